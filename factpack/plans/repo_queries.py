"""Queries over source repositories (no driver table holds source text, so they bring their own)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import focus_pack
from ..sources import ledger, repo, samples, specs
from ..tables import shared_dir
from . import compile as compiling
from . import evaluation, provenance, refine, scoring, semantics, tiers

_queries: dict = {}


def query(f):
    _queries[f.__name__] = f
    return f


def queries():
    return dict(_queries)


def _values(columns: str, rows: str) -> str:
    """A table of rows, one a line, with ``|`` between their columns."""
    each = ["(" + ", ".join("'" + x.replace("'", "''") + "'" for x in line.strip().split(" | ")) + ")" for line in rows.strip().split("\n")]
    return f"SELECT * FROM (VALUES {', '.join(each)}) AS t({columns})"


#: What the sample repositories hold, worked out by hand.
_EDGES = """
    library | def:lib/__init__.py:lib | def:lib/core.py:lib.core.load | import
    library | def:lib/core.py:lib.core | def:lib/helpers.py:lib.helpers | import
    library | def:lib/core.py:lib.core | def:lib/helpers.py:lib.helpers.tidy | import
    library | def:lib/core.py:lib.core.load | def:lib/helpers.py:lib.helpers.strip | call
    library | def:lib/core.py:lib.core.load | def:lib/helpers.py:lib.helpers.tidy | call
    library | def:lib/core.py:lib.core.load_all | def:lib/core.py:lib.core.load | call
    library | def:lib/helpers.py:lib.helpers.tidy | def:lib/helpers.py:lib.helpers.strip | call
    shop | def:shop/app.py:shop.app | def:shop/base.py:shop.base.Handler | import
    shop | def:shop/app.py:shop.app | def:shop/money.py:shop.money | import
    shop | def:shop/app.py:shop.app.Desk | def:shop/base.py:shop.base.Handler | inheritance
    shop | def:shop/app.py:shop.app.Desk.serve | def:shop/base.py:shop.base.Handler.check | call
    shop | def:shop/app.py:shop.app.Desk.serve | def:shop/money.py:shop.money.convert | call
    shop | def:shop/app.py:shop.app.route | def:shop/app.py:shop.app.Desk | call
    shop | def:shop/base.py:shop.base.Handler.handle | assign:shop/base.py:2:4:1 | attribute
    shop | def:shop/base.py:shop.base.Handler.handle | def:shop/base.py:shop.base.Handler.check | call
    shop | def:shop/money.py:shop.money.rounded | def:shop/money.py:shop.money.convert | call
"""
_OPEN = """
    library | open | unresolved_name | call
    library | text.strip | unresolved_attribute | call
    shop | from shop.money import * | star_import | unsupported
    shop | getattr(order, 'name') | reflective_builtin | unsupported
    shop | order.total | unresolved_attribute | attribute_access
    shop | route | unresolved_name | call
"""

_FACTS = """
    library | lib/__init__.py | definition 1, file 1, import 1
    library | lib/core.py | assignment 1, attribute 1, call 4, definition 3, file 1, import 2, parameter 2
    library | lib/helpers.py | attribute 1, call 2, definition 3, file 1, parameter 2
    shop | shop/__init__.py | definition 1, file 1
    shop | shop/app.py | assignment 2, attribute 4, base 1, call 6, decorator 1, definition 5, file 1, import 4, parameter 3
    shop | shop/base.py | assignment 1, attribute 2, call 1, definition 4, file 1, parameter 4
    shop | shop/broken.py | definition 1, diagnostic 1, file 1
    shop | shop/money.py | assignment 1, call 1, definition 3, file 1, parameter 2
"""
_BOUND = """
    library | def:lib/__init__.py:lib | load | import | import:lib/__init__.py:1:0:1:load:_
    library | def:lib/core.py:lib.core | helpers | import | import:lib/core.py:1:0:1:helpers:_
    library | def:lib/core.py:lib.core | load | definition | def:lib/core.py:lib.core.load
    library | def:lib/core.py:lib.core | load_all | definition | def:lib/core.py:lib.core.load_all
    library | def:lib/core.py:lib.core | tidy | import | import:lib/core.py:2:0:1:tidy:_
    library | def:lib/core.py:lib.core.load | path | parameter | parameter:def:lib/core.py:lib.core.load:0:positional_or_keyword:path
    library | def:lib/core.py:lib.core.load | text | assignment | assign:lib/core.py:5:4:1
    library | def:lib/core.py:lib.core.load_all | paths | parameter | parameter:def:lib/core.py:lib.core.load_all:0:positional_or_keyword:paths
    library | def:lib/helpers.py:lib.helpers | strip | definition | def:lib/helpers.py:lib.helpers.strip
    library | def:lib/helpers.py:lib.helpers | tidy | definition | def:lib/helpers.py:lib.helpers.tidy
    library | def:lib/helpers.py:lib.helpers.strip | text | parameter | parameter:def:lib/helpers.py:lib.helpers.strip:0:positional_or_keyword:text
    library | def:lib/helpers.py:lib.helpers.tidy | text | parameter | parameter:def:lib/helpers.py:lib.helpers.tidy:0:positional_or_keyword:text
    shop | def:shop/app.py:shop.app | Desk | definition | def:shop/app.py:shop.app.Desk
    shop | def:shop/app.py:shop.app | Handler | import | import:shop/app.py:1:0:1:Handler:_
    shop | def:shop/app.py:shop.app | Order | definition | def:shop/app.py:shop.app.Order
    shop | def:shop/app.py:shop.app | dataclass | import | import:shop/app.py:3:0:1:dataclass:_
    shop | def:shop/app.py:shop.app | m | import | import:shop/app.py:2:0:1:money:m
    shop | def:shop/app.py:shop.app | route | definition | def:shop/app.py:shop.app.route
    shop | def:shop/app.py:shop.app.Desk | serve | definition | def:shop/app.py:shop.app.Desk.serve
    shop | def:shop/app.py:shop.app.Desk.serve | order | parameter | parameter:def:shop/app.py:shop.app.Desk.serve:1:positional_or_keyword:order
    shop | def:shop/app.py:shop.app.Desk.serve | self | parameter | parameter:def:shop/app.py:shop.app.Desk.serve:0:positional_or_keyword:self
    shop | def:shop/app.py:shop.app.Order | name | class_attribute | assign:shop/app.py:8:4
    shop | def:shop/app.py:shop.app.Order | total | class_attribute | assign:shop/app.py:9:4
    shop | def:shop/app.py:shop.app.route | order | parameter | parameter:def:shop/app.py:shop.app.route:0:positional_or_keyword:order
    shop | def:shop/base.py:shop.base | Handler | definition | def:shop/base.py:shop.base.Handler
    shop | def:shop/base.py:shop.base.Handler | check | definition | def:shop/base.py:shop.base.Handler.check
    shop | def:shop/base.py:shop.base.Handler | handle | definition | def:shop/base.py:shop.base.Handler.handle
    shop | def:shop/base.py:shop.base.Handler | limit | class_attribute | assign:shop/base.py:2:4:1
    shop | def:shop/base.py:shop.base.Handler.check | order | parameter | parameter:def:shop/base.py:shop.base.Handler.check:1:positional_or_keyword:order
    shop | def:shop/base.py:shop.base.Handler.check | self | parameter | parameter:def:shop/base.py:shop.base.Handler.check:0:positional_or_keyword:self
    shop | def:shop/base.py:shop.base.Handler.handle | order | parameter | parameter:def:shop/base.py:shop.base.Handler.handle:1:positional_or_keyword:order
    shop | def:shop/base.py:shop.base.Handler.handle | self | parameter | parameter:def:shop/base.py:shop.base.Handler.handle:0:positional_or_keyword:self
    shop | def:shop/money.py:shop.money | RATE | assignment | assign:shop/money.py:1:0:1
    shop | def:shop/money.py:shop.money | convert | definition | def:shop/money.py:shop.money.convert
    shop | def:shop/money.py:shop.money | rounded | definition | def:shop/money.py:shop.money.rounded
    shop | def:shop/money.py:shop.money.convert | amount | parameter | parameter:def:shop/money.py:shop.money.convert:0:positional_or_keyword:amount
    shop | def:shop/money.py:shop.money.rounded | amount | parameter | parameter:def:shop/money.py:shop.money.rounded:0:positional_or_keyword:amount
"""
_IMPORTED = """
    library | import:lib/__init__.py:1:0:1:load:_ | load | definition | lib.core.load | def:lib/core.py:lib.core.load
    library | import:lib/core.py:1:0:1:helpers:_ | helpers | module | lib.helpers | def:lib/helpers.py:lib.helpers
    library | import:lib/core.py:2:0:1:tidy:_ | tidy | definition | lib.helpers.tidy | def:lib/helpers.py:lib.helpers.tidy
    shop | import:shop/app.py:1:0:1:Handler:_ | Handler | definition | shop.base.Handler | def:shop/base.py:shop.base.Handler
    shop | import:shop/app.py:2:0:1:money:m | m | module | shop.money | def:shop/money.py:shop.money
    shop | import:shop/app.py:3:0:1:dataclass:_ | dataclass | external | dataclasses.dataclass | -
"""
_FILE_PACKS = """
    q_convert:file_order_floor:120 | shop/__init__.py,shop/base.py,shop/broken.py | - | 99 | True
    q_convert:file_order_floor:260 | shop/__init__.py,shop/app.py,shop/base.py,shop/broken.py,shop/money.py | - | 232 | True
    q_convert:import_neighborhood_files:120 | shop/money.py | import_not_resolved,star_import_not_expanded | 78 | True
    q_convert:import_neighborhood_files:260 | shop/money.py,shop/app.py,shop/base.py | import_not_resolved,star_import_not_expanded | 224 | True
    q_convert:lexical_top_k_files:120 | shop/money.py,shop/base.py | - | 118 | True
    q_convert:lexical_top_k_files:260 | shop/money.py,shop/app.py,shop/base.py | - | 219 | True
    q_desk:file_order_floor:120 | shop/__init__.py,shop/base.py,shop/broken.py | - | 94 | True
    q_desk:file_order_floor:260 | shop/__init__.py,shop/app.py,shop/base.py,shop/broken.py,shop/money.py | - | 227 | True
    q_desk:import_neighborhood_files:120 | shop/base.py,shop/money.py | import_not_resolved,star_import_not_expanded | 117 | True
    q_desk:import_neighborhood_files:260 | shop/app.py,shop/base.py,shop/money.py | import_not_resolved,star_import_not_expanded | 219 | True
    q_desk:lexical_top_k_files:120 | shop/base.py | - | 82 | True
    q_desk:lexical_top_k_files:260 | shop/app.py,shop/base.py | - | 183 | True
    q_load:file_order_floor:120 | shop/__init__.py,shop/base.py,shop/broken.py | - | 93 | True
    q_load:file_order_floor:260 | shop/__init__.py,shop/app.py,shop/base.py,shop/broken.py,shop/money.py | - | 226 | True
    q_load:import_neighborhood_files:120 | - | no_positive_seed | 41 | True
    q_load:import_neighborhood_files:260 | - | no_positive_seed | 41 | True
    q_load:lexical_top_k_files:120 | - | no_positive_lexical_score | 40 | True
    q_load:lexical_top_k_files:260 | - | no_positive_lexical_score | 40 | True
"""


def oracle_sql():
    empty = lambda c: f"CASE WHEN {c} = '-' THEN '' ELSE {c} END AS {c}"
    return {
        "q_py_facts": f"WITH v AS ({_values('repo_id, path, facts', _FACTS)}), e AS (SELECT repo_id, path, unnest(string_split(facts, ', ')) AS x FROM v) SELECT repo_id, path, split_part(x, ' ', 1) AS fact, CAST(split_part(x, ' ', 2) AS BIGINT) AS n FROM e",
        "q_bindings": _values("repo_id, scope_id, name, binding_kind, symbol_id", _BOUND),
        "q_resolved_imports": f"SELECT * REPLACE (nullif(target, '-') AS target) FROM ({_values('repo_id, import_id, bound_name, target_kind, target_name, target', _IMPORTED)})",
        "q_file_packs": f"SELECT run_id, {empty('files')}, {empty('warnings')}, CAST(total_tokens AS INTEGER) AS total_tokens, CAST(fits AS BOOLEAN) AS fits FROM ({_values('run_id, files, warnings, total_tokens, fits', _FILE_PACKS)})",
        "q_provenance": "SELECT 'shop' AS repo_id, 'getattr' AS family, 'unsupported:call:shop/app.py:18:4' AS construct_id, CAST(2 AS INTEGER) AS argc",
        "q_dependencies": _values("repo_id, src, dst, kind", _EDGES),
        "q_frontier": _values("repo_id, text, reason_code, context", _OPEN),
        "q_ledger_roundtrip": """
            SELECT o_orderpriority AS provider_name, count(*) AS n_runs, round(avg((o_totalprice < 300000)::INT), 6) AS compliance_rate, round(avg(round(o_totalprice / 600000, 6)), 6) AS avg_aggregate_score,
              round(avg(CASE WHEN o_orderstatus <> 'O' THEN 0.5::DOUBLE END), 6) AS avg_support_coverage, NULL::DOUBLE AS avg_uncertainty_honesty
            FROM orders GROUP BY o_orderpriority
        """,
        "q_ledger_winners": """
            WITH r AS (SELECT o_orderstatus AS task_id, CAST(o_orderkey % 3 * 100 + 100 AS INTEGER) AS budget, o_orderpriority AS p, round(o_totalprice / 600000, 6) AS s FROM orders),
            m AS (SELECT task_id, budget, max(s) AS score FROM r GROUP BY ALL)
            SELECT task_id, budget, string_agg(DISTINCT p, ',' ORDER BY p) AS winners, score FROM r JOIN m USING (task_id, budget) WHERE s = score GROUP BY ALL
        """,
        "q_ledger_violations": "SELECT 'malformed' AS reason, count(*) AS n FROM documents UNION ALL SELECT 'duplicate_run_id', 1 FROM orders WHERE o_orderkey = 1",
    }


def _files(spark):
    return repo.from_texts(spark, samples.REPOS)


def _asked(spark):
    return spark.createDataFrame(samples.QUERIES, "query_id string, query string, budget int")


@query
def q_py_facts(spark, sf_dir):
    """Syntax facts by repository, file and kind."""
    return repo.facts(_files(spark)).groupBy("repo_id", "path", "fact").agg(F.count("*").alias("n"))


@query
def q_bindings(spark, sf_dir):
    """Names bound in each scope, by kind."""
    facts = repo.facts(_files(spark))
    bad = facts.where("fact = 'diagnostic'").select("repo_id", "path").distinct()
    _, bindings = semantics.bind(facts.join(bad, ["repo_id", "path"], "left_anti"))
    return bindings.select("repo_id", "scope_id", "name", "binding_kind", "symbol_id")


@query
def q_resolved_imports(spark, sf_dir):
    """Imports with a proven target."""
    return semantics.analyse(_files(spark)).imports.select("repo_id", "import_id", "bound_name", "target_kind", "target_name", "target")


@query
def q_dependencies(spark, sf_dir):
    """Proven edges between symbols."""
    return semantics.analyse(_files(spark)).dependencies.select("repo_id", "src", "dst", "kind")


@query
def q_frontier(spark, sf_dir):
    """What could not be proven, with the reason."""
    program = semantics.analyse(_files(spark))
    open_ = program.frontier.select("repo_id", F.col("access_text").alias("text"), "reason_code", "context")
    return open_.unionByName(program.unsupported.select("repo_id", F.col("construct_text").alias("text"), "reason_code", F.lit("unsupported").alias("context")))


@query
def q_compile(spark, sf_dir):
    """A compiled document for each query and repository."""
    found = compiling.compile_context(_files(spark), _asked(spark))
    return found.select("query_id", "repo_id", "budget", "total_tokens", F.round("confidence", 6).alias("confidence"), F.size("selections").alias("n_selected"), F.size("omitted_unit_ids").alias("n_omitted"), F.md5("document").alias("document_md5"))


@query
def q_focus_pack(spark, sf_dir):
    """Focus packing of all documents: a source is a repository, a document supports the next one in it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    after = docs.select("source", F.col("doc_id").alias("d")).groupBy("source").agg(F.array_sort(F.collect_list("d")).alias("ids"))
    pairs = after.select(F.col("source").alias("repo_id"), F.inline(F.zip_with(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    edges = pairs.select("repo_id", F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"))
    wanted = F.array(*[F.lit(x) for x in spark.range(1).select(X.terms(F.lit("the house of water and stone"))).first()[0]])
    kind = F.when(F.col("lang") == "en", "proven_symbol").otherwise("unresolved_frontier")
    parts = {"identity": F.substring("text", 1, 40), "summary": F.substring("text", 1, 160), "source": F.col("text")}
    units = docs.select(F.col("source").alias("repo_id"), F.col("doc_id").cast("string").alias("unit_id"), F.col("doc_id").cast("string").alias("primary_text"), kind.alias("kind"), F.col("lang").alias("path"), F.lit(1).alias("sl"), F.lit(0).alias("sc"), F.lit(None).cast("string").alias("enclosing_scope_id"), F.lit(None).cast("string").alias("file_scope_id"), X.overlap(wanted, X.terms(F.col("text"))).alias("p_edit"), *[c.alias(k) for k, c in parts.items()])
    units = units.withColumns({f"{k}_tokens": X.estimate_tokens(F.col(k)) for k in parts})
    scores = units.select(F.lit("q").alias("query_id"), "repo_id", "unit_id", "p_edit", (0.3 * F.col("p_edit")).alias("p_support"))
    budgets = spark.range(1).select(F.lit("q").alias("query_id"), F.lit(4000).alias("budget"))
    # the document text is not part of the result, so the texts are not sent to the packer
    light = units.drop("p_edit").withColumns({k: F.lit("") for k in parts})
    packed = focus_pack.pack_table(light, scores, edges, budgets, whole=False)
    return packed.select(F.col("repo_id").alias("source"), F.col("unit_id").cast("long").alias("doc_id"), "rank", "detail", "token_count", "total_tokens", F.round("confidence", 6).alias("confidence"))


def _runs(spark):
    rows = [(f"{q}:{p}:{b}", "task", q, text, "shop", p, b) for q, text, _ in samples.QUERIES for p in ("lexical_top_k_files", "import_neighborhood_files", "file_order_floor") for b in (120, 260)]
    return spark.createDataFrame(rows, "run_id string, task_id string, query_id string, query string, repo_id string, provider string, budget int")


@query
def q_file_packs(spark, sf_dir):
    """Whole-file packs of the three file baselines."""
    files = _files(spark)
    packed = evaluation.file_runs(semantics.analyse(files), files, _runs(spark))
    return packed.select("run_id", F.array_join("files", ",").alias("files"), F.array_join("warnings", ",").alias("warnings"), "total_tokens", "fits")


@query
def q_tiers(spark, sf_dir):
    """Five-tier packs of the sample repositories."""
    found = tiers.compile_tiers(_files(spark), _asked(spark))
    return found.select("query_id", "repo_id", "node_id", "tier", "token_cost", "reason", "total_tokens")


def _ledger(spark, sf_dir):
    """Orders as runs: the priority is the provider, the status the task, a price band the budget."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    share = lambda c: F.round(c, 6)
    metrics = F.struct(
        (F.col("o_totalprice") < 300000).alias("budget_compliant"), share(F.col("o_totalprice") / 600000).alias("aggregate_score"), F.lit(1.0).alias("edit_coverage"),
        F.when(F.col("o_orderstatus") != "O", 0.5).alias("support_coverage"), F.lit(0.25).alias("representation_adequacy"), F.lit(None).cast("double").alias("uncertainty_honesty"), F.lit(0.125).alias("noise_efficiency"),
    )
    return orders.select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderstatus").alias("task_id"), F.col("o_orderpriority").alias("provider_name"), (F.col("o_orderkey") % 3 * 100 + 100).cast("int").alias("budget"), metrics.alias("metrics"))


@query
def q_ledger_roundtrip(spark, sf_dir):
    """Runs written as JSON lines, read strictly, and rolled up by provider."""
    path = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    ledger.append(_ledger(spark, sf_dir), path)
    found = evaluation.summarise(ledger.read(spark, path))["providers"]
    return found.select("provider_name", "n_runs", F.round("compliance_rate", 6).alias("compliance_rate"), *[F.round(f"avg_{c}", 6).alias(f"avg_{c}") for c in ("aggregate_score", "support_coverage", "uncertainty_honesty")])


@query
def q_ledger_winners(spark, sf_dir):
    """The best providers of each task and budget."""
    lines = _ledger(spark, sf_dir).select(F.to_json(F.struct("*")).alias("line"))
    found = evaluation.summarise(ledger.typed(lines))["winners"]
    return found.select("task_id", "budget", F.array_join("winners", ",").alias("winners"), "score")


@query
def q_ledger_violations(spark, sf_dir):
    """Lines that no ledger may have: one for every document beside good lines, and one run twice."""
    good = _ledger(spark, sf_dir).select(F.to_json(F.struct("*")).alias("line"))
    bad = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("{"), F.col("source")).alias("line"))
    found = ledger.violations(good.unionByName(bad).unionByName(good.where("line like '%\"run_id\":\"1\",%'")))
    return found.groupBy("reason").agg(F.count("*").alias("n"))


@query
def q_provenance(spark, sf_dir):
    """Boundaries that runtime observations may explain."""
    return provenance.eligible(semantics.analyse(_files(spark))).select("repo_id", "family", "construct_id", "argc")


@query
def q_refine(spark, sf_dir):
    """What a reported miss was about, and why the pack missed it."""
    program = semantics.analyse(_files(spark))
    asked = _asked(spark).where("query_id = 'q_convert'").withColumn("budget", F.lit(40))
    packed, units = compiling.pack_units(program, asked), scoring.units(program)
    none = provenance.attach(program, spark.createDataFrame([], specs.OBSERVATIONS))
    misses = spark.createDataFrame([("m1", "q_convert", "shop", "absent_symbol", "route"), ("m2", "q_convert", "shop", "edit_to_omitted_path", "shop/money.py"), ("m3", "q_convert", "shop", "out_of_pack_trace", 'File "shop/base.py", line 5, in handle')], "miss_id string, query_id string, repo_id string, kind string, evidence string")
    return refine.diagnose(misses, units, packed, provenance.trace_summaries(units, none))
