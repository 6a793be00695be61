"""Units at three details with their token costs, and their scores against any number of queries.

All of it is built-in expressions and joins. A query is a row (query_id, query); units and queries meet
in one join on the repository, so a table of queries is scored in one pass over the renders.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph
from .semantics import Program

DETAILS = ("identity", "summary", "source")
PROVEN, FRONTIER, UNSUPPORTED = "proven_symbol", "unresolved_frontier", "unsupported_construct"
#: Weights of direct scores.
SUPPORT_SHARE, EDIT_MEANING, SUPPORT_MEANING = 0.30, 0.20, 0.20
_BODY_KINDS = ["function", "async_function", "class", "method"]


def _lines(*parts: Column) -> Column:
    """Lines joined; null lines are left out, empty ones are kept."""
    return F.concat_ws("\n", *parts)


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def units(program: Program) -> DataFrame:
    """(repo_id, unit_id, kind, ...) with identity, summary and source text of every unit."""
    span = X.span(F.col("sl"), F.col("sc"), F.col("el"), F.col("ec"))
    site = F.concat(F.col("path"), F.lit(":"), span)
    fields = F.transform(F.array_sort(F.collect_list(F.struct("sl", "sc", "name", "annotation", "default"))), lambda f: F.concat(f["name"], F.lit(": "), f["annotation"], F.coalesce(F.concat(F.lit(" = "), f["default"]), F.lit(""))))
    models = program.dataclasses.groupBy("repo_id", F.col("class_id").alias("unit_id")).agg(F.lit(True).alias("model"), F.array_join(fields, "; ").alias("fields"))
    symbols = program.symbols.select("repo_id", F.col("symbol_id").alias("unit_id"), F.col("kind").alias("symbol_kind"), "qualified_name", "defining_scope_id", "path", "sl", "sc", "el", "ec", "snippet")
    symbols = symbols.join(models, ["repo_id", "unit_id"], "left")
    facts = [_line("qualified_name", F.col("qualified_name")), _line("unit_id", F.col("unit_id")), _line("file", F.col("path")), _line("span", span)]
    summary = _lines(
        F.concat(F.lit("proven summary: "), F.col("symbol_kind"), F.lit(" "), F.col("qualified_name"), F.lit(" @ "), site),
        F.when(F.col("model"), F.lit("decorators: dataclass")),
        F.when(F.col("model"), F.lit("dataclass: dataclasses.dataclass")),
        F.when(F.col("fields") != "", F.concat(F.lit("fields: "), F.col("fields"))),
    )
    missing = _lines(F.lit("proven symbol source unavailable"), _line("kind", F.col("symbol_kind")), *facts, F.lit("reason: exact source span could not be read from disk"))
    place = ["path", "sl", "sc"]
    proven = symbols.select(
        "repo_id", "unit_id", F.lit(PROVEN).alias("kind"), "symbol_kind", F.col("qualified_name").alias("primary_text"), F.lit(None).cast("string").alias("scope_id"), *place,
        _lines(F.lit("proven symbol"), _line("kind", F.col("symbol_kind")), *facts, F.lit("proof_status: proven")).alias("identity"),
        summary.alias("summary"), F.coalesce("snippet", missing).alias("source"),
        F.lit("").alias("extra"),
    )
    snippet = F.coalesce(F.concat(F.lit("source_snippet:\n"), F.col("snippet")), F.lit("source_unavailable: no local snippet recorded"))
    long = _lines(F.lit("unresolved frontier item"), _line("unit_id", F.col("access_id")), F.lit("proof_status: unknown"), _line("reason_code", F.col("reason_code")), _line("context", F.col("context")), _line("file", F.col("path")), _line("span", span), _line("text", F.col("access_text")))
    frontier = program.frontier.select(
        "repo_id", F.col("access_id").alias("unit_id"), F.lit(FRONTIER).alias("kind"), F.lit(None).cast("string").alias("symbol_kind"), F.col("access_text").alias("primary_text"), "scope_id", *place,
        F.concat(F.lit("unresolved: "), F.col("access_text"), F.lit(" @ "), F.col("path"), F.format_string(":%d:%d", "sl", "sc")).alias("identity"),
        long.alias("summary"), _lines(long, snippet).alias("source"), _lines(F.col("reason_code"), F.col("context")).alias("extra"),
    )
    short = _lines(F.lit("unsupported construct"), _line("unit_id", F.col("construct_id")), _line("text", F.col("construct_text")), F.lit(f"kind: {UNSUPPORTED}"), _line("file", F.col("path")), _line("span", span))
    longer = _lines(F.lit("unsupported construct"), _line("unit_id", F.col("construct_id")), F.lit("proof_status: unsupported"), _line("reason_code", F.col("reason_code")), F.lit("context: unavailable"), _line("file", F.col("path")), _line("span", span), _line("text", F.col("construct_text")), _line("enclosing_scope_id", F.col("scope_id")))
    unsupported = program.unsupported.select(
        "repo_id", F.col("construct_id").alias("unit_id"), F.lit(UNSUPPORTED).alias("kind"), F.lit(None).cast("string").alias("symbol_kind"), F.col("construct_text").alias("primary_text"), "scope_id", *place,
        short.alias("identity"), longer.alias("summary"), _lines(longer, snippet).alias("source"), F.col("reason_code").alias("extra"),
    )
    every = proven.unionByName(frontier).unionByName(unsupported).dropDuplicates(["repo_id", "unit_id"])
    modules = program.symbols.where("kind = 'module'").groupBy("repo_id", "path").agg(F.min("symbol_id").alias("file_scope_id"))
    scopes = program.symbols.select("repo_id", F.col("symbol_id").alias("unit_id"), F.col("defining_scope_id").alias("own_scope"))
    every = every.join(modules, ["repo_id", "path"], "left").join(scopes, ["repo_id", "unit_id"], "left")
    costs = {f"{d}_tokens": X.estimate_tokens(F.col(d)) for d in DETAILS}
    return every.withColumns(costs | {"enclosing_scope_id": F.coalesce("scope_id", "own_scope")}).drop("own_scope")


def direct(unit_table: DataFrame, queries: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """(query_id, repo_id, unit_id, kind, scope_id, p_edit, p_support) from the texts alone."""
    joined = lambda *c: F.array_join(F.filter(F.array(*c), lambda x: x.isNotNull() & (x != "")), "\n")
    searchable = joined(F.col("primary_text"), F.col("path"), F.col("extra"), F.col("summary"))
    body = F.when(F.col("symbol_kind").isin(_BODY_KINDS), F.col("source"))
    rows = unit_table.select("repo_id", "unit_id", "kind", "scope_id", "primary_text", "path", searchable.alias("searchable"), body.alias("body"))
    rows = asked_of(rows, queries)
    lexical = X.relevance(F.col("query"), F.col("primary_text"), F.col("searchable"), F.col("path"), F.col("body"))
    if embed is None:
        meaning = F.lit(0.0)
    else:
        similar = F.pandas_udf("array<double>")(_embedded(embed))
        rows = rows.withColumns({"_q": similar("query"), "_t": similar("searchable")})
        meaning = X.clamp(X.cosine(F.col("_q"), F.col("_t")))
    rows = rows.withColumns({"lexical": lexical, "meaning": meaning})
    asked = F.size(X.terms(F.col("query"))) > 0
    edit = X.clamp(F.col("lexical") * (1 - EDIT_MEANING) + F.col("meaning") * EDIT_MEANING)
    support = X.clamp(F.col("lexical") * SUPPORT_SHARE + F.col("meaning") * SUPPORT_MEANING)
    return rows.select("query_id", "repo_id", "unit_id", "kind", "scope_id", F.when(asked, edit).otherwise(0.0).alias("p_edit"), F.when(asked, support).otherwise(0.0).alias("p_support"))


#: Queries of a block: what meets each row at once.
QUERY_BLOCK = 256


def asked_of(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """rows with each query: of their repository where queries name one, of all rows else.

    A stated query set meets all rows in blocks: queries are gathered into blocks of a bounded size and
    each row goes to each block, an equi-join, so that any number of queries works and none is broadcast.
    """
    if "repo_id" in queries.columns:
        return rows.join(queries, "repo_id")
    n = 1 + queries.count() // QUERY_BLOCK
    held = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")).groupBy("_block").agg(F.collect_list(F.struct(*queries.columns)).alias("_asked"))
    dealt = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return dealt.join(held, "_block").withColumn("_q", F.explode("_asked")).select(*rows.columns, "_q.*")


def _embedded(embed):
    def run(texts: pd.Series) -> pd.Series:
        found = embed(texts.fillna("").tolist())
        if len(found) != len(texts):
            raise ValueError("embed must return one vector for each text")
        return pd.Series([[float(x) for x in v] for v in found])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return run


def score(program: Program, unit_table: DataFrame, queries: DataFrame, embed=None) -> DataFrame:
    """(query_id, repo_id, unit_id, p_edit, p_support): direct, then orchestration, dependency and scope."""
    first = direct(unit_table, queries, embed)
    # a unit of a query is a vertex of its own
    vertex = lambda c: F.concat_ws("\x01", "query_id", "repo_id", c)
    base = first.withColumnRenamed("unit_id", "unit").withColumn("unit_id", vertex("unit"))
    edges = program.dependencies.select("repo_id", "src", "dst").join(first.select("query_id", "repo_id").distinct(), "repo_id").select(vertex("src").alias("src"), vertex("dst").alias("dst"))
    raised = graph.orchestrated(base.select("unit_id", "query_id", "repo_id", "unit", "kind", "scope_id", "p_edit", "p_support"), edges)
    source = raised.select(F.col("unit_id").alias("src"), F.col("p_edit").alias("e"))
    proofs = edges.join(source, "src").select(F.col("dst").alias("unit_id"), (F.col("e") * graph.DEPENDENCY).alias("boost"))
    open_ = raised.where((F.col("kind") != PROVEN) & F.col("scope_id").isNotNull()).select("unit_id", vertex("scope_id").alias("src"))
    scopes = open_.join(source, "src").select("unit_id", (F.col("e") * graph.SCOPE).alias("boost"))
    found = graph.support(raised, proofs.unionByName(scopes))
    return found.select("query_id", "repo_id", F.col("unit").alias("unit_id"), "p_edit", "p_support")
