"""The query catalogue: one entry per operator over the driver's tables, with DuckDB SQL beside it."""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import folds, graph, intervals, relational, rollups

QUERY = "the second passage of water and Stone_House walk"
BUDGET = 4000

_queries: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = inspect.cleandoc(sql)
        return f

    return register


def queries():
    from . import repo_queries

    return _queries | repo_queries.queries()


def oracle_sql():
    from . import repo_queries

    return _sql | repo_queries.oracle_sql()


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents; a table of fewer files than there are cores is dealt to all of them.

    Work on text is bound by the processor, and a single file of one row group is a single task. A table of
    many files is read as it lies, without a shuffle.
    """
    docs = _t(spark, sf_dir, "documents").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if len(docs.inputFiles()) < cores else docs


# A: text

_TOKENS = """list_transform(flatten(list_transform(list_filter(regexp_split_to_array(coalesce({0}, ''), '[^A-Za-z0-9]+'), lambda x: x != ''),
  lambda y: list_concat([y], regexp_extract_all(regexp_replace(y, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+\\b|[0-9]+')))), lambda z: lower(z))"""
_DISTINCT = "list_filter({0}, lambda v, i: list_position({0}, v) = i)"


@query("SELECT doc_id, CAST(greatest(1, (length(text) + 3) // 4) AS BIGINT) AS tokens, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens_low FROM documents")
def q_token_estimate(spark, sf_dir):
    """Both token estimates of every document."""
    return _t(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"), X.estimate_tokens_low(F.col("text")).alias("tokens_low"))


@query(f"""
    WITH b AS (SELECT doc_id, {_TOKENS.format('text')} AS bag FROM documents)
    SELECT doc_id, CAST(len(list_distinct(bag)) AS BIGINT) AS n_terms, CAST(len(bag) AS BIGINT) AS n_tokens, md5(array_to_string(list_sort(list_distinct(bag)), ' ')) AS terms_md5 FROM b
""")
def q_terms(spark, sf_dir):
    """Terms and tokens of every document."""
    bag = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", X.tokens(F.col("text")).alias("bag"))
    return bag.select("doc_id", F.size(F.array_distinct("bag")).cast("long").alias("n_terms"), F.size("bag").cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort(F.array_distinct("bag")), " ")).alias("terms_md5"))


@query(f"""
    WITH b AS (SELECT lang, unnest({_TOKENS.format('text')}) AS term FROM documents)
    SELECT lang, term, count(*) AS n FROM b GROUP BY ALL
""")
def q_term_counts(spark, sf_dir):
    """How often each term occurs in each language."""
    return _docs(spark, sf_dir, "lang", "text").select("lang", F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))


def _wanted(spark) -> list[str]:
    """The query's terms, as literals, so that Catalyst folds what depends on them alone."""
    return spark.range(1).select(X.terms(F.lit(QUERY))).first()[0]


@query(f"""
    WITH q AS (SELECT {_TOKENS.format(f"'{QUERY}'")} AS bag), w AS (SELECT list_distinct(bag) AS ts FROM q),
    d AS (SELECT doc_id, source, greatest(1, (length(text) + 3) // 4) AS tokens, {_TOKENS.format('text')} AS c, {_TOKENS.format('source')} AS p, ts FROM documents, w),
    s AS (SELECT doc_id, tokens, 0.75 * len(list_filter(ts, lambda t: list_contains(c, t))) / len(ts) + 0.20 * len(list_filter(ts, lambda t: list_contains(p, t))) / len(ts)
      + 0.05 * least(1.0, list_sum(list_transform(ts, lambda t: least(3, len(list_filter(c, lambda x: x = t))))) / (3.0 * len(ts))) AS score FROM d)
    SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY round(s.score, 9) DESC, s.tokens, doc_id LIMIT 8
""")
def q_lexical_topk(spark, sf_dir):
    """The eight best documents for a query, by the lexical file score; a top-k without a full sort."""
    wanted = F.array(*[F.lit(x) for x in _wanted(spark)])
    score = X.file_score(wanted, X.tokens(F.col("text")), X.tokens(F.col("source")))
    # exploded, the score is computed once: a filter on a plain column would move below it with a copy
    docs = _docs(spark, sf_dir, "doc_id", "text", "source").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"), F.explode(F.array(score)).alias("score"))
    return docs.where("score > 0").orderBy(F.round("score", 9).desc(), "tokens", "doc_id").limit(8).select("doc_id", "tokens", F.round("score", 6).alias("score"))


@query("""
    SELECT item_id, doc_id, CASE WHEN lower(d.text) = lower(b.text) THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS score FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))
""")
def q_phrase_match(spark, sf_dir):
    """Benchmark items that a document contains whole, letter case aside."""
    items = _t(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("phrase"))
    docs = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.lower("text").alias("body"))
    whole = folds.phrases(items, "item_id", "phrase", docs, "doc_id", "body")
    return whole.select("item_id", "doc_id", X.phrase(F.col("phrase"), F.col("body")).alias("score"))


@query("""
    WITH w AS (SELECT doc_id AS id, string_split(text, ' ') AS ws FROM documents), v AS (SELECT item_id AS id, string_split(text, ' ') AS ws FROM benchmark),
    dg AS (SELECT DISTINCT id, ws[i] || ' ' || ws[i+1] AS g FROM (SELECT id, ws, unnest(range(1, len(ws))) AS i FROM w)),
    bg AS (SELECT DISTINCT id, ws[i] || ' ' || ws[i+1] AS g FROM (SELECT id, ws, unnest(range(1, len(ws))) AS i FROM v)),
    n AS (SELECT id, count(*) AS n FROM bg GROUP BY id),
    p AS (SELECT bg.id AS item_id, dg.id AS doc_id, count(*) AS shared FROM bg JOIN dg USING (g) GROUP BY ALL)
    SELECT item_id, doc_id, shared, round(shared / n, 6) AS share FROM p JOIN n ON n.id = item_id WHERE shared * 2 >= n
""")
def q_ngram_overlap(spark, sf_dir):
    """Items of whose bigrams a document has half or more: an equi-join on bigrams, summed up by pair."""
    grams = lambda df, c: df.select(c, F.explode(X.ngrams(F.split("text", " "))).alias("g"))
    items = grams(_t(spark, sf_dir, "benchmark"), "item_id")
    sizes = items.groupBy("item_id").agg(F.count("*").alias("n"))
    shared = items.join(grams(_docs(spark, sf_dir, "doc_id", "text"), "doc_id"), "g").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    return shared.join(sizes, "item_id").where("shared * 2 >= n").select("item_id", "doc_id", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("share"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def q_content_hash(spark, sf_dir):
    """The SHA-256 of every document."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("""
    WITH p AS (SELECT vec_id AS probe, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT probe, vec_id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM p, embeddings WHERE probe <> vec_id)
    SELECT probe, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY probe ORDER BY score DESC, vec_id) <= 8
""")
def q_cosine_topk(spark, sf_dir):
    """For every vector whose id is divisible by 100, the eight nearest of all vectors by cosine."""
    rows = _t(spark, sf_dir, "embeddings")
    probes = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("probe"), F.col("embedding").alias("e"))
    found = folds.nearest(rows, "vec_id", "embedding", probes, "probe", "e", 8)
    return found.select("probe", "vec_id", F.col("score"))


@query("""
    WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/+', '/', 'g'), '/') AS s FROM pages),
    x AS (SELECT page_id, array_to_string(list_filter(s, lambda v: v <> ''), '/') AS path FROM p),
    l AS (SELECT DISTINCT string_split(path, '/')[-1] AS want FROM x)
    SELECT want, page_id FROM l JOIN x ON x.path = want OR suffix(x.path, '/' || want)
""")
def q_url_suffix(spark, sf_dir):
    """Pages whose path ends in a wanted suffix: suffixes are rows, so it is an equi-join."""
    pages = _t(spark, sf_dir, "pages").select("page_id", F.explode(_suffixes(F.col("url"))).alias("want"))
    wanted = _t(spark, sf_dir, "pages").select(F.element_at(_suffixes(F.col("url")), -1).alias("want")).distinct()
    return pages.join(wanted, "want").select("want", "page_id")


def _suffixes(url):
    return relational.path_suffixes(F.regexp_replace(url, "^[a-z]+://", ""))


# B: joins


@query("""
    WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), s AS (SELECT * FROM events WHERE event_type = 'signup')
    SELECT p.event_id, p.user_id, s.event_id AS signup_id FROM p LEFT JOIN s ON s.user_id = p.user_id AND s.ts < p.ts
    QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY s.ts DESC NULLS LAST, s.event_id DESC) = 1
""")
def q_asof_event(spark, sf_dir):
    """For each purchase the user's last sign-up before it: one ordered stream, not a join of pairs."""
    events = _t(spark, sf_dir, "events")
    asks = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    theirs = events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"), F.col("event_id").alias("tie"))
    found = relational.as_of(asks.withColumnRenamed("ts", "asked"), theirs, ["user_id"], "asked", "ts", ["signup_id"], "tie")
    return found.select("event_id", "user_id", "signup_id")


@query("""
    WITH b AS (SELECT 'c' || o_custkey AS scope, o_orderdate AS d, o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_totalprice > 300000
      UNION ALL SELECT 'n' || c_nationkey, o_orderdate, o_orderkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 350000
      UNION ALL SELECT 'r' || n_regionkey, o_orderdate, o_orderkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 400000),
    a AS (SELECT c_custkey, 'c' || c_custkey AS scope, 0 AS depth FROM customer UNION ALL SELECT c_custkey, 'n' || c_nationkey, 1 FROM customer
      UNION ALL SELECT c_custkey, 'r' || n_regionkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT c_custkey, k AS orderkey, depth FROM a JOIN b USING (scope) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY depth, d DESC, k DESC) = 1
""")
def q_asof_hierarchy(spark, sf_dir):
    """Each customer's latest large order of the nearest level: own, nation's, region's.

    Bindings are cut to the last one of each scope first, as no later pick can choose another.
    """
    nation = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    people = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nation), "c_nationkey")
    scope = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    levels = [(0, scope("c", "c_custkey"), 300000), (1, scope("n", "c_nationkey"), 350000), (2, scope("r", "n_regionkey"), 400000)]
    ancestors = people.select(F.col("c_custkey").alias("scope"), F.explode(F.array(*[F.struct(s.alias("ancestor"), F.lit(d).alias("depth")) for d, s, _ in levels])).alias("x")).select("scope", "x.*")
    orders = _t(spark, sf_dir, "orders").where("o_totalprice > 300000").join(people, F.col("o_custkey") == F.col("c_custkey"))
    each = F.filter(F.array(*[F.when(F.col("o_totalprice") > low, s) for _, s, low in levels]), lambda x: x.isNotNull())
    bound = orders.select(F.explode(each).alias("ancestor"), "o_orderdate", "o_orderkey")
    last = relational.last_per_key(bound, ["ancestor"], [F.col("o_orderdate")], ["o_orderkey"])
    last = last.select("ancestor", F.lit("").alias("name"), F.lit(0).alias("seq"), F.col("o_orderkey").alias("orderkey"), F.lit(0).alias("x"))
    asks = people.select(F.col("c_custkey").alias("scope"), "c_custkey", F.lit("").alias("name"))
    found = relational.nearest_scope(asks.join(ancestors, "scope").select("scope", "c_custkey", "name"), ancestors, last, ["c_custkey"], F.lit(True), "depth", "seq", ["orderkey", "depth"])
    return found.select("c_custkey", "orderkey", "depth")


@query("""
    WITH u AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, min(o_orderkey) AS k FROM orders GROUP BY ALL HAVING count(*) = 1)
    SELECT k AS orderkey, count(*) AS n_lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM u JOIN lineitem ON l_orderkey = k GROUP BY k
""")
def q_unique_key(spark, sf_dir):
    """Lines of the orders that are their customer's only ones of a day."""
    orders = _t(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), "o_orderkey")
    alone = relational.unique_key(orders, ["o_custkey", "d"], orderkey=F.col("o_orderkey"))
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_quantity")
    return lines.join(alone.select("orderkey"), "orderkey").groupBy("orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS orderkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority FROM orders GROUP BY o_custkey")
def q_last_per_key(spark, sf_dir):
    """Each customer's last order."""
    found = relational.last_per_key(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate")], ["o_orderkey", "o_orderpriority"])
    return found.select("o_custkey", F.col("o_orderkey").alias("orderkey"), F.col("o_orderpriority").alias("priority"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def q_keep_first(spark, sf_dir):
    """The first document of each identical text; what is shuffled is a hash, not the text."""
    hashed = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("text_md5"))
    return relational.keep_first(hashed, ["sha"], [F.col("doc_id")], ["doc_id", "text_md5"]).select("doc_id", "text_md5")


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def q_anti_quarantine(spark, sf_dir):
    """Documents without a toxic label."""
    bad = _t(spark, sf_dir, "labels").where("toxic = 1")
    return relational.quarantine(_t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), bad, ["doc_id"])


@query("""
    WITH r AS (SELECT n_nationkey AS rule, n_nationkey AS nation, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 's' || (n_nationkey * 4 + 1) END AS name FROM nation),
    s AS (SELECT s_suppkey, s_nationkey AS nation, 's' || s_suppkey AS name FROM supplier),
    m AS (SELECT rule, count(s_suppkey) AS n, min(s_suppkey) AS first FROM r LEFT JOIN s ON s.nation = r.nation AND (r.name IS NULL OR r.name = s.name) GROUP BY rule)
    SELECT rule, n, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN n = 1 THEN first END AS match FROM m
""")
def q_optional_match(spark, sf_dir):
    """Rules on suppliers whose name matches anything when null."""
    key = F.col("n_nationkey")
    name = F.when(key % 3 != 0, F.concat(F.lit("s"), (key * 4 + 1).cast("string")))
    rules = _t(spark, sf_dir, "nation").select(key.alias("rule"), key.alias("nation"), name.alias("name"))
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"))
    return relational.optional_match(rules, rows, "rule", "s_suppkey", ["nation"], ["name"])


@query("""
    SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_orderstatus = 'O' THEN 'open' END AS class,
      CASE WHEN o_totalprice > 400000 THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END AS rule_no
    FROM orders WHERE o_totalprice > 400000 OR o_orderpriority = '1-URGENT' OR o_orderstatus = 'O'
""")
def q_prioritized(spark, sf_dir):
    """The first rule that classifies an order wins."""
    orders = _t(spark, sf_dir, "orders")
    rule = lambda when, name: orders.where(when).select("o_orderkey", F.lit(name).alias("class"))
    return relational.prioritised([rule("o_totalprice > 400000", "large"), rule("o_orderpriority = '1-URGENT'", "urgent"), rule("o_orderstatus = 'O'", "open")], ["o_orderkey"], "class")


@query("""
    WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
    SELECT user_id, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL
    SELECT user_id, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT user_id, 'common' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
""")
def q_setdiff(spark, sf_dir):
    """Users who only click, only buy, or do both."""
    events = _t(spark, sf_dir, "events")
    of = lambda kind: events.where(F.col("event_type") == kind).select("user_id")
    return relational.differences(of("click"), of("purchase"), ["user_id"])


@query("""
    SELECT doc_id, CAST(count(l_doc) - 1 AS BIGINT) AS surplus FROM (SELECT d.doc_id, l.doc_id AS l_doc FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY doc_id HAVING count(l_doc) <> 1
""")
def q_coverage_violations(spark, sf_dir):
    """Documents that are not labelled exactly once."""
    found = relational.coverage_violations(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("doc_id", (-F.col("surplus")).alias("surplus"))


# C: intervals

_ISLANDS = """
    WITH e AS (SELECT {0} AS k, {1} AS s, {2} AS t FROM {3}),
    f AS (SELECT *, CASE WHEN s < max(t) OVER (PARTITION BY k ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM e),
    g AS (SELECT *, sum(o) OVER (PARTITION BY k ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS island FROM f),
    m AS (SELECT k, island, min(s) AS s, max(t) AS t, count(*) AS n FROM g GROUP BY ALL)
"""


@query(_ISLANDS.format("user_id", "CAST(epoch(date_trunc('second', ts)) AS BIGINT)", "CAST(epoch(date_trunc('second', ts)) AS BIGINT) + 3600", "events") + 'SELECT k AS user_id, CAST(island AS BIGINT) AS island, s AS "start", t AS "end", n FROM m')
def q_islands(spark, sf_dir):
    """Hours of activity of each user, merged where they overlap."""
    at = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    hours = _t(spark, sf_dir, "events").select("user_id", at.alias("s"), (at + 3600).alias("t"))
    return intervals.islands(hours, ["user_id"], "s", "t")


@query(_ISLANDS.format("conv_id", "turn * 40", "turn * 40 + length(text)", "conversations") + "SELECT k AS conv_id, CAST(sum(ceil((t - s) / 4)) AS BIGINT) AS tokens, count(*) AS n_islands FROM m GROUP BY k")
def q_span_credit(spark, sf_dir):
    """Tokens of the turns of a conversation, laid out with overlaps that count once."""
    turns = _t(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 40).alias("s"), (F.col("turn") * 40 + F.length("text")).alias("t"))
    return intervals.credited(intervals.islands(turns, ["conv_id"], "s", "t"), ["conv_id"])


# D: graphs


def _places(spark, sf_dir) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nations = _t(spark, sf_dir, "nation").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
    return nations.union(_t(spark, sf_dir, "supplier").select(key("n", "s_nationkey").alias("src"), key("s", "s_suppkey").alias("dst")))


_PLACES = "e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"


@query(f"""
    WITH RECURSIVE {_PLACES}, c AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT c.src, e.dst, c.depth + 1 FROM c JOIN e ON c.dst = e.src)
    SELECT src, dst, min(depth) AS depth FROM c GROUP BY src, dst
""")
def q_closure(spark, sf_dir):
    """Regions, nations and suppliers: who lies in whom."""
    return graph.closure(_places(spark, sf_dir))


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity = 50 AND l_discount >= 0.09),
    c AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT c.src, e.dst, c.depth + 1 FROM c JOIN e ON c.dst = e.src WHERE c.depth < (SELECT count(*) FROM nation))
    SELECT src, dst, min(depth) AS depth FROM c GROUP BY src, dst
""")
def q_closure_cyclic(spark, sf_dir):
    """Which nations' suppliers reach which nations' customers, over any number of large orders: a graph with cycles."""
    large = _t(spark, sf_dir, "lineitem").where("l_quantity = 50 and l_discount >= 0.09").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    buyers = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(_t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src")), "c_custkey")
    sellers = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    return graph.closure(large.join(buyers, "o_orderkey").join(sellers, "s_suppkey").select("src", "dst"))


@query(f"""
    WITH {_PLACES}, n AS (SELECT 's' || s_suppkey AS id, s_acctbal / 1000 AS s FROM supplier UNION ALL SELECT 'n' || n_nationkey, 0.0 FROM nation UNION ALL SELECT 'r' || r_regionkey, 1.0 FROM region),
    a AS (SELECT id, s + coalesce((SELECT 0.3 * sum(m.s) FROM e JOIN n m ON m.id = e.dst WHERE e.src = n.id), 0) AS s FROM n),
    b AS (SELECT id, s + coalesce((SELECT 0.3 * sum(m.s) FROM e JOIN a m ON m.id = e.dst WHERE e.src = a.id), 0) AS s FROM a)
    SELECT id, round(s, 6) AS score FROM b
""")
def q_propagate2(spark, sf_dir):
    """Two synchronous rounds of pushing 0.3 of a score to the parent."""
    sup = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), (F.col("s_acctbal") / 1000).alias("score"))
    nat = _t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.lit(0.0))
    reg = _t(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.lit(1.0))
    up = _places(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = graph.propagate(sup.union(nat).union(reg), up, 0.3)
    return found.select("id", F.round("score", 6).alias("score"))


@query("SELECT l_orderkey AS orderkey, round(1 - product(1 - l_discount), 6) AS support FROM lineitem GROUP BY l_orderkey")
def q_noisy_or(spark, sf_dir):
    """The discounts of an order as independent evidence."""
    found = graph.noisy_or(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_discount"), ["orderkey"], "l_discount", "support")
    return found.select("orderkey", F.round("support", 6).alias("support"))


@query("""
    WITH u AS (SELECT 's' || s_suppkey AS unit_id, least(1.0, greatest(0.0, s_acctbal / 10000)) AS p_edit, 0.1 AS p_support FROM supplier
      UNION ALL SELECT 'p' || p_partkey, p_size / 100.0, p_retailprice / 4000 FROM part),
    e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_quantity > 45),
    t AS (SELECT src, avg(greatest(t.p_edit, t.p_support)) AS m, count(*) AS n FROM e JOIN u s ON s.unit_id = src AND s.p_edit >= 0.05 JOIN u t ON t.unit_id = dst AND greatest(t.p_edit, t.p_support) >= 0.15 GROUP BY src)
    SELECT unit_id, round(CAST(least(1.0, p_edit + 0.12 * coalesce(m, 0)) AS DOUBLE), 6) AS p_edit FROM u LEFT JOIN t ON src = unit_id AND n >= 2
""")
def q_orchestration(spark, sf_dir):
    """Suppliers that coordinate several relevant parts gain by their mean relevance."""
    sup = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("unit_id"), X.clamp(F.col("s_acctbal") / 10000).alias("p_edit"), F.lit(0.1).alias("p_support"))
    part = _t(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.col("p_size") / 100.0, F.col("p_retailprice") / 4000)
    edges = _t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    found = graph.orchestrated(sup.union(part), edges)
    return found.select("unit_id", F.round("p_edit", 6).alias("p_edit"))


@query("SELECT l_orderkey AS orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS suppliers FROM lineitem GROUP BY l_orderkey")
def q_adjacency(spark, sf_dir):
    """The suppliers of each order, sorted."""
    edges = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_suppkey").cast("string").alias("s"))
    return graph.adjacency(edges, "orderkey", "s", "suppliers").select("orderkey", F.array_join("suppliers", ",").alias("suppliers"))


# E: rollups


@query("""
    SELECT o_orderpriority AS provider, count(*) AS n_runs, round(avg((o_totalprice <= 300000)::INT), 6) AS compliance_rate, round(avg(o_totalprice), 4) AS avg_price,
      round(avg(CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END), 4) AS avg_closed FROM orders GROUP BY ALL
""")
def q_provider_rollup(spark, sf_dir):
    """Runs, rate of compliance and means that skip nulls."""
    ledger = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("provider"), (F.col("o_totalprice") <= 300000).alias("ok"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("closed"))
    found = rollups.provider_rollup(ledger, "provider", "ok", ["price", "closed"])
    return found.select("provider", "n_runs", F.round("compliance_rate", 6).alias("compliance_rate"), F.round("avg_price", 4).alias("avg_price"), F.round("avg_closed", 4).alias("avg_closed"))


@query("""
    WITH s AS (SELECT c_mktsegment AS segment, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderpriority AS provider, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
    SELECT * FROM s QUALIFY rank() OVER (PARTITION BY segment, y ORDER BY n DESC) = 1
""")
def q_winners(spark, sf_dir):
    """The most common priorities of each segment and year, ties kept."""
    people = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    counts = _t(spark, sf_dir, "orders").join(people, "o_custkey").groupBy("segment", F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("provider")).agg(F.count("*").alias("n"))
    return rollups.winners(counts, ["segment", "y"], "n")


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n, concat_ws('+', CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' END, CASE WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' END) AS level
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))
""")
def q_grouping_sets(spark, sf_dir):
    """Counts by flag, by status and by both, in one pass."""
    return rollups.grouped_counts(_t(spark, sf_dir, "lineitem"), [["l_returnflag"], ["l_linestatus"], ["l_returnflag", "l_linestatus"]], ["l_returnflag", "l_linestatus"])


@query("""
    WITH m AS (SELECT unnest(map_entries(CAST(props::JSON AS MAP(VARCHAR, JSON)))) AS e FROM events)
    SELECT e.key AS key, e.value->>'$' AS value, count(*) AS n FROM m GROUP BY ALL
""")
def q_payload_outcomes(spark, sf_dir):
    """How often each property has each value."""
    return rollups.map_outcomes(_t(spark, sf_dir, "events"), F.from_json("props", "map<string,string>"))


@query("""
    WITH c AS (SELECT doc_id, CAST(quality AS DOUBLE) AS edit, CASE WHEN toxic = 1 THEN NULL ELSE least(1.0, n_chars / 5000) END AS sup, CASE WHEN quality IS NULL THEN 0.5 END AS hon FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, round((coalesce(0.35 * edit, 0) + coalesce(0.25 * sup, 0) + coalesce(0.15 * hon, 0)) / nullif(CASE WHEN edit IS NULL THEN 0 ELSE 0.35 END + CASE WHEN sup IS NULL THEN 0 ELSE 0.25 END + CASE WHEN hon IS NULL THEN 0 ELSE 0.15 END, 0)::DOUBLE, 6) AS score FROM c
""")
def q_weighted_null_drop(spark, sf_dir):
    """A weighted mean of the components that are not null."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    parts = docs.select("doc_id", F.col("quality").cast("double").alias("edit"), F.when(F.coalesce("toxic", F.lit(0)) != 1, F.least(F.lit(1.0), F.col("n_chars") / 5000)).alias("sup"), F.when(F.col("quality").isNull(), 0.5).alias("hon"))
    return parts.select("doc_id", F.round(rollups.weighted({"edit": 0.35, "sup": 0.25, "hon": 0.15}), 6).alias("score"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'no_such') AS n_no_such FROM events GROUP BY user_id")
def q_pivot_counts(spark, sf_dir):
    """Dense counts of event types by user, zero for a type that never occurs."""
    return rollups.dense_pivot(_t(spark, sf_dir, "events"), "user_id", "event_type", ["click", "purchase", "no_such"])


# F: packing and assembly


@query(f"""
    WITH RECURSIVE r AS (SELECT lang, doc_id, (length(text) + 3) // 4 AS w, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS rn FROM documents),
    p AS (SELECT lang, 0::BIGINT AS rn, 0::BIGINT AS used, NULL::BIGINT AS taken FROM (SELECT DISTINCT lang FROM documents)
      UNION ALL SELECT p.lang, r.rn, CASE WHEN p.used + r.w <= {BUDGET} THEN p.used + r.w ELSE p.used END, CASE WHEN p.used + r.w <= {BUDGET} THEN r.doc_id END FROM p JOIN r ON r.lang = p.lang AND r.rn = p.rn + 1)
    SELECT lang, taken AS doc_id, used AS running FROM p WHERE taken IS NOT NULL
""")
def q_greedy_pack(spark, sf_dir):
    """Longest documents first, each taken if it still fits its language's token budget."""
    docs = _t(spark, sf_dir, "documents").select("lang", "doc_id", F.floor((F.length("text") + 3) / 4).alias("w"), F.length("text").alias("n"))
    return folds.greedy_fit(docs, ["lang"], [-F.col("n"), F.col("doc_id")], "doc_id", "w", BUDGET)


@query("""
    SELECT doc_id, CASE WHEN n_chars <= 2000 THEN 'source' WHEN n_chars // 4 <= 900 THEN 'summary' WHEN 12 <= 900 THEN 'identity' END AS detail,
      CASE WHEN n_chars <= 2000 THEN n_chars WHEN n_chars // 4 <= 900 THEN n_chars // 4 ELSE 12 END AS cost FROM documents
""")
def q_detail_choice(spark, sf_dir):
    """The richest detail that is affordable."""
    n = F.col("n_chars")
    choices = F.array(*[F.struct(F.lit(d).alias("detail"), c.cast("long").alias("cost"), F.lit(most).alias("most")) for d, c, most in (("source", n, 2000), ("summary", F.floor(n / 4), 900), ("identity", F.lit(12), 900))])
    picked = F.filter(choices, lambda x: x["cost"] <= x["most"])[0]
    return _t(spark, sf_dir, "documents").select("doc_id", picked["detail"].alias("detail"), picked["cost"].alias("cost"))


@query("""
    WITH f AS (SELECT source, lang, string_agg(doc_id || ':' || n_chars, chr(10) ORDER BY n_chars, doc_id) AS part FROM documents GROUP BY ALL)
    SELECT source, md5('# Context' || chr(10) || string_agg('## ' || lang || chr(10) || part, chr(10) || chr(10) ORDER BY lang)) AS document_md5 FROM f GROUP BY source
""")
def q_document(spark, sf_dir):
    """A document per source: its languages in order, each with its units in order."""
    docs = _t(spark, sf_dir, "documents").select("source", "lang", "n_chars", "doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n_chars").cast("string")).alias("content"))
    found = folds.assemble(docs, ["source"], "lang", ["n_chars", "doc_id"], "content")
    return found.select("source", F.md5("document").alias("document_md5"))


@query("""
    WITH p AS (SELECT user_id, event_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 1800 THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM p
""")
def q_running_ordinal(spark, sf_dir):
    """A running ordinal: the number of each user's session of half an hour's gaps."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp").cast("double")
    opened = F.when(at - F.lag(at).over(order) <= 1800, 0).otherwise(1)
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", opened.alias("o"))
    return rows.select("user_id", "event_id", F.sum("o").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("session"))
