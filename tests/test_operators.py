"""Operators on small inputs, the catalogue against DuckDB, streams and the public surface."""

import itertools
import json
import math
import random

import duckdb
import pytest

import __spark_entry__ as entry
from factpack import api
from factpack.functions import text as X
from factpack.operators import folds, graph, intervals, relational, rollups
from factpack.plans import catalogue
from factpack.sources import samples
from factpack.streaming import ledger_stream
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.sql(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "tokens", "score"] and 0 < df.count() <= 8
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_as_of_takes_the_last_before(spark):
    draw = random.Random(1)
    left = [(i, draw.choice("ab"), draw.randrange(20)) for i in range(40)]
    right = [(i, draw.choice("abc"), draw.randrange(20)) for i in range(30)]
    asks = spark.createDataFrame(left, "id int, k string, t int")
    theirs = spark.createDataFrame(right, "rid int, k string, u int").withColumn("tie", F.col("rid"))
    for strict in (True, False):
        got = {r.id: r.rid for r in relational.as_of(asks, theirs, ["k"], "t", "u", ["rid"], "tie", strict).collect()}
        for i, k, t in left:
            before = [(u, rid) for rid, k2, u in right if k2 == k and (u < t or u == t and not strict)]
            assert got[i] == (max(before)[1] if before else None)


def test_prioritised_and_unique(spark):
    rules = [spark.createDataFrame(rows, "k int, v string") for rows in ([(1, None), (2, "a")], [(1, "b"), (2, "c"), (3, "d")])]
    assert sorted(map(tuple, relational.prioritised(rules, ["k"], "v").collect())) == [(1, "b", 1), (2, "a", 0), (3, "d", 1)]
    one = relational.unique_key(spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "k int, v int"), ["k"], v=F.col("v"))
    assert list(map(tuple, one.collect())) == [(2, 7)]


def test_touching_intervals_stay_apart(spark):
    rows = spark.createDataFrame([("a", 0, 4), ("a", 4, 8), ("a", 6, 10), ("a", 7, 8), ("b", 1, 2)], "k string, s int, t int")
    merged = intervals.islands(rows, ["k"], "s", "t")
    assert sorted((r.k, r.start, r.end, r.n) for r in merged.collect()) == [("a", 0, 4, 1), ("a", 4, 10, 3), ("b", 1, 2, 1)]
    assert {r.k: r.tokens for r in intervals.credited(merged, ["k"]).collect()} == {"a": 3, "b": 1}


def brute_closure(edges):
    follow, out = {}, {}
    for a, b in edges:
        follow.setdefault(a, set()).add(b)
    for start in follow:
        seen, front, depth = {}, {start}, 0
        while front:
            depth += 1
            front = {b for a in front for b in follow.get(a, ())} - set(seen)
            seen |= dict.fromkeys(front, depth)
        out |= {(start, b): d for b, d in seen.items()}
    return out


def test_closure_is_brute_force(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)]
    diamonds = [x for i in range(24) for x in ((f"d{i}", f"l{i}"), (f"d{i}", f"r{i}"), (f"l{i}", f"d{i + 1}"), (f"r{i}", f"d{i + 1}"))]
    chorded = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("a", "b"), ("z", "z"), (None, "a"), ("d", None)]
    edges = chain + diamonds + chorded
    got = {(r.src, r.dst): r.depth for r in graph.closure(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == brute_closure([x for x in edges if None not in x])
    assert graph.closure(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_phrases_of_any_length(spark):
    items = ["quick", "brown fo", "the quick brown fox jumped", "k b", "", "q", "lazy dogs; they all sleep late today", "none of this", "x😀y", None, "over the"]
    bodies = ["the quick brown fox jumped over", "lazy dogs; they all sleep late todays", "", "wx😀yz over the", None, "sleep"]
    df = spark.createDataFrame(list(enumerate(items)), "i int, p string")
    docs = spark.createDataFrame(list(enumerate(bodies)), "d int, b string")
    for some in (items, ["over the"], ["lazy dogs; they all sleep late today"], []):
        got = {(r.i, r.d) for r in folds.phrases(df.where(F.col("p").isin(some)) if some else df.limit(0), "i", "p", docs, "d", "b").collect()}
        assert got == {(i, d) for i, p in enumerate(items) for d, b in enumerate(bodies) if p in some and p is not None and b is not None and p in b}


def test_noisy_or_in_any_order(spark):
    draw = random.Random(3)
    values = [draw.random() for _ in range(30)]
    for some in (values, values[::-1], [*values, 1.0], [0.0]):
        df = spark.createDataFrame([("k", v) for v in some], "k string, v double")
        assert graph.noisy_or(df, ["k"], "v", "s").first().s == pytest.approx(1 - math.prod(1 - v for v in some), abs=1e-12)


def test_weighted_leaves_nulls_out(spark):
    df = spark.createDataFrame([(1.0, None), (0.5, 0.25), (None, None)], "a double, b double")
    got = [r.s for r in df.select(rollups.weighted({"a": 0.75, "b": 0.25}).alias("s")).collect()]
    assert got == [1.0, pytest.approx(0.4375), None]


def test_greedy_fit_is_brute_force(spark):
    df = spark.createDataFrame([("a", 1, 6), ("a", 2, 5), ("a", 3, 4), ("a", 4, 11), ("b", 5, 10)], "k string, i int, c int")
    got = folds.greedy_fit(df, ["k"], [F.col("i")], "i", "c", 10)
    assert sorted(map(tuple, got.collect())) == [("a", 1, 6), ("a", 3, 10), ("b", 5, 10)]
    draw = random.Random(2)
    rows = [(draw.choice(["a", "b", None]), i, draw.choice([0, 0, 1, 2, 3, 5, 8, 20, 21, 60]), draw.randrange(50)) for i in range(400)]
    got = folds.greedy_fit(spark.createDataFrame(rows, "k string, i int, c int, o int"), ["k"], [-F.col("o")], "i", "c", 40)
    want = []
    for k in ("a", "b", None):
        used = 0
        for _, i, c, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[3], r[1])):
            if used + c <= 40:
                used += c
                want.append((k, i, used))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)



def test_nearest_is_brute_force_without_a_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(folds, "PROBE_BLOCK", 5)
    monkeypatch.setattr(folds, "ROW_BLOCK", 70)
    draw = random.Random(2)
    data = [(i, [draw.gauss(0, 1) for _ in range(16)]) for i in range(300)]
    data += [(300 + i, [x + draw.gauss(0, 1e-4) for x in data[0][1]]) for i in range(30)] + [(400 + i, data[10][1]) for i in range(30)]
    data += [(500, None), (510, []), (520, [0.0] * 16), (530, [1.0] * 3), (540, [float("nan")] + [1.0] * 15), (550, [None] + [1.0] * 15), (560, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (10, data[10][1])]
    rows = spark.createDataFrame(data, "id long, v array<float>").repartition(3)
    probes = rows.where("id % 10 = 0").select(F.col("id").alias("p"), F.col("v").alias("e"))
    found = folds.nearest(rows, "id", "v", probes, "p", "e", 8)
    both = F.col("e").isNotNull() & F.col("v").isNotNull()  # as in SQL, a null vector has no score
    every = probes.crossJoin(rows).where("p != id").select("p", "id", F.when(both, F.round(X.cosine(F.col("e"), F.col("v")), 6)).alias("score"))
    want = folds.top_k(every, ["p"], [F.col("score").desc(), F.col("id")], 8).collect()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want)) and len(want) > 300
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_text_functions(spark):
    rows = spark.createDataFrame([("HTTPServer parse_v2 ABC1",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(X.tokens(F.col("t"))).collect()]
    assert got == [["httpserver", "http", "server", "parse", "parse", "v2", "v", "2", "abc1", "1"], [], []]
    grams = rows.limit(1).select(X.ngrams(F.split(F.lit("a b c a b"), " "), 2), X.ngrams(F.split(F.lit("a"), " "), 2)).first()
    assert list(grams) == [["a b", "b c", "c a"], []]


def test_path_suffixes(spark):
    got = spark.range(1).select(relational.path_suffixes(F.lit("./a\\b//c.py"))).first()[0]
    assert got == ["a/b/c.py", "b/c.py", "c.py"]


def test_ledger_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = lambda i, p, s: json.dumps({"run_id": f"r{i}", "task_id": "t", "provider_name": p, "budget": 1, "metrics": {"budget_compliant": True, "aggregate_score": s}})
    (folder / "a.json").write_text("\n".join([row(1, "x", 0.5), row(2, "y", 1.0), "{bad"]) + "\n")
    query = ledger_stream.rollup(ledger_stream.runs(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("rolled").start()
    try:
        query.processAllAvailable()
        (folder / "b.json").write_text(row(3, "x", 0.7) + "\n")
        query.processAllAvailable()
        assert {(r.provider_name, r.n_runs, round(r.avg_aggregate_score, 6)) for r in spark.sql("select * from rolled").collect()} == {("x", 2, 0.6), ("y", 1, 1.0)}
    finally:
        query.stop()


def test_public_surface(spark, tmp_path):
    for path, text in samples.SHOP.items():
        at = tmp_path / "src" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    answer = json.loads(api.tool_response(spark, json.dumps({"repo_root": str(tmp_path / "src"), "query": "change convert", "budget": 150})))
    assert answer["ok"] and answer["total_tokens"] <= 150 and "shop/money.py" in answer["document"]
    program = api.analyse_repository(spark, str(tmp_path / "src"))
    assert {r.path for r in program.facts.select("path").distinct().collect()} == set(samples.SHOP)
    assert [x["site"]["file_path"] for x in answer["syntax_diagnostics"]] == ["shop/broken.py"] and answer["unsupported_constructs"]
    assert sum(x["token_count"] for x in answer["selected_units"]) <= 150 and set(answer["unresolved_frontier"][0]["site"]["span"]) == {"start_line", "start_column", "end_line", "end_column"}
    assert api.mirror_violations(spark, json.dumps(answer), program).count() == 0
    lost = answer | {"unsupported_constructs": answer["unsupported_constructs"][1:]}
    assert [r.section for r in api.mirror_violations(spark, json.dumps(lost), program).collect()] == ["unsupported_constructs"]
    one = api.analyse_repository(spark, str(tmp_path / "src"), path="shop/money.py")
    assert [r.path for r in one.facts.select("path").distinct().collect()] == ["shop/money.py"]
    with pytest.raises(ValueError):
        api.analyse_repository(spark, str(tmp_path / "src"), telepathy_runtime_observations=[])


@pytest.mark.parametrize("asked, code", [
    ("{", "invalid_arguments"), ('{"repo_root": "r", "query": "q", "budget": 1, "x": 1}', "invalid_arguments"), ('{"query": "q", "budget": 1}', "invalid_repo_root"), ('{"repo_root": "r", "query": 1, "budget": 1}', "invalid_query"),
    ('{"repo_root": "r", "query": "q", "budget": true}', "invalid_budget"), ('{"repo_root": "r", "query": "q", "budget": 1, "include_document": 1}', "invalid_include_document"), ('{"repo_root": "/nowhere/at/all", "query": "q", "budget": 9}', "compile_failed"),
])
def test_wrong_calls(spark, asked, code):
    answer = json.loads(api.tool_response(spark, asked))
    assert not answer["ok"] and answer["error_code"] == code and answer["error"]


def test_bundle(spark, tmp_path):
    from factpack.sources import ledger

    line = json.dumps({"run_id": "r", "task_id": "t", "provider_name": "p", "budget": 5, "metrics": {"budget_compliant": True, "aggregate_score": 0.5, "edit_coverage": 1, "representation_adequacy": 1, "noise_efficiency": 0.1}})
    rows = spark.createDataFrame([(line,)], "line string").select(F.from_json("line", ledger.SCHEMA).alias("x")).select("x.*")
    paths = api.write_bundle(rows, str(tmp_path / "out"), "plan")
    said = "\n".join(r.value for r in spark.read.text(paths["report"]).collect())
    assert said.startswith("# Eval Summary") and "| p | 1 | 1.000 | 0.500" in said
    assert list(itertools.chain(json.loads("\n".join(r.value for r in spark.read.text(paths["manifest"]).collect()))["run_ids"])) == ["r"]
