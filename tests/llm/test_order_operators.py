"""Mixing, sharding, packing, line dedup and the pipeline."""

import itertools
import json
import math
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factpack.llm import _common, line_dedup, mixing, packing, sharding
from pyspark.sql import functions as F

from .conftest import SCHEMA, odd_rows, prose, rows

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402


def test_ranks_are_dense(spark, odd):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
    got = {}
    for r in _common.ranked(df, ["k"], ["id"], 9 * _common.RANK_ROWS).collect():
        got.setdefault(r.k, []).append(r["rank"])
    assert {k: sorted(v) for k, v in got.items()} == {0: list(range(334)), 1: list(range(333)), 2: list(range(333))}
    assert sorted(r["rank"] for r in _common.ranked(odd, ["lang"], ["doc_id"], 13).where("lang is null").collect()) == [0, 1]


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2}, {"heavy": 0.9} | {f"s{i:02d}": 0.005 for i in range(20)}, {"a": 0.6, "b": 0.3, "c": 0.05, "d": 0.05}, {"one": 2}])
def test_every_slot_is_within_a_block_of_the_given_weights(spark, weights):
    """Over many periods, of all sources together: done blocks against the weights themselves, slot by slot."""
    total, size, periods = sum(weights.values()), 64, 200
    last = spark.createDataFrame([(k, max(1, int(w / total * size * periods))) for k, w in weights.items()], "source string, blocks long")
    plan = mixing.slots(mixing.given_weights(spark, weights), last, size).select("source", "slot").collect()
    slots = sorted(r.slot for r in plan)
    assert slots == list(range(len(slots)))
    for name, w in weights.items():
        taken = np.zeros(len(slots) + 1)
        taken[[r.slot + 1 for r in plan if r.source == name]] = 1
        assert np.abs(np.cumsum(taken) - np.arange(len(slots) + 1) * w / total).max() < 1 + 1e-4


def test_columns_named_like_those_within(spark):
    names = ["slots", "_rank", "_size", "_slot", "_key", "_bucket", "rank", "of", "at", "row", "my col", "_n"]
    docs = spark.createDataFrame([(i, "t", "s", *([7] * len(names))) for i in range(40)], "doc_id long, text string, source string, " + ", ".join(f"`{x}` int" for x in names))
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "block", "release", "deadline", "slot", "place"] and mixed.count() == 40
    placed = sharding.shard(docs, "doc_id", ["a", "b"], 11)
    assert placed.columns == [*docs.columns, "slot", "shard"] and placed.count() == 40


def test_mixing_follows_the_true_weights_for_many_periods(spark):
    weights = {f"s{i}": 0.857 / 19 for i in range(19)} | {"hot": 1 / 7, "rare": 0.0001}
    total, blocks = sum(weights.values()), 1000
    docs = spark.range(blocks).select(F.lit("hot").alias("source"), F.col("id").alias("doc_id")).union(spark.range(300).select(F.lit("s3"), "id")).union(spark.range(1).select(F.lit("rare"), "id"))
    got = mixing.mix(docs, mixing.given_weights(spark, weights), block=1, period=128).collect()
    assert len({r.slot for r in got}) == len(got) == blocks + 301
    for source in ("hot", "s3", "rare"):
        w, at = weights[source] / total, sorted((r.block, r.slot) for r in got if r.source == source)
        for i, (block, slot) in enumerate(at):
            assert block == i + 1
            assert math.floor(i / w - 1e-3) <= slot < math.ceil((i + 1) / w + 1e-3)


def test_mixing_keeps_all_rows_in_their_windows(spark, odd, odd_clash, none):
    docs = spark.createDataFrame([(i, "", "en", "hot" if i % 2 else f"s{i % 6}", 0) for i in range(3000)], SCHEMA)
    got = mixing.mix(docs, block=8, period=64).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    assert all(r.release <= r.slot < r.deadline for r in got)
    blocks = {}
    for r in got:
        blocks.setdefault((r.source, r.block), set()).add((r.slot, r.place))
    assert all(len({s for s, _ in v}) == 1 and len(v) <= 8 for v in blocks.values())
    assert len({next(iter(v))[0] for v in blocks.values()}) == len(blocks)
    for frame in (odd, odd_clash):
        assert mixing.mix(frame).count() == len(odd_rows())
    assert rows(mixing.mix(none)) == []
    with pytest.raises(Exception, match="no target weight"):
        mixing.mix(docs, mixing.given_weights(spark, {"hot": 1})).collect()


def brute_table(offsets, skips, shards, slots):
    owner, at = [None] * slots, [0] * shards
    for turn in range(slots):
        i = turn % shards
        while owner[(offsets[i] + at[i] * skips[i]) % slots] is not None:
            at[i] += 1
        owner[(offsets[i] + at[i] * skips[i]) % slots] = i
    return owner


def test_lookup_table_is_brute_force(spark, odd, odd_clash, none):
    names = [f"n{i}" for i in range(7)]
    drawn = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit("offset"), F.lit(n)), F.lit(211)) for n in names], *[F.pmod(F.xxhash64(F.lit("skip"), F.lit(n)), F.lit(210)) + 1 for n in names]).first()
    got = {r.slot: r.shard for r in sharding.lookup_table(spark, names, 211).collect()}
    assert [got[i] for i in range(211)] == [names[k] for k in brute_table(drawn[:7], drawn[7:], 7, 211)]
    sizes = [list(got.values()).count(n) for n in names]
    assert max(sizes) - min(sizes) <= 1
    fewer = {r.slot: r.shard for r in sharding.lookup_table(spark, names[:-1], 211).collect()}
    moved = sum(got[i] != fewer[i] for i in range(211) if got[i] != names[-1])
    assert moved < 211 * 0.35
    placed = sharding.shard(odd, "doc_id", names, 211).collect()
    assert len(placed) == len(odd_rows()) and len({r.shard for r in placed if r.doc_id == 2}) == 1
    assert sharding.shard(odd_clash, "doc_id", names, 211).count() == len(odd_rows()) and rows(sharding.shard(none, "doc_id", names, 211)) == []
    for bad in (lambda: sharding.lookup_table(spark, names, 210), lambda: sharding.lookup_table(spark, ["a", "a"])):
        with pytest.raises(ValueError):
            bad()


def check_packing(data, got, capacity):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for id_, text, *_ in data:
        ids = [*slow.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)] if first < len(ids) or True else [0]
        for i, (a, b) in enumerate(itertools.pairwise(cuts)):
            want.append((id_, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        assert [a for a, _ in held] == [0, *itertools.accumulate(n for _, n in held)][:-1] and sum(n for _, n in held) <= capacity
    return len(sequences)


def test_added_tokens_are_tokens():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.encode(["a<|endoftext|>b", "plain"], path)[0][1] == 50256


def test_packing_round_trip(spark, odd, odd_clash, none):
    data = [(i, prose(i, 3 + i * 7 % 900), "en", "a", 1) for i in range(150)] + [(900, "<|endoftext|> \x85   中文 кириллица", "en", "a", 1)]
    used = check_packing(data, packing.pack(spark.createDataFrame(data, SCHEMA)).collect(), 1024)
    total = sum(r.length for r in packing.pack(spark.createDataFrame(data, SCHEMA)).collect())
    assert used <= math.ceil(total / 1024) * 1.05 + 1
    check_packing(odd_rows(), packing.pack(odd).collect(), 1024)
    check_packing(odd_rows(), packing.pack(odd_clash, capacity=64).collect(), 64)
    assert rows(packing.pack(none)) == []


def test_plan_packs_every_length():
    draw = np.random.default_rng(1)
    for capacity in (1, 2, 3, 10, 100, 1024):
        counts = np.concatenate([[0], draw.integers(0, 400, capacity)])
        patterns = packing.plan(counts, capacity)
        back = np.zeros_like(counts)
        for n, lengths in patterns:
            assert n > 0 and sum(lengths) <= capacity and sum(3 * x > capacity for x in lengths) <= 2
            np.add.at(back, lengths, n)
        assert (back == counts).all()
        assert sum(n for n, _ in patterns) <= 1.01 * math.ceil((counts * np.arange(capacity + 1)).sum() / capacity) + (counts[capacity // 2 + 1 :].sum()) + 1


def brute_line(text):
    line = re.sub(r"[\x20\x09-\x0D]+", " ", text.lower()).strip(" ")
    size = line_dedup.SHINGLE
    return line, {line[i : i + size] for i in range(len(line) - size + 1)} if len(line) >= size else {line}


def test_line_dedup_is_brute_force(spark, odd, odd_clash, none):
    import random

    draw, texts = random.Random(3), []
    for i in range(120):
        lines = []
        for j in range(draw.randrange(1, 5)):
            if texts and draw.random() < 0.5:
                words = draw.choice(draw.choice(texts).split("\n")).split()
                if words and draw.random() < 0.7:
                    words[draw.randrange(len(words))] = "other"
            else:
                words = prose(1000 * i + j, draw.choice([1, 4, 15, 25, 40, 80, 150])).split()
            lines.append(" ".join(words))
        texts.append("\n".join(lines))
    data = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    got = line_dedup.dedup_lines(spark.createDataFrame(data, SCHEMA)).collect()
    at = {(i, j): brute_line(x) for i, t in enumerate(texts) for j, x in enumerate(t.split("\n"))}
    parent = {k: k for k in at}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(k for k in at if at[k][0]), 2):
        x, y = at[a][1], at[b][1]
        if 100 * len(x & y) >= 80 * len(x | y):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {k: find(k) == k for k in at}
    wrong = [r for r in got if r.kept != want[r.doc_id, r.line_no]]
    assert len(got) == len(at) and len(wrong) <= 0.01 * len(at) and not [r for r in wrong if not r.kept]
    for frame in (odd, odd_clash):
        assert line_dedup.dedup_lines(frame).where("kept").count() > 0
    assert rows(line_dedup.dedup_lines(none)) == []


def test_bands_find_pairs_at_the_threshold(spark):
    assert 1 - (1 - (line_dedup.PERCENT / 100) ** line_dedup.ROWS) ** line_dedup.BANDS >= 0.996
    shared = spark.createDataFrame([(1, k) for k in (10, 20, 30, 40)], "band long, key long")
    assert set(rows(line_dedup._chains(shared))) == {(10, 20), (10, 30), (20, 30), (10, 40), (30, 40)}


def test_one_band_of_template_lines_is_brute_force(spark, monkeypatch):
    import random

    draw, plain = random.Random(4), []
    frame = "the order of customer %s was sent from the store in %s on %s and is now on its way"
    for i in range(300):
        plain.append((frame % tuple("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.choice([2, 5, 12]))) for _ in range(3))))
    plain += [draw.choice(plain[:300]) + draw.choice(["!", " x", " soon", ", again"]) for _ in range(60)]
    plain = sorted(set(plain))
    found = line_dedup.lines(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(plain)], SCHEMA))
    # all lines meet in one band; blocks are small, so that it takes several
    monkeypatch.setattr(line_dedup, "signatures", lambda f: f.select(F.lit(1).cast("long").alias("band"), "key"))
    monkeypatch.setattr(line_dedup, "BLOCK", 50)
    label = dict(rows(line_dedup.components(line_dedup.line_links(found))))
    keys = {r.line: r.key for r in found.collect()}
    sets, parent = {x: brute_line(x)[1] for x in plain}, {keys[x]: keys[x] for x in plain}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(plain, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(keys[a]), find(keys[b])
            parent[max(x, y)] = min(x, y)
    want = {k: find(k) for k in parent}
    assert 60 < len(set(want.values())) < len(plain)
    assert {k: label.get(k, k) for k in parent} == want


def test_long_and_repeated_lines_meet(spark):
    base = prose(77, 700)
    groups = [["-" * n for n in (50, 100, 200, 700)], ["=" * 2000, "=" * 2001], ["buy now " * 100, "buy now " * 101, "buy now " * 12], [base, base + " and so on"], ["x" * 7]]
    data = [(100 * g + i, line, "en", "a", 1) for g, lines in enumerate(groups) for i, line in enumerate(lines)]
    got = line_dedup.dedup_lines(spark.createDataFrame(data, SCHEMA)).collect()
    assert {r.doc_id for r in got if r.kept} == {100 * g for g in range(len(groups))}


def test_shingles_are_every_window_of_code_points(spark):
    line = "naïve \U0001f600\U0001f601 café of stone"
    got = spark.createDataFrame([(line,)], "line string").select(line_dedup.shingles(F.col("line"))).first()[0]
    want = spark.createDataFrame([(x,) for x in brute_line(line)[1]], "x string").select(F.xxhash64("x")).collect()
    assert sorted(got) == sorted(r[0] for r in want)


def test_pipeline_against_brute_force(spark, tmp_path):
    from .test_exact_and_near import brute_components, brute_groups
    from .test_text_operators import graded

    docs, labels = graded(240)
    docs += [(1000, docs[2][1], "en", "a", 1), (1001, docs[2][1] + " ", "en", "b", 1), (1002, docs[5][1] + " tail", "en", "b", 1), (1003, None, None, None, None), (1004, "", "en", "b", 0)]
    spark.createDataFrame([(*d, "x") for d in docs], SCHEMA + ", kept string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = corpus_pipeline.quality(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    data = [tuple(r) for r in kept.collect()]
    assert np.mean([d[0] % 3 == 2 for d in data if d[0] < 240]) > 0.95 and sum(d[0] % 3 == 2 for d in data if d[0] < 240) >= 78
    once = {x[0] for x in brute_groups(data) if x[3]}
    data = [d for d in data if d[0] in once]
    same = {i for i, _, c in brute_components(data) if i == c}
    data = [d for d in data if d[0] in same]
    assert 1000 not in same and 1002 not in same and 1001 in same
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing(data, got, 1024)


def test_mixing_stage_orders_the_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(i, 5), "en", "hot" if i % 2 else f"s{i % 6}", 0) for i in range(4000)], SCHEMA)
    corpus_pipeline.mix(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    order = [r.source for p in sorted(Path(f"{tmp_path}/mixed").glob("part-*")) for r in spark.read.parquet(str(p)).coalesce(1).collect()]
    assert len(order) == 4000
    weights = {r["source"]: r["weight"] for r in mixing.natural_weights(docs).collect()}
    plan = {k: w / sum(weights.values()) for k, w in weights.items()}
    for n in (500, 1000, 1500):
        for source, share in plan.items():
            assert abs(order[:n].count(source) - share * n) <= 2 * mixing.BLOCK
    assert json.dumps(sorted(plan)) == json.dumps(["hot", "s0", "s2", "s4"])


def test_packing_stage_follows_the_mixed_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 500)
    data = [(i, prose(i, 1500 if i % 400 == 0 else 5 + i % 7), "en", "hot" if i % 2 else f"s{i % 6}", 0) for i in range(2200)]
    docs = spark.createDataFrame(data, SCHEMA)
    corpus_pipeline.mix(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    order = [r.doc_id for p in sorted(Path(f"{tmp_path}/mixed").glob("part-*")) for r in spark.read.parquet(str(p)).coalesce(1).collect()]
    got = corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    assert check_packing(data, got, 1024) <= 1.02 * len({r.sequence_id for r in packing.pack(docs).collect()}) + 4
    # the sequences before a window's begin hold the documents before it, and no others
    for n in (500, 1000, 1500):
        assert {r.doc_id for r in got if r.sequence_id < n << packing.PIECE_BITS} == set(order[:n])
    at = {id_: i for i, id_ in enumerate(order)}
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append(at[r.doc_id])
    assert all(min(v) == k >> packing.PIECE_BITS for k, v in held.items())
    # rows that come from no file keep their order too
    assert check_packing(data, corpus_pipeline.pack(spark, docs, "").collect(), 1024) == len({r.sequence_id for r in corpus_pipeline.pack(spark, docs, "").collect()})


def test_packing_stage_without_rows(spark, none):
    assert corpus_pipeline.pack(spark, none, "").collect() == []
