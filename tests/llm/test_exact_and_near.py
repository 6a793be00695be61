"""Exact dedup and the n-gram Jaccard join against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa

from factpack.llm import _text as T
from factpack.llm import cuckoo_dedup as C
from factpack.llm import ngram_join as J
from factpack.llm._graph import components
from pyspark.sql import functions as F

from .conftest import SCHEMA, prose, rows

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute_groups(data):
    groups = {}
    for id_, text, *_ in data:
        groups.setdefault(SPACE.sub("", text or ""), []).append((-len(text or ""), C.NO_ID if id_ is None else id_))
    out = []
    for id_, text, *_ in data:
        norm = SPACE.sub("", text or "")
        keep = min(groups[norm])[1]
        keep = None if keep == C.NO_ID else keep
        out.append((id_, keep, len(groups[norm]), id_ == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def some_order(x):
    return sorted(x, key=repr)


def test_exact_dedup_is_brute_force(odd, odd_clash, none):
    want = some_order(brute_groups(rows(odd)))
    assert some_order(rows(C.dedup(odd).drop("n_chars"))) == want
    assert some_order(rows(C.dedup(odd_clash).drop("n_chars"))) == want
    assert rows(C.dedup(none)) == []


def test_filter_grows_and_deletes():
    bucket, keys = C.Bucket(), [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for k in keys:
        bucket.insert(k, 1, 5, 1)
    assert len(bucket.filter.slots) > C.START and all(k in bucket.filter for k in keys)
    again = C.Bucket({k: v[0] for k, v in bucket.row(3).items()})
    for k in keys[:4000]:
        again.put(k, 0, 0, 0)
    assert all(again.probe(k) is None for k in keys[:4000])
    assert all(again.probe(k) == [1, 5, 1] for k in keys[4000:])
    assert np.count_nonzero(again.filter.slots) == 1000


def test_index_inserts_and_deletes_tables(spark):
    docs = spark.createDataFrame([(i, f"text {i % 40}", "en", "a", 7) for i in range(200)], SCHEMA)
    digests = C.digests(docs)
    index = C.CuckooIndex.empty(spark, 200).insert(digests.where("doc_id < 100")).insert(digests.where("doc_id >= 100"))
    assert {(r.group_size, r.keep_id < 40) for r in index.content().collect()} == {(5, True)}
    index = index.delete(digests.where("doc_id % 40 < 10")).delete(digests.where("doc_id = 50"))
    assert sorted(r.group_size for r in index.content().collect()) == [4] + [5] * 29
    gone = index.probe(digests).where("group_size is null")
    assert gone.count() == 50


def test_deletion_finds_the_best_live_row(spark, monkeypatch):
    texts = [(1, "a  b"), (2, "ab"), (3, "a b"), (3, "a b"), (None, "a    b"), (9, "else")]
    digests = C.digests(spark.createDataFrame(texts, "doc_id long, text string"))
    index = C.CuckooIndex.empty(spark).insert(digests)
    kept = lambda x: sorted((r.group_size, r.keep_id) for r in x.content().collect())
    assert kept(index) == [(1, 9), (5, C.NO_ID)]
    index = index.delete(digests.where("doc_id is null"))
    assert kept(index) == [(1, 9), (4, 1)]
    index = index.delete(digests.where("doc_id = 1"))
    assert kept(index) == [(1, 9), (3, 3)]
    index = index.delete(digests.where("doc_id = 3").limit(1)).delete(digests.where("doc_id = 77"))
    assert kept(index) == [(1, 9), (2, 3)]
    index = index.delete(digests.where("doc_id in (3, 9)"))
    assert kept(index) == [(1, 2)]
    monkeypatch.setattr(C, "BUCKET_ROWS", 2)
    many = C.digests(spark.range(300).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
    more = index.insert(many)
    assert more.buckets > 16 and more.content().count() == 301 and more.delete(many).content().count() == 1


def brute_sets(data, n=5):
    sets = []
    for _, text, *_ in data:
        words = [w for w in SPACE.split("".join(c.lower() if c < "\x80" else c for c in text or "")) if w]
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set())
    return sets


def brute_components(data):
    sets, parent = brute_sets(data), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        x, y = data[i][0], data[j][0]
        if a and b and x is not None and y is not None and 100 * len(a & b) >= 80 * len(a | b):
            parent[max(find(x), find(y))] = min(find(x), find(y))
    return [(d[0], len(s), None if d[0] is None else find(d[0])) for d, s in zip(data, sets, strict=True)]


def near_corpus(n=260):
    draw, out = random.Random(5), []
    for i in range(n):
        if i % 3 == 0 or not out:
            words = prose(i, draw.choice([3, 5, 6, 8, 9, 12, 14, 17, 20, 30, 60, 140])).split()
        else:
            words = draw.choice(out)[1].split()
            for _ in range(draw.choice([0, 1, 1, 2, 3, 6])):
                at = draw.randrange(len(words) + 1)
                words[at : at + draw.choice([0, 1])] = draw.choice([[], ["new"], [f"w{i}"]])
        out.append((i, "  ".join(words), "en", "a", 1))
    return out


def test_ngram_join_is_brute_force(spark, odd, odd_clash, none):
    for data, df in ((near_corpus(), None), (rows(odd), odd), (rows(odd), odd_clash)):
        df = df if df is not None else spark.createDataFrame(data, SCHEMA)
        got = rows(J.join_ngrams(df).drop("n_links"))
        assert some_order(got) == some_order(brute_components(data))
    assert rows(J.join_ngrams(none)) == []


def test_every_linked_pair_shares_a_signature():
    draw, lows = np.random.default_rng(3), J.bands(80, 1 << 40)
    for size in [*range(1, 60), 97, 155, 400, 1001]:
        for _ in range(12):
            base = draw.integers(0, 1 << 64, size, dtype=np.uint64)
            # as far as a link can be: J is 80 % or just above, by a swap of shingles or by more of them
            swap = size // 9
            more = size // 4
            for other in (np.concatenate([base[swap:], draw.integers(0, 1 << 64, swap, dtype=np.uint64)]), np.concatenate([base, draw.integers(0, 1 << 64, more, dtype=np.uint64)])):
                a, b = np.unique(base), np.unique(other)
                both = len(np.intersect1d(a, b))
                assert 100 * both >= 80 * (len(a) + len(b) - both)
                assert np.intersect1d(J.signatures(a, 80, lows), J.signatures(b, 80, lows)).size
                assert J._hopeful(J.sketch(a), J.sketch(b), len(a), len(b), 80)


def test_words_and_hashes_follow_the_text():
    texts = ["Ab  cd\x0bef", None, "", " x ", "ab cd ef", "ef é", "zz"]
    words = T.Words(pa.array(texts), lower=True)
    said = [[bytes(words.data[a:b]).decode() for a, b in zip(words.start[i:j], words.end[i:j], strict=True)] for i, j in itertools.pairwise(words.bounds.tolist())]
    assert said == [["ab", "cd", "ef"], [], [], ["x"], ["ab", "cd", "ef"], ["ef é"], ["zz"]]
    by_word = {}
    for row, (i, j) in zip(said, itertools.pairwise(words.bounds.tolist()), strict=True):
        for w, h in zip(row, words.hash[i:j].tolist(), strict=True):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (200, 201), (202, 201)]
    found = dict(rows(components(spark.createDataFrame(links, "a long, b long"))))
    assert found == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 50)} | {201: 200, 202: 200}


def test_a_large_group_of_near_copies_is_one_component(spark):
    base = prose(9, 120).split()
    data = [(i, " ".join([*base[:60], f"n{i}", *base[60:]]), "en", "a", 1) for i in range(300)]
    got = rows(J.join_ngrams(spark.createDataFrame(data, SCHEMA)).drop("n_links"))
    assert {c for _, _, c in got} == {0}
