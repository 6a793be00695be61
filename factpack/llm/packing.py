"""Best-fit packing of tokenised documents by large-item matching.

Every document is tokenised (byte-level BPE from a vocabulary file) and closed with the id 2. Only
documents over the capacity are cut, into whole sequences, of which the first may be shorter. Packing
then depends on nothing but the lengths, of which there are ``capacity``: Spark counts the pieces of each
length, and the plan is made on that histogram, for any number of documents:

1. pieces over a third of the capacity, largest first, are matched with the largest of their kind
   that fits beside them; two such pieces at most go into a bin;
2. smaller pieces, largest first, go into the tightest gap that holds them; a bin is opened only
   where there is none.

The plan is a list of bin patterns with their numbers; a step uses up a length or a pattern, so the
list has a few entries for each length. A piece finds its bin by its rank among the pieces of its length; ranks
come from ``_common.ranked``, which never gathers a length in one task.

``pack_in_order`` keeps to an order of the documents as well: windows of ``WINDOW`` documents are planned one by
one, each a task's group (a document has one piece below the capacity at most), and sequences are numbered by the
first document in them. So the sequences before any point hold the documents before it, but for one window.

Results: a null text is empty: it has the id 2 alone. Rows that repeat an id are packed each for
itself. An empty table gives no pieces. A text of any length is tokenised whole, alone if it is long. Where
a text holds the string of one of the vocabulary's added tokens, that string is the token, as in the
tokenizer's plain call. Other columns of the table are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, null_text, pieces, ranked, table

CAPACITY, CLOSING = 1024, 2
#: Documents that are planned together where their order counts.
WINDOW = 1 << 14
#: A sequence's number in an order is the position of its first document and, in these bits, a piece.
PIECE_BITS = 24
#: Texts of these characters alone split alike under every release of Unicode's classes.
_PLAIN = re.compile("[\t\n\x20-\x7e¡-ɏ]*")
_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_encoders: dict[str, tuple] = {}


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoders(path: str):
    """The vocabulary's tokenizer, a faster one of equal results on plain characters, and the added tokens' strings."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        letters = _byte_letters()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in word): id_ for word, id_ in spec["model"]["vocab"].items() if word not in special}
        _encoders[path] = slow, tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sorted(special)
    return _encoders[path]


def encode(texts: list[str], path: str) -> list[list[int]]:
    """The ids of the texts; only plain texts without an added token take the faster way."""
    slow, fast, special = encoders(path)
    plain = lambda x: _PLAIN.fullmatch(x) and not any(token in x for token in special)
    return [fast.encode_ordinary(x) if plain(x) else slow.encode(x, add_special_tokens=False).ids for x in texts]


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    first = (length - 1) % capacity + 1
    return [(0, first), *[(start, capacity) for start in range(first, length, capacity)]]


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, and position where docs has it."""
    ordered = "position" in docs.columns

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for at, ids in enumerate(encode(part.column("text").to_pylist(), path)):
                    raw = np.array([*ids, CLOSING], "<u4").tobytes()
                    rows += [(at, i, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)])) for i, (start, n) in enumerate(cut(len(raw) // 4, capacity))]
                at, *columns = zip(*rows, strict=True)
                of = [part.column(c).take(pa.array(at)) for c in names]
                made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([of[0], *made, *of[1:]], names=[names[0], "piece", "start", "length", "ids_crc32", *names[1:]])

    names = ["doc_id", "position"] if ordered else ["doc_id"]
    docs = null_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *names[1:]))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", position long" if ordered else ""))


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(number of bins, lengths in a bin) for counts[length] pieces of each length."""
    left = [int(x) for x in counts]
    gaps: dict[int, list[tuple[int, list[int]]]] = {}

    def open_(n: int, lengths: list[int]) -> None:
        gaps.setdefault(capacity - sum(lengths), []).append((n, lengths))

    third = capacity // 3
    for size in range(capacity, third, -1):
        while left[size]:
            mate = next((m for m in range(min(size, capacity - size), third, -1) if left[m] > (m == size)), None)
            if mate is None:
                n, lengths = left[size], [size]
            elif mate == size:
                n, lengths = left[size] // 2, [size, size]
            else:
                n, lengths = min(left[size], left[mate]), [size, mate]
            for x in lengths:
                left[x] -= n
            open_(n, lengths)
    for size in range(min(third, capacity), 0, -1):
        while left[size]:
            gap = next((g for g in range(size, capacity) if gaps.get(g)), None)
            if gap is None:
                each = capacity // size
                n = left[size] // each
                if n:
                    open_(n, [size] * each)
                    left[size] -= n * each
                if left[size]:
                    open_(1, [size] * left[size])
                    left[size] = 0
                continue
            n, lengths = gaps[gap].pop()
            take = min(n, left[size])
            if take < n:
                gaps[gap].append((n - take, lengths))
            left[size] -= take
            open_(take, [*lengths, size])
    return [x for found in gaps.values() for x in found]


def places(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each length: the first rank, the first bin and the offset of each place for it."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    first = 0
    for n, lengths in patterns:
        offset = 0
        for size in lengths:
            out.setdefault(size, []).append((ranks.get(size, 0), first, offset))
            ranks[size] = ranks.get(size, 0) + n
            offset += size
        first += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def place(length: np.ndarray, rank: np.ndarray, where: dict[int, tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of pieces by their lengths and their ranks among the pieces of their length."""
    bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for size in np.unique(length).tolist():
        at = np.flatnonzero(length == size)
        ranks, first, offset = where[size]
        k = np.searchsorted(ranks, rank[at], side="right") - 1
        bins[at], offsets[at] = first[k] + rank[at] - ranks[k], offset[k]
    return bins, offsets


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut_ = table(tokenise(docs.select("doc_id", "text"), path or vocabulary(), capacity))
    # capacity rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut_.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    where = places(plan(counts, capacity))

    def run(batches):
        for batch in batches:
            sequence, offset = place(batch.column("length").to_numpy(), batch.column("rank").to_numpy(), where)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    placed = ranked(cut_, ["length"], ["doc_id", "piece", "start", "ids_crc32"], int(counts.max(initial=0)))
    return placed.mapInArrow(run, SCHEMA)


def pack_in_order(docs: DataFrame, last: int, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The columns of ``pack``; docs has ``position`` too, the places (long) from 0 to ``last`` of its rows, and
    sequences are numbered by their first document's."""
    windows, size = max(1, (last + 1) // WINDOW), WINDOW
    cut_ = table(tokenise(docs, path or vocabulary(), capacity))
    # whole sequences, of which a document can have any number, need no plan
    full = cut_.where(F.col("length") == capacity)
    own = F.shiftleft("position", PIECE_BITS).bitwiseOR(F.col("piece").cast("long"))
    full = full.select(*_PIECE, own.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut_.where(F.col("length") < capacity).withColumn("window", F.least((F.col("position") / size).cast("long"), F.lit(windows - 1)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        length, position = rows.column("length").to_numpy(), rows.column("position").to_numpy()
        order, rank = np.argsort(length, kind="stable"), np.zeros(len(length), np.int64)
        rank[order] = np.arange(len(length)) - np.searchsorted(length[order], length[order])
        bins, offsets = place(length, rank, places(plan(np.bincount(length, minlength=capacity + 1), capacity)))
        # the rows are in order, so the first one of a bin is its first document
        _, first, of = np.unique(bins, return_index=True, return_inverse=True)
        return rows.select(_PIECE).append_column("sequence_id", pa.array(position[first][of] << PIECE_BITS)).append_column("offset", pa.array(offsets))

    return full.unionByName(rest.groupBy("window").applyInArrow(run, SCHEMA))


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
