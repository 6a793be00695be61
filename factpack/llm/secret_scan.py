"""Secret scan: three plain patterns, and a randomness test battery under false-discovery control.

Base spans come from the patterns ``assign``, ``access`` and ``hex`` below. Beside them, every run of
20 or more token characters is a candidate:

1. Its *encoding* is inferred: the smallest alphabet of ``ALPHABETS`` that holds its characters.
2. The *battery* takes three statistics: chi-squared over the alphabet, which is a number of equal pairs; the runs
   of characters of a kind (lower, upper, digit, sign; of the alphabet's halves where it has one kind); and the
   lag-1 serial correlation. Each is tested against uniform draws from that alphabet (with exact means and
   variances, as expected counts are small). A candidate that any test rejects at ``LEVEL / 3`` is structured, and goes.
3. The same statistics are tested against *writing*: letters at prose frequencies that seldom change their kind.
   Writing has more equal pairs, longer runs and more correlation, so each test is one-sided, and Fisher's rule
   combines the three p-values into one. It shrinks with length, as the statistics sharpen.
4. *False-discovery control*: within each band of lengths, over the candidates of all documents, the
   Benjamini-Hochberg step-up rule at ``Q`` on these p-values, rounded up to a tenth of a decade. The driver
   sees only the histogram: (bands) x (tenths of decades) numbers.

What survives and touches no base span is added as kind ``random``. Nulls count as empty texts; a text
without spans has the SHA-256 of the empty string and empty spans; rows with equal ids each get a row. Very
long texts are read whole. An empty table gives no rows. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._common import documents, null_text, pieces, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: A text without any of these in lower case has no assign span.
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "any": _UPPER + _LOWER + _DIGITS + "+/-_",
}
LEVEL, Q = 0.003, 0.01
#: Candidates compete within a band of lengths: 20 to 31, 32 to 63, 64 to 127, 128 and more.
LENGTHS = (32, 64, 128)
STEPS = 400

#: Percent of each letter a to z in English prose.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: In writing, a character changes its predecessor's kind so often, and the correlation that this gives.
CHANGES, CORRELATION = 0.1, 0.5
_KIND = {c: k for k, letters in enumerate((_LOWER, _UPPER, _DIGITS, "+/-_")) for c in letters}
#: Chances that two, and three, letters of prose are the same.
_SAME2, _SAME3 = (sum((x / sum(LETTERS)) ** k for x in LETTERS) for k in (2, 3))


def encoding(token: str) -> str:
    return next(name for name, letters in ALPHABETS.items() if set(token) <= set(letters))


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _pairs(n: int, same2: float, same3: float) -> tuple[float, float]:
    """Mean and standard deviation of the number of equal pairs among n letters."""
    variance = n * (n - 1) / 2 * (same2 - same2**2) + n * (n - 1) * (n - 2) * (same3 - same2**2)
    return n * (n - 1) / 2 * same2, math.sqrt(max(variance, 1e-9))


def _at_least(r: int, n: int, p: float) -> float:
    """P(X >= r) of a binomial of n draws."""
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(r, n + 1)) if n <= 1000 else _tail((r - 0.5 - n * p) / math.sqrt(n * p * (1 - p)))


def statistics(token: str, letters: str) -> tuple[int, int, float, list[int]]:
    """Equal pairs, changes of kind, serial correlation, and the kinds of the alphabet's letters."""
    x = np.array([letters.index(c) for c in token])
    counts = np.bincount(x)
    kinds = [_KIND[c] for c in letters]
    if len(set(kinds)) == 1:
        kinds = [int(2 * i >= len(letters)) for i in range(len(letters))]
    kind = np.array(kinds)[x]
    centred = x - x.mean()
    spread = float((centred**2).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / spread if spread else 1.0
    return int((counts * (counts - 1)).sum()) // 2, int((kind[1:] != kind[:-1]).sum()), serial, kinds


def battery(token: str, letters: str) -> tuple[float, float, float]:
    """p-values of chi-squared uniformity, runs and serial correlation, against uniform draws."""
    k, n = len(letters), len(token)
    pairs, changes, serial, kinds = statistics(token, letters)
    mean, deviation = _pairs(n, 1 / k, 1 / k**2)
    stay = sum((kinds.count(i) / k) ** 2 for i in set(kinds))
    stay3 = sum((kinds.count(i) / k) ** 3 for i in set(kinds))
    # changes at two neighbouring places are not independent where kinds differ in size
    variance = (n - 1) * stay * (1 - stay) + 2 * (n - 2) * (stay3 - stay**2)
    runs = 2 * _tail(abs(changes - (n - 1) * (1 - stay)) / math.sqrt(variance))
    return _tail((pairs - mean) / deviation), min(1.0, runs), min(1.0, 2 * _tail(abs(serial + 1 / n) * math.sqrt(n)))


def against_writing(token: str, letters: str) -> float:
    """log10 of Fisher's combined p-value of the battery's statistics, were the token written."""
    n = len(token)
    pairs, changes, serial, kinds = statistics(token, letters)
    mean, deviation = _pairs(n, _SAME2, _SAME3)
    several = len({_KIND[c] for c in letters}) > 1
    p = [_tail((mean - pairs) / deviation), _at_least(changes, n - 1, CHANGES) if several else 1.0, _tail(((CORRELATION if several else 0.0) - serial) * math.sqrt(n))]
    x = -sum(math.log(max(v, 1e-300)) for v in p)
    return (math.log(1 + x + x * x / 2) - x) / math.log(10)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    found = []
    low = text.lower()
    if any(x in low for x in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, length band, tenths of decades of p) of what the battery does not reject."""
    found = []
    for m in CANDIDATE.finditer(text):
        if any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        letters = ALPHABETS[encoding(m[0])]
        passed = min(battery(m[0], letters)) >= LEVEL / 3
        step = min(STEPS, int(-10 * against_writing(m[0], letters))) if passed else 0
        found.append((m.start(), m.end(), sum(len(m[0]) >= x for x in LENGTHS), step))
    return found


def _digest(spans) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("band", pa.int32()), ("step", pa.int32())])
_TOKEN = np.zeros(256, bool)
_TOKEN[np.frombuffer((_LOWER + _UPPER + _DIGITS + "+/-_").encode(), np.uint8)] = True


def _has_long_run(texts: pa.Array, least: int = 20) -> np.ndarray:
    """Of each row, whether it has a run of ``least`` token characters (20: as hex needs more)."""
    data, offsets = T.buffer(texts)
    rows = np.zeros(len(offsets) - 1, bool)
    token = _TOKEN[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], token.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    long = starts[ends - starts >= least]
    rows[np.searchsorted(offsets, long, side="right") - 1] = True
    # a run may go on from one row into the next
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    for at in inner[token[inner] & token[inner - 1]].tolist() if len(inner) else ():
        rows[np.searchsorted(offsets, at, side="right") - 1] = True
    return rows


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans), found (candidates) and base_sha256 of every row."""

    def run(batches):
        nothing = _digest([])
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column("text")
                long = _has_long_run(texts)
                bases, founds, digests = [], [], []
                for i, text in enumerate(texts.to_pylist()):
                    low = text.lower()
                    if not (long[i] or any(x in low for x in HINTS) or "AKIA" in text):
                        bases.append([])
                        founds.append([])
                        digests.append(nothing)
                        continue
                    base = base_spans(text)
                    bases.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in base])
                    founds.append([dict(zip(("start", "end", "band", "step"), x, strict=True)) for x in candidates(text, base)] if long[i] else [])
                    digests.append(_digest(base))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bases, pa.list_(_SPAN)), pa.array(founds, pa.list_(_FOUND)), pa.array(digests)], names=["doc_id", "base", "found", "base_sha256"])

    docs = null_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return docs.mapInArrow(run, "doc_id long, base array<struct<start long, kind int, end long>>, found array<struct<start long, end long, band int, step int>>, base_sha256 string")


def thresholds(scanned: DataFrame, q: float = Q) -> list[int]:
    """Of each band of lengths, the least step that is a discovery (STEPS + 1: none is)."""
    counts = np.zeros((len(LENGTHS) + 1, STEPS + 1), np.int64)
    for row in scanned.select(F.explode("found").alias("x")).groupBy("x.band", "x.step").count().collect():
        counts[row["band"], row["step"]] = row["count"]
    least = []
    for one in counts:
        beyond = one[::-1].cumsum()[::-1]
        ok = [t for t in range(1, STEPS + 1) if beyond[t] and one.sum() * 10 ** (-t / 10) <= q * beyond[t]]
        least.append(min(ok, default=STEPS + 1))
    return least


def find_secrets(docs: DataFrame, q: float = Q) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of every row."""
    scanned = table(scan(docs))
    least = F.array(*[F.lit(x) for x in thresholds(scanned, q)])
    kept = F.filter("found", lambda x: x["step"] >= F.element_at(least, x["band"] + 1))
    kept = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    names = F.array(*[F.lit(x) for x in KINDS])
    spans = F.transform(F.array_sort(F.concat("base", kept)), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"]))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256", F.array_join(spans, ",").alias("spans"), F.size(kept).cast("long").alias("n_random"))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))
