"""Text as Column -> Column functions: terms, phrases, overlaps, scores and token estimates.

All of it is built-in expressions. Terms are arrays of strings in the order of first sight.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where tokens split, and what parts a token has.
SPLIT = "[^A-Za-z0-9]+"
PARTS = r"[A-Z]+(?=[A-Z][a-z]|\b)|[A-Z]?[a-z]+|[0-9]+"
#: Words of an instruction that say nothing about its subject.
GLUE = (
    "a", "an", "and", "by", "change", "fix", "for", "from", "in", "keep", "keeping", "modify", "of",
    "on", "or", "the", "to", "update", "while", "with", "without",
)
#: Weights of lexical relevance.
PRIMARY_PHRASE, SEARCHABLE_PHRASE = 0.45, 0.15
PRIMARY_OVERLAP, SEARCHABLE_OVERLAP, PATH_OVERLAP = 0.25, 0.10, 0.05
BODY_OVERLAP, BODY_BIGRAM = 0.55, 0.15
#: Weights of a file's lexical score, and the count at which a term saturates.
CONTENT_HITS, PATH_HITS, OCCURRENCE, SATURATION = 0.75, 0.20, 0.05, 3


def tokens(text: Column) -> Column:
    """The bag of lower-case tokens: each alphanumeric run, then its camel-case parts and numbers."""
    runs = F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda x: x != "")
    each = F.transform(runs, lambda x: F.concat(F.array(x), F.regexp_extract_all(x, F.lit(PARTS), F.lit(0))))
    return F.transform(F.flatten(each), F.lower)


def terms(text: Column) -> Column:
    """The distinct tokens in the order of first sight."""
    return F.array_distinct(tokens(text))


def normalised(text: Column) -> Column:
    return F.array_join(terms(text), " ")


def focus(query_terms: Column) -> Column:
    """Query terms without glue, or all of them if nothing else is left."""
    left = F.array_except(query_terms, F.array(*[F.lit(x) for x in GLUE]))
    return F.when(F.size(left) > 0, left).otherwise(query_terms)


def phrase(query: Column, text: Column) -> Column:
    """1 for equal normalised texts, 0.85 where the text contains the query, else 0."""
    return F.when((F.length(query) == 0) | (F.length(text) == 0), 0.0).when(query == text, 1.0).when(F.contains(text, query), 0.85).otherwise(0.0)


def overlap(wanted: Column, held: Column) -> Column:
    """The share of the distinct wanted terms that are held; 0 without any."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, held)) / F.size(wanted)).otherwise(0.0)


def ngrams(words: Column, n: int = 2) -> Column:
    """The distinct n-grams of an array, each joined by a blank.

    Shifted copies are zipped: the array is evaluated n times, not once for each of its places.
    """
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, F.lit(1), count)
    for i in range(2, n + 1):
        out = F.zip_with(out, F.slice(words, F.lit(i), count), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(out)


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the code points, rounded up; 1 at least."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def estimate_tokens_low(text: Column) -> Column:
    """The older estimate: a quarter of the code points, rounded down; 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def relevance(query: Column, primary: Column, searchable: Column, path: Column, body: Column | None = None) -> Column:
    """Lexical relevance of a unit's texts to a query, in [0, 1]."""
    wanted = terms(query)
    surface = clamp(
        PRIMARY_PHRASE * phrase(normalised(query), normalised(primary))
        + SEARCHABLE_PHRASE * phrase(normalised(query), normalised(searchable))
        + PRIMARY_OVERLAP * overlap(wanted, terms(primary))
        + SEARCHABLE_OVERLAP * overlap(wanted, terms(searchable))
        + PATH_OVERLAP * overlap(wanted, terms(path))
    )
    if body is None:
        return surface
    inner = terms(body)
    with_body = clamp(surface + BODY_OVERLAP * overlap(focus(wanted), inner) + BODY_BIGRAM * overlap(ngrams(focus(wanted)), ngrams(inner)))
    return F.when(body.isNull() | (F.size(inner) == 0), surface).otherwise(with_body)


def file_score(wanted: Column, content: Column, path: Column) -> Column:
    """A file's lexical score from distinct query terms and the token bags of its content and path.

    One fold over the content keeps a saturating count for each term.
    """
    n = F.size(wanted)

    def count(state, token):
        return F.zip_with(wanted, state, lambda t, c: F.when(t == token, F.least(c + 1, F.lit(SATURATION))).otherwise(c))

    def score(counts):
        hits = F.aggregate(counts, F.lit(0), lambda s, c: s + c)
        found = F.size(F.filter(counts, lambda c: c > 0))
        return CONTENT_HITS * (found / n) + OCCURRENCE * F.least(F.lit(1.0), hits / (SATURATION * n))

    held = F.filter(content, lambda x: F.array_contains(wanted, x))
    whole = F.aggregate(held, F.transform(wanted, lambda _: F.lit(0)), count, score) + PATH_HITS * overlap(wanted, path)
    return F.when(n > 0, whole).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, over their common length in the product; 0 for a zero norm."""
    wide = lambda x: F.transform(x, lambda v: v.cast("double"))
    a, b = wide(a), wide(b)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v * v)))
    dot = total(F.transform(F.zip_with(a, b, lambda x, y: x * y), lambda v: F.coalesce(v, F.lit(0.0))))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def span(line: Column, column: Column, end_line: Column, end_column: Column) -> Column:
    return F.format_string("%d:%d-%d:%d", line, column, end_line, end_column)


def is_digest(text: Column) -> Column:
    return F.trim(text).rlike("^[0-9A-Fa-f]{64}$")


def canonical_json(fields: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def digest_id(prefix: str, kind: Column, subject: Column, detail: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\n", kind, subject, detail), 256), 1, 24))
