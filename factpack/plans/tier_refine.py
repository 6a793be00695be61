"""Refinement of five-tier packs: ground reported misses to symbols, say why they were missed, compile again.

Misses are few and name things in one repository, so names meet symbols by equi-joins; only what
has to match inside a name or at the end of a path is compared within the repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from . import tiers

#: The least tier that shows enough of a kind, and the floors of a second pass.
SUFFICIENT = {"function": "slice", "class": "slice", "method": "slice", "constant": "summary"}
MISSED_EDIT, NEAR_SUPPORT = 1.0, 0.8
#: What is said of a missed symbol, and where nothing is missed.
INSUFFICIENT, PRESSED = "Symbol '%s' was included but at an insufficient tier.", "Symbol '%s' was omitted due to budget pressure."
ABSENT_FILE, LOW_SCORE = "File '%s' was not represented in the pack.", "Symbol '%s' was not scored highly enough for inclusion."
NOTHING = "No matching symbols found in the graph."
FILE, FUNCTION, PYTHON = r"File\s+'([^']+)'", r"(?U),\s+in\s+(\w+)", r"(?U)[\w./\\]+\.py"
_KEYS = ["miss_id", "query_id", "repo_id"]
_AT = [*_KEYS, "node_id"]


def _rank(column):
    return F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(tiers.TIERS) for x in (t, i)]), column)


def sufficient(kind, tier):
    """Whether a symbol of a kind is shown well enough at a tier (null: left out)."""
    least = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFICIENT.items() for x in kv]), kind)
    rank = F.coalesce(_rank(tier), F.lit(0))
    return (rank > 0) & (rank >= _rank(F.coalesce(least, F.lit("summary"))))


def _absent(misses: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols by id, else by name, else by dotted path, else by a part of their name."""
    asked = misses.where("kind = 'absent_symbol'").select(*_KEYS, F.trim("evidence").alias("said"))
    dotted = F.replace(F.regexp_replace("said", r"\.[^.]*$", ""), F.lit("."), F.lit("/"))
    last = asked.where("instr(said, '.') > 0").select(*_KEYS, F.concat(dotted, F.lit(".py")).alias("file"), F.substring_index("said", ".", -1).alias("name"))
    by_id = asked.join(symbols.withColumn("said", F.col("node_id")), ["repo_id", "said"])
    by_name = asked.join(symbols.withColumn("said", F.col("name")), ["repo_id", "said"])
    by_path = last.join(symbols, ["repo_id", "name"]).where(F.endswith("path", "file"))
    inside = asked.join(symbols, "repo_id").where(F.contains("name", "said"))
    found = [rows.select(*_AT, F.lit(i).alias("way")) for i, rows in enumerate((by_id, by_name, by_path, inside))]
    every = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    first = every.groupBy(*_KEYS).agg(F.min("way").alias("way"))
    return every.join(first, [*_KEYS, "way"], "left_semi").select(*_AT)


def ground(misses: DataFrame, nodes: DataFrame) -> DataFrame:
    """misses (miss_id, query_id, repo_id, kind, evidence) -> the packable symbols (keys, node_id) they are about."""
    symbols = nodes.where(F.col("kind").isin(*tiers.PACKED_KINDS)).select("repo_id", "node_id", "name", "path")
    files = symbols.select("repo_id", "path").distinct()
    in_files = lambda rows: rows.join(symbols, ["repo_id", "path"]).select(*_AT)
    traces = misses.where("kind = 'out_of_pack_trace'")
    said = F.concat(F.regexp_extract_all("evidence", F.lit(FILE), F.lit(1)), F.regexp_extract_all("evidence", F.lit(PYTHON), F.lit(0)))
    named = traces.select(*_KEYS, F.explode(F.array_distinct(said)).alias("said"))
    traced = in_files(named.join(files, "repo_id").where(F.endswith("path", "said") | F.endswith("said", "path")).select(*_KEYS, "path").distinct())
    called = traces.select(*_KEYS, F.explode(F.regexp_extract_all("evidence", F.lit(FUNCTION), F.lit(1))).alias("name")).join(symbols, ["repo_id", "name"]).select(*_AT)
    edits = misses.where("kind = 'edit_to_omitted'").select(*_KEYS, F.trim("evidence").alias("said"))
    edited = in_files(edits.join(files, "repo_id").where(F.endswith("path", "said")).select(*_KEYS, "path").distinct())
    return _absent(misses, symbols).union(traced).union(called).union(edited).distinct()


def missed(misses: DataFrame, nodes: DataFrame, packed: DataFrame) -> DataFrame:
    """(keys, node_id, said): the grounded symbols that the pack doesn't show well enough, with the reason."""
    symbols = nodes.select("repo_id", "node_id", F.col("name").alias("label"), "kind", "path", "seq")
    held = packed.select("query_id", "repo_id", "node_id", "tier", "token_cost")
    kinds = misses.select(*_KEYS, F.col("kind").alias("miss_kind"))
    rows = ground(misses, nodes).join(symbols, ["repo_id", "node_id"]).join(held, ["query_id", "repo_id", "node_id"], "left").join(kinds, _KEYS)
    tell = lambda text, c: F.format_string(text, F.col(c))
    said = (
        F.when(F.col("token_cost") > 0, tell(INSUFFICIENT, "label")).when(F.col("token_cost") == 0, tell(PRESSED, "label"))
        .when(F.col("miss_kind") == "edit_to_omitted", tell(ABSENT_FILE, "path")).otherwise(tell(LOW_SCORE, "label"))
    )
    return rows.where(~sufficient(F.col("kind"), F.col("tier"))).select(*_AT, "path", "seq", said.alias("said"))


def expansions(found: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(keys, node_id, missed): the missed symbols, and the packable ones that they call or import."""
    packable = nodes.where(F.col("kind").isin(*tiers.PACKED_KINDS)).select("repo_id", "node_id")
    steps = edges.where("kind in ('calls', 'imports')").select("repo_id", F.col("src").alias("node_id"), "dst")
    near = found.select(*_AT).join(steps, ["repo_id", "node_id"]).select(*_KEYS, F.col("dst").alias("node_id"))
    near = near.join(packable, ["repo_id", "node_id"], "left_semi").select(*_AT, F.lit(False).alias("missed"))
    return found.select(*_AT, F.lit(True).alias("missed")).unionByName(near).groupBy(*_AT).agg(F.max("missed").alias("missed"))


def diagnose(misses: DataFrame, nodes: DataFrame, edges: DataFrame, packed: DataFrame) -> DataFrame:
    """One row a miss: (keys, missed_units, reason, recommended_expansions), the lists in order of files and lines."""
    found = missed(misses, nodes, packed)
    places = nodes.select("repo_id", "node_id", "path", "seq")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("path", "seq", F.col(c).alias("x")))), lambda r: r["x"])
    lost = found.groupBy(*_KEYS).agg(ordered("node_id").alias("missed_units"), F.array_join(ordered("said"), " ").alias("reason"))
    wide = expansions(found, nodes, edges).join(places, ["repo_id", "node_id"]).groupBy(*_KEYS).agg(ordered("node_id").alias("recommended_expansions"))
    none = F.array().cast("array<string>")
    rows = misses.select(*_KEYS).join(lost, _KEYS, "left").join(wide, _KEYS, "left")
    return rows.select(*_KEYS, F.coalesce("missed_units", none).alias("missed_units"), F.coalesce("reason", F.lit(NOTHING)).alias("reason"), F.coalesce("recommended_expansions", none).alias("recommended_expansions"))


def boosted(scores: DataFrame, wide: DataFrame) -> DataFrame:
    """scores with the floors of a second pass: missed symbols to edit, their neighbours to support."""
    most = wide.groupBy("query_id", "repo_id", "node_id").agg(F.max("missed").alias("missed"))
    rows = scores.join(most, ["query_id", "repo_id", "node_id"], "left")
    edit = F.when(F.col("missed"), F.greatest("p_edit", F.lit(MISSED_EDIT))).otherwise(F.col("p_edit"))
    support = F.when(~F.col("missed"), F.greatest("p_support", F.lit(NEAR_SUPPORT))).otherwise(F.col("p_support"))
    return rows.select("query_id", "repo_id", "node_id", edit.alias("p_edit"), support.alias("p_support"))


def recompile(files: DataFrame, queries: DataFrame, misses: DataFrame, packed: DataFrame, delta: int, similar: DataFrame | None = None, keep=cut) -> tuple[DataFrame, DataFrame]:
    """(packs at budget + delta with boosted scores, the symbols (query_id, repo_id, node_id) that are new in them).

    All misses of a query and repository act together; a symbol that one of them missed counts as missed.
    """
    nodes, edges = tiers.graph(files, keep)
    wide = keep(expansions(missed(misses, nodes, packed), nodes, edges))
    scores = keep(boosted(tiers.score(nodes, edges, queries, similar), wide))
    wider = queries.withColumn("budget", F.col("budget") + delta)
    again = keep(tiers.pack(keep(tiers.renders(nodes, edges)), edges, scores, wider))
    shown = lambda rows: rows.where("tier is not null and tier != 'omit'").select("query_id", "repo_id", "node_id")
    return again, shown(again).join(shown(packed), ["query_id", "repo_id", "node_id"], "left_anti")
