"""Whole-file packing: files in order, each taken if the assembled document still fits.

The document's head tells how many files were taken and left, so its length changes as files are
taken; the fold needs the document so far. One grouped map for each run, over its candidates alone.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PACKED = "run_id string, files array<string>, omitted_files array<string>, warnings array<string>, total_tokens int, document string, fits boolean"


def numbered(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def tokens(length: int) -> int:
    return max(1, (length + 3) // 4)


def head(provider: str, task_id: str, query: str, budget: int, taken: int, left: int, n_warnings: int) -> str:
    lines = ["# Baseline Context", f"baseline: {provider}", f"task_id: {task_id}", f"query: {query or '<empty>'}", f"budget: {budget}", f"selected_files: {taken}", f"omitted_candidate_files: {left}"]
    return "\n".join(lines + [f"warnings: {n_warnings}"] * bool(n_warnings))


def take(files: list[tuple[str, str]], budget: int, top) -> list[int]:
    """The places of the files taken; ``top(taken, left)`` is the document's head.

    At the end files go again, last first, while the head that has grown makes the document too long.
    """
    size = [len(p) + len(t) + 6 for p, t in files]
    taken: list[int] = []
    for i in range(len(files)):
        body = sum(size[k] for k in taken) + size[i]
        if tokens(len(top(len(taken) + 1, len(files) - len(taken) - 1)) + body) <= budget:
            taken.append(i)
    while taken and tokens(len(top(len(taken), len(files) - len(taken))) + sum(size[k] for k in taken)) > budget:
        taken.pop()
    return taken


def pack_files(rows: DataFrame) -> DataFrame:
    """rows (run_id, task_id, query, provider, budget, rank, path, text, warnings) -> one document each run."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        first = part.iloc[0]
        notes = [] if first["warnings"] is None or isinstance(first["warnings"], float) else list(first["warnings"])
        files = [(r.path, r.text) for r in part.itertuples() if isinstance(r.path, str)]
        top = lambda taken, left: head(first["provider"], first["task_id"], first["query"], first["budget"], taken, left, len(notes))
        taken = take(files, int(first["budget"]), top)
        said = "".join([top(len(taken), len(files) - len(taken)), *(f"\n\n## {files[i][0]}\n{files[i][1]}" for i in taken)])
        return pd.DataFrame([(first["run_id"], [files[i][0] for i in taken], [p for i, (p, _) in enumerate(files) if i not in taken], notes, tokens(len(said)), said, tokens(len(said)) <= first["budget"])], columns=[x.split()[0] for x in PACKED.split(", ")])

    return rows.select("run_id", "task_id", "query", "provider", "budget", "rank", "path", "text", "warnings").groupBy("run_id").applyInPandas(run, PACKED)
