"""Outlines of source files for the five-tier packs: symbols by line, their texts, and plain call names.

A file is outlined in the worker that reads it. Symbols are the file itself, top-level functions, classes
with their methods and nested classes, constants (``UPPER_SNAKE``) and imports. A file that does not
parse has its file row alone.
"""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize

import pyarrow as pa
from pyspark.sql import DataFrame

_ROW = (
    "repo_id string, path string, seq int, node_id string, name string, kind string, start int, end int, parent string, source string, "
    "signature string, doc string, words array<string>, bound array<string>, modules array<string>, names array<string>, calls array<string>"
)
_LISTS = ("words", "bound", "modules", "names", "calls")
_CONSTANT = re.compile(r"^[A-Z][A-Z0-9_]*$")


def _words(source: str) -> list[str]:
    """The names in the executable text: no strings, no comments, no keywords."""
    found = set()
    try:
        for token in tokenize.generate_tokens(io.StringIO(source).readline):
            if token.type == tokenize.NAME and not keyword.iskeyword(token.string):
                found.add(token.string)
    except (IndentationError, tokenize.TokenError, SyntaxError):
        pass
    return sorted(found)


def _calls(node: ast.AST) -> list[str]:
    """Names called in a body: plain ones, and those on self or cls with their receiver."""
    found = []
    for x in (y for statement in node.body for y in ast.walk(statement)):
        if isinstance(x, ast.Call):
            if isinstance(x.func, ast.Name):
                found.append(x.func.id)
            elif isinstance(x.func, ast.Attribute) and isinstance(x.func.value, ast.Name) and x.func.value.id in ("self", "cls"):
                found.append(f"{x.func.value.id}.{x.func.attr}")
    return list(dict.fromkeys(found))


def outline(repo_id: str, path: str, content: bytes) -> list[dict]:
    text = content.decode("utf-8", errors="replace")
    lines = text.splitlines(keepends=True)
    rows: list[dict] = []

    def add(node_id, name, kind, start, end, parent, source, **more):
        row = {"repo_id": repo_id, "path": path, "seq": len(rows), "node_id": node_id, "name": name, "kind": kind, "start": start, "end": end, "parent": parent, "source": source, "signature": None, "doc": None} | dict.fromkeys(_LISTS, [])
        rows.append(row | more)

    top = f"file:{path}"
    add(top, path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "file", 1, max(1, len(lines)), None, text)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return rows

    used: dict[str, int] = {}

    def define(node, parent, scope):
        is_class = isinstance(node, ast.ClassDef)
        method = parent != top and not is_class
        name = f"{scope}.{node.name}" if scope else node.name
        node_id = f"{path}::{name}"
        if is_class or method:
            used[node_id] = n = used.get(node_id, 0) + 1
            node_id += f"#{n}" * (n > 1)
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        source = "".join(lines[start - 1 : node.end_lineno])
        # the head is the text before the first statement of the body
        first = node.body[0]
        line, column = first.lineno, len(lines[first.lineno - 1].encode()[: first.col_offset].decode(errors="replace"))
        if above := getattr(first, "decorator_list", []):
            line, column = above[0].lineno, 0
        head = "".join([*lines[node.lineno - 1 : line - 1], lines[line - 1][:column]])
        head = re.sub(r"(?m)#[^\n]*$", "", head).rstrip().removesuffix(":")
        said = ast.get_docstring(node, clean=False)
        doc = (said or "").strip().splitlines()
        add(node_id, node.name, "class" if is_class else "method" if method else "function", start, node.end_lineno, parent, source, signature=" ".join(head.split()), doc=doc[0].strip() if doc else None, words=_words(source), calls=[] if is_class else _calls(node))
        if is_class:
            for child in node.body:
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    define(child, node_id, name)

    for node in tree.body:
        source = "".join(lines[node.lineno - 1 : node.end_lineno])
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            define(node, top, "")
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            many = isinstance(node, ast.Import)
            module = node.names[0].name if many else "." * node.level + (node.module or "")
            bound = [x.asname or (x.name.split(".")[0] if many else x.name) for x in node.names]
            add(f"{path}::import:{node.lineno}", module, "import", node.lineno, node.end_lineno, top, source, bound=bound, modules=[x.name for x in node.names] if many else [], names=[] if many else [x.name for x in node.names])
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            target = node.targets[0] if isinstance(node, ast.Assign) else node.target
            if isinstance(target, ast.Name) and _CONSTANT.match(target.id):
                add(f"{path}::{target.id}", target.id, "constant", node.lineno, node.end_lineno, top, source)
    # a later top-level symbol of the same id takes the place of an earlier one
    last = {r["node_id"]: r for r in rows}
    return [r for r in rows if last[r["node_id"]] is r]


def outlines(files: DataFrame) -> DataFrame:
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _ROW.split(", ")])

    def run(batches):
        for batch in batches:
            for file in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(outline(file["repo_id"], file["path"], bytes(file["content"] or b"")), schema=schema)

    return files.select("repo_id", "path", "content").mapInArrow(run, _ROW)
