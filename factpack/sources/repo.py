"""Source repositories as fact tables: a scan of Python files, and one wide row for each syntax fact.

A file is parsed in the worker that reads it, so parsing needs no shuffle and scales with files. What
only the syntax tree can tell is decided here: spans, scopes, the shape of expressions, and the chain of
scopes that a name is looked up in. A file that cannot be parsed keeps its ``file`` and ``definition``
rows and gets a ``diagnostic``, no other fact; a file that is not UTF-8 is treated the same way.

Columns of offsets count characters, and lines break at ``\\r\\n``, ``\\r`` and ``\\n`` alone, as the
parser's do; so snippets are exact after non-ASCII text and form feeds.
"""

from __future__ import annotations

import ast
import itertools
import keyword
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = (
    "repo_id string, path string, fact string, seq int, id string, owner string, "
    "sl int, sc int, el int, ec int, snippet string, name string, kind string, text string, value string, "
    "note string, module string, imported string, alias string, n int, flag boolean, "
    "root string, attrs array<string>, vroot string, vattrs array<string>, chain array<string>"
)
_COLUMNS = [x.split()[0] for x in FACTS.split(", ")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in FACTS.split(", ")])
_FUNCTIONS = ("function", "async_function", "method")


def scan(spark: SparkSession, root: str, repo_id: str = "repo") -> DataFrame:
    """(repo_id, path, content) of every ``*.py`` under root, through Spark's own reader."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(root)
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = store.makeQualified(top).toUri().getPath().rstrip("/")
    inner = F.regexp_replace("path", "^[a-z]+:(//[^/]*)?/*", "/")
    held = files.select(F.substring(inner, F.lit(len(base) + 2), F.length(inner)).alias("path"), "content")
    # Spark's readers leave empty files out, but an empty module is a module: their names come from the listing
    listing, empty = store.listFiles(top, True), []
    while listing.hasNext():
        status = listing.next()
        if status.getLen() == 0 and status.getPath().getName().endswith(".py"):
            empty.append((status.getPath().toUri().getPath()[len(base) + 1 :], bytearray()))
    whole = held.unionByName(spark.createDataFrame(empty, "path string, content binary")) if empty else held
    return whole.select(F.lit(repo_id).alias("repo_id"), "path", "content")


def scan_file(spark: SparkSession, root: str, path: str, repo_id: str = "repo") -> DataFrame:
    """(repo_id, path, content) of the one file ``path`` (relative to root); an empty file has empty content."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root, path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    if size == 0:
        return from_texts(spark, {repo_id: {path: ""}})
    files = spark.read.format("binaryFile").load(at.toString())
    return files.select(F.lit(repo_id).alias("repo_id"), F.lit(path).alias("path"), "content")


def from_texts(spark: SparkSession, repos: dict[str, dict[str, str]]) -> DataFrame:
    rows = [(r, p, bytearray(t.encode())) for r, files in repos.items() for p, t in files.items()]
    return spark.createDataFrame(rows, "repo_id string, path string, content binary")


def content_hashes(files: DataFrame) -> DataFrame:
    return files.select("repo_id", "path", F.sha2("content", 256).alias("sha256"))


def module_name(path: str) -> str:
    parts = path.split("/")
    if parts[-1] == "__init__.py":
        return ".".join(parts[:-1]) or "__init__"
    return ".".join([*parts[:-1], parts[-1].rsplit(".", 1)[0]])


def shape(text: str | None) -> tuple[str, list[str]] | None:
    """(root, attributes) of a name or of a dotted chain of one or two attributes, else None."""
    parts = (text or "").split(".")
    if len(parts) > 3 or not all(x.isidentifier() and not keyword.iskeyword(x) for x in parts):
        return None
    return parts[0], parts[1:]


class _File:
    """Lines of a file, and spans of nodes in characters."""

    def __init__(self, text: str):
        self.lines = [x for x in re.split(r"(?<=\n)|(?<=\r)(?!\n)", text) if x]
        self.raw = [None if x.isascii() else x.encode() for x in self.lines]

    def column(self, line: int, offset: int) -> int:
        raw = self.raw[line - 1] if line <= len(self.raw) else None
        return offset if raw is None else len(raw[:offset].decode(errors="replace"))

    def span(self, node: ast.AST) -> tuple[int, int, int, int]:
        return node.lineno, self.column(node.lineno, node.col_offset), node.end_lineno, self.column(node.end_lineno, node.end_col_offset)

    def whole(self) -> tuple[int, int, int, int]:
        return (1, 0, len(self.lines), len(self.lines[-1])) if self.lines else (1, 0, 1, 0)

    def slice(self, sl: int, sc: int, el: int, ec: int) -> str | None:
        if not self.lines or el > len(self.lines):
            return None
        rows = self.lines[sl - 1 : el]
        rows[-1] = rows[-1][:ec]
        rows[0] = rows[0][sc:]
        return "".join(rows) or None


class _Reader:
    """Walks one module and keeps its facts."""

    def __init__(self, repo_id: str, path: str, text: str):
        self.repo_id, self.path, self.file, self.rows = repo_id, path, _File(text), []
        self.ids: dict[str, int] = {}

    def add(self, fact: str, id_: str, span: tuple[int, int, int, int], **more) -> None:
        row = dict.fromkeys(_COLUMNS) | {"repo_id": self.repo_id, "path": self.path, "fact": fact, "seq": len(self.rows), "id": id_}
        self.rows.append(row | dict(zip(("sl", "sc", "el", "ec"), span, strict=True)) | {"snippet": self.file.slice(*span)} | more)

    def id_of(self, prefix: str, node: ast.AST, *rest) -> str:
        span = self.file.span(node)
        return ":".join(map(str, (prefix, self.path, span[0], span[1], *rest)))

    def module(self, text: str) -> None:
        name = module_name(self.path)
        qualified = name or "__module__"
        id_ = f"def:{self.path}:{qualified}"
        self.add("file", f"file:{self.path}", self.file.whole(), module=name)
        self.add("definition", id_, self.file.whole(), name=qualified.rsplit(".", 1)[-1], kind="module", text=qualified, chain=[id_])
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
            self.broken(getattr(error, "lineno", None), getattr(error, "msg", None) or str(error))
            return
        kept = len(self.rows)
        try:
            for node in tree.body:
                self.walk(node, (id_, "module", qualified, [id_]))
        except RecursionError:
            del self.rows[kept:]
            self.broken(None, "too deeply nested")

    def broken(self, line: int | None, message: str) -> None:
        lines = self.file.lines
        span = (line, 0, line, len(lines[line - 1])) if isinstance(line, int) and 1 <= line <= len(lines) else self.file.whole()
        self.add("diagnostic", f"syntax:{self.path}:parse_error", span, kind="parse_error", text=message)

    def walk(self, node: ast.AST, scope: tuple) -> None:
        """Facts of a node, then of its children; scope is (id, kind, qualified name, lookup chain)."""
        kind = type(node).__name__
        handler = getattr(self, f"on_{kind}", None)
        if handler is None or not handler(node, scope):
            for child in ast.iter_child_nodes(node):
                self.walk(child, scope)

    def define(self, node, scope: tuple, kind: str) -> tuple:
        qualified = f"{scope[2]}.{node.name}"
        base = f"def:{self.path}:{qualified}"
        self.ids[base] = again = self.ids.get(base, 0) + 1
        id_ = base if again == 1 else f"{base}#{again}"
        sl, sc, el, ec = self.file.span(node)
        starts = [self.file.span(x)[:2] for x in node.decorator_list]
        sl, sc = min(starts, default=(sl, sc))
        # a function in a class does not see the class's names
        outer = scope[3][1:] if kind in _FUNCTIONS and scope[1] == "class" else scope[3]
        chain = [id_, *outer]
        self.add("definition", id_, (sl, sc, el, ec), owner=scope[0], name=node.name, kind=kind, text=qualified, chain=chain)
        for i, x in enumerate(node.decorator_list, 1):
            self.expression("decorator", x, id_, i)
        return id_, kind, qualified, chain

    def expression(self, fact: str, node: ast.expr, owner: str, index: int) -> None:
        said = ast.unparse(node)
        root, attrs = shape(said) or (None, None)
        self.add(fact, self.id_of(fact, node, owner, index), self.file.span(node), owner=owner, text=said, n=index, root=root, attrs=attrs)

    def on_ClassDef(self, node: ast.ClassDef, scope: tuple) -> bool:
        inner = self.define(node, scope, "class")
        for i, x in enumerate(node.bases, 1):
            self.expression("base", x, inner[0], i)
        metaclasses = [x for x in node.keywords if x.arg == "metaclass"]
        for i, x in enumerate(metaclasses, 1):
            span = self.file.span(x)
            self.add("metaclass", self.id_of("metaclass", x, inner[0], i), span, owner=inner[0], text=self.file.slice(*span))
        for x in (*node.decorator_list, *node.bases, *(k.value for k in node.keywords)):
            self.walk(x, scope)
        for x in node.body:
            self.walk(x, inner)
        return True

    def on_FunctionDef(self, node, scope: tuple) -> bool:
        kind = "method" if scope[1] == "class" else "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function"
        inner = self.define(node, scope, kind)
        self.parameters(node.args, inner[0])
        for x in (*node.decorator_list, *node.args.defaults, *filter(None, node.args.kw_defaults)):
            self.walk(x, scope)
        for x in node.body:
            self.walk(x, inner)
        return True

    on_AsyncFunctionDef = on_FunctionDef

    def parameters(self, args: ast.arguments, owner: str) -> None:
        plain = [*((x, "positional_only") for x in args.posonlyargs), *((x, "positional_or_keyword") for x in args.args)]
        defaults = [*[None] * (len(plain) - len(args.defaults)), *args.defaults]
        every = [(x, k, d) for (x, k), d in zip(plain, defaults, strict=True)]
        every += [(x, "vararg", None) for x in (args.vararg,) if x]
        every += [(x, "keyword_only", d) for x, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
        every += [(x, "kwargs", None) for x in (args.kwarg,) if x]
        for i, (x, kind, default) in enumerate(every):
            line, column, *_ = self.file.span(x)
            said = lambda e: None if e is None else ast.unparse(e)
            self.add("parameter", f"parameter:{owner}:{i}:{kind}:{x.arg}", (line, column, line, column + len(x.arg)), owner=owner, name=x.arg, kind=kind, n=i, note=said(x.annotation), value=said(default), flag=default is not None)

    def imports(self, node, scope: tuple, module: str | None) -> None:
        for i, x in enumerate(node.names, 1):
            kind = "import" if module is None else "star_import" if x.name == "*" else "from_import"
            bound = None if kind == "star_import" else x.asname or (x.name.split(".")[0] if kind == "import" else x.name)
            self.add("import", self.id_of("import", node, i, x.name, x.asname or "_"), self.file.span(node), owner=scope[0], kind=kind, name=bound, module=x.name if module is None else module, imported=None if module is None else x.name, alias=x.asname, flag=bool(module and module.startswith(".")))

    def on_Import(self, node: ast.Import, scope: tuple) -> bool:
        self.imports(node, scope, None)
        return True

    def on_ImportFrom(self, node: ast.ImportFrom, scope: tuple) -> bool:
        self.imports(node, scope, "." * node.level + (node.module or ""))
        return True

    def assign(self, node, scope: tuple, targets: list[ast.expr], suffix: bool, note: ast.expr | None = None) -> None:
        value = None if node.value is None else ast.unparse(node.value)
        vroot, vattrs = shape(value) or (None, None)
        for i, x in enumerate(targets, 1):
            target = ast.unparse(x)
            name = target if target.isidentifier() and not keyword.iskeyword(target) else None
            self.add("assignment", self.id_of("assign", node, *[i] * suffix), self.file.span(node), owner=scope[0], name=name, text=target, value=value, note=None if note is None else ast.unparse(note), vroot=vroot, vattrs=vattrs)

    def on_Assign(self, node: ast.Assign, scope: tuple) -> None:
        self.assign(node, scope, node.targets, True)

    def on_AnnAssign(self, node: ast.AnnAssign, scope: tuple) -> None:
        self.assign(node, scope, [node.target], False, node.annotation)

    def on_AugAssign(self, node: ast.AugAssign, scope: tuple) -> None:
        self.assign(node, scope, [node.target], False)

    def on_Call(self, node: ast.Call, scope: tuple) -> None:
        callee = ast.unparse(node.func)
        root, attrs = shape(callee) or (None, None)
        # eval(source), exec(source): one plain argument and nothing else
        plain = isinstance(node.func, ast.Name) and len(node.args) == 1 and not node.keywords and isinstance(node.args[0], ast.Name)
        self.add("call", self.id_of("call", node), self.file.span(node), owner=scope[0], text=callee, n=len(node.args) + len(node.keywords), flag=plain and node.args[0].id == "source", root=root, attrs=attrs)

    def on_Attribute(self, node: ast.Attribute, scope: tuple) -> None:
        base = ast.unparse(node.value)
        root, attrs = shape(f"{base}.{node.attr}") or (None, None)
        kind = "store" if isinstance(node.ctx, ast.Store) else "attribute_access"
        self.add("attribute", self.id_of("attribute", node), self.file.span(node), owner=scope[0], name=node.attr, kind=kind, text=f"{base}.{node.attr}", value=base, root=root, attrs=attrs)


def read_file(repo_id: str, path: str, content: bytes) -> list[dict]:
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as error:
        reader = _Reader(repo_id, path, content.decode("utf-8", errors="replace"))
        reader.module("")
        reader.broken(None, f"not UTF-8: {error.reason}")
        return reader.rows
    reader = _Reader(repo_id, path, text)
    reader.module(text)
    return reader.rows


def facts(files: DataFrame) -> DataFrame:
    """(repo_id, path, content) -> the wide fact table, by a map over Arrow batches without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                rows = read_file(file["repo_id"], file["path"], bytes(file["content"] or b""))
                for some in itertools.batched(rows, 4096):
                    yield pa.RecordBatch.from_pylist(list(some), schema=_ARROW)

    return files.select("repo_id", "path", "content").mapInArrow(run, FACTS)
