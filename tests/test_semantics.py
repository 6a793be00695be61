"""Facts, bindings, references, dependencies and frontier on small repositories."""

import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factpack.operators.classes import ClassGraph
from factpack.plans import semantics
from factpack.sources import repo

REPOS = {
    "calls": {
        "pkg/__init__.py": "",
        "pkg/util.py": "import os\n\ndef helper(x):\n    return x\n\nclass Base:\n    def run(self):\n        return self.step()\n    def step(self):\n        return 1\n",
        "pkg/main.py": (
            "from pkg.util import helper, Base\nimport pkg.util as u\nimport pkg.util\nfrom . import util\nfrom nowhere import thing\nfrom pkg.util import *\n"
            "early()\n\ndef early():\n    return helper(1)\n\ndef late():\n    early()\n    u.helper(2)\n    pkg.util.helper(3)\n    util.helper(4)\n    thing()\n    missing()\n    obj.attr.deep.more()\n    getattr(u, 'x')\n    alias = u\n    alias.helper(5)\n\n"
            "class Child(Base):\n    size = 3\n    def go(self):\n        self.step()\n        self.size\n        self.nothing\n        self.run()\n"
        ),
        "broken.py": "def x(:\n",
    },
    "models": {
        "m.py": "from dataclasses import dataclass\nimport dataclasses\n\n@dataclass\nclass A:\n    x: int\n    y: str = 'é'\n    z = 1\n\n@dataclasses.dataclass\nclass B(A, metaclass=Meta):\n    w: int\n\n@dataclass\n@other\nclass C:\n    v: int\n",
        "hook.py": "def __getattr__(name):\n    return 1\n",
        "use.py": "import hook\nimport importlib\nhook.anything\nimportlib.import_module('x')\n\nclass H:\n    def __getattr__(self, n):\n        return n\n    def m(self):\n        self.q()\n",
    },
}


@pytest.fixture(scope="module")
def program(spark):
    found = semantics.analyse(repo.from_texts(spark, REPOS))
    return {k: [r.asDict() for r in v.collect()] for k, v in found.tables().items()}


def edges(program, repo_id):
    return {(r["src"].split(":", 1)[1], r["dst"].split(":", 1)[1], r["kind"]) for r in program["dependencies"] if r["repo_id"] == repo_id}


def test_references_and_dependencies(program):
    got = edges(program, "calls")
    want = {
        ("pkg/main.py:pkg.main.early", "pkg/util.py:pkg.util.helper", "call"),
        ("pkg/main.py:pkg.main.late", "pkg/main.py:pkg.main.early", "call"),
        ("pkg/main.py:pkg.main.late", "pkg/util.py:pkg.util.helper", "call"),
        ("pkg/main.py:pkg.main.Child", "pkg/util.py:pkg.util.Base", "inheritance"),
        ("pkg/main.py:pkg.main.Child.go", "pkg/util.py:pkg.util.Base.step", "call"),
        ("pkg/main.py:pkg.main.Child.go", "pkg/util.py:pkg.util.Base.run", "call"),
        ("pkg/util.py:pkg.util.Base.run", "pkg/util.py:pkg.util.Base.step", "call"),
        ("pkg/main.py:pkg.main", "pkg/util.py:pkg.util.helper", "import"),
        ("pkg/main.py:pkg.main", "pkg/util.py:pkg.util.Base", "import"),
        ("pkg/main.py:pkg.main", "pkg/util.py:pkg.util", "import"),
        ("pkg/main.py:pkg.main", "pkg/__init__.py:pkg", "import"),
    }
    assert {e for e in got if e[2] != "attribute"} == want
    reads = [e for e in got if e[2] == "attribute"]
    assert len(reads) == 1 and reads[0][0].endswith("Child.go")
    calls = [r for r in program["references"] if r["repo_id"] == "calls" and r["context"] == "call" and r["resolved"].endswith("helper")]
    assert sorted(r["name"] for r in calls) == ["helper", "pkg.util.helper", "u.helper", "util.helper"]


def test_frontier_is_what_is_not_proven(program):
    got = {(r["access_text"], r["reason_code"], r["context"]) for r in program["frontier"] if r["repo_id"] == "calls"}
    assert got == {
        ("early", "unresolved_name", "call"),
        ("thing", "unresolved_name", "call"),
        ("missing", "unresolved_name", "call"),
        ("obj.attr", "unresolved_attribute", "attribute_access"),
        ("alias.helper", "alias_chain", "call"),
        ("self.nothing", "unresolved_attribute", "attribute_access"),
    }
    bad = {(r["construct_text"], r["reason_code"]) for r in program["unsupported"] if r["repo_id"] == "calls"}
    assert bad == {
        ("from pkg.util import *", "star_import"),
        ("getattr(u, 'x')", "reflective_builtin"),
        ("obj.attr.deep.more", "unsupported_call_target"),
        ("obj.attr.deep", "unsupported_attribute_access"),
    }


def test_quarantine_keeps_a_broken_file(program):
    broken = [r for r in program["facts"] if r["path"] == "broken.py"]
    assert [r["fact"] for r in broken] == ["file", "definition", "diagnostic"]
    assert (broken[2]["sl"], broken[2]["snippet"]) == (1, "def x(:\n")
    assert not [r for r in program["symbols"] if r["path"] == "broken.py"]


def test_dataclasses_hooks_and_boundaries(program):
    fields = {(r["class_id"].rsplit(".", 1)[-1], r["name"], r["default"]) for r in program["dataclasses"]}
    assert fields == {("A", "x", None), ("A", "y", "'é'"), ("B", "w", None)}
    bad = {(r["construct_text"], r["reason_code"]) for r in program["unsupported"] if r["repo_id"] == "models"}
    assert bad == {
        ("hook.anything", "unsupported_attribute_access"),
        ("importlib.import_module('x')", "dynamic_import"),
        ("self.q", "unsupported_call_target"),
        ("metaclass=Meta", "metaclass_behavior"),
    }
    assert {(r["access_text"], r["context"]) for r in program["frontier"] if r["repo_id"] == "models"} == {("other", "decorator")}


def test_spans_count_characters():
    rows = repo.read_file("r", "a.py", "x = 'é' + f('ü')\n\x0cdef g(): pass\r\ny = g()\n".encode())
    call = next(r for r in rows if r["fact"] == "call" and r["text"] == "f")
    assert call["snippet"] == "f('ü')"
    assert next(r for r in rows if r["fact"] == "definition" and r["name"] == "g")["snippet"].startswith("def g")
    bad = repo.read_file("r", "b.py", b"x = '\xff'\n")
    assert [r["fact"] for r in bad] == ["file", "definition", "diagnostic"]


def test_parameters_and_duplicates():
    rows = repo.read_file("r", "a.py", b"def f(a, /, b=1, *c, d, e=2, **g): pass\ndef f(): pass\n")
    got = [(r["name"], r["kind"], r["n"], r["value"]) for r in rows if r["fact"] == "parameter"]
    assert got == [("a", "positional_only", 0, None), ("b", "positional_or_keyword", 1, "1"), ("c", "vararg", 2, None), ("d", "keyword_only", 3, None), ("e", "keyword_only", 4, "2"), ("g", "kwargs", 5, None)]
    assert [r["id"] for r in rows if r["fact"] == "definition"] == ["def:a.py:a", "def:a.py:a.f", "def:a.py:a.f#2"]


@given(st.from_regex(r"[a-z_]{1,4}(\.[a-z_]{1,4}){0,3}", fullmatch=True))
@settings(max_examples=200, deadline=None)
def test_shape_agrees_with_the_parser(text):
    def brute():
        try:
            at = ast.parse(text, mode="eval").body
        except SyntaxError:
            return None
        attrs = []
        while isinstance(at, ast.Attribute):
            attrs.insert(0, at.attr)
            at = at.value
        return (at.id, attrs) if isinstance(at, ast.Name) and len(attrs) <= 2 else None

    assert repo.shape(text) == brute()


def graph(bases, **names):
    return ClassGraph(bases, {(c, "m"): (f"{c}.m" if ok else None) for c, ok in names.items()})


@pytest.mark.parametrize(("bases", "names", "want"), [
    ({"A": []}, {"A": True}, "A.m"),
    ({"A": ["B"]}, {"A": False, "B": True}, None),
    ({"A": ["B"]}, {"B": True}, "B.m"),
    ({"A": ["B"], "B": ["C"], "C": ["D"]}, {"D": True}, "D.m"),
    ({"A": ["B"], "B": ["C"], "C": ["D"]}, {"C": False, "D": True}, None),
    ({"A": ["B", "C"]}, {"C": True}, "C.m"),
    ({"A": ["B", "C"], "B": ["D"], "C": ["E"]}, {"D": True, "E": True}, "D.m"),
    ({"A": ["B", "C"], "B": ["D"], "C": ["D"]}, {"C": True, "D": True}, "C.m"),
    ({"A": ["B", "C"], "B": ["D"], "C": ["D"]}, {"D": True}, "D.m"),
    ({"A": ["B", "C"], "B": ["D", "E"]}, {"C": True}, None),
    ({"A": ["B"], "B": ["A"]}, {}, None),
    ({"A": ["B"], "B": ["C", "D"]}, {"D": True}, "D.m"),
    ({"A": ["B"], "B": ["C", "D"]}, {"C": True, "D": True}, None),
])
def test_inheritance_rules(bases, names, want):
    assert graph(bases, **names).method("A", "m") == want
