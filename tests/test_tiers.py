"""The five-tier stack: symbol graph, renders, scores and packs."""

import random

import pytest
from pyspark.sql import functions as F

from factpack.plans import tier_refine as R
from factpack.plans import tiers as T
from factpack.sources import outline, repo

FILES = {
    "pkg/__init__.py": "",
    "pkg/models.py": "LIMIT = 3\nname = 1\n\nclass User(object):\n    \"\"\"A user.\n\n    More.\"\"\"\n    def greet(self):\n        return self.say(LIMIT)\n    def say(self, x):\n        \"\"\"Say it.\"\"\"\n        return x\n    class Inner:\n        pass\n",
    "pkg/service.py": "from pkg.models import User, LIMIT\nimport os\n\ndef build(a,\n          b=1):\n    return User(a, LIMIT)\n\n@wraps\ndef run():\n    return build(1)\n",
    "main.py": "import pkg.service\nfrom pkg import models\n\ndef main(): return 1\n",
    "bad.py": "def x(:\n",
}


@pytest.fixture(scope="module")
def built(spark):
    nodes, edges = T.graph(repo.from_texts(spark, {"r": FILES}))
    return nodes, edges, T.renders(nodes, edges)


def test_graph(built):
    nodes, edges, _ = built
    ids = {r.node_id: r.kind for r in nodes.collect()}
    assert ids["pkg/models.py::User.Inner"] == "class" and ids["pkg/models.py::User.greet"] == "method" and ids["module:pkg"] == "module"
    assert "pkg/models.py::name" not in ids and ids["pkg/models.py::LIMIT"] == "constant" and ids["file:bad.py"] == "file"
    got = {(r.src, r.dst) for r in edges.where("kind = 'calls'").collect()}
    assert got == {("pkg/models.py::User.greet", "pkg/models.py::User.say"), ("pkg/service.py::run", "pkg/service.py::build")}
    imported = {(r.src, r.dst) for r in edges.where("kind = 'imports'").collect()}
    assert imported == {
        ("pkg/service.py::import:1", "file:pkg/models.py"), ("pkg/service.py::import:1", "pkg/models.py::User"), ("pkg/service.py::import:1", "pkg/models.py::LIMIT"),
        ("main.py::import:1", "file:pkg/service.py"), ("main.py::import:2", "file:pkg/models.py"),
    }


def test_renders(built):
    rows = {r.node_id: r for r in built[2].collect()}
    build = rows["pkg/service.py::build"]
    assert build.stub == "def build(a, b=1): ..." and build.summary == "def build(a, b=1)"
    assert build.slice.startswith("# Imports\nfrom pkg.models import User, LIMIT\n\n# Source\ndef build(a,")
    user = rows["pkg/models.py::User"]
    assert user.summary == "class User(object) (2 methods) -- A user." and user.stub == 'class User(object):\n    """A user."""\n    def greet(self): ...\n    def say(self, x): ...'
    assert user.slice.startswith("# Constants\nLIMIT = 3\n\n# Source\n")
    assert rows["pkg/models.py::User.greet"].slice.startswith("# Constants\nLIMIT = 3\n\n# Referenced signatures\ndef say(self, x): ...\n\n# Source\n")
    assert rows["file:pkg/models.py"].summary == "models.py (1 class, 1 constant)" and rows["module:pkg"].summary == "pkg/ (3 files)"
    assert rows["main.py::main"].stub == "def main(): ..." and rows["pkg/service.py::run"].full.startswith("@wraps\n")
    assert rows["pkg/models.py::LIMIT"].omit == "[ref: pkg/models.py::LIMIT]" and rows["pkg/models.py::LIMIT"].omit_tokens == max(1, len("[ref: pkg/models.py::LIMIT]") // 4)


def test_scores_spread(spark, built):
    nodes, edges, _ = built
    queries = spark.createDataFrame([("q", "fix User.greet", 100), ("none", "", 100)], "query_id string, query string, budget int")
    got = {(r.query_id, r.node_id): r for r in T.score(nodes, edges, queries).collect()}
    best = max((r for k, r in got.items() if k[0] == "q" and "::" in k[1]), key=lambda r: r.p_edit)
    assert best.node_id == "pkg/models.py::User"
    say, greet = got["q", "pkg/models.py::User.say"], got["q", "pkg/models.py::User.greet"]
    assert greet.p_edit > say.p_edit and all(0 <= r.p_edit <= 1 and 0 <= r.p_support <= 1 for r in got.values())
    assert got["none", "pkg/models.py::User.say"].p_edit == pytest.approx(0.03)
    assert got["none", "pkg/models.py::User.say"].p_support == pytest.approx(0.04 + 2 * 0.3 * 0.03)
    assert got["q", "file:pkg/models.py"].p_edit == got["q", "pkg/models.py::User"].p_edit


def test_packs(spark):
    queries = spark.createDataFrame([("q", "fix User.greet", 60), ("q2", "fix User.greet", 4000)], "query_id string, query string, budget int")
    rows = T.compile_tiers(repo.from_texts(spark, {"r": FILES}), queries).collect()
    whole = [r for r in rows if r.query_id == "q2"]
    assert all(r.tier for r in whole) and whole[0].total_tokens <= 4000
    document = next(r.document for r in whole if r.document)
    assert document.startswith("# Compiled Context\n# Query: fix User.greet\n# Budget: ") and "### User [" in document
    small = [r for r in rows if r.query_id == "q"]
    assert sum(r.token_cost for r in small) == small[0].total_tokens
    assert {r.reason for r in small} <= {None, "budget_pressure", "low_relevance", "dependency_only"}


MISSES = "miss_id string, query_id string, repo_id string, kind string, evidence string"


def test_misses_meet_symbols(spark, built):
    asked = {
        "id": ("absent_symbol", " pkg/models.py::User.say "), "name": ("absent_symbol", "build"), "dotted": ("absent_symbol", "pkg.models.User"), "part": ("absent_symbol", "ree"), "none": ("absent_symbol", "nobody"),
        "file": ("edit_to_omitted", "service.py"), "trace": ("out_of_pack_trace", "File 'main.py', line 4, in greet"), "bare": ("out_of_pack_trace", "see /home/x/main.py"),
    }
    misses = spark.createDataFrame([(k, "q", "r", *v) for k, v in asked.items()], MISSES)
    got = {}
    for r in R.ground(misses, built[0]).collect():
        got.setdefault(r.miss_id, set()).add(r.node_id)
    assert got == {
        "id": {"pkg/models.py::User.say"}, "name": {"pkg/service.py::build"}, "dotted": {"pkg/models.py::User"}, "part": {"pkg/models.py::User.greet"},
        "file": {"pkg/service.py::build", "pkg/service.py::run"}, "trace": {"main.py::main", "pkg/models.py::User.greet"}, "bare": {"main.py::main"},
    }


def test_what_shows_enough(spark):
    rows = spark.createDataFrame([(k, t) for k in ("function", "constant") for t in (*T.TIERS, None)], "kind string, tier string")
    got = {(r.kind, r.tier) for r in rows.where(R.sufficient(F.col("kind"), F.col("tier"))).collect()}
    assert got == {("function", "slice"), ("function", "full"), ("constant", "summary"), ("constant", "stub"), ("constant", "slice"), ("constant", "full")}


def test_tier_refinement(spark, built):
    files = repo.from_texts(spark, {"r": FILES})
    queries = spark.createDataFrame([("q", "main", 20)], "query_id string, query string, budget int")
    packed = T.cut(T.compile_tiers(files, queries))
    before = {r.node_id: r for r in packed.collect()}
    misses = spark.createDataFrame([("m", "q", "r", "absent_symbol", "run"), ("n", "q", "r", "absent_symbol", "nobody")], MISSES)
    said = {r.miss_id: r for r in R.diagnose(misses, built[0], built[1], packed).collect()}
    assert said["m"].missed_units == ["pkg/service.py::run"] and said["m"].recommended_expansions == ["pkg/service.py::build", "pkg/service.py::run"]
    shown = before["pkg/service.py::run"].token_cost > 0
    assert said["m"].reason == (R.INSUFFICIENT if shown else R.PRESSED) % "run"
    assert said["n"].missed_units == [] and said["n"].reason == "No matching symbols found in the graph."
    again, new = R.recompile(files, queries, misses, packed, 400)
    tiers = {r.node_id: r.tier for r in again.collect()}
    assert tiers["pkg/service.py::run"] in ("slice", "full") and {r.budget for r in again.collect()} == {420}
    assert {r.node_id for r in new.collect()} == {k for k, t in tiers.items() if t not in (None, "omit") and before[k].tier in (None, "omit")}


def test_upgrades_fit():
    draw = random.Random(7)
    for _ in range(200):
        items = [(str(i), draw.random(), draw.random(), sorted(draw.randrange(1, 50) for _ in T.TIERS)) for i in range(draw.randrange(12))]
        budget = draw.randrange(200)
        taken = T.upgrade(items, budget)
        assert sum(cost[taken[i]] for i, _, _, cost in items if i in taken) <= budget


def test_outline_of_odd_files():
    rows = outline.outline("r", "a.py", b"class A:\n    def f(self): pass\n    def f(self): return 2\nclass A: pass\ndef g(): pass\ndef g(): return 1\nX: int = 2\n")
    assert [r["node_id"] for r in rows] == ["file:a.py", "a.py::A", "a.py::A.f", "a.py::A.f#2", "a.py::A#2", "a.py::g", "a.py::X"]
    assert next(r for r in rows if r["node_id"] == "a.py::g")["source"] == "def g(): return 1\n"
