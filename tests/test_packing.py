"""Scores, renders and packs of small repositories, and the promises that every pack keeps."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factpack.operators import focus_pack as P
from factpack.plans import compile as C
from factpack.plans import scoring, semantics
from factpack.sources import repo

from .test_semantics import REPOS

ROUTES = {"pkg/router.py": "from pkg.store import save_order\nfrom pkg.check import check_order\n\ndef route_order(order):\n    check_order(order)\n    audit.log(order)\n    return save_order(order)\n", "pkg/store.py": "def save_order(order):\n    return order\n", "pkg/check.py": "def check_order(order):\n    if not order:\n        raise ValueError('empty')\n", "pkg/__init__.py": "", "pkg/noise.py": "def unrelated():\n    return 'x' * 100\n"}


@pytest.fixture(scope="module")
def program(spark):
    return semantics.analyse(repo.from_texts(spark, {**REPOS, "routes": ROUTES}))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("q1", "fix route_order to check the order", 200), ("q2", "", 60), ("q3", "Child.go step", 400)], "query_id string, query string, budget int")


@pytest.fixture(scope="module")
def table(program):
    return scoring.units(program)


def test_renders(table):
    rows = {r.unit_id: r for r in table.where("repo_id = 'models'").collect()}
    a = rows["def:m.py:m.A"]
    assert a.summary == "proven summary: class m.A @ m.py:4:1-8:9\ndecorators: dataclass\ndataclass: dataclasses.dataclass\nfields: x: int; y: str = 'é'"
    assert a.source.startswith("dataclass\nclass A:") and a.identity.startswith("proven symbol\nkind: class\nqualified_name: m.A\nunit_id: def:m.py:m.A\nfile: m.py\nspan: 4:1-8:9\nproof_status: proven")
    assert a.identity_tokens == max(1, (len(a.identity) + 3) // 4)
    bad = next(r for r in rows.values() if r.primary_text == "self.q")
    assert bad.identity.splitlines()[:2] == ["unsupported construct", f"unit_id: {bad.unit_id}"] and bad.source.endswith("source_snippet:\nself.q()")
    open_ = next(r for r in rows.values() if r.primary_text == "other")
    assert open_.identity == "unresolved: other @ m.py:15:1"


def brute_terms(text):
    import re

    seen = []
    for token in re.split("[^A-Za-z0-9]+", text):
        for part in [token, *re.findall(r"[A-Z]+(?=[A-Z][a-z]|\b)|[A-Z]?[a-z]+|[0-9]+", token)]:
            if part and part.lower() not in seen:
                seen.append(part.lower())
    return seen


def brute_relevance(query, primary, searchable, path, body):
    from factpack.functions import text as X

    q = brute_terms(query)
    phrase = lambda t: 1.0 if q == brute_terms(t) else 0.85 if " ".join(q) in " ".join(brute_terms(t)) and brute_terms(t) else 0.0
    share = lambda a, b: sum(x in b for x in a) / len(a) if a else 0.0
    base = min(1.0, 0.45 * phrase(primary) + 0.15 * phrase(searchable) + 0.25 * share(q, brute_terms(primary)) + 0.10 * share(q, brute_terms(searchable)) + 0.05 * share(q, brute_terms(path)))
    if not body or not brute_terms(body):
        return base
    focus = [x for x in q if x not in X.GLUE] or q
    pairs = lambda x: set(zip(x, x[1:], strict=False))
    grams = len(pairs(focus) & pairs(brute_terms(body))) / len(pairs(focus)) if pairs(focus) else 0.0
    return min(1.0, base + 0.55 * share(focus, brute_terms(body)) + 0.15 * grams)


def test_scores_are_brute_force(program, table, queries):
    got = {(r.query_id, r.repo_id, r.unit_id): (r.p_edit, r.p_support) for r in scoring.score(program, table, queries.drop("budget")).collect()}
    units = table.collect()
    edges = [(r.repo_id, r.src, r.dst) for r in program.dependencies.collect()]
    assert len(got) == 3 * len(units)
    for q, text, _ in queries.collect():
        edit, support = {}, {}
        for u in units:
            searchable = "\n".join(x for x in (u.primary_text, u.path, u.extra, u.summary) if x)
            body = u.source if u.symbol_kind in ("function", "async_function", "class", "method") else None
            s = brute_relevance(text, u.primary_text, searchable, u.path, body) if brute_terms(text) else 0.0
            edit[u.repo_id, u.unit_id], support[u.repo_id, u.unit_id] = 0.8 * s, 0.3 * s
        base = dict(edit)
        for key in base:
            best = [max(base[r, d], support[r, d]) for r, s, d in set(edges) if (r, s) == key and (r, d) in base]
            best = [x for x in best if x >= 0.15]
            if base[key] >= 0.05 and len(best) >= 2:
                edit[key] = min(1.0, base[key] + 0.12 * sum(best) / len(best))
        for r, s, d in edges:
            if (r, s) in edit and (r, d) in support:
                support[r, d] += 0.5 * edit[r, s] * (1 - support[r, d])
        for u in units:
            if u.kind != scoring.PROVEN and (u.repo_id, u.scope_id) in edit:
                support[u.repo_id, u.unit_id] += 0.4 * edit[u.repo_id, u.scope_id] * (1 - support[u.repo_id, u.unit_id])
        for (r, u), e in edit.items():
            assert got[q, r, u] == pytest.approx((e, support[r, u]), abs=1e-9)


def test_embeddings_count(program, table, spark):
    asked = spark.createDataFrame([("q", "anything at all")], "query_id string, query string")
    flat = scoring.direct(table, asked)
    like = scoring.direct(table, asked, embed=lambda texts: [[1.0, 0.0] for _ in texts])
    both = flat.join(like.selectExpr("repo_id", "unit_id", "p_edit as e2", "p_support as s2"), ["repo_id", "unit_id"])
    assert both.where("abs(e2 - least(1, p_edit + 0.2)) > 1e-9 or abs(s2 - least(1, p_support + 0.2)) > 1e-9").count() == 0


def test_compiled_documents(program, queries):
    packed = C.pack_units(program, queries)
    found = C.results(packed, queries)
    assert C.violations(found).count() == 0
    rows = {(r.query_id, r.repo_id): r for r in found.collect()}
    assert len(rows) == 9
    routes = rows["q1", "routes"]
    chosen = {s.unit_id: s.detail for s in routes.selections}
    assert chosen["def:pkg/router.py:pkg.router.route_order"] == "source"
    assert "def:pkg/check.py:pkg.check.check_order" in chosen and "def:pkg/noise.py:pkg.noise.unrelated" in routes.omitted_unit_ids
    assert any(k.startswith("frontier:") for k in chosen)
    reasons = {x.unit_id: x.reason for x in routes.selections}
    assert reasons["def:pkg/router.py:pkg.router.route_order"].startswith("selected for direct semantic relevance (p_edit=")
    assert any("repository-backed support for pkg.router.route_order" in x or "direct" in x for x in reasons.values())
    assert routes.document.startswith("# Context\npkg/check.py\n") and "\n\npkg/router.py\n" in routes.document
    assert rows["q2", "routes"].document == "# Context" and rows["q2", "routes"].confidence == 0.0


def drawn(draw, n):
    ids = [f"u{i}" for i in range(n)]
    units = []
    for i in range(n):
        kind = draw.choice(["proven_symbol"] * 3 + ["unresolved_frontier", "unsupported_construct"])
        cost = sorted(draw.randrange(1, 40) for _ in range(3))
        draw.shuffle(cost)
        units.append(P.Unit(ids[i], kind, draw.choice("ab"), i, 0, draw.choice([0, 0.04, 0.1, 0.2, 0.25, 0.35, 0.6]), draw.choice([0, 0.05, 0.2, 0.25, 0.3]), dict(zip(P.RANK, cost, strict=True)), draw.choice([None, *ids]), draw.choice([None, "u0"]), {d: d * 3 for d in P.RANK}, frozenset(draw.sample(ids, min(n, draw.randrange(3)))), frozenset(draw.sample(ids, min(n, draw.randrange(3))))))
    return units


@given(st.integers(0, 10**9), st.integers(0, 14), st.integers(0, 150))
@settings(max_examples=150, deadline=None)
def test_packs_keep_their_promises(seed, n, budget):
    draw = random.Random(seed)
    units = drawn(draw, n)
    made = P.pack(units, budget)
    cost = {u.unit_id: u.tokens for u in units}
    assert sum(cost[k][d] for k, d in made.chosen.items()) <= budget
    assert sorted([*made.chosen, *made.omitted]) == sorted(cost)
    draw.shuffle(units)
    again = P.pack(units, budget)
    assert (again.chosen, set(again.omitted), again.suppressed) == (made.chosen, set(made.omitted), made.suppressed)
    assert 0 <= P.confidence(units, made.chosen) <= 1
    if budget >= 3:
        assert P.tokens(P.fit(units, budget)[1]) <= budget


@pytest.mark.parametrize(("edit", "support", "tokens", "want"), [
    (0.30, 0.0, (5, 9, 30), ["source", "summary", "identity"]),
    (0.20, 0.0, (5, 9, 9), ["source", "summary", "identity"]),
    (0.20, 0.0, (5, 9, 17), ["source", "summary", "identity"]),
    (0.20, 0.0, (5, 9, 18), ["summary", "identity"]),
    (0.0, 0.21, (5, 9, 7), ["source", "identity"]),
    (0.0, 0.21, (9, 11, 30), ["summary", "identity"]),
    (0.0, 0.21, (9, 9, 30), ["summary", "identity"]),
    (0.0, 0.10, (9, 9, 8), ["identity"]),
    (0.0, 0.25, (5, 9, 11), ["source", "summary", "identity"]),
    (0.0, 0.25, (5, 9, 12), ["summary", "identity"]),
])
def test_detail_chains(edit, support, tokens, want):
    u = P.Unit("u", "proven_symbol", "a", 1, 0, edit, support, dict(zip(P.RANK, tokens, strict=True)), None, None)
    assert u.chain(u.preferred()) == want
