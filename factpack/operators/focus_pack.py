"""Budget packing of scored units around a moving focus, and the search for the budget that fits.

The order of what is left depends on the focus, and the focus on what was taken, so it is a state
machine: one grouped map for each (query, repository, budget). Its group is the units of one repository.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Thresholds, slack in tokens, and what a detail is worth.
RELEVANT, DIRECT_SOURCE, DIRECT_SUMMARY, SUPPORT_SUMMARY, FOCUS_SOURCE = 0.05, 0.30, 0.20, 0.24, 0.26
OPEN_SOURCE, SOURCE_SLACK, SUPPORT_SLACK = 0.40, 8, 2
WARN_DIRECT, WARN_OPEN = 0.50, 0.30
RANK = {"identity": 1, "summary": 2, "source": 3}
EDIT_WORTH = {"identity": 0.20, "summary": 0.60, "source": 1.00}
SUPPORT_WORTH = {"identity": 0.35, "summary": 0.85, "source": 0.55}
OPEN_EDIT, OPEN_SUPPORT = 0.85, 0.90


@dataclass
class Unit:
    unit_id: str
    kind: str
    path: str
    sl: int
    sc: int
    p_edit: float
    p_support: float
    tokens: dict[str, int]
    scope: str | None
    file_scope: str | None
    text: dict[str, str] = field(default_factory=dict)
    sources: frozenset = frozenset()
    targets: frozenset = frozenset()
    name: str | None = None

    @property
    def proven(self) -> bool:
        return self.kind == "proven_symbol"

    @property
    def best(self) -> float:
        return max(self.p_edit, self.p_support)

    def preferred(self) -> str | None:
        if self.best < RELEVANT:
            return None
        if self.proven:
            return "source" if self.p_edit >= DIRECT_SOURCE else "summary" if self.p_edit >= DIRECT_SUMMARY or self.p_support >= SUPPORT_SUMMARY else "identity"
        if self.p_edit >= OPEN_SOURCE:
            return "source"
        if self.p_edit >= DIRECT_SUMMARY or self.p_support < RELEVANT:
            return "summary"
        return "identity"

    def chain(self, wanted: str) -> list[str]:
        """The details to try, richest first."""
        source, summary, identity = (self.tokens[d] for d in ("source", "summary", "identity"))
        everything = ["source", "summary", "identity"]
        if wanted == "source":
            return everything
        if self.best >= DIRECT_SUMMARY:
            if self.proven and source <= self.tokens[wanted]:
                return everything if wanted == "summary" else ["source", "identity"]
            if wanted == "identity" and summary <= identity:
                return ["summary", "identity"]
        if wanted == "identity":
            if self.best >= DIRECT_SUMMARY and self.proven and self.p_support >= DIRECT_SUMMARY:
                if source <= identity + SUPPORT_SLACK and source <= summary:
                    return ["source", "identity"]
                if summary <= identity + SUPPORT_SLACK:
                    return ["summary", "identity"]
            return ["identity"]
        if source <= summary:
            return everything if self.best >= DIRECT_SUMMARY else ["summary", "identity"]
        if self.p_support >= DIRECT_SUMMARY and source <= summary + SUPPORT_SLACK or self.p_edit >= DIRECT_SUMMARY and source <= summary + SOURCE_SLACK:
            return everything
        return ["summary", "identity"]

    def worth(self, detail: str) -> float:
        bare = not self.proven and detail == "source"
        return self.p_edit * EDIT_WORTH[detail] * (OPEN_EDIT if bare else 1) + self.p_support * SUPPORT_WORTH[detail] * (OPEN_SUPPORT if bare else 1)

    def order(self) -> tuple:
        return -self.best, -self.p_edit, -self.p_support, not self.proven, self.path, self.sl, self.sc, self.unit_id


@dataclass
class State:
    """What the order and the choices depend on while a pack is made."""

    focus: str | None = None
    file_scope: str | None = None
    supports: int = 0
    shown_open: bool = False
    inherited: bool = False
    waiting: str | None = None

    def is_caller(self, u: Unit) -> bool:
        return u.proven and self.focus in u.targets and u.p_edit >= DIRECT_SUMMARY

    def is_support(self, u: Unit) -> bool:
        return u.proven and self.focus in u.sources

    def in_file_scope(self, u: Unit) -> bool:
        return self.file_scope is not None and u.file_scope == self.file_scope == u.scope

    def is_open(self, u: Unit) -> bool:
        return not u.proven and (u.scope == self.focus or self.in_file_scope(u))

    def wanted(self, u: Unit) -> str | None:
        return u.preferred() or ("identity" if self.in_file_scope(u) else None)

    def hides_open(self, u: Unit) -> bool:
        if self.focus is None or u.proven:
            return False
        return not self.is_open(u) or self.inherited and u.kind == "unresolved_frontier"

    def hides(self, u: Unit) -> bool:
        if self.focus is None or not u.proven:
            return self.hides_open(u)
        return not self.is_caller(u) and not self.is_support(u) and u.best < DIRECT_SUMMARY

    def detail(self, u: Unit, left: int) -> str | None:
        wanted = None if self.hides(u) else self.wanted(u)
        if wanted is None:
            return None
        tries = u.chain(wanted)
        if self.focus is not None and self.is_support(u) and (u.p_edit >= DIRECT_SUMMARY or u.p_support >= FOCUS_SOURCE):
            tries = ["source", *tries]
        return next((d for d in tries if u.tokens[d] <= left), None)

    def order(self, u: Unit) -> tuple:
        if self.focus is None:
            return u.order()
        caller, support = self.is_caller(u), self.is_support(u)
        if caller:
            place = 0
        elif self.is_open(u):
            place = 3 if self.shown_open else 1
        elif support:
            place = (1 if self.shown_open else 2) + (self.supports > 0)
        else:
            place = 4
        near = u.best if caller or support and not self.supports else 0.0
        wanted = u.preferred()
        dense = u.p_support / max(1, u.tokens[wanted]) if wanted else 0.0
        return place, -near, -dense, -u.p_edit, not u.proven, u.path, u.sl, u.sc, u.unit_id

    def move(self, to: str, units: dict[str, Unit], **flags) -> None:
        self.focus, self.file_scope, self.supports, self.waiting = to, units[to].file_scope, 0, None
        for name, value in flags.items():
            setattr(self, name, value)


@dataclass
class Pack:
    chosen: dict[str, str]
    omitted: list[str]
    focuses: set[str]
    suppressed: set[str]


def pack(units: list[Unit], budget: int) -> Pack:
    """Take units one by one in the order that the present focus gives, each at the detail that fits."""
    by_id = {u.unit_id: u for u in units}
    state, left = State(), budget
    out = Pack({}, [], set(), set())
    pending, sorted_by = list(units), None
    while pending:
        # the order changes with these three alone
        if (now := (state.focus, state.supports > 0, state.shown_open)) != sorted_by:
            pending.sort(key=state.order, reverse=True)
            sorted_by = now
        u = pending.pop()
        detail = state.detail(u, left)
        if detail is None:
            out.omitted.append(u.unit_id)
            if state.hides_open(u):
                out.suppressed.add(u.unit_id)
            if state.waiting is not None and state.focus is not None and state.is_open(u):
                state.move(state.waiting, by_id, inherited=False)
                out.focuses.add(state.focus)
            continue
        out.chosen[u.unit_id] = detail
        left -= u.tokens[detail]
        leads = u.proven and detail != "identity" and u.p_edit >= max(DIRECT_SUMMARY, u.p_support)
        if leads and state.focus is None:
            state.move(u.unit_id, by_id, shown_open=False, inherited=False)
            out.focuses.add(u.unit_id)
        elif leads and state.is_caller(u):
            if any(state.is_open(x) and state.wanted(x) for x in pending):
                state.waiting = u.unit_id
            else:
                state.move(u.unit_id, by_id, shown_open=False, inherited=False)
                out.focuses.add(u.unit_id)
        elif state.focus is not None and state.is_open(u):
            state.shown_open = True
            if state.waiting is not None:
                state.move(state.waiting, by_id, inherited=True)
                out.focuses.add(state.focus)
        elif state.focus is not None and state.is_support(u):
            state.supports += 1
    return out


def confidence(units: list[Unit], chosen: dict[str, str]) -> float:
    if not units:
        return 1.0
    ideal = math.fsum(max(u.worth(d) for d in RANK) for u in units)
    got = math.fsum(u.worth(chosen[u.unit_id]) for u in units if u.unit_id in chosen)
    return min(1.0, max(0.0, got / ideal)) if ideal else 0.0


def warnings(units: list[Unit], made: Pack) -> list[tuple[str, str, str]]:
    """(code, unit_id, message), selections first, then omissions, each in unit order."""
    out, gone = [], set(made.omitted)
    for u in units:
        if u.unit_id in made.chosen:
            wanted, got = u.preferred(), made.chosen[u.unit_id]
            missing = sorted(u.targets & gone)
            if wanted and RANK[wanted] > RANK[got]:
                out.append(("budget_pressure", u.unit_id, f"{u.unit_id} was downgraded from {wanted} to {got} under budget pressure"))
            elif missing:
                out.append(("budget_pressure", u.unit_id, f"{u.unit_id} was selected without repository-backed support units under budget pressure: {', '.join(missing)}"))
    for u in units:
        if u.unit_id in gone:
            if u.p_edit >= WARN_DIRECT:
                out.append(("omitted_direct_candidate", u.unit_id, f"{u.unit_id} was omitted despite strong direct relevance (p_edit={u.p_edit:.2f})"))
            elif u.unit_id not in made.suppressed and not u.proven and (u.best >= WARN_OPEN or u.scope in made.focuses):
                out.append(("omitted_uncertainty", u.unit_id, f"{u.unit_id} was omitted even though it carried relevant uncertainty under the current budget"))
    return out


def document(units: list[Unit], chosen: dict[str, str]) -> str:
    """The chosen units' texts, by file and place."""
    files: dict[str, list[str]] = {}
    for u in sorted((u for u in units if u.unit_id in chosen), key=lambda u: (u.path, u.sl, u.sc, u.unit_id)):
        files.setdefault(u.path, []).append(u.text[chosen[u.unit_id]])
    return "\n".join(["# Context", "\n\n".join(f"{path}\n" + "\n\n".join(texts) for path, texts in files.items())] if files else ["# Context"])


def tokens(text: str) -> int:
    return max(1, (len(text) + 3) // 4)


def fit(units: list[Unit], budget: int) -> tuple[Pack, str]:
    """The pack of the largest unit budget, by bisection, whose whole document fits the budget."""
    low, high, best = 0, max(0, budget - tokens("# Context")), None
    while low <= high:
        middle = (low + high) // 2
        made = pack(units, middle)
        said = document(units, made.chosen)
        if tokens(said) <= budget:
            best, low = (made, said), middle + 1
        else:
            high = middle - 1
    if best is None:
        raise ValueError("the budget is too small for an empty document")
    return best


PACKED = "query_id string, repo_id string, budget int, unit_id string, rank int, detail string, token_count int, basis string, reason string, suppressed boolean, warnings array<struct<code:string,message:string>>, total_tokens int, confidence double, document string"


def _basis(u: Unit, by_id: dict[str, Unit]) -> str:
    if u.kind == "unresolved_frontier":
        return "unresolved_frontier_escalation"
    proven = u.p_support > u.p_edit and any(by_id[s].p_edit > 0 for s in u.sources if s in by_id)
    return "proven_dependency" if proven else "heuristic_candidate"


def reason(u: Unit, detail: str, by_id: dict[str, Unit]) -> str:
    """Why a unit was chosen, and why at another detail than the preferred one."""
    scores = f"(p_edit={u.p_edit:.2f}, p_support={u.p_support:.2f})"
    if _basis(u, by_id) == "proven_dependency":
        best = min((by_id[s] for s in u.sources if s in by_id), key=lambda x: (-x.p_edit, x.unit_id))
        said = f"selected as repository-backed support for {best.name or best.unit_id} {scores}"
    elif u.proven:
        said = f"selected for direct semantic relevance {scores}"
    else:
        what = "unresolved uncertainty" if u.kind == "unresolved_frontier" else "unsupported behavior"
        around = f" around {by_id[u.scope].name or u.scope}" if u.scope in by_id else f" around {u.scope}" if u.scope else ""
        said = f"selected to surface directly relevant {what} {scores}" if u.p_edit >= u.p_support else f"selected to keep {what} visible{around} {scores}"
    wanted = u.preferred()
    if wanted is None or wanted == detail:
        return said
    if RANK[detail] < RANK[wanted]:
        return f"{said}; downgraded to {detail} under budget pressure"
    more = u.tokens[detail] - u.tokens[wanted]
    if more <= 0:
        return f"{said}; promoted to {detail} because it cost no more than {wanted}"
    return f"{said}; promoted to {detail} because the richer view stayed within pack slack (+{more} tokens over {wanted})"


def pack_table(unit_table: DataFrame, scores: DataFrame, edges: DataFrame, budgets: DataFrame, whole: bool = True) -> DataFrame:
    """A row for each unit of each (query, repository, budget): detail null where it was omitted.

    ``whole`` keeps the budget for the assembled document, which the row of rank 0 carries.
    """
    near = edges.select("repo_id", F.col("src").alias("unit_id"), F.col("dst").alias("t"), F.lit(None).cast("string").alias("s")).unionByName(edges.select("repo_id", F.col("dst").alias("unit_id"), F.lit(None).cast("string").alias("t"), F.col("src").alias("s")))
    near = near.groupBy("repo_id", "unit_id").agg(F.array_sort(F.collect_set("t")).alias("targets"), F.array_sort(F.collect_set("s")).alias("sources"))
    rows = unit_table.join(near, ["repo_id", "unit_id"], "left").join(scores, ["repo_id", "unit_id"]).join(budgets, "query_id")
    rows = rows.select("query_id", "repo_id", F.col("budget").cast("int").alias("budget"), "unit_id", "kind", "path", "sl", "sc", "p_edit", "p_support", "enclosing_scope_id", "file_scope_id", "primary_text", *[f"{d}{s}" for d in RANK for s in ("", "_tokens")], "targets", "sources")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        none = lambda x: x if isinstance(x, str) else None
        many = lambda x: frozenset() if x is None or isinstance(x, float) else frozenset(x)
        units = [
            Unit(r.unit_id, r.kind, r.path, r.sl, r.sc, r.p_edit, r.p_support, {d: int(getattr(r, f"{d}_tokens")) for d in RANK}, none(r.enclosing_scope_id), none(r.file_scope_id), {d: getattr(r, d) for d in RANK}, many(r.sources), many(r.targets), none(r.primary_text))
            for r in part.itertuples(index=False)
        ]
        units.sort(key=Unit.order)
        budget = int(part["budget"].iloc[0])
        made, said = fit(units, budget) if whole else (pack(units, budget), None)
        if said is None:
            said = document(units, made.chosen)
        by_id = {u.unit_id: u for u in units}
        notes: dict[str, list] = {}
        for code, unit_id, message in warnings(units, made):
            notes.setdefault(unit_id, []).append({"code": code, "message": message})
        total = sum(by_id[k].tokens[d] for k, d in made.chosen.items())
        sure = confidence(units, made.chosen)
        out = [
            (part["query_id"].iloc[0], part["repo_id"].iloc[0], budget, u.unit_id, i, made.chosen.get(u.unit_id), u.tokens[made.chosen[u.unit_id]] if u.unit_id in made.chosen else 0, _basis(u, by_id), reason(u, made.chosen[u.unit_id], by_id) if u.unit_id in made.chosen else None, u.unit_id in made.suppressed, notes.get(u.unit_id, []), total, sure, said if i == 0 else None)
            for i, u in enumerate(units)
        ]
        return pd.DataFrame(out, columns=[x.split()[0] for x in PACKED.split(", ")])

    return rows.groupBy("query_id", "repo_id", "budget").applyInPandas(run, PACKED)
