"""The class graph of a repository: which method a ``self`` call reaches, and where hooks apply.

One grouped map per repository over its class facts alone: bases in declared order, the names that
class bodies bind last, and the self calls and reads to decide. Walks are cycle-safe.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOOKS = ("__getattr__", "__getattribute__")


class ClassGraph:
    """bases: class -> bases in order; owned: (class, name) -> eligible method or None if it has none."""

    def __init__(self, bases: dict[str, list[str]], owned: dict[tuple[str, str], str | None]):
        self.bases, self.owned = bases, owned

    def ancestors(self, cls: str) -> list[str]:
        """All proven ancestors, in preorder of the declared order."""
        seen, left = [], list(reversed(self.bases.get(cls, [])))
        while left:
            at = left.pop()
            if at not in seen:
                seen.append(at)
                left += reversed(self.bases.get(at, []))
        return [x for x in seen if x != cls]

    def line(self, cls: str) -> list[str] | None:
        """cls and its bases as long as each has one; None where the line forks or turns in on itself."""
        out = [cls]
        while above := self.bases.get(out[-1], []):
            if len(above) > 1 or above[0] in out:
                return None
            out.append(above[0])
        return out

    def first_owner(self, names: list[str], name: str) -> str | None:
        """The method of the first class that binds the name; None if that one is not eligible."""
        owner = next((c for c in names if (c, name) in self.owned), None)
        return owner and self.owned[owner, name]

    def method(self, cls: str, name: str) -> str | None:
        """The method that ``self.name()`` in a method of cls reaches, by the first rule that proves one."""
        if own := self.owned.get((cls, name)):
            return own
        if name in HOOKS or (cls, name) in self.owned:
            return None
        direct = self.bases.get(cls, [])
        lines = [self.line(c) for c in direct]
        straight = all(x is not None for x in lines)
        rules = (self._single_base, self._up_one_line, self._disjoint_branches, self._shared_tail, self._sole_provider)
        return next((found for rule in rules if (found := rule(cls, name, direct, lines if straight else None))), None)

    def _single_base(self, cls, name, direct, lines):
        return self.owned.get((direct[0], name)) if len(direct) == 1 else None

    def _up_one_line(self, cls, name, direct, lines):
        if len(direct) != 1:
            return None
        line = [direct[0]]
        # as far as the line is straight: a fork above the first owner does not matter
        while (line[-1], name) not in self.owned:
            above = self.bases.get(line[-1], [])
            if len(above) != 1 or above[0] in line:
                return None
            line.append(above[0])
        return self.owned[line[-1], name] if len(line) > 1 else None

    def _disjoint_branches(self, cls, name, direct, lines):
        if len(direct) < 2 or lines is None or len({c for x in lines for c in x}) < sum(map(len, lines)):
            return None
        return self.first_owner([c for x in lines for c in x], name)

    def _shared_tail(self, cls, name, direct, lines):
        if len(direct) < 2 or lines is None:
            return None
        shared = 0
        while all(len(x) > shared for x in lines) and len({x[-1 - shared] for x in lines}) == 1:
            shared += 1
        return self.first_owner([c for x in lines for c in x[: len(x) - shared]], name) if shared else None

    def _sole_provider(self, cls, name, direct, lines):
        if len(direct) > 1 and lines is None or any((c, name) in self.owned for c in direct):
            return None
        above = [c for c in self.ancestors(cls) if c not in direct and (c, name) in self.owned]
        return self.owned[above[0], name] if len(above) == 1 else None


def graph(references: DataFrame, facts: DataFrame, bindings: DataFrame, asks: DataFrame) -> DataFrame:
    """(repo_id, id, target, hooked): self calls and reads with their targets, classes with hook flags."""
    definitions = facts.where("fact = 'definition'")
    of_class = definitions.where("kind = 'class'").select("repo_id", F.col("id").alias("cls"))
    bases = references.where("context = 'base_class'").select("repo_id", F.col("owner").alias("cls"), F.col("resolved").alias("other"), F.col("n").alias("n"))
    bases = bases.join(of_class.withColumnRenamed("cls", "other"), ["repo_id", "other"]).join(of_class, ["repo_id", "cls"]).select("repo_id", F.lit("base").alias("row"), "cls", F.lit(None).cast("string").alias("name"), "other", "n")
    last = bindings.groupBy("repo_id", F.col("scope_id").alias("cls"), "name").agg(F.max(F.struct("ord", "symbol_id", "binding_kind")).alias("last"), F.sum(F.when(F.col("binding_kind") == "class_attribute", 1).otherwise(0)).alias("attributes"))
    methods = definitions.where("kind = 'method'").groupBy("repo_id", F.col("owner").alias("cls"), "name").agg(F.count("*").alias("methods"), F.min("id").alias("method"))
    decorated = facts.where("fact = 'decorator'").select("repo_id", F.col("owner").alias("method"), F.lit(True).alias("decorated")).distinct()
    held = last.join(of_class, ["repo_id", "cls"]).join(methods, ["repo_id", "cls", "name"], "left").join(decorated, ["repo_id", "method"], "left")
    method = F.when((F.col("methods") == 1) & F.col("decorated").isNull() & (F.col("last.symbol_id") == F.col("method")), F.col("method"))
    attribute = F.when((F.col("attributes") == 1) & (F.col("last.binding_kind") == "class_attribute"), F.col("last.symbol_id"))
    names = held.select("repo_id", F.lit("name").alias("row"), "cls", "name", method.alias("other"), F.lit(0).alias("n"))
    fields = held.select("repo_id", F.lit("field").alias("row"), "cls", "name", attribute.alias("other"), F.lit(0).alias("n")).where("other is not null")
    # a hook counts as soon as the class defines the method, whatever binds the name last
    hooks = methods.where(F.col("name").isin(*HOOKS)).select("repo_id", F.lit("hook").alias("row"), "cls", "name", F.lit(None).cast("string").alias("other"), F.lit(0).alias("n"))
    own_method = definitions.where("kind = 'method'").select("repo_id", F.col("id").alias("scope_id"), F.col("owner").alias("cls"))
    plain = own_method.join(decorated.select("repo_id", F.col("method").alias("scope_id")), ["repo_id", "scope_id"], "left_anti")
    first = facts.where("fact = 'parameter' and n = 0 and name = 'self' and kind in ('positional_only', 'positional_or_keyword')").select("repo_id", F.col("owner").alias("scope_id"), F.col("id").alias("bound"))
    mine = asks.where("size(attrs) = 1").select("repo_id", "scope_id", "bound", F.col("attrs")[0].alias("name"), F.concat(F.lit("reference:"), F.col("id")).alias("other"), F.col("context").alias("row"), "value")
    mine = mine.where("row = 'call' or value = 'self'").join(plain, ["repo_id", "scope_id"]).join(first, ["repo_id", "scope_id", "bound"]).select("repo_id", "row", "cls", "name", "other", F.lit(0).alias("n"))
    rows = bases.unionByName(names).unionByName(fields).unionByName(hooks).unionByName(mine)

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        by = {k: list(g[["cls", "name", "other"]].itertuples(index=False, name=None)) for k, g in part.sort_values(["row", "cls", "n"], kind="stable").groupby("row")}
        above: dict[str, list[str]] = {}
        for cls, _, base in by.get("base", []):
            above.setdefault(cls, []).append(base)
        text = lambda x: x if isinstance(x, str) else None
        own = ClassGraph(above, {(c, n): text(o) for c, n, o in by.get("name", [])})
        reads = {(c, n): o for c, n, o in by.get("field", [])}
        hooks_ = {(c, n) for c, n, _ in by.get("hook", [])}
        lineage = {c: [c, *own.ancestors(c)] for c in set(part["cls"])}
        guarded = {c for c, line in lineage.items() if any((x, "__getattribute__") in hooks_ for x in line)}
        out = [(c, None, any((x, h) in hooks_ for x in line for h in HOOKS)) for c, line in lineage.items()]
        out += [(o, own.method(c, n), False) for c, n, o in by.get("call", []) if c not in guarded]
        out += [(o, reads.get((c, n)), False) for c, n, o in by.get("attribute_access", []) if c not in guarded]
        frame = pd.DataFrame(out, columns=["id", "target", "hooked"])
        return frame.assign(repo_id=part["repo_id"].iloc[0])[["repo_id", "id", "target", "hooked"]]

    return rows.groupBy("repo_id").applyInPandas(decide, "repo_id string, id string, target string, hooked boolean").distinct()
