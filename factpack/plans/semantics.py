"""From syntax facts to semantics: bindings, resolved imports and references, dependencies, frontier.

Every step is a join over the fact table, keyed by repository, so many repositories are resolved at
once. Rules that try one thing after another are rows with a rule number, and the least one wins. The
one Python step is the class graph of a repository (``operators.classes``), whose rules walk branches.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import classes
from ..sources import repo
from ..tables import cut

#: Which built-in calls are dynamic boundaries, and of what kind.
DYNAMIC = {
    "__import__": "dynamic_import",
    "setattr": "runtime_mutation", "delattr": "runtime_mutation", "globals": "runtime_mutation", "locals": "runtime_mutation",
    "getattr": "reflective_builtin", "hasattr": "reflective_builtin", "vars": "reflective_builtin", "dir": "reflective_builtin",
    "exec": "exec_or_eval", "eval": "exec_or_eval",
}
CALLABLE = ["function", "async_function", "class", "method"]
CALLERS = ["module", "function", "async_function", "method"]
_SPAN = ["sl", "sc", "el", "ec"]
_SITE = ["path", *_SPAN, "snippet"]


@dataclass
class Program:
    """The tables of analysed repositories."""

    facts: DataFrame
    symbols: DataFrame
    bindings: DataFrame
    imports: DataFrame
    references: DataFrame
    dataclasses: DataFrame
    dependencies: DataFrame
    frontier: DataFrame
    unsupported: DataFrame
    #: Records of runtime evidence, where the analysis was given observations.
    provenance: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        held = {f.name: getattr(self, f.name) for f in fields(self)}
        return {k: v for k, v in held.items() if v is not None}


def _of(facts: DataFrame, fact: str) -> DataFrame:
    return facts.where(F.col("fact") == fact)


def bind(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, bindings) of the facts of files that parse."""
    named = _of(facts, "definition").select("repo_id", F.col("id").alias("owner"), F.col("text").alias("within"), F.col("kind").alias("owner_kind"))
    plain = facts.where("fact in ('parameter', 'import', 'assignment') and name is not null").join(named, ["repo_id", "owner"])
    is_class = (F.col("fact") == "assignment") & (F.col("owner_kind") == "class")
    bound = plain.select(
        "repo_id", F.col("owner").alias("scope_id"), "name",
        F.when(F.col("fact") != "assignment", F.col("fact")).when(is_class, "class_attribute").otherwise("assignment").alias("binding_kind"),
        F.col("id").alias("symbol_id"),
        F.when(F.col("fact") == "parameter", "parameter").when(F.col("fact") == "import", "imported_name").when(is_class, "attribute").otherwise("local").alias("symbol_kind"),
        F.concat_ws(".", "within", "name").alias("qualified_name"), "seq", *_SITE,
    )
    defined = _of(facts, "definition").select(
        "repo_id", F.col("owner").alias("scope_id"), "name", F.lit("definition").alias("binding_kind"), F.col("id").alias("symbol_id"),
        F.col("kind").alias("symbol_kind"), F.col("text").alias("qualified_name"), "seq", *_SITE,
    )
    every = defined.unionByName(bound)
    symbols = every.select("repo_id", "symbol_id", F.col("symbol_kind").alias("kind"), "qualified_name", F.coalesce("scope_id", "symbol_id").alias("defining_scope_id"), *_SITE).dropDuplicates(["repo_id", "symbol_id"])
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(["definition", "parameter", "import", "assignment", "class_attribute"]) for x in (k, min(i, 3))])
    order = F.struct("sl", "sc", "el", "ec", rank[F.col("binding_kind")].alias("category"), "seq").alias("ord")
    bindings = every.where("scope_id is not null").select("repo_id", "scope_id", "name", "binding_kind", "symbol_id", "path", "sl", "sc", "el", "ec", order)
    return symbols, bindings


def _unique_definitions(facts: DataFrame) -> DataFrame:
    return _of(facts, "definition").groupBy("repo_id", F.col("text").alias("qualified_name")).agg(F.count("*").alias("n"), F.min("id").alias("target"), F.min("kind").alias("target_def_kind")).where("n = 1").drop("n")


def _modules(facts: DataFrame) -> DataFrame:
    return _of(facts, "definition").where("kind = 'module'").groupBy("repo_id", F.col("text").alias("qualified_name")).agg(F.max_by("id", "path").alias("module_id"))


def absolute_module(module: Column, relative: Column, importer: Column, is_package: Column) -> Column:
    """The dotted module that an import names; null above the root of the repository."""
    level = F.length(F.regexp_extract(module, r"^\.*", 0))
    parts = F.filter(F.split(importer, r"\."), lambda x: x != "")
    package = F.when(is_package, parts).otherwise(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    left = F.size(package) - (level - 1)
    rest = F.filter(F.split(F.regexp_replace(module, r"^\.+", ""), r"\."), lambda x: x != "")
    return F.when(~relative, module).when(left >= 0, F.array_join(F.concat(F.slice(package, F.lit(1), F.greatest(left, F.lit(0))), rest), "."))


def resolve_imports(facts: DataFrame) -> DataFrame:
    """Imports with a proven target: target_kind, target_name and target (null: external)."""
    files = _of(facts, "file").select("repo_id", "path", F.col("module").alias("importer"))
    asked = _of(facts, "import").where("kind != 'star_import'").join(files, ["repo_id", "path"])
    name = absolute_module(F.col("module"), F.col("flag"), F.col("importer"), F.col("path").endswith("__init__.py"))
    asked = asked.withColumn("absolute", name).where("absolute is not null")
    whole = F.when(F.col("kind") == "import", F.col("absolute")).otherwise(F.concat_ws(".", "absolute", "imported"))
    dotted = (F.col("kind") == "import") & F.col("alias").isNull() & F.col("absolute").contains(".")
    # a dotted import needs its whole name proven, and binds its first part
    asked = asked.withColumns({"whole": whole, "wanted": F.when(dotted, F.substring_index("absolute", ".", 1)).otherwise(whole)})
    modules = _modules(facts)
    found = (
        asked.join(modules.select("repo_id", F.col("qualified_name").alias("whole"), F.lit(True).alias("proven")), ["repo_id", "whole"], "left")
        .join(modules.select("repo_id", F.col("qualified_name").alias("wanted"), "module_id"), ["repo_id", "wanted"], "left")
        .join(_unique_definitions(facts).select("repo_id", F.col("qualified_name").alias("wanted"), "target", "target_def_kind"), ["repo_id", "wanted"], "left")
    )
    external = F.when((F.col("kind") == "import") & (F.col("absolute") == "dataclasses"), "dataclasses")
    external = external.when((F.col("kind") == "from_import") & (F.col("absolute") == "dataclasses") & (F.col("imported") == "dataclass"), "dataclasses.dataclass")
    definition = (F.col("kind") == "from_import") & F.col("target").isNotNull() & (F.col("target_def_kind") != "module")
    module = F.when((F.col("kind") == "import") & dotted & F.col("proven").isNull(), None).otherwise(F.coalesce(F.when(F.col("kind") == "from_import", F.col("target")), F.col("module_id")))
    out = found.select(
        "repo_id", F.col("id").alias("import_id"), F.col("name").alias("bound_name"), F.col("owner").alias("scope_id"), *_SITE,
        F.when(external.isNotNull(), "external").when(definition, "definition").when(module.isNotNull(), "module").alias("target_kind"),
        F.coalesce(external, F.col("wanted")).alias("target_name"),
        F.when(external.isNull(), F.when(definition, F.col("target")).otherwise(module)).alias("target"),
    )
    return out.where("target_kind is not null")


def look_up(asks: DataFrame, facts: DataFrame, bindings: DataFrame) -> DataFrame:
    """As-of over scopes: each ask (ask_id, scope_id, name, path, sl, sc, excluded) with its binding.

    Nearest scope first, then the latest binding that is visible at the site: parameters always,
    definitions that start before it, others that end before it. One aggregate of the best struct.
    """
    chain = _of(facts, "definition").select("repo_id", F.col("id").alias("scope_id"), F.posexplode("chain").alias("depth", "at_scope"))
    theirs = bindings.select("repo_id", F.col("scope_id").alias("at_scope"), "name", "binding_kind", "symbol_id", "ord", F.col("path").alias("bpath"), F.col("sl").alias("bsl"), F.col("sc").alias("bsc"), F.col("el").alias("bel"), F.col("ec").alias("bec"))
    at = F.struct("sl", "sc")
    defined = (F.struct("bsl", "bsc") < at) & (F.col("excluded").isNull() | (F.col("excluded") != F.col("symbol_id")))
    visible = F.when(F.col("binding_kind") == "parameter", True).when(F.col("binding_kind") == "definition", defined).otherwise(F.struct("bel", "bec") <= at)
    rows = asks.join(chain, ["repo_id", "scope_id"]).join(theirs, ["repo_id", "at_scope", "name"]).where((F.col("path") == F.col("bpath")) & visible)
    best = F.max(F.struct((-F.col("depth")).alias("near"), "ord", "symbol_id", "binding_kind")).alias("best")
    return rows.groupBy("repo_id", "ask_id").agg(best).select("repo_id", "ask_id", F.col("best.symbol_id").alias("bound"), F.col("best.binding_kind").alias("bound_kind"))


def _surfaces(facts: DataFrame) -> DataFrame:
    """Decorators, bases, calls and attributes with their context and the scope they are evaluated in."""
    owners = _of(facts, "definition").select("repo_id", F.col("id").alias("owner"), F.col("owner").alias("parent"))
    attached = facts.where("fact in ('decorator', 'base')").join(owners, ["repo_id", "owner"]).where("parent is not null")
    attached = attached.withColumns({"scope_id": F.col("parent"), "excluded": F.col("owner")}).drop("parent")
    inner = facts.where("fact in ('call', 'attribute')").withColumns({"scope_id": F.col("owner"), "excluded": F.lit(None).cast("string")})
    context = F.when(F.col("fact") == "base", "base_class").when(F.col("fact") == "attribute", F.col("kind")).otherwise(F.col("fact"))
    return attached.unionByName(inner).withColumn("context", context)


def analyse(files: DataFrame, keep=cut) -> Program:
    """(repo_id, path, content) -> the tables of a Program; ``keep`` materialises what is read often."""
    raw = keep(repo.facts(files))
    bad = _of(raw, "diagnostic").select("repo_id", "path").distinct()
    facts = keep(raw.join(bad, ["repo_id", "path"], "left_anti"))
    symbols, bindings = (keep(x) for x in bind(facts))
    imports = keep(resolve_imports(facts))
    surfaces = _surfaces(facts)

    def ask(rows: DataFrame, tag: str, name: str, excluded: Column) -> DataFrame:
        return rows.where(F.col(name).isNotNull()).select("repo_id", F.concat_ws("|", F.lit(tag), "id", *_SPAN).alias("ask_id"), "scope_id", F.col(name).alias("name"), "path", "sl", "sc", excluded.alias("excluded"))

    nothing = F.lit(None).cast("string")
    values = _of(facts, "assignment").withColumn("scope_id", F.col("owner"))
    asks = ask(surfaces, "ref", "root", F.col("excluded")).unionByName(ask(surfaces, "site", "root", nothing)).unionByName(ask(values, "value", "vroot", nothing))
    found = keep(look_up(asks, facts, bindings))

    def with_binding(rows: DataFrame, tag: str) -> DataFrame:
        return rows.withColumn("ask_id", F.concat_ws("|", F.lit(tag), "id", *_SPAN)).join(found, ["repo_id", "ask_id"], "left").drop("ask_id")

    by_import = imports.select("repo_id", F.col("import_id").alias("bound"), "target_kind", "target_name", "target")
    kinds = symbols.select("repo_id", F.col("symbol_id").alias("target_id"), F.col("kind").alias("target_symbol_kind"))
    looked = with_binding(surfaces, "ref").join(by_import, ["repo_id", "bound"], "left")
    references = keep(_references(looked, facts, bindings, kinds))
    chains = keep(classes.graph(references, facts, bindings, looked.where("context in ('call', 'attribute_access') and bound_kind = 'parameter'")))
    own = chains.where("target is not null").select("repo_id", F.col("id").alias("reference_id"), F.col("target").alias("own"))
    references = keep(_with_own(references, own, looked))
    dependencies = _dependencies(facts, imports, references, symbols)
    hooked = chains.where("hooked").select("repo_id", F.col("id").alias("class_id"), F.lit(True).alias("hooked")).distinct()
    alias = _aliases(with_binding(values, "value").join(by_import, ["repo_id", "bound"], "left"), facts)
    frontier, unsupported = _frontier(raw, facts, with_binding(surfaces, "site").join(by_import, ["repo_id", "bound"], "left"), references, alias, hooked)
    return Program(raw, symbols, bindings, imports, references, _dataclasses(looked, facts), dependencies, frontier, unsupported)


def _chain_targets(looked: DataFrame, facts: DataFrame, attrs: str = "attrs") -> DataFrame:
    """Import-rooted chains: modules all the way, then a unique definition that is no module."""
    modules = _modules(facts).select("repo_id", F.col("qualified_name").alias("through"), F.lit(True).alias("is_module"))
    definitions = _unique_definitions(facts).select("repo_id", F.col("qualified_name").alias("full"), F.col("target").alias("chain_target"), "target_def_kind")
    rows = looked.withColumns({
        "full": F.when((F.col("target_kind") == "module") & (F.size(attrs) > 0), F.concat(F.col("target_name"), F.lit("."), F.array_join(attrs, "."))),
        "through": F.when((F.col("target_kind") == "module") & (F.size(attrs) == 2), F.concat(F.col("target_name"), F.lit("."), F.col(attrs)[0])),
    })
    rows = rows.join(modules, ["repo_id", "through"], "left").join(definitions.where("target_def_kind != 'module'"), ["repo_id", "full"], "left")
    ok = F.col("through").isNull() | F.col("is_module")
    return rows.withColumn("chain_target", F.when(ok, F.col("chain_target"))).drop("full", "through", "is_module", "target_def_kind")


def _references(looked: DataFrame, facts: DataFrame, bindings: DataFrame, kinds: DataFrame) -> DataFrame:
    """References by names and import-rooted chains; calls must target something callable."""
    rows = _chain_targets(looked.where("bound is not null and context != 'store' and context != 'attribute_access'"), facts)
    call = F.col("context") == "call"
    imported = F.col("bound_kind") == "import"
    marker = F.when(~call & (F.col("target_kind") == "external"), F.col("bound"))
    name = F.when(imported, F.when(F.col("target_kind") == "definition", F.col("target")).when(F.col("target_name") == "dataclasses.dataclass", marker)).otherwise(F.col("bound"))
    chain = F.when(imported, F.coalesce("chain_target", F.when((F.col("target_name") == "dataclasses") & (F.array_join("attrs", ".") == "dataclass"), marker)))
    rows = rows.withColumn("target_id", F.when(F.size("attrs") == 0, name).otherwise(chain)).where("target_id is not null")
    rows = rows.join(kinds, ["repo_id", "target_id"]).where(~call | F.col("target_symbol_kind").isin(CALLABLE))
    return rows.select("repo_id", F.concat(F.lit("reference:"), F.col("id")).alias("reference_id"), F.col("text").alias("name"), "context", F.col("target_id").alias("resolved"), "scope_id", "owner", "n", *_SITE).dropDuplicates(["repo_id", "reference_id", *_SPAN])


def _with_own(references: DataFrame, own: DataFrame, looked: DataFrame) -> DataFrame:
    """References and the self calls and reads that the class graph proves, which come first."""
    rows = looked.where("context in ('call', 'attribute_access')").withColumn("reference_id", F.concat(F.lit("reference:"), F.col("id")))
    mine = rows.join(own, ["repo_id", "reference_id"]).select("repo_id", "reference_id", F.col("text").alias("name"), "context", F.col("own").alias("resolved"), "scope_id", "owner", "n", *_SITE)
    mine = mine.where("size(split(name, '[.]')) = 2").dropDuplicates(["repo_id", "reference_id", *_SPAN])
    return references.join(own, ["repo_id", "reference_id"], "left_anti").unionByName(mine)


def _dataclasses(looked: DataFrame, facts: DataFrame) -> DataFrame:
    """Fields of the classes whose one decorator proves to be the standard dataclass."""
    proven = looked.where("context = 'decorator' and bound_kind = 'import' and target_kind = 'external'")
    proven = proven.where("(size(attrs) = 0 and target_name = 'dataclasses.dataclass') or (target_name = 'dataclasses' and array_join(attrs, '.') = 'dataclass')")
    owners = _of(facts, "definition").where("kind = 'class'").select("repo_id", F.col("id").alias("owner"))
    alone = _of(facts, "decorator").groupBy("repo_id", "owner").agg(F.count("*").alias("n")).where("n = 1").select("repo_id", "owner")
    models = proven.join(owners, ["repo_id", "owner"]).join(alone, ["repo_id", "owner"]).select("repo_id", F.col("owner").alias("class_id"), F.col("id").alias("decorator_id"))
    fields_ = _of(facts, "assignment").where("note is not null and name is not null").select("repo_id", F.col("owner").alias("class_id"), F.col("id").alias("field_id"), "name", F.col("note").alias("annotation"), F.col("value").alias("default"), "sl", "sc")
    return models.join(fields_, ["repo_id", "class_id"], "left")


def _dependencies(facts: DataFrame, imports: DataFrame, references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Proven edges between symbols, by kinds that a context allows at either end."""
    kind = symbols.select("repo_id", F.col("symbol_id"), "kind")
    end = lambda c, k: kind.select("repo_id", F.col("symbol_id").alias(c), F.col("kind").alias(k))
    first = imports.where("target is not null").select("repo_id", F.concat(F.lit("dependency:import:"), F.col("import_id")).alias("dependency_id"), F.col("scope_id").alias("src"), F.col("target").alias("dst"), F.lit("import").alias("kind"), F.col("import_id").alias("evidence"))
    label = F.create_map(*[F.lit(x) for k, v in {"call": "call", "attribute_access": "attribute", "base_class": "inheritance", "decorator": "decorator"}.items() for x in (k, v)])
    prefix = F.create_map(*[F.lit(x) for k, v in {"call": "call", "attribute_access": "attribute", "base_class": "base", "decorator": "decorator"}.items() for x in (k, v)])
    source = F.when(F.col("context").isin("base_class", "decorator"), F.col("owner")).otherwise(F.col("scope_id"))
    external = imports.where("target_kind = 'external'").select("repo_id", F.col("import_id").alias("resolved"))
    second = references.join(external, ["repo_id", "resolved"], "left_anti").select("repo_id", F.concat(F.lit("dependency:"), prefix[F.col("context")], F.lit(":"), F.col("reference_id")).alias("dependency_id"), source.alias("src"), F.col("resolved").alias("dst"), label[F.col("context")].alias("kind"), F.col("reference_id").alias("evidence"))
    rows = first.unionByName(second).join(end("src", "src_kind"), ["repo_id", "src"]).join(end("dst", "dst_kind"), ["repo_id", "dst"])
    allowed = (
        F.when(F.col("kind") == "import", F.col("src_kind").isin([*CALLERS, "class"]))
        .when(F.col("kind") == "call", F.col("src_kind").isin(CALLERS))
        .when(F.col("kind") == "attribute", F.col("src_kind").isin(CALLERS) & (F.col("dst_kind") == "attribute"))
        .when(F.col("kind") == "inheritance", (F.col("src_kind") == "class") & (F.col("dst_kind") == "class"))
        .otherwise(F.col("src_kind").isin(CALLABLE) & F.col("dst_kind").isin(CALLABLE))
    )
    return rows.where(allowed).dropDuplicates(["repo_id", "dependency_id"]).select("repo_id", "dependency_id", "src", "dst", "kind", "evidence")


def _aliases(values: DataFrame, facts: DataFrame) -> DataFrame:
    """Assignments whose value is itself a name or chain that an import of the repository proves."""
    rows = _chain_targets(values.where("bound_kind = 'import' and vattrs is not null"), facts, "vattrs")
    modules = _modules(facts).select("repo_id", F.col("qualified_name").alias("whole"), F.lit(True).alias("whole_module"))
    rows = rows.withColumn("whole", F.concat_ws(".", "target_name", F.array_join("vattrs", "."))).join(modules, ["repo_id", "whole"], "left")
    simple = (F.size("vattrs") == 0) & F.col("target_kind").isin("module", "definition")
    proven = simple | ((F.size("vattrs") > 0) & F.col("chain_target").isNotNull())
    return rows.where(proven).select("repo_id", F.col("id").alias("bound"), F.lit(True).alias("aliased")).distinct()


def _frontier(raw: DataFrame, facts: DataFrame, sites: DataFrame, references: DataFrame, alias: DataFrame, hooked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is not proven: (frontier, unsupported), each surface routed once."""
    done = references.select("repo_id", F.expr("substring(reference_id, 11)").alias("id")).distinct()
    open_ = sites.where("context in ('decorator', 'base_class', 'call')").join(done, ["repo_id", "id"], "left_anti")
    sign = ["path", "sl", "sc", "text"]
    parts = F.split("name", r"\.")
    named = references.select("repo_id", "path", "sl", "sc", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).alias("text"))
    covered = facts.where("fact in ('decorator', 'base', 'call')").select("repo_id", *sign).unionByName(named).distinct()
    attributes = sites.where("fact = 'attribute'").join(covered, ["repo_id", *sign], "left_anti").withColumn("id", F.concat_ws(":", "id", "el", "ec"))

    methods = _of(facts, "definition").where("kind = 'method'").select("repo_id", F.col("id").alias("scope_id"), F.col("owner").alias("class_id"))
    decorated = _of(facts, "decorator").select("repo_id", F.col("owner").alias("scope_id")).distinct()
    first = _of(facts, "parameter").where("n = 0 and name = 'self' and kind in ('positional_only', 'positional_or_keyword')").select("repo_id", F.col("owner").alias("scope_id"), F.col("id").alias("self_id"))
    guarded = methods.join(decorated, ["repo_id", "scope_id"], "left_anti").join(first, ["repo_id", "scope_id"]).join(hooked, ["repo_id", "class_id"]).select("repo_id", "scope_id", F.col("self_id").alias("bound"), F.lit(True).alias("self_hooked"))
    module_hooks = _of(facts, "definition").where("name = '__getattr__' and kind in ('function', 'async_function')").select("repo_id", F.col("owner").alias("target"), F.lit(True).alias("module_hooked")).distinct()
    module_hooks = module_hooks.join(_of(facts, "definition").where("kind = 'module'").select("repo_id", F.col("id").alias("target")), ["repo_id", "target"])
    bound_import = _of(facts, "import").select("repo_id", F.col("id").alias("bound"), F.col("kind").alias("import_kind"), F.col("module").alias("import_module"), "imported")
    rows = open_.unionByName(attributes).drop("module", "imported")
    rows = rows.join(alias, ["repo_id", "bound"], "left").join(guarded, ["repo_id", "scope_id", "bound"], "left").join(module_hooks, ["repo_id", "target"], "left").join(bound_import, ["repo_id", "bound"], "left")

    call, one = F.col("context") == "call", F.size("attrs") == 1
    table = F.create_map(*[F.lit(x) for k, v in DYNAMIC.items() for x in (k, v)])
    by_name = F.when(F.col("bound").isNull(), F.element_at(table, F.col("root"))).when((F.col("import_kind") == "from_import") & (F.col("import_module") == "importlib") & (F.col("imported") == "import_module"), "dynamic_import")
    by_root = F.when((F.array_join("attrs", ".") == "import_module") & (F.col("import_kind") == "import") & (F.col("import_module") == "importlib"), "dynamic_import")
    dynamic = F.when(call & F.col("attrs").isNotNull(), F.when(F.size("attrs") == 0, by_name).otherwise(by_root))
    hook_name = F.col("attrs")[0].isin("__getattr__", "__getattribute__")
    shallow = (F.col("bound_kind") == "assignment") & F.col("aliased").isNotNull()
    unsupported = (
        F.when(F.col("attrs").isNull(), True)
        .when((F.size("attrs") == 2) & ~F.coalesce((F.col("bound_kind") == "import") | shallow, F.lit(False)), True)
        .when(one & (F.col("root") == "self") & ~hook_name & F.col("self_hooked").isNotNull() & (F.col("bound_kind") == "parameter"), True)
        .when(one & F.col("context").isin("call", "attribute_access", "store") & (F.col("attrs")[0] != "__getattr__") & (F.col("target_kind") == "module") & F.col("module_hooked").isNotNull(), True)
        .otherwise(False)
    )
    why = F.when(F.col("context") == "decorator", "opaque_decorator").when(F.col("context") == "base_class", "unsupported_base_expression").when(call, "unsupported_call_target").otherwise("unsupported_attribute_access")
    routed = rows.withColumns({"dynamic": dynamic, "bad": unsupported, "why": why, "shallow": F.coalesce(shallow, F.lit(False))})
    reason = F.when(F.col("shallow"), "alias_chain").when(F.size("attrs") == 0, "unresolved_name").otherwise("unresolved_attribute")
    frontier = routed.where("dynamic is null and not bad").select("repo_id", F.concat(F.lit("frontier:"), F.col("id")).alias("access_id"), F.col("text").alias("access_text"), "context", "scope_id", reason.alias("reason_code"), *_SITE)
    construct = lambda text, code: ["repo_id", F.concat(F.lit("unsupported:"), F.col("id")).alias("construct_id"), text.alias("construct_text"), code.alias("reason_code"), "scope_id", *_SITE]
    trimmed = F.regexp_replace("snippet", r"^\s+|\s+$", "")
    said = F.when(F.col("dynamic").isNotNull(), F.coalesce(trimmed, F.col("text"))).otherwise(F.col("text"))
    closed = routed.where("dynamic is not null or bad").select(*construct(said, F.coalesce("dynamic", "why")))
    stars = _of(facts, "import").where("kind = 'star_import'").withColumn("scope_id", F.col("owner"))
    stars = stars.select(*construct(F.coalesce(trimmed, F.concat(F.lit("from "), F.col("module"), F.lit(" import *"))), F.lit("star_import")))
    parents = _of(facts, "definition").where("owner is not null").select("repo_id", F.col("id").alias("owner"), F.col("owner").alias("scope_id"))
    meta = _of(facts, "metaclass").join(parents, ["repo_id", "owner"]).select(*construct(F.coalesce(trimmed, F.col("text")), F.lit("metaclass_behavior")))
    return frontier, closed.unionByName(stars).unionByName(meta)
