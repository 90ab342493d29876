"""From ontology sources to inferred records: materialise, what-if, explain; roles; workflows as triples; contracts.

``materialise`` compiles classes, roles and instances, each where there are sources, and reasons over all of
it in one plan. ``what_if`` derives the facts once and follows the change. Nothing is written here.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.model import TRIPLES
from kbspark.operators import compile as comp
from kbspark.operators import derivations, governance, reasoning
from kbspark.operators.reasoning import Rules
from kbspark.sources.yaml_files import namespace_of


@dataclass
class Materialised:
    """Triples of all sources, the rules, asserted and gained facts, and one record for each individual with gains."""

    triples: DataFrame
    rules: Rules
    types: DataFrame
    gained_types: DataFrame
    gained_props: DataFrame
    records: DataFrame


def compiled(spark: SparkSession, definitions: dict[str, dict], roles: dict[str, dict], instances: DataFrame | None, base: str | None = None) -> tuple[DataFrame, Rules]:
    """(triples, rules) that sources state. ``definitions`` and ``roles``: documents by domain; ``instances``: rows of ``read_instances``.

    A domain's namespace is that of its instances' file, else that of its definition, else ``base``; a domain
    without any raises. Instances of all files are compiled in one plan.
    """
    triples, rules = spark.createDataFrame([], TRIPLES), Rules()
    for domain, doc in definitions.items():
        space = namespace_of(doc) or base
        if not space:
            raise ValueError(f"no namespace for definition {domain}")
        own, more = comp.compile_classes(spark, doc, space)
        triples = triples.unionByName(comp.rewrite_carriers(own, space)[0])
        rules.conditions += more.conditions
    for domain, doc in roles.items():
        space = namespace_of(doc, definitions.get(domain)) or base
        if not space:
            raise ValueError(f"no namespace for roles {domain}")
        triples = triples.unionByName(comp.compile_roles(spark, doc, space))
    if instances is not None:
        spaces = []
        for r in instances.select("stem", "head").distinct().orderBy("stem").collect():  # one row a file
            space = namespace_of(json.loads(r.head), definitions.get(r.stem)) or base
            if not space:
                raise ValueError(f"no namespace for instances {r.stem}")
            spaces.append((r.stem, r.head, space))
        if spaces:
            spaced = instances.join(spark.createDataFrame(spaces, "stem string, head string, base string"), ["stem", "head"])
            triples = triples.unionByName(comp.compile_instances(spaced))
    triples = reasoning.saved(triples.distinct(), "triples")
    found = comp.rules_of(triples)
    found.conditions = rules.conditions
    return triples, found


def materialise(spark: SparkSession, definitions: dict[str, dict], roles: dict[str, dict], instances: DataFrame | None, base: str | None = None) -> Materialised:
    """``compiled`` sources and all that follows from them."""
    return reasoned(*compiled(spark, definitions, roles, instances, base))


def stated_facts(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(types (x, c), properties (x, p, y)) that ``triples`` state of named individuals."""
    typed = triples.filter(F.col("p") == comp.RDF + "type")
    individuals = typed.filter(F.col("o") == comp.OWL + "NamedIndividual").select(F.col("s").alias("iri")).distinct()
    properties = typed.filter(F.col("o") == comp.OWL + "ObjectProperty").select(F.col("s").alias("iri"))
    types = typed.join(individuals.withColumnRenamed("iri", "s"), "s", "left_semi").filter(F.col("o") != comp.OWL + "NamedIndividual").select(F.col("s").alias("x"), F.col("o").alias("c"))
    return types, reasoning.individual_facts(triples, individuals, properties)


def reasoned(triples: DataFrame, rules: Rules) -> Materialised:
    """Reasoning over the individuals of ``triples``."""
    types, props = stated_facts(triples)
    gt, gp = reasoning.reason(types, props, rules)
    return Materialised(triples, rules, types, gt, gp, reasoning.delta_records(types, gt, gp))


def derived(triples: DataFrame, rules: Rules) -> derivations.Derived:
    """The facts of ``triples`` and of what follows from them, each with a derivation."""
    return derivations.derive(_facts(triples), derivations.Axioms.of(rules))


def _facts(triples: DataFrame) -> DataFrame:
    types, props = stated_facts(triples)
    typed = types.select(F.col("x").alias("s"), F.lit(derivations.TYPE).alias("p"), F.col("c").alias("o"))
    return reasoning.saved(typed.unionByName(props.select(F.col("x").alias("s"), "p", F.col("y").alias("o"))).distinct(), "stated")


def what_if(now: Materialised | tuple[DataFrame, Rules], then: Materialised | tuple[DataFrame, Rules]) -> DataFrame:
    """(x, fact, change): inferred types and properties that other sources add or take away; both sides ``compiled`` (or materialised).

    Only the first is reasoned over as a whole; the second is a change of its facts and axioms.
    """
    key = ["s", "p", "o"]
    now, then = ((m.triples, m.rules) if isinstance(m, Materialised) else m for m in (now, then))
    a, b = _facts(now[0]), _facts(then[0])
    before = derivations.derive(a, derivations.Axioms.of(now[1]))
    after, moved = derivations.changed(before, b.join(a, key, "left_anti"), a.join(b, key, "left_anti"), derivations.Axioms.of(then[1]))
    # Facts that are inferred on one side only: those that came or went, and those stated on one side.
    touched = moved.select(*key).unionByName(a.join(b, key, "left_anti")).unionByName(b.join(a, key, "left_anti")).distinct()
    inferred = lambda d: d.facts.filter(F.col("rule") != derivations.STATED).join(touched, key, "left_semi").select(*key)
    was, is_ = inferred(before), inferred(after)
    out = is_.join(was, key, "left_anti").withColumn("change", F.lit("added")).unionByName(was.join(is_, key, "left_anti").withColumn("change", F.lit("removed")))
    out = out.filter(~(F.col("s").startswith("_:") | F.col("o").startswith("_:") | F.col("p").startswith("_:")))
    return out.select(F.col("s").alias("x"), F.concat_ws(" ", "p", "o").alias("fact"), "change")


def why(found: derivations.Derived, ids: DataFrame) -> DataFrame:
    """(id, goal, depth, fact, rule, because): proofs of all that is inferred of the individuals ``ids`` (id); facts as text."""
    goals = found.facts.filter(F.col("rule") != derivations.STATED).join(ids.select(F.col("id").alias("s")).distinct(), "s", "left_semi").filter(~F.col("o").startswith("_:"))
    text = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(" ", f"{c}.s", f"{c}.p", f"{c}.o"))
    rows = derivations.proofs(found, goals)
    return rows.select(F.col("goal.s").alias("id"), F.concat_ws(" ", "goal.p", "goal.o").alias("goal"), "depth", F.concat_ws(" ", "s", "p", "o").alias("fact"), "rule", F.concat_ws("; ", text("p1"), text("p2")).alias("because"))


def explain(originals: DataFrame, inferred: DataFrame) -> DataFrame:
    """(id, original, inferred): records as JSON, of the one side, the other, or both (``originals``: id or entity_id)."""
    keys = [F.col(c) for c in ("id", "entity_id") if c in originals.columns]
    a = originals.select(F.coalesce(*keys).alias("id"), F.to_json(F.struct(*originals.columns)).alias("original"))
    b = inferred.select(F.col("x").alias("id"), F.to_json(F.struct(*inferred.columns)).alias("inferred"))
    return a.join(b, "id", "full").select("id", "original", "inferred")


def rendered_explanation(row) -> str:
    """Lines of one row of ``explain``."""
    out = [f"instance: {row['id']}"]
    if row["original"]:
        own = json.loads(row["original"])
        out += ["[record]", f"  type: {own.get('entity_type') or own.get('type', '-')}", *(f"  {k}: {v}" for k, v in own.items() if k not in ("id", "entity_id", "entity_type", "type"))]
    if row["inferred"]:
        gained = json.loads(row["inferred"])
        out += ["[inferred]", *(f"  + {t}" for t in gained.get("inferred_types") or []), *(f"  {p}: {', '.join(v)}" for p, v in (gained.get("inferred_properties") or {}).items())]
    else:
        out.append("[nothing inferred]")
    return "\n".join(out)


def declare_roles(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` roles (name, source_refs) with ``rejected``: evidence_required, duplicate_role (in ``existing`` or before it in ``new``), or null."""
    from kbspark.operators.evidence import mark_first

    first = mark_first(new.withColumn("_at", F.monotonically_increasing_id()), "name", "_at").drop("_at")
    known = existing.select("name", F.lit(True).alias("_known")).distinct()
    none = F.array().cast("array<string>")
    reason = F.when(F.size(F.coalesce("source_refs", none)) == 0, "evidence_required").when(F.col("_known").isNotNull() | ~F.col("kept"), "duplicate_role")
    return first.join(known, "name", "left").withColumn("rejected", reason).drop("_known", "kept")


def list_roles(roles: DataFrame, axioms: DataFrame) -> DataFrame:
    """``roles`` (name, ...) with ``state``: axiomatised where an axiom (role) is about them, else declared."""
    about = axioms.select(F.col("role").alias("name"), F.lit(True).alias("_has")).distinct()
    return roles.join(about, "name", "left").withColumn("state", F.when(F.col("_has"), "axiomatised").otherwise("declared")).drop("_has")


def role_gate(props: DataFrame, roles: DataFrame) -> DataFrame:
    """(rule, subject, detail): undeclared roles in use, draft roles in use, aliases that collide; empty: the gate is open."""
    text = lambda c: F.col(c).cast("string")
    out = reasoning.undeclared_roles(props, roles).select(F.lit("undeclared").alias("rule"), F.col("p").alias("subject"), text("uses").alias("detail"))
    out = out.unionByName(reasoning.draft_roles_in_use(props, roles).select(F.lit("draft_in_use").alias("rule"), F.col("p").alias("subject"), text("uses").alias("detail")))
    return out.unionByName(reasoning.alias_collisions(roles).select(F.lit("alias_collision").alias("rule"), F.col("name").alias("subject"), F.col("other").alias("detail")))


def shape_triples(m: Materialised, inference: bool = False) -> DataFrame:
    """Triples to check shapes on: as stated, or with what is inferred (off by default: closed types add focus nodes to cardinality shapes)."""
    if not inference:
        return m.triples
    none = F.lit(None).cast("string")
    row = lambda df, p, o: df.select(F.col("x").alias("s"), p.alias("p"), F.col(o).alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_lang"), none.alias("o_dt"))
    return m.triples.unionByName(row(m.gained_types, F.lit(comp.RDF + "type"), "c")).unionByName(row(m.gained_props, F.col("p"), "y")).distinct()


_FLOW = "https://example.org/workflow#"


def workflow_triples(workflows: DataFrame, base: str = _FLOW) -> DataFrame:
    """Triples of workflow records (``read_workflows``): literal fields, and one step subject for each step, with its index."""
    s = F.concat(F.lit(base), "id")
    none = F.lit(None).cast("string")
    row = lambda df, subject, p, o, kind: df.select(subject.alias("s"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), none.alias("o_lang"), none.alias("o_dt"))
    fields = ("id", "version", "category", "kind", "mode", "status", "tool", "hitl_required", "max_retry", "oracle", "oracle_threshold")
    out = row(workflows, s, F.lit(comp.RDF + "type"), F.lit(base + "Workflow"), "iri")
    pairs = workflows.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("k"), F.col(f).cast("string").alias("v")) for f in fields])).alias("x")).filter("x.v is not null")
    out = out.unionByName(row(pairs, s, F.concat(F.lit(base), "x.k"), F.col("x.v"), "literal"))
    steps = workflows.select("id", F.posexplode("pipeline").alias("at", "step"))
    own = F.concat(F.lit(base), "id", F.lit("/step/"), F.col("at").cast("string"))
    out = out.unionByName(row(steps, s, F.lit(base + "hasStep"), own, "iri")).unionByName(row(steps, own, F.lit(base + "stepIndex"), F.col("at").cast("string"), "literal"))
    parts = steps.select("id", "at", F.explode(F.array(*[F.struct(F.lit(f).alias("k"), F.col(f"step.{f}").alias("v")) for f in ("step_id", "tool", "action")])).alias("x")).filter("x.v is not null")
    return out.unionByName(row(parts, own, F.concat(F.lit(base), "x.k"), F.col("x.v"), "literal"))


def out_of_sync(expected: DataFrame, written: DataFrame) -> DataFrame:
    """(side, s, p, o): triples that only one of two graphs has; sets are compared, not texts."""
    keys = ["s", "p", "o", "o_kind"]
    a, b = expected.select(*keys).distinct(), written.select(*keys).distinct()
    missing = a.exceptAll(b).select(F.lit("missing").alias("side"), "s", "p", "o")
    return missing.unionByName(b.exceptAll(a).select(F.lit("unexpected").alias("side"), "s", "p", "o"))


#: What a pack must say.
CORE_SKILLS, PACK_MODES = 8, ("compatibility", "strict-soft", "v1-strict")


def core_skill_count(pack: DataFrame) -> DataFrame:
    """One row: distinct core skills (skill) and whether they are as many as there must be."""
    return pack.agg(F.countDistinct("skill").alias("n")).withColumn("ok", F.col("n") == CORE_SKILLS)


def hub_violations(hub: DataFrame) -> DataFrame:
    """(contract, detail): no hub text (text) at all, or none that says it is locked."""
    one = hub.agg(F.count("*").alias("n"), F.count_if(F.contains("text", F.lit("locked: true"))).alias("locked"))
    broken = F.when(F.col("n") == 0, "canonical_root_hub_present").when(F.col("locked") == 0, "canonical_root_hub_locked")
    return one.select(broken.alias("contract"), F.lit("hub").alias("detail")).filter("contract is not null")


def contract_check(workflows: DataFrame, index: DataFrame, files: DataFrame, hub: DataFrame, pack: DataFrame, version: str, mode: str, expected: str) -> DataFrame:
    """(contract, detail): repeated workflow ids, indexed paths without a file, the hub, the pack's version, skills and mode."""
    text = lambda c: F.col(c).cast("string").alias("detail")
    out = governance.repeated_ids(workflows, "id", "file").select(F.lit("workflow_id_unique").alias("contract"), text("id")).distinct()
    out = out.unionByName(governance.missing_paths(index, files).select(F.lit("workflow_path").alias("contract"), text("path"))).unionByName(hub_violations(hub))
    out = out.unionByName(core_skill_count(pack).filter("not ok").select(F.lit("pack_config_core_count").alias("contract"), text("n")))
    spark = pack.sparkSession
    plain = [("pack_config_version", version, version != expected), ("pack_config_migration_mode", mode, mode not in PACK_MODES)]
    return out.unionByName(spark.createDataFrame([(c, d) for c, d, bad in plain if bad], "contract string, detail string"))


def layered_violations(workflows: DataFrame) -> DataFrame:
    """(id, rule) of workflow records of either layout: the flat rules, and for layered files the blocks that they need."""
    flat = governance.contract_violations(workflows.withColumn("pipeline", F.transform("pipeline", lambda s: F.coalesce(s["step_id"], s["tool"]))))
    need = [F.when(F.try_element_at("blocks", F.lit(b)).isNull(), F.lit(f"missing_block:{b}")) for b in ("module", "x_msm")]
    layered = workflows.filter("layered").select("id", F.explode(F.filter(F.array(*need), lambda r: r.isNotNull())).alias("rule"))
    return flat.unionByName(layered)


#: What a repository must hold.
SETUP_DIRS = ("ontology", "evidence", "record-archive", "agent-context", "harness", "docs")
SETUP_HUB = ("version:", "locked:", "domains:", "scan:", "sync:", "structural_ssot: jsonl", "projection_target: md", "auto_apply_md_to_jsonl: false")
SETUP_WORKFLOW = ("version:", "id:", "category:", "kind:", "mode:", "inputs:", "outputs:", "runtime:", "governance:")
SETUP_MEMORY_DIRS, SETUP_MEMORY_FILES = ("agent-context/work-memory/worklog", "harness/trajectory"), ("agent-context/work-memory/index.md", "harness/run.sh")
SETUP_FLAGS = dict(
    zip(("five_layer_directories", "canonical_hub_valid", "workflow_templates_valid", "memory_harness_skeleton_valid", "docs_index_present", "skill_links_valid_or_skipped", "no_unresolved_conflicts"), governance.SETUP_WEIGHTS)
)


def setup_score(tree: DataFrame) -> DataFrame:
    """One row: the seven flags of a repository's ``tree`` (path from its root, is_dir, text) and its weighted score. One aggregate."""
    path, text = F.col("path"), F.coalesce("text", F.lit(""))
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    a_dir, a_file = (lambda p: has(F.col("is_dir") & (path == p))), (lambda p: has(~F.col("is_dir") & (path == p)))
    holds = lambda words: F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    both = lambda parts: functools.reduce(lambda x, y: x & y, parts)
    index, flow = "agent-context/workflow/index.yaml", path.startswith("agent-context/workflow/") & path.endswith(".yaml") & ~F.col("is_dir") & (F.substring_index(path, "/", -1) != "index.yaml")
    asked = path.rlike("^harness/trajectory/run-[^/]*\\.jsonl$") & F.contains(text, F.lit("hitl_request")) & F.contains(text, F.lit("canonical_root_hub_locked_change"))
    open_ = asked & ~F.contains(text, F.lit("apply_partial")) & ~F.contains(text, F.lit("hitl_ack"))
    flags = (
        both([a_dir(d) for d in SETUP_DIRS]), has((path == "canonical_root_hub.yaml") & holds(SETUP_HUB)),
        has((path == index) & holds(("workflows:",))) & F.coalesce(F.bool_and(F.when(flow, holds(SETUP_WORKFLOW))), F.lit(True)),
        both([a_dir(d) for d in SETUP_MEMORY_DIRS] + [a_file(f) for f in SETUP_MEMORY_FILES]), a_file("docs/index.md"), a_dir(".claude/skills"), ~has(open_),
    )
    return governance.weighted_score(tree.agg(*[f.alias(k) for k, f in zip(SETUP_FLAGS, flags)]), SETUP_FLAGS)


def intervention(events: DataFrame, period: Column) -> DataFrame:
    """(period, runs, asked, rate, drift): the share of runs that asked a person, and the findings, in each period."""
    per = events.groupBy(period.alias("period"), "run_id").agg(F.bool_or(F.col("event_type") == "hitl_request").alias("asked"), F.coalesce(F.sum("drift"), F.lit(0)).alias("drift"))
    return per.groupBy("period").agg(F.count("*").alias("runs"), F.count_if("asked").alias("asked"), F.bround(F.count_if("asked") / F.count("*"), 3).alias("rate"), F.sum("drift").alias("drift"))
