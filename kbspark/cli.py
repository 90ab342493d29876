"""Command line over a knowledge-base directory. Every command that changes files is a dry run unless ``--apply``.

    python -m kbspark.cli --root KB evidence collect --source URI... [--sources-file F] [--chunk-size N] [--chunk-overlap N] [--cluster C] [--apply]
    python -m kbspark.cli --root KB evidence verify [--id ID] | list [--format table|json|ids] | readiness [--chunk-size N]
    python -m kbspark.cli --root KB graph lift GRAPH.json [--output-dir D] [--sigma X] [--code-hubs] [--apply]
    python -m kbspark.cli --root KB registry list [--cluster C] [--kind K] | overlap [--jaccard-max X]
    python -m kbspark.cli --root KB reason [--domain D] [--apply]
    python -m kbspark.cli --root KB maintain scan [--kind drift|orphan|eval|alignment|all] | report [--since DAY]
    python -m kbspark.cli --root KB archive query --sql SQL | export --table NAME=PATH... [--apply]
    python -m kbspark.cli --root KB runs summary | gate --run ID | ack --run ID --topic T --by WHO --outcome O [--notes N]
    python -m kbspark.cli --root KB ontology materialise [--apply] | explain --instance ID | what-if --definition FILE
    python -m kbspark.cli --root KB roles list | declare --name N --evidence REF... [--apply] | validate
    python -m kbspark.cli --root KB workflows check | sync [--apply]
    python -m kbspark.cli --root KB setup score

Exit codes: 0 fine, 1 findings or errors (readiness and setup: 1 warning, 2 failure), 2 wrong use; the gate: 100 a person is asked, 101 no measurement.
"""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark import model
from kbspark.functions.scalars import iri_local as _local
from kbspark.operators import alignment, archive, compile as comp, dispatch, evidence, governance, labels, lifting, maintain, materialise as mat, reasoning, registry
from kbspark.operators.reasoning import Rules
from kbspark.sinks import notes
from kbspark.sources import files, python_sources, yaml_files


@dataclass
class Layout:
    """Where the tables of a knowledge base are, below its root."""

    root: str
    seeds: str = "evidence/seeds.jsonl"
    evidence_md: str = "evidence/md"
    registry: str = "ontology/explain"
    turtle: str = "ontology/owl"
    inferred: str = "ontology/Abox/_inferred"
    concepts: str = "ontology/explain/concept"
    runs: str = "agent-context/memory/events"
    snapshots: str = "record-archive/snapshots"
    definitions: str = "ontology/definition"
    roles: str = "ontology/Rbox/roles"
    declared: str = "ontology/Rbox/roles.jsonl"
    instances: str = "ontology/Abox"
    workflows: str = "agent-context/workflow"
    audit: str = "agent-context/work-memory/auditlog"

    def path(self, name: str) -> str:
        return os.path.join(self.root, getattr(self, name))


def session() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found:
        return found
    made = SparkSession.builder.appName("kbspark").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def seeds_of(spark: SparkSession, at: Layout) -> DataFrame:
    path = at.path("seeds")
    parts = files.read_jsonl(spark, path, model.SEEDS)
    return parts.filter("id is not null")


def records(spark: SparkSession, at: Layout, kind: str) -> DataFrame:
    schema = {"entities": model.ENTITIES, "relations": model.RELATIONS, "instances": model.INSTANCES}[kind]
    pattern = f"{at.path('registry')}/*/{kind}.jsonl"
    if not glob.glob(pattern):
        return spark.createDataFrame([], f"{schema}, dir_cluster string, seq bigint")
    rows, _ = files.read_jsonl_numbered(spark, pattern, schema)
    return rows.withColumn("dir_cluster", F.element_at(F.split("file", "/"), -2)).withColumn("seq", F.col("line_no").cast("bigint")).drop("file", "line_no")


def note_files(spark: SparkSession, at: Layout, place: str) -> DataFrame:
    top = at.path(place)
    if not glob.glob(f"{top}/**/*.md", recursive=True):
        return spark.createDataFrame([], "path string, cluster string")
    found = files.read_directory(spark, top, "*.md").select(F.expr(f"substring(path, {len(os.path.abspath(at.root)) + 2})").alias("path"))
    return found.withColumn("cluster", F.element_at(F.split("path", "/"), -2))


def collect(spark: SparkSession, at: Layout, a) -> int:
    uris = list(a.source or [])
    if a.sources_file:
        uris += [r.uri for r in files.read_sources_list(spark, a.sources_file).orderBy("ordinal").collect()]
    if not uris:
        print("no source given", file=sys.stderr)
        return 2
    python_sources.register_all(spark)
    fetched = spark.read.format("kb_fetch").option("uris", "\n".join(uris)).option("attempts", str(max(1, a.max_retry))).load().cache()
    pages = fetched.filter("error is null").select("ordinal", "uri", "content_type", F.decode("content", "UTF-8").alias("body"))
    now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    out = evidence.collect(pages, seeds_of(spark, at), now, a.chunk_size, a.chunk_overlap).withColumn("cluster_hint", F.lit(a.cluster).cast("string")).cache()
    total = out.agg(F.count_if(F.col("kept")).alias("added"), F.count_if(~F.col("kept")).alias("skipped")).first()
    failed = fetched.filter("error is not null").count()
    if a.apply:
        added = out.filter("kept")
        path = at.path("seeds")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "a", encoding="utf-8") as f:
            for row in added.drop("text", "kept", "arrival").toJSON().toLocalIterator():
                f.write(row + "\n")
        notes.write_notes(notes.seed_notes(added), at.root, apply=True)
    print(json.dumps({"added": total.added, "skipped": total.skipped, "errors": failed, "applied": a.apply}))
    return 1 if failed else 0


def verify(spark: SparkSession, at: Layout, a) -> int:
    seeds = files.read_jsonl(spark, at.path("seeds"), model.SEEDS, "FAILFAST")
    seeds = seeds.filter(F.col("id") == a.id) if a.id else seeds
    bad = evidence.seed_violations(seeds).filter("rule not like 'missing:title%'").collect()
    lost = evidence.missing_notes(seeds, note_files(spark, at, "evidence_md")).select("id").collect()
    for r in bad:
        print(f"{r.id}: {r.rule}")
    for r in lost:
        print(f"{r.id}: note missing")
    return 1 if bad or lost else 0


def show(df: DataFrame, form: str = "json") -> None:
    for row in (df.toJSON() if form == "json" else df.select(F.col(df.columns[0]).cast("string").alias("v")).rdd.map(lambda r: r.v)).toLocalIterator():
        print(row)


def listing(spark: SparkSession, at: Layout, a) -> int:
    seeds = seeds_of(spark, at).orderBy("id")
    show(notes.seed_table(seeds) if a.format == "table" else seeds.select("id") if a.format == "ids" else seeds, "json" if a.format == "json" else "plain")
    return 0


def score(spark: SparkSession, at: Layout, a) -> int:
    row = evidence.readiness(seeds_of(spark, at), note_files(spark, at, "evidence_md"), a.chunk_size).first()
    status = model.score_status(row.score)
    print(json.dumps(row.asDict() | {"status": status}))
    return {"pass": 0, "warn": 1, "fail": 2}[status]


def lift(spark: SparkSession, at: Layout, a) -> int:
    nodes, edges = files.read_graph(spark, a.graph)
    ents, rels = lifting.lift_graph(nodes, edges, a.sigma, a.code_hubs)
    if a.apply:
        notes.overwrite_jsonl(ents, f"{a.output_dir}/entity_candidates")
        notes.overwrite_jsonl(rels, f"{a.output_dir}/relation_candidates")
    print(json.dumps({"entities": ents.count(), "relations": rels.count(), "applied": a.apply}))
    return 0


def registry_list(spark: SparkSession, at: Layout, a) -> int:
    show(registry.list_all(*[records(spark, at, k) for k in ("entities", "relations", "instances")], a.cluster, a.kind))
    return 0


def overlap(spark: SparkSession, at: Layout, a) -> int:
    ents = records(spark, at, "entities").withColumn("cluster", F.col("dir_cluster"))
    found = registry.overlap_report(ents, records(spark, at, "relations"), note_files(spark, at, "registry"), a.jaccard_max).cache()
    show(found)
    return 1 if found.filter("kind <> 'missing_md'").count() else 0


def reason(spark: SparkSession, at: Layout, a) -> int:
    pattern = f"{at.path('turtle')}/{a.domain or '*'}*.ttl"
    if not glob.glob(pattern):
        print("no Turtle files", file=sys.stderr)
        return 1
    triples = comp.with_lists(python_sources.read_turtle(spark, pattern).drop("src").distinct()).cache()
    typed = triples.filter(F.col("p") == comp.RDF + "type")
    individuals = typed.filter(F.col("o") == comp.OWL + "NamedIndividual").select(F.col("s").alias("iri"))
    properties = typed.filter(F.col("o") == comp.OWL + "ObjectProperty").select(F.col("s").alias("iri"))
    types = typed.join(individuals.withColumnRenamed("iri", "s"), "s", "left_semi").filter(F.col("o") != comp.OWL + "NamedIndividual").select(F.col("s").alias("x"), F.col("o").alias("c"))
    gained = reasoning.reason(types, reasoning.individual_facts(triples, individuals, properties), comp.rules_of(triples))
    out = reasoning.delta_records(types, *gained).cache()
    show(out)
    if a.apply:
        notes.overwrite_jsonl(out, at.path("inferred"))
    return 0


def scan(spark: SparkSession, at: Layout, a) -> int:
    ents, seeds = records(spark, at, "entities"), seeds_of(spark, at)
    if a.check:
        own = ents.withColumn("cluster", F.col("dir_cluster"))
        found = labels.length_findings(own) if a.check == "length" else labels.redundancy_findings(own)
        show(found.orderBy("cluster", "kind", "id"))
        return 0
    md = note_files(spark, at, "registry")
    if a.kind in ("drift", "all"):
        show(maintain.sorted_findings(maintain.drift(ents, md, seeds)))
    if a.kind in ("orphan", "all"):
        own = ents.withColumn("cluster", F.col("dir_cluster"))
        show(maintain.sorted_findings(maintain.orphan_findings(own, records(spark, at, "relations"), md, note_files(spark, at, "evidence_md").select("path"), seeds)))
    if a.kind in ("eval", "all"):
        by = lambda k: records(spark, at, k).withColumn("cluster", F.col("dir_cluster"))
        show(maintain.cluster_eval(by("entities"), by("relations"), by("instances")).orderBy("cluster"))
    if a.kind == "alignment":
        top = at.path("concepts")
        tree = files.read_notes(spark, top, os.path.abspath(top)).select("dir", "name", "stem", "body", "fm.level", "fm.entity", F.transform("fm.relations", lambda r: F.struct(r["type"].alias("type"), r["target"].alias("target"))).alias("relations"))
        show(alignment.scan(tree).orderBy("rule", "file"))
    return 0


def report(spark: SparkSession, at: Layout, a) -> int:
    show(maintain.scan_totals(files.read_trajectory(spark, at.path("runs")), a.since))
    return 0


def query(spark: SparkSession, at: Layout, a) -> int:
    print(archive.json_array(archive.query_snapshots(spark, at.path("snapshots"), a.sql)))
    return 0


def export(spark: SparkSession, at: Layout, a) -> int:
    tables = {name: spark.read.json(path) for name, _, path in (t.partition("=") for t in a.table)}
    stamp = time.strftime("%Y%m%d_%H%M%S", time.gmtime())
    print(json.dumps(archive.export_snapshot(tables, at.path("snapshots"), stamp) if a.apply else sorted(tables)))
    return 0


def run_summary(spark: SparkSession, at: Layout, a) -> int:
    events = files.read_trajectory(spark, at.path("runs")).cache()
    gaps = governance.step_gaps(events).groupBy("run_id").agg(F.count("*").alias("open_steps"))
    out = governance.run_rollup(events).join(governance.hitl_counts(events), "run_id").join(gaps, "run_id", "left")
    show(out.select("run_id", F.col("run_started.workflow_id").alias("workflow_id"), F.col("run_finished.exit_code").alias("exit_code"), F.col("governance_measurement.oracle_score").alias("oracle_score"), "requested", "acked", F.coalesce("open_steps", F.lit(0)).alias("open_steps")).orderBy("run_id"))
    return 0


def gate(spark: SparkSession, at: Layout, a) -> int:
    return dispatch.gate_run(spark, dispatch.RunLog(at.path("runs"), a.run_id))


def ack(spark: SparkSession, at: Layout, a) -> int:
    print(dispatch.acknowledge(at.path("audit"), dispatch.RunLog(at.path("runs"), a.run_id), a.topic, a.by, a.outcome, a.notes))
    return 0


def compiled(spark: SparkSession, at: Layout, definitions: dict | None = None) -> tuple[DataFrame, Rules]:
    """All that the ontology's YAML sources say; ``definitions`` replaces documents by domain."""
    docs = yaml_files.read_yaml(spark, f"{at.path('definitions')}/*.yaml") | (definitions or {})
    return mat.compiled(spark, docs, yaml_files.read_yaml(spark, f"{at.path('roles')}/*.yaml"), yaml_files.read_instances(spark, f"{at.path('instances')}/*.yaml"))


def materialised(spark: SparkSession, at: Layout) -> mat.Materialised:
    return mat.reasoned(*compiled(spark, at))


def materialise(spark: SparkSession, at: Layout, a) -> int:
    m = materialised(spark, at)
    show(m.records.orderBy("x"))
    if a.apply:
        comp.turtle_lines(m.triples).write.mode("overwrite").text(f"{at.path('turtle')}/materialised.ttl")
        notes.overwrite_jsonl(m.records, at.path("inferred"))
    return 0


def explain(spark: SparkSession, at: Layout, a) -> int:
    own = records(spark, at, "instances").drop("dir_cluster", "seq")
    named = (F.col("id") == a.instance) | F.col("id").endswith("/" + a.instance) | F.col("id").endswith("#" + a.instance)
    sources = compiled(spark, at)
    rows = mat.explain(own, mat.reasoned(*sources).records).filter(named).collect()
    for r in rows:
        print(mat.rendered_explanation(r))
    if rows:
        for r in mat.why(mat.derived(*sources), spark.createDataFrame([(r["id"],) for r in rows], "id string")).orderBy("id", "goal", "depth", "fact").collect():
            print(f"{'  ' * (r.depth + 1)}{r.fact} [{r.rule}{': ' + r.because if r.because else ''}]")
    return 0 if rows else 1


def what_if(spark: SparkSession, at: Layout, a) -> int:
    show(mat.what_if(compiled(spark, at), compiled(spark, at, yaml_files.read_yaml(spark, a.definition))).orderBy("x", "fact"))
    return 0


_ROLE = "name string, status string, aliases array<string>, source_refs array<string>"


def roles_of(spark: SparkSession, at: Layout) -> DataFrame:
    """Declared roles, and those of the role files."""
    rows = [(str(n), "accepted", [str(x) for x in (s or {}).get("aliases") or []], []) for doc in yaml_files.read_yaml(spark, f"{at.path('roles')}/*.yaml").values() for n, s in (doc.get("slots") or {}).items()]
    return spark.createDataFrame(rows, _ROLE).unionByName(files.read_jsonl(spark, at.path("declared"), _ROLE))


def role_list(spark: SparkSession, at: Layout, a) -> int:
    axioms = materialised(spark, at).triples.filter(F.col("p").isin(comp.RDFS + "subPropertyOf", comp.OWL + "inverseOf", comp.OWL + "propertyChainAxiom") | F.col("o").startswith(comp.OWL + "Transitive") | F.col("o").startswith(comp.OWL + "Symmetric"))
    show(mat.list_roles(roles_of(spark, at), axioms.select(_local(F.col("s")).alias("role"))).orderBy("name"))
    return 0


def role_declare(spark: SparkSession, at: Layout, a) -> int:
    new = spark.createDataFrame([(a.name, "draft", [], a.evidence or [])], _ROLE)
    row = mat.declare_roles(roles_of(spark, at), new).first()
    print(json.dumps({"name": a.name, "rejected": row.rejected, "applied": bool(a.apply and not row.rejected)}))
    if a.apply and not row.rejected:
        notes.append_jsonl(new, at.path("declared"))
    return 1 if row.rejected else 0


def role_validate(spark: SparkSession, at: Layout, a) -> int:
    m = materialised(spark, at)
    typed = m.triples.filter((F.col("p") == comp.RDF + "type") & (F.col("o") == comp.OWL + "NamedIndividual")).select(F.col("s").alias("iri"))
    used = m.triples.join(typed.withColumnRenamed("iri", "s"), "s", "left_semi").filter((F.col("o_kind") == "iri") & (F.col("p") != comp.RDF + "type"))
    found = mat.role_gate(used.select(F.col("s").alias("x"), _local(F.col("p")).alias("p"), F.col("o").alias("y")), roles_of(spark, at)).cache()
    show(found)
    return 0 if found.isEmpty() else 1


def flows_of(spark: SparkSession, at: Layout) -> DataFrame:
    return yaml_files.read_workflows(spark, f"{at.path('workflows')}/*/*.yaml")


def flow_check(spark: SparkSession, at: Layout, a) -> int:
    flows = flows_of(spark, at).cache()
    top = at.path("workflows")
    there = files.read_directory(spark, top, "*.yaml").select(F.expr(f"substring(path, {len(os.path.abspath(top)) + 2})").alias("path"))
    index = yaml_files.read_index(spark, f"{top}/index.yaml")
    found = mat.layered_violations(flows).select("id", "rule").unionByName(governance.repeated_ids(flows, "id", "file").select("id", F.lit("repeated_id").alias("rule")).distinct())
    found = found.unionByName(governance.missing_paths(index, there).select("id", F.lit("missing_path").alias("rule"))).cache()
    show(found.orderBy("id", "rule"))
    return 0 if found.isEmpty() else 1


def flow_sync(spark: SparkSession, at: Layout, a) -> int:
    triples, path = mat.workflow_triples(flows_of(spark, at)), f"{at.path('workflows')}/workflows.ttl"
    if a.apply:
        comp.turtle_lines(triples).write.mode("overwrite").text(path)
        return 0
    written = python_sources.read_turtle(spark, f"{path}/part-*") if glob.glob(f"{path}/part-*") else triples.filter("false")
    diff = mat.out_of_sync(triples, written).cache()
    show(diff)
    return 0 if diff.isEmpty() else 1


def setup(spark: SparkSession, at: Layout, a) -> int:
    # A repository's own skeleton: walked here, as many entries as a person keeps.
    rows = []
    for here, dirs, names in os.walk(at.root):
        rel = os.path.relpath(here, at.root)
        rows += [(os.path.normpath(os.path.join(rel, d)), True, None) for d in dirs]
        for n in names:
            path = os.path.normpath(os.path.join(rel, n))
            keep = n.endswith(".yaml") or path.startswith("harness/trajectory/")
            rows.append((path, False, open(os.path.join(here, n), encoding="utf-8", errors="replace").read() if keep else None))
    row = mat.setup_score(spark.createDataFrame(rows, "path string, is_dir boolean, text string")).first()
    status = model.score_status(row.score)
    print(json.dumps(row.asDict() | {"status": status}))
    return {"pass": 0, "warn": 1, "fail": 2}[status]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kbspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--root", default=".")
    areas = p.add_subparsers(dest="area", required=True)
    groups: dict[str, argparse._SubParsersAction] = {}

    def command(area: str, name: str, run, *options) -> None:
        if name:
            if area not in groups:
                groups[area] = areas.add_parser(area).add_subparsers(dest="command", required=True)
            own = groups[area].add_parser(name)
        else:
            own = areas.add_parser(area)
        own.set_defaults(run=run)
        for flags, kw in options:
            own.add_argument(*flags, **kw)

    o = lambda *flags, **kw: (flags, kw)
    apply = o("--apply", action="store_true")
    command("evidence", "collect", collect, o("--source", nargs="+"), o("--sources-file"), o("--chunk-size", type=int, default=1200), o("--chunk-overlap", type=int, default=100), o("--cluster"), o("--max-retry", type=int, default=1), apply)
    command("evidence", "verify", verify, o("--id"))
    command("evidence", "list", listing, o("--format", choices=("table", "json", "ids"), default="table"))
    command("evidence", "readiness", score, o("--chunk-size", type=int, default=1200))
    command("graph", "lift", lift, o("graph"), o("--output-dir", default="etl-out"), o("--sigma", type=float, default=2.0), o("--code-hubs", action="store_true"), apply)
    command("registry", "list", registry_list, o("--cluster"), o("--kind", choices=("entity", "relation", "instance")))
    command("registry", "overlap", overlap, o("--jaccard-max", type=float, default=0.7))
    command("reason", "", reason, o("--domain"), apply)
    command("maintain", "scan", scan, o("--kind", choices=("drift", "orphan", "eval", "alignment", "all"), default="all"), o("--check", choices=("length", "redundancy")))
    command("maintain", "report", report, o("--since"))
    command("archive", "query", query, o("--sql", required=True))
    command("archive", "export", export, o("--table", nargs="+", required=True), apply)
    command("runs", "summary", run_summary)
    run = o("--run", dest="run_id", required=True)
    command("runs", "gate", gate, run)
    command("runs", "ack", ack, run, o("--topic", required=True), o("--by", required=True), o("--outcome", required=True), o("--notes", default=""))
    command("ontology", "materialise", materialise, apply)
    command("ontology", "explain", explain, o("--instance", required=True))
    command("ontology", "what-if", what_if, o("--definition", required=True))
    command("roles", "list", role_list)
    command("roles", "declare", role_declare, o("--name", required=True), o("--evidence", nargs="*"), apply)
    command("roles", "validate", role_validate)
    command("workflows", "check", flow_check)
    command("workflows", "sync", flow_sync, apply)
    command("setup", "score", setup)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(session(), Layout(os.path.abspath(a.root)), a)


if __name__ == "__main__":
    sys.exit(main())
