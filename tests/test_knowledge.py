"""YAML sources, materialising, what-if, explaining, roles, workflows, dispatch, SQL functions, chunks against plain Python."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from kbspark.functions import sql as fsql
from kbspark.functions.text import chunk_text
from kbspark.operators import archive, compile as comp, dispatch, evidence, governance, materialise, provenance
from kbspark.sinks import notes
from kbspark.sources import files, yaml_files

DEFINITION = """
default_prefix: ex
prefixes: {ex: "https://ex.org/"}
classes:
  Thing: {}
  Part: {is_a: Thing}
  Engine: {is_a: Part}
  Fast:
    is_a: Thing
    classification_rules: [{is_a: Part, slot_conditions: {has_engine: {range: Engine}}}]
"""
ROLES = """
slots:
  has_engine: {domain: Part}
  part_of: {annotations: {owl_characteristic: TransitiveProperty}}
"""
ABOX = """
instances:
  car: {instance_of: Part, has_engine: motor, part_of: fleet, wheels: 4, name: "A b"}
  motor: {instance_of: Engine, part_of: [car]}
  fleet: {}
"""


@pytest.fixture
def base(tmp_path):
    for name, text in (("definition/d.yaml", DEFINITION), ("roles/d.yaml", ROLES), ("abox/d.yaml", ABOX)):
        path = tmp_path / name
        path.parent.mkdir(parents=True)
        path.write_text(text)
    return tmp_path


def sources(spark, base):
    return yaml_files.read_yaml(spark, f"{base}/definition/*.yaml"), yaml_files.read_yaml(spark, f"{base}/roles/*.yaml"), yaml_files.read_instances(spark, f"{base}/abox/*.yaml")


def test_materialise_what_if_and_explain(spark, base):
    definitions, roles, instances = sources(spark, base)
    m = materialise.materialise(spark, definitions, roles, instances)
    short = lambda x: x.removeprefix("https://ex.org/")
    assert {(short(r.x), short(r.c)) for r in m.gained_types.collect()} == {("car", "Thing"), ("motor", "Part"), ("motor", "Thing"), ("car", "Fast")}
    assert {(short(r.x), short(r.p), short(r.y)) for r in m.gained_props.collect()} == {("motor", "part_of", "fleet")}
    slower = json.loads(json.dumps(definitions))
    del slower["d"]["classes"]["Fast"]["classification_rules"]
    changes = materialise.what_if(m, materialise.materialise(spark, slower, roles, instances)).collect()
    assert [(short(r.x), r.fact, r.change) for r in changes] == [("car", "a https://ex.org/Fast", "removed")]
    own = spark.createDataFrame([("https://ex.org/car", "Vehicle"), ("lone", "Thing")], "id string, entity_type string")
    rows = {r.id: r for r in materialise.explain(own, m.records).collect()}
    assert set(rows) == {"https://ex.org/car", "https://ex.org/motor", "lone"}
    assert "+ https://ex.org/Fast" in materialise.rendered_explanation(rows["https://ex.org/car"]) and "[nothing inferred]" in materialise.rendered_explanation(rows["lone"])
    shape = [{"path": "https://ex.org/has_engine", "min": 1}]
    assert [provenance.check_shape(materialise.shape_triples(m, on), "https://ex.org/Part", shape).count() for on in (False, True)] == [0, 1]
    with pytest.raises(ValueError):
        materialise.materialise(spark, {"n": {"classes": {"A": {}}}}, {}, None)


def test_roles(spark):
    roles = spark.createDataFrame([("owns", ["e"])], "name string, source_refs array<string>")
    new = spark.createDataFrame([("owns", ["e"]), ("uses", ["e"]), ("uses", ["e"]), ("has", [])], "name string, source_refs array<string>")
    assert sorted((r.name, r.rejected or "") for r in materialise.declare_roles(roles, new).collect()) == [("has", "evidence_required"), ("owns", "duplicate_role"), ("uses", ""), ("uses", "duplicate_role")]
    axioms = spark.createDataFrame([("owns",)], "role string")
    assert [(r.name, r.state) for r in materialise.list_roles(roles.unionByName(new.filter("name = 'has'")), axioms).orderBy("name").collect()] == [("has", "declared"), ("owns", "axiomatised")]


FLOW = """
module: {id: flow.a, version: "1.0"}
x_msm:
  category: evidence
  kind: pipeline
  mode: dry-run
  governance: {max_retry: 2, hitl_required: true, oracle: o}
  cost_budget: {tokens: 10}
  pipeline:
    - {step_id: one, tool: t1}
    - {tool: t2, action: go}
"""


def test_workflows(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(FLOW)
    (tmp_path / "b.yaml").write_text("id: flat\nkind: single\nmode: nope\nversion: 1\ncategory: c\n")
    (tmp_path / "index.yml").write_text("workflows: [{id: flow.b, path: zz.yaml}, {id: flow.a, path: a.yaml}]\n")
    flows = yaml_files.read_workflows(spark, f"{tmp_path}/*.yaml").cache()
    a = flows.filter("id = 'flow.a'").first()
    assert (a.kind, a.max_retry, a.tokens_max, [s.tool for s in a.pipeline], a.layered) == ("pipeline", 2, 10.0, ["t1", "t2"], True)
    assert sorted((r.id, r.rule) for r in materialise.layered_violations(flows).collect()) == [("flat", "enum:mode"), ("flat", "single_needs_tool")]
    triples = materialise.workflow_triples(flows)
    path = str(tmp_path / "ttl")
    comp.turtle_lines(triples).coalesce(1).write.text(path)
    from kbspark.sources import python_sources

    back = python_sources.read_turtle(spark, f"{path}/*.txt").drop("src")
    assert materialise.out_of_sync(triples, back).isEmpty()
    assert {r.side for r in materialise.out_of_sync(triples, back.filter("o <> 'go'")).collect()} == {"missing"}
    index = yaml_files.read_index(spark, f"{tmp_path}/*.yml")
    assert [r.id for r in index.collect()] == ["flow.a", "flow.b"]
    files = spark.createDataFrame([("a.yaml",)], "path string")
    hub, pack = spark.createDataFrame([("x: 1",)], "text string"), spark.createDataFrame([(f"s{i}",) for i in range(8)], "skill string")
    found = materialise.contract_check(flows, index, files, hub, pack, "v1", "odd", "v1")
    assert sorted(r.contract for r in found.collect()) == ["canonical_root_hub_locked", "pack_config_migration_mode", "workflow_path"]


def test_runs(spark, tmp_path):
    log = dispatch.RunLog(str(tmp_path / "events"), "r1", {"skill": "s", "mode": "apply"})
    flow = {"id": "w", "kind": "pipeline", "max_retry": 3, "oracle": "o", "pipeline": [{"step_id": "a", "tool": "ok"}, {"step_id": "b", "tool": "flaky"}, {"step_id": None, "tool": "gone"}]}
    runs, tools = spark.createDataFrame([("r1", "w"), ("r0", "w"), ("r3", "none")], "run_id string, workflow_id string"), spark.createDataFrame([("ok",), ("flaky",), ("bad",)], "tool string")
    flows = spark.createDataFrame([(flow["id"], flow["kind"], None, flow["pipeline"], 3)], "id string, kind string, tool string, pipeline array<struct<step_id:string,tool:string>>, max_retry int")

    def asked(runs=runs, flows=flows, tools=tools):
        return {r.run_id: (r.step_id, r.action, r.attempt, r.reason) for r in governance.next_steps(runs, flows, files.read_trajectory(spark, log.directory), tools).collect()}

    def step(log, name, attempt, code=None):
        log.emit({"event_type": "step_started", "step_id": name, "attempt": attempt})
        if code is not None:
            log.emit({"event_type": "step_finished", "step_id": name, "attempt": attempt, "exit_code": code})

    step(log, "a", 1)
    assert asked() == {"r0": ("a", "start", 1, None), "r1": ("a", "wait", 1, None)}
    log.emit({"event_type": "step_finished", "step_id": "a", "attempt": 1, "exit_code": 0})
    assert asked()["r1"] == ("b", "start", 1, None)
    step(log, "b", 1, 75)
    step(log, "b", 2, 75)
    assert asked()["r1"] == ("b", "retry", 3, None)
    step(log, "b", 3, 0)
    assert asked()["r1"] == (None, "finish", None, None) and asked(tools=None)["r1"] == ("gone", "start", 1, None)
    assert dispatch.gate_run(spark, log) == dispatch.ABORTED
    summary = dispatch.finish_run(spark, log, flow, 0, 1.5, oracles=({"o": lambda spark, w: 0.9},), work_log=str(tmp_path / "log"))
    assert summary["trajectory_complete"] and summary["oracle_score"] == 0.9 and "oracle_score: 0.9" in (tmp_path / "log" / "r1.md").read_text()
    assert dispatch.gate_run(spark, log) == 0
    assert dispatch.gate_run(spark, log, {"min_score": 0.95}) == dispatch.ESCALATED
    dispatch.acknowledge(str(tmp_path / "audit"), log, "oracle", "p", "approved")
    events = [json.loads(x) for x in open(log.path)]
    assert [e["axis"] for e in events if e["event_type"] == "hitl_request"] == ["oracle"] and events[-1]["event_type"] == "hitl_ack" and all(e["skill"] == "s" for e in events)
    assert [e["attempt"] for e in events if e.get("step_id") == "b" and e["event_type"] == "step_finished"] == [1, 2, 3]
    other = dispatch.RunLog(str(tmp_path / "events"), "r2")
    one = spark.createDataFrame([("s", "single", "bad", None, None), ("t", "single", None, None, 2), ("u", "pipeline", None, [], 1)], flows.schema)
    pairs = lambda *p: spark.createDataFrame(p, "run_id string, workflow_id string")
    step(other, "step", 1, 64)
    assert asked(pairs(("r2", "s"), ("r4", "t"), ("r5", "u")), one) == {"r2": ("step", "retry", 2, None), "r4": ("step", "abort", None, "missing_tool_field"), "r5": (None, "finish", None, None)}
    step(other, "step", 2, 64)
    assert asked(pairs(("r2", "s")), one)["r2"] == ("step", "ask", 2, "retry_budget_exhausted")
    other.emit({"event_type": "hitl_request", "reason": "retry_budget_exhausted", "step_id": "step"})
    assert asked(pairs(("r2", "s")), one)["r2"] == ("step", "waiting", 2, None)
    step(other, "step", 3, 1)
    assert asked(pairs(("r2", "s")), one)["r2"] == ("step", "stop", 3, "exit code 1")
    triggers = [{"id": "collect", "phrases": ["collect", "harvest"], "legacy": ["harvest"]}]
    assert dispatch.dispatch(spark, "nothing", triggers, other, lambda r: 0) == 1
    assert [dispatch.dispatch(spark, "harvest it", triggers, other, lambda r: 0, strict) for strict in (False, True)] == [0, dispatch.REFUSED]
    with dispatch.hub_lock(str(tmp_path / "lock")), pytest.raises(RuntimeError), dispatch.hub_lock(str(tmp_path / "lock")):
        pass
    plan = spark.createDataFrame([("n/a.md", "a", "create_md_placeholder"), ("n/b.md", "b", "human_review")], "path string, id string, action string")
    assert dispatch.rewrite(plan, str(tmp_path)) == ["n/a.md"] == dispatch.rewrite(plan, str(tmp_path), True) and dispatch.rewrite(plan, str(tmp_path)) == []


def test_sql_functions(spark):
    names = fsql.register(spark)
    assert "kb_chunks" in names
    row = spark.sql("select kb_strip('  a ') a, kb_snake('A b-C') b, kb_content_hash('x') c, kb_round(0.0005D) d, kb_html('<title>T</title><p>x</p>').title e, kb_frontmatter('---\\nlevel: 2\\n---\\n').level f").first()
    assert (row.a, row.b, row.d, row.e, row.f) == ("a", "a_b_c", 0.0, "T", "2") and row.c.startswith("sha256:")
    got = spark.sql("select chunk_index, chunk from (select 'a b. c' t) s, lateral kb_chunks(s.t, 1200, 100)").collect()
    assert [tuple(r) for r in got] == [(0, "a b. c")]


def test_chunks_equal_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = ["", None, "x" * 5000, "a. " * 2000, "p\n\n\nq\n\n" * 50, "One? Two! " * 400 + "\n\n" + "z" * 3000, ("s" * 1300 + ". ") * 5, "  \n\n "]
    rows = docs.unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    for size, overlap in ((1200, 100), (300, 0), (500, 50)):
        for r in rows.select("text", chunk_text(F.col("text"), size, overlap).alias("c")).collect():
            assert r.c == fsql.chunks_of(r.text, size, overlap)


def test_first_of_equal_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), (None, 2), ("b", 3)], "k string, o int")
    assert sorted((r.k or "", r.kept) for r in evidence.mark_first(rows, "k", "o").collect()) == [("", False), ("", True), ("a", False), ("a", True), ("b", True)]


def test_migration_scripts(spark, tmp_path):
    assert archive.statements("a; 'x;y' -- c;d\n b; /* e; */ c") == ["a", "'x;y' \n b", "c"]
    path = tmp_path / "notes"
    made = notes.write_notes(spark.createDataFrame([("a/b.md", "t")], "path string, text string"), str(path), apply=True)
    assert made == 1 and (path / "a" / "b.md").read_text() == "t"
