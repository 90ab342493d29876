"""The core library: scalar rules by hand, fixtures with known findings, invariants."""

from __future__ import annotations

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from kbspark import model
from kbspark.functions import scalars as S
from kbspark.functions.text import chunk_text, windows
from kbspark.operators import archive, compile as comp, evidence, governance, graph, lifting, maintain, provenance, reasoning, registry
from kbspark.operators.reasoning import Rules
from kbspark.sinks import notes
from kbspark.sources import files, python_sources


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (S.uri_slug, "https://Ex.org:80/A/b c?q#f", "ex_org_a_b_c"), (S.uri_slug, "/tmp/My File.md", "my_file"), (S.uri_slug, "http://", "source"),
        (S.uri_kind, "FILE:///x", "url"), (S.uri_kind, "x/y.md", "md"), (S.graph_slug, "A--b_C!", "a__b_c"), (S.registry_snake, "Ünï x", "n_x"), (S.registry_snake, "한글", "unknown"),
        (S.role_snake, " Has Part-of! ", "has_part_of"), (S.iri_local, "http://a/b#c", "c"), (S.iri_namespace, "http://a/b#c", "http://a/b#"), (S.symbol_type, "MyStore", "DataStore"),
        (S.strip_frontmatter, "---\na: 1\n---\nbody", "body"), (S.wikilink_id, "see [[a b|c]] [[d]]", "a b"), (S.strip, "\n\t x  ", "x"),
        (S.content_hash, "", "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"), (S.literal_kind, "abc.d-e", "iri"), (S.literal_kind, "-1.5", "literal"), (S.literal_kind, "a b", "literal"),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, f(F.lit(value))) == want


def test_more_scalars(spark):
    assert S.glob_regex("a/**/b*.md") == r"^a/.*/b[^/]*\.md$"
    assert one(spark, S.confidence(F.parse_json(F.lit("0.9")))) == 0.9 and one(spark, S.confidence(F.parse_json(F.lit('"0.9"')))) == 0.7
    assert one(spark, S.generated_block(F.lit("a<s>x<e>b"), "<s>", "<e>")) == "x"
    assert one(spark, S.power_estimate(F.lit("mistral:7b"), F.lit(1000), F.lit("full"))) == 0.15
    assert one(spark, S.since(F.lit("soon"), "2024-01-01")) and not one(spark, S.since(F.lit("2023-12-31T"), "2024-01-01"))
    assert S.parse_html("<title>T</title><nav>n</nav><p>a &amp; b</p><script>x</script><p>c</p>") == ("T", "Ta & b\nc")
    row = spark.createDataFrame([("i", "ü", ["b", "a"])], "id string, label string, synonyms array<string>").select(S.canonical_hash(F.struct("id", "label", "synonyms")).alias("h")).first().h
    import hashlib

    assert row == hashlib.sha256('{"id": "i", "label": "ü", "synonyms": ["b", "a"]}'.encode()).hexdigest()


@pytest.mark.parametrize(("n", "want"), [(9, 1), (10, 1), (11, 2), (17, 2), (18, 3)])
def test_window_counts(spark, n, want):
    assert len(one(spark, windows(F.lit("x" * n), 10, 3))) == want


def plain_chunks(text, size, overlap, least):
    import re

    out = []
    for p in [p.strip() for p in re.split(r"\n\n+", text.strip()) if p.strip()]:
        parts = [s.strip() for s in re.split(r"(?<=[.?!])\s+", p) if s.strip()]
        if len(p) <= size:
            out.append([p])
        elif len(parts) > 1:
            packed = [parts[0]]
            for s in parts[1:]:
                packed[-1:] = [packed[-1] + " " + s] if len(packed[-1]) + 1 + len(s) <= size else [packed[-1], s]
            out.append(packed)
        else:
            step, cut, at = max(1, size - overlap), [], 0
            while True:
                cut.append(p[at : at + size])
                if at + size >= len(p):
                    break
                at += step
            out.append(cut)
    merged = []
    for piece in [x for xs in out for x in xs]:
        if merged and len(merged[-1]) < least:
            merged[-1] += " " + piece
        else:
            merged.append(piece)
    return [p + (" " + merged[i + 1][:overlap] if i + 1 < len(merged) else "") for i, p in enumerate(merged)]


def test_chunker_equals_plain_python(spark):
    import random

    r = random.Random(3)
    texts = ["", "  ", "x" * 200] + ["".join(r.choice(["word ", "Ende. ", "was? ", "\n\n", "y" * 30, "\n"]) for _ in range(r.randrange(1, 60))) for _ in range(120)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunk_text(F.col("t"), 60, 10, 20).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [plain_chunks(t, 60, 10, 20) for t in texts]


def test_readers(spark, tmp_path):
    (tmp_path / "seeds.jsonl").write_text('{"id": "evidence:seed:a", "uri": "u"}\n\n{bad\n{"id": "b"}\n')
    path = str(tmp_path / "seeds.jsonl")
    assert files.read_jsonl(spark, path, model.SEEDS).filter("id is not null").count() == 2
    assert files.read_jsonl(spark, str(tmp_path / "none*.jsonl"), model.SEEDS).count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, path, model.SEEDS, "FAILFAST").collect()
    rows, bad = files.read_jsonl_numbered(spark, path, model.SEEDS)
    assert [r.line_no for r in rows.orderBy("line_no").collect()] == [1, 4] and [r.failure for r in bad.collect()] == ["line 3: invalid JSON"]
    (tmp_path / "list.txt").write_text("# c\n\n http://a \nb.md\n")
    assert [r.uri for r in files.read_sources_list(spark, str(tmp_path / "list.txt")).orderBy("ordinal").collect()] == ["http://a", "b.md"]
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "file_type": "concept"}], "links": [{"from": "a", "to": "b", "confidence": "0.9"}, {"source": "a", "target": "a", "confidence": 1}]}))
    nodes, edges = files.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 1 and {(r.src, r.dst, r.confidence) for r in edges.collect()} == {("a", "b", 0.7), ("a", "a", 1.0)}
    (tmp_path / "kb" / "x").mkdir(parents=True)
    (tmp_path / "kb" / "x" / "concept__a.md").write_text("<!-- gen -->\n---\nlevel: L1\nrelations:\n  - type: belongs_to\n    target: '[[x__class]]'\n---\nbody")
    note = files.read_notes(spark, str(tmp_path / "kb"), str(tmp_path / "kb")).first()
    assert (note.dir, note.name, note.fm.level, note.fm.relations[0].type) == ("x", "concept__a.md", "L1", "belongs_to")
    assert files.read_directory(spark, str(tmp_path / "kb"), "*.md").count() == 1


def test_trajectory_and_snapshots(spark, tmp_path):
    (tmp_path / "run-1.jsonl").write_text('{"run_id": "1", "event_type": "run_started"}\n{"run_id": "1", "event_type": "run_finished"}\n')
    (tmp_path / "run-1.orchestration.jsonl").write_text('{"run_id": "1", "event_type": "gate"}\n')
    assert [r.seq for r in files.read_trajectory(spark, str(tmp_path)).orderBy("seq").collect()] == [1, 2]
    assert files.read_trajectory(spark, str(tmp_path), mirrors=True).count() == 3
    t = spark.createDataFrame([(1, "a")], "id int, name string")
    archive.export_snapshot({"t": t}, str(tmp_path / "s"), "20240101_000000")
    archive.export_snapshot({"t": t.unionAll(t)}, str(tmp_path / "s"), "20250101_000000")
    assert files.latest_snapshot(spark, str(tmp_path / "s")).count() == 2
    assert json.loads(archive.json_array(archive.query_snapshots(spark, str(tmp_path / "s"), "select count(*) as n from snap_20240101_000000_t"))) == [{"n": 1}]


def test_python_sources(spark, tmp_path):
    python_sources.register_all(spark)
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("create table market_signal (signal_id text primary key, value real not null, source text)")
        db.executemany("insert into market_signal values (?, ?, ?)", [(str(i), i / 2, None) for i in range(10)])
    got = spark.read.format("kb_sqlite").option("path", str(tmp_path / "a.db")).option("table", "market_signal").load()
    assert got.agg(F.sum("value")).first()[0] == 22.5 and python_sources.sqlite_tables(str(tmp_path / "a.db")) == ["market_signal"]
    (tmp_path / "p.html").write_text("<p>x</p>")
    rows = spark.read.format("kb_fetch").option("uris", f"{tmp_path}/p.html\n{tmp_path}/none.md").load().orderBy("ordinal").collect()
    assert bytes(rows[0].content) == b"<p>x</p>" and rows[0].content_type == "text/html" and rows[1].error


TURTLE = """@prefix ex: <http://e/> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
# comment
ex:a a ex:C ; ex:p ex:b, "x\\"y"@ko ; ex:n 1, 2.5, true . ex:l ex:list ( ex:r ex:s ) . [] ex:q _:z .
"""


def test_turtle(spark, tmp_path):
    (tmp_path / "t.ttl").write_text(TURTLE)
    rows = python_sources.read_turtle(spark, str(tmp_path / "*.ttl"))
    got = {(r.p.rpartition("/")[2], r.o, r.o_lang) for r in rows.collect()}
    assert ("p", 'x"y', "ko") in got and ("n", "2.5", None) in got
    lists = comp.with_lists(rows.drop("src"))
    assert lists.filter("o_kind = 'list'").first().o == "http://e/r http://e/s"
    again = python_sources.parse_turtle("\n".join(r.line for r in comp.turtle_lines(rows.drop("src")).collect()))
    assert len(again) == rows.count()
    with pytest.raises(ValueError):
        python_sources.parse_turtle("ex:a ex:b .")


def test_hubs(spark):
    nodes = spark.createDataFrame([(str(i),) for i in range(12)], "id string")
    edges = spark.createDataFrame([("0", str(i)) for i in range(1, 12)], "src string, dst string")
    assert [(r.id, r.degree) for r in lifting.hub_nodes(nodes, edges).collect()] == [("0", 11)]
    loop = spark.createDataFrame([("1", "1")], "src string, dst string")
    assert {r.id: r.degree for r in lifting.degrees(nodes, loop).collect()}["1"] == 2
    n = nodes.withColumns({"file_type": F.lit("code"), "label": F.concat(F.lit("Agent"), "id"), "source_file": F.lit("a/b.py"), "community": F.lit("c"), "community_name": F.lit("n")})
    ents, rels = lifting.lift_graph(n, edges.withColumns({"relation": F.lit(None).cast("string"), "confidence": F.lit(0.7), "source_file": F.lit("f")}))
    assert [r.entity_id for r in ents.collect()] == ["0"] and rels.count() == 0


def entities(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id string, cluster string, label string, synonyms array<string>, source_refs array<string>, md_path string, seq int")


def test_overlap_report(spark):
    ents = entities(spark, [("a", "x", "One Two", [], ["e"], "a.md"), ("b", "x", " one two ", [], [], "b.md"), ("c", "x", "p q r s t u v w", ["y"], ["e"], "c.md"), ("d", "x", "p q r s t u v", ["z"], ["e"], None), ("e", "y", "", [], ["e"], "e.md")])
    rel = spark.createDataFrame([("r1", "a", "e"), ("r2", "a", "c"), ("r3", "a", "none")], "id string, source string, target string")
    got = {(r.kind, r.id, r.other, r.value) for r in registry.overlap_report(ents, rel, spark.createDataFrame([("a.md",), ("b.md",), ("c.md",), ("e.md",)], "path string")).collect()}
    assert got == {("label_duplicate", "a", "b", None), ("jaccard_overlap", "a", "b", 1.0), ("jaccard_overlap", "c", "d", 0.7), ("orphan_entity", "b", None, None), ("missing_md", "d", None, None), ("cluster_boundary", "r1", "y", None)}
    score = registry.report_score(registry.overlap_report(ents, rel, spark.createDataFrame([], "path string"))).first().score
    assert score == 0.0


def test_suffixed_ids(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a_2", 4), ("b", 5)], "base string, seq int")
    got = [r.id for r in registry.suffixed_ids(rows, "base", "seq", spark.createDataFrame([("b",), ("b_2",)], "id string")).orderBy("seq").collect()]
    assert got == ["a", "a_3", "a_4", "a_2", "b_3"]


def test_guards(spark):
    new = spark.createDataFrame([("entity", " X ", "c", None, None, None, ["e"]), ("entity", "Y", "c", None, None, None, []), ("relation", "r", "c", "a", None, None, ["e"]), ("instance", "i", "c", None, None, "", ["e"]), ("entity", "Z", "c", None, None, None, ["e"])], "kind string, label string, cluster string, source string, target string, type string, source_refs array<string>")
    got = sorted(str(r.rejected) for r in registry.guard_additions(new, spark.createDataFrame([("c", "x")], "cluster string, label string")).collect())
    assert got == ["None", "duplicate_label", "evidence_required", "instance_needs_type", "relation_needs_ends"]


def test_maintenance_scan(spark):
    ents = spark.createDataFrame([("a", "c1", "c1", "accepted", ["evidence:seed:s1", "evidence:seed:gone"], "c1/a.md"), ("b", "other", "c1", "stable", [], "c1/b.md"), ("d", None, "c1", "draft", [], "c1/d.md")], "id string, cluster string, dir_cluster string, status string, source_refs array<string>, md_path string")
    md = spark.createDataFrame([("c1/a.md", "c1"), ("c1/d.md", "c1"), ("c1/z.md", "c1")], "path string, cluster string")
    seeds = spark.createDataFrame([("evidence:seed:s1", "e/s1.md")], "id string, md_path string")
    got = {(r.kind, r.id or r.path) for r in maintain.drift(ents, md, seeds).collect()}
    assert got == {("jsonl_without_md", "b"), ("md_without_jsonl", "c1/z.md"), ("evidence_dangling", "a"), ("cluster_mismatch", "b")}
    rel = spark.createDataFrame([("a", None)], "subject_id string, object_id string")
    found = maintain.orphan_findings(ents, rel, md, spark.createDataFrame([("e/s1.md",), ("e/s2.md",)], "path string"), seeds)
    assert {(r.kind, r.id or r.path) for r in found.collect()} == {("md_orphan", "c1/z.md"), ("seed_orphan", "e/s2.md"), ("no_incoming_relation", "b")}


def test_half_even_coverage(spark):
    ents = spark.createDataFrame([("c", "draft", ["e"] if i == 0 else []) for i in range(16)], "cluster string, status string, source_refs array<string>")
    none = spark.createDataFrame([], "cluster string")
    row = maintain.cluster_eval(ents, none, none).first()
    assert row.evidence_coverage == 0.062 and row.status_dist == {"draft": 16}
    empty = maintain.cluster_eval(ents.limit(0), none, none)
    assert maintain.drift_readiness(empty, 0, 0, False).first().score == 0.6 and maintain.drift_readiness(empty, 0, 0, True).first().score == 0.7


def test_role_reasoning(spark):
    props = spark.createDataFrame([("a", "uses", "b"), ("b", "requires", "c"), ("x", "ipo", "y"), ("y", "ipo", "z"), ("m", "member_of", "grp")], "x string, p string, y string")
    types = spark.createDataFrame([("model", "Transformer"), ("ig", "ImageGeneration")], "x string, c string")
    rules = Rules(subclass=[("ImageGeneration", "Task"), ("Multimodal", "Transformer")], conditions=[("Multimodal", "Transformer", (("canBeUsedFor", "ImageGeneration"),))], transitive=["ipo"], chains=[(("uses", "requires"), "depends_on")], inverse=[("member_of", "has_member")])
    gt, gp = reasoning.reason(types, props.unionByName(spark.createDataFrame([("model", "canBeUsedFor", "ig")], "x string, p string, y string")), rules)
    assert {tuple(r) for r in gp.collect()} == {("a", "depends_on", "c"), ("x", "ipo", "z"), ("grp", "has_member", "m")}
    assert {tuple(r) for r in gt.collect()} == {("model", "Multimodal"), ("ig", "Task")}
    rec = {r.x: r for r in reasoning.delta_records(types, gt, gp).collect()}
    assert rec["model"].all_types == ["Multimodal", "Transformer"] and rec["a"].inferred_properties == {"depends_on": ["c"]} and "b" not in rec
    back, _ = reasoning.reason(types.filter("false").unionByName(spark.createDataFrame([("m2", "Multimodal")], "x string, c string")), props, rules)
    assert {tuple(r) for r in back.collect()} == {("m2", "Transformer")}


def test_carriers_and_compile(spark):
    definition = {"classes": {"A": {"annotations": {"label_ko": "가"}}, "B": {"is_a": "A", "annotations": {"label_ko": "나"}}, "C": None}, "slots": {"p": {"annotations": {"owl_characteristic": "functional"}}, "q": {"annotations": {"owl_characteristic": "SymmetricProperty", "property_chain": "p, q"}}}}
    base, _ = comp.compile_classes(spark, definition, "http://e/")
    out, warn = comp.rewrite_carriers(base, "http://e/")
    n = lambda cond: out.filter(cond).count()
    assert n("o like '%#Class'") == 3 and n("o like '%#ObjectProperty'") == 2 and n("o like '%FunctionalProperty'") == 1 and n("o like '%SymmetricProperty'") == 1
    assert n("o_lang = 'ko'") == 2 and n("p like '%owl_characteristic' or p like '%label_ko'") == 0 and warn.count() == 0
    assert out.exceptAll(comp.rewrite_carriers(out, "http://e/")[0]).count() == 0 and out.count() == base.count()
    rules = comp.rules_of(out)
    assert rules.chains == [(("http://e/p", "http://e/q"), "http://e/q")] and rules.symmetric == ["http://e/q"] and rules.subclass == [("http://e/B", "http://e/A")]
    odd, warned = comp.rewrite_carriers(comp.compile_roles(spark, {"slots": {"r": {"annotations": {"owl_characteristic": "Odd"}}}}, "http://e/"), "http://e/")
    assert warned.count() == 1 and odd.filter("o = 'Odd'").count() == 1
    inst = spark.createDataFrame([("i1", "Tool", {"requires": ["r1", "2"]})], "id string, instance_of string, slots map<string,array<string>>")
    assert {(r.o, r.o_kind) for r in comp.compile_instances(inst, "http://e/").collect()} >= {("http://e/r1", "iri"), ("2", "literal"), ("http://e/Tool", "iri")}
    assert comp.create_table_ddl({"classes": {"T": {"slots": ["n", "tags"]}}, "slots": {"n": {"range": "integer"}, "tags": {"multivalued": True}}}, "T") == "CREATE TABLE T (id STRING NOT NULL, n BIGINT, tags ARRAY<STRING>) USING parquet"


def test_role_gate(spark):
    roles = spark.createDataFrame([("uses", "stable", ["Has Part"]), ("has_part", "draft", [])], "name string, status string, aliases array<string>")
    props = spark.createDataFrame([("a", "uses", "b"), ("a", "has_part", "c"), ("a", "odd", "c")], "x string, p string, y string")
    assert [r.p for r in reasoning.undeclared_roles(props, roles).collect()] == ["odd"]
    assert [r.p for r in reasoning.draft_roles_in_use(props, roles).collect()] == ["has_part"]
    assert [r.other for r in reasoning.alias_collisions(roles).collect()] == ["has_part"]
    bad = reasoning.characteristic_violations(props.withColumn("p", F.lit("f")), functional=["f"], irreflexive=["f"])
    assert {(r.rule, r.x) for r in bad.collect()} == {("functional", "a")}
    axioms = spark.createDataFrame([("uses", ["gone"], ["uses"])], "role string, refs array<string>, chain array<string>")
    assert {(r.rule, r.ref) for r in reasoning.axiom_violations(axioms, roles).collect()} == {("undeclared", "gone"), ("chain_too_short", "uses")}


def test_provenance(spark):
    classes = spark.createDataFrame([("u:A", "entity:a"), ("u:B", None), ("u:C", "entity:c"), ("u:D", None)], "iri string, identifier string")
    ents = spark.createDataFrame([("entity:a", None, ["s1", "s2"], "f", None), ("x", "u:B", [], "file.md", "z"), ("y", "u:A", ["other"], None, None)], "id string, owl_class string, source_refs array<string>, source_file string, source string")
    out = provenance.two_step_join(classes, ents, spark.createDataFrame([("u:D",)], "iri string"))
    assert {r.iri: (r.status, r.sources) for r in out.collect()} == {"u:A": ("joined", ["s1", "s2"]), "u:B": ("joined", ["file.md"]), "u:C": ("ungrounded", []), "u:D": ("exempt", [])}
    assert tuple(provenance.coverage(out).first()) == (4, 2, 1, 1)
    cls = spark.createDataFrame([(i, comp.RDF + "type", comp.OWL + "Class", "iri", None, None) for i in ("u:A", "u:C", "u:D")], model.TRIPLES)
    triples = cls.unionByName(provenance.projection(out, "u:src/"))
    assert [r.focus for r in provenance.ungrounded(triples, "u:", "u:src/").collect()] == ["u:C"]


def test_gate_and_routes(spark):
    cols = "run_id string, non_determinism double, trajectory_complete boolean, oracle_score double, mode string, tokens long, seconds double, power_wh double, required boolean, requested int, acked int, tokens_max long"
    rows = [("ok", 0.1, True, 0.85, "fallback", 5, 1.0, 99.0, True, 1, 1, 0), ("bad", 0.2, False, 0.8, "full", 50, 1.0, 0.0, True, 2, 1, 10)]
    got = {r.run_id: (r.violated, r.next_action) for r in governance.gate(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"ok": ([], "proceed"), "bad": (["non_determinism", "trajectory", "oracle", "cost", "hitl"], "escalate_hitl")}
    assert governance.merged_thresholds({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    triggers = [{"id": "x", "priority": 1, "phrases": ["ab"]}, {"id": "y", "priority": 5, "phrases": ["cd"]}, {"id": "z", "priority": 5, "phrases": ["dc"]}]
    texts = spark.createDataFrame([("AB cd",), ("cd dc",), ("none",), ("ab abc cd ab",)], "text string")
    assert [r.route for r in governance.route(texts, triggers).collect()] == ["y", "y", None, "y"]
    paths = spark.createDataFrame([('{"file_path": "a/b.md", "command": "rm c/d.txt"}',)], "p string").select(governance.payload_paths(F.col("p")).alias("x")).first().x
    assert paths == ["a/b.md", "c/d.txt"]
    assert governance.run_oracle({}, "none")["passed"] and governance.run_oracle({"f": lambda: 1 / 0}, "f")["score"] == 0.0


def test_run_log(spark):
    ev = spark.createDataFrame([("r", "step_started", "a", 1, None), ("r", "step_started", "a", 2, None), ("r", "step_finished", "a", 3, None), ("r", "cost_increment", None, 4, 7), ("s", "run_started", None, 1, None)], "run_id string, event_type string, step_id string, seq int, tokens_delta long").withColumns({"seconds_delta": F.lit(None).cast("double"), "power_wh_delta": F.lit(None).cast("double")})
    assert [tuple(r) for r in governance.step_gaps(ev).collect()] == [("r", "a", 2, 1)]
    runs = spark.createDataFrame([("r", 2.0, "full", "mistral:7b"), ("s", 1.5, "fallback", None)], "run_id string, wall_seconds double, cost_mode string, model string")
    assert {r.run_id: (r.tokens, r.seconds, r.power_wh) for r in governance.run_cost(ev, runs).collect()} == {"r": (7, 2.0, 0.00105), "s": (0, 1.5, 0.0)}


def test_upsert_replaces_rows(spark):
    now = spark.createDataFrame([("k", 1.0, "src"), ("l", 2.0, None)], "id string, value double, source string")
    new = spark.createDataFrame([("k", 5.0, "x", 1), ("k", 6.0, None, 2)], "id string, value double, source string, seq int")
    assert {tuple(r) for r in archive.upsert(now, new, "id", "seq").collect()} == {("k", 6.0, None), ("l", 2.0, None)}


def test_composition_table(spark):
    kinds = graph.KINDS
    edges = spark.createDataFrame([(f"{a}{b}", f"m{a}{b}", a) for a in kinds for b in kinds] + [(f"m{a}{b}", f"{a}{b}end", b) for a in kinds for b in kinds] + [("q", "r", "contrasts_with")], "src string, dst string, kind string")
    got = {r.src: r.kind for r in graph.compose_edges(edges, 1).collect()}
    assert got == {f"{a}{b}": graph.COMPOSITION[a][i] for a in kinds for i, b in enumerate(kinds)}


def test_notes_and_guards(spark, tmp_path):
    recs = spark.createDataFrame([("a.md", "new"), ("b.md", "other")], "md_path string, label string")
    old = spark.createDataFrame([("a.md", f"{notes.START}\nold\n{notes.END}\nmine\n")], "path string, text string")
    out = {r.path: r.text for r in notes.with_block(recs, old, F.col("label")).collect()}
    assert out["a.md"] == f"{notes.START}\nnew\n{notes.END}\nmine\n" and out["b.md"].endswith(f"{notes.END}\n")
    rows = spark.createDataFrame([("1", "n", "a, b")], "id string, name string, tags string")
    none = old.limit(0)
    assert notes.project_rows(rows, none, "d", str(tmp_path)) == 0 and not os.path.exists(tmp_path / "d")
    assert notes.project_rows(rows, none, "d", str(tmp_path), apply=True) == 0 and "tags: a, b" in (tmp_path / "d" / "1.md").read_text()
    assert notes.project_rows(rows, spark.createDataFrame([("d/1.md", "by hand")], "path string, text string"), "d", str(tmp_path)) == 2
    made = notes.scaffold([{"path": "x", "kind": "dir"}, {"path": "x/a.md", "kind": "file_template", "template": "t"}], {"t": "hi {{KB}}"}, {"KB": "k"}, str(tmp_path), apply=True)
    assert made == ["x", "x/a.md"] and (tmp_path / "x/a.md").read_text() == "hi k"


def test_streams_equal_batches(spark, tmp_path):
    from kbspark.streaming import runs

    lines = [{"run_id": "r", "event_type": t, "step_id": "a", "ts": "2024-01-01T00:00:00Z", "tokens_delta": 3} for t in ("step_started", "step_started", "step_finished", "cost_increment", "cost_increment")]
    (tmp_path / "run-1.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    for name, df, mode in (("cost", runs.cost_stream, "complete"), ("step", runs.step_stream, "update")):
        q = df(runs.read_events(spark, str(tmp_path))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(90)
    assert spark.table("cost").first().tokens == 6
    assert tuple(spark.table("step").first()) == ("r", "a", 2, 1, True)


def test_collect_and_verify(spark):
    pages = spark.createDataFrame([(0, "http://a/x", "text/html", "<title>T</title><p>" + "Some words. " * 40 + "</p>"), (1, "b.md", "text/plain", "---\nk: v\n---\nbody"), (2, "c.md", "text/plain", "body")], "ordinal int, uri string, content_type string, body string")
    out = evidence.collect(pages, spark.createDataFrame([], "content_hash string"), "2024-01-01T00:00:00Z")
    got = {r.uri: r.kept for r in out.collect()}
    assert got == {"http://a/x": True, "b.md": True, "c.md": False}
    assert evidence.seed_violations(out).filter("not rule like 'missing:title'").count() == 0
    again = evidence.collect(pages, out.filter("kept"), "2024-01-01T00:00:00Z")
    assert again.filter("kept").count() == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_compositions_are_counted_without_their_rows(spark, monkeypatch, few):
    import random

    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "STEPS", 500)
    dice = random.Random(3)
    edges = spark.createDataFrame([(dice.randrange(60), dice.randrange(90), dice.choice([*graph.KINDS, "else"])) for _ in range(700)], "src long, dst long, kind string")
    for rounds in (1, 2, 3):
        rows = graph.compose_edges(edges, rounds).groupBy("hops", "kind").agg(F.count("*").alias("n"), F.countDistinct("via").alias("vias"))
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, graph.compose_counts(edges, rounds).collect()))


def test_compositions_through_a_hub(spark):
    """A hundred thousand sources and ends of one node are 10^10 compositions."""
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("src"), F.lit(-1).cast("long").alias("dst"), F.lit("causes").alias("kind"))
    edges = edges.unionByName(spark.range(n, 2 * n).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"), F.lit("requires").alias("kind")))
    assert [tuple(r) for r in graph.compose_counts(edges).collect()] == [(2, "causes", n * n, 1)]


def test_frontmatter_is_read_by_the_compiled_loader(monkeypatch):
    """The loader in Python took six times as long; it is only for where the other is missing."""
    import yaml

    if not hasattr(yaml, "CSafeLoader"):
        pytest.skip("no compiled loader")
    monkeypatch.setattr(yaml.SafeLoader, "__init__", lambda self, stream: pytest.fail("read by the loader in Python"))
    assert files.frontmatter_of("---\na: [1, 'b']\nc: {d: null}\n---\nBody.") == {"a": [1, "b"], "c": {"d": None}}
    assert files.frontmatter_of("---\na: [1\n---\n") == files.frontmatter_of("no") == {}


def test_rows_meet_their_like_after_the_shuffle_only(spark):
    """A task that reads a large split keeps no table of its different rows."""
    rows = spark.range(100).selectExpr("cast(id % 10 as string) as x", "cast(id % 2 as string) as p", "cast(id % 5 as string) as y")
    plan = reasoning.once(rows, ["x", "p", "y"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan[plan.rindex("Exchange hashpartitioning") :] and plan.count("Exchange") == 1
    assert reasoning.once(rows, ["x", "p", "y"]).count() == 10
