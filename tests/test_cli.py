"""Commands over a small knowledge base: dry runs change nothing, applied runs can be verified."""

from __future__ import annotations

import json

from kbspark import cli


def run(capsys, root, *args):
    code = cli.main(["--root", str(root), *map(str, args)])
    return code, capsys.readouterr().out


def test_evidence(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("# Title\n\n" + "One short sentence. " * 200)
    assert run(capsys, tmp_path, "evidence", "collect")[0] == 2
    code, out = run(capsys, tmp_path, "evidence", "collect", "--source", tmp_path / "a.md")
    assert code == 0 and json.loads(out)["added"] > 1 and not (tmp_path / "evidence").exists()
    assert json.loads(run(capsys, tmp_path, "evidence", "collect", "--source", tmp_path / "a.md", "--apply")[1])["added"] > 1
    again = json.loads(run(capsys, tmp_path, "evidence", "collect", "--source", tmp_path / "a.md", tmp_path / "none.md", "--apply")[1])
    assert again["added"] == 0 and again["errors"] == 1
    assert run(capsys, tmp_path, "evidence", "verify")[0] == 0
    assert run(capsys, tmp_path, "evidence", "list", "--format", "ids")[1].startswith("evidence:seed:a_0000")
    assert json.loads(run(capsys, tmp_path, "evidence", "readiness")[1])["hashes_ok"] == 1.0


def test_reason_and_scan(spark, tmp_path, capsys):
    owl = tmp_path / "ontology/owl"
    owl.mkdir(parents=True)
    (owl / "d.ttl").write_text(
        "@prefix e: <http://e/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix s: <http://www.w3.org/2000/01/rdf-schema#> .\n"
        "e:uses a owl:ObjectProperty . e:requires a owl:ObjectProperty . e:depends a owl:ObjectProperty ; owl:propertyChainAxiom ( e:uses e:requires ) .\n"
        "e:Agent s:subClassOf e:Thing . e:a a owl:NamedIndividual, e:Agent ; e:uses e:b . e:b a owl:NamedIndividual ; e:requires e:c . e:c a owl:NamedIndividual .\n"
    )
    code, out = run(capsys, tmp_path, "reason")
    rec = json.loads(out)
    assert code == 0 and rec["inferred_properties"] == {"http://e/depends": ["http://e/c"]} and rec["inferred_types"] == ["http://e/Thing"]
    reg = tmp_path / "ontology/explain/c1"
    reg.mkdir(parents=True)
    (reg / "entities.jsonl").write_text(json.dumps({"id": "entity:a", "label": "A", "cluster": "c1", "status": "accepted", "md_path": "ontology/explain/c1/a.md", "source_refs": []}) + "\n")
    kinds = [json.loads(x)["kind"] for x in run(capsys, tmp_path, "maintain", "scan", "--kind", "drift")[1].splitlines()]
    assert kinds == ["jsonl_without_md"]
    assert [json.loads(x)["kind"] for x in run(capsys, tmp_path, "maintain", "scan", "--check", "length")[1].splitlines()] == ["label_too_short"]
    assert run(capsys, tmp_path, "maintain", "scan", "--check", "redundancy")[1] == ""
    assert run(capsys, tmp_path, "registry", "overlap")[0] == 1
    assert '"evidence_coverage":0.0' in run(capsys, tmp_path, "maintain", "scan", "--kind", "eval")[1]


def test_archive(spark, tmp_path, capsys):
    (tmp_path / "rows.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    done = json.loads(run(capsys, tmp_path, "archive", "export", "--table", f"t={tmp_path}/rows.jsonl", "--apply")[1])
    view = "snap_" + done[0].rpartition("/")[2].removesuffix(".parquet")
    assert json.loads(run(capsys, tmp_path, "archive", "query", "--sql", f"select sum(id) as s from {view}")[1]) == [{"s": 3}]


def test_ontology_roles_and_workflows(spark, tmp_path, capsys):
    from tests.test_knowledge import ABOX, DEFINITION, FLOW, ROLES

    for name, text in (("ontology/definition/d.yaml", DEFINITION), ("ontology/Rbox/roles/d.yaml", ROLES), ("ontology/Abox/d.yaml", ABOX), ("agent-context/workflow/e/a.yaml", FLOW), ("agent-context/workflow/index.yaml", "workflows: [{id: flow.a, path: e/a.yaml}, {id: b, path: e/b.yaml}]\n")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    code, out = run(capsys, tmp_path, "ontology", "materialise")
    assert code == 0 and "https://ex.org/Fast" in out and not (tmp_path / "ontology/owl").exists()
    assert run(capsys, tmp_path, "ontology", "materialise", "--apply")[0] == 0 and (tmp_path / "ontology/owl/materialised.ttl").exists()
    code, out = run(capsys, tmp_path, "ontology", "explain", "--instance", "motor")
    assert code == 0 and "part_of" in out and run(capsys, tmp_path, "ontology", "explain", "--instance", "none")[0] == 1
    other = tmp_path / "cand" / "d.yaml"
    other.parent.mkdir()
    other.write_text(DEFINITION.replace("is_a: Part, slot", "is_a: Engine, slot"))
    assert '"change":"removed"' in run(capsys, tmp_path, "ontology", "what-if", "--definition", other)[1]
    assert [json.loads(x)["state"] for x in run(capsys, tmp_path, "roles", "list")[1].splitlines()] == ["declared", "axiomatised"]
    assert run(capsys, tmp_path, "roles", "declare", "--name", "uses")[0] == 1
    assert run(capsys, tmp_path, "roles", "declare", "--name", "uses", "--evidence", "e", "--apply")[0] == 0
    assert run(capsys, tmp_path, "roles", "declare", "--name", "uses", "--evidence", "e")[0] == 1 and len(run(capsys, tmp_path, "roles", "list")[1].splitlines()) == 3
    assert run(capsys, tmp_path, "roles", "validate")[0] == 0
    code, out = run(capsys, tmp_path, "workflows", "check")
    assert code == 1 and [json.loads(x) for x in out.splitlines()] == [{"id": "b", "rule": "missing_path"}]
    assert run(capsys, tmp_path, "workflows", "sync")[0] == 1 and run(capsys, tmp_path, "workflows", "sync", "--apply")[0] == 0 == run(capsys, tmp_path, "workflows", "sync")[0]
    assert run(capsys, tmp_path, "runs", "gate", "--run", "x")[0] == 101 and run(capsys, tmp_path, "runs", "ack", "--run", "x", "--topic", "t", "--by", "p", "--outcome", "ok")[0] == 0
    code, out = run(capsys, tmp_path, "setup", "score")
    assert code == 2 and json.loads(out)["no_unresolved_conflicts"] is True
