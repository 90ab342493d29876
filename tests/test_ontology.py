"""Shapes, class expressions, derivations and changes against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from kbspark.model import TRIPLES
from kbspark.operators import derivations, expressions as ex, shapes as sh
from kbspark.operators.compile import OWL, RDF, RDFS, XSD
from kbspark.operators.reasoning import Rules
from kbspark.sources.python_sources import parse_turtle

FACTS = "s string, p string, o string"


# --- derivations -----------------------------------------------------------------------------------------


def one_step(kind, row, facts):
    """(conclusion, premises) of one axiom."""
    at = dict(zip(kind.columns, row))

    def match(atom, fact, bound):
        bound = dict(bound)
        for term, v in zip(atom, fact):
            want = derivations.TYPE if term == derivations.TYPE else at.get(term) or bound.setdefault(term, v)
            if v != want:
                return None
        return bound

    for f in facts:
        b = match(kind.body[0], f, {})
        if b is None:
            continue
        for g in facts if len(kind.body) == 2 else [None]:
            c = b if g is None else match(kind.body[1], g, b)
            if c is not None:
                yield tuple(derivations.TYPE if t == derivations.TYPE else at.get(t) or c[t] for t in kind.head), (f,) if g is None else (f, g)


def closed(facts, axioms):
    kinds, out = {k.name: k for k in derivations.KINDS}, set(facts)
    while True:
        new = {h for k, rows in axioms.rows.items() for r in rows for h, _ in one_step(kinds[k], r, out)} - out
        if not new:
            return out
        out |= new


def drawn(seed):
    r = random.Random(seed)
    nodes, roles, classes = [f"n{i}" for i in range(7)], ["r", "q", "t"], list("ABCDE")
    some = lambda v: r.choice(v)
    facts = {(some(nodes), "a", some(classes)) for _ in range(6)} | {(some(nodes), some(roles), some(nodes)) for _ in range(8)}
    axioms = derivations.Axioms()
    for _ in range(r.randrange(4, 9)):
        kind = some(derivations.KINDS)
        axioms.add(kind.name, *(some(roles) if c in "rqt" else some(classes) for c in kind.columns))
    return facts, axioms


def rows_of(df):
    return {(r.s, r.p, r.o) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_derivations_and_changes(spark, seed):
    facts, axioms = drawn(seed)
    frame = lambda fs: spark.createDataFrame(sorted(fs), FACTS)
    found = derivations.derive(frame(facts), axioms)
    rows = {(r.s, r.p, r.o): r for r in found.facts.collect()}
    assert set(rows) == closed(facts, axioms) and len(rows) == found.facts.count()
    kinds = {k.name: k for k in derivations.KINDS}
    for fact, r in rows.items():
        if r.rule == derivations.STATED:
            assert fact in facts
            continue
        premises = tuple(tuple(p) for p in (r.p1, r.p2) if p)
        assert all(rows[p].level < r.level for p in premises)
        assert any((fact, premises) == step for row in axioms.rows[r.rule] for step in one_step(kinds[r.rule], row, premises))
    # Other facts and other axioms.
    other_facts, other_axioms = drawn(seed + 100)
    r = random.Random(seed)
    gone, new = set(r.sample(sorted(facts), 4)), set(r.sample(sorted(other_facts), 3)) | {next(iter(sorted(set(rows) - facts)), ("n0", "a", "A"))}
    then = derivations.Axioms({k: set(v) for k, v in axioms.rows.items()})
    kind = sorted(then.rows)[0]
    then.rows[kind] = set(sorted(then.rows[kind])[1:])
    for k, v in list(sorted(other_axioms.rows.items()))[:2]:
        then.rows.setdefault(k, set()).update(v)
    now, moved = derivations.changed(found, frame(new), frame(gone), then)
    want = closed((facts - gone) | new, then)
    assert rows_of(now.facts) == want and now.facts.count() == len(want)
    assert {(x.s, x.p, x.o, x.change) for x in moved.collect()} == {(*f, "added") for f in want - set(rows)} | {(*f, "removed") for f in set(rows) - want}
    levels = {(x.s, x.p, x.o): x for x in now.facts.collect()}
    assert all(levels[tuple(p)].level < x.level for x in levels.values() for p in (x.p1, x.p2) if p)


def test_work_grows_with_the_change(spark):
    """Two hundred chains of one class each: one chain's change touches that chain only."""
    facts = spark.range(200).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct(F.concat_ws(".", "id", k).alias("s"), F.lit("r").alias("p"), F.concat_ws(".", "id", k + 1).alias("o")))).alias("f")).select("f.*")
    found = derivations.derive(facts, derivations.Axioms().add("chain", "r", "r", "r"))
    assert found.facts.count() == 200 * 15
    now, moved = derivations.changed(found, facts.filter("false"), facts.filter("s = '7.2'"))
    assert moved.count() == 9 and sum(now.work) < 30 < sum(found.work)


def test_proofs(spark):
    axioms = derivations.Axioms.of(Rules(subclass=[("A", "B"), ("B", "C")], conditions=[("D", "C", (("r", "C"), ("q", None)))], chains=[(("r", "q", "r"), "t")]))
    facts = spark.createDataFrame([("x", "a", "A"), ("y", "a", "A"), ("x", "r", "y"), ("x", "q", "z"), ("y", "q", "x")], FACTS)
    found = derivations.derive(facts, axioms)
    assert {("x", "a", "D"), ("x", "t", "y")} <= rows_of(found.facts)
    rows = derivations.proofs(found, spark.createDataFrame([("x", "a", "D"), ("x", "t", "y"), ("no", "a", "D")], FACTS)).collect()
    assert {tuple(r.goal) for r in rows} == {("x", "a", "D"), ("x", "t", "y")}
    for goal in {tuple(r.goal) for r in rows}:
        own = {(r.s, r.p, r.o): r for r in rows if tuple(r.goal) == goal}
        assert own[goal].depth == 0 and all((r.rule == "stated") == (r.p1 is None) for r in own.values())
        assert all(tuple(p) in own for r in own.values() for p in (r.p1, r.p2) if p)
    with pytest.raises(ValueError):
        derivations.derive(facts, derivations.Axioms().add("odd", "x"))


# --- class expressions -------------------------------------------------------------------------------------


def test_expressions_saturate_and_clash(spark):
    axioms = ex.axioms_of_definition(
        {
            "classes": {
                "Parent": {"equivalent_to": {"some": {"child": "Person"}}, "implies": {"only": {"child": {"and": ["Child", {"not": "Stone"}]}}}},
                "Rich": {"equivalent_to": {"and": ["Person", {"some": {"owns": {"and": ["House", {"some": {"in": "Town"}}]}}}, {"value": {"bank": "b"}}]}},
                "Lucky": {"implied_by": {"or": ["Rich", {"some": {"child": "Rich"}}]}, "disjoint_with": "Sad"},
            },
            "disjoint": [["Person", "House", "Town"]],
        },
        "",
    )
    normal = ex.normal_form(axioms)
    types = spark.createDataFrame([("ann", "Person"), ("bob", "Person"), ("h", "House"), ("t", "Town"), ("ann", "Sad"), ("h", "Person"), ("s", "Stone")], "x string, c string")
    props = spark.createDataFrame([("ann", "child", "bob"), ("bob", "owns", "h"), ("h", "in", "t"), ("bob", "bank", "b"), ("ann", "child", "s")], "x string, p string, y string")
    closed_types, closed_props = ex.saturate(types, props, normal)
    got = {(r.x, r.c) for r in closed_types.collect() if not r.c.startswith("_:")} - {(r.x, r.c) for r in types.collect()}
    assert got == {("ann", "Parent"), ("bob", "Child"), ("s", "Child"), ("bob", "Rich"), ("bob", "Lucky"), ("ann", "Lucky")}
    assert closed_props.count() == 5
    wrong = {(r.x, r.c, r.stated) for r in ex.clashes(closed_types, normal, types).collect() if not r.c.startswith("_:")}
    assert wrong == {("ann", "Lucky", False), ("ann", "Sad", True), ("h", "Person", True), ("h", "House", True), ("s", "Stone", True)}


def test_what_rules_cannot_say_raises():
    for axioms in (ex.Axioms(implies=[("A", ex.any_of("B", "C"))]), ex.Axioms(implies=[(ex.only("r", "B"), "A")]), ex.Axioms(implies=[(ex.no("B"), "A")])):
        with pytest.raises(ValueError):
            ex.normal_form(axioms)
    many = ex.normal_form(ex.Axioms(implies=[(ex.all_of(*(f"C{i}" for i in range(10))), "D")]))
    assert len(many.both) == 9 and len(many.sub) == 1


def test_unsatisfiable_classes(spark):
    normal = ex.normal_form(
        ex.Axioms(
            implies=[("Cat", "Pet"), ("Dog", "Pet"), ("CatDog", ex.all_of("Cat", "Dog")), ("Owner", ex.some("has", "CatDog")), ("Friend", ex.some("knows", "Owner")), ("Void", ex.NOTHING), ("Fine", ex.some("has", "Cat")), (ex.some("has", "Pet"), "Keeper")],
            disjoint=[("Cat", "Dog", "Fish")],
        )
    )
    below, empty = ex.classify(spark, normal)
    assert {r.c for r in empty.collect()} == {"CatDog", "Owner", "Friend", "Void"}
    assert {("CatDog", "Pet"), ("Fine", "Keeper"), ("Cat", "Pet")} <= {(r.c, r.d) for r in below.collect()}


def test_axioms_of_triples(spark):
    text = f"""@prefix owl: <{OWL}> . @prefix rdfs: <{RDFS}> . @prefix : <u:> .
    :A owl:equivalentClass [ a owl:Class ; owl:intersectionOf ( :B [ a owl:Restriction ; owl:onProperty :r ; owl:someValuesFrom :C ] ) ] ; rdfs:subClassOf :Z , [ owl:onProperty :r ; owl:allValuesFrom [ owl:complementOf :D ] ] .
    [ owl:onProperty :q ; owl:hasValue :i ] rdfs:subClassOf :V . [] a owl:AllDisjointClasses ; owl:members ( :E :F ) . :E owl:disjointWith :G . :U owl:unionOf ( :B :C ) ."""
    found = ex.axioms_of_triples(spark.createDataFrame(parse_turtle(text), TRIPLES))
    assert found.equal == [("u:A", ("and", ("u:B", ("some", "u:r", "u:C"))))]
    assert set(found.implies) == {("u:A", ("only", "u:r", ("not", "u:D"))), (("value", "u:q", "u:i"), "u:V")}
    assert sorted(map(sorted, found.disjoint)) == [["u:E", "u:F"], ["u:E", "u:G"]]


# --- shapes ----------------------------------------------------------------------------------------------


DATA = f"""@prefix : <u:> . @prefix xsd: <{XSD}> . @prefix rdfs: <{RDFS}> .
:a a :Person ; :name "Ann", "Anne"@en, "Änne"@en-GB ; :age 31 ; :knows :b, :c ; :born 5 ; :died 9 ; :email "x@y" .
:b a :Student ; :name "Bob" ; :age "old" ; :knows :a ; :born 9 ; :died 3 ; :nick "Bob" .
:c a :Person ; :name "C"@en, "D"@en ; :age 200, 7.5 ; :knows "nobody", [ a :Person ] ; :odd 1 .
:Student rdfs:subClassOf :Learner . :Learner rdfs:subClassOf :Person . :x :next :y . :y :next :z . :z :next :x ."""


@pytest.fixture(scope="module")
def validator(spark):
    return sh.Validator(spark.createDataFrame(parse_turtle(DATA), TRIPLES))


def failing(validator, shape, classes=("u:Person",)):
    return sorted({(r.focus.removeprefix("u:"), r.rule, (r.value or "").removeprefix("u:")) for r in validator.report([sh.Shape("s", target_classes=classes, properties=(shape,))]).collect() if not r.focus.startswith("_:")})


@pytest.mark.parametrize(
    "path,constraints,want",
    [
        ("u:name", {"max_count": 2, "min_count": 2}, [("a", "max_count", ""), ("b", "min_count", "")]),
        ("u:name", {"datatype": XSD + "string"}, [("a", "datatype", "Anne"), ("a", "datatype", "Änne"), ("c", "datatype", "C"), ("c", "datatype", "D")]),
        ("u:name", {"unique_lang": True}, [("c", "unique_lang", "")]),
        ("u:name", {"language_in": ["EN"], "min_length": 2, "max_length": 3}, [("a", "language_in", "Ann"), ("a", "max_length", "Anne"), ("a", "max_length", "Änne"), ("b", "language_in", "Bob"), ("c", "min_length", "C"), ("c", "min_length", "D")]),
        ("u:age", {"min_inclusive": 8, "max_exclusive": 200}, [("b", "max_exclusive", "old"), ("b", "min_inclusive", "old"), ("c", "max_exclusive", "200"), ("c", "min_inclusive", "7.5")]),
        ("u:age", {"in": ["31", "old", "200"]}, [("c", "in", "7.5")]),
        ("u:knows", {"class": "u:Person"}, [("c", "class", "nobody")]),
        ("u:knows", {"node_kind": "IRI"}, [("c", "node_kind", "nobody"), ("c", "node_kind", "_:g1")]),
        ("u:knows", {"has_value": "u:a"}, [("a", "has_value", ""), ("c", "has_value", "")]),
        ("u:name", {"equals": "u:nick"}, [("a", "equals", "Ann"), ("a", "equals", "Anne"), ("a", "equals", "Änne"), ("c", "equals", "C"), ("c", "equals", "D")]),
        ("u:name", {"disjoint": "u:nick"}, [("b", "disjoint", "Bob")]),
        ("u:born", {"less_than": "u:died"}, [("b", "less_than", "9")]),
        (sh.inverse("u:knows"), {"min_count": 2}, [("a", "min_count", ""), ("b", "min_count", ""), ("c", "min_count", "")]),
        (sh.sequence("u:knows", "u:knows"), {"has_value": "u:a"}, [("b", "has_value", ""), ("c", "has_value", "")]),
        (sh.alternative("u:born", "u:died", sh.optional("u:odd")), {"max_count": 2}, [("a", "max_count", ""), ("b", "max_count", "")]),
        (sh.one_or_more("u:knows"), {"max_count": 4}, [("a", "max_count", ""), ("b", "max_count", "")]),
        (sh.sequence(sh.zero_or_more("u:knows"), sh.inverse("u:email")), {"max_count": 0}, []),
    ],
)
def test_constraints_on_paths(validator, path, constraints, want):
    got = failing(validator, sh.Shape(path=path, constraints=constraints))
    assert [g if not g[2].startswith("_:") else (*g[:2], "_:g1") for g in got] == sorted(want)


def test_cycles_end(validator):
    shape = sh.Shape("s", target_nodes=("u:x",), properties=(sh.Shape(path=sh.one_or_more("u:next"), constraints={"min_count": 3, "max_count": 3}), sh.Shape(path=sh.inverse(sh.zero_or_more("u:next")), constraints={"max_count": 2})))
    assert [(r.rule, r.path) for r in validator.report([shape]).collect()] == [("max_count", "^u:next*")]


def test_logic_nesting_and_closure(validator):
    adult = sh.Shape(properties=(sh.Shape(path="u:age", constraints={"min_count": 1, "min_inclusive": 18, "max_inclusive": 150}),))
    named = sh.Shape(properties=(sh.Shape(path="u:name", constraints={"min_count": 1, "pattern": "^A"}),))
    report = lambda **k: sorted({(r.focus.removeprefix("u:"), r.rule) for r in validator.report([sh.Shape("s", target_classes=("u:Person",), **k)]).collect() if not r.focus.startswith("_:")})
    assert report(any_of=(adult, named)) == [("b", "any_of"), ("c", "any_of")]
    assert report(none_of=(adult,)) == [("a", "none_of")]
    assert report(one_of=(adult, named)) == [("b", "one_of"), ("c", "one_of")]
    assert report(all_of=(adult,)) == [("b", "all_of"), ("c", "all_of")]
    assert report(properties=(sh.Shape(path="u:knows", node=(adult,)),)) == [("a", "node"), ("c", "node")]
    assert report(properties=(sh.Shape(path="u:knows", constraints={"qualified": (adult, 1, None)}),)) == [("a", "qualified_min"), ("c", "qualified_min")]
    assert report(closed=True, ignored=(RDF + "type", "u:name", "u:age", "u:knows", "u:born", "u:died", "u:odd")) == [("a", "closed"), ("b", "closed")]
    assert report(none_of=(adult,), deactivated=True) == []
    with pytest.raises(ValueError):
        sh.Shape(constraints={"minimum": 1})


def test_shapes_that_reach_themselves(spark):
    text = f"@prefix sh: <{sh.SH}> . <u:s> a sh:NodeShape ; sh:targetClass <u:P> ; sh:property <u:p> . <u:p> sh:path <u:knows> ; sh:node <u:s> ."
    with pytest.raises(ValueError):
        sh.read_shapes(spark.createDataFrame(parse_turtle(text), TRIPLES))


def test_proofs_need_only_what_is_relevant(spark):
    """Facts and axioms that no proof of the goal can hold are left out, and the goal's proofs stay the same."""
    axioms = derivations.Axioms().add("subclass", "A", "B").add("some", "r", "B", "C").add("chain", "s", "s", "r").add("inverse", "r", "q").add("domain", "r", "Big").add("both", "C", "Big", "E")
    rows = [("x", "r", "y"), ("y", "a", "A"), ("u", "s", "v"), ("v", "s", "y"), ("x", "t", "y"), ("y", "a", "Other"), ("w", "a", "C")]
    facts = spark.createDataFrame(rows, FACTS)
    kept, fewer = derivations.relevant(facts, axioms, {"C"})
    assert fewer.rows == {"subclass": {("A", "B")}, "some": {("r", "B", "C")}, "chain": {("s", "s", "r")}}
    assert {tuple(r) for r in kept.collect()} == set(rows) - {("x", "t", "y"), ("y", "a", "Other")}
    goal = lambda d: {repr(r) for r in derivations.proofs(d, d.facts.filter("p = 'a' and o = 'C'")).collect()}
    assert goal(derivations.derive(kept, fewer)) == goal(derivations.derive(facts, axioms))


def test_triples_are_read_once_for_all_uses(spark):
    """Shapes with many paths, nested ones too: what the triples are made from is worked out once."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(f"n{i}", p, o, "iri", None, None) for i in range(20) for p, o in (("p", f"n{i // 2}"), ("q", "z"))]
    triples = spark.createDataFrame(rows, TRIPLES).mapInArrow(counted, TRIPLES)
    inner = sh.Shape(path="q", constraints={"min_count": 1, "has_value": "z"})
    shape = sh.Shape("s", target_subjects_of=("p",), properties=(sh.Shape(path="p", constraints={"max_count": 1}, any_of=(sh.Shape(properties=(inner,)), inner)), inner))
    assert sh.Validator(triples).report([shape]).collect() == []
    assert read.value == len(rows)


def test_shared_nodes_are_walked_from_once(spark, monkeypatch):
    """Many nodes lead to one chain: the rounds of a repeated path hold a row for each node of the chain and what it reaches, not for each start."""
    written, save = [], sh.saved

    def counting(df, name):
        out = save(df, name)
        written.append(out.count() if name == "reached" else 0)
        return out

    monkeypatch.setattr(sh, "saved", counting)
    rows = [(f"s{i}", "p", "c0", "iri", None, None) for i in range(300)] + [(f"c{i}", "up", f"c{i + 1}", "iri", None, None) for i in range(5)]
    v = sh.Validator(spark.createDataFrame(rows, TRIPLES))
    starts = spark.createDataFrame([(f"s{i}",) for i in range(300)], "v string").select(sh._resource(F.col("v")).alias("focus")).withColumn("node", F.col("focus"))
    for path, least in ((sh.one_or_more("up"), 1), (sh.zero_or_more("up"), 0)):
        got = v.walk(starts, sh.sequence("p", path), True)
        assert {(r.focus.value, r.node.value) for r in got.collect()} == {(f"s{i}", f"c{j}") for i in range(300) for j in range(least, 6)}
    assert sum(written) < 40


def test_facts_are_not_dealt_by_their_class(spark, monkeypatch):
    """No round shuffles facts on the name of their class or role: most have the same few. What is gained is new, each fact once."""
    plans, save = [], ex.saved

    def keeping(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df, name)

    monkeypatch.setattr(ex, "saved", keeping)
    normal = ex.normal_form(ex.Axioms(implies=[(ex.all_of("A", "B", ex.some("r", "A")), "C"), ("C", ex.only("r", "D")), ("D", ex.value("s", "v")), (ex.value("s", "v"), "A")], disjoint=[("C", "D")]))
    types = spark.createDataFrame([("x", "A"), ("x", "A"), ("x", "B"), ("y", "A"), ("y", "B"), ("z", "Other")], "x string, c string")
    props = spark.createDataFrame([("x", "r", "y"), ("x", "r", "y"), ("y", "r", "y"), ("z", "t", "x")], "x string, p string, y string")
    new_types, new_props = ex.gained(types, props, normal)
    assert sorted((r.x, r.c) for r in new_types.filter("c not like '\\_:%'").collect()) == [("x", "C"), ("y", "C"), ("y", "D")]
    assert [tuple(r) for r in new_props.collect()] == [("y", "s", "v")]
    closed, _ = ex.saturate(types, props, normal)
    assert sorted((r.x, r.c, r.stated) for r in ex.clashes(closed, normal, types).collect()) == [("y", "C", False), ("y", "D", False)]
    assert not [p for p in plans if re.search(r"hashpartitioning\([cp]#\d+, \d+", p)]


def test_derivations_do_not_deal_facts_by_their_class(spark, monkeypatch):
    """Neither rounds nor changes shuffle facts on class or role names alone, and facts that no axiom names are not joined."""
    plans, save = [], derivations.saved

    def keeping(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df, name)

    monkeypatch.setattr(derivations, "saved", keeping)
    axioms = derivations.Axioms().add("subclass", "A", "B").add("both", "B", "C", "D").add("inverse", "r", "q").add("chain", "q", "t", "u")
    rows = [("x", "a", "A"), ("x", "a", "C"), ("x", "r", "y"), ("x", "t", "z"), ("w", "a", "Other"), ("w", "other", "x")]
    found = derivations.derive(spark.createDataFrame(rows, "s string, p string, o string"), axioms)
    inferred = lambda d: sorted(tuple(r) for r in d.facts.filter("rule <> 'stated'").select("s", "p", "o").collect())
    assert inferred(found) == [("x", "a", "B"), ("x", "a", "D"), ("y", "q", "x"), ("y", "u", "z")]
    add, gone = ([("w", "a", "A"), ("w", "a", "C")], [("x", "a", "C"), ("x", "t", "z")])
    now, moved = derivations.changed(found, *(spark.createDataFrame(r, "s string, p string, o string") for r in (add, gone)))
    assert inferred(now) == [("w", "a", "B"), ("w", "a", "D"), ("x", "a", "B"), ("y", "q", "x")]
    assert sorted(tuple(r) for r in moved.collect()) == sorted([(*f, "added") for f in (*add, ("w", "a", "B"), ("w", "a", "D"))] + [(*f, "removed") for f in (*gone, ("x", "a", "D"), ("y", "u", "z"))])
    assert not [p for p in plans if re.search(r"hashpartitioning\([cr]#\d+, \d+", p)]


def test_saved_tables_leave_no_shuffle_files(spark):
    """The shuffle files of a written table go with the writing, and the session's setting stays as it was."""
    import time

    from kbspark.operators import reasoning

    held = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, setting = held(), spark.conf.get(reasoning._CLEANUP)
    out = reasoning.saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "counts")
    for _ in range(20):
        if not held() - before:
            break
        time.sleep(0.2)
    assert not held() - before and spark.conf.get(reasoning._CLEANUP) == setting
    assert sum(r.n for r in out.collect()) == 1000


def test_changes_need_only_what_is_concerned(spark):
    """Facts that a change cannot touch and that lead to none it can are left out; the changes stay the same."""
    axioms = derivations.Axioms().add("subclass", "A", "B").add("some", "r", "B", "C").add("inverse", "r", "q").add("domain", "q", "Big").add("chain", "s", "s", "s").add("both", "C", "D", "E")
    then = derivations.Axioms({k: set(v) for k, v in axioms.rows.items() if k != "both"}).add("subclass", "C", "F")
    rows = [("x", "r", "y"), ("y", "a", "A"), ("x", "a", "D"), ("u", "s", "v"), ("v", "s", "w"), ("u", "r", "z"), ("z", "other", "z")]
    facts, added, gone = spark.createDataFrame(rows, FACTS), spark.createDataFrame([("z", "a", "A")], FACTS), spark.createDataFrame([("y", "a", "A")], FACTS)
    kept, before, after = derivations.concerned(facts, axioms, then, added.unionByName(gone))
    assert {tuple(r) for r in kept.collect()} == {r for r in rows if r[1] != "s"}
    assert "inverse" not in before.rows and "chain" not in before.rows and after.rows["subclass"] == {("A", "B"), ("C", "F")}
    moved = lambda f, a, b: sorted(tuple(r) for r in derivations.changed(derivations.derive(f, a, once=True), added, gone, b)[1].collect())
    assert moved(kept, before, after) == moved(facts, axioms, then)


def test_order_graph_holds_each_triple_once(spark, tmp_path):
    """Lines, orders and parts that repeat give their triples once, so the validator need not shuffle them."""
    from kbspark.plans import graphs

    lines = [(1, 1, 2, 3, 5.0, "A"), (1, 1, 2, 3, 5.0, "A"), (1, 1, 2, 3, 5.0, "N"), (1, 2, 2, 3, 5.0, "A")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (1,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(2, "B"), (2, "B"), (2, "C")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    rows = [(r.s, r.p, r.o) for r in graphs.order_graph(spark, str(tmp_path)).collect()]
    assert len(rows) == len(set(rows)) == 2 * 5 + 1 + 1 + 1 + 2 and ("l-1-1-2-3-5", "note", "back") in rows


@pytest.mark.parametrize("most", [100_000, 3, 0])
def test_numbers_of_repeated_paths_without_their_pairs(spark, monkeypatch, most):
    """Counts at the end of a repeated path equal those of the pairs, which are not made; for any bound on one row."""
    rows = [(f"f{i}", "has", f"n{(i * 7 + j * 5) % 23}") for i in range(12) for j in range(i % 4)] + [(f"n{i}", "in", f"n{i // 2}") for i in range(1, 23)] + [("n3", "in", "n11"), ("f1", "in", "n4")]
    triples = spark.createDataFrame([(s, p, o, "iri", None, None) for s, p, o in rows], TRIPLES)
    v = sh.Validator(triples, once=True)
    path = sh.sequence("has", sh.one_or_more("in"))
    nodes = v.targets(sh.Shape(target_subjects_of=("has", "in")))
    start = nodes.select(F.col("node").alias("focus"), "node")
    plain = {r.focus.value: r.n for r in v.walk(start, path, True).groupBy("focus").agg(F.count("*").alias("n")).collect()}
    monkeypatch.setattr(sh, "MOST_IN_A_ROW", most)
    monkeypatch.setattr(sh.Validator, "_repeat", None)
    assert {r.focus.value: r.n for r in v.counts(start, path).collect()} == plain
    if most == 3:
        failed = v.failures(sh.Shape(path=path, constraints={"min_count": 2, "max_count": 6}), nodes)
        want = {(f, "min_count") for f in {r[0] for r in rows} if plain.get(f, 0) < 2} | {(f, "max_count") for f, n in plain.items() if n > 6}
        assert {(r.focus.value, r.rule) for r in failed.collect()} == want and {r for _, r in want} == {"min_count", "max_count"}
