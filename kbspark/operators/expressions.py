"""Class expressions and disjointness: normal forms, saturation by rule kind, clashes.

An axiom may name any nesting of intersections, unions, restrictions and complements. ``normal_form`` cuts it
into rules of seven kinds over named classes, with fresh names for inner expressions, so that every rule has
at most two premises and an intersection of ten classes is nine small rules instead of ten joins of nine. Each
kind is one table and one join: rounds cost the same however many axioms there are. Rounds are semi-naive
over types and properties together. What no rule of these kinds can say (a choice to be made, such as a union
that a class implies) raises ValueError instead of being lost.

Expressions: a class name, ``THING``, ``all_of(*es)``, ``any_of(*es)``, ``no(e)``, ``some(role, e)``,
``only(role, e)``, ``value(role, individual)``.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import reasoning
from kbspark.operators.compile import MOST_AXIOMS, OWL, RDF, RDFS
from kbspark.operators.reasoning import Rules, discard, gathered, saved

THING, NOTHING = OWL + "Thing", OWL + "Nothing"

all_of = lambda *es: ("and", es)
any_of = lambda *es: ("or", es)
no = lambda e: ("not", e)
some = lambda role, e=THING: ("some", role, e)
only = lambda role, e: ("only", role, e)
value = lambda role, individual: ("value", role, individual)


@dataclass
class Axioms:
    """``implies``: (expression, expression); ``equal``: (expression, expression); ``disjoint``: tuples of expressions."""

    implies: list[tuple] = field(default_factory=list)
    equal: list[tuple] = field(default_factory=list)
    disjoint: list[tuple] = field(default_factory=list)


@dataclass
class Normal:
    """Rules by kind, over named classes."""

    sub: list[tuple[str, str]] = field(default_factory=list)  # c -> d
    both: list[tuple[str, str, str]] = field(default_factory=list)  # c and e -> d
    some_left: list[tuple[str, str, str]] = field(default_factory=list)  # some r c -> d
    some_right: list[tuple[str, str, str]] = field(default_factory=list)  # c -> some r d
    only: list[tuple[str, str, str]] = field(default_factory=list)  # c -> only r d
    value_left: list[tuple[str, str, str]] = field(default_factory=list)  # r a -> d
    value_right: list[tuple[str, str, str]] = field(default_factory=list)  # c -> r a
    disjoint: list[tuple[str, str]] = field(default_factory=list)  # name of the axiom, class


class _Cutter:
    def __init__(self):
        self.out, self.number, self.known = Normal(), itertools.count(1), {}

    def fresh(self) -> str:
        return f"_:c{next(self.number)}"

    def implied_by(self, e) -> str:
        """A name that everything in ``e`` has."""
        if isinstance(e, str):
            return e
        if e in self.known:
            return self.known[e]
        kind = e[0]
        if kind == "and":
            name = self.implied_by(e[1][0])
            for part in e[1][1:]:
                right, left = self.implied_by(part), name
                if THING in (left, right):
                    name = left if right == THING else right
                else:
                    name = self.known.setdefault(("both", left, right), self.fresh())
                    self.out.both.append((left, right, name))
        else:
            name = self.fresh()
            if kind == "or":
                self.out.sub += [(self.implied_by(part), name) for part in e[1]]
            elif kind == "some":
                self.out.some_left.append((e[1], self.implied_by(e[2]), name))
            elif kind == "value":
                self.out.value_left.append((e[1], e[2], name))
            else:
                raise ValueError(f"{kind!r} cannot be a condition: it asks what is not known")
        self.known[e] = name
        return name

    def named(self, e) -> str:
        """A name that implies ``e``."""
        if isinstance(e, str):
            return e
        name = self.fresh()
        self.implies(name, e)
        return name

    def implies(self, name: str, e) -> None:
        if isinstance(e, str):
            if e == NOTHING:
                self.apart((name, name))
            elif e not in (name, THING):
                self.out.sub.append((name, e))
            return
        kind = e[0]
        if kind == "and":
            for part in e[1]:
                self.implies(name, part)
        elif kind == "not":
            self.apart((name, self.implied_by(e[1])))
        elif kind == "value":
            self.out.value_right.append((name, e[1], e[2]))
        elif kind == "or" and len(e[1]) == 1:
            self.implies(name, e[1][0])
        elif kind in ("some", "only"):
            if kind == "only" and e[2] == THING:
                return
            (self.out.some_right if kind == "some" else self.out.only).append((name, e[1], self.named(e[2])))
        else:
            raise ValueError("a class that implies a union leaves a choice: state which part holds, or the parts as disjoint")

    def apart(self, names: tuple[str, ...]) -> None:
        if len(set(names)) == 1:
            # Its members clash by themselves.
            self.out.disjoint += [(f"{names[0]} is empty", names[0]), (f"{names[0]} is empty", THING)]
        else:
            self.out.disjoint += [(" | ".join(sorted(set(names))), n) for n in sorted(set(names))]


def normal_form(axioms: Axioms) -> Normal:
    """Axioms as rules of at most two premises each; ValueError for what such rules cannot say."""
    cut = _Cutter()
    for left, right in [*axioms.implies, *((b, a) for a, b in axioms.equal), *axioms.equal]:
        cut.implies(cut.implied_by(left), right)
    for group in axioms.disjoint:
        cut.apart(tuple(cut.implied_by(e) for e in group))
    return cut.out


def _table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(sorted(set(rows)), ", ".join(f"{n} string" for n in names.split()))


def _together(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.filter("false")
    for part in parts:
        out = out.unionByName(part)
    return out.distinct()


#: Facts of one premise that are few enough to be sent to all tasks.
FEW = 200_000


def saturate(types: DataFrame, props: DataFrame, normal: Normal, rules: Rules | None = None, representatives: bool = False) -> tuple[DataFrame, DataFrame]:
    """(types (x, c), props (x, p, y)) with everything that follows, fresh names of ``normal`` included.

    ``rules``: role axioms, and the class axioms of a simpler kind. With ``representatives`` a class that
    implies a restriction gives its members a value that stands for the class restricted to, else nothing named.
    """
    (t, nt), (p, np_) = _closed(types, props, normal, rules, representatives)
    return t.distinct().unionByName(nt), p.distinct().unionByName(np_)


def gained(types: DataFrame, props: DataFrame, normal: Normal, rules: Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``saturate`` adds to the facts that are given."""
    (_, nt), (_, np_) = _closed(types, props, normal, rules, False)
    return nt, np_


def _counts(df: DataFrame, column: str, names: set[str]) -> dict[str, int]:
    """How many facts there are of each of ``names``; they come from axioms, so there are few."""
    return {r[0]: r[1] for r in df.filter(F.col(column).isin(*sorted(names))).groupBy(column).count().collect()} if names else {}


def _closed(types: DataFrame, props: DataFrame, normal: Normal, rules: Rules | None, representatives: bool) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """((types as given, types gained), (properties as given, properties gained)); what is given may repeat, what is gained does not.

    A round joins only what axioms whose premises are new ask for: facts of other classes and roles are neither joined
    nor shuffled, and conclusions are compared only with facts of their own classes.
    """
    spark, rules = types.sparkSession, rules or Rules()
    if rules.conditions:
        stated = Axioms([(all_of(*([is_a] if is_a else []), *(some(p, c or THING) for p, c in wanted)), cls) for cls, is_a, wanted in rules.conditions])
        more = normal_form(stated)
        normal = Normal(*(getattr(normal, f) + _apart_names(getattr(more, f)) for f in Normal.__dataclass_fields__))
    sub, domain, ranges = normal.sub + rules.subclass, list(rules.domain), list(rules.range)
    domain += [(r, d) for r, c, d in normal.some_left if c == THING]
    some_left = [t for t in normal.some_left if t[1] != THING]
    symmetric = sorted({*normal.both, *((b, a, d) for a, b, d in normal.both)})
    roles = bool(rules.subproperty or rules.inverse or rules.symmetric or rules.transitive or rules.chains)
    makes = [*normal.value_right, *(normal.some_right if representatives else [])]
    classes = {c for rows, at in ((sub, (0, 1)), (symmetric, (0, 2)), (some_left, (1, 2)), (normal.only, (0, 2)), (normal.value_left, (2,)), (domain, (1,)), (ranges, (1,)), (makes, (0,))) for r in rows for c in (r[i] for i in at)}
    names = {r[i] for rows, i in ((some_left, 0), (normal.only, 1), (normal.value_left, 0), (domain, 0), (ranges, 0), (makes, 1)) for r in rows}
    # Axioms come from the caller's code or ontology files, never from the facts.
    axioms = lambda rows, columns: F.broadcast(_table(spark, rows, columns))
    of = lambda df, column, rows, at: df.filter(F.col(column).isin(*sorted({r[at] for r in rows})))

    def few(rows: DataFrame, counts: dict[str, int], used: list[tuple], at: int) -> DataFrame:
        # A fact meets one axiom of a name or more.
        return F.broadcast(rows) if sum(counts.get(r[at], 0) for r in used) <= FEW else rows

    def new_types(dt: DataFrame, dp: DataFrame, ft: DataFrame, fp: DataFrame, first: bool) -> DataFrame | None:
        parts, heads = [], set()
        new, held = (lambda rows, at: [r for r in rows if fresh_t.get(r[at])]), (lambda rows, at: [r for r in rows if all_t.get(r[at])])
        used = lambda rows, at: [r for r in rows if fresh_p.get(r[at])]
        known = lambda rows, at: [r for r in rows if all_p.get(r[at])]

        def add(rows: list[tuple], at: int, part: DataFrame) -> None:
            heads.update(r[at] for r in rows)
            parts.append(part)

        if rows := new(sub, 0):
            add(rows, 1, dt.join(axioms(rows, "c d"), "c").select("x", F.col("d").alias("c")))
        # At first all facts are new: then one side of each axiom is enough.
        smaller = lambda rows: [(a, b, d) if fresh_t.get(a, 0) <= fresh_t.get(b, 0) else (b, a, d) for a, b, d in rows]
        if rows := held(new(smaller(normal.both) if first else symmetric, 0), 1):
            need = dt.join(axioms(rows, "c e d"), "c").select("x", F.col("e").alias("c"), "d")
            add(rows, 2, few(need, fresh_t, rows, 0).join(of(ft, "c", rows, 1), ["x", "c"]).select("x", F.col("d").alias("c")))
        if rows := known(new(some_left, 1), 0):
            inner = dt.withColumnRenamed("x", "y").join(axioms(rows, "p c d"), "c").select("p", "y", "d")
            add(rows, 2, few(inner, fresh_t, rows, 1).join(of(fp, "p", rows, 0), ["p", "y"]).select("x", F.col("d").alias("c")))
        if rows := [] if first else held(used(some_left, 0), 1):
            own = of(ft, "c", rows, 1).withColumnRenamed("x", "y")
            add(rows, 2, few(own, all_t, rows, 1).join(dp.join(axioms(rows, "p c d"), "p"), ["y", "c"]).select("x", F.col("d").alias("c")))
        if rows := known(new(normal.only, 0), 1):
            inner = dt.join(axioms(rows, "c p d"), "c").select("x", "p", "d")
            add(rows, 2, few(inner, fresh_t, rows, 0).join(of(fp, "p", rows, 1), ["x", "p"]).select(F.col("y").alias("x"), F.col("d").alias("c")))
        if rows := [] if first else held(used(normal.only, 1), 0):
            own = of(ft, "c", rows, 0)
            add(rows, 2, few(own, all_t, rows, 0).join(dp.join(axioms(rows, "c p d"), "p"), ["x", "c"]).select(F.col("y").alias("x"), F.col("d").alias("c")))
        if rows := used(normal.value_left, 0):
            add(rows, 2, dp.join(axioms(rows, "p y d"), ["p", "y"]).select("x", F.col("d").alias("c")))
        for pairs, end in ((domain, "x"), (ranges, "y")):
            if rows := used(pairs, 0):
                add(rows, 1, dp.join(axioms(rows, "p c"), "p").select(F.col(end).alias("x"), "c"))
        if not parts:
            return None
        out = _together(parts, ft.select("x", "c"))
        old = sorted(h for h in heads if all_t.get(h))
        return out.join(ft.filter(F.col("c").isin(*old)), ["x", "c"], "left_anti") if old else out

    def new_props(dt: DataFrame, dp: DataFrame, fp: DataFrame) -> DataFrame | None:
        parts = []
        rows = [r for r in makes if fresh_t.get(r[0])]
        if rows:
            parts.append(dt.join(axioms(rows, "c p y"), "c").select("x", "p", "y"))
        if roles and has_dp:
            parts.append(reasoning._new_props(dp, fp, rules).select("x", "p", "y"))
        if not parts:
            return None
        out, heads = _together(parts, fp.select("x", "p", "y")), sorted({r[1] for r in rows})
        if roles and has_dp:
            return out.join(fp, ["x", "p", "y"], "left_anti")
        return out.join(fp.filter(F.col("p").isin(*heads)), ["x", "p", "y"], "left_anti") if any(all_p.get(h) for h in heads) else out

    def kept(rows: DataFrame | None, name: str) -> DataFrame | None:
        return saved(rows, name) if rows is not None else None

    t0, p0 = dt, dp = ft, fp = saved(types.select("x", "c"), "types"), saved(props.select("x", "p", "y"), "props")
    none_t, none_p, t_parts, p_parts = t0.filter("false"), p0.filter("false"), [], []
    fresh_t, fresh_p, has_dp = _counts(t0, "c", classes), _counts(p0, "p", names), True
    all_t, all_p = dict(fresh_t), dict(fresh_p)
    for turn in itertools.count(1):
        nt, np_ = kept(new_types(dt, dp, ft, fp, turn == 1), "types"), kept(new_props(dt, dp, fp), "props")
        # Fresh names count too: every class that is concluded is one of ``classes``.
        has_dt, has_dp = nt is not None and not nt.isEmpty(), np_ is not None and not np_.isEmpty()
        if not has_dt and not has_dp:
            discard(nt, np_)
            together = lambda parts, none: functools.reduce(lambda a, b: a.unionByName(b), parts, none)
            return (t0, together(t_parts, none_t)), (p0, together(p_parts, none_p))
        dt, dp = nt if has_dt else none_t, np_ if has_dp else none_p
        fresh_t, fresh_p = _counts(dt, "c", classes) if has_dt else {}, _counts(dp, "p", names) if has_dp else {}
        for total, fresh in ((all_t, fresh_t), (all_p, fresh_p)):
            for k, n in fresh.items():
                total[k] = total.get(k, 0) + n
        if has_dt:
            t_parts.append(nt)
            ft = ft.unionByName(nt)
        if has_dp:
            p_parts.append(np_)
            fp = fp.unionByName(np_)
        if turn % 16 == 0:
            if len(t_parts) > 2:
                t_parts = [gathered(t_parts[:-1], "types"), t_parts[-1]]
                ft = functools.reduce(lambda a, b: a.unionByName(b), t_parts, t0)
                dt = t_parts[-1] if has_dt else dt
            if len(p_parts) > 2:
                p_parts = [gathered(p_parts[:-1], "props"), p_parts[-1]]
                fp = functools.reduce(lambda a, b: a.unionByName(b), p_parts, p0)


def _apart_names(rows: list[tuple]) -> list[tuple]:
    """Fresh names of a second normal form, told apart from those of the first."""
    return [tuple(v.replace("_:c", "_:r", 1) if v.startswith("_:c") else v for v in row) for row in rows]


def clashes(types: DataFrame, normal: Normal, asserted: DataFrame | None = None) -> DataFrame:
    """(x, axiom, c, stated): for every individual in two or more classes of a disjoint group, the facts that clash.

    ``types`` must be saturated. ``stated``: whether the fact is in ``asserted`` (x, c), not inferred. A group of
    any size is one aggregate, not pairs.
    """
    spark = types.sparkSession
    members = F.broadcast(_table(spark, normal.disjoint, "axiom c"))
    own = types.unionByName(types.select("x", F.lit(THING).alias("c"))).distinct() if any(c == THING for _, c in normal.disjoint) else types
    own = own.filter(F.col("c").isin(*sorted({c for _, c in normal.disjoint}), THING))
    # One shuffle: the classes of a group that an individual is in are no more than the group names.
    hit = own.filter("x is not null").join(members, "c").groupBy("x", "axiom").agg(F.collect_set("c").alias("cs")).filter(F.size("cs") > 1)
    facts = hit.select("x", "axiom", F.explode("cs").alias("c")).filter(F.col("c") != THING)
    if asserted is None:
        return facts.withColumn("stated", F.lit(None).cast("boolean"))
    stated = asserted.select("x", "c").filter(F.col("c").isin(*sorted({c for _, c in normal.disjoint}))).distinct().withColumn("stated", F.lit(True))
    return facts.join(stated, ["x", "c"], "left").select("x", "axiom", "c", F.coalesce("stated", F.lit(False)).alias("stated"))


def classify(spark: SparkSession, normal: Normal, rules: Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """(subsumptions (c, d) between named classes, unsatisfiable classes (c)), from one representative a class.

    A class is unsatisfiable if its representative clashes, or must have a value whose class is. ``only``,
    ranges and inverse roles, which tell more about a value than its class does, take no part here.
    """
    rules = rules or Rules()
    bare = Normal(**{**{f: getattr(normal, f) for f in Normal.__dataclass_fields__}, "only": []})
    given = Rules(subclass=rules.subclass, conditions=rules.conditions, subproperty=rules.subproperty, transitive=rules.transitive, chains=rules.chains, domain=rules.domain)
    names = {c for rows, at in ((bare.sub, (0, 1)), (bare.both, (0, 1, 2)), (bare.some_left, (1, 2)), (bare.some_right, (0, 2)), (bare.value_left, (2,)), (bare.value_right, (0,)), (bare.disjoint, (1,)), (rules.subclass, (0, 1))) for r in rows for c in (r[i] for i in at)}
    names |= {c for cls, is_a, wanted in rules.conditions for c in (cls, is_a, *(w for _, w in wanted)) if c}
    own = spark.createDataFrame(sorted((n, n) for n in names - {THING}), "x string, c string")
    none = spark.createDataFrame([], "x string, p string, y string")
    types, props = saturate(own, none, bare, given, representatives=True)
    empty = saved(clashes(types, normal).select("x").distinct(), "empty")
    fresh = empty
    while True:
        # Whoever needs a value of an empty class, or is in one, is empty.
        back = props.join(fresh.withColumnRenamed("x", "y"), "y").select("x").unionByName(types.join(fresh.withColumnRenamed("x", "c"), "c").select("x")).distinct()
        fresh = saved(back.join(empty, "x", "left_anti"), "empty")
        if fresh.isEmpty():
            break
        empty = empty.unionByName(fresh)
    stated = lambda c: ~F.col(c).startswith("_:")
    return types.filter(stated("x") & stated("c") & (F.col("x") != F.col("c"))).select(F.col("x").alias("c"), F.col("c").alias("d")), empty.filter(stated("x")).select(F.col("x").alias("c"))


# --- where axioms come from ------------------------------------------------------------------------------


def parse_expression(e, base: str = ""):
    """An expression of a definition file: a name, or one of {and: [...]}, {or: [...]}, {not: e}, {some: {role: e}}, {only: {role: e}}, {value: {role: individual}}."""
    if isinstance(e, str):
        return e if "://" in e or e == THING else base + e
    if not isinstance(e, dict) or len(e) != 1:
        raise ValueError(f"not a class expression: {e!r}")
    kind, of = next(iter(e.items()))
    if kind in ("and", "or"):
        return (kind, tuple(parse_expression(x, base) for x in of))
    if kind == "not":
        return no(parse_expression(of, base))
    if kind in ("some", "only", "value") and isinstance(of, dict) and len(of) == 1:
        role, inner = next(iter(of.items()))
        return (kind, base + role, base + inner if kind == "value" else parse_expression(inner, base))
    raise ValueError(f"not a class expression: {e!r}")


def axioms_of_definition(definition: dict, base: str) -> Axioms:
    """Keys ``equivalent_to``, ``implied_by``, ``implies``, ``disjoint_with`` of a definition's classes, and its ``disjoint`` groups."""
    out = Axioms()
    several = lambda v: v if isinstance(v, list) else [] if v is None else [v]
    for name, c in (definition.get("classes") or {}).items():
        c = c or {}
        out.equal += [(base + name, parse_expression(e, base)) for e in several(c.get("equivalent_to"))]
        out.implies += [(base + name, parse_expression(e, base)) for e in several(c.get("implies"))]
        out.implies += [(parse_expression(e, base), base + name) for e in several(c.get("implied_by"))]
        out.disjoint += [(base + name, parse_expression(e, base)) for e in several(c.get("disjoint_with"))]
    out.disjoint += [tuple(parse_expression(e, base) for e in group) for group in definition.get("disjoint") or []]
    return out


def axioms_of_triples(triples: DataFrame) -> Axioms:
    """Equivalent, implied and disjoint classes that triples (s, p, o, o_kind) state, with their blank nodes.

    Only triples of ontology terms leave the executors; more than MOST_AXIOMS raise.
    """
    terms = [OWL + t for t in ("equivalentClass", "disjointWith", "intersectionOf", "unionOf", "complementOf", "onProperty", "someValuesFrom", "allValuesFrom", "hasValue", "members")] + [RDF + "first", RDF + "rest", RDFS + "subClassOf"]
    rows = triples.filter(F.col("p").isin(*terms) & ((F.col("p") != RDFS + "subClassOf") | (F.col("o_kind") == "bnode") | F.col("s").startswith("_:"))).select("s", "p", "o").distinct().limit(MOST_AXIOMS + 1).collect()
    if len(rows) > MOST_AXIOMS:
        raise ValueError(f"more than {MOST_AXIOMS} axioms: these are facts, not an ontology")
    about: dict[str, dict[str, list[str]]] = {}
    for s, p, o in sorted(map(tuple, rows)):
        about.setdefault(s, {}).setdefault(p, []).append(o)

    def listed(cell: str) -> list[str]:
        out = []
        while cell != RDF + "nil":
            out.append(about[cell][RDF + "first"][0])
            cell = about[cell][RDF + "rest"][0]
        return out

    def expression(node: str):
        own = about.get(node, {})
        one = lambda t: own[OWL + t][0]
        if OWL + "onProperty" in own:
            role = one("onProperty")
            for term, make in (("someValuesFrom", some), ("allValuesFrom", only)):
                if OWL + term in own:
                    return make(role, expression(one(term)))
            if OWL + "hasValue" in own:
                return value(role, one("hasValue"))
            raise ValueError(f"restriction {node} of a kind that is not covered")
        if node.startswith("_:") or not {OWL + "equivalentClass", RDFS + "subClassOf", OWL + "disjointWith"} & set(own):
            for term, kind in (("intersectionOf", "and"), ("unionOf", "or")):
                if OWL + term in own:
                    return (kind, tuple(map(expression, listed(one(term)))))
            if OWL + "complementOf" in own:
                return no(expression(one("complementOf")))
        return node

    out = Axioms()
    for s, own in about.items():
        me = expression(s) if s.startswith("_:") else s
        out.equal += [(me, expression(o)) for o in own.get(OWL + "equivalentClass", [])]
        out.implies += [(me, expression(o)) for o in own.get(RDFS + "subClassOf", [])]
        out.disjoint += [(me, expression(o)) for o in own.get(OWL + "disjointWith", [])]
        out.disjoint += [tuple(map(expression, listed(o))) for o in own.get(OWL + "members", [])]
    return out
