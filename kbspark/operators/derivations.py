"""Why facts hold, and what changes when facts or axioms do.

Facts are (s, p, o); a type fact has the predicate ``a``. Axioms are rows of a few kinds, each a pattern of
one or two premises and a conclusion; all axioms of one kind are one table and one join. The fixpoint keeps
with every fact the first derivation found (kind and premises, the smallest of one round), so every fact has
one proof, and proofs are well founded: premises are of earlier levels. Of a derivation only what its fact does
not tell is kept (``how``: the terms of the premises that are not in the conclusion); premises are made of both.

``changed`` starts from such facts instead of from nothing. What loses its proof is found by following premises
upwards from what is taken away; what of it can be proved otherwise is proved backwards, from conclusion to
premises, and from there on as any new fact; what is new goes through ordinary semi-naive rounds. Rows that are
joined grow with the change, not with the facts.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.reasoning import Rules, discard, gathered, saved

TYPE, STATED = "a", "stated"


@dataclass(frozen=True)
class Kind:
    """Terms of patterns: ``x y z`` are nodes, TYPE is itself, all others are columns of the kind's axioms."""

    name: str
    columns: tuple[str, ...]
    body: tuple[tuple[str, str, str], ...]
    head: tuple[str, str, str]


KINDS = (
    Kind("subclass", ("c", "d"), (("x", TYPE, "c"),), ("x", TYPE, "d")),
    Kind("both", ("c", "e", "d"), (("x", TYPE, "c"), ("x", TYPE, "e")), ("x", TYPE, "d")),
    Kind("some", ("r", "c", "d"), (("x", "r", "y"), ("y", TYPE, "c")), ("x", TYPE, "d")),
    Kind("only", ("c", "r", "d"), (("x", TYPE, "c"), ("x", "r", "y")), ("y", TYPE, "d")),
    Kind("domain", ("r", "c"), (("x", "r", "y"),), ("x", TYPE, "c")),
    Kind("range", ("r", "c"), (("x", "r", "y"),), ("y", TYPE, "c")),
    Kind("subproperty", ("r", "q"), (("x", "r", "y"),), ("x", "q", "y")),
    Kind("inverse", ("r", "q"), (("x", "r", "y"),), ("y", "q", "x")),
    Kind("chain", ("r", "q", "t"), (("x", "r", "y"), ("y", "q", "z")), ("x", "t", "z")),
)
_FACT = ["s", "p", "o"]
_PREMISE = "struct<s:string,p:string,o:string>"
_HOW = ("a", "b", "c")


def _open_terms(kind: Kind) -> list[str]:
    """Terms of the premises that the conclusion leaves open, in the order of the premises: by them derivations of one fact compare as by their premises."""
    return list(dict.fromkeys(t for atom in kind.body for t in atom if t != TYPE and t not in kind.head))


def _premise(at: int) -> Column:
    """Premise number ``at`` of a row (s, p, o, rule, how)."""
    out = F.lit(None).cast(_PREMISE)
    for kind in KINDS:
        if len(kind.body) > at:
            known = {t: F.col(c) for c, t in zip(_FACT, kind.head)} | {t: F.col(f"how.{c}") for c, t in zip(_HOW, _open_terms(kind))}
            out = F.when(F.col("rule") == kind.name, F.struct(*[(F.lit(TYPE) if t == TYPE else known[t]).alias(c) for c, t in zip(_FACT, kind.body[at])])).otherwise(out)
    return out


@dataclass
class Axioms:
    """Rows by the name of their kind."""

    rows: dict[str, set[tuple[str, ...]]] = field(default_factory=dict)

    def add(self, kind: str, *row: str) -> Axioms:
        self.rows.setdefault(kind, set()).add(row)
        return self

    def minus(self, other: Axioms) -> Axioms:
        return Axioms({k: left for k, v in self.rows.items() if (left := v - other.rows.get(k, set()))})

    @staticmethod
    def of(rules: Rules) -> Axioms:
        """The same as ``rules`` say; chains and conditions of more than two parts are cut by names of their own."""
        out, number = Axioms(), itertools.count(1)
        for kind, pairs in (("subclass", rules.subclass), ("domain", rules.domain), ("range", rules.range), ("subproperty", rules.subproperty)):
            for pair in pairs:
                out.add(kind, *pair)
        for a, b in rules.inverse:
            out.add("inverse", a, b).add("inverse", b, a)
        for p in rules.symmetric:
            out.add("inverse", p, p)
        for p in rules.transitive:
            out.add("chain", p, p, p)
        for chain, target in rules.chains:
            first = chain[0]
            for at, p in enumerate(chain[1:], 2):
                name = target if at == len(chain) else f"_:{'/'.join(chain[:at])}"
                out.add("chain", first, p, name)
                first = name
            if len(chain) == 1:
                out.add("subproperty", first, target)
        for cls, is_a, wanted in rules.conditions:
            parts = [is_a] if is_a else []
            for r, c in wanted:
                parts.append(f"_:{r} {c}" if c else f"_:{r}")
                out.add("some", r, c, parts[-1]) if c else out.add("domain", r, parts[-1])
            first = parts[0]
            for at, c in enumerate(parts[1:], 2):
                name = cls if at == len(parts) else f"_:{next(number)} {cls}"
                out.add("both", first, c, name)
                first = name
            if len(parts) == 1:
                out.add("subclass", first, cls)
        return out


def _bound(atom: tuple[str, str, str], facts: DataFrame) -> DataFrame:
    """Facts as rows of the pattern's terms."""
    facts = facts.filter(F.col("p") == TYPE if atom[1] == TYPE else F.col("p") != TYPE)
    return facts.select(*[F.col(c).alias(t) for c, t in zip(_FACT, atom) if t != TYPE])


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [c for c in left.columns if c in right.columns])


def _head(kind: Kind, rows: DataFrame) -> DataFrame:
    term = lambda t: F.lit(TYPE) if t == TYPE else F.col(t)
    terms = [F.col(t) for t in _open_terms(kind)]
    how = F.struct(*[t.cast("string").alias(c) for c, t in itertools.zip_longest(_HOW, terms, fillvalue=F.lit(None))])
    return rows.select(*[term(t).alias(c) for c, t in zip(_FACT, kind.head)], F.lit(kind.name).alias("rule"), how.alias("how"))


#: What a pattern asks for: (TYPE, class), (role, None), or (TYPE, None) where a role that is concluded is the type's predicate itself.
Name = tuple[str, str | None]


def _name(kind: Kind, row: tuple[str, ...], atom: tuple[str, str, str]) -> Name:
    term = dict(zip(kind.columns, row))
    return (TYPE, term[atom[2]]) if atom[1] == TYPE else (term[atom[1]], None)


def _of(names: set[Name]) -> Column:
    """Whether a fact is of ``names``."""
    is_type = F.col("p") == TYPE
    classes = F.lit(True) if (TYPE, None) in names else F.col("o").isin(*sorted(c for p, c in names if p == TYPE))
    return F.coalesce(F.when(is_type, classes).otherwise(F.col("p").isin(*sorted(p for p, c in names if p != TYPE))), F.lit(False))


def _named(facts: DataFrame, names: set[Name]) -> DataFrame:
    """Facts of ``names``: others are neither joined nor shuffled."""
    # Tables of facts are read by predicate, which a whole condition on pairs does not tell the reader.
    return facts.filter(F.col("p").isin(*sorted({p for p, _ in names})) & _of(names))


class Reasoner:
    """Axioms as rows by kind, and the two directions of their rules."""

    def __init__(self, spark: SparkSession, axioms: Axioms):
        known = {k.name: k for k in KINDS}
        if set(axioms.rows) - set(known):
            raise ValueError(f"unknown kinds of axioms: {sorted(set(axioms.rows) - set(known))}")
        self.spark, self.rows = spark, [(known[k], sorted(rows)) for k, rows in sorted(axioms.rows.items()) if rows]
        each = lambda atoms: {_name(kind, row, atom) for kind, rows in self.rows for row in rows for atom in atoms(kind)}
        self.heads, self.bodies = each(lambda kind: (kind.head,)), each(lambda kind: kind.body)

    def _table(self, kind: Kind, rows: list[tuple[str, ...]]) -> DataFrame:
        # Axioms are the caller's, never facts. A join on their few names would put most facts in one task.
        return F.broadcast(self.spark.createDataFrame(rows, ", ".join(f"{c} string" for c in kind.columns)))

    def names(self, facts: DataFrame) -> set[Name]:
        """Which of the names that axioms hold occur in ``facts``."""
        rows = _named(facts, self.heads | self.bodies).select("p", F.when(F.col("p") == TYPE, F.col("o")).alias("c")).distinct()
        # A role that is the type's predicate may conclude any class: only classes that axioms name are told apart.
        classes = sorted({c for p, c in self.heads | self.bodies if p == TYPE and c is not None})
        return {(r.p, r.c) for r in rows.withColumn("c", F.when(F.col("c").isin(*classes), F.col("c"))).distinct().collect()}

    def forward(self, fresh: DataFrame, facts: DataFrame, new: set[Name] | None = None, held: set[Name] | None = None) -> tuple[DataFrame | None, set[Name]]:
        """((s, p, o, rule, how), names of those): conclusions with at least one premise in ``fresh``, the others in ``facts``.

        ``new`` and ``held``: the names of facts in both; without them any may be there. Where ``fresh`` is
        ``facts``, one side of each axiom is enough.
        """
        parts, heads = [], set()
        for kind, rows in self.rows:
            for newest, atom in enumerate(kind.body[:1] if fresh is facts else kind.body):
                other = kind.body[1 - newest] if len(kind.body) == 2 else None
                used = [r for r in rows if (new is None or _name(kind, r, atom) in new) and (other is None or held is None or _name(kind, r, other) in held)]
                if not used:
                    continue
                out = _met(_bound(atom, _named(fresh, {_name(kind, r, atom) for r in used})), self._table(kind, used))
                if other:
                    out = _met(out, _bound(other, _named(facts, {_name(kind, r, other) for r in used})))
                parts.append(_head(kind, out))
                heads |= {_name(kind, r, kind.head) for r in used}
        return _union(parts), heads

    def backward(self, heads: DataFrame, facts: DataFrame) -> DataFrame | None:
        """The same for conclusions among ``heads`` (s, p, o), all premises in ``facts``."""
        parts = []
        for kind, rows in self.rows:
            out = _met(_bound(kind.head, _named(heads, {_name(kind, r, kind.head) for r in rows})), self._table(kind, rows))
            for atom in kind.body:
                out = _met(out, _bound(atom, _named(facts, {_name(kind, r, atom) for r in rows})))
            parts.append(_head(kind, out))
        return _union(parts)

    def above(self, names: set[Name], at: int) -> tuple[set[Name], set[str]]:
        """Names and rules of what premise number ``at`` of one of ``names`` may conclude."""
        rests = [(_name(kind, row, kind.head), kind.name) for kind, rows in self.rows if len(kind.body) > at for row in rows if _name(kind, row, kind.body[at]) in names]
        return {n for n, _ in rests}, {r for _, r in rests}


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def _one_each(found: DataFrame, level: int) -> DataFrame:
    """One derivation a fact: the smallest."""
    # Derivations of one fact come from many tasks: a sort before the shuffle would join few of them.
    best = found.repartition(*_FACT).groupBy(*_FACT).agg(F.min(F.struct("rule", "how")).alias("d"))
    return best.select(*_FACT, F.lit(level).alias("level"), "d.rule", "d.how")


def _stated(facts: DataFrame, once: bool = False) -> DataFrame:
    facts = facts.select(*_FACT)
    none = F.lit(None).cast("struct<" + ",".join(f"{c}:string" for c in _HOW) + ">")
    return (facts if once else facts.distinct()).select(*_FACT, F.lit(0).alias("level"), F.lit(STATED).alias("rule"), none.alias("how"))


@dataclass
class Derived:
    """``rows`` (s, p, o, level, rule, how), their axioms, and the rows that each round of their making found."""

    rows: DataFrame
    axioms: Axioms
    work: list[int]
    changes: int = 0

    @property
    def facts(self) -> DataFrame:
        """(s, p, o, level, rule, p1, p2): each fact with the premises of its proof."""
        return self.rows.select(*_FACT, "level", "rule", _premise(0).alias("p1"), _premise(1).alias("p2"))


def _rounds(reasoner: Reasoner, full: DataFrame, fresh: DataFrame, level: int, work: list[int], held: set[Name] | None = None) -> DataFrame:
    """Semi-naive rounds from ``fresh``, which ``full`` holds; returns ``full`` with what follows. ``held``: names that ``full`` may hold, where these are known."""
    known, parts = full, []
    new_names = reasoner.names(fresh)
    held = held or (new_names if fresh is full else reasoner.names(full))
    while True:
        found, heads = reasoner.forward(fresh, full, new_names, held)
        if found is None:
            return known.unionByName(gathered(parts, "derived")) if parts else known
        found = _one_each(found, level)
        # Conclusions are compared with facts of their own names.
        if (TYPE, None) in heads or heads & held:
            found = found.join(_named(full, heads).select(*_FACT), _FACT, "left_anti")
        new = saved(found, "derived")
        n = new.count()
        if not n:
            discard(new)
            return known.unionByName(gathered(parts, "derived")) if parts else known
        work.append(n)
        new_names = reasoner.names(new)
        held = held | new_names
        parts.append(new)
        if len(parts) % 16 == 0:
            parts = [gathered(parts[:-1], "derived"), new]
        full, fresh, level = functools.reduce(lambda a, b: a.unionByName(b), [known, *parts]), new, level + 1


def derive(facts: DataFrame, axioms: Axioms, once: bool = False) -> Derived:
    """Everything that follows from ``facts`` (s, p, o), each with one derivation; stated facts are their own. ``once``: no fact is there twice."""
    start = saved(_stated(facts, once), "facts")
    work = [start.count()]
    return Derived(_rounds(Reasoner(facts.sparkSession, axioms), start, start, 1, work), axioms, work)


def relevant(facts: DataFrame, axioms: Axioms, classes: set[str] = frozenset(), predicates: set[str] = frozenset()) -> tuple[DataFrame, Axioms]:
    """The facts and axioms that a proof of a fact of ``classes`` or ``predicates`` can hold.

    An axiom counts if it concludes what is wanted; then what its premises ask for is wanted too. Derivations of
    wanted facts are the same as from everything: no other axiom concludes them or any of their premises.
    """
    bodies, heads, out = {k.name: k.body for k in KINDS}, {k.name: k for k in KINDS}, Axioms()
    wanted = {(TYPE, c) for c in classes} | {(p, None) for p in predicates}

    def pattern(kind: str, row: tuple[str, ...], atom: tuple[str, str, str]) -> Name:
        return _name(heads[kind], row, atom)

    def asked(head: tuple[str, str | None]) -> bool:
        # A role that is itself the type's predicate may conclude any class.
        return head in wanted or (head == (TYPE, None) and any(p == TYPE for p, _ in wanted))

    while True:
        found = {(kind, row) for kind, rows in axioms.rows.items() for row in rows if row not in out.rows.get(kind, ()) and asked(pattern(kind, row, heads[kind].head))}
        if not found:
            break
        for kind, row in found:
            out.add(kind, *row)
            wanted |= {pattern(kind, row, atom) for atom in bodies[kind]}
    is_type = F.col("p") == TYPE
    held = F.when(is_type, F.col("o").isin(*[c for p, c in wanted if p == TYPE])).otherwise(F.col("p").isin(*[p for p, c in wanted if c is None]))
    return facts.filter(held), out


def concerned(facts: DataFrame, axioms: Axioms, then: Axioms, moved: DataFrame) -> tuple[DataFrame, Axioms, Axioms]:
    """The facts and axioms, before and ``then``, on which ``changed`` finds the same changes when facts ``moved`` (s, p, o) come or go.

    Facts that neither follow from what comes or goes nor lead to such facts are the same on both sides.
    """
    both = Reasoner(facts.sparkSession, Axioms({k: axioms.rows.get(k, set()) | then.rows.get(k, set()) for k in {*axioms.rows, *then.rows}}))
    rules = [(kind.name, row, _name(kind, row, kind.head), {_name(kind, row, atom) for atom in kind.body}) for kind, rows in both.rows for row in rows]
    names = both.heads | both.bodies
    if (TYPE, None) in names:  # a role that is the type's predicate may conclude any class
        return facts, axioms, then
    other = {(kind, row) for a, b in ((axioms, then), (then, axioms)) for kind, rows in a.minus(b).rows.items() for row in rows}
    wanted = both.names(moved) | {head for kind, row, head, _ in rules if (kind, row) in other}
    while more := {head for _, _, head, bodies in rules if bodies & wanted} - wanted:
        wanted |= more
    while more := {name for _, _, head, bodies in rules if head in wanted for name in bodies} - wanted:
        wanted |= more
    used = {(kind, row) for kind, row, head, _ in rules if head in wanted}
    kept = lambda a: Axioms({k: left for k, rows in a.rows.items() if (left := {r for r in rows if (k, r) in used})})
    return facts.filter(~_of(names - wanted)), kept(axioms), kept(then)


def proofs(derived: Derived, goals: DataFrame) -> DataFrame:
    """(goal, depth, s, p, o, rule, p1, p2): for each goal (s, p, o) that holds, its proof, one row a fact in it.

    Unfolded level by level for all goals at once; ``depth`` is the shortest way from the goal. Goals that do not
    hold have no rows.
    """
    facts = derived.rows.drop("level")
    front, parts = None, []
    wanted = goals.select(*_FACT).distinct().withColumn("goal", F.struct(*_FACT))
    for depth in itertools.count():
        step = wanted.join(facts, _FACT).withColumn("depth", F.lit(depth))
        front = saved(step.select("goal", "depth", *_FACT, "rule", _premise(0).alias("p1"), _premise(1).alias("p2")), "proofs")
        if front.isEmpty() and parts:
            discard(front)
            return gathered(parts, "proofs")
        if front.isEmpty():
            return front
        parts.append(front)
        seen = functools.reduce(lambda a, b: a.unionByName(b), parts)
        below = front.select("goal", F.explode(F.array_compact(F.array("p1", "p2"))).alias("f")).select("goal", "f.*").distinct()
        wanted = below.join(seen.select("goal", *_FACT), ["goal", *_FACT], "left_anti")


def changed(derived: Derived, added: DataFrame, removed: DataFrame, axioms: Axioms | None = None) -> tuple[Derived, DataFrame]:
    """(the facts as ``derive`` would find them, (s, p, o, change)) with facts ``added`` and ``removed`` and with other ``axioms``.

    A stated fact that is taken away stays if it follows. A derived fact may be stated: then that is its proof.
    """
    spark, axioms = added.sparkSession, axioms or derived.axioms
    before, work = derived.rows, []
    # Facts whose proof is gone, then those whose proof rests on one of them.
    gone_axioms, new_axioms = derived.axioms.minus(axioms), axioms.minus(derived.axioms)
    start = saved(_stated(added), "start")
    out = removed.select(*_FACT).distinct().join(start, _FACT, "left_anti")
    lost = before.filter(F.col("rule") == STATED).select(*_FACT).join(out, _FACT, "left_semi")
    if gone_axioms.rows:
        # Facts whose proof may be by such an axiom; one too many is proved again below.
        own = before.filter(F.col("rule").isin(*gone_axioms.rows))
        by_lost = Reasoner(spark, gone_axioms).backward(own, before)
        lost = lost.unionByName(own.join(by_lost, [*_FACT, "rule", "how"], "left_semi").select(*_FACT))
    lost = fresh = saved(lost.select(*_FACT).distinct(), "lost")
    old_reasoner = Reasoner(spark, derived.axioms)
    while True:
        n = fresh.count()
        if not n:
            break
        work.append(n)
        key, names = fresh.select(F.struct(*_FACT).alias("f")), old_reasoner.names(fresh)
        # Only facts that such a premise may conclude are looked at.
        rests = []
        for at in range(2):
            heads, rules = old_reasoner.above(names, at)
            if heads:
                own = _named(before, heads).filter(F.col("rule").isin(*sorted(rules)))
                rests.append(own.select(*_FACT, _premise(at).alias("f")).join(key, "f", "left_semi").select(*_FACT))
        if not rests:
            break
        fresh = saved(_union(rests).distinct().join(lost, _FACT, "left_anti"), "lost")
        lost = lost.unionByName(fresh)
    # Newly stated facts, and lost ones with another proof from what is kept.
    reasoner = Reasoner(spark, axioms)
    level = (before.agg(F.max("level").alias("l")).first().l or 0) + 1
    touched = saved(lost.unionByName(start.select(*_FACT)).distinct(), "touched")
    # Names of which no fact was touched are kept as they are, without a join.
    names = reasoner.heads | reasoner.bodies | old_reasoner.heads | old_reasoner.bodies
    free = names - reasoner.names(touched) - old_reasoner.names(touched)
    whole = _of({n for n in free if n[0] != TYPE or (TYPE, None) not in names})
    kept = before.filter(~whole).join(touched, _FACT, "left_anti").unionByName(before.filter(whole)).unionByName(start)
    if (derived.changes + 1) % 8 == 0:
        # What is kept is a plan over the facts before, so after some changes they are written once.
        kept = saved(kept, "facts")
    again = reasoner.backward(lost.join(start, _FACT, "left_anti"), kept)
    known = saved(before.select(*_FACT).join(start, _FACT, "left_semi"), "known")
    fresh = start.join(known.join(lost, _FACT, "left_anti"), _FACT, "left_anti")
    if again is not None:
        again = saved(_one_each(again, level), "again")
        kept, fresh = kept.unionByName(again), fresh.unionByName(again)
    if new_axioms.rows:
        first, heads = Reasoner(spark, new_axioms).forward(kept, kept)
        first = saved(_one_each(first, level + 1).join(_named(kept, heads).select(*_FACT), _FACT, "left_anti"), "first")
        kept, fresh = kept.unionByName(first), fresh.unionByName(first)
    fresh = saved(fresh, "fresh")
    work.append(fresh.count())
    now = _rounds(reasoner, kept, fresh, level + 2, work, reasoner.heads | reasoner.bodies)
    # Only lost and new facts can differ. Facts of these levels are not among those kept: they were there before only if they were lost.
    made = now.filter(F.col("level") >= level).select(*_FACT)
    new = made.join(lost, _FACT, "left_anti").unionByName(start.select(*_FACT).join(known, _FACT, "left_anti")).distinct().withColumn("change", F.lit("added"))
    old = lost.distinct().join(made.unionByName(start.select(*_FACT)), _FACT, "left_anti").withColumn("change", F.lit("removed"))
    return Derived(now, axioms, work, derived.changes + 1), new.unionByName(old)
