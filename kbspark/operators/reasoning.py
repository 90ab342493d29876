"""Rule reasoning over triples by semi-naive fixpoints.

Facts: types (x, c) and props (x, p, y). Rules: subclass, sufficient conditions, subproperty, inverse,
symmetric, transitive, chain, domain, range. Each round joins only the newest facts with all facts, drops
what is known, and is written to the shared folder, so lineage stays short and lost executors cost one
round. Facts are finite, so rounds end by themselves; a cap, where one is given, raises and cuts nothing short.
"""

from __future__ import annotations

import functools
import itertools
import re
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Rules:
    """Axioms. ``conditions``: (class, is_a or None, ((property, range class), ...)); ``chains``: ((r, s, ...), t)."""

    subclass: list[tuple[str, str]] = field(default_factory=list)
    conditions: list[tuple] = field(default_factory=list)
    subproperty: list[tuple[str, str]] = field(default_factory=list)
    inverse: list[tuple[str, str]] = field(default_factory=list)
    symmetric: list[str] = field(default_factory=list)
    transitive: list[str] = field(default_factory=list)
    chains: list[tuple[tuple[str, ...], str]] = field(default_factory=list)
    domain: list[tuple[str, str]] = field(default_factory=list)
    range: list[tuple[str, str]] = field(default_factory=list)


#: With this setting the shuffle files of an action are deleted when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again; shuffle files of the writing are deleted with its end."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of ``saved`` that nothing will read again; other frames are left alone."""
    for table in tables:
        path = table.__dict__.pop("_written_at", None) if table is not None else None
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def gathered(parts: list[DataFrame], name: str) -> DataFrame:
    """Tables of ``saved`` as one of them; the parts are deleted."""
    if len(parts) == 1:
        return parts[0]
    out = saved(functools.reduce(lambda a, b: a.unionByName(b), parts), name)
    discard(*parts)
    return out


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kbspark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _mapped(spark: SparkSession, pairs: list[tuple[str, str]], a: str, b: str) -> DataFrame:
    # Axiom lists come from the caller's code or ontology files, never from the facts. A join on their few names would put most facts in one task.
    return F.broadcast(spark.createDataFrame(pairs, f"{a} string, {b} string"))


def _new_props(delta: DataFrame, full: DataFrame, rules: Rules) -> DataFrame:
    """Property facts (x, p, y) that follow in one step with at least one fact from ``delta``."""
    spark, parts = delta.sparkSession, []
    renames = [*rules.subproperty]
    if renames:
        parts.append(delta.join(_mapped(spark, renames, "p", "q"), "p").select("x", F.col("q").alias("p"), "y"))
    swaps = [*rules.inverse, *[(b, a) for a, b in rules.inverse], *[(p, p) for p in rules.symmetric]]
    if swaps:
        parts.append(delta.join(_mapped(spark, sorted(set(swaps)), "p", "q"), "p").select(F.col("y").alias("x"), F.col("q").alias("p"), F.col("x").alias("y")))
    if rules.transitive:
        d, f = delta.filter(F.col("p").isin(rules.transitive)), full.filter(F.col("p").isin(rules.transitive))
        for left, right in ((d, f), (f, d)):
            a, b = left.select("x", "p", F.col("y").alias("m")), right.select(F.col("x").alias("m"), "p", "y")
            parts.append(a.join(b, ["m", "p"]).select("x", "p", "y"))
    for chain, target in rules.chains:
        for newest in range(len(chain)):
            path = None
            for at, p in enumerate(chain):
                link = (delta if at == newest else full).filter(F.col("p") == p)
                if path is None:
                    path = link.select("x", F.col("y").alias("m"))
                else:
                    path = path.join(link.select(F.col("x").alias("m"), F.col("y").alias("n")), "m").select("x", F.col("n").alias("m")).distinct()
            parts.append(path.select("x", F.lit(target).alias("p"), F.col("m").alias("y")))
    return _union(parts, delta.filter("false"))


def _union(parts: list[DataFrame], none: DataFrame) -> DataFrame:
    for p in parts:
        none = none.unionByName(p)
    return none


def once(rows: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Each of the rows of ``keys`` once, dealt by the columns ``by`` of them. Rows meet their like after the shuffle only, so a task holds those of its part, not of a whole split of a file."""
    return rows.select(*keys).repartition(*(by or keys)).distinct()


def _fixpoint(start: DataFrame, step, keys: list[str], rounds: int | None, name: str) -> DataFrame:
    full = delta = saved(once(start, keys), name)
    parts = [full]
    for turn in itertools.count(1):
        fresh = once(step(delta, full), keys).join(full, keys, "left_anti")
        delta = saved(fresh, name)
        if delta.isEmpty():
            discard(delta)
            return gathered(parts, name)
        if turn == rounds:
            raise RuntimeError(f"no fixpoint after {rounds} rounds")
        full = full.unionByName(delta)
        parts.append(delta)
        if turn % 16 == 0:
            # One table again instead of one for each round; the newest facts stay a table of their own.
            full = gathered(parts[:-1], name)
            parts = [full, delta]
            full = full.unionByName(delta)


def close_properties(props: DataFrame, rules: Rules, rounds: int | None = None) -> DataFrame:
    """All property facts that follow from ``props`` (x, p, y)."""
    if not (rules.subproperty or rules.inverse or rules.symmetric or rules.transitive or rules.chains):
        return once(props, ["x", "p", "y"])
    return _fixpoint(props, lambda d, f: _new_props(d, f, rules), ["x", "p", "y"], rounds, "props")


def close_types(types: DataFrame, props: DataFrame, rules: Rules, rounds: int | None = None) -> DataFrame:
    """All type facts that follow from ``types`` (x, c) given the closed ``props``."""
    spark = types.sparkSession
    seeds = [types.select("x", "c")]
    for pairs, end in ((rules.domain, "x"), (rules.range, "y")):
        if pairs:
            # Spread by whole facts: however often an individual occurs, its rows lie in many tasks.
            seeds.append(props.repartition("x", "p", "y").join(_mapped(spark, pairs, "p", "c"), "p").select(F.col(end).alias("x"), "c").distinct())
    if not (rules.subclass or rules.conditions):
        return _union(seeds, types.select("x", "c").filter("false")).distinct()

    def step(delta: DataFrame, full: DataFrame) -> DataFrame:
        parts = []
        if rules.subclass:
            parts.append(delta.join(_mapped(spark, rules.subclass, "c", "d"), "c").select("x", F.col("d").alias("c")))
        for cls, is_a, wanted in rules.conditions:
            def holds(facts: DataFrame, p: str | None, target: str | None) -> DataFrame:
                """(x) for which one of the condition's parts holds by ``facts``."""
                of = facts.filter(F.col("c") == target) if target else facts
                if p is None:
                    return of.select("x").distinct()
                return props.filter(F.col("p") == p).join(of.select(F.col("x").alias("y")).distinct(), "y", "left_semi").select("x").distinct()

            atoms = [(None, is_a), *wanted]
            for newest in range(len(atoms)):
                # One part holds by a newest fact, the others by any.
                found = holds(delta, *atoms[newest])
                for at, atom in enumerate(atoms):
                    if at != newest:
                        found = found.join(holds(full, *atom), "x", "left_semi")
                parts.append(found.select("x", F.lit(cls).alias("c")))
        return _union(parts, delta.filter("false"))

    return _fixpoint(_union(seeds, types.select("x", "c").filter("false")), step, ["x", "c"], rounds, "types")


def reason(types: DataFrame, props: DataFrame, rules: Rules, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(gained types, gained props): what follows and was not asserted."""
    closed = close_properties(props, rules, rounds)
    all_types = close_types(types, closed, rules, rounds)
    return all_types.join(types.select("x", "c").distinct(), ["x", "c"], "left_anti"), closed.join(props.select("x", "p", "y").distinct(), ["x", "p", "y"], "left_anti")


def individual_facts(triples: DataFrame, individuals: DataFrame, properties: DataFrame) -> DataFrame:
    """(x, p, y) of the triples between named individuals over declared object properties."""
    facts = triples.select(F.col("s").alias("x"), "p", F.col("o").alias("y"))
    ind = individuals.select("iri").distinct()
    facts = facts.join(properties.select(F.col("iri").alias("p")).distinct(), "p", "left_semi")
    return facts.join(ind.withColumnRenamed("iri", "x"), "x", "left_semi").join(ind.withColumnRenamed("iri", "y"), "y", "left_semi").select("x", "p", "y")


def delta_records(types: DataFrame, gained_types: DataFrame, gained_props: DataFrame) -> DataFrame:
    """One row for each individual with gains: asserted_types, inferred_types, all_types, inferred_properties."""
    gt = gained_types.groupBy("x").agg(F.array_sort(F.collect_set("c")).alias("inferred_types"))
    per = gained_props.groupBy("x", "p").agg(F.array_sort(F.collect_set("y")).alias("ys"))
    gp = per.groupBy("x").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "ys")))).alias("inferred_properties"))
    asserted = types.groupBy("x").agg(F.array_sort(F.collect_set("c")).alias("asserted_types"))
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string,array<string>>")
    out = gt.join(gp, "x", "full").join(asserted, "x", "left")
    return out.select("x", F.coalesce("asserted_types", none).alias("asserted_types"), F.coalesce("inferred_types", none).alias("inferred_types"), F.array_sort(F.array_union(F.coalesce("asserted_types", none), F.coalesce("inferred_types", none))).alias("all_types"), F.coalesce("inferred_properties", empty).alias("inferred_properties"))


def most_specific(types: DataFrame, subclass: DataFrame) -> DataFrame:
    """Type facts without those that a more specific type of the same individual entails (``subclass``: closed (c, d))."""
    above = types.join(subclass, "c").select("x", F.col("d").alias("c")).distinct()
    return types.join(above, ["x", "c"], "left_anti")


def characteristic_violations(props: DataFrame, functional=(), inverse_functional=(), asymmetric=(), irreflexive=()) -> DataFrame:
    """(rule, p, x): facts that break a characteristic."""
    pick = lambda names: props.filter(F.col("p").isin(list(names)))
    row = lambda df, rule: df.select(F.lit(rule).alias("rule"), "p", "x")
    out = row(pick(functional).groupBy("p", "x").agg(F.countDistinct("y").alias("n")).filter("n > 1"), "functional")
    out = out.unionByName(row(pick(inverse_functional).groupBy("p", F.col("y").alias("x")).agg(F.countDistinct(props["x"]).alias("n")).filter("n > 1"), "inverse_functional"))
    a = pick(asymmetric).select("p", "x", "y").distinct()
    out = out.unionByName(row(a.join(a.select("p", F.col("y").alias("x"), F.col("x").alias("y")), ["p", "x", "y"], "left_semi"), "asymmetric"))
    return out.unionByName(row(pick(irreflexive).filter("x = y"), "irreflexive"))


def undeclared_roles(props: DataFrame, roles: DataFrame) -> DataFrame:
    """(p, uses): properties in use between individuals that no role declares."""
    return props.groupBy("p").agg(F.count("*").alias("uses")).join(roles.select(F.col("name").alias("p")).distinct(), "p", "left_anti")


def draft_roles_in_use(props: DataFrame, roles: DataFrame) -> DataFrame:
    return props.groupBy("p").agg(F.count("*").alias("uses")).join(roles.select(F.col("name").alias("p"), "status"), "p").filter(~F.col("status").isin("accepted", "stable"))


def alias_collisions(roles: DataFrame) -> DataFrame:
    """(name, alias, other): aliases whose snake form is another role's name."""
    from kbspark.functions.scalars import role_snake

    a = roles.select("name", F.explode("aliases").alias("alias")).withColumn("other", role_snake(F.col("alias")))
    return a.join(roles.select(F.col("name").alias("other")), "other").filter("name <> other").select("name", "alias", "other")


def axiom_violations(axioms: DataFrame, roles: DataFrame) -> DataFrame:
    """(role, rule, ref): axioms (role, refs, chain) over undeclared roles, and chains shorter than two."""
    known = roles.select(F.col("name").alias("ref")).distinct()
    refs = axioms.select("role", F.explode(F.array_union(F.array("role"), F.coalesce("refs", F.array().cast("array<string>")))).alias("ref"))
    out = refs.join(known, "ref", "left_anti").select("role", F.lit("undeclared").alias("rule"), "ref")
    short = axioms.filter(F.col("chain").isNotNull() & (F.size("chain") < 2)).select("role", F.lit("chain_too_short").alias("rule"), F.array_join("chain", ",").alias("ref"))
    return out.unionByName(short)
