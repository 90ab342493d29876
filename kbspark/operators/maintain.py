"""Maintenance: drift and orphan findings, cluster evaluation, readiness, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import scalars as S
from kbspark.model import ACCEPTED

_NO_REFS = "array<string>"


def _finding(df: DataFrame, kind: str, id_: str | None, path: str | None, cluster: str | None = "cluster") -> DataFrame:
    col = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    return df.select(F.lit(kind).alias("kind"), col(cluster).alias("cluster"), col(id_).alias("id"), col(path).alias("path"))


def dangling_refs(entities: DataFrame, seeds: DataFrame, prefix: str = "evidence:seed:") -> DataFrame:
    """(cluster, id, ref): references with the seed prefix that name no seed, one row each."""
    refs = entities.select("cluster", "id", F.explode(F.coalesce("source_refs", F.array().cast(_NO_REFS))).alias("ref")).filter(F.col("ref").startswith(prefix))
    return refs.join(seeds.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti").select("cluster", "id", "ref")


def drift(entities: DataFrame, files: DataFrame, seeds: DataFrame) -> DataFrame:
    """Findings of entities (with dir_cluster) against notes (path, cluster): kind, cluster, id, path."""
    own = entities.withColumn("cluster_", F.col("dir_cluster"))
    no_md = own.join(files.select(F.col("path").alias("md_path")).distinct(), "md_path", "left_anti").filter("md_path is not null")
    found = _finding(no_md, "jsonl_without_md", "id", "md_path", "cluster_")
    no_row = files.join(own.select(F.col("cluster_").alias("cluster"), F.col("md_path").alias("path")).distinct(), ["cluster", "path"], "left_anti")
    found = found.unionByName(_finding(no_row, "md_without_jsonl", None, "path"))
    loose = dangling_refs(own.withColumn("cluster", F.col("cluster_")), seeds)
    found = found.unionByName(_finding(loose, "evidence_dangling", "id", "ref"))
    moved = own.filter(F.coalesce("cluster", "dir_cluster") != F.col("dir_cluster"))
    return found.unionByName(_finding(moved, "cluster_mismatch", "id", "md_path", "cluster_"))


def stale_blocks(entities: DataFrame, files: DataFrame, start: str, end: str, block_hash: str = "expected_hash") -> DataFrame:
    """Entities whose note holds a generated block with another hash than ``expected_hash``."""
    held = files.select(F.col("path").alias("md_path"), F.sha2(S.strip(S.generated_block(F.col("text"), start, end)), 256).alias("_h")).filter("_h is not null")
    return entities.join(held, "md_path").filter(F.col("_h") != F.col(block_hash)).drop("_h")


def endpoints(relations: DataFrame) -> DataFrame:
    """(id) of both ends of relations, in any of their dialects."""
    have = set(relations.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have])
    a = pick("source", "subject_id", "source_entity_id")
    b = pick("target", "object_id", "target_entity_id")
    return relations.select(F.explode(F.array(a, b)).alias("id")).filter("id is not null").distinct()


def orphan_findings(entities: DataFrame, relations: DataFrame, files: DataFrame, evidence_files: DataFrame, seeds: DataFrame) -> DataFrame:
    """Notes that no entity names, evidence files that no seed names, accepted entities that no relation names."""
    md = files.join(entities.select(F.col("md_path").alias("path")).distinct(), "path", "left_anti")
    found = _finding(md, "md_orphan", None, "path")
    loose = evidence_files.join(seeds.select(F.col("md_path").alias("path")).distinct(), "path", "left_anti")
    found = found.unionByName(_finding(loose, "seed_orphan", None, "path", None))
    alone = entities.filter(F.col("status").isin(*ACCEPTED)).join(endpoints(relations), "id", "left_anti")
    return found.unionByName(_finding(alone, "no_incoming_relation", "id", "md_path"))


def sorted_findings(findings: DataFrame) -> DataFrame:
    """Findings by kind, id and path; what has none goes first."""
    return findings.orderBy(*_place())


def _place() -> list[Column]:
    return [F.coalesce(c, F.lit("")) for c in ("kind", "id", "path")]


def with_place(ordered: DataFrame) -> DataFrame:
    """Ordered findings with ``at``, their place: counted within each range of the order, plus the rows of the ranges before."""
    from kbspark.operators.reasoning import saved

    held = saved(ordered.withColumn("_range", F.spark_partition_id()), "findings")
    sizes = held.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row a range, at most as many as there are partitions.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*_place()))
    out = held.withColumn("_k", rank).join(sizes.select("_range", before.alias("_before")), "_range")
    return out.withColumn("at", (F.col("_before") + F.col("_k") - 1).cast("int")).drop("_range", "_k", "_before")


def cluster_eval(entities: DataFrame, relations: DataFrame, instances: DataFrame) -> DataFrame:
    """Per cluster: counts, status_dist, evidence_coverage, relation_density (rounded half-even to 3)."""
    status = entities.groupBy("cluster", F.coalesce("status", F.lit("draft")).alias("status")).agg(F.count("*").alias("n"), F.count_if(F.size(F.coalesce("source_refs", F.array().cast(_NO_REFS))) > 0).alias("k"))
    ent = status.groupBy("cluster").agg(F.sum("n").alias("entities"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_dist"), F.sum("k").alias("k"))
    rel = relations.groupBy("cluster").agg(F.count("*").alias("relations"))
    ins = instances.groupBy("cluster").agg(F.count("*").alias("instances"))
    out = ent.join(rel, "cluster", "full").join(ins, "cluster", "full").fillna(0, ["entities", "relations", "instances", "k"])
    none = F.create_map().cast("map<string,bigint>")
    return out.select(
        "cluster", "entities", "relations", "instances", F.coalesce("status_dist", none).alias("status_dist"),
        F.bround(F.coalesce(F.try_divide(F.col("k").cast("double"), F.col("entities")), F.lit(0.0)), 3).alias("evidence_coverage"),
        F.bround(F.col("relations") / F.greatest("entities", F.lit(1)), 3).alias("relation_density"),
    )


def drift_readiness(evaluation: DataFrame, drift_count: int | Column, orphan_count: int | Column, hub_locked: bool) -> DataFrame:
    """One row: five weighted flags and the score; coverage averages clusters with entities, density all."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    coverage = F.coalesce(F.avg(F.when(F.col("entities") > 0, F.col("evidence_coverage"))), F.lit(0.0))
    one = evaluation.agg(coverage.alias("coverage"), F.coalesce(F.avg("relation_density"), F.lit(0.0)).alias("density"))
    flags = {
        "no_drift": F.when(lit(drift_count) == 0, 0.40), "no_orphan": F.when(lit(orphan_count) == 0, 0.20), "covered": F.when(F.col("coverage") >= 0.80, 0.20),
        "dense": F.when(F.col("density") >= 0.5, 0.10), "locked": F.when(F.lit(hub_locked), 0.10),
    }
    out = one.select("coverage", "density", *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in flags.items()])
    return out.withColumn("score", F.bround(sum((F.col(k) for k in flags), F.lit(0.0)), 3))


def scan_totals(events: DataFrame, since: str | None = None) -> DataFrame:
    """Totals over scan events; events without a readable date are kept."""
    rows = events.filter("event_type = 'scan_complete'")
    rows = rows.filter(S.since(F.col("ts"), since)) if since else rows
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c)
    return rows.agg(F.count("*").alias("scans"), total("drift"), total("orphan"), total("auto_fixes"))


def plan_fixes(findings: DataFrame, fixable: tuple[str, ...] = ("jsonl_without_md",)) -> DataFrame:
    """Findings with ``action``: the automatic fix where there is one, else review by a person."""
    return findings.withColumn("action", F.when(F.col("kind").isin(*fixable), "create_md_placeholder").otherwise("human_review"))


def guard_bulk(plan: DataFrame, most: int = 100) -> DataFrame:
    """The automatic fixes of a plan; raises if there are ``most`` or more."""
    fixes = plan.filter("action <> 'human_review'")
    if len(fixes.limit(most).collect()) >= most:
        raise ValueError(f"{most} automatic fixes or more: the plan needs a person's consent")
    return fixes


def top_per_rule(rows: DataFrame, rule: str, order: list[str], most: int = 30) -> DataFrame:
    """At most ``most`` rows of each rule, with their rank."""
    w = Window.partitionBy(rule).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def survival(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """One row: records before, those still there after, and the rate."""
    kept = before.select(key).distinct().join(after.select(key).distinct().withColumn("_k", F.lit(1)), key, "left")
    return kept.agg(F.count("*").alias("before"), F.count("_k").alias("kept"), F.bround(F.coalesce(F.try_divide(F.count("_k"), F.count("*")), F.lit(0.0)), 3).alias("rate"))


def rule_groups(rows: DataFrame, rule: str = "rule", order: list[str] = ("file",), most: int = 30) -> DataFrame:
    """Findings by rule, larger rules first: ``n`` rows of the rule, its ``place`` among rules, and of each at most ``most`` with their rank.

    A rule's rows are counted before they are shuffled; the places are those of the few rules there are.
    """
    sizes = rows.groupBy(rule).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), rule)))
    return top_per_rule(rows, rule, list(order), most).join(F.broadcast(sizes), rule)


def evolution(log: DataFrame, period: Column, kind: str = "kind", id_: str = "id", at: str = "at", action: str = "action") -> DataFrame:
    """(kind, period, added, kept, survival, removals, drift) of a log of ``added`` and ``removed`` records.

    Of the records first added in a period: how many, how many of these the log's last word has not removed, and
    their share. ``removals``: records removed in the period, ``drift`` their share of all that the period changed.
    A record that is only ever removed belongs to no period's additions; actions of other names change nothing.
    """
    rows = log.select(F.col(kind).alias("kind"), F.col(id_).alias("id"), F.col(at).alias("at"), F.col(action).alias("action"), period.alias("period")).filter(F.col("action").isin("added", "removed"))
    own = rows.groupBy("kind", "id").agg(F.min_by("period", F.when(F.col("action") == "added", F.col("at"))).alias("period"), F.max_by("action", F.struct("at", "action")).alias("last"))
    born = own.filter("period is not null").groupBy("kind", "period").agg(F.count("*").alias("added"), F.count_if(F.col("last") == "added").alias("kept"))
    moved = rows.groupBy("kind", "period").agg(F.count_if(F.col("action") == "removed").alias("removals"), F.count("*").alias("changes"))
    share = lambda a, b: F.bround(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 3)
    out = moved.join(born, ["kind", "period"], "left").fillna(0, ["added", "kept"])
    return out.select("kind", "period", "added", "kept", share(F.col("kept"), F.col("added")).alias("survival"), "removals", share(F.col("removals"), F.col("changes")).alias("drift"))
