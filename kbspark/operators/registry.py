"""The registry of entities, relations and instances: ids, guards, listing, and the overlap report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import scalars as S


def normal_label(label: Column) -> Column:
    return S.strip(F.lower(F.coalesce(label, F.lit(""))))


def label_duplicates(entities: DataFrame, order: str = "seq") -> DataFrame:
    """(cluster, first_id, id): every entity whose normalised label came before in its cluster."""
    rows = entities.select("cluster", "id", F.col(order).alias("seq"), normal_label(F.col("label")).alias("norm")).filter("norm <> ''")
    first = rows.groupBy("cluster", "norm").agg(F.min(F.struct("seq", "id")).alias("first"))
    return rows.join(first, ["cluster", "norm"]).filter(F.struct("seq", "id") != F.col("first")).select("cluster", F.col("first.id").alias("first_id"), "id")


def jaccard_overlaps(entities: DataFrame, least: float = 0.7, by: str = "cluster") -> DataFrame:
    """(cluster, a, b, jaccard) of the pairs of a cluster whose token sets overlap by at least ``least``.

    Exact prefix filtering: tokens are ranked by rarity, and a pair at or over the threshold shares one of
    the first ``n - ceil(least * n) + 1`` tokens of both, so frequent tokens almost never form pairs.
    """
    held = entities.select(F.col(by).alias("cluster"), "id", S.label_tokens(F.col("label"), F.col("synonyms")).alias("tokens")).filter(F.size("tokens") > 0)
    words = held.select("cluster", "id", F.explode("tokens").alias("t"))
    rarity = words.groupBy("cluster", "t").agg(F.count("*").alias("df"))
    ranked = words.join(rarity, ["cluster", "t"]).groupBy("cluster", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda x: x["t"]).alias("sorted"))
    n = F.size("sorted")
    prefix = F.slice("sorted", F.lit(1), (n - F.ceil(n * F.lit(least)) + 1).cast("int"))
    left = ranked.select("cluster", "id", "sorted", F.explode(prefix).alias("t"))
    a, b = left.alias("a"), left.alias("b")
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.id") < F.col("b.id")) & (F.size("a.sorted") >= F.size("b.sorted") * least) & (F.size("b.sorted") >= F.size("a.sorted") * least))
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = pairs.select(F.col("a.cluster").alias("cluster"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.sorted").alias("sa"), F.col("b.sorted").alias("sb")).dropDuplicates(["cluster", "a", "b"])
    exact = both / (F.size("sa") + F.size("sb") - both)
    return pairs.withColumn("exact", exact).filter(F.col("exact") >= least).select("cluster", "a", "b", F.bround("exact", 4).alias("jaccard"))


def orphans(entities: DataFrame) -> DataFrame:
    """Entities without evidence."""
    return entities.filter(F.size(F.coalesce("source_refs", F.array().cast("array<string>"))) == 0)


def cross_cluster(relations: DataFrame, members: DataFrame, order: str | None = None) -> DataFrame:
    """Relations (id, source, target) whose ends are known and lie in different clusters; of an id in several clusters the last counts."""
    last = F.max_by("cluster", order) if order else F.max("cluster")
    home = members.groupBy("id").agg(last.alias("cluster"))
    a, b = home.withColumnsRenamed({"id": "source", "cluster": "source_cluster"}), home.withColumnsRenamed({"id": "target", "cluster": "target_cluster"})
    return relations.join(a, "source").join(b, "target").filter("source_cluster <> target_cluster")


def overlap_report(entities: DataFrame, relations: DataFrame, files: DataFrame, least: float = 0.7) -> DataFrame:
    """(cluster, kind, id, other, value) of the five kinds of findings."""
    from kbspark.operators.evidence import missing_notes

    none = F.lit(None).cast("string")
    rows = label_duplicates(entities).select("cluster", F.lit("label_duplicate").alias("kind"), F.col("first_id").alias("id"), F.col("id").alias("other"), F.lit(None).cast("double").alias("value"))
    rows = rows.unionByName(jaccard_overlaps(entities, least).select("cluster", F.lit("jaccard_overlap").alias("kind"), F.col("a").alias("id"), F.col("b").alias("other"), F.col("jaccard").alias("value")))
    plain = lambda df, kind: df.select("cluster", F.lit(kind).alias("kind"), "id", none.alias("other"), F.lit(None).cast("double").alias("value"))
    rows = rows.unionByName(plain(orphans(entities), "orphan_entity")).unionByName(plain(missing_notes(entities, files), "missing_md"))
    crossing = cross_cluster(relations, entities, "seq")
    return rows.unionByName(crossing.select(F.col("source_cluster").alias("cluster"), F.lit("cluster_boundary").alias("kind"), "id", F.col("target_cluster").alias("other"), F.lit(None).cast("double").alias("value")))


def report_score(report: DataFrame) -> DataFrame:
    """One row: the four quarter-weighted flags and their score; missing notes do not count as violations."""
    def clear(*kinds: str) -> Column:
        return F.when(F.count_if(F.col("kind").isin(*kinds)) == 0, 0.25).otherwise(0.0)

    one = report.agg(clear("label_duplicate").alias("labels"), clear("jaccard_overlap").alias("overlap"), clear("orphan_entity").alias("evidence"), clear("cluster_boundary").alias("boundary"))
    return one.withColumn("score", F.col("labels") + F.col("overlap") + F.col("evidence") + F.col("boundary"))


def suffixed_ids(rows: DataFrame, base: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """Adds ``id``: the base, then base_2, base_3 and so on in order, around the ids that ``existing`` (id) holds or that a base is already."""
    taken = rows.select(F.col(base).alias("id")).distinct()
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(base).orderBy(order)))
    if existing is None:
        used = taken.filter("false")
    else:
        used = existing.select("id").distinct()
    # Numbers of a base that are taken, by an existing id or by another base that looks like a suffixed one.
    known = used.unionByName(taken.filter(F.col("id").rlike(r"_[0-9]+$"))).distinct()
    split = known.select("id", F.regexp_extract("id", r"^(.*)_([0-9]+)$", 1).alias("b"), F.regexp_extract("id", r"^(.*)_([0-9]+)$", 2).alias("k"))
    numbers = split.filter("b <> '' and k rlike '^([2-9]|[1-9][0-9]+)$'").select(F.col("b").alias(base), F.col("k").cast("int").alias("k"))
    numbers = numbers.unionByName(used.select(F.col("id").alias(base), F.lit(1).alias("k")))
    gone = numbers.groupBy(base).agg(F.sort_array(F.collect_set("k")).alias("gone"))
    out = numbered.join(gone, base, "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    # The n-th free number: step over each taken number that is not above it.
    free = F.aggregate("gone", F.col("_n").cast("int"), lambda n, g: F.when(g <= n, n + 1).otherwise(n))
    out = out.withColumn("_k", free)
    return out.withColumn("id", F.when(F.col("_k") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), F.col("_k")))).drop("_n", "_k", "gone")


def relation_id(source: Column, predicate: Column, target: Column) -> Column:
    bare = lambda c: F.regexp_replace(c, "^(entity|instance):", "")
    return F.concat(F.lit("rel:"), bare(source), F.lit(":"), predicate, F.lit(":"), bare(target))


def guard_additions(new: DataFrame, entities: DataFrame, order: str | None = None) -> DataFrame:
    """``new`` (kind, label, cluster, source, target, type, source_refs) with ``rejected``: the reason, or null.

    A label is taken by an entity of the registry, or by the first entity of the batch (by ``order``, else as the
    rows lie) that nothing else speaks against.
    """
    from kbspark.operators.reasoning import saved

    known = entities.select("cluster", normal_label(F.col("label")).alias("norm")).distinct().withColumn("_dup", F.lit(True))
    rows = new.withColumn("norm", normal_label(F.col("label"))).join(known, ["cluster", "norm"], "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(F.size(F.coalesce("source_refs", F.array().cast("array<string>"))) == 0, "evidence_required")
        .when((F.col("kind") == "entity") & F.col("_dup").isNotNull(), "duplicate_label")
        .when((F.col("kind") == "relation") & (empty("source") | empty("target")), "relation_needs_ends")
        .when((F.col("kind") == "instance") & empty("type"), "instance_needs_type")
    )
    rows = saved(rows.withColumn("rejected", reason).withColumn("_row", F.monotonically_increasing_id()), "additions")
    place = F.struct(order, "_row") if order else F.struct("_row")
    wanted = rows.filter((F.col("kind") == "entity") & F.col("rejected").isNull())
    first = wanted.groupBy("cluster", "norm").agg(F.min_by("_row", place).alias("_first"))
    later = wanted.join(first, wanted["cluster"].eqNullSafe(first["cluster"]) & (wanted["norm"] == first["norm"]) & (wanted["_row"] != first["_first"])).select("_row", F.lit("duplicate_label").alias("_late"))
    return rows.join(later, "_row", "left").withColumn("rejected", F.coalesce("rejected", "_late")).drop("norm", "_dup", "_row", "_late")


def list_all(entities: DataFrame, relations: DataFrame, instances: DataFrame, cluster: str | None = None, kind: str | None = None) -> DataFrame:
    """Records of all kinds with ``_kind``."""
    parts = [df.withColumn("_kind", F.lit(k)) for k, df in (("entity", entities), ("relation", relations), ("instance", instances)) if kind in (None, k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.filter(F.col("cluster") == cluster) if cluster else out


def registry_violations(records: DataFrame, id_pattern: str, required: tuple[str, ...]) -> DataFrame:
    """(file, id, rule): required fields, id pattern, ids unique within a file, evidence pattern."""
    rules = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing:{c}")) for c in required]
    rules.append(F.when(~F.col("id").rlike(id_pattern), F.lit("pattern:id")))
    rules.append(F.when(F.exists(F.coalesce("source_refs", F.array().cast("array<string>")), lambda r: ~r.rlike("^evidence:seed:")), F.lit("pattern:source_refs")))
    broken = records.select("file", "id", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("rule"))
    repeated = records.groupBy("file", "id").agg(F.count("*").alias("n")).filter("n > 1").select("file", "id", F.lit("duplicate:id").alias("rule"))
    return broken.unionByName(repeated)
