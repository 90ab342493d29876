"""Checks on the labels of a registry: their lengths, and labels that are nearly the same.

Near-equal labels are found by partitions: a label cut into ``distance + 1`` segments keeps at least one of them
whole under ``distance`` edits, at a place that is shifted by no more edits than its side can hold. So every
label posts its segments under (length, segment, text), and asks, for each length it could be near to, for the
few pieces of its own that may be such a segment. The join on those keys is exact after the verification, which
is part of it: no unverified pair is a row. Equal labels are one label here; what repeats is ``label_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.operators.registry import label_duplicates, normal_label

LEAST_LENGTH, MOST_LENGTH, DISTANCE = 2, 80, 2


def _segments(labels: DataFrame, length: Column, parts: int) -> DataFrame:
    """One row a segment of a label of ``length``: its number, place (from 0) and size; the last ones are the longer."""
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    out = labels.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    extra = F.greatest(F.col("part") - (F.lit(parts) - longer), F.lit(0))
    return out.withColumn("place", (F.col("part") * base + extra).cast("int")).withColumn("size", base + F.when(F.col("part") >= F.lit(parts) - longer, 1).otherwise(0))


def _piece(place: Column, size: Column) -> Column:
    return F.substring(F.col("norm"), place + F.lit(1), size)


def near_labels(entities: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(cluster, a, b, edits): different normalised labels of a cluster that at most ``distance`` edits tell apart, a < b.

    Entities without a label take no part; a null cluster is a cluster.
    """
    if distance < 1:
        raise ValueError("equal labels are no pairs: the distance must be 1 or more")
    k = F.lit(distance)
    labels = entities.select(F.coalesce("cluster", F.lit("")).alias("cluster"), normal_label(F.col("label")).alias("norm")).filter("norm <> ''").distinct().withColumn("length", F.length("norm"))
    own = _segments(labels, F.col("length"), distance + 1)
    own = own.select("cluster", F.col("length").alias("near"), "part", _piece(F.col("place"), F.col("size")).alias("piece"), F.col("norm").alias("a"))
    # Only labels that are not longer are asked for: each pair comes up from one side.
    asked = labels.withColumn("near", F.explode(F.sequence(F.greatest(F.col("length") - k, F.lit(1)), F.col("length"))))
    asked = _segments(asked, F.col("near"), distance + 1)
    more = F.col("length") - F.col("near")
    first = F.greatest(F.lit(0), F.col("place") - F.col("part"), F.col("place") + more - (k - F.col("part")))
    last = F.least(F.col("length") - F.col("size"), F.col("place") + F.col("part"), F.col("place") + more + (k - F.col("part")))
    asked = asked.withColumn("lo", first).withColumn("hi", last).filter("lo <= hi").withColumn("at", F.explode(F.sequence("lo", "hi")))
    asked = asked.select("cluster", "near", "part", _piece(F.col("at"), F.col("size")).alias("piece"), F.col("norm").alias("b"), "length").distinct()
    edits = F.levenshtein("a", "b", distance)
    once = (F.col("near") < F.col("length")) | (F.col("a") < F.col("b"))
    met = asked.join(own, ["cluster", "near", "part", "piece"]).filter(once & (F.col("a") != F.col("b")) & (edits >= 0))
    return met.select("cluster", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), edits.alias("edits")).distinct()


def length_findings(entities: DataFrame, least: int = LEAST_LENGTH, most: int = MOST_LENGTH) -> DataFrame:
    """(cluster, kind, id, detail): labels that are missing, too short or too long after normalising."""
    n = F.length(normal_label(F.col("label")))
    kind = F.when(n == 0, "label_missing").when(n < least, "label_too_short").when(n > most, "label_too_long")
    return entities.select("cluster", kind.alias("kind"), "id", n.cast("string").alias("detail")).filter("kind is not null")


def redundancy_findings(entities: DataFrame, distance: int = DISTANCE, order: str = "seq") -> DataFrame:
    """(cluster, kind, id, detail): entities whose label another has, or nearly has; ``detail`` is that other id, or label and edits."""
    same = label_duplicates(entities, order).select("cluster", F.lit("label_duplicate").alias("kind"), "id", F.col("first_id").cast("string").alias("detail"))
    held = entities.select(F.coalesce("cluster", F.lit("")).alias("cluster"), "id", normal_label(F.col("label")).alias("b"))
    near = near_labels(entities, distance).join(held, ["cluster", "b"])
    return same.unionByName(near.select("cluster", F.lit("label_near").alias("kind"), "id", F.concat("a", F.lit(": "), F.col("edits").cast("string")).alias("detail")))
