"""Hierarchy alignment of notes: every directory has one anchor, and its notes belong to it.

Input: notes (dir relative to the root, name, stem, body, level, entity, relations array<struct<type,target>>).
Output rows: rule, severity, file (or directory), detail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import scalars as S

UNCLASSIFIED = "unclassified"
MAX_NAMES, DEEP = 10, 5


def _row(df: DataFrame, rule: str, severity, file, detail) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(rule).alias("rule"), severity.alias("severity"), file.alias("file"), detail.cast("string").alias("detail"))


def prepared(notes: DataFrame) -> DataFrame:
    leaf = F.substring_index("dir", "/", -1)
    return notes.filter("dir <> ''").withColumns(
        {
            "leaf": leaf, "is_entity": S.is_entity_file(F.col("name")), "is_class": F.col("name").endswith("__class.md"), "is_hub": F.col("name").endswith("__hub.md"),
            "want_class": F.concat(leaf, F.lit("__class")), "want_hub": F.concat(leaf, F.lit("__hub")), "file": F.concat("dir", F.lit("/"), "name"),
            "parents": F.filter(F.coalesce("relations", F.array().cast("array<struct<type:string,target:string>>")), lambda r: r["type"] == "belongs_to"),
        }
    )


def parent_existence(p: DataFrame, accept_hub: bool = True) -> DataFrame:
    dirs = p.filter(F.col("leaf") != UNCLASSIFIED).groupBy("dir", "leaf").agg(
        F.count_if("is_entity").alias("n"), F.bool_or(F.col("stem") == F.col("want_class")).alias("has_class"), F.bool_or(F.col("stem") == F.col("want_hub")).alias("has_hub")
    )
    bad = dirs.filter("n > 0 and not has_class")
    severity = F.when(F.lit(accept_hub) & F.col("has_hub"), "warning").otherwise("error")
    return _row(bad, "parent_existence", severity, F.col("dir"), F.concat("leaf", F.lit("__class.md")))


def naming_consistency(p: DataFrame, accept_hub: bool = True) -> DataFrame:
    wrong = F.col("is_class") & (F.col("stem") != F.col("want_class"))
    if accept_hub:
        wrong = wrong | (F.col("is_hub") & (F.col("stem") != F.col("want_hub")))
    return _row(p.filter(F.col("leaf") != UNCLASSIFIED).filter(wrong), "naming_consistency", "error", F.col("file"), F.concat("want_class", F.lit(".md")))


def belongs_to(p: DataFrame) -> DataFrame:
    """Missing parent, several parents, first parent that does not mention the directory's anchor."""
    notes = p.filter("is_entity").filter(F.col("leaf") != UNCLASSIFIED)
    n, target = F.size("parents"), F.coalesce(F.try_element_at("parents", F.lit(1))["target"], F.lit(""))
    missing = _row(notes.filter(n == 0), "belongs_to_missing", "error", F.col("file"), F.col("want_class"))
    several = _row(notes.filter(n > 1), "multiple_parents", "error", F.col("file"), n)
    other = notes.filter((n > 0) & ~target.contains(F.col("want_class")) & ~target.contains(F.col("want_hub")))
    return missing.unionByName(several).unionByName(_row(other, "belongs_to_mismatch", "warning", F.col("file"), target))


def self_reference(p: DataFrame) -> DataFrame:
    anchors = p.filter("is_class or is_hub")
    own = F.coalesce(F.nullif("entity", F.lit("")), F.col("stem"))
    ids = F.transform("parents", lambda r: S.wikilink_id(F.coalesce(r["target"], F.lit(""))))
    hit = F.try_element_at(F.filter(ids, lambda i: (i != "") & ((i == own) | (i == F.col("stem")))), F.lit(1))
    return _row(anchors.withColumn("hit", hit).filter("hit is not null"), "self_reference", "error", F.col("file"), F.col("hit"))


def parent_index(p: DataFrame) -> DataFrame:
    """Anchors whose body does not mention some note of their directory: the first names and the count."""
    anchors = p.filter("is_class or is_hub").select("dir", "file", "body")
    children = p.filter("is_entity").select("dir", F.col("name").alias("child"), F.col("stem").alias("child_stem"))
    lacking = anchors.join(children, "dir").filter(~F.contains(F.coalesce("body", F.lit("")), F.col("child_stem")))
    # Spark keeps the first names of each task before it shuffles, so a large directory is never gathered.
    first = lacking.select("file", "child").withColumn("at", F.row_number().over(Window.partitionBy("file").orderBy("child"))).filter(F.col("at") <= MAX_NAMES)
    names = first.groupBy("file").agg(F.array_sort(F.collect_list("child")).alias("names"))
    per = lacking.groupBy("file").agg(F.count("*").alias("n")).join(names, "file")
    return _row(per, "parent_index_missing", "warning", F.col("file"), F.concat(F.col("n").cast("string"), F.lit(": "), F.array_join("names", ",")))


def level_check(p: DataFrame) -> DataFrame:
    """Depth of five or more warns; else a declared level that differs from the depth."""
    anchors = p.filter("is_class or is_hub").withColumn("depth", S.path_depth(F.col("dir"))).withColumn("want", S.inferred_level(F.col("dir")))
    deep = _row(anchors.filter(F.col("depth") >= DEEP), "deep_nesting", "warning", F.col("file"), F.col("want"))
    other = anchors.filter((F.col("depth") < DEEP) & (F.coalesce("level", F.lit("")) != "") & (F.col("level") != F.col("want")))
    return deep.unionByName(_row(other, "level_mismatch", "warning", F.col("file"), F.concat("level", F.lit("->"), "want")))


def scan(notes: DataFrame, accept_hub: bool = True) -> DataFrame:
    """All rules over the directories that have entity notes or an anchor."""
    p = prepared(notes)
    rules = [parent_existence(p, accept_hub), naming_consistency(p, accept_hub), belongs_to(p), self_reference(p), parent_index(p), level_check(p)]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def summary(violations: DataFrame) -> DataFrame:
    """Counts by rule, by severity and in all."""
    return violations.groupingSets([["rule"], ["severity"], []], "rule", "severity").agg(F.count("*").alias("n")).select("rule", "severity", "n")
