"""Readers for the files of a knowledge base: JSON lines, graphs, notes, directories, snapshots, run logs.

All go through Spark's readers, so any store that Spark can read works. A path that matches nothing is an
empty table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark import model
from kbspark.functions import scalars as S


def _matches(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return bool(found)


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "DROPMALFORMED") -> DataFrame:
    """JSON lines of files and of the batches of a log; ``mode``: DROPMALFORMED drops bad lines, FAILFAST raises at the first one."""
    if not _matches(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", mode).option("recursiveFileLookup", "true").json(path)


_LINE = "file string, block long, line_no long, line string"
#: Bytes of splits that one task reads at most, where splits are smaller, and the least number of tasks for each core.
TASK_BYTES, TASKS_A_CORE = 8 << 20, 8


def _tasks(spark: SparkSession, splits: int) -> int:
    """Tasks that read so many splits: small ones are read several to a task, for a task costs far more than a small split."""
    size = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return min(splits, max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, -(-splits * min(size, TASK_BYTES) // TASK_BYTES)))


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line_no (from 1), line of text files, blank lines included; files are read in splits of any size.

    Lines are counted by split, the counts summed along each file (as many rows as there are splits), and each
    split's lines numbered where they lie: no file is one row or one task's. Rows of a split (its place in the
    file is ``block``) follow each other in order within one partition. Both passes read by one plan of one
    listing; should the splits still be dealt otherwise, the read fails instead of numbering wrongly.
    """
    if not _matches(spark, path):
        return spark.createDataFrame([], _LINE)
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    # Splits that share a task follow each other, each with the rows and places it has alone.
    splits = read.rdd.getNumPartitions()
    if _tasks(spark, splits) < splits:
        read = read.coalesce(_tasks(spark, splits))
    counts = read.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    along = Window.partitionBy("file").orderBy("block")
    starts = counts.select("file", "block", "first", (F.sum("n").over(along) - F.col("n")).alias("before"))
    # One row a split: the bytes over the largest size of a split, and the number of files, bound it.
    met = read.join(F.broadcast(starts), ["file", "block"], "left")
    moved = F.col("first").isNull() | (F.shiftright("at", 33) != F.shiftright("first", 33))
    number = F.when(moved, F.raise_error(F.lit("the splits of the files have changed while they were read")).cast("long")).otherwise(F.col("before") + F.col("at") - F.col("first") + 1)
    return met.select("file", "block", number.alias("line_no"), "line")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), line of text files, blank lines included; a carriage return ends with its line."""
    return split_lines(spark, path).select("file", "line_no", F.regexp_replace("line", "\r$", "").alias("line"))


def read_jsonl_numbered(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, failures): rows with file and line_no; a failure ``line N: invalid JSON`` for each bad line."""
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    parsed = lines.withColumn("row", F.from_json("line", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = parsed.filter("row is null or row._corrupt_record is not null")
    failures = bad.select("file", "line_no", F.format_string("line %d: invalid JSON", "line_no").alias("failure"))
    return parsed.filter("row is not null and row._corrupt_record is null").select("file", "line_no", "row.*").drop("_corrupt_record"), failures


def read_sources_list(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, uri) of a list file: comments and blank lines left out."""
    lines = numbered_lines(spark, path).withColumn("uri", S.strip(F.col("line")))
    return lines.filter("uri <> '' and not startswith(uri, '#')").select(F.col("line_no").alias("ordinal"), "uri")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph JSON; edges come from ``edges`` or else ``links``, ends from ``source``/``from`` and ``target``/``to``."""
    node = "struct<id:string,label:string,file_type:string,source_file:string,community:string,community_name:string>"
    edge = "struct<source:string,from:string,target:string,to:string,relation:string,confidence:variant,source_file:string>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"nodes array<{node}>, edges array<{edge}>, links array<{edge}>").alias("g"))
    nodes = raw.select(F.explode("g.nodes").alias("n")).select("n.*")
    either = F.when(F.size(F.coalesce("g.edges", F.array().cast(f"array<{edge}>"))) > 0, F.col("g.edges")).otherwise(F.col("g.links"))
    edges = raw.select(F.posexplode(either).alias("seq", "e")).select(
        "seq",
        F.coalesce(F.nullif("e.source", F.lit("")), F.col("e.from"), F.lit("")).alias("src"),
        F.coalesce(F.nullif("e.target", F.lit("")), F.col("e.to"), F.lit("")).alias("dst"),
        F.col("e.relation").alias("relation"),
        S.confidence(F.col("e.confidence")).alias("confidence"),
        F.col("e.source_file").alias("source_file"),
    )
    return nodes, edges


_NOTE = "entity string, entity_id string, level string, relations array<struct<type:string,target:string,category_axis:string>>, raw map<string,string>"


def read_notes(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Markdown files below ``root``: path, dir, name, stem, body, frontmatter (``fm``)."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    files = files.select(F.regexp_replace("_metadata.file_path", r"^file:(//)?(?=/)", "").alias("path"), F.col("value").alias("text"))
    rel = F.expr(f"substring(path, length('{root.rstrip('/')}') + 2)")
    files = files.withColumn("rel", rel).withColumn("name", F.substring_index("rel", "/", -1))
    files = files.withColumn("dir", F.regexp_replace("rel", r"/?[^/]*$", "")).withColumn("stem", F.regexp_replace("name", r"\.md$", ""))
    return files.withColumn("fm", parse_frontmatter(F.col("text"))).withColumn("body", S.strip_frontmatter(F.col("text")))


def frontmatter_of(text: str | None) -> dict:
    """Frontmatter of a note: YAML between the first two ``---`` lines, after leading comment lines."""
    import re

    import yaml

    body = re.sub(r"\A(?:\s*<!--.*?-->\s*\n)+", "", text or "", flags=re.S)
    m = re.match(r"---\s*\n(.*?)\n---\s*(?:\n|\Z)", body, re.S)
    try:
        found = yaml.load(m[1], Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if m else {}
    except yaml.YAMLError:
        found = {}
    return found if isinstance(found, dict) else {}


def parse_frontmatter(text: Column) -> Column:
    """struct of entity, entity_id, level, relations and the plain fields of a note's frontmatter."""
    return F.pandas_udf(_frontmatters, f"struct<{', '.join(f.replace(' ', ':', 1) for f in _NOTE.split(', '))}>")(text)


def _frontmatters(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        fm = frontmatter_of(t)
        rel = fm.get("relations")
        rel = [r for r in rel if isinstance(r, dict)] if isinstance(rel, list) else []
        asked = lambda k: None if fm.get(k) is None else str(fm[k])
        rows.append((asked("entity"), asked("entity_id"), asked("level"), [{k: None if r.get(k) is None else str(r[k]) for k in ("type", "target", "category_axis")} for r in rel], {str(k): str(v) for k, v in fm.items() if not isinstance(v, list | dict)}))
    return pd.DataFrame(rows, columns=["entity", "entity_id", "level", "relations", "raw"])


def read_directory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, size, modified of the files below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_replace("path", r"^file:(//)?(?=/)", "").alias("path"), F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_trajectory(spark: SparkSession, directory: str, run_id: str | None = None, mirrors: bool = False) -> DataFrame:
    """Run events with their file and ``seq`` (line number); orchestration mirrors only if asked for."""
    rows, _ = read_jsonl_numbered(spark, f"{directory}/run-{run_id or '*'}.jsonl", model.EVENTS)
    rows = rows.withColumnRenamed("line_no", "seq")
    return rows if mirrors else rows.filter(~F.col("file").endswith(".orchestration.jsonl"))


def register_snapshots(spark: SparkSession, directory: str) -> list[str]:
    """A temporary view ``snap_<stem>`` for every Parquet snapshot; returns their names."""
    if not _matches(spark, f"{directory}/*.parquet"):
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/*.parquet")
    names = []
    for found in where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where):
        path = found.getPath()
        name = "snap_" + path.getName().removesuffix(".parquet")
        spark.read.parquet(path.toString()).createOrReplaceTempView(name)
        names.append(name)
    return sorted(names)


def latest_snapshot(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of the snapshot whose name comes last."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/*.parquet")
    found = sorted(x.getPath().toString() for x in where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where))
    return spark.read.parquet(found[-1])


def first_by_id(instances: DataFrame, wanted: str) -> DataFrame:
    """The first record whose ``id`` or ``entity_id`` is ``wanted``."""
    ids = [F.col(c) for c in ("id", "entity_id") if c in instances.columns]
    hit = ids[0] == wanted
    for c in ids[1:]:
        hit = hit | (c == wanted)
    return instances.filter(F.coalesce(hit, F.lit(False))).limit(1)


def power_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*S.POWER_RATES.items(), ("default", S.DEFAULT_POWER_RATE)], "model string, wh_per_token double")


def workflows_of(triples: DataFrame) -> DataFrame:
    """One row a workflow subject: its literal properties as a map, and steps sorted by stepIndex."""
    local = triples.withColumn("k", S.iri_local(F.col("p")))
    typed = local.filter("k = 'type'").select("s", S.iri_local(F.col("o")).alias("kind"))
    flows = typed.filter("kind = 'Workflow'").select("s")
    props = local.join(flows, "s", "left_semi").filter("o_kind = 'literal'").groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("k", "o"))).alias("props"))
    steps = local.filter("k = 'hasStep'").select(F.col("s").alias("flow"), F.col("o").alias("s"))
    fields = local.filter("o_kind = 'literal'").groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("k", "o"))).alias("step"))
    index = F.coalesce(F.try_element_at("step", F.lit("stepIndex")).cast("int"), F.lit(0))
    steps = steps.join(fields, "s").groupBy("flow").agg(F.transform(F.array_sort(F.collect_list(F.struct(index.alias("at"), F.to_json("step").alias("step")))), lambda x: x["step"]).alias("pipeline"))
    return flows.distinct().join(props, "s", "left").join(steps, F.col("s") == F.col("flow"), "left").drop("flow")


def latest_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
