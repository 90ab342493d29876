"""Writers: JSON lines, candidate files, notes with generated blocks, manifests, reports.

Row files are written by Spark. Notes are one small file a row under names that people chose: each task
writes its own rows, to names that depend on the row only, so a repeated task writes the same files.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<!-- kb:generated:start -->", "<!-- kb:generated:end -->"


def append_jsonl(df: DataFrame, path: str, batch: str | None = None) -> bool:
    """Appends rows to the log ``path`` as one unit, in two phases; whether they were appended.

    Tasks write lines into a staging folder that readers pass over; when all have, one rename puts it into the
    log. A failing task leaves the log as it was and nothing behind. A ``batch`` that the log holds is not
    appended again, so a replayed one counts once. Needs a file system whose renames are atomic.
    """
    spark, name = df.sparkSession, batch or f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    top, target, staged = path_of(path), path_of(path, f"batch-{name}"), path_of(path, f"_staging-{uuid.uuid4().hex}")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        return False
    try:
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").json(staged.toString())
        if not fs.rename(staged, target):
            raise OSError(f"cannot put a batch into {path}")
    finally:
        fs.delete(staged, True)
    # Where another writer of the same batch was faster, the rename ends inside its folder, unseen by readers.
    return not fs.delete(path_of(target, staged.getName()), True)


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    """Replaces what was there, also by nothing."""
    df.write.mode("overwrite").json(path)


def put_file(path: str, text: str) -> None:
    """Atomic: a temporary file beside it, then a rename."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, path)


def write_notes(notes: DataFrame, root: str, apply: bool = False) -> int:
    """Writes (path, text) below ``root`` from the tasks, in one pass; without ``apply`` only counts.

    ``root`` is a folder that all tasks see: a knowledge base is a directory of files that people edit.
    """
    if not apply:
        return notes.count()

    def each(batches):
        for rows in batches:
            for path, text in zip(rows["path"], rows["text"]):
                put_file(os.path.join(root, path), text)
            yield rows[["path"]]

    return notes.select("path", "text").mapInPandas(each, "path string").count()


def frontmatter(fields: dict[str, Column]) -> Column:
    """Frontmatter lines of the non-null fields."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in fields.items()]
    return F.concat(F.lit("---\n"), F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"), F.lit("\n---\n"))


def seed_notes(seeds: DataFrame) -> DataFrame:
    """(path, text) of seed notes."""
    head = frontmatter({"id": F.col("id"), "kind": F.col("kind"), "uri": F.col("uri"), "content_hash": F.col("content_hash"), "retrieved_at": F.col("retrieved_at"), "status": F.col("status")})
    return seeds.select(F.col("md_path").alias("path"), F.concat(head, F.lit("\n# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"))


def with_block(records: DataFrame, files: DataFrame, block: Column) -> DataFrame:
    """(path, text): the generated block of each record's note, and whatever stands after its end marker in the file."""
    own = records.withColumn("_block", F.concat(F.lit(START + "\n"), block, F.lit("\n" + END)))
    both = own.join(files.select(F.col("path").alias("md_path"), F.col("text").alias("_old")), "md_path", "left")
    at = F.locate(END, F.coalesce("_old", F.lit("")))
    tail = F.when(at > 0, F.substring("_old", at + len(END), F.length("_old"))).otherwise("\n")
    return both.select(F.col("md_path").alias("path"), F.concat("_block", tail).alias("text"))


def unmarked(targets: DataFrame, files: DataFrame, marker: str = START) -> DataFrame:
    """Targets that exist without the marker: they are a person's and must not be overwritten."""
    return targets.join(files.filter(~F.contains("text", F.lit(marker))).select("path"), "path", "left_semi")


def project_rows(rows: DataFrame, files: DataFrame, domain: str, root: str, apply: bool = False) -> int:
    """Snapshot rows (id, name, tags) as notes and a manifest; exit code 2 if an unmarked file is in the way."""
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    text = F.concat(F.lit(START + "\n# "), F.coalesce("name", F.col("id")), F.lit("\n\ntags: "), F.array_join(tags, ", "), F.lit("\n" + END + "\n"))
    notes = rows.select(F.concat(F.lit(f"{domain}/"), F.col("id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))
    if not unmarked(notes, files).isEmpty():
        return 2
    write_notes(notes, root, apply)
    if apply:
        listed = [r.path for r in notes.select("path").orderBy("path").toLocalIterator()]
        put_file(os.path.join(root, domain, "_manifest.base.json"), json.dumps({"domain": domain, "files": listed}, ensure_ascii=False, indent=2))
    return 0


def listing(files: DataFrame, first: int = 5) -> DataFrame:
    """(dir, ext, n, names): files by directory and ending, with the first names."""
    ext = F.when(F.col("name").endswith(".base.json"), "base.json").otherwise(F.substring_index("name", ".", -1))
    return files.groupBy("dir", ext.alias("ext")).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("name")), 1, first).alias("names"))


def seed_table(seeds: DataFrame, widths: tuple[int, int, int] = (40, 40, 30)) -> DataFrame:
    """Lines of a table of seeds, columns cut and padded."""
    cells = [F.rpad(F.substring(F.coalesce(c, F.lit("")), 1, w), w, " ") for c, w in zip(("id", "uri", "title"), widths)]
    return seeds.select(F.concat_ws(" | ", *cells).alias("line"))


def write_manifest(path: str, run_id: str, inputs: dict, outputs: dict) -> None:
    put_file(path, json.dumps({"run_id": run_id, "inputs": inputs, "outputs": outputs, "written_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}, ensure_ascii=False, indent=2))


def report(rows: list[dict], title: str) -> str:
    """Markdown table of a small result."""
    if not rows:
        return f"# {title}\n\n(none)\n"
    heads = list(rows[0])
    return f"# {title}\n\n| " + " | ".join(heads) + " |\n|" + "-|" * len(heads) + "\n" + "".join("| " + " | ".join(str(r[h]) for h in heads) + " |\n" for r in rows)


def scaffold(entries: list[dict], templates: dict[str, str], values: dict[str, str], root: str, apply: bool = False) -> list[str]:
    """Creates the directories and files of a plan (path, kind, template) that do not exist; returns what it makes."""
    made = []
    for e in entries:
        path = os.path.join(root, e["path"])
        if os.path.exists(path):
            continue
        made.append(e["path"])
        if not apply:
            continue
        if e["kind"] == "dir":
            os.makedirs(path, exist_ok=True)
            continue
        text = templates.get(e.get("template"), "")
        for k, v in values.items():
            text = text.replace("{{" + k + "}}", v)
        put_file(path, text)
        if e["kind"] == "file_executable":
            os.chmod(path, 0o755)
    return made
