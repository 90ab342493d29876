"""The archive: last-wins tables, snapshots, SQL over snapshots, event-condition-action rules."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.sources.files import register_snapshots


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """``current`` with ``changes`` by key: the last change of a key replaces the whole row."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in current.columns if c != key]), order).alias("_row")).select(key, "_row.*")
    return current.join(last.select(key), key, "left_anti").select(*current.columns).unionByName(last.select(*current.columns))


def last_rows(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of an append log; a partial aggregate, no window."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), order).alias("_row")).select(key, "_row.*")


def export_snapshot(tables: dict[str, DataFrame], directory: str, stamp: str) -> list[str]:
    """Each table as Parquet below ``directory``, named by time stamp and table."""
    paths = []
    for name, df in sorted(tables.items()):
        path = f"{directory}/{stamp}_{name}.parquet"
        df.write.mode("errorifexists").parquet(path)
        paths.append(path)
    return paths


def query_snapshots(spark: SparkSession, directory: str, sql: str) -> DataFrame:
    """SQL over the snapshots, each a view ``snap_<stem>``."""
    register_snapshots(spark, directory)
    return spark.sql(sql)


def json_array(df: DataFrame, most: int = 10_000) -> str:
    """Rows as an indented JSON array, for display; raises where there are more than ``most``."""
    rows = df.toJSON().take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them to a file instead")
    return json.dumps([json.loads(r) for r in rows], indent=2, ensure_ascii=False)


def migrate(spark: SparkSession, scripts: dict[str, str], to: str) -> int:
    """Runs the statements of the versions up to ``to``, in order; returns how many."""
    n = 0
    for version in sorted(v for v in scripts if v <= to):
        for statement in statements(scripts[version]):
            spark.sql(statement)
            n += 1
    return n


def statements(script: str) -> list[str]:
    """The statements of a script: semicolons within quotes and comments end none."""
    out, held = [], ""
    for piece in re.findall(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|.", script, re.S):
        if piece == ";":
            out.append(held.strip())
            held = ""
        elif not piece.startswith(("--", "/*")):
            held += piece
    return [s for s in [*out, held.strip()] if s]


def init(spark: SparkSession, tables: dict[str, str]) -> list[str]:
    """Makes the tables (name -> columns) that do not exist; returns their names."""
    made = [t for t in tables if not spark.catalog.tableExists(t)]
    for t in made:
        spark.sql(f"CREATE TABLE {t} ({tables[t]}) USING parquet")
    return made


def fire_rules(rows: DataFrame, rules: list[tuple[str, str, str]], table: str) -> DataFrame:
    """Log rows (table_name, row_json, rule_id, action) of the (rule_id, SQL condition, action) rules that rows meet."""
    out = F.filter(F.array(*[F.when(F.coalesce(F.expr(cond), F.lit(False)), F.struct(F.lit(i).alias("rule_id"), F.lit(a).alias("action"))) for i, cond, a in rules]), lambda x: x.isNotNull())
    return rows.select(F.lit(table).alias("table_name"), F.to_json(F.struct("*")).alias("row_json"), F.explode(out).alias("r")).select("table_name", "row_json", "r.*")
