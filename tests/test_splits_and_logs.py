"""Files in splits, logs of batches, rules on silence."""

from __future__ import annotations

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kbspark.sinks import notes
from kbspark.sources import files, python_sources
from kbspark.streaming import runs, schedule

TURTLE = '@prefix ex: <http://e/> .\n# a comment. with "dots" . and marks\n' + "".join(
    f'ex:a{i} ex:p "x.y", """long {i}\n.  @prefix no: <http://no> .\n "in" """ , [ ex:q 1.5 ; ex:r ( ex:b ex:c.d ) ] ; ex:z <http://z.org/x#y> , _:n{i % 3} .' + ("\n" if i % 2 else " ") + (f"@prefix ex: <http://e{i}/> .\r\n" if i % 20 == 7 else "") for i in range(60)
) + '<http://s> <http://p>\n\n <http://o>\n.'


@pytest.fixture
def splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}

    def size(n):
        spark.conf.set(keys[0], n)
        spark.conf.set(keys[1], 1)

    yield size
    for k, v in old.items():
        spark.conf.set(k, v)


def unnamed(rows):
    return sorted(tuple("_" if str(v).startswith("_:") and "g" in str(v) else str(v) for v in r) for r in rows)


def test_turtle_in_any_splits(spark, tmp_path, splits):
    (tmp_path / "a.ttl").write_bytes(TURTLE.encode())
    (tmp_path / "b.ttl").write_text("<http://b/s> <http://b/p> 'é' . ")
    (tmp_path / "c.ttl").write_text("")
    seen = []
    for size in (10**6, 1500, 200):
        splits(size)
        rows = python_sources.read_turtle(spark, f"{tmp_path}/*.ttl")
        seen.append(sorted(tuple(map(str, r)) for r in rows.drop("src").collect()))
    assert seen[0] == seen[1] == seen[2]
    assert rows.rdd.getNumPartitions() > 20
    scope = next(f"{python_sources.hash_name(r.src):x}" for r in rows.select("src").distinct().collect() if r.src.endswith("a.ttl"))
    want = python_sources.parse_turtle(TURTLE, scope) + python_sources.parse_turtle("<http://b/s> <http://b/p> 'é' .")
    assert unnamed(seen[0]) == unnamed(want)


@pytest.mark.parametrize("text", ["<http://a> <http://b> .", "<http://a> <http://b> <http://c>", '<http://a> <http://b> """open .', "ex:a ex:b ex:c .", "<http://a> %% <http://c> ."])
def test_broken_turtle_fails(spark, tmp_path, splits, text):
    splits(10)
    (tmp_path / "a.ttl").write_text("<http://x> <http://y> <http://z> .\n" + text)
    with pytest.raises(PySparkException):
        python_sources.read_turtle(spark, f"{tmp_path}/*.ttl").collect()


@pytest.mark.parametrize("size", [10**6, 1000, 64])
def test_lines_are_numbered_in_any_splits(spark, tmp_path, splits, size):
    splits(size)
    texts = {"a": "".join(f"line {i} {'x' * (i * 7 % 90)}\r\n" if i % 5 else "\n" for i in range(300)), "b": "one\ntwo", "c": "y" * 5000 + "\nlast\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = sorted((os.path.basename(r.file), r.line_no, r.line) for r in files.numbered_lines(spark, f"{tmp_path}/*").collect())
    assert got == sorted((n, i, x.rstrip("\r")) for n, t in texts.items() for i, x in enumerate(t.removesuffix("\n").split("\n"), 1))
    assert files.numbered_lines(spark, f"{tmp_path}/none*").collect() == []


def test_a_log_gets_whole_batches_or_nothing(spark, tmp_path):
    path, schema = f"{tmp_path}/log", "id long"
    rows = lambda a, b: spark.range(a, b).repartition(3)
    assert notes.append_jsonl(rows(0, 5), path) and notes.append_jsonl(rows(5, 9), path, "b1") and not notes.append_jsonl(rows(5, 9), path, "b1")
    with pytest.raises(PySparkException):
        notes.append_jsonl(rows(100, 900).withColumn("id", F.when(F.col("id") == 800, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id"))), path)
    assert not [x for x in os.listdir(path) if not x.startswith("batch-")] and len(os.listdir(path)) == 2
    assert sorted(r.id for r in files.read_jsonl(spark, path, schema, "FAILFAST").collect()) == list(range(9))
    assert notes.append_jsonl(rows(0, 0), path) and files.read_jsonl(spark, path, schema).count() == 9
    notes.overwrite_jsonl(rows(1, 2), path)
    assert [r.id for r in files.read_jsonl(spark, path, schema).collect()] == [1]


def test_a_replayed_micro_batch_is_logged_once(spark, tmp_path):
    from pyspark.sql import DataFrame

    spark.range(4).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").json(f"{tmp_path}/in")
    runs.run_rules(stream, [("r", "id > 0", "log")], "t", f"{tmp_path}/log", f"{tmp_path}/offsets").awaitTermination()
    # The commit of the batch is lost, as when the driver stops just before it.
    for name in os.listdir(f"{tmp_path}/offsets/commits"):
        os.remove(f"{tmp_path}/offsets/commits/{name}")
    runs.run_rules(stream, [("r", "id > 0", "log")], "t", f"{tmp_path}/log", f"{tmp_path}/offsets").awaitTermination()
    found: DataFrame = files.read_jsonl(spark, f"{tmp_path}/log", "rule_id string, epoch long")
    assert found.count() == 3


def test_silence_fires_once_and_begins_anew(spark, tmp_path):
    rules = [schedule.Silence("s", "kind = 'a'", 60), schedule.Silence("long", "true", 600)]
    batches = [
        [("u", "a", "2024-01-01 00:00:00"), ("u", "a", "2024-01-01 00:00:30"), ("v", "b", "2024-01-01 00:00:10"), (None, "a", "2024-01-01 00:00:00"), ("u", "a", None)],
        [("u", "b", "2024-01-01 00:01:00"), ("w", "a", "2024-01-01 00:05:00.000001")],
        [("u", "a", "2024-01-01 00:06:00"), ("u", "a", "2024-01-01 00:08:00"), ("w", "b", "2024-01-01 00:20:00")],
    ]
    schema = "who string, kind string, at string"
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("who string, kind string, at timestamp").parquet(f"{tmp_path}/in")
        schedule.run_silences(stream, rules, "who", "at", f"{tmp_path}/log", f"{tmp_path}/offsets", late="1 second").awaitTermination()
    got = {(r.rule_id, r.key, r.last_at, r.fired_at) for r in files.read_jsonl(spark, f"{tmp_path}/log", "rule_id string, key string, last_at string, fired_at string").collect()}
    day = lambda a, b: (f"2024-01-01 00:{a}", f"2024-01-01 00:{b}")
    assert got == {
        ("s", "u", *day("00:30.000000", "01:30.000000")), ("s", "w", *day("05:00.000001", "06:00.000001")), ("s", "u", *day("06:00.000000", "07:00.000000")), ("s", "u", *day("08:00.000000", "09:00.000000")),
        ("long", "v", *day("00:10.000000", "10:10.000000")), ("long", "w", *day("05:00.000001", "15:00.000001")), ("long", "u", *day("08:00.000000", "18:00.000000")),
    }
    assert spark.conf.get(schedule.PROVIDER, "none") != schedule._ROCKS


def test_small_splits_share_tasks(spark, tmp_path, splits):
    """Splits far more than tasks: every line with its number once, in order within its split, and no task for each split."""
    splits(64)
    lines = [f"<http://s{i}> <http://p> <http://o> ." for i in range(600)]
    (tmp_path / "a.ttl").write_text("\n".join(lines) + "\n")
    found = files.split_lines(spark, str(tmp_path / "*.ttl"))
    got = found.collect()
    assert sorted((r.line_no, r.line) for r in got) == list(enumerate(lines, 1)) and len({r.block for r in got}) > 200
    assert all(a.line_no < b.line_no for a, b in zip(got, got[1:]) if a.block == b.block)
    triples = python_sources.read_turtle(spark, str(tmp_path / "*.ttl"))
    assert sorted(r.s for r in triples.collect()) == sorted(f"http://s{i}" for i in range(600))
    assert found.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
