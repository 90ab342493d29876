"""Near-equal labels against every pair; oracles called from SQL."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import AnalysisException, PySparkException

from kbspark.functions import oracles
from kbspark.operators import labels


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_near_labels_as_all_pairs(spark, distance):
    r = random.Random(distance)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(1, 9))) for _ in range(150)} | {"internationalisation", "internationalization", "internationalizations", "x"}
    rows = [(c, i, w.upper() + " ", i) for c in ("one", None) for i, w in enumerate(sorted(words))] + [("one", 998, "", 998), ("one", 999, None, 999)]
    got = {tuple(x) for x in labels.near_labels(spark.createDataFrame(rows, "cluster string, id int, label string, seq int"), distance).collect()}
    assert got == {(c, a, b, edits(a, b)) for c in ("one", "") for a in words for b in words if a < b and edits(a, b) <= distance}


def test_findings(spark):
    rows = [("c", 1, "Gear box", 1), ("c", 2, " gear BOX", 2), ("c", 3, "gear boxes", 3), ("c", 4, "x", 4), ("c", 5, None, 5), ("d", 6, "gear box" * 20, 6)]
    ents = spark.createDataFrame(rows, "cluster string, id int, label string, seq int")
    assert {(x.id, x.kind) for x in labels.length_findings(ents).collect()} == {(4, "label_too_short"), (5, "label_missing"), (6, "label_too_long")}
    assert {(x.id, x.kind, x.detail) for x in labels.redundancy_findings(ents).collect()} == {(2, "label_duplicate", "1"), (3, "label_near", "gear box: 2")}
    with pytest.raises(ValueError):
        labels.near_labels(ents, 0)
    assert labels.near_labels(ents.limit(0)).collect() == []


class Last:
    """Whether rows came in the order of ``at``; a list of them for the details."""

    def __init__(self):
        self.seen = []

    def add(self, row):
        self.seen.append(row["at"])

    def result(self):
        return float(self.seen == sorted(self.seen)), ",".join(map(str, self.seen))


def broken():
    raise RuntimeError("no model")


def test_oracles_from_sql(spark):
    oracles.register_oracles(spark, {"last": Last, "broken": broken})
    spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 5), ("a", 2)], "k string, at int").repartition(3).createOrReplaceTempView("rows_of_runs")
    ask = lambda args: spark.sql(f"select * from kb_oracle(TABLE(rows_of_runs), {args})")
    out = ask("'last', 'k', 0.5, 'at'")
    assert out.schema["k"].dataType.simpleString() == "string"
    assert {tuple(r) for r in out.collect()} == {("a", 1.0, True, "1,2,3"), ("b", 1.0, True, "2"), (None, 1.0, True, "5")}
    assert {(r.score, r.passed, r.details) for r in ask("'broken', 'k'").collect()} == {(0.0, False, "no model")}
    assert {(r.at, r.score, r.passed, r.details) for r in ask("'none', 'at'").collect()} == {(n, 1.0, True, "skipped") for n in (1, 2, 3, 5)}
    assert spark.sql("select * from kb_oracle(TABLE(select * from rows_of_runs where at > 9), 'last', 'k')").collect() == []
    for args in ("'last', 'no'", "'last', 'k', 0.5, 'no'", "upper(cast(rand() as string)), 'k'"):
        with pytest.raises((AnalysisException, PySparkException)):
            ask(args).collect()
