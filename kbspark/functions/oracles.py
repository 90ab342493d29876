"""Oracles as a table function: scorers chosen by name, run over the partitions of any table, called from SQL.

``kb_oracle(TABLE(t), oracle, by, threshold)`` deals the rows of ``t`` by its column ``by``, feeds each group to
a new scorer row by row, and returns one row a group: the column ``by`` in its own type, ``score``, ``passed``,
``details``. A scorer keeps what it counts, never the rows. An oracle that is not registered is skipped with 1.0; one
that raises scores 0.0 and says why, and the query goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

THRESHOLD = 0.85


class Scorer(Protocol):
    """Takes rows as dicts; ``result`` is a score from 0 to 1, or (score, details)."""

    def add(self, row: dict) -> None: ...

    def result(self) -> float | tuple[float, str]: ...


def table_function(oracles: dict[str, Callable[[], Scorer]]) -> type:
    """The class behind ``kb_oracle``, with the scorers that ``oracles`` makes."""

    class Oracle:
        @staticmethod
        def analyze(rows: AnalyzeArgument, oracle: AnalyzeArgument, by: AnalyzeArgument, threshold: AnalyzeArgument | None = None, order: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument must be TABLE(...)")
            for argument in (oracle, by):
                if not argument.isConstantExpression or not isinstance(argument.value, str):
                    raise ValueError("the oracle's name and the column to deal by must be constant texts")
            kinds = {f.name: f.dataType for f in rows.dataType.fields}
            for name in [by.value, *([order.value] if order else [])]:
                if name not in kinds:
                    raise ValueError(f"the table has no column {name}")
            schema = StructType([StructField(by.value, kinds[by.value]), StructField("score", DoubleType()), StructField("passed", BooleanType()), StructField("details", StringType())])
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(by.value)], orderBy=[OrderingColumn(order.value)] if order else [])

        def __init__(self):
            self.scorer = self.error = self.key = None
            self.name, self.threshold, self.begun = None, THRESHOLD, False

        def eval(self, rows, oracle: str, by: str, threshold: float = THRESHOLD, order: str | None = None):
            if not self.begun:
                self.begun, self.key, self.name, self.threshold = True, rows[by], oracle, float(threshold)
                if oracle in oracles:
                    try:
                        self.scorer = oracles[oracle]()
                    except Exception as e:  # noqa: BLE001 - an oracle that fails must not end the query
                        self.error = str(e)
            if self.scorer is not None and self.error is None:
                try:
                    self.scorer.add(rows.asDict())
                except Exception as e:  # noqa: BLE001
                    self.error = str(e)

        def terminate(self):
            if not self.begun:
                return
            score, details = 1.0, "skipped"
            if self.scorer is not None and self.error is None:
                try:
                    found = self.scorer.result()
                    score, details = (found if isinstance(found, tuple) else (found, self.name))
                    score = float(score)
                except Exception as e:  # noqa: BLE001
                    self.error = str(e)
            if self.error is not None:
                score, details = 0.0, self.error
            yield self.key, score, details == "skipped" or (self.error is None and score >= self.threshold), details

    return Oracle


def register_oracles(spark: SparkSession, oracles: dict[str, Callable[[], Scorer]], name: str = "kb_oracle") -> None:
    """Registers the table function with these scorers; registering again replaces them."""
    spark.udtf.register(name, F.udtf(table_function(oracles)))
