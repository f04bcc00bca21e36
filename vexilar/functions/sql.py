"""Features and windows for ``spark.sql``: scalar functions by name, and table functions.

    register(spark)
    SELECT id, w.* FROM records, LATERAL strided_windows(i, q, 8, 4) w
    SELECT id, feature_amplitude_8d(i, q) FROM records
    SELECT * FROM row_changes(TABLE(events) PARTITION BY user_id ORDER BY ts, column => 'value')
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, NumericType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from vexilar.functions import rf
from vexilar.session import ship


class StridedWindows:
    """(window, i, q): the windows of ``length`` samples, ``step`` apart, of one record; none of a shorter or null record."""

    @staticmethod
    def analyze(i: AnalyzeArgument, q: AnalyzeArgument, length: AnalyzeArgument, step: AnalyzeArgument) -> AnalyzeResult:
        for name, a in (("i", i), ("q", q)):
            if not isinstance(a.dataType, ArrayType) or not isinstance(a.dataType.elementType, NumericType):
                raise ValueError(f"{name} must be an array of numbers, not {a.dataType.simpleString()}")
        for name, a in (("length", length), ("step", step)):
            if not a.isConstantExpression or a.value is None or int(a.value) < 1:
                raise ValueError(f"{name} must be a whole number of at least 1")
        out = StructType().add("window", IntegerType(), False).add("i", ArrayType(DoubleType())).add("q", ArrayType(DoubleType()))
        return AnalyzeResult(schema=out)

    def eval(self, i: list[float] | None, q: list[float] | None, length: int, step: int) -> Iterator[tuple]:
        if i is None or q is None:
            return
        for k, at in enumerate(range(0, min(len(i), len(q)) - length + 1, step)):
            yield k, [float(x) for x in i[at : at + length]], [float(x) for x in q[at : at + length]]


class RowChanges:
    """The rows of a partition, in its order, with ``change``: a column's value less that of the row before, null for the first.

    A partition is read in passing: only the row before is kept, however large it is.
    """

    def __init__(self) -> None:
        self.before: float | None = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        if not column.isConstantExpression or column.value not in rows.dataType.names:
            raise ValueError(f"column must be one of {', '.join(rows.dataType.names)}")
        if not isinstance(rows.dataType[column.value].dataType, NumericType):
            raise ValueError(f"{column.value} isn't a column of numbers")
        if "change" in rows.dataType.names:
            raise ValueError("the table has a column named change")
        out = StructType(list(rows.dataType.fields)).add("change", DoubleType())
        return AnalyzeResult(schema=out)

    def eval(self, rows: Row, column: str) -> Iterator[tuple]:
        now = rows[column]
        change = float(now) - self.before if now is not None and self.before is not None else None
        self.before = None if now is None else float(now)
        yield *rows, change


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to SQL and returns their names: feature_{view} for every view, and the table functions."""
    ship(spark)
    names = []
    for view in rf.VIEWS:
        spark.udf.register(f"feature_{view}", rf.feature_udf(view))
        names.append(f"feature_{view}")
    for name, made in (("strided_windows", StridedWindows), ("row_changes", RowChanges)):
        spark.udtf.register(name, udtf(made))
        names.append(name)
    return names
