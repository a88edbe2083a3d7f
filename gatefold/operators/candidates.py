"""Methods that propose candidates, as table functions: any Python callable becomes a polymorphic UDTF over a table argument.

A sampler is ``(row, k) -> candidates``; a table function calls it for the rows of one group in their order and returns what
it proposes, at most k different ones of a group. What comes out has the type of the group's own column and the type that
the sampler states, whatever table it is used on. Groups are Spark's partitions of the table argument: it shuffles and sorts
them, and a task sees one row at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

Sampler = Callable[[Row, int], Iterable]


def _named(table: AnalyzeArgument, column: AnalyzeArgument, what: str) -> str:
    """The name that a constant argument gives, checked against the table."""
    if not table.isTable:
        raise ValueError("the first argument is a table")
    if not column.isConstantExpression or column.value not in table.dataType.names:
        raise ValueError(f"{what} names no column of the table: {column.value}")
    return column.value


def proposer(sampler: Sampler, kind: str | T.DataType, k: int):
    """A UDTF (table, group, order) -> group, place, candidate, row: the first k different candidates of each group in the
    order that its rows propose them, and the number of the row, from 1, that did. Null candidates are failures and left out.

    ``group`` and ``order`` are the names of columns; the function itself asks for the partitioning and the sorting, so a
    caller can't leave them out."""
    answer = T._parse_datatype_string(kind) if isinstance(kind, str) else kind

    class Proposer:
        @staticmethod
        def analyze(table: AnalyzeArgument, group: AnalyzeArgument, *order: AnalyzeArgument) -> AnalyzeResult:
            name = _named(table, group, "group")
            fields = [T.StructField(name, table.dataType[name].dataType), T.StructField("place", T.IntegerType()), T.StructField("candidate", answer), T.StructField("row", T.LongType())]
            return AnalyzeResult(schema=T.StructType(fields), partitionBy=[PartitioningColumn(name)], orderBy=[OrderingColumn(_named(table, x, "order")) for x in order])

        def __init__(self):
            self.seen: dict = {}
            self.rows = 0

        def eval(self, table: Row, group: str, *order: str) -> Iterator[tuple]:
            self.rows += 1
            if len(self.seen) >= k:
                return
            for x in sampler(table, k):
                if x is not None and x not in self.seen and len(self.seen) < k:
                    self.seen[x] = None
                    yield table[group], len(self.seen), x, self.rows

    return F.udtf(Proposer)


def proposed(df: DataFrame, sampler: Sampler, kind: str | T.DataType, k: int, group: str, order: list[str]) -> DataFrame:
    """``proposer`` over a DataFrame. A null group is one group; an empty table has no candidates."""
    return proposer(sampler, kind, k)(df.asTable(), F.lit(group), *map(F.lit, order))


class Running:
    """(table, group, value, order) -> all columns of the table, and ``run``, the number of the run of equal values within the
    group. The result has whatever columns the table has: ``analyze`` appends one to them."""

    @staticmethod
    def analyze(table: AnalyzeArgument, group: AnalyzeArgument, value: AnalyzeArgument, *order: AnalyzeArgument) -> AnalyzeResult:
        _named(table, value, "value")
        fields = [*table.dataType.fields, T.StructField("run", T.LongType())]
        return AnalyzeResult(schema=T.StructType(fields), partitionBy=[PartitioningColumn(_named(table, group, "group"))], orderBy=[OrderingColumn(_named(table, x, "order")) for x in order])

    def __init__(self):
        self.run, self.last = 0, None

    def eval(self, table: Row, group: str, value: str, *order: str) -> Iterator[tuple]:
        if not self.run or table[value] != self.last:
            self.run += 1
        self.last = table[value]
        yield (*table, self.run)


runs = F.udtf(Running)
