"""The functions of this library for SQL text: scalar functions that Spark inlines, and a table function over partitions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import SkipRestOfInputTableException, udtf
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SelectedColumn

from candrank.functions.exprs import CODES, COMPLEMENTS
from candrank.operators.candidates import NoveltyRule


class FirstDistinct:
    """first_distinct(TABLE(rows) PARTITION BY (key) ORDER BY (place), 'key', 'value', n): (key, rank, value), the first n distinct values of each partition.

    It holds n values of one partition, whatever the partition's size; a value that is null does not count. Python gets these two
    columns alone, not those that rows are ordered by, and the rest of a partition is passed over once it has its values.
    """

    def __init__(self) -> None:
        self.seen: dict = {}

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, column: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("first_distinct takes a table first")
        for name in (key.value, column.value):
            if name is None or name not in rows.dataType.names:
                raise ValueError(f"first_distinct has no column {name}")
        if not isinstance(n.value, int) or n.value < 0:
            raise ValueError("first_distinct takes a constant number of values")
        schema = StructType().add("key", rows.dataType[key.value].dataType).add("rank", IntegerType())
        chosen = [SelectedColumn(f"`{name.replace('`', '``')}`", alias) for name, alias in ((key.value, "key"), (column.value, "value"))]
        return AnalyzeResult(schema.add("value", rows.dataType[column.value].dataType), select=chosen)

    def eval(self, row, key: str, column: str, n: int) -> Iterator[tuple]:
        found, value = row[0], row[1]
        if len(self.seen) < n and value is not None and value not in self.seen:
            self.seen[value] = True
            yield found, len(self.seen), value
        if len(self.seen) >= n:
            raise SkipRestOfInputTableException


def first_rows(table: str, key: str, column: str, place: str, n: int) -> str:
    """The rows (key, column, place) of a table that first_distinct can return, in SQL text: the first of each value that is not null, n a key.

    A row costs Python some 50 microseconds, so a large table is asked for these, which Spark finds by itself; the answer is the same.
    Rows are dealt by key and value before they are grouped: no task sorts a whole split, and no key is a hot task.
    """
    dealt = f"SELECT /*+ REPARTITION({key}, {column}) */ {key}, {column}, {place} FROM {table} WHERE {column} IS NOT NULL"
    firsts = f"SELECT {key}, {column}, min({place}) AS {place} FROM ({dealt}) GROUP BY {key}, {column}"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {place}) AS nth FROM ({firsts})"
    return f"SELECT {key}, {column}, {place} FROM ({ranked}) WHERE nth <= {n}"


def novelty_sql(rule: NoveltyRule = NoveltyRule()) -> str:
    """The label of pident and qcov as a CASE; comparisons with nan are false, as those of candidates.novelty_label."""
    text = lambda label: "'" + label.replace("'", "''") + "'"
    below = lambda c, bound: f"({c} < double({bound!r}) AND NOT isnan({c}))"
    steps = " ".join(f"WHEN {below('pident', bound)} THEN {text(label)}" for bound, label in rule.steps)
    return f"CASE WHEN pident IS NULL THEN {text(rule.no_hit)} WHEN {below('qcov', rule.least_qcov)} THEN {text(rule.weak)} {steps} ELSE {text(rule.last)} END"


def register(spark: SparkSession, rule: NoveltyRule = NoveltyRule()) -> None:
    """novelty_label(pident, qcov), tolerant_number(x), safe_name(x), reverse_complement_of(seq) and first_distinct for this session."""
    scalar = {
        "novelty_label(pident DOUBLE, qcov DOUBLE) RETURNS STRING": novelty_sql(rule),
        "tolerant_number(x STRING) RETURNS DOUBLE": "try_cast(x AS DOUBLE)",
        "safe_name(x STRING) RETURNS STRING": "regexp_replace(x, '[^A-Za-z0-9_.-]+', '_')",
        "reverse_complement_of(seq STRING) RETURNS STRING": f"reverse(translate(seq, '{CODES}', '{COMPLEMENTS}'))",
    }
    for head, body in scalar.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("first_distinct", udtf(FirstDistinct))
