"""Rows of a table told apart by position, whatever columns the table has."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictalog.session import materialize


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


#: Plans in which each row is still one row of a file.
_NARROW = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}
#: Most files whose numbers are sent to all executors (a name and a number each); beyond it the rows are shuffled to them.
BROADCAST_FILES = 100_000
#: Rows a file may have, as a power of two.
_ROW_BITS = 40


def numbered(docs: DataFrame, rid: str | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and that column's name. With ``rid``, that column is it already.

    The number comes from the row's file and its place there, so every job sees the same, however many cores are alive to split the scan. A table that isn't read
    from Parquet files row by row is written once with its numbers, and read from there.
    """
    if rid:
        return docs, rid
    name = unused(docs, "rid")
    if not _from_files(docs):
        return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
    path, place = unused(docs, "file_path"), unused(docs, "file_no")
    placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(name))
    files = sorted(r[0] for r in placed.select(path).distinct().collect())  # names of files, which the driver has listed anyway
    # as an Arrow table: a list of rows would start Python workers on every executor, which stay as long as the application
    numbers = docs.sparkSession.createDataFrame(pa.table({path: pa.array(files, pa.string()), place: pa.array(range(len(files)), pa.int64())}))
    at = F.shiftleft(F.col(place), _ROW_BITS) + F.col(name)
    if len(files) <= BROADCAST_FILES:
        numbers = F.broadcast(numbers)
    return placed.join(numbers, path).select(*[F.col(f"`{c}`") for c in docs.columns], at.alias(name)), name


def _from_files(docs: DataFrame) -> bool:
    todo, names = [docs._jdf.queryExecution().analyzed()], set()
    while todo:
        node = todo.pop()
        names.add(node.nodeName())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    if not names <= _NARROW or any(c.lower() == "_metadata" for c in docs.columns):
        return False
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # files of another format
        return False
    return True


def without(rows: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """Numbered ``rows`` but for those in ``gone`` (rid), without their numbers."""
    return rows.join(gone.select(F.col("rid").alias(name)), name, "left_anti").drop(name)


def struct_of(docs: DataFrame, names: list[str]):
    """The columns as one value."""
    return F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(0).alias("none")])


def fields_of(column: str, names: list[str]) -> list:
    """The columns of such a value."""
    return [F.col(column).getField(c).alias(c) for c in names]
