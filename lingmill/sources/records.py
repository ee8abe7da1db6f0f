"""Records of quoted CSV whose fields hold line ends, read by splits: many tasks a file.

Whether a line starts inside a quoted field depends on all lines before it. But a line only takes one of two states, at
a record's start or inside quotes, to another, and a split's lines compose to such a step too. So one pass gives each split's
step from either state, the steps of a file's splits are composed in order, and a second pass, which knows each split's first state, cuts
its lines into records. What crosses splits, at most one piece at either end of a split, is joined by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package

#: The end of a quoted field, from inside it.
_CLOSE = re.compile(r'(?:[^"]|"")*"(?!")')

START, INSIDE = 0, 1


def after_line(line: str, state: int, sep: str = ",") -> int:
    """The state after a line. A quote opens a field only where a field starts; elsewhere it is a character."""
    if '"' not in line:
        return state
    at = 0
    if state == START:
        if line[0] != '"':
            at = line.find(sep + '"')
            if at < 0:
                return START
            at += len(sep)
        at += 1
    while True:
        end = _CLOSE.match(line, at)
        if not end:
            return INSIDE
        at = line.find(sep + '"', end.end())
        # what stands between a closing quote and the next separator belongs to the field
        if at < 0:
            return START
        at += len(sep) + 1


def _keyed(batch: pa.RecordBatch) -> Iterator[tuple[str, int, str]]:
    return zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), batch.column("value").to_pylist())


def _steps(batches: Iterator[pa.RecordBatch], *, sep: str) -> Iterator[pa.RecordBatch]:
    """(path, start, from_start, from_inside) of each split."""
    held, states = None, (START, INSIDE)
    out = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (*held, *states)], ["path", "start", "from_start", "from_inside"])
    for batch in batches:
        for path, start, line in _keyed(batch):
            if (path, start) != held:
                if held:
                    yield out()
                held, states = (path, start), (START, INSIDE)
            if '"' in line:
                states = after_line(line, states[0], sep), after_line(line, states[1], sep)
    if held:
        yield out()


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("start")
    state, first = START, []
    for a, b in zip(pdf["from_start"], pdf["from_inside"]):
        first.append(state)
        state = b if state == INSIDE else a
    return pd.DataFrame({"path": pdf["path"], "start": pdf["start"], "first": first})


#: Kinds of rows: a whole record, lines that end a record of a split before, lines that start one which a later split ends.
WHOLE, HEAD, TAIL = 0, 1, 2


def _cut(batches: Iterator[pa.RecordBatch], *, sep: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """(path, start, n, kind, value) of each split's records and pieces, in order."""
    rows: list[tuple] = []
    size, held, state, open_, n, head = 0, None, START, [], 0, False

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["path", "start", "n", "kind", "value"])
        rows.clear()
        return made

    def left() -> None:
        # what a split leaves open: a piece that goes on before and after is a head, and the owner is an earlier split
        if open_:
            rows.append((*held, n, HEAD if head else TAIL, "\n".join(open_)))

    for batch in batches:
        for (path, start, line), first in zip(_keyed(batch), batch.column("first").to_pylist()):
            if (path, start) != held:
                if held:
                    left()
                held, state, open_, n, head = (path, start), first, [], 0, first == INSIDE
            state = after_line(line, state, sep)
            open_.append(line)
            size += len(line)
            if state == START:
                rows.append((path, start, n, HEAD if head else WHOLE, "\n".join(open_)))
                open_, n, head = [], n + 1, False
            if size >= most:
                yield out()
                size = 0
    if held:
        left()
    yield out()


def csv_records(spark: SparkSession, *paths: str, sep: str = ",") -> DataFrame:
    """(path, start, n, record): the records of quoted CSV files in order of (path, start, n), without empty lines and the line ends between records.

    Lines end in LF or CR LF. Inside quotes they stay as they are, but CR LF becomes LF in a record that itself ends in CR LF. A quote that is open at the end of a file makes
    the rest of it one record. A table of one row a split is broadcast.
    """
    ship_package(spark)
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    steps = lines.mapInArrow(partial(_steps, sep=sep), "path string, start long, from_start long, from_inside long")
    firsts = steps.groupBy("path").applyInPandas(_compose, "path string, start long, first int")
    # the lines' side is streamed, so they stay in order
    cut = lines.join(F.broadcast(firsts), ["path", "start"]).select("path", "start", "value", "first").mapInArrow(partial(_cut, sep=sep), "path string, start long, n long, kind int, value string")
    every = _joined(cut)
    record = F.when(F.endswith("value", F.lit("\r")), F.replace(F.expr("left(value, length(value) - 1)"), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("value"))
    return every.select("path", "start", "n", record.alias("record")).filter("record <> ''")


def _joined(cut: DataFrame) -> DataFrame:
    """(path, start, n, value): whole rows, and those that pieces of several splits make. Pieces are at most two a split."""
    pieces = cut.filter(F.col("kind") != WHOLE)
    # a head belongs to the last split before it that left something open
    order = Window.partitionBy("path").orderBy("start", F.col("kind") == TAIL)
    owner = F.last(F.when(F.col("kind") == TAIL, F.struct("start", "n")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = pieces.withColumn("owner", owner).groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "n", "value"))).alias("parts"))
    first = lambda c: F.coalesce(F.col(f"owner.{c}"), F.get("parts", F.lit(0))[c]).alias(c)
    joined = joined.select("path", first("start"), first("n"), F.array_join(F.col("parts.value"), "\n").alias("value"))
    return cut.filter(F.col("kind") == WHOLE).select("path", "start", "n", "value").unionByName(joined)


def _cut_at(batches: Iterator[pa.RecordBatch], *, marker: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """(path, start, n, kind, value): the blocks of a split's lines that start with marker. What comes before the first belongs to a split before, the last may go on."""
    rows: list[tuple] = []
    size, held, lines, n, head = 0, None, [], 0, True

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["path", "start", "n", "kind", "value"])
        rows.clear()
        return made

    for batch in batches:
        for path, start, line in _keyed(batch):
            if (path, start) != held:
                if lines:
                    rows.append((*held, n, HEAD if head else TAIL, "\n".join(lines)))
                held, lines, n, head = (path, start), [], 0, True
            if line.startswith(marker):
                if lines:
                    rows.append((*held, n, HEAD if head else WHOLE, "\n".join(lines)))
                    n += 1
                lines, head = [], False
            lines.append(line)
            size += len(line)
            if size >= most:
                yield out()
                size = 0
    if lines:
        rows.append((*held, n, HEAD if head else TAIL, "\n".join(lines)))
    yield out()


def blocks_at(spark: SparkSession, *paths: str, marker: str) -> DataFrame:
    """(path, start, n, block): files cut before each line that starts with marker, in order of (path, start, n). What stands before the first one is a block too.

    Files are read in splits. Only blocks that cross splits are shuffled, at most two pieces a split.
    """
    ship_package(spark)
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    return _joined(lines.mapInArrow(partial(_cut_at, marker=marker), "path string, start long, n long, kind int, value string")).withColumnRenamed("value", "block")


MALFORMED = "_malformed"


def _options(sep: str) -> dict[str, str]:
    # multiLine leaves line ends inside quotes as they are
    return {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}


def _without_header(records: DataFrame, header: bool) -> DataFrame:
    """Without the first record of each file."""
    if not header:
        return records
    first = records.groupBy("path").agg(F.min(F.struct("start", "n")).alias("first"))  # one row a file
    return records.join(F.broadcast(first), "path").filter(F.struct("start", "n") != F.col("first")).drop("first")


def _fields(record: str, sep: str) -> int:
    """How many fields a record has."""
    n, at = 1, 0
    while True:
        if record[at : at + 1] == '"':
            end = _CLOSE.match(record, at + 1)
            at = end.end() if end else len(record)
        at = record.find(sep, at)
        if at < 0:
            return n
        n, at = n + 1, at + len(sep)


def _schema(n: int) -> str:
    return ", ".join([*[f"c{i} string" for i in range(n)], f"{MALFORMED} string"])


def header_of(records: DataFrame, sep: str = ",") -> list[str]:
    """The fields of the first record; none without a record."""
    first = records.orderBy("path", "start", "n").select("record").limit(1)
    row = first.first()
    if row is None:
        return []
    n = _fields(row.record, sep)
    fields = first.select(F.from_csv("record", F.lit(_schema(n)), _options(sep)).alias("r")).first().r
    return [fields[i] or f"_c{i}" for i in range(n)]


def split_csv(spark: SparkSession, *paths: str, sep: str = ",", header: bool = True, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of quoted CSV files: rows of string columns, and the records (`line`) of another number of fields.

    columns names the columns; without them the first record does, or `_c0` and so on without a header. Rows of fewer
    or more fields are malformed only if columns is given; else missing fields are null and further ones are dropped.
    """
    records = csv_records(spark, *paths, sep=sep)
    names = columns or header_of(records, sep)
    if not names:
        raise ValueError(f"no record in {', '.join(paths)}")
    if not header and not columns:
        names = [f"_c{i}" for i in range(len(names))]
    parsed = _without_header(records, header).select("record", F.from_csv("record", F.lit(_schema(len(names))), _options(sep)).alias("r"))
    rows = parsed.filter(F.col(f"r.{MALFORMED}").isNull()) if columns else parsed
    return rows.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)]), parsed.filter(F.col(f"r.{MALFORMED}").isNotNull()).select(F.col("record").alias("line"))
