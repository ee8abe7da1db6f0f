"""Readers of parallel-corpus formats. Each returns a lazy DataFrame."""

from __future__ import annotations

import gzip
import io
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..functions.text import strip
from ..operators.pairing import aligned
from .records import blocks_at, split_csv

FORMATS = {"arrow": "arrow", "json": "json", "jsonl": "json", "parquet": "parquet", "csv": "csv", "tsv": "csv", "xml": "xml", "txt": "text"}


def parquet(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    r = spark.read.option("recursiveFileLookup", "true") if recursive else spark.read.option("pathGlobFilter", "*.parquet")
    return r.parquet(path)


def by_extension(spark: SparkSession, *paths: str) -> DataFrame:
    """Reads files of one known extension by its format; another or mixed ones are an error."""
    kinds = {p.rsplit(".", 1)[-1].lower() if "." in p.rsplit("/", 1)[-1] else "" for p in paths}
    if len(kinds) != 1 or next(iter(kinds)) not in FORMATS:
        raise ValueError(f"cannot tell one format from {', '.join(sorted(kinds))}; known: {', '.join(sorted(FORMATS))}")
    kind = kinds.pop()
    if kind == "arrow":
        return arrow(spark, *paths)
    if kind in ("csv", "tsv"):
        return split_csv(spark, *paths, sep="\t" if kind == "tsv" else ",")[0]
    return spark.read.format(FORMATS[kind]).load(list(paths))


def _opened_arrow(raw: bytes) -> pa.RecordBatchReader:
    """The batches of an Arrow file, or of an Arrow stream."""
    source = pa.py_buffer(raw)
    if raw[:6] == b"ARROW1":
        file = pa.ipc.open_file(source)
        return pa.RecordBatchReader.from_batches(file.schema, (file.get_batch(i) for i in range(file.num_record_batches)))
    return pa.ipc.open_stream(source)


def _arrow_schema(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"raw": pa.array([_opened_arrow(x.as_py()).schema.serialize().to_pybytes() for x in batch.column(0)], pa.binary())})


def arrow(spark: SparkSession, *paths: str) -> DataFrame:
    """Arrow files or streams, or folders of them (*.arrow). All have the first one's schema.

    A task reads a file as one value, so a file holds less than 2 GiB, as the shards of saved data sets do.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.arrow")
    files = r.load(list(paths)).select("content")
    first = files.limit(1).mapInArrow(_arrow_schema, "raw binary").first()
    if first is None:
        raise ValueError(f"no *.arrow file under {', '.join(paths)}")
    schema = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes(first.raw))))
    kinds = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                for own in _opened_arrow(x.as_py()):
                    yield pa.RecordBatch.from_arrays([own.column(f.name).cast(f.type) for f in kinds], names=kinds.names)

    return files.mapInArrow(rows, schema)


def catalog(spark: SparkSession, entries: dict[tuple[str, str, str], str], name: str, config: str, split: str) -> DataFrame:
    """A data set by (name, config, split) from a table of local paths."""
    if (name, config, split) not in entries:
        raise KeyError(f"no path for {name}/{config}/{split}")
    return by_extension(spark, entries[name, config, split])


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line, value): every line with its number from 0 over the files in the order given.

    Files are read in splits, as Spark deals them. Within a split lines come in order, so a line's number is its
    place there plus the lines of the splits before, of which there is one count each. Counts are broadcast, so lines
    stay where they are read. An empty file has no line.
    """
    out = None
    for n, path in enumerate(paths):
        rows = spark.read.option("lineSep", "\n").text(path).select(F.lit(n).alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.regexp_replace("value", r"\r$", "").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    placed = out.withColumn("at", F.monotonically_increasing_id())
    split = ["file", "path", "start"]
    counts = placed.groupBy(*split).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy(*split)) - F.col("n")).select(*split, "first", "before")
    return placed.join(F.broadcast(before), split).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")


def text_pair(spark: SparkSession, source: str | list[str], target: str | list[str], source_code: str, target_code: str) -> DataFrame:
    """Line-aligned files beside each other: line, source_text, target_text and the codes. Different line counts are an error."""
    read = lambda p, n: lines(spark, *([p] if isinstance(p, str) else p)).select("line", F.col("value").alias(n))
    both = aligned(read(source, "s"), read(target, "t"), "s", "t")
    return both.withColumn("source_nllb_code", F.lit(source_code)).withColumn("target_nllb_code", F.lit(target_code))


def negatives(spark: SparkSession, path: str, code: str) -> DataFrame:
    """A headless file of one column as hard negatives: ids -1, -2 and so on, sentence, nllb_code."""
    return lines(spark, path).select((-F.col("line") - 1).cast("long").alias("id"), F.col("value").alias("sentence"), F.lit(code).alias("nllb_code"))


_UNIT = "tuv array<struct<`_xml:lang`:string,`_lang`:string,seg:string>>"


def _segment(tuv: Column, lang: str) -> Column:
    own = F.filter(tuv, lambda v: F.lower(F.coalesce(v["_xml:lang"], v["_lang"])).startswith(lang.lower()))
    return F.get(own, F.lit(0))["seg"]


def tmx(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """Translation units of a TMX memory: source_text and target_text of the two languages, null where one lacks."""
    units = spark.read.format("xml").option("rowTag", "tu").schema(_UNIT).load(path)
    return units.select(_segment(F.col("tuv"), source).alias("source_text"), _segment(F.col("tuv"), target).alias("target_text"))


def tmx_unit(value: Column, source: str, target: str) -> tuple[Column, Column]:
    """The two languages' texts of one translation unit that a column holds as XML."""
    unit = F.from_xml(value, _UNIT)
    return _segment(unit["tuv"], source), _segment(unit["tuv"], target)


def quoted_csv(spark: SparkSession, path: str, source: int = 0, target: int = 1, sep: str = ",", header: bool = True) -> DataFrame:
    """Two stripped columns, by number, of a quoted CSV or TSV; further columns, empty ones included, are dropped."""
    df, _ = split_csv(spark, path, sep=sep, header=header)
    pick = lambda i: strip(F.col(f"`{df.columns[i]}`"))
    return df.select(pick(source).alias("source_text"), pick(target).alias("target_text"))


def multilingual_csv(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of a CSV of that many columns: rows with another number of fields aren't read as text
    but reported, as their line (`line`)."""
    return split_csv(spark, path, header=header, columns=columns)


def unpivot_pairs(df: DataFrame, languages: list[str], row: str, pivot: str) -> DataFrame:
    """A table with a column per language to pairs of the pivot with every other: row, source_lang, target_lang, texts."""
    others = F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), F.col(x).alias("text")) for x in languages if x != pivot]))
    return df.select(row, F.col(pivot).alias("source_text"), others.alias("o")).select(row, F.lit(pivot).alias("source_lang"), "source_text", F.col("o.lang").alias("target_lang"), F.col("o.text").alias("target_text"))


def bar_lines(value: Column) -> Column:
    """`a  b|c  d` to pairs: parts stand between runs of white space; if the sides have
    different numbers of parts, each is one text again. A column to explode."""
    sides = F.split(value, r"\|", 2)
    part = lambda i: F.filter(F.split(strip(F.coalesce(F.get(sides, F.lit(i)), F.lit(""))), r"\s\s+"), lambda x: x != "")
    a, b = part(0), part(1)
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("source_text"), y.alias("target_text")))
    whole = F.array(F.struct(F.array_join(a, " ").alias("source_text"), F.array_join(b, " ").alias("target_text")))
    return F.when(F.size(a) == F.size(b), pairs).otherwise(whole)


def tab_split(value: Column) -> tuple[Column, Column]:
    """What is before and after the first tab."""
    parts = F.split(value, "\t", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def marked_blocks(value: Column, first: str, second: str) -> Column:
    """Blocks `first: ... second: ...` of a whole text as (source_text, target_text) to explode; line ends become spaces."""
    blocks = F.filter(F.split(value, rf"(?m)^{first}:"), lambda b: F.contains(b, F.lit(f"{second}:")))
    clean = lambda c: strip(F.regexp_replace(c, r"\s*\n\s*", " "))
    return F.transform(blocks, lambda b: F.struct(clean(F.substring_index(b, f"{second}:", 1)).alias("source_text"), clean(F.substring(b, F.instr(b, F.lit(f"{second}:")) + len(second) + 1, F.length(b))).alias("target_text")))


def marked_block_files(spark: SparkSession, *paths: str, first: str, second: str) -> DataFrame:
    """(source_text, target_text) of the marked blocks of files of any size, read in splits."""
    blocks = blocks_at(spark, *paths, marker=f"{first}:")
    pairs = blocks.select(F.explode(marked_blocks(F.col("block"), first, second)).alias("p"))
    return pairs.select("p.source_text", "p.target_text")


def members(spark: SparkSession, path: str, most_bytes: int = 1 << 31) -> DataFrame:
    """(archive, name, line, value): the lines of every file in zip and tar archives. Archives are read one per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for where, raw in zip(pdf["path"], pdf["content"]):
                if len(raw) > most_bytes:
                    raise ValueError(f"{where} is larger than {most_bytes} bytes")
                for name, data in _opened(where, raw):
                    text = data.decode("utf-8").splitlines()
                    yield pd.DataFrame({"archive": where, "name": name, "line": range(len(text)), "value": text})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, line long, value string")


def _opened(where: str, raw: bytes) -> Iterator[tuple[str, bytes]]:
    if where.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for name in sorted(z.namelist()):
                if not name.endswith("/"):
                    yield name, z.read(name)
    elif where.endswith(".gz") and not where.endswith(".tar.gz"):
        yield os.path.basename(where).removesuffix(".gz"), gzip.decompress(raw)
    else:
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for m in sorted(t.getmembers(), key=lambda m: m.name):
                if m.isfile():
                    yield m.name, t.extractfile(m).read()


def pair_of_path(path: Column) -> tuple[Column, Column]:
    """Language codes of a file or folder named `src-tgt`."""
    pattern = r"([^/\-.]+)-([^/\-.]+)(?:\.[^/]*)?(?:/[^/]*)?$"
    return F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)


def spreadsheet(spark: SparkSession, path: str, sheets: tuple[str, str]) -> DataFrame:
    """Two sheets zipped by row, without rows that lack a cell; needs openpyxl, which is optional."""
    import openpyxl

    book = openpyxl.load_workbook(path, read_only=True)
    rows = [(str(a[0]).replace("\n", " "), str(b[0]).replace("\n", " ")) for a, b in zip(*(book[s].iter_rows(values_only=True) for s in sheets)) if a and b and a[0] is not None and b[0] is not None]
    return spark.createDataFrame(rows, "source_text string, target_text string")
