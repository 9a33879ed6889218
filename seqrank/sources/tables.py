"""CSV, FASTA, GenBank and XLSX tables."""

from __future__ import annotations

import functools
import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.stats import running_before
from ..session import ship


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """With a header; a byte-order mark is passed over. Without a schema all columns are strings, cast where they are used."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def named_index(df: DataFrame, to: str = "sample_id") -> DataFrame:
    """The unnamed first column as a trimmed key."""
    first = df.columns[0]
    if first != "_c0" and not first.lower().startswith("unnamed"):
        return df
    return df.withColumnRenamed(first, to).withColumn(to, F.trim(to))


def without_unnamed(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.lower().startswith(("unnamed", "_c"))))


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; array columns as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema]
    df.select(flat).write.mode("overwrite").option("header", True).csv(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, sequence of each record, split over any number of lines; the id is the header's first word. Only a ``>`` that begins a line begins a record."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value")).filter(F.trim("value") != "")
    header = F.element_at(F.split("value", "\r?\n", 2), 1)
    body = F.when(F.col("value").contains("\n"), F.element_at(F.split("value", "\r?\n", 2), 2)).otherwise(F.lit(""))
    return records.select(F.element_at(F.split(header, r"\s+"), 1).alias("id"), F.regexp_replace(body, r"\s", "").alias("sequence"))


def write_fasta(df: DataFrame, path: str, id_col: str = "sample_id", sequence: str = "sequence", order: str | None = None) -> None:
    """One record per distinct id, the first by ``order`` (by default, of the rows as they come); rows without either are left out."""
    rows = df.dropna(subset=[id_col, sequence]).withColumn("__o", F.col(order) if order else F.monotonically_increasing_id())
    first = rows.groupBy(F.col(id_col).cast("string").alias("i")).agg(F.min_by(sequence, F.struct("__o", sequence)).alias("s"))
    first.select(F.concat(F.lit(">"), "i", F.lit("\n"), "s").alias("value")).write.mode("overwrite").text(path)


def _genbank_records(spark: SparkSession, path: str) -> DataFrame:
    records = spark.read.option("lineSep", "\n//").text(path).filter(F.col("value").contains("LOCUS"))
    return records.select(F.regexp_extract("value", r"LOCUS\s+(\S+)", 1).alias("locus"), F.regexp_replace("value", "\r", "").alias("value"))


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """locus, length, sequence of each record: the origin's letters in upper case."""
    origin = F.regexp_extract("value", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1)
    sequence = F.upper(F.regexp_replace(origin, "[^A-Za-z]", ""))
    return _genbank_records(spark, path).select("locus", F.length(sequence).alias("length"), sequence.alias("sequence"))


def read_genbank_features(spark: SparkSession, path: str) -> DataFrame:
    """locus, nth, feature, location, qualifiers (array of struct<name, value>) of each row of the features tables.

    Values are joined over their lines and lose their quotes; a qualifier without a value has none.
    """
    table = F.regexp_extract("value", r"(?s)\nFEATURES[^\n]*\n(.*?)(?=\n\S|$)", 1)
    entries = F.filter(F.split(table, r"(?m)^(?= {5}\S)"), lambda x: F.trim(x) != "")
    rows = _genbank_records(spark, path).select("locus", F.posexplode(entries).alias("nth", "entry"))
    parts = F.split("entry", r"\n {21}/")  # the feature with its location, then a qualifier each

    def qualifier(x: Column) -> Column:
        value = F.regexp_replace(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1), r"\s*\n\s*", " ")
        value = F.regexp_replace(value, r'^\s*"?|"?\s*$', "")
        return F.struct(F.regexp_extract(x, r"(?s)^\s*([^=]*?)\s*(?:=|$)", 1).alias("name"), F.when(x.contains("="), value).alias("value"))

    head = F.element_at(parts, 1)
    location = F.regexp_replace(F.regexp_extract(head, r"(?s)^\s*\S+\s+(.*)$", 1), r"\s+", "")
    return rows.select("locus", "nth", F.regexp_extract(head, r"^\s*(\S+)", 1).alias("feature"), location.alias("location"), F.transform(F.slice(parts, 2, F.size(parts)), qualifier).alias("qualifiers"))


_CELL = re.compile(r"([A-Z]+)[0-9]+")
_XLSX = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_rows(raw: bytes, sheet: str | None) -> Iterator[list[str | None]]:
    """The rows of a sheet (the first by default) of a workbook, as text."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        strings = []
        if "xl/sharedStrings.xml" in book.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{_XLSX}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_XLSX}si")]
        link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        names = {s.get("name"): s.get(link) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_XLSX}sheet")}
        if sheet is not None and sheet not in names:
            raise ValueError(f"there is no sheet {sheet}; there are {list(names)}")
        wanted = names[sheet] if sheet is not None else next(iter(names.values()))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        with book.open("xl/" + targets[wanted].removeprefix("/xl/")) as file:
            for _, row in ElementTree.iterparse(file):
                if row.tag != f"{_XLSX}row":
                    continue
                out: list[str | None] = []
                for cell in row.iter(f"{_XLSX}c"):
                    at = functools.reduce(lambda n, c: 26 * n + ord(c) - 64, _CELL.match(cell.get("r"))[1], 0) - 1 if cell.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    value = cell.find(f"{_XLSX}v")
                    if cell.get("t") == "inlineStr":
                        out[at] = "".join(t.text or "" for t in cell.iter(f"{_XLSX}t"))
                    elif value is not None and value.text is not None:
                        out[at] = strings[int(value.text)] if cell.get("t") == "s" else value.text
                yield out
                row.clear()


#: Rows of a sheet that are handed over at once.
SLICE = 4096


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet (the first by default) of the workbooks under a path, that have one header, as columns of strings; cast where they are used.

    Each workbook is read by a task; the first one's header is what the driver sees. Rows whose cells are all empty are left out.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                nth = 0
                for rows in itertools.batched(_sheet_rows(raw.as_py(), sheet), SLICE):
                    yield pa.RecordBatch.from_arrays([pa.array(range(nth, nth + len(rows)), pa.int64()), pa.array(list(rows), pa.list_(pa.string()))], ["nth", "cells"])
                    nth += len(rows)

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "nth long, cells array<string>")
    header = rows.filter("nth = 0").first()
    if header is None:
        raise ValueError(f"no workbook with a row under {path}")
    names = [name if name else f"_c{i}" for i, name in enumerate(header["cells"])]
    some = rows.filter((F.col("nth") > 0) & F.exists("cells", lambda x: x.isNotNull()))
    return some.select(*(F.try_element_at("cells", F.lit(i + 1)).alias(name) for i, name in enumerate(names)))


def synthetic_ids(df: DataFrame, order: str, to: str = "sample_id", prefix: str = "test_", digits: int = 5) -> DataFrame:
    """Ids prefix00000, prefix00001, ... in the order of a column.

    Rows are ranked by ranges of the order, so no task holds all of them.
    """
    number = F.col("__place").cast("string")
    named = F.concat(F.lit(prefix), F.when(F.length(number) < digits, F.lpad(number, digits, "0")).otherwise(number))
    return running_before(df, [F.col(order)], F.lit(1), "__place").withColumn(to, named).drop("__place")
