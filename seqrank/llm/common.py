"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import Stored, bound_batches, drop_path, fresh_path, scratch, ship, stored  # noqa: F401  (the operators' own names for them)

#: The six white-space characters that the contracts name.
BLANK = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


#: What a worker process keeps from task to task, by name.
_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a worker keeps under a name; made where it has none."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


@contextlib.contextmanager
def _lean(keeps: str) -> Iterator[None]:
    """A task in a worker that lives through all operators: it begins without what others keep, and gives back what it freed."""
    for name in [n for n in _KEPT if not keeps or not n.startswith(keeps)]:
        del _KEPT[name]
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    trim = getattr(libc, "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        libc.mallopt(-3, 1 << 17)  # M_MMAP_THRESHOLD stays: large blocks go back to the system as they are freed
        trim(0)
    try:
        yield
    finally:
        if trim is not None:
            trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, keeps: str = "") -> DataFrame:
    """mapInArrow with the package at hand in the workers, batches bounded by rows and bytes, and what only other operators keep let go.

    keeps: how the names begin under which ``run`` keeps something for its next task. Bounds that the session's owner has set stay.
    """
    spark = df.sparkSession
    ship(spark)
    bound_batches(spark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _lean(keeps):
            yield from run(batches)

    return df.mapInArrow(task, schema)


def shuffled(df: DataFrame) -> DataFrame:
    """To be joined by a shuffle, whatever Spark thinks its size is.

    Spark sizes a table by its source's files: after an explode, or beside columns that are null, a tenth or less of what it holds, and the driver
    would broadcast it. For tables that grow with the corpus.
    """
    return df.hint("merge")


#: Bits of an id bitmap.
BITMAP = 1 << 22


def split_by_ids(df: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose id may be among ``ids`` (one column), and those whose id surely isn't, without a shuffle.

    A bitmap of 2^22 hashed ids is sent about: 65,536 words at most, whatever the corpus. When it fills up it only
    splits less well: what may be among them still has to be joined.
    """
    at = F.pmod(F.xxhash64(F.col(f"`{ids.columns[0]}`").cast("long")), F.lit(BITMAP))
    words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits"))
    place = f"pmod(xxhash64(cast(_rows.`{id_col}` AS long)), {BITMAP})"
    hit = F.expr(f"shiftright({place}, 6) = _ids.word AND (shiftright(_ids.bits, int({place} & 63)) & 1L) = 1L")
    rows, words = df.alias("_rows"), F.broadcast(words).alias("_ids")
    return rows.join(words, hit, "left_semi"), rows.join(words, hit, "left_anti")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; SEQRANK_TOKENIZERS names another folder."""
    folder = os.environ.get("SEQRANK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: int = 1 << 15) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by integer keys as tables that hold whole groups, each with the places where its groups begin and end."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, len(t) - 1), bool)
        for k in keys:
            v = np.asarray(t.column(k))
            new |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1, [len(t)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < size:
            continue
        t = pa.Table.from_batches(held)
        at = bounds(t)
        if len(at) > 2:
            yield t.slice(0, int(at[-2])), at[:-1]
            t = t.slice(int(at[-2]))
        held, rows = t.to_batches(), t.num_rows
    if rows:
        t = pa.Table.from_batches(held)
        yield t, bounds(t)
