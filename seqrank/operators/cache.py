"""A cache of vectors that several fills may complete at once.

A fill writes its vectors to a folder of its own and makes them visible by renaming one manifest to the next number, which only one of two fills can do. The other
looks again: keys that have become visible meanwhile are taken out of what it has written, and it tries the next number. So no key is there twice, and what a
fill has not finished is not seen. A manifest lists the folders that are visible; the newest counts. Files that lie in the cache's own folder (written by other means) are visible as well.
Renaming must fail where the target exists, as it does in HDFS; object stores without such a rename need a single fill at a time.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import cache_key
from ..session import scratch, ship, stored
from .embeddings import cache_missing, usable

SCHEMA = "key string, embedding array<double>"
#: Tries for one sequence, and seconds of waiting after the first failure; after the n-th it is n times as long.
TRIES, BACKOFF = 5, 2.0
_publishing = threading.Lock()


class Cache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path + ("/" + name if name else ""))

    def version(self) -> int:
        """The newest manifest's number; 0 if there is none."""
        folder = self._at("_manifests")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def folders(self, version: int) -> list[str]:
        """The folders that a manifest lists."""
        if not version:
            return []
        stream = self._fs.open(self._at(f"_manifests/{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """key, embedding of all that is visible and can be used. A file that can't be read counts as lacking."""
        reader = self.spark.read.schema(SCHEMA).option("ignoreCorruptFiles", True)
        plain = self._fs.exists(self._at("")) and any(f.getPath().getName().endswith(".parquet") for f in self._fs.listStatus(self._at("")))
        places = [self.path] if plain else []
        places += [f"{self.path}/_fills/{name}" for name in self.folders(self.version() if version is None else version)]
        found = reader.parquet(*places) if places else self.spark.createDataFrame([], SCHEMA)
        return found.filter(usable(F.col("embedding")))

    def _renamed(self, source: str, target: str) -> bool:
        jvm = self.spark._jvm
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(kind, 1)
        none[0] = kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(self._at(source)), self._fs.makeQualified(self._at(target)), none)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        return True

    def _published(self, version: int, folders: list[str]) -> bool:
        """Whether this fill's manifest became the next one."""
        self._fs.mkdirs(self._at("_manifests"))
        own = f"_manifests/_{uuid.uuid4().hex}"
        out = self._fs.create(self._at(own), False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        with _publishing:  # a local file system's rename looks first and moves then
            if self._renamed(own, f"_manifests/{version + 1}"):
                return True
        self._fs.delete(self._at(own), False)
        return False

    def add(self, vectors: DataFrame) -> int:
        """Make (key, embedding) visible, each key once, without those that are visible already; how many times another fill came first."""
        name, version, lost = uuid.uuid4().hex, self.version(), 0
        rows = vectors.select("key", F.col("embedding").cast("array<double>").alias("embedding")).filter(usable(F.col("embedding")))
        rows.groupBy("key").agg(F.min("embedding").alias("embedding")).write.parquet(f"{self.path}/_fills/{name}")
        seen = -1
        while True:
            if version != seen:  # what others have published since the last look is taken out
                own = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/_fills/{name}")
                known = self.read(version).select("key")
                if not own.join(known, "key", "left_semi").isEmpty():
                    after = uuid.uuid4().hex
                    own.join(known, "key", "left_anti").write.parquet(f"{self.path}/_fills/{after}")
                    self._fs.delete(self._at(f"_fills/{name}"), True)
                    name = after
                seen = version
            if self._published(version, [*self.folders(version), name]):
                return lost
            lost, version = lost + 1, self.version()


def filled(spark: SparkSession, df: DataFrame, path: str, model: str, provide: Callable[[DataFrame], DataFrame], sequence: str = "sequence", chunks: int = 1) -> DataFrame:
    """key, embedding of every distinct sequence: what the cache lacks is provided and made visible, a chunk after another.

    provide: takes (key, sequence) and returns (key, embedding). If it fails, the chunks before are in the cache, and the next call asks only for what is lacking.
    """
    cache = Cache(spark, path)
    with scratch():
        missing = stored(cache_missing(df, cache.read(), model, sequence), "missing")
        for c in range(chunks):
            part = missing.filter(F.pmod(F.xxhash64("key"), F.lit(chunks)) == c)
            if not part.isEmpty():
                cache.add(provide(part))
    wanted = df.select(cache_key(F.lit(model), F.col(sequence)).alias("key")).distinct()
    # two rows of one key can come only from files that were written by other means
    return cache.read().join(wanted, "key", "left_semi").groupBy("key").agg(F.min("embedding").alias("embedding"))


def asked(client: Callable[[], Callable[[str], list[float]]], tries: int = TRIES, backoff: float = BACKOFF) -> Callable[[DataFrame], DataFrame]:
    """A provider that asks a service for each sequence, with some tries and longer waits after each failure.

    client: makes what asks, once in each task. After the last failure the task fails, and Spark tries it again elsewhere; sequences that a
    task had answers for are asked again only within its chunk.
    """

    def provide(missing: DataFrame) -> DataFrame:
        ship(missing.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ask = client()
            for batch in batches:
                out = []
                for text in batch.column(1).to_pylist():
                    for k in range(1, tries + 1):
                        try:
                            out.append(list(map(float, ask(text))))
                            break
                        except Exception:
                            if k == tries:
                                raise
                            time.sleep(backoff * k)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["key", "embedding"])

        return missing.select("key", "sequence").mapInArrow(run, SCHEMA)

    return provide
