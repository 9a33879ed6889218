import threading

import pytest
from pyspark.sql import functions as F

from seqrank.operators.cache import Cache, asked, filled


def texts(spark, *rows):
    return spark.createDataFrame([(t, "x") for t in rows], "sequence string, key string")


def vectors(missing):
    return missing.select("key", F.array(F.length("sequence").cast("double")).alias("embedding"))


def rows_of(cache):
    return sorted(r["key"] for r in cache.read().collect())


def test_two_fills_at_once_hold_each_key_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    one, two = texts(spark, "A", "B", "C", "A"), texts(spark, "B", "C", "D")
    both, errors = threading.Barrier(2), []

    def slow(missing):
        both.wait(60)  # both have looked before either publishes
        return vectors(missing)

    def fill(df):
        try:
            filled(spark, df, path, "m", slow).collect()
        except Exception as error:  # a thread's error would be lost
            errors.append(error)

    threads = [threading.Thread(target=fill, args=(df,)) for df in (one, two)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not errors
    cache = Cache(spark, path)
    keys = rows_of(cache)
    assert len(keys) == len(set(keys)) == 4 and cache.version() == 2
    assert filled(spark, one.union(two), path, "m", lambda m: pytest.fail("nothing is lacking")).count() == 4


def test_what_is_not_published_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "cache")
    cache = Cache(spark, path)
    assert rows_of(cache) == [] and cache.version() == 0
    spark.createDataFrame([("half", [1.0])], "key string, embedding array<double>").write.parquet(f"{path}/_fills/unfinished")
    assert rows_of(cache) == []
    assert cache.add(spark.createDataFrame([("k", [1.0]), ("k", [2.0]), ("bad", None), ("worse", [float("nan")])], "key string, embedding array<double>")) == 0
    assert rows_of(cache) == ["k"]
    assert cache._published(0, ["other"]) is False and cache.version() == 1  # the number is taken


def test_a_failing_chunk_keeps_those_before(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def provide(missing):
        calls.append(sorted(r["sequence"] for r in missing.collect()))
        if len(calls) == 2:
            raise RuntimeError("the service is gone")
        return vectors(missing)

    df = texts(spark, *"ABCDEFGHIJ")
    with pytest.raises(RuntimeError):
        filled(spark, df, path, "m", provide, chunks=3)
    assert filled(spark, df, path, "m", provide, chunks=3).count() == 10
    answered = calls[0] + [s for c in calls[2:] for s in c]
    assert sorted(answered) == sorted("ABCDEFGHIJ")  # after success, each was asked for once


def test_a_client_is_asked_again_with_longer_waits(spark, tmp_path):
    log = str(tmp_path / "log")

    def client():
        failed = {}

        def ask(text):
            failed[text] = failed.get(text, 0) + 1
            if text != "AA" and failed[text] < 3:
                raise ConnectionError(text)
            with open(log, "a") as f:
                f.write(text + "\n")
            return [len(text), 1]

        return ask

    df = texts(spark, "AA", "BBB", "C")
    got = filled(spark, df, str(tmp_path / "cache"), "m", asked(client, backoff=0.01)).collect()
    assert sorted(list(r["embedding"]) for r in got) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]]
    assert sorted(open(log).read().split()) == ["AA", "BBB", "C"]
    with pytest.raises(Exception, match="ConnectionError"):
        filled(spark, df, str(tmp_path / "other"), "m", asked(client, tries=2, backoff=0.01)).collect()
