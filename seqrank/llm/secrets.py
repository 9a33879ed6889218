"""Secret scans with multipart credential linking.

Native: DataFrame functions only. Base kinds (assign, access, hex) are found by regular expressions; where a match begins
follows from the running total of the lengths of matches and of the gaps that splitting the text leaves, so positions are code points
without any Python. Running totals go chunk by chunk, and redaction cuts by places in bytes: a text with very many findings takes near linear time.

Multipart linking: access identifiers, secrets and endpoints are parts. An access identifier alone is a base finding;
a 40-character secret or an endpoint address alone is weak. Parts of a text are held against each other by an interval join: every part
is posted under the buckets of SCOPE code points that its surroundings touch, so a part meets only those parts
near it, however many a long text has. A weak secret is reported only if an access identifier lies in its
scope, an endpoint only if such a complete pair does. An assignment (a base finding) is a secret of a pair as well, unless the
access identifier is what it assigns.

Defined results: a null text counts as empty and has no findings. Rows repeated with the same id and text are one
document: each of them is returned with the same spans. Rows of one id with different texts keep to themselves. A row without an id is scanned like any other. An
empty table gives no rows; texts are scanned whole, in near linear time. Of a run of host characters all up to its last service suffix is the endpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, shuffled, split_by_ids, stored, table, text_or_empty

#: The contract's patterns. A run of characters that is too short holds no match that is long enough,
#: so access and hex ask for the length at once; an assignment that is too short is matched, and dropped afterwards.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
#: Weak parts: a 40-character secret that stands alone or behind a "=", and the address of a service.
SECRET = "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
#: No pattern repeats a group (Java does that by recursion), and each run of characters is tried from its beginning alone.
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?|(?<![a-z0-9.-])[a-z0-9.-]*[a-z0-9-]\.amazonaws\.com"
#: Kinds in the contract's order, then those that the method adds.
KINDS = (("assign", ASSIGN, 8), ("access", ACCESS, 16), ("hex", HEX, 32), ("secret", SECRET, 40), ("endpoint", ENDPOINT, 8))
BASE = ("assign", "access", "hex")
#: Code points within which parts belong together.
SCOPE = 400


#: A span: places in code points, and in bytes of the UTF-8 text.
SPANS = "array<struct<start:int,kind:int,end:int,from:int,to:int>>"
#: Elements that a running total covers at once: of a text with very many findings the work stays near linear.
CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is made once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The running totals of an array of int under an associative step: chunk by chunk, then over the chunks."""
    none = F.array().cast("array<int>")

    def scan(xs: Column) -> Column:
        start = F.struct(F.lit(None).cast("int").alias("at"), none.alias("out"))

        def one(state: Column, x: Column) -> Column:
            return let(F.coalesce(step(state["at"], x), x), lambda at: F.struct(at.alias("at"), F.concat(state["out"], F.array(at)).alias("out")))

        return F.aggregate(xs, start, one, lambda s: s["out"])

    def over(v: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))
        chunks = F.transform(places, lambda c: scan(F.slice(v, c * CHUNK + 1, CHUNK)))
        return let(chunks, lambda made: let(scan(F.transform(made, lambda c: F.element_at(c, -1))), lambda ends: F.flatten(F.transform(made, lambda own, i: F.when(i == 0, own).otherwise(F.transform(own, lambda x: step(F.get(ends, i - 1), x)))))))

    return let(values, lambda v: F.when(F.size(v) > 0, over(v)).otherwise(none))


def _matches(text: Column, kind: int, quick: str) -> Column:
    """The spans of a kind's matches that are long enough. quick: a text without it has none."""
    name, pattern, least = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(f"({pattern})" if name != "assign" else pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if name == "assign" else found
    parts = F.arrays_zip(found.alias("found"), held.alias("held"), F.split(text, pattern, -1).alias("gap"))  # the gap behind the last match has none

    def spans(p: Column) -> Column:
        ends = lambda size: running(F.transform(p, lambda m: F.coalesce(size(m["gap"]) + size(m["found"]), F.lit(0))), lambda a, b: a + b)

        def span(x: Column) -> Column:
            m = x["m"]["found"]
            return F.struct((x["end"] - F.char_length(m)).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), (x["to"] - F.octet_length(m)).alias("from"), x["to"].alias("to"))

        known = F.arrays_zip(p.alias("m"), ends(F.char_length).alias("end"), ends(F.octet_length).alias("to"))
        return F.transform(F.filter(known, lambda x: F.char_length(x["m"]["held"]) >= least), span)

    return F.when(text.rlike(quick), let(parts, spans).cast(SPANS)).otherwise(F.array().cast(SPANS))


#: A text that doesn't match has no finding of the kind: these are cheaper than finding all.
QUICK = (
    "(?i:passw|secret|token|api_?key)",
    "AKIA[A-Z0-9]{12}",
    "[0-9a-f]{32}",
    "[A-Za-z0-9+/]{40}",
    r"https?://[A-Za-z0-9.-]|\.amazonaws\.com",
)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (digest of the text) and the spans found in each row: base (of the contract) and weak ones."""
    text = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    cols = [_matches(F.col("text"), k, QUICK[k]).alias(KINDS[k][0]) for k in range(len(KINDS))]
    return text.select("doc_id", F.md5("text").alias("h"), *cols)


def _pairs() -> Column:
    """Whether a text of scan() can hold complementary parts at all."""
    return (F.size("access") > 0) & ((F.size("secret") > 0) | ((F.size("assign") > 0) & (F.size("endpoint") > 0)))


def linked(found: DataFrame) -> DataFrame:
    """doc_id, h, more: weak spans that have their complementary parts in scope. One row per text that has any."""
    key = ["doc_id", "h"]
    some = found.filter(_pairs()).select(*key, "access", "assign", "secret", "endpoint")
    some = some.dropDuplicates(key)  # rows repeated with id and text
    place = ["start", "kind", "end", "from", "to"]
    part = lambda c: some.select(*key, F.explode(c).alias("s")).select(*key, "s.*")
    bucket = lambda c: F.floor(F.col(c) / SCOPE)

    def join(weak: DataFrame, strong: DataFrame, apart: bool = False) -> DataFrame:
        """Weak parts with a strong one (apart: that doesn't overlap it) within SCOPE code points: by bucket, then by distance."""
        posted = strong.select(F.col("doc_id").alias("i"), F.col("h").alias("g"), F.col("start").alias("left"), F.col("end").alias("right"))
        posted = posted.withColumn("b", F.explode(F.sequence(F.floor((F.col("left") - SCOPE) / SCOPE), F.floor((F.col("right") + SCOPE) / SCOPE))))
        spots = weak.withColumn("b", bucket("start"))
        near = (F.col("start") <= F.col("right") + SCOPE) & (F.col("end") >= F.col("left") - SCOPE)
        if apart:
            near = near & ((F.col("start") >= F.col("right")) | (F.col("end") <= F.col("left")))
        same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")) & (spots["b"] == posted["b"])
        return spots.join(shuffled(posted), same & near, "left_semi").drop("b")

    secrets = join(part("secret"), part("access"))
    endpoints = join(part("endpoint"), secrets.union(join(part("assign"), part("access"), apart=True)))
    return secrets.union(endpoints).groupBy(*key).agg(F.collect_list(F.struct(*place)).alias("more"))


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start, then kind."""
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, n_assign, n_access, n_hex, base, every: a row for each row, with arrays of spans.

    Each text is scanned once: what was found is written, without the texts, and linked from there.
    """
    found = stored(scan(df, id_col, text_col), "found", keep=True)
    more = linked(found).select(F.col("doc_id").alias("i"), F.col("h").alias("g"), "more")
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))
    alone = found.filter(~_pairs()).withColumn("more", F.array().cast(SPANS))
    rows = found.filter(_pairs()).join(more, same, "left").select(*found.columns, "more").union(alone)
    base = F.concat(*BASE)
    every = F.concat(base, F.coalesce(F.col("more").cast(SPANS), F.array().cast(SPANS)))
    return rows.select("doc_id", "h", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), base.alias("base"), every.alias("every"))


def findings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    rows = scanned(df, id_col, text_col)
    return rows.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("every")).alias("spans"))


def without(text: Column, spans: Column, mark: str) -> Column:
    """The text with ``mark`` in place of its spans; overlapping ones are replaced as one. Cut by places in bytes, so in linear time."""

    def clean(raw: Column, known: Column) -> Column:
        cut = lambda begin, size: F.substring(raw, begin + 1, size).cast("string")

        def pieces(reach: Column) -> Column:  # where the spans before each one end
            between = F.transform(known, lambda s, i: F.struct(s["from"].alias("from"), F.get(reach, i).alias("at")))
            kept = F.filter(between, lambda x: x["from"] >= x["at"])
            made = F.transform(kept, lambda x: F.concat(cut(x["at"], x["from"] - x["at"]), F.lit(mark)))
            return F.concat(F.array_join(made, ""), cut(F.element_at(reach, -1), F.octet_length(raw)))

        return let(F.concat(F.array(F.lit(0)), running(F.transform(known, lambda s: s["to"]), F.greatest)), pieces)

    return let(F.encode(text, "utf-8"), lambda raw: let(F.array_sort(spans), lambda known: clean(raw, known)))


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """The rows of ``df``, all columns and their order kept, with every reported span of the text replaced by ``mark``.

    A text without spans, null texts included, is left as it is. Overlapping spans are replaced as one.
    """
    with scratch():
        found = scanned(df, id_col, text_col).filter(F.size("every") > 0)
        found = stored(found.dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "every"), "spans", keep=True)
    some, rest = split_by_ids(df, id_col, found.select("doc_id"))  # only texts that may have a span are joined
    text = F.col(f"_d.`{text_col}`").cast("string")
    every = F.col("_s.every")
    same = F.col(f"_d.`{id_col}`").cast("long").eqNullSafe(F.col("_s.doc_id").cast("long")) & (F.md5(F.coalesce(text, F.lit(""))) == F.col("_s.h"))
    rows = some.alias("_d").join(found.alias("_s"), same, "left")
    cols = [F.when(every.isNull(), text).otherwise(without(text, every, mark)).alias(c) if c == text_col else F.col(f"_d.`{c}`") for c in df.columns]
    return rows.select(cols).union(rest)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"))


QUERIES = {"op4_secret_scan": op4_secret_scan}
ORACLE: dict[str, str] = {}
