"""Chat formatting by quotation linking.

Each message's lines are parsed into quote levels (``>`` marks, nested as ``> >`` or ``>>``). Passages, which are single lines,
runs of lines of one level and the sentences of both, are normalised and hashed, so a sentence of a longer line and a run that was wrapped anew are found. A
passage of fewer than ``LEAST`` characters is evidence only where one message of the conversation alone holds it. A quoted passage is joined to the first message of its
conversation whose own words hold it; a message replies to the latest original among the quotes of its lowest linked level.
Following the replies gives each message its thread's root and its depth, by doubling steps; in a thread, turns are in
reply order, as a reply is later than what it answers. The messages are returned without quotes.

Original passages are aggregated to one row per conversation and hash before the join, so a sentence that a conversation
repeats any number of times joins once; no conversation is ever gathered in one task.

Defined results: a null text is empty. A row without a conversation or turn links with nothing. Rows repeated with conversation and turn are one
message to those that quote them; each is returned. A message that quotes nothing known is the root of its own thread. An empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import running_within
from .common import Stored, map_arrow, stored, table, text_or_empty

#: Shortest normalised passage that is evidence of a quotation whoever else says it, in characters.
LEAST = 12
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s*(?=\S)")
_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_ATTRIBUTION = re.compile(r".{0,200}\b(wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$", re.I)


def levels(text: str) -> list[tuple[int, str]]:
    """The quote level and the words of each line."""
    out = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def normal(passage: str) -> str:
    return " ".join(re.findall(r"\w+", passage.lower()))


def passages(lines: list[tuple[int, str]]) -> list[tuple[int, str, bool]]:
    """Level and hash of each passage, and whether it is short: every line, every run of lines of one level (an empty line ends a run), and their sentences."""
    found: dict[tuple[int, str], bool] = {}
    run: list[str] = []
    level = 0

    def add(at: int, words: str) -> None:
        for part in {words, *_SENTENCE.split(words)}:
            if n := normal(part):
                found[at, hashlib.md5(n.encode("utf-8", "replace")).hexdigest()] = len(n) < LEAST

    for at, words in [*lines, (-1, "")]:
        if at != level or not words.strip():
            if len(run) > 1:
                add(level, " ".join(run))
            run, level = [], at
        if words.strip():
            add(at, words)
            run.append(words)
    return [(at, h, short) for (at, h), short in found.items()]


def unquoted(lines: list[tuple[int, str]]) -> str:
    """A message's own words: quotes go, and the line that announces one."""
    own = [words for k, (level, words) in enumerate(lines) if not level and not (k + 1 < len(lines) and lines[k + 1][0] and _ATTRIBUTION.match(words))]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n")


def linked(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, reply_to, quote_level, thread_root, depth, text (without quotes) of every row.

    Ordered by conv_id, thread_root and turn they are reply-ordered conversations; reply_order() keeps branches together as well.
    """
    key = F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn")
    rows = df.select(*key, F.col(role_col).cast("string").alias("role"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for text in batch.column(3).to_pylist():
                lines = levels(text)
                texts.append(unquoted(lines))
                found.append([{"level": n, "hash": h, "short": short} for n, h, short in passages(lines)])
            kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.string()), ("short", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(found, kind)], ["conv_id", "turn", "role", "text", "found"])

    parsed = stored(map_arrow(rows, run, "conv_id long, turn long, role string, text string, found array<struct<level:int,hash:string,short:boolean>>"), "messages")
    some = parsed.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("found").alias("p")).select("conv_id", "turn", "p.level", "p.hash", "p.short")
    own = some.filter("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"), F.max("turn").alias("last"), F.first("short").alias("short"))
    originals = own.filter("not short or original = last").select("conv_id", "hash", "original")
    quoted = some.filter("level > 0").select("conv_id", "turn", "level", "hash").distinct().join(originals, ["conv_id", "hash"]).filter("original < turn")
    best = F.min(F.struct("level", (-F.col("original")).alias("o")))
    replies = stored(quoted.groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", (-F.col("b.o")).alias("reply_to"), F.col("b.level").alias("level")), "replies")
    now = Stored(replies.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = now.df.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        step = now.df.join(up, ["conv_id", "root"], "left")
        after = Stored(step.select("conv_id", "turn", F.coalesce("higher", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")), "threads")
        going = not after.df.filter("moved").isEmpty()
        now.drop()
        now = after
        if not going:
            break
    threads = now.df.select("conv_id", "turn", "root", "depth")
    out = parsed.drop("found").join(replies, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        "reply_to",
        F.col("level").alias("quote_level"),
        F.coalesce("root", "turn").alias("thread_root"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "text",
    )


def reply_order(messages: DataFrame) -> DataFrame:
    """The rows of linked() with position: a message's place in its thread, depth first, replies to one message by turn. The root has 0.

    Threads are walked as lists of steps, into and out of each message, which are ranked by doubling steps: as many jobs as the
    logarithm of the longest thread, and no thread or message with many replies is gathered in one task. Rows repeated with
    conversation and turn share a place; rows without either are the roots of their own threads.
    """
    replies = stored(messages.filter("conv_id is not null and turn is not null and reply_to is not null").select("conv_id", "turn", "reply_to").distinct(), "tree")
    placed = stored(running_within(replies, ["conv_id", "reply_to"], [F.col("turn")], F.lit(1), "place").select("conv_id", "turn", "reply_to", "place"), "siblings")
    roots = replies.select("conv_id", F.col("reply_to").alias("turn")).distinct().join(replies, ["conv_id", "turn"], "left_anti")
    every = replies.select("conv_id", "turn", "reply_to").unionByName(roots.withColumn("reply_to", F.lit(None).cast("long")))
    first = placed.filter("place = 0").select("conv_id", F.col("reply_to").alias("turn"), F.col("turn").alias("child"))
    into = every.join(first, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.lit(0).alias("out"), F.coalesce("child", "turn").alias("next"), F.col("child").isNull().cast("int").alias("next_out"), F.lit(1).cast("long").alias("rest")
    )
    later = placed.select("conv_id", "reply_to", (F.col("place") - 1).alias("place"), F.col("turn").alias("sibling"))
    onward = placed.join(later, ["conv_id", "reply_to", "place"], "left").select(
        "conv_id", "turn", F.lit(1).alias("out"), F.coalesce("sibling", "reply_to").alias("next"), F.col("sibling").isNull().cast("int").alias("next_out"), F.lit(0).cast("long").alias("rest")
    )
    # a root's way out is the end of its list: steps that lead to it have nothing left to add
    now = Stored(into.unionByName(onward), "steps")
    while True:
        ahead = now.df.select("conv_id", F.col("turn").alias("next"), F.col("out").alias("next_out"), F.col("next").alias("then"), F.col("next_out").alias("then_out"), F.col("rest").alias("more"))
        step = now.df.join(ahead, ["conv_id", "next", "next_out"], "left")
        rest = F.col("rest") + F.coalesce("more", F.lit(0))
        after = Stored(step.select("conv_id", "turn", "out", F.col("then").alias("next"), F.col("then_out").alias("next_out"), rest.alias("rest")), "steps")
        going = not after.df.filter("next is not null").isEmpty()
        now.drop()
        now = after
        if not going:
            break
    left = now.df.filter("out = 0").select("conv_id", "turn", "rest")
    whole = left.join(roots, ["conv_id", "turn"], "left_semi").select("conv_id", F.col("turn").alias("thread_root"), F.col("rest").alias("whole"))
    out = messages.join(left, ["conv_id", "turn"], "left").join(whole, ["conv_id", "thread_root"], "left")
    return out.select(*messages.columns, F.coalesce(F.col("whole") - F.col("rest"), F.lit(0)).alias("position"))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(linked(table(spark, sf_dir, "conversations")))


QUERIES = {"op3_quotation_linking": op3_quotation_linking}
ORACLE: dict[str, str] = {}
