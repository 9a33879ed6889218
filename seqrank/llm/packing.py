"""Best-fit packing by bin completion, branch and bound.

Lengths are integers up to the capacity, so what the search needs of the corpus is a histogram of at most ``capacity``
rows, whatever the corpus's size: that alone goes to the driver. There, each step takes the largest length that is
left and enumerates the fillings of the room beside it by any number of documents, those of least waste first and without
dominated ones (which a swap of up to two documents for a larger one improves). The chosen one is used as often as the
counts allow, and on backtracking half as often, down to once. A branch is cut when its waste so far shows that it can't
beat the incumbent; the first incumbent is the best-fit solution. The search ends at the lower bound, when all choices
are tried, or after ``NODES`` fillings (the only bound), with the best plan found; every plan packs every document.

The plan is a list of patterns with how often each is used. Each use up of a pattern exhausts the count of a length
for it, so the plan's size is bounded by the capacity as well. A piece finds its place by its rank among the pieces of
its length: its index in its own task's output plus what the tasks before it have, so no window runs over a frequent length.

Defined results: a null text counts as empty and gives one piece with the end token alone. An empty table gives none.
Rows repeated with the same id are packed each for itself.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import GROUP_SIZE, MEMO_SIZE, coder
from .common import map_arrow, stored, table, text_or_empty, tokenizer_path

CAPACITY, END_ID = 1024, 2
#: Fillings that the search looks at.
NODES = 8_000

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, times), ...), uses


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Of the sequences that any packing needs: by total length, and by lengths that can't share."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    for k in range(0, capacity // 2 + 1):
        alone = sum(n for s, n in counts.items() if s > capacity - k)
        halves = {s: n for s, n in counts.items() if capacity / 2 < s <= capacity - k}
        small = sum(s * n for s, n in counts.items() if k <= s <= capacity / 2)
        spare = sum((capacity - s) * n for s, n in halves.items())
        best = max(best, alone + sum(halves.values()) + max(0, -(-(small - spare) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Largest first, each time the largest that still fits beside it."""
    left, plan = dict(counts), []
    sizes = sorted(left, reverse=True)
    while sizes:
        room, items = capacity, []
        for s in sizes:
            if times := min(room // s, left[s]):
                items.append((s, times))
                room -= s * times
            if room < sizes[-1]:
                break
        plan.append((tuple(items), uses := min(left[s] // n for s, n in items)))
        for s, n in items:
            left[s] -= n * uses
        sizes = [s for s in sizes if left[s]]
    return plan


def fillings(left: dict[int, int], room: int) -> Iterator[Pattern]:
    """Fillings of ``room`` by any number of documents, of least waste first and the largest documents first, each with its sum.

    Left out are those that a swap of none, one or two of their documents for a larger one that is left shows to be dominated: their sum is None.
    """
    sizes = sorted((s for s, n in left.items() if n and s <= room), reverse=True)
    within, reach = (1 << room + 1) - 1, [1]
    for s in reversed(sizes):  # as bits, what the documents from each size down can sum to
        bits, n, k = reach[-1], min(left[s], room // s), 1
        while n:
            k = min(k, n)
            bits |= bits << s * k & within
            n, k = n - k, 2 * k
        reach.append(bits)
    reach.reverse()
    have = sum(1 << s for s in sizes)

    def walk(i: int, rest: int) -> Iterator[tuple[tuple[int, int], ...]]:
        if not rest:
            yield ()
            return
        i = max(i, bisect_left(sizes, -rest, key=lambda s: -s))
        while reach[i] >> rest & 1:
            s = sizes[i]
            for t in range(min(left[s], rest // s), 0, -1):
                if reach[i + 1] >> rest - s * t & 1:
                    for more in walk(i + 1, rest - s * t):
                        yield ((s, t), *more)
            i += 1

    def dominated(items: tuple[tuple[int, int], ...], slack: int) -> bool:
        spare = have - sum(1 << s for s, t in items if t == left[s])
        between = lambda a, b: spare >> a & (1 << max(0, b - a + 1)) - 1
        if between(1, slack) or any(between(s + 1, s + slack) for s, _ in items):
            return True
        pairs = {a + b for k, (a, t) in enumerate(items) for b in (*(s for s, _ in items[k + 1 :]), *([a] if t > 1 else []))}
        return any(between(x, x + slack) for x in pairs)

    for fill in range(room, -1, -1):
        if reach[0] >> fill & 1:
            for items in walk(0, fill):
                yield items, None if dominated(items, room - fill) else fill


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[Pattern]:
    """The best plan found; see the module's text."""
    counts = {s: n for s, n in counts.items() if n > 0}
    if any(s > capacity or s < 1 for s in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    best = best_fit(counts, capacity)
    need, target = sum(n for _, n in best), lower_bound(counts, capacity)
    total, left, path = sum(s * n for s, n in counts.items()), dict(counts), []
    stack: list[tuple[int, int, int]] = []  # waste and bins before, and the first choice not yet tried
    waste = bins = 0

    def choice(first: int) -> tuple[int, dict[int, int], int, int] | None:
        """From the first-th on, a choice that can still beat the incumbent: its number, documents, waste and uses."""
        nonlocal nodes
        top, number = max(s for s, n in left.items() if n), 0
        spare = (need - 1) * capacity - total - waste
        left[top] -= 1
        try:
            for items, fill in fillings(left, capacity - top):
                nodes -= 1
                if nodes < 0:
                    return None
                if fill is None:
                    continue
                lost = capacity - top - fill
                if lost > spare:  # those to come waste no less
                    return None
                times = dict(items)
                times[top] = times.get(top, 0) + 1
                uses = min((left[s] + (s == top)) // n for s, n in times.items())
                while uses:  # as often as the counts allow, then half as often, down to once
                    if number >= first and lost * uses <= spare:
                        return number, times, lost, uses
                    number, uses = number + 1, uses // 2
        finally:
            left[top] += 1
        return None

    first = 0
    while need > target and nodes > 0 and counts:
        if found := choice(first):
            number, times, lost, uses = found
            stack.append((waste, bins, number + 1))
            path.append((tuple(sorted(times.items(), reverse=True)), uses))
            for s, n in times.items():
                left[s] -= n * uses
            waste, bins = waste + lost * uses, bins + uses
            if any(left.values()):
                first = 0
                continue
            if bins < need:
                best, need = list(path), bins
        elif not stack:
            break
        waste, bins, first = stack.pop()
        items, uses = path.pop()
        for s, n in items:
            left[s] += n * uses
    return best


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, memo_size: int = MEMO_SIZE, group_size: int = GROUP_SIZE) -> DataFrame:
    """Every document's pieces with their length and checksum; part and nth count them by task and length."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = coder(path, memo_size, group_size), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            ids, cols = batch.column(0).to_pylist(), [[] for _ in range(7)]
            for doc_id, raw in zip(ids, bpe.encode_batch(batch.column(1).to_pylist()), strict=True):
                raw += end
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for c, v in zip(cols, (doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), part, seen[b - a]), strict=True):
                        c.append(v)
                    seen[b - a] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long", keeps="bpe:")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece of a written table of pieces() its sequence and offset."""
    parts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: first rank, first sequence, times, offset
    taken, sequence = dict.fromkeys(counts, 0), 0
    for items, uses in complete(counts, capacity):
        offset = 0
        for s, times in items:
            slots.setdefault(s, []).append((taken[s], sequence, times, offset))
            taken[s] += uses * times
            offset += s * times
        sequence += uses
    tables = {s: np.array(v, np.int64).T for s, v in slots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length).tolist():
                at = length == s
                first, base, times, begin = tables[s]
                k = np.searchsorted(first, rank[at], "right") - 1
                within = rank[at] - first[k]
                seq[at], offset[at] = base[k] + within // times[k], begin[k] + within % times[k] * s
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))  # a row per task and length
    ranked = cut.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    return map_arrow(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, memo_size: int = MEMO_SIZE, group_size: int = GROUP_SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    memo_size, group_size: segments that a worker memoises in each generation, and characters that it merges at once; more take memory and save time.
    """
    return place(stored(pieces(df, id_col, text_col, path, capacity, end_id, memo_size, group_size), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLE: dict[str, str] = {}
