"""Profile hidden Markov models: made from aligned sequences by aggregation, scored in Arrow batches.

A column of an alignment in which at least a share of the rows has a residue is a node. A row is a path through the states of the nodes: match
(a residue in a node), insert (a residue between two nodes) and delete (no residue in a node). Emissions and transitions are counts of these
paths, with pseudo-counts. Paths are array expressions over each row, so what is shuffled are counts alone, however many rows a family has.

Scores are natural logarithms of odds against the background: the best path's (Viterbi) and that of all paths (forward), in log space, by
anti-diagonals for many sequences of like length at once: memory grows with the profile's length, not with the sequences'.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import ship, stored
from .meeting import behind, groups, numbered

#: Share of residues that makes a column a node; weights of the background in emissions, and of an even choice in transitions.
SHARE, EMISSION_PRIOR, TRANSITION_PRIOR = 0.5, 1.0, 1.0
#: What stands for no residue.
GAPS = "-."
#: Cells of a table that are worked on at once, and sequences.
CELLS, TOGETHER = 1 << 18, 256
STATES = "MID"


def _match_columns(rows: DataFrame, share: float) -> DataFrame:
    """family, nodes: of each position, the number of its node, or minus the number of the node before it; and size, how many nodes there are."""
    places = rows.select("family", F.posexplode("a").alias("pos", "c"))
    held = F.count(F.when(~F.col("c").isin(*GAPS), 1)) / F.count("*") >= share
    columns = places.groupBy("family", "pos").agg(held.alias("match"))
    flags = columns.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("pos", "match"))).alias("f"))  # as many as the alignment is wide
    step = lambda s, x: F.concat(s, F.array(F.when(x["match"], F.abs(F.element_at(s, -1)) + 1).otherwise(-F.abs(F.element_at(s, -1)))))
    nodes = F.aggregate("f", F.array(F.lit(0)), step)
    return flags.select("family", F.slice(nodes, 2, F.size("f")).alias("nodes"), F.abs(F.element_at(nodes, -1)).alias("size"))


def paths(aligned: DataFrame, family: str = "family", text: str = "aligned", share: float = SHARE) -> DataFrame:
    """family, size, path: the states (node, state, residue) of every aligned row from begin (node 0) to end. Null rows are left out; rows shorter than the alignment end in gaps."""
    rows = aligned.select(F.col(family).alias("family"), F.upper(F.col(text)).alias("t")).filter("t is not null and family is not null and t <> ''")
    width = rows.groupBy("family").agg(F.max(F.length("t")).alias("width"))
    rows = rows.join(width, "family").select("family", F.split(F.rpad("t", F.col("width"), "-"), "").alias("a"))
    known = rows.join(_match_columns(rows, share), "family")
    gap = lambda c: c.isin(*GAPS)

    def state(c: Column, node: Column) -> Column:
        kind = F.when(node > 0, F.when(gap(c), F.lit("D")).otherwise("M")).when(~gap(c), F.lit("I"))
        return F.struct(F.abs(node).alias("node"), kind.alias("state"), F.when(~gap(c), c).alias("residue"))

    inner = F.filter(F.zip_with("a", "nodes", state), lambda s: s["state"].isNotNull())
    end = lambda node: F.array(F.struct(node.cast("int").alias("node"), F.lit("M").alias("state"), F.lit(None).cast("string").alias("residue")))
    return known.select("family", "size", F.concat(end(F.lit(0)), inner, end(F.col("size") + 1)).alias("path"))


def emissions(found: DataFrame, alphabet: str = K.AMINO_ACIDS, prior: float = EMISSION_PRIOR) -> DataFrame:
    """family, node, state (M or I), residue, n, probability of every residue of the alphabet; the background is even."""
    seen = found.select("family", F.explode("path").alias("s")).select("family", "s.*").filter("residue is not null")
    counts = seen.groupBy("family", "node", "state", "residue").agg(F.count("*").alias("n"))
    sizes = found.groupBy("family").agg(F.max("size").alias("size"))
    letters = F.array(*(F.lit(c) for c in alphabet))
    grid = sizes.select("family", F.explode(F.sequence(F.lit(0), F.col("size"))).alias("node")).select("family", "node", F.explode(F.array(F.lit("M"), F.lit("I"))).alias("state"))
    grid = grid.filter("node > 0 OR state = 'I'").select("*", F.explode(letters).alias("residue"))
    known = counts.filter(F.col("residue").isin(*alphabet))
    total = known.groupBy("family", "node", "state").agg(F.sum("n").alias("all"))
    rows = grid.join(known, ["family", "node", "state", "residue"], "left").join(total, ["family", "node", "state"], "left").fillna(0, ["n", "all"])
    return rows.select("family", "node", "state", "residue", "n", ((F.col("n") + prior / len(alphabet)) / (F.col("all") + prior)).alias("probability"))


def transitions(found: DataFrame, prior: float = TRANSITION_PRIOR) -> DataFrame:
    """family, node, source, target, n, probability of every step out of a node's states: to the next node's match or delete, or to the node's own insert. The last node's next match is the end."""
    pairs = F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))
    steps = found.select("family", F.explode(pairs).alias("p")).select("family", F.col("p.a.node").alias("node"), F.col("p.a.state").alias("source"), F.col("p.b.state").alias("target"))
    counts = steps.groupBy("family", "node", "source", "target").agg(F.count("*").alias("n"))
    sizes = found.groupBy("family").agg(F.max("size").alias("size"))
    grid = sizes.select("family", "size", F.explode(F.sequence(F.lit(0), F.col("size"))).alias("node"))
    each = F.array(*(F.lit(c) for c in STATES))
    grid = grid.select("*", F.explode(each).alias("source")).select("*", F.explode(each).alias("target"))
    grid = grid.filter("(node > 0 OR source <> 'D') AND (node < size OR target <> 'D')")  # no delete before the first node or behind the last
    total = counts.groupBy("family", "node", "source").agg(F.sum("n").alias("all"))
    rows = grid.join(counts, ["family", "node", "source", "target"], "left").join(total, ["family", "node", "source"], "left").fillna(0, ["n", "all"])
    ways = F.when(F.col("node") < F.col("size"), 3).otherwise(2)
    return rows.select("family", "node", "source", "target", "n", ((F.col("n") + prior / ways) / (F.col("all") + prior)).alias("probability"))


def profiles(aligned: DataFrame, family: str = "family", text: str = "aligned", alphabet: str = K.AMINO_ACIDS, share: float = SHARE) -> DataFrame:
    """family, size, emissions, transitions: a row for each profile, its tables as arrays of logarithms (of odds, for emissions). Its size grows with the alignment's width alone."""
    found = stored(paths(aligned, family, text, share), "paths")
    odds = F.log(F.col("probability") * len(alphabet))
    letter = F.instr(F.lit(alphabet), F.col("residue"))
    e = emissions(found, alphabet).groupBy("family").agg(F.max("node").alias("size"), F.array_sort(F.collect_list(F.struct("state", "node", letter.alias("letter"), odds.alias("x")))).alias("e"))
    t = transitions(found).groupBy("family").agg(F.array_sort(F.collect_list(F.struct("source", "target", "node", F.log("probability").alias("x")))).alias("t"))
    return e.join(t, "family").select("family", "size", F.transform("e", lambda s: s["x"]).alias("emissions"), F.transform("t", lambda s: s["x"]).alias("transitions"))


class Profile:
    """A profile's tables as matrices: emit[state][node, letter] and step[source + target][node], minus infinity where there is no such step."""

    def __init__(self, size: int, e: list[float], t: list[float], alphabet: str):
        letters = len(alphabet)
        self.size = size
        self.code = np.full(0x110000 if any(ord(c) > 255 for c in alphabet) else 256, letters, np.int16)
        self.code[[ord(c) for c in alphabet]] = np.arange(letters)
        self.emit = {}
        inserts = (size + 1) * letters  # sorted by state: I before M
        unknown = lambda m: np.hstack([m, np.zeros((len(m), 1))])  # noqa: E731  # a letter that isn't of the alphabet has even odds
        self.emit["I"] = unknown(np.array(e[:inserts]).reshape(size + 1, letters))
        self.emit["M"] = unknown(np.vstack([np.full((1, letters), -np.inf), np.array(e[inserts:]).reshape(size, letters)]))
        self.step, at = {}, 0
        for source in "DIM":
            for target in "DIM":
                nodes = np.arange(1 if source == "D" else 0, size if target == "D" else size + 1)
                row = np.full(size + 1, -np.inf)
                row[nodes] = t[at : at + len(nodes)]
                at += len(nodes)
                self.step[source + target] = row

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters as numbers, a row for each text, and the texts' lengths."""
        texts = [t.upper() for t in texts]
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.full((len(texts), int(sizes.max(initial=0))), self.emit["I"].shape[1] - 1, np.int16)
        for k, t in enumerate(texts):
            raw = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)
            known = raw < len(self.code)
            out[k, : len(raw)][known] = self.code[raw[known]]
        return out, sizes

    def scores(self, texts: list[str], add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Each text's score; ``add`` says what two ways to a state are worth: np.maximum (the best path) or np.logaddexp (all paths)."""
        codes, sizes = self.encoded(texts)
        rows, nodes, step = len(texts), self.size + 1, self.step
        node = np.arange(nodes)
        lost = np.full((rows, nodes), -np.inf)
        m1, i1, d1, m2, i2, d2 = (lost for _ in range(6))  # the diagonals one and two before
        out = np.full(rows, -np.inf)
        moved = lambda x, way: (x + way)[:, :-1]
        for diagonal in range(int(sizes.max(initial=0)) + nodes):
            place = diagonal - node  # of each node, how many letters are behind it
            real = (place >= 1) & (place <= codes.shape[1])
            m, i, d = lost.copy(), lost.copy(), lost.copy()
            if diagonal == 0:
                m[:, 0] = 0.0
            d[:, 1:] = add(add(moved(m1, step["MD"]), moved(i1, step["ID"])), moved(d1, step["DD"]))
            if real.any():
                at = node[real]
                letter = codes[:, place[real] - 1]
                i[:, at] = self.emit["I"][at, letter] + add(add(m1 + step["MI"], i1 + step["II"]), d1 + step["DI"])[:, at]
                m[:, 1:] = add(add(moved(m2, step["MM"]), moved(i2, step["IM"])), moved(d2, step["DM"]))
                odds = np.full((rows, nodes), -np.inf)
                odds[:, at] = self.emit["M"][at, letter]
                m = m + odds
            done = np.flatnonzero(sizes + self.size == diagonal)
            if len(done):
                ends = [x[done, -1] + step[s + "M"][-1] for x, s in ((m, "M"), (i, "I"), (d, "D"))]
                out[done] = add(add(ends[0], ends[1]), ends[2])
            m2, i2, d2, m1, i1, d1 = m1, i1, d1, m, i, d
        return out


def profile_scores(df: DataFrame, models: DataFrame, sequence: str = "sequence", alphabet: str = K.AMINO_ACIDS) -> DataFrame:
    """sequence, family, viterbi, forward: each distinct sequence (null ones left out) with each profile, in natural logarithms."""
    ship(df.sparkSession)
    numbers = models.select("family").distinct()
    # families are numbered over their few names
    named = numbers.groupBy().agg(F.array_sort(F.collect_set("family")).alias("f"))
    heads = stored(models.join(F.broadcast(named)).select((F.array_position("f", F.col("family")) - 1).alias("number"), "family", "size", "emissions", "transitions"), "profiles")
    rows = df.select(F.col(sequence).alias("sequence")).filter("sequence is not null").distinct()
    met = behind(numbered(rows, heads.agg(F.max("number")), "number"), heads, "number", "sequence", together=TOGETHER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, profile = None, None
        for head, held in groups(batches, TOGETHER):
            if head is not at:
                at, profile = head, Profile(head[0]["size"], head[0]["emissions"], head[0]["transitions"], alphabet)
            texts = sorted((r["sequence"] for r in held), key=len)
            together = max(1, CELLS // (profile.size + 1))
            for k in range(0, len(texts), together):
                part = texts[k : k + together]
                with np.errstate(invalid="ignore"):
                    best, every = profile.scores(part, np.maximum), profile.scores(part, np.logaddexp)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([at[0]["family"]] * len(part), pa.string()), pa.array(best), pa.array(every)], ["sequence", "family", "viterbi", "forward"])

    return met.mapInArrow(run, "sequence string, family string, viterbi double, forward double")
