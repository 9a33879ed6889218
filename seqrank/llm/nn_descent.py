"""Embedding near-duplicates within a label by NN-descent.

Equal vectors become one class first. A neighbour list is kept for every class: it begins with the nearest of a few
random-hyperplane blocks, and each round joins, around every vector, its neighbours and a sample of those that list it
with each other (neighbours of neighbours); what beats the end of a list enters it. A list whose every entry reaches the
threshold is saturated and is doubled. Rounds end when one of them brings few new edges at the threshold, or after ROUNDS.

The lists are audited then: blocks by fresh hyperplanes show links at random, each with a chance that its angle gives, so
the links that they show, weighted by that chance, estimate the share of all links that the lists hold. What is shown enters the
lists, and rounds and audits go on until the share is RECALL in all, and in every label of which SHOWN links were shown. Where
fewer were shown in all, that says little, and a link at the threshold must have had a chance of RECALL to share one of the blocks so far.
Each audit adds blocks, so every link comes up in the end. No pairs outside of blocks and lists are compared for this.

Lists that are still saturated may leave links out, so their vectors are counted exactly: they are dealt into cells
of vectors linked with a leader, and every vector of the label meets the leaders alone. By the triangle inequality of angles,
its angle with a leader and the cell's radius say that it links with the whole cell, or with none of it; only vectors in between
meet the cell's members. Dense groups cost a few leaders, and labels without saturated lists nothing. Links of all others are those of the lists.

Defined results: a vector that is null, of zero length, or holds null or non-finite numbers, or has no label, links with
nothing, as do vectors of unlike dimension. Rows repeated with an id count as one vector. A row without an id stands alone;
its component is null and it is kept. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, scratch, stored, table, whole_groups
from .components import components

#: Length of a list at first and at most, blocks per vector to begin with, vectors in such a block on average and at most.
LIST, LONGEST, TREES, LEAF, LEAF_MOST = 10, 40, 4, 96, 512
#: Rounds at most before an audit, and the share of edges at the threshold that must be new for another.
ROUNDS, CHANGED = 4, 0.02
#: The share of links that an audit must find in the lists, and links that it must show, in all or of a label, for their share to count.
RECALL, SHOWN = 0.98, 150
#: Leaders, or a fourth of the vectors that meet them, in a block on average. Rows of a block that meet the other at once.
BLOCK, TILE = 2048, 256
#: Angles (radians) nearer to a bound than this are compared exactly.
MARGIN = 1e-6


def _unit(raw: list[bytes]) -> np.ndarray:
    """Vectors (of one dimension) as unit rows in double precision."""
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def _prepared(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, label, digest and the unit vector's bytes; the last two are null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit: list[bytes | None] = []
            for v, label in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ok = None
                if v is not None and label is not None and None not in v:
                    x = np.array(v, np.float64)
                    top = np.abs(x).max() if len(x) else 0.0
                    if np.isfinite(top) and top > 0 and np.isfinite(x).all():
                        x = x / top
                        ok = (x / np.sqrt((x * x).sum())).astype("<f8").tobytes()
                unit.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(unit, pa.binary())], ["vec_id", "label", "vec"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    out = map_arrow(rows, run, "vec_id long, label string, vec binary")
    linkable = F.col("vec").isNotNull() & F.col("vec_id").isNotNull()
    group = F.xxhash64("label", F.length("vec"))
    return out.select("vec_id", F.when(linkable, F.md5(F.concat_ws("|", F.hex("vec"), "label"))).alias("digest"), F.when(linkable, group).alias("label"), F.when(linkable, F.col("vec")).alias("vec"))


def _codes(classes: DataFrame, trees: int, seed: int) -> DataFrame:
    """id, block, salt, bits: blocks of vectors on one side of ``bits`` hyperplanes, drawn from the seed. Full blocks are split by salt."""
    sizes = classes.groupBy("label").agg(F.count("*").alias("n"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF))).cast("int")
    rows = classes.join(sizes, "label").select("id", "label", bits.alias("bits"), "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(3).to_pylist()
            dims = np.array([len(x) // 8 for x in raw], np.int64)
            out = np.zeros((len(raw), trees), np.int64)
            label, bits = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                v = _unit([raw[i] for i in at])
                for t in range(trees):
                    side = v @ np.random.default_rng((seed, t, dim)).standard_normal((dim, 48)) > 0
                    kept = np.arange(48)[None, :] < bits[at][:, None]
                    out[at, t] = ((side & kept) * (1 << np.arange(48))).sum(1)
            n = len(raw)
            cols = [np.repeat(np.asarray(batch.column(0)), trees), np.tile(np.arange(trees, dtype=np.int32), n), np.repeat(label, trees), np.repeat(bits, trees), out.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "tree", "label", "bits", "code"])

    codes = map_arrow(rows, run, "id long, tree int, label long, bits int, code long").select("id", F.xxhash64("tree", "label", "code").alias("block"), "tree", "bits")
    full = codes.groupBy("block").agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.ceil(F.col("n") / LEAF_MOST)).cast("int")
    return codes.join(full, "block").select("id", "block", salt.alias("salt"), "bits")


def _near(groups: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Of each group (keys, id, label, vec, bound, bits), pairs that beat v's bound: v, u, sim, label, bits, at most ``most`` for a v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, keys, 1 << 13):
            ids, label, bound, bits = (np.asarray(t.column(c)) for c in ("id", "label", "bound", "bits"))
            raw = t.column("vec").to_pylist()
            found = []
            for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                if e - s < 2 or len({len(x) for x in raw[s:e]}) > 1:
                    continue
                v = _unit(raw[s:e])
                sim = v @ v.T
                sim[(label[s:e, None] != label[None, s:e]) | (ids[s:e, None] == ids[None, s:e])] = -2
                if e - s > most + 1:
                    cut = np.partition(sim, e - s - most, axis=1)[:, e - s - most]
                    sim[sim < cut[:, None]] = -2
                x, y = np.nonzero(sim > bound[s:e, None])
                found.append((ids[s:e][x], ids[s:e][y], sim[x, y], label[s:e][x], bits[s:e][x]))
            if found:
                cols = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["v", "u", "sim", "label", "bits"])

    return map_arrow(groups.repartition(*keys).sortWithinPartitions(*keys), run, "v long, u long, sim double, label long, bits int")


def _blocks(classes: DataFrame, bound: float, most: int, seed: int) -> DataFrame:
    """Pairs of vectors that share a block of hyperplanes drawn from the seed."""
    rows = classes.select("id", "label", "vec", F.lit(bound).alias("bound"))
    return _near(_codes(classes, TREES, seed).join(rows, "id"), ["block", "salt"], most)


def _trimmed(edges: DataFrame, sizes: DataFrame | None, size: int) -> DataFrame:
    """The best of each list: as many as ``sizes`` says for its vector, else ``size``."""
    most = size if sizes is None else LONGEST
    ranked = edges.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))).filter(F.col("r") <= most)
    if sizes is not None:
        ranked = ranked.join(sizes, ranked["v"] == sizes["id"], "left").filter(F.col("r") <= F.coalesce("size", F.lit(size))).select("v", "u", "sim", "r")
    return ranked.groupBy("v", "u").agg(F.max("sim").alias("sim"))


def _ends(graph: DataFrame, threshold: float, size: int) -> DataFrame:
    """id, size of its list from now on, and the similarity that another vector has to beat to enter it."""
    lists = graph.groupBy(F.col("v").alias("id")).agg(F.count("*").alias("n"), F.min("sim").alias("least"))
    saturated = (F.col("n") >= size) & (F.col("least") >= threshold)
    doubled = F.when(saturated, F.least(F.lit(LONGEST), 2 * F.col("n"))).otherwise(size)
    return lists.select("id", doubled.cast("int").alias("size"), F.when(F.col("n") >= doubled, F.col("least")).otherwise(-1.5).alias("bound"))


def _round(graph: DataFrame, classes: DataFrame, threshold: float, size: int, seed: int) -> DataFrame:
    ends = stored(_ends(graph, threshold, size), "ends")
    listed = graph.groupBy("u").agg(F.count("*").alias("n"))
    back = graph.join(listed, "u").filter(F.pmod(F.xxhash64("u", "v", F.lit(seed)), F.lit(1 << 20)) < (size / F.col("n")) * (1 << 20))
    pairs = graph.select(F.col("v").alias("node"), F.col("u").alias("id")).union(back.select(F.col("u").alias("node"), F.col("v").alias("id")))
    itself = classes.select(F.col("id").alias("node"), "id")
    around = pairs.union(itself).distinct()
    bound = classes.join(ends, "id", "left").select("id", "label", "vec", F.coalesce("bound", F.lit(-1.5)).alias("bound"), F.lit(0).alias("bits"))
    new = stored(_near(around.join(bound, "id").select("node", "id", "label", "vec", "bound", "bits"), ["node"], 2 * size), "new")
    return stored(_trimmed(graph.select("v", "u", "sim").union(new.select("v", "u", "sim")), ends.select("id", "size"), size), "graph")


def _saturated(graph: DataFrame, threshold: float) -> DataFrame:
    """The ids of vectors whose lists are links alone."""
    lists = graph.groupBy(F.col("v").alias("id")).agg(F.count("*").alias("n"), F.min("sim").alias("least"))
    return lists.filter((F.col("n") >= LIST) & (F.col("least") >= threshold)).select("id")


def _audit(graph: DataFrame, shown: DataFrame, threshold: float) -> tuple[float, int]:
    """The share of links that the lists hold, estimated from what fresh blocks show: in all, or of the label where it is least; how many are shown.

    Links of saturated vectors are left out: they are counted exactly.
    """
    ends = F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")
    same = F.pow(1 - F.acos(F.least(F.lit(1.0), F.col("sim"))) / F.lit(np.pi), F.col("bits"))
    links = shown.groupBy(*ends).agg(F.first("label").alias("label"), F.first(1 / (1 - F.pow(1 - same, F.lit(TREES)))).alias("weight"))
    full = stored(_saturated(graph, threshold), "saturated")
    for end in ("a", "b"):
        links = links.join(full.withColumnRenamed("id", end), end, "left_anti")
    held = graph.filter(F.col("sim") >= threshold).select(*ends, F.lit(True).alias("held")).distinct()
    weights = F.sum("weight").alias("all"), F.sum(F.when(F.col("held"), F.col("weight")).otherwise(0.0)).alias("held")
    by_label = links.join(held, ["a", "b"], "left").groupBy("label").agg(F.count("*").alias("shown"), *weights)
    least = F.min(F.when(F.col("shown") >= SHOWN, F.col("held") / F.col("all"))).alias("least")
    *shares, n = by_label.agg(F.try_divide(F.sum("held"), F.sum("all")).alias("share"), least, F.sum("shown")).first()
    return min(1.0 if x is None else x for x in shares), n or 0


def neighbour_graph(classes: DataFrame, threshold: float) -> DataFrame:
    """v, u, sim: the refined lists of a table of classes (id, label, vec)."""
    with scratch():
        most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
        same = (1 - np.arccos(threshold) / np.pi) ** max(0, np.ceil(np.log2(most / LEAF)))
        graph = stored(_trimmed(_blocks(classes, -1.5, LIST, 0), None, LIST), "graph")
        for seed in itertools.count(1):
            for k in range(ROUNDS):
                before, graph = graph, _round(graph, classes, threshold, LIST, ROUNDS * seed + k)
                edges = graph.filter(F.col("sim") >= threshold)
                if edges.join(before, ["v", "u"], "left_anti").count() <= CHANGED * edges.count():
                    break
            shown = stored(_blocks(classes, float(np.nextafter(threshold, -1)), LONGEST, seed), "shown")
            held, n = _audit(graph, shown, threshold)
            chance = 1 - (1 - same) ** (TREES * (seed + 1))
            sizes = _ends(graph, threshold, LIST).select("id", "size")
            graph = stored(_trimmed(graph.union(shown.select("v", "u", "sim")), sizes, LIST), "graph")
            if held >= RECALL and (n >= SHOWN or chance >= RECALL):
                return stored(graph, "lists", keep=True)


def _joining(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> list[tuple[int, int]]:
    """Of pairs of components, those that join what isn't joined in parent yet."""

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in np.unique(np.stack([a, b], 1), axis=0).tolist():
        if (r := root(x)) != (q := root(y)):
            parent[r] = q
            out.append((x, y))
    return out


def _cells(saturated: DataFrame, threshold: float) -> DataFrame:
    """id, cell, radius, total: saturated vectors (id, label, vec, weight) by their leaders, which they are linked with.

    Leaders are taken one by one in blocks of hyperplanes, so a cell has no more members than a block. radius: the widest angle with
    the leader; total: the weight of the cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, ["label", "block", "salt"], 1 << 13):
            ids, weight, raw = np.asarray(t.column("id")), np.asarray(t.column("weight")), t.column("vec").to_pylist()
            for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                v = _unit(raw[s:e])
                sim = v @ v.T
                leader = np.full(e - s, -1)
                for i in range(e - s):
                    if leader[i] < 0:
                        leader[(leader < 0) & (sim[i] >= threshold)] = i
                        leader[i] = i
                angle = np.arccos(np.minimum(1, sim[np.arange(e - s), leader]))
                radius, total = np.zeros(e - s), np.zeros(e - s, np.int64)
                np.maximum.at(radius, leader, angle)
                np.add.at(total, leader, weight[s:e])
                cols = [ids[s:e], ids[s:e][leader], radius[leader], total[leader]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "cell", "radius", "total"])

    keys = ["label", "block", "salt"]
    rows = _codes(saturated.select("id", "label", "vec"), 1, 0).join(saturated, "id").select(*keys, "id", "weight", "vec")
    return map_arrow(rows.repartition(*keys).sortWithinPartitions(*keys), run, "id long, cell long, radius double, total long")


#: What leaders and members find out: links to be summed by id (or by cell, for all its members), two roots that a link joins
#: (id and other), or a vector that must meet a cell's members (id, cell and what is known of it).
_OUT = "id long, links long, other long, cell long, weight long, root long, own long, vec binary"


def _out(**cols: np.ndarray | list) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    names = [c.split()[0] for c in _OUT.split(", ")]
    types = [pa.binary() if c == "vec" else pa.int64() for c in names]
    return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)


def _joins(joins: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if joins:
        yield _out(id=[x for x, _ in joins], other=[y for _, y in joins])


def _with_leaders(members: DataFrame, threshold: float) -> DataFrame:
    """Every vector of the labels that have cells against their leaders (see _OUT). members: root, id, label, vec, weight, cell, radius, total."""
    leaders = members.filter(F.col("id") == F.col("cell"))
    counts = leaders.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ps"))
    counts = members.groupBy("label").agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("qs")).join(counts, "label")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    shared = "label", "id", "root", "vec"
    sent = leaders.join(counts, "label").select(*shared, deal("ps").alias("p"), every("qs").alias("q"), F.lit(1).alias("leads"), F.col("total").alias("weight"), "radius", "cell")
    rows = members.join(counts, "label").select(*shared, every("ps").alias("p"), deal("qs").alias("q"), F.lit(0).alias("leads"), "weight", F.lit(0.0).alias("radius"), "cell")
    keys, limit = ["label", "p", "q"], float(np.arccos(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, keys, 1 << 12):
            ids, root, leads, weight, radius = (np.asarray(t.column(c)) for c in ("id", "root", "leads", "weight", "radius"))
            own, raw = t.column("cell").to_pylist(), t.column("vec").to_pylist()
            for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                a, b = s + np.flatnonzero(leads[s:e] == 0), s + np.flatnonzero(leads[s:e] == 1)
                if not len(a) or not len(b):
                    continue
                y, parent, whole = _unit([raw[i] for i in b]), {}, np.zeros(len(b), np.int64)
                for k in range(0, len(a), TILE):
                    at = a[k : k + TILE]
                    angle = np.arccos(np.clip(_unit([raw[i] for i in at]) @ y.T, -1, 1))
                    sure = angle + radius[b] <= limit - MARGIN
                    may = ~sure & (angle <= limit + radius[b] + MARGIN)
                    whole += (sure * weight[at][:, None]).sum(0)
                    saturated = np.array([own[i] is not None for i in at])
                    # a member of a cell isn't linked with itself; of others than members, the cell's weight counts for them too
                    itself = (sure & (np.array([-1 if own[i] is None else own[i] for i in at])[:, None] == ids[b]) & saturated[:, None]).any(1)
                    links = np.where(saturated, -weight[at] * itself, (sure * weight[b]).sum(1))
                    yield _out(id=ids[at][links != 0], links=links[links != 0])
                    u, v = np.nonzero(sure & (root[at][:, None] != root[b]))
                    if len(u):
                        yield from _joins(_joining(root[at][u], root[b][v], parent))
                    u, v = np.nonzero(may)
                    yield _out(id=ids[at][u], cell=ids[b][v], weight=weight[at][u], root=root[at][u], own=[own[i] for i in at[u]], vec=[raw[i] for i in at[u]])
                yield _out(cell=ids[b][whole > 0], links=whole[whole > 0])

    columns = [*keys, "id", "root", "vec", "leads", "weight", "radius", "cell"]
    both = sent.select(columns).union(rows.select(columns))
    return map_arrow(both.repartition(*keys).sortWithinPartitions(*keys), run, _OUT)


def _with_members(members: DataFrame, between: DataFrame, threshold: float) -> DataFrame:
    """Vectors that leaders leave open against the members of the cell (see _OUT). A cell's vectors are split into chunks."""
    chunks = between.groupBy("cell").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("chunks"))
    shared = "cell", "id", "root", "weight", "vec"
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk")
    rows = between.join(chunks, "cell").select(*shared, chunk, F.lit(0).alias("member"), F.col("own").isNotNull().cast("int").alias("full"))
    inside = members.join(chunks, "cell").select(*shared, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("member"), F.lit(1).alias("full"))
    keys = ["cell", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, keys, 1 << 12):
            ids, root, weight, member, full = (np.asarray(t.column(c)) for c in ("id", "root", "weight", "member", "full"))
            raw = t.column("vec").to_pylist()
            for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                a, b = s + np.flatnonzero(member[s:e] == 0), s + np.flatnonzero(member[s:e] == 1)
                y, parent, inner = _unit([raw[i] for i in b]), {}, np.zeros(len(b), np.int64)
                for k in range(0, len(a), TILE):
                    at = a[k : k + TILE]
                    hit = (_unit([raw[i] for i in at]) @ y.T >= threshold) & (ids[at][:, None] != ids[b])
                    inner += (hit * weight[at][:, None]).sum(0)
                    links = np.where(full[at] == 1, 0, (hit * weight[b]).sum(1))
                    yield _out(id=ids[at][links > 0], links=links[links > 0])
                    u, v = np.nonzero(hit & (root[at][:, None] != root[b]))
                    if len(u):
                        yield from _joins(_joining(root[at][u], root[b][v], parent))
                yield _out(id=ids[b][inner > 0], links=inner[inner > 0])

    both = rows.unionByName(inside)
    return map_arrow(both.repartition(*keys).sortWithinPartitions(*keys), run, _OUT)


def _linked(df: DataFrame, id_col: str, vec_col: str, label_col: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (vec_id, digest), their classes (digest, n, root), and the classes as id, label, vec, weight, links (the weight of the classes linked with it)."""
    with scratch():
        rows = stored(_prepared(df, id_col, vec_col, label_col), "vectors", keep=True)
        real = rows.filter("digest is not null")
        distinct = real.groupBy("digest", "vec_id").agg(F.first("label").alias("label"), F.first("vec").alias("vec"))
        by_digest = distinct.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vec").alias("vec"))
        classes = stored(by_digest, "classes", keep=True)
        graph = neighbour_graph(classes.select("id", "label", "vec"), threshold)
        full = stored(_saturated(graph, threshold), "saturated")
        cells = stored(_cells(classes.join(full, "id", "left_semi"), threshold), "cells")

        ends = F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")
        links = stored(graph.filter(F.col("sim") >= threshold).select(*ends).distinct(), "links")
        inside = cells.filter(F.col("id") != F.col("cell")).select(F.col("id").alias("a"), F.col("cell").alias("b"))
        found = stored(components(links.union(inside)), "components")
        members = classes.join(found, "id", "left").select(F.coalesce("component", "id").alias("root"), "id", "digest", "label", "vec", "weight")
        members = stored(members.join(cells, "id", "left"), "members")

        led = stored(_with_leaders(members, threshold), "led")
        met = stored(_with_members(members.filter("cell is not null"), led.filter("vec is not null"), threshold), "met")
        whole = led.filter("cell is not null and links is not null").groupBy("cell").agg(F.sum("links").alias("links"))
        parts = [cells.join(whole, "cell").select("id", "links")]
        parts += [x.filter("links is not null and id is not null").select("id", "links") for x in (led, met)]
        for end in ("a", "b"):  # saturated vectors' links are counted above
            links = links.join(full.withColumnRenamed("id", end), end, "left_anti")
        weights = classes.select("id", "weight")
        for one, other in (("a", "b"), ("b", "a")):
            parts.append(links.join(weights.withColumnRenamed("id", other), other).select(F.col(one).alias("id"), F.col("weight").alias("links")))
        counted = functools.reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("links").alias("links"))

        joins = led.select("id", "other").union(met.select("id", "other")).filter("other is not null").distinct()
        joined = components(joins.toDF("a", "b")).select(F.col("id").alias("part"), F.col("component").alias("whole"))
        named = members.join(joined, F.col("root") == F.col("part"), "left").join(counted, "id", "left")
        n = (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n")
        named = stored(named.select("digest", "id", n, F.coalesce("whole", "root").alias("root")), "named", keep=True)
    return rows.select("vec_id", "digest"), named, classes


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows, named, _ = _linked(df, id_col, vec_col, label_col, threshold)
    out = rows.join(named.drop("id"), "digest", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _all_links(classes: DataFrame, every: int, threshold: float) -> DataFrame:
    """id, links: brute force, for one in ``every`` classes by a hash of its id. Blocks of them against blocks of all in the label."""
    asked = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(every)) == 0
    sizes = classes.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qs"), F.greatest(F.lit(1), F.ceil(F.count_if(asked) / BLOCK).cast("int")).alias("ps"))
    rows = classes.join(sizes, "label").select("label", "id", "vec", "weight", asked.alias("asked"), "ps", "qs")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys, shared = ["label", "p", "q"], ["id", "vec", "weight"]
    ask = rows.filter("asked").select("label", deal("ps").alias("p"), spread("qs").alias("q"), *shared, F.lit(1).alias("asks"))
    others = rows.select("label", spread("ps").alias("p"), deal("qs").alias("q"), *shared, F.lit(0).alias("asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, keys, 1 << 12):
            ids, weight, asks, raw = *(np.asarray(t.column(c)) for c in ("id", "weight", "asks")), t.column("vec").to_pylist()
            for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                a, b = s + np.flatnonzero(asks[s:e] == 1), s + np.flatnonzero(asks[s:e] == 0)
                if not len(a) or not len(b):
                    continue
                y = _unit([raw[i] for i in b])
                for k in range(0, len(a), TILE):
                    at = a[k : k + TILE]
                    hit = (_unit([raw[i] for i in at]) @ y.T >= threshold) & (ids[at][:, None] != ids[b])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array((hit * weight[b]).sum(1))], ["id", "links"])

    both = ask.unionByName(others)
    return map_arrow(both.repartition(*keys).sortWithinPartitions(*keys), run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def audited(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, every: int = 1) -> DataFrame:
    """One row: found (links between unlike vectors that near_vectors counts), links (all there are, by brute force) and recall, null without any.

    every: of how many vectors one is asked about; its links with all rows count.
    """
    _, named, classes = _linked(df, id_col, vec_col, label_col, threshold)
    all_links = _all_links(classes, every, threshold).join(classes.select("id", "weight"), "id").join(named.select("id", "n"), "id")
    sums = all_links.agg(F.sum(F.col("weight") * (F.col("n") - F.col("weight") + 1)).alias("found"), F.sum(F.col("weight") * F.col("links")).alias("links"))
    found, links = (F.coalesce(F.col(c), F.lit(0)) for c in ("found", "links"))
    return sums.select(found.alias("found"), links.alias("links"), F.try_divide(found.cast("double"), links.cast("double")).alias("recall"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_nn_descent": op9_nn_descent}
ORACLE = {
    "op9_nn_descent": """
        WITH RECURSIVE x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
             ok AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM x
                    WHERE label IS NOT NULL AND v IS NOT NULL AND NOT list_contains(list_transform(v, lambda e: coalesce(isfinite(e), false)), false)),
             links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
                       WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93),
             reach AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
             least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
        SELECT vec_id, count(b) AS n_links, any_value(component_id) AS component_id, vec_id = any_value(component_id) AS kept
        FROM embeddings JOIN least ON id = vec_id LEFT JOIN links ON a = vec_id GROUP BY vec_id"""
}
