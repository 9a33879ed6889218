"""MinHash near-duplicates by an inverted join over signature coordinates.

1. One pass over the texts makes, for each document, the hashes of its word shingles, their number, a 128-bit digest of
   the set and a MinHash signature. Documents with equal sets become one class, whatever their number.
2. Each class has a key for each of ``COORDS`` coordinate-value pairs. Keys are counted (an aggregate, combined map-side), and those of one
   class alone go. A pair of classes above the match threshold T of the coordinates shares one of the COORDS - T + 1 rarest
   keys of each side (prefix filter), so a class is posted under those alone, by their counts: under a passage that many
   documents share only where a class has nothing rarer. No table of counts is ever collected or sent about.
3. Collisions are counted over lists in sorted order, a few coordinates at a time, and a pair is skipped as soon as what is
   left can't bring it to the threshold. A short list counts all its pairs. A list of more than ``BLOCK`` members is dealt over salts by its true count;
   each block of a longer list links its members to the member nearest to the block's modal signature, and the blocks' centres
   form a list of the next level.
4. Every candidate is confirmed on the full sets: candidates stream past their centre's set, and hot centres are salted.
5. After components are known, members of long lists that are not of their family's main component are held against all that share
   a list with them, block by block: first by a longer signature, without texts; those blocks that hold someone like them
   then by full sets. So the short cut of 3 loses no link.

Defined results: words are runs of other characters than the six blanks, after lower-casing A-Z. A document with fewer
words than a shingle has one shingle, the whole sequence; without words or text it has none and stands alone. A row
without an id stands alone, its component is null and it is kept. Rows repeated with the same id are one document if
their sets are equal; otherwise each keeps its own set and its own links. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, scratch, shuffled, split_by_ids, stored, table, text_or_empty, whole_groups
from .components import components
from .hashing import mixed, spans_hash, words

#: Coordinates that are posted; all coordinates of a signature, of which eight bits each are kept for counting.
COORDS, WIDTH = 32, 64
#: Coordinates of the longer signature; members of a block that it is compared in, and of one that full sets are.
LONG_WIDTH, LONG_BLOCK, REST_BLOCK = 512, 2048, 1024
#: Members of a list that are merged pair by pair; members of a block of a long list; coordinates that are counted at once.
SHORT, BLOCK, STEP = 16, 1024, 16
#: Members that are confirmed against one copy of a centre's set.
CONFIRM = 512
#: Standard deviations below the expected matches at which a pair is given up.
SLACK = 4.3

_U = np.uint64
#: Odd multipliers from a fixed seed: those of a signature, and those of the longer one.
_LONG_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, LONG_WIDTH, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_MIX = _LONG_MIX[:WIDTH]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, in order, after lower-casing A-Z."""
    b = np.frombuffer(raw, np.uint8)
    begin, end = words(b)
    return spans_hash(np.where((b >= 65) & (b <= 90), b + 32, b), begin, end) if len(begin) else np.zeros(0, _U)


def shingle_set(text: str, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    hashes = word_hashes(text.encode("utf-8", "replace"))
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - width + 1)
    out = np.zeros(n, _U)
    for k in range(min(width, len(hashes))):
        part = hashes[k : k + n]
        out = mixed(out + part) + _U(k)
    return np.unique(out)


def signature(s: np.ndarray, mix: np.ndarray = _MIX) -> np.ndarray:
    """The MinHash coordinates of a set, 64 bits each."""
    least = np.full(len(mix), 0xFFFFFFFFFFFFFFFF, _U)
    for k in range(0, len(s), 2048):
        np.minimum(least, (s[None, k : k + 2048] * mix[:, None]).min(1), out=least)
    return least


def short_form(sig: np.ndarray) -> np.ndarray:
    """Eight bits of each coordinate, for counting collisions."""
    return (sig >> _U(32)).astype(np.uint8)


def least_matches(coords: int, threshold: float) -> int:
    return max(1, math.floor(coords * threshold - SLACK * math.sqrt(coords * threshold * (1 - threshold))))


def _signed(df: DataFrame, width: int) -> DataFrame:
    """doc_id, h and, of the text's set, its size, digest, short signature and the keys of the coordinates that may be posted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "h", "n_shingles", "digest", "sig", "keys"]
        place = np.arange(1, COORDS + 1, dtype=_U)
        for batch in batches:
            n, digest, sig, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, width)
                n.append(len(s))
                if not len(s):
                    for c in (digest, sig, keys):
                        c.append(None)
                    continue
                least = signature(s)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(short_form(least).tobytes())
                keys.append(mixed(mixed(least[:COORDS]) + place).astype(np.int64))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip((n, digest, sig, keys), kinds, strict=True))], names)

    return map_arrow(df, run, "doc_id long, h long, n_shingles long, digest binary, sig binary, keys array<long>")


def postings(classes: DataFrame, threshold: float) -> DataFrame:
    """key, doc, n: the rarest keys of each class (doc, keys) among those that it shares, and how many classes have the key."""
    prefix = COORDS - least_matches(COORDS, threshold) + 1
    every = classes.select("doc", F.explode("keys").alias("key"))
    counts = every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = every.join(shuffled(counts), "key").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("found"))  # COORDS at most
    # the keys that a class has alone are its rarest: they take places of the prefix
    places = F.lit(prefix - COORDS) + F.size("found")
    return shared.filter(places > 0).select("doc", F.explode(F.slice("found", 1, places)).alias("p")).select("p.key", "doc", "p.n")


def _dealt(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """key, salt, salts, doc, sig: postings with the salt of their block, by the number of members that the list really has."""
    posted = lists.filter(F.col("n") > BLOCK).groupBy("key").agg(F.count("*").alias("posted")).filter(F.col("posted") > BLOCK)
    salts = F.coalesce(F.ceil(F.col("posted") / BLOCK), F.lit(1)).cast("int")
    some = lists.filter(F.col("n") > BLOCK).join(posted, "key", "left").select("key", "doc", salts.alias("salts"))
    rows = some.union(lists.filter(F.col("n") <= BLOCK).select("key", "doc", F.lit(1)))
    salt = F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int").alias("salt")
    return rows.join(classes.select("doc", "sig"), "doc").select("key", salt, "salts", "doc", "sig")


def _sigs(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, WIDTH)


def _colliding(a: np.ndarray, b: np.ndarray, matches: int) -> np.ndarray:
    """Which pairs of signatures (rows of a and b, or one row of b for all) collide in enough coordinates.

    Counted STEP coordinates at a time; a pair that the coordinates left can't bring to the threshold is skipped.
    """
    alive, count = np.arange(len(a)), np.zeros(len(a), np.int64)
    for c in range(0, WIDTH, STEP):
        x, y = a[alive, c : c + STEP], b[alive, c : c + STEP] if b.ndim > 1 else b[c : c + STEP]
        count[alive] += (x == y).sum(1)
        alive = alive[count[alive] + WIDTH - STEP - c >= matches]
    return count >= matches


def _merged(lists: DataFrame, matches: int) -> DataFrame:
    """Candidates of all lists, and a row (b null) for the centre of each block of a list of several blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, ["key", "salt"]):
            doc, sig, salts = np.asarray(t.column("doc")), _sigs(t), np.asarray(t.column("salts"))
            sizes = np.diff(bounds)
            found: list[np.ndarray] = []
            for g in np.unique(sizes[(sizes > 1) & (sizes <= SHORT)]).tolist():  # all lists of one size together
                first = bounds[:-1][sizes == g]
                for i in range(g):
                    for j in range(i + 1, g):
                        x, y = first + i, first + j
                        ok = _colliding(sig[x], sig[y], matches)
                        found.append(np.stack([x[ok], y[ok]]))
            centres = []
            for k in np.flatnonzero((sizes > SHORT) | (salts[bounds[:-1]] > 1)).tolist():
                at = np.arange(bounds[k], bounds[k + 1])
                mode = np.array([np.bincount(c, minlength=256).argmax() for c in sig[at].T], np.uint8)
                near = (sig[at] == mode).sum(1)
                c = at[np.lexsort((doc[at], -near))[0]]
                y = at[(doc[at] != doc[c]) & _colliding(sig[at], sig[c], matches)]
                found.append(np.stack([np.full(len(y), c), y]))
                if salts[c] > 1:
                    centres.append(c)
            a, b = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
            c = np.array(centres, np.int64)
            key, raw = np.asarray(t.column("key")), t.column("sig").combine_chunks()
            none = pa.nulls(len(a), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(doc[b]), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()), none], ["a", "b", "key", "salts", "sig"])
            if len(c):
                yield pa.RecordBatch.from_arrays([pa.array(doc[c]), pa.nulls(len(c), pa.int64()), pa.array(key[c]), pa.array(salts[c]), raw.take(pa.array(c))], ["a", "b", "key", "salts", "sig"])

    sort = lists.repartition("key", "salt").sortWithinPartitions("key", "salt")
    return map_arrow(sort, run, "a long, b long, key long, salts int, sig binary")


def _with_texts(need: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``need`` (doc and more) with a text of each class's set: only texts that may be needed are shuffled."""
    keyed = stored(need.join(classes.select("doc", "rep", "h"), "doc"), "need")
    some, _ = split_by_ids(docs, "doc_id", keyed.select("rep"))
    return some.alias("t").join(keyed.alias("k"), (F.col("t.doc_id") == F.col("k.rep")) & (F.col("t.h") == F.col("k.h"))).select("k.*", "t.text").drop("rep", "h")


def _open(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """family, doc, label, main, all, guests: members of long lists whose family isn't one component yet.

    Documents that share a long list make a family (whole lists, so no pair of a list is apart). main: its most frequent label; all: its members; guests: those of other labels.
    """
    first = lists.groupBy("key").agg(F.min("doc").alias("b"))
    shared = lists.join(first, "key").select(F.col("doc").alias("a"), "b")
    family = components(shared.distinct()).select(F.col("id").alias("doc"), F.col("component").alias("family"))
    known = family.join(labels, family["doc"] == labels["id"], "left").select("family", "doc", F.coalesce("component", "doc").alias("label"))
    sizes = known.groupBy("family", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("family").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels"), F.sum("n").alias("all")).filter("labels > 1")
    return known.join(main.select("family", F.col("most.label").alias("main"), "all", (F.col("all") - F.col("most.n")).alias("guests")), "family")


def _visits(members: DataFrame, width: int, percent: int) -> DataFrame:
    """family, doc, salt: blocks of a family (by salt) that hold someone whom an outsider of the main component may be linked with.

    members: of _open, with texts. Signatures alone are compared, blocks of LONG_BLOCK members against as many outsiders at once; a row for each
    outsider and small block, no pairs.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = [short_form(signature(shingle_set(t, width), _LONG_MIX)).tobytes() for t in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(sig, pa.binary())], ["family", "doc", "label", "main", "all", "guests", "sig"])

    signed = map_arrow(members.select("family", "doc", "label", "main", "all", "guests", "text"), sign, "family long, doc long, label long, main long, all long, guests long, sig binary")
    several = lambda c: F.ceil(F.col(c) / LONG_BLOCK).cast("int")
    signed = stored(signed, "signatures").withColumns({"blocks": several("all"), "turns": several("guests")})
    small = F.pmod(F.xxhash64("doc"), F.ceil(F.col("all") / REST_BLOCK)).cast("int").alias("salt")
    rows = signed.withColumn("salt", small)
    own = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    own = own.select("family", F.pmod("salt", "blocks").cast("int").alias("block"), "turn", F.lit(1).alias("guest"), "salt", "doc", "label", "sig")
    guests = rows.filter("label <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    guests = guests.select("family", "block", F.pmod(F.xxhash64("doc", F.lit(1)), "turns").cast("int").alias("turn"), F.lit(2).alias("guest"), "salt", "doc", "label", "sig")
    matches = least_matches(LONG_WIDTH, percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for family, block, turn, guest, salt, doc, label, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (family, block, turn) != at:
                    at, held = (family, block, turn), ([], [], [])
                if guest == 1:
                    for c, v in zip(held, (salt, label, sig), strict=True):
                        c.append(v)
                    continue
                if isinstance(held[0], list):
                    salts, labels, sigs = held
                    held = np.array(salts, np.int32), np.array(labels, np.int64), np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, LONG_WIDTH)
                salts, labels, sigs = held
                other = np.flatnonzero(labels != label)
                near = other[(sigs[other] == np.frombuffer(sig, np.uint8)).sum(1) >= matches]
                out += [(family, doc, s) for s in np.unique(salts[near]).tolist()]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["family", "doc", "salt"])

    both = own.unionByName(guests).repartition("family", "block", "turn").sortWithinPartitions("family", "block", "turn", "guest")
    return map_arrow(both, run, "family long, doc long, salt int")


def _rest(opened: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between members of long lists that are in different components so far, decided on full sets.

    The likeliest pairs of an outsider and a block first; pairs that a link found in the block joins already are left out: only whether components meet matters.
    """
    members = stored(_with_texts(opened, classes, docs).dropDuplicates(["doc"]), "families")
    visits = stored(_visits(members, width, percent), "visits")
    met = visits.groupBy("family", "salt").agg(F.ceil(F.count("*") / REST_BLOCK).cast("int").alias("turns"))
    salt = F.pmod(F.xxhash64("doc"), F.ceil(F.col("all") / REST_BLOCK)).cast("int").alias("salt")
    own = members.select("family", salt, F.lit(1).alias("guest"), "doc", "label", "text").join(met, ["family", "salt"])
    own = own.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select("family", "salt", "turn", "guest", "doc", "label", "text")
    turn = F.pmod(F.xxhash64("doc", F.lit(2)), "turns").cast("int").alias("turn")
    guests = visits.join(met, ["family", "salt"]).select("family", "salt", turn, F.lit(2).alias("guest"), "doc").join(shuffled(members.select("doc", "label", "text")), "doc")
    matches = least_matches(LONG_WIDTH, percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, docs, marks, sets, sigs, joined = None, [], [], [], [], {}

        def root(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        for batch in batches:
            links: list[tuple[int, int]] = []
            for family, salt, turn, guest, doc, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (family, salt, turn) != at:
                    at, docs, marks, sets, sigs, joined = (family, salt, turn), [], [], [], [], {}
                s = shingle_set(text, width)
                sig = short_form(signature(s, _LONG_MIX))
                if guest == 1:
                    for c, v in zip((docs, marks, sets, sigs), (doc, label, s, sig), strict=True):
                        c.append(v)
                    continue
                if isinstance(sigs, list):
                    sigs = np.array(sigs, np.uint8).reshape(-1, LONG_WIDTH)
                same = (sigs == sig).sum(1)
                near = np.flatnonzero(same >= matches)
                for i in near[np.argsort(-same[near], kind="stable")].tolist():
                    if docs[i] == doc or root(marks[i]) == root(label):
                        continue
                    both = len(np.intersect1d(s, sets[i], assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(sets[i]) - both):
                        links.append((docs[i], doc))
                        x, y = root(marks[i]), root(label)
                        joined[max(x, y)] = min(x, y)
            cols = list(zip(*links, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    rows = own.unionByName(guests).repartition("family", "salt", "turn").sortWithinPartitions("family", "salt", "turn", "guest")
    return map_arrow(rows, run, "a long, b long")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""
    degree = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salted = pairs.join(shuffled(degree), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CONFIRM)).cast("int").alias("salt"))
    need = salted.select(F.col("b").alias("doc"), "a", "salt", F.lit(1).alias("member")).union(salted.select(F.col("a").alias("doc"), "a", "salt", F.lit(0)).distinct())
    rows = _with_texts(need, classes, docs).select("a", "salt", "member", "doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, salt, member, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingle_set(text, width)
                if not member:
                    at, centre = (a, salt), s
                elif (a, salt) == at:
                    both = len(np.intersect1d(s, centre, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(centre) - both):
                        out.append((a, doc))
            cols = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return map_arrow(rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "member"), run, "a long, b long")


def near_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, h (xxhash64 of the text), n_shingles, part (the component's own number; null for what links with nothing by definition), component_id of every row."""
    threshold = percent / 100
    matches = least_matches(WIDTH, threshold)
    with scratch():
        docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
        docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
        signed = stored(_signed(docs, width), "signed", keep=True)
        real = signed.filter("doc_id is not null and digest is not null")
        by_set = real.groupBy("digest").agg(F.min(F.struct("doc_id", "h", "sig", "keys")).alias("x"))
        # ids may repeat with other texts: a class has a number of its own, fixed as the table is written
        by_set = by_set.select(F.monotonically_increasing_id().alias("doc"), "digest", F.col("x.doc_id").alias("rep"), F.col("x.h").alias("h"), F.col("x.sig").alias("sig"), F.col("x.keys").alias("keys"))
        classes = stored(by_set, "classes", keep=True)
        lists = stored(postings(classes, threshold), "postings")
        level, candidates = _dealt(lists, classes), []
        while True:
            merged = stored(_merged(level, matches), "merged")
            candidates.append(merged.filter("b is not null").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "b"))
            blocks = F.ceil(F.col("salts") / BLOCK).cast("int")
            centres = merged.filter("b is null").select("key", F.pmod(F.xxhash64("a"), blocks).cast("int").alias("salt"), blocks.alias("salts"), F.col("a").alias("doc"), "sig")
            if centres.isEmpty():
                break
            level = centres
        pairs = candidates[0]
        for more in candidates[1:]:
            pairs = pairs.union(more)
        # of the two directions in which lists may have found a pair, one stays: each centre keeps its members together
        pairs = pairs.groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
        links = stored(_confirmed(pairs, classes, docs, width, percent), "confirmed")
        found = stored(components(links), "components")
        long = lists.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > min(SHORT, BLOCK)).select("key")
        opened = stored(_open(lists.join(long, "key").select("key", "doc"), found), "open")
        if not opened.isEmpty():
            more = stored(_rest(opened, classes, docs, width, percent), "rest")
            if not more.isEmpty():
                found = stored(components(links.union(more)), "components")
        part = classes.join(found, classes["doc"] == found["id"], "left").select("digest", "rep", F.coalesce("component", "doc").alias("part"))
        least = part.groupBy("part").agg(F.min("rep").alias("least"))
        named = stored(part.join(least, "part").select("digest", "part", "least"), "named", keep=True)
    out = signed.select("doc_id", "h", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    return out.select("doc_id", "h", "n_shingles", "part", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = near_rows(df, id_col, text_col, width, percent)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), width=3, percent=85)


QUERIES = {"op10_minhash": op10_minhash}
ORACLE = {
    "op10_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS shingle
                   FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL)
                       JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
             reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
             least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN least ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
}
