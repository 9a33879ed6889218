"""Runs (maximal repetitions) of words by Kolpakov and Kucherov's algorithm, and texts without their repeats.

A stretch of words is cut into Lempel-Ziv factors: a factor is the longest prefix of what is left that occurs earlier too
(overlapping itself or not), or one new word; a suffix automaton tells how far it goes and where it occurred first. A run that is not
strictly inside one factor touches or crosses a border, and reaches back from a factor by less than twice the
factor before it and once its own length: Main's extension functions (Z arrays) find these runs, linear in the two factors. A run
strictly inside a factor is a copy of one in the factor's earlier occurrence, and is copied from there.

Each position of a run that counts lies in a sequence of SEED words that comes again in the same run: a run of length n and period q
is n - q >= n / 2 words that come again q words on. So stretches not covered by repeated sequences are left to no algorithm at all;
what is looked for in the covered ones is exactly what the whole text holds. Whole texts are read, one document at a time, in
time and memory that grow with its words (and the runs) alone; no rows move between tasks.

Defined results: a null text has no words. Rows repeated with an id are answered each. A document without an id is left as it is
(no words of it are replaced), and an empty table gives no rows. Bytes that aren't UTF-8 are words as they are.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

#: The shortest run that counts, and the length of the sequences that come again in each of them: half of it.
SHORTEST = 12
U = np.uint64


class Automaton:
    """The suffix automaton of a sequence of small integers. Most states have one way on, which is held in two lists; others have a dict."""

    def __init__(self, word: Sequence[int]):
        self.first = [-1]  # where the first occurrence of a state's strings ends
        self.symbol, self.target = [-1], [0]
        self.more: dict[int, dict[int, int]] = {0: {}}
        length, link = [0], [-1]
        first, symbol, target, more = self.first, self.symbol, self.target, self.more
        last = 0
        for i, c in enumerate(word):
            state = len(length)
            length.append(i + 1)
            link.append(0)
            first.append(i)
            symbol.append(-1)
            target.append(0)
            p = last
            while p >= 0:
                if p in more:
                    ways = more[p]
                    if c in ways:
                        q = ways[c]
                        break
                    ways[c] = state
                elif symbol[p] == -1:
                    symbol[p], target[p] = c, state
                elif symbol[p] == c:
                    q = target[p]
                    break
                else:
                    more[p] = {symbol[p]: target[p], c: state}
                p = link[p]
            else:
                last = state
                continue
            if length[q] != length[p] + 1:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                first.append(first[q])
                symbol.append(symbol[q])
                target.append(target[q])
                if q in more:
                    more[twin] = dict(more[q])
                link[q] = twin
                while p >= 0:
                    if p in more:
                        if more[p].get(c) != q:
                            break
                        more[p][c] = twin
                    elif symbol[p] == c and target[p] == q:
                        target[p] = twin
                    else:
                        break
                    p = link[p]
                q = twin
            link[state] = q
            last = state

    def step(self, state: int, c: int) -> int:
        """The state after c, or -1."""
        ways = self.more.get(state)
        if ways is not None:
            return ways.get(c, -1)
        return self.target[state] if self.symbol[state] == c else -1


def factors(word: Sequence[int]) -> list[tuple[int, int, int]]:
    """(begin, end, earlier begin or -1) of each Lempel-Ziv factor."""
    automaton = Automaton(word)
    out, s, n, first, step = [], 0, len(word), automaton.first, automaton.step
    while s < n:
        state, e = 0, s
        while e < n:
            after = step(state, word[e])
            if after < 0 or first[after] >= e:
                break
            state, e = after, e + 1
        if e == s:
            out.append((s, s + 1, -1))
            e = s + 1
        else:
            out.append((s, e, first[state] - (e - s) + 1))
        s = e
    return out


def z_array(word: list[int]) -> list[int]:
    """Of each position, how many symbols from there on equal the first ones."""
    n = len(word)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and word[k] == word[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _crossing(word: list[int], b: int, e: int, reach: int) -> Iterator[tuple[int, int, int]]:
    """(begin, end, period) of repetitions that touch or cross the border before b, between b - reach and e, as far as they go there."""
    t, u = word[b - reach : b], word[b:e]
    n, m = len(u), len(t)
    ahead = z_array([*u, -1, *t, *u])  # from n + 1 on: how far a place of t or u goes on like u
    behind = z_array([*t[::-1], -1, *u[::-1], *t[::-1]])  # the same backwards, from the end of t
    for p in range(1, m + 1):  # the part before b holds a period
        f, g = min(ahead[n + 1 + m - p], n), behind[m + 1 + n + p] if p < m else 0
        if f + g >= p:
            yield b - p - g, b + f, p
    for p in range(1, n + 1):  # the part from b on does
        f, g = (ahead[p] if p < n else 0), min(behind[m + 1 + n - p], m)
        if f + g >= p:
            yield b - g, b + p + f, p


def runs(word: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal repetition of at least two periods and ``shortest`` symbols, by start, then period."""
    n = len(word)
    cut = factors(word)
    starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (end, period) by start, ends ascending once complete
    known: dict[tuple[int, int], int] = {}

    def cross(b: int, e: int, before: int) -> None:
        found: dict[tuple[int, int], int] = {}
        for i, j, p in _crossing(word, b, e, min(b, 2 * before + e - b)):
            if j - i < shortest or (i > 0 and word[i - 1] == word[i - 1 + p]) or (j < n and word[j] == word[j - p]):
                continue  # too short, or it goes on: another border has it whole
            if p < found.get((i, j), n):
                found[i, j] = p
        for (i, j), p in found.items():
            if (i, j) not in known:
                known[i, j] = p
                starting[i].append((j, p))

    for h, (b, e, earlier) in enumerate(cut):
        cross(b, e, cut[h - 1][1] - cut[h - 1][0] if h else 0)
        if earlier >= 0 and e - b > shortest:
            back = b - earlier
            for i in range(b + 1, e):
                for j, p in starting[i - back]:
                    if j + back < e and (i, j + back) not in known:
                        known[i, j + back] = p
                        starting[i].append((j + back, p))
    if n:
        cross(n, n, cut[-1][1] - cut[-1][0])  # those that end with the last factor
    return sorted((i, j - i, p) for (i, j), p in known.items())


def covered(codes: np.ndarray, seed: int) -> list[tuple[int, int]]:
    """Stretches (begin, end) in which every position lies in a sequence of ``seed`` symbols that occurs twice in the stretch."""
    n = len(codes)
    if n < 2 * seed:
        return []
    h = np.zeros(n - seed + 1, U)
    base = (codes.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
    base ^= base >> U(29)
    for k in range(seed):  # unlike sequences of one hash cover too much, never too little
        h = h * U(0xD6E8FEB86659FD93) + base[k : k + len(h)]
    owner = np.zeros(len(h), U)
    inside = np.ones(len(h), bool)
    before = -1
    while True:
        at = np.flatnonzero(inside)
        if len(at) == before or not len(at):
            break
        before = len(at)
        key = h[at] + owner[at] * U(0xA0761D6478BD642F)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        at = at[twice]
        inside[:] = False
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + seed, -1)
        cover = np.cumsum(edge[:-1]) > 0
        number = np.cumsum(np.diff(cover, prepend=False) & cover)  # of each covered position, its stretch
        inside[at] = True
        owner[at] = number[at].astype(U)
    if not before or not inside.any():
        return []
    change = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
    return [(s, e) for s, e in zip(change[::2].tolist(), change[1::2].tolist(), strict=True) if e - s >= 2 * seed]


def runs_of(words: list[bytes], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``shortest`` words, by start, then period."""
    if len(words) < shortest or shortest < 2:
        return []
    code: dict[bytes, int] = {}
    codes = np.fromiter(map(code.setdefault, words, itertools.count()), np.int64, len(words))
    out = []
    for s, e in covered(codes, shortest // 2):
        out += [(s + start, length, period) for start, length, period in runs(codes[s:e].tolist(), shortest)]
    return out


def rewritten(words: list[bytes], ident: int | None) -> list[bytes]:
    """The words of a document, those of every tenth one repeated from a place of its own on, as the contract says."""
    n = len(words)
    h = zlib.crc32(str(ident).encode()) if ident is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + list(itertools.islice(itertools.cycle(period), n - a))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that a run holds behind its first period."""
    if not found:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join(itertools.compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def _described(rows: Iterator[tuple[int | None, bytes | None]], rewrite: bool) -> Iterator[tuple[int | None, list[tuple[int, int, int]], bytes]]:
    for ident, text in rows:
        words = (text or b"").split()  # at the six white-space characters, as bytes are
        if rewrite:
            words = rewritten(words, ident)
        found = runs_of(words)
        yield ident, found, collapsed(words, found)


def run_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (start, length, period) and the collapsed text of every row, for texts as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_described(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), rewrite=False))
            names = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
            found = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for _, f, _ in rows], pa.list_(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), found, pa.array([c for _, _, c in rows], pa.binary())], ["doc_id", "runs", "collapsed"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return map_arrow(rows, run, SCHEMA).select("doc_id", "runs", F.col("collapsed").cast("string").alias("collapsed"))


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = True) -> DataFrame:
    """One row per document: the number of runs, the longest one, and digests of all runs and of the collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ident, found, text in _described(zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True), rewrite):
                top = min(((-length, start, period) for start, length, period in found), default=None)
                longest = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
                listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
                out.append((ident, len(found), *longest, listed, hashlib.sha256(text).hexdigest()))
            names = [c.split()[0] for c in DIGEST.split(", ")]
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names)

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return map_arrow(rows, run, DIGEST)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLE = {
    # crc32 by its table; a run is an island of places whose six words come again q words on
    "op12_periodic_runs": f"""
        WITH crc_table AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || range(8), lambda c, i:
                 CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)::BIGINT AS c FROM range(256) AS r(b))),
             split AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce("text", ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
                 CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT),
                     lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) END AS h FROM documents, crc_table),
             shaped AS (SELECT row, doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS again, (h // 10) % greatest(len(words), 1) AS a,
                 1 + (len(words) - (h // 10) % greatest(len(words), 1)) // (3 + (h // 10) % 8) AS p FROM split),
             texts AS MATERIALIZED (SELECT row, doc_id, n, CASE WHEN again THEN list_transform(range(n), lambda i: words[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE words END AS w FROM shaped),
             placed AS (SELECT row, n, w, unnest(range(n)) AS i FROM texts),
             grams AS MATERIALIZED (SELECT row, i, hash(w[i + 1 : i + 6]) AS g FROM placed WHERE i + 6 <= n),
             equal AS (SELECT x.row, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.row = y.row AND x.g = y.g AND x.i < y.i),
             islands AS (SELECT row, q, min(i) AS start, max(i) - min(i) + 6 + q AS length FROM
                 (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM equal) GROUP BY row, q, island),
             found AS MATERIALIZED (SELECT row, start, length, min(q) AS period FROM islands WHERE length >= 2 * q AND length >= {SHORTEST} GROUP BY ALL),
             gone AS MATERIALIZED (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM found),
             kept AS (SELECT row, string_agg(w[i + 1], ' ' ORDER BY i) AS body FROM placed ANTI JOIN gone USING (row, i) GROUP BY row),
             listed AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS body,
                 min((-length, start, period)) AS top FROM found GROUP BY row)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top[2] AS start, -top[1] AS length, top[3] AS period, 1000 * -top[1] // top[3] AS exponent_milli,
               sha256(coalesce(l.body, '')) AS runs_sha256, sha256(coalesce(k.body, '')) AS collapsed_sha256
        FROM texts LEFT JOIN listed l USING (row) LEFT JOIN kept k USING (row)"""
}
