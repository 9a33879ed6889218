"""Byte-level BPE by a pair occurrence index, and its decoder.

The distinct pre-tokens of a batch are laid out as one linked list of symbols. An index maps each pair that has a rank
to all its positions in that list; the active ranks are applied in ascending order, each to all its positions at once,
and each merge updates only the lists of the pairs that it touches. A batch's results are memoised by segment (white
space and the word after it), so a frequent word is merged once per worker.

Texts are cut into segments before the tokenizer's own pattern is applied: a pre-token never reaches from a character
that isn't white space over a white-space character behind it, so segments are independent of each other.

Defined results: null counts as empty; an empty text has no tokens. Rows repeated with an id are answered each, rows without one as well; an empty table gives
no rows. Whole texts are encoded, of any length, a segment after another. The vocabulary's added tokens are found in the text
before all else, as the library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_arrow, table, text_or_empty, tokenizer_path

#: Unicode's White_Space property, which the pattern's \s means.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: The byte-level pre-tokenizer's pattern.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The same pattern for the built-in engine, which is faster: it holds for texts up to U+00FF only.
LETTER, NUMBER = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
BLANKS = "\\t-\\r \\x85\\xa0"
LATIN_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{BLANKS}{LETTER}{NUMBER}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
WIDE = re.compile("[^\\x00-\\xff]")
WORD = re.compile(f" ?[{LETTER}]+")
#: Segments that each generation of a worker's memo holds, the longest that it holds, and characters merged at once.
MEMO_SIZE, MEMO_LENGTH, GROUP_SIZE = 500_000, 64, 1 << 23


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Memo(dict):
    """Ids by segment, in two generations: what isn't used while the younger one fills up is forgotten.

    A segment that it doesn't know gives None and is noted in missed.
    """

    def __init__(self, size: int):
        super().__init__()
        self.size = size
        self.older: dict[str, bytes] = {}
        self.missed: list[str] = []

    def __missing__(self, segment: str) -> bytes | None:
        ids = self.older.get(segment)
        if ids is None:
            self.missed.append(segment)
        else:
            self[segment] = ids
        return ids

    def keep(self, learned: dict[str, bytes]) -> None:
        self.missed = []
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()
        self.update((s, b) for s, b in learned.items() if len(s) <= MEMO_LENGTH)


class ByteBPE:
    def __init__(self, path: str, memo_size: int = MEMO_SIZE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        value = {c: b for b, c in enumerate(symbols)}
        self.start = np.array([vocab[c] for c in symbols], np.int32)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.by_rank, born = [], {}
        for rank, (a, b) in enumerate(pairs):
            self.by_rank.append((vocab[a], vocab[b], vocab[a + b]))
            born.setdefault(vocab[a + b], rank)
        if len(born) < len(self.by_rank) or any(max(born.get(x, -1), born.get(y, -1)) >= rank for rank, (x, y, _) in enumerate(self.by_rank)):
            raise ValueError("a merge uses a token that isn't made before it, or two make the same: ranks can't be applied in order")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.added_ids = {token: np.array([i], "<u4").tobytes() for token, i in self.added.items()}
        byte_of = {int(i): b for b, i in enumerate(self.start)}
        self.byte_rank = np.full((256, 256), -1, np.int32)
        left, right = defaultdict(list), defaultdict(list)
        for r, (x, y, _) in enumerate(self.by_rank):
            left[x].append((y, r))
            right[y].append((x, r))
            if x in byte_of and y in byte_of:
                self.byte_rank[byte_of[x], byte_of[y]] = r
        #: For a token as the left or right half of a pair: the other halves and the pairs' ranks.
        self.as_left, self.as_right = ({t: tuple(np.array(v, np.int32).T) for t, v in side.items()} for side in (left, right))
        self.scratch = np.full(len(self.bytes_of), -1, np.int32)
        self.memo, self.group_size = Memo(memo_size), GROUP_SIZE

    def merge_words(self, words: list[str]) -> tuple[bytes, list[int]]:
        """The ids of all pre-tokens in a row as little-endian 32-bit numbers, and where each one's begin (in ids).

        All words are merged together over one pair occurrence index: where[rank] lists the positions of the rank's pair.
        A position whose pair a merge has changed since is passed over when its old rank's turn comes.
        """
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        n = int(sizes.sum()) + len(raw)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        codes = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        sym = self.start[codes]
        sym[begins[1:] - 1] = -1  # no pair reaches over the end of a word
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def post(at: np.ndarray, ranks: np.ndarray) -> None:
            known = ranks >= 0
            if not known.any():
                return
            at, ranks = at[known], ranks[known]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, places in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if r in where:
                    where[r].append(places)
                else:
                    where[r] = [places]
                    heapq.heappush(active, r)

        inner = np.flatnonzero((sym[:-1] >= 0) & (sym[1:] >= 0))
        post(inner, self.byte_rank[codes[inner], codes[inner + 1]])
        scratch = self.scratch
        while active:
            r = heapq.heappop(active)
            x, y, z = self.by_rank[r]
            places = where.pop(r)
            p = np.unique(np.concatenate(places)) if len(places) > 1 else places[0]
            p = p[sym[p] == x]
            q = after[p]
            p = p[sym[q] == y]
            if x == y and len(p) > 1:  # of a run, every other position counts from its first
                took, last = [], -1
                for i in np.sort(p).tolist():
                    if i != last:
                        took.append(i)
                        last = int(after[i])
                p = np.array(took)
            if not len(p):
                continue
            q = after[p]
            k = after[q]
            sym[p], sym[q] = z, -2
            after[p], before[k] = k, p
            for side, at, other in ((self.as_left.get(z), p, sym[k]), (self.as_right.get(z), before[p], None)):
                if side is None:
                    continue
                partners, ranks = side
                if other is None:
                    at = at[at >= 0]
                    other = sym[at]
                scratch[partners] = ranks
                post(at, np.where(other >= 0, scratch[other], -1))
                scratch[partners] = -1
        alive = sym >= 0
        return sym[alive].astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(alive)])[begins].tolist()

    def learn(self, segments: list[str]) -> dict[str, bytes]:
        """Ids of unseen segments as little-endian unsigned 32-bit numbers."""
        whole = set(filter(WORD.fullmatch, segments))
        split = {s: (PATTERN if WIDE.search(s) else LATIN_PATTERN).findall(s) for s in segments if s not in whole}
        words = list(whole.union(*split.values()))
        ids, begins = self.merge_words(words)
        known = {w: ids[4 * a : 4 * b] for w, a, b in zip(words, begins, begins[1:], strict=False)}
        for s, found in split.items():
            known[s] = b"".join(map(known.__getitem__, found))
        return {s: known[s] for s in segments}

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        memo, group, size = self.memo, [], 0
        for k, text in enumerate(texts):
            parts = self.cut.split(text) if self.cut and any(a in text for a in self.added) else [text]
            found: list[bytes | None] = []
            for i, p in enumerate(parts):
                if i % 2:
                    found.append(self.added_ids[p])
                else:
                    found += map(memo.__getitem__, SEGMENT.findall(p))
            group.append(found)
            size += len(text)
            if size < self.group_size and k < len(texts) - 1:
                continue
            learned = self.learn(list(set(memo.missed)))
            filled = map(learned.__getitem__, memo.missed)
            for found in group:
                yield b"".join([b if b is not None else next(filled) for b in found])
            memo.keep(learned)
            group, size = [], 0

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").encode("utf-8")


def coder(path: str, memo_size: int = MEMO_SIZE, group_size: int = GROUP_SIZE) -> ByteBPE:
    """One coder per worker process and vocabulary, kept while tasks of BPE follow each other; its memo and groups have the sizes that were asked for last."""
    found: ByteBPE = kept(f"bpe:{path}", lambda: ByteBPE(path))
    found.memo.size, found.group_size = memo_size, group_size
    return found


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype("int32") for x in bpe.encode_batch(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, ids array<int>", keeps="bpe:")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids; a null list is an empty text."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            texts = [bpe.decode(x or []).decode("utf-8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return map_arrow(rows, run, "doc_id long, text string", keeps="bpe:")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode in one pass, so that only digests leave the worker."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for raw in bpe.encode_batch(batch.column(1).to_pylist()):
                ids = np.frombuffer(raw, "<u4").tolist()
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keeps="bpe:")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op5_bpe": op5_bpe}
ORACLE: dict[str, str] = {}
