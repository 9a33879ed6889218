import hashlib
import random
import re

from pyspark.sql import functions as F

from seqrank.llm.exact_dedup import content_groups


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        norm = re.sub("[\x20\x09-\x0d]", "", t or "")
        keep = min(groups[norm])[3]
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(documents):
    rng = random.Random(1)
    texts = ["", None, " ", "a b", "ab", "a\tb\n", "a\x0bb", "a\xa0b", "é", "e\u0301", "\U0001f600 x", "x" * 200_000, "x" * 199_999 + " x"]
    rows = [(k, rng.choice(texts)) for k in range(80)] + [(3, "again"), (3, "again"), (None, "a b"), (None, "alone"), (None, None)]
    got = sorted(map(tuple, content_groups(documents(rows)).collect()), key=str)
    assert got == brute(rows)


def test_texts_that_share_a_hash_are_told_apart(documents, monkeypatch):
    monkeypatch.setattr(F, "md5", lambda c: F.lit("00" * 16))
    rows = [(1, "a"), (2, "b"), (3, "a "), (4, "b")]
    assert sorted(map(tuple, content_groups(documents(rows)).collect()), key=str) == brute(rows)


def test_empty_table(documents):
    assert content_groups(documents([])).collect() == []
