import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqrank.llm.periodic import SHORTEST, covered, factors, rewritten, run_digests, run_table, runs, runs_of


def brute(word, shortest=SHORTEST):
    """Every period over the whole word."""
    n, out = len(word), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and word[j] == word[j + p]:
                j += 1
            if j - i >= p and j + p - i >= shortest:
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((i, j - i, p) for (i, j), p in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 4), st.sampled_from([2, 3, 7, 12]))
def test_runs_against_every_period(word, times, shortest):
    assert runs(word * times, shortest) == brute(word * times, shortest)


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_long_periodic_words(seed):
    draw = random.Random(seed)
    word = []
    while len(word) < 600:
        part = [draw.randrange(3 + 10 * (seed % 2)) for _ in range(draw.randrange(1, 40))]
        word += part * draw.randrange(1, 6) + part[: draw.randrange(len(part) + 1)]
    assert runs(word) == brute(word)
    assert runs_of([str(x).encode() for x in word]) == brute(word)


def test_factors_cover_the_word_and_occur_earlier():
    draw = random.Random(2)
    word = [draw.randrange(3) for _ in range(400)]
    end = 0
    for b, e, earlier in factors(word):
        assert b == end
        assert (earlier >= 0 and word[earlier : earlier + e - b] == word[b:e] and earlier < b) or word[b] not in word[:b]
        longer = word[b : e + 1]
        assert e == len(word) or earlier < 0 or not any(word[k : k + len(longer)] == longer for k in range(b))
        end = e
    assert end == len(word)


def test_prose_is_covered_by_nothing():
    import numpy as np

    assert covered(np.arange(1000), 6) == []
    twice = np.concatenate([np.arange(100), np.arange(50, 80), np.arange(200, 300)])
    assert covered(twice, 6) == []  # sequences that come again, but not in their stretch
    assert runs_of([str(x).encode() for x in twice]) == []


def expected(ident, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(ident).encode()) if ident is not None else 1
    if h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    found = brute(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(((-n, s, p) for s, n, p in found), default=None)
    longest = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
    return (ident, len(found), *longest, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_table_against_brute_force(spark, documents):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice("abcd") for _ in range(draw.randrange(60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, "x " * 3000), (104, "a b c " * 7), (104, "a b c " * 7), (None, "a b " * 9), (105, "one\x0btwo\x0c" * 8)]
    got = sorted((tuple(r) for r in run_digests(documents(rows)).collect()), key=str)
    assert got == sorted((expected(*r) for r in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)


def test_empty_table_and_texts_as_they_are(spark, documents):
    assert run_digests(documents([])).collect() == []
    row = run_table(documents([(7, "start " + "a b c " * 5 + "end"), (8, None)])).orderBy("doc_id").collect()
    assert [tuple(r) for r in row[0]["runs"]] == [(1, 15, 3)] and row[0]["collapsed"] == "start a b c end"
    assert row[1]["runs"] == [] and row[1]["collapsed"] == ""


def test_a_very_long_text(spark, documents):
    words = 200_000
    row = run_digests(documents([(1, "lorem ipsum dolor " * (words // 3))]), rewrite=False).first()
    assert (row["n_runs"], row["start"], row["period"], row["length"]) == (1, 0, 3, words // 3 * 3)


def test_rewritten_documents():
    for ident in range(2000):
        if zlib.crc32(str(ident).encode()) % 10 == 0:
            words = [str(k).encode() for k in range(50)]
            again = rewritten(words, ident)
            g = zlib.crc32(str(ident).encode()) // 10
            a = g % 50
            assert again[:a] == words[:a] and len(again) == 50 and set(again) <= set(words)
            return
