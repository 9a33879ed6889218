import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from seqrank.llm.common import tokenizer_path
from seqrank.llm.packing import CAPACITY, END_ID, best_fit, complete, lower_bound, pack


def used(plan):
    out = Counter()
    for items, uses in plan:
        for s, n in items:
            out[s] += n * uses
    return out


def fewest(sizes, capacity):
    """Exact bin packing of a few documents."""

    @lru_cache(None)
    def solve(left):
        if not left:
            return 0
        best = len(left)
        first, rest = left[0], left[1:]
        for mask in range(1 << len(rest)):
            if first + sum(s for i, s in enumerate(rest) if mask >> i & 1) <= capacity:
                best = min(best, 1 + solve(tuple(s for i, s in enumerate(rest) if not mask >> i & 1)))
        return best

    return solve(tuple(sorted(sizes, reverse=True)))


def test_plans_are_optimal_on_small_cases():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randrange(1, 10))]
        plan = complete(Counter(sizes), 30)
        assert used(plan) == Counter(sizes) and all(sum(s * n for s, n in items) <= 30 for items, _ in plan)
        assert lower_bound(Counter(sizes), 30) <= fewest(sizes, 30) == sum(u for _, u in plan)


def test_plans_of_many_documents_are_never_worse_than_best_fit():
    rng = random.Random(4)
    for draw in (lambda: rng.randint(1, 1024), lambda: rng.randint(300, 600), lambda: max(1, min(1024, int(rng.expovariate(1 / 300))))):
        counts = Counter(draw() for _ in range(3000))
        plan = complete(counts, 1024)
        assert used(plan) == counts
        assert lower_bound(counts, 1024) <= sum(u for _, u in plan) <= sum(u for _, u in best_fit(counts, 1024))
    assert complete({}, 10) == []
    with pytest.raises(ValueError):
        complete({11: 1}, 10)


def test_fillings_of_many_documents_are_found():
    plan = complete({200: 1000, 156: 2000}, 1024)
    assert used(plan) == {200: 1000, 156: 2000} and sum(u for _, u in plan) == 500  # 2 x 200 + 4 x 156 = 1024
    rng = random.Random(6)
    for _ in range(15):
        sizes = [rng.randint(2, 9) for _ in range(12)]
        assert sum(u for _, u in complete(Counter(sizes), 29)) == fewest(sizes, 29)


def test_a_filling_is_used_less_often_than_the_counts_allow():
    counts = {6: 4, 4: 2, 3: 4, 2: 2}
    plan = complete(counts, 12)
    assert used(plan) == counts and sum(u for _, u in plan) == fewest([s for s, n in counts.items() for _ in range(n)], 12)


def check(rows, texts):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + [END_ID] for k, t in texts.items()}
    sequences, whole = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        whole.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAPACITY
    for k, parts in whole.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts))) and sum(p[2] for p in parts) == len(ids[k])
        assert all(p[2] == CAPACITY for p in parts[1:]) and [p[1] for p in parts] == [sum(q[2] for q in parts[:i]) for i in range(len(parts))]
    assert set(whole) == set(texts)
    return len(sequences)


def test_pieces_and_places(documents):
    rng = random.Random(5)
    texts = {k: " ".join(rng.choice(["word", "thing", "x", "длинное", "中文"]) for _ in range(rng.randrange(0, 900))) for k in range(60)}
    texts |= {100: None, 101: "", 102: "long " * 5000, 103: "a " * 1022 + "b", 104: "same", 105: "same", 106: "<|endoftext|> x"}
    rows = pack(documents(list(texts.items()))).collect()
    n = check(rows, texts)
    counts = Counter(r["length"] for r in rows)
    assert lower_bound(counts, CAPACITY) <= n <= sum(u for _, u in best_fit(counts, CAPACITY))


def test_repeated_and_missing_ids_and_empty_tables(documents):
    rows = pack(documents([(1, "a"), (1, "a"), (None, "b")])).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    assert pack(documents([])).collect() == []
