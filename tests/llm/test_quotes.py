import random

from seqrank.llm.quotes import levels, linked, normal, passages, reply_order, unquoted

SCHEMA = "conv_id long, turn long, role string, text string, hash string, level string, root string"


def brute(rows):
    parsed = [(c, t, passages(levels(x or ""))) for c, t, _, x in rows]
    tellers = {}
    for c, t, found in parsed:
        for level, h, _ in found:
            if level == 0 and c is not None and t is not None:
                tellers.setdefault((c, h), set()).add(t)
    short = {h for *_, found in parsed for _, h, is_short in found if is_short}
    first = {(c, h): min(turns) for (c, h), turns in tellers.items() if h not in short or len(turns) == 1}
    reply = {}
    for c, t, found in parsed:
        if c is None or t is None:
            continue
        for level, h, _ in found:
            o = first.get((c, h))
            if level > 0 and o is not None and o < t:
                reply[c, t] = min(reply.get((c, t), (level, -o)), (level, -o))
    out = []
    for c, t, role, x in rows:
        root, depth = t, 0
        while (c, root) in reply:
            root, depth = -reply[c, root][1], depth + 1
        level, o = reply.get((c, t), (None, None))
        out.append((c, t, role, None if o is None else -o, level, root, depth, unquoted(levels(x or ""))))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def test_levels_and_passages():
    assert levels(" > > a\n>>b\nc > d\n>") == [(2, "a"), (2, "b"), (0, "c > d"), (1, "")]
    assert normal("  Ab,  C! ") == "ab c"
    two = passages(levels("the first line\nthe second line"))
    assert len(two) == 3 and {p[0] for p in two} == {0}
    assert unquoted(levels("Bob wrote:\n> x\nme\n\n\n\nagain")) == "me\n\nagain"


def test_against_brute_force(spark):
    rng = random.Random(1)
    lines = [f"sentence number {k} says something" for k in range(40)]
    rows, told = [], []
    for turn in range(160):
        own = [rng.choice(lines) if rng.random() < 0.3 else f"turn {turn} adds a line of its own {rng.random()}" for _ in range(rng.randrange(0, 3))]
        quotes = []
        for _ in range(rng.randrange(0, 3) if told else 0):
            quotes += [f"{rng.choice(['> ', '>> ', '> > '])}{line}" for line in rng.choice(told).split("\n")]
        rows.append((turn % 2, turn, "user", "\n".join(quotes + own)))
        told.append("\n".join(own))
    chain = [(7, k, "a", (f"> message number {k - 1} in the chain\n" if k else "") + f"message number {k} in the chain") for k in range(50)]
    rows += chain + [(0, 3, "twin", "another text with the same turn"), (None, 1, "x", "> sentence number 1 says something"), (1, None, "x", "> sentence number 2 says something"), (2, 0, "x", None), (2, 1, "x", ""), (3, 5, "x", "> " * 30_000 + "deep")]
    got = sorted(map(tuple, linked(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    assert {r[6] for r in got if r[0] == 7} == set(range(50))


def test_sentences_and_short_passages(spark):
    rows = [
        (1, 0, "a", "Shall we meet on Monday morning? I could bring the documents. Tea?"),
        (1, 1, "b", "> I could bring\n> the documents.\nplease do"),  # one sentence, wrapped anew
        (1, 2, "c", "yes"),
        (1, 3, "d", "> yes\ngood"),  # short, but one message alone holds it
        (1, 4, "e", "ok"),
        (1, 5, "f", "ok"),
        (1, 6, "g", "> ok\nwhich one?"),  # short, and two messages hold it
        (2, 0, "a", "好的。明天见！"),
        (2, 1, "b", "> 明天见！\n好"),
        (3, 0, "a", "word " * 40_000 + "and a last sentence of it."),
        (3, 1, "b", "> " + "word " * 40_000 + "and a last sentence of it.\nindeed"),
    ]
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in linked(frame(spark, rows)).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {(1, 1): 0, (1, 3): 2, (2, 1): 0, (3, 1): 0}


def test_empty_table(spark):
    assert linked(frame(spark, [])).collect() == []


def test_reply_order_keeps_branches_together(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for conv, shape in ((1, "random"), (2, "chain"), (3, "star"), (4, "alone")):
        above = {}
        for turn in range(40):
            above[turn] = None if not turn or shape == "alone" else {"random": rng.randrange(turn) if rng.random() < 0.9 else None, "chain": turn - 1, "star": 0}[shape]
        below = {}
        for turn, up in above.items():
            below.setdefault(up, []).append(turn)
        for root in below[None]:
            walk, stack = 0, [root]
            while stack:
                turn = stack.pop()
                want[conv, turn] = walk
                walk += 1
                rows.append((conv, turn, above[turn], root))
                stack += sorted(below.get(turn, []), reverse=True)
    rows += [rows[5], (None, 3, None, 3), (1, None, None, None)]
    rng.shuffle(rows)
    got = reply_order(spark.createDataFrame(rows, "conv_id long, turn long, reply_to long, thread_root long")).collect()
    assert len(got) == len(rows)
    assert all(r["position"] == want.get((r["conv_id"], r["turn"]), 0) for r in got)
    assert reply_order(linked(frame(spark, []))).collect() == []


def test_reply_order_of_linked_messages(spark):
    said = ["the first message opens the thread", "> the first message opens the thread\nan early answer to it", "> the first message opens the thread\na second branch of talk", "> an early answer to it\nback to the early branch"]
    got = reply_order(linked(frame(spark, [(1, t, "user", x) for t, x in enumerate(said)]))).collect()
    assert [r["turn"] for r in sorted(got, key=lambda r: r["position"])] == [0, 1, 3, 2]
