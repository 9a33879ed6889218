import numpy as np

from seqrank.llm import nn_descent
from seqrank.llm.nn_descent import audited, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, vec string, digest string, n long"


def brute(rows, threshold=0.93):
    ok = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or None in v:
            continue
        x = np.array(v, np.float32).astype(float)
        if len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            ok[i] = (label, x / np.linalg.norm(x))
    parent = {i: i for i, *_ in rows if i is not None}
    links = dict.fromkeys(parent, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(ok)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], root(i)) for i in parent}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 32)
    rng = np.random.default_rng(1)
    rows = []
    for label in (1, 2):
        rows += [(rng.normal(size=16), label) for _ in range(150)]
        centre = rng.normal(size=16)
        rows += [(centre + 0.1 * rng.normal(size=16), label) for _ in range(70)]  # a group larger than any list
        for _ in range(20):
            x = rng.normal(size=16)
            rows += [(x, label), (x * 3, label), (x + 0.05 * rng.normal(size=16), label)]
    rows += [(np.ones(16), 3)] * 30 + [(np.ones(16), 4), (np.ones(8), 3)]
    order = rng.permutation(len(rows))
    data = [(int(i), [float(x) for x in rows[k][0].astype(np.float32)], rows[k][1], "x", "y", 0) for i, k in enumerate(order)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (1004, [float("inf")] * 16, 1), (1005, [1.0] * 16, None), (1006, [], 3)]
    data += [(*r, "x", "y", 0) for r in odd]
    data += [data[0], (None, [1.0] * 16, 3, "x", "y", 0)]
    df = spark.createDataFrame(data, SCHEMA)
    got = near_vectors(df).collect()
    assert len(got) == len(data)
    want = brute(data[:-2])
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    (none,) = [r for r in got if r["vec_id"] is None]
    assert (none["n_links"], none["component_id"], none["kept"]) == (0, None, True)


def test_empty_tables_and_lone_vectors(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    one = near_vectors(spark.createDataFrame([(7, [1.0, 2.0], 1, "", "", 0)], SCHEMA)).collect()
    assert [tuple(r) for r in one] == [(7, 0, 7, True)]


def groups(spark, rows):
    """Rows in order as vectors of one label; their links and components, and those by brute force."""
    data = [(i, [float(x) for x in v.astype(np.float32)], 1, "", "", 0) for i, v in enumerate(rows)]
    got = near_vectors(spark.createDataFrame(data, SCHEMA)).collect()
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}, brute(data)


def test_groups_that_fill_each_others_lists_are_linked(spark):
    rng = np.random.default_rng(2)
    a, b = np.eye(16)[:2]
    centres = a, 0.945 * a + np.sqrt(1 - 0.945**2) * b
    got, want = groups(spark, [c + 0.002 * rng.normal(size=16) for c in centres for _ in range(60)])
    assert got == want and set(want.values()) == {(119, 0)}


def test_the_audit_counts_what_the_lists_hold(spark):
    rng = np.random.default_rng(5)
    rows = [c + 0.02 * rng.normal(size=16) for c in rng.normal(size=(60, 16)) for _ in range(5)] + list(rng.normal(size=(200, 16)))
    data = [(i, [float(x) for x in v.astype(np.float32)], 1, "", "", 0) for i, v in enumerate(rows)]
    data += [(1000 + i, *data[i][1:]) for i in range(10)]  # copies: a link from each to what the first is linked with
    r = audited(spark.createDataFrame(data, SCHEMA)).first()
    copies = 2 * 10
    assert r["links"] == sum(n for n, _ in brute(data).values()) - copies and r["recall"] >= 0.95
    assert audited(spark.createDataFrame([], SCHEMA)).first()["recall"] is None


def test_dense_bundles_larger_than_any_list(spark):
    """Bundles of 60 about 20 degrees apart: their own members fill all lists, and links across join them."""
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(4):
        a, b = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        for c in (a, np.cos(np.radians(20)) * a + np.sin(np.radians(20)) * b):
            rows += [c + 0.004 * rng.normal(size=32) for _ in range(60)]
    got, want = groups(spark, rows)
    assert got == want and len({c for _, c in want.values()}) == 4


def test_pairs_that_the_graph_misses_are_found(spark, monkeypatch):
    for name, value in (("TREES", 1), ("LEAF", 4), ("ROUNDS", 0)):  # lists are as the first small blocks leave them
        monkeypatch.setattr(nn_descent, name, value)
    rng = np.random.default_rng(3)
    rows = list(rng.normal(size=(300, 32)))
    got, want = groups(spark, rows + [v + 0.3 * rng.normal(size=32) for v in rows[:20]])
    assert got == want and sum(n for n, _ in want.values()) == 40


def test_the_audit_weighs_links_by_their_chance_to_be_shown(spark):
    rng = np.random.default_rng(7)
    sims, bits = rng.uniform(0.93, 1, 200), rng.integers(0, 8, 200)
    shown = [(2 * i, 2 * i + 1, float(s), 5, int(b)) for i, (s, b) in enumerate(zip(sims, bits, strict=True))]
    shown += [(u, v, *rest) for v, u, *rest in shown]  # blocks show a pair from both sides
    held = rng.random(200) < 0.6
    graph = [(2 * i, 2 * i + 1, float(sims[i])) for i in np.flatnonzero(held).tolist()] + [(2 * i, 2 * i + 1, 0.2) for i in np.flatnonzero(~held).tolist()]
    weight = 1 / (1 - (1 - (1 - np.arccos(sims) / np.pi) ** bits) ** nn_descent.TREES)
    got, n = nn_descent._audit(
        spark.createDataFrame(graph, "v long, u long, sim double"), spark.createDataFrame(shown, "v long, u long, sim double, label long, bits int"), 0.93
    )
    assert n == 200 and abs(got - (weight * held).sum() / weight.sum()) < 1e-9
    nothing = spark.createDataFrame([], "v long, u long, sim double"), spark.createDataFrame([], "v long, u long, sim double, label long, bits int")
    assert nn_descent._audit(*nothing, 0.93) == (1.0, 0)


def test_saturated_vectors_meet_few_others(spark):
    """A label of 5200 vectors, of which 1200 lie close together: leaders decide nearly all pairs, and counts are those of brute force."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=32)
    v = np.concatenate([centre + 0.03 * rng.normal(size=(1200, 32)), centre + 0.35 * rng.normal(size=(200, 32)), rng.normal(size=(3800, 32))])
    v /= np.linalg.norm(v, axis=1)[:, None]
    weight = rng.integers(1, 4, len(v))
    rows = [(i, 7, x.astype("<f8").tobytes(), int(w)) for i, (x, w) in enumerate(zip(v, weight, strict=True))]
    classes = spark.createDataFrame(rows, "id long, label long, vec binary, weight long")
    cells = nn_descent._cells(classes.filter("id < 1200"), 0.93).persist()
    assert cells.count() == 1200
    members = classes.withColumn("root", classes["id"]).join(cells, "id", "left").persist()
    led = nn_descent._with_leaders(members, 0.93).persist()
    met = nn_descent._with_members(members.filter("cell is not null"), led.filter("vec is not null"), 0.93)
    links = dict.fromkeys(range(len(v)), 0)
    edges = set()
    inside = {}
    for r in cells.collect():
        inside.setdefault(r["cell"], []).append(r["id"])
        edges.add((r["id"], r["cell"]))
    for r in led.collect() + met.collect():
        if r["other"] is not None:
            edges.add((r["id"], r["other"]))
        elif r["links"] is not None:
            for i in inside[r["cell"]] if r["id"] is None else [r["id"]]:
                links[i] += r["links"]
    hit = (v @ v.T >= 0.93) & ~np.eye(len(v), dtype=bool)
    full = np.arange(len(v)) < 1200
    want = (hit * weight)[:, :].sum(1) * full + (hit * (weight * full)).sum(1) * ~full
    assert [links[i] for i in range(len(v))] == want.tolist()
    assert all(hit[a, b] or a == b for a, b in edges if b in inside)
    compared = len(inside) * len(v) + sum(len(inside[r["cell"]]) for r in led.filter("vec is not null").select("cell").collect())
    assert compared < 0.1 * len(v) ** 2


def test_bundles_of_a_hundred_whose_links_cross(spark):
    rng = np.random.default_rng(9)
    a, b = np.eye(32)[:2]
    rows = []
    for turn in (0, 19, 38):  # the first and the last are linked through the one between alone
        centre = np.cos(np.radians(turn)) * a + np.sin(np.radians(turn)) * b
        rows += [centre + 0.003 * rng.normal(size=32) for _ in range(100)]
    got, want = groups(spark, rows + list(rng.normal(size=(150, 32))))
    assert got == want and max(n for n, _ in want.values()) == 299
