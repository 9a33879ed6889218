import math
import re
import time

from seqrank.llm import url_filter as u
from seqrank.llm.url_filter import judged


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :])[0]


def ruled(host, path):
    fits = [(len(h + p), h + p, kind) for kind, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def shape(path):
    return tuple("{hex}" if re.fullmatch("[0-9a-fA-F-]{16,}", s) else re.sub("[0-9]+", "#", s) for s in path.split("/") if s) or ("",)


def brute(pages):
    """The tree by recursion, node by node, over all pages: host and shape to template and purity."""
    stats, out = {}, {}
    for host, s, known in pages:
        t = stats.setdefault((host, s), [0, 0, 0])
        for i, x in enumerate((1, known is not None, known or 0)):
            t[i] += x

    def grow(host, shapes, d, template, purity):
        children = {}
        for s in shapes:
            if len(s) > d:
                children.setdefault(s[d], []).append(s)
        sums = {c: [sum(stats[host, s][i] for s in found) for i in range(3)] for c, found in children.items()}
        n, known, blocked = (sum(x[i] for x in sums.values()) for i in range(3))
        shares = [b / k for _, k, b in sums.values() if k]
        expected = (sum(shares) + u.BRANCHES * purity) / (len(shares) + u.BRANCHES)
        groups = {}
        for seg, (m, k, b) in sums.items():
            rare = len(sums) > u.FAN and m < u.RARE * n
            label = "+" if rare else seg
            if not rare and len(sums) > 1 and k == 0:
                label = "*"
            elif not rare and len(sums) > 1 and known - k > 0:
                p = blocked / known
                if abs(b / k - (blocked - b) / (known - k)) <= u.APART * math.sqrt(p * (1 - p) * (1 / k + 1 / (known - k))):
                    label = "+"
            groups.setdefault(label, []).append(seg)
        for label, segs in groups.items():
            k, b = (sum(sums[c][i] for c in segs) for i in (1, 2))
            own = (b + u.PRIOR * expected) / (k + u.PRIOR)
            below = [s for c in segs for s in children[c]]
            for s in below:
                if len(s) == d + 1:
                    out[host, s] = (f"{template}/{label}", round(own, 6))
            if any(len(s) > d + 1 for s in below):
                grow(host, below, d + 1, f"{template}/{label}", own)

    for host in {h for h, _ in stats}:
        grow(host, [s for h, s in stats if h == host], 0, "", 0.5)
    return out


def test_parts_and_rules(spark):
    urls = [None, "", "abc", "HTTP://A.COM", "http://EXAMPLE.com/en/x?y", "a://b://c/d/e", "http://x.net/es/", "http://www.example.com/en/1", "http://notexample.com/en/1", "http://net/es/", "http://x.net/es", "http://m.www.example.com/en/é#f/", "http://a.com?q=/en/", "x\ny://h.com/\n/z"]
    df = spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(urls)], "page_id long, url string, host string, template string")
    for r in judged(df).collect():
        host, path = parsed(urls[r["page_id"]])
        rule, verdict = ruled(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["host"] and r["purity"] >= u.PURITY else "allow"))


def test_the_tree_against_brute_force(spark):
    pages = []
    for k in range(240):
        bad = k % 4 == 0
        pages.append((f"http://h{k % 2}.org/{'junk' if bad else 'news'}/{k}/{'abcdefghijklmnopqrstuvwxyz'[k % 26]}.html", (1 if bad else 0) if k % 3 else None))
    pages += [(f"http://h0.org/only{'xyz'[k % 3]}", None) for k in range(9)] + [(f"http://h1.org/a/b/c/d/e/f/{k}", 1) for k in range(6)] + [("http://h0.org", 0), ("http://h0.org/", 1), ("http://h1.org/0123456789abcdef01/x", None)]
    df = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(pages)], "page_id long, url string, y int")
    want = brute([(*(lambda h, p: (h, shape(p)))(*parsed(t)), y) for t, y in pages])
    for r in judged(df, rules=(), label_col="y").collect():
        host, path = parsed(pages[r["page_id"]][0])
        template, purity = want[host, shape(path)]
        assert (r["template"], round(r["purity"], 5)) == (template, round(purity, 5))
        assert r["verdict"] == ("block" if purity >= u.PURITY else "allow")
    verdicts = {pages[r["page_id"]][0].split("/")[3]: r["verdict"] for r in judged(df, rules=(), label_col="y").filter("path like '/junk/%' or path like '/news/%'").collect()}
    assert verdicts == {"junk": "block", "news": "allow"}


def test_variable_segments_carry_labels_to_those_without(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    slugs = [a + b + "-page" for a in letters for b in letters[:8]]
    pages = [(f"http://h.org/{top}/{slug}", bad if k % 10 == 0 else None) for top, bad in (("junk", 1), ("news", 0)) for k, slug in enumerate(slugs)]
    df = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(pages)], "page_id long, url string, y int")
    got = {(r["path"].split("/")[1], r["template"], r["verdict"]) for r in judged(df, rules=(), label_col="y").collect()}
    assert got == {("junk", "/junk/+", "block"), ("news", "/news/+", "allow")}


def test_siblings_judge_branches_without_examples(spark):
    urls = ["http://a.net/es/1", "http://a.net/fr/2", "http://a.net/de/3", "http://b.net/es/1", "http://b.net/de/3", "http://c.org/de/1"]
    got = {urls[r["page_id"]]: (r["rule"], r["verdict"]) for r in judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    # two branches of two are blocked: a third is expected to be; after one branch it isn't
    assert got["http://a.net/de/3"] == (None, "block") and got["http://b.net/de/3"] == (None, "allow") and got["http://c.org/de/1"] == (None, "allow")


def test_segments_at_any_depth_are_judged(spark):
    deep = "http://h.org/" + "/".join("abcdefghij")
    pages = [(f"{deep}/{end}/{k}", y) for end, y in (("junk", 1), ("news", 0)) for k in range(12)] + [(f"{deep}/junk/x/{'z' * 70_000}", None)]
    df = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(pages)], "page_id long, url string, y int")
    got = {r["page_id"]: r["verdict"] for r in judged(df, rules=(), label_col="y").collect()}
    assert got == {k: "block" if "/junk/" in t else "allow" for k, (t, _) in enumerate(pages)}


def test_rules_against_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    got = sorted(map(tuple, u.url_rules(spark, d).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    assert got == sorted(db.execute(u.ORACLE["url_rules"]).fetchall())


def test_empty_table_and_repeated_rows(spark):
    schema = "page_id long, url string"
    assert judged(spark.createDataFrame([], schema)).collect() == []
    assert judged(spark.createDataFrame([(None, "http://a.com/"), (1, "http://a.com/"), (1, "http://a.com/")], schema)).count() == 3


def test_chains_are_passed_over_at_once(spark, monkeypatch):
    """Crawl loops with every beginning of a path, long paths alone, and chains that part: as in the recursion, in few levels."""
    levels = []
    real = u._level
    monkeypatch.setattr(u, "_level", lambda at: levels.append(1) or real(at))
    pages = [("http://loop.org/" + "a/" * k, (1 if k % 2 else 0) if k % 3 == 0 else None) for k in range(1, 60)]
    pages += [("http://loop.org/" + "a/" * 30 + "b/" * k, 1) for k in (1, 2)] + [("http://one.org/" + "x/" * 400, None), ("http://one.org/" + "x/" * 400 + "y", 1), ("http://one.org/" + "x/" * 400 + "z", 0)]
    pages += [("http://alone.org/" + "/".join("pqrs" * 200), None), ("http://loop.org/" + "a/" * 30, 1)]
    df = spark.createDataFrame([(k, t, y, "x", "y") for k, (t, y) in enumerate(pages)], "page_id long, url string, y int, rest string, level string")
    want = brute([(*(lambda h, p: (h, shape(p)))(*parsed(t)), y) for t, y in pages])
    for r in judged(df, rules=(), label_col="y").collect():
        host, path = parsed(pages[r["page_id"]][0])
        template, purity = want[host, shape(path)]
        assert (r["template"], round(r["purity"], 5)) == (template, round(purity, 5))
    assert len(levels) <= 5


def test_a_very_deep_path_costs_no_more_jobs(spark):
    def took(depth):
        df = spark.createDataFrame([(1, "http://h.org/" + "/".join("abcde" * (depth // 5)), 0), (2, "http://h.org/q/r", 1)], "page_id long, url string, y int")
        began = time.perf_counter()
        assert judged(df, rules=(), label_col="y").count() == 2
        return time.perf_counter() - began

    took(5)
    assert took(2000) < 2 * took(5) + 5
