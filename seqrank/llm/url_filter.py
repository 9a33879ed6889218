"""URL filters: host and path rules, then a path-template tree per host.

Native: DataFrame functions only. A url that a rule fits has the rule's verdict, and those urls are the labelled examples
from which the tree judges the others (a caller may give other labels). The tree is built on counts of distinct path
shapes, level by level:

* variable segments become wildcards: runs of digits in a segment become ``#``, long hexadecimal ones ``{hex}``, and the children
  of a node with more than FAN different children are merged into ``+`` where each is rare, with examples or without: the
  value of such a segment says nothing, so what is known of some of them holds for all;
* branches of one node are merged if they are statistically alike: those whose share of blocked examples isn't apart
  from their siblings' by a two-proportion test become ``+``. Other branches without examples become ``*``.

The share of blocked examples of a template is smoothed towards what is expected of a new branch of its node: the mean share of the
branches with examples, each counted once, itself smoothed towards the node's own share (one half at the root, so after two
branches of two a new one is expected at 3/4). Branches without examples are thus judged by their siblings, by
how many branches are known and not by how many urls those have. A template is rejected if its smoothed share reaches PURITY.
Every level of a path is a level of the tree. Levels of one branch alone are passed over at once, so the jobs are as many as a path meets nodes
of several branches, not as many as the longest path has segments.
Shapes are aggregated before every shuffle, so a host with a third of all pages is as many rows as it has shapes.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed. Rows repeated
with an id are judged each for itself. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, table

#: The contract's rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Children that make a level variable, the share below which a child is rare.
FAN, RARE = 20, 0.1
#: Standard errors that set a branch apart, weights (in examples, in branches) of what is expected in a smoothed share, share that rejects.
APART, PRIOR, BRANCHES, PURITY = 1.96, 4.0, 2.0, 0.7

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first, so it's added last
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(begin)
        rule = F.when(fits, F.lit(at + begin)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """The path's segments with their digits generalised; of a path without any, one that is empty."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    general = F.transform(segments, lambda s: F.when(s.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("{hex}")).otherwise(F.regexp_replace(s, "[0-9]+", "#")))
    return F.when(F.size(general) > 0, general).otherwise(F.array(F.lit("")))


def _share(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _chain(at: DataFrame) -> DataFrame:
    """All levels at once that hold one branch alone, up to where a node's paths part or end; so what is left has nodes of several branches.

    A level of one branch has its own segment as its name; only the smoothed share changes from level to level, with the paths that end there.
    """
    key = ["host", "template"]
    rows = at.withColumn("rest", F.expr("slice(shape, level + 1, size(shape) - level)"))
    last = rows.groupBy(*key).agg(F.max("rest").alias("last"))  # the paths of a node that are a beginning of its last one lie on the chain
    parts = F.array_position(F.zip_with("rest", F.expr("slice(last, 1, size(rest))"), lambda a, b: a.eqNullSafe(b)), F.lit(False))
    met = rows.join(last, key).withColumn("same", F.when(parts == 0, F.size("rest")).otherwise(parts - 1).cast("int"))
    turn = met.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("same") < F.size("rest"), F.col("same"))), F.max(F.size("last"))).alias("turn"))
    met = stored(met.join(turn, key), "chain")
    sums = [F.sum(c).alias(c) for c in ("known", "blocked")]
    ends = met.filter(F.size("rest") <= F.col("turn")).groupBy(*key, F.size("rest").alias("stop")).agg(*sums)
    ends = ends.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("stop", "known", "blocked"))).alias("ends"))  # one for each length at most
    nodes = met.groupBy(*key).agg(*sums, F.max("purity").alias("above"), F.max("turn").alias("turn")).join(ends, key, "left")

    def deeper(p: Column, levels: Column, known: Column, blocked: Column) -> Column:
        """The smoothed share so many levels on."""
        labelled = F.when(known > 0, F.lit(1)).otherwise(0)

        def step(q: Column, _: Column) -> Column:
            expected = (F.coalesce(_share(blocked, known), F.lit(0.0)) + BRANCHES * q) / (labelled + BRANCHES)
            return (blocked + PRIOR * expected) / (known + PRIOR)

        return F.when(levels > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), p, step)).otherwise(p)

    def passed(s: Column, e: Column) -> Column:
        p = deeper(s["p"], e["stop"] - s["level"], s["known"], s["blocked"])
        out = F.concat(s["out"], F.array(p))
        return F.struct(p.alias("p"), e["stop"].alias("level"), (s["known"] - e["known"]).alias("known"), (s["blocked"] - e["blocked"]).alias("blocked"), out.alias("out"))

    start = F.struct(F.col("above").alias("p"), F.lit(0).alias("level"), "known", "blocked", F.array().cast("array<double>").alias("out"))
    stops = F.coalesce("ends", F.array().cast("array<struct<stop:int,known:bigint,blocked:bigint>>"))
    nodes = nodes.withColumn("s", F.aggregate(stops, start, passed))
    shares = F.map_from_arrays(F.transform(stops, lambda e: e["stop"]), F.col("s.out"))
    end = deeper(F.col("s.p"), F.col("turn") - F.col("s.level"), F.col("s.known"), F.col("s.blocked"))
    nodes = nodes.select(*key, shares.alias("shares"), end.alias("end"))
    far = F.least(F.size("rest"), F.col("turn"))
    name = F.when(far > 0, F.concat("template", F.lit("/"), F.array_join(F.expr("slice(last, 1, least(size(rest), turn))"), "/"))).otherwise(F.col("template"))
    purity = F.when(F.size("rest") <= F.col("turn"), F.try_element_at("shares", F.size("rest"))).otherwise(F.col("end"))
    out = met.drop("purity").join(nodes, key)
    return out.select("host", "shape", "n", "known", "blocked", name.alias("template"), purity.alias("purity"), (F.col("level") + far).alias("level"))


def _level(at: DataFrame) -> DataFrame:
    """The next level of paths: template and purity by host and shape. at: host, shape, n, known, blocked, template, purity, level (how many levels a path has had)."""
    stats = ("n", "known", "blocked")
    at = at.withColumn("segment", F.try_element_at("shape", F.col("level") + 1))
    share = _share
    child = at.groupBy("host", "template", "segment").agg(*(F.sum(c).alias(c) for c in stats), F.max("purity").alias("above"))
    child = child.withColumn("share", share(F.col("blocked"), F.col("known")))
    sums = [F.sum(c).alias(f"all_{c}") for c in stats]
    node = child.groupBy("host", "template").agg(*sums, F.count("*").alias("fan"), F.count("share").alias("labelled"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("shares"), F.max("above").alias("above"))
    expected = (F.col("shares") + BRANCHES * F.col("above")) / (F.col("labelled") + BRANCHES)
    node = node.withColumn("expected", expected).drop("above", "shares", "labelled")
    both = child.drop("above").join(node, ["host", "template"])
    rest_known, rest_blocked = F.col("all_known") - F.col("known"), F.col("all_blocked") - F.col("blocked")
    pooled = share(F.col("all_blocked"), F.col("all_known"))
    error = F.sqrt(pooled * (1 - pooled) * (share(F.lit(1), F.col("known")) + share(F.lit(1), rest_known)))
    gap = F.abs(F.col("share") - share(rest_blocked, rest_known))
    rare = (F.col("fan") > FAN) & (F.col("n") < RARE * F.col("all_n"))
    alike = rare | ((F.col("fan") > 1) & (rest_known > 0) & (gap <= APART * error))
    unknown = (F.col("known") == 0) & (F.col("fan") > 1) & ~rare
    name = F.when(unknown, F.lit("*")).when(alike, F.lit("+")).otherwise(F.col("segment"))
    named = both.select("host", "template", "segment", name.alias("name"), "known", "blocked", "expected")
    merged = named.groupBy("host", "template", "name").agg(F.sum("known").alias("known"), F.sum("blocked").alias("blocked"), F.max("expected").alias("expected"))
    purity = (F.col("blocked") + PRIOR * F.col("expected")) / (F.col("known") + PRIOR)
    found = named.select("host", "template", "segment", "name").join(merged.select("host", "template", "name", purity.alias("purity")), ["host", "template", "name"])
    out = at.drop("purity").join(found, ["host", "template", "segment"])
    return out.select("host", "shape", *stats, F.concat("template", F.lit("/"), "name").alias("template"), "purity", (F.col("level") + 1).alias("level"))


def templates(shapes: DataFrame) -> DataFrame:
    """host, shape, template, purity. shapes: host, shape, n, known, blocked (a row per host and shape)."""
    with scratch():
        # a level uses the one before it several times: written, each is made once, and plans stay small
        now = stored(shapes.withColumns({"template": F.lit(""), "purity": F.lit(0.5), "level": F.lit(0)}), "shapes")
        ended = now.select("host", "shape", "template", "purity").limit(0)
        while not now.isEmpty():
            for step in (_chain, _level):
                now = stored(step(now), "level")
                ended = ended.union(now.filter(F.size("shape") <= F.col("level")).select("host", "shape", "template", "purity"))
                now = now.filter(F.size("shape") > F.col("level"))
        return stored(ended, "templates", keep=True)


def judged(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, label_col: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row.

    label_col: a column with 1 (to be blocked), 0 or null, in place of the rules' verdicts as examples.
    """
    url = F.col(url_col).cast("string")
    label = F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")
    pages = df.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), label.alias("label"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"rule": rule, "ruled": verdict, "shape": shape_of(F.col("path"))})
    example = F.col("label") if label_col else F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    shapes = pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count(example).alias("known"), F.coalesce(F.sum(example), F.lit(0)).alias("blocked"))
    named = pages.join(templates(shapes), ["host", "shape"], "left")
    method = F.when((F.col("host") != "") & (F.col("purity") >= PURITY), F.lit("block")).otherwise(F.lit("allow"))
    return named.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone say of every page: the part of op6_url_filter that SQL can express."""
    host, path = host_of(F.col("url").cast("string")), path_of(F.col("url").cast("string"))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    return pages.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


QUERIES = {"op6_url_filter": op6_url_filter, "url_rules": url_rules}
#: The tree's levels depend on each other, one aggregate after another for as deep as paths go: held against brute force in the tests.
ORACLE = {
    "url_rules": r"""
        WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
             q AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
             r(kind, h, begin) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
             f AS (SELECT page_id, first(h || begin ORDER BY length(h || begin) DESC) AS rule, first(kind ORDER BY length(h || begin) DESC) AS ruled
                   FROM q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, begin) GROUP BY page_id)
        SELECT q.page_id, host, path, rule, ruled FROM q LEFT JOIN f ON q.page_id IS NOT DISTINCT FROM f.page_id"""
}
