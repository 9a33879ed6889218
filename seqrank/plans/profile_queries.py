"""Queries over profiles and substitution matrices. Names of parts stand for sequences: their two words, each padded with gaps, are an alignment, and their type is the family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import matrices, profiles
from . import scores
from .catalogue import REFS, Catalogue, r6, references, table

C = Catalogue()
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WIDTH = 8


def aligned(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, d, "part").select(F.col("p_type").alias("family"), F.concat(*(F.rpad(F.get(words, F.lit(k)), WIDTH, "-") for k in (0, 1))).alias("aligned"))


_PATHS = (
    f"rows AS (SELECT p_partkey AS row, p_type AS family, upper(rpad(split_part(p_name, ' ', 1), {WIDTH}, '-') || rpad(split_part(p_name, ' ', 2), {WIDTH}, '-')) AS t FROM part), "
    f"chars AS (SELECT row, family, pos, substr(t, pos, 1) AS c FROM rows, range(1, {2 * WIDTH + 1}) AS r(pos)), "
    "shares AS (SELECT family, pos, 2 * count(*) FILTER (c <> '-') >= count(*) AS match FROM chars GROUP BY ALL), "
    "cols AS (SELECT family, pos, match, sum(match::INTEGER) OVER (PARTITION BY family ORDER BY pos) AS node FROM shares), "
    "sizes AS (SELECT family, max(node)::BIGINT AS size FROM cols GROUP BY family), "
    "states AS (SELECT row, family, pos, node, CASE WHEN match AND c = '-' THEN 'D' WHEN match THEN 'M' WHEN c <> '-' THEN 'I' END AS state, c FROM chars JOIN cols USING (family, pos)), "
    "walk AS (SELECT row, family, pos, node, state FROM states WHERE state IS NOT NULL UNION ALL SELECT row, family, 0, 0, 'M' FROM rows UNION ALL SELECT row, family, 1000, size + 1, 'M' FROM rows JOIN sizes USING (family)), "
    "steps AS (SELECT family, lag(node) OVER w AS node, lag(state) OVER w AS source, state AS target FROM walk WINDOW w AS (PARTITION BY row ORDER BY pos)), "
    "nodes AS (SELECT family, size, unnest(range(0, size + 1)) AS node FROM sizes)"
)


@C.add(
    "profile_emissions",
    f"WITH {_PATHS}, n AS (SELECT family, node, state, c AS residue, count(*) AS n FROM states WHERE state <> 'D' GROUP BY ALL), "
    f"g AS (SELECT family, node, state, residue FROM nodes, (VALUES ('M'), ('I')) AS s(state), (SELECT unnest(string_split('{LETTERS}', '')) AS residue) WHERE node > 0 OR state = 'I') "
    "SELECT family, node::INTEGER AS node, state, residue, coalesce(n, 0) AS n, round((coalesce(n, 0) + 1 / 26::DOUBLE) / (coalesce(sum(n) OVER (PARTITION BY family, node, state), 0) + 1), 6) AS probability FROM g LEFT JOIN n USING (family, node, state, residue)",
)
def profile_emissions(spark: SparkSession, d: str) -> DataFrame:
    return profiles.emissions(profiles.paths(aligned(spark, d)), LETTERS).select("family", "node", "state", "residue", "n", r6("probability"))


@C.add(
    "profile_transitions",
    f"WITH {_PATHS}, n AS (SELECT family, node, source, target, count(*) AS n FROM steps WHERE source IS NOT NULL GROUP BY ALL), "
    "g AS (SELECT family, size, node, source, target FROM nodes, (VALUES ('M'), ('I'), ('D')) AS s(source), (VALUES ('M'), ('I'), ('D')) AS t(target) WHERE (node > 0 OR source <> 'D') AND (node < size OR target <> 'D')) "
    "SELECT family, node::INTEGER AS node, source, target, coalesce(n, 0) AS n, round((coalesce(n, 0) + 1 / (CASE WHEN node < size THEN 3 ELSE 2 END)::DOUBLE) / (coalesce(sum(n) OVER (PARTITION BY family, node, source), 0) + 1), 6) AS probability "
    "FROM g LEFT JOIN n USING (family, node, source, target)",
)
def profile_transitions(spark: SparkSession, d: str) -> DataFrame:
    return profiles.transitions(profiles.paths(aligned(spark, d))).select("family", "node", "source", "target", "n", r6("probability"))


@C.add("profile_scores")
def profile_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each name with each family's profile; the tests hold the scores against an enumeration of all paths."""
    models = profiles.profiles(aligned(spark, d), alphabet=LETTERS)
    rows = table(spark, d, "part").select(F.regexp_replace("p_name", " ", "").alias("sequence"))
    return profiles.profile_scores(rows, models, alphabet=LETTERS).select("sequence", "family", r6("viterbi"), r6("forward"))


#: Gap costs of the matrix queries.
OPENED, EXTENDED = 3, 1


def hydropathy_matrix(spark: SparkSession) -> DataFrame:
    """A caller's matrix: 4 for a residue with itself, less the whole difference of two residues' hydropathies else."""
    scale = K.HYDROPATHY.items()
    return spark.createDataFrame([(a, b, float(4 if a == b else -int(abs(x - y)))) for a, x in scale for b, y in scale], "a string, b string, score double")


_SCALE = "(VALUES " + ", ".join(f"('{a}', {w}::DOUBLE)" for a, w in K.HYDROPATHY.items()) + ") AS scale(c, w)"


@C.add(
    "matrix_scores_short",
    # a row of the table at a time; a gap along the row is a running maximum
    f"WITH RECURSIVE {REFS}, k AS (SELECT c, w FROM {_SCALE}), m AS (SELECT x.c AS a, y.c AS b, CASE WHEN x.c = y.c THEN 4 ELSE -trunc(abs(x.w - y.w)) END::INTEGER AS s FROM k x, k y), n AS (SELECT DISTINCT p_name AS name FROM part), "
    "pos AS (SELECT ref_id, unnest(range(0, length(ref_sequence) + 1)) AS j, ref_sequence AS t FROM refs), "
    f"dp AS (SELECT name, ref_id, j, substr(t, j::INTEGER, 1) AS c, 0 AS i, CASE WHEN j = 0 THEN 0 ELSE -{OPENED} - {EXTENDED} * (j - 1) END AS h, -100000 AS down FROM n, pos UNION ALL "
    f"SELECT name, ref_id, j, c, i, greatest(g, coalesce(max(g + {EXTENDED} * j) OVER (PARTITION BY name, ref_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {OPENED} - {EXTENDED} * (j - 1), -100000)), down FROM "
    "(SELECT name, ref_id, j, d.c, i, greatest(nd, CASE WHEN j > 0 THEN before + coalesce(s, -1) ELSE -100000 END) AS g, nd AS down FROM "
    f"(SELECT name, ref_id, j, c, i + 1 AS i, upper(substr(name, i + 1, 1)) AS own, greatest(h - {OPENED}, down - {EXTENDED}) AS nd, lag(h) OVER (PARTITION BY name, ref_id ORDER BY j) AS before FROM dp WHERE i < length(name)) d LEFT JOIN m ON a = own AND b = d.c)) "
    "SELECT name, ref_id, h::DOUBLE AS matrix_score FROM dp JOIN refs USING (ref_id) WHERE i = length(name) AND j = length(ref_sequence)",
)
def matrix_scores_short(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part")
    found = matrices.matrix_with_all(names, references(spark, d), hydropathy_matrix(spark), "p_name", opened=OPENED, extended=EXTENDED)
    return found.select(F.col("sequence").alias("name"), "ref_id", "matrix_score")


@C.add("profile_composite_scores")
def profile_composite_scores(spark: SparkSession, d: str) -> DataFrame:
    """R3 from sequences on: three families' profiles, the matrix score, and the price as what a supervised model said; each part is held against brute force in the tests."""
    models = profiles.profiles(aligned(spark, d), alphabet=LETTERS)
    families = [r[0] for r in models.select("family").orderBy("family").limit(3).collect()]
    roles = dict(zip(("family_hmm", "site_hmm", "homologs_hmm"), families, strict=False))
    rows = table(spark, d, "part").select("p_partkey", F.regexp_replace("p_name", " ", "").alias("sequence"), (F.col("p_retailprice") / 1000).cast("double").alias("supervised"))
    raw = scores.profile_raw_scores(rows, models, references(spark, d), hydropathy_matrix(spark), roles, alphabet=LETTERS, opened=OPENED, extended=EXTENDED)
    return scores.profile_composite(raw).select("p_partkey", *(r6(c) for c in K.R3_SCALES), r6("unsupervised"), r6("composite"))
