"""Queries over sequences: features, motifs, k-mers, strings and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import kmers, motifs, residues, strings
from ..operators import alignment
from ..operators.stats import mode_smallest
from ..session import ready
from .catalogue import CHARS, COUNTS, REFS, SEQS, Catalogue, charge_sql, fnv_sql, kmers_sql, r6, references, seq_sql, sequences, table, values, weighted

C = Catalogue()
_CNT = f"WITH {SEQS}, {CHARS}, {COUNTS}"
_LETTERS = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residues.with_counts(sequences(spark, sf_dir)).withColumn("len", F.length("sequence"))


def dipeptide_weights(spark: SparkSession) -> DataFrame:
    """A caller's table of weights: here a pair weighs a seventh of the difference of its residues' hydropathies."""
    return spark.createDataFrame([(a + b, abs(x - y) / 7) for a, x in K.HYDROPATHY.items() for b, y in K.HYDROPATHY.items()], "pair string, weight double")


@C.add("clean_sequence", f"SELECT doc_id, md5(regexp_replace(replace(replace(replace(replace(replace({_LETTERS}, 'B', 'N'), 'Z', 'Q'), 'U', 'C'), 'O', 'K'), 'J', 'L'), 'X', '', 'g')) AS digest, length(regexp_replace({_LETTERS}, 'X', '', 'g')) AS len FROM documents")
def clean_sequence(spark: SparkSession, d: str) -> DataFrame:
    clean = residues.clean_sequence(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, d, "documents").select("doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("long").alias("len"))


@C.add("residue_counts", f"{_CNT} SELECT doc_id, {', '.join(f'n{a}::BIGINT AS n{a}' for a in K.AMINO_ACIDS)} FROM cnt")
def residue_counts(spark: SparkSession, d: str) -> DataFrame:
    return counted(spark, d).select("doc_id", *(F.col(f"n.{a}").cast("long").alias(f"n{a}") for a in K.AMINO_ACIDS))


_SHARE = lambda x, name: f"round(CASE WHEN len > 0 THEN ({x}) / len::DOUBLE ELSE 0 END, 6) AS {name}"


@C.add(
    "composition24",
    f"{_CNT} SELECT doc_id, len, {', '.join(_SHARE(f'n{a}', f'frac_{a}') for a in K.AMINO_ACIDS)}, {_SHARE('nD + nE', 'frac_acidic')}, {_SHARE('nK + nR + nH', 'frac_basic')}, {_SHARE('nK + nR - nD - nE', 'net_charge_proxy')} FROM cnt",
)
def composition24(spark: SparkSession, d: str) -> DataFrame:
    out = residues.composition(F.col("n"), F.col("len"))
    return counted(spark, d).select("doc_id", F.col("len").cast("long").alias("len"), *(r6(k, v) for k, v in out.items() if k != "len"))


@C.add("pg_fraction", "SELECT doc_id, round(CASE WHEN length(text) > 0 THEN (length(text) - length(replace(replace(text, 'P', ''), 'G', ''))) / length(text)::DOUBLE ELSE 0 END, 6) AS pg_fraction FROM documents")
def pg_fraction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", r6("pg_fraction", residues.pro_gly_fraction(F.col("text"))))


@C.add("gravy", f"WITH {SEQS}, {CHARS}, w AS (SELECT doc_id, sum(w) / count(*) AS g FROM chars JOIN {values(K.HYDROPATHY)} USING (c) GROUP BY doc_id) SELECT doc_id, round(coalesce(g, 0), 6) AS gravy FROM seqs LEFT JOIN w USING (doc_id)")
def gravy(spark: SparkSession, d: str) -> DataFrame:
    return counted(spark, d).select("doc_id", r6("gravy", residues.hydropathy(F.col("n"), F.col("len"))))


@C.add("molecular_weight", f"WITH {SEQS}, {CHARS}, w AS (SELECT doc_id, sum(w) - (count(*) - 1) * {K.WATER}::DOUBLE AS g FROM chars JOIN {values(K.MASS)} USING (c) GROUP BY doc_id) SELECT doc_id, round(coalesce(g, 0), 4) AS molecular_weight FROM seqs LEFT JOIN w USING (doc_id)")
def molecular_weight(spark: SparkSession, d: str) -> DataFrame:
    return counted(spark, d).select("doc_id", F.round(residues.molecular_weight(F.col("n"), F.col("len")), 4).alias("molecular_weight"))


@C.add("net_charge_ph", f"{_CNT} SELECT doc_id, {', '.join(f'round({charge_sql(ph)}, 6) AS {name}' for ph, name in (('7.4', 'charge7'), ('9.0', 'charge9'), ('5.5', 'charge55')))} FROM cnt")
def net_charge_ph(spark: SparkSession, d: str) -> DataFrame:
    s, n = F.col("sequence"), F.col("n")
    return counted(spark, d).select("doc_id", *(r6(name, residues.net_charge(s, n, F.lit(ph))) for ph, name in ((7.4, "charge7"), (9.0, "charge9"), (5.5, "charge55"))))


_PI = (
    f"WITH RECURSIVE {SEQS}, {CHARS}, {COUNTS}, b AS (SELECT doc_id, 0 AS k, {K.PI_START}::DOUBLE AS ph, {K.PI_LOW}::DOUBLE AS lo, {K.PI_HIGH}::DOUBLE AS hi FROM cnt"
    " UNION ALL SELECT doc_id, k + 1, (nlo + nhi) / 2, nlo, nhi FROM (SELECT doc_id, k, CASE WHEN q > 0 THEN ph ELSE lo END AS nlo, CASE WHEN q > 0 THEN hi ELSE ph END AS nhi"
    f" FROM (SELECT b.*, {charge_sql('ph')} AS q FROM b JOIN cnt USING (doc_id) WHERE k < {K.PI_STEPS})))"
)


@C.add("isoelectric_point", f"{_PI} SELECT doc_id, round(ph, 6) AS iep FROM b WHERE k = {K.PI_STEPS}")
def isoelectric_point(spark: SparkSession, d: str) -> DataFrame:
    return counted(spark, d).select("doc_id", r6("iep", residues.isoelectric_point(F.col("sequence"), F.col("n"))))


@C.add(
    "instability_index",
    f"WITH {SEQS}, {CHARS}, p AS (SELECT doc_id, c AS a, lead(c) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM chars), k AS (SELECT c, w FROM {values(K.HYDROPATHY)}), "
    "t AS (SELECT doc_id, sum(abs(x.w - y.w) / 7) AS total FROM p JOIN k x ON p.a = x.c JOIN k y ON p.b = y.c GROUP BY doc_id) "
    "SELECT doc_id, round(CASE WHEN length(sequence) > 1 THEN 10.0::DOUBLE / length(sequence) * coalesce(total, 0) ELSE 0 END, 3) AS instability FROM seqs LEFT JOIN t USING (doc_id)",
)
def instability_index(spark: SparkSession, d: str) -> DataFrame:
    return residues.instability_index(sequences(spark, d), dipeptide_weights(spark), "doc_id").select("doc_id", F.round("instability", 3).alias("instability"))


@C.add(
    "all_params",
    f"{_PI} SELECT doc_id, round(ph, 6) AS iep, {', '.join(f'round({charge_sql(ph)}, 6) AS {name}' for ph, name in (('7.4', 'charge7'), ('9.0', 'charge9'), ('5.5', 'charge55')))}, "
    f"round(CASE WHEN len > 0 THEN {weighted(K.MASS)} - (len - 1) * {K.WATER}::DOUBLE ELSE 0 END, 4) AS molecular_weight, round(CASE WHEN len > 0 THEN {weighted(K.HYDROPATHY)} / len ELSE 0 END, 6) AS hydrophobicity, "
    f"round(CASE WHEN len > 0 THEN (nP + nG) / len::DOUBLE ELSE 0 END, 6) AS pg_fraction FROM b JOIN cnt USING (doc_id) WHERE k = {K.PI_STEPS}",
)
def all_params(spark: SparkSession, d: str) -> DataFrame:
    p = residues.all_params(F.col("sequence"), F.col("n"), F.col("len"))
    rows = counted(spark, d).select("doc_id", p.alias("p"))
    six = [r6(c, F.col(f"p.{c}")) for c in ("iep", "charge7", "charge9", "charge55", "hydrophobicity", "pg_fraction")]
    return rows.select("doc_id", *six, F.round("p.molecular_weight", 4).alias("molecular_weight"))


def _motif_sql(a: str, b: str, c: str) -> str:
    return (
        f"WITH {SEQS}, {CHARS}, x AS (SELECT doc_id, pos + 2 AS center, c AS a, lead(c, 2) OVER w AS b, lead(c, 4) OVER w AS e FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), "
        f"h AS (SELECT doc_id, center, abs(center - floor(length(sequence) * 0.4)) AS gap FROM x JOIN seqs USING (doc_id) WHERE a = '{a}' AND b = '{b}' AND e = '{c}' AND center >= 10 AND center <= length(sequence) - 11), "
        "f AS (SELECT doc_id, center FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY gap, center) = 1)"
    )


_MOTIF = "SELECT doc_id, (center IS NOT NULL)::INTEGER AS present, coalesce(center, -1)::INTEGER AS center FROM seqs LEFT JOIN f USING (doc_id)"


def _motif(spark: SparkSession, d: str, pattern: tuple[str, str, str]) -> DataFrame:
    ready(spark)
    rows = sequences(spark, d).select("doc_id", motifs.motif_center(F.col("sequence"), pattern).cast("int").alias("center"))
    return rows.select("doc_id", (F.col("center") >= 0).cast("int").alias("present"), "center")


@C.add("motif_gxsxg", f"{_motif_sql('G', 'S', 'G')} {_MOTIF}")
def motif_gxsxg(spark: SparkSession, d: str) -> DataFrame:
    return _motif(spark, d, ("G", "S", "G"))


@C.add("motif_param", f"{_motif_sql('E', 'T', 'E')} {_MOTIF}")
def motif_param(spark: SparkSession, d: str) -> DataFrame:
    return _motif(spark, d, ("E", "T", "E"))


_WINDOW_COUNTS = ", ".join(f"length(part) - length(replace(part, '{a}', '')) AS n{a}" for a in (*K.PK_POSITIVE, *K.PK_NEGATIVE))


@C.add(
    "local_window_charge",
    f"{_motif_sql('E', 'T', 'E')}, p AS (SELECT doc_id, CASE WHEN center IS NULL THEN '' ELSE substr(sequence, (greatest(center - 20, 0) + 1)::BIGINT, (least(center + 21, length(sequence)) - greatest(center - 20, 0))::BIGINT) END AS part FROM seqs LEFT JOIN f USING (doc_id)), "
    f"q AS (SELECT doc_id, part, {_WINDOW_COUNTS} FROM p) SELECT doc_id, round({charge_sql('5.5', 'part')}, 6) AS local_charge55, round({charge_sql('9.0', 'part')}, 6) AS local_charge90 FROM q",
)
def local_window_charge(spark: SparkSession, d: str) -> DataFrame:
    ready(spark)
    s = F.col("sequence")
    rows = sequences(spark, d).withColumn("center", motifs.motif_center(s, ("E", "T", "E"))).withColumn("part", motifs.window(s, F.col("center")))
    return rows.select("doc_id", *(r6(name, motifs.window_charge(F.col("part"), ph)) for ph, name in ((5.5, "local_charge55"), (9.0, "local_charge90"))))


@C.add(
    "max_hydrophobic_window",
    f"WITH {SEQS}, {CHARS}, m AS (SELECT doc_id, pos, sum((c IN ({', '.join(repr(x) for x in K.HYDROPHOBIC)}))::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS h, count(*) OVER (PARTITION BY doc_id) AS len FROM chars), "
    "b AS (SELECT doc_id, max(h) / least(9, any_value(len))::DOUBLE AS best FROM m WHERE pos >= 8 OR pos = len - 1 GROUP BY doc_id) SELECT doc_id, round(coalesce(best, 0), 6) AS agg_window FROM seqs LEFT JOIN b USING (doc_id)",
)
def max_hydrophobic_window(spark: SparkSession, d: str) -> DataFrame:
    ready(spark)
    return sequences(spark, d).select("doc_id", r6("agg_window", motifs.max_hydrophobic_window(F.col("sequence"))))


@C.add(
    "max_hydrophobic_run",
    f"WITH {SEQS}, {CHARS}, m AS (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM chars WHERE c IN ({', '.join(repr(x) for x in K.HYDROPHOBIC)})), "
    "r AS (SELECT doc_id, max(n) AS run FROM (SELECT doc_id, island, count(*) AS n FROM m GROUP BY ALL) GROUP BY doc_id) SELECT doc_id, coalesce(run, 0)::INTEGER AS agg_run FROM seqs LEFT JOIN r USING (doc_id)",
)
def max_hydrophobic_run(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).select("doc_id", motifs.max_hydrophobic_run(F.col("sequence")).cast("int").alias("agg_run"))


@C.add("fnv_kmer_hash", f"WITH {SEQS}, {CHARS}, w AS (SELECT c AS a, lead(c, 1) OVER w AS b, lead(c, 2) OVER w AS d FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT a || b || d AS kmer, {fnv_sql(['a', 'b', 'd'])} AS bucket, count(*) AS n FROM w WHERE d IS NOT NULL GROUP BY a, b, d")
def fnv_kmer_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences(spark, d).filter(F.length("sequence") >= 3)
    words = rows.select(F.explode(kmers.kmer_words(F.col("sequence"), 3)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    return words.select("kmer", kmers.fnv1a(F.col("kmer"), 3, K.KMER_DIM).alias("bucket"), "n")


_RAW = f"raw AS (SELECT doc_id, {_LETTERS} AS sequence FROM documents)"
_VECTOR = "SELECT doc_id, count(*) AS n_buckets, sum(c)::BIGINT AS n_kmers, round(max(c) / sqrt(sum(c * c)), 6) AS top_weight, sum(bucket * c)::BIGINT AS checksum FROM v GROUP BY doc_id"


def _vectors(spark: SparkSession, d: str, valid_only: bool) -> DataFrame:
    raw = table(spark, d, "documents").select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"))
    v = kmers.kmer_vectors(raw, ["doc_id"], valid_only=valid_only)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda t, c: t + c)
    checksum = total(F.zip_with("buckets", "counts", lambda b, c: b * c))
    return v.select("doc_id", F.size("buckets").cast("long").alias("n_buckets"), total("counts").alias("n_kmers"), r6("top_weight", F.array_max("weights")), checksum.alias("checksum"))


@C.add("kmer_vector_freq", f"WITH {_RAW}, {kmers_sql('raw', 'doc_id', 'v')} {_VECTOR}")
def kmer_vector_freq(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, False)


@C.add("kmer_vector_valid", f"WITH {_RAW}, {kmers_sql('raw', 'doc_id', 'v', True)} {_VECTOR}")
def kmer_vector_valid(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, True)


@C.add(
    "kmer_cosine",
    f"WITH {SEQS}, bench AS (SELECT item_id AS ref_id, {seq_sql()} AS sequence FROM benchmark), {kmers_sql('seqs', 'doc_id', 'v', True)}, {kmers_sql('bench', 'ref_id', 'u', True)}, "
    "vn AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM v GROUP BY doc_id), un AS (SELECT ref_id, sqrt(sum(c * c)) AS n FROM u GROUP BY ref_id), "
    "p AS (SELECT doc_id, ref_id, sum(v.c * u.c) AS dot FROM v JOIN u USING (bucket) GROUP BY ALL) "
    "SELECT doc_id, count(*) AS n_refs, round(max(dot / (vn.n * un.n)), 6) AS best_cosine, round(avg(dot / (vn.n * un.n)), 6) AS mean_cosine FROM p JOIN vn USING (doc_id) JOIN un USING (ref_id) GROUP BY doc_id",
)
def kmer_cosine(spark: SparkSession, d: str) -> DataFrame:
    pairs = kmers.cosine_to(sequences(spark, d), references(spark, d), "doc_id", "ref_id")
    return pairs.groupBy("doc_id").agg(F.count("*").alias("n_refs"), r6("best_cosine", F.max("cosine")), r6("mean_cosine", F.avg("cosine")))


@C.add(
    "t5_prepare",
    f"WITH raw AS (SELECT doc_id, {_LETTERS} AS s FROM documents), c AS (SELECT doc_id, CASE WHEN length(s) > 1000 THEN left(s, 500) || right(s, 500) ELSE s END AS s FROM raw) "
    "SELECT doc_id, length(s) AS kept, md5(array_to_string(string_split(regexp_replace(s, '[UZOB]', 'X', 'g'), ''), ' ')) AS digest FROM c WHERE length(s) > 0",
)
def t5_prepare(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "documents").select("doc_id", strings.both_ends(F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))).alias("s"))
    return raw.filter(F.length("s") > 0).select("doc_id", F.length("s").cast("long").alias("kept"), F.md5(strings.spaced(F.col("s"))).alias("digest"))


@C.add(
    "smiles_tokens",
    f"WITH {SEQS}, t AS (SELECT doc_id, string_split(sequence, '') AS l FROM seqs WHERE length(sequence) > 0), c AS (SELECT doc_id, CASE WHEN len(l) > 218 THEN l[1:109] || l[len(l) - 108:len(l)] ELSE l END AS l FROM t), "
    "i AS (SELECT doc_id, [3] || list_transform(l, lambda x: CASE WHEN instr('ACDEFGHIKLMNPQRSTV', x) > 0 THEN instr('ACDEFGHIKLMNPQRSTV', x)::INTEGER + 3 ELSE 1 END) || [2] AS l FROM c) "
    "SELECT doc_id, md5(array_to_string(list_resize(l, 220, 0), ',')) AS digest FROM i",
)
def smiles_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of a fixed length; the vocabulary lacks two letters, which become the unknown id."""
    vocabulary = F.create_map(*(F.lit(x) for i, a in enumerate(K.AMINO_ACIDS[:18]) for x in (a, i + 4)))
    rows = sequences(spark, d).filter(F.length("sequence") > 0)
    ids = strings.token_ids(F.split("sequence", ""), vocabulary)
    return rows.select("doc_id", F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")).alias("digest"))


@C.add("sha1_cache_key", f"WITH {SEQS} SELECT doc_id, sha1('model-v1|' || sequence) AS key FROM seqs")
def sha1_cache_key(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).select("doc_id", strings.cache_key(F.lit("model-v1"), F.col("sequence")).alias("key"))


@C.add(
    "length_penalties",
    f"WITH {SEQS}, l AS (SELECT doc_id, length(sequence) AS len FROM seqs), m AS (SELECT len AS mode FROM l GROUP BY len ORDER BY count(*) DESC, len LIMIT 1) "
    "SELECT doc_id, round(0 - abs(len - mode) / mode, 6) AS linear, round(0 - pow(abs(len - mode) / mode, 1.5), 6) AS powered FROM l, m",
)
def length_penalties(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences(spark, d).select("doc_id", F.length("sequence").alias("len"))
    rows = rows.crossJoin(F.broadcast(mode_smallest(rows, "len")))
    return rows.select("doc_id", r6("linear", strings.length_penalty(F.col("len"), F.col("mode"))), r6("powered", strings.length_penalty(F.col("len"), F.col("mode"), 1.5)))


@C.add(
    "hamming_rate",
    f"WITH {SEQS}, w AS (SELECT length(sequence) AS len, min(doc_id) AS wt FROM seqs WHERE length(sequence) > 0 GROUP BY ALL), p AS (SELECT s.doc_id, wt, s.sequence AS a, t.sequence AS b FROM seqs s JOIN w ON length(s.sequence) = w.len JOIN seqs t ON t.doc_id = w.wt) "
    "SELECT doc_id, wt, round(hamming(a, b) / length(b)::DOUBLE * 100, 6) AS mutation_rate FROM p",
)
def hamming_rate(spark: SparkSession, d: str) -> DataFrame:
    """Each sequence against the first of its length."""
    rows = sequences(spark, d).filter(F.length("sequence") > 0).withColumn("len", F.length("sequence"))
    first = rows.groupBy("len").agg(F.min_by("sequence", "doc_id").alias("b"), F.min("doc_id").alias("wt"))
    return rows.join(first, "len").select("doc_id", "wt", r6("mutation_rate", strings.hamming_rate(F.col("sequence"), F.col("b"))))


_LCS = (
    f"WITH RECURSIVE {REFS}, n AS (SELECT DISTINCT p_name AS name FROM part), pos AS (SELECT ref_id, ref_sequence AS t, unnest(range(1, length(ref_sequence) + 1)) AS j FROM refs), "
    "dp AS (SELECT name, ref_id, j, lower(substr(t, j, 1)) AS c, 0 AS i, 0 AS v FROM n, pos UNION ALL SELECT name, ref_id, j, c, i + 1, max(greatest(v, before + (c = lower(substr(name, i + 1, 1)))::INTEGER)) OVER (PARTITION BY name, ref_id ORDER BY j) "
    "FROM (SELECT *, coalesce(lag(v) OVER (PARTITION BY name, ref_id ORDER BY j), 0) AS before FROM dp WHERE i < length(name))), "
    "scored AS (SELECT name, ref_id, max(v) AS score, count(*) AS ref_length FROM dp WHERE i = length(name) GROUP BY name, ref_id)"
)


def _names(spark: SparkSession, d: str) -> DataFrame:
    return alignment.block_scores(table(spark, d, "part"), references(spark, d), "p_name").withColumnRenamed("sequence", "name")


@C.add("lcs_sql_short", f"{_LCS} SELECT name, ref_id, ref_length::INTEGER AS ref_length, score FROM scored")
def lcs_sql_short(spark: SparkSession, d: str) -> DataFrame:
    """Short strings, for which SQL has a recurrence: a row at a time, by running maxima."""
    return _names(spark, d).select("name", F.inline("found"))


@C.add("lcs_short_best", f"{_LCS} SELECT name, CASE WHEN max(score) > 0 THEN arg_min(ref_id, (-score, ref_id)) END AS best_ref_id, max(score) AS best_score FROM scored GROUP BY name")
def lcs_short_best(spark: SparkSession, d: str) -> DataFrame:
    return alignment.best_match(_names(spark, d).withColumnRenamed("name", "sequence")).withColumnRenamed("sequence", "name")


@C.add(
    "lcs_short_arrays",
    f"{_LCS} SELECT name, array_to_string(list(score ORDER BY ref_id), ',') AS scores, round(list_sum(list(round(100.0::DOUBLE * score / ref_length, 6))), 3) AS identities FROM scored GROUP BY name",
)
def lcs_short_arrays(spark: SparkSession, d: str) -> DataFrame:
    out = alignment.score_arrays(_names(spark, d).withColumnRenamed("name", "sequence"))
    total = F.aggregate("identity_percent", F.lit(0.0), lambda t, x: t + x)
    return out.select(F.col("sequence").alias("name"), F.array_join(F.transform("scores", lambda x: x.cast("string")), ",").alias("scores"), F.round(total, 3).alias("identities"))


@C.add("lcs_best_match")
def lcs_best_match(spark: SparkSession, d: str) -> DataFrame:
    """Whole sequences; SQL has no such recurrence at this length, so the tests hold it against a textbook table."""
    best = alignment.best_references(sequences(spark, d), references(spark, d))
    return sequences(spark, d).join(best, "sequence", "left").select("doc_id", "best_ref_id", "best_score")


@C.add("lcs_best_short", f"{_LCS} SELECT name, CASE WHEN max(score) > 0 THEN arg_min(ref_id, (-score, ref_id)) END AS best_ref_id, max(score) AS best_score FROM scored GROUP BY name")
def lcs_best_short(spark: SparkSession, d: str) -> DataFrame:
    """The search that leaves out what bounds rule out, on short strings."""
    best = alignment.best_references(table(spark, d, "part"), references(spark, d), "p_name")
    return best.select(F.col("sequence").alias("name"), "best_ref_id", "best_score")


@C.add(
    "lcs_mutation_short",
    f"{_LCS}, best AS (SELECT name, arg_min(ref_id, (-score, ref_id)) AS ref_id, max(score) AS score FROM scored GROUP BY name HAVING max(score) > 0), "
    "lines AS MATERIALIZED (SELECT name, ref_id, i, list(v ORDER BY j) AS l FROM dp JOIN best USING (name, ref_id) GROUP BY ALL), "
    "walk AS (SELECT name, ref_id, length(name) AS i, len(l) AS j, length(name) + 1 AS x, len(l) + 1 AS y, 0 AS wrong FROM lines WHERE i = length(name) UNION ALL "
    "SELECT w.name, w.ref_id, w.i - 1, CASE WHEN hit THEN spot - 1 ELSE j END, CASE WHEN hit THEN w.i ELSE x END, CASE WHEN hit THEN spot ELSE y END, wrong + CASE WHEN hit THEN least(x - w.i - 1, y - spot - 1) ELSE 0 END "
    "FROM (SELECT w.*, CASE WHEN j > 0 THEN own.l[j] > up.l[j] ELSE false END AS hit, list_position(own.l, own.l[greatest(j, 1)]) AS spot FROM walk w JOIN lines own ON own.name = w.name AND own.i = w.i "
    "JOIN lines up ON up.name = w.name AND up.i = w.i - 1) w), "
    "done AS (SELECT name, ref_id, wrong + least(x - 1, y - 1) AS wrong FROM walk WHERE i = 0) "
    "SELECT name, ref_id, score, m::INTEGER AS mismatches, (CASE WHEN length(name) = length(ref_sequence) THEN 0 ELSE length(name) + length(ref_sequence) - 2 * (score + m) END)::INTEGER AS gaps, round(m / length(ref_sequence)::DOUBLE * 100, 6) AS mutation_rate "
    "FROM (SELECT name, ref_id, score, ref_sequence, CASE WHEN length(name) = length(ref_sequence) THEN hamming(lower(name), lower(ref_sequence)) ELSE wrong END AS m FROM done JOIN best USING (name, ref_id) JOIN refs USING (ref_id))",
)
def lcs_mutation_short(spark: SparkSession, d: str) -> DataFrame:
    """Each name aligned with its best reference; the SQL walks back through its table."""
    refs = references(spark, d)
    best = alignment.best_references(table(spark, d, "part"), refs, "p_name").filter("best_ref_id is not null")
    pairs = best.join(refs, F.col("best_ref_id") == F.col("ref_id")).select(F.col("sequence").alias("name"), "ref_id", "ref_sequence")
    return alignment.mutations(pairs, "name").select("name", "ref_id", "score", "mismatches", "gaps", r6("mutation_rate"))


@C.add("lcs_mutation_rate")
def lcs_mutation_rate(spark: SparkSession, d: str) -> DataFrame:
    """Whole sequences aligned with their best references; the tests hold it against a textbook table."""
    rows, refs = sequences(spark, d), references(spark, d)
    best = alignment.best_references(rows, refs).filter("best_ref_id is not null")
    pairs = best.join(refs, F.col("best_ref_id") == F.col("ref_id")).select("sequence", "ref_id", "ref_sequence")
    found = alignment.mutations(pairs).drop("ref_sequence")
    return rows.select("doc_id", "sequence").join(found, "sequence").select("doc_id", "ref_id", "score", "mismatches", "gaps", r6("mutation_rate"))


@C.add("lcs_all_scores")
def lcs_all_scores(spark: SparkSession, d: str) -> DataFrame:
    """Rows meet their scores by a digest: whole texts are shuffled as they are made distinct and as they meet the references, and not again."""
    rows = sequences(spark, d)
    found = alignment.score_arrays(alignment.block_scores(rows, references(spark, d), by="key"), "key")
    return rows.select("doc_id", F.md5("sequence").alias("key")).join(found, "key", "left").select("doc_id", "scores", "identity_percent")


@C.add("reference_lengths", f"WITH {REFS} SELECT ref_id, length(ref_sequence) AS len FROM refs")
def reference_lengths(spark: SparkSession, d: str) -> DataFrame:
    return references(spark, d).select("ref_id", F.length("ref_sequence").cast("long").alias("len"))
