"""Queries over tables: scaling, summaries, joins, pivots, kinetics and text preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kinetics
from ..operators import assays, joins, stats
from ..schema import number, numeric_columns
from ..session import shared_dir
from ..sources import tables
from .catalogue import REFS, SEQS, Catalogue, r6, references, sequences, table
from .scores import kinetics_activity

C = Catalogue()

# --- scaling and summaries -------------------------------------------------------------------------------------------


@C.add("zscore_cols", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS z_p_retailprice, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS z_p_size FROM part")
def zscore_cols(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.zscore(table(spark, d, "part"), ["p_retailprice", "p_size"])
    return rows.select("p_partkey", r6("z_p_retailprice"), r6("z_p_size"))


@C.add(
    "robust_z_cols",
    "WITH m AS (SELECT median(o_totalprice) AS m FROM orders), d AS (SELECT median(abs(o_totalprice - m)) AS d FROM orders, m) SELECT o_orderkey, round((o_totalprice - m) / (1.4826::DOUBLE * (d + 1e-8::DOUBLE)), 6) AS g_o_totalprice FROM orders, m, d",
)
def robust_z_cols(spark: SparkSession, d: str) -> DataFrame:
    return stats.robust_z(table(spark, d, "orders"), ["o_totalprice"]).select("o_orderkey", r6("g_o_totalprice"))


@C.add("cluster_center", "SELECT doc_id, round(n_chars - avg(n_chars) OVER (PARTITION BY source), 6) AS c_n_chars FROM documents")
def cluster_center(spark: SparkSession, d: str) -> DataFrame:
    return stats.centered(table(spark, d, "documents"), ["n_chars"], "source").select("doc_id", r6("c_n_chars"))


@C.add("impute_median", "WITH x AS (SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS v FROM events) SELECT event_id, round(coalesce(v, (SELECT median(v) FROM x)), 6) AS v FROM x")
def impute_median(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", None).otherwise(F.col("value")).alias("v"))
    return stats.impute_median(rows, ["v"]).select("event_id", r6("v"))


@C.add("clip_guard", "SELECT c_custkey, round(least(greatest(c_acctbal, 0), 5000), 6) AS clipped, round(greatest(c_acctbal, 0), 6) AS floored FROM customer")
def clip_guard(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("c_acctbal").cast("double")
    return table(spark, d, "customer").select("c_custkey", r6("clipped", stats.clipped(x, 0.0, 5000.0)), r6("floored", F.greatest(x, F.lit(0.0))))


_ODD = "CASE WHEN {k} % 4 = 0 THEN NULL WHEN {k} % 4 = 1 THEN {inf} WHEN {k} % 4 = 2 THEN {ninf} ELSE {k} END"


@C.add("nan_guard", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN -10.0::DOUBLE WHEN s_suppkey % 4 = 1 THEN 10.0::DOUBLE WHEN s_suppkey % 4 = 2 THEN -10.0::DOUBLE ELSE s_suppkey::DOUBLE END AS guarded FROM supplier")
def nan_guard(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    odd = F.when(k % 4 == 0, None).when(k % 4 == 1, F.lit(float("inf"))).when(k % 4 == 2, F.lit(float("-inf"))).otherwise(k.cast("double"))
    return table(spark, d, "supplier").select("s_suppkey", stats.finite_or(odd).alias("guarded"))


@C.add("length_mode", f"WITH {SEQS} SELECT length(sequence) AS mode FROM seqs GROUP BY ALL ORDER BY count(*) DESC, mode LIMIT 1")
def length_mode(spark: SparkSession, d: str) -> DataFrame:
    return stats.mode_smallest(sequences(spark, d).select(F.length("sequence").cast("long").alias("len")), "len")


@C.add("mode_first_seen", f"WITH {SEQS} SELECT source, len AS mode FROM (SELECT source, length(sequence) AS len, count(*) AS n, min(doc_id) AS o FROM seqs GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, o) = 1")
def mode_first_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences(spark, d).select("source", "doc_id", F.length("sequence").cast("long").alias("len"))
    return stats.mode_first_seen(rows, "len", "doc_id", ["source"])


@C.add("top5_lengths", f"WITH {SEQS} SELECT length(sequence) AS len, count(*) AS n FROM seqs GROUP BY ALL ORDER BY n DESC, len LIMIT 5")
def top5_lengths(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_frequencies(sequences(spark, d).select(F.length("sequence").cast("long").alias("len")), "len")


@C.add("quantiles", "SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS q, round(unnest(quantile_cont(value::DOUBLE, [0.1, 0.25, 0.5, 0.75, 0.9])), 6) AS value FROM events")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantiles(table(spark, d, "events"), "value").select("q", r6("value"))


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@C.add("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS r FROM lineitem" for a in _CORR for b in _CORR))
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlations(table(spark, d, "lineitem"), list(_CORR)).select("a", "b", r6("r"))


@C.add(
    "null_audit",
    "WITH x AS (SELECT d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT count(*) AS n_rows, count(*) FILTER (lang IS NULL) AS lang_nulls, bool_or(lang IS NULL) AS lang_any_null, count(DISTINCT lang) AS lang_distinct, "
    "count(*) FILTER (quality IS NULL) AS quality_nulls, bool_or(quality IS NULL) AS quality_any_null, count(DISTINCT quality) AS quality_distinct FROM x",
)
def null_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("lang", "quality")
    return stats.null_audit(rows, ["lang", "quality"])


@C.add("distinct_first", f"WITH {SEQS} SELECT sequence, doc_id, source FROM seqs QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY doc_id) = 1")
def distinct_first(spark: SparkSession, d: str) -> DataFrame:
    return stats.first_by_key(sequences(spark, d), ["sequence"], "doc_id")


@C.add("row_summary", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS n_orders, round(avg(l_quantity), 6) AS mean_quantity, round(stddev_samp(l_quantity), 6) AS sd_sample, round(stddev_pop(l_quantity), 6) AS sd_population, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem")
def row_summary(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").agg(
        F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_orders"), r6("mean_quantity", F.avg(q)), r6("sd_sample", F.stddev_samp(q)), r6("sd_population", F.stddev_pop(q)), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship")
    )


@C.add("average_ranks", "SELECT p_partkey, (rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0)::DOUBLE AS rank FROM part")
def average_ranks(spark: SparkSession, d: str) -> DataFrame:
    return stats.rank_average(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "rank").select("p_partkey", F.col("rank").cast("double").alias("rank"))


@C.add("finite_check", "SELECT o_orderkey, o_totalprice::DOUBLE AS o_totalprice FROM orders")
def finite_check(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    return stats.checked_finite(rows, ["o_totalprice"])


# --- assays ----------------------------------------------------------------------------------------------------------

_TYPES = ("click", "error", "purchase", "signup", "view")


def _wide(spark: SparkSession, d: str, only: tuple[str, ...] | None = None) -> DataFrame:
    return assays.pivot_first(table(spark, d, "events"), "user_id", "event_type", "value", "event_id", _TYPES, "v_", only)


_FIRST = "f AS (SELECT trim(user_id::VARCHAR) AS user_id, event_type, arg_min(value, event_id) FILTER (value IS NOT NULL) AS v FROM events GROUP BY ALL)"
_WIDE = f"{_FIRST}, w AS (SELECT user_id, {', '.join(f'''max(v) FILTER (event_type = '{t}') AS v_{t}''' for t in _TYPES)} FROM f GROUP BY user_id)"
_ALL = " AND ".join(f"v_{t} IS NOT NULL" for t in _TYPES)


@C.add("pair_intersect", "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def pair_intersect(spark: SparkSession, d: str) -> DataFrame:
    return assays.have_all(table(spark, d, "events"), "user_id", "event_type", ("click", "purchase"))


@C.add("pivot_first_dropna", f"WITH {_WIDE} SELECT user_id, {', '.join(f'round(v_{t}, 6) AS v_{t}' for t in _TYPES)} FROM w WHERE {_ALL}")
def pivot_first_dropna(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d).select("user_id", *(r6(f"v_{t}") for t in _TYPES))


@C.add("pivot_first_pair_only", f"WITH {_WIDE} SELECT user_id, round(v_click, 6) AS v_click, round(v_purchase, 6) AS v_purchase FROM w WHERE v_click IS NOT NULL AND v_purchase IS NOT NULL")
def pivot_first_pair_only(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, ("click", "purchase")).select("user_id", r6("v_click"), r6("v_purchase"))


@C.add("pair_label", f"WITH {_WIDE} SELECT user_id, (v_purchase > v_click)::INTEGER AS label FROM w WHERE {_ALL}")
def pair_label(spark: SparkSession, d: str) -> DataFrame:
    return assays.paired(_wide(spark, d), "v_click", "v_purchase").select("user_id", "label")


@C.add("pair_delta", f"WITH {_WIDE} SELECT user_id, round(v_purchase - v_click, 6) AS delta FROM w WHERE {_ALL}")
def pair_delta(spark: SparkSession, d: str) -> DataFrame:
    return assays.paired(_wide(spark, d), "v_click", "v_purchase").select("user_id", r6("delta"))


@C.add(
    "pair_summary",
    f"WITH {_WIDE}, p AS (SELECT (v_purchase > v_click)::INTEGER AS label, (v_purchase - v_click)::DOUBLE AS delta FROM w WHERE {_ALL}) SELECT count(*) AS n_pairs, round(avg(label), 6) AS rate, round(avg(delta), 6) AS mean_delta, round(stddev_samp(delta), 6) AS sd_delta, "
    + ", ".join(f"round(quantile_cont(delta, {q}), 6) AS q{int(100 * q)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))
    + " FROM p",
)
def pair_summary(spark: SparkSession, d: str) -> DataFrame:
    out = assays.summary(assays.paired(_wide(spark, d), "v_click", "v_purchase"))
    return out.select("n_pairs", *(r6(c) for c in out.columns if c != "n_pairs"))


# --- joins -----------------------------------------------------------------------------------------------------------


@C.add("join_left_cluster", "SELECT doc_id, lang, n AS cluster_size, quality FROM documents LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY ALL) USING (source) LEFT JOIN labels USING (doc_id)")
def join_left_cluster(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    sizes = docs.groupBy("source").agg(F.count("*").alias("cluster_size"))
    rows = joins.left_unique(docs.select("doc_id", "lang", "source"), sizes, ["source"])
    return joins.left_unique(rows, table(spark, d, "labels"), ["doc_id"]).select("doc_id", "lang", "cluster_size", "quality")


@C.add("join_inner_features", "SELECT l.doc_id, l.quality, d.n_chars FROM labels l JOIN documents d USING (doc_id)")
def join_inner_features(spark: SparkSession, d: str) -> DataFrame:
    return joins.inner_nonempty(table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "n_chars"), ["doc_id"]).select("doc_id", "quality", "n_chars")


@C.add("join_left_fill", "SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_left_fill(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").fillna(0).select("doc_id", "quality", "toxic")


@C.add("join_missing_keys", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_missing_keys(spark: SparkSession, d: str) -> DataFrame:
    return joins.missing_keys(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@C.add("join_semi_wt", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def join_semi_wt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi")


@C.add("join_anti_unmapped", "SELECT count(*) AS unmapped FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def join_anti_unmapped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti").agg(F.count("*").alias("unmapped"))


@C.add("join_lookup_last", "SELECT c_custkey, o_orderkey AS last_order FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) ON c_custkey = o_custkey")
def join_lookup_last(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("last_order"), F.col("o_orderkey").alias("o"))
    return joins.lookup_last(table(spark, d, "customer").select("c_custkey"), pairs, "c_custkey", "last_order", "o")


@C.add("fallback_exact_len", f"WITH {SEQS}, {REFS} SELECT doc_id, md5(coalesce((SELECT arg_min(ref_sequence, ref_id) FROM refs WHERE length(ref_sequence) = length(sequence)), (SELECT arg_min(ref_sequence, ref_id) FROM refs))) AS digest FROM seqs")
def fallback_exact_len(spark: SparkSession, d: str) -> DataFrame:
    return joins.exact_length_or_first(sequences(spark, d), references(spark, d)).select("doc_id", F.md5("ref_sequence").alias("digest"))


@C.add("fallback_nearest_len", f"WITH {SEQS}, {REFS} SELECT doc_id, ref_id FROM (SELECT doc_id, ref_id, row_number() OVER (PARTITION BY doc_id ORDER BY abs(length(ref_sequence) - length(sequence)), length(ref_sequence), ref_id) AS r FROM seqs, refs) WHERE r = 1")
def fallback_nearest_len(spark: SparkSession, d: str) -> DataFrame:
    return joins.nearest_length(sequences(spark, d), references(spark, d)).select("doc_id", "ref_id")


@C.add("fallback_self", f"WITH {SEQS} SELECT s.doc_id, md5(CASE WHEN l.quality = 1 THEN s.sequence || 'W' ELSE s.sequence END) AS digest FROM seqs s LEFT JOIN labels l USING (doc_id)")
def fallback_self(spark: SparkSession, d: str) -> DataFrame:
    good = sequences(spark, d).join(table(spark, d, "labels").filter("quality = 1"), "doc_id").select("doc_id", F.concat("sequence", F.lit("W")).alias("ref_sequence"))
    rows = sequences(spark, d).join(good, "doc_id", "left")
    return joins.or_itself(rows, "ref_sequence").select("doc_id", F.md5("ref_sequence").alias("digest"))


# --- kinetics --------------------------------------------------------------------------------------------------------

_KIN = "k AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS kcat, l_extendedprice::DOUBLE / 1000 AS km, l_discount::DOUBLE AS e FROM lineitem)"


def _kinetics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("kcat"), (F.col("l_extendedprice").cast("double") / 1000).alias("km"), F.col("l_discount").cast("double").alias("e"))


@C.add("mm_v0", f"WITH {_KIN} SELECT l_orderkey, l_linenumber, round(kcat * 60 * (1.0::DOUBLE / 30000) * 10 / (km + 10), 9) AS v0 FROM k")
def mm_v0(spark: SparkSession, d: str) -> DataFrame:
    v0 = kinetics.michaelis_menten(kinetics.per_minute(F.col("kcat")), F.col("km"), F.lit(10.0), kinetics.mgml_to_molar(F.lit(1.0), F.lit(30.0)))
    return _kinetics(spark, d).select("l_orderkey", "l_linenumber", F.round(v0, 9).alias("v0"))


@C.add("specific_activity", f"WITH {_KIN} SELECT l_orderkey, l_linenumber, round(kcat * 60 * 10 / (km + 10) / 30000, 9) AS specific_activity FROM k")
def specific_activity(spark: SparkSession, d: str) -> DataFrame:
    """The SQL is the closed identity: volume and enzyme mass cancel."""
    return kinetics_activity(_kinetics(spark, d), 10.0).select("l_orderkey", "l_linenumber", F.round("specific_activity", 9).alias("specific_activity"))


@C.add("kinetics_expression_as_e", f"WITH {_KIN} SELECT l_orderkey, l_linenumber, round(kcat * 60 * e / 30000 * 10 / (km + 10), 9) AS v0, CASE WHEN e > 0 THEN round(kcat * 60 * 10 / (km + 10) / 30000, 9) END AS specific_activity FROM k")
def kinetics_expression_as_e(spark: SparkSession, d: str) -> DataFrame:
    rows = kinetics_activity(_kinetics(spark, d), 10.0, expression="e")
    return rows.select("l_orderkey", "l_linenumber", F.round("v0", 9).alias("v0"), F.round("specific_activity", 9).alias("specific_activity"))


# --- preparation, sources and sinks ----------------------------------------------------------------------------------


@C.add("filter_blank", "SELECT event_id, user_id FROM events WHERE lower(event_type) <> 'view'")
def filter_blank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(F.lower("event_type") != "view").select("event_id", "user_id")


@C.add("try_cast_numeric", "SELECT doc_id, try_cast(trim(replace(source, 'src', '')) AS DOUBLE) AS number, try_cast(trim(source) AS DOUBLE) AS none FROM documents")
def try_cast_numeric(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", F.regexp_replace("source", "src", "").alias("tail"))
    return rows.select("doc_id", number("tail").alias("number"), number("source").alias("none"))


@C.add("select_numeric", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def select_numeric(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier")
    return rows.select(numeric_columns(rows))


@C.add("synthetic_ids", "SELECT doc_id, 'test_' || lpad((row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR, 5, '0') AS sample_id FROM documents")
def synthetic_ids(spark: SparkSession, d: str) -> DataFrame:
    return tables.synthetic_ids(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "sample_id")


@C.add("fasta_roundtrip", f"WITH {REFS} SELECT ref_id::VARCHAR AS id, ref_sequence AS sequence FROM refs")
def fasta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/seqrank/fasta-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    tables.write_fasta(references(spark, d), path, "ref_id", "ref_sequence")
    return tables.read_fasta(spark, path).select("id", "sequence")


@C.add("csv_unnamed_index", "SELECT s_suppkey::VARCHAR AS sample_id, s_acctbal::DOUBLE AS balance FROM supplier")
def csv_unnamed_index(spark: SparkSession, d: str) -> DataFrame:
    """Written with an unnamed first column and a column to be dropped, and read back."""
    path = f"{shared_dir(spark)}/seqrank/csv-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("Unnamed: 0"), F.col("s_acctbal").alias("balance"), F.lit(1).alias("Unnamed: 2"))
    tables.write_csv(rows, path)
    back = tables.named_index(tables.read_csv(spark, path))
    return tables.without_unnamed(back).select("sample_id", number("balance").alias("balance"))


@C.add("back_transform", "SELECT p_partkey, round(pow(10::DOUBLE, p_size / 25.0::DOUBLE), 6) AS km, round(p_retailprice / 2000 * 14, 6) AS phopt, round(p_retailprice / 2000 * 120, 6) AS topt, round(p_retailprice / 2000 * 100, 6) AS tm FROM part")
def back_transform(spark: SparkSession, d: str) -> DataFrame:
    """Predicted decimal logarithms as constants, and predictions in [0, 1] in the units of their tasks."""
    scaled = [r6(task.lower(), kinetics.by_task_maximum(F.col("p_retailprice") / 2000, task)) for task in kinetics.TASK_MAXIMUM]
    return table(spark, d, "part").select("p_partkey", r6("km", kinetics.from_log10(F.col("p_size") / 25.0)), *scaled)


@C.add("csv_list_cells", "SELECT vec_id::VARCHAR AS vec_id, len(embedding)::INTEGER AS dims, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings")
def csv_list_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells that hold lists, written as JSON and read back."""
    path = f"{shared_dir(spark)}/seqrank/lists-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    tables.write_csv(table(spark, d, "embeddings").select("vec_id", "embedding"), path)
    back = tables.read_csv(spark, path).withColumn("v", F.from_json("embedding", "array<double>"))
    return back.select("vec_id", F.size("v").alias("dims"), F.round(F.element_at("v", 1), 5).alias("first"))
