"""Queries over models: wild types, clusters, embeddings, scores, metrics, folds and fits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import kmers, residues, vectors
from ..operators import cache, clusters, embeddings, folds, metrics, minibatch, models, positions, trees, wild_types
from ..operators.stats import centered, robust_z, running_before
from ..session import shared_dir, stored
from . import fit_sql, scores
from .catalogue import CHARS, COUNTS, SEQS, Catalogue, charge_sql, kmers_sql, r6, sequences, table, values, weighted
from .sequence_queries import _PI, _motif_sql, dipeptide_weights

C = Catalogue()

# --- wild types and clusters -----------------------------------------------------------------------------------------


def wild_type_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sequences with their source as the cluster, and as wild types the documents labelled good."""
    rows = sequences(spark, d).select("doc_id", F.col("source").alias("cluster_id"), "sequence")
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    wild = rows.join(good, "doc_id", "left_semi").select(F.col("doc_id").alias("wt_id"), F.col("sequence").alias("wt_sequence"))
    return rows, wild


_CANDIDATES = (
    f"{SEQS}, wt AS (SELECT sequence, max(doc_id) AS wt_id FROM seqs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY sequence), "
    "cand AS (SELECT DISTINCT source AS cluster_id, wt_id, sequence FROM seqs JOIN wt USING (sequence))"
)
_CENTRAL = (
    f"{_CANDIDATES}, keyed AS (SELECT cluster_id || '/' || wt_id AS k, sequence FROM cand), {kmers_sql('keyed', 'k', 'v', True)}, "
    "vn AS (SELECT k, sqrt(sum(c * c)) AS n FROM v GROUP BY k), w AS (SELECT v.k, split_part(v.k, '/', 1) AS cluster_id, bucket, c / n AS w FROM v JOIN vn USING (k)), "
    "dots AS (SELECT a.k, sum(a.w * b.w) AS total FROM w a JOIN w b ON a.cluster_id = b.cluster_id AND a.bucket = b.bucket AND a.k <> b.k GROUP BY a.k), "
    "sizes AS (SELECT cluster_id, count(*) AS m FROM (SELECT DISTINCT cluster_id, k FROM w) GROUP BY ALL)"
)


@C.add("wt_candidates", f"WITH {_CANDIDATES} SELECT cluster_id, wt_id, md5(sequence) AS digest FROM cand")
def wt_candidates(spark: SparkSession, d: str) -> DataFrame:
    return wild_types.candidates(*wild_type_rows(spark, d)).select("cluster_id", "wt_id", F.md5("wt_sequence").alias("digest"))


@C.add(
    "wt_centrality",
    f"WITH {_CENTRAL} SELECT split_part(k, '/', 2)::BIGINT AS wt_id, cluster_id, round(CASE WHEN m > 1 THEN coalesce(total, 0) / (m - 1) ELSE 1 END, 6) AS centrality FROM (SELECT DISTINCT k, cluster_id FROM w) LEFT JOIN dots USING (k) JOIN sizes USING (cluster_id)",
)
def wt_centrality(spark: SparkSession, d: str) -> DataFrame:
    """By summed vectors; the SQL makes all pairs."""
    found = wild_types.candidates(*wild_type_rows(spark, d))
    v = kmers.unit_rows(stored(found, "candidates"), ["cluster_id", "wt_id"], "wt_sequence", valid_only=True)
    return kmers.centrality(stored(v, "vectors"), "wt_id", "cluster_id").select("wt_id", "cluster_id", r6("centrality"))


_CHOSEN = (
    f"WITH {_CANDIDATES}, sized AS (SELECT *, length(sequence) AS len FROM cand), modal AS (SELECT cluster_id, len FROM (SELECT cluster_id, len, count(*) AS n, min(wt_id) AS o FROM sized GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, o) = 1), "
    f"kept AS (SELECT cluster_id, wt_id, sequence FROM sized JOIN modal USING (cluster_id, len)), keyed AS (SELECT cluster_id || '/' || wt_id AS k, sequence FROM kept), {kmers_sql('keyed', 'k', 'v', True)}, "
    "vn AS (SELECT k, sqrt(sum(c * c)) AS n FROM v GROUP BY k), w AS (SELECT v.k, split_part(v.k, '/', 1) AS cluster_id, bucket, c / n AS w FROM v JOIN vn USING (k)), "
    "dots AS (SELECT a.k, sum(a.w * b.w) AS total FROM w a JOIN w b ON a.cluster_id = b.cluster_id AND a.bucket = b.bucket AND a.k <> b.k GROUP BY a.k), "
    "sizes AS (SELECT cluster_id, count(*) AS m FROM kept GROUP BY ALL), "
    "scored AS (SELECT cluster_id, wt_id, sequence, CASE WHEN m = 1 THEN 1.0::DOUBLE ELSE coalesce(total, 0) / (m - 1) END AS centrality FROM kept LEFT JOIN dots ON dots.k = cluster_id || '/' || wt_id JOIN sizes USING (cluster_id)), "
    "best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY round(centrality, 9) DESC, wt_id) = 1), "
    "chosen AS (SELECT cluster_id, coalesce(wt_id, -1) AS wt_id, coalesce(sequence, '') AS wt_sequence, coalesce(centrality, 0) AS wt_centrality FROM (SELECT DISTINCT source AS cluster_id FROM seqs) LEFT JOIN best USING (cluster_id))"
)


def _chosen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, wild = wild_type_rows(spark, d)
    return rows, wild_types.choose(wild_types.candidates(rows, wild), rows)


@C.add("cluster_to_wt", f"{_CHOSEN} SELECT cluster_id, wt_id, md5(wt_sequence) AS digest, round(wt_centrality, 6) AS wt_centrality FROM chosen")
def cluster_to_wt(spark: SparkSession, d: str) -> DataFrame:
    return _chosen(spark, d)[1].select("cluster_id", "wt_id", F.md5("wt_sequence").alias("digest"), r6("wt_centrality"))


@C.add("sequence_to_wt", f"{_CHOSEN} SELECT doc_id, source AS cluster_id, wt_id FROM seqs JOIN chosen ON source = cluster_id")
def sequence_to_wt(spark: SparkSession, d: str) -> DataFrame:
    return wild_types.sequence_map(*_chosen(spark, d)).select("doc_id", "cluster_id", "wt_id")


_K = "CASE WHEN n < 50 THEN 2 WHEN n < 200 THEN 3 WHEN n < 600 THEN 5 WHEN n < 1500 THEN 8 ELSE 12 END"


@C.add("cluster_policy_small", f"WITH {SEQS}, g AS (SELECT length(sequence) AS seq_len, count(*) AS n FROM seqs WHERE length(sequence) > 0 GROUP BY ALL) SELECT seq_len, n, n >= 100 AS clustered, CASE WHEN n >= 100 THEN least(n, {_K}) ELSE n END AS k FROM g")
def cluster_policy_small(spark: SparkSession, d: str) -> DataFrame:
    return clusters.group_policy(sequences(spark, d)).select(F.col("seq_len").cast("long").alias("seq_len"), "n", "clustered", F.col("k").cast("long").alias("k"))


@C.add("choose_k", f"SELECT l_orderkey, n, least(n, {_K})::BIGINT AS k FROM (SELECT l_orderkey, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL)")
def choose_k(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("n"))
    return rows.select("l_orderkey", "n", clusters.choose_k(F.col("n")).alias("k"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Words of the documents as sequences, each once: many of each length, so that length groups are clustered. What is no amino acid is dropped of different words alone."""
    words = table(spark, d, "documents").select(F.explode(F.split(F.upper(F.regexp_replace("text", "[^A-Za-z]+", " ")), " +")).alias("w")).distinct()
    return words.select(F.regexp_replace("w", f"[^{K.AMINO_ACIDS}]", "").alias("sequence")).filter(F.length("sequence") >= 3)


def _kmeans_sql(rounds: int = 4) -> str:
    """The same rounds as joins: seeds by MD5, nearest centres to nine digits, the lowest at a tie."""
    letters = f"regexp_replace(w, '[^{K.AMINO_ACIDS}]', '', 'g')"
    out = [
        f"lines AS (SELECT {letters} AS sequence FROM (SELECT unnest(string_split_regex(upper(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' +')) AS w FROM documents))",
        "d AS (SELECT DISTINCT sequence, length(sequence) AS seq_len FROM lines WHERE length(sequence) >= 3)",
        f"g AS (SELECT seq_len, n >= {K.SMALL_GROUP} AS clustered, CASE WHEN n >= {K.SMALL_GROUP} THEN least(n, {_K}) ELSE n END AS k FROM (SELECT seq_len, count(*) AS n FROM d GROUP BY ALL))",
        "small AS (SELECT sequence, seq_len, row_number() OVER (PARTITION BY seq_len ORDER BY sequence) AS c, 1.0::DOUBLE AS similarity FROM d JOIN g USING (seq_len) WHERE NOT clustered)",
        "big AS (SELECT sequence, seq_len, k FROM d JOIN g USING (seq_len) WHERE clustered)",
        kmers_sql("(SELECT sequence AS key, sequence FROM big)", "key", "v"),
        "x AS MATERIALIZED (SELECT key, length(key) AS seq_len, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY key)) AS w FROM v)",
        "c0 AS MATERIALIZED (SELECT x.seq_len, s.c, bucket, w AS u FROM x JOIN (SELECT sequence, row_number() OVER (PARTITION BY seq_len ORDER BY md5(sequence), sequence) AS c, k FROM big) s ON s.sequence = x.key WHERE s.c <= s.k)",
    ]
    for r in range(rounds + 1):
        dots = f"SELECT x.key, x.seq_len, c, sum(w * u) AS similarity FROM x JOIN c{r} ON x.seq_len = c{r}.seq_len AND x.bucket = c{r}.bucket GROUP BY ALL"
        out.append(f"a{r} AS MATERIALIZED (SELECT * FROM ({dots}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(similarity, 9) DESC, c) = 1)")
        if r < rounds:
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT seq_len, c, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY seq_len, c)) AS u FROM (SELECT x.seq_len, a{r}.c, bucket, sum(w) AS w FROM x JOIN a{r} USING (key) GROUP BY ALL))")
    out += [
        f"every AS (SELECT sequence, seq_len, c, similarity FROM small UNION ALL SELECT key, seq_len, c, similarity FROM a{rounds} UNION ALL SELECT sequence, seq_len, 0, 1.0 FROM big WHERE sequence NOT IN (SELECT key FROM a{rounds}))",
        "clustered AS (SELECT sequence, seq_len, dense_rank() OVER (ORDER BY seq_len, c) - 1 AS cluster_id, similarity FROM every)",
    ]
    return "WITH " + ", ".join(out)


@C.add("kmeans_groups", f"{_kmeans_sql()} SELECT sequence, seq_len, cluster_id, round(similarity, 6) AS similarity FROM clustered")
def kmeans_groups(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clusters(_lines(spark, d)).select("sequence", F.col("seq_len").cast("long").alias("seq_len"), "cluster_id", r6("similarity"))


@C.add(
    "cluster_reps",
    f"{_kmeans_sql()} SELECT cluster_id, seq_len, count(*) AS cluster_size, arg_min(sequence, (-round(similarity, 9), sequence)) AS rep_sequence, round(avg(similarity), 6) AS avg_similarity FROM clustered GROUP BY cluster_id, seq_len",
)
def cluster_reps(spark: SparkSession, d: str) -> DataFrame:
    out = clusters.representatives(clusters.clusters(_lines(spark, d)))
    return out.select("cluster_id", F.col("seq_len").cast("long").alias("seq_len"), "cluster_size", "rep_sequence", r6("avg_similarity"))


def _minibatch_sql(rounds: int, batch: int) -> str:
    """Seeds by MD5; each round a batch of every length, each centre moved by its share of rows; then all rows to the nearest centre."""
    head = _kmeans_sql(0)
    out = [head[: head.index(", a0 AS MATERIALIZED")].removeprefix("WITH ")]
    out.append(f"slots AS MATERIALIZED (SELECT key, seq_len, ('0x' || substr(md5(key), 1, 8))::BIGINT % s AS slot, s FROM (SELECT DISTINCT key, x.seq_len, (n + {batch - 1}) // {batch} AS s FROM x JOIN (SELECT seq_len, count(*) AS n FROM d GROUP BY ALL) AS z ON x.seq_len = z.seq_len))")
    out.append("h0 AS MATERIALIZED (SELECT DISTINCT seq_len, c, 0::BIGINT AS had FROM c0)")

    def nearest(r: int, rows: str) -> str:
        dots = f"SELECT x.key, c, sum(w * u) AS dot FROM x JOIN {rows} USING (key) JOIN c{r} ON x.seq_len = c{r}.seq_len AND x.bucket = c{r}.bucket GROUP BY ALL"
        every = f"SELECT key, b.seq_len, c, norm, 1 + norm - 2 * coalesce(dot, 0) AS e FROM {rows} b JOIN (SELECT seq_len, c, sum(u * u) AS norm FROM c{r} GROUP BY ALL) AS n ON n.seq_len = b.seq_len LEFT JOIN ({dots}) USING (key, c)"
        return f"(SELECT * FROM ({every}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(e, 9), c) = 1)"

    for r in range(rounds):
        out.append(f"b{r} AS MATERIALIZED (SELECT key, seq_len FROM slots WHERE slot = {r} % s)")
        out.append(f"f{r} AS MATERIALIZED {nearest(r, f'b{r}')}")
        out.append(f"h{r + 1} AS MATERIALIZED (SELECT seq_len, c, had + coalesce(got, 0) AS had, coalesce(got, 0) AS m FROM h{r} LEFT JOIN (SELECT seq_len, c, count(*) AS got FROM f{r} GROUP BY ALL) USING (seq_len, c))")
        kept = f"SELECT seq_len, c, bucket, CASE WHEN m > 0 THEN u * (had - m) / had ELSE u END AS u FROM c{r} JOIN h{r + 1} USING (seq_len, c)"
        new = f"SELECT x.seq_len, f{r}.c, bucket, sum(w) / any_value(had) AS u FROM x JOIN f{r} USING (key) JOIN h{r + 1} ON h{r + 1}.seq_len = x.seq_len AND h{r + 1}.c = f{r}.c GROUP BY ALL"
        out.append(f"c{r + 1} AS MATERIALIZED (SELECT seq_len, c, bucket, sum(u) AS u FROM ({kept} UNION ALL {new}) GROUP BY ALL HAVING sum(u) <> 0)")
    out += [
        f"last AS MATERIALIZED {nearest(rounds, 'slots')}",
        "every AS (SELECT sequence, seq_len, c, similarity FROM small UNION ALL SELECT key, seq_len, c, (1 + norm - greatest(e, 0)) / 2 / sqrt(norm) FROM last UNION ALL SELECT sequence, seq_len, 0, 1.0 FROM big WHERE sequence NOT IN (SELECT key FROM last))",
        "clustered AS (SELECT sequence, seq_len, dense_rank() OVER (ORDER BY seq_len, c) - 1 AS cluster_id, similarity FROM every)",
    ]
    return "WITH " + ", ".join(out)


@C.add("minibatch_groups", f"{_minibatch_sql(6, 100)} SELECT sequence, seq_len, cluster_id, round(similarity, 6) AS similarity FROM clustered")
def minibatch_groups(spark: SparkSession, d: str) -> DataFrame:
    """Mini-batches with learning rates, as many rounds as the SQL makes, from the same seeds."""
    found = minibatch.minibatch_clusters(_lines(spark, d), batch=100, rounds=6, patience=None, seeding="hashed")
    return found.select("sequence", F.col("seq_len").cast("long").alias("seq_len"), "cluster_id", r6("similarity"))


@C.add("minibatch_reps")
def minibatch_reps(spark: SparkSession, d: str) -> DataFrame:
    """With oversampled seeds, until the inertia stands still: the tests hold its invariants, and its inertia against the plain rounds'."""
    out = clusters.representatives(minibatch.minibatch_clusters(_lines(spark, d)))
    return out.select("cluster_id", F.col("seq_len").cast("long").alias("seq_len"), "cluster_size", "rep_sequence", r6("avg_similarity"))


# --- embeddings ------------------------------------------------------------------------------------------------------

_DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"
_COS = f"{_DOT.format('a.embedding', 'b.embedding')} / ((sqrt({_DOT.format('a.embedding', 'a.embedding')}) + 1e-8::DOUBLE) * (sqrt({_DOT.format('b.embedding', 'b.embedding')}) + 1e-8::DOUBLE))"


@C.add(
    "embed_pool_mean",
    "WITH x AS (SELECT label, unnest(embedding) AS e, unnest(range(len(embedding))) AS i FROM embeddings) SELECT label, round(avg(m), 6) AS mean_of_means, round(max(m), 6) AS top, count(*) AS dims FROM (SELECT label, i, avg(e::DOUBLE) AS m FROM x GROUP BY ALL) GROUP BY label",
)
def embed_pool_mean(spark: SparkSession, d: str) -> DataFrame:
    pooled = vectors.mean_pool(table(spark, d, "embeddings"), ["label"], "embedding")
    mean = F.aggregate("pooled", F.lit(0.0), lambda t, x: t + x) / F.size("pooled")
    return pooled.select("label", r6("mean_of_means", mean), r6("top", F.array_max("pooled")), F.size("pooled").cast("long").alias("dims"))


def _against_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("wt"))
    return rows.join(first, "label").withColumn("cosine", vectors.cosine_safe(F.col("embedding"), F.col("wt")))


_PAIR = "FROM embeddings a JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) b USING (label)"


@C.add("embed_cosine_wt", f"SELECT vec_id, round({_COS}, 6) AS cosine {_PAIR}")
def embed_cosine_wt(spark: SparkSession, d: str) -> DataFrame:
    return _against_first(spark, d).select("vec_id", r6("cosine"))


@C.add("delta_emb", f"SELECT vec_id, round(1 - {_COS}, 6) AS delta_emb {_PAIR}")
def delta_emb(spark: SparkSession, d: str) -> DataFrame:
    return _against_first(spark, d).select("vec_id", r6("delta_emb", embeddings.delta(F.col("cosine"))))


@C.add("delta_inverse", f"SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN 0.5 ELSE 1 - {_COS} END, 6) AS delta_emb {_PAIR}")
def delta_inverse(spark: SparkSession, d: str) -> DataFrame:
    """From the cosine where the delta isn't given."""
    given = F.when(F.col("vec_id") % 3 == 0, F.lit(0.5))
    rows = _against_first(spark, d).withColumnRenamed("cosine", "wt_cosine_sim").withColumn("delta_emb", given)
    return embeddings.delta_given(rows).select("vec_id", r6("delta_emb"))


@C.add(
    "token_log_likelihood",
    "WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(8)) AS pos FROM embeddings), q AS (SELECT vec_id, (vec_id + 3 * pos) % 8 AS token, e[8 * pos + 1 : 8 * pos + 8] AS s FROM p) "
    "SELECT vec_id, round(avg(s[token + 1] - ln(list_sum(list_transform(s, lambda x: exp(x))))), 6) AS ll FROM q WHERE token NOT IN (0, 2) GROUP BY vec_id",
)
def token_log_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding read as a model's scores of 8 tokens at 8 positions, two of the tokens being special."""
    logits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, 8))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: ((F.col("vec_id") + 3 * k) % 8).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", r6("ll", vectors.token_log_likelihood(logits, tokens, (0, 2))))


@C.add("embed_cache_fill", f"WITH {SEQS} SELECT DISTINCT sha1('model-v1|' || sequence) AS key, length(sequence)::DOUBLE + 1 AS first FROM seqs")
def embed_cache_fill(spark: SparkSession, d: str) -> DataFrame:
    """A cache with some vectors, some of them unusable, is completed by a provider and read."""
    rows, path = sequences(spark, d), f"{shared_dir(spark)}/seqrank/cache-{uuid.uuid4().hex}"
    vector = F.array(F.length("sequence").cast("double") + 1, F.lit(0.5))
    known = rows.join(table(spark, d, "labels"), "doc_id").select("sequence", "quality").dropDuplicates(["sequence"])
    broken = F.when(F.col("quality") == 0, F.array(F.lit(float("nan")))).otherwise(vector)
    known.select(F.sha1(F.concat_ws("|", F.lit("model-v1"), "sequence")).alias("key"), broken.alias("embedding")).write.parquet(path)
    out = cache.filled(spark, rows, path, "model-v1", lambda missing: missing.select("key", vector.alias("embedding")), chunks=2)
    return out.select("key", F.element_at("embedding", 1).alias("first"))


@C.add("embed_cache_miss", f"WITH {SEQS} SELECT DISTINCT sha1('model-v1|' || sequence) AS key FROM seqs WHERE sequence NOT IN (SELECT sequence FROM seqs JOIN labels USING (doc_id))")
def embed_cache_miss(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences(spark, d)
    known = rows.join(table(spark, d, "labels"), "doc_id", "left_semi").select(F.sha1(F.concat_ws("|", F.lit("model-v1"), "sequence")).alias("key"))
    return embeddings.cache_missing(rows, known, "model-v1").select("key")


# --- tree ensembles, tables side by side -----------------------------------------------------------------------------

TREES, DEPTH = 70, 4
_SPLIT_BY = ("l_quantity", "l_extendedprice", "l_discount")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """A caller's ensemble: complete trees whose thresholds are shares of the features' means."""
    means = table(spark, d, "lineitem").agg(*(F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in _SPLIT_BY))  # one row
    rows = spark.range(TREES).select(F.col("id").alias("tree"), F.explode(F.sequence(F.lit(0), F.lit(2 ** (DEPTH + 1) - 2))).alias("node"))
    inner = F.col("node") < 2**DEPTH - 1
    feature = F.when(inner, (F.col("tree") + F.col("node")) % 3).cast("int")
    share = (F.col("node") * 7 + F.col("tree") * 3) % 11 / F.lit(5.0)
    mean = F.element_at(F.array(*_SPLIT_BY), feature + 1)
    rows = rows.join(F.broadcast(means)).select("tree", "node", feature.alias("feature"), (mean * share).alias("threshold"), F.when(inner, 2 * F.col("node") + 1).alias("left"), F.when(inner, 2 * F.col("node") + 2).alias("right"), ((F.col("node") + F.col("tree")) % 2 == 0).alias("missing_left"), F.when(~inner, ((F.col("node") * 13 + F.col("tree") * 5) % 17).cast("double")).alias("value"))
    return rows


@C.add(
    "tree_ensemble",
    "WITH RECURSIVE m AS (SELECT " + ", ".join(f"round(avg({c}::DOUBLE), 6) AS m{k}" for k, c in enumerate(_SPLIT_BY)) + " FROM lineitem), "
    "x AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN (l_orderkey + l_linenumber) % 7 = {k} THEN NULL ELSE {c}::DOUBLE END AS x{k}" for k, c in enumerate(_SPLIT_BY)) + " FROM lineitem), "
    "dx AS (SELECT DISTINCT x0, x1, x2 FROM x), "
    f"walk AS (SELECT x0, x1, x2, tree, 0::BIGINT AS node FROM dx, range({TREES}) AS t(tree) UNION ALL "
    "SELECT x0, x1, x2, tree, 2 * node + CASE WHEN CASE WHEN v IS NULL THEN (node + tree) % 2 = 0 ELSE v <= mean * ((node * 7 + tree * 3) % 11 / 5.0::DOUBLE) END THEN 1 ELSE 2 END FROM "
    f"(SELECT walk.*, CASE (tree + node) % 3 WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END AS v, CASE (tree + node) % 3 WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END AS mean FROM walk, m WHERE node < {2**DEPTH - 1})), "
    f"p AS (SELECT x0, x1, x2, round(sum((node * 13 + tree * 5) % 17) / {TREES}::DOUBLE, 6) AS prediction FROM walk WHERE node >= {2**DEPTH - 1} GROUP BY ALL) "
    "SELECT l_orderkey, l_linenumber, prediction FROM x JOIN p ON x.x0 IS NOT DISTINCT FROM p.x0 AND x.x1 IS NOT DISTINCT FROM p.x1 AND x.x2 IS NOT DISTINCT FROM p.x2",
)
def tree_ensemble(spark: SparkSession, d: str) -> DataFrame:
    gone = (F.col("l_orderkey") + F.col("l_linenumber")) % 7
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.when(gone != k, F.col(c).cast("double")).alias(c) for k, c in enumerate(_SPLIT_BY)))
    return trees.ensemble_predictions(rows, list(_SPLIT_BY), _nodes(spark, d)).select("l_orderkey", "l_linenumber", r6("prediction"))


@C.add("side_by_side", "SELECT doc_id, source, page_id, length(url) AS url_length FROM documents POSITIONAL JOIN pages")
def side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """Two tables without a common key, row by row."""
    found = positions.side_by_side(table(spark, d, "documents"), table(spark, d, "pages"))
    return found.select("doc_id", "source", "page_id", F.length("url").cast("long").alias("url_length"))


# --- scores ----------------------------------------------------------------------------------------------------------


def _r1_rows(spark: SparkSession, d: str, delta: bool) -> DataFrame:
    """A model's likelihoods are inputs; here they are made from the documents' lengths, alike on both sides."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    rows = sequences(spark, d).withColumnRenamed("source", "cluster_id").join(docs, "doc_id").filter(F.length("sequence") > 0)
    rows = rows.withColumns({"ll": -(F.col("n_chars") % 97) / 10.0, "rep_ll": -(F.col("n_chars") % 31) / 10.0})
    return rows.withColumn("delta_emb", (F.col("n_chars") % 53) / 100.0) if delta else rows


def _r1_sql(delta: bool) -> str:
    cols = ["delta_ll", "ll", "hydropathy", "pg", "length", "local55", "local90", "agg_window", "agg_run", *(["delta_emb"] if delta else [])]
    hyd = ", ".join(repr(x) for x in K.HYDROPHOBIC)
    window = ", ".join(f"length(part) - length(replace(part, '{a}', '')) AS n{a}" for a in (*K.PK_POSITIVE, *K.PK_NEGATIVE))
    robust = lambda x: f"({x} - m_{x}) / (1.4826::DOUBLE * (d_{x} + 1e-8::DOUBLE))"
    centred = [f"k_{c}" for c in cols] + ["ll"] + (["delta_emb"] if delta else [])
    core = " + ".join(f"{w} * {robust('k_' + c[2:]) if c[:2] == 'c_' else robust(c[2:])}" for c, w in K.R1_CORE.items()) + f" + {K.R1_CORE_LOCAL55} * abs({robust('k_local55')})"
    term = f"(-0.9 * {robust('k_delta_emb')} - 0.2 * {robust('delta_emb')})" if delta else "0"
    expr = " + ".join(f"{w} * {robust('k_' + c[2:]) if c[:2] == 'c_' else robust(c[2:])}" for c, w in K.R1_EXPRESSION.items())
    return (
        f"{_motif_sql('G', 'S', 'G')}, {COUNTS}, "
        f"hw AS (SELECT doc_id, max(h) / least(9, any_value(len))::DOUBLE AS agg_window FROM (SELECT doc_id, pos, sum((c IN ({hyd}))::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS h, count(*) OVER (PARTITION BY doc_id) AS len FROM chars) WHERE pos >= 8 OR pos = len - 1 GROUP BY doc_id), "
        f"hr AS (SELECT doc_id, max(n) AS agg_run FROM (SELECT doc_id, island, count(*) AS n FROM (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM chars WHERE c IN ({hyd})) GROUP BY ALL) GROUP BY doc_id), "
        "lm AS (SELECT len AS mode FROM cnt WHERE len > 0 GROUP BY len ORDER BY count(*) DESC, len LIMIT 1), "
        "p AS (SELECT doc_id, CASE WHEN center IS NULL THEN '' ELSE substr(sequence, (greatest(center - 20, 0) + 1)::BIGINT, (least(center + 21, length(sequence)) - greatest(center - 20, 0))::BIGINT) END AS part, (center IS NULL)::INTEGER AS motif_penalty FROM seqs LEFT JOIN f USING (doc_id)), "
        f"q AS (SELECT doc_id, part, motif_penalty, {window} FROM p), lq AS (SELECT doc_id, motif_penalty, {charge_sql('5.5', 'part')} AS local55, {charge_sql('9.0', 'part')} AS local90 FROM q), "
        f"base AS (SELECT doc_id, source, motif_penalty, -(n_chars % 97) / 10.0::DOUBLE AS ll, (n_chars % 31 - n_chars % 97) / 10.0::DOUBLE AS delta_ll, (n_chars % 53) / 100.0::DOUBLE AS delta_emb, {weighted(K.HYDROPATHY)} / len AS hydropathy, (nP + nG) / len::DOUBLE AS pg, "
        "0 - pow(abs(len - mode) / mode, 1.5) AS length, local55, local90, agg_window, coalesce(agg_run, 0)::DOUBLE AS agg_run FROM cnt JOIN documents USING (doc_id) JOIN lq USING (doc_id) JOIN hw USING (doc_id) LEFT JOIN hr USING (doc_id), lm), "
        f"cen AS (SELECT *, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY source) AS k_{c}' for c in cols)} FROM base), "
        f"med AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in centred)} FROM cen), mad AS (SELECT {', '.join(f'median(abs({c} - m_{c})) AS d_{c}' for c in centred)} FROM cen, med) "
        f"SELECT doc_id, round(({core}) + {term} - 3.2 * motif_penalty, 3) AS activity_1, round(({core}) + {term} + 0.15 * {robust('k_pg')} - 0.55 * abs({robust('k_local90')}) - 3.0 * motif_penalty, 3) AS activity_2, round({expr} + 0.40 * {term}, 3) AS expression FROM cen, med, mad"
    )


def _r1(spark: SparkSession, d: str, delta: bool) -> DataFrame:
    out = scores.cluster_aware(_r1_rows(spark, d, delta))
    return out.select("doc_id", *(F.round(c, 3).alias(c) for c in ("activity_1", "activity_2", "expression")))


#: Most documents lack the motif, so the median of its local charges is 0 and so is their MAD: the robust z is then of the order of 1e8, as the recipe has it. The SQL check leaves the sign to it.
@C.add("score_r1_v2", _r1_sql(False))
def score_r1_v2(spark: SparkSession, d: str) -> DataFrame:
    return _r1(spark, d, False)


@C.add("score_r1_with_delta", _r1_sql(True))
def score_r1_with_delta(spark: SparkSession, d: str) -> DataFrame:
    return _r1(spark, d, True)


_R2 = {"align": "l_quantity", "phopt": "l_discount", "instability": "l_tax", "weight": "l_extendedprice", "charge7": "l_partkey % 101", "charge5": "l_suppkey % 103", "iep": "l_orderkey % 107", "charge9": "l_partkey % 109"}


def _r2_sql(style: str) -> str:
    robust = lambda c: f"coalesce(({c} - m_{c}) / (1.4826::DOUBLE * (d_{c} + 1e-8::DOUBLE)), 0)"
    total = lambda w: " + ".join(f"{x} * {robust(c)}" for c, x in w.items() if c in _R2)
    act = f"({total(K.R2_ACTIVITY[style])})"
    clip = lambda x: f"round(least(greatest({x}, -25), 25), 6)"
    return (
        f"WITH x AS (SELECT l_orderkey, l_linenumber, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in _R2.items())} FROM lineitem), m AS (SELECT {', '.join(f'median({k}) AS m_{k}' for k in _R2)} FROM x), "
        f"d AS (SELECT {', '.join(f'median(abs({k} - m_{k})) AS d_{k}' for k in _R2)} FROM x, m) SELECT l_orderkey, l_linenumber, {clip(act)} AS activity_1, {clip(f'0.98 * {act} + 0.10 * {robust('phopt')}')} AS activity_2, {clip(total(K.R2_EXPRESSION[style]))} AS expression FROM x, m, d"
    )


def _r2(spark: SparkSession, d: str, style: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(v).cast("double").alias(k) for k, v in _R2.items()))
    return scores.final_parameters(rows, style).select("l_orderkey", "l_linenumber", *(r6(c) for c in ("activity_1", "activity_2", "expression")))


@C.add("score_r2_safe", _r2_sql("safe"))
def score_r2_safe(spark: SparkSession, d: str) -> DataFrame:
    return _r2(spark, d, "safe")


@C.add("score_r2_aggressive", _r2_sql("aggressive"))
def score_r2_aggressive(spark: SparkSession, d: str) -> DataFrame:
    return _r2(spark, d, "aggressive")


_R3 = {"supervised": "p_size / 50.0", "family_hmm": "p_retailprice", "site_hmm": "p_size", "homologs_hmm": "p_partkey", "blosum": "-p_retailprice * 3"}
_R3_Z = {c: f"({x} - {m}::DOUBLE) / {sd}::DOUBLE" for c, x, m, sd in ((c, f"x_{c}", *K.R3_SCALES[c]) for c in _R3)}


@C.add(
    "score_r3_composite",
    f"WITH x AS (SELECT p_partkey, {', '.join(f'({v})::DOUBLE * (p_partkey % 50 <> 0)::INTEGER AS x_{k}' for k, v in _R3.items())} FROM part), z AS (SELECT p_partkey, {' AND '.join(f'x_{k} = 0' for k in _R3)} AS absent, {', '.join(f'{e} AS z_{k}' for k, e in _R3_Z.items())} FROM x) "
    "SELECT p_partkey, CASE WHEN NOT absent THEN round((z_family_hmm + z_site_hmm + z_homologs_hmm + z_blosum) / 4, 6) END AS unsupervised, CASE WHEN NOT absent THEN round((z_supervised + (z_family_hmm + z_site_hmm + z_homologs_hmm + z_blosum) / 4) / 2, 6) END AS composite FROM z",
)
def score_r3_composite(spark: SparkSession, d: str) -> DataFrame:
    there = (F.col("p_partkey") % 50 != 0).cast("int")
    rows = table(spark, d, "part").select("p_partkey", *((F.expr(v).cast("double") * there).alias(k) for k, v in _R3.items()))
    return scores.profile_composite(rows).select("p_partkey", r6("unsupervised"), r6("composite"))


@C.add("ensemble_mean", "SELECT p_partkey, round((p_size::DOUBLE + p_retailprice::DOUBLE) / 2, 6) AS ensemble FROM part")
def ensemble_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").cast("double").alias("b"))
    return rows.select("p_partkey", r6("ensemble", scores.ensemble_mean(["a", "b"])))


_R6 = {
    "iep": "ph",
    "charge7": charge_sql("7.4"),
    "charge9": charge_sql("9.0"),
    "charge55": charge_sql("5.5"),
    "molecular_weight": f"CASE WHEN len > 0 THEN {weighted(K.MASS)} - (len - 1) * {K.WATER}::DOUBLE ELSE 0 END",
    "hydrophobicity": f"CASE WHEN len > 0 THEN {weighted(K.HYDROPATHY)} / len ELSE 0 END",
    "pg_fraction": "CASE WHEN len > 0 THEN (nP + nG) / len::DOUBLE ELSE 0 END",
    "local_charge55": "local55",
    "local_charge90": "local90",
    "agg_window": "coalesce(agg_window, 0)",
    "agg_run": "coalesce(agg_run, 0)::DOUBLE",
    "length_penalty": "0 - abs(len - mode) / mode",
    "instability_index": "CASE WHEN len > 1 THEN 10.0::DOUBLE / len * coalesce(total, 0) ELSE 0 END",
}


def _r6_sql() -> str:
    motif = _motif_sql("E", "T", "E").split(f"{CHARS}, ", 1)[1]
    hyd = ", ".join(repr(x) for x in K.HYDROPHOBIC)
    window = ", ".join(f"length(part) - length(replace(part, '{a}', '')) AS n{a}" for a in (*K.PK_POSITIVE, *K.PK_NEGATIVE))
    return (
        f"{_PI}, {motif}, hw AS (SELECT doc_id, max(h) / least(9, any_value(len))::DOUBLE AS agg_window FROM (SELECT doc_id, pos, sum((c IN ({hyd}))::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS h, count(*) OVER (PARTITION BY doc_id) AS len FROM chars) WHERE pos >= 8 OR pos = len - 1 GROUP BY doc_id), "
        f"hr AS (SELECT doc_id, max(n) AS agg_run FROM (SELECT doc_id, island, count(*) AS n FROM (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM chars WHERE c IN ({hyd})) GROUP BY ALL) GROUP BY doc_id), "
        "lm AS (SELECT len AS mode FROM cnt GROUP BY len ORDER BY count(*) DESC, len LIMIT 1), "
        "part_ AS (SELECT doc_id, CASE WHEN center IS NULL THEN '' ELSE substr(sequence, (greatest(center - 20, 0) + 1)::BIGINT, (least(center + 21, length(sequence)) - greatest(center - 20, 0))::BIGINT) END AS part, (center IS NULL)::INTEGER AS motif_penalty FROM seqs LEFT JOIN f USING (doc_id)), "
        f"lq AS (SELECT doc_id, motif_penalty, {charge_sql('5.5', 'part')} AS local55, {charge_sql('9.0', 'part')} AS local90 FROM (SELECT doc_id, part, motif_penalty, {window} FROM part_)), "
        f"sc AS (SELECT c, w FROM {values(K.HYDROPATHY)}), di AS (SELECT doc_id, c AS a, lead(c) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM chars), ins AS (SELECT doc_id, sum(abs(x.w - y.w) / 7) AS total FROM di JOIN sc x ON di.a = x.c JOIN sc y ON di.b = y.c GROUP BY doc_id), "
        f"pr AS (SELECT doc_id, motif_penalty, {', '.join(f'{v} AS {k}' for k, v in _R6.items())} FROM cnt JOIN b USING (doc_id) JOIN lq USING (doc_id) LEFT JOIN hw USING (doc_id) LEFT JOIN hr USING (doc_id) LEFT JOIN ins USING (doc_id), lm WHERE b.k = {K.PI_STEPS}) "
        f"SELECT doc_id, motif_penalty, {', '.join(f'round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 5) AS z_{c}' for c in _R6)} FROM pr"
    )


@C.add("properties_r6", _r6_sql())
def properties_r6(spark: SparkSession, d: str) -> DataFrame:
    rows = scores.properties(sequences(spark, d), pattern=("E", "T", "E"), weights=dipeptide_weights(spark))
    return rows.select("doc_id", "motif_penalty", *(F.round(f"z_{c}", 5).alias(f"z_{c}") for c in _R6))


@C.add(
    "flagship",
    f"WITH {SEQS}, {CHARS}, {COUNTS}, x AS (SELECT doc_id, source, {weighted(K.HYDROPATHY)} / len AS gravy, {charge_sql('5.5')} AS charge, (nP + nG) / len::DOUBLE AS pg FROM cnt JOIN (SELECT doc_id, source FROM seqs) USING (doc_id) WHERE len >= 10), "
    "c AS (SELECT doc_id, gravy - avg(gravy) OVER w AS gravy, charge - avg(charge) OVER w AS charge, pg - avg(pg) OVER w AS pg FROM x WINDOW w AS (PARTITION BY source)), "
    "m AS (SELECT median(gravy) AS mg, median(charge) AS mc, median(pg) AS mp FROM c), d AS (SELECT median(abs(gravy - mg)) AS dg, median(abs(charge - mc)) AS dc, median(abs(pg - mp)) AS dp FROM c, m), "
    "s AS (SELECT doc_id, round(0.55 * (gravy - mg) / (1.4826::DOUBLE * (dg + 1e-8::DOUBLE)) - 0.75 * abs((charge - mc) / (1.4826::DOUBLE * (dc + 1e-8::DOUBLE))) + 0.15 * (pg - mp) / (1.4826::DOUBLE * (dp + 1e-8::DOUBLE)), 6) AS score FROM c, m, d) "
    "SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM s QUALIFY place <= greatest(1, floor((SELECT count(*) FROM s) * 0.1))",
)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Features, centred by cluster, robust z, a weighted score, and its top tenth in order."""
    rows = residues.with_counts(sequences(spark, d)).filter(F.length("sequence") >= 10)
    length = F.length("sequence")
    rows = rows.select("doc_id", "source", residues.hydropathy(F.col("n"), length).alias("gravy"), residues.net_charge(F.col("sequence"), F.col("n"), F.lit(5.5)).alias("charge"), residues.pro_gly_fraction(F.col("sequence")).alias("pg"))
    rows = stored(centered(rows, ["gravy", "charge", "pg"], "source"), "features")
    z = robust_z(rows, ["c_gravy", "c_charge", "c_pg"], "z_")
    scored = z.select("doc_id", F.round(0.55 * F.col("z_c_gravy") - 0.75 * F.abs("z_c_charge") + 0.15 * F.col("z_c_pg"), 6).alias("score"))
    k = max(1, int(rows.count() * 0.1))
    placed = running_before(scored, [F.desc("score"), F.col("doc_id")], F.lit(1), "place")
    return placed.withColumn("place", (F.col("place") + 1).cast("long")).filter(F.col("place") <= k)


# --- metrics ---------------------------------------------------------------------------------------------------------

_NDCG = (
    "x AS (SELECT {g} AS g, l_extendedprice::DOUBLE AS p, l_quantity::DOUBLE AS t, l_orderkey * 10 + l_linenumber AS r FROM lineitem), "
    "s AS (SELECT g, count(*) AS n, greatest(1, floor(count(*) * 0.1))::BIGINT AS k, min(t) AS lo, max(t) AS hi FROM x GROUP BY g), "
    "a AS (SELECT g, (t - lo) / (hi - lo) AS gain, k, row_number() OVER (PARTITION BY g ORDER BY p DESC, r DESC) AS rp, row_number() OVER (PARTITION BY g ORDER BY t DESC, r DESC) AS rt FROM x JOIN s USING (g) WHERE hi > lo), "
    "d AS (SELECT g, sum(CASE WHEN rp <= k THEN gain / log2(rp + 1) END) AS dcg, sum(CASE WHEN rt <= k THEN gain / log2(rt + 1) END) AS idcg FROM a GROUP BY g)"
)


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.select("l_returnflag", F.col("l_extendedprice").cast("double").alias("p"), F.col("l_quantity").cast("double").alias("t"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("r"))


@C.add("ndcg_top10pct", f"WITH {_NDCG.format(g='0')} SELECT n, k, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM s LEFT JOIN d USING (g)")
def ndcg_top10pct(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ndcg_top_fraction(_ranked(spark, d), "p", "t", "r").select("n", "k", r6("ndcg"))


@C.add("ndcg_by_group", f"WITH {_NDCG.format(g='l_returnflag')} SELECT g AS l_returnflag, n, k, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM s LEFT JOIN d USING (g)")
def ndcg_by_group(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ndcg_top_fraction(_ranked(spark, d), "p", "t", "r", group=["l_returnflag"]).select("l_returnflag", "n", "k", r6("ndcg"))


@C.add(
    "spearman",
    "WITH x AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS a, "
    "rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS b FROM lineitem) SELECT l_returnflag, round(corr(a, b), 6) AS rho FROM x GROUP BY l_returnflag",
)
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return metrics.spearman(_ranked(spark, d), "p", "t", ["l_returnflag"]).select("l_returnflag", r6("rho"))


@C.add(
    "auc_mannwhitney",
    "WITH x AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM documents JOIN labels USING (doc_id)), s AS (SELECT sum(r) FILTER (quality = 1) AS rs, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS q FROM x) SELECT round((rs - p * (p + 1) / 2.0) / (p * q), 6) AS auc FROM s",
)
def auc_mannwhitney(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("n_chars", "quality")
    return metrics.auc(rows, "n_chars", "quality").select(r6("auc"))


@C.add("accuracy_mae_rmse", "SELECT l_returnflag, round(avg(((l_discount > 0.05) = (l_tax > 0.04))::INTEGER), 6) AS accuracy, round(avg(abs(l_discount::DOUBLE - l_tax::DOUBLE)), 6) AS mae, round(sqrt(avg(pow(l_discount::DOUBLE - l_tax::DOUBLE, 2))), 6) AS rmse FROM lineitem GROUP BY ALL")
def accuracy_mae_rmse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_discount").cast("double").alias("p"), F.col("l_tax").cast("double").alias("t"), (F.col("l_discount") > 0.05).alias("a"), (F.col("l_tax") > 0.04).alias("b"))
    out = metrics.accuracy(rows, "a", "b", ["l_returnflag"]).join(metrics.errors(rows, "p", "t", ["l_returnflag"]), "l_returnflag")
    return out.select("l_returnflag", r6("accuracy"), r6("mae"), r6("rmse"))


@C.add("fold_summary", "SELECT round(avg(m), 6) AS value_mean, round(stddev_pop(m), 6) AS value_sd FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY ALL)")
def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("value"))
    return metrics.over_folds(per, ["value"]).select(r6("value_mean"), r6("value_sd"))


# --- folds and fits --------------------------------------------------------------------------------------------------

_HASH = "md5('42|' || {0}::VARCHAR)"


@C.add("kfold_assign", f"SELECT doc_id, (('0x' || substr({_HASH.format('doc_id')}, 1, 8))::BIGINT % 5)::INTEGER AS fold FROM documents")
def kfold_assign(spark: SparkSession, d: str) -> DataFrame:
    return folds.kfold(table(spark, d, "documents").select("doc_id"), "doc_id")


@C.add("stratified_kfold", f"SELECT doc_id, ((row_number() OVER (PARTITION BY quality ORDER BY {_HASH.format('doc_id')}, doc_id) - 1) % 5)::INTEGER AS fold FROM labels")
def stratified_kfold(spark: SparkSession, d: str) -> DataFrame:
    return folds.stratified(table(spark, d, "labels"), "doc_id", "quality").select("doc_id", "fold")


@C.add("group_kfold", f"WITH RECURSIVE {fit_sql.dealt('events', 'user_id')} SELECT event_id, user_id, fold::INTEGER AS fold FROM events JOIN dealt USING (user_id)")
def group_kfold(spark: SparkSession, d: str) -> DataFrame:
    return folds.grouped(table(spark, d, "events").select("event_id", "user_id"), "user_id").select("event_id", "user_id", "fold")


_FEATURES = ["l_discount", "l_tax", "l_extendedprice"]


def _fit_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in (*_FEATURES, "l_quantity")))


@C.add(
    "ridge_fit",
    "WITH s AS (SELECT count(*) AS n, avg(l_extendedprice::DOUBLE) AS mx, stddev_pop(l_extendedprice::DOUBLE) AS sx, avg(l_quantity::DOUBLE) AS my, covar_pop(l_extendedprice::DOUBLE, l_quantity::DOUBLE) AS c FROM lineitem), w AS (SELECT n * c / sx / (n + 1) / sx AS w, mx, my FROM s) "
    "SELECT round(w, 9) AS weight, round(my - w * mx, 6) AS intercept FROM w",
)
def ridge_fit(spark: SparkSession, d: str) -> DataFrame:
    """One feature, of which the SQL has the closed form."""
    m = models.ridge(_fit_rows(spark, d), ["l_extendedprice"], "l_quantity")
    return spark.createDataFrame([(round(m.weights[0], 9), round(m.intercept, 6))], "weight double, intercept double")


_RANKS = "rank() OVER (PARTITION BY fold ORDER BY {0}) + (count(*) OVER (PARTITION BY fold, {0}) - 1) / 2.0"


@C.add(
    "ridge_cv",
    f"WITH RECURSIVE rows_ AS (SELECT l_orderkey % 50 AS g, {', '.join(f'{c}::DOUBLE AS {c}' for c in (*_FEATURES, 'l_quantity'))} FROM lineitem), {fit_sql.dealt('rows_', 'g')}, x AS (SELECT * FROM rows_ JOIN dealt USING (g)), "
    f"train AS (SELECT f.f, x.* FROM range(5) f(f) JOIN x ON x.fold <> f.f), m AS ({fit_sql.ridge('train', _FEATURES, 'l_quantity')}), "
    f"p AS (SELECT fold, l_quantity AS t, intercept + {' + '.join(f'w{i} * {c}' for i, c in enumerate(_FEATURES))} AS prediction FROM x JOIN m ON f = fold), "
    f"k AS (SELECT *, {_RANKS.format('prediction')} AS ra, {_RANKS.format('t')} AS rb FROM p), per AS (SELECT fold, avg(abs(prediction - t)) AS mae, sqrt(avg(pow(prediction - t, 2))) AS rmse, coalesce(corr(ra, rb), 0) AS rho FROM k GROUP BY fold) "
    f"SELECT {', '.join(f'round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_sd' for m in ('mae', 'rmse', 'rho'))} FROM per",
)
def ridge_cv(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(folds.grouped(_fit_rows(spark, d).withColumn("g", F.col("l_orderkey") % 50), "g"), "folds")
    predicted = models.predict_folds(rows, models.ridge_folds(rows, _FEATURES, "l_quantity", "fold"), "fold")
    per = metrics.errors(predicted, "prediction", "l_quantity", ["fold"]).join(metrics.spearman(predicted, "prediction", "l_quantity", ["fold"]), "fold")
    out = metrics.over_folds(per, ["mae", "rmse", "rho"])
    return out.select(*(r6(c) for c in out.columns))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = residues.with_counts(sequences(spark, d)).join(table(spark, d, "labels"), "doc_id")
    out = residues.composition(F.col("n"), F.length("sequence"))
    return rows.select("doc_id", "quality", *(v.alias(k) for k, v in out.items()))


_COMPOSITION = ["frac_acidic", "frac_basic", "frac_A", "frac_E", "frac_L"]


_LABELLED = (
    f"WITH {SEQS}, {CHARS}, {COUNTS}, lab AS (SELECT doc_id, quality, CASE WHEN len > 0 THEN (nD + nE) / len::DOUBLE ELSE 0 END AS frac_acidic, CASE WHEN len > 0 THEN (nK + nR + nH) / len::DOUBLE ELSE 0 END AS frac_basic, "
    + ", ".join(f"CASE WHEN len > 0 THEN n{a} / len::DOUBLE ELSE 0 END AS frac_{a}" for a in "AEL")
    + " FROM cnt JOIN labels USING (doc_id))"
)


@C.add(
    "logreg_fit",
    f"{_LABELLED}, rows_ AS (SELECT 0 AS f, * FROM lab), {fit_sql.logistic('rows_', _COMPOSITION, 'quality')} "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, round({w}, 6) AS weight FROM fitted" for c, w in [*((c, f"w{i}") for i, c in enumerate(_COMPOSITION)), ("intercept", "intercept")]),
)
def logreg_fit(spark: SparkSession, d: str) -> DataFrame:
    m = models.logistic(stored(_labelled(spark, d), "labelled"), _COMPOSITION, "quality")
    return spark.createDataFrame([(c, round(w, 6)) for c, w in zip([*m.columns, "intercept"], [*m.weights, m.intercept], strict=True)], "feature string, weight double")


@C.add(
    "logreg_cv",
    f"{_LABELLED}, x AS (SELECT *, ((row_number() OVER (PARTITION BY quality ORDER BY {_HASH.format('doc_id')}, doc_id) - 1) % 5)::INTEGER AS fold FROM lab), rows_ AS (SELECT f.f, x.* FROM range(5) f(f) JOIN x ON x.fold <> f.f), {fit_sql.logistic('rows_', _COMPOSITION, 'quality')}, "
    f"p AS (SELECT fold, quality, 1 / (1 + exp(-(intercept + {' + '.join(f'w{i} * {c}' for i, c in enumerate(_COMPOSITION))}))) AS prediction FROM x JOIN fitted ON f = fold), k AS (SELECT *, {_RANKS.format('prediction')} AS r FROM p), "
    "per AS (SELECT fold, avg(((prediction >= 0.5)::INTEGER = quality)::INTEGER) AS accuracy, (sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)) AS auc FROM k GROUP BY fold) "
    "SELECT round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_sd, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_sd FROM per",
)
def logreg_cv(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(folds.stratified(_labelled(spark, d), "doc_id", "quality"), "labelled")
    fitted = models.logistic_folds(rows, _COMPOSITION, "quality", "fold")
    predicted = models.predict_folds(rows, fitted, "fold").withColumn("called", (F.col("prediction") >= 0.5).cast("int"))
    per = metrics.auc(predicted, "prediction", "quality", ["fold"]).join(metrics.accuracy(predicted, "called", "quality", ["fold"]), "fold")
    out = metrics.over_folds(per, ["auc", "accuracy"])
    return out.select(*(r6(c) for c in out.columns))


_PH = ["l_extendedprice", "l_discount"]
_PH_SQL = f"WITH rows_ AS (SELECT 0 AS f, l_orderkey, l_linenumber, {', '.join(f'{c}::DOUBLE AS {c}' for c in (*_PH, 'l_quantity'))} FROM lineitem), m AS ({fit_sql.ridge('rows_', _PH, 'l_quantity')})"


@C.add("predict_at_ph", f"{_PH_SQL} SELECT l_orderkey, l_linenumber, {', '.join(f'round(greatest(intercept + w0 * l_extendedprice + w1 * {v}::DOUBLE, 0), 6) AS {name}' for v, name in ((0.02, 'low'), (0.08, 'high')))} FROM rows_ JOIN m USING (f)")
def predict_at_ph(spark: SparkSession, d: str) -> DataFrame:
    """A model of quantity on price and discount, asked at two fixed discounts; not below 0."""
    rows = _fit_rows(spark, d)
    m = models.ridge(rows, _PH, "l_quantity")
    at = models.predict_at(rows, m, "l_discount", 0.02, "low")
    return models.predict_at(at, m, "l_discount", 0.08, "high").select("l_orderkey", "l_linenumber", r6("low"), r6("high"))


@C.add("model_roundtrip", f"{_PH_SQL} SELECT l_orderkey, l_linenumber, round(intercept + w0 * l_extendedprice, 6) AS prediction FROM rows_ JOIN m USING (f)")
def model_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on all rows, saved, loaded, and asked of a table that lacks one of its columns."""
    rows, path = _fit_rows(spark, d), f"{shared_dir(spark)}/seqrank/model-{uuid.uuid4().hex}"
    models.ridge(rows, _PH, "l_quantity").save(spark, path)
    return models.Linear.load(spark, path).predict(rows.drop("l_discount")).select("l_orderkey", "l_linenumber", r6("prediction"))


@C.add("metrics_json", "SELECT round(avg(abs(l_discount::DOUBLE - l_tax::DOUBLE)), 6) AS mae, round(sqrt(avg(pow(l_discount::DOUBLE - l_tax::DOUBLE, 2))), 6) AS rmse FROM lineitem")
def metrics_json(spark: SparkSession, d: str) -> DataFrame:
    """Written as a model's figures are, and read back."""
    rows = table(spark, d, "lineitem").select(F.col("l_discount").cast("double").alias("p"), F.col("l_tax").cast("double").alias("t"))
    path = f"{shared_dir(spark)}/seqrank/metrics-{uuid.uuid4().hex}"
    models.save_metrics(spark, metrics.errors(rows, "p", "t").first().asDict(), path)
    found = models.load_metrics(spark, path)
    return spark.createDataFrame([(round(found["mae"], 6), round(found["rmse"], 6))], "mae double, rmse double")
