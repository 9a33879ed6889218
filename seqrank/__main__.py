"""The flows from a command line: ``python -m seqrank <flow> --help``. Paths may be of any store that Spark reads."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kmers
from .operators import clusters, embeddings, positions, wild_types
from .plans import pipelines, scores
from .schema import number, require_columns
from .sources import tables


#: The column of a row's place in its files, where a flow needs it.
ORDER = "__position"


def _table(spark: SparkSession, path: str, sheet: str | None = None, ordered: bool = False) -> DataFrame:
    """A CSV, XLSX or FASTA table by its name's ending, Parquet otherwise. ordered: CSV and Parquet with their rows' places as ORDER."""
    name = path.lower().rstrip("/")
    if name.endswith(".xlsx"):
        return tables.read_xlsx(spark, path, sheet)
    if name.endswith((".fasta", ".fa", ".faa")):
        return tables.read_fasta(spark, path)
    read = tables.read_csv(spark, path) if name.endswith(".csv") else spark.read.parquet(path)
    read = positions.positioned(read, ORDER) if ordered else read
    return tables.without_unnamed(tables.named_index(read)) if name.endswith(".csv") else read


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: number(c) for c in columns if c in df.columns})


def cluster(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = require_columns(_table(spark, a.input, a.sheet), [a.sequence], "cluster")
    found = clusters.clusters(rows, a.sequence, a.k, a.dim)
    tables.write_csv(found, a.out_clusters)
    tables.write_csv(clusters.representatives(found), a.out_reps)


def wild_type(spark: SparkSession, a: argparse.Namespace) -> None:
    found = require_columns(_table(spark, a.clusters), ["sequence", "cluster_id"], "wild-types")
    wild = _table(spark, a.wt)
    wild = wild if "wt_id" in wild.columns else tables.synthetic_ids(wild, a.wt_sequence, "wt_id", "", 1).withColumn("wt_id", F.col("wt_id").cast("long"))
    options = wild_types.candidates(found, wild.select(F.col("wt_id").cast("long").alias("wt_id"), F.col(a.wt_sequence).alias("wt_sequence")))
    chosen = wild_types.choose(options, found)
    tables.write_csv(chosen, a.out_clusters)
    tables.write_csv(wild_types.sequence_map(found, chosen), a.out_sequences)


def properties(spark: SparkSession, a: argparse.Namespace) -> None:
    weights = _numbers(_table(spark, a.weights), ["weight"]) if a.weights else None
    tables.write_csv(scores.properties(_table(spark, a.input, a.sheet), a.sequence, tuple(a.motif), weights=weights), a.output)


def final(spark: SparkSession, a: argparse.Namespace) -> None:
    names = ("align", "phopt", "instability", "weight", "delta", "charge7", "charge9", "charge5", "charge55", "iep", "delta_emb", "wt_cosine_sim")
    rows = embeddings.delta_given(_numbers(_table(spark, a.input, a.sheet), names))
    rows = rows.withColumnRenamed("delta_emb", "delta") if "delta" not in rows.columns and "delta_emb" in rows.columns else rows
    tables.write_csv(scores.final_parameters(rows, a.style), a.output)


def zero_shot(spark: SparkSession, a: argparse.Namespace) -> None:
    delta = _numbers(_table(spark, a.delta, ordered=True), ["delta_emb", "wt_cosine_sim"]) if a.delta else None
    clustered, likelihood = _table(spark, a.clusters, ordered=True), _numbers(_table(spark, a.likelihood, ordered=True), ["ll"])
    found = pipelines.zero_shot(_table(spark, a.input, a.sheet), clustered, _table(spark, a.reps), likelihood, delta, ORDER)
    tables.write_csv(found, a.output)


def kinetics(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _numbers(_table(spark, a.input, a.sheet), ["kcat", "km", "expression"])
    rows = scores.kinetics_activity(rows, a.s0, a.enzyme_mgml, a.mw_kda, a.volume_ml, a.unit, not a.per_minute, "expression" if a.expression_as_enzyme else None)
    tables.write_csv(rows, a.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqrank", description=__doc__)
    flows = top.add_subparsers(dest="flow", required=True)

    def flow(run, name: str, *paths: str) -> argparse.ArgumentParser:
        p = flows.add_parser(name)
        for path in paths:
            p.add_argument(f"--{path}", required=True)
        p.add_argument("--sheet")
        p.add_argument("--sequence", default="sequence")
        p.set_defaults(run=run)
        return p

    p = flow(cluster, "cluster", "input", "out-clusters", "out-reps")
    p.add_argument("--k", type=int, default=kmers.K.KMER)
    p.add_argument("--dim", type=int, default=kmers.K.KMER_DIM)
    flow(wild_type, "wild-types", "clusters", "wt", "out-clusters", "out-sequences").add_argument("--wt-sequence", default="sequence")
    p = flow(properties, "properties", "input", "output")
    p.add_argument("--weights")
    p.add_argument("--motif", nargs=3, default=["G", "S", "G"])
    flow(final, "final-score", "input", "output").add_argument("--style", choices=("safe", "aggressive"), default="safe")
    flow(zero_shot, "zero-shot", "input", "clusters", "reps", "likelihood", "output").add_argument("--delta")
    p = flow(kinetics, "kinetics", "input", "output")
    for name, default in (("s0", 1.0), ("enzyme-mgml", 1.0), ("mw-kda", 30.0), ("volume-ml", 1.0)):
        p.add_argument(f"--{name}", type=float, default=default)
    p.add_argument("--unit", choices=("mM", "uM"), default="mM")
    p.add_argument("--per-minute", action="store_true")
    p.add_argument("--expression-as-enzyme", action="store_true")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    """Run a flow; the session is the submitting one, or a new one of Spark's own settings."""
    arguments = parser().parse_args(argv)
    arguments.run(spark or SparkSession.builder.appName(f"seqrank {arguments.flow}").getOrCreate(), arguments)


if __name__ == "__main__":
    main()
