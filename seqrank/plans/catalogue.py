"""Where queries and the SQL that says the same are registered, and the domain tables that they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.residues import letters_to_sequence

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source (as the cluster), sequence: the documents' whole texts read as sequences."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", letters_to_sequence(F.col("text")).alias("sequence"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_id, ref_sequence: the benchmark passages read as sequences."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), letters_to_sequence(F.col("text")).alias("ref_sequence"))


def r6(name: str, column: Column | None = None) -> Column:
    """A double rounded to 6 digits, under a name."""
    return F.round(F.col(name) if column is None else column, 6).alias(name)


# --- SQL fragments ---------------------------------------------------------------------------------------------------

_LETTERS = "upper(regexp_replace({0}, '[^A-Za-z]', '', 'g'))"


def seq_sql(text: str = "text") -> str:
    return f"regexp_replace({_LETTERS.format(text)}, '[^{K.AMINO_ACIDS}]', '', 'g')"


SEQS = f"seqs AS (SELECT doc_id, source, {seq_sql()} AS sequence FROM documents)"
REFS = f"refs AS (SELECT item_id AS ref_id, {seq_sql()} AS ref_sequence FROM benchmark)"
#: A row per residue and position (from 0).
CHARS = "chars AS (SELECT doc_id, unnest(string_split(sequence, '')) AS c, unnest(range(length(sequence))) AS pos FROM seqs WHERE length(sequence) > 0)"
#: A row per document with a column per residue's count.
COUNTS = (
    "cnt AS (SELECT s.doc_id, s.sequence, length(s.sequence) AS len, "
    + ", ".join(f"coalesce(sum(n) FILTER (c = '{a}'), 0) AS n{a}" for a in K.AMINO_ACIDS)
    + " FROM seqs s LEFT JOIN (SELECT doc_id, c, count(*) AS n FROM chars GROUP BY ALL) USING (doc_id) GROUP BY ALL)"
)


def values(scale: dict[str, float]) -> str:
    return "(VALUES " + ", ".join(f"('{a}', {w}::DOUBLE)" for a, w in scale.items()) + ") AS scale(c, w)"


def weighted(scale: dict[str, float]) -> str:
    return "(" + " + ".join(f"n{a} * {w}::DOUBLE" for a, w in scale.items()) + ")"


def charge_sql(ph: str, s: str = "sequence", n: str = "n") -> str:
    """The charge of a sequence over count columns with a prefix."""

    def end(residue: str, default: float, overrides: dict[str, float]) -> str:
        return f"CASE {residue} " + " ".join(f"WHEN '{a}' THEN {pk}::DOUBLE" for a, pk in overrides.items()) + f" ELSE {default}::DOUBLE END"

    plus = [f"{n}{a} * (1 / (1 + pow(10::DOUBLE, {ph} - {pk})))" for a, pk in K.PK_POSITIVE.items()]
    minus = [f"{n}{a} * (1 / (1 + pow(10::DOUBLE, {pk} - {ph})))" for a, pk in K.PK_NEGATIVE.items()]
    first = f"1 / (1 + pow(10::DOUBLE, {ph} - {end(f'left({s}, 1)', K.PK_N_TERMINUS, K.PK_N_TERMINAL)}))"
    last = f"1 / (1 + pow(10::DOUBLE, {end(f'right({s}, 1)', K.PK_C_TERMINUS, K.PK_C_TERMINAL)} - {ph}))"
    return f"CASE WHEN length({s}) > 0 THEN ({' + '.join(plus)} + {first}) - ({' + '.join(minus)} + {last}) ELSE 0 END"


def fnv_sql(letters: list[str], dim: int = K.KMER_DIM) -> str:
    h = f"{K.FNV_OFFSET}::BIGINT"
    for c in letters:
        h = f"((xor({h}, ascii({c})::BIGINT) * {K.FNV_PRIME}) % 4294967296)"
    return f"({h} % {dim})::INTEGER"


def kmers_sql(source: str, key: str, name: str, valid_only: bool = False) -> str:
    """CTEs <name>_words and <name> (key, bucket, c) of a table's sequences."""
    only = f" AND regexp_full_match(a || b || d, '[{K.AMINO_ACIDS}]+')" if valid_only else ""
    return (
        f"{name}_chars AS (SELECT {key}, unnest(string_split(sequence, '')) AS a, unnest(range(length(sequence))) AS pos FROM {source} WHERE length(sequence) > 0), "
        f"{name}_words AS (SELECT {key}, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS d FROM {name}_chars WINDOW w AS (PARTITION BY {key} ORDER BY pos)), "
        f"{name} AS (SELECT {key}, {fnv_sql(['a', 'b', 'd'])} AS bucket, count(*) AS c FROM {name}_words WHERE d IS NOT NULL{only} GROUP BY ALL)"
    )
