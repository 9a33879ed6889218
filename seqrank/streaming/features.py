"""Features of sequences as they arrive: the same expressions on an unbounded table, without any state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import motifs, residues
from ..session import ready


def featurised(stream: DataFrame, text: str = "text") -> DataFrame:
    """Adds sequence, seq_len, gravy, charge55 and agg_window."""
    ready(stream.sparkSession)
    rows = residues.with_counts(stream.withColumn("sequence", residues.letters_to_sequence(F.col(text))))
    s, n, length = F.col("sequence"), F.col("n"), F.length("sequence")
    return rows.withColumns(
        {"seq_len": length, "gravy": residues.hydropathy(n, length), "charge55": residues.net_charge(s, n, F.lit(5.5)), "agg_window": motifs.max_hydrophobic_window(s)}
    ).drop("n")
