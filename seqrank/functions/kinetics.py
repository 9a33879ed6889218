"""Closed-form enzyme kinetics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mgml_to_molar(enzyme: Column, mw_kda: Column) -> Column:
    return enzyme / (mw_kda * 1000.0)


def michaelis_menten(kcat: Column, km: Column, s0: Column, enzyme: Column) -> Column:
    """v0; null if an input is negative, 0 without substrate. The enzyme's unit isn't converted to the substrate's."""
    negative = (kcat < 0) | (km < 0) | (s0 < 0) | (enzyme < 0)
    return F.when(negative, F.lit(None).cast("double")).when(s0 == 0, F.lit(0.0)).otherwise(F.try_divide(kcat * enzyme * s0, km + s0))


def specific_activity(rate: Column, volume_ml: Column, enzyme_mg: Column, unit: str = "mM") -> Column:
    """A concentration rate as micromoles per minute and mg; null if there is no volume or enzyme."""
    if unit not in ("mM", "uM"):
        raise ValueError("unit must be mM or uM")
    micromoles = rate * volume_ml if unit == "mM" else rate * volume_ml / 1000.0
    return F.when((volume_ml <= 0) | (enzyme_mg <= 0), F.lit(None).cast("double")).otherwise(F.try_divide(micromoles, enzyme_mg))


def per_minute(per_second: Column) -> Column:
    return per_second * 60.0


#: The scale by which a model's predictions of a property are multiplied.
TASK_MAXIMUM = {"pHopt": 14.0, "topt": 120.0, "tm": 100.0}


def from_log10(x: Column) -> Column:
    """A constant predicted as its decimal logarithm."""
    return F.pow(F.lit(10.0), x)


def by_task_maximum(x: Column, task: str) -> Column:
    """A prediction in [0, 1] in the units of its task."""
    return x * F.lit(TASK_MAXIMUM[task])
