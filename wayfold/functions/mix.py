"""Land-use mix: sector shares, entropy and its index."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .maths import round_half_up

MIX_SECTORS = ("government", "education", "retail", "leisure", "healthcare")


def mix_index(df: DataFrame, total: str = "total_intensity") -> DataFrame:
    """Add `p_<sector>` (2 digits), `entropy` and `entropy_index` (3 digits) from the five sector columns.

    Shares are NULL without a total; the entropy treats them as absent, so it is 0 there.
    """
    shares = {
        f"p_{s}": round_half_up(F.try_divide(F.col(s).cast("double"), F.col(total).cast("double")), 2)
        for s in MIX_SECTORS
    }
    df = df.withColumns(shares)
    terms = F.lit(0.0)
    for s in MIX_SECTORS:
        p = F.col(f"p_{s}")
        terms = terms + F.when(p > 0, p * F.log(p)).otherwise(0.0)
    df = df.withColumn("entropy", round_half_up(-terms, 3))
    return df.withColumn("entropy_index", round_half_up(F.col("entropy") / math.log(5.0), 3))
