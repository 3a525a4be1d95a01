"""Number formatting as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_significant(x: Column, digits: int = 1) -> Column:
    """Round to ``digits`` digits below the leading decade of ``x``."""
    decade = F.floor(F.log10(F.greatest(F.lit(1e-12), F.abs(x))))
    scale = F.pow(F.lit(10.0), F.lit(digits) - decade)
    return F.rint(x * scale) / scale
