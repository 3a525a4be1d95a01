"""Formulas of the registered models, sized for the hourly series of the test tables."""

from ..operators.features import Factor, Term

LAG = Factor("target", 4, "lag", "24")
TEMPERATURE = Factor("temperature", 4)
HOUR = Factor("hour", 8)
WEEKEND = Factor("weekend", "p1")
TIME = Factor("timestamp", "p1")
YEAR_DAY = Factor("year_day", 3)

WANTED = [
    ("target", "lag", 24), ("temperature", "", None), ("hour", "", None),
    ("weekend", "", None), ("timestamp", "", None), ("year_day", "", None), ("week_day", "binary", None),
]

# the default kind: unconstrained terms and interactions with quadratic penalties
DEFAULT = [
    Term((LAG,), "smoothing", 1e-4),
    Term((TEMPERATURE,), "smoothing", 1e-3),
    Term((HOUR,), "ridge", 1e-6),
    Term((TIME,), "ridge", 1e-3),
    Term((WEEKEND, HOUR), "smoothing", 1e-6),
    Term((LAG, HOUR), "ridge", 1e-4),
]


def shared(penalty: str, alpha, structure: int | None = None) -> list[Term]:
    """Calendar terms, the same for all sites, under one penalty."""
    return [Term((HOUR,), penalty, alpha, structure), Term((Factor("timestamp", 4),), penalty, alpha, structure)]


# 24 hats on the 24 hours are indicators of the hour
EACH_HOUR = Factor("hour", 24)
