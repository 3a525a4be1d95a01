"""D: detection of errors."""

from ...operators import detect
from .. import bindings as b
from ..registry import query
from ..sql_parts import final, with_parts
from .common import tidy

NUMBERED = """SELECT site, ts, value, row_number() OVER (PARTITION BY site ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY site) AS n,
    CASE WHEN value IS NULL THEN 'null' WHEN value = 0 THEN 'zero' WHEN value < 0 THEN 'neg' END AS point_error FROM {source}"""


def window_parts(source: str, period: int) -> dict[str, str]:
    """The weekly window rule, restated as a self join on the candidate row numbers."""
    return {
        "numbered": NUMBERED.format(source=source),
        "offsets": "SELECT unnest(generate_series(-5, 4)) AS j",
        "near": f"""SELECT a.site, a.ts, a.idx, a.value, a.point_error, list_sort(list(c.value) FILTER (c.value IS NOT NULL AND c.point_error IS NULL)) AS v
            FROM numbered a CROSS JOIN offsets o LEFT JOIN numbered c ON c.site = a.site AND c.idx = a.idx + {period} * o.j
              AND o.j >= -least(5, a.idx // {period}) AND o.j < least(5, (a.n - a.idx) // {period})
            GROUP BY ALL""",
        "flagged": """SELECT site, ts, idx, CASE WHEN point_error IS NOT NULL THEN point_error WHEN coalesce(len(v), 0) <= 2 THEN 'bad_win'
            WHEN value < 0.2 * (list_sum(v[2:len(v) - 1]) / (len(v) - 2)) THEN 'too_low' END AS error_type FROM near""",
    }


POINTS = "SELECT site, ts, idx, point_error AS error_type FROM numbered WHERE point_error = '{0}'"
# the load less 10, floored to whole tens, has zeros and negative values
SHIFTED = "SELECT site, ts, floor((value - 20) / 10) * 10 AS value FROM hourly"


def shifted(spark, sf):
    return b.hourly(spark, sf).selectExpr("site", "ts", "floor((value - 20) / 10) * 10.0D AS value")


def point_query(name, kind):
    @query(name, final("site ts! idx# error_type", f"({POINTS.format(kind)})", shifted=SHIFTED, numbered=NUMBERED.format(source="shifted")))
    def run(spark, sf):
        return tidy(detect.point_flags(shifted(spark, sf)).filter(f"error_type = '{kind}'"))

    return run


point_query("d1_null", "null")
point_query("d2_zero", "zero")
point_query("d3_negative", "neg")


@query("d4_bad_window", final("site ts! idx# error_type", "(SELECT * FROM flagged WHERE error_type = 'bad_win')", **window_parts("hourly", 168)))
def d4(spark, sf):
    return tidy(detect.detect_errors(b.hourly(spark, sf)).filter("error_type = 'bad_win'"))


@query("d5_too_low", final("site ts! idx# error_type", "(SELECT * FROM flagged WHERE error_type = 'too_low')", **window_parts("daily", 7)))
def d5(spark, sf):
    return tidy(detect.detect_errors(b.daily(spark, sf), step=86400, period=7).filter("error_type = 'too_low'"))


@query("d6_affected_sites", with_parts("SELECT error_type, count(DISTINCT site) AS n_sites FROM flagged WHERE error_type IS NOT NULL GROUP BY 1", **window_parts("daily", 7)))
def d6(spark, sf):
    return detect.affected_sites(detect.detect_errors(b.daily(spark, sf), step=86400, period=7))
