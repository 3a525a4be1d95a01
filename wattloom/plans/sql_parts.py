"""Named SQL pieces of the same derivations, for the checks in DuckDB."""

from __future__ import annotations

import re


def rounded(expression: str, digits: int = 6) -> str:
    """Round, with negative zero written as zero."""
    return f"(CASE WHEN round({expression}, {digits}) = 0 THEN CAST(0 AS DOUBLE) ELSE round({expression}, {digits}) END)"


def full_grid(source: str, keys: str, unit: str, pad: str = "") -> str:
    return f"""SELECT s.*, g.ts FROM (SELECT DISTINCT {keys} FROM {source}) s,
        (SELECT unnest(generate_series(min(ts), max(ts){pad}, INTERVAL 1 {unit})) AS ts FROM {source}) g"""


def interpolated(source: str, keys: str) -> str:
    """Linear interpolation; the trailing gap holds, the leading gap stays null."""
    part = f"PARTITION BY {keys} ORDER BY ts"
    return f"""SELECT {keys}, ts, CASE WHEN value IS NOT NULL THEN value WHEN pt IS NULL THEN NULL WHEN nt IS NULL THEN pv
          ELSE pv + (nv - pv) * ((epoch(ts) - epoch(pt)) / (epoch(nt) - epoch(pt))) END AS value FROM (
        SELECT *, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
          last_value(value IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
          first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER ({part} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt,
          first_value(value IGNORE NULLS) OVER ({part} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv
        FROM {source})"""


def backfilled(source: str, keys: str) -> str:
    return f"""SELECT {keys}, ts, first_value(value IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY ts
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {source}"""


def places(table: str, key: str, name: str) -> str:
    return f"""SELECT {name} AS name, 42 + CAST({key} * 37 % 80 AS DOUBLE) / 10 AS latitude,
        -4 + CAST({key} * 53 % 110 AS DOUBLE) / 10 AS longitude FROM {table}"""


STATION = "'ST_' || CAST(user_id % 8 AS VARCHAR)"

PARTS: dict[str, str] = {
    "load_h": """SELECT event_type AS site, date_trunc('hour', ts) AS ts,
        CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2""",
    "grid_h": full_grid("load_h", "site", "HOUR"),
    "hourly": "SELECT g.site, g.ts, l.value FROM grid_h g LEFT JOIN load_h l USING (site, ts)",
    "filled_h": backfilled("hourly", "site"),
    "clean_h": "SELECT * FROM filled_h WHERE value IS NOT NULL",
    "load_q": """SELECT event_type AS site, time_bucket(INTERVAL 15 MINUTE, ts) AS ts,
        CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2""",
    "load_d": """SELECT n_name AS site, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "grid_d": full_grid("load_d", "site", "DAY"),
    "daily": "SELECT g.site, g.ts, l.value FROM grid_d g LEFT JOIN load_d l USING (site, ts)",
    "filled_d": backfilled("daily", "site"),
    "load_s": """SELECT site, ts, CAST(sum(q) AS DOUBLE) AS value FROM (
        SELECT unnest(['ALL', 'S_' || l_linestatus, 'R_' || l_returnflag]) AS site,
          date_trunc('day', l_shipdate)::TIMESTAMP AS ts, CAST(l_quantity AS DECIMAL(18,2)) AS q FROM lineitem) GROUP BY 1, 2""",
    "grid_s": full_grid("load_s", "site", "DAY"),
    "shipped": "SELECT g.site, g.ts, l.value FROM grid_s g LEFT JOIN load_s l USING (site, ts)",
    "weather_wide": f"""SELECT {STATION} AS station, date_trunc('hour', ts) AS ts,
        CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS temperature,
        CAST(count(*) % 9 AS DOUBLE) AS nebulosity, max(value) AS wind_speed FROM events GROUP BY 1, 2""",
    "weather": """SELECT station, ts, 'temperature' AS quantity, temperature AS value FROM weather_wide
        UNION ALL SELECT station, ts, 'nebulosity', nebulosity FROM weather_wide
        UNION ALL SELECT station, ts, 'wind_speed', wind_speed FROM weather_wide""",
    "grid_w": full_grid("weather", "station, quantity", "HOUR"),
    "weather_grid": """SELECT g.station, g.quantity, g.ts, w.value FROM grid_w g
        LEFT JOIN weather w USING (station, quantity, ts)""",
    "weather_lin": interpolated("weather_grid", "station, quantity"),
    "weather_filled": backfilled("weather_lin", "station, quantity"),
    "nation_coords": places("nation", "n_nationkey", "n_name"),
    "supplier_coords": places("supplier", "s_suppkey", "s_name"),
    "customer_coords": places("customer", "c_custkey", "c_name"),
    "station_coords": places(f"(SELECT DISTINCT user_id % 8 AS k, {STATION} AS station FROM events)", "k", "station"),
    "type_coords": places("(SELECT DISTINCT event_type, length(event_type) * 3 AS k FROM events)", "k", "event_type"),
    "site_region": "SELECT n_name AS site, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    "station_weights": """SELECT station, zone, CAST(sum(w) AS DOUBLE) AS weight FROM (
        SELECT 'ST_' || CAST(s_suppkey % 8 AS VARCHAR) AS station, unnest(['FRAN', r_name]) AS zone,
          abs(CAST(s_acctbal AS DECIMAL(18,2))) AS w
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY 1, 2""",
}


def with_parts(body: str, **extra: str) -> str:
    """Prefix ``body`` with the CTEs it uses, directly or through each other.

    ``extra`` adds CTEs of one query, in order.
    """
    pieces = {**PARTS, **extra}
    needed: list[str] = []
    open_names: set[str] = set()

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if word in pieces and word not in needed and word not in open_names:
                open_names.add(word)
                visit(pieces[word])
                needed.append(word)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({pieces[name]})" for name in needed) + "\n" + body


def final(columns: str, source: str, **extra: str) -> str:
    """Last SELECT: ``ts!`` as text, ``value~`` or ``value~8`` rounded, ``idx#`` as BIGINT."""
    chosen = []
    for word in columns.split():
        c, mark, digits = re.fullmatch(r"(\w+)([!~#]?)(\d*)", word).groups()
        form = {
            "": c,
            "!": f"CAST({c} AS VARCHAR) AS {c}",
            "~": f"{rounded(c, int(digits or 6))} AS {c}",
            "#": f"CAST({c} AS BIGINT) AS {c}",
        }
        chosen.append(form[mark])
    return with_parts(f"SELECT {', '.join(chosen)} FROM {source}", **extra)


def scores(source: str, keys: str) -> str:
    """The five metrics per key, rounded to 8 digits as the operator does."""
    return f"""SELECT {keys}, round(avg((target - prediction) ** 2), 8) AS mse, round(avg(abs(target - prediction)), 8) AS mae,
        round(1 - sum((target - prediction) ** 2) / (var_pop(target) * count(*)), 8) AS score,
        round(100 * avg(abs((target - prediction) / nullif(target, 0))), 8) AS mape,
        round(avg((target - prediction) ** 2) / (avg(target) ** 2), 8) AS nmse FROM {source} GROUP BY {keys}"""


PARTS["split_h"] = """SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'training' ELSE 'validation' END AS split
    FROM clean_h WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'"""
NAIVE_PARTS = {
    "naive": """SELECT site, split, ts, value AS target, prediction FROM (
        SELECT *, lag(value, 168) OVER (PARTITION BY site, split ORDER BY ts) AS prediction FROM split_h) WHERE prediction IS NOT NULL""",
    "naive_scores": scores("naive", "site, split"),
}
