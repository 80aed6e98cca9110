"""DuckDB SQL for the registered queries that SQL can express.

Written apart from the operators, with the plainest method that gives the
same rows: cross-checks by counting, ranking and closed forms.
"""

from __future__ import annotations

import math

from crashgrade.functions.hexgrid import BORDER_LAT, EARTH_RADIUS_M, edge_length
from crashgrade.operators.features import REGISTRY, SOURCE_REGISTRY
from crashgrade.sources.derived import ACCIDENT_ROADS, BASE_EDGE_M, ROAD_TYPES, STANDARD_LATS


def num(x: float) -> str:
    """A double literal; plain decimals would be exact decimals."""
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def h(salt: str, key: str) -> str:
    return f"cast(('0x' || substr(md5('{salt}-' || cast({key} AS varchar)), 1, 8)) AS bigint)"


def cell(res: int) -> str:
    """Cell id of lat, lon; q, r and s are repaired by the largest error."""
    edge = num(edge_length(res, BASE_EDGE_M))
    south, north = (math.cos(math.radians(at)) for at in STANDARD_LATS)
    side = f"CASE WHEN lat >= {num(BORDER_LAT)} THEN {{}} ELSE {{}} END"
    x = f"(radians(lon) * {side.format(num(EARTH_RADIUS_M * north), num(EARTH_RADIUS_M * south))})"
    y = f"(sin(radians(lat)) * {side.format(num(EARTH_RADIUS_M / north), num(EARTH_RADIUS_M / south))})"
    q = f"(({x} * {num(math.sqrt(3.0) / 3.0)} - {y} * {num(1.0 / 3.0)}) / {edge})"
    r = f"(({y} * {num(2.0 / 3.0)}) / {edge})"
    s = f"(-{q} - {r})"
    n = {k: f"floor({v} + 0.5e0)" for k, v in (("q", q), ("r", r), ("s", s))}
    d = {k: f"abs({n[k]} - {v})" for k, v in (("q", q), ("r", r), ("s", s))}
    worst_q = f"({d['q']} > {d['r']} AND {d['q']} > {d['s']})"
    cell_q = f"CASE WHEN {worst_q} THEN -{n['r']} - {n['s']} ELSE {n['q']} END"
    cell_r = (
        f"CASE WHEN NOT {worst_q} AND {d['r']} > {d['s']} THEN -{n['q']} - {n['s']} "
        f"ELSE {n['r']} END"
    )
    return (
        f"((cast({cell_q} AS bigint) + 1073741824) * 2147483648 "
        f"+ (cast({cell_r} AS bigint) + 1073741824) + {side.format(1 << 62, 0)})"
    )


CELLS = ", ".join(f"{cell(r)} AS cell_{r}" for r in (9, 10, 11))

TABLES = f"""
WITH road_features AS (
  SELECT o_custkey AS zone_id, l_orderkey AS feature_id, p_type AS road_type,
         l_quantity AS length_km, cast(p_size AS bigint) AS speed,
         CASE WHEN p_size > 40 THEN 'curve' WHEN p_size < 5 THEN 'signal'
              WHEN p_size = 10 THEN 'hospital' WHEN p_size IN (11, 12) THEN 'school'
              WHEN p_size IN (13, 14) THEN 'fuel' WHEN p_size = 20 THEN 'tunnel'
              ELSE 'plain' END AS kind, o_custkey % 4 + 1 AS lanes,
         -23.70e0 + ({h('flat', 'l_orderkey')} % 4000) * 0.0001e0 AS lat,
         -46.80e0 + ({h('flon', 'l_orderkey')} % 4000) * 0.0001e0 AS lon
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), zone_infra AS (
  SELECT zone_id, count(*) AS n_segments, sum(length_km) AS road_len,
         sum(CASE WHEN road_type = 'ECONOMY' THEN length_km ELSE 0e0 END) AS bridge_len,
         count(*) FILTER (road_type = 'ECONOMY') AS n_bridges,
         count(*) FILTER (kind = 'curve') AS n_curves,
         count(*) FILTER (kind = 'signal') AS n_signals,
         count(*) FILTER (kind = 'tunnel') AS n_tunnels,
         count(*) FILTER (kind = 'hospital') AS n_hospitals,
         count(*) FILTER (kind = 'school') AS n_schools,
         count(*) FILTER (kind = 'fuel') AS n_fuel,
         cast(sum(speed) AS double) / count(*) AS mean_speed,
         zone_id % 4 + 1 AS lanes
  FROM road_features GROUP BY zone_id
), weather AS (
  SELECT hr, grid_id, temp_c, temp_c - dew_gap / 10e0 AS dew_c, gust / 10e0 AS wind_ms, n_obs
  FROM (
    SELECT date_trunc('hour', ts) AS hr, user_id % 5 AS grid_id,
           cast(sum(cast(round(value * 100) AS bigint)) AS double) / count(*) / 100e0 - 20e0 AS temp_c,
           min({h('dew', 'event_id')} % 150) AS dew_gap,
           max({h('wind', 'event_id')} % 300) AS gust, count(*) AS n_obs
    FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
), located AS (
  SELECT event_id AS accident_id, zone_id, user_id % 5 AS grid_id, ts AS obs_ts,
         ts + to_days(cast((user_id % 12) * 30 AS int)) AS accident_ts, value AS precip,
         event_type AS road_type, cast(c_nationkey % 2 AS bigint) AS country_flag,
         n_segments, road_len, bridge_len, n_bridges, n_curves, n_signals, n_tunnels,
         n_hospitals, n_schools, n_fuel, mean_speed, lanes,
         {h('sev', 'event_id')} % 1000 AS h,
         -23.70e0 + ({h('lat', 'event_id')} % 4000) * 0.0001e0 AS lat,
         -46.80e0 + ({h('lon', 'event_id')} % 4000) * 0.0001e0 AS lon
  FROM events JOIN customer ON user_id = c_custkey JOIN zone_infra ON user_id = zone_id
), accidents AS (
  SELECT *, cast(h < score AS bigint) AS severe,
         CASE WHEN {h('split', 'accident_id')} % 1000 < 595 THEN 'train'
              WHEN {h('split', 'accident_id')} % 1000 < 700 THEN 'meta' ELSE 'test' END AS part
  FROM (
    SELECT *, precip * n_curves AS rain_x_curves, mean_speed * lanes AS speed_x_lanes,
           least(950, greatest(15, -360 + 2 * cast(floor(bridge_len) AS bigint) + 200 * rush_hour
             + 4 * cast(floor(precip) AS bigint)
             - CASE WHEN road_type = 'view' THEN 250 ELSE 0 END + 60 * country_flag)) AS score
    FROM (SELECT *, cast(hour(accident_ts) IN (7, 8, 9, 17, 18, 19) AS bigint) AS rush_hour
          FROM located))
), placed AS (SELECT *, {CELLS} FROM accidents
), roads AS (SELECT *, {CELLS} FROM road_features
), observed AS (
  SELECT p.*, w.temp_c, w.dew_c, w.wind_ms, w.n_obs
  FROM placed p LEFT JOIN weather w
    ON w.hr = date_trunc('hour', p.obs_ts) AND w.grid_id = p.grid_id
), consolidated AS (
  SELECT accident_id, accident_ts, lat, lon, country_flag,
         CASE WHEN country_flag = 1 THEN cast(CASE WHEN severe = 1 THEN 3 ELSE 1 END + h % 2 AS varchar)
              WHEN severe = 1 THEN CASE WHEN h % 2 = 0 THEN 'GRAVE' ELSE 'FATAL' END
              WHEN h % 2 = 0 THEN 'LEVE' ELSE 'MODERADO' END AS severity
  FROM accidents
), rules AS (
  SELECT accident_id, part, severe, 'rule' AS model, score / 1000e0 AS p FROM accidents
  UNION ALL
  SELECT accident_id, part, severe, 'rule_rain', least(precip, 200e0) / 200e0 FROM accidents
  UNION ALL
  SELECT accident_id, part, severe, 'rule_time', 0.25e0 + 0.5e0 * rush_hour FROM accidents
)
"""

BY_CELL = """
  SELECT cell_{res}, count(*) AS n_segments, sum(length_km) AS road_len,
         sum(CASE WHEN road_type = 'ECONOMY' THEN length_km ELSE 0e0 END) AS bridge_len,
         count(*) FILTER (road_type = 'ECONOMY') AS n_bridges,
         count(*) FILTER (kind = 'curve') AS n_curves,
         count(*) FILTER (kind = 'signal') AS n_signals,
         count(*) FILTER (kind = 'tunnel') AS n_tunnels,
         cast(sum(speed) AS double) / count(*) AS mean_speed
  FROM roads GROUP BY cell_{res}
"""

SURROUNDINGS = """
  SELECT *, cast(n_hospitals + n_schools + n_fuel >= 5 AS bigint) AS urban
  FROM (SELECT cell_9, count(*) FILTER (kind = 'hospital') AS n_hospitals,
               count(*) FILTER (kind = 'school') AS n_schools,
               count(*) FILTER (kind = 'fuel') AS n_fuel
        FROM roads GROUP BY cell_9)
"""

DOMINANT = """
  SELECT cell_10, road_type AS dominant, km AS dominant_km
  FROM (SELECT *, row_number() OVER (PARTITION BY cell_10 ORDER BY km DESC, road_type) AS place
        FROM (SELECT cell_10, road_type, sum(length_km) AS km FROM roads GROUP BY ALL))
  WHERE place = 1
"""


def flag(column: str, level: str, name: str) -> str:
    return f"cast(coalesce({column} = '{level}', false) AS bigint) AS {name}"


def other(column: str, levels: tuple[str, ...], name: str) -> str:
    names = ", ".join(f"'{level}'" for level in levels)
    return f"cast(NOT coalesce({column} IN ({names}), false) AS bigint) AS {name}"


ROAD_FLAGS = ", ".join(flag("road_type", r, f"road_{r}") for r in ACCIDENT_ROADS[1:])
TYPE_FLAGS = ", ".join(flag("dominant", t, f"dominant_{t.lower()}") for t in ROAD_TYPES[1:])
OTHERS = f"{other('road_type', ACCIDENT_ROADS, 'road_other')}, {other('dominant', ROAD_TYPES, 'dominant_other')}"

JOINED = f"""
, joined AS (
  SELECT o.accident_id, o.part, o.severe, o.temp_c, o.dew_c, o.precip, o.wind_ms, o.mean_speed,
         o.lanes, o.n_segments, o.road_len, o.n_curves, o.n_bridges, o.n_tunnels, o.n_signals,
         o.bridge_len, o.n_hospitals, o.n_schools, o.n_fuel, coalesce(s.urban, 0) AS urban,
         coalesce(c9.road_len, 0e0) AS hex9_road_len,
         coalesce(c10.road_len, 0e0) AS hex10_road_len,
         coalesce(c11.road_len, 0e0) AS hex11_road_len,
         coalesce(c9.n_curves, 0) AS hex9_n_curves,
         coalesce(c10.bridge_len, 0e0) AS hex10_bridge_len,
         {ROAD_FLAGS}, {TYPE_FLAGS}, {OTHERS},
         hour(accident_ts) AS hour, isodow(accident_ts) - 1 AS weekday,
         month(accident_ts) AS month, rush_hour, rain_x_curves,
         temp_c * (cast(o.n_curves AS double) / o.road_len) AS temp_x_curvature,
         speed_x_lanes, country_flag
  FROM observed o
  LEFT JOIN ({BY_CELL.format(res=9)}) c9 ON o.cell_9 = c9.cell_9
  LEFT JOIN ({BY_CELL.format(res=10)}) c10 ON o.cell_10 = c10.cell_10
  LEFT JOIN ({BY_CELL.format(res=11)}) c11 ON o.cell_11 = c11.cell_11
  LEFT JOIN ({DOMINANT}) d ON o.cell_10 = d.cell_10
  LEFT JOIN ({SURROUNDINGS}) s ON o.cell_9 = s.cell_9
)
"""


# The source path: weather from four corners, roads from the finest cell.
VARIABLES = ("temp_c", "dew_c", "wind_ms", "precip")
CORNERS = (("(1 - up) * (1 - rgt)", 0, 0), ("(1 - up) * rgt", 0, 1), ("up * (1 - rgt)", 1, 0), ("up * rgt", 1, 1))


def blended(v: str) -> str:
    """Weighted mean over the corners that are known."""
    top = " + ".join(f"coalesce(w{i}.{v} * ({w}), 0e0)" for i, (w, _, _) in enumerate(CORNERS))
    low = " + ".join(f"CASE WHEN w{i}.{v} IS NOT NULL THEN {w} ELSE 0e0 END" for i, (w, _, _) in enumerate(CORNERS))
    return f"CASE WHEN {low} > 0 THEN ({top}) / ({low}) END AS {v}"


CASES = f"""
, cases AS (
  SELECT CASE country_flag WHEN 1 THEN 'us' ELSE 'br' END || '-' || accident_id AS case_id,
         CASE country_flag WHEN 1 THEN 'us' ELSE 'br' END AS source, accident_id, accident_ts, lat, lon,
         country_flag, cast(severity IN ('GRAVE', 'FATAL', '3', '4') AS bigint) AS severe,
         accident_ts + to_hours(CASE country_flag WHEN 1 THEN 5 ELSE 3 END) AS utc_ts
  FROM consolidated
), hours AS (
  SELECT date_trunc('hour', accident_ts + to_hours(CASE country_flag WHEN 1 THEN 5 ELSE 3 END)) AS hr,
         cast(sum(cast(round(precip * 100) AS bigint)) AS double) / count(*) / 100e0 AS mean
  FROM accidents GROUP BY 1
), points AS (
  SELECT hr, mean, point, cast(epoch(hr) AS bigint) // 3600 * 12 + point AS k
  FROM hours, (SELECT unnest(range(12)) AS point)
), lattice AS (
  SELECT hr, point // 4 - 95 AS step_lat, point % 4 - 188 AS step_lon,
         mean - 20e0 + ({h('lt', 'k')} % 100) / 10e0 AS temp_c,
         mean - 20e0 + ({h('lt', 'k')} % 100) / 10e0 - ({h('ld', 'k')} % 150) / 10e0 AS dew_c,
         ({h('lw', 'k')} % 300) / 10e0 AS wind_ms,
         mean * ({h('lp', 'k')} % 21 + 90) / 100e0 AS precip
  FROM points WHERE {h('lm', 'k')} % 40 <> 0
), at_lattice AS (
  SELECT *, cast(floor(lat * 4) AS bigint) AS y, cast(floor(lon * 4) AS bigint) AS x,
         lat * 4 - floor(lat * 4) AS up, lon * 4 - floor(lon * 4) AS rgt, date_trunc('hour', utc_ts) AS hr
  FROM cases
), case_weather AS (
  SELECT case_id, {', '.join(blended(v) for v in VARIABLES)}
  FROM at_lattice a {' '.join(
      f"LEFT JOIN lattice w{i} ON w{i}.hr = a.hr AND w{i}.step_lat = a.y + {n} AND w{i}.step_lon = a.x + {e}"
      for i, (_, n, e) in enumerate(CORNERS))}
)
"""


def variables(res: int) -> str:
    return f"""SELECT cell_{res} AS cell, count(*) AS n_segments, sum(length_km) AS road_len,
         sum(CASE WHEN road_type = 'ECONOMY' THEN length_km ELSE 0e0 END) AS bridge_len,
         count(*) FILTER (road_type = 'ECONOMY') AS n_bridges,
         count(*) FILTER (kind = 'curve') AS n_curves, count(*) FILTER (kind = 'signal') AS n_signals,
         count(*) FILTER (kind = 'tunnel') AS n_tunnels, count(*) FILTER (kind = 'hospital') AS n_hospitals,
         count(*) FILTER (kind = 'school') AS n_schools, count(*) FILTER (kind = 'fuel') AS n_fuel,
         sum(length_km * speed) / sum(length_km) AS mean_speed, sum(length_km * lanes) / sum(length_km) AS lanes,
         cast(count(*) FILTER (kind IN ('hospital', 'school', 'fuel')) >= 5 AS bigint) AS urban
  FROM roads GROUP BY cell_{res}"""


AMOUNTS = ("n_segments", "road_len", "n_curves", "n_bridges", "n_tunnels", "n_signals", "bridge_len")


def finest(name: str, scaled: bool) -> str:
    cases = " ".join(
        f"WHEN c{r}.cell IS NOT NULL THEN " + (f"cast(c{r}.{name} AS double) / {7.0 ** (11 - r)}e0" if scaled else f"c{r}.{name}")
        for r in (11, 10, 9)
    )
    return f"CASE {cases} {'ELSE 0e0 ' if scaled else ''}END AS {name}"


SOURCE_NAMES = [f.name for f in SOURCE_REGISTRY]
FROM_WEATHER = (*VARIABLES, "rain_x_curves", "temp_x_curvature")
SOURCE_JOINED = CASES + f"""
, found AS (
  SELECT p.*, w.* EXCLUDE (case_id), {', '.join(finest(n, False) for n in ('mean_speed', 'lanes'))},
         {', '.join(finest(n, True) for n in AMOUNTS)},
         CASE WHEN c11.cell IS NOT NULL THEN 11 WHEN c10.cell IS NOT NULL THEN 10 WHEN c9.cell IS NOT NULL THEN 9 END
           AS road_res,
         {', '.join(f"coalesce(c9.{n}, 0) AS {n}" for n in ('n_hospitals', 'n_schools', 'n_fuel', 'urban'))},
         {', '.join(f"coalesce(c{r}.road_len, 0e0) AS hex{r}_road_len" for r in (9, 10, 11))},
         coalesce(c9.n_curves, 0) AS hex9_n_curves, coalesce(c10.bridge_len, 0e0) AS hex10_bridge_len, d.dominant
  FROM (SELECT *, {CELLS} FROM cases) p JOIN case_weather w USING (case_id)
  {' '.join(f"LEFT JOIN ({variables(r)}) c{r} ON c{r}.cell = p.cell_{r}" for r in (9, 10, 11))}
  LEFT JOIN ({DOMINANT}) d ON d.cell_10 = p.cell_10
), source_joined AS (
  SELECT *, CASE WHEN {h('split', 'case_id')} % 1000 < 595 THEN 'train'
                 WHEN {h('split', 'case_id')} % 1000 < 700 THEN 'meta' ELSE 'test' END AS part,
         {TYPE_FLAGS}, {other('dominant', ROAD_TYPES, 'dominant_other')},
         hour(accident_ts) AS hour, isodow(accident_ts) - 1 AS weekday, month(accident_ts) AS month,
         cast(hour(accident_ts) IN (7, 8, 9, 17, 18, 19) AS bigint) AS rush_hour,
         precip * n_curves AS rain_x_curves,
         temp_c * coalesce(n_curves / nullif(road_len, 0e0), 0e0) AS temp_x_curvature,
         mean_speed * lanes AS speed_x_lanes
  FROM found
)
"""


def tidy(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" if n in FROM_WEATHER else n for n in names)


def fences(cols: tuple[str, ...], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, q1 - 1.5e0 * (q3 - q1) AS lower, q3 + 1.5e0 * (q3 - q1) AS upper "
        f"FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source})"
        for c in cols
    )


def inside(cols: tuple[str, ...], source: str) -> str:
    checks = " AND ".join(
        f"({c} IS NULL OR {c} BETWEEN "
        f"(SELECT lower FROM fences WHERE feature = '{c}') AND "
        f"(SELECT upper FROM fences WHERE feature = '{c}'))"
        for c in cols
    )
    return f"SELECT * FROM {source} WHERE {checks}"


OUTLIERS = ("precip", "temp_c", "wind_ms")
FENCED = f", fences AS ({fences(OUTLIERS, 'joined')}), base AS ({inside(OUTLIERS, 'joined')})"

# Every cut counted on its own, without running sums.
SWEEP = """
  SELECT model, threshold, tp, fp, fn, n_unscored,
         CASE WHEN tp + fp = 0 THEN 0e0 ELSE cast(tp AS double) / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0e0 ELSE cast(tp AS double) / (tp + fn) END AS recall,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0
              ELSE cast(2 * tp AS double) / (2 * tp + fp + fn) END AS f1
  FROM (SELECT model, i / 100e0 AS threshold,
               count(*) FILTER (severe = 1 AND p >= i / 100e0) AS tp,
               count(*) FILTER (severe = 0 AND p >= i / 100e0) AS fp,
               count(*) FILTER (severe = 1 AND p < i / 100e0) AS fn,
               count(*) FILTER (p IS NULL) AS n_unscored
        FROM {source}, range(0, 101) AS cuts(i) GROUP BY model, i)
"""


def best(source: str) -> str:
    return f"""
  SELECT model, threshold, f1
  FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS place
        FROM ({SWEEP.format(source=source)})) WHERE place = 1
"""


CONFUSION = """
  SELECT model, count(*) FILTER (severe = 1 AND p >= {cut}) AS tp,
         count(*) FILTER (severe = 0 AND p >= {cut}) AS fp,
         count(*) FILTER (severe = 0 AND p < {cut}) AS tn,
         count(*) FILTER (severe = 1 AND p < {cut}) AS fn,
         count(*) FILTER (p IS NULL) AS n_unscored
  FROM {source} GROUP BY model
"""
AT_HALF = CONFUSION.format(cut="0.5e0", source="rules")

# Average ranks, doubled to stay whole.
AUC = """
  SELECT model, cast(sum(severe * (2 * low + ties + 1)) - n1 * (n1 + 1) AS double)
                / cast(2 * n1 * n0 AS double) AS auc, cast(0 AS bigint) AS n_unscored
  FROM (SELECT model, severe, rank() OVER (PARTITION BY model ORDER BY p) - 1 AS low,
               count(*) OVER (PARTITION BY model, p) AS ties,
               sum(severe) OVER (PARTITION BY model) AS n1,
               sum(1 - severe) OVER (PARTITION BY model) AS n0
        FROM {source})
  GROUP BY model, n1, n0
"""

POINTS = """
  SELECT model, i AS bin,
         count(*) FILTER (severe = 1 AND (i < 0 OR (i <= 100 AND p >= i / 100e0))) AS tp,
         count(*) FILTER (severe = 0 AND (i < 0 OR (i <= 100 AND p >= i / 100e0))) AS fp,
         sum(severe) AS all_pos, sum(1 - severe) AS all_neg
  FROM rules, range(-1, 102) AS cuts(i) GROUP BY model, i
"""


def compared(part: str) -> str:
    source = f"(SELECT * FROM rules WHERE part = '{part}')"
    cuts = best("(SELECT * FROM rules WHERE part = 'meta')")
    return f"""
  SELECT *, rank() OVER (ORDER BY auc DESC) AS auc_rank
  FROM (SELECT model, threshold, cast(tp + tn AS double) / (tp + fp + tn + fn) AS accuracy,
               (cast(tp AS double) / (tp + fn) + cast(tn AS double) / (tn + fp)) / 2e0
                 AS balanced_accuracy,
               cast(2 * tp AS double) / (2 * tp + fp + fn) AS f1, auc, n_unscored
        FROM ({CONFUSION.format(cut='cut', source=f'''(SELECT r.*, t.threshold AS cut
              FROM {source} r JOIN ({cuts}) t USING (model))''')})
        JOIN ({cuts.replace(', f1', '', 1)}) USING (model)
        JOIN (SELECT model, auc FROM ({AUC.format(source=source)})) USING (model))
"""


def gaps() -> str:
    metrics = ("accuracy", "balanced_accuracy", "f1", "auc")
    return " UNION ALL ".join(
        f"SELECT model, '{m}' AS metric, a.{m} AS on_meta, b.{m} AS on_test, a.{m} - b.{m} AS fall "
        f"FROM ({compared('meta')}) a JOIN ({compared('test')}) b USING (model)"
        for m in metrics
    )


def per_level(factors: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS factor, cast({expr} AS varchar) AS level, count(*) AS n_rows, "
        f"cast(sum(severe) AS double) / count(*) AS severe_share FROM accidents GROUP BY ALL"
        for name, expr in factors.items()
    )


def profiled(cols: tuple[str, ...]) -> str:
    picks = []
    for c in cols:
        for name, where in (("'all'", "true"), ("cast(severe AS varchar)", "true")):
            picks.append(
                f"SELECT {name} AS class, '{c}' AS feature, count({c}) AS n, "
                f"round(avg(cast({c} AS double)), 6) AS mean, "
                f"round(stddev_pop(cast({c} AS double)), 6) AS deviation, "
                f"min(cast({c} AS double)) AS lowest, max(cast({c} AS double)) AS highest, "
                f"round(quantile_cont(cast({c} AS double), 0.25), 6) AS q1, "
                f"round(quantile_cont(cast({c} AS double), 0.5), 6) AS median, "
                f"round(quantile_cont(cast({c} AS double), 0.75), 6) AS q3 "
                f"FROM joined WHERE {where} GROUP BY ALL"
            )
    return " UNION ALL ".join(picks)


SCALED = [f.name for f in REGISTRY if f.scaled]
SCALER = ", stats AS (SELECT " + ", ".join(
    f"avg(cast({c} AS double)) AS {c}_mean, stddev_pop(cast({c} AS double)) AS {c}_deviation" for c in SCALED
) + " FROM joined WHERE part = 'train')"


def vif3(a: str, b: str, c: str, tag: str = "") -> str:
    """Inflation of three columns, and of the pair left if the worst one goes."""
    r, det, vifs, worst, pairs, left, after = (
        f"{t}{tag}" for t in ("r", "det", "vifs", "worst", "pairs", "left_pair", "after")
    )
    return f"""
, {r} AS (SELECT corr({a}, {b}) AS ab, corr({a}, {c}) AS ac, corr({b}, {c}) AS bc FROM accidents)
, {det} AS (SELECT *, 1e0 + 2e0 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS d FROM {r})
, {vifs} AS (SELECT '{a}' AS feature, (1e0 - bc * bc) / d AS vif FROM {det}
           UNION ALL SELECT '{b}', (1e0 - ac * ac) / d FROM {det}
           UNION ALL SELECT '{c}', (1e0 - ab * ab) / d FROM {det})
, {worst} AS (SELECT feature, vif FROM {vifs} WHERE vif > 10e0 ORDER BY vif DESC LIMIT 1)
, {pairs} AS (SELECT '{a}' AS a, '{b}' AS b, ab AS c FROM {r}
            UNION ALL SELECT '{a}', '{c}', ac FROM {r}
            UNION ALL SELECT '{b}', '{c}', bc FROM {r})
, {left} AS (SELECT * FROM {pairs} WHERE EXISTS (SELECT 1 FROM {worst})
             AND a NOT IN (SELECT feature FROM {worst}) AND b NOT IN (SELECT feature FROM {worst}))
, {after} AS (SELECT a AS feature, 1e0 / (1e0 - c * c) AS vif FROM {left}
            UNION ALL SELECT b, 1e0 / (1e0 - c * c) FROM {left}
            UNION ALL SELECT feature, vif FROM {vifs} WHERE NOT EXISTS (SELECT 1 FROM {worst}))
"""


VIF3 = vif3("mean_speed", "lanes", "speed_x_lanes")
VERDICTS = VIF3 + vif3("precip", "n_curves", "rain_x_curves", "_rain") + """
, verdicts AS (SELECT feature, round(vif, 6) AS vif, accepted FROM (
    SELECT *, cast(0 AS bigint) AS accepted FROM worst UNION ALL SELECT *, 1 FROM after
    UNION ALL SELECT *, 0 FROM worst_rain UNION ALL SELECT *, 1 FROM after_rain)
  WHERE feature IN ('speed_x_lanes', 'rain_x_curves'))
"""
# Sums of the labels -1 and 1 on the four combinations of two flags; what a
# split removes is the sum of s * s / n below it, less that of the node.
TREE2 = """
, combos AS (SELECT bridge_len >= 200e0 AS a, precip >= 50e0 AS b, cast(count(*) AS double) AS n,
                    cast(sum(2 * severe - 1) AS double) AS s FROM accidents GROUP BY ALL)
, removed AS (SELECT (SELECT sum(s) * sum(s) / sum(n) FROM combos) AS whole,
    (SELECT sum(q) FROM (SELECT sum(s) * sum(s) / sum(n) AS q FROM combos GROUP BY a)) AS by_a,
    (SELECT sum(q) FROM (SELECT sum(s) * sum(s) / sum(n) AS q FROM combos GROUP BY b)) AS by_b,
    (SELECT sum(s * s / n) FROM combos) AS by_both)
, share AS (SELECT CASE WHEN by_a >= by_b THEN by_a - whole ELSE by_both - by_b END
                   / (by_both - whole) AS of_a FROM removed)
, importances AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS importance_rank
    FROM (SELECT 'bridge_len' AS feature, 'road' AS feature_group, round(of_a, 6) AS importance FROM share
          UNION ALL SELECT 'precip', 'climate', round(1e0 - of_a, 6) FROM share))
"""
# n<severe><flag>
COUNTS = ", counts AS (SELECT " + ", ".join(
    f"cast(count(*) FILTER (severe = {s} AND {{flag}} = {f}) AS double) AS n{s}{f}" for s in (0, 1) for f in (0, 1)
) + " FROM accidents)\n"


def verdict(number: int, statement: str, left: str, right: str, confirmed: str, source: str) -> str:
    return f"""SELECT cast({number} AS bigint) AS hypothesis, '{statement}' AS statement,
        cast({left} AS double) AS left_value, cast({right} AS double) AS right_value,
        cast({confirmed} AS bigint) AS confirmed FROM {source}"""

CORRELATED = ("precip", "bridge_len", "n_curves", "mean_speed", "lanes", "speed_x_lanes")

LDA2 = """
, m AS (SELECT severe, count(*) AS n, avg(precip) AS a, avg(bridge_len) AS b,
               var_pop(precip) AS va, var_pop(bridge_len) AS vb,
               covar_pop(precip, bridge_len) AS cab FROM accidents GROUP BY severe)
, g AS (SELECT sum(n * va) / (sum(n) - 2) AS va, sum(n * vb) / (sum(n) - 2) AS vb,
               sum(n * cab) / (sum(n) - 2) AS cab,
               max(a) FILTER (severe = 1) AS a1, max(a) FILTER (severe = 0) AS a0,
               max(b) FILTER (severe = 1) AS b1, max(b) FILTER (severe = 0) AS b0,
               max(n) FILTER (severe = 1) AS n1, max(n) FILTER (severe = 0) AS n0 FROM m)
, w AS (SELECT *, (vb * (a1 - a0) - cab * (b1 - b0)) / (va * vb - cab * cab) AS wa,
               (va * (b1 - b0) - cab * (a1 - a0)) / (va * vb - cab * cab) AS wb FROM g)
"""

SHAP = {"bridge_len": 2.0, "rush_hour": 200.0, "precip": 4.0, "country_flag": 60.0}
CONTRIBUTIONS = "SELECT accident_id, " + ", ".join(
    f"{num(w)} * (cast({c} AS double) - (SELECT avg(cast({c} AS double)) FROM accidents)) AS {c}"
    for c, w in SHAP.items()
) + " FROM accidents"


RULES = ("rule", "rule_rain", "rule_time")
PAIRS = [(a, b) for i, a in enumerate(RULES) for b in RULES[i + 1 :]]
# Placement values by running counts; the variance of a difference of AUCs is
# that of the differences of the placements.
PAIRED = f"""
, run AS (SELECT accident_id, severe, model,
    sum(1 - severe) OVER (PARTITION BY model ORDER BY p) AS neg_upto, sum(1 - severe) OVER (PARTITION BY model, p) AS neg_tied,
    sum(severe) OVER (PARTITION BY model ORDER BY p) AS pos_upto, sum(severe) OVER (PARTITION BY model, p) AS pos_tied,
    sum(severe) OVER (PARTITION BY model) AS n1, sum(1 - severe) OVER (PARTITION BY model) AS n0
    FROM rules WHERE part = 'test')
, placed_scores AS (SELECT accident_id, severe, {', '.join(
    f"max(v) FILTER (model = '{m}') AS {m}" for m in RULES)}
  FROM (SELECT *, CASE WHEN severe = 1 THEN (neg_upto - neg_tied / 2e0) / n0
                       ELSE (n1 - pos_upto + pos_tied / 2e0) / n1 END AS v FROM run)
  GROUP BY accident_id, severe)
, paired AS ({' UNION ALL '.join(
    f"""SELECT '{a}' AS model_a, '{b}' AS model_b, auc_a, auc_b, auc_a - auc_b AS difference, std_error,
          (auc_a - auc_b) / std_error AS z
        FROM (SELECT avg({a}) FILTER (severe = 1) AS auc_a, avg({b}) FILTER (severe = 1) AS auc_b,
                sqrt(var_samp({a} - {b}) FILTER (severe = 1) / count(*) FILTER (severe = 1)
                     + var_samp({a} - {b}) FILTER (severe = 0) / count(*) FILTER (severe = 0)) AS std_error
              FROM placed_scores)""" for a, b in PAIRS)})
"""


def local_effects(column: str, others: str, bins: int = 5) -> str:
    """Mean change of the planted score across each quantile bin of a column."""
    edges = ", ".join(f"quantile_cont({column}, {i / bins})" for i in range(bins + 1))
    low, high = (planted(**{column: f"e[bin{step}]"}) for step in ("", " + 1"))
    return f"""
  SELECT '{column}' AS feature, bin, low, high, n_rows, effect,
         upto - sum(n_rows * (upto - effect / 2e0)) OVER () / sum(n_rows) OVER () AS ale,
         CASE WHEN sum(effect) OVER () > 0 THEN 'raises' WHEN sum(effect) OVER () < 0 THEN 'lowers' ELSE 'neutral' END
           AS direction
  FROM (SELECT *, sum(effect) OVER (ORDER BY bin) AS upto FROM (
    SELECT bin, any_value(e[bin]) AS low, any_value(e[bin + 1]) AS high, count(*) AS n_rows,
           avg(cast({high} AS double) - cast({low} AS double)) AS effect
    FROM (SELECT {column}, {others}, e, greatest(1, len(list_filter(e, lambda x: x < {column}))) AS bin
          FROM accidents, (SELECT list_sort(list_distinct([{edges}])) AS e FROM accidents))
    GROUP BY bin))
"""


def rate_gap(name: str, condition: str) -> str:
    return f"""
  SELECT *, CASE WHEN share_with > share_without THEN 'raises'
                 WHEN share_with < share_without THEN 'lowers' ELSE 'neutral' END AS direction
  FROM (SELECT '{name}' AS feature,
          cast(count(*) FILTER ({condition} AND severe = 1) AS double) / count(*) FILTER ({condition})
            AS share_with,
          cast(count(*) FILTER (NOT ({condition}) AND severe = 1) AS double)
            / count(*) FILTER (NOT ({condition})) AS share_without
        FROM accidents)
"""


def planted(**moved: str) -> str:
    col = {c: moved.get(c, c) for c in SHAP}
    return (
        f"least(950, greatest(15, -360 + 2 * cast(floor({col['bridge_len']}) AS bigint) "
        f"+ 200 * {col['rush_hour']} + 4 * cast(floor({col['precip']}) AS bigint) "
        f"- CASE WHEN road_type = 'view' THEN 250 ELSE 0 END + 60 * {col['country_flag']}))"
    )


RING = f"""
, ringed AS (
  SELECT *, {', '.join(
      f"coalesce(lead({c}) OVER ring, first_value({c}) OVER ring) AS {c}_other" for c in SHAP)}
  FROM (SELECT *, {h('perm', 'accident_id')} AS place FROM accidents)
  WINDOW ring AS (ORDER BY place, accident_id)
), variants AS (
  SELECT '(none)' AS model, severe, {planted()} AS p FROM ringed
  {' '.join(f"UNION ALL SELECT '{c}', severe, {planted(**{c: c + '_other'})} FROM ringed" for c in SHAP)}
)
"""


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}

    # Derived tables, sources and sinks
    q["road_features"] = "SELECT * FROM road_features"
    q["zone_infra"] = "SELECT * FROM zone_infra"
    q["weather"] = "SELECT * REPLACE (cast(hr AS varchar) AS hr) FROM weather"
    q["accidents"] = """SELECT * EXCLUDE (part) REPLACE (cast(obs_ts AS varchar) AS obs_ts,
        cast(accident_ts AS varchar) AS accident_ts) FROM accidents"""
    q["read_accidents"] = """SELECT * REPLACE (cast(accident_ts AS varchar) AS accident_ts)
        FROM consolidated"""
    q["consolidate"] = q["read_accidents"]
    q["read_road_features"] = """SELECT road_type, kind, count(*) AS n_features,
        sum(length_km) AS length_km, cast(sum(speed) AS bigint) AS speed_sum, min(lat) AS south,
        max(lon) AS east FROM road_features GROUP BY ALL"""
    q["read_weather"] = q["weather"]
    q["clean_roundtrip"] = f""", fences AS ({fences(('precip', 'mean_speed'), 'accidents')})
        SELECT accident_id, cast(accident_ts AS varchar) AS accident_ts, precip, mean_speed,
               country_flag, severe FROM ({inside(('precip', 'mean_speed'), 'accidents')})"""
    q["features_roundtrip"] = VIF3 + """SELECT cast(row_number() OVER (ORDER BY place) - 1 AS bigint)
        AS position, feature, feature_group
        FROM (VALUES (1, 'mean_speed', 'road'), (2, 'lanes', 'road'),
                     (3, 'speed_x_lanes', 'interaction')) AS names(place, feature, feature_group)
        WHERE feature NOT IN (SELECT feature FROM worst)"""
    q["thresholds_roundtrip"] = best("(SELECT * FROM rules WHERE part = 'meta')")
    q["metrics_roundtrip"] = AT_HALF

    # Integration
    q["country_flag"] = "SELECT country_flag, count(*) AS n_rows FROM accidents GROUP BY 1"
    q["hex_cell"] = "SELECT accident_id, cell_9, cell_10, cell_11 FROM placed"
    q["infra_by_cell"] = BY_CELL.format(res=10)
    q["length_by_type"] = "SELECT cell_10, " + ", ".join(
        f"sum(CASE WHEN road_type = '{t}' THEN length_km ELSE 0e0 END) AS len_{t.lower()}"
        for t in ROAD_TYPES
    ) + ", sum(CASE WHEN road_type IN (" + ", ".join(f"'{t}'" for t in ROAD_TYPES) + (
        ") THEN 0e0 ELSE length_km END) AS len_other FROM roads GROUP BY cell_10"
    )
    q["dominant_type"] = DOMINANT
    q["surroundings"] = SURROUNDINGS
    q["cell_statistics"] = " UNION ALL ".join(
        f"""SELECT i.* EXCLUDE (cell_{r}), cell_{r} AS cell,
        cast({r} AS bigint) AS res, n_hospitals, n_schools, n_fuel,
        cast(n_hospitals + n_schools + n_fuel >= 5 AS bigint) AS urban, dominant
        FROM ({BY_CELL.format(res=r)}) i
        JOIN ({SURROUNDINGS.replace('cell_9', f'cell_{r}')}) s USING (cell_{r})
        JOIN ({DOMINANT.replace('cell_10', f'cell_{r}')}) d USING (cell_{r})"""
        for r in (9, 10, 11)
    )
    q["attach_infra"] = "SELECT accident_id, " + ", ".join(
        f"coalesce(c{r}.n_segments, 0) AS hex{r}_n_segments, "
        f"coalesce(c{r}.road_len, 0e0) AS hex{r}_road_len, "
        f"coalesce(c{r}.mean_speed, 0e0) AS hex{r}_mean_speed" for r in (9, 10, 11)
    ) + " FROM placed p " + " ".join(
        f"LEFT JOIN ({BY_CELL.format(res=r)}) c{r} ON p.cell_{r} = c{r}.cell_{r}"
        for r in (9, 10, 11)
    )
    q["attach_weather"] = "SELECT accident_id, grid_id, temp_c, dew_c, wind_ms, n_obs FROM observed"
    q["joined_features"] = JOINED + "SELECT * FROM joined"

    # The source path
    q["audit_accidents"] = """SELECT source, outcome, count(*) AS n_rows FROM (
        SELECT CASE country_flag WHEN 1 THEN 'us' ELSE 'br' END AS source,
               CASE WHEN country_flag = 1 THEN 'accepted' ELSE coalesce(['short_line', 'bad_value',
                 'unknown_severity', 'no_id', 'no_place'][accident_id % 50 + 1], 'accepted') END AS outcome
        FROM accidents) GROUP BY ALL"""
    q["source_cases"] = CASES + """SELECT * EXCLUDE (utc_ts) REPLACE (cast(accident_ts AS varchar)
        AS accident_ts) FROM cases"""
    q["lattice_weather"] = CASES + f"""SELECT cast(hr AS varchar) AS hr, step_lat, step_lon,
        {tidy(VARIABLES)} FROM lattice"""
    q["weather_at_place"] = CASES + f"SELECT case_id, {tidy(VARIABLES)} FROM case_weather"
    q["cell_variables"] = " UNION ALL ".join(
        f"""SELECT cast({r} AS bigint) AS res, c.*, dominant FROM ({variables(r)}) c
        JOIN ({DOMINANT.replace('cell_10', f'cell_{r}')}) d ON d.cell_{r} = c.cell"""
        for r in (9, 10, 11)
    )
    q["road_variables"] = SOURCE_JOINED + "SELECT case_id, cast(road_res AS bigint) AS road_res, " + ", ".join(
        f.name for f in SOURCE_REGISTRY if f.group == "road") + " FROM source_joined"
    q["source_features"] = SOURCE_JOINED + f"SELECT case_id, part, severe, {tidy(SOURCE_NAMES)} FROM source_joined"
    q["source_split_audit"] = SOURCE_JOINED + """SELECT part, count(*) AS n_rows,
        count(DISTINCT case_id) AS n_keys, cast(0 AS bigint) AS torn_keys,
        cast(count(*) AS double) / (SELECT count(*) FROM source_joined) AS share,
        cast(sum(severe) AS double) / count(*) AS severe_share FROM source_joined GROUP BY part"""

    # Cleaning and exploration
    q["outlier_bounds"] = JOINED + FENCED + "SELECT * FROM fences"
    q["outlier_bounds_sketch"] = "SELECT unnest([" + ", ".join(f"'{c}'" for c in OUTLIERS) + (
        "]) AS feature, cast(1 AS bigint) AS q1_near, cast(1 AS bigint) AS q3_near")
    q["remove_outliers"] = JOINED + FENCED + "SELECT accident_id, precip, temp_c, wind_ms FROM base"
    q["binarise_severity"] = """SELECT accident_id, severity,
        cast(severity IN ('GRAVE', 'FATAL', '3', '4') AS bigint) AS severe FROM consolidated"""
    q["drop_leaky"] = """SELECT * EXCLUDE (lat, lon, obs_ts, accident_ts, h, score, part)
        FROM accidents"""
    q["class_balance"] = """SELECT severe, count(*) AS n_rows,
        cast(count(*) AS double) / (SELECT count(*) FROM accidents) AS share
        FROM accidents GROUP BY severe"""
    q["row_funnel"] = JOINED + FENCED + """SELECT 'raw' AS step, count(*) AS n_rows FROM joined
        UNION ALL SELECT 'clean', count(*) FROM base
        UNION ALL SELECT part, count(*) FROM base GROUP BY part"""
    q["select_features"] = JOINED + """SELECT accident_id, severe, precip AS climate__precip,
        bridge_len AS road__bridge_len, n_hospitals AS surroundings__n_hospitals,
        month AS time__month, rain_x_curves AS interaction__rain_x_curves,
        country_flag AS country__country_flag FROM joined"""
    q["profile"] = JOINED + profiled(("temp_c", "precip", "bridge_len", "mean_speed"))
    q["severity_rate_by"] = per_level({
        "hour": "hour(accident_ts)", "weekday": "isodow(accident_ts) - 1",
        "month": "month(accident_ts)", "rush_hour": "rush_hour", "road_type": "road_type",
        "country": "country_flag",
    })
    q["rush_hour_severity"] = per_level({"rush_hour": "rush_hour"})
    q["histogram"] = """SELECT cast(CASE WHEN precip < 0e0 THEN 0 WHEN precip >= 200e0 THEN 21
        ELSE floor(20e0 * (precip - 0e0) / 200e0) + 1 END AS bigint) AS bin, severe,
        count(*) AS n_rows FROM accidents GROUP BY ALL"""

    # Features
    q["hour_of_day"] = "SELECT accident_id, hour(accident_ts) AS hour FROM accidents"
    q["day_of_week"] = "SELECT accident_id, isodow(accident_ts) - 1 AS weekday FROM accidents"
    q["month"] = "SELECT accident_id, month(accident_ts) AS month FROM accidents"
    q["rush_hour"] = "SELECT accident_id, rush_hour AS rush FROM accidents"
    q["rain_x_curves"] = "SELECT accident_id, precip * n_curves AS value FROM accidents"
    q["temp_x_curvature"] = """SELECT accident_id,
        temp_c * (cast(n_curves AS double) / road_len) AS value FROM observed"""
    q["speed_x_lanes"] = "SELECT accident_id, mean_speed * lanes AS value FROM accidents"
    q["climate_features"] = JOINED + "SELECT accident_id, temp_c, dew_c, precip, wind_ms FROM joined"
    q["road_group_features"] = """SELECT accident_id, mean_speed, lanes, n_segments, road_len,
        n_curves, n_bridges, n_tunnels, n_signals, bridge_len FROM accidents"""
    q["one_hot"] = "SELECT accident_id, " + ", ".join(
        flag("road_type", r, f"is_{r}") for r in ACCIDENT_ROADS
    ) + ", " + other("road_type", ACCIDENT_ROADS, "is_other") + " FROM accidents"
    q["fit_scaler"] = JOINED + SCALER + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round({c}_mean, 6) AS mean, round({c}_deviation, 6) AS deviation FROM stats"
        for c in SCALED)
    q["apply_scaler"] = JOINED + SCALER + "SELECT accident_id, part, " + ", ".join(
        f"round(coalesce(({c} - {c}_mean) / nullif({c}_deviation, 0e0), 0e0), 6) + 0e0 AS {c}"
        for c in SCALED) + " FROM joined, stats"

    # Collinearity and split
    q["corr_matrix"] = " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
        f"round(corr({a}, {b}), 6) AS correlation FROM accidents"
        for a in CORRELATED for b in CORRELATED)
    q["vif"] = VIF3 + "SELECT feature, round(vif, 6) AS vif FROM vifs"
    q["vif_stepwise"] = VIF3 + """SELECT feature, cast(1 AS bigint) AS step, round(vif, 6) AS vif,
        cast(0 AS bigint) AS kept FROM worst
        UNION ALL SELECT feature, NULL, round(vif, 6), 1 FROM after"""
    q["interaction_verdict_three"] = VERDICTS + "SELECT * FROM verdicts"
    q["split3"] = "SELECT accident_id, part FROM accidents"
    q["split_audit"] = """SELECT part, count(*) AS n_rows, count(DISTINCT accident_id) AS n_keys,
        count(DISTINCT accident_id) FILTER (accident_id IN (SELECT accident_id FROM accidents
          GROUP BY 1 HAVING count(DISTINCT part) > 1)) AS torn_keys,
        cast(count(*) AS double) / (SELECT count(*) FROM accidents) AS share,
        cast(sum(severe) AS double) / count(*) AS severe_share FROM accidents GROUP BY part"""

    # Models in closed form
    q["fit_logistic_one_flag"] = """, odds AS (SELECT
          ln(cast(count(*) FILTER (severe = 1 AND rush_hour = 0) AS double)
             / count(*) FILTER (severe = 0 AND rush_hour = 0)) AS without,
          ln(cast(count(*) FILTER (severe = 1 AND rush_hour = 1) AS double)
             / count(*) FILTER (severe = 0 AND rush_hour = 1)) AS during FROM accidents)
        SELECT '(intercept)' AS feature, round(without, 4) AS coefficient FROM odds
        UNION ALL SELECT 'rush_hour', round(during - without, 4) FROM odds"""
    q["wald_one_flag"] = COUNTS.format(flag="rush_hour") + """SELECT 'rush_hour' AS feature,
        round(ln(n11 / n01 * n00 / n10), 4) AS coefficient,
        round(sqrt(1e0 / n00 + 1e0 / n01 + 1e0 / n10 + 1e0 / n11), 4) AS std_error FROM counts
        UNION ALL SELECT '(intercept)', round(ln(n10 / n00), 4), round(sqrt(1e0 / n00 + 1e0 / n10), 4) FROM counts"""
    q["fit_mlp_early_stop_one_flag"] = f"""SELECT rush_hour, any_value(n) AS n_rows, {{share}} AS lowest, {{share}} AS highest
        FROM (SELECT *, count(*) OVER (PARTITION BY rush_hour) AS n FROM accidents)
        WHERE {h('valid', 'accident_id')} % 1000 >= 100 GROUP BY rush_hour""".format(
        share="round(cast(sum(severe) AS double) / count(*), 2)")
    per_flag = """SELECT rush_hour, count(*) AS n_rows, round({p}, 6) AS lowest,
        round({p}, 6) AS highest FROM accidents GROUP BY rush_hour"""
    weight = "(SELECT cast(sum(1 - severe) AS double) / sum(severe) FROM accidents)"
    q["fit_forest_one_flag"] = per_flag.format(
        p=f"sum(severe) * {weight} / (sum(severe) * {weight} + sum(1 - severe))"
    )
    q["fit_boosted_one_flag"] = per_flag.format(
        p="1e0 / (1e0 + exp(-2e0 * (cast(sum(2 * severe - 1) AS double) / count(*))))"
    )
    share = "round(cast(sum(severe) AS double) / count(*), 2)"
    q["fit_mlp_one_flag"] = f"""SELECT rush_hour, count(*) AS n_rows, {share} AS lowest,
        {share} AS highest FROM accidents GROUP BY rush_hour"""
    q["base_scores_one_flag"] = f""", levels AS (SELECT rush_hour,
          round(cast(sum(severe) AS double) / count(*), 4) AS logistic,
          round(sum(severe) * {weight} / (sum(severe) * {weight} + sum(1 - severe)), 4) AS forest,
          round(1e0 / (1e0 + exp(-2e0 * (cast(sum(2 * severe - 1) AS double) / count(*)))), 4) AS boosted
          FROM accidents GROUP BY rush_hour)
        SELECT accident_id, severe, logistic, forest, boosted FROM accidents JOIN levels USING (rush_hour)"""
    def scored_one_flag(key: str, source: str) -> str:
        return f""", levels AS (SELECT rush_hour,
          cast(sum(severe) FILTER (part = 'train') AS double) / count(*) FILTER (part = 'train') AS logistic,
          cast(sum(severe) FILTER (part = 'meta') AS double) / count(*) FILTER (part = 'meta') AS stack
          FROM {source} GROUP BY rush_hour)
        , stacked AS (SELECT {key}, part, severe, logistic, 'stack' AS model, stack AS p
                      FROM {source} JOIN levels USING (rush_hour))
        , cut AS ({best("(SELECT * FROM stacked WHERE part = 'meta')")})
        SELECT {key}, round(logistic, 4) AS logistic, round(p, 4) AS stack,
               cast(p >= threshold AS bigint) AS predicted FROM stacked, cut"""

    q["score_one_flag"] = scored_one_flag("accident_id", "accidents")
    q["score_accidents_one_flag"] = SOURCE_JOINED + scored_one_flag("case_id", "source_joined")
    q["fit_stack_one_score"] = """, odds AS (SELECT p,
          ln(cast(sum(severe) AS double) / sum(1 - severe)) AS logit
          FROM rules WHERE part = 'meta' AND model = 'rule_time' GROUP BY p),
        slope AS (SELECT (max(logit) FILTER (p = 0.75e0) - max(logit) FILTER (p = 0.25e0)) / 0.5e0
          AS weight FROM odds)
        SELECT 'rule_time' AS model, round(weight, 4) AS weight,
               CASE WHEN weight > 0 THEN 'positive' ELSE 'negative' END AS sign,
               cast(1 AS bigint) AS weight_rank FROM slope"""
    q["lda_scores"] = LDA2 + """SELECT accident_id, round(1e0 / (1e0 + exp(-(
          ln(cast(n1 AS double) / n0) - 0.5e0 * ((a1 + a0) * wa + (b1 + b0) * wb)
          + wa * precip + wb * bridge_len))), 6) AS p FROM accidents, w"""
    q["model_roundtrip"] = JOINED + FENCED + """SELECT model, count(*) AS n_rows, 0e0 AS max_gap
        FROM base, (VALUES ('logistic'), ('lda'), ('forest'), ('mlp'), ('boosted'), ('stack'))
          AS names(model) GROUP BY model"""
    q["fit_lda"] = LDA2 + """SELECT 'precip' AS feature, round(wa, 6) AS coefficient FROM w
        UNION ALL SELECT 'bridge_len', round(wb, 6) FROM w
        UNION ALL SELECT '(intercept)', round(ln(cast(n1 AS double) / n0)
          - 0.5e0 * ((a1 + a0) * wa + (b1 + b0) * wb), 6) FROM w"""
    q["class_weights"] = """SELECT *, cast(n_negative AS double) / n_positive AS positive_weight
        FROM (SELECT count(*) FILTER (severe = 0) AS n_negative,
                     count(*) FILTER (severe = 1) AS n_positive
              FROM accidents WHERE part = 'train')"""
    q["risk_hotspots"] = """SELECT cell_9, hour(accident_ts) AS hour, count(*) AS n_rows,
        cast(sum(score) AS double) / count(*) AS mean_risk FROM placed GROUP BY ALL
        ORDER BY mean_risk DESC, cell_9, hour LIMIT 25"""

    # Thresholds
    q["threshold_sweep"] = SWEEP.format(source="rules")
    q["best_threshold"] = best("rules")
    q["tune_all"] = q["thresholds_roundtrip"]
    q["apply_threshold"] = """SELECT accident_id, severe, model, p,
        cast(p >= 0.3e0 AS bigint) AS predicted FROM rules WHERE model = 'rule'"""
    test = "(SELECT * FROM rules WHERE part = 'test')"
    cut = f"(SELECT r.*, threshold FROM {test} r JOIN ({q['tune_all']}) t USING (model))"
    half, own = (
        f"""SELECT model, threshold, cast(2 * count(*) FILTER (severe = 1 AND p >= {at}) AS double)
              / (count(*) FILTER (severe = 1) + count(*) FILTER (p >= {at})) AS f1
            FROM {cut} GROUP BY model, threshold"""
        for at in ("0.5e0", "threshold")
    )
    q["threshold_gain"] = f"""SELECT model, own.threshold, half.f1 AS f1_at_half, own.f1 AS f1_at_cut,
        (own.f1 - half.f1) * 100e0 AS gain_points, cast(0 AS bigint) AS n_unscored FROM ({own}) own JOIN ({half}) half USING (model)"""

    # Evaluation
    q["confusion"] = AT_HALF
    q["accuracy"] = f"""SELECT model, cast(tp + tn AS double) / (tp + fp + tn + fn) AS accuracy
        FROM ({AT_HALF})"""
    q["balanced_accuracy"] = f"""SELECT model, (cast(tp AS double) / (tp + fn)
        + cast(tn AS double) / (tn + fp)) / 2e0 AS balanced_accuracy FROM ({AT_HALF})"""
    q["prf_severe"] = f"""SELECT model,
        CASE WHEN tp + fp = 0 THEN 0e0 ELSE cast(tp AS double) / (tp + fp) END AS precision,
        cast(tp AS double) / (tp + fn) AS recall,
        cast(2 * tp AS double) / (2 * tp + fp + fn) AS f1 FROM ({AT_HALF})"""
    q["matthews"] = f"""SELECT model, round(coalesce(
        (cast(tp AS double) * tn - cast(fp AS double) * fn)
        / nullif(sqrt(cast(tp + fp AS double) * (tp + fn)) * sqrt(cast(tn + fp AS double) * (tn + fn)),
                 0e0), 0e0), 6) AS matthews FROM ({AT_HALF})"""
    q["roc_auc"] = AUC.format(source="rules")
    q["paired_auc_rules"] = PAIRED + "SELECT model_a, model_b, " + ", ".join(
        f"round({c}, 7) AS {c}" for c in ("auc_a", "auc_b", "difference", "std_error", "z")) + " FROM paired"
    q["roc_points"] = f"""SELECT model, bin, cast(fp AS double) / all_neg AS false_positive_rate,
        cast(tp AS double) / all_pos AS true_positive_rate FROM ({POINTS})"""
    q["pr_points"] = f"""SELECT model, bin, cast(tp AS double) / nullif(tp + fp, 0) AS precision,
        cast(tp AS double) / all_pos AS recall FROM ({POINTS})"""
    q["max_chance"] = """SELECT cast(max(n) AS double) / sum(n) AS max_chance
        FROM (SELECT count(*) AS n FROM accidents GROUP BY severe)"""
    q["proportional_chance"] = f"""SELECT model, accuracy, pcc, pcc * 1.25e0 AS bar,
        cast(accuracy > pcc * 1.25e0 AS bigint) AS passes
        FROM ({q['accuracy']}), (SELECT cast(sum(n * n) AS double) / cast(sum(n) * sum(n) AS double)
          AS pcc FROM (SELECT count(*) AS n FROM accidents GROUP BY severe))"""
    q["compare_rules"] = compared("test")
    q["overfit_gap"] = gaps()

    # Explanation
    q["permutation_importance"] = RING + f"""SELECT model AS feature, auc,
        (SELECT auc FROM ({AUC.format(source='variants')}) WHERE model = '(none)') - auc AS auc_loss
        FROM ({AUC.format(source='variants')})"""
    q["linear_shap"] = "SELECT accident_id, " + ", ".join(
        f"round({c}, 6) AS {c}" for c in SHAP) + f" FROM ({CONTRIBUTIONS})"
    q["shap_summary"] = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(abs({c})), 6) AS mean_abs FROM ({CONTRIBUTIONS})"
        for c in SHAP)
    q["accumulated_effects"] = f"""SELECT feature, cast(bin AS bigint) AS bin, round(low, 6) AS low,
        round(high, 6) AS high, n_rows, round(effect, 6) AS effect, round(ale, 6) AS ale, direction
        FROM ({local_effects('bridge_len', 'rush_hour, precip, road_type, country_flag')} UNION ALL
              {local_effects('precip', 'rush_hour, bridge_len, road_type, country_flag')})"""
    q["effect_direction"] = " UNION ALL ".join(
        [rate_gap("rush_hour", "rush_hour = 1"), rate_gap("country_flag", "country_flag = 1")]
        + [rate_gap(f"road_{r}", f"road_type = '{r}'") for r in ACCIDENT_ROADS])

    q["tree_importance_two_flags"] = TREE2 + """SELECT feature, importance, importance_rank
        FROM importances"""
    q["group_importance_two_flags"] = TREE2 + """SELECT feature_group, importance,
        cast(1 AS bigint) AS n_features FROM importances"""
    q["project_2d_two_columns"] = """, z AS (SELECT accident_id,
          (bridge_len - (SELECT avg(bridge_len) FROM accidents))
            / (SELECT stddev_pop(bridge_len) FROM accidents) AS a,
          (road_len - (SELECT avg(road_len) FROM accidents))
            / (SELECT stddev_pop(road_len) FROM accidents) AS b FROM accidents)
        , points AS (SELECT accident_id, abs(a + b) / sqrt(2e0) AS along, abs(a - b) / sqrt(2e0) AS across,
                            (SELECT corr(a, b) FROM z) > 0 AS same FROM z)
        SELECT accident_id, round(CASE WHEN same THEN along ELSE across END, 5) AS x,
               round(CASE WHEN same THEN across ELSE along END, 5) AS y FROM points"""

    # Hypotheses
    cast = PAIRED + f""", cast_rules AS (SELECT * FROM ({compared('test')}))
        , led AS (SELECT model_a AS better, model_b AS worse, z FROM paired
                  UNION ALL SELECT model_b, model_a, -z FROM paired)"""

    def leads(better: str, worse: str) -> str:
        return f"coalesce((SELECT max(z) FROM led WHERE better = '{better}' AND worse = '{worse}') >= 1.96e0, false)"

    def of(model: str, metric: str) -> str:
        return f"max({metric}) FILTER (model = '{model}')"

    singles = "greatest({0}, {1})"
    best_auc = singles.format(of("rule", "auc"), of("rule_rain", "auc"))
    best_f1 = singles.format(of("rule", "f1"), of("rule_rain", "f1"))
    wald = "(abs(ln(n11 / n01 * n00 / n10)) / sqrt(1e0 / n00 + 1e0 / n01 + 1e0 / n10 + 1e0 / n11))"
    answers = {
        "hyp_road_over_climate_two_flags": (TREE2, verdict(
            1, "road importance exceeds climate importance",
            "max(importance) FILTER (feature_group = 'road')",
            "max(importance) FILTER (feature_group = 'climate')",
            "max(importance) FILTER (feature_group = 'road') > max(importance) FILTER (feature_group = 'climate')",
            "importances")),
        "hyp_interactions_three": (VERDICTS, verdict(
            2, "climate and road interactions pass the VIF limit", "sum(accepted)", "count(*)",
            "sum(accepted) = count(*)", "verdicts WHERE feature = 'rain_x_curves'")),
        "hyp_country_one_flag": (COUNTS.format(flag="country_flag"), verdict(
            3, "country is a control with an effect of its own", f"round({wald}, 4)", "1.96e0",
            f"{wald} >= 1.96e0", "counts")),
        "hyp_nonlinear_rules": (cast, verdict(
            4, "non-linear models exceed linear ones in AUC", of("rule", "auc"), of("rule_rain", "auc"),
            f"{of('rule', 'auc')} > {of('rule_rain', 'auc')} AND {leads('rule', 'rule_rain')}", "cast_rules")),
        "hyp_stack_rules": (cast, verdict(
            5, "the stack exceeds every single model in AUC and F1", of("rule_time", "auc"), best_auc,
            f"""{of('rule_time', 'auc')} > {best_auc} AND {of('rule_time', 'f1')} > {best_f1}
               AND CASE WHEN {of('rule', 'auc')} > {of('rule_rain', 'auc')} THEN {leads('rule_time', 'rule')}
                        ELSE {leads('rule_time', 'rule_rain')} END""", "cast_rules")),
    }
    for name, (tables, body) in answers.items():
        q[name] = tables + body
    q["hypothesis_report_rules"] = TREE2 + VERDICTS + COUNTS.format(flag="country_flag") + cast + " UNION ALL ".join(
        body for _, body in answers.values()
    )
    q["hyp_country"] = """SELECT country_flag, count(*) AS n_rows,
        cast(sum(severe) AS double) / count(*) AS severe_share FROM accidents GROUP BY country_flag"""

    return {name: TABLES + body for name, body in q.items()}
