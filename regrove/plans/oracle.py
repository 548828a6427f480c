"""ANSI SQL twins of the registered queries, for a result check in another engine."""

from __future__ import annotations

import math
import random

from regrove.catalog import FEATURE_GROUPS, FEATURES
from regrove.operators.explore import LEAK_THRESHOLD
from regrove.operators.features import COMPLEXITY_WEIGHTS, DISTANCE_CUTS, RUSH_HOURS, SPEED_CUTS

Y = "target_energy_consumption"
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, price_cents"

TRIPS = """
trips AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents,
    CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS DayNum,
    l_suppkey AS VehId, l_orderkey AS Trip,
    l_extendedprice AS target_energy_consumption,
    CAST(l_shipdate AS DATE) AS trip_date,
    epoch_ms(l_shipdate) AS start_timestamp_ms,
    l_shipdate AS feature_timestamp,
    l_quantity AS distance_km,
    o_totalprice / 1000 AS duration_minutes,
    CASE WHEN l_discount = 0 THEN NULL ELSE l_discount * 1000 END AS avg_speed_kmh,
    l_discount * 1000 + l_tax * 100 AS max_speed_kmh,
    c_acctbal AS avg_battery_soc,
    c_acctbal - l_discount * 1000 AS min_battery_soc,
    c_acctbal + l_tax * 1000 AS max_battery_soc,
    s_acctbal AS avg_elevation_m,
    CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax * 100 END AS elevation_gain_m,
    s_nationkey AS origin_nation, c_nationkey AS dest_nation,
    s_acctbal / CAST(173.21 AS DOUBLE) AS origin_lat, s_nationkey * CAST(13.3 AS DOUBLE) - 160 AS origin_lon,
    c_acctbal / CAST(173.21 AS DOUBLE) AS dest_lat, c_nationkey * CAST(13.3 AS DOUBLE) - 160 AS dest_lon,
    l_quantity * 3 + l_discount * 100
      + CAST((l_orderkey * 31 + l_partkey * 17) % 101 AS DOUBLE) / 1010 AS planted_target
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
)"""

HOURS = ", ".join(str(h) for h in RUSH_HOURS)


def r(expression: str, digits: int = 4) -> str:
    """Rounded, with negative zero made positive."""
    return f"(round({expression}, {digits}) + 0.0)"


def _parts(ts: str) -> str:
    return f"""
    CAST(year({ts}) AS INTEGER) AS trip_year, CAST(month({ts}) AS INTEGER) AS trip_month,
    CAST(dayofweek({ts}) + 1 AS INTEGER) AS trip_dayofweek, CAST(hour({ts}) AS INTEGER) AS trip_hour"""


PATTERNS = f"""
    CASE WHEN trip_hour IN ({HOURS}) THEN 1 ELSE 0 END AS is_rush_hour,
    CASE WHEN trip_dayofweek IN (1, 7) THEN 1 ELSE 0 END AS is_weekend,
    sin(trip_hour * (2 * pi() / 24)) AS hour_sin, cos(trip_hour * (2 * pi() / 24)) AS hour_cos"""


def _code(value: str, cuts: tuple[float, ...]) -> str:
    whens = " ".join(f"WHEN {value} < {c} THEN {i}" for i, c in enumerate(cuts))
    return f"CASE WHEN {value} IS NULL THEN NULL {whens} ELSE {len(cuts)} END"


ROUNDED = """
    round_even(origin_lat, 2) AS origin_lat_rounded, round_even(origin_lon, 2) AS origin_lon_rounded,
    round_even(dest_lat, 2) AS dest_lat_rounded, round_even(dest_lon, 2) AS dest_lon_rounded"""
INTERACTION = """
    distance_km * elevation_gain_m AS distance_elevation_interaction,
    avg_speed_kmh * avg_speed_kmh AS speed_squared,
    avg_speed_kmh / nullif(distance_km, 0) AS speed_per_distance,
    duration_minutes / nullif(distance_km, 0) AS duration_per_distance,
    max_speed_kmh - avg_speed_kmh AS speed_variability"""
RATIO = """
    elevation_gain_m / nullif(distance_km, 0) AS elevation_gradient,
    distance_km / nullif(duration_minutes / 60, 0) AS actual_speed_efficiency,
    avg_speed_kmh / nullif(max_speed_kmh, 0) AS speed_efficiency_ratio,
    elevation_gain_m / nullif(duration_minutes, 0) AS elevation_per_minute"""
SCORE = "0.0 + " + " + ".join(f"{c} * CAST({w} AS DOUBLE)" for c, w in COMPLEXITY_WEIGHTS.items()) + " AS trip_complexity_score"
BATTERY = """
    max_battery_soc - min_battery_soc AS battery_soc_range,
    (max_battery_soc - min_battery_soc) / nullif(duration_minutes, 0) AS battery_usage_rate,
    target_energy_consumption / nullif(distance_km, 0) AS energy_per_km"""
CODES = f"""
    {_code("distance_km", DISTANCE_CUTS)} AS distance_category,
    {_code("avg_speed_kmh", SPEED_CUTS)} AS speed_category"""

FEATS = f"""{TRIPS},
parts AS (SELECT *, {_parts("feature_timestamp")} FROM trips),
stepped AS (SELECT *, {PATTERNS}, {ROUNDED}, {INTERACTION}, {RATIO}, {BATTERY}, {CODES} FROM parts),
feats AS (SELECT *, {SCORE} FROM stepped)"""

# Numeric columns of the row-wise feature frame besides the key and identifiers, target last.
NUMERIC_FEATURES = [
    "distance_km", "duration_minutes", "avg_speed_kmh", "max_speed_kmh", "avg_battery_soc", "min_battery_soc",
    "max_battery_soc", "avg_elevation_m", "elevation_gain_m", "origin_lat_rounded", "origin_lon_rounded",
    "dest_lat_rounded", "dest_lon_rounded", "trip_year", "trip_month", "trip_dayofweek", "trip_hour",
    "distance_elevation_interaction", "speed_squared", "speed_per_distance", "duration_per_distance",
    "speed_variability", "elevation_gradient", "actual_speed_efficiency", "speed_efficiency_ratio",
    "battery_soc_range", "battery_usage_rate", "energy_per_km", "elevation_per_minute", "trip_complexity_score",
    "is_rush_hour", "is_weekend", "hour_sin", "hour_cos", "distance_category", "speed_category",
]
WINDOWED = [
    "vehicle_avg_efficiency_last30", "vehicle_avg_energy_last30", "vehicle_stddev_energy_last30", "vehicle_avg_distance_last30",
    "vehicle_trip_count_last30", "route_avg_energy_last10", "route_avg_duration_last10", "route_avg_speed_last10", "route_trip_count",
    "vehicle_efficiency_vs_fleet",
]
EVERY_NUMBER = [*NUMERIC_FEATURES, *WINDOWED]

# The whole feature table: row-wise features, both histories, fleet ratio.
WHOLE = f"""{FEATS},
timed AS (SELECT *, CAST(epoch(feature_timestamp) AS BIGINT) AS ts, {Y} / nullif(distance_km, 0) AS per_km FROM feats),
windowed AS (SELECT *, avg(per_km) OVER v AS vehicle_avg_efficiency_last30, avg({Y}) OVER v AS vehicle_avg_energy_last30,
    stddev_samp({Y}) OVER v AS vehicle_stddev_energy_last30, avg(distance_km) OVER v AS vehicle_avg_distance_last30,
    count(*) OVER v AS vehicle_trip_count_last30, avg({Y}) OVER w AS route_avg_energy_last10,
    avg(duration_minutes) OVER w AS route_avg_duration_last10, avg(avg_speed_kmh) OVER w AS route_avg_speed_last10,
    row_number() OVER (PARTITION BY origin_nation, dest_nation ORDER BY feature_timestamp, {KEY}) - 1 AS route_trip_count
  FROM timed WINDOW v AS (PARTITION BY VehId ORDER BY ts RANGE BETWEEN {30 * 86400} PRECEDING AND 1 PRECEDING),
    w AS (PARTITION BY origin_nation, dest_nation ORDER BY feature_timestamp, {KEY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
whole AS (SELECT *, vehicle_avg_efficiency_last30 / (SELECT avg(per_km) FROM timed) AS vehicle_efficiency_vs_fleet FROM windowed)"""
PREP_COLUMNS = ["distance_km", "avg_speed_kmh", "max_speed_kmh", "elevation_gain_m"]
RIDGE_COLUMNS = ["distance_km", "avg_speed_kmh", "max_speed_kmh"]


def _list(items) -> str:
    return "[" + ", ".join(items) + "]"


def _names(columns) -> str:
    return _list(f"'{c}'" for c in columns)


def _missing(source: str, columns: list[str]) -> str:
    counts = _list(f"count(*) - count({c})" for c in columns)
    return f"""
    SELECT CAST(row_number() OVER (ORDER BY missing_count DESC, "column") AS INTEGER) AS rank, "column", missing_count, round_even(missing_count * 100.0 / n_total, 2) AS missing_pct
    FROM (SELECT unnest({_names(columns)}) AS "column", unnest({counts}) AS missing_count, count(*) AS n_total FROM {source})
    WHERE missing_count > 0"""


def _corr(a: str, b: str) -> str:
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"


def _correlation(target: str, columns: list[str]) -> str:
    return f"""ranked AS (
    SELECT unnest({_names(columns)}) AS feature, unnest({_list(_corr(f"CAST({c} AS DOUBLE)", target) for c in columns)}) AS r
    FROM whole)"""


def _label(source: str, column: str, q: int, into: str) -> str:
    """CTEs `edges` and `labelled`: quantile bins with equal edges merged."""
    probs = _list(str(i / q) for i in range(q + 1))
    return f"""
    edges AS (SELECT list_sort(list_distinct(quantile_cont({column}, {probs}))) AS e FROM {source}),
    labelled AS (
      SELECT s.*, CASE WHEN {column} IS NULL THEN NULL
        ELSE CAST(len(list_filter(e[2:len(e) - 1], lambda x: x < {column})) AS INTEGER) END AS {into}
      FROM {source} s, edges)"""


def _hash(seed: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {KEY}))"


# ceil(0.2 n) test rows, shared by largest remainder, first rows of each label in hash order
SPLIT = f"""{TRIPS}, {_label("trips", Y, 4, "label")},
    sizes AS (SELECT label, count(*) AS n FROM labelled GROUP BY label),
    wanted AS (SELECT CAST(ceil(round(0.2 * sum(n), 9)) AS BIGINT) AS n_test, CAST(sum(n) AS BIGINT) AS n_all FROM sizes),
    shares AS (SELECT label, n_test, (n_test * n) // n_all AS base, (n_test * n) % n_all AS rem FROM sizes, wanted),
    quota AS (
      SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, CAST(label AS VARCHAR))
        <= n_test - sum(base) OVER () THEN 1 ELSE 0 END AS take FROM shares),
    split_rows AS (
      SELECT l.*, CASE WHEN row_number() OVER (PARTITION BY l.label ORDER BY {_hash("42")}) <= take
        THEN 'test' ELSE 'train' END AS split
      FROM labelled l JOIN quota USING (label))"""

PREP_SQL = ", ".join(
    f"avg({c}) AS m_{c}, coalesce(nullif(sqrt(var_pop({c}) * count({c}) / count(*)), 0), 1) AS s_{c}" for c in PREP_COLUMNS
)
PREP = f"""{SPLIT}, fitted AS (SELECT {PREP_SQL} FROM split_rows WHERE split = 'train')"""

METRICS = f"""count(*) AS n, {r("sqrt(avg((y - p) * (y - p)))")} AS rmse, {r("avg(abs(y - p))")} AS mae,
    {r("1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0)", 6)} AS r2"""


def _fold(source: str, seed: str, k: int) -> str:
    """First n % k folds hold one row more; folds are runs of the hash order."""
    return f"""
    ordered AS (SELECT *, row_number() OVER (ORDER BY {_hash(seed)}) - 1 AS pos, count(*) OVER () AS n_all FROM {source}),
    folded AS (
      SELECT *, CAST(CASE WHEN pos < (n_all % {k}) * (n_all // {k} + 1) THEN pos // (n_all // {k} + 1)
        ELSE (n_all % {k}) + (pos - (n_all % {k}) * (n_all // {k} + 1)) // (n_all // {k}) END AS INTEGER) AS fold
      FROM ordered)"""


CV = f"""{SPLIT}, train AS (SELECT * FROM split_rows WHERE split = 'train'), {_fold("train", "42", 5)},
    lines AS (
      SELECT f.fold, regr_slope(t.{Y}, t.distance_km) AS b, regr_intercept(t.{Y}, t.distance_km) AS a
      FROM (SELECT DISTINCT fold FROM folded) f JOIN folded t ON t.fold <> f.fold GROUP BY f.fold),
    scores AS (
      SELECT fold, sqrt(avg(({Y} - (a + b * distance_km)) * ({Y} - (a + b * distance_km)))) AS rmse
      FROM folded JOIN lines USING (fold) GROUP BY fold)"""


def _ridge() -> str:
    """Closed form for three columns: Cramer's rule on the penalised moment matrix."""
    a, b, c = RIDGE_COLUMNS
    pairs = [(a, a), (a, b), (a, c), (b, b), (b, c), (c, c), (a, Y), (b, Y), (c, Y)]
    names = ["aa", "ab", "ac", "bb", "bc", "cc", "a_y", "b_y", "c_y"]
    moments = ", ".join(
        f"covar_pop({x}, {y}) * count(*)" + (" + 1.0" if x == y else "") + f" AS {n}" for (x, y), n in zip(pairs, names)
    )
    det = "(aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac))"
    det_a = "(a_y * (bb * cc - bc * bc) - ab * (b_y * cc - bc * c_y) + ac * (b_y * bc - bb * c_y))"
    det_b = "(aa * (b_y * cc - bc * c_y) - a_y * (ab * cc - bc * ac) + ac * (ab * c_y - b_y * ac))"
    det_c = "(aa * (bb * c_y - b_y * bc) - ab * (ab * c_y - b_y * ac) + a_y * (ab * bc - bb * ac))"
    return f"""WITH {SPLIT},
    moments AS (SELECT {moments}, avg({a}) AS ma, avg({b}) AS mb, avg({c}) AS mc, avg({Y}) AS my
      FROM split_rows WHERE split = 'train' AND {a} IS NOT NULL AND {b} IS NOT NULL AND {c} IS NOT NULL AND {Y} IS NOT NULL),
    solved AS (SELECT {det_a} / {det} AS ba, {det_b} / {det} AS bb_, {det_c} / {det} AS bc_, ma, mb, mc, my FROM moments)
    SELECT unnest(['intercept', '{a}', '{b}', '{c}']) AS term,
      unnest([{r("my - ma * ba - mb * bb_ - mc * bc_")}, {r("ba")}, {r("bb_")}, {r("bc_")}]) AS coefficient FROM solved"""


# one trial per supplier, one study per supplier nation
TRIALS = """trials AS (
    SELECT 'nation-' || CAST(s_nationkey AS VARCHAR) AS study, l_suppkey AS number,
      sqrt(avg((l_extendedprice - 50000) * (l_extendedprice - 50000))) AS value,
      avg(CAST(l_linenumber AS DOUBLE)) AS depth, avg(l_discount) AS learning_rate, avg(l_tax) AS random_strength
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, l_suppkey)"""

# one run per customer; the shipped fixtures have no missing metric, so some are removed here
RUNS = """runs AS (
    SELECT CAST(o_custkey AS VARCHAR) AS run_id,
      CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 'run-' || CAST(o_custkey % 20 AS VARCHAR) END AS run_name,
      CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE sqrt(avg((o_totalprice - 100000) * (o_totalprice - 100000))) END AS test_rmse,
      CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE avg(o_totalprice) / 1000000 END AS test_r2
    FROM orders GROUP BY o_custkey)"""

HISTORY = f"""{TRIPS},
    scaled AS (SELECT *, price_cents / CAST(9973 AS DOUBLE) AS energy, CAST(epoch(feature_timestamp) AS BIGINT) AS ts FROM trips),
    history AS (SELECT *,
        avg(energy / nullif(distance_km, 0)) OVER w AS eff, avg(energy) OVER w AS energy_mean,
        stddev_samp(energy) OVER w AS energy_std, avg(distance_km) OVER w AS distance_mean, count(*) OVER w AS trips30
      FROM scaled WINDOW w AS (PARTITION BY VehId ORDER BY ts RANGE BETWEEN {30 * 86400} PRECEDING AND 1 PRECEDING))"""
ROUTES = f"""{TRIPS},
    scaled AS (SELECT *, price_cents / CAST(9973 AS DOUBLE) AS energy, duration_minutes / CAST(9.973 AS DOUBLE) AS duration, round(avg_speed_kmh) AS speed FROM trips),
    routes AS (SELECT *, avg(energy) OVER w AS e10, avg(duration) OVER w AS d10, avg(speed) OVER w AS s10,
        row_number() OVER (PARTITION BY origin_nation, dest_nation ORDER BY feature_timestamp, {KEY}) - 1 AS before
      FROM scaled WINDOW w AS (PARTITION BY origin_nation, dest_nation ORDER BY feature_timestamp, {KEY}
        ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"""


def _sample(column: str, ordinal: int) -> str:
    return f"""(SELECT {ordinal} AS ordinal, '{column}' AS "column", CAST({column} AS VARCHAR) AS value
      FROM (SELECT DISTINCT {column} FROM parts) ORDER BY {column} NULLS LAST LIMIT 10)"""


def _catalog() -> str:
    whole = dict.fromkeys(["DayNum", "VehId", "Trip", "start_timestamp_ms", "vehicle_trip_count_last30", "route_trip_count"], "bigint")
    kinds = whole | dict.fromkeys(["trip_year", "trip_month", "trip_dayofweek", "trip_hour"], "int") | {"trip_date": "date", "feature_timestamp": "timestamp_ntz"}
    listed = [(g, c) for g, cols in FEATURE_GROUPS.items() for c in cols]
    columns = [c for _, c in listed]
    return f"""WITH {WHOLE}
    SELECT ordinal, "group", "column", data_type, round_even(missing * 100.0 / n_total, 1) AS null_pct FROM (
      SELECT unnest({_list(f"CAST({i} AS INTEGER)" for i in range(len(listed)))}) AS ordinal,
        unnest({_names(g for g, _ in listed)}) AS "group", unnest({_names(columns)}) AS "column",
        unnest({_list(f"'{kinds.get(c, 'double')}'" for c in columns)}) AS data_type,
        unnest({_list(f"count(*) - count({c})" for c in columns)}) AS missing, count(*) AS n_total FROM whole)"""


def _histogram(column: str, bins: int) -> str:
    return f"""WITH {TRIPS},
    bounds AS (SELECT min({column}) AS lo, max({column}) AS hi, avg({column}) AS mean FROM trips),
    counted AS (
      SELECT CAST(least(floor({bins} * ({column} - lo) / (hi - lo)), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
      FROM trips, bounds WHERE {column} IS NOT NULL GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, {r(f"lo + i * ((hi - lo) / {bins})")} AS lo,
      {r(f"lo + (i + 1) * ((hi - lo) / {bins})")} AS hi, coalesce(n, 0) AS n, {r("mean")} AS mean
    FROM bounds, range({bins}) axis(i) LEFT JOIN counted ON counted.bin = i"""


def _scatter(x: str, y: str, bins: int) -> str:
    def cell(c: str) -> str:
        return f"CAST(least(floor({bins} * ({c} - {c}_lo) / ({c}_hi - {c}_lo)), {bins - 1}) AS INTEGER)"
    return f"""WITH {TRIPS},
    complete AS (SELECT {x}, {y} FROM trips WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
    bounds AS (SELECT min({x}) AS {x}_lo, max({x}) AS {x}_hi, min({y}) AS {y}_lo, max({y}) AS {y}_hi FROM complete)
    SELECT {cell(x)} AS x_bin, {cell(y)} AS y_bin, count(*) AS n, {r(f"avg({x})")} AS x_mean, {r(f"avg({y})")} AS y_mean
    FROM complete, bounds GROUP BY 1, 2"""


# A stump's cell is the high step alone, a tree's cell both steps; a cell predicts the mean of its training rows.
STEPPED = f"""{SPLIT},
    stepped AS (SELECT *, distance_km >= 25 AS high, l_linenumber >= 4 AS low,
      price_cents + CASE WHEN distance_km >= 25 THEN 1000000000 ELSE 0 END + CASE WHEN l_linenumber >= 4 THEN 100000000 ELSE 0 END AS y FROM split_rows),
    train AS (SELECT * FROM stepped WHERE split = 'train'),
    stump AS (SELECT high, avg(y) AS p FROM train GROUP BY high),
    tree AS (SELECT high, low, avg(y) AS p FROM train GROUP BY high, low)"""


def _stack() -> str:
    """Out-of-fold cell means, a ridge blend of the two in closed form (penalty 1), cell means of all training rows."""
    return f"""WITH {STEPPED}, {_fold("train", "stack-42", 5)},
    folds AS (SELECT DISTINCT fold FROM folded),
    stumps AS (SELECT f.fold, t.high, avg(t.y) AS p FROM folds f JOIN folded t ON t.fold <> f.fold GROUP BY ALL),
    trees AS (SELECT f.fold, t.high, t.low, avg(t.y) AS p FROM folds f JOIN folded t ON t.fold <> f.fold GROUP BY ALL),
    out AS (SELECT CAST(r.y AS DOUBLE) AS y, s.p AS a, t.p AS b FROM folded r JOIN stumps s ON s.fold = r.fold AND s.high = r.high
      JOIN trees t ON t.fold = r.fold AND t.high = r.high AND t.low = r.low),
    m AS (SELECT var_pop(a) * count(*) + 1.0 AS aa, var_pop(b) * count(*) + 1.0 AS bb, covar_pop(a, b) * count(*) AS ab,
      covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM out),
    w AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS wb, ma, mb, my FROM m)
    SELECT {KEY}, split, {r("(my - wa * ma - wb * mb + wa * s.p + wb * t.p) / 1000000")} AS prediction
    FROM stepped x JOIN stump s ON s.high = x.high JOIN tree t ON t.high = x.high AND t.low = x.low, w"""


def _gain(settings, g: str, h: str) -> str:
    return f"coalesce(power(greatest(abs({g}) - {settings.reg_alpha!r}, 0), 2) / nullif({h} + {settings.reg_lambda!r}, 0), 0)"


def _splits(name: str, source: str, features, settings) -> str:
    """CTEs: `<name>_gains` has each node's gain at each value of each feature; rows of `source` have node, w (weight) and e (what is to explain)."""
    cells = " UNION ALL ".join(f"SELECT node, '{f}' AS feature, CAST({f} AS DOUBLE) AS v, sum(w * e) AS g, sum(w) AS h, count(*) AS n FROM {source} GROUP BY ALL" for f in features)
    gain = f"0.5 * ({_gain(settings, 'gl', 'hl')} + {_gain(settings, 'g - gl', 'h - hl')} - {_gain(settings, 'g', 'h')})"
    small = f"least(hl, h - hl) < {settings.min_child_weight!r} OR least(nl, n - nl) < {max(1, settings.min_child_samples)}"
    return f"""
    {name}_cells AS ({cells}),
    {name}_at AS (SELECT DISTINCT feature, v FROM {name}_cells),
    {name}_sums AS (
      SELECT c.node, a.feature, a.v, sum(g) AS g, sum(h) AS h, sum(n) AS n, coalesce(sum(g) FILTER (c.v <= a.v), 0) AS gl,
        coalesce(sum(h) FILTER (c.v <= a.v), 0) AS hl, coalesce(sum(n) FILTER (c.v <= a.v), 0) AS nl
      FROM {name}_at a JOIN {name}_cells c ON c.feature = a.feature GROUP BY ALL),
    {name}_gains AS (SELECT node, feature, v, CASE WHEN {small} THEN NULL ELSE {gain} - {settings.gamma!r} END AS gain FROM {name}_sums)"""


def _below(split: str, features) -> str:
    return "CASE " + " ".join(f"WHEN {split}.feature = '{f}' THEN {f} <= {split}.v" for f in features) + " END"


def _leaf_values(settings) -> str:
    return f"sign(sum(w * e)) * greatest(abs(sum(w * e)) - {settings.reg_alpha!r}, 0) / (sum(w) + {settings.reg_lambda!r}) * {settings.learning_rate!r}"


def _boosted_levels(settings, features_of, weight: str = "1.0") -> str:
    """Trees of one level, one after the other: the best of all splits, then each side's shrunk mean is taken off what is to explain."""
    ctes = [f"""WITH {STEPPED}, base AS (SELECT avg(CAST(y AS DOUBLE)) AS b FROM train),
    t0 AS (SELECT x.*, 0 AS node, {weight} AS w, y - b AS e, b AS p FROM stepped x, base)"""]
    for k in range(settings.trees):
        features = features_of(k)
        ctes.append(f"""
    train{k} AS (SELECT * FROM t{k} WHERE split = 'train'), {_splits(f"s{k}", f"train{k}", features, settings)},
    best{k} AS (SELECT arg_max(feature, gain) AS feature, arg_max(v, gain) AS v FROM s{k}_gains WHERE gain > 0),
    sides{k} AS (SELECT {_below(f"best{k}", features)} AS below, {_leaf_values(settings)} AS value FROM train{k}, best{k} GROUP BY 1),
    t{k + 1} AS (SELECT t.* EXCLUDE (e, p), e - value AS e, p + value AS p FROM t{k} t, best{k} JOIN sides{k} ON below = ({_below(f"best{k}", features)}))""")
    return f"{','.join(ctes)} SELECT {KEY}, split, {r('p / 1000000')} AS prediction FROM t{settings.trees}"


def _boosted_twice(settings, features, second: str) -> str:
    """One tree of a first split and `second` ones: `chosen` has node, feature and v of what splits then."""
    return f"""WITH {STEPPED}, base AS (SELECT avg(CAST(y AS DOUBLE)) AS b FROM train),
    t0 AS (SELECT x.*, 0 AS node, 1.0 AS w, y - b AS e, b FROM stepped x, base),
    train0 AS (SELECT * FROM t0 WHERE split = 'train'), {_splits("s0", "train0", features, settings)},
    best0 AS (SELECT arg_max(feature, gain) AS feature, arg_max(v, gain) AS v FROM s0_gains WHERE gain > 0),
    t1 AS (SELECT t.* EXCLUDE (node), CAST({_below("best0", features)} AS INTEGER) AS node FROM t0 t, best0),
    train1 AS (SELECT * FROM t1 WHERE split = 'train'), {_splits("s1", "train1", features, settings)},
    chosen AS ({second}),
    t2 AS (SELECT t.* EXCLUDE (node), t.node * 10 + CASE WHEN c.node IS NULL THEN 5 ELSE CAST({_below("c", features)} AS INTEGER) END AS node FROM t1 t LEFT JOIN chosen c ON c.node = t.node),
    leaves AS (SELECT node, {_leaf_values(settings)} AS value FROM t2 WHERE split = 'train' GROUP BY node)
    SELECT {KEY}, split, {r('(b + value) / 1000000')} AS prediction FROM t2 JOIN leaves USING (node)"""


def _boosted() -> dict[str, str]:
    from regrove.plans.boosting import tree_features
    from regrove.plans.registered import BOOSTED, STEPS

    every = lambda _: STEPS
    bagged, columns = BOOSTED["boost_bagged"], BOOSTED["boost_columns"]
    draw = f"(CAST('0x' || substr(md5({_hash(str(bagged.seed))} || '|0'), 1, 8) AS BIGINT) + 0.5) / 4294967296"
    one_leaf = "SELECT arg_max(node, gain) AS node, arg_max(feature, gain) AS feature, arg_max(v, gain) AS v FROM s1_gains WHERE gain > 0"
    # one split for both sides: the sum of their gains, where a side that it leaves whole adds nothing
    both = """SELECT n.node, feature, v FROM (SELECT arg_max(feature, total) AS feature, arg_max(v, total) AS v
      FROM (SELECT feature, v, sum(coalesce(gain, 0)) AS total FROM s1_gains GROUP BY ALL)), (SELECT DISTINCT node FROM s1_gains) n"""
    return {
        "boost_regularised": _boosted_levels(BOOSTED["boost_regularised"], every),
        "boost_bagged": _boosted_levels(bagged, every, f"-ln({draw})"),
        "boost_columns": _boosted_levels(columns, lambda k: [STEPS[i] for i in tree_features(STEPS, columns.column_share, columns.seed, k)]),
        "boost_leaves": _boosted_twice(BOOSTED["boost_leaves"], STEPS, one_leaf),
        "boost_symmetric": _boosted_twice(BOOSTED["boost_symmetric"], STEPS, both),
    }


def _alpha() -> str:
    """The same seeded draws as literals; one-column ridge in closed form on four folds, judged on the fifth."""
    rng = random.Random(42)
    draws = [math.exp(rng.uniform(math.log(1.0), math.log(10_000_000.0))) for _ in range(25)]
    listed = ", ".join(f"({i}, {d!r})" for i, d in enumerate(draws))
    return f"""WITH {SPLIT}, train AS (SELECT * FROM split_rows WHERE split = 'train'), {_fold("train", "validation-42", 5)},
    draws AS (SELECT * FROM (VALUES {listed}) d(number, alpha)),
    m AS (SELECT var_pop(distance_km) * count(*) AS xx, covar_pop(distance_km, {Y}) * count(*) AS xy, avg(distance_km) AS mx, avg({Y}) AS my
      FROM folded WHERE fold <> 0),
    scores AS (SELECT number, sqrt(avg(power({Y} - (my + (distance_km - mx) * xy / (xx + alpha)), 2))) AS value
      FROM folded, m, draws WHERE fold = 0 GROUP BY number)
    SELECT CAST(number AS INTEGER) AS number, {r("value")} AS value, {r("min(value) OVER ()")} AS best_value,
      row_number() OVER (ORDER BY scores.value, number) = 1 AS is_best FROM scores"""


def _halving() -> str:
    """Rung by rung on nested samples: the best third, by value and number, goes on."""
    rng = random.Random(42)
    draws = [math.exp(rng.uniform(math.log(1.0), math.log(10_000_000.0))) for _ in range(25)]
    ctes = [f"""WITH {SPLIT}, train AS (SELECT * FROM split_rows WHERE split = 'train'), {_fold("train", "validation-42", 5)},
    alive0 AS (SELECT * FROM (VALUES {", ".join(f"({i}, {d!r})" for i, d in enumerate(draws))}) d(number, alpha))"""]
    sizes = [25, 9, 3]
    for k, share in enumerate((1 / 9, 1 / 3, 1.0)):
        kept = f"substr({_hash('halving-42')}, 1, 6) < '{int(share * 16 ** 6):06x}'" if share < 1 else "TRUE"
        ctes.append(f"""
    rows{k} AS (SELECT * FROM folded WHERE {kept}),
    m{k} AS (SELECT var_pop(distance_km) * count(*) AS xx, covar_pop(distance_km, {Y}) * count(*) AS xy, avg(distance_km) AS mx, avg({Y}) AS my
      FROM rows{k} WHERE fold <> 0),
    scores{k} AS (SELECT number, any_value(alpha) AS alpha, {k} AS rung, sqrt(avg(power({Y} - (my + (distance_km - mx) * xy / (xx + alpha)), 2))) AS value
      FROM rows{k}, m{k}, alive{k} WHERE fold = 0 GROUP BY number),
    alive{k + 1} AS (SELECT number, alpha FROM scores{k} ORDER BY value, number LIMIT {sizes[k + 1] if k < 2 else 1})""")
    return f"""{",".join(ctes)}, every AS (SELECT * FROM scores0 UNION ALL SELECT * FROM scores1 UNION ALL SELECT * FROM scores2)
    SELECT CAST(number AS INTEGER) AS number, CAST(max(rung) AS INTEGER) AS rung, {r("arg_max(value, rung)")} AS value, number = (SELECT number FROM alive3) AS is_best
    FROM every GROUP BY number"""


def _tune() -> str:
    rng = random.Random(42)
    depths = [rng.randint(1, 2) for _ in range(4)]
    return f"""WITH {STEPPED}, {_fold("train", "validation-42", 5)},
    stumps AS (SELECT high, avg(y) AS p FROM folded WHERE fold <> 0 GROUP BY ALL), trees AS (SELECT high, low, avg(y) AS p FROM folded WHERE fold <> 0 GROUP BY ALL),
    errors AS (SELECT sqrt(avg(power(f.y - s.p, 2))) AS one, sqrt(avg(power(f.y - t.p, 2))) AS two
      FROM folded f JOIN stumps s USING (high) JOIN trees t ON t.high = f.high AND t.low = f.low WHERE fold = 0),
    trials AS (SELECT * FROM (VALUES {", ".join(f"({i}, {d})" for i, d in enumerate(depths))}) t(number, depth))
    SELECT CAST(number AS INTEGER) AS number, CAST(depth AS INTEGER) AS depth, {r("CASE WHEN depth = 1 THEN one ELSE two END / 1000000")} AS value FROM trials, errors"""


def _described(sql: str) -> str:
    return f"(SELECT column_name, lower(CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE column_type END) AS kind FROM (DESCRIBE {sql}))"


def _small() -> dict[str, str]:
    from regrove.plans.registered import PRESENCE

    columns = [Y, "distance_km", "avg_speed_kmh", "elevation_gain_m", "price_cents"]
    sketched = " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS n_total, count({c}) AS n_present, {r(f"CAST(min({c}) AS DOUBLE)")} AS low,
        {r(f"CAST(max({c}) AS DOUBLE)")} AS high, TRUE AS quantiles_within, TRUE AS distinct_within FROM trips""" for c in columns)
    listed = ", ".join(f"({i}, '{c}')" for i, c in enumerate(PRESENCE))
    status = " UNION ALL ".join(f"SELECT '{c}' AS target, CASE WHEN count({c}) > 0 THEN 'ok' ELSE 'all_null' END AS status FROM guarded" for c in (Y, "elevation_gain_m", "nothing"))
    return {
        "scatter_bottom_k": f"""WITH {TRIPS} SELECT avg_speed_kmh, {Y} FROM (SELECT avg_speed_kmh, {Y}, {_hash("42")} AS h FROM trips
          WHERE avg_speed_kmh IS NOT NULL AND {Y} IS NOT NULL) ORDER BY h, avg_speed_kmh, {Y} LIMIT 500""",
        "sketch_profile": f"WITH {TRIPS} {sketched}",
        "dtype_counts": f"SELECT kind AS data_type, count(*) AS n_columns FROM {_described('SELECT * FROM lineitem')} GROUP BY 1",
        "feature_presence": f"""SELECT CAST(ordinal AS INTEGER) AS ordinal, "column", "column" IN (SELECT column_name FROM {_described('SELECT * FROM lineitem')}) AS present
          FROM (VALUES {listed}) p(ordinal, "column")""",
        "target_guards": f"WITH {TRIPS}, guarded AS (SELECT *, CAST(NULL AS DOUBLE) AS nothing FROM trips) {status} UNION ALL SELECT 'no_such_column', 'no_column'",
    }


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = _boosted() | _small()
    sql["search_halving"], sql["tune_exact"] = _halving(), _tune()
    in_millions = r("p / 1000000") + " AS prediction"
    sql["tree_exact"] = f"WITH {STEPPED} SELECT {KEY}, split, {in_millions} FROM stepped JOIN stump USING (high)"
    sql["forest_exact"] = f"WITH {STEPPED} SELECT {KEY}, split, {in_millions} FROM stepped JOIN tree USING (high, low)"
    sql["champion_exact"] = sql["forest_exact"]
    sql["importance_exact"] = "SELECT unnest(['distance_km', 'l_linenumber']) AS feature, unnest([CAST(1 AS DOUBLE), 0]) AS importance"
    sql["stack_exact"] = _stack()
    sql["search_alpha"] = _alpha()
    sampled = f"substr({_hash('42')}, 1, 6) < '{int(0.1 * 16 ** 6):06x}'"
    sql["scatter_sample"] = f"WITH {TRIPS} SELECT avg_speed_kmh, {Y} FROM trips WHERE avg_speed_kmh IS NOT NULL AND {Y} IS NOT NULL AND {sampled}"
    sql["table_scan"] = "SELECT * FROM lineitem"
    sql["shape"] = "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem"
    sql["missing_profile"] = f"WITH {TRIPS} {_missing('trips', [Y, 'distance_km', 'duration_minutes', 'avg_speed_kmh', 'max_speed_kmh', 'avg_battery_soc', 'avg_elevation_m', 'elevation_gain_m'])}"
    sql["selected_missing"] = f"WITH {WHOLE} {_missing('whole', FEATURES)}"
    sql["target_summary"] = f"""WITH {TRIPS} SELECT count({Y}) AS n_present, {r(f"avg({Y})")} AS mean,
        {r(f"quantile_cont({Y}, 0.5)")} AS median, {r(f"stddev_samp({Y})")} AS std,
        {r(f"min({Y})")} AS min, {r(f"max({Y})")} AS max, count({Y}) = 0 AS all_null FROM trips"""
    sql["feature_catalog"] = _catalog()
    sql["column_range"] = f"""WITH {TRIPS} SELECT count(DISTINCT trip_date) AS n_distinct,
        min(trip_date) AS min, max(trip_date) AS max FROM trips"""
    temporal = ["trip_year", "trip_month", "trip_dayofweek", "trip_hour"]
    sql["distinct_sample"] = f"WITH {TRIPS}, parts AS (SELECT {_parts('feature_timestamp')} FROM trips) " + " UNION ALL ".join(
        _sample(c, i) for i, c in enumerate(temporal))
    sql["histogram"] = _histogram(Y, 50)
    sql["scatter_bins"] = _scatter("distance_km", "price_cents", 50)
    sql["scatter_speed"] = _scatter("avg_speed_kmh", "price_cents", 50)
    sql["scatter_elevation"] = _scatter("elevation_gain_m", "price_cents", 50)
    sql["scatter_points"] = f"WITH {TRIPS} SELECT avg_speed_kmh, {Y} FROM trips WHERE avg_speed_kmh IS NOT NULL AND {Y} IS NOT NULL"
    ranked = f"WITH {WHOLE}, {_correlation(Y, [*EVERY_NUMBER, Y])}"
    place = "CAST(row_number() OVER (ORDER BY round(ranked.r, 9) DESC NULLS LAST, feature) AS INTEGER) AS rank"
    sql["target_correlation"] = f"{ranked} SELECT {place}, feature, {r('r')} AS r FROM ranked"
    sql["correlation_top15"] = f"{ranked} SELECT {place}, feature, {r('r')} AS r FROM ranked ORDER BY round(ranked.r, 9) DESC NULLS LAST, feature LIMIT 15"
    every = [*EVERY_NUMBER, Y]
    sql["correlation_matrix"] = f"""{ranked},
        top AS (SELECT feature FROM ranked ORDER BY round(r, 9) DESC NULLS LAST, feature LIMIT 12),
        long AS (SELECT row_number() OVER () AS i, unnest({_names(every)}) AS feature, unnest({_list(f"CAST({c} AS DOUBLE)" for c in every)}) AS v
          FROM whole),
        cells AS (SELECT p.i, feature, v FROM (SELECT i, feature, v FROM long) p JOIN top USING (feature))
        SELECT x.feature AS a, y.feature AS b, {r(_corr("x.v", "y.v"))} AS r FROM cells x JOIN cells y ON x.i = y.i GROUP BY ALL"""
    sql["leakage_check"] = f"""WITH {WHOLE}, {_correlation("planted_target", [*EVERY_NUMBER, "planted_target"])}
        SELECT rank, feature, {r('r')} AS r FROM (SELECT {place}, * FROM ranked) ranked WHERE abs(ranked.r) > {LEAK_THRESHOLD} AND feature <> 'planted_target'"""
    sql["flagship"] = f"{ranked} SELECT {place}, feature, {r('r')} AS r, coalesce(abs(ranked.r) > {LEAK_THRESHOLD} AND feature <> '{Y}', false) AS suspect FROM ranked ORDER BY round(ranked.r, 9) DESC NULLS LAST, feature LIMIT 15"
    sql["with_target"] = f"WITH {TRIPS} SELECT {KEY}, distance_km, avg_speed_kmh FROM trips WHERE avg_speed_kmh IS NOT NULL"
    chosen = [c for c in FEATURES if c in NUMERIC_FEATURES[:9]]
    sql["select_features"] = f"WITH {TRIPS} SELECT {KEY}, {', '.join(chosen)} FROM trips"
    sql["quantile_label"] = f"WITH {TRIPS}, {_label('trips', Y, 4, 'label')} SELECT {KEY}, label FROM labelled"
    sql["quantile_label_ties"] = f"WITH {TRIPS}, {_label('trips', 'elevation_gain_m', 4, 'label')} SELECT {KEY}, elevation_gain_m, label FROM labelled"
    sql["stratified_split"] = f"WITH {SPLIT} SELECT {KEY}, label, split FROM split_rows"
    sql["split_summary"] = f"""WITH {SPLIT} SELECT split, count(*) AS n, {r("count(*) * 100.0 / sum(count(*)) OVER ()")} AS pct,
        {r(f"avg({Y})")} AS target_mean, {r(f"stddev_samp({Y})")} AS target_std FROM split_rows GROUP BY split"""
    sql["prep_params"] = f"""WITH {PREP} SELECT unnest({_list(f"CAST({i} AS INTEGER)" for i in range(len(PREP_COLUMNS)))}) AS ordinal,
        unnest({_names(PREP_COLUMNS)}) AS "column", unnest({_list(r("m_" + c, 6) for c in PREP_COLUMNS)}) AS mean,
        unnest({_list(r("s_" + c, 6) for c in PREP_COLUMNS)}) AS scale FROM fitted"""
    applied = ", ".join(r(f"(coalesce({c}, m_{c}) - m_{c}) / s_{c}") + f" AS {c}" for c in PREP_COLUMNS)
    sql["prep_apply"] = f"WITH {PREP} SELECT {KEY}, split, {applied} FROM split_rows, fitted"
    sql["baseline_metrics"] = f"""WITH {SPLIT},
        line AS (SELECT regr_slope({Y}, distance_km) AS b, regr_intercept({Y}, distance_km) AS a FROM split_rows WHERE split = 'train'),
        predicted AS (SELECT split, {Y} AS y, a + b * distance_km AS p FROM split_rows, line)
        SELECT split, {METRICS} FROM predicted GROUP BY split"""
    sql["kfold"] = f"WITH {TRIPS}, {_fold('trips', '42', 5)} SELECT {KEY}, fold FROM folded"
    sql["cross_validation"] = f"WITH {CV} SELECT fold, {r('rmse')} AS rmse FROM scores"
    sql["cv_summary"] = f"WITH {CV} SELECT count(*) AS folds, {r('avg(rmse)')} AS rmse_mean, {r('stddev_pop(rmse)')} AS rmse_std FROM scores"
    sql["ridge"] = _ridge()
    sql["search_runs"] = f"WITH {RUNS} SELECT CAST(row_number() OVER (ORDER BY runs.test_rmse ASC NULLS LAST, run_id) AS INTEGER) AS rank, run_id, run_name, {r('test_rmse')} AS test_rmse, {r('test_r2', 6)} AS test_r2 FROM runs"
    sql["compare_runs"] = f"""WITH {RUNS} SELECT run_id, coalesce(run_name, 'Unknown') AS run_name,
        coalesce({r('test_rmse')}, CAST('inf' AS DOUBLE)) AS test_rmse, coalesce({r('test_r2', 6)}, 0.0) AS test_r2 FROM runs"""
    sql["best_run"] = f"""WITH {RUNS} SELECT run_id, coalesce(run_name, 'Unknown') AS run_name, {r('test_rmse')} AS test_rmse, {r('test_r2', 6)} AS test_r2
        FROM runs ORDER BY runs.test_rmse ASC NULLS LAST, run_id LIMIT 1"""
    sql["trial_history"] = f"""WITH {TRIALS} SELECT study, number, {r('value')} AS value, {r('min(value) OVER (PARTITION BY study)')} AS best_value,
        row_number() OVER (PARTITION BY study ORDER BY trials.value, number) = 1 AS is_best FROM trials"""
    importance = ", ".join(f"abs({_corr(p, 'value')})" for p in ("depth", "learning_rate", "random_strength"))
    sql["param_importance"] = f"""WITH {TRIALS}, each_study AS (SELECT study,
        unnest(['depth', 'learning_rate', 'random_strength']) AS param, unnest([{importance}]) AS importance FROM trials GROUP BY study)
        SELECT study, param, {r('importance')} AS importance,
        CAST(row_number() OVER (PARTITION BY study ORDER BY round(each_study.importance, 9) DESC NULLS LAST, param) AS INTEGER) AS rank FROM each_study"""
    sql["trial_points"] = f"""WITH {TRIALS} SELECT study, number, {r('learning_rate', 6)} AS x, {r('value')} AS value, {r('random_strength', 6)} AS colour,
        row_number() OVER (PARTITION BY study ORDER BY trials.value, number) = 1 AS is_best FROM trials"""
    sql["trial_summary"] = f"""WITH {TRIALS} SELECT study, count(*) AS trials, arg_min(number, value) AS best_number, {r('min(value)')} AS best_value,
        {r('max(value)')} AS worst_value, {r('(max(value) - min(value)) / nullif(max(value), 0) * 100')} AS improvement_pct
        FROM trials GROUP BY study"""
    sql["vehicle_history"] = f"""WITH {HISTORY} SELECT {KEY}, {r('eff')} AS vehicle_avg_efficiency_last30, {r('energy_mean')} AS vehicle_avg_energy_last30,
        {r('energy_std')} AS vehicle_stddev_energy_last30, {r('distance_mean')} AS vehicle_avg_distance_last30,
        trips30 AS vehicle_trip_count_last30 FROM history"""
    sql["fleet_ratio"] = f"""WITH {HISTORY}, fleet AS (SELECT avg(energy / nullif(distance_km, 0)) AS f FROM scaled)
        SELECT {KEY}, {r('eff / f', 6)} AS vehicle_efficiency_vs_fleet FROM history, fleet"""
    sql["route_history"] = f"""WITH {ROUTES} SELECT {KEY}, {r('e10')} AS route_avg_energy_last10, {r('d10')} AS route_avg_duration_last10,
        {r('s10')} AS route_avg_speed_last10, before AS route_trip_count FROM routes"""
    sql["vehicle_batches"], sql["route_batches"] = sql["vehicle_history"], sql["route_history"]
    sql["time_features"] = f"""WITH parts AS (SELECT event_id, {_parts('ts')} FROM events), patterns AS (SELECT *, {PATTERNS} FROM parts)
        SELECT event_id, trip_year, trip_month, trip_dayofweek, trip_hour, is_rush_hour, is_weekend,
        {r('hour_sin', 6)} AS hour_sin, {r('hour_cos', 6)} AS hour_cos FROM patterns"""
    sql["rounded_coordinates"] = f"""WITH {FEATS} SELECT {KEY}, origin_lat_rounded, origin_lon_rounded, dest_lat_rounded, dest_lon_rounded FROM feats"""
    sql["interaction_features"] = f"""WITH {FEATS} SELECT {KEY}, distance_elevation_interaction, speed_squared, speed_per_distance,
        duration_per_distance, speed_variability FROM feats"""
    sql["ratio_features"] = f"""WITH {FEATS} SELECT {KEY}, elevation_gradient, actual_speed_efficiency, speed_efficiency_ratio,
        elevation_per_minute, trip_complexity_score FROM feats"""
    sql["battery_features"] = f"WITH {FEATS} SELECT {KEY}, battery_soc_range, battery_usage_rate, energy_per_km FROM feats"
    sql["category_codes"] = f"WITH {FEATS} SELECT {KEY}, distance_category, speed_category FROM feats"
    return sql
