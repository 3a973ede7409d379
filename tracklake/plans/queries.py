"""Every registered query of the engine beside the SQL it must agree with; queries without SQL are checked by tests."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions.plates import is_valid_plate
from tracklake.operators import features, filters, lookups, periods, profiling, quantiles
from tracklake.operators.outliers import detect_outliers
from tracklake.plans import cleaning
from tracklake.operators.staging import shared_folder
from tracklake.plans.adapter import read_points
from tracklake.sources import csv_points, memory, parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: With the default multiplier every vehicle of the test data is anomalous.
MULTIPLIER = 20.0
GAP_SECONDS, JUMP_KPH = 300.0, 200.0
POLYGON = [(115.8, 39.5), (117.2, 39.5), (117.2, 41.4), (116.5, 40.3), (115.8, 41.4)]
EDGES = [(*a, *b) for a, b in zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True)]
#: Stands for the model's label where SQL has to know it too.
LABEL_EVERY = 17


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


POINTS = """points AS (
  SELECT '京A' || lpad(user_id::VARCHAR, 5, '0') AS license_plate, ts AS timestamp, event_id AS key, value AS instant_speed,
    115.5::DOUBLE + ((event_id * 7) % 200)::DOUBLE / 100.0::DOUBLE AS longitude, 39.2::DOUBLE + ((event_id * 13) % 260)::DOUBLE / 100.0::DOUBLE AS latitude,
    (CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 1 ELSE 0 END)::TINYINT AS occupancy_status FROM events)"""


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"least(greatest(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2), 0.0::DOUBLE), 1.0::DOUBLE)"
    return f"12742.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a}))"


def featured(name: str, source: str) -> str:
    return f"""{name}_lag AS (SELECT *, lag(timestamp) OVER w AS pt, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon, lag(occupancy_status) OVER w AS pocc
  FROM {source} WINDOW w AS (PARTITION BY license_plate ORDER BY timestamp, key)),
{name}_dist AS (SELECT *, epoch_us(timestamp) - epoch_us(pt) AS time_diff_us, (epoch_us(timestamp) - epoch_us(pt)) // 1000000 AS time_diff_seconds,
  CASE WHEN plat IS NULL THEN 0.0 ELSE {haversine("plat", "plon", "latitude", "longitude")} END AS distance_km FROM {name}_lag),
{name} AS (SELECT *, CASE WHEN time_diff_seconds > 0 THEN distance_km / (time_diff_seconds / 3600.0::DOUBLE) ELSE 0.0 END AS implied_speed_kph FROM {name}_dist)"""


def nearest(column: str, q: float) -> str:
    return f"(list_sort(list({column}) FILTER (WHERE {column} IS NOT NULL)))[CAST(floor((count({column}) - 1) * {q}::DOUBLE + 0.5) AS BIGINT) + 1]::DOUBLE"


def beyond(column: str, m: float, q: Callable[[str, float], str] = nearest) -> str:
    return f"({q(column, 0.75)} + {m}::DOUBLE * ({q(column, 0.75)} - {q(column, 0.25)}))"


def linear(column: str, q: float) -> str:
    return f"quantile_cont({column}::DOUBLE, {q})"


FEATURES = f"WITH {POINTS}, {featured('f', 'points')}"
FLAGGED = f"""{FEATURES}, occ AS (SELECT * FROM points WHERE occupancy_status = 1), {featured("o", "occ")},
thr AS (SELECT {beyond("time_diff_seconds", MULTIPLIER)} AS gap, {beyond("implied_speed_kph", MULTIPLIER)} AS jump FROM o),
flagged AS (SELECT f.*, time_diff_seconds > gap AS is_temporal_gap, implied_speed_kph > jump AS is_position_jump FROM f, thr),
bad AS (SELECT DISTINCT license_plate FROM flagged WHERE is_temporal_gap OR is_position_jump),
cleaned AS (SELECT license_plate, timestamp, key, longitude, latitude, occupancy_status, time_diff_us, time_diff_seconds, round(distance_km, 3) AS distance_km, instant_speed, round(implied_speed_kph, 2) AS implied_speed_kph
  FROM flagged WHERE license_plate NOT IN (SELECT license_plate FROM bad))"""
IDS = f"""{FLAGGED}, marked AS (SELECT *, coalesce(license_plate <> lag(license_plate) OVER w OR occupancy_status <> lag(occupancy_status) OVER w, true) AS change FROM cleaned WINDOW w AS (ORDER BY license_plate, timestamp, key)),
ids AS (SELECT *, (sum(change::INT) OVER (ORDER BY license_plate, timestamp, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::INTEGER AS period_id FROM marked)"""
SUMMARY = f"""{IDS}, ends AS (SELECT license_plate, occupancy_status, period_id, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS count_rows, avg(implied_speed_kph) AS avg_implied_speed,
  coalesce(sum(time_diff_seconds), 0)::BIGINT AS sum_time_diff, coalesce(sum(distance_km), 0) AS sum_distance,
  first(latitude ORDER BY timestamp, key) AS lat1, first(longitude ORDER BY timestamp, key) AS lon1, last(latitude ORDER BY timestamp, key) AS lat2, last(longitude ORDER BY timestamp, key) AS lon2
  FROM ids GROUP BY license_plate, occupancy_status, period_id),
sld AS (SELECT *, epoch_us(end_time) - epoch_us(start_time) AS duration_us, {haversine("lat1", "lon1", "lat2", "lon2")} AS straight_line_distance_km FROM ends),
summary AS (SELECT *, CASE WHEN straight_line_distance_km > 0 THEN sum_distance / straight_line_distance_km ELSE 0.0 END AS sld_ratio FROM sld),
longer AS (SELECT * FROM summary WHERE count_rows >= 3)"""
ATTACHED = f"""{SUMMARY}, attached AS (SELECT c.*, p.period_id, p.start_time, p.end_time, CASE WHEN c.key % {LABEL_EVERY} = 0 THEN -1 ELSE 1 END AS is_outlier
  FROM cleaned c JOIN longer p ON c.license_plate = p.license_plate AND c.timestamp BETWEEN p.start_time AND p.end_time)"""
ENRICHED = f"""{ATTACHED}, counted AS (SELECT license_plate, period_id, count(*) FILTER (WHERE is_outlier = -1) AS traj_outlier_count FROM attached GROUP BY ALL),
rated AS (SELECT p.*, coalesce(traj_outlier_count, 0)::BIGINT AS traj_outlier_count, coalesce(traj_outlier_count / count_rows, 0.0)::DOUBLE AS traj_outlier_ratio, coalesce(traj_outlier_count, 0) > 0 AS is_traj_outlier FROM longer p LEFT JOIN counted USING (license_plate, period_id)),
enriched AS (SELECT r.*, sld_ratio > t AS is_sld_outlier FROM rated r, (SELECT {beyond("sld_ratio", 1.5)} AS t FROM longer))"""
PERIOD_SQL = "license_plate, occupancy_status, period_id, start_time, end_time, count_rows, round(avg_implied_speed, 6) AS avg_implied_speed, sum_time_diff, round(sum_distance, 6) AS sum_distance, duration_us, round(straight_line_distance_km, 6) AS straight_line_distance_km, round(sld_ratio, 6) AS sld_ratio"


def made_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.add_implied_speed(features.add_time_distance(read_points(spark, sf)))


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.flagged_points(read_points(spark, sf), MULTIPLIER, also=["key"])


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean(flagged(spark, sf))


def attached(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The periods of three points or more, and the labelled points with theirs."""
    points = cleaning.stage(cleaned(spark, sf).withColumn("is_outlier", F.when(F.col("key") % LABEL_EVERY == 0, -1).otherwise(1)))
    rows = cleaning.stage(cleaning.period_table(points))
    return rows, periods.attach_period_id(points, rows)


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    rows, points = attached(spark, sf)
    return cleaning.enrich(rows, points)


def micros(name: str, alias: str) -> F.Column:
    return F.expr(f"cast(extract(SECOND FROM {name}) * 1000000 AS BIGINT) + (extract(MINUTE FROM {name}) + 60 * (extract(HOUR FROM {name}) + 24 * cast(extract(DAY FROM {name}) AS BIGINT))) * 60000000").alias(alias)


def r6(*names: str) -> list[F.Column]:
    return [F.round(n, 6).alias(n) for n in names]


def period_columns() -> list:
    return ["license_plate", "occupancy_status", "period_id", "start_time", "end_time", "count_rows", *r6("avg_implied_speed"), "sum_time_diff", *r6("sum_distance"), micros("duration", "duration_us"), *r6("straight_line_distance_km", "sld_ratio")]


PLATES = """SELECT event_id AS key, CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '京I12345' WHEN 2 THEN '京A1234' WHEN 3 THEN '京AD12345' WHEN 4 THEN '沪C1234D' WHEN 5 THEN '京a12345' WHEN 6 THEN '京A12345' || chr(10)
  ELSE '京A' || lpad(user_id::VARCHAR, 5, '0') END AS license_plate FROM events"""


def odd_plates(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("key") % 10
    plate = F.when(kind == 0, None)
    for k, text in ((1, "京I12345"), (2, "京A1234"), (3, "京AD12345"), (4, "沪C1234D"), (5, "京a12345"), (6, "京A12345\n")):
        plate = plate.when(kind == k, text)
    return read_points(spark, sf).select("key", plate.otherwise(F.col("license_plate")).alias("license_plate"))


@query(f"SELECT * FROM ({PLATES}) WHERE regexp_full_match(license_plate, '[一-龥][A-HJ-NP-Z][A-HJ-NP-Z0-9]{{5}}')")
def plate_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.valid_plates(odd_plates(spark, sf))


@query(f"SELECT key, coalesce(regexp_full_match(license_plate, '[一-龥][A-HJ-NP-Z][A-HJ-NP-Z0-9]{{5}}') OR regexp_full_match(license_plate, '[一-龥][A-HJ-NP-Z]([DF][A-HJ-NP-Z0-9][0-9]{{4}}|[0-9]{{5}}[DF])'), false) AS valid FROM ({PLATES})")
def plate_filter_new_energy(spark: SparkSession, sf: str) -> DataFrame:
    return odd_plates(spark, sf).select("key", is_valid_plate(F.col("license_plate"), allow_new_energy=True).alias("valid"))


KEYS = "SELECT event_id AS key, ts AS timestamp FROM events WHERE "


@query(KEYS + "year(ts) = 2024")
def date_year_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.by_date(read_points(spark, sf), year=2024).select("key", "timestamp")


@query(KEYS + "ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12'")
def date_range_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.by_date(read_points(spark, sf), start=date(2024, 1, 5), end=date(2024, 1, 12)).select("key", "timestamp")


@query(KEYS + "ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-08'")
def day_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.on_day(read_points(spark, sf), date(2024, 1, 7)).select("key", "timestamp")


@query(KEYS + "ts >= TIMESTAMP '2024-01-09 22:00:00' AND ts <= TIMESTAMP '2024-01-10 00:00:00'")
def last_n_hours(spark: SparkSession, sf: str) -> DataFrame:
    return filters.last_hours(read_points(spark, sf), datetime(2024, 1, 10), 2).select("key", "timestamp")


@query(f"WITH {POINTS} SELECT key, longitude, latitude FROM points WHERE longitude BETWEEN 115.7 AND 117.4 AND latitude BETWEEN 39.4 AND 41.6")
def bbox_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.in_box(read_points(spark, sf)).select("key", "longitude", "latitude")


EDGE_ROWS = ", ".join("(" + ", ".join(f"{v}::DOUBLE" for v in e) + ")" for e in EDGES)


@query(f"""WITH {POINTS}, edges(x1, y1, x2, y2) AS (VALUES {EDGE_ROWS})
SELECT key FROM points, edges GROUP BY key HAVING count(*) FILTER (WHERE (y1 > latitude) <> (y2 > latitude) AND longitude < (x2 - x1) * (latitude - y1) / (y2 - y1) + x1) % 2 = 1
  AND NOT bool_or((x2 - x1) * (latitude - y1) = (y2 - y1) * (longitude - x1) AND longitude BETWEEN least(x1, x2) AND greatest(x1, x2) AND latitude BETWEEN least(y1, y2) AND greatest(y1, y2))""")
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    return filters.in_polygon(read_points(spark, sf), EDGES).select("key")


@query(f"{FEATURES} SELECT key, time_diff_us, time_diff_seconds, round(distance_km, 6) AS distance_km FROM f")
def time_distance(spark: SparkSession, sf: str) -> DataFrame:
    return features.add_time_distance(read_points(spark, sf)).select("key", micros("time_diff_duration", "time_diff_us"), "time_diff_seconds", *r6("distance_km"))


@query(f"{FEATURES} SELECT key, round(implied_speed_kph, 6) AS implied_speed_kph FROM f")
def implied_speed(spark: SparkSession, sf: str) -> DataFrame:
    return made_features(spark, sf).select("key", *r6("implied_speed_kph"))


@query(f"{FEATURES} SELECT key, time_diff_seconds > {GAP_SECONDS} AS is_temporal_gap, implied_speed_kph > {JUMP_KPH} AS is_position_jump FROM f")
def abnormality_flags(spark: SparkSession, sf: str) -> DataFrame:
    return features.add_flags(made_features(spark, sf), GAP_SECONDS, JUMP_KPH).select("key", "is_temporal_gap", "is_position_jump")


@query(f"{FEATURES} SELECT license_plate, count(*) AS n FROM f WHERE time_diff_seconds > {GAP_SECONDS} OR implied_speed_kph > {JUMP_KPH} GROUP BY license_plate")
def anomalous_by_plate(spark: SparkSession, sf: str) -> DataFrame:
    rows = filters.valid_plates(features.add_flags(made_features(spark, sf), GAP_SECONDS, JUMP_KPH))
    return features.anomalous(rows).groupBy("license_plate").agg(F.count(F.lit(1)).alias("n"))


@query(f"{FEATURES} SELECT license_plate, timestamp, longitude, latitude, occupancy_status, time_diff_us, time_diff_seconds, round(distance_km, 3) AS distance_km, instant_speed, round(implied_speed_kph, 2) AS implied_speed_kph, time_diff_seconds > {GAP_SECONDS} AS is_temporal_gap, implied_speed_kph > {JUMP_KPH} AS is_position_jump FROM f")
def final_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.final_columns(features.add_flags(made_features(spark, sf), GAP_SECONDS, JUMP_KPH))
    return rows.select(*[micros(c, "time_diff_us") if c == "time_diff_duration" else c for c in rows.columns])


@query(f"{FEATURES} SELECT key, time_diff_seconds, round(implied_speed_kph, 6) AS implied_speed_kph FROM f WHERE occupancy_status = 1 AND pocc = 1")
def contiguous_segments(spark: SparkSession, sf: str) -> DataFrame:
    return features.contiguous_occupied(made_features(spark, sf)).select("key", "time_diff_seconds", *r6("implied_speed_kph"))


def two_thresholds(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    found = quantiles.point_thresholds(read_points(spark, sf), mode=mode)
    return spark.createDataFrame([tuple(round(v, 6) for v in found)], "gap_seconds double, speed_kph double")


@query(f"WITH {POINTS}, occ AS (SELECT * FROM points WHERE occupancy_status = 1), {featured('o', 'occ')} SELECT round({beyond('time_diff_seconds', 1.5)}, 6) AS gap_seconds, round({beyond('implied_speed_kph', 1.5)}, 6) AS speed_kph FROM o")
def iqr_thresholds_occupied(spark: SparkSession, sf: str) -> DataFrame:
    return two_thresholds(spark, sf, "occupied")


@query(f"{FEATURES} SELECT round({beyond('time_diff_seconds', 1.5, linear)}, 6) AS gap_seconds, round({beyond('implied_speed_kph', 1.5, linear)}, 6) AS speed_kph FROM f WHERE occupancy_status = 1 AND pocc = 1")
def iqr_thresholds_contiguous(spark: SparkSession, sf: str) -> DataFrame:
    return two_thresholds(spark, sf, "contiguous")


@query(f"SELECT round({beyond('l_extendedprice', 1.5)}, 6) AS threshold FROM lineitem")
def iqr_generic(spark: SparkSession, sf: str) -> DataFrame:
    found = quantiles.iqr_threshold(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_extendedprice")
    return spark.createDataFrame([(round(found, 6),)], "threshold double")


QS = [0.01, 0.25, 0.5, 0.75, 0.99]


@query(" UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, {nearest('l_extendedprice', q)} AS nearest, round({linear('l_extendedprice', q)}, 6) AS linear FROM lineitem" for q in QS))
def quantile_nearest(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    found = quantiles.exact_quantiles(rows, ["l_extendedprice"], QS + QS, ["nearest"] * len(QS) + ["linear"] * len(QS))["l_extendedprice"]
    near, line = found[: len(QS)], found[len(QS) :]
    return spark.createDataFrame([(q, n, round(x, 6)) for q, n, x in zip(QS, near, line, strict=True)], "q double, nearest double, linear double")


def tier_sql() -> str:
    where = {"raw": "true", "clean": "implied_speed_kph <= t", "outlier": "implied_speed_kph > t"}
    rows = [f"SELECT '{tier}' AS tier, {p}::DOUBLE AS percentile, round(quantile_cont(implied_speed_kph, {p / 100}), 6) AS value FROM seg, thr WHERE {where[tier]}" for tier, ps in quantiles.TIERS.items() for p in ps]
    return f"{FEATURES}, seg AS (SELECT * FROM f WHERE occupancy_status = 1 AND pocc = 1), thr AS (SELECT {beyond('implied_speed_kph', 1.5, linear)} AS t FROM seg) " + " UNION ALL ".join(rows)


@query(tier_sql())
def percentile_tiers(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaning.stage(features.contiguous_occupied(made_features(spark, sf)).select("implied_speed_kph"))
    limit = quantiles.iqr_threshold(rows, "implied_speed_kph", interpolation="linear")
    return quantiles.percentile_tiers(rows, "implied_speed_kph", limit).select("tier", "percentile", *r6("value"))


def describe_sql() -> str:
    stats = {"count": "count({c})", "null_count": "count(*) - count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})"}
    value = lambda s, c: nearest(c, int(s[:-1]) / 100) if s.endswith("%") else stats[s].format(c=c)
    names = ["count", "null_count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    return f"{FEATURES} " + " UNION ALL ".join(f"SELECT '{s}' AS statistic, round(({value(s, 'time_diff_seconds')})::DOUBLE, 4) AS time_diff_seconds, round(({value(s, 'implied_speed_kph')})::DOUBLE, 4) AS implied_speed_kph FROM f" for s in names)


@query(describe_sql())
def describe_features(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.describe(made_features(spark, sf), ["time_diff_seconds", "implied_speed_kph"]).select("statistic", F.round("time_diff_seconds", 4).alias("time_diff_seconds"), F.round("implied_speed_kph", 4).alias("implied_speed_kph"))


def profile_sql() -> str:
    rows = []
    for c, kind in (("c", "bigint"), ("v", "double"), ("s", "string")):
        number = kind != "string"
        rows.append(f"SELECT '{c}' AS column, '{kind}' AS dtype, count(*) - count({c}) AS missing_count, (count(*) - count({c})) / count(*) * 100.0::DOUBLE AS missing_pct, count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS unique, {f'round(avg({c}), 6)' if number else 'NULL::DOUBLE'} AS mean, {f'round(stddev_samp({c}), 6)' if number else 'NULL::DOUBLE'} AS std FROM t")
    return "WITH t AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS c, value AS v, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS s FROM events) " + " UNION ALL ".join(rows)


@query(profile_sql())
def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("c"), F.col("value").alias("v"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("s"))
    return profiling.profile(rows).select("column", "dtype", "missing_count", "missing_pct", "unique", *r6("mean", "std"))


@query(f"""{FEATURES}, lim AS (SELECT min(implied_speed_kph) AS lo, max(implied_speed_kph) AS hi FROM f),
binned AS (SELECT least(floor((implied_speed_kph - lo) / ((hi - lo) / 200)), 199)::INTEGER AS bin FROM f, lim), n AS (SELECT bin, count(*) AS n FROM binned GROUP BY bin)
SELECT r.range::INTEGER AS bin, round(lo + r.range * ((hi - lo) / 200), 6) AS low, round(lo + (r.range + 1) * ((hi - lo) / 200), 6) AS high, coalesce(n.n, 0) AS n FROM range(200) r CROSS JOIN lim LEFT JOIN n ON n.bin = r.range""")
def histogram_speed(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.histogram(made_features(spark, sf), "implied_speed_kph", 200).select("bin", *r6("low", "high"), "n")


@query("""WITH t AS (SELECT epoch_us(ts) AS us FROM events), lim AS (SELECT min(us) AS lo, max(us) AS hi FROM t)
SELECT least(((us - lo)::HUGEINT * 24) // (hi - lo), 23)::INTEGER AS bin, count(*) AS n FROM t, lim GROUP BY 1""")
def timestamp_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.time_histogram(read_points(spark, sf), 24)


@query("SELECT ts AS timestamp, count(*) AS len FROM events GROUP BY ts")
def timestamp_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.counts_per_timestamp(read_points(spark, sf))


@query(f"{FLAGGED} SELECT license_plate FROM bad")
def flagged_plates(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.flagged_plates(flagged(spark, sf))


@query(f"{FLAGGED} SELECT * FROM cleaned")
def cleaned_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaned(spark, sf)
    return rows.select(*[micros(c, "time_diff_us") if c == "time_diff_duration" else c for c in rows.columns])


@query(f"{IDS} SELECT key, license_plate, period_id FROM ids")
def period_id(spark: SparkSession, sf: str) -> DataFrame:
    return periods.add_period_id(cleaned(spark, sf)).select("key", "license_plate", "period_id")


@query(f"{SUMMARY} SELECT {PERIOD_SQL} FROM summary")
def period_summary(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.period_table(cleaned(spark, sf), 1).select(*period_columns())


@query(f"{SUMMARY} SELECT {PERIOD_SQL} FROM longer")
def period_summary_min3(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.period_table(cleaned(spark, sf)).select(*period_columns())


@query(f"{ATTACHED} SELECT key, license_plate, period_id, start_time, end_time, is_outlier FROM attached")
def attach_period_id(spark: SparkSession, sf: str) -> DataFrame:
    return attached(spark, sf)[1].select("key", "license_plate", "period_id", "start_time", "end_time", "is_outlier")


@query(f"{ENRICHED} SELECT license_plate, period_id, round(sld_ratio, 6) AS sld_ratio FROM enriched WHERE is_sld_outlier")
def sld_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return enriched(spark, sf).filter("is_sld_outlier").select("license_plate", "period_id", *r6("sld_ratio"))


@query(f"{ENRICHED} SELECT {PERIOD_SQL}, traj_outlier_count, round(traj_outlier_ratio, 6) AS traj_outlier_ratio, is_traj_outlier, is_sld_outlier FROM enriched")
def periods_enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enriched(spark, sf).select(*period_columns(), "traj_outlier_count", *r6("traj_outlier_ratio"), "is_traj_outlier", "is_sld_outlier")


@query(f"""{FEATURES}, h AS (SELECT *, CASE WHEN pt IS NOT NULL THEN implied_speed_kph END AS speed, nullif(time_diff_seconds / 3600.0::DOUBLE, 0) AS hours, degrees(atan2(longitude - plon, latitude - plat)) AS heading FROM f)
SELECT key, round(speed, 6) AS speed, round((speed - lag(speed) OVER w) / hours, 4) AS acceleration, round(abs(heading - lag(heading) OVER w), 6) AS direction_change FROM h WINDOW w AS (PARTITION BY license_plate ORDER BY timestamp, key)""")
def outlier_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.motion(made_features(spark, sf)).select("key", *r6("speed"), F.round("acceleration", 4).alias("acceleration"), *r6("direction_change"))


@query()
def isolation_forest_flags(spark: SparkSession, sf: str) -> DataFrame:
    return detect_outliers(made_features(spark, sf)).select("key", "license_plate", "is_outlier")


@query()
def full_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.run(read_points(spark, sf), MULTIPLIER).periods.select(*period_columns(), "traj_outlier_count", "is_traj_outlier", "is_sld_outlier")


@query(f"{ENRICHED} SELECT license_plate, period_id, round(sum_distance, 6) AS sum_distance FROM enriched WHERE is_sld_outlier AND NOT is_traj_outlier AND occupancy_status IN (0, 1) AND sum_distance >= 1.0")
def periods_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.filtered_periods(enriched(spark, sf), "Only outliers", "Only normal", [0, 1], True).select("license_plate", "period_id", *r6("sum_distance"))


@query(f"{SUMMARY} SELECT license_plate, count(period_id) AS n_periods FROM longer GROUP BY license_plate HAVING count(period_id) > 1")
def plate_period_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.plate_counts(cleaning.period_table(cleaned(spark, sf)), only_several=True, order="descending")


@query(f"WITH {POINTS} SELECT DISTINCT license_plate FROM points ORDER BY license_plate LIMIT 100")
def sample_plates(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.sample_plates(read_points(spark, sf))


@query(f"{SUMMARY} SELECT DISTINCT occupancy_status FROM longer")
def occupancy_options(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.occupancy_options(cleaning.period_table(cleaned(spark, sf)))


ONE_PERIOD = "(SELECT license_plate, period_id FROM longer ORDER BY count_rows DESC, period_id LIMIT 1)"


@query(f"{ATTACHED} SELECT timestamp, latitude, longitude, is_outlier FROM attached JOIN {ONE_PERIOD} USING (license_plate, period_id)")
def trajectory_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows, points = attached(spark, sf)
    one = rows.orderBy(F.desc("count_rows"), "period_id").first()
    return lookups.trajectory(points, one.license_plate, one.period_id) if one else lookups.trajectory(points, "", 0)


@query(f"{ATTACHED} SELECT round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM attached JOIN {ONE_PERIOD} USING (license_plate, period_id)")
def trajectory_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.centroid(trajectory_lookup(spark, sf)).select(*r6("latitude", "longitude"))


@query(f"{SUMMARY}, one AS {ONE_PERIOD} SELECT {PERIOD_SQL} FROM longer WHERE license_plate = (SELECT license_plate FROM one) AND period_id = (SELECT period_id FROM one)")
def period_info(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaning.stage(cleaning.period_table(cleaned(spark, sf)))
    one = rows.orderBy(F.desc("count_rows"), "period_id").first()
    return lookups.period_info(rows, one.license_plate if one else "", one.period_id if one else 0).select(*period_columns())


@query(f"{SUMMARY}, one AS {ONE_PERIOD} SELECT DISTINCT period_id FROM longer WHERE license_plate = (SELECT license_plate FROM one)")
def period_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaning.stage(cleaning.period_table(cleaned(spark, sf)))
    one = rows.orderBy(F.desc("count_rows"), "period_id").first()
    return lookups.period_ids(rows, one.license_plate if one else "")


@query(f"{SUMMARY} SELECT license_plate, period_id, coalesce(lag(period_id) OVER w, period_id) AS prev_period, coalesce(lead(period_id) OVER w, period_id) AS next_period FROM longer WINDOW w AS (PARTITION BY license_plate ORDER BY period_id)")
def period_navigation(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.navigation(cleaning.period_table(cleaned(spark, sf)))


@query(f"{SUMMARY} SELECT sha256(license_plate)[1:8] AS license_plate, period_id, '***' AS start_time, '***' AS end_time, count_rows FROM longer")
def anonymized_periods(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.private(cleaning.period_table(cleaned(spark, sf))).select("license_plate", "period_id", "start_time", "end_time", "count_rows")


def histogram_sql(bins: int) -> str:
    return f"""{FEATURES}, lim AS (SELECT min(implied_speed_kph) AS lo, max(implied_speed_kph) AS hi FROM f),
n AS (SELECT least(floor((implied_speed_kph - lo) / ((hi - lo) / {bins})), {bins - 1})::INTEGER AS bin, count(*) AS n FROM f, lim GROUP BY 1)
SELECT r.range::INTEGER AS bin, round(lo + r.range * ((hi - lo) / {bins}), 6) AS low, round(lo + (r.range + 1) * ((hi - lo) / {bins}), 6) AS high, coalesce(n.n, 0) AS n FROM range({bins}) r CROSS JOIN lim LEFT JOIN n ON n.bin = r.range"""


@query(histogram_sql(500))
def histogram_speed_500(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.histogram(made_features(spark, sf), "implied_speed_kph", 500).select("bin", *r6("low", "high"), "n")


@query(histogram_sql(100))
def histogram_speed_100(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.histogram(made_features(spark, sf), "implied_speed_kph", 100).select("bin", *r6("low", "high"), "n")


def time_bins_sql(bins: int) -> str:
    return f"""WITH t AS (SELECT epoch_us(ts) AS us FROM events), lim AS (SELECT min(us) AS lo, max(us) AS hi FROM t)
SELECT least(((us - lo)::HUGEINT * {bins}) // (hi - lo), {bins - 1})::INTEGER AS bin, count(*) AS n FROM t, lim GROUP BY 1"""


@query(time_bins_sql(12))
def timestamp_histogram_12(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.time_histogram(read_points(spark, sf), 12)


@query(time_bins_sql(50))
def timestamp_histogram_50(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.time_histogram(read_points(spark, sf), 50)


@query(f"{SUMMARY} SELECT license_plate, count(period_id) AS n_periods FROM longer GROUP BY license_plate")
def plate_counts_by_plate(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.plate_counts(cleaning.period_table(cleaned(spark, sf)))


@query(f"{SUMMARY} SELECT license_plate, count(period_id) AS n_periods FROM longer GROUP BY license_plate HAVING count(period_id) > 1")
def plate_counts_ascending(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.plate_counts(cleaning.period_table(cleaned(spark, sf)), only_several=True, order="ascending")


@query(f"""WITH {POINTS}, marked AS (SELECT key, coalesce(license_plate <> lag(license_plate) OVER w OR occupancy_status <> lag(occupancy_status) OVER w, true) AS change FROM points WINDOW w AS (ORDER BY key))
SELECT key, (sum(change::INT) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::INTEGER AS period_id FROM marked""")
def period_id_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return periods.add_period_id_in_order(read_points(spark, sf), "key").select("key", "period_id")


NORTH = [(115.6, 40.0), (117.3, 40.0), (117.3, 41.7), (115.6, 41.7)]
SHAPES = {"city": EDGES, "north": [(*a, *b) for a, b in zip(NORTH, NORTH[1:] + NORTH[:1], strict=True)]}
SHAPE_ROWS = ", ".join(f"('{name}', " + ", ".join(f"{v}::DOUBLE" for v in e) + ")" for name, edges in SHAPES.items() for e in edges)


@query(f"""WITH {POINTS}, edges(area, x1, y1, x2, y2) AS (VALUES {SHAPE_ROWS})
SELECT key, area FROM points, edges GROUP BY key, area HAVING count(*) FILTER (WHERE (y1 > latitude) <> (y2 > latitude) AND longitude < (x2 - x1) * (latitude - y1) / (y2 - y1) + x1) % 2 = 1
  AND NOT bool_or((x2 - x1) * (latitude - y1) = (y2 - y1) * (longitude - x1) AND longitude BETWEEN least(x1, x2) AND greatest(x1, x2) AND latitude BETWEEN least(y1, y2) AND greatest(y1, y2))""")
def polygon_join(spark: SparkSession, sf: str) -> DataFrame:
    return filters.join_polygons(read_points(spark, sf), [({"area": name}, edges) for name, edges in SHAPES.items()]).select("key", "area")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query(f"""WITH {POINTS} SELECT key::VARCHAR AS taxi_id, CASE WHEN key % 11 <> 0 THEN license_plate END AS license_plate, CASE WHEN key % 13 <> 0 THEN timestamp END AS timestamp,
  CASE WHEN key % 7 <> 0 THEN longitude END AS longitude, CASE WHEN key % 17 <> 0 THEN latitude END AS latitude, CASE WHEN key % 5 <> 0 THEN instant_speed END AS instant_speed, CASE WHEN key % 19 <> 0 THEN occupancy_status END AS occupancy_status FROM points""")
def csv_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The points written as a raw file with each null token and unreadable cells, converted, and read back."""
    text = lambda c, n, bad: F.when(F.col("key") % n == 0, F.lit(bad)).otherwise(F.col(c).cast("string")).alias(c)
    raw = read_points(spark, sf).select(F.lit("c").alias("company_id"), F.col("key").cast("string").alias("taxi_id"), text("license_plate", 11, "N"), text("timestamp", 13, "bad"), text("longitude", 7, "n"), text("latitude", 17, "39.x"), text("instant_speed", 5, ""), text("occupancy_status", 19, "999"), F.lit("x"), F.lit("y"), F.lit("z"))
    where = new_folder(spark)
    raw.write.csv(f"{where}/day.csv")
    done = csv_points.convert_csv(spark, f"{where}/day.csv", columns="taxi_id, license_plate, timestamp, longitude, latitude, instant_speed, occupancy_status")
    return spark.read.parquet(done)


@query(f"WITH {POINTS} SELECT license_plate, key, longitude FROM points WHERE occupancy_status = 1")
def parquet_sink(spark: SparkSession, sf: str) -> DataFrame:
    where = new_folder(spark)
    parquet.save_parquet(filters.occupied(read_points(spark, sf)).select("license_plate", "key", "longitude"), where, compression="snappy")
    return spark.read.parquet(where)


@query(f"WITH {POINTS} SELECT license_plate, count(*) AS n FROM points GROUP BY license_plate")
def csv_sink(spark: SparkSession, sf: str) -> DataFrame:
    where = new_folder(spark)
    parquet.save_csv(read_points(spark, sf).groupBy("license_plate").agg(F.count(F.lit(1)).alias("n")), where)
    return spark.read.schema("license_plate string, n bigint").option("header", True).csv(where)


@query("SELECT * FROM (VALUES ('京A12345', TIMESTAMP '2019-11-25 01:02:03', 1), ('京A12345', NULL, 0), ('京B00001', TIMESTAMP '2019-11-25 23:59:59', 1)) v(license_plate, timestamp, occupancy_status)")
def memory_points(spark: SparkSession, sf: str) -> DataFrame:
    made = memory.points_from_columns(spark, {"license_plate": ["京A12345", "京A12345", "京B00001"], "timestamp": ["2019-11-25T01:02:03", "late", "2019-11-25T23:59:59"], "occupancy_status": [1, 0, 1]})
    return made.withColumn("occupancy_status", F.col("occupancy_status").cast("int"))
