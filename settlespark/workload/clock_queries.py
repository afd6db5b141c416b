"""Settlement clock and time functions. Order dates span many years and clock changes."""

from pyspark.sql import functions as F

from settlespark.functions import clock, values
from settlespark.operators import timeline
from settlespark.workload.registry import day, day_length, day_start, local, out, period, query

# Order dates at one of 48 half-hours, so that every hour of the clock change occurs.
DELIVERY = "o_orderdate + (o_orderkey % 48) * INTERVAL '30 minutes'"


def deliveries(t):
    shifted = clock.add_seconds("o_orderdate", F.col("o_orderkey") % 48 * 1800)
    return t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", shifted.alias("ts"))


@query("settlement_columns", f"""
SELECT o_orderkey, ts AS timestamp_utc, {local('ts')} AS timestamp_local, {day('ts')} AS delivery_date,
  {period('ts')} AS settlement_period, strftime({local('ts')}, '%H:%M') AS gb_time,
  strftime({local('ts')}, '%Y-%m-%d %H:%M') || CASE WHEN {local('ts')} = ts THEN ' GMT' ELSE ' BST' END AS gb_label
FROM (SELECT o_orderkey, {DELIVERY} AS ts FROM orders)""", dates=["delivery_date"])
def settlement_columns(t):
    d = timeline.with_settlement_columns(deliveries(t), "ts")
    return out(d.select("o_orderkey", "timestamp_utc", "timestamp_local", "delivery_date", "settlement_period",
                        clock.gb_time("ts").alias("gb_time"), clock.gb_label("ts").alias("gb_label")))


@query("settlement_spine", f"""
WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS delivery_date FROM orders)
SELECT delivery_date, {day_start('delivery_date')} + (p - 1) * INTERVAL '30 minutes' AS timestamp, p AS settlement_period
FROM (SELECT delivery_date, unnest(generate_series(1, {day_length('delivery_date')})) AS p FROM days)""", dates=["delivery_date"])
def settlement_spine(t):
    days = t.orders.select(F.to_date("o_orderdate").alias("delivery_date")).distinct()
    return out(timeline.settlement_spine(days).select("delivery_date", "timestamp", "settlement_period"))


@query("hourly_clock", f"""
WITH days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS delivery_date FROM lineitem)
SELECT delivery_date, unnest(range({day_start('delivery_date')}, {day_start('delivery_date + 1')}, INTERVAL '1 hour')) AS timestamp
FROM days""", dates=["delivery_date"])
def hourly_clock(t):
    days = t.lineitem.select(F.to_date("l_shipdate").alias("delivery_date")).distinct()
    return out(timeline.settlement_spine(days, step_s=3600).select("delivery_date", "timestamp"))


@query("settlement_to_utc", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, d AS settlement_date, p AS settlement_period,
  CASE WHEN p BETWEEN 1 AND {day_length('d')} THEN {day_start('d')} + (p - 1) * INTERVAL '30 minutes' END AS timestamp
FROM (SELECT *, CAST(l_shipdate AS DATE) AS d, (l_orderkey + l_linenumber) % 53 AS p FROM lineitem)""", dates=["settlement_date"], ints=["l_linenumber"])
def settlement_to_utc(t):
    d = t.lineitem.withColumns({
        "settlement_date": F.to_date("l_shipdate"),
        "settlement_period": (F.col("l_orderkey") + F.col("l_linenumber")) % 53,
    })
    return out(d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "settlement_date", "settlement_period",
                        clock.settlement_instant("settlement_date", "settlement_period").alias("timestamp")))


@query("start_time_or_period", f"""
SELECT o_orderkey, coalesce(TRY_CAST(start_text AS TIMESTAMP), {day_start('d')} + (p - 1) * INTERVAL '30 minutes') AS timestamp
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 46 + 1 AS p,
  CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN 'unknown' END AS start_text FROM orders)""")
def start_time_or_period(t):
    start = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm'Z'")).when(
        F.col("o_orderkey") % 3 == 1, "unknown")
    d = t.orders.select("o_orderkey", clock.source_or_settlement_instant(
        start, F.to_date("o_orderdate"), F.col("o_orderkey") % 46 + 1).alias("timestamp"))
    return out(d)


@query("clock_gaps", """
WITH hh AS (SELECT event_type AS series, time_bucket(INTERVAL '30 minutes', ts) AS ts FROM events GROUP BY 1, 2),
g AS (SELECT series, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series ORDER BY ts)) AS gap FROM hh)
SELECT series, count(*) AS row_count, count(*) FILTER (gap = 0) AS duplicate_count,
  count(*) FILTER (gap <> 0 AND gap <> 1800) AS gap_count, CAST(max(gap) AS BIGINT) AS largest_gap_s
FROM g GROUP BY series""")
def clock_gaps(t):
    return out(timeline.clock_violations(t.hh, ["series"], "ts"))


@query("date_chunks", f"""
WITH w AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) + 1 AS z FROM orders GROUP BY 1),
c AS (SELECT o_custkey, z, a + CAST(unnest(generate_series(0, (z - a - 1) // 30)) * 30 AS INTEGER) AS chunk_start FROM w)
SELECT o_custkey, chunk_start, least(chunk_start + 30, z) AS chunk_end,
  {day_start('chunk_start')} AS start_utc, {day_start('least(chunk_start + 30, z)')} AS end_utc FROM c""", dates=["chunk_start", "chunk_end"])
def date_chunks(t):
    w = t.orders.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"),
                                          F.date_add(F.to_date(F.max("o_orderdate")), 1).alias("z"))
    c = w.select("o_custkey", F.inline(clock.date_chunks("a", "z", 30)).alias("chunk_start", "chunk_end"))
    return out(c.withColumns({"start_utc": clock.day_start("chunk_start"), "end_utc": clock.day_start("chunk_end")}))


@query("issue_time", f"""
SELECT o_orderkey, issue AS issue_time_utc, late AS wall_clock_issue_utc, (epoch(ts) - epoch(issue)) / 3600.0 AS lead_hours
FROM (SELECT o_orderkey, ts, {day_start(day('ts'))} - INTERVAL '11 hours' AS issue,
  ((CAST({day('ts')} - 1 AS TIMESTAMP) + INTERVAL '30 minutes') AT TIME ZONE 'Europe/London' AT TIME ZONE 'UTC') AS late
  FROM (SELECT o_orderkey, {DELIVERY} AS ts FROM orders))""")
def issue_time(t):
    d = deliveries(t).withColumn("issue_time_utc", clock.issue_instant("ts", 13, 0))
    return out(d.select("o_orderkey", "issue_time_utc", clock.issue_instant("ts", 0, 30, wall_clock=True).alias("wall_clock_issue_utc"),
                        clock.lead_hours("issue_time_utc", "ts").alias("lead_hours")))


@query("iso_durations", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber % 3 WHEN 0 THEN l_linenumber * 60 WHEN 1 THEN l_linenumber * 15 ELSE l_linenumber * 60 + 30 END AS minutes
FROM lineitem""", ints=["l_linenumber", "minutes"])
def iso_durations(t):
    n = F.col("l_linenumber").cast("string")
    text = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("PT"), n, F.lit("H"))).when(
        F.col("l_linenumber") % 3 == 1, F.concat(F.lit("PT"), (F.col("l_linenumber") * 15).cast("string"), F.lit("M"))
    ).otherwise(F.concat(F.lit("PT"), n, F.lit("H30M")))
    return out(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", clock.duration_minutes(text).alias("minutes")))


@query("text_keys", f"""
SELECT o_orderkey, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc_key, strftime({day('ts')}, '%Y-%m-%d') AS date_key,
  o_orderpriority || '|' || strftime({day_start(day('ts'))} - INTERVAL '11 hours', '%Y-%m-%dT%H:%M:%SZ') || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS forecast_id
FROM (SELECT *, {DELIVERY} AS ts FROM orders)""")
def text_keys(t):
    d = deliveries(t).withColumn("issue", clock.issue_instant("ts"))
    return out(d.select("o_orderkey", clock.utc_text("ts").alias("utc_key"), clock.date_text(clock.delivery_date("ts")).alias("date_key"),
                        values.forecast_id("o_orderpriority", "issue", "ts").alias("forecast_id")))


@query("period_completeness", f"""
SELECT event_type, {day('ts')} AS delivery_date, count(DISTINCT b) AS observed_periods, count(*) AS row_count,
  {day_length(day('any_value(ts)'))} AS expected_periods, {day_length(day('any_value(ts)'))} - count(DISTINCT b) AS missing_periods
FROM (SELECT event_type, ts, time_bucket(INTERVAL '30 minutes', ts) AS b FROM events) GROUP BY 1, 2""", dates=["delivery_date"])
def period_completeness(t):
    grid = t.events.select("event_type", clock.half_hour("ts").alias("ts"))
    return out(timeline.period_completeness(grid, ["event_type"], "ts"))


@query("missing_dates", """
WITH s AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders),
e AS (SELECT o_custkey, CAST(unnest(generate_series(min(d), max(d), INTERVAL '1 day')) AS DATE) AS missing_date FROM s GROUP BY 1)
SELECT e.* FROM e ANTI JOIN s ON e.o_custkey = s.o_custkey AND e.missing_date = s.d""", dates=["missing_date"])
def missing_dates(t):
    return out(timeline.missing_dates(t.orders, ["o_custkey"], "o_orderdate"))


@query("clock_difference", f"""
WITH hh AS (SELECT event_type, time_bucket(INTERVAL '30 minutes', ts) AS timestamp FROM events GROUP BY 1, 2),
span AS (SELECT event_type, min({day('timestamp')}) AS a, max({day('timestamp')}) AS z FROM hh GROUP BY 1),
days AS (SELECT event_type, CAST(unnest(generate_series(a + 1, z, INTERVAL '1 day')) AS DATE) AS d FROM span),
spine AS (SELECT event_type, unnest(range({day_start('d')}, {day_start('d + 1')}, INTERVAL '30 minutes')) AS timestamp FROM days)
SELECT event_type, timestamp, CASE WHEN e THEN 'missing' ELSE 'extra' END AS difference FROM (
  SELECT event_type, timestamp, bool_or(e) AS e, bool_or(a) AS a FROM (
    SELECT event_type, timestamp, true AS e, false AS a FROM spine UNION ALL SELECT event_type, timestamp, false, true FROM hh)
  GROUP BY 1, 2) WHERE e <> a""")
def clock_difference(t):
    grid = t.events.select("event_type", clock.half_hour("ts").alias("timestamp")).distinct()
    span = grid.groupBy("event_type").agg(F.date_add(F.min(clock.delivery_date("timestamp")), 1).alias("a"),
                                          F.date_add(F.max(clock.delivery_date("timestamp")), 1).alias("z"))
    spine = timeline.settlement_spine(timeline.dates_between(span, "a", "z")).select("event_type", "timestamp")
    return out(timeline.clock_difference(spine, grid, ["event_type", "timestamp"]))


@query("seam_days", f"""
WITH seen AS (SELECT DISTINCT {DELIVERY} AS timestamp FROM orders WHERE o_orderstatus = 'P'),
span AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS z FROM orders),
days AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL '1 day')) AS DATE) AS d FROM span),
spine AS (SELECT unnest(range({day_start('d')}, {day_start('d + 1')}, INTERVAL '30 minutes')) AS timestamp FROM days),
miss AS (SELECT timestamp FROM spine ANTI JOIN seen USING (timestamp)),
seams AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_discount = 0.1 AND l_returnflag = 'R')
SELECT delivery_date, missing_rows, CASE WHEN s.d IS NULL THEN 'outside_seam'
  WHEN missing_rows = {day_length('delivery_date')} THEN 'excluded' ELSE 'partial_day' END AS verdict
FROM (SELECT {day('timestamp')} AS delivery_date, count(*) AS missing_rows FROM miss GROUP BY 1) m LEFT JOIN seams s ON m.delivery_date = s.d""", dates=["delivery_date"])
def seam_days(t):
    pending = t.orders.where("o_orderstatus = 'P'")
    seen = pending.select(clock.add_seconds("o_orderdate", F.col("o_orderkey") % 48 * 1800).alias("timestamp"))
    span = t.orders.agg(F.to_date(F.min("o_orderdate")).alias("a"), F.date_add(F.to_date(F.max("o_orderdate")), 1).alias("z"))
    spine = timeline.settlement_spine(timeline.dates_between(span, "a", "z")).select("timestamp")
    missing = timeline.clock_difference(spine, seen, ["timestamp"]).where("difference = 'missing'")
    seams = t.lineitem.where("l_discount = 0.1 and l_returnflag = 'R'").select(F.to_date("l_shipdate").alias("seam_date"))
    return out(timeline.seam_days(missing, seams))


@query("training_clock", f"""
WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
closed AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
SELECT d AS delivery_date, unnest(range({day_start('d')}, {day_start('d + 1')}, INTERVAL '30 minutes')) AS timestamp
FROM days ANTI JOIN closed USING (d)""", dates=["delivery_date"])
def training_clock(t):
    days = t.orders.select(F.to_date("o_orderdate").alias("delivery_date")).distinct()
    closed = t.orders.where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("delivery_date"))
    # Excluding days before the spine keeps the anti-join at one row per day.
    return out(timeline.settlement_spine(timeline.without_days(days, closed)).select("delivery_date", "timestamp"))


@query("date_union", """
SELECT CAST(o_orderdate AS DATE) AS delivery_date FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem""", dates=["delivery_date"])
def date_union(t):
    return out(t.orders.select(F.to_date("o_orderdate").alias("delivery_date")).union(
        t.lineitem.select(F.to_date("l_shipdate"))).distinct())
