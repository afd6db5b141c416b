"""Revisions, as-of joins, lags, merges and guards."""

from pyspark.sql import functions as F

from settlespark.functions import clock
from settlespark.operators import point_in_time as pit, quality, relations as rel
from settlespark.workload.registry import COMPONENTS, HH, day, day_start, out, query

# Events as publications: the delivery is the user's day after the event.
PUBLICATIONS = "SELECT event_id, user_id, CAST(ts AS DATE) + 1 AS delivery_day, ts AS published_at_utc, value FROM events"


def publications(t):
    return t.events.select("event_id", "user_id", F.date_add(F.to_date("ts"), 1).alias("delivery_day"),
                           F.col("ts").alias("published_at_utc"), "value")


@query("latest_revision", """
SELECT user_id, CAST(ts AS DATE) AS delivery_day, event_id, ts AS published_at_utc, value FROM events WHERE ts <= TIMESTAMP '2024-01-20 13:00:00'
QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1""", dates=["delivery_day"])
def latest_revision(t):
    p = t.events.select("user_id", F.to_date("ts").alias("delivery_day"), "event_id", F.col("ts").alias("published_at_utc"), "value")
    return out(pit.latest_revision(p, ["user_id", "delivery_day"], issue="2024-01-20 13:00:00", tie=["event_id"]))


@query("revision_at_issue", f"""
SELECT user_id, delivery_day, event_id, published_at_utc, value, {day_start('delivery_day')} - INTERVAL '11 hours' AS issue_time_utc
FROM ({PUBLICATIONS}) WHERE published_at_utc <= {day_start('delivery_day')} - INTERVAL '11 hours'
QUALIFY row_number() OVER (PARTITION BY user_id, delivery_day ORDER BY published_at_utc DESC, event_id DESC) = 1""", dates=["delivery_day"])
def revision_at_issue(t):
    issue = clock.issue_instant(clock.day_start("delivery_day"))
    chosen = pit.latest_revision(publications(t), ["user_id", "delivery_day"], issue=issue, tie=["event_id"])
    return out(chosen.withColumn("issue_time_utc", issue))


@query("asof_join", """
SELECT l.event_id, l.user_id, l.ts AS issue_time, CAST(r.event_id AS DOUBLE) AS source_event, r.ts AS published_at, r.value AS source_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_join(t):
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("issue_time"))
    right = t.events.where("event_type = 'click'").select(
        "user_id", F.col("event_id").cast("double").alias("source_event"), F.col("ts").alias("published_at"), F.col("value").alias("source_value"))
    return out(pit.asof_join(left, right, "issue_time", "published_at", ["user_id"], tie=["source_event"]))


@query("asof_join_hot_series", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_returnflag, r.o_orderdate AS known_date, r.top AS known_total
FROM lineitem l ASOF LEFT JOIN (SELECT o_orderdate, max(o_totalprice) AS top FROM orders GROUP BY 1) r ON l.l_shipdate >= r.o_orderdate""",
       ints=["l_linenumber"])
def asof_join_hot_series(t):
    # One key for all rows: the join still spreads over time blocks.
    left = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", F.lit(0).alias("k"))
    right = t.orders.select(F.lit(0).alias("k"), F.col("o_orderdate").alias("known_date"), F.col("o_totalprice").alias("known_total"))
    joined = pit.asof_join(left, right, "l_shipdate", "known_date", ["k"], tie=["known_total"])
    return out(joined.drop("k", "l_shipdate"))


@query("future_information", f"""
SELECT 'published_at_utc' AS publication_column, count(*) FILTER (published_at_utc > issue) AS late_rows FROM
  (SELECT *, {day_start('delivery_day')} - INTERVAL '11 hours' AS issue FROM ({PUBLICATIONS}))
UNION ALL SELECT 'price_published_at_utc', count(*) FILTER (published_at_utc - INTERVAL '6 hours' > issue) FROM
  (SELECT *, {day_start('delivery_day')} - INTERVAL '11 hours' AS issue FROM ({PUBLICATIONS}))""")
def future_information(t):
    p = publications(t).withColumns({
        "issue_time_utc": clock.issue_instant(clock.day_start("delivery_day")),
        "price_published_at_utc": clock.add_seconds("published_at_utc", -6 * 3600)})
    return out(pit.future_information(p))


@query("issue_window_faults", f"""
SELECT o_orderkey FROM (SELECT o_orderkey, epoch({day_start('CAST(o_orderdate AS DATE)')}) - epoch(o_orderdate - (o_orderkey % 60) * INTERVAL '1 hour') AS gap FROM orders)
WHERE gap <= 0 OR gap > 172800""")
def issue_window_faults(t):
    d = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"),
                        clock.add_seconds("o_orderdate", -(F.col("o_orderkey") % 60) * 3600).alias("issue"))
    return out(quality.issue_window_faults(d, "issue", "d").select("o_orderkey"))


@query("persistence_lags", f"""
WITH {HH} SELECT a.series, a.ts, round(a.price, 6) AS price, a.n, round(b.price, 6) AS persistence_24h, round(c.price, 6) AS persistence_168h
FROM hh a LEFT JOIN hh b ON a.series = b.series AND b.ts = a.ts - INTERVAL '24 hours'
LEFT JOIN hh c ON a.series = c.series AND c.ts = a.ts - INTERVAL '168 hours'""")
def persistence_lags(t):
    return out(pit.timestamp_lags(t.hh, ["series"], "ts", "price", {"persistence_24h": 86400, "persistence_168h": 7 * 86400}))


@query("one_to_one_join", f"""
WITH {HH} SELECT a.ts, round(a.price, 6) AS click_price, round(b.price, 6) AS view_price, round(c.price, 6) AS error_price,
  round(d.price, 6) AS purchase_price, round(e.price, 6) AS signup_price FROM
  (SELECT * FROM hh WHERE series = 'click') a JOIN (SELECT * FROM hh WHERE series = 'view') b USING (ts)
  LEFT JOIN (SELECT * FROM hh WHERE series = 'error') c USING (ts) LEFT JOIN (SELECT * FROM hh WHERE series = 'purchase') d USING (ts)
  LEFT JOIN (SELECT * FROM hh WHERE series = 'signup') e USING (ts)""")
def one_to_one_join(t):
    def one(kind):
        return t.hh.where(F.col("series") == kind).select("ts", F.col("price").alias(f"{kind}_price"))
    base = rel.join_one_to_one(one("click"), one("view"), ["ts"])
    for kind in ("error", "purchase", "signup"):
        base = rel.join_many_to_one(base, one(kind), ["ts"])
    return out(base)


@query("outer_merge", f"""
WITH {HH} SELECT ts, round(max(price) FILTER (series = 'click'), 6) AS click_price, round(max(price) FILTER (series = 'view'), 6) AS view_price,
  round(max(price) FILTER (series = 'signup'), 6) AS signup_price, round(max(price) FILTER (series = 'purchase'), 6) AS purchase_price,
  round(max(price) FILTER (series = 'error'), 6) AS error_price FROM hh GROUP BY ts""")
def outer_merge(t):
    frames = [t.hh.where(F.col("series") == k).select("ts", F.col("price").alias(f"{k}_price")) for k in ("click", "view", "signup", "purchase", "error")]
    return out(rel.outer_merge(frames, ["ts"]))


@query("align_to_spine", f"""
WITH span AS (SELECT {day('min(ts)')} AS a, {day('max(ts)')} AS z FROM events),
days AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL '1 day')) AS DATE) AS d FROM span),
spine AS (SELECT unnest(range({day_start('d')}, {day_start('d + 1')}, INTERVAL '30 minutes')) AS timestamp FROM days), {COMPONENTS}
SELECT s.timestamp, c.demand_mw, c.inertia_gvas FROM spine s LEFT JOIN components c USING (timestamp)""")
def align_to_spine(t):
    from settlespark.operators import timeline
    span = t.events.agg(clock.delivery_date(F.min("ts")).alias("a"), F.date_add(clock.delivery_date(F.max("ts")), 1).alias("z"))
    spine = timeline.settlement_spine(timeline.dates_between(span, "a", "z")).select("timestamp")
    return out(rel.join_many_to_one(spine, t.components.select("timestamp", "demand_mw", "inertia_gvas"), ["timestamp"]))


@query("clock_semi_join", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
WHERE CAST(l_shipdate AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT')""", ints=["l_linenumber"])
def clock_semi_join(t):
    days = t.orders.where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("d")).distinct()
    kept = t.lineitem.withColumn("d", F.to_date("l_shipdate")).join(days, "d", "left_semi")
    return out(kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


@query("unseen_keys", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'F')""")
def unseen_keys(t):
    seen = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return out(t.customer.select("c_custkey", "c_name").join(seen, "c_custkey", "left_anti"))


@query("alignment_faults", """
WITH b AS (SELECT event_type, time_bucket(INTERVAL '30 minutes', ts) AS timestamp FROM events)
SELECT timestamp, count(*) FILTER (event_type = 'click') AS left_rows, count(*) FILTER (event_type = 'view') AS right_rows
FROM b WHERE event_type IN ('click', 'view') GROUP BY 1 HAVING left_rows <> right_rows""")
def alignment_faults(t):
    b = t.events.select("event_type", clock.half_hour("ts").alias("timestamp"))
    return out(rel.alignment_faults(b.where("event_type = 'click'"), b.where("event_type = 'view'"), ["timestamp"]))


@query("column_lookup", f"""
WITH {COMPONENTS} SELECT a.timestamp, a.demand_mw, b.inertia_gvas FROM components a LEFT JOIN components b USING (timestamp)""")
def column_lookup(t):
    tables = {"prices": t.hh, "grid": t.components.select("timestamp", "demand_mw"), "inertia": t.components.select("timestamp", "inertia_gvas")}
    found = rel.column_from_first(tables, "inertia_gvas")
    return out(rel.join_many_to_one(tables["grid"], found, ["timestamp"]))


@query("dedup_last", """
SELECT user_id, event_type, event_id, ts, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def dedup_last(t):
    return out(pit.last_by(t.events, ["user_id", "event_type"], ["ts", "event_id"]))


@query("conflicting_rows", """
SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, count(*) AS row_count FROM orders GROUP BY 1, 2
HAVING count(*) > 1 AND count(DISTINCT o_orderstatus || '|' || o_orderpriority) > 1""", dates=["d"])
def conflicting_rows(t):
    d = t.orders.select("o_custkey", F.to_date("o_orderdate").alias("d"), "o_orderstatus", "o_orderpriority")
    return out(rel.conflicting_rows(d, ["o_custkey", "d"]))


@query("duplicate_flags", """
SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1 AS is_duplicate FROM orders""")
def duplicate_flags(t):
    return out(rel.duplicate_flags(t.orders, ["o_custkey", "o_orderdate"]).select("o_orderkey", "is_duplicate"))


@query("trim_window", """
SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1 hour' AND ts < TIMESTAMP '2024-01-30 00:00:00'""")
def trim_window(t):
    start, end = F.lit("2024-01-01 01:00:00").cast("timestamp"), F.lit("2024-01-30 00:00:00").cast("timestamp")
    return out(quality.trim_window(t.events.select("event_id", "ts"), "ts", start, end))


@query("window_counts", """
SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20') AS inside_rows,
  count(*) FILTER ((ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-10') OR (ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21')) AS spilled_rows,
  count(*) FILTER (ts < TIMESTAMP '2024-01-09' OR ts >= TIMESTAMP '2024-01-21') AS far_rows, CAST(0 AS BIGINT) AS untimed_rows
FROM events GROUP BY 1""")
def window_counts(t):
    start, end = F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    return out(quality.window_counts(t.events, "ts", start, end, keys=["event_type"]))


@query("equality_filter", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def equality_filter(t):
    return out(t.orders.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice"))


@query("table_profile", """
SELECT 'customer' AS table_name, count(*) AS row_count, CAST(5 AS BIGINT) AS column_count,
  CAST(sum((c_custkey IS NULL)::INT + (c_name IS NULL)::INT + (c_nationkey IS NULL)::INT + (c_acctbal IS NULL)::INT + (c_mktsegment IS NULL)::INT) AS BIGINT) AS null_cells,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS duplicate_rows, NULL::VARCHAR AS timestamp_column,
  NULL::DOUBLE AS invalid_timestamps, NULL::TIMESTAMP AS timestamp_min, NULL::TIMESTAMP AS timestamp_max, NULL::DOUBLE AS duplicate_timestamps FROM customer
UNION ALL SELECT 'documents', count(*), 5, CAST(sum((doc_id IS NULL)::INT + (text IS NULL)::INT + (lang IS NULL)::INT + (source IS NULL)::INT + (n_chars IS NULL)::INT) AS BIGINT),
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)), NULL, NULL, NULL, NULL, NULL FROM documents
UNION ALL SELECT 'events', count(*), 6, CAST(sum((event_id IS NULL)::INT + (ts IS NULL)::INT + (user_id IS NULL)::INT + (event_type IS NULL)::INT + (value IS NULL)::INT + (props IS NULL)::INT) AS BIGINT),
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events)), 'timestamp', count(*) - count(ts), min(ts), max(ts), count(ts) - count(DISTINCT ts) FROM events
UNION ALL SELECT 'orders', count(*), 6, CAST(sum((o_orderkey IS NULL)::INT + (o_custkey IS NULL)::INT + (o_orderstatus IS NULL)::INT + (o_totalprice IS NULL)::INT + (o_orderdate IS NULL)::INT + (o_orderpriority IS NULL)::INT) AS BIGINT),
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)), 'settlement_date', count(*) - count(o_orderdate), min(o_orderdate), max(o_orderdate), count(o_orderdate) - count(DISTINCT o_orderdate) FROM orders""")
def table_profile(t):
    tables = {"customer": t.customer, "documents": t.documents, "events": t.events.withColumnRenamed("ts", "timestamp"),
              "orders": t.orders.withColumnRenamed("o_orderdate", "settlement_date")}
    audit = quality.audit_tables(t.spark, tables).drop("error", "null_counts", "data_types", "sample")
    # Counts that may be absent are doubles in both engines.
    return out(audit.withColumns({c: F.col(c).cast("double") for c in ("invalid_timestamps", "duplicate_timestamps")}))


@query("sampled_rows", """
SELECT '{"region":"' || r_name || '"}' AS sample FROM region WHERE r_regionkey < 2""")
def sampled_rows(t):
    """The first two rows of a table in file order."""
    return out(quality.sample_rows(t.region.select(F.col("r_name").alias("region"))))


@query("full_profile", """
SELECT 'customer' AS table_name, 'c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string' AS types, n AS null_counts, s AS sample FROM
  (SELECT string_agg(k || '=' || v, ',' ORDER BY k) AS n FROM (SELECT unnest(['c_acctbal', 'c_mktsegment']) AS k, unnest([count(*) FILTER (c_acctbal < 0), count(*) FILTER (c_mktsegment = 'BUILDING')]) AS v FROM customer) WHERE v > 0),
  (SELECT string_agg('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_acctbal":' || CASE WHEN c_acctbal < 0 THEN 'null' ELSE c_acctbal END
    || ',"c_mktsegment":' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}', ';' ORDER BY c_custkey) AS s FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 2))""")
def full_profile(t):
    """Types, null counts and first rows of customers, with debts and one segment blanked."""
    rows = t.customer.withColumns({"c_acctbal": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), "c_mktsegment": F.nullif("c_mktsegment", F.lit("BUILDING"))})
    p = quality.table_profile(rows, "customer")
    listed = F.transform(F.array_sort(F.map_entries("null_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    types = F.transform(F.array(*[F.lit(c) for c in rows.columns]), lambda c: F.concat_ws(" ", c, F.col("data_types")[c]))
    return out(p.select("table_name", F.array_join(types, ", ").alias("types"), F.array_join(listed, ",").alias("null_counts"), F.array_join("sample", ";").alias("sample")))


@query("audited_with_a_bad_table", """
SELECT 'customer' AS table_name, count(*)::DOUBLE AS row_count, false AS failed FROM customer UNION ALL SELECT 'nothing', NULL, true
UNION ALL SELECT 'orders', count(*), false FROM orders UNION ALL SELECT 'supplier', count(*), false FROM supplier UNION ALL SELECT 'truncated', NULL, true""")
def audited_with_a_bad_table(t):
    """Good tables, one whose files turn out to be no Parquet while they are read, and one that is not there."""
    from settlespark.session import shared_path
    broken = shared_path(t.spark, "truncated")
    t.orders.select(F.to_json(F.struct("*"))).write.text(broken)
    tables = {"customer": t.customer, "orders": t.orders, "supplier": t.supplier, "truncated": t.spark.read.schema(t.orders.schema).parquet(broken),
              "nothing": lambda: t.spark.read.parquet(f"{broken}/nothing")}
    return out(quality.audit_tables(t.spark, tables).select("table_name", F.col("row_count").cast("double").alias("row_count"), F.col("error").isNotNull().alias("failed")))


@query("column_profile", """
SELECT 'lineitem' AS table_name, column_name, null_rows, data_type FROM (
  SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate']) AS column_name,
  unnest(['bigint', 'bigint', 'bigint', 'int', 'double', 'double', 'double', 'double', 'string', 'string', 'timestamp']) AS data_type,
  unnest([count(*) - count(l_orderkey), count(*) - count(l_partkey), count(*) - count(l_suppkey), count(*) - count(l_linenumber), count(*) - count(l_quantity), count(*) - count(l_extendedprice),
  count(*) - count(l_discount), count(*) - count(l_tax), count(*) - count(l_returnflag), count(*) - count(l_linestatus), count(*) - count(l_shipdate)]) AS null_rows FROM lineitem)""")
def column_profile(t):
    return out(quality.column_profile(t.lineitem, "lineitem"))
