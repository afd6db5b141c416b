import pytest
from pyspark.sql import functions as F

from settlespark.errors import GuardError, MissingColumns
from settlespark.operators import quality, relations as rel
from settlespark.plans import collect
from settlespark.sources import documents, records as src, tables

def market_document(field, start, step, values, made="2027-02-10T11:40:00Z", **labels):
    """A document with one series whose points carry ``values`` from ``start`` on."""
    points = "".join(f"<Point><position>{i}</position><{field}>{v}</{field}></Point>" for i, v in enumerate(values, 1))
    tags = "".join(f"<{k}>{v}</{k}>" for k, v in labels.items())
    period = f"<Period><timeInterval><start>{start}</start></timeInterval><resolution>{step}</resolution>{points}</Period>"
    return f'<Market_Document xmlns="urn:example:market"><createdDateTime>{made}</createdDateTime><TimeSeries>{tags}{period}</TimeSeries></Market_Document>'


PRICE_XML = market_document("price.amount", "2027-02-11T17:00Z", "PT60M", [31.25, -4.5, 0.0], **{"mRID": "s17", "currency_Unit.name": "EUR"})


def flow_document(*values):
    return market_document("quantity", "2027-02-11T06:30Z", "PT30M", values, **{"mRID": "f3", "in_Domain.mRID": "NORTH", "out_Domain.mRID": "SOUTH"})


REFUSED = """<Acknowledgement_MarketDocument xmlns="urn:y"><Reason><code>999</code><text>No data; securityToken=abc&amp;x=1</text></Reason></Acknowledgement_MarketDocument>"""


def docs(frame, *xml):
    return frame([(x,) for x in xml], "xml string")


def test_hourly_prices_become_two_half_hours_each(frame):
    got = documents.day_ahead_prices(docs(frame, PRICE_XML)).orderBy("timestamp").collect()
    assert [(r.timestamp.strftime("%d %H:%M"), r.price_eur_mwh) for r in got] == [
        ("11 17:00", 31.25), ("11 17:30", 31.25), ("11 18:00", -4.5), ("11 18:30", -4.5), ("11 19:00", 0.0), ("11 19:30", 0.0)]
    assert {(r.currency, r.published_at_utc.minute, r.resolution_minutes) for r in got} == {("EUR", 40, 30)}


def test_flows_in_and_out_give_the_net_import(frame):
    inbound = documents.physical_flows(docs(frame, flow_document(250, 0, 75)))
    outbound = documents.physical_flows(docs(frame, flow_document(40, 60)))
    got = rel.directional_flows(inbound, outbound, "north").orderBy("timestamp").collect()
    assert [(r.timestamp.strftime("%H:%M"), r.north_net_import_mw) for r in got] == [("06:30", 210.0), ("07:00", -60.0), ("07:30", 75.0)]


def test_refused_documents(frame):
    with pytest.raises(Exception, match="999: No data"):
        documents.day_ahead_prices(docs(frame, REFUSED)).collect()
    assert documents.day_ahead_prices(docs(frame, PRICE_XML, REFUSED), strict=False).count() == 6
    rows = documents.document_status(docs(frame, PRICE_XML, REFUSED, "broken", '<D xmlns="u"><createdDateTime>2026-01-01T00:00Z</createdDateTime></D>')).collect()
    assert [r.status for r in rows] == ["success", "unavailable", "failed", "no_rows"]
    assert "abc" not in rows[1].message and "***" in rows[1].message


def test_points_without_value_are_skipped_and_odd_steps_fail(frame):
    partial = PRICE_XML.replace("<price.amount>0.0</price.amount>", "")
    assert documents.timeseries_points(docs(frame, partial), "price.amount", "v").count() == 2
    with pytest.raises(Exception, match="unsupported duration"):
        documents.timeseries_points(docs(frame, PRICE_XML.replace("PT60M", "P1D")), "price.amount", "v").collect()


def test_one_odd_document_hides_no_other(frame):
    odd = [PRICE_XML.replace("PT60M", "P1D"), PRICE_XML.replace("PT60M", "PT5M"), PRICE_XML.replace("<position>2<", "<position>x<")]
    d = frame([("good", PRICE_XML), ("day", odd[0]), ("five", odd[1]), ("text", odd[2])], "border string, xml string")
    points = documents.timeseries_points(d, "price.amount", "v", keep=["border"], strict=False).collect()
    assert {r.border for r in points} == {"good"} and len(points) == 3
    status = {r.border: (r.status, r.message) for r in documents.document_status(d).collect()}
    assert status["good"] == ("success", None) and {status[k][0] for k in ("day", "five", "text")} == {"failed"} and "P1D" in status["day"][1]
    items = {r.border: (r.status, r.row_count) for r in collect.item_status(d, ["border"], "price.amount").collect()}
    assert items["good"] == ("success", 3) and items["text"] == ("failed", 0)


def test_one_broken_payload_hides_no_other(frame):
    rows = [(1, '{"data": [{"a": 1}]}'), (2, '{"data": [{"a": 1}'), (3, '{"x": 1}'), (4, '{"data": []}')]
    p = frame(rows, "n int, payload string")
    assert [r.n for r in src.records(p, keep=["n"], strict=False).collect()] == [1]
    assert {r.n: (r.status, r.record_count) for r in src.payload_status(p).collect()} == {1: ("success", 1), 2: ("failed", 0), 3: ("failed", 0), 4: ("no_rows", 0)}
    with pytest.raises(Exception):
        src.records(p, keep=["n"]).collect()


def test_an_unlisted_link_is_an_error_and_never_left_out_of_the_total(frame):
    body = '[{"settlementDate": "2027-02-11", "settlementPeriod": 9, "interconnectorName": "%s", "generation": %d}]'
    recs = src.records(frame([(body % ("North", 10),), (body % ("East", 7),)], "payload string"))
    assert src.interconnectors(recs, ["North", "East"]).first().net_import_mw == 17.0
    with pytest.raises(Exception, match="not among the listed ones: east"):
        src.interconnectors(recs, ["North"]).collect()
    with pytest.raises(Exception, match="not among the listed ones"):
        rel.sum_by_category(frame([("a", 1.0), ("b", 2.0)], "k string, v double").withColumn("t", F.lit(1)), ["t"], "k", "v", ["a"]).collect()


@pytest.mark.parametrize("shape", ["%s", '{"data": %s}', '{"records": %s}', '{"result": %s}', '{"result": {"records": %s}}', '{"data": {"records": %s}}'])
def test_every_payload_shape(frame, shape):
    body = '[{"settlementDate": "2026-07-15", "settlementPeriod": 1, "PRICE": "12.5", "dataProvider": "APXMIDP", "volume": 3},' \
           ' {"settlementDate": "2026-07-15", "settlementPeriod": 2, "price": "n/a", "dataProvider": "APXMIDP", "volume": 3},' \
           ' {"settlementDate": "2026-07-15", "settlementPeriod": 3, "price": 1, "dataProvider": "OTHER", "volume": 3}]'
    got = src.market_index(src.records(frame([(shape % body,)], "payload string"))).collect()
    assert [(r.price_gbp_mwh, r.timestamp.strftime("%d %H:%M")) for r in got] == [(12.5, "14 23:00")]


def test_payload_without_records_fails(frame):
    with pytest.raises(Exception, match="no record list"):
        src.records(frame([('{"other": 1}',)], "payload string")).collect()


def test_absent_fields_are_named(frame):
    recs = src.records(frame([('[{"settlementDate": "2026-01-01"}]',)], "payload string"))
    with pytest.raises(MissingColumns, match="price"):
        src.require_fields(recs, ["date", "price"])


def test_unit_reference_keeps_the_last(frame):
    body = '[{"elexonBmUnit": "U1", "fuelType": "%s", "generationCapacity": %d}]'
    recs = src.records(frame([(1, body % ("GAS", 5)), (2, body % ("WIND", 7))], "n int, payload string"), keep=["n"])
    got = src.unit_reference(recs, ["n"]).collect()
    assert [(r.bm_unit, r.fuel_type, r.generation_capacity_mw) for r in got] == [("U1", "WIND", 7.0)]


def test_weather_payload_without_hours_fails(frame):
    with pytest.raises(Exception, match="no hourly time"):
        src.hourly_weather(frame([("s", '{"x": 1}')], "site string, payload string"), ["t"]).collect()


def test_core_collection_combines_chunks(spark, frame, tmp_path):
    def rec(period, name, value, **extra):
        import json
        return json.dumps({"data": [{"settlementDate": "2026-07-15", "settlementPeriod": period, name: value, **extra}]})
    rows = []
    for landed, value in (("2026-07-15", 1.0), ("2026-07-16", 2.0)):  # the later landing wins
        for p in (1, 2):
            rows += [(rec(p, "price", value, dataProvider="APXMIDP", volume=1), "price", landed), (rec(p, "demand", value), "demand", landed),
                     (rec(p, "generation", value, fuelType="WIND"), "fuel", landed), (rec(p, "generation", value, interconnectorName="IFA"), "interconnectors", landed)]
    landed = frame(rows, "payload string, source string, d string").withColumn("landed_date", F.to_date("d")).drop("d")
    path = tables.land_payloads(landed, str(tmp_path / "bronze"))
    saved = collect.core_sources(tables.read_landed(spark, path), "2026-07-15", "2026-07-16", str(tmp_path / "out"), ["WIND", "NUCLEAR"], ["IFA"])
    assert [r.price_gbp_mwh for r in spark.read.parquet(saved["price"]).collect()] == [2.0, 2.0]
    fuel = spark.read.parquet(saved["fuel"]).first()
    assert (fuel.fuel_wind_mw, fuel.fuel_nuclear_mw) == (2.0, None)
    assert spark.read.parquet(saved["interconnectors"]).first().net_import_mw == 2.0
    with pytest.raises(GuardError, match="far outside"):
        collect.core_sources(tables.read_landed(spark, path), "2026-01-15", "2026-01-16", str(tmp_path / "bad"), ["WIND"], ["IFA"])


def test_chunks_are_summed_and_the_last_one_wins_whole(spark, frame, tmp_path):
    import json
    def rec(fuel, value):
        return {"settlementDate": "2027-02-11", "settlementPeriod": 4, "fuelType": fuel, "generation": value}
    def price(kind):
        return {"settlementDate": "2027-02-11", "settlementPeriod": 4, "price": 1, "demand": 2, "dataProvider": "APXMIDP", "volume": 1, "interconnectorName": "L", "generation": 1}
    rows = [("fuel", "2027-02-12", json.dumps([rec("WIND", 10), rec("WIND", 5), rec("GAS", 3)])), ("fuel", "2027-02-13", json.dumps([rec("WIND", 4), rec("WIND", 4)]))]
    rows += [(k, "2027-02-12", json.dumps([price(k)])) for k in ("price", "demand", "interconnectors")]
    landed = frame(rows, "source string, d string, payload string").withColumn("landed_date", F.to_date("d")).drop("d")
    for days, want in ((landed.where("landed_date < '2027-02-13'"), (15.0, 3.0)), (landed, (8.0, None))):
        saved = collect.core_sources(days, "2027-02-11", "2027-02-12", str(tmp_path / str(want[0])), ["WIND", "GAS"], ["L"])
        row = spark.read.parquet(saved["fuel"]).first()
        assert (row.fuel_wind_mw, row.fuel_gas_mw) == want


def test_market_collection_keeps_partial_success(spark, frame, tmp_path):
    rows = [("price", "france", None, PRICE_XML), ("price", "belgium", None, REFUSED), ("flow", "france", "in", flow_document(5, 6)),
            ("flow", "france", "out", flow_document(1, 1)), ("schedule", "france", "in", flow_document(2, 2))]
    d = frame(rows, "product string, border string, direction string, xml string")
    saved = collect.market_collection(d, ["france", "belgium"], str(tmp_path))
    flows = spark.read.parquet(saved["physical_flows"]).orderBy("timestamp").collect()
    assert [r.net_import_mw for r in flows] == [4.0, 5.0] and flows[0].belgium_net_import_mw == 0.0
    assert spark.read.parquet(saved["prices"]).where("belgium_day_ahead_price_eur_mwh is null").count() == 6
    assert spark.read.parquet(saved["scheduled_exchanges"]).first().scheduled_net_import_mw == 2.0
    roll = collect.overall_status(spark.read.parquet(saved["status"])).first()
    assert (roll.overall_status, roll.successful_items, roll.failed_or_unavailable_items) == ("partial", 3, 1)
    with pytest.raises(GuardError):
        collect.market_collection(d.where("border = 'belgium'"), ["belgium"], str(tmp_path / "none"))


def test_tables_by_suffix_and_empty_refusal(spark, frame, tmp_path):
    df = frame([("2026-01-01 00:00:00", 1)], "timestamp string, v int")
    for suffix in (".parquet", ".csv", ".json"):
        path = tables.write_table(df, str(tmp_path / f"t{suffix}"))
        assert tables.read_table(spark, path).count() == 1
    with pytest.raises(GuardError, match="empty"):
        tables.write_table(df.where("v > 1"), str(tmp_path / "e.parquet"))
    assert tables.read_if_present(spark, str(tmp_path / "nothing")) is None
    bad = frame([("soon",)], "timestamp string")
    assert tables.keyed_by_instant(bad, strict=False).count() == 0
    with pytest.raises(Exception, match="invalid time"):
        tables.keyed_by_instant(bad).collect()


def test_preset_window_needs_both_dates(frame):
    recs = src.records(frame([('[{"settlement_date": "2026-01-01", "x": 1}]',)], "payload string"))
    row = collect.preset_source(recs, "inertia_cost", "2026-01-01", "2026-01-02").first()
    assert row.x == "1" and str(row.settlement_date) == "2026-01-01 00:00:00"
    with pytest.raises(ValueError):
        collect.preset_source(recs, "inertia_cost", "2026-01-01")
    with pytest.raises(GuardError):
        collect.preset_source(recs, "inertia_cost", "2027-01-01", "2027-01-02")


def test_trim_window_rules(frame):
    start, end = F.lit("2026-01-02").cast("timestamp"), F.lit("2026-01-03").cast("timestamp")
    make = lambda *t: frame([(x,) for x in t], "t string", ["t"])
    assert quality.trim_window(make("2026-01-02 00:00:00", "2026-01-03 00:00:00"), "t", start, end).count() == 1
    for bad in (make("2026-01-02 00:00:00", "2026-01-09 00:00:00"), make("2026-01-03 00:00:00"), make("2026-01-02 00:00:00", None)):
        with pytest.raises(GuardError):
            quality.trim_window(bad, "t", start, end)


def test_bounds_profiles_and_guards(frame):
    df = frame([(-1.0, -2.0, "full"), (3.0, 4.0, "full")], "demand_mw double, net_import_mw double, model_profile string")
    got = quality.physical_bounds(df, ["demand_mw", "net_import_mw"]).collect()
    assert [(r.demand_mw, r.net_import_mw) for r in got] == [(0.0, -2.0), (3.0, 4.0)]
    assert quality.clip_counts(df, ["demand_mw", "net_import_mw"]).first().asDict() == {"demand_mw": 1, "net_import_mw": 0}
    with pytest.raises(Exception, match="nulls: demand_mw"):
        quality.physical_bounds(df.withColumn("demand_mw", F.lit(None).cast("double")), ["demand_mw"]).collect()
    with pytest.raises(MissingColumns):
        quality.component_profile(df)
    with pytest.raises(GuardError, match="inconsistent"):
        quality.component_profile(df.withColumn("model_profile", F.when(F.col("demand_mw") > 0, "full").otherwise("x")))
    assert quality.component_profile(df.drop("model_profile"))[1] == ["demand_mw", "net_import_mw"]
    for wrong in (["demand_mw"], ["nope"], []):
        with pytest.raises(GuardError):
            quality.require_components(wrong)
    with pytest.raises(MissingColumns):
        quality.mapped({"a": "REQUIRED_X"}, "a")


def test_audit_isolates_tables_that_fail_when_opened_or_read(spark, frame, tmp_path):
    df = frame([("2026-01-01", 1.0), ("2026-01-01", 1.0), (None, None)], "timestamp string, v double")
    for name in ("whole", "cut"):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    part = next((tmp_path / "cut").glob("part-*.parquet"))
    part.write_bytes(part.read_bytes()[:-40])
    for crc in (tmp_path / "cut").glob(".part-*.crc"):
        crc.write_bytes(b"")  # the checksum file is not what must catch it
    tables_of = {"good": df, "whole": lambda: spark.read.parquet(str(tmp_path / "whole")), "cut": spark.read.schema(df.schema).parquet(str(tmp_path / "cut")),
                 "absent": lambda: spark.read.parquet(str(tmp_path / "absent")), "bad": ValueError("token=secret  broken")}
    rows = {r.table_name: r for r in quality.audit_tables(spark, tables_of).collect()}
    for name in ("good", "whole"):
        g = rows[name]
        assert (g.row_count, g.duplicate_rows, g.null_cells, g.invalid_timestamps, g.duplicate_timestamps) == (3, 1, 2, 1, 1) and g.error is None
    assert g.null_counts == {"timestamp": 1, "v": 1} and g.data_types == {"timestamp": "string", "v": "double"} and len(g.sample) == 2
    assert rows["good"].sample[0] == '{"timestamp":"2026-01-01","v":1.0}'
    assert "secret" not in rows["bad"].error and all(rows[n].row_count is None and rows[n].error for n in ("bad", "cut", "absent"))
    assert quality.sample_rows(df).first().sample == '{"timestamp":"2026-01-01","v":1.0}'


def test_audit_cancels_what_takes_too_long(spark):
    import time
    slow = spark.range(8, numPartitions=2).mapInPandas(lambda it: (time.sleep(15) or x for x in it), "id long")
    rows = {r.table_name: r for r in quality.audit_tables(spark, {"slow": slow, "quick": spark.range(5)}, seconds=6.0).collect()}
    assert rows["quick"].row_count == 5 and "cancelled" in rows["slow"].error


def test_profile_is_one_scan_and_tells_rows_apart(frame):
    df = frame([(None, 1, "x"), (1, None, "x"), (1, None, "x")], "a int, b int, c string")
    p = quality.table_profile(df, "t")
    row = p.first()
    assert (row.row_count, row.duplicate_rows, row.null_cells, row.timestamp_column) == (3, 1, 3, None)
    assert quality.table_profile(df.limit(0), "t").first().row_count == 0
    nested = df.selectExpr("map('k', a) AS m", "struct(b, c) AS s", "array(a) AS l")
    assert quality.table_profile(nested, "t").first().duplicate_rows == 1


def test_join_guards(frame):
    a, b = frame([(1, 1.0), (1, 2.0)], "k int, v double"), frame([(1, 1.0)], "k int, w double")
    with pytest.raises(GuardError):
        rel.join_one_to_one(a, b, ["k"])
    with pytest.raises(GuardError):
        rel.join_many_to_one(b, a, ["k"])
    with pytest.raises(GuardError):
        rel.require_no_conflicts(a, ["k"])
    rel.require_no_conflicts(frame([(1, None), (1, None)], "k int, v double"), ["k"])
    with pytest.raises(GuardError):
        rel.require_aligned(a, b, ["k"])
    mapping = frame([("REPLACE_X", "battery", 1)], "bm_unit string, technology string, sign int")
    with pytest.raises(GuardError, match="placeholder"):
        rel.require_reviewed_mapping(mapping)
    with pytest.raises(GuardError, match="no battery"):
        rel.require_reviewed_mapping(frame([("U", "gas", 1)], "bm_unit string, technology string, sign int"))
