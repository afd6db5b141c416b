"""XML market-document readers: one document per row, expanded to one row per point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from settlespark.functions import clock, values
from settlespark.operators.series import to_half_hourly

VALUE_FIELDS = ["price.amount", "quantity"]
STEPS = (15, 30, 60)  # minutes that become half-hours
SCHEMA = """
createdDateTime string,
TimeSeries array<struct<
  mRID: string, businessType: string, `in_Domain.mRID`: string, `out_Domain.mRID`: string,
  `contract_MarketAgreement.type`: string, curveType: string, MktPSRType: struct<psrType: string>,
  psrType: string, `currency_Unit.name`: string, `price_Measure_Unit.name`: string,
  `quantity_Measure_Unit.name`: string,
  Period: array<struct<
    timeInterval: struct<start: string>, resolution: string,
    Point: array<struct<position: string, `price.amount`: string, quantity: string>>>>>>,
Reason array<struct<code: string, text: string>>
"""


def _doc(xml: str) -> Column:
    return F.from_xml(xml, SCHEMA, {"ignoreNamespace": "true"})


def _acknowledged(xml: str) -> Column:
    return F.col(xml).rlike(r"<(\w+:)?Acknowledgement_MarketDocument[\s>]")


def _reason(doc: Column) -> Column:
    codes = F.array_join(F.transform(doc["Reason"], lambda r: r["code"]), ",")
    texts = F.array_join(F.transform(doc["Reason"], lambda r: r["text"]), "; ")
    return F.concat_ws(": ", F.nullif(codes, F.lit("")), F.coalesce(F.nullif(texts, F.lit("")), F.lit("acknowledgement document")))


def _fault(doc: Column) -> Column:
    """Why the points of a document cannot be read: a step that is no half-hour's, or a position that is no number."""
    periods = F.flatten(F.transform(doc["TimeSeries"], lambda s: s["Period"]))
    read = F.filter(periods, lambda p: p["timeInterval"]["start"].isNotNull() & p["resolution"].isNotNull())
    steps = F.filter(F.transform(read, lambda p: p["resolution"]), lambda r: ~F.coalesce(clock.duration_minutes(r, strict=False).isin(*STEPS), F.lit(False)))
    places = F.filter(F.flatten(F.transform(read, lambda p: p["Point"])), lambda x: x["position"].isNotNull() & x["position"].try_cast("int").isNull())
    return F.when(F.size(steps) > 0, F.concat(F.lit("unsupported step "), steps[0])).when(
        F.size(places) > 0, F.concat(F.lit("unreadable position "), places[0]["position"]))


def parsed(docs: DataFrame, xml: str = "xml", keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, the document ``d`` and whether it is an acknowledgement; each text is parsed once.

    The parse is a generator: filters on what it gives are not pushed below it, where they would parse
    the text again.
    """
    return docs.select(*keep, _acknowledged(xml).alias("acknowledged"), F.explode_outer(F.array(_doc(xml))).alias("d"))


def _state(d: Column, acknowledged: Column) -> tuple[Column, Column]:
    """Status and message of a parsed document."""
    series = F.coalesce(F.size(d["TimeSeries"]), F.lit(0))
    blank, fault = d["createdDateTime"].isNull() & (series <= 0) & d["Reason"].isNull(), _fault(d)
    status = F.when(acknowledged, "unavailable").when(blank | fault.isNotNull(), "failed").when(series <= 0, "no_rows").otherwise("success")
    return status, F.when(acknowledged, values.redacted(_reason(d))).otherwise(values.redacted(fault))


def status_of(d: Column, acknowledged: Column) -> Column:
    return _state(d, acknowledged)[0]


def point_count(d: Column, value_field: str) -> Column:
    """How many rows ``timeseries_points`` makes of a parsed document; none where it has a fault."""
    periods = F.flatten(F.transform(d["TimeSeries"], lambda s: s["Period"]))
    read = F.filter(periods, lambda p: clock.parse_instant(p["timeInterval"]["start"]).isNotNull() & p["resolution"].isNotNull())
    points = F.filter(F.flatten(F.transform(read, lambda p: p["Point"])), lambda x: x["position"].isNotNull() & values.number(x[value_field]).isNotNull())
    return F.when(_fault(d).isNull(), F.greatest(F.size(points), F.lit(0))).otherwise(0)


def document_status(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Classify documents without failing: success, no_rows, unavailable or failed."""
    status, message = _state(F.col("d"), F.col("acknowledged"))
    return parsed(docs, xml, docs.columns).withColumns({"status": status, "message": message}).drop("d", "acknowledged")


def timeseries_points(
    docs: DataFrame, value_field: str, out: str, xml: str = "xml", keep: Sequence[str] = (), strict: bool = True,
) -> DataFrame:
    """Points as ``start + (position - 1) * resolution``.

    Points without position or value are skipped. With ``strict`` an acknowledgement
    document is an error that carries its reason, and so is an odd step or position;
    otherwise such a document yields no rows and hides no other one, see ``document_status``.
    """
    return points_of(parsed(docs, xml, keep), value_field, out, keep, strict)


def points_of(read: DataFrame, value_field: str, out: str, keep: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """``timeseries_points`` of documents that are ``parsed`` already."""
    if strict:
        refusal = F.raise_error(F.concat(F.lit("source refused: "), _reason(F.col("d")))).cast("boolean")
        d = read.where(F.when(F.col("acknowledged"), refusal).otherwise(True))
    else:
        d = read.where(_fault(F.col("d")).isNull())
    series = d.select(
        *keep, F.col("d.createdDateTime").alias("_made"), F.explode_outer("d.TimeSeries").alias("s")
    ).where("s is not null")
    named = {
        "series_id": "s.mRID", "business_type": "s.businessType", "in_domain": "s.`in_Domain.mRID`",
        "out_domain": "s.`out_Domain.mRID`", "contract_type": "s.`contract_MarketAgreement.type`",
        "curve_type": "s.curveType", "currency": "s.`currency_Unit.name`",
    }
    labels = {n: F.col(c) for n, c in named.items()} | {
        "psr_type": F.coalesce("s.psrType", "s.MktPSRType.psrType"),
        "measure_unit": F.coalesce("s.`price_Measure_Unit.name`", "s.`quantity_Measure_Unit.name`"),
    }
    periods = series.select(*keep, "_made", *[c.alias(n) for n, c in labels.items()], F.explode_outer("s.Period").alias("p"))
    # Start and step are read once per period, before its points multiply the rows.
    timed = periods.where("p.timeInterval.start is not null and p.resolution is not null").select(
        *keep, *labels, clock.parse_instant("_made").alias("published_at_utc"),
        F.unix_micros(clock.parse_instant("p.timeInterval.start")).alias("_start"),
        clock.duration_minutes("p.resolution", strict).alias("resolution_minutes"), F.explode_outer("p.Point").alias("pt"),
    )
    value = F.col(f"pt.`{value_field}`")
    step = F.col("resolution_minutes").cast("long") * 60_000_000
    return (
        timed.where(F.col("pt.position").isNotNull() & value.isNotNull())
        .select(
            *keep, F.timestamp_micros(F.col("_start") + ((F.col("pt.position").cast("int") if strict else F.col("pt.position").try_cast("int")) - 1) * step).alias("timestamp"),
            values.number(value).alias(out), "resolution_minutes", "published_at_utc", *labels,
        )
        .dropna(subset=["timestamp", out])
    )


def _half_hourly(docs, field, out, xml, keep, strict) -> DataFrame:
    points = timeseries_points(docs, field, out, xml, keep, strict)
    return to_half_hourly(points, out, domains=[*keep, "in_domain", "out_domain"])


def day_ahead_prices(docs: DataFrame, xml: str = "xml", keep: Sequence[str] = (), strict: bool = True) -> DataFrame:
    return _half_hourly(docs, "price.amount", "price_eur_mwh", xml, keep, strict)


def physical_flows(docs: DataFrame, xml: str = "xml", keep: Sequence[str] = (), strict: bool = True) -> DataFrame:
    return _half_hourly(docs, "quantity", "flow_mw", xml, keep, strict)


def scheduled_exchanges(docs: DataFrame, xml: str = "xml", keep: Sequence[str] = (), strict: bool = True) -> DataFrame:
    return _half_hourly(docs, "quantity", "scheduled_exchange_mw", xml, keep, strict)
