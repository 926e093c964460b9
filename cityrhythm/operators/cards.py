"""Card kinds and periods: card share (C7), period share (C25), Ramadan
profile (C26), period lift (C27), evening order (C28)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityrhythm import dims
from cityrhythm.functions import ratio, round_half_away
from cityrhythm.operators import P
from cityrhythm.operators.enrich import in_range, tag_periods


def card_share(trips: DataFrame, kinds: Sequence[str] = dims.CARD_KINDS) -> DataFrame:
    """Weekday hourly passengers per card kind and the % of the kind's own total."""
    g = (trips.where((F.col("gun_tipi") == F.lit(dims.WEEKDAY)) & F.col("product_kind").isin(list(kinds)))
         .groupBy(F.col("product_kind").alias("kart"), F.col("transition_hour").alias("saat"))
         .agg(F.sum(P).alias("yolcu")))
    tot = F.sum("yolcu").over(Window.partitionBy("kart"))
    return g.select("kart", "saat", "yolcu",
                    round_half_away(ratio(F.col("yolcu"), tot, 100.0), 2).alias("gun_ici_pay_pct"))


def period_share(trips: DataFrame, card: str = dims.STUDENT_CARD,
                 months: tuple[int, int] = (dims.SCHOOL_MONTH, dims.SUMMER_MONTH),
                 labels: tuple[str, str] = (dims.SCHOOL_LABEL, dims.SUMMER_LABEL)) -> DataFrame:
    """One card kind's weekday hour share (%) in two months (school vs summer)."""
    first, second = months
    g = (trips.where((F.col("gun_tipi") == F.lit(dims.WEEKDAY)) & (F.col("product_kind") == F.lit(card))
                     & F.col("ay").isin(first, second))
         .groupBy(F.when(F.col("ay") == first, F.lit(labels[0])).otherwise(F.lit(labels[1])).alias("donem"),
                  F.col("transition_hour").alias("saat"))
         .agg(F.sum(P).alias("yolcu")))
    tot = F.sum("yolcu").over(Window.partitionBy("donem"))
    return g.select("donem", "saat", ratio(F.col("yolcu"), tot, 100.0).alias("pay"))


def period_profile(trips: DataFrame, period: dims.Period,
                   labels: tuple[str, str] = (dims.RAMADAN_LABEL, dims.NORMAL_LABEL)) -> DataFrame:
    """Weekday mean per hour inside the period vs the rest of the analysis
    window of the same year, holiday range left out."""
    d = F.col("transition_date")
    base = trips.where((F.col("yil") == F.lit(period.year)) & (F.col("gun_tipi") == F.lit(dims.WEEKDAY))
                       & in_range(d, period.window_start, period.window_end)
                       & ~in_range(d, period.excluded[0], period.excluded[1]))
    donem = F.when(in_range(d, period.start, period.end), F.lit(labels[0])).otherwise(F.lit(labels[1]))
    daily = base.groupBy(donem.alias("donem"), "transition_date", "transition_hour").agg(F.sum(P).alias("yolcu"))
    return daily.groupBy("donem", F.col("transition_hour").alias("saat")).agg(F.avg("yolcu").alias("ort"))


def _evening(col: str = "saat"):
    return (F.col(col) >= 20) | (F.col(col) <= 5)


def period_lift(trips: DataFrame, periods) -> DataFrame:
    """Per year and evening/night hour (>= 20 or <= 5),
    ``100 * (mean in period / mean outside - 1)``. Hours present on only one
    side drop out. One conditional aggregation instead of a self-join.
    ``periods``: list of :class:`dims.Period` or the period DataFrame (B5)."""
    tagged = tag_periods(trips.where(F.col("gun_tipi") == F.lit(dims.WEEKDAY)), periods)
    tagged = tagged.where(_evening("transition_hour"))
    daily = tagged.groupBy("yil", "donem", "transition_date", "transition_hour").agg(F.sum(P).alias("yolcu"))
    m = daily.groupBy("yil", F.col("transition_hour").alias("saat")).agg(
        F.avg(F.when(F.col("donem") == "ramazan", F.col("yolcu"))).alias("r"),
        F.avg(F.when(F.col("donem") == "normal", F.col("yolcu"))).alias("n"))
    return (m.where(F.col("r").isNotNull() & F.col("n").isNotNull())
            .select("yil", "saat", (F.lit(100.0) * (F.try_divide("r", "n") - F.lit(1.0))).alias("fark_pct")))


def evening_spine(lift: DataFrame, years: Sequence[int], order: Sequence[int] = dims.EVENING_ORDER) -> DataFrame:
    """The fixed evening order 20..23, 0..5 for every period year, left
    joined to the lift; a missing hour shows as NULL ``fark_pct``. The spine
    (years x 10 hours) is a literal local relation."""
    schema = T.StructType([T.StructField("yil", T.IntegerType()), T.StructField("sira", T.IntegerType()),
                           T.StructField("saat", T.ByteType())])
    spine = dims.literal_df(lift.sparkSession, [(int(y), i, int(h)) for y in years for i, h in enumerate(order)], schema)
    return spine.join(lift, ["yil", "saat"], "left").select("yil", "sira", "saat", "fark_pct")


def assert_evening_complete(spine: DataFrame) -> None:
    """Strict form of C28: every spine hour must have a value (raises otherwise).

    Collects only the missing (year, hour) pairs, at most years x 10.
    """
    missing = spine.where(F.col("fark_pct").isNull()).select("yil", "saat").collect()
    if missing:
        raise KeyError(f"evening hours without a value: {[(r['yil'], r['saat']) for r in missing]}")
