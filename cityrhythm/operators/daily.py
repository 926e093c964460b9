"""Daily series: moving average (C4), anomaly z-score (C10), anomaly labels
(C11), series annotations (C12).

The series has one row per day (per entity when ``by`` is given), so after
the first aggregation the windows see calendar-bounded data; with ``by`` they
are partitioned per entity and spread over tasks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityrhythm import dims
from cityrhythm.functions import ratio, round_half_away
from cityrhythm.operators import P


def daily_totals(trips: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return trips.groupBy(*by, "transition_date").agg(F.sum(P).alias("yolcu"))


def moving_avg(trips: DataFrame, by: Sequence[str] = (), days: int = 7) -> DataFrame:
    """C4: daily total, trailing ``days``-ROW mean (includes the day itself; the
    first rows use shorter frames; gaps are not filled) and % deviation from it."""
    d = daily_totals(trips, by)
    w = Window.partitionBy(*by).orderBy("transition_date").rowsBetween(-(days - 1), 0)
    ma = F.avg("yolcu").over(w)
    return d.select(
        *by, "transition_date", "yolcu",
        round_half_away(ma).alias("hareketli_ort_7g"),
        round_half_away(ratio(F.col("yolcu"), ma, 100.0) - F.lit(100.0), 1).alias("trendden_sapma_pct"),
    )


def anomaly(trips: DataFrame, by: Sequence[str] = (), z_limit: float = dims.ANOMALY_Z) -> DataFrame:
    """Z-score of each day's total against days of the same ISO weekday
    (sample stddev). A zero or undefined stddev gives NULL z, which is neither
    normal nor anomalous (``anomali`` NULL). ``z`` is rounded to 6 digits,
    ``z_ham`` is not."""
    d = trips.groupBy(*by, "transition_date", "haftanin_gunu").agg(F.sum(P).alias("yolcu"))
    w = Window.partitionBy(*by, "haftanin_gunu")
    z = F.try_divide(F.col("yolcu") - F.avg("yolcu").over(w), F.stddev_samp("yolcu").over(w))
    return (d.select(*by, "transition_date", "haftanin_gunu", "yolcu", z.alias("_z"))
            .select(*by, "transition_date", "haftanin_gunu", "yolcu",
                    round_half_away(F.col("_z"), 6).alias("z"), F.col("_z").alias("z_ham"),
                    (F.abs(F.col("_z")) >= F.lit(z_limit)).alias("anomali")))


def weekday_moments(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per ISO weekday (and ``by``): number, mean and sum of squared deviations of the daily totals.

    ``days`` has one row a day (``transition_date``, ``haftanin_gunu``, ``yolcu``), e.g. the kept daily
    totals of one month; moments of disjoint sets of days are united by :func:`merge_moments`.
    """
    n = F.count("yolcu")
    return days.groupBy(*by, "haftanin_gunu").agg(n.alias("n"), F.avg("yolcu").alias("ort"), (F.var_pop("yolcu") * n).alias("m2"))


def merge_moments(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moments of the union from moments of disjoint parts (weighted mean; second moments plus those of the means)."""
    w = Window.partitionBy(*by, "haftanin_gunu")        # one row a part: a month each
    mean = F.try_divide(F.sum(F.col("n") * F.col("ort")).over(w), F.sum("n").over(w))
    shifted = moments.select(*by, "haftanin_gunu", "n", mean.alias("ort"), (F.col("m2") + F.col("n") * (F.col("ort") - mean) * (F.col("ort") - mean)).alias("m2"))
    return shifted.groupBy(*by, "haftanin_gunu").agg(F.sum("n").alias("n"), F.first("ort").alias("ort"), F.sum("m2").alias("m2"))


def anomaly_of_moments(days: DataFrame, moments: DataFrame, by: Sequence[str] = (), z_limit: float = dims.ANOMALY_Z) -> DataFrame:
    """:func:`anomaly` for daily totals against kept moments: new days are judged without the rows behind the moments."""
    own = {"n": "_n", "ort": "_ort", "m2": "_m2"}
    m = moments.select(*by, "haftanin_gunu", *[F.col(c).alias(a) for c, a in own.items()])
    keys = [*by, "haftanin_gunu"]
    z = F.try_divide(F.col("yolcu") - F.col("_ort"), F.when(F.col("_n") > 1, F.sqrt(F.col("_m2") / (F.col("_n") - 1))))
    return (days.join(m, keys, "left").select(*by, "transition_date", "haftanin_gunu", "yolcu", round_half_away(z, 6).alias("z"), z.alias("z_ham"),
                                              (F.abs(z) >= F.lit(z_limit)).alias("anomali")))


def _special_map(special_days: Mapping) -> tuple[list[dt.date], Column | None]:
    days = sorted((dt.date.fromisoformat(str(d)) if not isinstance(d, dt.date) else d, lbl)
                  for d, lbl in special_days.items())
    if not days:
        return [], None
    return [d for d, _ in days], F.create_map(*[F.lit(x) for kv in days for x in kv])


def anomaly_labels(trips: DataFrame, special_days, top: int = dims.ANOMALY_DATE_LABELS,
                   z_limit: float = dims.ANOMALY_Z) -> DataFrame:
    """C11: every anomalous day with its label: the special-day name when known,
    else the short date text when the day is among the ``top`` largest unrounded
    |z| of all anomalies (ties by date), else NULL.

    ``special_days``: a fixed mapping date -> label (applied as a literal map,
    no join) or the special-day DataFrame (tarih, etiket), left joined."""
    an = anomaly(trips, z_limit=z_limit).where(F.col("anomali"))
    # top-k by |z|: TakeOrderedAndProject, at most ``top`` rows come back
    extreme = (an.orderBy(F.abs("z_ham").desc(), F.col("transition_date").asc()).limit(top)
               .select(F.col("transition_date").alias("_x_date"), F.lit(True).alias("_uc")))
    if isinstance(special_days, Mapping):
        _, m = _special_map(special_days)
        j = an.select("*", (m[F.col("transition_date")] if m is not None
                            else F.lit(None).cast("string")).alias("_s_etiket"))
    else:
        sd = special_days.select(F.col("tarih").alias("_s_date"), F.col("etiket").alias("_s_etiket"))
        j = an.join(sd, F.col("transition_date") == F.col("_s_date"), "left")
    j = j.join(extreme, F.col("transition_date") == F.col("_x_date"), "left")
    label = F.coalesce(F.col("_s_etiket"),
                       F.when(F.col("_uc"), dims.short_date("transition_date")))
    return j.select("transition_date", "haftanin_gunu", "yolcu", "z", label.alias("etiket"))


def series_annotations(trips: DataFrame, special_days) -> DataFrame:
    """Marked special days that exist in the data, with that day's total.

    ``special_days``: a fixed mapping date -> label of the days to mark (a
    date ``isin`` filter the scan can use, then a literal map for the label),
    or the special-day DataFrame with its ``seride`` flag (inner join)."""
    if isinstance(special_days, Mapping):
        dates, m = _special_map(special_days)
        if m is None:
            return daily_totals(trips).where(F.lit(False)).select(
                "transition_date", F.lit(None).cast("string").alias("etiket"), "yolcu")
        d = trips.where(F.col("transition_date").isin(dates))
        return daily_totals(d).select("transition_date", m[F.col("transition_date")].alias("etiket"), "yolcu")
    sd = special_days.where(F.col("seride")).select(F.col("tarih").alias("transition_date"), "etiket")
    return daily_totals(trips).join(sd, "transition_date", "inner").select("transition_date", "etiket", "yolcu")
