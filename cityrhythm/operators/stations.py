"""Station-level operators: peak hour (C2), share profile (C14), matrix.

Rail only (the station is the real grain there), weekday, station present.
Windows are partitioned by station, so they run spread over tasks; each
partition holds at most 24 rows after the hourly aggregation.
"""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityrhythm import dims
from cityrhythm.functions import ratio, round_half_away
from cityrhythm.operators import P
from cityrhythm.operators.profiles import pivot_hours


def _rail_weekday_stations(trips: DataFrame, rail: str) -> DataFrame:
    return trips.where((F.col("road_type") == F.lit(rail))
                       & F.col("station_poi_desc_cd").isNotNull()
                       & (F.col("gun_tipi") == F.lit(dims.WEEKDAY)))


def station_peak(trips: DataFrame, rail: str = dims.RAIL) -> DataFrame:
    """Each (line, station)'s peak hour, its passengers, the station total
    and the peak share %. Ties on passengers go to the earlier hour."""
    g = (_rail_weekday_stations(trips, rail)
         .groupBy(F.col("line_name").alias("hat"), F.col("station_poi_desc_cd").alias("istasyon"),
                  F.col("transition_hour").alias("saat"))
         .agg(F.sum(P).alias("yolcu")))
    w = Window.partitionBy("hat", "istasyon")
    ranked = g.select("*",
                      F.row_number().over(w.orderBy(F.col("yolcu").desc(), F.col("saat").asc())).alias("sira"),
                      F.sum("yolcu").over(w).alias("istasyon_toplam"))
    return ranked.where(F.col("sira") == 1).select(
        "hat", "istasyon",
        F.col("saat").alias("zirve_saat"),
        F.col("yolcu").alias("zirve_saat_yolcu"),
        "istasyon_toplam",
        round_half_away(ratio("yolcu", "istasyon_toplam", 100.0), 1).alias("zirve_pay_pct"),
    )


def station_share(trips: DataFrame, rail: str = dims.RAIL,
                  min_total: int = dims.STATION_MIN_TOTAL) -> DataFrame:
    """C14: hour share of each station's own weekday total, for stations whose
    total exceeds ``min_total``. Key 'line / station'; rows without a line are
    dropped (their key would be NULL)."""
    key = F.concat(F.col("line_name"), F.lit(" / "), F.col("station_poi_desc_cd"))
    g = (_rail_weekday_stations(trips, rail).where(F.col("line_name").isNotNull())
         .groupBy(key.alias("istasyon"), F.col("transition_hour").alias("saat"))
         .agg(F.sum(P).alias("yolcu")))
    tot = F.sum("yolcu").over(Window.partitionBy("istasyon"))
    return (g.select("istasyon", "saat", "yolcu", tot.alias("_tot"))
            .where(F.col("_tot") > F.lit(min_total))
            .select("istasyon", "saat", ratio("yolcu", "_tot", 1.0).alias("pay")))


def station_matrix(share: DataFrame) -> DataFrame:
    """Stations x 24 hour columns of shares, a missing hour = 0."""
    return pivot_hours(share, "istasyon", "pay", fill=0.0)


#: The two results of :func:`cluster_stations`.
CLUSTER_SCHEMAS = ("kume int, kume_adi string, sira int, boyut long, oran double, profil array<double>, maliyet double",
                   "istasyon string, kume int, kume_adi string")


# --- C16 / C17: station clustering -------------------------------------------

#: Shares are summed as whole numbers of this unit, and costs of that: sums of integers don't depend on the order.
SHARE_UNIT, COST_UNIT = 1e12, 1e15
EVENING, MORNING = dims.EVENING_HOURS, dims.MORNING_HOURS


def _distances(x: Column, centres: list[list[list[float]]]) -> Column:
    """Squared distances of a profile to each centre of each start, the hours added in order."""
    def to(c: Column) -> Column:
        return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    # as one literal: building the numbers one by one would take the driver longer than the job
    given = F.from_json(F.lit(json.dumps(centres)), "array<array<array<double>>>")
    return F.transform(given, lambda start: F.transform(start, to))


def _whole(x: Column, unit: float) -> Column:
    return F.floor(x * F.lit(unit) + F.lit(0.5))


def _first_centres(points: DataFrame, k: int, n_init: int, seed: int) -> list[list[list[float]]]:
    """For each start ``k`` centres: a station in the order of a hash, then always that farthest from the centres so far."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("istasyon")))
    centres = [[list(r["x"])] for r in points.orderBy(order, "istasyon").limit(n_init).collect()]
    for _ in range(k - 1 if centres else 0):
        near = points.select("istasyon", "x", F.posexplode(F.transform(_distances(F.col("x"), centres), F.array_min)).alias("start", "d"))
        far = near.groupBy("start").agg(F.max(F.struct("d", "istasyon", "x")).alias("far")).collect()      # a row a start
        for r in far:
            centres[r["start"]].append(list(r["far"]["x"]))
    return centres


def cluster_stations(matrix: DataFrame, k: int = 4, n_init: int = 10, seed: int = 42, max_iter: int = 300):
    """K-means on the station x hour share matrix, the best of ``n_init``
    starts by cost. C17: clusters named by the ratio of the mean profile's
    evening (16-19) to morning (6-9) share, ascending.

    All starts advance together: an iteration is one job, a single aggregation
    over (start, centre) of the shares' sums, and the driver keeps the centres
    alone (starts x k x 24 numbers). The start points are given by a rule (a
    station by hash order, then the farthest ones, ties to the greatest name),
    sums are of integers, the nearest centre is the first of equals and the best
    start the first of equals, so the result depends on neither partitioning nor
    engine. A centre that loses all stations stays where it is. It ends when no
    centre moves, or after ``max_iter`` iterations. With fewer distinct stations
    than ``k`` there are as many clusters as these; a null name is a station.

    Returns (clusters, members): clusters = (kume, kume_adi, sira, boyut, oran,
    profil array<double>[24], maliyet = cost of the chosen start); members =
    (istasyon, kume, kume_adi).
    """
    from cityrhythm.operators.profiles import hour_columns

    hours = hour_columns()
    points = matrix.select("istasyon", F.array(*[F.col(h).cast("double") for h in hours]).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    sums = [F.sum(_whole(F.col("x")[h], SHARE_UNIT)).alias(name) for h, name in enumerate(hours)]

    def nearest(d: Column) -> Column:
        return F.array_position(d, F.array_min(d)) - 1

    centres = _first_centres(points, k, n_init, seed)
    if not centres:
        raise ValueError("no station to cluster")
    for _ in range(max_iter):
        labels = points.select("x", F.posexplode(F.transform(_distances(F.col("x"), centres), nearest)).alias("start", "kume"))
        moved = False
        for r in labels.groupBy("start", "kume").agg(F.count(F.lit(1)).alias("n"), *sums).collect():     # a row a centre
            new = [float(r[h]) / r["n"] / SHARE_UNIT for h in hours]
            moved |= new != centres[r["start"]][r["kume"]]
            centres[r["start"]][r["kume"]] = new
        if not moved:
            break
    costs = (points.select(F.posexplode(F.transform(_distances(F.col("x"), centres), F.array_min)).alias("start", "d"))
             .groupBy("start").agg(F.sum(_whole(F.col("d"), COST_UNIT).cast("decimal(20,0)")).alias("cost")).collect())
    cost, start = min((r["cost"], r["start"]) for r in costs)

    d = _distances(F.col("x"), [centres[start]])[0]
    members = points.select("istasyon", "x", nearest(d).cast("int").alias("kume"))
    prof = members.groupBy("kume").agg(F.count(F.lit(1)).alias("boyut"), *sums)
    prof = prof.select("kume", "boyut", *[(F.col(h).cast("double") / F.col("boyut") / F.lit(SHARE_UNIT)).alias(h) for h in hours])
    ev = sum((F.col(f"h{h}") for h in range(EVENING[0] + 1, EVENING[1] + 1)), F.col(f"h{EVENING[0]}"))
    mo = sum((F.col(f"h{h}") for h in range(MORNING[0] + 1, MORNING[1] + 1)), F.col(f"h{MORNING[0]}"))
    prof = prof.select("kume", "boyut", F.try_divide(ev, mo).alias("oran"), F.array(*[F.col(h) for h in hours]).alias("profil"),
                       F.lit(float(cost) / COST_UNIT).alias("maliyet"))
    names = F.array(*[F.lit(n) for n in dims.CLUSTER_NAMES])
    ranked = prof.select("*", F.row_number().over(
        Window.orderBy(F.col("oran").asc_nulls_last(), F.col("kume").asc())).alias("sira"))   # k rows
    clusters = ranked.select("kume", F.try_element_at(names, F.col("sira")).alias("kume_adi"),
                             "sira", "boyut", "oran", "profil", "maliyet")
    named = members.join(clusters.select("kume", "kume_adi"), "kume").select("istasyon", "kume", "kume_adi")
    return clusters, named


def cluster_profiles(clusters: DataFrame) -> DataFrame:
    """C17 for a chart or table: name, rank, size and ratio of each cluster with its mean profile as 24 hour columns."""
    return clusters.select("kume_adi", "sira", "boyut", "oran", *[F.col("profil")[h].alias(f"h{h}") for h in range(24)], "maliyet")
