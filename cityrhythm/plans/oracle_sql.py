"""Portable SQL texts of the facades, used to check each operator with an
independent engine (DuckDB) on the same Parquet tables.

Conventions: sums are cast to BIGINT and date parts to INTEGER, ratios are
computed in DOUBLE, denominators go through NULLIF, and every LIMIT has a
unique tie-break. These texts are test oracles only; the engine itself is
the DataFrame code.
"""

from __future__ import annotations

from cityrhythm import dims

WD = dims.WEEKDAY
WE = dims.WEEKEND

CUST = """cust AS (
  SELECT c.c_custkey, c.c_mktsegment AS line_name, n.n_name AS station_poi_desc_cd,
         CASE WHEN c.c_mktsegment = 'MACHINERY' THEN NULL ELSE r.r_name END AS town
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

LOOKUP = """lookup AS (
  SELECT n.n_name AS istasyon, r.r_name AS ilce
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE n.n_nationkey <> 3
)"""


def _calendar(ts: str) -> str:
    return (f"CAST(year({ts}) AS INTEGER) AS yil, CAST(month({ts}) AS INTEGER) AS ay,\n"
            f"         CAST(isodow({ts}) AS INTEGER) AS haftanin_gunu,\n"
            f"         CASE WHEN isodow({ts}) <= 5 THEN '{WD}' ELSE '{WE}' END AS gun_tipi")


TRIPS_E = f"""trips AS (
  SELECT CAST(e.ts AS DATE) AS transition_date,
         CAST(hour(e.ts) AS TINYINT) AS transition_hour,
         CASE e.user_id % 3 WHEN 0 THEN 'OTOYOL' WHEN 1 THEN 'RAYLI' ELSE 'DENIZ' END AS road_type,
         e.event_type AS product_kind,
         k.line_name, k.station_poi_desc_cd, k.town,
         CAST(ROUND(e.value * 100.0) AS BIGINT) AS number_of_passenger,
         CAST(ROUND(e.value * 100.0) AS BIGINT)
           + CASE WHEN e.event_id % 12 = 0 THEN 1 ELSE 0 END AS number_of_passage,
         {_calendar('e.ts')}
  FROM events e JOIN cust k ON e.user_id = k.c_custkey
)"""

TRIPS_O = f"""trips AS (
  SELECT CAST(o.o_orderdate AS DATE) AS transition_date,
         CAST(o.o_orderkey % 24 AS TINYINT) AS transition_hour,
         CASE o.o_custkey % 3 WHEN 0 THEN 'OTOYOL' WHEN 1 THEN 'RAYLI' ELSE 'DENIZ' END AS road_type,
         o.o_orderpriority AS product_kind,
         k.line_name, k.station_poi_desc_cd, k.town,
         CAST(ROUND(o.o_totalprice) AS BIGINT) AS number_of_passenger,
         CAST(ROUND(o.o_totalprice) AS BIGINT)
           + CASE WHEN o.o_orderkey % 12 = 0 THEN 1 ELSE 0 END AS number_of_passage,
         {_calendar('o.o_orderdate')}
  FROM orders o JOIN cust k ON o.o_custkey = k.c_custkey
)"""

# B3 as SQL: completed district of rail rows (both facades).
RAIL = """rail AS (
  SELECT t.*, COALESCE(t.town, m.ilce) AS ilce
  FROM trips t LEFT JOIN lookup m
    ON t.line_name = 'MACHINERY' AND t.station_poi_desc_cd = m.istasyon
  WHERE t.road_type = 'RAYLI'
)"""


def facade_sql(facade: str, select: str, ctes: list[str] | None = None) -> str:
    """Compose ``WITH cust, trips, lookup[, rail], <ctes> <select>``."""
    trips = {"E": TRIPS_E, "O": TRIPS_O}[facade]
    parts = [CUST, trips, LOOKUP, RAIL] + list(ctes or [])
    return "WITH " + ",\n".join(parts) + "\n" + select.strip()
