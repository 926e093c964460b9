"""cityrhythm — hourly public-transport rhythm analytics on Spark.

Layout:
  session      SparkSession builder and the shared checkpoint folder
  schema       raw CSV contract, clean schema, trips columns
  dims         fixed dimensions (special days, periods, card / weekday / month labels)
  model        trips view over the clean table, and the two test facades
  functions/   column-level helpers (trim, calendar, rounding, name normaliser)
  sources/     raw CSV, clean Parquet store, station lookup, GeoJSON boundaries
  operators/   ingest + quality, enrichment, profiles, windows, districts, geo, k-means
  plans/       hourly roll-up, query registry with oracle SQL
  streaming/   incremental ingest with Structured Streaming (availableNow)
  reports      report jobs writing the data behind each output as Parquet tables
"""

__version__ = "0.1.0"
