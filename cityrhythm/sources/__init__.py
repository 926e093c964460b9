"""Sources and sinks: driver tables, raw CSV, clean Parquet store, lookup, GeoJSON."""
