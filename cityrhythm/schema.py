"""Data contract of the hourly transport files.

Raw monthly CSV: header + exactly these 13 columns in this order. The clean
table keeps names and order, with hour / mode id as tinyint, the two counts
as int and blank text in four columns turned into NULL.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The raw column contract, in file order.
RAW_COLUMNS = [
    "transition_date", "transition_hour", "transport_type_id", "road_type",
    "line", "transfer_type", "number_of_passage", "number_of_passenger",
    "product_kind", "transaction_type_desc", "town", "line_name",
    "station_poi_desc_cd",
]

# Everything is read as text first; types are applied explicitly by the
# cleaner (schema inference would turn the hour "00" into an int and guess
# differently per file).
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

CLEAN_SCHEMA = T.StructType([
    T.StructField("transition_date", T.DateType(), True),
    T.StructField("transition_hour", T.ByteType(), True),
    T.StructField("transport_type_id", T.ByteType(), True),
    T.StructField("road_type", T.StringType(), True),
    T.StructField("line", T.StringType(), True),
    T.StructField("transfer_type", T.StringType(), True),
    T.StructField("number_of_passage", T.IntegerType(), True),
    T.StructField("number_of_passenger", T.IntegerType(), True),
    T.StructField("product_kind", T.StringType(), True),
    T.StructField("transaction_type_desc", T.StringType(), True),
    T.StructField("town", T.StringType(), True),
    T.StructField("line_name", T.StringType(), True),
    T.StructField("station_poi_desc_cd", T.StringType(), True),
])

# Text columns whose blanks become NULL (the others are kept verbatim).
BLANK_TO_NULL = ("line", "town", "line_name", "station_poi_desc_cd")

# Partition column of the clean store: YYYYMM taken from the source file name,
# so a year scope prunes whole files exactly like a file-name glob.
PERIOD_COL = "yilay"
SOURCE_COL = "kaynak_dosya"

# Calendar columns added by the trips view.
CALENDAR_COLUMNS = ["yil", "ay", "haftanin_gunu", "gun_tipi"]

# Columns every analytical operator may use (row-level trips or the roll-up).
TRIP_COLUMNS = [
    "transition_date", "transition_hour", "road_type", "product_kind",
    "line_name", "station_poi_desc_cd", "town",
    "number_of_passenger", "number_of_passage",
    "yil", "ay", "haftanin_gunu", "gun_tipi",
]

LOOKUP_SCHEMA = T.StructType([
    T.StructField("istasyon", T.StringType(), True),
    T.StructField("ilce", T.StringType(), True),
])
