"""Fixed dimensions of the domain.

Every literal below is a value the results depend on (labels that appear in
outputs, calendar facts, thresholds). They are kept together here, in their
natural order, and turned into small DataFrames / column expressions on use.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: day type labels (ISO weekday 1..5 => weekday) -------------
WEEKDAY = "hafta içi"
WEEKEND = "hafta sonu"

# --- Fixed values: mode names ------------------------------------------------
RAIL = "RAYLI"
ROAD = "OTOYOL"
SEA = "DENİZ"
M7_LINE = "M7"          # the line whose district is NULL in the feed

# --- Fixed values: line M7 station -> district (the feed leaves M7's town empty)
M7_STATION_DISTRICT = {
    "ALIBEYKOY BATI": "EYUPSULTAN",
    "ALIBEYKOY DOGU": "EYUPSULTAN",
    "CAGLAYAN BATI": "KAGITHANE",
    "CAGLAYAN DOGU": "KAGITHANE",
    "CIRCIR BATI": "EYUPSULTAN",
    "CIRCIR DOGU": "EYUPSULTAN",
    "GOZTEPE BATI": "BAGCILAR",
    "GOZTEPE DOGU": "BAGCILAR",
    "KAGITHANE BATI": "KAGITHANE",
    "KAGITHANE DOGU": "KAGITHANE",
    "KARADENIZ MAH. BATI": "GAZIOSMANPASA",
    "KARADENIZ MAH. DOGU": "GAZIOSMANPASA",
    "KAZIMKARABEKIR": "GAZIOSMANPASA",
    "M7 FULYA": "BESIKTAS",
    "M7 YILDIZ 1": "BESIKTAS",
    "M7 YILDIZ 2": "BESIKTAS",
    "MAHMUTBEY M3 HOL 3": "BAGCILAR",
    "MAHMUTBEY M3 HOL 4": "BAGCILAR",
    "MAHMUTBEY M7 HOL 1": "BAGCILAR",
    "MAHMUTBEY M7 HOL 2": "BAGCILAR",
    "MECIDIYEKOY BATI": "SISLI",
    "MECIDIYEKOY DOGU": "SISLI",
    "NURTEPE BATI": "KAGITHANE",
    "NURTEPE DOGU": "KAGITHANE",
    "ORUCREIS BATI": "ESENLER",
    "ORUCREIS DOGU": "ESENLER",
    "TEKSTILKENT": "ESENLER",
    "VEYSELKARANI BATI": "SULTANGAZI",
    "VEYSELKARANI DOGU": "SULTANGAZI",
    "YENIMAHALLE": "GAZIOSMANPASA",
    "YESILPINAR": "EYUPSULTAN",
}

# --- Fixed values: night = hour >= 23 or hour < 5 ------------------------------
NIGHT_FROM = 23
NIGHT_UNTIL = 5

# --- Fixed values: thresholds (defaults of the corresponding reports) ---------
MIN_ROWS_PER_DAY = 100_000          # crumb-day threshold of validator and gate
NIGHT_INDEX_MIN_TOTAL = 1_000_000   # district night index
NIGHT_MAP_MIN_TOTAL = 500_000       # night map and by-year comparison
STATION_MIN_TOTAL = 100_000         # station share profile / clustering
PULSE_MIN_TOTAL = 100_000           # normalised district pulse
TOP_TOWNS = 15                      # district pulse chart
NIGHT_TOP = 12                      # night chart
BY_YEAR_TOP = 10                    # by-year night chart
ANOMALY_Z = 2.0
ANOMALY_DATE_LABELS = 6

# --- Fixed values: card kinds and their labels --------------------------------
CARD_LABELS = {
    "TAM": "Tam",
    "INDIRIMLI1": "İndirimli-1 (öğrenci ağırlıklı)",
    "INDIRIMLI2": "İndirimli-2",
    "UCRETSIZ": "Ücretsiz (65+, engelli)",
}
CARD_KINDS = tuple(CARD_LABELS)

# --- Fixed values: weekday names (short, long) and month abbreviations --------
WEEKDAY_SHORT = ["Pzt", "Sal", "Çar", "Per", "Cum", "Cmt", "Paz"]
WEEKDAY_LONG = ["Pazartesi", "Salı", "Çarşamba", "Perşembe", "Cuma", "Cumartesi", "Pazar"]
MONTH_SHORT = ["Oca", "Şub", "Mar", "Nis", "May", "Haz",
               "Tem", "Ağu", "Eyl", "Eki", "Kas", "Ara"]

# --- Fixed values: student-card period comparison ------------------------------
SCHOOL_MONTH, SUMMER_MONTH = 3, 7
SCHOOL_LABEL = "Okul dönemi (Mart)"
SUMMER_LABEL = "Yaz tatili (Temmuz)"
STUDENT_CARD = "INDIRIMLI1"

# --- Fixed values: Ramadan period labels ---------------------------------------
RAMADAN_LABEL = "Ramazan"
NORMAL_LABEL = "Normal dönem"

# --- Fixed values: station cluster names, from most morning- to most evening-heavy
CLUSTER_NAMES = [
    "Sabah zirveli (yatak odası)",
    "Çift zirveli (dengeli)",
    "Akşam ağırlıklı (karma-merkez)",
    "Sert akşam zirveli (iş/merkez)",
]
EVENING_HOURS = (16, 19)   # inclusive
MORNING_HOURS = (6, 9)     # inclusive
EVENING_ORDER = [20, 21, 22, 23, 0, 1, 2, 3, 4, 5]

# --- Fixed values: Turkish letters folded by the district name normaliser ------
TR_FROM = "çğıöşüÇĞİÖŞÜ"
TR_TO = "cgiosuCGIOSU"
NO_RAIL_TEXT = "raylı sistem yok"
PER_MILLE = "‰"

# --- Fixed values: special days per year ----------------------------------------
SPECIAL_DAYS = {
    2022: {
        "2022-01-01": "Yılbaşı",
        "2022-01-24": "Kar fırtınası 1. gün",
        "2022-01-25": "Kar fırtınası 2. gün",
        "2022-05-01": "Ramazan B. arifesi",
        "2022-05-02": "Ramazan Bayramı",
        "2022-07-08": "Kurban B. arifesi",
        "2022-07-09": "Kurban Bayramı",
        "2022-09-05": "Okullar açıldı",
        "2022-10-29": "Cumhuriyet Bayramı",
    },
    2023: {
        "2023-01-01": "Yılbaşı",
        "2023-02-05": "Kar yağışı",
        "2023-02-06": "6 Şubat depremi",
        "2023-04-20": "Ramazan B. arifesi",
        "2023-04-21": "Ramazan B. 1. günü",
        "2023-04-23": "23 Nisan + bayramın 3. günü",
        "2023-05-14": "Seçim 1. tur",
        "2023-05-28": "Seçim 2. tur",
        "2023-06-27": "Kurban B. arifesi",
        "2023-06-28": "Kurban Bayramı",
        "2023-09-11": "Okullar açıldı",
        "2023-10-28": "100. yıl arifesi",
        "2023-10-29": "Cumhuriyet'in 100. yılı",
        "2023-11-18": "Lodos fırtınası",
    },
    2024: {
        "2024-01-01": "Yılbaşı",
        "2024-03-31": "Yerel seçim",
        "2024-04-09": "Ramazan B. arifesi",
        "2024-04-10": "Ramazan Bayramı",
        "2024-04-23": "23 Nisan",
        "2024-05-01": "1 Mayıs",
        "2024-06-15": "Kurban B. arifesi",
        "2024-06-16": "Kurban Bayramı",
        "2024-06-17": "Kurban B. 2. günü",
    },
}

# Subset marked on the yearly series; years without an entry use all their special days.
SERIES_LABELS = {
    2023: ["2023-01-01", "2023-02-06", "2023-04-21", "2023-05-14",
           "2023-05-28", "2023-06-28", "2023-09-11", "2023-10-29"],
}


@dataclass(frozen=True)
class Period:
    """An inclusive date range tagged as special within an analysis window."""
    year: int
    start: str
    end: str
    window_start: str
    window_end: str
    excluded: tuple[str, str]      # inclusive holiday range left out entirely


# --- Fixed values: Ramadan periods (holiday excluded), window 1 Feb - 31 May ---
RAMADAN = [
    Period(2023, "2023-03-23", "2023-04-20", "2023-02-01", "2023-05-31", ("2023-04-21", "2023-04-25")),
    Period(2024, "2024-03-11", "2024-04-09", "2024-02-01", "2024-05-31", ("2024-04-10", "2024-04-14")),
]


@dataclass(frozen=True)
class Domain:
    """Names and values that differ between the real feed and a test facade."""
    rail: str = RAIL
    m7_line: str = M7_LINE
    card_kinds: tuple[str, ...] = CARD_KINDS
    student_card: str = STUDENT_CARD
    ramadan: tuple[Period, ...] = tuple(RAMADAN)
    special_days: dict = field(default_factory=lambda: SPECIAL_DAYS)
    series_labels: dict = field(default_factory=lambda: SERIES_LABELS)


REAL = Domain()


# ---------------------------------------------------------------------------
# DataFrames over the fixed values (all tiny; safe to broadcast by construction)
# ---------------------------------------------------------------------------

def literal_df(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small DataFrame of literal rows as a local relation (an inline VALUES
    table with bound parameters): Catalyst knows its exact size, and
    broadcasting it needs no scan job — unlike ``createDataFrame`` of a list,
    which plans as an RDD scan."""
    if not rows:
        return spark.createDataFrame([], schema)
    args, tuples = {}, []
    for i, row in enumerate(rows):
        cells = []
        for j, (v, f) in enumerate(zip(row, schema.fields)):
            k = f"v{i}_{j}"
            args[k] = v
            cells.append(f"CAST(:{k} AS {f.dataType.simpleString()})")
        tuples.append("(" + ", ".join(cells) + ")")
    names = ", ".join(f.name for f in schema.fields)
    return spark.sql(f"SELECT * FROM VALUES {', '.join(tuples)} AS t({names})", args=args)


def special_days_df(spark: SparkSession, special_days: dict | None = None,
                    series_labels: dict | None = None, year: int | None = None) -> DataFrame:
    """(tarih date, yil int, etiket string, seride bool) — DM5 with the DM6 flag.

    When ``year`` is given only that year's days are returned (the yearly
    figures work per year); otherwise all years.
    """
    special_days = SPECIAL_DAYS if special_days is None else special_days
    series_labels = SERIES_LABELS if series_labels is None else series_labels
    rows = []
    for y, days in special_days.items():
        if year is not None and y != year:
            continue
        marked = series_labels.get(y)
        for d, label in days.items():
            rows.append((dt.date.fromisoformat(d), int(y), label,
                         True if marked is None else d in marked))
    schema = T.StructType([
        T.StructField("tarih", T.DateType(), False),
        T.StructField("yil", T.IntegerType(), False),
        T.StructField("etiket", T.StringType(), False),
        T.StructField("seride", T.BooleanType(), False),
    ])
    return literal_df(spark, rows, schema)


def special_days_map(special_days: dict | None = None, series_labels: dict | None = None,
                     year: int | None = None, marked_only: bool = False) -> dict[str, str]:
    """DM5 (or its DM6 subset with ``marked_only``) as a date -> label mapping."""
    special_days = SPECIAL_DAYS if special_days is None else special_days
    series_labels = SERIES_LABELS if series_labels is None else series_labels
    out = {}
    for y, days in special_days.items():
        if year is not None and y != year:
            continue
        marked = series_labels.get(y)
        for d, label in days.items():
            if not marked_only or marked is None or d in marked:
                out[d] = label
    return out


def periods_df(spark: SparkSession, periods=None) -> DataFrame:
    """DM7: one row per period year with inclusive bounds, window and exclusion."""
    periods = RAMADAN if periods is None else periods
    rows = [(p.year, dt.date.fromisoformat(p.start), dt.date.fromisoformat(p.end),
             dt.date.fromisoformat(p.window_start), dt.date.fromisoformat(p.window_end),
             dt.date.fromisoformat(p.excluded[0]), dt.date.fromisoformat(p.excluded[1]))
            for p in periods]
    schema = T.StructType([
        T.StructField("yil", T.IntegerType(), False),
        T.StructField("baslangic", T.DateType(), False),
        T.StructField("bitis", T.DateType(), False),
        T.StructField("pencere_bas", T.DateType(), False),
        T.StructField("pencere_son", T.DateType(), False),
        T.StructField("haric_bas", T.DateType(), False),
        T.StructField("haric_son", T.DateType(), False),
    ])
    return literal_df(spark, rows, schema)


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def card_label(col: Column | str) -> Column:
    """Card kind -> display label (NULL for other kinds)."""
    c = F.col(col) if isinstance(col, str) else col
    return _literal_map(CARD_LABELS)[c]


def weekday_name(col: Column | str, long: bool = False) -> Column:
    """ISO weekday 1..7 -> name."""
    c = F.col(col) if isinstance(col, str) else col
    names = WEEKDAY_LONG if long else WEEKDAY_SHORT
    return F.element_at(F.array(*[F.lit(n) for n in names]), c.cast("int"))


def month_abbr(col: Column | str) -> Column:
    """Month 1..12 -> abbreviation."""
    c = F.col(col) if isinstance(col, str) else col
    return F.element_at(F.array(*[F.lit(n) for n in MONTH_SHORT]), c.cast("int"))


def short_date(col: Column | str) -> Column:
    """Date -> '6 Şub' (day without padding, month abbreviation)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat_ws(" ", F.dayofmonth(c).cast("string"), month_abbr(F.month(c)))
