"""The listing schema and the state-table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# (name, Spark SQL type) in canonical column order: 55 listing fields.
LISTING_FIELDS: list[tuple[str, str]] = [
    ("id", "string"), ("source", "string"), ("url", "string"), ("title", "string"),
    ("price", "int"),
    ("location", "string"), ("latitude", "double"), ("longitude", "double"),
    ("description", "string"),
    ("posted_date", "timestamp"), ("available_date", "timestamp"), ("extracted_at", "timestamp"),
    ("listing_type", "string"),
    ("num_bedrooms", "int"), ("num_bathrooms", "int"), ("num_roommates", "int"), ("square_feet", "int"),
    ("utilities_included", "boolean"), ("furnished", "boolean"), ("pets_allowed", "boolean"),
    ("parking_included", "boolean"), ("laundry_in_unit", "boolean"),
    ("gender_preference", "string"), ("couples_allowed", "boolean"), ("smoking_allowed", "boolean"),
    ("age_range_min", "int"), ("age_range_max", "int"), ("vibe", "string"),
    ("lease_type", "string"), ("min_lease_months", "int"), ("available_from", "string"),
    ("price_min", "int"), ("price_max", "int"),
    ("building_type", "string"), ("domicile_type", "string"), ("room_type", "string"),
    ("shared_living", "boolean"),
    ("furniture_level", "string"), ("furnished_bedroom", "boolean"), ("furnished_common", "boolean"),
    ("bathroom_type", "string"), ("laundry_type", "string"),
    ("transit_proximity", "string"), ("transit_description", "string"),
    ("dishwasher", "boolean"), ("balcony", "boolean"), ("fireplace", "boolean"), ("air_conditioning", "boolean"),
    ("ev_charging", "boolean"), ("gym_access", "boolean"), ("storage_locker", "boolean"),
    ("close_to_amenities", "boolean"), ("has_views", "boolean"),
    ("neighbourhood", "string"),
    ("image_urls", "array<string>"),
]
LISTING_COLUMNS = [n for n, _ in LISTING_FIELDS]
LISTING_TYPES_BY_NAME = dict(LISTING_FIELDS)

# Keys of a model answer that are taken as given, as typed columns.
_ANSWER_OTHER = ("id", "source", "url", "title", "price", "location", "latitude", "longitude", "description",
                 "posted_date", "available_date", "extracted_at", "listing_type", "square_feet", "neighbourhood",
                 "image_urls")
ANSWER_KEYS = [n for n, _ in LISTING_FIELDS if n not in _ANSWER_OTHER]

_SPARK_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
}

LISTING_SCHEMA = T.StructType([T.StructField(n, _SPARK_TYPES[t], True) for n, t in LISTING_FIELDS])

# Keyed state: the listings table adds the run id.
STATE_FIELDS = LISTING_FIELDS + [("scrape_run_id", "bigint")]
STATE_SCHEMA = T.StructType([T.StructField(n, _SPARK_TYPES[t], True) for n, t in STATE_FIELDS])

# On a key conflict these 18 columns keep the first stored value; every other
# column takes the newest value, even when that value is NULL.
FIRST_WRITER_COLUMNS = (
    "source", "url", "title", "location", "posted_date", "available_date", "listing_type",
    "num_bedrooms", "num_bathrooms", "num_roommates", "square_feet", "utilities_included", "furnished",
    "pets_allowed", "parking_included", "laundry_in_unit", "latitude", "longitude",
)
LAST_WRITER_COLUMNS = tuple(n for n, _ in STATE_FIELDS if n != "id" and n not in FIRST_WRITER_COLUMNS)

PRICE_HISTORY_SCHEMA = T.StructType([
    T.StructField("listing_id", T.StringType(), False),
    T.StructField("price", T.IntegerType(), False),
    T.StructField("observed_at", T.TimestampType(), True),
])

RUN_LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("started_at", T.TimestampType(), True),
    T.StructField("finished_at", T.TimestampType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("listings_found", T.LongType(), True),
    T.StructField("status", T.StringType(), True),
])

# Columns that captured (structured) values win over parsed text values.
CAPTURED_FIRST = ("utilities_included", "parking_included", "pets_allowed", "num_bedrooms", "num_bathrooms")


def as_listings(df, fields=LISTING_FIELDS, keep=()):
    """The frame with all ``fields`` in order, NULL where it lacks one, and the
    ``keep`` columns: decoders that fill some columns, and stored tables from
    before a column was added."""
    from pyspark.sql import functions as F
    have = set(df.columns)
    return df.select(*keep, *[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields])


STATE_COLUMNS_BY_NAME = dict(STATE_FIELDS)
