"""Listing captures derived from the ``orders`` table.

The test data holds no rental posts, so captures are generated from
``orders``: every order becomes one captured listing whose texts are picked
from phrase lists by the order key modulo distinct primes, so phrase
combinations vary and the table grows with ``orders``.  Four consecutive
orders share one post (``post_no = o_orderkey div 4``) and appear in
snapshots 0..3, which gives repeated ids for upsert and snapshot merge.

One definition serves both engines: ``listing_raw(spark, sf_dir)`` builds the
Spark DataFrame and ``listing_raw_sql()`` the DuckDB query used by the
oracle.  All phrases are ASCII apart from whitespace characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rentgrid.functions.dialect import DUCK, SPARK
from rentgrid.schema import ANSWER_KEYS, LISTING_TYPES_BY_NAME
from rentgrid.functions.stages import apply_stages, cached, stages_sql
from rentgrid.session import read_table, rebalance

AS_OF = "2026-12-01 12:00:00"

TITLES = [
    "Bright private room in Kitsilano",
    "Basement suite near Metrotown",
    "2 bed 1 bath condo with views",
    "Studio apartment Downtown",
    "Shared room for female student",
    "",
    "Room for rent in Port Coquitlam",
    "Laneway house, 1 bedroom",
    "Coach house close to Commercial Drive",
    "Master bedroom in 3 br house",
    "Furnished room near UBC",
    "Entire unit   garden \t suite",
    "Cozy den by Samuel",
]

LOCATIONS = [
    "Kitsilano", "(Mt. Pleasant)", "Vancouver", "Port Coquitlam", "Burnaby", " Fuel station area ",
    "North Van near Lonsdale", "Commercial Drive", "", "Richmond", "Broadway and Cambie",
]

POLICY = [
    "Female only, no couples.", "Couples welcome!", "Male preferred.", "No smoking please.",
    "Smoking ok outside.", "Non-smoker preferred.", "No pets.", "Cats ok.", "Pet-friendly building.",
    "Single occupancy only.", "Room for a woman.", "Quiet household, working professional preferred.",
    "420-friendly house.", "Sorry no pets, no parking.", "Laid-back student house.", "Nice place. \tClean.",
    "Tenant doesn`t smoke.",
]

PROPERTY = [
    "Furnished bedroom available.", "Unfurnished bedroom, bring your own bed.", "Fully furnished suite.",
    "Partially furnished.", "Turn-key ready.", "The room is furnished.", "No furniture provided.",
    "Shared spaces are fully furnished.", "Modern high-rise building with gym.", "Low-rise apartment.",
    "Townhouse on Main St.", "Basement suite available.", "Single family house.", "Converted den for rent.",
    "Shared room, 2 bunk beds.", "Private room in shared apartment.",
    "Primary bedroom with ensuite bathroom.", "Entire unit available.", "Roommate wanted.",
]

TRANSIT = [
    "Near the SkyTrain.", "5 min walk to skytrain.", "Close to Metrotown station skytrain.",
    "Near the bus stop.", "Excellent transit access.", "Transit-friendly location.",
    "10 minute walk to Joyce station.", "3 blocks to the 99 B-Line bus.", "Kitchen with dishwasher and A/C.",
    "Large deck and gas fireplace.", "EV charging available, level 2 charger.", "Storage locker included.",
    "Walkable to lots of grocery stores, cafes.", "Close to shops and restaurants.", "Rooms with city views.",
    "Beautiful mountain view.", "Quiet residential area.", "Great location!", "Fitness centre on-site.",
    "Near all amenities.", "Central air and mini-split.", "Walk to the fuel depot near Broadway station.",
    "Steps from Renfrew skytrain",
]

UTILITIES = [
    "Laundry in unit.", "In-suite washer/dryer.", "W/D in unit.", "Shared laundry in building.",
    "Coin laundry downstairs.", "Utilities included.", "All-inclusive rent.", "Hydro included.",
    "Utilities not included.", "Utilities extra.", "Parking included.", "Underground parking spaces included.",
    "1 parking spot available.", "Street parking only.", "Private bathroom.", "Shared bathroom.",
    "Full en-suite bath.", "2 bathrooms total.", "1.5 bath.", "Your own bathroom.",
    "Laundry room available on floor 2.",
]

LEASE = [
    "Month-to-month lease.", "M2M available.", "No lease required.", "Minimum 6 months commitment.",
    "Lease required.", "One-year lease preferred.", "Minimum 3-month sublet, with the possibility of extending.",
    "12 month lease.", "1 year minimum.", "Minimum 100 months.", "Available April 1, 2026.",
    "Available immediately.", "Move-in now.", "Available 2026-05-15.", "Available sept 1 2026.",
    "Available february 30, 2026.", "Available 2026-02-30 or from March 3rd 2027.", "Starting jun 15th, 2026.",
    "Term: 18 months.", "2 yr lease.", "min. 4 months.", "Minimum 99999999999 year lease.",
    "Available 2026-4-7.",
]

NUMBERS = [
    "Rent: $1,300 – $2,300/month.", "$800-$1200/mo.", "$1200/month.", "Someone in their 20-30's.",
    "Looking for someone in their 20s and 30s.", "Ages 25 to 40.", "Between 25-35 years old.",
    "$2,050 / 2br.", "2-bedroom apartment.", "3 bed house.", "10 bed dorm.", "Ages 15 to 90.",
    "$,-$, pricing.", "$1500 to $900.", "2br 2 bath.", "",
    "Ages 15 to 19 or between 22-28.", "4bedrooms, 1.25 baths.",
]

PRICE_FORMS = ["slash_month", "slash_mo", "per_month", "$50", "$15,000", "", "labelled"]

DATE_TEXTS = [
    "2 hours ago", "yesterday", "today", "just now", "an hour ago", "3 days ago", "2 weeks ago", "",
    "sometime soon", "a month ago", "Moments ago", " 45 minutes ago ", "1 second ago", "2026-11-02",
    "30000 seconds ago", "40000 minutes ago", "30000 hours ago", "Nov 3, 2026", "3 November 2026", "11/02/2026",
    "2026-11-20T10:15:00Z", "2026-11", "10:15", "Nov 5", "Thu Nov 5", "Tuesday", "November 3rd, 2026", "5 Nov at 3:45 pm",
    "11/5", "31 Sept 2026", "Fri., 9pm",
]

DATE_ATTRS = ["2026-11-20T10:15:00Z", "2026-11-21 08:00:00", "", "not-a-date", "20261119", "2026-11", "10:15", "20261120T101500",
              "20261120T1015", "20261131", "2026-11-22"]

MODEL_TYPES = ["room_private", "room_shared", "studio", "1br", "penthouse", "", "other", "laneway"]

# Detail attribute rows (lower/upper case mixed on purpose), '|' separated.
ATTRS = [
    "furnished|cats are OK - purrr|800ft2",
    "laundry in unit|carport",
    "unfurnished|dogs are OK - wooof",
    "w/d in unit|650 ft|700 ft",
    "",
    "street parking",
    "Furnished: No|Pet friendly: Yes|Size (sqft): 750 sq",
    "Parking included: Yes|Laundry (in unit)",
    "Utilities: included|Pets: No",
    "Laundry (in suite)|Size: 512 sqft",
]

IMAGES = [
    "https://img.example/a1.jpg|/local/a2.jpg|http://img.example/placeholder.png",
    "",
    "http://img.example/b1.jpg",
    "ftp://img.example/c1.jpg|https://img.example/c2.jpg",
]


def _money(d, n):
    """``1,234`` style thousands text for an integer expression."""
    return d.case([(d.ge(n, 1000), d.concat(d.to_str(d.idiv(n, 1000)), d.lit(","),
                                             d.lpad(d.to_str(d.mod(n, 1000)), 3, "0")))],
                  d.to_str(n))


def fixture_columns(d) -> dict:
    key = d.col("o_orderkey")
    cust = d.col("o_custkey")
    post = d.idiv(key, 4)
    amount = d.add(d.lit(300), d.mod(d.mul(cust, 37), 2900))
    money = _money(d, amount)
    price_text = d.case([
        (d.eq(d.mod(key, 7), 0), d.concat(d.lit("$"), money, d.lit("/month"))),
        (d.eq(d.mod(key, 7), 1), d.concat(d.to_str(amount), d.lit("/mo"))),
        (d.eq(d.mod(key, 7), 2), d.concat(d.to_str(amount), d.lit(" per month"))),
        (d.eq(d.mod(key, 7), 3), d.lit("$50")),
        (d.eq(d.mod(key, 7), 4), d.lit("$15,000")),
        (d.eq(d.mod(key, 7), 5), d.lit("")),
    ], d.concat(d.lit("Rent: $ "), money, d.lit(" (utilities extra)")))
    source = d.pick(post, ["craigslist", "kijiji", "facebook"])
    qr = d.case([(d.eq(d.mod(key, 5), 0), d.lit("QR Code Link to This Post\n"))], d.lit(""))
    description = d.concat(qr, d.concat_ws(
        " ",
        d.pick(key, POLICY),
        d.pick(key, PROPERTY),
        d.pick(key, TRANSIT),
        d.pick(key, UTILITIES),
        d.case([(d.eq(d.mod(key, 2), 0), d.pick(key, LEASE))], d.null("string")),
        d.case([(d.ne(d.mod(key, 3), 0), d.pick(key, NUMBERS))], d.null("string")),
    ))
    href = d.case([
        (d.eq(source, "craigslist"),
         d.case([(d.eq(d.mod(post, 2), 0), d.lit("https://vancouver.craigslist.org"))], d.lit(""))),
        (d.eq(source, "kijiji"),
         d.case([(d.eq(d.mod(post, 5), 4), d.lit("https://www.kijiji.ca"))], d.lit(""))),
    ], d.lit(""))
    url_path = d.case([
        (d.eq(source, "craigslist"), d.concat(d.lit("/van/roo/d/room/"), d.to_str(d.add(post, d.lit(7_000_000_000))),
                                              d.lit(".html"))),
        (d.eq(source, "kijiji"), d.concat(d.lit("/v-room-rental/vancouver/room/"),
                                          d.to_str(d.add(post, d.lit(1_600_000_000))))),
    ], d.lit(""))
    return {
        "listing_key": key,
        "post_no": post,
        "snapshot_no": d.to_int(d.mod(key, 4)),
        "source": source,
        "href": d.concat(href, url_path),
        "pid": d.case([(d.and_(d.eq(source, "craigslist"), d.eq(d.mod(post, 3), 0)),
                        d.to_str(d.add(post, d.lit(7_000_000_000))))], d.lit("")),
        "title_text": d.pick(key, TITLES),
        "price_text": price_text,
        "model_price": d.to_int(amount),
        "location_text": d.pick(key, LOCATIONS),
        "description_text": description,
        "date_attr": d.case([(d.eq(source, "craigslist"), d.pick(key, DATE_ATTRS))], d.lit("")),
        "date_text": d.pick(key, DATE_TEXTS),
        "model_type": d.pick(key, MODEL_TYPES),
        "captured_pets": d.case([(d.eq(d.mod(key, 6), 0), d.lit(True)), (d.eq(d.mod(key, 6), 1), d.lit(False))],
                                d.null("boolean")),
        "captured_bedrooms": d.case([(d.eq(d.mod(key, 5), 0), d.lit(3))], d.null("int")),
        "attrs_text": d.pick(key, ATTRS),
        "images_text": d.pick(key, IMAGES),
        "lat_text": d.case([(d.eq(d.mod(key, 4), 0), d.lit("49.26")), (d.eq(d.mod(key, 4), 1), d.lit("x"))],
                           d.lit("")),
        "lon_text": d.case([(d.eq(d.mod(key, 4), 0), d.lit("-123.1")), (d.eq(d.mod(key, 4), 1), d.lit("-123.2"))],
                           d.lit("")),
        "posted_at": d.col("o_orderdate"),
        "extracted_at": d.plus_hours(d.ts_lit(AS_OF), d.neg(d.mod(d.mul(key, 7), 720))),
    }


def listing_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = rebalance(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"),
                       "o_orderkey")
    cols = cached(("fixture",), lambda: [expr.alias(name) for name, expr in fixture_columns(SPARK).items()])
    return orders.select(*cols)


def listing_raw_sql() -> str:
    cols = ",\n  ".join(f"{expr} AS {name}" for name, expr in fixture_columns(DUCK).items())
    return f"SELECT\n  {cols}\nFROM orders"


#: JSON values that the answers' further keys take, by column type.
ANSWER_VALUES = {
    "string": ['"some text"', "null", '"other_value"'],
    "int": ["1", "null", "24", "3"],
    "boolean": ["true", "false", "null"],
}


def answer_stages(d) -> tuple[list[dict], dict]:
    """Model answers (JSON text) for every captured record: plain, fenced,
    not offering, without the offering flag, not JSON, unknown type.  The
    JSON body is its own column so its variants share it."""
    key = d.col("listing_key")
    body = d.concat(
        d.lit('{"is_offering": '), d.case([(d.eq(d.mod(key, 6), 2), d.lit("false"))], d.lit("true")),
        d.lit(', "title": "'), d.col("title_text"),
        d.lit('", "price": '), d.to_str(d.col("model_price")),
        d.lit(', "location": "'), d.col("location_text"),
        d.lit('", "description": "'), d.pick(key, PROPERTY),
        d.lit('", "listing_type": "'), d.col("model_type"),
        d.lit('", "available_date": "2026-0'), d.to_str(d.add(d.mod(key, 9), d.lit(1))),
        d.lit('-15", "num_bedrooms": '), d.to_str(d.add(d.mod(key, 4), d.lit(1))),
        d.lit(', "pets_allowed": '), d.case([(d.eq(d.mod(key, 2), 0), d.lit("true"))], d.lit("null")),
        *[d.concat(d.lit(f', "{name}": '), d.pick(d.add(key, d.lit(i)), ANSWER_VALUES[LISTING_TYPES_BY_NAME[name]]))
          for i, name in enumerate(ANSWER_KEYS) if name not in ("num_bedrooms", "pets_allowed")],
        d.lit("}"))
    b = d.col("_answer_body")
    no_flag = d.regexp_replace(b, r'^\{"is_offering": true, ', "{")
    answer = d.case([
        (d.eq(d.mod(key, 6), 1), d.concat(d.lit("```json\n"), b, d.lit("\n```"))),
        (d.eq(d.mod(key, 6), 3), no_flag),
        (d.eq(d.mod(key, 6), 4), d.lit("Sorry, this post is not a rental offer.")),
        (d.eq(d.mod(key, 6), 5), d.concat(d.lit("  ```\n"), b, d.lit("\n```  "))),
    ], b)
    final = {"listing_key": key, "post_url": d.case([(d.eq(d.col("source"), "facebook"), d.col("href"))],
                                                    d.lit("")), "answer": answer}
    return [{"_answer_body": body}], final


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = listing_raw(spark, sf_dir)
    stages, final = cached(("answers",), lambda: answer_stages(SPARK))
    return apply_stages(raw, stages, final)


def model_answers_sql() -> str:
    stages, final = answer_stages(DUCK)
    return stages_sql("listing_raw", stages, final)
