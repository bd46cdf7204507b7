"""Golden cases for the 37 derived columns (inputs of our own, covering the
boundaries the source's unit tests cover)."""

import pytest

from conftest import parse_rows

CASES = [
    # gender preference: no_couples beats female
    ("gender_preference", "Women only please", "female_only"),
    ("gender_preference", "Gentleman preferred", "male_only"),
    ("gender_preference", "couples okay here", "couples_welcome"),
    ("gender_preference", "Sorry no couples", "no_couples"),
    ("gender_preference", "Ladies only, no couples", "no_couples"),
    ("gender_preference", "Suits a lady", None),
    ("gender_preference", "Great for a lady", "female_only"),
    ("couples_allowed", "no couple", False),
    ("couples_allowed", "Couples accepted", True),
    ("couples_allowed", "single occupancy only", False),
    ("couples_allowed", "Bright room", None),
    ("smoking_allowed", "No smokers", False),
    ("smoking_allowed", "non smoking unit", False),
    ("smoking_allowed", "smoke free home", False),
    ("smoking_allowed", "she doesn't smoke", False),
    ("smoking_allowed", "Smokers welcome", True),
    ("smoking_allowed", "Garden view", None),
    ("age_range_min", "someone in their 25-35's", 25),
    ("age_range_max", "someone in their 25-35's", 35),
    ("age_range_min", "people in their 30s or 40s", 30),
    ("age_range_max", "ages 22 to 29", 29),
    ("age_range_min", "between 21-27 years", 21),
    ("age_range_min", "ages 15 to 90", None),
    ("age_range_min", "ages 15 to 19 or between 22-28", None),  # only the first match is tried
    ("vibe", "Peaceful home", "quiet"),
    ("vibe", "easy-going people", "quiet"),
    ("vibe", "professional household", "professional"),
    ("vibe", "close to college", "student"),
    ("vibe", "outgoing house", "social"),
    ("vibe", "420 friendly", "social"),
    ("vibe", "calm street", "quiet"),
    ("vibe", "3 bedroom house", None),
    ("lease_type", "month to month", "month_to_month"),
    ("lease_type", "m2m ok", "month_to_month"),
    ("lease_type", "no lease needed", "month_to_month"),
    ("lease_type", "Min 4 month stay", "fixed_term"),
    ("lease_type", "lease agreement needed", "fixed_term"),
    ("lease_type", "annual lease", "fixed_term"),
    ("lease_type", "1-year lease", None),
    ("lease_type", "Lovely place", None),
    ("min_lease_months", "Minimum 4 months", 4),
    ("min_lease_months", "6 month lease", 6),
    ("min_lease_months", "2 year minimum", 24),
    ("min_lease_months", "1-year lease", 12),
    ("min_lease_months", "Minimum 2-month sublet then extend", 2),
    ("min_lease_months", "Minimum 90 months", None),
    ("min_lease_months", "term: 9 months", 9),
    ("available_from", "Available May 3, 2026", "2026-05-03"),
    ("available_from", "available immediately", "immediate"),
    ("available_from", "Move in asap", "immediate"),
    ("available_from", "Available 2026-06-20", "2026-06-20"),
    ("available_from", "available sept 1 2026", None),
    ("available_from", "available february 30, 2026", None),
    ("available_from", "starting jun 15th, 2026", "2026-06-15"),
    ("available_from", "Cute room", None),
    ("price_min", "Rent: $1,100 – $2,000/month", 1100),
    ("price_max", "Rent: $1,100 – $2,000/month", 2000),
    ("price_min", "$900-$1300/mo", 900),
    ("price_min", "$1300/month", None),
    ("price_min", "$1500 to $900", None),
    ("price_min", "$,-$, pricing", None),
    ("building_type", "new hi-rise", "high_rise"),
    ("building_type", "condo tower", "high_rise"),
    ("building_type", "low rise", "low_rise"),
    ("building_type", "walk-up building", "walk_up"),
    ("building_type", "townhome near park", "townhouse"),
    ("building_type", "lane way home", "laneway"),
    ("building_type", "ground level suite", "basement"),
    ("building_type", "detached home", "house"),
    ("building_type", "room for rent", None),
    ("domicile_type", "condominium near skytrain", "condo"),
    ("domicile_type", "apartment in Fairview", "apartment"),
    ("domicile_type", "town home", "townhouse"),
    ("domicile_type", "studio bachelor", "studio"),
    ("domicile_type", "garden suite", "suite"),
    ("domicile_type", "whole house", "house"),
    ("domicile_type", "room", None),
    ("room_type", "master bed available", "master"),
    ("room_type", "primary room", "master"),
    ("room_type", "flex room", "den"),
    ("room_type", "sharing a room", "shared_room"),
    ("room_type", "your own room", "private_room"),
    ("room_type", "second bedroom", "single"),
    ("room_type", "apartment", None),
    ("shared_living", "room available in a shared house", True),
    ("shared_living", "housemate wanted", True),
    ("shared_living", "room for rent in 2br", True),
    ("shared_living", "whole apartment", False),
    ("shared_living", "no roommates", False),
    ("shared_living", "Lovely", None),
    ("furnished_bedroom", "furnished private bedroom", True),
    ("furnished_bedroom", "bedroom is fully furnished", True),
    ("furnished_bedroom", "unfurnished bedroom", False),
    ("furnished_bedroom", "bring your own furniture", False),
    ("furnished_bedroom", "bedroom not furnished", False),
    ("furnished_bedroom", "views", None),
    ("furnished_common", "shared areas are furnished", True),
    ("furnished_common", "furnished living area", True),
    ("furnished_common", "fully furnished kitchen", True),
    ("furnished_common", "kitchen", None),
    ("furniture_level", "un-furnished", "unfurnished"),
    ("furniture_level", "completely furnished", "fully_furnished"),
    ("furniture_level", "semi furnished", "partially_furnished"),
    ("furniture_level", "desk provided", "partially_furnished"),
    ("furniture_level", "turnkey", "fully_furnished"),
    ("furniture_level", "it is furnished", "fully_furnished"),
    ("furniture_level", "not furnished", "unfurnished"),
    ("bathroom_type", "own washroom", "private"),
    ("bathroom_type", "bathroom ensuite", "private"),
    ("bathroom_type", "personal shower", "private"),
    ("bathroom_type", "your own bath", "private"),
    ("bathroom_type", "communal bathroom", "shared"),
    ("bathroom_type", "bathroom shared", "shared"),
    ("bathroom_type", "3 bathrooms", None),
    ("laundry_type", "washer in suite", "in_unit"),
    ("laundry_type", "in-unit laundry", "in_unit"),
    ("laundry_type", "w/d in suite", "in_unit"),
    ("laundry_type", "laundry on-site", "in_building"),
    ("laundry_type", "coin washer", "in_building"),
    ("laundry_type", "laundry facilities available", "in_building"),
    ("laundry_type", "Good spot", None),
    ("transit_proximity", "steps to the sky train", "near_skytrain"),
    ("transit_proximity", "3 blocks to skytrain", "near_skytrain"),
    ("transit_proximity", "walk to Joyce-Collingwood station", "near_skytrain"),
    ("transit_proximity", "close to the b-line", "near_bus"),
    ("transit_proximity", "bus stop outside", "near_bus"),
    ("transit_proximity", "great public transit", "good_transit"),
    ("transit_proximity", "transit oriented", "good_transit"),
    ("transit_proximity", "Calm area", None),
    ("transit_description", "only 5 min walk to Granville station", "5 min walk to granville station"),
    ("transit_description", "close to nanaimo skytrain, nice", "close to nanaimo skytrain"),
    ("transit_description", "3 blocks to the 99 b-line", "3 blocks to the 99 b-line"),
    ("transit_description", "nothing nearby", None),
    ("dishwasher", "dishwasher included", True),
    ("dishwasher", "dish washer", None),
    ("balcony", "two balconies", True),
    ("balcony", "terrace", True),
    ("fireplace", "electric fireplace", True),
    ("air_conditioning", "unit has AC", True),
    ("air_conditioning", "central air", True),
    ("ev_charging", "ev charger", True),
    ("ev_charging", "level 2 charging", None),
    ("gym_access", "work out room", True),
    ("storage_locker", "locker available", True),
    ("close_to_amenities", "walking distance to groceries", True),
    ("close_to_amenities", "steps from cafes", True),
    ("close_to_amenities", "remote cabin", None),
    ("has_views", "view of the mountains", True),
    ("has_views", "suite with a gorgeous view", True),
    ("has_views", "basement unit", None),
    ("utilities_included", "heat included", True),
    ("utilities_included", "includes all utilities", True),
    ("utilities_included", "hydro extra", False),
    ("utilities_included", "no utilities included", False),
    ("utilities_included", "Sunny", None),
    ("parking_included", "parking stall", True),
    ("parking_included", "covered parking", True),
    ("parking_included", "two parking spaces", None),  # "spaces" fails the trailing \\b
    ("parking_included", "two parking spots ok", None),
    ("parking_included", "one parking stall", True),
    ("parking_included", "parking not included", False),
    ("parking_included", "no parking, parking available", False),
    ("pets_allowed", "dogs welcome", True),
    ("pets_allowed", "small pets ok", True),
    ("pets_allowed", "pet free", False),
    ("pets_allowed", "pets not allowed", False),
    ("num_bedrooms", "$2,050 / 3br", 3),
    ("num_bedrooms", "1-bedroom suite", 1),
    ("num_bedrooms", "2 bdrm", 2),
    ("num_bedrooms", "10 bed dorm", None),
    ("num_bedrooms", "cozy", None),
    ("num_bathrooms", "2-bathroom", 2),
    ("num_bathrooms", "1.5 bath", 2),
    ("num_bathrooms", "1 ba", 1),
    ("num_bathrooms", "cozy", None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    return parse_rows(spark, [t for _, t, _ in CASES])


@pytest.mark.parametrize("idx", range(len(CASES)))
def test_golden(parsed, idx):
    col, text, expected = CASES[idx]
    assert parsed[idx][col] == expected, (col, text)


NEIGHBOURHOODS = [
    ("Room in Kitsilano", "Kitsilano"),
    ("Kits basement", "Kitsilano"),
    ("Collingwood area", "Renfrew-Collingwood"),
    ("Renfrew Heights", "Renfrew-Collingwood"),
    ("just off Commercial Dr", "Grandview-Woodland"),
    ("steps to UBC", "UBC"),
    ("near Metrotown mall", "Burnaby — Metrotown"),
    ("central Burnaby", "Burnaby"),
    ("Downtown core", "Downtown"),
    ("Mt Pleasant", "Mount Pleasant"),
    ("Queensborough New West", "New Westminster"),
    ("Lower Lonsdale, North Vancouver", "North Vancouver"),
    ("Steveston village", "Richmond"),
    ("Davie Village", "West End"),
    ("Coal Harbour view", "Coal Harbour"),
    ("Joyce Collingwood", "Renfrew-Collingwood"),
    ("Nice location", None),
    # quirks kept on purpose
    ("Near the fuel station", "UBC"),          # 'uel\\b' has no left boundary
    ("Samuel's place", "UBC"),
    ("Port Coquitlam house", "Coquitlam"),       # the general rule comes first
    ("Kitsilano, Broadway and Cambie", "Kitsilano"),  # landmarks come last
    ("Broadway & Cambie", "Fairview"),
]


def test_neighbourhood(spark):
    from pyspark.sql import functions as F
    from rentgrid.functions.dialect import SPARK
    from rentgrid.functions.extract import neighbourhood
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NEIGHBOURHOODS)], "i int, t string")
    for prefilter in (False, True):
        got = {r.i: r.n for r in df.select("i", neighbourhood(SPARK, F.col("t"), prefilter).alias("n")).collect()}
        for i, (text, expected) in enumerate(NEIGHBOURHOODS):
            assert got[i] == expected, (text, prefilter)


def test_whole_listing(spark):
    text = ("Furnished room in shared 2br high-rise apartment downtown, rooms with city views. "
            "Utilities included, in-suite laundry. No smoking. Rent $1,300 – $2,300/month. "
            "Looking for someone in their 20-30's, working professional. Available April 1, 2026, "
            "minimum 3-month sublet. Close to shops and restaurants, dishwasher, balcony, gas fireplace, "
            "parking included. No couples. Master bedroom with private bathroom, 2 bath.")
    r = parse_rows(spark, [text], title="Room")[0]
    assert r["neighbourhood"] == "Downtown"
    assert r["building_type"] == "high_rise"
    assert r["domicile_type"] == "apartment"
    assert r["furnished_bedroom"] is True
    assert r["utilities_included"] is True
    assert r["laundry_type"] == "in_unit"
    assert r["has_views"] is True
    assert r["smoking_allowed"] is False
    assert (r["price_min"], r["price_max"]) == (1300, 2300)
    assert (r["age_range_min"], r["age_range_max"]) == (20, 30)
    assert r["vibe"] == "professional"
    assert r["available_from"] == "2026-04-01"
    assert r["min_lease_months"] == 3
    assert r["lease_type"] == "fixed_term"
    assert r["gender_preference"] == "no_couples"
    assert r["couples_allowed"] is False
    assert r["room_type"] == "master"
    assert r["bathroom_type"] == "private"
    assert r["num_bedrooms"] == 2
    assert r["num_bathrooms"] == 2
    assert r["close_to_amenities"] is True
    assert r["dishwasher"] is True and r["balcony"] is True and r["fireplace"] is True
    assert r["parking_included"] is True
