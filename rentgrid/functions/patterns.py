"""The text rules that decide every derived listing column.

Everything in this module is data, not logic: regular expressions, the
labels they produce and the order in which they are tried.  They must stay
exactly as written for results to agree with the source behaviour, so they
are kept verbatim, in their natural order, in one place.  The patterns use
Python ``re`` syntax; :mod:`rentgrid.functions.dialect` adapts them to Java
(Spark) and RE2 (DuckDB) without changing what they match.

Unless a rule says otherwise, patterns run on ``lower(title || ' ' ||
description)``.  In an ordered list the first pattern that matches wins.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Neighbourhood rules, tried in this order (rule order, not
# text position, decides), case-insensitive, on "location title description".
# --------------------------------------------------------------------------
NEIGHBOURHOOD_RULES: list[tuple[str, str]] = [
    (r'\bcoal\s+harbour\b', "Coal Harbour"),
    (r'\bgastown\b', "Gastown"),
    (r'\byaletown\b', "Yaletown"),
    (r'\bcrosstown\b', "Crosstown"),
    (r'\bchinatown\b', "Strathcona"),
    (r'\b(?:west\s+end|english\s+bay|davie\s+village|denman\s+(?:st|street))\b', "West End"),
    (r'\b(?:downtown|dt\s+van(?:couver)?)\b', "Downtown"),
    (r'\b(?:west\s+point\s+grey|wpg|jericho)\b', "West Point Grey"),
    (r'\bubc\b|university\s+endowment|wesbrook\b|uel\b', "UBC"),
    (r'\b(?:kitsilano|kits)\b', "Kitsilano"),
    (r'\b(?:arbutus[\s-]?ridge|arbutus)\b', "Arbutus Ridge"),
    (r'\b(?:kerrisdale)\b', "Kerrisdale"),
    (r'\b(?:dunbar[\s-]?southlands|dunbar|southlands)\b', "Dunbar-Southlands"),
    (r'\b(?:shaughnessy)\b', "Shaughnessy"),
    (r'\b(?:south\s+granville)\b', "South Granville"),
    (r'\bfairview\b', "Fairview"),
    (r'\b(?:south\s+cambie|cambie\s+village|cambie\s+corridor)\b', "South Cambie"),
    (r'\b(?:oakridge)\b', "Oakridge"),
    (r'\b(?:langara)\b', "Langara"),
    (r'\b(?:marpole)\b', "Marpole"),
    (r'\b(?:mount\s+pleasant|mt\.?\s+pleasant)\b', "Mount Pleasant"),
    (r'\b(?:riley[\s-]?park|little\s+mountain|queen\s+elizabeth)\b', "Riley Park"),
    (r'\bstrathcona\b', "Strathcona"),
    (r'\b(?:grandview[\s-]?woodland|commercial\s+dr(?:ive)?|the\s+drive)\b', "Grandview-Woodland"),
    (r'\b(?:hastings[\s-]?sunrise|east\s+hastings)\b', "Hastings-Sunrise"),
    (r'\b(?:joyce[\s-]?collingwood)\b', "Renfrew-Collingwood"),
    (r'\b(?:renfrew[\s-]?collingwood|renfrew\s+heights)\b', "Renfrew-Collingwood"),
    (r'\b(?:collingwood)\b', "Renfrew-Collingwood"),
    (r'\b(?:renfrew)\b', "Renfrew-Collingwood"),
    (r'\b(?:kensington[\s-]?cedar\s+cottage|cedar\s+cottage)\b', "Kensington-Cedar Cottage"),
    (r'\b(?:kensington)\b', "Kensington-Cedar Cottage"),
    (r'\b(?:sunset)\b', "Sunset"),
    (r'\b(?:punjabi\s+market)\b', "Sunset"),
    (r'\b(?:victoria[\s-]?fraserview|fraserview)\b', "Victoria-Fraserview"),
    (r'\b(?:killarney)\b', "Killarney"),
    (r'\b(?:champlain\s+heights|champlain)\b', "Killarney"),
    (r'\b(?:river\s+district|south\s+marine)\b', "River District"),
    (r'\b(?:south\s+van(?:couver)?)\b', "South Vancouver"),
    (r'\b(?:east\s+van(?:couver)?|east\s+side)\b', "East Vancouver"),
    (r'\bmetrotown\b', "Burnaby — Metrotown"),
    (r'\b(?:brentwood)\b', "Burnaby — Brentwood"),
    (r'\b(?:edmonds|highgate)\b', "Burnaby — Edmonds"),
    (r'\b(?:lougheed)\b', "Burnaby — Lougheed"),
    (r'\bburquitlam\b', "Burnaby — Lougheed"),
    (r'\b(?:sfu|simon\s+fraser|univercity|burnaby\s+mountain)\b', "Burnaby — SFU"),
    (r'\bburnaby\b', "Burnaby"),
    (r'\b(?:sapperton|queensborough)\b', "New Westminster"),
    (r'\b(?:new\s+west(?:minster)?)\b', "New Westminster"),
    (r'\b(?:lonsdale|lynn\s+valley|deep\s+cove|lower\s+lonsdale)\b', "North Vancouver"),
    (r'\b(?:north\s+van(?:couver)?)\b', "North Vancouver"),
    (r'\b(?:ambleside|park\s+royal)\b', "West Vancouver"),
    (r'\b(?:west\s+van(?:couver)?)\b', "West Vancouver"),
    (r'\b(?:steveston|brighouse|richmond\s+centre)\b', "Richmond"),
    (r'\brichmond\b', "Richmond"),
    (r'\b(?:coquitlam\s+centre|burke\s+mountain)\b', "Coquitlam"),
    (r'\bcoquitlam\b', "Coquitlam"),
    (r'\b(?:inlet\s+centre|moody\s+centre)\b', "Port Moody"),
    (r'\bport\s+moody\b', "Port Moody"),
    (r'\b(?:port\s+coquitlam|poco)\b', "Port Coquitlam"),
    (r'\btri[\s-]?cit(?:y|ies)\b', "Tri-Cities"),
    (r'\b(?:surrey\s+central|whalley|king\s+george|guildford|fleetwood|newton)\b', "Surrey"),
    (r'\bsurrey\b', "Surrey"),
    (r'\b(?:langley\s+city|walnut\s+grove|willoughby)\b', "Langley"),
    (r'\blangley\b', "Langley"),
    (r'\bwhite\s+rock\b', "White Rock"),
    (r'\bmaple\s+ridge\b', "Maple Ridge"),
    (r'\bpitt\s+meadows\b', "Pitt Meadows"),
    (r'\b(?:ladner|tsawwassen)\b', "Delta"),
    (r'\bdelta\b', "Delta"),
    (r'\bbroadway\s*(?:&|and)\s*cambie\b', "Fairview"),
    (r'\bbroadway\s*(?:&|and)\s*(?:commercial|victoria|clark)\b', "Mount Pleasant"),
    (r'\bmain\s*(?:&|and)\s*(?:broadway|king\s+edward)\b', "Mount Pleasant"),
    (r'\bcommercial\s*(?:&|and)\s*broadway\b', "Grandview-Woodland"),
    (r'\bbroadway\s*(?:&|and)\s*(?:yew|macdonald|alma)\b', "Kitsilano"),
    (r'\b(?:41st|49th)\s*(?:&|and)\s*(?:cambie|oak|main)\b', "Oakridge"),
    (r'\b(?:victoria\s+dr(?:ive)?)\b', "Victoria-Fraserview"),
    (r'\b(?:main\s+st(?:reet)?)\b', "Mount Pleasant"),
    (r'\bcambie\b', "South Cambie"),
]

# --------------------------------------------------------------------------
# First-match chains on the lower-cased text.
# column -> ordered (pattern, value) pairs; no hit -> NULL.
# --------------------------------------------------------------------------
_NO_COUPLES = (
    r'\b(?:no\s+couples?|sorry\s+no\s+couples?|couples?\s+not\s+(?:allowed|accepted|welcome)|single\s+occupancy\s+only)\b'
)
_COUPLES_OK = r'\bcouples?\s+(?:welcome|ok|okay|allowed|accepted|friendly)\b'

_SKYTRAIN_STATIONS = (
    r'waterfront|burrard|granville|stadium|main\s+st|commercial[\s-]broadway'
    r'|nanaimo|29th\s+ave|joyce[\s-]collingwood|patterson|metrotown'
    r'|royal\s+oak|edmonds|new\s+westminster|columbia|scott\s+road'
    r'|gateway|surrey\s+central|king\s+george'
    r'|vcc[\s-]clark|renfrew|rupert|gilmore|brentwood|holdom|sperling'
    r'|lake\s+city|production\s+way|lougheed|burquitlam'
    r'|moody\s+centre|inlet\s+centre|coquitlam\s+central|lincoln|lafarge'
    r'|yaletown|olympic\s+village|broadway[\s-]city\s+hall|king\s+edward'
    r'|oakridge|langara|marine\s+drive|bridgeport|templeton'
    r'|sea\s+island|yvr[\s-]airport|aberdeen|lansdowne|richmond[\s-]brighouse'
)

CHAIN_RULES: dict[str, list[tuple[str, object]]] = {
    "gender_preference": [
        (_NO_COUPLES, "no_couples"),
        (_COUPLES_OK, "couples_welcome"),
        (r'\b(?:female|women|woman|girl|lady|ladies)\s*(?:only|preferred|pref)\b'
         r'|\bonly\s+(?:female|women|ladies)\b'
         r'|\bfor\s+(?:a\s+)?(?:female|woman|lady)\b', "female_only"),
        (r'\b(?:male|men|man|guy|gentleman)\s*(?:only|preferred|pref)\b'
         r'|\bonly\s+(?:male|men|gentleman)\b'
         r'|\bfor\s+(?:a\s+)?(?:male|man|gentleman)\b', "male_only"),
    ],
    "couples_allowed": [
        (r'\b(?:no\s+couples?|couples?\s+not\s+(?:allowed|accepted|welcome)|single\s+occupancy\s+only)\b', False),
        (_COUPLES_OK, True),
    ],
    "smoking_allowed": [
        (r'\b(?:no\s+smok(?:ing|ers?)|smoke[\s-]?free|non[\s-]?smok(?:ing|ers?)|doesn.t\s+smoke)\b', False),
        (r'\bsmok(?:ing|ers?)\s+(?:ok|okay|allowed|welcome|friendly)\b', True),
    ],
    "vibe": [
        (r'\b(?:quiet|peaceful|low[\s-]?key|laid[\s-]?back|calm|tranquil|easy[\s-]?going)\b', "quiet"),
        (r'\b(?:professional|working\s+professional)\b', "professional"),
        (r'\b(?:student|university|college|studying)\b', "student"),
        (r'\b(?:social|outgoing|friendly\s+house|party|420[\s-]?friendly)\b', "social"),
    ],
    "lease_type": [
        (r'month[\s-]?to[\s-]?month|m2m|mth[\s-]?to[\s-]?mth|no\s+lease', "month_to_month"),
        (r'(?:minimum|min\.?)\s+\d+[\s-]*(?:month|mth)'
         r'|\d+[\s-]*(?:month|mth)\s+(?:minimum|min|lease|commitment|sublet|term)'
         r'|\b(?:fixed|annual|yearly|one[\s-]?year)\s+(?:term|lease)\b'
         r'|\blease\s+(?:required|agreement|contract)\b', "fixed_term"),
    ],
    "building_type": [
        (r'\b(?:high[\s-]?rise|hi[\s-]?rise|tower)\b', "high_rise"),
        (r'\b(?:low[\s-]?rise)\b', "low_rise"),
        (r'\b(?:walk[\s-]?up)\b', "walk_up"),
        (r'\b(?:townhouse|town[\s-]?home|row[\s-]?house)\b', "townhouse"),
        (r'\b(?:laneway|lane[\s-]?way)\b', "laneway"),
        (r'\b(?:basement|below[\s-]?grade|ground[\s-]?level\s+suite)\b', "basement"),
        (r'\b(?:detached|single\s+family|house)\b', "house"),
    ],
    "domicile_type": [
        (r'\b(?:condo(?:minium)?)\b', "condo"),
        (r'\b(?:townhouse|town[\s-]?home)\b', "townhouse"),
        (r'\b(?:studio|bachelor)\b', "studio"),
        (r'\b(?:basement\s+suite|garden\s+suite)\b', "suite"),
        (r'\b(?:detached\s+house|single\s+family\s+house|whole\s+house)\b', "house"),
        (r'\bapartment\b', "apartment"),
    ],
    "room_type": [
        (r'\b(?:master\s+bed(?:room)?|primary\s+(?:bed)?room)\b', "master"),
        (r'\b(?:den|flex\s+room|converted\s+den)\b', "den"),
        (r'\b(?:shared\s+room|sharing\s+(?:a\s+)?room|bunk)\b', "shared_room"),
        (r'\b(?:private\s+room|private\s+bed(?:room)?|your\s+own\s+room)\b', "private_room"),
        (r'\b(?:single\s+room|small\s+room|second\s+bed(?:room)?)\b', "single"),
    ],
    "shared_living": [
        (r'\b(?:shared\s+(?:apartment|house|home|accommodation|living|space|place))\b'
         r'|\b(?:looking\s+for\s+(?:a\s+)?roommate|housemate|flatmate)\b'
         r'|\b(?:roommate\s+(?:wanted|needed))\b'
         r'|\b(?:room\s+(?:available|for\s+rent)\s+in\s+(?:a\s+)?(?:shared|[23]\s*(?:bed|br)))\b', True),
        (r'\b(?:entire\s+(?:unit|suite|apartment)|whole\s+(?:apartment|house|unit)|no\s+roommates?)\b', False),
    ],
    "furniture_level": [
        (r'\b(?:unfurnished|un[\s-]?furnished|no\s+furniture|not\s+furnished|bring\s+your\s+own\s+furniture)\b',
         "unfurnished"),
        (r'\b(?:fully|completely|100%)\s+furnished\b'
         r'|\bfurnished\s+(?:with\s+)?(?:everything|all)\b'
         r'|\bturn[\s-]?key\b', "fully_furnished"),
        (r'\b(?:partially|partly|semi[\s-]?)\s*furnished\b'
         r'|\bfurnished\s+(?:with|includes?)\b'
         r'|\b(?:bed|desk|dresser|table)\s+(?:included|provided)\b', "partially_furnished"),
        (r'\bfurnished\b', "fully_furnished"),
    ],
    "furnished_bedroom": [
        (r'\b(?:furnished\s+(?:private\s+)?bed(?:room)?)\b'
         r'|\b(?:private\s+furnished\s+bed(?:room)?)\b'
         r'|\b(?:bed(?:room)?\s+(?:is\s+)?(?:fully\s+)?furnished)\b'
         r'|\b(?:room\s+(?:comes?\s+)?(?:fully\s+)?furnished)\b', True),
        (r'\b(?:unfurnished\s+(?:private\s+)?bed(?:room)?|bed(?:room)?\s+(?:is\s+)?unfurnished)\b'
         r'|\b(?:bring\s+your\s+own\s+(?:bed|furniture))\b'
         r'|\b(?:bed(?:room)?\s+not\s+furnished)\b', False),
    ],
    "furnished_common": [
        (r'\b(?:shared\s+(?:spaces?|areas?)\s+(?:are\s+)?(?:fully\s+)?furnished)\b'
         r'|\b(?:fully\s+furnished\s+(?:shared\s+)?(?:kitchen|living|common))\b'
         r'|\b(?:furnished\s+(?:common|shared|living)\s+(?:area|space))\b'
         r'|\b(?:(?:common|shared)\s+areas?\s+(?:fully\s+)?furnished)\b', True),
    ],
    "bathroom_type": [
        (r'\b(?:private|own|ensuite|en[\s-]?suite|personal|full\s+private)\s+(?:bath(?:room)?|washroom|shower)\b'
         r'|\b(?:bath(?:room)?|washroom)\s+(?:private|ensuite|en[\s-]?suite)\b'
         r'|\byour\s+own\s+(?:bath(?:room)?|washroom)\b', "private"),
        (r'\b(?:shared|share|common|communal)\s+(?:bath(?:room)?|washroom|shower)\b'
         r'|\b(?:bath(?:room)?|washroom)\s+(?:shared|share)\b', "shared"),
    ],
    "laundry_type": [
        (r'\b(?:in[\s-]?(?:suite|unit)\s+(?:washer|laundry|w/d))\b'
         r'|\b(?:laundry|washer|w/d|washer[\s/&]+dryer)\s+(?:in|inside)\s+(?:unit|suite|apartment|home)\b'
         r'|\bin[\s-]?(?:unit|suite)\s+(?:laundry|washer|w/d)\b'
         r'|\bw/d\s+in\s+(?:unit|suite)\b', "in_unit"),
        (r'\b(?:laundry|washer)\s+(?:in[\s-]?building|on[\s-]?site|shared|common|downstairs)\b'
         r'|\b(?:shared|common|coin)\s+(?:laundry|washer)\b'
         r'|\blaundry\s+(?:room|facilities?)\s+(?:available|on|in)\b', "in_building"),
    ],
    "transit_proximity": [
        (r'\b(?:near|close\s+to|next\s+to|steps?\s+(?:from|to)|walk(?:ing)?\s+(?:distance\s+)?(?:from|to)|'
         r'block[s]?\s+(?:from|to)|min(?:ute)?s?\s+(?:from|to|walk))\s+'
         r'(?:the\s+)?(?:skytrain|sky[\s-]?train)\b', "near_skytrain"),
        (r'\b(?:near|close|walk|block|min)\b.*?\b(?:' + _SKYTRAIN_STATIONS +
         r')\s*(?:station|skytrain|sky\s+train)\b', "near_skytrain"),
        (r'\b(?:near|close\s+to|steps?\s+to|walk(?:ing)?\s+to)\s+(?:the\s+)?(?:bus|b[\s-]?line|transit\s+stop)\b'
         r'|\b(?:bus\s+(?:stop|route)\s+(?:near|close|outside|steps?))\b'
         r'|\b(?:on\s+(?:a\s+)?(?:bus|transit)\s+(?:route|line))\b', "near_bus"),
        (r'\b(?:excellent|great|good|convenient|easy)\s+(?:access\s+to\s+)?'
         r'(?:transit|transportation|public\s+transit|public\s+transport)\b'
         r'|\btransit[\s-]?(?:friendly|oriented|accessible)\b', "good_transit"),
    ],
    "dishwasher": [(r'\bdishwasher\b', True)],
    "balcony": [(r'\b(?:balcon(?:y|ies)|patio|deck|terrace|outdoor\s+space)\b', True)],
    "fireplace": [(r'\b(?:fireplace|gas\s+fireplace|electric\s+fireplace)\b', True)],
    "air_conditioning": [
        (r'\b(?:air\s+condition(?:ing|er|ed)|a/?c|central\s+air|portable\s+ac|mini[\s-]?split)\b', True),
    ],
    "ev_charging": [
        (r'\b(?:ev\s+charg(?:ing|er)|electric\s+vehicle\s+charg(?:ing|er)|level\s+2\s+charg)\b', True),
    ],
    "gym_access": [
        (r'\b(?:gym|fitness\s+(?:centre|center|room)|exercise\s+room|work[\s-]?out\s+(?:room|facility))\b', True),
    ],
    "storage_locker": [
        (r'\b(?:storage\s+locker|locker\s+(?:included|available)|storage\s+(?:unit|space|included))\b', True),
    ],
    "close_to_amenities": [
        (r'\b(?:walkable\s+to\s+(?:lots\s+of\s+)?(?:shops?|stores?|restaurants?|cafes?|groceries|grocery|amenities))\b'
         r'|\b(?:close\s+to\s+(?:shops?|stores?|restaurants?|amenities|everything))\b'
         r'|\b(?:steps?\s+(?:from|to)\s+(?:shops?|restaurants?|cafes?|amenities))\b'
         r'|\b(?:near\s+(?:all\s+)?amenities)\b'
         r'|\b(?:walking\s+distance\s+to\s+(?:shops?|restaurants?|groceries|amenities))\b', True),
    ],
    "has_views": [
        (r'\b(?:city\s+view|mountain\s+view|ocean\s+view|water\s+view|park\s+view)\b'
         r'|\b(?:views?\s+of\s+(?:the\s+)?(?:city|mountains?|ocean|water|park|inlet|harbour))\b'
         r'|\b(?:with\s+(?:a\s+)?(?:beautiful|stunning|gorgeous|amazing)?\s*views?)\b'
         r'|\b(?:rooms?\s+with\s+(?:city\s+)?views?)\b', True),
    ],
    "utilities_included": [
        (r'\b(?:no\s+utilities|utilities\s+not\s+included|utilities\s+extra|hydro\s+extra)\b', False),
        (r'\b(?:utilities?\s+included|all\s+(?:bills?|utilities?)\s+included)\b'
         r'|\b(?:hydro\s+included|heat\s+included|internet\s+included)\b'
         r'|\b(?:includes?\s+(?:all\s+)?utilit(?:y|ies))\b'
         r'|\b(?:all[\s-]?inclusive|everything\s+included)\b', True),
    ],
    "parking_included": [
        (r'\b(?:no\s+parking|parking\s+not\s+included|street\s+parking\s+only)\b', False),
        (r'\b(?:parking\s+(?:included|available|spot|space|stall))\b'
         r'|\b(?:underground\s+parking|covered\s+parking)\b'
         r'|\b(?:(?:1|one|two|2)\s+parking\s+(?:spot|space|stall))\b'
         r'|\b(?:includes?\s+parking)\b', True),
    ],
    "pets_allowed": [
        (r'\b(?:no\s+pets?|pets?\s+not\s+allowed|sorry\s+no\s+pets?|pet[\s-]?free)\b', False),
        (r'\b(?:pet[\s-]?friendly|pets?\s+(?:ok|okay|welcome|allowed))\b'
         r'|\b(?:cats?\s+(?:ok|okay|welcome|allowed))\b'
         r'|\b(?:dogs?\s+(?:ok|okay|welcome|allowed))\b'
         r'|\b(?:small\s+pets?\s+(?:ok|allowed))\b', True),
    ],
}

# --------------------------------------------------------------------------
# Extractors that read numbers or text out of a match.
# --------------------------------------------------------------------------

# Age range: groups 1 and 2; both ends must lie in AGE_BOUNDS, else the next
# pattern is tried.
AGE_RANGE_PATTERNS: list[str] = [
    r'(?:in\s+their|ages?|aged?)\s+(\d{2})[\s\-\']*(?:s\s*[\-–to]+\s*)?(\d{2})[\s\']*s?\b',
    r"(\d{2})[\'\u2019]?s\s+(?:and|or|to)\s+(\d{2})[\'\u2019]?s",
    r'(?:between|ages?)\s+(\d{2})\s*[\-–to]+\s*(\d{2})',
]
AGE_BOUNDS = (18, 80)

# Minimum lease: group 1 times the unit (patterns 4 and 5 are written in
# years, so their number counts 12 months); the result must lie in
# LEASE_MONTH_BOUNDS, else the next pattern is tried.
MIN_LEASE_PATTERNS: list[tuple[str, int]] = [
    (r'(?:minimum|min\.?)\s*:?\s*(\d+)[\s-]*(?:month|mth)', 1),
    (r'(\d+)[\s-]*(?:month|mth)\s*(?:minimum|min|lease|commitment|term|sublet)', 1),
    (r'(?:lease|term)\s*:?\s*(\d+)[\s-]*(?:month|mth)', 1),
    (r'(\d+)[\s-]*(?:year|yr)\s*(?:minimum|min|lease|commitment|term)', 12),
    (r'(?:minimum|min\.?)\s*:?\s*(\d+)[\s-]*(?:year|yr)', 12),
]
LEASE_MONTH_BOUNDS = (1, 60)

# Availability date: month name + day + year, then Y-M-D, then "immediate".
MONTH_NAMES = (
    r'(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?'
    r'|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)'
)
AVAILABLE_MONTH_DATE_PATTERN = (
    r'(?:available|move[\s-]?in|starting|from)\s+' + MONTH_NAMES + r'\s+(\d{1,2})(?:st|nd|rd|th)?,?\s*(\d{4})'
)
AVAILABLE_ISO_DATE_PATTERN = r'(?:available|move[\s-]?in|starting|from)\s+(\d{4})[/-](\d{1,2})[/-](\d{1,2})'
AVAILABLE_NOW_PATTERN = r'(?:available|move[\s-]?in)\s+(?:immediately|now|asap|right\s+away)'
AVAILABLE_NOW_VALUE = "immediate"

# Price range: on the original (not lower-cased) text, case-insensitive;
# only the first match is tried; both ends in PRICE_BOUNDS and lo < hi.
PRICE_RANGE_PATTERN = r'\$\s*([\d,]+)\s*[\-–—to]+\s*\$\s*([\d,]+)\s*(?:/\s*(?:mo(?:nth)?|mth))?'

# Transit description: group 1 of the first pattern that matches, stripped.
TRANSIT_DESCRIPTION_PATTERNS: list[str] = [
    r'(\d+[\s-]?(?:minute|min|block)s?\s+(?:walk\s+)?(?:from|to)\s+[^.,;!]{3,40}?(?:skytrain|sky[\s-]?train|station))',
    r'((?:close|near|next|adjacent|walking\s+distance)\s+(?:to\s+)?[^.,;!]{3,40}?(?:skytrain|sky[\s-]?train|station))',
    r'(\d+[\s-]?(?:minute|min|block)s?\s+(?:walk\s+)?(?:from|to)\s+[^.,;!]{3,30}?(?:bus|transit|b[\s-]?line))',
]

# Bedrooms: one digit (group 1 or 2) of the first match, in ROOM_BOUNDS.
BEDROOM_PATTERN = (
    r'(\d)\s*[\-]?\s*(?:br|bed(?:room)?s?|bdrm|bdr)\b'
    r'|(\d)\s*[\-]?\s*bedroom'
)
# Bathrooms: a number with at most one decimal, in ROOM_BOUNDS, rounded up.
BATHROOM_PATTERN = r'(\d+(?:\.\d)?)\s*[\-]?\s*(?:bath(?:room)?s?|ba)\b'
ROOM_BOUNDS = (1, 10)

# --------------------------------------------------------------------------
# Monthly price from a price text (case-insensitive).  Each
# pattern's first match is tried in turn; commas are dropped; a value outside
# PRICE_BOUNDS (or no digits) falls through to the next pattern.
# --------------------------------------------------------------------------
PRICE_PATTERNS: list[str] = [
    r'\$\s*([\d,]+)',
    r'([\d,]+)\s*/\s*mo',
    r'([\d,]+)\s*/\s*month',
    r'([\d,]+)\s*(?:per|a)\s*month',
]
PRICE_BOUNDS = (100, 10_000)

# --------------------------------------------------------------------------
# Capture clean-up.
# --------------------------------------------------------------------------
QR_BOILERPLATE_PATTERN = r'QR Code Link.*'          # case-insensitive, to end of line
CRAIGSLIST_ID_PATTERN = r'/(\d+)\.html'             # -> "cl-" + digits
KIJIJI_ID_PATTERN = r'/(\d+)$'                      # -> "kj-" + digits
CRAIGSLIST_SQFT_PATTERN = r'(\d+)\s*ft'              # per attribute text, last hit wins
KIJIJI_SQFT_PATTERN = r'(\d+)\s*(?:sq|ft|sqft)'       # per attribute row, last hit wins
CRAIGSLIST_BASE_URL = "https://vancouver.craigslist.org"
KIJIJI_BASE_URL = "https://www.kijiji.ca"
POST_NEWLINES_PATTERN = r'\n{3,}'                   # -> two newlines
MIN_POST_CHARS = 20                                 # shorter posts are skipped
POST_DEDUP_PREFIX_CHARS = 100                       # dedup key length for posts
DUMP_SEPARATOR = "---"

# Relative dates: "N unit(s) ago" anchored at the start, after "a"/"an" -> 1.
RELATIVE_DATE_PATTERN = r'(\d+)\s+(second|minute|hour|day|week|month)s?\s+ago'
ARTICLE_PATTERN = r'\ban?\b'
RELATIVE_NOW_WORDS = ("just now", "moments ago")
RELATIVE_UNIT_SECONDS = {
    "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 30 * 86400,
}

# Listing type by substring, first hit wins; no hit keeps the current type.
# Variant A (card/detail pages of the first site) and variant B (second site).
LISTING_TYPE_RULES_A: list[tuple[tuple[str, ...], str]] = [
    (("basement suite", "basement apt"), "basement_suite"),
    (("studio", "bachelor"), "studio"),
    (("laneway", "lane way", "coach house"), "laneway"),
    (("shared room", "share room", "shared bedroom"), "room_shared"),
    (("private room", "room in", "room for rent"), "room_private"),
    (("1 br", "1 bed", "one bed"), "1br"),
    (("2 br", "2 bed", "two bed"), "2br"),
]
LISTING_TYPE_RULES_B: list[tuple[tuple[str, ...], str]] = [
    (("basement suite", "basement apt"), "basement_suite"),
    (("studio", "bachelor"), "studio"),
    (("laneway", "lane way", "coach house"), "laneway"),
    (("shared room", "share room"), "room_shared"),
    (("private room", "room in", "room for rent"), "room_private"),
]
LISTING_TYPES = (
    "room_shared", "room_private", "basement_suite", "studio", "1br", "2br", "3br", "house", "laneway", "other",
)
SOURCES = ("craigslist", "kijiji", "facebook")
