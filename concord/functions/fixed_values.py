"""Values that are fixed by the data the engine resolves: spellings, rules and word lists."""

from __future__ import annotations

# Fixed values: (canonical spelling, variant) of venues and performers; a later pair wins.
SPELLINGS = [
    ("The Typos", "THE TYPOS"),
    ("Stevie Monce", "STEVIE MONCE"),
    ("Casey Kearney", "CASEY KEARNEY"),
    ("Casey Kearney", "Casey Kearney Band"),
    ("Casey Kearney", "CASEY KEARNEY BAND"),
    ("Will Thompson", "Will Thompson Band"),
    ("Brett Stafford", "BRETT STAFFORD"),
    ("Brett Stafford", "Brett Stafford Smith"),
    ("Cadillac Willy", "CADILLAC WILLY"),
    ("Dion Jones & The Neon Tears", "DION JONES & THE NEON TEARS"),
    ("Gage Cowart", "GAGE COWART"),
    ("Sunshine Wranglers", "SUNSHINE WRANLGERS"),
    ("Sunshine Wranglers", "The Sunshine Wranglers"),
    ("Boukou Groove", "BOUKOU GROOVE"),
    ("Boukou Groove", "Boucou Groove"),
    ("Harrison Prentice", "HARRISON PRENTICE"),
    ("Red Fish Taco", "RED FISH TACO"),
    ("Red Fish Taco", "redfishtaco"),
    ("Papa Surf", "Papa Surf Burger Bar"),
    ("Papa Surf", "PAPA SURF BURGER BAR"),
    ("Papa Surf", "Papa Surf Burger Bar 30A"),
    ("Papa Surf", "papasurfburgerbar"),
    ("Papa Surf", "PapaSurf Burger Bar"),
    ("Papa Surf", "PAPASURF BURGER BAR"),
    ("Papa Surf", "Papa Surf's, Santa Rosa"),
    ("Papa Surf", "PapaSurf"),
    ("Papa Surf", "steviemonce"),
    ("Shelby's Beach Bar", "shelbysbeachbar"),
    ("Shelby's Beach Bar", "Shelby's Beach Bar and Grill"),
    ("Shelby's Beach Bar", "Shelby's Beach Bar & Grill"),
    ("Chiringo", "chiringograyton"),
    ("North Beach Social", "NORTH BEACH SOCIAL"),
    ("North Beach Social", "northbeachsocial"),
    ("North Beach Social", "North Beach Social 1"),
    ("North Beach Social", "North Beach Social 2"),
    ("North Beach Social", "July Live Music Lineup"),
    ("North Beach Social", "july-live-music-lineup"),
    ("North Beach Social", "JULY LIVE MUSIC LINEUP"),
    ("North Beach Social", "North Beach Social, Santa Rosa"),
    ("North Beach Social", "North Beach Social (Santa Rosa Beach, FL)"),
    ("30Avenue", "30AVENUE"),
    ("Queens Handsome", "QUEENS HANDSOME"),
    ("Lips Manly", "LIPS MANLY"),
    ("Zack Miller", "ZACK MILLER"),
    ("Pickled Pickers", "PICKLED PICKERS"),
    ("Nate Kelly", "NATE KELLY"),
    ("Zoe Walega", "ZOE WALEGA"),
    ("River Dan", "RIVER DAN"),
    ("Catalyst Dance Band", "CATALYST DANCE BAND"),
    ("Black Creek String Band", "BLACK CREEK STRING BAND"),
    ("Bill Garrett", "Bill Garrett + John Reinlie @ Brunch / Vine Illers"),
    ("Bill Garrett", "Bill Garrett + John Reinlie @ Brunch / Corey Hall Trio"),
    ("Bill Garrett", "Bill Garrett + John Reinlie @ Brunch / Harrison Prentice"),
    ("The Kennedys", "The Kennedy's"),
    ("AJ's Grayton Beach", "AJ's Grayton"),
    ("Aaron Bessant Park", "Aaron Bessant Park at Pier Park"),
    ("Crackings", "Crackings. - Grayton Beach"),
    ("Hilton Sandestin Beach Golf Resort & Spa", "Hilton Sandestin Golf Resort & Spa"),
    ("Seascape Towne Centre", "Seascape Town Centre"),
    ("Seaside Amphitheater", "Seaside Ampitheatre"),
    ("Chautauqua Theater", "Florida Chautauqua Theatre"),
    ("The Village Door", "John Wehner's Village Door"),
    ("Havana Beach Bar", "Havana Beach Rooftop Bar"),
    ("Havana Beach Bar", "Havana Beach Bar & Grill"),
    ("The Big Chill 30A", "The Big Chill"),
    ("Watersound Town Center", "Watersound"),
    ("Coconut Radio", "COCONUT RADIO"),
    ("DJ 30A", "DJ30A"),
    ("DJ Q$", "DJ QS"),
    ("Gilleran's Island", "Gilleran's Island Band"),
    ("Pickled Pickers", "The Pickled Pickers"),
    ("New Cahoots", "The New Cahoots"),
    ("Bill Garrett", "Bill Garrett + John Reinlie @ Brunch / The Typos"),
    ("Bill Garrett", "Bill Garrett + John Reinlie @ Brunch / WineLers"),
    ("Michael Johnson", "Michael Johnson at Havana Beach Bar & Grill"),
    ("Martin Lane", "Martin‑Lane"),
    ("Martin Lane", "Martin Lane (acoustic duo)"),
    ("Martin Lane", "Martin‑Lane (acoustic duo)"),
    ("Martin Lane", "Lane Martin"),
    ("Harrison Prentice", "Harrison Prentice (songwriter)"),
    ("Harrison Prentice", "Songwriter Harrison Prentice"),
    ("Mike Whitty & Friends", "Sunday Pickin' w/ Mike Whitty & Friends"),
    ("Lane Maury", "Lane Maury Music"),
]

# A short billing that means another act at one venue, (performer, venue) -> performer.
VENUE_ALIASES = {("dion jones", "stinky's bait shack"): "Dion Jones & The Neon Tears"}

# Typographic characters and what they are folded to.
FANCY_CHARACTERS = "\u2018\u2019\u02bc\u00b4`\u201c\u201d\u2013\u2014"
PLAIN_CHARACTERS = "'''''\"\"--"

# Tokens that stay in capitals, and endings after an apostrophe that go to lower case.
CAPITAL_TOKENS = ["DJ", "TJ", "AJ"]
LOWER_ENDINGS = {"'S": "'s", "'T": "'t", "'D": "'d", "'M": "'m", "'Ll": "'ll", "'Re": "'re", "'Ve": "'ve"}

# Slots that venues run when no time is posted, and what counts as no time.
VENUE_DEFAULT_TIMES = {"Shelby's Beach Bar": "6:00 - 9:00 PM", "Papa Surf": "6:00 - 9:00 PM"}
MISSING_TIMES = ["", "UNKNOWN", "TBD", "N/A", "NONE"]

# Trust in a source by name; by prefix; by default.
SOURCE_TRUST = {"venue": 0.95, "sowal": 0.90, "crawler": 0.90, "dashboard_legacy": 0.85, "seed": 0.60}
SOURCE_PREFIX_TRUST = [("image:", 0.8), ("ocr", 0.5), ("venue", 0.95)]
DEFAULT_TRUST = 0.5

# What the way of extraction is worth; other ways are worth 1.
METHOD_FACTOR = {"title": 1.0, "description": 0.8, "lineup": 0.85}

# Confidence of canonical events.
CORROBORATION, CONFLICT_PENALTY, CEILING = 0.5, 0.15, 0.99
HIGH_BAND, MEDIUM_BAND = 0.80, 0.50

# Kinds of events without a named act, by first pattern.
CATEGORY_PATTERNS = [
    ("dj", r"\bdj\b"),
    ("karaoke", r"\bkaraoke\b"),
    ("open_mic", r"\bopen[\s-]?mic\b"),
    ("trivia", r"\btrivia\b"),
    ("block_party", r"\bblock\s+party\b"),
    ("sip_n_shop", r"\bsip\s*(?:n'?|&|and)\s*shop\b"),
]

# Listings that are not music, by first pattern.
NON_MUSIC_PATTERNS = [
    ("farmers_market", r"farmers?\s*market"),
    ("guided_tour", r"guided\s+\w*\s*(tour|hike|walk)|ranger[- ]?guided|ranger[- ]?led|nature\s+hike|history\s+tour"),
    ("car_show", r"\bcar\s+show\b|\bcars\s+of\s+30a\b"),
    ("sporting_event", r"\bironman\b|\btriathlon\b|\bmarathon\b|\b\d+k\s+run\b|\bfun run\b|\bday\s+run\b|trail\s+(?:race|run|trot)|\b\d+k\b|\bpoker\s+run\b"),
    ("air_show", r"\bair\s*show\b"),
    ("wine_festival", r"\bwine\s*(?:&|and)?\s*food\s+festival\b|\bwine\s+festival\b"),
    ("film_festival", r"\bmountainfilm\b|\bfilm festival\b|\bfilm series\b|\bscreening\b"),
    ("eggfest", r"\beggs on the beach\b|\beggfest\b"),
    ("county_fair", r"\bcounty\s+fair\b"),
    ("wine_tasting", r"\buncorked\b"),
    ("award_ceremony", r"\bseaside prize\b"),
    ("art_market", r"\bart\s+(?:market|walk|gallery|show)\b"),
    ("community_theater", r"\bgrit and grace\b"),
    ("bingo", r"\bbingo\b"),
    ("game_night", r"\bmahjong\b"),
    ("golf", r"\bgolf\b|\btin\s+cup\s+classic\b"),
    ("locals_market", r"\blocals?\s+market\b"),
    ("kids_activity", r"\bkids.?\s+night\s+out\b|\bpumpkin\s+carving\b|\bcostume\s+contest\b|\bbreakfast with santa\b"),
    ("stargazing", r"\bstar\s*gazing\b"),
    ("nature_program", r"\bwild sea turtle\b|\bback to nature\b"),
    ("pet_fitness", r"\bpupp(?:y|ies)\s*(?:&|and)?\s*pilates\b|\bpuppy\s+yoga\b"),
    ("wellness_talk", r"\bnutrition\s*(?:&|and)?\s*wellness\b|\bwellness\s+talk\b"),
    ("hemingway_day", r"\bhemingway day\b"),
    ("theater_production", r"\bectc\b|\bthe musical\b|\bnutcracker\b"),
    ("childrens_play", r"child(?:ren)?'?s\s+play\b"),
]

# Words that denote music without naming an act, and words that don't change that.
GENERIC_WORDS = """
live music band entertainment concert series brunch bonfire dinner sunset sunrise patio deck
monday tuesday wednesday thursday friday saturday sunday summer spring fall autumn winter
weekly nightly daily night weekend afternoon evening lineup schedule tba tbd
""".split()
FILLER_WORDS = ["&", "and", "the", "a", "an", "with", "on", "at", "of", "-", "\u2013", "\u00b7", "/"]

# Phrases before a performer's name, the name itself, and words that are no name.
STRONG_CUE = r"\b(?:featuring|feat\.|ft\.|presents|performance by|music by|music from)\s+(.+)"
WITH_CUE = r"\bwith\s+(.+)"
NAME = r"^([A-Z][\w.'\u2019-]*(?:\s+(?:&|and|the|of|[A-Z][\w.'\u2019-]*)){0,4})"
NAME_STOPWORDS = "friends family dinner lunch brunch food drinks cocktails everyone guests us you your".split()

# Series whose title names no act, prefixes before the act, and phrases that point to a lineup elsewhere.
SERIES_TITLES = [
    "Live Music @ Crackings",
    "Live Music @ Old Florida Fish House",
    "30Avenue Summer Concert Series",
    "Here Comes the Sun Summer Concert Series at Rosemary Beach",
    "Baytowne Wednesday Night Concert Series",
    "Harbor Nights at HarborWalk",
    "Wine & Song at Neat",
    "PCB Summer Concert Series",
    "Sounds Like Summer: 30A Songwriters Showcase",
    "LIVE MUSIC Mondays at Fish Out of Water",
    "Sounds of Seaside at Seaside Amphitheater",
]
SERIES_PREFIXES = ["30A Songwriters Showcase - "]
LINEUP_POINTER = r"\b(?:see|check out)\s+(?:the\s+)?(?:full\s+|music\s+|complete\s+)?line[\s-]?up\b"
MONTHS = "January February March April May June July August September October November December".split()
LONGEST_PROSE_NAME = 80

# Keywords in upper-case text that mean a venue, by first match; a list means all, "^" the beginning.
VENUE_KEYWORDS = [
    ("Chiringo", [["CHIRINGO"]]),
    ("Red Fish Taco", [["RED FISH"], ["^ED FIS"]]),
    ("Papa Surf", [["PAPA SURF"]]),
    ("Shelby's Beach Bar", [["SHELBY"]]),
    ("The Big Chill", [["BIG CHILL"]]),
    ("Watercolor Beach Club", [["WATERCOLOR"]]),
    ("Watersound Beach", [["WATERSOUND"]]),
    ("Haughty Heron", [["HAUGHTY"]]),
    ("Scallop Republic", [["SCALLOP"]]),
    ("Stinky's Bait Shack", [["STINKY"]]),
    ("Alibi Beach Lounge", [["ALIBI"]]),
    ("Moe's BBQ", [["MOES"], ["MOE'S"]]),
    ("The Dock", [["THE DOCK"]]),
    ("AJ's Grayton", [["AJ", "GRAYTON"]]),
    ("Shunk Gulley", [["SHUNK"]]),
    ("Outcast", [["OUTCAST"]]),
    ("Props Brewery SRB", [["PROPS"]]),
]
READER_GARBAGE = "\u00ff\u00a5\u00a2%"

# Promotions in the section feed that are not music.
PROMOTIONS = r"\b(happy hour|golf tournament|meet ?up|fundraiser|wine tasting|beer tasting)\b"

# Classes, short names, map searches and links of venues on the dashboard, by lower-case name.
VENUE_CLASSES = {
    "red fish taco": "vt-rft",
    "papa surf": "vt-ps",
    "papa surf burger bar": "vt-ps",
    "shelby's beach bar and gill": "vt-sbb",
    "shelby's beach bar": "vt-sbb",
    "shelby's": "vt-sbb",
    "north beach social": "vt-nbs",
    "stinky's bait shack": "vt-sbs",
    "stinky\u2019s bait shack": "vt-sbs",
    "aj's grayton": "vt-aj",
    "aj's grayton beach": "vt-aj",
    "the pavilion at watersound town center": "vt-pav",
    "chiringo": "vt-chi",
    "30avenue": "vt-30a",
    "mcguire's destin": "vt-mcg",
    "mcguire\u2019s destin": "vt-mcg",
    "crackings": "vt-crk",
    "local catch bar & grill": "vt-lcb",
    "seaside amphitheater": "vt-sea",
    "shunk gulley": "vt-sgl",
    "stinky's fish camp": "vt-sfc",
    "stinky\u2019s fish camp": "vt-sfc",
    "the bay": "vt-bay",
    "the red bar": "vt-trb",
    "watersound town center": "vt-wsc",
    "rosemary beach": "vt-rsb",
    "rosemary beach town hall": "vt-rsb",
    "fish out of water": "vt-fow",
    "old florida fish house": "vt-ofh",
}
DEFAULT_VENUE_CLASS = "vt-def"
VENUE_FALLBACK_URLS = {
    "papa surf": "https://instagram.com/papasurfburgerbar",
    "papa surf burger bar": "https://instagram.com/papasurfburgerbar",
    "shelby's beach bar": "https://instagram.com/shelbysbeachbar",
    "shelby's beach bar and gill": "https://instagram.com/shelbysbeachbar",
    "shelby's": "https://instagram.com/shelbysbeachbar",
}
VENUE_MAP_SEARCHES = {
    "aj's grayton": "AJ's Grayton Beach, FL",
    "aj's grayton beach": "AJ's Grayton Beach, FL",
    "the pavilion at watersound town center": "The Pavilion at Watersound Town Center, FL",
    "mcguire's destin": "McGuire's Irish Pub, Destin, FL",
    "mcguire\u2019s destin": "McGuire's Irish Pub, Destin, FL",
}
VENUE_SHORT_NAMES = {"the pavilion at watersound town center": "The Pavilion at WTC"}
MAP_EMBED = ("https://www.google.com/maps?q=", "&output=embed")
MAP_SEARCH = "https://www.google.com/maps/search/?api=1&query="
BAND_CLASSES = {"high": "cf-hi", "medium": "cf-md", "low": "cf-lo"}
DEFAULT_BAND_CLASS = "cf-md"

# Endings of image files; seed events without their date; a curated listing's source and body.
IMAGE_ENDINGS = [".png", ".jpg", ".jpeg", ".webp", ".gif"]
SEED_EVENTS = [
    {"name": "Stevie Monce at Chiringo", "time_start": "6PM", "venue": "Chiringo", "performer": "Stevie Monce", "url": "https://instagram.com/steviemonce"},
    {"name": "Casey Kearney at Shunk Gulley", "time_start": "7PM", "venue": "Shunk Gulley", "performer": "Casey Kearney", "url": "https://instagram.com/caseykearney"},
]
#: Confidence that events of old stores get by their source, the first that matches.
BACKFILL_TRUST = {"image:%": 0.8, "ocr%": 0.5, "sowal": 0.9, "crawler": 0.9, "seed": 0.6}
BACKFILL_TRUST_OTHER, BACKFILL_REASON = 0.5, "backfilled at v2 migration from source trust"
FLYER_CLASS = "image-_bohr-body-image-full-width"
CURATED_SOURCE, CURATED_BODY = "dashboard_legacy", "tb"

# The wording of a changelog in text.
CHANGELOG_HEAD = ["Changelog: %s", "Recorded: %s", "+%d new  ~%d changed  -%d removed  %d unchanged"]
CHANGELOG_TITLES = {"new": "New (%d):", "changed": "Changed (%d):", "removed": "Removed (%d):"}
CHANGELOG_EVENT, CHANGELOG_FIELD = "  \u00b7 %s", "      %s: %s -> %s"
