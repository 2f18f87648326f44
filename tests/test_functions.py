import datetime

import pytest
from pyspark.sql import functions as F

from concord.functions import names, scores, text, times, titles
from concord.functions.text import let


def values(spark, rows, expression, kind="string"):
    rows = rows if isinstance(rows[0], tuple) else [(r,) for r in rows]
    columns = ", ".join(f"c{i} {kind}" for i in range(len(rows[0])))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, " + columns)
    return [r.v for r in df.select("n", expression.alias("v")).orderBy("n").collect()]


def test_let_computes_once(spark):
    assert values(spark, ["a"], let(F.upper("c0"), lambda x: F.concat(x, x))) == ["AA"]


def test_normalize_time(spark):
    pairs = {"18:00": "6:00 PM", "0:30": "12:30 AM", "12:05": "12:05 PM", "18:00-21:30": "6:00 PM - 9:30 PM", " 9:00 – 13:15 ": "9:00 AM - 1:15 PM", "6pm": "6pm", "6:00 PM": "6:00 PM", "25:00": "1:00 PM", "later": "later", "": "", None: None, "JAMboree 5": "JAMboree 5"}
    assert values(spark, list(pairs), times.normalize_time("c0")) == list(pairs.values())


def test_split_time_range(spark):
    pairs = {
        "6-9 PM": ("6:00 PM", "9:00 PM"), "6:00 - 9:00 PM": ("6:00 PM", "9:00 PM"), "9:00 - 1:00 AM": ("9:00 AM", "1:00 AM"), "11 AM - 2": ("11:00 AM", "2:00 AM"), "5:00 PM - 8:00 PM CST": ("5:00 PM", "8:00 PM"),
        "6:30 pm CT": ("6:30 PM", None), "7 to 9 p.m.": ("7:00 PM", "9:00 PM"), "6PM": ("6:00 PM", None), "6–9 pm": ("6:00 PM", "9:00 PM"), "6-9": ("6-9", None), "7": ("7", None), "After the Parade": ("After the Parade", None), "": ("", None), None: (None, None), "6a": ("6a", None),
    }
    got = values(spark, list(pairs), times.split_time_range("c0"))
    assert [(r["start"], r["end"]) for r in got] == list(pairs.values())
    assert values(spark, ["6-9 PM", "7pm", None, "x"], times.format_time_range("c0")) == ["6:00 PM - 9:00 PM", "7:00 PM", None, "x"]


def test_start_minutes(spark):
    pairs = {"6:00 pm": 1080, "6:00 - 9:00 PM": 1080, "9:00 - 1:00 AM": 1260, "12:00 - 4:00 PM": 720, "After the Parade": None, "noon": 720, "Midnight": 0, "12 am": 0, "13 pm": None, "18:30": 1110, "24:00": None, "5:75 pm": None, "7": 420, "7pm - 10pm": 1140, None: None, "": None}
    assert values(spark, list(pairs), times.start_minutes("c0")) == list(pairs.values())
    assert values(spark, [("6 pm", "18:00"), ("6 pm", "7 pm"), ("x", "7 pm"), (None, None)], times.times_conflict("c0", "c1")) == [False, True, False, False]


def test_venue_default_time(spark):
    rows = [("Papa Surf", None), ("Papa Surf", " tbd "), ("Papa Surf", "7 PM"), ("papa surf", "TBD"), (None, ""), ("Elsewhere", None)]
    assert values(spark, rows, times.apply_venue_default_time("c0", "c1")) == ["6:00 - 9:00 PM", "6:00 - 9:00 PM", "7 PM", "TBD", "", None]


def test_weekdays(spark):
    rows = [("Saturday", "2026-08-07"), ("sunday", "2026-08-07"), ("This Saturday", "2026-08-07"), ("Monday", "2026-08-02"), (None, "2026-08-02")]
    day = lambda x: x and datetime.date.fromisoformat(x)
    assert values(spark, rows, times.current_week_date("c0", F.to_date("c1"))) == [day("2026-08-08"), day("2026-08-02"), None, day("2026-08-03"), None]
    assert values(spark, [("Sunday", "2026-07-08"), ("Monday", "2026-07-08")], times.anchored_date("c0", F.to_date("c1"))) == [day("2026-07-12"), day("2026-07-06")]


def test_dates(spark):
    pairs = {"Saturday, August 8, 2026": "2026-08-08", "august 8, 2026": "2026-08-08", "Saturday August 8, 2026": "2026-08-08", "8/8/2026": "2026-08-08", "2026-08-08": "2026-08-08", "2026-02-30": None, "soon": None, None: None, "": None}
    assert values(spark, list(pairs), times.parse_when("c0")) == list(pairs.values())
    assert values(spark, ["July 4", "July 4, 2025", "room 1234", "x"], times.parse_lineup_date("c0", F.lit(2026))) == ["2026-07-04", "2025-07-04", None, None]
    assert values(spark, ["2026-07-23", "2026-07-11", "2026-07-01", "2026-07-22"], times.ordinal_date(F.to_date("c0"))) == ["July 23rd, 2026", "July 11th, 2026", "July 1st, 2026", "July 22nd, 2026"]
    assert values(spark, ["2026-08-08", "bad", None], times.short_date("c0")) == ["Sat Aug 08", "bad", ""]
    assert values(spark, ["2026-02-28", "2026-02-30", " 2026-1-5 ", "", None, "2026"], times.valid_date("c0")) == [True, False, True, False, False, False]


def test_feed_stamps(spark):
    got = values(spark, ["2026-07-19 17:00:00", "2026-07-19T00:05:00", "2026-07-19", None], times.split_datetime("c0"))
    assert [(r["date"], r["time"]) for r in got] == [("2026-07-19", "5:00 pm"), ("2026-07-19", "12:05 am"), (None, None), (None, None)]
    got = values(spark, ["20260613T220000Z", "20260113T010000Z", "20260613T220000", "x", None], times.parse_utc("c0"))
    assert [str(x) if x else None for x in got] == ["2026-06-13 17:00:00", "2026-01-12 19:00:00", None, None, None]
    cells = values(spark, ["6:00 pm to 9:00 PM", "at 7:30pm!", "late"], times.cell_time("c0"))
    assert [(r["start"], r["end"]) for r in cells] == [("6:00 pm", "9:00 PM"), ("7:30pm", None), (None, None)]
    assert [tuple(r) for r in values(spark, ["Time: 7ish\nmore", "5:00 pm to 6:00 pm Time: x"], times.parse_time("c0"))] == [("7ish", None), ("5:00 pm", "6:00 pm")]


def test_canonicalize(spark):
    pairs = {"BOUCOU GROOVE": "Boukou Groove", "papasurf": "Papa Surf", "STINKY’S BAIT SHACK": "Stinky's Bait Shack", "O'BRIEN 30AVENUE": "O'Brien 30Avenue", "DJ SHADOW": "DJ Shadow", "Already Fine": "Already Fine", "  The Typos ": "The Typos", "WE'LL SEE": "We'll See", "123": "123", "": "", None: None, "“Q” — x": '"Q" - x', "The Kennedy’s": "The Kennedys"}
    assert values(spark, list(pairs), names.canonicalize("c0")) == list(pairs.values())
    rows = [("Dion Jones", "Stinky's Bait Shack"), ("Dion Jones", "North Beach Social"), (None, "x")]
    assert values(spark, rows, names.apply_venue_alias("c0", "c1")) == ["Dion Jones & The Neon Tears", "Dion Jones", None]


def test_keys_and_types(spark):
    assert values(spark, [(" A\t", None, " 2026-01-01 ")], names.identity_key("c0", "c1", "c2")) == ["a||2026-01-01"]
    pairs = {"image:x.png": "image", "OCR scan": "ocr", "Instagram": "social", "seed": "manual", "venue": "website", None: "website"}
    assert values(spark, list(pairs), names.observation_type("c0")) == list(pairs.values())
    pairs = {"live at CHIRINGO!": "Chiringo", "ed fish taco": "Red Fish Taco", "AJs of Grayton": "AJ's Grayton", "moe's": "Moe's BBQ", "nowhere": None, None: None}
    assert values(spark, list(pairs), names.match_venue("c0")) == list(pairs.values())
    assert values(spark, ["a\\, b\\; c\\nd\\\\e"], names.unescape_ics("c0")) == ["a, b; c\nd\\e"]
    assert values(spark, ["<p>A&nbsp;&amp; B</p>\n c"], names.strip_html("c0")) == ["A & B c"]
    assert values(spark, ["/in/zoe_blue.png"], names.artist_of_file("c0")) == ["Zoe Blue"]


def test_scores(spark):
    pairs = {"image:a": 0.8, "OCR": 0.5, "venue:x": 0.95, "crawler": 0.9, "seed": 0.6, "other": 0.5, None: 0.5}
    assert values(spark, list(pairs), scores.source_trust("c0")) == list(pairs.values())
    assert values(spark, [0.8, 0.79, 0.5, 0.1, None], scores.band("c0"), "double") == ["high", "medium", "medium", "low", "unknown"]
    assert values(spark, ["0.5", "7", "-1", "x", None], scores.clamped("c0")) == [0.5, 1.0, 0.0, None, None]


def test_titles(spark):
    pairs = {"A @ B @ C": ("A", "B @ C"), "Series at Rosemary at Beach": ("Series at Rosemary", "Beach"), "Trivia at 7pm": ("Trivia at 7pm", None), "Plain": ("Plain", None), "": ("", None), None: ("", None), "X @ ": ("X", None)}
    assert [tuple(r) for r in values(spark, list(pairs), titles.split_title("c0"))] == list(pairs.values())
    pairs = {"Live Music": True, "Live Music with the Band": True, "Live Music Zoe": False, "": False, None: False, "Sunset & Bonfire": True}
    assert values(spark, list(pairs), titles.is_generic_title("c0")) == list(pairs.values())
    pairs = {"DJ Night": "dj", "Open-Mic": "open_mic", "Bubbles Sip N' Shop": "sip_n_shop", "Djembe": None}
    assert values(spark, list(pairs), titles.detect_category("c0")) == list(pairs.values())
    pairs = {"Farmers Market": "farmers_market", "5k run": "sporting_event", "Airshow": "air_show", "Moon Crush": None}
    assert values(spark, list(pairs), titles.detect_non_music("c0")) == list(pairs.values())


def test_performers_in_text(spark):
    pairs = {"live music from Christon Birge, all day": "Christon Birge", "brunch with friends": None, "with Kévin Noël and": "Kévin Noël", "featuring Live Music": None, "feat. The Aces Band.": "The Aces Band", "music with dinner": None, None: None}
    assert values(spark, list(pairs), titles.performer_in_text("c0")) == list(pairs.values())
    pairs = {"Live Music: Dion Jones & The Neon Tears": "Dion Jones & The Neon Tears", "Happy Hour": None, "3HG": "3HG", "Karaoke": None, "Jam with Zoe Blue": "Zoe Blue", "Live Music": None, "Sunday Deck": None}
    assert values(spark, list(pairs), titles.section_feed_performer("c0")) == list(pairs.values())


def test_classification(spark):
    rows = [("Zoe @ Hall", "", "named", "Zoe", "title"), ("Live Music @ Hall", "with Zoe Blue", "named", "Zoe Blue", "description"), ("Live Music", "", "unresolved", None, "unresolved"), ("Karaoke", "", "category", None, "category"), ("Block Party", "music by Weston Hines", "named", "Weston Hines", "description"), ("Car Show", "with Zoe Blue", "category", None, "non_music")]
    got = values(spark, [r[:2] for r in rows], titles.classify_performer("c0", "c1"))
    assert [(r.performer_status, r.performer, r.extraction_method) for r in got] == [r[2:] for r in rows]
    text = "July 15th: The Aces Band July 22nd : TBA July 29: Shenanigans " + "x" * 90
    found = values(spark, [text], titles.prose_lineup("c0", F.lit(2026)))[0]
    assert [(e["date"], e["name"]) for e in found] == [("2026-07-15", "The Aces Band"), ("2026-07-22", "TBA")]
    resolve = lambda date: titles.resolve_performer(F.lit("Baytowne Wednesday Night Concert Series"), F.col("c0"), F.lit(date), F.lit(2026))
    assert values(spark, [text], resolve("2026-07-15"))[0].performer == "The Aces Band"
    assert values(spark, [text], resolve("2026-07-22"))[0].performer_status == "unresolved"
    assert values(spark, [text], resolve("2026-09-01"))[0].performer_status == "unresolved"
    assert values(spark, ["See the full lineup below"], titles.resolve_performer(F.lit("Mystery Night"), F.col("c0"), F.lit("2026-09-01"), F.lit(2026)))[0].performer is None
    emoji = "2026 LINEUP: \U0001f3b6 July 19 - Zoe Blue \U0001f3b6⁠ Aug 2 - The Aces"
    assert values(spark, [emoji], titles.emoji_lineup_performer("c0", F.lit("2026-08-02"))) == ["The Aces"]
    rows = [("named", "true"), ("named", None), ("category", None), (None, None)]
    assert values(spark, rows, titles.partition_status("c0", F.col("c1").cast("boolean"))) == ["named", "unresolved", "category", "unresolved"]


@pytest.mark.parametrize("confidences,conflict,want", [([0.96], 0, 0.96), ([0.96, 0.9], 0, 0.978), ([0.96, 0.9, 0.9], 0, 0.988), ([0.99] * 10, 0, 0.99), ([0.96, 0.3], 0, 0.966), ([0.9, 0.85], 0, 0.943), ([0.9], 1, 0.765), ([0.8, 0.5], 0, 0.85)])
def test_combined_confidence(spark, confidences, conflict, want):
    from concord.operators.aggregate import combined_confidence, source_confidences

    rows = spark.createDataFrame([("k", f"s{i}", c) for i, c in enumerate(confidences)] + [("k", "s0", 0.01)], "k string, source string, confidence double")
    assert source_confidences(rows, ["k"]).select(combined_confidence(conflict=F.lit(bool(conflict))).alias("v")).first().v == want


def test_strip_by_name_is_strip(spark):
    ends = ["", " ", "\t", " ", "　", "​", "\x7f", "\x00", "!", "~", "é", "日"]
    rows = [a + "b c" + b for a in ends for b in ends] + [*ends, None]
    assert values(spark, rows, text.strip("c0")) == values(spark, rows, text.strip(F.col("c0")))


def test_plain_times_have_the_minutes_of_others(spark):
    rows = [f"{h}:{m} {x}" for h in range(1, 13) for m in ("00", "05", "59") for x in ("AM", "PM")]
    assert values(spark, rows, times.start_minutes("c0"), "string") == values(spark, [r.lower() for r in rows], times.start_minutes("c0"), "string")
