"""Name, label and market-text functions, all as built-in column expressions."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.aliases import ALIASES, lookup


def _plain(char: str) -> str:
    parts = unicodedata.normalize("NFKD", char)
    return "".join(p for p in parts if not unicodedata.combining(p)).lower()


def _ranges(chars: Iterable[str]) -> str:
    """A class of a regular expression that holds just these characters, none of them ASCII."""
    codes = sorted(map(ord, chars))
    firsts = [c for c in codes if c - 1 not in codes]
    lasts = [c for c in codes if c + 1 not in codes]
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip(firsts, lasts, strict=True)) + "]"


@cache
def _foldings() -> tuple[str, str, str]:
    """Tables derived from the Unicode data: characters that become one letter or digit, the
    letters they become (combining marks become nothing), and JSON of those that become several."""
    single, target, marks, several = [], [], [], {}
    for code in range(128, 0x110000):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        if unicodedata.combining(char):
            marks.append(char)
            continue
        if not unicodedata.decomposition(char):
            continue
        plain = _plain(char)
        if not re.search("[a-z0-9]", plain):
            continue
        if len(plain) == 1:
            single.append(char)
            target.append(plain)
        else:
            several[char] = plain
    return "".join(single + marks), "".join(target), json.dumps(several, ensure_ascii=False)


def normalize_person(col: Column | str) -> Column:
    """Accents, case and punctuation removed: compatibility decomposition, marks dropped, lower case,
    everything else than ``a-z0-9`` one blank. Null becomes the empty string.

    Spark has no Unicode normalisation function. Since only ``a-z0-9`` survives, a character table
    gives the same result inside the JVM; characters that decompose to several letters (ligatures,
    fractions, enclosed numbers) are rare and take a second path.
    """
    col = F.col(col) if isinstance(col, str) else col
    source, target, several = _foldings()
    folded = F.lower(F.translate(F.coalesce(col, F.lit("")), source, target))
    table = F.from_json(F.lit(several), "map<string,string>")
    spread = F.array_join(
        F.transform(F.split(folded, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    # Only names with a character of the second table look there: a letter without a decomposition stays as it is anyway.
    text = F.when(folded.rlike("[^\\x00-\\x7f]") & folded.rlike(_ranges(json.loads(several))), spread).otherwise(folded)
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def canonical_nationality(col: Column | str) -> Column:
    """A player's nationality as team name: the squad table first, then the nationality table, then that by folded key."""
    name = lookup(F.trim(F.col(col) if isinstance(col, str) else col), ALIASES["squad"])
    folded = {fold(alias): team for alias, team in ALIASES["nationality"].items()} | ALIASES["nationality_key"]
    tables = [F.create_map(*[F.lit(x) for item in names.items() for x in item]) for names in (ALIASES["nationality"], folded)]
    return F.coalesce(F.try_element_at(tables[0], name), F.try_element_at(tables[1], normalize_person(name)), name)


def fold(name: str) -> str:
    """The key that ``normalize_person`` gives a name."""
    return " ".join(re.sub(r"[^a-z0-9]+", " ", "".join(_plain(c) for c in name)).split())


def normalize_person_legacy(col: Column | str) -> Column:
    """Older key: three letters folded, every other non-ASCII letter is a gap."""
    col = F.col(col) if isinstance(col, str) else col
    folded = F.translate(F.lower(F.coalesce(col, F.lit(""))), "øıđ", "oid")
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def normalize_subject(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return lookup(F.lower(F.trim(F.coalesce(col, F.lit("")))), ALIASES["subject"])


def distinct_names(*cols: Column) -> Column:
    """Ordered, de-duplicated, non-empty candidate names."""
    return F.array_distinct(F.filter(F.array(*cols), lambda x: x != ""))


def full_name(first: str, last: str) -> Column:
    return F.concat_ws(" ", F.coalesce(F.col(first), F.lit("")), F.coalesce(F.col(last), F.lit("")))


# Position spellings of the squad files.
POSITION_NAMES = {
    "Goalkeeper": "GK", "GK": "GK",
    "Defender": "DF", "Centre-Back": "DF", "Left-Back": "DF", "Right-Back": "DF", "DF": "DF",
    "Midfielder": "MID", "Central Midfield": "MID", "Defensive Midfield": "MID", "Attacking Midfield": "MID",
    "Left Midfield": "MID", "Right Midfield": "MID", "MID": "MID",
    "Forward": "FW", "Centre-Forward": "FW", "Second Striker": "FW", "Left Winger": "FW", "Right Winger": "FW",
    "FW": "FW",
}
# Pieces of position text, checked in this order, as used by current squads.
POSITION_PARTS = [
    ("GK", ["GK", "KEEPER"]),
    ("DF", ["CB", "LB", "RB", "BACK", "DEF"]),
    ("MID", ["CM", "DM", "AM", "MID"]),
    ("FW", ["ST", "CF", "LW", "RW", "FW", "WINGER", "FORWARD"]),
]
# Position codes and words of the historical rating files.
POSITION_CODES = [
    ("GK", ["GK"]),
    ("DF", ["CB", "LB", "RB", "LWB", "RWB", "SW"]),
    ("MID", ["CM", "CDM", "CAM", "LM", "RM"]),
    ("FW", ["ST", "CF", "LW", "RW", "LF", "RF"]),
]
# Position codes of squad layouts.
LAYOUT_CODES = [
    ("GK", ["GK"]),
    ("DF", ["CB", "LB", "RB", "LWB", "RWB", "DF"]),
    ("MID", ["CM", "CDM", "CAM", "LM", "RM", "MID"]),
    ("FW", ["ST", "CF", "LW", "RW", "LF", "RF", "FW"]),
]
POSITION_WORDS = [("GK", "GOALKEEPER"), ("DF", "DEFENDER"), ("MID", "MIDFIELDER"), ("FW", "FORWARD")]


def _cases(pairs: list[tuple[Column, str]], otherwise: Column | None = None) -> Column:
    out = F
    for condition, value in pairs:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit("") if otherwise is None else otherwise)


def simplify_position(col: Column | str, mode: str) -> Column:
    """GK / DF / MID / FW or empty. ``squad``: names, then pieces; ``layout``: codes, then words;
    ``rating``: the first code of a list."""
    col = F.col(col) if isinstance(col, str) else col
    text = F.trim(F.coalesce(col, F.lit("")))
    upper = F.upper(text)
    if mode == "squad":
        pieces = _cases([(upper.rlike("|".join(words)), label) for label, words in POSITION_PARTS])
        table = F.create_map(*[F.lit(x) for pair in POSITION_NAMES.items() for x in pair])
        return F.coalesce(F.try_element_at(table, text), pieces)
    if mode == "layout":
        pairs = [(upper.isin(codes), label) for label, codes in LAYOUT_CODES]
        return _cases(pairs + [(upper.contains(word), label) for label, word in POSITION_WORDS])
    if mode == "rating":
        first = F.split(upper, "[,/ ]+")[0]
        return _cases([(first.isin(words), label) for label, words in POSITION_CODES])
    raise ValueError(f"unknown mode {mode!r}")


def classify_signal(question: Column, title: Column) -> Column:
    """Kind of a prediction market from its texts; the first rule that fits."""
    text = F.lower(F.concat_ws(" ", F.coalesce(question, F.lit("")), F.coalesce(title, F.lit(""))))
    # Kinds and the phrases that mark them.
    rules = [
        ("tournament_winner", ["win the 2026 fifa world cup", "world cup winner"]),
        ("golden_boot", ["golden boot"]),
        ("advance_or_qualify", ["advance", "qualify"]),
        ("match_related", ["beat", " vs ", "match"]),
    ]

    def any_of(phrases: list[str]) -> Column:
        out = F.lit(False)
        for phrase in phrases:
            out = out | text.contains(phrase)
        return out

    return _cases([(any_of(p), kind) for kind, p in rules], F.lit("other_worldcup"))


# Question templates whose first gap is the subject.
SUBJECT_PATTERNS = [
    r"^Will (.+?) win the 2026 FIFA World Cup\?",
    r"^Will (.+?) win the World Cup\?",
    r"^Will (.+?) advance",
    r"^Will (.+?) qualify",
]


def extract_subject(question: Column) -> Column:
    found = [F.nullif(F.trim(F.regexp_extract(question, f"(?i){p}", 1)), F.lit("")) for p in SUBJECT_PATTERNS]
    return F.coalesce(*found, F.lit(""))


def is_tournament_event(*texts: Column) -> Column:
    """Football world-cup event by its texts, without ceremony and music markets."""
    text = F.lower(F.concat_ws(" ", *texts))
    # Words that rule an event out, unless it has a winner, and words it must have.
    noise = text.rlike("opening ceremony|song|perform|halftime") & ~text.contains("winner")
    football = text.rlike("fifa|soccer|football|national team|golden boot|winner")
    return text.contains("world cup") & ~noise & football


def is_tournament_trade(*texts: Column) -> Column:
    text = F.lower(F.concat_ws(" ", *texts))
    return text.contains("fifwc") | text.contains("world cup")


def is_tournament_league(*names: Column) -> Column:
    text = F.concat_ws(" ", *names)
    return text.contains("世界杯") | text.contains("World Cup")


def score_outcome(label: Column) -> Column:
    """home_win / draw / away_win of the first ``h-a`` score in the text, else null."""
    home = F.regexp_extract(label, r"(\d+)\s*-\s*(\d+)", 1).try_cast("long")
    away = F.regexp_extract(label, r"(\d+)\s*-\s*(\d+)", 2).try_cast("long")
    return F.when(home > away, "home_win").when(home < away, "away_win").when(home == away, "draw")


def score_from_question(question: Column) -> Column:
    """``h-a`` from an exact-score question, the label of the catch-all market, or the text itself."""
    text = F.coalesce(question, F.lit(""))
    named = r"Exact Score:\s*.*?(\d+)\s*-\s*(\d+).*?\?"
    bare = r"\b(\d+)\s*-\s*(\d+)\b"
    score = lambda p: F.concat_ws("-", F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2))
    return (
        F.when(text.rlike(named), score(named)).when(text.rlike(bare), score(bare))
        .when(text.contains("Any Other Score"), "其他比分").otherwise(text)
    )
