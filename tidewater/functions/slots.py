"""Validity of the slots of a broadcast line, as expressions: each slot gives a verdict or null where it does not occur."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.text import squeeze

# Digit words, spelling alphabet.
DIGITS = ("ZERO", "ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE")
ALPHABET = ("ALPHA", "ALFA", "BRAVO", "CHARLIE", "DELTA", "ECHO", "FOXTROT", "GOLF", "HOTEL", "INDIA", "JULIET", "KILO", "LIMA", "MIKE", "NOVEMBER", "OSCAR", "PAPA", "QUEBEC", "ROMEO", "SIERRA", "TANGO", "UNIFORM", "VICTOR", "WHISKEY", "XRAY", "YANKEE", "ZULU")
_D = "(?:" + "|".join(DIGITS) + ")"

#: Where a slot's values stand in a line of upper-case words one space apart; expressions and the table function share them.
PATTERNS = {
    "letter": r"INFORMATION ([A-Z]+)",
    "time": rf"WEATHER(?: \w+)*? AT ({_D}(?: {_D}){{3}})\b",
    "wind": rf"WIND ({_D}(?: {_D}){{2}}) AT ({_D})\b",
    "thousands": rf"\bVISIBILITY(?: \w+)*? ({_D}(?: {_D})?) THOUSAND\b",
    "range": rf"\bVISIBILITY ({_D}(?: {_D})?)\b",
    "temperature": rf"TEMPERATURE (MINUS )?({_D}(?: {_D})?)\b",
    "dew": rf"DEW POINT (MINUS )?({_D}(?: {_D})?)\b",
    "qnh": rf"ALTIMETER ({_D}(?: {_D}){{3}})\b",
    "runway": rf"RUNWAY ({_D}(?: {_D})?)\b",
    "frequency": rf"({_D}(?: {_D}){{2}}) DECIMAL ({_D} {_D})\b",
    "level": rf"FLIGHT LEVEL ({_D}(?: {_D}){{0,2}})\b",
    "level_hundreds": rf"FLIGHT LEVEL {_D}(?: {_D})? HUNDRED\b",
}


def number(words: Column) -> Column:
    """Digit words as an integer; null if there are none."""
    out = words
    for k, w in enumerate(DIGITS):
        out = F.replace(out, F.lit(w), F.lit(str(k)))
    return F.try_to_number(F.nullif(F.replace(out, F.lit(" "), F.lit("")), F.lit("")), F.lit("9999999999")).cast("int")


def _group(line: Column, pattern: str, k: int = 1) -> Column:
    return number(F.regexp_extract(line, pattern, k))


def _verdict(there: Column, value: Column, good: Column) -> Column:
    return F.when(there, F.when(value.isNotNull() & good, "PASS").otherwise("FAIL"))


def check_slots(text: Column) -> dict[str, Column]:
    """Verdicts by slot: info_letter, obs_time, wind, visibility, temp_dew, qnh, runway, freq, flight_level, and free_text (UNPARSED) where none occurs."""
    t = squeeze(F.regexp_replace(F.upper(text), "[^A-Z ]+", " "))
    letter = F.regexp_extract(t, PATTERNS["letter"], 1)
    value = lambda name, k=1: _group(t, PATTERNS[name], k)
    signed = lambda name: F.when(F.regexp_extract(t, PATTERNS[name], 1) == "MINUS ", -1).otherwise(1) * value(name, 2)
    time, way, speed, thousands, range_ = value("time"), value("wind"), value("wind", 2), value("thousands"), value("range")
    temp, dew, qnh, runway = signed("temperature"), signed("dew"), value("qnh"), value("runway")
    pair = t.rlike(rf"RUNWAY {_D} {_D}\b")
    mhz1000 = value("frequency") * 1000 + value("frequency", 2) * 10
    level = value("level") * F.when(t.rlike(PATTERNS["level_hundreds"]), 100).otherwise(1)
    out = {
        "info_letter": F.when(letter != "", F.when(letter.isin(*ALPHABET), "PASS").otherwise("WARN")),
        "obs_time": _verdict(t.rlike(r"\bWEATHER\b.*\bAT\b"), time, time <= 2359),
        "wind": F.when(t.rlike(r"\bWIND\b"), F.when(way.isNull() | speed.isNull(), "WARN").when(way <= 360, "PASS").otherwise("FAIL")),
        # read digit by digit (hundreds) or as thousands, either may be meant
        "visibility": F.when(
            t.rlike(r"\bVISIBILITY\b"),
            F.when(t.rlike(r"\bVISIBILITY\b.*\bTHOUSAND\b"), F.when((thousands * 100).between(1200, 6500) | (thousands * 1000).between(1200, 6500), "PASS").otherwise("WARN")).when(range_.between(1, 99), "PASS").otherwise("WARN"),
        ),
        "temp_dew": _verdict(t.rlike(r"\bTEMPERATURE\b"), temp, temp.between(-60, 60) & (dew.isNull() | (dew.between(-60, 60) & (dew <= temp)))),
        "qnh": _verdict(t.rlike(r"\bALTIMETER\b"), qnh, qnh.between(2750, 3150)),
        "runway": _verdict(t.rlike(r"\bRUNWAY\b"), runway, runway.between(1, 36) & (pair | (runway <= 9))),
        "freq": F.when(t.rlike(r"\bDECIMAL\b"), F.when(mhz1000.isNull(), "WARN").when(~mhz1000.between(118000, 136975), "FAIL").when(mhz1000 % 25 == 0, "PASS").otherwise("WARN")),
        "flight_level": F.when(level.isNotNull(), F.when(level.between(45, 600), "PASS").otherwise("WARN")),
    }
    return out | {"free_text": F.when(F.coalesce(*out.values()).isNull(), "UNPARSED")}
