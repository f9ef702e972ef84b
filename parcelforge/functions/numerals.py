"""Numerals of Indian registers: digits of eleven scripts, look-alikes, decimals, component groups. Built-ins only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The zero of each script, and Latin glyphs that scanners take for digits.
ZEROS = {"Devanagari": "०", "Bengali": "০", "Gurmukhi": "੦", "Gujarati": "૦", "Oriya": "୦", "Tamil": "௦", "Telugu": "౦", "Kannada": "೦", "Malayalam": "൦", "Arabic": "٠", "Extended_Arabic": "۰"}
LOOKALIKES = {"0": "OoQD", "1": "lI|!", "2": "Zz", "5": "Ss", "6": "bG", "7": "T", "8": "B", "9": "gq"}
#: Scripts counted on a page, with the name of their Unicode block property.
SCRIPTS = {s: s for s in ("Latin", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Arabic")}

_FOREIGN = "".join(chr(ord(z) + i) for z in ZEROS.values() for i in range(10))
#: Marks between the numbers of a group: any dash, the minus sign, slashes, bars, colons, the danda and the middle dot; full stops too when there are several.
_MARK = r"\p{Pd}\u2212/\\|:\u0964\u00B7"
NUMBER = "decimal(24,10)"


def ascii_digits(text: Column) -> Column:
    return F.translate(text, _FOREIGN, "0123456789" * len(ZEROS))


_TO_ASCII = str.maketrans(_FOREIGN, "0123456789" * len(ZEROS))


def ascii_digits_of(text: str) -> str:
    return text.translate(_TO_ASCII)


def repaired(text: Column) -> Column:
    """Look-alikes to digits. For fields that must be numeric only."""
    return F.translate(text, "".join(LOOKALIKES.values()), "".join(d * len(g) for d, g in LOOKALIKES.items()))


def numeric_text(text: Column, repair: bool = False) -> Column:
    """ASCII digits without currency marks and digit groups, white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(ascii_digits(text), r"₹|Rs\.?|रू", " "), ",", "")
    out = repaired(out) if repair else out
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def decimal_of(text: Column, repair: bool = False) -> Column:
    """The first number in the text, or null."""
    found = F.regexp_extract(numeric_text(text, repair), r"-?[0-9]+(?:\.[0-9]+)?", 0)
    return F.nullif(found, F.lit("")).try_cast(NUMBER)


def int_of(text: Column, repair: bool = False) -> Column:
    """As ``decimal_of``, truncated."""
    return decimal_of(text, repair).try_cast("bigint")


def components(text: Column, repair: bool = False) -> Column:
    """Numbers of a component group such as 0-80-05; a lone decimal is one number."""
    clean = numeric_text(text, repair)
    single = ~clean.rlike(f"[{_MARK}]") & (F.size(F.split(clean, r"\.")) <= 2)
    one = decimal_of(clean)
    pieces = F.transform(F.filter(F.split(clean, f"[{_MARK}.]+"), lambda p: F.trim(p) != ""), lambda p: F.regexp_replace(p, r"[^0-9.\-]", "").try_cast(NUMBER))
    many = F.filter(pieces, lambda p: p.isNotNull())
    none = F.array().cast(f"array<{NUMBER}>")
    return F.when(clean.isNull() | (clean == ""), none).when(single, F.when(one.isNull(), none).otherwise(F.array(one))).otherwise(many)


def script_counts(text: Column) -> Column:
    """Map script -> characters; scripts that do not occur are left out."""
    counts = [(s, F.regexp_count(text, F.lit(r"[A-Za-z0-9\p{IsLatin}]" if s == "Latin" else rf"\p{{Is{p}}}"))) for s, p in SCRIPTS.items()]
    return F.map_filter(F.create_map(*(x for s, c in counts for x in (F.lit(s), c))), lambda k, v: v > 0)


def dominant_script(text: Column) -> Column:
    entries = F.transform(F.map_entries(script_counts(text)), lambda e: F.struct((-e["value"]).alias("n"), F.array_position(F.array(*(F.lit(s) for s in SCRIPTS)), e["key"]).alias("ord"), e["key"].alias("script")))
    return F.coalesce(F.get(F.array_sort(entries), F.lit(0))["script"], F.lit("Unknown"))


def is_multilingual(text: Column, least: float = 0.10) -> Column:
    counts = script_counts(text)
    total = F.aggregate(F.map_values(counts), F.lit(0), lambda a, b: a + b)
    return F.size(F.filter(F.map_values(counts), lambda v: v >= total * least)) >= 2
