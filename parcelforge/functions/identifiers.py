"""Parcel identifiers and place names: folding and comparison."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numerals import ascii_digits, ascii_digits_of

PLACES = ("village", "tehsil", "district", "state")


# Characters that part an identifier beside white space and the slash, and those that a place name does without
JOINTS, MARKS = "-_\\.,", ".,-_/()[]'"
_SPACE = r"[\s\p{Z}]+"


def parts(text: Column, marks: str, also: str = "") -> Column:
    """The text cut at white space and at any of ``marks``, without empty parts."""
    spaced = F.translate(text, marks + also, " " * len(marks + also))
    return F.filter(F.split(spaced, _SPACE), lambda x: x != "")


def normalized(raw: Column) -> Column:
    """One separator, no leading zeros, lower case; blank is empty. Apply ``names.nfkc`` before for decomposed text."""
    own = parts(F.lower(ascii_digits(F.coalesce(raw, F.lit("")))), JOINTS, "/")
    return F.array_join(F.transform(own, lambda x: F.regexp_replace(x, r"(?<![\p{L}\p{M}\p{N}_])0+(?=[0-9])", "")), "/")


def place(raw: Column) -> Column:
    return F.array_join(parts(F.lower(F.coalesce(raw, F.lit(""))), MARKS), " ")


def compared(left: Column, right: Column, numeric: bool = True) -> Column:
    """equal, related (one is a part of the other), different, or null when either is not stated."""
    a, b = (normalized(left), normalized(right)) if numeric else (place(left), place(right))
    related = F.startswith(a, F.concat(b, F.lit("/"))) | F.startswith(b, F.concat(a, F.lit("/"))) if numeric else F.lit(False)
    return F.when((a == "") | (b == ""), None).when(a == b, "equal").when(related, "related").otherwise("different")


# The same in Python, for engines that run over Arrow batches
_ZEROS, _SPACES = re.compile(r"0+(?=[0-9])"), re.compile("[ \t\n\x0b\f\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_PARTED, _BARE = str.maketrans(dict.fromkeys(JOINTS + "/", " ")), str.maketrans(dict.fromkeys(MARKS, " "))


@lru_cache(1 << 16)
def normalized_of(raw: str | None) -> str:
    """``normalized``."""
    joined = lambda m, x: m.start() and (x[m.start() - 1] == "_" or unicodedata.category(x[m.start() - 1])[0] in "LMN")
    own = [x for x in _SPACES.split(ascii_digits_of(raw or "").lower().translate(_PARTED)) if x]
    return "/".join(_ZEROS.sub(lambda m, x=x: m[0] if joined(m, x) else "", x) for x in own)


@lru_cache(1 << 16)
def place_of(raw: str | None) -> str:
    """``place``."""
    return " ".join(x for x in _SPACES.split((raw or "").lower().translate(_BARE)) if x)


def compared_of(left: str | None, right: str | None, numeric: bool = True) -> str | None:
    """``compared``."""
    of = normalized_of if numeric else place_of
    a, b = of(left), of(right)
    if not a or not b:
        return None
    return "equal" if a == b else "related" if numeric and (a.startswith(b + "/") or b.startswith(a + "/")) else "different"


def parcel_key(village: Column, khata: Column, survey: Column, sub_survey: Column, khasra: Column) -> Column:
    """village-or-?/khata-or-'-'/survey-or-first-khasra-or-'-', and the sub-survey if there is one."""
    blank = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    first = F.get(khasra, F.lit(0))
    return F.concat_ws("/", blank(village, F.lit("?")), blank(khata, F.lit("-")), blank(survey, blank(first, F.lit("-"))), F.nullif(sub_survey, F.lit("")))
