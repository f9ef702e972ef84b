"""How values are shown: areas, percentages, counts, sizes, relative times, rule codes, initials, colours, axis steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "—"
# Families of rules by prefix; the first that fits counts.
RULE_GROUPS = (
    ("AREA", "Arithmetic consistency"), ("CLASSIFICATION", "Arithmetic consistency"), ("TOTAL", "Arithmetic consistency"), ("ASSESSMENT", "Arithmetic consistency"),
    ("SHARE", "Ownership"), ("OWNER", "Ownership"), ("NO_OWNERS", "Ownership"), ("DUPLICATE_OWNER", "Ownership"), ("ORPHAN", "Ownership"),
    ("MUTATION", "Mutation chain"), ("CORRECTION", "Mutation chain"), ("SUCCESSION", "Ownership succession"), ("ENCUMBRANCE", "Encumbrance"),
    ("IDENTIFIER", "Identifiers"), ("DUPLICATE_KHASRA", "Identifiers"), ("JURISDICTION", "Identifiers"),
    ("LOW", "Extraction quality"), ("UNRESOLVED", "Extraction quality"), ("TABLE", "Extraction quality"), ("GEOMETRY", "Geospatial"),
)
SPANS = (("year", 31_536_000), ("month", 2_592_000), ("day", 86_400), ("hour", 3600), ("minute", 60))


def rule_group(code: Column) -> Column:
    out = None
    for prefix, group in RULE_GROUPS:
        fits = F.startswith(code, F.lit(prefix))
        out = F.when(fits, group) if out is None else out.when(fits, group)
    return out.otherwise("Other")


def rule_title(code: Column) -> Column:
    words = F.replace(F.lower(code), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20))


def indian_count(n: Column) -> Column:
    """Digits grouped as 1,23,456."""
    digits = F.abs(n).cast("string")
    tail = F.right(digits, F.lit(3))
    head = F.substring(digits, F.lit(1), F.length(digits) - 3)
    grouped = F.when(F.length(digits) <= 3, digits).otherwise(F.concat(F.regexp_replace(head, r"(?<=[0-9])(?=(?:[0-9]{2})+$)", ","), F.lit(","), tail))
    return F.when(n.isNull(), NONE).otherwise(F.concat(F.when(n < 0, "-").otherwise(""), grouped))


def area(sq_metre: Column) -> Column:
    """Hectares from one hectare on, square metres below."""
    return F.when(sq_metre.isNull(), NONE).when(sq_metre >= 10_000, F.format_string("%.4f ha", sq_metre / 10_000)).otherwise(F.concat(F.regexp_replace(F.format_string("%.2f", sq_metre), r"\.?0+$", ""), F.lit(" m²")))


def percent(fraction: Column, digits: int = 0) -> Column:
    return F.when(fraction.isNull(), NONE).otherwise(F.format_string(f"%.{digits}f%%", fraction * 100))


def file_size(n: Column) -> Column:
    k = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    unit = F.get(F.array(*(F.lit(u) for u in ("B", "KB", "MB", "GB"))), k)
    value = n / F.pow(F.lit(1024.0), k)
    return F.when(n.isNull() | (n == 0), NONE).when(k == 0, F.format_string("%.0f %s", value, unit)).otherwise(F.format_string("%.1f %s", value, unit))


def relative(then: Column, now: Column) -> Column:
    """``in 3 days``, ``2 hours ago`` by the largest span that fits."""
    s = (F.unix_micros(then.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1e6
    out = None
    for name, size in (*SPANS, ("second", 1)):
        n = F.abs(F.round(s / size)).cast("int")
        many = F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))
        text = F.when(s >= 0, F.concat(F.lit("in "), many)).otherwise(F.concat(many, F.lit(" ago")))
        fits = F.abs(s) >= size if name != "second" else F.lit(True)
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return F.when(then.isNull(), NONE).otherwise(out)


def initials(name: Column) -> Column:
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) == 0, "?").otherwise(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), ""))


def map_colour(mismatch: Column) -> Column:
    return F.when(mismatch.isNull(), "muted").when(mismatch < 5, "good").when(mismatch < 50, "warning").otherwise("critical")


def nice_step(value: Column) -> Column:
    """The next of 1, 2, 5 times a power of ten."""
    ten = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    r = F.round(value / ten, 9)
    return F.when(value <= 0, 1.0).when(r <= 1, ten).when(r <= 2, 2 * ten).when(r <= 5, 5 * ten).otherwise(10 * ten)


def display_key(khasra: Column, survey: Column, khata: Column, village: Column, district: Column) -> Column:
    blank = lambda c: F.nullif(c, F.lit(""))
    plot = F.coalesce(blank(khasra), blank(survey), blank(khata))
    text = F.concat_ws(" · ", F.when(plot.isNotNull(), F.concat(F.lit("Khasra "), plot)), blank(village), blank(district))
    return F.when(text == "", "Unidentified parcel").otherwise(text)
