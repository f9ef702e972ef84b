"""Triage: score, band, reasons and service-level clock, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..enums import SLA_HOURS

# Weights of the components, and of severities and actions.
WEIGHTS = {"mismatch": 34.0, "severity": 30.0, "confidence": 22.0, "volume": 8.0, "action": 6.0}
SEVERITY_WEIGHT = {"critical": 1.0, "error": 0.7, "warning": 0.35, "info": 0.1}
ACTION_WEIGHT = {"reject_re_scan": 1.0, "field_verification": 0.8, "review_queue": 0.5, "auto_approve": 0.0}
BANDS = ((55.0, "critical"), (30.0, "high"), (12.0, "normal"))


def _weight(column: Column, table: dict[str, float], default: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(default)


def components(mismatch="mismatch", severity="severity", confidence="confidence", issues="issue_count", action="action") -> dict[str, Column]:
    """A missing mismatch or severity weighs nothing, a missing confidence counts as one half, a missing action as 0.3."""
    m, c, n = F.col(mismatch), F.col(confidence), F.col(issues)
    sure = F.when(c.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(c, F.lit(1.0))))
    return {
        "mismatch": F.when(m.isNull(), 0.0).otherwise(F.least(m, F.lit(100.0)) / 100.0 * WEIGHTS["mismatch"]),
        "severity": _weight(F.col(severity), SEVERITY_WEIGHT, 0.0) * WEIGHTS["severity"],
        "confidence": (1.0 - sure) * WEIGHTS["confidence"],
        "volume": F.least(n, F.lit(5)) / 5.0 * WEIGHTS["volume"],
        "action": _weight(F.col(action), ACTION_WEIGHT, 0.3) * WEIGHTS["action"],
    }


def score(**columns: str) -> Column:
    c = components(**columns)
    return F.round(c["mismatch"] + c["severity"] + c["confidence"] + c["volume"] + c["action"], 2)


def band(score_column: Column) -> Column:
    out = None
    for least, name in BANDS:
        out = F.when(score_column >= least, name) if out is None else out.when(score_column >= least, name)
    return out.otherwise("low")


def reasons(mismatch="mismatch", severity="severity", confidence="confidence", issues="issue_count", action="action") -> Column:
    """At most three drivers as text, largest component first (ties in this order)."""
    c = components(mismatch, severity, confidence, issues, action)
    m, s, n, a = F.col(mismatch), F.col(severity), F.col(issues), F.col(action)
    sure = F.when(F.col(confidence).isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.col(confidence), F.lit(1.0))))
    percent = lambda x: F.format_string("%.0f", x)
    texts = (
        (c["mismatch"], F.when(m >= 50, F.concat(F.lit("Map and text areas differ by "), percent(m), F.lit("%"))).when(m >= 15, F.concat(F.lit("Map and text areas differ moderately, by "), percent(m), F.lit("%")))),
        (c["severity"], F.when(s.isin("critical", "error"), F.concat(F.lit("A rule reported a finding of severity "), s))),
        (c["confidence"], F.when(sure < 0.6, F.concat(F.lit("Extraction confidence is only "), percent(sure * 100), F.lit("%")))),
        (c["volume"], F.when(n >= 3, F.concat(n.cast("string"), F.lit(" findings on the record")))),
        (c["action"], F.when(a == "reject_re_scan", "A new scan is recommended").when(a == "field_verification", "A visit to the field is recommended")),
    )
    entries = F.array(*(F.struct((-w).alias("w"), F.lit(i).alias("i"), t.alias("text")) for i, (w, t) in enumerate(texts)))
    top = F.slice(F.array_sort(F.filter(entries, lambda x: x["text"].isNotNull())), 1, 3)
    out = F.transform(top, lambda x: x["text"])
    return F.when(F.size(out) == 0, F.array(F.lit("No findings"))).otherwise(out)


def sla_due(priority: Column, since: Column, hours: dict[str, int] | None = None) -> Column:
    out = None
    for name, h in (hours or SLA_HOURS).items():
        out = F.when(priority == name, h) if out is None else out.when(priority == name, h)
    return since + F.make_interval(hours=out.otherwise(168))
