"""Closed vocabularies. Fixed values, in rank order where there is one."""

SEVERITIES = ("info", "warning", "error", "critical")
STATUSES = ("pending", "in_review", "approved", "rejected", "escalated")
OPEN_STATUSES = ("pending", "in_review", "escalated")
TERMINAL_STATUSES = ("approved", "rejected")
PRIORITIES = ("critical", "high", "normal", "low")
SLA_HOURS = {"critical": 24, "high": 72, "normal": 168, "low": 336}
ACTIONS = ("auto_approve", "review_queue", "field_verification", "reject_re_scan")
ROLES = ("auditor", "operator", "reviewer", "admin")
CHECK_STATUSES = ("not_applicable", "pass", "warning", "review_required", "fail")
MINUTES_SAVED = 22.0

#: Which status may follow which.
TRANSITIONS = {
    "pending": ("in_review", "approved", "rejected", "escalated"),
    "in_review": ("pending", "approved", "rejected", "escalated"),
    "escalated": ("in_review", "approved", "rejected"),
    "approved": ("in_review",),
    "rejected": ("in_review",),
}
