"""The bundle engine itself: one case at a time over Arrow batches, in Python.

A case's names, pairs of names and pairs of parcels are folded and scored when a check first asks for them and then kept, as far as a
bounded cache reaches; nothing is worked out twice, and a report's columns that nobody asked for are not worked out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from datetime import date
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property, lru_cache
from itertools import starmap
from typing import NamedTuple

import pyarrow as pa

from ..enums import CHECK_STATUSES
from ..functions import identifiers, names, shares
from ..functions.names import EXACT_ENOUGH, THRESHOLD

# Weights of findings, multipliers of statuses, bands, and what kinds of document can show.
RISK_POINTS = {
    "SUCCESSION_DOCUMENTS_CONTRADICT": 55.0, "SUCCESSION_EXCLUSIVE_TRANSFER_UNSUPPORTED": 55.0, "SUCCESSION_PARCEL_MISMATCH": 50.0, "SUCCESSION_UNEXPLAINED_TRANSITION": 50.0,
    "SUCCESSION_EVENT_SEQUENCE_INVALID": 45.0, "SUCCESSION_EVIDENCE_MISSING": 45.0, "SUCCESSION_OWNER_IDENTITY_MISMATCH": 40.0, "SUCCESSION_MUTATION_PREDECESSOR_MISMATCH": 35.0,
    "SUCCESSION_MUTATION_PARCEL_MISMATCH": 35.0, "SUCCESSION_AREA_MISMATCH": 30.0, "SUCCESSION_SHARE_SUM_INCONSISTENT": 25.0, "SUCCESSION_MUTATION_MISSING": 20.0,
    "SUCCESSION_DEATH_RECORD_MISSING": 18.0, "SUCCESSION_RECORD_NOT_UPDATED_AFTER_DEATH": 15.0, "SUCCESSION_HEIRS_NOT_IDENTIFIED": 15.0, "SUCCESSION_DOCUMENT_UNREADABLE": 12.0, "SUCCESSION_NAME_MATCH_APPROXIMATE": 6.0,
}
MULTIPLIER = {"fail": 1.0, "review_required": 0.85, "warning": 0.45, "pass": 0.0, "not_applicable": 0.0}
BANDS = ((70.0, "critical"), (40.0, "high"), (15.0, "medium"))
OUTCOMES = {"fail": "inconsistent", "review_required": "review_required", "warning": "incomplete", "pass": "validated", "not_applicable": "validated"}
ACTIONS = {"validated": "accept_record", "incomplete": "obtain_additional_documents", "review_required": "human_review", "inconsistent": "refer_to_revenue_authority"}
EXCLUSIVE = ("will", "relinquishment_deed", "partition_deed", "family_settlement", "court_order", "succession_certificate")
TRANSITION = ("mutation_order", "mutation_application", *EXCLUSIVE)
INHERITING = ("son_of", "daughter_of", "wife_of", "widow_of", "heir_of")
EVENT_TYPES = {"will": "will", "relinquishment_deed": "relinquishment", "partition_deed": "partition", "family_settlement": "family_settlement", "court_order": "court_order", "succession_certificate": "court_order"}
IDENTIFIERS = ("khasra_number", "khata_number", "survey_number", "village", "tehsil", "district", "state")
#: What a check says when its status is not clear. Statuses that a rule does not give are left out.
MESSAGES = {
    "OWNER_IDENTITY_MATCH": {"fail": "A deceased person is not among the previously recorded owners.", "review_required": "No previous owners are recorded to compare the deceased with."},
    "TRANSITION_AFTER_DEATH": {"fail": "Ownership moved before the recorded death.", "review_required": "The order of death and transfer cannot be told, as dates are missing.", "warning": "A deceased owner is still recorded."},
    "PARCEL_MATCH": {"fail": "The previous and the current record describe different parcels.", "review_required": "The previous and the current record share no parcel identifier.", "warning": "The current record describes a part of the previous parcel."},
    "MUTATION_PREDECESSOR_MATCH": {"fail": "A mutation moves the land from someone who is no recorded owner.", "warning": "A mutation names no previous owner."},
    "MUTATION_PARCEL_MATCH": {"fail": "A mutation concerns another parcel.", "review_required": "A mutation shares no parcel identifier with the record.", "warning": "A mutation names no parcel, or a part of it."},
    "SHARE_SUM_CONSISTENCY": {"fail": "Recorded shares exceed the whole.", "warning": "Recorded shares do not add up to the whole, or are not stated."},
    "AREA_CONSISTENCY": {"fail": "The area grew with the transfer.", "warning": "The area shrank with the transfer."},
    "HEIRS_IDENTIFIED": {"warning": "No heir of the deceased is identified."},
    "SUCCESSION_EVIDENCE": {"review_required": "Nothing supports the transfer.", "warning": "The mutation behind the transfer is not sanctioned."},
    "EXCLUSIVE_TRANSFER_EVIDENCE": {"review_required": "Some heirs received nothing, and no deed explains it.", "warning": "A deed explains why some, but not all, of the left-out heirs received nothing."},
    "TRANSITION_CHAIN_COMPLETE": {"review_required": "No document explains a change between two records."},
    "DEATH_RECORD_PRESENT": {"warning": "An inheritance is claimed without a death record."},
    "MUTATION_RECORD_PRESENT": {"warning": "The transfer has no mutation record."},
    "DOCUMENT_CONSISTENCY": {"fail": "Documents contradict each other."},
    "DOCUMENT_LEGIBILITY": {"warning": "A document is not fully legible."},
    "NAME_MATCH_QUALITY": {"warning": "Names were matched approximately."},
}

_EPOCH = date(1970, 1, 1).toordinal()
_FIRST, _LAST = date(1, 1, 1).toordinal() - _EPOCH, date(9999, 12, 31).toordinal() - _EPOCH


class Owner(NamedTuple):
    name: str | None
    f: str
    relation_type: str | None
    relation_name: str | None
    rf: str
    share: tuple | None


class Parcel(NamedTuple):
    khasra_number: str | None
    khata_number: str | None
    survey_number: str | None
    village: str | None
    tehsil: str | None
    district: str | None
    state: str | None
    area: float | None


class Snapshot(NamedTuple):
    """Dates are days since 1970."""

    label: str | None
    document_type: str | None
    as_of: int | None
    inferred: bool
    parcel: Parcel
    owners: list[Owner]
    is_legible: bool


class Death(NamedTuple):
    person: str | None
    f: str
    date_of_death: int | None
    is_legible: bool


class Heir(NamedTuple):
    name: str | None
    f: str
    relation: str
    share: tuple | None


class Mutation(NamedTuple):
    number: str | None
    mutation_type: str | None
    status: str | None
    effective: int | None
    parcel: Parcel
    area: float | None
    previous_owners: list[Owner]
    new_owners: list[Owner]
    is_legible: bool


class Document(NamedTuple):
    document_type: str | None
    label: str | None
    issued_on: int | None
    executants: list[Owner]
    beneficiaries: list[Owner]
    is_legible: bool


class Check(NamedTuple):
    rule: str
    rule_code: str
    status: str
    match_score: float | None = None


# Arrow columns as Python values. Fields of a null struct are null, a null array is an empty one


def _values(a: pa.Array) -> list:
    if a.null_count == len(a):
        return [None] * len(a)
    if pa.types.is_date(a.type):
        a = a.cast(pa.int32())
    if pa.types.is_string(a.type) or pa.types.is_large_string(a.type) or not a.null_count:
        return a.to_numpy(zero_copy_only=False).tolist()
    return a.to_pylist()


def _flags(a: pa.Array, default: bool) -> list[bool]:
    return [default if v is None else v for v in _values(a)]


def _fields(a: pa.StructArray) -> dict[str, pa.Array]:
    return {f.name: x for f, x in zip(a.type, a.flatten(), strict=True)}


def _lists(a: pa.ListArray, made: Callable[[pa.StructArray], list]) -> list[list]:
    """Each row's items, made from the items of all rows at once."""
    if not len(a):  # its offsets may be anything
        return []
    ends = a.offsets.to_numpy()
    items = made(a.values.slice(ends[0], ends[-1] - ends[0]))
    at = (ends - ends[0]).tolist()
    out = [items[i:j] for i, j in zip(at, at[1:], strict=False)]
    if a.null_count:
        out = [x if v else [] for x, v in zip(out, a.is_valid().to_pylist(), strict=True)]
    return out


def _shares(a: pa.StructArray) -> list[tuple | None]:
    if a.null_count == len(a):
        return [None] * len(a)
    pairs = list(zip(*map(_values, a.flatten()), strict=True))
    return [p if v else None for p, v in zip(pairs, a.is_valid().to_pylist(), strict=True)] if a.null_count else pairs


def _folds(raw: list) -> list[str]:
    fold = names.folded_of
    return [fold(x) for x in raw]


def _owners(a: pa.StructArray) -> list[Owner]:
    f = _fields(a)
    own, relatives = _values(f["name"]), _values(f["relation_name"])
    return list(map(Owner, own, _folds(own), _values(f["relation_type"]), relatives, _folds(relatives), _shares(f["share"])))


def _parcels(a: pa.StructArray) -> list[Parcel]:
    return list(starmap(Parcel, zip(*map(_values, a.flatten()), strict=True)))


def _snapshots(a: pa.StructArray) -> list[Snapshot]:
    f = _fields(a)
    return list(map(Snapshot, _values(f["label"]), _values(f["document_type"]), _values(f["as_of"]), _flags(f["as_of_inferred"], False), _parcels(f["parcel"]), _lists(f["owners"], _owners), _flags(f["is_legible"], True)))


def _deaths(a: pa.StructArray) -> list[Death]:
    f = _fields(a)
    who = _values(f["person"])
    return list(map(Death, who, _folds(who), _values(f["date_of_death"]), _flags(f["is_legible"], True)))


def _heirs(a: pa.StructArray) -> list[Heir]:
    f = _fields(a)
    who = _values(f["name"])
    return list(map(Heir, who, _folds(who), [x if x is not None else "unknown" for x in _values(f["relation"])], _shares(f["share"])))


def _mutations(a: pa.StructArray) -> list[Mutation]:
    f = _fields(a)
    effective = [e if o is None else o for o, e in zip(_values(f["order_date"]), _values(f["entry_date"]), strict=True)]
    return list(map(Mutation, _values(f["number"]), _values(f["mutation_type"]), _values(f["status"]), effective, _parcels(f["parcel"]), _values(f["area"]), _lists(f["previous_owners"], _owners), _lists(f["new_owners"], _owners), _flags(f["is_legible"], True)))


def _documents(a: pa.StructArray) -> list[Document]:
    f = _fields(a)
    return list(map(Document, _values(f["document_type"]), _values(f["label"]), _values(f["issued_on"]), _lists(f["executants"], _owners), _lists(f["beneficiaries"], _owners), _flags(f["is_legible"], True)))


def cases(batch: pa.RecordBatch) -> Iterator[Case]:
    c = lambda n, made: _lists(batch.column(batch.schema.get_field_index(n)), made)
    return map(Case, c("snapshots", _snapshots), c("deaths", _deaths), c("heirs", _heirs), c("mutations", _mutations), c("documents", _documents))


# Scores and dates


def _score(a: str, b: str) -> float | None:
    """Of two folded names that match, else null."""
    if a == b:
        return 1.0 if a else None
    s = names.similarity_of(a, b)
    return s if s >= THRESHOLD else None


def _among(a: str, others: Sequence[str]) -> bool:
    if a and a in others:
        return True
    for b in others:
        if _score(a, b) is not None:
            return True
    return False


def _meet(left: Sequence[str], right: Sequence[str]) -> bool:
    for a in left:
        if _among(a, right):
            return True
    return False


def _best(name: str, owners: list[Owner]) -> tuple[int, float] | None:
    """Index and score of the first best-matching owner."""
    top = None
    for i, o in enumerate(owners):
        s = _score(name, o.f)
        if s is not None and (top is None or s > top[1]):
            top = (i, s)
    return top


def _fold(owners) -> list[str]:
    return [o.f for o in owners]


def compared(before: list[Owner], after: list[Owner]) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """Owners of ``after`` without a partner, of ``before`` without one, and pairs; each match consumes its partner."""
    left, gone, kept = list(range(len(after))), [], []
    for i, o in enumerate(before):
        top = _best(o.f, [after[j] for j in left])
        if top is None:
            gone.append(i)
        else:
            kept.append((i, left.pop(top[0])))
    return left, gone, kept


def _key(name: str | None) -> str:
    return (name or "").strip(" ").lower()


@lru_cache(1 << 12)
def _window_end(as_of: int | None, inferred: bool) -> int | None:
    """An inferred date stands for its revenue year, which ends on 31 March of the next."""
    return date(date.fromordinal(as_of + _EPOCH).year + 1, 3, 31).toordinal() - _EPOCH if inferred and as_of is not None else as_of


@lru_cache(1 << 12)
def _date_text(day: int | None) -> str | None:
    return None if day is None else date.fromordinal(day + _EPOCH).isoformat()


@lru_cache(1 << 12)
def rounded(x: float) -> float:
    """To two places, halves away from zero, of the shortest decimal that stands for the number."""
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def double_text(x: float | None) -> str | None:
    """As a cast to string writes it."""
    if x is None or math.isnan(x) or math.isinf(x):
        return None if x is None else "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return f"{Decimal(repr(x)):f}" if "e" in repr(x) else repr(x)
    _, digits, _ = t = Decimal(repr(x)).normalize().as_tuple()
    rest = "".join(map(str, digits[1:])) or "0"
    return f"{'-' if x < 0 else ''}{digits[0]}.{rest}E{len(digits) - 1 + t.exponent}"


def parcel_status(left: Parcel, right: Parcel) -> str:
    """fail for a conflict, warning for a part of the same plot, pass when all shared identifiers agree, review when none is shared."""
    return _status(left[: len(IDENTIFIERS)], right[: len(IDENTIFIERS)])


@lru_cache(1 << 14)
def _status(left: tuple, right: tuple) -> str:
    verdicts = {identifiers.compared_of(a, b, f not in identifiers.PLACES) for f, a, b in zip(IDENTIFIERS, left, right, strict=True)} - {None}
    return "review_required" if not verdicts else "fail" if "different" in verdicts else "warning" if "related" in verdicts else "pass"


def _has_identifier(parcel: Parcel) -> bool:
    return any(parcel[: len(IDENTIFIERS)])


class Case:
    """What the checks read, each worked out once."""

    tolerance = (1.0, 0.005)

    def __init__(self, snapshots: list[Snapshot], deaths: list[Death], heirs: list[Heir], mutations: list[Mutation], documents: list[Document]):
        order = lambda i: (snapshots[i].document_type == "updated_jamabandi", snapshots[i].as_of is None, snapshots[i].as_of or 0)
        self.snapshots = snapshots if len(snapshots) < 2 else [snapshots[i] for i in sorted(range(len(snapshots)), key=order)]
        self.deaths, self.heirs_given, self.mutations, self.documents = deaths, heirs, mutations, documents
        self.previous = self.snapshots[0] if snapshots else None
        self.current = self.snapshots[-1] if len(snapshots) > 1 else None
        self.before = self.previous.owners if self.previous else []
        self.after = self.current.owners if self.current else []

    @cached_property
    def diff(self) -> tuple[list[int], list[int], list[tuple[int, int]]]:
        return compared(self.before, self.after)

    @cached_property
    def changed(self) -> bool:
        if self.current is None:
            return any(m.new_owners for m in self.mutations)
        left, gone, kept = self.diff
        part = lambda o: o.share[0] / o.share[1] if o.share and None not in o.share and o.share[1] else -1.0
        return bool(left or gone) or any(part(self.before[i]) != part(self.after[j]) for i, j in kept)

    @cached_property
    def matches(self) -> list[tuple[int, float] | None]:
        """Of each death, its person among the previous owners."""
        return [_best(d.f, self.before) for d in self.deaths]

    @cached_property
    def recorded(self) -> list[Death]:
        """Deaths of previously recorded owners."""
        return [d for d, m in zip(self.deaths, self.matches, strict=True) if m]

    @cached_property
    def heirs(self) -> list[Heir]:
        """Heirs given, heirs by stated relation to a deceased, and executants of connected deeds; one a name, the first that states it fills a gap."""
        dead, after, before = _fold(self.deaths), _fold(self.after), _fold(self.before)
        related = lambda owners: [Heir(o.name, o.f, o.relation_type, None) for o in owners if o.relation_type in INHERITING and o.rf != "" and _among(o.rf, dead)]
        found = list(self.heirs_given)
        for s in self.snapshots:
            found += related(s.owners)
        for m in self.mutations:
            found += related(m.new_owners)
        known = dead + before + after
        for d in self.documents:
            if d.document_type in EXCLUSIVE and _meet(_fold(d.executants) + _fold(d.beneficiaries), known):
                found += [Heir(e.name, e.f, "unknown" if e.relation_type is None else e.relation_type, None) for e in d.executants]
        by: dict[str, Heir] = {}
        for h in found:
            key = _key(h.name)
            if not key:
                continue
            had = by.get(key)
            if had is None:
                by[key] = h
            elif (had.relation == "unknown" and h.relation != "unknown") or (had.share is None and h.share is not None):
                by[key] = Heir(had.name, had.f, h.relation if had.relation == "unknown" else had.relation, h.share if had.share is None else had.share)
        return list(by.values())

    @cached_property
    def takers(self) -> list[str]:
        return _fold(self.after) if self.after else [o.f for m in self.mutations for o in m.new_owners]

    @cached_property
    def left_out(self) -> list[str]:
        return [h.f for h in self.heirs if not _among(h.f, self.takers)]

    @cached_property
    def predecessors(self) -> list[list[tuple[int, float] | None]]:
        """Of each mutation's previous owners, the one of the record."""
        return [[_best(o.f, self.before) for o in m.previous_owners] for m in self.mutations]

    @cached_property
    def event_type(self) -> str:
        return "insufficient_documents" if not self.snapshots and not self.mutations else "no_transition_detected" if not self.changed else "owner_death_succession" if self.recorded else "ownership_transition"


Rule = Callable[[Case], list[Check]]
REGISTRY: list[tuple[str, str, Rule]] = []


def rule(name: str, code: str) -> Callable[[Callable], Rule]:
    """Registers a rule that gets the case and a maker of its checks: ``check(status, score=None, code=code)``."""

    def add(f: Callable) -> Rule:
        plain: dict[tuple[str, str], Check] = {}

        def check(status: str, score: float | None = None, code: str = code) -> Check:
            if score is not None:
                return Check(name, f"SUCCESSION_{code}", status, score)
            key = (status, code)
            if key not in plain:
                plain[key] = Check(name, f"SUCCESSION_{code}", status, None)
            return plain[key]

        def build(k: Case) -> list[Check]:
            out = f(k, check)
            return out if type(out) is list else [out]

        REGISTRY.append((name, code, build))
        return build

    return add


@rule("OWNER_IDENTITY_MATCH", "OWNER_IDENTITY_MISMATCH")
def _s1(k: Case, check):
    if not k.deaths or not k.before:
        return check("review_required" if k.deaths else "not_applicable")
    return [check("pass", m[1]) if m else check("fail") for m in k.matches]


@rule("TRANSITION_AFTER_DEATH", "EVENT_SEQUENCE_INVALID")
def _s2(k: Case, check):
    if not k.recorded:
        return check("not_applicable")
    if not k.changed:
        holders = _fold(k.after or k.before)
        return check("warning", code="RECORD_NOT_UPDATED_AFTER_DEATH") if any(_among(d.f, holders) for d in k.recorded) else check("not_applicable")
    moves = [m.effective for m in k.mutations if m.effective is not None]
    if k.current and not k.current.inferred and k.current.as_of is not None:
        moves.append(k.current.as_of)
    died = [d.date_of_death for d in k.recorded if d.date_of_death is not None]
    return check("review_required" if not died or not moves else "fail" if min(moves) < max(died) else "pass")


@rule("PARCEL_MATCH", "PARCEL_MISMATCH")
def _s3(k: Case, check):
    return check(parcel_status(k.previous.parcel, k.current.parcel) if k.current else "not_applicable")


@rule("MUTATION_PREDECESSOR_MATCH", "MUTATION_PREDECESSOR_MISMATCH")
def _s4(k: Case, check):
    if not k.mutations or not k.before:
        return check("not_applicable")
    return [c for own in k.predecessors for c in ([check("pass", x[1]) if x else check("fail") for x in own] if own else [check("warning")])]


@rule("MUTATION_PARCEL_MATCH", "MUTATION_PARCEL_MISMATCH")
def _s5(k: Case, check):
    if not k.mutations or k.previous is None or not _has_identifier(k.previous.parcel):
        return check("not_applicable")
    return [check(parcel_status(k.previous.parcel, m.parcel) if _has_identifier(m.parcel) else "warning") for m in k.mutations]


def _share_status(owners: list[Owner]) -> str:
    stated = [o.share for o in owners if o.share is not None]
    if not stated:
        return "warning" if len(owners) > 1 else "pass"
    if any(None in s for s in stated):
        return "warning"
    n, d = shares.total_of(stated)
    if n == d == 0:
        return "warning"
    return "pass" if n == d and len(stated) == len(owners) else "fail" if n > d else "warning"


@rule("SHARE_SUM_CONSISTENCY", "SHARE_SUM_INCONSISTENT")
def _s6_shares(k: Case, check):
    held = [o for o in (k.after, *(m.new_owners for m in k.mutations)) if o]
    return [check(_share_status(o)) for o in held] if held else check("not_applicable")


@rule("AREA_CONSISTENCY", "AREA_MISMATCH")
def _s6_area(k: Case, check):
    base = k.previous.parcel.area if k.previous else None
    others = [k.current.parcel.area if k.current else None, *(m.area if m.parcel.area is None else m.parcel.area for m in k.mutations)]
    others = [a for a in others if a is not None]
    if base is None or not others:
        return check("not_applicable")
    absolute, relative = k.tolerance

    def of(a: float) -> str:
        off = abs(a - base)
        if off <= absolute or off / max(abs(a), abs(base), 1.0) <= relative:
            return "pass"
        return "fail" if a > base or (math.isnan(a) and not math.isnan(base)) else "warning"

    return [check(of(a)) for a in others]


@rule("HEIRS_IDENTIFIED", "HEIRS_NOT_IDENTIFIED")
def _s7(k: Case, check):
    return check("not_applicable" if not k.deaths else "pass" if k.heirs else "warning")


@rule("SUCCESSION_EVIDENCE", "EVIDENCE_MISSING")
def _s8(k: Case, check):
    if not k.changed:
        return check("not_applicable")
    supported = any(m.status == "sanctioned" for m in k.mutations) or any(d.document_type in TRANSITION for d in k.documents)
    return check("pass" if supported else "warning" if k.mutations else "review_required")


@rule("EXCLUSIVE_TRANSFER_EVIDENCE", "EXCLUSIVE_TRANSFER_UNSUPPORTED")
def _s9(k: Case, check):
    if not k.changed or not k.recorded or len(k.heirs) <= 1 or not k.takers:
        return check("not_applicable")
    if not k.left_out:
        return check("pass")
    parties = [_fold(d.beneficiaries) + _fold(d.executants) for d in k.documents if d.document_type in EXCLUSIVE]
    deeds = [p for p in parties if _meet(p, k.takers) or _meet(p, k.left_out)]
    if not deeds:
        return check("review_required")
    return check("pass" if all(any(_among(h, p) for p in deeds) for h in k.left_out) else "warning")


def _broken(k: Case, a: Snapshot, b: Snapshot) -> bool:
    left, lost, _ = k.diff if (a is k.previous and b is k.current) else compared(a.owners, b.owners)
    if not left and not lost:
        return False
    gone, come = [a.owners[i].f for i in lost], [b.owners[j].f for j in left]
    until = _window_end(b.as_of, b.inferred)
    for m in k.mutations:
        at = m.effective
        if at is None or ((a.as_of is None or at >= a.as_of) and (until is None or at <= until)):
            if _meet(_fold(m.new_owners), come) or (not come and _meet(_fold(m.previous_owners), gone)):
                return False
    if not _meet(_fold(k.deaths), gone):
        return True
    return bool(come) and not any(d.document_type in TRANSITION and _meet(_fold(d.beneficiaries), come) for d in k.documents)


@rule("TRANSITION_CHAIN_COMPLETE", "UNEXPLAINED_TRANSITION")
def _s10(k: Case, check):
    if len(k.snapshots) < 2:
        return check("not_applicable")
    return check("review_required" if any(_broken(k, a, b) for a, b in zip(k.snapshots, k.snapshots[1:], strict=False)) else "pass")


@rule("DEATH_RECORD_PRESENT", "DEATH_RECORD_MISSING")
def _s11(k: Case, check):
    claimed = k.heirs_given or any(m.mutation_type in ("inheritance", "will") for m in k.mutations)
    return check("pass" if k.deaths else "warning" if claimed else "not_applicable")


@rule("MUTATION_RECORD_PRESENT", "MUTATION_MISSING")
def _s12(k: Case, check):
    return check("pass" if k.mutations else "warning" if k.changed else "not_applicable")


@rule("DOCUMENT_CONSISTENCY", "DOCUMENTS_CONTRADICT")
def _s13(k: Case, check):
    dated = [d for d in k.deaths if d.date_of_death is not None]
    n = sum(x.date_of_death != y.date_of_death and _score(x.f, y.f) is not None for i, x in enumerate(dated) for y in dated[i + 1 :])
    if k.after:
        holders = _fold(k.after)
        strangers = lambda owners: bool(owners) and not _meet(_fold(owners), holders)
        n += sum(strangers(m.new_owners) for m in k.mutations) + sum(d.document_type in EXCLUSIVE and strangers(d.beneficiaries) for d in k.documents)
    return [check("fail")] * n if n else check("pass")


@rule("DOCUMENT_LEGIBILITY", "DOCUMENT_UNREADABLE")
def _s14(k: Case, check):
    for c in (k.snapshots, k.deaths, k.mutations, k.documents):
        for x in c:
            if not x.is_legible:
                return check("warning")
    return check("pass")


@rule("NAME_MATCH_QUALITY", "NAME_MATCH_APPROXIMATE")
def _s15(k: Case, check):
    used = [*k.matches, *((x for own in k.predecessors for x in own) if k.before else ())]
    loose = [x[1] for x in used if x and x[1] < EXACT_ENOUGH]
    return check("warning", min(loose)) if loose else check("pass")


def _identified(parcel: Parcel | None) -> str:
    """The identifiers that a parcel states, as text."""
    return ", ".join(f"{f.removesuffix('_number')} {v}" for f, v in zip(IDENTIFIERS, parcel or (), strict=False) if v)


def evidence(k: Case) -> dict[str, tuple[list, str | None, str | None]]:
    """Per rule: the labels of the documents it reads, what they say, and what that is held against."""
    shots = [s.label or "" for s in k.snapshots]
    first, last = shots[:1], shots[-1:] if len(shots) > 1 else []
    dead = [f"death of {d.person or ''}" for d in k.deaths]
    moves = [f"mutation {m.number or ''}" for m in k.mutations]
    deeds = [d.document_type if d.label is None else d.label for d in k.documents]
    names_of = lambda owners: ", ".join(o.name or "" for o in owners)
    before, after, heirs = names_of(k.before), names_of(k.after), ", ".join(h.name for h in k.heirs)
    died = ", ".join(d.person or "" for d in k.deaths)
    share = lambda o: f"{o.share[0]}/{o.share[1]}" if o.share and None not in o.share else "?"
    from_, to = [o for m in k.mutations for o in m.previous_owners], [o for m in k.mutations for o in m.new_owners]
    all_ = shots + dead + moves + deeds
    area = lambda s: double_text(s.parcel.area) if s else None
    plot = lambda s: _identified(s.parcel if s else None)
    return {
        "OWNER_IDENTITY_MATCH": (dead + first, died, before),
        "TRANSITION_AFTER_DEATH": (dead + moves + last, _date_text(min((m.effective for m in k.mutations if m.effective is not None), default=None)), _date_text(max((d.date_of_death for d in k.deaths if d.date_of_death is not None), default=None))),
        "PARCEL_MATCH": (first + last, plot(k.current), plot(k.previous)),
        "MUTATION_PREDECESSOR_MATCH": (moves + first, names_of(from_), before),
        "MUTATION_PARCEL_MATCH": (moves + first, "; ".join(_identified(m.parcel) for m in k.mutations), plot(k.previous)),
        "SHARE_SUM_CONSISTENCY": (last + moves, ", ".join(map(share, k.after or to)), "1"),
        "AREA_CONSISTENCY": (first + last + moves, area(k.current), area(k.previous)),
        "HEIRS_IDENTIFIED": (dead, heirs, died),
        "SUCCESSION_EVIDENCE": (moves + deeds, ", ".join("unknown" if m.status is None else m.status for m in k.mutations), "sanctioned"),
        "EXCLUSIVE_TRANSFER_EVIDENCE": (last + moves + deeds, after if k.after else names_of(to), heirs),
        "TRANSITION_CHAIN_COMPLETE": (shots + moves + deeds, after, before),
        "DEATH_RECORD_PRESENT": (dead, str(len(k.deaths)), "1"),
        "MUTATION_RECORD_PRESENT": (moves, str(len(k.mutations)), "1"),
        "DOCUMENT_CONSISTENCY": (all_, names_of(to), after),
        "DOCUMENT_LEGIBILITY": (all_, None, None),
        "NAME_MATCH_QUALITY": (dead + moves, None, str(EXACT_ENOUGH)),
    }


def timeline(k: Case) -> list[tuple]:
    """Events of all sources with their dates, ordered by anchor (dateless ones last), numbered from 0."""
    out = []
    for i, s in enumerate(k.snapshots):
        end = _window_end(s.as_of, s.inferred)
        out.append(("record_snapshot", s.as_of, _FIRST + i if end is None else end, s.as_of is not None and not s.inferred, None))
    out += [("death", d.date_of_death, d.date_of_death, d.date_of_death is not None, d.person) for d in k.deaths]
    if k.deaths and k.heirs:
        out.append(("succession_claim", None, next((d.date_of_death for d in k.deaths if d.date_of_death is not None), None), False, k.deaths[0].person))
    out += [(EVENT_TYPES.get(d.document_type, "other"), d.issued_on, d.issued_on, d.issued_on is not None, None) for d in k.documents]
    out += [("mutation", m.effective, m.effective, m.effective is not None, None) for m in k.mutations]
    out.sort(key=lambda e: _LAST if e[2] is None else e[2])
    return [(*e, i) for i, e in enumerate(out)]


# Reports as Arrow columns

_TEXTS = pa.list_(pa.string())
CHECK = {"rule": pa.string(), "rule_code": pa.string(), "status": pa.string(), "match_score": pa.float64(), "message": pa.string(), "documents": _TEXTS, "observed": pa.string(), "expected": pa.string()}
_SHARE = pa.struct([("num", pa.int64()), ("den", pa.int64())])
_HEIR = {"name": pa.string(), "f": pa.string(), "relation": pa.string(), "share": _SHARE}
_PART = {"rule": pa.string(), "rule_code": pa.string(), "status": pa.string(), "points": pa.float64()}
_EVENT = {"event_type": pa.string(), "event_date": pa.date32(), "anchor": pa.date32(), "stated": pa.bool_(), "person": pa.string(), "sequence": pa.int32()}


def _leaf(values, kind: pa.DataType) -> pa.Array:
    if kind == _SHARE:
        values = [None if v is None else {"num": v[0], "den": v[1]} for v in values]
    return pa.array(values, pa.int32()).cast(kind) if kind == pa.date32() else pa.array(values, kind)


def structs(rows: list[list[tuple]], fields: dict[str, pa.DataType]) -> pa.Array:
    """Lists of structs from each row's tuples."""
    ends, n = [0], 0
    for r in rows:
        n += len(r)
        ends.append(n)
    columns = list(zip(*(x for r in rows for x in r), strict=True)) or [()] * len(fields)
    items = pa.StructArray.from_arrays([_leaf(c, t) for c, t in zip(columns, fields.values(), strict=True)], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)


class Reports:
    """Columns of the reports of a batch of cases; ``wanted`` names them, checks have the fields ``told``."""

    TYPES = {"risk_score": pa.float64(), "risk_level": pa.string(), "outcome": pa.string(), "recommended_action": pa.string(), "event_type": pa.string(), "death_verified": pa.bool_()}

    def __init__(self, wanted: Sequence[str], told: Sequence[str], risk_points: dict[str, float] | None, disabled: Sequence[str]):
        self.wanted, self.told = tuple(wanted), tuple(told)
        self.disabled, self.points = frozenset(disabled), RISK_POINTS | (risk_points or {})
        self.clear = {s: i for i, s in enumerate(CHECK_STATUSES)}
        self.weighed: dict[tuple[str, str], float] = {}

    def weight(self, c: Check) -> float:
        if not MULTIPLIER[c.status]:
            return 0.0
        key = (c.rule_code, c.status)
        if key not in self.weighed:
            self.weighed[key] = rounded(self.points.get(c.rule_code, 20.0) * MULTIPLIER[c.status])
        return self.weighed[key]

    def _told(self, k: Case, checks: list[Check]) -> list[tuple]:
        if self.told == Check._fields[: len(self.told)]:
            return [c[: len(self.told)] for c in checks]
        shown = evidence(k) if {"documents", "observed", "expected"} & set(self.told) else {}
        none = (None, None, None)
        each = [(*c, MESSAGES.get(c.rule, {}).get(c.status), *shown.get(c.rule, none)) for c in checks]
        at = [list(CHECK).index(n) for n in self.told]
        return each if len(at) == len(CHECK) else [tuple(e[i] for i in at) for e in each]

    def batch(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        want = set(self.wanted)
        judged = bool(want & {"checks", "contributions", "risk_score", "risk_level", "outcome", "recommended_action"})
        active = [build for _, code, build in REGISTRY if f"SUCCESSION_{code}" not in self.disabled] if judged else []
        out: dict[str, list] = {n: [] for n in self.wanted}
        for k in cases(batch):
            row = {}
            if judged:
                checks: list[Check] = []
                for build in active:
                    checks += build(k)
                parts = [(c.rule, c.rule_code, c.status, p) for c in checks if (p := self.weight(c)) > 0]
                risk = rounded(min(100.0, _summed(parts)))
                outcome = OUTCOMES[CHECK_STATUSES[max((self.clear[c.status] for c in checks), default=0)]]
                row = {"contributions": parts, "risk_score": risk, "risk_level": next((n for least, n in BANDS if risk >= least), "low"), "outcome": outcome, "recommended_action": ACTIONS[outcome]}
                if "checks" in want:
                    row["checks"] = self._told(k, checks)
            if "event_type" in want:
                row["event_type"] = k.event_type
            if "death_verified" in want:
                row["death_verified"] = bool(k.recorded)
            if "heirs" in want:
                row["heirs"] = k.heirs
            if "timeline" in want:
                row["timeline"] = timeline(k)
            for n in out:
                if n in row:
                    out[n].append(row[n])
        lists = {"checks": {n: CHECK[n] for n in self.told}, "heirs": _HEIR, "contributions": _PART, "timeline": _EVENT}
        arrays = [batch.column(batch.schema.get_field_index(n)) if n in ("case_id", "parcel_key") else structs(out[n], lists[n]) if n in lists else pa.array(out[n], self.TYPES[n]) for n in self.wanted]
        return pa.RecordBatch.from_arrays(arrays, names=list(self.wanted))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(self.batch, batches)


def _summed(parts: list[tuple]) -> float:
    """In their order, one by one: the interpreter's own sum makes up for lost places."""
    total = 0.0
    for p in parts:
        total += p[3]
    return total


def diffs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``case_id, left, gone, kept`` of the first and the last snapshot."""
    pair = {"i": pa.int32(), "j": pa.int32()}
    for b in batches:
        left, gone, kept = zip(*(k.diff for k in cases(b)), strict=True) if b.num_rows else ((), (), ())
        number = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("case_id")), pa.array(left, number), pa.array(gone, number), structs(list(kept), pair)], names=["case_id", "left", "gone", "kept"])
