"""Structured filters: fields, operations, validation, coercion and normal forms of their values."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field

FIELDS = ("publisher", "imprint_place", "country", "year", "language", "title", "subject", "agent", "agent_norm", "agent_role", "agent_type", "physical_desc")
OPS = ("EQUALS", "CONTAINS", "RANGE", "IN")
STEP = re.compile(r"^\$step_\d+$")


class PlanError(ValueError):
    """A filter or plan that cannot be run."""


def _is_year(v) -> bool:
    return bool(re.fullmatch(r"-?\d+", str(v).strip()))


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: str | list[str] | None = None
    start: int | None = None
    end: int | None = None
    negate: bool = False
    confidence: float | None = None
    notes: str | None = None

    def __post_init__(self):
        problem = self._problem()
        if problem:
            raise PlanError(f"{self.field} {self.op}: {problem}")

    def _problem(self) -> str | None:
        if self.field not in FIELDS or self.op not in OPS:
            return "no such field or operation"
        if self.confidence is not None and not 0 <= self.confidence <= 1:
            return "confidence lies between 0 and 1"
        if self.op == "RANGE":
            if self.field != "year":
                return "only a year has ranges"
            if self.start is None or self.end is None:
                return "a range needs a start and an end"
            return "start is after end" if self.start > self.end else None
        if self.field == "year" and self.op != "IN":
            return "a single year is a range with equal start and end"
        if self.field == "physical_desc" and self.op == "EQUALS":
            return "extents are free text: use CONTAINS or IN"
        if self.field == "agent" and self.op != "CONTAINS":
            return "agent has CONTAINS only: use agent_norm"
        if self.op == "IN":
            if isinstance(self.value, str):
                return None if STEP.match(self.value) else "IN needs a list"
            if not isinstance(self.value, list) or not self.value:
                return "IN needs a list with members"
            if not all(isinstance(v, str) for v in self.value):
                return "members are strings"
            if any(not v.strip() for v in self.value):
                return "members are not empty"
            if self.field == "year" and not all(_is_year(v) for v in self.value):
                return "years are integers"
            return None
        if not isinstance(self.value, str):
            return "a string is needed"
        return None if self.value.strip() else "the value is empty"

    @property
    def values(self) -> list[str]:
        return [str(v) for v in self.value] if isinstance(self.value, list) else [str(self.value)]


@dataclass(frozen=True)
class QueryPlan:
    filters: list[Filter] = field(default_factory=list)
    soft_filters: list[Filter] = field(default_factory=list)
    limit: int | None = None
    query_text: str = ""

    def __post_init__(self):
        if self.limit is not None and self.limit <= 0:
            raise PlanError("a limit is positive")

    @classmethod
    def from_dict(cls, plan: dict) -> QueryPlan:
        """A plan from JSON; unknown keys are an error."""
        extra = set(plan) - {"version", "query_text", "filters", "soft_filters", "limit", "debug"}
        if extra:
            raise PlanError(f"unknown keys: {sorted(extra)}")
        make = lambda fs: [Filter(**_known(f)) for f in fs]
        return cls(make(plan.get("filters", [])), make(plan.get("soft_filters", [])), plan.get("limit"), plan.get("query_text", ""))

    @property
    def hash(self) -> str:
        """A digest that equal plans share."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def _known(f: dict) -> dict:
    extra = set(f) - {"field", "op", "value", "start", "end", "negate", "confidence", "notes"}
    if extra:
        raise PlanError(f"unknown keys in a filter: {sorted(extra)}")
    return f


def coerce(raw: dict) -> Filter | None:
    """The filter that a loosely written one means, or None where it has no value left."""
    f = dict(raw)
    value, op, name = f.get("value"), f.get("op"), f.get("field")
    as_text = lambda v: str(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
    value = [as_text(v) for v in value] if isinstance(value, list) else as_text(value)
    if op == "IN" and isinstance(value, str) and not STEP.match(value):
        value = [value]
    if op in ("EQUALS", "CONTAINS") and isinstance(value, list):
        op = "IN"
    if op == "IN" and isinstance(value, list):
        value = [v for v in value if isinstance(v, str) and v.strip()]
        if not value:
            return None
    if op in ("EQUALS", "CONTAINS") and (value is None or (isinstance(value, str) and not value.strip())):
        return None
    if name == "year" and op in ("EQUALS", "CONTAINS") and isinstance(value, str):
        years = [int(y) for y in re.findall(r"\d{4}", value)]
        if len(years) in (1, 2):
            return Filter("year", "RANGE", start=min(years), end=max(years), negate=f.get("negate", False), confidence=f.get("confidence"))
    return Filter(**_known(f | {"op": op, "value": value}))


def clean_phrase(value: str) -> str:
    """A value for full-text search: without quotes and operators."""
    return " ".join(re.sub(r"[(){}^:+\-]", " ", value.replace("'", "")).split()).strip('"')


def normal_value(name: str, value: str) -> str:
    """The form of a value that the field's column holds."""
    v = value.strip()
    if name in ("publisher", "imprint_place"):
        v = re.sub(r"[^\w\s\-,]", "", v.casefold().replace("[", "").replace("]", ""))
        return " ".join(v.split()).rstrip(",").strip()
    if name.startswith("agent"):
        v = v.casefold().replace("[", "").replace("]", "").replace(",", "")
        return " ".join(v.rstrip(".,;: ").split())
    return v.lower()


def warnings(filters: list[Filter]) -> list[str]:
    """What a reader of the results should know about the plan."""
    out = [] if filters else ["no filters: the whole catalogue matches"]
    for f in filters:
        if f.confidence is not None and f.confidence < 0.7:
            out.append(f"low confidence in {f.field}: {f.confidence}")
        if f.op == "RANGE" and f.end - f.start > 200:
            out.append(f"wide span of years: {f.start}-{f.end}")
        if f.op == "CONTAINS" and isinstance(f.value, str) and " " not in f.value.strip() and len(f.value.strip()) < 4:
            out.append(f"vague {f.field}: {f.value}")
    return out
