"""The question IR: a small closed set of intents with validation, coercion, JSON round trip and a stable cache key."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

#: The words of the IR.
INTENTS = ("top_n", "count", "trend", "list", "lookup", "path", "neighbors")
METRICS = ("count", "sum_isk", "avg_isk")
OPERATORS = ("eq", "in", "ne")
MAX_LIMIT = 1000
VERSION = "1"
#: Seconds for which an answer may be reused.
CACHE_SECONDS = {"list": 30, "lookup": 86400, "path": 86400, "neighbors": 86400}


class PlanError(ValueError):
    """A plan that means nothing; nothing falls back silently."""


@dataclass(frozen=True)
class Entity:
    role: str
    kind: str
    operator: str = "eq"
    value: object = None


@dataclass(frozen=True)
class Plan:
    intent: str
    metric: str = "count"
    subject: Entity | None = None
    filters: tuple[Entity, ...] = ()
    since: str | None = None
    until: str = "now"
    group_by: Entity | None = None
    interval: str | None = None
    limit: int = 10
    version: str = VERSION

    def checked(self) -> Plan:
        """The plan with defaults filled in; PlanError if it can't be answered."""
        for value, known, what in ((self.intent, INTENTS, "intent"), (self.metric, METRICS, "metric"), (self.version, (VERSION,), "version")):
            if value not in known:
                raise PlanError(f"unknown {what}: {value}")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise PlanError(f"limit must lie between 1 and {MAX_LIMIT}")
        for f in self.filters:
            if f.operator not in OPERATORS:
                raise PlanError(f"unknown operator: {f.operator}")
            if f.value is None or f.value == []:
                raise PlanError(f"filter {f.role}/{f.kind} is missing value")
        out = self
        if self.intent == "top_n":
            if self.subject is None:
                raise PlanError("top_n requires a subject")
            out = dataclasses.replace(out, group_by=self.group_by or Entity(self.subject.role, self.subject.kind))
        elif self.intent == "count":
            out = dataclasses.replace(out, metric="count")
        elif self.intent == "trend" and not self.interval:
            raise PlanError("trend requires a time_interval")
        elif self.intent in ("lookup", "neighbors") and (self.subject is None or self.subject.value is None):
            raise PlanError(f"{self.intent} requires a subject with a value")
        elif self.intent == "path" and len(self.filters) != 2:
            raise PlanError("path requires two ends")
        return out

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Plan:
        d = json.loads(text)
        entity = lambda e: None if e is None else Entity(**e)
        d |= {"subject": entity(d.get("subject")), "group_by": entity(d.get("group_by")), "filters": tuple(map(entity, d.get("filters", ())))}
        return Plan(**d)

    def key(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    def cache_seconds(self) -> int:
        return CACHE_SECONDS.get(self.intent, 60)


_RELATIVE = re.compile(r"now(?:-(\d+)([mhdw]))?")
_UNITS = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def instant(expression: str, now: datetime) -> datetime:
    """A moment given as ISO 8601, `now` or `now-30d`; now is always passed in."""
    if m := _RELATIVE.fullmatch(expression):
        return now - timedelta(**{_UNITS[m[2]]: int(m[1])}) if m[1] else now
    try:
        return datetime.fromisoformat(expression)
    except ValueError as e:
        raise PlanError(f"no moment: {expression}") from e


@dataclass(frozen=True)
class Template:
    """A question form: a pattern with named groups and the plan it stands for."""

    pattern: str
    build: object = field(compare=False)

    def read(self, question: str) -> Plan | None:
        m = re.fullmatch(self.pattern, question.strip().rstrip("?").strip(), re.IGNORECASE)
        return self.build(m.groupdict()).checked() if m else None


def _victims(g: dict) -> tuple[Entity, ...]:
    return (Entity("victim", "segment", "eq", g["segment"].upper()),) if g.get("segment") else ()


_SPAN = r"(?:\s+in the last (?P<n>\d+) (?P<unit>minute|hour|day|week)s?)?"


def _since(g: dict) -> str:
    return f"now-{g['n']}{g['unit'][0].lower()}" if g.get("n") else "now-7d"


TEMPLATES = (
    Template(
        r"top (?P<limit>\d+) (?:ships|types)(?: against (?P<segment>\w+))?" + _SPAN,
        lambda g: Plan("top_n", subject=Entity("attacker", "type"), filters=_victims(g), since=_since(g), limit=int(g["limit"])),
    ),
    Template(r"how many (?:kills|events)(?: against (?P<segment>\w+))?" + _SPAN, lambda g: Plan("count", filters=_victims(g), since=_since(g))),
    Template(
        r"(?:route|path) from (?P<a>\d+) to (?P<b>\d+)",
        lambda g: Plan("path", filters=(Entity("any", "node", "eq", int(g["a"])), Entity("any", "node", "eq", int(g["b"])))),
    ),
    Template(r"neighbou?rs of (?P<a>\d+)", lambda g: Plan("neighbors", subject=Entity("any", "node", "eq", int(g["a"])))),
)


def parse(question: str) -> Plan | None:
    """The plan of a question in one of the known forms, else None."""
    return next((p for t in TEMPLATES if (p := t.read(question))), None)
