"""Plans of several steps: resolved in the order of their references, each a lazy DataFrame.

A step's params may refer to other steps: ``$step_N`` as a filter's value or scope, ``$a+$b`` as a
union of scopes, ``$previous_results`` as what an earlier plan left. A step that fails is recorded
and the rest goes on; a cycle or a reference to no step is an error of the plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import display, facets, network, resolve
from ..sources.catalog import Catalog
from . import compile as compiler
from .filters import Filter, PlanError, QueryPlan, coerce

REF = re.compile(r"\$step_(\d+)")
ACTIONS = ("resolve_agent", "resolve_publisher", "retrieve", "aggregate", "sample", "find_connections", "enrich")
TOPICAL = ("subject", "title")


@dataclass
class Step:
    action: str
    params: dict = field(default_factory=dict)
    depends_on: list[int] = field(default_factory=list)
    label: str = ""


@dataclass
class Result:
    """What a step gave: a table, of which kind, and what was relaxed on the way."""

    kind: str
    table: DataFrame | None
    status: str = "ok"
    notes: list[str] = field(default_factory=list)
    message: str = ""


def references(params) -> set[int]:
    """The steps that params refer to, at any depth."""
    if isinstance(params, str):
        return {int(x) for x in REF.findall(params)}
    if isinstance(params, dict):
        params = list(params.values())
    return set().union(*map(references, params)) if isinstance(params, list) else set()


def order(steps: list[Step]) -> list[int]:
    """An order in which every step follows those it needs (the least index first)."""
    needs = {i: references(s.params) | set(s.depends_on) for i, s in enumerate(steps)}
    for i, n in needs.items():
        if bad := [x for x in n if x not in needs or x == i]:
            raise PlanError(f"step {i} refers to {bad}")
    out: list[int] = []
    while len(out) < len(steps):
        ready = [i for i in needs if i not in out and needs[i] <= set(out)]
        if not ready:
            raise PlanError("the steps refer to one another in a circle")
        out.append(ready[0])
    return out


class Executor:
    """Runs plans on a catalogue.

    ``concepts`` widens topics by name; ``previous`` is what ``$previous_results`` means; ``hints`` is
    asked once for other filters where a retrieval on subjects finds nothing, with the commonest headings.
    """

    def __init__(self, cat: Catalog, concepts: dict[str, list[str]] | None = None, previous: DataFrame | None = None, hints: Callable[[list[Filter], DataFrame], list[Filter] | None] | None = None):
        self.cat, self.concepts, self.previous, self.hints = cat, concepts or {}, previous, hints
        self.values: dict[tuple[str, str], DataFrame] = {}  # of each $step_N that a filter on a field names
        self.handlers: dict[str, Callable[[dict, dict[int, Result]], Result]] = {a: getattr(self, a) for a in ACTIONS}

    def run(self, steps: list[Step]) -> dict[int, Result]:
        done: dict[int, Result] = {}
        self.values = {}
        for i in order(steps):
            step = steps[i]
            try:
                if step.action not in self.handlers:
                    raise PlanError(f"no such action: {step.action}")
                done[i] = self.handlers[step.action](step.params, done)
            except (PlanError, KeyError, TypeError, ValueError) as e:
                done[i] = Result("none", None, "error", message=str(e))
        return done

    def connect(self, done: dict[int, Result], most: int = 5) -> Result | None:
        """How the agents of the records retrieved are connected, where no step asked for it.

        The ``most`` agents with most of the records, if there are at least two.
        """
        found = [r for r in done.values() if r.kind == "records" and r.table is not None]
        if not found or any(r.kind == "connections" for r in done.values()):
            return None
        scope = reduce(DataFrame.unionByName, [self._records(r) for r in found]).distinct()
        top = facets.within(self.cat.agents.where("agent_norm is not null"), scope).groupBy("agent_norm").agg(F.count_distinct("record_id").alias("n")).orderBy(F.desc("n"), "agent_norm").limit(most)
        names = [r["agent_norm"] for r in top.collect()]
        return Result("connections", network.connections(self.cat, names)) if len(names) > 1 else None

    # scopes and references

    def scope(self, text: str | None, done: dict[int, Result]) -> DataFrame | None:
        """(record_id) of a scope, or None for the whole catalogue."""
        if text in (None, "", "full_collection"):
            return None
        if text == "$previous_results":
            empty = self.cat.records.where("false").select(F.col("id").alias("record_id"))
            return self.previous if self.previous is not None else empty
        found = [int(x) for x in REF.findall(text)]
        if not found:
            return None
        return reduce(DataFrame.unionByName, [self._records(done[i]) for i in found]).distinct()

    def _records(self, r: Result) -> DataFrame:
        if r.kind == "records" and r.table is not None:
            return self.cat.records.join(r.table.select("mms_id"), "mms_id", "left_semi").select(F.col("id").alias("record_id"))
        return self.cat.records.where("false").select(F.col("id").alias("record_id"))

    def _filter(self, raw: dict, done: dict[int, Result]) -> tuple[Filter | None, str | None]:
        """The filter, with the values resolved as a table beside a reference; and a name left unresolved."""
        value = raw.get("value")
        if isinstance(value, str) and (m := re.fullmatch(REF, value)):
            r = done[int(m[1])]
            column = r.table.columns[0] if r.table is not None else None
            values = r.table.select(F.col(column).cast("string").alias("value")).where(F.trim("value") != "").distinct() if column else None
            if values is None or values.isEmpty():
                return None, r.message or value
            if raw.get("field") == "year":  # integers, of which there are few
                return coerce(raw | {"op": "IN", "value": [x[0] for x in values.orderBy("value").collect()]}), None
            if raw.get("field") in resolve.SEVERAL:  # a name can tell several, as in resolve.split_values
                parts = F.explode(F.concat(F.array("value"), F.split("value", ",")))
                values = values.select(parts.alias("value")).where(F.trim("value") != "")
            self.values[value, raw.get("field")] = values
            return coerce(raw | {"op": "IN"}), None
        return coerce(raw), None

    # actions

    def resolve_agent(self, params: dict, done: dict[int, Result]) -> Result:
        t = resolve.agent(self.cat, params["name"])
        return Result("agents", t, "empty" if t.isEmpty() else "ok", message=params["name"])

    def resolve_publisher(self, params: dict, done: dict[int, Result]) -> Result:
        t = resolve.publisher(self.cat, params["name"])
        return Result("publishers", t, "empty" if t.isEmpty() else "ok", message=params["name"])

    def ids(self, filters: list[Filter], scope: DataFrame | None) -> DataFrame:
        """(mms_id) of the records in scope that meet all filters; no filters, no records."""
        if not filters:
            return self.cat.records.where("false").select("mms_id")
        cat = self.cat
        if scope is not None:
            cat = Catalog(**{**cat.__dict__, "records": facets.within(cat.records, scope, "id")})
        plan = QueryPlan([f if isinstance(f.value, str) and (f.value, f.field) in self.values else resolve.split_values(f) for f in filters])
        return compiler.ids(cat, plan, values=self.values)

    def retrieve(self, params: dict, done: dict[int, Result]) -> Result:
        scope = self.scope(params.get("scope"), done)
        told = [self._filter(f, done) for f in params.get("filters", [])]
        filters = [f for f, _ in told if f is not None]
        unresolved = [(raw, name) for raw, (f, name) in zip(params.get("filters", []), told, strict=True) if name]
        if unresolved:
            found, notes = self._recover(filters, unresolved, scope)
        else:
            found, notes = self.ids(filters, scope), []
            if filters and found.isEmpty():
                found, notes = self._relax(filters, scope)
            if self.hints and any(f.field == "subject" for f in filters) and found.isEmpty():
                other = self.hints(filters, facets.subject_hints(self.cat))
                if other:
                    found, notes = self.ids(other, scope), [*notes, "subjects by hint"]
        return Result("records", found, "empty" if found.isEmpty() else "ok", notes)

    def _relax(self, filters: list[Filter], scope: DataFrame | None) -> tuple[DataFrame, list[str]]:
        """What looser forms of the filters find: the first that finds anything."""
        notes: list[str] = []
        looser = [Filter(f.field, "CONTAINS", f.value, negate=f.negate) if f.field == "publisher" and f.op == "EQUALS" else f for f in filters]
        if looser != filters:
            notes.append("publisher: equal to any part")
            found = self.ids(looser, scope)
            if not found.isEmpty():
                return found, notes
        topics = [f for f in looser if f.field in TOPICAL and f.op == "CONTAINS" and not f.negate]
        hard = [f for f in looser if f not in topics]
        if len(topics) >= 2:
            notes.append("topics: any of them")
            found = self._any(hard, topics, scope)
            if not found.isEmpty():
                return found, notes
        if topics:
            wider: list[Filter] = []
            for t in topics:
                own = [Filter(t.field, "CONTAINS", c) for c in self.concepts.get(t.value.strip().lower(), [])]
                if not own or self._any(hard, own, scope).isEmpty():
                    own += [Filter(t.field, "CONTAINS", s) for s in resolve.stem_variants(t.value)]
                wider += [t, *own]
            notes.append("topics: by concept and number")
            return self._any(hard, wider, scope), notes
        return self.ids(looser, scope), notes

    def _any(self, hard: list[Filter], topics: list[Filter], scope: DataFrame | None) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.ids([*hard, t], scope) for t in topics]).distinct()

    def _recover(self, filters: list[Filter], unresolved: list[tuple[dict, str]], scope: DataFrame | None) -> tuple[DataFrame, list[str]]:
        """Records that hold words of a name which could not be resolved; a word that finds too many is dropped."""
        twin = {"agent_norm": "publisher", "publisher": "agent_norm"}
        most = resolve.ceiling(self.cat.records.count())
        probes, notes = [], []
        for raw, name in unresolved:
            for w in resolve.fallback_words(name):
                for f in dict.fromkeys((raw["field"], twin.get(raw["field"], raw["field"]))):
                    probes.append(self.ids([*filters, Filter(f, "CONTAINS", w)], scope).withColumn("probe", F.lit(f"{f}:{w}")))
            notes.append(f"{raw['field']}: words of {name!r}")
        if probes:
            hits = reduce(DataFrame.unionByName, probes)
            kept = hits.groupBy("probe").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("probe")
            found = hits.join(kept, "probe").select("mms_id").distinct()
            if not found.isEmpty():
                return found, notes
        return self.ids(filters, scope), [*notes, "names left out"]

    def aggregate(self, params: dict, done: dict[int, Result]) -> Result:
        name = facets.ALIASES.get(params["field"], params["field"])
        if name not in facets.FACETS:
            return Result("facet", None, "empty", message=f"no facet {params['field']}")
        return Result("facet", facets.facet(self.cat, name, params.get("limit", 20), self.scope(params.get("scope"), done)))

    def sample(self, params: dict, done: dict[int, Result]) -> Result:
        scope, n = self.scope(params.get("scope"), done), params.get("n", 10)
        match params.get("strategy", "earliest"):
            case "diverse":
                return Result("records", display.diverse(self.cat, scope, n))
            case "notable":
                rows = [(r["mms_id"], r["total"]) for r in display.notable(self.cat, scope, n)]
                return Result("records", self.cat.records.sparkSession.createDataFrame(rows, "mms_id string, score double"))
        return Result("records", display.earliest(self.cat, scope, n))

    def find_connections(self, params: dict, done: dict[int, Result]) -> Result:
        names = list(params.get("agents", []))
        for i in {i for a in names for i in references(a)}:
            names += [r[0] for r in done[i].table.select("agent_norm").limit(51).collect()]
        return Result("connections", network.connections(self.cat, [n for n in names if not REF.fullmatch(n)]))

    def enrich(self, params: dict, done: dict[int, Result]) -> Result:
        from ..operators import enrichment

        names = params.get("agents") or params.get("targets") or []
        names = [names] if isinstance(names, str) else names
        norms = [done[i].table.select("agent_norm") for n in names for i in references(n)]
        return Result("profiles", enrichment.profiles(self.cat, [n for n in names if not references(n)], reduce(DataFrame.unionByName, norms) if norms else None))
