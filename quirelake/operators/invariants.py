"""The invariants of one key or one row, counted together in one pass over each table.

A table tells, for each of its rows, the facts that rules ask for: (space, key, tag), such as "record 7 is
named by an agent" or "this row breaks M2". All tables' facts meet in one aggregate by space and key, which
counts them by tag, so rules about the same keys share them: a key that a child has and no parent is a row
too many, a key that a tag has twice is no key. Counts combine before the shuffle, so frequent keys cost
nothing more, and the plan has one scan a table and one shuffle of keys however many rules there are.

Rules that compare two keys of a row stay joins, in ``quality.invariants``.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from . import quality


@dataclass(frozen=True)
class Fact:
    """What rows of a table say of a key: SQL expressions over the table, with a whole number if one is asked for."""

    space: str
    table: str
    key: str
    where: str = "true"
    mark: str | None = None


@dataclass(frozen=True)
class Rule:
    """``rows``: none has the fact. ``lacks``: rows whose key no parent has. ``twice``: keys that several rows
    have. ``several``: keys with more than one mark that no parent has."""

    id: str
    kind: str
    fact: Fact
    parents: tuple[Fact, ...] = ()


#: The space of broken rows, whose keys are rules.
ROWS = ""


def rules(cat: Catalog) -> list[Rule]:
    """The rules that a catalogue has the tables and columns for, with the ids of ``quality.invariants``."""
    has = lambda t, *cs: getattr(cat, t) is not None and set(cs) <= set(getattr(cat, t).columns)
    out: list[Rule] = []

    def row(name: str, table: str, broken: str, *columns: str) -> None:
        if has(table, *columns):
            out.append(Rule(name, "rows", Fact(ROWS, table, f"'{name}'", broken)))

    record = Fact("record", "records", "id")
    for t in ("imprints", "titles", "subjects", "agents", "languages", "notes", "physical_descriptions"):
        out.append(Rule(f"orphan_{t}", "lacks", Fact("record", t, "record_id"), (record,)))
    if has("record_scope_flags"):
        out.append(Rule("R1", "lacks", Fact("record", "record_scope_flags", "record_id"), (record,)))
    out.append(Rule("mms_id_unique", "twice", Fact("mms_id", "records", "mms_id")))
    row("confidence_range", "agents", "agent_confidence < 0 or agent_confidence > 1", "agent_confidence")
    row("place_trimmed", "imprints", "place_norm != trim(place_norm)")
    row("publisher_lower", "imprints", "publisher_norm != lower(publisher_norm)")
    row("agent_type_known", "agents", "agent_type not in ('personal', 'corporate', 'meeting')")
    row("M1", "imprints", "(publisher_norm is not null and publisher_raw is null) or (place_norm is not null and place_raw is null) or ((date_start is not null or date_end is not null) and date_raw is null)", "place_raw", "publisher_raw", "date_raw")
    row("M2", "imprints", "date_start > date_end")
    row("M3", "imprints", "country_name is not null and country_code is null", "country_code")
    row("S3mojibake", "subjects", "contains(value_he, '�')", "value_he")
    row("S3empty", "subjects", "value_he = ''", "value_he")
    if cat.has_aliases:
        own = Fact("authority", "agent_authorities", "id")
        out.append(Rule("I3", "lacks", Fact("authority", "agent_aliases", "authority_id"), (own,)))
        row("I4", "agent_aliases", "alias_form rlike '^[ -~]*$' and alias_form_lower != lower(alias_form)")
        row("I5", "agent_authorities", "canonical_name rlike '^[ -~]*$' and canonical_name_lower != lower(canonical_name)")
        out.append(Rule("A1", "twice", Fact("alias", "agent_aliases", "alias_form_lower")))
    if has("publisher_authorities") and has("publisher_variants"):
        name, form = Fact("publisher", "publisher_authorities", "canonical_name_lower"), Fact("publisher", "publisher_variants", "variant_form_lower")
        printed = Fact("publisher", "imprints", "publisher_norm", "publisher_norm is not null", "record_id")
        out.append(Rule("P1", "lacks", Fact("publisher id", "publisher_variants", "authority_id"), (Fact("publisher id", "publisher_authorities", "id"),)))
        out.append(Rule("P2", "several", printed, (name, form)))
        out.append(Rule("variant_unique", "twice", form))
        if has("publisher_variants", "variant_form"):
            out.append(Rule("P6", "lacks", Fact("publisher", "publisher_variants", "variant_form_lower", "variant_form_lower != lower(variant_form)"), (printed,)))
    if has("network_nodes") and has("network_edges"):
        out.append(Rule("N2", "lacks", Fact("agent", "network_nodes", "agent_norm", "node_type = 'person'"), (Fact("agent", "agents", "agent_norm"),)))
        if has("publisher_authorities"):
            out.append(Rule("N3", "lacks", Fact("publisher", "network_nodes", "substring(agent_norm, 5, 10000)", "node_type = 'publisher'"), (Fact("publisher", "publisher_authorities", "canonical_name_lower"),)))
        row("N6self", "network_edges", "source = target")
        row("N6bounds", "network_edges", "confidence < 0 or confidence > 1", "confidence")
    return out


def once(cat: Catalog, only: set[str] | None = None) -> DataFrame:
    """(id, violations) of the rules, or of some of them, with one scan of each table that they are about."""
    asked = [r for r in rules(cat) if only is None or r.id in only]
    if not asked:
        return cat.records.sparkSession.createDataFrame([], "id string, violations long")
    facts = list(dict.fromkeys(f for r in asked for f in (r.fact, *r.parents)))
    spaces, tags = list(dict.fromkeys(f.space for f in facts)), defaultdict(dict)
    for f in facts:
        tags[f.space].setdefault(ROWS if f.space == ROWS else f, len(tags[f.space]))
    tag = lambda f: tags[f.space][ROWS if f.space == ROWS else f]

    def told(table: str) -> DataFrame:
        each = [
            F.when(F.expr(f.where), F.struct(F.lit(spaces.index(f.space)).alias("space"), F.expr(f.key).cast("string").alias("key"), F.lit(tag(f)).alias("tag"), (F.expr(f.mark) if f.mark else F.lit(None)).cast("long").alias("mark")))
            for f in facts if f.table == table
        ]
        return getattr(cat, table).select(F.explode(F.array_compact(F.array(*each))).alias("f")).select("f.*")

    rows = reduce(DataFrame.unionByName, [told(t) for t in dict.fromkeys(f.table for f in facts)])
    n = lambda f: F.col(f"n{tag(f)}")
    most = max(len(t) for t in tags.values())
    keys = rows.groupBy("space", "key").agg(*[F.count_if(F.col("tag") == i).alias(f"n{i}") for i in range(most)], F.min("mark").alias("low"), F.max("mark").alias("high"))

    def broken(r: Rule) -> Column:
        alone = reduce(lambda a, b: a & b, [n(p) == 0 for p in r.parents], F.lit(True)) | F.col("key").isNull()
        here = F.col("space") == spaces.index(r.fact.space)
        match r.kind:
            case "rows":
                return F.when(here & (F.col("key") == r.id), n(r.fact))
            case "lacks":
                return F.when(here & alone, n(r.fact))
            case "twice":
                return F.when(here & (n(r.fact) > 1), 1)
        return F.when(here & alone & (F.col("low") < F.col("high")), 1)

    counts = keys.agg(*[F.coalesce(F.sum(broken(r)), F.lit(0)).cast("long").alias(r.id) for r in asked])
    pairs = F.explode(F.array(*[F.struct(F.lit(r.id).alias("id"), F.col(r.id).alias("violations")) for r in asked])).alias("v")
    return counts.select(pairs).select("v.*")


def violations(cat: Catalog) -> DataFrame:
    """(id, violations) of all invariants: those of one key or row in one pass, the others a join each."""
    done = {r.id for r in rules(cat)}
    rest = [i for i in quality.invariants(cat) if i.id not in done]
    return once(cat).unionByName(quality.violations(rest)) if rest else once(cat)
