"""Places, publishers, agents and roles: a value, a confidence and the method for every raw string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import UNICODE, bound, collapse, nfkc, strip, unbracket

#: Relator codes with their terms.
RELATORS = {
    "aut": "author", "cre": "creator", "asn": "associated name", "com": "compiler", "ctb": "contributor", "oth": "other",
    "edt": "editor", "ann": "annotator", "cmm": "commentator", "crr": "corrector", "pfr": "proofreader", "red": "redactor", "rev": "reviewer",
    "wpr": "writer of preface", "aui": "author of introduction", "aft": "author of afterword", "wam": "writer of accompanying material", "trl": "translator",
    "art": "artist", "ill": "illustrator", "ilu": "illuminator", "eng": "engraver", "etr": "etcher", "ltg": "lithographer", "wde": "wood engraver", "drm": "draftsman", "clr": "colorist", "acp": "art copyist", "pnc": "penciller", "ink": "inker", "prm": "printmaker", "pop": "printer of plates", "plt": "platemaker",
    "prt": "printer", "pbl": "publisher", "bnd": "binder", "bdd": "binding designer", "bkd": "book designer", "bkp": "book producer", "bjd": "bookjacket designer", "bpd": "bookplate designer", "bka": "book artist", "cov": "cover designer", "tyd": "type designer", "tyg": "typographer", "ppm": "papermaker", "mrb": "marbler", "mfr": "manufacturer", "dst": "distributor",
    "scr": "scribe", "cll": "calligrapher", "rbr": "rubricator", "ins": "inscriber", "ctg": "cartographer", "srv": "surveyor", "dln": "delineator",
    "fmo": "former owner", "own": "owner", "col": "collector", "dnr": "donor", "bsl": "bookseller", "rps": "repository", "cur": "curator", "cor": "collection registrar",
    "dte": "dedicatee", "pat": "patron", "fnd": "funder", "spn": "sponsor", "hnr": "honoree", "pht": "photographer", "con": "conservator", "rsr": "restorationist", "fac": "facsimilist",
    "sgn": "signer", "wit": "witness", "cns": "censor", "lse": "licensee", "lso": "licensor", "res": "researcher", "exp": "expert",
}
#: Abbreviations of terms.
SHORT = {"impr.": "printer", "impr": "printer", "print.": "printer", "pub.": "publisher", "pub": "publisher", "publ.": "publisher", "ed.": "editor", "ed": "editor", "edit.": "editor", "trans.": "translator", "trans": "translator", "tran.": "translator", "tr.": "translator", "tr": "translator", "engr.": "engraver", "engr": "engraver", "illus.": "illustrator", "illus": "illustrator", "ill.": "illustrator", "phot.": "photographer", "annot.": "annotator"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _result(value: Column, display: Column, confidence: Column, method: Column) -> Column:
    return F.struct(value.alias("value"), display.alias("display"), confidence.cast("double").alias("confidence"), method.alias("method"))


def bare_name(raw: Column) -> Column:
    """Without outer blanks, final ``:,;/`` and brackets around the whole."""
    return unbracket(strip(F.regexp_replace(strip(raw), "[:,;/]+$", "")))


def clean_name(raw: Column, exact: bool = True) -> Column:
    """``bare_name`` composed by NFKC."""
    return nfkc(bare_name(raw), exact)


def normalize_imprint_name(raw: Column, kind: str, alias: Column | None = None, exact: bool = True) -> Column:
    """struct<value, display, confidence, method> of a raw place or publisher.

    ``alias`` is the canonical key that an alias map has for the folded name, joined beforehand (see
    ``imprint_key``), or null.
    """
    return imprint_value(raw, clean_name(raw, exact), kind, alias)


def imprint_value(raw: Column, clean: Column, kind: str, alias: Column | None = None) -> Column:
    """``normalize_imprint_name`` of a name whose ``clean_name`` is known."""
    none, blank = F.lit(None).cast("string"), F.lit("")

    def value(clean: Column) -> Column:
        out = F.when(raw.isNull() | (raw == ""), _result(none, blank, F.lit(0.0), F.lit("missing"))).when(clean == "", _result(none, blank, F.lit(0.0), F.lit("empty_after_cleaning")))
        if alias is not None:
            out = out.when(alias.isNotNull(), _result(alias, clean, F.lit(0.95), F.lit(f"{kind}_alias_map")))
        return out.otherwise(_result(F.lower(clean), clean, F.lit(0.80), F.lit(f"{kind}_casefold_strip")))

    return bound(clean, value)


def imprint_key(raw: Column, exact: bool = True) -> Column:
    return F.lower(clean_name(raw, exact))


def bare_agent(raw: Column) -> Column:
    return unbracket(strip(raw))


def agent_form(composed: Column) -> Column:
    """The key of an agent's ``bare_agent`` composed by NFKC."""
    return collapse(F.regexp_replace(F.lower(composed), "[.,;:]+$", ""))


def agent_key(raw: Column, exact: bool = True) -> Column:
    return agent_form(nfkc(bare_agent(raw), exact))


def normalize_agent(raw: Column, decision: Column | None = None, canonical: Column | None = None, confidence: Column | None = None, exact: bool = True) -> Column:
    """struct<value, display, confidence, method> of a raw agent; decision is an alias map's, joined by ``agent_key``."""
    return agent_value(raw, agent_key(raw, exact), decision, canonical, confidence)


def agent_value(raw: Column, key: Column, decision: Column | None = None, canonical: Column | None = None, confidence: Column | None = None) -> Column:
    """``normalize_agent`` of a name whose ``agent_key`` is known."""

    def value(key: Column) -> Column:
        out = F.when(raw.isNull() | (key == ""), _result(F.lit(""), F.coalesce(raw, F.lit("")), F.lit(0.0), F.lit("empty_after_cleaning")))
        if decision is not None:
            out = out.when(decision == "MAP", _result(canonical, raw, F.coalesce(confidence, F.lit(0.95)), F.lit("alias_map")))
            out = out.when(decision == "AMBIGUOUS", _result(F.lit("ambiguous"), raw, F.coalesce(confidence, F.lit(0.5)), F.lit("ambiguous")))
        return out.otherwise(_result(key, raw, F.lit(0.80), F.lit("base_clean")))

    return bound(key, value)


def normalize_role(raw: Column) -> Column:
    """struct<value, display, confidence, method> of a raw role."""
    key = F.lower(strip(raw))
    code = _lookup({k: v.replace(" ", "_") for k, v in RELATORS.items()}, key)
    # the term for "other" is no term of the map
    term = _lookup({v: v.replace(" ", "_") for k, v in RELATORS.items() if k != "oth"} | SHORT, key)
    shown = F.coalesce(raw, F.lit(""))
    return (
        F.when(raw.isNull() | (raw == ""), _result(F.lit("other"), shown, F.lit(0.5), F.lit("missing_role")))
        .when(code.isNotNull(), _result(code, shown, F.lit(0.99), F.lit("relator_code")))
        .when(term.isNotNull(), _result(term, shown, F.lit(0.95), F.lit("relator_term")))
        .otherwise(_result(F.lit("other"), shown, F.lit(0.6), F.lit("unmapped")))
    )


def place_basic(raw: Column) -> Column:
    """The simple place key that frequencies are counted by."""
    return F.lower(collapse(F.regexp_replace(unbracket(strip(raw)), UNICODE + r"[\s:,;/.]+$", "")))


def country_key(raw: Column) -> Column:
    return F.rtrim(F.lower(raw), F.lit("#|"))
