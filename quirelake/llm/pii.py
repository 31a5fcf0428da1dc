"""Surrogates for personal data.

Personal data and secrets are detected in whole texts, and every distinct entity of the corpus gets a
surrogate of its own: drawn by a keyed hash (HMAC-SHA256) from its type and canonical form, in the
layout of what it replaces - digits for digits of the same script, letter case for letter case, hyphens
where the name has them, in the script of the name. A given name has one surrogate, of the gender that
most of the corpus's forms of address tell with it. Phone numbers keep
their country code, IBANs their country, and check digits of IBANs, and of cards that had valid ones,
are computed. Surrogates are checked against all real entities of the corpus and against one another;
of those that clash all but one are drawn again, a little longer each time, until none is left. So
different entities stay different, mentions of one entity stay one, and no surrogate is somebody's
real datum.

The entity table is distributed: it is drawn, checked and joined back as DataFrames, and only texts
that hold a detectable entity pass through Python or a shuffle.

Defined results: null text stays null and texts without an entity stay byte for byte as they are.
Names are mapped by part, so that a surname alone and a full name keep their coreference. A name found
after a form of address is replaced wherever its document has it as a capitalized word, but for parts that the
document also has in lower case, which may be words. Thirteen to
nineteen digits are a card if they are sixteen, written in groups, or end in a valid check digit. Very long texts are scanned whole, in time linear in their length. Mail
addresses are mapped by mailbox and domain, so that addresses of one domain keep one. Repeated rows are rewritten
each, as are rows with a null or a repeated ``doc_id``. An empty table gives an empty result. Other
columns are kept; one named ``n_replaced`` is replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import arrow_map, staged

#: Rounds of drawing in which numbers keep their length; from then on each round adds a digit. Names,
#: mailboxes and domains grow with every round, so the space outgrows any number of entities.
ROUNDS = 12

#: Forms of address that come before a name, by the gender they tell.
ADDRESS = {
    "m": ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Doña"),
    "n": ("Dr", "Prof", "Professor"),
}
GENDER = {a.lower(): g for g, names in ADDRESS.items() for a in names}

#: Syllables that surrogate names are built of, by script, and endings of given names by gender.
SYLLABLES = {
    "latin": (["ba", "be", "da", "do", "fe", "ga", "ka", "la", "le", "lo", "ma", "me", "na", "no", "ra", "ri", "sa", "so", "ta", "ve"], {"m": "n", "f": "a", "n": "e", "s": "r"}),
    "cyrillic": (["ба", "ве", "га", "да", "же", "за", "ка", "ле", "ма", "но", "па", "ро", "са", "те", "фе", "хо"], {"m": "н", "f": "а", "n": "е", "s": "в"}),
    "greek": (["βα", "γε", "δα", "ζη", "θε", "κα", "λε", "μα", "νι", "πα", "ρο", "σα", "τε", "φι"], {"m": "ν", "f": "α", "n": "ι", "s": "ς"}),
    "hebrew": (["בא", "גל", "דן", "הר", "זי", "טל", "לי", "מר", "נו", "עד", "רו", "שי"], {"m": "ן", "f": "ה", "n": "י", "s": "ר"}),
}
SCRIPTS = (("cyrillic", 0x400, 0x52F), ("greek", 0x370, 0x3FF), ("hebrew", 0x590, 0x5FF))

#: The country calling codes of one and two digits; all others have three.
SHORT_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()

_CAP = r"(?:[^\W\d_a-zß-öø-ÿ]['’](?=[^\W\d_a-zß-öø-ÿ]))?[^\W\d_a-zß-öø-ÿ][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Every type's pattern; earlier ones win where they overlap.
PATTERNS = [
    ("mail", r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}"),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![0-9A-Za-z])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?\w)"),
    ("ip6", rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\w:])"),
    ("card", r"(?<![\w.,-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5}|(?<!\d[ -])\d(?:[ -]?\d){12,18}(?![ -]\d))(?![\w-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<![\w(])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[.-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{5,8})(?![\w-])"),
    ("name", r"(?<!\w)(?P<address>" + "|".join(sorted((a for names in ADDRESS.values() for a in names), key=len, reverse=True)) + rf")\.? (?P<parts>{_CAP}(?: {_CAP}){{0,2}})"),
]
FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
_NAME, _WORD = re.compile(rf"(?<![\w'’-]){_CAP}"), re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")
#: What a text must hold for any of the patterns to match: all but names hold an @ or a decimal digit
#: (the ranges are digits that the JVM's tables need not know yet). It is scanned for in every
#: text, so each alternative fails at its first character nearly everywhere.
HINT = r"[@\p{Nd}\x{11F50}-\x{11F59}\x{16AC0}-\x{16AC9}\x{1E4F0}-\x{1E4F9}]|(?=[" + "".join(sorted({a[0] for names in ADDRESS.values() for a in names})) + r"])(?:" + "|".join(a for names in ADDRESS.values() for a in names) + r")\.? \S"


def script_of(text: str) -> str:
    return next((s for c in text for s, low, high in SCRIPTS if low <= ord(c) <= high), "latin")


def canonical(kind: str, text: str) -> str:
    """What mentions of one entity have in common."""
    if kind in ("phone", "card", "ssn"):
        digits = "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())
        return f"+{digits}" if kind == "phone" and text[0] == "+" else digits
    if kind == "ip6":
        return ipaddress.ip_address(text).exploded
    return re.sub(r"\s", "", text).lower().replace("’", "'")


def _is_ip6(text: str) -> bool:
    """Whether this is an address, and not a name of a program's parts such as ``ab::cd``."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return any(c.isdigit() for c in text) and text.count(":") > 2


def _is_card(text: str) -> bool:
    digits = canonical("card", text)
    return not text.isdecimal() or len(digits) == 16 or luhn(digits[:-1]) == int(digits[-1])


def is_name(kind: str) -> bool:
    return kind == "surname" or kind.startswith("given")


def _addressed(text: str) -> Iterator[tuple[int, int, str, str]]:
    """The entities that their own form, or a form of address before them, tells."""
    for m in FINDER.finditer(text):
        kind = m.lastgroup if m.lastgroup not in ("address", "parts") else "name"
        if kind == "secret" and not (re.search(r"[0-9]", m[0]) and re.search(r"[A-Za-z]", m[0])) or kind == "ip6" and not _is_ip6(m[0]) or kind == "card" and not _is_card(m[0]):
            continue
        if kind == "mail":
            at = m.start() + m[0].index("@")
            yield m.start(), at, "mailbox", canonical(kind, m[0])
            yield at + 1, m.end(), "domain", canonical(kind, text[at + 1 : m.end()])
        elif kind == "name":
            gender, parts = GENDER[m["address"].lower()], list(re.finditer(r"\S+", m["parts"]))
            for i, p in enumerate(parts):
                begin, part = m.start("parts") + p.start(), _owner(p[0])
                role = "surname" if i == len(parts) - 1 else f"given-{gender}"
                yield begin, begin + len(part), role, canonical("name", part)
        else:
            yield m.start(), m.end(), kind, canonical(kind, m[0])


def _owner(name: str) -> str:
    """A name without the ending of the possessive."""
    return name[:-2] if len(name) > 3 and name[-2] in "'’" and name[-1] in "sS" else name


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, type, canonical form) of the entities of a text, in order; names and addresses part by part."""
    told = list(_addressed(text))
    names = {canon: kind for _, _, kind, canon in reversed(told) if is_name(kind)}
    if not names:
        return told
    for m in _WORD.finditer(text):
        if m[0] in names:  # in lower case too
            del names[m[0]]
    held = iter([*told, (len(text), len(text), "", "")])
    begin, end, *_ = next(held)
    more = []
    for m in _NAME.finditer(text):
        part = _owner(m[0])
        canon = canonical("name", part)
        if canon not in names:
            continue
        at, upto = m.start(), m.start() + len(part)
        while end <= at and begin < len(text):
            begin, end, *_ = next(held)
        if upto <= begin:
            more.append((at, upto, names[canon], canon))
    return sorted(told + more)


#: What joins the parts of one name.
_JOIN = r"([-'’])"


def _stream(key: bytes, *parts: str) -> Iterator[int]:
    k = 0
    while True:
        yield from hmac.new(key, "\x1f".join([*parts, str(k)]).encode(), hashlib.sha256).digest()
        k += 1


def luhn(digits: str) -> int:
    """The check digit that goes after these digits of a card."""
    twice = [int(c) * 2 for c in digits[::-2]]
    return -(sum(x - 9 if x > 9 else x for x in twice) + sum(int(c) for c in digits[-2::-2])) % 10


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in f"{account}{country}00")
    return f"{98 - int(number) % 97:02}"


def draw(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """The canonical form of a candidate surrogate."""
    s = _stream(key, kind, canon, str(attempt))
    below = lambda n: (next(s) << 8 | next(s)) % n
    letters = "abcdefghijklmnopqrstuvwxyz"
    digit = lambda c: str(1 + below(9)) if c != "0" else "0"  # noqa: E731  a first digit stays zero or not
    digits = lambda text: "".join(str(below(10)) for _ in text)
    longer = "0" * max(0, attempt - ROUNDS + 1)
    if kind == "ip":
        return ".".join(str(1 + below(254)) for _ in range(4))
    if kind == "ip6":
        return ":".join(f"{below(65536):04x}" for _ in range(8))
    if kind == "card":
        body = canon[0] + digits(canon[1:-1] + longer)
        return body + (str(luhn(body)) if luhn(canon[:-1]) == int(canon[-1]) else digits(" "))
    if kind == "phone":
        keep = 0
        if canon[0] == "+":
            keep = next((n + 1 for n in (1, 2) if canon[1 : 1 + n] in SHORT_CODES), 4)
        rest = canon[keep:] + longer
        return canon[:keep] + (digit(rest[0]) + digits(rest[1:]) if rest else "")
    if kind == "ssn":
        return digit(canon[0]) + digits(canon[1:] + longer)
    same = lambda text, low: "".join(low[below(10)] if c.isdigit() else low[10 + below(len(low) - 10)] if c.isalpha() else c for c in text)
    if kind == "iban":
        account = same(canon[4:], "0123456789" + letters)
        return canon[:2] + iban_check(canon[:2], account) + account
    if kind == "secret":
        keep = len(canon) - len(canon.split("_")[-1].split("-")[-1].removeprefix("akia"))
        return canon[:keep] + same(canon[keep:], "0123456789abcdef" if re.fullmatch(r"[0-9a-f]+", canon) else "0123456789" + letters)
    if kind == "mailbox":
        return "".join(letters[below(26)] if c.isalpha() else str(below(10)) if c.isdigit() else c for c in canon.split("@")[0] + "a" * attempt)
    if kind == "domain":
        labels = [len(x) for x in canon.split(".")[:-1]]
        labels[-1] = max(labels[-1], 6) + attempt
        return ".".join("".join(letters[below(26)] for _ in range(n)) for n in labels) + ".invalid"
    syllables, ends = SYLLABLES[script_of(canon)]
    ending = ends[kind.removeprefix("given-") if kind.startswith("given-") else "s"]
    parts = re.split(_JOIN, canon)
    name = lambda grow: "".join(syllables[below(len(syllables))] for _ in range(2 + below(2) + grow)) + ending
    drawn = [x if i % 2 else syllables[below(len(syllables))][0] if len(x) == 1 and i < len(parts) - 1 else name(attempt if i == len(parts) - 1 else 0) for i, x in enumerate(parts)]
    return "".join(drawn)


def render(kind: str, mention: str, surrogate: str) -> str:
    """The surrogate in the layout of the mention."""
    if kind in ("phone", "card", "ssn"):
        left, zero = iter(surrogate.removeprefix("+")), 48
        out = []
        for c in mention:
            if c.isdecimal():
                zero = ord(c) - unicodedata.decimal(c)
                c = chr(zero + int(next(left)))
            out.append(c)
        return "".join([*out, *(chr(zero + int(x)) for x in left)])
    if kind == "iban":
        left = iter(surrogate)
        return "".join(c if c.isspace() else next(left).upper() for c in mention)
    if kind in ("mailbox", "domain"):
        return surrogate.upper() if mention.isupper() else surrogate
    if kind == "secret":
        return "".join(x.upper() if c.isupper() else x for c, x in zip(mention, surrogate, strict=True))
    if kind == "ip":
        return surrogate
    if kind == "ip6":
        return surrogate.upper() if any(c.isupper() for c in mention) else surrogate
    cased = lambda like, x: x.upper() if len(mention) > 1 and mention.isupper() else x[:1].upper() + x[1:] if like[:1].isupper() or not like[:1].islower() else x
    return "".join(like if i % 2 else cased(like, x) for i, (like, x) in enumerate(zip(re.split(_JOIN, mention), re.split(_JOIN, surrogate), strict=True)))


def one_name(kind: Column) -> Column:
    """The type under which mentions meet their surrogates: given names of any gender are one."""
    return F.when(kind.startswith("given-"), "given").otherwise(kind)


def resolved(found: DataFrame) -> DataFrame:
    """The entities of found(kind, canon), each given name once, with the gender that most mentions tell."""
    given = F.col("kind").startswith("given-")
    told = lambda g: F.sum(F.when(F.col("kind") == f"given-{g}", 1).otherwise(0))
    people = found.where(given).groupBy("canon").agg(told("m").alias("m"), told("f").alias("f"))
    gender = F.when(F.col("m") + F.col("f") == 0, "n").when(F.col("m") > F.col("f"), "m").otherwise("f")
    return found.where(~given).select("kind", "canon").unionByName(people.select(F.concat(F.lit("given-"), gender).alias("kind"), "canon"))


def entities(docs: DataFrame) -> DataFrame:
    """(row, kind, canon), once for each entity that a text of docs(row, text) holds."""

    def found(batches):
        for b in batches:
            rows = []
            for row, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows += [(row, kind, canon) for kind, canon in dict.fromkeys((k, c) for _, _, k, c in find(text.as_py() or ""))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["row", "kind", "canon"])

    return arrow_map(docs.select("row", "text"), found, "row long, kind string, canon string")


def assign(found: DataFrame, key: bytes, drawer: Callable[[bytes, str, str, int], str] = draw) -> DataFrame:
    """(kind, canon, surrogate) for each distinct entity of found(kind, canon), without clashes.

    Names share one space of surrogates with real names of any part, other types one each. It draws
    until no clash is left. IPv4 addresses alone have a space that cannot grow: where the real ones
    leave less room than they need, that is an error.
    """
    real = staged(found.select("kind", "canon").distinct(), "entities")
    space = lambda c: F.when(F.col(c).startswith("given-") | (F.col(c) == "surname"), "name").otherwise(F.col(c))
    taken = real.select(space("kind").alias("space"), F.col("canon").alias("surrogate")).distinct()
    accepted, left = None, real
    for attempt in count():

        def drawn(batches, attempt=attempt):
            for b in batches:
                got = [drawer(key, k, c, attempt) for k, c in zip(b["kind"].to_pylist(), b["canon"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b["kind"], b["canon"], pa.array(got, pa.string())], ["kind", "canon", "surrogate"])

        tried = arrow_map(left, drawn, "kind string, canon string, surrogate string").withColumn("space", space("kind"))
        first = F.row_number().over(Window.partitionBy("space", "surrogate").orderBy("kind", "canon"))
        free = tried.join(taken, ["space", "surrogate"], "left_anti").withColumn("_n", first).where("_n = 1").select("kind", "canon", "surrogate", "space")
        free = staged(free, "surrogates")
        accepted = free if accepted is None else accepted.unionByName(free)
        left = staged(left.join(free, ["kind", "canon"], "left_anti"), "clashes")
        if left.isEmpty():
            return accepted.select("kind", "canon", "surrogate")
        taken = taken.unionByName(free.select("space", "surrogate"))
        if attempt == ROUNDS and real.where("kind = 'ip'").count() > 254**4 // 2:
            raise RuntimeError("more IPv4 addresses than surrogates for them")


def rewrite(text: str, surrogates: dict[tuple[str, str], str]) -> tuple[str, int]:
    out, at, n = [], 0, 0
    for begin, end, kind, canon in find(text):
        out += [text[at:begin], render(kind, text[begin:end], surrogates["given" if kind.startswith("given-") else kind, canon])]
        at, n = end, n + 1
    return "".join([*out, text[at:]]), n


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_replaced``."""
    if len(key) < 16:
        raise ValueError("the key must have 16 bytes at least")
    docs = docs.drop("n_replaced")
    held = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    # rows that agree in this hash share their surrogates, which is all the same to each
    row = F.xxhash64("doc_id", "text")
    found = staged(entities(docs.where(held).select(row.alias("row"), "text")), "mentions")
    table = assign(resolved(found), key).withColumn("kind", one_name(F.col("kind")))
    told = found.withColumn("kind", one_name(F.col("kind"))).distinct().join(table, ["kind", "canon"]).groupBy("row").agg(F.collect_set(F.struct("kind", "canon", "surrogate")).alias("_ql_told")).withColumnRenamed("row", "_ql_row")
    names = docs.columns

    def rewritten(batches):
        for b in batches:
            texts, counts = [], []
            for text, told in zip(b["text"], b["_ql_told"], strict=True):
                t, n = rewrite(text.as_py(), {(x["kind"], x["canon"]): x["surrogate"] for x in told.as_py() or ()})
                texts.append(t)
                counts.append(n)
            cols = [pa.array(texts, pa.string()) if c == "text" else b[c] for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], [*names, "n_replaced"])

    schema = StructType([*docs.schema.fields]).add("n_replaced", LongType())
    changed = docs.where(held).join(told, row == F.col("_ql_row"), "left").drop("_ql_row")
    return docs.where(~held).withColumn("n_replaced", F.lit(0).cast("long")).unionByName(arrow_map(changed, rewritten, schema))
