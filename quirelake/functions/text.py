"""String expressions: cleaning, folding, tokens and phrases, scripts, subject display."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..shared import workers_import

#: Python's ``\s``, ``\w`` and ``\d`` cover Unicode; Java's do with this flag.
UNICODE = "(?U)"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc_json(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: json.dumps([x if x is None else unicodedata.normalize("NFKC", x) for x in json.loads(xs)], ensure_ascii=False), na_action="ignore")


def bound(c: Column, body) -> Column:
    """``body`` of a value that is computed once for a row, however often the body names it."""
    return F.transform(F.array(c), body)[0]


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def nfkc(c: Column, exact: bool = True) -> Column:
    """Unicode compatibility composition, which ASCII values do not need: Python sees nulls for these.

    ``exact=False`` keeps the expression inside the JVM.
    """
    if not exact:
        return c
    workers_import()
    return F.when(is_ascii(c), c).otherwise(_nfkc(F.when(~is_ascii(c), c)))


#: Latin, Greek, Cyrillic and Hebrew letters and punctuation that compatibility composition leaves as they are, alone and side by side.
SETTLED = [chr(i) for a, b in ((0, 0x300), (0x370, 0x483), (0x48A, 0x530), (0x5D0, 0x5F5), (0x2010, 0x2028)) for i in range(a, b) if unicodedata.category(chr(i)) != "Cn" and unicodedata.normalize("NFKC", chr(i)) == chr(i)]
_ENDS = [(a, b) for a, b in zip(["", *SETTLED], [*SETTLED, ""]) if not a or not b or ord(b) - ord(a) > 1]
_UNSETTLED = "[^" + "".join(rf"\x{{{ord(b):x}}}-\x{{{ord(a):x}}}" for (_, b), (a, _) in zip(_ENDS, _ENDS[1:])) + "]"


def nfkc_all(c: Column, exact: bool = True) -> Column:
    """``nfkc`` of every string of an array; Python sees nulls for arrays whose characters are all settled.

    Arrays go there as JSON: the size of a batch with list columns is counted anew for every row of it.
    """
    if not exact:
        return c
    workers_import()
    return F.coalesce(F.from_json(_nfkc_json(F.when(F.exists(c, lambda x: ~is_ascii(x) & x.rlike(_UNSETTLED)), F.to_json(c))), "array<string>"), c)


def _base(c: str) -> str:
    """The letter that is left of a character without its marks; a final sigma is a sigma."""
    plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
    return "σ" if plain == "ς" else plain


#: Every lower-case or caseless letter that is one letter with marks, and that letter, by Unicode.
_LETTERS = [(chr(i), _base(chr(i))) for i in (*range(0x80, 0x2000), *range(0xFB1D, 0xFB50)) if unicodedata.category(chr(i)) in ("Ll", "Lo") and not 0xD800 <= i < 0xE000]
MARKED, PLAIN = ("".join(x) for x in zip(*[(c, b) for c, b in _LETTERS if c != b and len(b) == 1], strict=True))


def fold(c: Column) -> Column:
    """Lower case without marks, whether they are parts of letters or follow them; in the JVM."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}+", ""), MARKED, PLAIN)


def fold_text(text: str) -> str:
    """``fold`` of one string."""
    bare = "".join(x for x in text.lower() if unicodedata.category(x) != "Mn")
    return bare.translate(str.maketrans(MARKED, PLAIN))


def tokens(c: Column) -> Column:
    """The text's tokens, folded, each after a blank and with one at the end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def fold_literal(text: str) -> str:
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" or c == "*" else " " for c in fold_text(text)).split())


def terms(query: str) -> list[str]:
    """The terms of a query, folded."""
    return [t for t in fold_literal(query).split() if t.strip("*")]


def matches(c: Column, query: str, phrase: bool = True) -> Column:
    """Full-text match of one text: an ordered phrase, or all terms; a last ``*`` matches a prefix."""
    sought = terms(query)
    text = tokens(c)
    if not sought:
        return F.lit(False)
    if phrase or len(sought) == 1:
        return _run(text, " ".join(sought))
    found = F.lit(True)
    for t in sought:
        found = found & _run(text, t)
    return found


def _run(text: Column, run: str) -> Column:
    return text.contains(f" {run.rstrip('*')}") if run.endswith("*") else text.contains(f" {run.replace('*', ' ').strip()} ")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, UNICODE + r"\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, UNICODE + r"^\s+|\s+$", "")


def unbracket(c: Column) -> Column:
    """Without brackets that wrap the whole value."""
    return bound(c, lambda v: F.when(v.startswith("[") & v.endswith("]") & (F.length(v) >= 2), strip(F.substring(v, F.lit(2), F.length(v) - 2))).otherwise(v))


def shorten(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


HEBREW, ARABIC = r"\x{0590}-\x{05FF}", r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}"


def script(c: Column) -> Column:
    """The script of most letters: hebrew, arabic or latin; ties go to the script that is not Latin.

    Letters are only counted where there is one that is not Latin.
    """
    other = rf"[{HEBREW}{ARABIC}]"
    h, a = F.regexp_count(c, F.lit(f"[{HEBREW}]")), F.regexp_count(c, F.lit(f"[{ARABIC}]"))
    n = F.length(F.regexp_replace(c, rf"[^\p{{L}}]|{other}", ""))
    return (
        F.when(c.isNull(), "empty").when(~F.regexp_like(c, F.lit(other)), F.when(F.regexp_like(c, F.lit(r"\p{L}")), "latin").otherwise("empty"))
        .when((h > a) & (h > n), "hebrew").when((a > h) & (a > n), "arabic").when((n > h) & (n > a), "latin")
        .when((h > 0) & (h >= a), "hebrew").when(a > 0, "arabic").otherwise("latin")
    )


def tidy_subject(c: Column) -> Column:
    """A heading for display: no final stop, dashes between its parts."""
    return F.replace(F.replace(F.rtrim(c, F.lit(". ")), F.lit(" -- "), F.lit(" — ")), F.lit(". — "), F.lit(" — "))


def subject_root(c: Column) -> Column:
    return F.substring_index(tidy_subject(c), " — ", 1)


def city(c: Column) -> Column:
    """The place that a location begins with."""
    return F.lower(F.trim(F.get(F.split(c, "[,/]"), F.lit(0))))


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first, also after apostrophes and digits."""
    letters = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(letters, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000))), "")


def reorder_name(c: Column) -> Column:
    """``Surname, Given`` for ``Given Surname`` and the other way about; null where there is neither."""
    comma = F.regexp_extract(c, r"^\s*([^,]+?)\s*,\s*([^,]+?)\s*$", 0) != ""
    words = F.split(collapse(c), " ")
    return F.when(comma, F.concat_ws(" ", F.regexp_extract(c, r"^\s*([^,]+?)\s*,\s*([^,]+?)\s*$", 2), F.regexp_extract(c, r"^\s*([^,]+?)\s*,\s*([^,]+?)\s*$", 1))).when(~c.contains(",") & (F.size(words) > 1), F.concat(F.element_at(words, -1), F.lit(", "), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")))


def comparable(c: Column, exact: bool = True) -> Column:
    """A name without case and punctuation, composed, as names are compared."""
    return collapse(F.regexp_replace(F.lower(nfkc(c, exact)), UNICODE + r"[^\w\s]", " "))


def in_order(c: Column, exact: bool = True) -> Column:
    """A comparable name with what stands before its first comma at the end."""
    at = F.instr(c, ",")
    last, first = comparable(F.substring(c, F.lit(1), at - 1), exact), comparable(F.substring(c, at + 1, F.length(c)), exact)
    turned = F.when((first != "") & (last != ""), F.concat_ws(" ", first, last)).otherwise(F.concat(last, first))
    return F.when(at > 0, turned).otherwise(comparable(c, exact))


def names_match(a: Column, b: Column, exact: bool = True) -> Column:
    """Whether two names are one, as they stand or with the surname moved to the end."""
    x, y, u, v = comparable(a, exact), comparable(b, exact), in_order(a, exact), in_order(b, exact)
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, False).otherwise((x == y) | (u == v) | (x == v) | (u == y))


def name_forms(c: Column) -> Column:
    """The forms that a title is sought in: as it is, and a name of two or three words with its last or first word in front."""
    t = strip(c)
    w = F.split(t, UNICODE + r"\s+")
    two = F.concat(F.get(w, F.lit(1)), F.lit(", "), w[0])
    three = F.concat(F.get(w, F.lit(2)), F.lit(", "), w[0], F.lit(" "), F.get(w, F.lit(1)))
    turned = F.concat(w[0], F.lit(", "), F.get(w, F.lit(1)), F.lit(" "), F.get(w, F.lit(2)))
    return F.when(F.size(w) == 2, F.array(t, two)).when(F.size(w) == 3, F.array(t, three, turned)).otherwise(F.array(t))


def record_url(base: str, c: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(c))


def century_label(y: Column, spoken: bool = False) -> Column:
    """``16th century`` for a year; ``spoken`` also writes 21st, else every later one gets ``th``."""
    n = F.floor((y - 1) / 100).cast("int") + 1
    suffix = F.when(n == 1, "st").when(n == 2, "nd").when(n == 3, "rd")
    if spoken:
        suffix = suffix.when(n == 21, "st").when(n == 22, "nd").when(n == 23, "rd")
    return F.concat(n.cast("string"), suffix.otherwise("th"), F.lit(" century"))


def decade(y: Column) -> Column:
    return (F.floor(y / 10) * 10).cast("int")


def decade_label(y: Column) -> Column:
    return F.concat(decade(y).cast("string"), F.lit("s"))
