"""Column functions on text: tokens, normal forms, chunk headers, dates, codes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def long_terms(c: Column, longer_than: int = 2) -> Column:
    """Lower-cased white-space tokens of more than so many characters, repeats kept."""
    return F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda t: F.char_length(t) > longer_than)


def bare_words(c: Column) -> Column:
    """Distinct lower-cased words once punctuation has become white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, r"[^A-Za-z0-9\s]", " ")), r"\s+"), lambda t: t != ""))


def substring_hits(low: Column, terms: Column) -> Column:
    """How many of the terms occur anywhere in a text that is in lower case already; a repeated term counts each time."""
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


@F.pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFKC; Spark has no function for it, so it runs on Arrow batches."""
    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: ASCII, and signs that NFKC leaves as they are whatever stands beside them: Latin letters and common punctuation, none of which is a mark on another sign.
ASCII = r"^\p{ASCII}*\z"
PLAIN = r"^[\x00-\x9F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-ıĴ-ľŁ-ňŊ-ž–—‘-‚“-„•€]*+\z"


def content_hash(c: Column, normalise: bool = True) -> Column:
    """SHA-256 of the text in NFKC, lower case and single spaces. Texts of PLAIN's signs are their own normal form: Python sees a null in their place."""
    plain = c.rlike(ASCII) | c.rlike(PLAIN)
    form = F.when(plain, c).otherwise(nfkc(F.when(~plain, c))) if normalise else c
    return F.sha2(F.trim(F.regexp_replace(F.lower(form), r"(?U)\s+", " ")), 256)


def window_starts(text: Column, size: int, overlap: int, stop_at_end: bool) -> Column:
    """Starts (from 0) of windows over a text. With stop_at_end no window lies wholly inside the one before."""
    n, step = F.char_length(text), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step) * step) if stop_at_end else n - 1
    return F.when(n > 0, F.sequence(F.lit(0), last.cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))


def header(source: Column, code: Column, amendment: Column, document: Column, page: Column, section: Column, kind: Column | None = None) -> Column:
    """The line that a chunk begins with; chunks of the structured chunker also say their type."""
    parts = [F.lit("[Source: "), source, F.lit(" | Reg: "), code, F.lit(" | Amendment: "), amendment, F.lit(" | Doc: "), document, F.lit(" | Page: "), page.cast("string"), F.lit(" | Section: "), section]
    return F.concat(*parts, *([F.lit(" | Type: "), kind] if kind is not None else []), F.lit("]"))


#: A header with a type.
HEADER = r"\[Source:\s*([^|]+)\|\s*Reg:\s*([^|]+)\|\s*Amendment:\s*([^|]+)\|\s*Doc:\s*([^|]+)\|\s*Page:\s*([^|]+)\|\s*Section:\s*([^|]+)\|\s*Type:\s*([^\]]+)\]"


def fingerprint(context: Column) -> Column:
    """What tells a retrieved chunk apart from others: code, document, section, type and page of its header with a digest of its body's first 400 signs;
    without such a header, a digest of the first 200. A null is an empty one."""
    text = F.coalesce(context, F.lit(""))

    def field(i: int) -> Column:
        return F.trim(F.regexp_extract(text, HEADER, i))

    body = F.regexp_replace(F.regexp_replace(text, r"(?s)^[^\]]*\]", ""), r"^\s+|\s+$", "")
    mark = F.substring(F.md5(F.substring(body, 1, 400).cast("binary")), 1, 10)
    named = F.concat_ws("|", field(2), field(4), field(6), field(7), F.concat(F.lit("p"), field(5)), mark)
    return F.when(text.rlike(HEADER), named).otherwise(F.substring(F.md5(F.substring(text, 1, 200).cast("binary")), 1, 12))


def header_field(chunk: Column, name: str) -> Column:
    """A field of a chunk's header, null where it is absent."""
    return F.nullif(F.regexp_extract(chunk, name + r": ([^|\]]*?) ?[|\]]", 1), F.lit(""))


#: Month names by number.
MONTHS = "january february march april may june july august september october november december".split()


def month_number(name: Column) -> Column:
    """1..12; an unknown word counts as January."""
    low, out = F.lower(name), F.lit(1)
    for i, m in enumerate(MONTHS, 1):
        out = F.when(low == m, i).otherwise(out)
    return out


def any_date(c: Column) -> Column:
    """A date that begins as yyyy-mm-dd or dd.mm.yyyy, has d Month yyyy or Month d, yyyy in it, or is a year and nothing else (its first day); null if none is a day."""

    def build(col: Column) -> Column:
        def g(pattern: str, i: int) -> Column:
            return F.nullif(F.regexp_extract(col, pattern, i), F.lit(""))

        iso, dots = r"^\s*(\d{4})-(\d{2})-(\d{2})", r"^\s*(\d{1,2})\.(\d{1,2})\.(\d{4})"
        day_first, month_first, year = r"(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})", r"([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})", r"^\s*(\d{4})\s*$"

        def made(y: Column, m: Column, d: Column) -> Column:
            text = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0"))
            return F.when(y.isNotNull(), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))

        return F.coalesce(
            made(g(iso, 1), g(iso, 2), g(iso, 3)),
            made(g(dots, 3), g(dots, 2), g(dots, 1)),
            made(g(day_first, 3), month_number(g(day_first, 2)), g(day_first, 1)),
            made(g(month_first, 3), month_number(g(month_first, 1)), g(month_first, 2)),
            made(g(year, 1), F.lit("01"), F.lit("01")),
        )

    return build(c)


def regulation_code(c: Column, keep_zeros: bool = True) -> Column:
    """UN_R94 from r94, UN R 94, UN_R094, un-r94; other values are upper-cased with underscores."""
    up = F.regexp_replace(F.upper(F.trim(c)), r"[\s-]+", "_")
    number = F.nullif(F.regexp_extract(up, r"^(?:UN_?|ECE_?)?R_?(\d+)$", 1), F.lit(""))
    if not keep_zeros:
        number = number.cast("int").cast("string")
    return F.coalesce(F.concat(F.lit("UN_R"), number), up)
