"""What a question asks for: filters it names, terms that help to find it, and measurements it holds against a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a question's capitals say of regulations, amendments and years.
UN_CODE = r"\b(?:UN[\s_-]?)?(R\d{2,3})\b"
SERIES = r"(\d{2})\s*SERIES"
NCAP_YEAR = r"\b(?:EURO\s+)?NCAP\s+(20\d{2})\b"
FMVSS = r"\bFMVSS\s+(\d{3})\b"
#: A paragraph that belongs to one regulation where no other is named.
LOCKING = r"(?i)(?:§|paragraph\s+)7\.6\.2\b|\b7\.6\.2\b.*(?:lock|retractor|decelerat)"
LOCKING_CODE = "UN_R16"
#: Terms added to a question about a regulation (a pattern for it in the question, its code) that has one of some words.
EXPANSIONS = [
    (r"(?i)\bR\s*94\b", "UN_R94", ("chest", "deflection", "thorax", "thcc", "compression"), "ThCC thorax compression criterion 42 mm 5.2.1.4"),
    (r"(?i)\bR\s*94\b", "UN_R94", ("injury", "criteria", "frontal", "impact", "dummy"), "5.2.1.3 5.2.1.4 5.2.1.8 neck bending moment ThCC viscous criterion FFC TCFC 8 kN tibia"),
    (None, None, (), "child restraint i-Size mass group height-based UN Regulation No. 44 UN Regulation No. 129"),
    (r"(?i)\bR\s*14\b", "UN_R14", ("isofix", "annex 6", "annex6", "anchorage"), "Annex 6 anchorage table Vehicle category M1 M2 N1 lower anchorages minimum number of anchorage"),
    (r"\b7\.6\.2\b", "UN_R16", ("lock", "retractor", "decelerat", "emergency"), "7.6.2 emergency locking retractor locking test deceleration-actuated sort of locking mechanism"),
]
#: Measurements in a question, and what makes it one about a margin.
MM_PAIR = r"(?is)(\d+(?:\.\d+)?)\s*mm\s+.*?\bvs\.?\b.*?(\d+(?:\.\d+)?)\s*mm"
MM = r"(?i)(\d+(?:\.\d+)?)\s*mm"
MARGIN = r"(?i)\b(?:margin|headroom|clearance|vs\.?|versus|against\s+(?:the\s+)?limit)\b"
CLOSE = r"(?i)(?:close\s+to\s+(?:its\s+)?limit|margin\s+tight|what\s+else\s+is\s+close)"
CRITERION = r"(?i)\b(thorax|thcc|chest|hic|femur|tibia)\b"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def filters(queries: DataFrame) -> DataFrame:
    """queries with codes (sorted array), amendment and source_type that the query names; a null query names nothing.

    One UN code stands for itself; several also set the source, and so do a year of Euro NCAP and an FMVSS number, the later of these over the
    earlier. A code said twice counts as several. A year of Euro NCAP is the amendment before any series. FMVSS codes stand beside UN ones.
    """
    q = F.upper(F.coalesce("query", F.lit("")))
    rows = queries.withColumn("_un", F.regexp_extract_all(q, F.lit(UN_CODE), F.lit(1))).withColumn("_fm", _found(q, FMVSS)).withColumn("_year", _found(q, NCAP_YEAR)).withColumn("_series", _found(q, SERIES))
    un = F.transform(F.array_distinct("_un"), lambda c: F.concat(F.lit("UN_"), c))
    codes = F.concat(un, F.when(F.col("_fm").isNotNull(), F.array(F.concat(F.lit("FMVSS "), F.col("_fm")))).otherwise(F.array().cast("array<string>")))
    alone = F.when((F.size(codes) == 0) & F.coalesce(F.col("query").rlike(LOCKING), F.lit(False)), F.array(F.lit(LOCKING_CODE))).otherwise(codes)
    source = F.when(F.col("_fm").isNotNull(), "FMVSS").when(F.col("_year").isNotNull(), "Euro NCAP").when(F.size("_un") > 1, "UNECE")
    amendment = F.coalesce(F.concat(F.lit("Protocol Year "), F.col("_year")), F.concat(F.col("_series"), F.lit(" Series")))
    return rows.withColumn("codes", F.array_sort(alone)).withColumn("amendment", amendment).withColumn("source_type", source).drop("_un", "_fm", "_year", "_series")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def expand(queries: DataFrame) -> DataFrame:
    """queries with expanded: the query, and the terms of all rules that hold for it, in their order. A null query stays null."""
    rows = filters(queries)
    low, codes = F.lower("query"), F.filter("codes", lambda c: F.startswith(c, F.lit("UN_")))
    several = (F.size(codes) >= 2) | (F.contains(low, F.lit("r44")) & F.contains(low, F.lit("r129")))
    added = []
    for pattern, code, words, terms in EXPANSIONS:
        # R94 counts among several codes, the others only where they are the one code
        own = several if code is None else (F.array_contains(codes, code) & ((F.size(codes) == 1) | F.lit(code == "UN_R94")) | F.col("query").rlike(pattern)) & _any(low, words)
        added.append(F.when(own, F.concat(F.lit(" "), F.lit(terms))).otherwise(""))
    return rows.withColumn("expanded", F.concat("query", *added)).select(*queries.columns, "expanded")


def margins(queries: DataFrame) -> DataFrame:
    """queries with is_margin, measured, limit_mm, criterion, code, margin and verdict: the two measurements that a question holds against each other.

    The pair around "vs" counts first, else the first two numbers of millimetres; with fewer than two all is null. A limit is a ceiling;
    without a criterion's word it is the thorax's.
    """
    numbers = F.regexp_extract_all("query", F.lit(MM), F.lit(1))
    rows = queries.withColumn("_n", F.coalesce(numbers, F.array().cast("array<string>")))
    two = F.size("_n") >= 2
    pair = [F.coalesce(_found(F.col("query"), MM_PAIR, i + 1), F.get("_n", F.lit(i))) for i in range(2)]
    word = F.lower(_found(F.col("query"), CRITERION))
    criterion = F.when(word.isNull() | word.isin("thorax", "thcc", "chest"), "ThCC").otherwise(F.upper(word))
    rows = rows.withColumn("is_margin", F.coalesce(two & (F.col("query").rlike(MARGIN) | F.col("query").rlike(CLOSE)), F.lit(False)))
    rows = rows.withColumn("measured", F.when(two, pair[0].cast("double"))).withColumn("limit_mm", F.when(two, pair[1].cast("double"))).withColumn("criterion", F.when(two, criterion))
    rows = rows.withColumn("code", F.when(two, F.concat(F.lit("UN_"), F.upper(_found(F.col("query"), "(?i)" + UN_CODE)))))
    rows = rows.withColumn("margin", F.round(F.col("limit_mm") - F.col("measured"), 4)).withColumn("verdict", F.when(two, F.when(F.col("measured") <= F.col("limit_mm"), "PASS").otherwise("FAIL")))
    return rows.drop("_n")
