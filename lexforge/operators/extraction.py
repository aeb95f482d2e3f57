"""Facts from page text: registry metadata by the rules of each authority, and records of test reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import MONTHS, any_date

#: What shows a document's authority, in this order, in the text's capitals and in the file's name. Marks are whole words.
SOURCES = [
    ("UNECE", r"\bUNECE\b|\bE/ECE|\bWP\.29\b|\bUN\s+R\d+", r"UNECE|^R\d+"),
    ("Euro NCAP", r"\bEURO ?NCAP\b", r"NCAP"),
    ("FMVSS", r"\bFMVSS|\b49 CFR\b", r"FMVSS"),
    ("NHTSA", r"\bNHTSA\b|\bODI\b|\bRECALLS?\b", r"NHTSA"),
    ("IIHS", r"\bIIHS\b|\bHIGHWAY SAFETY\b", r"IIHS"),
]
#: Categories of Euro NCAP and kinds of IIHS tests by their words.
CATEGORIES = [(r"ADULT OCCUPANT|\bAOP\b", "Adult Occupant Protection"), (r"CHILD OCCUPANT|\bCOP\b", "Child Occupant Protection"), (r"VULNERABLE ROAD USERS|\bVRU\b|\bPEDESTRIANS?\b", "Vulnerable Road Users"), (r"SAFETY ASSIST|\bSAD\b", "Safety Assist")]
IIHS_TESTS = [(r"\bSIDE\b", "IIHS Side Impact"), (r"\bFRONT(?:AL)?\b", "IIHS Frontal Impact")]
#: Where fields stand in a text.
FIELDS = {
    "un_code": r"(?i)Regulation\s+No\.\s*(\d+)",
    "un_code_short": r"(?i)\bUN\s+R(\d+)\b",
    "series": r"(?i)(\d+)\s*series\s+of\s+amendments",
    "series_short": r"(?i)\b(0\d+)\s+series\b",
    "supplement": r"(?i)Supplement\s+(\d+)\s+to\s+the\s",
    "corrigendum": r"(?i)Corrigendum\s+(\d+)\b",
    "in_force": r"(?i)Date\s+of\s+entry\s+into\s+force:\s*([^\n\r]+)",
    "un_title": r"(?is)concerning the approval of(.*?)(?:uniform|agreement|regulation|issues|revision|\n{4,}|\z)",
    "year": r"\b(20\d{2})\b",
    "ncap_title": r"(?is)EURO\s+NCAP\s+(.*?)\s+(?:Protocol|Assessment|Methodology)",
    "fmvss": r"(?i)\bFMVSS\s+(\d+)\b",
    "cfr": r"(?i)49\s+CFR\s+(?:§\s*)?571\.(\d+)",
    "fmvss_title": r"(?i)Standard\s+No\.\s*\d+\s*[-—:\s]+(.*?)(?:\n|\z)",
    "odi": r"\b((?:PE|EA|RQ|DP)\d{2}-\d{3})\b",
    "recall": r"\b(\d{2}V-\d{3})\b",
    "issued": r"(?i)(?:date|opened|closed|issued):\s*([^\n\r]+)",
    "month_year": rf"(?i)\b((?:{'|'.join(MONTHS)})\s+\d{{4}})\b",
}
NO_TITLE = "Unknown Regulation Document"


def _choice(text: Column, rules: list[tuple[str, str]], other: Column | str | None) -> Column:
    out = other if isinstance(other, Column) else F.lit(other)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), value).otherwise(out)
    return out


def source_type(text: Column, file_name: Column) -> Column:
    """The authority that a text's own marks show first, else its file's name, else INTERNAL."""
    up, name = F.upper(text), F.upper(file_name)
    un = F.contains(up, F.lit("ADDENDUM")) & F.contains(up, F.lit("REGULATION NO."))
    by_name = _choice(name, [(p, s) for s, _, p in SOURCES], "INTERNAL")
    rules = [(p, s) for s, p, _ in SOURCES]
    return F.when(up.rlike(rules[0][0]) | un, rules[0][1]).otherwise(_choice(up, rules[1:], by_name))


def metadata(docs: DataFrame) -> DataFrame:
    """docs (text: of the first pages, file_name) with source_type, code, title, amendment, supplement, corrigendum, effective_date, publication_date and market.

    Each authority has its own rules; what they do not find is null, but for the code (UNKNOWN) and the title, for which the file's name
    stands in. A null text or name is empty. Names of columns that start with _ are reserved.
    """
    text, name = F.coalesce("text", F.lit("")), F.coalesce("file_name", F.lit(""))
    rows = docs.withColumn("_text", text).withColumn("_name", name).withColumn("source_type", source_type(text, name))
    # each field is looked for once, in a column of its own, however often the rules use it
    rows = rows.select("*", F.upper("_text").alias("_up"), *[F.nullif(F.regexp_extract("_text", p, 1), F.lit("")).alias(f"_{k}") for k, p in FIELDS.items()])
    rows = rows.withColumn("_protocol", F.coalesce("_year", F.nullif(F.regexp_extract("_name", FIELDS["year"], 1), F.lit("")), F.lit("2026"))).withColumn("_category", _choice(F.col("_up"), CATEGORIES, "General"))
    found = {k: F.col(f"_{k}") for k in FIELDS}
    up, source, year, category = (F.col(c) for c in ("_up", "source_type", "_protocol", "_category"))
    fmvss = F.concat(F.lit("FMVSS "), F.coalesce(found["fmvss"], found["cfr"]))
    odi, recall = found["odi"], found["recall"]

    def titled(prefix: str, title: Column) -> Column:
        return F.concat(F.lit(prefix), F.nullif(title, F.lit("")))

    def by(**parts: Column) -> Column:
        out = F.lit(None)
        for s, _, _ in SOURCES:
            if (key := s.split()[0].lower()) in parts:
                out = F.when(source == s, parts[key]).otherwise(out)
        return F.when(source == "INTERNAL", parts["internal"]).otherwise(out) if "internal" in parts else out

    code = by(
        unece=F.coalesce(F.concat(F.lit("R"), F.coalesce(found["un_code"], found["un_code_short"])), F.lit("UNKNOWN")),
        euro=F.concat(F.lit("Euro NCAP "), year, F.lit(" - "), category),
        fmvss=F.coalesce(fmvss, F.lit("UNKNOWN")),
        nhtsa=F.coalesce(F.concat(F.lit("NHTSA ODI "), F.left(odi, F.lit(2))), F.concat(F.lit("NHTSA Recall "), recall), F.lit("NHTSA Standard")),
        iihs=_choice(up, IIHS_TESTS, "IIHS Protocol"),
        internal=F.lit("INTERNAL"),
    )
    rows = rows.withColumn("code", code)
    collapsed = F.substring(F.trim(F.regexp_replace(found["un_title"], r"\s+", " ")), 1, 200)
    title = by(
        unece=titled("UN Regulation concerning: ", collapsed),
        euro=F.coalesce(F.concat(F.lit("Euro NCAP Protocol: "), F.regexp_replace(found["ncap_title"], r"^\s+|\s+$", "")), F.concat(F.lit("Euro NCAP "), category, F.lit(" Assessment Protocol"))),
        fmvss=F.coalesce(titled("FMVSS: ", F.regexp_replace(found["fmvss_title"], r"^\s+|\s+$", "")), F.concat(F.lit("Federal Motor Vehicle Safety Standard: "), F.col("code"))),
        nhtsa=F.coalesce(F.concat(F.lit("NHTSA Investigation: "), odi), F.concat(F.lit("NHTSA Recall Campaign: "), recall)),
        iihs=F.when(F.col("code") != "IIHS Protocol", F.concat("code", F.lit(" Test Procedure"))),
    )
    from_name = F.nullif(F.translate(F.regexp_replace("_name", r"\.[^.]*$", ""), "_-", "  "), F.lit(""))
    series = F.when(found["series"].isNotNull(), F.format_string("%02d Series", found["series"].cast("long"))).otherwise(F.concat(found["series_short"], F.lit(" Series")))
    # the one date that is to be read, as text
    written = by(unece=found["in_force"], euro=F.concat(year, F.lit("-01-01")), fmvss=F.lit("2024-01-01"), nhtsa=found["issued"], iihs=F.concat(F.lit("1 "), F.regexp_replace(found["month_year"], r"\s+", " ")), internal=F.concat(found["year"], F.lit("-01-01")))
    rows = rows.withColumn("_written", written).withColumn("effective_date", any_date(F.col("_written")))
    rows = rows.withColumn("title", F.coalesce(title, from_name, F.lit(NO_TITLE))).withColumn("amendment", by(unece=series, euro=F.concat(F.lit("Protocol Year "), year)))
    rows = rows.withColumn("supplement", by(unece=F.concat(F.lit("Supplement "), found["supplement"]))).withColumn("corrigendum", by(unece=F.concat(F.lit("Corrigendum "), found["corrigendum"])))
    rows = rows.withColumn("publication_date", by(unece=F.col("effective_date"), euro=F.to_date(F.concat((year.cast("int") - 1).cast("string"), F.lit("-11-01")))))
    market = F.when(source == "Euro NCAP", "EU").when(source.isin("FMVSS", "NHTSA", "IIHS"), "US").otherwise("GLOBAL")
    return rows.withColumn("market", market).drop("_text", "_name", "_up", "_protocol", "_category", "_written", *[f"_{k}" for k in FIELDS])


# ---------------------------------------------------------------- test reports

#: Labels of a test report.
REPORT = {
    "test_id": r"(?i)\b(TEST-\d{4}-\d{2,3}-\d{3})\b",
    "date": r"\b(20\d{2}-\d{2}-\d{2})\b",
    "program": r"(?i)Program:\s*([^\n\r]+)",
    "impact_mode": r"(?i)Impact\s*mode:\s*([A-Z_]+)",
    "dummy": r"(?i)Dummy:\s*([^\n\r]+)",
}
RESULT = r"(?i)\b(ThCC|HIC(?:36)?|TCFC)\b\s*[:|]?\s*(\d+(?:\.\d+)?)\s*(?:mm|g|kN)?"
NO_TEXT, NO_ID, NO_DATE, NO_RESULT, BAD_DATE = "no extractable text", "no test_id TEST-YYYY-XX-NNN", "no date YYYY-MM-DD", "no injury criterion rows (ThCC/HIC/TCFC)", "invalid date"


def read_reports(reports: DataFrame) -> DataFrame:
    """reports (report_id, text, linked_clause) with record and errors: a record with all its results, or null and every field that is missing.

    A record has test_id, program, date, test_type, impact_mode, dummy, confidential and results (position, criterion, value, linked_clause).
    An empty or null text has no other error; a date that is no day is one only where nothing is missing.
    """
    text = F.coalesce("text", F.lit(""))

    def label(name: str) -> Column:
        return F.nullif(F.regexp_extract("_t", REPORT[name], 1), F.lit(""))

    rows = reports.withColumn("_t", text)
    criterion = F.transform(F.regexp_extract_all("_t", F.lit(RESULT), F.lit(1)), lambda c: F.when(F.upper(c).startswith("HIC"), "HIC36").when(F.upper(c) == "THCC", "ThCC").otherwise(F.upper(c)))
    pairs = F.arrays_zip(criterion.alias("c"), F.regexp_extract_all("_t", F.lit(RESULT), F.lit(2)).alias("v"))
    results = F.transform(pairs, lambda r, i: F.struct((i + 1).alias("position"), r["c"].alias("criterion"), r["v"].cast("double").alias("value"), F.col("linked_clause")))
    rows = rows.withColumn("_results", results).withColumn("_id", F.upper(label("test_id"))).withColumn("_date", label("date"))
    missing = F.filter(F.array(F.when(F.col("_id").isNull(), NO_ID), F.when(F.col("_date").isNull(), NO_DATE), F.when(F.size("_results") == 0, NO_RESULT)), lambda e: e.isNotNull())
    valid = F.try_to_timestamp("_date", F.lit("yyyy-MM-dd")).isNotNull()
    none = F.array().cast("array<string>")
    errors = F.when(~F.col("_t").rlike(r"\S"), F.array(F.lit(NO_TEXT))).when(F.size(missing) > 0, missing).when(~valid, F.array(F.concat(F.lit(f"{BAD_DATE}: "), F.col("_date")))).otherwise(none)
    record = F.struct(
        F.col("_id").alias("test_id"), F.coalesce(F.trim(label("program")), F.lit("UPLOADED")).alias("program"), F.col("_date").alias("date"), F.lit("PHYSICAL_CRASH").alias("test_type"),
        F.coalesce(F.upper(label("impact_mode")), F.lit("FRONTAL_OFFSET")).alias("impact_mode"), F.trim(label("dummy")).alias("dummy"), F.lit(True).alias("confidential"), F.col("_results").alias("results"),
    )
    rows = rows.withColumn("errors", errors)
    return rows.withColumn("record", F.when(F.size("errors") == 0, record)).drop("_t", "_results", "_id", "_date")


def report_results(read: DataFrame) -> DataFrame:
    """The results of read_reports() as records.link_results() takes them: record_id, position, test_date, criterion, value, unit, link."""
    rows = read.where("record IS NOT NULL").select("report_id", "record", F.explode("record.results").alias("r"))
    return rows.select(F.col("report_id").alias("record_id"), "r.position", F.col("record.date").alias("test_date"), "r.criterion", "r.value", F.lit(None).cast("string").alias("unit"), F.col("r.linked_clause").alias("link"))


# ---------------------------------------------------------------- prompts within a budget

#: Passages and tokens of a context, words to tokens, and what stands where a text was cut.
MOST_PASSAGES, CONTEXT_TOKENS, TOKENS_A_WORD, CUT_MARK = 6, 3500, 1.33, "\n…[truncated for token budget]"
LEVELS = 6


def estimated_tokens(words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(words * TOKENS_A_WORD)).cast("int")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def level_budget(level: Column) -> Column:
    return F.when(level == 0, CONTEXT_TOKENS).otherwise(F.greatest(F.lit(300), F.floor(CONTEXT_TOKENS / (level + 1)))).cast("int")


def _kept(level: Column, passages: Column) -> Column:
    """Passages that a level leaves: it drops one more from the end each time, but never the first."""
    return F.greatest(F.lit(1), F.size(passages) - level).cast("int")


def _shrunk(level: Column, length: Column) -> Column:
    """Tokens that a passage of so many characters may have at a level; null where all of it may stay."""
    return F.when(level >= 2, F.floor(length * F.greatest(F.lit(0.35), 1 - 0.25 * (level - 1))).cast("int"))


def _cut_words(words: Column, most: Column) -> Column:
    """Words left, the mark's four included, of a text that may have so many tokens."""
    return F.when(most.isNull() | (estimated_tokens(words) <= most), words).otherwise(F.least(words, F.greatest(F.lit(1), F.floor(most / TOKENS_A_WORD).cast("int"))) + 4)


def _cut(text: Column, most: Column) -> Column:
    words = _words(text)
    return F.when(most.isNull() | (estimated_tokens(F.size(words)) <= most), text).otherwise(F.concat(F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(1), F.floor(most / TOKENS_A_WORD).cast("int"))), " "), F.lit(CUT_MARK)))


def compress_prompts(passages: DataFrame, limits: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(query_id, level, tokens, passages, context, fits): each question's passages at the least level of compression that fits its limit.

    passages: query_id, rank (from 1), text, of which the first MOST_PASSAGES count; limits: query_id, limit. Level 0 cuts the context to CONTEXT_TOKENS; each further one
    drops a passage from the end, from level 2 on shortens the others, and divides the budget. The tokens of every level come from word counts in one pass; only
    the chosen level's text is made. Where none fits, the last level stands and fits is false. Null texts are empty; of rows with one rank the smallest text comes first.
    """
    few = passages.where(F.col("rank") <= MOST_PASSAGES).groupBy("query_id", "rank").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    each = F.array_sort(F.collect_list(F.struct("rank", F.size(_words(F.col("text"))).alias("n"), F.char_length("text").alias("chars"), "text")))
    rows = few.groupBy("query_id").agg(each.alias("p")).join(limits, "query_id")

    def tokens(level: Column) -> Column:
        sizes = F.transform(F.slice("p", F.lit(1), _kept(level, F.col("p"))), lambda x: _cut_words(x["n"], _shrunk(level, x["chars"])))
        return estimated_tokens(_cut_words(F.aggregate(sizes, F.lit(0), lambda a, n: a + n), level_budget(level)))

    rows = rows.withColumn("by_level", F.transform(F.sequence(F.lit(0), F.lit(levels)), tokens))
    fitting = F.array_position(F.transform("by_level", lambda t: t <= F.col("limit")), F.lit(True)).cast("int")
    rows = rows.withColumn("fits", fitting > 0).withColumn("level", F.when(fitting > 0, fitting - 1).otherwise(levels))
    texts = F.transform(F.slice("p", F.lit(1), _kept(F.col("level"), F.col("p"))), lambda x: _cut(x["text"], _shrunk(F.col("level"), x["chars"])))
    context = _cut(F.array_join(texts, "\n\n"), level_budget(F.col("level")))
    return rows.select("query_id", "level", F.get("by_level", F.col("level")).alias("tokens"), _kept(F.col("level"), F.col("p")).alias("passages"), context.alias("context"), "fits")

