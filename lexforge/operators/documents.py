"""Chunking, clause and section structure, versions, gates and coverage of regulation documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import content_hash, window_starts

# ---------------------------------------------------------------- chunks


def flat_chunks(pages: DataFrame, size: int = 1000, overlap: int = 200, stop_at_end: bool = False) -> DataFrame:
    """(doc_id, chunk_index, chunk_text): windows over each text. The flat form keeps short tails, the oversize form stops at the end."""
    at = F.posexplode(window_starts(F.col("text"), size, overlap, stop_at_end))
    return pages.select("doc_id", "text", at.alias("chunk_index", "start")).select("doc_id", "chunk_index", F.expr(f"substring(text, start + 1, {size})").alias("chunk_text"))


CLAUSE = r"^\s*(\d+(?:\.\d+)+)\.?(?:\s+(.*))?$"


def clause_blocks(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, line) -> (doc_id, block, clause, n_lines, body): a running count of clause lines is the block."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    number = F.nullif(F.regexp_extract("line", CLAUSE, 1), F.lit(""))
    rows = lines.withColumn("number", number).withColumn("block", F.count("number").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.when(F.col("number").isNotNull(), F.regexp_extract("line", CLAUSE, 2)).otherwise(F.col("line"))
    rows = rows.withColumn("part", F.nullif(F.trim(body), F.lit("")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("line_no", "part")))), lambda x: x["part"]), " ")
    return rows.groupBy("doc_id", "block").agg(F.max("number").alias("clause"), F.count("*").alias("n_lines"), text.alias("body"))


#: Headings, the numbers that they may say, and what stands before the first one.
HEADING = r"^#{1,6}\s+(.+?)\s*$"
SECTION_NUMBER = r"(?i)\b((?:\d+\.)+\d+|\d+|Annex\s+\d+|Appendix\s+[A-Z\d]+|Article\s+\d+)\b"
GENERAL, GENERAL_TITLE = "General", "General Context"


def markdown_sections(lines: DataFrame) -> DataFrame:
    """(doc_id, section, title, text): the sections of lines (doc_id, line_no, line), one for each number that a heading says.

    A heading's number is taken out of its title. Text before the first heading and under headings without a number is General. Sections without text
    are left out; those of one number are joined by a blank line, in order, under the first one's title. Null lines are empty.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    line = F.coalesce("line", F.lit(""))
    head = F.nullif(F.trim(F.regexp_extract(line, HEADING, 1)), F.lit(""))
    rows = lines.select("doc_id", "line_no", line.alias("line")).withColumn("head", head).withColumn("nth", F.count("head").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    parts = rows.groupBy("doc_id", "nth").agg(F.max("head").alias("head"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text")).where("text != ''")
    number = F.nullif(F.regexp_extract("head", SECTION_NUMBER, 1), F.lit(""))
    bare = F.nullif(F.regexp_replace(F.replace("head", F.col("number"), F.lit("")), r"^[.:\- ]+|[.:\- ]+$", ""), F.lit(""))
    title = F.when(F.col("head").isNull(), GENERAL_TITLE).when(F.col("number").isNull(), F.col("head")).otherwise(F.coalesce(bare, F.concat(F.lit("Section "), F.col("number"))))
    parts = parts.withColumn("number", number).withColumn("title", title).withColumn("section", F.coalesce("number", F.lit(GENERAL)))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "\n\n")
    return parts.groupBy("doc_id", "section").agg(F.min_by("title", "nth").alias("title"), whole.alias("text"))


def table_islands(lines: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, table_no, n_rows, header, summary): runs of pipe rows of at least so many lines."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    pipe = F.trim("line").rlike(r"^\|.+\|$")
    rows = lines.withColumn("pipe", pipe).withColumn("island", F.col("line_no") - F.sum(F.col("pipe").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tables = rows.where("pipe").groupBy("doc_id", "island").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_rows"), F.min_by("line", "line_no").alias("header")).where(F.col("n_rows") >= least)
    cells = F.transform(F.slice(F.split(F.regexp_replace(F.trim("header"), r"^\||\|$", ""), r"\|"), 1, 4), lambda c: F.trim(c))
    return tables.withColumn("table_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line"))).select("doc_id", "table_no", "first_line", "n_rows", F.array_join(cells, ", ").alias("summary"))


def pipe_table(cells: Column) -> Column:
    """array<array<string>> as a pipe table: first row is the header, rows are cut or padded to its width."""
    width = F.size(F.element_at(cells, 1))

    def row(r: Column) -> Column:
        full = F.slice(F.concat(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), width)), 1, width)
        return F.concat(F.lit("| "), F.array_join(F.transform(full, lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))

    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    return F.array_join(F.concat(F.array(row(F.element_at(cells, 1)), rule), F.transform(F.slice(cells, 2, F.size(cells)), row)), "\n")


def incremental_plan(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """chunks with their content hash and whether a stored vector (content_hash, embedding) can be used again."""
    once = stored.groupBy("content_hash").agg(F.first("embedding").alias("embedding"))
    return chunks.withColumn("content_hash", content_hash(F.col("chunk_text"))).join(once, "content_hash", "left").withColumn("reused", F.col("embedding").isNotNull())


# ---------------------------------------------------------------- versions


def register_versions(incoming: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """incoming with outcome NEW, NO_CHANGE or SUPERSEDED_UPDATED: null-safe match on keys, then the file hash decides."""
    a = active.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("file_hash").alias("_hash"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    outcome = F.when(F.col("_hash").isNull(), "NEW").when(F.col("_hash") == F.col("file_hash"), "NO_CHANGE").otherwise("SUPERSEDED_UPDATED")
    return incoming.join(a, same, "left").withColumn("outcome", outcome).drop("_hash", *[f"_{k}" for k in keys])


def classify_changes(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """items (source_url, text_hash) with change NEW, DUPLICATE or CHANGED against the manifest."""
    m = manifest.select("source_url", F.col("text_hash").alias("_old"))
    change = F.when(F.col("_old").isNull(), "NEW").when(F.col("_old") == F.col("text_hash"), "DUPLICATE").otherwise("CHANGED")
    return items.join(m, "source_url", "left").withColumn("change", change).drop("_old")


def remote_changed(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """First of etag (quotes stripped), last_modified and content_length that both sides have decides; none: changed."""
    out = F.lit(True)
    for name in ("content_length", "last_modified", "etag"):
        a, b = old[name], new[name]
        if name == "etag":
            a, b = F.regexp_replace(a, '"', ""), F.regexp_replace(b, '"', "")
        out = F.when(a.isNotNull() & b.isNotNull(), a != b).otherwise(out)
    return out


#: Order of document roles in an overlay.
ROLES = {"base": 0, "amendment": 1, "supplement": 2, "corrigendum": 3, "bulletin": 4}


def role_priority(role: Column) -> Column:
    out = F.lit(99)
    for name, p in ROLES.items():
        out = F.when(role == name, p).otherwise(out)
    return out


def consolidate(sections: DataFrame) -> DataFrame:
    """(code, section, title, text, provenance) of sections (code, document, role, version, section, title, text).

    Documents overlay each other by (role priority, version); the last text wins, the first title stays,
    the chain of documents begins again at the last base document.
    """
    order = F.struct(role_priority(F.col("role")).alias("p"), F.col("version").alias("v"), F.col("document").alias("d"))
    rows = sections.withColumn("o", order)
    base = F.max(F.when(F.col("role") == "base", F.col("o"))).over(Window.partitionBy("code", "section"))
    rows = rows.withColumn("b", base).where(F.col("b").isNull() | (F.col("o") >= F.col("b")))
    chain = F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda x: x["d"]), " > ")
    return rows.groupBy("code", "section").agg(F.min_by("title", "o").alias("title"), F.max_by("text", "o").alias("text"), chain.alias("provenance"))


def supersedes(documents: DataFrame) -> DataFrame:
    """documents (code, series, document) with the closest older series of the same code."""
    w = Window.partitionBy("code").orderBy("series", "document")
    return documents.withColumn("supersedes", F.lag("document").over(w))


#: What a role's files are called, first match wins.
ROLE_MARKS = [("amendment", "amend"), ("supplement", "supp"), ("corrigendum", "corr"), ("bulletin", "tb_|_tb|technical_bulletin")]
#: Families of files without a UN number by their mark, their members by theirs (first match wins), and the family's own name.
FILE_FAMILIES = [
    ("euroncap", [("_aop", "Euro NCAP AOP"), ("_cop", "Euro NCAP COP"), ("_vru", "Euro NCAP VRU"), ("_sa_|_sa$", "Euro NCAP Safety Assist"), ("_side", "Euro NCAP Side"), ("_farside", "Euro NCAP Far-Side"), ("_rescue", "Euro NCAP Rescue"), ("_postcrash", "Euro NCAP Post-Crash"), ("_overall", "Euro NCAP Overall Assessment"), ("_scoring", "Euro NCAP Scoring"), ("_generalguidance", "Euro NCAP General Guidance"), ("tb_thor", "Euro NCAP THOR Dummy"), ("tb_aemdb", "Euro NCAP AE-MDB"), ("tb_farside", "Euro NCAP Far-Side Bulletin")], "Euro NCAP"),
    ("eu_|_gsr|_wvta", [("2019_2144|gsr2|gsr_amendment", "EU GSR2"), ("2018_858|wvta", "EU WVTA")], "EU Regulation"),
    ("iihs", [("moderateoverlap", "IIHS Moderate Overlap"), ("smalloverlap", "IIHS Small Overlap"), ("sidebarrier", "IIHS Side Barrier"), ("roofstrength", "IIHS Roof Strength"), ("headrestraints", "IIHS Head Restraints")], "IIHS Protocol"),
    ("nhtsa_ncap", [("frontal", "NHTSA NCAP Frontal"), ("pole", "NHTSA NCAP Pole"), ("side", "NHTSA NCAP Side")], "NHTSA NCAP"),
    ("cncap", [], "C-NCAP 2024"),
]
#: Where the numbers of a file name stand.
FILE_NUMBERS = {"series": [r"(\d+)[ _]*series", r"am(\d+)"], "revision": [r"\brev(?:ision)?\.?\s*(\d+)\b", r"rev(\d+)"], "supplement": [r"\bsupp(?:lement)?\.?\s*(\d+)\b", r"supp(\d+)"], "corrigendum": [r"\bcorr(?:igendum)?\.?\s*(\d+)\b", r"corr(\d+)"]}
UN_NUMBER = [r"\bun_r(\d+)", r"\br(\d+)"]


def parse_filename(name: Column) -> dict[str, Column]:
    """role, whether the file is a whole regulation, code and the four numbers of a file name."""

    def parsed(stem: Column) -> Column:
        def first(patterns: list[str]) -> Column:
            return F.coalesce(*[F.nullif(F.regexp_extract(stem, p, 1), F.lit("")) for p in patterns])

        role = F.lit("base")
        for r, mark in reversed(ROLE_MARKS):
            role = F.when(stem.rlike(mark), r).otherwise(role)
        code = F.lit("UNKNOWN")
        for mark, members, own in reversed(FILE_FAMILIES):
            member = F.lit(own)
            for m, n in reversed(members):
                member = F.when(stem.rlike(m), n).otherwise(member)
            code = F.when(stem.rlike(mark), member).otherwise(code)
        fmvss = F.concat(F.lit("FMVSS"), F.regexp_replace(F.regexp_extract(stem, r"fmvss_(\d+)", 1), r"^(?=\d)", " "))
        code = F.coalesce(F.concat(F.lit("UN_R"), first(UN_NUMBER)), F.when(F.contains(stem, F.lit("fmvss")), fmvss), code)
        return F.struct(role.alias("role"), (role == "base").alias("complete"), code.alias("code"), *[first(v).cast("int").alias(k) for k, v in FILE_NUMBERS.items()])

    # a lambda's variable is computed once, however often the patterns use it
    out = F.get(F.transform(F.array(F.regexp_replace(F.lower(name), r"\.[^.]*$", "")), parsed), F.lit(0))
    return {k: out[k] for k in ("role", "complete", "code", *FILE_NUMBERS)}


# ---------------------------------------------------------------- gates


def allowed_url(urls: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """urls with allowed: https, and the host is a listed domain or a sub-domain of one.

    The host's endings are joined to the list, so neither side is compared with all of the other.
    """
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select(host.alias("host")).where("host is not null").distinct().withColumn("domain", F.explode(endings))
    good = hosts.join(domains.select("domain"), "domain").select(F.col("host").alias("_host")).distinct().withColumn("_listed", F.lit(True))
    rows = urls.withColumn("host", host).join(good, F.col("host") == F.col("_host"), "left")
    secure = F.lower(F.try_parse_url(F.col(url), F.lit("PROTOCOL"))) == "https"
    return rows.withColumn("allowed", F.coalesce(secure & F.col("_listed"), F.lit(False))).drop("_host", "_listed")


#: What the first bytes of a file that only stands for a document say, and how such files must begin.
PLACEHOLDERS = ("git-lfs.github.com", "<html", "<!doctype", "placeholder", "lorem ipsum")
MAGIC = "%PDF-"


def names_regulation(text: Column, code: Column) -> Column:
    """Whether a text names a regulation, as a word: R94, UN R94, UN_R94, Regulation No. 94; other ids as they are, with or without spaces. No id is always named."""
    up, rid = F.upper(text), F.upper(F.trim(F.coalesce(code, F.lit(""))))
    number = F.regexp_extract(rid, r"^(?:UN[ _]?)?R0*(\d+)$", 1)
    un = F.concat(F.lit(r"\b(?:UN[ _]?)?R[ _]?0*"), number, F.lit(r"\b|\bREGULATION NO\.? ?0*"), number, F.lit(r"\b"))
    plain = F.concat_ws("|", *[F.concat(F.lit(r"(?<!\w)\Q"), x, F.lit(r"\E(?!\w)")) for x in (rid, F.replace(rid, F.lit(" "), F.lit("")))])
    return (rid == "") | F.regexp_like(up, F.when(number != "", un).otherwise(plain))


def validate(text: Column, n_bytes: Column, pages: Column, code: Column, head: Column | None = None) -> Column:
    """outcome: the first check that fails, in a fixed order, else ACCEPTED. head: the file's first 512 bytes as text, where they are known."""
    ink = F.char_length(F.regexp_replace(text, r"\s", ""))
    out = F.when(text.isNull(), "REJECTED: unreadable")
    if head is not None:
        stands = F.lit(False)
        for p in PLACEHOLDERS:
            stands = stands | F.contains(F.lower(head), F.lit(p))
        out = F.when(~F.coalesce(F.startswith(head, F.lit(MAGIC)), F.lit(False)), "REJECTED: not %PDF-").when(stands, "REJECTED: placeholder")
        out = out.when(n_bytes < 2048, "REJECTED: too small").when(n_bytes > 80 * 1024 * 1024, "REJECTED: too large").when(text.isNull(), "REJECTED: unreadable")
    return (
        out.when(n_bytes < 2048, "REJECTED: too small")
        .when(n_bytes > 80 * 1024 * 1024, "REJECTED: too large")
        .when(pages < 1, "REJECTED: no pages")
        .when(ink < 50, "REJECTED: no text")
        .when(ink / pages < 80, "NEEDS_OCR: thin text")
        .when(~names_regulation(text, code), "REJECTED: regulation not named")
        .otherwise("ACCEPTED")
    )


def coverage(expected: DataFrame, present: DataFrame) -> DataFrame:
    """One row per authority: expected, found, active, rates (3 places, 1.0 when nothing is expected) and what is missing."""
    have = present.groupBy("code").agg(F.max((F.col("status") == "ACTIVE").cast("int")).alias("active"))
    rows = expected.join(have, "code", "left")
    n, found, active = F.count("*"), F.count("active"), F.coalesce(F.sum("active"), F.lit(0))
    missing = F.array_join(F.array_sort(F.collect_list(F.when(F.col("active").isNull(), F.col("code")))), ",")
    return rows.groupBy("authority").agg(n.alias("expected"), found.alias("found"), active.alias("active"), F.round(found / n, 3).alias("coverage"), F.round(active / n, 3).alias("active_rate"), missing.alias("missing"))

