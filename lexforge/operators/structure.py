"""Structure of page text: blocks, clauses, tables and the chunks made of them, and stand-in vectors.

A document's lines come together in one shuffle by doc_id, in as many tasks as the pages need, so that their lines fit into memory. What
follows cuts their array into blocks, clauses and tables, and shuffles nothing; the only sort is one of a document's finished pieces, for
the numbers of its chunks. Only two rules look at their own last answer, whether a clause leaves the current block and whether a clause is taken in
by one before it, and these are folds over the short lists of numbers, not over text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import content_hash, window_starts

SECTION_CHARS, CLAUSE_CHARS, OVERLAP = 1800, 1800, 200
#: Pages of a task: a page is a few hundred times smaller in the shuffle than its lines are in the sorts behind it, so Spark's own measure, bytes shuffled, makes tasks too large.
TASK_PAGES = 20_000
#: What page marks, annex headings, section headings, clause lines and table marks look like.
PAGE = r"(?i)^<!--\s*page:\s*(\d+)\s*-->"
ANNEX = r"(?i)^(annex\s+\d+(?:\s*[-–]\s*appendix\s+\d+)?)$"
SECTION = r"^(\d+(?:\.\d+)*\.?)\s+([A-Z].{3,})$"
BOUNDARY = r"^(\d+(?:\.\d+)+)\.(?:$|\s+[A-Za-z])"
CLAUSE = r"^(\d+(?:\.\d+)+)\.?(?:$|\s+(.+)$)"
TABLE_MARK, OTHER_MARK = r"(?i)<!--\s*chunk_type:table\s*-->", r"(?i)^<!-- chunk_type:"
PIPE_ROW = r"^\|.+\|$"
SPACE = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def found(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def cut(rows: Column, at: Column) -> Column:
    """An array in slices: what stands before the first of the positions (from 0), then from each to the next. Both are columns, not expressions, which a lambda would work out again."""
    return F.zip_with(F.array_prepend(at, F.lit(0)), F.array_append(at, F.size(rows)), lambda x, y: F.slice(rows, x + 1, y - x))


def places(rows: Column, holds) -> Column:
    """Positions (from 0) of what holds."""
    return F.filter(F.transform(rows, lambda x, i: F.when(holds(x), i)), lambda i: i.isNotNull())


def digit(c: Column) -> Column:
    """Whether a text begins with 0 to 9; most lines don't, and no pattern is tried on them."""
    return (c >= "0") & (c < ":")


def joined(lines: Column) -> Column:
    return strip(F.array_join(lines, "\n"))


def leaves(current: Column, number: Column) -> Column:
    """Whether a clause number begins a block of its own while the block `current` is open."""
    parts, own = F.split(number, r"\."), F.split(current, r"\.")
    top, own_top = F.element_at(parts, 1), F.element_at(own, 1)
    sibling = (F.size(parts) <= F.size(own)) & ~F.startswith(number, current)
    return current.isin("General", "Document") | F.startswith(current, F.lit("Annex")) | (top != own_top) | sibling


def block_lines(pages: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, block, block_id, kind, path, first_page, last_page, text, lines) of every block with text, numbered from 0; lines: array<struct<n, line, s, page>>, s without outer space.

    pages: doc_id, page_number, text and perhaps tables (array of pipe tables, which follow the text unless they are in it).
    Equal page rows of a document are one page; pages of one number come in order of their text; a null text is an empty one.
    most: how many pages there are at most, where that is known; else they are counted.
    """
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, (pages.count() if most is None else most) // TASK_PAGES)
    text = F.coalesce("text", F.lit(""))
    lines = F.concat(F.array(F.concat(F.lit("<!-- page: "), F.coalesce(F.col("page_number").cast("string"), F.lit("?")), F.lit(" -->"))), F.split(text, r"\r?\n"))
    if "tables" in pages.columns:
        new = F.filter(F.coalesce("tables", F.array().cast("array<string>")), lambda t: t.isNotNull() & ~F.contains(text, t))
        lines = F.concat(lines, F.flatten(F.transform(new, lambda t: F.concat(F.array(F.lit("<!-- chunk_type:table -->")), F.split(t, r"\r?\n")))))
    page = F.struct(F.col("page_number"), lines.alias("lines"))
    docs = pages.repartition(tasks, "doc_id").groupBy("doc_id").agg(F.flatten(F.sort_array(F.collect_set(page))["lines"]).alias("lines"))
    # each line is stripped once, and matched only where its first sign allows it
    number = lambda x: F.when(F.contains(x, F.lit("<!--")), found(strip(x), PAGE, 1).cast("int"))
    docs = docs.withColumn("lines", F.transform("lines", lambda x, i: F.struct(i.alias("n"), x.alias("line"), strip(x).alias("s"), number(x).alias("page"))))
    edge = lambda s: digit(s) | F.startswith(s, F.lit("A")) | F.startswith(s, F.lit("a"))
    numbers = F.transform(F.filter("lines", lambda x: edge(x["s"])), lambda x: F.struct(x["n"].alias("n"), found(x["s"], ANNEX, 1).alias("annex"), found(x["s"], SECTION, 1).alias("number"), F.substring(F.regexp_extract(x["s"], SECTION, 2), 1, 60).alias("title"), found(x["s"], BOUNDARY, 1).alias("bound")))
    # one or two parts make a section, where a dot at the end counts as a part
    section = lambda x: F.when(x["annex"].isNull() & (F.size(F.split(x["number"], r"\.")) <= 2), F.regexp_replace(x["number"], r"\.$", ""))
    marked = F.transform(numbers, lambda x: F.struct(x["n"].alias("n"), x["annex"].alias("annex"), section(x).alias("section"), x["title"].alias("title"), x["bound"].alias("bound")))
    edges = F.filter(marked, lambda x: F.coalesce(x["annex"], x["section"], x["bound"]).isNotNull())

    def opening(n: Column, kind: str, name: Column, path: Column) -> Column:
        return F.struct(n.alias("n"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("path"))

    def moved(state: Column, name: Column, base: Column, opened: Column) -> Column:
        return F.struct(name.alias("id"), base.alias("base"), F.array_append(state["opened"], opened).alias("opened"))

    def step(state: Column, e: Column) -> Column:
        annex = moved(state, F.lit("Annex"), e["annex"], opening(e["n"], "annex", F.replace(e["annex"], F.lit(" "), F.lit("_")), e["annex"]))
        section = moved(state, e["section"], state["base"], opening(e["n"], "section", e["section"], F.concat(state["base"], F.lit(" > §"), e["section"], F.lit(" "), e["title"])))
        clause = moved(state, e["bound"], F.lit("Document"), opening(e["n"], "clause", e["bound"], F.concat(F.lit("Document > §"), e["bound"])))
        return F.when(e["annex"].isNotNull(), annex).when(e["section"].isNotNull(), section).when(leaves(state["id"], e["bound"]), clause).otherwise(state)

    first = opening(F.lit(0), "section", F.lit("General"), F.lit("Document"))
    start = F.struct(F.lit("General").alias("id"), F.lit("Document").alias("base"), F.slice(F.array(first), 1, 0).alias("opened"))
    docs = docs.withColumn("opened", F.aggregate(edges, start, step)["opened"])

    def block(o: Column, end: Column) -> Column:
        at = o["n"] + F.when(o["kind"] == "annex", 1).otherwise(0)  # an annex heading is in no text
        return F.struct(o["name"].alias("block_id"), o["kind"].alias("kind"), o["path"].alias("path"), F.slice("lines", at + 1, end - at).alias("lines"))

    parts = F.zip_with(F.array_prepend("opened", first), F.array_append(F.col("opened")["n"], F.size("lines")), block)
    rows = docs.select("doc_id", F.posexplode(F.filter(parts, lambda b: F.exists(b["lines"], lambda x: x["s"] != ""))).alias("block", "b")).select("doc_id", "block", "b.*")
    page = F.col("lines")["page"]
    return rows.select("doc_id", "block", "block_id", "kind", "path", F.array_min(page).alias("first_page"), F.array_max(page).alias("last_page"), joined(F.col("lines")["line"]).alias("text"), "lines")


def blocks(pages: DataFrame, most: int | None = None) -> DataFrame:
    """pages -> (doc_id, block, block_id, kind, heading_path, first_page, last_page, text): annexes, sections and clauses apart from them.

    Pages are those whose marks lie in the block, null where none does. An annex heading is in no text; blocks without text are left out.
    """
    return block_lines(pages, most).select("doc_id", "block", "block_id", "kind", F.col("path").alias("heading_path"), "first_page", "last_page", "text")


def block_clauses(rows: DataFrame) -> DataFrame:
    """Blocks with their clauses, array<struct<number, title, marks, lines>>, null for a block that is a clause itself; marks are the numbers of pages that begin in a clause.

    Text before the first clause is a clause without a number, perhaps an empty one.
    """
    lines = F.when(F.col("kind") != "clause", F.col("lines"))
    numbered = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["s"].alias("s"), x["page"].alias("page"), F.when(digit(x["s"]), found(x["s"], CLAUSE, 1)).alias("number")))
    rest = lambda x: F.regexp_extract(x["s"], CLAUSE, 2)
    dropped = lambda x: (x["s"] == "") | (F.startswith(x["s"], F.lit("<!--")) & ~x["s"].rlike(TABLE_MARK))
    text = lambda x: F.when(x["number"].isNotNull(), F.nullif(strip(rest(x)), F.lit(""))).when(~dropped(x), x["line"])
    title = lambda x: F.when(x["number"].isNotNull(), strip(F.concat(F.lit("§"), x["number"], F.lit(" "), F.substring(rest(x), 1, 80)))).otherwise(F.lit(""))
    told = F.transform(numbered, lambda x: F.struct(x["page"].alias("page"), x["number"].alias("number"), title(x).alias("title"), text(x).alias("text")))
    rows = rows.withColumn("told", told).withColumn("at", places(F.col("told"), lambda x: x["number"].isNotNull()))

    def clause(part: Column) -> Column:
        own = F.get(part, F.lit(0))
        return F.struct(own["number"].alias("number"), F.coalesce(own["title"], F.lit("")).alias("title"), F.array_compact(part["page"]).alias("marks"), F.array_compact(part["text"]).alias("lines"))

    return rows.withColumn("clauses", F.transform(cut(F.col("told"), F.col("at")), clause)).drop("told", "at")


def heads(clauses: Column) -> Column:
    """For each clause its page, the highest of those it is on, and whether its text joins that of a clause before it that ends with a colon and is its parent, with nothing else between."""
    start = F.struct(F.lit(None).cast("string").alias("number"), F.lit(False).alias("colon"), F.lit(None).cast("int").alias("page"), F.array().cast("array<struct<taken:boolean,page:int>>").alias("out"))

    def step(state: Column, c: Column) -> Column:
        child = state["colon"] & F.coalesce(F.regexp_replace(c["number"], r"\.\d+$", "") == state["number"], F.lit(False)) & (c["number"] != state["number"])
        page = F.coalesce(F.try_element_at(c["marks"], F.lit(-1)), state["page"])
        ends = F.coalesce(F.try_element_at(c["lines"], F.lit(-1)).rlike(r":\s*$"), F.lit(False))

        def gone(number: Column, colon: Column, taken: bool) -> Column:
            told = F.struct(F.lit(taken).alias("taken"), F.greatest(state["page"], F.array_max(c["marks"])).alias("page"))
            return F.struct(number.alias("number"), colon.alias("colon"), page.alias("page"), F.array_append(state["out"], told).alias("out"))

        return F.when(child, gone(state["number"], state["colon"], True)).otherwise(gone(c["number"], c["number"].isNotNull() & ends, False))

    return F.aggregate(clauses, start, step)["out"]


def clause_bodies(per_block: DataFrame) -> DataFrame:
    """(..., nth, number, title, page, lines, section) of each block's bodies: clauses with the sub-clauses they take in, each introduced by its number.

    A block that is a clause itself is one body, whole. Any other has its section chunk's text in a body before the others, without lines.
    """
    told = F.zip_with("clauses", heads(F.col("clauses")), lambda c, h: F.struct(c["number"].alias("number"), c["title"].alias("title"), h["page"].alias("page"), h["taken"].alias("taken"), c["lines"].alias("lines")))
    rows = per_block.withColumn("clauses", told).withColumn("at", places(F.col("clauses"), lambda c: ~c["taken"]))
    lines = lambda c: F.when(c["taken"], F.array_prepend(c["lines"], F.concat(c["number"], F.lit(".")))).otherwise(c["lines"])
    none = F.lit(None).cast("string")

    def body(number: Column, title: Column, page: Column, lines: Column, section: Column = none) -> Column:
        return F.struct(number.alias("number"), title.alias("title"), page.alias("page"), lines.alias("lines"), section.alias("section"))

    def group(clauses: Column) -> Column:
        own = F.get(clauses, F.lit(0))
        return body(own["number"], own["title"], own["page"], F.flatten(F.transform(clauses, lines)))

    bodies = F.filter(F.transform(cut(F.col("clauses"), F.col("at")), group), lambda b: b["number"].isNotNull() | (F.size(b["lines"]) > 0))
    section = body(none, none, F.col("first_page"), F.array().cast("array<string>"), strip(F.substring("text", 1, SECTION_CHARS)))
    whole = body(F.col("block_id"), F.lit(""), F.col("last_page"), F.col("lines")["line"])
    rows = rows.withColumn("bodies", F.when(F.col("kind") == "clause", F.array(whole)).otherwise(F.array_prepend(bodies, section)))
    # the array is exploded as an expression: of a column Spark would test the size, below all the steps that make it, and do these once more
    every = F.when(F.size("bodies") > 0, F.col("bodies"))
    key = ["doc_id", "block", "block_id", "kind", "path", "first_page"]
    return rows.select(*key, F.posexplode(every).alias("nth", "b")).select(*key, "nth", "b.*")


def body_tables(bodies: DataFrame) -> DataFrame:
    """bodies with text (what is in no table) and tables, array<struct<preamble, markdown>>, instead of lines; tables may be null where there is none.

    A table is what follows a table mark, up to the next mark or through the first line that is no pipe row once there is
    one, or else two pipe rows or more in a row. Its preamble is the text since the table before; it stays in the text too.
    """
    plain = ~F.exists("lines", lambda x: F.contains(x, F.lit("|")) | F.contains(x, F.lit("<!--")))
    mark = lambda x: F.when(F.contains(x, F.lit("<!--")), F.when(strip(x).rlike(TABLE_MARK), 1).when(strip(x).rlike(OTHER_MARK), 0))
    pipe = lambda x: F.contains(x, F.lit("|")) & strip(x).rlike(PIPE_ROW)
    marked = F.transform(F.when(~plain, F.col("lines")), lambda x, k: F.struct(k.alias("k"), x.alias("line"), (strip(x) != "").alias("ink"), mark(x).alias("mark"), pipe(x).alias("pipe")))
    rows = bodies.withColumn("plain", plain).withColumn("rows", marked).withColumn("at", places(F.col("rows"), lambda x: x["mark"].isNotNull()))
    # in a zone, from a mark to the next: its first lines, then the line that ends its table
    inked = lambda x: x["mark"].isNull() & x["ink"]
    least = lambda rows, holds: F.array_min(F.filter(rows, holds)["k"])
    zones = F.transform(cut(F.col("rows"), F.col("at")), lambda z: F.struct(z.alias("rows"), F.coalesce(F.get(z, F.lit(0))["mark"] == 1, F.lit(False)).alias("table"), least(z, lambda x: x["pipe"]).alias("pipe"), least(z, inked).alias("ink")))
    zones = F.transform(zones, lambda z: F.struct(z["rows"].alias("rows"), z["table"].alias("table"), z["ink"].alias("ink"), least(z["rows"], lambda x: inked(x) & ~x["pipe"] & (x["k"] > z["pipe"]) & (x["k"] > z["ink"])).alias("stop")))

    def in_zone(x: Column, z: Column) -> Column:
        taken = z["table"] & x["mark"].isNull() & (x["k"] <= F.coalesce(z["stop"], x["k"]))
        return F.struct(x["k"].alias("k"), x["line"].alias("line"), x["mark"].alias("mark"), taken.alias("marked"), (x["pipe"] & ~taken).alias("loose"), (taken & x["ink"]).alias("inside"), F.coalesce(taken & (x["k"] == z["ink"]), F.lit(False)).alias("fresh"))

    rows = rows.withColumn("rows", F.flatten(F.transform(zones, lambda z: F.transform(z["rows"], lambda x: in_zone(x, z)))))
    loose = lambda k: F.coalesce(F.get("rows", k)["loose"], F.lit(False))

    def in_run(x: Column) -> Column:
        wide = x["loose"] & (loose(x["k"] - 1) | loose(x["k"] + 1))
        return F.struct(x["line"].alias("line"), (x["mark"].isNull() & ~x["marked"] & ~wide).alias("plain"), (x["inside"] | wide).alias("inside"), (x["fresh"] | (wide & ~loose(x["k"] - 1))).alias("fresh"))

    rows = rows.withColumn("rows", F.transform("rows", in_run)).withColumn("at", places(F.col("rows"), lambda x: x["fresh"]))
    which = lambda rows, name: F.filter(rows, lambda x: x[name])["line"]
    parts = F.transform(cut(F.col("rows"), F.col("at")), lambda p: F.struct(joined(which(p, "plain")).alias("preamble"), joined(which(p, "inside")).alias("markdown")))
    rows = rows.withColumn("parts", parts)
    tables = F.zip_with(F.slice("parts", 1, F.size("at")), F.slice("parts", 2, F.size("at")), lambda before, own: F.struct(before["preamble"].alias("preamble"), own["markdown"].alias("markdown")))
    text = joined(F.when(F.col("plain"), F.col("lines")).otherwise(which(F.col("rows"), "plain")))
    return rows.select(*[c for c in bodies.columns if c != "lines"], text.alias("text"), tables.alias("tables"))


def header_cells(markdown: Column) -> Column:
    """The header cells of a pipe table."""
    rows = F.filter(F.split(markdown, "\n"), lambda r: F.startswith(r, F.lit("|")) & ~F.startswith(strip(r), F.lit("| ---")))
    return F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(F.get(rows, F.lit(0)), F.lit("")), r"^\|+|\|+$", ""), r"\|"), strip), lambda c: c != "")


def table_summary(cells: Column) -> Column:
    """The first four header cells of a pipe table."""
    head = F.concat(F.lit("Table: "), F.array_join(F.slice(cells, 1, 4), ", "), F.when(F.size(cells) > 4, "…").otherwise(F.lit("")))
    return F.when(F.size(cells) > 0, head).otherwise(F.lit("Structured compliance table"))


def structured_chunks(pages: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, chunk_index, parent_index, chunk_type, section, page_number, heading_path, chunk_text, content_hash).

    An annex or section block gives a section chunk (its first SECTION_CHARS characters); its clauses give clause chunks, text without
    a number paragraph chunks, both cut to CLAUSE_CHARS; their tables follow. Parent of a clause is its section, of a table its numbered clause,
    else the section. A block that is a clause itself has no section chunk.
    """
    bodies = body_tables(clause_bodies(block_clauses(block_lines(pages, most))))
    starts = window_starts(F.col("text"), CLAUSE_CHARS, OVERLAP, True)
    texts = F.filter(F.transform(starts, lambda at: strip(F.substring(F.col("text"), at + 1, F.lit(CLAUSE_CHARS)))), lambda t: t != "")
    kind = F.when(F.col("number").isNotNull(), "clause").otherwise(F.lit("paragraph"))
    title = F.btrim(F.concat(F.col("path"), F.lit(" > "), F.coalesce("title", F.lit(""))), F.lit(" >"))
    chunk = lambda kind, path, text: F.struct(kind.alias("type"), path.alias("path"), text.alias("text"))
    celled = F.transform("tables", lambda t: F.struct(t.alias("t"), header_cells(t["markdown"]).alias("cells")))
    headed = F.transform(celled, lambda t: F.struct(t["t"].alias("t"), table_summary(t["cells"]).alias("head")))

    def table(x: Column) -> Column:
        t = x["t"]
        text = F.concat(x["head"], F.lit("\n\n"), F.when(t["preamble"] != "", F.concat(t["preamble"], F.lit("\n\n"))).otherwise(F.lit("")), t["markdown"])
        return chunk(F.lit("table"), F.concat(F.col("path"), F.lit(" > "), x["head"]), text)

    whole = (F.col("text") != "") & (F.char_length("text") <= CLAUSE_CHARS)
    own = F.when(F.col("section").isNotNull(), F.array(chunk(F.lit("section"), F.col("path"), F.col("section")))).when(whole, F.array(chunk(kind, title, F.col("text")))).otherwise(F.transform(texts, lambda t: chunk(kind, title, t)))
    bodies = bodies.select("doc_id", "block", "block_id", "kind", "first_page", "nth", "number", "page", "section", own.alias("own"), F.transform(headed, table).alias("more"))
    order = Window.partitionBy("doc_id").orderBy("block", "nth")
    made = F.size("own") + F.when(F.col("more").isNotNull(), F.size("more")).otherwise(0)
    first = F.coalesce(F.sum(made).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    bodies = bodies.withColumn("first", first).withColumn("section_index", F.last(F.when(F.col("section").isNotNull(), F.col("first")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    section_index = F.when(F.col("kind") != "clause", F.col("section_index"))
    clause_index = F.when(F.col("number").isNotNull() & (F.size("own") > 0), F.col("first"))
    chunks = F.when(F.col("more").isNotNull(), F.concat("own", "more")).otherwise(F.col("own"))
    rows = bodies.select("doc_id", F.coalesce("number", "block_id").alias("section"), F.coalesce("page", "first_page").alias("page_number"), "first", section_index.alias("section_index"), clause_index.alias("clause_index"), F.posexplode(chunks).alias("at", "c"))
    parent = F.when(F.col("c.type") == "section", None).when(F.col("c.type") == "table", F.coalesce("clause_index", "section_index")).otherwise(F.col("section_index"))
    out = rows.select("doc_id", (F.col("first") + F.col("at")).alias("chunk_index"), parent.alias("parent_index"), F.col("c.type").alias("chunk_type"), "section", "page_number", F.col("c.path").alias("heading_path"), F.col("c.text").alias("chunk_text"))
    return out.withColumn("content_hash", content_hash(F.col("chunk_text")))


def synthetic_pages(lines: DataFrame) -> DataFrame:
    """One document per order, a page a line, with section, clause, annex and table lines."""
    text = F.expr(r"""CASE l_linenumber % 4
        WHEN 1 THEN concat_ws('\n', (l_orderkey % 6 + 1) || '. General', (l_orderkey % 6 + 1) || '.2.1. The limits are:', (l_orderkey % 6 + 1) || '.2.1.1. ' || cast(l_quantity AS int) || ' mm', 'more text')
        WHEN 2 THEN concat_ws('\n', '5.2.' || l_linenumber || '. shall not exceed ' || cast(l_quantity AS int) || ' mm', '| Seat | Load |', '| --- | --- |', '| Driver | ' || cast(l_quantity AS int) || ' |', 'and so on')
        WHEN 3 THEN concat_ws('\n', 'Annex ' || (l_orderkey % 4), '7.6.2. Procedure', 'step', '7.6.3.', 'second step')
        ELSE 'plain text' END""")
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page_number"), text.alias("text"))


def mock_embedding(text: Column, dim: int = 64) -> Column:
    """Deterministic unit vector: SHA-256 of the text, modulo 2^32 - 1, seeds a normal generator."""

    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        def one(t: str | None):
            if t is None:
                return None
            seed = int(hashlib.sha256(t.encode()).hexdigest(), 16) % (2**32 - 1)
            v = np.random.default_rng(seed).normal(0.0, 1.0, dim)
            return (v / np.linalg.norm(v)).astype(np.float32)

        return s.map(one)

    return embed(text)
