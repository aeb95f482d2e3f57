"""Set-oriented hybrid retrieval: many questions against a corpus in one plan.

Ranked lists are DataFrames (query_id, doc_id, ..., rank from 1). Every ranking has a unique tie-break.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.sizes import small
from lexforge.functions.text import MONTHS, bare_words, long_terms, substring_hits
from lexforge.operators.records import with_limits

RRF_K = 60
DENSE_SHARE, SPARSE_SHARE = 0.6, 0.4
#: Questions of a batch: this side is broadcast, so its size is checked.
MOST_QUERIES = 10_000
#: Criteria of which a clause must have a limit to be offered for linking.
RESOLVABLE = ("ThCC", "HIC36", "HIC", "TCFC")


def depth(top_k: int) -> int:
    """Candidates that each list gives to the fusion."""
    return max(30, 3 * top_k)


def metadata_filter(filters: dict, include_superseded: bool = False) -> Column:
    """Conjunction of the filters that are given; they apply inside both lists, before ranking."""
    parts = []
    for name, value in filters.items():
        if value is None:
            continue
        if name == "effective_year":
            parts.append(F.year("effective_date") == value)
        else:
            parts.append(F.col(name).isin(value) if isinstance(value, list | tuple | set) else F.col(name) == value)
    if not include_superseded:
        parts.append(F.col("status") == "ACTIVE")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def against(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Each question beside each row of the corpus; the questions are the small side, and that is checked."""
    return corpus.crossJoin(small(queries, MOST_QUERIES, "questions"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k best rows of each question with their rank; Spark keeps k per task before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """By cosine of vectors; rows without one are skipped."""
    rows = against(queries.select("query_id", "query_vector"), corpus.where("embedding is not null").select("doc_id", "embedding"))
    scored = rows.select("query_id", "doc_id", cosine(F.col("embedding"), F.col("query_vector")).alias("score"))
    return top(scored, k, F.desc("score"), F.col("doc_id"))


def sparse(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """By the number of question terms found in the text; rows without any are left out."""
    q = queries.select("query_id", long_terms(F.col("query")).alias("terms"))
    scored = against(q, corpus.select("doc_id", F.lower("text").alias("low"))).select("query_id", "doc_id", substring_hits(F.col("low"), F.col("terms")).alias("score"))
    return top(scored.where("score > 0"), k, F.desc("score"), F.col("doc_id"))


def fuse(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion; ties keep the first list's order, then the second's."""
    a = first.select("query_id", "doc_id", F.col("rank").alias("dense_rank"))
    b = second.select("query_id", "doc_id", F.col("rank").alias("sparse_rank"))
    part = [F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0)) for c in ("dense_rank", "sparse_rank")]
    both = a.join(b, ["query_id", "doc_id"], "full_outer").withColumn("rrf_score", part[0] + part[1])
    return top(both, k, F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"))


def hybrid(queries: DataFrame, corpus: DataFrame, top_k: int = 10) -> DataFrame:
    n = depth(top_k)
    return fuse(dense(queries, corpus, n), sparse(queries, corpus, n), top_k)


def weighted(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """0.6 cosine + 0.4 share of distinct question words that occur as substrings; rows without a vector score 0 there."""
    q = queries.select("query_id", "query_vector", F.filter(bare_words(F.col("query")), lambda t: F.char_length(t) > 2).alias("terms"))
    rows = against(q, corpus.select("doc_id", F.lower("text").alias("low"), "embedding"))
    words = substring_hits(F.col("low"), F.col("terms")) / F.greatest(F.size("terms"), F.lit(1))
    score = DENSE_SHARE * F.coalesce(cosine(F.col("embedding"), F.col("query_vector")), F.lit(0.0)) + SPARSE_SHARE * words
    return top(rows.select("query_id", "doc_id", F.round(score, 8).alias("score")), k, F.desc("score"), F.col("doc_id"))


def overlap(query: Column, text: Column) -> Column:
    """Word overlap in place of a cross-encoder: question words lose punctuation, passage words don't."""
    return F.size(F.array_intersect(bare_words(query), F.array_distinct(F.split(F.lower(text), r"\s+"))))


def rerank(queries: DataFrame, candidates: DataFrame, passages: DataFrame, k: int, score: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """The k best candidates (query_id, doc_id) of each question by score(query, text). Only candidates are read and scored; a model comes in as a column function."""
    rows = candidates.select("query_id", "doc_id").join(passages.select("doc_id", "text"), "doc_id").join(queries.select("query_id", "query"), "query_id")
    return top(rows.select("query_id", "doc_id", score(F.col("query"), F.col("text")).alias("score")), k, F.desc("score"), F.col("doc_id"))


def is_scope(section: Column, body: Column) -> Column:
    """Scope, definition and administration chunks, which answer few questions."""
    head = F.lower(F.substring(F.ltrim(F.regexp_replace(body, r"^[^\]]*\]", "")), 1, 200))
    return section.isin("1", "2", "3", "4", "General") | section.rlike(r"^2\.\d+$") | F.contains(head, F.lit("as defined in the consolidated resolution")) | head.rlike(rf"^\d{{1,2}}\s+(?:{'|'.join(MONTHS)})\s+20\d{{2}}")


def demote_scope(ranked: DataFrame) -> DataFrame:
    """Substantive chunks first, each part in its old order."""
    flag = F.coalesce(is_scope(F.col("section"), F.col("text")), F.lit(False))
    w = Window.partitionBy("query_id").orderBy("is_scope", "old_rank")
    return ranked.withColumnRenamed("rank", "old_rank").withColumn("is_scope", flag).withColumn("rank", F.row_number().over(w))


def promote(ranked: DataFrame, wanted: Column, k: int, *order: Column, cut: bool = True) -> DataFrame:
    """The best wanted chunk takes the last of k places, unless a chunk of the first k is that one already. Without cut the others stay behind them, in their order."""
    w = Window.partitionBy("query_id")
    best = F.row_number().over(w.orderBy(F.desc("wanted"), *order))
    r = ranked.withColumn("wanted", F.coalesce(wanted, F.lit(False))).withColumn("chosen", (best == 1) & F.col("wanted"))
    inside = F.max(F.col("chosen") & (F.col("rank") <= k)).over(w)
    exists = F.max("chosen").over(w)
    r = r.withColumn("inside", inside).withColumn("exists", exists)
    moved = F.when(F.col("inside") | ~F.col("exists"), F.col("rank")).when(F.col("chosen"), F.lit(k)).when(F.col("rank") >= k, F.col("rank") + 1).otherwise(F.col("rank"))
    return r.withColumn("rank", moved).where((F.col("rank") <= k) | F.lit(not cut)).drop("wanted", "chosen", "inside", "exists")


def promote_annex(ranked: DataFrame, queries: DataFrame, k: int, cut: bool = True) -> DataFrame:
    """Where a question names an annex, its best chunk of the list (section, chunk_type, text, score) is among the first k: tables before other chunks, then by score."""
    number = F.nullif(F.regexp_extract("query", r"(?i)\bannex\s*(\d+)\b", 1), F.lit(""))
    rows = ranked.join(queries.select("query_id", number.alias("_annex")), "query_id", "left")
    wanted = F.regexp_like(F.col("section"), F.concat(F.lit("Annex_"), F.col("_annex"), F.lit(r"(?:\D|$)")))
    table = F.coalesce((F.col("chunk_type") == "table") | F.contains("text", F.lit("Vehicle category")), F.lit(False))
    return promote(rows, wanted, k, F.desc(table), F.desc("score"), F.col("doc_id"), cut=cut).drop("_annex")


def promote_cited(ranked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Where a question cites paragraphs, the best chunk of their sections, of those above or of those below is among the first k: the deepest, then by score."""
    cited = F.array_distinct(F.concat(*[F.regexp_extract_all("query", F.lit(p), F.lit(1)) for p in (r"(?i)(?:§|paragraph\s+)(\d+(?:\.\d+)*)", r"\b(\d+\.\d+\.\d+)\b")]))
    rows = ranked.join(queries.select("query_id", cited.alias("_cited")), "query_id", "left")
    section, dot = F.trim("section"), F.lit(".")
    near = F.exists("_cited", lambda c: (section == c) | F.startswith(section, F.concat(c, dot)) | F.startswith(c, F.concat(section, dot)))
    return promote(rows, near & (section != ""), k, F.desc(F.size(F.split(section, r"\."))), F.desc("score"), F.col("doc_id")).drop("_cited")


def expand_parents(ranked: DataFrame, corpus: DataFrame, k: int, most: int = 4) -> DataFrame:
    """Each hit's parent follows it unless it is there already; at most so many are added, then the list is cut to k."""
    hits = ranked.select("query_id", "doc_id", "rank", F.lit(0).alias("is_parent"))
    up = ranked.join(corpus.select("doc_id", "parent_id"), "doc_id").where("parent_id is not null").groupBy("query_id", "parent_id").agg(F.min("rank").alias("rank"))
    new = up.join(ranked.select("query_id", F.col("doc_id").alias("parent_id")), ["query_id", "parent_id"], "left_anti")
    new = top(new.withColumnRenamed("rank", "at"), most, F.col("at"), F.col("parent_id")).select("query_id", F.col("parent_id").alias("doc_id"), F.col("at").alias("rank"), F.lit(1).alias("is_parent"))
    both = hits.union(new).withColumnRenamed("rank", "at")
    return top(both, k, F.col("at"), F.col("is_parent"), F.col("doc_id"))


def search(queries: DataFrame, corpus: DataFrame, top_k: int = 10, score: Callable[[Column, Column], Column] | None = None, parents: int = 4) -> DataFrame:
    """(query_id, rank, doc_id, is_parent): the whole way of a question, in one plan.

    Both lists give depth(top_k) candidates, fusion ranks them, a score (a reranker's column function) ranks them anew where there is one, else the fused order
    stands. Scope chunks go behind the others; the chunks of a named annex and of cited paragraphs are promoted from the candidates, by their fused score;
    parents follow their chunks, at most so many, and then the list is cut. queries: query_id, query, query_vector; corpus: doc_id, text, embedding,
    section, chunk_type, parent_id. Only candidates carry texts beyond the two lists.
    """
    n = depth(top_k)
    fused = fuse(dense(queries, corpus, n), sparse(queries, corpus, n), n).select("query_id", "doc_id", "rank", F.col("rrf_score").alias("score"))
    pool = fused.join(corpus.select("doc_id", "text", "section", "chunk_type"), "doc_id")
    if score is not None:
        given = pool.join(queries.select("query_id", "query"), "query_id").withColumn("_given", score(F.col("query"), F.coalesce("text", F.lit(""))))
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_given"), "rank"))
        pool = given.withColumn("rank", best).drop("query", "_given")
    pool = demote_scope(pool).drop("old_rank", "is_scope")
    chosen = promote_cited(promote_annex(pool, queries, top_k, cut=False), queries, top_k)
    return expand_parents(chosen, corpus, top_k, parents).select("query_id", "rank", "doc_id", "is_parent")


CITATION = r"(?:paragraphs?|paras?\.)\s+(\d+(?:\.\d+)*)"


def longest_prefix(cited: DataFrame, sections: DataFrame) -> DataFrame:
    """cited (src, code, ordinal, number) joined to the longest existing beginning of the number among sections (code, section, doc_id)."""
    parts = F.split("number", r"\.")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), ".").alias("section"))))
    rows = cited.withColumn("p", prefix).select("src", "code", "ordinal", "number", "p.depth", "p.section").join(sections, ["code", "section"])
    best = F.row_number().over(Window.partitionBy("src", "ordinal").orderBy(F.desc("depth"), "doc_id"))
    return rows.withColumn("n", best).where("n = 1").select("src", "ordinal", "number", F.col("doc_id").alias("dst"))


def citations(chunks: DataFrame) -> DataFrame:
    """(src, code, ordinal, number) of the paragraphs that a chunk's text cites."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(CITATION), F.lit(1))
    return chunks.select(F.col("doc_id").alias("src"), "code", F.posexplode(found).alias("ordinal", "number"))


def expand_references(ranked: DataFrame, edges: DataFrame, most: int = 5, rounds: int = 2) -> DataFrame:
    """(query_id, doc_id, depth, score): chunks cited by hits, breadth first, depth by depth, at most so many a question.

    Each depth is one join; a chunk that is there already is not added again; the score falls by 0.05 a hop.
    """
    seen = ranked.select("query_id", "doc_id", F.lit(0).alias("depth"), F.col("rank").alias("place"), F.col("score"))
    layer = seen
    for d in range(1, rounds + 1):
        step = layer.join(edges, layer["doc_id"] == edges["src"]).select("query_id", F.col("dst").alias("doc_id"), "place", "ordinal", F.round(F.col("score") - 0.05, 6).alias("score"))
        first = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("place", "ordinal"))
        step = step.withColumn("n", first).where("n = 1").join(seen.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        order = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "ordinal", "doc_id"))
        layer = step.select("query_id", "doc_id", F.lit(d).alias("depth"), order.alias("place"), "score")
        seen = seen.union(layer)
    added = seen.where("depth > 0")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "place"))
    return added.withColumn("n", nth).where(F.col("n") <= most).select("query_id", "doc_id", "depth", "score")


#: Patterns of the intent router, first match wins.
IDENTITY = r"(?i)^\s*(?:who\s+are\s+you|what\s+are\s+you|are\s+you\s+(?:an?\s+)?(?:ai|artificial|human|engineer|chatbot|bot)|introduce\s+yourself|tell\s+me\s+about\s+yourself)\s*[?.!]*\s*$"
INJECTION = "(?is)" + "|".join(
    [
        r"(?:translate|tradu(?:ire|isez|uction)|translation).{0,200}?(?:then|puis|and\s+then|after\s+that|ensuite).{0,60}?(?:follow|obey|execute|apply|comply|do\s+(?:what|it)|suivre|suivez)",
        r"ignore(?:z)?\s+les?\s+directives?\s+de\s+citation",
        r"ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions",
        r"disregard\s+(?:all\s+)?(?:previous|prior|the\s+)?(?:system|above)\s+instructions",
        r"ignore\s+(?:all\s+)?citation",
        r"invent(?:ez)?\s+(?:une\s+)?r[eé]ponse",
        r"invent\s+(?:an?\s+)?answer",
        r"fabriqu(?:er|ez)\s+(?:une\s+)?r[eé]ponse",
        r"make\s+up\s+(?:an?\s+)?answer",
        r"without\s+(?:any\s+)?citations?",
        r"bypass\s+(?:safety|guardrails|filters|restrictions|grounding)",
        r"override\s+(?:your\s+)?(?:system|safety)\s+(?:prompt|rules|instructions)",
        r"pretend\s+you\s+are\s+not\s+(?:an?\s+)?(?:ai|assistant|chatbot)",
        r"\bjailbreak\b",
        r"reveal\s+(?:the\s+)?(?:system\s+)?prompt",
    ]
)
DOCUMENT_COUNT = "(?i)" + "|".join(
    [
        r"how\s+many\s+(?:pdf|pdfs|document|documents|file|files|source|sources)",
        r"(?:count|total\s+number\s+of)\s+(?:the\s+)?(?:pdf|pdfs|document|documents|file|files)",
        r"count\s+(?:the\s+)?number\s+of\s+(?:the\s+)?(?:pdf|pdfs|document|documents|file|files)",
        r"what\s+is\s+the\s+(?:total\s+)?number\s+of\s+(?:pdf|pdfs|document|documents|file|files)",
        r"number\s+of\s+(?:pdf|pdfs|document|documents)",
    ]
)
CORPUS_META = "(?i)" + "|".join(
    [
        r"(?:what|which)\s+(?:documents?|regulations?|regs?|standards?|sources?|pdfs?|corpus|knowledge\s+base)\s+(?:do\s+you\s+)?(?:use|have|cover|contain|include|access)",
        r"(?:what|which)\s+(?:regulations?|regs?|standards?)\s+do\s+you\s+have\s+access\s+to",
        r"what\s+(?:is|are)\s+in\s+(?:the\s+)?(?:corpus|knowledge\s+base|registry)",
        r"what\s+do\s+you\s+have\s+access\s+to",
        r"list\s+(?:all\s+)?(?:ingested\s+)?(?:regulations?|documents?|coverage|pdfs?|sources?)",
        r"list\s+(?:your|the)\s+(?:pdf|pdfs|document|documents|source|sources)",
        r"coverage\s+(?:report|summary|status)",
        r"how\s+many\s+(?:pdf|pdfs|document|documents|file|files|source|sources|regs?|regulations?)",
        r"(?:count|total\s+number\s+of)\s+(?:the\s+)?(?:pdf|pdfs|document|documents|file|files|source|sources)",
        r"count\s+(?:the\s+)?number\s+of\s+(?:the\s+)?(?:pdf|pdfs|document|documents|file|files)",
        r"what\s+is\s+the\s+(?:total\s+)?number\s+of\s+(?:pdf|pdfs|document|documents|file|files)",
        r"number\s+of\s+(?:pdf|pdfs|document|documents)\s+(?:in|does|do)\s+(?:the\s+)?(?:system|you|registry|corpus)",
    ]
)
NAMED_SCOPE = r"(?i)(?:\b(?:UN[\s_-]?R\d{2,3}|R\d{2,3}\b|FMVSS|Euro\s*NCAP|NHTSA|UNECE|annex|section|clause)\b|§)"


def intent(query: Column) -> Column:
    meta = query.rlike(CORPUS_META) & ~query.rlike(NAMED_SCOPE)
    return F.when(query.rlike(IDENTITY), "identity").when(query.rlike(INJECTION), "injection_blocked").when(meta, "corpus_meta").otherwise("regulatory")


def clause_search(clauses: DataFrame, term: str, code: str | None = None, most: int = 20) -> DataFrame:
    """(place, code, section, doc_id, linked_clause, snippet): clauses with a section and a readable limit in which a term occurs.

    The term is looked for in text, section and code, regardless of case; shorter ones than two characters find nothing. Filters
    come before the cut; of clauses with one code and section the smallest doc_id stays.
    """
    term = term.strip().lower()
    if len(term) < 2:
        clauses = clauses.where(F.lit(False))
    rows = clauses.where(F.coalesce(F.col("section") != "", F.lit(False)))
    if code is not None:
        rows = rows.where(F.col("code") == code)
    rows = rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(term)), F.lit(False)) for c in ("text", "section", "code")]))
    found = {f"_{c}": F.lit(c) for c in RESOLVABLE}
    rows = with_limits(rows, "text", found).where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in found])).drop(*found)
    once = rows.groupBy("code", "section").agg(F.min_by(F.struct("doc_id", "text"), F.struct("doc_id", "text")).alias("c"))
    # one list for the whole corpus: ordered and cut before it is numbered, so each task hands on no more than the cut
    few = once.orderBy("code", "section").limit(most)
    place = F.row_number().over(Window.orderBy("code", "section"))
    return few.select(place.alias("place"), "code", "section", "c.doc_id", F.concat("code", F.lit("#"), "section").alias("linked_clause"), F.replace(F.substring("c.text", 1, 280), F.lit("\n"), F.lit(" ")).alias("snippet"))


def fulltext(queries: DataFrame, corpus: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, rank, doc_id, score): BM25 over words; only words that a question has are counted and shuffled."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    asked = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("query"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))).alias("term"))
    if asked.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} terms in a batch: split it")
    docs = corpus.select("doc_id", words.alias("words")).withColumn("length", F.size("words"))
    hits = docs.select("doc_id", "length", F.explode("words").alias("term")).join(F.broadcast(asked.select("term").distinct()), "term").groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))
    size = docs.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    known = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(size))
    idf = F.ln((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = known.withColumn("part", part).join(F.broadcast(asked), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top(scored, k, F.desc("score"), F.col("doc_id"))


def citations_of(ranked: DataFrame) -> DataFrame:
    """ranked (query_id, rank, code, amendment, document, page_number, section, heading_path, chunk_type, text, perhaps source_kind) -> what an answer cites.

    Ids count from S1; an empty section gives way to the heading path; snippets have 400 characters.
    """
    given = F.col("source_kind") if "source_kind" in ranked.columns else F.lit(None).cast("string")
    kind = F.coalesce(F.nullif(given, F.lit("")), F.when(F.col("chunk_type") == "test_record", "harness_test").otherwise("regulation_corpus"))
    section = F.coalesce(F.nullif(F.col("section"), F.lit("")), F.col("heading_path"))
    return ranked.select("query_id", "rank", F.concat(F.lit("S"), F.col("rank")).alias("id"), kind.alias("source_kind"), "code", "document", "page_number", section.alias("section"), "amendment", F.substring(F.coalesce("text", F.lit("")), 1, 400).alias("snippet"))


def context_of(ranked: DataFrame) -> DataFrame:
    """(query_id, passages, context): the evidence of each question in order of rank, each passage under its number."""
    head = F.format_string("[S%d] Regulation: %s | Amendment: %s\nDocument: %s | Page: %s\n", F.col("rank").cast("int"), F.col("code"), F.col("amendment"), F.col("document"), F.col("page_number").cast("string"))
    part = F.struct("rank", F.concat(head, F.coalesce("text", F.lit("")), F.lit("\n\n")).alias("passage"))
    return ranked.groupBy("query_id").agg(F.count("*").alias("passages"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["passage"]), "").alias("context"))


def within_budget(passages: DataFrame, group: str, order: str, tokens: int = 3500, most: int = 6) -> DataFrame:
    """The first passages of a group whose estimated tokens fit; tokens = max(1, floor(words * 1.33))."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    need = F.greatest(F.lit(1), F.floor(words * 1.33)).cast("long")
    w = Window.partitionBy(group).orderBy(order)
    rows = passages.withColumn("tokens", need).withColumn("place", F.row_number().over(w)).withColumn("running", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("place") <= most) & (F.col("running") <= tokens))
