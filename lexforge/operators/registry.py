"""The registry as tables: versions with their closing, manifests, removal of documents, gates with logs, offline batches, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.sizes import small
from lexforge.functions.text import fingerprint
from lexforge.operators import documents as D
from lexforge.operators import records as H


def apply_versions(registry: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """(version_id, keys, file_hash, status, closed_by): the registry after a batch that has one row at most for each value of keys.

    Keys are compared null-safe. A new hash closes the active version of its keys and becomes the active one; an equal hash changes nothing.
    """
    cols = ["version_id", *keys, "file_hash"]
    old = registry.select(*cols, "status").withColumn("_active", F.col("status") == "ACTIVE")
    # a key may have several active versions: one row for them decides, and a change closes all of them
    held = old.where("_active").groupBy(*keys).agg(F.max(F.col("file_hash").isNull()).alias("_null"), F.collect_set("file_hash").alias("_hashes")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_null", "_hashes")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    known = F.when(F.col("file_hash").isNull(), F.col("_null")).otherwise(F.array_contains("_hashes", F.col("file_hash")))
    fresh = incoming.select(*cols).join(held, same, "left").where(~F.coalesce(known, F.lit(False))).select(*cols)
    closing = fresh.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("version_id").alias("_by"))
    met = old.join(closing, same & F.col("_active"), "left")
    status = F.when(F.col("_by").isNotNull(), "SUPERSEDED").otherwise(F.col("status"))
    return met.select(*cols, status.alias("status"), F.col("_by").alias("closed_by")).union(fresh.select(*cols, F.lit("ACTIVE"), F.lit(None).cast(dict(incoming.dtypes)["version_id"])))


def upsert_manifest(manifest: DataFrame, items: DataFrame) -> DataFrame:
    """(source_url, text_hash, first_seen, change): the manifest after items (source_url, text_hash, seen), one per URL; rows without an item are kept."""
    old = manifest.select("source_url", F.col("text_hash").alias("_hash"), "first_seen")
    both = old.join(items.select("source_url", "text_hash", "seen"), "source_url", "full_outer")
    change = F.when(F.col("seen").isNull(), "KEPT").when(F.col("first_seen").isNull(), "NEW").when(F.col("_hash").eqNullSafe(F.col("text_hash")), "DUPLICATE").otherwise("CHANGED")
    kept = F.when(F.col("seen").isNull(), F.col("_hash")).otherwise(F.col("text_hash"))
    return both.select("source_url", kept.alias("text_hash"), F.coalesce("first_seen", "seen").alias("first_seen"), change.alias("change"))


def without(rows: DataFrame, gone: DataFrame, key: str, gone_key: str = "doc_id") -> DataFrame:
    """rows whose key isn't among the removed ids; rows without a key stay."""
    return rows.join(gone.select(F.col(gone_key).alias(key)).distinct(), key, "left_anti")


#: Stages of the gate in their order.
STAGES = ("allowlist", "validate", "tracker")


def gate(items: DataFrame) -> DataFrame:
    """items (allowed, checked: an outcome of documents.validate, change: of documents.classify_changes) with the stage that settles them, outcome and reason."""
    stage = F.when(~F.col("allowed"), "allowlist").when(F.col("checked") != "ACCEPTED", "validate").otherwise("tracker")
    refused = F.when(F.startswith("checked", F.lit("NEEDS_OCR")), "needs_ocr").otherwise("rejected")
    outcome = F.when(stage == "allowlist", "rejected").when(stage == "validate", refused).otherwise(F.lower("change"))
    reason = F.when(stage == "allowlist", "domain not allowed").when(stage == "validate", F.regexp_replace("checked", "^[A-Z_]+: ", ""))
    return items.withColumn("stage", stage).withColumn("outcome", outcome).withColumn("reason", reason)


def gate_log(gated: DataFrame) -> DataFrame:
    """(stage, outcome, items): what every stage that an item passed through said of it; a stage before the last one says passed."""
    at = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage")).cast("int")
    lines = F.transform(F.slice(F.array(*[F.lit(s) for s in STAGES]), F.lit(1), at), lambda s: F.struct(s.alias("stage"), F.when(s == F.col("stage"), F.col("outcome")).otherwise("passed").alias("outcome")))
    return gated.select(F.explode(lines).alias("l")).groupBy("l.stage", "l.outcome").agg(F.count("*").alias("items"))


def offline_batch(files: DataFrame, expected: DataFrame, stored: DataFrame) -> DataFrame:
    """files (file_id, code, file_hash, text_hash, checked) with status UNMAPPED, DUPLICATE, REJECTED or ACCEPTED, the first that holds.

    expected: code; stored: file_hash, text_hash of what is there. Of files of a batch with one hash the smallest file_id isn't a duplicate of the others.
    """
    known = expected.select("code").distinct().withColumn("_mapped", F.lit(True))
    by_file, by_text = (stored.select(F.col(c).alias(c)).where(F.col(c).isNotNull()).distinct().withColumn(f"_{c}", F.lit(True)) for c in ("file_hash", "text_hash"))
    rows = files.join(known, "code", "left").join(by_file, "file_hash", "left").join(by_text, "text_hash", "left")
    mapped = F.coalesce("_mapped", F.lit(False))
    # the first file of a hash by an aggregate with map-side combine: no task holds all copies
    fine = mapped & (F.col("checked") == "ACCEPTED") & F.col("_file_hash").isNull()
    first = rows.where(mapped & F.col("file_hash").isNotNull()).groupBy("file_hash").agg(F.min("file_id").alias("_first"))
    first_text = rows.where(fine & F.col("text_hash").isNotNull()).groupBy("text_hash").agg(F.min("file_id").alias("_first_text"))
    rows = rows.join(first, "file_hash", "left").join(first_text, "text_hash", "left")
    copy = F.coalesce("_file_hash", F.col("_first") < F.col("file_id"), F.lit(False))
    copy_text = F.coalesce("_text_hash", F.col("_first_text") < F.col("file_id"), F.lit(False))
    status = F.when(~mapped, "UNMAPPED").when(copy, "DUPLICATE").when(F.col("checked") != "ACCEPTED", "REJECTED").when(copy_text, "DUPLICATE").otherwise("ACCEPTED")
    return rows.withColumn("status", status).select("file_id", "code", "status")


def series_of(amendment: Column) -> Column:
    """The first number of an amendment in two digits, else its trimmed text."""
    number = F.nullif(F.regexp_extract(amendment, r"(\d+)", 1), F.lit(""))
    return F.coalesce(F.lpad(number.cast("int").cast("string"), 2, "0"), F.nullif(F.trim(amendment), F.lit("")))


def amendment_audit(rows: DataFrame) -> DataFrame:
    """rows (amendment as the text says it, file_name) with from_filename and mismatch, true only where both are known and differ."""
    series = D.parse_filename(F.col("file_name"))["series"]
    from_name = F.when(series.isNotNull(), F.concat(F.lpad(series.cast("string"), 2, "0"), F.lit(" Series")))
    return rows.withColumn("from_filename", from_name).withColumn("mismatch", F.coalesce(series_of(F.col("amendment")) != series_of(F.col("from_filename")), F.lit(False)))


# ---------------------------------------------------------------- tests beside their clauses

#: Impact modes by the word of a question, criteria likewise, and what a test's id looks like.
MODES = [("FRONTAL", ["FRONTAL_OFFSET"]), ("SIDE", ["SIDE_MDB", "POLE_SIDE"])]
CRITERIA = [("THCC", "ThCC"), ("HIC", "HIC36")]
MOST_QUESTIONS = 10_000
TEST_ID = r"\b(TEST-\d{4}-\d{2}-\d{3})\b"


def tests_with_clauses(questions: DataFrame, tests: DataFrame, results: DataFrame, clauses: DataFrame, user: str | None) -> DataFrame:
    """(query_id, test_id, position, criterion, value, link, section, text): results that a question's words ask for, beside the clause they are linked to.

    The first word of each kind that a question has filters; without any it gets all visible results. Results of hidden tests never show.
    A link that leads nowhere keeps its row; of a section's clauses the smallest clause_id counts. Questions are at most MOST_QUESTIONS, a block that every visible result is held against.
    """
    q = F.upper("query")

    def wanted(choices: list[tuple[str, object]]) -> Column:
        out = F.lit(None)
        for word, value in reversed(choices):
            out = F.when(F.contains(q, F.lit(word)), F.array(*[F.lit(v) for v in (value if isinstance(value, list) else [value])])).otherwise(out)
        return out

    asked = questions.select("query_id", wanted(MODES).alias("modes"), wanted(CRITERIA).alias("criteria"), F.nullif(F.regexp_extract(q, TEST_ID, 1), F.lit("")).alias("asked_id"))
    seen = tests.where(H.visible(user, F.col("confidential"), F.col("owner"))).select("test_id", "impact_mode").join(results, "test_id")
    fits = (F.col("modes").isNull() | F.array_contains("modes", F.col("impact_mode"))) & (F.col("criteria").isNull() | F.array_contains("criteria", F.col("criterion"))) & (F.col("asked_id").isNull() | (F.col("asked_id") == F.col("test_id")))
    rows = seen.join(small(asked, MOST_QUESTIONS, "questions"), fits)
    once = clauses.groupBy(F.concat("code", F.lit("#"), "section").alias("link")).agg(F.min_by(F.struct("section", "text"), "clause_id").alias("c"))
    return rows.join(once, "link", "left").select("query_id", "test_id", "position", "criterion", "value", "link", "c.section", "c.text")


# ---------------------------------------------------------------- evaluation

#: What an answer says that refuses, and what marks a regulation that isn't there.
REFUSALS = ("couldn't find", "could not find", "cannot find", "can't find", "not found", "not in the", "not available", "do not contain", "does not contain", "no relevant", "not present in the sources", "not present in the", "i'm sorry, but", "i am sorry, but")
ABSENT = r"(?i)\b(?:R\s*)?999\b|nonexistent|not in the ingested|not in (?:the )?corpus"


def refusal_is_correct(expected: Column, question: Column, truth: Column, answer: Column, evidence_only: Column) -> Column:
    """Whether an answer rightly refuses; null where no refusal is expected."""
    text = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    raw, asked = F.coalesce(answer, F.lit("")), F.contains(question, F.lit("999"))
    says = F.exists(F.array(*[F.lit(p) for p in REFUSALS]), lambda p: F.contains(text, p))
    invented = asked & (raw.rlike(r"(?i)\b\d+\s*mm\b") | (raw.rlike(r"(?i)\bUN[\s_-]?R?\d+") & ~F.contains(raw, F.lit("999"))))
    both = F.coalesce(truth, F.lit("")).rlike(ABSENT) & raw.rlike(ABSENT)
    held = F.when((text == "") & evidence_only, True).when(says, True).when(both, True).when(invented, False).otherwise((F.char_length(text) < 20) | F.contains(text, F.lit("sorry")))
    return F.when(F.coalesce(expected, F.lit(False)), held)


def compare_runs(flat: DataFrame, structured: DataFrame) -> DataFrame:
    """(case_id, outcome) of two runs (case_id, passed)."""
    both = flat.select("case_id", F.col("passed").alias("a")).join(structured.select("case_id", F.col("passed").alias("b")), "case_id")
    return both.select("case_id", F.when(F.col("b") & ~F.col("a"), "structure_wins").when(F.col("a") & ~F.col("b"), "flat_wins").when(F.col("a") & F.col("b"), "tie").otherwise("both_fail").alias("outcome"))


def run_comparison(flat: DataFrame, structured: DataFrame) -> DataFrame:
    """One row: passed and recall of both runs, wins, ties, and whether the structured run may replace the flat one."""
    both = flat.select("case_id", F.col("passed").alias("a")).join(structured.select("case_id", F.col("passed").alias("b")), "case_id").join(compare_runs(flat, structured), "case_id")
    n, a, b = F.count("*"), F.count_if("a"), F.count_if("b")

    def of(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    recall = [F.when(n == 0, 0.0).otherwise(F.round(x / n, 3)) for x in (a, b)]
    return both.agg(n.alias("total"), a.alias("flat_passed"), b.alias("structured_passed"), recall[0].alias("flat_recall"), recall[1].alias("structured_recall"), of("structure_wins").alias("structure_wins"), of("flat_wins").alias("flat_wins"), of("tie").alias("ties"), ((of("flat_wins") == 0) & (b == n)).alias("approval_ready"))


def diff_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case_id, before, after, same, jaccard): how the contexts (case_id, context) of two runs differ, by their fingerprints, each counted once a case.

    A case of one run alone has a Jaccard of 0. Fingerprints meet in one aggregate with map-side combine, so no case's list is ever gathered.
    """
    sides = [rows.select("case_id", fingerprint(F.col("context")).alias("mark"), F.lit(side).alias("side")) for side, rows in enumerate((before, after))]
    marks = sides[0].union(sides[1]).groupBy("case_id", "mark").agg(F.bool_or(F.col("side") == 0).alias("old"), F.bool_or(F.col("side") == 1).alias("new"))
    same = F.count_if(F.col("old") & F.col("new"))
    return marks.groupBy("case_id").agg(F.count_if("old").alias("before"), F.count_if("new").alias("after"), same.alias("same"), F.round(same / F.count("*"), 6).alias("jaccard"))


def diff_summary(diffs: DataFrame) -> DataFrame:
    """One row of diff_runs(): cases, those that are identical, the mean Jaccard, and how many contexts were added and removed."""
    return diffs.agg(F.count("*").alias("cases"), F.count_if(F.col("jaccard") == 1).alias("identical"), F.round(F.avg("jaccard"), 4).alias("mean_jaccard"), F.sum(F.col("after") - F.col("same")).alias("added"), F.sum(F.col("before") - F.col("same")).alias("removed"))
