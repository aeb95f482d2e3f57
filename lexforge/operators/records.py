"""Test records against the clause in force: limits, as-of links, verdicts, headroom, visibility, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.sizes import small

#: What a limit looks like, words near it that make it a floor or a ceiling, and words that name a criterion.
LIMIT = r"(\d+(?:\.\d+)?)\s*(mm|g|kn|ms)\b"
FLOOR_WORDS = ("above", "greater than", "greater", "minimum", "min", "at least", "stay above", "more than", "exceeds")
CEILING_WORDS = ("not exceed", "not to exceed", "less than", "less", "maximum", "max", "below", "limit")
AROUND = 60
THORAX_WORDS, HEAD_WORDS = ("thcc", "thorax", "chest", "deflection", "compression"), ("hic", "head", "injury")
CEILING_BY_DEFAULT = ("hic", "hic36", "thcc")


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def criterion_fits(criterion: Column, text: Column) -> Column:
    """Whether a clause speaks of a criterion: by the words of thorax or head, else by its name."""
    return _fits(F.lower(criterion), F.lower(text))


def _fits(name: Column, low: Column) -> Column:
    return F.when(name == "thcc", any_word(low, THORAX_WORDS)).when(name.isin("hic", "hic36"), any_word(low, HEAD_WORDS)).otherwise(F.contains(low, name))


KIND = "struct<value:double,direction:string,unit:string>"


def _near(low: Column, hit: Column, at: Column) -> Column:
    """What stands within AROUND characters of a hit on either side."""
    before = F.substring(low, F.greatest(F.lit(1), at - AROUND), F.least(F.lit(AROUND), at - 1))
    return F.concat(before, F.lit(" "), F.substring(low, at + F.char_length(hit), F.lit(AROUND)))


def _limit(name: Column, low: Column, hit: Column, floor: Column, ceiling: Column) -> Column:
    def known(value: float, unit: str) -> Column:
        return F.struct(F.lit(value).alias("value"), F.lit("ceiling").alias("direction"), F.lit(unit).alias("unit")).cast(KIND)

    direction = F.when(floor & ~ceiling, "floor").when(ceiling & ~floor, "ceiling").when(name.isin(*CEILING_BY_DEFAULT), "ceiling")
    number, unit = F.regexp_extract(hit, LIMIT, 1).cast("double"), F.regexp_extract(hit, LIMIT, 2)
    given = F.when(direction.isNotNull(), F.struct(number.alias("value"), direction.alias("direction"), unit.alias("unit")).cast(KIND))
    default = F.when((name == "thcc") & F.contains(low, F.lit("94")), known(42.0, "mm")).when(name.isin("hic", "hic36"), known(1000.0, "none"))
    return F.when(_fits(name, low), F.when(hit != "", given).otherwise(default))


def limit(text: Column, criterion: Column) -> Column:
    """struct(value, direction, unit) of the first number with a unit in a clause that speaks of the criterion, else null.

    Words within 60 characters on either side make it a floor or a ceiling; where they make it both or neither, it is a ceiling for head
    and thorax and no limit for others. Without a number thorax clauses that name 94 have 42 mm, and head clauses 1000 without a unit.
    Over whole tables with_limits() does the same with less work.
    """
    low = F.lower(text)
    hit = F.regexp_extract(low, LIMIT, 0)
    near = _near(low, hit, F.regexp_instr(low, F.lit(LIMIT)))
    return _limit(F.lower(criterion), low, hit, near.rlike("|".join(FLOOR_WORDS)), near.rlike("|".join(CEILING_WORDS)))


def with_limits(rows: DataFrame, text: str, criteria: dict[str, Column]) -> DataFrame:
    """rows with a column of limit() for each criterion. The text is lowered, searched and cut once for all of them. Names that start with _lim are reserved."""
    low, hit, near = F.col("_lim_low"), F.col("_lim_hit"), F.col("_lim_near")
    found = rows.withColumn("_lim_low", F.lower(text)).withColumn("_lim_hit", F.regexp_extract(low, LIMIT, 0)).withColumn("_lim_at", F.when(hit != "", F.regexp_instr(low, F.lit(LIMIT))))
    found = found.withColumn("_lim_near", _near(low, hit, F.col("_lim_at"))).withColumn("_lim_floor", any_word(near, FLOOR_WORDS)).withColumn("_lim_ceiling", any_word(near, CEILING_WORDS))
    told = [_limit(F.lower(c), low, hit, F.col("_lim_floor"), F.col("_lim_ceiling")).alias(name) for name, c in criteria.items()]
    # a generator of one row: filters on the limits stay above it, and are not pushed down with all of this inside them
    return found.select(*[c for c in rows.columns if c not in criteria], F.inline(F.array(F.struct(*told))))


def verdict(value: Column, limit_value: Column, direction: Column) -> Column:
    return F.when(value.isNull() | limit_value.isNull() | direction.isNull(), None).when(F.when(direction == "floor", value >= limit_value).otherwise(value <= limit_value), "PASS").otherwise("FAIL")


def headroom(value: Column, limit_value: Column, direction: Column) -> Column:
    return F.round(F.when(direction == "floor", value - limit_value).otherwise(limit_value - value), 4)


def headroom_percent(value: Column, limit_value: Column) -> Column:
    """Absolute, also when over the limit; 0 when the limit is 0."""
    return F.when(limit_value == 0, 0.0).otherwise(F.round(F.abs(limit_value - value) / limit_value * 100, 2))


def tightness(percent: Column) -> Column:
    return F.when(percent <= 0, "over").when(percent < 10, "tight").when(percent < 20, "close").otherwise("clear")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, row: str, tie: str) -> DataFrame:
    """left with the latest right row of its key at or before its time; rows without one stay, with nulls.

    Both sides go through one shuffle by key and one ordered window, so no pair of rows is ever built.
    """
    cols = [c for c in right.columns if c != key]
    made = F.struct(*cols)
    a = left.select(F.col(key), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_tie"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(made).schema[0].dataType).alias("_right"))
    b = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("bigint").alias("_tie"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), made.alias("_right"))
    w = Window.partitionBy(key).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = a.union(b).withColumn("_last", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_left.*", *[F.col("_last")[c].alias(c) for c in cols])


def latest(versions: DataFrame, key: str, date: str, tie: str) -> DataFrame:
    """The last version of each key, undated ones only where there is no other."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(date), tie)
    return versions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def visible(user: str | None, confidential: Column, owner: Column) -> Column:
    """Public rows, and confidential ones of their owner; without an owner they are hidden."""
    own = F.coalesce(owner == F.lit(user), F.lit(False)) if user is not None else F.lit(False)
    return ~F.coalesce(confidential, F.lit(True)) | own


def first_error(checks: list[tuple[Column, str]]) -> Column:
    """The reason of the first check that holds, in order; null if none."""
    out = F.lit(None).cast("string")
    for fails, reason in reversed(checks):
        out = F.when(fails, reason).otherwise(out)
    return out


def settle_records(results: DataFrame) -> DataFrame:
    """(record_id, outcome, reason) of results (record_id, position, reason): one failing result refuses the whole record; schema and date errors end as FAILED."""
    reason = F.min_by("reason", F.when(F.col("reason").isNotNull(), F.struct("position", "reason")))
    rows = results.groupBy("record_id").agg(reason.alias("reason"), F.count("*").alias("n_results"))
    outcome = F.when(F.col("reason").isNull(), "ACCEPTED").when(F.col("reason").rlike("^(schema|date)"), "FAILED").otherwise("REFUSED")
    return rows.withColumn("outcome", outcome)


#: Days of a stretch of time that versions are looked up by; parts of the results of one clause.
STRETCH, SPREAD = 32, 64


def in_force(rows: DataFrame, versions: DataFrame, code: str, day: str) -> DataFrame:
    """rows with the version_id that is in force for a code on a day: null before the first version, and where code or day is null.

    versions: version_id, code, effective; each one holds until the next of its code (of equal days the greater version_id). The last one of a code is
    looked up by code. Those before are listed for every stretch of STRETCH days that they hold in, so a row meets only the versions of
    its own stretch in an equi-join, and a code that many rows have is many keys.
    """
    until = F.lead("effective").over(Window.partitionBy("code").orderBy("effective"))
    days = versions.where("code IS NOT NULL AND effective IS NOT NULL").groupBy("code", "effective").agg(F.max("version_id").alias("version_id"))
    spans = days.withColumn("_until", until)
    spans = spans.select(F.col("code").alias("_code"), F.col("version_id").alias("_version"), F.col("effective").alias("_from"), "_until")

    def stretch(c: Column) -> Column:
        return F.floor(F.unix_date(c) / STRETCH).cast("int")

    last = spans.where("_until IS NULL").select(F.col("_code").alias("_open"), F.col("_from").alias("_open_from"), F.col("_version").alias("_open_version"))
    past = spans.where("_until IS NOT NULL").withColumn("_stretch", F.explode(F.sequence(stretch(F.col("_from")), stretch(F.date_sub("_until", 1)))))
    met = rows.withColumn("_at", stretch(F.col(day))).join(last, F.col(code) == F.col("_open"), "left")
    holds = (F.col(code) == F.col("_code")) & (F.col("_at") == F.col("_stretch")) & (F.col(day) >= F.col("_from")) & (F.col(day) < F.col("_until"))
    version = F.when(F.col(day) >= F.col("_open_from"), F.col("_open_version")).otherwise(F.col("_version"))
    return met.join(past, holds, "left").withColumn("version_id", version).drop("_at", "_open", "_open_from", "_open_version", "_code", "_version", "_from", "_until", "_stretch")


def link_results(results: DataFrame, versions: DataFrame, clauses: DataFrame) -> DataFrame:
    """Results against the clause in force on the day of their test, with verdict and headroom or the first reason to refuse them.

    results: record_id, position, test_date (text), criterion, value, unit, link (CODE#SECTION); versions: version_id, code, effective;
    clauses: clause_id, version_id, section, text, of which the smallest clause_id of a section counts. The version is that of in_force().

    Codes are few and results many, so results never meet a table by code, or by a version that most have or lack: clauses are looked up for each
    distinct code, day and section, and results meet them by all three.
    """
    known = versions.groupBy("code").agg(F.min("effective").alias("earliest"), F.max(F.col("effective").isNull()).alias("undated"))
    once = clauses.groupBy("version_id", "section").agg(F.min_by("text", "clause_id").alias("text"))
    day = F.when(F.col("test_date").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp("test_date", F.lit("yyyy-M-d")).cast("date"))
    rows = results.withColumn("day", day).withColumn("code", F.nullif(F.regexp_extract("link", "^([^#]*)#", 1), F.lit(""))).withColumn("section", F.regexp_extract("link", "(?s)^[^#]*#(.*)$", 1))
    asked = rows.where("code IS NOT NULL AND day IS NOT NULL").select("code", "day", "section").distinct().join(known, "code")
    asked = in_force(asked, versions, "code", "day").join(once, ["version_id", "section"], "left")
    rows = with_limits(rows.join(asked, ["code", "day", "section"], "left"), "text", {"lim": F.col("criterion")})
    checks = [
        (F.col("criterion").isNull() | F.col("value").isNull() | F.col("test_date").isNull(), "schema: incomplete result"),
        (F.col("day").isNull(), "date: not YYYY-MM-DD"),
        (~F.coalesce(F.contains("link", F.lit("#")), F.lit(False)), "link is not CODE#SECTION"),
        (F.col("undated").isNull(), "regulation not found"),
        (F.col("undated"), "a version has no date"),
        (F.col("day") < F.col("earliest"), "test is before the first version"),
        (F.col("text").isNull(), "clause not found"),
        (F.col("lim").isNull(), "limit not readable"),
        (F.coalesce(F.lower("unit") != F.col("lim.unit"), F.lit(False)), "unit mismatch"),
    ]
    x, how = F.col("lim.value"), F.col("lim.direction")
    out = rows.withColumn("reason", first_error(checks))
    fine = F.col("reason").isNull()
    return out.select("record_id", "position", "version_id", "criterion", "value", x.alias("limit_value"), how.alias("direction"), F.when(fine, verdict(F.col("value"), x, how)).alias("verdict"), F.when(fine, headroom(F.col("value"), x, how)).alias("headroom"), "reason")


def close_to_limits(results: DataFrame, tests: DataFrame, versions: DataFrame, clauses: DataFrame, user: str | None, fallback: float, n: int = 5, direction: str = "ceiling") -> DataFrame:
    """(place, record_id, position, criterion, value, limit_value, headroom, percent, verdict, link): the n visible results with the least headroom to their limits.

    results: record_id, position, criterion, value, link; tests: record_id, confidential, owner, at most one of a record. A result's limit is that of its linked clause in the latest version
    of its code, where that has one in millimetres; with another unit it takes no part; where no limit can be read the fallback stands. A result without a
    test is visible, one without a criterion is the thorax's, one without a value takes no part. Ties go to the smaller record_id and position.
    """
    now = latest(versions.where("code IS NOT NULL"), "code", "effective", "version_id").select(F.col("code").alias("_code"), F.col("version_id").alias("_version"))
    once = clauses.groupBy(F.col("version_id").alias("_of"), F.col("section").alias("_section")).agg(F.min_by("text", "clause_id").alias("_text"))
    owned = tests.select(F.col("record_id").alias("_record"), "confidential", "owner")
    rows = results.where("value IS NOT NULL").join(owned, F.col("record_id") == F.col("_record"), "left")
    rows = rows.where(F.col("_record").isNull() | visible(user, F.col("confidential"), F.col("owner")))
    rows = rows.select("record_id", "position", F.coalesce("criterion", F.lit("ThCC")).alias("criterion"), "value", "link", F.regexp_extract("link", "^([^#]*)#", 1).alias("_c"), F.regexp_extract("link", "(?s)^[^#]*#(.*)$", 1).alias("_s"))
    # few clauses of many results: each is looked up once and dealt out SPREAD times, so no task has all results of one
    asked = rows.select("_c", "_s").distinct().join(now, F.col("_c") == F.col("_code"))
    asked = asked.join(once, (F.col("_version") == F.col("_of")) & (F.col("_s") == F.col("_section"))).select("_c", "_s", "_text", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_nth"))
    rows = rows.withColumn("_nth", F.pmod(F.xxhash64("record_id", "position"), F.lit(SPREAD)).cast("int")).join(asked, ["_c", "_s", "_nth"], "left")
    rows = with_limits(rows, "_text", {"_found": F.col("criterion")})
    known = F.col("_found.value").isNotNull() & F.col("_found.direction").isNotNull()
    rows = rows.where(~known | (F.col("_found.unit") == "mm"))
    rows = rows.withColumn("limit_value", F.when(known, F.col("_found.value")).otherwise(F.lit(float(fallback)))).withColumn("_way", F.when(known, F.col("_found.direction")).otherwise(direction))
    value, bound, way = F.col("value"), F.col("limit_value"), F.col("_way")
    percent = F.when(bound == 0, 0.0).otherwise(F.round(F.abs(bound - value) / bound * 100, 2))
    rows = rows.select("record_id", "position", "criterion", "value", "limit_value", headroom(value, bound, way).alias("headroom"), percent.alias("percent"), verdict(value, bound, way).alias("verdict"), "link")
    # ordered and cut before it is numbered: each task hands on n rows
    few = rows.orderBy("headroom", "record_id", "position").limit(n)
    return few.select(F.row_number().over(Window.orderBy("headroom", "record_id", "position")).alias("place"), *rows.columns)


def model_allowed(model: Column) -> Column:
    """Confidential rows may go to local and contracted models only."""
    low = F.lower(model)
    return F.when(low.rlike("free|gemini"), False).when(low.rlike("ollama|local|groq|anthropic"), True).otherwise(False)


# ---------------------------------------------------------------- evaluation


def jaccard(a: Column, b: Column) -> Column:
    """1.0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


#: Cases of a batch, which are broadcast; pipes of a table where a case does not say.
MOST_CASES, MIN_PIPES = 10_000, 20


def check_cases(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, found, codes_ok, together, clean, table_ok, retrieved, passed) of cases against their hits (case_id, code, chunk_type, text).

    cases: case_id, must_contain, together, must_not, codes (arrays, each may be null or empty), needs_table, min_pipes (may be null). found: each wanted term is in some hit; together: one hit has all of
    them; clean: no unwanted term is in a hit, as a word, or as it stands where it begins or ends with a space; codes_ok: all expected codes are among
    the hits', or there are hits where none is expected; table_ok: one hit has so many pipes, is a table or has a table's rule, and has the terms that belong together.
    A case has 31 terms and 31 codes at most. Hits of a case are combined in each task before they are shuffled; a case without hits stays.
    """
    none = F.array().cast("array<string>")
    told = cases.select("case_id", *[F.coalesce(c, none).alias(c) for c in ("must_contain", "together", "must_not", "codes")], F.coalesce("needs_table", F.lit(False)).alias("needs_table"), F.coalesce("min_pipes", F.lit(MIN_PIPES)).alias("min_pipes"))
    # an empty hit for each case keeps those without hits and changes no other
    rows = hits.select("case_id", "code", "chunk_type", F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("hit")).union(told.select("case_id", F.lit(None), F.lit(None), F.lit(""), F.lit(0)))
    rows = rows.join(small(told, MOST_CASES, "cases"), "case_id").withColumn("low", F.lower("text"))

    def bits(wanted: str, there) -> Column:
        """A bit for each wanted value, by place, so that hits can be or-ed."""
        each = F.transform(wanted, lambda w, i: F.when(there(w), F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
        return F.aggregate(each, F.lit(0), lambda s, x: s.bitwiseOR(x))

    def unwanted(w: Column) -> Column:
        edge = F.startswith(w, F.lit(" ")) | F.endswith(w, F.lit(" "))
        return F.when(edge, F.contains(F.concat(F.lit(" "), "low", F.lit(" ")), F.lower(w))).otherwise(F.regexp_like(F.col("low"), F.concat(F.lit(r"\b\Q"), F.lower(w), F.lit(r"\E\b"))))

    pipes = F.char_length("text") - F.char_length(F.replace("text", F.lit("|"), F.lit("")))
    rows = rows.withColumn("all", (F.col("hit") == 1) & F.forall("together", lambda w: F.contains("low", F.lower(w))))
    rows = rows.withColumn("whole", (pipes >= F.col("min_pipes")) & (F.coalesce(F.col("chunk_type") == "table", F.lit(False)) | F.contains("text", F.lit("| --- |"))) & F.col("all"))
    agg = rows.groupBy("case_id").agg(
        F.bit_or(bits("must_contain", lambda w: F.contains("low", F.lower(w)))).alias("words"), F.bit_or(bits("codes", lambda c: F.coalesce(F.col("code") == c, F.lit(False)))).alias("named"),
        F.bool_or("all").alias("all"), F.bool_or("whole").alias("whole"), F.bool_or(F.exists("must_not", unwanted)).alias("bad"), F.sum("hit").alias("retrieved"),
        F.max(F.size("must_contain")).alias("n_words"), F.max(F.size("codes")).alias("n_codes"), F.max(F.size("together")).alias("n_together"), F.bool_or("needs_table").alias("needs_table"),
    )
    codes_ok = F.when(F.col("n_codes") > 0, F.bit_count("named") == F.col("n_codes")).otherwise(F.col("retrieved") > 0)
    out = agg.select("case_id", (F.bit_count("words") == F.col("n_words")).alias("found"), codes_ok.alias("codes_ok"), ((F.col("n_together") == 0) | F.col("all")).alias("together"), (~F.col("bad")).alias("clean"), (~F.col("needs_table") | F.col("whole")).alias("table_ok"), "retrieved")
    return out.withColumn("passed", F.col("found") & F.col("codes_ok") & F.col("together") & F.col("clean") & F.col("table_ok"))


def streaks(rows: DataFrame, key: str, order: str, bad: str, least: int = 2) -> DataFrame:
    """(key, first_order, length) of runs of bad rows of at least so many: gaps and islands."""
    w = Window.partitionBy(key).orderBy(order)
    good = F.sum(F.when(F.col(bad), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_island", good).where(F.col(bad)).groupBy(key, "_island").agg(F.min(order).alias("first_order"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_island")
