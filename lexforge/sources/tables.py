"""Table and file sources: Parquet tables by name, records, manifests, URL lists, page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


RESULT = "struct<channel:string,filter_class:string,peak_value:double,injury_criterion:string,value:double,unit:string,linked_regulation_clause:string>"
RECORD = f"test_id string, program string, date string, test_type string, impact_mode string, dummy string, confidential_tier boolean, owner string, channel string, filter_class string, peak_value double, injury_criterion string, value double, unit string, linked_regulation_clause string, results array<{RESULT}>"


def test_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON test records, one object or a list to a file; flat records get one result."""
    rows = spark.read.json(path, schema=RECORD, multiLine=True)
    flat = ["channel", "filter_class", "peak_value", "injury_criterion", "value", "unit", "linked_regulation_clause"]
    return rows.withColumn("results", F.coalesce("results", F.array(F.struct(*flat)))).drop(*flat)


def staged_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, code, amendment) of a JSON staging manifest, with the aliases that its fields may have."""
    fields = "filename string, file string, regulation_code string, regulation string, reg_code string, amendment string, series string"
    whole = spark.read.json(path, multiLine=True, schema=f"files array<struct<{_typed(fields)}>>, mappings array<struct<{_typed(fields)}>>, {fields}")
    bare = F.array(F.struct(*[x.split()[0] for x in fields.split(", ")]))
    rows = whole.select(F.explode(F.coalesce("files", "mappings", bare)).alias("x")).select("x.*")
    name = F.lower(F.regexp_replace(F.coalesce("filename", "file"), r"^.*[/\\]", ""))
    return rows.select(name.alias("file_name"), F.coalesce("regulation_code", "regulation", "reg_code").alias("code"), F.coalesce("amendment", "series").alias("amendment")).where("file_name is not null")


def _typed(fields: str) -> str:
    return ",".join(f.replace(" ", ":") for f in fields.split(", "))


def scanned_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, file_hash, authority) of a folder tree; the authority comes from the path's parts. Empty files are not listed."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    low = F.lower("path")
    authority = F.when(low.contains("unece"), "UNECE").when(low.contains("ncap"), "NCAP").when(low.contains("nhtsa") | low.contains("fmvss"), "NHTSA").when(low.contains("iihs"), "IIHS").otherwise("OTHER")
    return rows.select("path", "length", F.sha2("content", 256).alias("file_hash"), authority.alias("authority"))


def expected_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(authority, code, title, area, priority) of an expected-coverage YAML file."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    found = yaml.safe_load(text[0])["authorities"] if text else {}
    rows = [(a, r["id"], r.get("title"), r.get("area"), r.get("priority")) for a, x in found.items() for r in x.get("regulations", [])]
    return spark.createDataFrame(rows, "authority string, code string, title string, area string, priority string")


def canonical_path(source, code, amendment, file_hash):
    """Column: source_code_amendment-hash.pdf, other signs turned to underscores; the hash keeps versions apart."""
    name = F.regexp_replace(F.concat_ws("_", source, code, amendment), r"[^A-Za-z0-9]+", "_")
    return F.concat(name, F.lit("-"), F.substring(file_hash, 1, 8), F.lit(".pdf"))


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace-by-key write: only the partitions that df has are written anew, in one commit."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


#: Fixed value: what a part of a storage path may be.
SAFE_SEGMENT = r"^[a-zA-Z0-9_-]{1,128}\z"


def safe_segment(part):
    """Column: whether a value may be a part of a storage path; null and empty ones may not."""
    return F.coalesce(part.rlike(SAFE_SEGMENT), F.lit(False))


def stored_path(root: str, *parts):
    """Column: root and parts as a path; null where a part is not safe, so no path leads out of the root."""
    fine = F.lit(True)
    for p in parts:
        fine = fine & safe_segment(p)
    return F.when(fine, F.concat_ws("/", F.lit(root.rstrip("/")), *parts))
