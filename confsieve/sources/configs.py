"""Configuration files, labels and vendor documents as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from confsieve.sources.documents import parse_documents, read_documents

# File patterns in order of precedence, extensions paired with labels.
CONFIG_PATTERNS = ["conf", "cfg", "txt", "rsc", "ini", "xml", "log"]
LABEL_EXTENSIONS = ["conf", "cfg", "json", "xml", "rsc", "ini", "txt"]

VENDOR_DOC_SCHEMA = (
    "vendor string, os_name string, os_version string, topic string, concept_summary string, cli_mode_context string, example_commands string, "
    "key_parameters array<struct<parameter:string,description:string>>, verification_commands array<string>, source_url string, "
    "not_available boolean, deprecated boolean, last_verified_date string"
)
LABEL_SCHEMA = (
    "sample_id string, vendor string, product string, device_type string, device_class string, network_role string, platform string, model string, "
    "routing_capability boolean, l3_capable boolean, ambiguity boolean, contains_secrets boolean, anonymized boolean, "
    "routing_protocols array<string>, capabilities array<string>, controls_present array<string>, controls_absent array<string>, "
    "vulnerability_tags array<string>, ambiguity_reason string, os string, version string, category string, source_type string, source_url string, "
    "license string, configuration_format string, security_state string, security_state_details string, generator_version string, "
    "generation_date string, legacy_device_type string"
)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_binary(content: Column, sniff_bytes: int | None = None) -> Column:
    """A NUL byte anywhere in the file, or in its first ``sniff_bytes`` bytes where that is asked for."""
    head = content if sniff_bytes is None else F.substring(content, 1, sniff_bytes)
    return F.position(F.unhex(F.lit("00")), head) > 0


def decode(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1, which always is; line ends become plain newlines."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def decode_files(files: DataFrame) -> DataFrame:
    """(path, content) to (filename, raw_text): known extensions only, binary files left out, one file per name by pattern order.

    The paths decide which file stands for a name; contents only follow the chosen paths.
    """
    kept = _text_files(files)
    chosen = kept.groupBy("filename").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return kept.join(chosen.select("path"), "path", "left_semi").select("filename", decode(F.col("content")).alias("raw_text"))


def _text_files(files: DataFrame) -> DataFrame:
    rank = F.array_position(F.lit(CONFIG_PATTERNS), extension(F.col("path")))
    return files.where((rank > 0) & ~is_binary(F.col("content"))).select(file_name(F.col("path")).alias("filename"), rank.alias("rank"), "path", "content")


def discover_configs(spark: SparkSession, folder: str) -> DataFrame:
    """Scans a folder, not its subfolders, for configuration files."""
    glob = "*.{" + ",".join(CONFIG_PATTERNS) + "}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    # One folder holds a name once, so there is nothing to choose and nothing to shuffle.
    return _text_files(found).select("filename", decode(F.col("content")).alias("raw_text"))


def load_samples(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Label sidecars ``<stem>.meta.json`` with the first existing configuration of the same stem; broken and lone ones drop out."""
    meta = (
        spark.read.schema(LABEL_SCHEMA + ", _corrupt_record string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.meta.json")
        .json(root)
        .where(F.col("_corrupt_record").isNull())
        .select("*", F.regexp_replace(F.col("_metadata.file_path"), r"\.meta\.json$", "").alias("stem"))
        .drop("_corrupt_record")
    )
    glob = "*.{" + ",".join(LABEL_EXTENSIONS) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return pair_samples(meta, files.where(~F.col("path").endswith(".meta.json")), limit)


def pair_samples(meta: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """``meta`` has stem; ``files`` has path and content. The earliest extension in the list wins."""
    rank = F.array_position(F.lit(LABEL_EXTENSIONS), extension(F.col("path")))
    ranked = files.withColumn("rank", rank).where("rank > 0").withColumn("stem", F.regexp_replace("path", r"\.[^./]+$", ""))
    # The path is chosen first, without the contents; these are joined to what was chosen.
    first = ranked.groupBy("stem").agg(F.min_by("path", "rank").alias("path"))
    chosen = meta.orderBy("stem").limit(limit) if limit else meta
    placed = chosen.join(first, "stem").join(files.select("path", "content"), "path")
    return placed.select(*meta.columns, file_name(F.col("path")).alias("filename"), decode(F.col("content")).alias("raw_text"))


def load_vendor_docs(spark: SparkSession, merged: list[str], per_vendor: list[str]) -> DataFrame:
    """The merged file and the per-vendor files, exact repeats removed."""
    read = spark.read.schema(VENDOR_DOC_SCHEMA)
    return distinct_by_digest(read.json(merged).unionByName(read.json(per_vendor)))


def distinct_by_digest(rows: DataFrame) -> DataFrame:
    """Exact repeats removed; a row is known by the digest of all its fields, nulls told from empty ones by their place in JSON."""
    keyed = rows.withColumn("_digest", F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])), 256))
    return keyed.dropDuplicates(["_digest"]).drop("_digest")


#: A rule catalogue as files hold it. Its blocks (evaluation, evidence, defaults, remediation per vendor, references) stay JSON texts: the types of
#: their values are the rule's choice.
RULE_BLOCKS = ["evaluation", "evidence", "known_insecure_defaults", "remediation", "references"]
RULE_SCHEMA = StructType([StructField(c, StringType()) for c in ["id", "title", "framework", "baseline_field_path", "description", "severity", *RULE_BLOCKS]])


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule catalogue (YAML or JSON, the rules under ``rules``) as rows."""
    ending = "." + path.rsplit(".", 1)[-1].lower()
    return parse_documents(spark.read.text(path, wholetext=True), RULE_SCHEMA, ending=ending, under="rules")


def load_rules(spark: SparkSession, path: str) -> list:
    """A rule catalogue for :func:`operators.rules.rule_rows`: a bounded list, nested blocks flattened, ``references`` kept."""
    rows = [r.asDict() for r in read_rules(spark, path).orderBy("id").collect()]
    return [_flat_rule(r | {b: json.loads(r[b]) if r[b] else {} for b in RULE_BLOCKS}) for r in rows]


def _flat_rule(r: dict) -> dict:
    if "operator" in r:
        return r
    evaluation, evidence = r.get("evaluation", {}), r.get("evidence", {})
    return {
        "id": r["id"],
        "title": r.get("title"),
        "framework": r.get("framework", "cis"),
        "field_path": r["baseline_field_path"],
        "description": (r.get("description") or "").strip(),
        "severity": r["severity"],
        "operator": evaluation.get("operator"),
        "expected": evaluation.get("expected"),
        "minimum_confidence": evidence.get("minimum_confidence", 0.75),
        "require_explicit": evidence.get("require_explicit_configuration", True),
        "known_insecure_defaults": r.get("known_insecure_defaults") or {},
        "remediation": {v: (x.get("command"), x.get("rationale")) for v, x in (r.get("remediation") or {}).items()},
        "references": r.get("references") or [],
    }


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Any structured file or folder by its extension: JSON, YAML, CSV with header, Parquet, or lines of text."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("yaml", "yml"):
        return read_documents(spark, path)
    if kind in ("json", "jsonl"):
        return spark.read.option("multiLine", kind == "json").json(path)
    if kind == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    return spark.read.text(path)


def preview(df: DataFrame, rows: int = 100) -> DataFrame:
    return df.limit(rows)
