"""Queries over the corpus as files and labels: decoding, pairing, facets, validation, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confsieve.operators import corpus as co
from confsieve.plans.adapters import DOC_SQL, configs, table
from confsieve.plans.registry import query
from confsieve.session import run_folder
from confsieve.sources import configs as src
from confsieve.sources import tables as stored

# ---- files ----------------------------------------------------------------------------------------------------------------------------------
# Documents as files: seven extensions and one unknown; every 5th in Latin-1, every 11th with a NUL byte, line ends of every 3rd doubled.

EXT = ["conf", "cfg", "txt", "rsc", "ini", "xml", "log", "exe"]
EXT_SQL = "['conf', 'cfg', 'txt', 'rsc', 'ini', 'xml', 'log', 'exe'][doc_id % 8 + 1]"


def files(spark: SparkSession, d: str) -> DataFrame:
    n, text = F.col("doc_id"), F.col("text")
    # A name occurs under two folders for every 6th document; the copy holds another text.
    body = F.when(n % 3 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    latin = (n % 5 == 0) & ~text.rlike(r"[^\x00-\xff]")
    content = F.when(latin, F.encode(F.regexp_replace(body, r"[^\x00-\xff]", "?"), "ISO-8859-1")).otherwise(F.encode(body, "UTF-8"))
    content = F.when(n % 11 == 0, F.concat(F.unhex(F.lit("4100")), content)).otherwise(content)
    name = F.concat(F.lit("f"), n.cast("string"), F.lit("."), F.element_at(F.lit(EXT), (n % 8 + 1).cast("int")))
    docs = table(spark, d, "documents")
    first = docs.select(F.concat(F.lit("/a/"), name).alias("path"), content.alias("content"))
    second = docs.where(n % 6 == 0).select(F.concat(F.lit("/b/"), name).alias("path"), F.encode(F.lit("copy"), "UTF-8").alias("content"))
    return first.unionByName(second)


@query("src01_config_scan", f"SELECT 'f' || doc_id || '.' || {EXT_SQL} AS filename, CAST(length(text) AS INTEGER) AS chars FROM documents WHERE doc_id % 8 <> 7 AND doc_id % 11 <> 0 UNION ALL SELECT 'f' || doc_id || '.' || {EXT_SQL}, 4 FROM documents WHERE doc_id % 6 = 0 AND doc_id % 8 <> 7 AND doc_id % 11 = 0")
def scan(spark: SparkSession, d: str) -> DataFrame:
    return src.decode_files(files(spark, d)).select("filename", F.length("raw_text").alias("chars"))


@query("src02_binary_skip", "SELECT count(*) FILTER (WHERE doc_id % 11 = 0) AS binary_files, (SELECT count(*) FROM documents) + (SELECT count(*) FROM documents WHERE doc_id % 6 = 0) AS files FROM documents")
def binary(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).agg(F.count_if(src.is_binary(F.col("content"))).alias("binary_files"), F.count("*").alias("files"))


@query("src03_decoded_text", f"SELECT '/a/f' || doc_id || '.' || {EXT_SQL} AS path, md5(CASE WHEN doc_id % 11 = 0 THEN 'A' || chr(0) || text ELSE text END) AS text_md5 FROM documents UNION ALL SELECT '/b/f' || doc_id || '.' || {EXT_SQL}, md5('copy') FROM documents WHERE doc_id % 6 = 0")
def decoded(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", F.md5(src.decode(F.col("content"))).alias("text_md5"))


@query(
    "src04_labelled_samples",
    "SELECT CAST(l.doc_id AS VARCHAR) AS stem, quality, doc_id || CASE WHEN doc_id % 2 = 0 THEN '.conf' ELSE '.xml' END AS filename, md5(text) AS text_md5 FROM labels l JOIN documents USING (doc_id) WHERE doc_id % 9 <> 4",
)
def samples(spark: SparkSession, d: str) -> DataFrame:
    """Labels as sidecars, documents as configurations: even ones under two extensions of which the first wins, every 9th missing."""
    meta = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("stem"), "quality")
    docs = table(spark, d, "documents").where("doc_id % 9 <> 4")
    n = F.col("doc_id").cast("string")
    xml = docs.select(F.concat(n, F.lit(".xml")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    conf = docs.where("doc_id % 2 = 0").select(F.concat(n, F.lit(".conf")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return src.pair_samples(meta, xml.unionByName(conf)).select("stem", "quality", "filename", F.md5("raw_text").alias("text_md5"))


PATH_SQL = "CASE doc_id % 3 WHEN 0 THEN 'firewall' WHEN 1 THEN 'routers' ELSE 'iot' END"
STATE_SQL = "CASE doc_id % 4 WHEN 0 THEN 'secure' WHEN 1 THEN 'misconfigured' ELSE 'edge_cases' END"
LETTER_SQL = "CASE doc_id % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'M' ELSE 'E' END"


@query(
    "src05_path_labels",
    f"SELECT doc_id, {PATH_SQL} AS category, source AS family, replace({STATE_SQL}, 'edge_cases', 'edge_case') AS state, 'FW-' || upper(source) || '-' || {LETTER_SQL} || '-' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS sample_id, {LETTER_SQL} AS state_letter, CAST(doc_id % 1000 AS INTEGER) AS sample_no FROM documents",
)
def labels_from_paths(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    category = F.when(n % 3 == 0, "firewall").when(n % 3 == 1, "routers").otherwise("iot/cameras")
    state = F.when(n % 4 == 0, "secure").when(n % 4 == 1, "misconfigured").otherwise("edge_cases")
    letter = F.when(n % 4 == 0, "S").when(n % 4 == 1, "M").otherwise("E")
    stem = F.concat(F.lit("FW-"), F.upper("source"), F.lit("-"), letter, F.lit("-"), F.lpad((n % 1000).cast("string"), 3, "0"))
    path = F.concat_ws("/", F.lit("/corpus"), category, F.col("source"), state, F.concat(stem, F.lit(".conf")))
    out = co.path_labels(table(spark, d, "documents").select("doc_id", path.alias("path")))
    return out.select("doc_id", "category", "family", "state", "sample_id", "state_letter", "sample_no")


@query("src06_vendor_documents", "SELECT lang, source, count(*) AS records FROM (SELECT DISTINCT lang, source, text FROM documents) GROUP BY ALL")
def vendor_documents(spark: SparkSession, d: str) -> DataFrame:
    """Written as a merged file and per-vendor files that overlap it, and loaded again."""
    docs = table(spark, d, "documents").select(F.col("lang").alias("vendor"), F.col("source").alias("os_name"), F.col("text").alias("concept_summary"))
    merged, own = run_folder(spark, "vendor-docs"), run_folder(spark, "vendor-docs")
    docs.write.json(merged)
    docs.where("vendor <> 'en'").write.json(own)
    loaded = src.load_vendor_docs(spark, [merged], [own])
    return loaded.groupBy(F.col("vendor").alias("lang"), F.col("os_name").alias("source")).agg(F.count("*").alias("records"))


@query("snk06_preserved_labels", "SELECT doc_id, lang AS legacy_device_type, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS device_type FROM documents")
def preserved(spark: SparkSession, d: str) -> DataFrame:
    """The relabelled table is written, read, and relabelled again: the original label stays."""
    docs, root = table(spark, d, "documents").select("doc_id", "n_chars", F.col("lang").alias("device_type")), run_folder(spark, "relabelled")
    derived = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    stored.write_version(docs, root, 1)
    for version in (1, 2):
        stored.write_version(co.preserve_label(stored.read_version(spark, root, version), "device_type", "legacy_device_type", derived), root, version + 1)
    return stored.read_version(spark, root, 3).select("doc_id", "legacy_device_type", "device_type")


@query("jon06_orphan_labels", "SELECT doc_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id + 1000000000 FROM labels WHERE toxic = 1 EXCEPT ALL SELECT doc_id FROM documents")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Label sidecars without a configuration; labels of toxic documents stand under names that no document has."""
    labels = table(spark, d, "labels")
    named = labels.where("quality = 1").select("doc_id").unionByName(labels.where("toxic = 1").select((F.col("doc_id") + 1_000_000_000).alias("doc_id")))
    return co.lone_labels(named, table(spark, d, "documents"), "doc_id")


# ---- corpus views -----------------------------------------------------------------------------------------------------------------------------

POSTURE_SQL = "CASE doc_id % 3 WHEN 0 THEN 'secure' WHEN 1 THEN 'misconfigured' ELSE 'edge_case' END"


def postures(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 3
    return table(spark, d, "documents").withColumn("state", F.when(n == 0, "secure").when(n == 1, "misconfigured").otherwise("edge_case"))


@query("agg18_corpus_manifest", f"SELECT lang, count(*) AS configs, count(DISTINCT source) AS vendors, count(*) FILTER (WHERE s = 'secure') AS secure, count(*) FILTER (WHERE s = 'misconfigured') AS misconfigured, count(*) FILTER (WHERE s = 'edge_case') AS edge_case FROM (SELECT *, {POSTURE_SQL} AS s FROM documents) GROUP BY lang")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    return co.manifest(postures(spark, d), "lang", "source", "state")


@query("agg19_corpus_facets", f"WITH x AS (SELECT *, {POSTURE_SQL} AS state FROM documents) SELECT 'lang' AS facet, lang AS value, count(*) AS configs FROM x GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM x GROUP BY source UNION ALL SELECT 'state', state, count(*) FROM x GROUP BY state")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return co.facets(postures(spark, d), ["lang", "source", "state"])


@query("agg20_coverage_matrix", "SELECT source, " + ", ".join(f"count(*) FILTER (WHERE lang = '{v}') AS {v}" for v in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source")
def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    return co.coverage(table(spark, d, "documents"), "source", "lang", ["de", "en", "es", "fr"])


@query("srt04_top_sources", "SELECT source, count(*) AS documents, max(n_chars) AS longest FROM documents GROUP BY source ORDER BY longest DESC, source LIMIT 12")
def top_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.max("n_chars").alias("longest")).orderBy(F.desc("longest"), "source").limit(12)


SHARES_SQL = """sized AS (SELECT source, lang, count(*) AS size FROM documents GROUP BY ALL), share AS (SELECT *, 120.0::DOUBLE * size / (SELECT sum(size) FROM sized) AS exact FROM sized),
ranked AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, source, lang) AS r FROM share),
given AS (SELECT source, lang, floor(exact) + CASE WHEN r <= 120 - (SELECT sum(floor(exact)) FROM share) THEN 1 ELSE 0 END AS base FROM ranked),
quota AS (SELECT source, lang, greatest(base, 1) AS n FROM given)"""


@query("srt06_repeatable_sample", f"WITH {SHARES_SQL} SELECT doc_id, d.source, d.lang FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5('7|' || doc_id), doc_id) AS k FROM documents) d JOIN quota q ON d.source = q.source AND d.lang = q.lang WHERE k <= n")
def sampled(spark: SparkSession, d: str) -> DataFrame:
    return co.stratified_sample(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 7, 120)


@query("dq01_manifest_counts", """WITH found AS (SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang), told AS (SELECT d.lang AS category, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang UNION ALL SELECT 'gone', 3)
SELECT coalesce(f.category, t.category) AS category, coalesce(t.n, 0) AS declared, coalesce(f.n, 0) AS found, CASE WHEN f.n IS NULL THEN 'declared and not found' WHEN t.n IS NULL THEN 'found and not declared' ELSE 'counts differ' END AS error
FROM found f FULL JOIN told t ON f.category = t.category WHERE f.n IS DISTINCT FROM t.n""")
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts a manifest declares (here: labelled documents, and a category that is gone) against those found."""
    docs = table(spark, d, "documents")
    labelled = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("declared"))
    declared = labelled.unionByName(docs.sparkSession.range(1).select(F.lit("gone").alias("category"), F.lit(3).cast("long").alias("declared")))
    return co.manifest_errors(docs.groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("found")), declared, "category")


@query("dq01_reconciled_stems", """WITH c AS (SELECT DISTINCT source || '/' || doc_id AS stem FROM documents), l AS (SELECT d.source || '/' || CASE WHEN toxic = 1 THEN 'x' ELSE '' END || l.doc_id AS stem FROM labels l JOIN documents d USING (doc_id))
SELECT coalesce(c.stem, l.stem) AS stem, CASE WHEN c.stem IS NULL THEN 'label without configuration' ELSE 'configuration without label' END AS error FROM c FULL JOIN l ON c.stem = l.stem WHERE c.stem IS NULL OR l.stem IS NULL""")
def reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Configurations and label sidecars by stem; sidecars of toxic documents are misnamed."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    stem = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    odd = F.concat(F.col("source"), F.lit("/"), F.when(F.col("toxic") == 1, "x").otherwise(""), F.col("doc_id").cast("string"))
    return co.reconcile(docs.select(stem.alias("stem")), table(spark, d, "labels").join(docs, "doc_id").select(odd.alias("stem")), "stem")


# ---- validation ---------------------------------------------------------------------------------------------------------------------------------


LABEL_ERRORS_SQL = """r AS (SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 10 = 1 THEN 'missing vendor' END, CASE WHEN doc_id % 12 = 5 THEN 'missing sample_id' END, CASE WHEN doc_id % 12 = 5 OR doc_id % 7 = 3 THEN 'sample_id does not match pattern' END, CASE WHEN doc_id % 8 = 2 THEN 'invalid security_state' END,
  CASE WHEN lang IN ('es', 'fr') THEN 'invalid category' END, CASE WHEN doc_id % 9 = 4 THEN 'network_role cannot be empty' END, CASE WHEN doc_id % 13 = 6 THEN 'contains_secrets must be false' END, CASE WHEN doc_id % 14 = 6 THEN 'anonymized must be true' END], lambda x: x IS NOT NULL)) AS error FROM documents)"""


def label_errors(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    docs = table(spark, d, "documents")
    sample = F.when(n % 12 == 5, None).when(n % 7 == 3, "bad id").otherwise(F.concat(F.lit("FW-A-S-"), F.lpad((n % 1000).cast("string"), 3, "0")))
    given = {
        "sample_id": sample,
        "vendor": F.when(n % 10 != 1, F.col("source")),
        "security_state": F.when(n % 8 == 2, "broken").otherwise("secure"),
        "category": F.when(F.col("lang") == "de", "firewall").when(F.col("lang") == "en", "router").otherwise("printer"),
        "network_role": F.when(n % 9 == 4, "").otherwise("core"),
        "contains_secrets": n % 13 == 6,
        "anonymized": n % 14 != 6,
    }
    labels = docs.select("doc_id", *[given.get(k, F.lit("x")).alias(k) for k in co.REQUIRED_KEYS])
    return labels.select("doc_id", F.explode_outer(co.label_errors()).alias("error")).where("error IS NOT NULL")


@query("dq01_label_validation", f"WITH {LABEL_ERRORS_SQL} SELECT error, count(*) AS records, min(doc_id) AS first_doc FROM r GROUP BY error")
def validated(spark: SparkSession, d: str) -> DataFrame:
    errors = label_errors(spark, d)
    return errors.groupBy("error").agg(F.count("*").alias("records"), F.min("doc_id").alias("first_doc"))


@query(
    "srt05_first_errors",
    f"WITH {LABEL_ERRORS_SQL}, told AS (SELECT doc_id, error, row_number() OVER (ORDER BY doc_id, error) AS k FROM r) SELECT doc_id, error FROM told WHERE k <= 20 UNION ALL SELECT NULL, 'and ' || (count(*) - 20) || ' more' FROM told HAVING count(*) > 20",
)
def first_errors(spark: SparkSession, d: str) -> DataFrame:
    """What a person is shown: the first twenty errors, and how many more there are."""
    return co.first_errors(label_errors(spark, d), ["doc_id", "error"], "error")


SAFE_SQL = " OR ".join(f"starts_with(a, '{p}')" for p in co.SAFE_PREFIXES)


@query(
    "dq02_addresses_and_secrets",
    f"""WITH {DOC_SQL} SELECT config_id, array_to_string(list_filter(regexp_extract_all(raw_text, '\\b\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\b'), lambda a: NOT ({SAFE_SQL})), ',') AS unsafe_addresses,
  len(list_filter(regexp_extract_all(raw_text, '(?i)\\b(?:password|secret|token|community|key)\\b\\s*[=:]?\\s*"?([^\\s"]+)', 1), lambda v: NOT regexp_matches(v, '(?i)<[^>\\s]+>|change_?me|example|redacted|\\*{{3,}}'))) AS secrets FROM doc""",
)
def exposure(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw_text")
    return configs(spark, d).select("config_id", F.array_join(co.unsafe_addresses(raw), ",").alias("unsafe_addresses"), F.size(co.exposed_secrets(raw)).cast("bigint").alias("secrets"))
