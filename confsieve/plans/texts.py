"""Queries over the texts themselves: lines, markers, directives, vendor decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confsieve.catalog.signatures import SIGNATURES
from confsieve.functions import text as t
from confsieve.functions.tables import literal_map
from confsieve.operators import fingerprint as fp
from confsieve.operators.corpus import browse
from confsieve.plans.adapters import (
    ALL_LINES_SQL, BLANKS_SQL, DOC_BASE_SQL, DOC_SIGNATURES, DOC_SQL, LINES_SQL, configs, marker_sql, scores_sql, table,
)
from confsieve.plans.registry import half_up, query


@query(
    "prj01_line_explosion",
    f"WITH {LINES_SQL} SELECT config_id, line_no, md5(raw) AS raw_md5 FROM lines",
)
def lines(spark: SparkSession, d: str) -> DataFrame:
    return configs(spark, d).select("config_id", F.explode_outer(t.numbered_lines(F.col("raw_text"))).alias("l")).where(F.col("l").isNotNull()).select(
        "config_id", F.col("l.line_no").alias("line_no"), F.md5(F.col("l.raw")).alias("raw_md5")
    )


@query(
    "prj02_substantive_lines",
    f"""WITH {ALL_LINES_SQL}
SELECT d.config_id, count(l.line_no) AS every_line, count(*) FILTER (WHERE raw <> '' AND raw[1] NOT IN ('!', '#')) AS inventory_lines,
  count(*) FILTER (WHERE raw <> '' AND raw[1] NOT IN ('!', '#') AND NOT starts_with(raw, '//') AND NOT starts_with(raw, '/*') AND NOT starts_with(raw, '<!--')) AS fingerprint_lines
FROM doc d LEFT JOIN all_lines l USING (config_id) GROUP BY d.config_id""",
)
def substantive(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw_text")
    return configs(spark, d).select(
        "config_id",
        t.count_lines(raw, None).cast("bigint").alias("every_line"),
        t.count_lines(raw, t.COMMENT_STARTS).cast("bigint").alias("inventory_lines"),
        t.count_lines(raw, t.SUBSTANTIVE_COMMENT_STARTS).cast("bigint").alias("fingerprint_lines"),
    )


MARKERS = ["the", "der", "tion", "###", "licens", "menu", "ssh", "les"]


@query(
    "prj03_marker_presence",
    f"WITH {DOC_SQL}, low AS (SELECT config_id, lower(raw_text) AS t FROM doc) SELECT config_id, "
    + ", ".join(f"{marker_sql('t', m)} AS m{i}" for i, m in enumerate(MARKERS))
    + " FROM low",
)
def markers(spark: SparkSession, d: str) -> DataFrame:
    low = configs(spark, d).select("config_id", F.lower("raw_text").alias("low")).withColumn("tokens", t.token_text(F.col("low")))
    return low.select("config_id", *[t.marker_present(F.col("low"), F.col("tokens"), m).alias(f"m{i}") for i, m in enumerate(MARKERS)])


# Markup pages are cut at tag borders into directive-like pieces.
PIECES_SQL = f"""pieces AS (SELECT page_id, CAST(i AS INTEGER) AS piece_no, trim(p[i], {BLANKS_SQL}) AS piece
  FROM (SELECT page_id, string_split(replace(replace(html, '><', '>' || chr(10) || '<'), '</p>', '</p>' || chr(10)), chr(10)) AS p FROM pages), unnest(range(1, len(p) + 1)) AS t(i))"""
# DuckDB has no back-reference. Text between two tags holds no tag, so that pairs never overlap: all are cut out, and those of equal names flattened.
TAG_SQL = "[A-Za-z0-9_:-]+"
PAIR_SQL = f"'<({TAG_SQL})>([^<]*)</({TAG_SQL})>'"
PAIRED_SQL = f"""array_to_string(list_transform(list_zip(regexp_split_to_array(piece, '<{TAG_SQL}>[^<]*</{TAG_SQL}>'), regexp_extract_all(piece, {PAIR_SQL})), lambda z: z[1] || CASE WHEN z[2] IS NULL THEN ''
  WHEN regexp_extract(z[2], {PAIR_SQL}, 1) = regexp_extract(z[2], {PAIR_SQL}, 3) THEN regexp_extract(z[2], {PAIR_SQL}, 1) || ' ' || regexp_extract(z[2], {PAIR_SQL}, 2) ELSE z[2] END), '')"""
FLAT_SQL = f"trim(regexp_replace({PAIRED_SQL}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ')"


def pieces(spark: SparkSession, d: str) -> DataFrame:
    cut = F.replace(F.replace(F.col("html"), F.lit("><"), F.lit(">\n<")), F.lit("</p>"), F.lit("</p>\n"))
    return (
        table(spark, d, "pages")
        .select("page_id", F.posexplode_outer(F.split(cut, "\n", -1)).alias("i", "piece")).where(F.col("piece").isNotNull())
        .select("page_id", (F.col("i") + 1).alias("piece_no"), t.strip(F.col("piece")).alias("piece"))
    )


@query("prj04_flatten_markup", f"WITH {PIECES_SQL}, flat AS (SELECT page_id, piece_no, {FLAT_SQL} AS f FROM pieces) SELECT page_id, piece_no, md5(f) AS flat_md5, length(f) AS flat_length FROM flat")
def flatten(spark: SparkSession, d: str) -> DataFrame:
    flat = t.flatten_markup(F.col("piece"))
    return pieces(spark, d).select("page_id", "piece_no", F.md5(flat).alias("flat_md5"), F.length(flat).cast("bigint").alias("flat_length"))


SCAFFOLD_SQL = (
    "(?i)^(?:</?[A-Za-z0-9_:-]+/?>|(?:end|next|exit|return|commit|quit|abort|save\\s+config|top|root)|(?:config|edit|config\\s+\\w[\\w\\s-]*)"
    "|[{}\\[\\]()!#;,.\\-*=/\\\\|''\"\\s]+|\\w+\\(config[^)]*\\)#?)$"
)


@query(
    "prj05_reviewable_directives",
    f"WITH {PIECES_SQL} SELECT page_id, count(*) AS pieces, count(*) FILTER (WHERE length(piece) >= 3 AND NOT regexp_matches(piece, '{SCAFFOLD_SQL}') AND regexp_matches(piece, '[\\p{{L}}\\p{{N}}]')) AS reviewable FROM pieces GROUP BY page_id",
)
def reviewable(spark: SparkSession, d: str) -> DataFrame:
    return pieces(spark, d).groupBy("page_id").agg(F.count("*").alias("pieces"), F.count_if(t.is_reviewable(F.col("piece"))).alias("reviewable"))


@query(
    "prj06_resolution_key",
    f"WITH {LINES_SQL} SELECT config_id, line_no, md5(filename || '::' || lower(trim(regexp_replace(raw, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' '))) AS key_md5 FROM lines",
)
def keys(spark: SparkSession, d: str) -> DataFrame:
    exploded = configs(spark, d).select("config_id", "filename", F.explode_outer(t.numbered_lines(F.col("raw_text"))).alias("l")).where(F.col("l").isNotNull())
    return exploded.select("config_id", F.col("l.line_no").alias("line_no"), F.md5(t.resolution_key(F.col("filename"), F.col("l.raw"))).alias("key_md5"))


NAMES = {"machinery": "Machine Works", "household": "House & Home"}


@query(
    "prj10_display_names",
    """SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'machinery' THEN 'Machine Works' WHEN 'household' THEN 'House & Home'
  ELSE upper(lower(c_mktsegment)[1]) || lower(c_mktsegment)[2:] END AS display FROM customer""",
)
def names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", fp.display_name(F.lower("c_mktsegment"), NAMES).alias("display"))


@query(
    "prj14_document_selection",
    "SELECT source, lang, count(*) AS documents, count(*) FILTER (WHERE length(text) < 200) AS not_available FROM documents WHERE source IN ('src1', 'src2') OR lang = 'de' GROUP BY ALL",
)
def selection(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("source").isin("src1", "src2") | (F.col("lang") == "de"))
    return docs.groupBy("source", "lang").agg(F.count("*").alias("documents"), F.count_if(F.length("text") < 200).alias("not_available"))


@query("prj17_corpus_browse", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'fr' AND source <> '' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 5")
def browsed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").where("source <> ''")
    return browse(docs, {"lang": "fr"}, [F.desc("n_chars"), F.col("doc_id")], limit=20, offset=5)


# ---- vendor decision ---------------------------------------------------------------------------------------------------------------


@query(
    "fpr01_signature_scores",
    f"WITH {DOC_SQL}, {scores_sql('doc', DOC_SIGNATURES)} SELECT config_id, ordinal, vendor, {half_up('score', 6)} AS score FROM scores",
)
def scores(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.functions.numbers import round_half_up

    scored = fp.score_vendors(configs(spark, d), DOC_SIGNATURES)
    return scored.select("config_id", F.explode_outer("ranking").alias("r")).where(F.col("r").isNotNull()).select("config_id", "r.ordinal", "r.vendor", round_half_up(F.col("r.score"), 6).alias("score"))


CONFIDENCE_SQL = half_up("least(0.97::DOUBLE, CASE WHEN s2 > 0 THEN (0.55::DOUBLE + 0.42::DOUBLE * s1) * (0.80::DOUBLE + 0.20::DOUBLE * margin) ELSE 0.55::DOUBLE + 0.42::DOUBLE * s1 END)", 2)


@query(
    "fpr02_vendor_decision",
    f"WITH {DOC_BASE_SQL} SELECT config_id, vendor, CASE WHEN vendor = 'unknown' THEN 0::DOUBLE ELSE {CONFIDENCE_SQL} END AS vendor_confidence FROM decided",
)
def decision(spark: SparkSession, d: str) -> DataFrame:
    return fp.fingerprint(configs(spark, d), DOC_SIGNATURES).select("config_id", "vendor", "vendor_confidence")


STATUS_SQL = """CASE WHEN empty THEN 'UNKNOWN_EDGE_CASE' WHEN s1 IS NULL OR s1 < 0.08::DOUBLE THEN CASE WHEN n_lines <= 6 THEN 'UNKNOWN_EDGE_CASE' ELSE 'LOW_EVIDENCE' END
  WHEN s2 > 0 AND margin < 0.15::DOUBLE THEN 'CONFLICTING_EVIDENCE' WHEN s1 < 0.62::DOUBLE THEN 'LOW_EVIDENCE' ELSE 'CONFIDENT' END"""


def _fix(x: str, n: int) -> str:
    return f"printf('%.{n}f', {half_up(x, n)})"


FEW_SQL = "CASE WHEN n_lines <= 6 THEN '; lines of substance: ' || n_lines ELSE '' END"
REASON_SQL = f"""CASE WHEN empty THEN 'nothing to read' WHEN s1 IS NULL THEN 'no family has a marker here' || {FEW_SQL}
  WHEN s1 < 0.08::DOUBLE THEN 'too little evidence: ' || v1 || ' leads with ' || {_fix('s1', 3)} || ', 0.08 is needed' || {FEW_SQL}
  WHEN s2 > 0 AND margin < 0.15::DOUBLE THEN 'undecided between ' || v1 || ' at ' || {_fix('s1', 2)} || ' and ' || v2 || ' at ' || {_fix('s2', 2)} || ', ' || CAST(CAST(floor(margin * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) || '% apart'
  WHEN s1 < 0.62::DOUBLE THEN 'likely ' || v1 || ' at ' || {_fix('s1', 2)} || ', sure from 0.62 on' END"""


@query("fpr03_certainty_status", f"WITH {DOC_BASE_SQL} SELECT config_id, {STATUS_SQL} AS vendor_status, {REASON_SQL} AS vendor_reason FROM decided")
def certainty(spark: SparkSession, d: str) -> DataFrame:
    return fp.fingerprint(configs(spark, d), DOC_SIGNATURES).select("config_id", "vendor_status", "vendor_reason")


@query(
    "fpr04_runner_up",
    f"""WITH {DOC_BASE_SQL}, shown AS (SELECT r.config_id, r.vendor, r.score, r.rk, d.vendor AS chosen FROM ranked r JOIN decided d USING (config_id))
SELECT d.config_id, coalesce((SELECT string_agg(s.vendor || ':' || CAST(CAST(floor(s.score * 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS VARCHAR), ',' ORDER BY s.rk) FROM shown s
  WHERE s.config_id = d.config_id AND CASE WHEN s.chosen = 'unknown' THEN s.rk <= 3 ELSE s.rk BETWEEN 2 AND 4 END), '') AS runner_up FROM decided d""",
)
def runners(spark: SparkSession, d: str) -> DataFrame:
    shown = F.transform("runner_up", lambda x: F.concat(x["vendor"], F.lit(":"), F.round(x["score"] * 1000).cast("bigint").cast("string")))
    return fp.fingerprint(configs(spark, d), DOC_SIGNATURES).select("config_id", F.array_join(shown, ",").alias("runner_up"))


@query("win01_top_candidates", f"WITH {DOC_BASE_SQL} SELECT config_id, CAST(rk AS INTEGER) AS rank, vendor, {half_up('score', 3)} AS score FROM ranked WHERE rk <= 5")
def candidates(spark: SparkSession, d: str) -> DataFrame:
    return fp.top_ranking(fp.score_vendors(configs(spark, d), DOC_SIGNATURES), ["config_id"])


#: Documents and pages as configurations of one table.
ALL_TEXTS_SQL = "every AS (SELECT 'd' || doc_id AS config_id, coalesce(text, '') AS raw_text FROM documents UNION ALL SELECT 'p' || page_id, coalesce(html, '') FROM pages)"


def all_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("config_id"), F.coalesce("text", F.lit("")).alias("raw_text"))
    return docs.unionByName(table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("config_id"), F.coalesce("html", F.lit("")).alias("raw_text")))


@query(
    "fpr01_stated_catalogue",
    f"WITH {ALL_TEXTS_SQL}, {scores_sql('every', SIGNATURES)} SELECT e.config_id, coalesce(arg_min(vendor, (-score, ordinal)), 'unknown') AS leading, count(vendor) AS families FROM every e LEFT JOIN scores s USING (config_id) GROUP BY e.config_id",
)
def stated(spark: SparkSession, d: str) -> DataFrame:
    """The stated families over documents and pages."""
    scored = fp.score_vendors(all_texts(spark, d))
    return scored.select("config_id", fp.vendor_at(0.0).alias("leading"), F.size("ranking").cast("bigint").alias("families"))


CATALOGUE_SQL = """words AS (SELECT item_id, unnest(w) AS marker, generate_subscripts(w, 1) AS i, len(w) AS n FROM (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) > 2) AS w FROM benchmark)),
markers AS (SELECT DISTINCT CASE WHEN 2 * i <= n THEN 2 * item_id ELSE 2 * item_id + 1 END AS ordinal, CASE WHEN length(marker) > 5 THEN 'strong' ELSE 'weak' END AS tier, marker FROM words),
possible AS (SELECT ordinal, sum(CASE tier WHEN 'strong' THEN 3 ELSE 1 END)::DOUBLE AS possible FROM markers GROUP BY ordinal),
low AS (SELECT doc_id, lower(text) AS t, ' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ' AS k FROM documents),
hit AS (SELECT doc_id, ordinal, sum(CASE tier WHEN 'strong' THEN 3 ELSE 1 END)::DOUBLE AS earned FROM low, markers WHERE CASE tier WHEN 'strong' THEN contains(t, marker) ELSE contains(k, ' ' || marker || ' ') END GROUP BY ALL),
best AS (SELECT doc_id, arg_min(ordinal, (-earned / possible, ordinal)) AS ordinal, max(earned / possible) AS score, count(*) AS families FROM hit JOIN possible USING (ordinal) GROUP BY doc_id)"""


@query(
    "fpr02_loaded_catalogue",
    f"WITH {CATALOGUE_SQL} SELECT d.doc_id, coalesce(b.ordinal, -1) AS family, {half_up('coalesce(score, 0::DOUBLE)', 6)} AS score, coalesce(families, 0) AS families FROM documents d LEFT JOIN best b USING (doc_id)",
)
def loaded(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue from a table, two families an item: the words of either half mark it."""
    from confsieve.functions.numbers import round_half_up

    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 2)
    cut = table(spark, d, "benchmark").select("item_id", F.size(words).alias("n"), F.posexplode(words).alias("i", "marker"))
    family = 2 * F.col("item_id") + F.when(2 * (F.col("i") + 1) <= F.col("n"), 0).otherwise(1)
    markers = cut.select(family.alias("ordinal"), family.cast("string").alias("vendor"), F.when(F.length("marker") > 5, "strong").otherwise("weak").alias("tier"), "marker")
    scored = fp.score_vendors(table(spark, d, "documents"), fp.catalogue(markers), text="text")
    best = F.try_element_at("ranking", F.lit(1))
    return scored.select("doc_id", F.coalesce(best["vendor"].cast("bigint"), F.lit(-1)).alias("family"), round_half_up(F.coalesce(best["score"], F.lit(0.0)), 6).alias("score"), F.size("ranking").cast("bigint").alias("families"))


@query(
    "jon01_marker_hits",
    f"WITH {DOC_SQL}, low AS (SELECT config_id, lower(raw_text) AS t FROM doc), hits AS ("
    + " UNION ALL ".join(f"SELECT config_id, '{m}' AS marker FROM low WHERE {marker_sql('t', m)}" for m in sorted({m for s in DOC_SIGNATURES for k in ('strong', 'weak') for m in s[k]}))
    + ") SELECT marker, count(*) AS configs FROM hits GROUP BY marker",
)
def hits(spark: SparkSession, d: str) -> DataFrame:
    known = sorted({m for s in DOC_SIGNATURES for k in ("strong", "weak") for m in s[k]})
    low = configs(spark, d).select(F.lower("raw_text").alias("low"))
    found = low.select(F.explode_outer(t.markers_found(F.col("low"), t.token_text(F.col("low")), known)).alias("marker")).where(F.col("marker").isNotNull())
    return found.groupBy("marker").agg(F.count("*").alias("configs"))


@query(
    "agg15_floor_sweep",
    f"""WITH {DOC_BASE_SQL}, floors(evidence_floor) AS (VALUES (0.0::DOUBLE), (0.06::DOUBLE), (0.08::DOUBLE), (0.12::DOUBLE), (0.2::DOUBLE), (0.5::DOUBLE))
SELECT evidence_floor, count(*) FILTER (WHERE s1 IS NOT NULL AND s1 >= evidence_floor AND v1 = truth) AS correct,
  count(*) FILTER (WHERE s1 IS NOT NULL AND s1 >= evidence_floor AND v1 <> truth) AS wrong, count(*) FILTER (WHERE s1 IS NULL OR s1 < evidence_floor) AS abstain
FROM decided JOIN doc USING (config_id), floors GROUP BY evidence_floor""",
)
def sweep(spark: SparkSession, d: str) -> DataFrame:
    return fp.floor_sweep(fp.score_vendors(configs(spark, d), DOC_SIGNATURES), F.col("truth"), [0.0, 0.06, 0.08, 0.12, 0.2, 0.5])


@query("fpr13_coarse_types", """SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'switch' WHEN 1 THEN 'iot_device' WHEN 2 THEN 'wireless_ap' WHEN 3 THEN 'router' ELSE 'firewall' END AS device_type,
  CASE c_nationkey % 5 WHEN 0 THEN 'network' WHEN 1 THEN 'iot' WHEN 2 THEN 'network' WHEN 3 THEN 'network' ELSE 'security' END AS asset_group FROM customer""")
def coarse(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.operators.profile import asset_group, coarse_type

    klass = F.element_at(literal_map({"0": "network_switch", "1": "iot_controller", "2": "wireless_controller", "3": "router", "4": "firewall"}), (F.col("c_nationkey") % 5).cast("string"))
    return table(spark, d, "customer").select("c_custkey", coarse_type(klass).alias("device_type"), asset_group(klass).alias("asset_group"))
