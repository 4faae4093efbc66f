"""Queries of the review queue: unknown lines, controls, trust, verdicts, similarity, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confsieve.catalog.review import CONTROL_KEYWORDS
from confsieve.functions import text as t
from confsieve.functions.tables import computed
from confsieve.operators import cluster, folds, review, similarity
from confsieve.operators import extract as x
from confsieve.operators import rules as ru
from confsieve.operators.latest import latest_per_key
from confsieve.plans.adapters import (
    BLANKS_SQL, DOC_FACTS_SQL, DOC_FIELD_TYPES, DOC_FINDINGS_SQL, DOC_GRAMMAR, DOC_RULES, LINES_SQL, UNKNOWN_SQL, configs, rule_number_sql, table,
)
from confsieve.plans.audits import extracted, matched
from confsieve.plans.registry import half_up, query, text
from confsieve.plans.texts import CONFIDENCE_SQL
from confsieve.session import cut_lineage, run_folder
from confsieve.sources import tables as stored

#: No text may have more lines, no conversation more turns than this; both are checked. Ids of texts go up to 2**39.
LINES_APART, TURNS_APART = 1 << 24, 1 << 20

KEY_SQL = "lower(trim(regexp_replace({c}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' '))"


def unknown(spark: SparkSession, d: str) -> DataFrame:
    """Unknown lines with a distinct arrival number: configuration first, then line."""
    u = x.unknown_lines(matched(spark, d), ["config_id", "filename", "vendor", "vendor_confidence"], DOC_GRAMMAR)
    line = F.when(F.col("line_no") < LINES_APART, F.col("line_no")).otherwise(F.raise_error(F.lit("a text has too many lines")).cast("int"))
    return u.withColumn("seq", F.col("config_id") * LINES_APART + line)


UNKNOWN_SEQ_SQL = f"{DOC_FACTS_SQL}, {UNKNOWN_SQL}, unk AS (SELECT *, config_id * {LINES_APART} + line_no AS seq FROM unknowns)"


@query("win06_first_seen_directives", f"WITH {LINES_SQL}, k AS (SELECT config_id, line_no, {KEY_SQL.format(c='raw')} AS key FROM lines) SELECT config_id, md5(key) AS key_md5, min(line_no) AS line_no FROM k GROUP BY config_id, key")
def first_directives(spark: SparkSession, d: str) -> DataFrame:
    """Found inside the row that holds the text: its lines in order of their keys."""
    lines = F.transform(t.numbered_lines(F.col("raw_text")), lambda x: F.struct(F.lower(t.collapse_blanks(x["raw"])).alias("key"), x["line_no"].alias("line_no")))
    ordered = computed(configs(spark, d).select("config_id", lines.alias("_lines")), _ordered=F.array_sort("_lines"))
    found = ordered.select("config_id", F.explode(t.first_of_keys("_ordered")).alias("e")).where("e.first")
    return found.select("config_id", F.md5("e.entry.key").alias("key_md5"), "e.entry.line_no")


# ---- control mapping and trust ----------------------------------------------------------------------------------------------------------------

WORDS = [("DOC-LIC-01", ["licen", "rights"]), ("DOC-PII-01", ["@mail", "menu"]), ("DOC-SEC-01", ["token", "###"]), ("DOC-ACL-01", ["free", " | "])]
FLAT_RAW = f"trim(regexp_replace(regexp_replace(trim(raw, {BLANKS_SQL}), '<([A-Za-z0-9_:-]+)>([^<]*)</([A-Za-z0-9_:-]+)>', '\\1 \\2', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ')"
CONTROL_SQL = "CASE WHEN line_no % 11 = 0 THEN 'DOC-PII-02' WHEN line_no % 13 = 0 THEN 'DOC-LIC-02' " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower({FLAT_RAW} || ' '), {text(w)})" for w in words) + f" THEN '{r}'" for r, words in WORDS
) + " ELSE 'UNMAPPED' END"


def mapped(u: DataFrame) -> DataFrame:
    hint = F.when(F.col("line_no") % 11 == 0, "DOC-PII-02")
    path = F.when(F.col("line_no") % 13 == 0, "content.license.name")
    return review.with_control(u, "raw", path, hint, DOC_RULES, WORDS)


@query("knw04_control_mapping", f"WITH {UNKNOWN_SEQ_SQL} SELECT seq, {CONTROL_SQL} AS control FROM unk")
def controls(spark: SparkSession, d: str) -> DataFrame:
    return mapped(unknown(spark, d)).select("seq", "control")


KEYWORD_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({FLAT_RAW} || ' '), {text(w)})" for w in words) + f" THEN '{r}'" for r, words in CONTROL_KEYWORDS) + " ELSE 'UNMAPPED' END"


@query("knw04_control_keywords", f"WITH {LINES_SQL} SELECT {KEYWORD_SQL} AS control, count(*) AS lines FROM lines GROUP BY 1")
def control_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The default keyword table over every line of every document."""
    lines = configs(spark, d).select(F.explode_outer(t.numbered_lines(F.col("raw_text"))).alias("l")).where("l IS NOT NULL")
    none = F.lit(None).cast("string")
    return review.with_control(lines.select(F.col("l.raw").alias("raw")), "raw", none, none).groupBy("control").agg(F.count("*").alias("lines"))


#: What the turns of the conversations taught: see win08_directive_weights.
WEIGHTS_SQL = f"""taught AS (SELECT conv_id * {TURNS_APART} + turn AS seq, unnest(list_distinct(list_filter(regexp_split_to_array(lower(replace(text, '"', '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: length(w) > 2))) AS token, CASE WHEN role = 'assistant' THEN 10000::BIGINT ELSE 2000::BIGINT END AS target FROM conversations),
weights AS (SELECT token, list_reduce(list_prepend(5000::BIGINT, list(target ORDER BY seq)), lambda w, t: (w * 92 + t * 8 + 50) // 100) / 10000.0::DOUBLE AS weight FROM taught GROUP BY token)"""
TOKENS_SQL = "tok AS (SELECT seq, trim(lower(unnest(list_filter(regexp_split_to_array(raw, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: length(w) > 2))), '\"''') AS token FROM unk)"
LEARNED_SQL = f"{WEIGHTS_SQL}, {TOKENS_SQL}, learned AS (SELECT u.seq, count(k.token) AS tokens, count(w.weight) AS known_tokens, coalesce(avg(w.weight), 0::DOUBLE) AS learned FROM unk u LEFT JOIN tok k USING (seq) LEFT JOIN weights w USING (token) GROUP BY u.seq)"


def weights(spark: SparkSession, d: str) -> DataFrame:
    """Written once, so that its true size decides whether it goes to all tasks or meets the tokens in a shuffle."""
    return cut_lineage(directive_weights(spark, d).select("token", "weight"), "weights")


@query("knw09_token_weights", f"WITH {UNKNOWN_SEQ_SQL}, {LEARNED_SQL} SELECT seq, tokens, known_tokens, {half_up('learned', 6)} AS learned FROM learned")
def learned(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.functions.numbers import round_half_up

    out = review.learned_weights(unknown(spark, d), "seq", "raw", weights(spark, d))
    return out.withColumn("learned", round_half_up(F.col("learned"), 6))


DIRECTIVE_TOKENS_SQL = "list_filter(list_distinct(list_transform(list_filter(regexp_split_to_array(lower({f}), '[\\s=]+'), lambda w: length(w) > 2), lambda w: trim(w, '\"''<>=,;()[]{{}}'))), lambda w: w NOT IN ('set', 'the', 'and', 'for', 'config', 'configure', 'edit'))"
JACCARD_SQL = f"""q AS (SELECT seq, {DIRECTIVE_TOKENS_SQL.format(f=FLAT_RAW)} AS ts FROM unk), e AS (SELECT item_id, {DIRECTIVE_TOKENS_SQL.format(f=FLAT_RAW.replace('raw', 'text'))} AS ts FROM benchmark),
qt AS (SELECT seq, len(ts) AS a, unnest(ts) AS token FROM q), et AS (SELECT item_id, len(ts) AS b, unnest(ts) AS token FROM e),
sh AS (SELECT seq, item_id, count(*) AS both_n, any_value(a) AS a, any_value(b) AS b FROM qt JOIN et USING (token) GROUP BY ALL),
jac AS (SELECT u.seq, {half_up('coalesce(max(both_n::DOUBLE / (a + b - both_n)), 0::DOUBLE)', 3)} AS similarity FROM unk u LEFT JOIN sh USING (seq) GROUP BY u.seq)"""


@query("jon11_nearest_example", f"WITH {UNKNOWN_SEQ_SQL}, {JACCARD_SQL} SELECT * FROM jac")
def nearest_example(spark: SparkSession, d: str) -> DataFrame:
    return similarity.token_overlap(unknown(spark, d), table(spark, d, "benchmark"), "seq", "raw", "item_id", "text")


def trust_sql(line: str, learned: str) -> str:
    return half_up(f"least(greatest(0.30::DOUBLE * CASE WHEN control <> 'UNMAPPED' THEN 1.0::DOUBLE ELSE 0::DOUBLE END + 0.25::DOUBLE * CASE WHEN known THEN 1.0::DOUBLE ELSE 0::DOUBLE END + 0.20::DOUBLE * {learned} + 0.15::DOUBLE * similarity + 0.10::DOUBLE * vendor_confidence, 0::DOUBLE), 1::DOUBLE)", 3)


NEUTRAL = x.Grammar(vendor_rules=[], fallback_rules=DOC_GRAMMAR.fallback_rules, keyword_rules=DOC_GRAMMAR.keyword_rules)
GRID = "round({0} * 1048576) / 1048576.0::DOUBLE"
BAND_SQL = "CASE WHEN trust_score >= 0.70::DOUBLE THEN 'high' WHEN trust_score >= 0.45::DOUBLE THEN 'medium' ELSE 'low' END"
VENDOR_CONFIDENCE_SQL = f"CASE WHEN vendor = 'unknown' THEN 0::DOUBLE ELSE {CONFIDENCE_SQL} END"


def known_sql(raw: str) -> str:
    return f"({rule_number_sql(raw, 'NULL', NEUTRAL)} IS NOT NULL OR {rule_number_sql(FLAT_RAW.replace('raw', raw), 'NULL', NEUTRAL)} IS NOT NULL)"


def _on_grid(c: str) -> F.Column:
    """Averages are put on a binary grid before they are added up, so that the order of summation cannot show."""
    return F.round(F.col(c) * 1048576) / 1048576.0


def trusted(rows: DataFrame, key: str, text_of: str, weighed: DataFrame, examples: DataFrame) -> DataFrame:
    """Adds control, known, learned, similarity, trust_score, trust_band and the factors to directives with vendor and vendor_confidence."""
    ready = computed(rows, known=review.known_pattern(F.col(text_of), F.lit(None).cast("string"), DOC_GRAMMAR).isNotNull())
    l = review.learned_weights(ready, key, text_of, weighed).select(key, "learned")
    j = similarity.token_overlap(ready, examples, key, text_of, "item_id", "text")
    parts = F.col("control") != review.UNMAPPED, F.col("known"), _on_grid("learned"), F.col("similarity"), F.col("vendor_confidence")
    scored = ready.join(l, key).join(j, key).withColumn("trust_score", review.trust(*parts)).withColumn("factors", review.trust_factors(*parts))
    return scored.withColumn("trust_band", review.trust_band(F.col("trust_score")))


@query(
    "knw05_trust_score",
    f"""WITH {UNKNOWN_SEQ_SQL}, {LEARNED_SQL}, {JACCARD_SQL}, c AS (SELECT *, {CONTROL_SQL} AS control, {known_sql('raw')} AS known FROM unk),
v AS (SELECT config_id, {VENDOR_CONFIDENCE_SQL} AS vendor_confidence FROM decided), s AS (SELECT c.seq, known, {trust_sql('line_no', GRID.format('learned'))} AS trust_score FROM c JOIN v USING (config_id) JOIN learned USING (seq) JOIN jac USING (seq))
SELECT seq, known, trust_score, {BAND_SQL} AS trust_band FROM s""",
)
def trust(spark: SparkSession, d: str) -> DataFrame:
    u = cut_lineage(mapped(unknown(spark, d)).select("seq", "raw", "control", "vendor_confidence"), "mapped")
    return trusted(u, "seq", "raw", weights(spark, d), table(spark, d, "benchmark")).select("seq", "known", "trust_score", "trust_band")


# ---- the queue ----------------------------------------------------------------------------------------------------------------------------------

SCAFFOLD_TEST = "length(command) >= 3 AND regexp_matches(command, '[\\p{L}\\p{N}]') AND NOT regexp_matches(command, '(?i)^(?:</?[A-Za-z0-9_:-]+/?>|(?:end|next|exit|return|commit|quit|abort|save\\s+config|top|root)|(?:config|edit|config\\s+\\w[\\w\\s-]*)|[{}\\[\\]()!#;,.\\-*=/\\\\|''\"\\s]+|\\w+\\(config[^)]*\\)#?)$')"
QUEUE_SQL = f"""{DOC_FINDINGS_SQL}, {UNKNOWN_SQL}, both_sources AS (SELECT filename, line_no, raw AS command, NULL::VARCHAR AS rule_hint, 0 AS source FROM unknowns
  UNION ALL SELECT filename, src_line, src_raw, rule_id, 1 FROM findings WHERE status = 'fail' AND src_raw IS NOT NULL),
keyed AS (SELECT *, filename || '::' || {KEY_SQL.format(c='command')} AS resolution_key FROM both_sources WHERE {SCAFFOLD_TEST}),
queue AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY filename, resolution_key ORDER BY source, line_no, command, rule_hint) AS rn FROM keyed) WHERE rn = 1),
verdicts AS (SELECT resolution_key, arg_max(CASE WHEN line_no % 3 = 0 THEN 'PASS' ELSE 'FAIL' END, line_no) AS verdict FROM keyed WHERE line_no % 2 = 0 GROUP BY resolution_key),
q2 AS (SELECT queue.*, verdict, verdict IS NOT NULL AS resolved FROM queue LEFT JOIN verdicts USING (resolution_key))"""


def queue_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every entry of the queue of every document, from one pass over the texts; ``first`` marks those that stand for their key."""
    rows = ru.findings_in_row(extracted(spark, d), DOC_RULES, DOC_FIELD_TYPES)
    return cut_lineage(review.queue_in_row(rows, ["config_id", "filename", "vendor", "vendor_confidence"], DOC_GRAMMAR), "queue")


def queued(spark: SparkSession, d: str) -> DataFrame:
    rows = queue_rows(spark, d)
    told = rows.where("line_no % 2 = 0").select("resolution_key", "line_no", F.when(F.col("line_no") % 3 == 0, "PASS").otherwise("FAIL").alias("verdict"), F.lit("auditor").alias("reviewer"))
    return review.with_verdicts(rows.where("first").drop("first"), latest_per_key(told, ["resolution_key"], ["line_no"]))


#: Fix texts by control and vendor, of this catalogue of rules.
FIXES = {"DOC-SEC-01|en": "remove the token", "DOC-PII-01|en": "mask the address", "DOC-PII-01|fr": "masquer l'adresse", "DOC-ACL-01|en": "drop the menu"}
_HINTED = "CASE " + " ".join(f"WHEN rule_hint = {text(r['id'])} THEN {text(r['id'])}" for r in DOC_RULES) + " " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower({FLAT_RAW.replace('raw', 'command')} || ' '), {text(w)})" for w in words) + f" THEN '{r}'" for r, words in WORDS
) + " ELSE 'UNMAPPED' END"
_SEVERITY = "CASE control " + " ".join(f"WHEN {text(r['id'])} THEN {text(r['severity'])}" for r in DOC_RULES) + " END"
_TITLE = "CASE control " + " ".join(f"WHEN {text(r['id'])} THEN {text(r['title'])}" for r in DOC_RULES) + " END"
_FIX = "CASE control || '|' || vendor " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in FIXES.items()) + " END"


@query(
    "knw06_review_queue",
    f"""WITH {QUEUE_SQL}, unk AS (SELECT resolution_key AS seq, command AS raw FROM q2), {LEARNED_SQL}, {JACCARD_SQL},
full_rows AS (SELECT q2.*, d.vendor, {VENDOR_CONFIDENCE_SQL} AS vendor_confidence, {_HINTED} AS control, {known_sql('command')} AS known FROM q2 JOIN doc USING (filename) JOIN decided d ON d.config_id = doc.config_id),
s AS (SELECT f.*, {trust_sql('line_no', GRID.format('learned'))} AS trust_score FROM full_rows f JOIN learned l ON l.seq = f.resolution_key JOIN jac ON jac.seq = f.resolution_key)
SELECT filename, line_no, md5(resolution_key) AS key_md5, verdict, resolved, control, {_TITLE} AS control_title, {_SEVERITY} AS severity, {_FIX} AS remediation, known, trust_score, {BAND_SQL} AS trust_band FROM s""",
)
def queue(spark: SparkSession, d: str) -> DataFrame:
    """The whole queue: what a directive is about, what mends it, how far it is trusted, and what was decided before."""
    from confsieve.functions.tables import literal_map

    rows = review.with_control(queued(spark, d), "command", F.lit(None).cast("string"), F.col("rule_hint"), DOC_RULES, WORDS)
    rows = cut_lineage(rows.withColumn("entry", F.monotonically_increasing_id()), "queue-controls")
    out = trusted(rows, "entry", "command", weights(spark, d), table(spark, d, "benchmark"))
    control = F.col("control")
    return out.select(
        "filename", "line_no", F.md5("resolution_key").alias("key_md5"), "verdict", "resolved", "control", review.rule_attribute(control, "title", DOC_RULES).alias("control_title"),
        review.rule_attribute(control, "severity", DOC_RULES).alias("severity"), F.try_element_at(literal_map(FIXES), F.concat_ws("|", control, "vendor")).alias("remediation"), "known", "trust_score", "trust_band",
    )


@query("jon05_pending_only", f"WITH {QUEUE_SQL} SELECT filename, line_no FROM q2 WHERE NOT resolved")
def pending(spark: SparkSession, d: str) -> DataFrame:
    return queued(spark, d).where(~F.col("resolved")).select("filename", "line_no")


@query("agg21_queue_totals", f"WITH {QUEUE_SQL} SELECT CASE WHEN grouping(filename) = 1 THEN '(all)' ELSE filename END AS filename, count(*) FILTER (WHERE NOT resolved) AS pending, count(*) FILTER (WHERE resolved) AS resolved FROM q2 GROUP BY ROLLUP (filename)")
def totals(spark: SparkSession, d: str) -> DataFrame:
    return review.queue_totals(queued(spark, d))


@query("srt01_files_by_pending", f"WITH {QUEUE_SQL} SELECT filename, count(*) FILTER (WHERE NOT resolved) AS pending FROM q2 GROUP BY filename")
def busiest(spark: SparkSession, d: str) -> DataFrame:
    per_file = queued(spark, d).groupBy("filename").agg(F.count_if(~F.col("resolved")).alias("pending"))
    return per_file.orderBy(F.desc("pending"), "filename")


@query("srt05_first_unknown_lines", f"WITH {UNKNOWN_SEQ_SQL} SELECT seq, filename, line_no FROM unk ORDER BY seq LIMIT 6")
def first_unknown(spark: SparkSession, d: str) -> DataFrame:
    return unknown(spark, d).select("seq", "filename", "line_no").orderBy("seq").limit(6)


@query("set04_token_sets", f"WITH {UNKNOWN_SEQ_SQL}, s AS (SELECT seq, {DIRECTIVE_TOKENS_SQL.format(f=FLAT_RAW)} AS ts FROM unk) SELECT seq, len(ts) AS tokens, len(list_intersect(ts, ['menu', 'free', 'that', 'with'])) AS shared FROM s")
def token_sets(spark: SparkSession, d: str) -> DataFrame:
    u = computed(unknown(spark, d), ts=t.directive_tokens(F.col("raw")))
    return u.select("seq", F.size("ts").cast("bigint").alias("tokens"), F.size(F.array_intersect("ts", F.lit(["menu", "free", "that", "with"]))).cast("bigint").alias("shared"))


# ---- similarity and clusters ------------------------------------------------------------------------------------------------------------------------

GRAMS = "list_concat(list_transform(range(1, length(w)), lambda i: w[i:i + 1]), list_transform(range(1, length(w) - 1), lambda i: w[i:i + 2]), list_transform(range(1, length(w) - 2), lambda i: w[i:i + 3]))"


def _grams_sql(name: str, source: str, key: str, col: str) -> str:
    return f"""{name}_w AS (SELECT {key}, ' ' || unnest(list_filter(regexp_split_to_array(lower({col}), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) || ' ' AS w FROM {source}),
{name} AS (SELECT {key}, gram, count(*) AS tf FROM (SELECT {key}, unnest({GRAMS}) AS gram FROM {name}_w) GROUP BY ALL)"""


# Weighs each query in the corpus of all entries plus itself, entry by entry, as the definition says.
NEAREST_SQL = f"""{_grams_sql('eg', 'benchmark', 'item_id', 'text')}, {_grams_sql('qg', 'unk', 'seq', 'raw')},
n AS (SELECT count(*) + 1 AS n FROM benchmark), edf AS (SELECT gram, count(*) AS df FROM eg GROUP BY gram),
qw AS (SELECT seq, gram, tf * (ln((n + 1.0::DOUBLE) / (coalesce(df, 0) + 1 + 1.0::DOUBLE)) + 1.0::DOUBLE) AS w, ln((n + 1.0::DOUBLE) / (coalesce(df, 0) + 1 + 1.0::DOUBLE)) + 1.0::DOUBLE AS iq FROM qg LEFT JOIN edf USING (gram), n),
qn AS (SELECT seq, sum(w * w) AS qsq FROM qw GROUP BY seq),
ew AS (SELECT item_id, gram, tf, ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0::DOUBLE AS ie FROM eg JOIN edf USING (gram), n),
en AS (SELECT item_id, sum(tf * tf * ie * ie) AS sq FROM ew GROUP BY item_id),
pr AS (SELECT q.seq, e.item_id, sum(q.w * e.tf * q.iq) AS dot, sum(e.tf * e.tf * (q.iq * q.iq - e.ie * e.ie)) AS shift FROM qw q JOIN ew e USING (gram) GROUP BY ALL),
sc AS (SELECT seq, item_id, dot / sqrt(qsq * (sq + shift)) AS cosine FROM pr JOIN qn USING (seq) JOIN en USING (item_id)),
near AS MATERIALIZED (SELECT u.seq, coalesce({half_up('max(cosine)', 4)}, 0::DOUBLE) AS similarity FROM unk u LEFT JOIN sc USING (seq) GROUP BY u.seq)"""


def nearest(spark: SparkSession, d: str) -> DataFrame:
    return similarity.nearest_entries(unknown(spark, d), table(spark, d, "benchmark"), "seq", "raw", "item_id", "text")


@query("jon10_nearest_entry", f"WITH {UNKNOWN_SEQ_SQL}, {NEAREST_SQL} SELECT seq, similarity FROM near")
def nearest_entry(spark: SparkSession, d: str) -> DataFrame:
    return nearest(spark, d).select("seq", "similarity")


@query("knw03_confident_retrieval", f"WITH {UNKNOWN_SEQ_SQL}, {NEAREST_SQL} SELECT count(*) AS queries, count(*) FILTER (WHERE similarity >= 0.55::DOUBLE) AS confident FROM near")
def retrieval(spark: SparkSession, d: str) -> DataFrame:
    return nearest(spark, d).agg(F.count("*").alias("queries"), F.count_if("is_confident").alias("confident"))


def _backend(queries: DataFrame, kb: DataFrame) -> DataFrame:
    return similarity.token_overlap(queries, kb, "seq", "raw", "item_id", "text")


@query("udf01_similarity_backend", f"WITH {UNKNOWN_SEQ_SQL}, {JACCARD_SQL} SELECT count(*) AS queries, {half_up('avg(round(similarity * 1000))', 2)} AS mean_permille FROM jac")
def backend(spark: SparkSession, d: str) -> DataFrame:
    """A similarity back end is any function (queries, entries) -> matches; here the token one is put in."""
    from confsieve.functions.numbers import round_half_up

    matches = _backend(unknown(spark, d), table(spark, d, "benchmark"))
    return matches.agg(F.count("*").alias("queries"), round_half_up(F.avg(F.round(F.col("similarity") * 1000)), 2).alias("mean_permille"))


def clustered(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.session import cut_lineage

    u = cut_lineage(unknown(spark, d).select("seq", "config_id", "filename", "vendor", "line_no", "raw"), "unknown")
    return u.join(cluster.cluster_lines(u, "vendor", "raw", "seq"), "seq")


#: The greedy run in arrival order, spelled out: distinct lines, their unit vectors, all pairs at or above the threshold, then line by line.
CLUSTER_SQL = f"""{UNKNOWN_SEQ_SQL}, nodes AS MATERIALIZED (SELECT vendor, raw, min(seq) AS node, count(*) AS copies FROM unk GROUP BY vendor, raw),
padded AS (SELECT node, vendor, copies, ' ' || w || ' ' AS w FROM (SELECT node, vendor, copies, unnest(regexp_split_to_array(lower(raw), '[ \\t\\n\\x0b\\f\\r]+')) AS w FROM nodes) WHERE w <> ''),
placed AS (SELECT node, vendor, copies, w, n, unnest(generate_series(1, length(w) - n + 1)) AS i FROM padded, (VALUES (2), (3), (4)) AS sizes(n)),
tfs AS (SELECT node, vendor, copies, substr(w, i, n) AS gram, count(*) AS tf FROM placed GROUP BY ALL),
idfs AS (SELECT gram, ln(((SELECT sum(copies) FROM nodes) + 1.0::DOUBLE) / (sum(copies) + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf FROM tfs GROUP BY gram),
weights AS MATERIALIZED (SELECT node, vendor, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY node)) AS w FROM tfs JOIN idfs USING (gram)),
near AS (SELECT a.node AS i, b.node AS j, sum(a.w * b.w) AS similarity FROM weights a JOIN weights b ON a.gram = b.gram AND a.vendor = b.vendor AND a.node < b.node GROUP BY 1, 2 HAVING sum(a.w * b.w) >= {similarity.THRESHOLD - 1e-12!r}::DOUBLE),
line AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) AS k, coalesce(js, []::BIGINT[]) AS js FROM nodes LEFT JOIN (SELECT j AS node, list(i) AS js FROM near GROUP BY j) USING (node)),
greedy AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE g AS (
  SELECT 0::BIGINT AS k, NULL::BIGINT AS node, NULL::BIGINT AS seed, []::BIGINT[] AS seeds
  UNION ALL
  SELECT l.k, l.node, coalesce(list_min(list_intersect(g.seeds, l.js)), l.node), CASE WHEN len(list_intersect(g.seeds, l.js)) = 0 THEN list_append(g.seeds, l.node) ELSE g.seeds END FROM g JOIN line l ON l.k = g.k + 1) SELECT node, seed FROM g WHERE k > 0)),
members AS MATERIALIZED (SELECT u.seq, u.config_id, u.vendor, u.raw, g.seed FROM unk u JOIN nodes n ON u.vendor = n.vendor AND u.raw = n.raw JOIN greedy g ON g.node = n.node),
groups AS (SELECT seed, count(DISTINCT config_id) AS devices, count(*) AS lines, min(seq) AS first_order FROM members GROUP BY seed)"""


@query("jon09_similar_lines", f"WITH {CLUSTER_SQL} SELECT i, j, {half_up('similarity', 6)} AS similarity FROM near")
def similar(spark: SparkSession, d: str) -> DataFrame:
    """Every two similar lines of a vendor, each distinct line named by its first occurrence."""
    from confsieve.functions.numbers import round_half_up
    from confsieve.session import cut_lineage

    nodes = cut_lineage(cluster.collapse_equal(unknown(spark, d), "vendor", "raw", "seq"), "similar-lines")
    return similarity.similar_pairs(nodes, "vendor", "node", "raw", "copies").withColumn("similarity", round_half_up(F.col("similarity"), 6))


@query("win13_review_groups", f"WITH {CLUSTER_SQL} SELECT seq, seed FROM members")
def groups(spark: SparkSession, d: str) -> DataFrame:
    return clustered(spark, d).select("seq", "seed")


@query("agg29_cluster_rollup", f"WITH {CLUSTER_SQL} SELECT seed, devices, lines, first_order, vendor, raw AS representative FROM groups JOIN members USING (seed) WHERE seq = seed")
def rollup(spark: SparkSession, d: str) -> DataFrame:
    c = clustered(spark, d)
    heads = c.where("seq = seed").select("seed", "vendor", F.col("raw").alias("representative"))
    return cluster.cluster_summary(c, "seed", "config_id", "seq").join(heads, "seed")


@query("jon14_mapping_fan_out", f"WITH {CLUSTER_SQL} SELECT DISTINCT config_id, seed, 'content.noise.present' AS field_path FROM members JOIN groups USING (seed) WHERE devices > 1")
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    """One decision per group (here: groups that reach more than one device) reaches every device of the group."""
    c = clustered(spark, d)
    wide = cluster.cluster_summary(c, "seed", "config_id", "seq").where("devices > 1").select("seed")
    return c.join(wide, "seed").select("config_id", "seed", F.lit("content.noise.present").alias("field_path")).distinct()


# ---- knowledge ------------------------------------------------------------------------------------------------------------------------------------------


@query("knw01_vendor_entries", "SELECT item_id % 4 AS vendor_no, count(*) AS entries, count(DISTINCT item_id) AS items FROM (SELECT item_id FROM benchmark UNION ALL SELECT item_id FROM benchmark WHERE length(text) > 200) GROUP BY 1")
def entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries appended in two runs, the second time the long ones again; the view of a vendor reads its folder only."""
    kb, path = table(spark, d, "benchmark").withColumn("vendor_no", F.col("item_id") % 4), run_folder(spark, "kb")
    stored.append(kb, path, ["vendor_no"])
    stored.append(kb.where(F.length("text") > 200), path, ["vendor_no"])
    view = spark.read.schema(kb.schema).parquet(path)
    return view.groupBy("vendor_no").agg(F.count("*").alias("entries"), F.count_distinct("item_id").alias("items"))


@query(
    "knw02_seeded_entries",
    f"""WITH {LINES_SQL}, m AS (SELECT config_id, line_no, CASE {' '.join(f"WHEN regexp_matches(raw, {text('(?i)' + r[0])}) THEN {text(r[1])}" for r in DOC_GRAMMAR.fallback_rules)}
  WHEN contains(lower(raw), 'rights') AND (contains(lower(raw), 'reserved') OR contains(lower(raw), 'all')) THEN 'content.license.present' WHEN contains(lower(raw), 'worthless') OR contains(lower(raw), 'http') THEN 'content.link.present' END AS field_path FROM lines WHERE length(raw) >= 5)
SELECT * FROM m WHERE field_path IS NOT NULL""",
)
def seeded(spark: SparkSession, d: str) -> DataFrame:
    records = configs(spark, d).withColumn("vendor", F.col("truth"))
    # The flattened form of a line matches nothing the line itself does not in this corpus.
    return review.seed_entries(records, ["config_id"], "raw_text", "vendor", DOC_GRAMMAR).select("config_id", "line_no", "field_path")


@query(
    "win08_directive_weights",
    f"""WITH v AS (SELECT conv_id * {TURNS_APART} + turn AS seq, unnest(list_distinct(list_filter(regexp_split_to_array(lower(replace(text, '"', '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: length(w) > 2))) AS token, CASE WHEN role = 'assistant' THEN 10000::BIGINT ELSE 2000::BIGINT END AS target FROM conversations)
SELECT token, count(*) AS events, list_reduce(list_prepend(5000::BIGINT, list(target ORDER BY seq)), lambda w, t: (w * 92 + t * 8 + 50) // 100) / 10000.0::DOUBLE AS weight FROM v GROUP BY token""",
)
def directive_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights learned from whole directives: every token of a turn gets that turn's verdict, in turn order."""
    turn = F.when(F.col("turn") < TURNS_APART, F.col("turn")).otherwise(F.raise_error(F.lit("a conversation has too many turns")))
    words = F.filter(F.split(F.lower(F.replace("text", F.lit('"'), F.lit(""))), r"\s+", -1), lambda w: F.length(w) > 2)
    good = F.coalesce(F.col("role") == "assistant", F.lit(False))
    turns, n = folds.in_order(table(spark, d, "conversations").select((F.col("conv_id") * TURNS_APART + turn).alias("_order"), good.alias("good"), "text"), "_order", F.col("good"))
    c = turns.select("seq", "good", F.explode_outer(F.array_distinct(words)).alias("token"))
    return folds.token_weights(c.where("token IS NOT NULL"), "token", "seq", F.col("good"), max(0, n - 1))


