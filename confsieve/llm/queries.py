"""The registered queries of this folder, one for each operator, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confsieve.llm import byte_bpe, host_lines, langid, length_counts, lexical, line_dedup, lm_score, minhash, mixing, simhash, spelling, topk, toxicity
from confsieve.llm.common import pick, read
from confsieve.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


#: Lines of every document with their keys; white space is stripped by its code points, and only A-Z are lower-cased.
LINES_SQL = """
lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
),
shared AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
"""

OP1_SQL = f"""
WITH {LINES_SQL}
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT l.doc_id, i, line, s.key IS NOT NULL AND s.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key)
GROUP BY doc_id
"""


@query("op1_line_dedup", OP1_SQL)
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines each document has and loses, and the digest of what stays."""
    kept = line_dedup.drop_shared_lines(pick(read(spark, folder, "documents"), "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """For each encoded length: the documents of that length, up to it and over it, and the tokens left were every text cut to it."""
    counts = cut_lineage(length_counts.histogram(read(spark, folder, "documents"), *_vocabulary()), "lengths")
    total = counts.agg(F.sum(F.col("n_tokens") * F.col("n_docs"))).first()[0] or 0
    return length_counts.with_truncation(length_counts.suffix_sums(counts), total)


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """The number and digest of each document's token ids, and the digest of what they decode to."""
    path, pattern = _vocabulary()
    decoded = byte_bpe.encode(pick(read(spark, folder, "documents"), "doc_id", "text"), path, pattern, decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_source_mix")
def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's size, its source's size and target, and the words the mix takes of it."""
    mix = mixing.mix(read(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op4_simhash_groups")
def op4_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's fingerprint and the smallest document it is linked to, directly or through others."""
    groups = simhash.near_duplicates(read(spark, folder, "documents"))
    return groups.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query("op5_language_id")
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each document as its words and letters tell it."""
    docs = read(spark, folder, "documents")
    predicted = langid.predict(pick(docs, "doc_id", "text"), langid.fit(docs))
    return predicted.select("doc_id", "held_out", "lang_pred", "score")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """How likely each document is toxic."""
    docs = read(spark, folder, "documents")
    scored = toxicity.score(pick(docs, "doc_id", "text"), toxicity.fit(docs, read(spark, folder, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how near it is to the edited text and to the next document."""
    prints = minhash.edited(read(spark, folder, "documents"))
    return prints.select(
        "doc_id", "n_chars", F.sha2("text_edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        minhash.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        minhash.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


OP9_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
) WHERE rank <= 10
"""


@query("op9_top_k", OP9_SQL)
def op9_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best matches of every hundredth vector among all others."""
    return topk.top_k(read(spark, folder, "embeddings"))


@query("op3_lm_scores")
def op3_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The log probability of each document's words, each given the words on both sides of it."""
    scored = lm_score.pseudo_likelihood(pick(read(spark, folder, "documents"), "doc_id", "text"))
    return scored.select("doc_id", "mean_log_prob", "log_prob", "n_words")


#: The table of the CRC-32 of zip files, from its polynomial, and the sum over the UTF-8 bytes of a text whose code points are below U+0800.
CRC_SQL = """
crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(i)))
"""
_BYTES = "flatten(list_transform(regexp_extract_all(s, '.'), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [(192 + unicode(ch) // 64)::BIGINT, (128 + unicode(ch) % 64)::BIGINT] END))"
_CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], {_BYTES}), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::BIGINT)"
OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, n, {_CRC} AS h FROM (SELECT run, n, concat(doc_id, ':', run) AS s FROM runs), crc_table),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS MATERIALIZED (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b, b.n AS bn FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.cut = w.word UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.cut = w.word),
near AS (SELECT a AS word, count(*) AS n_near, max(bn) AS best_n, arg_min(b, (-bn, b)) AS best FROM pairs GROUP BY a),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN near USING (word)),
chain AS (SELECT word, form AS at FROM formed WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, n, n_near, form, form_n, coalesce(e.at, f.word) AS root FROM formed f LEFT JOIN ends e USING (word)
"""


@query("op11_spelling_variants", OP11_SQL)
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Each word, the words one edit from it, the far more frequent one that it may stand for, and where that leads."""
    return spelling.variants(read(spark, folder, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = "'[^\\x20\\x09-\\x0D]+'"
OP12_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS words FROM documents),
lines AS MATERIALIZED (SELECT r, source, line, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key, regexp_extract_all(line, {_WORD}) AS words
  FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE trim(line, {_BLANKS}) <> ''),
doubled AS (SELECT r, sum(n - 1)::BIGINT AS n_dup_lines FROM (SELECT r, line, count(*) AS n FROM lines GROUP BY ALL) GROUP BY r),
windows AS (SELECT r, i, array_to_string(words[i : i + 7], ' ') AS w FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM docs WHERE len(words) >= 8)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM again) GROUP BY r),
hosts AS (SELECT source, count(*) AS all_docs FROM docs GROUP BY source),
over AS (SELECT l.source, l.key FROM (SELECT source, key, count(DISTINCT r) AS n FROM lines GROUP BY ALL) l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE n >= 20 AND 100 * n > all_docs),
lost AS (SELECT r, sum(len(words)) AS words, sum(length(array_to_string(words, ''))) AS chars FROM lines l JOIN over o ON l.source IS NOT DISTINCT FROM o.source AND l.key = o.key GROUP BY r),
base AS (SELECT d.r, doc_id, len(d.words)::BIGINT AS n_words, length(array_to_string(d.words, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(l.words, 0) AS lost_words, coalesce(l.chars, 0) AS lost_chars
  FROM docs d LEFT JOIN doubled USING (r) LEFT JOIN repeated USING (r) LEFT JOIN lost l USING (r)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (2 * lost_chars > word_chars OR n_words - lost_words < 20) AS kept FROM judged
"""


@query("op12_quality_rules", OP12_SQL)
def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """What each document measures, and whether it is kept once the lines that its host repeats are gone."""
    return host_lines.judged(read(spark, folder, "documents")).select("doc_id", *host_lines.COUNTS, "base_failed", "kept")


OP13_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
q AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM d),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n::DOUBLE + 2) / (2 * df::DOUBLE + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
m AS (SELECT r, doc_id, 25 + (75 * len(terms) * n) // l AS m FROM d, s WHERE len(terms) > 0),
scores AS (SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r)::INTEGER AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""


@query("op13_ranked_search", OP13_SQL)
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every item."""
    return lexical.search(read(spark, folder, "documents"), read(spark, folder, "benchmark")).select("item_id", "rank", "doc_id", "score")
