"""Language identification, words first: a known word speaks by its frequency in each language, an unseen one by its character n-grams.

For every word of the training sample the model holds the logarithm of its frequency in each language. A word that is not among them falls back
to its n-grams with word marks, the longest first: the n-grams of the greatest length at which the model knows any of them speak for it
by their mean log frequency; single characters come last. A text's evidence is the sum over its words, whole texts always. The score is
the share of the best language after a softmax over the evidence divided by the root of the number of words, as neighbouring words are
not independent witnesses.

Learned from at most about ``SAMPLE`` documents of each language that are not held out. Words and n-grams are counted where the texts lie; the
driver gets the ``KEPT`` most frequent words and n-grams of each length, and nothing else. Words seen once teach n-grams only.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text where nothing could be learned. A null lang
teaches nothing. Ties go to the first language by code point. Result columns replace input columns of their name.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from confsieve.llm.common import extended, map_texts, pick, slices, with_columns, without
from confsieve.llm.subwords import WordTable, bounded_sample, held_out, ngrams
from confsieve.session import cut_lineage

#: Documents of a language in the sample; the longest n-grams; sightings from which a word or an n-gram is known; words, and n-grams of each
#: length, kept of each language: a language with much text takes no room from others, and the driver's model is bounded by the languages.
SAMPLE, LONGEST, WORD_MIN, GRAM_MIN, KEPT = 2000, 5, 2, 3, 30_000
UNKNOWN = "und"


def clean(word: str) -> str:
    """The word in lower case without what is not a letter at its ends; empty if it has no letter."""
    if word.isalpha():
        return word.lower()
    start, end = 0, len(word)
    while start < end and not word[start].isalpha():
        start += 1
    while end > start and not word[end - 1].isalpha():
        end -= 1
    return word[start:end].lower()


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray  # (known words, languages)
    grams: list[tuple[np.ndarray, np.ndarray]]  # for lengths 1 to LONGEST: sorted hashes, (n-grams, languages)

    def word_rows(self, raw: list[str]) -> np.ndarray:
        """For each word its evidence in each language, and 1 if it has a letter."""
        out = np.zeros((len(raw), len(self.langs) + 1))
        cleaned = [clean(w) for w in raw]
        known = np.array([self.words.get(w, -1) for w in cleaned], np.int64)
        out[:, -1] = [bool(w) for w in cleaned]
        out[known >= 0, :-1] = self.word_logs[known[known >= 0]]
        rest = np.flatnonzero((known < 0) & (out[:, -1] > 0))
        if len(rest):
            hashes, owner, order = ngrams([cleaned[i] for i in rest], 1, LONGEST)
            open_ = np.ones(len(rest), bool)
            for n in range(LONGEST, 0, -1):
                keys, logs = self.grams[n - 1]
                own = (order == n) & open_[owner]
                if not len(keys) or not own.any():
                    continue
                h, o = hashes[own], owner[own]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                at, o = at[hit], o[hit]
                n_hit = np.bincount(o, minlength=len(rest))
                found = n_hit > 0
                for k in range(len(self.langs)):
                    out[rest[found], k] = (np.bincount(o, logs[at, k], len(rest)) / np.maximum(n_hit, 1))[found]
                open_ &= ~found
        return out


def _logs(table: np.ndarray) -> np.ndarray:
    """Log frequencies by language with half a sighting added."""
    return np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * max(len(table), 1)))


def count_words(rows: DataFrame) -> DataFrame:
    """(lang, word, n) from (lang, text)."""

    def count(batches):
        totals: dict[str, Counter] = {}
        for batch, texts in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                totals.setdefault(lang, Counter()).update((text or b"").decode().split())
        for lang, words in totals.items():
            cleaned: Counter = Counter()
            for word, n in words.items():
                cleaned[clean(word)] += n
            cleaned.pop("", None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cleaned), pa.string()), pa.array(list(cleaned), pa.string()), pa.array(list(cleaned.values()), pa.int64())], names=["lang", "word", "n"])

    return rows.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame, columns: list[str]) -> DataFrame:
    """(length, gram, one count for each language) from (word, the same counts); ``gram`` is a hash."""

    def count(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 5_000):
                batch = whole.slice(at, 5_000)
                hashes, owner, order = ngrams(batch.column(0).to_pylist(), 1, LONGEST)
                own = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
                for n in range(1, LONGEST + 1):
                    keys, where = np.unique(hashes[order == n], return_inverse=True)
                    sums = [np.bincount(where, own[owner[order == n], k], len(keys)).astype(np.int64) for k in range(len(columns))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)), *map(pa.array, sums)], names=["length", "gram", *columns])

    schema = ", ".join(["length int, gram long", *[f"{c} long" for c in columns]])
    return words.select("word", *columns).mapInArrow(count, schema).groupBy("length", "gram").agg(*[F.sum(c).alias(c) for c in columns])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from the documents with a language that are not held out."""
    rows = pick(docs, "doc_id", "text", "lang")
    known = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    chosen, share = bounded_sample(known, "lang", sample)
    langs = sorted(share, key=lambda x: x.encode())
    if not langs:
        return Model([], {}, np.zeros((0, 0)), [(np.zeros(0, np.uint64), np.zeros((0, 0)))] * LONGEST)
    columns = [f"n{i}" for i in range(len(langs))]
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    by_word = count_words(chosen).groupBy("word").agg(*[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(c) for lang, c in zip(langs, columns)])
    by_word = cut_lineage(by_word, "lang-words")
    grams = cut_lineage(count_grams(by_word, columns), "lang-grams")

    def most(table: DataFrame, key: str, at_least: int):
        """The most frequent rows of each language, a bounded number: their keys and counts."""
        frequent = table.filter(total >= at_least)
        each = frequent.select(key, F.posexplode(F.array(*columns)).alias("lang", "n")).filter("n > 0")
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), key))
        best = each.withColumn("rank", rank).filter(F.col("rank") <= KEPT).select(key).distinct()
        got = frequent.join(best, key, "left_semi").orderBy(key).select(key, *columns).toArrow()
        counts = [got.column(c).to_numpy() for c in columns]
        return got.column(key), np.stack(counts, axis=1).astype(np.float64) if len(got) else np.zeros((0, len(columns)))

    words, counts = most(by_word, "word", WORD_MIN)
    tables = []
    for n in range(1, LONGEST + 1):
        # Of single characters all are known, so that every alphabet seen speaks.
        keys, table = most(grams.filter(F.col("length") == n), "gram", GRAM_MIN if n > 1 else 1)
        keys = np.ascontiguousarray(keys.to_numpy()).view(np.uint64) if len(keys) else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        tables.append((keys[order], _logs(table)[order]))
    return Model(langs, {w: i for i, w in enumerate(words.to_pylist())}, _logs(counts), tables)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score`` (0 to 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = without(docs, "held_out", "lang_pred", "score").withColumn("held_out", held_out(F.col("doc_id")))
    own: dict = {}

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        model = sent.value
        table = own.setdefault("table", WordTable(model.word_rows, len(model.langs) + 1))
        split = [(t or b"").decode().split() for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        numbers = table.numbers([w for words in split for w in words])
        rows = table.results()[numbers]
        sums = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)])
        ends = np.cumsum(counts)
        total = sums[ends] - sums[ends - counts]
        table.tidy()
        spoken = np.round(total[:, -1]) > 0
        if not model.langs:
            return with_columns(batch, lang_pred=pa.array([UNKNOWN] * len(texts), pa.string()), score=pa.array(np.zeros(len(texts))))
        evidence = total[:, :-1] / np.sqrt(np.maximum(total[:, -1:], 1))
        share = np.exp(evidence - evidence.max(axis=1, keepdims=True))
        best = evidence.argmax(axis=1)
        score = np.where(spoken, 1 / share.sum(axis=1), 0.0)
        return with_columns(batch, lang_pred=pa.array([model.langs[k] if s else UNKNOWN for k, s in zip(best, spoken)], pa.string()), score=pa.array(score))

    return map_texts(docs, extended(docs, StructField("lang_pred", StringType()), StructField("score", DoubleType())), run)
