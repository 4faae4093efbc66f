"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

Every word is predicted from the two words on each side of it; the sum of the conditional log probabilities is the document's score.
Words are ids: the most frequent ones have their own, all others share hash buckets. The network adds an embedding for each place of the
window, takes tanh, and predicts first the class of the word (32 classes of 32 ids, by frequency), then the word in its class. A word
without an id of its own is then told from the others of its bucket by its share of the bucket's counts, so the score is one of words.

1. All words of all documents are counted; the most frequent become the vocabulary, their logs the starting biases.
2. Training runs where the texts lie. In each round every task takes gradient steps (Adagrad) from the common parameters on its own documents,
   and the results are averaged by the number of words seen, in two levels. Each round trains on one in ``PART`` positions of every
   document, chosen by a hash of place and neighbours; the rounds together train on every position once. Ids are written when words have been
   counted; training and scoring read them and no texts.
3. All positions of all documents are scored. The share of a word in its bucket comes from the counts: those of the ``KNOWN`` next frequent
   words are sent to the tasks, all others meet the distinct words of each document in a join. One count a bucket is left for unseen words.

CPU is the limit here. Arrow tells the words of a slice apart, so that a word is looked up once a slice, and positions are handled side by side by the class of
their word, a column each, so that the sums of a softmax run along memory.

The driver holds the vocabulary, the known counts and the parameters, a few MB at any input. Scores depend in the last digits on how rows are dealt to tasks.

Defined cases: a text without words, or null, has 0 words, log probability 0 and no mean. Result columns replace input columns of their name.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from confsieve.llm.common import extended, map_texts, pick, slices, with_columns, without
from confsieve.session import cut_lineage

CLASSES, WIDE = 32, 32
IDS = CLASSES * WIDE
FREQUENT, PAD = 24 * WIDE, IDS
OFFSETS, DIM = (-2, -1, 1, 2), 24
ROUNDS, BATCH, RATE = 2, 8192, 0.3
#: A round trains on one in so many positions, so that the rounds together train on every position once.
PART = ROUNDS
#: Distinct words a task counts, and ids it remembers, before it hands out or starts anew; pieces the parameters travel in.
WORDS_KEPT, PIECES, FAN = 400_000, 32, 32
#: Words below the frequent ones whose counts are sent to the tasks; the others are too rare to be hot keys of a join.
KNOWN = 1 << 15
MARKS = b".,;:!?|%*$&#\"'()[]{}<>"
_SHAPES = {"places": (len(OFFSETS), IDS + 1, DIM), "hidden": (DIM,), "classes": (DIM, CLASSES), "class_bias": (CLASSES,), "words": (CLASSES, DIM, WIDE), "word_bias": (CLASSES, WIDE)}


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def words_told(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """:func:`words_of` of many texts: (for each word its place among the distinct ones, words of each text, the distinct words as they first come).

    Arrow splits and tells words apart, so that Python meets each distinct word of a slice once."""
    # Bytes seen as a string, unchecked: the kernels for ASCII leave all other bytes alone.
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string())))
    pieces = lists.flatten().view(pa.large_binary())
    owner = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    there = pc.greater(pc.binary_length(pieces), 0)  # white space at an end of a text leaves an empty piece
    told = pieces.filter(there).dictionary_encode()
    distinct = told.dictionary.cast(pa.binary())
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), b" ")
    return told.indices.to_numpy(), np.bincount(owner[there.to_numpy(zero_copy_only=False)], minlength=len(texts)), joined[0].as_py().split()


class Ids(dict):
    """Word to id; a word without one gets the bucket of its hash. Marks at the ends of a word do not count."""

    def __init__(self, frequent: list[bytes]):
        self.frequent = {w: i for i, w in enumerate(frequent)}

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(MARKS) or word
        n = self.frequent.get(bare, -1)
        if n < 0:
            n = FREQUENT + xxhash.xxh64_intdigest(bare) % (IDS - FREQUENT)
        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = n
        return n


def placed(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids with two pads before, between and after the texts, where the words are, words of each text)."""
    at = np.arange(len(flat)) + 2 * np.repeat(np.arange(1, len(counts) + 1), counts)
    out = np.full(len(flat) + 2 * (len(counts) + 1), PAD, np.int16)
    out[at] = flat
    return out, at, counts


def laid_out(ids: Ids, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    split = [words_of(t) for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    return placed(np.fromiter(map(ids.__getitem__, chain.from_iterable(split)), np.int16, int(counts.sum())), counts)


def texts_laid_out(frequent: list[bytes]):
    ids = Ids(frequent)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, texts in slices(batches):
            yield laid_out(ids, texts)

    return lay


def ids_laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From a table of :func:`encoded`: ids are written once and then read."""
    for _, ids in slices(batches, "ids"):
        yield placed(np.frombuffer(b"".join(ids), np.int16), np.array([len(x) // 2 for x in ids], np.int64))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[bytes, int] = {}

        def rows() -> pa.RecordBatch:
            bare: Counter = Counter()
            for word, n in totals.items():
                bare[word.strip(MARKS) or word] += n
            return pa.RecordBatch.from_arrays([pa.array(list(bare), pa.binary()), pa.array(list(bare.values()), pa.int64())], names=["word", "n"])

        for _, texts in slices(batches):
            places, _, words = words_told(texts)
            for word, n in zip(words, np.bincount(places, minlength=len(words)).tolist()):
                totals[word] = totals.get(word, 0) + n
            if len(totals) > WORDS_KEPT:
                yield rows()
                totals.clear()
        if totals:
            yield rows()

    return pick(docs, "text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in _SHAPES]).astype(np.float32)


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = values[at : at + n].reshape(shape).copy()
        at += n
    return out


def start(counts: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters before training: small embeddings, and biases that give each id its frequency."""
    rng = np.random.default_rng(seed)
    by_class = counts.reshape(CLASSES, WIDE) + 0.5
    params = {name: np.zeros(shape, np.float32) for name, shape in _SHAPES.items()}
    params["places"] = (rng.standard_normal(_SHAPES["places"]) * 0.1).astype(np.float32)
    params["classes"] = (rng.standard_normal(_SHAPES["classes"]) * 0.1).astype(np.float32)
    params["words"] = (rng.standard_normal(_SHAPES["words"]) * 0.1).astype(np.float32)
    params["class_bias"] = np.log(by_class.sum(axis=1) / by_class.sum()).astype(np.float32)
    params["word_bias"] = np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32)
    return params


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Over the first axis: a position is a column, so that each pass runs along memory."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def hidden(params: dict, line: np.ndarray, at: np.ndarray) -> np.ndarray:
    total, one = (np.empty((len(at), DIM), np.float32) for _ in range(2))
    for place, offset in enumerate(OFFSETS):
        # Ids are below the size of the table; ``clip`` only spares the copy that the other modes make of ``out``.
        params["places"][place].take(line[at + offset], axis=0, out=one if place else total, mode="clip")
        if place:
            total += one
    total += params["hidden"]
    return np.tanh(total, out=total)


def by_class(line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(order of the positions by the class of their word, their words in that order, (class, from, to) of each class that is there)."""
    target = line[at]
    # Sorting small integers is a radix sort.
    group = target // WIDE
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=CLASSES)).tolist()
    return order, target[order], [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]


def distributions(params: dict, h: np.ndarray, runs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For positions side by side by class, a column each: the probabilities of the classes, and of the words of their class."""
    of_class = params["classes"].T @ h.T
    of_class += params["class_bias"][:, None]
    of_word = np.empty((WIDE, len(h)), np.float32)
    for c, a, b in runs:
        np.matmul(params["words"][c].T, h[a:b].T, out=of_word[:, a:b])
        of_word[:, a:b] += params["word_bias"][c][:, None]
    return _softmax(of_class), _softmax(of_word)


def log_probabilities(params: dict, line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each position in ``at``: log P(word | the words around it)."""
    out = np.empty(len(at))
    for low in range(0, len(at), BATCH):
        some = at[low : low + BATCH]
        order, target, runs = by_class(line, some)
        of_class, of_word = distributions(params, hidden(params, line, some[order]), runs)
        columns = np.arange(len(some))
        p = of_class[target // WIDE, columns].astype(np.float64) * of_word[target % WIDE, columns]
        out[low + order] = np.log(np.maximum(p, 1e-30))
    return out


def step(params: dict, seen: dict, line: np.ndarray, at: np.ndarray, rate: float) -> None:
    """One Adagrad step on these positions."""
    order, target, runs = by_class(line, at)
    at, columns = at[order], np.arange(len(at))
    h = hidden(params, line, at)
    grads = {name: np.zeros(shape, np.float32) for name, shape in _SHAPES.items() if name != "places"}
    of_class, of_word = distributions(params, h, runs)
    of_class[target // WIDE, columns] -= 1
    of_word[target % WIDE, columns] -= 1
    grads["classes"], grads["class_bias"] = h.T @ of_class.T, of_class.sum(axis=1)
    back = of_class.T @ params["classes"].T
    for c, a, b in runs:
        error = of_word[:, a:b]
        np.matmul(h[a:b].T, error.T, out=grads["words"][c])
        error.sum(axis=1, out=grads["word_bias"][c])
        back[a:b] += error.T @ params["words"][c].T
    h *= h
    back *= np.subtract(1, h, out=h)
    grads["hidden"] = back.sum(axis=0)
    for name, grad in grads.items():
        grad /= len(at)
        seen[name] += grad * grad
        params[name] -= rate * grad / np.sqrt(seen[name])
    back /= len(at)
    for place, offset in enumerate(OFFSETS):
        ids = line[at + offset]
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        starts = np.r_[0, np.flatnonzero(np.diff(ids)) + 1]
        grad, ids = np.add.reduceat(back.take(order, axis=0), starts, axis=0), ids[starts]
        squares = seen["places"][place][ids] + grad * grad
        seen["places"][place][ids] = squares
        params["places"][place][ids] -= rate * grad / np.sqrt(squares)


def chosen(line: np.ndarray, at: np.ndarray, counts: np.ndarray, part: int) -> np.ndarray:
    """The positions of one part in ``PART``, by a hash of the place in the text and the words around it; the word itself has no say."""
    place = (np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
    mixed = (place * np.uint64(0x9E3779B97F4A7C15)) ^ (line[at - 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (line[at + 1].astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return at[(mixed >> np.uint64(40)) % np.uint64(PART) == np.uint64(part)]


def train_round(docs: DataFrame, frequent: list[bytes], params: dict, part: int) -> dict:
    """One round of local steps and averaging, over texts or over their written ids."""
    spark, written = docs.sparkSession, "ids" in docs.columns
    sent = spark.sparkContext.broadcast((frequent, flat(params)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, values = sent.value
        params, lay = shaped(values), ids_laid_out if written else texts_laid_out(frequent)
        seen = {name: np.full(shape, 1e-4, np.float32) for name, shape in _SHAPES.items()}
        total = 0
        for line, at, counts in lay(batches):
            own = chosen(line, at, counts, part)
            for low in range(0, len(own), BATCH):
                step(params, seen, line, own[low : low + BATCH], RATE)
            total += len(own)
        if total:
            pieces = np.array_split(flat(params) * np.float32(1), PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary()), pa.array([total] * PIECES, pa.int64())], names=["piece", "data", "n"])

    def average(key, group):
        n = group["n"].to_numpy(np.float64)
        mean = sum(np.frombuffer(d, np.float32).astype(np.float64) * w for d, w in zip(group["data"], n)) / n.sum()
        row = group.iloc[:1].copy()
        row["data"], row["n"] = [mean.astype(np.float32).tobytes()], [int(n.sum())]
        return row

    own = pick(docs, "ids" if written else "text").mapInArrow(local, "piece int, data binary, n long").withColumn("fan", F.spark_partition_id() % FAN)
    schema = "piece int, data binary, n long, fan int"
    first = own.groupBy("piece", "fan").applyInPandas(average, schema)
    rows = first.groupBy("piece").applyInPandas(average, schema).select("piece", "data").collect()  # the parameters once
    return shaped(np.concatenate([np.frombuffer(r.data, np.float32) for r in sorted(rows)])) if rows else params


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents, written."""
    return cut_lineage(count_words(docs), "words")


def fit(docs: DataFrame, rounds: int = ROUNDS, counted: DataFrame | None = None) -> tuple[list[bytes], dict]:
    """The vocabulary and the trained parameters; ``counted`` are the written counts of ``docs`` where the caller has them."""
    counted = word_counts(docs) if counted is None else counted
    frequent, params = untrained(counted)
    return frequent, trained(pick(docs, "text"), frequent, params, rounds)


def untrained(counted: DataFrame) -> tuple[list[bytes], dict]:
    top = counted.orderBy(F.col("n").desc(), "word").limit(FREQUENT).collect()
    frequent = [bytes(r.word) for r in top]
    total = counted.agg(F.sum("n")).first()[0] or 0
    counts = np.zeros(IDS)
    counts[: len(top)] = [r.n for r in top]
    counts[FREQUENT:] = (total - counts.sum()) / (IDS - FREQUENT)
    return frequent, start(counts)


def trained(docs: DataFrame, frequent: list[bytes], params: dict, rounds: int = ROUNDS) -> dict:
    for part in range(rounds):
        params = train_round(docs, frequent, params, part)
    return params


def bucket_logs(counted: DataFrame, frequent: list[bytes]) -> np.ndarray:
    """For each bucket the log of the summed counts of its words and one for those unseen."""
    sent = counted.sparkSession.sparkContext.broadcast(frequent)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sums = Ids(sent.value), np.zeros(IDS, np.int64)
        for batch in batches:
            of = np.fromiter(map(ids.__getitem__, batch.column(0).to_pylist()), np.int64, batch.num_rows)
            np.add.at(sums, of, batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(range(IDS - FREQUENT), pa.int32()), pa.array(sums[FREQUENT:])], names=["bucket", "n"])

    out = np.ones(IDS - FREQUENT)
    for r in counted.select("word", "n").mapInArrow(totals, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r.bucket] += r.n
    return np.log(out)


class Codes(dict):
    """Word to code: below ``FREQUENT`` its id, from there on its place among the words without one, whose bucket and log count are kept in lists."""

    def __init__(self, frequent: list[bytes], known: dict[bytes, float], rest: np.ndarray):
        self.frequent, self.known, self.rest = {w: i for i, w in enumerate(frequent)}, known, rest
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.words: list[bytes] = []
        self.buckets, self.logs = array("h"), array("d")

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(MARKS) or word
        code = self.frequent.get(bare)
        if code is None:
            code = FREQUENT + len(self.words)
            self.words.append(bare)
            self.buckets.append(FREQUENT + xxhash.xxh64_intdigest(bare) % (IDS - FREQUENT))
            self.logs.append(self.known.get(bare, np.nan))
        self[word] = code
        return code

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(ids, words of each text, shares, rare). ``shares``: for each text, what its words say about their buckets, the log of the count of a word
        less that of the bucket, unknown words as if seen once; ``rare``: the unknown (word, times)."""
        if len(self) > WORDS_KEPT:
            self._forget()
        places, counts, words = words_told(texts)
        codes = np.fromiter(map(self.__getitem__, words), np.int32, len(words))[places]
        buckets, logs = np.array(self.buckets, np.int16), np.array(self.logs, np.float64)
        tail = np.flatnonzero(codes >= FREQUENT)
        place = codes[tail] - FREQUENT
        ids = codes.astype(np.int16)
        ids[tail] = buckets[place]
        document = np.repeat(np.arange(len(texts)), counts)[tail]
        said = logs[place]
        shares = np.bincount(document, np.nan_to_num(said) - self.rest[ids[tail] - FREQUENT], len(texts)).astype(np.float64)
        unknown = np.isnan(said)
        each, times = np.unique(document[unknown] * (len(self.words) + 1) + place[unknown], return_counts=True)
        owner, word = np.divmod(each, len(self.words) + 1)
        offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
        pairs = [pa.array([self.words[i] for i in word.tolist()], pa.binary()), pa.array(times.astype(np.int64))]
        return ids, counts, shares, pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(pairs, names=["word", "times"]))


def _known(counted: DataFrame, frequent: list[bytes]) -> tuple[dict[bytes, float], np.ndarray]:
    top = counted.orderBy(F.col("n").desc(), "word").limit(FREQUENT + KNOWN).collect()  # bounded
    own_id = set(frequent)
    return {bytes(r.word): float(np.log(r.n)) for r in top if bytes(r.word) not in own_id}, bucket_logs(counted, frequent)


RARE = ArrayType(StructType([StructField("word", BinaryType()), StructField("times", LongType())]))
SCORES = [StructField("n_words", LongType()), StructField("log_prob", DoubleType()), StructField("mean_log_prob", DoubleType())]


def encoded(docs: DataFrame, frequent: list[bytes], counted: DataFrame) -> DataFrame:
    """A written table of the columns of ``docs`` but the text (``doc``), row, ids (two bytes a word), ``shares`` and ``rare`` (see :class:`Codes`)."""
    sent = docs.sparkSession.sparkContext.broadcast((frequent, *_known(counted, frequent)))
    own: dict = {}

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        if not own:
            own.update(codes=Codes(*sent.value))
        ids, counts, sums, rare = own["codes"].encode(texts)
        ends = np.cumsum(counts)
        cut = pa.array([ids[a:b].tobytes() for a, b in zip(ends - counts, ends)], pa.binary())
        return with_columns(batch.drop_columns(["text"]), ids=cut, shares=pa.array(sums), rare=rare)

    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
    base = docs.select(F.struct(*rest).alias("doc"), F.monotonically_increasing_id().alias("row"), _text(docs))
    fields = [StructField("ids", BinaryType()), StructField("shares", DoubleType()), StructField("rare", RARE)]
    return cut_lineage(map_texts(base, extended(base.drop("text"), *fields), run), "lm-ids")


def _text(docs: DataFrame):
    name = next((c for c in docs.columns if c.lower() == "text"), None)
    return (F.col(f"`{name}`") if name else F.lit(None)).cast("string").alias("text")


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Trains on all of ``docs`` and scores them: their columns but the text, and ``n_words``, ``log_prob`` and ``mean_log_prob``.

    Texts are read twice, to count words and to write their ids; training and scoring read the ids."""
    docs = without(docs, "n_words", "log_prob", "mean_log_prob")
    counted = word_counts(docs)
    frequent, params = untrained(counted)
    table = encoded(docs, frequent, counted)
    params = trained(table, frequent, params, rounds)
    sent = docs.sparkSession.sparkContext.broadcast(flat(params))
    own: dict = {}

    def run(batch: pa.RecordBatch, ids: list) -> pa.RecordBatch:
        if not own:
            own.update(params=shaped(sent.value))
        line, at, counts = placed(np.frombuffer(b"".join(ids), np.int16), np.array([len(x) // 2 for x in ids], np.int64))
        total = _sums(log_probabilities(own["params"], line, at), counts) + batch.column(batch.schema.get_field_index("shares")).to_numpy()
        return with_columns(batch.drop_columns(["ids", "shares"]), n_words=pa.array(counts), log_prob=pa.array(total))

    base = table.drop("rare")
    scored = map_texts(base, extended(base.drop("ids", "shares"), *SCORES[:2]), run, "ids")
    added = _added(table.select("row", "rare"), counted)
    whole = scored.join(added, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("added", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob")
    return whole.select("doc.*", "n_words", "log_prob", mean)


def _sums(logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums, ends = np.r_[0.0, np.cumsum(logs)], np.cumsum(counts)
    return np.where(counts > 0, sums[ends] - sums[ends - counts], 0.0)


def _added(rare: DataFrame, counted: DataFrame) -> DataFrame:
    """(row, added): the logs of the counts of words too rare to be sent. The log of a count of one, as of one unseen, is 0."""
    words = rare.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.times").alias("times"))
    return words.join(counted.filter("n > 1").select("word", F.log("n").alias("log_n")), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("log_n")).alias("added"))


def score(docs: DataFrame, frequent: list[bytes], params: dict, counted: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``log_prob`` (summed over all words) and ``mean_log_prob``, by a model trained before.

    ``counted`` are the counts (word, n) of the corpus. Without them all words of a bucket are one word.
    """
    shared = counted is not None
    sent = docs.sparkSession.sparkContext.broadcast((frequent, flat(params), *(_known(counted, frequent) if shared else ({}, np.zeros(IDS - FREQUENT)))))
    docs = without(docs, "n_words", "log_prob", "mean_log_prob")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"), _text(docs))
    own: dict = {}

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        if not own:
            own.update(codes=Codes(sent.value[0], *sent.value[2:]), params=shaped(sent.value[1]))
        ids, counts, sums, rare = own["codes"].encode(texts)
        total, columns = _sums(log_probabilities(own["params"], *placed(ids, counts)[:2]), counts), {}
        if shared:
            total, columns["rare"] = total + sums, rare
        return with_columns(batch.drop_columns(["text"]), n_words=pa.array(counts), log_prob=pa.array(total), **columns)

    scored = map_texts(base, extended(base.drop("text"), *SCORES[:2], *([StructField("rare", RARE)] if shared else [])), run)
    if shared:
        scored = cut_lineage(scored, "lm-scored")  # written, so that the row numbers hold from here on
        added = _added(scored.select("row", "rare"), counted)
        scored = scored.join(added, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("added", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob")
    return scored.select("doc.*", "n_words", "log_prob", mean)
