"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word's features are the word itself and its character n-grams, hashed into ``BUCKETS`` rows of an embedding table; a misspelling
shares most of them with the word it hides. A window of a text is the average of its features' embeddings, and a linear softmax gives the
odds of the toxic class. A text is as toxic as its worst window, so a few words are not thinned out by a long text; training follows the
same rule and moves the worst window of each text. The softmax over two classes is written as the logistic of the difference of the two
classes' weights. A logistic scale, fitted on the sample and corrected for its class shares, turns the worst window into a probability.

The sample: at most about ``SAMPLE`` labelled documents of each class, and ``SAMPLE_BYTES`` of text, none of them held out. The model is 0.5 MB.

A word said over and over counts once in a window.

Defined cases: a text without words gets the share of toxic ones among the labels. Labels that are null do not count; of several labels of a
document the largest does. Without labels of both classes every score is the share of toxic ones among them (0 without any).
Result columns replace input columns of their name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from confsieve.llm.common import extended, map_texts, pick, with_columns, without
from confsieve.llm.subwords import WordTable, bounded_sample, held_out, ngrams, windows

SAMPLE, SAMPLE_BYTES, THRESHOLD = 2500, 16 << 20, 0.3
BUCKETS, DIM, SHORT, LONG = 1 << 17, 8, 3, 5
WINDOW, STEP, EPOCHS, GROUPS, RATE = 8, 4, 16, 12, 0.5
#: Marks stripped from the ends of a word before its features are taken.
MARKS = ".,;:!?|%*$&#\"'()[]{}<>-_/\\"


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number), sorted by word."""
    hashes, owner, _ = ngrams([w.lower().strip(MARKS) for w in words], SHORT, LONG, whole=True)
    order = np.argsort(owner, kind="stable")
    return (hashes % np.uint64(BUCKETS)).astype(np.int32)[order], owner[order].astype(np.int32)


@dataclass
class Model:
    weight: np.ndarray  # per bucket, the embedding times the difference of the classes' weights
    bias: float
    scale: float
    shift: float
    base: float  # share of the toxic class among all labels, the score of a text without words

    def word_rows(self, words: list[str]) -> np.ndarray:
        """For each word the sum of its features' weights, and their number."""
        bucket, owner = features(words)
        return np.stack([np.bincount(owner, self.weight[bucket], len(words)), np.bincount(owner, minlength=len(words))], axis=1)


def earlier(numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word the place of the same word before it in its text, -1 without one. In a window it counts if that lies before the start."""
    order = np.argsort(numbers, kind="stable")
    document = np.repeat(np.arange(len(counts)), counts)
    same = (np.diff(numbers[order]) == 0) & (np.diff(document[order]) == 0)
    out = np.full(len(numbers), -1, np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


def worst_windows(numbers: np.ndarray, counts: np.ndarray, rows: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, start, end) of the window with the greatest mean weight of each text; the mean of a text without words is 0."""
    own = rows[numbers]
    sums = np.concatenate([np.zeros((1, 2)), np.cumsum(own, axis=0)])
    start, end, document = windows(counts, WINDOW, STEP)
    total = sums[end] - sums[start]
    # What a window repeats is taken out of it: of the windows that hold the word, those that start at or before the earlier one.
    again = np.flatnonzero((before >= 0) & (np.arange(len(before)) - before < WINDOW))
    begin, number = np.cumsum(counts) - counts, np.bincount(document, minlength=len(counts))
    text = np.repeat(np.arange(len(counts)), counts)[again]
    low = np.maximum(-(-(again - begin[text] - WINDOW + 1) // STEP), 0)
    high = np.minimum((before[again] - begin[text]) // STEP, number[text] - 1)
    for more in range(-(-WINDOW // STEP)):
        held = low + more <= high
        at = (np.cumsum(number) - number)[text[held]] + low[held] + more
        for column in range(2):
            total[:, column] -= np.bincount(at, own[again[held], column], len(total))
    mean = total[:, 0] / np.maximum(total[:, 1], 1)
    best = np.lexsort((-mean, document))[np.r_[0, np.flatnonzero(np.diff(document)) + 1]] if len(document) else np.array([], np.int64)
    return mean[best], start[best], end[best]


def train(texts: list[bytes | None], toxic: list[int], share: dict[int, float], seed: int = 7) -> Model:
    """Joint gradient steps (Adagrad) on embeddings and softmax weights, then the logistic scale."""
    y, rng = np.array(toxic, np.float64), np.random.default_rng(seed)
    if len(set(toxic)) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 0.0, 0.0, float(y.mean()) if len(y) else 0.0)
    table: dict[str, int] = {}
    numbers = []
    for text in texts:
        own = (text or b"").decode().split()
        numbers.append(np.fromiter((table.setdefault(w, len(table)) for w in own), np.int32, len(own)))
    words = list(table)
    del table
    parts = [features(words[at : at + 20_000]) for at in range(0, len(words), 20_000)]
    size = np.concatenate([np.zeros(0, np.int64), *[np.bincount(owner, minlength=min(20_000, len(words) - 20_000 * i)) for i, (_, owner) in enumerate(parts)]])
    bucket = np.concatenate([np.zeros(0, np.int32), *[b for b, _ in parts]])
    del parts, words
    first = np.cumsum(size) - size
    embed = np.zeros((BUCKETS, DIM), np.float32)  # from nothing, so that features never seen say nothing
    heads = rng.standard_normal((DIM, 2))
    embed_sq, heads_sq, bias, bias_sq = np.full(BUCKETS, 1e-6), np.full((DIM, 2), 1e-6), np.array([2.0, -2.0]), np.full(2, 1.0)

    def spread(of: np.ndarray) -> np.ndarray:
        """The positions of the features of these words."""
        n = size[of]
        return np.repeat(first[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def judged(some: np.ndarray):
        own = np.concatenate([numbers[i] for i in some])
        used, where = np.unique(own, return_inverse=True)
        at = spread(used)
        weight = embed @ (heads[:, 1] - heads[:, 0]).astype(np.float32)
        who = np.repeat(np.arange(len(used)), size[used])
        rows = np.stack([np.bincount(who, weight[bucket[at]], len(used)), size[used]], axis=1)
        counts = np.array([len(numbers[i]) for i in some])
        before = earlier(where, counts)
        return own, before, *worst_windows(where, counts, rows, before)

    # A fifth of the sample is kept from the steps and sets the scale, so that it is not fitted to texts learned by heart.
    kept = np.arange(len(texts)) % 5 == 4 if len(set(y[4::5])) == 2 and len(set(np.delete(y, np.s_[4::5]))) == 2 else np.zeros(len(texts), bool)
    taught = np.flatnonzero(~kept)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for some in np.array_split(rng.permutation(taught), min(GROUPS, len(taught))):
            own, before, mean, start, end = judged(some)
            n = end - start
            at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            window = np.repeat(np.arange(len(some)), n)
            first_said = before[at] < start[window]
            member, window = own[at[first_said]], window[first_said]
            total = np.maximum(np.bincount(window, size[member], len(some)), 1)
            window, buckets = np.repeat(window, size[member]), bucket[spread(member)]
            average = np.stack([np.bincount(window, embed[buckets, d], len(some)) for d in range(DIM)], axis=1) / total[:, None]
            logits = average @ heads + bias
            soft = np.exp(logits - logits.max(axis=1, keepdims=True))
            soft /= soft.sum(axis=1, keepdims=True)
            error = (soft - np.stack([1 - y[some], y[some]], axis=1)) / len(some)
            to_average = error @ heads.T / total[:, None]
            touched, place = np.unique(buckets, return_inverse=True)
            change = np.stack([np.bincount(place, to_average[window, d], len(touched)) for d in range(DIM)], axis=1)
            embed_sq[touched] += (change**2).mean(axis=1)
            embed[touched] -= (rate * change / np.sqrt(embed_sq[touched])[:, None]).astype(np.float32)
            change = average.T @ error
            heads_sq += change**2
            heads -= 0.1 * rate * change / np.sqrt(heads_sq)
            bias_sq += error.sum(axis=0) ** 2
            bias -= 0.1 * rate * error.sum(axis=0) / np.sqrt(bias_sq)
    worst = np.concatenate([judged(some)[2] for some in np.array_split(np.arange(len(texts)), min(GROUPS, len(texts)))]) + bias[1] - bias[0]
    spoken = np.array([len(n) > 0 for n in numbers]) & (kept if kept.any() else True)
    scale, shift = logistic(worst[spoken], y[spoken]) if spoken.any() else (0.0, 0.0)
    shift -= np.log(share.get(1, 1.0) / share.get(0, 1.0))
    n1, n0 = y.sum() / share.get(1, 1.0), (len(y) - y.sum()) / share.get(0, 1.0)
    return Model(embed @ (heads[:, 1] - heads[:, 0]), float(bias[1] - bias[0]), scale, shift, float(n1 / (n1 + n0)))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a one-variable logistic regression by damped Newton steps, with targets drawn in a little so that they exist."""
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design, beta = np.stack([x / (x.std() + 1e-12), np.ones(len(x))], axis=1), np.zeros(2)

    def loss(b):
        z = design @ b
        return np.logaddexp(0, z).sum() - (goal * z).sum() + 1e-3 * (b**2).sum()

    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        move = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 2e-3 * np.eye(2), design.T @ (p - goal) + 2e-3 * beta)
        step = 1.0
        while step > 1e-6 and loss(beta - step * move) > loss(beta):
            step /= 2
        beta = beta - step * move
        if np.abs(step * move).max() < 1e-9:
            break
    return float(beta[0] / (x.std() + 1e-12)), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Trains on a bounded sample of labelled documents that are not held out; the driver gets that sample and nothing else."""
    known = pick(labels, "doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = pick(docs, "doc_id", "text")
    chosen, share = bounded_sample(known, "toxic", sample)

    def gather(ids: DataFrame) -> DataFrame:
        # Bounded by the sample size, so the ids may go to all tasks.
        return texts.join(F.broadcast(ids), "doc_id")

    size = gather(chosen).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > sample_bytes:
        part = sample_bytes / size
        chosen = chosen.filter(F.pmod(F.xxhash64("doc_id", F.lit("bytes")), F.lit(1 << 30)) / float(1 << 30) < part)
    rows = sorted(((r[0], r[1], r[2]) for r in gather(chosen).select("doc_id", "toxic", "text").toLocalIterator()), key=lambda r: (r[0], r[2] or ""))
    return train([r[2].encode() if r[2] is not None else None for r in rows], [r[1] for r in rows], share)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = without(docs, "held_out", "score", "predicted").withColumn("held_out", held_out(F.col("doc_id")))
    own: dict = {}

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        model = sent.value
        table = own.setdefault("table", WordTable(model.word_rows, 2))
        split = [(t or b"").decode().split() for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        numbers = table.numbers([w for words in split for w in words])
        mean, _, _ = worst_windows(numbers, counts, table.results(), earlier(numbers, counts))
        table.tidy()
        z = (mean + model.bias) * model.scale + model.shift
        p = np.where((counts > 0) & (model.scale != 0), 1 / (1 + np.exp(-np.clip(z, -700, 700))), model.base)
        return with_columns(batch, score=pa.array(p, pa.float64()), predicted=pa.array((p >= threshold).astype(np.int32)))

    return map_texts(docs, extended(docs, StructField("score", DoubleType()), StructField("predicted", IntegerType())), run)
