"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's shingles of 5 words are hashed once. The top bits of a hash name its bin, and each bin keeps its smallest hash. An empty bin takes
the value of another one (optimal densification): it tries the bins in an order of its own, ``bin XOR r`` for a fixed random order of all
r, until one is filled, so equal sets agree and different ones agree no more often than filled bins do. Four low bits of each bin's value,
hashed with the bin, make the fingerprint, 256 bins in 256 hexadecimal digits. Two fingerprints that agree in a share p of the digits have the likeness
``(p - 1/16) / (1 - 1/16)``: the agreement of 4 bits by chance is taken out.

Expressions over whole arrays stand behind a one-row generator, as the optimizer would else copy them into every use.

Defined cases: a null text is an empty one. A text of fewer than 5 words is one shingle; texts without words have one fingerprint of their own.
A null id is an id of its own below all others. Every row has its row in the result; of rows that share an id, the text of smallest digest is the
next document of the id before. A single document follows itself. An empty table has no rows. Other columns are not looked at.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confsieve.llm.common import SPACE, pick
from confsieve.session import cut_lineage

SHINGLE, BIN_BITS, KEPT_BITS = 5, 8, 4
BINS, LOW = 1 << BIN_BITS, 64 - BIN_BITS
#: Bins tried one after the other before the rest is looked through at once.
TRIES = 12
_ORDER = random.Random(5).sample(range(1, BINS), BINS - 1)
_EMPTY = (1 << LOW) - 1


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column whose expression is worked out once for each row."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def word_hashes(text: Column) -> Column:
    words = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)), r"[ \t-\r]+")
    return F.transform(words, lambda w: F.xxhash64(w))


def add_fingerprint(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """Replaces the column of word hashes (see :func:`word_hashes`) by the fingerprint."""
    rest = [c for c in df.columns if c != hashes]
    words, size = F.col(hashes), F.size(hashes)
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(size - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    # One value above all others closes each bin, so that every bin has a smallest value after sorting.
    closing = F.array(*[F.lit((b << LOW) | _EMPTY) for b in range(-BINS // 2, BINS // 2)])
    df = held(df, "__sorted", F.sort_array(F.concat(shingles, closing))).select(*rest, "__sorted")
    bin_of = lambda x: F.shiftright(x, LOW)
    smallest = F.filter("__sorted", lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col("__sorted"), i - 1))))
    filled = F.transform(smallest, lambda x: F.when(x.bitwiseAND(F.lit(_EMPTY)) != F.lit(_EMPTY), x))
    df = held(df, "__bins", filled).select(*rest, "__bins")
    bins, order = F.col("__bins"), F.array(*[F.lit(r) for r in _ORDER])

    def digit(x: Column, i: Column) -> Column:
        tried = [F.get(bins, i.bitwiseXOR(F.lit(r))) for r in _ORDER[:TRIES]]
        others = F.get(F.filter(F.transform(order, lambda r: F.get(bins, i.bitwiseXOR(r))), lambda y: y.isNotNull()), F.lit(0))
        # Hashed with the bin, so that copies of one value in many bins agree with others' by chance for each bin anew.
        low = F.xxhash64(F.coalesce(x, *tried, others), i).bitwiseAND(F.lit((1 << KEPT_BITS) - 1))
        return F.substring(F.lit("0123456789abcdef"), (low + 1).cast("int"), F.lit(1))

    return df.select(*rest, F.array_join(F.transform(bins, digit), "").alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two fingerprints, 0 to 1."""
    agree = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))) / BINS
    chance = 1 / (1 << KEPT_BITS)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (agree - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of a text column."""
    return add_fingerprint(held(docs, "__words", word_hashes(F.col(text))), "__words", name)


def following(docs: DataFrame) -> DataFrame:
    """(doc_id, most, next): for each id the next one in ascending order, the first after the last; null ids come first.

    ``most`` is the largest number of code points of the id's texts, ``next`` (id, digest) of the next document; of rows that share an id, the
    one with the smallest digest. Ids are dealt to ranges, and only the first of each range leaves it. Nothing but numbers is moved.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = pick(docs, "doc_id", "text").select("doc_id", F.length(text).alias("n_chars"), F.xxhash64(text).alias("digest"))
    by_id = narrow.groupBy("doc_id").agg(F.max("n_chars").alias("most"), F.min("digest").alias("digest"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = by_id.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first()).withColumn("span", F.spark_partition_id())
    ranged = cut_lineage(ranged, "fingerprint-ranges")
    entry = F.struct("doc_id", "digest")
    heads = ranged.groupBy("span").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", entry.alias("entry")))["entry"].alias("head"))
    # A row for each range: as many as there are partitions.
    in_line = Window.orderBy("span")
    heads = heads.select("span", F.coalesce(F.lead("head").over(in_line), F.first("head").over(in_line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = F.lead(entry).over(Window.partitionBy("span").orderBy(F.col("doc_id").asc_nulls_first()))
    return ranged.withColumn("inside", inside).join(heads, "span").select("doc_id", "most", F.coalesce("inside", "after").alias("next"))


def _keyed(df: DataFrame, id_: str, name: str) -> DataFrame:
    """Adds the id as two columns without nulls, by which tables are joined and grouped alike, so that one shuffle serves both."""
    kind = df.schema[id_].dataType
    return df.withColumns({name: F.coalesce(F.col(id_), F.lit(0).cast(kind)), f"{name}_null": F.col(id_).isNull()})


def edited(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: its text with the last quarter replaced by the beginning of the next document's, and fingerprints.

    (doc_id, n_chars, text_edited, fingerprint, next_fingerprint, edited_fingerprint). Texts are shuffled once, by id, with the fingerprints
    made before; both joins read that shuffle. Beginnings of at most a quarter of the receiving text go to the document before.
    """
    links = following(docs).select(F.col("doc_id").alias("to_id"), F.floor(F.col("most") / 4).cast("int").alias("most"), F.col("next.doc_id").alias("from_id"), F.col("next.digest").alias("from_digest"))
    links = cut_lineage(_keyed(_keyed(links, "to_id", "to"), "from_id", "at").drop("to_id", "from_id"), "fingerprint-links")
    texts = _keyed(pick(docs, "doc_id", "text"), "doc_id", "at").select("at", "at_null", F.coalesce("text", F.lit("")).alias("text"))
    texts = fingerprints(texts)
    # A difference, not an equality: the digest is to be tested after the join by id, not to become a key of it.
    is_it = (F.xxhash64("text").bitwiseXOR(F.col("from_digest"))) == 0
    given = texts.join(links, ["at", "at_null"]).filter(is_it).select(F.col("to").alias("at"), F.col("to_null").alias("at_null"), F.col("fingerprint").alias("next_fingerprint"), F.substring("text", F.lit(1), F.col("most")).alias("begin"))
    given = given.groupBy("at", "at_null").agg(F.first("next_fingerprint").alias("next_fingerprint"), F.first("begin").alias("begin"))
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    text = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("begin", F.lit(1), quarter))
    doc_id = F.when(~F.col("at_null"), F.col("at")).alias("doc_id")
    joined = texts.join(given, ["at", "at_null"]).select(doc_id, n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", text.alias("text_edited"))
    return fingerprints(joined, "text_edited", "edited_fingerprint")
