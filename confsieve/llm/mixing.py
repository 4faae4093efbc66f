"""Mixing sources to target weights by entropy balancing.

A document's size is its number of words. The sources share all words by weights; no source may be asked for more than ``max_copies``
times what it has, and what it cannot give goes to the others. Of all rates at which documents could be taken, entropy balancing
chooses those nearest to one each (in relative entropy) whose words add up to each source's target:

    minimise sum r (log r - 1)  subject to  sum size r = target  for each source, r <= max_copies

The dual is convex with one unknown a source, and its solution tilts the rates exponentially: ``r = min(max_copies, exp(lambda size))``.
Newton's iterations solve it for all sources at once. They are distributed: a rate depends on source and size only, so each iteration
adds up a table of (source, size, documents), joined with the current lambdas. A bracket keeps Newton from overshooting.

Rates become whole copies: from the largest size to the smallest, each class of equal sizes gets the number of copies nearest to its
words plus what is still owed from larger sizes, so that a source misses its target by less than its smallest texts. Inside a class, the
documents with the smallest hashes of their ids get the odd copies. Nothing is random: reruns agree.

Defined cases: a null text has size 0 and keeps one copy. A null source is a source, the last one. Rows that share an id are
documents of their own. A result column replaces an input column of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confsieve.llm.common import pick, same, unused, without
from confsieve.session import cut_lineage

WEIGHTS, MAX_COPIES = (5, 2, 1), 3
#: Newton stops at this relative distance from every target. Hash buckets in which a class of equal sizes is counted.
TOLERANCE, MAX_STEPS, BUCKETS = 1e-7, 60, 256


def word_count(text: Column) -> Column:
    """Runs of anything but space and U+0009 to U+000D; 0 of null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ordered(source: Column) -> Column:
    """A key without nulls that sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(src, source_size, target) from a table (src, size): the share of each source, with what full sources cannot give shared again.

    The end of the sharing is ``min(max_copies * source_size, weight * level)`` for one level. Each round finds the sources that are full
    at the level so far and raises it for the others; the driver gets two sums a round.
    """
    sources = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy("src")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    sources = cut_lineage(sources.withColumn("weight", weight).withColumn("most", F.lit(max_copies) * F.col("source_size")), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        is_full = F.col("most") <= F.col("weight") * F.lit(level)
        given, open_weight, now_full = sources.agg(F.sum(F.when(is_full, F.col("most")).otherwise(0)), F.sum(F.when(~is_full, F.col("weight")).otherwise(0.0)), F.sum(is_full.cast("int"))).first()
        if not open_weight or now_full == full:
            break
        level, full = (total - given) / open_weight, now_full
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level))
    return sources.select("src", "source_size", target.alias("target"))


def rates(classes: DataFrame, goals: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(src, lambda) with ``sum of size * min(max_copies, exp(lambda * size / scale))`` equal to the target; null where every rate is the greatest.

    ``classes`` is (src, size, n). The bracket starts where Newton cannot leave it: at lambda 0 the words are the source's own.
    """
    scale = classes.groupBy("src").agg((F.sum(F.col("size") * F.col("n")) / F.sum(F.when(F.col("size") > 0, F.col("n")))).alias("scale"))
    state = goals.filter((F.col("target") < max_copies * F.col("source_size") * (1 - 1e-12)) & (F.col("source_size") > 0)).join(scale, "src")
    state = cut_lineage(state.select("src", "target", "scale", F.lit(0.0).alias("lam"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")), "mix-state")
    for _ in range(MAX_STEPS):
        z = F.col("size") / F.col("scale")
        rate = F.least(F.lit(float(max_copies)), F.exp(F.col("lam") * z))
        words = F.col("size") * F.col("n") * rate
        # Decimals add up to the same in any order, so reruns agree to the last digit.
        exact = lambda x: F.sum(x.cast("decimal(28,9)")).cast("double")
        sums = classes.join(state, "src").groupBy("src").agg(exact(words).alias("words"), exact(F.when(rate < max_copies, words * z).otherwise(0.0)).alias("slope"))
        gap = F.col("words") - F.col("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - gap / F.col("slope")
        wide = F.when(F.isnan("low") | (F.col("low") == float("-inf")), F.col("high") * 2 - 1).when(F.col("high") == float("inf"), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        moved = state.join(sums, "src").withColumns({"low": low, "high": high})
        moved = moved.withColumn("step", F.when((F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(wide))
        moved = moved.select("src", "target", "scale", F.when(gap == 0, F.col("lam")).otherwise(F.col("step")).alias("lam"), "low", "high", (F.abs(gap) / F.col("target")).alias("off"))
        moved = cut_lineage(moved, "mix-state")
        worst = moved.agg(F.max("off")).first()[0]
        state = moved.drop("off")
        if worst is None or worst < TOLERANCE:
            break
    return state.select("src", "lam", "scale")


def copies_by_class(classes: DataFrame, goals: DataFrame, lambdas: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(src, size, class_copies, rate): whole copies for each class of equal sizes, owed words handed from larger sizes to smaller ones.

    A source's classes are as many as its different sizes, so a group is bounded by the longest text, not by the number of documents.
    """
    table = classes.join(goals, "src").join(lambdas, "src", "left")
    tilted = F.least(F.lit(float(max_copies)), F.exp(F.col("lam") * F.col("size") / F.col("scale")))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), float(max_copies)).otherwise(tilted)

    def whole(group):
        group = group.sort_values("size", ascending=False, ignore_index=True)
        owed, out = 0.0, []
        for size, n, r in zip(group["size"], group["n"], group["rate"]):
            if size == 0:
                out.append(int(n))
                continue
            owed += r * size * n
            copies = int(min(max(round(owed / size), 0), max_copies * n))
            owed -= copies * size
            out.append(copies)
        group["class_copies"] = out
        return group

    return table.select("src", "size", "n", rate.alias("rate")).groupBy("src").applyInPandas(whole, "src string, size long, n long, rate double, class_copies long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(doc_id, src, size, source_size, target, rate, copies): a row for each row of ``docs``; ``copies`` says how often the mix has it."""
    narrow = pick(docs, "doc_id", "text", "source")
    hashed = F.xxhash64("doc_id")
    sizes = cut_lineage(narrow.select("doc_id", _ordered(F.col("source")).alias("src"), word_count(F.col("text")).alias("size"), hashed.alias("mix_hash")), "mix-sizes")
    part = F.pmod("mix_hash", F.lit(BUCKETS)).cast("int").alias("part")
    parts = cut_lineage(sizes.groupBy("src", "size", part).agg(F.count(F.lit(1)).alias("n")), "mix-parts")
    classes = cut_lineage(parts.groupBy("src", "size").agg(F.sum("n").alias("n")), "mix-classes")
    goals = cut_lineage(targets(classes.select("src", (F.col("size") * F.col("n")).alias("size")), weights, max_copies), "mix-goals")
    given = copies_by_class(classes, goals, rates(classes, goals, max_copies), max_copies)
    # Which documents of a class get one copy more: whole parts as far as they go, then by rank inside the part where they end.
    odd = F.col("class_copies") % F.col("n")
    by_class = given.select("src", "size", "rate", F.floor(F.col("class_copies") / F.col("n")).alias("base"), odd.alias("odd"))
    before = Window.partitionBy("src", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(by_class, ["src", "size"]).join(goals, "src")
    by_part = cut_lineage(by_part.select("src", "size", "part", "rate", "base", (F.col("odd") - F.col("before")).alias("odd"), "source_size", "target"), "mix-given")
    rank = F.row_number().over(Window.partitionBy("src", "size", "part").orderBy("mix_hash", "doc_id"))
    ranked = sizes.withColumn("part", part).withColumn("rank", rank)
    return ranked.join(by_part, ["src", "size", "part"]).select(
        "doc_id", "src", "size", "source_size", "target", "rate", (F.col("base") + (F.col("rank") <= F.col("odd")).cast("int")).cast("int").alias("copies")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``docs`` as the mix has it: a row as often as it has copies. Rows that share an id and a size share their copies evenly."""
    size_, src_, rank_, copies_, doc_, n_, from_, times_, copy_ = unused(docs, "size", "src", "rank", "copies", "doc", "n", "from", "times", "copy")
    size = word_count(F.col("text"))
    given = mix(docs, weights, max_copies).groupBy("doc_id", "src", "size").agg(F.array_sort(F.collect_list("copies")).alias(copies_))
    own = Window.partitionBy("doc_id", _ordered(F.col("source")), size).orderBy(F.xxhash64("text"))
    rows = docs.withColumns({size_: size, src_: _ordered(F.col("source")), rank_: F.row_number().over(own)})
    given = given.select(F.col("doc_id").alias(doc_), F.col("size").alias(n_), F.col("src").alias(from_), copies_)
    joined = rows.join(given, same(F.col("doc_id"), F.col(doc_)) & (F.col(size_) == F.col(n_)) & (F.col(src_) == F.col(from_)))
    repeated = joined.withColumn(times_, F.element_at(copies_, F.col(rank_))).filter(F.col(times_) > 0).withColumn(copy_, F.explode(F.sequence(F.lit(1), F.col(times_))))
    return without(repeated, size_, src_, rank_, doc_, n_, from_, copies_, times_, copy_)
