"""A hash-chained ledger that is appended and verified in parallel, and whose every block commits to all before it.

Every block's digest covers the digest before it, so one chain is sequential by nature. A chain is therefore cut into segments by event number.
Inside a segment blocks link one to the next. The first block links to an anchor that covers the contents of *all* segments before it:
segments are leaves of a tree by their number, a node's digest is over its children's, and an anchor is over the digests of everything to the
left on the way from the root to the segment. Empty numbers leave no trace, so a removed segment, wherever it lies, changes the
anchor and the numbering of all that follow. No task folds more than one segment or one node's children.

A ledger grows by appends, which are its parts. What comes late goes into the part it comes with; the base of a part is the digest of the last
block before it (zeros for the first). Blocks once written do not change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confsieve.functions.digest import canonical, sha256

#: Events of a segment, children of a node.
SEGMENT, FAN = 256, 256
NO_PREVIOUS = "0" * 64


def block_digest(index: Column, ts: Column, previous: Column, kind: Column, payload: Column) -> Column:
    return sha256(canonical(index, ts, previous, kind, payload, F.lit(0)))


def content_digest(seq: Column, ts: Column, kind: Column, payload: Column) -> Column:
    """What a block says, apart from where it is linked."""
    return sha256(canonical(seq, ts, kind, payload))


def segment_of(seq: Column) -> Column:
    return F.floor(seq / SEGMENT).cast("bigint")


def _before(nodes: DataFrame, keys: list[str], greatest: int) -> DataFrame:
    """Adds to nodes (keys, at, digest, n) what lies before each: ``history``, a digest of it (null for nothing), and ``offset``, its blocks."""
    if greatest == 0:
        return nodes.select(*keys, "at", F.lit(None).cast("string").alias("history"), F.lit(0).cast("bigint").alias("offset"))
    up = F.floor(F.col("at") / FAN).cast("bigint")
    gathered = nodes.groupBy(*keys, up.alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "digest", "n"))).alias("kids"))
    parents = gathered.select(*keys, F.col("up").alias("at"), sha256(F.array_join(F.transform("kids", lambda x: x["digest"]), "")).alias("digest"), _total(F.col("kids")).alias("n"))
    above = _before(parents, keys, greatest // FAN).withColumnsRenamed({"at": "up", "history": "_above", "offset": "_start"})
    each = gathered.select(*keys, "up", "kids", F.posexplode_outer("kids").alias("i", "kid"))
    left = F.slice("kids", F.lit(1), F.col("i"))
    beside = sha256(F.array_join(F.transform(left, lambda x: x["digest"]), ""))
    each = each.select(*keys, "up", "i", F.col("kid.at").alias("at"), beside.alias("_beside"), _total(left).alias("_n"))
    history = F.when(F.col("i") == 0, F.col("_above")).otherwise(sha256(canonical(F.col("_above"), F.col("_beside"))))
    return each.join(above, [*keys, "up"]).select(*keys, "at", history.alias("history"), (F.col("_start") + F.col("_n")).alias("offset"))


def _total(kids: Column) -> Column:
    return F.aggregate(kids, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])


def _anchor(base: Column, history: Column) -> Column:
    return F.when(history.isNull(), base).otherwise(sha256(canonical(base, history)))


def _greatest(rows: DataFrame, number: Column) -> int:
    return rows.agg(F.max(number)).first()[0] or 0


def append_blocks(events: DataFrame, chain: str, seq: str, tips: DataFrame | None = None) -> DataFrame:
    """Events (chain, seq, ts_us, kind, payload) to linked blocks. ``seq`` is a distinct whole number >= 0 per chain in one append.

    ``tips`` (chain, tip_hash, tip_blocks) says where chains ended before; without it every chain starts.
    """
    entry = F.struct(F.col(seq).alias("seq"), F.col("ts_us"), F.col("kind"), F.col("payload"))
    segments = events.groupBy(F.col(chain).alias("chain"), segment_of(F.col(seq)).alias("segment")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    said = F.transform("entries", lambda e: content_digest(e["seq"], e["ts_us"], e["kind"], e["payload"]))
    nodes = segments.select("chain", F.col("segment").alias("at"), sha256(F.array_join(said, "")).alias("digest"), F.size("entries").cast("bigint").alias("n"))
    placed = segments.join(_before(nodes, ["chain"], _greatest(events, segment_of(F.col(seq)))).withColumnRenamed("at", "segment"), ["chain", "segment"])
    if tips is None:
        placed = placed.withColumns({"tip_hash": F.lit(NO_PREVIOUS), "tip_blocks": F.lit(0).cast("bigint")})
    else:
        placed = placed.join(tips.select("chain", "tip_hash", "tip_blocks"), "chain", "left").withColumns(
            {"tip_hash": F.coalesce("tip_hash", F.lit(NO_PREVIOUS)), "tip_blocks": F.coalesce("tip_blocks", F.lit(0).cast("bigint"))}
        )
    placed = placed.withColumns({"anchor": _anchor(F.col("tip_hash"), F.col("history")), "first": F.col("tip_blocks") + F.col("offset")})
    linked = F.aggregate(
        F.transform("entries", lambda e, i: F.struct((F.col("first") + i).alias("i"), e.alias("e"))),
        F.array().cast("array<struct<block_index:bigint,seq:bigint,ts_us:bigint,kind:string,payload:string,previous_hash:string,block_hash:string>>"),
        lambda acc, x: F.concat(acc, F.array(_next_block(acc, x))),
    )
    return placed.select("chain", "segment", F.explode_outer(linked).alias("b")).where(F.col("b").isNotNull()).select("chain", "segment", "b.*")


def tips_of(blocks: DataFrame) -> DataFrame:
    """(chain, tip_hash, tip_blocks): the last block of each chain and how many there are."""
    last = blocks.groupBy("chain").agg(F.max_by(F.struct("block_hash", "block_index"), "block_index").alias("t"))
    return last.select("chain", F.col("t.block_hash").alias("tip_hash"), (F.col("t.block_index") + 1).alias("tip_blocks"))


def _next_block(acc: Column, x: Column) -> Column:
    previous = F.when(F.size(acc) > 0, F.try_element_at(acc, F.lit(-1))["block_hash"]).otherwise(F.col("anchor"))
    e = x["e"]
    return F.struct(
        x["i"].alias("block_index"),
        e["seq"].cast("bigint").alias("seq"),
        e["ts_us"].cast("bigint").alias("ts_us"),
        e["kind"].alias("kind"),
        e["payload"].alias("payload"),
        previous.alias("previous_hash"),
        block_digest(x["i"], e["ts_us"], previous, e["kind"], e["payload"]).alias("block_hash"),
    )


def verify_blocks(blocks: DataFrame, part: str | None = None) -> DataFrame:
    """Every block with what is wrong with it in ``fault``, null if nothing is. ``part`` names the column that tells appends apart.

    A block's predecessor is found by a lag inside its segment, which holds no more than SEGMENT blocks. Anchors and numbers are worked out
    anew from the contents of all segments there are; the base of a part is the last digest of the part before it.
    """
    from pyspark.sql import Window

    rows = blocks.withColumn("_part", F.col(part) if part else F.lit(0))
    keys = ["chain", "_part"]
    said = F.struct("seq", content_digest(F.col("seq"), F.col("ts_us"), F.col("kind"), F.col("payload")).alias("c"))
    nodes = rows.groupBy(*keys, F.col("segment").alias("at")).agg(F.array_sort(F.collect_list(said)).alias("cs"))
    nodes = nodes.select(*keys, "at", sha256(F.array_join(F.transform("cs", lambda x: x["c"]), "")).alias("digest"), F.size("cs").cast("bigint").alias("n"))
    before = _before(nodes, keys, _greatest(rows, F.col("segment"))).withColumnRenamed("at", "segment")
    # One row a chain and append.
    ends = rows.groupBy(*keys).agg(F.max_by("block_hash", "block_index").alias("_end"), F.count("*").alias("_size"))
    line = Window.partitionBy("chain").orderBy("_part")
    bases = ends.select(*keys, F.coalesce(F.lag("_end").over(line), F.lit(NO_PREVIOUS)).alias("_base"), F.coalesce(F.sum("_size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    in_segment = Window.partitionBy(*keys, "segment").orderBy("block_index", "seq")
    checked = rows.join(before, [*keys, "segment"]).join(bases, keys).withColumns({"_place": F.row_number().over(in_segment) - 1, "_link": F.lag("block_hash").over(in_segment)})
    previous = F.when(F.col("_place") > 0, F.col("_link")).otherwise(_anchor(F.col("_base"), F.col("history")))
    expected = block_digest(F.col("block_index"), F.col("ts_us"), F.col("previous_hash"), F.col("kind"), F.col("payload"))
    fault = (
        F.when(~F.col("block_hash").eqNullSafe(expected), "hash mismatch")
        .when(~F.col("previous_hash").eqNullSafe(previous), "broken link")
        .when(F.col("block_index") != F.col("_earlier") + F.col("offset") + F.col("_place"), "wrong number")
    )
    return checked.select(*blocks.columns, fault.alias("fault"))


def first_fault(verified: DataFrame) -> DataFrame:
    """One row per chain: its number of blocks, the faults, and the place of the first."""
    bad = F.col("fault").isNotNull()
    return verified.groupBy("chain").agg(
        F.count("*").alias("blocks"),
        F.count_if(bad).alias("faults"),
        F.min(F.when(bad, F.col("seq"))).alias("first_seq"),
        F.min(F.when(bad, F.struct("seq", "fault")))["fault"].alias("first_fault"),
    )


def latest_report_check(blocks: DataFrame, reports: DataFrame) -> DataFrame:
    """Digest of each report as it is now against the one recorded last; ``reports`` has chain and report_text."""
    recorded = blocks.where(F.col("kind") == "REPORT_INTEGRITY").groupBy("chain").agg(F.max_by("payload", "seq").alias("stored_hash"))
    current = reports.select("chain", sha256(F.col("report_text")).alias("current_hash"))
    return current.join(recorded, "chain", "left").withColumn(
        "verdict",
        F.when(F.col("stored_hash").isNull(), "NOT RECORDED").when(F.col("stored_hash") == F.col("current_hash"), "VERIFIED").otherwise("TAMPER DETECTED"),
    )


def merge_ledgers(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored blocks whose digest is not among the current ones are added."""
    return current.unionByName(stored.join(current.select("block_hash"), "block_hash", "left_anti").select(current.columns))


# Payload fields per event kind, in the order they are digested.
PAYLOAD_FIELDS = {
    "RULE_APPROVAL": ["rule_id", "version", "rule_sha256", "approvers", "rationale", "approval_count", "status"],
    "REPORT_INTEGRITY": ["report_id", "report_sha256", "goal", "summary", "report_length_bytes"],
    "KNOWLEDGE_CONFIRMATION": ["vendor", "raw_pattern", "baseline_field_path", "confirmed_by", "pattern_sha256"],
    "HUMAN_DECISION": ["device_id", "rule_id", "command_raw", "command_hash", "decision", "reviewer", "notes", "has_uploaded_info", "uploaded_info_hash"],
}


def payload(kind: str) -> Column:
    """The payload text of one event kind from columns of the same names."""
    return canonical(*[F.col(f) for f in PAYLOAD_FIELDS[kind]])
