"""The configuration corpus and the vendor documents: labels, facets, coverage, validation, sampling, field statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confsieve.functions.numbers import round_half_up
from confsieve.functions.tables import literal_map
from confsieve.session import cut_lineage

# Label file rules and the address blocks a published configuration may show.
REQUIRED_KEYS = [
    "sample_id", "vendor", "product", "device_type", "device_class", "network_role", "routing_capability", "os", "version", "category",
    "source_type", "configuration_format", "security_state", "controls_present", "controls_absent", "contains_secrets", "anonymized",
    "generation_date", "generator_version",
]
SAMPLE_ID = r"^[A-Z]{2,4}-[A-Z0-9_]+-[SME]-\d{3}$"
STATES = ["secure", "misconfigured", "edge_case"]
CATEGORIES = ["firewall", "router", "switch", "wifi", "iot"]
SAFE_PREFIXES = ["192.0.2.", "198.51.100.", "203.0.113.", "10.", "172.16.", "192.168.", "127.", "0.0.0.0", "255."]
POSTURES = {"secure": "hardened", "misconfigured": "weak", "edge_case": "edge_case"}
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
PLACEHOLDER = r"(?i)<[^>\s]+>|change_?me|example|redacted|\*{3,}"
SECRET = r"(?i)\b(?:password|secret|token|community|key)\b\s*[=:]?\s*\"?([^\s\"]+)"


def path_labels(files: DataFrame, path: str = "path") -> DataFrame:
    """Category, family, state and file stem out of ``.../<category>/[<group>/]<family>/<state>/<stem>.<extension>``."""
    p = F.col(path)
    state = F.regexp_extract(p, r"/(secure|misconfigured|edge_cases)/[^/]+$", 1)
    sample = F.regexp_extract(p, r"/([^/]+)\.[^./]+$", 1)
    return (
        files.withColumn("category", F.regexp_extract(p, r"/(firewall|routers|switches|wifi|iot)/", 1))
        .withColumn("family", F.regexp_extract(p, r"/([^/]+)/(?:secure|misconfigured|edge_cases)/[^/]+$", 1))
        .withColumn("state", F.when(state == "edge_cases", "edge_case").otherwise(state))
        .withColumn("sample_id", sample)
        .withColumn("state_letter", F.regexp_extract(sample, r"-([SME])-\d{3}$", 1))
        .withColumn("sample_no", F.regexp_extract(sample, r"-(\d{3})$", 1).try_cast("int"))
    )


def label_errors() -> Column:
    """All violations of a label record as an array of texts. Absent keys are null columns."""
    def bad(cond: Column, text: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(True)), F.lit(text))

    missing = [F.when(F.col(k).isNull(), F.lit(f"missing {k}")) for k in REQUIRED_KEYS]
    return F.array_compact(
        F.array(
            *missing,
            bad(~F.col("sample_id").rlike(SAMPLE_ID), "sample_id does not match pattern"),
            bad(~F.col("security_state").isin(STATES), "invalid security_state"),
            bad(~F.col("category").isin(CATEGORIES), "invalid category"),
            bad(F.col("device_class") == "", "device_class cannot be empty"),
            bad(F.col("network_role") == "", "network_role cannot be empty"),
            bad(F.col("contains_secrets"), "contains_secrets must be false"),
            bad(~F.col("anonymized"), "anonymized must be true"),
        )
    )


def unsafe_addresses(text: Column) -> Column:
    """IPv4 addresses outside the permitted blocks."""
    safe = F.lit(SAFE_PREFIXES)
    return F.filter(F.regexp_extract_all(text, F.lit(IPV4), F.lit(0)), lambda a: ~F.exists(safe, lambda p: F.startswith(a, p)))


def exposed_secrets(text: Column) -> Column:
    """Values after a secret keyword that are not placeholders."""
    return F.filter(F.regexp_extract_all(text, F.lit(SECRET), F.lit(1)), lambda v: ~F.regexp_like(v, F.lit(PLACEHOLDER)))


def manifest(samples: DataFrame, category: str, vendor: str, state: str) -> DataFrame:
    """Configurations, distinct vendors and states per category; distinct values are counted in two steps."""
    s = F.col(state)
    per_vendor = samples.groupBy(category, vendor).agg(F.count("*").alias("n"), *[F.count_if(s == v).alias(v) for v in STATES])
    return per_vendor.groupBy(category).agg(F.sum("n").alias("configs"), F.count(vendor).alias("vendors"), *[F.sum(v).alias(v) for v in STATES])


def facets(samples: DataFrame, columns: list[str]) -> DataFrame:
    """Totals per value of every facet from one pass: (facet, value, configs)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return samples.select(F.explode_outer(pairs).alias("x")).where(F.col("x").isNotNull()).groupBy("x.facet", "x.value").agg(F.count("*").alias("configs"))


def browse(samples: DataFrame, filters: dict, order: list[str], limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of the corpus under facet filters."""
    conds = [F.col(k) == v for k, v in filters.items()]
    out = samples.where(reduce(lambda a, b: a & b, conds)) if conds else samples
    return out.orderBy(*order).offset(offset).limit(limit)


def repeatable_sample(samples: DataFrame, key: str, seed: int, n: int = 25) -> DataFrame:
    """A random sample that repeats: the n smallest digests of (seed, key), found per partition and merged."""
    return samples.withColumn("_d", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_d").limit(n).drop("_d")


def stratified_sample(samples: DataFrame, strata: list[str], key: str, seed: int, n: int) -> DataFrame:
    """A sample of about ``n`` that spans all strata and repeats: shares by largest remainder, one row a stratum at least, and in each stratum the
    rows of smallest digest. The window is limited on the map side, so that a task hands on no more rows of a stratum than its share.
    """
    sizes = cut_lineage(samples.groupBy(*strata).agg(F.count("*").alias("_size")), "strata")
    total = sizes.agg(F.sum("_size")).first()[0] or 1
    exact = F.lit(float(n)) * F.col("_size") / F.lit(total)
    shares = sizes.withColumn("_base", F.floor(exact)).withColumn("_left", exact - F.floor(exact))
    spare = n - (shares.agg(F.sum("_base")).first()[0] or 0)
    # Fewer places are spare than there are strata, so the greatest remainders are a bounded top-k and no sort of all strata.
    lucky = shares.orderBy(F.desc("_left"), *strata).limit(int(spare)).select(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(strata)], F.lit(1).alias("_more"))
    matched = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_l{i}")) for i, c in enumerate(strata)])
    given = F.greatest(F.col("_base") + F.coalesce("_more", F.lit(0)), F.lit(1)).alias("_n")
    quota = cut_lineage(shares.join(lucky, matched, "left").select(*[F.col(c).alias(f"_q{i}") for i, c in enumerate(strata)], given), "quota")
    most = quota.agg(F.max("_n")).first()[0] or 1
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    ranked = samples.withColumn("_k", F.row_number().over(Window.partitionBy(*strata).orderBy(digest, key))).where(F.col("_k") <= int(most))
    matched = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_q{i}")) for i, c in enumerate(strata)])
    return ranked.join(quota, matched).where(F.col("_k") <= F.col("_n")).select(*samples.columns)


def lone_labels(labels: DataFrame, configs: DataFrame, key: str) -> DataFrame:
    """Labels whose configuration is not there."""
    return labels.join(configs.select(key), key, "left_anti")


def reconcile(configs: DataFrame, labels: DataFrame, stem: str) -> DataFrame:
    """(stem, error) of configurations without a label and labels without a configuration. One shuffle: both sides are counted by stem together."""
    both = configs.select(stem, F.lit(1).alias("_c"), F.lit(0).alias("_l")).unionByName(labels.select(stem, F.lit(0).alias("_c"), F.lit(1).alias("_l")))
    seen = both.groupBy(stem).agg(F.max("_c").alias("_c"), F.max("_l").alias("_l")).where("_c + _l = 1")
    return seen.select(stem, F.when(F.col("_c") == 0, "label without configuration").otherwise("configuration without label").alias("error"))


def manifest_errors(found: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """(key, declared, found, error) where the counts of a manifest are not those found."""
    j = declared.join(found, key, "full")
    kind = F.when(F.col("found").isNull(), "declared and not found").when(F.col("declared").isNull(), "found and not declared").otherwise("counts differ")
    zero = F.lit(0).cast("long")
    return j.where(~F.col("found").eqNullSafe(F.col("declared"))).select(key, F.coalesce("declared", zero).alias("declared"), F.coalesce("found", zero).alias("found"), kind.alias("error"))


def first_errors(errors: DataFrame, order: list[str], message: str, n: int = 20) -> DataFrame:
    """The first ``n`` errors, a top-k, and one row more that says how many are not shown."""
    more = errors.agg((F.count("*") - n).alias("_more")).where("_more > 0")
    rest = more.select(*[(F.concat(F.lit("and "), "_more", F.lit(" more")) if c == message else F.lit(None)).cast(errors.schema[c].dataType).alias(c) for c in errors.columns])
    return errors.orderBy(*order).limit(n).unionByName(rest)


def coverage(records: DataFrame, topic: str, vendor: str, vendors: list[str]) -> DataFrame:
    """Topic by vendor matrix of record counts; the vendor list is given, so no extra pass finds it."""
    return records.groupBy(topic).pivot(vendor, vendors).agg(F.count(F.lit(1))).fillna(0, subset=vendors)


def field_statistics(data: DataFrame, fields: list[str] | None = None, sample: int = 10) -> DataFrame:
    """Per field its type, values, nulls, distinct values and a sample, and of numbers min, max, mean and sum (texts that are numbers count as such).

    One scan melts the fields to (field, value) and counts equal values where they lie; a second level works on distinct values only. Nested fields
    go by their JSON text, so that every field has a row. The sample is the first ``sample`` values, limited on the map side.
    """
    fields = fields or data.columns
    types = {f.name: f.dataType for f in data.schema.fields}

    def text_of(c: str) -> Column:
        nested = types[c].typeName() in ("struct", "array", "map", "variant")
        return F.to_json(F.col(f"`{c}`")) if nested else F.col(f"`{c}`").cast("string")

    melted = data.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), text_of(c).alias("value")) for c in fields])).alias("m")).select("m.*")
    values = cut_lineage(melted.groupBy("field", "value").agg(F.count("*").alias("times")), "field-values")
    x, n = F.col("value").try_cast("double"), F.col("times")
    is_number = x.isNotNull()
    exact = F.col("value").try_cast("decimal(38,6)")
    per = values.groupBy("field").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), n)), F.lit(0)).alias("values"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), n)), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        F.coalesce(F.sum(F.when(is_number, n)), F.lit(0)).alias("numbers"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        F.sum(exact * n.cast("decimal(20,0)")).cast("double").alias("_sum"),
    )
    order = Window.partitionBy("field").orderBy("value")
    heads = values.where(F.col("value").isNotNull()).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= sample)
    shown = heads.groupBy("field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "value"))), lambda r: r["value"]), ",").alias("sample"))
    kinds = literal_map({c: types[c].typeName() for c in fields})
    joined = per.join(shown, "field", "left")
    return joined.select(
        "field", F.try_element_at(kinds, F.col("field")).alias("type"), "values", "nulls", "distinct_values", "numbers", "min", "max",
        round_half_up(F.col("_sum") / F.col("numbers"), 4).alias("mean"), round_half_up(F.col("_sum"), 2).alias("sum"), "sample",
    )


def preserve_label(samples: DataFrame, label: str, legacy: str, derived: Column) -> DataFrame:
    """Writes a derived label and keeps the original one exactly once, so that a second run changes nothing."""
    kept = F.coalesce(F.col(legacy), F.col(label)) if legacy in samples.columns else F.col(label)
    return samples.withColumn(legacy, kept).withColumn(label, derived)
