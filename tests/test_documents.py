"""Loaders: YAML and JSON documents as a data source, rule catalogues with references, corpus samples and reconciliation."""

import json

import pytest
from pyspark.sql import functions as F

from confsieve.operators import corpus
from confsieve.plans.evidences import catalogue_file
from confsieve.sources import configs, documents


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.yaml").write_text("---\nname: one\nport: 22\ntags: [x, y]\n---\nname: two\nport: 2.5\nnested: {up: true}\n")
    (tmp_path / "b.json").write_text(json.dumps({"records": [{"name": "three", "port": None}, {"name": "four", "nested": {"up": False, "why": "z"}}]}))
    (tmp_path / "c.jsonl").write_text('{"name": "five"}\n{"name": "six", "tags": []}\n')
    (tmp_path / "ignored.txt").write_text("not: read")
    return tmp_path


def test_documents_source_infers_and_reads_a_partition_a_file(spark, folder):
    documents.register(spark)
    got = spark.read.format("documents").load(str(folder))
    assert got.schema["port"].dataType.typeName() == "double" and {f.name for f in got.schema["nested"].dataType.fields} == {"up", "why"}
    assert got.rdd.getNumPartitions() == 3
    rows = {r["name"]: r for r in got.collect()}
    assert set(rows) == {"one", "two", "three", "four", "five", "six"}
    assert rows["one"].port == 22.0 and rows["one"].tags == ["x", "y"] and rows["two"].nested.up is True and rows["three"].port is None


def test_broken_files_are_told_or_fail(spark, folder):
    documents.register(spark)
    (folder / "d.yaml").write_text("a: [1, 2")
    said = spark.read.format("documents").schema("name string, _error string").load(str(folder)).filter("_error is not null").collect()
    assert [r._error.split(":")[0] for r in said] == ["d.yaml"]
    with pytest.raises(Exception, match="cannot be parsed"):
        spark.read.format("documents").schema("name string").load(str(folder)).collect()


def test_datasets_by_ending(spark, folder):
    assert configs.load_dataset(spark, str(folder / "a.yaml")).count() == 2
    assert configs.load_dataset(spark, str(folder / "c.jsonl")).count() == 2
    assert configs.load_dataset(spark, str(folder / "ignored.txt")).first().value == "not: read"


def test_rule_catalogue_keeps_references_and_types(spark):
    from confsieve.catalog.rules import RULES

    loaded = {r["id"]: r for r in configs.load_rules(spark, catalogue_file(spark))}
    assert set(loaded) == {r["id"] for r in RULES}
    for r in RULES:
        got = loaded[r["id"]]
        assert (got["expected"], got["operator"], got["known_insecure_defaults"]) == (r["expected"], r["operator"], r["known_insecure_defaults"])
        assert got["references"][1] == {"benchmark": "own", "control_id": r["id"]}
        assert {v: c for v, (c, _) in got["remediation"].items()} == r["remediation"]


def test_vendor_documents_without_repeats(spark, tmp_path):
    rows = [{"vendor": "a", "topic": "t"}, {"vendor": "a", "topic": "t"}, {"vendor": "b"}]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "v.json").write_text(json.dumps(rows[0]))
    assert configs.load_vendor_docs(spark, [str(tmp_path / "m.json")], [str(tmp_path / "v.json")]).count() == 2


def test_sample_spans_all_strata(spark):
    rows = [(i, "big") for i in range(500)] + [(1000 + i, f"small{i}") for i in range(8)] + [(2000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, vendor string")
    got = corpus.stratified_sample(docs, ["vendor"], "doc_id", 7, 40)
    taken = {r.vendor: r["count"] for r in got.groupBy("vendor").count().collect()}
    assert len(taken) == 10 and taken["big"] >= 30 and got.count() <= 50
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in corpus.stratified_sample(docs.repartition(5), ["vendor"], "doc_id", 7, 40).collect())


def test_statistics_cover_every_type_in_one_scan(spark):
    data = spark.createDataFrame([(1, "x", True), (2, "3.5", None), (None, "x", False)], "n int, t string, b boolean").withColumn("s", F.struct("n", "b")).withColumn("d", F.to_date(F.lit("2024-01-02")))
    got = {r.field: r for r in corpus.field_statistics(data).collect()}
    assert set(got) == {"n", "t", "b", "s", "d"}
    assert (got["n"].numbers, got["n"].nulls, got["n"].sum, got["n"].mean) == (2, 1, 3.0, 1.5)
    assert (got["t"].numbers, got["t"].distinct_values, got["t"].sample) == (1, 2, "3.5,x")
    assert got["b"].distinct_values == 2 and got["d"].sample == "2024-01-02" and got["s"].type == "struct"
    assert {r.error for r in corpus.reconcile(data.select("t"), data.limit(0).select("t"), "t").collect()} == {"configuration without label"}
