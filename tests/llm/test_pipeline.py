"""The pipeline against a plain Python run of its rules on the same decisions of the trained model."""

import pytest
import tiktoken
import public_tokenizers
from test_mix_and_search import plain_targets, words
from test_texts import plain_groups, plain_lines, plain_simhash

import corpus_pipeline
from confsieve.llm import byte_bpe, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before the first stage and after each."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_columns_stay_until_the_last(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_toxic_documents_go(spark, stages):
    scored = toxicity.score(stages[0], toxicity.fit(stages[0], spark.read.parquet(f"{FOLDER}/labels.parquet")))
    assert sorted(rows(scored.filter("predicted = 0"))) == sorted(rows(stages[1]))


def test_shared_lines_go(stages):
    before = rows(stages[1])
    kept = {r[0]: r[3] for r in plain_lines(before)}
    assert sorted(rows(stages[2])) == sorted((i, kept[i], lang, source, len(kept[i])) for i, _, lang, source, _ in before)


def test_near_copies_go(stages):
    before = sorted(rows(stages[2]))
    groups = plain_groups([plain_simhash(r[1]) for r in before])
    assert sorted(rows(stages[3])) == [r for i, r in enumerate(before) if groups[i] == i]


def test_mix_meets_targets(stages):
    before, after = rows(stages[3]), rows(stages[4])
    sizes, taken = {}, {}
    for r in before:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    for r in after:
        taken[r[3]] = taken.get(r[3], 0) + words(r[1])
    goal, most = plain_targets(sizes), {}
    for r in before:
        most[r[3]] = max(most.get(r[3], 0), words(r[1]))
    assert all(abs(taken.get(s, 0) - goal[s]) <= max(0.05 * goal[s], 3) for s in goal)
    assert set(after) <= set(before) and max(after.count(r) for r in set(after)) <= 3


def test_ids_are_those_of_the_library(stages):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    assert sorted(rows(stages[5])) == sorted(rows(stages[4]))
    for r in stages[5].collect():
        assert r.ids == library.encode_ordinary(r.text) and r.n_tokens == len(r.ids) and r.round_trip


def test_stages_take_edges(spark, edge, empty):
    for docs in (edge, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        docs.count()


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(rows(corpus_pipeline.run(spark, FOLDER))) == sorted(rows(stages[-1]))


def test_stages_keep_columns_with_clashing_names(spark, stages, tmp_path):
    """Columns named like results or helpers come through every stage but the last as they were."""
    from conftest import CLASHING
    from pyspark.sql import functions as F

    docs = stages[0].limit(60).withColumns({name: F.concat(F.lit("mine "), F.col("doc_id")) for name in CLASHING})
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "byte_bpe":
            assert out.columns == docs.columns
            assert out.filter(" OR ".join(f"`{c}` <> concat('mine ', doc_id)" for c in CLASHING)).isEmpty()
        docs = out
    assert docs.count() > 20


def test_stages_on_edge_rows(spark, edge, empty, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows; and a table without rows."""
    spark.createDataFrame([*[(i, 1, 0) for i in range(1, 18) if i != 10], (10, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, start in enumerate((edge, empty)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{k}-{name}")
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() > 0 if k == 0 else docs.count() == 0
