"""Byte-level BPE and token counts against the tokenizer library."""

import random

import public_tokenizers
import pytest
import tiktoken
from conftest import edge_rows

from confsieve.llm import byte_bpe, length_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = byte_bpe.load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(RANKS, byte_bpe.merge_tree(RANKS), PATTERN)


def test_encoder_equals_library(encoder):
    rnd = random.Random(1)
    parts = ["a", "e", "r", "s", " ", "t", "h", "the", "ing", "\n", "\t", "é", "ß", "日", "本", "'s", "'LL", "1", "2", "!", "=", "-", "  ", "\x1c", "\x85", "\xa0", " ", "\U0001f600", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))
        assert encoder.encode(text) == LIBRARY.encode_ordinary(text)
        assert encoder.length(text) == len(LIBRARY.encode_ordinary(text))


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 20_000, "ab" * 20_000, "-" * 20_000, "\n" * 5_000, "é" * 20_000, "0" * 20_000, "thethe" * 9_000])
def test_long_runs_are_linear_and_equal(encoder, text):
    assert encoder.encode(text) == LIBRARY.encode_ordinary(text)


def test_small_vocabulary_agrees_with_plain_merging():
    rnd = random.Random(2)
    for _ in range(30):
        ranks = {bytes([b]): b for b in range(256)}
        known = [b"a", b"b", b"c"]
        while len(ranks) < 290:
            token = rnd.choice(known) + rnd.choice(known)
            if token not in ranks and len(byte_bpe.merged(token, ranks, 1 << 30)) == 2:
                ranks[token] = len(ranks)
                known.append(token)
        own = byte_bpe.Encoder(ranks, byte_bpe.merge_tree(ranks), PATTERN)
        for _ in range(60):
            piece = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))
            assert [own.token[i] for i in own.piece(piece)] == byte_bpe.merged(piece.encode(), ranks, 1 << 30)


def test_columns_and_round_trip(clashing):
    ids = byte_bpe.encode(clashing, PATH, PATTERN)
    got = byte_bpe.decode(ids, PATH).collect()
    at_once = byte_bpe.encode(clashing, PATH, PATTERN, decoded=True)
    assert sorted((str(r.ids), r.decoded) for r in at_once.collect()) == sorted((str(r.ids), r.decoded) for r in got)
    assert ids.columns.count("ids") == 1 and len(got) == len(edge_rows())
    for r in got:
        assert r.ids == LIBRARY.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_decode_edges(spark, empty):
    got = byte_bpe.decode(spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "k int, ids array<int>"), PATH).orderBy("k").collect()
    assert [r.decoded and bytes(r.decoded) for r in got] == [None, b"", b'!"']
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([([50256],)], "ids array<int>"), PATH).collect()
    assert byte_bpe.decode(byte_bpe.encode(empty, PATH, PATTERN), PATH).count() == 0


def test_counts_answer_every_limit(edge, empty):
    lengths = [len(LIBRARY.encode_ordinary(r[1] or "")) for r in edge_rows()]
    sums = length_counts.suffix_sums(length_counts.histogram(edge, PATH, PATTERN))
    for r in length_counts.with_truncation(sums, sum(lengths)).collect():
        n = r.n_tokens
        assert r.n_docs == lengths.count(n) and r.docs_up_to == sum(x <= n for x in lengths) and r.docs_longer == sum(x > n for x in lengths)
        assert r.tokens_longer == sum(x for x in lengths if x > n) and r.truncated_total == sum(min(x, n) for x in lengths)
    for limit in (0, 3, 50, 10**6):
        assert length_counts.answer(sums, limit) == (sum(min(x, limit) for x in lengths), sum(x > limit for x in lengths))
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert length_counts.quantile(sums, share) == min(x for x in lengths if sum(y <= x for y in lengths) >= share * len(lengths))
    assert length_counts.suffix_sums(length_counts.histogram(empty, PATH, PATTERN)).count() == 0


def test_histogram_passes_over_clashing_columns(edge, clashing):
    def rows(df):
        return sorted(tuple(r) for r in length_counts.histogram(df, PATH, PATTERN).collect())

    assert rows(clashing) == rows(edge) and rows(edge)
