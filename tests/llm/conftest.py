import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField(n, t) for n, t in [("doc_id", LongType()), ("text", StringType()), ("lang", StringType()), ("source", StringType()), ("n_chars", LongType())]])
#: Names the operators give to their results or use inside, here as columns of the input.
CLASHING = ["n_lines", "n_dropped", "score", "predicted", "held_out", "lang_pred", "ids", "decoded", "n_tokens", "size", "target", "copies", "rate", "fp", "component_id", "key", "bit", "fingerprint", "log_prob", "words", "gone", "doc", "src", "rank", "n", "from", "times", "copy", "keep_doc", "keep_text", "keep_rows", "keep_rank", "row", "lines", "rare", "shares", "host", "hash", "bundle", "own_score", "text_hash", "__drop", "__doc", "__fp", "__rank", "__copies", "__n", "__size", "__src", "__times", "__rare"]
LONG = "A long line that five documents share, word for word."


def edge_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, letters of several alphabets."""
    rows = [(i, f"Own words of {i}\n{LONG}\n  {LONG.upper()} ", "en", f"s{i % 3}", None) for i in range(1, 7)]
    rows += [(7, None, "en", "s1", 0), (8, "", None, "s2", 0), (9, " \t\n\r\x0b\x0c ", "de", None, 7), (None, f"no id\n{LONG}", "en", "s0", 3), (10, "one", None, None, None), (11, "one two", "fr", "s0", 7)]
    rows += [(12, "twin text with enough words to be a text of its own", "fr", "s1", 1)] * 3
    rows += [(13, "twin text with enough words to be a text of its own", "fr", "s1", 1), (14, "日本語のテキスト です。 ümläut É\U0001f600", "ja", "sé", 1)]
    rows += [(15, "many words in a very long text " * 20_000, "en", "s0", 1), (16, "x" * 300_000, "en", "s0", 1), (17, "1234 5678 !!", "en", "s2", 1)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(spark, edge):
    from pyspark.sql import functions as F

    return edge.withColumns({name: F.lit("mine") for name in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
