"""Operators and queries against plain Python on small fixtures."""

import hashlib
import re

import __spark_entry__ as entry
from confsieve.operators import similarity


def test_similar_pairs_in_blocks(spark):
    """Two openers, a line near both, and members near one another; small blocks give the same pairs, each once."""
    lines = [f"set interface eth{i} address {w}" for i in range(12) for w in ("alpha", "beta", "alpha beta")] + ["something else entirely", "x"]
    nodes = spark.createDataFrame([(k, "v" if k % 7 else "w", t, 1) for k, t in enumerate(lines)], "node long, vendor string, raw string, copies long")

    def pairs(block):
        found = similarity.similar_pairs(nodes, "vendor", "node", "raw", "copies", block).collect()
        assert len({(r.i, r.j) for r in found}) == len(found)
        return {(r.i, r.j): round(r.similarity, 9) for r in found}

    whole = pairs(1000)
    assert pairs(3) == whole and len(whole) > len(lines)
    assert all(i < j and (i % 7 == 0) == (j % 7 == 0) for i, j in whole)


def test_markup_keeps_pieces_with_unequal_tags(spark, tmp_path):
    lines = ["<a>one</b>", "<a>one</a>", "<a>x</b> <c> two </c>", "<c>y</c><a>x</b>", "plain  text", "<a>one</a> <a>x</b>"]
    spark.createDataFrame([(7, "\n".join(lines))], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.piece_no: (r.flat_md5, r.flat_length) for r in entry.queries()["prj04_flatten_markup"](spark, str(tmp_path)).collect()}
    cut = "\n".join(lines).replace("><", ">\n<").split("\n")
    flat = [re.sub(r"\s+", " ", re.sub(r"<([A-Za-z0-9_:-]+)>([^<]*)</\1>", r"\1 \2", x.strip())).strip() for x in cut]
    assert got == {i + 1: (hashlib.md5(x.encode()).hexdigest(), len(x)) for i, x in enumerate(flat)}
