"""The marker automaton and the scores made from it, against plain Python."""

import json
import random
import re

import pyarrow as pa
import pytest

from confsieve.catalog.signatures import SIGNATURES
from confsieve.functions.automaton import Markers
from confsieve.operators import fingerprint as fp


def plain_found(text, markers):
    words = {m for m in markers if len(m) <= 5 and m.isalnum()}
    tokens = " " + re.sub("[^a-z0-9]+", " ", text) + " "
    return {m for m in markers if (f" {m} " in tokens if m in words else m in text)}


def test_hits_equal_substring_searches():
    rnd = random.Random(3)
    markers = ["ab", "abc", "line vty", "a", "set system", "vdc ", "bca b", "ip", "c-a", "zone-pair"]
    index = Markers(markers)
    for _ in range(300):
        text = "".join(rnd.choice(["ab", "c", " ", "-", "a", "ip", "line vty", "set system", ".", "é"]) for _ in range(rnd.randint(0, 30)))
        assert {index.markers[i] for i in index.found(text)} == plain_found(text, markers)


def plain_scores(text, signatures):
    out = []
    for i, s in enumerate(signatures):
        tiers = {k: list(dict.fromkeys(s.get(k, []))) for k in ("strong", "weak", "exclude", "contradicts")}
        hit = {k: plain_found(text, v) for k, v in tiers.items()}
        groups = [g for g in s.get("structural", []) if g]
        whole = sum(plain_found(text, g) == set(g) for g in groups)
        earned = 3 * len(hit["strong"]) + len(hit["weak"]) + 2 * whole
        if earned and not hit["exclude"]:
            score = max(0.0, earned / (3 * len(tiers["strong"]) + len(tiers["weak"]) + 2 * len(s.get("structural", []))) - 0.2 * len(hit["contradicts"]))
            if score > 0:
                out.append((-score, i, s["vendor"]))
    return sorted(out)


def families(n):
    """A catalogue of ``n`` families of made-up words, some of them shared."""
    rnd = random.Random(n)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(2, 7)))
    return [
        {"vendor": f"v{i}", "strong": [word() for _ in range(4)], "weak": [word() for _ in range(4)], "exclude": [word() + "zz"], "contradicts": [word()], "structural": [[word(), word()]]} for i in range(n)
    ]


@pytest.mark.parametrize("signatures", [SIGNATURES, families(78), families(150)])
def test_rankings_equal_plain(signatures):
    rnd = random.Random(8)
    pool = [m for s in signatures for k in ("strong", "weak", "exclude", "contradicts") for m in s.get(k, [])] + ["and", "other", "words"]
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for _ in range(120)] + ["", None]
    got = fp.Scorer(signatures).ranking(pa.array(texts, pa.string())).to_pylist()
    for text, ranking in zip(texts, got, strict=True):
        assert [(r["rank_key"], r["ordinal"], r["vendor"]) for r in ranking] == plain_scores(text or "", signatures)


def test_catalogue_from_file_and_from_table(spark, tmp_path):
    path = tmp_path / "signatures.json"
    path.write_text(json.dumps(families(90)))
    loaded = fp.load_signatures(str(path))
    docs = spark.createDataFrame([(1, " ".join(loaded[70]["strong"])), (2, "")], "config_id long, raw_text string")
    got = {r.config_id: r.vendor for r in fp.fingerprint(docs, loaded).collect()}
    assert got[1] != "unknown" and got[2] == "unknown"
    markers = spark.createDataFrame([(0, "one", "strong", "alpha beta"), (1, "two", "weak", "gamma"), (1, "two", "exclude", "beta")], "ordinal int, vendor string, tier string, marker string")
    assert fp.catalogue(markers) == [{"vendor": "one", "strong": ["alpha beta"]}, {"vendor": "two", "exclude": ["beta"], "weak": ["gamma"]}]
    with pytest.raises(ValueError, match="at most 2"):
        fp.catalogue(markers, most=2)


def test_text_is_read_once_for_two_floors(spark):
    docs = spark.createDataFrame([(1, "line vty 0 4\nip ssh version 2")], "config_id long, raw_text string")
    scored = fp.score_vendors(docs).select(fp.vendor_at(0.08).alias("a"), fp.vendor_at(0.9).alias("b"))
    assert scored._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") <= 1
    assert tuple(scored.first()) == ("cisco_ios", "unknown")
