"""Words a pattern cannot match without."""

import random
import re

from confsieve.catalog import grammar
from confsieve.functions.needles import needles


def test_known_patterns():
    assert needles(r"^ip\s+ssh\s+version\s+(\d)") == ["version"]
    assert needles(r"stelnet\s+server|disable-ssh\s+no") == ["disable-ssh", "stelnet"]
    assert needles(r"(?:colou?r)?x") == [] and needles(r"(?:abc|d)ef") == [] and needles(r"[abc]+\d") == []
    assert needles(r"(?:abcd)+e") == ["abcd"] and needles(r"(?:abcd)*e") == [] and needles(r"foo(?=barbar)") == ["foo"]


def test_no_match_without_a_needle():
    """Whatever a pattern of the catalogue matches holds one of its words: built from the pattern's own alternatives and noise."""
    rnd = random.Random(3)
    patterns = [p for _, p, _ in grammar.GRAMMAR] + [r[0] for r in grammar.FALLBACK_GRAMMAR]
    pieces = sorted({w for p in patterns for w in re.findall(r"[A-Za-z][A-Za-z0-9-]+", p)}) + ["10.0.0.1", "any", "permit", "7", "public", "#", "=no", "/ip"]
    told = 0
    for p in patterns:
        words, compiled = needles(p), re.compile(p, re.I)
        told += bool(words)
        own = re.findall(r"[A-Za-z0-9/'=.-]+", p)
        for _ in range(60):
            line = " ".join(rnd.choice(own + pieces[:40]) for _ in range(rnd.randint(1, 7)))
            if words and compiled.search(line):
                assert any(w in line.lower() for w in words), (p, line)
    assert told > 0.9 * len(patterns)
