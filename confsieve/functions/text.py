"""Column expressions for lines, markers, directives, tokens and character n-grams."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
BLANKS = " \t\n\r\x0b\x0c"
COMMENT_STARTS = ("!", "#")
SUBSTANTIVE_COMMENT_STARTS = ("!", "#", "//", "/*", "<!--")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"\s+", " ")


def split_lines(text: Column) -> Column:
    """Lines without their breaks; a break at the very end opens no further line."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def is_comment(line: Column, starts: tuple = COMMENT_STARTS) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | line.startswith(s)
    return out


def numbered_lines(text: Column) -> Column:
    """array<struct<line_no, raw>>: numbers count every line, blank and comment lines drop out afterwards."""
    numbered = F.transform(split_lines(text), lambda line, i: F.struct((i + 1).cast("int").alias("line_no"), strip(line).alias("raw")))
    return F.filter(numbered, lambda x: (F.length(x["raw"]) > 0) & ~is_comment(x["raw"]))


def count_lines(text: Column, comment_starts: tuple | None) -> Column:
    """Substantive lines; ``None`` counts every line."""
    lines = split_lines(text)
    if comment_starts is None:
        return F.size(lines)
    return F.size(F.filter(lines, lambda line: (F.length(strip(line)) > 0) & ~is_comment(strip(line), comment_starts)))


def token_text(lower_text: Column) -> Column:
    """Runs of [a-z0-9] kept, everything else one blank, blanks at both ends: a word test becomes a substring test."""
    return F.concat(F.lit(" "), F.regexp_replace(lower_text, "[^a-z0-9]+", " "), F.lit(" "))


def is_word_marker(marker: str) -> bool:
    """Short alphanumeric markers count only as whole tokens."""
    return len(marker) <= 5 and marker.isalnum()


def marker_present(lower_text: Column, tokens: Column, marker: str) -> Column:
    if is_word_marker(marker):
        return F.contains(tokens, F.lit(f" {marker} ")) if marker.isascii() else lower_text.rlike(_between(marker))
    return F.contains(lower_text, F.lit(marker))


def _between(marker: str) -> str:
    """A word marker with letters outside a-z, which the token text does not keep."""
    return f"(^|[^a-z0-9]){marker}([^a-z0-9]|$)"


def any_of(words: list[str]) -> str:
    """One pattern for any of the words, case ignored: a single pass where a test per word would lower the text each time."""
    return "(?i)" + "|".join(re.escape(w) for w in words)


def markers_found(lower_text: Column, tokens: Column, markers: list[str]) -> Column:
    """The markers present, as an array; one pass of a substring search per marker, no regular expression."""
    words = sorted({m for m in markers if is_word_marker(m) and m.isascii()})
    others = sorted({m for m in markers if is_word_marker(m) and not m.isascii()})
    parts = sorted({m for m in markers if not is_word_marker(m)})
    empty = F.array().cast("array<string>")
    by_word = F.filter(F.lit(words), lambda m: F.contains(tokens, F.concat(F.lit(" "), m, F.lit(" ")))) if words else empty
    by_part = F.filter(F.lit(parts), lambda m: F.contains(lower_text, m)) if parts else empty
    by_pattern = F.array_compact(F.array(*[F.when(lower_text.rlike(_between(m)), F.lit(m)) for m in others])) if others else empty
    return F.concat(by_word, by_part, by_pattern)


# The shape of one markup pair, and of lines that carry no setting.
MARKUP_PAIR = r"<([A-Za-z0-9_:-]+)>([^<]*)</([A-Za-z0-9_:-]+)>"
SCAFFOLDING = (
    r"(?i)^(?:</?[A-Za-z0-9_:-]+/?>"
    r"|(?:end|next|exit|return|commit|quit|abort|save\s+config|top|root)"
    r"|(?:config|edit|config\s+\w[\w\s-]*)"
    r"|[{}\[\]()!#;,.\-*=/\\|'\"\s]+"
    r"|\w+\(config[^)]*\)#?)$"
)
STOP_TOKENS = ["set", "the", "and", "for", "config", "configure", "edit"]
TOKEN_EDGES = "\"'<>=,;()[]{}"


def flatten_markup(text: Column) -> Column:
    """``<k>v</k>`` becomes ``k v``; blanks collapse. Either pattern is tried only where the text holds what it cannot match without."""
    marked = F.contains(text, F.lit("</"))
    loose = marked | F.contains(text, F.lit("  "))
    for blank in BLANKS[1:]:
        loose = loose | F.contains(text, F.lit(blank))
    return F.when(loose, collapse_blanks(F.when(marked, F.regexp_replace(strip(text), r"<([A-Za-z0-9_:-]+)>([^<]*)</\1>", "$1 $2")).otherwise(text))).otherwise(strip(text))


def is_reviewable(text: Column) -> Column:
    """Worth a verdict: three characters, an alphanumeric, and more than scaffolding."""
    t = strip(text)
    return (F.length(t) >= 3) & ~t.rlike(SCAFFOLDING) & t.rlike(r"[\p{L}\p{N}]")


def resolution_key(filename: Column, command: Column) -> Column:
    return F.concat(filename, F.lit("::"), F.lower(collapse_blanks(command)))


def first_of_keys(ordered: str) -> Column:
    """array<struct<entry, first>> of a column of entries in order of ``key``: ``first`` where the entry before has another key."""
    return F.transform(ordered, lambda x, i: F.struct(x.alias("entry"), ((i == 0) | (F.get(F.col(ordered), i - 1)["key"] != x["key"])).alias("first")))


def directive_tokens(text: Column) -> Column:
    """Distinct tokens of a directive, longer than two characters, edge punctuation and stop words removed."""
    parts = F.split(F.lower(flatten_markup(text)), r"[\s=]+", -1)
    kept = F.filter(parts, lambda t: F.length(t) > 2)
    return F.array_except(F.array_distinct(F.transform(kept, lambda t: F.btrim(t, F.lit(TOKEN_EDGES)))), F.lit(STOP_TOKENS))


def char_grams(text: Column) -> Column:
    """Character 2- to 4-grams inside word bounds, one blank padded on each side of a word; repeats kept."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+", -1), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_size(w: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(w) - (n - 1))
        cut = F.transform(starts, lambda i: F.call_function("substring", w, i, F.lit(n)))
        return F.when(F.length(w) >= n, cut).otherwise(F.array().cast("array<string>"))

    def grams_of(w: Column) -> Column:
        return F.concat(*[of_size(w, n) for n in (2, 3, 4)])

    return F.flatten(F.transform(padded, grams_of))
