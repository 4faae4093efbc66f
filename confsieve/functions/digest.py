"""SHA-256 and HMAC-SHA-256 from built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "|"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical(*fields: Column) -> Column:
    """Fields in a fixed order with null as the empty string; the form every digest here is taken over."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


def hmac_sha256(key: str, text: Column) -> Column:
    """HMAC as two nested digests over the padded key. The key is a parameter of the caller, never a constant here."""
    raw = key.encode("utf-8")
    if len(raw) > 64:  # a longer key stands for itself by its digest, as the definition has it
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in raw).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in raw).hex()))
    first = F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)
