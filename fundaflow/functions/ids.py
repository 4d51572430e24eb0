"""Content-derived identifiers.

The hashed text is `name=value|name=value`: numbers as fixed-point text, dates as ISO
text, instants as epoch seconds, NULL spelled out, separators in text escaped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TEXT = "~"


def _text(c: Column, kind: str) -> Column:
    if kind == "num":
        # six decimals where they are the whole double; otherwise the double's own text follows, which no other double has
        fixed = c.try_cast("decimal(38,6)")
        out = F.when(fixed.isNull(), c.cast("string")).when(fixed.cast("double") == c, fixed.cast("string")).otherwise(
            F.concat(fixed.cast("string"), F.lit("~"), c.cast("string")))
    elif kind == "time":
        out = F.unix_seconds(c.cast("timestamp")).cast("string")
    elif kind == "str":
        out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(NULL_TEXT))


def canonical_text(**parts: tuple[Column, str] | Column) -> Column:
    """Canonical text of named values; a bare column counts as text."""
    pieces = []
    for name, part in parts.items():
        col, kind = part if isinstance(part, tuple) else (part, "str")
        pieces.append(F.concat(F.lit(f"{name}="), _text(col, kind)))
    return F.concat_ws("|", *pieces)


def content_hash(**parts: tuple[Column, str] | Column) -> Column:
    return F.sha2(canonical_text(**parts), 256)


LANES = 4


def hash_lanes(digest: Column) -> list[Column]:
    """A hex digest of 256 bits as four signed 64-bit numbers."""
    return [F.conv(F.substring(digest, 1 + 16 * k, 16), 16, -10).cast("long") for k in range(LANES)]


def set_digest(digest: Column) -> Column:
    """Aggregate: an order-free text over all 256 bits of the hashes of a set, which combines on the map side.

    Sum and xor of each lane; equal sets give equal texts, and nothing of a hash is left out.
    """
    parts = []
    for lane in hash_lanes(digest):
        total = F.coalesce(F.sum(lane.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        parts += [total.cast("string"), F.coalesce(F.bit_xor(lane), F.lit(0).cast("long")).cast("string")]
    return F.concat_ws(":", F.count(digest).cast("string"), *parts)


def stable_id(prefix: str, **parts: tuple[Column, str] | Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), content_hash(**parts))


def short_id(prefix: str, digits: int, **parts: tuple[Column, str] | Column) -> Column:
    """Identifier cut to a number of hex digits, names in sorted order."""
    ordered = {k: parts[k] for k in sorted(parts)}
    return F.concat(F.lit(prefix), F.left(content_hash(**ordered), F.lit(digits)))
