"""Text normalisation used before names are compared."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters and letter-like signs; their compatibility decompositions fold them.
RANGES = ((0xAA, 0x250), (0x1D00, 0x1F00), (0x2070, 0x20A0), (0x2100, 0x2190), (0x2460, 0x2500),
          (0xFB00, 0xFB07), (0xFF10, 0xFF5B))
MARKS = "".join(map(chr, range(0x300, 0x370)))


@functools.cache
def _tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters that become one ASCII character, that character, and longer replacements."""
    single, plain, longer = [], [], []
    for code in (c for low, high in RANGES for c in range(low, high)):
        parts = unicodedata.normalize("NFKD", chr(code).lower())
        kept = "".join(c for c in parts if not unicodedata.combining(c)).lower()
        if not kept.isascii() or not kept or kept == chr(code):
            continue
        if len(kept) == 1:
            single.append(chr(code))
            plain.append(kept)
        elif kept.isalnum():
            longer.append((chr(code), kept))
    return "".join(single), "".join(plain), tuple(longer)


def fold(value: Column) -> Column:
    """Lower-case text decomposed by compatibility, without accents.

    Combining marks go; ligatures and the like become their letters.
    """
    single, plain, longer = _tables()
    wide = F.array(*[F.lit(a) for a, _ in longer])
    narrow = F.array(*[F.lit(b) for _, b in longer])
    low = F.lower(value)
    # Few texts hold a sign of several letters: only those are walked letter by letter.
    signs = "[" + "".join(a for a, _ in longer) + "]"
    letters = F.transform(F.split(low, ""), lambda c: F.coalesce(
        F.get(narrow, (F.array_position(wide, c) - 1).cast("int")), c))
    spread = F.when(low.rlike(signs), F.array_join(letters, "")).otherwise(low)
    return F.translate(spread, single + MARKS, plain)


def match_key(value: Column) -> Column:
    """Folded text keeping only ASCII letters and digits."""
    return F.regexp_replace(fold(value), "[^a-z0-9]", "")
