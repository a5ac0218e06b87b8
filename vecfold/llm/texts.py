"""What the corpus operators share: words, splits by document id, packed answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a maximal run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def id_remainder(divisor: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % divisor


def whole(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def lower_words(text: str) -> list[bytes]:
    """Words with A-Z lower-cased, as UTF-8; bytes split and lower exactly the ASCII characters."""
    return text.encode().lower().split()
