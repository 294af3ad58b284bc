"""Text column expressions (JVM-side regular expressions, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's ``str.strip`` understands it: ASCII controls
# tab..CR, the file/group/record/unit separators, NEL and every Unicode
# separator (Zs, Zl, Zp).  Spelled out instead of ``\s`` because ``\s``
# differs between regex engines (vertical tab).
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
STRIP_PATTERN = rf"^{WS_CLASS}+|{WS_CLASS}+$"
# A token is a run of letters/digits/underscore, or one other visible char.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}\p{L}\p{N}_]"


def strip_text(c: Column) -> Column:
    """Unicode-aware strip of leading and trailing whitespace."""
    return F.regexp_replace(c, STRIP_PATTERN, "")


def tokenize(c: Column) -> Column:
    """Word and punctuation tokens as ``ARRAY<STRING>`` (whole text)."""
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)
