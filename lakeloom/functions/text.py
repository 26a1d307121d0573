"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a maximal run of letters and digits of any script.
TOKEN = r"[\p{L}\p{N}]+"


def html_to_text(html: Column) -> Column:
    """``html`` with scripts, styles and then all tags replaced by a space; entities stay."""
    bare = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.regexp_replace(bare, r"<[^>]*>", " ")


def tokens(text: Column) -> Column:
    """Lower-cased tokens of ``text`` in order; null for null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
