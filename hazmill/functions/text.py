"""Text functions as column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends as Python's splitlines sees them.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
# The patterns of dates and headings, and those inside normalize_text and split_sentences.
DATE = (
    r"\b(?:on\s+)?((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}"
    r"|\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2})\b"
)
HEADING = r"^\s*(?:[A-Z][A-Z \-/&]{4,}|\d+(?:\.\d+)*\s+[A-Z].{0,80})\s*$"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def lines(col: Column) -> Column:
    """Lines without a last empty one after a final line end."""
    parts = F.split(col, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def normalize_text(col: Column) -> Column:
    """Joins hyphenated and wrapped lines, collapses spaces and runs of blank lines."""
    out = F.regexp_replace(col, r"(?U)(\w)-\n(\w)", "$1$2")
    out = F.regexp_replace(out, r"(?U)(?<![.!?:;\n])\n(?![\n\s•\-\d])", " ")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def split_sentences(col: Column) -> Column:
    """Array of stripped sentences; a sentence ends before white space and a capital, quote or bracket."""
    return F.filter(F.transform(F.split(col, r"""(?U)(?<=[.!?])\s+(?=[A-Z("'\[])"""), strip), lambda s: s != "")


def tokenize(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit("([a-z0-9]+)"), 1)


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(r"(?U)\S+")).cast("int")


def detect_date(col: Column, window: int = 8000) -> Column:
    """The first date of the front matter, or the empty text."""
    return F.regexp_extract(F.substring(col, 1, window), DATE, 1)


def document_title(name: Column) -> Column:
    """File name without its ending, underscores as spaces."""
    return F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "_", " ")


def safe_name(col: Column, limit: int = 120) -> Column:
    """Runs of unsafe characters become one space; trimmed, cut to the limit, trimmed again."""
    return strip(F.substring(strip(F.regexp_replace(col, r"[^A-Za-z0-9 ._-]+", " ")), 1, limit))


def safe_filename(col: Column, limit: int = 200, default: str = "upload.pdf") -> Column:
    """The last part of a path with unsafe runs as underscores; the default if nothing is left."""
    base = F.regexp_extract(F.regexp_replace(F.coalesce(col, F.lit("")), r"[/\\]+$", ""), r"([^/\\]*)$", 1)
    name = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9 ._-]+", "_"), r"^[. ]+|[. ]+$", "")
    return F.substring(F.when(name == "", F.lit(default)).otherwise(name), 1, limit)
