"""Column functions for preparing text.  All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes, and the character classes built on them.
# Java's \s and \w are ASCII-only, so the classes are written out.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"

# Characters the cleaner keeps, and the heading-number lines that are dropped.
CLEAN_DROP = (
    r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\p{Z}"
    r"\.,;?!\-\(\)\[\]\{\}:\"'/@#$%^&*+=_<>`~|]"
)
MARKER = (
    r"(?iu)^[\t-\r\x1c-\x20\x{85}\p{Z}]*"
    r"(Điều|Chương|Mục|Phần|Phụ lục|Article|Section|Part|Appendix)?"
    r"[\t-\r\x1c-\x20\x{85}\p{Z}]*([0-9]+\.)+([0-9]+)?"
    r"[\t-\r\x1c-\x20\x{85}\p{Z}]*\.?[\t-\r\x1c-\x20\x{85}\p{Z}]*$"
)

# Entities replaced after the tags are gone, in this order.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def words(col: Column) -> Column:
    """Whitespace-separated words, blanks dropped."""
    return F.filter(F.split(col, WS + "+"), lambda w: w != "")


def tokens(col: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(col), F.lit("(" + WORD_TOKEN + ")"), F.lit(1))


def raw_sentences(col: Column) -> Column:
    """Cut after a full stop, exclamation or question mark that is followed by whitespace."""
    return F.split(col, "(?<=[.!?])" + WS + "+")


def clean_text(col: Column) -> Column:
    spaced = F.regexp_replace(col, WS + "+", " ")
    return strip(F.regexp_replace(spaced, CLEAN_DROP, ""))


def is_long_enough(col: Column, minimum: int = 4) -> Column:
    return F.length(strip(col)) > minimum


def is_marker(col: Column) -> Column:
    return col.rlike(MARKER)


def prepared_sentences(col: Column, min_length: int = 4, clean: bool = True) -> Column:
    """Sentence array of one text: cut, drop short ones (tested on the raw text), clean, drop heading numbers."""
    kept = F.filter(raw_sentences(col), lambda s: is_long_enough(s, min_length))
    shaped = F.transform(kept, clean_text) if clean else kept
    return F.filter(shaped, lambda s: ~is_marker(s))


def html_to_text(col: Column) -> Column:
    out = F.regexp_replace(col, "<[^>]+>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(out, WS + "+", " "))


def normalize_answer(col: Column) -> Column:
    return F.regexp_replace(strip(F.lower(col)), NOT_WORD_OR_SPACE, "")


def clean_name(col: Column) -> Column:
    """Collection name: 3 to 63 characters after cleaning, otherwise NULL."""
    out = F.regexp_replace(col, "[^a-zA-Z0-9_.-]", "")
    out = F.regexp_replace(out, r"\.{2,}", ".")
    out = F.regexp_replace(out, "^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$", "")
    return F.when(F.length(out).between(3, 63), out)


def paragraphs(col: Column) -> Column:
    return F.filter(F.transform(F.split(col, "\n"), strip), lambda p: p != "")


def content_gate(col: Column, minimum: int = 100) -> Column:
    size = F.length(strip(F.coalesce(col, F.lit(""))))
    return F.when(size == 0, "empty").when(size < minimum, "needs_ocr").otherwise("ok")


def word_count(text: Column, known: Column | None = None) -> Column:
    counted = F.coalesce(F.size(words(text)), F.lit(0)).cast("long")
    return counted if known is None else F.coalesce(known.cast("long"), counted)


def truncate(col: Column, limit: int) -> Column:
    return F.substring(col, 1, limit)


def safe_id(col: Column) -> Column:
    return F.regexp_replace(col.cast("string"), r'[/\\:*?"<>|]', "_")


def best_content(doc: Column, top: Column | None = None) -> Column:
    """Best text of a source record and the name of the field it came from, as a struct (text, source).

    ``doc`` is a struct with summary.text, full_text, text, story and context; ``top`` (optional) holds
    text, story and context for records without a usable document.
    """
    raw = doc["text"]
    looks_html = raw.contains("<") & raw.contains(">")
    cleaned = html_to_text(raw)

    def pick(text, source):
        return F.struct(text.cast("string").alias("text"), F.lit(source).alias("source"))

    nothing = F.lit(None).cast("string")
    out = (
        F.when(doc["summary"]["text"].isNotNull(), pick(doc["summary"]["text"], "summary.text"))
        .when(doc["full_text"].isNotNull(), pick(doc["full_text"], "full_text"))
        .when(raw.isNotNull() & looks_html & (F.length(cleaned) > 100), pick(cleaned, "text (cleaned HTML)"))
        .when(raw.isNotNull() & looks_html, pick(nothing, "text (HTML, too short after cleaning)"))
        .when(raw.isNotNull(), pick(raw, "text"))
        .when(doc["story"].isNotNull(), pick(doc["story"], "story"))
        .when(doc["context"].isNotNull(), pick(doc["context"], "context"))
    )
    if top is not None:
        for name in ("text", "story", "context"):
            out = out.when(top[name].isNotNull(), pick(top[name], name + " (fallback)"))
    return out.otherwise(pick(nothing, "none"))
