"""Keyword selection from text, from tagged words and from a model's reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import strip, words

# The Vietnamese stop words, in their published order.
VIETNAMESE = [
    "và", "là", "của", "thì", "mà", "rằng", "rồi", "đã", "đang", "sẽ", "khi", "để", "cho", "từ", "cũng", "như",
    "các", "có", "không", "được", "trong", "ra", "vào", "lên", "xuống", "trên", "dưới", "trước", "sau", "đây",
    "đó", "ấy", "này", "kia", "khác", "những", "nhiều", "ít", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy",
    "tám", "chín", "mười", "ông", "bà", "anh", "chị", "em", "tôi", "chúng ta", "chúng tôi", "bạn", "họ",
    "mình", "mọi", "mỗi", "điều", "việc", "thứ", "lần", "theo", "tại", "đến", "vì", "nên", "nếu", "thế",
    "vậy", "ơi", "à", "ừ", "dạ", "vâng", "ạ", "đi", "chứ", "nhỉ", "nhá", "nhé", "quá", "rất", "thật", "còn",
    "nhưng", "tuy", "song", "hễ", "hầu", "bao", "gồm", "gì", "ai", "đâu", "nào", "sao", "bao nhiêu", "bấy nhiêu",
    "bởi", "do", "qua", "hay", "hoặc", "trở", "chỉ", "vẫn", "cứ", "luôn", "thường", "bao giờ", "lúc", "ngày",
    "tháng", "năm", "giờ", "phút", "giây", "đầu", "cuối", "về", "với", "đối với", "hướng", "cùng", "riêng",
    "chung", "hơn", "kém", "nhất", "số", "lượng", "thành", "phần", "toàn", "bộ", "tất cả", "hết", "vài",
    "ngày xửa ngày xưa", "ngày nảy ngày nay", "biết bao", "biết mấy", "ôi chao", "than ôi",
]
NOUN_TAGS = ["N", "Np", "Nc", "Nu"]
REPLY_HEADER = "Từ khóa:"

STOP_WORDS: dict[str, list[str]] = {"vi": VIETNAMESE}


def stop_words(lang: str = "vi", extra: dict[str, list[str]] | None = None) -> list[str]:
    """Stop words of a language; callers add lists of their own through ``extra``."""
    return {**STOP_WORDS, **(extra or {})}.get(lang, [])


def keywords(col: Column, min_len: int = 3, limit: int = 10, stop: list[str] | None = None) -> Column:
    """Distinct lower-cased words longer than ``min_len`` that are no stop words, in order of first appearance."""
    banned = VIETNAMESE if stop is None else stop
    kept = F.filter(
        words(F.lower(col)),
        lambda w: (F.length(w) > min_len) & (~w.isin(banned) if banned else F.lit(True)),
    )
    return F.slice(F.array_distinct(kept), 1, limit)


def select_tagged(tagged: Column, limit: int = 20, min_len: int = 2, stop: list[str] | None = None) -> Column:
    """Nouns out of an array of (word, tag) structs."""
    banned = VIETNAMESE if stop is None else stop
    nouns = F.filter(tagged, lambda t: t["tag"].isin(NOUN_TAGS))
    lowered = F.transform(nouns, lambda t: F.lower(t["word"]))
    kept = F.filter(lowered, lambda w: (F.length(w) > min_len) & (~w.isin(banned) if banned else F.lit(True)))
    return F.slice(F.array_distinct(kept), 1, limit)


def parse_keyword_lines(col: Column) -> Column:
    lines = F.transform(F.split(col, "\n"), strip)
    return F.filter(lines, lambda s: (s != "") & (s != REPLY_HEADER))
