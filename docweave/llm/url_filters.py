"""Verdicts on page URLs: rules for hosts and paths, then a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import let, stored

# One block is a row of eight 64-bit words; every URL sets one bit in each word of its block.
WORDS = 8
WORD_BITS = 6
KEYS_PER_BLOCK = 32
# About 15 MB at the most on every executor.  A list of more than four million URLs makes the filter denser, so that it
# passes more; the join settles those all the same.
MAX_BLOCKS = 1 << 17
SALTS = 16

TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def _after_scheme(url: Column) -> Column:
    """What follows the first '://'; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))


def host_of(url: Column) -> Column:
    """The host up to '/', '?', '#' or the end, A-Z lower-cased; empty for a null and for a URL without '://'."""
    found = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; empty for a null and for a URL without '://'."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """One text for the spellings of an address; null without a host.

    The scheme, 'www.', the ports 80 and 443, the fragment, 'index.html' or '/' at the end of the path and tracking
    parameters go; the other parameters are sorted.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+(index\.html?)?$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    asked = let(F.array_join(kept, "&"), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.when(host != "", F.concat(host, path, asked))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits the host or one it is a subdomain of; else null."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    found = None
    for verdict, on, under in longest_first:
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(under)
        entry = F.struct(F.lit(on + under).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, entry) if found is None else found.when(fits, entry)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _masks(url: Column) -> list[Column]:
    bits = F.xxhash64(url, F.lit(1))
    one = F.lit(1).cast("long")
    return [
        F.call_function("shiftleft", one, F.shiftrightunsigned(bits, WORD_BITS * i).bitwiseAND(F.lit(63)).cast("int"))
        for i in range(WORDS)
    ]


class BlockedBloom:
    """A blocked Bloom filter of distinct URLs as a table of blocks (_block, w0 .. w7), small enough to be broadcast."""

    def __init__(self, urls: DataFrame, column: str, max_blocks: int | None = None):
        self.count = max(1, min(-(-urls.count() // KEYS_PER_BLOCK), max_blocks or MAX_BLOCKS))
        words = [F.bit_or(m).alias(f"w{i}") for i, m in enumerate(_masks(F.col(column)))]
        self.blocks = urls.groupBy(self._block(F.col(column)).alias("_block")).agg(*words)

    def _block(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.count))

    def mark(self, df: DataFrame, column: str, into: str) -> DataFrame:
        """Adds whether a row's URL can be on the list; false for null."""
        joined = df.withColumn("_block", self._block(F.col(column))).join(F.broadcast(self.blocks), "_block", "left")
        hit = [F.col(f"w{i}").bitwiseAND(m) != 0 for i, m in enumerate(_masks(F.col(column)))]
        every = F.coalesce(reduce(Column.__and__, hit), F.lit(False)) & F.col(column).isNotNull()
        return joined.withColumn(into, every).select(*df.columns, into)


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every row: the verdict of its rule, else block for a listed URL.

    `listed` has one column `url`; both sides are compared in canonical form.  A blocked Bloom filter of the list, of a
    bounded size, goes to every task; rows that it stops are done there and never shuffled.  Of those that it passes the
    distinct URLs meet the list in an exact join, which drops false positives, and what it confirms goes back to the rows
    in salted parts, so that one URL on a third of all pages is spread.

    Null URLs, and those without '://', have an empty host and path, fit no rule and are never listed.  Rows with equal or
    null ids are judged one by one, and equal URLs alike.  Other columns of either table are not read.  An empty list blocks
    nothing; an empty table gives an empty result.  URLs of any length are compared whole.  Rules of one length can't both
    fit a URL unless they are equal; the first by host and path, then by the given order, counts.
    """
    known = stored(listed.select(canonical_url(F.col("url")).alias("canonical")).where("canonical is not null").distinct(), "listed-urls")
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical_url(url).alias("canonical"))
    ruled = parsed.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    marked = BlockedBloom(known, "canonical").mark(ruled, "canonical", "_possible")
    possible = marked.where("_possible")
    confirmed = possible.select("canonical").distinct().join(known, "canonical")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = confirmed.select("canonical", F.lit(True).alias("listed"), salts.alias("_salt"))
    dealt = possible.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    settled = dealt.join(salted, ["canonical", "_salt"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    columns = ["page_id", "host", "path", "_rule", "listed"]
    every = marked.where("not _possible").withColumn("listed", F.lit(False)).select(*columns).union(settled.select(*columns))
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return every.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", by_list).alias("verdict"), "listed"
    )
