"""Order MinHash fingerprints of documents, with column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import Ranges, let, shuffle_partitions

POSITION_BITS = 27
POSITION = (1 << POSITION_BITS) - 1
ORDER_BITS = 36
ORDER = (1 << ORDER_BITS) - 1
BIN_BITS = 5
BINS = 1 << BIN_BITS
WIDTH = 8
NONE = "-" * WIDTH


def _high(x: Column) -> Column:
    return F.shiftright(x, POSITION_BITS)


def _packed(order: Column, position: Column) -> Column:
    """Order value above, place in the text below: sorting such longs sorts by order value."""
    return F.shiftleft(order.bitwiseAND(F.lit(ORDER)), POSITION_BITS).bitwiseOR(position.cast("long"))


def _run_starts(sorted_values: Column, key) -> Column:
    places = F.sequence(F.lit(0), F.size(sorted_values) - 1)
    return F.filter(
        places, lambda j: (j == 0) | (key(F.get(sorted_values, j)) != key(F.get(sorted_values, F.greatest(j - 1, F.lit(0)))))
    )


def _kmers(text: Column, k: int) -> Column:
    """Hashes of the text's k-mers of words in text order; a text with fewer than k words is one k-mer."""
    words = F.transform(F.split(text, r"\s+"), lambda w: F.xxhash64(w))

    def joined(h):
        many = F.greatest(F.lit(1), F.size(h) - (k - 1))
        return F.transform(
            F.slice(h, F.lit(1), many),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]).bitwiseAND(F.lit(ORDER)),
        )

    return let(words, joined)


def _numbered(kmers: Column) -> Column:
    """Order values of the k-mers, each numbered among its equals in the text, with their places.

    The first of its equals has the k-mer's hash as order value, the n-th the hash of that and n.  Most texts hold no
    k-mer twice and need no numbers.
    """

    def run_numbers(s):
        def of(starts):
            lengths = F.transform(starts, lambda st, i: F.coalesce(F.get(starts, i + 1), F.size(s)) - st)
            numbers = F.flatten(F.transform(lengths, lambda n: F.sequence(F.lit(1), n)))
            return F.zip_with(
                s,
                numbers,
                lambda x, n: F.when(n == 1, x).otherwise(_packed(F.xxhash64(_high(x), n), x.bitwiseAND(F.lit(POSITION)))),
            )

        return let(_run_starts(s, _high), of)

    def of(h):
        placed = F.transform(h, lambda x, i: _packed(x, i))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), placed).otherwise(let(F.sort_array(placed), run_numbers))

    return let(kmers, of)


def order_minhash(text: Column, k: int = 5, ell: int = 2, depth: int = 4) -> Column:
    """Fingerprint of a text: an array of 32 hexadecimal words of 8 digits.

    The text's words (split at white space) form k-mers, each numbered among its equals.  One hash orders them; the
    `32 * ell * depth` minimal ones are dealt to 32 bins by that hash.  In each bin the `ell` minimal ones are put back
    in text order and hashed as a tuple.  A change of the order of words therefore changes the fingerprint, unlike with
    plain MinHash.  Texts with fewer than k words have one k-mer, the whole text; a bin without k-mers has '--------'.
    Null counts as the empty text.
    """

    def of_bins(b):
        def entry(st):
            def chosen(j):
                x = F.get(b, st + j)
                return F.when(F.shiftright(x, 63 - BIN_BITS) == F.shiftright(F.get(b, st), 63 - BIN_BITS), x)

            in_order = F.array_sort(
                F.transform(
                    F.filter(F.array(*[chosen(j) for j in range(ell)]), lambda x: x.isNotNull()),
                    lambda x: F.struct(x.bitwiseAND(F.lit(POSITION)).alias("at"), _high(x).alias("id")),
                )
            )
            digest = F.aggregate(in_order, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x["id"]))
            return F.struct(
                F.shiftright(F.get(b, st), 63 - BIN_BITS).cast("int").alias("bin"),
                F.lpad(F.lower(F.hex(digest.bitwiseAND(F.lit(0xFFFFFFFF)))), WIDTH, "0").alias("word"),
            )

        starts = _run_starts(b, lambda x: F.shiftright(x, 63 - BIN_BITS))
        return let(
            F.map_from_entries(F.transform(starts, entry)),
            lambda m: F.transform(
                F.sequence(F.lit(0), F.lit(BINS - 1)), lambda c: F.coalesce(F.element_at(m, c), F.lit(NONE))
            ),
        )

    smallest = F.slice(F.sort_array(_numbered(_kmers(F.coalesce(text, F.lit("")), k))), 1, BINS * ell * depth)
    low = F.lit((1 << (63 - BIN_BITS)) - 1)
    # The bin is the low end of the order value; it moves to the top, the rest keeps its order below.
    binned = F.transform(
        smallest,
        lambda x: F.shiftleft(_high(x).bitwiseAND(F.lit(BINS - 1)), 63 - BIN_BITS).bitwiseOR(
            F.shiftleft(F.shiftright(x, POSITION_BITS + BIN_BITS), POSITION_BITS)
            .bitwiseOR(x.bitwiseAND(F.lit(POSITION)))
            .bitwiseAND(low)
        ),
    )
    return let(F.sort_array(binned), of_bins)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal words of two fingerprints among the bins that either fills; one bin at least is filled."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == NONE) & (y == NONE), None).otherwise((x == y).cast("int")))
    return let(F.array_compact(pairs), lambda p: F.size(F.array_remove(p, 0)).cast("double") / F.size(p))


def with_next(df: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """Each row with the carried columns of the next one in descending id order as struct `following`; the last gets the first.

    Rows are dealt to ranges of the id and sorted inside them; the top row of a range also visits the range above as its
    last row, so no range needs another.  Rows with equal ids follow each other by the carried columns, null ids come last.
    """
    spark = df.sparkSession
    ranges = Ranges(df, id_col, 8 * shuffle_partitions(spark))
    total = max(1, len(ranges.bounds))
    own = df.withColumn("_range", ranges.number(F.col(id_col)))
    home = F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest"))
    visit = F.struct(((F.col("_range") + 1) % total).alias("range"), F.lit(1).alias("guest"))
    top = ranges.is_top(F.col(id_col), F.col("_range"))
    seats = F.when(top, F.array(home, visit)).otherwise(F.array(home))
    seated = own.withColumn("_seat", F.explode(seats)).withColumn("_in", F.col("_seat.range")).withColumn("_guest", F.col("_seat.guest"))
    order = Window.partitionBy("_in").orderBy("_guest", F.col(id_col).desc_nulls_last(), *[F.col(c) for c in carried])
    following = F.lead(F.struct(*[F.col(c) for c in carried])).over(order)
    return seated.withColumn("following", following).where("_guest = 0").drop("_range", "_seat", "_in", "_guest")


def fingerprint_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of the next document's, in
    descending id order (after the last: the first).  Null texts count as empty; other columns of the input are not read.
    """
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    printed = texts.withColumn("fingerprint", order_minhash(F.col("text"), k))
    paired = with_next(printed, "doc_id", ["text", "fingerprint"])
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = paired.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("following.text"), F.lit(1), cut)).alias("edited"),
        "fingerprint",
        F.col("following.fingerprint").alias("next_fingerprint"),
    )
    both = edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        order_minhash(F.col("edited"), k).alias("edited_fingerprint"),
        "next_fingerprint",
    )
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("fingerprint", "").alias("fingerprint"),
        F.array_join("edited_fingerprint", "").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
