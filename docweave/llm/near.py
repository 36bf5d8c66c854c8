"""Near-duplicate documents: an inverted join over MinHash coordinates, confirmed on whole shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import release_shuffles
from docweave.llm.components import components
from docweave.session import checkpointed

# Documents meet under the first coordinates; pairs are then told apart by all of them.
POSTED = 70
COORDINATES = 140
# Seven coordinates' low bytes fill a long without its top byte, so sums of them can't overflow.
PER_LONG = 7
# Of 70 coordinates of two documents with Jaccard 0.8, 56 agree on average, of 140 there are 112; fewer than 38, or than
# 87, agree about once in a million.
MATCHES = 38
ALIKE = 87
PACKED = [f"p{i}" for i in range(COORDINATES // PER_LONG)]
# Parities of how many shingles fall in each slot.  Slots of unlike parity are never more than the shingles that only one
# of two sets has, so they bound the similarity from above, closely for sets up to about twice as large.
PARITY_LONGS = 10
PARITIES = [f"o{i}" for i in range(PARITY_LONGS)]
SKETCH = PACKED + PARITIES
HUB_ROUNDS = 2
BLOCK_DOCUMENTS = 256
# Entries of a list on one side of a tile, and pairs of entries that a task compares at once.
LIST_BLOCK = 1024
PAIRS_AT_ONCE = 1 << 16
LONG_WORD = 1024
SEGMENT = 1 << 14
SETS = "doc_id long, n_shingles long, set_key binary, keys array<long>, packed array<long>"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return _mix(np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class RegionHash:
    """64-bit hashes of many regions of one byte string at once, alike wherever a region stands.

    A region's hash is the sum of a number for each byte times a power of an odd base, from prefix sums; the power of
    the region's start is divided out.
    """

    BASE = 0x9E3779B97F4A7C55

    def __init__(self):
        self.letters = _stream(7, 256)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int):
        if n > len(self.powers):
            size = 1 << (n - 1).bit_length()
            inverse = pow(self.BASE, -1, 1 << 64)
            for name, base in (("powers", self.BASE), ("inverses", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def __call__(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        codes = self.letters[np.frombuffer(data, np.uint8)] * self.powers[: len(data)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes)])
        return _mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; one beyond 1,024 bytes stands as its digest."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if any(len(w) > LONG_WORD for w in found):
        found = [w if len(w) <= LONG_WORD else b"\0" + hashlib.blake2b(w).digest() for w in found]
    return found


def shingle_hashes(found: list[bytes], k: int, region: RegionHash) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words are one shingle, no words none."""
    if not found:
        return np.zeros(0, np.uint64)
    k = min(k, len(found))
    parts = []
    for at in range(0, len(found) - k + 1, SEGMENT):
        own = found[at : at + SEGMENT + k - 1]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) + 1
        ends = np.cumsum(sizes) - 1
        starts = ends - sizes + 1
        many = len(own) - k + 1
        parts.append(np.unique(region(b" ".join(own), starts[:many], ends[k - 1 :])))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


class Coordinates:
    """The MinHash coordinates of a set: for each of the hash functions the upper half of the least value."""

    def __init__(self, count: int = COORDINATES):
        self.factors, self.offsets = _stream(101, count) | np.uint64(1), _stream(202, count)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 2048):
            values = hashes[at : at + 2048, None] * self.factors + self.offsets
            least = np.minimum(least, values.min(axis=0))
        return (least >> np.uint64(32)).astype(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each slot whether an odd number of the hashes falls in it, packed in longs."""
    slots = PARITY_LONGS * 64
    odd = np.bincount((hashes % np.uint64(slots)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch(documents: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, keys, packed): each document's set by its digest, its coordinates and parities."""

    def run(batches):
        region, coordinates = RegionHash(), Coordinates()
        shifts = np.arange(PER_LONG) * 8
        for batch in batches:
            counts, digests, keys, packed = [], [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(words(text.as_py()), k, region)
                values = coordinates(hashes)
                counts.append(len(hashes))
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                keys.append((np.arange(POSTED) << 32) | values[:POSTED])
                low = ((values & 255).reshape(-1, PER_LONG) << shifts).sum(axis=1)
                packed.append(np.concatenate([low, parities(hashes)]))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary())]
            for x in (keys, packed):
                flat = np.concatenate(x) if x else np.zeros(0, np.int64)
                width = len(x[0]) if x else 0
                columns.append(pa.ListArray.from_arrays(np.arange(len(x) + 1) * width, pa.array(flat, pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "keys", "packed"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SETS)


def matching(a: str, b: str) -> Column:
    """Number of coordinates of two aliases' rows whose low bytes agree: bytes that are zero in the exclusive or."""
    low = F.lit(0x7F7F7F7F7F7F7F)
    equal = F.lit(PER_LONG * 8 * len(PACKED))
    for p in PACKED:
        x = F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))
        equal = equal - F.bit_count((x.bitwiseAND(low) + low).bitwiseOR(x).bitwiseOR(low))
    return equal


def unlike(a: str, b: str) -> Column:
    """Number of slots whose parities differ between two aliases' rows."""
    return sum((F.bit_count(F.col(f"{a}.{o}").bitwiseXOR(F.col(f"{b}.{o}"))) for o in PARITIES), F.lit(0))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def confirmed_in_tiles(pairs: DataFrame, sets: DataFrame, blocks: int, percent: int) -> DataFrame:
    """As ``confirmed``, for many pairs among few documents: ids are dealt to blocks, and a pair is settled in the tile of
    its two blocks.  A set goes once to each tile that needs it, not once to each pair.  A task reads its tiles as a
    stream, so that tiles of few pairs cost no call each."""

    def tile(column):
        return F.pmod(F.xxhash64(column, F.lit(9)), F.lit(blocks)).cast("int")

    dealt = checkpointed(pairs.select("a", "b", tile("a").alias("x"), tile("b").alias("y")))
    asked = dealt.select("x", "y", "a", "b", F.lit(None).cast("binary").alias("hashes"))
    needed = dealt.select("x", "y", F.explode(F.array("a", "b")).alias("a")).distinct()
    held = needed.join(sets.withColumnRenamed("doc_id", "a"), "a").select("x", "y", "a", F.lit(None).cast("long").alias("b"), "hashes")
    # Rows without a second id come first, so a tile's sets are there before its pairs.
    sent = held.union(asked).repartition("x", "y").sortWithinPartitions("x", "y", "b")

    def settle(batches):
        found, tile = {}, None
        for batch in batches:
            pairs, keep = {"a": [], "b": []}, []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for x, y, a, b, h in zip(*columns, batch.column(4), strict=True):
                if (x, y) != tile:
                    found, tile = {}, (x, y)
                if b is None:
                    found[a] = np.frombuffer(h.as_py(), np.uint64)
                    continue
                m, n = len(found[a]), len(found[b])
                both = len(np.intersect1d(found[a], found[b], assume_unique=True))
                keep.append(100 * both >= percent * (m + n - both))
                pairs["a"].append(a)
                pairs["b"].append(b)
            made = pa.RecordBatch.from_pydict(pairs, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
            yield made.filter(pa.array(keep, pa.bool_()))

    return sent.mapInArrow(settle, "a long, b long")


def _partners(tile: np.ndarray, role: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to): the rows that each row meets, of rows sorted by tile and role: on the diagonal the later ones of its tile,
    elsewhere those of the other role."""
    at = np.arange(len(tile))
    ends = np.searchsorted(tile, tile, side="right")
    other = np.searchsorted(2 * tile + role, 2 * tile + 1)
    return np.where(diagonal, at + 1, np.where(role == 0, other, ends)), ends


def pairs_in_lists(listed: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: pairs of documents that share a list, are of different components and so alike that they must be
    confirmed; each under the first list that they share.

    ``listed`` holds a row (key, size, rep, label, n, earlier, *SKETCH) for each document of a list with so many; earlier has
    the keys of its lists before this one.  A list is cut into blocks of about 1,024 documents, and pairs of blocks are spread over tasks.  A
    task reads its tiles as a stream and compares some of their pairs at a time, by the parities before the coordinates.
    """
    block = F.pmod(F.xxhash64("rep", F.lit(11)), F.col("blocks")).cast("int")

    def places(block: Column, other: Column, role: Column) -> Column:
        """Lower and upper block of a tile; on the lower side the role is 0."""
        return F.struct(F.least(block, other).alias("ti"), F.greatest(block, other).alias("tj"), role.cast("int").alias("role"))

    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: places(F.col("block"), other, other < F.col("block")))
    held = ["rep", "label", "n", *SKETCH, "earlier"]
    dealt = listed.withColumn("blocks", F.ceil(F.col("size") / LIST_BLOCK).cast("int")).withColumn("block", block).select("key", F.explode(tiles).alias("at"), *held)
    sent = dealt.select("key", "at.*", *held).repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj", "role")
    n_packed = len(PACKED)

    def found(rows: pa.RecordBatch, tile: np.ndarray):
        key, ti, tj, role, rep, label, n = (rows.column(i).to_numpy() for i in range(7))
        sketches = np.stack([rows.column(7 + i).to_numpy() for i in range(len(SKETCH))], axis=1).view(np.uint64)
        packed, odd = sketches[:, :n_packed], sketches[:, n_packed:]
        earlier, sets = rows.column(7 + len(SKETCH)), {}

        def first(i: int, j: int) -> bool:
            for at in (i, j):
                if at not in sets:
                    sets[at] = frozenset(earlier[at].as_py())
            return sets[i].isdisjoint(sets[j])

        start, stop = _partners(tile, role, ti == tj)
        many = stop - start
        upto = np.concatenate([[0], np.cumsum(many)])
        for low in range(0, int(upto[-1]), PAIRS_AT_ONCE):
            number = np.arange(low, min(low + PAIRS_AT_ONCE, upto[-1]))
            i = np.searchsorted(upto, number, side="right") - 1
            j = start[i] + number - upto[i]
            x, y = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            keep = (label[i] != label[j]) & (x * 100 >= y * percent)
            i, j = i[keep], j[keep]
            differ = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64)
            keep = differ * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
            i, j = i[keep], j[keep]
            same = (packed[i].view(np.uint8) == packed[j].view(np.uint8)).sum(axis=1, dtype=np.int64) - n_packed
            keep = same >= ALIKE
            pairs = [pair for pair in zip(i[keep].tolist(), j[keep].tolist(), strict=True) if first(*pair)]
            if pairs:
                i, j = np.array(pairs, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(f(rep[i], rep[j])) for f in (np.minimum, np.maximum)], ["a", "b"])

    def compare(batches):
        rest = []
        for batch in filter(len, batches):
            whole = pa.Table.from_batches([*rest, batch]).combine_chunks().to_batches()[0]
            change = np.zeros(len(whole), bool)
            for i in range(3):
                column = whole.column(i).to_numpy()
                change[1:] |= column[1:] != column[:-1]
            # The last tile may go on in the next batch.
            cut = int(np.flatnonzero(change)[-1]) if change.any() else 0
            if cut:
                yield from found(whole.slice(0, cut), np.cumsum(change[:cut]))
            rest = [whole.slice(cut)]
        if rest:
            yield from found(rest[0], np.zeros(len(rest[0]), np.int64))

    return sent.mapInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Documents are linked if their sets of k-word shingles have a Jaccard similarity of percent / 100 or more; a component
    is named by its smallest doc_id, which alone is kept.  Equal sets are joined first by digest.  Of each other set,
    70 MinHash coordinates are posted; links have 38 in common, so a set without 38 that another has as well is left out,
    and of the rest, rarest first, all but 37 are posted (one of them must be shared).  In rounds every set is confirmed
    against the most alike of the hubs of its lists.  Lists whose sets are then all in one component are passed over; in
    the others sets of different components meet, each pair under its first shared coordinate, if 87 of 140 coordinates
    agree.  So copies of one text don't meet in all pairs.
    Null, empty and blank texts have no set and no links; a null doc_id neither, and no component.  Rows with one doc_id
    count as one document.  Other columns are not read.
    """
    spark = documents.sparkSession
    sketches = checkpointed(sketch(documents, k))
    linked = sketches.where("n_shingles > 0 and doc_id is not null")
    reps = linked.groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("packed").alias("packed")
    )
    reps = checkpointed(reps)
    release_shuffles(spark)

    posted = reps.select("rep", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    lists = posted.join(shared, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("keys"))
    prefix = F.transform(F.slice("keys", F.lit(1), F.size("keys") - (MATCHES - 1)), lambda x: x["key"])
    typical = F.aggregate("keys", F.lit(0).cast("long"), lambda total, x: total + x["c"])
    able = lists.where(F.size("keys") >= MATCHES).select("rep", prefix.alias("prefix"), typical.alias("typical"))
    able = checkpointed(able.join(reps.select("rep", "n", *[F.get("packed", F.lit(i)).alias(p) for i, p in enumerate(SKETCH)]), "rep").dropDuplicates(["rep"]))
    release_shuffles(spark)

    def hash_texts(batches):
        region = RegionHash()
        for batch in batches:
            sets = [shingle_hashes(words(t.as_py()), k, region).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "hashes"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    needed = texts.join(able.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = checkpointed(needed.mapInArrow(hash_texts, "doc_id long, hashes binary"))

    def alike(a: str, b: str) -> Column:
        sizes = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent
        # Jaccard >= percent / 100 if the shingles in one set alone are few: (100 - percent) / (100 + percent) of both sizes.
        few = unlike(a, b) * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)
        return sizes & few & (matching(a, b) >= ALIKE)

    def open_lists(found, *carried):
        """Entries of the lists whose documents aren't all in one component, with their labels and the size of the list."""
        known = able if found is None else able.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        label = F.col("rep") if found is None else F.coalesce("component", "rep")
        known = known.withColumn("label", label)
        thin = known.select("label", F.explode("prefix").alias("key"))
        several = thin.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size"))
        several = several.where("x <> y").select("key", "size")
        entries = known.select("rep", "label", F.posexplode("prefix").alias("at", "key")).join(several, "key")
        return entries.join(able.select("rep", "n", *SKETCH, *carried), "rep")

    links, found = None, None
    for turn in range(HUB_ROUNDS):
        # The first hub of a list is its most typical document, the next ones are any.
        order = -F.col("typical") if turn == 0 else F.xxhash64("rep", "key", F.lit(turn))
        entries = open_lists(found, "typical")
        hub = F.min(F.struct(order.alias("o"), "rep", "label", "n", *SKETCH)).alias("hub")
        hubs = entries.groupBy("key").agg(hub).select("key", "hub.*")
        met = entries.alias("e").join(hubs.alias("h"), "key").where((F.col("e.label") != F.col("h.label")) & alike("e", "h"))
        likest = F.max(F.struct(matching("e", "h").alias("m"), (-F.col("h.rep")).alias("o")))
        best = met.groupBy(F.col("e.rep").alias("a")).agg(likest.alias("best")).select("a", (-F.col("best.o")).alias("b"))
        new = checkpointed(confirmed(best, sets, percent))
        if turn and new.isEmpty():
            break
        links = new if links is None else links.union(new)
        found = checkpointed(components(links))
        release_shuffles(spark)

    listed = open_lists(found, "prefix").withColumn("earlier", F.slice("prefix", F.lit(1), F.col("at"))).drop("prefix", "at")
    rest = pairs_in_lists(listed, percent)
    blocks = -(-able.count() // BLOCK_DOCUMENTS) or 1
    last = checkpointed(confirmed_in_tiles(rest, sets, blocks, percent))
    if not last.isEmpty():
        found = checkpointed(components(links.union(last)))
    release_shuffles(spark)

    named = reps.select("set_key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("set_key", F.coalesce("component", "rep").alias("component_id"))
    whole = sketches.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key"))
    labelled = whole.join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return labelled.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
