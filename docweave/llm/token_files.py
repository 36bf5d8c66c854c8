"""Token ids in binary shards with Elias-Fano document bounds."""

from __future__ import annotations

import hashlib
import json
import re
import string
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.bpe import KNOWN_WORDS, byte_letters, read_tokenizer, words_of
from docweave.llm.common import shuffle_partitions, worker_memory

MAGIC = b"DWT1"
# Ids in one shard, unless a single document has more.
SHARD_IDS = 1 << 20
# Every so many set bits, the place of one is kept for select.
SAMPLE = 256
# Longer words are encoded whenever they come up and not kept.
KEPT_LETTERS = 64
# Letters and marks that the normalizers of PLAIN leave as they are, but for upper case; a run of either is one match of its pattern.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
MARKS = string.punctuation
PLAIN = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
)


class EliasFano:
    """A non-decreasing list of whole numbers in about 2 + log2(largest / count) bits each, with random access.

    The low bits of the values lie side by side; the high bits are a row of bits in which the i-th value sets bit
    (value >> low bits) + i.  select(i), the place of the i-th set bit, gives a value back without any other.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values) -> EliasFano:
        v = np.asarray(values, dtype=np.int64)
        n, top = len(v), int(v[-1]) + 1 if len(v) else 1
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.packbits(((v[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8), bitorder="little")
        places = (v >> low_bits) + np.arange(n)
        bits = np.zeros((int(places[-1]) if n else 0) + 1, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Place of the i-th set bit; only the bytes from the sample before it to the next sample are looked at."""
        block = i // SAMPLE
        at = int(self.samples[block])
        last = int(self.samples[block + 1]) if block + 1 < len(self.samples) else 8 * len(self.high) - 1
        byte = at >> 3
        sums = np.cumsum(np.bitwise_count(self.high[byte : (last >> 3) + 1]), dtype=np.int64)
        want = i % SAMPLE + (int(self.high[byte]) & ((1 << (at & 7)) - 1)).bit_count()
        k = int(np.searchsorted(sums, want, side="right"))
        bits, rest = int(self.high[byte + k]), want - (int(sums[k - 1]) if k else 0)
        for _ in range(rest):
            bits &= bits - 1
        return (byte + k) * 8 + (bits & -bits).bit_length() - 1

    def get(self, i: int) -> int:
        at = i * self.low_bits
        held = int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes(), "little")
        low = (held >> (at & 7)) & ((1 << self.low_bits) - 1)
        return ((self.select(i) - i) << self.low_bits) | low

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return ((places - np.arange(self.n)).astype(np.int64) << self.low_bits) | low

    def to_bytes(self) -> bytes:
        head = struct.pack("<IBIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = struct.unpack_from("<IBIII", data, at)
        at += struct.calcsize("<IBIII")
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        samples = np.frombuffer(data, "<u4", c, at + a + b)
        return cls(n, low_bits, low, high, samples), at + a + b + 4 * c


def write_shard(doc_ids: list, lengths: list[int], ids: bytes) -> bytes:
    """One shard: head, document ids, ends of the documents in the array of ids, the array (2 bytes an id if it fits).

    ``ids`` holds little-endian unsigned 32-bit integers.  Document ids ascend; those that are null come first.
    """
    known = [d for d in doc_ids if d is not None]
    wide = np.frombuffer(ids, "<u4")
    width = 2 if not len(wide) or int(wide.max()) < 1 << 16 else 4
    first = known[0] if known else 0
    head = MAGIC + struct.pack("<BIqQ", width, len(doc_ids) - len(known), first, len(wide))
    # Documents' ids may lie as far apart as longs can; those that do are kept as they are.
    spread = bool(known) and known[-1] - first < 1 << 62
    names = EliasFano.of([d - first for d in known]).to_bytes() if spread else np.asarray(known, "<i8").tobytes()
    ends = EliasFano.of(np.cumsum(np.asarray(lengths, np.int64))).to_bytes()
    body = wide.astype("<u2").tobytes() if width == 2 else ids
    return head + struct.pack("<BII", spread, len(known), len(names)) + names + ends + body


class Shard:
    """A shard read back: document ids, bounds of the documents, and their ids."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        width, nulls, first, self.n_ids = struct.unpack_from("<BIqQ", data, 4)
        at = 4 + struct.calcsize("<BIqQ")
        spread, known, size = struct.unpack_from("<BII", data, at)
        at += struct.calcsize("<BII")
        if spread:
            names = [int(x) + first for x in EliasFano.read(view, at)[0].all()]
        else:
            names = np.frombuffer(data, "<i8", known, at).tolist()
        self.doc_ids = [None] * nulls + names
        self.ends, at = EliasFano.read(view, at + size)
        self.ids = np.frombuffer(data, "<u2" if width == 2 else "<u4", self.n_ids, at)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by the ends of it and of the one before."""
        return self.ids[self.ends.get(i - 1) if i else 0 : self.ends.get(i)]


def separator_of(content: str) -> str | None:
    """An added token that can stand between words without changing their ids, if the tokenizer file has one.

    Added tokens are found in the text as it is, before anything else.  Words that lack the first character of all added
    tokens can't hold one, nor form one with a token beside them where that character only stands at their starts.
    """
    added = json.loads(content)["added_tokens"]
    names = [t["content"] for t in added]
    plain = not any(t[flag] for t in added for flag in ("normalized", "lstrip", "rstrip", "single_word"))
    return names[0] if names and plain and all(n.rfind(names[0][0]) == 0 for n in names) else None


def is_plain(content: str) -> bool:
    """Whether a file's normalizers and pattern are those of PLAIN."""
    file = json.loads(content)
    steps = [(file["normalizer"] or {}).get("normalizers"), (file["pre_tokenizer"] or {}).get("pretokenizers")]
    return steps == list(PLAIN) and file["model"]["type"] == "BPE"


def word_encoder(content: str):
    """Ids of whole texts as little-endian 32-bit integers by the tokenizers library, which is asked once for each word.

    Its pattern never matches across white space, nor across a letter or digit and a mark of punctuation behind it, so
    words can be encoded one by one and without their last marks; a worker keeps the latest.  New runs of letters or marks
    go to the library's model as they are, where nothing before it could change them (``PLAIN``); other new words go to the
    library as one text in which an added token parts them.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    known: dict[str, bytes] = worker_memory("tokenizers-" + hashlib.sha256(content.encode()).hexdigest())
    separator = separator_of(content)
    separator_id = tokenizer.token_to_id(separator) if separator else None
    model = tokenizer.model if is_plain(content) and separator else None
    stand_in = dict(enumerate(byte_letters()))
    folds = "Lowercase" in [n["type"] for n in (json.loads(content)["normalizer"] or {}).get("normalizers", [])]

    def library(texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, "<u4") for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def modelled(piece: str) -> bytes:
        """Ids of a run of letters in lower case or of marks."""
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(stand_in)
        return array("I", [t.id for t in model.tokenize(letters)]).tobytes()

    def parts(word: str) -> tuple[str, ...]:
        """What a word is looked up by: its letters, in lower case if the file folds them, and the marks behind it."""
        stem = word.rstrip(MARKS)
        if not stem or not stem[-1].isalnum():
            stem = word
        own = stem.lower() if folds and (stem.isascii() or LETTERS(stem)) else stem
        return (own, word[len(stem) :]) if stem != word else (own,)

    def spelled(new: set[str]) -> dict[str, bytes]:
        alone = [w for w in new if not separator or separator[0] in w]
        out = {w: ids.tobytes() for w, ids in zip(alone, library(alone), strict=True)}
        cut = {w: parts(w) for w in new if w not in out}
        pieces = {p for ps in cut.values() for p in ps if p not in known}
        if model:
            out.update((p, modelled(p)) for p in pieces if LETTERS(p) or not p.strip(MARKS))
        joined = [p for p in pieces if p not in out]
        if joined:
            ids = library([separator.join(joined)])[0]
            ends = [*(np.flatnonzero(ids == separator_id) * 4).tolist(), len(ids) * 4]
            raw, at = ids.tobytes(), 0
            for piece, end in zip(joined, ends, strict=True):
                out[piece], at = raw[at:end], end + 4
        for w, ps in cut.items():
            out[w] = b"".join([out[p] if p in out else known[p] for p in ps])
        return out

    def encode(texts: list[str]) -> list[bytes]:
        if len(known) >= KNOWN_WORDS:
            known.clear()
        split = [words_of(t) for t in texts]
        found = [list(map(known.get, words)) for words in split]
        open_ = [i for i, ids in enumerate(found) if None in ids]
        if open_:
            new = spelled({w for i in open_ for w, ids in zip(split[i], found[i], strict=True) if ids is None})
            for i in open_:
                found[i] = [new[w] if ids is None else ids for w, ids in zip(split[i], found[i], strict=True)]
            known.update((w, ids) for w, ids in new.items() if len(w) <= KEPT_LETTERS)
        return [b"".join(ids) for ids in found]

    return encode


def write_token_shards(
    documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every whole text, append ``end_id``, and write shards in ascending document id order.

    The table at ``path`` has a row for each shard: (part, n, ids_before in the part, n_docs, n_ids, shard).  Parts are
    ranges of the document ids, so all shards by (part, n) follow each other.  Null texts are empty, null ids come first,
    equal ids are ordered by text, repeated rows are written each, other columns are not read, an empty table gives no
    shard; a document of more than SHARD_IDS ids has a shard of its own.  Spark's writer commits the files, so a lost executor leaves none half-written.
    """
    spark = documents.sparkSession
    content = spark.sparkContext.broadcast(read_tokenizer(tokenizer))

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = word_encoder(content.value)
        part = TaskContext.get().partitionId()
        end = struct.pack("<I", end_id)
        doc_ids, lengths, held, size, before, number = [], [], [], 0, 0, 0

        def packed():
            row = [[part], [number], [before], [len(doc_ids)], [size], [write_shard(doc_ids, lengths, b"".join(held))]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["part", "n", "ids_before", "n_docs", "n_ids", "shard"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(names), 64):
                for name, ids in zip(names[at : at + 64], encode([t or "" for t in texts[at : at + 64]]), strict=True):
                    n = len(ids) // 4 + 1
                    if size and size + n > SHARD_IDS:
                        yield packed()
                        before, number = before + size, number + 1
                        doc_ids, lengths, held, size = [], [], [], 0
                    doc_ids.append(name)
                    lengths.append(n)
                    held += [ids, end]
                    size += n
        if size:
            yield packed()

    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = texts.repartitionByRange(shuffle_partitions(spark), F.col("id")).sortWithinPartitions("id", "text")
    schema = "part int, n int, ids_before long, n_docs int, n_ids long, shard binary"
    dealt.mapInArrow(run, schema).write.mode("errorifexists").parquet(path)


def read_token_shards(spark, path: str) -> DataFrame:
    """A row for each document of the shards: (doc_id, start, n_tokens, ids_crc32), start counting all ids before it.

    Bounds of documents come from select.  Shards of no documents give no rows.
    """
    shards = spark.read.parquet(path)
    # One row for each part: as many as the writing job had tasks.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(data.as_py())
                ends = np.array([shard.ends.get(i) for i in range(shard.ends.n)], np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                checks = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                columns = [
                    pa.array(shard.doc_ids, pa.int64()),
                    pa.array(starts + base, pa.int64()),
                    pa.array(ends - starts, pa.int64()),
                    pa.array(checks, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = shards.join(F.broadcast(bases), "part").select((F.col("base") + F.col("ids_before")).alias("base"), "shard")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
