"""Byte-pair encoding and decoding of whole texts with a tokenizer file in the format of the tokenizers library."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import worker_memory

# Distinct words that a Python worker keeps the ids of; beyond that it starts anew.
KNOWN_WORDS = 1_000_000
# Control characters that Python's split() takes for white space and Unicode doesn't.
CONTROLS = "\x1c\x1d\x1e\x1f"


def words_of(text: str) -> list[str]:
    """The pieces of a text between white space (Unicode's White_Space)."""
    if any(c in text for c in CONTROLS):
        return regex.findall(r"\P{White_Space}+", text)
    return text.split()


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: its own character where that prints."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder for one tokenizer file: NFC, lower case, a split pattern, byte-level letters, word ends.

    The pattern of such files never matches across white space, so a text is encoded word by word.
    """

    def __init__(self, content: str):
        file = json.loads(content)
        model = file["model"]
        steps = file["pre_tokenizer"]["pretokenizers"]
        self.vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {p: rank for rank, p in enumerate(pairs)}
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        by_id = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.strings = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self.letters = byte_letters()
        self.known: dict[str, bytes] = worker_memory("bpe-" + hashlib.sha256(content.encode()).hexdigest())

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge neighbours in order of rank, leftmost first: a queue over a doubly linked list of symbols.

        A merge leaves entries of the queue that name symbols which are gone; they are skipped when they come up.
        """
        ranks, n = self.ranks, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None:
                queue.append((rank, i, symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(queue, (rank, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(queue, (rank, h, symbols[h], symbols[i]))
        return [s for s in symbols if s]

    def word_ids(self, word: str) -> list[int]:
        ids = []
        for part in self.cut.split(word) if any(s in word for s in self.special) else [word]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            # Letter by letter, as sigma at a word's end stays sigma.
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for piece in self.pattern.findall(plain):
                symbols = [self.letters[b] for b in piece.encode()]
                symbols[-1] += self.suffix
                ids += [self.vocab[s] for s in self.merged(symbols) if s in self.vocab]
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        for word in words_of(text):
            ids = known.get(word)
            if ids is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                ids = known[word] = array("I", self.word_ids(word)).tobytes()
            out.append(ids)
        return b"".join(out)

    def decode(self, ids) -> str:
        """The vocabulary's strings of the ids one after another; files without a decoder part them by a space."""
        return " ".join(map(self.strings.__getitem__, ids))


def read_tokenizer(path: str) -> str:
    """The content of a tokenizer file (a few MB), read where the job is planned."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_and_decode(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text and the text that they decode to, as digests.

    (doc_id, n_tokens, ids_sha256, decoded_sha256).  Null and empty texts have no ids and decode to the empty string.
    ``tokenizer`` is a path; its content is broadcast.  Repeated rows give repeated rows; other columns are not read.
    """
    content = documents.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))

    def run(batches):
        bpe = Bpe(content.value)
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for text in batch.column(1):
                raw = bpe.encode(text.as_py() or "")
                ids = array("I", raw)
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(raw).hexdigest())
                text_digests.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    texts = documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
