"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

Each document's ids, with the end id, are cut into full sequences and then into pieces whose
lengths are the powers of two in the binary form of the rest. Every piece is a sequence of its
own; pieces of one length form a bucket, and sequence numbers run through the buckets.

Words repeat, so each worker tokenizes a white-space word once and keeps its ids in a bounded
cache. The tokenizer treats white space as a border, so words give the same ids as the text.

Defined cases: a null or empty text gives the end id alone. A text without white space is one word.
Rows repeated in full are packed as rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.operators.ordered import Total, with_ordered
from leadlake.session import materialize

# Words a worker remembers, about 150 bytes each and kept between tasks; beyond that it starts afresh.
CACHE_WORDS = 250_000
# Ids in one batch of pieces that carry their ids.
IDS_HELD = 1 << 21
# Bytes of text split into words at once.
SLICE_BYTES = 1 << 22
PLAIN = re.compile(r"[^İɐ-\U0010ffff]*\Z")


def byte_letters() -> list[str]:
    """One printable character per byte: printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordIds(dict):
    """White-space words (bytes) to their place in one flat list of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = "".join(byte_letters())
        self.table = dict(enumerate(self.letters))
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.tails: dict[str, list[int]] = {}
        self.flat, self.starts, self.sizes = array("I"), array("q"), array("q")

    def part(self, text: str) -> list[int]:
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.table)
        return [t.id for t in self.tokenizer.model.tokenize(text)]

    def ids_of(self, word: str) -> list[int]:
        """Letters, then punctuation, all Latin: cut here as the tokenizer would; anything else goes through it whole."""
        head = word.rstrip(string.punctuation)
        if (head.isalpha() or not head) and (word.isascii() or PLAIN.match(word)):
            ids = self.part(head.lower()) if head else []
            tail = word[len(head):]
            if tail:
                if tail not in self.tails:
                    self.tails[tail] = self.part(tail)
                ids = ids + self.tails[tail]
            return ids
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def __missing__(self, word: bytes) -> int:
        ids = self.ids_of(word.decode())
        place = self[word] = len(self.starts)
        self.starts.append(len(self.flat))
        self.sizes.append(len(ids))
        self.flat.extend(ids)
        return place

    def gather(self, places: np.ndarray) -> np.ndarray:
        starts, sizes = np.frombuffer(self.starts, np.int64)[places], np.frombuffer(self.sizes, np.int64)[places]
        shift = starts - (np.cumsum(sizes) - sizes)
        return np.frombuffer(self.flat, "<u4")[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]

    def encode(self, text: bytes) -> np.ndarray:
        found = [np.empty(0, dtype="<u4")]
        at = 0
        while at < len(text):
            end = at + SLICE_BYTES
            if end < len(text):
                border = re.compile(rb"[ \t\n\r\x0b\x0c]").search(text, end)
                end = border.start() if border else len(text)
            if len(self) > CACHE_WORDS:
                self.reset()
            words = text[at:end].split()
            if not words:
                break
            places = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
            found.append(self.gather(places))
            at = end
        return np.concatenate(found)


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One encoder per worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, then falling powers of two."""
    cuts, at = [], 0
    while n - at >= longest:
        cuts.append((at, longest))
        at += longest
    while at < n:
        size = 1 << ((n - at).bit_length() - 1)
        cuts.append((at, size))
        at += size
    return cuts


def packer(path: str, end_id: int, longest: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        part = TaskContext.get().partitionId()
        counts: dict[int, int] = {}
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", *["ids"] * with_ids)
        for batch in batches:
            kinds = {"doc_id": batch.schema.field(0).type, "ids": pa.list_(pa.int32())}
            columns: dict[str, list] = {k: [] for k in names}
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids = np.append(words.encode(text.as_py() or b""), np.uint32(end_id)).astype("<u4")
                for start, length in pieces(len(ids), longest):
                    piece = ids[start : start + length]
                    counts[length] = counts.get(length, -1) + 1
                    row = (doc_id, start, length, zlib.crc32(piece.tobytes()), len(ids), part, counts[length], *[piece.astype(np.int32)] * with_ids)
                    for column, value in zip(columns.values(), row):
                        column.append(value)
                held += len(ids) * with_ids
                if held > IDS_HELD:
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()})
                    columns, held = {k: [] for k in names}, 0
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()})

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 2, longest: int = 4096, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]); ``with_ids`` adds the ids themselves.

    ``tokenizer`` is the path of a tokenizers file that every executor can read. ``longest`` is a power of two.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long"
    cut = narrow.mapInArrow(packer(tokenizer, end_id, longest, with_ids), schema + ", ids array<int>" * with_ids)
    rows = materialize(cut, "pack-pieces")
    sizes = rows.groupBy("length", "part").agg((F.max("nth") + 1).alias("n"))
    bases = with_ordered(sizes, [], ["length", "part"], {"base": Total(F.col("n"))}).drop("n")
    return rows.join(bases, ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)
