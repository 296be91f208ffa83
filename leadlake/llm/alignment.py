"""Alignment of two tokenizers over a corpus, with counts of aligned token pairs.

Byte offsets where a token of either tokenizer ends cut a text; each cut belongs to one token of both, and these two are
linked. Cuts that end a token of both close a group. A pair's count is the number of documents that hold it linked.

Counting is by minimal perfect hashing. A first pass over the documents gives each task's distinct pairs. The distinct
pairs of the corpus fall into hash bins, and every bin gets a cascade of bit arrays in which each pair owns one bit: the
rank of that bit is the pair's slot. Count vectors are dense arrays over the slots, filled from the tasks' pairs and
summed in a tree; each slot holds its key, so a foreign key is noticed. A second pass aligns the documents again and looks
the counts up.

Both tokenizers cut where a space follows anything but white space: no byte-level piece starts before such a space and ends
after it, and no sentencepiece piece has a space behind another letter, which is checked. So a worker aligns a stretch
between such borders once, remembers it and puts texts together from stretches. Texts with a stretch that is too long or is
not given back are aligned in one piece.

The table of pairs is bounded by the two vocabularies, not by the corpus. Up to ``broadcast_pairs`` entries it is sent to
the workers; a larger one is joined with the documents' links, with the same result.

Defined cases: a text that is null or empty, or that a tokenizer does not give back byte for byte, has no tokens: counts 0
and the empty digest. Repeated rows count as documents of their own. Null ids stay null. Only the id and the text are
read, so further columns may have any name. A text is aligned whole, whatever its length. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.packing import byte_letters
from leadlake.session import materialize

# Hash bins: at most (size of one vocabulary x size of the other) / BINS pairs meet in one.
BIN_BITS = 9
BINS = 1 << BIN_BITS
# Largest pair table that is sent to every worker: 17 bytes an entry.
BROADCAST_PAIRS = 4_000_000
# Pairs that a task of the first pass holds before it hands them on.
HELD_PAIRS = 3_000_000
BATCH_BYTES = 1 << 21
# Stretches and pairs a worker remembers before it starts afresh, letters of a stretch, stretches tokenized as one text.
REMEMBERED, STRETCH_CHARS, TOGETHER = 500_000, 256, 4_096
# A place between two stretches: a space after anything but white space.
BORDER = re.compile(r"(?<=\S)(?= )")
# Bits of a level for each pair that is still without a slot.
BITS_PER_PAIR = 1.7
# Dense vectors that meet in one step of the tree.
FAN = 16
# Texts of letters below this are split alike by both readers of the byte-level vocabulary.
PLAIN_BELOW = "԰"
# Stands for a count that must not be used.
MISSING = -(1 << 50)
TOTALS = ("n_a", "n_b", "n_groups", "n_links")
POPCOUNT = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


class ByteLevel:
    """A byte-level BPE of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        back = {letter: value for value, letter in enumerate(byte_letters())}
        vocabulary = self.full.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(back[c] for c in token)
        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        self.parts = True
        self.ranked = None
        # Ids in the order of the merges are ranks, which a faster reader of the same vocabulary takes.
        if all(vocabulary["".join(pair)] == 256 + i for i, pair in enumerate(pairs)):
            import tiktoken
            from public_tokenizers import PATTERN

            ranks = {token: i for i, token in enumerate(self.bytes) if token and i < 256 + len(merges)}
            self.ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: Sequence[str]) -> list[Sequence[int]]:
        found = []
        for text in texts:
            if self.ranked is not None and (text.isascii() or max(text) < PLAIN_BELOW):
                found.append(self.ranked.encode_ordinary(" " + text))
            else:
                found.append(self.full.encode(" " + text, add_special_tokens=False).ids)
        return found


class Pieces:
    """A sentencepiece model, which adds the leading space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        self.parts = True
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.parts = self.parts and re.search("[^▁]▁", piece) is None
            self.bytes.append(bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: Sequence[str]) -> list[Sequence[int]]:
        return self.model.encode(list(texts), num_threads=1)


class Spelled:
    """Ids of one tokenizer with the bytes they stand for."""

    def __init__(self, reader: ByteLevel | Pieces):
        self.encode, self.parts = reader.encode, reader.parts
        self.sizes = np.array([len(b) for b in reader.bytes], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(reader.bytes), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        shift = self.starts[ids] - (np.cumsum(sizes) - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


def flattened(rows: Sequence[Sequence[int]]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(np.asarray(row, dtype=np.int64) for row in rows)])


class Aligned:
    """The tokens, cuts and links of a batch of texts; ``texts`` holds those that have any."""

    def __init__(self, texts: np.ndarray, ids: Sequence[np.ndarray], counts: Sequence[np.ndarray], a: Spelled, b: Spelled):
        self.texts = texts
        (self.ids_a, self.ids_b), (self.n_a, self.n_b) = ids, counts
        ends_a, ends_b = np.cumsum(a.sizes[self.ids_a]), np.cumsum(b.sizes[self.ids_b])
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        cuts = ends[np.concatenate([ends[1:] != ends[:-1], [True]])] if len(ends) else ends
        self.of_a, self.of_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        self.closes = (ends_a[self.of_a] == cuts) & (ends_b[self.of_b] == cuts)
        self.doc = np.searchsorted(np.cumsum(self.n_a), self.of_a, "right")
        self.keys = self.ids_a[self.of_a] << 32 | self.ids_b[self.of_b]
        self.n_links = np.bincount(self.doc, minlength=len(texts))
        self.n_groups = np.bincount(self.doc[self.closes], minlength=len(texts))

    @classmethod
    def singly(cls, texts: Sequence[str], a: Spelled, b: Spelled) -> Aligned:
        """Texts tokenized one by one."""
        ids = [a.encode(texts), b.encode(texts)]
        whole = []
        spelled = [reader.spell(flattened(rows)) for reader, rows in zip((a, b), ids)]
        at = [0, 0]
        for n, text in enumerate(texts):
            source, same = b" " + text.encode(), True
            for side, (reader, rows) in enumerate(zip((a, b), ids)):
                size = int(reader.sizes[rows[n]].sum()) if len(rows[n]) else 0
                same = same and size == len(source) and spelled[side][at[side] : at[side] + size].tobytes() == source
                at[side] += size
            if same:
                whole.append(n)
        counts = [np.array([len(rows[n]) for n in whole], dtype=np.int64) for rows in ids]
        return cls(np.array(whole, dtype=np.int64), [flattened([rows[n] for n in whole]) for rows in ids], counts, a, b)

    @classmethod
    def together(cls, texts: Sequence[str], a: Spelled, b: Spelled) -> Aligned:
        """Stretches tokenized as one text; singly where this text is not given back."""
        source = " ".join(texts)
        borders = np.cumsum(np.array([len(text.encode()) for text in texts]) + 1)
        ids, counts = [], []
        for reader in (a, b):
            found = np.array(reader.encode([source])[0], dtype=np.int64)
            if reader.spell(found).tobytes() != b" " + source.encode():
                return cls.singly(texts, a, b)
            ids.append(found)
            counts.append(np.diff(np.searchsorted(np.cumsum(reader.sizes[found]), borders) + 1, prepend=0))
        return cls(np.arange(len(texts)), ids, counts, a, b)

    def document_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys, number of texts that hold each)."""
        order = np.lexsort((self.doc, self.keys))
        keys, doc = self.keys[order], self.doc[order]
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])]) if len(keys) else np.empty(0, bool)
        return np.unique(keys[fresh], return_counts=True)

    def group_texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every text: the ids of both sides, group by group."""
        group = np.cumsum(self.closes) - self.closes
        group_a, group_b = (np.zeros(len(ids), dtype=np.int64) for ids in (self.ids_a, self.ids_b))
        group_a[self.of_a], group_b[self.of_b] = group, group
        parts = []
        for ids, groups, close in ((self.ids_a, group_a, "|"), (self.ids_b, group_b, ";")):
            last = np.concatenate([groups[1:] != groups[:-1], [True]]) if len(ids) else np.empty(0, bool)
            inner, closing = (id_texts(mark, int(ids.max(initial=0)) + 1) for mark in (",", close))
            parts.append(np.where(last, closing[ids], inner[ids]))
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        words = np.concatenate(parts)[order].tolist()
        ends = np.cumsum(self.n_a + self.n_b)
        return ["".join(words[start:end])[:-1] for start, end in zip((ends - self.n_a - self.n_b).tolist(), ends.tolist())]


_id_texts: dict[str, np.ndarray] = {}


def id_texts(mark: str, n: int) -> np.ndarray:
    """The ids from 0 to at least ``n`` - 1 as texts with a mark behind; as many as the vocabulary has in the end."""
    if len(_id_texts.get(mark, ())) < n:
        _id_texts[mark] = np.array([f"{i}{mark}" for i in range(2 * n)], dtype=object)
    return _id_texts[mark]


class Stretches:
    """What a worker remembers of stretches between borders: sums, group texts and links, as places in a list of pairs."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Spelled(ByteLevel(path_a)), Spelled(Pieces(path_b))
        self.parts = self.a.parts and self.b.parts
        self.reset()

    def reset(self) -> None:
        self.places: dict[str, int] = {}
        self.pairs: dict[int, int] = {}
        self.groups: list[bytes] = []
        # Kinds: 0 whole, 1 whole but no border behind it, 2 to be aligned with its text.
        self.kinds, self.links, self.link_ends = array("b"), array("q"), array("q")
        self.sums = {name: array("q") for name in TOTALS}

    def full(self) -> bool:
        return len(self.places) > REMEMBERED or len(self.pairs) > REMEMBERED

    def pair_places(self, keys: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(keys, return_inverse=True)
        return np.array([self.pairs.setdefault(k, len(self.pairs)) for k in distinct.tolist()], dtype=np.int64)[where]

    def keep(self, names: Sequence[str], kinds: np.ndarray, found: Aligned | None) -> None:
        """Remember stretches that ``found`` aligns, or that are to be aligned with their texts."""
        first, n = len(self.kinds), len(names)
        self.places.update(zip(names, range(first, first + n)))
        self.kinds.frombytes(kinds.astype(np.int8).tobytes())
        for name, values in self.sums.items():
            values.frombytes((getattr(found, name) if found else np.zeros(n)).astype(np.int64).tobytes())
        self.groups += [text.encode() for text in found.group_texts()] if found else [b""] * n
        ends = len(self.links) + (np.cumsum(found.n_links) if found else np.zeros(n))
        if found:
            self.links.frombytes(self.pair_places(found.keys).tobytes())
        self.link_ends.frombytes(ends.astype(np.int64).tobytes())

    def learn(self, names: list[str]) -> None:
        """Align new stretches; one that is long or not given back is left to its texts."""
        apart = [name for name in names if not name or len(name) > STRETCH_CHARS]
        short = [name for name in names if name and len(name) <= STRETCH_CHARS]
        opened = np.array([name[-1].isspace() for name in short], dtype=bool)
        for kind, way in ((0, Aligned.together), (1, Aligned.singly)):
            chosen = [short[i] for i in np.flatnonzero(opened == kind)]
            for at in range(0, len(chosen), TOGETHER):
                part = chosen[at : at + TOGETHER]
                found = way(part, self.a, self.b)
                apart += [part[i] for i in np.setdiff1d(np.arange(len(part)), found.texts)]
                part = [part[i] for i in found.texts]
                self.keep(part, np.full(len(part), kind), found)
        self.keep(apart, np.full(len(apart), 2), None)

    def of(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(places, how many of them each text has, texts to be aligned in one piece); these have none."""
        if not self.parts:
            return np.empty(0, np.int64), np.zeros(len(texts), dtype=np.int64), list(range(len(texts)))
        names = [text.split(" ") for text in texts]
        for at_spaces in (True, False):
            flat = [name for parts in names for name in parts]
            fresh = set(flat).difference(self.places)
            if fresh:
                self.learn(sorted(fresh))
            places = np.fromiter(map(self.places.__getitem__, flat), dtype=np.int64, count=len(flat))
            sizes = np.array([len(parts) for parts in names], dtype=np.int64)
            kinds = np.frombuffer(self.kinds, np.int8)[places]
            of = np.repeat(np.arange(len(texts)), sizes)
            if at_spaces:
                # A split at a space that is no border is made anew at borders only.
                inner = (kinds > 0) & (np.arange(len(places)) != np.cumsum(sizes)[of] - 1)
                again = np.unique(of[inner]).tolist()
                if not again:
                    break
                for n in again:
                    names[n] = [part[1:] for part in BORDER.split(" " + texts[n])]
        apart = np.unique(of[kinds == 2])
        keep = ~np.isin(of, apart)
        return places[keep], np.where(np.isin(np.arange(len(texts)), apart), 0, sizes), apart.tolist()

    def links_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair of every link, number of links of every place)."""
        ends = np.frombuffer(self.link_ends, np.int64)
        starts = ends[places - 1] * (places > 0)
        sizes = ends[places] - starts
        shift = starts - (np.cumsum(sizes) - sizes)
        return np.frombuffer(self.links, np.int64)[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes


_stretches: dict[tuple[str, str], Stretches] = {}


def stretches(path_a: str, path_b: str) -> Stretches:
    """One store per worker process and pair of tokenizers, kept between tasks."""
    if (path_a, path_b) not in _stretches:
        _stretches[path_a, path_b] = Stretches(path_a, path_b)
    return _stretches[path_a, path_b]


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``sizes`` values."""
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return running[ends] - running[ends - sizes]


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], np.ndarray]]:
    """(ids, texts that are not empty, their rows) of about ``BATCH_BYTES`` of text at a time."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= BATCH_BYTES):
                size += len(texts[end] or "")
                end += 1
            rows = [i - at for i in range(at, end) if texts[i]]
            yield batch.column("doc_id").slice(at, end - at), [texts[at + i] for i in rows], np.array(rows, dtype=np.int64)
            at = end


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """64 hash bits of every key, different on each level; level -1 deals the bins."""
    h = keys.astype(np.uint64) + np.uint64((level + 2) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bin_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, -1) >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def perfect_levels(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits of all levels in bytes, bits per level): on each level the keys that meet no other one take their bit."""
    sizes, bits = [], []
    while len(keys):
        size = max(64, -(-int(len(keys) * BITS_PER_PAIR) // 8) * 8)
        at = (mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        bits.append(np.packbits(alone))
        sizes.append(size)
        keys = keys[~alone[at]]
    return (np.concatenate(bits) if bits else np.empty(0, np.uint8)), np.array(sizes, dtype=np.int64)


class PairTable:
    """Slots, keys and counts of some bins, in bin order; ``bins`` gives the row of every key."""

    def __init__(self, rows: Sequence[dict], bins: Callable[[np.ndarray], np.ndarray]):
        self.bins = bins
        sizes = [np.frombuffer(r["sizes"], np.int64) for r in rows]
        self.sizes = np.zeros((len(rows), max((len(s) for s in sizes), default=0)), dtype=np.int64)
        for r, s in enumerate(sizes):
            self.sizes[r, : len(s)] = s
        self.starts = np.cumsum(self.sizes.ravel()).reshape(self.sizes.shape) - self.sizes
        self.bits = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8)
        self.before = np.concatenate([[0], np.cumsum(POPCOUNT[self.bits], dtype=np.int64)])
        self.keys = np.frombuffer(b"".join(r.get("keys", b"") for r in rows), np.int64)
        self.counts = np.frombuffer(b"".join(r.get("counts", b"") for r in rows), np.int64)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key that has one; a foreign key gets any slot or -1."""
        slot = np.full(len(keys), -1, dtype=np.int64)
        open_, row = np.arange(len(keys)), self.bins(keys)
        for level in range(self.sizes.shape[1]):
            size = self.sizes[row, level]
            there = size > 0
            open_, row, size = open_[there], row[there], size[there]
            if not len(open_):
                break
            at = self.starts[row, level] + (mixed(keys[open_], level) % size.astype(np.uint64)).astype(np.int64)
            byte, place = at >> 3, at & 7
            value = self.bits[byte].astype(np.int64)
            taken = (value >> (7 - place)) & 1 == 1
            slot[open_[taken]] = (self.before[byte] + POPCOUNT[value >> (8 - place)])[taken]
            open_, row = open_[~taken], row[~taken]
        return slot

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; a key that is not in the table is an error."""
        slot = self.ranks(keys)
        if len(keys) and (slot.min() < 0 or (self.keys[slot] != keys).any()):
            raise KeyError("a pair of tokens that the first pass did not find")
        return slot


def one_row(keys: np.ndarray) -> np.ndarray:
    return np.zeros(len(keys), dtype=np.int64)


def first_pass(path_a: str, path_b: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each task's distinct pairs with the number of its documents that hold them, one row per bin."""
    def hand_on(part: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = merged(held)
        bins = bin_of(keys)
        order = np.argsort(bins, kind="stable")
        keys, counts, bins = keys[order], counts[order], bins[order]
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]])) if len(bins) else np.empty(0, np.int64)
        ends = np.append(first[1:], len(bins))
        lists = lambda values: pa.array([values[s:e] for s, e in zip(first, ends)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(first), part), pa.int64()), pa.array(bins[first], pa.int32()), lists(keys), lists(counts)], names=["part", "bin", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = stretches(path_a, path_b)
        part, held = TaskContext.get().partitionId(), []
        counts = np.zeros(0, dtype=np.int64)

        def take() -> list[tuple[np.ndarray, np.ndarray]]:
            """What ``held`` and the counts come to; the counts start anew."""
            nonlocal counts
            keys = np.fromiter(known.pairs, dtype=np.int64, count=len(known.pairs))[: len(counts)]
            some = [*held, (keys[counts > 0], counts[counts > 0])]
            counts = np.zeros(0, dtype=np.int64)
            return [merged(some)]

        for _, texts, _ in text_batches(batches):
            if known.full():
                held = take()
                known.reset()
                if len(held[0][0]) > HELD_PAIRS:
                    yield hand_on(part, held)
                    held = []
            places, sizes, apart = known.of(texts)
            links, per_place = known.links_of(places)
            pairs = len(known.pairs)
            doc = np.repeat(np.repeat(np.arange(len(texts)), sizes), per_place)
            counts = np.concatenate([counts, np.zeros(pairs - len(counts), dtype=np.int64)])
            counts += np.bincount(np.unique(doc * pairs + links) % max(1, pairs), minlength=pairs)
            if apart:
                held.append(Aligned.singly([texts[n] for n in apart], known.a, known.b).document_pairs())
                if sum(len(k) for k, _ in held) > HELD_PAIRS:
                    held = [merged(held)]
        yield hand_on(part, take())

    return run


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([c for _, c in held]), minlength=len(keys)).astype(np.int64)


def hash_bin(key: tuple, table: pa.Table) -> pa.Table:
    """The minimal perfect hash of one bin, with its keys in slot order."""
    keys = table.column("key").to_numpy()
    bits, sizes = perfect_levels(keys)
    row = {"bin": key[0].as_py(), "n": len(keys), "sizes": sizes.tobytes(), "bits": bits.tobytes()}
    placed = np.empty(len(keys), dtype=np.int64)
    placed[PairTable([row], one_row).ranks(keys)] = keys
    return pa.Table.from_pylist([row | {"keys": placed.tobytes()}], HASHED)


HASHED = pa.schema([("bin", pa.int32()), ("n", pa.int64()), ("sizes", pa.binary()), ("bits", pa.binary()), ("keys", pa.binary())])
HASH_COLUMNS = "bin int, n long, sizes binary, bits binary, keys binary"


def count_vector(key: tuple, chunks: pa.Table, table: pa.Table) -> pa.Table:
    """The dense count vector of one bin over some tasks' pairs."""
    [row] = table.to_pylist()
    slots = PairTable([row], one_row)
    total = np.zeros(row["n"], dtype=np.int64)
    for keys, counts in zip(chunks.column("keys"), chunks.column("counts")):
        # Keys are distinct inside a chunk.
        total[slots.slots(keys.values.to_numpy())] += counts.values.to_numpy()
    return pa.table({"bin": pa.array([row["bin"]], pa.int32()), "salt": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def add_vectors(key: tuple, table: pa.Table) -> pa.Table:
    """One step of the tree."""
    vectors = table.column("counts")
    total = np.frombuffer(vectors[0].as_py(), np.int64).copy()
    for vector in vectors[1:]:
        total += np.frombuffer(vector.as_py(), np.int64)
    return pa.table({"bin": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def counted_pairs(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The pair table, one row per hash bin: (bin, n, sizes, bits, keys, counts)."""
    found = materialize(docs.mapInArrow(first_pass(path_a, path_b), "part long, bin int, keys array<long>, counts array<long>"), "align-found")
    keys = found.select("bin", F.explode("keys").alias("key")).distinct()
    hashed = materialize(keys.groupBy("bin").applyInArrow(hash_bin, HASH_COLUMNS), "align-hash")
    entries = found.agg(F.sum(F.size("keys"))).first()[0] or 0
    slots = hashed.agg(F.sum("n")).first()[0] or 0
    # A vector takes at least four times the pairs it has slots, so vectors and copies of the hash stay below the pairs in size.
    salts = max(1, -(-entries // max(1, 4 * slots)))
    left = found.select("bin", F.pmod(F.xxhash64("part"), F.lit(salts)).alias("salt"), "keys", "counts")
    right = hashed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    right = right.join(left.select("bin", "salt").distinct(), ["bin", "salt"], "left_semi")
    vectors = left.groupBy("bin", "salt").cogroup(right.groupBy("bin", "salt")).applyInArrow(count_vector, "bin int, salt long, counts binary")
    while salts > 1:
        salts = -(-salts // FAN)
        vectors = vectors.select("bin", F.floor(F.col("salt") / FAN).alias("salt"), "counts").groupBy("bin", "salt").applyInArrow(add_vectors, "bin int, salt long, counts binary")
    return materialize(hashed.join(vectors.drop("salt"), "bin"), "align-pairs")


def pair_rows(table: DataFrame) -> DataFrame:
    """(key, a, b, n) of every pair of a table of :func:`counted_pairs`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                key, n = np.frombuffer(keys.as_py(), np.int64), np.frombuffer(counts.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(n)], names=["key", "a", "b", "n"])

    return table.select("keys", "counts").mapInArrow(run, "key long, a long, b long, n long")


def best_counts(table: DataFrame) -> DataFrame:
    """(a, best): the highest count of every id of the first tokenizer."""
    return pair_rows(table).groupBy("a").agg(F.max("n").alias("best"))


def second_pass(path_a: str, path_b: str, look_up: Callable[[Stretches], Links], with_groups: bool):
    """Rows of (doc_id, totals, digest of the groups, what ``look_up`` makes of the links)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = stretches(path_a, path_b)
        rate = look_up(known)
        for ids, texts, rows in text_batches(batches):
            if known.full():
                known.reset()
                rate = look_up(known)
            places, sizes, apart = known.of(texts)
            columns: dict[str, pa.Array] = {"doc_id": ids}
            whole = Aligned.singly([texts[n] for n in apart], known.a, known.b) if apart else None
            of_whole = np.array(apart, dtype=np.int64)[whole.texts] if apart else None
            for name in TOTALS:
                values = np.zeros(len(ids), dtype=np.int64)
                values[rows] = summed(np.frombuffer(known.sums[name], np.int64)[places], sizes)
                if apart:
                    values[rows[of_whole]] = getattr(whole, name)
                columns[name] = pa.array(values)
            ends, groups = np.cumsum(sizes), [b""] * len(ids)
            for row, end, size in zip(rows.tolist(), ends.tolist(), sizes.tolist()):
                groups[row] = b";".join([known.groups[p] for p in places[end - size : end].tolist()])
            if apart:
                for row, text in zip(rows[of_whole].tolist(), whole.group_texts()):
                    groups[row] = text.encode()
            columns["groups_sha256"] = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups], pa.string())
            if with_groups:
                columns["groups"] = pa.array([g.decode() for g in groups], pa.string())
            columns |= rate(places, sizes, whole, rows, rows[of_whole] if apart else None, len(ids))
            yield pa.RecordBatch.from_pydict(columns)

    return run


# (places, places of each text, texts aligned in one piece, rows of the texts, rows of those, number of rows) to columns.
Links = Callable[[np.ndarray, np.ndarray, "Aligned | None", np.ndarray, "np.ndarray | None", int], dict[str, pa.Array]]


def align_tokenizers(
    docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", with_groups: bool = False, broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) of every document.

    ``path_a`` is a byte-level BPE of the tokenizers library, ``path_b`` a sentencepiece model; every executor can read both.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    table = counted_pairs(narrow, path_a, path_b)
    best = best_counts(table)
    names = ["doc_id", *TOTALS, "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in TOTALS) + ", groups_sha256 string" + ", groups string" * with_groups
    if (table.agg(F.sum("n")).first()[0] or 0) <= broadcast_pairs:
        # Both are bounded: the table by the check, the best counts by the vocabulary.
        rows = [r.asDict() for r in table.orderBy("bin").collect()]
        context = docs.sparkSession.sparkContext
        sent = context.broadcast((rows, [(r.a, r.best) for r in best.collect()]))
        summed = narrow.mapInArrow(second_pass(path_a, path_b, sent_counts(sent, uuid.uuid4().hex), with_groups), schema + ", n_best long, count_sum long")
        return summed.select(*names)
    linked = narrow.mapInArrow(second_pass(path_a, path_b, own_links, with_groups), schema + ", keys array<long>, times array<long>")
    linked = materialize(linked.withColumn("row", F.monotonically_increasing_id()), "align-links")
    each = linked.select("row", F.explode(F.arrays_zip("keys", "times")).alias("link")).select("row", "link.*")
    rated = pair_rows(table).join(best, "a").select(F.col("key").alias("keys"), "n", (F.col("n") == F.col("best")).cast("long").alias("top"))
    sums = each.join(rated, "keys").groupBy("row").agg(F.sum(F.col("top") * F.col("times")).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return linked.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")}).select(*names)


_tables: dict[str, tuple[PairTable, np.ndarray]] = {}


def sent_counts(sent: Broadcast, name: str) -> Callable[[Stretches], Links]:
    """Counts looked up in the table that was sent; a worker unpacks one table at a time, known by ``name``."""
    def unpacked() -> tuple[PairTable, np.ndarray]:
        if name not in _tables:
            _tables.clear()
            bins, best = sent.value
            place = np.full(BINS, -1, dtype=np.int64)
            place[[r["bin"] for r in bins]] = np.arange(len(bins))
            highest = np.zeros(max((a for a, _ in best), default=-1) + 1, dtype=np.int64)
            for a, value in best:
                highest[a] = value
            _tables[name] = PairTable(bins, lambda k: place[bin_of(k)]), highest
        return _tables[name]

    def rated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table, highest = unpacked()
        counts = table.counts[table.slots(keys)]
        return (counts == highest[keys >> 32]).astype(np.int64), counts

    def look_up(known: Stretches) -> Links:
        # Sums over the links of every stretch, worked out when it first occurs.
        of_pairs = of_places = [np.empty(0, np.int64)] * 2

        def rate(places: np.ndarray, sizes: np.ndarray, whole: Aligned | None, rows: np.ndarray, whole_rows: np.ndarray | None, n: int) -> dict[str, pa.Array]:
            nonlocal of_pairs, of_places
            fresh = np.fromiter(known.pairs, dtype=np.int64, count=len(known.pairs))[len(of_pairs[0]) :]
            # A stretch of another job's texts may have pairs that this table lacks; it is not asked for here.
            of_pairs = [np.concatenate([old, new]) for old, new in zip(of_pairs, present(fresh))]
            links, per_place = known.links_of(np.arange(len(of_places[0]), len(known.kinds)))
            of_places = [np.concatenate([old, summed(values[links], per_place)]) for old, values in zip(of_places, of_pairs)]
            found = {}
            for column, (name, of_place) in enumerate(zip(("n_best", "count_sum"), of_places)):
                values = np.zeros(n, dtype=np.int64)
                values[rows] = summed(of_place[places], sizes)
                if whole is not None:
                    values[whole_rows] = summed(rated(whole.keys)[column], whole.n_links)
                found[name] = pa.array(values)
            return found

        def present(keys: np.ndarray) -> list[np.ndarray]:
            table, _ = unpacked()
            slot = table.ranks(keys)
            there = (slot >= 0) & (table.keys[slot] == keys) if len(table.keys) else np.zeros(len(keys), dtype=bool)
            values = [np.full(len(keys), MISSING, dtype=np.int64) for _ in range(2)]
            for all_values, some in zip(values, rated(keys[there])):
                all_values[there] = some
            return values

        return rate

    return look_up


def own_links(known: Stretches) -> Links:
    """The distinct links of every text, each with the number of times it occurs."""
    def rate(places: np.ndarray, sizes: np.ndarray, whole: Aligned | None, rows: np.ndarray, whole_rows: np.ndarray | None, n: int) -> dict[str, pa.Array]:
        keys, times = [[]] * n, [[]] * n
        of_pair = np.fromiter(known.pairs, dtype=np.int64, count=len(known.pairs))
        links, per_place = known.links_of(places)
        per_text = summed(per_place, sizes)
        parts = [(rows, of_pair[links], per_text)] + ([(whole_rows, whole.keys, whole.n_links)] if whole is not None else [])
        for some, all_keys, counts in parts:
            for row, end, size in zip(some.tolist(), np.cumsum(counts).tolist(), counts.tolist()):
                if size:
                    keys[row], times[row] = np.unique(all_keys[end - size : end], return_counts=True)
        return {"keys": pa.array(keys, pa.list_(pa.int64())), "times": pa.array(times, pa.list_(pa.int64()))}

    return rate
