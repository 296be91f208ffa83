"""Runs of repeating words: maximal periodic stretches, found by their Lyndon roots.

A run is a stretch of words with a smallest period q that holds at least two periods and that no neighbouring word extends.
Every run has a root of q words that is the longest Lyndon word at its place under one of two orders: that of the words, or its
reverse. The first phase of Baier's suffix sorter groups suffixes so that a group's common context is the longest Lyndon word at
each of its members; run under both orders it gives both Lyndon arrays directly. Each root is then extended to both
sides by longest common extensions, and what holds two periods is a run.

The grouping is linear in the words, but it is not needed where nothing repeats. A run of at least ``min_length`` words agrees with itself
q words on, over at least half its length, so each of its words lies in a window of ``min_length`` / 2 words that occurs
twice in the text. Stretches of such words are found with window hashes for many texts at once, and only they are grouped;
a run never leaves its stretch, and equal hashes of different windows only make a stretch longer.

Defined cases: a null or empty text has no words and no runs. Words are runs of anything but ASCII white space. Repeated rows
have their own results. A text is searched whole, whatever its length. The row itself comes along as the struct ``document``,
so further columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import WORD, text_or_empty
from leadlake.llm.lm import mixed
from leadlake.llm.words import batches_of, document_words

# Stretches whose runs a worker remembers: copies of a passage are searched once.
REMEMBERED = 20_000
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lyndon_lengths(letters: Sequence[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place.

    Suffixes begin in groups by first letter. Groups are closed from the highest down. Every suffix of the group now closed
    points to the nearest earlier one that is still open, whose context ends where the first of its pointers starts;
    that context grows by one context of the closed group for each pointer, and the suffixes whose context grew alike
    leave their group for a new one just above it.
    """
    n = len(letters)
    first: dict[int, list[int]] = {}
    for i, letter in enumerate(letters):
        first.setdefault(letter, []).append(i)
    members = [first[letter] for letter in sorted(first)]
    lower, upper = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    g = len(members) - 1
    group = [0] * n
    for k, suffixes in enumerate(members):
        for i in suffixes:
            group[i] = k
    size = [1] * n
    # Suffix i stands at i + 1; following the entries from a closed suffix leads to the nearest open one before it, or to 0.
    left = list(range(n + 1))
    while g >= 0:
        closing = [i for i in members[g] if group[i] == g]
        members[g] = []
        if closing:
            context = size[closing[0]]
            for i in closing:
                left[i + 1] = i
            pointers: dict[int, int] = {}
            for at in closing:
                while left[at] != at:
                    left[at] = at = left[left[at]]
                if at:
                    pointers[at - 1] = pointers.get(at - 1, 0) + 1
            moved: dict[tuple[int, int], list[int]] = {}
            for i, times in pointers.items():
                size[i] += times * context
                moved.setdefault((times, group[i]), []).append(i)
            # Of one group's members those that grew most stand highest, so they are set above it first.
            for times, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                new = len(members)
                suffixes = moved[times, old]
                members.append(suffixes)
                for i in suffixes:
                    group[i] = new
                lower.append(old)
                upper.append(upper[old])
                lower[upper[old]] = new
                upper[old] = new
        g = lower[g]
    return size


class Extensions:
    """Longest common extensions of places in one sequence, by comparing blocks that double and then halve."""

    def __init__(self, letters: Sequence[int]):
        self.letters, self.n = letters, len(letters)
        self.data = np.array(letters, dtype=np.uint32).tobytes()

    def right(self, i: int, j: int) -> int:
        """How many letters from ``i`` and from ``j`` > ``i`` on agree."""
        data = self.data
        return self.longest(self.n - j, lambda k, end: data[4 * (i + k) : 4 * (i + end)] == data[4 * (j + k) : 4 * (j + end)])

    def left(self, i: int, j: int) -> int:
        """How many letters up to ``i`` and up to ``j`` > ``i``, both included, agree."""
        data = self.data
        return self.longest(i + 1, lambda k, end: data[4 * (i - end + 1) : 4 * (i - k + 1)] == data[4 * (j - end + 1) : 4 * (j - k + 1)])

    @staticmethod
    def longest(room: int, equal: Callable[[int, int], bool]) -> int:
        """The largest n up to ``room`` with ``equal(0, n)``."""
        k, step = 0, 1
        while k < room:
            end = min(k + step, room)
            if not equal(k, end):
                break
            k, step = end, step * 2
        else:
            return room
        # The first difference lies in [k, end).
        while end - k > 1:
            middle = (k + end) // 2
            k, end = (middle, end) if equal(k, middle) else (k, middle)
        return k


def runs_of(letters: Sequence[int], min_length: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs with at least two periods and ``min_length`` letters."""
    extensions = Extensions(letters)
    n, found = len(letters), set()
    plain = np.array(letters, dtype=np.int64)
    for order in (letters, [-letter for letter in letters]):
        roots = np.array(lyndon_lengths(order), dtype=np.int64)
        at = np.arange(n)
        after, before = at + roots, np.maximum(at - 1, 0)
        again = (after < n) & (plain[np.minimum(after, n - 1)] == plain) | (at > 0) & (plain[before] == plain[after - 1])
        # End of the last run of each period: further roots inside it give the same run.
        ends: dict[int, int] = {}
        for i in np.flatnonzero(again).tolist():
            q = int(roots[i])
            if ends.get(q, -1) >= i + q:
                continue
            start = i - (extensions.left(i - 1, i + q - 1) if i else 0)
            end = i + q + extensions.right(i, i + q)
            if end - start >= 2 * q:
                ends[q] = end
                if end - start >= min_length:
                    found.add((start, end - start, q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def repeating_stretches(counts: np.ndarray, words: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of stretches of words in windows that occur twice in their text."""
    k = (min_length + 1) // 2
    ends = np.cumsum(counts)
    first = ends - counts
    windows = np.maximum(counts - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), windows)
    at = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    weights = mixed(np.arange(1, k + 2, dtype=np.uint64)) | np.uint64(1)
    total = text.astype(np.uint64) * weights[k]
    for j in range(k):
        total += words[at + j] * weights[j]
    order = np.argsort(total)
    same = total[order[1:]] == total[order[:-1]]
    twice = np.zeros(len(total), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + k, -1)
    inside = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
    opens, closes = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    # Stretches that touch across a border between texts part there.
    borders = first[(first > 0) & (first < len(words))]
    borders = np.unique(borders[inside[borders] & inside[borders + 1]])
    opens, closes = np.sort(np.concatenate([opens, borders])), np.sort(np.concatenate([closes, borders]))
    long = closes - opens >= min_length
    opens, closes = opens[long], closes[long]
    of = np.searchsorted(ends, opens, "right")
    return of, opens - first[of], closes - first[of]


class Searcher:
    """Runs of texts, given as UTF-8."""

    def __init__(self, min_length: int):
        self.min_length = min_length
        self.known: dict[bytes, list[tuple[int, int, int]]] = {}

    def stretch(self, words: Sequence[bytes]) -> list[tuple[int, int, int]]:
        mark = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
        if mark not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            ranks: dict[bytes, int] = {}
            self.known[mark] = runs_of([ranks.setdefault(word, len(ranks) + 1) for word in words], self.min_length)
        return self.known[mark]

    def __call__(self, texts: Sequence[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
        """(runs, text without the repetitions) of each text."""
        counts, hashes = document_words(texts)
        of, firsts, ends = repeating_stretches(counts, hashes, self.min_length)
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        for n, text in enumerate(texts):
            words, runs = text.split(), []
            for s in range(bounds[n], bounds[n + 1]):
                first = int(firsts[s])
                runs += [(first + start, length, period) for start, length, period in self.stretch(words[first : ends[s]])]
            if runs:
                dropped = np.zeros(len(words) + 1, dtype=np.int64)
                for start, length, period in runs:
                    dropped[start + period] += 1
                    dropped[start + length] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(dropped)[:-1] == 0)]
            yield runs, b" ".join(words)


def find_runs(docs: DataFrame, min_length: int = 12, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """(document, n_words, runs, collapsed_text) of every row.

    ``runs`` are (start, length, period) in words from 0, by start and period, of at least ``min_length`` words. ``collapsed_text``
    leaves out the words that any run holds after its first period; single spaces join the others. ``document`` has
    the columns ``keep``, all by default.
    """
    rows = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("document"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(min_length)
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text").cast(pa.binary())]
            for first, end in batches_of(texts):
                part = texts[first:end]
                results = list(search(part))
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in found] for found, _ in results]
                yield pa.RecordBatch.from_arrays([
                    batch.column("document").slice(first, end - first), pa.array([len(t.split()) for t in part], pa.int64()),
                    pa.array(runs, RUNS), pa.array([t.decode() for _, t in results], pa.string()),
                ], names=["document", "n_words", "runs", "collapsed_text"])

    kind = rows.schema["document"].dataType.simpleString()
    return rows.mapInArrow(run, f"document {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string")


def with_periodic_tail(text: Column, doc_id: Column) -> Column:
    """One document in ten, by the crc32 h of its id, repeats words from place a on with a period p; the other texts are as they are.

    Of n words, a = g mod n and p = 1 + floor((n - a) / (3 + g mod 8)) with g = floor(h / 10). A null id counts as the empty text.
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    g = F.floor(h / 10)

    def repeating(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))), " ")

    chosen = (F.pmod(h, F.lit(10)) == 0) & F.rlike(text, F.lit(WORD))
    # The words are bound once, as the only element of an array; inside the inner lambda they would be split anew for each.
    words = F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    return F.when(chosen, F.transform(words, repeating)[0]).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """Digest columns of :func:`find_runs`: the number of runs, the longest one, and hashes of all runs and of the collapsed text."""
    # Longest first; of ties the smallest start, then the smallest period.
    ranked = F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period")))
    best = F.array_max(ranked)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "document.*", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"), F.expr("(1000 * _best.length) div (-_best.period)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
