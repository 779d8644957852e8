"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and items are folded (A-Z to lower case, runs of blanks to one space). An item of n bytes
that occurs in a text with at most k edits shares n - q + 1 - q * k of its q-grams with it, all on
diagonals (place in text minus place in item) within k of one another. Each text's q-grams are
looked up among the items'; hits are counted in diagonal bands of two strides that overlap by one,
a stride being over k, so one band holds all of an occurrence. Bands that reach the bound are
aligned within their diagonals.

A q-gram that an item holds more than REPEATS times (rows of `=`) would meet a text of the same kind
everywhere. Its places are left out of the count and taken off the bound, which keeps the lemma.
Where that leaves no bound, the item is counted without diagonals: some stretch of the text that is
as long as an occurrence has to hold the lemma's number of the item's q-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoweave.llm import wordscan
from chronoweave.session import map_batches, materialize

U = np.uint64
Q = 10
EDITS = 0.08
#: Items of fewer folded bytes are searched without edits, and only as whole words.
EXACT_BYTES = 40
#: Places of a q-gram in an item that are counted by diagonal.
REPEATS = 4
#: Items are searched in blocks of so many bytes; a block's index, some 25 times that, is what is broadcast.
BLOCK_BYTES = 6 << 20
FILTER_BITS = 22
#: Shared q-grams that are held at once.
HITS = 1 << 19
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[wordscan.BLANK] = 32


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, row offsets, and the place of each byte before folding."""
    b = _FOLD[data]
    keep = b != 32
    keep[1:] |= b[:-1] != 32
    starts = offsets[:-1][np.diff(offsets) > 0]
    keep[starts] |= b[starts] == 32
    at = np.flatnonzero(keep)
    return b[at], np.searchsorted(at, offsets), at


def gram_hashes(b: np.ndarray, q: int = Q) -> np.ndarray:
    m = max(0, len(b) - q + 1)
    h = np.zeros(m, U)
    for j in range(q):
        h *= U(0x100000001B3)
        h += b[j : j + m]
    return wordscan.mix(h)


def budget(n: int, edits: float) -> int:
    """Edits allowed in n bytes: the share asked for, as far as the lemma still gives a bound."""
    return min(int(n * edits), (n - Q) // Q)


class ItemIndex:
    """Folded items and their q-grams; items that hold no q-gram are left out."""

    def __init__(self, items: list[tuple[int, str | None]], edits: float = EDITS):
        rows = []
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            b = np.frombuffer(folded(raw, np.array([0, len(raw)]))[0].tobytes().strip(), np.uint8)
            if len(b) >= Q:
                rows.append((item_id, b))
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.texts = [r[1] for r in rows]
        self.budgets = np.array([budget(len(b), edits) if len(b) >= EXACT_BYTES else 0 for b in self.texts], np.int32)
        self.stride = int(self.budgets.max()) + 1 if rows else 1
        self.bounds = np.zeros(len(rows), np.int32)
        self.periodic: dict[int, np.ndarray] = {}
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, (_, b) in enumerate(rows):
            grams = gram_hashes(b)
            keys, inverse, times = np.unique(grams, return_inverse=True, return_counts=True)
            place = np.flatnonzero(times[inverse] <= REPEATS)
            self.bounds[i] = len(place) - Q * self.budgets[i]
            if self.bounds[i] < 1:
                self.periodic[i] = keys
            else:
                kept.append((grams[place], np.full(len(place), i, np.int32), place.astype(np.int32)))
        h, item, place = (np.concatenate([k[j] for k in kept]) if kept else np.zeros(0, t) for j, t in enumerate((U, np.int32, np.int32)))
        order = np.argsort(h, kind="stable")
        self.keys, first = np.unique(h[order], return_index=True)
        self.first, self.item, self.place = np.r_[first, len(h)].astype(np.int32), item[order], place[order]
        self.periodic_keys = np.unique(np.concatenate(list(self.periodic.values()))) if self.periodic else np.zeros(0, U)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        for keys in (self.keys, self.periodic_keys):
            self.filter[(keys >> U(64 - FILTER_BITS)).astype(np.int64)] = True

    def known(self, h: np.ndarray) -> np.ndarray:
        """Places of h that some item may hold."""
        return np.flatnonzero(self.filter[(h >> U(64 - FILTER_BITS)).astype(np.int64)])

    def hits(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of h, items and places in items of shared q-grams, about HITS at a time. at: known(h)."""
        if not len(self.keys):
            return
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        found = self.keys[k] == h[at]
        at, k = at[found], k[found]
        n = (self.first[k + 1] - self.first[k]).astype(np.int64)
        total = np.cumsum(n)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, "right")))
            m = n[a:b]
            inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            slot = np.repeat(self.first[k[a:b]].astype(np.int64), m) + inner
            yield np.repeat(at[a:b], m), self.item[slot], self.place[slot]
            a = b


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int, fixed: bool = False) -> tuple[int, int]:
    """Fewest edits of the whole item against a part of text on diagonals low..high, and the part's end.

    The part begins anywhere on these diagonals, or where text does if fixed. The search ends, with
    most + 1, once each diagonal has more than `most` edits. Bytes 0 around text fit nothing, so
    they cost what leaving out the item's bytes does.
    """
    width = high - low + 1
    steps = np.arange(width)
    before, after = max(0, -low), max(0, high + len(item) - len(text))
    padded = np.r_[np.zeros(before, np.uint8), text, np.zeros(after, np.uint8)][low + before :]
    row = np.abs(low + steps) if fixed else np.zeros(width, np.int64)
    for i, c in enumerate(item.tolist()):
        new = row + (padded[i : i + width] != c)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])  # an item byte without text
        row = np.minimum.accumulate(new - steps) + steps  # text bytes without item
        if not i & 7 and row.min() > most:
            return most + 1, 0
    best = int(row.argmin())
    return int(row[best]), min(max(low + len(item) + best, 0), len(text))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int]:
    """Edits, start and end in text of the best occurrence that begins on diagonals low..high; over `most` edits: most + 1, 0, 0."""
    edits, end = banded(item, text, low, high, most)
    if edits > most:
        return most + 1, 0, 0
    # the start is the end of the reversed item in the reversed text before this end
    back = text[max(0, end - len(item) - edits) : end][::-1]
    _, span = banded(item[::-1], back, -edits, edits, edits, fixed=True)
    return edits, end - span, end


def _counted(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    keys, n = (np.concatenate(x) for x in zip(*pairs, strict=True))
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, np.bincount(inverse, n, len(keys)).astype(np.int64)


def _by_diagonal(index: ItemIndex, h: np.ndarray, known: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """Row, item, shared q-grams, first and last diagonal of bands that reach the bound; bands that follow one another are one."""
    longest = max(map(len, index.texts))
    low = -(longest // index.stride) - 2
    span = int(np.diff(at).max()) // index.stride + 4 - low
    kept, held = [], 0
    for place, item, inner in index.hits(h, known):
        rows = np.searchsorted(at, place, "right") - 1
        fits = place + Q <= at[rows + 1]
        rows, item, diagonal = rows[fits], item[fits], (place - at[rows])[fits] - inner[fits]
        key = (rows * len(index.texts) + item) * span + np.floor_divide(diagonal, index.stride) - low
        # a hit counts in the band that begins with its stride and in the one before
        kept.append(np.unique(np.r_[key, key - 1], return_counts=True))
        held += len(kept[-1][0])
        if held > 4 * HITS:
            kept = [_counted(kept)]
            held = 0
    if not kept:
        return
    key, counts = _counted(kept)
    enough = counts >= index.bounds[key // span % len(index.texts)]
    key, counts = key[enough], counts[enough]
    apart = np.flatnonzero(np.r_[True, (np.diff(key // span) != 0) | (np.diff(key) > 1)]) if len(key) else key
    for first, last in zip(apart.tolist(), [*(apart[1:] - 1).tolist(), len(key) - 1], strict=False):
        pair, most = int(key[first] // span), int(index.budgets[int(key[first] // span % len(index.texts))])
        bands = [int(key[x] % span) + low for x in (first, last)]
        yield pair // len(index.texts), pair % len(index.texts), int(counts[first : last + 1].max()), bands[0] * index.stride - most, (bands[1] + 2) * index.stride + most


def _periodic(index: ItemIndex, h: np.ndarray, known: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """As _by_diagonal() for periodic items: stretches of an occurrence's length that hold enough of the item's q-grams."""
    if not index.periodic:
        return
    known = known[np.isin(h[known], index.periodic_keys)]
    rows = np.searchsorted(at, known, "right") - 1
    inside = known + Q <= at[rows + 1]
    known, rows = known[inside], rows[inside]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else rows
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=False):
        r = int(rows[a])
        for i, keys in index.periodic.items():
            n, most = len(index.texts[i]), int(index.budgets[i])
            bound = max(1, n - Q + 1 - Q * most)
            place = known[a:b][np.isin(h[known[a:b]], keys)] - at[r]
            if len(place) < bound:
                continue
            first = place[: len(place) - bound + 1]
            dense = np.flatnonzero(place[bound - 1 :] - first <= n + most - Q)
            if not len(dense):
                continue
            # stretches that touch are one
            low, high = first[dense] - n - most, place[bound - 1 :][dense] + most
            cut = np.flatnonzero(np.r_[True, low[1:] > np.maximum.accumulate(high)[:-1]])
            for x, y in zip(cut.tolist(), [*(cut[1:] - 1).tolist(), len(low) - 1], strict=True):
                yield r, i, bound, int(low[x]), int(high[y])


def _wordish(byte: int) -> bool:
    return byte >= 0x80 or chr(byte).isalnum()


def _as_words(item: np.ndarray, text: np.ndarray) -> int:
    """The first place at which item stands in text and no letter or digit goes on at its ends; -1 if there is none."""
    t, i = text.tobytes(), item.tobytes()
    at = t.find(i)
    while at >= 0:
        end = at + len(i)
        if not (at and _wordish(t[at - 1]) and _wordish(i[0])) and not (end < len(t) and _wordish(t[end]) and _wordish(i[-1])):
            return at
        at = t.find(i, at + 1)
    return -1


def find(index: ItemIndex, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Row, item, shared q-grams, edits, start and end (bytes of the row) of each item's best occurrence."""
    b, at, origin = folded(data, offsets)
    if not index.texts or len(b) < Q:
        return
    h = gram_hashes(b)
    known = index.known(h)
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for finder in (_by_diagonal, _periodic):
        for r, i, shared, low, high in finder(index, h, known, at):
            text, item, most = b[at[r] : at[r + 1]], index.texts[i], int(index.budgets[i])
            if best.get((r, i), (1,))[0] == 0:
                continue
            left = max(0, low)
            part = text[left : max(0, high + len(item) + most)]
            if len(item) < EXACT_BYTES:
                start = _as_words(item, text)
                edits, end, left = (0, start + len(item), 0) if start >= 0 else (1, 0, 0)
            elif (start := part.tobytes().find(item.tobytes())) >= 0:
                edits, end = 0, start + len(item)
            else:
                edits, start, end = align(item, part, low - left, high - left, most)
            if edits <= most:
                found = (edits, left + start, left + end, shared)
                if (r, i) not in best or found < best[r, i]:
                    best[r, i] = found
    for (r, i), (edits, start, end, shared) in sorted(best.items()):
        where = origin[at[r] : at[r + 1]] - offsets[r]
        yield r, i, shared, edits, int(where[start]), int(where[end - 1]) + 1


FOUND = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int64()), ("edits", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())]
)
FOUND_DDL = "doc_id bigint, item_id bigint, shared bigint, edits bigint, start_byte bigint, end_byte bigint"


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids = batch.column(0)
            data, offsets = wordscan.column_bytes(batch.column(1))
            rows = []
            for i, j in wordscan.pieces(offsets, 1 << 20):
                for r, item, grams, edits, start, end in find(index, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    rows.append((ids[i + r].as_py(), int(index.ids[item]), grams, edits, start, end))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), FOUND, strict=True)], schema=FOUND)

    return run


def _indexes(benchmark: DataFrame, edits: float) -> tuple[int, Iterator[ItemIndex]]:
    """The number of blocks of the benchmark's items, and their indexes, one after the other."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1

    def each() -> Iterator[ItemIndex]:
        for k in range(blocks):
            block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
            yield ItemIndex([(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").collect()], edits)

    return blocks, each()


def _keep(shared, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = wordscan.column_bytes(batch.column(place))
            clean = np.ones(batch.num_rows, bool)
            for i, j in wordscan.pieces(offsets, 1 << 20):
                for r, *_ in find(shared.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    clean[i + r] = False
            yield batch.filter(pa.array(clean))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of docs, with all their columns, in which leaks() finds no item. Null and empty texts stay."""
    blocks, indexes = _indexes(benchmark, edits)
    for index in indexes:
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = map_batches(docs, _keep(shared, docs.columns.index("text")), docs.schema)
        if blocks > 1:  # one index in a task at a time
            docs = materialize(docs)
            shared.destroy()
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, shared, edits, start_byte, end_byte: the best occurrence of each item in each document.

    docs: doc_id, text; benchmark: item_id, text; other columns are passed over. Whole texts are
    searched against all items that hold a q-gram (Q folded bytes or more), in blocks of BLOCK_BYTES
    so that what is broadcast is bounded. An occurrence has at most `edits` times the item's length
    in edits; items under EXACT_BYTES have to stand there without edits, as whole words. Null and
    empty texts and items find nothing; rows without an id are searched, with a null id. Repeated
    rows and repeated items each give their rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = None
    blocks, indexes = _indexes(benchmark, edits)
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)
        found = map_batches(texts, _search(shared), FOUND_DDL)
        if blocks > 1:
            found = materialize(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out
