"""Removal of repeated word windows with a count-min prefilter.

1. Documents are written in blocks of some thousand rows. Each block's windows are counted in a
   sparse sketch of two rows of counters, dealt into shards by the windows' hashes.
2. A shard's sketches are merged by summing, which never underestimates, and each block gets back
   which of its own counters reached two. Counters grow in number with the input, so what passes
   for repeated by chance stays the same share at every size, and no task holds more than a shard.
3. Windows that their block's reply calls repeated in both rows, and only they, go on. Within a
   block, each that starts in a smaller document there too is decided. The others are grouped
   exactly by a 96-bit hash to find the smallest document: a row for each block and place in its
   smallest document at most, however many documents hold the window.
4. The flagged places return to their documents, where the covered words are cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chronoweave.llm import wordscan
from chronoweave.session import delete_folder, map_batches, materialize, release, scratch_dir

U = np.uint64
#: Counters in a row for each window expected; bytes of a word, by which windows are expected.
CELLS_PER_WINDOW, WORD_BYTES = 4, 6
#: Counters of a shard, at least and at most, and how many shards a row has before they grow.
LEAST_SHARD, MOST_SHARD, SHARDS = 1 << 20, 1 << 27, 4096
#: Rows of a block at least; blocks grow so that a block has some 128 windows in each shard.
BLOCK_ROWS, SHARE = 4096, 128
#: Files' buckets that blocks are dealt to; Spark takes no more.
MOST_BUCKETS = 100_000


class Sizes:
    """Shards of each row, counters of a shard, and rows of a block for texts of so many bytes and rows."""

    def __init__(self, size: int, rows: int, shard: int | None = None, block_rows: int | None = None):
        cells = max(1, CELLS_PER_WINDOW * size // WORD_BYTES)
        self.shard = shard or min(MOST_SHARD, max(LEAST_SHARD, -(-cells // SHARDS)))
        self.shards = -(-cells // self.shard)
        row_windows = max(1, size // WORD_BYTES // max(1, rows))
        self.block_rows = block_rows or max(BLOCK_ROWS, SHARE * self.shards // row_windows)
        self.blocks = -(-rows // self.block_rows)

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        """The counter of each hash in a row, counted through its shards; the second row's shards follow the first's."""
        if row:
            h = wordscan.mix(h ^ U(0x2545F4914F6CDD1D))
        shard = ((h >> U(32)) * U(self.shards) >> U(32)) + U(row * self.shards)
        return shard * U(self.shard) + ((h & U(0xFFFFFFFF)) * U(self.shard) >> U(32))


def pack_gaps(cells: np.ndarray) -> bytes:
    """Ascending numbers as gaps of seven bits a byte, the last byte of each below 128."""
    gaps = np.diff(cells.astype(np.int64), prepend=0)
    size = 1 + sum((gaps >= 1 << 7 * k).astype(np.int64) for k in range(1, 6))
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        out[start[at] + k] = (gaps[at] >> 7 * k & 127) | np.where(size[at] > k + 1, 128, 0)
    return out.tobytes()


def unpack_gaps(packed: bytes) -> np.ndarray:
    b = np.frombuffer(packed, np.uint8)
    end = np.flatnonzero(b < 128)
    start = np.r_[0, end[:-1] + 1].astype(np.int64) if len(end) else end
    gaps = (b[start] & 127).astype(np.int64)
    for k in range(1, int((end - start).max(initial=0)) + 1):
        at = np.flatnonzero(end - start >= k)
        gaps[at] |= (b[start[at] + k] & 127).astype(np.int64) << 7 * k
    return np.cumsum(gaps)


def _sketches(sizes: Sizes, n: int):
    """A block's sketch: for each shard the counters touched, and those more than once."""

    def emit(block: int, hashes: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(hashes)
        c = np.concatenate([sizes.cells(h, row) for row in (0, 1)])
        c.sort()
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
        often, c = np.diff(np.r_[first, len(c)]) > 1, c[first].astype(np.int64)
        shard = c // sizes.shard
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(c) else first
        rows = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(c)], strict=False):
            low = c[a:b] - shard[a] * sizes.shard
            rows.append((int(shard[a]), block, pack_gaps(low), pack_gaps(low[often[a:b]])))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "block", "cells", "often"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []
        for batch in batches:
            blocks = np.asarray(batch.column(0))
            for i, j, words in wordscan.scan(batch.column(1), False):
                h, rows, _ = words.grams(n)
                cut = np.flatnonzero(np.r_[True, blocks[i + 1 : j] != blocks[i : j - 1]])
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), j - i], strict=True):
                    if kept and blocks[i + a] != now:
                        yield emit(now, kept)
                        kept = []
                    now = int(blocks[i + a])
                    kept.append(h[np.searchsorted(rows, a) : np.searchsorted(rows, b)])
        if kept:
            yield emit(now, kept)

    return run


def _replies(shard: int):
    """For each block the counters of this shard that it touched and that reached two over all blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(shard, np.uint8)
        for cells, often in zip(pdf["cells"], pdf["often"], strict=True):
            at = unpack_gaps(cells)
            counts[at] = np.minimum(counts[at] + np.uint8(1), 2)
            counts[unpack_gaps(often)] = 2
        rows = []
        for block, cells in zip(pdf["block"], pdf["cells"], strict=True):
            at = unpack_gaps(cells)
            at = at[counts[at] == 2]
            if len(at):
                rows.append((int(block), int(pdf["shard"].iloc[0]), pack_gaps(at)))
        return pd.DataFrame(rows, columns=["block", "shard", "cells"])

    return run


CANDIDATES = pa.schema([("h", pa.int64()), ("tail", pa.int64()), ("doc_id", pa.int64()), ("decided", pa.bool_())])


def _candidates(sizes: Sizes, n: int):
    """h, second hash and place in one number, doc_id, and whether a smaller document of the block holds the window too."""

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows or not replies.num_rows:
            return CANDIDATES.empty_table()
        # a block that two tasks sketched has two replies of a shard
        parts = zip(replies.column("shard").to_pylist(), replies.column("cells").to_pylist(), strict=True)
        seen = np.concatenate([unpack_gaps(cells) + shard * sizes.shard for shard, cells in parts]).view(U)
        del replies, parts
        seen.sort()
        kept = []
        ids, column = np.asarray(texts.column("doc_id").combine_chunks()), texts.column("text").combine_chunks()
        for i, _, words in wordscan.scan(column, False):
            h, rows, place = words.grams(n)
            found = np.arange(len(h))
            for row in (0, 1):
                cells = sizes.cells(h[found], row)
                at = np.searchsorted(seen, cells)
                at[at == len(seen)] = 0
                found = found[seen[at] == cells]
            second = words.grams(n, salt=1)[0][found] if len(found) else h[:0]
            kept.append((h[found], (second >> U(32)).astype(np.uint32), ids[rows[found] + i], place[found].astype(np.uint32)))
        del seen, texts, column
        h, second, doc, place = (np.concatenate(x) for x in zip(*kept, strict=True))
        del kept
        order = np.lexsort((doc, second, h))
        same = (h[order[1:]] == h[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
        first = np.flatnonzero(np.r_[True, ~same]) if len(h) else np.zeros(0, np.int64)
        decided = np.empty(len(h), bool)
        decided[order] = doc[order] > np.repeat(doc[order[first]], np.diff(np.r_[first, len(h)]))
        del order, same, first
        tail = second.astype(U) << U(32) | place
        del second, place
        # in the order of the texts, in which neighbours compress well; decided rows need no hash
        h[decided], tail[decided] = 0, tail[decided] & U(0xFFFFFFFF)
        return pa.table([pa.array(h.view(np.int64)), pa.array(tail.view(np.int64)), pa.array(doc, pa.int64()), pa.array(decided)], schema=CANDIDATES)

    return run


def repeated_places(docs: DataFrame, n: int = 13, shard: int | None = None, block_rows: int | None = None) -> DataFrame:
    """doc_id, drops: sorted places (word numbers from 0) of windows that start in a smaller doc_id too."""
    flagged, close = flagged_windows(docs, n, shard, block_rows)
    drops = materialize(flagged.groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias("drops")))
    close()
    return drops


def flagged_windows(docs: DataFrame, n: int, shard: int | None, block_rows: int | None):
    """doc_id and place of windows that start in a smaller document too, and a function that deletes what they are read from."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    size, rows = base.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    sizes = Sizes(size or 0, rows, shard, block_rows)
    at = F.monotonically_increasing_id()  # the partition's number over 33 bits of the row's
    block = F.shiftright(at, 33) * F.lit(1 << 33) + F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / sizes.block_rows)
    # bucketed by block, so that the reply meets its texts without dealing them again
    buckets = max(1, min(sizes.blocks, MOST_BUCKETS))
    name = f"window_blocks_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    base.withColumn("block", block.cast("bigint")).write.bucketBy(buckets, "block").sortBy("block").format("parquet").option("path", path).saveAsTable(name)
    staged = spark.table(name)
    counted = map_batches(staged.select("block", "text"), _sketches(sizes, n), "shard bigint, block bigint, cells binary, often binary")
    replies = materialize(counted.groupBy("shard").applyInPandas(_replies(sizes.shard), "block bigint, shard bigint, cells binary"))
    found = staged.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_candidates(sizes, n), "h bigint, tail bigint, doc_id bigint, decided boolean")
    found = found.withColumn("h2", F.shiftright("tail", 32)).withColumn("place", F.col("tail").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    # decided rows need no group: dealt by document, they stay out of the window's partition
    group = Window.partitionBy("h", "h2", F.when(F.col("decided"), F.col("doc_id")))
    flagged = found.withColumn("least", F.min("doc_id").over(group)).where("decided or doc_id > least").select("doc_id", "place")

    def close() -> None:
        spark.sql(f"DROP TABLE {name}")
        delete_folder(spark, path)
        release(replies)

    return flagged, close


def _cut(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = batch.column(1), batch.column(2)
            n_words, kept_texts, removed = [], [], []
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                words = (text or "").encode().split()
                gone = 0
                if drops[k].is_valid:
                    at = np.asarray(drops[k].values)
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = at[at + n <= len(words)]
                    edge[at] += 1
                    edge[at + n] -= 1
                    keep = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                n_words.append(len(words) + gone)
                removed.append(gone)
                kept_texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_texts, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, n: int = 13, **sizes) -> DataFrame:
    """doc_id, n_words, n_removed, kept (UTF-8 bytes of the kept words, joined by one space).

    docs: doc_id and text; other columns are passed over. A window is n consecutive words; each
    word is removed that a window covers whose words also start in a document with a smaller
    doc_id. Null text has no words. Rows without an id neither lose words nor take them from
    others. doc_id is the key: repeated rows get equal results, and rows that share an id but not
    the text share the places of their windows.
    """
    drops = repeated_places(docs, n, **sizes)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(base.join(drops, "doc_id", "left"), _cut(n), "doc_id bigint, n_words bigint, n_removed bigint, kept binary")


def removal_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of remove_repeats()."""
    return remove_repeats(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB text of removal_digest() over documents.
WINDOW_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
g AS (SELECT doc_id, pos, string_agg(word, ' ') OVER f AS gram, count(*) OVER f AS n FROM w
      WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT gram, min(doc_id) AS least FROM g WHERE n = 13 GROUP BY gram HAVING min(doc_id) < max(doc_id)),
s AS (SELECT g.doc_id, pos FROM g JOIN m ON g.gram = m.gram WHERE n = 13 AND g.doc_id > m.least),
c AS (SELECT w.doc_id, w.pos, word, max(s.pos) OVER (PARTITION BY w.doc_id ORDER BY w.pos) >= w.pos - 12 AS gone
      FROM w LEFT JOIN s ON s.doc_id = w.doc_id AND s.pos = w.pos),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
        string_agg(word, ' ' ORDER BY pos) FILTER (NOT coalesce(gone, false)) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""
