"""Near-duplicate classes by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is the hashes of its word shingles; its signature is 72 symbols of 16 bits, the
low bits of mixed minima under 72 permutations. Signatures are cut into chunks. If two signatures
differ in at most 2 * chunks - 1 symbols, by the pigeonhole principle some chunk differs in at most
one, so both hold an equal key among the chunk's keys with one symbol left out. Joining on these
keys therefore meets every pair under that distance; the chunks are chosen so that a pair at the
similarity threshold exceeds it with a probability below MISS. Links are confirmed on the full
sets.

Equal sets are one class from the start, and only one member of each goes on. Keys shared by
several classes are buckets. Pairs of a bucket are not all emitted: in each round a bucket compares
its members with one pivot, first the member that is in most buckets, then the one with most links;
the pivot leaves, and the bucket ends when its members are in one component. Members that stay apart, such as documents that share a common passage or heavily edited
copies, go on to a last join. It meets those that share a rare shingle; for all others the shingles
besides the rare ones bound what they can share, so most pairs are out at once, and the rest compare
along their rare symbols: of two signatures under the distance, each has an equal symbol among its
`distance + 1` rarest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chronoweave.llm import wordscan
from chronoweave.llm.graph import components
from chronoweave.session import kept, map_batches, materialize, release

U = np.uint64
SYMBOLS = 72
MISS = 1e-4
ROUNDS = 2
RARE = 8
_rng = np.random.default_rng(7)
FACTORS = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * U(2) + U(1)
SHIFTS = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def chunk_count(similarity: float) -> int:
    """The fewest chunks for which a pair at the threshold is missed with a probability below MISS."""
    p = (1 - similarity) * (1 - 2**-16)
    for chunks in range(2, SYMBOLS // 2 + 1):
        if sum(math.comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k) for k in range(2 * chunks, SYMBOLS + 1)) < MISS:
            return chunks
    raise ValueError(f"similarity {similarity} is too low for {SYMBOLS} symbols")


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some rows at a time: first row, hashes of distinct shingles (ascending in a row), offsets."""
    for i, j, words in wordscan.scan(column, True):
        h, rows, _ = words.grams(size)
        short = np.flatnonzero((words.counts > 0) & (words.counts < size))
        if len(short):
            whole = [0] * len(short)
            for k, r in enumerate(short.tolist()):
                x = 977 * int(words.counts[r])
                for w in words.hash[words.first[r] : words.first[r + 1]].tolist():
                    x = (x * 0xA0761D6478BD642F + w) % 2**64
                whole[k] = x
            h = np.concatenate([h, wordscan.mix(np.array(whole, U))])
            rows = np.concatenate([rows, short])
        # sorting by row and a few bits of hash, then within: one sort by hash, then a stable one by row
        order = np.argsort(h)
        order = order[np.argsort(rows[order], kind="stable")]
        h, rows = h[order], rows[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])] if len(h) else np.zeros(0, bool)
        h, rows = h[new], rows[new]
        yield i, h, np.searchsorted(rows, np.arange(j - i + 1))


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of SYMBOLS symbols; rows of empty sets are zero."""
    counts = np.diff(offsets)
    full = np.flatnonzero(counts)
    out = np.zeros((len(counts), SYMBOLS), np.uint16)
    if not len(full):
        return out
    starts = offsets[full]
    # a segment's end is the next one's start, as empty sets take no room
    for k in range(SYMBOLS):
        low = np.minimum.reduceat(h * FACTORS[k] + SHIFTS[k], starts)
        out[full, k] = (wordscan.mix(low) & U(0xFFFF)).astype(np.uint16)
    return out


def digests(h: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Two 64-bit sums that tell sets apart."""
    out = []
    for x in (h ^ U(0x5851F42D4C957F2D), h + U(0x14057B7EF767814F)):
        sums = np.r_[U(0), np.cumsum(wordscan.mix(x))]
        out.append(pa.array((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64)))
    return out[0], out[1]


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, h, offsets in shingle_sets(batch.column(1), size):
                n = np.diff(offsets)
                sig = signatures(h, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, len(n)),
                        pa.array(n.astype(np.int64)),
                        *digests(h, offsets),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "s1", "s2", "sig"],
                )

    return run


def _keys(chunks: int):
    """The keys of a signature: for each chunk and each of its symbols, the other symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, SYMBOLS).astype(U)
            ids = batch.column(0)
            for chunk, part in enumerate(np.array_split(sig, chunks, axis=1)):
                for out in range(part.shape[1]):
                    key = np.full(len(part), U(chunk * 64 + out + 1))
                    for k in range(part.shape[1]):
                        if k != out:
                            key = wordscan.mix(key * U(0x9E3779B97F4A7C15) + part[:, k])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids], names=["key", "rep"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each hash of a set."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
            reps = np.repeat(np.asarray(part.column(0)), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(reps)], names=["h", "rep"])


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every symbol of a signature with its place, as one number."""
    place = np.arange(SYMBOLS, dtype=np.int64) << 16
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(part.num_rows, SYMBOLS)
            ids = np.repeat(np.asarray(part.column(0)), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array((sig + place).reshape(-1)), pa.array(ids)], names=["symbol", "rep"])


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(n, -1) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a != b).sum(1).astype(np.int32))], names=["a", "b", "dist"])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, h, offsets in shingle_sets(batch.column(1), size):
                sets = [h[s:e].tobytes() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = [batch.column(0).slice(i, len(sets)), *digests(h, offsets), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["least", "s1", "s2", "hashes"])

    return run


def _confirmed(similarity: float):
    percent = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = 0
                if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


class _Links:
    """Confirmed links and the components that they make."""

    def __init__(self, reps: DataFrame, sets: DataFrame, similarity: float, most: int):
        self.reps, self.sets, self.similarity, self.most = reps.select("rep", "sig", "n_shingles"), sets, similarity, most
        self.identity = reps.select("rep", "s1", "s2")
        self.links: list[DataFrame] = []
        self.comps: DataFrame | None = None

    def join_rows_of_one_id(self, signed: DataFrame) -> DataFrame | None:
        """Link the sets of rows that share a doc_id: doc_id, rep of the ids with several sets, an empty one included; None if there is none."""
        bounds = [f(c).alias(f"{name}_{c}") for c in ("s1", "s2") for name, f in (("lo", F.min), ("hi", F.max))]
        several = signed.where("doc_id is not null").groupBy("doc_id").agg(*bounds).where("lo_s1 < hi_s1 or lo_s2 < hi_s2").select("doc_id")
        rows = signed.where("n_shingles > 0").join(several, "doc_id", "left_semi").select("doc_id", "s1", "s2").distinct()
        rows = kept(rows.join(self.identity, ["s1", "s2"]).select("doc_id", "rep"))
        if rows.isEmpty():
            return None
        first = kept(rows.groupBy("doc_id").agg(F.min("rep").alias("v")))
        self.links.append(kept(rows.join(first, "doc_id").where("rep <> v").select(F.col("rep").alias("u"), "v")))
        self.comps = kept(components(self.links[0]))
        return first.withColumnRenamed("v", "rep")

    def labelled(self, rows: DataFrame, column: str, as_: str) -> DataFrame:
        """rows with the component of a column."""
        if self.comps is None:
            return rows.withColumn(as_, F.col(column))
        comps = self.comps.select(F.col("node").alias(column), F.col("component").alias("_c"))
        return rows.join(comps, column, "left").withColumn(as_, F.coalesce("_c", column)).drop("_c")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs a, b that are under the distance."""
        sig = lambda c: self.reps.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}"))
        both = pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b")
        return map_batches(both, _distances, "a bigint, b bigint, dist int").where(F.col("dist") <= self.most).select("a", "b")

    def confirm(self, pairs: DataFrame, bounded: bool = False) -> None:
        """Test near pairs on the full sets and follow the links. Pairs that bounds on their sets left over need no distance."""
        pairs = kept(pairs if bounded else self.near(pairs))
        if pairs.isEmpty():
            return
        one = lambda c: self.sets.select(F.col("rep").alias(c), F.col("hashes").alias(f"set_{c}"))
        both = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "set_a", "set_b")
        self.links.append(kept(map_batches(both, _confirmed(self.similarity), "u bigint, v bigint")))
        self.comps = kept(components(reduce(DataFrame.unionByName, self.links)))
        release(pairs)

    def degrees(self) -> DataFrame:
        ends = reduce(DataFrame.unionByName, self.links) if self.links else None
        if ends is None:
            return None
        return ends.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))


def _leftover_pairs(links: _Links, among: DataFrame, prefix: int) -> DataFrame:
    """Pairs a, b of different components that may still be similar, in two exact cases.

    A shingle is rare if at most RARE of these documents hold it. Either a pair shares a rare
    shingle: these have few holders, and are joined. Or it shares none: then it shares at most what
    either holds besides its rare shingles, which has to be enough for the similarity, and it has
    an equal symbol among the `prefix` rarest of each; on these it is joined. Symbols are ordered
    by how many documents hold them, then by number; those that one document holds come first and
    meet nothing, so they are only counted.
    """
    percent = round(links.similarity * 100)
    sets = links.sets.join(among, "rep", "left_semi").select("rep", "hashes")
    hashes = kept(map_batches(sets, _spread, "h bigint, rep bigint"))
    holders = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("rep")).where(F.col("k") <= RARE)
    holders = kept(holders)
    few = kept(hashes.join(holders.where("k > 1").select("h"), "h"))
    count = lambda rows, name: rows.groupBy("rep").agg(F.count(F.lit(1)).alias(name))
    held = links.reps.join(among, "rep", "left_semi").join(count(holders.where("k = 1"), "_alone"), "rep", "left").join(count(few, "_few"), "rep", "left")
    able = F.col("n_shingles") - F.coalesce("_alone", F.lit(0))
    held = held.select("rep", "sig", "n_shingles", able.alias("able"), (able - F.coalesce("_few", F.lit(0))).alias("common"))
    held = kept(links.labelled(held.where(100 * F.col("able") >= percent * F.col("n_shingles")), "rep", "c"))
    release(hashes)

    def joined(rows: DataFrame, on: str, bound: str) -> DataFrame:
        """Pairs with an equal `on` among rows (on, rep, all of a rep's in order) whose bounds allow the similarity; each once, at its first."""
        # each written, so that the joins deal both sides anew and can split a frequent value's rows
        one = kept(rows.join(held.select("rep", "n_shingles", bound, "c"), "rep"))
        mixed = kept(one.groupBy(on).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(on))
        one = kept(one.join(mixed, on))
        two = one.select(on, *[F.col(x).alias(y) for x, y in (("rep", "b"), ("c", "cb"), ("n_shingles", "nb"), (bound, "other"), ("all", "all_b"))])
        most = F.least(bound, "other")
        can = 100 * most >= percent * (F.col("n_shingles") + F.col("nb") - most)
        once = F.get(F.array_intersect("all", "all_b"), 0) == F.col(on)
        return one.join(two, on).where((F.col("rep") > F.col("b")) & (F.col("c") != F.col("cb")) & can & once).select(F.col("rep").alias("a"), "b")

    wide = held.where(100 * F.col("common") >= percent * F.col("n_shingles")).select("rep", "sig")
    symbols = kept(map_batches(wide, _symbols, "symbol bigint, rep bigint"))
    # written, so that the join can split the rows of a frequent symbol
    counts = kept(symbols.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    w = Window.partitionBy("rep")
    rank = F.row_number().over(w.orderBy("n", "symbol")) + SYMBOLS - F.count(F.lit(1)).over(w)
    rare = kept(symbols.join(counts, "symbol").withColumn("rank", rank).where(F.col("rank") <= prefix).select("symbol", "rep", "n"))
    listed = rare.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "symbol"))), lambda x: x["symbol"]).alias("all"))
    rare = rare.join(listed, "rep").select("symbol", "rep", "all")
    # few holders, so few repeats: a shingle stands for itself
    few = few.withColumn("all", F.array("h"))
    return joined(few, "h", "able").unionByName(joined(rare, "symbol", "common")).distinct()


def classes(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text; others are passed over).

    A-Z are lower-cased; a set is the distinct shingles of `size` words, or with fewer words the
    whole sequence as one. Documents link from the given Jaccard similarity on, counted in whole
    percent; component_id is the smallest doc_id reachable. Null, empty or blank texts have an
    empty set and link with nothing, as do rows without an id (component_id null). Rows that share a
    doc_id are one document, linked by what any of them links with. Shingles are compared by 64-bit
    hashes.
    """
    chunks = chunk_count(similarity)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = materialize(map_batches(base, _signed(size), "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, sig binary"))
    real = signed.where("n_shingles > 0 and doc_id is not null")
    # a number for each different set
    by_set = real.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"))
    reps = kept(by_set.withColumn("rep", F.monotonically_increasing_id()))
    keys = map_batches(reps.select("rep", "sig"), _keys(chunks), "key bigint, rep bigint")
    shared = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    buckets = kept(keys.join(shared.select("key"), "key"))
    places = kept(buckets.groupBy("rep").agg(F.count(F.lit(1)).alias("places")))
    wanted = kept(reps.join(places, "rep", "left_semi").select("rep", "least", "s1", "s2"))
    # a merge join at every size: what is wanted grows with the input
    texts = base.join(wanted.select(F.col("least").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    made = map_batches(texts, _sets(size), "least bigint, s1 bigint, s2 bigint, hashes binary")
    sets = kept(made.join(wanted, ["least", "s1", "s2"]).select("rep", "hashes").dropDuplicates(["rep"]))
    links = _Links(reps, sets, similarity, 2 * chunks - 1)
    of_id = links.join_rows_of_one_id(signed)
    for k in range(ROUNDS):
        # a pivot is the member in most buckets, later with most links, then the first
        rank = links.degrees() if k else None
        rank = places.withColumnRenamed("places", "degree") if rank is None else rank
        at = buckets.join(rank, "rep", "left").fillna(0, ["degree"])
        pivots = at.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("minus"))).alias("p"))
        pivots = kept(pivots.select("key", (-F.col("p.minus")).alias("pivot")))
        pairs = buckets.join(pivots, "key").where("rep <> pivot")
        pairs = pairs.select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b")).distinct()
        links.confirm(links.labelled(links.labelled(pairs, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b"))
        left = buckets.join(pivots.select("key", F.col("pivot").alias("rep")), ["key", "rep"], "left_anti")
        left = links.labelled(left, "rep", "c")
        mixed = left.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
        before, buckets = buckets, kept(left.join(mixed, "key").select("key", "rep"))
        release(before)
        release(pivots)
        if buckets.isEmpty():
            break
    else:
        links.confirm(_leftover_pairs(links, buckets.select("rep").distinct(), 2 * chunks), bounded=True)
    # a component's smallest doc_id, then every row by its set; written, so that joins can split large groups
    labelled = links.labelled(reps.select("rep", "least", "s1", "s2"), "rep", "c")
    low = kept(labelled.groupBy("c").agg(F.min("least").alias("component_id")))
    named = kept(labelled.join(low, "c").select("rep", "s1", "s2", "component_id"))
    found = signed.select("doc_id", "n_shingles", "s1", "s2").join(named.drop("rep"), ["s1", "s2"], "left")
    component = F.coalesce("component_id", "doc_id")
    if of_id is not None:  # empty texts of an id that has others
        by_id = of_id.join(named, "rep").select("doc_id", F.col("component_id").alias("by_id"))
        found, component = found.join(by_id, "doc_id", "left"), F.coalesce("component_id", "by_id", "doc_id")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def class_digest(docs: DataFrame, size: int = 3, similarity: float = 0.85) -> DataFrame:
    """classes() with kept: whether the document is its component's smallest."""
    return classes(docs, size, similarity).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: DuckDB text of class_digest() over documents.
NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
r AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
x AS (SELECT e.* FROM e JOIN r ON e.g = r.g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
c(node, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, c.seen FROM c JOIN l ON l.a = c.node)
SELECT n.doc_id, n.n AS n_shingles, min(seen) AS component_id, min(seen) = n.doc_id AS kept
FROM n JOIN c ON c.node = n.doc_id GROUP BY n.doc_id, n.n
"""
