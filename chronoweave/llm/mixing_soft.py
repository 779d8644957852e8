"""Mixing sources to target weights with soft membership.

A softmax classifier, trained on a bounded sample of the labelled table, gives each document the
posteriors of the domains. Projected-gradient least squares then finds nonnegative document rates
whose expected tokens by domain match the targets: it lessens the squared misses, each divided by the
domain's expected tokens in the corpus. In the metric in which a document weighs its tokens, the
gradient moves a document's rate by its posteriors times the divided misses. The metric is diagonal,
so cutting rates at zero is the projection, and the gradient's Lipschitz constant is one (posteriors
sum to one), so steps of one are safe. They carry momentum, which starts again when the miss grows. The only state is the steps by domain, from which each document's rate follows; each
step is one distributed sum.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chronoweave.llm import wordscan
from chronoweave.session import map_batches, materialize

U = np.uint64
BITS = 14
#: Bounds of the training sample: documents in all, and characters of one.
SAMPLE_DOCS, MOST_CHARS = 4000, 50_000
EPOCHS, RATE, DECAY = 150, 0.05, 1e-4
#: Target shares of the tokens by quality and toxicity label, and the share of all tokens to keep.
TARGETS = {"q1t0": 0.75, "q0t0": 0.17, "q1t1": 0.05, "q0t1": 0.03}
KEEP_TOKENS = 0.5
#: Most steps; the largest miss, as a share of the largest target, at which the rates fit; the share of
#: its square that PATIENCE steps have to gain, else no rates fit better.
STEPS, TOLERANCE, LEAST_GAIN, PATIENCE = 100, 1e-4, 2e-3, 8
STATS = 7


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows at a time: first row, word counts, offsets, hashed words, their weights, and dense statistics."""
    for i, j, words in wordscan.scan(column, True):
        n = j - i
        key = (words.rows() << BITS) | (words.hash >> U(64 - BITS)).astype(np.int64)
        keys, times = np.unique(key, return_counts=True)
        rows, slots = keys >> BITS, keys & ((1 << BITS) - 1)
        value = 1 + np.log(times)
        norm = np.sqrt(np.maximum(np.bincount(rows, value * value, n), 1e-12))
        offsets = np.searchsorted(rows, np.arange(n + 1))
        data = words.data
        counts = np.maximum(words.counts, 1)
        of_row = np.r_[words.start, len(data)][words.first]
        row_of = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][of_row])
        length = np.maximum(np.diff(of_row), 1)
        upper = row_of((data >= 65) & (data <= 90))
        digit = row_of((data >= 48) & (data <= 57))
        sign = row_of(np.isin(data, np.frombuffer(b"!#$%&*+=<>@^_|~", np.uint8)))
        line = row_of(data == 10)
        dense = np.stack(
            [np.log1p(words.counts), upper / length, digit / length, sign / counts, line / counts, length / counts, np.diff(offsets) / counts], 1
        )
        yield i, words.counts, offsets, slots, (value / norm[rows]).astype(np.float32), dense


class DomainClassifier:
    """Softmax regression on hashed words and dense statistics."""

    def __init__(self, texts: list[str], labels: list[str]):
        self.domains = sorted(set(labels))
        k = max(1, len(self.domains))
        self.words = np.zeros((1 << BITS, k), np.float32)
        self.mean, self.scale = np.zeros(STATS), np.ones(STATS)
        self.dense, self.bias = np.zeros((STATS, k)), np.zeros(k)
        if len(self.domains) < 2:
            return
        parts = list(features(pa.array(texts, pa.string())))
        offsets, base = [np.zeros(1, np.int64)], 0
        for p in parts:
            offsets.append(p[2][1:] + base)
            base += p[2][-1]
        offsets = np.concatenate(offsets)
        slots, values = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
        dense = np.concatenate([p[5] for p in parts])
        self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-6
        x = (dense - self.mean) / self.scale
        y = np.searchsorted(self.domains, labels)
        rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
        order = np.argsort(slots, kind="stable")
        by_slot, first = slots[order], None
        first = np.flatnonzero(np.r_[True, by_slot[1:] != by_slot[:-1]]) if len(by_slot) else np.zeros(0, np.int64)
        weights = [self.words, self.dense, self.bias]
        m = [np.zeros_like(w) for w in weights]
        v = [np.zeros_like(w) for w in weights]
        for t in range(1, EPOCHS + 1):
            p = self._posteriors(offsets, slots, values, x)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            g_words = np.zeros_like(self.words)
            if len(first):
                g_words[by_slot[first]] = np.add.reduceat(p[rows[order]] * values[order, None], first, 0)
            grads = [g_words + DECAY * self.words, x.T @ p + DECAY * self.dense, p.sum(0)]
            for k, (w, g) in enumerate(zip(weights, grads, strict=True)):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                w -= (RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(w.dtype)

    def _posteriors(self, offsets, slots, values, x) -> np.ndarray:
        n = len(offsets) - 1
        part = self.words[slots] * values[:, None]
        scores = np.zeros((n, part.shape[1]))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            scores[full] = np.add.reduceat(part, offsets[:-1][full], 0)
        scores += x @ self.dense + self.bias
        scores -= scores.max(1, keepdims=True)
        p = np.exp(scores)
        return p / p.sum(1, keepdims=True)

    def predict(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First row, word counts and posteriors, some rows at a time."""
        for i, counts, offsets, slots, values, dense in features(column):
            yield i, counts, self._posteriors(offsets, slots, values, (dense - self.mean) / self.scale)


def fit(docs: DataFrame, labels: DataFrame) -> DomainClassifier:
    """A classifier from docs (doc_id, text) and labels (doc_id, quality, toxic): SAMPLE_DOCS documents at most, by a hash of their id."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("domain"),
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("draw"),
    )
    share = min(1.0, SAMPLE_DOCS / max(1, known.count()))
    drawn = known.where(F.col("draw") < int(share * (1 << 30)))
    texts = docs.where(F.length("text").between(1, MOST_CHARS)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = drawn.join(texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))), "doc_id").collect()
    rows = sorted(rows, key=lambda r: (r["draw"], r["text"], r["domain"]))[:SAMPLE_DOCS]
    return DomainClassifier([r["text"] for r in rows], [r["domain"] for r in rows])


def _members(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            counts, posteriors = [np.zeros(0, np.int64)], [np.zeros((0, len(model.bias)))]
            for _, n, p in model.predict(batch.column(batch.num_columns - 1)):
                counts.append(n)
                posteriors.append(p)
            p = np.concatenate(posteriors)
            offsets = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(counts).astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(p.reshape(-1)))],
                names=["doc_id", "n_tokens", "posteriors"],
            )

    return run


def folded_rates(p: np.ndarray, start: float, steps: np.ndarray) -> np.ndarray:
    """Rates of documents with posteriors p after the given steps (momentum, then one number by domain), each projected onto rates of 0 or more."""
    before = w = np.full(len(p), start)
    for s in steps:
        before, w = w, np.maximum(0.0, w + s[0] * (w - before) - p @ s[1:])
    return w


def _totals(start: float, steps: np.ndarray):
    """A task's expected tokens by domain at the rates so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = np.asarray(batch.column(0)).astype(float)
            p = np.asarray(batch.column(1).flatten()).reshape(len(n), -1)
            out = (n * folded_rates(p, start, steps)) @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["at", "x"])

    return run


def _summed(rows: DataFrame, f) -> np.ndarray:
    sums = map_batches(rows, f, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    return np.array([r["x"] for r in sorted(sums, key=lambda r: r["at"])])


def _rates(start: float, steps: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            rates = folded_rates(p, start, steps) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates)], names=["doc_id", "n_tokens", "posteriors", "rate"])

    return run


def _rated(shared, place: int, start: float, steps: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates = [np.zeros(0)]
            rates += [folded_rates(p, start, steps) for _, _, p in shared.value.predict(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(rates))], names=[*batch.schema.names, "mix_rate"])

    return run


class Rates:
    """Rates of members (doc_id, n_tokens, posteriors) whose expected tokens by domain match the targets.

    residual: the largest miss as a share of the largest target. fits: whether it is under
    TOLERANCE. settled: whether it is, or steps gain nothing any more, so that no rates fit better
    (a target of a domain without tokens cannot be met).
    """

    def __init__(self, members: DataFrame, domains: list[str], targets: dict[str, float] = TARGETS, keep: float = KEEP_TOKENS):
        self.members, self.domains, k = members, domains, len(domains)
        share = np.array([targets.get(d, 0.0) for d in domains])
        total = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
        self.start, self.steps, self.residual, self.settled = keep, np.zeros((0, k + 1)), 0.0, True
        self.targets = total * keep * (share / share.sum() if share.sum() else np.full(k, 1 / k))
        if not total:
            return
        sums = members.select("n_tokens", "posteriors").where("n_tokens > 0")
        tokens = _summed(sums, _totals(1.0, self.steps))
        weights = np.divide(1.0, tokens, out=np.zeros(k), where=tokens > 0)
        squares, last, pace, self.settled = [], None, 1.0, False
        for _ in range(STEPS):
            off = _summed(sums, _totals(self.start, self.steps)) - self.targets
            squares.append(float(off @ (weights * off)))
            self.residual = float(np.abs(off).max() / max(self.targets.max(), 1.0))
            best = min(squares)
            stalled = len(squares) > PATIENCE and min(squares[:-PATIENCE]) - best < LEAST_GAIN * best and squares[-1] <= best * (1 + LEAST_GAIN)
            self.settled = self.residual < TOLERANCE or stalled
            if self.settled:
                break
            if len(squares) > 1 and squares[-1] > squares[-2]:
                pace = 1.0
            momentum, pace = (pace - 1) / (0.5 + (0.25 + pace * pace) ** 0.5), 0.5 + (0.25 + pace * pace) ** 0.5
            ahead = off if last is None else off + momentum * (off - last)
            last, self.steps = off, np.vstack([self.steps, np.r_[momentum, weights * ahead]])
        if not self.settled:
            warnings.warn(f"mixing rates miss a target by {self.residual:.1%} after {STEPS} steps", stacklevel=2)

    @property
    def fits(self) -> bool:
        return self.residual < TOLERANCE

    def rates(self) -> DataFrame:
        """doc_id, n_tokens, posteriors, rate."""
        return map_batches(self.members, _rates(self.start, self.steps), "doc_id bigint, n_tokens bigint, posteriors array<double>, rate double")


class Mix(Rates):
    """Posteriors and rates of a corpus."""

    def __init__(self, docs: DataFrame, model: DomainClassifier, targets: dict[str, float] = TARGETS, keep: float = KEEP_TOKENS):
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        members = map_batches(rows, _members(docs.sparkSession.sparkContext.broadcast(model)), "doc_id bigint, n_tokens bigint, posteriors array<double>")
        super().__init__(materialize(members), model.domains or ["all"], targets, keep)

    def rated(self, docs: DataFrame, model: DomainClassifier) -> DataFrame:
        """The rows of docs, with all their columns, and mix_rate."""
        shared = docs.sparkSession.sparkContext.broadcast(model)
        schema = T.StructType([*docs.schema.fields, T.StructField("mix_rate", T.DoubleType())])
        return map_batches(docs, _rated(shared, docs.columns.index("text"), self.start, self.steps), schema)


def copies(rate: Column) -> Column:
    """A rate rounded up or down by a hash of doc_id, so that the expectation is the rate."""
    part = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor(rate)
    return (whole + (part < rate - whole).cast("bigint")).cast("bigint")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, keep: float = KEEP_TOKENS) -> DataFrame:
    """doc_id, n_tokens, p_<domain>..., rate, copies, residual for each row of docs (doc_id, text).

    rate is the expected number of copies, 0 or more; copies rounds it up or down by a hash of
    doc_id, so that its expectation is the rate. residual, the same in all rows, is the largest miss
    of a target as a share of the largest; there is a warning where rates that fit better remain
    after STEPS steps. Null and empty texts have no tokens; their rate
    follows their posteriors and moves nothing. Without labels all documents are one domain. Rows
    without an id take part, with a null id. Repeated rows get equal results. Targets of domains
    that are not among the labels are left out, the others scaled.
    """
    model = fit(docs, labels)
    out = Mix(docs, model, targets, keep)
    return out.rates().select(
        "doc_id",
        "n_tokens",
        *[F.get("posteriors", k).alias(f"p_{d}") for k, d in enumerate(out.domains)],
        "rate",
        copies(F.col("rate")).alias("copies"),
        F.lit(float(out.residual)).alias("residual"),
    )
