"""Language identification by interpolated Kneser-Ney character models.

One model per language over letters and word breaks; each order is a sorted array of n-gram hashes
with the interpolated log probabilities, and one of context hashes with the back-off weights. A
text gets the language of lowest cross-entropy per character; it is rejected where that exceeds
what texts of the language show in a calibration part of the sample.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoweave.llm import wordscan
from chronoweave.session import map_batches

U = np.uint64
ORDER = 4
#: Bounds of the training sample: documents of a language, documents in all, characters of a document.
DOCS_PER_LANGUAGE, SAMPLE_DOCS, MOST_CHARS = 400, 80_000, 50_000
#: Characters that are looked up together.
CHUNK = 1 << 18
#: Of the sampled documents so many in ten are kept for calibration.
CALIBRATION = 3
FALSE_REJECTIONS = 0.001
#: Bits per character that are allowed over what the calibration shows.
MARGIN_BITS = 0.5
BREAK, START = 32, 2


@functools.cache
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case letter or itself if it is a mark, all else is a word break; and whether it is a mark."""
    table, marks = np.full(0x110000, BREAK, np.uint32), np.zeros(0x110000, bool)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low[0])
        elif unicodedata.category(c) in ("Mn", "Mc"):
            table[code], marks[code] = code, True
    return table, marks


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of each row without repeated breaks, and row offsets. Each row begins with a break.

    Marks (vowel signs, accents) belong to the letter before them; without one they are breaks.
    """
    codes, at = wordscan.code_points(data, offsets)
    table, marks = _folding()
    folded = np.insert(table[codes], at[:-1], BREAK)
    at = at + np.arange(len(at))
    mark = np.insert(marks[codes], (at - np.arange(len(at)))[:-1], False)
    if mark.any():
        base = np.maximum.accumulate(np.where(mark, -1, np.arange(len(folded))))  # a row begins with a break, so a base is in the row
        folded[mark & (folded[base] == BREAK)] = BREAK
    keep = folded != BREAK
    keep[1:] |= folded[:-1] != BREAK
    keep[at[:-1]] = True
    return folded[keep], np.r_[0, np.cumsum(keep)][at]


def places(offsets: np.ndarray) -> np.ndarray:
    """The place of each character in its row."""
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))


def gram_hashes(chars: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1..order the hash of the k characters that end at each position; before a row are START signs."""
    out = []
    x = chars.astype(U) + U(1)
    seen = wordscan.mix(x)
    out.append(seen)
    for k in range(1, order):
        back = np.full(len(chars), START + 1, U)
        back[k:] = x[:-k]
        back[place < k] = START + 1
        seen = wordscan.mix(seen * U(0x9E3779B97F4A7C15) + back)
        out.append(seen)
    return out


def context_hashes(chars: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0..order-1 the hash of the k characters before each position."""
    before = np.full(len(chars), START, np.uint32)
    before[1:] = chars[:-1]
    before[place == 0] = START
    # the grams that end one place before; START signs stand before a row's first place too
    return [np.full(len(chars), U(1)), *gram_hashes(before, place, order - 1)]


class CharModel:
    """Interpolated Kneser-Ney of one language in sorted hash arrays."""

    def __init__(self, chars: np.ndarray, offsets: np.ndarray, order: int = ORDER, alphabet: int = 1000):
        self.order = order
        place = places(offsets)
        grams = gram_hashes(chars, place, order)
        # a context is the gram without its last character: the hash of what ends one place before
        contexts = context_hashes(chars, place, order)
        self.keys: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []
        self.context_keys: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        lower = None
        for k in range(order):
            if k == order - 1:
                keys, first, counts = np.unique(grams[k], return_index=True, return_counts=True)
            else:  # continuation counts: how many characters stand before the gram
                _, at = np.unique(grams[k + 1], return_index=True)
                keys, first, counts = np.unique(grams[k][at], return_index=True, return_counts=True)
                first = at[first]
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = ones / (ones + 2 * twos) if ones else 0.5
            discount = float(min(max(discount, 0.1), 0.95))
            context, inverse = np.unique(contexts[k][first], return_inverse=True)
            total = np.bincount(inverse, counts, len(context))
            kinds = np.bincount(inverse, minlength=len(context))
            weight = discount * kinds / total
            below = np.full(len(keys), 1 / alphabet) if k == 0 else lower(grams[k - 1][first], first)
            p = (counts - discount) / total[inverse] + weight[inverse] * below
            self.keys.append(keys)
            self.logs.append(np.log2(p))
            self.context_keys.append(context)
            self.weights.append(np.log2(weight))
            lower = self._reader(k)
        self.floor = float(np.log2(1 / alphabet))

    def _reader(self, k: int):
        keys, logs = self.keys[k], self.logs[k]
        return lambda h, _: 2.0 ** logs[np.searchsorted(keys, h)]

    @staticmethod
    def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def log2(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """log2 probability of characters, from the hashes of their grams and contexts of all orders."""
        out = np.full(len(grams[0]), self.floor)
        at, found = self._find(self.context_keys[0], contexts[0])
        out = out + self.weights[0][at]
        for k in range(self.order):
            if k:
                at, found = self._find(self.context_keys[k], contexts[k])
                out = out + np.where(found, self.weights[k][at], 0.0)
            at, found = self._find(self.keys[k], grams[k])
            out = np.where(found, self.logs[k][at], out)
        return out


class LanguageModels:
    """Character models of some languages with rejection limits."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.names = sorted(n for n, texts in samples.items() if any(any(c.isalpha() for c in t) for t in texts))
        self.order = order
        self.models, self.limits, held = [], [], []
        for name in self.names:
            texts = [t for t in samples[name] if any(c.isalpha() for c in t)]
            fit = [t for i, t in enumerate(texts) if i % 10 >= CALIBRATION or len(texts) < 10]
            held.append([t for i, t in enumerate(texts) if i % 10 < CALIBRATION] or texts)
            self.models.append(CharModel(*letters(*wordscan.column_bytes(pa.array(fit)))))
        for k, texts in enumerate(held):
            bits, n = self.bits(pa.array(texts))
            mine = bits[:, k]
            self.limits.append(float(np.quantile(mine[n > 0], 1 - FALSE_REJECTIONS)) + MARGIN_BITS)

    def bits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each row under each language, and the number of letters and breaks.

        Looked up CHUNK characters and one language at a time, whatever the length of a text and the number of languages.
        """
        all_bits, all_n = [], []
        data, offsets = wordscan.column_bytes(column)
        for i, j in wordscan.pieces(offsets, CHUNK):
            chars, at = letters(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = np.diff(at)
            sums = np.zeros((len(self.models), j - i))
            for start in range(0, len(chars), CHUNK):
                low, stop = max(0, start - self.order), min(len(chars), start + CHUNK)  # with the characters before that grams reach
                row = np.searchsorted(at, np.arange(low, stop), "right") - 1
                part, place, skip = chars[low:stop], np.arange(low, stop) - at[row], start - low
                grams = gram_hashes(part, place, self.order)
                contexts = context_hashes(part, place, self.order)
                _, first, inverse = np.unique(grams[-1][skip:], return_index=True, return_inverse=True)
                contexts, seen = [c[skip:][first] for c in contexts], [g[skip:][first] for g in grams]
                first_row, row = int(row[skip]), row[skip:] - row[skip]
                for k, m in enumerate(self.models):
                    got = np.bincount(row, m.log2(seen, contexts)[inverse])
                    sums[k, first_row : first_row + len(got)] += got
            all_bits.append(-(sums / n).T)
            all_n.append(np.where(n > 1, n, 0))
        if not all_n:
            return np.zeros((0, len(self.names))), np.zeros(0, np.int64)
        return np.concatenate(all_bits), np.concatenate(all_n)

    def predict(self, column: pa.Array) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Language (und without letters), score, rejected, bits per character for each row."""
        bits, n = self.bits(column)
        if not self.names:
            return ["und"] * len(n), np.zeros(len(n)), np.ones(len(n), bool), np.zeros(len(n))
        best = bits.argmin(1)
        low = bits[np.arange(len(n)), best]
        scale = np.minimum(n, 64)[:, None] * np.log(2)
        weights = np.exp(-(bits - low[:, None]) * scale)
        score = np.where(n > 0, 1 / weights.sum(1), 0.0)
        # a short text's mean scatters more: six deviations of about three bits a character
        limit = np.array(self.limits)[best] + 18 / np.sqrt(np.maximum(n, 1))
        rejected = (n == 0) | (low > limit)
        names = np.array([*self.names, "und"], object)[np.where(n > 0, best, len(self.names))]
        return names.tolist(), score, rejected, np.where(n > 0, low, 0.0)


def fit(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, most: int = SAMPLE_DOCS) -> LanguageModels:
    """Models of every language in docs (doc_id, text, lang), from a bounded sample of the rows with text, lang and doc_id.

    The sample takes documents of at most MOST_CHARS characters by a hash of their id, about
    per_language of each language, fewer where there are so many languages that it would exceed
    `most` documents in all; the driver holds it. More than `most` languages are refused.
    """
    rows = docs.where("text is not null and lang is not null and doc_id is not null").where(F.length("text").between(1, MOST_CHARS))
    rows = rows.select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("draw"))
    counts = rows.groupBy("lang").count().limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} languages")
    each = min(per_language, max(1, most // max(1, len(counts))))
    sample: dict[str, list] = {r["lang"]: [] for r in counts}
    # a language's share of draws; at small counts a hash may draw none, so some more are taken and cut below
    share = {r["lang"]: int(min(1.0, (each + 6 * each**0.5 + 6) / r["count"]) * (1 << 30)) for r in counts}
    limits = docs.sparkSession.createDataFrame(list(share.items()), "lang string, upto bigint")
    for r in rows.join(F.broadcast(limits), "lang").where("draw < upto").select("lang", "text", "draw").collect():
        sample[r["lang"]].append((r["draw"], r["text"]))
    return LanguageModels({k: [t for _, t in sorted(v)[:each]] for k, v in sample.items()})


def _predict(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected, bits = models.value.predict(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected), pa.array(bits)],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected", "bits"],
            )

    return run


def identify(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """doc_id, lang_pred, score, rejected, bits for each row of docs (doc_id, text; others are passed over).

    A null text, or one without a letter, is `und`, has score 0 and is rejected. Whole texts are
    judged. Repeated rows get equal results. Without any training text all rows are `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(rows, _predict(shared), "doc_id bigint, lang_pred string, score double, rejected boolean, bits double")


def _keep(models, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~models.value.predict(batch.column(place))[2]))

    return run


def accepted(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """The rows of docs, with all their columns, whose text is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    return map_batches(docs, _keep(shared, docs.columns.index("text")), docs.schema)


def fold_of(folds: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def language_digest(docs: DataFrame) -> DataFrame:
    """identify() with held_out: the fold 2 of 4 by crc32 of the id is held out of training; a null id is not."""
    models = fit(docs.where(fold_of(4) != 2))
    out = identify(docs, models)
    return out.select("doc_id", F.coalesce(fold_of(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected", "bits")
