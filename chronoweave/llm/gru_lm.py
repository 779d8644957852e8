"""Language-model scores of whole documents by a gated recurrent network with a class-factored output.

1. Counts: every token of the training documents is counted. The most frequent words are the
   network's vocabulary; others are one sign each time they occur, and are told apart by the
   smoothed counts. So the model gives a probability to every text.
2. Training: the driver warms the weights up on a bounded sample. Then, in each round, every token
   of every training document is trained on: each task trains from the shared weights by truncated
   backpropagation through all windows of its documents, the state carried from one window to the
   next, and the weights are averaged by their tokens, in a shuffle, so that the driver gets one set
   of weights whatever the number of tasks.
3. Scoring: documents run through the network window by window, all tokens of each, the state
   carried from one window to the next. Words of the bounded hot table are looked up in the tasks;
   the rest are joined with the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoweave.llm import wordscan
from chronoweave.session import map_batches, materialize, tidy_shuffles

U = np.uint64
HIDDEN = 32
#: Words of each class: the most frequent words are in small ones, so that most tokens need a short softmax.
SIZES = np.array([16] * 8 + [32] * 8 + [104] * 16)
CLASSES, VOCABULARY = len(SIZES), int(SIZES.sum())
STARTS = np.r_[0, np.cumsum(SIZES)]
CLASS_OF = np.repeat(np.arange(CLASSES), SIZES)
END, UNKNOWN = 0, 1
#: Steps of a window of backpropagation, rounds over all tokens of all documents.
WINDOW, ROUNDS = 32, 1
#: Documents that are trained on side by side, and the rate at which tasks learn.
BATCH, RATE = 256, 2e-3
#: Documents (of at most MOST_CHARS characters, WARM_TOKENS tokens of each) that the driver warms up on, and epochs.
WARM_DOCS, MOST_CHARS, WARM_TOKENS, WARM_EPOCHS = 1500, 20_000, 128, 4
#: Words that tasks look up without a join.
HOT_WORDS = 131_072
SMOOTH = 0.1
#: Bytes of texts whose words are found together, where nothing is sent on for each piece.
PIECE = 1 << 17
#: Documents and tokens that are scored together.
SCORE_LANES, SCORE_TOKENS = 320, 16_384
#: Outputs that are computed together: products of so many are fastest, and a core's cache holds them. Those nearer to 0 than SMALL need no greatest one taken off.
OUTPUTS, SMALL = 30_000, 80.0
#: Words that a window has more often are summed one by one, of so many tokens at once; weights that are moved together.
FEW, SOME = 16, 16_384
f32 = np.float32


def new_weights(log_unigram: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(f32)
    by_class = np.logaddexp.reduceat(log_unigram, STARTS[:-1])
    return {
        "embed": small(VOCABULARY, HIDDEN),
        "input": small(3 * HIDDEN, HIDDEN),
        "bias": np.zeros(3 * HIDDEN, f32),
        "state": small(3 * HIDDEN, HIDDEN),
        "class": small(CLASSES, HIDDEN),
        "class_bias": by_class.astype(f32),
        "word": small(VOCABULARY, HIDDEN),
        "word_bias": (log_unigram - by_class[CLASS_OF]).astype(f32),
    }


# Arrays hold features by tokens, so that gates are whole blocks and sums over features run along tokens.


_rooms: dict[str, np.ndarray] = {}


def _room(name: str, *shape: int) -> np.ndarray:
    """An array that the next call with this name uses again."""
    size = math.prod(shape)
    if name not in _rooms or len(_rooms[name]) < size or _rooms[name].dtype != f32:
        _rooms[name] = np.empty(size, f32)
    return _rooms[name][:size].reshape(shape)


def _gates(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """What each word of the vocabulary adds to the gates and the candidate (a row each), and the states' weights; halved for the gates, as a gate is 0.5 + 0.5 * tanh(half its sum)."""
    half = np.repeat(np.array([0.5, 1], f32), [2 * HIDDEN, HIDDEN])
    table = np.matmul(w["embed"], (w["input"] * half[:, None]).T, out=_room("table", VOCABULARY, 3 * HIDDEN))
    table += w["bias"] * half
    return table, w["state"] * half[:, None]


def _inputs(table: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The words' rows of the table as columns (in room that the next call uses again); whole rows are read faster than columns."""
    rows = np.take(table, words, 0, out=_room("rows", len(words), 3 * HIDDEN), mode="clip")
    gx = _room("gx", 3 * HIDDEN, len(words))
    gx[:] = rows.T
    return gx


def _step(gx: np.ndarray, h: np.ndarray, state: np.ndarray, sums: np.ndarray, n: np.ndarray, new: np.ndarray) -> None:
    """One step from states h to `new`; sums gets the gates and the states' part of the candidate, n the candidate."""
    np.matmul(state, h, out=sums)
    gates = sums[: 2 * HIDDEN]
    gates += gx[: 2 * HIDDEN]
    np.tanh(gates, out=gates)
    gates *= f32(0.5)
    gates += f32(0.5)
    np.multiply(gates[HIDDEN:], sums[2 * HIDDEN :], out=n)
    n += gx[2 * HIDDEN :]
    np.tanh(n, out=n)
    np.subtract(h, n, out=new)
    new *= gates[:HIDDEN]
    new += n


def _softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, target: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of states: exponents of the outputs (a column, in room that the next call uses again), their sum, the flat place of its target in them, and that one's log probability.

    small: no output can be so far from 0 that its exponent would leave the range of numbers.
    """
    n = len(target)
    h = _room("columns", HIDDEN, n)
    h[:] = rows.T
    x = np.matmul(weights, h, out=_room("outputs", len(weights), n))
    x += bias[:, None]
    if not small:
        x -= x.max(0)
    place = target * n + np.arange(n)
    logp = x.reshape(-1)[place]
    np.exp(x, out=x)
    total = np.ones(len(x), x.dtype) @ x
    return x, total, place, logp - np.log(total)


def _outputs(rows: np.ndarray, target: np.ndarray, w: dict) -> Iterator[tuple]:
    """States (a row each) sorted by their target, some at a time: the class's part, then each class's words: place, what _softmax() returns, weights, their rows."""
    if not len(target):
        return
    reach = max(float(rows.max()), -float(rows.min()))
    widest = [np.abs(w[name]).sum(1) * reach + np.abs(w[f"{name}_bias"]) for name in ("class", "word")]
    small, group, ends = widest[0].max() < SMALL, CLASS_OF[target], np.searchsorted(target, STARTS).tolist()
    for a in range(0, len(target), OUTPUTS // CLASSES):
        at = slice(a, min(a + OUTPUTS // CLASSES, len(target)))
        yield at, *_softmax(w["class"], w["class_bias"], rows[at], group[at], small), "class", slice(0, CLASSES)
    for c in range(CLASSES):
        if ends[c] == ends[c + 1]:
            continue
        part = slice(int(STARTS[c]), int(STARTS[c + 1]))
        small, step = widest[1][part].max() < SMALL, OUTPUTS // int(SIZES[c])
        for a in range(ends[c], ends[c + 1], step):
            at = slice(a, min(a + step, ends[c + 1]))
            yield at, *_softmax(w["word"][part], w["word_bias"][part], rows[at], target[at] - STARTS[c], small), "word", part


def log_output(h: np.ndarray, target: np.ndarray, w: dict) -> np.ndarray:
    """Natural log probability of the targets given states."""
    order = np.argsort(target.astype(np.int16), kind="stable")
    out = np.zeros(len(target), h.dtype)
    for at, _, _, _, logp, _, _ in _outputs(np.take(h.T, order, 0, mode="clip"), target[order], w):
        out[at] += logp
    back = np.empty_like(out)
    back[order] = out
    return back


def _sums_by_word(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and the sums of their rows: frequent words one by one, the others' first rows, second rows and so on together."""
    by_word = np.argsort(words, kind="stable")
    ids = words[by_word]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    counts = np.diff(np.r_[first, len(ids)])
    frequent_first = np.argsort(-counts, kind="stable")
    ids, first, counts = ids[first][frequent_first], first[frequent_first], counts[frequent_first]
    many = int((counts > FEW).sum())
    sums = np.zeros((len(ids), rows.shape[1]), rows.dtype)
    for k, (a, n) in enumerate(zip(first[:many].tolist(), counts[:many].tolist(), strict=True)):
        for i in range(a, a + n, SOME // 16):
            some = by_word[i : min(i + SOME // 16, a + n)]
            sums[k] += np.ones(len(some), rows.dtype) @ np.take(rows, some, 0, out=_room("by_word", len(some), rows.shape[1]), mode="clip")
    for n in range(int(counts[many]) if many < len(counts) else 0):
        stop = int(np.searchsorted(-counts, -n))
        sums[many:stop] += np.take(rows, by_word[first[many:stop] + n], 0, out=_room("by_word", stop - many, rows.shape[1]), mode="clip")
    return ids, sums


def gradients(x: np.ndarray, y: np.ndarray, mask: np.ndarray, h: np.ndarray, w: dict) -> tuple[dict, float, np.ndarray]:
    """Gradients of the mean loss of a window (steps x batch), the summed loss, and the last state."""
    steps, batch = x.shape
    h2 = 2 * HIDDEN
    table, state = _gates(w)
    hs, sums, ns = _room("states", steps + 1, HIDDEN, batch), _room("sums", steps, 3 * HIDDEN, batch), _room("candidates", steps, HIDDEN, batch)
    rows = _room("states by tokens", steps + 1, batch, HIDDEN)
    hs[0], rows[0] = h, h.T
    for t in range(steps):
        _step(_inputs(table, x[t]), hs[t], state, sums[t], ns[t], hs[t + 1])
        rows[t + 1] = hs[t + 1].T
    g = {k: np.zeros_like(v) for k, v in w.items()}
    # the outputs, tokens sorted by target
    target = y.reshape(-1).astype(np.int16)
    scale = mask.reshape(-1).astype(f32) / f32(max(1, int(mask.sum())))
    order = np.argsort(target, kind="stable")
    so = np.take(rows[1:].reshape(-1, HIDDEN), order, 0, out=_room("sorted", steps * batch, HIDDEN), mode="clip")
    ss, loss, dso = scale[order], 0.0, _room("dsorted", steps * batch, HIDDEN)
    counted = (ss > 0).astype(f32)
    for at, d, total, place, logp, name, part in _outputs(so, target[order].astype(np.int64), w):
        loss -= float(np.vdot(logp, counted[at]))
        d *= ss[at] / total
        d.reshape(-1)[place] -= ss[at]
        g[name][part] += d @ so[at]
        g[f"{name}_bias"][part] += d @ np.ones(d.shape[1], f32)
        if name == "class":
            np.matmul(d.T, w[name][part], out=dso[at])
        else:
            dso[at] += np.matmul(d.T, w[name][part], out=_room("part", d.shape[1], HIDDEN))
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    dh = np.take(dso, back, 0, out=so, mode="clip").reshape(steps, batch, HIDDEN)
    # back through time: to the candidate's inputs, the gates and the states' part of the candidate; the first three, by tokens, in the place of a step's sums
    back, carry = _room("back", 4 * HIDDEN, batch), np.zeros((HIDDEN, batch), f32)
    rest, d, dz, dr, dc = _room("rest", HIDDEN, batch), *(back[k : k + HIDDEN] for k in range(0, 4 * HIDDEN, HIDDEN))
    for t in range(steps - 1, -1, -1):
        z, r, c, n = sums[t, :HIDDEN], sums[t, HIDDEN:h2], sums[t, h2:], ns[t]
        d[:] = dh[t].T
        d += carry
        np.multiply(d, z, out=carry)
        d -= carry  # to the candidate, as the state is candidate + z * (last state - candidate)
        np.subtract(hs[t + 1], n, out=dz)
        dz *= d
        np.multiply(n, n, out=rest)
        np.subtract(f32(1), rest, out=rest)
        d *= rest
        np.multiply(d, r, out=dc)
        np.subtract(f32(1), r, out=rest)
        rest *= c
        np.multiply(dc, rest, out=dr)
        sums[t].reshape(batch, 3 * HIDDEN)[:] = back[: 3 * HIDDEN].T
        g["state"] += back[HIDDEN:] @ rows[t]
        carry += np.matmul(w["state"].T, back[HIDDEN:], out=rest)
    # by word: the gates' gradients of its places, then of its embedding
    ids, by_word = _sums_by_word(sums.reshape(-1, 3 * HIDDEN), x.reshape(-1).astype(np.int16))
    by_word = np.roll(by_word, -HIDDEN, 1)  # the candidate last
    g["bias"] = by_word.sum(0)
    g["input"] = by_word.T @ w["embed"][ids]
    g["embed"][ids] = by_word @ w["input"]
    return g, loss, hs[steps].copy()


class Adam:
    def __init__(self, w: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.v = {k: np.zeros_like(v) for k, v in w.items()}

    def step(self, w: dict, g: dict, share: float = 1.0) -> None:
        """`share` is how full the window was, so that the few tokens of a part-filled one move the weights by as little."""
        self.t += 1
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        clip = min(1.0, 1.0 / (norm + 1e-12))
        rate = share * self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        # m and v are ten and a thousand times the means; some at a time, so that a core's cache holds them
        for k in w:
            for a in range(0, w[k].size, SOME):
                m, v, x, y = (z.reshape(-1)[a : a + SOME] for z in (self.m[k], self.v[k], g[k], w[k]))
                x = np.multiply(x, f32(clip), out=_room("adam", len(x)))
                m *= f32(0.9)
                m += x
                x *= x
                v *= f32(0.999)
                v += x
                np.sqrt(v, out=x)
                x += f32(1e-8 / math.sqrt(0.001))
                np.divide(m, x, out=x)
                x *= f32(0.1 * rate / math.sqrt(0.001))
                y -= x


def train(w: dict, chunks: Iterable[list[np.ndarray]], adam: Adam) -> tuple[float, int]:
    """One pass over all tokens of chunks of sequences (targets; each begins in the state after an end). Loss and tokens.

    A lane runs through one sequence, window by window with the state carried, and then takes the next.
    """
    chunks, waiting = iter(chunks), []
    # what lanes read: an end, then a sequence; at: place of the next input; end: place after the last target
    read, at, end = np.zeros(0, np.int16), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, loss, seen = np.zeros((HIDDEN, 0), f32), 0.0, 0
    while True:
        going = np.flatnonzero(at + 1 < end)
        at, end = at[going], end[going]
        if len(going) < h.shape[1]:
            h = h[:, going]
        while len(at) < BATCH:
            if not waiting:
                chunk = next(chunks, None)
                if chunk is None:
                    break
                left = [read[a:b] for a, b in zip(at.tolist(), end.tolist(), strict=True)]
                parts = [*left, *[x for s in chunk for x in (np.zeros(1, np.int16), s)]]
                read = np.concatenate(parts).astype(np.int16) if parts else read
                sizes = np.array([len(x) for x in left], np.int64)
                end = np.cumsum(sizes)
                at = end - sizes
                stops = int(sizes.sum()) + np.cumsum(np.array([len(s) + 1 for s in chunk], np.int64))
                waiting = [(int(b) - len(s) - 1, int(b)) for s, b in zip(chunk, stops, strict=True) if len(s)][::-1]
                continue
            new = [waiting.pop() for _ in range(min(BATCH - len(at), len(waiting)))]
            at, end = (np.concatenate([old, np.array(x, np.int64)]) for old, x in zip((at, end), zip(*new, strict=True), strict=True))
            h = np.concatenate([h, np.zeros((HIDDEN, len(new)), f32)], 1)
        if not len(at):
            return loss, seen
        steps = min(WINDOW, int((end - at).max()) - 1)
        place = at + np.arange(steps)[:, None]
        mask = place + 1 < end
        place = np.minimum(place, len(read) - 2)
        g, part_loss, h = gradients(read[place].astype(np.int64), read[place + 1].astype(np.int64), mask, h, w)
        n = int(mask.sum())
        adam.step(w, g, n / (BATCH * WINDOW))
        loss, seen, at = loss + part_loss, seen + n, at + steps


class Places:
    """The place of each of some distinct 64-bit hashes, by linear probing."""

    def __init__(self, hashes: np.ndarray):
        bits = max(8, (4 * len(hashes)).bit_length())
        self.shift = U(64 - bits)
        order = np.argsort(hashes)
        slots = (hashes[order] >> self.shift).astype(np.int64)
        at = np.maximum.accumulate(slots - np.arange(len(slots))) + np.arange(len(slots))
        room = max((1 << bits), int(at[-1]) + 1 if len(at) else 0) + 1
        self.keys, self.place = np.zeros(room, U), np.full(room, -1, np.int32)
        self.keys[at], self.place[at] = hashes[order], order

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places, -1 for others."""
        slots = (h >> self.shift).astype(np.int64)
        out = self.place[slots]
        wrong = np.flatnonzero((self.keys[slots] != h) & (out >= 0))
        while len(wrong):
            slots = slots[wrong] + 1 if len(slots) == len(h) else slots + 1
            place, same = self.place[slots], self.keys[slots] == h[wrong]
            out[wrong] = np.where(same, place, -1)
            on = ~same & (place >= 0)
            wrong, slots = wrong[on], slots[on]
        return out


class Vocabulary:
    """Network ids of the most frequent words, by their hashes."""

    def __init__(self, hashes: np.ndarray):
        self.places = Places(hashes)

    def ids(self, h: np.ndarray) -> np.ndarray:
        at = self.places.find(h)
        return np.where(at >= 0, at.astype(np.int64) + 2, UNKNOWN)


def log_states(tokens: np.ndarray, first: np.ndarray, w: dict) -> np.ndarray:
    """Natural log probability of each row's tokens (network ids, the end included), rows given by offsets."""
    table, state = _gates(w)
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    out = np.zeros(len(counts))
    # rows of like lengths run side by side
    for lane in range(0, len(counts), SCORE_LANES):
        rows = order[lane : lane + SCORE_LANES]
        out[rows] = _log_lanes(tokens, first[:-1][rows], counts[rows], table, state, w)
    return out


def _log_lanes(tokens: np.ndarray, starts: np.ndarray, counts: np.ndarray, table: np.ndarray, state: np.ndarray, w: dict) -> np.ndarray:
    """log_states() of some rows, the longest first."""
    out, longest, t = np.zeros(len(counts)), int(counts[0]), 0
    h, last = np.zeros((HIDDEN, len(counts)), f32), np.full(len(counts), END)
    rows = _room("scored", SCORE_TOKENS + len(counts), HIDDEN)
    while t < longest:
        parts, n = [], 0
        while t < longest and n < SCORE_TOKENS:
            # steps until one in sixteen of the rows that go on has ended
            active = int(np.searchsorted(-counts, -t))
            steps = min(int(counts[active - 1 - active // 16]) - t, -(-(SCORE_TOKENS - n) // active))
            place = np.arange(t, t + steps)[:, None]
            valid = place < counts[:active]
            y = tokens[np.minimum(starts[:active] + place, starts[:active] + counts[:active] - 1)]
            x = np.concatenate([last[None, :active], y[:-1]])
            hs, sums, candidate = _room("states", steps + 1, HIDDEN, active), _room("sums", 3 * HIDDEN, active), _room("candidates", HIDDEN, active)
            hs[0] = h[:, :active]
            # few rows take all their inputs at once
            gx = _inputs(table, x.reshape(-1)).reshape(3 * HIDDEN, steps, active) if active <= FEW else None
            for k in range(steps):
                _step(_inputs(table, x[k]) if gx is None else gx[:, k], hs[k], state, sums, candidate, hs[k + 1])
            rows[n : n + steps * active].reshape(steps, active, HIDDEN)[:] = hs[1:].transpose(0, 2, 1)
            parts.append((n, y, valid))
            h, last, n, t = hs[steps].copy(), y[-1], n + steps * active, t + steps
        logs = log_output(rows[:n].T, np.concatenate([y.reshape(-1) for _, y, _ in parts]), w)
        for at, y, valid in parts:
            out[: y.shape[1]] += np.where(valid, logs[at : at + y.size].reshape(y.shape), 0).sum(0, dtype=np.float64)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of a task and their counts."""

    def merged(kept):
        h, n = (np.concatenate(x) for x in zip(*kept, strict=True))
        keys, inverse = np.unique(h, return_inverse=True)
        return keys, np.bincount(inverse, n, len(keys)).astype(np.int64)

    kept, held = [], 0
    for batch in batches:
        for _, _, words in wordscan.scan(batch.column(1), True, PIECE):
            kept.append(np.unique(words.hash, return_counts=True))
            held += len(kept[-1][0])
            if held > 1 << 22:
                kept = [merged(kept)]
                held = 0
                if len(kept[0][0]) > 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(kept[0][0].view(np.int64)), pa.array(kept[0][1])], names=["h", "n"])
                    kept = []
    if kept:
        h, n = merged(kept)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])


def _sequences(column: pa.Array, vocabulary: Vocabulary, most: int | None, draws: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Network ids of each row with its end; of `most` tokens at a drawn place, if given."""
    row = 0
    for i, j, words in wordscan.scan(column, True, PIECE):
        # every row's end goes behind its words
        tokens = np.insert(vocabulary.ids(words.hash).astype(np.int16), words.first[1:], END)
        edges = (words.first + np.arange(j - i + 1)).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if most and b - a > most:
                a += int(draws[row]) % (b - a - most + 1)
                b = a + most
            row += 1
            yield tokens[a:b]


def _long_first(sequences: Iterable[np.ndarray]) -> list[np.ndarray]:
    """Sequences over four times the mean length before the others, so that few lanes are left alone with one at the end."""
    sequences = list(sequences)
    limit = 4 * sum(map(len, sequences)) / max(1, len(sequences))
    return sorted(sequences, key=lambda s: len(s) <= limit)


def _local(shared, rate: float):
    """Weights that a task trains from the shared ones: rows of (place, weight times tokens), and the tokens at place -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, vocabulary = shared.value
        w = {k: v.copy() for k, v in w.items()}
        whole = (_long_first(_sequences(batch.column(0), vocabulary, None)) for batch in batches)
        seen = train(w, whole, Adam(w, rate))[1]
        if seen:
            flat = np.concatenate([w[k].reshape(-1) for k in sorted(w)]).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, len(flat), dtype=np.int32)), pa.array(np.r_[float(seen), flat])], names=["at", "x"]
            )

    return run


def _by_row(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """The order by row, of which there are n, then by hash."""
    order = np.argsort(hashes)
    return order[np.argsort(rows[order].astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")]


def _scored(shared):
    """Per row: tokens, hot tokens, base score of hot tokens and of the vocabulary's, network's log10, unknown tokens, rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hot_words, hot_logs, end_log, vocabulary_logs = shared.value
        for batch in batches:
            tokens, firsts, base, parts = [], [np.zeros(1, np.int64)], 0, []
            for _, _, words in wordscan.scan(batch.column(1), True):
                n = len(words.counts)
                rows = words.rows()
                at = hot_words.find(words.hash)
                hot = at >= 0
                # hot words are in the order of their counts, and the vocabulary is the first of them
                ids = np.where(hot & (at < VOCABULARY - 2), at.astype(np.int64) + 2, UNKNOWN)
                known = np.bincount(rows[hot], minlength=n)
                base_hot = np.bincount(rows[hot], hot_logs[at[hot]], n)
                base_in = np.bincount(rows, vocabulary_logs[ids], n) + end_log
                unknown = np.bincount(rows[ids == UNKNOWN], minlength=n)
                rare_rows, rare = rows[~hot], words.hash[~hot]
                order = _by_row(rare_rows, rare, n)
                rare_rows, rare = rare_rows[order], rare[order]
                new = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (rare_rows[1:] != rare_rows[:-1])]) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.r_[new, len(rare)])
                ends = np.searchsorted(rare_rows[new], np.arange(n + 1)).astype(np.int32)
                parts.append((words.counts + 1, known, base_hot, base_in, unknown, ends, rare[new].view(np.int64), times))
                # every row's end goes behind its words
                tokens.append(np.insert(ids, words.first[1:], END))
                firsts.append(words.first[1:] + np.arange(1, n + 1) + base)
                base += len(ids) + n
            if not parts:
                continue
            logs = log_states(np.concatenate(tokens), np.concatenate(firsts), w) / np.log(10)
            done = 0
            for n_tokens, known, base_hot, base_in, unknown, ends, rare, times in parts:
                k = len(n_tokens)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, k),
                        pa.array(n_tokens.astype(np.int64)),
                        pa.array(known.astype(np.int64)),
                        pa.array(base_hot),
                        pa.array(base_in),
                        pa.array(logs[done : done + k]),
                        pa.array(unknown.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(rare)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int64))),
                    ],
                    names=["doc_id", "n_tokens", "known", "base_hot", "base_in", "net", "unknown", "rare", "times"],
                )
                done += k

    return run


SCORED = (
    "doc_id bigint, n_tokens bigint, known bigint, base_hot double, base_in double, net double, unknown bigint,"
    " rare array<bigint>, times array<bigint>"
)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _trained(learned: DataFrame, vocabulary: Vocabulary, w: dict) -> dict:
    """Weights after the driver's warm-up and ROUNDS passes of all tasks over all tokens of learned (doc_id, text)."""
    spark = learned.sparkSession
    # the warm-up's sample: documents of the lowest draws
    short = learned.where(F.length("text").between(1, MOST_CHARS)).select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("draw"))
    share = min(1.0, WARM_DOCS / max(1, short.count()))
    sample = [r["text"] for r in sorted(short.where(F.col("draw") < int(share * (1 << 30))).collect(), key=lambda r: r["draw"])[:WARM_DOCS]]
    adam = Adam(w, 4e-3)
    for epoch in range(WARM_EPOCHS):
        draws = np.random.default_rng(epoch).integers(0, 1 << 30, len(sample))
        train(w, [list(_sequences(pa.array(sample, pa.string()), vocabulary, WARM_TOKENS, draws))], adam)
        adam.rate *= 0.7
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((w, vocabulary))
        sums = map_batches(learned.select("text"), _local(shared, RATE / (k + 1)), "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
        with tidy_shuffles(spark):
            rows = sums.collect()
        if rows:
            flat = np.empty(len(rows))
            flat[np.array([r["at"] for r in rows]) + 1] = [r["x"] for r in rows]
            flat, at = (flat[1:] / flat[0]).astype(f32), 0
            for name in sorted(w):
                w[name], at = flat[at : at + w[name].size].reshape(w[name].shape), at + w[name].size
    return w


def score_documents(docs: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    The network is trained here unless weights are given. Null text is empty: its one token is the
    end. Rows without an id are trained on. Other columns
    are passed over, repeated rows get equal scores. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    learned = base.where(~held_out())
    counts = materialize(map_batches(learned, _count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")))
    n_docs = learned.count()
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    train_tokens, distinct = (total[0] or 0) + n_docs, total[1] + (n_docs > 0)
    below = train_tokens + SMOOTH * (distinct + 1)
    log10 = lambda c: np.log10((np.asarray(c, float) + SMOOTH) / below)
    # the least count at which the words with it or more still fit the hot table
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("k")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"))
    room, least = HOT_WORDS, None
    for r in sorted(steps.collect(), key=lambda r: -r["k"]):
        room -= r["words"]
        if room < 0:
            break
        least = r["least"]
    top = counts.where(F.col("n") >= least).collect() if least else []
    hashes, n = np.array([r["h"] for r in top], np.int64).view(U), np.array([r["n"] for r in top], np.int64)
    order = np.lexsort((hashes, -n))
    words = order[: VOCABULARY - 2]
    vocabulary = Vocabulary(hashes[words])
    end_log = float(log10(n_docs))
    in_network = 10**end_log + (10 ** log10(n[words])).sum()
    rest = float(np.log10(max(1 - in_network, 1e-12)))
    unigram = np.full(VOCABULARY, 1e-9)
    unigram[END], unigram[UNKNOWN] = 10**end_log, 10**rest
    unigram[2 : 2 + len(words)] = 10 ** log10(n[words])
    w = weights or _trained(learned, vocabulary, new_weights(np.log(unigram / unigram.sum())))
    vocabulary_logs = np.zeros(VOCABULARY)
    vocabulary_logs[2 : 2 + len(words)] = log10(n[words])
    shared = spark.sparkContext.broadcast((w, Places(hashes[order]), log10(n[order]), end_log, vocabulary_logs))
    scored = materialize(map_batches(base, _scored(shared), SCORED).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    met = rare.join(counts, "h").groupBy("row").agg(
        F.sum("times").alias("rare_known"),
        F.sum(F.col("times") * F.log10((F.col("n") + SMOOTH) / F.lit(float(below)))).alias("rare_base"),
    )
    never = float(log10(0))
    left = F.col("n_tokens") - 1 - F.col("known")
    out = scored.drop("rare", "times").join(met, "row", "left").fillna(0, ["rare_known", "rare_base"])
    base_score = F.col("base_hot") + F.lit(end_log) + F.col("rare_base") + (left - F.col("rare_known")) * F.lit(never)
    out = out.withColumn("base_score", base_score)
    end_known = F.lit(1 if n_docs else 0)
    return out.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("rare_known") + end_known).alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        (F.col("net") + F.col("base_score") - F.col("base_in") - F.col("unknown") * F.lit(rest)).alias("score"),
    )
