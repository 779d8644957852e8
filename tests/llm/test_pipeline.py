"""Every stage of the corpus pipeline against brute force on what its predecessor kept."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from chronoweave.llm import decontam, langid_kn, mixing_soft
from chronoweave.session import materialize, table
from tests.llm.test_dedup import brute_classes

BLANKS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fewest_edits(item: str, text: str) -> int:
    """Of the whole item against any part of text, row by row of the full table."""
    t = np.frombuffer(text.encode(), np.uint8)
    row, steps = np.zeros(len(t) + 1, np.int64), np.arange(len(t) + 1)
    for i, c in enumerate(item.encode()):
        new = np.empty_like(row)
        new[0], new[1:] = i + 1, np.minimum(row[:-1] + (t != c), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def without_wide_lines(rows):
    held = {}
    key = lambda line: line.strip(BLANKS).translate(FOLD)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    gone = lambda i, line: len(key(line)) >= 20 and len(held[key(line)]) >= 3 and i < max(held[key(line)])
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x))) for i, t in rows]


@pytest.fixture(scope="module")
def stages(spark, small):
    """The output of each stage, as run() makes it, and the rows that go in."""
    docs = table(spark, small, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], small)))
    return out


def test_language_id(stages):
    models = langid_kn.fit(stages[0])
    rejected = models.predict(pa.array([t for _, t in texts(stages[0])], pa.string()))[2]
    assert sorted(texts(stages[1]), key=repr) == sorted((x for x, r in zip(texts(stages[0]), rejected, strict=True) if not r), key=repr)


def test_line_dedup(stages):
    want = without_wide_lines(texts(stages[1]))
    assert sorted(texts(stages[2])) == sorted(want) and want != texts(stages[1])
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect() if r["text"] is not None)


def test_near_dedup(stages):
    rows = texts(stages[2])
    component = brute_classes(rows, 5, 80)[1]
    want = sorted(x for x in rows if component[x[0]] == x[0])
    assert sorted(texts(stages[3])) == want and len(want) < len(rows)


def test_decontamination(stages, spark, small):
    items = [decontam.folded(np.frombuffer(r["text"].encode(), np.uint8), np.array([0, len(r["text"].encode())]))[0].tobytes().decode().strip() for r in table(spark, small, "benchmark").collect()]
    plain = lambda t: decontam.folded(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tobytes().decode()
    rows = [(i, t) for i, t in texts(stages[3])]
    # to save time, items whose words of eight letters or more have all been edited are not looked for
    long = [{w for w in x.split() if len(w) >= 8} for x in items]
    leaked = set()
    for i, t in rows:
        p = plain(t or "")
        words = set(p.split())
        for item, rare in zip(items, long, strict=True):
            if (not rare or rare & words) and fewest_edits(item, p) <= decontam.budget(len(item.encode()), decontam.EDITS):
                leaked.add(i)
                break
    assert leaked and sorted(texts(stages[4])) == sorted(x for x in rows if x[0] not in leaked)


def test_mixing(stages, spark, small):
    docs = stages[4]
    rows = stages[5].collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted(texts(docs)) and stages[5].columns[: len(docs.columns)] == docs.columns
    model = mixing_soft.fit(docs, table(spark, small, "labels"))
    column = pa.array([r["text"] for r in rows], pa.string())
    n, p = (np.concatenate([x[k] for x in model.predict(column)]) for k in (1, 2))
    share = np.array([mixing_soft.TARGETS[d] for d in model.domains])
    targets = n.sum() * mixing_soft.KEEP_TOKENS * share / share.sum()
    rates = np.array([r["mix_rate"] for r in rows])
    assert rates.min() >= 0 and np.abs((n * rates) @ p - targets).max() < 1e-3 * targets.max()
    assert all(int(r["mix_rate"]) <= r["mix_copies"] <= int(r["mix_rate"]) + 1 for r in rows)
