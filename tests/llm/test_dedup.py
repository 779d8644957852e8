"""Line, substring and near-duplicate operators against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import graph, line_runs, neardup_hamming, substring_dedup
from tests.llm.conftest import HARD, words

sha = lambda b: hashlib.sha256(b).hexdigest()


def sentences(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(n))


def corpus(seed, n=120):
    rng = random.Random(seed)
    passage, line = sentences(rng, 40), sentences(rng, 9)
    out = []
    for k in range(n):
        text = sentences(rng, rng.randint(1, 120))
        if k % 3 == 0:
            text = text + " " + passage + " " + sentences(rng, 5)
        if k % 4 == 0:
            text = text + "\n  " + line.upper() + "\t\n" + sentences(rng, 5)
        if k % 7 == 0 and out:
            text = rng.choice(out)
        if k % 5 == 0 and out:
            w = rng.choice(out).split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = "edit"
            text = " ".join(w)
        out.append(text)
    return out


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def brute_lines(rows):
    held = defaultdict(set)
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for i, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 20 and i is not None:
                held[key(s)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if not (i is not None and len(held[key(s)]) >= 3 and i < max(held[key(s)]))]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return sorted(out, key=repr)


def test_lines(make):
    rows = list(enumerate(corpus(1) + HARD, 1)) + [(None, corpus(1)[0]), (5, corpus(1)[4])]
    assert rows_of(line_runs.line_digest(make(rows)), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(rows)


def test_line_runs_are_levelled(spark):
    key = lambda x: bytearray(x.encode())
    runs = line_runs.LineRuns(spark, enough=3, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(key("same"), k), (key("same"), k), (key(f"own{k}"), k), (key("x"), None)], "h binary, doc_id bigint"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    stats = {bytes(r["h"]): (r["n_docs"], r["max_doc"]) for r in runs.stats().collect()}
    assert stats == {b"same": (5, 4), **{f"own{k}".encode(): (1, k) for k in range(5)}}
    # a settled key goes no further, unless a larger document holds it
    batch = spark.createDataFrame([(key("same"), 1, 3), (key("own1"), 1, 0), (key("new"), 1, 0)], "h binary, n_docs bigint, max_doc bigint")
    assert {bytes(r["h"]) for r in runs.unsettled(batch).collect()} == {b"own1", b"new"}
    assert runs.unsettled(batch.withColumn("max_doc", F.lit(9).cast("bigint"))).count() == 3
    names = [n for level in runs.levels for n in level]
    runs.close()
    assert runs.stats().count() == 0 and not any(spark.catalog.tableExists(n) for n in names)


def test_line_runs_in_any_order(spark):
    rng = random.Random(6)
    docs = [(bytearray(bytes([rng.randrange(30)])), k) for k in range(200) for _ in range(3)]
    for order in (sorted(range(200)), sorted(range(200), reverse=True), rng.sample(range(200), 200)):
        runs = line_runs.LineRuns(spark, enough=3, fanout=3)
        for at in range(0, 200, 40):
            part = set(order[at : at + 40])
            runs.add(spark.createDataFrame([d for d in docs if d[1] in part], "h binary, doc_id bigint"))
        held = defaultdict(set)
        for h, k in docs:
            held[bytes(h)].add(k)
        got = {bytes(r["h"]): (min(r["n_docs"], 3), r["max_doc"]) for r in runs.stats().collect()}
        assert got == {h: (min(len(k), 3), max(k)) for h, k in held.items()}
        runs.close()


def test_batch_joins_runs_without_dealing_them(spark):
    runs = line_runs.LineRuns(spark, enough=1, fanout=9)
    runs.add(spark.createDataFrame([(bytearray(b"a"), 1)], "h binary, doc_id bigint"))
    plan = runs.unsettled(spark.table(runs.levels[0][0]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Exchange" not in plan
    runs.close()


def brute_windows(rows, n=13):
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            if i is not None:
                g = tuple(w[k : k + n])
                least[g] = min(i, least.get(g, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and least[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha(kept.encode())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"shard": 64, "block_rows": 7}, {"shard": 1 << 12, "block_rows": 1}])
def test_windows(make, sizes):
    rows = list(enumerate(corpus(2) + HARD[:-3] + HARD[-2:], 1)) + [(None, corpus(2)[3]), (3, corpus(2)[2])]
    got = rows_of(substring_dedup.removal_digest(make(rows), **sizes), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_windows(rows)


def test_a_full_sketch_loses_nothing(make, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CELLS_PER_WINDOW", 0)  # one counter a row: all windows pass
    rows = list(enumerate(corpus(3, 60), 1))
    assert rows_of(substring_dedup.removal_digest(make(rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_windows(rows)


def test_chance_passes_stay_a_share(make, monkeypatch):
    """However many shards and blocks there are, as few windows that do not repeat pass the sketch, and all that do."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    texts = ["".join(f"{rng.randrange(10**9):09d} " for _ in range(500)) for _ in range(60)]
    shared = " ".join(texts[0].split()[:100])
    texts = [t + shared if k in (7, 50) else t for k, t in enumerate(texts)]
    shares = []
    for shard, rows in ((1 << 14, 60), (1 << 12, 60), (1 << 9, 5), (1 << 6, 1)):
        sizes = substring_dedup.Sizes(sum(map(len, texts)), 60, shard, rows)
        blocks = pa.array([k // rows for k in range(60)])
        out = list(substring_dedup._sketches(sizes, 13)(iter([pa.RecordBatch.from_arrays([blocks, pa.array(texts)], names=["block", "text"])])))
        packets = pa.Table.from_batches(out).to_pandas()
        replies = [substring_dedup._replies(sizes.shard)(g) for _, g in packets.groupby("shard")]
        found = 0
        for b in range(60 // rows):
            table = pa.table({"block": blocks, "doc_id": np.arange(60), "text": texts}).slice(b * rows, rows)
            mine = [r[r["block"] == b] for r in replies]
            mine = pa.table({"shard": [int(x) for r in mine for x in r["shard"]], "cells": pa.array([x for r in mine for x in r["cells"]], pa.binary())})
            found += substring_dedup._candidates(sizes, 13)(table, mine).num_rows
        repeated = 3 * 88
        assert found >= repeated
        shares.append((found - repeated) / (60 * 488))
    assert max(shares) < 0.2 and max(shares) < 1.3 * min(shares) + 0.02


def test_gaps():
    import numpy as np

    for cells in ([], [0], [127, 128, 255, 256, 20_000, 70_000, 2**21, 2**27 - 1, 2**33], list(range(0, 9000, 3))):
        assert substring_dedup.unpack_gaps(substring_dedup.pack_gaps(np.array(cells, np.int64))).tolist() == cells


def brute_classes(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = words(t, fold=True)
        grams = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(grams)
    ids = [i for i in sets if i is not None]
    comp = {i: i for i in ids}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                comp[max(ra, rb)] = min(ra, rb)
    return sets, {i: root(i) for i in ids}


@pytest.mark.parametrize("rounds", [0, 2])
@pytest.mark.parametrize(("size", "similarity"), [(3, 0.85), (5, 0.8)])
def test_near_duplicates(make, size, similarity, rounds, monkeypatch):
    monkeypatch.setattr(neardup_hamming, "ROUNDS", rounds)
    rows = list(enumerate(corpus(4, 150) + HARD[:7] + HARD[8:9], 1)) + [(None, corpus(4)[0]), (2, corpus(4)[1])]
    sets, comp = brute_classes(rows, size, round(similarity * 100))
    got = neardup_hamming.class_digest(make(rows), size, similarity).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == comp.get(r["doc_id"])
        assert r["n_shingles"] in [len(s) for s in sets[r["doc_id"]]]
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])


def test_rows_of_one_id_link_by_all_their_texts(make):
    rng = random.Random(9)
    a, b, c = (sentences(rng, 150).split(" ") for _ in range(3))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(c)), (5, near(c)), (5, " "), (None, " ".join(a)), (6, None)]
    got = sorted((r["doc_id"], r["component_id"]) for r in neardup_hamming.class_digest(make(rows)).where("doc_id is not null").collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 6)]


def test_chain_of_near_copies(make):
    """Neighbours are similar, ends are not: one component all the same."""
    rng = random.Random(8)
    w = sentences(rng, 200).split(" ")
    rows = []
    for k in range(30):
        w = [*w]
        w[rng.randrange(len(w))] = f"new{k}"
        rows.append(" ".join(w))
    got = neardup_hamming.class_digest(make(rows)).collect()
    assert {r["component_id"] for r in got} == {1}


@pytest.mark.parametrize("small", [0, 100_000])
def test_components(spark, small, monkeypatch):
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2001 + k) for k in range(60)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame([*edges, (7, 7), (None, 3)], "u bigint, v bigint")).collect()}
    comp = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            if u != v and comp[u] != comp[v]:
                comp[u] = comp[v] = min(comp[u], comp[v])
                changed = True
    assert got == comp


def test_empty_tables(make, spark):
    none = make([(1, "x")]).where("false")
    assert line_runs.line_digest(none).count() == 0
    assert substring_dedup.removal_digest(none).count() == 0
    assert neardup_hamming.class_digest(none).count() == 0
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_cleaned_keeps_columns(make):
    df = make(list(enumerate(corpus(6, 40), 1)) + [(99, None)])
    out = line_runs.cleaned(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.where("n_chars <> length(text)").count() == 0
    assert out.agg(F.sum(F.length("text"))).first()[0] < df.agg(F.sum(F.length("text"))).first()[0]
