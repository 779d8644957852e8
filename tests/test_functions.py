import pytest
from pyspark.sql import functions as F

from chronoweave.functions import hashing, jsontext, text, timestamps, vectors


def one(spark, values, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column(F.col("x")).alias("y")).collect()]


def test_normalize(spark):
    assert one(spark, ["  Ana\t Maria ", "NYC", "", None], text.normalize_exact) == ["ana maria", "nyc", "", None]
    assert one(spark, ["Jean-Luc", "O'Hara", "北京 Office"], text.normalize_fuzzy) == ["jean luc", "o'hara", "office"]


def test_entropy(spark):
    assert one(spark, ["nyc", "aaaaaaaa", "ana maria lopez", ""], text.has_high_entropy) == [False, False, True, False]
    assert one(spark, ["", "aa", "ab"], text.name_entropy) == [0.0, 0.0, 1.0]


def test_shingles(spark):
    assert one(spark, ["", "a", "ab", "abcd", "ab cd"], text.shingles) == [[], ["a"], [], ["abc", "bcd"], ["abc", "bcd"]]


def test_jaccard(spark):
    rows = [([], []), (["a"], []), (["a", "b"], ["b", "c"])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(text.jaccard(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [1.0, 0.0, pytest.approx(1 / 3)]


def test_minhash(spark):
    assert hashing.shingle_hash(0, "abc") == 7705568351334315143
    df = spark.createDataFrame([(["abc", "bcd"],), ([],)], "x array<string>").select(hashing.minhash_signature("x").alias("s"))
    rows = df.select("s", hashing.lsh_bands(F.col("s")).alias("b")).collect()
    assert len(rows[0]["s"]) == 32 and len(rows[0]["b"]) == 8
    assert rows[0]["s"][0] == f"{min(hashing.shingle_hash(0, s) for s in ('abc', 'bcd')):016x}"
    assert rows[1]["s"] == [] and rows[1]["b"] == []


def test_sentences(spark):
    cut = lambda c: text.truncate_at_sentence(c, 20)
    assert one(spark, ["Short.", "One two. Three four five six.", "abcdefghijklmnopqrstuvwxyz", "Exactly twenty char. More."], cut) == [
        "Short.",
        "One two.",
        "abcdefghijklmnopqrst",
        "Exactly twenty char.",
    ]
    assert one(spark, ["No end", "Is e.g. this. That", "Done."], text.sentence_end) == [None, 12, 4]
    docs = ["A kind, e.g. a dog. Second one. Third. Fourth.\n\nMore.", "  Two\n lines ", ""]
    assert one(spark, docs, text.brief_type_description) == ["A kind, e.g. a dog. Second one. Third.", "Two lines", ""]


def test_labels(spark):
    rows = [(["Entity"], ["Entity", "Place"]), (["Entity", "City"], ["Place"]), (["Entity"], ["Entity"])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(text.promoted_labels(F.col("a"), F.col("b")), text.primary_label(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(["Entity", "Place"], "Entity"), (["Entity", "City"], "City"), (["Entity"], "Entity")]


def test_indices(spark):
    rows = [([0, 7, -1], 2), ([7], 2), ([], 0), (None, 3)]
    got = spark.createDataFrame(rows, "i array<bigint>, n bigint").select(text.clamped_indices(F.col("i"), F.col("n"))).collect()
    assert [r[0] for r in got] == [[0], [0, 1], [], [0]]


def test_episodes(spark):
    rows = [(["a"], [None]), (["a", "b"], ["t", None])]
    got = spark.createDataFrame(rows, "c array<string>, t array<string>").select(text.concatenate_episodes(F.col("c"), F.col("t"))).collect()
    assert [r[0] for r in got] == ["a", "[Episode 0] (timestamp: t)\na\n\n[Episode 1] (timestamp: unknown)\nb"]


def test_times(spark):
    raw = ["2024-03-01T10:00:00Z", "2024-03-01", "2024-03-01 10:00:00+02:00", "2024-03-01T10:00", "2024", "2024-03", "soon", None, "2024-03-01T10:00:00.250"]
    got = one(spark, raw, lambda c: timestamps.iso_millis(timestamps.parse_time(c)))
    assert got == ["2024-03-01T10:00:00.000Z", "2024-03-01T00:00:00.000Z", "2024-03-01T08:00:00.000Z", "2024-03-01T10:00:00.000Z", None, None, None, None, "2024-03-01T10:00:00.250Z"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(2**-0.5) and got[1] is None
    with pytest.raises(Exception, match="shorter"):
        df.select(vectors.leading(F.col("a"), 3)).collect()


def test_replies(spark):
    assert one(spark, ['```json\n{"a": 1}\n```', ' {"a": 1} ', "```\nx\n```"], text.strip_fences) == ['{"a": 1}', '{"a": 1}', "x"]
    got = one(spark, ['{"properties": {"a": 1}}', '{"a": 2}'], lambda c: text.salvaged(c, ["a"]))
    assert got == ['{"a":1}', '{"a": 2}']
    assert one(spark, ['{"b": 1, "a": [2, 1]}'], jsontext.canonical_json) == ['{"a":[2,1],"b":1}']
    assert one(spark, ['{"b": 1, "a": "ü"}'], jsontext.spaced_json) == ['{"b": 1, "a": "ü"}']
    assert one(spark, ['[null, true, "it\'s"]'], jsontext.python_repr) == ['[None, True, "it\'s"]']
