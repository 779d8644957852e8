import re
import zlib

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, fold=False):
    found = WORD.findall(text or "")
    return [w.translate(UPPER) for w in found] if fold else found


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


HARD = [None, "", " ", "\n\n", "a", "A b", "one two three four five six seven eight nine ten eleven twelve thirteen", "x " * 20_000, "漢字 ümlaut\x0bnext\x0cpage\rend", "no" * 30_000]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or (id, text) pairs, with an extra column of a clashing name."""

    def build(rows, start=1):
        rows = [(r if isinstance(r, tuple) else (start + i, r)) for i, r in enumerate(rows)]
        full = [(i, t, "en", "s", len(t or ""), 7) for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, rep int").repartition(3)

    return build
