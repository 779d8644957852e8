"""MinHash over BLAKE2b, which Spark has no function for."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

PERMUTATIONS = 32
BAND_SIZE = 4
MIN_JACCARD = 0.9


def shingle_hash(seed: int, shingle: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{shingle}".encode(), digest_size=8).digest(), "big")


#: Distinct shingles that are hashed at once.
AT_ONCE = 1 << 16


@F.pandas_udf(T.ArrayType(T.StringType()))
def minhash_signature(sets: pd.Series) -> pd.Series:
    """For each permutation the least hash of the set, as 16 hex digits; none for an empty set. Each distinct shingle of some rows is hashed once."""
    out: list[list[str] | None] = []
    at, rows = 0, sets.tolist()
    while at < len(rows):
        known: dict[str, int] = {}
        stop = at
        while stop < len(rows) and (stop == at or len(known) < AT_ONCE):
            for s in rows[stop] if rows[stop] is not None else ():
                known.setdefault(s, len(known))
            stop += 1
        hashes = np.array([[shingle_hash(k, s) for k in range(PERMUTATIONS)] for s in known], np.uint64).reshape(-1, PERMUTATIONS)
        for row in rows[at:stop]:
            if row is None:
                out.append(None)
            else:
                out.append([f"{x:016x}" for x in hashes[[known[s] for s in row]].min(0).tolist()] if len(row) else [])
        at = stop
    return pd.Series(out, index=sets.index, dtype=object)


def lsh_bands(signature: Column) -> Column:
    """Whole bands of a signature, each one string."""
    n = F.floor(F.size(signature) / BAND_SIZE).cast("int")
    band = lambda i: F.concat_ws("-", F.slice(signature, i * BAND_SIZE + 1, BAND_SIZE))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), band)).otherwise(F.array().cast("array<string>"))
