"""JSON and Python-literal text whose bytes matter, as Arrow UDFs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F, types as T


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Keys sorted at all depths, no blanks; arrays keep their order."""
    return text.map(lambda x: None if x is None else canonical(json.loads(x)))


@F.pandas_udf(T.StringType())
def spaced_json(text: pd.Series) -> pd.Series:
    """Keys in the order given, a blank after commas and colons, non-ASCII as it is."""
    return text.map(lambda x: None if x is None else json.dumps(json.loads(x), ensure_ascii=False))


@F.pandas_udf(T.StringType())
def python_repr(text: pd.Series) -> pd.Series:
    """The literal that Python shows for a JSON value."""
    return text.map(lambda x: None if x is None else repr(json.loads(x)))
