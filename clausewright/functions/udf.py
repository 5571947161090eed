"""What Spark has no expression for: compatibility folding and matching-block similarity, as Arrow-batched functions."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

#: Similarity at which a name counts as found in a line.
NAME_SIMILARITY = 0.9


def folded(t: str | None) -> str:
    return "".join(unicodedata.normalize("NFKC", t or "").split()).lower()


@F.pandas_udf(StringType())
def nfkc(t: pd.Series) -> pd.Series:
    """Compatibility forms folded, white space out, lower case; null stays."""
    return t.map(folded, na_action="ignore")


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all; null if either is."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def named_in(name: str | None, text: str | None) -> bool:
    """Whether a line of the text holds the name up to small differences."""
    want = folded(name)
    if not want:
        return False
    near = SequenceMatcher(None, "", want)
    for line in map(folded, (text or "").splitlines()):
        if line and abs(len(line) - len(want)) <= max(6, len(want) // 2):
            for a in range(max(1, len(line) - len(want) + 1)):
                near.set_seq1(line[a : a + len(want)])
                if near.real_quick_ratio() >= NAME_SIMILARITY and near.quick_ratio() >= NAME_SIMILARITY and near.ratio() >= NAME_SIMILARITY:
                    return True
    return False


@F.pandas_udf(BooleanType())
def fuzzy_in(name: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([named_in(n, t) for n, t in zip(name, text)], dtype="bool")


def register_functions(spark: SparkSession) -> None:
    """Makes the functions of this engine that are no built-ins usable in SQL."""
    for name, f in (("nfkc", nfkc), ("seq_ratio", seq_ratio), ("fuzzy_in", fuzzy_in)):
        spark.udf.register(name, f)
