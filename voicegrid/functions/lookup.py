"""Terms looked up in a fixed vocabulary, wholly in the JVM.

A Spark ML count model carries the vocabulary as a hash table in a broadcast;
its vectors are unwrapped to plain arrays, on which column expressions go on.
The cost of a row follows its terms, not the vocabulary.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, functions as F

from voicegrid.session import compute_once


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once in each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def constant(values: Sequence | np.ndarray, kind: str) -> Column:
    """A literal array of any length as one constant, folded when the plan is made."""
    plain = values.tolist() if isinstance(values, np.ndarray) else list(values)
    return F.from_json(F.lit(json.dumps(plain)), kind)


def count_terms(df: DataFrame, terms: Column, vocabulary: Sequence[str], use: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """Add ``name``: ``use`` of the ascending numbers and the counts of a row's known terms."""
    if not len(vocabulary):
        return df.withColumn(name, use(F.array().cast("array<int>"), F.array().cast("array<double>")))
    listed = compute_once(df, "_listed_terms", terms)
    model = CountVectorizerModel.from_vocabulary(list(vocabulary), inputCol="_listed_terms", outputCol="_term_vector")
    counted = model.transform(listed)
    cells = let(F.unwrap_udt("_term_vector"), lambda v: use(v["indices"], v["values"]))
    return compute_once(counted, name, cells).drop("_listed_terms", "_term_vector")
