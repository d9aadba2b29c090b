"""Model hooks: a model is loaded once per Python worker and called in batches.

``load`` is a function without arguments that returns the model's batch call; it runs on the workers, so weights come from a path
that they reach and never travel with the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 64


def text_encoder(load: Callable[[], Callable[[Sequence[str]], np.ndarray]], batch_size: int = BATCH) -> Callable[[Column], Column]:
    """text Column to vector Column; the model maps a batch of texts to a matrix. A null text is encoded as the empty one."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        model = load()
        return lambda texts: np.asarray(model([str(t) for t in texts.reshape(-1)]), np.float64)

    udf = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return lambda text: udf(F.coalesce(text, F.lit("")))


def pair_scorer(load: Callable[[], Callable[[Sequence[str], Sequence[str]], np.ndarray]], batch_size: int = BATCH) -> Callable[[Column, Column], Column]:
    """(query, content) Columns to a score Column, for ``retrieval.model_rerank``."""

    def make() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        model = load()
        return lambda queries, contents: np.asarray(model([str(q) for q in queries.reshape(-1)], [str(c) for c in contents.reshape(-1)]), np.float64)

    udf = predict_batch_udf(make, return_type=T.DoubleType(), batch_size=batch_size)
    return lambda query, content: udf(F.coalesce(query, F.lit("")), F.coalesce(content, F.lit("")))
