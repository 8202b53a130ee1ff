"""Mean pooling: numpy for the workers, and the same as a column expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def masked_mean(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of `hidden[row, position, dim]` over unmasked positions; 0 where all are masked."""
    mask = mask.astype(np.float32)
    summed = np.matmul(mask[:, None, :], hidden)[:, 0, :]
    return (summed / np.maximum(mask.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def plain_mean(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over all positions, padding included."""
    return hidden.mean(axis=1, dtype=np.float32)


POOLS = {"masked": masked_mean, "all": plain_mean}


def pool_column(hidden: Column, mask: Column | None = None) -> Column:
    """Mean of the vectors in `hidden`, an array of arrays with one vector per position.

    With `mask` only positions marked 1 count, and the divisor is at least 1.
    """
    if mask is None:
        weighted, divisor = hidden, F.size(hidden)
    else:
        weighted = F.zip_with(hidden, mask, lambda v, m: F.transform(v, lambda x: x * m))
        divisor = F.greatest(F.aggregate(mask, F.lit(0), lambda a, m: a + m), F.lit(1))
    width = F.size(F.get(hidden, F.lit(0)))
    zero = F.transform(F.sequence(F.lit(1), width), lambda i: F.lit(0.0))
    total = F.aggregate(weighted, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    return F.transform(total, lambda x: x / divisor)
