"""Reading vectors from Arrow list columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (positions) and float64 matrix of each dimension that occurs.

    Left out: null ids, null vectors, and vectors with a null or non-finite component.
    """
    vectors = vectors.cast(pa.large_list(pa.float64()))
    n = len(vectors)
    offsets = np.frombuffer(vectors.buffers()[1], np.int64)[vectors.offset : vectors.offset + n + 1] if n else np.zeros(1, np.int64)
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    good = vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    good &= bad[offsets[1:]] == bad[offsets[:-1]]
    size = np.diff(offsets)
    for dim in np.unique(size[good]):
        rows = np.flatnonzero(good & (size == dim))
        yield rows, values[offsets[rows][:, None] + np.arange(dim)]
