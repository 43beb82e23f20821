"""Arrow array columns as matrices and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Samples of a column that are made into matrices at once.
BLOCK = 1 << 18


def grouped(columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, Callable[[np.ndarray], list[np.ndarray]]]]:
    """The rows of array columns in blocks of one length, with what makes matrices of some of them; rows with a null or an empty array are left out."""
    size = np.stack([pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in columns])
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
    start = np.cumsum(size, axis=1) - size
    for lengths in np.unique(size[:, (size > 0).all(0)], axis=1).T:
        rows = np.flatnonzero((size == lengths[:, None]).all(0))
        make = lambda own, n_of=lengths: [x[s[own][:, None] + np.arange(n)].astype(float) for x, s, n in zip(flat, start, n_of, strict=True)]
        step = max(1, BLOCK // int(lengths.max()))
        for i in range(0, len(rows), step):
            yield rows[i : i + step], make


def lists(found: dict[int, np.ndarray], n: int) -> pa.Array:
    """An array of ``n`` lists, null where nothing is found."""
    sizes = [len(found[i]) if i in found else 0 for i in range(n)]
    flat = np.concatenate([np.zeros(0), *(found[i] for i in range(n) if i in found)])
    ends = pa.array(np.cumsum([0, *sizes]).astype(np.int32), mask=np.array([*(i not in found for i in range(n)), False]))
    return pa.ListArray.from_arrays(ends, pa.array(flat))
