"""Embeddings as packed bytes: checked once, cheap to move, read by numpy without copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 64


def usable(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Rows with ``width`` finite values that aren't all zero, and their values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == width)
    values = pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False)
    values = np.asarray(values, dtype=np.float32).reshape(len(at), width)
    ok = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
    return at[ok], values[ok]


def pack(values: np.ndarray) -> pa.Array:
    """Rows as bytes: in half precision where that loses nothing, else in single."""
    with np.errstate(over="ignore"):
        half = values.astype(np.float16)
    exact = (half.astype(np.float32) == values).all(axis=1)
    if exact.all():
        width = half.shape[1] * 2
        offsets = np.arange(len(values) + 1, dtype=np.int32) * width
        return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(half))])
    return pa.array([h.tobytes() if e else v.tobytes() for h, v, e in zip(half, values, exact)], pa.binary())


def unpack(column: pa.Array, width: int = WIDTH, kind: type = np.float32) -> np.ndarray:
    """Packed rows scaled to length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    out = np.empty((n, width), dtype=np.float64)
    for bytes_, dtype in ((2, np.float16), (4, np.float32)):
        mine = size == bytes_ * width
        if not mine.any():
            continue
        part = column if mine.all() else column.filter(pa.array(mine))
        _, offsets, data = part.buffers()
        first = np.frombuffer(offsets, dtype=np.int32)[part.offset]
        flat = np.frombuffer(data, dtype=np.uint8)[first : first + len(part) * bytes_ * width].view(dtype)
        out[mine] = flat.reshape(len(part), width)
    out /= np.abs(out).max(axis=1, keepdims=True) if n else 1.0  # else squares of tiny values vanish
    out /= np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    return out.astype(kind, copy=False)


def tables(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Batches joined to tables of at least ``rows`` rows but for the last."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by ``key`` as one table per value of it."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        k = batch.column(batch.schema.get_field_index(key)).dictionary_encode()
        code = k.indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            name = k.dictionary[int(code[a])].as_py()
            if held and name != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = name
    if held:
        yield pa.concat_tables(held)


def components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For each of ``n`` nodes the smallest node joined to it by the edges ``a``-``b``, on top of ``label``."""
    label = np.arange(n) if label is None else label
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        if not len(a):
            break
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label
