"""The per-batch arithmetic of the mixture model, on Arrow batches inside Spark tasks.

Adding up D table rows of K numbers for each data row is array work: on numpy it runs many times faster than through
higher-order SQL functions. Spark still partitions the rows, joins what is too large to broadcast, shuffles the partial
sums and keeps the model tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Numbers held at once in one intermediate array of a task.
_BLOCK_NUMBERS = 4_000_000
# Sums of joined features that a task holds before it passes some on, and the numbers in the heaviest it then keeps.
_HELD_NUMBERS = 8_000_000
_KEPT_NUMBERS = 800_000
# A (feature, value) pair fits one integer: value ids are 32-bit.
_VALUE_BITS = 32
# Feature id under which the cluster mass per data row is reported.
RECORD_MASS = -1


@dataclass(frozen=True)
class LogModel:
    """ln prior, and ln p(value | cluster) for what is broadcast.

    ``log_theta`` has one row per (feature, value) and one more of zeros for a missing cell. ``value_ids`` are the values
    that a feature has there: all of a broadcast feature's, the hot ones of a ``joined`` feature, whose other ln p arrive with
    the data rows.
    """

    log_theta: np.ndarray
    log_prior: np.ndarray
    value_ids: list[np.ndarray]
    first_row: list[int]
    joined: list[int]

    def arrays(self) -> tuple:
        """The fields as plain arrays, which any Python worker can load."""
        return self.log_theta, self.log_prior, self.value_ids, self.first_row, self.joined

    @property
    def clusters(self) -> int:
        return len(self.log_prior)

    def table_rows(self, feature: int, ids: np.ndarray) -> np.ndarray:
        """The row of ``log_theta`` for each cell; the row of zeros for a missing one and for one that is not hot."""
        known = self.value_ids[feature]
        present = ids >= 0
        place = np.searchsorted(known, ids)
        found = present & (known[np.minimum(place, len(known) - 1)] == ids) if len(known) else np.zeros(len(ids), bool)
        if feature not in self.joined:
            _fail_on_unknown(feature, ids, present & ~found)
        return np.where(found, place + self.first_row[feature], len(self.log_theta) - 1)

    def blocks(self, columns: list[pa.Array]) -> Iterator[tuple[slice, dict[int, np.ndarray], np.ndarray]]:
        """Posterior probabilities, a block of rows at a time: ``(rows, cells by feature, p)``.

        ``columns`` are the value ids of all features, then lists of the joined cells' ln p, if there are any. A block's cells
        are rows of ``log_theta`` for a broadcast feature, value ids for a joined one.
        """
        features = len(self.value_ids)
        size, step = len(columns[0]), max(1, _BLOCK_NUMBERS // self.clusters)
        for start in range(0, size, step):
            part = slice(start, min(start + step, size))
            here = [c.slice(start, part.stop - start) for c in columns]
            cells = {d: _ids(c) for d, c in enumerate(here[:features])}
            p = np.tile(self.log_prior, (part.stop - start, 1))
            if self.joined:
                _add_lists(p, here[features])
            for d in range(features):
                rows = self.table_rows(d, cells[d])
                p += self.log_theta[rows]
                if d not in self.joined:
                    cells[d] = rows
            p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(axis=1, keepdims=True)
            yield part, cells, p


def _add_lists(p: np.ndarray, lists: pa.Array) -> None:
    """Add to each row of ``p`` all vectors in its list; a missing list has none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(p)), sizes)
    if len(row):
        found = lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(row), -1)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        p[row[starts]] += np.add.reduceat(found, starts, axis=0)


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _fail_on_unknown(feature: int, ids: np.ndarray, unknown: np.ndarray) -> None:
    if unknown.any():
        raise ValueError(f"value id {ids[unknown][0]} of feature {feature} is not in the model")


def _add_by_key(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[starts], np.add.reduceat(n[order], starts, axis=0)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, sums = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    return _add_by_key(keys, sums) if len(keys) else (keys, sums)


def partial_statistics(
    model: LogModel, batches: Iterator[pa.RecordBatch], hard: bool
) -> Iterator[pa.RecordBatch]:
    """Weighted cluster mass per (feature, value) over one task's rows; the last column is the row weight.

    The sums of broadcast features stay within the size of the model. Those of joined features may outgrow a task: then
    all but the heaviest are passed on, so that even a value found in most rows leaves the task only once.
    """
    totals = np.zeros_like(model.log_theta)
    mass = np.zeros_like(model.log_prior)
    joined = model.joined
    held, numbers = [(np.empty(0, np.int64), np.empty((0, model.clusters)))], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        weight = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(float)
        for part, cells, p in model.blocks(batch.columns[:-1]):
            if hard:
                best = p.argmax(axis=1)
                p = np.zeros_like(p)
                p[np.arange(len(p)), best] = 1.0
            p *= weight[part, None]
            mass += p.sum(axis=0)
            for d, cell in cells.items():
                if d not in joined:
                    hit, n = _add_by_key(cell, p)
                    totals[hit] += n
                elif (present := cell >= 0).any():
                    held.append(_add_by_key((d << _VALUE_BITS) + cell[present], p[present]))
                    numbers += held[-1][1].size
        if numbers > _HELD_NUMBERS:
            keys, sums = _merged(held)
            if sums.size > _HELD_NUMBERS // 2:
                light = np.argsort(sums.sum(axis=1))[: -max(1, _KEPT_NUMBERS // model.clusters)]
                yield from _by_key(keys[light], sums[light])
                keys, sums = np.delete(keys, light), np.delete(sums, light, axis=0)
            held, numbers = [(keys, sums)], sums.size
    yield from _by_key(*_merged(held))
    feature = np.repeat(np.arange(len(model.value_ids)), [len(known) for known in model.value_ids])
    value = np.concatenate([np.empty(0, np.int64), *model.value_ids])
    touched = np.flatnonzero(totals[:-1].any(axis=1))
    yield from _statistics(feature[touched], value[touched], totals[touched])
    yield from _statistics(np.array([RECORD_MASS]), np.array([0]), mass[None, :])


def summed_statistics(batches: Iterator[pa.RecordBatch], clusters: int) -> Iterator[pa.RecordBatch]:
    """Total per (feature, value) of partial statistics that come sorted by these two columns.

    Only the sum that the next batch may go on with is held.
    """
    key, total = None, np.zeros(clusters)
    for batch in batches:
        if not batch.num_rows:
            continue
        feature, value = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        n = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, clusters)
        keys = (feature << _VALUE_BITS) + value
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, sums = keys[starts], np.add.reduceat(n, starts, axis=0)
        if key == keys[0]:
            sums[0] += total
        elif key is not None:
            yield from _by_key(np.array([key]), total[None, :])
        yield from _by_key(keys[:-1], sums[:-1])
        key, total = int(keys[-1]), sums[-1]
    if key is not None:
        yield from _by_key(np.array([key]), total[None, :])


def _by_key(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    return _statistics(keys >> _VALUE_BITS, keys & (1 << _VALUE_BITS) - 1, n)


def _statistics(feature: np.ndarray, value: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = max(1, _BLOCK_NUMBERS // n.shape[1])
    for start in range(0, len(n), step):
        part = slice(start, start + step)
        columns = [pa.array(feature[part], pa.int32()), pa.array(value[part], pa.int32()), vectors(n[part])]
        yield pa.RecordBatch.from_arrays(columns, names=["feature_id", "value_id", "n"])


def vectors(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an Arrow list column."""
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


def sample_clusters(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """First cluster whose cumulative probability reaches ``u``; the last one with mass if rounding leaves a gap."""
    reached = np.cumsum(p, axis=1) >= u[:, None]
    last = p.shape[1] - 1 - (p[:, ::-1] > 0).argmax(axis=1)
    return np.where(reached.any(axis=1), reached.argmax(axis=1), last)


def scores(model: LogModel, columns: list[pa.Array], kind: str) -> pa.Array:
    """Posterior vectors ("soft"), likeliest clusters ("argmax"), or draws ("sampled") by a last column of uniforms."""
    cells = columns[:-1] if kind == "sampled" else columns
    parts = [pa.array([], pa.list_(pa.float64()) if kind == "soft" else pa.int32())]
    for part, _, p in model.blocks(cells):
        if kind == "soft":
            parts.append(vectors(p))
        elif kind == "argmax":
            parts.append(pa.array(p.argmax(axis=1), pa.int32()))
        else:
            u = columns[-1].to_numpy(zero_copy_only=False)[part]
            parts.append(pa.array(sample_clusters(p, u), pa.int32()))
    return pa.concat_arrays(parts)
