"""The arithmetic of one clustering pass over an Arrow batch, in numpy.

Used inside ``mapInArrow`` only: Spark partitions the points, merges the partial sums and
holds all state. The module is pickled by value, so executors need no copy of it.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Per group: (model number, centroid vectors [k, size], bias [k]).
GroupModels = dict[str, list[tuple[int, np.ndarray, np.ndarray]]]

#: Rows that are labelled at once, rows a combination of labels has at least to be worked on by itself, and the share of the squares by which rounding may move a distance (far more than it can).
CHUNK, LEAST_RUN, CLOSE = 2048, 256, 1e-12

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def nearest(x: list[np.ndarray], slots: list[np.ndarray], vectors: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid; ties go to the lower number."""
    label = best = None
    for j in range(len(vectors)):
        v = vectors[j]
        distance = (x[0] - v[0]) * (x[0] - v[0])
        for i in range(1, len(x)):
            difference = x[i] - v[i]
            distance = distance + difference * difference
        if slots:
            shares = v[slots[0]]
            for s in slots[1:]:
                shares = shares + v[s]
            distance = distance + (bias[j] - 2.0 * shares)
        if best is None:
            label, best = np.zeros(len(distance), np.int64), distance
        else:
            closer = distance < best
            label[closer] = j
            best = np.where(closer, distance, best)
    return label, np.maximum(best, 0.0)


def _group_rows(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Each group label of the batch and the positions of its rows."""
    encoded = batch.column("grp").dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    for code, label in enumerate(encoded.dictionary.to_pylist()):
        yield label, np.flatnonzero(codes == code)


def _columns(batch: pa.RecordBatch, prefix: str, count: int) -> list[np.ndarray]:
    return [batch.column(f"{prefix}{i}").to_numpy(zero_copy_only=False) for i in range(count)]


def _runs(slots: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Positions of the rows of each combination of label slots; nothing if most combinations have few rows."""
    if not slots:
        return []
    code = slots[0].astype(np.int64)
    for s in slots[1:]:
        code = code * size + s
    order = np.argsort(code, kind="stable")
    edges = np.flatnonzero(np.diff(code[order])) + 1
    return np.split(order, edges) if len(code) >= LEAST_RUN * (len(edges) + 1) else []


class _Stacked:
    """The centroids of all models of a group, one below the other, as weights of 1, of x0.. in units and of the indicators of slots."""

    def __init__(self, mine: list[tuple[int, np.ndarray, np.ndarray]], n_num: int, n_cat: int, units: float):
        self.models, self.n_num, self.units, self.parts = mine, n_num, units, []
        vectors, bias = np.concatenate([v for _, v, _ in mine]), np.concatenate([b for _, _, b in mine])
        square = (vectors[:, :n_num] ** 2).sum(axis=1)
        self.scale = 1.0 + float(square.max() + np.abs(bias).max() + 2.0 * n_cat)
        self.weights = np.column_stack((square + bias if n_cat else square, -2.0 / units * vectors[:, :n_num], -2.0 * vectors[:, n_num:]))
        at = 0
        for _, v, _ in mine:
            self.parts.append(slice(at, at + len(v)))
            at += len(v)
        self.totals = np.zeros((at, self.weights.shape[1]), np.int64)

    def add(self, part: np.ndarray, slots: list[np.ndarray], one: list[int]) -> None:
        """Label points (columns) and add them up; ``one`` has the slots that all of them share, if ``part`` lacks the indicators.

        A point's distances, less the part that all centroids share, are one matrix product. Where two of them are so
        close that rounding may decide, :func:`nearest` does.
        """
        weights = self.weights[:, :len(part)]
        if one:
            weights = weights.copy()
            weights[:, 0] += self.weights[:, [1 + s for s in one]].sum(axis=1)
        scores = weights @ part
        owner = np.empty(scores.shape, bool)
        x = [c / self.units for c in part[1:1 + self.n_num]]
        near = CLOSE * (sum(c * c for c in x) + self.scale)
        for at in self.parts:
            best = scores[at].min(axis=0)
            best += near
            np.less_equal(scores[at], best, out=owner[at])
        if np.count_nonzero(owner) > len(self.parts) * part.shape[1]:
            for at, (_, vectors, bias) in zip(self.parts, self.models):
                close = np.flatnonzero(owner[at].sum(axis=0) > 1)
                if len(close):
                    label, _ = nearest([c[close] for c in x], [c[close] for c in slots], vectors, bias)
                    owner[at, close] = False
                    owner[at.start + label, close] = True
        # Sums of a chunk stay far below 2**53, so the floats are exact in any order.
        found = (owner.astype(np.float64) @ part.T).astype(np.int64)
        self.totals[:, :found.shape[1]] += found
        for s in one:
            self.totals[:, 1 + s] += found[:, 0]


def partial_sums(n_num: int, n_cat: int, size: int, units: float, models: GroupModels) -> Callable:
    """One row per model and cluster of a partition: n, sums of x0.. and counts of each slot.

    Rows with the same label slots are worked on together where there are many, so that labels add a constant to a distance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacked: dict[str, _Stacked] = {}
        for batch in batches:
            fixed, slots = _columns(batch, "x", n_num), _columns(batch, "s", n_cat)
            for group, rows in _group_rows(batch):
                if group not in models:
                    continue
                if group not in stacked:
                    stacked[group] = _Stacked(models[group], n_num, n_cat, units)
                mine_slots = [c[rows] for c in slots]
                runs = _runs(mine_slots, size)
                for run_rows in runs or [np.arange(len(rows))]:
                    for at in range(0, len(run_rows), CHUNK):
                        some = run_rows[at:at + CHUNK]
                        here, here_slots = rows[some], [c[some] for c in mine_slots]
                        part = np.zeros((1 + n_num if runs else 1 + size, len(here)))
                        part[0] = 1.0
                        for i, c in enumerate(fixed):
                            part[1 + i] = c[here]
                        if not runs:
                            for c in here_slots:
                                part[1 + c, np.arange(len(here))] += 1.0
                        stacked[group].add(part, here_slots, [int(c[0]) for c in here_slots] if runs else [])
        out = [
            (number, j, *row) for group in stacked.values() for (number, _, _), at in zip(group.models, group.parts)
            for j, row in enumerate(group.totals[at].tolist()) if row[0] > 0
        ]
        if out:
            names = ["model", "cluster", "n", *[f"v{i}" for i in range(size)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return run


def best_draws(n_num: int, n_cat: int, units: float, models: GroupModels) -> Callable:
    """One row per model of a partition: the point with the smallest score -ln(u) / d²."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for batch in batches:
            fixed, slots = _columns(batch, "x", n_num), _columns(batch, "s", n_cat)
            race, ids = -np.log(batch.column("u").to_numpy(zero_copy_only=False)), batch.column("pid")
            for group, rows in _group_rows(batch):
                x, mine_slots = [c[rows] / units for c in fixed], [c[rows] for c in slots]
                for number, vectors, bias in models.get(group, ()):
                    _, d2 = nearest(x, mine_slots, vectors, bias)
                    score = np.full(len(rows), np.inf)
                    np.divide(race[rows], d2, out=score, where=d2 > 0)
                    lowest = score.min()
                    if not np.isfinite(lowest):
                        continue
                    for at in rows[np.flatnonzero(score == lowest)]:
                        row = (float(lowest), ids[int(at)].as_py(), *[int(c[at]) for c in fixed], *[int(c[at]) for c in slots])
                        found[number] = min(found.get(number, row), row)
        if found:
            columns = list(zip(*found.values()))
            arrays = [pa.array(list(found), pa.int64()), pa.array(columns[0], pa.float64()), pa.array(columns[1], ids.type)]
            arrays += [pa.array(c, pa.int64()) for c in columns[2:]]
            names = ["model", "score", "pid", *[f"x{i}" for i in range(n_num)], *[f"s{i}" for i in range(n_cat)]]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def all_labels(n_num: int, n_cat: int, units: float, models: GroupModels) -> Callable:
    """Every row once, with the labels and distances of all models of its group as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed, slots = _columns(batch, "x", n_num), _columns(batch, "s", n_cat)
            for group, rows in _group_rows(batch):
                mine = models.get(group)
                if not mine:
                    continue
                x, mine_slots = [c[rows] / units for c in fixed], [c[rows] for c in slots]
                pairs = [nearest(x, mine_slots, vectors, bias) for _, vectors, bias in mine]
                ends = pa.array(np.arange(0, (len(rows) + 1) * len(mine), len(mine)), pa.int32())
                flat = lambda i, kind: pa.array(np.stack([p[i] for p in pairs], axis=1).ravel(), kind)
                arrays = [
                    *batch.take(pa.array(rows)).columns,
                    pa.ListArray.from_arrays(ends, flat(0, pa.int32())),
                    pa.ListArray.from_arrays(ends, flat(1, pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "clusters", "distances"])

    return run


def cluster_sums(n_num: int, n_cat: int, size: int, units: float, models: GroupModels, measures: list[str], shifts: dict[int, np.ndarray]) -> Callable:
    """One row per model and cluster of a partition, for final models: n, the sum of squared distances,
    the counts of each slot, and for each measure the shift and the sums of differences from it and of their squares.

    ``shifts`` has a value near the cluster's mean per cluster and measure, so that the squares don't cancel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            fixed, slots = _columns(batch, "x", n_num), _columns(batch, "s", n_cat)
            values = [batch.column(m).to_numpy(zero_copy_only=False) for m in measures]
            for group, rows in _group_rows(batch):
                x, mine_slots, mine = [c[rows] / units for c in fixed], [c[rows] for c in slots], [c[rows] for c in values]
                for number, vectors, bias in models.get(group, ()):
                    k = len(vectors)
                    label, d2 = nearest(x, mine_slots, vectors, bias)
                    count = counts.setdefault(number, np.zeros((k, 1 + size), np.int64))
                    total = sums.setdefault(number, np.zeros((k, 1 + 2 * len(measures))))
                    count[:, 0] += np.bincount(label, minlength=k)
                    for c in mine_slots:
                        count[:, 1:] += np.bincount(label * size + c, minlength=k * size).reshape(k, size)
                    total[:, 0] += np.bincount(label, weights=d2, minlength=k)
                    for i, c in enumerate(mine):
                        off = c - shifts[number][label, i]
                        total[:, 1 + 2 * i] += np.bincount(label, weights=off, minlength=k)
                        total[:, 2 + 2 * i] += np.bincount(label, weights=off * off, minlength=k)
        at = [(m, j) for m, t in counts.items() for j in range(len(t)) if t[j, 0] > 0]
        if at:
            whole = np.array([counts[m][j] for m, j in at])
            parts = np.hstack([np.array([sums[m][j] for m, j in at]), np.array([shifts[m][j] for m, j in at]).reshape(len(at), -1)])
            numbers = np.array(at)
            names = ["model", "cluster", "n", *[f"v{i}" for i in range(size)], "d2"]
            names += [f"{c}{i}" for i in range(len(measures)) for c in "ab"] + [f"c{i}" for i in range(len(measures))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*numbers.T, *whole.T, *parts.T)], names)

    return run


def wide_labels(n_num: int, n_cat: int, units: float, models: GroupModels, names: dict[int, str], kept: list[str]) -> Callable:
    """Every row once, its columns ``kept``, with a column of labels per model.

    A group's coordinates are the columns ``<group>_x0``..; rows without them get null labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = _columns(batch, "s", n_cat)
            columns = {c: batch.column(c) for c in kept}
            for group, mine in models.items():
                raw = [batch.column(f"{group}_x{i}") for i in range(n_num)]
                rows = np.flatnonzero(raw[0].is_valid().to_numpy(zero_copy_only=False))
                x = [c.take(pa.array(rows)).to_numpy(zero_copy_only=False) / units for c in raw]
                mine_slots = [c[rows] for c in slots]
                for number, vectors, bias in mine:
                    label, missing = np.zeros(batch.num_rows, np.int32), np.ones(batch.num_rows, bool)
                    label[rows], missing[rows] = nearest(x, mine_slots, vectors, bias)[0], False
                    columns[names[number]] = pa.array(label, mask=missing)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run
