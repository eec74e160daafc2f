"""Exact nearest neighbours by cosine: tiles of scores as matrix products; a task keeps k rows per query.

A similarity is what a running sum in doubles gives, rounded half up, and ties go to the smaller id. Scores are products in
single precision, which only tell what can't be among the best: their error is bounded, and all within it is computed by
running sums.
"""

from __future__ import annotations

import uuid
from collections.abc import Hashable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Queries and vectors of a tile at most (4 bytes a score), and vectors of a task's first tile.
TILE_QUERIES, TILE_ROWS, FIRST_ROWS = 1024, 2048, 16
#: Pairs whose running sums are made at once.
EXACT_PAIRS = 8192
#: Share of a unit of the last digit, next to where rounding turns, that is rounded by decimal digits.
NEAR_TURN = 1e-4
#: A free place: behind every id.
FREE = np.iinfo(np.int64).max


def running_sum(x: np.ndarray) -> np.ndarray:
    """Of each row, added from left to right."""
    return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def norms(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(running_sum(x * x))
    return np.where(n == 0, 1e-9, n)


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """As SQL rounds: by the decimal digits of the double."""
    different, at = np.unique(x, return_inverse=True)
    step = Decimal(1).scaleb(-digits)
    return np.array([float(Decimal(repr(v)).quantize(step, ROUND_HALF_UP)) if np.isfinite(v) else v for v in different.tolist()])[at] + 0.0


def by_dimension(ids: np.ndarray, vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, ids and vectors as a matrix of doubles; -1 for what is null or holds a null, which no vector can be compared with."""
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).copy()
    flat = pc.list_flatten(vectors)
    if flat.null_count:
        size[pc.list_parent_indices(vectors).filter(pc.is_null(flat)).to_numpy()] = -1
    for d in np.unique(size).tolist():
        here = size == d
        x = pc.list_flatten(vectors.filter(pa.array(here))).to_numpy(zero_copy_only=False).astype(np.float64) if d > 0 else np.zeros(0)
        yield d, ids[here], x.reshape(np.count_nonzero(here), max(d, 0))


def smallest(group: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of each group the places of the k + 1 smallest ids, k rows of an id at most: enough for k rows that aren't of one given id."""
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    place = np.arange(len(order))
    new_group = np.r_[True, g[1:] != g[:-1]][: len(order)]
    new_id = new_group | np.r_[True, i[1:] != i[:-1]][: len(order)]
    nth = np.cumsum(new_id)
    nth_id = nth - np.maximum.accumulate(np.where(new_group, nth, 0))
    nth_row = place - np.maximum.accumulate(np.where(new_id, place, 0))
    return order[(nth_id <= k) & (nth_row < k)]


def units(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (x / norm[:, None]).astype(np.float32)


_bounds: tuple[Hashable, dict[int, np.ndarray]] = (None, {})


def bounds(key: Hashable) -> dict[int, np.ndarray]:
    """By dimension, how far each query's k-th row was in the best of the key's tasks that this worker has ended; what is farther isn't among the k nearest of all."""
    global _bounds
    if _bounds[0] != key:
        _bounds = (key, {})
    return _bounds[1]


class Best:
    """The k best rows so far of queries of one dimension: by similarity (stored negative; NaN, the greatest, as minus infinity), then id."""

    @np.errstate(invalid="ignore", over="ignore")
    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, digits: int) -> None:
        self.ids, self.x, self.k, self.digits = ids, x, k, digits
        self.norm = norms(x)
        self.unit = units(x, self.norm)
        # half a unit of the last digit, and the error of a product of unit vectors in single precision
        self.slack = 0.5 * 10.0**-digits + (x.shape[1] + 8) * 2.0**-24
        self.far = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), FREE)
        self.bound = np.full(len(ids), np.inf)
        self.seen = 0

    @np.errstate(invalid="ignore", over="ignore")
    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        # of equal vectors only those of the smallest ids can be among the best
        same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, 8 * x.shape[1]))).ravel(), return_inverse=True)[1] if x.shape[1] else np.zeros(len(x), np.int64)
        keep = np.sort(smallest(same, ids, self.k))
        ids, x = ids[keep], x[keep]
        norm = norms(x)
        unit = units(x, norm)
        at = 0
        while at < len(ids):  # small tiles first, as every row is a candidate until k are found
            rows = slice(at, min(len(ids), at + min(TILE_ROWS, max(FIRST_ROWS, self.seen))))
            for q in range(0, len(self.ids), TILE_QUERIES):
                self._tile(slice(q, q + TILE_QUERIES), ids[rows], x[rows], norm[rows], unit[rows])
            self.seen += rows.stop - at
            at = rows.stop

    def _tile(self, queries: slice, ids: np.ndarray, x: np.ndarray, norm: np.ndarray, unit: np.ndarray) -> None:
        far, found, bound = self.far[queries], self.found[queries], self.bound[queries]
        behind = self.unit[queries] @ unit.T < (-np.minimum(far[:, -1], bound) - self.slack).astype(np.float32)[:, None]
        q, r = np.divmod(np.flatnonzero(~behind), len(ids))
        other = self.ids[queries][q] != ids[r]
        q, r = q[other], r[other]
        away = -self._similarity(self.x[queries], self.norm[queries], x, norm, q, r)
        away[np.isnan(away)] = -np.inf
        last, last_id = far[q, -1], found[q, -1]
        better = ((away < last) | ((away == last) & (ids[r] < last_id))) & (away <= bound[q])
        q, r, away = q[better], r[better], away[better]
        if not len(q):
            return
        touched = np.unique(q)
        q, away, ids = np.r_[np.repeat(touched, self.k), q], np.r_[far[touched].ravel(), away], np.r_[found[touched].ravel(), ids[r]]
        order = np.lexsort((ids, away, q))
        first = np.r_[True, q[order][1:] != q[order][:-1]]
        place = np.arange(len(order))
        order = order[place - np.maximum.accumulate(np.where(first, place, 0)) < self.k]
        far[touched], found[touched] = away[order].reshape(-1, self.k), ids[order].reshape(-1, self.k)

    def _similarity(self, a: np.ndarray, a_norm: np.ndarray, b: np.ndarray, b_norm: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Of the pairs q of a and r of b, rounded."""
        s = np.empty(len(q))
        for i in range(0, len(q), EXACT_PAIRS):
            part = slice(i, i + EXACT_PAIRS)
            s[part] = running_sum(a[q[part]] * b[r[part]]) / (a_norm[q[part]] * b_norm[r[part]])
        scaled = s * 10.0**self.digits
        out = np.rint(scaled) / 10.0**self.digits + 0.0
        turn = np.abs(scaled - np.floor(scaled) - 0.5) <= NEAR_TURN
        out[turn] = half_up(s[turn], self.digits)
        return out


def nearest_rows(v: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
    """Of each task over v (vec_id, embedding) the k rows nearest to each of the queries (query_id, query), which are broadcast, but for a query's own id.

    The k nearest of all are among them, by descending similarity, then vec_id. A similarity is null, and so the least, where
    either vector is null, holds a null or the dimensions differ. Every pair is scored.
    """
    wanted = queries.select(queries["query_id"].cast("long"), "query").toArrow().combine_chunks()
    shipped = v.sparkSession.sparkContext.broadcast(tuple(by_dimension(wanted["query_id"].to_numpy(), _whole(wanted["query"]))))
    search = uuid.uuid4().hex
    kinds = [f.dataType.simpleString() for f in (queries.schema["query_id"], v.schema["vec_id"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(ids, x, k, digits) for d, ids, x in shipped.value}
        known = bounds((search, TaskContext.get().stageId()))  # of one stage, so of one reading of the rows
        for d, own in best.items():
            own.bound = known.get(d, own.bound)
        least: dict[int, np.ndarray] = {}
        for b in batches:
            for d, ids, x in by_dimension(b["vec_id"].to_numpy(), b["embedding"]):
                if d >= 0 and d in best:
                    best[d].add(ids, x)
                ids = np.r_[least.get(d, ids[:0]), ids]
                least[d] = ids[smallest(np.zeros(len(ids)), ids, k)]
        for d, own in best.items():
            known[d] = np.minimum(own.bound, own.far[:, -1])
            unlike = np.sort(np.concatenate([np.zeros(0, np.int64), *(ids for other, ids in least.items() if other != d or d < 0)]))
            taken = ~np.isposinf(own.far)
            unknown = np.zeros_like(taken)
            if len(unlike):
                for q in np.flatnonzero(~taken.all(axis=1)).tolist():
                    more = unlike[unlike != own.ids[q]][: np.count_nonzero(~taken[q])]
                    places = slice(n := np.count_nonzero(taken[q]), n + len(more))
                    own.found[q, places], unknown[q, places], taken[q, places] = more, True, True
            similarity = np.where(np.isneginf(own.far), np.nan, -own.far)
            yield pa.record_batch([pa.array(np.repeat(own.ids, k).reshape(-1, k)[taken]), pa.array(own.found[taken]), pa.array(similarity[taken] + 0.0, mask=unknown[taken], from_pandas=False)], ["query_id", "vec_id", "similarity"])

    rows = v.where("vec_id is not null").select(v["vec_id"].cast("long"), "embedding")
    found = rows.mapInArrow(run, "query_id long, vec_id long, similarity double")
    return found.select(found["query_id"].cast(kinds[0]).alias("query_id"), found["vec_id"].cast(kinds[1]).alias("vec_id"), "similarity")


def _whole(x: pa.ChunkedArray) -> pa.ListArray:
    x = x.combine_chunks()
    return x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks)
