"""Exact k nearest neighbours by cosine distance.

Small indexes travel to the executors as a matrix, after their size was checked. Otherwise queries are dealt into blocks of
bounded size, and the index passes by each block in slices, as a stream: a task holds its block, a slice and the k best rows
so far. Products in single precision, with a bound on their error, tell which rows can be among them; only those are computed
in double precision. The work is the product of both sizes, as vectors without clusters leave nothing to rule out.
Distances are rounded to DECIMALS places and ties go to the smaller id, so every path and SQL agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scalars import cosine_distance
from ..session import ship, tidy

DECIMALS = 6
BROADCAST_VALUES = 1 << 20  # 8 MB of doubles
BLOCK_ROWS, SLICE_ROWS = 16384, 2048  # of queries in a task, and of the index in a step
STEP_ROWS, STEP_PAIRS = 512, 1 << 15  # of queries in a step, and pairs in double precision at once
STEP_VALUES = 1 << 20
FEW_QUERIES = 1000


def unit_rows(vectors: list) -> np.ndarray:
    rows = np.asarray(vectors, dtype=np.float64)
    if not len(rows):
        return np.zeros((0, 0))
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.full_like(rows, np.nan), where=norms > 0)


def nearest(queries: np.ndarray, index: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, index row, distance) of the k nearest rows, ties to the smaller index row; rows are unit vectors."""
    out = []
    step = max(1, STEP_VALUES // max(1, len(index)))
    for at in range(0, len(queries), step):
        distance = np.round(1 - queries[at : at + step] @ index.T, DECIMALS) + 0.0
        distance[np.isnan(distance)] = np.inf
        if k < len(index):
            bound = np.partition(distance, k - 1, axis=1)[:, k - 1]
            q, i = np.nonzero((distance <= bound[:, None]) & np.isfinite(distance))
        else:
            q, i = np.nonzero(np.isfinite(distance))
        d = distance[q, i]
        order = np.lexsort((i, d, q))
        q, i, d = q[order], i[order], d[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < k
        out.append((q[keep] + at, i[keep], d[keep]))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0)
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def _schema(queries: DataFrame, index: DataFrame, query_id: str, index_id: str) -> str:
    return f"query_id {queries.schema[query_id].dataType.simpleString()}, id {index.schema[index_id].dataType.simpleString()}, distance double"


def knn(queries: DataFrame, index: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest rows of index for each row of queries, a row itself included."""
    ship(queries.sparkSession)
    queries = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    index = index.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    rows, width = index.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not rows:
        return queries.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    found = _with_matrix(queries, index, k) if rows * width <= broadcast_values else _by_blocks(queries, index, k)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _with_matrix(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    frame = index.orderBy("id").toPandas()
    shared = queries.sparkSession.sparkContext.broadcast((frame["id"].to_numpy(), unit_rows(frame["v"].tolist())))
    schema = _schema(queries, index, "id", "id")

    def run(batches):
        ids, matrix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_pandas().to_numpy()
            q, i, d = nearest(unit_rows(_matrix(batch.column(1))), matrix, k)
            yield pa.RecordBatch.from_arrays([pa.array(own[q], batch.column(0).type), pa.array(ids[i]), pa.array(d)], names=["query_id", "id", "distance"])

    return queries.mapInArrow(run, schema)


def _is_single(rows: DataFrame) -> bool:
    return rows.schema["v"].dataType.elementType.simpleString() == "float"


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, in its own precision."""
    if not len(column):
        return np.zeros((0, 0))
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) != 1:
        raise ValueError(f"vectors of different widths: {lengths.tolist()}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), int(lengths[0]))


def _slices(rows: DataFrame, parts: int, most: int, is_query: bool) -> DataFrame:
    """(part, is_query, ids, width, vectors): rows (id, v) dealt into parts by id, many in a row, without zero vectors."""
    kind = np.float32 if _is_single(rows) else np.float64

    def run(batches):
        for batch in batches:
            matrix = _matrix(batch.column(1))
            with np.errstate(over="ignore", invalid="ignore"):
                squares = np.einsum("ij,ij->i", matrix, matrix, dtype=np.float64)
            good = np.flatnonzero((squares > 0) & np.isfinite(squares))
            part = batch.column(2).to_numpy()[good]
            order = np.argsort(part, kind="stable")
            good, part = good[order], part[order]
            for own in np.split(good, np.flatnonzero(np.diff(part)) + 1):
                for at in range(0, len(own), most):
                    taken = own[at : at + most]
                    ids = batch.column(0).take(pa.array(taken))
                    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                    columns = [batch.column(2).take(pa.array(taken[:1])), pa.array([is_query]), lists, pa.array([matrix.shape[1]], pa.int32()), pa.array([matrix[taken].astype(kind).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "is_query", "ids", "width", "vectors"])

    dealt = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    return dealt.mapInArrow(run, f"part int, is_query boolean, ids array<{rows.schema['id'].dataType.simpleString()}>, width int, vectors binary")


def _unpacked(batch: pa.RecordBatch, single: bool) -> tuple[pa.Array, np.ndarray]:
    """The ids and unit rows of slices (..., ids, width, vectors)."""
    widths = np.unique(batch.column(3).to_numpy())
    if len(widths) != 1:
        raise ValueError(f"vectors of different widths: {widths.tolist()}")
    parts = [np.frombuffer(data.as_buffer(), dtype=np.float32 if single else np.float64) for data in batch.column(4)]
    return batch.column(2).flatten(), unit_rows(np.concatenate(parts).reshape(-1, widths[0]))


def _margin(width: int) -> float:
    """How far a product of two unit rows in single precision can lie from the one that gives the rounded distance."""
    return (width + 6) * 2.0**-23 + 0.5 * 10.0**-DECIMALS


def _at_least(products: np.ndarray, bound: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the products that aren't below their row's bound; most are, which is seen eight at a time."""
    np.greater_equal(products, bound[:, None], out=mask)
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:whole].view(np.uint64) != 0)
    places = (some[:, None] * 8 + np.arange(8)).reshape(-1)
    found = np.concatenate([places[flat[places]], whole + np.flatnonzero(flat[whole:])])
    return found // products.shape[1], found % products.shape[1]


def _distances(own: np.ndarray, other: np.ndarray, q: np.ndarray, i: np.ndarray) -> np.ndarray:
    out = np.empty(len(q))
    for at in range(0, len(q), STEP_PAIRS):
        to = at + STEP_PAIRS
        out[at:to] = np.einsum("ij,ij->i", own[q[at:to]], other[i[at:to]])
    return np.round(1 - out, DECIMALS) + 0.0


def _orders(ids: np.ndarray) -> np.ndarray:
    """Numbers that sort as ids do."""
    return ids if ids.dtype.kind in "iuf" else np.unique(ids, return_inverse=True)[1]


def _steps(own32: np.ndarray, other32: np.ndarray, rows: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first query, first row, products, mask to use) of blocks of queries and rows; both arrays are used again."""
    products, mask = np.empty(STEP_ROWS * rows, np.float32), np.empty(STEP_ROWS * rows, bool)
    for a in range(0, len(own32), STEP_ROWS):
        left = own32[a : a + STEP_ROWS]
        for b in range(0, len(other32), rows):
            right = other32[b : b + rows]
            shape = (len(left), len(right))
            size = shape[0] * shape[1]
            yield a, b, np.dot(left, right.T, out=products[:size].reshape(shape)), mask[:size].reshape(shape)


class Best:
    """The k best rows so far of each query of a block."""

    def __init__(self, unit: np.ndarray, k: int, names: np.ndarray):
        self.unit, self.single, self.k = unit, unit.astype(np.float32), k
        self.distance, self.ids = np.full((len(unit), k), np.inf), np.full((len(unit), k), names[0], dtype=names.dtype)
        self.margin = _margin(unit.shape[1])

    def meet(self, ids: np.ndarray, unit: np.ndarray, rows: int) -> None:
        for a, b, products, mask in _steps(self.single, unit.astype(np.float32), rows):
            q, i = _at_least(products, self._bound(a, products), mask)
            if not len(q):
                continue
            q, i = q + a, i + b
            d, names = _distances(self.unit, unit, q, i), ids[i]
            worst, last = self.distance[q, -1], self.ids[q, -1]
            better = d < worst
            equal = np.flatnonzero(d == worst)
            better[equal] = names[equal] < last[equal]
            if better.any():
                self._merge(q[better], names[better], d[better])

    def _bound(self, a: int, products: np.ndarray) -> np.ndarray:
        """The least product in single precision that a row nearer than the k-th so far, or among k of these, can have."""
        bound = 1 - self.distance[a : a + len(products), -1] - self.margin
        open_ = np.flatnonzero(np.isneginf(bound))
        if len(open_) and self.k < products.shape[1]:
            place = products.shape[1] - self.k
            bound[open_] = np.partition(products[open_], place, axis=1)[:, place] - 2 * self.margin
        return bound.astype(np.float32)

    def _merge(self, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        touched = np.unique(q)
        every_q = np.concatenate([np.repeat(touched, self.k), q])
        every_id, every_d = np.concatenate([self.ids[touched].reshape(-1), ids]), np.concatenate([self.distance[touched].reshape(-1), d])
        order = np.lexsort((_orders(every_id), every_d, every_q))
        taken = order[np.searchsorted(every_q[order], touched)[:, None] + np.arange(self.k)]
        self.distance[touched], self.ids[touched] = every_d[taken], every_id[taken]


def _meeting(asks: DataFrame, rest: DataFrame, tasks: int, columns: list[str]) -> DataFrame:
    """Slices by task, the queries' first."""
    columns = ["task", "is_query", "ids", "width", "vectors", *columns]
    return asks.select(columns).unionByName(rest.select(columns)).repartitionById(tasks, F.col("task")).sortWithinPartitions("task", F.desc("is_query"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(task, is_query, slices) of a batch, for each run of equal ones."""
    task, asking = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((np.diff(task) != 0) | (asking[1:] != asking[:-1])) + 1
    for at, to in zip([0, *cuts], [*cuts, len(task)], strict=True):
        if at < to:
            yield task[at], asking[at], batch.slice(at, to - at)


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _by_blocks(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The k nearest rows in each part of the index, of which there are more than one only if the queries are few."""
    cores, block, rows = queries.sparkSession.sparkContext.defaultParallelism, BLOCK_ROWS, SLICE_ROWS
    blocks = max(1, -(-queries.count() // block))
    blocks, parts = (-(-blocks // cores) * cores, 1) if blocks >= cores else (blocks, -(-2 * cores // blocks))
    asks = _slices(queries, blocks, block, True).withColumn("other", _every(parts)).withColumn("task", F.col("part") * parts + F.col("other"))
    rest = _slices(index, parts, rows, False).withColumn("other", _every(blocks)).withColumn("task", F.col("other") * parts + F.col("part"))
    singles, id_type = {True: _is_single(queries), False: _is_single(index)}, to_arrow_type(index.schema["id"].dataType)

    def answer(own: list[pa.Array], best: Best | None) -> Iterator[pa.RecordBatch]:
        if best is None:
            return
        names = pa.concat_arrays(own)
        for at in range(0, len(names), STEP_ROWS):
            q, place = np.nonzero(np.isfinite(best.distance[at : at + STEP_ROWS]))
            columns = [names.take(pa.array(q + at)), pa.array(best.ids[q + at, place], id_type), pa.array(best.distance[q + at, place])]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "distance"])

    def run(batches):
        task, own, units, best = None, [], [], None
        for batch in batches:
            for now, asking, slices in _runs(batch):
                if now != task:
                    yield from answer(own, best)
                    task, own, units, best = now, [], [], None
                ids, unit = _unpacked(slices, singles[bool(asking)])
                if asking:
                    own.append(ids)
                    units.append(unit)
                elif own:
                    names = ids.to_numpy(zero_copy_only=False)
                    if best is None:
                        best, units = Best(np.concatenate(units), k, names), []
                    best.meet(names, unit, rows)
        yield from answer(own, best)
        tidy()

    return _meeting(asks, rest, blocks * parts, []).mapInArrow(run, _schema(queries, index, "id", "id"))


def knn_sql(queries: DataFrame, index: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The same in SQL functions only, for few queries, which travel to the rows of the index; more go to `knn`."""
    if queries.limit(FEW_QUERIES + 1).count() > FEW_QUERIES:
        return knn(queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding")), index.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding")), k)
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("__q")).where("__q is not null")
    i = index.select(F.col(id_col).alias("id"), F.col(vector_col).alias("__v")).where("__v is not null")
    pairs = i.crossJoin(F.broadcast(q)).select("query_id", "id", (F.round(cosine_distance(F.col("__q"), F.col("__v")), DECIMALS) + 0.0).alias("distance")).where("distance is not null")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)


def threshold_join(index: DataFrame, threshold: float, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """All pairs (a < b) within the distance, block by block; unlike the scan, not limited to near neighbours.

    Each two blocks meet in one task: a block stays, and itself and half of the others, those that follow it, pass by.
    """
    ship(index.sparkSession)
    vectors = index.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    cores, rows, single = index.sparkSession.sparkContext.defaultParallelism, SLICE_ROWS, _is_single(vectors)
    blocks = -(-max(2 * cores, -(-vectors.count() // BLOCK_ROWS)) // cores) * cores
    packed = _slices(vectors, blocks, rows, True)
    passing = packed.withColumn("is_query", F.lit(False)).withColumn("step", _every(blocks // 2 + 1)).withColumn("task", F.pmod(F.col("part") - F.col("step"), F.lit(blocks)))
    passing = passing.where((F.col("step") * 2 < blocks) | (F.col("task") * 2 < blocks))  # of an even number, opposite ones once
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches):
        task, held, own = None, [], None
        for batch in batches:
            for now, asking, slices in _runs(batch):
                if now != task:
                    task, held, own = now, [], None
                ids, unit = _unpacked(slices, single)
                if asking:
                    held.append((ids.to_numpy(zero_copy_only=False), unit))
                    continue
                if own is None:
                    own = tuple(np.concatenate(part) for part in zip(*held, strict=True))
                    own, held = (*own, own[1].astype(np.float32)), []
                itself = np.repeat(slices.column(5).to_numpy() == now, slices.column(2).value_lengths().to_numpy())
                names, bound = ids.to_numpy(zero_copy_only=False), 1 - threshold - _margin(unit.shape[1])
                for a, b, products, mask in _steps(own[2], unit.astype(np.float32), rows):
                    q, i = _at_least(products, np.full(len(products), bound, np.float32), mask)
                    q, i = q + a, i + b
                    d = _distances(own[1], unit, q, i)
                    x, y = own[0][q], names[i]
                    near = (d <= threshold) & np.where(itself[i], x < y, x != y)
                    x, y, swap = x[near], y[near], (x > y)[near]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, y, x), ids.type), pa.array(np.where(swap, x, y), ids.type), pa.array(d[near])], names=["a_id", "b_id", "distance"])
        tidy()

    return _meeting(packed.withColumn("task", F.col("part")), passing, blocks, ["part"]).mapInArrow(run, f"a_id {kind}, b_id {kind}, distance double")
