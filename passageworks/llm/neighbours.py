"""The most similar vectors of every vector, by collision-counting hashing.

Method: every vector is projected on ``projections`` random lines.  On each
line the vectors of a shard stand in a sorted array, and a query looks at the
window centred at its own projection.  Two vectors collide on a line if one
lies in the other's window; vectors that collide on enough lines are verified
by their true cosine.  The windows start narrow and are widened (virtual
rehashing: the arrays stay as they are): both ends of every window move on,
only what enters is added to the counts, which are carried from one width to
the next, and a query ends as soon as its ``k`` best are at least as near as
the windows are made for, or the floor asked for is reached.

Windows are read from prefix sets of a line, one bit for a vector, and counts
are kept in bit planes, so that 64 vectors are counted by one operation.

Shards keep this linear: cells around centroids fitted on a bounded sample hold
all vectors; a query visits its nearest cells, as many as a measured recall
asks for.  A cell or query list over its limit is cut into blocks, every pair
of which is compared, so nothing is capped.  Exact copies are searched once: a
class of equal vectors sends one query, and at most ``k + 1`` of its members
are needed as answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import erf, isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageworks.session import cut_lineage

#: Vectors of a cell, on average, and the most cells (64 MB of centroids at 64 dimensions); beyond that cells grow up to blocks.
CELL_VECTORS, MAX_CELLS = 1000, 262_144
#: Vectors the centroids are fitted on: this many per cell, within these bounds.
SAMPLE_PER_CELL, SAMPLE_LEAST, SAMPLE_MOST = 16, 20_000, 524_288
#: From so many cells on, a vector is compared with the centroids of its nearest groups of cells only, this many groups.
GROUPED_CELLS, NEAR_GROUPS = 2048, 8
#: Data and query vectors compared in one group.
BLOCK_DATA, BLOCK_QUERIES = 4096, 8192
#: Queries that the number of visited cells is measured on.
TUNING_QUERIES = 256
#: Random lines; half-width of a window in units of the distance it is made for; standard deviations of allowance in the threshold.
PROJECTIONS, WIDTH, ALLOWANCE = 32, 1.645, 3.2
#: Cosines for which the windows are made, one after the other; the last stands for windows over everything.
LEVELS = (0.95, 0.88, 0.75, 0.55, -1.0)
#: Words of 64 bits in one plane that are worked on at a time.
PLANE_WORDS = 32_768
#: A class of at least one row in so many is hot: its copies are spread over as many parts as follow.
HOT_ONE_IN, HOT_SAMPLE, HOT_PARTS = 1000, 100_000, 64


def usable(df: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """Rows whose vector has ``dimensions`` finite components, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull() & (F.size(v) == dimensions)).where(finite & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dimensions)


def _unit(df: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """id and unit vector, as packed 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) + np.float32(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "v"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(run, "id long, v binary")


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Distinct centroids by k-means on the unit sphere; beyond 1,024 in two levels, with cells in proportion to the sample.

    Copies in the sample count once, else a hot class would start many cells at one place.
    """
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    if cells > 1024 and len(sample) > cells:
        top = fit_cells(sample, isqrt(cells), rounds, seed)
        at = (sample @ top.T).argmax(axis=1)
        return np.unique(np.concatenate([fit_cells(own, max(1, round(cells * len(own) / len(sample))), rounds, seed) for own in (sample[at == i] for i in range(len(top))) if len(own)]), axis=0)
    cells = max(1, min(cells, len(sample)))
    c = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        at = (sample @ c.T).argmax(axis=1)
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        moved = c.copy()
        moved[at[order][first]] = np.add.reduceat(sample[order], first, axis=0)
        norm = np.linalg.norm(moved, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, moved / np.maximum(norm, 1e-9), c).astype(np.float32)
    return np.unique(c, axis=0)


class Cells:
    """Centroids, in groups if they are many, and the cells nearest to vectors."""

    def __init__(self, centroids: np.ndarray, grouped: int = GROUPED_CELLS, near: int = NEAR_GROUPS):
        self.centroids, self.near, self.groups = centroids, near, None
        if len(centroids) > grouped:
            top = fit_cells(centroids[:: max(1, len(centroids) // 20_000)], isqrt(len(centroids)))
            at = np.concatenate([(centroids[i : i + 4096] @ top.T).argmax(axis=1) for i in range(0, len(centroids), 4096)])
            members = [np.flatnonzero(at == i) for i in range(len(top))]
            held = [i for i, m in enumerate(members) if len(m)]
            self.groups, self.top = [members[i] for i in held], top[held]

    def visited(self, v: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``probes`` nearest cells of every vector, and which of them is its home: always exactly one, also if centroids tie.

        Rows are worked on in slices, so that memory does not grow with rows times cells.
        """
        width = len(self.centroids) if self.groups is None else self._near(probes) * max(map(len, self.groups))
        step = max(1, 4_000_000 // width)
        found = [self._slice(v[i : i + step], probes) for i in range(0, len(v), step)]
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros((0, 1), int), np.zeros((0, 1), bool))

    def _near(self, probes: int) -> int:
        """Groups looked into: so many that they hold several times the cells asked for."""
        return min(len(self.groups), max(self.near, -(-4 * probes * len(self.groups) // len(self.centroids))))

    def _slice(self, v: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        if self.groups is None:
            far, names = -(v @ self.centroids.T), None
        else:
            near = self._near(probes)
            chosen = np.argpartition(-(v @ self.top.T), near - 1, axis=1)[:, :near]
            width = max(map(len, self.groups))
            far, names = np.full((len(v), near, width), np.inf, np.float32), np.zeros((len(v), near, width), np.int32)
            for g in np.unique(chosen):
                row, place = np.nonzero(chosen == g)
                own = self.groups[g]
                far[row, place, : len(own)] = -(v[row] @ self.centroids[own].T)
                names[row, place, : len(own)] = own
            far, names = far.reshape(len(v), -1), names.reshape(len(v), -1)
        own = min(probes, int(np.isfinite(far).sum(axis=1).min()))
        home = far.argmin(axis=1)
        far[np.arange(len(v)), home] = -np.inf  # so that it is among those taken
        cell = np.argpartition(far, own - 1, axis=1)[:, :own] if own < far.shape[1] else np.tile(np.arange(own), (len(v), 1))
        return cell if names is None else np.take_along_axis(names, cell, axis=1), cell == home[:, None]


def lines(dimensions: int, projections: int = PROJECTIONS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, projections)).astype(np.float32)


def threshold(projections: int = PROJECTIONS, width: float = WIDTH, allowance: float = ALLOWANCE) -> int:
    """Collisions that a vector just as near as a window is made for reaches almost surely."""
    p = erf(width / sqrt(2))
    return max(1, int(projections * p - allowance * sqrt(projections * p * (1 - p))))


class _Lines:
    """The sorted arrays of a block, one for each line, and the set of the first r vectors of each array, for every r."""

    def __init__(self, data: np.ndarray, a: np.ndarray):
        n, m = len(data), a.shape[1]
        self.words = -(-n // 64)
        projected = data @ a
        order = np.argsort(projected, axis=0, kind="stable")
        self.arrays = np.ascontiguousarray(np.take_along_axis(projected, order, axis=0).T)
        self.prefix = np.zeros((m, n + 1, self.words), np.uint64)
        for i in range(m):
            self.prefix[i, np.arange(1, n + 1), order[:, i] >> 6] = np.uint64(1) << (order[:, i] & 63).astype(np.uint64)
            np.bitwise_or.accumulate(self.prefix[i], axis=0, out=self.prefix[i])


class _Windows:
    """Windows of a step of queries on every line, and for every vector on how many lines it lies inside, in bit planes."""

    def __init__(self, lines: _Lines, at: np.ndarray):
        m, q = at.shape
        self.lines, self.at = lines, at
        self.low = self.high = np.zeros((m, q), np.int32)
        self.planes = np.zeros((m.bit_length(), q, lines.words), np.uint64)

    def widen(self, half: float) -> None:
        """Moves both ends of every window outwards and counts what enters."""
        low, high = np.empty_like(self.low), np.empty_like(self.high)
        for i, prefix in enumerate(self.lines.prefix):
            low[i] = np.searchsorted(self.lines.arrays[i], self.at[i] - half)
            high[i] = np.searchsorted(self.lines.arrays[i], self.at[i] + half, "right")
            carry = prefix[high[i]] ^ prefix[low[i]] ^ prefix[self.high[i]] ^ prefix[self.low[i]]
            for plane in self.planes:
                both = plane & carry
                plane ^= carry
                carry = both
        self.low, self.high = low, high

    def at_least(self, need: int) -> np.ndarray:
        more = np.zeros_like(self.planes[0])
        equal = ~more
        for p in range(len(self.planes) - 1, -1, -1):
            if need >> p & 1:
                equal = equal & self.planes[p]
            else:
                more |= equal & self.planes[p]
                equal = equal & ~self.planes[p]
        return more | equal

    def keep(self, left: np.ndarray) -> None:
        self.at, self.low, self.high, self.planes = self.at[:, left], self.low[:, left], self.high[:, left], self.planes[:, left]


def _verified(own: np.ndarray, data: np.ndarray, candidates: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, datum, cosine) of the ``k`` best candidates of each query, of cosine at least ``floor``; equal ones by place."""
    n = len(data)
    bits = np.unpackbits(candidates.view(np.uint8), axis=1, bitorder="little", count=n)
    if np.count_nonzero(bits) * 8 > bits.size:  # so many that the product of all is cheaper
        cosine = own @ data.T
        ordered = np.where(bits, np.round(cosine, 7) - np.arange(n) * 1e-12, -3.0)
        d = np.argpartition(-ordered, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(own), 1))
        keep = np.take_along_axis(bits, d, axis=1).astype(bool)
        q, at = np.nonzero(keep)
        d = d[q, at]
        cosine = cosine[q, d]
    else:
        q, d = np.nonzero(bits)
        cosine = np.einsum("ij,ij->i", own[q], data[d])
    keep = cosine >= max(floor, -2.0)
    return q[keep], d[keep], cosine[keep]


def search_block(data: np.ndarray, queries: np.ndarray, k: int, floor: float, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, datum, cosine) of up to ``k`` best data of cosine at least ``floor`` for each query, by collision counting."""
    lines = _Lines(data, a)
    need = threshold(a.shape[1])
    levels = [x for x in LEVELS if x > floor] + [max(floor, -1.0)]
    exact = data.astype(np.float64)
    everything = np.full(lines.words, ~np.uint64(0))
    step = max(32, PLANE_WORDS // lines.words)
    out = []
    for begin in range(0, len(queries), step):
        own = queries[begin : begin + step]
        windows, own = _Windows(lines, (own @ a).T), own.astype(np.float64)
        seen = np.zeros((len(own), lines.words), np.uint64)
        active = np.arange(len(own))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for level in levels:
            if level <= -1.0:
                candidates = everything & ~seen
            else:
                windows.widen(WIDTH * sqrt(2 - 2 * level))
                candidates = windows.at_least(need) & ~seen
                seen |= candidates
            q, d, cosine = _verified(own[active], exact, candidates, k, floor)
            found.append((active[q], d, cosine))
            if level == levels[-1]:
                break
            near = sum(np.bincount(q[cosine >= level], minlength=len(own)) for q, _, cosine in found)[active]
            left = near < k
            active, seen = active[left], seen[left]
            windows.keep(left)
            if not len(active):
                break
        q, d, cosine = (np.concatenate([f[i] for f in found]) for i in range(3))
        by = np.lexsort((d, -np.round(cosine, 7), q))
        q, d, cosine = q[by], d[by], cosine[by]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        out.append((begin + q[best], d[best], cosine[best]))
    return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0) for i in range(3))


def _probes_for(classes: DataFrame, cells: Cells, total: int, k: int, floor: float, dimensions: int, recall: float) -> int:
    """The fewest cells in which ``recall`` of the true neighbours of a bounded sample of queries stand.

    The sample is compared with every vector in one pass that keeps ``k`` per query and task.
    """
    every = max(1, total // TUNING_QUERIES)
    asked = classes.where(F.pmod(F.xxhash64("class", F.lit(1)), F.lit(every)) == 0).limit(TUNING_QUERIES).select("class", "v").toArrow()
    if not len(asked):
        return 1
    names, queries = asked["class"].to_numpy(), _matrix(asked["v"], dimensions)
    context = classes.sparkSession.sparkContext
    shared = context.broadcast((names, queries))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        kept: list[tuple[float, int, bytes]] = [[] for _ in names]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            cosine = queries @ _matrix(batch.column(1), dimensions).T
            cosine[names[:, None] == ids[None, :]] = -2
            d = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < len(ids) else np.tile(np.arange(len(ids)), (len(names), 1))
            for i, places in enumerate(d):
                new = [(float(cosine[i, j]), int(ids[j]), batch.column(1)[int(j)].as_py()) for j in places if cosine[i, j] >= max(floor, -1.5)]
                kept[i] = sorted(kept[i] + new, reverse=True)[:k]
        rows = [(int(names[i]), *x) for i, own in enumerate(kept) for x in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.binary()))], ["query", "cosine", "class", "v"])

    near = classes.select("class", "v").mapInArrow(best, "query long, cosine double, class long, v binary")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("cosine").desc(), "class"))).where(F.col("rank") <= k)
    true = near.select("query", "v").toArrow()  # at most TUNING_QUERIES * k
    shared.unpersist()
    if not len(true):
        return 1
    most = len(cells.centroids)
    cell, home = cells.visited(_matrix(true["v"], dimensions), 1)
    at = cell[home]
    place = np.searchsorted(np.sort(names), true["query"].to_numpy())
    own = queries[np.argsort(names)][place]
    # how many centroids are nearer to the query than the home of its neighbour
    needed = np.concatenate([(own[i : i + 64] @ cells.centroids.T > (own[i : i + 64] * cells.centroids[at[i : i + 64]]).sum(axis=1, keepdims=True)).sum(axis=1) for i in range(0, len(own), 64)]) + 1
    return int(min(most, max(1, np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])))


def similar(
    df: DataFrame,
    k: int = 10,
    floor: float = -1.0,
    key: str = "vec_id",
    vector: str = "embedding",
    dimensions: int = 64,
    probes: int | None = None,
    queries: Callable[[Column], Column] | None = None,
    cell_vectors: int = CELL_VECTORS,
    recall: float = 0.98,
) -> DataFrame:
    """One row per query vector and neighbour: ``key``, ``neighbour``, ``rank`` (from 1), ``cosine`` and
    ``score`` = (cosine + 1) / 2.

    Queries are all usable vectors, or those whose id fulfils ``queries`` (a
    function from the id's column to a condition); neighbours are the ``k`` best other usable vectors found,
    of cosine at least ``floor``; equal cosines (to 7 places) go by id.

    Null vectors, vectors of another length, with a null, NaN or infinite
    component or all zero take no part.  Copies are neighbours of cosine 1 of
    each other.  A table without usable vectors gives an empty result.  Ids are
    taken as unique; a repeated row repeats its vector under one id, which
    counts once.  Other columns are ignored whatever their names.

    A query visits ``probes`` cells, or, if none are given, as many as hold the
    share ``recall`` of the true neighbours of a bounded sample of queries.

    Jobs run while the query is built: the classes are written to the shared
    folder, centroids are fitted and probes measured.

    Searching below a ``floor`` is not needed to find what is above it, which
    keeps windows narrow.  The index holds every vector; only the centroids
    come from a sample.
    """
    rows = _unit(usable(df, vector, dimensions), key, vector, dimensions)
    spark = df.sparkSession

    # A class of copies is one row with its first k + 1 ids: the surplus of a hot class is dropped before the
    # shuffle, and what remains of a class is bounded.
    first = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = first.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    asks = F.lit(True) if queries is None else F.exists("ids", queries) | (F.size("ids") > k)
    classes = cut_lineage(classes.select(F.element_at("ids", 1).alias("class"), "ids", "v", asks.alias("asks")))

    # cells are made for classes, since a class stands in its cell once
    total = classes.count()
    cells = max(1, min(MAX_CELLS, total // cell_vectors))
    size = min(SAMPLE_MOST, max(SAMPLE_LEAST, SAMPLE_PER_CELL * cells))
    every = max(1, total // size)
    sample = classes.where(F.pmod(F.xxhash64("class"), F.lit(every)) == 0).limit(size).select("v").toArrow()["v"]
    centroids = fit_cells(_matrix(sample, dimensions), cells) if len(sample) else np.zeros((1, dimensions), np.float32)
    index = Cells(centroids)
    if probes is None:
        probes = _probes_for(classes, index, total, k, floor, dimensions, recall)
    shared = spark.sparkContext.broadcast(index)  # at most MAX_CELLS vectors

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, home = shared.value.visited(_matrix(batch.column(2), dimensions), probes)
            asks = np.broadcast_to(np.asarray(batch.column(3).to_numpy(zero_copy_only=False), bool)[:, None], cell.shape)
            at, place = np.nonzero(home | asks)
            columns = [batch.column(i).take(pa.array(at)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(asks[at, place]), pa.array(home[at, place]), pa.array(cell[at, place].astype(np.int32))], ["class", "ids", "v", "asks", "answers", "cell"])

    # at home a class answers and asks, in its other cells it only asks
    visits = classes.mapInArrow(visit, "class long, ids array<long>, v binary, asks boolean, answers boolean, cell int")

    # one small row per cell: how many blocks its data and its queries need (the vectors are not written for it)
    need = lambda c, most: F.greatest(F.lit(1), F.ceil(c / most)).cast("int")
    sizes = visits.groupBy("cell").agg(need(F.count_if("answers"), BLOCK_DATA).alias("data_blocks"), need(F.count_if("asks"), BLOCK_QUERIES).alias("query_blocks"))
    sizes = {r["cell"]: (r["data_blocks"], r["query_blocks"]) for r in sizes.where("data_blocks > 1 OR query_blocks > 1").collect()}  # at most MAX_CELLS
    large = spark.createDataFrame([(c, *n) for c, n in sizes.items()], "cell int, data_blocks int, query_blocks int")
    placed = visits.join(F.broadcast(large), "cell", "left").fillna(1, ["data_blocks", "query_blocks"])
    everywhere = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    drawn = lambda blocks: F.array(F.pmod(F.xxhash64("class"), F.col(blocks)).cast("int"))
    # in a pair of blocks stands what answers in the one and what asks in the other
    pairs = F.flatten(F.transform(everywhere("data_blocks"), lambda x: F.transform(everywhere("query_blocks"), lambda y: F.struct(x.alias("data_block"), y.alias("query_block")))))
    here = lambda p: F.struct((F.col("answers") & (p["data_block"] == drawn("data_blocks")[0])).alias("answers"), (F.col("asks") & (p["query_block"] == drawn("query_blocks")[0])).alias("asks"), p["data_block"].alias("data_block"), p["query_block"].alias("query_block"))
    spread = F.filter(F.transform(pairs, here), lambda h: h["answers"] | h["asks"])
    placed = placed.select("cell", "class", "ids", "v", F.inline(spread))

    def compare(table: pa.Table) -> pa.Table:
        v = _matrix(table["v"], dimensions)
        ids, lists = table["class"].to_numpy(), table["ids"].to_pylist()
        own, others = (np.flatnonzero(table[x].to_numpy(zero_copy_only=False).astype(bool)) for x in ("asks", "answers"))
        if not len(own) or not len(others):
            return pa.table({"class": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        others = others[np.argsort(ids[others])]
        q, d, cosine = (x.astype(y) for x, y in zip(search_block(v[others], v[own], k + 1, floor, lines(dimensions)), (np.int64, np.int64, np.float64)))
        answers = [lists[i] for i in others[d]]
        many = np.fromiter(map(len, answers), np.int64, len(answers))
        asking, flat = np.repeat(ids[own][q], many), np.fromiter((x for a in answers for x in a), np.int64, int(many.sum()))
        return pa.table({"class": asking, "other": flat, "cosine": np.repeat(np.minimum(cosine, 1.0), many)})

    hits = placed.groupBy("cell", "data_block", "query_block").applyInArrow(compare, "class long, other long, cosine double")
    best = Window.partitionBy("class").orderBy(F.round("cosine", 7).desc(), "other")
    hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    lists = hits.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "cosine"))).alias("found"))

    # Every member of a class that asks gets the list of its class, without itself.  Members of a hot class are spread
    # over parts, to each of which its list is sent; which classes are hot is seen on a bounded sample of the rows.
    digest = rows.select("id", F.md5("v").alias("digest"))
    sampled = max(1, df.count() // HOT_SAMPLE)
    hot = digest.where(F.pmod(F.xxhash64("id"), F.lit(sampled)) == 0).groupBy("digest").count()
    least = max(8, HOT_SAMPLE // HOT_ONE_IN)
    hot = [r["digest"] for r in hot.where(F.col("count") >= least).orderBy(F.col("count").desc()).limit(HOT_ONE_IN).collect()]
    parts = F.when(F.col("digest").isin(hot), F.lit(HOT_PARTS)).otherwise(1) if hot else F.lit(1)
    digest = (digest if queries is None else digest.where(queries(F.col("id")))).distinct()
    alone = lists.select(F.col("class").alias("id"), "found")
    copies = classes.where(F.size("ids") > 1).select("class", F.md5("v").alias("digest")).join(lists, "class")
    copies = copies.select("class", "digest", "found", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    members = digest.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).join(copies, ["digest", "part"])
    own = alone.unionByName(members.where(F.col("id") != F.col("class")).select("id", "found"))
    if queries is not None:
        own = own.where(queries(F.col("id")))
    own = own.select("id", F.posexplode(F.slice(F.filter("found", lambda x: x["other"] != F.col("id")), 1, k)).alias("place", "hit"))
    cosine = F.col("hit.cosine")
    return own.select(F.col("id").alias(key), F.col("hit.other").alias("neighbour"), (F.col("place") + 1).alias("rank"), cosine.alias("cosine"), ((cosine + 1) / 2).alias("score"))
