"""Approximate nearest neighbours with a permutation index.

1. Pivots: of a sample of ``sample`` usable vectors, least hash first, those farthest from the ones chosen before.  The
   sample has a stated size; a group of near copies gets few pivots, however large it is.
2. Each vector is its ``prefix`` nearest pivots in order.  For the inner product, vectors get one more component
   that makes all norms equal (queries get 0), so nearness to pivots orders as the inner product does.
3. Inverted files: a posting (vector, place) for each pivot in a vector's list, by pivot.  Every vector is posted; files
   are kept by block of vectors, where the block is read.
4. Footrule: a pivot that two lists share at places a and b brings them 2 * (prefix - max(a, b)) nearer than lists that
   share none.  Summed over the files of a query's own pivots - no other file is opened - this ranks the vectors.
5. Which footrule distance is near enough is told by the sample, once for each query and for all of its vectors alike:
   the nearest ``share`` of the vectors (``least`` at least), a group of near copies counting for little, and all that are
   ``alike`` as near as the sample's nearest, so that a query in such a group sees the whole of it.  What a query finds thus doesn't depend on how the
   vectors are dealt out.
6. Candidates are reranked with the exact inner product in double precision.  Those under the k-th best of the
   sample's own candidates can't be among the best k and stay where they are.  A query that finds fewer than k is
   asked again of all vectors.

Queries come in blocks of ``query_bytes``, broadcast one at a time.  Equal vectors of a block are ranked once, so that
thousands of copies can't crowd others out; ties go to smaller ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

K = 20
PIVOTS = 1024
PREFIX = 64
SHARE = 0.12
LEAST = 400
ALIKE = 0.6
SAMPLE = 8_192
QUERY_BYTES = 32 << 20
VECTOR_BLOCK = 8_192
#: Share of the sample that vectors with the same two nearest pivots count for at most when a distance is chosen.
CROWD = 0.002


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v: rows with an id and finite components, not all 0."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)


def augmented(v: np.ndarray, norm: float) -> np.ndarray:
    return np.c_[v, np.sqrt(np.maximum(norm * norm - (v * v).sum(axis=1), 0))]


def far_apart(v: np.ndarray, n: int) -> np.ndarray:
    """n of the vectors, all of one norm: each the one whose nearest vector chosen before is farthest."""
    v = np.unique(v, axis=0)
    at = [0]
    near = v @ v[0]
    while len(at) < min(n, len(v)):
        near[at[-1]] = math.inf
        at.append(int(near.argmin()))
        near = np.maximum(near, v @ v[at[-1]])
    return v[at]


def orders(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first; of equally near ones the first."""
    near = -(v @ pivots.T)
    if prefix < len(pivots):
        # ties at the edge are settled by number too: all at the edge's distance stay until the sort
        edge = np.partition(near, prefix - 1, axis=1)[:, prefix - 1 : prefix]
        near = np.where(near <= edge, near, math.inf)
    return np.argsort(near, axis=1, kind="stable")[:, :prefix].astype(np.int32)


def top(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (v * q).sum(axis=1)


class Block:
    """Inverted files of some vectors; equal ones are one vector with several ids."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, pivots: np.ndarray, prefix: int, norm: float):
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], np.ascontiguousarray(v[order])
        _, first, same = np.unique((v + 0.0).view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        self.v, self.ids, self.prefix = v[first], ids, prefix
        self.members, self.bounds = np.argsort(same, kind="stable"), np.r_[0, np.cumsum(np.bincount(same, minlength=len(first)))]
        lists = orders(augmented(self.v, norm), pivots, prefix)
        self.cell = lists[:, 0] * len(pivots) + lists[:, min(1, prefix - 1)]  # near copies share their first pivots
        by_pivot = np.argsort(lists.ravel(), kind="stable")
        self.files = np.searchsorted(lists.ravel()[by_pivot], np.arange(len(pivots) + 1))
        self.vector, self.place = (by_pivot // prefix).astype(np.int32), (by_pivot % prefix).astype(np.int32)

    def nearness(self, pivots: np.ndarray) -> np.ndarray:
        """Half of what the footrule distance is under that of lists that share no pivot."""
        a, n = self.files[pivots], self.files[pivots + 1] - self.files[pivots]
        posting = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        gain = self.prefix - np.maximum(self.place[posting], np.repeat(np.arange(len(pivots)), n))
        return np.bincount(self.vector[posting], gain, minlength=len(self.v))

    def candidates(self, pivots: np.ndarray, bar: float) -> np.ndarray:
        return np.flatnonzero(self.nearness(pivots) >= bar) if bar > 0 else np.arange(len(self.v))

    def best(self, own: int, q: np.ndarray, pivots: np.ndarray, bar: float, low: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k of the candidates that score `low` at least."""
        some = self.candidates(pivots, bar)
        score = products(self.v[some], q)
        if len(score) > k:
            low = max(low, np.partition(score, len(score) - k - 1)[len(score) - k - 1])  # one is the query's own, perhaps
        some, score = some[score >= low], score[score >= low]
        sizes = np.minimum(self.bounds[some + 1] - self.bounds[some], k + 1)  # the smallest ids of equal vectors
        at = np.repeat(self.bounds[some] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        ids, score = self.ids[self.members[at]], np.repeat(score, sizes)
        return top(ids[ids != own], score[ids != own], k)


class Space:
    """Pivots of one dimension's vectors, and the sample that tells how near is near."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, n: int, norm: float, *, k: int, pivots: int, prefix: int, share: float, least: int, alike: float):
        self.n, self.norm, self.k, self.least, self.share, self.alike = n, norm, k, least, share, alike
        self.pivots = far_apart(augmented(v, norm), pivots)
        self.prefix = min(prefix, len(self.pivots))
        self.sample = Block(ids, v, self.pivots, self.prefix, norm)
        weight = np.diff(self.sample.bounds).astype(float)
        _, cell = np.unique(self.sample.cell, return_inverse=True)
        held = np.bincount(cell, weight)
        self.weight = weight * np.minimum(1, CROWD * weight.sum() / held)[cell]

    def block(self, ids: np.ndarray, v: np.ndarray) -> Block:
        return Block(ids, v, self.pivots, self.prefix, self.norm)

    def ask(self, own: int, q: np.ndarray) -> tuple[np.ndarray, float, float]:
        """(a query's pivots in order, nearness that makes a candidate, score that the best k reach)."""
        mine = orders(np.r_[q, 0.0][None, :], self.pivots, self.prefix)[0]
        near = self.sample.nearness(mine)
        order = np.argsort(-near, kind="stable")
        upto = np.cumsum(self.weight[order]) * (self.n / self.weight.sum())  # about so many vectors are so near
        wanted = max(self.least, self.share * self.n)
        if wanted >= self.n or upto[np.searchsorted(-near[order], 0, side="left") - 1] < self.least or near.max() == 0:
            bar = 0.0
        else:
            at_share = near[order][min(np.searchsorted(upto, wanted), len(order) - 1)]
            bar = max(1.0, min(at_share, self.alike * near.max()))
        _, score = self.sample.best(own, q, mine, bar, -math.inf, self.k)
        low = float(score[-1]) if len(score) == self.k else -math.inf
        return mine, bar, low - 1e-9 * abs(low) if low > -math.inf else low


_ASKED = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("pivots", pa.list_(pa.int32())), ("bar", pa.float64()), ("low", pa.float64())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_FOUND_DDL = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST, alike: float = ALIKE, sample: int = SAMPLE, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors with the largest inner product found for each query.

    is_query: a condition on the id column, named "id".  Null, zero and non-finite vectors and rows without an id take
    no part.  A product needs equal lengths: vectors of another length than a query's are no candidates of it.  Rows
    with the query's own id are its own; of query rows that share an id and length the least vector asks.  Fewer candidates
    than k: all of them.  Empty in, empty out.
    """
    if not 0 < prefix <= pivots or sample < pivots:
        raise ValueError("prefix must be between 1 and pivots, and the sample at least as large")
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm2).alias("norm2"), F.count_if(is_query).alias("asked")).where("asked > 0").orderBy("d").collect()
    found = None
    for r in sizes:  # vectors mostly have one length
        mine = rows.where(F.size("v") == r["d"])
        some = _arrays([mine.orderBy(F.xxhash64("id", "v"), "id").limit(sample).toArrow().combine_chunks().to_batches()[0]], r["d"])
        space = Space(*some, r["n"], math.sqrt(r["norm2"]), k=k, pivots=pivots, prefix=prefix, share=share, least=least, alike=alike)
        got = _search(mine, mine.where(is_query).groupBy("id").agg(F.min("v").alias("v")), space, r["d"], query_bytes)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, queries: DataFrame, space: Space, d: int, query_bytes: int) -> DataFrame:
    """For each query the best of every task: k rows at most from each."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(space)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = _arrays([batch], d)
            out = [shared.value.ask(i, q) for i, q in zip(ids.tolist(), v, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.float64())), pa.array([p.tolist() for p, _, _ in out], _ASKED.field(2).type), pa.array([b for _, b, _ in out], pa.float64()), pa.array([x for _, _, x in out], pa.float64())], schema=_ASKED)

    # Few rows with much work each: as many tasks as any shuffle has.
    dealt = queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    asked = saved(dealt.mapInArrow(prepare, "id long, v array<double>, pivots array<int>, bar double, low double"), "asked")
    blocks = max(1, math.ceil(asked.count() * (8 * d + 4 * space.prefix + 24) / query_bytes))
    part = F.pmod(F.xxhash64("id"), F.lit(blocks))
    found = None
    for b in range(blocks):
        some = asked.where(part == b) if blocks > 1 else asked
        got = saved(_ask(rows, some, shared, d, space.k), "nearest")
        found = got if found is None else found.unionByName(got)
    # A query whose candidates were too few is asked again, of all vectors.
    due = min(space.k, space.n - 1)
    few = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= due)
    again = saved(asked.join(few, asked["id"] == few["query_id"], "left_anti").withColumns({"bar": F.lit(0.0), "low": F.lit(-math.inf)}).select(asked.columns), "again")
    if space.n > 1 and (n := again.count()):
        blocks = max(1, math.ceil(n * (8 * d + 4 * space.prefix + 24) / query_bytes))
        found = found.join(again.select(F.col("id").alias("a")), found["query_id"] == F.col("a"), "left_anti")
        for b in range(blocks):
            found = found.unionByName(saved(_ask(rows, again.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), shared, d, space.k), "nearest"))
    return found


def _ask(rows: DataFrame, asked: DataFrame, shared, d: int, k: int) -> DataFrame:
    """One block of queries against all vectors."""
    table = asked.orderBy("id").toArrow().combine_chunks()  # at most about query_bytes
    queries = rows.sparkSession.sparkContext.broadcast((table["id"].to_numpy(), _matrix(table["v"], d), _matrix(table["pivots"], shared.value.prefix), table["bar"].to_numpy(), table["low"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, qs, lists, bars, lows = queries.value
        lows = lows.copy()
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for vec_ids, v in _blocks(batches, d):
            block = shared.value.block(vec_ids, v)
            for i in range(len(ids)):
                a, s = block.best(int(ids[i]), qs[i], lists[i], bars[i], lows[i], k)
                if len(a):
                    best[i] = (a, s) if i not in best else top(np.r_[best[i][0], a], np.r_[best[i][1], s], k)
                    if len(best[i][1]) == k:
                        lows[i] = max(lows[i], best[i][1][-1])
        keys = sorted(best)
        for at in range(0, len(keys), 1000):
            some = keys[at : at + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[some], [len(best[i][0]) for i in some])), pa.array(np.concatenate([best[i][0] for i in some])), pa.array(np.concatenate([best[i][1] for i in some]))], schema=_FOUND)

    return rows.select("id", "v").mapInArrow(run, _FOUND_DDL)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for at in range(0, batch.num_rows, VECTOR_BLOCK):
            held.append(batch.slice(at, VECTOR_BLOCK))
            n += held[-1].num_rows
            if n >= VECTOR_BLOCK:
                yield _arrays(held, d)
                held, n = [], 0
    if n:
        yield _arrays(held, d)


def _matrix(column, d: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]) if not isinstance(column, pa.ChunkedArray) or column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(-1, d)


def _arrays(held: list[pa.RecordBatch], d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([b.column(0).to_numpy() for b in held]), np.concatenate([_matrix(b.column(1), d) for b in held])


def brute_force(ids: np.ndarray, v: np.ndarray, queries: np.ndarray, k: int) -> dict[int, list[tuple[int, float]]]:
    """All usable vectors, no index: what recall is measured against."""
    out = {}
    for q in queries.tolist():
        score = products(v, v[ids == q][0])
        some = ids != q
        a, s = top(ids[some], score[some], k)
        out[q] = list(zip(a.tolist(), s.tolist(), strict=True))
    return out
