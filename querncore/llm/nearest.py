"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, then exact scores of the pairs that survive.

Vectors are packed into blocks: a row of packed int8 codes, scales, error norms and the original floats. Each tile multiplies a block
of queries with a block of candidates in int8 values (exact in float32 arithmetic, as the sums stay below 2**24). With x = s q + e,

    |x.y - s_x s_y q_x.q_y| <= |s_x q_x| |e_y| + |e_x| |y|

so a pair whose upper bound lies below the k-th largest lower bound of its query in the tile cannot be among the k nearest. The
others are recomputed in float64 from the original vectors; a tile hands on its k best of each query, and these meet in heaps.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of queries and of candidates; a tile's products take QUERIES * CHUNK * 4 bytes at a time.
QUERIES, CANDIDATES, CHUNK = 1024, 16384, 4096
#: Products of codes up to 127 sum up exactly in float32 for so many dimensions.
MAX_EXACT = (1 << 24) // (127 * 127)
BLOCK_SCHEMA = "block int, dim int, ids binary, vectors binary, codes binary, scale binary, error binary"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and norms of what the codes leave out, with room for rounding."""
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-30
    return codes, scale, error


def pack(kind: str):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        ids = group.column("vec_id").to_numpy()
        dim = group.column("dim")[0].as_py()
        flat = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = np.ascontiguousarray(flat.reshape(len(ids), dim), dtype=np.float64)
        codes, scale, error = quantised(x)
        one = lambda a: pa.array([a.tobytes()], pa.binary())
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), "ids": one(ids.astype(np.int64)), "vectors": one(x), "codes": one(codes), "scale": one(scale), "error": one(error)})

    return run


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision; equal rows give equal results wherever they stand."""
    return (a * b).sum(axis=1)


def tile(q: dict, c: dict, k: int):
    """(query place, id, score) of the k nearest candidates of each query in one tile, ties to the smaller id."""
    nq, nc = len(q["ids"]), len(c["ids"])
    qn = np.sqrt((q["vectors"] ** 2).sum(axis=1)) * (1 + 1e-9)
    qs = qn + q["error"]
    cn = np.sqrt((c["vectors"] ** 2).sum(axis=1)) * (1 + 1e-9)
    wide = q["codes"].shape[1] > MAX_EXACT
    qc = q["codes"].astype(np.float64 if wide else np.float32)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(nq)]
    floor = np.full(nq, -np.inf)
    for at in range(0, nc, CHUNK):
        part = slice(at, min(at + CHUNK, nc))
        ids = c["ids"][part]
        dots = (qc @ c["codes"][part].astype(qc.dtype).T).astype(np.float64) * q["scale"][:, None] * c["scale"][part][None, :]
        slack = (qs[:, None] * c["error"][part][None, :] + q["error"][:, None] * cn[part][None, :]) * (1 + 1e-9) + 1e-12 * (qn[:, None] * cn[part][None, :])
        own = ids[None, :] == q["ids"][:, None]
        low = dots - slack
        low[own] = -np.inf
        if low.shape[1] >= k:
            floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
        keep = (dots + slack >= floor[:, None]) & ~own
        rows, cols = np.nonzero(keep)
        for lo in range(0, len(rows), 1 << 17):
            r, j = rows[lo : lo + (1 << 17)], cols[lo : lo + (1 << 17)]
            scores = exact(q["vectors"][r], c["vectors"][part][j])
            order = np.lexsort((ids[j], -scores, r))
            r, s, i = r[order], scores[order], ids[j][order]
            starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(r)]):
                b = min(b, a + k)
                heap = heaps[r[a]]
                for x, v in zip(s[a:b].tolist(), i[a:b].tolist()):
                    if len(heap) < k:
                        heapq.heappush(heap, (x, -v))
                    elif (x, -v) > heap[0]:
                        heapq.heapreplace(heap, (x, -v))
                    else:
                        break
                if len(heap) == k:
                    floor[r[a]] = max(floor[r[a]], heap[0][0])
    for place, heap in enumerate(heaps):
        for x, v in heap:
            yield place, -v, x


def unpacked(row: dict, prefix: str) -> dict:
    dim = row["dim"]
    ids = np.frombuffer(row[prefix + "ids"], np.int64)
    return {"ids": ids, "vectors": np.frombuffer(row[prefix + "vectors"], np.float64).reshape(-1, dim), "codes": np.frombuffer(row[prefix + "codes"], np.int8).reshape(-1, dim), "scale": np.frombuffer(row[prefix + "scale"], np.float64), "error": np.frombuffer(row[prefix + "error"], np.float64)}


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """query_id long, rank int (from 1), vec_id long, score double: the k candidates with the largest inner product of each query,
    nearest first, ties to the smaller id; all candidates where there are fewer. The answer is exact.

    is_query: a condition on the id column. Candidates of a query are the rows with another id and as many dimensions. Null ids and null,
    empty, zero or non-finite vectors (or with null components) take no part. Rows that repeat an id count once, with the
    smallest of its vectors. Empty tables give no rows. Other columns are not read.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: F.coalesce(bad(x), F.lit(True))))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    sizes = {(r.dim, r.q): r.n for r in rows.withColumn("q", F.expr(is_query) if isinstance(is_query, str) else is_query).groupBy("dim", "q").agg(F.count("*").alias("n")).collect()}
    dims = sorted({d for d, _ in sizes})
    spark = vectors.sparkSession
    plan = spark.createDataFrame([(d, -(-sizes.get((d, True), 0) // queries), -(-sum(n for (e, _), n in sizes.items() if e == d) // candidates)) for d in dims], "dim int, nq int, nc int")
    rows = rows.join(F.broadcast(plan), "dim")  # a row for each number of dimensions
    asked = (F.expr(is_query) if isinstance(is_query, str) else is_query)
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int").alias("block")
    q = rows.filter(asked).select("dim", "nc", "vec_id", "v", block("nq")).drop("nc").groupBy("dim", "block").applyInArrow(pack("q"), BLOCK_SCHEMA)
    c = rows.select("dim", "vec_id", "v", block("nc")).groupBy("dim", "block").applyInArrow(pack("c"), BLOCK_SCHEMA)
    q = q.join(F.broadcast(plan), "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("block"), *(F.col(x).alias("q" + x) for x in ("ids", "vectors", "codes", "scale", "error")))
    c = c.select("dim", "block", *(F.col(x).alias("c" + x) for x in ("ids", "vectors", "codes", "scale", "error")))

    def run(batches):
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                own, other = unpacked(row, "q"), unpacked(row, "c")
                place, ids, scores = [], [], []
                for p, i, s in tile(own, other, k):
                    place.append(p)
                    ids.append(i)
                    scores.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(own["ids"][np.array(place, int)]), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["query_id", "vec_id", "score"])

    tiles = q.join(c, ["dim", "block"]).mapInArrow(run, "query_id long, vec_id long, score double")

    def merge(batches):
        best: dict[int, list] = {}
        done: int | None = None

        def out():
            found = [(qid, r + 1, -i, s) for qid, heap in best.items() for r, (s, i) in enumerate(sorted(heap, reverse=True))]
            return pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], t) for n, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", "vec_id", "score"])

        for b in batches:
            for qid, i, s in zip(*(b.column(n).to_pylist() for n in range(3))):
                if qid != done and len(best) >= 4096:  # rows are sorted by query: whole queries leave
                    yield out()
                    best = {}
                done = qid
                heap = best.setdefault(qid, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -i))
                else:
                    heapq.heappushpop(heap, (s, -i))
        yield out()

    dealt = tiles.repartition("query_id").sortWithinPartitions("query_id")
    return dealt.mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
