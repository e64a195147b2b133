"""Approximate nearest neighbours by largest inner product: robust-pruned directed graphs, one for each shard.

Vectors get one more component, sqrt(M - |v|^2) with M the shard's largest squared norm, and queries a zero there: the
nearest by distance are then those of largest inner product, whatever the norms. Distinct vectors are dealt to shards
of about SHARD by a hash of their smallest id, those whose norms differ by a factor of four or so to shards of their
own, so that a few long vectors don't make all others look alike. In a shard a task builds the graph: points come in batches; a greedy
search for each proposes neighbours (all points that it went through), and of these, nearest first, one is kept
unless a kept one is nearer to it by a factor of ALPHA (relaxed distance pruning, which keeps edges in diverse
directions, at most DEGREE). Edges are given back, and a list that grows over DEGREE is pruned again. Every vector is in
the index; nothing is fitted on a sample.

Queries, a stated set, are taken in blocks of QUERIES against every shard: a beam search of BEAM points from the
shard's medoid, in numpy steps for many queries at once. Inner products of what it finds are worked out anew in double
precision, and a shard hands on its k best for each query. Memory is bounded by a shard and a block.

Equal vectors are one point that carries its k + 1 smallest ids: no result holds more of them, since ties go to smaller
ids and only the query's own id is left out. A hot vector is thus one point, and its rows are cut down before the
shuffle. Vectors null, empty, zero or holding null or non-finite components take no part, nor do rows without an id;
rows that repeat id and vector count once, and rows of a query's id are never its candidates. Vectors meet those of
their length only. With fewer candidates all are given as far as they are found (all, where a shard holds no more points than the
beam). There are no texts. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import durable, quoted, ship

#: Points of a shard, queries of a block.
SHARD, QUERIES = 8192, 4096
#: Edges of a point; points of the beam in building and in queries; points that a step expands at once.
DEGREE, BUILD_BEAM, BEAM, STEP = 36, 56, 112, 4
#: How much nearer a kept neighbour must be to replace another (squared distances).
ALPHA = 1.1**2
#: Points inserted at a time, at most; floats that a numpy step handles at a time, about.
BATCH, FLOATS = 256, 1 << 23


def search(data: np.ndarray, sq: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the ``width`` nearest found, nearest first; all points expanded) for each query; n stands for none.

    data, sq, edges: vectors, squared norms and neighbours of n points and of a last one that stands for none.
    """
    n, b = len(sq) - 1, len(queries)
    ids, dist = np.full((b, width), n, np.int32), np.full((b, width), np.inf, np.float32)
    fresh, seen = np.zeros((b, width), bool), np.zeros((b, n + 1), bool)
    ids[:, 0], dist[:, 0], fresh[:, 0] = entry, sq[entry] - 2 * (queries @ data[entry]), True
    seen[:, [n, entry]] = True
    active, path = np.arange(b), []
    while True:
        active = active[fresh[active].any(1)]
        if not len(active):
            break
        rows, own = active[:, None], fresh[active]
        at = np.argsort(~own, axis=1, kind="stable")[:, :STEP]
        expanded = np.where(np.take_along_axis(own, at, 1), ids[rows, at], n)
        fresh[rows, at] = False
        path.append((active, expanded))
        near = np.sort(edges[expanded].reshape(len(active), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        r, c = np.nonzero(~seen[rows, near])
        x = near[r, c]
        seen[active[r], x] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[r, c] = sq[x] - 2 * np.einsum("ij,ij->i", data[x], queries[active[r]])
        every = np.concatenate([dist[active], d], 1)
        best = np.argsort(every, axis=1, kind="stable")[:, :width]
        dist[active] = np.take_along_axis(every, best, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], 1), best, 1)
        fresh[active] = np.take_along_axis(np.concatenate([fresh[active], np.isfinite(d)], 1), best, 1)
    went = np.full((b, STEP * len(path)), n, np.int32)
    for k, (active, expanded) in enumerate(path):
        went[active, STEP * k : STEP * k + expanded.shape[1]] = expanded
    ids[~np.isfinite(dist)] = n
    return ids, went


def prune(data: np.ndarray, sq: np.ndarray, points: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """The neighbours that each point keeps of the proposed ones (n: none), nearest first."""
    n, step = len(sq) - 1, max(1, FLOATS // max(1, near.shape[1] * max(near.shape[1], data.shape[1])))
    out = np.full((len(points), degree), n, np.int32)
    for i in range(0, len(points), step):
        own, c = points[i : i + step, None], np.sort(near[i : i + step], axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = n
        c[c == own] = n
        v = data[c]
        dist = sq[c] + sq[own] - 2 * np.matmul(v, data[own[:, 0]][:, :, None])[:, :, 0]
        order = np.argsort(dist, axis=1, kind="stable")
        c, dist, v = np.take_along_axis(c, order, 1), np.take_along_axis(dist, order, 1), np.take_along_axis(v, order[:, :, None], 1)
        some = int((c < n).sum(1).max(initial=0))
        c, dist, v = c[:, :some], dist[:, :some], v[:, :some]
        norms = np.where(c < n, sq[c], 0)
        between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive, every = c < n, np.arange(len(c))
        for k in range(min(degree, some)):
            if not alive.any():
                break
            pick, left = alive.argmax(1), alive.any(1)
            out[i + every[left], k] = c[every, pick][left]
            alive &= ALPHA * between[every, pick] > dist
            alive[every, pick] = False
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, batch: int = BATCH) -> tuple[np.ndarray, int]:
    """(neighbours of each point, n for none; the point to start from). The same for the same vectors."""
    n = len(vectors)
    data, sq = padded(vectors)
    edges = np.full((n + 1, degree), n, np.int32)
    entry = int(np.argmin(sq[:n] - 2 * (vectors @ vectors.mean(0))))
    order = np.random.RandomState(7).permutation(n)
    order, done = np.concatenate([[entry], order[order != entry]]), 1
    while done < n:
        new = order[done : done + max(1, min(batch, done // 8))]
        done += len(new)
        kept = prune(data, sq, new, search(data, sq, edges, entry, data[new], beam)[1], degree)
        edges[new] = kept
        # Edges back, by the point that gets them; at most ``degree`` new ones of it at a time.
        to, back = kept.ravel(), np.repeat(new, degree).astype(np.int32)
        to, back = to[to < n], back[to < n]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        for low in range(0, int(place.max(initial=-1)) + 1, degree):
            now = (place >= low) & (place < low + degree)
            points, row = np.unique(to[now], return_inverse=True)
            more = np.full((len(points), degree), n, np.int32)
            more[row, place[now] - low] = back[now]
            both = np.sort(np.concatenate([edges[points], more], 1), axis=1)
            full = both[:, degree] < n if both.shape[1] > degree else np.zeros(len(points), bool)
            edges[points[~full]] = both[~full, :degree]
            edges[points[full]] = prune(data, sq, points[full], both[full], degree)
    return edges[:n], entry


def padded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors and their squared norms, and one at infinity that stands for none."""
    data = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
    sq = np.einsum("ij,ij->i", data, data)
    sq[-1] = np.inf
    return data, sq


def norms(v: np.ndarray) -> np.ndarray:
    """Norms as a column, of very long and very short vectors too."""
    scale = np.maximum(np.abs(v).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return scale * np.linalg.norm(v / scale, axis=1, keepdims=True)


def lifted(v: np.ndarray) -> np.ndarray:
    """With the component that makes all norms alike; scaled to 1, so that single precision does."""
    x = v / norms(v).max()
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", x, x)))[:, None]], 1).astype(np.float32)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, v (doubles): rows that take part, each once."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vec_col)).cast("array<double>").alias("v"))
    good: Column = F.col("id").isNotNull() & F.forall("v", real) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.coalesce(good, F.lit(False))).distinct()


def indexed(rows: DataFrame, k: int, shard: int = SHARD) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(dim, size, shard, place, v, ids, edges, entry for each distinct vector: durable; dim, size and its shards).

    size: a power of four that the sum of the components' sizes is about; there are 1,100 at most. ids: the k + 1 smallest of the vector.
    """
    ship(rows.sparkSession)
    first = Window.partitionBy("h", "v").orderBy("id")
    told = rows.withColumn("h", F.xxhash64("v")).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x))  # no squares, which might be infinite or 0
    size = F.floor(F.least(F.log2(length), F.lit(1024.0)) / 2 + 0.5).cast("int")
    points = told.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = durable(points.select(F.size("v").alias("dim"), size.alias("size"), "v", "ids"))
    kinds = [(r.dim, r.size, -(-r.n // shard)) for r in points.groupBy("dim", "size").agg(F.count("*").alias("n")).collect()]
    shards = F.element_at(F.create_map(*(F.lit(x) for d, s, n in kinds for x in (f"{d} {s}", n))), F.concat_ws(" ", "dim", "size")) if kinds else F.lit(1)
    dealt = points.select("dim", "size", F.pmod(F.xxhash64(F.col("ids")[0]), shards).cast("int").alias("shard"), "v", "ids")

    def graph(table: pa.Table) -> pa.Table:
        # The same order in whatever order rows come, so that a lost task builds the same graph again.
        lead = table["ids"].combine_chunks()
        table = table.take(pa.array(np.argsort(lead.values.to_numpy()[lead.offsets.to_numpy()[:-1]], kind="stable")))
        edges, entry = build(lifted(_matrix(table["v"])))
        lists = pa.ListArray.from_arrays(np.arange(0, edges.size + 1, edges.shape[1], dtype=np.int32), edges.ravel())
        table = table.append_column("place", pa.array(np.arange(len(edges), dtype=np.int32))).append_column("edges", lists)
        return table.append_column("entry", pa.array(np.full(len(edges), entry, np.int32)))

    schema = "dim int, size int, shard int, v array<double>, ids array<bigint>, place int, edges array<int>, entry int"
    return durable(dealt.groupBy("dim", "size", "shard").applyInArrow(graph, schema)), kinds


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, block: int = QUERIES, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id ``every`` divides, among all others."""
    rows = durable(usable(vectors, id_col, vec_col))
    asked = rows.filter(F.col("id") % every == 0)
    return nearest_to(rows, asked, k, shard, block, beam)


def nearest_to(rows: DataFrame, asked: DataFrame, k: int, shard: int = SHARD, block: int = QUERIES, beam: int = BEAM) -> DataFrame:
    """As ``nearest``, for the queries ``asked`` (id, v, as ``usable`` gives them) against ``rows``."""
    index, kinds = indexed(rows, k, shard)
    blocks = max(1, -(-asked.count() // block))
    width = max(beam, k + 1)
    every = F.array(*(F.struct(F.lit(d).alias("dim"), F.lit(s).alias("size"), F.lit(n).alias("shards")) for d, s, n in kinds)) if kinds else F.array().cast("array<struct<dim:int,size:int,shards:int>>")
    queries = asked.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.filter(every, lambda x: x["dim"] == F.size("v"))).alias("kind"), "id", "v")
    queries = queries.select("kind.dim", "kind.size", F.explode(F.sequence(F.lit(0), F.col("kind.shards") - 1)).alias("shard"), "block", "id", "v")
    points = index.select("dim", "size", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", "place", "v", "ids", "edges", "entry")

    def look(points: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if points.num_rows and queries.num_rows:
            points = points.take(pa.array(np.argsort(points["place"].to_numpy())))
            v, q, ids = _matrix(points["v"]), _matrix(queries["v"]), points["ids"].combine_chunks()
            members, starts = ids.values.to_numpy(), ids.offsets.to_numpy()
            data, sq = padded(lifted(v))
            edges = _matrix(points["edges"])
            edges = np.concatenate([edges, np.full((1, edges.shape[1]), len(v), np.int32)])
            lifted_q = np.concatenate([q / norms(q), np.zeros((len(q), 1))], 1).astype(np.float32)
            step = max(1, FLOATS // max(data.shape[1] * STEP * edges.shape[1], len(v)))
            names = queries["id"].to_pylist()
            for i in range(0, len(q), step):
                near = search(data, sq, edges, points["entry"][0].as_py(), lifted_q[i : i + step], width)[0]
                for name, own, at in zip(names[i : i + step], q[i : i + step], near, strict=True):
                    at = at[at < len(v)]
                    each = ((-float(s), m) for s, p in zip((v[at] * own).sum(1).tolist(), at.tolist(), strict=True) for m in members[starts[p] : starts[p + 1]].tolist() if m != name)
                    found += [(name, m, -s) for s, m in sorted(each)[:k]]
        a, b, c = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    keys = ["dim", "size", "shard", "block"]
    found = points.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(look, "query_id long, vec_id long, score double")
    # A row repeats an id with other vectors: its best one counts.
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
