"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

* Vectors get one more component that makes all of them equally long, so that the largest inner product is the smallest distance.
* Centroids come from a bounded sample by splitting it again and again at the median along its widest direction, so
  every list gets an equal share of the sample.
* A graph over the centroids (neighbours of each) in every task finds the nearest centroids of a vector by best-first
  search. A vector near a boundary is entered in every list whose centroid is nearly as near as its nearest.
* A query reads the lists whose centroids are within a distance ratio of its nearest, and is compared exactly with all
  vectors in them.

Equal vectors are one entry with its k+1 smallest ids, which is all that can be among k nearest. A long list is cut
into blocks, so no task holds a list, and queries meet blocks by an equi-join on the list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm.common import saved


def matrix(lists) -> np.ndarray:
    """An Arrow list column of equally long vectors as one array."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class CentroidGraph:
    """Centroids and a neighbour graph over them; at most as many as the sample has rows."""

    def __init__(self, sample: np.ndarray, n_lists: int, degree: int = 24):
        rng = np.random.default_rng(7)
        groups = [sample]
        while len(groups) < n_lists and max(map(len, groups)) > 1:
            cut = []
            for g in groups:
                if len(g) < 2:
                    cut.append(g)
                    continue
                d = g - g.mean(axis=0)
                v = rng.standard_normal(g.shape[1])
                for _ in range(8):  # power iteration: the widest direction
                    v = d.T @ (d @ v)
                    v /= max(np.linalg.norm(v), 1e-30)
                order = np.argsort(d @ v, kind="stable")
                cut += [g[order[:len(g) // 2]], g[order[len(g) // 2:]]]
            groups = cut
        self.centroids = np.array([g.mean(axis=0) for g in groups])
        n, k = len(self.centroids), min(degree, len(self.centroids) - 1)
        self.near = np.zeros((n, max(k, 1)), np.int64)
        for lo in range(0, n, 512):
            d = self.square_distances(self.centroids[lo:lo + 512])
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            if k:
                self.near[lo:lo + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
        self.entries = rng.choice(n, min(n, 16), replace=False)

    def square_distances(self, x: np.ndarray) -> np.ndarray:
        c = self.centroids
        return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1), 0)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of up to ``width`` near centroids of each row, nearest first, -1 for none.

        Best-first search with a beam of that width, for all rows at once.
        """
        n, c = len(x), self.centroids
        seen = np.zeros((n, len(c)), bool)
        beam, dist, done = np.full((n, width), -1), np.full((n, width), np.inf), np.ones((n, width), bool)

        def offer(rows: np.ndarray, cand: np.ndarray) -> None:
            new = ~seen[rows[:, None], cand]
            seen[rows[:, None], cand] = True
            diff = c[cand] - x[rows][:, None, :]
            d = np.where(new, np.einsum("ijk,ijk->ij", diff, diff), np.inf)
            all_c, all_d = np.hstack([beam[rows], cand]), np.hstack([dist[rows], d])
            all_done = np.hstack([done[rows], np.zeros(cand.shape, bool)])
            take = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            at = np.arange(len(rows))[:, None]
            beam[rows], dist[rows], done[rows] = all_c[at, take], all_d[at, take], all_done[at, take] | np.isinf(all_d[at, take])

        offer(np.arange(n), np.repeat(self.entries[None, :], n, axis=0))
        while True:
            rows = np.flatnonzero(~done.all(axis=1))
            if not len(rows):
                break
            pick = (~done[rows]).argmax(axis=1)
            done[rows, pick] = True
            offer(rows, self.near[beam[rows, pick]])
        return np.where(np.isinf(dist), -1, beam), dist


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) with v as doubles. Vectors null, zero, empty, with null or non-finite components, and of another than the usual length take no part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).where(~bad & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("v") == (usual.dim if usual else 0))


def nearest(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", query=None, sample: int = 16_384, list_rows: int = 256,
            width: int = 64, replicas: int = 4, entry_ratio: float = 1.08, probe_ratio: float = 1.6, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each query among all other rows.

    ``query``: a condition on vec_id; all rows if None. Ties go to the smaller vec_id. ``sample`` rows (in the order of a hash
    of the id) fit the centroids, about one for ``list_rows`` vectors and at most one for two of the sample. ``width`` is
    the search beam and the most lists a query reads, ``replicas`` the most lists a vector is entered in; both bound the work
    of a query, not which vectors are indexed: every vector is in at least one list. Recall is measured in tests.
    A query that finds fewer than k rows in its lists, though there are more, is compared with all vectors in blocks.
    A repeated vec_id is a separate candidate, but never its own neighbour; as a query its distinct vectors share one list.
    """
    rows = usable(vectors, id_col, vec_col)
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)  # pruned before the shuffle
    index = saved(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("key", F.xxhash64("v")))
    asked = rows.where(query(F.col("vec_id")) if query else F.lit(True)).select(F.col("vec_id").alias("query_id"), "v").distinct()
    stats = index.agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if not stats.n:
        return spark.createDataFrame([], schema)
    fitted = np.array([r.v for r in index.orderBy("key").select("v").limit(sample).collect()])
    top = stats.top

    def longer(x: np.ndarray, is_query: bool) -> np.ndarray:
        return np.hstack([x, np.zeros((len(x), 1)) if is_query else np.sqrt(np.maximum(top - (x * x).sum(1, keepdims=True), 0))])

    graph = CentroidGraph(longer(fitted, False), min(max(1, len(fitted) // 2), max(1, round(stats.n / list_rows))))
    shared = spark.sparkContext.broadcast(graph)  # bounded by the sample

    def entered(is_query: bool, limit: int, ratio: float):
        def run(batches):
            g = shared.value
            for whole in batches:
                for lo in range(0, whole.num_rows, 1024):
                    b = whole.slice(lo, 1024)
                    x = longer(matrix(b.column("v")), is_query)
                    if is_query:  # an inner product ranks alike for any length of the query; the usual one makes distances comparable
                        x *= np.sqrt(top) / np.linalg.norm(x, axis=1, keepdims=True)
                    c, d = g.search(x, max(limit, 16))
                    c, d = c[:, :limit], d[:, :limit]
                    row, col = np.nonzero((c >= 0) & (d <= ratio * ratio * d[:, :1]))
                    keep = b.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(c[row, col], pa.int64())], names=[*keep.schema.names, "list"])
        return run

    lists = saved(index.mapInArrow(entered(False, replicas, entry_ratio), "v array<double>, ids array<long>, key long, list long"))
    sizes = lists.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("n_blocks"))
    blocks = lists.join(F.broadcast(sizes), "list").groupBy("list", F.pmod("key", "n_blocks").alias("part")).agg(F.collect_list(F.struct("v", "ids")).alias("rows"))
    probes = saved(asked.mapInArrow(entered(True, width, probe_ratio), "query_id long, v array<double>, list long"))
    n_q = probes.groupBy("list").agg(F.ceil(F.count("*") / 256).cast("int").alias("n_q"))
    groups = probes.join(F.broadcast(n_q), "list").groupBy("list", F.pmod(F.xxhash64("query_id"), "n_q").alias("q")).agg(F.collect_list(F.struct("query_id", "v")).alias("queries"))

    def compare(batches):
        for b in batches:
            out = [[], [], []]
            for n in range(b.num_rows):
                queries, entries = b.column("queries")[n].values, b.column("rows")[n].values
                q, e, names, ids_of = matrix(queries.field("v")), matrix(entries.field("v")), queries.field("query_id").to_pylist(), entries.field("ids")
                s = np.einsum("id,jd->ij", q, e)
                keep = min(k + 1, len(e))
                best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                for i, own in enumerate(names):
                    least = s[i, best[i]].min()
                    for j in np.flatnonzero(s[i] >= least).tolist():  # ties at the edge too
                        ids = [v for v in ids_of[j].as_py() if v != own][:k]
                        out[0] += [own] * len(ids)
                        out[1] += ids
                        out[2] += [float(s[i, j])] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    def ranked(pairs: DataFrame) -> DataFrame:
        got = pairs.mapInArrow(compare, "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return got.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    found = saved(ranked(groups.join(blocks, "list").repartition("list", "q", "part").select("queries", "rows")))
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = saved(asked.join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < min(k, stats.ids - 1)).select("query_id", "v"))
    n_short = short.count()
    if not n_short:
        return found
    n_blocks = -(-stats.n // block)
    every = index.groupBy(F.pmod("key", F.lit(n_blocks)).alias("part")).agg(F.collect_list(F.struct("v", "ids")).alias("rows"))
    some = short.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(-(-n_short // 256))).alias("q")).agg(F.collect_list(F.struct("query_id", "v")).alias("queries"))
    some = some.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    whole = ranked(some.join(every, "part").repartition("q", "part").select("queries", "rows"))
    return found.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(whole)
