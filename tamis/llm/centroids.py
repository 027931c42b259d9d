"""Exact k-means rounds over integer vectors, pruned by bounds over the history of centroids (ns-bounds).

For each vector and centroid the distance of their last evaluation is kept, and its round. The history of all centroids is
kept too, so a bound is loosened by how far that centroid is now from where it was then: the norm of its total displacement, which is
never more than the sum of its drifts per round. A centroid whose lower bound exceeds the upper bound to the vector's own one cannot be
nearer. Where that fails, the distance to the own centroid is evaluated, and then to every centroid that still may be nearer, in exact
integers, ties to the smaller number.

Vectors lie in blocks, with their bounds beside them. A round reads the blocks, writes them anew with the sums of each block's clusters, and reads
back the sums alone: per round a number per centroid and dimension reaches the driver. Blocks are cut inside tasks, so nothing is
shuffled by cluster and a cluster that holds most vectors is no hot key. The blocks of the round before are deleted when the next ones
are written; a lost task reads its input again. Centroids and their history are the only broadcasts: rounds * k * d numbers.

Defined results: vectors that are null, hold a null, or do not have ``dimensions`` components take no part; components must
lie within 2 ** 26 of 0, so that squared distances fit a long, and others end the job with an error; repeated rows count each; a null id
is kept; with no vectors there are no rows, and with fewer distinct starts than clusters the later of equal ones stay
empty and as they are; other columns are not read.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shared_folder, shuffles_dropped

#: Numbers (components and bounds) in a block, and the largest component.
BLOCK_NUMBERS, LARGEST = 1 << 19, 1 << 26
BLOCKS = "ids binary, vectors binary, cluster binary, distance binary, seen binary, clusters array<struct<cluster:int,n:long,inertia:long,sums:array<long>>>, evaluated long"


class Clustering(NamedTuple):
    """``vectors``: id, cluster, distance (squared). ``clusters``: cluster, n, inertia and centroid of every centroid. ``inertia``: the sum
    over all. ``evaluated``: distances computed in each round."""
    vectors: DataFrame
    clusters: DataFrame
    inertia: int
    evaluated: list[int]


def assign(x, history, cluster, distance, seen):
    """Assign block ``x`` to the centroids history[-1]; ``distance`` and ``seen`` (rows x k: the distance at the last evaluation and its
    round) are brought up to date in place. Returns (cluster, number of distances evaluated)."""
    now, centroids = len(history) - 1, history[-1]
    k, rows = len(centroids), np.arange(len(x))
    moved = np.sqrt(((history - centroids).astype(float) ** 2).sum(axis=2))  # [round, centroid]
    exact = np.full(distance.shape, -1, np.int64)
    evaluated = 0

    def evaluate(j, which):
        nonlocal evaluated
        if len(which):
            exact[which, j] = ((x[which] - centroids[j]) ** 2).sum(axis=1)
            distance[which, j] = np.sqrt(exact[which, j].astype(float))
            seen[which, j] = now
            evaluated += len(which)

    if now == 0:
        for j in range(k):
            evaluate(j, rows)
        return exact.argmin(axis=1), evaluated  # the first of equal ones

    def maybe(which):
        """Which centroids may be as near as the own one; room for rounding keeps too many, never too few."""
        drift = moved[seen[which], np.arange(k)]
        upper = (distance[which, cluster[which]] + drift[np.arange(len(which)), cluster[which]])[:, None]
        may = distance[which] - drift <= upper + 1e-9 * (upper + drift + 1)
        may[np.arange(len(which)), cluster[which]] = False
        return may

    open_rows = rows[maybe(rows).any(axis=1)]
    for j in range(k):
        evaluate(j, open_rows[cluster[open_rows] == j])
    may = maybe(open_rows)
    for j in range(k):
        evaluate(j, open_rows[may[:, j]])
    out = cluster.copy()
    known = np.where(exact[open_rows] < 0, np.iinfo(np.int64).max, exact[open_rows])
    out[open_rows] = known.argmin(axis=1)
    return out, evaluated


def _sums(x, cluster, centroids):
    """Per non-empty cluster: number, sum of squared distances, sums of components."""
    away = ((x - centroids[cluster]) ** 2).sum(axis=1)
    return [{"cluster": int(j), "n": int(own.sum()), "inertia": int(away[own].sum()), "sums": x[own].sum(axis=0).tolist()}
            for j in np.unique(cluster) for own in [cluster == j]]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
    if len(x) and max(int(x.max()), -int(x.min())) > LARGEST:
        raise ValueError(f"a component lies beyond {LARGEST}: squared distances might not fit a long")
    return x


class _Rounds:
    """The blocks of one run: a folder a round, of which the last two exist."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.last = spark, f"{shared_folder(spark)}/tamis-llm/centroids-{uuid.uuid4().hex}", None

    def write(self, blocks: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        with shuffles_dropped(self.spark):
            blocks.write.parquet(path)
        if self.last:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.last)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.last = path
        return self.spark.read.schema(blocks.schema).parquet(path)


def _totals(blocks: DataFrame, d: int) -> dict[int, tuple[int, int, list[int]]]:
    """cluster: (number, inertia, sums); a row per centroid comes to the driver."""
    c = F.col("c")
    rows = (blocks.select(F.explode("clusters").alias("c"))
            .groupBy(c["cluster"].alias("cluster")).agg(F.sum(c["n"]).alias("n"), F.sum(c["inertia"]).alias("inertia"),
                                                         F.array(*[F.sum(c["sums"][i]) for i in range(d)]).alias("sums")).collect())
    return {r["cluster"]: (r["n"], r["inertia"], r["sums"]) for r in rows}


def cluster_vectors(vectors: DataFrame, starts: list[list[int]], rounds: int = 10, id: str = "vec_id", vector: str = "vector",
                    dimensions: int | None = None) -> Clustering:
    """``rounds`` times: assign every vector to the nearest of the centroids (at first ``starts``), put every non-empty centroid at the floor
    of its vectors' mean; then assign once more. ``vectors`` has an id and an array<long>."""
    spark = vectors.sparkSession
    if not starts:
        return Clustering(spark.createDataFrame([], "id long, cluster int, distance long"),
                          spark.createDataFrame([], "cluster int, n long, inertia long, centroid array<long>"), 0, [])
    d, k = dimensions or len(starts[0]), len(starts)
    v = F.col(vector).cast("array<long>")
    own = (vectors.select(F.col(id).cast("long").alias("id"), v.alias("v"))
           .filter(F.col("v").isNotNull() & (F.size("v") == d) & ~F.exists("v", lambda e: e.isNull())))
    size = max(1, BLOCK_NUMBERS // (d + k))

    def packed(ids, x, history, cluster, distance, seen):
        cluster, evaluated = assign(x, history, cluster, distance, seen)
        row = {"ids": ids, "vectors": x.astype("<i4").tobytes(), "cluster": cluster.astype("<i4").tobytes(), "distance": distance.tobytes(),
               "seen": seen.tobytes(), "clusters": _sums(x, cluster, history[-1]), "evaluated": evaluated}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema([(c, pa.binary()) for c in ("ids", "vectors", "cluster", "distance", "seen")] + [
        ("clusters", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("inertia", pa.int64()), ("sums", pa.list_(pa.int64()))]))),
        ("evaluated", pa.int64())])

    def first(history):
        def run(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, size):
                    part = batch.slice(i, size)
                    x = _matrix(part["v"], d)
                    ids = pa.ipc.new_stream(sink := pa.BufferOutputStream(), pa.schema([("id", pa.int64())]))
                    ids.write_batch(pa.RecordBatch.from_arrays([part["id"]], ["id"]))
                    ids.close()
                    yield packed(sink.getvalue().to_pybytes(), x, history.value, np.zeros(len(x), np.int64), np.zeros((len(x), k)), np.zeros((len(x), k), "<i4"))
        return run

    def again(history):
        def run(batches):
            for batch in batches:
                for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                    x = np.frombuffer(r["vectors"], "<i4").reshape(-1, d).astype(np.int64)
                    yield packed(r["ids"], x, history.value, np.frombuffer(r["cluster"], "<i4").astype(np.int64),
                                 np.frombuffer(r["distance"], float).reshape(-1, k).copy(), np.frombuffer(r["seen"], "<i4").reshape(-1, k).copy())
        return run

    def result(centroids):
        def run(batches):
            for batch in batches:
                for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                    cluster = np.frombuffer(r["cluster"], "<i4")
                    x = np.frombuffer(r["vectors"], "<i4").reshape(-1, d).astype(np.int64)
                    ids = pa.ipc.open_stream(r["ids"]).read_all().combine_chunks().column("id")
                    yield pa.RecordBatch.from_arrays([ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, pa.array(cluster, pa.int32()),
                                                      pa.array(((x - centroids.value[cluster]) ** 2).sum(axis=1), pa.int64())], ["id", "cluster", "distance"])
        return run

    history, written, evaluated = np.array([starts], np.int64), _Rounds(spark), []
    for turn in range(rounds + 1):
        sent = spark.sparkContext.broadcast(history)  # rounds * k * d numbers
        blocks = own.mapInArrow(first(sent), BLOCKS) if not turn else blocks.select("ids", "vectors", "cluster", "distance", "seen").mapInArrow(again(sent), BLOCKS)
        blocks = written.write(blocks)
        sent.unpersist()
        evaluated.append(blocks.agg(F.sum("evaluated")).first()[0] or 0)
        totals = _totals(blocks, d)
        if turn < rounds:
            centroids = history[-1].copy()
            for j, (n, _, sums) in totals.items():
                centroids[j] = [s // n for s in sums]  # Python integers: the exact floor
            history = np.concatenate([history, centroids[None]])
    found = blocks.select("ids", "vectors", "cluster").mapInArrow(result(spark.sparkContext.broadcast(history[-1])), "id long, cluster int, distance long")
    rows = [(j, *totals.get(j, (0, 0))[:2], history[-1][j].tolist()) for j in range(k)]
    return Clustering(found, spark.createDataFrame(rows, "cluster int, n long, inertia long, centroid array<long>"), sum(r[2] for r in rows), evaluated)


def hashed_starts(vectors: DataFrame, k: int, seed: int, id: str = "vec_id", vector: str = "vector") -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of the seed and the id, in that order; k vectors come to the driver."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(key.cast("binary"), 256).alias("h"), F.col(vector).alias("v")).orderBy("h", "v").limit(k).collect()
    return [list(r["v"]) for r in rows]
