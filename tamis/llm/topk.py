"""Exact top-k search by inner product over integer vectors.

Vectors are ranked by length and cut into blocks, longest first, and rotated into the singular directions of the whole table (from
its Gram matrix, summed on the executors; the driver sees d * d numbers). A task takes a group of queries through a stripe of
blocks. A block is skipped for a query when the product of the lengths cannot reach the query's k-th score so far; inside a
block the product over the first rotated coordinates plus the Cauchy-Schwarz bound on the rest rules out candidates, and what is
left gets its exact integer product. Stripes and groups have fixed sizes: more data are more tasks. The k best
of each stripe are merged by a window per query.

Defined results: vectors that are null or hold a null, and rows without id, take no part, neither as query nor as candidate;
shorter vectors count as padded with zeros; a candidate with the query's own id is left out; repeated candidate rows
are candidates each; a query row given twice counts once; fewer than k candidates are returned all. Scores must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import partitions

BLOCK, STRIPE, GROUP, HEAD = 1024, 16_384, 2048, 16
NONE = np.iinfo(np.int64).min


def _matrix(column, d) -> np.ndarray:
    """A list column as int64 rows of d numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (sizes == d).all():
        return flat.reshape(-1, d).astype(np.int64)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(x) for x in sizes]) if len(sizes) else []] = flat
    return out


def _numbers(blob, d):
    return np.frombuffer(blob, "<i8").reshape(-1, d)


def _numbered(n):
    """A row for each number below n."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


class _Search:
    """The queries of a group and their best candidates so far."""

    def __init__(self, ids, vectors, rotation, k):
        self.ids, self.exact, self.k = ids, vectors, k
        self.rotation = rotation
        self.turned = vectors @ rotation
        self.rest = np.sqrt(np.maximum((self.turned[:, HEAD:] ** 2).sum(axis=1), 0))
        self.length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        self.scores = np.full((len(ids), k), NONE, np.int64)
        self.found = np.full((len(ids), k), NONE, np.int64)

    def reach(self):
        """The score that a candidate must reach, by query."""
        worst = self.scores[:, -1]
        return np.where(worst == NONE, -np.inf, worst.astype(float))

    def see(self, ids, vectors):
        lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        longest, reach = lengths.max(initial=0.0), self.reach()
        # room for the rounding of bounds: they may keep too much, never too little
        slack = 1e-9 * (self.length * longest + 1)
        live = np.flatnonzero(self.length * longest + slack >= reach)
        if not len(live):
            return
        turned = vectors @ self.rotation
        rest = np.sqrt(np.maximum((turned[:, HEAD:] ** 2).sum(axis=1), 0))
        bound = self.turned[live, :HEAD] @ turned[:, :HEAD].T
        bound += np.outer(self.rest[live], rest)
        maybe = bound + slack[live, None] >= reach[live, None]
        for row in np.flatnonzero(np.isin(self.ids[live], ids)):
            maybe[row, ids == self.ids[live[row]]] = False
        row, col = np.nonzero(maybe)
        if not len(row):
            return
        whole = max(np.abs(vectors).max(initial=0), 1) * float(max(np.abs(self.exact).max(initial=0), 1)) * vectors.shape[1] >= 2.0 ** 53
        a, b = (self.exact, vectors) if whole else (self.exact.astype(float), vectors.astype(float))
        if len(row) * 4 > maybe.size:
            score = (a[live] @ b.T)[row, col]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", a[live[row[i:i + 65536]]], b[col[i:i + 65536]]) for i in range(0, len(row), 65536)])
        score = score.astype(np.int64)
        keep = score >= np.where(np.isinf(reach[live]), NONE, self.scores[live, -1])[row]
        row, score, found = row[keep], score[keep], ids[col[keep]]
        self._merge(live, row, score, found)

    def _merge(self, live, row, score, found):
        touched = np.unique(row)
        old = live[touched]
        row = np.concatenate([np.repeat(touched, self.k), row])
        score = np.concatenate([self.scores[old].ravel(), score])
        found = np.concatenate([self.found[old].ravel(), found])
        real = score != NONE
        row, score, found = row[real], score[real], found[real]
        order = np.lexsort((found, -score, row))
        row, score, found = row[order], score[order], found[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best = rank < self.k
        for name, values in (("scores", score), ("found", found)):
            fresh = np.full((len(live), self.k), NONE, np.int64)
            fresh[row[best], rank[best]] = values[best]
            getattr(self, name)[old] = fresh[touched]

    def result(self, g):
        at, rank = np.nonzero(self.scores != NONE)
        return pa.RecordBatch.from_pydict({
            "g": pa.array(np.full(len(at), g)), "row": pa.array(at), "query_id": pa.array(self.ids[at]),
            "vec_id": pa.array(self.found[at, rank]), "score": pa.array(self.scores[at, rank])})


def _rotation(base: DataFrame, d: int) -> np.ndarray:
    """Singular directions of the table, the strongest first."""

    def gram(batches):
        total = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch["v"], d).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(d)), "x": pa.array(list(total), pa.list_(pa.float64()))})

    rows = (base.select("v").mapInArrow(gram, "i long, x array<double>").groupBy("i")
            .agg(F.array(*[F.sum(F.col("x")[j]) for j in range(d)]).alias("x")).collect())  # d rows
    total = np.zeros((d, d))
    for r in rows:
        total[r["i"]] = r["x"]
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def top_k(base: DataFrame, queries: DataFrame, k: int = 20, id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): for every query its k largest inner products with rows of ``base``, ties to
    the smaller id. Both frames have an id and an array<long>."""
    spark = base.sparkSession

    def own(df):
        v = F.col(vector).cast("array<long>")
        return (df.select(F.col(id).cast("long").alias("id"), v.alias("v"))
                .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())))

    base, queries = own(base), own(queries).distinct()
    d, n = base.agg(F.max(F.size("v")), F.count("*")).first()
    dq, n_queries = queries.agg(F.max(F.size("v")), F.count("*")).first()
    d = max(d or 0, dq or 0, 1)
    groups, stripes = max(1, -(-n_queries // GROUP)), max(1, -(-n // STRIPE))
    turn = spark.sparkContext.broadcast(_rotation(base, d))  # d * d numbers

    def group(key, table):
        return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "longest": pa.array([float("inf")]),
                         "ids": pa.array([table["id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                         "vectors": pa.array([_matrix(table["v"], d).astype("<i8").tobytes()], pa.binary())})

    def blocks(batches):
        for batch in batches:  # rows come longest first
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                x = _matrix(part["v"], d)
                yield pa.RecordBatch.from_pydict({
                    "longest": pa.array([float(np.sqrt((x.astype(float) ** 2).sum(axis=1)).max())]),
                    "ids": pa.array([part["id"].to_numpy().astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([x.astype("<i8").tobytes()], pa.binary())})

    length = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    asked = (queries.withColumn("g", F.pmod(F.xxhash64("id", "v"), F.lit(groups))).groupBy("g")
             .applyInArrow(group, "g long, longest double, ids binary, vectors binary")
             .select("g", _numbered(stripes).alias("s"), F.lit(0).alias("kind"), "longest", "ids", "vectors"))
    ranked = base.repartitionByRange(partitions(spark), length.desc()).sortWithinPartitions(length.desc())
    sought = (ranked.mapInArrow(blocks, "longest double, ids binary, vectors binary")
              .withColumn("s", F.pmod(F.xxhash64("ids"), F.lit(stripes)))
              .select(_numbered(groups).alias("g"), "s", F.lit(1).alias("kind"), "longest", "ids", "vectors"))

    def search(batches):
        now, state = None, None
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids, vectors = np.frombuffer(r["ids"], "<i8"), _numbers(r["vectors"], d)
                if (r["g"], r["s"]) != now:
                    if state is not None:
                        yield state.result(now[0])
                    now, state = (r["g"], r["s"]), None
                if r["kind"] == 0:
                    state = _Search(ids, vectors, turn.value, k)
                elif state is not None:  # a group may have got no query
                    state.see(ids, vectors)
        if state is not None:
            yield state.result(now[0])

    best = (asked.unionByName(sought).repartition(partitions(spark), "g", "s").sortWithinPartitions("g", "s", "kind", F.desc("longest"))
            .mapInArrow(search, "g long, row long, query_id long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("g", "row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
