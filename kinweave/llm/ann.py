"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots, in order. It is posted in the inverted files of the first few of
them; long vectors, which may be the largest inner product from far away, in more. A query probes the files of
its own nearest pivots and handles each vector it meets once, in the file of the first pivot they share.
Vectors are ranked by the footrule distance of their order to the query's, times their norm, and those above the
query's threshold are ranked again by the exact inner product. The threshold is a quantile of the same rank over
the sample of the pivots, so that about a fixed share of all rows is ranked again. Files are split into blocks of
bounded size, by members and by queries, and copies of a vector share one posting.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.durable import durable


#: Numbers of a table of vectors by pivots that are held at a time.
SLICE = 1 << 22


@dataclass(frozen=True)
class AnnParams:
    """k: neighbours of a query. pivots: times the square root of the number of distinct vectors, at least min_pivots (all
    vectors, if fewer) and at most max_pivots (a bounded sample of them). order: pivots that represent a vector. post: of these, files that a vector of median norm
    is in. probe: files that a query looks into; beyond probe_from pivots more, with the root of their number. share: of all vectors that is ranked again, but at least_times k of
    them. block: mean members, and half as many queries, that a task handles at a time."""

    k: int = 20
    pivots: float = 2.0
    min_pivots: int = 320
    max_pivots: int = 16_384
    order: int = 128
    post: int = 8
    probe: int = 64
    probe_from: int = 1000
    share: float = 0.08
    at_least_times: int = 10
    block: int = 8192


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part, once each: no nulls, zero vectors or components that are not finite.

    Inner products need one length: rows whose vector is not as long as most are left out too (the shorter length of
    two equally common).
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    )
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (size.n if size else 0)).distinct()


def _ordered(vectors: np.ndarray, pivots: np.ndarray, order: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; nearness is the cosine."""
    order = min(order, len(pivots))
    out, step = np.empty((len(vectors), order), np.int32), max(1, SLICE // len(pivots))
    for low in range(0, len(vectors), step):
        near = vectors[low : low + step] @ pivots.T
        some = np.argpartition(-near, order - 1, axis=1)[:, :order]
        place = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
        out[low : low + step] = np.take_along_axis(some, place, 1)
    return out


def footrule(members: np.ndarray, query: np.ndarray, n_pivots: int) -> np.ndarray:
    """Footrule distance of each member's pivot order to the query's; a pivot that is missing counts as last but one."""
    m = len(query)
    return _footrule(_places(query, n_pivots)[members], m)


def _places(query: np.ndarray, n_pivots: int) -> np.ndarray:
    """The place of each pivot in an order; its length for pivots that are not in it."""
    place = np.full(n_pivots, len(query), np.int16)
    place[query] = np.arange(len(query))
    return place


def _footrule(at: np.ndarray, m: int) -> np.ndarray:
    far = np.abs(at - np.arange(m, dtype=np.int16)) - (m - at)
    return far.sum(1, dtype=np.int32) + (m * (m + 1)) // 2


class Index:
    """The pivots, and the orders and norms of the sample they come from."""

    def __init__(self, sample: np.ndarray, params: AnnParams, n: int):
        self.params, self.sample = params, sample
        self.norms = np.linalg.norm(sample, axis=1)
        self.pivots = sample / np.maximum(self.norms[:, None], 1e-300)
        self.m = min(params.order, len(sample))
        # as the table grows, neighbours come nearer but files more; found by simulation up to 10^8 vectors
        self.probe = min(len(sample), int(np.ceil(params.probe * max(1.0, len(sample) / params.probe_from) ** 0.5)))
        self.orders = _ordered(sample, self.pivots, self.m)
        self.typical = max(float(np.median(self.norms)), 1e-300)
        self.share = min(1.0, max(params.share, params.at_least_times * params.k / n))

    def files(self, vectors: np.ndarray) -> np.ndarray:
        """How many files each vector is in: ``post`` for a median norm, more with its square."""
        size = np.linalg.norm(vectors, axis=1) / self.typical
        return np.clip(np.rint(self.params.post * np.minimum(size, 1e3) ** 2), self.params.post, self.m).astype(np.int64).clip(max=self.m)

    def threshold(self, order: np.ndarray) -> tuple[float, float]:
        """(mean footrule distance of the sample, least rank to be ranked again) for a query's order."""
        far = _footrule(_places(order[: self.m], len(self.pivots))[self.orders], self.m)
        mean = float(far.mean())
        if self.share >= 1:
            return mean, -np.inf
        return mean, float(np.quantile(self.norms * (mean - far), 1 - self.share))


def search(vectors: DataFrame, params: AnnParams | None = None, every: int = 20) -> DataFrame:
    """The nearest rows of ``vectors(vec_id, embedding)`` for every row whose vec_id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score (inner product in double precision), at most k a query,
    ties to the smaller vec_id. A query's own vec_id is no candidate. Repeated rows count once. An empty table, or
    one without usable vectors, gives no rows.
    """
    params = params or AnnParams()
    rows = durable(usable(vectors))
    key = F.xxhash64("vector").alias("key")
    number = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("number", number).where(F.col("number") <= params.k + 1)
    distinct = durable(
        few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(key, "vector", "ids")
    )
    queries = durable(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), key))
    n = distinct.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wanted = min(n, params.max_pivots, max(params.min_pivots, int(params.pivots * n**0.5)))
    sample = distinct.orderBy("key").limit(wanted).select("vector").toPandas()
    index = Index(np.array(sample["vector"].tolist(), np.float64).reshape(len(sample), -1), params, n)

    def represent(batches):
        for batch in batches:
            if batch.num_rows:
                values = np.array(batch.column("vector").to_pylist(), np.float64)
                own = _ordered(values, index.pivots, index.m).astype("<u2")
                n_files = index.files(values)
                yield pa.RecordBatch.from_arrays([
                    batch.column("key"), batch.column("ids"), pa.array([v.tobytes() for v in values], pa.binary()), pa.array([o.tobytes() for o in own], pa.binary()),
                    pa.array([o[:k].astype(np.int32) for o, k in zip(own, n_files, strict=True)], pa.list_(pa.int32())),
                ], names=["key", "ids", "vector", "own", "files"])

    ordered = durable(
        distinct.mapInArrow(represent, "key long, ids array<long>, vector binary, own binary, files array<int>")
    )

    def limits(batches):
        for batch in batches:
            values = np.array([np.frombuffer(v) for v in batch.column("q_vector").to_pylist()]).reshape(batch.num_rows, -1)
            own = _ordered(values, index.pivots, max(index.m, index.probe)).astype("<u2") if batch.num_rows else []
            found = [index.threshold(o) for o in own]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([o.tobytes() for o in own], pa.binary()), pa.array([o[: index.probe].astype(np.int32) for o in own], pa.list_(pa.int32())),
                *(pa.array([x[i] for x in found], pa.float64()) for i in (0, 1)),
            ], names=[*batch.schema.names, "q_own", "probes", "q_mean", "q_least"])

    asked = ordered.join(queries.select("key").distinct(), "key", "left_semi").select(F.col("key").alias("q_key"), F.col("vector").alias("q_vector"))
    asked = durable(asked.mapInArrow(limits, "q_key long, q_vector binary, q_own binary, probes array<int>, q_mean double, q_least double"))
    parts = lambda size: F.ceil(F.col("n") / size).cast("int")
    n_members = ordered.select(F.explode("files").alias("pivot")).groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).select("pivot", parts(params.block).alias("blocks"))
    n_queries = asked.select(F.explode("probes").alias("pivot")).groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).select("pivot", parts(-(-params.block // 2)).alias("turns"))
    sizes = durable(n_members.join(n_queries, "pivot"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    posted = ordered.select("key", F.col("ids")[0].alias("least_id"), "vector", "own", F.size("files").alias("n_files"), F.explode("files").alias("pivot"))
    members = posted.join(sizes, "pivot").withColumn("block", F.pmod("key", "blocks").cast("int")).withColumn("turn", upto("turns")).drop("blocks", "turns")
    probing = asked.select("q_key", "q_vector", "q_own", "q_mean", "q_least", F.explode("probes").alias("pivot")).join(sizes, "pivot")
    probing = probing.select(
        "q_key", "q_vector", "q_own", "q_mean", "q_least", F.col("pivot").alias("q_pivot"), F.pmod("q_key", "turns").cast("int").alias("q_turn"),
        upto("blocks").alias("q_block"),
    )

    def rank(found: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"key": [], "found": [], "least_id": [], "score": []})
        if not len(found) or not len(probes):
            return empty
        values = np.frombuffer(b"".join(found["vector"]), np.float64).reshape(len(found), -1)
        own = np.frombuffer(b"".join(found["own"]), "<u2").reshape(len(found), -1)
        n_files = found["n_files"].to_numpy()
        widest = int(n_files.max())
        absent = np.arange(widest) >= n_files[:, None] if n_files.min() < widest else None
        norms = np.linalg.norm(values, axis=1)
        keys, least_ids = found["key"].to_numpy(), found["least_id"].to_numpy()
        pivot, out = int(found["pivot"].iloc[0]), []
        for q_key, q_vector, q_own, mean, least in zip(probes["q_key"], probes["q_vector"], probes["q_own"], probes["q_mean"], probes["q_least"], strict=True):
            meets = _places(np.frombuffer(q_own, "<u2"), len(index.pivots))
            at = meets[own[:, :widest]]
            if absent is not None:
                at[absent] = len(index.pivots)
            here = np.flatnonzero(at.min(1) == meets[pivot])
            far = _footrule(np.minimum(meets, index.m)[own[here]], index.m)
            near = here[norms[here] * (mean - far) >= least]
            if not len(near):
                continue
            q = np.frombuffer(q_vector, np.float64)
            rough = values[near] @ q
            edge = np.partition(rough, -params.k - 1)[-params.k - 1] if len(near) > params.k + 1 else -np.inf
            best = near[rough >= edge - 1e-9 * abs(edge)] if edge > -np.inf else near
            out.append(pd.DataFrame({"key": q_key, "found": keys[best], "least_id": least_ids[best], "score": (values[best] * q).sum(1)}))
        return pd.concat(out) if out else empty

    hits = members.groupBy("pivot", "block", "turn").cogroup(probing.groupBy("q_pivot", "q_block", "q_turn")).applyInPandas(
        rank, "key long, found long, least_id long, score double"
    )
    by_key = Window.partitionBy("key").orderBy(F.desc("score"), "least_id")
    best = hits.withColumn("n", F.row_number().over(by_key)).where(F.col("n") <= params.k + 1).drop("n")
    ids = ordered.select(F.col("key").alias("found"), "ids")
    each = best.join(ids, "found").select("key", "score", F.explode("ids").alias("vec_id"))
    joined = queries.join(each, "key").where("vec_id <> query_id")
    ranked = joined.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= params.k).select("query_id", "rank", "vec_id", "score")


def op6_permutation_index(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
