"""Centroid clustering (k-means) in exact integers, with ns-bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._names import Named
from ._scratch import discard, materialize

#: Largest component kept: with it squared distances of 64 components fit a long.
MOST_COMPONENT = 1 << 27
#: Slack of bounds against rounding.
SLACK = 1e-9
#: Vectors worked on at once.
PIECE = 4096


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All exact squared distances; through a product of doubles where these are exact."""
    most = max(int(np.abs(x).max(initial=0)) for x in (vectors, centroids))
    if 4 * most * most * max(1, vectors.shape[1]) < 1 << 53:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (v @ c.T)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _below(squared: np.ndarray) -> np.ndarray:
    """Distances as floats of four bytes that are never too large."""
    return np.nextafter(np.sqrt(squared.astype(np.float64)).astype(np.float32), np.float32(0))


def first_assignment(vectors: np.ndarray, centroids: np.ndarray) -> dict[str, np.ndarray]:
    """State of vectors after all their distances were taken at round 0."""
    squared = squared_distances(vectors, centroids)
    cluster = squared.argmin(axis=1)
    return {"cluster": cluster, "own": squared[np.arange(len(vectors)), cluster], "low": _below(squared),
            "when": np.zeros(squared.shape, dtype=np.int16)}


def reassign(vectors: np.ndarray, state: dict[str, np.ndarray], history: np.ndarray) -> int:
    """Bring the state of vectors up to the last round of ``history`` (rounds, centroids,
    components); returns how many distances were taken.

    ``low[i, j]`` is the distance of vector i to centroid j as it was in round
    ``when[i, j]``.  It is loosened by the distance between that old place of the centroid
    and the present one, one vector difference however many rounds lie between.
    A centroid whose bound lies above the vector's own distance can't be nearest; every
    other one is measured again, exactly, and its entry renewed.
    """
    now = len(history) - 1
    moved = np.sqrt(((history - history[now]) ** 2).sum(axis=2).astype(np.float64)) * (1 + SLACK)
    n, k = state["low"].shape
    every, columns = np.arange(n), np.arange(k)
    cluster, when = state["cluster"], state["when"]
    floor = state["low"] - moved[when, columns]
    floor -= np.abs(floor) * SLACK
    own_when = when[every, cluster]
    top = np.sqrt(state["own"].astype(np.float64)) * (1 + SLACK) + moved[own_when, cluster]
    floor[every, cluster] = np.inf
    unsure = np.flatnonzero(floor.min(axis=1) <= top)
    if not len(unsure):
        return 0
    own = ((vectors[unsure] - history[now, cluster[unsure]]) ** 2).sum(axis=1)
    state["own"][unsure], when[unsure, cluster[unsure]] = own, now
    state["low"][unsure, cluster[unsure]] = _below(own)
    row, to = np.nonzero(floor[unsure] <= (np.sqrt(own.astype(np.float64)) * (1 + SLACK))[:, None])
    row = unsure[row]
    squared = ((vectors[row] - history[now, to]) ** 2).sum(axis=1)
    state["low"][row, to], when[row, to] = _below(squared), now
    # The least (distance, number) of those measured, the own one included.
    owner = np.concatenate([unsure, row])
    number = np.concatenate([cluster[unsure], to])
    distance = np.concatenate([own, squared])
    order = np.lexsort((number, distance, owner))
    first = order[np.concatenate(([True], np.diff(owner[order]) != 0))]
    state["cluster"][owner[first]], state["own"][owner[first]] = number[first], distance[first]
    return len(unsure) + len(row)


def _assign(columns: list[str], history: np.ndarray, exact_own: bool):
    """One round over batches; ``exact_own`` measures the own centroid of all at the end."""
    k, dims = history.shape[1:]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PIECE):
                piece = batch.slice(i, PIECE)
                n = piece.num_rows
                vectors = piece.column("_v").flatten().to_numpy().astype(np.int64).reshape(n, dims)
                if len(history) == 1:
                    state = first_assignment(vectors, history[0])
                else:
                    state = {"cluster": piece.column("_cluster").to_numpy().astype(np.int64), "own": piece.column("_own").to_numpy().copy()}
                    for name, kind in (("low", np.float32), ("when", np.int16)):
                        state[name] = np.frombuffer(b"".join(piece.column(f"_{name}").to_pylist()), dtype=kind).reshape(n, k).copy()
                    reassign(vectors, state, history)
                if exact_own:
                    state["own"] = ((vectors - history[-1, state["cluster"]]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in columns), piece.column("_v"), pa.array(state["cluster"], pa.int32()), pa.array(state["own"], pa.int64()),
                     *(pa.array([x.tobytes() for x in state[name]], pa.binary()) for name in ("low", "when"))],
                    names=[*columns, "_v", "_cluster", "_own", "_low", "_when"])
    return assign


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = 40, rounds: int = 5,
                      dims: int = 64, scale: int = 256, seed: int = 2, carry: Sequence[str] | None = None) -> DataFrame:
    """Cluster vectors around ``clusters`` centroids; one row for each vector that is kept.

    Components become ``floor(scale * x)``; all further arithmetic is exact.  The first
    centroids are the vectors with the least SHA-256 of ``<seed>:<id>`` (then the least
    components).  Each round assigns every vector to its nearest centroid (ties: the
    smaller number) and moves every centroid that has vectors to their mean, rounded
    down; then vectors are assigned once more.  Adds ``cluster``, ``distance`` (squared),
    ``cluster_inertia`` and ``inertia`` (distances of the cluster and of all) and
    ``centroid_sha256``.  ``carry`` names the columns to keep, all by default.

    A round is one pass without a shuffle over a stored table that holds each vector's
    bounds (``reassign``), and one aggregate of as many rows as clusters.  All earlier
    places of the centroids (rounds x clusters x dims numbers) go along with it; of the
    stored tables only the last is kept.  Nothing but centroids reaches the driver.

    Vectors that are null, have another number of components, or a null, non-finite or
    huge one (beyond 2**27 after scaling, so that distances fit) are left out.  A null
    id counts as an empty one.  Repeated rows are vectors of their own.  With fewer
    vectors than clusters each is a centroid; an empty table gives an empty result.
    Columns may have any names; those with the names of new ones are replaced.
    """
    added = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    named = Named(vectors, added, carry)
    spark = vectors.sparkSession
    id_col, vector_col = named.plain(id_col), named.plain(vector_col)
    columns = named.kept
    x = F.col(vector_col)
    fits = F.coalesce((F.size(x) == dims) & F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double")) * scale < MOST_COMPONENT, F.lit(False))), F.lit(False))
    whole = F.when(fits, F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("int")))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    state = materialize(named.df.select(*columns, whole.alias("_v"), F.sha2(name, 256).alias("_h")).where("_v is not null"))
    started = state.select("_h", "_v").orderBy("_h", "_v").limit(clusters).collect()
    new = T.StructType([T.StructField("_cluster", T.IntegerType()), T.StructField("_own", T.LongType()),
                        T.StructField("_low", T.BinaryType()), T.StructField("_when", T.BinaryType())])
    schema = T.StructType([*named.fields(), T.StructField("_v", T.ArrayType(T.IntegerType())), *new.fields])
    history = np.array([[r["_v"] for r in started]], dtype=np.int64).reshape(1, len(started), dims)
    for done in range(rounds + 1 if started else 0):
        before, state = state, materialize(state.mapInArrow(_assign(columns, history, done == rounds), schema))
        discard(before)
        if done < rounds:
            means = state.groupBy("_cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("_v", F.lit(i))).alias(f"s{i}") for i in range(dims)])
            now = history[-1].copy()
            for r in means.collect():  # one row a cluster
                now[r["_cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
            history = np.concatenate([history, now[None]])
    if not started:
        state = state.selectExpr(*columns, "cast(null as int) _cluster", "cast(null as long) _own")
    sums = {r["_cluster"]: int(r["s"]) for r in state.groupBy("_cluster").agg(F.sum(F.col("_own").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(sums.values())
    fitting = lambda n: n if n < 1 << 63 else None
    told = [(j, fitting(s), fitting(total), hashlib.sha256(",".join(map(str, history[-1, j])).encode()).hexdigest()) for j, s in sums.items()]
    facts = spark.createDataFrame(told, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # one row a cluster
    out = state.join(F.broadcast(facts), "_cluster")
    return named.back(out, F.col("_cluster").alias("cluster"), F.col("_own").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
