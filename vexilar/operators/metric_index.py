"""A metric index for exact neighbour searches: rows in balls around pivots, of which a query visits few.

Every row lies in the ball of its nearest pivot, with its distance to it. By the triangle inequality no row of a ball is
nearer to a query than the distance to the pivot less the ball's radius; nor than the query's distance to the plane
midway between the ball's pivot and the query's own. A search looks into the query's own ball first. The distance of its
k-th row there bounds the rest: balls that can't hold a nearer row aren't visited, and in the others only rows whose
distance to the pivot is within the bound of the query's. Nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexilar.operators.knn import STRIP, _distances, _matrix, _nearest, _rows, matrix, near_rows
from vexilar.session import materialize, ship

#: Pivots at most; twice the square root of the rows up to there.
MOST_PIVOTS = 2_048
#: Share of the vectors' size by which bounds give way to rounding.
SLACK = 1e-6


def points(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows between which Euclidean distances order as the metric does: unit rows for cosines, and one place more that tells zero rows."""
    if metric == "euclidean":
        return x
    return np.hstack([_rows(x, metric), (np.linalg.norm(x, axis=1, keepdims=True) == 0).astype(float)])


@dataclass
class Balls:
    """rows: (id, v, ball, r), stored; pivots: as points; radii and sizes by ball."""

    rows: DataFrame
    metric: str
    pivots: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def build(df: DataFrame, metric: str = "euclidean", n: int | None = None, pivots: int | None = None) -> Balls:
        """The index of (id, v). Pivots are rows, chosen by a hash of the id."""
        spark = df.sparkSession
        ship(spark)
        n = df.count() if n is None else n
        m = pivots or max(1, min(MOST_PIVOTS, int(2 * n**0.5)))
        first = df.orderBy(F.xxhash64("id"), "id").limit(m).select("v").toArrow().combine_chunks()  # m rows
        chosen = np.unique(points(matrix(first.column("v").combine_chunks()), metric), axis=0)
        sent = spark.sparkContext.broadcast((chosen, (chosen * chosen).sum(axis=1)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, sq = sent.value
            for batch in batches:
                x = points(matrix(batch.column("v")), metric)
                d = [_distances(x[k : k + STRIP], p, sq) for k in range(0, len(x), STRIP)]
                ball = np.concatenate([y.argmin(axis=1) for y in d]) if d else np.zeros(0, np.int64)
                r = np.concatenate([y.min(axis=1) for y in d]) if d else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(ball.astype(np.int32)), pa.array(r)], names=["id", "v", "ball", "r"])

        rows = materialize(df.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(deal, f"id {dict(df.dtypes)['id']}, v array<double>, ball int, r double"), "balls")
        radii, sizes = np.zeros(len(chosen)), np.zeros(len(chosen), np.int64)
        for b in rows.groupBy("ball").agg(F.max("r").alias("r"), F.count("*").alias("n")).collect():  # a row a pivot
            radii[b["ball"]], sizes[b["ball"]] = b["r"], b["n"]
        return Balls(rows, metric, chosen, radii, sizes)

    def _visits(self, queries: DataFrame, k: int, own_only: bool) -> DataFrame:
        """(ball, id, v, dq, bound) of queries (id, v, and bound unless own_only): the balls that may hold one of the k nearest."""
        tables = (self.pivots, self.radii, self.sizes, _distances(self.pivots, self.pivots, (self.pivots**2).sum(axis=1)))
        sent, metric = queries.sparkSession.sparkContext.broadcast(tables), self.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, radii, sizes, between = sent.value
            sq, full = (p * p).sum(axis=1), np.flatnonzero(sizes)
            for batch in batches:
                x = points(matrix(batch.column("v")), metric)
                for lo in range(0, len(x), STRIP):
                    q = x[lo : lo + STRIP]
                    d = _distances(q, p, sq)
                    own = full[d[:, full].argmin(axis=1)] if len(full) else np.zeros(len(q), np.int64)
                    rows = np.arange(len(q))
                    far = d + radii  # all rows of a ball are at most that far
                    far[:, sizes == 0] = np.inf
                    order = far.argsort(axis=1)
                    enough = (np.cumsum(sizes[order], axis=1) >= k).argmax(axis=1)
                    whole = far[rows, order[rows, enough]] if sizes.sum() >= k else np.full(len(q), np.inf)
                    if own_only:
                        row, ball, bound = rows, own, whole
                    else:
                        bound = np.minimum(whole, batch.column("bound").to_numpy(zero_copy_only=False)[lo : lo + STRIP])
                        with np.errstate(divide="ignore", invalid="ignore"):
                            plane = (d * d - (d[rows, own] ** 2)[:, None]) / (2 * between[own])
                        least = np.maximum(d - radii, np.where(np.isfinite(plane), plane, 0.0))
                        slack = SLACK * (np.sqrt((q * q).sum(axis=1))[:, None] + np.sqrt(sq) + 1e-9)
                        visit = (least - slack <= bound[:, None]) & (sizes > 0)
                        visit[rows, own] = False
                        row, ball = np.nonzero(visit)
                        bound = bound[row]
                    at = pa.array(lo + row)
                    yield pa.RecordBatch.from_arrays([pa.array(ball.astype(np.int32)), batch.column("id").take(at), batch.column("v").take(at), pa.array(d[row, ball]), pa.array(bound)], names=["ball", "id", "v", "dq", "bound"])

        columns = ["id", "v"] if own_only else ["id", "v", "bound"]
        return queries.select(*columns).mapInArrow(run, f"ball int, id {dict(queries.dtypes)['id']}, v array<double>, dq double, bound double")

    def _met(self, visits: DataFrame, k: int, include_self: bool, part_rows: int) -> DataFrame:
        """(src, dst, w) of the k nearest in each visited part of a ball; a row without src holds pairs compared in dst.

        Balls, and the queries that visit one, are dealt to parts of bounded size.
        """
        asked = {r["ball"]: r["n"] for r in visits.groupBy("ball").agg(F.count("*").alias("n")).collect()}  # a row a ball
        parts = [(b, max(1, -(-int(self.sizes[b]) // part_rows)), max(1, -(-n // part_rows))) for b, n in asked.items()]
        if not parts:
            return visits.sparkSession.createDataFrame([], "src bigint, dst bigint, w double")
        table = lambda: F.broadcast(visits.sparkSession.createDataFrame(parts, "ball int, bn int, qn int"))  # noqa: E731 - a row a ball
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        q = visits.join(table(), "ball").withColumn("qp", deal("id", "qn")).withColumn("bp", F.explode(F.sequence(F.lit(0), F.col("bn") - 1)))
        b = self.rows.join(table(), "ball").withColumn("bp", deal("id", "bn")).withColumn("qp", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)))
        metric = self.metric

        def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out, compared = [], 0
            if len(left) and len(right):
                right = right.sort_values(["r", "id"], kind="stable")
                left = left.sort_values("dq", kind="stable")
                ids, own, r = right["id"].to_numpy(), left["id"].to_numpy(), right["r"].to_numpy()
                x, y = _rows(_matrix(left["v"]), metric), _rows(_matrix(right["v"]), metric)
                sq, dq, bound = (y * y).sum(axis=1), left["dq"].to_numpy(), left["bound"].to_numpy()
                bound = bound + SLACK * (np.sqrt((x * x).sum(axis=1)) + np.sqrt(sq.max()) + 1e-9)
                for lo in range(0, len(x), STRIP):
                    some = slice(lo, lo + STRIP)
                    a = np.searchsorted(r, (dq[some] - bound[some]).min())
                    z = np.searchsorted(r, (dq[some] + bound[some]).max(), side="right")
                    if z <= a:
                        continue
                    near = np.arange(a, z)[np.argsort(ids[a:z], kind="stable")]  # ties then fall to the smaller id
                    w = near_rows(x[some], y[near], sq[near], metric)
                    compared += w.size
                    if not include_self:
                        w[own[some, None] == ids[near][None, :]] = -np.inf
                    row, col = _nearest(w, k)
                    out.append(pd.DataFrame({"src": own[lo + row], "dst": ids[near[col]], "w": w[row, col]}))
            out.append(pd.DataFrame({"src": [None], "dst": [compared], "w": [0.0]}))
            found = pd.concat(out).astype({"src": "Int64", "dst": "int64", "w": "float64"})
            return found[np.isfinite(found["w"])]

        return q.groupBy("ball", "bp", "qp").cogroup(b.groupBy("ball", "bp", "qp")).applyInPandas(block, "src bigint, dst bigint, w double")

    def nearest(self, queries: DataFrame, k: int, include_self: bool = True, part_rows: int = 50_000) -> tuple[DataFrame, int]:
        """((src, dst, w), pairs compared): the k nearest rows of each query (id, v), w the cosine or minus the distance."""
        want = k if include_self else k + 1
        first = materialize(self._met(self._visits(queries, want, True), k, include_self, part_rows), "own_balls")
        reach = (F.sqrt(F.greatest(2 - 2 * F.min("w"), F.lit(0.0))) if self.metric == "cosine" else -F.min("w")).alias("bound")
        bounds = first.where("src is not null").groupBy("src").agg(reach, F.count("*").alias("n")).where(F.col("n") >= k).select("src", "bound")
        bounded = queries.join(bounds, queries["id"] == bounds["src"], "left").select("id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        second = materialize(self._met(self._visits(materialize(bounded, "bounded"), want, False), k, include_self, part_rows), "other_balls")
        every = first.union(second)
        compared = every.where("src is null").agg(F.sum("dst")).first()[0] or 0
        rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
        return every.where("src is not null").withColumn("_r", rank).where(F.col("_r") <= k).drop("_r"), compared
