"""Class-incremental learners on frozen vectors, compared over the same staged rounds.

A round brings rows with discovered labels. Learners keep bounded memories; heads are trained from those and the
round's rows, on the driver where they are few and as sums of gradients over partitions otherwise.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexilar.functions.vectors import unit
from vexilar.operators import metrics, prototypes, reports
from vexilar.plans.discovery import predict_head, train_head, train_head_on
from vexilar.session import materialize

LEARNERS = ("finetune", "lwf", "eeil", "icarl", "tpcil", "doi")
#: Rows that a head is trained on by the driver; more are left where they are.
LOCAL_ROWS = 50_000


def _head(df: DataFrame, *args, **options) -> tuple[np.ndarray, np.ndarray]:
    if df.count() > LOCAL_ROWS:
        return train_head_on(df, *args, **options)
    rows = df.select("label", "v").orderBy("id").collect()
    return train_head(np.array([r["v"] for r in rows]), np.array([r["label"] for r in rows]), *args, **options)


def run_learner(name: str, known: DataFrame, rounds: list[DataFrame], evaluation: DataFrame, per_class: int = 20, smoothing: float = 0.20, start: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(method, stage, overall, old_acc, new_acc, initial_acc, forgetting) after day 1 and each round.

    known, rounds and evaluation: id, label, v. finetune trains on new rows alone, lwf also distils the old head, eeil
    adds exemplars to that; icarl, tpcil and doi predict by prototypes: of exemplars, of exemplars smoothed over their
    graph, and of old prototypes moved towards the new exemplars'. start: the head of day 1, if it is trained already.
    """
    seen = initial = known.agg(F.max("label")).first()[0] + 1
    exemplars = lambda df: df.join(prototypes.nearest_to_mean(df, per_class).select("id"), "id").select("id", "label", "v")
    memory = materialize(exemplars(known), "exemplars")
    head = (start or _head(known, seen)) if name in LEARNERS[:3] else None
    protos = prototypes.make_prototypes(unit(memory, "v"))
    out, reference, old = [], None, seen
    for k, new in enumerate([None, *rounds]):
        if new is not None:
            old, seen = seen, new.agg(F.max("label")).first()[0] + 1
            memory = materialize(memory.unionByName(exemplars(new)), "exemplars")
            if head is not None:
                rows = new.unionByName(memory.where(F.col("label") < old)) if name == "eeil" else new
                head = _head(rows.select("id", "label", "v"), seen, head, 0.0 if name == "finetune" else 1.0)
            else:
                now = prototypes.make_prototypes(unit(memory, "v"))
                protos = prototypes.align(protos, now) if name == "doi" else prototypes.smooth(now, smoothing) if name == "tpcil" else now
                protos = materialize(protos.select("label", "v"), "protos")
        rows = evaluation.where(F.col("label") < seen)
        pred = predict_head(rows, *head) if head is not None else prototypes.predict(rows, protos)
        judged = materialize(rows.select("id", "label").join(pred.select("id", "pred"), "id"), "judged")
        stage = metrics.stage_accuracy(judged, old if new is not None else seen, seen, initial, reference).withColumn("method", F.lit(name)).withColumn("stage", F.lit("Initial" if new is None else f"After R{k}"))
        reference = stage.first()["initial_acc"] if new is None else reference
        out.append(stage)
    return reports.union_rows(*out).select("method", "stage", "n", "overall", "old_acc", "new_acc", "initial_acc", "forgetting")


def compare(known: DataFrame, rounds: list[DataFrame], evaluation: DataFrame, learners: tuple[str, ...] = LEARNERS, **options) -> DataFrame:
    """The stages of all learners, one row a learner and stage."""
    # learners with a head begin with the same one
    start = _head(known, known.agg(F.max("label")).first()[0] + 1) if set(learners) & set(LEARNERS[:3]) else None
    return reports.union_rows(*(run_learner(n, known, rounds, evaluation, start=start, **options) for n in learners))


def wide(stages: DataFrame, rounds: int, metric: str = "overall") -> DataFrame:
    """One row a method with the metric after each round and its mean."""
    return reports.pivot_rounds(stages, ["method"], "stage", ["Initial", *(f"After R{k}" for k in range(1, rounds + 1))], metric)
