"""A replay memory as state of a stream: of each class the rows that a seeded hash puts first, a bounded number.

The rows kept are those that ``operators.prototypes.replay_memory`` draws from everything seen so far, however it was cut
into micro-batches. State is kept in the query's checkpoint, so a restarted query goes on with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vexilar.operators.splits import seeded_order
from vexilar.session import ship

#: Names and types of the state: a class's rows in order. Changing them makes old checkpoints unreadable.
STATE = "keys array<string>, ids array<bigint>, vectors array<array<double>>"
ROWS = "label bigint, rank int, id bigint, v array<double>"


def _first(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    return rows.sort_values(["key", "id"], kind="stable").drop_duplicates(["key", "id"]).groupby("label", sort=False).head(most)


def replay_stream(stream: DataFrame, per_class: int = 20, seed: int = 7) -> DataFrame:
    """(label, rank, id, v): after each micro-batch the whole memory of every class that the batch touched.

    stream: id, label and v, none of them null (other rows are left out); a repeated id is one row. Each task first drops
    the rows that can't stay, so at most ``per_class`` rows of a class and task are shuffled, and state is as bounded.
    """
    ship(stream.sparkSession)
    key = seeded_order("id", seed)[0]
    rows = stream.where("id is not null and label is not null and v is not null").select(F.col("label").cast("bigint").alias("label"), F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"), key.alias("key"))

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = _first(batch if held is None else pd.concat([held, batch]), per_class)
        if held is not None:
            yield held

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"key": [], "id": [], "v": []})
        if state.exists:
            keys, ids, vectors = state.get
            held = pd.DataFrame({"key": list(keys), "id": list(ids), "v": list(vectors)})
        for batch in batches:
            some = batch[["key", "id", "v"]]
            held = _first((some if not len(held) else pd.concat([held, some])).assign(label=key[0]), per_class)[["key", "id", "v"]]
        vectors = [[float(x) for x in v] for v in held["v"]]
        state.update((held["key"].tolist(), [int(i) for i in held["id"]], vectors))
        yield pd.DataFrame({"label": key[0], "rank": range(1, len(held) + 1), "id": held["id"].astype("int64").to_numpy(), "v": vectors})

    trimmed = rows.mapInPandas(trim, "label bigint, id bigint, v array<double>, key string")
    return trimmed.groupBy("label").applyInPandasWithState(keep, ROWS, STATE, "update", GroupStateTimeout.NoTimeout)


def run_replay(stream: DataFrame, path: str, per_class: int = 20, seed: int = 7) -> StreamingQuery:
    """Starts a query that takes what there is, batch by batch, and stops; memories go below ``path``, state with them.

    Started again on the same path it goes on where it, or a failed run, has stopped.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/memory/batch={number}")  # a batch that is repeated takes its own place

    return replay_stream(stream, per_class, seed).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """(label, rank, id, v): the last memory of every class that ``run_replay`` wrote."""
    every = spark.read.schema(f"{ROWS}, batch bigint").parquet(f"{path}/memory")
    last = every.groupBy(F.col("label").alias("_l")).agg(F.max("batch").alias("_b"))
    return every.join(F.broadcast(last), (F.col("label") == F.col("_l")) & (F.col("batch") == F.col("_b"))).select("label", "rank", "id", "v")  # a row a class
