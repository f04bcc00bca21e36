"""Leakage-safe splits, seeded samples and audits. Random choices are by a seeded hash of the id: the same at any size of cluster, and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexilar.operators.prefix import running


def _place(keys: list[str], order: list[str | Column]) -> tuple[Column, Column]:
    w = Window.partitionBy(*keys)
    return F.row_number().over(w.orderBy(*order)), F.count(F.lit(1)).over(w)


def _ranked(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """``df`` with _rn and _n, a row's rank and its group's rows: groups are dealt by ranges, so that a large one fills several tasks."""
    return running(df, keys, order, {"_n": "_rn"}, _rn=F.lit(1))


def seeded_order(id_col: str, seed: int) -> list[Column]:
    """A random order of ids that depends on them and the seed alone."""
    return [F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")).cast("binary")), F.col(id_col)]


def order_block(df: DataFrame, keys: list[str], order: list[str], share: float = 0.7, rounding: str = "floor") -> DataFrame:
    """Adds split: the first ``share`` of each group in stored order is train, the rest eval.

    rounding: 'floor', or 'round' to the nearest, halves to even, with at least one row on both sides.
    """
    rn, n = F.col("_rn"), F.col("_n")
    cut = F.floor(n * share) if rounding == "floor" else F.least(F.greatest(F.bround(n * share), F.lit(1)), n - 1)
    return _ranked(df, keys, order).select(*df.columns, F.when(rn <= cut, "train").otherwise("eval").alias("split"))


def blocks(df: DataFrame, keys: list[str], order: list[str], shares: dict[str, float]) -> DataFrame:
    """Adds split: consecutive blocks of each group with the given shares (rounded down), the last takes the rest."""
    rn, n = _place(keys, order)
    names = list(shares)
    out, upto = F.lit(names[-1]), 0.0
    bounds = []
    for name in names[:-1]:
        upto += shares[name]
        bounds.append((name, upto))
    for name, edge in reversed(bounds):
        out = F.when(rn <= F.floor(n * F.lit(edge) + 1e-9), name).otherwise(out)
    return df.withColumn("split", out)


def seeded(df: DataFrame, keys: list[str], id_col: str, share: float = 0.7, seed: int = 7) -> DataFrame:
    """Adds split: a seeded random share of each group is train."""
    ranked = _ranked(df, keys, seeded_order(id_col, seed))
    return ranked.select(*df.columns, F.when(F.col("_rn") <= F.floor(F.col("_n") * share), "train").otherwise("eval").alias("split"))


def held_out(df: DataFrame, column: str, values: list) -> DataFrame:
    """Adds split: rows with one of these values (receivers, distances) are eval, so that none is on both sides."""
    return df.withColumn("split", F.when(F.coalesce(F.col(column).isin(values), F.lit(False)), "eval").otherwise("train"))


def known_unknown(df: DataFrame, known: int, offset: int | None = None, label: str = "label") -> DataFrame:
    """Adds kind, known for classes below ``known``, and local, the class's number within its kind.

    offset: unknown classes are numbered from there in ``label`` too; None leaves labels as they are.
    """
    is_known = F.col(label) < known
    out = df.withColumn("kind", F.when(is_known, "known").otherwise("unknown")).withColumn("local", F.when(is_known, F.col(label)).otherwise(F.col(label) - known))
    return out if offset is None else out.withColumn(label, F.when(F.col("kind") == "known", F.col(label)).otherwise(F.col("local") + offset))


def stratified(df: DataFrame, label: str, id_col: str, share: float = 1 / 7, seed: int = 7, group: str | None = None) -> DataFrame:
    """Adds split: max(1, round(share * n)) rows (or whole groups) of each class are val, n - 1 at most."""
    n = F.col("_n")
    split = F.when(F.col("_rn") <= F.least(F.greatest(F.bround(n * share), F.lit(1)), n - 1), "val").otherwise("train").alias("split")
    if group is None:
        return _ranked(df, [label], seeded_order(id_col, seed)).select(*df.columns, split)
    units = df.select(label, group).distinct()
    return df.join(_ranked(units, [label], seeded_order(group, seed)).select(label, group, split), [label, group])


def per_class(df: DataFrame, label: str, id_col: str, k: int, seed: int = 7) -> DataFrame:
    """At most k seeded rows a class."""
    rn, _ = _place([label], seeded_order(id_col, seed))
    return df.withColumn("_r", rn).where(F.col("_r") <= k).drop("_r")


def head(df: DataFrame, keys: list[str], order: list[str | Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    rn, _ = _place(keys, order)
    return df.withColumn("_r", rn).where(F.col("_r") <= k).drop("_r")


def choose_classes(df: DataFrame, label: str, k: int, seed: int = 7) -> DataFrame:
    """(label): k classes by seeded hash, in order."""
    return df.select(label).distinct().orderBy(*seeded_order(label, seed)).limit(k).orderBy(label)


def dense_labels(df: DataFrame, label: str, out: str = "dense") -> DataFrame:
    """Adds labels numbered from 0 in order; only the distinct labels are ranked, in ranges."""
    ranks = running(df.select(label).distinct(), [], [label], _rank=F.lit(1)).select(label, (F.col("_rank") - 1).alias(out))
    return df.join(F.broadcast(ranks) if ranks.count() <= 1_000_000 else ranks, label)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds weight: 1 / rows of the class."""
    return df.join(df.groupBy(label).agg((1 / F.count("*")).alias("weight")), label)


def eligible(df: DataFrame, device: str, cell: str, least: int, most_devices: int) -> DataFrame:
    """(device, least_n): devices with at least ``least`` rows in every cell that the table has, first ones by id."""
    n_cells = df.select(cell).distinct().count()
    per = df.groupBy(device, cell).count().groupBy(device).agg(F.min("count").alias("least_n"), F.count("*").alias("_c"))
    return per.where((F.col("_c") == n_cells) & (F.col("least_n") >= least)).orderBy(device).limit(most_devices).select(device, "least_n")


def common_to_all(df: DataFrame, value: str, owner: str) -> DataFrame:
    """(value): values that every owner has (relational division)."""
    n = df.select(owner).distinct().count()
    return df.groupBy(value).agg(F.countDistinct(owner).alias("_n")).where(F.col("_n") == n).select(value)


def cycled(rows: DataFrame, memory: DataFrame, order: str, memory_order: str) -> DataFrame:
    """Every row beside the next of the memory's rows, which begin again at their end: (rows' columns, memory's as m_*).

    Both sides are numbered in ranges. An empty memory gives no row.
    """
    n = memory.count()
    left = running(rows, [], [order], _at=F.lit(1).cast("bigint"))
    right = running(memory, [], [memory_order], _m=F.lit(1).cast("bigint")).select((F.col("_m") - 1).alias("_m"), *[F.col(c).alias(f"m_{c}") for c in memory.columns])
    return left.withColumn("_m", F.pmod(F.col("_at") - 1, F.lit(max(n, 1)))).join(right, "_m").select(*rows.columns, *[f"m_{c}" for c in memory.columns])


def content_overlap(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(left_rows, right_rows, overlap): distinct contents of one side that stand on the other, by SHA-256 of their text."""
    digest = lambda df: df.select(F.sha2(F.col(column).cast("string").cast("binary"), 256).alias("d"))
    both = digest(left).distinct().join(digest(right).distinct(), "d", "left_semi")
    return both.agg(F.count("*").alias("overlap")).select(F.lit(left.count()).alias("left_rows"), F.lit(right.count()).alias("right_rows"), "overlap")


def record_overlap(left: DataFrame, right: DataFrame, vec: str) -> DataFrame:
    """``content_overlap`` of records by the BLAKE2b digests of their 32-bit floats."""
    from vexilar.functions.registry import blake2b_128, float32_bytes

    digest = lambda df: df.select(blake2b_128(float32_bytes(F.col(vec))).alias("d"))
    return content_overlap(digest(left), digest(right), "d")


def assert_disjoint(left: DataFrame, right: DataFrame, column: str) -> None:
    n = content_overlap(left, right, column).first()["overlap"]
    if n:
        raise AssertionError(f"{n} contents are in both splits")


def protocol(df: DataFrame, known: int, per_round: int, rounds: int, label: str = "label", split: str = "split") -> DataFrame:
    """Adds stage: the part of the staged protocol that a row belongs to, from its class and train/eval split.

    Known classes are day1_known_train or day1_initial_eval. Class group k of unknowns trains as
    day{k+1}_unknown_round{k}, and every class met so far is evaluated as day{k+1}_eval_after_r{k}, one row a stage.
    """
    g = F.when(F.col(label) < known, 0).otherwise(F.floor((F.col(label) - known) / per_round) + 1).cast("int")
    rows = df.withColumn("_g", g).where(F.col("_g") <= rounds)
    train = F.when(F.col("_g") == 0, F.lit("day1_known_train")).otherwise(F.concat(F.lit("day"), F.col("_g") + 1, F.lit("_unknown_round"), F.col("_g")))
    later = F.transform(F.sequence(F.greatest(F.col("_g"), F.lit(1)), F.lit(rounds)), lambda k: F.concat(F.lit("day"), k + 1, F.lit("_eval_after_r"), k))
    evals = F.when(F.col("_g") == 0, F.concat(F.array(F.lit("day1_initial_eval")), later)).otherwise(later)
    return rows.withColumn("stage", F.explode(F.when(F.col(split) == "train", F.array(train)).otherwise(evals))).drop("_g")
