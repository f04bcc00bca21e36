"""Feature bank and prototypes as Spark ML stages: fitted in a Pipeline, saved and loaded with it.

    model = Pipeline(stages=[FeatureBank(inputCols=["deep", "rf"]), NearestPrototype(inputCol="hybrid")]).fit(train)
    model.write().overwrite().save(path)
    PipelineModel.load(path).transform(rows)

What a stage has learned is a small table, kept as Parquet below the stage's folder; settings are ordinary params.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexilar.functions.vectors import column_stats, standardize, unit
from vexilar.operators.prototypes import BROADCAST_PROTOTYPES, make_prototypes, nearest_of


class _TableWriter(MLWriter):
    def __init__(self, instance: _WithTable) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802 - Spark's name
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.coalesce(1).write.parquet(f"{path}/data")  # a row a component or prototype


class _TableReader(MLReader):
    def __init__(self, kind: type) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> Params:
        held = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.kind(self.sparkSession.read.parquet(f"{path}/data"))
        out._resetUid(held["uid"])
        DefaultParamsReader.getAndSetParams(out, held)
        return out


class _WithTable(MLWritable, MLReadable):
    """A model whose state is one small table."""

    table: DataFrame

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


# ---- feature bank ----


class FeatureBank(Estimator, HasInputCols, DefaultParamsWritable, DefaultParamsReadable):
    """Column scales of several vector columns, from the rows that it is fitted on (the first day's training rows)."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None) -> None:  # noqa: N803 - Spark's name
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> FeatureBankModel:
        spark = df.sparkSession
        stats = [(v, r["i"], r["mean"], r["std"]) for v in self.getInputCols() for r in column_stats(df, v).collect()]  # a row a component
        return self._copyValues(FeatureBankModel(spark.createDataFrame(stats, "view string, i int, mean double, std double")))


class FeatureBankModel(Model, HasInputCols, _WithTable):
    """Scales each column, adds ``hybrid``, all of them one after another, and makes every one a unit vector.

    The rows are those of ``plans.discovery.feature_bank``; other columns stay.
    """

    def __init__(self, table: DataFrame | None = None) -> None:
        super().__init__()
        self.table = table

    def _transform(self, df: DataFrame) -> DataFrame:
        views = self.getInputCols()
        for v in views:
            df = standardize(df, v, self.table.where(F.col("view") == v).select("i", "mean", "std"), unit_if_flat=True)
        df = df.withColumn("hybrid", F.concat(*views))
        for v in (*views, "hybrid"):
            df = unit(df, v)
        return df


# ---- prototypes ----


class NearestPrototype(Estimator, HasInputCol, HasLabelCol, DefaultParamsWritable, DefaultParamsReadable):
    """Unit class means, or several K-means parts a class, of unit vectors."""

    prototypesPerClass = Param(Params._dummy(), "prototypesPerClass", "prototypes of a class at most", TypeConverters.toInt)  # noqa: N815
    oldClasses = Param(Params._dummy(), "oldClasses", "classes below this get the bonus", TypeConverters.toInt)  # noqa: N815
    bonus = Param(Params._dummy(), "bonus", "added to the similarity of old classes", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str = "v", labelCol: str = "label", prototypesPerClass: int = 1, oldClasses: int = 0, bonus: float = 0.0) -> None:  # noqa: N803
        super().__init__()
        self._setDefault(inputCol="v", labelCol="label", prototypesPerClass=1, oldClasses=0, bonus=0.0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> NearestPrototypeModel:
        label, vec = self.getLabelCol(), self.getInputCol()
        rows = unit(df.select(F.col(label).cast("bigint").alias("label"), F.col(vec).alias("v")).where("label is not null and v is not null"), "v")
        protos = make_prototypes(rows, prototypes_per_class=self.getOrDefault("prototypesPerClass")).select("label", "v")
        held = protos.orderBy("label").limit(BROADCAST_PROTOTYPES + 1).collect()  # a few a class
        if len(held) > BROADCAST_PROTOTYPES:
            raise ValueError(f"more than {BROADCAST_PROTOTYPES} prototypes")
        return self._copyValues(NearestPrototypeModel(df.sparkSession.createDataFrame(held, "label bigint, v array<double>")))


class NearestPrototypeModel(Model, HasInputCol, HasLabelCol, _WithTable):
    """Adds pred and sim, the nearest prototype's class and cosine; nothing is shuffled."""

    prototypesPerClass, oldClasses, bonus = NearestPrototype.prototypesPerClass, NearestPrototype.oldClasses, NearestPrototype.bonus  # noqa: N815

    def __init__(self, table: DataFrame | None = None) -> None:
        super().__init__()
        self.table = table

    def _transform(self, df: DataFrame) -> DataFrame:
        near = nearest_of(self.table, self.getOrDefault("oldClasses"), self.getOrDefault("bonus"))
        found = df.withColumn("_near", near(self.getInputCol()))
        return found.select(*df.columns, F.col("_near.pred").alias("pred"), F.when(F.col("_near.pred").isNotNull(), F.col("_near.sim")).alias("sim"))
