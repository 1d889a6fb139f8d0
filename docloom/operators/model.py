"""The recommender as a Spark ML estimator and model, for pipelines, with its parameters and history saved together."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from .recommend import recommend


class _Settings(Params):
    catCols = Param(Params._dummy(), "catCols", "categorical columns", TypeConverters.toListString)
    numCols = Param(Params._dummy(), "numCols", "numeric columns", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "column that the neighbours vote on", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "id of history rows", TypeConverters.toString)
    queryCol = Param(Params._dummy(), "queryCol", "id of query rows", TypeConverters.toString)
    n = Param(Params._dummy(), "n", "neighbours of a query", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(catCols=[], numCols=[], labelCol="label", idCol="id", queryCol="query_id", n=5)

    def _columns(self) -> list[str]:
        """The columns of history that recommendations need."""
        return list(dict.fromkeys([self.getOrDefault(self.idCol), *self.getOrDefault(self.catCols), *self.getOrDefault(self.numCols), self.getOrDefault(self.labelCol)]))


class Recommender(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """fit() takes a history; the model's transform() takes queries."""

    @keyword_only
    def __init__(self, *, catCols=None, numCols=None, labelCol="label", idCol="id", queryCol="query_id", n=5) -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> RecommenderModel:
        return self._copyValues(RecommenderModel(dataset.select(*self._columns())))


class RecommenderModel(Model, _Settings, MLReadable, MLWritable):
    """Adds predicted, confidence, top and message to each query, as recommend() has them.

    It is lazy about its history: only a saved model has a copy of it. Queries whose ids are null or repeat share a result.
    """

    def __init__(self, history: DataFrame) -> None:
        super().__init__()
        self.history = history

    def _transform(self, dataset: DataFrame) -> DataFrame:
        query = self.getOrDefault(self.queryCol)
        asked = dataset.select(query, *self.getOrDefault(self.catCols), *self.getOrDefault(self.numCols)).dropDuplicates([query])
        found = recommend(asked, self.history, self.getOrDefault(self.catCols), self.getOrDefault(self.numCols), self.getOrDefault(self.labelCol), self.getOrDefault(self.idCol), query, self.getOrDefault(self.n)).withColumnRenamed(query, "__q")
        return dataset.join(found, dataset[query].eqNullSafe(found["__q"]), "left").drop("__q")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: RecommenderModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.history.write.parquet(f"{path}/history")


class _Reader(MLReader):
    def load(self, path: str) -> RecommenderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = RecommenderModel(self.sparkSession.read.parquet(f"{path}/history"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
