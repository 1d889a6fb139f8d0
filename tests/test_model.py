"""The recommender as an ML model: fitted, saved, loaded and used in a pipeline it gives the rows of the plain function."""

from pyspark.ml import Pipeline, PipelineModel

from docloom.operators import recommend
from docloom.operators.model import Recommender, RecommenderModel

SETTINGS = {"catCols": ["c"], "numCols": ["v"], "labelCol": "label"}


def tables(spark):
    hist = spark.createDataFrame([(i, "abc"[i % 3], float(i * 7 % 11), "xy"[i % 2]) for i in range(60)], "id long, c string, v double, label string")
    asks = spark.createDataFrame([(i, "abz"[i % 3], float(i), "extra") for i in range(9)] + [(None, None, None, "extra")], "query_id long, c string, v double, other string")
    return hist, asks


def rows(df):
    return sorted(((r.query_id, r.predicted, round(r.confidence, 9), [t.id for t in r.top]) for r in df.collect()), key=str)


def test_saved_loaded_and_in_a_pipeline(spark, tmp_path):
    hist, asks = tables(spark)
    want = rows(recommend.recommend(asks, hist, ["c"], ["v"], "label"))
    model = Recommender(**SETTINGS).fit(hist)
    found = model.transform(asks)
    assert rows(found) == want and found.columns == ["query_id", "c", "v", "other", "predicted", "confidence", "top", "message"]
    model.save(str(tmp_path / "model"))
    again = RecommenderModel.load(str(tmp_path / "model"))
    assert rows(again.transform(asks)) == want and again.uid == model.uid and again.getOrDefault("n") == 5
    made = Pipeline(stages=[Recommender(**SETTINGS, n=3)])
    made.save(str(tmp_path / "made"))
    fitted = Pipeline.load(str(tmp_path / "made")).fit(hist)
    fitted.write().overwrite().save(str(tmp_path / "fitted"))
    loaded = PipelineModel.load(str(tmp_path / "fitted"))
    assert rows(loaded.transform(asks)) == rows(recommend.recommend(asks, hist, ["c"], ["v"], "label", n=3))


def test_repeated_queries_and_no_history(spark):
    hist, asks = tables(spark)
    model = Recommender(**SETTINGS).fit(hist)
    assert model.transform(asks.union(asks)).count() == 20
    none = Recommender(**SETTINGS).fit(hist.limit(0)).transform(asks).collect()
    assert len(none) == 10 and all(r.predicted is None for r in none)
