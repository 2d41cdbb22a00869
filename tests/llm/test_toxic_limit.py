import numpy as np
from pyspark.sql import functions as F

from isolates.llm import op1_toxicity
from tests.llm.corpus import SCHEMA


def test_stage_drops_what_the_query_calls_toxic(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c", "aa", "s", 5) for i in range(3)], SCHEMA)
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    for score, left in ((0.29, 3), (0.31, 0), (0.49, 0)):
        model = op1_toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(score / (1 - score))))
        monkeypatch.setattr(op1_toxicity, "fit", lambda *_: model)
        assert op1_toxicity.without_toxic(docs, labels, F.lit(True)).count() == left
