import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import langid


def test_language_sample_is_of_different_texts_with_letters(spark):
    texts = ["the cat sat on the mat", "a quick brown fox jumps", "rain falls over green hills", "letters arrive every monday", "Ω μέγα"]
    hashed = spark.createDataFrame([(t,) for t in texts], "text string").orderBy(F.xxhash64("text"))
    first = hashed.first().text
    rows = [(t, "en") for t in texts + [first] * 20 + [f"{k} - {k * 7}" for k in range(200)]]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(4), per_language=3)
    want = langid.train(spark.createDataFrame([(r.text, "en") for r in hashed.limit(3).collect()], "text string, lang string"), per_language=3)
    assert len(np.unique(model.centroids, axis=0)) == 3
    assert np.array_equal(model.centroids, want.centroids)
    assert np.array_equal(model.least, want.least)
