"""Bounds of unusual texts come from all labelled texts, not from those the model was fitted on."""

import math

from keelson.llm import language_id


def test_bounds_come_from_all_labelled_texts(spark):
    texts = [(f"der hund und die katze gehen nummer {chr(97 + i % 26)}{chr(97 + i // 26)} nach haus", "de") for i in range(60)]
    usual = spark.createDataFrame(texts * 2, "text string, lang string")
    odd = spark.createDataFrame([("xqz wvk jjq " * 40, "de")], usual.schema)
    bounds = []
    for docs in (usual, usual.unionByName(odd)):
        # On average five texts are learned from, fewer than a bound needs.
        model = language_id.fit_language_model(usual, rows_per_language=5)
        bounds.append(language_id.learn_bounds(docs, model, rows_per_language=5).allowed[0])
    assert math.isfinite(bounds[0])
    assert bounds[1] > bounds[0]
