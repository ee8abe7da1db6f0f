"""The pattern voter of op4_toxicity has its part in scores."""

from lingmill.llm.toxicity import Model, fit

from test_toxicity import DOCS, LABELS, data


def test_shouting_is_scored():
    m = Model({"bad": 9.0, "!shouting": 5.0}, -4.0)
    assert m.score("quiet words") < 0.1 < 0.5 < m.score("word " * 100_000 + "GET AWAY FROM HERE WITH THAT")
    assert m.score("quiet words!!!") > 0.5 > m.score("quiet words!!")


def test_fitted_weight_is_kept(spark):
    docs, labels, truth = data(600)
    docs = [(i, t + (" !!!" if i in truth else ""), *rest) for i, t, *rest in docs]
    m = fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert m.weights["!shouting"] > 0 and m.score("ka lo mi !!!") > m.score("ka lo mi")
