from pyspark.sql import functions as F

from folioscan.llm.labelled import fitted_in_task, sample, within


def test_within():
    assert within([(0, 5), (1, 5)], 10) == [True, True]
    assert within([(0, 9), (0, 4), (1, 1), (0, 5)], 10) == [True, False, True, False]  # what one class leaves, the other has
    assert within([(0, 6), (0, 4), (1, 6), (1, 5)], 10) == [False, True, False, True]
    assert within([(1, 99), (1, 50), (0, 1)], 10) == [False, True, True]
    assert within([], 10) == []


def test_a_very_long_text_does_not_end_the_sample(spark):
    """Wherever it stands in the order."""
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(40)], "doc_id long, toxic int")
    for long in (0, 1, 10, 25):
        docs = spark.createDataFrame([(i, f"text {i} " * (1000 if i == long else 1)) for i in range(40)], "doc_id long, text string")
        texts, y, share = sample(docs, labels, "toxic", F.lit(True), (40, 40), 2000)
        assert len(texts) == 39 and y.sum() == 4 - (long % 10 == 0) and share == 0.1


def test_the_rarer_class_is_not_cut_first(spark):
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"{i:04d}" * 25) for i in range(400)], "doc_id long, text string")
    texts, y, _ = sample(docs, labels, "toxic", F.lit(True), (60, 40), 6000)
    assert sum(map(len, texts)) <= 6000 and y.sum() == 30 and len(y) == 60


def test_a_fit_in_a_task_sees_the_sample_of_the_driver(spark):
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "doc_id long, toxic int")
    rows = [(i, f"text {i % 90} " * (i % 7)) for i in range(200)] + [(3, None), (3, "other"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for d, l in ((docs, labels), (docs.limit(0), labels), (docs, labels.limit(0))):
        args = (d, l, "toxic", F.lit(True), (60, 12), 3000)
        texts, y, share = sample(*args)
        assert fitted_in_task(*args, lambda t, v, s: (t, v.tolist(), s)) == (texts, y.tolist(), share)
