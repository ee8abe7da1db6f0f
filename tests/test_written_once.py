from lingmill.plans import curation, files

SF = "/root/testdata/sf0.01"


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def made(spark, df):
    """Bytes that a query shuffles."""
    before = shuffled(spark)
    df().write.format("noop").mode("overwrite").save()
    return shuffled(spark) - before


def test_increments_make_the_pairs_once(spark):
    once = made(spark, lambda: curation._kept(spark, SF))
    assert made(spark, lambda: curation.dedup_increments(spark, SF)) < 3 * once


def test_files_to_resume_are_not_dealt_to_two_tasks(spark):
    assert made(spark, lambda: files.resumed_files(spark, SF)) < 100_000
