from platewise.session import checkpoint_dir, cut_lineage, scratch_dir


def test_shared_folders(spark):
    base = checkpoint_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert (configured is None) or base == configured
    assert scratch_dir(spark, "x").startswith(base.rstrip("/") + "/scratch/x-")
    assert spark.sparkContext.getCheckpointDir() is not None


def test_cut_lineage_is_reliable(spark):
    df = cut_lineage(spark.range(10).selectExpr("id * 2 AS v"))
    assert df.agg({"v": "sum"}).first()[0] == 90
    assert "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
