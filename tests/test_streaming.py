from lakesift.streaming import quality_stream


def test_stream_writes_what_passes(spark, tmp_path):
    schema = "id string, duration_sec double, snr_db double, silence_ratio double, is_clipped boolean, rms_db double"
    rows = [("a", 3.0, 20.0, 0.1, False, -20.0), ("b", 0.1, 20.0, 0.1, False, -20.0), ("c", 3.0, 15.0, 0.4, False, -40.0)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        quality_stream.start(quality_stream.read_features(spark, folder, schema), out, str(tmp_path / "at")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "c"]
