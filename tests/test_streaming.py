from tandem.streaming import online


def test_batches_match_earlier_reports(spark, tmp_path):
    rows = [(1, "crash on start", ""), (2, "slow menu redraw", ""), (3, "crash on start again", ""), (4, "menu redraw slow", "")]
    source = tmp_path / "in"
    source.mkdir()
    schema = "bug_id long, short_desc string, description string"
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(source / f"p{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source / "*"))
    out = str(tmp_path / "out")
    q = stream.writeStream.foreachBatch(online.matcher(spark, str(tmp_path / "store"), out, 1)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["anchor"]: r["cand"] for r in spark.read.parquet(out).collect()}
    assert got[3] == 1 and got[4] == 2
