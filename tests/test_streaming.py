import json

from pyspark.sql import functions as F

from quillspark.operators.learn import nb_counts
from quillspark.streaming.jobs import NaiveBayesTables, deduplicated, review_lines, windowed_hours


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / ("cp_" + name))).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_growing_json_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.json").write_text("\n".join(json.dumps({"review_url": f"u{i}{k % 2}", "total_game_hours": k, "date_posted": "Jan 1, 2015, 1:00AM"}) for k in range(4)))
    lines = review_lines(spark, str(folder), 1)
    assert run(lines, "lines", tmp_path).count() == 12
    timed = lines.withColumn("at", F.to_timestamp(F.lit("2015-01-01")))
    assert run(deduplicated(timed, "review_url", "at"), "once", tmp_path).count() == 6


def test_windowed_hours(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", 1, 2.0), ("2024-01-10 10:00:00", 1, 3.0), ("2024-02-10 10:00:00", 1, 4.0)], "t string, user_id long, value double")
    rows.select(F.to_timestamp("t").alias("ts"), "user_id", "value").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, user_id long, value double").parquet(str(tmp_path / "ev"))
    got = run(windowed_hours(stream), "hours", tmp_path, "complete")
    assert got.count() == 14 + 9 + 14 and got.agg(F.max("hours")).first()[0] == 5.0


def test_naive_bayes_replay(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0, {"x": 2, "z": 0}), ("b", 2.0, {"x": 1, "y": 1}), ("c", 1.0, {"y": 3})], "id string, y double, features map<string,int>")
    nb = NaiveBayesTables(str(tmp_path / "nb"))
    nb.update(rows.limit(2), 0)
    nb.update(rows.limit(2), 0)  # the same batch again
    nb.update(rows.where("id = 'c'"), 1)
    feats, classes = nb.tables(spark)
    long = rows.select("id", F.explode("features").alias("feature", "value")).where("value > 0")
    want, n = nb_counts(long, rows.select("id", "y"))
    assert sorted(map(tuple, feats.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, classes.collect())) == sorted(map(tuple, n.collect()))
