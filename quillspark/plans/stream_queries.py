"""Core queries that run a stream to its end over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.tables import shared_dir, table
from ..streaming.jobs import NaiveBayesTables, windowed_hours
from .core_queries import query


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/quillspark-streams/{uuid.uuid4().hex}"


@query(
    "stream_windowed_hours",
    """with w as (select user_id, value, unnest(range(0, 14)) as k, ts::date as d from events)
select user_id, (d - k::int)::timestamp as start, round(sum(value), 6) as hours from w
where (d - k::int)::timestamp + interval 14 day <= (select max(ts) - interval 1 day from events) group by 1, 2""",
)
def stream_windowed_hours(spark, sf):
    """14-day windows sliding by a day, as a stream over the events run to its end: a window is put out,
    and its state dropped, once the watermark (the last event less a day) has passed its end."""
    at = _folder(spark)
    out = windowed_hours(spark.readStream.schema(table(spark, sf, "events").schema).parquet(_single(spark, sf, "events")))
    q = out.select("user_id", F.col("window.start").alias("start"), "hours").writeStream.outputMode("append").format("parquet")
    q.option("checkpointLocation", f"{at}/at").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.round("hours", 6).alias("hours"))


def _single(spark, sf, name: str) -> str:
    """A folder with the table's file(s), which a file stream needs."""
    path = f"{_folder(spark)}/{name}"
    table(spark, sf, name).write.parquet(path)
    return path


@query(
    "stream_nb_counts",
    """with r as (select * exclude (k) from (select *, row_number() over (partition by id_string order by inserted_at, num_found_helpful, num_comments) as k from review) where k = 1),
x as (select total_game_hours_bin::double as y, e.key as feature, e.value as value from (select total_game_hours_bin, unnest(map_entries(nlp_features)) as e from r
  where nlp_features is not null and total_game_hours_bin is not null) where e.value > 0)
select feature, y, sum(value)::double as total, count(*)::bigint as records from x group by 1, 2""",
)
def stream_nb_counts(spark, sf):
    """Naive Bayes counts grown batch by batch; the sum is that of one aggregation."""
    from ..sources.reviews import stored

    rows = stored(spark, sf, ["total_game_hours_bin", "nlp_features"]).where("total_game_hours_bin is not null and nlp_features is not null")
    rows = rows.select(F.col("id_string").alias("id"), F.col("total_game_hours_bin").cast("double").alias("y"), F.col("nlp_features").alias("features"))
    base = _folder(spark)
    rows.repartition(4).write.parquet(f"{base}/in")
    nb = NaiveBayesTables(f"{base}/model")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    nb.start(stream, f"{base}/checkpoint").awaitTermination()
    return nb.tables(spark)[0]
