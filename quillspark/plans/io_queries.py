"""Core queries that write, read back and compare (sinks K1-K9, sources S3, S4, R4), and parsed parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config
from ..operators import describe as ds
from ..operators import features as ft
from ..operators import learn as ln
from ..operators import metrics as mt
from ..sources import reviews as rv
from ..sources import sinks
from ..sources.tables import shared_dir, table
from ..streaming.jobs import review_lines
from . import text_queries as tq
from .core_queries import SQL, query


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}/io-{uuid.uuid4().hex}"


@query("parquet_table", "select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def parquet_table(spark, sf):
    """Tables of a directory."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")


def _raw(spark, sf):
    """Fetched lines that are whole."""
    return table(spark, sf, "raw_review").where(F.col("line").rlike("\\}\\s*$")).select("game", "line")


_WHOLE = """select game, line::json as j from raw_review where regexp_matches(line, '\\}\\s*$')"""
_FIELDS = "j ->> 'steam_id_number' as steam_id_number, j ->> 'rating' as rating, (j ->> 'num_comments')::bigint as num_comments"


@query("json_lines_written", f"select {_FIELDS}, count(*) as n from ({_WHOLE}) group by 1, 2, 3")
def json_lines_written(spark, sf):
    """Reviews written as JSON lines in two appends and read back."""
    path = _folder(spark)
    rows = rv.parsed_lines(_raw(spark, sf)).drop("game").withColumn("_part", F.crc32("review_url") % 2)
    for k in (0, 1):
        sinks.write_json_lines(rows.where(F.coalesce("_part", F.lit(0)) == k).drop("_part"), path)
    return rv.json_lines(spark, path).groupBy("steam_id_number", "rating", "num_comments").agg(F.count("*").alias("n"))


@query("game_files_read", f"select game, {_FIELDS}, count(*) as n from ({_WHOLE}) where game in ('Paper_Frontier', 'Salt_Rally') group by 1, 2, 3, 4")
def game_files_read(spark, sf):
    """S3: one folder of JSON lines a game, listed, chosen by name and read."""
    path = _folder(spark)
    games = ["Paper_Frontier", "Salt_Rally"]
    rows = _raw(spark, sf).where(F.col("game").isin(*games, "Iron_Orchard"))
    for g in (*games, "sample"):
        rows.where(F.col("game") == g).select("line").write.text(f"{path}/{g}.jsonlines")
    out = None
    for f in rv.game_files(",".join(games), path, spark=spark):
        one = rv.json_lines(spark, f"{path}/{f}").select(F.lit(f.removesuffix(".jsonlines")).alias("game"), "steam_id_number", "rating", "num_comments")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("game", "steam_id_number", "rating", "num_comments").agg(F.count("*").alias("n"))


@query("growing_lines_streamed", f"select {_FIELDS}, count(*) as n from ({_WHOLE}) group by 1, 2, 3")
def growing_lines_streamed(spark, sf):
    """JSON lines of a growing folder as a stream, files added between two runs on one checkpoint."""
    path = _folder(spark)
    rows = _raw(spark, sf).withColumn("_part", F.crc32("line") % 2)
    for k in (0, 1):
        rows.where(F.col("_part") == k).select("line").write.mode("append").text(f"{path}/in")
        stream = review_lines(spark, f"{path}/in", 1).select("steam_id_number", "rating", "num_comments")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("steam_id_number", "rating", "num_comments").agg(F.count("*").alias("n"))


@query("reviews_written", "select id_string, game, part as partition, num_reviews from parted where part is not null")
def reviews_written(spark, sf):
    """K2: reviews stored by game and partition and read back."""
    path = _folder(spark)
    rows = rv.stored(spark, sf, ["game", "partition", "num_reviews"]).withColumn("partition", rv.stored_partition(F.col("partition")))
    sinks.write_reviews(rows.where("partition is not null"), path)
    return spark.read.parquet(path).select("id_string", "game", "partition", "num_reviews")


@query("features_written", ", e as (select game, unnest(map_entries(nlp_features)) as e from r where nlp_features is not null) select game, e.key as feature, sum(e.value)::bigint as total from e group by 1, 2")
def features_written(spark, sf):
    """K3: features as a table by game, one game's written anew."""
    path = _folder(spark)
    long = tq.stored_long(spark, sf, "game")
    sinks.write_features(long, path)
    sinks.write_features(long.where("game = 'Paper_Frontier'"), path)
    return spark.read.parquet(path).groupBy("game", "feature").agg(F.sum("value").alias("total"))


@query("arff_file", "select '@relation hours' as line, 1 as n union all select '@attribute text string', 1 union all select '@attribute value numeric', 1 union all select '@data', 1 union all select * from (select '\"' || replace(replace(replace(lower(review), '''', ''), '\"', ''), chr(92), '') || '\",' || num_reviews::varchar as line, count(*) as n from r where review is not null and not regexp_matches(review, '[\\x00-\\x1f\\x85\\x{2028}\\x{2029}]') and num_reviews is not null and not contains(review, chr(304)) group by 1)")
def arff_file(spark, sf):
    """K4: header and data lines written as text and read back (texts of one line, as the format needs)."""
    path = _folder(spark)
    rows = rv.stored(spark, sf, ["review", "num_reviews"]).where("review is not null and num_reviews is not null")
    rows = rows.where(~F.col("review").rlike("[\\x00-\\x1f\\x85\\u2028\\u2029]") & ~F.contains("review", F.lit("İ")))
    sinks.write_arff(rows, path, "hours", "review", "num_reviews")
    lines = spark.read.text(f"{path}/header").union(spark.read.text(f"{path}/data"))
    return lines.where("value <> ''").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("distribution_csv", "select rating as label, count(*) as n from r group by 1")
def distribution_csv(spark, sf):
    """K6 K7: a report as CSV with a header, read back."""
    path = _folder(spark)
    sinks.write_csv(ds.distribution(rv.stored(spark, sf, ["rating"]).select(F.col("rating").alias("label"))).select("label", "n"), path)
    return spark.read.csv(path, header=True, schema="label string, n long")


@query("weights_written", SQL["feature_weights"].replace(" order by abs(weight) desc, feature, y limit 100", ""))
def weights_written(spark, sf):
    """K8: weights of every feature by falling size, with their parameters, read back in the order written."""
    path = _folder(spark)
    x, train, _, _ = tq.train_test(spark, sf)
    w, _ = ln.mnb_weights(*ln.nb_counts(x, train))
    sinks.write_weights(w.select("feature", "y", F.round("weight", 6).alias("weight")), {"alpha": 0.1}, path)
    return spark.read.csv(f"{path}/weights", header=True, schema="feature string, y double, weight double", multiLine=True, escape='"')


@query("model_reloaded", SQL["mnb_predict"])
def model_reloaded(spark, sf):
    """K9: a model written as its tables and loaded for predictions."""
    path = _folder(spark)
    x, train, test, _ = tq.train_test(spark, sf)
    for name, part in zip(("weights", "base"), ln.mnb_weights(*ln.nb_counts(x, train))):
        sinks.write_model(part, f"{path}/{name}")
    return ln.mnb_predict(x.join(test.select("id"), "id", "left_semi"), test, spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/base"))


#: A fixture of parses: (id, head, relation, child, tag of the child).
PARSES = [
    (1, "play", "nsubj", "you", "PRP"), (1, "play", "dobj", "game", "NN"), (1, "play", "punct", ".", "."), (1, "play", "dobj", "game", "NN"),
    (2, "be", "attr", "fun", "JJ"), (2, "be", "punct", "!", "."), (2, "fun", "amod", "great", "JJ"), (3, "be", "punct", ",", ","), (4, "a:b", "x", "c", "NN"),
]
_PARSES = "(values " + ", ".join(str(p) for p in PARSES) + ") t(id, h, d, c, tag)"


@query("dependency_features", f"select id, h || ':' || d || ':' || c as feature, count(*)::int as value from {_PARSES} where not contains('!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', tag) group by 1, 2")
def dependency_features(spark, sf):
    """on a fixture of parses, since the tables have none."""
    df = spark.createDataFrame(PARSES, "id int, head_lemma string, dep string, child_lemma string, child_tag string")
    return ft.dependency_features(df).select("id", "feature", "value")


@query("chosen_games", "select 'all' as asked, game from game_catalog union all select 'list', game from game_catalog where game in ('Paper_Frontier', 'Salt_Rally')")
def chosen_games(spark, sf):
    """The games of a parameter, over the catalogue (a list of known size)."""
    known = [r["game"] for r in table(spark, sf, "game_catalog").collect()]
    rows = [(k, g) for k, s in (("all", "all"), ("list", "Paper_Frontier, Salt_Rally"), ("none", " ")) for g in sorted(config.parse_games(s, known))]
    return spark.createDataFrame(rows, "asked string, game string")


@query("chosen_learners", "select unnest(['bnb', 'mnb', 'perc']) as learner")
def chosen_learners(spark, sf):
    """P9."""
    return spark.createDataFrame([(x,) for x in sorted(config.parse_learners("perc, mnb,bnb"))], "learner string")


@query("chosen_attributes", "select unnest(['num_achievements_attained', 'num_achievements_percentage', 'num_achievements_possible', 'num_badges', 'num_comments', 'num_found_funny', 'num_found_helpful', 'num_found_unhelpful', 'num_games_owned', 'num_groups', 'num_guides', 'num_reviews', 'num_screenshots', 'num_voted_helpfulness', 'num_workshop_items', 'found_helpful_percentage', 'total_game_hours', 'total_game_hours_bin', 'total_game_hours_last_two_weeks']) as attribute")
def chosen_attributes(spark, sf):
    """P10: all attributes outside the target's group, here friends."""
    return spark.createDataFrame([(x,) for x in sorted(config.parse_attributes("all", "num_friends"))], "attribute string")


def _sub(name: str) -> str:
    return "(" + SQL[name] + ")"


@query(
    "evaluation_record",
    f"""select a.*, k.* exclude (learner, fold), t.tau as kendall_tau_rounded, pu.r as pearson_r_unrounded, pr.r as pearson_r_rounded, su.rho as spearman_unrounded, sr.rho as spearman_rounded,
  pu.n as n_test_samples, m.printable as confusion, 'total_game_hours' as prediction_label
from {_sub("accuracy_precision_f1")} a join {_sub("kappa_all")} k using (learner, fold) join {_sub("kendall")} t using (learner, fold) join {_sub("pearson")} pu using (learner, fold)
join {_sub("pearson").replace("from p group", "from q group")} pr using (learner, fold) join {_sub("spearman")} su using (learner, fold)
join {_sub("spearman").replace("from p) select", "from q) select")} sr using (learner, fold) join {_sub("printable_confusion")} m using (learner, fold)""",
)
def evaluation_record(spark, sf):
    """All metrics of a learning round, its confusion matrix and its description."""
    good = tq.preds(spark, sf)
    n = good.groupBy(*mt.KEYS).agg(F.count("*").alias("n_test_samples"))
    confusion = mt.printable(mt.confusion(good)).withColumnRenamed("printable", "confusion")
    return tq.r9(mt.evaluation(good)).join(n, mt.KEYS).join(confusion, mt.KEYS).withColumn("prediction_label", F.lit("total_game_hours"))
