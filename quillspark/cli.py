"""Command line: ``python -m quillspark.cli <command> ...`` (2.12).

split       split stored or raw reviews of games into training, test and extra
features    extract text features of stored reviews that have none yet
arff        write ARFF lines, in one folder or one a partition
describe    print the descriptive report of a table
evaluate    all metrics of a table of predictions, as CSV
query       run a registered query and print it
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import labels as lb
from .operators import describe as ds
from .operators import features as ft
from .operators import metrics as mt
from .operators import sampling as sp
from .sources import reviews as rv
from .sources import sinks
from .sources.tables import table


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *args):
        q = sub.add_parser(name)
        for names, kw in args:
            q.add_argument(*names, **kw)
        return q

    data = (("data",), {"help": "data directory"})
    out = (("--out",), {"required": True})
    add("split", data, out, (("--games",), {"default": "all"}), (("--max_size",), {"type": int, "default": 4000}),
        (("--percent_train",), {"type": float, "default": 80.0}), (("--convert_to_bins",), {"type": int}),
        (("--bin_factor",), {"type": float, "default": 1.0}), (("--json",), {"action": "store_true"}))
    add("features", data, out, (("--partition",), {"default": "all"}), (("--keep_case",), {"action": "store_true"}),
        (("--binarize",), {"action": "store_true"}))
    add("arff", data, out, (("--mode",), {"choices": ["combined", "separate"], "default": "combined"}), (("--label",), {"default": "num_reviews"}))
    add("describe", data)
    add("evaluate", data, out)
    add("query", data, (("name",), {}), (("--rows",), {"type": int, "default": 20}))
    return p


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "split":
        if a.max_size < 50 or a.percent_train < 1:
            raise SystemExit("max_size must be at least 50, percent_train at least 1")
        if a.json:
            files = rv.game_files(a.games, a.data, spark=spark)
            df = None
            for f in files:
                one = rv.json_lines(spark, os.path.join(a.data, f)).withColumn("game", F.lit(f.removesuffix(".jsonlines")))
                df = one if df is None else df.unionByName(one)
            df = df.withColumn("id_string", F.substring(F.sha2(F.concat_ws("|", "review_url", "date_posted"), 256), 1, 24))
        else:
            df = rv.stored(spark, a.data).drop("partition")
            if a.games != "all":
                df = df.where(F.col("game").isin(*a.games.split(",")))
        df = rv.typed_hours(df)
        if a.convert_to_bins:
            ranges = lb.bin_ranges(*lb.bin_limits(df.where(~F.isnan("total_game_hours")), "total_game_hours"), a.convert_to_bins, a.bin_factor)
            df = df.withColumn("total_game_hours_bin", lb.bin_index(F.col("total_game_hours"), ranges))
        split = sp.train_test_extra(df, "game", a.max_size, a.percent_train, "id_string").withColumnRenamed("split", "partition")
        sinks.write_reviews(split, a.out)
    elif a.command == "features":
        df = rv.stored(spark, a.data, ["game", "partition", "review", "nlp_features"])
        if a.partition != "all":
            df = df.where(rv.stored_partition(F.col("partition")) == a.partition)
        todo = ft.to_extract(df.where("review <> ''"), df.where("nlp_features is not null"))
        long = ft.exploded(ft.extracted(todo.select(F.col("id_string").alias("id"), "review"), "id", "review", lower=not a.keep_case))
        if a.binarize:
            long = long.withColumn("value", F.lit(1))
        sinks.write_features(long.join(df.select(F.col("id_string").alias("id"), "game"), "id"), a.out)
    elif a.command == "arff":
        df = rv.stored(spark, a.data, ["review", "partition", "game", a.label]).where(F.col("review").isNotNull() & F.col(a.label).isNotNull())
        if a.mode == "combined":
            sinks.write_arff(df, a.out, "reviews", "review", a.label)
        else:
            for part in ("training", "test"):
                one = df.where(rv.stored_partition(F.col("partition")) == part)
                sinks.write_arff(one, os.path.join(a.out, part), f"reviews_{part}", "review", a.label)
    elif a.command == "describe":
        df = rv.stored(spark, a.data, ["review", "total_game_hours"]).where("review is not null and total_game_hours >= 0 and not isnan(total_game_hours)")
        print(sinks.describe_report(ds.described(df, "review", "total_game_hours").first().asDict()))
    elif a.command == "evaluate":
        sinks.write_csv(mt.across_folds(mt.evaluation(mt.usable(table(spark, a.data, "prediction")))), a.out)
    else:
        from .plans import registry

        registry.queries()[a.name](spark, a.data).show(a.rows, truncate=80)


__all__ = ["main"]

if __name__ == "__main__":
    main()
