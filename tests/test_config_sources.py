import pytest

from quillspark.config import Experiment, parse_attributes, parse_games, parse_learners
from quillspark.operators.learn import grid_rows
from quillspark.schema import LABELS, TIME_LABELS, partition_key
from quillspark.sources import reviews as rv
from quillspark.sources import sinks
from quillspark.sources.paged import PagedListing

BASE = dict(
    games={"a"}, learners=["perc", "pagr"], training_rounds=10, training_samples_per_round=100, grid_search_samples_per_fold=50,
    prediction_label="total_game_hours", objective="pearson_r", hashed_features=100000, bin_ranges=[(0.0, 40.0), (40.1, 600.5), (600.6, 9000.0)],
)


def test_experiment_defaults():
    e = Experiment(**BASE)
    assert (e.data_sampling, e.grid_search_folds, e.rescale, e.feature_selection_percentile, e.n_jobs) == ("even", 5, True, 1.0, 1)
    assert len(e.grids()) == 2


@pytest.mark.parametrize(
    "change",
    [
        {"learners": ["x"]}, {"training_rounds": 1}, {"training_samples_per_round": 0}, {"grid_search_samples_per_fold": 1}, {"objective": "x"},
        {"prediction_label": "x"}, {"non_nlp_features": {"total_game_hours"}}, {"non_nlp_features": {"x"}}, {"data_sampling": "x"},
        {"hashed_features": -1}, {"hashed_features": True}, {"lognormal": True, "power_transform": 2.0}, {"power_transform": 0.0},
        {"feature_selection_percentile": 0.0}, {"feature_selection_percentile": 1.1}, {"n_jobs": 0}, {"bin_ranges": [(0.0, 1.0)]}, {"games": set()},
    ],
)
def test_experiment_errors(change):
    with pytest.raises(ValueError):
        Experiment(**(BASE | change))


def test_lists():
    assert parse_games("", ["a"]) == set() and parse_games("all", ["a", "b"]) == {"a", "b"}
    assert parse_learners("mnb, bnb") == {"mnb", "bnb"}
    assert parse_attributes("all", "total_game_hours") == set(LABELS) - set(TIME_LABELS)
    assert parse_attributes("none", "num_guides") == set()
    for f, args in ((parse_games, ("c", ["a"])), (parse_learners, ("MNB",)), (parse_attributes, ("total_game_hours_bin", "total_game_hours")), (parse_attributes, ("x", "num_guides"))):
        with pytest.raises(ValueError):
            f(*args)
    assert [len(grid_rows(x)) for x in ("mbkm", "bnb", "mnb", "perc", "pagr", "pagc", "sgdc")] == [6, 6, 6, 96, 20, 20, 384]
    assert partition_key("train") == "training"


def test_game_files(tmp_path):
    for n in ("a", "b", "sample"):
        (tmp_path / f"{n}.jsonlines").write_text("{}\n")
    assert rv.game_files("b,a.jsonlines,sample", str(tmp_path)) == ["b.jsonlines", "a.jsonlines"]
    assert rv.game_files("all", str(tmp_path)) == ["a.jsonlines", "b.jsonlines"]
    for bad in ("", "sample", "zzz"):
        with pytest.raises((ValueError, FileNotFoundError)):
            rv.game_files(bad, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        rv.game_files("all", str(tmp_path / "none"))


def test_json_lines_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonlines").write_text('{"review": "x", "total_game_hours": 3, "num_comments": 1}\n{"review": "cut\n{"total_game_hours": null}\n')
    df = rv.typed_hours(rv.json_lines(spark, str(tmp_path / "a.jsonlines")))
    assert [tuple(r) for r in df.select("review", "total_game_hours").collect()] == [("x", 3.0)]
    lines = sinks.arff_lines(spark.createDataFrame([('A "q" \\ it\'s', 2)], "t string, v int"), "t", "v")
    assert lines.first()[0] == '"a q  its",2'
    rows = spark.createDataFrame([("1", "g", "test"), ("1", "g", "test"), ("2", "g", "training")], "id_string string, game string, partition string")
    sinks.write_reviews(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_paged_listing(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i + 1}.page").write_text("\n".join(f"{i}-{k}" for k in range(10)))
    spark.dataSource.register(PagedListing)
    df = spark.read.format("paged_listing").option("limit", 15).load(str(tmp_path))
    assert df.count() == 15 and df.selectExpr("max(position)").first()[0] == 14
    assert rv.page_offsets(95, 40) == [(1, 0), (2, 10), (3, 20), (4, 30)]


def test_report_sinks(spark, tmp_path):
    df = spark.createDataFrame([("Some \"text\"", 2.0), ("b", 3.0)], "t string, v double")
    sinks.write_arff(df, str(tmp_path / "arff"), "r", "t", "v", ["2.0", "3.0"])
    assert next((tmp_path / "arff" / "header").glob("part-*")).read_text().startswith("@relation r\n@attribute text string\n@attribute value {2.0,3.0}")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "arff" / "data")).collect()) == ['"b",3.0', '"some text",2.0']
    w = spark.createDataFrame([("a", 0.5), ("b", -2.0)], "feature string, weight double")
    sinks.write_weights(w, {"alpha": 0.1}, str(tmp_path / "w"))
    assert [r["feature"] for r in spark.read.option("header", True).csv(str(tmp_path / "w" / "weights")).collect()] == ["b", "a"]
    sinks.write_model(w, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    sinks.write_json_lines(w, str(tmp_path / "j"))
    sinks.write_json_lines(w, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    f = spark.createDataFrame([("1", "a", 1, "g")], "id string, feature string, value int, game string")
    sinks.write_features(f, str(tmp_path / "f"))
    sinks.write_features(f.replace("g", "h"), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    row = {"n": 2} | {f"{a}_{b}": 1.0 for a in ("length", "hours") for b in ("mean", "min", "max", "std")}
    assert sinks.describe_report(row).count("\n") == 9


def test_cli(spark, tmp_path, capsys):
    import os

    from quillspark import cli

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    cli.main(["split", data, "--out", str(tmp_path / "s"), "--convert_to_bins", "3", "--bin_factor", "5.0"])
    assert set(r[0] for r in spark.read.parquet(str(tmp_path / "s")).select("partition").distinct().collect()) <= {"training", "test", "extra"}
    cli.main(["describe", data])
    cli.main(["evaluate", data, "--out", str(tmp_path / "e")])
    cli.main(["arff", data, "--out", str(tmp_path / "a"), "--mode", "separate"])
    cli.main(["query", data, "fold_check"])
    assert "Number of reviews" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["split", data, "--out", "x", "--max_size", "10"])
