"""Every core query against its DuckDB statement on the smallest tables."""

import math
import os

import pytest

from quillspark.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_whole_input(spark, tmp_path):
    """No usable row and no position is left out."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name in ("review", "documents"):
        t = pq.read_table(f"{DIR}/{name}.parquet")
        if name == "review":
            v = [2_026_300.0, 100_000.0, 20_000.5, *t["total_game_hours"].to_pylist()[3:]]
            t = t.set_column(t.column_names.index("total_game_hours"), "total_game_hours", pa.array(v, t.schema.field("total_game_hours").type))
        pq.write_table(t, f"{tmp_path}/{name}.parquet")
    r = pq.read_table(f"{tmp_path}/review.parquet", columns=["id_string", "total_game_hours"]).to_pylist()
    high = {x["id_string"] for x in r[:3]}
    q = registry.queries()
    for name in ("zscore_label", "label_transforms", "hours_strings"):
        assert high <= {x["id_string"] for x in q[name](spark, str(tmp_path)).collect()}
    assert q["describe_corpus"](spark, str(tmp_path)).first()["hours_max"] == 2_026_300.0
    want = sorted((d["doc_id"], i, w) for d in pq.read_table(f"{DIR}/documents.parquet").to_pylist() if d["text"] is not None for i, w in enumerate(d["text"].split(" ")))
    assert sorted((x["doc_id"], x["pos"], x["word"]) for x in q["positional_join"](spark, DIR).collect()) == want


def test_every_fold_is_held_out(spark):
    from quillspark.operators import learn as ln
    from quillspark.plans import text_queries as tq

    q = registry.queries()
    y = tq.train_test(spark, DIR)[3].select("fold", "id")
    for name, one in (("mnb_cv", "mnb_predict"), ("bnb_cv", "bnb_predict")):
        got = q[name](spark, DIR).collect()
        assert sorted((r["fold"], r["id"]) for r in got) == sorted(map(tuple, y.collect()))
        assert sorted((r["id"], r["p"]) for r in got if r["fold"] == 1) == sorted(map(tuple, q[one](spark, DIR).select("id", "p").collect()))
    scores = q["grid_search"](spark, DIR).collect()
    assert sorted(r["combination"] for r in scores) == list(range(len(ln.grid_rows("perc"))))
