"""Core queries and the DuckDB statements they are compared with: relational part, labels, sampling."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..operators import describe as ds
from ..operators import features as ft
from ..operators import sampling as sp
from ..schema import LABELS
from ..sources import reviews as rv
from ..sources.sinks import arff_lines
from ..sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}

#: Stored reviews, each id once, and those with usable hours.
R = """r as (select * exclude (k) from (select *, row_number() over (partition by id_string
  order by inserted_at, num_found_helpful, num_comments) as k from review) where k = 1),
parted as (select *, case when lower(trim(partition)) in ('train', 'training') then 'training'
  when lower(trim(partition)) in ('test', 'extra') then lower(trim(partition)) end as part from r),
h as (select id_string, game, appid, total_game_hours as v from r
  where total_game_hours is not null and not isnan(total_game_hours) and total_game_hours >= 0)"""


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            needs = not sql.lstrip().startswith("with") and re.search(r"^\s*,|\b(?:from|join) (?:r|h|parted)\b", sql)
            SQL[name] = f"with {R} {sql}" if needs else sql
        return f

    return add


def hours(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    df = rv.stored(spark, sf, ["game", "appid", "total_game_hours", *more])
    v = F.col("total_game_hours")
    return df.where(v.isNotNull() & ~F.isnan(v) & (v >= 0)).withColumnRenamed("total_game_hours", "v")


def bins_of(spark: SparkSession, sf: str, label: str) -> DataFrame:
    return table(spark, sf, "bin_range").where(F.col("label") == label).select("bin", "lo", "hi")


#: As in the table bin_range.
HOURS_BINS = [(0.0, 225.1), (225.2, 2026.2), (2026.3, 16435.0)]


@query(
    "label_distribution_binned",
    """, b as (select h.game, min(q.bin) as bin from h join bin_range q on q.label = 'total_game_hours' and h.v > q.lo - 0.05 and h.v < q.hi + 0.05
  group by h.game, h.id_string),
c as (select game, bin, count(*) as n from b group by 1, 2)
select game, bin, n, round(n / sum(n) over (partition by game), 9) as share from c""",
)
def label_distribution_binned(spark, sf):
    """Bins of the hours played, per game, with relative frequency."""
    from pyspark.sql import Window

    df = lb.bin_join(hours(spark, sf), "v", bins_of(spark, sf, "total_game_hours")).where("bin is not null")
    n = df.groupBy("game", "bin").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("game")), 9))


@query("label_distribution", "select num_reviews as label, count(*) as n from r where num_reviews is not null group by 1")
def label_distribution(spark, sf):
    """A1."""
    return ds.distribution(rv.stored(spark, sf, ["num_reviews"]).select(F.col("num_reviews").alias("label"))).select("label", "n")


@query("label_relative_freq", ", c as (select rating as label, count(*) as n from r group by 1) select label, round(n / sum(n) over (), 9) as share from c")
def label_relative_freq(spark, sf):
    """A2."""
    d = ds.distribution(rv.stored(spark, sf, ["rating"]).select(F.col("rating").alias("label")))
    return d.select("label", F.round("share", 9).alias("share"))


@query(
    "describe_corpus",
    """, t as (select length(review)::double as l, total_game_hours as v from r where review is not null and total_game_hours is not null
  and not isnan(total_game_hours) and total_game_hours >= 0)
select count(*) as n, round(avg(l), 6) as length_mean, min(l) as length_min, max(l) as length_max, round(stddev_pop(l), 6) as length_std,
  round(avg(v), 6) as hours_mean, min(v) as hours_min, max(v) as hours_max, round(stddev_pop(v), 6) as hours_std from t""",
)
def describe_corpus(spark, sf):
    """A3 K5."""
    df = hours(spark, sf, "review").where("review is not null")
    d = ds.described(df, "review", "v")
    return d.select(*[F.round(c, 6).alias(c) if c.endswith(("mean", "std")) else c for c in d.columns])


@query(
    "length_histogram",
    """with t as (select n_chars::double as v from documents where n_chars is not null), m as (select min(v) as lo, max(v) as hi from t)
select coalesce(least(floor((v - lo) / ((hi - lo) / 10)), 9), 0)::int as bin, count(*) as n from t, m group by 1""",
)
def length_histogram(spark, sf):
    """A6 K10."""
    return ds.histogram(table(spark, sf, "documents").select("n_chars"), "n_chars", 10)


@query("ceil_histogram", "with t as (select ceil(value / 10.0) * 10.0 as upper from events where value is not null) select upper::double as upper, count(*) as n from t group by 1")
def ceil_histogram(spark, sf):
    """A13."""
    return ds.ceil_histogram(table(spark, sf, "events"), "value", 10.0)


@query("coverage_share", "select round(avg(case when v <= 300 then 1 else 0 end), 9) as share, avg(case when v <= 300 then 1 else 0 end) >= 0.9 as covered from h")
def coverage_share(spark, sf):
    """A14."""
    return ds.coverage(hours(spark, sf), "v", 300.0).withColumn("share", F.round("share", 9))


@query(
    "moments_report",
    """with t as (select value as v from events where value is not null and not isnan(value)), m as (select avg(v) as m from t),
c as (select v, count(*) as c from t group by 1), d as (select (select v from c order by c desc, v limit 1) as mode),
s as (select count(*) as n, min(v) as mn, max(v) as mx, avg(v) as mean, quantile_cont(v, 0.5) as median, avg((v - m) ^ 2) as m2, avg((v - m) ^ 3) as m3,
  avg((v - m) ^ 4) as m4 from t, m)
select n, mn as min, mx as max, round(sqrt(m2), 6) as std, round(mean, 6) as mean, round(median, 6) as median, d.mode as mode,
  round(m3 / m2 ^ 1.5, 6) as skewness, round(m4 / (m2 * m2), 6) as kurtosis,
  round(n / 6 * ((m3 / m2 ^ 1.5) ^ 2 + (m4 / (m2 * m2) - 3) ^ 2 / 4), 3) as jarque_bera from s, d""",
)
def moments_report(spark, sf):
    """A15."""
    m = ds.moments(table(spark, sf, "events"), "value")
    r6 = ("std", "mean", "median", "skewness", "kurtosis")
    return m.select(*[F.round(c, 6).alias(c) if c in r6 else F.round(c, 3).alias(c) if c == "jarque_bera" else c for c in m.columns])


@query("bin_limits", "select floor(min(value))::double as lo, ceil(max(value))::double as hi, min(value) as raw_lo, max(value) as raw_hi from events")
def bin_limits(spark, sf):
    """A4 A5."""
    e = table(spark, sf, "events")
    return e.agg(
        F.floor(F.min("value")).cast("double").alias("lo"), F.ceil(F.max("value")).cast("double").alias("hi"), F.min("value").alias("raw_lo"), F.max("value").alias("raw_hi")
    )


@query("geometric_bins", "select * from (values (1, 0.0::double, 29.0::double), (2, 29.1::double, 174.2::double), (3, 174.3::double, 900.0::double)) as t(bin, lo, hi)")
def geometric_bins(spark, sf):
    """The ranges of fixed limits."""
    return spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(lb.bin_ranges(0, 900, 3, 5.0), 1)], "bin int, lo double, hi double")


@query(
    "bins_from_data",
    """with m as (select floor(min(value))::double as lo, ceil(max(value))::double as hi from events), u as (select lo, hi, round(round(hi, 1) - lo) / 31.0 as unit from m),
a as (select lo, hi, unit, round(lo + unit, 1) as e1 from u), b as (select *, round(round(e1 + 0.1, 1) + unit * 5 - 0.1, 1) as e2 from a),
r as (select *, unnest([1, 2, 3]) as bin from b)
select bin::int as bin, case bin when 1 then lo when 2 then round(e1 + 0.1, 1) else round(e2 + 0.1, 1) end as lo, case bin when 1 then e1 when 2 then e2 else hi end as hi from r""",
)
def bins_from_data(spark, sf):
    """A5 L4: ranges from the limits of a column, two scalars to the driver."""
    lo, hi = lb.bin_limits(table(spark, sf, "events"), "value")
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(lb.bin_ranges(lo, hi, 3, 5.0), 1)], "bin int, lo double, hi double")


_BIN_CASE = "case when v > 0.0 - 0.05 and v < 225.1 + 0.05 then 1 when v > 225.2 - 0.05 and v < 2026.2 + 0.05 then 2 when v > 2026.3 - 0.05 and v < 16435.0 + 0.05 then 3 end"


@query("bin_assign_when", f"select id_string, {_BIN_CASE} as bin from h")
def bin_assign_when(spark, sf):
    """L6."""
    return hours(spark, sf).select("id_string", lb.bin_index(F.col("v"), HOURS_BINS).alias("bin"))


@query(
    "bin_assign_table",
    "select id_string, (select min(bin) from bin_range q where q.label = 'num_games_owned' and r.num_games_owned > q.lo - 0.05 and r.num_games_owned < q.hi + 0.05) as bin from r",
)
def bin_assign_table(spark, sf):
    """J7."""
    df = rv.stored(spark, sf, ["num_games_owned"])
    return lb.bin_join(df, "num_games_owned", bins_of(spark, sf, "num_games_owned")).select("id_string", "bin")


@query("label_ln", "select id_string, round(case when v > 1 then ln(v) else v end, 9) as label from h")
def label_ln(spark, sf):
    """L1 L2."""
    return hours(spark, sf).select("id_string", F.round(lb.label_value(F.col("v"), "total_game_hours", lognormal=True), 9).alias("label"))


@query("label_power", "select id_string, round(v ^ 0.5, 9) as label from h")
def label_power(spark, sf):
    """L1 L3."""
    return hours(spark, sf).select("id_string", F.round(lb.label_value(F.col("v"), "total_game_hours", power=0.5), 9).alias("label"))


@query("label_percentage", "select id_string, round(found_helpful_percentage * 100, 9) as label from r where found_helpful_percentage is not null")
def label_percentage(spark, sf):
    """Fractions of a percentage label become percents."""
    s = rv.label_scan(rv.stored(spark, sf, ["game", "found_helpful_percentage"]), None, "found_helpful_percentage")
    return s.select("id_string", F.round("label", 9).alias("label"))


@query("label_binned_value", f", t as (select id_string, v from h where v <= 16435) select id_string, {_BIN_CASE} as label from t")
def label_binned_value(spark, sf):
    """L1 with bins: a value without a bin would be an error, so the scan keeps to the bins' span."""
    df = hours(spark, sf).where("v <= 16435")
    return df.select("id_string", lb.label_value(F.col("v"), "total_game_hours", ranges=HOURS_BINS).alias("label"))


@query(
    "label_transforms",
    """select id_string, round(v ^ 0.25, 6) as root4, round(sqrt(v), 6) as sqrt, round(ln(v + 1), 6) as log1p, round(log2(v + 1), 6) as log2p, round(log10(v + 1), 6) as log10p,
  round(v ^ 2 / 1e6, 6) as pow2, round(v ^ 5 / 1e26, 6) as pow5 from h""",
)
def label_transforms(spark, sf):
    """The fifth power is scaled down, so that it can be compared."""
    scale = {"pow2": 1e6, "pow5": 1e26}
    cols = [F.round(f(F.col("v")) / scale.get(k, 1.0), 6).alias(k) for k, f in lb.TRANSFORMS.items()]
    return hours(spark, sf).select("id_string", *cols)


@query(
    "derived_arithmetic",
    """select id_string, num_voted_helpfulness - num_found_helpful as unhelpful,
  case when num_voted_helpfulness <> 0 then round(num_found_helpful / num_voted_helpfulness, 9) end as helpful_share,
  case when achievement_progress.num_achievements_possible <> 0
  then round(achievement_progress.num_achievements_attained / achievement_progress.num_achievements_possible, 9) end as achieved_share from r""",
)
def derived_arithmetic(spark, sf):
    """L8."""
    df = rv.stored(spark, sf, ["num_found_helpful", "num_voted_helpfulness", "achievement_progress"])
    a = F.col("achievement_progress")
    return df.select(
        "id_string",
        (F.col("num_voted_helpfulness") - F.col("num_found_helpful")).alias("unhelpful"),
        F.round(F.try_divide(F.col("num_found_helpful"), F.col("num_voted_helpfulness")), 9).alias("helpful_share"),
        F.round(F.try_divide(a["num_achievements_attained"], a["num_achievements_possible"]), 9).alias("achieved_share"),
    )


@query("half_even_rounding", "select event_id, round_even(value, 0)::double as rounded, round_even(value / 2, 0)::double as half from events")
def half_even_rounding(spark, sf):
    """L9."""
    return table(spark, sf, "events").select("event_id", lb.half_even(F.col("value")).alias("rounded"), lb.half_even(F.col("value") / 2).alias("half"))


@query("zscore_label", ", m as (select avg(v) as m, stddev_pop(v) as s from h) select id_string, round((v - m) / s, 6) as z from h, m")
def zscore_label(spark, sf):
    """W16."""
    return ds.zscores(hours(spark, sf), "v").select("id_string", F.round("z", 6).alias("z"))


# ---- scans, projections, filters -----------------------------------------------------------------

_LINE = """with t as (select raw_id, case when json_valid(line) then line::json end as j from raw_review)
select raw_id, j ->> 'steam_id_number' as steam_id_number, j ->> 'rating' as rating, (j ->> 'total_game_hours')::double as total_game_hours,
  (j ->> 'num_comments')::bigint as num_comments, (j -> 'achievement_progress' ->> 'num_achievements_attained')::bigint as attained from t"""


@query("json_lines_parsed", _LINE)
def json_lines_parsed(spark, sf):
    """Lines parsed with the fixed schema; a cut line is all null."""
    p = rv.parsed_lines(table(spark, sf, "raw_review"))
    cols = ["steam_id_number", "rating", "total_game_hours", "num_comments"]
    bad = table(spark, sf, "raw_review").select("raw_id", F.col("line").rlike("\\}\\s*$").alias("closed"))
    j = p.join(bad, "raw_id")
    return j.select("raw_id", *[F.when(F.col("closed"), F.col(c)).alias(c) for c in cols], F.when(F.col("closed"), F.col("achievement_progress.num_achievements_attained")).alias("attained"))


@query("typed_hours", f"select raw_id, total_game_hours from ({_LINE}) where total_game_hours is not null")
def typed_hours(spark, sf):
    """Rows whose required fields could be read."""
    return rv.typed_hours(json_lines_parsed(spark, sf)).select("raw_id", "total_game_hours")


@query("partition_scan", "select id_string, appid, num_reviews from parted where game = 'Paper_Frontier' and part = 'training'")
def partition_scan(spark, sf):
    """S5 P1 P2."""
    return rv.stored(spark, sf, ["appid", "num_reviews"], rv.of_scan("train", ["Paper_Frontier"]))


@query("sorted_scan", "select id_string, steam_id_number from parted where part = 'test' and game in ('Paper_Frontier', 'Salt_Rally')")
def sorted_scan(spark, sf):
    """S6 W10."""
    df = rv.stored(spark, sf, ["steam_id_number"], rv.of_scan("test", ["Paper_Frontier", "Salt_Rally"]))
    return rv.scan(df, columns=["id_string", "steam_id_number"])


@query("scan_by_ids", "select id_string, game from r where id_string in (select id from fold_set where set_name = 'training_set')")
def scan_by_ids(spark, sf):
    """S6 J1."""
    ids = table(spark, sf, "fold_set").where("set_name = 'training_set'").select("id")
    return rv.stored(spark, sf, ["game"], ids=ids)


@query("label_scan_games", "select id_string, num_friends::double as label from r where game in ('Paper_Frontier', 'Salt_Rally') and num_friends is not null")
def label_scan_games(spark, sf):
    """S7 P7."""
    return rv.label_scan(rv.stored(spark, sf, ["num_friends"], rv.of_scan(games=["Paper_Frontier", "Salt_Rally"])), None, "num_friends")


@query("game_catalog_join", "select r.id_string, r.game, c.appid as catalog_appid, r.appid is distinct from c.appid as differs from r join game_catalog c using (game)")
def game_catalog_join(spark, sf):
    """S11 J8."""
    j = rv.game_ids(rv.stored(spark, sf, ["game", "appid"]), table(spark, sf, "game_catalog"))
    return j.select("id_string", "game", "catalog_appid", (~F.col("appid").eqNullSafe(F.col("catalog_appid"))).alias("differs"))


@query("row_count", "select count(*) as stored_rows, count(distinct id_string) as reviews from review")
def row_count(spark, sf):
    """S12."""
    return table(spark, sf, "review").agg(F.count("*").alias("stored_rows"), F.countDistinct("id_string").alias("reviews"))


@query("page_plan", "select i + 1 as page, i * 10 as offset from range(0, 4) t(i)")
def page_plan(spark, sf):
    """Pages of a listing of 95 rows, limited to 40."""
    return spark.createDataFrame(rv.page_offsets(95, 40), "page long, offset long")


@query("lookup_features", ", i as (select id from fold_set where set_name = 'test_set') select i.id, coalesce(cardinality(r.nlp_features), 0)::int as n_features from i left join r on r.id_string = i.id")
def lookup_features(spark, sf):
    """S8 J4."""
    ids = table(spark, sf, "fold_set").where("set_name = 'test_set'").select(F.col("id").alias("id_string"))
    j = rv.stored_features(ids, rv.stored(spark, sf, ["nlp_features"]))
    return j.select(F.col("id_string").alias("id"), F.coalesce(F.size(F.map_keys("nlp_features")), F.lit(0)).alias("n_features"))


@query(
    "nested_label_lookup",
    """select id_string, achievement_progress.num_achievements_attained as attained, achievement_progress.num_achievements_percentage as percentage, num_badges as badges from r""",
)
def nested_label_lookup(spark, sf):
    """P3 M1."""
    df = rv.stored(spark, sf, ["achievement_progress", "num_badges"])
    col = lambda n, a: lb.label_column(df, n).alias(a)
    return df.select("id_string", col("num_achievements_attained", "attained"), col("num_achievements_percentage", "percentage"), col("num_badges", "badges"))


_LABEL_COLS = ", ".join(
    f"('{n}', {'achievement_progress.' if n.startswith('num_achievements') else ''}{n}::double)" for n in LABELS
)
_P4 = f""", l as (select id_string, x.key as feature, x.val as value from (select id_string, unnest([{", ".join(f"{{'key': '{n}', 'val': {'achievement_progress.' if n.startswith('num_achievements') else ''}{n}::double}}" for n in LABELS)}]) as x
  from r)),
t as (select id_string, e.key as feature, e.value::double as value from (select id_string, unnest(map_entries(nlp_features)) as e from r where nlp_features is not null)),
u as (select * from l union all select * from t where feature not in ({", ".join(f"'{n}'" for n in LABELS)})),
f as (select u.* from u join r using (id_string) where u.value is not null and (u.value <> 0 or isnan(u.value))
  and r.num_games_owned is not null and r.num_games_owned <> 0)"""


@query("feature_assembly", _P4 + " select id_string, count(*) as n_features, round(sum(case when isnan(value) or value > 1e6 then 0 else value end), 4) as total from f group by 1")
def feature_assembly(spark, sf):
    """Text features and labels in one map, falsy values dropped."""
    df = rv.stored(spark, sf)
    m = df.select("id_string", ft.all_features(df, "num_games_owned").alias("m")).where("m is not null and size(m) > 0")
    v = F.transform(F.map_values("m"), lambda x: F.when(F.isnan(x) | (x > 1e6), 0.0).otherwise(x))
    return m.select("id_string", F.size("m").cast("bigint").alias("n_features"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(
    "data_points",
    _P4
    + f""" select id_string as id, (select round(ln(num_games_owned), 9) from r where r.id_string = f.id_string and num_games_owned > 1 union all
  select num_games_owned from r where r.id_string = f.id_string and num_games_owned <= 1) as y, count(*) as n_features from f
  where feature in ('num_friends', 'num_reviews') or feature not in ({", ".join(f"'{n}'" for n in LABELS)}) group by id_string""",
)
def data_points(spark, sf):
    """P5."""
    d = ft.data_points(rv.stored(spark, sf), "num_games_owned", True, ("num_friends", "num_reviews"), lognormal=True)
    return d.select("id", F.round("y", 9).alias("y"), F.size("x").cast("bigint").alias("n_features"))


@query("fixed_attributes", "select id_string, rating, (date_updated is not null)::int as updated, num_friends, num_guides from r")
def fixed_attributes(spark, sf):
    """P6."""
    return ft.fixed_attributes(rv.stored(spark, sf)).select("id_string", "rating", "updated", "num_friends", "num_guides")


@query("language_filter", "select doc_id, n_chars from documents where lang = 'en'")
def language_filter(spark, sf):
    """P14."""
    return table(spark, sf, "documents").where("lang = 'en'").select("doc_id", "n_chars")


@query("empty_text_filter", "select id_string from r where review is not null and trim(review, e' \\t\\n\\r') <> ''")
def empty_text_filter(spark, sf):
    """P15 P7."""
    df = rv.stored(spark, sf, ["review"])
    return df.where(F.regexp_replace("review", "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", "") != "").select("id_string")


@query("arff_lines", """select '"' || translate(replace(lower(replace(review, 'İ', chr(1))), chr(1), 'i' || chr(775)), e'\\'"\\\\', '') || '",' || num_reviews::varchar as line from r where review is not null and num_reviews is not null""")
def arff(spark, sf):
    """K4 T4."""
    df = rv.stored(spark, sf, ["review", "num_reviews"]).where("review is not null and num_reviews is not null")
    return arff_lines(df, "review", "num_reviews")


@query("semi_join_ids", "select doc_id, source from documents where doc_id in (select doc_id from content_label)")
def semi_join_ids(spark, sf):
    """J1."""
    ids = table(spark, sf, "content_label").select(F.col("doc_id").alias("id"))
    return sp.within(table(spark, sf, "documents").select("doc_id", "source"), ids, "doc_id")


@query("anti_join_used_ids", "select id_string from r where not exists (select 1 from fold_set f where f.id = r.id_string)")
def anti_join_used_ids(spark, sf):
    """J2."""
    return sp.without(rv.stored(spark, sf, []), table(spark, sf, "fold_set").select("id"), "id_string")


@query(
    "positional_join",
    """with w as (select doc_id, string_split(text, ' ') as w from documents where text is not null)
select *, length(word)::int as n from (select doc_id, (unnest(range(1, len(w) + 1)) - 1)::int as pos, unnest(w) as word from w)""",
)
def positional_join(spark, sf):
    """Two arrays joined by position, in the row itself; all positions of all texts."""
    df = table(spark, sf, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("w"))
    z = df.select("doc_id", F.posexplode(F.arrays_zip(F.col("w").alias("w"), F.transform("w", F.length).alias("n"))).alias("pos", "z"))
    return z.select("doc_id", "pos", F.col("z.w").alias("word"), F.col("z.n").alias("n"))


@query(
    "set_operations",
    """, a as (select distinct game from r), b as (select game from game_catalog)
select 'difference' as op, game from (select game from b except select game from a) union all select 'union', game from (select game from a union select game from b)
union all select 'intersection', game from (select game from a intersect select game from b)""",
)
def set_operations(spark, sf):
    """O1-O3."""
    a, b = table(spark, sf, "review").select("game").distinct(), table(spark, sf, "game_catalog").select("game")
    parts = {"difference": b.subtract(a), "union": a.union(b).distinct(), "intersection": a.intersect(b)}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("op"), "game")
        out = df if out is None else out.unionByName(df)
    return out


# ---- sampling ------------------------------------------------------------------------------------


def labelled(spark, sf) -> DataFrame:
    """(id, game, label): reviews with a bin of the hours played."""
    return hours(spark, sf).select(F.col("id_string").alias("id"), "game", lb.bin_index(F.col("v"), HOURS_BINS).alias("label")).where("label is not null")


_L = f", l as (select id_string as id, game, {_BIN_CASE} as label from h where {_BIN_CASE} is not null)"


@query(
    "split_train_test_extra",
    """, x as (select id_string, game, row_number() over (partition by game order by md5('1:' || id_string), id_string) as rn, least(count(*) over (partition by game), 30) as n from r)
select id_string, game, case when rn > 30 then 'extra' when rn <= ceil(n * 80.0 / 100) + 1 then 'training' else 'test' end as split from x""",
)
def split_train_test_extra(spark, sf):
    """W1."""
    return sp.train_test_extra(rv.stored(spark, sf, ["game"]), "game", 30, 80.0, "id_string")


_EVEN = """, c as (select label, count(*) as cnt from l group by 1), q as (select label, least(ceil({size} / count(*) over ()), floor(min(cnt) over () / {k}))::int as quota from c)"""
_STRAT = """, c as (select label, count(*) as cnt from l group by 1), w as (select *, ceil(cnt * {size} / sum(cnt) over ()) as want from c),
s as (select *, least(1.0, min(floor(cnt / {k}) / want) over ()) as shrink from w), q as (select label, greatest(floor(want * shrink), 0)::int as quota from s)"""
_FOLDS = """, rk as (select id, l.label, row_number() over (partition by l.label order by md5('{seed}:' || id), id) as rn from l),
g as (select id, floor((rn - 1) / quota)::int + 1 as fold from rk join q using (label) where rn <= quota * {k}),
z as (select id, fold, row_number() over (partition by fold order by md5('{next}:' || id), id) - 1 as pos from g)
select '{name}' as set_name, fold, pos, id from z where pos < {size}"""


def _fold_sql(kind: str, k: int, size: int, name: str = "training_set", seed: int = 12345) -> str:
    return _L + kind.format(size=size, k=k) + _FOLDS.format(k=k, size=size, seed=seed, next=seed + 1, name=name)


@query("folds_even", _fold_sql(_EVEN, 3, 15))
def folds_even(spark, sf):
    """W2 W5 J3."""
    return sp.folds(labelled(spark, sf), "label", 3, 15, "even")


@query("folds_stratified", _fold_sql(_STRAT, 4, 50))
def folds_stratified(spark, sf):
    """W2 W3 J3."""
    return sp.folds(labelled(spark, sf), "label", 4, 50, "stratified")


@query("test_set_even", _fold_sql(_EVEN, 1, 30, "test_set"))
def test_set_even(spark, sf):
    """W4."""
    return sp.folds(labelled(spark, sf), "label", 1, 30, "even", set_name="test_set")


@query("sample_quotas", _L + _STRAT.format(size=200, k=2) + " select label, quota from q")
def sample_quotas(spark, sf):
    """W3."""
    return sp.quotas(labelled(spark, sf), "label", 200, "stratified", 2).select("label", "quota")


def _layer(p: str, src: str, k: int, size: int) -> str:
    return f""", {p}c as (select label, count(*) as cnt from {src} group by 1), {p}w as (select *, ceil(cnt * {size} / sum(cnt) over ()) as want from {p}c),
{p}s as (select *, least(1.0, min(floor(cnt / {k}) / want) over ()) as shrink from {p}w), {p}q as (select label, greatest(floor(want * shrink), 0)::int as quota from {p}s),
{p}r as (select id, label, row_number() over (partition by label order by md5('12345:' || id), id) as rn from {src}),
{p}g as (select id, floor((rn - 1) / quota)::int + 1 as fold from {p}r join {p}q using (label) where rn <= quota * {k}),
{p}z as (select * from (select id, fold, row_number() over (partition by fold order by md5('12346:' || id), id) - 1 as pos from {p}g) where pos < {size})"""


_LAYERED = (
    _L
    + _layer("t1", "l", 1, 20)
    + ", l2 as (select * from l where id not in (select id from t1z))"
    + _layer("t2", "l2", 3, 15)
    + ", l3 as (select * from l2 where id not in (select id from t2z))"
    + _layer("t3", "l3", 2, 10)
    + """ select 'test_set' as set_name, fold, pos, id from t1z union all select 'training_set', fold, pos, id from t2z
union all select 'grid_search_set', fold, pos, id from t3z"""
)


@query("layered_sample", _LAYERED)
def layered_sample(spark, sf):
    """Test set, training folds and grid-search folds, disjoint."""
    return sp.layered(labelled(spark, sf), "label", 20, (3, 15), (2, 10), "stratified")


@query("fold_check", ", f as (select set_name, count(distinct fold) as folds from fold_set group by 1) select set_name, folds, folds >= 0.75 * 5 as enough from f")
def fold_check(spark, sf):
    """W6."""
    f = table(spark, sf, "fold_set").groupBy("set_name").agg(F.countDistinct("fold").alias("folds"))
    return f.withColumn("enough", F.col("folds") >= F.lit(0.75 * 5))


@query("labels_to_ids", _L + " select label, row_number() over (partition by label order by id) - 1 as pos, id from l")
def labels_to_ids(spark, sf):
    """W8."""
    return sp.labels_of(labelled(spark, sf), "label")


@query("round_robin", _L + " select row_number() over (partition by label order by md5('12345:' || id), id) as turn, label, id from l")
def round_robin(spark, sf):
    """W9."""
    return sp.round_robin(labelled(spark, sf), "label")


@query("limited_scan", "select id_string, steam_id_number from r where steam_id_number is not null order by steam_id_number, id_string limit 25")
def limited_scan(spark, sf):
    """A limit asked for by the user."""
    return rv.scan(rv.stored(spark, sf, ["steam_id_number"]).where("steam_id_number is not null"), columns=["id_string", "steam_id_number"]).limit(25)


@query("leave_one_out_pairs", "with f as (select distinct fold from fold_set where set_name = 'training_set') select a.fold as held_out, b.fold from f a join f b on a.fold <> b.fold")
def leave_one_out_pairs(spark, sf):
    """W14."""
    return sp.leave_one_out(table(spark, sf, "fold_set").where("set_name = 'training_set'"))


@query("stratified_kfold", _L + " select id, label, ((row_number() over (partition by label order by md5('12345:' || id), id) - 1) % 5)::int as fold from l")
def stratified_kfold(spark, sf):
    """W15."""
    return sp.stratified_kfold(labelled(spark, sf), "label", 5)


@query("two_week_hours", "with m as (select max(ts) as t from events) select user_id, round(sum(value), 6) as hours from events, m where ts > t - interval 14 day group by 1")
def two_week_hours(spark, sf):
    """R3."""
    e = table(spark, sf, "events").select("user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    last = e.agg(F.max("ts") - F.expr("interval 14 days")).scalar()
    return e.where(F.col("ts") > last).groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("hours"))
