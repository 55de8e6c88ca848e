"""Core queries: text functions, scraped strings, features, learning, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import scrape as sc
from ..functions import text as tx
from ..operators import describe as ds
from ..operators import features as ft
from ..operators import learn as ln
from ..operators import metrics as mt
from ..operators import sampling as sp
from ..operators import vectorize as vz
from ..sources import reviews as rv
from ..sources.tables import spread, table
from .core_queries import SQL, Q, R, query


def texts(spark, sf) -> DataFrame:
    """Every text that is not empty, of all languages."""
    return spread(table(spark, sf, "documents").where("text <> ''").select("doc_id", "text"))


_EN = "en as (select doc_id, text from documents where text <> '')"


def _norm_sql(col: str, lower: bool = True) -> str:
    low = f"lower(replace({col}, chr(304), 'i' || chr(775)))"  # a dotted capital I has two characters in lower case
    out = f"regexp_replace(trim({low if lower else col}), '[\\n\\t ]+', ' ', 'g')"
    for short, full in tx.CONTRACTIONS:
        out = f"regexp_replace({out}, '\\b{short}\\b', '{full.replace(chr(39), chr(39) * 2)}', 'gi')"
    return out


@query("normalize_text", f"with {_EN} select doc_id, md5({_norm_sql('text')}) as digest from en")
def normalize_text(spark, sf):
    """F1 T3."""
    return texts(spark, sf).select("doc_id", F.md5(tx.normalized(F.col("text"))).alias("digest"))


@query("length_feature", "select doc_id, case when length(text) = 1 then 0 else ceil(log2(length(text)))::int end as size from documents where text <> ''")
def length_feature(spark, sf):
    """F2."""
    d = table(spark, sf, "documents").where("text <> ''")
    return d.select("doc_id", tx.length_feature(F.col("text")).alias("size"))


def _sentence_sql() -> str:
    # a sentence ends behind . ! ? before white space; the sign stays with it
    return f"""{_EN}, n as (select doc_id, regexp_replace(trim({_norm_sql("text")}), '([.!?])\\s+', '\\1' || chr(1), 'g') as t from en),
s as (select doc_id, unnest(string_split(t, chr(1))) as s from n),
k as (select doc_id, regexp_extract_all(s, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}\\s]') as w from s),
g as (select doc_id, unnest(w) as feature from k union all
      select doc_id, w[i] || ' ' || w[i + 1] from (select doc_id, w, unnest(range(1, len(w))) as i from k where len(w) > 1))"""


#: Of each text the number of features, their sum and largest value, and a digest of all names and values.
_OF_FEATURES = "select doc_id as id, count(*) as n_features, sum(value)::bigint as total, max(value)::int as most, md5(string_agg(feature || ':' || value, chr(10) order by feature)) as digest"


def of_features(counts: DataFrame) -> DataFrame:
    f = F.col("features")
    total = F.aggregate(f, F.lit(0).cast("bigint"), lambda a, x: a + x["value"])
    lines = F.transform(f, lambda x: F.concat(x["feature"], F.lit(":"), x["value"].cast("string")))
    most = F.array_max(F.transform(f, lambda x: x["value"]))
    return counts.where(F.size(f) > 0).select("id", F.size(f).cast("bigint").alias("n_features"), total.alias("total"), most.alias("most"), F.md5(F.array_join(lines, "\n")).alias("digest"))


@query("word_ngrams", f"with {_sentence_sql()}, c as (select doc_id, feature, count(*) as value from g group by 1, 2) {_OF_FEATURES} from c group by 1")
def word_ngrams(spark, sf):
    """F3 F11 A7."""
    return of_features(ft.word_counts(texts(spark, sf), "doc_id", "text"))


@query("word_frequency", f"with {_sentence_sql()} select feature, count(*) as n, count(distinct doc_id) as docs from g group by 1")
def word_frequency(spark, sf):
    """Over the whole corpus."""
    long = ft.exploded(ft.word_counts(texts(spark, sf), "doc_id", "text"))
    return long.groupBy("feature").agg(F.sum("value").alias("n"), F.count("*").alias("docs"))


_CHARS = """c0 as (select doc_id, string_split(text, '') as c from en),
c1 as (select doc_id, unnest(c) as c, generate_subscripts(c, 1) as i from c0),
c2 as (select doc_id, c as a, lead(c, 1) over w as b, lead(c, 2) over w as c, lead(c, 3) over w as d, lead(c, 4) over w as e from c1 window w as (partition by doc_id order by i)),
g2 as (select doc_id, a || b as feature from c2 where b is not null union all select doc_id, a || b || c from c2 where c is not null
  union all select doc_id, a || b || c || d from c2 where d is not null union all select doc_id, a || b || c || d || e from c2 where e is not null)"""


@query("char_ngrams", f"with {_EN}, {_CHARS}, f as (select doc_id, feature, count(*) as value from g2 group by 1, 2) {_OF_FEATURES} from f group by 1")
def char_ngrams(spark, sf):
    """F4."""
    return of_features(ft.char_counts(texts(spark, sf), "doc_id", "text"))


@query(
    "feature_merge_priority",
    f"""with {_sentence_sql()}, {_CHARS},
w as (select doc_id, feature, count(*) as value from g group by 1, 2), c as (select doc_id, feature, count(*) as value from g2 group by 1, 2),
l as (select doc_id, case when length(text) = 1 then '0' else ceil(log2(length(text)))::int::varchar end as feature, 1 as value from en),
u as (select 1 as p, * from l union all select 2, * from w union all select 3, * from c),
m as (select doc_id, feature, max_by(value, p) as value from u group by 1, 2) {_OF_FEATURES} from m group by 1""",
)
def feature_merge_priority(spark, sf):
    """An equal name of a later family takes the place of the former."""
    return of_features(ft.extracted(texts(spark, sf), "doc_id", "text"))


@query("binarized_features", "select id_string, cardinality(nlp_features)::bigint as total from r where nlp_features is not null")
def binarized_features(spark, sf):
    """F9 M3."""
    df = rv.stored(spark, sf, ["nlp_features"]).where("nlp_features is not null")
    v = F.map_values(ft.binarized_map(F.col("nlp_features")))
    return df.select("id_string", F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("features_to_extract", "select id_string from r where id_string not in (select id_string from r where nlp_features is not null)")
def features_to_extract(spark, sf):
    """F10."""
    df = rv.stored(spark, sf, ["nlp_features"])
    return ft.to_extract(df.select("id_string"), df.where("nlp_features is not null"))


def _clusters(spark, sf) -> DataFrame:
    """A supplied token -> cluster table: words of part names by the number of the first part that has them."""
    p = table(spark, sf, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), "\\s+")).alias("token"))
    return p.groupBy("token").agg((F.min("p_partkey") % 97).alias("cluster"))


@query(
    "cluster_features",
    f"""with {_EN}, c as (select token, min(p_partkey) % 97 as cluster from (select p_partkey, unnest(string_split_regex(lower(p_name), '\\s+')) as token from part) group by 1),
t as (select doc_id as id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}\\s]')) as token from en)
select id, 'cluster' || cluster::varchar as feature, count(*)::int as value from t join c using (token) group by 1, 2""",
)
def cluster_features(spark, sf):
    """F5."""
    t = texts(spark, sf).select(F.col("doc_id").alias("id"), F.explode(tx.tokens(F.lower("text"))).alias("token"))
    return ft.cluster_features(t, _clusters(spark, sf)).select("id", "feature", "value")


@query("doc_frequency_topk", ", e as (select id_string, unnest(map_keys(nlp_features)) as feature from r where nlp_features is not null) select feature, count(*) as records from e group by 1 order by records desc, feature limit 50")
def doc_frequency_topk(spark, sf):
    """A report of the 50 features in most records."""
    return ft.document_frequency(stored_long(spark, sf), 50)


def stored_long(spark, sf, *keep: str) -> DataFrame:
    df = rv.stored(spark, sf, ["nlp_features", *keep]).where("nlp_features is not null")
    return df.select(F.col("id_string").alias("id"), *keep, F.explode("nlp_features").alias("feature", "value"))


@query("vocabulary", ", e as (select distinct unnest(map_keys(nlp_features)) as feature from r where nlp_features is not null) select feature, row_number() over (order by feature collate \"C\") - 1 as index from e")
def vocabulary(spark, sf):
    """V1."""
    return ft.ranked_vocabulary(stored_long(spark, sf))


@query("hashed_features", ", e as (select id_string as id, unnest(map_entries(nlp_features)) as e from r where nlp_features is not null) select id, (('0x' || substr(md5(e.key), 1, 8))::bigint % 100000)::int as slot, sum(coalesce(e.value, 0))::double as value from e group by 1, 2")
def hashed_features(spark, sf):
    """V2 V3."""
    return vz.hashed(stored_long(spark, sf).na.fill(0, ["value"]), 100_000)


# ---- scraped strings -----------------------------------------------------------------------------


@query("collapse_spaces", f"with {_EN} select doc_id, md5(trim(regexp_replace(replace(text, '<br>', ' '), '\\s+', ' ', 'g'))) as digest from en")
def collapse_spaces(spark, sf):
    """T1."""
    return texts(spark, sf).select("doc_id", F.md5(tx.spaces_collapsed(F.col("text"))).alias("digest"))


@query("comma_numbers", "select event_id, (value * 1000)::bigint as n, try_cast(case when event_id % 7 = 0 then 'x1,2' end as bigint) as bad from events")
def comma_numbers(spark, sf):
    """Numbers written with commas come back; what is none is null."""
    e = table(spark, sf, "events").select("event_id", F.round(F.col("value") * 1000, 0).cast("bigint").alias("v"))
    bad = F.when(F.col("event_id") % 7 == 0, "x1,2")
    return e.select("event_id", tx.number(F.format_number("v", 0)).alias("n"), tx.number(bad).alias("bad"))


@query("ascii_fold", "select doc_id, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) as n from documents where text is not null")
def ascii_fold(spark, sf):
    """T3."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.length(tx.ascii_only(F.col("text"))).cast("bigint").alias("n"))


@query("game_titles", "select game, replace(game, '_', ' ') as title from game_catalog")
def game_titles(spark, sf):
    """T4."""
    return table(spark, sf, "game_catalog").select("game", tx.underscores_to_spaces(F.col("game")).alias("title"))


@query(
    "helpful_strings",
    """select id_string, num_found_helpful, num_voted_helpfulness, num_voted_helpfulness - num_found_helpful as num_found_unhelpful,
  case when num_voted_helpfulness <> 0 then round(num_found_helpful / num_voted_helpfulness, 9) end as share, num_found_funny from r""",
)
def helpful_strings(spark, sf):
    """T5: counts written as the site writes them, parsed back."""
    df = rv.stored(spark, sf, ["num_found_helpful", "num_voted_helpfulness", "num_found_funny"])
    s = F.concat(
        F.format_number("num_found_helpful", 0), F.lit(" of "), F.format_number("num_voted_helpfulness", 0), F.lit(" people (50%) found this review helpful "),
        F.format_number("num_found_funny", 0), F.lit(" people found this review funny"),
    )
    h = sc.helpful_funny(s)
    return df.select("id_string", *[h[c].alias(c) for c in ("num_found_helpful", "num_voted_helpfulness", "num_found_unhelpful", "num_found_funny")], F.round(h["found_helpful_percentage"], 9).alias("share"))


@query(
    "posted_dates",
    """, u as (select id_string, regexp_replace(date_posted, '[ap]m$', upper(right(date_posted, 2))) as date_posted,
  regexp_replace(date_updated, '[ap]m$', upper(right(date_updated, 2))) as date_updated from r)
select *, strptime(date_posted, '%b %-d, %Y, %-I:%M%p') as posted_at from u""",
)
def posted_dates(spark, sf):
    """Date strings as on the site, parsed back, and as a timestamp."""
    df = rv.stored(spark, sf, ["date_posted", "date_updated"])
    site = lambda c: F.concat(F.regexp_replace(c, "(?i), (\\d+:\\d+[AP]M)$", " @ "), F.lower(F.regexp_extract(c, "(?i)(\\d+:\\d+[AP]M)$", 1)))
    s = F.concat(F.lit("Posted: "), site("date_posted"), F.coalesce(F.concat(F.lit(" Updated: "), site("date_updated")), F.lit("")))
    p = sc.posted_dates(s)
    return df.select("id_string", p["date_posted"].alias("date_posted"), p["date_updated"].alias("date_updated"), sc.timestamp_of(p["date_posted"]).cast("timestamp_ntz").alias("posted_at"))


@query("hours_strings", "select id_string, round(v, 1) as total, 1.5::double as last_two_weeks from h")
def hours_strings(spark, sf):
    """T7."""
    from .core_queries import hours

    df = hours(spark, sf)
    h = sc.hours(F.concat(F.lit("1.5 hrs last two weeks / "), F.format_number("v", 1), F.lit(" hrs on record")))
    return df.select("id_string", h["total"].alias("total"), h["last_two_weeks"].alias("last_two_weeks"))


@query("url_parts", "select id_string, array_to_string(string_split(review_url, '/')[1:5], '/') as profile, string_split(review_url, '/')[5] as user from r")
def url_parts(spark, sf):
    """T8."""
    u = sc.url_parts(F.col("review_url"))
    return rv.stored(spark, sf, ["review_url"]).select("id_string", u["profile"].alias("profile"), u["user"].alias("user"))


@query("comment_counts", "select id_string, num_comments from r")
def comment_counts(spark, sf):
    """T9."""
    html = F.concat(F.lit('<div><span id="commentthread_1_totalcount">'), F.col("num_comments").cast("string"), F.lit("</span></div>"))
    return rv.stored(spark, sf, ["num_comments"]).select("id_string", sc.comment_count(html).alias("num_comments"))


@query("html_elements", "select id_string, [trim(username)] as strings from r where username is not null")
def html_elements(spark, sf):
    """Stripped strings of elements by tag and class."""
    html = F.concat(F.lit('<div class="a"><span class="title x">'), F.col("username"), F.lit("</span> <b>no</b></div><span>other</span>"))
    return rv.stored(spark, sf, ["username"]).where("username is not null").select("id_string", sc.element_strings(html, "span", "title").alias("strings"))


@query("pairwise_counts", "select id_string, num_games_owned as games, num_reviews as reviews, 0::bigint as screens from r")
def pairwise_counts(spark, sf):
    """Alternating numbers and names as a map, 0 by default."""
    df = rv.stored(spark, sf, ["num_games_owned", "num_reviews"])
    m = sc.pairs_map(F.array(F.format_number("num_games_owned", 0), F.lit("Games"), F.format_number("num_reviews", 0), F.lit("Reviews")))
    return df.select("id_string", sc.map_number(m, "Games").alias("games"), sc.map_number(m, "Reviews").alias("reviews"), sc.map_number(m, "Screenshots").alias("screens"))


@query("joined_fragments", f"with {_EN}, w as (select doc_id, string_split(text, ' ') as w from en) select doc_id, md5(array_to_string(w[5:], ' ')) as digest from w")
def joined_fragments(spark, sf):
    """T12."""
    return texts(spark, sf).select("doc_id", F.md5(tx.joined_from(F.split("text", " "))).alias("digest"))


@query("event_props", "select event_id, (props ->> '$.k')::bigint as k from events")
def event_props(spark, sf):
    """M1 M2: a member of a JSON text."""
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# ---- evaluation ----------------------------------------------------------------------------------

_P = """p0 as (select learner, fold, id, y, p from prediction
  where y is not null and p is not null and lower(y::varchar) <> 'nan' and lower(p::varchar) <> 'nan'),
p as (select distinct on (learner, fold, id) * from p0), q as (select learner, fold, id, round_even(y, 0) + 0.0 as y, round_even(p, 0) + 0.0 as p from p),
cf as (select learner, fold, y as actual, p as predicted, count(*) as n from q group by 1, 2, 3, 4)"""
_BY = mt.KEYS


def preds(spark, sf) -> DataFrame:
    return mt.usable(table(spark, sf, "prediction"))


def r9(df: DataFrame, skip=("learner", "fold", "n")) -> DataFrame:
    return df.select(*[c if c in skip else F.round(c, 9).alias(c) for c in df.columns])


@query("confusion_matrix", f"with {_P}, l as (select learner, fold, actual as v from cf union select learner, fold, predicted from cf) select a.learner, a.fold, a.v as actual, b.v as predicted, coalesce(n, 0) as n from l a join l b using (learner, fold) left join cf on cf.learner = a.learner and cf.fold = a.fold and cf.actual = a.v and cf.predicted = b.v")
def confusion_matrix(spark, sf):
    """A10."""
    return mt.full_confusion(mt.confusion(preds(spark, sf)))


_CLASS = f"""{_P}, l as (select learner, fold, actual as v from cf union select learner, fold, predicted from cf),
k as (select l.learner, l.fold, l.v, coalesce(sum(n) filter (where actual = v), 0) as s, coalesce(sum(n) filter (where predicted = v), 0) as q,
  coalesce(sum(n) filter (where actual = v and predicted = v), 0) as h from l join cf using (learner, fold) group by 1, 2, 3),
m as (select *, case when q = 0 then 0 else h / q end as pr, case when s = 0 then 0 else h / s end as re, case when s + q = 0 then 0 else 2 * h / (s + q) end as f1 from k)"""


@query(
    "accuracy_precision_f1",
    f"""with {_CLASS} select learner, fold, round(sum(h) / sum(s), 9) as accuracy, round(avg(pr), 9) as precision_macro, round(sum(pr * s) / sum(s), 9) as precision_weighted,
  round(avg(f1), 9) as f1_macro, round(sum(f1 * s) / sum(s), 9) as f1_weighted, round(avg(re), 9) as recall_macro,
  round((list(f1 order by s, v) filter (where s > 0))[1], 9) as f1_score_least_frequent from m group by 1, 2""",
)
def accuracy_precision_f1(spark, sf):
    """E1-E4."""
    return r9(mt.class_scores(mt.confusion(preds(spark, sf))))


def _kappa_sql() -> str:
    d = "abs(actual - predicted)"
    parts = []
    for suffix, x in (("", d), ("_off_by_one", f"greatest({d} - 1, 0)")):
        for name, w in (("uwk", f"(case when {x} = 0 then 0 else 1 end)"), ("lwk", f"({x})"), ("qwk", f"({x}) ^ 2")):
            parts.append(f"round(1 - sum({w} * o) / nullif(sum({w} * e), 0), 9) as {name}{suffix}")
    return f"""with {_P}, t as (select learner, fold, sum(n) as t from cf group by 1, 2), a as (select learner, fold, actual, sum(n) as r from cf group by 1, 2, 3),
b as (select learner, fold, predicted, sum(n) as c from cf group by 1, 2, 3),
x as (select learner, fold, actual, predicted, n::double as o, 0.0::double as e from cf union all select learner, fold, actual, predicted, 0, r * c / t from a join b using (learner, fold) join t using (learner, fold))
select learner, fold, {", ".join(parts)} from x group by 1, 2"""


@query("kappa_all", _kappa_sql())
def kappa_all(spark, sf):
    """E5."""
    return r9(mt.kappas(mt.confusion(preds(spark, sf))))


@query("pearson", f"with {_P} select learner, fold, count(*) as n, round(case when stddev_pop(y) * stddev_pop(p) > 0 then corr(y, p) end, 9) as r from p group by 1, 2")
def pearson(spark, sf):
    """E6 raw."""
    return r9(mt.pearson(preds(spark, sf), "y", "p"))


@query("pearson_significance")
def pearson_significance(spark, sf):
    """E6 with the two-sided p."""
    return r9(mt.with_p(mt.pearson(mt.rounded(preds(spark, sf)), "y", "p")))


_RANK = "rank() over (partition by learner, fold order by {0}) + (count(*) over (partition by learner, fold, {0}) - 1) / 2.0"


@query("spearman", f"with {_P}, k as (select learner, fold, {_RANK.format('y')} as a, {_RANK.format('p')} as b from p) select learner, fold, count(*) as n, round(case when stddev_pop(a) * stddev_pop(b) > 0 then corr(a, b) end, 9) as rho from k group by 1, 2")
def spearman(spark, sf):
    """E7."""
    return r9(mt.spearman(preds(spark, sf)))


@query(
    "kendall",
    f"""with {_P}, c as (select x.learner, x.fold, sum(sign(x.actual - z.actual) * sign(x.predicted - z.predicted) * x.n * z.n) / 2 as cd from cf x join cf z using (learner, fold) group by 1, 2),
n as (select learner, fold, sum(n) as n from cf group by 1, 2), a as (select learner, fold, sum(r * (r - 1)) / 2 as t from (select learner, fold, actual, sum(n) as r from cf group by 1, 2, 3) group by 1, 2),
b as (select learner, fold, sum(r * (r - 1)) / 2 as u from (select learner, fold, predicted, sum(n) as r from cf group by 1, 2, 3) group by 1, 2)
select learner, fold, round(cd / nullif(sqrt((n * (n - 1) / 2 - t) * (n * (n - 1) / 2 - u)), 0), 9) as tau from c join n using (learner, fold) join a using (learner, fold) join b using (learner, fold)""",
)
def kendall(spark, sf):
    """E8."""
    return r9(mt.kendall(mt.confusion(preds(spark, sf))))


@query(
    "printable_confusion",
    f"""with {_P}, l as (select learner, fold, actual as v from cf union select learner, fold, predicted from cf),
g as (select a.learner, a.fold, a.v as i, b.v as j, coalesce(n, 0) as n from l a join l b using (learner, fold) left join cf on cf.learner = a.learner and cf.fold = a.fold and cf.actual = a.v and cf.predicted = b.v),
s as (select learner, fold, i, i::bigint::varchar || chr(9) || string_agg(n::varchar, chr(9) order by j) as line from g group by 1, 2, 3),
h as (select learner, fold, chr(9) || string_agg(v::bigint::varchar, chr(9) order by v) as head from l group by 1, 2)
select learner, fold, head || chr(10) || string_agg(line, chr(10) order by i) as printable from s join h using (learner, fold) group by learner, fold, head""",
)
def printable_confusion(spark, sf):
    """E11."""
    return mt.printable(mt.confusion(preds(spark, sf)))


@query("cv_aggregate", f"with {_CLASS}, f as (select learner, fold, sum(h) / sum(s) as accuracy, avg(f1) as f1_macro from m group by 1, 2) select learner, count(*) as folds, round(avg(accuracy), 9) as accuracy, round(avg(f1_macro), 9) as f1_macro from f group by 1")
def cv_aggregate(spark, sf):
    """A11."""
    m = mt.class_scores(mt.confusion(preds(spark, sf))).select("learner", "fold", "accuracy", "f1_macro")
    return r9(mt.across_folds(m), ("learner", "folds"))


@query("mean_confusion", f"with {_P}, k as (select learner, count(distinct fold) as k from cf group by 1) select learner, actual, predicted, round(sum(n) / k, 9) as mean_n from cf join k using (learner) group by 1, 2, 3, k")
def mean_confusion(spark, sf):
    """A11."""
    return r9(mt.mean_confusion(mt.confusion(preds(spark, sf))), ("learner", "actual", "predicted"))


@query("rank_learners", f"with {_CLASS}, f as (select learner, fold, sum(h) / sum(s) as a from m group by 1, 2), g as (select learner, round(avg(a), 9) as accuracy from f group by 1) select learner, accuracy, row_number() over (order by accuracy desc, learner) as place from g")
def rank_learners(spark, sf):
    """E13."""
    return mt.ranked(cv_aggregate(spark, sf), "accuracy")


@query(
    "rescale_predictions",
    f"""with {_P}, s as (select learner, fold, avg(p) as pm, stddev_pop(p) as ps, avg(y) as ym, stddev_pop(y) as ys, min(y) as lo, max(y) as hi from p group by 1, 2)
select learner, fold, id, round(case when ps = 0 then hi else greatest(lo, least(hi, (p - pm) / ps * ys + ym)) end, 6) as rescaled, greatest(lo, least(hi, p)) as clipped from p join s using (learner, fold)""",
)
def rescale_predictions(spark, sf):
    """L10."""
    w = Window.partitionBy("learner", "fold")
    p, y = F.col("p"), F.col("y")
    lo, hi = F.min(y).over(w), F.max(y).over(w)
    r = lb.rescaled(p, F.avg(p).over(w), F.stddev_pop(p).over(w), F.avg(y).over(w), F.stddev_pop(y).over(w), lo, hi)
    return preds(spark, sf).select("learner", "fold", "id", F.round(r, 6).alias("rescaled"), lb.clipped(p, lo, hi).alias("clipped"))


@query("fold_label_stats", f"with {_P}, f as (select distinct fold from p) select f.fold as held_out, round(avg(y), 9) as y_mean, round(stddev_pop(y), 9) as y_std from f join p on p.fold <> f.fold where learner = 'mnb' group by 1")
def fold_label_stats(spark, sf):
    """A12 W14."""
    p = preds(spark, sf).where("learner = 'mnb'").select("fold", "y")
    pairs = sp.leave_one_out(preds(spark, sf))
    return p.join(F.broadcast(pairs), "fold").groupBy("held_out").agg(F.round(F.avg("y"), 9).alias("y_mean"), F.round(F.stddev_pop("y"), 9).alias("y_std"))


@query("majority_baseline", f"with {_P}, c as (select learner, fold, y, count(*) as n from q group by 1, 2, 3), t as (select learner, fold, arg_max(y, n * 1000000 - y) as majority, max(n) as n, sum(n)::bigint as total from c group by 1, 2) select *, round(n / total, 9) as accuracy from t")
def majority_baseline(spark, sf):
    """A8 V8."""
    m = ds.majority(mt.rounded(preds(spark, sf)), _BY, "y")
    return m.withColumn("accuracy", F.round(F.col("n") / F.col("total"), 9))


@query("class_sets", f"with {_P}, a as (select distinct learner, y from q), b as (select distinct learner, p from q) select learner, count(*) as classes, count(*) = (select count(*) from b where b.learner = a.learner and b.p in (select y from a z where z.learner = a.learner)) as all_predicted from a group by learner")
def class_sets(spark, sf):
    """A9 O3."""
    q = mt.rounded(preds(spark, sf))
    a, b = q.select("learner", "y").distinct(), q.select("learner", F.col("p").alias("y")).distinct()
    hit = a.join(b.withColumn("hit", F.lit(1)), ["learner", "y"], "left")
    return hit.groupBy("learner").agg(F.count("*").alias("classes"), (F.count("*") == F.count("hit")).alias("all_predicted"))


# ---- learning ------------------------------------------------------------------------------------

_HELD = f"""with {R}, y as (select id_string as id, total_game_hours_bin::double as y, f.fold from r join fold_set f on f.id = r.id_string and f.set_name = 'training_set' where total_game_hours_bin is not null),
x as (select id, e.key as feature, e.value::double as value from (select id_string as id, unnest(map_entries(nlp_features)) as e from r where nlp_features is not null) where e.value > 0),
tr as (select id, y from y where fold <> {{held}}), te as (select id, y from y where fold = {{held}}),
fc as (select feature, y, sum(value) as total, count(*) as records from x join tr using (id) group by 1, 2), cl as (select y, count(*) as n from tr group by 1)"""
_TRAIN = _HELD.format(held=1)
#: The training folds of the tables.
FOLDS = range(1, 11)


def _every_fold(rest: str) -> str:
    """The statement for one held-out fold, for each of ``FOLDS`` that is there."""
    return " union all ".join(f"select *, {k} as fold from ({_HELD.format(held=k)}{rest}) where exists (select 1 from fold_set where set_name = 'training_set' and fold = {k})" for k in FOLDS)


def train_test(spark, sf, set_name: str = "training_set"):
    """(features, training labels, test labels, all labels with their fold): fold 1 held out of the folds."""
    folds = table(spark, sf, "fold_set").where(F.col("set_name") == set_name).select("id", "fold")
    df = rv.stored(spark, sf, ["total_game_hours_bin", "nlp_features"]).withColumnRenamed("id_string", "id")
    y = df.where("total_game_hours_bin is not null").select("id", F.col("total_game_hours_bin").cast("double").alias("y")).join(folds, "id")
    x = df.where("nlp_features is not null").select("id", F.explode("nlp_features").alias("feature", "value")).where("value > 0")
    return x, y.where("fold <> 1").select("id", "y"), y.where("fold = 1").select("id", "y"), y


_CHI2 = """, pr as (select y, n / sum(n) over () as s from cl), t as (select feature, sum(total) as t from fc group by 1),
g as (select feature, y, t * s as e, coalesce(total, 0) as o from t join pr on true left join fc using (feature, y)) select feature, round(sum((o - e) ^ 2 / e) + 1e-9, 6) as chi2 from g group by 1"""
_UPPER = _CHI2.replace("select feature, round(", ", c2 as (select feature, round(") + ") select feature from c2 where chi2 >= (select quantile_cont(chi2, 0.9) from c2)"


@query("chi2_scores", _TRAIN + _CHI2)
def chi2_scores(spark, sf):
    """V5."""
    x, train, _, _ = train_test(spark, sf)
    return vz.chi2(x.join(train.select("id"), "id", "left_semi"), train).select("feature", F.round(F.col("chi2") + 1e-9, 6).alias("chi2"))


@query("selected_features", _TRAIN + _UPPER)
def selected_features(spark, sf):
    """V5: the upper tenth."""
    return vz.selected(chi2_scores(spark, sf), 0.1)


_MNB = """, v as (select count(distinct feature) as v from fc), nc as (select y, sum(total) as nc from fc group by 1),
b as (select cl.y, ln(n / sum(n) over ()) as prior, ln(coalesce(nc, 0) + 0.1 * v) as den from cl left join nc using (y), v),
vo as (select distinct feature from fc), kn as (select te.id, x.feature, x.value from te join x using (id) join vo using (feature)),
s as (select te.id, b.y, prior + coalesce((select sum(k.value * (ln(coalesce(fc.total, 0) + 0.1) - b.den)) from kn k left join fc on fc.feature = k.feature and fc.y = b.y where k.id = te.id), 0) as s from te, b),
r2 as (select id, y, row_number() over (partition by id order by round(s, 6) desc, y) as k from s)
select id, y as p from r2 where k = 1"""


@query("mnb_predict", _TRAIN + _MNB)
def mnb_predict(spark, sf):
    """V7 V9: multinomial naive Bayes as counts and joins."""
    x, train, test, _ = train_test(spark, sf)
    w, base = ln.mnb_weights(*ln.nb_counts(x, train))
    return ln.mnb_predict(x.join(test.select("id"), "id", "left_semi"), test, w, base)


_BNB = """, b as (select y, n, ln(n / sum(n) over ()) as prior from cl), vo as (select distinct feature from fc),
v as (select feature, b.y, b.n from vo cross join b),
c as (select v.feature, v.y, ln((coalesce(records, 0) + 0.1) / (n + 0.2)) as lp, ln(1 - (coalesce(records, 0) + 0.1) / (n + 0.2)) as lq
  from v left join fc on fc.feature = v.feature and fc.y = v.y),
no as (select y, sum(lq) as q from c group by 1),
pr as (select te.id, c.y, sum(lp - lq) as s from te join x using (id) join c using (feature) group by 1, 2),
s as (select te.id, b.y, prior + q + coalesce(pr.s, 0) as s from te cross join b join no on no.y = b.y left join pr on pr.id = te.id and pr.y = b.y),
r2 as (select id, y, row_number() over (partition by id order by round(s, 6) desc, y) as k from s) select id, y as p from r2 where k = 1"""


@query("bnb_predict", _TRAIN + _BNB)
def bnb_predict(spark, sf):
    """V7 V9: Bernoulli naive Bayes as counts and joins."""
    x, train, test, _ = train_test(spark, sf)
    return ln.bnb_predict(x.join(test.select("id"), "id", "left_semi"), test, *ln.nb_counts(x, train))


@query("feature_weights", _TRAIN + """, v as (select count(distinct feature) as v from fc), nc as (select y, sum(total) as nc from fc group by 1),
w as (select feature, y, ln(total + 0.1) - ln(nc + 0.1 * v) as weight from fc join nc using (y), v) select feature, y, round(weight, 6) as weight from w order by abs(weight) desc, feature, y limit 100""")
def feature_weights(spark, sf):
    """A report of the 100 largest weights."""
    x, train, _, _ = train_test(spark, sf)
    w, _ = ln.mnb_weights(*ln.nb_counts(x, train))
    return sp.top_weights(w, 100).select("feature", "y", F.round("weight", 6).alias("weight"))


def _held_out(spark, sf, f) -> DataFrame:
    """``f(features, training labels, test ids)`` with every training fold held out in turn, and its fold."""
    x, _, _, y = train_test(spark, sf)
    out = None
    for (k,) in y.select("fold").distinct().orderBy("fold").collect():
        df = f(x, y.where(F.col("fold") != k).select("id", "y"), y.where(F.col("fold") == k).select("id", "y")).withColumn("fold", F.lit(k))
        out = df if out is None else out.unionByName(df)
    return out


def _chi2(x, train, _=None) -> DataFrame:
    return vz.chi2(x.join(train.select("id"), "id", "left_semi"), train).select("feature", F.round(F.col("chi2") + 1e-9, 6).alias("chi2"))


@query("chi2_scores_cv", _every_fold(_CHI2))
def chi2_scores_cv(spark, sf):
    """V5 on the training side of every held-out fold."""
    return _held_out(spark, sf, _chi2)


@query("selected_features_cv", _every_fold(_UPPER))
def selected_features_cv(spark, sf):
    """V5: the upper tenth on the training side of every held-out fold."""
    return _held_out(spark, sf, lambda x, train, _: vz.selected(_chi2(x, train), 0.1))


@query("mnb_cv", _every_fold(_MNB))
def mnb_cv(spark, sf):
    """V7 V9: multinomial naive Bayes with every fold held out, in one plan."""
    x, _, _, y = train_test(spark, sf)
    return ln.mnb_grid(x, y, [{"alpha": 0.1, "fit_prior": True}]).select("fold", "id", "p")


def _grid_sql(params: list[dict]) -> str:
    out = []
    for i, g in enumerate(params):
        rest = _MNB.replace("0.1", repr(g["alpha"]))
        if not g["fit_prior"]:
            rest = rest.replace("ln(n / sum(n) over ())", "-ln(count(*) over ())")
        for k in range(1, 6):
            one = (_HELD.format(held=k) + rest).replace("'training_set'", "'grid_search_set'").replace("select id, y as p from r2", "select r2.id, r2.y as p, te.y as y from r2 join te on te.id = r2.id")
            out.append(f"select {i} as combination, {k} as fold, avg((p = y)::int) as a from ({one}) having count(*) > 0")
    return "select combination, count(*) as folds, round(avg(a), 9) as accuracy from (" + " union all ".join(out) + ") group by 1"


@query("grid_search_nb", _grid_sql(ln.grid_rows("mnb")))
def grid_search_nb(spark, sf):
    """Every combination of a learner's grid on every fold of the grid-search set, by mean accuracy."""
    x, _, _, y = train_test(spark, sf, "grid_search_set")
    got = ln.mnb_grid(x, y, ln.grid_rows("mnb")).join(y, ["fold", "id"])
    per = got.groupBy("combination", "fold").agg(F.avg((F.col("p") == F.col("y")).cast("double")).alias("a"))
    return per.groupBy("combination").agg(F.count("*").alias("folds"), F.round(F.avg("a"), 9).alias("accuracy"))


@query("bnb_cv", _every_fold(_BNB))
def bnb_cv(spark, sf):
    """V7 V9: Bernoulli naive Bayes with every fold held out."""
    return _held_out(spark, sf, lambda x, train, test: ln.bnb_predict(x.join(test.select("id"), "id", "left_semi"), test, *ln.nb_counts(x, train)))


@query("feature_weights_cv")
def feature_weights_cv(spark, sf):
    """The 100 largest weights with every fold held out."""

    def run(x, train, _):
        w, _ = ln.mnb_weights(*ln.nb_counts(x, train))
        return sp.top_weights(w, 100).select("feature", "y", F.round("weight", 6).alias("weight"))

    return _held_out(spark, sf, run)


@query("param_grid_rows", "select * from (values ('mbkm', 6), ('bnb', 6), ('mnb', 6), ('perc', 96), ('pagr', 20), ('pagc', 20), ('sgdc', 384)) as t(learner, combinations)")
def param_grid_rows(spark, sf):
    """V10."""
    return ln.grid_table(spark).groupBy("learner").agg(F.count("*").cast("int").alias("combinations"))


DIM = 4096


def points(spark, sf) -> DataFrame:
    """(fold, id, y, slots, vals): the training folds' reviews, features hashed."""
    x, _, _, y = train_test(spark, sf)
    h = vz.hashed(x.join(y.select("id"), "id", "left_semi"), DIM)
    cells = F.array_sort(F.collect_list(F.struct("slot", "value")))
    v = h.groupBy("id").agg(cells.alias("c"))
    return y.join(v, "id").select("fold", "id", "y", F.transform("c", lambda z: z["slot"]).alias("slots"), F.transform("c", lambda z: z["value"]).alias("vals"))


def _cv(learner: str, params: dict):
    def run(spark, sf):
        return r9(ln.cross_validated(points(spark, sf), learner, params, DIM), ("learner", "fold", "id"))

    run.__doc__ = f"V7 V9: leave-one-fold-out training of {ln.LEARNERS[learner]}."
    return run


query("perceptron_cv")(_cv("perc", {"n_iter": 5, "eta0": 1}))
query("pa_cv")(_cv("pagc", {"C": 1.0, "n_iter": 5, "loss": "hinge"}))
query("pa_regression_cv")(_cv("pagr", {"C": 0.1, "n_iter": 5}))
query("sgd_cv")(_cv("sgdc", {"loss": "hinge", "penalty": "l2", "alpha": 1e-4, "n_iter": 5, "average": True}))
query("kmeans_cv")(_cv("mbkm", {"n_clusters": 3, "init": "k-means++"}))


@query("grid_search")
def grid_search(spark, sf):
    """Scores of every combination of the learner's default grid over the folds."""

    def accuracy(p):
        return p.groupBy("fold").agg(F.avg((F.rint("p") == F.rint("y")).cast("double")).alias("score"))

    _, scored = ln.grid_search(points(spark, sf), "perc", ln.grid_rows("perc"), DIM, accuracy)
    return r9(scored, ("combination",))
