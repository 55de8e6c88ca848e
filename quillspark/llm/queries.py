"""Queries pN_... over the project's tables, with production parameters over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut, shared_dir, spread, table
from . import (
    abuse,
    languages,
    leaks,
    linked_splits,
    mojibake,
    near_duplicates,
    near_pairs,
    quantiles,
    split_overlap,
    term_counts,
    tokenizer,
)


def _shingled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that count in p1 and p6: (id, appid, part, s); garbled and short ones are left out."""
    rows = table(spark, sf_dir, "review").select(
        F.col("id_string").alias("id"), "appid", linked_splits.partition_name(F.col("partition")).alias("part"), F.col("review").alias("text")
    )
    rows = spread(rows.where("text is not null"))
    shingles = near_pairs.shingle_set(F.col("text"), split_overlap.SHINGLE, split_overlap.MIN_WORDS)
    words = mojibake.vocabulary(rows, "text")
    return mojibake.without_garbled(rows.withColumn("s", shingles), "text", words, "s", mojibake.rare_forms(rows, "text", words))


def _p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("part") == "training", near_pairs.TRAIN).otherwise(near_pairs.EVAL).cast("byte")
    return split_overlap.overlaps(_shingled(spark, sf_dir).where("part is not null").select("id", side.alias("side"), "s"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p1(spark, sf_dir).select(F.col("id").alias("id_string"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping evaluation reviews and all evaluation reviews, per partition and game."""
    reviews = (
        table(spark, sf_dir, "review")
        .select("id_string", linked_splits.partition_name(F.col("partition")).alias("partition"), "game")
        .where(F.col("partition").isin("test", "extra"))
        .distinct()
    )
    found = _p1(spark, sf_dir).select(F.col("id").alias("id_string"), "containment")
    return (
        reviews.join(found, "id_string", "left")
        .groupBy("partition", "game")
        .agg(F.count("containment").alias("n_overlap"), F.count("*").alias("n_reviews"), F.round(F.avg("containment"), 6).alias("avg_containment"))
    )


def _p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _shingled(spark, sf_dir)
        .where("appid is not null")
        .select("id", F.xxhash64("appid").alias("grp"), F.lit(3).cast("byte").alias("side"), "s")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.duplicate_pairs(_p6(spark, sf_dir))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per review that has a near-copy: its group and its number of links."""
    return near_duplicates.duplicate_groups(_p6(spark, sf_dir)).withColumnRenamed("id", "id_string")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.find(table(spark, sf_dir, "review").select("id_string", "review"), "review").select("id_string").distinct()


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mojibake.find(table(spark, sf_dir, "review").select("id_string", "review"), "review")
    return found.drop("review").dropDuplicates(["id_string"])


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "review").select(
        F.col("id_string").alias("id"),
        linked_splits.account(F.col("profile_url")).alias("node"),
        linked_splits.partition_name(F.col("partition")).alias("part"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    comps = linked_splits.components(linked_splits.alias_edges(table(spark, sf_dir, "profile_alias")))
    return linked_splits.in_several_partitions(_accounts(spark, sf_dir), comps).withColumnRenamed("id", "id_string")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, node, at) of every review: its author, else itself, and when it was first stored."""
    node = F.coalesce(linked_splits.account(F.col("profile_url")), F.concat(F.lit("r:"), F.col("id_string")))
    rows = table(spark, sf_dir, "review").select(F.col("id_string").alias("id"), node.alias("node"), "inserted_at")
    return rows.groupBy("id").agg(F.min("node").alias("node"), F.min("inserted_at").alias("at"))


def _per_node(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("node").agg(F.count("*").alias("n"))


def _new_state(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}/splits-{uuid.uuid4().hex}"


def p3_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every review with its split, all in one batch on an empty state."""
    reviews, path = _entities(spark, sf_dir), _new_state(spark)
    linked_splits.advance(_per_node(reviews), linked_splits.alias_edges(table(spark, sf_dir, "profile_alias")), path)
    return reviews.join(linked_splits.load(spark, path).select("node", "split"), "node").select(F.col("id").alias("id_string"), "split")


def p3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews and links in two batches on one persisted state, and what has to hold of it: (batch, n_reviews,
    n_entities, in_several_splits, moved, unmarked, near_shares). The links of half of the accounts are known only
    with the second batch, so that it joins entities that have different splits already."""
    reviews, path = cut(_entities(spark, sf_dir)), _new_state(spark)
    edges = linked_splits.alias_edges(table(spark, sf_dir, "profile_alias"))
    first, early = F.month("at") % 2 == 0, F.ascii(F.substring("a", -1, 1)) % 2 == 0
    linked_splits.advance(_per_node(reviews.where(first)), edges.where(early), path)
    linked_splits.advance(_per_node(reviews.where(~first)), edges.where(~early), path)
    one, two = cut(linked_splits.load(spark, path, 2)), cut(linked_splits.load(spark, path))
    known = one.select("node", F.col("split").alias("was"))
    out = None
    for batch, state, of in ((1, one, reviews.where(first)), (2, two, reviews)):
        rows = of.join(state, "node").join(known, "node", "left")
        conflicts = state.join(known, "node").groupBy("component").agg(F.count_distinct("was").alias("k"), F.max(F.col("split") == linked_splits.QUARANTINE).alias("q"))
        bad = conflicts.agg(F.coalesce(F.sum((F.col("q") != (F.col("k") > 1)).cast("long")), F.lit(0)).alias("unmarked"))
        several = state.groupBy("component").agg(F.count_distinct("split").alias("k")).agg(F.coalesce(F.sum((F.col("k") > 1).cast("long")), F.lit(0)).alias("in_several_splits"))
        counts = rows.agg(
            F.count("*").alias("n_reviews"),
            F.count_distinct("component").alias("n_entities"),
            F.coalesce(F.sum((F.col("was").isNotNull() & (F.col("was") != F.col("split")) & (F.col("status") == "ok")).cast("long")), F.lit(0)).alias("moved"),
            *[F.avg((F.col("split") == s).cast("double")).alias(s) for s in linked_splits.PROPORTIONS],
        )
        slack = F.greatest(F.lit(0.02), 2 / F.sqrt("n_reviews"))
        near = F.lit(True)
        for s, share in linked_splits.PROPORTIONS.items():
            near = near & (F.abs(F.col(s) - share) <= slack)
        part = counts.select(
            F.lit(batch).alias("batch"), "n_reviews", "n_entities", several.scalar().alias("in_several_splits"), "moved", bad.scalar().alias("unmarked"), near.alias("near_shares")
        )
        out = part if out is None else out.union(part)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = term_counts.marked_terms(table(spark, sf_dir, "review"), "id_string", "nlp_features")
    return marked.where(F.col("mark").isNotNull()).select("feature", "mark")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.marked_terms(table(spark, sf_dir, "review"), "id_string", "nlp_features")


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per appid and day, and joined from these days per appid (day null)."""
    rows = quantiles.first_rows(table(spark, sf_dir, "review"), "id_string", "inserted_at", "total_game_hours", "appid")
    days = cut(quantiles.day_sketches(rows))
    joined = quantiles.merge_sketches(days).select("grp", F.lit(None).cast("date").alias("day"), "n", "sketch")
    return quantiles.answer(days.select("grp", "day", "n", "sketch").unionByName(joined)).withColumnRenamed("grp", "appid")


#: A sketch so small that most groups of the test tables exceed it.
SMALL_K = 64


def p5_small_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound held against exact ranks, with sketches far smaller than the groups: (n_groups, n_sketched,
    n_values, bound_holds), the last if at most 3 % of the answers of groups beyond ``SMALL_K`` exceed it."""
    rows = cut(quantiles.first_rows(table(spark, sf_dir, "review"), "id_string", "inserted_at", "total_game_hours", "appid"))
    joined = quantiles.merge_sketches(quantiles.day_sketches(rows, SMALL_K), SMALL_K)
    got = quantiles.outside_bound(rows, quantiles.answer(joined, k=SMALL_K))
    large = F.col("n") > SMALL_K
    share = F.sum(F.when(large, F.col("n_outside")).otherwise(0)) / F.greatest(F.sum(large.cast("int")), F.lit(1)) / len(quantiles.PERCENTS)
    return got.agg(F.count("*").alias("n_groups"), F.sum(large.cast("int")).alias("n_sketched"), F.sum("n").alias("n_values"), (share <= 0.03).alias("bound_holds"))


def _p7(spark: SparkSession, sf_dir: str):
    texts = spread(table(spark, sf_dir, "review").select(F.col("id_string").alias("id"), F.col("review").alias("text")).where("text is not null"))
    labels = (
        table(spark, sf_dir, "language_label")
        .select(F.col("id_string").alias("id"), languages.label_code(F.col("lang")).alias("lang"))
        .where("lang is not null")
    )
    vocabulary = mojibake.vocabulary(texts, "text")
    model = languages.fit_on(texts, labels, vocabulary)
    return languages.languages(texts, model, vocabulary), labels


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, labels = _p7(spark, sf_dir)
    return languages.cases(found, labels).select(F.col("id").alias("id_string"), "lang")


def p7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per review and language of it, with confidence and number of segments of six words or more
    (0: shorter ones only, or the text as a whole; ``und`` where it has no letters, or is null)."""
    found, _ = _p7(spark, sf_dir)
    langs = F.when(F.size("langs") > 0, F.col("langs")).otherwise(F.array("whole"))
    rows = found.dropDuplicates(["id"]).select(F.col("id").alias("id_string"), F.explode(F.concat(langs, "short")).alias("x")).select("id_string", "x.*")
    none = table(spark, sf_dir, "review").where("review is null").select("id_string").distinct()
    return rows.union(none.select("id_string", F.lit(languages.UND), F.lit(0.0), F.lit(0)))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.token_ids(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, same): whether the decoded ids are the text, byte for byte."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = tokenizer.decoded(tokenizer.token_ids(docs))
    return docs.join(back, "doc_id").select("doc_id", F.size("ids").alias("n_ids"), (F.col("decoded") == F.col("text")).alias("same"))


def _p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_item").select("item_id", "text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p9(spark, sf_dir).where("exact").select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also passages with a few edits: (doc_id, item_id, score, exact)."""
    return _p9(spark, sf_dir)


def _p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scored(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "content_label"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p10(spark, sf_dir).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p10(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the number of documents and the share with abusive content."""
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "source")
        .join(_p10(spark, sf_dir), "doc_id")
        .groupBy("source")
        .agg(F.count("*").alias("n_docs"), F.sum((F.col("score") >= abuse.THRESHOLD).cast("long")).alias("n_abusive"))
        .withColumn("rate", F.round(F.col("n_abusive") / F.col("n_docs"), 6))
    )


_P4_SQL = """
with r as (select id_string, max(nlp_features) as m from review where nlp_features is not null group by 1),
e as (select unnest(map_entries(m)) as e from r),
c as (select e.key as feature, sum(case when e.value > 0 then e.value else 0 end)::bigint as total,
             count(*) filter (where e.value > 0) as records from e group by 1 having count(*) filter (where e.value > 0) > 0),
k as (select c.*, case when records < 3 then 'rare'
                       when records > 0.25 * (select count(*) from r) then 'common' end as mark from c)
"""

_P5_SQL = """
with o as (select id_string, appid, inserted_at, total_game_hours as v,
                  row_number() over (partition by id_string order by inserted_at, total_game_hours nulls first) as k from review),
d as (select appid, inserted_at::date as day, v from o where k = 1 and appid is not null and v is not null and not isnan(v) and v >= 0),
r as (select * from d union all select appid, null, v from d),
w as (select *, row_number() over (partition by appid, day order by v) as rn, count(*) over (partition by appid, day) as n from r)
select appid, day, n, {cols}, 0.0::double as rank_error from w group by appid, day, n
"""


_P5_SMALL_SQL = f"""
with o as (select id_string, appid, total_game_hours as v, row_number() over (partition by id_string order by inserted_at, total_game_hours nulls first) as k from review),
g as (select appid, count(*) as n from o where k = 1 and appid is not null and v is not null and not isnan(v) and v >= 0 group by 1)
select count(*) as n_groups, count(*) filter (where n > {SMALL_K}) as n_sketched, sum(n)::bigint as n_values, true as bound_holds from g
"""


def _p5_sql() -> str:
    return _P5_SQL.format(cols=", ".join(f"min(v) filter (where rn >= ceil(n * {p} / 100.0)) as p{p}" for p in quantiles.PERCENTS))


def queries():
    return {
        "p1_found": p1_found,
        "p1_report": p1_report,
        "p6_found": p6_found,
        "p6_groups": p6_groups,
        "p2_found": p2_found,
        "p2_restored": p2_restored,
        "p3_found": p3_found,
        "p3_split": p3_split,
        "p3_batches": p3_batches,
        "p4_found": p4_found,
        "p4_terms": p4_terms,
        "p5_percentiles": p5_percentiles,
        "p5_small_sketches": p5_small_sketches,
        "p7_found": p7_found,
        "p7_languages": p7_languages,
        "p8_ids": p8_ids,
        "p8_roundtrip": p8_roundtrip,
        "p9_found": p9_found,
        "p9_leaks": p9_leaks,
        "p10_found": p10_found,
        "p10_scores": p10_scores,
        "p10_rates": p10_rates,
    }


_P3_SQL = r"""
with u as (select id_string, lower(trim(partition)) as p, regexp_replace(trim(profile_url), '^[A-Za-z]+://[^/]*/+', '') as path from review),
a as (select id_string,
       case when p in ('training', 'train') then 'training' when p in ('test', 'extra') then p end as part,
       case lower(regexp_extract(path, '^([A-Za-z]+)/+', 1)) when 'profiles' then 'n:' when 'id' then 'i:' end as kind,
       lower(trim(url_decode(regexp_extract(path, '^[A-Za-z]+/+([^/?#\s]+)', 1)))) as name from u),
n as (select distinct id_string, part, kind || name as node from a where part is not null and kind is not null and name <> ''),
l as (select 'n:' || lower(trim(account_number)) as x, 'i:' || lower(trim(account_name)) as y from profile_alias),
c as (select id_string, part, coalesce(l.x, n.node) as author from n left join l on n.node = l.y)
select distinct id_string from c where author in (select author from c group by 1 having count(distinct part) >= 2)
"""


#: The whole state by plain means, and what has to hold.
_P3_BATCHES_SQL = r"""
with u as (select id_string, inserted_at, regexp_replace(trim(profile_url), '^[A-Za-z]+://[^/]*/+', '') as path from review),
k as (select id_string, inserted_at, case lower(regexp_extract(path, '^([A-Za-z]+)/+', 1)) when 'profiles' then 'n:' when 'id' then 'i:' end as kind,
             lower(trim(url_decode(regexp_extract(path, '^[A-Za-z]+/+([^/?#\s]+)', 1)))) as name from u),
e as (select id_string, min(case when kind is not null and name <> '' then kind || name else 'r:' || id_string end) as node, min(inserted_at) as t from k group by 1),
l as (select 'n:' || lower(trim(account_number)) as x, 'i:' || lower(trim(account_name)) as y from profile_alias),
a as (select 1 as batch, coalesce(l.x, e.node) as entity from e left join l on e.node = l.y and ascii(right(l.x, 1)) % 2 = 0 where month(t) % 2 = 0
      union all select 2, coalesce(l.x, e.node) from e left join l on e.node = l.y)
select batch, count(*) as n_reviews, count(distinct entity) as n_entities, 0::bigint as in_several_splits, 0::bigint as moved, 0::bigint as unmarked, true as near_shares from a group by 1
"""


_P9_SQL = r"""
with d as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' as t
           from documents where text is not null),
w as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_item where text is not null),
p as (select item_id, ' ' || array_to_string(w[i + 1 : i + 15], ' ') || ' ' as p
      from (select item_id, w, unnest(range(0, len(w) - 14)) as i from w where len(w) >= 15)),
g as (select doc_id, w, unnest(range(0, len(w) - 14)) as i from
      (select doc_id, regexp_extract_all(t, '[\p{L}\p{N}]+') as w from d) where len(w) >= 15)
select distinct g.doc_id, p.item_id from g join p on ' ' || array_to_string(g.w[g.i + 1 : g.i + 15], ' ') || ' ' = p.p
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p9_found": _P9_SQL,
        "p3_found": _P3_SQL,
        "p3_batches": _P3_BATCHES_SQL,
        "p4_found": _P4_SQL + "select feature, mark from k where mark is not null",
        "p4_terms": _P4_SQL + "select feature, total, records, mark from k",
        "p5_percentiles": _p5_sql(),
        "p5_small_sketches": _P5_SMALL_SQL,
    }
