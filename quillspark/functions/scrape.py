"""Parsing of scraped strings (T5-T11, L8, P13). All are null-safe; what cannot be parsed is null."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import number

NO_RATINGS = "No ratings yet"


def helpful_funny(text: Column) -> Column:
    """T5: struct of counts from "a of b people (c%) found this review helpful d people found this review
    funny": 15 words hold both parts, 9 the helpful one, 6 the funny one; anything else is null."""
    w = F.split(F.trim(text), "\\s+")
    n = F.size(w)
    none = F.trim(text) == NO_RATINGS
    zero = F.lit(0).cast("bigint")
    has_helpful, has_funny = n.isin(9, 15), n.isin(6, 15)
    helpful = F.when(has_helpful, number(F.get(w, F.lit(0)))).when(has_funny | none, zero)
    voted = F.when(has_helpful, number(F.get(w, F.lit(2)))).when(has_funny | none, zero)
    funny = F.when(n == 15, number(F.get(w, F.lit(9)))).when(n == 6, number(F.get(w, F.lit(0)))).when(has_helpful | none, zero)
    ok = none | n.isin(6, 9, 15)
    return F.when(
        ok,
        F.struct(
            helpful.alias("num_found_helpful"),
            voted.alias("num_voted_helpfulness"),
            (voted - helpful).alias("num_found_unhelpful"),
            F.when(has_helpful, F.try_divide(helpful.cast("double"), voted)).alias("found_helpful_percentage"),
            funny.alias("num_found_funny"),
        ),
    )


def posted_dates(text: Column, default_year: int = 2015) -> Column:
    """Struct (date_posted, date_updated) from "Posted: <date> @ <time> Updated: <date> @ <time>"."""
    parts = F.split(F.substring(F.trim(text), 9, 1000), " Updated: ")

    def one(p):
        halves = F.split(F.trim(p), "@")
        day = F.trim(F.get(halves, F.lit(0)))
        day = F.when(day.rlike(", \\d{4}$"), day).otherwise(F.concat(day, F.lit(f", {default_year}")))
        return F.when(F.size(halves) == 2, F.concat_ws(", ", day, F.upper(F.trim(F.get(halves, F.lit(1))))))

    return F.struct(one(F.get(parts, F.lit(0))).alias("date_posted"), one(F.get(parts, F.lit(1))).alias("date_updated"))


def timestamp_of(date: Column) -> Column:
    """The timestamp of a date string such as Jan 13, 2015, 3:50PM; null if malformed."""
    return F.try_to_timestamp(date, F.lit("MMM d, yyyy, h:mma"))


def hours(text: Column) -> Column:
    """Struct (last_two_weeks, total) from "x hrs last two weeks / y hrs on record"."""
    get = lambda p: number(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), "double")
    return F.struct(
        get("([\\d,.]+) hrs last two weeks").alias("last_two_weeks"), get("([\\d,.]+) hrs on record").alias("total")
    )


def url_parts(url: Column) -> Column:
    """Struct (profile, user): the first five segments, and segment 4."""
    p = F.split(url, "/")
    return F.struct(F.array_join(F.slice(p, 1, 5), "/").alias("profile"), F.get(p, F.lit(4)).alias("user"))


def comment_count(html: Column) -> Column:
    """The number at the end of the comment thread element, 0 if there is none."""
    inner = F.regexp_extract(html, '(<span id="commentthread[^<]+)', 1)
    return F.coalesce(F.regexp_extract(inner, ">(\\d*)$", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def pairs_map(parts: Column) -> Column:
    """Map of alternating values and names: ["12", "Games", "3", "Reviews"] -> {Games: 12, ...}."""
    n = F.floor(F.size(parts) / 2).cast("int")
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.map_from_arrays(
        F.transform(idx, lambda i: F.get(parts, i * 2 + 1)), F.transform(idx, lambda i: F.get(parts, i * 2))
    )


def map_number(m: Column, name: str) -> Column:
    """A number of the map, 0 by default."""
    return F.coalesce(number(F.try_element_at(m, F.lit(name))), F.lit(0).cast("bigint"))


class _Strings(HTMLParser):
    def __init__(self, tag: str, css: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.css, self.depth, self.out = tag, css, 0, []

    def handle_starttag(self, tag, attrs):
        if self.depth:
            self.depth += tag == self.tag
        elif tag == self.tag and (self.css is None or self.css in (dict(attrs).get("class") or "").split()):
            self.depth = 1

    def handle_endtag(self, tag):
        if self.depth and tag == self.tag:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and data.strip():
            self.out.append(data.strip())


def element_strings(html: Column, tag: str, css: str | None = None) -> Column:
    """Stripped strings inside the elements of a tag and class; general HTML, hence Arrow-batched Python."""

    @F.pandas_udf("array<string>")
    def parse(col: pd.Series) -> pd.Series:
        def one(h):
            if h is None:
                return None
            p = _Strings(tag, css)
            p.feed(h)
            p.close()
            return p.out

        return col.map(one)

    return parse(html)
