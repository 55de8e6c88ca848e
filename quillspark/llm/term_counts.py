"""Problem 4: how often every distinct term occurs and in how many records.

Heavy-light aggregation:

1. Ids only: the ids that stand in several rows are found by their hashes and put into a filter of fixed
   size (``BLOCKS`` x ``BITS`` bits, 8 MB), built block by block and sent to every task. It never misses a
   repeated id; the ids it takes for repeated by mistake only go the longer way.
2. A pass over all rows finds the terms that hold at least ``heavy_share`` of the records (at most
   ``256 / heavy_share`` names, however large the input).
3. The counting pass adds up heavy terms in exact local arrays, one row per task and term, and pre-adds the
   remaining terms, which are shuffled as counts. Only the entries of rows that may be repeats are shuffled
   by id, to count once; then both count tables are united.

Defined cases: a null map is no record; a null, zero or negative value means the record lacks the term,
and a name that no record has is no term and gets no row; repeated rows of one id count once (of differing
values of a term the largest), rows without id as one record; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import cut

RARE_BELOW = 3
COMMON_ABOVE = 0.25
HEAVY_SHARE = 1 / 500
SUMMARY_SIZE = 8192
BLOCKS = 64
BITS = 1 << 20
FLUSH = 500_000


def heavy_terms(entries: DataFrame, share: float = HEAVY_SHARE, size: int = SUMMARY_SIZE) -> list[str]:
    """Terms in at least ``share`` of the rows of ``entries(entries array<struct<key,value>>)``.

    Each task keeps a frequent-items summary of ``size`` counters over all its rows (counters are
    lowered by the same amount when there are too many, so a kept count is low by at most that amount);
    what reaches the driver is bounded by ``1 / share`` terms a record's worth of entries."""

    def run(batches):
        kept: Counter = Counter()
        n = 0
        for b in batches:
            col = b.column(0)
            n += len(col) - col.null_count
            counts = pc.value_counts(pc.struct_field(col.flatten(), 0))
            for k, v in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist()):
                kept[k] += v
            if len(kept) > 4 * size:
                low = sorted(kept.values(), reverse=True)[size]
                kept = Counter({k: v - low for k, v in kept.items() if v > low})
        least = max(1, int(n * share / 2))
        out = [(k, v) for k, v in kept.items() if v >= least]
        out.append((None, n))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in out], pa.string()), pa.array([v for _, v in out], pa.int64())], ["term", "n"]
        )

    sums = entries.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.col("term").isNotNull(), F.desc("n")).limit(1 + int(256 / share)).collect()
    n = sum(r["n"] for r in top if r["term"] is None)
    return sorted(r["term"] for r in top if r["term"] is not None and r["n"] >= n * share)


def _probes(h: np.ndarray) -> list[np.ndarray]:
    """Three bit places of hashes within their block."""
    h = h.view(np.uint64)
    return [((h >> np.uint64(shift)) & np.uint64(BITS - 1)).astype(np.int64) for shift in (6, 25, 44)]


def repeated_ids(hashes: DataFrame) -> dict[int, bytes]:
    """block -> compressed bits of the hashes that ``hashes(h)`` has more than once; at most ``BLOCKS`` of
    ``BITS`` bits. Hashes are shuffled, pre-counted, and of the repeated ones each block goes to one task."""
    several = hashes.groupBy("h").count().where("count > 1").select("h", F.col("h").bitwiseAND(BLOCKS - 1).cast("int").alias("block"))

    def run(batches):
        bits: dict[int, np.ndarray] = {}
        for b in batches:
            h, block = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(block):
                own = bits.setdefault(int(k), np.zeros(BITS, bool))
                for at in _probes(h[block == k]):
                    own[at] = True
        for k, own in bits.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(np.packbits(own).tobytes(), 1)])], ["block", "bits"])

    rows = several.repartition("block").mapInArrow(run, "block int, bits binary").limit(BLOCKS).collect()
    return {r["block"]: bytes(r["bits"]) for r in rows}


def _maybe(h: np.ndarray, bits: dict[int, np.ndarray]) -> np.ndarray:
    """Whether the filter has each hash."""
    out = np.zeros(len(h), bool)
    block = h & (BLOCKS - 1)
    probes = _probes(h)
    for k, own in bits.items():
        mine = np.flatnonzero(block == k)
        ok = np.ones(len(mine), bool)
        for at in probes:
            ok &= own[at[mine] >> 3] & (0x80 >> (at[mine] & 7)) != 0
        out[mine] = ok
    return out


def term_counts(df: DataFrame, id_col: str, map_col: str, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(term, total, records) of every term that a record has, and one row with term null whose ``records``
    is the number of records with a non-null map."""
    spark = df.sparkSession
    repeats = spark.sparkContext.broadcast(repeated_ids(df.select(F.xxhash64(id_col).alias("h"))))
    rows = df.where(F.col(map_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"), F.map_entries(map_col).alias("entries"))
    heavy = heavy_terms(rows.select("entries"), heavy_share)
    kind = rows.schema["id"].dataType

    def run(batches):
        bits = {k: np.frombuffer(zlib.decompress(x), np.uint8) for k, x in repeats.value.items()}
        names = pa.array(heavy, pa.string())
        total, records = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        light: list[pa.Table] = []
        n = 0

        def out(term, total, records, ids=None):
            own = pa.array(np.full(len(term), ids is not None))
            ids = pa.nulls(len(term), id_type) if ids is None else ids
            return pa.RecordBatch.from_arrays([own, ids, pa.array(term, pa.string()), pa.array(total, pa.int64()), pa.array(records, pa.int64())], ["own", "id", "term", "total", "records"])

        def merged():
            t = pa.concat_tables(light).group_by("term").aggregate([("total", "sum"), ("records", "sum")])
            return t.rename_columns(["term", "total", "records"])

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            entries = b.column(2)
            size = pc.list_value_length(entries).to_numpy()
            flat = entries.flatten()
            term = pc.struct_field(flat, 0)
            value = pc.fill_null(pc.struct_field(flat, 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            maybe = _maybe(b.column(1).to_numpy(), bits)
            n += int((~maybe).sum())
            there = value > 0
            again = np.repeat(maybe, size)
            at = pc.fill_null(pc.index_in(term, names), -1).to_numpy(zero_copy_only=False)
            few = there & ~again
            is_heavy = few & (at >= 0)
            total += np.bincount(at[is_heavy], weights=value[is_heavy], minlength=len(heavy)).astype(np.int64)
            records += np.bincount(at[is_heavy], minlength=len(heavy))
            rest = few & (at < 0)
            t = pa.table({"term": term.filter(pa.array(rest)), "total": value[rest], "records": np.ones(int(rest.sum()), np.int64)})
            light.append(t.group_by("term").aggregate([("total", "sum"), ("records", "sum")]).rename_columns(["term", "total", "records"]))
            if sum(x.num_rows for x in light) > 2 * FLUSH:
                light = [merged()]
                if light[0].num_rows > FLUSH:
                    done = light.pop().combine_chunks()
                    for x in done.to_batches():
                        yield out(x.column(0), x.column(1), x.column(2))
            if maybe.any():
                row = np.repeat(np.arange(b.num_rows), size)[there & again]
                ids = b.column(0).take(pa.array(np.concatenate([row, np.flatnonzero(maybe)])))
                some = int(maybe.sum())
                terms = pa.concat_arrays([term.filter(pa.array(there & again)).cast(pa.string()), pa.nulls(some, pa.string())])
                v = value[there & again]
                yield out(terms, np.concatenate([v, np.zeros(some, np.int64)]), np.ones(len(v) + some, np.int64), ids)
        if id_type is None:
            return
        if light:
            for x in merged().combine_chunks().to_batches():
                yield out(x.column(0), x.column(1), x.column(2))
        yield out([*heavy, None], [*total, 0], [*records, n])

    schema = T.StructType(
        [T.StructField("own", T.BooleanType()), T.StructField("id", kind), T.StructField("term", T.StringType()), T.StructField("total", T.LongType()), T.StructField("records", T.LongType())]
    )
    once = (
        rows.mapInArrow(run, schema)
        .groupBy("own", "id", "term")
        .agg(F.sum("total").alias("total"), F.max("total").alias("most"), F.sum("records").alias("records"))
        .select("term", F.when(F.col("own"), F.col("most")).otherwise(F.col("total")).alias("total"), F.when(F.col("own"), 1).otherwise(F.col("records")).alias("records"))
    )
    return once.groupBy("term").agg(F.sum("total").alias("total"), F.sum("records").alias("records")).where("term is null or records > 0")


def marked_terms(
    df: DataFrame, id_col: str, map_col: str, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE
) -> DataFrame:
    """(feature, total, records, mark): ``rare`` below ``rare_below`` records, ``common`` above the share
    ``common_above`` of all records with a map, else null. Rare wins if both hold."""
    counts = cut(term_counts(df, id_col, map_col))
    n = counts.where(F.col("term").isNull()).agg(F.max("records")).first()[0] or 0
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * n, "common")
    return counts.where(F.col("term").isNotNull()).select(
        F.col("term").alias("feature"), "total", "records", mark.alias("mark")
    )
