"""Near pairs against brute force: p1 and p6, with nulls, short texts, copies, hot groups."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import near_duplicates, near_pairs, split_overlap

W = re.compile(r"[^\W_]+")


def texts(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(15, 70))] for _ in range(n // 4)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 12)):
            i = rng.randrange(len(w))
            k = rng.random()
            if k < 0.4:
                w[i] = rng.choice(vocab)
            elif k < 0.7:
                w.insert(i, rng.choice(vocab))
            elif len(w) > 5:
                del w[i]
        out.append(" ".join(w))
    return out + [out[0]] * 5 + ["", None, "a b c"]


def jaccard(a, b):
    return len(a & b) / len(a | b)


def sets(rows):
    out = {}
    for i, t in rows:
        w = W.findall((t or "").lower())
        if len(w) >= 20:
            out[i] = frozenset(zip(w, w[1:], w[2:]))
    return out


def docs(spark, rows):
    df = spark.createDataFrame(rows, "id string, grp long, side int, t string")
    s = near_pairs.shingle_set(F.col("t"), 3, 20)
    return df.select("id", "grp", F.col("side").cast("byte").alias("side"), s.alias("s")).where("s is not null")


@pytest.mark.parametrize("seed, block", [(1, 4096), (2, 8)])
def test_pairs_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(near_pairs, "BLOCK", block)
    ts = texts(120, seed)
    rows = [(f"r{i:03d}", i % 2, 3, t) for i, t in enumerate(ts)]
    rows += rows[:5]  # repeated rows
    s = sets([(r[0], r[3]) for r in rows])
    grp = {r[0]: r[1] for r in rows}
    ids = sorted(s)
    want = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if grp[a] == grp[b] and jaccard(s[a], s[b]) >= 0.5}
    got = [tuple(r) for r in near_duplicates.duplicate_pairs(docs(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    links = {}
    for a, b in want:
        links[a] = links.get(a, 0) + 1
        links[b] = links.get(b, 0) + 1
    groups = near_duplicates.duplicate_groups(docs(spark, rows)).collect()
    assert {r["id"]: r["n_links"] for r in groups} == links
    of = {r["id"]: r["group_id"] for r in groups}
    assert all(of[a] == of[b] for a, b in want)


def test_overlaps_equal_brute_force(spark):
    ts = texts(120, 3)
    rows = [(f"r{i:03d}", 0, 1 if i % 3 == 0 else 2, t) for i, t in enumerate(ts)]
    s = sets([(r[0], r[3]) for r in rows])
    side = {r[0]: r[2] for r in rows}
    want = {}
    for a in s:
        best = [len(s[a] & s[b]) / len(s[a]) for b in s if side[b] == 2 and jaccard(s[a], s[b]) >= 0.5] if side[a] == 1 else []
        if best:
            want[a] = max(best)
    got = {r["id"]: r["containment"] for r in split_overlap.overlaps(docs(spark, rows)).collect()}
    assert set(got) == set(want) and want
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_empty(spark):
    e = docs(spark, [("a", 0, 3, None)])
    assert near_duplicates.duplicate_pairs(e).count() == 0 and split_overlap.overlaps(e).count() == 0


def test_comparison_keeps_every_pair_within_the_radius():
    rng = np.random.default_rng(0)
    hashes = [np.unique(rng.integers(-(2**31), 2**31, n)).astype(np.int32) for n in rng.integers(10, 700, 60)]
    hashes += [np.unique(np.concatenate([h[: int(len(h) * 0.9)], rng.integers(-(2**31), 2**31, 3).astype(np.int32)])) for h in hashes]
    hashes.sort(key=len)
    n = np.array([len(h) for h in hashes])
    data, size = near_pairs._parity(np.concatenate(hashes), np.repeat(np.arange(len(n)), n), n)
    start = np.cumsum(size) - size
    folded = near_pairs._folded(data, start, size * 8)
    group = np.zeros(len(n), np.int64)
    i, j = near_pairs.compare(group, n, np.zeros(len(n), int), np.full(len(n), 7, np.int8), size * 8, folded, 0.5)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    for a in range(len(n)):
        for b in range(a):
            x, y = set(hashes[a].tolist()), set(hashes[b].tolist())
            if len(x & y) / len(x | y) >= 0.5:
                assert (b, a) in got


def test_buckets_without_a_pair_are_not_compared():
    """One side only, one record only, no hash of a smaller set's prefix; a class with both sides is a pair's half."""
    new = np.array([1, 0, 1, 1, 0, 1, 0, 1, 0], bool)
    flags = np.array([1 | 2, 1 | 2, 1 | 6, 1 | 2, 4, 2, 4, 6, 1 | 2], np.int8)
    assert near_pairs.paired(new, flags).tolist() == [False, False, False, True, True, False, False, True, True]
