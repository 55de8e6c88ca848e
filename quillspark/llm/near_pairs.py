"""Pairs of records whose word-shingle sets have a Jaccard similarity of at least t: problems 1 and 6.

All pairs are found; nothing is sampled and no bucket is capped:

1. Records with the same set are one class; one representative of each goes on, so a text copied into a
   third of all rows costs one representative.
2. Shingle hashes are ordered rarest first by one table of the frequent shingles, counted over all rows
   and bounded in size by its least share. Two sets that are similar enough share a hash among the first
   few of either (prefix filter: the smaller set's first n - ceil(2t/(1+t) n) + 1, the larger's first
   n - ceil(t n) + 1), so only these are partitioned by hash.
3. In each bucket the records are compared bit-sliced: every set is a parity map of 256 to 2,048 bits by
   its size (the wider is folded to the narrower), whose Hamming distance never exceeds the sets'
   symmetric difference, so that a pair beyond the radius (1-t)/(1+t)(|a|+|b|) is surely none. Bit planes lie vertically, 64 records to a word; a shift by s
   sets every record against the s-th next of its bucket; carry-save adders update all distances at once;
   words whose pairs all exceed their radius are abandoned.
4. What is left is verified on the whole sets.

The bucket of a shingle in at least ``FREQUENT_SHARE`` of all sets is cut into blocks of ``BLOCK`` records and
each pair of blocks goes to a task of its own. A rarer shingle's bucket stays in one task, whose work is
quadratic in it; above ``BLOCK`` / ``FREQUENT_SHARE`` (8 million) sets it can be larger than a block. Sets hold
32-bit hashes: a wrong count takes a collision
between the two sets (chance about |a||b| / 2^32 for a pair).
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Widths of the parity maps, and the largest set of each but the last.
WIDTHS = (256, 512, 1024, 2048)
LARGEST = (64, 160, 400)
CHUNK = 64
BLOCK = 4096
LANES = 1 << 17
WORDS = 2048
FREQUENT_SHARE = 1 / 2000
BROADCAST_IDS = 500_000
EVAL, TRAIN = 1, 2


def words(text: Column) -> Column:
    """Lower-cased maximal runs of Unicode letters and digits; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def shingle_set(text: Column, k: int, min_words: int) -> Column:
    """Sorted distinct 32-bit hashes of ``k`` consecutive words; null below ``min_words`` words. The word
    array is bound to a lambda variable, else it would be computed again for every shingle."""

    def of(w):
        at = lambda i: F.hash(*[F.get(w, i + j) for j in range(k)])
        return F.when(
            F.size(w) >= max(k, min_words),
            F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - k), at))),
        )

    return F.get(F.transform(F.array(words(text)), of), F.lit(0))


def representatives(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``docs(id, grp, side, s)``: classes (rid, grp, side, n, s) of equal sets within a group, and
    members (id, grp, side, h1, h2). The sets are computed and written once; the members' columns are read
    from there without them."""
    keyed = cut(docs.select("id", "grp", "side", F.xxhash64("s").alias("h1"), F.hash("s").alias("h2"), "s"))
    reps = (
        keyed.groupBy("grp", "h1", "h2")
        .agg(F.bit_or("side").alias("side"), F.count("*").alias("m"), F.first("s").alias("s"))
        .select(F.monotonically_increasing_id().alias("rid"), "grp", "h1", "h2", "side", "m", F.size("s").alias("n"), "s")
    )
    return cut(reps), keyed.select("id", "grp", "side", "h1", "h2")


def frequent(reps: DataFrame, share: float = FREQUENT_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of the shingles in about ``share`` of all sets or more.

    Every task counts all its sets exactly and reports what half the share of them hold; the sum can be
    low by that half. The counts only order the hashes and size the blocks, they decide no pair."""

    def run(batches):
        keys, counts, n, todo = np.zeros(0, np.int32), np.zeros(0, np.int64), 0, []
        def merge():
            nonlocal keys, counts, todo
            v, c = np.unique(np.concatenate(todo), return_counts=True) if todo else (keys[:0], counts[:0])
            k = np.concatenate([keys, v])
            keys, at = np.unique(k, return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, c]), minlength=len(keys)).astype(np.int64)
            todo = []

        for b in batches:
            n += b.num_rows
            todo.append(b.column(0).flatten().to_numpy(zero_copy_only=False))
            if sum(map(len, todo)) > 2_000_000:
                merge()
        merge()
        keep = counts >= max(2, n * share / 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(keys[keep], 0), pa.int32()), pa.array(np.append(counts[keep], n)), pa.array([*[False] * int(keep.sum()), True])],
            ["k", "n", "rows"],
        )

    sums = reps.select("s").mapInArrow(run, "k int, n long, rows boolean").groupBy("rows", "k").agg(F.sum("n").alias("n"))
    got = sums.orderBy(F.desc("rows"), F.desc("n")).limit(1 + int(1000 / share)).toPandas()
    rows = int(got.n[got.rows].sum())
    got = got[~got.rows & (got.n >= rows * share)].sort_values("k")
    return got.k.to_numpy(np.int32), got.n.to_numpy(np.int64)


def _parity(flat: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all parity maps, one after the other, and their lengths): a bit is the parity of the
    hashes that fall on it; a hash's place in half the width is its place modulo that width."""
    width = np.array(WIDTHS)[np.searchsorted(LARGEST, n)]
    start = np.cumsum(width) - width
    slot = ((flat.astype(np.int64) & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> 16
    parity = np.bincount(start[doc] + slot % width[doc], minlength=int(width.sum())).astype(np.uint8) & 1
    return np.packbits(parity, bitorder="little"), width // 8


def postings(reps: DataFrame, t: float, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, n, pos, rid, flags, bits) for the prefix hashes of every set, several rows where a bucket is cut
    into blocks. flags: 1 if among the smaller set's prefix, 2 and 4 the sides, 8 and 16 first or second
    block of a pair of blocks."""
    bound = reps.sparkSession.sparkContext.broadcast(often)
    large, small = Fraction(str(t)), 2 * Fraction(str(t)) / (1 + Fraction(str(t)))

    def run(batches):
        keys, counts = bound.value
        for b in batches:
            for part in range(0, b.num_rows, 2000):
                yield _postings(b.slice(part, 2000), keys, counts)

    def _postings(b, keys, counts):
        s = b.column(b.schema.get_field_index("s"))
        n = np.asarray(pc.list_value_length(s)).astype(np.int64)
        flat = s.flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(n)), n)
        maps, size = _parity(flat, doc, n)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
            df = np.where(keys[at] == flat, counts[at], 0)
        else:
            df = np.zeros(len(flat), np.int64)
        order = np.lexsort((flat, df, doc))
        flat, df, doc = flat[order], df[order], doc[order]
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        probe = n - np.ceil(n * float(large) - 1e-9).astype(np.int64) + 1
        index = n - np.ceil(n * float(small) - 1e-9).astype(np.int64) + 1
        keep = place < probe[doc]
        flat, df, doc, place = flat[keep], df[keep], doc[keep], place[keep]
        rid = b.column(b.schema.get_field_index("rid")).to_numpy()
        flags = (place < index[doc]).astype(np.int8) | (b.column(b.schema.get_field_index("side")).to_numpy()[doc].astype(np.int8) << 1)
        key = (b.column(b.schema.get_field_index("grp")).to_numpy()[doc] * np.int64(0x1E3779B97F4A7C15) + flat) * np.int64(0x5851F42D4C957F2D)
        blocks = np.maximum(1, -(-df // BLOCK))
        mine = (rid[doc] * np.int64(0x2545F4914F6CDD1D) >> np.int64(20)) % blocks
        src = np.repeat(np.arange(len(key)), blocks)
        other = np.arange(len(src)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        me = mine[src]
        lo, hi = np.minimum(me, other), np.maximum(me, other)
        cutup = blocks[src] > 1
        key = np.where(cutup, (key[src] ^ (lo * 0x100000 + hi + 1)) * np.int64(0x369DEA0F31A53F85), key[src])
        flags = flags[src] | np.where(cutup & (lo != hi), np.where(me == lo, 8, 16), 0).astype(np.int8)
        d = doc[src]
        start = np.cumsum(size) - size
        length = size[d]
        offsets = np.concatenate([[0], np.cumsum(length)])
        data = maps[np.arange(offsets[-1]) + np.repeat(start[d] - offsets[:-1], length)]
        bits = pa.Array.from_buffers(pa.binary(), len(d), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(n[d].astype(np.int32)), pa.array(place[src].astype(np.int32)), pa.array(rid[d]), pa.array(flags), bits],
            ["key", "n", "pos", "rid", "flags", "bits"],
        )

    return reps.select("rid", "grp", "side", "s").mapInArrow(run, "key long, n int, pos int, rid long, flags byte, bits binary")


def _add(planes: list[np.ndarray]) -> list[np.ndarray]:
    """Carry-save addition: planes[w] holds (m, K) words of weight 2^w; the result has one row a weight."""
    w = 0
    while w < len(planes):
        x = planes[w]
        while len(x) > 1:
            if len(x) == 2:
                s, c, rest = x[:1] ^ x[1:], x[:1] & x[1:], x[:0]
            else:
                m = len(x) // 3
                a, b, d = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
                ab = a ^ b
                s, c, rest = ab ^ d, (a & b) | (d & ab), x[3 * m :]
            if w + 1 == len(planes):
                planes.append(c)
            else:
                planes[w + 1] = np.concatenate([planes[w + 1], c])
            x = np.concatenate([s, rest])
        planes[w] = x
        w += 1
    return planes


def _exceeds(count: list[np.ndarray], limit: list[np.ndarray], k: int) -> np.ndarray:
    """Bitwise count > limit, from the least significant plane up."""
    out = np.zeros(k, np.uint64)
    for w in range(max(len(count), len(limit))):
        a = count[w][0] if w < len(count) and len(count[w]) else np.uint64(0)
        b = limit[w] if w < len(limit) else np.uint64(0)
        out = (a & ~b) | (out & ~(a ^ b))
    return out


def _pack(mask: np.ndarray) -> np.ndarray:
    full = np.zeros(-(-len(mask) // 64) * 64, bool)
    full[: len(mask)] = mask
    return np.packbits(full, bitorder="little").view(np.uint64)


def compare(group, n, pos, flags, width, bits: list[np.ndarray], t: float) -> tuple[np.ndarray, np.ndarray]:
    """Lane numbers (i, j) of the pairs that may reach ``t``; lanes of a group stand together, n ascending.
    ``bits[k]`` has the lanes' maps folded to WIDTHS[k] (only of lanes at least as wide)."""
    found = []
    for k, w in enumerate(WIDTHS):
        if (width == w).any():
            lanes = np.flatnonzero(width >= w)
            i, j = _compare(group[lanes], n[lanes], pos[lanes], flags[lanes], width[lanes] == w, bits[k], t)
            found.append((lanes[i], lanes[j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _compare(group, n, pos, flags, first, bits, t) -> tuple[np.ndarray, np.ndarray]:
    """The comparison at one width, of pairs whose smaller set is in ``first``."""
    sizes = np.bincount(group)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    # largest groups first: a shift needs only a head; within a size by n: words with like radii
    rank = np.empty(len(sizes), np.int64)
    there = group[starts]
    rank[there[np.lexsort((n[starts], -sizes[there]))]] = np.arange(len(there))
    order = np.argsort(rank[group], kind="stable")
    group, n, flags, first, bits = group[order], n[order].astype(np.int32), flags[order], first[order], bits[order]
    pos = pos[order].astype(np.int32)
    lanes, size, width = len(group), sizes[group], bits.shape[1] * 8
    grid = np.zeros((-(-lanes // 64) * 64, width // 8), np.uint8)
    grid[:lanes] = bits
    byte = np.ascontiguousarray(grid.T)
    planes = np.zeros((width, len(grid) // 64 + 2), np.uint64)
    for b in range(8):  # plane 8 k + b has bit b of byte k of all lanes
        planes[b::8, :-2] = np.packbits(byte & np.uint8(1 << b), axis=1, bitorder="little").view(np.uint64)
    ratio, share = (1 - t) / (1 + t), t / (1 + t)
    index = (flags & 1 == 1) & first
    sides, blocks = (flags >> 1 & 3).astype(np.uint8), (flags >> 3 & 3).astype(np.uint8)
    across = sides >> 1 | (sides & 1) << 1
    cutup = bool(blocks.any())
    rest = n - pos
    ends = np.flatnonzero(np.diff(group, append=-1)) + 1
    left = (np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(lanes)).astype(np.int32)  # lanes of the group from here on
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo: list[tuple] = []
    waiting = 0
    head_of = np.searchsorted(-size, -np.arange(int(size[0]) + 1 if lanes else 1), side="left")
    for s in range(1, int(size[0]) if lanes else 0):
        e = min(int(head_of[s]), lanes - s)  # lanes of groups larger than s
        ok = left[:e] > s
        ok &= index[:e]
        ok &= (sides[:e] & across[s : s + e]) != 0
        if cutup:
            either = blocks[:e] | blocks[s : s + e]
            ok &= (either == 0) | (either == 3)
        i = np.flatnonzero(ok)
        na, nb = n[i], n[i + s]
        total = na + nb
        least = total * share - 1e-9  # of common hashes; the first stands early in both
        good = (rest[i] >= least) & (rest[i + s] >= least) & (na >= t * nb)
        i, total = i[good], total[good]
        if not len(i):
            continue
        at, begin = np.unique(i >> 6, return_index=True)
        mask = np.zeros((len(at), 64), bool)
        mask[np.repeat(np.arange(len(at)), np.diff(begin, append=len(i))), i & 63] = True
        radius = (np.maximum.reduceat(total, begin) * ratio + 1e-9).astype(np.int64)
        todo.append((at, np.full(len(at), s), np.packbits(mask, axis=1, bitorder="little").view(np.uint64)[:, 0], radius))
        waiting += len(at)
        if waiting >= WORDS:
            found.append(_abandoned(planes, *map(np.concatenate, zip(*todo))))
            todo, waiting = [], 0
    if todo:
        found.append(_abandoned(planes, *map(np.concatenate, zip(*todo))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, shift = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    j = i + shift
    # words were kept by their largest radius; the few pairs left are held to their own
    near = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= (n[i] + n[j]) * ratio + 1e-9
    return order[i[near]], order[j[near]]


def _abandoned(planes, at, shift, alive, radius) -> tuple[np.ndarray, np.ndarray]:
    """(lane, shift) of the pairs whose distance stays within their word's radius. ``at`` are words,
    ``alive`` their pairs; all distances are updated plane by plane with carry-save adders."""
    q, r = shift // 64, (shift % 64).astype(np.uint64)
    up = np.uint64(63) - r
    y0, y1 = at + q, at + q + 1
    last = planes.shape[1] - 1
    y0, y1 = np.minimum(y0, last), np.minimum(y1, last)
    limit = [(-(radius >> w & 1)).astype(np.uint64) for w in range(int(radius.max()).bit_length())]
    count: list[np.ndarray] = []
    one = np.uint64(1)
    for c in range(0, len(planes), CHUNK):
        rows = planes[c : c + CHUNK]
        diff = rows[:, y1]
        diff <<= one
        diff <<= up
        low = rows[:, y0]
        low >>= r
        diff |= low
        diff ^= rows[:, at]
        count = _add([np.concatenate([count[0], diff]) if count else diff, *count[1:]])
        alive = alive & ~_exceeds(count, limit, len(at))
        stay = np.flatnonzero(alive)
        if len(stay) < len(at):  # abandon words without a pair left
            at, alive, shift, r, up, y0, y1 = (x[stay] for x in (at, alive, shift, r, up, y0, y1))
            count, limit = [x[:, stay] for x in count], [x[stay] for x in limit]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little"))
    return at[hit // 64] * 64 + hit % 64, shift[hit // 64]


def _folded(data: np.ndarray, start: np.ndarray, width: np.ndarray) -> list[np.ndarray]:
    """For each of WIDTHS the maps of the lanes at least as wide, folded to it."""
    out = []
    for w in WIDTHS:
        rows = np.zeros((len(width), w // 8), np.uint8)
        for own in WIDTHS:
            at = np.flatnonzero(width == own)
            if own >= w and len(at):
                x = data[start[at][:, None] + np.arange(own // 8)]
                rows[at] = np.bitwise_xor.reduce(x.reshape(len(at), own // w, w // 8), axis=1)
        out.append(rows[width >= w])
    return out


def paired(new: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Which lanes are in a bucket that can hold a pair: of two records or more, with both sides, and with a
    hash that is among a smaller set's prefix. ``new`` marks the first lane of each bucket."""
    start = np.flatnonzero(new)
    members = np.diff(np.append(start, len(new)))
    either = np.bitwise_or.reduceat(flags, start)
    return np.repeat((members > 1) & (either & 7 == 7), members)


def candidates(posts: DataFrame, t: float) -> DataFrame:
    """(a, b) rids, distinct, of pairs that survive the bit-sliced comparison."""

    def flush(table):
        key = table.column(0).to_numpy()
        new = np.empty(len(key), bool)
        new[:1] = True
        new[1:] = key[1:] != key[:-1]
        keep = np.flatnonzero(paired(new, table.column(4).to_numpy()))
        if not len(keep):
            return None
        group = np.unique((np.cumsum(new) - 1)[keep], return_inverse=True)[1]
        table = table.take(pa.array(keep)).combine_chunks()
        n, pos, rid, flags = (table.column(k).to_numpy() for k in range(1, 5))
        col = table.column(5).chunk(0)
        offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8)
        width = np.diff(offsets) * 8
        i, j = compare(group, n, pos, flags, width, _folded(data, offsets[:-1], width), t)
        a, b = np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])
        ab = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    def run(batches):
        parts, lanes = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            parts.append(b)
            lanes += b.num_rows
            if lanes < LANES:
                continue
            table = pa.Table.from_batches(parts)
            key = table.column(0).to_numpy()
            end = int(np.searchsorted(key, key[-1], side="left"))  # the last key may go on
            if end:
                out = flush(table.slice(0, end))
                if out is not None:
                    yield out
                parts = table.slice(end).to_batches()
                lanes = len(key) - end
        if lanes:
            out = flush(pa.Table.from_batches(parts))
            if out is not None:
                yield out

    by_key = posts.repartition("key").sortWithinPartitions("key", "n", "rid")
    return by_key.mapInArrow(run, "a long, b long").distinct()


def verified(cand: DataFrame, reps: DataFrame, t: float) -> DataFrame:
    """(a, b, na, nb, overlap) of the candidates that reach ``t``. The candidates' sets are picked out by
    a broadcast of ids only while these are at most ``BROADCAST_IDS``; beyond, by a shuffled join."""
    cand = cut(cand)
    ids = cand.select(F.col("a").alias("rid")).union(cand.select("b")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    sets = reps.select("rid", "n", "s").join(ids, "rid", "left_semi")
    left = sets.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    right = sets.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    both = cand.join(left, "a").join(right, "b").withColumn("overlap", F.size(F.array_intersect("sa", "sb")))
    f = Fraction(str(t))
    return both.where(F.col("overlap") * (f.denominator + f.numerator) >= (F.col("na") + F.col("nb")) * f.numerator).select(
        "a", "b", "na", "nb", "overlap"
    )


def near_pairs(docs: DataFrame, t: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs between classes, classes, members) of ``docs(id, grp long, side byte, s)``; a pair needs
    one class with side 1 and the other with side 2."""
    docs = docs.where(F.size("s") > 0)
    reps, members = representatives(docs)
    pairs = verified(candidates(postings(reps, t, frequent(reps)), t), reps, t)
    return cut(pairs), reps, members
