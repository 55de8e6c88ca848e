"""Problem 9: documents that hold passages of evaluation items.

Q-gram lemma filtering. Texts become their words joined by single spaces. A passage of L characters that
stands in a document with at most k edits shares at least L + 1 - q - kq character q-grams with it, on
diagonals that drift by at most k. Shared q-grams are counted in overlapping diagonal bands; the regions
that meet the bound, and only they, are verified by banded alignment (match +1, edit -1, so a passage
scores at least L - 2k). ``exact`` tells whether ``min_words`` consecutive words of the item stand there
unchanged.

The items are fixed and few: their q-gram index is sent to every task in blocks of at most
``BLOCK_CHARS`` characters; more items mean more passes, not a larger broadcast. Long documents are
scanned in overlapping pieces. Defined cases: null and empty texts and items below ``min_words`` words
give no rows; repeated rows give one row a pair; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_pairs import words

Q = 8
EDITS = 3
MIN_WORDS = 15
STEP = 16  # bands are 2 * STEP wide and overlap by half
BLOCK_CHARS = 4_000_000
PIECE = 500_000
_BASE = np.uint64(0x100000001B3)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each position."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h = h * _BASE + codes[i : i + n] + np.uint64(1)
    return h ^ (h >> np.uint64(29))


class ItemIndex:
    def __init__(self, items: list[tuple[int, list[str]]], q: int = Q, edits: int = EDITS, min_words: int = MIN_WORDS):
        self.q, self.edits = q, edits
        self.ids, self.texts, self.least, self.most, self.windows = [], [], [], [], []
        grams, item, pos = [], [], []
        for item_id, w in items:
            if w is None or len(w) < min_words:
                continue
            text = " " + " ".join(w) + " "
            windows = [" " + " ".join(w[i : i + min_words]) + " " for i in range(len(w) - min_words + 1)]
            g = _grams(_codes(text), q)
            grams.append(g)
            item.append(np.full(len(g), len(self.ids)))
            pos.append(np.arange(len(g)))
            self.ids.append(item_id)
            self.texts.append(text)
            self.windows.append(windows)
            self.least.append(min(map(len, windows)))
            self.most.append(max(map(len, windows)))
        g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.keys, self.first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.item = np.concatenate(item)[order] if grams else np.zeros(0, np.int64)
        self.pos = np.concatenate(pos)[order] if grams else np.zeros(0, np.int64)
        self.least, self.most = np.array(self.least, np.int64), np.array(self.most, np.int64)
        self.bound = np.maximum(1, self.least + 1 - q - edits * q)
        self.reach = int(self.most.max()) + edits + 2 * STEP if len(self.most) else 0

    def regions(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, diagonal band, lo, hi): document spans whose shared q-grams meet the item's bound."""
        if not len(self.keys):
            return []
        h = _grams(_codes(text), self.q)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        where = np.flatnonzero(self.keys[at] == h)
        if len(where) < self.bound.min():
            return []
        k = at[where]
        times = self.count[k]
        src = np.repeat(self.first[k], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item = self.item[src]
        many = np.flatnonzero(np.bincount(item, minlength=len(self.bound))[item] >= self.bound[item])
        if not len(many):  # no item has as many in the whole text
            return []
        dpos, item, ipos = np.repeat(where, times)[many], item[many], self.pos[src[many]]
        band = (dpos - ipos + (1 << 40)) // STEP
        item, band, dpos = np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(dpos, 2)
        order = np.lexsort((dpos, band, item))
        item, band, dpos = item[order], band[order], dpos[order]
        need = self.bound[item]
        last = np.arange(len(item)) + need - 1  # the need-th q-gram from here on
        ok = last < len(item)
        last = np.minimum(last, len(item) - 1)
        ok &= (item[last] == item) & (band[last] == band) & (dpos[last] - dpos <= self.most[item] + self.edits)
        hits = np.flatnonzero(ok)
        if not len(hits):
            return []
        a, b, lo, hi = item[hits], band[hits], dpos[hits], dpos[last[hits]] + self.q
        first = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
        end = np.append(first[1:], len(a)) - 1  # positions rise within an item's band
        return list(zip(a[first].tolist(), b[first].tolist(), lo[first].tolist(), hi[end].tolist()))

    def align(self, jobs: list[tuple[str, int, int, int, int]]) -> np.ndarray:
        """Best local alignment score of each (text, item, band, lo, hi), in its band, all at once."""
        wide = 4 * STEP
        rows = max(j[4] - j[3] for j in jobs)
        a = np.zeros((len(jobs), rows), np.uint32)
        b = np.zeros((len(jobs), rows + wide), np.uint32)
        for r, (text, item, band, lo, hi) in enumerate(jobs):
            part = np.frombuffer(text[lo:hi].encode("utf-32-le"), np.uint32)
            a[r, : len(part)] = part
            d = band * STEP - (1 << 40)  # least diagonal
            it = np.frombuffer(self.texts[item].encode("utf-32-le"), np.uint32)
            x = lo - d - 2 * STEP - STEP + np.arange(rows + wide)  # item positions of the band's columns
            inside = (x >= 0) & (x < len(it))
            b[r, inside] = it[x[inside]]
        h = np.zeros((len(jobs), wide + 1), np.int32)
        best = np.zeros(len(jobs), np.int32)
        col = np.arange(wide, dtype=np.int32)
        for i in range(rows):
            same = (b[:, i : i + wide] == a[:, i : i + 1]) & (a[:, i : i + 1] != 0)
            new = np.maximum(h[:, :wide] + np.where(same, 1, -1), h[:, 1:] - 1)
            new = np.maximum(new, 0)
            new = np.maximum.accumulate(new + col, axis=1) - col
            h[:, :wide] = new
            best = np.maximum(best, new.max(axis=1))
        return best


def _pieces(text: str, reach: int):
    step = max(1, PIECE - reach)
    for s in range(0, max(1, len(text) - reach), step):
        yield s, text[s : s + PIECE]


def _scan(index: ItemIndex, ids, texts):
    """(doc, item, score, bound score, exact) rows."""
    jobs, owner = [], []
    for doc, t in zip(ids, texts):
        if not t:
            continue
        padded = " " + t + " "
        for _, piece in _pieces(padded, index.reach):
            for item, band, lo, hi in index.regions(piece):
                lo, hi = max(0, lo - STEP), min(len(piece), hi + STEP)
                jobs.append((piece, item, band, lo, hi))
                owner.append(doc)
    best: dict[tuple[int, int], list] = {}
    by_length = sorted(range(len(jobs)), key=lambda k: jobs[k][4] - jobs[k][3])  # jobs aligned at once are alike
    jobs, owner = [jobs[k] for k in by_length], [owner[k] for k in by_length]
    for s in range(0, len(jobs), 1024):
        for (piece, item, band, lo, hi), doc, score in zip(jobs[s : s + 1024], owner[s : s + 1024], index.align(jobs[s : s + 1024])):
            if score < index.least[item] - 2 * index.edits:
                continue
            part = piece[max(0, lo - 2 * STEP) : hi + 2 * STEP]
            row = best.setdefault((doc, item), [0, False])
            row[0] = max(row[0], int(score))
            row[1] = row[1] or any(w in part for w in index.windows[item])
    return [(doc, index.ids[item], score, exact) for (doc, item), (score, exact) in best.items()]


def leaked(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, edits: int = EDITS, q: int = Q) -> DataFrame:
    """(doc_id, item_id, score, exact) from ``docs(doc_id long, text)`` and ``items(item_id long, text)``."""
    it = items.where(F.col("text").isNotNull()).select("item_id", words(F.col("text")).alias("w")).distinct()
    chars = it.agg(F.coalesce(F.sum(F.length(F.array_join("w", " "))), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    corpus = docs.where(F.col("text").isNotNull()).select("doc_id", F.array_join(words(F.col("text")), " ").alias("t"))
    out = None
    for block in range(blocks):
        mine = it.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        bound = docs.sparkSession.sparkContext.broadcast([(r["item_id"], list(r["w"])) for r in mine])

        def run(batches, bound=bound):
            index = ItemIndex(bound.value, q, edits, min_words)
            for b in batches:
                for s in range(0, b.num_rows, 2048):
                    part = b.slice(s, 2048)
                    rows = _scan(index, part.column(0).to_pylist(), part.column(1).to_pylist())
                    if rows:
                        d, i, c, e = zip(*rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(c, pa.int32()), pa.array(e)],
                            ["doc_id", "item_id", "score", "exact"],
                        )

        part = corpus.mapInArrow(run, "doc_id long, item_id long, score int, exact boolean")
        out = part if out is None else out.union(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("exact").alias("exact"))
