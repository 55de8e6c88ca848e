"""Problem 8: token ids of every text by a public byte-level BPE.

Overlapping chunk encoding, for every text of more than ``CHUNK`` + ``OVERLAP`` characters (a shorter one is one chunk):

1. Texts are cut into chunks that overlap by ``OVERLAP`` characters. All chunks of a batch are
   pre-tokenised at once, each from its own first character and without knowing what stands before it.
2. The split has no memory: from a place where two scans both have a boundary on they agree. Chunks are
   stitched at the first settled boundary that both have in their overlap (a boundary is settled if the
   chunk shows what the split looks at behind it). Where they have none (a run without boundary that is
   longer than the overlap) the earlier scan goes on over windows of doubled length until it meets one.
3. The pieces between the stitched boundaries are encoded, equal pieces once; the ids are concatenated.
   Decoding concatenates raw bytes.

One scan of the corpus, no shuffle, time linear in a text's length; a text is one row, which Spark bounds
at 2 GB. The split is computed on arrays of character classes (letter, number, white space, other), which
are asked of the encoder's own pattern engine, so that both know the same letters.

The vocabulary is a file of fixed size whose path is a parameter; the driver reads it and sends it to the
tasks. Defined cases: an empty and a null text have the empty list; special tokens' strings are ordinary
text; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 1024
OVERLAP = 128
BATCH_CHARS = 2_000_000
CACHE = 200_000
#: Characters behind a token that the split looks at.
AHEAD = 2
SPACE, LETTER, NUMBER, OTHER, EDGE = range(5)
_GAP = "\ud800"  # between chunks: no text has it


@lru_cache(maxsize=2)
def encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, as the encoder's pattern engine sees it."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\s", SPACE), (r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        one = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out[np.frombuffer(one.decode(one.encode_ordinary(every)).encode("utf-32-le"), np.uint32)] = kind
    out[ord(_GAP)] = EDGE
    return out


def boundaries(joined: str) -> np.ndarray:
    """First positions of the pre-tokens of chunks joined by ``_GAP``, each chunk scanned from its start."""
    code = np.frombuffer(f"{_GAP}{joined}{_GAP * 3}".encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[code]
    before, here, after = kind[:-4], kind[1:-3], kind[2:-2]
    c, before_c = code[1:-3], code[:-4]
    begins = (here != before) & ~((before_c == ord(" ")) & (here != SPACE))  # a space goes with what follows it
    begins |= (here == SPACE) & (before == SPACE) & (after >= LETTER) & (after <= OTHER)  # so the last of several parts
    # an apostrophe by itself, not behind a space, with one of the fixed endings
    at = np.flatnonzero((c == ord("'")) & begins & (after == LETTER) & (before != OTHER))
    one, two = code[at + 2], code[at + 3]
    short = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
    pair = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
    for place, n in ((at[short], 2), (at[pair & ~short], 3)):
        begins[place + 1] = False
        ends = place[place + n < len(begins)] + n
        begins[ends[here[ends] == LETTER]] = True  # what follows the ending and is no letter begins anyway
    begins &= here != EDGE
    return np.flatnonzero(begins)


def _settled(begin: np.ndarray, length: int, final: bool) -> np.ndarray:
    """Of a chunk's boundaries, those from which on the next token is sure not to depend on what follows the chunk."""
    if final or not len(begin):
        return begin
    return begin[: np.searchsorted(np.append(begin[1:], length), length - AHEAD, side="right") + 1]


def stitch(text: str, chunks: list[tuple[int, np.ndarray]], overlap: int) -> np.ndarray:
    """Boundaries of a whole text from its chunks' (start, boundaries in the text's positions)."""
    parts, at, k, n = [], 0, 0, len(text)
    starts = [s for s, _ in chunks]
    scan = chunks[0][1]
    while k + 1 < len(chunks):
        mine = scan[np.searchsorted(scan, at) :]
        common = mine[np.isin(mine, chunks[k + 1][1])] if len(mine) else mine
        if len(common):
            k += 1
        else:  # the scan goes on until it meets a later chunk's
            begin, step = int(mine[-1]) if len(mine) else at, overlap
            while not len(common):
                step *= 2
                end = min(n, begin + step)
                more = _settled(boundaries(text[begin:end]), end - begin, end == n) + begin
                later = [j for j in range(k + 1, len(chunks)) if starts[j] < end]
                known = np.concatenate([chunks[j][1] for j in later]) if later else more[:0]
                common = more[(more > begin) & np.isin(more, known)]
                if end == n:
                    break
            mine = np.concatenate([mine[:-1], more])
            if not len(common):
                parts.append(mine)
                return np.concatenate(parts)
            k = max(j for j in later if len(chunks[j][1]) and chunks[j][1][0] <= common[0] <= chunks[j][1][-1] and np.isin(common[0], chunks[j][1]))
        at = int(common[0])
        parts.append(mine[: np.searchsorted(mine, at)])
        scan = chunks[k][1]
    parts.append(scan[np.searchsorted(scan, at) :])
    return np.concatenate(parts)


def splits(texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[np.ndarray]:
    """Pre-token boundaries of every text, by way of overlapping chunks."""
    cuts, owner = [], []
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - overlap), chunk):
            cuts.append((s, t[s : s + chunk + overlap]))
            owner.append(i)
    found = boundaries(_GAP.join(c for _, c in cuts))
    size = np.array([len(c) + 1 for _, c in cuts])
    first = np.cumsum(size) - size
    edge = np.searchsorted(found, np.append(first, first[-1] + size[-1]))
    out: list[list] = [[] for _ in texts]
    for k, (s, c) in enumerate(cuts):
        final = k + 1 == len(cuts) or owner[k + 1] != owner[k]
        out[owner[k]].append((s, _settled(found[edge[k] : edge[k + 1]] - first[k], len(c), final) + s))
    return [x[0][1] if len(x) == 1 else stitch(t, x, overlap) for t, x in zip(texts, out)]


class Encoder:
    """Ids of texts, with a bounded cache of pieces."""

    def __init__(self, enc, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.enc, self.chunk, self.overlap, self.known = enc, chunk, overlap, {}

    def __call__(self, texts: list[str]) -> list[list[int]]:
        pieces = []
        for t, b in zip(texts, splits(texts, self.chunk, self.overlap) if texts else ()):
            b = b.tolist()
            pieces.append([t[i:j] for i, j in zip(b, [*b[1:], len(t)])])
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        new = list({p for x in pieces for p in x if p not in known})
        known.update(zip(new, map(self.enc.encode_ordinary, new)))
        return [list(chain.from_iterable([known[p] for p in x])) for x in pieces]


def token_ids(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(id_col, ids) of every row."""
    with open(ranks, "rb") as f:
        bound = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches):
        encode = Encoder(encoding(bound.value), chunk, overlap)

        def encoded(part, texts):
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(encode(texts), pa.list_(pa.int32()))], ["id", "ids"])

        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            begin, chars = 0, 0
            for i, t in enumerate(texts):
                if chars and chars + len(t) > BATCH_CHARS:
                    yield encoded(b.slice(begin, i - begin), texts[begin:i])
                    begin, chars = i, 0
                chars += len(t)
            yield encoded(b.slice(begin), texts[begin:])

    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def decoded(ids: DataFrame, ids_col: str = "ids", ranks: str = RANKS) -> DataFrame:
    """``ids`` with ``decoded``: the raw bytes of the ids one after the other, as text."""
    with open(ranks, "rb") as f:
        bound = ids.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def decode(col):
        enc = encoding(bound.value)
        return col.map(lambda x: None if x is None else enc.decode_bytes([int(i) for i in x]).decode("utf-8", "replace"))

    return ids.withColumn("decoded", decode(ids_col))
