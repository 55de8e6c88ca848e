"""Problem 7: the language of every text and of every segment of it, with a confidence.

String-kernel classification. The blended-spectrum presence kernel of two segments is the number of
character n-grams (1 to 4 letters, words padded by a space) that both hold, over the root of the product
of both numbers. Nystroem landmarks, drawn from the labelled rows, give the feature map
K(x, landmarks) K^-1/2, one-versus-rest kernel ridge regression the weights. N-grams are hashed, so the
scores of a batch are one sparse matrix product: presence (segments x n-grams) times
presence (n-grams x landmarks) times weights (landmarks x languages), the last two multiplied beforehand.

The classifier is fitted on a bounded sample: at most ``PER_LANGUAGE`` labelled rows of each declared
language, by a hash of their id; rows whose declared language the first fit rejects are left out of the
second. Everything else covers all rows.

Segments are sentences: they end at . ! ? and ellipses before white space, at line breaks and at
separators between spaces. A text without a segment of ``MIN_WORDS`` words is classified as a whole. A shorter
segment adds its language (with 0 segments) where the languages of the text so far are clearly behind. The replacement character counts as a letter, and every
``LOST_EACH``-th training segment is also learned with its letters outside ASCII lost, so that the n-grams of
lost letters tell as much as they do. Defined cases: null and empty texts and texts without letters are
``und`` with confidence 0; labels that are null, empty or of no language are undetermined; repeated rows
count once; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mojibake

#: Notations of one language, beside the two-letter code.
NOTATIONS = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"),
    "pt": ("por", "portuguese"),
    "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch"),
    "pl": ("pol", "polish"),
    "ru": ("rus", "russian"),
    "tr": ("tur", "turkish"),
}
UNDETERMINED = ("", "und", "unknown", "??", "?", "none", "null", "n/a", "mul", "zxx", "xx")
LANGS = tuple(NOTATIONS)
PER_LANGUAGE = 300
LANDMARKS = 600
DIM = 1 << 16
RIDGE = 1e-3
GRAMS = (1, 2, 3, 4)
MIN_WORDS = 6
CASE_WORDS = 8
SURE = 0.6
LOST_EACH = 8
UND = "und"
LOST = "\ufffd"

_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"(?:[^\W\d_]|\ufffd)+['’]?")
_CUT = re.compile(r"(?<=[.!?…])[\"”“»’')\]]*\s+|\s*[\r\n  \x85]+\s*|\s+(?:/|\||-{2,}|—|\*{3,}|={3,}|•)+\s+")


def label_code(label: Column) -> Column:
    """The two-letter code of a declared language; another language's name as it is; null if undetermined."""
    low = F.lower(F.trim(label))
    base = F.regexp_extract(low, "^([^-_]*)", 1)
    out = F.when(low.isin(*UNDETERMINED) | (base == ""), F.lit(None))
    for code, names in NOTATIONS.items():
        out = out.when(base.isin(code, *names), code)
    return out.otherwise(base)


def segments(text: str) -> list[str]:
    return [s for s in _CUT.split(text) if s and s.strip()]


def n_words(text: str) -> int:
    return len(_WORD.findall(text.lower()))


@lru_cache(maxsize=200_000)
def _word_grams(word: str) -> tuple[int, ...]:
    return _grams(word)


def _grams(word: str) -> tuple[int, ...]:
    w = f" {word} "
    return tuple({zlib.crc32(w[i : i + k].encode()) & (DIM - 1) for k in GRAMS for i in range(len(w) - k + 1) if w[i : i + k] != " "})


def presence(segment: str) -> np.ndarray:
    """Hashed n-grams that the segment holds. Names (capital letter inside a segment) are left out."""
    words = _LETTERS.findall(segment)
    plain = [w.lower().replace("’", "'") for i, w in enumerate(words) if i == 0 or not w[0].isupper() or w.isupper()]
    grams: set[int] = set()
    for w in plain if len(plain) > 2 else [w.lower().replace("’", "'") for w in words]:
        grams.update(_word_grams(w) if len(w) <= 40 else _grams(w))  # long ones are not kept
    return np.fromiter(grams, np.int64, len(grams))


def _scores(sets: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Sparse presence matrix times ``table`` (n-grams x columns), rows divided by the root of their size."""
    n = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), table.shape[1]), table.dtype)
    full = np.flatnonzero(n)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        start = np.cumsum(n[full]) - n[full]
        step = max(8, 16_384 // table.shape[1])  # the gathered rows are a few MB, however wide the table
        for s in range(0, len(full), step):
            e = min(s + step, len(full))
            lo, hi = start[s], start[e] if e < len(full) else len(flat)
            out[full[s:e]] = np.add.reduceat(table[flat[lo:hi]], start[s:e] - lo, axis=0)
        out[full] /= np.sqrt(n[full])[:, None]
    return out


def fit(samples: list[tuple[str, str]], landmarks: int = LANDMARKS) -> np.ndarray:
    """(n-grams x languages) table of the kernel classifier from (segment, language)."""
    sets, langs = [presence(s) for s, _ in samples], np.array([LANGS.index(x) for _, x in samples])
    ok = [i for i, s in enumerate(sets) if len(s)]
    sets, langs = [sets[i] for i in ok], langs[ok]
    table = np.zeros((DIM, len(LANGS)), np.float32)
    if not sets:
        return table
    chosen = []
    for c in range(len(LANGS)):  # landmarks of every language
        own = np.flatnonzero(langs == c)
        chosen += own[:: max(1, -(-len(own) * len(LANGS) // landmarks))].tolist()
    marks = np.zeros((DIM, len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        marks[sets[i], j] = 1 / np.sqrt(len(sets[i]))
    kernel = _scores(sets, marks).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    keep = values > 1e-6 * values.max()
    half = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel @ half
    weight = np.ones(len(langs))
    for c in range(len(LANGS)):
        weight[langs == c] = len(langs) / max(1, (langs == c).sum()) / len(LANGS)
    target = np.where(langs[:, None] == np.arange(len(LANGS)), 1.0, -1.0)
    gram = phi.T @ (phi * weight[:, None]) + RIDGE * len(langs) * np.eye(phi.shape[1])
    ridge = np.linalg.solve(gram, phi.T @ (target * weight[:, None]))
    return (marks @ (half @ ridge).astype(np.float32)).astype(np.float32)


def with_lost_letters(segment: str, times: int) -> str:
    """The segment with each letter outside ASCII lost, as ``times`` replacement characters."""
    return "".join(c if c.isascii() or not c.isalpha() else LOST * times for c in segment)


def with_lost(samples: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The samples and, of every ``LOST_EACH``-th, one with its letters lost, each as one or two signs."""
    some = [(x, lang) for x, lang in samples[::LOST_EACH] if not x.isascii()]
    return samples + [(with_lost_letters(x, 1 + k % 2), lang) for k, (x, lang) in enumerate(some)]


def confidence(scores: np.ndarray) -> np.ndarray:
    """Softmax of the one-versus-rest scores."""
    z = np.exp(4 * (scores - scores.max(axis=1, keepdims=True)))
    return (z / z.sum(axis=1, keepdims=True)).max(axis=1)


def fit_on(texts: DataFrame, labels: DataFrame, vocabulary, per_language: int = PER_LANGUAGE) -> np.ndarray:
    """Fit on at most ``per_language`` rows (of 40 to 10,000 characters, to bound the sample) of ``texts(id, text)`` for each language of ``labels(id, lang)``."""
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    some = labels.where(F.col("lang").isin(*LANGS)).select("id", "lang").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_language)
    rows = texts.where("length(text) between 40 and 10000").join(F.broadcast(some), "id").groupBy("id", "lang").agg(F.max("text").alias("text")).orderBy("id").collect()
    finder = mojibake._finder(vocabulary)
    samples = []
    for r in rows:
        for s in segments(finder.restore(r["text"])[0])[:20]:
            if n_words(s) >= MIN_WORDS:
                samples.append((s, r["lang"]))
    samples = with_lost(samples)
    table = fit(samples)
    for _ in range(2):
        got = _scores([presence(s) for s, _ in samples], table).argmax(axis=1)
        table = fit([x for x, g in zip(samples, got) if LANGS[g] == x[1]])
    return table


def texts_languages(texts: list[str], table: np.ndarray) -> list[list[tuple[str, float, int]]]:
    """For each text [(language, confidence, segments)] by its segments of ``MIN_WORDS`` words or more, most
    segments first. The others are left to ``short_languages``."""
    segs, owner = [], []
    for i, t in enumerate(texts):
        for s in segments(t):
            if n_words(s) >= MIN_WORDS:
                segs.append(s)
                owner.append(i)
    out: list[list] = [[] for _ in texts]
    if not segs:
        return out
    scores = _scores([presence(s) for s in segs], table)
    owner = np.array(owner)
    conf = confidence(scores)
    best = scores.argmax(axis=1)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        lo, hi = bounds[i], bounds[i + 1]
        if lo == hi:
            continue
        b, sc = best[lo:hi].copy(), scores[lo:hi]
        main = int(np.bincount(b, minlength=len(LANGS)).argmax()) if hi - lo > 2 else int(sc.sum(axis=0).argmax())
        # a segment leaves the text's main language only when that is clearly behind
        unsure = sc[np.arange(hi - lo), b] - sc[:, main] < SURE
        b[unsure] = main
        for lang in np.unique(b):
            at = b == lang
            out[i].append((LANGS[lang], float(conf[lo:hi][at].max()), int(at.sum())))
        out[i].sort(key=lambda x: (-x[2], x[0]))
    return out


def whole_language(texts: list[str], table: np.ndarray) -> list[tuple[str, float]]:
    """(language, confidence) of each text as one segment; ``und`` where it has no letters."""
    sets = [presence(t) for t in texts]
    scores = _scores(sets, table)
    conf = confidence(scores)
    return [(LANGS[int(x.argmax())], float(c)) if len(s) else (UND, 0.0) for s, x, c in zip(sets, scores, conf)]


def short_languages(texts: list[str], known: list[list[str]], table: np.ndarray) -> list[list[tuple[str, float, int]]]:
    """For each text [(language, confidence, 0)] of its segments below ``MIN_WORDS`` words, without the
    languages ``known`` of it and where these are clearly behind."""
    sets, owner = [], []
    for i, t in enumerate(texts):
        if known[i] and known[i] != [UND]:
            for s in segments(t):
                if s != t and n_words(s) < MIN_WORDS and len(grams := presence(s)):
                    sets.append(grams)
                    owner.append(i)
    best: list[dict[str, float]] = [{} for _ in texts]
    if sets:
        scores = _scores(sets, table)
        for i, x, c in zip(owner, scores, confidence(scores)):
            lang = LANGS[int(x.argmax())]
            if x.max() - max(x[LANGS.index(k)] for k in known[i]) >= SURE:
                best[i][lang] = max(best[i].get(lang, 0.0), float(c))
    return [[(lang, c, 0) for lang, c in sorted(b.items())] for b in best]


def languages(texts: DataFrame, table: np.ndarray, vocabulary) -> DataFrame:
    """(id, words, langs array<struct<lang, confidence, segments>>, whole struct<lang, confidence, segments>,
    short array<struct<...>>) of every row of ``texts(id, text)``; ``whole``, of the text as one segment, only
    where ``langs`` is empty; ``short``: languages that only segments below ``MIN_WORDS`` words are in."""
    bound = texts.sparkSession.sparkContext.broadcast((table, vocabulary))

    def run(batches):
        model, vocab = bound.value
        finder = mojibake._finder(vocab)
        one = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("segments", pa.int32())])
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                raw = [t or "" for t in part.column(1).to_pylist()]
                fixed = [t if t.isascii() else finder.restore(t)[0] for t in raw]
                langs = [[{"lang": a, "confidence": c, "segments": n} for a, c, n in x] for x in texts_languages(fixed, model)]
                words = pa.array([n_words(t) for t in raw], pa.int32())
                rest = [i for i, x in enumerate(langs) if not x]
                whole: list[dict | None] = [None] * len(raw)
                for i, (lang, c) in zip(rest, whole_language([fixed[i] for i in rest], model) if rest else ()):
                    whole[i] = {"lang": lang, "confidence": c, "segments": 0}
                known = [[y["lang"] for y in x or [w]] for x, w in zip(langs, whole)]
                short = [[{"lang": a, "confidence": c, "segments": n} for a, c, n in x] for x in short_languages(fixed, known, model)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), words, pa.array(langs, pa.list_(one)), pa.array(whole, one), pa.array(short, pa.list_(one))], ["id", "words", "langs", "whole", "short"]
                )

    return texts.select("id", "text").mapInArrow(
        run,
        "id string, words int, langs array<struct<lang: string, confidence: double, segments: int>>, whole struct<lang: string, confidence: double, segments: int>, short array<struct<lang: string, confidence: double, segments: int>>",
    )


def cases(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, lang, confidence, reason) of texts of ``CASE_WORDS`` words or more without label, with a wrong
    one or in several languages; one row for each language. ``found`` as of languages()."""
    per = labels.groupBy("id").agg(F.collect_set("lang").alias("labels"))
    rows = found.where((F.col("words") >= CASE_WORDS) & (F.size("langs") > 0)).dropDuplicates(["id"]).join(per, "id", "left")
    codes = F.transform("langs", lambda x: x["lang"])
    known = F.coalesce(F.col("labels"), F.array().cast("array<string>"))
    reason = (
        F.when(F.size("langs") > 1, "several")
        .when(F.size(known) == 0, "no label")
        .when(F.size(F.array_except(known, codes)) > 0, "wrong label")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select("id", F.explode("langs").alias("x"), "reason").select(
        "id", "x.lang", "x.confidence", "reason"
    )
