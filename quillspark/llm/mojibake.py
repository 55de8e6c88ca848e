"""Problem 2: text decoded with the wrong character encoding, found and restored.

Garbled sequences are computed beforehand for all pairs (true encoding, wrong encoding) and put into one
Aho-Corasick automaton, which finds every one of them in a single pass over a text:

* UTF-8 read as a one-byte encoding, once or twice: each letter and sign becomes two or more characters.
  Latin and Russian letters and frequent signs are patterns; every other assigned character is found by
  its form, a lead and its continuation bytes, where that is no correct text (``utf8_runs``);
* one one-byte encoding read as another: each letter becomes one character, so the patterns are whole
  words: the garbled forms of the collection's own frequent words with letters outside ASCII. Whether such
  a form is a word itself is decided in each text by the language of the words beside it; only where they
  tell nothing, the numbers of distinct texts with either are compared;
* single characters that are proof only between certain neighbours (a box-drawing sign inside a word, a
  Cyrillic letter in a Latin word, a capital with an accent inside a small-letter word), checked there.

Only matched spans are replaced; correct text around them stays. U+FFFD and lost bytes are found but
cannot be restored (``restorable`` false). Defined cases: null and empty texts are no case; repeated rows
give repeated rows; correct letters and signs of any language are no case; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WRONG_FOR_UTF8 = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859-2", "iso8859-15", "cp1254", "koi8-r", "cp866", "cp1253", "cp1257", "cp852")
ONE_BYTE = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1254", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "cp1257", "cp852")
LATIN = "".join(chr(c) for c in range(0xC0, 0x180) if chr(c) not in "×÷") + "ȘșȚț"
CYRILLIC = "".join(chr(c) for c in range(0x410, 0x450)) + "Ёё"
SIGNS = "“”„‘’‚–—…«»€£°µ½¼¾±ºª§©®™•·×÷¢¥†‡‰‹›²³¹¿¡\xa0\xad→★☆♥❤☑☐✔✓−ツ👍🔥😂😀🎮"
MIN_RECORDS = 5
VOCABULARY_SHARE = 1 / 20_000
CLEARLY_MORE = 20
#: Signs that are as likely correct as garbled: inside a word, and at its ends.
QUOTING = "’‘“”„‚–—…«»‹›'"
CLEAN = QUOTING + "€£°µ½ºª©™®§·•"
#: Signs outside ASCII that correct text may have between two letters.
JOINING = set("´’‘–—…°™®©×•\xad\xa0ªº†µ¸​‍−→/″′“”„«»‹›")

#: Quotation marks of cp1252 and mac_roman, as they look read as another one-byte encoding, around a word.
QUOTES = {"ì": "î", "Ò": "Ó", "ô": "ö"}
ROUNDS = 3

#: Letters outside ASCII by language, and frequent words in letters that wrong one-byte encodings leave alone.
ALPHABETS = {
    "en": "éèêëçñïöüäáíóúåøæœàâôû", "de": "äöüß", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíñóúü", "pt": "ãáàâçéêíõóôúü", "it": "àèéìíîòóùú", "nl": "áéíóúàèëïöü",
    "pl": "ąćęłńóśźż", "tr": "çğıi̇öşüâîû", "cs": "áčďéěíňóřšťúůýž", "hu": "áéíóöőúüű", "sv": "åäöé", "da": "æøåé", "fi": "äöå", "ro": "ăâîșțşţ", "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
}
FUNCTION_WORDS = {
    "en": "the and of to is it this that was with for you but not are have game play very",
    "de": "und der die das ist nicht ein eine mit auch auf sich ich aber wie dem den von zu sehr wird spiel",
    "fr": "le les des une est et dans pour pas que qui sur avec vous je jeu mais plus ce cette",
    "es": "el los las una es en y por con para del muy pero que juego como se lo este",
    "pt": "o os as um uma em e com do da dos das mas muito que jogo por para isso ele",
    "it": "il gli della un una di e con per non che sono molto ma gioco questo come del nel",
    "nl": "de het een en van niet dat zijn met voor op maar ook je spel wel deze er",
    "pl": "i w na nie jest to z do jak ale gra ta od po za dla tak bardzo tylko gry",
    "tr": "bir ve bu da de ne ama bana daha ile oyun en her kadar sonra oyunu ben gibi olan oldu",
    "cs": "a v na je se to z do ale jako hra pro po za tak by jsem jen od hru",
    "hu": "a az egy nem hogy van meg csak ez de is ha vagy volt mint",
    "sv": "och att det som en inte med den av till ett jag men var spelet",
    "da": "og at det som en ikke med den af til et jeg men var spillet",
    "fi": "ja on ei se joka mutta kun niin peli ovat oli tai jos ole",
    "ro": "si de la nu este un o cu pe din care mai dar jocul sunt",
    "ru": "и в не на что я с это как но а по у за от из так игра для очень только",
}
_LETTERS = {k: set(v) for k, v in ALPHABETS.items()}
_FUNCTION = {k: set(v.split()) for k, v in FUNCTION_WORDS.items()}
_WORDS = re.compile(r"[^\W\d_]+")
_RUNS = re.compile(r"(?:[a-zA-Z]|[^\x00-\x7F\s])+")
_SIGNS = re.compile(r"[^\x00-\x7F]{2,}")
RARE = "_rare_forms"
#: More signs that correct text has beside letters.
USUAL = set("¡¿¢¥²³¹¼½¾×÷´¨¯†‡‰№♥★☆")
BESIDE = 100


def _decode(data: bytes, wrong: str) -> str | None:
    out = []
    for x in data:
        try:
            out.append(bytes([x]).decode(wrong))
        except UnicodeDecodeError:
            if not wrong.startswith("cp125"):
                return None
            out.append(chr(x))  # browsers keep such bytes as control characters
    return "".join(out)


def _garble(text: str, true: str, wrong: str) -> str | None:
    try:
        return _decode(text.encode(true), wrong)
    except UnicodeEncodeError:
        return None


def _correct_word(s: str) -> bool:
    return all(c in CYRILLIC for c in s) or all(c in LATIN and c.islower() for c in s)


def utf8_patterns() -> dict[str, tuple[str, str]]:
    """garbled sequence -> (character, pair)."""
    out: dict[str, tuple[str, str]] = {}
    for wrong in WRONG_FOR_UTF8:
        for c in LATIN + CYRILLIC + SIGNS:
            once = _garble(c, "utf-8", wrong)
            if once and once != c and not _correct_word(once):
                out.setdefault(once, (c, f"utf-8>{wrong}"))
            twice = once and _garble(once, "utf-8", wrong)
            if twice:
                out.setdefault(twice, (c, f"utf-8>{wrong} twice"))
    quoted = lambda k: len(k) == 2 and k[0].isalpha() and ord(k[0]) >= 0x250 and (k[1] in CLEAN or k[1] in "\xa0\xad")
    return {k: v for k, v in out.items() if len(k) > 1 and not k.isascii() and not quoted(k)}  # the last are left to ``utf8_runs``


def languages_beside(text: str, start: int, end: int) -> tuple[str | None, list[str]]:
    """(the language most function words around a span are of, else most in the text; null if none leads,
    all languages with two function words or more there, and at least half as many as the most)."""
    near, whole = (set(_WORDS.findall(x.lower())) for x in (text[max(0, start - BESIDE) : start] + " " + text[end : end + BESIDE], text[:start] + " " + text[end:]))
    lead, others = None, set()
    for words in (near, whole):
        got = sorted(((len(words & x), k) for k, x in _FUNCTION.items()), reverse=True)
        if lead is None and got[0][0] >= 2 and got[0][0] > got[1][0]:
            lead = got[0][1]
        others.update(k for n, k in got if n >= 2 and 2 * n >= got[0][0])
    return lead, sorted(others)


def _spelled(word: str, lang: str) -> bool:
    """Whether a word of the language may be written so: its letters, and capitals only first or throughout."""
    rest = word[1:]
    return all(c.isascii() or c in _LETTERS[lang] for c in word.lower()) and (rest.islower() or word.isupper())


def is_garbled(form: str, word: str, by_count: bool, lang: str | None, others: list[str]) -> bool | None:
    """Whether ``form`` of letters only is ``word`` garbled, beside words of ``lang``, in a text that may have
    words of ``others``; null if only the numbers of texts speak for it and the form could be a word or name.
    English text tells nothing: its words with such letters are borrowed."""
    lang = None if lang == "en" else lang
    if lang and _spelled(word, lang) and not any(_spelled(form, k) for k in (lang, *others)):
        return True
    if lang and _spelled(form, lang) and not any(_spelled(word, k) for k in (lang, *others)):
        return False
    return None if by_count and _natural(form) else by_count


def _natural(form: str) -> bool:
    """Whether a form is shaped as words and names are: of one script, capitals only first or throughout."""
    rest = form[1:]
    return (rest.islower() or form.isupper()) and len({_script(c) for c in form}) == 1


def _script(c: str) -> int:
    return ord(c) >> 8 if ord(c) >= 0x250 else 0


def word_patterns(vocabulary: dict[str, int]) -> dict[str, list[tuple[str, str, bool]]]:
    """garbled word -> [(word, pair, whether the numbers of texts speak for it)] for the one-byte pairs, from
    frequent words and the number of distinct texts they are in; the most frequent word first."""
    out: dict[str, list[tuple[str, str, bool]]] = {}
    known = _known()
    for word, n in sorted(vocabulary.items(), key=lambda x: (-x[1], x[0])):
        if _garbled_itself(word, known):
            continue
        for g, pair in garbled_forms(word):
            by_count = vocabulary.get(g, 0) * CLEARLY_MORE <= n
            if n * CLEARLY_MORE <= vocabulary.get(g, 0):
                continue  # the form is the word, and this its garbled form
            if not by_count and not any(_spelled(word, k) and not _spelled(g, k) for k in ALPHABETS if k != "en"):
                continue  # no language could speak for it
            if all(x[0] != word for x in out.get(g, ())):
                out.setdefault(g, []).append((word, pair, by_count))
    return out


@lru_cache(maxsize=1)
def _known() -> ahocorasick.Automaton:
    known = ahocorasick.Automaton()
    for g in utf8_patterns():
        known.add_word(g, g)
    known.make_automaton()
    return known


def _garbled_itself(word: str, known: ahocorasick.Automaton) -> bool:
    return next(known.iter(word), None) is not None or any(Finder._proof(word, i) for i, c in enumerate(word) if ord(c) > 127)


def garbled_forms(word: str):
    """(garbled form, pair) of a word for the one-byte pairs."""
    for true in ONE_BYTE:
        try:
            data = word.encode(true)
        except UnicodeEncodeError:
            continue
        for wrong in ONE_BYTE:
            if wrong == true:
                continue
            g = _decode(data, wrong)
            if not g or g == word or not g.isprintable():
                continue
            letters = all(c.isalpha() for c in g)
            if not letters and all(c.isalpha() or c in QUOTING for c in g.strip(CLEAN)):
                continue
            if len(g) >= (3 if letters else 2):
                yield g, f"{true}>{wrong}"


@lru_cache(maxsize=4)
def single_signs() -> dict[str, str]:
    """Garbled single characters of Latin letters, that are no letters themselves -> most likely letter."""
    out: dict[str, str] = {}
    for wrong in ONE_BYTE:
        for true in ("cp1252", "cp1250", "iso8859-2", "cp1254", "mac_roman"):
            for c in LATIN:
                g = _garble(c, true, wrong)
                if g and g != c and ord(g) > 127 and not g.isalpha() and g not in JOINING:
                    out.setdefault(g, c)
    return out


@lru_cache(maxsize=1)
def _forms_of_utf8() -> list[tuple[str, dict[str, int], re.Pattern]]:
    """(wrong encoding, its bytes by character, runs of lead and continuation bytes read in it)."""
    out = []
    for wrong in WRONG_FOR_UTF8:
        byte = {c: x for x in range(0x80, 0x100) if (c := _decode(bytes([x]), wrong))}
        part = lambda a, b: "[" + "".join(re.escape(c) for c, x in byte.items() if a <= x < b) + "]"
        more = part(0x80, 0xC0)
        run = f"(?:{part(0xC2, 0xE0)}{more}|{part(0xE0, 0xF0)}{more}{{2}}|{part(0xF0, 0xF5)}{more}{{3}})+"
        out.append((wrong, byte, re.compile(run)))
    return out


def _assigned(c: str) -> bool:
    return unicodedata.category(c) not in ("Cn", "Co", "Cc", "Cs") or c == "\u200d"


@lru_cache(maxsize=200_000)
def _utf8_parts(signs: str) -> tuple[tuple[int, int, str, str, bool], ...]:
    """(start, end, restored, wrong encoding, proof by itself) in a run of characters outside ASCII."""
    out = []
    for wrong, byte, pattern in _forms_of_utf8():
        for m in pattern.finditer(signs):
            run = m.group()
            try:
                good = bytes(byte[c] for c in run).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if run.isalpha() or not all(map(_assigned, good)):
                continue
            odd = any(not c.isalpha() and c not in CLEAN and c not in JOINING and c not in USUAL for c in run)
            long = max(len(c.encode()) for c in good)
            proof = long == 4 or long == 3 and (odd or len(good) >= 2) or len(good) >= 3 or len(good) == 2 and odd
            out.append((m.start(), m.end(), good, wrong, proof))
    return tuple(out)


def utf8_runs(text: str, known: set[str] = frozenset()) -> list[tuple[int, int, str, str]]:
    """Spans (start, end, restored, pair) that are the UTF-8 form of assigned characters, read in a one-byte
    encoding, and no correct text: four bytes, a sign that correct text has not got there, or several in a
    row; beside such a span in the same encoding, or where ``known`` has it, the doubtful ones count too. Letters alone (many Russian
    words in cp866) never do."""
    parts = [(m.start(), x) for m in _SIGNS.finditer(text) for x in _utf8_parts(m.group())]
    sure = {x[3] for _, x in parts if x[4]} | known
    found = [(at + x[0], at + x[1], x[2], x[3]) for at, x in parts if x[3] in sure]
    return [(a, b, good, f"utf-8>{wrong}") for a, b, good, wrong in sorted(found, key=lambda x: WRONG_FOR_UTF8.index(x[3]))]


class Finder:
    """The automaton, with ``spans(text)`` -> [(start, end, restored text or None, pair)], not overlapping."""

    def __init__(self, vocabulary: dict[str, int]):
        self.auto = ahocorasick.Automaton()
        for g, words in word_patterns(vocabulary).items():
            self.auto.add_word(g, (len(g), "w", words, ""))
        for g, (c, pair) in utf8_patterns().items():
            self.auto.add_word(g, (len(g), "u", c, pair))
        singles = single_signs()
        for g in {*singles, *LATIN, *CYRILLIC, *(chr(c) for c in range(0x370, 0x400)), *(chr(c) for c in range(0x2500, 0x25A0)), *map(chr, range(0x80, 0xA0)), "�"}:
            if g not in self.auto:
                self.auto.add_word(g, (1, "c", singles.get(g), "one-byte"))
        self.auto.make_automaton()

    @staticmethod
    def _proof(text: str, i: int) -> bool:
        """Whether the single character at ``i`` is proof between its neighbours."""
        c = text[i]
        o = ord(c)
        if c == "�" or 0x80 <= o < 0xA0:
            return True
        n = len(text)
        a, b = text[i - 1] if i else " ", text[i + 1] if i + 1 < n else " "
        a2, b2 = text[i - 2] if i > 1 else " ", text[i + 2] if i + 2 < n else " "
        latin = lambda x: x.isalpha() and ord(x) < 0x250 and x not in "µªº"
        if 0x2500 <= o < 0x25A0:
            return a.isalnum() or b.isalnum()
        if 0x370 <= o < 0x400 or c in CYRILLIC:
            # inside a word of other letters; at its start, or before capitals only, it may be a unit or a name
            return latin(a) and (latin(a2) or b.islower()) and latin(b) and not (a.isupper() or b.isupper())
        if c in LATIN:
            if c.isupper() and a.isascii() and a.islower():
                return b.isascii() and b.islower() or a2.islower() and not b.isalnum()
            if c in QUOTES and not a.isalnum():
                end = i + 1
                while end < n and text[end].isalpha():
                    end += 1
                return end > i + 2 and text[end - 1] == QUOTES[c]
            if c in "úÄÛ" and b.isdigit() and a.isspace():
                return True
            if c in "ûñÐÑ" and a.isspace() and b.isspace():
                return True
            return False
        return latin(a) and latin(b) and not (c == "·" and a in "lL" and b in "lL")

    @staticmethod
    def _word(text: str, start: int, end: int, words: list[tuple[str, str, bool]]) -> tuple | None:
        """The word a form is garbled from, as a value of the automaton; null if it is no garbled form here."""
        form = text[start:end]
        if not form.isalpha():
            return (end - start, "w", *words[0][:2])
        langs = languages_beside(text, start, end)
        weak = None
        name = form[0].isupper() and not form.isupper() and _natural(form)
        for word, pair, by_count in words:
            told = is_garbled(form, word, by_count, *langs)
            told = None if told and name else told
            if told:
                return (end - start, "w", word, pair)
            if told is None and weak is None:
                weak = (end - start, "weak", word, pair)
        return weak

    def spans(self, text: str, rare: dict[str, list] | None = None) -> list[tuple[int, int, str | None, str]]:
        """``rare``: forms in the text beyond the automaton's."""
        out: list[tuple[int, int, str | None, str]] = []
        best: dict[int, tuple] = {}
        for form, words in (rare or {}).items():
            for m in re.finditer(re.escape(form), text):
                start, end = m.span()
                if not (start and text[start - 1].isalpha() or end < len(text) and text[end].isalpha()):
                    value = self._word(text, start, end, words)
                    if value and (start not in best or best[start][0] < value[0]):
                        best[start] = value
        for end, value in self.auto.iter(text):
            start = end + 1 - value[0]
            if value[1] == "w" and (start and text[start - 1].isalpha() or end + 1 < len(text) and text[end + 1].isalpha()):
                continue
            if value[1] == "w" and (value := self._word(text, start, end + 1, value[2])) is None:
                continue
            if value[1] == "c" and not self._proof(text, start):
                continue
            if start not in best or best[start][0] < value[0]:
                best[start] = value
        known = {v[3].removeprefix("utf-8>") for v in best.values() if v[1] == "u"}
        for start, end, c, pair in utf8_runs(text, known):
            if sum(v[0] for s, v in best.items() if start <= s < end and v[1] == "u") >= end - start:
                continue  # patterns cover it
            if start not in best or best[start][0] < end - start:
                best[start] = (end - start, "u", c, pair)
        # a form that only its rarity speaks against needs another damaged place, or form, beside it
        weak = {(text[s : s + v[0]], v[3]) for s, v in best.items() if v[1] == "weak"}
        pairs = [pair for _, pair in weak]
        alone = all(v[1] == "weak" for v in best.values())
        last = 0
        for start in sorted(best):
            length, kind, c, pair = best[start]
            if kind == "weak" and alone and pairs.count(pair) < 2:
                continue
            if start >= last:
                out.append((start, start + length, c, pair))
                last = start + length
        return out

    def restore(self, text: str, rare: dict[str, list] | None = None) -> tuple[str, bool, int, str]:
        """(text with matched spans replaced, all could be, number of spans, most frequent pair); text
        garbled several times over is taken through up to ``ROUNDS`` rounds."""
        out = self._restore(text, self.spans(text, rare))
        for _ in range(ROUNDS - 1):
            more = [x for x in self.spans(out[0]) if x[3].startswith("utf-8")]
            if not more:
                break
            out = (self._restore(out[0], more)[0], *out[1:])
        return out

    def _restore(self, text: str, spans: list) -> tuple[str, bool, int, str]:
        parts, at, whole, pairs = [], 0, True, {}
        words = [s for s in spans if s[3] != "one-byte"]
        for _, _, _, pair in words:
            pairs[pair] = pairs.get(pair, 0) + 1
        main = max(sorted(pairs), key=pairs.get) if pairs else ""
        for start, end, c, pair in spans:
            if pair == "one-byte":
                c = self._by_pair(text[start:end], main) or c
            whole &= c is not None
            parts += [text[at:start], c if c is not None else text[start:end]]
            at = end
        return "".join([*parts, text[at:]]), whole, len(spans), main or ("one-byte" if spans else "")

    @staticmethod
    def _by_pair(s: str, pair: str) -> str | None:
        true, _, wrong = pair.partition(">")
        if not wrong or true == "utf-8":
            true, wrong = ("cp1252", "latin-1") if all(0x80 <= ord(c) < 0xA0 for c in s) else ("", "")
        try:
            return s.encode(wrong).decode(true) if wrong else None
        except (UnicodeError, LookupError):
            return None


@lru_cache(maxsize=2)
def _finder(vocabulary: tuple[tuple[str, int], ...]) -> Finder:
    return Finder(dict(vocabulary))


def _word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(w, count): words with letters outside ASCII that occur at least ``MIN_RECORDS`` times, and the number
    of distinct texts they are in."""
    odd = df.where(F.col(text_col).rlike("[^\\x00-\\x7F]")).select(F.col(text_col).alias("t"))
    words = odd.select(F.xxhash64("t").alias("h"), F.explode(F.expr("regexp_extract_all(t, '\\\\p{L}*[\\\\p{L}&&[^\\\\x00-\\\\x7F]]\\\\p{L}*', 0)")).alias("w"))
    texts = words.where("length(w) between 2 and 30").groupBy("h", "w").count()
    counts = texts.groupBy("w").agg(F.count("*").alias("count"), F.sum("count").alias("all"))
    return counts.where(F.col("all") >= MIN_RECORDS).select("w", "count")


def vocabulary(df: DataFrame, text_col: str) -> tuple[tuple[str, int], ...]:
    """The most frequent words with letters outside ASCII and the number of distinct texts they are in, over
    all rows: the part that is sent to every task. The garbled forms of all others are ``rare_forms``."""
    rows = _word_counts(df, text_col).orderBy(F.desc("count"), "w").limit(int(1 / VOCABULARY_SHARE)).collect()
    return tuple((r["w"], r["count"]) for r in rows)


def _tokens(text: str) -> set[str]:
    """What may be a garbled word in a text: the parts of runs of letters and signs that no letter adjoins."""
    out = set()
    for run in _RUNS.findall(text):
        if run.isascii():
            continue
        at = [i for i in range(len(run) + 1) if i in (0, len(run)) or not (run[i - 1].isalpha() and run[i].isalpha())]
        starts = [i for i in at if i == 0 or not run[i - 1].isalpha()]
        ends = [i for i in at if i == len(run) or not run[i].isalpha()]
        out.update(run[i:j] for i in starts for j in ends if 2 <= j - i <= 30 and not run[i:j].isascii())
    return out


def rare_forms(df: DataFrame, text_col: str, words: tuple[tuple[str, int], ...]) -> DataFrame | None:
    """(h, rare): for the texts, by their hash, that have garbled forms of words beyond ``words``: these forms
    as (form, word, pair, n_form, n_word). Found by a shuffled join; null if there are no such words."""
    if len(words) < int(1 / VOCABULARY_SHARE):
        return None
    counts = _word_counts(df, text_col)
    top = df.sparkSession.createDataFrame(pa.table({"w": [w for w, _ in words]}).to_pandas())

    def garbled(batches):
        known = _known()
        for b in batches:
            rows = [(g, w, pair, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if not _garbled_itself(w, known) for g, pair in garbled_forms(w)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["form", "word", "pair", "n_word"])

    def tokens(batches):
        for b in batches:
            rows = [(h, g) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for g in _tokens(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 2, (pa.int64(), pa.string()))], ["h", "form"])

    rest = counts.join(top, "w", "left_anti").mapInArrow(garbled, "form string, word string, pair string, n_word long")
    odd = df.where(F.col(text_col).rlike("[^\\x00-\\x7F]")).select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    seen = odd.mapInArrow(tokens, "h long, form string").distinct()
    own = counts.select(F.col("w").alias("form"), F.col("count").alias("n_form"))
    hits = seen.join(rest.hint("merge"), "form").join(own, "form", "left").fillna(0, ["n_form"])
    return hits.groupBy("h").agg(F.array_sort(F.collect_set(F.struct("form", "word", "pair", "n_form", "n_word"))).alias("rare"))


def _with_rare(df: DataFrame, text_col: str, rare: DataFrame | None) -> DataFrame:
    """``df`` with the rare garbled forms of each text as a last column."""
    if rare is None:
        return df.withColumn(RARE, F.lit(None).cast("array<struct<form:string,word:string,pair:string,n_form:bigint,n_word:bigint>>"))
    return df.join(rare.withColumnRenamed("rare", RARE), F.xxhash64(text_col) == F.col("h"), "left").drop("h")


def _forms(rare: list[dict] | None) -> dict[str, list[tuple[str, str, bool]]]:
    """As ``word_patterns``."""
    out: dict[str, list[tuple[str, str, bool]]] = {}
    for x in sorted(rare or (), key=lambda x: (-x["n_word"], x["word"])):
        if x["n_word"] * CLEARLY_MORE <= x["n_form"]:
            continue
        out.setdefault(x["form"], []).append((x["word"], x["pair"], x["n_form"] * CLEARLY_MORE <= x["n_word"]))
    return out


def find(df: DataFrame, text_col: str, words: tuple[tuple[str, int], ...] | None = None) -> DataFrame:
    """The rows of ``df`` whose text is garbled, with ``restored``, ``restorable``, ``n_spans``, ``pair``
    (columns of those names in ``df`` are replaced). Pure ASCII texts never leave the JVM."""
    rare = None
    if words is None:
        words = vocabulary(df, text_col)
        rare = rare_forms(df, text_col, words)
    keep = [c for c in df.columns if c not in ("restored", "restorable", "n_spans", "pair")]
    odd = df.where(F.col(text_col).rlike("[^\\x00-\\x7F]")).select(*keep)
    bound = df.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        finder = _finder(bound.value)
        for b in batches:
            texts = b.column(keep.index(text_col)).to_pylist()
            forms = map(_forms, b.column(len(keep)).to_pylist())
            found = [(i, *finder.restore(t, x)) for i, (t, x) in enumerate(zip(texts, forms)) if finder.spans(t, x)]
            kept = b.select(keep).take(pa.array([x[0] for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    *kept.columns,
                    pa.array([x[1] for x in found], pa.string()),
                    pa.array([x[2] for x in found], pa.bool_()),
                    pa.array([x[3] for x in found], pa.int32()),
                    pa.array([x[4] for x in found], pa.string()),
                ],
                [*keep, "restored", "restorable", "n_spans", "pair"],
            )

    from pyspark.sql import types as T

    schema = T.StructType(
        [
            *odd.schema.fields,
            T.StructField("restored", T.StringType()),
            T.StructField("restorable", T.BooleanType()),
            T.StructField("n_spans", T.IntegerType()),
            T.StructField("pair", T.StringType()),
        ]
    )
    return _with_rare(odd, text_col, rare).mapInArrow(run, schema)


def without_garbled(df: DataFrame, text_col: str, words: tuple[tuple[str, int], ...], needed: str, rare: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` whose text is no case and whose column ``needed`` is not null, without the text.
    Both are tested in the Python stage, so that what ``needed`` costs is spent once."""
    from pyspark.sql import types as T

    bound = df.sparkSession.sparkContext.broadcast(words)
    keep = [i for i, c in enumerate(df.columns) if c != text_col]
    text, need = df.columns.index(text_col), df.columns.index(needed)

    def run(batches):
        finder = _finder(bound.value)
        for b in batches:
            b = b.filter(b.column(need).is_valid())
            texts = b.column(text).to_pylist()
            forms = map(_forms, b.column(b.num_columns - 1).to_pylist())
            yield b.filter(pa.array([not t or t.isascii() or not finder.spans(t, x) for t, x in zip(texts, forms)], pa.bool_())).select(keep)

    return _with_rare(df, text_col, rare).mapInArrow(run, T.StructType([df.schema.fields[i] for i in keep]))


def restored_texts(texts: list[str | None], words: tuple[tuple[str, int], ...]) -> list[str | None]:
    """For other operators' Python stages: texts with the garbled spans restored."""
    finder = _finder(words)
    return [finder.restore(t)[0] if t and not t.isascii() else t for t in texts]
