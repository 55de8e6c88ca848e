"""Problem 10: abusive, hateful and sexual content.

Noisy-channel deobfuscation, then a fitted scorer:

1. A text is folded (compatibility forms, letter case, invisible characters); what then looks disguised -
   letters with digits or signs inside, a letter repeated three times or more, single letters with the same
   gap between them - becomes a character lattice: a digit or sign may be one of the letters it imitates,
   nothing, or itself, a repetition one or two letters, a gap nothing or a space. A Viterbi search over all
   states finds the likeliest reading under a character model (interpolated n-grams, counted over all words
   of the collection); the reading stands where it is likelier than the signs as they are. No word list
   decides that; only a sign for any letter (a star) has to go on a frequent word or one of the lexicon.
2. Each sentence of the restored text is scored by a logistic model on its words, word pairs (also with one
   word between) and a few features of a lexicon. The model is fitted on the ratings: a rated document is
   abusive if at least one of its sentences is (noisy-or), a rating errs with probability ``ERRS``. The
   lexicon enters only as features with a prior weight, from which few ratings move little and many much.

The fit takes at most ``PER_CLASS`` documents of either rating, by a hash of their id, of at most
``LONGEST`` characters (its documented bound); everything else covers all rows and whole texts.

Score: 0 to 1, that of the likeliest sentence; abusive from ``THRESHOLD``. Defined cases: null and empty texts
score 0; null ratings do not count and equal ones of one rater count once; without ratings the prior
weights hold; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import cut

THRESHOLD = 0.5
ORDER = 5
VOCABULARY = 20_000
MIN_RECORDS = 3
GRAMS = 400_000
PER_CLASS = 2000
LONGEST = 20_000
ERRS = 0.05
DIM = 1 << 18
RIDGE = 1.0
STEPS = 60
WINDOW = 12
MIN_DOCS = 3
FOLDS = 4
DOUBT = 0.05
RATE = 0.1
PRIOR_RIDGE = 10

#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "?": "abcdefghijklmnopqrstuvwxyz",
    "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz", "%": "abcdefghijklmnopqrstuvwxyz", "_": "abcdefghijklmnopqrstuvwxyz",
}
#: Readings from which on a sign stands for any letter.
ANY = 26
#: Letters of other scripts that look like Latin ones.
LOOKALIKE = dict(zip("аеорсухіѕјԁɡαοєƨ", "aeopcyxisjdgaoes"))
GAPS = set(" .-_*~·|/\\+,'`")
INVISIBLE = re.compile("[­͏؜ᅟ᠎​-‏‪-‮⁠-⁤﻿︀-️]")

#: By language: insults and the words that aim them at someone; groups and what demeans them; sexual words
#: and what asks for them.
LEXICON = {
    "en": (
        "idiot idiots moron morons imbecile imbeciles cretin cretins dumbass asshole assholes arsehole bastard bastards scumbag scumbags degenerate bitch "
        "whore slut cunt fucker motherfucker retard faggot dickhead prick twat wanker jackass douchebag shithead dipshit halfwit dimwit loser losers "
        "clown scum vermin pig rat coward creep pervert shit",
        "you your u ur yourself whoever shut get go he she they",
        "foreigners immigrants migrants refugees women girls men jews muslims christians hindus believers atheists blacks gays lesbians gypsies disabled noobs",
        "vermin animals inferior subhuman subhumans parasites disease filth scum trash criminals rats pigs apes plague savages banned deported gassed locked cage",
        "nudes nude naked undressed boobs tits pussy porn horny moaning fuck lick cock topless",
        "send show give post me want you her him cam link",
    ),
    "de": (
        "vollidiot idiot drecksau arschloch wichser hurensohn missgeburt schlampe dummkopf schwachkopf trottel spast sau schwein abschaum mistkerl penner fotze hure nutte dreckskerl bastard fresse",
        "du dich dir dein deine ihr euch bist halt verpiss",
        "ausländer flüchtlinge juden frauen türken schwarze zigeuner moslems migranten behinderte",
        "abschaum ungeziefer verschwinden parasiten dreck untermenschen raus müll pack ratten vergasen",
        "nacktbilder nacktfotos nackt geile titten ficken blasen",
        "schick schicke zeig sende will",
    ),
    "fr": (
        "débile connard connarde salope enculé imbécile abruti pute gueule crétin ordure merde bâtard conne idiote pétasse",
        "tu toi te ta tes vous votre espèce ferme dégage",
        "étrangers immigrés femmes juifs arabes noirs musulmans migrants handicapés",
        "vermine dehors parasites ordures rats racaille déchets nuisibles",
        "nue nues nichons baiser seins chatte",
        "envoie envoyez montre photos photo veux",
    ),
    "es": (
        "imbécil idiota estúpido estúpida puta puto cabrón gilipollas mierda basura asco zorra maricón pendejo malparido escoria",
        "tú ti tu tus eres cállate vete pedazo das",
        "extranjeros inmigrantes mujeres judíos negros moros gitanos",
        "basura echarlos escoria ratas parásitos fuera plaga",
        "desnuda desnudo tetas caliente follar",
        "mándame envíame manda enséñame muéstrame fotos foto quiero",
    ),
    "pt": (
        "imbecil idiota burro otário vagabunda lixo merda puta viado cuzão babaca vadia nojo desgraçado arrombado",
        "você voce teu tua seu cala vai some",
        "estrangeiros imigrantes mulheres negros judeus ciganos",
        "lixo escória ratos parasitas praga expulsar expulsos fora",
        "pelada pelado nua gostosa peitos transar",
        "manda mande mostra envia foto fotos quero",
    ),
    "it": (
        "stronzo stronza idiota coglione imbecille puttana troia schifo bastardo cretino merda feccia deficiente",
        "sei tu ti tuo tua stai zitto fai vai sparisci",
        "stranieri immigrati donne ebrei negri zingari musulmani",
        "feccia parassiti spazzatura fuori ratti cacciarli cacciateli immondizia",
        "nuda nudo eccitato tette scopare",
        "mandami inviami mostrami foto voglio",
    ),
    "nl": (
        "idioot klootzak sukkel rat hoer eikel kutwijf trut stommeling mongool smeerlap bek rotzak",
        "je jij jou jouw bent hou houd",
        "buitenlanders vreemdelingen vrouwen joden moslims migranten",
        "ongedierte tuig parasieten uitschot ratten oprotten weg",
        "naaktfoto naaktfotos naakt naaktfoto's blote geil neuken tieten",
        "stuur foto fotos wil",
    ),
    "pl": (
        "kretynie kretyn idioto idiota debil debilu śmieciem śmieć suko kurwo kurwa dziwko chuju skurwysyn skurwysynu gnoju ścierwo bydlaku świnio",
        "ty ciebie cię tobą jesteś zamknij spadaj",
        "obcy cudzoziemcy imigranci kobiety żydzi cyganie uchodźcy",
        "robactwo wyrzucić szczury pasożyty śmieci bydło",
        "nagie nago naga nagą cycki ruchać napalony napalona",
        "wyślij pokaż przyślij zdjęcia zdjęcie fotki chcę",
    ),
    "ru": (
        "мразь урод идиот тварь шлюха сука ублюдок дебил кретин гнида придурок скотина мудак сволочь подонок дура дурак чмо",
        "ты тебя тебе тобой твой твоя заткнись вали иди",
        "приезжие мигранты бабы женщины иностранцы чужаки евреи",
        "хуже крыс гнать паразиты отбросы скот мусор твари",
        "голые голую голая сиськи трахнуть",
        "пришли скинь покажи фото хочу",
    ),
    "tr": (
        "pisliksin pislik aptal gerizekalı salak orospu şerefsiz piç kaşar dangalak ahmak",
        "sen seni sana senden senin kapa defol çeneni kes",
        "yabancılar göçmenler kadınlar mülteciler yahudiler",
        "haşere kovun parazit pislik defolsun kovulsun",
        "çıplak memelerini sikmek azdım",
        "gönder yolla göster fotoğraf foto",
    ),
}

#: Words that turn a sentence on oneself or into a report, in the language most of the texts have.
TURNED = set("i am i'm im myself reported report moderators moderation deleted filter called".split())

_SENTENCE = re.compile(r"(?<=[.!?…])\s+|[\r\n]+")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    t = INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).casefold()
    return unicodedata.normalize("NFC", t).replace("’", "'")


class CharModel:
    """Interpolated character n-grams over words with a space on either side, from ``grams``: n-gram ->
    count; ``words`` are those that a sign for any letter may go on."""

    def __init__(self, grams: dict[str, float], words: set[str], order: int = ORDER):
        self.order = order
        self.n: dict[str, dict[str, float]] = defaultdict(dict)
        for g, c in grams.items():
            self.n[g[:-1]][g[-1]] = c
        self.words = words
        self.prefixes = {w[:i] for w in words for i in range(1, len(w) + 1)}
        self.total = {h: sum(x.values()) for h, x in self.n.items()}
        self.cost = lru_cache(maxsize=500_000)(self._cost)

    def _cost(self, history: str, c: str) -> float:
        p = 1 / 2000
        for k in range(0, self.order):
            h = history[len(history) - k :] if k else ""
            x = self.n.get(h)
            if x is None:
                break
            types = len(x)
            p = (x.get(c, 0.0) + types * p) / (self.total[h] + types)
        return -math.log(p)

    def of(self, text: str) -> float:
        """Cost of a text as it is, between spaces."""
        s = f" {text} "
        return sum(self.cost(s[max(0, i - self.order + 1) : i], s[i]) for i in range(1, len(s)))


def word_grams(words: dict[str, float], order: int = ORDER) -> Counter:
    """n-gram -> weight of words with a space on either side."""
    out: Counter = Counter()
    for w, c in words.items():
        s = f" {w} "
        for i in range(1, len(s)):
            for k in range(min(order, i + 1)):
                out[s[i - k : i + 1]] += c
    return out


def lattice(token: str) -> list[tuple[list[tuple[str, float]], bool]]:
    """Per position the readings with their channel cost, and whether it is a gap."""
    out = []
    i = 0
    while i < len(token):
        c = token[i]
        run = 1
        while i + run < len(token) and token[i + run] == c:
            run += 1
        c = LOOKALIKE.get(c, c) if token.isascii() is False and any("a" <= x <= "z" for x in token) else c
        if c.isalpha():
            if run >= 3:
                out.append(([(c, 0.2), (c + c, 0.5)], False))
            elif run == 2:
                out.append(([(c + c, 0.1), (c, 2.5)], False))
            else:
                out.append(([(c, 0.0)], False))
        else:
            for _ in range(1 if c in GAPS and c != "*" else run):
                reads = [(x, 0.7 if len(LEET[c]) < 4 else 2.0) for x in LEET.get(c, "")]
                if c in GAPS and c != "*":
                    reads += [("", 0.3), (" ", 4.0)]
                elif not reads:
                    reads = [(c, 6.0), ("", 6.0)]
                out.append((reads, c in GAPS))
        i += run
    return out


def decode(token: str, model: CharModel) -> tuple[str, float]:
    """Viterbi search for the likeliest reading and its cost, over all states: the last ``order - 1``
    characters and, in tokens with signs for any letter, the word begun, which such a sign has to go on and
    which has to be whole at the end. The token at infinite cost if there is none."""
    keep = model.order - 1
    nodes = lattice(token)
    some = any(len(reads) >= ANY for reads, _ in nodes)
    states: dict[tuple[str, str | None], tuple[float, tuple | None]] = {(" ", "" if some else None): (0.0, None)}
    for reads, _ in nodes:
        new: dict[tuple[str, str | None], tuple[float, tuple | None]] = {}
        for (h, word), (cost, text) in states.items():
            for r, extra in reads:
                c, hh, w = cost + extra, h, word
                if some and r.isalpha() and len(reads) >= ANY and (w is None or w + r not in model.prefixes):
                    continue
                for ch in r:
                    c += model.cost(hh, ch)
                    hh = (hh + ch)[-keep:]
                    if some:
                        w = "" if not (ch.isalnum()) else w + ch if w is not None and w + ch in model.prefixes else None
                if (hh, w) not in new or c < new[hh, w][0]:
                    new[hh, w] = (c, (text, r))
        states = new
    ends = [(c + model.cost(h, " "), t) for (h, w), (c, t) in states.items() if not w or w in model.words]
    if not ends:
        return token, math.inf
    least = min(c for c, _ in ends)
    return min(_joined(t) for c, t in ends if c == least), least


def _joined(text: tuple | None) -> str:
    parts = []
    while text:
        text, r = text
        parts.append(r)
    return "".join(reversed(parts))


_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]([ .\-_*~·|/,]{1,2}))(?:[^\W_]\1){2,}[^\W_](?![^\W_])")
_TOKEN = re.compile(r"[^\s\"“”„«»:;,()<>\[\]{}]*[^\W\d_][^\s\"“”„«»:;,()<>\[\]{}]*|[^\s]*[0-9@$!*][^\s]*")
_RUN3 = re.compile(r"([^\W\d_])\1\1")
_INSIDE = re.compile(r"[^\W\d_][0-9@$!*#%+|.\-_~]+[^\W\d_]|^[0-9@$!]{0,2}[0-9@$][^\W\d_]|[^\W\d_][0-9@$]+[^\W\d_]*[0-9@$]|[^\W\d_]{3}\*$")
_TAIL = re.compile(r"^[^\W\d_]+[0-9]+$")
_UNITS = re.compile(r"^\d[\d.,:%]+(?:[a-z]{1,3})?$|https?:|www\.|@.*\.|^\d+(?:st|nd|rd|th|x|h|km|px|fps|mb|gb)\b")
_PLAIN_NUMBER = re.compile(r"^[#v]?\d[\d.,:%]*(?:[a-z]{1,3})?$|^[a-z]{1,3}\d+$|https?:|www\.|@.*\.|^\d+(?:st|nd|rd|th|x|h|km|px|fps|mb|gb)\b")


def restore(text: str, model: CharModel) -> str:
    """Folded text with disguised parts replaced by their likeliest reading, one sentence a line."""
    folded = fold(text)

    def spaced(m):
        read, cost = decode(m.group(), model)
        return read if cost < model.of(m.group()) else m.group()

    return "\n".join(_restored(s, model) for s in _SENTENCE.split(_SPACED.sub(spaced, folded)))


def _restored(sentence: str, model: CharModel) -> str:
    if not _SUSPECT.search(sentence) and (sentence.isascii() or not _MIXED.search(sentence)):
        return sentence
    changed = 0

    def token(m, least=3):
        nonlocal changed
        w = m.group()
        core = w.strip(".!?…'_~-" if "*" in w and w[:1] != "*" else ".!?…'*_~-")
        short = least < 3 and len(core) <= 3 and any(c.isdigit() for c in core)
        if len(core) < least or not short and (_PLAIN_NUMBER if least > 1 else _UNITS).search(core):
            return w
        mixed = not core.isascii() and any("a" <= c <= "z" for c in core) and any(c in LOOKALIKE for c in core)
        if not (short or least < 3 and _TAIL.search(core) or _RUN3.search(core) or _INSIDE.search(core) or mixed):
            return w
        read, cost = decode(core, model)
        if read == core or cost >= model.of(core):
            return w
        changed += 1
        return w.replace(core, read, 1)

    out = _TOKEN.sub(token, sentence)
    # short words and single digits are read only beside a longer disguised word
    return _TOKEN.sub(lambda m: token(m, 1), out) if changed else out


_SUSPECT = re.compile(r"([^\W\d_])\1\1|[^\W\d_][0-9@$!*#%+|.\-_~]+[^\W\d_]|(?<!\S)[0-9@$!]{0,2}[0-9@$][^\W\d_]|[^\W\d_][0-9@$]|[^\W\d_]{3}\*")
_MIXED = re.compile("[a-z]+[%s]|[%s]+[a-z]" % (("".join(LOOKALIKE),) * 2))


# ---- scoring ---------------------------------------------------------------------------------------

_BIT = {}
for _k, _lists in enumerate(LEXICON.values()):
    for _j, _words in enumerate(_lists):
        for _w in _words.split():
            _BIT[_w] = _BIT.get(_w, 0) | 1 << (6 * _k + _j)
for _w in TURNED:
    _BIT[_w] = _BIT.get(_w, 0) | 1 << 60
#: Features of the lexicon and their prior weights; the last weight is every sentence's.
PRIOR = np.array([6.0, 6.5, 6.5, -1.5, -5.5])


@lru_cache(maxsize=500_000)
def _word(word: str) -> tuple[int, int]:
    return zlib.crc32((word if not word.isdigit() else "0").encode()), _BIT.get(word, 0)


class Sentences:
    """Hashed features of sentences: ``sentence`` and ``feature`` side by side, ``lexicon`` (sentence x
    PRIOR), ``n``."""

    def __init__(self, sentences: list[str]):
        words, parts = [], []
        for s in sentences:  # a long sentence is read in overlapping windows
            w = _WORD.findall(s)
            before = len(words)
            words += [w[i : i + WINDOW] for i in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2)]
            parts.append(len(words) - before)
        self.owner = np.repeat(np.arange(len(sentences)), parts)
        size = np.array([len(w) for w in words], np.int64)
        pairs = [_word(w) for x in words for w in x]
        h = np.array([p[0] for p in pairs], np.uint64)
        bits = np.array([p[1] for p in pairs], np.int64)
        owner = np.repeat(np.arange(len(words)), size)
        some, feature = [owner], [h]
        for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
            same = owner[gap:] == owner[:-gap]
            both = (h[:-gap] * np.uint64(salt)) ^ (h[gap:] * np.uint64(0x165667B19E3779F9))
            some.append(owner[gap:][same])
            feature.append((both ^ both >> np.uint64(31))[same])
        self.n, self.sentence = len(words), np.concatenate(some)
        self.feature = ((np.concatenate(feature) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)
        found = np.zeros(self.n, np.int64)
        full = np.flatnonzero(size)
        if len(full):
            found[full] = np.bitwise_or.reduceat(bits, (np.cumsum(size) - size)[full])
        has = (found[:, None] >> np.arange(61) & 1).astype(bool)
        kinds = has[:, :60].reshape(self.n, -1, 6) if self.n else has[:, :60].reshape(0, 10, 6)
        rules = [(kinds[:, :, a] & kinds[:, :, a + 1]).any(axis=1) for a in (0, 2, 4)]
        self.lexicon = np.stack([*rules, has[:, 60], np.ones(self.n, bool)], axis=1).astype(np.float64)

    def score(self, weights: np.ndarray, prior: np.ndarray) -> np.ndarray:
        z = np.bincount(self.sentence, weights=weights[self.feature], minlength=self.n) + self.lexicon @ prior
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: Sentences, owner: np.ndarray, yes: np.ndarray, no: np.ndarray, steps: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights from sentences of documents ``owner`` with ``yes`` and ``no`` ratings; 0 of both: not used."""
    used = (yes + no > 0)[owner]
    on = used[x.sentence]
    sentence, feature = x.sentence[on], x.feature[on]
    pairs = np.unique(feature * len(yes) + owner[sentence]) // len(yes)
    keys, times = np.unique(pairs, return_counts=True)
    keys = keys[times >= MIN_DOCS]
    known = np.zeros(DIM, bool)
    known[keys] = True
    on = known[feature]
    place = np.zeros(DIM, np.int64)
    place[keys] = np.arange(len(keys))
    sentence, feature = sentence[on], place[feature[on]]
    a, b = (1 - ERRS) ** yes * ERRS**no, ERRS**yes * (1 - ERRS) ** no
    w, v = np.zeros(len(keys)), PRIOR.copy()
    first, second = np.zeros(len(w) + len(v)), np.zeros(len(w) + len(v))
    for step in range(1, steps + 1):
        z = np.clip(np.bincount(sentence, weights=w[feature], minlength=x.n) + x.lexicon @ v, -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(-np.bincount(owner, weights=np.logaddexp(0, z), minlength=len(yes)))
        g = ((a - b) * none / (a * (1 - none) + b * none))[owner] * p * used
        grad = np.concatenate([np.bincount(feature, weights=g[sentence], minlength=len(w)) - ridge * w, x.lexicon.T @ g - ridge * PRIOR_RIDGE * (v - PRIOR)])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, v = w + move[: len(w)], v + move[len(w) :]
    weights = np.zeros(DIM)
    weights[keys] = w
    return weights, v


def fit(docs: list[list[str]], ones: list[int], zeros: list[int], steps: int = STEPS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """(weights of hashed features, weights of the lexicon's) from the sentences of rated documents and
    their numbers of ratings 1 and 0. Documents rated abusive in which a fit on the others sees nothing
    of it (``DOUBT``) are taken for mistakes of the rater and left out of the last fit."""
    if not docs:
        return np.zeros(DIM), PRIOR.copy()
    x = Sentences([s for d in docs for s in d])
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])[x.owner]
    yes, no = np.array(ones), np.array(zeros)
    fold = np.random.default_rng(0).integers(0, FOLDS, len(docs))
    seen = np.zeros(len(docs))
    for k in range(FOLDS):
        p = x.score(*_fit(x, owner, np.where(fold == k, 0, yes), np.where(fold == k, 0, no), steps, ridge))
        seen = np.where(fold == k, likeliest(p, owner, len(docs)), seen)
    doubt = (yes > no) & (yes - no < 2) & (seen < DOUBT)
    return _fit(x, owner, np.where(doubt, 0, yes), np.where(doubt, 0, no), steps, ridge)


def likeliest(p: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The highest score of each document's sentences, so that a text's length does not add up."""
    out = np.zeros(n)
    np.maximum.at(out, owner, p)
    return out


def scores(texts: list[str | None], model: CharModel, fitted: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Score of each text."""
    parts = [restore(t, model).split("\n") if t else [] for t in texts]
    x = Sentences([s for x in parts for s in x])
    p = x.score(*fitted)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in parts])[x.owner]
    return likeliest(p, owner, len(texts))


# ---- on tables -------------------------------------------------------------------------------------


def _known_words() -> set[str]:
    return {w for lists in LEXICON.values() for x in lists for w in x.split()}


def language_model(docs: DataFrame, text_col: str) -> tuple[dict[str, float], set[str]]:
    """(n-gram -> weight, words a sign for any letter may go on). The n-grams are counted over every word of
    letters only of all texts, a word weighing the root of its number; the ``GRAMS`` heaviest are kept. The
    words are the ``VOCABULARY`` most frequent; the lexicon's words are added to both."""
    words = F.explode(F.expr(f"regexp_extract_all(lower({text_col}), '\\\\p{{L}}+', 0)"))
    counts = cut(docs.where(F.col(text_col).isNotNull()).select(words.alias("w")).groupBy("w").count())

    def run(batches):
        total: Counter = Counter()
        for b in batches:
            own = {w: math.sqrt(c) for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if not _RUN3.search(w)}
            total.update(word_grams(own))
            if len(total) > 4 * GRAMS:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.float64())], ["g", "n"])
                total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64())], ["g", "n"])

    sums = counts.mapInArrow(run, "g string, n double").groupBy("g").agg(F.sum("n").alias("n"))
    grams = {r["g"]: r["n"] for r in sums.orderBy(F.desc("n"), "g").limit(GRAMS).toLocalIterator()}
    top = counts.where(F.col("count") >= MIN_RECORDS).orderBy(F.desc("count"), "w").limit(VOCABULARY).collect()
    least = math.sqrt(max((r["count"] for r in top), default=1)) / 4 + 1
    for g, n in word_grams({w: least for w in _known_words() - {r["w"] for r in top if r["count"] >= least**2}}).items():
        grams[g] = grams.get(g, 0.0) + n
    return grams, {r["w"] for r in top} | _known_words()


def rated(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_class: int = PER_CLASS) -> list[tuple[str, int, int]]:
    """(text, ratings 1, ratings 0) of at most ``per_class`` documents of either rating."""
    votes = labels.where(F.col("abusive").isin(0, 1)).select(F.col(id_col).alias("id"), "rater", "abusive").distinct()
    per = votes.groupBy("id").agg(F.sum("abusive").cast("int").alias("ones"), F.sum(1 - F.col("abusive")).cast("int").alias("zeros"))
    some = None
    for side in (F.col("ones") > F.col("zeros"), F.col("ones") <= F.col("zeros")):
        part = per.where(side).orderBy(F.xxhash64("id"), "id").limit(per_class)
        some = part if some is None else some.union(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.length("t").between(1, LONGEST))
    rows = texts.join(F.broadcast(some), "id").dropDuplicates(["id"]).orderBy("id").collect()
    return [(r["t"], r["ones"], r["zeros"]) for r in rows]


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row; ``labels(id_col, rater, abusive)`` are the ratings."""
    parts = language_model(docs, text_col)
    model = CharModel(*parts)
    sample = rated(docs, labels, id_col, text_col)
    weights, prior = fit([restore(t, model).split("\n") for t, _, _ in sample], [a for _, a, _ in sample], [b for _, _, b in sample])
    bound = docs.sparkSession.sparkContext.broadcast((parts, weights.astype(np.float32), prior))

    def run(batches):
        (grams, words), weights, prior = bound.value
        model = CharModel(grams, words)
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(part.column(1).to_pylist(), model, (weights, prior)), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    out = T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)
