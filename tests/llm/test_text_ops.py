"""Garbled text, languages, tokenizer, leaks, abuse."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import abuse, languages, leaks, mojibake, tokenizer

VOCAB = (("für", 300), ("más", 300), ("était", 300), ("się", 300), ("привет", 300), ("größer", 300), ("café", 300), ("şimdi", 100))


@pytest.mark.parametrize("true, wrong", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1250"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp850")])
def test_garbled_is_found_and_restored(true, wrong):
    f = mojibake.Finder(dict(VOCAB))
    text = "We ate at a café and für 3 Stunden größer, the end"
    bad = text.encode(true).decode(wrong)
    assert f.spans(bad) and f.restore(bad)[0] == text
    half = text + " -- " + bad
    assert f.restore(half)[0] == text + " -- " + text


def test_several_rounds_and_lost_bytes():
    f = mojibake.Finder(dict(VOCAB))
    twice = "café – déjà".encode().decode("cp1252").encode().decode("cp1252")
    assert f.restore(twice)[:2] == ("café – déjà", True)
    lost = "caf��".strip()
    assert f.restore(lost)[1] is False


@pytest.mark.parametrize("text", ["", "plain", "SÃO Paulo, ÀÉÎ", "für 34€ · 20° – “ok”… don’t", "¯\\_(ツ)_/¯ ½ → ★", "日本語です नमस्ते", "Рёбра и Ёж", "naïve Velïrmora Haleiførd", "10 µs £5 m³ x²"])
def test_correct_text_is_no_case(text):
    assert mojibake.Finder(dict(VOCAB)).spans(text) == []


def test_find_on_a_table(spark):
    rows = [("a", "cafÃ© here", 1), ("b", "fine", 2), ("c", None, 3), ("d", "", 4), ("e", "naïve", 5), ("a", "cafÃ© here", 1), ("f", "x " * 40000 + "Ã©", 6)]
    df = spark.createDataFrame(rows, "id string, text string, pair int")
    got = mojibake.find(df, "text").collect()
    assert sorted(r["id"] for r in got) == ["a", "a", "f"]
    assert got[0]["restored"].startswith("café") or got[0]["id"] == "f"
    assert mojibake.find(df.limit(0), "text").count() == 0
    kept = mojibake.without_garbled(df.select("id", "text", F.length("text").alias("n")), "text", (), "n")
    assert kept.columns == ["id", "n"] and sorted(r["id"] for r in kept.collect()) == ["b", "d", "e"]


SAMPLES = {
    "en": ["The camera is far better than the trailer made it look", "I never thought that this game would keep me busy for weeks", "They should have tested the second act before launch"],
    "de": ["Die Kamera ist leider nicht so gut wie erwartet", "Ich habe das Spiel mit guten Freunden gespielt und gelacht", "Der letzte Abschnitt war für mich einfach zu schwer"],
    "fr": ["La caméra est vraiment très réussie dans ce jeu", "Je ne pensais pas que ce jeu serait aussi long", "Le dernier chapitre est beaucoup trop difficile pour moi"],
    "ru": ["Камера в этой игре работает очень плохо у меня", "Я не думал что эта игра будет такой длинной", "Последний уровень слишком трудный для новичков в игре"],
}


def test_languages():
    model = languages.fit(languages.with_lost([(s, k) for k, v in SAMPLES.items() for s in v for _ in range(8)]))
    mixed = "The second act is far better than the first one. Der letzte Abschnitt ist leider nicht so gut für mich."
    got = languages.texts_languages([mixed, "", "Too short.", "Я не думал что уровень такой трудный в игре."], model)
    assert {x[0] for x in got[0]} == {"en", "de"} and got[1] == [] and got[2] == [] and [x[0] for x in got[3]] == ["ru"]
    assert all(0 < c <= 1 for x in got for _, c, _ in x)
    lost = [languages.with_lost_letters(s, 2) for s in ("Последний этап слишком долгий но камера хорошая очень", "La seconde étape était très réussie")]
    assert [x[0] for x in languages.whole_language([*lost, "...", ""], model)] == ["ru", "fr", "und", "und"]


def test_language_cases(spark):
    en = "The second act is far better than the first one. They should have tested it before."
    rows = [("a", en), ("b", en), ("c", en), ("d", en), ("e", None), ("f", ""), ("g", "short one"), ("a", en)]
    labels = [("a", "en-GB"), ("b", "de"), ("c", "und"), ("d", None), ("a", "EN")]
    texts = spark.createDataFrame(rows, "id string, text string")
    lab = spark.createDataFrame(labels, "id string, lang string").select("id", languages.label_code(F.col("lang")).alias("lang")).where("lang is not null")
    model = languages.fit([(s, k) for k, v in SAMPLES.items() for s in v])
    found = languages.languages(texts.where("text is not null"), model, VOCAB)
    got = sorted((r["id"], r["lang"], r["reason"]) for r in languages.cases(found, lab).collect())
    whole = {r["id"]: r["whole"] for r in found.collect()}
    assert whole["a"] is None and whole["f"]["lang"] == "und" and whole["g"]["segments"] == 0 and whole["g"]["lang"] == "en"
    assert got == [("b", "en", "wrong label"), ("c", "en", "no label"), ("d", "en", "no label")]
    assert languages.cases(found.limit(0), lab).count() == 0


def test_label_notations(spark):
    names = ["en", "EN", "eng", "english", "en-GB", "de-AT", "fr_CA", "und", "", "??", None, "sv"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i")
    assert [r[0] for r in df.select(languages.label_code(F.col("n"))).collect()] == ["en"] * 5 + ["de", "fr", None, None, None, None, "sv"]


def test_stitching_equals_the_whole():
    enc = tokenizer.encoding(open(tokenizer.RANKS, "rb").read())
    rng = random.Random(0)
    for _ in range(600):
        chunk, over = rng.choice([7, 20, 50]), rng.choice([3, 8, 20])
        alphabet = rng.choice(["ab '", " \n\tab1.", "aaaaaaaaa b'sé中 ", "x", "'stmdrevl a", "'\xa0 \xa0ll're\n!1", "\U00011de0\u0558a 'l"])
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(3)]
        assert tokenizer.Encoder(enc, chunk, over)(texts) == [enc.encode_ordinary(t) for t in texts]


def test_runs_longer_than_the_overlap():
    enc = tokenizer.encoding(open(tokenizer.RANKS, "rb").read())
    texts = ["x" * 5000 + " end", "\n" * 700 + "a", "a " * 900 + "!" * 1300 + "'s", "word 's " * 400]
    assert tokenizer.Encoder(enc, 100, 10)(texts) == [enc.encode_ordinary(t) for t in texts]


def test_token_ids(spark):
    enc = tokenizer.encoding(open(tokenizer.RANKS, "rb").read())
    long = "word été 中文\n" * 400
    rows = [(1, "Hello world<|endoftext|>"), (2, ""), (3, None), (4, long), (5, "x" * 3000), (4, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(7))
    got = sorted((r["doc_id"], list(r["ids"])) for r in tokenizer.token_ids(df, chunk=100).collect())
    assert got == sorted((i, enc.encode_ordinary(t or "")) for i, t in rows)
    back = tokenizer.decoded(tokenizer.token_ids(df, chunk=100)).collect()
    assert sorted((r["doc_id"], r["decoded"]) for r in back) == sorted((i, t or "") for i, t in rows)
    assert tokenizer.token_ids(df.limit(0)).count() == 0


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"wo{i}rd" for i in range(300)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([10, 30, 60])))) for k in range(20)] + [(99, None)]
    docs = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        k, t = rng.choice(items[:20])
        part = t.split()[rng.randint(0, 10) :][: rng.choice([5, 14, 15, 25])]
        if d % 5 == 0 and len(part) > 8:
            part[7] = "changed"
        docs.append((d, "; ".join(w[:20] + part + w[20:]).upper()))
    docs += [(100, None), (101, ""), docs[0], (102, "pad " * 300_000 + items[1][1])]
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = set()
    for d, t in docs:
        have = " " + " ".join(norm(t)) + " "
        for k, it in items:
            w = norm(it)
            if any(" " + " ".join(w[i : i + 15]) + " " in have for i in range(len(w) - 14)):
                want.add((d, k))
    out = leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = [(r["doc_id"], r["item_id"]) for r in out.where("exact").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def test_edited_passages_are_kept(spark):
    item = "the honest tower of the old harbour has twenty six floors and a small blueprint of great value inside"
    edited = item.replace("honest", "hones").replace("floors", "floor").replace("value", "values")
    out = leaks.leaked(spark.createDataFrame([(1, "before " + edited + " after")], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["exact"]) for r in out] == [(1, 7, False)]


WORDS = (("the", 100), ("you", 90), ("such", 50), ("are", 60), ("tower", 40), ("level", 40), ("and", 90))


MODEL = abuse.CharModel({g: n for g, n in abuse.word_grams({w: 10.0 for w, _ in WORDS} | {w: 10.0 for w in abuse._known_words()}).items()}, {w for w, _ in WORDS} | abuse._known_words())
UNRATED = abuse.fit([], [], [])


@pytest.mark.parametrize(
    "text, bad",
    [
        ("", False), (None, False), ("You are an idiot, get lost", True), ("y0u 1d10t, get l0st", True), ("you m o r o n", True), ("You iiiidiot", True),
        ("du bist ein Vollidiot", True), ("ты тупой урод", True), ("This is a fine game, I played it for 20 hours", False), ("I am an idiot, I forgot to save", False),
        ("v1.0.3 runs at 60fps, 3rd patch", False), ("you 1d**t", True),
    ],
)
def test_disguised_words_are_read_and_scored_by_the_prior(text, bad):
    assert (abuse.scores([text], MODEL, UNRATED)[0] >= abuse.THRESHOLD) is np.bool_(bad)


def test_a_reading_needs_no_listed_word():
    assert "zorbling" not in MODEL.words and abuse.restore("the z0rbl1ng is here", MODEL) == "the zorbling is here"
    assert abuse.restore("plain words, 1999 and 3rd", MODEL) == "plain words, 1999 and 3rd"


def rated_documents(n, rng):
    docs = []
    for i in range(n):
        bad = i % 4 == 0
        s = [" ".join(rng.choice(["map", "sound", "level", "boss", "patch", "story", "is", "was", "good", "slow", "long"]) for _ in range(rng.randint(4, 14))) for _ in range(5)]
        if bad:
            s[rng.randrange(5)] = f"may your {rng.choice(['house', 'car', 'cat', 'dog'])} rot in a swamp {rng.choice(['soon', 'today', 'friend'])}"
        docs.append((s, bad))
    return docs


def test_the_fit_learns_what_no_list_has():
    rng = random.Random(5)
    docs = rated_documents(400, rng)
    said = [bad ^ (rng.random() < 0.05) for _, bad in docs]  # raters err
    fitted = abuse.fit([s for s, _ in docs], [int(x) for x in said], [int(not x) for x in said])
    held = rated_documents(400, rng)
    got = abuse.scores([". ".join(s) for s, _ in held], MODEL, fitted) >= abuse.THRESHOLD
    want = np.array([bad for _, bad in held])
    assert (got & want).sum() >= 0.9 * want.sum() and (got & ~want).sum() <= 3


def test_abuse_on_a_table(spark):
    rows = [(1, "You idiot, get lost", 0.1), (2, None, 0.2), (3, "", 0.3), (1, "You idiot, get lost", 0.1), (4, "fine game " * 5000, 0.4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, rater string, abusive int")
    got = sorted((r["doc_id"], r["score"] >= abuse.THRESHOLD, r["score"] == 0) for r in abuse.scored(df, none).collect())
    assert got == [(1, True, False), (1, True, False), (2, False, True), (3, False, True), (4, False, False)]
    labels = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "b", None), (4, "a", 0), (9, "a", 1), (2, "a", 0)], "doc_id long, rater string, abusive int")
    assert abuse.rated(df.where("doc_id < 4"), labels, "doc_id", "text") == [("You idiot, get lost", 1, 0)]
    assert [r["score"] >= abuse.THRESHOLD for r in abuse.scored(df, labels).where("doc_id = 1").collect()] == [True, True]
    assert abuse.scored(df.limit(0), labels).count() == 0


def test_copies_of_a_garbled_word_do_not_make_it_correct(spark):
    good = [(f"g{i}", f"Bu oyunda {i} kale ve yakınında bir köy var") for i in range(77)]
    bad = "Kalenin yakýnýnda bir orman ve bir nehir daha"
    df = spark.createDataFrame([*good, *((f"b{i}", bad) for i in range(40))], "id string, text string")
    assert dict(mojibake.vocabulary(df, "text"))["yakýnýnda"] == 1
    got = mojibake.find(df, "text").collect()
    assert sorted(r["id"] for r in got) == sorted(f"b{i}" for i in range(40)) and "yakınında" in got[0]["restored"]
    # not by the ratio either, when every text is another, and not the other way round
    f = mojibake.Finder({"yakınında": 77, "yakýnýnda": 500})
    assert f.spans(bad) and not f.spans(good[0][1]) and not f.spans("To je na mapě yakýnýnda ale hra se mi líbí")


def test_words_beyond_the_broadcast_vocabulary(spark, monkeypatch):
    rows = [(f"a{i}", f"senin için {i} oyun") for i in range(20)] + [(f"b{i}", f"{i} kale yakınında") for i in range(6)]
    bad = "bu oyunda bir kale yakýnýnda, daha ne"
    rows += [("x", bad), ("x", bad), ("y", "plain"), ("z", None)]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("n", F.length("text"))
    every = sorted((r["id"], r["restored"]) for r in mojibake.find(df, "text").collect())
    monkeypatch.setattr(mojibake, "VOCABULARY_SHARE", 1)
    words = mojibake.vocabulary(df, "text")
    assert [w for w, _ in words] == ["için"] and mojibake.find(df, "text", words).count() == 0
    got = sorted((r["id"], r["restored"]) for r in mojibake.find(df, "text").collect())
    assert got == every == [("x", "bu oyunda bir kale yakınında, daha ne")] * 2
    kept = mojibake.without_garbled(df, "text", words, "n", mojibake.rare_forms(df, "text", words))
    assert sorted(r["id"] for r in kept.collect()) == sorted(r[0] for r in rows if r[0] not in "xz")


@pytest.mark.parametrize("good", ["great game \U0001f480 really", "nice \U0001f9d9‍♂️ one", "Αυτό είναι ένα παιχνίδι", "это 日本語の良いゲーム", "لعبة جيدة جدا", "좋은 게임", "משחק טוב"])
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "cp437"])
def test_any_character_in_a_wrong_encoding(good, wrong):
    bad = mojibake._decode(good.encode(), wrong)
    f = mojibake.Finder(dict(VOCAB))
    assert f.spans(bad) and f.restore(bad)[0] == good and not f.spans(good)


@pytest.mark.parametrize("text", ["voilà\xa0»… été\xa0» «\xa0olé\xa0»", "её…» «О» Я… всё»", "„Äußerung“ „Öl“ ¡olé!¿", "так рад, ЁРШИ и ура", "nejhezčí příště — ěšť", "część ężą „ęź”…", "3 €/Std. Größe ±5 °C", "naïve “café”…"])
def test_correct_text_has_no_utf8_runs(text):
    assert mojibake.utf8_runs(text) == []


def test_long_disguises_and_signs_for_any_letter():
    words = {"idiot", "duck", "deck", "you", "are"}
    model = abuse.CharModel(abuse.word_grams({w: 10.0 for w in words}), words)
    for token in ("id" + "i" * 60 + "ot", "i" * 50 + "d1ot"):
        assert abuse.scores([f"you are an {token}"], MODEL, UNRATED)[0] >= abuse.THRESHOLD
    assert abuse.decode("i" + "*" * 2 + "ot", model)[0] == "idiot"
    # every reading of a short token, one by one
    reads = [[r for r, _ in x] for x, _ in abuse.lattice("d**k")]
    known = [t for t in map("".join, itertools.product(*reads)) if t in words]
    assert abuse.decode("d**k", model)[0] == min(known, key=lambda t: (round(model.of(t), 9), t))
    assert abuse.decode("x" + "*" * 200 + "x", model)[0] == "x" + "*" * 200 + "x"


def test_short_segments_have_their_language(spark):
    """A segment below six words in another language than the rest gives p7_languages a row; p7_found does not ask for it."""
    model = languages.fit([(s, k) for k, v in SAMPLES.items() for s in v for _ in range(8)])
    en = "The second act is far better than the first one."
    rows = [("a", en + " Камера работает плохо."), ("b", en + " The camera is better."), ("c", "The camera is better. Камера работает очень плохо!"), ("d", "..."), ("e", ""), ("f", en + " ... 7!")]
    found = {r["id"]: r for r in languages.languages(spark.createDataFrame(rows, "id string, text string"), model, VOCAB).collect()}
    assert [x["lang"] for x in found["a"]["langs"]] == ["en"] and [(x["lang"], x["segments"]) for x in found["a"]["short"]] == [("ru", 0)]
    assert {found["c"]["whole"]["lang"], *(x["lang"] for x in found["c"]["short"])} == {"en", "ru"}
    assert all(found[k]["short"] == [] for k in "bdef")
