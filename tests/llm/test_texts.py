import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from darkslide.llm.damage import damaged
from darkslide.llm.edit_search import EditSearch, edit_distances
from darkslide.llm.leaks import FOUND, NEAR, near_windows
from darkslide.llm.mojibake import CLASSES, Pairs, pairs, repair
from darkslide.llm.tokens import VOCABULARY, round_trip, token_ids
from darkslide.llm.transducer import Transducer, Utf8Stream, read_ranks
from darkslide.llm.words import words

vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def transducer():
    return Transducer(read_ranks(VOCABULARY))


@vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_plain_merging(transducer, text):
    ids = transducer.encode(text)
    assert ids == [i for p in transducer._cut(text) for i in transducer.merge(p.encode())]
    assert transducer.decode(ids) == text


@vocabulary
def test_long_runs_special_strings_and_nothing(transducer):
    for text in ("ab" * 3000, "日本" * 500, " " * 2000, "<|endoftext|>", "a\n\n  b"):
        assert transducer.decode(transducer.encode(text)) == text
    assert transducer.encode(None) == transducer.encode("") == []
    assert 50256 not in transducer.encode("<|endoftext|>")


@vocabulary
def test_ids_of_a_table(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a cat"), (2, ""), (3, None), (4, "a cat")], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: r.x for r in df.select("doc_id", token_ids(F.col("text")).alias("x")).collect()}
    assert got[1] == got[4] == [64, 3797] and got[2] == got[3] == []
    assert all(r.x.restored for r in df.select(round_trip(F.col("text")).alias("x")).collect())


@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8_stream_is_that_of_python(data, step):
    s = Utf8Stream()
    assert "".join(s.feed(data[i : i + step]) for i in range(0, len(data), step)) + s.end() == data.decode("utf-8", "replace")


def test_words():
    assert words("Ｆｕｌｌ‑width, a\u00adb_c ﬁne É2") == ["full", "width", "ab", "c", "fine", "é2"] and words(None) == words(" ") == []


W = [f"w{i}" for i in range(60)]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y or x == 0))
    return row[-1]


@pytest.mark.parametrize("block", [2_000_000, 900])
def test_leaks_like_brute_force(spark, monkeypatch, block):
    r = random.Random(8)
    passages = [(i, " ".join(r.choices(W, k=r.choice([5, 12, 30])))) for i in range(20)] + [(90, None), (91, "")]
    docs = [(0, None), (1, ""), (2, "w1 " * 5)]
    for d in range(3, 60):
        i, p = r.choice(passages[:20])
        part = p.split()
        at, n = r.randint(0, len(part)), r.randint(4, 14)
        docs.append((d, " ".join(r.choices(W, k=20)) + ", " + ("_" if d % 2 else "\u00ad ").join(part[at : at + n]).upper() + ". " + " ".join(r.choices(W, k=20))))
    docs += docs[-3:]
    grams = lambda t: {tuple(words(t)[k : k + 10]) for k in range(len(words(t)) - 9)}
    want = {(d, i) for d, t in docs for i, p in passages if grams(t) & grams(p)}
    ddf, pdf = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(passages, "eval_id bigint, passage string")
    monkeypatch.setattr("darkslide.llm.leaks.BLOCK_CHARS", block)
    got = near_windows(ddf, pdf, **FOUND).collect()
    assert want and {(x.doc_id, x.eval_id) for x in got if x.edits == 0} == want and len({x[:2] for x in got}) == len(got)
    symbol = {w: i for i, w in enumerate(W, 1)}
    coded = lambda g: [symbol[x] for x in g]
    texts, given = dict(docs), dict(passages)
    for x in got:
        assert x.edits == min(plain_distance(coded(a), coded(b)) for a in grams(texts[x.doc_id]) for b in grams(given[x.eval_id])) <= 2
    assert near_windows(ddf, pdf.filter("eval_id > 99"), **FOUND).count() == 0 and near_windows(ddf.filter("doc_id > 99"), pdf, **FOUND).count() == 0


@pytest.mark.parametrize("parameters", [FOUND, NEAR])
def test_recall_of_edited_windows(parameters):
    r, n = random.Random(9), parameters["size"]
    vocabulary = [f"v{i}" for i in range(500)]
    passages = [(i, " ".join(r.choices(vocabulary, k=n))) for i in range(200)]
    index, found = EditSearch(passages, **parameters), 0
    texts = []
    for _, p in passages:
        w = p.split()
        for _ in range(2):
            w[r.randrange(n)] = r.choice(vocabulary)
        texts.append(" ".join(r.choices(vocabulary, k=9) + w + r.choices(vocabulary, k=9)))
    text, passage, _ = index.find(texts)
    found = len({i for i, j in zip(text.tolist(), passage.tolist()) if i == j})
    assert index.tables > 5 and found >= 200 * parameters["recall"] - 6


def test_edit_distances():
    import numpy as np

    r = np.random.default_rng(1)
    a = r.integers(0, 5, (300, 7))
    b = np.where(r.random((300, 7)) < 0.2, r.integers(1, 5, (300, 7)), np.roll(a, 1, axis=1) * (r.random((300, 1)) < 0.5) + a * 1)
    for edits in (0, 1, 2, 3):
        want = [min(plain_distance(x, y), edits + 1) for x, y in zip(a.tolist(), b.tolist())]
        assert edit_distances(a, b, edits).tolist() == want


SOUND = [
    "Le café est fermé; l’été revient — déjà…", "Größe für später, „schön“", "Zdjęcie już źle dobraną łódź", "¿Por qué la imagen está así?", "Кадр имеет сильный шум в тенях, снова.",
    "夕方、港の連作に傾いた水平線がある。", "CORREÇÃO: NÃO USAR", "├── a.jpg\n└── b.jpg", "√2 ≈ 1.414, ±9′", "voilà\u00a0»", "l’été “Été” « à »", "Серия из порта: класс «В»", "📷 👍🏽",
]


@pytest.mark.parametrize("text", [*SOUND, "", None, "plain", "m³ and x² ± 3"])
def test_sound_texts_stay(text):
    assert repair(text) == (text, 0, True)


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("text", [s for s in SOUND[:6]])
def test_damage_is_found_and_undone(codec, text):
    wrong = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in text.encode())
    fixed, n, whole = repair("Frame 12, ISO 400. " + wrong)
    assert n > 0 and whole and fixed == "Frame 12, ISO 400. " + text


CORPUS = [*SOUND, "Осталось разобрать файлы", "Zdjęcie już jest, według planu, z łódką", "сильный шум снова"]


@pytest.fixture(scope="module")
def model():
    import numpy as np

    return Pairs(np.bincount(pairs("\n".join(CORPUS * 100)), minlength=CLASSES**2))


@pytest.mark.parametrize("text", CORPUS)
def test_sound_texts_stay_with_letter_pairs(model, text):
    assert repair(text, model) == (text, 0, True)


def test_twice_and_lost():
    once = SOUND[0].encode().decode("cp1252", "replace").replace("\ufffd", "")
    twice = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in once.encode())
    assert repair(twice)[1] > 0
    assert repair("caf\ufffd ouvert")[1:] == (1, False)
    assert repair("вЂњnight setвЂќ") == ("“night set”", 2, True)


@pytest.mark.parametrize("taken, meant", [("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "cp1251"), ("latin_1", "koi8_r"), ("iso8859_5", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866")])
def test_cyrillic_of_another_encoding(model, taken, meant):
    whole = "Кадр имеет сильный шум"
    wrong = "".join(bytes([b]).decode(taken, "ignore") or " " for b in whole.encode(meant))
    fixed, n, _ = repair("снова. " + wrong, model)
    assert n >= 3 and fixed.count("снова") == 1 and ("Кадр" in fixed and "шум" in fixed or meant == "cp866" or taken in ("iso8859_5", "cp866"))


def test_several_encodings_in_one_text(model):
    text = "снова. " + "Кадр имеет сильный шум".encode("koi8_r").decode("cp1251") + " | " + "Осталось разобрать файлы".encode("cp1251").decode("cp1252") + " | " + "Zdjęcie już jest, według planu".encode("cp1250").decode("cp1252")
    assert repair(text, model)[0] == "снова. Кадр имеет сильный шум | Осталось разобрать файлы | Zdjęcie już jest, według planu"


def test_damaged_documents(spark):
    docs = [(1, "plain"), (2, None), (3, ""), (4, "The cafÃ© is shut"), (5, "Été"), (6, "x" * 100_000 + "Ã©t" + "Ã©"), (4, "The cafÃ© is shut")]
    got = sorted((r.doc_id, r.n_stretches) for r in damaged(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())
    assert [d for d, _ in got] == [4, 4, 6]


def _wrong(text, codec):
    return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in text.encode())


def test_long_damage_is_undone_to_its_end():
    text = "schön und über " * 300
    fixed, n, whole = repair(_wrong(text, "cp1251"))
    assert fixed == text and n == 600 and whole


def test_restored_only_if_nothing_is_left():
    assert repair(_wrong("schön" + " plain" * 20 + " über", "cp1251")) == ("schön" + " plain" * 20 + " " + _wrong("ü", "cp1251") + "ber", 1, False)
    many = "l’été là-bas"
    for _ in range(6):
        many = _wrong(many, "cp1252")
    assert repair(many)[::2] == ("l’été là-bas", True)
