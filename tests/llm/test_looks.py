"""Texts that look the same."""

import os
import random
import unicodedata

import pytest

from ontoloom.llm import looks, plans

SAME = [
    ("full", "ｆｕｌｌ"), ("7 (x)", "７　（ｘ）"), ("café", "café"), ("ё", "ё"), ("ガ", "ガ"), ("ガ", "ｶﾞ"), ("office flow", "oﬃce ﬂow"), ("a b", "a b"), ("a b", " a \n\tb　"), ("a b", "a ​ b"),
    ("paypal", "pаypаl"), ("scope", "ѕсоре"), ("HOTEL", "НОТЕL"), ("TOXIN", "ΤΟΧΙΝ"), ("word", "wo​rd"), ("word", "w­or﻿d"), ("ë", "ё"), ("heart ❤", "heart ❤️"), ("dot", "dօt"),
    ("Apple", "Ꭺpple"), ("Bad", "ꓐad"), ("Open", "Ⲟpen"), ("VIII", "Ⅷ"), ("xi", "ⅺ"), ("LJ", "Ǉ"), ("dž", "ǆ"), ("gang", "ɡanɡ"), ("HAL", "ᕼᗅᒪ"), ("cool", "𐐽𐐬𐐬l"), ("æther", "ӕther"), ("μm", "µm"), ("一", "⼀"), ("لا", "ﻻ"), ("TAXI", "ꓔꓮꓫꓲ"), ("ij", "ĳ"), ("กำ", "กํา"),
]
DIFFERENT = [("a", "A"), ("cafe", "café"), ("a.", "a!"), ("a b", "ab"), ("x1", "x2"), ("don't", "don’t"), ("в", "b"), ("к", "k"), ("2", "²"), ("a-b", "a–b"), ("дом", "dom"), ("I", "l"), ("0", "O"), ("No", "№"), ("TEL", "℡"), ("...", "…"), ("s", "ſ"), ("1", "①"), ("a", "ᵃ"), ("ㄱ", "ᄀ")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert a != b and looks.form(a) == looks.form(b) and looks.skeleton(a) == looks.skeleton(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert looks.form(a) != looks.form(b)


def test_forms_keep_scripts_consistent():
    assert looks.form("Москва и вода") == "Москва и вода"
    assert looks.form("вoдa") == "вода"  # Latin letters amid Cyrillic ones
    assert looks.form("сор") == "cop"  # wholly look-alikes
    assert looks.form("qж") in ("qж", "ԛж")
    assert looks.token_kinds("сор pаy дом plain") == ["whole", "mixed", "plain"]


def test_spelling_is_of_the_scripts_that_all_letters_share():
    assert looks.respell("сор") == looks.respell("cop") == "cop"  # Latin is among them
    assert looks.respell("бop") == looks.respell("бор") == "бор"  # only Cyrillic is
    assert looks.respell("λoγoς") == looks.respell("λογος") == "λογος"  # only Greek is
    assert looks.respell("жλo") == looks.respell("жλо") == "жλo"  # none is: Latin letters where there are such
    assert looks.respell("ꭰo") == looks.respell("ꭰо")


def test_forms_are_stable_and_equal_exactly_for_equal_skeletons():
    r = random.Random(2)
    letters = "ᎪꓐⲞɡλжabcoxpвдсорхеяKКNΝοé́ ​ｆﬁ中ё1_"
    seen = {}
    for _ in range(20_000):
        t = "".join(r.choice(letters) for _ in range(r.randrange(5)))
        f = looks.form(t)
        assert looks.form(f) == f and looks.skeleton(f) == looks.skeleton(t)
        assert seen.setdefault(looks.skeleton(t), f) == f


def test_long_texts_take_linear_time():
    for t in ("a" * 400_000 + "é", "а" * 400_000, "x́" * 200_000, " " * 400_000 + "я"):
        assert len(looks.form(t)) <= len(t)


def test_words():
    assert looks.words("Don’t <b>STOP</b>, ПАРКА_2 straße") == ["don", "t", "b", "stop", "b", *looks.words("парка"), "2", "strasse"]
    assert looks.words("Bank") == looks.words("ВАNК") == looks.words("bаnk") and looks.words(None) == looks.words(" ​") == []


def brute(docs):
    def key(t):
        return looks.skeleton(t)

    return sorted((a, b) for a, x in docs for b, y in docs if a < b and x and y and key(x) and x != y and key(x) == key(y))


def test_found_matches_all_pairs(spark):
    r = random.Random(4)
    base = ["cope with it", "дом вода", "full width", "café", "", "  ", None, "one"]
    change = [lambda t: t, lambda t: t, lambda t: t.replace("o", "о"), lambda t: t.replace("e", "е"), lambda t: t + " ", lambda t: unicodedata.normalize("NFD", t), str.upper]
    docs = []
    for n in range(150):
        t = r.choice(base)
        docs.append((n, None if t is None else r.choice(change)(t)))
    df = spark.createDataFrame([(n, t, 1, "x") for n, t in docs], "doc_id long, text string, f1 int, x string").repartition(3)
    keys = looks.form_keys(df).cache()
    assert sorted(tuple(x) for x in looks.look_alikes(keys).collect()) == brute(docs)
    forms = {x.doc_id: x for x in looks.forms(df).collect()}
    assert all(forms[n].form == (None if t is None else looks.form(t)) for n, t in docs)
    assert looks.look_alikes(looks.form_keys(df.limit(0))).count() == 0 and looks.forms(df.limit(0)).count() == 0


def test_repeated_documents(spark):
    df = spark.createDataFrame([(1, "cop"), (1, "cop"), (1, "соp"), (2, "сop"), (2, "сop"), (None, "cоp")], "doc_id int, text string")
    assert [tuple(x) for x in looks.look_alikes(looks.form_keys(df).cache()).collect()] == [(1, 2)]


def test_a_hot_group_of_copies_makes_no_pairs_of_its_own(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id = 7, 'hоt text', 'hot text') as text")
    found = looks.look_alikes(looks.form_keys(df).cache())
    assert found.count() == 2999 and found.where("7 in (doc_id_a, doc_id_b)").count() == 2999


def test_classes_are_the_pairs_in_linear_form(spark):
    r = random.Random(8)
    base = ["cope with it", "дом вода", "full width", "café", "", "  ", None, "one"]
    change = [lambda t: t, lambda t: t, lambda t: t.replace("o", "о"), lambda t: t.replace("e", "е"), lambda t: t + " ", lambda t: unicodedata.normalize("NFD", t), str.upper]
    docs = [(n, None if t is None else r.choice(change)(t)) for n in range(150) for t in [r.choice(base)]]
    df = spark.createDataFrame([(n, t, 7) for n, t in docs] + [docs[0] + (8,), (None, "one", 9)], "doc_id long, text string, class_id int").repartition(3)
    keys = looks.form_keys(df).cache()
    rows = looks.classes(keys).collect()
    assert sorted(x.doc_id for x in rows) == [n for n, t in docs if t and looks.form(t)]
    pairs = sorted((a.doc_id, b.doc_id) for a in rows for b in rows if a.doc_id < b.doc_id and a.class_id == b.class_id and a.spelling_id != b.spelling_id)
    assert pairs == brute(docs)
    assert all(x.class_id <= x.spelling_id <= x.doc_id for x in rows)
    assert looks.classes(looks.form_keys(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["p7_found", "p7_near", "p8_found", "p8_classes", "p8_tokens", "p8_forms"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    rel = con.execute(plans.SQL[name])
    columns = [c[0] for c in rel.description]
    expected = sorted(map(repr, rel.fetchall()))
    assert sorted(repr(tuple(r)) for r in plans.QUERIES[name](spark, small).select(*columns).collect()) == expected
