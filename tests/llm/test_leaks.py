"""Leaked test items against brute force."""

import random
import time

import pytest

from ontoloom.llm import leaks
from ontoloom.llm.looks import words


def edits(pattern, text):
    """The least edits that turn some part of ``text`` into ``pattern``, by dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_distance_matches_dynamic_programming():
    r = random.Random(0)
    for _ in range(3000):
        p, t = [r.randrange(4) for _ in range(r.randrange(1, 12))], [r.randrange(4) for _ in range(r.randrange(14))]
        assert leaks.distance(p, t) == edits(p, t)


def brute(docs, items, window, errors):
    out = {}
    for d, t in docs:
        have = words(t)
        for i, x in items:
            own = words(x)
            best = min((edits(own[k : k + window], have) for k in range(len(own) - window + 1)), default=99)
            if best <= errors:
                out[d, i] = best
    return out


@pytest.mark.parametrize("window,errors", [(10, 0), (10, 1), (7, 2), (5, 0), (6, 5)])
def test_found_matches_brute_force(spark, window, errors):
    r = random.Random(window + errors)
    vocabulary = [f"w{n}" for n in range(12 if errors < 3 else 60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, window, 25])))) for i in range(12)]
    docs = []
    for d in range(120):
        text = [r.choice(vocabulary) for _ in range(r.randrange(30))]
        own = r.choice(items)[1].split()
        at = r.randrange(len(own))
        part = own[at : at + r.randrange(1, 16)]
        for _ in range(r.randrange(3)):
            part[r.randrange(len(part))] = r.choice(vocabulary)
        text[5:5] = part
        docs.append((d, r.choice([" ", "\n> ", ", "]).join(text)))
    docs += [(900, None), (901, ""), (902, " ")]
    d = spark.createDataFrame([(*x, "e", 1) for x in docs], "doc_id long, text string, edits string, item_id int").repartition(3)
    i = spark.createDataFrame([(*x, 1) for x in items] + [(77, None, 1)], "item_id int, text string, doc_id int")
    found = leaks.find_leaks(d, i, window, errors)
    assert {(x.doc_id, x.item_id): x.edits for x in found.collect()} == brute(docs, items, window, errors) and found.count() == len({*map(tuple, found.select("doc_id", "item_id").collect())})


def test_blocks_give_the_same(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a b c d e f"), (2, "c d e f g"), (2, "c d e f g")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b c d"), (2, "d e f g"), (3, "b c d e f")], "item_id long, text string")
    whole = sorted(map(tuple, leaks.find_leaks(d, i, 4).collect()))
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 4)
    assert sorted(map(tuple, leaks.find_leaks(d, i, 4).collect())) == whole and len(whole) == 4


def test_an_item_longer_than_a_block_keeps_all_its_windows(spark, monkeypatch):
    long = [f"w{n}" for n in range(60)]
    d = spark.createDataFrame([(n, " ".join(long[n : n + 10])) for n in range(51)] + [(99, " ".join(long[:9]))], "doc_id long, text string")
    i = spark.createDataFrame([(5, " ".join(long)), (6, "other words")], "item_id long, text string")
    for size in (3, 10, 11, 17, 25):
        monkeypatch.setattr(leaks, "BLOCK_WORDS", size)
        assert sorted(x.doc_id for x in leaks.find_leaks(d, i).collect()) == list(range(51))
        parts = [p for block in leaks._blocks(i, "item_id", "text", 10) for p in block]
        assert max(len(p) for _, p in parts) <= max(size, 10)


@pytest.mark.parametrize("errors", [0, 1, 2])
def test_hot_words_take_linear_time(errors):
    index = leaks.Index([(1, ["a"] * 400), (2, ["a", "b"] * 200)], 10, errors)
    began = time.perf_counter()
    found = sorted(index.search([index.numbers(["a"] * 1_000_000), index.numbers(["b", "a"] * 300_000), index.numbers(["c"] * 50)]))
    assert time.perf_counter() - began < 20
    assert [x[:2] for x in found if x[2] == 0] == [(0, 1), (1, 2)]


def test_planted_leaks_with_one_edit_are_all_found(spark):
    """Passages of the benchmark, one word changed, missing or added, amid real posts."""
    small = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    posts = [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    r, docs = random.Random(3), []
    for n, (item, t) in enumerate(items):
        own = words(t)
        if len(own) < 12:
            continue
        at = r.randrange(len(own) - 10)
        part = own[at : at + 10]
        k = r.randrange(1, 9)
        part[k : k + r.choice([0, 1])] = r.choice([["zzz"], []])
        docs.append((n, posts[n % len(posts)] + " \n" + " ".join(part) + ". " + posts[(n + 7) % len(posts)]))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(x.doc_id, x.item_id): x.edits for x in leaks.find_leaks(d, spark.createDataFrame(items, "item_id long, text string"), errors=1).collect()}
    assert len(docs) > 20 and all((n, items[n][0]) in found for n, _ in docs)


def test_empty_and_altered(spark):
    d = spark.createDataFrame([(1, "ONE **two** thrее\nfour <i>five")], "doc_id long, text string")  # with Cyrillic letters
    i = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert leaks.find_leaks(d, i, 4).count() == 1
    assert leaks.find_leaks(d.limit(0), i, 4).count() == 0 and leaks.find_leaks(d, i.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        leaks.find_leaks(d, i, 4, 4)
