"""Token ids against the public tokenizer itself."""

import json
import os
import random

import pyarrow as pa
import pytest

from ontoloom.llm import plans, tokens

tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(plans.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(plans.VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_random_texts(reference):
    r = random.Random(1)
    letters = "ab'sdtmrevl \t\n\r 　  \u0085  ,.=-'\"éß中文😀‍0123_́\x1c"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(20_000)]
    texts += ["'s 't 're 've 'm 'll 'd", "='s", "--'s", "a'll'd", "<|endoftext|>x<|endoftext|>", "  ", "\n\n\n x", " 'd", "x" * 50_000, " " * 50_000, "ab1 " * 20_000, "'" * 20_000, "�\U0010ffff"]
    assert tokens.encoder(plans.VOCABULARY).encode(pa.array(texts)).to_pylist() == reference(texts)


def test_every_cut_is_between_bytes_that_no_token_joins():
    e = tokens.encoder(plans.VOCABULARY)
    data = "One two-three, four’s 五.\n".encode()
    import numpy as np

    cuts = np.flatnonzero(e.cuts(np.frombuffer(data, dtype=np.uint8)))
    assert len(cuts) > 3 and all(e.encoding.decode(e.encoding.encode_ordinary(data[:c].decode()) + e.encoding.encode_ordinary(data[c:].decode())) == data.decode() for c in cuts)


def test_empty_and_null_and_slices():
    e = tokens.encoder(plans.VOCABULARY)
    assert e.encode(pa.array([None, "", None], pa.string())).to_pylist() == [[], [], []]
    assert e.encode(pa.array([], pa.string())).to_pylist() == []
    whole = e.encode(pa.array(["ab", None, "", "c d", "ab"])).to_pylist()
    assert e.encode(pa.array(["ab", None, "", "c d", "ab"]).slice(1)).to_pylist() == whole[1:] and whole[0] == whole[4]


def test_documents(spark, reference):
    path = "/root/testdata/sf0.001/documents.parquet"
    df = spark.read.parquet(path) if os.path.exists(path) else spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    rows = df.select("doc_id", "text").collect()
    found = {r.doc_id: r.ids for r in tokens.token_ids(df.withColumnRenamed("lang", "ids"), plans.VOCABULARY).collect()}
    assert found == {r.doc_id: i for r, i in zip(rows, reference([r.text for r in rows]))}
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "a"), (2, "a b" * 5)], "doc_id int, text string")
    assert sorted(json.dumps([r.doc_id, r.ids]) for r in tokens.token_ids(odd, plans.VOCABULARY).collect())[:2] == ["[1, []]", "[1, []]"]
    assert tokens.token_ids(odd.limit(0), plans.VOCABULARY).count() == 0


def test_the_path_of_the_vocabulary_is_a_setting(spark):
    spark.conf.set("spark.ontoloom.vocabulary", "/nowhere/at/all")
    try:
        with pytest.raises(Exception, match="nowhere"):
            plans.p6_ids(spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.unset("spark.ontoloom.vocabulary")
