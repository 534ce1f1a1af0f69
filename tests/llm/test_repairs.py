"""Ids beside nulls, samples of any size, decomposed text, redaction of many spans."""

import random
import time
from unicodedata import normalize

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import language_id, packing, secrets, token_counts

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_large_ids_beside_nulls_are_packed_as_they_are(spark):
    ids = [2**53 + 1, 2**53 + 3, None, 2**62 + 5, -(2**53) - 7, None, 0]
    rows = spark.createDataFrame([(i, f"w{k} x", "en", "a", 4) for k, i in enumerate(ids)], DOCS)
    got = packing.pack(rows.coalesce(1)).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted(ids, key=repr)
    assert sorted(r["copy"] for r in got if r["doc_id"] is None) == [1, 2]


def test_samples_of_any_size():
    assert language_id.below(12_000, 10**11) > 0 and language_id.below(1, 10**30) == 1
    for n in (10**5, 10**8, 10**11, 10**14):
        assert language_id.below(3_000, n) / 2**63 == pytest.approx(3_000 / n)


def test_null_and_hot_ids_are_learned_from_like_others(spark):
    words = {"en": "the cat sat on the mat", "de": "der hund lief in den wald"}
    for key in (None, 7):
        rows = spark.createDataFrame([(key, words[x], x) for x in ("en", "de")] * 200, "doc_id long, text string, lang string")
        sample = language_id.bounded_sample(rows.withColumn("row", F.monotonically_increasing_id()), 100, F.lit(9), F.col("row"))
        assert 50 < sample.count() < 160
        model = language_id.train(rows, max_train=100)
        assert model["langs"] == ["de", "en"]
        got = language_id.identify(rows, model).groupBy("lang_pred").count().collect()
        assert {r["lang_pred"]: r["count"] for r in got} == {"en": 200, "de": 200}
    one = spark.createDataFrame([(1, "a b", "en")] * 50, "doc_id long, text string, lang string")
    assert language_id.bounded_sample(one.withColumn("row", F.monotonically_increasing_id()), 1, F.col("row")).count() >= 1


def by_library(counter, text):
    return [len(counter.encoder.tokenizer.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]


def test_decomposed_text_counts_as_the_library_counts():
    counter = token_counts.PrefixCounter(PATH)
    rng = random.Random(8)
    starters = list("aeioucnABEİIıqs'!.-9 が한글é中ßΣς") + ["か", "ハ", "ᄒ", "ᅡ", "ᆫ", "한", "\U0001d15e", "Å", "ﬁ", "x"]
    marks = ["́", "̈", "̧", "゙", "゚", "̇", "ͅ", "ְ", "֑"]
    for k in range(400):
        text = "".join(rng.choice(starters if rng.random() < 0.6 else marks) for _ in range(rng.randrange(1, 30)))
        text = normalize("NFD", text) if k % 2 else text
        word = text.replace(" ", "")
        assert list(counter.word(word)) == by_library(counter, word), repr(word)
    for alphabet in ("がぎぐげご", "한국어글", "éàüñ", "İ"):
        for mixed in (False, True):
            word = "".join(normalize("NFD", rng.choice(alphabet)) + ("x" if mixed and rng.random() < 0.2 else "") + ("́" if rng.random() < 0.1 else "") for _ in range(70))
            assert list(counter.word(word)) == by_library(counter, word), repr(word)


@pytest.mark.parametrize("letters", ["が", "한", "é", "Ị̇"])
def test_long_decomposed_texts_take_linear_time(letters):
    counter = token_counts.PrefixCounter(PATH)
    text = normalize("NFD", letters) * (200_000 // len(normalize("NFD", letters)))
    began = time.time()
    counts = counter.word(text)
    assert len(counts) == len(text) and time.time() - began < 60
    assert counts[-1] == len(counter.encoder.tokenizer.encode(text, add_special_tokens=False).ids)


def test_redaction_of_very_many_spans_is_one_cut(spark):
    rng = random.Random(9)
    hashes = ["%024x" % rng.getrandbits(96) for _ in range(100_000)]
    text = " ".join(hashes)
    began = time.time()
    (got,) = secrets.redact(spark.createDataFrame([(1, text, "en", "a", len(text))], DOCS)).collect()
    assert got["text"] == " ".join(["[secret]"] * len(hashes)) and got["n_chars"] == len(got["text"]) and time.time() - began < 60


def test_masks_of_spans_that_overlap_touch_or_lie_in_each_other():
    rng = random.Random(10)
    for _ in range(300):
        text = "".join(rng.choice("abé😀") for _ in range(40))
        spans = sorted(({"start": a, "end": rng.randrange(a + 1, 41)} for a in (rng.randrange(40) for _ in range(rng.randrange(5)))), key=lambda s: s["start"])
        want, at = "", 0
        for s in spans:
            if s["start"] >= at:
                want += text[at : s["start"]] + "#"
            at = max(at, s["end"])
        assert secrets.masked(text, spans, "#") == want + text[at:]
