"""The methods themselves against plain versions: language scores, index vectors, gradients, links of secrets; odd and hot rows."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tests.conftest import SF
from tests.llm.test_llm import DOCS, ODD, PATH, check_packing, library, plain_top

from siftwell.llm import cap_filters, language_id, mixing, packing, quality, secrets, token_counts, token_output, topk
from siftwell.llm.common import Scratch

# 7


def test_prefix_counts_of_all_scripts_are_those_of_the_library():
    tok = library()
    texts = [
        "x’s İstanbul　日本語。1２ ΣΑΣ é́", "it’s John’s “quoted” — dash", "Привет, мир! «Это»", "a\t\tb 　　 c\x1cd\x85e​f", "日本<|endoftext|>語!<|startoftext|><|endoftex x!<|endoftext|>",
        "한국어 텍스트", "がぎく ẹ́x q́̕", "نص عربي ١٢٣", "ไทยภาษา", "\U0001F600‍\U0001F468 ½ Ⅳ²", "ﬁ ŉ ǰ ẞß İi", "'s’t 日's 日'ré 語'", "́abc 각",
    ]
    rng, pool = random.Random(1), "aB'’é日本語あが́\t　 .,!1２ΣσİЖ\U0001F600<|\x00\xa0​가"
    texts += ["".join(rng.choice(pool) for _ in range(30)) for _ in range(200)]
    for text, counts in zip(texts, token_counts.prefix_arrays(texts, PATH)):
        assert counts.tolist() == [len(tok.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)], text


def test_long_text_without_blanks_takes_linear_time():
    rng = random.Random(2)
    text = "".join(rng.choice("日本語漢字中文的一是不了人我在有他这为") for _ in range(50_000))
    began = time.process_time()
    assert token_counts.prefix_arrays([text], PATH)[0][-1] == len(library().encode(text, add_special_tokens=False).ids)
    assert time.process_time() - began < 20


# 9


def plain_language(text, docs, orders=language_id.ORDERS):
    """Word-first backoff from counts of all labelled documents."""
    letters = lambda t: regex.findall(r"\p{L}+", t.lower())
    langs = sorted({lang for _, lang in docs})
    words = {lang: Counter(w for t, own in docs for w in letters(t) if own == lang) for lang in langs}
    total = sum(words.values(), Counter())
    known = {w for w, n in total.items() if n >= language_id.MIN_COUNT}
    grams = {n: {lang: Counter() for lang in langs} for n in orders}
    for lang in langs:
        for w, c in words[lang].items():
            for n in orders:
                for i in range(len(w) + 3 - n):
                    grams[n][lang][f"<{w}>"[i : i + n]] += c
    # Only words known at least so often take part in the words' totals.
    sums = {lang: sum(c for w, c in words[lang].items() if w in known) for lang in langs}
    log = lambda c, t, most: math.log((c + 0.5) / (t + 0.5 * most))
    scores = np.zeros(len(langs))
    found = letters(text)
    for w in found:
        if w in known:
            scores += [log(words[lang][w], sums[lang], language_id.MAX_WORDS) for lang in langs]
            continue
        for n in orders:
            own = [g for g in (f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)) if any(grams[n][lang][g] for lang in langs)]
            if own:
                scores += np.mean([[log(grams[n][lang][g], sum(grams[n][lang].values()), language_id.MAX_GRAMS) for lang in langs] for g in own], axis=0)
                break
    if not found:
        return "und", 0.0
    z = scores / len(found) * min(len(found), 8)
    p = np.exp(z - z.max())
    return langs[int(p.argmax())], float(p.max() / p.sum())


def test_language_scores_are_those_of_a_plain_version(spark):
    docs = [("der Hund und die Katze und der Maus", "de"), ("the dog and the cat and a mouse", "en"), ("le chien et le chat", "fr"), ("Über Größe; über die Straße", "de")]
    model = language_id.train(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(docs)], "doc_id long, text string, lang string"))
    texts = ["der Hund", "the catty dogs", "chienne et Katzen", "zzz qqq", "½ ²", "Ⅳ", "1234", "", "und ½ le", "ÜBER straßen", "a" * 50]
    got = language_id.classify(texts, model, language_id._Scores(model))
    for text, (lang, score) in zip(texts, got):
        want = plain_language(text, docs)
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-9), text


# 10


def test_word_vectors_are_sums_of_neighbours(spark):
    texts = ["a b c a B, b!", "c b a 12 b", None, "", "a a a a b", "x"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    vectors, network = quality.train(docs, labels)
    learned = [t for i, t in enumerate(texts) if quality.crc32(str(i).encode()) % 5]
    counts = Counter(w for t in learned for w in quality._TOKENS.findall(t or ""))
    assert {w for w in vectors.rows if w[0] != "~"} == {w for w, n in counts.items() if n >= quality.MIN_COUNT}
    total = defaultdict(lambda: np.zeros(quality.DIM))
    for t in learned:
        names = [w if w in vectors.rows else quality.shape(w) for w in quality._TOKENS.findall(t or "")]
        for i, w in enumerate(names):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(names):
                    places, signs = quality.index_vector(names[j])
                    total[w][places] += signs
    for w, i in vectors.rows.items():
        own = np.zeros(quality.DIM)
        places, signs = quality.index_vector(w if w[0] == "~" else quality.shape(w))
        own[places] = signs
        want = total[w] / max(np.linalg.norm(total[w]), 1e-9) + 0.5 * own
        assert vectors.vectors[i, : quality.DIM] == pytest.approx(want, abs=1e-5)
    known = quality._Known(vectors)
    x = quality.features(["a b a", "a b b"], known)
    a, b = (vectors.vectors[vectors.rows[w]] for w in "ab")
    assert x[0, : 2 * quality.DIM] == pytest.approx((2 * a + b) / 3, abs=1e-5) and x[0, -2] == pytest.approx(1 / 3) and x[1, -3] == pytest.approx(1 / 3) and x[0, -1] == pytest.approx(np.log(4))


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 6))
    p = 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1]))
    y = (rng.random(2000) < p).astype(float)
    net = quality.Network().fit(x, y)
    got = net.score(x)
    assert np.corrcoef(got, p)[0, 1] > 0.9
    loss = lambda q: -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))
    z = net.logits((x - net.mean) / net.scale)
    assert loss(got) <= min(loss(1 / (1 + np.exp(-z / t))) for t in (0.2, 5.0)) + 1e-9
    # One step of descent from the weights doesn't go up: the gradient points where the loss falls.
    assert loss(got) < loss(np.full(2000, y.mean()))
    assert (quality.Network().fit(x[:4], np.ones(4)).score(x) == 1).all() and (quality.Network().fit(x[:0], y[:0]).score(x) == 0.5).all()
    assert np.isfinite(quality.Network().fit(x[:3], np.array([0.0, 1.0, 1.0])).score(x)).all()


def test_quality_gives_way_to_a_clashing_column(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("x"))
    model = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int"))
    got = quality.score(docs, model, ["doc_id", "score", "text"])
    assert got.columns == ["doc_id", "text", "score"] and got.count() == len(ODD)


# 4


def plain_links(text):
    base, weak = secrets.base_spans(text), secrets.weak_spans(text)
    near = lambda s, ps: any(p[1] <= s[2] + secrets.SCOPE and s[1] <= p[2] + secrets.SCOPE for p in ps)
    access = [s for s in base if s[0] == "access"]
    keys = [s for s in weak if s[0] == "secret" and near(s, access)]
    return secrets.ordered(base + keys + [s for s in weak if s[0] == "endpoint" and near(s, access) and near(s, keys)])


def test_links_over_all_documents_are_those_of_a_plain_version(spark):
    rng = random.Random(5)
    docs = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    parts = ["AKIA" + "ABCD1234EFGH5678", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEYab", "https://s3.example.org/x?y", "bucket.s3.amazonaws.com", "-x.amazonaws.com.", "token=abcdef12"]
    made = []
    for t in docs:
        for _ in range(rng.choice([0, 0, 2, 5])):
            at = rng.randint(0, len(t))
            t = f"{t[:at]} {rng.choice(parts)} {'z ' * rng.randint(0, 250)}{t[at:]}"
        made.append(t)
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("spans", F.lit(2))
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.find_secrets(rows, ["doc_id", "base"]).collect()}
    assert got == {i: plain_links(t) for i, t in enumerate(made)} and any(s[0] in secrets.WEAK for g in got.values() for s in g)
    assert secrets.redact(rows).columns == rows.columns


def test_patterns_take_linear_time_on_long_lines():
    access = "AKIA" + "B" * 20 + " "
    for line in ("a-" * 300_000, "a." * 300_000, "password" * 60_000, "token   " * 60_000, "https://" * 60_000, "A" * 600_000, "0" * 600_000):
        began = time.process_time()
        secrets.base_spans(access + line)
        secrets.weak_spans(access + line)
        assert time.process_time() - began < 5, line[:10]
    assert [s[0] for s in secrets.weak_spans("x https://a.s3.amazonaws.com/k b.amazonaws.com, c.amazonaws.company")] == ["endpoint", "endpoint"]


# 5


def test_top_k_of_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=3 if i % 3 else 5).tolist()) for i in range(1, 160)] + [(200 + i, []) for i in range(0, 60, 10)] + [(20, [9.0] * 3), (20, [1.0] * 3), (40, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit("x")).withColumn("cell", F.lit(1)).withColumn("v", F.lit(2))
    data = topk.quantized(table)
    by_len = defaultdict(list)
    for i, v in rows:
        by_len[len(v)].append((i, v))
    want = []
    for n, own in by_len.items():
        seen = {i: min(np.floor(64 * np.array(v)).tolist() for j, v in own if j == i) for i, v in own}
        if n:
            alone = {i for i in seen if i % 20 == 0}
            for q in alone:
                x = np.array(seen[q])
                best = sorted((-int((x * np.floor(64 * np.array(v))).sum()), i) for i, v in own if i != q)[:20]
                want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
        else:
            want += [(q, r + 1, i, 0) for q in seen if q % 20 == 0 for r, i in enumerate(sorted(j for j, _ in own if j != q))]
    # An id on rows of several lengths asks with the least of its vectors, which is of one of them.
    asks = {i: min((np.floor(64 * np.array(v)).tolist() for j, v in rows if j == i)) for i, _ in rows if i % 20 == 0}
    want = [w for w in want if any(len(v) == len(asks[w[0]]) for j, v in rows if j == w[2])]
    got = topk.top_k(data.filter("vec_id % 20 = 0"), data, pivots=4, block=16, query_block=3).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_products_beyond_a_double_are_exact_and_stop_at_the_ends():
    big = np.array([[2.0**40, 3.0], [2.0**70, 1.0]])
    got = topk.exact_products(big, big)
    assert got[0, 0] == 2**63 - 1 and got[1, 1] == 2**63 - 1
    assert topk.exact_products(np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0]]))[0, 0] == 2**60 + 1


# 1, 2, 6, 8: clashing names, hot ids


def test_mix_keeps_other_columns(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumn("copy", F.lit("own")).withColumn("__n", F.lit(7)).withColumn("rate 0", F.lit(8))
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "__n", "rate 0", "copy"]
    rows = got.collect()
    assert rows and all(r["__n"] == 7 and r["rate 0"] == 8 and r["copy"] >= 1 for r in rows)


def test_sources_are_numbered_over_many_partitions(spark):
    rows = [(f"s{i:04d}", 1 + i % 7) for i in range(1000)] + [(None, 50)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long").repartition(7)).collect()}
    order = sorted(s for s, _ in rows if s) + [None]
    total, w = sum(n for _, n in rows), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size = dict(rows)
    level = 0.0
    while (new := (total - sum(3 * size[s] for s in order if 3 * size[s] < level * w[s])) / sum(w[s] for s in order if 3 * size[s] >= level * w[s])) > level:
        level = new
    assert got == {s: pytest.approx(min(3 * size[s], level * w[s]), abs=1e-5) for s in order}


def test_a_hot_id_becomes_several_shards(spark):
    tok = library()
    rows = spark.createDataFrame([(None if i % 2 else 7, f"text number {i} " * 20) for i in range(400)], "doc_id long, text string").repartition(5)
    shards = token_output.write_tokens(rows, PATH, Scratch(spark, "test-tokens").base, shard_bytes=10_000, max_shards=6).collect()
    assert 2 < len(shards) <= 6 and max(s["n_docs"] for s in shards) < 200
    got = token_output.read_tokens(spark.createDataFrame(shards)).collect()
    assert Counter(r["n_tokens"] for r in got) == Counter(len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows.collect())
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None] * 200 + [7] * 200


def test_packing_of_a_hot_id(spark):
    rows = [(None if i % 3 == 0 else 5, f"word{i % 50} " * (1 + i % 40), "en", "s", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4).withColumn("shard", F.lit("x")).withColumn("piece", F.lit(1))
    got = packing.pack(docs, shard_items=100).collect()
    by_id = Counter((r["doc_id"], r["copy"]) for r in got)
    assert set(by_id.values()) == {1} and {c for d, c in by_id if d == 5} == set(range(1, 401)) and {c for d, c in by_id if d is None} == set(range(1, 201))
    assert len({r["bin_id"] % 6 for r in got}) == 6
    want = Counter()
    for d, t, *_ in rows:
        want[d] += len(t.split())
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["size"]
    assert have == want


def test_cap_filters_ignore_clashing_columns(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = cap_filters.embedding_links(rows.withColumn("print", F.lit("x")).withColumn("n", F.lit(5)).withColumn("component_id", F.lit(9))).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
