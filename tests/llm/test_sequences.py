"""Operators 11 to 13 against plain versions, exact round trips and brute force over all documents."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from siftwell.llm import infill, licenses, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BIG = 2**53
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one two three"), (4, "one two three"), (None, "cc by a cc by b"), (None, None), (BIG + 1, "é中😀x" * 9), (BIG + 3, "a<P>b"), (7, "<" * 30), (8, "word " * 40_000),
    (10, "a b c " * 500 + "SPDX-License-Identifier: MIT"), (11, "naïve\xa0Ünïcode \x00 x́ CC-BY! cc\x00by"), (12, "x" * 300_000), (13, "all rights reserved all rights reserved"), (14, "\n\nA\nB\n"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    # Columns more, with names of results.
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumns({c: F.lit("clash") for c in ("n", "form", "output", "runs", "collapsed", "labels", "score", "h1", "seed", "given 0")})


@pytest.fixture(scope="module")
def odd_dir(odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty_dir(odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    odd.limit(0).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("op", [infill.op11, runs.op12, licenses.op13])
def test_no_documents_make_no_rows(spark, empty_dir, op):
    assert op(spark, empty_dir).count() == 0


# 11


def sha(s):
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def plain_fim(doc_id, text):
    text = text or ""
    n, d = len(text), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(d[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    out = ("spm", f"<S>{suf}<P>{pre}<M>{mid}") if h4 % 100 < 20 else ("psm", f"<P>{pre}<S>{suf}<M>{mid}")
    return doc_id, n, out[0], len(pre), len(mid), sha(out[1]), sha(text)


def test_infill_gives_the_rows_of_a_plain_version(spark, odd, odd_dir):
    for rows, path in ((spark.read.parquet(f"{SF}/documents.parquet"), SF), (odd, odd_dir)):
        want = [plain_fim(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()]
        got = [tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")) for r in infill.op11(spark, path).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_select_by_words_finds_every_unit_of_every_alignment():
    rng = random.Random(1)
    for _ in range(200):
        texts = ["".join(rng.choice("ab\né中😀") for _ in range(rng.randrange(0, 40))) for _ in range(5)]
        raw = [t.encode() for t in texts]
        data, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        for unit, cut in (("character", lambda t: list(t)), ("line", lambda t: re.findall(r"[^\n]*\n|[^\n]+", t))):
            units = infill.Units(data, starts, unit)
            for i, t in enumerate(texts):
                parts = cut(t)
                assert units.counts[i] == len(parts)
                ends = np.cumsum([0, *(len(p.encode()) for p in parts)]) + starts[i]
                assert units.cut(np.full(len(ends), i), np.arange(len(ends))).tolist() == ends.tolist()


def test_infill_of_lines_and_other_marks_gives_texts_back(odd, docs):
    marks = ("[a.]", "[b*]", "[c]")
    for rows in (odd, docs):
        made = infill.fill_in_middle(rows, ["doc_id", "text", "n"], unit="line", plain_share=0, spm_share=50, seed="x", marks=marks)
        assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
        back = made.select(F.coalesce("text", F.lit("")).alias("text"), infill.restored(F.col("output"), F.col("form"), marks).alias("back"), "form").collect()
        assert all(r["text"] == r["back"] for r in back)
    assert {r["form"] for r in back} == {"spm", "psm"} or {r["form"] for r in back} == {"spm", "psm", "plain"}
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs, ["doc_id"], unit="page")


# 12


def brute_runs(ids, least=12):
    n, found = len(ids), {}
    for p in range(1, n // 2 + 1):
        same = np.concatenate([[0], ids[:-p] == ids[p:], [0]]).astype(np.int8)
        edge = np.diff(same)
        for a, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if e - a + p >= max(least, 2 * p):
                found.setdefault((int(a), int(e) + p), p)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def plain_runs(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    found = brute_runs(np.array([ids[w] for w in words], np.int64))
    out = [True] * n
    for s, length, p in found:
        out[s + p : s + length] = [False] * (length - p)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    return (doc_id, len(found), *best, sha("".join(f"{s},{x},{p}\n" for s, x, p in found)), sha(" ".join(w for w, k in zip(words, out) if k)))


def test_runs_of_all_documents_are_those_of_brute_force(spark, odd, odd_dir):
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    for rows, path in ((spark.read.parquet(f"{SF}/documents.parquet"), SF), (odd.filter("doc_id is null or doc_id <> 8"), odd_dir)):
        want = [plain_runs(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()]
        got = [tuple(r[c] for c in columns) for r in runs.op12(spark, path).filter("doc_id is null or doc_id <> 8" if path == odd_dir else "true").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def made_words(rng, kind):
    if kind == "binary":
        return [rng.randrange(2) for _ in range(rng.randrange(1, 300))]
    if kind == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < rng.randrange(50, 900):
            a, b = b, b + a
        return b
    out = []
    while len(out) < rng.randrange(10, 1200):
        part = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 60))]
        out += part * rng.choice([1, 1, 2, 3, 7])
        if rng.random() < 0.4:
            out += out[-rng.randrange(1, 200) :]
    return out


@pytest.mark.parametrize("kind", ["binary", "fibonacci", "mixed"])
def test_runs_of_made_words_however_they_are_appended(kind):
    rng = random.Random(kind)
    for _ in range(60):
        ids = np.array(made_words(rng, kind), np.int64)
        least = rng.choice([2, 5, 12, 12, 40, 100])
        want = brute_runs(ids, least)
        catcher, at = runs.SquareCatcher(least), 0
        while at < len(ids):
            k = rng.choice([1, 1, 2, 3, 7, 64, 500])
            catcher.append(ids[at : at + k])
            at += k
        assert catcher.finish() == want
        assert runs.runs_of(ids, least) == want or len(ids) < least


def test_long_texts_of_one_word_and_of_long_periods_take_near_linear_time():
    assert runs.runs_of(np.zeros(400_000, np.int64)) == [(0, 400_000, 1)]
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 40, 300_000)
    x[100_000:300_000] = np.tile(x[100_000:140_000], 5)
    assert runs.runs_of(x) == [(100_000, 200_000, 40_000)]
    assert runs.runs_of(x, at_once=1000) == [(100_000, 200_000, 40_000)]
    words = np.tile(np.tile(np.arange(7), 30), 900)
    words[::7777] = 9
    assert runs.runs_of(words[:4000]) == brute_runs(words[:4000])
    assert runs.runs_of(words, at_once=5000) == runs.runs_of(words)


def test_names_that_clash_find_nothing_that_is_not_there(monkeypatch):
    monkeypatch.setattr(runs, "joined", lambda x, y: np.zeros(min(len(x), len(y)), np.uint64))
    ids = np.array(made_words(random.Random(3), "mixed")[:400], np.int64)
    assert runs.runs_of(ids) == brute_runs(ids)


def test_runs_as_they_are_and_what_is_left(odd):
    got = runs.find_runs(odd, ["doc_id", "runs", "n"], least=4)
    assert got.columns == ["doc_id", "n", "n_words", "runs", "collapsed"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[8]["runs"] == [(0, 40_000, 1)] and by[8]["collapsed"] == "word" and by[8]["n_words"] == 40_000
    assert by[10]["runs"] == [(0, 1500, 3)] and by[10]["collapsed"] == "a b c SPDX-License-Identifier: MIT"
    assert by[13]["collapsed"] == "all rights reserved" and by[2]["runs"] == [] and by[2]["collapsed"] == ""


# 13

PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_licenses(doc_id, text):
    words = PLAIN_WORD.findall((text or "").translate(LOWER))
    places = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        want = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    at = [i for i, _ in places]
    return doc_id, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_places_are_those_of_a_plain_version(spark, odd, odd_dir):
    for rows, path in ((spark.read.parquet(f"{SF}/documents.parquet"), SF), (odd, odd_dir)):
        want = [plain_licenses(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()]
        got = licenses.op13(spark, path).collect()
        assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in got), key=repr) == sorted(want, key=repr)
        assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "") for r in got)
        assert all({*r["base_labels"].split(",")} <= {*r["labels"].split(","), ""} for r in got)


def parsed(text):
    e = licenses.Expression(text)
    return e.text, e.valid, None if e.bound is None else licenses.CLASSES[e.bound], e.ids


@pytest.mark.parametrize(
    "text, want",
    [
        ("MIT", ("MIT", True, "permissive", ["mit"])),
        ("MIT. This file is", ("MIT", True, "permissive", ["mit"])),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MPL-2.0 */", ("GPL-2.0-only WITH Classpath-exception-2.0 OR MPL-2.0", True, "weak", ["gpl-2.0-only", "classpath-exception-2.0", "mpl-2.0"])),
        ("(MIT OR GPL-3.0+) and Apache-2.0\nnext", ("(MIT OR GPL-3.0+) and Apache-2.0", True, "permissive", ["mit", "gpl-3.0+", "apache-2.0"])),
        ("MIT OR GPL-3.0 AND MIT", ("MIT OR GPL-3.0 AND MIT", True, "permissive", ["mit", "gpl-3.0"])),
        ("(MIT OR GPL-3.0) AND GPL-2.0", ("(MIT OR GPL-3.0) AND GPL-2.0", True, "copyleft", ["mit", "gpl-3.0", "gpl-2.0"])),
        ("MIT AND", ("MIT AND", False, "permissive", ["mit"])),
        ("MIT OR (GPL-2.0 AND", ("MIT OR (GPL-2.0 AND", False, "permissive", ["mit", "gpl-2.0"])),
        ("MIT OR ((", ("MIT OR ((", False, "permissive", ["mit"])),
        ("LicenseRef-Mine", ("LicenseRef-Mine", True, "restricted", ["licenseref-mine"])),
        ("CC-BY-NC-4.0 or CC-BY-SA-4.0", ("CC-BY-NC-4.0 or CC-BY-SA-4.0", True, "copyleft", ["cc-by-nc-4.0", "cc-by-sa-4.0"])),
        ("", ("", False, None, [])),
        ("OR MIT", ("", False, None, [])),
        ("MIT) OR GPL", ("MIT", True, "permissive", ["mit"])),
    ],
)
def test_expressions(text, want):
    assert parsed(text) == want


def test_expressions_of_any_depth_agree_with_python():
    values = {"mit": 0, "mpl": 1, "gpl": 2, "other": 3}
    rng = random.Random(6)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([*values])
        return f"({made(depth - 1)} {rng.choice(['and', 'OR'])} {made(depth - 1)})"

    for _ in range(200):
        text = f"{made(5)} or {made(4)} AND {made(3)}"
        e = licenses.Expression(text)
        assert e.valid and e.text == text
        assert e.bound == value(text.lower(), values)
    deep = "(" * 50_000 + "mit" + ")" * 50_000
    assert parsed(deep) == (deep, True, "permissive", ["mit"])


def value(text, values):
    """A plain recursive evaluation: or weakest, then and."""
    text = text.strip()
    for op, f in ((" or ", min), (" and ", max)):
        depth = 0
        for m in re.finditer(rf"\(|\)|{op}", text):
            depth += {"(": 1, ")": -1}.get(m[0], 0)
            if m[0] == op and depth == 0:
                return f(value(text[: m.start()], values), value(text[m.end() :], values))
    return values[text] if text in values else value(text[1:-1], values)


def test_tags_and_notices(spark):
    texts = [
        "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only\nint x;", "spdx license identifier without a colon", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
        "GNU Lesser General Public License", "plain prose about a licence to drive", "SPDX-License-Identifier:\nMIT", "see SPDX-License-Identifier: BSD-3-Clause and SPDX-License-Identifier: ISC",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.find_licenses(rows, ["doc_id", "text"]).collect()}
    assert got[0]["labels"] == ["apache-2.0", "gpl-2.0-only", "mit"] and got[0]["expressions"][0]["class"] == "copyleft" and got[0]["score"] > 0.9
    assert got[1]["labels"] == [] and got[1]["score"] == 0 and got[6]["labels"] == []
    assert got[2]["labels"] == ["mit"] and got[3]["labels"] == ["cc-by", "cc-by-nc"] and got[4]["labels"] == ["gpl", "lgpl"]
    assert got[5]["labels"] == [] and got[7]["labels"] == ["bsd-3-clause", "isc"]
    own = licenses.find_licenses(rows, ["doc_id"], base={"to drive": "car"}, notices={}).filter("size(places) > 0").collect()
    assert [(r["doc_id"], r["base_labels"], r["places"][0]["word"]) for r in own] == [(5, ["car"], 5)]
