"""Operator 11: fill-in-middle transformation, cut points found by SWAR words.

The texts of an Arrow batch lie one after another in one UTF-8 buffer. It is viewed as uint64 words, eight bytes each, and the
bytes that end a unit are marked by arithmetic on whole words: a character ends before each byte that isn't a continuation
byte; a line ends at a line feed. Marks are counted by a bit count per word and summed up, so that the k-th unit of any text is
found by a search among the cumulative counts for its word, and within the word by a select: a multiplication gives the
counts up to each byte, and a comparison of all eight at once tells how many bytes stand before the wanted one. All
cuts of a batch are found together; no text is decoded.

Two cuts at unit numbers drawn from a hash of the id part a text in prefix, middle and suffix. The output is, by a draw,

    plain: the text        psm: <P>prefix<S>suffix<M>middle        spm: <S>suffix<P>prefix<M>middle

Texts that are empty, or hold one of the marks, stay plain, so that ``restored`` gives every text back exactly.

One pass, no shuffle; memory is one slice of a batch. Defined results: a null text counts as empty; a null doc_id draws as
an empty id, and rows that repeat a doc_id and a text have the same result; texts of any length are cut as a whole; columns of docs
that are called like a result give way; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table
from .token_output import slices

MARKS = ("<P>", "<S>", "<M>")
PLAIN_SHARE, SPM_SHARE = 10, 20
SEED = "1"
_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_LINE = np.uint64(0x0A0A0A0A0A0A0A0A)
_U = np.uint64
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def words_of(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian uint64 words, the last one filled up with zeros."""
    out = np.zeros(len(data) // 8 + 1, "<u8")
    out.view(np.uint8)[: len(data)] = data
    return out


def character_ends(words: np.ndarray) -> np.ndarray:
    """Bit 0 of each byte that ends a character: the byte after it isn't 10xxxxxx. What follows the last word begins anew."""
    begins = ~((words >> _U(7)) & ~(words >> _U(6))) & _ONES
    after = np.append(begins[1:], _ONES)
    return (begins >> _U(8)) | ((after & _U(1)) << _U(56))


def line_ends(words: np.ndarray) -> np.ndarray:
    """Bit 0 of each byte that is a line feed."""
    x = words ^ _LINE
    return (~(((x & _LOW7) + _LOW7) | x) & _HIGH) >> _U(7)


class Units:
    """The units of texts that lie one after another in a buffer: ``starts`` (as many and one) are their places in it."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, unit: str = "character"):
        self.starts, words = starts, words_of(data)
        self.marks = (character_ends if unit == "character" else line_ends)(words)
        if unit != "character" and len(data):  # the rest after a text's last line feed is a line, too
            ends = starts[1:][np.diff(starts) > 0] - 1
            np.bitwise_or.at(self.marks, ends >> 3, _U(1) << (_U(8) * (ends & 7).astype("u8")))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)])
        self.base = self.rank(starts)
        self.counts = np.diff(self.base)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Units that end before each place."""
        word, byte = at >> 3, (at & 7).astype("u8")
        below = self.marks[word] & ((_U(1) << (_U(8) * byte)) - _U(1))
        return self.before[word] + np.bitwise_count(below)

    def cut(self, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place in the buffer where the first k units of each text end."""
        wanted = self.base[text] + k  # as the number of a unit from 1 on, over all texts
        word = np.minimum(np.searchsorted(self.before, wanted, "left") - 1, len(self.marks) - 1).clip(0)
        left = (wanted - self.before[word]).clip(1, 8).astype("u8")
        upto = self.marks[word] * _ONES  # in each byte: marks up to and with it
        reached = ((upto | _HIGH) - left * _ONES) & _HIGH
        return np.where(k > 0, 8 * word + 8 - np.bitwise_count(reached).astype(np.int64) + 1, self.starts[text])


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string array and where its texts start in them (and the last one ends); nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def _cut(columns: list[str], unit: str, marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part["text"]
                data, starts = buffer_of(texts)
                units = Units(data, starts, unit)
                n = units.counts
                a, b = (part[h].to_numpy().astype(np.int64) % (n + 1) for h in ("h1", "h2"))
                rows = np.arange(len(part))
                first, last = np.minimum(a, b), np.maximum(a, b)
                one, two = units.cut(rows, first), units.cut(rows, last)
                held = np.zeros(len(part), bool)
                for x in marks:
                    held |= pc.fill_null(pc.match_substring(texts, x), False).to_numpy(zero_copy_only=False)
                form = np.where((n == 0) | held | part["plain"].to_numpy(zero_copy_only=False), "plain", np.where(part["spm"].to_numpy(zero_copy_only=False), "spm", "psm"))
                whole, out = memoryview(data), []
                for f, at, i, j, end in zip(form, starts, one, two, starts[1:]):
                    if f == "plain":
                        out.append(bytes(whole[at:end]))
                    elif f == "psm":
                        out.append(b"".join((p, whole[at:i], s, whole[j:end], m, whole[i:j])))
                    else:
                        out.append(b"".join((s, whole[j:end], p, whole[at:i], m, whole[i:j])))
                none = form == "plain"
                yield pa.RecordBatch.from_arrays(
                    [*(part[c] for c in columns), pa.array(n), pa.array(form, pa.string()), pa.array(first, mask=none), pa.array(last - first, mask=none), pa.array(out, pa.binary()).cast(pa.string())],
                    names=[*columns, *(x.split()[0] for x in RESULT.split(", "))],
                )

    return run


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2^32 from the digest of the seed and an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, columns: list[str], unit: str = "character", plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE, seed: str = SEED, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The named columns of docs with ``n`` (units), ``form``, ``prefix_chars`` and ``middle_chars`` (units; null if plain) and
    ``output``. plain_share and spm_share: percent of texts that stay, and of the others that put the suffix first."""
    ship(docs.sparkSession)
    if unit not in ("character", "line"):
        raise ValueError(f"unit: {unit}")
    own = [x.split()[0] for x in RESULT.split(", ")]
    kept = [c for c in columns if c not in own]
    inner = {c: f"given {i}" for i, c in enumerate(kept)}
    h = draws(F.col("doc_id"), seed)
    given = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in inner.items()], F.col("text").cast("string").alias("text"), h[0].alias("h1"), h[1].alias("h2"), (h[2] % 100 >= 100 - plain_share).alias("plain"), (h[3] % 100 < spm_share).alias("spm"))
    schema = ", ".join([f"`{c}` {t}" for c, t in given.select(*inner.values()).dtypes] + [RESULT])
    return given.mapInArrow(_cut(list(inner.values()), unit, marks), schema).withColumnsRenamed({x: c for c, x in inner.items()})


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of the given form was made of."""
    parts = F.split(output, "|".join(map(re.escape, marks)))
    whole = lambda *at: F.concat(*[parts[i] for i in at])
    return F.when(form == "psm", whole(1, 3, 2)).when(form == "spm", whole(2, 3, 1)).otherwise(output)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), ["doc_id"])
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
k AS (SELECT doc_id, t, length(t) AS n, ('0x' || d[1:8])::UBIGINT::BIGINT AS h1, ('0x' || d[9:16])::UBIGINT::BIGINT AS h2, ('0x' || d[17:24])::UBIGINT::BIGINT AS h3, ('0x' || d[25:32])::UBIGINT::BIGINT AS h4 FROM h),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
"""
