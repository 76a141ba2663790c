"""Language identification by language-bitmask n-gram filters.

A Bloom filter for each language is stored bit-sliced: position p of the table holds a mask with one bit a
language, so the AND of an n-gram's k positions is the set of all languages whose filter holds it, in k reads
for any number of languages. A text's popcount for a language is how many of its n-grams have that bit; the
filter's false-positive rate f (its fill to the power k) adds about f(N - hits) to it, so the corrected count is
(popcount - f N) / (1 - f). The largest corrected count decides; its share of N lies in score.

A language's filter holds its typical n-grams of one to four letters, within words, where a leading or trailing blank
marks a word's edge: all whose share of the language's n-grams is at least ``ratio`` of their share in any other language,
by documents, and which the share ``spread`` of its documents has. They are learned from at most about ``max_docs``
documents a language (a documented bound; documents are drawn by a hash of their id). The table is filled by tasks, slot by
slot; what goes through the driver and is broadcast is the table, of 2**``most_bits`` slots at most: more n-grams fill it
further, which the correction of the counts allows for. Everything is predicted from whole texts.

Edge cases: a null text or one without letters is ``und`` with score 0; with nothing to learn from, every text
is; a text with letters of which no n-gram is known gets the language with the most training documents and score
0; ties go to the language first by code point; rows with null language or id teach nothing (id) or are skipped
(language); repeated rows are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.llm.common import crc_fold, cut, mix64, pieces, row_of, table

SIZES = (1, 2, 3, 4)
UNKNOWN = "und"
#: Bytes of text that are looked at together.
PIECE = 1 << 20
#: Runs of letters, and of a few numerals that count as none.
WORD = re.compile(r"[^\W\d_]+")
#: Words whose popcounts a worker keeps; beyond that it starts anew.
WORDS_KEPT = 150_000
#: Words whose n-grams are counted together, which bounds the arrays of a worker.
WORDS_AT_ONCE = 1 << 13
_letters: list[np.ndarray] = []
_kept: dict[str, tuple] = {}


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, text's place) of all n-grams, and for each text how many letters it has."""
    lower = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower])
    is_letter = letters()[points]
    count = np.bincount(doc[is_letter], minlength=len(texts))
    keep = is_letter.copy()
    if not keep.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64), count
    keep[1:] |= is_letter[:-1]  # one blank after each word
    c, doc = np.where(is_letter, points, 0)[keep].astype(np.uint64), doc[keep]
    c, doc = np.r_[np.uint64(0), c], np.r_[doc[:1], doc]
    codes, docs = [], []
    blank = c == 0
    inner = np.cumsum(blank)
    for n in SIZES:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : j + m]
        first, last = blank[:m], blank[n - 1 :]
        ok = (inner[n - 1 :] - inner[:m] + first == first.astype(int) + last) if n > 1 else ~first
        if n == 2:
            ok &= ~(first & last)
        codes.append(mix64(h[ok]))
        docs.append(doc[n - 1 :][ok])
    return np.concatenate(codes) if codes else np.empty(0, np.uint64), np.concatenate(docs) if docs else np.empty(0, np.int64), count


@dataclass
class Model:
    """languages by code point; table: masks of the bit-sliced filters, a row a position, a word each 64 languages."""

    languages: list[str]
    usual: int
    table: np.ndarray
    probes: int
    slots: int = 0

    def positions(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        mask, step = np.uint64((self.slots or len(self.table)) - 1), mix64(codes ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        for k in range(self.probes):
            yield (codes + np.uint64(k) * step) & mask

    def holders(self, codes: np.ndarray) -> np.ndarray:
        """The mask of languages that hold each n-gram."""
        out = np.full((len(codes), self.table.shape[1]), np.uint64(0xFFFFFFFFFFFFFFFF))
        for p in self.positions(codes):
            out &= self.table[p]
        return out

    def false_rates(self) -> np.ndarray:
        return np.array([np.mean(self.table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) ** self.probes for i in range(len(self.languages))])

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. N-grams lie within words, so a word's popcounts are looked up once and kept."""
        held, words = _kept.get("words", (None, None))
        if held is not self or len(words) > WORDS_KEPT:  # a worker outlives models: it keeps the words of one
            words = Words()
            _kept["words"] = self, words
        places = [list(map(words.__getitem__, WORD.findall((t or "").lower()))) for t in texts]
        words.count(self)
        flat = np.fromiter(chain.from_iterable(places), np.int64)
        ends = np.cumsum([len(x) for x in places])
        starts = np.r_[0, ends[:-1]]
        got = np.zeros((len(texts), len(self.languages) + 2))
        some = ends > starts
        if some.any():
            got[some] = np.add.reduceat(words.rows[flat], starts[some], axis=0, dtype=np.float64)
        got = got.T
        hits, total, n_letters = got[:-2], got[-2], got[-1]
        f = self.false_rates()[:, None]
        counts = np.maximum(hits - f * total, 0) / np.maximum(1 - f, 1e-9)
        best = counts.argmax(axis=0)
        top = counts.max(axis=0)
        best[top <= 0] = self.usual
        score = np.where(n_letters > 0, np.clip(top / np.maximum(total, 1), 0, 1), 0.0)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, n_letters)], score


class Words(dict):
    """Word to row; rows holds popcounts by language, n-grams and letters of each word."""

    def __init__(self):
        self.new: list[str] = []
        self.rows = np.empty((0, 0), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def count(self, model: Model) -> None:
        if not self.new:
            return
        k = len(model.languages)
        fresh = np.zeros((len(self.new), k + 2), np.float32)
        for s in range(0, len(self.new), WORDS_AT_ONCE):
            part = fresh[s : s + WORDS_AT_ONCE]
            codes, of, part[:, k + 1] = grams(self.new[s : s + WORDS_AT_ONCE])
            held = model.holders(codes)
            part[:, k] = np.bincount(of, minlength=len(part))
            for i in range(k):
                part[:, i] = np.bincount(of[(held[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)], minlength=len(part))
        if len(self) > len(self.rows):  # room for twice as many
            self.rows = np.vstack([self.rows.reshape(-1, k + 2)[: len(self) - len(self.new)], np.zeros((2 * len(self), k + 2), np.float32)])
        self.rows[len(self) - len(self.new) : len(self)] = fresh
        self.new = []


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = 1000, spread: float = 0.01, ratio: float = 0.6, probes: int = 4, bits: int = 16, most_bits: int = 22) -> Model | None:
    """A model of the languages of docs; see the module for the bounds."""
    docs = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    sizes = {r[0]: r[1] for r in docs.groupBy(lang).count().collect()}
    if not sizes:
        return None
    names = sorted(sizes)
    share = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(min(1.0, max_docs / sizes[n])))])
    drawn = docs.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < share[F.col(lang)] * (1 << 20))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in pieces([len(t) for t in texts], PIECE):
                codes, doc, _ = grams(texts[i:j])
                of = np.array([names.index(x) for x in langs[i:j]])
                for one in np.unique(of):
                    mine = of[doc] == one
                    if not mine.any():
                        continue
                    order = np.argsort(codes[mine], kind="stable")
                    code, place = codes[mine][order], doc[mine][order]
                    new = np.r_[True, code[1:] != code[:-1]]
                    counts = np.cumsum(new | np.r_[True, place[1:] != place[:-1]])  # a document counts once
                    last = np.flatnonzero(np.r_[new[1:], True])
                    code, n = code[last], np.diff(np.r_[0, counts[last]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), one, np.int32)), pa.array(code.view(np.int64)), pa.array(n)], ["l", "code", "n"])

    seen = cut(drawn.select(F.col(text).alias("t"), F.col(lang).alias("l")).mapInArrow(counted, "l int, code long, n long").groupBy("l", "code").agg(F.sum("n").alias("n")))
    all_of = {r[0]: float(r[1]) for r in seen.groupBy("l").agg(F.sum("n")).collect()}
    total = F.create_map(*[x for k, v in all_of.items() for x in (F.lit(k), F.lit(v))]) if all_of else F.lit(None)
    seen = seen.withColumn("p", F.col("n") / total[F.col("l")] if all_of else F.lit(0.0)).withColumn("top", F.max("p").over(Window.partitionBy("code")))
    least = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(spread * min(max_docs, sizes[n])))])
    typical = cut(seen.where((F.col("p") >= ratio * F.col("top")) & (F.col("n") >= least[F.col("l")])).select("l", "code"))
    size = 1 << min(most_bits, max(10, math.ceil(math.log2(max(1, typical.count()) * bits / 2))))
    model = Model(names, max(range(len(names)), key=lambda i: (sizes[names[i]], -i)), np.zeros((size, -(-len(names) // 64)), np.uint64), probes)
    shape = Model(names, 0, np.zeros((0, 1), np.uint64), probes, size)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, codes = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            mask = (np.uint64(1) << (of % 64).astype(np.uint64)).view(np.int64)
            for at in shape.positions(codes):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array((of // 64).astype(np.int32)), pa.array(mask)], ["slot", "word", "mask"])

    filled = typical.mapInArrow(placed, "slot int, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()  # the table's slots at most
    model.table[filled["slot"].to_numpy(), filled["word"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    return model


def identify(docs: DataFrame, model: Model | None, text: str = "text", within: str | None = None) -> DataFrame:
    """Adds lang_pred and score to docs; columns of these names are replaced. The text may be a field within a struct."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")
    at = names.index(within or text)
    held = docs.sparkSession.sparkContext.broadcast(model)  # of a bounded size

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs, scores = (b.column(at).field(text) if within else b.column(at)).to_pylist(), [], []
            for i, j in pieces([len(t or "") for t in texts], PIECE):
                if held.value is None:
                    x, s = [UNKNOWN] * (j - i), np.zeros(j - i)
                else:
                    x, s = held.value.decide(texts[i:j])
                langs += x
                scores.append(s)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*names, "lang_pred", "score"])

    return docs.select(*names).mapInArrow(found, schema)


def of_known_languages(docs: DataFrame, least: float = 0.3, **how) -> DataFrame:
    """docs less those of no language: without letters, or with less than the share least of their n-grams in the best one.

    The model is learned from the rows of docs that have a language.
    """
    model = learn(docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang"), **how)
    # any names may be there; the text goes to Python once, within its row
    packed = docs.select(row_of(docs, text=F.col("text").cast("string")).alias("row"))
    return identify(packed, model, "text", "row").where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    model = learn(docs.where(crc_fold(F.col("doc_id"), 5) != 0))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_langid": op1_langid}
ORACLES: dict[str, str] = {}
