"""The quality classifier: tokens and sums against plain Python, held-out labels, and edge cases."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from held import DATA
from pyspark.sql import functions as F

from frameloom.llm import op13_quality as Q
from frameloom.llm import registry


def slow_tokens(text):
    """Classes of equal tokens: (kind, name)."""
    out, last = [], None
    for t in re.findall(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+", text):
        kind = "n" if t.isdigit() else "w" if t[0].isalpha() else "s"
        name = ("n", min(len(t), 6)) if kind == "n" else ("A",) if kind == "w" and len(t) > 1 and t.isupper() else ("w", t.lower()) if kind == "w" else ("s", t[:3])
        out.append(("again",) if name == last else name)
        last = name
    return out


def test_tokens():
    texts = ["", " ", "The the THE cat's 12 1234567 99!! !!! ????x", "a_b __ É é ÉÉ\tzwölf\n\nA A a", "one", "one one one\x1fone", "ß SS ss 中文 中文", "1 22 22"] + ["x" * 50]
    found, bounds = Q.tokens(texts)
    named = {}
    for i, t in enumerate(texts):
        want, got = slow_tokens(t), found[bounds[i] : bounds[i + 1]].tolist()
        assert len(want) == len(got), t
        for w, g in zip(want, got):
            assert named.setdefault(w, g) == g
    assert len(set(named.values())) == len(named)


def test_contexts_against_plain_sums(monkeypatch, prose):
    monkeypatch.setattr(Q, "TOKENS", 50)
    texts = [prose("en", 70, i) for i in range(4)] + ["", None, "one", "two words"]
    c = Q.Contexts()
    c.add(texts[:3])
    c.add(texts[3:])
    c.flush()
    index, sums, counts = Q.index_vectors(), np.zeros((Q.BUCKETS, Q.DIMS)), Counter()
    for t in texts:
        x = Q.tokens([t or ""])[0].tolist()
        counts.update(x)
        for i, a in enumerate(x):
            for j in range(max(0, i - 2), min(len(x), i + 3)):
                if i != j:
                    sums[a] += index[x[j]]
    table = c.table()
    assert (table[:, 1:] == sums).all() and {k: v for k, v in enumerate(table[:, 0].tolist()) if v} == dict(counts)


def test_long_texts_in_runs(monkeypatch, prose):
    text = prose("de", 3000, 1)
    vectors = np.random.default_rng(1).normal(size=(Q.BUCKETS, 6)).astype(np.float32)
    whole = Q.features([text, "a", text], vectors)
    monkeypatch.setattr(Q, "PIECE", 1000)
    assert np.allclose(Q.features([text, "a", text], vectors), whole, atol=1e-3)


def test_gradient_and_temperature():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(20, 5)), (rng.random(20) > 0.4).astype(float)
    layers = [rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4), np.array(0.3)]
    value = lambda ls: Q.loss(np.maximum(x @ ls[0] + ls[1], 0) @ ls[2] + ls[3], y) + 0.05 * ((ls[0] ** 2).sum() + (ls[2] ** 2).sum())
    for k, g in enumerate(Q.gradient(x, y, layers, 0.1)):
        for at in np.ndindex(layers[k].shape):
            up, down = ([w.copy() for w in layers] for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert abs((value(up) - value(down)) / 2e-6 - g[at]) < 1e-5
    logits = np.log(np.array([0.9, 0.9, 0.9, 0.9, 0.1] * 40) / np.array([0.1, 0.1, 0.1, 0.1, 0.9] * 40))
    truth = (rng.random(200) < 1 / (1 + np.exp(-logits))).astype(float)
    best = Q.temperature(logits * 3, truth)
    assert all(Q.loss(logits * 3 / best, truth) <= Q.loss(logits * 3 / t, truth) + 1e-9 for t in np.linspace(0.5, 9, 40))


def noisy(text, kind):
    words = text.split()
    return text if kind == 1 else " ".join(w.upper() + "!!" for w in words) if len(words) % 2 else " ".join(w + random.Random(w).choice(["$$$", "###", "%%%"]) for w in words)


def test_held_out_documents(spark, prose):
    rows = [(i, noisy(prose("en" if i % 3 else "de", 20 + i % 40, i), int(i % 4 != 0))) for i in range(600)]
    odd = [(700, None), (701, ""), (None, prose("en", 30, 701)), (None, None), (702, rows[5][1]), (702, rows[4][1]), (703, "word " * 30000)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumns({"a.b": F.lit(1), "score": F.lit("x"), "row": F.lit(2), "k": F.lit(3)})
    labels = [(i, int(i % 4 != 0)) for i in range(0, 600) if zlib.crc32(str(i).encode()) % 5] + [(8, 1), (None, 0), (9, None), (10, 7), (702, 1), (99999, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, label int").withColumn("text", F.lit("clash"))
    model = Q.train(docs, frame)
    got = Q.scored(docs, model).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows + odd) and all(r["a.b"] == 1 and r.row == 2 and 0 <= r.score <= 1 for r in got)
    held = [(r.score, r.doc_id % 4 != 0) for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 80 and sum((s >= 0.5) == y for s, y in held) >= 0.97 * len(held)
    of = {r.text: r.score for r in got}
    assert all(of[r.text] == r.score for r in got)
    again = Q.scored(docs, Q.train(docs.repartition(3), frame)).collect()
    assert Counter((r.doc_id, r.text, r.score) for r in again) == Counter((r.doc_id, r.text, r.score) for r in got)
    none = Q.scored(docs, Q.train(docs, frame.where("false"))).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    empty = docs.where("false")
    assert Q.scored(empty, Q.train(empty, frame)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_quality_of_whole_table(spark):
    rows = registry.queries()["op13_quality"](spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good, bad = ([r.score for r in rows if labels.get(r.doc_id) == y and r.held_out] for y in (1, 0))
    assert sum(a > b for a in good for b in bad) >= 0.85 * len(good) * len(bad)
