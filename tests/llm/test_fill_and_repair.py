"""Fill-in-middle and conversation repair against plain Python, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from frameloom.llm import op11_fim, op12_repair

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def slow_fill(key, text):
    t = text or ""
    h = [int(hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    u = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, None, t
    return (len(u), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(u), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, prose):
    r = random.Random(11)
    odd = ["a", "Z", "é", "\x1f", "\x1b", "\x1b0", "\x1b1", "$1", "\\", "<", ">", "P", "<S", "\n", "\r\n", "𝒳", " ", "0", "\0", "ab"]
    rows = [(i, "".join(r.choice(odd) for _ in range(r.randint(0, 30)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "no key here"), (None, None), (1002, "a <M> in it"), (1003, prose("en", 60000, 3)), (1004, "x"), (1004, "x"), (-5, "minus five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in ("n", "form", "row", "whole", "marks", "a.b", "h0", "output")})
    got = op11_fim.transformed(docs).withColumn("back", op11_fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((x.doc_id, *[x[c] for c in op11_fim.MADE], x["a.b"], x.row) for x in got) == Counter((i, *slow_fill(i, t), "a.b", "row") for i, t in rows)
    assert Counter((x.doc_id, x.back) for x in got) == Counter((i, t or "") for i, t in rows)
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert op11_fim.transformed(docs.where("false")).count() == 0


def test_sentinels_must_not_overlap():
    for bad in (("a", "b", ""), ("x", "x", "y"), ("<a", "<", "b"), ("aba", "c", "d"), ("ab", "bc", "d")):
        with pytest.raises(ValueError):
            op11_fim.Sentinels(*bad)


def slow_repair(turns):
    """turns(initial, fault) -> the cheapest (cost, audit) by trying all edits, two inserted turns at most in each gap."""
    best = None
    inserted = [(), *(((("I", x),)) for x in "ua"), *(((("I", x), ("I", y))) for x in "ua" for y in "ua")]
    for edits in itertools.product(*[[("D", "")] if f in (1, 2) else [("K", x), ("R", "u"), ("R", "a"), ("D", "")] for x, f in turns]):
        for fill in itertools.product(inserted, repeat=len(turns) + 1):
            path = [*fill[0]]
            for e, g in zip(edits, fill[1:]):
                path += [e, *g]
            if not re.fullmatch("(s?(ua)+)?", "".join(x for _, x in path)):
                continue
            cost = sum({"K": 0, "R": 1, "D": 2, "I": 5}[k] for k, _ in path) + sum(5 for (k, _), (_, f) in zip(edits, turns) if f == 3 and k != "D")
            found = cost, "".join(k for k, _ in path)
            best = found if best is None or found < best else best
    return best


def test_cheapest_edits():
    r = random.Random(12)
    cases = [[(r.choice("suat"), r.choice((0, 0, 0, 1, 2, 3))) for _ in range(r.randint(1, 3))] for _ in range(25)]
    for turns in cases:
        want = slow_repair(turns)
        m = op12_repair.matrix([(x, f, 0) for x, f in turns])
        assert op12_repair.best(m) == want
        for k in range(1, len(turns)):  # cut anywhere, the parts give the same
            parts = [op12_repair.matrix([(x, f, 0) for x, f in p]) for p in (turns[:k], turns[k:])]
            assert op12_repair.best(op12_repair.composed(*parts)) == want


def whole_repair(rows):
    """A conversation's rows(turn, role, text) -> facts, cost, audit, repaired text; the pass over one list, as it is told."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0)
        seen.add((role, text))
    known = [t for t, _, _ in rows if t is not None]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    layer = op12_repair.closed({0: (0, "")})
    for (_, role, _), f in zip(rows, faults):
        layer = op12_repair.step(layer, role[:1], f, 0)
    cost, audit = min(layer[s] for s in (0, 3) if s in layer)
    lines, at = [], iter(rows)
    for letter in audit:
        turn = None if letter == "I" else next(at)
        if letter != "D":
            last = lines[-1][0][0] if lines else ""
            role = turn[1] if letter == "K" else "assistant" if last == "u" else "user"
            lines.append((role, "" if turn is None else turn[2]))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    return (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, sha(text)), lines


def test_conversations(spark):
    r = random.Random(5)
    texts = ["Yes.", "No", "Why?", " \t", "", "Go!", "Well. \n", None, "a. b", "é!"]
    role = lambda: r.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""])
    rows = [(c, r.choice([None, *range(6), *range(6)]), role(), r.choice(texts)) for c in range(150) for _ in range(r.randint(1, 6))]
    rows += [(None, t, role(), r.choice(texts)) for t in range(5)] + [(700, t, "user", "Same.") for t in range(40)] + [(701, 3, "user", "Same.")] * 30
    rows += [(900, t, ("user", "assistant")[t % 2] if r.random() < 0.9 else role(), f"Turn {t}." if r.random() < 0.9 else r.choice(texts)) for t in range(1500) for _ in range(1 + (t % 97 == 0))]
    rows += [(901, -(2**63), "user", "Far."), (901, 2**63 - 1, "assistant", "Off."), (902, 1, "user", "x" * 300000 + "."), (902, 2, "assistant", "y")]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows += [(dropped, 1, "user", "Gone.")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit(n) for n in ("n", "part", "k", "a.b")})
    want, lines = {}, {}
    for c, _, _, _ in rows:
        want[c] = []
    for c, t, x, y in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x, y = " " if x is None else x, " " if y is None else y
        y = "" if code == 1 else re.sub("[.!?]", "", y) if code == 2 else y
        want[c] += [(t, "user" if code == 4 else x, y)] * {0: 0, 3: 2}.get(code, 1)
    for c, x in want.items():
        want[c], lines[c] = whole_repair(x) if x else ((0, 0, 0, 0, 0, 0, "", sha("")), [])
        want[c] = ((want[c][0] if want[c][0] < 2**63 else None), *want[c][1:])
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 7):  # many partitions cut the long conversation
            spark.conf.set("spark.sql.shuffle.partitions", n)
            repairs = op12_repair.repair(op12_repair.damaged(docs))
            got = {x.conv_id: tuple(x)[1:] for x in repairs.collect()}
            assert got == want
        made = {}
        for x in op12_repair.repaired_turns(op12_repair.damaged(docs), repairs).collect():
            made.setdefault(x.conv_id, {})[x.turn] = (x.role, x.text)
        assert {c: [t[i] for i in range(len(t))] for c, t in made.items()} == {c: x for c, x in lines.items() if x}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert op12_repair.repair(op12_repair.damaged(docs.where("false"))).count() == 0
