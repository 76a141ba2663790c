"""Near copies of the pipeline's second stage: planted similarities of 0.8 to 0.95, brute force and edge cases."""

import random
from collections import Counter

import corpus_pipeline

from frameloom.llm import near_copies, op7_simhash


def sets(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(words, n, r):
    w = words[:]
    for k in r.sample(range(5, len(w) - 5), n):
        w[k] = f"changed{r.randint(0, 10**9)}"
    return " ".join(w)


def test_planted_near_copies(spark, prose):
    r = random.Random(1)
    base = [prose("en", 250, i).split() for i in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, edited(w, 1 + i % 5, r)) for i, w in enumerate(base)]  # about 0.96 to 0.81
    rows += [(200 + i, edited(w, 12, r)) for i, w in enumerate(base[:10])]  # below 0.8
    rows += [(300, "one two"), (301, "One  two"), (302, "two one"), (303, None), (304, " \n"), (305, prose("de", 20000, 1)), (306, "x " + prose("de", 20000, 1)), (7, "namesake of its own"), (None, "null twin"), (None, "null twin"), (None, rows[3][1]), (400, "tied"), (400, "tied")]
    s = [sets(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if similar(s[i], s[j]) >= 0.8]
    assert {j for j in range(40)} <= {j for _, j in pairs} and any(0.8 <= similar(s[i], s[j]) < 0.85 for i, j in pairs)
    at = list(range(len(rows)))
    for i, j in pairs:
        a, b = at[i], at[j]
        at = [min(a, b) if x in (a, b) else x for x in at]
    want = Counter()
    for c in set(at):
        ids = [rows[i][0] for i in range(len(rows)) if at[i] == c]
        want[min((x for x in ids if x is not None), default=None)] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.selectExpr("*", "1 as unit", "2 as band", "map('k', doc_id) as h1")
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert out.columns == docs.columns
    kept = out.collect()
    assert Counter(x.doc_id for x in kept) == want
    assert want[7] == 2 and want[None] == 1 and want[400] == 1 and want[303] == 1
    assert corpus_pipeline.near_copies(spark, docs.where("false"), "").count() == 0


def test_fingerprints_find_what_bands_miss(spark, prose):
    rows = []
    for i in range(12):
        often = [f"w{i}x{k}" for k in range(101)] * 60  # fingerprints count repeats, sets don't
        tail = lambda n, k: [f"t{i}y{n}z{k}y{j}" for j in range(n)]  # noqa: B023, E731
        rows += [(10 * i + k, " ".join(often + tail(8, k))) for k in range(2)]  # 0.86
        rows += [(10 * i + 5 + k, " ".join([f"v{i}x{k}" for k in range(101)] * 60 + tail(40, k))) for k in range(2)]  # 0.54
    s = [sets(t) for _, t in rows]
    assert all((similar(s[i], s[i + 1]) >= 0.8) == (rows[i][0] % 10 == 0) for i in range(0, len(rows), 2))
    assert all((op7_simhash.fingerprint(rows[i][1]) ^ op7_simhash.fingerprint(rows[i + 1][1])).bit_count() <= 3 for i in range(0, len(rows), 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # a single band of 60 minimum hashes: pairs of 0.86 share it in one case of ten thousand
    kept = {r.doc_id for r in near_copies.without_near_copies(docs, rows=60, miss=0.9999).collect()}
    assert kept == {i for i, _ in rows if i % 10 != 1}
