"""The mix against the entropy optimum found by bisection, and its copies against the threshold rule walked in a list."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from frameloom.llm import op5_mix


def optimum(sizes, target, most=2.0):
    """Rates min(most, exp(lambda n / mean)) whose words meet the target: lambda by bisection."""
    some = [n for n in sizes if n]
    mean = sum(some) / len(some)
    rates = lambda lam: [min(most, math.exp(min(lam * n / mean, 5.0))) if n else 0.0 for n in sizes]
    lo, hi = -200.0, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(n * r for n, r in zip(sizes, rates(mid))) < target else (lo, mid)
    return rates((lo + hi) / 2)


@pytest.mark.parametrize("share", [0.4, 1.5, 1.9])
def test_rates_are_optimal_and_copies_follow_the_rule(spark, share):
    r = random.Random(7)
    rows = [(i, r.choice(["a", "b", "b", "c", None]), int(r.paretovariate(0.9) * 3) % 4000) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    u = {x.doc_id: x.u for x in docs.select("doc_id", (F.shiftrightunsigned(F.xxhash64("doc_id", "size"), 11) / float(1 << 53)).alias("u")).collect()}
    got = defaultdict(list)
    for x in op5_mix.mix(docs, share=share).collect():
        got[x.source].append(x)
    assert sum(len(v) for v in got.values()) == len(rows)
    for found in got.values():
        target, sizes = found[0].target, [x.size for x in found]
        if target >= 2 * sum(sizes) - 1e-6:
            assert all(x.copies == (2 if x.size else 0) for x in found)
            continue
        want = optimum(sizes, target)
        assert all(abs(x.rate - w) < 1e-3 for x, w in zip(found, want))
        assert abs(sum(x.size * x.rate for x in found) - target) < 1
        # the words that whole copies leave go to the documents next in line, as long as they fit
        copies = {x.doc_id: math.floor(x.rate) if x.size else 0 for x in found}
        left = target - sum(x.size * copies[x.doc_id] for x in found)
        for x in sorted((x for x in found if x.size and copies[x.doc_id] < 2), key=lambda x: (u[x.doc_id] - (x.rate - copies[x.doc_id]), x.doc_id)):
            if x.size > left:
                break
            left -= x.size
            copies[x.doc_id] += 1
        off = [x for x in found if x.copies != copies[x.doc_id]]
        assert len(off) <= 6 and all(abs(x.copies - copies[x.doc_id]) == 1 for x in off)  # what makes up the rest, one a round
        assert abs(sum(x.taken for x in found) - target) <= max(1.0, left)
