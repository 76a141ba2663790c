"""Secrets glued to names by = and in runs that mix separators."""

import base64
import math
import random
import time
from collections import Counter

import numpy as np

from frameloom.llm import op10_secrets

AWS = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzXaMpLqKeYd8"


def test_names_and_parameters_are_parted_from_secrets(spark):
    r = random.Random(7)
    keys = [base64.b64encode(r.randbytes(30)).decode() for _ in range(20)] + [base64.b64encode(r.randbytes(31)).decode() for _ in range(20)]
    texts, at = [], []
    for i, k in enumerate(keys):
        u = k.replace("+", "-").replace("/", "_")
        for before, key, after in (("AWS_SECRET_ACCESS_KEY=", k, ""), ("é key=", k, " end"), ("https://host/x?a=1&sig=", u, "&b=2"), ("conf/prod-eu_west/", u.replace("=", ""), "/")):
            texts.append(f"{before}{key}{after}")
            at.append((len(before), len(before) + len(key)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x.doc_id: [(s.s, s.e) for s in x.spans if s.k == 3] for x in op10_secrets.find_spans(docs).collect()}
    for kind in range(4):
        mine = range(kind, len(texts), 4)
        if kind < 3:
            assert np.mean([at[i] in out[i] for i in mine]) >= 0.9, kind
        else:  # the piece may hold - or _ of the path
            assert np.mean([any(s < at[i][1] and at[i][0] < e for s, e in out[i]) for i in mine]) >= 0.9
    clean = {x.doc_id: x.text for x in op10_secrets.redact(docs).collect()}
    assert np.mean([keys[i // 4].rstrip("=") not in clean[i] for i in range(0, len(texts), 4)]) >= 0.9


def test_env_line_is_redacted(spark):
    docs = spark.createDataFrame([(1, f"export AWS_SECRET_ACCESS_KEY={AWS}"), (2, "SOME_LONG_NAME_OF_A_KEY=plain words, and=more")], "doc_id long, text string")
    assert {x.doc_id: x.text for x in op10_secrets.redact(docs).collect()} == {1: "export AWS_SECRET_ACCESS_KEY=[SECRET]", 2: "SOME_LONG_NAME_OF_A_KEY=plain words, and=more"}


def slow_p(v):
    """(encoding, characters, p) by the three tests, one string at a time."""
    body = v.rstrip("=")
    encoding = next((k for k, a in op10_secrets.ALPHABETS.items() if set(body) <= set(a)), None)
    if encoding is None or len(body) < 20 or not any(c.isdigit() for c in body) or not any(c.isalpha() for c in body):
        return None
    a, n = op10_secrets.ALPHABETS[encoding], len(body)
    tail = lambda z: math.erfc(z / math.sqrt(2))
    free = len(a) - 1
    chi2 = len(a) / n * sum(c * c for c in Counter(body).values()) - n
    z = ((chi2 / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    kinds = ["U" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "o" for c in body]
    runs = 1 + sum(x != y for x, y in zip(kinds, kinds[1:]))
    s2, s3 = (sum(c**k for c in Counter(kinds).values()) for k in (2, 3))
    var = (s2 * (s2 + n * (n + 1)) - 2 * n * s3 - n**3) / (n * n * (n - 1))
    z_runs = (1 + (n * n - s2) / n - runs) / math.sqrt(var) if var > 0 else 10.0
    x = [a.index(c) - free / 2 for c in body]
    z_serial = abs(sum(p * q for p, q in zip(x, x[1:]))) / ((len(a) ** 2 - 1) / 12 * math.sqrt(n - 1))
    upper = lambda z: max(tail(z) / 2 if z >= 0 else 1 - tail(-z) / 2, 1e-300)
    x = -math.log(upper(z) * upper(z_runs) * max(tail(z_serial), 1e-300)) if upper(z) > 1e-99 and upper(z_runs) > 1e-99 else 999.0
    return encoding, n, min(1.0, math.exp(-x) * (1 + x + x * x / 2))


def test_battery_and_control_against_single_strings(spark):
    r = random.Random(12)
    secrets = [base64.b64encode(r.randbytes(n)).decode().rstrip("=") for n in (16, 20, 30, 60, 90) for _ in range(12)] + [r.randbytes(n).hex() for n in (11, 16, 40) for _ in range(12)]
    text = ["Win32_NetworkAdapterConfiguration", "org/apache/spark/sql/v2/catalog/Table1", "deadbeefcafe2024deadbeefcafe2024", "a" * 30 + "1"]
    text += [x.v for x in op10_secrets.decoys(spark, 400).collect()]
    runs = sorted(set(secrets + text))
    df = spark.createDataFrame([(v,) for v in runs], "v string")
    got = {x.v: x for x in op10_secrets.classed(op10_secrets.with_p(df)).collect()}
    want = {v: slow_p(v) for v in runs}
    assert set(got) == {v for v in runs if want[v]}
    assert all(got[v].encoding == want[v][0] and got[v].n == want[v][1] and abs(got[v].p - want[v][2]) < 1e-5 for v in got)
    decoys = Counter()
    for x in op10_secrets.decoy_bins(spark, 120_000).collect():
        decoys[x.encoding, x.len_class, x.bin] += x.d
    reported = set()
    for k in {(x.encoding, x.len_class) for x in got.values()}:
        mine = sorted((x for x in got.values() if (x.encoding, x.len_class) == k), key=lambda x: -x.bin)
        n = sum(d for (e, c, _), d in decoys.items() if (e, c) == k)
        p = [(1 + sum(d for (e, c, b), d in decoys.items() if (e, c) == k and b >= x.bin)) / (1 + n) for x in mine]
        last = max((i for i, q in enumerate(p) if q <= 0.05 * (i + 1) / len(mine)), default=-1)
        reported |= {x.v for x in mine if last >= 0 and x.bin >= mine[last].bin}
    docs = spark.createDataFrame([(i, f"see {v} there") for i, v in enumerate(runs)], "doc_id long, text string")
    spans = {runs[x.doc_id] for x in op10_secrets.find_spans(docs).collect() if any(s.k == 3 for s in x.spans)}
    assert spans == reported
    assert np.mean([v in spans for v in secrets]) > 0.9 and np.mean([v in spans for v in text]) < 0.05


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token=abcdef{i}" for i in range(30000))
    began = time.monotonic()
    out = op10_secrets.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), n_decoys=2000).first()
    assert len(out.base) == 30000 and out.base[-1].e == len(text) and time.monotonic() - began < 60
