"""WARC, exact top-k, mixing, passages, suffixes and pages: round trips, brute force and edge cases."""

import gzip
import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from slow import slow_removal

from frameloom.llm import op2_warc, op4_topk, op5_mix, op6_paragraphs, op8_suffix, op9_html

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    tricky = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nhttp://x 1.1.1.1 20000101000000 text/html 5\nhello\r\n\r\nWARC/1.1\r\n"
    records = [op2_warc.ArcRecord("http://a/b c", "1.2.3.4", "19991231235959", "text/html", tricky), op2_warc.ArcRecord("dns:a", "0.0.0.0", "20000101", "text/dns", b""), op2_warc.ArcRecord("http://z/", "1.2.3.4", "20010101000000", "text/html", "é".encode() * 999)]
    data = op2_warc.arc_volume(records, version)
    got = list(op2_warc.arc_records(data))
    assert [(r.url, r.ip, r.date, r.type, r.content) for r in got] == [(r.url, r.ip, r.date, r.type, r.content) for r in records]
    with pytest.raises(ValueError):
        list(op2_warc.arc_records(data[:-700]))
    assert op2_warc.iso_date("20000101") == "2000-01-01T00:00:00Z" and op2_warc.iso_date("x") == "1970-01-01T00:00:00Z"


def test_pages_to_warc_and_back(spark, tmp_path):
    long = "WARC/1.1\r\n\r\n" + "ü" * 1200
    rows = [(1, "http://a/1", long), (7, "http://a/ 7", long), (3, None, long), (4, "http://a/4", None), (5, "http://a/5", ""), (6, "http://a/6", "short"), (8, "http://a/8", "short"), (9, "http://a/9", "x" * 1000), (None, "http://a/n", long), (9, "http://a/9", "x" * 1000)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("d")).withColumn("key", F.lit(1))
    op2_warc.archive_pages(pages, str(tmp_path / "w"))
    back = op2_warc.read_warc(spark, str(tmp_path / "w")).collect()
    body = lambda h: (h or "").encode()
    assert Counter((r.key, r.payload_bytes, r.payload_digest) for r in back) == Counter((i, len(body(h)), hashlib.sha1(body(h)).hexdigest()) for i, _, h in rows)
    kinds = Counter((r.key, r.record_type, r.refers_to) for r in back)
    assert kinds == Counter({(1, "revisit", 7): 1, (3, "revisit", 7): 1, (None, "revisit", 7): 1, (7, "response", None): 1, (4, "response", None): 1, (5, "response", None): 1, (6, "response", None): 1, (8, "response", None): 1, (9, "response", None): 2})
    assert {r.payload for r in back if r.key == 7} == {body(long)} and {r.payload for r in back if r.record_type == "revisit"} == {None}
    file = next((tmp_path / "w").glob("part-*.gz"))
    assert gzip.decompress(file.read_bytes()).startswith(b"WARC/1.1\r\n")
    every = [f for x in (tmp_path / "w").glob("part-*.gz") for f, _ in op2_warc.warc_records(gzip.decompress(x.read_bytes()))]
    named = {f["warc-record-id"]: f for f in every}
    assert all(named[f["warc-refers-to"]]["warc-target-uri"] == f["warc-refers-to-target-uri"] == "http://a/%207" and named[f["warc-refers-to"]]["warc-type"] == "response" for f in every if f["warc-type"] == "revisit")
    op2_warc.archive_pages(pages.where("false"), str(tmp_path / "e"))
    assert op2_warc.read_warc(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("block", [4096, 16])
def test_top_k_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=24).astype(np.float32).tolist()) for i in range(90)] + [(i, [1.0] * 24) for i in range(90, 130)]
    rows += [(130, None), (140, []), (150, [None] * 24), (160, [float("nan")] * 24), (180, [float("inf")] * 24), (200, [0.5] * 7), (201, [0.25] * 7), (None, [2.0] * 24), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit(1)).withColumn("n", F.lit(1))
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in op4_topk.top_k(df, "vec_id", "embedding", k=5, block=block, query_block=8).collect())
    ok = [(p, i, np.floor(64 * np.array(v, float)).astype(int)) for p, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all()]
    want = Counter()
    for p, i, q in ok:
        if i is not None and i % 20 == 0:
            scores = sorted((-int(q @ v), j if j is not None else 1 << 62, o) for o, j, v in ok if o != p and len(v) == len(q))[:5]
            want.update((i, k + 1, j if j < 1 << 62 else None, -s) for k, (s, j, _) in enumerate(scores))
    assert got == want
    assert op4_topk.top_k(df.where("false"), "vec_id", "embedding").count() == 0


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(8)
    rows = [(0, [7e7, 1.0]), (1, [2.0, 0.0]), (2, [1e300, -1e300]), (3, [3e12 + 0.5, 2e9]), (20, [1e300, 1e300]), (40, [2.0**40 + 1, 3.0]), (41, [2.0**40, 3.0])]
    rows += [(100 + i, (rng.normal(size=2) * 10.0 ** rng.integers(0, 15)).tolist()) for i in range(60)]
    got = Counter(map(tuple, op4_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", k=6, block=16, query_block=4).collect()))
    whole = {i: [math.floor(Fraction(x) * 64) for x in v] for i, v in rows}
    hold = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    want = Counter()
    for i, q in whole.items():
        if i % 20 == 0:
            scores = sorted((-hold(sum(x * y for x, y in zip(q, v))), j) for j, v in whole.items() if j != i)[:6]
            want.update((i, n + 1, j, -s) for n, (s, j) in enumerate(scores))
    assert got == want and max(s for _, _, _, s in got) == 2**63 - 1
    two = spark.createDataFrame([(0, [7e7, 1.0]), (1, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in op4_topk.top_k(two, "vec_id", "embedding").collect()] == [(0, 1, 1, 573440000000)]


def test_bounds_hold_for_all_resolutions():
    rng = np.random.default_rng(9)
    q, c = (rng.integers(-60, 60, (50, 37)).astype(float) for _ in range(2))
    for s in op4_topk.RESOLUTIONS:
        assert (op4_topk.stats(q, s) @ op4_topk.stats(c, s).T >= q @ c.T - 1e-6).all()


def test_shared_targets():
    assert op5_mix.shared_targets([10, 10, 10], [1, 1, 1], 45, 2) == [15, 15, 15]
    assert op5_mix.shared_targets([100, 10, 10], [1, 1, 1], 180, 2) == [140, 20, 20]
    assert op5_mix.shared_targets([0, 10], [5, 1], 15, 2) == [0, 15]


def test_mix_meets_targets(spark):
    r = random.Random(8)
    rows = [(i, None if i % 7 == 0 else f"s{i % 7 * (i % 3 > 0)}", int(r.lognormvariate(4, 1.2))) for i in range(3000)] + [(5, "s1", 10), (5, "s1", 10), (None, "s2", 9), (3001, "zero", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("target", F.lit(1)).withColumn("rid", F.lit(1))
    out = op5_mix.mix(docs).collect()
    assert len(out) == len(rows) and all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in out)
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, op5_mix.shared_targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2)))
    by = {(r.source_size, round(r.target, 6)): 0 for r in out}
    for x in out:
        by[x.source_size, round(x.target, 6)] += x.taken
    assert set(by) == {(sizes[s], round(want[s], 6)) for s in order}
    assert all(abs(t - taken) <= max(2, 0.005 * t) for (_, t), taken in by.items())
    mean = [sum(r.rate * r.size for r in out if (r.source_size, round(r.target, 6)) == k) for k in by]
    assert np.allclose(mean, [t for _, t in by], rtol=1e-6, atol=1)
    assert Counter(map(tuple, out)) == Counter(map(tuple, op5_mix.mix(docs).collect()))
    assert op5_mix.mix(docs.where("false")).count() == 0


def test_words_are_counted_as_named(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "a", " a  b c\n", "x\x1fy"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(op5_mix.n_words(F.col("t"))).collect()]
    assert got == [0, 0, 0, 1, 2, 1]


def test_passages_near_exact_and_embedded(spark, prose):
    p = prose("en", 60, 1)
    near = p.split()
    near[30] = "changed"
    fill = lambda i: prose("de", 40, 100 + i)
    texts = [(1, f"{fill(1)}\n{p}\n{fill(2)}"), (2, f"{fill(3)}\n{' '.join(near)}\n{fill(4)}"), (3, f"{fill(5)} {p} {fill(6)}"), (4, fill(7)), (5, None), (6, ""), (7, f"{fill(8)}\n" * 2), (None, fill(9)), (9, fill(9)), (10, prose("de", 5000, 3))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("unit", F.lit(1)).withColumn("start", F.lit(1))
    out = op6_paragraphs.repeated_passages(docs).collect()
    lines = {(r.doc_id, r.component_id) for r in out if not r.is_window}
    assert {(1, 1), (2, 1), (7, 7), (None, None), (9, None)} <= lines
    assert {r.doc_id for r in out} == {1, 2, 3, 7, None, 9}
    assert not any(r.removed for r in out if r.doc_id == 1) and any(r.removed for r in out if r.doc_id == 3)
    by_id = {i: (t or "").encode() for i, t in texts}
    assert all(len(by_id[r.doc_id][r.start : r.end].split()) == r.words for r in out)
    assert op6_paragraphs.repeated_passages(docs.where("false")).count() == 0
    whole = {r.doc_id: r for r in op6_paragraphs.without_passages(docs).collect()}
    assert set(whole) == set(by_id) and op6_paragraphs.without_passages(docs.where("false")).count() == 0
    for i, t in by_id.items():
        gone = {"long": set(), "short": set()}
        for r in out:
            if r.doc_id == i and r.removed:
                gone["long" if r.is_window or r.words >= 24 else "short"].update(range(r.start, r.end))
        for spans, want, n in ((whole[i].spans, gone["long"], whole[i].n_removed), (whole[i].short, gone["short"] - gone["long"], whole[i].n_short)):
            assert {k for s in spans for k in range(s.start, s.end)} == want and len(want) == n
        assert whole[i].n_bytes == len(t) and whole[i].n_spans == len(whole[i].spans)


def test_near_passages_inside_longer_text(spark, prose):
    r = random.Random(5)
    rows, hold = [], set()
    for k in range(60):  # passages of 50 to 130 words, the copy with as many words changed as 0.8 allows
        n = 50 + k % 81
        p = prose("en", n, 1000 + k).split()
        q = p[:]
        for at in r.sample(range(n), (n - 4) // 45):
            q[at] = f"changed{at}"
        rows += [(2 * k, f"{prose('de', 30, k)} {' '.join(p)} {prose('de', 20, 500 + k)}"), (2 * k + 1, f"{prose('de', 25, 700 + k)} {' '.join(q)} {prose('de', 40, 900 + k)}")]
        hold.add(2 * k + 1)
    rows += [(1000 + k, prose("de", 120, 3000 + k)) for k in range(60)]
    out = op6_paragraphs.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id for x in out if x.n_removed} == hold


@pytest.mark.parametrize("block", [2048, 3])
def test_passage_classes_against_all_pairs(spark, prose, block):
    base = prose("en", 50, 7).split()
    r = random.Random(2)
    texts = []
    for _ in range(30):
        w = base[:]
        for k in r.sample(range(50), r.randint(0, 3)):
            w[k] = f"w{r.randint(0, 9)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [x for x in op6_paragraphs.repeated_passages(docs, window=49, span=50, block=block).collect() if not x.is_window]
    sh = [{tuple(t.split()[i : i + 5]) for i in range(46)} for t in texts]
    at = list(range(30))
    for i in range(30):
        for j in range(i):
            if len(sh[i] & sh[j]) >= 0.8 * len(sh[i] | sh[j]):
                a, b = at[i], at[j]
                at = [min(a, b) if x in (a, b) else x for x in at]
    want = {i: at[i] for i in range(30) if at.count(at[i]) > 1}
    assert {x.doc_id: x.component_id for x in out} == want


def test_leader_links_are_those_of_all_pairs():
    r = random.Random(6)
    for _ in range(40):
        base = list(range(40))
        sets = [frozenset(r.sample(base, 34) + [100 + r.randint(0, 9) for _ in range(r.randint(0, 8))]) for _ in range(25)]
        edges = set(op6_paragraphs.band_links(sets, 0.8))
        groups = []
        for near in (lambda i, j: (i, j) in edges or (j, i) in edges, lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
            at = list(range(25))
            for i in range(25):
                for j in range(i):
                    if near(i, j):
                        a, b = at[i], at[j]
                        at = [min(a, b) if x in (a, b) else x for x in at]
            groups.append(at)
        assert groups[0] == groups[1]


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("chunk,block,hot,piece", [(1 << 20, 1 << 21, 1 << 16, 1 << 20), (700, 900, 3, 512)])
def test_suffix_removal_against_brute_force(spark, prose, monkeypatch, chunk, block, hot, piece):
    monkeypatch.setattr(op8_suffix, "PIECE", piece)
    p = prose("en", 40, 1)
    rows = [(5, p), (3, "é" + p + "x"), (9, "z" * 400), (2, "z" * 150 + p[20:130]), (None, p[5:] + "q" * 99), (7, None), (8, ""), (11, p), (12, p[:99]), (13, p[:100]), (14, "ab" * 300), (15, prose("de", 3000, 1)), (16, prose("de", 3000, 1)[50:9000] + p), (1, p[60:] + p[:90])]
    rows += [(20, thue_morse(1200)), (21, thue_morse(1200).translate(str.maketrans("ab", "ba"))), (22, thue_morse(4096)[900:2300]), (23, "z" * 3000 + "y" + "z" * 300), (24, p + " and " + p)]
    rows += [(30 + i, f"{prose('de', 25, 200 + i)} {p} {prose('de', 25, 300 + i)}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit(1)).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in op8_suffix.remove_repeats(docs, chunk=chunk, block=block, hot=hot).collect()}
    assert got == slow_removal(rows)
    assert op8_suffix.remove_repeats(docs.where("false")).count() == 0


def test_rows_of_one_id_are_not_earlier_than_each_other(spark, prose):
    p = prose("en", 60, 4)
    rows = [(1, p), (1, p), (1, p + "!" + p), (2, p + "?")]
    for chunk in (1 << 20, 300):
        got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in op8_suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk).collect())
        n = len(p)
        assert got == Counter({(1, n, 0): 2, (1, 2 * n + 1, n): 1, (2, n + 1, n): 1})


def test_suffixes_of_a_block_against_sorted_strings():
    rng = np.random.default_rng(2)
    for text in (bytes(rng.integers(97, 99, 900).astype(np.uint8)) * 2, b"a" * 700, thue_morse(1500).encode()):
        at = np.arange(len(text) - 100 + 1)
        first: dict[bytes, int] = {}
        want = [first.setdefault(text[i : i + 100], i) for i in at]
        assert op8_suffix.Suffixes(text, 100).classes(at).tolist() == want


def test_cover_is_a_difference_cover():
    assert {(a - b) % op8_suffix.PERIOD for a in op8_suffix.COVER for b in op8_suffix.COVER} == set(range(op8_suffix.PERIOD))


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/a">Menu</a></ul></nav><div class="ad">Buy, now, please</div><div id="cookie-notice">We use cookies</div>
<article><h1>Head&nbsp;line</h1><p>One, two &lt;three&gt; <b>bold</b>er
  text<br>next<p>Second <a href=x>linked</a> part &#233;.<!-- no --><form><p>Mail?</form><ul><li>item one<li>item two</ul></article>
<aside>Related</aside><div class="comments"><p>I, for one, disagree, with, all, of, this</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert op9_html.main_text(PAGE) == "Head line One, two <three> bolder text next Second linked part é. item one item two"
    assert op9_html.main_text(None) == op9_html.main_text("") == op9_html.main_text("<nav>x</nav>") == ""
    assert op9_html.main_text("just text") == "just text"
    assert op9_html.main_text("<p>a < b & c</p><p title='>'>d</p>") == "a < b & c d"
    body = "".join(f"<p>Paragraph {i}, with commas, and enough text to count for something here.</p>" for i in range(5))
    assert op9_html.main_text(f"<body><div class=menu><a href=1>A</a> <a href=2>B</a></div><div><div>{body}</div><div><a href=x>more</a></div></div>").startswith("Paragraph 0,")
    long = "<p>" + "word, " * 200000 + "</p>"
    assert len(op9_html.main_text(f"<html><body><article>{long}</article>")) == len(("word, " * 200000).strip())


def test_extract_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (None, None, None), (1, "u", PAGE)], PAGES).withColumn("text", F.lit("old")).withColumn("n_chars", F.lit(3))
    out = op9_html.extract_text(pages).collect()
    assert [r.text == "" for r in out] == [False, True, False] and {r.n_chars for r in out} == {3}
    assert op9_html.extract_text(pages.where("false")).count() == 0
