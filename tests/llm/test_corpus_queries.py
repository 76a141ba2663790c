"""The registered queries: against SQL where there is some, else against brute force or figures that must hold."""

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import pytest
from held import DATA, assert_same
from pyspark.sql import functions as F
from slow import base_spans, slow_removal

from frameloom.llm import op5_mix, registry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{DATA}/{name}.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    assert_same(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_all_are_registered():
    names = set(registry.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))


def test_languages_held_out(spark):
    out = {r.doc_id: r for r in registry.queries()["op1_langid"](spark, DATA).collect()}
    docs = table("documents", "doc_id, lang")
    assert len(out) == len(docs)
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in docs)
    held = [out[i].lang_pred == lang for i, lang in docs if out[i].held_out and lang is not None]
    assert sum(held) >= 0.95 * len(held)


def test_suffixes_of_whole_table(spark):
    want = slow_removal(table("documents", "doc_id, text"))
    got = {r.doc_id: tuple(r)[1:] for r in registry.queries()["op8_suffix"](spark, DATA).collect()}
    assert got == {i: x[:4] for i, x in want.items()}


def test_secrets_of_whole_table(spark):
    kinds = ("assign", "access", "hex")
    got = {r.doc_id: r for r in registry.queries()["op10_secrets"](spark, DATA).collect()}
    for i, t in table("documents", "doc_id, text"):
        base = base_spans(t or "")
        text = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in base)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[i].n_hex == sum(k == 2 for _, k, _ in base)
        assert set(text.split(",")) <= set(got[i].spans.split(","))


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA).collect()
    ids = {r.doc_id for r in out}
    docs = table("documents", "doc_id, text")
    assert len(ids) == len(out) and ids <= {i for i, _ in docs}
    first = {}
    for i, t in sorted(docs):
        first.setdefault(t, i)
    assert ids <= set(first.values())  # no exact copies
    items = [t for (t,) in table("benchmark", "text")]
    leaky = {i for i, t in docs if any(x in t for x in items)}
    assert not ids & leaky and len(ids) >= 0.95 * len(set(first.values()) - leaky)
    assert all(r.taken == r.copies * r.size for r in out)


def test_stages_take_odd_tables(spark, prose):
    import corpus_pipeline

    long = prose("en", 6000, 1)
    rows = [(i, prose("en" if i % 2 else "de", 60, i), "en" if i % 2 else "de", f"s{i % 3}") for i in range(40)]
    rows += [(None, prose("en", 70, 90), "en", None), (None, prose("en", 70, 90), "en", None), (3, prose("en", 80, 91), "en", "s1"), (3, rows[3][1], "en", "s0"), (50, None, "en", "s0"), (51, "", None, "s1"), (None, None, None, None), (52, long, "en", "s2"), (53, long, "en", "s2"), (None, rows[7][1], "en", "s1")]
    names = ("a.b", "row", "_h1", "_k1", "h1", "key", "size", "copies", "unit", "lang_pred", "score", "base", "spans", "k1", "c")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert set(docs.columns) <= set(out.columns)
        got = out.collect()
        assert got and all(r[n] == n for r in got for n in names if n not in ("size", "copies"))
        assert stage(spark, docs.where("false"), DATA).count() == 0
        ids = Counter((r.doc_id, r.text) for r in got)
        if name == "near_copies":
            assert ids == Counter({k: 1 for k in [*((r[0], r[1]) for r in rows[:40]), (None, prose("en", 70, 90)), (3, prose("en", 80, 91)), (50, None), (52, long)]})
        elif name == "mixing":
            assert ids == Counter((r[0], r[1]) for r in rows) and all(r.taken == r.copies * r.size for r in got)
            made = Counter((r.doc_id, r.source, r.size, r.copies) for r in op5_mix.mix(docs.select("doc_id", "source", op5_mix.n_words(F.col("text")).alias("size"))).collect())
            assert made == Counter((r.doc_id, r.source, r.size, r.copies) for r in got)
        elif name != "language":
            assert len(got) == len(rows)
