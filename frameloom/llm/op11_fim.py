"""Fill-in-middle transformation by escaped marker injection, in built-in functions only.

A text is escaped, so that it can't hold the delimiter; regexp_replace appends the delimiter after each unit (a run
of letters, or any other character), so counting delimiters counts units and substring_index cuts at any rank; the
parts are freed of delimiters, unescaped and put together with sentinels. Ranks and form are drawn from hashes of
the key. A row is worked on by itself: nothing is shuffled.

Edge cases: a null text is empty, an empty one is plain; a text that holds a sentinel is plain, so every output can
be cut up again; a null key hashes as no digits; equal rows have equal outputs; texts of any length are cut whole,
by code point; further columns, of any names, are kept, but for those of the names that are added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import quoted, row_of, table

#: The delimiter and the escape are control characters; those of the text become the escape and a digit.
DELIMITER, ESCAPE = "\x1f", "\x1b"
ESCAPED = {ESCAPE: ESCAPE + "0", DELIMITER: ESCAPE + "1"}
#: A unit of an escaped text: a run of letters, an escaped character, or any other character.
UNIT = rf"[A-Za-z]+|{ESCAPE}[01]|[^A-Za-z]"
MADE = ("n", "form", "prefix", "middle", "suffix", "output")


@dataclass(frozen=True)
class Sentinels:
    """Three strings of which none can begin inside another, so that outputs have one reading."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = self.all()
        if len(set(marks)) < 3 or any(not x or x in y and x != y or any(y.startswith(x[-k:]) for k in range(1, len(x))) for x in marks for y in marks):
            raise ValueError("sentinels must differ, not be empty and not overlap")

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def escape(text: Column) -> Column:
    for char, name in ESCAPED.items():
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def unescape(text: Column) -> Column:
    for char, name in reversed(ESCAPED.items()):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def marked(text: Column) -> Column:
    """The escaped text with a delimiter after each unit."""
    return F.regexp_replace(escape(text), f"({UNIT})", "$1" + DELIMITER)


def n_units(marks: Column) -> Column:
    return F.octet_length(marks) - F.octet_length(F.replace(marks, F.lit(DELIMITER)))


def first_units(marks: Column, n: Column) -> Column:
    """The first n units, with a delimiter between two."""
    return F.call_function("substring_index", marks, F.lit(DELIMITER), n)


def last_units(marks: Column, n: Column) -> Column:
    return F.call_function("substring_index", marks, F.lit(DELIMITER), -n)


def plain_text(marks: Column) -> Column:
    return unescape(F.replace(marks, F.lit(DELIMITER)))


def draws(key: Column) -> list[Column]:
    """Four unsigned numbers of 32 bits from the sha256 of ``1:`` and the key."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, text: str = "text", key: str = "doc_id", plain_percent: int = 10, spm_percent: int = 20, sentinels: Sentinels = Sentinels()) -> DataFrame:
    """docs with MADE: units, form (plain, psm, spm), the three parts (null if plain) and the output."""
    kept = [c for c in docs.columns if c not in MADE]
    whole = F.coalesce(docs[quoted(text)].cast("string"), F.lit(""))
    h = draws(docs[quoted(key)])
    row = docs.select(row_of(docs.select(*[docs[quoted(c)] for c in kept])).alias("row"), whole.alias("whole"), *[x.alias(f"h{i}") for i, x in enumerate(h)])
    held = F.lit(False)
    for s in sentinels.all():
        held = held | F.contains("whole", F.lit(s))
    form = F.when((F.col("whole") == "") | held | (F.col("h2") % 100 >= 100 - plain_percent), "plain").when(F.col("h3") % 100 < spm_percent, "spm").otherwise("psm")
    cut = row.withColumns({"form": form, "marks": marked(F.col("whole"))})
    cut = cut.withColumn("n", n_units(F.col("marks")))
    a, b = F.col("h0") % (F.col("n") + 1), F.col("h1") % (F.col("n") + 1)
    cut = cut.withColumns({"a": F.least(a, b).cast("int"), "b": F.greatest(a, b).cast("int")})
    cut = cut.withColumn("head", first_units(F.col("marks"), F.col("b")))
    parts = {
        "prefix": first_units(F.col("marks"), F.col("a")),
        "middle": F.when(F.col("b") > F.col("a"), last_units(F.col("head"), F.col("b") - F.col("a"))).otherwise(""),
        "suffix": last_units(F.col("marks"), F.col("n") - F.col("b") + 1),  # the last unit is followed by a delimiter
    }
    cut = cut.withColumns({k: F.when(F.col("form") != "plain", plain_text(v)) for k, v in parts.items()})
    p, s, m = map(F.lit, sentinels.all())
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("whole"))
    return cut.withColumn("output", output).select(*[F.col("row")[c].alias(c) for c in kept], F.col("n").cast("long").alias("n"), *MADE[1:])


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that an output of that form was made of: no part holds a sentinel, so each is found where it was put."""
    p, s, m = sentinels.all()
    before, after = (lambda x, mark: F.substring_index(x, mark, 1)), (lambda x, mark: F.substring_index(x, mark, -1))
    psm = F.concat(before(after(output, p), s), after(output, m), before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), before(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    chars = {f"{c}_chars": F.length(c).cast("long") for c in ("prefix", "middle")}
    return out.select("doc_id", "n", "form", *[v.alias(k) for k, v in chars.items()], sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {"op11_fim": op11_fim}

ORACLES = {
    "op11_fim": r"""
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
), drawn AS (
    SELECT doc_id, t, u, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || x[9:16] AS BIGINT) % (len(u) + 1) AS c2,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || x[17:24] AS BIGINT) % 100 >= 90 THEN 'plain' WHEN CAST('0x' || x[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM hashed
), parts AS (
    SELECT doc_id, t, n, form, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
""",
}
