"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Test items are short and documents long, so a sketch of both sides would tell nothing. As in containment MinHash,
only the small side is sketched: an item keeps its smallest shingle hashes, and each is looked up in the whole
shingle set of a document. Items are partitioned by size (powers of two of their distinct shingles); a partition
with at most m shingles an item keeps floor((1 - t) m) + 1 hashes. If a document holds at least the share t of an
item, it misses at most floor((1 - t) m) of its shingles and so holds one that is kept: no link is lost. Documents
that hold one are verified: the exact share of the item's distinct shingles, compared as text.

Words are runs of letters and digits of the lower-cased text. Shingles are five words; an item of fewer words is
one shingle of all of them, looked up among shingles of that many words. Sketches and items are broadcast if what
they weigh is proven small, else shuffled, with the document side's shingles counted once a document before.

Edge cases: null and empty items or documents link to nothing; repeated items are items of their own; rows with
equal doc_id are one document, the union of their texts' shingles; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.llm.common import BROADCAST_BYTES, cut, fits, row_of, table

WIDTH = 5
THRESHOLD = 0.8


def tokens(text: Column) -> Column:
    """Words, lower-cased; an array, empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: str, width: int) -> Column:
    """Shingles of width words of the array column words, as text, in order; none of shorter arrays."""
    n = F.size(words) - (width - 1)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", F.slice(words, i, F.lit(width))))


def shingle_hashes(words: str, width: int) -> Column:
    n = F.size(words) - (width - 1)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(width)]))


def hash_of(shingle: Column, width: int) -> Column:
    """The hash that shingle_hashes gives to a shingle."""
    words = F.split(shingle, " ")
    return F.xxhash64(*[F.element_at(words, j + 1) for j in range(width)])


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (doc_id, item_id, n_shared, n_shingles, containment), of links at threshold or more."""
    spark = docs.sparkSession
    words = items.select("item_id", F.monotonically_increasing_id().alias("item"), tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    by_width = [
        words.where(F.size("w") >= k if k == width else F.size("w") == k).select("item_id", "item", F.lit(k).alias("width"), F.array_distinct(shingles("w", k)).alias("sh")) for k in range(1, width + 1)
    ]
    whole = by_width[0]
    for more in by_width[1:]:
        whole = whole.unionByName(more)
    whole = cut(whole.withColumn("n", F.size("sh")))
    each = whole.select("item_id", "item", "width", "n", F.explode("sh").alias("s"))
    widths = sorted(r[0] for r in whole.select("width").distinct().collect())
    if not widths:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, n_shared int, n_shingles int, containment double")
    hashed = F.lit(None).cast("long")
    for k in widths:
        hashed = F.when(F.col("width") == k, hash_of(F.col("s"), k)).otherwise(hashed)
    # the partition of an item: sizes from 2**(c-1) + 1 to 2**c; its sketch is as long as the largest of them needs
    most = F.pow(F.lit(2.0), F.ceil(F.log2("n")))
    kept = F.floor((1 - threshold) * most + 1e-9) + 1
    rank = F.row_number().over(Window.partitionBy("item").orderBy("h", "s"))
    sketch = cut(each.withColumn("h", hashed).withColumn("r", rank).where(F.col("r") <= kept).select("h", "width").distinct())
    small = fits(sketch, 64) and (each.agg(F.sum(F.octet_length("s") + 64)).first()[0] or 0) < BROADCAST_BYTES

    found = None
    texts = docs.select("doc_id", tokens(F.col("text")).alias("w"))
    for k in widths:
        hs = F.array_distinct(shingle_hashes("w", k))
        mine = sketch.where(F.col("width") == k).select("h")
        hit = texts.select("doc_id", F.explode(hs).alias("h")).join(F.broadcast(mine) if small else mine, "h", "left_semi").select("doc_id").distinct()
        found = hit if found is None else found.unionByName(hit).distinct()
    found = cut(found)
    few = fits(found, 32)
    again = docs.join(F.broadcast(found) if few else found, "doc_id", "left_semi").select("doc_id", tokens(F.col("text")).alias("w"))
    links = None
    for k in widths:
        mine = each.where(F.col("width") == k).select("item_id", "item", "n", "s")
        held = again.select("doc_id", F.explode(F.array_distinct(shingles("w", k))).alias("s")).join(F.broadcast(mine) if small else mine, "s")
        one = held.groupBy("doc_id", "item_id", "item", "n").agg(F.count_distinct("s").alias("c"))
        links = one if links is None else links.unionByName(one)
    share = F.col("c") / F.col("n")
    return links.where(share >= threshold).select("doc_id", "item_id", F.col("c").cast("int").alias("n_shared"), F.col("n").alias("n_shingles"), share.alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """docs less the rows whose text holds an item. Each row is judged by its own text, whatever its id; null texts stay."""
    hashes = F.struct(F.xxhash64(F.col("text").cast("string")).alias("h1"), F.xxhash64(F.lit("text"), F.col("text").cast("string")).alias("h2"))
    bad = cut(contained(docs.select(hashes.alias("doc_id"), "text"), items, threshold, width).select(F.col("doc_id").alias("key")).distinct())
    bad = F.broadcast(bad) if fits(bad, 64) else bad
    packed = docs.select(row_of(docs).alias("row"), hashes.alias("key"))  # any names may be there
    return packed.join(bad, "key", "left_anti").select("row.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, least(5, len(w)) AS k, unnest(list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda j: array_to_string(w[j:j + 4], ' ')))) AS s FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM i),
d AS (SELECT DISTINCT doc_id, k, s FROM (
    SELECT doc_id, k, unnest(list_transform(range(1, greatest(1, len(w) - k + 2)), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS s FROM dw, ks WHERE len(w) >= k)),
h AS (SELECT d.doc_id, i.item_id, count(*) AS c FROM d JOIN i ON d.s = i.s AND d.k = i.k GROUP BY ALL)
SELECT h.doc_id, h.item_id, CAST(c AS INTEGER) AS n_shared, CAST(n AS INTEGER) AS n_shingles, c / n::DOUBLE AS containment
FROM h JOIN n USING (item_id) WHERE c / n::DOUBLE >= 0.8
"""

QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES = {"op3_decontaminate": ORACLE}
