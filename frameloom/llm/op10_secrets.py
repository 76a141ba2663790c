"""Secret scans: three base patterns, and a battery of randomness tests on what looks encoded.

Base spans are the matches of the patterns of KINDS (leftmost, not overlapping, by kind; failing ones dropped
after matching). The method adds spans of kind ``random``: every maximal run of 20 or more characters of
``[A-Za-z0-9+/_-]``, with ``=`` after it only as padding, that holds a digit and a letter; a run that no alphabet
holds, as it mixes ``-_`` with ``+/``, is split at either pair, and the pieces of both splits are tested. Its encoding
is inferred as the smallest alphabet that holds it (hex, HEX, base32, alnum36 in one case, base64) and three tests are
made: chi-squared uniformity over the alphabet (Wilson-Hilferty), too few runs of upper-case, lower-case, digits and
others (Wald-Wolfowitz for several kinds), and lag-1 serial correlation (both normal). Their p-values are combined by
Fisher's method: the score, about even in 0..1 for random strings and near 0 for names, words and paths.

What is reported are runs that are not like text, so text is the hypothesis whose false rejections are controlled. Its
scores are those of ``decoys`` made by a rule of common words and numbers in the ways in which names, paths and slugs are
written. In each class of encoding and length (powers of two, as short runs have little power) a run's p-value is the
share of decoys that score as high; Benjamini-Hochberg over all distinct runs of all documents reports those whose
rate of false discoveries stays below ``alpha``. All of that happens on histograms of a fixed number of bins, so nothing
larger than that is ever ranked; results don't hang on how much text there is but through the runs themselves.
Everything is DataFrame functions; only documents with a match are looked into.

Edge cases: a null or empty text has no spans; positions are code points, ends exclusive; equal starts go by the
order of KINDS; ids may repeat or be null (tests are gathered by runs, not ids); an empty table gives no rows. Texts
with many matches take time in proportion to n sqrt(n) of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.llm.common import cut, fits, row_of, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: = is padding only where no other character of a run follows; else it parts a name from its value.
PADDING = r"(?:=++(?![A-Za-z0-9+/_-]))?"
RUN = r"[A-Za-z0-9+/_-]{20,}" + PADDING
#: The pieces of runs that mix the two families of separators.
PIECES = (r"[A-Za-z0-9+/]{20,}" + PADDING, r"[A-Za-z0-9_-]{20,}" + PADDING)
#: In the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
SPAN = "array<struct<s:int,k:int,e:int,v:string>>"
#: Of the histogram of p-values: bins are even in the square root of p, so small ones are told apart.
BINS = 2000
#: Lengths of this power of two and more are one class.
LONGEST_CLASS = 7
_bins: dict[int, str] = {}
#: What decoys are made of.
PLAIN = tuple(
    "access account action adapter address agent archive array backup balance binary block branch bridge browser buffer build bundle button cache channel chapter client cluster column command "
    "common config connect content context control counter create credit current cursor daemon data debug default delete deploy design detail device digest direct display document domain driver "
    "editor element email engine error event export factory feature field filter final folder format frame function gateway general global group handler header history image import index "
    "input install instance item journal kernel label language layout length level library link list loader local logger manager mapping market memory message method module monitor network "
    "notice number object office option order output package page panel parent partner path pattern payment person plugin policy portal primary printer process product profile project "
    "provider public queue random reader record region release remote report request resource result return review role router sample schema screen script search section security select "
    "sequence server service session setting shadow simple source standard state storage stream string style summary support switch system table target template test thread title token "
    "total trace track transfer update upload user utility value version video view window worker writer".split()
)
HEXED = tuple("abed accede ace ad add babe bad bade be bead bed bee beef cab cad cafe cede dab dad dead deaf deb decade deed deface ebb fab facade face fad fade fed fee feed".split())


def spans(text: Column, pattern: str, kind: int, keep: Column | None = None, group: int = 0) -> Column:
    """[(start, kind, end, matched text)] of all matches of pattern, in one pass: what lies between them tells where they are."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    each = F.slice(F.arrays_zip(between.alias("b"), found.alias("f"), value.alias("v")), F.lit(1), F.size(found))
    step = F.ceil(F.sqrt(F.size(found).cast("double"))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.size(found) - 1, step), lambda i: F.slice(each, i + 1, step))

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["f"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"), x["v"].alias("v"))).alias("out"))

    # appending copies an array, so blocks of the root of their number are walked and put together
    inner = lambda at, block: F.aggregate(block, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), one)
    outer = lambda acc, block: F.transform(F.array(inner(acc["at"], block)), lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")))[0]
    walked = F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), outer, lambda acc: acc["out"]))
    return F.when(F.size(found) > 0, walked).otherwise(F.array().cast(SPAN))


def normal_tail(z: Column) -> Column:
    """P(|N| > z) for z >= 0 (a public five-term approximation of erfc, good to 1.5e-7)."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def encoding_of(body: Column) -> Column:
    """The smallest alphabet that holds body; null if none does or if it isn't a mix of digits and letters."""
    encoding = F.lit(None).cast("string")
    for name, letters in reversed(ALPHABETS.items()):
        inside = letters.replace("-", "\\-")
        encoding = F.when(body.rlike(f"^[{inside}]+$"), name).otherwise(encoding)
    return F.when(body.rlike("[0-9]") & body.rlike("[A-Za-z]"), encoding)


def with_p(runs: DataFrame) -> DataFrame:
    """runs(v) -> runs with encoding, n and p: the three tests' p-values combined."""
    df = runs.withColumn("body", F.regexp_replace("v", "=+$", "")).withColumn("encoding", encoding_of(F.col("body")))
    df = df.withColumn("alphabet", F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), F.col("encoding")))
    df = df.withColumns({"n": F.length("body").cast("double"), "size": F.length("alphabet").cast("double")})
    df = df.where(F.col("encoding").isNotNull() & (F.col("n") >= 20))
    at = F.transform(F.split("body", ""), lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double"))
    df = df.withColumn("codes", F.filter(at, lambda v: v >= 0))
    n, size = F.col("n"), F.col("size")
    squares = F.aggregate(F.array_distinct("codes"), F.lit(0.0), lambda acc, v: acc + F.pow(F.size(F.filter("codes", lambda w: w == v)).cast("double"), F.lit(2.0)))
    df = df.withColumn("chi2", size / n * squares - n)
    # Wilson-Hilferty: the cube root of chi2 / df is about normal; only too uneven counts speak against an even draw
    free = size - 1
    z_chi = (F.cbrt(F.col("chi2") / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    # runs of kinds of characters, given how many there are of each
    kinds = F.translate("body", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", "U" * 26 + "l" * 26 + "d" * 10 + "o" * 4)
    df = df.withColumns({"z_chi": z_chi, "kinds": kinds})
    counts = [F.length(F.regexp_replace("kinds", f"[^{k}]", "")).cast("double") for k in "Uldo"]
    df = df.withColumns({"s2": sum((c * c for c in counts), F.lit(0.0)), "s3": sum((c * c * c for c in counts), F.lit(0.0)), "runs": F.length(F.regexp_replace("kinds", r"(.)\1+", "$1")).cast("double")})
    s2, s3 = F.col("s2"), F.col("s3")
    df = df.withColumns({"mean": 1 + (n * n - s2) / n, "var": (s2 * (s2 + n * (n + 1)) - 2 * n * s3 - n * n * n) / (n * n * (n - 1))})
    z_runs = F.when(F.col("var") > 0, (F.col("mean") - F.col("runs")) / F.sqrt("var")).otherwise(F.lit(10.0))  # words have too few
    centred = F.transform("codes", lambda v: v - (size - 1) / 2)
    df = df.withColumns({"z_runs": z_runs, "c": centred})
    serial = F.aggregate(F.zip_with(F.slice("c", 2, F.size("c") - 1), F.slice("c", F.lit(1), F.size("c") - 1), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    variance = (size * size - 1) / 12  # of an even draw from 0..size-1
    df = df.withColumn("z_serial", F.abs(serial) / (variance * F.sqrt(n - 1)))
    upper = lambda z: F.greatest(F.when(z >= 0, normal_tail(z) / 2).otherwise(1 - normal_tail(-z) / 2), F.lit(1e-300))
    # Fisher's sum of three: -2 ln of their product is chi-squared with six degrees of freedom
    df = df.withColumn("l", -(F.log(upper(F.col("z_chi"))) + F.log(upper(F.col("z_runs"))) + F.log(F.greatest(normal_tail(F.col("z_serial")), F.lit(1e-300)))))
    df = df.withColumn("p", F.least(F.lit(1.0), F.exp(-F.col("l")) * (1 + F.col("l") + F.col("l") * F.col("l") / 2)))
    return df.drop("l", "body", "alphabet", "codes", "kinds", "c", "chi2", "z_chi", "s2", "s3", "runs", "z_runs", "size", "mean", "var", "z_serial")


def classed(df: DataFrame) -> DataFrame:
    """Adds the class of encoding and length, and the bin of p."""
    return df.withColumn("len_class", F.least(F.floor(F.log2("n")), F.lit(LONGEST_CLASS)).cast("int")).withColumn("bin", F.least(F.floor(F.sqrt("p") * BINS), F.lit(BINS - 1)).cast("int"))


def decoys(spark: SparkSession, n: int) -> DataFrame:
    """(v): n strings of words and numbers, of 20 to 320 characters, written in the ways of names, paths, slugs and hex words."""
    h = lambda *x: F.xxhash64("id", *x)
    pick = lambda words: lambda j: F.element_at(F.array(*map(F.lit, words)), (F.pmod(h(j), F.lit(len(words))) + 1).cast("int"))
    number = lambda j: F.pmod(h(j, F.lit("n")), F.element_at(F.array(*map(F.lit, (10, 100, 1000, 10000))), (F.pmod(h(j, F.lit("d")), F.lit(4)) + 1).cast("int"))).cast("string")
    turn = F.sequence(F.lit(1), F.lit(70))
    mixed = lambda words, change: F.transform(turn, lambda j: F.when(F.pmod(h(j, F.lit("k")), F.lit(4)) == 0, number(j)).otherwise(change(pick(words)(j))))
    same = lambda w: w
    styles = (
        (HEXED, same, ""), (HEXED, F.upper, ""), (PLAIN, same, ""), (PLAIN, F.upper, ""), (PLAIN, F.initcap, ""), (PLAIN, F.initcap, "/"),
        (PLAIN, same, "_"), (PLAIN, same, "-"), (PLAIN, F.upper, "_"), (PLAIN, F.initcap, "_"),
    )
    text = F.lit(None).cast("string")
    for k, (words, change, between) in enumerate(styles):
        text = F.when(F.col("style") == k, F.array_join(mixed(words, change), between)).otherwise(text)
    size = F.floor(20 * F.pow(F.lit(2.0), F.pmod(h(F.lit("size")), F.lit(4096)) / 1024.0)).cast("int")
    made = spark.range(n).withColumn("style", F.pmod(h(F.lit("style")), F.lit(len(styles)))).select(F.substring(text, F.lit(1), size).alias("v"), "style")
    # an alphabet of capitals has no digits but 2 to 7
    base32 = made.where("style = 3").select(F.translate("v", "0189", "2367").alias("v"))
    return made.select("v").unionByName(base32)


def decoy_bins(spark: SparkSession, n: int) -> DataFrame:
    """(encoding, len_class, bin, d): how many decoys are in each bin. They are the same always, so they are scored once a driver."""
    if n not in _bins:
        held = classed(with_p(decoys(spark, n))).groupBy("encoding", "len_class", "bin").agg(F.count("*").alias("d"))
        _bins[n] = held.agg(F.to_json(F.collect_list(F.struct("encoding", "len_class", "bin", "d")))).first()[0]  # BINS rows a class at most
    rows = F.from_json(F.lit(_bins[n]), "array<struct<encoding:string,len_class:int,bin:int,d:long>>")
    return spark.range(1).select(F.inline(rows))


def reported_bins(df: DataFrame, text: DataFrame, alpha: float) -> DataFrame:
    """(encoding, len_class, least): bins from least on are reported, by Benjamini-Hochberg in each class over distinct runs.

    At most BINS rows a class are ranked; a run that is copied many times is one hypothesis.
    """
    by = Window.partitionBy("encoding", "len_class")
    down = by.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    runs = df.select("encoding", "len_class", "bin", "v").distinct().groupBy("encoding", "len_class", "bin").agg(F.count("*").alias("c"))
    both = runs.join(text, ["encoding", "len_class", "bin"], "full_outer").na.fill(0, ["c", "d"])
    both = both.withColumns({"above": F.sum("c").over(down), "text_above": F.sum("d").over(down), "m": F.sum("c").over(by), "n_text": F.sum("d").over(by)})
    p = (1 + F.col("text_above")) / (1 + F.col("n_text"))
    return both.where((F.col("above") > 0) & (p <= alpha * F.col("above") / F.col("m"))).groupBy("encoding", "len_class").agg(F.min("bin").alias("least"))


def find_spans(docs: DataFrame, alpha: float = 0.05, keys: tuple[str, ...] = ("doc_id",), n_decoys: int = 120_000) -> DataFrame:
    """docs(*keys, text) -> (*keys, base, spans): spans in order, as (s, k, e, v); a row for each of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.array_sort(F.concat(
        F.when(text.rlike(ASSIGN), F.filter(spans(text, ASSIGN, 0, group=1), lambda x: F.length(x["v"]) >= 6)).otherwise(F.array().cast(SPAN)),
        F.when(text.rlike(ACCESS), spans(text, ACCESS, 1)).otherwise(F.array().cast(SPAN)),
        F.when(text.rlike(HEX), spans(text, HEX, 2)).otherwise(F.array().cast(SPAN)),
    ))
    none = F.array().cast(SPAN)
    whole = F.when(text.rlike(RUN), F.filter(spans(text, RUN, 3), lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]"))).otherwise(none)
    mixed = lambda x: x["v"].rlike("[+/]") & x["v"].rlike("[_-]")
    within = lambda x: F.exists(F.filter("whole", mixed), lambda m: (m["s"] <= x["s"]) & (x["e"] <= m["e"]))
    pieces = F.filter(F.concat(*(spans(text, p, 3) for p in PIECES)), within)
    may = F.when(F.exists("whole", mixed), F.array_distinct(F.concat(F.filter("whole", lambda x: ~mixed(x)), pieces))).otherwise(F.col("whole"))
    # what a run is tested on is made once, as pieces hang on it
    found = docs.select(*keys, text.alias("text"), base.alias("base"), whole.alias("whole"))
    found = cut(found.select(*keys, F.monotonically_increasing_id().alias("rid"), "base", may.alias("may")))
    runs = classed(with_p(found.where(F.size("may") > 0).select("rid", F.explode("may").alias("x")).select("rid", "x", F.col("x.v").alias("v"))))
    runs = cut(runs.select("rid", "x", "v", "encoding", "len_class", "bin"))
    # a few classes of at most BINS bins: 7 encodings by the number of binary lengths of a string
    thresholds = F.broadcast(reported_bins(runs, decoy_bins(docs.sparkSession, n_decoys), alpha))
    secret = runs.join(thresholds, ["encoding", "len_class"]).where(F.col("bin") >= F.col("least"))
    added = secret.groupBy("rid").agg(F.collect_list("x").alias("added"))
    out = found.join(added, "rid", "left")
    both = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN))))
    return out.select(*keys, "base", both.alias("spans"))


def listed(spans_col: str) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans_col, lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]", alpha: float = 0.05) -> DataFrame:
    """docs with every span of text replaced by mask (overlapping spans by one), n_chars made anew where it is a column.

    Spans hang on the text alone, so they are joined by two hashes of it: ids may repeat or be null. Documents
    without spans are left as they are, nulls too.
    """
    hashes = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("text"), "text").alias("h2")]
    kept = find_spans(docs.select(*hashes, "text"), alpha, ("h1", "h2")).where(F.size("spans") > 0)
    kept = cut(kept.select("h1", "h2", F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("spans")).dropDuplicates(["h1", "h2"]))
    kept = F.broadcast(kept) if fits(kept, 512) else kept
    # what is kept lies between the spans' ends so far and a later start; the text itself is copied once
    upto = F.aggregate("spans", F.array(F.lit(0)), lambda ends, x: F.array_append(ends, F.greatest(F.element_at(ends, -1), x["e"])))
    gaps = F.filter(F.zip_with(F.concat(F.transform("spans", lambda x: x["s"]), F.array(F.length("row.text"))), F.col("upto"), lambda s, e: F.struct(e.alias("from"), s.alias("to"))), lambda x: x["to"] >= x["from"])
    clean = F.array_join(F.transform("gaps", lambda x: F.substring(F.col("row.text"), x["from"] + 1, x["to"] - x["from"])), mask)
    packed = docs.select(row_of(docs).alias("row"), *hashes)  # any names may be there
    kept = kept.withColumn("upto", upto)
    out = packed.join(kept, ["h1", "h2"], "left").withColumn("gaps", gaps).withColumn("clean", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(clean))
    made = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("clean")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


QUERIES = {"op10_secrets": op10_secrets}
ORACLES: dict[str, str] = {}
