"""Repair of conversation structure: the cheapest edits that make the roles of a conversation read ``(s?(ua)+)?``.

Turns are kept, given another role, deleted or inserted. Four states say what the roles so far allow: nothing yet,
after the system's turn, after the user's, after the assistant's. A forward Viterbi pass carries for each state the
least (cost, audit string); each turn's layer is closed by inserted turns, two at most, as a third leads nowhere new.
Paths of equal cost to one layer are never prefixes of each other (their costs are sums over the letters), so the
least string of a layer stays the least whatever follows, and blocks of turns compose as matrices of (cost, string).

That lets a conversation be split: equal rows are one row with a number first, then rows are dealt out by ranges of
(conversation, turn, role, text), so a long conversation lies in many partitions. A conversation whole in a
partition is repaired there; what lies at a partition's ends is emitted as 4 x 4 matrices, composed in order
afterwards. SHA-256 reads its text in order, so the conversations at the ends (two a partition at most) are then
streamed again, each in order, with the audit on ahead of it; nothing but the audit is held. A conversation's audit is
one string, a letter a turn: that is the one thing that grows with a conversation.

Edge cases: null ids, roles and texts are one space (a null id is a conversation, returned as null); turns may be
null (first), repeat or be missing; turns of equal number are read by role, then text; an empty table gives no rows; a
conversation without rows after the damage costs nothing; spans of turns beyond a long give null gaps; other columns
don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from frameloom.llm.common import cut, fits, table

START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
#: Where a turn of this initial leads; and where an inserted turn, or one of a changed role, leads: a state has one such way.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
MENDED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Turns that one matrix covers before matrices are composed.
BLOCK = 512
SPACES = " \t\n\x0b\x0c\r"

Layer = dict[int, tuple[int, str]]


def closed(layer: Layer) -> Layer:
    """The layer with all that inserted turns reach from it."""
    for _ in range(2):
        for state, (cost, audit) in list(layer.items()):
            to, path = MENDED[state], (cost + INSERT_COST, audit + INSERT)
            if to not in layer or path < layer[to]:
                layer[to] = path
    return layer


def step(layer: Layer, initial: str, fault: int, again: int) -> Layer:
    """The layer after a turn and its repetitions, which are deleted."""
    out: Layer = {}
    n = again + (fault in (BLANK, DUPLICATE))
    spoilt = TRUNCATED_COST if fault == TRUNCATED else 0
    gone, deleted = n * DELETE_COST, DELETE * n
    for state, (cost, audit) in layer.items():
        if fault in (BLANK, DUPLICATE):
            ways = [(state, gone, deleted)]
        else:
            ways = [(state, gone + DELETE_COST, DELETE + deleted), (MENDED[state], gone + spoilt + REROLE_COST, REROLE + deleted)]
            if initial in NEXT[state]:
                ways.append((NEXT[state][initial], gone + spoilt, KEEP + deleted))
        for to, more, letters in ways:
            path = (cost + more, audit + letters)
            if to not in out or path < out[to]:
                out[to] = path
    return closed(out)


def forward(turns: list[tuple[str, int, int]], start: int) -> Layer:
    """The layer after turns(initial, fault, again) from a state; inserted turns before the first are the layer before's."""
    layer: Layer = {start: (0, "")}
    for turn in turns:
        layer = step(layer, *turn)
    return layer


Matrix = list[Layer]


def matrix(turns: list[tuple[str, int, int]]) -> Matrix:
    """Layers from each state; of more turns than a block by composing neighbours, pair by pair."""
    made = [[forward(turns[i : i + BLOCK], s) for s in range(4)] for i in range(0, len(turns), BLOCK)]
    while len(made) > 1:
        made = [composed(*made[i : i + 2]) if i + 1 < len(made) else made[i] for i in range(0, len(made), 2)]
    return made[0]


def composed(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for layer in a:
        row: Layer = {}
        for mid, (c1, a1) in layer.items():
            for to, (c2, a2) in b[mid].items():
                if to not in row or (c1 + c2) < row[to][0] or (c1 + c2 == row[to][0] and a1 + a2 < row[to][1]):
                    row[to] = (c1 + c2, a1 + a2)
        out.append(row)
    return out


def best(m: Matrix) -> tuple[int, str]:
    """The cheapest audit of a whole conversation: from the start, closed, to an accepted state."""
    first = closed({START: (0, "")})
    paths = [(c1 + c2, a1 + a2) for mid, (c1, a1) in first.items() for to, (c2, a2) in m[mid].items() if to in ACCEPTED]
    return min(paths)


def repaired(turns: Iterator[tuple[str, str, int]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation from its turns(role, text, n) and audit."""
    state, at = START, 0
    for role, text, n in turns:
        for _ in range(n):
            while audit[at] == INSERT:
                state, at = MENDED[state], at + 1
                yield ROLE[state], ""
            if audit[at] == KEEP:
                state = NEXT[state][role[:1]]
                yield role, text
            elif audit[at] == REROLE:
                state = MENDED[state]
                yield ROLE[state], text
            at += 1
    for _ in audit[at:]:
        state = MENDED[state]
        yield ROLE[state], ""


def digest(lines: Iterator[tuple[str, str]]) -> str:
    sha, first = hashlib.sha256(), True
    for role, text in lines:
        sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        first = False
    return sha.hexdigest()


FACTS = ("blank", "duplicate", "truncated", "illegal")
LONGS = ("gaps", *FACTS, "cost")
PATHS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
PART = pa.struct([("part", pa.int32()), ("whole", pa.bool_()), *[(x, pa.int64()) for x in ("gaps", *FACTS, "low", "high", "turns")], ("first_role", pa.string()), ("last_role", pa.string()), ("paths", PATHS), ("sha", pa.string())])
RESULT = ", ".join(f"{x} long" for x in LONGS) + ", audit string"
LEGAL = frozenset(("su", "ua", "au"))


def facts(rows: list[dict]) -> dict:
    """Counts over a conversation's rows in a partition, and what its neighbours must know."""
    out = dict.fromkeys(FACTS, 0)
    initials = [r["role"][:1] for r in rows]
    for r, x in zip(rows, initials):
        if r["fault"] == BLANK:
            out["blank"] += r["n"]
        else:
            out["duplicate"] += r["n"] - (r["fault"] != DUPLICATE)
            out["truncated"] += r["fault"] == TRUNCATED
        out["illegal"] += r["n"] - 1  # no role goes with itself
    out["illegal"] += sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    out |= {"first_role": initials[0], "last_role": initials[-1], "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns))}
    return out | {"gaps": gaps(out["low"], out["high"], out["turns"])}


def joined(parts: list[dict]) -> dict:
    """The facts and the best audit of a conversation from its parts in order."""
    out = {x: sum(p[x] for p in parts) for x in FACTS}
    out["illegal"] += sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in zip(parts, parts[1:]))
    known = [p for p in parts if p["low"] is not None]
    distinct = sum(p["turns"] for p in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
    out["gaps"] = gaps(known[0]["low"], known[-1]["high"], distinct) if known else 0
    made = []
    for p in parts:
        m: Matrix = [{}, {}, {}, {}]
        for x in p["paths"]:
            m[x["start"]][x["end"]] = x["cost"], x["audit"]
        made.append(m)
    while len(made) > 1:
        made = [composed(*made[i : i + 2]) if i + 1 < len(made) else made[i] for i in range(0, len(made), 2)]
    out["cost"], out["audit"] = best(made[0])
    return out


def gaps(low: int | None, high: int | None, distinct: int) -> int | None:
    """Turns that are missing between the first and the last; null if there are more than a long holds."""
    n = 0 if low is None else high - low + 1 - distinct
    return n if n < 1 << 63 else None


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Rows of sorted batches, conversation by conversation."""
    rows = (r for b in batches for i in range(0, b.num_rows, 256) for r in b.slice(i, 256).to_pylist())
    return groupby(rows, key=lambda r: r["conv_id"])


def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition -> a row a conversation: repaired if it lies between two others, else its matrix."""
    part = TaskContext.get().partitionId()

    def described(rows: list[dict], whole: bool) -> dict:
        turns = [(r["role"][:1], r["fault"], r["n"] - 1) for r in rows]
        out = {"part": part, "whole": whole, **facts(rows), "sha": None}
        m = matrix(turns)
        if whole:
            cost, audit = best(m)
            out["paths"] = [{"start": START, "end": ASSISTANT, "cost": cost, "audit": audit}]
            out["sha"] = digest(repaired(((r["role"], r["text"], r["n"]) for r in rows), audit))
        else:
            out["paths"] = [{"start": s, "end": t, "cost": c, "audit": a} for s in range(4) for t, (c, a) in m[s].items()]
        return out

    first, held, ids, made = True, None, [], []
    for conv, rows in conversations_of(batches):
        if held:
            ids.append(held[0])
            made.append(described(held[1], not first))
            first = False
            if len(made) >= 256:
                yield out_batch(ids, made)
                ids, made = [], []
        held = conv, list(rows)
    if held:
        ids.append(held[0])
        made.append(described(held[1], False))
        yield out_batch(ids, made)


def out_batch(ids: list, made: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, PART)], ["conv_id", "p"])


def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, parts) -> (conv_id, facts, cost, audit)."""
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            out = joined(r["parts"])
            yield pa.RecordBatch.from_arrays([pa.array([r["conv_id"]], pa.int64()), *[pa.array([out[k]], pa.int64()) for k in LONGS], pa.array([out["audit"]])], ["conv_id", *LONGS, "audit"])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of with_audits -> (k, sha)."""
    for conv, rows in conversations_of(batches):
        audit = next(rows)["text"]
        sha = digest(repaired(((r["role"], r["text"], r["n"]) for r in rows), audit))
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha])], ["k", "sha"])


def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of with_audits -> (conv_id, turn, role, text) of the repaired conversations, turns from 0."""
    for conv, rows in conversations_of(batches):
        audit = next(rows)["text"]
        turns = enumerate(repaired(((r["role"], r["text"], r["n"]) for r in rows), audit))
        while some := list(islice(turns, 256)):
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(some), pa.int64()), pa.array([i for i, _ in some], pa.int64()), pa.array([x for _, (x, _) in some]), pa.array([x for _, (_, x) in some])], ["conv_id", "turn", "role", "text"])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows as the benchmark of this operator damages them, n how often; dropped ones have n 0."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    code = F.crc32(F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))) % 20
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    n = F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), n.alias("n"))


def print_of(role: Column, text: Column) -> dict[str, Column]:
    return {"h1": F.xxhash64(role, text), "h2": F.xxhash64(F.lit("turn"), text, role)}


def repair(rows: DataFrame) -> DataFrame:
    """rows(conv_id long, turn long, role, text, n) -> a row a conversation: conv_id, RESULT and repaired_sha256.

    n is how often a row is there; rows of n 0 only say that there is such a conversation.
    """
    there = rows.where("n > 0")
    absent = rows.groupBy("conv_id").agg(F.max("n").alias("n")).where("n = 0")
    # of a role and text seen at several turns, the first turn counts
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    prints = print_of(F.col("role"), F.col("text"))
    seen = there.select("conv_id", order.alias("o"), *[v.alias(k) for k, v in prints.items()]).groupBy("conv_id", "h1", "h2").agg(F.min("o").alias("first"), F.max("o").alias("last"))
    seen = cut(seen.where("first <> last").select(F.col("conv_id").alias("k"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first"))
    seen = F.broadcast(seen) if fits(seen, 64) else seen
    alike = there.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    told = alike.withColumns(prints).join(seen, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    later = F.coalesce(order > F.col("first"), F.lit(False))
    fault = F.when(end == "", BLANK).when(later, DUPLICATE).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(CLEAN)
    turns = told.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))
    by = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    ranged = turns.repartitionByRange(*by, F.substring("text", 1, 64)).sortWithinPartitions(*by, "text")
    parts = cut(ranged.mapInArrow(parted, StructType([StructField("conv_id", LongType()), StructField("p", from_arrow_type(PART))])))
    path = F.col("p.paths")[0]
    whole = parts.where("p.whole").select("conv_id", *[f"p.{x}" for x in LONGS[:-1]], path["cost"].alias("cost"), path["audit"].alias("audit"), F.col("p.sha").alias("repaired_sha256"))
    ends = parts.where("not p.whole").groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("parts"))
    ends = cut(ends.mapInArrow(put_together, f"conv_id long, {RESULT}"))
    names = F.broadcast(ends.select(F.col("conv_id").alias("k")))  # two a partition at most
    again = there.join(names, F.col("conv_id").eqNullSafe(F.col("k")), "left_semi")
    shas = with_audits(again, ends).mapInArrow(hashed, "k long, sha string")
    ended = ends.join(shas, F.col("conv_id").eqNullSafe(F.col("k"))).select("conv_id", *LONGS, "audit", F.col("sha").alias("repaired_sha256"))
    zeros = [F.lit(0).cast("long").alias(x) for x in LONGS]
    empty = absent.select("conv_id", *zeros, F.lit("").alias("audit"), F.sha2(F.lit(b""), 256).alias("repaired_sha256"))
    return whole.unionByName(ended).unionByName(empty)


def with_audits(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """rows in order, each conversation in one partition, a row with its audit as text ahead of it."""
    turns = rows.where("n > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "n")
    ahead = repairs.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("n"))
    both = turns.unionByName(ahead).repartition("conv_id")
    return both.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "text")


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations, (conv_id, turn, role, text): rows as repair() takes them, repairs what it returned."""
    return with_audits(rows, repairs).mapInArrow(written, "conv_id long, turn long, role string, text string")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {"op12_repair": op12_repair}


def oracle() -> str:
    """The same pass in SQL: paths are strings, twelve digits of cost and the audit, so that the least string is the best path."""
    plus = lambda p, k, letter: f"printf('%012d', CAST({p}[1:12] AS BIGINT) + {k}) || {p}[13:] || '{letter}'"
    way = lambda p, initial: f"CASE WHEN fault IN (0, 3) AND ini = '{initial}' THEN {plus(p, 'CASE fault WHEN 3 THEN 5 ELSE 0 END', 'K')} END"
    other = lambda p: f"CASE WHEN fault IN (0, 3) THEN {plus(p, 'CASE fault WHEN 3 THEN 6 ELSE 1 END', 'R')} END"
    users = ", ".join(f"{way(p, 'u')}, {other(p)}" for p in ("p0", "p1", "p3"))
    return rf"""
WITH RECURSIVE coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))),
            lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS code
    FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations)
), turns AS (
    SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM (SELECT *, unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM coded)
), ordered AS (
    SELECT *, left(role, 1) AS ini,
        CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
            WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM turns)
), told AS (
    SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM ordered
), facts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
    FROM told GROUP BY conv_id
), walk AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS pos, '000000000000' AS p0, CAST(NULL AS VARCHAR) AS p1, '000000000005I' AS p2, '000000000010II' AS p3 FROM facts
    UNION ALL
    SELECT conv_id, pos, p0, p1, p2, least(p3, {plus("p2", 5, "I")}) FROM (
        SELECT conv_id, pos, p0, p1, least(p2, {plus("p0", 5, "I")}, {plus("p1", 5, "I")}, {plus("p3", 5, "I")}) AS p2, p3 FROM (
            SELECT w.conv_id, r.pos, {plus("p0", 2, "D")} AS p0, least({way("p0", "s")}, {plus("p1", 2, "D")}) AS p1, least({users}, {plus("p2", 2, "D")}) AS p2, least({way("p2", "a")}, {other("p2")}, {plus("p3", 2, "D")}) AS p3
            FROM walk w JOIN ordered r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1))
), paths AS (
    SELECT f.*, CAST(least(p0, p3)[1:12] AS BIGINT) AS cost, least(p0, p3)[13:] AS audit FROM facts f JOIN walk w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.pos = f.n
), letters AS (
    SELECT conv_id, i, audit[i] AS letter, length(replace(audit[1:i], 'I', '')) AS pos FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM paths)
), kept AS (
    SELECT l.conv_id, l.i, l.letter, r.role, CASE l.letter WHEN 'I' THEN '' ELSE r.text END AS text, row_number() OVER w AS j, first_value(l.letter = 'K' AND r.ini = 's') OVER w AS system
    FROM letters l LEFT JOIN ordered r ON l.letter <> 'I' AND r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.pos = l.pos WHERE l.letter <> 'D' WINDOW w AS (PARTITION BY l.conv_id ORDER BY l.i)
), texts AS (
    SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - CASE WHEN system THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS t FROM kept GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN paths p ON p.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLES = {"op12_repair": oracle()}
