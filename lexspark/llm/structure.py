"""Conversation structure repair: the cheapest edits that give a conversation legal turns, by an integer-minimum DP.

Every path through the graph of (row, state) is one whole number: high digits are its cost, the octal digits below them
its edits in order, one of 1 to 4 for each, and zeros behind the last. The smaller of two numbers is the cheaper path, and
of equal costs the one whose letters are least; so the minimum of whole numbers decides everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.llm.common import small_batches, table, written

#: Edits in the order of their letters; an edit's digit is its place from 1.
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
#: What an edit costs, and what a truncated row that is not deleted adds.
COSTS = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
TRUNCATED = 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn that is inserted or gets a new role, by the state before it.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a row that is kept, by the state before it and the row's initial.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Rows whose edits are digits of one number; longer conversations go block by block.
BLOCK = 64
FAULTS = ("", "blank", "duplicate", "truncated")


@dataclass
class Conversation:
    """What of a conversation's rows decides its edits: their initials and the places of their faults in FAULTS."""

    initials: list[str] = field(default_factory=list)
    faults: bytearray = field(default_factory=bytearray)


def cheapest(rows: Conversation, block: int = BLOCK) -> tuple[int, list[str]]:
    """(cost, edits of each row and at last those after all rows): the edits of a row are inserts before it and its own.

    Goes from the last row to the first: putting an edit before a path adds its cost above and moves the letters down by a
    digit. Between blocks the letters so far are replaced by one digit, the rank among the four states; as two paths that
    have consumed the same rows never differ by inserts at their end alone (inserts stand before a row), ranks decide as
    the letters would. So numbers stay short, and long conversations take linear time.
    """
    width = 3 * (3 * block + 3)
    mask, top = (1 << width) - 1, width - 3

    def put(edit: int, value: int | None, more: int = 0) -> int | None:
        return None if value is None else ((value >> width) + COSTS[edit] + more) << width | edit << top | (value & mask) >> 3

    def least(*values: int | None) -> int | None:
        return min((v for v in values if v is not None), default=None)

    def inserted(values: list[int | None]) -> list[int | None]:
        once = [put(INSERT, values[NEXT[s]]) for s in range(4)]
        return [least(values[s], once[s], put(INSERT, once[NEXT[s]])) for s in range(4)]

    n = len(rows.faults)
    values = inserted([0, None, None, 0])
    kept: list[list[int | None]] = []
    starts = list(range(0, n, block)) or [0]
    for start in reversed(starts):
        end = min(n, start + block)
        if kept:  # letters of later blocks are left in `kept`; here their rank stands for them
            ranks = {low: k for k, low in enumerate(sorted({v & mask for v in values if v is not None}), 1)}
            values = [None if v is None else v >> width << width | ranks[v & mask] << top for v in values]
        for i in range(end - 1, start - 1, -1):
            fault, initial = FAULTS[rows.faults[i]], rows.initials[i]
            after = [put(DELETE, v) for v in values]
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault == "truncated" else 0
                for s in range(4):
                    keep = KEPT.get((s, initial))
                    after[s] = least(after[s], put(REROLE, values[NEXT[s]], more), None if keep is None else put(KEEP, values[keep], more))
            values = inserted(after)
        kept.append([None if v is None else v & mask for v in values])
    cost, state, edits = values[START] >> width, START, []
    for start, lows in zip(starts, reversed(kept)):
        end, waiting = min(n, start + block), ""
        for digit in format(lows[state], f"0{width // 3}o"):
            if len(edits) == end and (end < n or digit == "0"):
                break
            waiting += LETTERS[int(digit) - 1]
            if int(digit) == INSERT:
                state = NEXT[state]
            else:
                state = {DELETE: state, KEEP: KEPT.get((state, rows.initials[len(edits)])), REROLE: NEXT[state]}[int(digit)]
                edits.append(waiting)
                waiting = ""
    return cost, [*edits, waiting]


def faulty(rows: DataFrame) -> DataFrame:
    """Adds to rows (conv_id, turn, role, text, gone) their number n in the conversation from 1, initial and fault.

    Rows are in order of (turn, role, text), nulls first. A row's first fault counts: blank, duplicate (role and text seen
    earlier), truncated. Rows with `gone` come last and have no fault.
    """
    order = Window.partitionBy("conv_id").orderBy("gone", "turn", "role", "text")
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("n")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("_again", F.row_number().over(same) > 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(F.col("gone"), 0).when(blank, 1).when(F.col("_again"), 2).when(~whole, 3).otherwise(0)
    return rows.withColumn("fault", fault.cast("int")).withColumn("initial", F.substring("role", 1, 1)).drop("_again")


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def edits_of(rows: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation in rows (as faulty gives them): (conv_id, n, edits) for each row, and a row
    behind the last with the edits there and the conversation's summary: gaps, faults, illegal pairs, cost, audit.

    Sorted rows stream through a task without their texts; of a conversation an initial, a fault and four numbers for each
    64 rows are held, less than its audit takes.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    types = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.string()]
    names = ["n", "edits", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = told  # no conversation yet
        key_type = None
        out: list[tuple] = []

        def close() -> None:
            cost, edits = cheapest(now)
            gaps = 0 if low is None else last - low + 1 - turns
            out.extend((at, k, e, None, None, None, None, None, None, None) for k, e in enumerate(edits[:-1], 1))
            faults = [now.faults.count(k) for k in (1, 2, 3)]
            out.append((at, len(edits), edits[-1], gaps, *faults, illegal, cost, "".join(edits)))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, t) for c, t in zip(columns[1:], types))], names=["conv_id", *names])

        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            for conv, turn, gone, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "gone", "initial", "fault"))):
                if conv != at:
                    if at is not told:
                        close()
                    at, now, low, last, turns, illegal = conv, Conversation(), None, None, 0, 0
                if gone:
                    continue
                if now.faults and now.initials[-1] + initial not in ("su", "ua", "au"):
                    illegal += 1
                now.initials.append(initial)
                now.faults.append(fault)
                if turn is not None and turn != last:
                    low, last, turns = turn if low is None else low, turn, turns + 1
                if len(out) > 10_000:
                    yield batch_of()
        if at is not told:
            close()
        if out:
            yield batch_of()

    few = small_batches(rows.select("conv_id", "turn", "gone", "initial", "fault", "n")).repartition("conv_id").sortWithinPartitions("conv_id", "n")
    return few.mapInArrow(told, f"conv_id {kind}, n long, edits string, {SUMMARY}")


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, position from 0, turn, role, text, edit), rows of a conversation adjoining in order.

    Inserted turns have an empty text and no turn number.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    both = rows.where("not gone").select("conv_id", "n", F.lit(1).alias("row"), F.col("turn").cast("long").alias("turn"), "role", "text", F.lit(None).cast("string").alias("edits"))
    both = both.unionByName(edits.select("conv_id", "n", F.lit(0).alias("row"), "edits"), allowMissingColumns=True)

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = applied
        for batch in batches:
            out: list[tuple] = []
            key_type = batch.schema.field("conv_id").type
            for conv, row, turn, role, text, letters in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "row", "turn", "role", "text", "edits"))):
                if conv != at:
                    at, state, position = conv, START, 0
                if not row:
                    own = letters.lstrip("I")
                    for _ in range(len(letters) - len(own)):
                        state = NEXT[state]
                        out.append((conv, position, None, ROLES[state], "", "I"))
                        position += 1
                    continue
                if own == "D":
                    continue
                state = KEPT[state, role[:1]] if own == "K" else NEXT[state]
                out.append((conv, position, turn, role if own == "K" else ROLES[state], text, own))
                position += 1
            if out:
                kinds = (key_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["conv_id", "position", "turn", "role", "text", "edit"])

    sorted_rows = small_batches(both).repartition("conv_id").sortWithinPartitions("conv_id", "n", "row")
    return sorted_rows.mapInArrow(applied, f"conv_id {kind}, position long, turn long, role string, text string, edit string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired turns straight from repaired_turns: their `role:text`, joined by line feeds."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = hashed
        for batch in batches:
            done: list[tuple] = []
            key_type = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != at:
                    if at is not hashed:
                        done.append((at, digest.hexdigest()))
                    at, digest = conv, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (key_type, pa.string()))], names=["conv_id", "repaired_sha256"])
        if at is not hashed:
            yield pa.RecordBatch.from_arrays([pa.array([at], key_type), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return turns.mapInArrow(hashed, f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary by conversation, repaired turns) of rows (conv_id, turn, role, text, and gone: the row doesn't count).

    Repaired roles begin like `(s?(ua)+)?`. Null roles and texts must have been replaced before. An empty role has no
    initial, so it can't be kept. A conversation without rows that count has zeros, an empty audit and no repaired turns;
    an empty table gives none. Rows with a null conv_id are one conversation, null turns come first, repeated rows are
    duplicates, other columns are ignored. Rows are written once, numbered, and then stream in order: a conversation is
    never gathered, and a very long one takes one task's time as its digest must anyway.
    """
    numbered = written(faulty(rows.select("conv_id", "turn", "role", "text", "gone")))
    edits = written(edits_of(numbered))
    summary = edits.where("cost is not null").drop("n", "edits")
    return summary, repaired_turns(numbered, edits)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations (conv_id, turn, role, text) after damage by crc32(`conv_id:turn`) % 20.

    Nulls count as one space each, in the key too; a null conv_id or turn stays null besides. Dropped rows stay with `gone`.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    rows = conversations.withColumn("_d", kind).select(
        "conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), (F.col("_d") == 0).alias("gone"),
        F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return rows.drop("_copy")


def _filled(column: Column) -> Column:
    return F.coalesce(column, F.sha2(F.lit(""), 256))


def op12_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    summary, turns = repair(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    found = digests(turns).withColumnRenamed("conv_id", "_conv")
    return summary.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").withColumn("repaired_sha256", _filled(F.col("repaired_sha256"))).drop("_conv")


#: The same by a recursion over (row, state) with costs and letters side by side; crc32 from its table of 256 remainders.
SQL = r"""WITH RECURSIVE tab AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c FROM range(256) r(n))),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda s: ascii(s)::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 20 AS k FROM conversations, tab),
e AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT *, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE k <> 0)),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM e),
f AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM g),
b AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS before FROM f) GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations),
p AS (SELECT conv_id, 0::BIGINT AS n, '' AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM c
  UNION ALL SELECT * FROM (SELECT conv_id, f_n, CASE o WHEN 'D' THEN st WHEN 'K' THEN i ELSE nx END AS to_state, cost + 3 * m + CASE o WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN o <> 'D' AND fault = 3 THEN 3 ELSE 0 END AS to_cost, audit || repeat('I', m) || o AS to_audit,
      list_concat(list_concat(said, put), CASE o WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE nx WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text] END) AS to_said
    FROM (SELECT *, CASE WHEN st = 'u' THEN 'a' ELSE 'u' END AS nx FROM (SELECT p.conv_id, p.cost, p.audit, p.said, f.n AS f_n, f.role, f.text, f.fault, f.i, m, CASE m WHEN 0 THEN state WHEN 1 THEN CASE WHEN state = 'u' THEN 'a' ELSE 'u' END ELSE CASE WHEN state = 'u' THEN 'u' ELSE 'a' END END AS st,
      CASE m WHEN 0 THEN [] WHEN 1 THEN [CASE WHEN state = 'u' THEN 'assistant:' ELSE 'user:' END] ELSE CASE WHEN state = 'u' THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END END AS put
      FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n + 1, (VALUES (0), (1), (2)) v(m))), (VALUES ('D'), ('K'), ('R')) w(o)
    WHERE o = 'D' OR (fault NOT IN (1, 2) AND (o = 'R' OR st || i IN ('s', 'u', 'su', 'ua', 'au') AND i <> '' AND (st <> '' OR i IN ('s', 'u')))) QUALIFY row_number() OVER (PARTITION BY conv_id, to_state ORDER BY to_cost, to_audit) = 1)),
z AS (SELECT p.conv_id, cost + 3 * m AS cost, audit || repeat('I', m) AS audit, array_to_string(list_concat(said, CASE m WHEN 0 THEN [] WHEN 1 THEN ['assistant:'] ELSE ['user:', 'assistant:'] END), chr(10)) AS told
  FROM p LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM p.conv_id, (VALUES (0), (1), (2)) v(m) WHERE p.n = coalesce(b.n, 0) AND CASE m WHEN 0 THEN state IN ('', 'a') WHEN 1 THEN state = 'u' ELSE state IN ('', 's') END
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY cost + 3 * m, audit || repeat('I', m)) = 1)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, z.cost, z.audit, sha256(z.told) AS repaired_sha256 FROM z LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM z.conv_id"""
