"""Repair of the turn structure of conversations by secondary-sorted streams.

A conversation is well formed if it is empty or its roles read ``system`` (at most once, first), then pairs of ``user``
and ``assistant``. Rows are kept, given another role, deleted, or rows without text are inserted, at the least
cost; of the cheapest repairs the one whose letters (``D I K R``) come first is taken.

The automaton of that form has four states, so the cheapest way from every state to the end of the conversation is a vector of four
costs. One stream (rows dealt out by conversation, sorted by turn from the last to the first) carries this vector
from row to row and across Arrow batches, and leaves one byte a row: the best edit in each of the four states, two bits each. These
backpointers go to a table in the shared folder in blocks of ``BLOCK`` rows, so a conversation of any length needs the memory
of one block. A second stream (sorted from the first turn on, each block just ahead of its first row) follows them from the initial
state and gives the edited rows. No conversation is ever held as a whole; a lost task reads its sorted rows again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchloom.llm.checksums import CRC_TABLE, crc32_sql
from merchloom.llm.shingles import stored
from merchloom.session import ship_code

#: Rows whose backpointers make one row of the stored table.
BLOCK = 1 << 16
BLANKS = " \t\n\x0b\x0c\r"
ROLES = ("system", "user", "assistant")
#: Letters in the order that decides ties, and what an edit costs.
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)
COSTS = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
#: Added for every truncated row that stays.
TRUNCATED_COST = 5
FAULTS = ("", "blank", "duplicate", "truncated")

# States: nothing yet, after the system row, after a user row, after an assistant row. Roles: 0 other, 1 to 3 as in ROLES.
_MOVES = ({1: 1, 2: 2}, {2: 2}, {3: 3}, {2: 2})
#: The only role that may be inserted or given in a state; a role's number is also the state after it.
_WANTED = (2, 2, 3, 2)
_END = (0, 10, 5, 0)


@lru_cache(maxsize=1 << 16)
def _step(kind: int, ahead: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """(the best edits at a row as one byte, costs from the row on less the least) from its role and fault and the costs after it."""
    role, fault = kind & 3, kind >> 2
    options: list[list[tuple[int, int]]] = []
    for state in range(4):
        ways = [(COSTS[DELETE] + ahead[state], DELETE)]
        if fault not in (1, 2):
            stays = TRUNCATED_COST if fault == 3 else 0
            if role in _MOVES[state]:
                ways.append((stays + ahead[_MOVES[state][role]], KEEP))
            ways.append((COSTS[REROLE] + stays + ahead[_WANTED[state]], REROLE))
        options.append(ways)
    costs = [min(ways)[0] for ways in options]
    for _ in range(3):
        costs = [min(cost, COSTS[INSERT] + costs[_WANTED[state]]) for state, cost in enumerate(costs)]
    byte = 0
    for state, ways in enumerate(options):
        best = [edit for cost, edit in ways if cost == costs[state]]
        if COSTS[INSERT] + costs[_WANTED[state]] == costs[state]:
            best.append(INSERT)
        byte |= min(best) << 2 * state
    least = min(costs)  # only differences matter, so that few vectors occur however long a stream is
    return byte, tuple(cost - least for cost in costs)


def _keyed(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The rows under fixed names with a digest of role and text."""
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    return turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
        F.unhex(F.md5(F.concat(F.octet_length(role), F.lit(":"), role, text).cast("binary"))).alias("digest"))


def _kinds(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, kind`` per distinct row; ``kind`` is the role's number plus four times the fault's."""
    kept = F.rtrim("text", F.lit(BLANKS))
    role = F.coalesce(*[F.when(F.substring("role", 1, 1) == r[0], F.lit(i + 1)) for i, r in enumerate(ROLES)], F.lit(0))
    own = F.when(kept == "", 1).when(F.substring(kept, -1, 1).isin(".", "!", "?"), 0).otherwise(3)
    narrow = rows.select("conv_id", "turn", "digest", (role + 4 * own).cast("int").alias("kind")).distinct()
    seen = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.floor(F.col("kind") / 4)
    return narrow.withColumn("seen", seen).withColumn(
        "kind", F.when(F.col("seen") & (fault != 1), F.col("kind") % 4 + 8).otherwise(F.col("kind")).cast("int")).drop("seen")


def trace(kinds: DataFrame) -> DataFrame:
    """The stored table of backpointers: ``conv_id, turn, digest`` of a block's first row, ``steps, kinds`` in the order of the rows."""
    kind_of = kinds.schema["conv_id"].dataType.simpleString()
    turn_of = kinds.schema["turn"].dataType.simpleString()
    ordered = kinds.select("conv_id", "turn", "digest", "kind").repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").desc_nulls_last(), F.desc("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ahead, held, steps, first = None, _END, bytearray(), bytearray(), None
        schema = None

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip((*first, bytes(steps[::-1]), bytes(held[::-1])), schema, strict=True)],
                ["conv_id", "turn", "digest", "steps", "kinds"])

        for batch in batches:
            schema = [*[batch.schema.field(k).type for k in range(3)], pa.binary(), pa.binary()]
            for key in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if steps and (key[0] != conv or len(steps) == BLOCK):
                    yield block()
                    steps, held = bytearray(), bytearray()
                if key[0] != conv or first is None:
                    conv, ahead = key[0], _END
                byte, ahead = _step(key[3], ahead)
                steps.append(byte)
                held.append(key[3])
                first = key[:3]
        if steps:
            yield block()

    return stored(ordered.mapInArrow(run, f"conv_id {kind_of}, turn {turn_of}, digest binary, steps binary, kinds binary"), "backpointers")


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Edited rows: ``conv_id, turn, old_role, role, text, fault, edit``.

    ``old_role`` and ``turn`` are null for an inserted row, ``role`` is null for a deleted one; ``fault`` is empty, ``blank``,
    ``duplicate`` or ``truncated``. All rows of a conversation are in one partition, next to each other and in order, deleted ones
    included, so a function over batches can go on from here without a shuffle.

    Rows go by turn, null turns first, and within a turn by a digest of role and text. A null role or text is one space. A
    repeated row is a duplicate of the first. A role counts by its first sign; rows without an id make one conversation. Other columns are left out.
    """
    ship_code(turns.sparkSession)
    rows = _keyed(turns, id_col, turn_col, role_col, text_col)
    kind_of, turn_of = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    blocks = trace(_kinds(rows))
    both = blocks.select(
        "conv_id", "turn", "digest", F.lit(0).alias("row"), "steps", "kinds", F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text")).unionByName(rows.select(
            "conv_id", "turn", "digest", F.lit(1).alias("row"), F.lit(None).cast("binary").alias("steps"),
            F.lit(None).cast("binary").alias("kinds"), "role", "text"))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv, state, last = False, None, 0, None
        steps, kinds, at = b"", b"", 0
        out: list[tuple] = []

        def insert() -> None:
            nonlocal state
            state = _WANTED[state]
            out.append((conv, None, None, ROLES[state - 1], "", "", "I"))

        def close() -> None:
            while started and state in (1, 2):
                insert()

        def emitted(types: list) -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], t) for k, t in enumerate(types)],
                ["conv_id", "turn", "old_role", "role", "text", "fault", "edit"])
            out.clear()
            return found

        types = None
        for batch in batches:
            types = [batch.schema.field(0).type, batch.schema.field(1).type, *[pa.string()] * 5]
            for found, turn, digest, row, new_steps, new_kinds, role, text in zip(
                    *[batch.column(k).to_pylist() for k in range(batch.num_columns)], strict=True):
                if not started or found != conv:
                    close()
                    started, conv, state, last = True, found, 0, None
                if not row:
                    steps, kinds, at = new_steps, new_kinds, 0
                    continue
                if last == (turn, digest):  # the same row again
                    fault = 1 if kinds[at - 1] >> 2 == 1 else 2
                    out.append((conv, turn, role, None, text, FAULTS[fault], "D"))
                    continue
                last, step, kind = (turn, digest), steps[at], kinds[at]
                at += 1
                while (edit := step >> 2 * state & 3) == INSERT:
                    insert()
                fault = FAULTS[kind >> 2]
                if edit == DELETE:
                    out.append((conv, turn, role, None, text, fault, "D"))
                elif edit == KEEP:
                    state = kind & 3
                    out.append((conv, turn, role, role, text, fault, "K"))
                else:
                    state = _WANTED[state]
                    out.append((conv, turn, role, ROLES[state - 1], text, fault, "R"))
            yield emitted(types)
        if types:
            close()
            yield emitted(types)

    return ordered.mapInArrow(
        run, f"conv_id {kind_of}, turn {turn_of}, old_role string, role string, text string, fault string, edit string")


class _Tally:
    """What one conversation adds up to, row by row."""

    def __init__(self, conv):
        self.conv, self.turns, self.low, self.high = conv, 0, None, None
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal, self.cost, self.audit = 0, 0, []
        self.before, self.hash, self.any = None, hashlib.sha256(), False

    def add(self, turn, old_role, role, text, fault, edit) -> None:
        self.audit.append(edit)
        self.cost += COSTS[LETTERS.index(edit)] + (TRUNCATED_COST if fault == "truncated" and edit != "D" else 0)
        if edit != "I":
            self.faults[fault] += 1
            initial = old_role[:1]
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = initial
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if edit != "D":
            self.hash.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode())
            self.any = True

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, self.cost,
                "".join(self.audit), self.hash.hexdigest())


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s result, in the same stream: numbers of faults, cost, edits and a hash of what is left.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``; turns must be whole numbers.
    """
    kind_of = repaired.schema["conv_id"].dataType.simpleString()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, id_type = None, None

        def emitted(done: list[tuple]) -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array([d[k] for d in done], t) for k, t in enumerate(types)], ["conv_id", *names, "audit", "repaired_sha256"])

        for batch in batches:
            id_type, done = batch.schema.field(0).type, []
            for conv, *row in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
                if tally is None or conv != tally.conv:
                    if tally:
                        done.append(tally.row())
                    tally = _Tally(conv)
                tally.add(*row)
            yield emitted(done)
        if tally:
            yield emitted([tally.row()])

    return repaired.mapInArrow(run, f"conv_id {kind_of}, " + ", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` spoiled by a checksum of id and turn, as a test of ``repair``.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes away its ``. ! ?``, 3 repeats it, 4 makes it a user's; nulls are one space.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_case"))
    return rows.where("_case <> 0").select(
        "conv_id", "turn", F.when(F.col("_case") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def _oracle() -> str:
    """The same edits by a recursion over the rows of each conversation, with whole strings in place of backpointers."""
    wanted = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    moves = {0: "s1 u2", 1: "u2", 2: "a3", 3: "u2"}
    base, full = [], []
    for state, (after, role) in wanted.items():
        keep = " ".join(f"WHEN initial = '{m[0]}' THEN {{c: s{m[1]}.c + late, a: 'K' || s{m[1]}.a, r: list_prepend(line, s{m[1]}.r)}}"
                        for m in moves[state].split())
        base.append(f"""list_min(list_filter([{{c: s{state}.c + 2, a: 'D' || s{state}.a, r: s{state}.r}},
            CASE WHEN fault IN ('blank', 'duplicate') THEN NULL {keep} END,
            CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {{c: s{after}.c + late + 1, a: 'R' || s{after}.a, r: list_prepend('{role}:' || text, s{after}.r)}} END],
            lambda x: x IS NOT NULL)) AS b{state}""")
        second, other = wanted[after]
        full.append(f"""list_min([b{state}, {{c: b{after}.c + 5, a: 'I' || b{after}.a, r: list_prepend('{role}:', b{after}.r)}},
            {{c: b{second}.c + 10, a: 'II' || b{second}.a, r: list_prepend('{role}:', list_prepend('{other}:', b{second}.r))}}])""")
    return f"""
WITH RECURSIVE {CRC_TABLE},
cased AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kase
    FROM conversations, tab),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kase = 4 THEN 'user' ELSE role END AS role,
        CASE kase WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN kase = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM cased WHERE kase <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(role)) || ':' || role || text), copy) AS n,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
    FROM damaged),
judged AS (
    SELECT conv_id, turn, role, text, n, left(role, 1) AS initial, role || ':' || text AS line,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before,
        CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
            WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM placed),
steps AS (
    SELECT conv_id, max(n) + 1 AS n, {{c: 0, a: '', r: CAST([] AS VARCHAR[])}} AS s0, {{c: 10, a: 'II', r: ['user:', 'assistant:']}} AS s1,
        {{c: 5, a: 'I', r: ['assistant:']}} AS s2, {{c: 0, a: '', r: CAST([] AS VARCHAR[])}} AS s3
    FROM judged GROUP BY conv_id
    UNION ALL
    SELECT conv_id, n, {", ".join(full)}
    FROM (SELECT conv_id, n, {", ".join(base)}
          FROM (SELECT f.*, CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END AS late, s0, s1, s2, s3
                FROM steps JOIN judged f ON f.conv_id IS NOT DISTINCT FROM steps.conv_id AND f.n = steps.n - 1))),
totals AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
    CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
    CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit,
    sha256(coalesce(array_to_string(s0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN steps ON steps.conv_id IS NOT DISTINCT FROM o.conv_id AND steps.n = 1
"""


ORACLE = _oracle()
