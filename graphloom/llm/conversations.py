"""Repair of the structure of conversations: cheapest edits that make the roles alternate.

Each row of a conversation is a letter of its role and its fault. Rows are sorted over all tasks and cut into segments of bounded length, so a
conversation is one segment or, if it is long, many; a segment's letters are its signature. Each distinct signature is solved once, by memoised
recursion over its suffixes: for each state that it may begin and end in, the least cost and the least audit of that cost. Audits are joined back to the
segments and replayed. A conversation of several segments picks the states between them by composing the segments' tables, first within a partition and then
over partitions; no task gathers its rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import byte_slices, partitions
from graphloom.llm.common import materialize, row_key

#: Rows of a segment and bytes of its texts, at most (a longer text has a segment of its own).
SEGMENT_ROWS, SEGMENT_BYTES = 128, 4 << 20
SPACE = " \t\n\x0b\x0c\r"

# Costs of the edits, and the faults in the order in which the first one counts.
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED_COST = 3
CLEAN, TRUNCATED, DUPLICATE, BLANK = range(4)

#: A letter for each fault and role: system, user, assistant, any other.
LETTERS = "suaxSUAX01234567"
ROLES = "suax"
LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after system, after user, after assistant. What each expects next, where that leads, and the inserts that end a conversation there.
START, SYSTEM, USER, ASSISTANT = range(4)
EXPECTED = ("user", "user", "assistant", "user")
NEXT = (USER, USER, ASSISTANT, USER)
ENDING = ("", "II", "I", "")
NEVER = 1 << 60


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by crc32 of "conv_id:turn" modulo 20: 0 drops the row, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it the user's.
    Nulls in role, text and the checked string are one space."""
    part = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    changed = F.when(F.col("_part") == 1, "").when(F.col("_part") == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = rows.select("conv_id", "turn", "role", "text", part.alias("_part")).filter("_part != 0")
    out = out.select("conv_id", "turn", F.when(F.col("_part") == 4, "user").otherwise(role).alias("role"), changed.alias("text"), F.when(F.col("_part") == 3, 2).otherwise(1).alias("_copies"))
    return out.withColumn("_copies", F.explode(F.array_repeat("_copies", F.col("_copies")))).drop("_copies")


def _options(letter: str) -> list[list[tuple[str, int, int]]]:
    """For each state, the ways to deal with one row: edits, their cost and the state after. An insert belongs before the next row that stays, as D sorts before I."""
    kind = LETTERS.index(letter)
    fault, role = divmod(kind, 4)
    out = []
    for state in range(4):
        ways = [("D", COST["D"], state)]
        if fault in (CLEAN, TRUNCATED):
            more = TRUNCATED_COST * (fault == TRUNCATED)
            for inserts, at in (("", state), ("I", NEXT[state])):
                cost = COST["I"] * len(inserts) + more
                if ROLES[role] == EXPECTED[at][0]:
                    ways.append((inserts + "K", cost, NEXT[at]))
                if ROLES[role] == "s" and at == START:
                    ways.append((inserts + "K", cost, SYSTEM))
                ways.append((inserts + "R", cost + COST["R"], NEXT[at]))
        out.append(ways)
    return out


OPTIONS = {x: _options(x) for x in LETTERS}
Table = tuple[tuple[tuple[int, str] | None, ...], ...]


@functools.lru_cache(1 << 14)
def solve(letters: str) -> Table:
    """[state before][state after]: the least (cost, audit) of rows with these letters, or None. An audit ends with a row's edit, so none is another's beginning, and
    parts can be compared and joined one by one."""
    if not letters:
        return tuple(tuple((0, "") if a == b else None for b in range(4)) for a in range(4))
    rest = solve(letters[1:])
    found = []
    for state in range(4):
        best: list[tuple[int, str] | None] = [None] * 4
        for edits, cost, at in OPTIONS[letters[0]][state]:
            for end, then in enumerate(rest[at]):
                if then and (best[end] is None or (cost + then[0], edits + then[1]) < best[end]):
                    best[end] = cost + then[0], edits + then[1]
        found.append(tuple(best))
    return tuple(found)


def ended(table: Table) -> str:
    """The least audit of a whole conversation."""
    return min((x[0] + COST["I"] * len(ENDING[end]), x[1] + ENDING[end]) for end, x in enumerate(table[START]) if x)[1]


def replay(letters: str, roles: list[str], texts: list[str], state: int, audit: str) -> tuple[list[str], list[str], int]:
    """Roles and texts after the edits, and their cost."""
    new_roles, new_texts, cost, at = [], [], 0, 0
    for edit in audit:
        cost += COST[edit]
        if edit == "K":
            new_roles.append(roles[at])
            state = SYSTEM if ROLES[LETTERS.index(letters[at]) % 4] == "s" else NEXT[state]
        elif edit != "D":
            new_roles.append(EXPECTED[state])
            state = NEXT[state]
        if edit != "D":
            new_texts.append("" if edit == "I" else texts[at])
        if edit != "I":
            cost += TRUNCATED_COST * (edit != "D" and LETTERS.index(letters[at]) // 4 == TRUNCATED)
            at += 1
    return new_roles, new_texts, cost


def dense(keys: list) -> list[int]:
    order = {k: n for n, k in enumerate(sorted(set(keys)))}
    return [order[k] for k in keys]


def ranked(audits: list[str | None]) -> list[int]:
    """Places of a table's audits among each other; only the places are needed to compare compositions."""
    return dense([x or "" for x in audits])


def compose(a: tuple[list[int], list[int]], b: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    """Costs and ranks (16 each, by state before and after) of a and then b."""
    best = [min((a[0][4 * i + m] + b[0][4 * m + j], a[1][4 * i + m], b[1][4 * m + j]) for m in range(4)) for i in range(4) for j in range(4)]
    return [min(x[0], NEVER) for x in best], dense([x[1:] for x in best])


def states(parts: list[tuple[list[int], list[int]]], state: int, end: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """States before and after each part on the best way from state; end: cost and rank of ending in each state."""
    chosen = []
    for cost, rank in reversed(parts):
        best = [min((cost[4 * i + m] + end[m][0], rank[4 * i + m], end[m][1], m) for m in range(4)) for i in range(4)]
        chosen.append([x[3] for x in best])
        end = list(zip((x[0] for x in best), dense([x[1:3] for x in best]), strict=True))
    out = []
    for way in reversed(chosen):
        out.append((state, way[state]))
        state = way[state]
    return out


class Segment:
    """Rows of one conversation within a task, as they come."""

    def __init__(self) -> None:
        self.letters, self.roles, self.texts, self.k1, self.k2 = "", [], [], [], []
        self.first, self.last, self.turns, self.bytes, self.seen = None, None, 0, 0, set()

    def add(self, turn, role: str, text: str, kind: int, k1: int, k2: int) -> None:
        fault = kind // 4
        if fault != BLANK:
            if (role, text) in self.seen:
                fault = DUPLICATE
            self.seen.add((role, text))
        gone = fault in (BLANK, DUPLICATE)
        self.letters += LETTERS[4 * fault + kind % 4]
        self.roles.append("" if gone else role)
        self.texts.append("" if gone else text)
        self.k1.append(k1)
        self.k2.append(k2)
        self.bytes += len(text)
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1

    def full(self, rows: int) -> bool:
        return len(self.letters) >= rows or self.bytes >= SEGMENT_BYTES


def segments(rows: DataFrame, conversations: DataFrame | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Signatures and rows by segment, in order of (pid, seg): conv_id, pid (partition), run (its first segment of this conversation), seg, whole (the conversation has no other segment), letters, roles,
    texts, k1, k2 (hashes of role and text where not whole), first_turn, last_turn, n_turns. Duplicates are found within a segment."""
    kinds = dict(rows.dtypes)
    if kinds["turn"] not in ("int", "bigint", "smallint", "tinyint"):
        raise ValueError("turns are whole numbers")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    source = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text)
    if conversations is not None:
        marks = conversations.select("conv_id").distinct().select("conv_id", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))))
        source = source.unionByName(marks)
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), CLEAN).otherwise(TRUNCATED)
    first = F.substring("role", 1, 1)
    kind = 4 * fault + F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    order = ["conv_id", "turn", "role", "_digest"]
    source = source.select("*", F.md5("text").alias("_digest"), kind.alias("kind"), *row_key("role", "text"), F.monotonically_increasing_id().alias("_salt"))
    # the salt splits equal rows, which may stand in any order
    placed = source.repartitionByRange(partitions(rows), *order, "_salt").sortWithinPartitions(*order).drop("_digest", "_salt")
    columns = "pid int, run int, seg int, whole boolean, letters string, roles array<string>, texts array<string>, k1 array<long>, k2 array<long>, first_turn long, last_turn long, n_turns int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seg, held, now, conv, runs, begun = TaskContext.get().partitionId(), 0, [], None, None, 0, 0
        schema = None

        def close(whole: bool) -> None:
            nonlocal seg
            held.append((conv, pid, begun, seg, whole, now.letters, now.roles, now.texts, None if whole else now.k1, None if whole else now.k2, now.first, now.last, now.turns))
            seg += 1

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema, strict=True)], NAMES)
            held.clear()
            return out

        for big in batches:
            schema = schema or [big.schema.field("conv_id").type, pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32()]
            for part in byte_slices(big, "text"):
                for new, turn, role, text, kind, k1, k2 in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "kind", "k1", "k2")), strict=True):
                    if now is None or new != conv:
                        if now is not None:
                            close(runs > 1 and begun == seg)
                        conv, now, begun, runs = new, Segment(), seg, runs + 1
                    elif now.full(segment_rows):
                        close(False)
                        now = Segment()
                    if role is not None:
                        now.add(turn, role, text, kind, k1, k2)
                if held:
                    yield batch()
        if now is not None:
            close(False)
            yield batch()

    return materialize(placed.mapInArrow(run, f"conv_id {kinds['conv_id']}, {columns}"))


NAMES = ["conv_id", "pid", "run", "seg", "whole", "letters", "roles", "texts", "k1", "k2", "first_turn", "last_turn", "n_turns"]


def without_repeats(parts: DataFrame) -> DataFrame:
    """Letters of the segments of long conversations, with rows that repeat one of an earlier segment as duplicates."""
    each = parts.select("conv_id", "pid", "seg", "letters", F.posexplode(F.arrays_zip("k1", "k2")).alias("i", "k")).filter(F.substring("letters", F.col("i") + 1, F.lit(1)).rlike("[a-zA-Z]"))
    each = each.select("conv_id", "k.k1", "k.k2", F.struct("pid", "seg", "i").alias("at"))
    known = each.groupBy("conv_id", "k1", "k2").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("_conv"), "k1", "k2", "first")
    again = each.join(known, [each.k1 == known.k1, each.k2 == known.k2, each.conv_id.eqNullSafe(known._conv)]).filter("at != first")
    marks = again.groupBy(F.col("at.pid").alias("pid"), F.col("at.seg").alias("seg")).agg(F.collect_set("at.i").alias("again"))
    letters = F.array_join(F.transform(F.split("letters", ""), lambda x, i: F.when(F.array_contains("again", i), F.translate(x, LETTERS[:8], LETTERS[8:12] * 2)).otherwise(x)), "")
    return parts.join(marks, ["pid", "seg"], "left").withColumn("letters", F.when(F.col("again").isNull(), F.col("letters")).otherwise(letters)).drop("again", "k1", "k2")


def solved(signatures: DataFrame) -> DataFrame:
    """letters, audit (of a whole conversation), costs and audits (16 each, by state before and after) of each distinct signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for letters in batch.column(0).to_pylist():
                table = solve(letters)
                rows.append((letters, ended(table), [x[0] if x else NEVER for way in table for x in way], [x[1] if x else None for way in table for x in way]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())), strict=True)], ["letters", "audit", "costs", "audits"])

    return signatures.select("letters").distinct().mapInArrow(run, "letters string, audit string, costs array<long>, audits array<string>")


def _rows(table: pa.Table, *columns: str) -> list[tuple]:
    return sorted(zip(*(table.column(c).to_pylist() for c in columns), strict=True))


def between(parts: DataFrame) -> DataFrame:
    """state and audit of each segment (pid, seg) of long conversations: rows of conv_id, pid, run, seg, costs, audits."""
    conv = dict(parts.dtypes)["conv_id"]

    def within(table: pa.Table) -> pa.Table:
        rows = [(cost, ranked(audits)) for _, cost, audits in _rows(table, "seg", "costs", "audits")]
        cost, rank = functools.reduce(compose, rows)
        return table.slice(0, 1).select(["conv_id", "pid", "run"]).append_column("costs", pa.array([cost], pa.list_(pa.int64()))).append_column("ranks", pa.array([rank], pa.list_(pa.int32())))

    def over(table: pa.Table) -> pa.Table:
        rows = _rows(table, "pid", "run", "costs", "ranks")
        way = states([x[2:] for x in rows], START, [(COST["I"] * len(x), len(x)) for x in ENDING])
        pid, runs = zip(*(x[:2] for x in rows), strict=True)
        return pa.table([pa.array(pid, pa.int32()), pa.array(runs, pa.int32()), *(pa.array(x, pa.int32()) for x in zip(*way, strict=True)), pa.array([k == len(rows) - 1 for k in range(len(rows))])], ["pid", "run", "before", "after", "closing"])

    def down(table: pa.Table) -> pa.Table:
        rows = _rows(table, "seg", "costs", "audits")
        before, after, closing = (table.column(c)[0].as_py() for c in ("before", "after", "closing"))
        way = states([(cost, ranked(audits)) for _, cost, audits in rows], before, [(0 if k == after else NEVER, 0) for k in range(4)])
        audits = [x[2][4 * a + b] + (ENDING[b] if closing and k == len(rows) - 1 else "") for k, (x, (a, b)) in enumerate(zip(rows, way, strict=True))]
        return pa.table([table.column("pid").combine_chunks(), pa.array([x[0] for x in rows], pa.int32()), pa.array([a for a, _ in way], pa.int32()), pa.array(audits, pa.string())], ["pid", "seg", "state", "audit"])

    tops = parts.groupBy("pid", "run").applyInArrow(within, f"conv_id {conv}, pid int, run int, costs array<long>, ranks array<int>")
    ways = tops.groupBy("conv_id").applyInArrow(over, "pid int, run int, before int, after int, closing boolean")
    return parts.join(ways, ["pid", "run"]).groupBy("pid", "run").applyInArrow(down, "pid int, seg int, state int, audit string")


def audited(rows: DataFrame, conversations: DataFrame | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """segments() with the state that each begins in and its audit, beside their tables' other columns.

    rows: conv_id, turn, role, text; other columns aren't read. Rows are taken by turn, nulls first, then by role and by the md5 of the text. Null roles and texts count as one space, so the
    row is blank or has an unknown role. Rows without conv_id are one conversation. conversations: ids that appear even without a row. Repeated rows are duplicates.
    """
    parts = segments(rows, conversations, segment_rows)
    whole = parts.filter("whole").drop("k1", "k2", "run")
    long = materialize(without_repeats(parts.filter("NOT whole")), "lz4")
    tables = materialize(solved(whole.select("letters").unionByName(long.select("letters"))), "lz4")
    ways = between(long.select("conv_id", "pid", "run", "seg", "letters").join(tables.select("letters", "costs", "audits"), "letters").drop("letters"))
    one = whole.join(tables.select("letters", "audit"), "letters").withColumn("state", F.lit(START))
    return one.unionByName(long.drop("run").join(ways, ["pid", "seg"]))


def repaired_rows(rows: DataFrame, conversations: DataFrame | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The rows after repair: conv_id, part and at (their order within the conversation), role, text. See audited() for odd input."""
    found = audited(rows, conversations, segment_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                roles, texts, _ = replay(*(batch.column(c)[k].as_py() for c in ("letters", "roles", "texts", "state", "audit")))
                ids = pa.repeat(batch.column("conv_id")[k], len(roles))
                yield pa.RecordBatch.from_arrays([ids, pa.repeat(batch.column("part")[k], len(roles)), pa.array(range(len(roles)), pa.int32()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], ["conv_id", "part", "at", "role", "text"])

    part = (F.shiftleft(F.col("pid").cast("long"), 32) + F.col("seg")).alias("part")
    return found.select("conv_id", part, "letters", "roles", "texts", "state", "audit").mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, part long, at int, role string, text string")


class Tally:
    """Counts and digest of one conversation, segment by segment."""

    def __init__(self) -> None:
        self.faults, self.illegal, self.cost, self.role, self.audit = [0] * 4, 0, 0, None, []
        self.first, self.last, self.turns, self.digest, self.lines = None, None, 0, hashlib.sha256(), 0

    def add(self, letters, roles, texts, state, audit, first, last, turns) -> None:
        for x in letters:
            fault, kind = divmod(LETTERS.index(x), 4)
            self.faults[fault] += 1
            self.illegal += self.role is not None and self.role + ROLES[kind] not in LEGAL
            self.role = ROLES[kind]
        if turns:
            self.turns += turns - (first == self.last)
            self.first, self.last = first if self.first is None else self.first, last
        new_roles, new_texts, cost = replay(letters, roles, texts, state, audit)
        self.cost += cost
        self.audit.append(audit)
        for role, text in zip(new_roles, new_texts, strict=True):
            self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def report(rows: DataFrame, conversations: DataFrame | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row for each conversation: gaps between its turns, rows by first fault, adjacent roles that may not meet, the cost and letters of the cheapest edits, and the SHA-256 of the
    repaired "role:text" lines. A digest is of one stream by nature: the segments of a long conversation pass one task in order, one at a time. See audited() for odd input;
    conversations without rows have zeros, no edits and the digest of nothing."""
    kinds = dict(rows.dtypes)
    columns = ["letters", "roles", "texts", "state", "audit", "first_turn", "last_turn", "n_turns"]
    found = audited(rows, conversations, segment_rows).select("conv_id", "pid", "seg", "whole", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, schema = None, None, None

        def table(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), schema, strict=True)], ["conv_id", *REPORT])

        for batch in batches:
            schema = schema or [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            done = []
            ids, lone = batch.column("conv_id").to_pylist(), batch.column("whole").to_pylist()
            for k in range(batch.num_rows):
                if now is None or lone[k] or ids[k] != conv:
                    if now is not None:
                        done.append((conv, *now.row()))
                    now, conv = Tally(), ids[k]
                now.add(*(batch.column(c)[k].as_py() for c in columns))
            if done:
                yield table(done)
        if now is not None:
            yield table([(conv, *now.row())])

    schema = f"conv_id {kinds['conv_id']}, " + ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in REPORT)
    long = found.filter("NOT whole").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "pid", "seg")
    return found.filter("whole").mapInArrow(run, schema).unionByName(long.mapInArrow(run, schema))
