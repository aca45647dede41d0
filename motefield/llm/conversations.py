"""Repair of the structure of conversations by cheapest edits: a checkpointed dynamic program over sorted blocks.

A conversation is repaired when its role initials read ``(s?(ua)+)?``. Costs: keep 0, rerole to user or assistant 2,
delete 3 (the only choice for blank rows and duplicates), insert an empty user or assistant row 2; a truncated row that
stays costs 1 more. Among the cheapest edits the one whose initials (``D``, ``I``, ``K``, ``R``) come first in ASCII wins.

The program has four states (nothing yet, system, user, assistant), and the cost vector before a row follows from the one
after it. Rows are sorted over the cluster and numbered; blocks of `BLOCK` rows are solved apart. A conversation inside a
block is solved there: backward vectors are kept at every square root of its rows only, and the stretch between two of
them is computed again while walking forward. A conversation that reaches over blocks sends one 4 x 4 matrix of costs per
block; from these follow the vectors at the blocks' ends, the checkpoints of the large program; each block is walked from
its checkpoint for all four states it may be entered with, and a last pass over the exits picks the one that holds.
So a conversation with a third of all rows is solved by as many tasks as it has blocks.

Definitions. Null roles and texts are one space. Rows are ordered by turn (nulls first), then role, then SHA-256 of the text;
rows equal in all of these are merged and counted before anything moves. The conversation of null ids is one conversation.
A row is blank if its text has no ``[^\\x20\\x09-\\x0D]``; else a duplicate if an earlier row of the conversation has the same
role and text; else truncated if its last such character is not one of ``.!?``. Roles of other initials (the empty one too)
are never kept. Long texts pass through once, row by row. Extra columns are left out. Empty tables give empty tables.

The digest of a repaired conversation is one SHA-256 over all its texts in order, which only one task can compute: it
reads the sorted rows as a stream and holds one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.llm.common import release, staged

BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS

SPACE = r"\x20\x09-\x0D"
FAR = 1 << 60
FOLLOWING = (2, 2, 3, 2)  # state after a user or assistant row is added: nothing, system, user, assistant come before
END = (0, 4, 2, 0)  # cost at the end: the missing turns are inserted
KEPT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}  # state after a kept row, -1 where it may not stand
NEVER = (-1, -1, -1, -1)
LEGAL = ("su", "ua", "au")

Vector = tuple[int, int, int, int]
Row = tuple[str, int, int]  # role initial; 0, 1 if truncated, 2 if it must go; further copies, which must go


# ---------------------------------------------------------------- the program

def before(row: Row, v: Vector) -> Vector:
    """Cost vector before a row, given the one after it and its copies."""
    initial, fault, copies = row
    extra = 3 * copies
    if fault == 2:
        extra += 3
        return v[0] + extra, v[1] + extra, v[2] + extra, v[3] + extra
    kept = KEPT.get(initial, NEVER)
    d = []
    for s in range(4):
        least = min(3 + v[s], 2 + fault + v[FOLLOWING[s]])
        d.append(min(least, fault + v[kept[s]]) + extra if kept[s] >= 0 else least + extra)
    user = min(d[2], 2 + d[3])
    return min(d[0], 2 + user), min(d[1], 2 + user), user, min(d[3], 2 + d[2])


def vectors(rows: list[Row], v: Vector) -> list[Vector]:
    """Cost vectors before each row, and after the last."""
    out = [v]
    for row in reversed(rows):
        v = before(row, v)
        out.append(v)
    out.reverse()
    return out


def checkpoints(rows: list[Row], v: Vector) -> tuple[int, list[Vector]]:
    """Step, and the vectors after each step of rows (the last one is the given one)."""
    step = isqrt(len(rows)) + 1
    kept = [v]
    for start in range((len(rows) - 1) // step * step, 0, -step):
        for row in reversed(rows[start: start + step]):
            v = before(row, v)
        kept.append(v)
    kept.reverse()
    return step, kept


def walked(rows: list[Row], kept: tuple[int, list[Vector]], state: int, last: bool) -> tuple[list[str], int]:
    """Edits of each row (inserts that come before it included) and the state in the end.

    With ``last`` the conversation ends here, and what it lacks is inserted after the last row.
    """
    edits = []
    step, marks = kept
    for block, v in enumerate(marks):
        part = rows[block * step: (block + 1) * step]
        costs = vectors(part, v)
        for k, (initial, fault, copies) in enumerate(part):
            here, after = costs[k], costs[k + 1]
            word = ""
            if fault == 2:
                word = "D"
            else:
                extra = 3 * copies
                while True:
                    cost, to = here[state], FOLLOWING[state]
                    stay = KEPT.get(initial, NEVER)[state]
                    if 3 + extra + after[state] == cost:
                        word += "D"
                    elif 2 + here[to] == cost:
                        word += "I"
                        state = to
                        continue
                    elif stay >= 0 and fault + extra + after[stay] == cost:
                        word += "K"
                        state = stay
                    else:
                        word += "R"
                        state = to
                    break
            edits.append(word + "D" * copies)
    if last:
        tail = ""
        while END[state]:
            tail += "I"
            state = FOLLOWING[state]
        if tail:
            edits[-1] += tail
    return edits, state


def cheapest(rows: list[Row]) -> tuple[int, list[str]]:
    """Cost and edits of a whole conversation."""
    if not rows:
        return 0, []
    kept = checkpoints(rows, END)
    first = kept[1][0]
    for row in reversed(rows[: kept[0]]):
        first = before(row, first)
    return first[0], walked(rows, kept, 0, True)[0]


def matrix(rows: list[Row]) -> list[int]:
    """Least costs from each state before the rows to each state after them, row by row."""
    columns = []
    for t in range(4):
        v = tuple(0 if s == t else FAR for s in range(4))
        for row in reversed(rows):
            v = before(row, v)
        columns.append(v)
    return [columns[t][s] for s in range(4) for t in range(4)]


# ---------------------------------------------------------------- tables

def _key(conv: Column) -> Column:
    return F.when(conv.isNull(), F.lit("n")).otherwise(F.concat(F.lit("c"), conv.cast("string")))


def _rows(turns: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    conv, turn, role, text = (F.col(n) for n in names)
    return turns.select(
        _key(conv).alias("k"), turn.cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def judged(turns: DataFrame, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """Distinct rows with ``copies`` and the ``fault`` of the first copy (blank, duplicate, truncated or null).

    Columns ``k, turn, role, digest, copies, fault``. Copies of a row are blank like it, or else duplicates.
    """
    full = f"[^{SPACE}]"
    rows = _rows(turns, names).withColumns({
        "blank": ~F.col("text").rlike(full), "cut": ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")}).drop("text")
    merged = rows.groupBy("k", "turn", "role", "digest").agg(
        F.count(F.lit(1)).alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    # one row for each text that a conversation says again, so a group of copies is never gathered
    again = merged.groupBy("k", "role", "digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    again = again.where("n > 1").drop("n")
    seen = F.coalesce(F.col("first") < order, F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(seen, "duplicate").when(F.col("cut"), "truncated")
    return merged.join(again, ["k", "role", "digest"], "left").select("k", "turn", "role", "digest", "copies", fault.alias("fault"))


def _initial(role: str) -> str:
    return role[:1]


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows in order over the whole table, numbered by ``at``; the numbers are fixed by the table that is written."""
    keys = ["k", F.col("turn").asc_nulls_first(), "role", "digest"]
    return staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "turns")


def _blocks(rows: DataFrame) -> DataFrame:
    """Solves the conversations that lie inside one block, and prepares the others.

    Only the first and the last conversation of a block can reach over its border; these are the open ones.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        block = table.column("block")[0].as_py()
        ks, ats = table.column("k").to_pylist(), table.column("at").to_pylist()
        items = list(zip(table.column("initial").to_pylist(), table.column("how").to_pylist(), table.column("more").to_pylist()))
        out = []
        starts = [0, *(i for i in range(1, len(ks)) if ks[i] != ks[i - 1]), len(ks)]
        for a, b in zip(starts, starts[1:]):
            part = items[a:b]
            initials = [r[0] for r in part]
            illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:])) + sum(r[2] for r in part)
            row = {"k": ks[a], "block": block, "ats": ats[a:b], "illegal": illegal, "first": initials[0], "last": initials[-1]}
            if a == 0 or b == len(ks):
                row |= {"initials": initials, "hows": [r[1] for r in part], "mores": [r[2] for r in part], "costs": matrix(part)}
            else:
                row["cost"], row["edits"] = cheapest(part)
            out.append(row)
        return pa.Table.from_pylist(out, schema=schema)

    schema = pa.schema([("k", pa.string()), ("block", pa.int64()), ("ats", pa.list_(pa.int64())), ("illegal", pa.int64()),
                        ("first", pa.string()), ("last", pa.string()), ("cost", pa.int64()), ("edits", pa.list_(pa.string())),
                        ("initials", pa.list_(pa.string())), ("hows", pa.list_(pa.int32())), ("mores", pa.list_(pa.int64())),
                        ("costs", pa.list_(pa.int64()))])
    ddl = ("k string, block long, ats array<long>, illegal long, first string, last string, cost long, edits array<string>, "
           "initials array<string>, hows array<int>, mores array<long>, costs array<long>")
    how = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    slim = rows.select("k", "at", F.shiftright("at", BLOCK_BITS).alias("block"), F.substring("role", 1, 1).alias("initial"),
                       how.alias("how"), (F.col("copies") - 1).alias("more"))
    return staged(slim.groupBy("block").applyInArrow(run, ddl), "blocks")


def _checkpointed(parts: DataFrame) -> DataFrame:
    """For each block of the open conversations: ``vector``, the costs at its end, ``ends`` (the conversation ends there),
    and at the first block the ``cost`` of the whole. Reads 16 numbers per block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        v, out = END, []
        for k, row in enumerate(reversed(table.to_pylist())):
            out.append({"k": row["k"], "block": row["block"], "vector": list(v), "ends": k == 0})
            m = row["costs"]
            v = tuple(min(min(m[4 * s + t] + v[t], FAR) for t in range(4)) for s in range(4))
        out[-1]["cost"] = v[0]
        return pa.Table.from_pylist(out, schema=schema)

    schema = pa.schema([("k", pa.string()), ("block", pa.int64()), ("vector", pa.list_(pa.int64())), ("ends", pa.bool_()), ("cost", pa.int64())])
    slim = parts.select("k", "block", "costs")
    return slim.groupBy("k").applyInArrow(run, "k string, block long, vector array<long>, ends boolean, cost long")


def _walks(parts: DataFrame) -> DataFrame:
    """Edits of each block for each of the four states it may be entered with, and the states it is left with."""
    schema = pa.schema([("k", pa.string()), ("block", pa.int64()), ("ats", pa.list_(pa.int64())), ("illegal", pa.int64()), ("first", pa.string()),
                        ("last", pa.string()), ("cost", pa.int64()), ("ways", pa.list_(pa.list_(pa.string()))), ("exits", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                rows = list(zip(row["initials"], row["hows"], row["mores"]))
                kept = checkpoints(rows, tuple(row["vector"]))
                ways = [walked(rows, kept, s, row["ends"]) for s in range(4)]
                row |= {"ways": [w for w, _ in ways], "exits": [s for _, s in ways]}
                yield pa.RecordBatch.from_pylist([{n: row[n] for n in schema.names}], schema=schema)

    return parts.mapInArrow(run, "k string, block long, ats array<long>, illegal long, first string, last string, cost long, "
                                 "ways array<array<string>>, exits array<int>")


def _entered(walks: DataFrame) -> DataFrame:
    """The state each block is entered with, and whether the role at its start breaks the order. Reads 4 numbers per block."""

    def run(table: pa.Table) -> pa.Table:
        state, last, out = 0, None, []
        for row in table.sort_by("block").to_pylist():
            broken = last is not None and last + row["first"] not in LEGAL
            out.append({"k": row["k"], "block": row["block"], "state": state, "broken": int(broken)})
            state, last = row["exits"][state], row["last"]
        return pa.Table.from_pylist(out, schema=schema)

    schema = pa.schema([("k", pa.string()), ("block", pa.int64()), ("state", pa.int32()), ("broken", pa.int64())])
    return walks.select("k", "block", "exits", "first", "last").groupBy("k").applyInArrow(run, "k string, block long, state int, broken long")


class Repair:
    """Edits of all conversations of a table; results are DataFrames over stage tables in the shared folder.

    ``edits``: ``at, k, block, edit`` per distinct row; ``conversations``: one row per conversation; ``turns()``: the
    repaired rows; ``digests()``: SHA-256 of the repaired conversations.
    """

    def __init__(self, turns: DataFrame, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")):
        self.source, self.names = turns, names
        self.rows = _sorted(judged(turns, names))
        blocks = _blocks(self.rows)
        parts = blocks.where("cost is null")
        walks = staged(_walks(parts.drop("cost").join(_checkpointed(parts), ["k", "block"])), "walks")
        opened = walks.join(_entered(walks), ["k", "block"]).select(
            "k", "block", "ats", (F.col("illegal") + F.col("broken")).alias("illegal"), "cost", F.get("ways", F.col("state")).alias("edits"))
        self.solved = staged(blocks.where("cost is not null").select(*opened.columns).unionByName(opened), "edits")

    @property
    def edits(self) -> DataFrame:
        return self.solved.select("k", F.explode(F.arrays_zip("ats", "edits")).alias("e")).select("k", "e.ats", F.col("e.edits").alias("edit"))

    def conversations(self) -> DataFrame:
        """``k, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation with rows."""
        count = lambda name: F.sum(F.when(F.col("fault") == name, 1).otherwise(0))
        more = F.col("copies") - 1
        blank = F.sum(F.when(F.col("fault") == "blank", F.col("copies")).otherwise(0))
        duplicate = count("duplicate") + F.sum(F.when(F.col("fault") == "blank", 0).otherwise(more))
        per_turn = self.rows.groupBy("k", "turn").agg(
            blank.alias("blank"), duplicate.alias("duplicate"), count("truncated").alias("truncated"))
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
        faults = per_turn.groupBy("k").agg(gaps.cast("long").alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
        parts = F.sort_array(F.collect_list(F.struct("block", F.array_join("edits", "").alias("text"))))
        edits = self.solved.groupBy("k").agg(
            F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("audit"))
        return faults.join(edits, "k")

    def _stream(self) -> DataFrame:
        """Edits and texts of each conversation side by side, in order."""
        edits = self.rows.join(self.edits.drop("k").withColumnRenamed("ats", "at"), "at").select("k", "turn", "role", "digest", "edit", F.lit(None).cast("string").alias("text"))
        texts = _rows(self.source, self.names).select("k", "turn", "role", "digest", F.lit(None).cast("string").alias("edit"), "text")
        return edits.unionByName(texts).repartition("k").sortWithinPartitions(
            "k", F.col("turn").asc_nulls_first(), "role", "digest", F.col("edit").isNull()).select("k", "role", "edit", "text")

    def turns(self) -> DataFrame:
        """Rows of the repaired conversations: ``k, place, role, text, edit`` (``K``, ``R`` or ``I``)."""
        names = ["k", "place", "role", "text", "edit"]

        def run(batches):
            release()
            place, key = 0, None
            for _, found in _repaired(batches):
                out = []
                for k, line in found:
                    if k != key:
                        place, key = 0, k
                    if line is not None:
                        out.append((k, place, *line))
                        place += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
                    (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names)

        return self._stream().mapInArrow(run, "k string, place long, role string, text string, edit string")

    def digests(self) -> DataFrame:
        """``k, repaired_sha256``: of ``role:text`` of the repaired rows, joined by line ends."""

        def run(batches):
            release()
            key, total, started = None, None, False
            for batch, found in _repaired(batches):
                done = []
                for k, line in found:
                    if k != key:
                        if key is not None:
                            done.append((key, total.hexdigest()))
                        key, total, started = k, hashlib.sha256(), False
                    if line is not None:
                        total.update(("\n" if started else "").encode() + f"{line[0]}:".encode() + line[1].encode())
                        started = True
                if batch is None and key is not None:
                    done.append((key, total.hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], pa.string()) for i in range(2)], ["k", "repaired_sha256"])

        return self._stream().mapInArrow(run, "k string, repaired_sha256 string")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Batches with the repaired rows in them: pairs of conversation and (role, text, edit), None where a row adds none.
    Ends with an empty pair, so that the last conversation can be closed."""
    state, key, word = 0, None, ""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        out = []
        for k, role, edit, text in zip(*columns):
            if k != key:
                state, key, word = 0, k, ""
            if edit is not None:
                word = edit
                continue
            out.append((k, None))
            for letter in word:  # of several copies of a row only the first finds edits
                if letter == "D":
                    continue
                state = KEPT[_initial(role)][state] if letter == "K" else FOLLOWING[state]
                name = role if letter == "K" else ("user" if state == 2 else "assistant")
                out.append((k, (name, "" if letter == "I" else text, letter)))
            word = ""
        yield batch, out
    yield None, []


def damaged(turns: DataFrame) -> DataFrame:
    """Faults put into ``conversations`` by rule, one row in twenty for each kind, to be repaired again."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                        (F.crc32(F.concat_ws(":", conv, turn)) % 20).alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def repaired(turns: DataFrame, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``turns``, and of ``ids`` if given: faults, cost, audit and digest of the repair.

    A conversation without rows has zeros, an empty audit and the digest of the empty text.
    """
    repair = Repair(turns, names)
    found = repair.conversations().join(repair.digests(), "k")
    every = (turns if ids is None else ids).select(F.col(names[0]).alias("conv_id")).distinct().withColumn("k", _key(F.col("conv_id")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, "k", "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
