"""Repair of conversations: the cheapest edits that make the roles take turns.

Rows are dealt out by conversation and sorted by turn; a task streams over them.
The state of a dynamic program over the four places of ``(s?(ua)+)?`` (nothing
yet, after s, after u, after a) goes from one Arrow batch to the next. Only
differences between the four costs matter and those that can still win are few,
so there are few states, and which ways into a row and over it are cheapest is
one of a small number of cases: one byte a row is the backpointer. When a conversation ends, its bytes are followed back to mark
what lies on a cheapest way, then forward to spell the least of these ways. A
conversation's rows and bytes over ``KEEP_BYTES`` go to files in the shared work
folder, which the task deletes.

An edit script costs what its letters say, so scripts of equal cost are never
one the beginning of another, and the length of what they give decides each
role. Hence the greedy walk over sets of places finds the one least script.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import materialise, new_path

#: Bytes of rows, or of backpointers, of one conversation that stay in memory; bytes of a spilled piece, about.
KEEP_BYTES, PIECE = 32 << 20, 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANK, SOLID = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]+$"
_INF = 1 << 20
#: Places: 0 nothing yet, 1 after s, 2 after u, 3 after a. Ends are 0 and 3.
_STEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_INSERTED = (2, 2, 3, 2)
#: (p, q): going on from q costs at most so much more than from p, so p is out where q is cheaper by more.
_WITHIN = {(0, 3): 3, (1, 3): 0, (2, 3): 2, (3, 2): 2, (0, 2): 5, (1, 2): 2}
#: Kinds of rows: initial s, u, a or another, each whole or truncated; rows that have to go.
MUST_GO, KINDS = 8, 9


def _settled(cost: list[int]) -> tuple[int, tuple[int, ...]]:
    """Costs with insertions, without places that can't win, less the smallest; and the smallest."""
    cost = list(cost)
    for _ in range(3):
        for p, q in enumerate(_INSERTED):
            cost[q] = min(cost[q], cost[p] + INSERT)
    out = [_INF if c >= _INF or any(cost[q] + d < c for (a, q), d in _WITHIN.items() if a == p) else c for p, c in enumerate(cost)]
    low = min(out)
    return low, tuple(c if c >= _INF else c - low for c in out)


def _edges(kind: int) -> list[tuple[int, str, int, int]]:
    """All (place, letter, place after, cost) by which a row of the kind is consumed."""
    out = [(p, "D", p, DELETE) for p in range(4)]
    if kind != MUST_GO:
        initial, more = "sua?"[kind // 2], TRUNCATED * (kind % 2)
        for letter, roles, cost in (("K", initial, KEEP), ("R", "ua", REROLE)):
            for r in roles:
                for p, q in enumerate(_STEP.get(r, ())):
                    if q is not None:
                        out.append((p, letter, q, cost + more))
    return out


class _Machine:
    """What each state becomes by each kind of row, and the backpointer: which edges are on a cheapest way to their end."""

    def __init__(self) -> None:
        _, start = _settled([0, _INF, _INF, _INF])
        self.costs, at = [start], {start: 0}
        self.after: list[int] = []          # by state * KINDS + kind
        self.pointer: list[int] = []        # the same: number of the case
        cases: dict = {}                    # (insertions before the row, edges over it) to number
        self.inserts: list[tuple] = []      # by state
        s = 0
        while s < len(self.costs):
            now = self.costs[s]
            self.inserts.append(tuple((p, q) for p, q in enumerate(_INSERTED) if now[p] < _INF and now[p] + INSERT == now[q]))
            for kind in range(KINDS):
                reach = [_INF] * 4
                ways = [(p, x, q, now[p] + c) for p, x, q, c in _edges(kind) if now[p] < _INF]
                for _, _, q, c in ways:
                    reach[q] = min(reach[q], c)
                low, settled = _settled(reach)
                if settled not in at:
                    at[settled] = len(self.costs)
                    self.costs.append(settled)
                self.after.append(at[settled])
                edges = tuple((p, x, q) for p, x, q, c in ways if settled[q] < _INF and c - low == settled[q])
                self.pointer.append(cases.setdefault((self.inserts[s], edges), len(cases)))
            s += 1
        self.cases = list(cases)
        if len(self.cases) > 256:
            raise AssertionError("a backpointer is one byte")
        self._back: dict = {}
        self._on: dict = {}

    @staticmethod
    def _with_inserts(inserts: tuple, on: set[int]) -> frozenset[int]:
        for _ in range(3):
            on |= {p for p, q in inserts if q in on}
        return frozenset(on)

    def last(self, state: int) -> frozenset[int]:
        """Places on a cheapest way after the last row."""
        cost = self.costs[state]
        low = min(cost[0], cost[3])
        return self._with_inserts(self.inserts[state], {p for p in (0, 3) if cost[p] == low})

    def back(self, case: int, on: frozenset[int]) -> frozenset[int]:
        """Places on a cheapest way before a row, from those after it."""
        key = (case, on)
        if key not in self._back:
            inserts, edges = self.cases[case]
            self._back[key] = self._with_inserts(inserts, {p for p, _, q in edges if q in on})
        return self._back[key]

    def on(self, case: int, here: frozenset[int], there: frozenset[int], at: frozenset[int]) -> tuple[str, frozenset[int]]:
        """The least letters that consume a row, and the places where they may end."""
        key = (case, here, there, at)
        if key not in self._on:
            out, now = "", at
            inserts, edges = self.cases[case]
            while not out or out[-1] == "I":
                for letter in "DIKR":
                    if letter == "I":
                        got = {q for p, q in inserts if p in now and q in here}
                    else:
                        got = {q for p, x, q in edges if x == letter and p in now and q in there}
                    if got:
                        out, now = out + letter, frozenset(got)
                        break
            self._on[key] = out, now
        return self._on[key]

    def end(self, state: int, at: frozenset[int]) -> str:
        """Insertions after the last row."""
        cost, out = self.costs[state], ""
        low = min(cost[0], cost[3])
        on = self.last(state)
        while not any(p in (0, 3) and cost[p] == low for p in at):
            out, at = out + "I", frozenset(q for p, q in self.inserts[state] if p in at and q in on)
        return out


MACHINE = _Machine()
_SETS = [frozenset(p for p in range(4) if n >> p & 1) for n in range(16)]
_NUMBER = {s: n for n, s in enumerate(_SETS)}


class _Pieces:
    """Byte strings in order; beyond ``KEEP_BYTES`` they are files in the shared folder."""

    def __init__(self, folder: str):
        self.folder, self.fs = folder, None
        self.items: list[bytes | str] = []
        self.kept = 0

    def add(self, data: bytes) -> None:
        if self.kept + len(data) <= KEEP_BYTES:
            self.kept += len(data)
            self.items.append(data)
            return
        if self.fs is None:
            self.fs, self.root = pa.fs.FileSystem.from_uri(self.folder)
            self.fs.create_dir(self.root, recursive=True)
        name = f"{self.root}/{uuid.uuid4().hex}"
        with self.fs.open_output_stream(name, compression=None) as f:
            f.write(data)
        self.items.append(name)

    def __len__(self) -> int:
        return len(self.items)

    def __getitem__(self, k: int) -> bytes:
        item = self.items[k]
        if isinstance(item, bytes):
            return item
        with self.fs.open_input_file(item) as f:
            return f.read()

    def clear(self) -> None:
        for item in self.items:
            if isinstance(item, str):
                self.fs.delete_file(item)
        self.items, self.kept = [], 0


class _List(list):
    add = list.append


def spell(pointers, ways, script, state: int) -> str:
    """Fill ``script`` with the letters of each piece of ``pointers``; returns the insertions behind them.

    A row's letters end with the one that consumes it. ``ways`` takes, backwards,
    the places after each row that are on a cheapest way.
    """
    on = MACHINE.last(state)
    back = MACHINE.back
    for k in range(len(pointers) - 1, -1, -1):
        marks = bytearray()
        for case in reversed(pointers[k]):
            marks.append(_NUMBER[on])
            on = back(case, on)
        ways.add(bytes(marks))
    here, at, step = on, _SETS[1], MACHINE.on
    for k in range(len(pointers)):
        letters = []
        for case, mark in zip(pointers[k], reversed(ways[len(pointers) - 1 - k])):
            there = _SETS[mark]
            some, at = step(case, here, there, at)
            here = there
            letters.append(some)
        script.add("".join(letters).encode())
    return MACHINE.end(state, at)


def _given(letters: str | bytes) -> int:
    """Rows of the repaired conversation."""
    return len(letters) - letters.count("D" if isinstance(letters, str) else b"D")


class _Out:
    """Edits of one output batch, by the rows of one input batch."""

    def __init__(self) -> None:
        self.conv, self.pos, self.letters, self.source, self.role = [], [], [], [], []

    def add(self, letters: str, row: int, before: list[str], pos: int, out: int, odd: int) -> int:
        """Letters from ``row`` on; the conversation had ``pos`` edits and ``out`` rows before. Returns rows given."""
        last = max(len(before) - 1, 0)
        for x in letters:
            self.conv.append(min(row, last))
            if x == "D":
                self.role.append(None)
            else:
                self.role.append(before[row] if x == "K" else ("user", "assistant")[(out + odd) % 2])
                out += 1
            if x == "I":
                self.source.append(None)
            else:
                self.source.append(row)
                row += 1
        self.pos.extend(range(pos, pos + len(letters)))
        self.letters.append(letters)
        return out

    def batch(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        at = pa.array(self.source, pa.int64())
        text = rows["text"]
        return pa.record_batch([
            rows["conv_id"].take(pa.array(self.conv, pa.int64())), pa.array(self.pos, pa.int64()),
            pa.array(list("".join(self.letters)), pa.string()), rows["turn"].take(at), pa.array(self.role, pa.string()),
            pa.compute.coalesce(text.take(at), pa.scalar("", text.type)), rows["role"].take(at), rows["fault"].take(at)],
            names=["conv_id", "pos", "edit", "turn", "role", "text", "role_before", "fault"])


def _packed(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


class _Running:
    """A conversation that goes on from one batch to the next."""

    def __init__(self, folder: str):
        self.folder = folder
        self.rows, self.pointers = _Pieces(folder), _Pieces(folder)
        self.recent: list[pa.RecordBatch] = []
        self.recent_bytes = 0
        self.open = bytearray()
        self.state = 0

    def take(self, rows: pa.RecordBatch, pointers: bytes, state: int) -> None:
        self.recent.append(rows)
        self.recent_bytes += rows.nbytes
        self.open += pointers
        self.state = state
        if self.recent_bytes >= PIECE:
            self.rest()

    def rest(self) -> None:
        """Put what came lately among the pieces; one of rows and one of backpointers belong together."""
        if self.recent:
            self.rows.add(_packed(self.recent))
            self.pointers.add(bytes(self.open))
            self.recent, self.recent_bytes, self.open = [], 0, bytearray()

    def edits(self) -> Iterator[pa.RecordBatch]:
        self.rest()
        ways, script = _Pieces(self.folder), _Pieces(self.folder)
        tail = spell(self.pointers, ways, script, self.state)
        odd = (sum(_given(script[k]) for k in range(len(script))) + len(tail)) % 2
        pos = out = 0
        for k in range(len(self.rows)):
            letters, at = script[k].decode(), 0
            with pa.ipc.open_stream(self.rows[k]) as stream:
                batches = list(stream)
            for i, rows in enumerate(batches):
                n, stop = 0, at
                while n < len(rows):
                    n += letters[stop] != "I"
                    stop += 1
                some = letters[at:stop]
                if k == len(self.rows) - 1 and i == len(batches) - 1:
                    some += tail
                made = _Out()
                out = made.add(some, 0, rows["role"].to_pylist(), pos, out, odd)
                pos += len(some)
                at = stop
                yield made.batch(rows)
        for p in (self.rows, self.pointers, ways, script):
            p.clear()


def _stream(folder: str):
    """Task: rows by conversation and turn to edits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, pointer = MACHINE.after, MACHINE.pointer
        running: _Running | None = None
        before: tuple | None = None     # conversation, turn and key of the last row
        for batch in batches:
            if not len(batch):
                continue
            convs, turns, keys = (batch[c].to_pylist() for c in ("conv_id", "turn", "key"))
            roles = batch["role"].to_pylist()
            faults, pointers, starts = [], bytearray(), []
            states = []     # after each row
            state = running.state if running else 0
            for i, (conv, turn, key, kind, fault) in enumerate(zip(convs, turns, keys, batch["kind"].to_pylist(), batch["fault"].to_pylist())):
                if before is None or conv != before[0]:
                    state = 0
                    starts.append(i)
                elif fault != "blank" and (turn, key) == before[1:]:
                    fault = "duplicate"
                before = (conv, turn, key)
                code = state * KINDS + (MUST_GO if fault in ("blank", "duplicate") else kind)
                pointers.append(pointer[code])
                state = after[code]
                states.append(state)
                faults.append(fault)
            batch = batch.set_column(batch.schema.get_field_index("fault"), "fault", pa.array(faults, pa.string()))
            first = starts[0] if starts else len(convs)
            if running and first:       # the conversation of the batch before goes on
                running.take(batch.slice(0, first), bytes(pointers[:first]), states[first - 1])
            if not starts:
                continue
            if running:
                yield from running.edits()
            made = _Out()
            for a, b in zip(starts, starts[1:]):
                script = _List()
                tail = spell([bytes(pointers[a:b])], _List(), script, states[b - 1])
                letters = script[0].decode() + tail
                made.add(letters, a, roles[:b], 0, 0, _given(letters) % 2)
            if made.letters:
                yield made.batch(batch)
            running = _Running(folder)
            running.take(batch.slice(starts[-1]), bytes(pointers[starts[-1]:]), state)
        if running:
            yield from running.edits()
    return run


def _key(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The edits that make the roles' initials of each conversation ``(s?(ua)+)?`` at the least cost, one a row.

    conv_id, pos (from 0), edit (K keep, R other role, D delete, I insert), turn
    (null for insertions), role and text of the repaired row (role null when
    deleted, text empty when inserted), role_before, fault. Within a task a
    conversation's edits come together and in order; elsewhere sort by pos.

    Rows go by turn, nulls first, then by role and text. A row's fault is the
    first of: blank (no character but white space ``[\x20\x09-\x0D]``), duplicate
    (role and text came before), truncated (the last such character is none of
    ``.!?``). Blank and duplicate rows are deleted. Keeping costs 0, another role
    (user or assistant) 2, deleting 3, inserting an empty user or assistant 2, a
    truncated row that stays 1 more; among equally cheap scripts that least in
    ASCII is taken. A null role or text is one space, and a null conversation
    is one like any other. Other columns are not carried. A conversation is one
    stream in one task, of bounded memory whatever its length.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit(" ")), F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    src = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    src = src.withColumn("key", _key(F.col("role"), F.col("text")))
    # where a text first comes, of those that come again
    again = materialise(src.groupBy("conv_id", "key").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first"))
                        .where("n > 1").select(F.col("conv_id").alias("_conv"), F.col("key").alias("_key"), "first"), "repeats")
    src = src.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")), "left")
    later = F.col("first").isNotNull() & (F.struct(F.col("turn").isNotNull().alias("some"), "turn") > F.col("first"))
    end = F.regexp_replace("text", SOLID, "")
    fault = (F.when(~F.col("text").rlike(BLANK), "blank").when(F.coalesce(later, F.lit(False)), "duplicate")
             .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated"))
    place = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    place = F.when((F.col("role") == "") | (place == 0), 3).otherwise(place - 1)
    src = src.select("conv_id", "turn", "role", "text", "key", fault.alias("fault"))
    src = src.withColumn("kind", (place * 2 + (F.coalesce("fault", F.lit("")) == "truncated").cast("int")).cast("int"))
    conv, turn = (src.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    ordered = src.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(tx.trimmed(_stream(new_path(rows.sparkSession, "conversations"))),
                              f"conv_id {conv}, pos long, edit string, turn {turn}, role string, text string, role_before string, fault string")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in the order in which :func:`repair` gives them, to a row for each conversation."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    price = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
    legal = ("su", "ua", "au")
    now, done, kind = None, [], None

    def finish() -> None:
        gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
        done.append((now["conv"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"],
                     b"".join(now["audit"]).decode(), now["sha"].hexdigest()))

    def out() -> pa.RecordBatch:
        types = [kind] + [pa.int64()] * 6 + [pa.string()] * 2
        return pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names=names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, pos, edit, turn, role, text, old, fault in zip(*(batch[c].to_pylist() for c in (
                "conv_id", "pos", "edit", "turn", "role", "text", "role_before", "fault"))):
            if pos == 0:
                if now is not None:
                    finish()
                now = {"conv": conv, "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                       "cost": 0, "audit": [], "sha": hashlib.sha256(), "before": None, "given": 0}
            now["audit"].append(edit.encode())
            now["cost"] += price[edit]
            if edit != "I":
                if fault:
                    now[fault] += 1
                    now["cost"] += TRUNCATED * (fault == "truncated" and edit != "D")
                if turn is not None and turn != now["high"]:
                    now["low"] = turn if now["low"] is None else now["low"]
                    now["high"], now["turns"] = turn, now["turns"] + 1
                if now["before"] is not None and now["before"] + old[:1] not in legal:
                    now["illegal"] += 1
                now["before"] = old[:1]
            if edit != "D":
                now["sha"].update((("\n" if now["given"] else "") + f"{role}:{text}").encode())
                now["given"] += 1
        if len(done) >= 1000:
            yield out()
            done.clear()
    if now is not None:
        finish()
        yield out()


def summary(edits: DataFrame) -> DataFrame:
    """A row for each conversation of :func:`repair`'s result as it comes from there: counts, cost, the script and a digest.

    gaps (turns missing between the least and the greatest, nulls ignored),
    blank, duplicate, truncated, illegal (neighbours before the repair whose
    roles' initials are not su, ua or au), cost, audit (the letters),
    repaired_sha256 (of the repaired ``role:text``, joined by newlines).
    """
    conv = edits.schema["conv_id"].dataType.simpleString()
    return edits.mapInArrow(tx.trimmed(_summed), f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, "
                            "cost long, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` with the faults that crc32 of ``conv_id:turn`` deals out (nulls: one space)."""
    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = (F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text")))
    out = rows.select("conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(said("role")).alias("role"), text.alias("text"),
                      fault.alias("fault")).where("fault <> 0")
    return out.withColumn("n", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("n", "fault")
