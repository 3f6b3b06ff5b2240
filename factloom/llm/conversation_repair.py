"""Cheapest repair of a conversation's structure, as the least path of the optimal-arc graph.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``. Its rows, in order,
may be kept, given another role, deleted, or have empty turns inserted between them; nodes of the
graph are (rows consumed, state of the automaton), arcs are edits. Backward minimum costs, brought
along by a first pass, and forward minimum costs, kept by a second one, tell the optimal arcs: those
whose forward cost, own cost and backward cost add up to the total. The second pass walks the set of
nodes that the edits chosen so far can have led to and takes the least letter of their optimal arcs,
so it ends with the least of all cheapest edit texts.

Both passes stream over partitions sorted by conversation, one forwards and one backwards, and keep
four costs and a few counters for the conversation at hand: a conversation of any length needs no
more memory than a batch, besides one letter an edit. One shuffle by conversation serves the window
that finds repeated turns and both passes. A digest of a whole text can only be made in its order,
so a conversation is one task's work.

Defined cases: a null conversation id is a conversation of its own; null roles and texts count as
one space; rows without a turn come first; rows of one turn are ordered by role, then text; rows
that are alike but for an order are copies of each other; conversations that lose all rows get
zeros, an empty text and its digest; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import WORD, table

DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. The next user or assistant turn leads on from each.
ONWARD = (2, 2, 3, 2)
ACCEPTING = (0, 3)
FAR = 1 << 60
#: Costs to end well from each state when no row is left.
AT_END = (0, 2 * INSERT, INSERT, 0)
LEGAL = ("su", "ua", "au")
_ROLE = {2: "user", 3: "assistant"}


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults set by a checksum of their conversation and turn; what it drops stays, marked ``gone``."""
    c = {name: F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn", "role", "text")}
    code = F.pmod(F.crc32(F.concat_ws(":", c["conv_id"], c["turn"])), F.lit(20))
    text = F.when(code.isin(0, 1), "").when(code == 2, F.regexp_replace(c["text"], "[.!?]", "")).otherwise(c["text"])
    copies = F.explode(F.sequence(F.lit(1), F.when(code == 3, 2).otherwise(1)))
    made = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(code == 4, "user").otherwise(c["role"]).alias("role"), text.alias("text"), (code == 0).alias("gone"), copies.alias("__copy"))
    return made.drop("__copy")


def faulted(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text and gone, if there) with their place among copies, and their first fault."""
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    plain = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone")
    ).repartition("conv_id")
    same = W.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    fault = (
        F.when(~F.col("text").rlike(WORD), "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    return plain.withColumn("nth", F.row_number().over(same)).withColumn("fault", fault)


def _order(down: bool) -> list[Column]:
    names = ("conv_id", "gone", "turn", "role", "text", "nth")
    return [F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n in names]


def _kept(state: int, initial: str) -> int | None:
    """Where keeping a row with this initial leads; None where it may not stand."""
    if initial == "s":
        return 1 if state == 0 else None
    return ONWARD[state] if initial == ("u" if ONWARD[state] == 2 else "a") else None


def _arcs(initial: str, fault: str | None) -> list[list[tuple[str, int, int]]]:
    """For every state: (letter, cost, state after) of the edits that consume a row, by letter."""
    more = CUT if fault == "truncated" else 0
    out = []
    for state in range(4):
        edits = [("D", DELETE, state)]
        if fault not in ("blank", "duplicate"):
            if (to := _kept(state, initial)) is not None:
                edits.append(("K", more, to))
            edits.append(("R", REROLE + more, ONWARD[state]))
        out.append(edits)
    return out


class _Arcs(dict):
    """Arcs by (initial, fault), made once a kind."""

    def __missing__(self, key: tuple[str, str | None]) -> list:
        initial, fault = key
        return self.setdefault(key, _arcs(initial, fault))


def backward(arcs: list, after: tuple) -> tuple:
    """Costs to the end from every state before a row, from those after it; turns may be inserted first."""
    least = [min(cost + after[to] for _, cost, to in edits) for edits in arcs]
    user, assistant = min(least[2], INSERT + least[3]), min(least[3], INSERT + least[2])
    return min(least[0], INSERT + user), min(least[1], INSERT + user), user, assistant


def _inserted(costs: list) -> list:
    """Forward costs once turns may have been inserted; two in a row are never worth a third."""
    for _ in range(2):
        for state, to in enumerate(ONWARD):
            costs[to] = min(costs[to], costs[state] + INSERT)
    return costs


def with_costs(rows: DataFrame) -> DataFrame:
    """Add the least cost to the end from every state after a row; rows come back in reverse order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, known, here, after = _Arcs(), False, None, AT_END
        for batch in batches:
            costs: list[list] = [[], [], [], []]
            read = (batch.column(n).to_pylist() for n in ("conv_id", "gone", "role", "fault"))
            for conv, gone, role, fault in zip(*read, strict=True):
                if not known or conv != here:
                    known, here, after = True, conv, AT_END
                for kept, cost in zip(costs, after, strict=True):
                    kept.append(cost)
                if not gone:
                    after = backward(kinds[role[:1], fault], after)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in costs]], names=[*batch.schema.names, "c0", "c1", "c2", "c3"])

    kind = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.sortWithinPartitions(*_order(True)).mapInArrow(work, f"{kind}, c0 long, c1 long, c2 long, c3 long")


class Walk:
    """One conversation's walk along optimal arcs, row by row."""

    def __init__(self, conv):
        self.conv, self.total, self.costs, self.at = conv, 0, [0, FAR, FAR, FAR], {0}
        self.audit: list[str] = []
        self.turns = self.low = self.high = self.last = None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.distinct, self.digest, self.empty = 0, 0, hashlib.sha256(), True

    def _emit(self, role: str, text: str) -> tuple[str, str]:
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False
        return role, text

    def _optimal(self, before: tuple, arcs: list, after: tuple) -> tuple[str, set[int]]:
        """The least letter of an optimal arc from the nodes reached, and where that letter leads."""
        steps = [("I", INSERT + before[ONWARD[s]], s, ONWARD[s]) for s in self.at] + [(x, cost + after[to], s, to) for s in self.at for x, cost, to in arcs[s]]
        tight = [(x, to) for x, cost, s, to in steps if self.costs[s] + cost == self.total]
        letter = min(x for x, _ in tight)
        return letter, {to for x, to in tight if x == letter}

    def row(self, turn, role: str, text: str, fault: str | None, arcs: list, after: tuple) -> Iterator[tuple[str, str | None, str | None]]:
        """(letter, role, text) of the edits that a row leads to."""
        before = backward(arcs, after)
        if self.last is None:
            self.total = before[0]
        elif self.last + role[:1] not in LEGAL:
            self.illegal += 1
        self.last = role[:1]
        if fault:
            self.counts[fault] += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        _inserted(self.costs)
        while True:
            letter, self.at = self._optimal(before, arcs, after)
            self.audit.append(letter)
            if letter != "I":
                break
            yield "I", *self._emit(_ROLE[min(self.at)], "")
        if letter == "D":
            yield "D", None, None
        else:
            yield letter, *self._emit(role if letter == "K" else _ROLE[min(self.at)], text)
        reached = [FAR] * 4
        for state, edits in enumerate(arcs):
            for _, cost, to in edits:
                reached[to] = min(reached[to], self.costs[state] + cost)
        self.costs = reached

    def end(self) -> Iterator[tuple[str, str, str]]:
        """Turns inserted after the last row."""
        _inserted(self.costs)
        while self.last is not None and not any(s in ACCEPTING and self.costs[s] == self.total for s in self.at):
            self.at = {ONWARD[s] for s in self.at if self.costs[s] + INSERT + AT_END[ONWARD[s]] == self.total}
            self.audit.append("I")
            yield "I", *self._emit(_ROLE[min(self.at)], "")

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, gaps, *self.counts.values(), self.illegal, self.total, "".join(self.audit), self.digest.hexdigest())


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Walk | None, list | None]]:
    """(walk, edits) of every row in order; (walk, None) when a conversation is over; (None, None) after a batch."""
    kinds, walk = _Arcs(), None
    for batch in batches:
        read = (batch.column(n).to_pylist() for n in ("conv_id", "gone", "turn", "role", "text", "fault", "c0", "c1", "c2", "c3"))
        for conv, gone, turn, role, text, fault, *after in zip(*read, strict=True):
            if walk is None or conv != walk.conv:
                if walk is not None:
                    yield walk, list(walk.end())
                    yield walk, None
                walk = Walk(conv)
            if not gone:
                yield walk, list(walk.row(turn, role, text, fault, kinds[role[:1], fault], tuple(after)))
        yield None, None
    if walk is not None:
        yield walk, list(walk.end())
        yield walk, None


def _walk_ready(rows: DataFrame) -> DataFrame:
    return with_costs(faulted(rows)).sortWithinPartitions(*_order(False))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): every edit of every conversation; deleted rows have no place, role or text."""
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, place long, edit string, role string, text string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out, place = None, [], 0
        for walk, edits in _walks(_typed(batches, seen := [])):
            kinds = kinds or _arrow(seen[0], ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()))
            if walk is not None and edits is None:
                place = 0
            for letter, role, text in edits or ():
                place += letter != "D"
                out.append((walk.conv, None if letter == "D" else place, letter, role, text))
            if walk is None or edits is None and len(out) >= 4096:
                yield _rows(out, kinds)
                out = []
        if out:
            yield _rows(out, kinds)

    return _walk_ready(rows).mapInArrow(work, schema)


def repair_reports(rows: DataFrame) -> DataFrame:
    """One row a conversation: faults, cost, edits and the digest of what the repair leaves.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, " + ", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out = None, []
        for walk, edits in _walks(_typed(batches, seen := [])):
            kinds = kinds or _arrow(seen[0], *[(n, pa.int64()) for n in names], ("audit", pa.string()), ("repaired_sha256", pa.string()))
            if walk is not None and edits is None:
                out.append(walk.report())
            if walk is None and out:
                yield _rows(out, kinds)
                out = []
        if out:
            yield _rows(out, kinds)

    return _walk_ready(rows).mapInArrow(work, schema)


def _typed(batches: Iterator[pa.RecordBatch], seen: list) -> Iterator[pa.RecordBatch]:
    """The batches; the first one's type of conv_id goes to ``seen``."""
    for batch in batches:
        if not seen:
            seen.append(batch.schema.field("conv_id").type)
        yield batch


def _arrow(conv: pa.DataType, *more: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("conv_id", conv), *more])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair_reports(damaged(table(spark, sf_dir, "conversations")))
