"""Repair of conversations whose turns are out of grammar: the cheapest edits, by dynamic programming over turn and state.

A repaired conversation's role initials read ``(s?(ua)+)?``. Kept rows cost nothing, rows given another role 3, deleted
rows 4, inserted ones 3, and a truncated row that stays 3 more; blank rows and duplicates must go. Costs to go are
found backwards over rows and grammar states, then a walk forwards takes the ASCII-least edit among those that reach
them, so of all cheapest repairs the least audit comes out.

Nothing holds a conversation in one task but the final pass, which streams over its rows in order, since one SHA-256 of a
text has to. Rows are sorted by range, so that one conversation may lie in many tasks, and cut into fragments of at
most ``FRAGMENT`` rows, one byte a row. A fragment's backward step is a (min, +) matrix of the four states: composing
these gives every fragment the cost vector behind it, and with it each fragment walks, on its own, from every state it
could be entered in. Copies of one row are counted before the first shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorespan.llm import text as T
from lorespan.llm.store import discard, settle

C = F.col
FRAGMENT = 4096
BLANKS = " \t\n\x0b\x0c\r"
KEEP_COST, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Grammar states: nothing yet, after system, after user, after assistant; conversations may end in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row goes whose role may be chosen, and what it is called.
CHOSEN = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Where a row goes that keeps its role, by its initial's place in "sua".
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Faults in a row's code: initial + 4 * fault, and 16 for a further copy of a row.
BLANK, DUPLICATE, CUT = 1, 2, 3
_FAR = 1 << 60


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows harmed by crc32(``conv:turn``) % 20: dropped, emptied, without ends of sentences, twice, or with role user.

    Nulls count as one space, in the key as well; all columns stay.
    """
    said = lambda c: F.coalesce(C(f"`{c}`").cast("string"), F.lit(" "))
    how = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col))) % 20
    text = F.when(how == 1, F.lit("")).when(how == 2, F.translate(said(text_col), ".!?", "")).otherwise(said(text_col))
    role = F.when(how == 4, F.lit("user")).otherwise(said(role_col))
    out = rows.filter(how != 0)
    values = {role_col: role, text_col: text}
    twice = F.explode(F.when(how == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    copy = max(out.columns, key=len) + "_"  # a name that rows have not
    return out.select(*((values[c].alias(c) if c in values else C(f"`{c}`")) for c in rows.columns), twice.alias(copy)).drop(copy)


def _faulty(rows: DataFrame) -> DataFrame:
    """k, t, r, h and the code of every row (k, t, r, x), in order of k, t, r, h within and across partitions; ``row`` counts on."""
    trimmed = F.rtrim(C("x"), F.lit(BLANKS))
    fault = F.when(trimmed == "", BLANK).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.left("r", F.lit(1))), F.lit(0)) - 1, F.lit(3))
    compact = rows.select("k", "t", "r", _hash().alias("h"), fault.alias("fault"), F.when(C("r") == "", 3).otherwise(initial).alias("initial"))
    counted = compact.groupBy("k", "t", "r", "h", "fault", "initial").agg(F.count("*").alias("n"))
    again = counted.groupBy("k", "h").agg(F.count("*").alias("turns"), F.max(C("t").isNull()).alias("untimed"), F.min("t").alias("least"))
    again = again.filter("turns > 1").select(C("k").alias("k2"), C("h").alias("h2"), "untimed", "least")
    later = C("h2").isNotNull() & C("t").isNotNull() & (C("untimed") | (C("t") > C("least")))
    marked = counted.join(again, C("k").eqNullSafe(C("k2")) & (C("h") == C("h2")), "left").withColumn("later", F.coalesce(later, F.lit(False)))
    copies = marked.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("c"))
    second = (C("fault") != BLANK) & (C("later") | (C("c") > 1))
    code = C("initial") + 4 * F.when(second, DUPLICATE).otherwise(C("fault")) + F.when(C("c") > 1, 16).otherwise(0)
    by = ["k", "t", "r", "h", "c"]
    placed = copies.select(*by, code.cast("int").alias("code")).repartitionByRange(*by).sortWithinPartitions(*by)
    return settle(placed.select("k", "t", "r", "h", "code", F.monotonically_increasing_id().alias("row")))


def _hash() -> Column:
    return F.md5(F.concat(F.length("r"), F.lit(":"), C("r"), C("x")))


def _closed(costs: list[int]) -> list[int]:
    """Costs to go where rows may be inserted first."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[CHOSEN[s]]) for s, c in enumerate(costs)]
    return costs


FINAL = tuple(_closed([0, _FAR, _FAR, 0]))


@lru_cache(maxsize=1 << 16)
def _edits(code: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of what may be done with a row."""
    initial, fault = code & 3, code >> 2 & 3
    out = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        if KEPT[state][initial] is not None:
            out.append(("K", KEEP_COST + more, KEPT[state][initial]))
        out.append(("R", REROLE + more, CHOSEN[state]))
    return tuple(out)


@lru_cache(maxsize=1 << 16)
def _before(code: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs to go before a row, less the least of them, and that; few differ, so they are looked up."""
    costs = _closed([min(cost + after[to] for _, cost, to in _edits(code, s)) for s in range(4)])
    least = min(costs)
    return tuple(min(c - least, _FAR) for c in costs), least


def backward(codes: bytes, after: tuple[int, ...]) -> tuple[list[tuple[int, ...]], list[int]]:
    """Cost vectors at 0 .. len(codes), each less its own base; the bases."""
    least = min(after)
    vectors, bases = [tuple(min(c - least, _FAR) for c in after)], [least]
    for code in reversed(codes):
        vector, more = _before(code, vectors[-1])
        vectors.append(vector)
        bases.append(bases[-1] + more)
    return vectors[::-1], bases[::-1]


def cost_map(codes: bytes) -> list[int]:
    """The (min, +) matrix from costs behind the rows to costs before them, row by row."""
    columns = []
    for end in range(4):
        vectors, bases = backward(codes, tuple(0 if s == end else _FAR for s in range(4)))
        columns.append([min(c + bases[0], _FAR) for c in vectors[0]])
    return [columns[end][s] for s in range(4) for end in range(4)]


def walk(codes: bytes, after: tuple[int, ...], state: int) -> tuple[int, str, str]:
    """(state behind the rows, audit, the same without further copies) of the ASCII-least cheapest edits.

    Copies are always deleted as they come: a delete that can be tight is tight at once, and first in ASCII.
    """
    vectors, bases = backward(codes, after)
    audit, lines = [], []
    for i, code in enumerate(codes):
        here, there, more = vectors[i], vectors[i + 1], bases[i] - bases[i + 1]
        while True:
            tight = {e: to for e, cost, to in _edits(code, state) if cost + there[to] == here[state] + more}
            if INSERT + here[CHOSEN[state]] == here[state]:
                tight["I"] = CHOSEN[state]
            edit = min(tight)
            audit.append(edit)
            if not code & 16:
                lines.append(edit)
            state = tight[edit]
            if edit != "I":
                break
    return state, "".join(audit), "".join(lines)


def _fragments(kinds: dict[str, pa.DataType], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one conversation, cut at multiples of FRAGMENT and where a split of the table begins."""
    head, codes, out, last = None, bytearray(), [], -2

    def flush():
        initials = [c & 3 for c in codes]
        illegal = sum(p not in LEGAL for p in zip(initials, initials[1:], strict=False))
        faults = [c >> 2 & 3 for c in codes]
        out.append((*head, bytes(codes), cost_map(bytes(codes)), [*map(faults.count, (BLANK, DUPLICATE, CUT)), illegal, initials[0], initials[-1]]))

    def batch():
        values = list(zip(*out, strict=True)) or [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[n]) for n, v in zip(names, values, strict=True)], names=names)

    names = ["k", "t", "r", "h", "first", "codes", "map", "counts"]
    for rows in batches:
        for k, t, r, h, code, row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if row != last + 1 or not row % FRAGMENT or k != head[0]:
                if codes:
                    flush()
                head, codes = (k, t, r, h, row), bytearray()
            codes.append(code)
            last = row
        if out:
            yield batch()
    if codes:
        flush()
        yield batch()


def _followed(names: list[str], kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments, the last of each conversation first, with the costs behind and before them."""
    before, conv = FINAL, object()
    for rows in batches:
        behind = []
        for k, m in zip(rows.column("k").to_pylist(), rows.column("map").to_pylist(), strict=True):
            after = before if k == conv else FINAL
            conv, before = k, tuple(min(_FAR, min(m[4 * s + e] + after[e] for e in range(4))) for s in range(4))
            behind.append((after, before[START]))
        yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array([x[0] for x in behind], pa.list_(pa.int64())), pa.array([x[1] for x in behind], pa.int64())], names=[*names, "after", "cost"])


def _walked(names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        found = [[walk(c, tuple(a), s) for s in range(4)] for c, a in zip(rows.column("codes").to_pylist(), rows.column("after").to_pylist(), strict=True)]
        own = [pa.array([[f[i] for f in x] for x in found], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), *own], names=[*names, "exits", "audits", "lines"])


def _planned(rows: DataFrame) -> DataFrame:
    """Rows (k, t, r, x) with the edits of each fragment before its first row, and a first row for every conversation.

    All of a conversation is in one partition, in order. ``kind`` is 0 for fragments, 1 for rows.
    """
    placed = _faulty(rows)
    types = {n: placed.schema[n].dataType for n in "kt"}
    k, t = (types[n].simpleString() for n in "kt")
    kinds = {**{n: to_arrow_type(x) for n, x in types.items()}, "r": pa.string(), "h": pa.string(), "first": pa.int64(), "codes": pa.binary(), "map": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
    base = f"k {k}, t {t}, r string, h string, first long"
    fragments = T.mapped(placed, partial(_fragments, kinds), f"{base}, codes binary, map array<long>, counts array<long>")
    last_first = fragments.repartition("k").sortWithinPartitions("k", F.desc("first"))
    names = ["k", "t", "r", "h", "first", "codes", "counts"]
    followed = T.mapped(last_first, partial(_followed, names, kinds["k"]), f"{base}, codes binary, counts array<long>, after array<long>, cost long")
    names = ["k", "t", "r", "h", "first", "counts", "cost"]
    walked = T.mapped(followed.repartition("k", "first"), partial(_walked, names), f"{base}, counts array<long>, cost long, exits array<int>, audits array<string>, lines array<string>")
    edits = settle(walked.withColumn("kind", F.lit(0)))
    discard(placed)
    return edits.unionByName(rows.select("k", "t", "r", _hash().alias("h"), "x", F.lit(1).alias("kind")), allowMissingColumns=True)


def _in_order(lines: DataFrame) -> DataFrame:
    by = ("k", "t", "r", "h", "kind", "first")
    return lines.repartition("k").sortWithinPartitions(*by)


class _Repair:
    """One conversation's rows and edits, as they come."""

    def __init__(self):
        self.state, self.edits, self.audit = START, iter(()), []
        self.entry, self.queue, self.counts, self.last, self.cost = START, [], [0] * 4, None, 0
        self.seen = self.low = self.high = None
        self.turn_count = 0

    def fragment(self, exits, audits, lines, cost, counts):
        if self.last is None:
            self.cost = cost
        else:
            self.counts[3] += (self.last, counts[4]) not in LEGAL
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=False)]
        self.last = counts[5]
        self.audit.append(audits[self.entry])
        self.queue.append(lines[self.entry])
        self.entry = exits[self.entry]

    def _letters(self):
        while True:
            try:
                return next(self.edits)
            except StopIteration:
                self.edits = iter(self.queue.pop(0))

    def row(self, t, r, h, x):
        """Turns (edit, role, text) that come of the row; none for further copies."""
        if t is not None and t != self.high:
            self.low, self.high, self.turn_count = t if self.low is None else self.low, t, self.turn_count + 1
        if self.seen == (t, r, h):
            return
        self.seen = t, r, h
        while (edit := self._letters()) == "I":
            yield self._chosen(edit, "")
        if edit == "K":
            self.state = KEPT[self.state]["sua".index(r[0])]
            yield edit, r, x
        elif edit == "R":
            yield self._chosen(edit, x)

    def _chosen(self, edit, x):
        self.state = CHOSEN[self.state]
        return edit, NAMES[self.state], x

    def end(self):
        while self.state not in (START, ASSISTANT):
            self.audit.append("I")
            yield self._chosen("I", "")


def _conversations(batches: Iterator[pa.RecordBatch]):
    """(conversation, Repair, its turns as an iterator to be used up) one after another."""
    names = ("k", "t", "r", "h", "kind", "x", "exits", "audits", "lines", "cost", "counts")
    rows = (row for b in batches for row in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True))
    for k, own in groupby(rows, itemgetter(0)):
        repair = _Repair()

        def turns(own=own, repair=repair):
            for _, t, r, h, kind, x, *fragment in own:
                if kind == 0:
                    repair.fragment(*fragment)
                elif kind == 1:
                    yield from repair.row(t, r, h, x)
            yield from repair.end()

        yield k, repair, turns()


def _reported(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["k", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    out, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    for k, repair, turns in _conversations(batches):
        digest, first = hashlib.sha256(), True
        for _, role, text in turns:
            digest.update(("" if first else "\n").encode() + role.encode() + b":")
            digest.update(text.encode())
            first = False
        audit = "".join(repair.audit)
        gaps = repair.high - repair.low + 1 - repair.turn_count if repair.turn_count else 0
        out.append((k, gaps, *repair.counts, repair.cost, audit, digest.hexdigest()))
        size += 200 + len(audit)
        if size > T.BATCH_BYTES:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def _rebuilt(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["k", "position", "edit", "role", "text"], [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
    out, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    for k, _, turns in _conversations(batches):
        for position, (edit, role, text) in enumerate(turns):
            out.append((k, position, edit, role, text))
            size += 100 + len(text)
            if size > T.BATCH_BYTES:
                yield batch()
                out, size = [], 0
    if out:
        yield batch()


def _plain(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    said = lambda c: F.coalesce(C(f"`{c}`").cast("string"), F.lit(" "))
    return rows.select(C(f"`{conv_col}`").alias("k"), C(f"`{turn_col}`").cast("long").alias("t"), said(role_col).alias("r"), said(text_col).alias("x"))


def repair_report(rows: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for every conversation of ``conversations`` (default: rows), a null id being one of them.

    ``gaps`` counts the turn numbers missing between the least and the greatest, null ones aside; ``blank``,
    ``duplicate`` and ``truncated`` rows by their first fault; ``illegal`` neighbours; the repair's ``cost`` and its
    ``audit``, an initial an edit (Keep, Rerole, Delete, Insert); ``repaired_sha256`` of its lines ``role:text``. Rows are
    taken by turn, null turns first, and at one turn by role and a hash of role and text. Null roles and texts are one
    space; an empty role must be changed or go. A conversation without rows has zeros, no audit and the hash of
    nothing; an empty table has no conversations. Further columns are not read.
    """
    own = _plain(rows, conv_col, turn_col, role_col, text_col)
    lines = _planned(own)
    every = (rows if conversations is None else conversations).select(C(f"`{conv_col}`").alias("k")).distinct().withColumn("kind", F.lit(-1))
    k = own.schema["k"].dataType
    out = T.mapped(_in_order(lines.unionByName(every, allowMissingColumns=True)), partial(_reported, to_arrow_type(k)), f"k {k.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return out.withColumnRenamed("k", "conv_id")


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns of every repaired conversation: ``conv_id``, ``position`` from 0, ``edit`` (K, R or I), ``role``, ``text``. Cases as in the report."""
    own = _plain(rows, conv_col, turn_col, role_col, text_col)
    k = own.schema["k"].dataType
    out = T.mapped(_in_order(_planned(own)), partial(_rebuilt, to_arrow_type(k)), f"k {k.simpleString()}, position long, edit string, role string, text string")
    return out.withColumnRenamed("k", "conv_id")
