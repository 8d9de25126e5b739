"""Conversation structure repair by error-correcting Earley parsing.

A conversation's roles shall read `(s?(ua)+)?`: a system turn at most, then user and
assistant by turns. The grammar is left-linear and weighted; besides the productions
that keep a row there are error productions that delete one, give it another role, or
insert an empty turn. The parser goes through a conversation's rows in order; every
item of its chart keeps the least (cost, audit), the audit being the initials of the
edits so far (Delete, Insert, Keep, Rerole). The least completed chart yields the repair.

Every item begins at the first row (the grammar recurs on the left), so only the last
column of the chart is needed. Two audits of one item that cost the same consume the
same rows, so neither begins with the other, and the lesser one stays the lesser
whatever follows. An item that another one beats by more than it costs to go on in its
place is dropped. So a conversation goes through its task as a stream, each item with the
running hash of its own repair; no text is kept. Kept of a conversation are its audits (a
character a row, and what all of them agree on only once) and 16 bytes for each distinct
row, by which repeated rows are known. A conversation's repaired text has one hash, so
one task has to see all of it in order. repaired_turns() gives turns out as soon as all
audits agree on them, and keeps those on which they don't.

Faults, of which a row has the first: blank (no character but white space), duplicate
(role and text came before), truncated (the last character that is not white space is
not one of .!?). Blank and duplicate rows have to be deleted; a truncated one costs more.

Defined results: null roles and texts are one space, so their rows are of no role, or
blank; rows without conversation id are one conversation; rows that share a turn come by
role, then text, and null turns first; an empty role has no initial; an empty table gives
an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What edits cost, and what a truncated row that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: left side: right sides, each a nonterminal and the initial of the role that follows; () is the empty one.
GRAMMAR = {"none": ((),), "system": (("none", "s"),), "asked": (("none", "u"), ("system", "u"), ("pair", "u")), "pair": (("asked", "a"),)}
ACCEPTED = ("none", "pair")
#: How much more the best way on from the first may cost than the best from the second, for any rest: the inserts that lead there, or what replaces a system turn kept later.
BEHIND = {
    ("none", "system"): 0, ("none", "asked"): 3, ("none", "pair"): 6, ("system", "none"): 6, ("system", "asked"): 3, ("system", "pair"): 6,
    ("asked", "none"): 7, ("asked", "system"): 3, ("asked", "pair"): 3, ("pair", "none"): 4, ("pair", "system"): 0, ("pair", "asked"): 3,
}
_NEXT = {left: [(parent, right[1]) for parent, rights in GRAMMAR.items() for right in rights if right and right[0] == left] for left in GRAMMAR}
WHITE = "\x20\x09\x0A\x0B\x0C\x0D"

#: By nonterminal: cost, audit, and the nonterminal of the column before that it comes from.
Best = dict[str, tuple[int, str, str]]


def _closed(items: Best) -> Best:
    """Predicts and completes within a column: what inserts reach, the least (cost, audit) of each nonterminal."""
    queue = sorted((cost, audit, source, n) for n, (cost, audit, source) in items.items())
    done: Best = {}
    while queue:
        cost, audit, source, n = heappop(queue)
        if n in done:
            continue
        done[n] = cost, audit, source
        for parent, initial in _NEXT[n]:
            if initial in ROLES and parent not in done:
                heappush(queue, (cost + INSERT, audit + "I", source, parent))
    return done


def _scanned(column: Best, initial: str, extra: int, must_go: bool) -> Best:
    """The next column's items after a row: deleted, kept or given another role."""
    out: Best = {}

    def offer(n: str, cost: int, audit: str, source: str) -> None:
        if n not in out or (cost, audit) < out[n][:2]:
            out[n] = cost, audit, source

    for n, (cost, audit, _) in column.items():
        offer(n, cost + DELETE, audit + "D", n)
        if not must_go:
            for parent, wanted in _NEXT[n]:
                if wanted == initial:
                    offer(parent, cost + KEEP + extra, audit + "K", n)
                if wanted in ROLES:
                    offer(parent, cost + REROLE + extra, audit + "R", n)
    return out


def _pruned(column: Best) -> Best:
    """Without items that can't be part of the least parse."""
    return {n: item for n, item in column.items() if not any(m != n and other[0] + BEHIND[m, n] < item[0] for m, other in column.items())}


def _role(before: str, edit: str, role: str) -> str:
    """Of a turn of the repair: roles that edits give follow from the one before."""
    return role if edit == "K" else ROLES["a" if before == "u" else "u"]


class Text:
    """SHA-256 of the lines of one item's repair."""

    def __init__(self) -> None:
        self.hashed, self.before = hashlib.sha256(), ""

    def followed(self, edits: str, role: str, text: str) -> Text:
        """After the edits of one row: at most one takes it, inserts come before or behind."""
        new = Text()
        new.hashed, new.before = self.hashed.copy(), self.before
        for edit in edits:
            if edit != "D":
                now = _role(new.before, edit, role)
                line = f"{now}:{'' if edit == 'I' else text}"
                new.hashed.update((chr(10) + line if new.before else line).encode("utf-8", "surrogatepass"))
                new.before = now[:1]
        return new


class Repair:
    """One conversation, row after row.

    With texts, take() and end() give the turns of the repair that are decided, as (edit, role, text);
    else each item hashes its own repair.
    """

    def __init__(self, texts: bool = False) -> None:
        self.column = _closed({"none": (0, "", "none")})
        self.texts = texts
        self.hashes = {n: Text().followed(audit, "", "") for n, (_, audit, _) in self.column.items()}
        self.sha256 = hashlib.sha256().hexdigest()
        self.waiting: deque[tuple[str, str]] = deque()
        self.audit: list[str] = []
        self.seen: set[bytes] = set()
        self.last_turn: int | None = None
        self.first_turn: int | None = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.initial: str | None = None
        self.role_before = ""

    def take(self, turn: int | None, role: str, text: str) -> list[tuple[str, str, str]]:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        last = text.rstrip(WHITE)[-1:]
        blank, duplicate = not last, key in self.seen
        truncated = not blank and not duplicate and last not in ".!?"
        self.seen.add(key)
        self.blank += blank
        self.duplicate += not blank and duplicate
        self.truncated += truncated
        before = {n: len(audit) for n, (_, audit, _) in self.column.items()}
        self.column = _pruned(_closed(_scanned(self.column, initial, TRUNCATED * truncated, blank or duplicate)))
        if self.texts:
            self.waiting.append((role, text))
        else:
            self.hashes = {n: self.hashes[source].followed(audit[before[source] :], role, text) for n, (_, audit, source) in self.column.items()}
        sure = os.path.commonprefix([audit for _, audit, _ in self.column.values()])
        self.column = {n: (cost, audit[len(sure) :], source) for n, (cost, audit, source) in self.column.items()}
        return self._decided(sure)

    def end(self) -> list[tuple[str, str, str]]:
        self.cost, rest, n = min((*self.column[n][:2], n) for n in ACCEPTED if n in self.column)
        self.sha256 = self.hashes[n].hashed.hexdigest() if not self.texts else ""
        return self._decided(rest)

    def _decided(self, edits: str) -> list[tuple[str, str, str]]:
        out: list[tuple[str, str, str]] = []
        self.audit.append(edits)
        if not self.texts:
            return out
        for edit in edits:
            role, text = ("", "") if edit == "I" else self.waiting.popleft()
            if edit != "D":
                role = _role(self.role_before, edit, role)
                self.role_before = role[:1]
                out.append((edit, role, text))
        return out

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"


def _conversations(batches: Iterator[pa.RecordBatch], with_texts: bool) -> Iterator[tuple[int | None, Repair, list[tuple[str, str, str]], bool]]:
    """(id, state, turns decided, is it the end?) along rows sorted by conversation."""
    now, state = None, None
    for b in batches:
        ids, turns, roles, texts, gone = (b.column(i) for i in range(5))
        ids, turns, roles, gone = ids.to_pylist(), turns.to_pylist(), roles.to_pylist(), gone.to_pylist()
        for i, conv in enumerate(ids):
            if state is None or conv != now:
                if state is not None:
                    yield now, state, state.end(), True
                now, state = conv, Repair(with_texts)
            if not gone[i]:
                yield now, state, state.take(turns[i], roles[i], texts[i].as_py()), False
    if state is not None:
        yield now, state, state.end(), True


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in SUMMARY.split(", ")]
    out = lambda: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    for conv, s, _, ended in _conversations(batches, False):
        if ended:
            rows.append((conv, s.gaps, s.blank, s.duplicate, s.truncated, s.illegal, s.cost, "".join(s.audit), s.sha256))
            if len(rows) >= 1000:
                yield out()
                rows = []
    if rows:
        yield out()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = 0
    rows: list[tuple] = []
    size = 0
    out = lambda: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "place", "edit", "role", "text"])
    for conv, _, turns, ended in _conversations(batches, True):
        for edit, role, text in turns:
            place += 1
            size += len(text)
            rows.append((conv, place, edit, role, text))
        if len(rows) >= 1000 or size > 1 << 22:
            yield out()
            rows, size = [], 0
        if ended:
            place = 0
    if rows:
        yield out()


def _ordered(convs: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, gone: Column | None) -> DataFrame:
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = convs.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), some(role_col).alias("role"), some(text_col).alias("text"), F.coalesce(gone if gone is not None else F.lit(False), F.lit(False)).alias("gone")
    )
    return given.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def repair(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """A row for each conversation: conv_id, gaps (numbers missing between its turns), rows by fault, illegal (neighbours whose roles don't follow each other), cost and audit of the repair, SHA-256 of its `role:text` lines.

    Rows for which gone holds are not there, but their conversation is.
    """
    return _ordered(convs, id_col, turn_col, role_col, text_col, gone).mapInArrow(_summaries, SUMMARY)


def repaired_turns(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """The turns of every repaired conversation: conv_id, place (from 1), edit (K, R or I), role, text."""
    return _ordered(convs, id_col, turn_col, role_col, text_col, gone).mapInArrow(_turns, TURNS)
