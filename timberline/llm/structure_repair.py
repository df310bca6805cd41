"""The cheapest edits that give a conversation a legal structure, by iterative-deepening A*.

A conversation is legal if its roles read ``(s?(ua)+)?``: nothing, or an optional system turn and then pairs of user and
assistant turns. Its turns are read as short codes; a depth-first search runs through the edits of each turn in the order of
their letters (D, I, K, R) under a bound on their cost, which rises to the least cost that it went beyond until a
path ends in a legal state; the first such path is the cheapest and, among those, the first in ASCII order. What a state
was found to cost at least is kept in a table, so no state is searched twice under the same rest of the bound. The
estimate that starts this table is the cost of the same edits if a conversation might end after any turn.

Turns are shuffled twice by conversation: once as codes for the search, once as they are, behind the edits found.
A task streams over its turns and holds one byte a turn of the conversation at hand and, in the first pass, its
search table; texts are never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.prefix_trie import turn_digest

DELETE, INSERT, REROLE, UNFINISHED = 4, 3, 3, 3  # costs
SPACE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}

# A code is 3 * kind + fault; kinds by the role's initial.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, GONE, CUT = range(3)

# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, OPENED, ASKED, ANSWERED = range(4)
_LEGAL_ENDS = (START, ANSWERED)
_REPEATED_CODES = 48  # turns of a conversation whose edits are remembered for the next one alike


def _after(state: int) -> int:
    """The state after the turn that has to come next."""
    return ANSWERED if state == ASKED else ASKED


def _keeps(kind: int, state: int) -> int | None:
    """The state after a turn of ``kind`` is kept, None if it may not be."""
    if kind == SYSTEM:
        return OPENED if state == START else None
    if kind == (ASSISTANT if state == ASKED else USER):
        return _after(state)
    return None


def _moves(codes: bytes, i: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next node) of the edits possible before turn ``i``, by letter; node 4 * i + state."""
    there = i < len(codes)
    if there:
        kind, fault = divmod(codes[i], 3)
        yield "D", DELETE, 4 * (i + 1) + state
    yield "I", INSERT, 4 * i + _after(state)
    if there and fault != GONE:
        more = UNFINISHED if fault == CUT else 0
        kept = _keeps(kind, state)
        if kept is not None:
            yield "K", more, 4 * (i + 1) + kept
        yield "R", REROLE + more, 4 * (i + 1) + _after(state)


def _estimates(codes: bytes) -> list[int]:
    """Per node, the least cost of the rest if every state were a legal end: never above the true one."""
    n = len(codes)
    least = [0] * (4 * n + 4)
    for i in range(n - 1, -1, -1):
        kind, fault = divmod(codes[i], 3)
        more = UNFINISHED if fault == CUT else 0
        at, on = 4 * i, 4 * i + 4
        for state in (START, OPENED, ASKED, ANSWERED):
            cost = DELETE + least[on + state]
            if fault != GONE:
                kept = _keeps(kind, state)
                cost = min(cost, REROLE + more + least[on + _after(state)])
                if kept is not None:
                    cost = min(cost, more + least[on + kept])
            least[at + state] = cost
        # One inserted turn leads from asked to answered, or from all others to asked.
        asked, answered = least[at + ASKED], least[at + ANSWERED]
        for state in (START, OPENED, ANSWERED):
            least[at + state] = min(least[at + state], INSERT + asked)
        least[at + ASKED] = min(asked, INSERT + answered)
    return least


def _search(codes: bytes) -> tuple[int, str]:
    least = _estimates(codes)
    end = 4 * len(codes)
    while True:
        bound = least[START]
        path: list[str] = []
        stack = [[START, 0, _moves(codes, 0, START), None, 0]]  # node, cost so far, moves, least cost found, cost of the last move
        while stack:
            frame = stack[-1]
            node, so_far, moves = frame[0], frame[1], frame[2]
            if node >= end and node - end in _LEGAL_ENDS:
                return so_far, "".join(path)
            for letter, cost, child in moves:
                rest = cost + least[child]
                if so_far + rest <= bound:
                    frame[4] = cost
                    path.append(letter)
                    stack.append([child, so_far + cost, _moves(codes, child >> 2, child & 3), None, 0])
                    break
                if frame[3] is None or rest < frame[3]:
                    frame[3] = rest
            else:
                # Failed: what the cheapest edit from here costs is now known to be beyond the bound.
                least[node] = max(least[node], frame[3])
                stack.pop()
                if stack:
                    above = stack[-1]
                    path.pop()
                    rest = above[4] + least[node]
                    if above[3] is None or rest < above[3]:
                        above[3] = rest


@lru_cache(maxsize=1 << 16)
def _remembered(codes: bytes) -> tuple[int, str]:
    return _search(codes)


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of a conversation given by the codes of its turns."""
    return (_remembered if len(codes) <= _REPEATED_CODES else _search)(codes)


def _coded(turns: DataFrame) -> DataFrame:
    """(``conv_id``, ``turn``, ``digest``, ``code``, ``known``) of every turn, laid out by conversation in order."""
    role, text = F.col("role"), F.col("text")
    trimmed = F.rtrim(text, F.lit(SPACE))
    same = Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())
    initial = F.substring(role, 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    rows = turns.select(
        "conv_id", "turn", turn_digest(role, text).alias("digest"), kind.alias("kind"),
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    # The window needs no shuffle of its own: all rows of a conversation are in one task already.
    rows = rows.repartition("conv_id").withColumn("copy", F.row_number().over(same))
    fault = F.when(F.col("blank"), "b").when(F.col("copy") > 1, "d").when(F.col("cut"), "t").otherwise("")
    coded = rows.select("conv_id", "turn", "digest", "copy", "kind", fault.alias("fault"))
    return coded.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest", "copy")


_FIGURES = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


class _Conversation:
    """What one conversation adds up to, turn by turn."""

    def __init__(self):
        self.codes = bytearray()
        self.faults = {"b": 0, "d": 0, "t": 0}
        self.first = self.last = None
        self.distinct = 0

    def add(self, turns: list, kinds: list, faults: list) -> None:
        for turn, kind, fault in zip(turns, kinds, faults):
            if turn is not None and turn != self.last:
                self.distinct += 1
                self.first = turn if self.first is None else self.first
                self.last = turn
            if fault:
                self.faults[fault] += 1
            self.codes.append(3 * kind + (FINE if not fault else CUT if fault == "t" else GONE))

    def figures(self) -> tuple:
        kinds = bytes(c // 3 for c in self.codes)
        legal = ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
        illegal = sum(pair not in legal for pair in zip(kinds, kinds[1:]))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (gaps, *self.faults.values(), illegal, *cheapest_edits(bytes(self.codes)))


def _runs(keys: list) -> Iterator[tuple[int, int]]:
    """Borders of the runs of equal keys."""
    at = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[at]:
            yield at, i
            at = i


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [pa.int64()] * 7 + [pa.string()]
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    now, conversation = None, None
    for batch in batches:
        ids, turns, kinds, faults = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "kind", "fault"))
        done = []
        for at, to in _runs(ids):
            if conversation is None or ids[at] != now:
                if conversation is not None:
                    done.append((now, *conversation.figures()))
                now, conversation = ids[at], _Conversation()
            conversation.add(turns[at:to], kinds[at:to], faults[at:to])
        if done:
            yield batch_of(done)
    if conversation is not None:
        yield batch_of([(now, *conversation.figures())])


def audits(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per conversation of ``members``: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``,
    ``cost`` and ``audit``, the letters of its edits.

    ``turns`` has (``conv_id``, ``turn``, ``role``, ``text``) without null roles or texts, ``members`` each ``conv_id`` once (null is one).
    Turns are read by number, null first, and those of equal number by the digest of role and text. A conversation
    without turns has zeros and no edits. The first fault of a turn counts: blank; a copy of an earlier turn; an
    end without ``. ! ?``. ``illegal`` counts neighbours that are not su, ua or au; ``gaps`` the numbers that are
    missing between the least and the greatest.
    """
    found = _coded(turns).mapInArrow(_searched, f"conv_id bigint, {_FIGURES}").withColumnRenamed("conv_id", "_found")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    joined = members.join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left")
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
    )


def _edited(audit: str, role_of: Callable[[], tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired turns; ``role_of`` gives the next turn of the input."""
    state = START
    for letter in audit:
        if letter == "I":
            yield ROLES["a" if state == ASKED else "u"], ""
            state = _after(state)
            continue
        role, text = role_of()
        if letter == "R":
            role = ROLES["a" if state == ASKED else "u"]
        if letter != "D":
            yield role, text
            state = OPENED if letter == "K" and role[:1] == "s" else _after(state)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """Per conversation its audit row and its repaired turns, which must be read to the end."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for piece in range(0, batch.num_rows, 1024):
                yield from batch.slice(piece, 1024).to_pylist()

    stream = rows()

    def role_of() -> tuple[str, str]:
        row = next(stream)
        return row["role"], row["text"]

    for head in stream:
        yield head, _edited(head["audit"], role_of)


def _laid_out(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's audit row and then its turns in order."""
    rows = turns.select(
        "conv_id", F.lit(1).alias("rank"), F.col("turn"), turn_digest(F.col("role"), F.col("text")).alias("digest"), "role", "text"
    )
    heads = found.withColumn("rank", F.lit(0))
    both = heads.unionByName(rows, allowMissingColumns=True).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "rank", F.col("turn").asc_nulls_first(), "digest")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    kept = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    schema = pa.schema([(c, pa.string() if c == "audit" else pa.int64()) for c in kept] + [("repaired_sha256", pa.string())])
    for head, turns in _streams(batches):
        digest = hashlib.sha256()
        for i, (role, text) in enumerate(turns):
            digest.update(f"{chr(10) if i else ''}{role}:{text}".encode())
        held.append({**{c: head[c] for c in kept}, "repaired_sha256": digest.hexdigest()})
        if len(held) == 4096:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    held: list[tuple] = []
    for head, turns in _streams(batches):
        for i, (role, text) in enumerate(turns):
            held.append((head["conv_id"], i, role, text))
            if len(held) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def repair_digests(turns: DataFrame, members: DataFrame) -> DataFrame:
    """:func:`audits` and ``repaired_sha256``, of the repaired turns as ``role:text`` lines; of the empty text where none is left."""
    laid = _laid_out(turns, audits(turns, members))
    return laid.mapInArrow(_digests, f"conv_id bigint, {_FIGURES}, repaired_sha256 string")


def repaired_turns(turns: DataFrame, members: DataFrame) -> DataFrame:
    """(``conv_id``, ``turn``, ``role``, ``text``) of the repaired conversations, turns numbered from 0 without gaps.

    Arguments as for :func:`audits`; conversations that are left without turns have no row. Inserted turns have an empty text.
    """
    return _laid_out(turns, audits(turns, members)).mapInArrow(_repaired, "conv_id bigint, turn bigint, role string, text string")

