"""Operator 12: conversations repaired to ``(s?(ua)+)?`` at least cost, by a Viterbi search that commits early.

A row is a turn; its role counts by its first letter.  Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an
empty turn of user or assistant, anywhere) 2; a truncated row that is not deleted adds 1; blank and repeated rows must be
deleted.  Of the cheapest repairs the one whose string of edits (K, R, D, I) is least in ASCII is taken.

The search keeps one survivor for each state of the pattern (start, after s, after u, after a).  Their edits form a tree of
backpointers whose nodes count their users; as soon as all survivors share an ancestor, the edits above it are emitted and
freed.  A survivor that another one can follow for less, whatever comes, is dropped, so that the tree coalesces.  Ties are
broken by comparing the complete strings of edits since the last commit.  A task so holds the unresolved turns of one
conversation, not the conversation.

Rows are dealt by conversation in one shuffle, sorted by Spark, and streamed; repeats are found by a window in the same
shuffle.  A conversation's hash is a running one over its turns in order, so one conversation passes through one task, in a
stream of bounded memory but for its answer (a letter for each edit).

Defined results: rows are taken by turn (nulls first), then role, then text, then copy; a null role or text is one space; a
null conv_id is a conversation of its own; an empty role has no letter and can't be kept; conversations without rows give
zeros and empty strings; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

START, AFTER_S, AFTER_U, AFTER_A = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: Role and next state of a turn that is inserted or given another role.
NEXT = {START: ("user", AFTER_U), AFTER_S: ("user", AFTER_U), AFTER_U: ("assistant", AFTER_A), AFTER_A: ("user", AFTER_U)}
#: Where a kept turn leads, by state and the first letter of its role.
KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
LEGAL_PAIRS = frozenset(("su", "ua", "au"))
#: Faults of a row.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
ROWS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Edit:
    """A node of the tree: an edit, the turn it writes, and how many nodes and survivors stand on it."""

    __slots__ = ("parent", "letter", "turn", "uses")

    def __init__(self, parent: _Edit | None, letter: str = "", turn: str | None = None):
        self.parent, self.letter, self.turn, self.uses = parent, letter, turn, 0


class Repair:
    """The search over one conversation: ``row`` for each turn, then ``finish``; edits come out as ``edits`` and a hash."""

    def __init__(self):
        self.root = _Edit(None)
        self.edits: list[str] = []
        self.hash, self.first = hashlib.sha256(), True
        self.unresolved = self.most_unresolved = 0
        self.survivors: dict[int, tuple[int, _Edit]] = {START: (0, self.root)}
        self.root.uses = 1
        self._insert()

    def _since_commit(self, node: _Edit) -> str:
        letters = []
        while node is not self.root:
            letters.append(node.letter)
            node = node.parent
        return "".join(reversed(letters))

    def _offer(self, to: dict, state: int, cost: int, parent: _Edit, letter: str, turn: str | None) -> bool:
        """Puts a path into ``to`` if it is cheaper than the state's, or as cheap with a lesser string of edits."""
        if state in to:
            old_cost, old = to[state]
            if cost > old_cost or cost == old_cost and self._since_commit(parent) + letter >= self._since_commit(old):
                return False
        node = _Edit(parent, letter, turn)
        node.uses, self.unresolved = 1, self.unresolved + 1
        parent.uses += 1
        if state in to:
            self._drop(to[state][1])
        to[state] = (cost, node)
        return True

    def _drop(self, node: _Edit) -> None:
        node.uses -= 1
        while node.uses == 0 and node is not self.root:
            node = node.parent
            node.uses -= 1
            self.unresolved -= 1

    def _insert(self) -> None:
        for _ in range(2):  # two turns at most are worth inserting at one place
            for state in (START, AFTER_S, AFTER_A, AFTER_U):
                if state in self.survivors:
                    cost, node = self.survivors[state]
                    role, after = NEXT[state]
                    self._offer(self.survivors, after, cost + INSERT_COST, node, INSERT, f"{role}:")

    def row(self, role: str, text: str, fault: int) -> None:
        new: dict[int, tuple[int, _Edit]] = {}
        for state, (cost, node) in self.survivors.items():
            self._offer(new, state, cost + DELETE_COST, node, DELETE, None)
            if fault in (BLANK, DUPLICATE):
                continue
            extra = TRUNCATED_COST if fault == TRUNCATED else 0
            if (state, role[:1]) in KEPT:
                self._offer(new, KEPT[state, role[:1]], cost + extra, node, KEEP, f"{role}:{text}")
            other, after = NEXT[state]
            self._offer(new, after, cost + REROLE_COST + extra, node, REROLE, f"{other}:{text}")
        old, self.survivors = self.survivors, new
        for _, node in old.values():
            self._drop(node)
        self._insert()
        self._prune()
        self._commit()
        self.most_unresolved = max(self.most_unresolved, self.unresolved)

    def _prune(self) -> None:
        """What follows from after s, follows from after a too; from the start it does with one more deletion (of an s)."""
        if AFTER_A in self.survivors:
            least = self.survivors[AFTER_A][0]
            for state, more in ((AFTER_S, 0), (START, DELETE_COST)):
                if state in self.survivors and self.survivors[state][0] > least + more:
                    self._drop(self.survivors.pop(state)[1])

    def _commit(self) -> None:
        """Emits what all survivors share."""
        if self.root.uses != 1:
            return
        path = []
        node = next(iter(self.survivors.values()))[1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        while path and self.root.uses == 1:
            self.root = path.pop()
            self.root.parent = None
            self.unresolved -= 1
            self.edits.append(self.root.letter)
            if self.root.turn is not None:
                self.hash.update(("" if self.first else "\n").encode() + self.root.turn.encode("utf-8", "surrogatepass"))
                self.first = False

    def finish(self) -> tuple[int, str, str]:
        """Cost, string of edits and hash of the repaired conversation."""
        ends = {s: self.survivors[s] for s in (START, AFTER_A) if s in self.survivors}
        best = min(ends, key=lambda s: (ends[s][0], self._since_commit(ends[s][1])))
        for state in [s for s in self.survivors if s != best]:
            self._drop(self.survivors.pop(state)[1])
        cost, end = self.survivors[best]
        self._commit()
        assert self.root is end
        return cost, "".join(self.edits), self.hash.hexdigest()


def _text_or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of a conversation after damage by ``crc32(conv_id:turn) % 20``: conv_id, turn, role, text, copy; dropped ones are marked ``gone``."""
    kind = F.crc32(F.concat(_text_or_space("conv_id"), F.lit(":"), _text_or_space("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), kind.alias("kind"), _text_or_space("role").alias("role"), _text_or_space("text").alias("text"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds the first fault of each row: blank, duplicate (role and text seen earlier in the conversation), truncated, or 0."""
    seen = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"), "copy")
    bare = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = F.when(bare == "", BLANK).when(F.row_number().over(seen) > 1, DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return rows.withColumn("fault", fault)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, unset, schema = [], object(), pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (c.split() for c in ROWS.split(", "))])
    conv, search, counts, turns, letters, illegal = unset, None, None, None, None, 0

    def answer() -> tuple:
        cost, audit, digest = search.finish()
        least, most, distinct = turns if turns else (0, -1, 0)
        return (conv, most - least + 1 - distinct, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], illegal, cost, audit, digest)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for c, turn, role, text, gone, fault in zip(*(batch[n].to_pylist() for n in ("conv_id", "turn", "role", "text", "gone", "fault"))):
            if c != conv or conv is unset:
                if conv is not unset:
                    out.append(answer())
                conv, search, counts, turns, letters, illegal = c, Repair(), [0] * 4, None, None, 0
            if gone:
                continue
            counts[fault] += 1
            if turn is not None:  # rows come by turn
                turns = (turn, turn, 1) if turns is None else (turns[0], turn, turns[2] + (turn != turns[1]))
            illegal += letters is not None and letters + role[:1] not in LEGAL_PAIRS
            letters = role[:1]
            search.row(role, text, fault)
        if len(out) >= 1024:
            yield table(out)
            out = []
    if conv is not unset:
        out.append(answer())
    if out:
        yield table(out)


def repair_rows(rows: DataFrame) -> DataFrame:
    """Repairs conversations given as conv_id, turn, role, text, gone, copy (no nulls in role and text)."""
    # the window's partitions lie within those of conv_id, so one shuffle serves both
    marked = with_faults(rows.repartition("conv_id"))
    ordered = marked.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "copy")
    return ordered.select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(_streamed, ROWS)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Damages the conversations as above and returns each one's faults, cheapest edits and the hash of its repaired turns."""
    return repair_rows(damaged(conversations))


# ---- the same in DuckDB's SQL: a recursive search with one column for each state


def _move(state: str, letter: str, cost: str, turn: str | None) -> str:
    """A survivor after one more edit; null stays null."""
    turns = f"{state}.t" if turn is None else f"list_append({state}.t, {turn})"
    return f"case when {state} is not null then {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {turns}}} end"


def _least(*paths: str) -> str:
    return f"list_sort(list_filter([{', '.join(paths)}], lambda x: x is not null))[1]"


def _kept(letter: str, state: str) -> str:
    return f"case when fault not in (1, 2) and left(role, 1) = '{letter}' then {_move(state, KEEP, '(fault = 3)::bigint', "role || ':' || text")} end"


def _rerole(role: str, state: str) -> str:
    return f"case when fault not in (1, 2) then {_move(state, REROLE, '2 + (fault = 3)::bigint', f"'{role}:' || text")} end"


_STATES = {
    "n0": _least(_move("b0", DELETE, "3", None)),
    "n1": _least(_move("b1", DELETE, "3", None), _kept("s", "b0")),
    "n2": _least(_move("b2", DELETE, "3", None), *[f for b in ("b0", "b1", "b3") for f in (_kept("u", b), _rerole("user", b))]),
    "n3": _least(_move("b3", DELETE, "3", None), _kept("a", "b2"), _rerole("assistant", "b2")),
}
_INSERTED_U = _least("n2", *[_move(n, INSERT, "2", "'user:'") for n in ("n0", "n1", "n3")])
_INSERTED_A = _least("n3", _move("i2", INSERT, "2", "'assistant:'"))

ORACLE = f"""
with recursive shown as (
  select conv_id, turn, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k, coalesce(role, ' ') as role, coalesce(text, ' ') as text from conversations),
kinds as (
  select *, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(k, ''), lambda c: ascii(c)::ubigint)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda x, i: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint) % 20 as kind from shown),
rows_after as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case when kind = 3 then 2 else 1 end)) as copy from kinds where kind <> 0),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from rows_after),
faulty as (
  select *, case when bare = '' then 1 when seen > 1 then 2 when right(bare, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
    left(lag(role) over (partition by conv_id order by i), 1) || left(role, 1) as pair from numbered),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
    count(*) filter (fault = 3) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, max(i) as n from faulty group by conv_id),
search as (
  select conv_id, 0::bigint as i, {{'c': 0::bigint, 'a': '', 't': []::varchar[]}} as b0, null::struct(c bigint, a varchar, t varchar[]) as b1,
    {{'c': 2::bigint, 'a': 'I', 't': ['user:']}} as b2, {{'c': 4::bigint, 'a': 'II', 't': ['user:', 'assistant:']}} as b3 from counts
  union all
  select conv_id, i, n0, n1, i2, {_INSERTED_A} from (
    select *, {_INSERTED_U} as i2 from (
      select s.conv_id, f.i, {', '.join(f'{v} as {k}' for k, v in _STATES.items())} from search s join faulty f on s.conv_id is not distinct from f.conv_id and f.i = s.i + 1))),
best as (
  select s.conv_id, {_least('b0', 'b3')} as b from search s join counts c on s.conv_id is not distinct from c.conv_id and s.i = c.n)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') as audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on o.conv_id is not distinct from c.conv_id left join best on o.conv_id is not distinct from best.conv_id
"""
