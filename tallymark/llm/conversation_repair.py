"""Conversations repaired at the least cost, read row by row with bounded memory.

Rows of a conversation are kept, given another role, deleted, or others put
between them, until the roles are `(s?(ua)+)?` by their initials. A Viterbi
search over the four states of that pattern keeps one survivor each: the
cheapest edits that lead there, of equal ones the least in ASCII. Survivors are
leaves of one tree of back pointers with reference counts. What no survivor
reaches any more is freed, and the edits that all survivors share are given out
at once, so that memory holds only what is still undecided. A survivor that
another one beats by more than it can ever make good is dropped; without that
the survivor of the empty conversation would hold everything back.

Whatever the input: a null role or text counts as one space; a null turn comes
before all others; rows with the same turn are ordered by role and text, and
repeated rows are duplicates; a null conv_id is a conversation of its own; a
role with another initial can only be changed or deleted; other columns are not
read; no rows give no rows. A conversation is read by one task, in order, since
the digest is one over its whole text: that task streams and never holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States by the last initial of what has been kept; EMPTY and A are ends.
EMPTY, S, U, A = range(4)
KEEP = {(EMPTY, "s"): S, (EMPTY, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
#: The state after a user's or assistant's row is put in, and that row's role.
NEXT = {EMPTY: (U, "user"), S: (U, "user"), A: (U, "user"), U: (A, "assistant")}
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: AHEAD[p][q]: what is left to pay from p is at most that from q and this. From A the rest of any path goes on,
#: save that a system row must be deleted; from U an inserted answer leads to A; from S a question and an answer.
AHEAD = (
    (0, 0, 3, 0),
    (6, 0, 3, 6),
    (7, 3, 0, 3),
    (4, 0, 3, 0),
)
FAULTS = ("blank", "duplicate", "truncated")
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}

EDITS = ("conv_id bigint, step bigint, edit string, turn bigint, was string, fault int, role string, text string")
DIGEST = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
          "cost bigint, audit string, repaired_sha256 string")
#: Rows and characters of a batch that a task gives out.
BATCH_ROWS, BATCH_CHARS = 10_000, 4 << 20


class Node:
    """An edit; `refs` counts the edits that follow it and the survivors that end here."""

    __slots__ = ("letter", "row", "role", "parent", "refs", "after")

    def __init__(self, letter: str, row: tuple | None, role: str | None, parent: Node | None):
        self.letter, self.row, self.role, self.parent = letter, row, role, parent
        self.refs, self.after = 0, set()
        if parent is not None:
            parent.refs += 1
            parent.after.add(self)


class Repair:
    """The edits of one conversation, given out as soon as they are certain.

    `step` takes a row and its fault (0: none, else 1 + its place in FAULTS) and
    returns nodes that are decided; `finish` returns the rest.
    """

    def __init__(self) -> None:
        self.root = Node("", None, None, None)
        self.heads: list[Node | None] = [self.root, None, None, None]
        self.costs = [0, 0, 0, 0]
        self.root.refs = 1
        self.paid = 0
        self._insert()

    def _edits(self, node: Node) -> str:
        """The undecided edits up to a node, complete."""
        out = []
        while node is not self.root:
            out.append(node.letter)
            node = node.parent
        return "".join(reversed(out))

    def _first(self, a: tuple[int, Node, str], b: tuple[int, Node, str]) -> bool:
        """Whether a = (cost, parent, letter) comes before b."""
        if a[0] != b[0]:
            return a[0] < b[0]
        return self._edits(a[1]) + a[2] < self._edits(b[1]) + b[2]

    def step(self, row: tuple, initial: str, fault: int) -> list[Node]:
        best: list[tuple | None] = [None] * 4

        def offer(state: int, cost: int, parent: Node, letter: str, role: str | None) -> None:
            new = (cost, parent, letter, role)
            if best[state] is None or self._first(new, best[state]):
                best[state] = new

        extra = TRUNCATED_COST if fault == 3 else 0
        for state, (cost, head) in enumerate(zip(self.costs, self.heads, strict=True)):
            if head is None:
                continue
            offer(state, cost + DELETE_COST, head, "D", None)
            if fault not in (1, 2):
                if (kept := KEEP.get((state, initial))) is not None:
                    offer(kept, cost + extra, head, "K", None)
                after, role = NEXT[state]
                offer(after, cost + REROLE_COST + extra, head, "R", role)
        old = self.heads
        self.heads = [None] * 4
        for state, new in enumerate(best):
            if new is not None:
                self._put(state, new[0], Node(new[2], row, new[3], new[1]))
        for head in old:
            if head is not None:
                self._release(head)
        self._insert()
        self._drop_beaten()
        return self._decided()

    def _put(self, state: int, cost: int, node: Node) -> None:
        node.refs += 1
        before, self.heads[state], self.costs[state] = self.heads[state], node, cost
        if before is not None:
            self._release(before)

    def _insert(self) -> None:
        """Rows put in behind the last one; a question first, since an answer may follow it."""
        for froms, to in (((EMPTY, S, A), U), ((U,), A)):
            for state in froms:
                if self.heads[state] is None:
                    continue
                new = (self.costs[state] + INSERT_COST, self.heads[state], "I")
                if self.heads[to] is None or self._first(new, (self.costs[to], self.heads[to], "")):
                    self._put(to, new[0], Node("I", None, NEXT[state][1], self.heads[state]))

    def _drop_beaten(self) -> None:
        for q in range(4):
            if any(self.heads[p] is not None and self.costs[p] + AHEAD[p][q] < self.costs[q] for p in range(4)) and self.heads[q] is not None:
                head, self.heads[q] = self.heads[q], None
                self._release(head)

    def _release(self, node: Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            parent = node.parent
            parent.after.discard(node)
            parent.refs -= 1
            node = parent

    def _decided(self) -> list[Node]:
        out = []
        while self.root.refs == 1 and self.root.after:
            (node,) = self.root.after
            node.parent = None
            self.root = node
            out.append(node)
        if out:
            least = min(c for c, h in zip(self.costs, self.heads, strict=True) if h is not None)
            self.costs = [c - least for c in self.costs]
            self.paid += least
        return out

    def finish(self) -> list[Node]:
        """The rest of the cheapest edits; `paid` is then what all of them cost."""
        ends = [q for q in (EMPTY, A) if self.heads[q] is not None]
        last = ends[0]
        if len(ends) == 2 and self._first((self.costs[A], self.heads[A], ""), (self.costs[EMPTY], self.heads[EMPTY], "")):
            last = A
        self.paid += self.costs[last]
        out, node = [], self.heads[last]
        while node is not self.root:
            out.append(node)
            node = node.parent
        return out[::-1]

    def held(self) -> int:
        """Edits in memory."""
        todo, n = [self.root], 0
        while todo:
            node = todo.pop()
            todo += node.after
            n += 1
        return n


def faulty(rows: DataFrame) -> DataFrame:
    """Rows by conversation and in order, with their first fault: 1 blank, 2 duplicate, 3 truncated, else 0.

    `rows` has conv_id, turn, role, text and maybe `gone`; a row that is gone only
    names its conversation. One shuffle by conv_id serves both sorts.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    space = F.lit(" ")
    rows = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(~gone, F.coalesce(F.col("role").cast("string"), space)).alias("role"),
        F.when(~gone, F.coalesce(F.col("text").cast("string"), space)).alias("text"), gone.alias("gone"),
    ).repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(F.col("gone"), 0).when(rest == "", 1).when(F.row_number().over(same) > 1, 2)
        .when(~F.right(rest, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    )
    # Of equal rows of a turn the one that is no duplicate comes first.
    return rows.withColumn("fault", fault.cast("int")).sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", F.col("fault") == 2)


def edits(rows: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation, one row each, in order within a partition.

    `edit` is K(eep), R(erole), D(elete) or I(nsert), and null for a row that is gone;
    `was` is the role before; role and text are null where nothing is left.
    A row with step -1 ends each conversation and has the cost as its turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        conv_id, repair, step = None, None, 0

        def give(nodes: list[Node]) -> None:
            nonlocal step, chars
            for node in nodes:
                turn, was, text, fault = node.row or (None, None, "", 0)
                role = None if node.letter == "D" else node.role or was
                out.append((conv_id, step, node.letter, turn, was, fault, role, None if role is None else text))
                step, chars = step + 1, chars + len(text)

        def end() -> None:
            give(repair.finish())
            out.append((conv_id, -1, None, repair.paid, None, None, None, None))

        def ready() -> pa.RecordBatch:
            nonlocal chars
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                [c.split()[0] for c in EDITS.split(", ")])
            out.clear()
            chars = 0
            return batch

        for batch in batches:
            for k, turn, role, text, gone, fault in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if repair is None or k != conv_id:
                    if repair is not None:
                        end()
                    conv_id, repair, step = k, Repair(), 0
                if not gone:
                    give(repair.step((turn, role, text, fault), role[:1], fault))
                if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield ready()
        if repair is not None:
            end()
        if out:
            yield ready()

    return faulty(rows).mapInArrow(run, EDITS)


def digests(edited: DataFrame) -> DataFrame:
    """One row per conversation of `edits`, which must come straight from there: it is read in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        state = _Digest()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if row[1] >= 0:
                    state.add(*row[2:])
                else:
                    out.append((row[0], *state.close(row[3])))
                    state = _Digest()
                if len(out) >= BATCH_ROWS:
                    yield _digest_batch(out)
                    out = []
        if out:
            yield _digest_batch(out)

    return edited.mapInArrow(run, DIGEST)


def _digest_batch(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                      [c.split()[0] for c in DIGEST.split(", ")])


class _Digest:
    """Counts of one conversation and the hash of its repaired text."""

    def __init__(self) -> None:
        self.turns, self.first, self.last = 0, None, None
        self.faults, self.illegal, self.before = [0] * 4, 0, None
        self.audit, self.hash, self.some = [], hashlib.sha256(), False

    def add(self, edit: str, turn: int | None, was: str | None, fault: int, role: str | None, text: str | None) -> None:
        self.audit.append(edit)
        if was is not None:
            if turn is not None:
                self.first = turn if self.first is None else self.first
                self.turns += turn != self.last
                self.last = turn
            self.faults[fault] += 1
            self.illegal += self.before is not None and self.before + was[:1] not in LEGAL
            self.before = was[:1]
        if role is not None:
            self.hash.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
            self.some = True

    def close(self, cost: int) -> tuple:
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.turns
        return (gaps, *self.faults[1:], self.illegal, cost, "".join(self.audit), self.hash.hexdigest())


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with a fault put into four of twenty, by the crc32 of `conv_id:turn`; a fifth kind is `gone`."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text["role"].alias("role"), text["text"].alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """`conversations` damaged, then repaired: faults, cheapest edits and the hash of what comes out."""
    return digests(edits(damaged(conversations)))


def oracle() -> str:
    """The same in SQL: a step of the search per row, all conversations at once, edits and text carried along."""

    def best(*ways: str) -> str:
        return f"list_sort([{', '.join(ways)}])[1]"

    def way(state: int, cost: str, letter: str, text: str = "''") -> str:
        return f"{{'c': p[{state + 1}].c + {cost}, 'a': p[{state + 1}].a || '{letter}', 't': p[{state + 1}].t || {text}}}"

    line = "chr(10) || {role} || ':' || text"
    never = "{'c': 1000000000, 'a': '', 't': ''}"
    extra = "CASE WHEN fault = 3 THEN 3 ELSE 0 END"
    must = "CASE WHEN fault IN (1, 2) THEN 1000000000 ELSE 0 END"

    def after(state: int) -> str:
        ways = [way(state, "4", "D")]
        for (before, initial), to in KEEP.items():
            if to == state:
                barred = f"CASE WHEN initial = '{initial}' THEN 0 ELSE 1000000000 END"
                ways.append(way(before, f"{extra} + {must} + {barred}", "K", line.format(role="role")))
        for before, (to, role) in NEXT.items():
            if to == state:
                ways.append(way(before, f"3 + {extra} + {must}", "R", line.format(role=f"'{role}'")))
        return best(*ways)

    def put(state: int, role: str) -> str:
        return f"{{'c': p[{state + 1}].c + 3, 'a': p[{state + 1}].a || 'I', 't': p[{state + 1}].t || chr(10) || '{role}:'}}"

    question = f"[p[1], p[2], {best('p[3]', put(EMPTY, 'user'), put(S, 'user'), put(A, 'user'))}, p[4]]"
    answer = f"[p[1], p[2], p[3], {best('p[4]', put(U, 'assistant'))}]"
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    # crc32 is not a function there: a table of 256 remainders from the polynomial, then a byte at a time.
    return f"""
WITH RECURSIVE bits AS (
  SELECT i, i::UBIGINT AS r, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END, k + 1 FROM bits WHERE k < 8),
remainders AS (SELECT list(r ORDER BY i) AS rs FROM bits WHERE k = 8),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::UBIGINT)),
    lambda c, b: xor(c >> 8, rs[(xor(c, b) % 256 + 1)::BIGINT])), 4294967295::UBIGINT) % 20 AS kind FROM named, remainders),
rows_after AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM coded WHERE kind <> 0),
judged AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, {blanks}) AS rest,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
  FROM rows_after),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS pos FROM judged),
ordered AS (
  SELECT *, CASE WHEN rest = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(rest, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM placed),
every AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, 0::BIGINT AS pos, [{{'c': 0::BIGINT, 'a': '', 't': ''}}, {never}, {{'c': 3::BIGINT, 'a': 'I', 't': chr(10) || 'user:'}},
    {{'c': 6::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}] AS p FROM every
  UNION ALL
  SELECT conv_id, pos, {answer} FROM (
    SELECT conv_id, pos, {question} AS p FROM (
      SELECT w.conv_id, o.pos, [{after(EMPTY)}, {after(S)}, {after(U)}, {after(A)}] AS p
      FROM walk w JOIN ordered o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.pos = w.pos + 1))),
ended AS (SELECT conv_id, {best('p[1]', 'p[4]')} AS e FROM walk
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM ordered GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.e.c AS cost, e.e.a AS audit, sha256(e.e.t[2:]) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""
