"""Operator 12: the cheapest repair of a conversation's structure, by a persistent audit DP.

A repaired conversation has role initials ``(s?(ua)+)?``. Its audit is the string of its edits: Keep, Rerole, Delete
and Insert. Rows are read once in order; for each of the four states of the pattern the cheapest audit so far is kept,
of equally cheap ones the least in ASCII. Audits are linked nodes that share their prefixes. Every node has its
ancestors at powers of two and a rolling hash of its whole prefix, so two audits are compared at the place behind their
longest common prefix, which is found by search; equal hashes are verified, as equal prefixes are one and the same
node. Audits of one cost and one state never are proper prefixes of each other (the longer one would have paid for
its inserts), so the least prefix also gives the least audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskboard.llm.native import strip

REROLE, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: A row that is kept: (state, role initial) -> state.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: A row that is given a role, or inserted, has the only role that may follow.
GIVEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Nodes after which the prefix that all audits share is taken off.
NODES = 1 << 14
_BASE, _MODULUS = 1_000_003, (1 << 61) - 1

AUDITED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "conv_id long, position long, edit string, role string, text string"


class Prefixes:
    """Strings that share their prefixes. A string is the number of its last node; 0 is the empty one."""

    def __init__(self) -> None:
        self.symbol, self.depth, self.hash, self.up = [""], [0], [0], [[0]]
        self.children: dict[tuple[int, str], int] = {}

    def __len__(self) -> int:
        return len(self.symbol)

    def extend(self, node: int, symbol: str) -> int:
        known = self.children.get((node, symbol))
        if known is not None:
            return known
        new = self.children[node, symbol] = len(self.symbol)
        self.symbol.append(symbol)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(symbol)) % _MODULUS)
        up = [node]
        while up[-1]:
            above = self.up[up[-1]]
            if len(above) < len(up):
                break
            up.append(above[len(up) - 1])
        self.up.append(up)
        return new

    def same(self, a: int, b: int) -> bool:
        return self.hash[a] == self.hash[b] and a == b  # equal strings are one node, so a collision of hashes shows

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            k = (self.depth[node] - depth).bit_length() - 1
            node = self.up[node][k]
        return node

    def fork(self, a: int, b: int) -> tuple[int, int]:
        """The ancestors of both behind their longest common prefix, at one depth; equal if one is a prefix of the other."""
        depth = min(self.depth[a], self.depth[b])
        a, b = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.same(a, b):
            return a, b
        for k in reversed(range(len(self.up[a]))):
            if k < len(self.up[a]) and not self.same(self.up[a][k], self.up[b][k]):
                a, b = self.up[a][k], self.up[b][k]
        return a, b

    def less(self, a: int, b: int) -> bool:
        x, y = self.fork(a, b)
        return self.depth[a] < self.depth[b] if x == y else self.symbol[x] < self.symbol[y]

    def shared(self, a: int, b: int) -> int:
        x, y = self.fork(a, b)
        return x if x == y else self.up[x][0]

    def text(self, node: int, above: int = 0) -> str:
        """The symbols from behind ``above`` to ``node``."""
        out = []
        while node != above:
            out.append(self.symbol[node])
            node = self.up[node][0]
        return "".join(reversed(out))


class Auditor:
    """The cheapest audits of a conversation, row by row. What it holds is the undecided ends of at most four audits
    and the text of the part that is decided."""

    def __init__(self, nodes: int = NODES) -> None:
        self.prefixes, self.limit, self.nodes = Prefixes(), nodes, nodes
        self.decided: list[str] = []
        self.best: dict[int, tuple[int, int]] = {START: (0, 0)}
        self._insert(self.best)

    def _offer(self, best: dict[int, tuple[int, int]], state: int, cost: int, node: int, symbol: str) -> bool:
        old = best.get(state)
        if old is not None and old[0] < cost:
            return False
        new = self.prefixes.extend(node, symbol)
        if old is not None and old[0] == cost and not self.prefixes.less(new, old[1]):
            return False
        best[state] = (cost, new)
        return True

    def _insert(self, best: dict[int, tuple[int, int]]) -> None:
        waiting = list(best)
        while waiting:
            state = waiting.pop()
            cost, node = best[state]
            if self._offer(best, GIVEN[state], cost + INSERT, node, "I"):
                waiting.append(GIVEN[state])

    def row(self, initial: str, must_go: bool, unfinished: bool) -> None:
        best: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in self.best.items():
            self._offer(best, state, cost + DELETE, node, "D")
            if not must_go:
                stays = cost + UNFINISHED * unfinished
                if (state, initial) in KEPT:
                    self._offer(best, KEPT[state, initial], stays, node, "K")
                self._offer(best, GIVEN[state], stays + REROLE, node, "R")
        self._insert(best)
        # After an assistant's turn all may follow but a system turn, which can be deleted instead: what costs more
        # than that in the other two states can never win.
        if ASSISTANT in best:
            for state, more in ((START, DELETE), (SYSTEM, 0)):
                if state in best and best[state][0] > best[ASSISTANT][0] + more:
                    del best[state]
        self.best = best
        if len(self.prefixes) > self.limit:
            self._settle()

    def _settle(self) -> None:
        ends = [node for _, node in self.best.values()]
        common = ends[0]
        for node in ends[1:]:
            common = self.prefixes.shared(common, node)
        self.decided.append(self.prefixes.text(common))
        old, self.prefixes = self.prefixes, Prefixes()
        for state, (cost, end) in self.best.items():
            node = 0
            for symbol in old.text(end, common):
                node = self.prefixes.extend(node, symbol)
            self.best[state] = (cost, node)
        self.limit = self.nodes + 2 * len(self.prefixes)

    def result(self) -> tuple[int, str]:
        ends = [self.best[s] for s in (START, ASSISTANT) if s in self.best]
        cost = min(c for c, _ in ends)
        node = None
        for c, end in ends:
            if c == cost and (node is None or self.prefixes.less(end, node)):
                node = end
        return cost, "".join(self.decided) + self.prefixes.text(node)


def damage(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with faults planted by the checksum of ``id:turn``: (conv_id, turn, role, text, dropped). A row that is
    dropped stays with its mark, so that its conversation stays known. Nulls in role, text and checksum are one space;
    equal rows are damaged alike. Other columns are left out; an empty table gives no rows."""
    shown = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(id_col), F.lit(":"), shown(turn_col)).cast("binary")) % 20
    text, role = shown(text_col), shown(role_col)
    rows = turns.select(
        F.col(f"`{id_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def _rows(turns: DataFrame, *more: str) -> DataFrame:
    """What the DP needs of a row. Two hashes stand for role and text where rows are compared and ordered."""
    bare = strip(F.col("text"))
    named = turns.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")),
        (F.coalesce("dropped", F.lit(False)) if "dropped" in turns.columns else F.lit(False)).alias("dropped"),
    )
    return named.select(
        "conv_id", "turn", "dropped", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("unfinished"),
        F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", "role", F.lit(1)).alias("h2"), *more,
    )


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = zip(zip(*rows, strict=True), fields, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in columns], names=[n for n, _ in fields])


def _read(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[object, Iterator[tuple]]]:
    """The conversations of sorted rows, one after another, each as a stream of its rows."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names), strict=True))
    return groupby(rows, key=lambda r: r[0])


def audit_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text, dropped if there is such a column): its gaps,
    blank, duplicate and unfinished rows, illegal neighbours, and its cheapest audit with the cost.

    Rows stand by turn, null first; rows of one turn in a fixed order of their hashes. A null role or text is one space.
    Rows with a null id are one conversation. Of rows marked dropped only the id counts; a conversation without others
    has zeros and an empty audit. Repeated rows are duplicates. Other columns are ignored; an empty table gives no rows.

    Rows reach a task sorted, without their texts, and are read as a stream: of a conversation a task holds two hashes
    of each distinct row, and the audit, which is one value of the result anyway.
    """
    names = ("conv_id", "turn", "dropped", "initial", "blank", "unfinished", "h1", "h2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, own in _read(batches, *names):
            auditor, seen, before, last = Auditor(), set(), None, None
            blanks = duplicates = unfinished_rows = illegal = distinct = first = 0
            for _, turn, dropped, initial, blank, unfinished, h1, h2 in own:
                if dropped:
                    continue
                if turn is not None and turn != last:
                    first, last, distinct = (turn if last is None else first), turn, distinct + 1
                again = (h1, h2) in seen
                seen.add((h1, h2))
                open_end = unfinished and not blank and not again
                blanks, duplicates, unfinished_rows = blanks + blank, duplicates + (again and not blank), unfinished_rows + open_end
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                auditor.row(initial, blank or again, open_end)
            cost, audit = auditor.result()
            gaps = 0 if last is None else last - first + 1 - distinct
            out.append((conv, gaps, blanks, duplicates, unfinished_rows, illegal, cost, audit))
            size += len(audit) + 100
            if size > 4 << 20:
                yield _record(out, AUDITED)
                out, size = [], 0
        if out:
            yield _record(out, AUDITED)

    light = _rows(turns).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "h1", "h2")
    return light.select(*names).mapInArrow(run, AUDITED)


def apply_audits(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, position, edit, role, text), the rows of one behind each other in a partition,
    in order. ``turns`` are the rows that ``audits`` were made of; inserted rows have an empty text.

    An audit goes ahead of its conversation in the sorted rows, so a task holds one audit and one batch of rows.
    """
    names = ("conv_id", "audit", "dropped", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def edited(own) -> Iterator[tuple[int, str, str, str]]:
            audit, at, position, state = "", 0, 0, START
            for _, given, dropped, role, text in own:
                if given is not None:
                    audit = given
                    continue
                if dropped:
                    continue
                while audit[at] == "I":
                    state = GIVEN[state]
                    yield position, "I", ROLE[state], ""
                    at, position = at + 1, position + 1
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = KEPT[state, role[:1]] if edit == "K" else GIVEN[state]
                    yield position, edit, role if edit == "K" else ROLE[state], text
                    position += 1
            for _ in audit[at:]:
                state = GIVEN[state]
                yield position, "I", ROLE[state], ""
                position += 1

        for conv, own in _read(batches, *names):
            for row in edited(own):
                out.append((conv, *row))
                size += len(row[3]) + 50
                if size > 4 << 20:
                    yield _record(out, REPAIRED)
                    out, size = [], 0
        if out:
            yield _record(out, REPAIRED)

    own = _rows(turns, "role", "text").select("conv_id", "turn", "dropped", "h1", "h2", "role", "text", F.lit(None).cast("string").alias("audit"))
    empty = {"turn": "bigint", "dropped": "boolean", "h1": "bigint", "h2": "bigint", "role": "string", "text": "string"}
    ahead = audits.select("conv_id", *(F.lit(None).cast(k).alias(c) for c, k in empty.items()), "audit")
    order = ("conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "h1", "h2")
    ordered = own.unionByName(ahead).repartition("conv_id").sortWithinPartitions(*order)
    return ordered.select(*names).mapInArrow(run, REPAIRED)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the rows as ``apply_audits`` leaves them: the digest of ``role:text``, joined by line
    feeds. It is a digest of the whole conversation, so its rows go through one task one after another; none is held.
    A conversation without rows has no digest."""
    schema = "conv_id long, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, own in _read(batches, "conv_id", "position", "role", "text"):
            digest = hashlib.sha256()
            for _, position, role, text in own:
                digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            out.append((conv, digest.hexdigest()))
            if len(out) == 10_000:
                yield _record(out, schema)
                out = []
        if out:
            yield _record(out, schema)

    return repaired.mapInArrow(run, schema)
