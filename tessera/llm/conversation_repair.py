"""Operator 11: conversation repair as a shortest path, found by an auction.

A conversation is a lattice: its nodes are (rows read so far, state of the role
pattern), its arcs are the edits Keep, Rerole, Delete and Insert with their integer costs.
The auction algorithm holds a path from the origin and a price per node, never more
than any arc's cost plus the price behind it. The path's last node is extended along an
arc that meets its price exactly, or, if none does, its price is raised to the
least of them and the path contracts. When the path reaches the sink, the
prices are an optimal dual: exactly the arcs of cheapest paths (and some that
lead nowhere) are tight. The tight arcs from which the sink can be reached are
traced, the ASCII-least edit first.

Conversations of any length: rows are ranked by ranges, not by a window,
and cut into blocks of BLOCK rows, of which only one letter per row goes into the lattice.
Blocks are tasks of their own: an auction per exit state gives the costs
between a block's ends; prices run over those from the last block to the first; with the
prices at its end each block is traced for every state it may be
entered in. A last stream over the rows of a conversation picks the traces that fit
together, and holds one row. It is in order, as the digest of a whole conversation is.

Defined cases: null conv_id, turn, role and text are read as one space where
they are text; null turns come first and count for no gap; rows with one turn are ordered by role and
text hash; roles other than user, assistant and system are judged by their initial;
a conversation without rows gives zeros and the empty string's
digest; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import order_key, ranked
from .util import materialize, slices, tidy

BLOCK = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5      # costs
WHITE = " \t\n\x0b\x0c\r"
ROLES = "suax"                     # system, user, assistant, any other initial
FAULTS = ("fine", "truncated", "blank", "duplicate")
# The pattern (s?(ua)+)? as states: 0 nothing yet, 1 after s, 2 after u, 3 after ua.
WANTED = (2, 2, 3, 2)              # the state after the role that each state lets in by Rerole or Insert
ENDS = (0, -1, -1, 0)              # prices at a conversation's end; -1: no way on
NAMES = {2: "user", 3: "assistant"}


# ---- the lattice and the auction ------------------------------------------------

def _code(letter: int) -> tuple[int, int]:
    """(role, fault) of a row's letter."""
    return divmod(letter - 97, 4)


def keeps_to(state: int, role: int) -> int:
    """The state after keeping a row of that role, -1 where the pattern has no place for it."""
    if role == 0:
        return 1 if state == 0 else -1
    return role + 1 if role < 3 and WANTED[state] == role + 1 else -1


def lattice(codes: bytes, exits: tuple[int, ...], last: bool) -> list[list[tuple[str, int, int]]]:
    """Arcs (edit, cost, node) of every node 4 * rows + state, in the edits' ASCII order; the sink is the last node.
    Nodes from which the sink can't be reached have none."""
    rows, sink = len(codes), 4 * len(codes) + 4
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(sink + 1)]
    alive = [False] * sink + [True]
    for i in range(rows, -1, -1):
        arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(4)]
        for q in range(4):
            if i == rows:
                if exits[q] >= 0:
                    arcs[q].append(("", exits[q], sink))
            else:
                role, fault = _code(codes[i])
                more = TRUNCATED if fault == 1 else 0
                arcs[q].append(("D", DELETE, 4 * i + 4 + q))
                if fault < 2:
                    to = keeps_to(q, role)
                    if to >= 0:
                        arcs[q].append(("K", KEEP + more, 4 * i + 4 + to))
                    arcs[q].append(("R", REROLE + more, 4 * i + 4 + WANTED[q]))
            if i < rows or last:                        # else the next block inserts here
                arcs[q].append(("I", INSERT, 4 * i + WANTED[q]))
        for _ in range(4):
            for q in range(4):
                alive[4 * i + q] = alive[4 * i + q] or any(alive[to] for _, _, to in arcs[q])
        for q in range(4):
            if alive[4 * i + q]:
                out[4 * i + q] = sorted(a for a in arcs[q] if alive[a[2]])
    return out


def first_prices(codes: bytes, nodes: int) -> list[int]:
    """Prices that no arc undercuts: what the rows left cost at least, whatever the state."""
    price, rest = [0] * nodes, 0
    for i in range(len(codes) - 1, -1, -1):
        role, fault = _code(codes[i])
        rest += DELETE if fault else REROLE if role == 3 else KEEP
        price[4 * i:4 * i + 4] = [rest] * 4
    return price


def auction(out: list, price: list[int], origin: int) -> int | None:
    """Length of the shortest path from ``origin`` to the sink (None: there is none). ``price`` is raised in
    place to an optimal dual; prices left by another origin are a valid start."""
    sink = len(out) - 1
    if not out[origin]:
        return None
    path, on = [origin], origin
    while on != sink:
        least, best = None, -1
        for _, cost, to in out[on]:
            reach = cost + price[to]
            if least is None or reach < least:
                least, best = reach, to
        if price[on] < least:
            price[on] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(best)
        on = path[-1]
    return price[origin]


def trace(out: list, price: list[int], origin: int) -> tuple[str, int]:
    """(edits, state at the block's end) of the ASCII-least path over tight arcs."""
    sink = len(out) - 1
    tight = [[(edit, to) for edit, cost, to in arcs if price[node] == cost + price[to]] for node, arcs in enumerate(out)]
    leads = [False] * sink + [True]
    for level in range(sink - 4, -1, -4):
        for _ in range(4):                              # inserts stay on the level
            for node in range(level, level + 4):
                leads[node] = leads[node] or any(leads[to] for _, to in tight[node])
    node, edits = origin, []
    while True:
        edit, to = min(a for a in tight[node] if leads[a[1]])
        if to == sink:
            return "".join(edits), node % 4
        edits.append(edit)
        node = to


@lru_cache(maxsize=1 << 14)
def crossing(codes: bytes, last: bool) -> tuple[int, ...]:
    """Costs between a block's ends, 4 * entry + exit (of the last block: to the conversation's end, 4 entries); -1 for no way."""
    targets = [ENDS] if last else [tuple(0 if e == q else -1 for e in range(4)) for q in range(4)]
    table = []
    for exits in targets:
        out = lattice(codes, exits, last)
        price = first_prices(codes, len(out))
        table.append([-1 if (x := auction(out, price, q)) is None else x for q in range(4)])
    return tuple(x for entry in zip(*table) for x in entry)


@lru_cache(maxsize=1 << 14)
def traces(codes: bytes, exits: tuple[int, ...], last: bool, entries: tuple[int, ...]) -> tuple[tuple[str, int], ...]:
    """(edits, exit state) for each entry state; exit -1 where there is no way."""
    out = lattice(codes, exits, last)
    price = first_prices(codes, len(out))
    return tuple(("", -1) if auction(out, price, q) is None else trace(out, price, q) for q in entries)


def price_at_start(costs: list[int], after: tuple[int, ...]) -> tuple[int, ...]:
    """Prices at a block's start from those at its end."""
    prices = []
    for q in range(4):
        ways = [costs[4 * q + e] + after[e] for e in range(4) if costs[4 * q + e] >= 0 and after[e] >= 0]
        prices.append(min(ways) if ways else -1)
    return tuple(prices)


def _leveled(prices: tuple[int, ...]) -> tuple[int, ...]:
    """Only differences matter for a trace; small prices keep the auction short."""
    low = min(p for p in prices if p >= 0)
    return tuple(p - low if p >= 0 else -1 for p in prices)


# ---- rows and blocks ------------------------------------------------------------

def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Spoils rows by crc32 of ``conv:turn`` mod 20: 0 drops, 1 empties, 2 takes the ends of
    sentences, 3 repeats, 4 makes it the user's. Returns the four columns, role and text without nulls."""
    space = F.lit(" ")
    c, t, r, x = (F.col(f"`{name}`") for name in (conv, turn, role, text))
    hit = F.crc32(F.concat(F.coalesce(c.cast("string"), space), F.lit(":"), F.coalesce(t.cast("string"), space))) % 20
    r, x = F.coalesce(r.cast("string"), space), F.coalesce(x.cast("string"), space)
    spoiled = rows.select(
        c.alias(conv), t.alias(turn), F.when(hit == 4, "user").otherwise(r).alias(role),
        F.when(hit == 1, "").when(hit == 2, F.translate(x, ".!?", "")).otherwise(x).alias(text),
        hit.alias("_hit"))
    return spoiled.filter("_hit <> 0").withColumn("_copy", F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))) \
                  .select(conv, turn, role, text)


ORDER = ["_turn", "_role", "_t1", "_t2"]


def _narrow(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    space = F.lit(" ")
    out = rows.select(F.col(f"`{conv}`").alias("_conv"), order_key(f"`{conv}`").alias("_g"), F.col(f"`{turn}`").cast("long").alias("_turn"),
                      F.coalesce(F.col(f"`{role}`").cast("string"), space).alias("_role"), F.coalesce(F.col(f"`{text}`").cast("string"), space).alias("_text"))
    return out.select("*", *[F.xxhash64(F.lit(s), "_text").alias(n) for s, n in (("a", "_t1"), ("b", "_t2"))])


def _letter() -> Column:
    """One letter per row: its role's initial and whether it is fine, truncated or blank."""
    bare = F.btrim(F.col("_text"), F.lit(WHITE))
    fault = F.when(bare == "", 2).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    initial = F.substring("_role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (4 * role + fault).cast("int")


def blocks_of(rows: DataFrame) -> DataFrame:
    """(_g, _block, _blocks, order columns of its first row, _codes) of narrow rows."""
    at = ranked(rows.select("_g", *ORDER, _letter().alias("_letter")), "_g", ORDER)
    # the first of equal rows is found by an aggregate; (conversation, rank) is unique, so no join is skewed
    first = at.groupBy("_g", "_role", "_t1", "_t2").agg(F.min("_rank").alias("_rank")).select("_g", "_rank", F.lit(True).alias("_first"))
    judged = at.join(first, ["_g", "_rank"], "left")
    repeat = F.col("_first").isNull() & (F.col("_letter") % 4 != 2)
    letter = F.when(repeat, F.floor(F.col("_letter") / 4) * 4 + 3).otherwise(F.col("_letter"))
    parts = judged.groupBy("_g", F.floor(F.col("_rank") / BLOCK).cast("long").alias("_block"),
                           F.ceil(F.col("_n") / BLOCK).cast("long").alias("_blocks")) \
        .agg(F.min(F.struct("_rank", *ORDER)).alias("_start"), F.sort_array(F.collect_list(F.struct("_rank", F.char(letter + 97).alias("c")))).alias("_cs"))
    return parts.select("_g", "_block", "_blocks", *[F.col(f"_start.{c}").alias(c) for c in ORDER], F.array_join(F.col("_cs.c"), "").alias("_codes"))


def _with_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [list(crossing(c.encode(), b + 1 == n)) for c, b, n in zip(*(batch.column(k).to_pylist() for k in ("_codes", "_block", "_blocks")))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.list_(pa.int64()))], [*batch.schema.names, "_costs"])


def _with_exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from the last to the first: the prices at the end of each."""
    of, price = None, ENDS
    for batch in batches:
        exits = []
        for g, costs in zip(batch.column("_g").to_pylist(), batch.column("_costs").to_pylist()):
            if g != of:
                of, price = g, ENDS
                exits.append(list(price))
                price = tuple(costs)
            else:
                exits.append(list(price))
                price = price_at_start(costs, price)
        kept = [c for c in batch.schema.names if c != "_costs"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(exits, pa.list_(pa.int64()))], [*kept, "_exits"])


def _with_traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        edits, ends = [], []
        for codes, block, blocks, exits in zip(*(batch.column(k).to_pylist() for k in ("_codes", "_block", "_blocks", "_exits"))):
            found = traces(codes.encode(), _leveled(tuple(exits)), block + 1 == blocks, (0, 1, 2, 3) if block else (0,))
            edits.append([e for e, _ in found])
            ends.append([q for _, q in found])
        kept = [c for c in batch.schema.names if c != "_exits"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(edits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int64()))],
                                         [*kept, "_edits", "_ends"])


def traced(blocks: DataFrame) -> DataFrame:
    """Blocks with the edits and the exit state for each state they may be entered in."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema)
    alone = blocks.filter("_blocks = 1").withColumn("_exits", F.array(*[F.lit(e).cast("long") for e in ENDS]))
    long = blocks.filter("_blocks > 1").mapInArrow(tidy(_with_costs), f"{kind}, _costs array<long>")
    long = long.repartition("_g").sortWithinPartitions("_g", F.col("_block").desc()).mapInArrow(_with_exits, f"{kind}, _exits array<long>")
    return alone.unionByName(long).mapInArrow(tidy(_with_traces), f"{kind}, _edits array<string>, _ends array<long>")


# ---- the stream over whole conversations --------------------------------------------

class _Conversation:
    """Rows and traces of one conversation as they come by, in order."""

    def __init__(self, g, conv):
        self.g, self.conv = g, conv
        self.entry, self.state = 0, 0              # of the next block; of the repaired rows so far
        self.waiting, self.at = "", 0              # edits whose rows have not come yet
        self.audit, self.cost = [], 0
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.low = self.high = self.turn = None
        self.turns = 0

    def block(self, codes: str, edits: list[str], ends: list[int]) -> None:
        """A block's trace, chosen by the state the block before ended in."""
        way = edits[self.entry]
        self.entry = ends[self.entry]
        self.waiting, self.at = self.waiting[self.at:] + way, 0
        self.audit.append(way)
        letters = iter(codes)
        for edit in way:
            if edit == "I":
                self.cost += INSERT
                continue
            role, fault = _code(ord(next(letters)))
            self.faults[fault] += 1
            self.illegal += self.before is not None and ROLES[self.before] + ROLES[role] not in ("su", "ua", "au")
            self.before = role
            self.cost += DELETE if edit == "D" else (REROLE if edit == "R" else KEEP) + (TRUNCATED if fault == 1 else 0)

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.waiting) and self.waiting[self.at] == "I":
            self.at += 1
            self.state = WANTED[self.state]
            yield "I", NAMES[self.state], ""

    def row(self, turn, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the repaired rows up to this one."""
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.turn = self.high = turn
            self.low = turn if self.low is None else self.low
        yield from self._inserted()
        edit = self.waiting[self.at]
        self.at += 1
        if edit == "R":
            self.state = WANTED[self.state]
            yield edit, NAMES[self.state], text
        elif edit == "K":
            self.state = keeps_to(self.state, ROLES.find(role[:1]))
            yield edit, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, tuple | None]]:
    """(conversation, repaired row), and (conversation, None) at its end."""
    now = None
    for batch in batches:
        for part in slices(batch, "_text"):
            cols = [part.column(c).to_pylist() for c in ("_g", "_kind", "_conv", "_turn", "_role", "_text", "_codes", "_edits", "_ends")]
            for g, kind, conv, turn, role, text, codes, edits, ends in zip(*cols):
                if now is None or now.g != g:
                    if now is not None:
                        yield from ((now, r) for r in now.end())
                        yield now, None
                    now = _Conversation(g, conv)
                if kind == 1:
                    now.block(codes, edits, ends)
                elif kind == 2:
                    yield from ((now, r) for r in now.row(turn, role, text))
    if now is not None:
        yield from ((now, r) for r in now.end())
        yield now, None


def _records(rows: DataFrame, ids: DataFrame | None, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Marks (0), traces (1) and rows (2) of all conversations, each conversation in one partition and in order."""
    narrow = _narrow(rows, conv, turn, role, text)
    steps = materialize(traced(materialize(blocks_of(narrow))))
    ids = rows if ids is None else ids
    marks = ids.select(F.col(f"`{conv}`").alias("_conv"), order_key(f"`{conv}`").alias("_g")).distinct().withColumn("_kind", F.lit(0))
    every = marks.unionByName(steps.select("_g", *ORDER, "_block", "_codes", "_edits", "_ends").withColumn("_kind", F.lit(1)), allowMissingColumns=True) \
                 .unionByName(narrow.withColumn("_kind", F.lit(2)).drop("_conv"), allowMissingColumns=True)
    keys = [F.col(c).asc_nulls_first() for c in ("_g", *ORDER, "_kind", "_block")]
    return every.repartition("_g").sortWithinPartitions(*keys) \
                .select("_g", "_kind", "_conv", "_turn", "_role", "_text", "_codes", "_edits", "_ends")


def repaired_turns(rows: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn",
                   role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, edit, role, text): the repaired conversations, places 0, 1, .."""
    kind = rows.schema[conv].dataType.simpleString()

    def run(batches):
        place, out, size = 0, [], 0
        for now, row in _walk(batches):
            if row is None:
                place = 0
                continue
            out.append((now.conv, place, *row))
            place, size = place + 1, size + len(row[2])
            if len(out) >= 5000 or size > 4 << 20:
                yield _batch(out, schema)
                out, size = [], 0
        yield _batch(out, schema)

    schema = [(conv, kind), ("place", "long"), ("edit", "string"), (role, "string"), (text, "string")]
    return _records(rows, ids, conv, turn, role, text).mapInArrow(tidy(run), ", ".join(f"`{n}` {k}" for n, k in schema))


def repair(rows: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of ``ids`` (default: of ``rows``): ``conv``, gaps, blank, duplicate, truncated, illegal, cost,
    audit (its edits' initials) and repaired_sha256 (of the repaired ``role:text`` lines)."""
    kind = rows.schema[conv].dataType.simpleString()

    def run(batches):
        digest, started, out = hashlib.sha256(), False, []
        for now, row in _walk(batches):
            if row is not None:
                digest.update(f"{chr(10) if started else ''}{row[1]}:{row[2]}".encode())
                started = True
                continue
            _, cut, blank, twice = now.faults
            out.append((now.conv, now.gaps, blank, twice, cut, now.illegal, now.cost, "".join(now.audit), digest.hexdigest()))
            digest, started = hashlib.sha256(), False
            if len(out) >= 5000:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    schema = [(conv, kind), *[(n, "long") for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
              ("audit", "string"), ("repaired_sha256", "string")]
    return _records(rows, ids, conv, turn, role, text).mapInArrow(tidy(run), ", ".join(f"`{n}` {k}" for n, k in schema))


def _batch(rows: list[tuple], schema: list[tuple[str, str]]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k)) for c, (_, k) in zip(columns, schema)], [n for n, _ in schema])
