"""Structure repair of conversations: the cheapest edits after which the roles follow `(s?(ua)+)?`.

Wu-Manber-style cost layers. Layer d holds, for each place between turns, the bitset of grammar states from which the
rest of the conversation can be brought to an accepting end at cost exactly d; it follows by bit operations from the
layers d, d - 1, d - 2, ... that the edits' costs name (keep 0, new role 1, delete 2, insert 5, 5 more where a turn
that is cut short stays). Layers are made for rising d; the first whose bitset before the first turn holds the start
state gives the cost. The bit-trace walks from there and takes, at each place, the edit of the least letter
(D, I, K, R) whose layer still holds the state it leads to: the least audit of the cheapest ones.

A conversation of more than `SPAN` turns is layered in spans from its end, each span's end states starting at the
costs that the span after it gives, so the work is linear in its turns; the trace then goes span by span.

Jobs: roles and faults are columns; whether a turn was said before is an aggregation by (conversation, role, SHA-256 of
the text) and a join with what repeats. One shuffle of narrow rows (no texts) streams each conversation in order through
the layers, with a byte or two of memory a turn; a second one brings texts and edits together as sorted streams, holding
one batch. A conversation is never gathered: its audit, which is one string, is the only thing that grows with it.
What one conversation gives in one value (audit, digest of its texts) is made by one task, as those values are
sequential; its rows come to it sorted and spilled by Spark.

Statements. Turns come in ascending order, nulls first; equal turns by role, then by the SHA-256 of the text. A null
role or text is one space. An empty role has no letter, so it can't be kept. Identical rows are copies: the second is a
duplicate. A null conversation id is an id of its own. An empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

#: Costs of the edits, and of a turn that is cut short and stays.
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
SPAN = 64
#: States of the grammar: 0 nothing yet, 1 after s, 2 after u, 3 after a. Kept letters lead from state to state.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
FORCED = {0: 2, 1: 2, 2: 3, 3: 2}
ACCEPTING = (0, 3)
ROLE_INTO = {2: "user", 3: "assistant"}
LETTERS = "suax"
#: What a turn is like, next to its letter: whole, cut short, or to be deleted. Blank and repeated turns must go.
WHOLE, SHORT, GONE = 0, 1, 2


def _sources(steps: dict[int, int]) -> list[int]:
    """For each bitset of states, the bitset of those that a step leads into it from."""
    return [sum(1 << s for s, t in steps.items() if bits >> t & 1) for bits in range(16)]


KEEPS, FORCES = [_sources(STEPS[c]) for c in LETTERS], _sources(FORCED)


def _layers(symbols, ends: list[int], want: int, last: bool) -> list[list[int]]:
    """Layers over the places of symbols until the bitsets at place 0 have held all states of `want`.

    ends: the cost from which each state is at the last place. last: nothing follows, so inserts may stand there.
    """
    n, out, seen = len(symbols), [], 0
    none = [0] * (n + 1)
    while want & ~seen:
        d = len(out)
        back = lambda by: out[d - by] if d >= by else none  # noqa: E731, B023
        layer = [0] * (n + 1)
        inserted, forced, removed = back(INSERT), (back(REROLE), back(REROLE + CUT_SHORT)), back(DELETE)
        kept = (layer, back(CUT_SHORT))
        layer[n] = sum(1 << s for s in range(4) if ends[s] == d) | (FORCES[inserted[n]] if last else 0)
        for i in range(n - 1, -1, -1):
            letter, kind = divmod(symbols[i], 3)
            bits = removed[i + 1] | FORCES[inserted[i]]
            if kind != GONE:
                bits |= KEEPS[letter][kept[kind][i + 1]] | FORCES[forced[kind][i + 1]]
            layer[i] = bits
        out.append(layer)
        seen |= layer[0]
    return out


def _trace(symbols, layers, ends, state: int, last: bool) -> tuple[str, int]:
    """The least edits from the state before the first symbol, at the first layer that holds it, and the state after."""
    n, i, out = len(symbols), 0, []
    d = next(k for k, layer in enumerate(layers) if layer[0] >> state & 1)
    holds = lambda cost, at, s: cost >= 0 and layers[cost][at] >> s & 1
    while i < n or (last and not (d == 0 and state in ACCEPTING)):
        letter, kind = divmod(symbols[i], 3) if i < n else (0, GONE)
        extra = CUT_SHORT * (kind == SHORT)
        step = STEPS[LETTERS[letter]].get(state)
        if i < n and holds(d - DELETE, i + 1, state):
            out.append("D")
            d, i = d - DELETE, i + 1
        elif (i < n or last) and holds(d - INSERT, i, FORCED[state]):
            out.append("I")
            d, state = d - INSERT, FORCED[state]
        elif kind != GONE and step is not None and holds(d - extra, i + 1, step):
            out.append("K")
            d, i, state = d - extra, i + 1, step
        else:
            out.append("R")
            d, i, state = d - REROLE - extra, i + 1, FORCED[state]
    return "".join(out), state


def _costs(layers) -> list[int]:
    return [next(d for d, layer in enumerate(layers) if layer[0] >> s & 1) for s in range(4)]


def repair(symbols: bytes) -> tuple[int, str]:
    """Cost and least audit of a conversation, given by 3 * letter + kind for each turn."""
    starts = list(range(0, len(symbols), SPAN)) or [0]
    ends, base, after = [0 if s in ACCEPTING else 1 << 62 for s in range(4)], 0, {}
    for k in reversed(starts[1:]):
        after[k] = ends
        costs = _costs(_layers(symbols[k : k + SPAN], ends, 15, k == starts[-1]))
        base, ends = base + min(costs), [c - min(costs) for c in costs]
    state, audit, cost = 0, [], 0
    for k in starts:
        piece, last = symbols[k : k + SPAN], k == starts[-1]
        to = after.get(k, ends)
        layers = _layers(piece, to, 1 << state, last)
        cost = cost or base + len(layers) - 1 if k == 0 else cost
        edits, state = _trace(piece, layers, to, state, last)
        audit.append(edits)
    return cost, "".join(audit)


_short_repair = lru_cache(1 << 15)(repair)
_PLAN = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Conversation:
    """What a plan needs to know of a conversation whose turns come one by one."""

    def __init__(self, key):
        self.key, self.symbols, self.counts = key, bytearray(), [0, 0, 0]
        self.first = self.last = self.before = None
        self.turns = self.illegal = 0

    def add(self, turn, initial, blank, short, later, times):
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.illegal += times - 1
        self.before = initial
        letter = 3 * (LETTERS.index(initial) if initial in ("s", "u", "a") else 3)
        fault = 0 if blank else 1 if later else 2 if short else None
        kind = GONE if fault in (0, 1) else SHORT if fault == 2 else WHOLE
        self.symbols += bytes([letter + kind]) + bytes([letter + GONE]) * (times - 1)
        if fault is not None:
            self.counts[fault] += 1
        self.counts[0 if blank else 1] += times - 1

    def plan(self):
        cost, audit = (_short_repair if len(self.symbols) <= SPAN else repair)(bytes(self.symbols))
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.key, gaps, *self.counts, self.illegal, cost, audit)


def _planner(schema: pa.Schema):
    def plans(batches):
        now, out = None, []
        for batch in batches:
            for key, *turn in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or key != now.key:
                    if now is not None:
                        out.append(now.plan())
                    now = _Conversation(key)
                now.add(*turn)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)
            out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(now.plan(), schema)], schema=schema)

    return plans


def _repairer(schema: pa.Schema):
    """Sorted rows (conv_id, header, role, text): a conversation's audit first, then its turns. Gives the turns after repair."""

    def turns(batches):
        key, edits, at, state, place = None, "", 0, 0, 0
        out: list = []

        def inserts():
            nonlocal at, state, place
            while at < len(edits) and edits[at] == "I":
                state = FORCED[state]
                out.append((key, place, "I", ROLE_INTO[state], ""))
                at, place = at + 1, place + 1

        for batch in batches:
            for conv, header, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if header:
                    inserts()
                    key, edits, at, state, place = conv, text, 0, 0, 0
                    continue
                inserts()
                edit, at = edits[at], at + 1
                if edit == "D":
                    continue
                if edit == "K":
                    state = STEPS[role[:1]][state]
                else:
                    state = FORCED[state]
                    role = ROLE_INTO[state]
                out.append((key, place, edit, role, text))
                place += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)
            out.clear()
        inserts()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return turns


def _arrow(kind: str, shape: str) -> pa.Schema:
    names = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32()}
    fields = [f.strip().split(" ") for f in shape.format(kind=kind).split(",")]
    return pa.schema([(name, names[t]) for name, t in fields])


def prepared(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text of rows, a null role or text being one space. Ids that are no strings are numbers."""
    kind = "string" if dict(rows.dtypes)[conv_col] == "string" else "long"
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{conv_col}`").cast(kind).alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))


def plan_repairs(turns: DataFrame) -> DataFrame:
    """One row for each conversation of prepared rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    ship(turns.sparkSession)
    kind = dict(turns.dtypes)["conv_id"]
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    short = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    same = turns.groupBy("conv_id", "turn", "role", F.sha2("text", 256).alias("digest")).agg(F.first(blank).alias("blank"), F.first(short).alias("short"), F.count("*").alias("times"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = same.groupBy("conv_id", "role", "digest").agg(F.min(when).alias("first"), F.count("*").alias("c")).where("c > 1")
    said = said.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    known = same.join(said, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    later = F.coalesce(~F.col("first").eqNullSafe(when), F.lit(False)) & F.col("_d").isNotNull()
    narrow = known.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "short", later.alias("later"), "times", "role", "digest")
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest").drop("role", "digest")
    return ordered.mapInArrow(_planner(_arrow(kind, _PLAN)), _PLAN.format(kind=kind))


_TURN = "conv_id {kind}, place long, edit string, role string, text string"


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """The turns of prepared rows after the repairs of `plans`: conv_id, place, edit (K, R or I), role, text.

    A conversation's turns lie together in one partition, in order.
    """
    ship(turns.sparkSession)
    kind = dict(turns.dtypes)["conv_id"]
    headers = plans.select("conv_id", F.lit(True).alias("header"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    rows = turns.select("conv_id", F.lit(False).alias("header"), "turn", "role", F.sha2("text", 256).alias("digest"), "text")
    ordered = headers.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("header"), "turn", "role", "digest")
    return ordered.select("conv_id", "header", "role", "text").mapInArrow(_repairer(_arrow(kind, _TURN)), _TURN.format(kind=kind))


def text_digests(repaired: DataFrame) -> DataFrame:
    """repaired_turns() to one row for each conversation that has turns: conv_id, digest of its `role:text` lines."""
    shape = "conv_id {kind}, digest string"
    kind = dict(repaired.dtypes)["conv_id"]
    schema = _arrow(kind, shape)

    def digests(batches):
        key, running = None, None
        for batch in batches:
            keys, found = [], []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if running is None or conv != key:
                    if running is not None:
                        keys.append(key), found.append(running.hexdigest())
                    key, running = conv, sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, schema[0].type), pa.array(found, pa.string())], schema=schema)
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], schema[0].type), pa.array([running.hexdigest()])], schema=schema)

    return repaired.select("conv_id", "role", "text").mapInArrow(digests, shape.format(kind=kind))


def damage(turns: DataFrame) -> DataFrame:
    """Prepared rows after fixed damage by CRC-32 of `conv_id:turn` (nulls: one space) modulo 20.

    0 drops a row, 1 empties its text, 2 takes away its `[.!?]`, 3 repeats it, 4 gives it the role user.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit: Column = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(hit == 3, 2).otherwise(1)))
    return turns.where(hit != 0).select("conv_id", "turn", F.when(hit == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_")).drop("_")


def repair_summaries(rows: DataFrame) -> DataFrame:
    """Damage, repair and summarise: one row for each conv_id of rows (conv_id, turn, role, text), with repaired_sha256."""
    turns = prepared(rows)
    damaged = damage(turns)
    plans = cut(plan_repairs(damaged))
    digests = text_digests(repaired_turns(damaged, plans)).withColumnRenamed("conv_id", "_d")
    every, planned = turns.select("conv_id").distinct(), plans.withColumnRenamed("conv_id", "_p")
    found = every.join(planned, F.col("conv_id").eqNullSafe(F.col("_p")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))
