"""Chat formatting: repair of role sequences at least cost, then rendering.

A legal conversation is, by an automaton of four states: an optional system
turn, then user and assistant turns by turns from a user's, the last an
assistant's.  Each turn is kept, relabelled, or merged into the turn before;
empty turns may go in between.  Dynamic programming over the states finds the
cheapest way; of equal ones that which comes from the lowest state, then the
lowest role.

A conversation may be longer than a task can hold.  Turns are sorted into range
partitions by conversation and turn; a part of a conversation folds into a 4 x 4
matrix of costs, the product of which over the parts gives each part's entry
costs, and each part's table of entry by exit state the states between parts.
Only a partition's first and last conversation can reach over its edges, so what
the driver sees is two small rows for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, stored, table

START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
ROLES = ("system", "user", "assistant")
MERGE, RELABEL, UNKNOWN, INSERT = 1, 2, 1, 3
FAR = 1 << 40
#: Template of a rendered turn: before and after its text.
OPEN, CLOSE, JOIN = "<|{}|>\n", "\n<|end|>\n", "\n\n"


def _transitions():
    """(from, role, to, cost without relabelling, inserted roles, merged) of every legal step."""
    out = []
    for q in range(4):
        for x, role in enumerate(ROLES):
            to = x + 1
            if to == q:
                out.append((q, x, to, MERGE, (), True))
            elif role == "system" and q == START or role == "user" or role == "assistant" and q == AFTER_USER:
                out.append((q, x, to, 0, (), False))
            elif role == "assistant":
                out.append((q, x, to, INSERT, ("user",), False))
    return out


STEPS = _transitions()
#: Cost at the end, and the empty turns put there.
ENDS = {START: (0, ()), AFTER_SYSTEM: (2 * INSERT, ("user", "assistant")), AFTER_USER: (INSERT, ("assistant",)), AFTER_ASSISTANT: (0, ())}


def relabel(given: int, role: int) -> int:
    """given: 0 to 2 a role's number, 3 any other or none."""
    return 0 if given == role else UNKNOWN if given == 3 else RELABEL


def advance(costs: list, given: int) -> tuple[list, list]:
    """Costs of the four states after a turn, and the step taken into each (None if there is none)."""
    new, how = [FAR] * 4, [None] * 4
    for step in STEPS:
        q, x, to, cost, _, _ = step
        c = costs[q] + cost + relabel(given, x)
        if costs[q] < FAR and c < new[to]:
            new[to], how[to] = c, step
    return new, how


def product(given: list) -> list:
    """Matrix of least costs from each state before the turns to each after."""
    rows = []
    for q in range(4):
        costs = [0 if i == q else FAR for i in range(4)]
        for g in given:
            costs = advance(costs, g)[0]
        rows.append(costs)
    return rows


def solve(entry: list, given: list) -> tuple[list, list]:
    """Costs after all turns, and the steps into each state by turn."""
    back = []
    for g in given:
        entry, how = advance(entry, g)
        back.append(how)
    return entry, back


def trace(back: list, exit_state: int) -> tuple[int, list]:
    """Entry state and steps of the cheapest way that ends in exit_state."""
    steps, q = [], exit_state
    for how in reversed(back):
        steps.append(how[q])
        q = how[q][0]
    return q, steps[::-1]


def best_end(costs: list) -> int:
    return min(range(4), key=lambda q: (costs[q] + ENDS[q][0], q))


FIRST = [0, FAR, FAR, FAR]


def _numbers(roles: pa.Array) -> list:
    index = {r: i for i, r in enumerate(ROLES)}
    return [index.get((r or "").strip().lower(), 3) for r in roles.to_pylist()]


def _runs(batches: Iterator[pa.RecordBatch], columns: list):
    """(part, conversation number in the part, values of the columns) of each run of equal part and conversation; rows come sorted."""
    key, held = None, None
    for batch in batches:
        parts, convs = batch.column("part").to_pylist(), batch.column("conv").to_pylist()
        values = [_numbers(batch.column(c)) if c == "role" else batch.column(c).to_pylist() for c in columns]
        start = 0
        for i in range(1, len(parts) + 1):
            if i == len(parts) or (parts[i], convs[i]) != (parts[i - 1], convs[i - 1]):
                now = (parts[start], convs[start])
                piece = [v[start:i] for v in values]
                if held is not None and now == key:
                    held = [a + b for a, b in zip(held, piece, strict=True)]
                else:
                    if held is not None:
                        yield (*key, held)
                    key, held = now, piece
                start = i
    if held is not None:
        yield (*key, held)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds part (the partition's number) and seq (the row's number in it)."""
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        m = batch.num_rows
        yield pa.record_batch([*batch.columns, pa.array([part] * m, pa.int32()), pa.array(range(n, n + m), pa.int64())], names=[*batch.schema.names, "part", "seq"])
        n += m


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per input turn: conv, turn, role (given), new_role, action (keep, relabel, merge, or both), inserted (roles of empty turns
    before it), appended (roles of empty turns after the conversation's last), cost, rendered.

    rendered, in the order of position, gives the whole conversation.  Roles are
    compared without case and outer white space; a null or unknown one takes any
    role at a lesser price.  Null texts are empty.  Turns are in order of turn
    (null first); equal ones by role, then text.  A null conversation id is a
    conversation like any other; repeated rows are turns of their own.  An empty
    table gives no rows; other columns are not read.
    """
    spark = conversations.sparkSession
    rows = conversations.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "tie", "row"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv", "turn", "role", "text")
    rows = stored(in_batches(rows, _numbered, "conv long, turn long, role string, text string, part int, seq long"), "turns")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "part").sortWithinPartitions("part", "seq")

    # conversations in more than one part: two for each partition at most
    ends = rows.groupBy("part").agg(F.min_by("conv", "seq").alias("a"), F.max_by("conv", "seq").alias("b"), F.count("*").alias("n")).orderBy("part").collect()
    chains: dict = {}
    for r in ends:
        for c in dict.fromkeys([r["a"], r["b"]]):
            chains.setdefault(c, []).append(r["part"])
    chains = {c: p for c, p in chains.items() if len(p) > 1}
    entries: dict = {}
    exits: dict = {}
    if chains:
        wanted = {(p, c) for c, ps in chains.items() for p in ps}
        among = F.broadcast(spark.createDataFrame(sorted(wanted, key=str), "p int, c long"))
        edge = stored(rows.join(among, (F.col("part") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c"))).select("conv", "part", "seq", "role"), "edges")

        def fold(batches):
            out = [(p, c, [x for row in product(v[0]) for x in row]) for p, c, v in _runs(batches, ["role"])]
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["part", "conv", "m"])

        folded = {(r["part"], r["conv"]): r["m"] for r in in_batches(dealt(edge), fold, "part int, conv long, m array<long>").collect()}
        last: dict = {}
        for c, ps in chains.items():
            costs = FIRST
            for p in ps:
                entries[p, c] = costs
                m = folded[p, c]
                costs = [min(FAR, min(costs[i] + m[4 * i + j] for i in range(4))) for j in range(4)]
            last[c] = best_end(costs)

        def turn_back(batches):
            out = []
            for p, c, v in _runs(batches, ["role"]):
                costs, back = solve(entries[p, c], v[0])
                out.append((p, c, [trace(back, q)[0] if costs[q] < FAR else -1 for q in range(4)]))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["part", "conv", "m"])

        turned = {(r["part"], r["conv"]): r["m"] for r in in_batches(dealt(edge), turn_back, "part int, conv long, m array<long>").collect()}
        for c, ps in chains.items():
            q = last[c]
            for i, p in enumerate(reversed(ps)):
                exits[p, c] = (q, i == 0)
                q = turned[p, c][q]
    return in_batches(dealt(rows), _rendering(entries, exits), "part int, seq long, conv long, turn long, role string, new_role string, action string, inserted array<string>, appended array<string>, cost int, rendered string")


def _rendering(entries: dict, exits: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.list_(pa.string())
        schema = pa.schema(
            [("part", pa.int32()), ("seq", pa.int64()), ("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("inserted", texts), ("appended", texts), ("cost", pa.int32()), ("rendered", pa.string())]
        )
        out: list = []
        for part, conv, (given, named, turns, seqs, bodies) in _runs(map(_named, batches), ["role", "named", "turn", "seq", "text"]):
            costs, back = solve(entries.get((part, conv), FIRST), given)
            end, last = exits.get((part, conv), (best_end(costs), True))
            q, steps = trace(back, end)
            for i, (at, x, _, cost, inserted, merged) in enumerate(steps):
                final = last and i == len(steps) - 1
                after = ENDS[end][1] if final else ()
                closing = CLOSE if final else ""
                before = "" if merged or at == START else CLOSE
                shown = (JOIN if merged else before + "".join(OPEN.format(r) + CLOSE for r in inserted) + OPEN.format(ROLES[x])) + bodies[i] + closing + "".join(OPEN.format(r) + CLOSE for r in after)
                changed = given[i] != x
                action = "+".join((["relabel"] if changed else []) + (["merge"] if merged else [])) or "keep"
                out.append((part, seqs[i], conv, turns[i], named[i], ROLES[x], action, list(inserted), list(after), cost + relabel(given[i], x) + (ENDS[end][0] if final else 0), shown))
            if len(out) >= 2000:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    return run


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _named(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The role column a second time, as it was given."""
    return pa.record_batch([*batch.columns, batch.column("role")], names=[*batch.schema.names, "named"])


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all conversations."""
    return repair(table(spark, sf_dir, "conversations")).select(
        F.col("conv").alias("conv_id"), "turn", "role", "new_role", "action", F.array_join("inserted", ",").alias("inserted"), F.array_join("appended", ",").alias("appended"), "cost", F.sha2("rendered", 256).alias("rendered_sha256")
    )
