"""Chat formatting with minimum-cost role repair.

The legal conversation is an optional system turn and then user and assistant turns in alternation, ending with the
assistant. Every row is kept in its role, merged into the turn before it, relabelled, and may be preceded by an inserted
empty turn; the path of least total cost through the automaton is chosen, of several the one whose actions come first.

A conversation may be of any length. Rows are sorted by conversation and turn into tasks of even size; each task reduces
each stretch of a conversation to a 4 x 4 min-plus matrix, the driver joins the matrices of stretches that meet at a
boundary (at most two a task), and then every stretch is decoded on its own from the exact costs that lie ahead of it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, keep, tidy

#: States: what came last. 0: nothing, 1: system, 2: user, 3: assistant.
ROLES = (None, "system", "user", "assistant")
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
MERGE, RELABEL, INSERT, FAR = 1, 2, 3, 1 << 40
_OPEN, _CLOSE = "<|{}|>\n", "\n<|end|>\n"


def _moves(role: str | None):
    """For a row of this role: state -> [(cost, action, next state, inserted role or None)], in order of preference."""
    out = {}
    for state in range(4):
        found = []
        for to in NEXT[state]:
            found.append((0, "keep", to, None) if ROLES[to] == role else (RELABEL, "relabel", to, None))
        if state:
            found.append((MERGE if ROLES[state] == role else MERGE + RELABEL, "merge", state, None))
        for mid in NEXT[state]:
            for to in NEXT[mid]:
                cost = INSERT + (0 if ROLES[to] == role else RELABEL)
                found.append((cost, "keep" if ROLES[to] == role else "relabel", to, ROLES[mid]))
        out[state] = sorted(found, key=lambda m: (m[0], ("keep", "merge", "relabel").index(m[1]), m[2], m[3] or ""))
    return out


_MOVES = {role: _moves(role) for role in (*ROLES[1:], None)}
#: Cost of ending in a state: after a user, or a system turn alone, empty turns are inserted.
ENDING = (0, 2 * INSERT, INSERT, 0)


def _ahead(roles: list, end: list[int]) -> list[list[int]]:
    """Least cost from each state before each row, given those after the last."""
    costs = [list(end)]
    for role in reversed(roles):
        later, moves = costs[-1], _MOVES.get(role, _MOVES[None])
        costs.append([min(c + later[to] for c, _, to, _ in moves[s]) for s in range(4)])
    return costs[::-1]


def matrix(roles: list) -> list[list[int]]:
    """cost[state before][state after] of a stretch."""
    columns_ = [_ahead(roles, [0 if s == t else FAR for s in range(4)])[0] for t in range(4)]
    return [[min(FAR, columns_[t][s]) for t in range(4)] for s in range(4)]


def decode(roles: list, state: int, end: list[int]) -> tuple[list[tuple], int]:
    """[(action, state, inserted role)] of the chosen path from a state, and the state after it."""
    costs, out = _ahead(roles, end), []
    for k, role in enumerate(roles):
        for cost, action, to, inserted in _MOVES.get(role, _MOVES[None])[state]:
            if cost + costs[k + 1][to] == costs[k][state]:
                out.append((action, to, inserted))
                state = to
                break
    return out, state


def _stretches(ids: list):
    i = 0
    while i < len(ids):
        j = i
        while j < len(ids) and ids[j] == ids[i]:
            j += 1
        yield i, j
        i = j


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, nth, turn, role, new_role, action, inserted, rendered) for every row of turns.

    nth numbers a conversation's rows from 0, as sorted by turn (nulls first), role and text; rows equal in all of these are
    repeated turns, of which any may come first. inserted is the role of an empty turn before the row. rendered is the row's
    share of the conversation's text: joined in order of nth, the shares of a conversation are its text, and each closes
    what its successor does not continue. Roles are read without regard to case and outer blanks and returned as they
    stand; a row whose role is null or unknown is relabelled or merged. All rows without a conv_id are one conversation; a
    null text is empty. A conversation may be of any length, and texts too. Other columns are ignored. An empty table gives
    no rows.
    """
    spark = turns.sparkSession
    n = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = columns(turns, "conv_id", "turn", "role", "text")
    order = ["conv_id", "turn", "role", "text"]
    # Rows equal in all columns can't be told apart, so that a further number may part them between tasks.
    spread = rows.withColumn("tie", F.monotonically_increasing_id())
    ordered = spread.repartitionByRange(n, *order, "tie").sortWithinPartitions(*order, "tie").withColumn("part", F.spark_partition_id()).drop("tie")
    ordered = keep(ordered.withColumn("place", F.monotonically_increasing_id()), "turns")
    # From here on, a stretch is one conversation within one part; the table is read part by part, in order of place.
    ready = ordered.repartition(n, "part").sortWithinPartitions("part", "place")

    def cut(batches):
        """Yield (part, conversation, table) of whole stretches; a batch is looked at once."""
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            for i, j in _stretches(keys):
                if held and keys[i] != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = keys[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield now, pa.Table.from_batches(held)

    def roles_of(table) -> list:
        return [None if r is None else r.strip().lower() for r in table["role"].to_pylist()]

    def edges(batches):
        """Matrices of the first and the last stretch of each part: only these can go on elsewhere."""
        part, own = None, []

        def give():
            for (p, conv), roles, place in own:
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "conv_id": pa.array([conv], key_type), "place": [place], "rows": [len(roles)], "costs": pa.array([[x for r in matrix(roles) for x in r]], pa.list_(pa.int64()))})

        for key, table in cut(batches):
            if key[0] != part:
                yield from give()
                part, own = key[0], []
            if len(own) == 2:
                own.pop()
            own.append((key, roles_of(table), table["place"][0].as_py()))
        yield from give()

    kind = rows.schema["conv_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(rows.schema["conv_id"].dataType)
    # At most two short rows a part come to the driver.
    found = ready.select("part", "place", "conv_id", "role").mapInArrow(edges, f"part int, conv_id {kind}, place bigint, rows bigint, costs array<bigint>").collect()
    found.sort(key=lambda r: (r["part"], r["place"]))
    stretch = [(r["part"], r["place"], r["conv_id"], [r["costs"][4 * s : 4 * s + 4] for s in range(4)], r["rows"]) for r in found]

    start = {k: k for k in range(len(stretch))}
    end_costs: list[list[int]] = [list(ENDING)] * len(stretch)
    for k in range(len(stretch) - 2, -1, -1):
        if stretch[k][2] == stretch[k + 1][2] and stretch[k][0] != stretch[k + 1][0]:
            later = end_costs[k + 1]
            end_costs[k] = [min(stretch[k + 1][3][s][t] + later[t] for t in range(4)) for s in range(4)]
            start[k + 1] = k
    # Rows of the conversation in the parts before.
    offset: dict[int, int] = {}
    for k in range(1, len(stretch)):
        if start[k] != k:
            offset[stretch[k][1]] = offset.get(stretch[k - 1][1], 0) + stretch[k - 1][4]
    # Among equally good states at a boundary, the path's own preference decides: each stretch says where it ends from each start.
    joined = {stretch[k][1]: end_costs[k] for k in range(len(stretch)) if start[k] != k or end_costs[k] != list(ENDING)}

    def ends(batches):
        for _, table in cut(batches):
            place = table["place"][0].as_py()
            if place in joined:
                roles = roles_of(table)
                yield pa.RecordBatch.from_pydict({"place": [place], "after": pa.array([[decode(roles, s, joined[place])[1] for s in range(4)]], pa.list_(pa.int32()))})

    states: dict[int, int] = {}
    if joined:
        touched = sorted({p for p, *_ in stretch})
        after = {r["place"]: r["after"] for r in ready.where(F.col("part").isin(touched)).select("part", "place", "conv_id", "role").mapInArrow(ends, "place bigint, after array<int>").collect()}
        for k in range(len(stretch)):
            if start[k] != k:
                before = stretch[k - 1][1]
                states[stretch[k][1]] = after[before][states.get(before, 0)]
    goes_on = {stretch[k][1] for k in range(len(stretch) - 1) if start[k + 1] == k}

    def render(batches):
        for _, table in cut(batches):
            place = table["place"][0].as_py()
            state = states.get(place, 0)
            path, _ = decode(roles_of(table), state, joined.get(place, list(ENDING)))
            last, k = state, 0
            for batch in table.to_batches():  # a long stretch is handed on piece by piece
                texts, own, shares = batch.column("text").to_pylist(), path[k : k + batch.num_rows], []
                for text, (action, to, inserted) in zip(texts, own):
                    share = ""
                    if action == "merge":
                        share += "\n"
                    else:
                        share += _CLOSE if last else ""
                        if inserted:
                            share += _OPEN.format(inserted) + _CLOSE
                        share += _OPEN.format(ROLES[to])
                    shares.append(share + (text or ""))
                    last = to
                nth = offset.get(place, 0) + k
                k += batch.num_rows
                if k == len(path) and place not in goes_on:
                    shares[-1] += _CLOSE
                    for role in {1: ("user", "assistant"), 2: ("assistant",)}.get(last, ()):
                        shares[-1] += _OPEN.format(role) + _CLOSE
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("conv_id"), pa.array(range(nth, nth + batch.num_rows), pa.int64()), batch.column("turn"), batch.column("role"),
                        pa.array([ROLES[to] for _, to, _ in own]), pa.array([a for a, _, _ in own]), pa.array([i for _, _, i in own], pa.string()), pa.array(shares),
                    ],
                    names=["conv_id", "nth", "turn", "role", "new_role", "action", "inserted", "rendered"],
                )

    turn = rows.schema["turn"].dataType.simpleString()
    return ready.select("part", "place", "conv_id", "turn", "role", "text").mapInArrow(tidy(render), f"conv_id {kind}, nth bigint, turn {turn}, role string, new_role string, action string, inserted string, rendered string")
