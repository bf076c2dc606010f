"""Chat formatting: minimum-cost repair of role sequences over an automaton of legal turns.

Legal conversations: at most one system turn, first; then user and assistant in turn,
with tool turns between two assistant turns; the last turn is the assistant's. Every
source turn is kept, relabelled, or merged into the turn before it, and empty turns may
be inserted anywhere; the cheapest way under ``Costs`` is found by dynamic programming
over the automaton's states, ties by state order. The result is rendered as fragments,
one per source turn: put together in order they are the conversation's text.

A conversation may hold a third of all rows, so none is gathered. Rows are range
partitioned by (conversation, turn) and checkpointed. A step over one turn is a
(min, +) product of 5 x 5 matrices, which is associative: the first and last run of
every partition are summed up as such a matrix, at most two per partition; the driver
joins those that continue each other and hands each run the costs it starts from. The
runs answer where each exit state comes from, which gives every run its exit state. A
task then repairs its own partition and holds no more than that; the result does not
depend on how the rows are cut.

Defined results: an unknown or null role is one the automaton does not know and is
relabelled at ``Costs.unknown``; a null text is empty; null conversation numbers form
one conversation; rows of one conversation with equal turn are ordered by role and
text, and equal rows stay separate turns; an empty table gives no rows; other columns
are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnspark.llm.common import Batches, column, map_batches, record
from txnspark.sources.scratch import scratch_root

ROLES = ("system", "user", "assistant", "tool")
START, AFTER = 0, {"system": 1, "user": 2, "assistant": 3, "tool": 4}
LEGAL = {0: ("system", "user"), 1: ("user",), 2: ("assistant",), 3: ("user", "tool"), 4: ("assistant",)}
FINAL = (START, AFTER["assistant"])
STATES = 5
FAR = 1 << 40

OUT = (
    "conv_id long, turn long, role string, action string, inserted string, out_turn long, "
    "out_role string, cost long, fragment string"
)


@dataclass(frozen=True)
class Costs:
    merge: int = 2
    relabel: int = 5
    unknown: int = 1
    insert: int = 4


@dataclass
class Automaton:
    """Step costs and actions for every (role, state before, state after)."""

    costs: Costs
    gap: list[list[int]] = field(init=False)  # cheapest insertions between two states
    filler: dict[tuple[int, int], tuple[str, ...]] = field(init=False)
    memo: dict = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.gap = [[0 if a == b else FAR for b in range(STATES)] for a in range(STATES)]
        self.filler = {(s, s): () for s in range(STATES)}
        for a in range(STATES):
            seen, level = {a: ()}, [a]
            while level:
                ahead = []
                for s, role in ((s, r) for s in level for r in LEGAL[s]):
                    if AFTER[role] not in seen:
                        seen[AFTER[role]] = (*seen[s], role)
                        ahead.append(AFTER[role])
                level = ahead
            for s, roles in seen.items():
                self.gap[a][s], self.filler[a, s] = self.costs.insert * len(roles), roles

    def label(self, role: str | None, to: str) -> int:
        if role == to:
            return 0
        return self.costs.relabel if role in ROLES else self.costs.unknown

    def action(self, role: str | None, s: int, t: int) -> tuple[int, str, tuple[str, ...]]:
        """(cost, "keep" / "relabel" / "merge", inserted roles) of the cheapest step s to t."""
        if t == START:
            return FAR, "", ()
        to = ROLES[t - 1]
        own = self.label(role, to)
        ways = [
            (self.gap[s][p] + own, "relabel" if own else "keep", self.filler[s, p])
            for p in range(STATES)
            if to in LEGAL[p] and self.gap[s][p] < FAR
        ]
        if s == t:
            ways.append((self.costs.merge + own, "merge", ()))
        return min(ways, key=lambda w: w[0], default=(FAR, "", ()))

    def step(self, vector: tuple[int, ...], role: str | None) -> tuple[tuple[int, ...], int, tuple[int, ...]]:
        """Next cost vector (least cost 0), what was taken off, and each state's best predecessor.

        Differences between states stay small, so few vectors exist and each is worked out once.
        """
        role = role if role in ROLES else None
        if (vector, role) not in self.memo:
            value, back = [], []
            for t in range(STATES):
                best = min(range(STATES), key=lambda s: min(FAR, vector[s] + self.action(role, s, t)[0]))
                value.append(min(FAR, vector[best] + self.action(role, best, t)[0]))
                back.append(best)
            low = min(value)
            value = [v - low if v < FAR else FAR for v in value]
            self.memo[vector, role] = (tuple(value), low, tuple(back))
        return self.memo[vector, role]

    def run(self, roles: list[str | None], start: list[int]) -> tuple[list[int], list[tuple[int, ...]]]:
        """Cost of every state after ``roles`` from the costs ``start``, and the back pointers."""
        total, back = min(start), []
        vector = tuple(min(FAR, v - total) if v < FAR else FAR for v in start)
        for role in roles:
            vector, low, pointers = self.step(vector, role)
            total += low
            back.append(pointers)
        return [min(FAR, total + v) for v in vector], back

    def last(self, cost: list[int]) -> int:
        """The exit state from which the conversation ends most cheaply."""
        return min(range(STATES), key=lambda s: min(FAR, cost[s] + self.ending(s)[0]))

    def ending(self, s: int) -> tuple[int, tuple[str, ...]]:
        end = min(FINAL, key=lambda f: self.gap[s][f])
        return self.gap[s][end], self.filler[s, end]


def path_of(back: list[tuple[int, ...]], exit_state: int) -> list[int]:
    """States before each turn and after the last one."""
    states = [exit_state]
    for pointers in reversed(back):
        states.append(pointers[states[-1]])
    return states[::-1]


def opened(machine: Automaton, roles: list[str | None], states: list[int]) -> int:
    """Output turns that a path begins, inserted ones included."""
    steps = zip(roles, states, states[1:], strict=False)
    acts = [machine.action(r if r in ROLES else None, s, t) for r, s, t in steps]
    return sum((a[1] != "merge") + len(a[2]) for a in acts)


def render(machine: Automaton, rows: list[tuple], states: list[int], turns: int, ends: bool) -> list[tuple]:
    """Output rows of one run: ``turns`` output turns came before, ``ends`` closes the conversation."""
    out = []
    for i, ((conv, turn, role, text), s, t) in enumerate(zip(rows, states, states[1:], strict=False)):
        cost, action, inserted = machine.action(role if role in ROLES else None, s, t)
        text = (text or "").replace("<|", "< |")
        if action == "merge":
            fragment = "\n" + text
        else:
            lead = "".join(f"<|{r}|>\n<|end|>\n" for r in inserted)
            fragment = ("<|end|>\n" if s != START else "") + lead + f"<|{ROLES[t - 1]}|>\n{text}"
            turns += 1 + len(inserted)
        number = turns - 1
        if ends and i == len(rows) - 1:
            more, roles = machine.ending(t)
            cost += more
            inserted = (*inserted, *(f"+{r}" for r in roles))
            fragment += "<|end|>\n" + "".join(f"<|{r}|>\n<|end|>\n" for r in roles)
        out.append((conv, turn, role, action, ",".join(inserted), number, ROLES[t - 1], cost, fragment))
    return out


def _runs(batches: Batches) -> list[list[tuple]]:
    """The partition's rows by conversation, in order."""
    out: list[list[tuple]] = []
    for batch in batches:
        columns = [column(batch, n).to_pylist() for n in ("conv_id", "turn", "role", "text")]
        for row in zip(*columns, strict=True):
            if not out or out[-1][0][0] != row[0]:
                out.append([])
            out[-1].append(row)
    return out


@lru_cache(maxsize=4)
def automaton(costs: Costs) -> Automaton:
    return Automaton(costs)


def at(state: int) -> list[int]:
    """Costs of being in one state and no other."""
    return [0 if s == state else FAR for s in range(STATES)]


def chains_of(edges: list[dict]) -> list[list[dict]]:
    """Runs of conversations that cross partitions, in order, each with the costs it starts from.

    ``edges`` are the first and last runs of all partitions with their cost matrices.
    """
    chains: list[list[dict]] = []
    for e in sorted(edges, key=lambda e: (e["part"], e["run"])):
        if chains and chains[-1][-1]["conv_id"] == e["conv_id"]:
            chains[-1].append(e)
        else:
            chains.append([e])
    chains = [c for c in chains if len(c) > 1]
    for chain in chains:
        now = at(START)
        for e in chain:
            e["start"] = now
            now = [min(min(FAR, now[s] + e["cost"][s * STATES + t]) for s in range(STATES)) for t in range(STATES)]
            e["end"] = now
    return chains


def resolve(
    chains: list[list[dict]], traced: dict[tuple[int, int], tuple[list[int], list[int]]], machine: Automaton
) -> dict[tuple[int, int], tuple[list[int], int, int, bool]]:
    """(part, run) to (costs at the start, exit state, output turns before, whether it ends).

    ``traced`` has, for each run and exit state, the entry state it comes from and the
    output turns on the way.
    """
    out = {}
    for chain in chains:
        exits = [machine.last(chain[-1]["end"])]
        for e in reversed(chain):
            exits.append(traced[e["part"], e["run"]][0][exits[-1]])
        exits, turns = exits[::-1][1:], 0
        for i, e in enumerate(chain):
            key = e["part"], e["run"]
            out[key] = (e["start"], exits[i], turns, i == len(chain) - 1)
            turns += traced[key][1][exits[i]]
    return out


def repair(turns: DataFrame, costs: Costs | None = None, partitions: int | None = None) -> DataFrame:
    """Repaired conversations: one row per source turn, see the module's text."""
    costs, spark = costs or Costs(), turns.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    # The last key cuts runs of equal rows, which are interchangeable.
    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    cut = ["conv_id", "turn", "role", F.xxhash64("text"), "_tie"]
    dealt = keyed.repartitionByRange(partitions, *cut) if partitions else keyed.repartitionByRange(*cut)
    dealt = dealt.sortWithinPartitions(*cut).select(*order).checkpoint()
    roles_only = dealt.select("conv_id", "turn", "role", F.lit(None).cast("string").alias("text"))
    fields = [("part", pa.int32()), ("run", pa.int32()), ("conv_id", pa.int64())]
    matrix = pa.schema([*fields, ("cost", pa.list_(pa.int64()))])

    def summarise(batches: Batches) -> Batches:
        machine, runs = automaton(costs), _runs(batches)
        for i in sorted({0, len(runs) - 1}) if runs else ():
            roles = [r[2] for r in runs[i]]
            cost = [c for entry in range(STATES) for c in machine.run(roles, at(entry))[0]]
            yield record(matrix, [TaskContext.get().partitionId()], [i], [runs[i][0][0]], [cost])

    shape = "part int, run int, conv_id long, cost array<long>"
    edges = [r.asDict() for r in map_batches(roles_only, summarise, shape).collect()]
    chains = chains_of(edges)
    starts = spark.sparkContext.broadcast({(e["part"], e["run"]): e["start"] for c in chains for e in c})
    origin = pa.schema([*fields, ("entry", pa.list_(pa.int64())), ("turns", pa.list_(pa.int64()))])

    def trace(batches: Batches) -> Batches:
        machine, part = automaton(costs), TaskContext.get().partitionId()
        for i, run in enumerate(_runs(batches)):
            if (part, i) in starts.value:
                roles = [r[2] for r in run]
                _, back = machine.run(roles, starts.value[part, i])
                paths = [path_of(back, t) for t in range(STATES)]
                turns = [opened(machine, roles, p) for p in paths]
                yield record(origin, [part], [i], [run[0][0]], [[p[0] for p in paths]], [turns])

    shape = "part int, run int, conv_id long, entry array<long>, turns array<long>"
    found = map_batches(roles_only, trace, shape).collect() if chains else []
    traced = {(r["part"], r["run"]): (r["entry"], r["turns"]) for r in found}
    crossing = resolve(chains, traced, automaton(costs))
    shared = spark.sparkContext.broadcast(crossing)  # at most two entries per partition
    kinds = {"long": pa.int64(), "string": pa.string()}
    result = pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in OUT.split(", "))])

    def rewrite(batches: Batches) -> Batches:
        machine, part = automaton(costs), TaskContext.get().partitionId()
        held: list[tuple] = []
        for i, run in enumerate(_runs(batches)):
            roles = [r[2] for r in run]
            if (part, i) in shared.value:
                start, exit_state, before, ends = shared.value[part, i]
                _, back = machine.run(roles, start)
            else:
                before, ends = 0, True
                cost, back = machine.run(roles, at(START))
                exit_state = machine.last(cost)
            held += render(machine, run, path_of(back, exit_state), before, ends)
            while len(held) >= 4096:
                yield record(result, *map(list, zip(*held[:4096], strict=True)))
                held = held[4096:]
        if held:
            yield record(result, *map(list, zip(*held, strict=True)))

    return map_batches(dealt, rewrite, OUT)


def cheapest(roles: list[str | None], costs: Costs | None = None) -> int:
    """Least cost of one short conversation by trying every path; for tests."""
    machine = Automaton(costs or Costs())
    if not roles:
        return 0
    best = FAR
    for path in product(range(STATES), repeat=len(roles)):
        states = (START, *path)
        cost = sum(machine.action(r if r in ROLES else None, s, t)[0] for r, s, t in zip(roles, states, states[1:], strict=False))
        best = min(best, cost + machine.ending(path[-1])[0])
    return best
