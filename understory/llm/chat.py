"""Chat formatting: the cheapest repair of a conversation's roles, and its rendering.

A legal conversation is a path of a small automaton: an optional system turn, then user and assistant by turns, a tool
turn only between two assistant turns, and an assistant turn at the end. Every given turn is appended, merged into the
turn before it, or relabelled, and empty turns are inserted where that is cheaper. What a run of turns costs from one
state to another is a matrix; matrices of runs are combined by (min, +), so a conversation of any length is repaired in
chunks: only the matrices of a conversation that is cut meet in one place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from understory.llm.text import quoted, ready
from understory.session import stored

#: States are the role of the last turn, or the beginning.
BEGIN, SYSTEM, USER, ASSISTANT, TOOL = range(5)
STATES = 5
ROLES = ("", "system", "user", "assistant", "tool")
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant",
           "ai": "assistant", "agent": "assistant", "function": "tool", "observation": "tool", "developer": "system", "instruction": "system"}
NEXT = {BEGIN: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER, TOOL), TOOL: (ASSISTANT,)}
#: Turns and bytes of one chunk at most (a longer text is a chunk of its own).
CHUNK_TURNS, CHUNK_BYTES = 4096, 1 << 20
_ONE = 1 << 32          # costs are counted in this unit; below it, inserted turns, so equal costs go to fewer insertions
_NEVER = 1 << 60


@dataclass(frozen=True)
class Costs:
    """Of one merge, one relabelling, one inserted empty turn; a role that isn't known costs `unknown` whatever it becomes."""
    merge: int = 1
    relabel: int = 3
    insert: int = 2
    unknown: int = 1
    #: insertions that lead from one state to another: number and roles
    ways: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        for a in range(STATES):  # shortest paths, smaller states first
            seen, queue = {a: ()}, [a]
            while queue:
                s = queue.pop(0)
                for t in NEXT[s]:
                    if t not in seen:
                        seen[t] = (*seen[s], t)
                        queue.append(t)
            for b, path in seen.items():
                self.ways[a, b] = path

    def moves(self, role: int) -> list[tuple[int, int, int, tuple, bool]]:
        """(from, to, cost, inserted roles, merged) of every way to take one turn; role 0 isn't known."""
        out = []
        for q in range(1, STATES):
            label = 0 if role == q else (self.unknown if role == 0 else self.relabel)
            for s in range(STATES):
                if s == q:
                    out.append((s, q, (self.merge + label) * _ONE, (), True))
                best = min((self.ways[s, m] for m in range(STATES) if (s, m) in self.ways and q in NEXT[m]), key=len, default=None)
                if best is not None:
                    out.append((s, q, (label + self.insert * len(best)) * _ONE + len(best), best, False))
        return out


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else 0


class Repair:
    def __init__(self, costs: Costs):
        self.costs = costs
        self.moves = [costs.moves(r) for r in range(STATES)]
        end = [self.costs.ways.get((s, ASSISTANT)) for s in range(STATES)]
        self.end = [(costs.insert * len(p) * _ONE + len(p)) if p is not None else _NEVER for p in end]
        self.end[BEGIN] = 0  # nothing at all is legal

    def forward(self, roles: list[int], entry: list[int]) -> tuple[list[list[int]], list[list]]:
        """Best costs after each turn, and the move that leads there."""
        costs, back = [entry], []
        for r in roles:
            now, via = [_NEVER] * STATES, [None] * STATES
            last = costs[-1]
            for move in self.moves[r]:
                c = last[move[0]] + move[2]
                if c < now[move[1]]:
                    now[move[1]], via[move[1]] = c, move
            costs.append(now)
            back.append(via)
        return costs, back

    def matrix(self, roles: list[int]) -> list[int]:
        """Cost from each state to each other over the turns."""
        out = []
        for s in range(STATES):
            out += self.forward(roles, [0 if t == s else _NEVER for t in range(STATES)])[0][-1]
        return out

    def path(self, roles: list[int], entry: int, leave: int) -> list:
        """The cheapest moves from entry to leave."""
        _, back = self.forward(roles, [0 if t == entry else _NEVER for t in range(STATES)])
        out = []
        for via in reversed(back):
            out.append(via[leave])
            leave = via[leave][0]
        return out[::-1]

    def last(self, costs: list[int]) -> int:
        """The best state to end in."""
        return min(range(STATES), key=lambda s: (costs[s] + self.end[s], s))


def render(role: str, text: str, merged: bool, first: bool) -> str:
    """What one turn adds to the rendered conversation; a merged one goes on in the turn before it."""
    if merged:
        return "\n\n" + text
    return ("" if first else "<|end|>\n") + f"<|{role}|>\n{text}"


OUT = "conv_id {id}, seq bigint, turn bigint, role string, text string, action string, rendered string"
_ACTIONS = {(False, False): "keep", (False, True): "relabel", (True, False): "merge", (True, True): "relabel and merge"}


def _lines(conv, turns, roles, texts, moves, repair, entry, offset, closing):
    """Output rows of a chunk; closing: the state the conversation ends in, None if it goes on."""
    at = offset
    for turn, role, text, (s, q, _, inserted, merged) in zip(turns, roles, texts, moves):
        for extra in inserted:
            yield conv, at, turn, ROLES[extra], "", "insert", render(ROLES[extra], "", False, at == 0)
            at += 1
        text = text or ""
        yield conv, at, turn, ROLES[q], text, _ACTIONS[merged, role != q], render(ROLES[q], text, merged, at == 0)
        at += 1
    if closing is not None and turns:
        for extra in repair.costs.ways[closing, ASSISTANT]:
            yield conv, at, turns[-1], ROLES[extra], "", "insert", render(ROLES[extra], "", False, at == 0)
            at += 1
        yield conv, at, None, "", "", "close", "<|end|>\n"


def format_chats(turns: DataFrame, costs: Costs = Costs(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """The repaired conversations, one row per given or inserted turn and a closing row each.

    conv_id, seq (from 0, gapless, in order), turn (the given turn it stands for or before; NULL in the closing row),
    role, text, action (keep, merge, relabel, relabel and merge, insert, close) and rendered: joined by seq, the rendered
    strings are the conversation, a merged turn continuing the one before it. The repair has the least total cost; ties go
    to fewer insertions.

    Turns are ordered by turn, then by their place in the table; NULL turns come first. Roles are compared trimmed, in
    lower case and through ALIASES; others, and NULL, are unknown. NULL text is empty. NULL conv_ids are one conversation.
    Repeated rows are turns of their own. Other columns are left out. An empty table gives no rows. Rows are sorted by
    range, so a conversation of any length is spread over tasks; chunks have chunk_turns turns and CHUNK_BYTES at most.
    """
    spark = turns.sparkSession
    ready(spark)
    id_kind = next(f.dataType for f in turns.schema.fields if f.name == conv_col)
    id_type, arrow_id = id_kind.simpleString(), to_arrow_type(id_kind)
    repair = Repair(costs)
    rows = turns.select(quoted(conv_col).alias("conv_id"), quoted(turn_col).cast("bigint").alias("turn"), quoted(role_col).alias("role"),
                        quoted(text_col).alias("text"), F.monotonically_increasing_id().alias("_place"))
    keys = ["conv_id", "turn", "_place"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text")
    names = ["conv_id", "seq", "turn", "role", "text", "action", "rendered", "chunk", "matrix", "turns", "roles", "texts"]
    kinds = [arrow_id, pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=names)

    def chunks(batches):
        """Whole conversations are finished here; those that may go on in another task, and long ones, stay open."""
        chunk = TaskContext.get().partitionId() << 33
        conv, held, size, part, out = None, [], 0, 0, []
        first = True

        def close(whole):
            nonlocal chunk
            turns, roles, texts = [list(x) for x in zip(*held)]
            if whole:
                end = repair.last(repair.forward(roles, [0] + [_NEVER] * 4)[0][-1])
                moves = repair.path(roles, BEGIN, end)
                return [(*r, None, None, None, None, None) for r in _lines(conv, turns, roles, texts, moves, repair, BEGIN, 0, end)]
            chunk += 1
            return [(conv, None, None, None, None, None, None, chunk, repair.matrix(roles), turns, roles, texts)]

        weight = 0
        for batch in batches:
            for c, t, r, x in zip(*(b.to_pylist() for b in batch.columns)):
                change = bool(held) and c != conv
                full = bool(held) and not change and (len(held) >= chunk_turns or size + len(x or "") > CHUNK_BYTES)
                if change or full:
                    new = close(whole=change and part == 0 and not first)
                    weight += size
                    out += new
                    held, size, part = [], 0, 0 if change else part + 1
                    first &= not change
                    if weight > 4 << 20:
                        yield table(out)
                        out, weight = [], 0
                conv = c
                held.append((t, role_number(r), x))
                size += len(x or "")
        if held:
            out += close(whole=False)
        yield table(out)

    schema = OUT.format(id=id_type) + ", chunk bigint, matrix array<bigint>, turns array<bigint>, roles array<int>, texts array<string>"
    made = stored(ordered.mapInArrow(chunks, schema), "chats")
    final = ["conv_id", "seq", "turn", "role", "text", "action", "rendered"]

    def plan(batches):
        """Rows come sorted by conversation and chunk, one per chunk."""
        conv, run, started = None, [], False

        def decided():
            costs = [[0] + [_NEVER] * 4]
            for _, m, _ in run:
                costs.append([min(costs[-1][s] + m[s * STATES + t] for s in range(STATES)) for t in range(STATES)])
            state, leave = repair.last(costs[-1]), []
            for (_, m, _), before in zip(reversed(run), reversed(costs[:-1])):
                leave.append(state)
                state = min(range(STATES), key=lambda s: (before[s] + m[s * STATES + state], s))
            entry, offset, rows = BEGIN, 0, []
            for k, ((chunk, m, n), end) in enumerate(zip(run, reversed(leave))):
                rows.append((chunk, entry, end, offset, k == len(run) - 1))
                offset += n + m[entry * STATES + end] % _ONE
                entry = end
            return rows

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()))],
                                              names=["chunk", "entry", "leave", "offset", "ends"])

        for batch in batches:
            for c, chunk, m, n in zip(*(b.to_pylist() for b in batch.columns)):
                if started and c != conv:
                    yield batch_of(decided())
                    run = []
                conv, started = c, True
                run.append((chunk, m, n))
        if run:
            yield batch_of(decided())

    open_ = made.filter("chunk is not null")
    plans = (open_.select("conv_id", "chunk", "matrix", F.size("turns").alias("n")).repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
             .mapInArrow(plan, "chunk bigint, entry int, leave int, offset bigint, ends boolean"))

    def finish(batches):
        for batch in batches:
            for conv, turns, roles, texts, entry, leave, offset, ends in zip(*(b.to_pylist() for b in batch.columns)):
                moves = repair.path(roles, entry, leave)
                rows = list(_lines(conv, turns, roles, texts, moves, repair, entry, offset, leave if ends else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=final)

    rest = (open_.select("conv_id", "chunk", "turns", "roles", "texts").join(plans, "chunk")
            .select("conv_id", "turns", "roles", "texts", "entry", "leave", "offset", "ends").mapInArrow(finish, OUT.format(id=id_type)))
    return made.filter("chunk is null").select(*final).unionByName(rest)
