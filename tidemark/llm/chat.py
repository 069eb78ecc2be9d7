"""Chat formatting: least-cost repair of roles by dynamic programming, then rendering."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jaccard import small
from .store import Scratch

#: States of the automaton of legal turns: what the last turn was.
STATES = ("start", "system", "user", "assistant", "tool")
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}
#: What a conversation may end with.
ENDS = ("user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant", "function": "tool", "developer": "system"}
#: Costs of joining a turn to the one before it, of another role, of a role where none is known,
#: and of an empty turn.
COSTS = {"merge": 2, "relabel": 3, "unknown": 1, "insert": 4}
#: Turns of a row; longer conversations are cut after as many, and joined by cost matrices.
PIECE = 2048
_BIG = 1 << 40


class Automaton:
    """Costs of one turn between states, and the best actions."""

    def __init__(self, legal=None, ends=ENDS, costs=None):
        legal, self.costs = legal or LEGAL, COSTS | (costs or {})
        n = len(STATES)
        at = {s: i for i, s in enumerate(STATES)}
        self.ends = [at[s] for s in ends]
        self.legal = np.zeros((n, n), bool)
        for s, to in legal.items():
            self.legal[at[s], [at[x] for x in to]] = True
        # insertions: cheapest ways between states and the empty turns on them
        self.way = [[(0, ()) if i == j else (_BIG, ()) for j in range(n)] for i in range(n)]
        for _ in range(n):
            for i in range(n):
                for j in range(n):
                    c, path = self.way[i][j]
                    for k in np.flatnonzero(self.legal[j]).tolist():
                        if c + self.costs["insert"] < self.way[i][k][0]:
                            self.way[i][k] = (c + self.costs["insert"], (*path, k))
        self.moves: dict = {}

    def role(self, name) -> int:
        """State of a role's name; 0 for none that is known."""
        name = (name or "").strip().lower()
        name = ALIASES.get(name, name)
        return STATES.index(name) if name in STATES[1:] else 0

    def move(self, role: int):
        """[state][state]: (cost, empty turns before it, whether it is merged) for a turn."""
        if role not in self.moves:
            n = len(STATES)
            table = [[(_BIG, (), False)] * n for _ in range(n)]
            for s in range(n):
                for a in range(1, n):
                    label = 0 if role == a else self.costs["relabel" if role else "unknown"]
                    for x in range(n):
                        c, path = self.way[s][x]
                        if self.legal[x, a] and c + label < table[s][a][0]:
                            table[s][a] = (c + label, path, False)
                    if s == a and self.costs["merge"] + label < table[s][a][0]:
                        table[s][a] = (self.costs["merge"] + label, (), True)
            self.moves[role] = table, np.array([[x[0] for x in r] for r in table], np.int64)
        return self.moves[role]

    def matrix(self, roles) -> np.ndarray:
        """Least cost of all turns from each state to each."""
        out = np.where(np.eye(len(STATES), dtype=bool), 0, _BIG)
        for r in roles:
            out = np.minimum((out[:, :, None] + self.move(r)[1][None]).min(axis=1), _BIG)
        return out

    def close(self, state: int):
        """Cost and empty turns from a state to a legal end."""
        return min((self.way[state][e] for e in self.ends), key=lambda w: w[0])

    def repair(self, roles, entry: int = 0, leave: int | None = None):
        """(cost, [(role, empty turns before, merged)]) for the turns, from state `entry` to state
        `leave`, or else to the best end. Of equal costs the first state wins."""
        best, back = [0 if s == entry else _BIG for s in range(len(STATES))], []
        for r in roles:
            costs = np.array(best)[:, None] + self.move(r)[1]
            back.append(costs.argmin(axis=0).tolist())
            best = np.minimum(costs.min(axis=0), _BIG).tolist()
        s = leave
        if leave is None:
            s = min(range(len(STATES)), key=lambda x: best[x] + self.close(x)[0]) if roles else entry
        cost, out = best[s], []
        for r, b in zip(reversed(roles), reversed(back)):
            out.append((s, *self.move(r)[0][b[s]][s][1:]))
            s = b[s]
        return cost, out[::-1]


def _safe(text) -> str:
    return (text or "").replace("<|im_", "< |im_")


def render(auto: Automaton, turns, entry: int, leave: int | None, last: bool):
    """Text of the repaired turns and counts: cost, turns, merged, relabelled, inserted. A piece
    leaves its last turn open for what follows to be merged with, unless it is the last."""
    roles = [auto.role(t["role"]) for t in turns]
    cost, steps = auto.repair(roles, entry, leave)
    parts, is_open = [], entry > 0
    count = [0, 0, 0, 0]

    def begin(role):
        nonlocal is_open
        parts.append(("<|im_end|>\n" if is_open else "") + f"<|im_start|>{STATES[role]}\n")
        is_open = True
        count[0] += 1

    state = entry
    for t, r, (a, empty, merged) in zip(turns, roles, steps):
        for e in empty:
            begin(e)
            count[3] += 1
        if merged:
            parts.append("\n")
            count[1] += 1
        else:
            begin(a)
        count[2] += a != r
        parts.append(_safe(t["text"]))
        state = a
    if last:
        more, empty = auto.close(state)
        cost += more
        for e in empty:
            begin(e)
            count[3] += 1
        parts.append("<|im_end|>\n" if is_open else "")
    return "".join(parts), cost, *count


_TURNS = "array<struct<role:string,text:string>>"


def _fragments(limit: int):
    """Rows of a sorted partition as fragments (conversation, partition, number, turns): what the
    partition has of a conversation, `limit` turns at a time."""

    def run(batches):
        from pyspark import TaskContext

        part, number, key, turns, size = TaskContext.get().partitionId(), 0, None, [], 0
        out = []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([part] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))], ["conv_id", "part", "number", "turns"])
            out.clear()
            return batch

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if turns and (conv != key or len(turns) >= limit):
                    out.append((key, number, turns))
                    number, turns = number + 1, []
                    if size > 4_000_000 or len(out) >= 4096:
                        yield flush()
                        size = 0
                key = conv
                turns.append({"role": role, "text": text})
                size += len(text or "")
        if turns:
            out.append((key, number, turns))
        yield flush()

    return run


def _rendered(auto: Automaton):
    def run(batches):
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            got = [render(auto, t, s, e, z) for t, s, e, z in zip(cols["turns"], cols["entry"], cols["leave"], cols["last"])]
            names = ["rendered", "cost", "n_turns", "n_merged", "n_relabelled", "n_inserted"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("piece"), pa.array([len(t) for t in cols["turns"]], pa.int64()), *(pa.array([g[i] for g in got], pa.string() if not i else pa.int64()) for i in range(6))],
                ["conv_id", "piece", "n_source", *names],
            )

    return run


def _matrices(auto: Automaton):
    def run(batches):
        for batch in batches:
            m = [auto.matrix([auto.role(t["role"]) for t in turns]).reshape(-1) for turns in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), pa.array(m, pa.list_(pa.int64()))], ["conv_id", "piece", "matrix"])

    return run


def _chain(auto: Automaton):
    """States between the pieces of one conversation, from their cost matrices alone."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("piece", "ascending")])
        n = len(STATES)
        best, back = np.array([0] + [_BIG] * (n - 1)), []
        for m in table.column("matrix").to_pylist():
            costs = best[:, None] + np.array(m).reshape(n, n)
            back.append(costs.argmin(axis=0))
            best = np.minimum(costs.min(axis=0), _BIG)
        s = min(range(n), key=lambda x: best[x] + auto.close(x)[0])
        leave, entry = [], []
        for b in reversed(back):
            leave.append(s)
            s = int(b[s])
            entry.append(s)
        k = len(back)
        return pa.table({"c": table.column("conv_id"), "p": table.column("piece"), "entry": pa.array(entry[::-1], pa.int32()), "leave": pa.array(leave[::-1], pa.int32()), "last": [i == k - 1 for i in range(k)]})

    return run


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE, auto: Automaton | None = None) -> DataFrame:
    """conv_id, piece, n_source, rendered, cost, n_turns, n_merged, n_relabelled and n_inserted.

    For each conversation the repair of least cost makes its turns legal: turns are merged with
    the one before, given another role, or preceded by empty turns. A conversation of up to `piece`
    turns is one row; a longer one, which no single task may have to hold, has a row for every
    `piece` turns, and its text is theirs joined in order. Which turns a row has depends on the
    turns' order alone, so reruns and other partitionings agree.

    Turns are sorted by ranges over all conversations, so a conversation of any size is spread over
    tasks. Of those that more than one task has, or that are long, turns are numbered by counts per
    fragment and dealt to their pieces; the pieces of one conversation are joined by their cost
    matrices (one number for each two states), which give each piece the states that it begins and
    ends in. Costs are least in any case.

    Order: turn, null last, then role and text by hash. Null texts are empty; null and unknown
    roles take any role at a cost of their own. Rows without a conversation are one conversation.
    Conversations are numbers (cast to bigint). Markers inside texts are broken up. Repeated rows
    are turns of their own. Empty: no rows.
    """
    spark = turns.sparkSession
    scratch, auto = Scratch(spark), auto or Automaton()
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    # rows that agree in all but `tie` are equal, so it only spreads them over ranges
    keys = [F.col("conv_id"), F.col("turn").isNull(), F.col("turn"), F.xxhash64("role", "text"), F.col("tie")]
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    cut = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "role", "text")
    cut = scratch.save(cut.mapInArrow(_fragments(piece), f"conv_id bigint, part int, number bigint, turns {_TURNS}"))
    many = small(scratch.save(cut.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("k"))))
    same = F.col("conv_id").eqNullSafe(F.col("k"))
    whole = cut.join(many, same, "left_anti").select("conv_id", F.lit(0).cast("long").alias("piece"), "turns", F.lit(0).alias("entry"), F.lit(None).cast("int").alias("leave"), F.lit(True).alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    place = cut.join(many, same, "left_semi")
    offset = place.select("conv_id", "part", "number", F.size("turns").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    offset = offset.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("number").alias("q"), "offset")
    place = place.join(offset, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("number") == F.col("q")))
    each = place.select("conv_id", "offset", F.posexplode("turns").alias("pos", "turn")).select("conv_id", (F.col("offset") + F.col("pos")).alias("at"), "turn")
    each = each.groupBy("conv_id", F.floor(F.col("at") / F.lit(piece)).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("at", "turn"))).alias("turns"))
    parts = scratch.save(each.select("conv_id", "piece", F.transform("turns", lambda t: t["turn"]).alias("turns")))
    states = parts.mapInArrow(_matrices(auto), "conv_id bigint, piece bigint, matrix array<bigint>").groupBy("conv_id").applyInArrow(_chain(auto), "c bigint, p bigint, entry int, leave int, last boolean")
    parts = parts.join(states, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")))
    every = whole.unionByName(parts.select(*whole.columns))
    return every.mapInArrow(_rendered(auto), "conv_id bigint, piece bigint, n_source bigint, rendered string, cost bigint, n_turns bigint, n_merged bigint, n_relabelled bigint, n_inserted bigint")


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
