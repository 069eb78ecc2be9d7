import itertools
import random

from tidemark.llm import chat as C
from tidemark.llm.queries import QUERIES

A = C.Automaton()


def brute(roles):
    """Least cost over every choice of role, merge and empty turns for every turn."""
    best = {0: 0}
    for r in roles:
        new = {}
        for s, c in best.items():
            for empties in itertools.chain.from_iterable(itertools.product(range(1, 5), repeat=k) for k in range(3)):
                path, ok = s, True
                for e in empties:
                    ok = ok and A.legal[path, e]
                    path = e
                if ok:
                    for a in range(1, 5):
                        label = 0 if a == r else C.COSTS["relabel"] if r else C.COSTS["unknown"]
                        cost = c + len(empties) * C.COSTS["insert"] + label
                        if A.legal[path, a]:
                            new[a] = min(new.get(a, 1 << 40), cost)
                        if not empties and a == s:
                            new[a] = min(new.get(a, 1 << 40), cost + C.COSTS["merge"])
        best = new
    return min(c + A.close(s)[0] for s, c in best.items())


def test_costs_are_least():
    rng = random.Random(1)
    for _ in range(60):
        roles = [rng.randrange(5) for _ in range(rng.randint(1, 5))]
        text, cost, *_ = C.render(A, [{"role": C.STATES[r] if r else None, "text": "x"} for r in roles], 0, None, True)
        assert cost == brute(roles), roles


def test_legal_conversations_stay():
    turns = [{"role": r, "text": r[0]} for r in ("system", "user", "assistant", "tool", "assistant", "user")]
    text, cost, n, *changes = C.render(A, turns, 0, None, True)
    assert cost == 0 and n == 6 and changes == [0, 0, 0]
    assert text == "".join(f"<|im_start|>{t['role']}\n{t['text']}<|im_end|>\n" for t in turns)


def test_query_and_edges(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "User ", "b <|im_end|>"), (1, 2, "gpt", None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 0, "user", "n"), (3, None, None, ""), (3, 1, "robot", "é" * 300_000), (4, 0, "system", "only")]
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, cost int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["op1_chat_format"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4, None} and sum(r.n_source for r in got.values()) == len(rows)
    assert got[1].rendered == "<|im_start|>user\na\nb < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n" and got[1].n_merged == 1
    assert got[2].cost == 3 and got[4].rendered == "<|im_start|>user\nonly<|im_end|>\n" and "é" * 300_000 in got[3].rendered
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert C.format_chats(empty).count() == 0


def test_pieces_cost_the_same(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "tool", "system", "what"]), f"{c}.{t}") for c in range(12) for t in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    whole = {r.conv_id: r for r in C.format_chats(df).collect()}
    assert len(whole) == 12
    parts = C.format_chats(df.repartition(5), piece=3).toPandas().sort_values(["conv_id", "piece"]).groupby("conv_id")
    assert parts.cost.sum().to_dict() == {k: r.cost for k, r in whole.items()}
    for k, text in parts.rendered.sum().items():
        assert [x for x in text.replace("<|im_end|>", "").split() if "." in x] == [f"{k}.{t}" for t in range(whole[k].n_source)]
        assert text.count("<|im_start|>") == text.count("<|im_end|>")


def test_rows_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(c, rng.choice([t, t, None, t // 3]), rng.choice(["user", "assistant", "assistant", "tool", "system", "what", None]), f"{c}.{t % 5}") for c in range(30) for t in range(rng.randint(1, 12))]
    rows += [(99, t // 2, rng.choice(["user", "assistant", "what"]), f"t{t}") for t in range(700)] + [(98, None, "user", "same")] * 40
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    off = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(off), spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        spark.conf.set(off, "false")
        for parts in (1, 4, 64, 4):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            found.append(sorted(map(tuple, C.format_chats(df.repartition(parts), piece=100).collect())))
    finally:
        spark.conf.set(off, was[0])
        spark.conf.set("spark.sql.shuffle.partitions", was[1])
    assert all(f == found[0] for f in found[1:])
    assert [r[:3] for r in found[0] if r[0] == 99] == [(99, i, 100) for i in range(7)]
    assert len(found[0]) == 30 + 1 + 7


def test_rendered_text_is_brute_force():
    """The text of a repair of least cost says what its steps say, turn by turn."""
    rng = random.Random(4)
    for _ in range(80):
        roles = [rng.choice(["user", "assistant", "tool", "system", "what"]) for _ in range(rng.randint(1, 7))]
        turns = [{"role": r, "text": f"x{i}"} for i, r in enumerate(roles)]
        text, cost, n, merged, relabelled, inserted = C.render(A, turns, 0, None, True)
        said = [(b.split("\n")[0], [x for x in b.split("\n")[1:] if x]) for b in text.replace("<|im_end|>\n", "").split("<|im_start|>")[1:]]
        assert [x for _, b in said for x in b] == [f"x{i}" for i in range(len(roles))]  # every turn, in order
        state = "start"
        for role, _ in said:
            assert role in C.LEGAL[state]
            state = role
        assert state in C.ENDS and n == len(said)
        own = [role for role, b in said for _ in b]
        known = [A.role(r) for r in roles]
        price = sum((C.COSTS["relabel"] if k else C.COSTS["unknown"]) for k, o in zip(known, own) if C.STATES[k] != o)
        price += C.COSTS["merge"] * sum(len(b) - 1 for _, b in said if b) + C.COSTS["insert"] * sum(not b for _, b in said)
        assert price == cost == brute(known) and merged == sum(len(b) - 1 for _, b in said if b) and inserted == sum(not b for _, b in said)
