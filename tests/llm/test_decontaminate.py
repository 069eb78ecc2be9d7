import hashlib
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import decontaminate as D
from tidemark.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, n_hit string"  # a column that clashes with a result's


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n=13):
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for k, it in items:
            v = words(it)
            size = min(n, len(v))
            windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if size else set()
            for i in range(len(w) - size + 1) if size else []:
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    ids.add("" if k is None else str(k))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "É", "cd", "a1", "x", "Zz"])
    item = lambda n: " ".join(word() for _ in range(n))
    items = [(1, item(30)), (2, item(4).upper()), (3, item(13)), (None, item(16)), (1, item(20)), (5, ""), (6, None), (7, "!!")]
    docs = [(i, item(rng.randint(0, 60)) + ", " + rng.choice(items)[1].__str__() + " - " + item(9)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), (None, items[0][1]), (103, items[0][1]), (103, items[0][1]), (104, "qq " * 30_000 + items[3][1])]
    return docs, items


def query(spark, docs, items, path, **more):
    spark.createDataFrame([(*d, "x") for d in docs], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return sorted((tuple(r) for r in QUERIES["op2_decontaminate"](spark, str(path)).collect()), key=str)


def test_query_is_brute_force(spark, tmp_path):
    docs, items = made(1)
    assert query(spark, docs, items, tmp_path) == brute(docs, items)


def test_many_blocks_give_the_same(spark):
    docs, items = made(2)
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    pick = lambda x: sorted((tuple(r) for r in x.select("doc_id", "__tm_words", D.hits(), F.size("__tm_items")).collect()), key=str)
    assert pick(D.find(df, it, block_words=8)) == pick(D.find(df, it))


def test_empty_tables(spark, tmp_path):
    docs, items = made(3)
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    assert query(spark, [], items, tmp_path / "a") == []
    assert query(spark, docs, [], tmp_path / "b") == brute(docs, [])


def test_spans_are_cut(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(13)))], "item_id int, text string")
    passage = " ".join(f"W{i}" for i in range(13))
    text = "é " * 400 + passage + " end."
    docs = spark.createDataFrame([(1, text), (2, passage), (3, "clean")], "doc_id int, text string")
    out = {r.doc_id: r.text for r in D.decontaminate(docs, items, max_span=13).collect()}
    assert out == {1: "é " * 400 + " end.", 3: "clean"}
    assert {r.doc_id: r.text for r in D.decontaminate(docs, items).collect()} == {1: text, 3: "clean"}
