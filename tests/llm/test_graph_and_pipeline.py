import random
import zlib

import corpus_pipeline
from test_classifiers import EDGES, corpus
from test_decontaminate import brute as contaminated
from test_jaccard import brute as groups

from tidemark.llm.graph import components
from tidemark.llm.quality import good_share
from tidemark.llm.store import Scratch


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(3, 3), (None, 4), (7, None), (9, 8), (8, 9)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark)).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u bigint, v bigint"), Scratch(spark)).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs, labels = corpus(400)
    item = " ".join(f"bench{i}" for i in range(20))
    docs += [(2004, " ".join(t for i, t in docs[:60] if i % 7 and i % 5) + " " + item), (2000, docs[1][1] + " extra"), (2001, docs[1][1]), (2002, " ".join(docs[2][1].split()[::-1]) + " " + item), (2003, docs[3][1] * 30 + " " + item), *[e for e in EDGES if e[0] != 9004]]
    rows = [(d, t, "en", f"s{(d or 0) % 3}" if d != 9001 else None, len(t or ""), "more") for d, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, __extra string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf, now = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, kept, first = [n for n, _ in corpus_pipeline.STAGES], {}, now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        if k < 4:
            assert out.columns == first
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = sorted(((r.doc_id, r.text) for r in now.select("doc_id", "text").collect()), key=str)
    clean = {i for i, _ in docs if i is not None and i < 400 and i % 7 and i % 5}
    assert names == ["quality", "toxicity", "near_duplicates", "contamination", "mixture"]
    told = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5]
    k = round(len(docs) * good_share(sum(q for _, q in told), len(told)))  # a share: a little more than the good ones
    assert clean <= {d for d, _ in kept["quality"]} and len(kept["quality"]) == k
    assert sum(d % 7 == 0 for d, _ in kept["quality"] if d and d < 400) <= k - sum(i % 7 > 0 for i, _ in docs[:400])
    assert clean <= {d for d, _ in kept["toxicity"]}
    want = {c for d, n, c in groups(kept["toxicity"]) if n and d is not None}
    words = lambda t: bool((t or "").split())
    assert {d for d, t in kept["near_duplicates"] if d is not None and words(t)} == want
    bad = {r[0] for r in contaminated(kept["near_duplicates"], [(1, item)]) if r[-1]}
    assert bad == {2002} and {d for d, _ in kept["contamination"]} == {d for d, _ in kept["near_duplicates"]} - bad
    assert 2004 in {d for d, _ in kept["contamination"]} and not any(item in (t or "") for _, t in kept["contamination"])
    assert all(t == dict(kept["near_duplicates"])[d] for d, t in kept["contamination"] if d not in (2003, 2004, None, 9003))
    mix = now.toPandas()
    assert (mix.taken > 0).all() and all(abs(g.taken.sum() - g.target.iloc[0]) < 1 for _, g in mix.groupby(mix.source.fillna("-")))
    assert corpus_pipeline.run(spark, sf).count() == len(mix)
