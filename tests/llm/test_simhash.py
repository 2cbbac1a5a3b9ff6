import random

import xxhash
from pyspark.sql import functions as F

from lexibrook.llm import simhash


def brute(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, near):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


def test_masks_cover_every_triple():
    rng = random.Random(1)
    for level in simhash.mask_tree():
        for row in [level[0], level[-1]]:
            common = -1
            for m in row:
                common &= m
            free = [b for b in range(64) if not common >> b & 1]
            for _ in range(2000):
                gone = sum(1 << b for b in rng.sample(free, 3))
                assert any(not m & gone for m in row)
    assert max(64 - m.bit_count() for row in simhash.mask_tree()[-1] for m in row) <= 10


def test_fingerprints_and_components_match_brute_force(spark):
    rng, texts = random.Random(2), [None, "", " \t", "a", "A", "a b", "É é b c", "x" * 50000, " ".join(["w"] * 20000)]
    base = " ".join(rng.choice("abcdefghij") * 3 for _ in range(300))
    for _ in range(60):
        w = base.split()
        w[rng.randrange(300)] = "z"
        texts.append(" ".join(w))
    rows = [(i * 3, t, "s", i) for i, t in enumerate(texts)] + [(3, "", "s", 0), (None, "a", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {r[0]: brute(r[1]) for r in rows if r[0] is not None}
    want = classes(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    for r in got:
        if r.doc_id is not None:
            assert (r.fp % 2**64, r.component_id) == (fps[r.doc_id], want[r.doc_id])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted(set(want.values())) and ids.count(None) == 1


def test_hot_buckets_are_covered_anew(spark):
    rng, centre = random.Random(3), 0x0123456789ABCDEF
    fps = {centre}
    while len(fps) < 900:
        x = centre
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    got = {r.node % 2**64: r.component % 2**64 for r in simhash.components(simhash.links(df)).collect()}
    want = classes(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    part = {}
    for x in fps:
        part.setdefault(got.get(x, x), set()).add(want[x])
    assert all(len(v) == 1 for v in part.values()) and len(part) == len(set(want.values()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def test_chain_is_one_component(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in simhash.components(edges).collect()} == {0}


def test_each_group_keeps_a_row_where_doc_ids_are_repeated_or_null(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(str(rng.random()) for _ in range(50)) for _ in range(4))
    rows = [(3, a, 0)] + [(5, t, k) for k in range(4) for t in (a, b)] + [(5, b, 0), (None, c, 1), (None, c, 1), (None, c, 2), (None, d, 1), (7, d, 1)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(3, a), (5, b), (0, c), (0, d), (7, d)])


def test_exploded_rows_are_never_broadcast(spark):
    fps = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(v) for v in range(15)])).alias("t"))
    full = keyed.groupBy("t").agg(F.count("*").alias("n"))
    out = simhash.spread_join(keyed, full, ["t"], F.xxhash64("fp"))
    assert out.count() == 30000
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
