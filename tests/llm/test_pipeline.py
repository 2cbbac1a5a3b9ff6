from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from lexibrook.llm import langid, mixing, packing, tokens
from tests.llm.test_mixing import water
from tests.llm.test_simhash import brute, classes


FOREIGN = "det här är en svensk mening med flera ord som inte finns på engelska"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, "en", "src0", 0), (90_002, "123 ...", "en", None, 7), (90_003, "", None, "src1", 0), (90_004, FOREIGN, "en", "src1", 0)], docs.schema)
    docs = docs.unionByName(extra)
    rows = {r.doc_id: r for r in docs.collect()}
    (_, language), (_, dedup), (_, mix), (_, pack) = corpus_pipeline.STAGES

    one = language(spark, docs, "")
    assert one.columns == docs.columns
    kept = {d for d, r in rows.items() if any(c.isalpha() for c in r.text or "") and r.text != FOREIGN}  # that one by its prediction
    assert {r.doc_id for r in one.collect()} == kept

    two = dedup(spark, one, "")
    fps = {d: brute(rows[d].text) for d in kept}
    left = set(classes(sorted(kept), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3).values())
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == sorted(left)

    three = mix(spark, two, "")
    size, sources = {d: len(rows[d].text.split()) for d in left}, defaultdict(int)
    for d in left:
        sources[rows[d].source] += size[d]
    names = sorted(sources, key=lambda s: (s is None, s))
    taken, copies = Counter(), Counter(r.doc_id for r in three.collect())
    for d, n in copies.items():
        assert n <= mixing.LIMIT
        taken[rows[d].source] += n * size[d]
    most = {s: max(size[d] for d in left if rows[d].source == s) for s in names}
    for s, target in zip(names, water([sources[s] for s in names])):
        assert abs(taken[s] - target) <= 2 * most[s]

    last = pack(spark, three, "").collect()
    enc = tokens.Encoder(tokens.vocabulary_path("word_bpe_49k.json"))
    want = Counter({d: n * len(enc.ids(rows[d].text, packing.END)) for d, n in copies.items()})
    got = Counter()
    for r in last:
        got[r.doc_id] += r.length
    assert got == want


def test_run_is_registered_and_whole(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_clashing_columns_go_through_all_stages(spark):
    names = ["task", "nth", "rank", "component", "fp", "row", "score", "lang_pred", "size", "target", "copies", "bin", "part", "r", "length", "id", "h"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        more = stage(spark, more, "")
        assert more.columns == docs.columns + names and more.select(*names).distinct().collect() == [tuple(range(len(names)))]
    assert corpus_pipeline.STAGES[-1][1](spark, more, "").count() > 100


def test_nothing_left(spark):
    docs = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


assert langid.UNKNOWN == "und"
