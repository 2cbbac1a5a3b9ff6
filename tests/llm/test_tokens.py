import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexibrook.llm import packing, rans, tokens

TRICKY = [
    None, "", " ", "\n\n", "  a  b", "it's IT'S 'sa ''s !'s 's's", "a\t\n b\r\n\r\nc ", "Éléphant ÀÖØÞß ÿ×÷ª", "œuvre Œ €5 — ²³ ½ 12345 1a2b", "日本語 text", "x" * 3000,
    "<|endoftext|> <|startoftext|> </w>", "é İ K", "\x85\xa0\x1c\x00 a", "don't we'll they've I'd I'm you're", "foo_bar __init__ @#$%^&*() ...", "   \n  x", "\x0b\x0c v",
    "a <|endoftext|> b", "a<|endoftext|>b", "a <|ENDOFTEXT|> b", "<|startoftext|>", "<|endof text|>", "<|endoftext|", "<|endoftext|><|endoftext|>  ", "日 <|endoftext|> 本",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(spark, name):
    path = tokens.vocabulary_path(name)
    library, enc, rng = Tokenizer.from_file(path), tokens.Encoder(path), random.Random(1)
    assert enc.merge != enc.slow
    alphabet = "abcdeABCDE  \n\t'slvremtd!?-.,0123éÉßÿÀ\r"
    texts = TRICKY + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts += [" ".join(rng.choice(["a", "\n", "b\n\n", "\nc", "é,", "'s", "\t", "", "\r\n", "x.\ny"]) for _ in range(rng.randrange(9))) for _ in range(1500)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts:
        assert enc.ids(t, 7).tolist() == library.encode(t or "", add_special_tokens=False).ids + [7], t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_tokens_as_text(name):
    path = tokens.vocabulary_path(name)
    library, enc = Tokenizer.from_file(path), tokens.Encoder(path, special_as_text=True)
    library.encode_special_tokens = True
    for t in TRICKY:
        assert enc.ids(t, 7).tolist() == library.encode(t or "", add_special_tokens=False).ids + [7], t


def test_other_ways_of_cutting_are_left_to_the_library(tmp_path):
    with open(tokens.vocabulary_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "Lowercase"}
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    library, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    assert not enc.known
    for t in TRICKY:
        assert enc.ids(t, 7).tolist() == library.encode(t or "", add_special_tokens=False).ids + [7], t


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    enc = tokens.Encoder(tokens.vocabulary_path("byte_bpe_50k.json"))
    for k in range(40):
        enc.ids(f"w{k} x{k} y{k}", 0)
    assert len(enc.words) + len(enc.runs) <= 5 + 10


def test_packing_places_every_piece_once(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(["word"] * int(rng.paretovariate(1) * 40)), "x") for i in range(700)] + [(None, None, "x"), (5, "", "x"), (5, "", "x")] + [(10_000 + i, "same", "x") for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id long, text string, offset string")
    path = tokens.vocabulary_path("word_bpe_49k.json")
    from lexibrook.llm.common import saved

    got = packing.pack(saved(packing.pieces(df, path), "t")).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    total = 0
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
        total += at
    enc = tokens.Encoder(path)
    assert total == sum(len(enc.ids(t, 1)) for _, t, _ in docs)
    assert len(by) <= -(-total // 4096) + 1
    for r in got:
        assert r.start == 4096 * r.piece
    want = [(d, k, tokens.crc(ids[4096 * k : 4096 * k + 4096])) for d, t, _ in docs for ids in [enc.ids(t, 1)] for k in range(-(-len(ids) // 4096))]
    known = lambda rows: sorted(rows, key=str)
    assert known((r.doc_id, r.piece, r.ids_crc32) for r in got) == known(want)
    assert packing.pack(saved(packing.pieces(df.limit(0), path), "t")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_the_histogram_exactly(seed):
    rng = random.Random(seed)
    histogram = {n: rng.randrange(1, [2, 5, 500, 40][seed]) for n in rng.sample(range(1, 4097), [20, 400, 900, 3000][seed])}
    configs, held = packing.plan(histogram), {}
    for contents, n in configs:
        assert n > 0 and sum(contents) <= 4096
        for x in contents:
            held[x] = held.get(x, 0) + n
    assert held == histogram
    least = -(-sum(n * c for n, c in histogram.items()) // 4096)
    assert sum(n for _, n in configs) <= max(least * 1.03 + 2, sum(c for n, c in histogram.items() if n > 2048) + 1)


def test_the_program_places_nearly_all_pieces_of_a_real_table(spark):
    """The histogram of sf0.1: fractional counts within 1 % of what the tokens need, at least 90 % of the pieces placed by configurations,
    and no more sequences than the tokens need."""
    from lexibrook.llm.common import saved

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    cut = saved(packing.pieces(docs, tokens.vocabulary_path("word_bpe_49k.json")), "t")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    need = sum(n * c for n, c in histogram.items()) / packing.CAPACITY
    x = packing.solve(histogram)
    assert sum(x.values()) <= 1.01 * need
    covered = {}
    for config, n in x.items():
        assert sum(config) <= packing.CAPACITY
        for m in config:
            covered[m] = covered.get(m, 0) + n
    assert all(abs(covered[m] - c) < 1e-6 * c for m, c in histogram.items())
    placed, left = packing.programmed(histogram)
    assert sum(left.values()) <= 0.1 * sum(histogram.values())
    assert sum(n for _, n in placed + packing.best_fit(left)) == -(-sum(n * c for n, c in histogram.items()) // packing.CAPACITY)


def test_one_length_and_one_doc_id_everywhere(spark):
    from lexibrook.llm.common import saved

    df = spark.createDataFrame([(7, "the same words", k) for k in range(5000)], "doc_id long, text string, task int").repartition(5)
    cut = saved(packing.pieces(df, tokens.vocabulary_path("word_bpe_49k.json")), "t")
    got = packing.pack(cut).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 5000 and len({r.sequence_id for r in got}) == -(-5000 // (4096 // got[0].length))


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 70_001])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 65_535).astype(np.uint32)
    counts = np.bincount(ids, minlength=1 << 16)
    coder = rans.Coder(rans.scaled(counts))
    assert n == 0 or coder.freq.sum() == 1 << rans.BITS
    if n:
        data = coder.encode(ids)
        assert (coder.decode(data, n) == ids).all()


def test_single_symbol_and_files(spark, monkeypatch):
    ids = np.zeros(5000, np.uint32)
    coder = rans.Coder(rans.scaled(np.bincount(ids, minlength=10)))
    assert (coder.decode(coder.encode(ids), 5000) == 0).all()
    docs = [(i, t, 1) for i, t in enumerate(TRICKY)] + [(None, "null id", 1), (3, "again", 1), (3, "again", 1), (99, "long " * 200_000, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, ids int")
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    from lexibrook.llm.common import saved, shared_dir

    folder = shared_dir(spark, "test-rans")
    rans.write_files(saved(rans.encoded(df, path), "t"), folder)
    got = sorted(rans.read_files(spark, folder).collect(), key=lambda r: r.start)
    enc, at = tokens.Encoder(path), 0
    want = sorted((-1 if d is None else d, tokens.crc(enc.ids(t, 0)), len(enc.ids(t, 0))) for d, t, _ in docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == want
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == [w[0] for w in want]
    for r in got:
        assert r.start == at
        at += r.n_tokens
    folder = shared_dir(spark, "test-rans")
    rans.write_files(saved(rans.encoded(df.limit(0), path), "t"), folder)
    assert rans.read_files(spark, folder).count() == 0


def test_documents_of_one_id_go_over_many_files(spark, monkeypatch):
    from lexibrook.llm import common

    monkeypatch.setattr(common, "LEAST_RANGE", 2000)
    docs = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k - 300, f"text number {k} " * 3) for k in range(600)]
    df, path = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), tokens.vocabulary_path("byte_bpe_50k.json")
    folder = common.shared_dir(spark, "test-rans")
    manifest = rans.write_files(common.saved(rans.encoded(df, path), "t"), folder).collect()
    assert len(manifest) > 5 and max(r["n_docs"] for r in manifest) < 200
    got, enc, at = sorted(rans.read_files(spark, folder).collect(), key=lambda r: r.start), tokens.Encoder(path), 0
    key = lambda d: -(1 << 63) if d is None else d
    assert [key(r.doc_id) for r in got] == sorted(key(d) for d, _ in docs)
    assert sorted((key(r.doc_id), r.ids_crc32) for r in got) == sorted((key(d), tokens.crc(enc.ids(t, 0))) for d, t in docs)
    for r in got:
        assert r.start == at
        at += r.n_tokens
