"""Literal cases of every operator, on small inputs."""

import math
import os
import random
import struct
import zlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lexibrook.__main__ import main
from lexibrook.engine import Engine, NoDocuments
from lexibrook.functions import text as tx
from lexibrook.operators import consistency, search
from lexibrook.operators import index as ix
from lexibrook.plans import storage
from lexibrook.plans.catalogue import QUERIES
from lexibrook.sources import files, records
from lexibrook.streaming.ingest import ingest

FIVE = {1: "python search", 2: "storage basics", 4: "python storage search", 7: "search engine", 9: "python language"}


def docs_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


@pytest.fixture(scope="module")
def five(spark):
    docs = docs_of(spark, FIVE).cache()
    return docs, ix.postings(docs).cache()


def ids(df):
    return sorted(r.doc_id for r in df.collect())


TOKENS = {
    "HELLO WORLD": "hello world", "Python, Storage & Search!": "python storage search", "Hello... (world)? [test]! {again}": "hello world test again", "one   two\t\tthree\n\nfour": "one two three four",
    "order 123 item 456": "order 123 item 456", "": "", "!!! ??? --- ...": "", "Héllo Wörld — Café": "héllo wörld café", "Straße, München ✓ 42": "straße münchen 42", "python 🚀 storage": "python storage",
    "PYTHON ΣΤΟΡΑΓΕ": "python στοραγε", "the quick brown fox jumps over the lazy dog": "quick brown fox jumps over lazy dog", "the and of to a an": "", "python is great, and storage is fast": "python great storage fast",
    "İstanbul ΟΔΟΣ": "̇stanbul οδος".lstrip("̇"), "é x²": "e x²",
}


def test_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in TOKENS], "text string").select("text", tx.tokens(F.col("text")).alias("t")).collect()
    for r in rows:
        assert " ".join(r.t) == TOKENS[r.text] == " ".join(tx.query_terms(r.text)), r.text
    assert len(tx.STOPWORDS) == len(set(tx.STOPWORDS)) == 37
    for bad in (b"bytes", 5):
        with pytest.raises(TypeError):
            tx.query_terms(bad)
    with pytest.raises(TypeError):
        ix.postings(spark.createDataFrame([(1, 5)], "doc_id long, text int"))


def test_previews(spark):
    df = spark.createDataFrame([("a\x1c  b\n" + "🚀" * 100,), ("  short\t ",), ("x" * 68,)], "text string")
    got = [tuple(r) for r in df.select(tx.preview(F.col("text"), 4), tx.one_line(F.col("text"))).collect()]
    assert got[0] == ("a\x1c  ", "a b " + "🚀" * 64 + "...") and got[1][1] == "short" and got[2][1] == "x" * 68


def test_boolean_search(five):
    _, index = five
    cases = [("python", "and", [1, 4, 9]), ("python search", "and", [1, 4]), ("python storage search", "and", [4]), ("python missing", "and", []), ("missing python", "and", []), ("", "and", []), ("", "or", []), ("python python", "and", [1, 4, 9]), ("storage", "or", [2, 4]), ("python storage", "or", [1, 2, 4, 9]), ("missing search", "or", [1, 4, 7]), ("Python", "and", []), ("Python", "or", [])]
    for terms, mode, want in cases:
        assert ids(search.match(index, terms.split(), mode)) == want
    for query, want in [("Python, STORAGE & Search!", [4]), ("the python", [1, 4, 9]), ("the of and", []), ("", [])]:
        assert ids(search.search(index, query)) == want
    for f in (search.match, lambda i, t, m: search.search(i, " ".join(t), m)):
        with pytest.raises(ValueError):
            f(index, ["python"], "fuzzy")


def test_ranking(spark, five):
    docs, index = five
    terms = spark.createDataFrame([("python",), ("search",), ("engine",), ("missing",)], "term string")
    got = {r.term: (r.df, r.idf) for r in search.idf(index, search.count_documents(docs), terms).collect()}
    assert {k: v[0] for k, v in got.items()} == {"python": 3, "search": 3, "engine": 1, "missing": 0}
    assert math.isclose(got["python"][1], math.log(5 / 3)) and math.isclose(got["engine"][1], math.log(5)) and got["missing"][1] == 0.0
    scores = {r.doc_id: r.score for r in search.scored(docs, index, ["python", "storage", "search", "python"]).collect()}
    assert scores[4] == 1.937942
    order = lambda df: [r.doc_id for r in sorted(df.collect(), key=lambda r: r["rank"])]
    given = spark.createDataFrame([(1,), (4,), (9,)], "doc_id long")
    assert order(search.rank_documents(docs, index, given, ["python", "storage", "search"])) == [4, 1, 9]
    twice = spark.createDataFrame([(7,), (1,), (7,), (99,)], "doc_id long")
    assert order(search.rank_documents(docs, index, twice, ["python"])) == [1, 7, 7, 99]
    assert search.rank_documents(docs, index, given, []).count() == 0
    assert order(search.search_ranked(docs, index, "python search")) == [1, 4]
    assert order(search.search_ranked(docs, index, "storage engine", "or")) == [7, 2, 4]
    assert order(search.search_top(docs, index, "storage engine", "or", 2)) == [7, 2]
    assert search.search_ranked(docs, index, "the", "fuzzy").count() == 0
    with pytest.raises(ValueError):
        search.search_ranked(docs, index, "python", "fuzzy")
    one = docs_of(spark, {1: "python"})
    assert [(r.doc_id, r.score) for r in search.search_ranked(one, ix.postings(one), "python").collect()] == [(1, 0.0)]
    tie = docs_of(spark, {5: "python search", 2: "python search", 3: "other"})
    assert order(search.search_ranked(tie, ix.postings(tie), "python search")) == [2, 5]


def test_ranks_match_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10**6), rng.choice([0.0, 0.5, 1.25])) for _ in range(3000)]
    got = sorted(search.numbered(spark.createDataFrame(rows, "doc_id long, score double")).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 3001))
    assert [(r.doc_id, r.score) for r in got] == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_index(spark):
    docs = docs_of(spark, {1: "python is a great language", 2: "storage and search engines", 3: "python search engine storage", 4: "", 5: "python python python"})
    index = ix.postings(docs)
    assert ids(ix.term_documents(index, "python")) == [1, 3, 5] and ids(ix.term_documents(index, "engine")) == [3] and ids(ix.term_documents(index, "the")) == []
    assert ix.stats(docs, index).first().n_docs == 5
    probe = spark.createDataFrame([(5, "python"), (4, "python"), (9, "x")], "doc_id long, term string")
    assert {(r.doc_id, r.tf) for r in ix.token_frequencies(index, probe).collect()} == {(5, 3), (4, 0), (9, 0)}
    again = docs.withColumn("version", F.lit(1)).unionByName(docs_of(spark, {1: "other words"}).withColumn("version", F.lit(2)))
    assert ids(ix.term_documents(ix.postings(ix.newest(again)), "python")) == [3, 5]
    assert {r.term for r in ix.document_frequency(ix.without(index, docs.where("doc_id <> 2"))).collect()} == {"storage", "search", "engines"}
    empty = docs.where("false")
    assert ix.stats(empty, ix.postings(empty)).first().asDict() == {"n_docs": 0, "n_terms": 0}


STORED = {1: "python search", 2: "storage basics", 4: "python storage search"}


@pytest.mark.parametrize(
    ("drift", "want"),
    [
        ({}, {}),
        ({4: None}, {"missing_docs": 1, "missing_postings": 3}),
        ({9: "python newterm"}, {"extra_docs": 1, "extra_postings": 2, "extra_terms": 1}),
        ({4: "python storage"}, {"missing_postings": 1}),
        ({2: "storage basics search"}, {"extra_postings": 1}),
        ({1: "python", 2: "storage basics search"}, {"missing_postings": 1, "extra_postings": 1}),
        ({1: "python python search"}, {"tf_mismatches": 1}),
    ],
)
def test_consistency(spark, drift, want):
    docs = docs_of(spark, STORED)
    drifted = docs_of(spark, {k: v for k, v in {**STORED, **drift}.items() if v is not None})
    got = consistency.report(docs, ix.postings(drifted), drifted).first().asDict()
    counts = ("missing_docs", "extra_docs", "missing_postings", "extra_postings", "tf_mismatches", "extra_terms")
    assert {k: got[k] for k in counts if got[k]} == want and got["ok"] == (not want)
    assert got["storage_docs"] == 3


# records


def rec(doc_id, payload):
    body = struct.pack(">Q", doc_id) + payload
    return b"FG" + struct.pack(">II", len(payload), zlib.crc32(body)) + body


def test_codec(spark):
    for doc_id in (0, 1, 255, 256, 1000, 2**32 - 1, 2**64 - 1):
        for payload in (b"", b"a", "é🚀".encode(), bytes(256)):
            assert records.encode(doc_id, payload) == rec(doc_id, payload)
            assert records.decode(rec(doc_id, payload)) == (doc_id, payload)
    for bad in (-1, 2**64):
        with pytest.raises(records.InvalidDocumentId):
            records.encode(bad, b"")
    whole = rec(7, b"hello")
    for data, error in [(whole[:17], records.IncompleteRecord), (b"XX" + whole[2:], records.BadMagic), (whole[:-1], records.BadLength), (whole[:-1] + b"!", records.BadChecksum), (whole[:6] + b"\0\0\0\0" + whole[10:], records.BadChecksum)]:
        with pytest.raises(error):
            records.decode(data)
    df = spark.createDataFrame([(7, b"hello"), (2**62, b""), (3, bytes(300))], "doc_id long, payload binary")
    for r in df.select("*", records.encoded(F.col("doc_id"), F.col("payload")).alias("r")).collect():
        assert bytes(r.r) == rec(r.doc_id, bytes(r.payload))
    rows = [whole, rec(2**64 - 1, b"x"), whole[:17], b"XX" + whole[2:], whole[:-1], whole[:-1] + b"!", b""]
    got = spark.createDataFrame([(bytearray(x),) for x in rows], "r binary").select(records.fields(F.col("r")).alias("f")).collect()
    assert [r.f.error for r in got] == [None, None, "incomplete", "magic", "length", "checksum", "incomplete"]
    assert int(got[1].f.doc_id) == 2**64 - 1 and bytes(got[0].f.payload) == b"hello"


A, B, C = rec(1, b"first"), rec(2, b""), rec(3, b"third")
FILES = {
    "clean": (A + B + C, 3, "ok", len(A + B + C)), "empty": (b"", 0, "ok", 0), "magic_only": (b"FG", 0, "incomplete_tail", 0), "torn": (A + B[:12], 1, "incomplete_tail", len(A)),
    "garbage": (b"this is not a record at all", 0, "corruption", 0), "short_garbage": (A + b"garbage", 1, "incomplete_tail", len(A)), "flipped": (A[:-1] + b"!", 0, "corruption", 0),
    "overlong": (b"FG\x7f\xff\xff\xff" + A[6:], 0, "incomplete_tail", 0), "middle": (A + B[:-1] + b"\xff" + C, 1, "corruption", len(A)),
}


def test_scan_classes_and_truncation(spark, tmp_path):
    for name, (data, *_) in FILES.items():
        (tmp_path / name).write_bytes(data)
    scanned = records.read_records(spark, str(tmp_path))
    got = {os.path.basename(r.path): r for r in records.status(scanned).collect()}
    for name, (data, n, status, good) in FILES.items():
        r = got[name]
        assert (r.n_valid, r.status, r.good_offset, r.total) == (n, status, good, len(data)), name
        assert records.truncate_tail(str(tmp_path / name), r.good_offset) == len(data) - good
        assert (tmp_path / name).read_bytes() == data[:good]
        assert records.truncate_tail(str(tmp_path / name), good + 5) == 0
    assert records.read_records(spark, str(tmp_path / "nothing")).count() == 0
    assert {r.status for r in records.status(records.read_records(spark, str(tmp_path))).collect()} == {"ok"}


def test_append_is_read_back(spark, tmp_path):
    at = str(tmp_path / "log")
    for part in ([(1, b"a"), (2**63 - 1, b"")], [(5, bytes(1000))]):
        records.append_records(spark.createDataFrame(part, "doc_id long, payload binary"), at)
    got = {int(r.doc_id): bytes(r.payload) for r in records.valid(records.read_records(spark, at)).collect()}
    assert got == {1: b"a", 2**63 - 1: b"", 5: bytes(1000)}


def test_replay_and_guard(spark):
    log = spark.createDataFrame([(0, "a", 0), (1, "b", 10), (1, "later", 20), (2, "c", 30)], "doc_id long, text string, offset long")
    stored = docs_of(spark, {0: "a"})
    new = storage.replay(log, stored)
    assert sorted((r.doc_id, r.text) for r in new.collect()) == [(1, "b"), (2, "c")]
    assert storage.replay_report(log, stored).first().asDict() == {"examined": 4, "recovered": 2, "skipped": 2}
    after = stored.unionByName(new.select("doc_id", "text"))
    assert storage.replay_report(log, after).first().asDict() == {"examined": 4, "recovered": 0, "skipped": 4}
    assert ids(storage.missing_from_storage(log, stored)) == [1, 2] and storage.missing_from_storage(log, after).count() == 0
    for incoming in ({0: "x"},):
        with pytest.raises(storage.DuplicateDocument):
            storage.guarded(docs_of(spark, incoming), stored)
    twice = docs_of(spark, {5: "x"})
    with pytest.raises(storage.DuplicateDocument):
        storage.guarded(twice.union(twice), stored)
    new_ids = storage.next_ids(spark.createDataFrame([(7,), (70_000,), (3,)], "k long"), stored.where("false"), "k")
    assert sorted((r.new_id, r.k) for r in new_ids.collect()) == [(1, 3), (2, 7), (3, 70_000)]


def test_scores_are_shown_as_summed(spark):
    """df = 201 of 1,000: ln(1000 / 201) = 1.6044503..., which rounds to 1.60445 first and would then be cut to 1.6044."""
    docs = spark.range(1000).selectExpr("id AS doc_id", "IF(id < 201, 'rare word', 'word') AS text")
    row = search.search_ranked(docs, ix.postings(docs), "rare", "or", exact=True).select("score", F.format_string("%.4f", "exact").alias("t")).first()
    assert (row.score, row.t) == (1.60445, "1.6045") and f"{math.log(1000 / 201):.4f}" == "1.6045"


def test_nulls_empty_tables_and_clashing_columns(spark):
    names = ["term", "tf", "rank", "preview", "score", "exact", "_span", "_words", "_at", "_p", "n", "idf", "m", "kind"]
    docs = docs_of(spark, {1: "python search", 2: None, 3: "", 4: "the of"})
    more = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    index = ix.postings(more)
    assert sorted(map(tuple, index.collect())) == [("python", 1, 1), ("search", 1, 1)]
    assert ix.stats(more, index).first().asDict() == {"n_docs": 4, "n_terms": 2}
    assert [tuple(r) for r in search.search_ranked(more, index, "python").collect()] == [(1, 1, round(math.log(4), 6))]
    assert [tuple(r) for r in search.hydrate(search.match(index, ["python"]), more, 3).collect()] == [(1, "pyt")]
    assert consistency.report(more, index, more).first().ok
    assert sorted((r.doc_id, r.size, r.offset) for r in records.offsets(more).collect()) == [(1, 31, 0), (2, 18, 31), (3, 18, 49), (4, 24, 67)]
    none = more.where("false")
    nothing = ix.postings(none)
    assert search.search_ranked(none, nothing, "python", "or").count() == 0 and search.search_top(none, nothing, "python").count() == 0
    assert search.rank_documents(none, nothing, docs.select("doc_id"), ["python"]).where("score = 0").count() == 4
    assert consistency.report(none, nothing, none).first().ok and records.offsets(none).count() == 0
    log = none.withColumn("offset", F.lit(0))
    assert storage.replay(log, docs).count() == 0 and storage.replay_report(log, docs).first().asDict() == {"examined": 0, "recovered": 0, "skipped": 0}
    assert storage.next_ids(none.select(F.col("doc_id").alias("k")), docs, "k").count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_hydration_of_few_and_many_results(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(search, "FEW", few)
    docs_of(spark, {k: f"text {k}" for k in range(50)}).withColumn("preview", F.lit("other")).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    found = spark.createDataFrame([(7, 1.5), (7, 1.5), (99, 0.0), (None, 0.0)], "doc_id long, score double")
    out = search.hydrate(found, docs, 6)
    assert sorted(map(str, map(tuple, out.collect()))) == ["(7, 1.5, 'text 7')", "(7, 1.5, 'text 7')", "(99, 0.0, '')", "(None, 0.0, '')"]
    assert out.columns == ["doc_id", "score", "preview"] and search.hydrate(found.where("false"), docs, 6).collect() == []
    plan = out._jdf.queryExecution().toString()
    assert ("In(doc_id, [7,99])" in plan) == (few > 0), plan


def test_postings_count_runs_of_words(spark, tmp_path):
    rng = random.Random(7)
    docs = docs_of(spark, {k: " ".join(rng.choices(["aa", "b", "the", "Ccc", "é9"], k=rng.randrange(0, 300))) for k in range(40)})
    want = {}
    for r in docs.collect():
        for w in tx.query_terms(r.text):
            want[w, r.doc_id] = want.get((w, r.doc_id), 0) + 1
    assert {(r.term, r.doc_id): r.tf for r in ix.postings(docs).collect()} == want
    ix.write_postings(docs, str(tmp_path / "p"))
    assert {(r.term, r.doc_id): r.tf for r in spark.read.parquet(str(tmp_path / "p")).collect()} == want and os.listdir(tmp_path) == ["p"]


def test_commits_are_in_order_and_the_first_wins(spark, tmp_path):
    root = str(tmp_path / "data")
    engine = Engine(spark, root)
    for k in range(12):
        rows = [(7, f"version {k}".encode()), (100 + k, b"own")] + ([(3, None)] if k == 5 else [])
        records.append_records(spark.createDataFrame(rows, "doc_id long, payload binary").repartition(3), f"{root}/log")
    names = sorted(x for x in os.listdir(f"{root}/log") if not x.startswith((".", "_")))
    assert [int(x.split("-")[0]) for x in names] == sorted(int(x.split("-")[0]) for x in names) and {int(x.split("-")[0]) for x in names} == set(range(1, 13))
    with open(f"{root}/log/{names[-1]}", "ab") as f:
        f.write(b"FG torn")
    got = engine.recover()
    assert (got["examined"], got["recovered"], got["skipped"], got["incomplete_tail"], got["corruption"], got["tail_truncated"], got["truncated_bytes"], got["completed"]) == (25, 14, 11, True, False, True, 7, False)
    assert got["reason"] and engine.get(7) == "version 0" and engine.get(3) == ""
    again = engine.recover()
    assert again["completed"] and again["recovered"] == 0 and again["reason"] == "" and engine.stats()["next_id"] == 112
    with pytest.raises(storage.DocumentNotFound):
        engine.get(99)


def test_add_guards_the_log_too(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "data"))
    records.append_records(spark.createDataFrame([(1, b"logged only")], "doc_id long, payload binary"), engine.at("log"))
    with pytest.raises(storage.DuplicateDocument):
        engine.add(docs_of(spark, {1: "other"}))
    engine.add(docs_of(spark, {2: None, 4: "four"}).withColumn("path", F.lit("x")))
    assert engine.get(2) == "" and engine.get(4) == "four" and {r.doc_id for r in engine.log().collect()} == {1, 2, 4}
    assert engine.recover()["recovered"] == 1 and engine.get(1) == "logged only"
    assert os.listdir(engine.at("incoming")) == [] if os.path.exists(engine.at("incoming")) else True
    records.append_records(spark.createDataFrame([(Decimal(2**64 - 1), b"x")], "doc_id decimal(20,0), payload binary"), engine.at("log"))
    with pytest.raises(Exception, match="2\\*\\*63"):
        engine.log().collect()


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\nx\ry".encode())
    assert [r.text for r in files.read_text_files(spark, str(tmp_path)).collect()] == ["é\nx\ny"]
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_text_files(spark, str(tmp_path)).collect()


def test_text_files_are_listed_and_read_in_tasks(spark, tmp_path):
    texts = {k: f"{k}\r\n" * (k % 3) for k in range(-5, 2100)}
    folders = files.write_text_files(docs_of(spark, texts | {7: None}).coalesce(1), f"file://{tmp_path}/many")
    found = files.read_text_files(spark, *folders)
    assert found.inputFiles() == []  # Spark's reader would hold each file on the driver
    got = {int(r.path.rpartition("_")[2][:-4]): r.text for r in found.collect()}
    assert got == {k: t.replace("\r\n", "\n") for k, t in texts.items()} | {7: ""}
    assert len(os.listdir(folders[0].removeprefix("file://"))) == 3
    deep = tmp_path / "many" / "x y" / "z"
    deep.mkdir(parents=True)
    for name in ("a.txt", "_hidden", ".hidden"):
        (deep / name).write_text(name)
    for at in (str(tmp_path / "many" / "x y"), f"file://{tmp_path}/many"):
        mine = [(r.path, r.text) for r in files.read_text_files(spark, at).collect() if r.path.endswith("a.txt")]
        assert mine == [(f"file:{deep}/a.txt", "a.txt")]
    assert files.read_text_files(spark).count() == 0
    assert files.read_text_files(spark, f"file://{tmp_path}/many").count() == 2106


def test_engine_and_command_line(spark, tmp_path, capsys):
    root, given = str(tmp_path / "data"), tmp_path / "in"
    given.mkdir()
    with pytest.raises(NoDocuments):
        Engine(spark, root).search("python")
    assert main(["--data-dir", root, "search", "python"], spark) == 1
    for k, t in enumerate(["python storage engine", "python search index", "storage search wal"], 1):
        (given / f"{k}.txt").write_text(t)
        assert main(["--data-dir", root, "add", str(given / f"{k}.txt")], spark) == 0
    engine = Engine(spark, root)
    assert engine.index() == (3, 6)
    assert [r.doc_id for r in engine.search("python search").collect()] == [2]
    assert [r.doc_id for r in engine.search("python search", "or").collect()] == [1, 2, 3]
    assert [r.doc_id for r in engine.search("storage wal", "or", ranked=True).collect()] == [3, 1]
    s = engine.stats()
    assert (s["documents"], s["max_id"], s["terms"], s["log_records"], s["log_status"]) == (3, 3, 6, 3, "ok")
    assert engine.check()["ok"] and main(["--data-dir", root, "check"], spark) == 0
    records.append_records(spark.createDataFrame([(9, b"late words"), (1, b"other")], "doc_id long, payload binary"), root + "/log")
    with open(f"{root}/log/" + sorted(x for x in os.listdir(f"{root}/log") if x.endswith(".rec"))[0], "ab") as f:
        f.write(b"FG torn")
    got = engine.recover()
    assert (got["examined"], got["recovered"], got["removed"]) == (5, 1, 7) and engine.recover()["recovered"] == 0
    assert not engine.check()["ok"] and main(["--data-dir", root, "check"], spark) == 2
    assert main(["--data-dir", root, "index"], spark) == 0 and engine.check()["ok"]
    capsys.readouterr()
    assert main(["--data-dir", root, "search", "storage wal", "--or", "--ranked"], spark) == 0
    assert capsys.readouterr().out.splitlines()[0].startswith("1. [")
    assert main(["--data-dir", root, "search", "zzz"], spark) == 0 and "no matches" in capsys.readouterr().out
    assert main(["nonsense"], spark) == 2
    assert main(["--data-dir", root, "add", str(tmp_path / "missing.txt")], spark) == 1


def test_streaming_ingest(spark, tmp_path):
    log = str(tmp_path / "log")
    schema = "doc_id long, text string, offset long"
    for rows in ([(1, "a", 0), (1, "b", 5), (2, "c", 9)], [(2, "later", 1), (3, "d", 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
        ingest(spark.readStream.schema(schema).parquet(log), str(tmp_path / "docs"), str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "docs")).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_into_tokens_once(spark, tmp_path):
    docs = docs_of(spark, {1: "b a b the", 2: None, 3: "the", 4: "", 5: "Ab a ab"})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    every = ix.postings(docs)
    assert plan_of(every).count("regexp_extract_all") == 1
    assert {tuple(r) for r in every.collect()} == {("b", 1, 2), ("ab", 5, 2)}
    for terms in (["ab", "zz"], ["b", "the", "b"], ["zz"], ["the"], []):
        assert sorted(map(tuple, ix.postings(docs, terms).collect())) == sorted(tuple(r) for r in every.collect() if r.term in terms)
    for name in ("rank_scores", "rank_documents", "search_ranked_and", "search_ranked_or", "search_ranked_topk", "search_ranked_preview", "search_preview"):
        assert "regexp_extract_all" not in plan_of(QUERIES[name](spark, str(tmp_path))), name


def test_comparison_sorts_by_number_and_extra_terms_need_no_join(spark):
    docs = docs_of(spark, {1: "b", 2: "c c"})
    index = spark.createDataFrame([("b", 1, 1), ("b", 2, 1), ("x", 1, 1), ("x", 9, 1), (None, 3, 1)], "term string, doc_id long, tf long")
    both = consistency.compared(docs, index)
    assert both.columns == ["term", "doc_id", "expected", "actual"]
    assert "SortMergeJoin [doc_id" in both._jdf.queryExecution().executedPlan().toString() or "ShuffledHashJoin [doc_id" in both._jdf.queryExecution().executedPlan().toString()
    extra = consistency.extra_terms(docs, index)
    assert "Join" not in plan_of(extra)
    assert {r.term for r in extra.collect()} == {"x", None} and consistency.report(docs, index, docs).first().extra_terms == 2


def test_record_files_are_copied_whole_and_counted_without_payloads(spark, tmp_path):
    at, to = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    records.append_records(spark.range(50).select(F.col("id").alias("doc_id"), F.lit(b"payload").alias("payload")).repartition(3), at)
    records.copy_files(spark, at, to)
    both = [{p.rpartition("/")[2]: open(p, "rb").read() for p, _ in records.files_at(x)} for x in (at, to)]
    assert both[0] == both[1] and len(os.listdir(tmp_path / "b")) == len(both[0]) == 3
    rows = [sorted(map(tuple, records.status(records.read_records(spark, to, payload=p)).collect())) for p in (True, False)]
    assert rows[0] == rows[1] and sum(r[1] for r in rows[0]) == 50
    light = records.valid(records.read_records(spark, to, payload=False)).collect()
    assert sorted(int(r.doc_id) for r in light) == list(range(50)) and {r.payload for r in light} == {None}


def test_small_record_files_share_a_task():
    files_ = [(f"{k:06}.rec", 2_500_000) for k in range(3000)] + [("x", 1 << 30), ("y", 1)]
    groups = records.grouped(files_)
    assert [f for g in groups for f in g] == files_ and len(groups) < 150 and all(len(g) == 1 or sum(n for _, n in g) <= records.LARGEST for g in groups)
    assert records.grouped([]) == [] and len(records.grouped([("a", 1), ("b", 1)])) == 1
