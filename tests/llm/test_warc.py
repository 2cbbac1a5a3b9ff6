import base64
import gzip
import hashlib

from pyarrow import fs as pafs

from lexibrook.llm import common, warc
from lexibrook.llm.common import open_fs, shared_dir

ROWS = [
    (5, "http://a/é b\r\nX: y", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://a", "<p>same</p>"), (2, "u", None), (3, "u", ""), (7, "u", "é" * 100_000), (8, "u", "x" * 10),
    (None, "u", "<p>same</p>"), (None, None, None), (4, "u", "WARC/1.1\r\n\r\n\r\n"), (9, "again", "<p>same</p>"), (5, "other", "not the same"),
]


def brute(rows, least=0):
    most = {}
    for p, _, h in rows:
        most[h or ""] = max(most.get(h or "", -1), -1 if p is None else p)
    for p, _, h in rows:
        data = (h or "").encode()
        revisit = p is not None and len(data) >= least and p < most[h or ""]
        yield (str(p), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", most[h or ""] if revisit else None)


def rows_of(df):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_round_trip_and_rolling(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, kind string").repartition(3)
    key = lambda r: tuple(map(str, r))
    for least, roll in ((0, 1), (0, 1 << 20), (11, 500)):
        folder = shared_dir(spark, "test-warc")
        manifest = warc.write_archives(df, folder, least, roll).collect()
        assert sorted(rows_of(warc.read_archives(spark, folder)), key=key) == sorted(brute(ROWS, least), key=key)
        fs, path = open_fs(f"{folder}/files")
        names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(path)))
        assert names == sorted(r["name"] for r in manifest) and (roll > 1 or len(names) == len(ROWS))
        for r in manifest:
            with fs.open_input_stream(f"{path}/{r['name']}", compression=None) as f:
                data = f.read()
            assert hashlib.sha256(data).hexdigest() == r["sha256"] and gzip.decompress(data).startswith(b"WARC/1.1\r\n")


def test_same_bytes_again(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    runs = [sorted(tuple(r) for r in warc.write_archives(df, shared_dir(spark, "test-warc")).collect()) for _ in range(2)]
    assert runs[0] == runs[1]


def test_one_id_over_many_ranges(spark, monkeypatch):
    """A third of all rows share an id, another third has none: their ranges are several, each page is read back, and runs agree."""
    monkeypatch.setattr(common, "LEAST_RANGE", 4000)
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, "u", f"page {k % 40} " * 5) for k in range(900)]
    df, runs = spark.createDataFrame(rows, "page_id long, url string, html string"), []
    for parts in (2, 7):
        folder = shared_dir(spark, "test-warc")
        manifest = warc.write_archives(df.repartition(parts), folder).collect()
        runs.append(sorted((r["name"], r["records"], r["bytes"]) for r in manifest))
        assert len(manifest) > 5 and max(r["records"] for r in manifest) < 300
        key = lambda r: tuple(map(str, r))
        assert sorted(rows_of(warc.read_archives(spark, folder)), key=key) == sorted(brute(rows), key=key)
    assert runs[0] == runs[1]


def test_empty_table(spark):
    folder = shared_dir(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(spark, folder).count() == 0
