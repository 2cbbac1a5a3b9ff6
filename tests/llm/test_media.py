import hashlib
import random
import zlib

from pyspark.sql import functions as F

from lexibrook.llm import media
from lexibrook.llm.common import open_fs, shared_dir


def brute_cuts(payload):
    g, mask, ends, start = [int(x) for x in media.gears()], (1 << 32) - 1, [], 0
    marks = []
    for i in range(len(payload)):
        h = 0
        for b in payload[max(0, i - 31) : i + 1]:
            h = (h << 1) + g[b] & mask
        if h < 1 << 32 - media.CUT:
            marks.append(i + 1)
    for c in [*marks, len(payload)]:
        last = c == len(payload) and (not marks or c != marks[-1] or True)
        while c - start > media.MOST and (c in marks or last) and c - start >= media.LEAST:
            start += media.MOST
            ends.append(start)
        if c in marks and c - start >= media.LEAST:
            ends.append(c)
            start = c
    if start < len(payload):
        ends.append(len(payload))
    return ends


def test_cuts_match_a_byte_by_byte_hash():
    rng = random.Random(1)
    for n in (0, 1, 64, 511, 513, 5000, 40_000):
        payload = bytes(rng.choice(b"abcdefgh ") for _ in range(n))
        assert media.cuts(payload) == brute_cuts(payload)
    assert media.cuts(bytes(70_000))[-1] == 70_000


def test_blocks_of_a_long_payload_agree(monkeypatch):
    payload = random.Random(2).randbytes(9 << 20)
    ends = media.cuts(payload)
    assert ends[-1] == len(payload) and max(b - a for a, b in zip([0, *ends], ends)) <= media.MOST
    shifted = media.cuts(payload[12345:])
    assert len({e - 12345 for e in ends} & set(shifted)) > 0.99 * len(shifted)


def test_a_wave_that_failed_is_done_again(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(k, "".join(rng.choice("abcdé \n") for _ in range(3000))) for k in range(40)], "doc_id long, text string").repartition(6)
    folder = shared_dir(spark, "test-media")
    lists = media.ingest(df, f"{folder}/packs")
    fs, path = open_fs(folder)
    fs.create_dir(f"{path}/store-places/1")
    with fs.open_output_stream(f"{path}/store-places/1/part-of-a-failed-run"):
        pass
    places = media.rewrite(lists, f"{folder}/packs", f"{folder}/store")
    assert media.read_media(media.media(lists, places), f"{folder}/store").count() == 40


def test_round_trip(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdé \n") for _ in range(30_000))
    texts = [None, "", "a", "é" * 31, "x" * 64, "x" * 65, base, base, base[:20_000] + "!" + base[20_000:], "y" * 3_000_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a", "x"), (2, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, medium string").repartition(3)
    folder = shared_dir(spark, "test-media")
    lists = media.ingest(df, f"{folder}/packs")
    places = media.rewrite(lists, f"{folder}/packs", f"{folder}/store")
    assert places.count() == places.select("digest").distinct().count() == lists.select("digest").distinct().count()
    fs, path = open_fs(f"{folder}/store")
    from pyarrow import fs as pafs

    assert sum(x.size for x in fs.get_file_info(pafs.FileSelector(path))) == places.agg(F.sum("stored")).first()[0]
    at, old = open_fs(f"{folder}/packs")
    assert at.get_file_info(pafs.FileSelector(old)) == []
    again = media.rewrite(lists, f"{folder}/packs", f"{folder}/store")  # as after a failure: whole waves are left as they are
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, places.collect()))
    got = media.read_media(media.media(lists, places), f"{folder}/store").collect()
    assert len(got) == len(rows)
    for r in got:
        payload, n = media.payload_of("a" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.feature == media.features(payload)
    same = {(r.media_bytes, r.media_sha256) for r in got if r.doc_id in (6, 7)}
    assert len(same) == 1
    lists = media.ingest(df.limit(0), f"{folder}/packs0")
    assert media.read_media(media.media(lists, media.rewrite(lists, f"{folder}/packs0", f"{folder}/store0")), f"{folder}/store0").count() == 0
