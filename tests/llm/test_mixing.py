import pytest

from lexibrook.llm import mixing


def water(sizes):
    total, weights = sum(sizes), [i % 3 + 1 for i in range(len(sizes))]
    out, left = [None] * len(sizes), set(range(len(sizes)))
    while True:
        spare = total - sum(x for x in out if x is not None)
        w = sum(weights[i] for i in left)
        over = [i for i in left if spare * weights[i] / w > 3 * sizes[i]]
        if not over:
            for i in left:
                out[i] = spare * weights[i] / w
            return out
        for i in over:
            out[i] = 3 * sizes[i]
            left.remove(i)


def rows(sizes, per=10):
    return [(s * 1000 + i, " ".join(["w"] * (n // per)), f"s{s:02}" if s < len(sizes) - 1 else None, 5) for s, n in enumerate(sizes) for i in range(per)]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 2000, 10, 500, 90], [1000], [20, 20, 9000, 20, 20, 20, 700]])
def test_targets_match_iterated_resharing(spark, sizes):
    docs = spark.createDataFrame(rows(sizes), "doc_id long, text string, source string, weight int")
    got = mixing.targets(mixing.with_sizes(docs)).collect()
    got = [r.target for r in sorted(got, key=lambda r: (r.source is None, r.source))]
    assert got == pytest.approx(water(sizes)) and sum(got) == pytest.approx(sum(sizes))


def test_taken_is_near_target_and_mix_repeats_rows(spark):
    data = rows([600, 6000, 300, 90]) + [(None, None, "s00", 1), (7, "", "s01", 1), (7, "", "s01", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size int")
    got = mixing.copies(mixing.with_sizes(docs)).collect()
    assert len(got) == len(data) and max(r.copies for r in got) <= 3
    by = {}
    for r in got:
        t = by.setdefault(r.source, [r.target, 0])
        t[1] += r.copies * r["size"]
    assert all(abs(a - b) <= 2 * 600 for a, b in by.values())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs).collect()))


def test_sources_without_words_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.copies) for r in mixing.copies(mixing.with_sizes(docs)).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.copies(mixing.with_sizes(docs.limit(0))).count() == 0
