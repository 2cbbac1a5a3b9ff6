"""Best-fit packing of token sequences by a configuration linear program.

Documents become pieces of at most CAPACITY tokens. What is packed is the histogram of piece lengths: at most CAPACITY numbers,
however many documents there are, so it fits the driver. The linear program has a variable for each configuration (a multiset of
lengths that fits one sequence) and covers each length's count with as few sequences as it can.

It is solved by multiplicative weights. A length's weight is its share of a sequence times a price; a knapsack over the capacity
(dynamic programming) gives the value of each room, and a walk down that table prices the best configuration that holds the longest
length still short and only lengths that are short. Its count grows until one of its lengths has the round's share, the weights of
what it covers fall at once, and the table is made anew every BATCH configurations. A configuration that leaves more than LOOSE of a
sequence is put off to later rounds. After each round the prices of lengths that stood in loose configurations rise; while the whole
needs over GAP more than the tokens do, it is solved again by these prices, PASSES times at most.

Counts are rounded down, then up where the pieces suffice, the fullest configurations first; what is left is a linear program of its
own, with half the rounds, until at most REST of the pieces are left. Best fit in decreasing order places those, in sequences of
their own.

Which document gets which place is decided by ranks within a length: pieces() numbers the pieces of a length within its task, and
the tasks' counts are summed by length, so nothing is ranked in one place, even if a third of all pieces share a length. The places
of a length are a sorted table in the shared folder, which each task reads; its rows are those of the configurations, of which each
round of the program makes at most a few for each length.

Edge cases: null or empty text is a document of the end id alone; repeated doc_ids are packed as rows of their own; null doc_ids
are allowed; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexibrook.llm.common import open_fs, rested, saved, shared_dir, table, values
from lexibrook.llm.tokens import crc, encoder, vocabulary_path

CAPACITY, END = 4096, 1
ROUNDS, BATCH, STALE, PASSES, STEP, PRICE, LOOSE, GAP, REST = 6, 96, 24, 3, 0.05, 4.0, 1 / 4096, 0.005, 0.05


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth) of every document's ids with the end id, cut only if longer than capacity;
    nth counts a task's pieces of equal length."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(b.column(0).to_pylist(), values(b.column(1))):
                ids = enc.ids(text, end)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for column, x in zip(out, (doc, k, at, len(part), crc(part), task, seen[len(part)])):
                        column.append(x)
                    seen[len(part)] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def priced(lengths, weights, capacity: int):
    """Knapsack by dynamic programming: the greatest value of each room up to the capacity; lengths ascend."""
    import numpy as np

    best = np.zeros(capacity + 1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        if n := fits[c]:
            best[c] = (best[c - lengths[:n]] + weights[:n]).max()
    return best


def covered(histogram: dict[int, int], capacity: int, rounds: int, price) -> Counter:
    """Counts of configurations that cover the histogram once, by these prices of its lengths in ascending order, which it changes."""
    import numpy as np

    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[n] for n in lengths.tolist()], np.float64)
    cover, out = np.zeros(len(lengths)), Counter()
    for k in range(1, rounds + 1):
        quota = np.maximum(0.0, counts * k / rounds - cover)
        quota[quota < 1e-9] = 0.0
        loose, done, first, age = np.zeros(len(lengths)), np.full(len(lengths), 1e-9), len(lengths) - 1, BATCH
        while True:
            while first >= 0 and quota[first] <= 0:
                first -= 1
            if first < 0:
                break
            for again in (False, True):
                if again or age >= BATCH:
                    weight = lengths / capacity * price * np.exp(-STEP * (cover / counts * rounds - k))
                    short, age = np.flatnonzero(quota > 0), 0
                    best = priced(lengths[short], weight[short], capacity)
                held, room = {first: 1}, capacity - int(lengths[first])
                while n := int(np.searchsorted(lengths, room, "right")):
                    value = np.where(quota[:n] > 0, weight[:n] + best[room - lengths[:n]], -1.0)
                    i = int(value.argmax())
                    if value[i] < 0:
                        break
                    held[i] = held.get(i, 0) + 1
                    room -= int(lengths[i])
                if room <= LOOSE * capacity or age < STALE:
                    break
            age += 1
            if room > LOOSE * capacity and k < rounds:
                first -= 1
                continue
            step = min(quota[i] / h for i, h in held.items())
            out[tuple(int(lengths[i]) for i in sorted(held, reverse=True) for _ in range(held[i]))] += step
            for i, h in held.items():
                cover[i] += h * step
                done[i] += h * step
                loose[i] += h * step * room / capacity
                quota[i] = max(0.0, quota[i] - h * step)
                if quota[i] < 1e-9:
                    quota[i] = 0.0
                weight[i] *= np.exp(-STEP * h * step / counts[i] * rounds)
        price *= np.exp(PRICE * loose / done)
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Counter:
    """Fractional counts of configurations that cover each length exactly, in as few sequences as the passes found."""
    import numpy as np

    need, price, best = sum(n * c for n, c in histogram.items()) / capacity, np.ones(len(histogram)), Counter()
    for _ in range(PASSES):
        x = covered(histogram, capacity, rounds, price)
        if not best or sum(x.values()) < sum(best.values()):
            best = x
        if sum(best.values()) <= need * (1 + GAP) + 0.5:
            break
    return best


def rounded(x: Counter, histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(contents, number of sequences) within the histogram: x rounded down, then up where the pieces are there. Configurations that leave
    more room than the average does wait for the next program."""
    left, out = Counter(histogram), Counter()
    spare = sum((capacity - sum(c)) * n for c, n in x.items()) / max(1e-9, sum(x.values())) + LOOSE * capacity
    full = sorted(((c, n) for c, n in x.items() if capacity - sum(c) <= spare), key=lambda p: (capacity - sum(p[0]), -p[1], p[0]))
    down = [(c, int(n + 1e-9)) for c, n in full]
    up = [(c, 1) for c, n in sorted(full, key=lambda p: -(p[1] % 1)) if n % 1 > 1e-9]
    for config, n in down + up:
        held = Counter(config)
        if (n := min([n, *(left[m] // h for m, h in held.items())])) > 0:
            out[config] += n
            for m, h in held.items():
                left[m] -= h * n
    return list(out.items())


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in decreasing order, with bins of equal contents as one group: (contents, count)."""
    rooms: list[int] = []  # sorted, of the groups that are open
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(contents: tuple[int, ...], n: int, room: int) -> None:
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append((contents, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if left >= each:
                    put((length,) * each, left // each, capacity - each * length)
                if left % each:
                    put((length,) * (left % each), 1, capacity - left % each * length)
                break
            room = rooms[at]
            contents, n = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            each = room // length
            if left >= each * n:
                put(contents + (length,) * each, n, room - each * length)
                left -= each * n
            else:
                full = left // each
                if full:
                    put(contents + (length,) * each, full, room - each * length)
                if rest := left - full * each:
                    put(contents + (length,) * rest, 1, room - rest * length)
                if n - full - (rest > 0):
                    put(contents, n - full - (rest > 0), room)
                left = 0
    return [g for room in groups.values() for g in room]


def programmed(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(contents, number of sequences) that the linear programs place, and the histogram of what is left."""
    left, out, rounds = Counter(histogram), [], ROUNDS
    enough = REST * sum(left.values())
    if left[capacity]:
        out.append(((capacity,), left.pop(capacity)))
    while (before := sum(left.values())) > enough:
        for config, n in rounded(solve(dict(left), capacity, rounds), left, capacity):
            out.append((config, n))
            for m in config:
                left[m] -= n
        left = Counter({m: n for m, n in left.items() if n})
        if rounds == 1 and sum(left.values()) > 0.9 * before:
            break
        rounds = max(1, rounds // 2)
    return out, dict(left)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(contents, number of sequences): holds each length exactly as often as the histogram does."""
    out, left = programmed(histogram, capacity)
    return out + best_fit(left, capacity)


def places(configs: list[tuple[tuple[int, ...], int]]):
    """Rows (key, first sequence, offset): the piece of rank r among those of its length is in the last row with key <= length << 40 | r."""
    import numpy as np

    taken: Counter = Counter()
    rows, sequence = [], 0
    for contents, n in configs:
        offset = 0
        for length in contents:
            rows.append((length << 40 | taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 3)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A table of pieces() with sequence_id and offset in place of task and nth."""
    import numpy as np
    import pyarrow as pa

    counts = saved(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    at = shared_dir(cut.sparkSession, "packing-places")
    fs, path = open_fs(at)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(places(plan(histogram, capacity)).tobytes())
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = [c for c in cut.columns if c not in ("task", "nth")]
    ranked = cut.join(counts.select("length", "task", before.alias("before")).hint("merge"), ["length", "task"]).select(*names, (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # no more texts are cut
        rested()
        here, p = open_fs(at)
        with here.open_input_stream(p) as f:
            key, first, offset = np.frombuffer(f.read(), np.int64).reshape(-1, 3).T
        key = np.ascontiguousarray(key)
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            want = length.astype(np.int64) << 40 | rank
            row = np.searchsorted(key, want, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(first[row] + want - key[row]), pa.array(offset[row])], [*names, "sequence_id", "offset"])

    fields = [f for f in cut.schema.fields if f.name in names]
    return ranked.mapInArrow(place, T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(saved(pieces(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json")), "packing-pieces"))


QUERIES, SQL = {"op1_packing": op1_packing}, {}
