"""Language identification by segmentation-marginalised unigrams.

A text is a run of words (letters, lower-cased). A word's probability in a language is the sum, over all ways to cut it into
pieces of a fixed public vocabulary, of the product of that language's piece probabilities; a forward pass over the word's
positions gives that sum. A text's score sums the words' logarithms, and softmax over the languages gives the score returned.

Piece probabilities come from expectation-maximisation (forward-backward over each distinct word, weighted by its count), ROUNDS
times, on labelled documents: those with a lang whose crc32(doc_id as text) mod 5 isn't 0. TRAIN_ROWS bounds the expected number
of them (chosen by a hash of doc_id, whole texts); everything else covers all rows. The driver gets one number for each language
and piece, whatever the input's size; a model of over MOST_BYTES is an error. Prediction sees the text alone.

As a filter (keep_known), words are also scored by a background in which all pieces are equally likely. A text of a language is taken
to have a share of NOISE background words (names, keys, codes): it goes, as one in none of the languages, if that mixture with its
best language makes its words no likelier than the background alone does.

Edge cases: null text, or text without a letter, is `und` with score 0; so is everything if nothing can be learned, and keep_known
then keeps nothing; null doc_ids are never trained on and count as held out; repeated rows give one row each; an empty table gives no
rows. Training counts a word of over LONG letters as several; scoring takes a word of any length whole, one of over SHORT letters by
itself with rescaling against underflow."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexibrook.llm.common import rested, saved, table, values
from lexibrook.llm.tokens import encoder, vocabulary_path

TRAIN_ROWS, ROUNDS, SMOOTH, CACHE, UNKNOWN, LONG = 20_000, 3, 0.1, 150_000, "und", 48
SHORT, STRETCH, MOST_BYTES, NOISE, SENT = 24, 50_000, 1 << 29, 0.1, 1000
LETTERS = re.compile(r"[^\W\d_]+").findall


class Pieces:
    """The vocabulary's lower-case pieces of letters; a word starts with the mark ▁. The last number is that of any other letter."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        self.number = {p: k for k, p in enumerate(p for p in kept if p == p.lower() and p.replace("▁", "", 1).isalpha() or p == "▁")}
        self.other, self.longest = len(self.number), max(map(len, self.number))
        self.root: dict = {}  # by letter, the pieces that go on with it; "" holds the number and, in the low byte, the length of the piece that ends here
        for piece, k in self.number.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = k << 8 | len(piece)

    def edges(self, word: str) -> list[list[tuple[int, int]]]:
        """By start, the (end, piece) that can stand there."""
        s, out = "▁" + word, []
        n, root, other = len(s), self.root, self.other
        for i in range(n):
            here, node, j = [], root.get(s[i]), i + 1
            while node is not None:
                code = node.get("")
                if code is not None:
                    here.append((j, code >> 8))
                if j == n:
                    break
                node = node.get(s[j])
                j += 1
            out.append(here if here and here[0][0] == i + 1 else [(i + 1, other), *here])
        return out


    def add_edges(self, word: str, codes: list[int], counts: list[int]) -> None:
        """Adds the number and length, as in root, of each piece that can stand in the word, and how many start at each position."""
        s, root = "▁" + word, self.root
        n = len(s)
        for i in range(n):
            node, j, before = root.get(s[i]), i + 1, len(codes)
            while node is not None:
                if "" in node:
                    codes.append(node[""])
                if j == n:
                    break
                node = node.get(s[j])
                j += 1
            if len(codes) == before or codes[before] & 255 != 1:
                codes.append(self.other << 8 | 1)
            counts.append(len(codes) - before)


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def forward(edges: list[list[tuple[int, int]]], p: list[float], longest: int) -> float:
    """Logarithm of the sum over all segmentations."""
    a, shift = [0.0] * (len(edges) + 1), 0.0
    a[0] = 1.0
    for i, here in enumerate(edges):
        x = a[i]
        if x < 1e-150:
            shift += math.log(x)
            for j in range(i, min(len(a), i + longest + 1)):
                a[j] /= x
            x = 1.0
        for j, k in here:
            a[j] += x * p[k]
    return math.log(a[-1]) + shift


def expected(edges: list[list[tuple[int, int]]], p: list[float], n: float, into) -> None:
    """Adds each piece's expected count in n copies of a word of at most LONG letters."""
    size = len(edges)
    a, b = [0.0] * (size + 1), [0.0] * (size + 1)
    a[0] = b[size] = 1.0
    for i, here in enumerate(edges):
        for j, k in here:
            a[j] += a[i] * p[k]
    for i in range(size - 1, -1, -1):
        b[i] = sum(p[k] * b[j] for j, k in edges[i])
    scale = n / a[size] if a[size] > 0 else 0.0
    for i, here in enumerate(edges):
        for j, k in here:
            into[k] += a[i] * p[k] * b[j] * scale


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


class Model:
    """Languages and, for each, the piece probabilities, as an array that goes to tasks."""

    def __init__(self, path: str, langs: list[str], probabilities) -> None:
        import numpy as np

        self.path, self.langs, self.p = path, langs, np.array(probabilities, np.float64).reshape(len(langs), -1 if langs else 0)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n), summed within each batch only; words over LONG letters count as several."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), values(b.column(1))):
                by.setdefault(lang, Counter()).update(w[k : k + LONG] for w in LETTERS((text or "").lower()) for k in range(0, len(w), LONG))
            rows = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, path: str, rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> Model:
    import numpy as np
    import pyarrow as pa

    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    total = labelled.select("doc_id").count()
    if total > rows:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rows / total * (1 << 30)))
    words = saved(word_counts(labelled), "langid-words")
    langs = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    size = pieces(path).other + 1
    if len(langs) * size * 8 > MOST_BYTES:
        raise ValueError(f"{len(langs)} languages make a model of more than {MOST_BYTES} bytes")
    p = np.full((len(langs), size), 1.0 / size)
    for _ in range(rounds if langs else 0):

        def run(batches: Iterator[pa.RecordBatch], p=p) -> Iterator[pa.RecordBatch]:
            v, p, got = pieces(path), p.tolist(), [[0.0] * size for _ in langs]
            at = {x: k for k, x in enumerate(langs)}
            for b in batches:
                for lang, w, n in zip(*(c.to_pylist() for c in b.columns)):
                    expected(v.edges(w), p[at[lang]], n, got[at[lang]])
            got = np.array(got)
            i, k = np.nonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(k, pa.int32()), pa.array(got[i, k])], ["i", "k", "n"])

        counts = np.full((len(langs), size), SMOOTH)
        for r in words.select("lang", "word", "n").mapInArrow(run, "i int, k int, n double").groupBy("i", "k").agg(F.sum("n").alias("n")).collect():  # one for each language and piece
            counts[r["i"], r["k"]] += r["n"]
        p = counts / counts.sum(axis=1, keepdims=True)
    return Model(path, langs, p)


class Scorer:
    """Scores texts by their words' log-probabilities, one row for each known word; keeps two generations of CACHE words. With
    background, a row also holds how much likelier each language's mixture makes the word than the background does."""

    def __init__(self, model: Model, background: bool = False) -> None:
        import numpy as np

        self.v, self.model, self.background = pieces(model.path), model, background
        every = np.vstack([model.p, np.full_like(model.p[:1], 1.0 / max(1, model.p.shape[1]))]) if background else model.p
        self.p = every.T.copy()  # by piece, a number for each language
        self.alone = every.tolist()
        self.known, self.before, self.rows, self.rows_before = {}, {}, np.zeros((1024, len(model.langs) * (1 + background))), None

    def widened(self, logs):
        import numpy as np

        if not self.background:
            return logs
        n = len(self.model.langs)
        return np.hstack([logs[:, :n], np.logaddexp(logs[:, :n] - logs[:, n:] + math.log(1 - NOISE), math.log(NOISE))])

    def renew(self) -> None:
        import numpy as np

        self.before, self.rows_before, self.known, self.rows = self.known, self.rows, {}, np.zeros_like(self.rows)

    def forwards(self, words: list[str]):
        """forward() of these words of at most SHORT letters in each language, all words and languages of a position in one step."""
        import numpy as np

        width, codes, counts = SHORT + 2, [], []
        for word in words:
            self.v.add_edges(word, codes, counts)
        lengths = np.array([len(x) + 1 for x in words])
        first = np.repeat(np.arange(len(words)) * width - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(len(counts))  # each position's row
        row, codes = np.repeat(first, counts), np.array(codes, np.int64)
        i = row % width
        order = np.argsort(i, kind="stable")
        source, codes, steps = row[order], codes[order], np.searchsorted(i[order], np.arange(width))
        target, k = source + (codes & 255), codes >> 8
        a = np.zeros((len(words) * width, self.p.shape[1]))
        a[::width] = 1.0
        for at, end in zip(steps, steps[1:]):  # edges from one position of a word end at different ones
            a[target[at:end]] += a[source[at:end]] * self.p[k[at:end]]
        return np.log(a[np.arange(len(words)) * width + lengths])

    def learn(self, words: set[str]) -> None:
        """Gives these words their rows."""
        import numpy as np

        first, new = len(self.known), sorted(words)
        while len(self.rows) < first + len(new):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.known.update(zip(new, range(first, first + len(new))))
        old = [(self.known[w], self.before[w]) for w in new if w in self.before]
        if old:
            to, at = np.array(old).T
            self.rows[to] = self.rows_before[at]
            new = [w for w in new if w not in self.before]
        short = [w for w in new if len(w) <= SHORT]
        step = max(64, 400_000 // (SHORT * self.p.shape[1]))
        for at in range(0, len(short), step):
            part = short[at : at + step]
            self.rows[[self.known[w] for w in part]] = self.widened(self.forwards(part))
        for w in (w for w in new if len(w) > SHORT):
            edges = self.v.edges(w)
            self.rows[self.known[w]] = self.widened(np.array([[forward(edges, p, self.v.longest) for p in self.alone]]))

    def predict(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; words are looked up for a stretch of texts of about STRETCH words at a time. With
        background, a text that goes as keep_known says has no language."""
        import numpy as np

        if not self.model.langs:
            return [(UNKNOWN, 0.0) for _ in texts]
        totals, held, size = [], [], 0

        def flush() -> None:
            if len(self.known) > CACHE:
                self.renew()
            self.learn({w for _, part in held for w in part if w not in self.known})
            for n, part in held:
                totals[n] += self.rows[np.fromiter(map(self.known.__getitem__, part), np.int64, len(part))].sum(axis=0)
            held.clear()

        for n, text in enumerate(texts):
            words = LETTERS((text or "").lower())
            totals.append(np.zeros(self.rows.shape[1]) if any(c.isalpha() for w in words for c in w) else None)
            for at in range(0, len(words) if totals[n] is not None else 0, STRETCH):
                held.append((n, words[at : at + STRETCH]))
                size += len(held[-1][1])
                if size >= STRETCH:
                    flush()
                    size = 0
        flush()
        n = len(self.model.langs)
        none = [t is None or self.background and t[n + int(t[:n].argmax())] <= 0 for t in totals]
        return [(UNKNOWN, 0.0) if x else (self.model.langs[int(t[:n].argmax())], float(1 / np.exp(t[:n] - t[:n].max()).sum())) for x, t in zip(none, totals)]


def in_parts(batch, names: list[str]) -> Iterator:
    """These columns as record batches of SENT rows, so that the executor doesn't hold a large one beside its heap."""
    import pyarrow as pa

    for at in range(0, max(map(len, batch)), SENT):
        yield pa.RecordBatch.from_arrays([c.slice(at, SENT) for c in batch], names)


def with_language(docs: DataFrame, model: Model, name: str = "lang_pred", score: str = "score", text: str = "text") -> DataFrame:
    """docs with two columns at the end."""
    import pyarrow as pa

    n, at = len(docs.columns), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # a worker that tokenized before would keep its words
        rested()
        scorer = Scorer(model)
        for b in batches:
            got = scorer.predict(values(b.column(at)))
            yield from in_parts([*b.columns[:n], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*b.schema.names, name, score])
        del scorer
        rested()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())]))


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """docs, with their own columns, but for those without a language: null text, no letter, or no likelier than background."""
    import pyarrow as pa

    at, plain = docs.columns.index("text"), isinstance(docs.schema["text"].dataType, T.StringType)
    rows = docs.select(F.struct(*docs.columns).alias("row"), *[F.col("text").cast("string").alias("text")] * (not plain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()
        rested()
        scorer = Scorer(model, background=True)
        for b in batches:
            texts = b.column(0).field(at) if plain else b.column(1)
            keep = pa.array([lang != UNKNOWN for lang, _ in scorer.predict(values(texts))], pa.bool_())
            yield from in_parts([b.column(0) if keep.true_count == len(keep) else b.column(0).filter(keep)], ["row"])
        del scorer
        rested()

    return rows.mapInArrow(run, T.StructType([T.StructField("row", docs.schema)])).select("row.*")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, vocabulary_path("piece_bpe_32k.model"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_language(rows, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES, SQL = {"op6_language": op6_language}, {}
