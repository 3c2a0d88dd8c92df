"""Scoring by a hidden Markov language model over hashed word classes.

A word's class is a hash of it, so the model has ``STATES`` x ``CLASSES``
parameters however large the vocabulary is.  A text's probability is that of its
class sequence under the hidden Markov chain, times that of each word in its class,
(c + 1) / (N_class + V_class + 1) from counts over all training documents; the
last 1 is what a class leaves to words it has never seen.  The end of a text is a
token with a class of its own.

Training is Baum-Welch: every task adds up expected counts over its documents,
Spark sums them by parameter, the driver normalises.  Scoring runs the scaled
forward recursion over each whole text, exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder, stored, text_of, text_slices, texts_in, words_of

STATES, CLASSES, ROUNDS = 8, 1 << 13, 6
#: Words kept in each worker with their counts (the most frequent ones); all others are joined by shuffle.
HEAD, LONGEST_HEAD = 1 << 18, 64
#: Distinct words a task counts before it passes them on; tokens of a training piece; texts advanced together.
DISTINCT, PIECE, LANES = 300_000, 512, 256
#: Weight of the class frequencies in each state's emissions, in tokens.
PRIOR = 20.0
END = b""


def class_of(word: bytes, classes: int) -> int:
    """The class of a word, as Spark's ``pmod(xxhash64(word), classes)``; the end token has class ``classes``."""
    if not word:
        return classes
    unsigned = xxhash.xxh64_intdigest(word, 42)
    return (unsigned - (1 << 64) if unsigned >= 1 << 63 else unsigned) % classes


@dataclass(frozen=True)
class Model:
    """start and restart (states), move (states x states), emit (classes + 1 x states), all probabilities."""

    start: np.ndarray
    restart: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def initial(share: np.ndarray, states: int = STATES, seed: int = 11) -> Model:
        """Slow chains whose emissions are the class frequencies, unevenly weighted to break the symmetry."""
        emit = share[:, None] * np.random.default_rng(seed).uniform(0.5, 1.5, size=(len(share), states))
        move = np.full((states, states), 0.05 / states) + 0.95 * np.eye(states)
        even = np.full(states, 1.0 / states)
        return Model(even, even, move, emit / emit.sum(axis=0))

    def next(self, counts: np.ndarray, share: np.ndarray) -> Model:
        """The model that a round's expected counts call for; ``share`` is the emissions' prior."""
        states = len(self.start)
        emit, move, start, restart = np.split(counts, np.cumsum([self.emit.size, self.move.size, states]))
        emit = emit.reshape(self.emit.shape) + PRIOR * share[:, None]
        move, start, restart = move.reshape(self.move.shape) + 0.1, start + 0.1, restart + 0.1
        return Model(start / start.sum(), restart / restart.sum(), move / move.sum(axis=1, keepdims=True),
                     emit / emit.sum(axis=0))


def expected_counts(pieces: list[np.ndarray], first: np.ndarray, model: Model) -> tuple[np.ndarray, float]:
    """Expected counts (as ``Model.next`` splits them) and log likelihood of pieces of about the same length.

    Padding is a class that every state emits with probability one, which leaves
    the recursions as they are; its counts are dropped.
    """
    classes, states = model.emit.shape
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    codes = np.full((len(pieces), int(lengths.max())), classes, dtype=np.int64)
    for row, piece in zip(codes, pieces):
        row[:len(piece)] = piece
    codes = np.ascontiguousarray(codes.T)
    emit = np.vstack([model.emit, np.ones(states)])
    steps, lanes = codes.shape
    ahead = np.empty((steps, lanes, states))
    scale = np.empty((steps, lanes, 1))
    now = np.where(first[:, None], model.start, model.restart)
    for t in range(steps):
        if t:
            now = now @ model.move
        now = now * emit[codes[t]]
        scale[t] = now.sum(axis=1, keepdims=True)
        now = now / scale[t]
        ahead[t] = now
    move, turn = np.zeros((states, states)), np.ascontiguousarray(model.move.T)
    chance = ahead.copy()
    back = np.ones((lanes, states))
    for t in range(steps - 2, -1, -1):
        weighted = emit[codes[t + 1]] * back / scale[t + 1]
        move += (ahead[t] * (codes[t + 1] < classes)[:, None]).T @ weighted
        back = weighted @ turn
        chance[t] *= back
    flat, shares = codes.ravel(), chance.reshape(-1, states)
    counted = np.stack([np.bincount(flat, weights=shares[:, k], minlength=classes + 1)[:classes]
                        for k in range(states)], axis=1)
    return (np.concatenate([counted.ravel(), (move * model.move).ravel(), chance[0][first].sum(axis=0),
                            chance[0][~first].sum(axis=0)]), float(np.log(scale).sum()))


def log_likelihoods(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """Natural logarithm of the class sequence's probability, by the scaled forward recursion over the whole text."""
    out = np.zeros(len(texts))
    order = np.argsort([-len(t) for t in texts], kind="stable")
    for a in range(0, len(order), LANES):
        rows = order[a:a + LANES]
        lengths = np.array([len(texts[i]) for i in rows])
        ends = np.cumsum(lengths)
        joined, begin = np.concatenate([texts[i] for i in rows]).astype(np.int64), ends - lengths
        now, total = np.tile(model.start, (len(rows), 1)), np.zeros(len(rows))
        live = len(rows)
        for t in range(int(lengths[0])):
            while lengths[live - 1] <= t:  # longest first: those that have ended are at the end
                live -= 1
            if t:
                now = now[:live] @ model.move
            now = now[:live] * model.emit[joined[begin[:live] + t]]
            scale = now.sum(axis=1)
            now /= scale[:, None]
            total[:live] += np.log(scale)
        out[rows] = total
    return out


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over the rows given; the end of each text counts as the empty word.  Summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()),
                                               pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for whole in batches:
            for batch in text_slices(whole, 0):
                for body in texts_in(batch.column(0)):
                    seen.update(words_of(body))
                    seen[END] += 1
                if len(seen) > DISTINCT:
                    yield out()
                    seen.clear()
        yield out()

    rows = texts.select(text_of(text).alias("_text")).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("c"))


class Head:
    """The most frequent words of a worker: index, class and log10(c + 1)."""

    def __init__(self, words: list[bytes], counts: np.ndarray, classes: int):
        self.at = {w: i for i, w in enumerate(words)}
        self.value = np.append(np.log10(counts + 1.0), 0.0)
        self.code = np.array([class_of(w, classes) for w in words] + [0], dtype=np.uint16)


def encoded(docs: DataFrame, head: tuple[list[bytes], np.ndarray], classes: int, id_col: str, text: str) -> DataFrame:
    """One row for each text: _id, n_tokens, classes of its tokens (16-bit), what the head knows of it, other words."""
    held = docs.sparkSession.sparkContext.broadcast(head)
    schema = T.StructType([
        T.StructField("_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType(), False),
        T.StructField("codes", T.BinaryType(), False), T.StructField("head_known", T.LongType(), False),
        T.StructField("head_sum", T.DoubleType(), False),
        T.StructField("words", T.ArrayType(T.BinaryType(), False), False),
        T.StructField("times", T.ArrayType(T.LongType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Head(*held.value, classes)
        for whole in batches:
            for batch in text_slices(whole, 1):
                out = {n: [] for n in schema.names[1:]}
                for body in texts_in(batch.column(1)):
                    words = words_of(body)
                    words.append(END)
                    at = np.fromiter(map(table.at.get, words, repeat(-1)), dtype=np.int64, count=len(words))
                    codes, rare = table.code[at], np.flatnonzero(at < 0).tolist()
                    others = Counter(words[i] for i in rare)
                    known = {w: class_of(w, classes) for w in others}
                    codes[rare] = [known[words[i]] for i in rare]
                    for name, value in zip(out, (len(words), codes.tobytes(), len(words) - len(rare),
                                                 float(table.value[at].sum()), list(others), list(others.values()))):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(v, pa.list_(pa.binary()) if n == "words" else
                                                 pa.list_(pa.int64()) if n == "times" else None)
                                        if n != "codes" else pa.array(v, pa.binary()) for n, v in out.items()]],
                    names=schema.names)

    return docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text).alias("_text")).mapInArrow(run, schema)


def train(rows: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Baum-Welch over ``rows`` (codes); the model and the log likelihood before each round.

    Texts are cut into pieces of ``PIECE`` tokens, all of which count; pieces that
    do not begin a text have a starting distribution of their own.  A round moves
    one number for each parameter and task, whatever the number of documents.
    """
    model, history = Model.initial(share, states), []
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        held = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            model, total, seen = held.value, None, 0.0
            for batch in batches:
                pieces, first = [], []
                for body in texts_in(batch.column(0)):
                    codes = np.frombuffer(body, dtype=np.uint16)
                    for a in range(0, len(codes), PIECE):
                        pieces.append(codes[a:a + PIECE])
                        first.append(a == 0)
                order = np.argsort([len(p) for p in pieces], kind="stable")
                for a in range(0, len(order), LANES):
                    part = order[a:a + LANES]
                    counts, log = expected_counts([pieces[i] for i in part], np.array(first)[part], model)
                    total, seen = counts if total is None else total + counts, seen + log
            if total is not None:
                total = np.append(total, seen)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "value"])

        sums = rows.select("codes").mapInArrow(run, "at long, value double").groupBy("at").agg(
            F.sum("value").alias("value")).toArrow()
        counts = np.zeros(model.emit.size + model.move.size + 2 * len(model.start) + 1)
        counts[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
        history.append(float(counts[-1]))
        model = model.next(counts[:-1], share)
    return model, history


def scored(docs: DataFrame, learn, id_col: str = "doc_id", text: str = "text", states: int = STATES,
           classes: int = CLASSES, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """_id, learnt, n_tokens, n_known, train_tokens, base_score, score of every document.

    ``learn`` is a condition on the column ``_id``: the rows to learn from.  Words
    are lower-cased in A-Z, separated by ASCII white space and followed by one end
    token; NULL texts are empty and have the end alone.  ``base_score`` is the sum
    of log10((c + 1) / (N + V + 1)), ``score`` the log10 probability under the
    model.  With nothing to learn from, N, V and all counts are 0.  Each row is
    scored on its own, also where ids repeat; other columns are ignored.
    """
    if classes >= 1 << 16:
        raise ValueError("classes are kept as 16-bit numbers")
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    counts = stored(word_counts(rows.where(learn), "_text"))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # At most classes + 1 rows.
    code = F.when(F.octet_length("word") == 0, F.lit(classes)).otherwise(F.pmod(F.xxhash64("word"), F.lit(classes)))
    per_class = np.zeros((classes + 1, 2))
    for r in counts.groupBy(code.cast("int").alias("code")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        per_class[r["code"]] = r["n"], r["v"]
    share = (per_class[:, 0] + 1) / (per_class[:, 0] + 1).sum()
    inside = np.log10(per_class.sum(axis=1) + 1)  # log10(N_class + V_class + 1)
    top = (counts.where(F.octet_length("word") <= LONGEST_HEAD).orderBy(F.desc("c"), "word").limit(head)).toArrow()
    frequent = (top.column("word").to_pylist(), top.column("c").to_numpy())
    table = stored(encoded(rows, frequent, classes, "_id", "_text").withColumn("row", F.monotonically_increasing_id()))
    model, _ = train(table.where(learn), share, states, rounds)
    held = spark.sparkContext.broadcast((model, inside))

    # Words outside the head: their counts by a join on the word, their sums by row.
    other = table.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    tail = (other.join(counts, "word").groupBy("row").agg(
        F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("tail_sum")))

    names = ["row", "_id", "n_tokens", "head_known", "head_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, inside = held.value
        for batch in batches:
            texts = [np.frombuffer(c, dtype=np.uint16) for c in texts_in(batch.column(len(names)))]
            chain = log_likelihoods(texts, model) / math.log(10)
            # The end's class holds the end alone, so it costs nothing within its class.
            words = np.array([inside[t[:-1]].sum() for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], pa.array(chain), pa.array(words)],
                                             names=[*names, "chain", "inside"])

    schema = T.StructType([*[table.schema[n] for n in names], T.StructField("chain", T.DoubleType(), False),
                           T.StructField("inside", T.DoubleType(), False)])
    found = table.select(*names, "codes").mapInArrow(run, schema).join(tail, "row", "left")
    known = F.col("head_known") + F.coalesce("tail_known", F.lit(0).cast("bigint"))
    values = F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0))
    ends = counts.where(F.octet_length("word") == 0).select("c").first()
    end_value = math.log10((ends["c"] if ends else 0) + 1)
    return found.select(
        "_id", learn.alias("learnt"), "n_tokens", known.alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (values - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        (F.col("chain") + values - F.lit(end_value) - F.col("inside")).alias("score"))


def language_scores(docs: DataFrame, modulus: int = 7, held_out: int = 2, id_col: str = "doc_id", text: str = "text",
                    **options) -> DataFrame:
    """``scored`` with the rows held out whose crc32(id as text) mod ``modulus`` is ``held_out``."""
    out = scored(docs, remainder("_id", modulus) != held_out, id_col, text, **options)
    return out.select(F.col("_id").alias(id_col), (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", "base_score", "score")
