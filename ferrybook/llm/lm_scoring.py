"""Scoring texts with a log-bilinear language model.

Tokens are lower-cased words and one end per text. A token's class is the word itself
for the most frequent words and the end, and the last two bytes for all others. The
model predicts the class from the two classes before it: two context matrices turn
their embeddings into a vector, whose products with the output embeddings, plus a
bias, are the scores of all classes. It is trained in numpy by noise-contrastive
estimation. Within a class, words have their smoothed share of the training counts.

What training needs from the corpus, the counts of words and of class triples, is
gathered over all training documents. The triples are bounded by the classes, so the
driver can hold them whatever the size of the corpus, and the expectation over data
and noise is exact rather than sampled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrybook.llm.common import write_stage
from ferrybook.llm.words import Chunk, as_long, chunks, segment_of, space_table, split_words

CLASS_BITS = 7
CLASSES = 1 << CLASS_BITS
#: Class 0 is the end; then come single words, then endings, then all other words.
SINGLE, ENDINGS = 63, 63
FIRST_ENDING = 1 + SINGLE
OTHER = CLASSES - 1
#: Words whose counts every task has at hand: the most frequent ones, 4 MB. The counts
#: of all other words are joined.
AT_HAND = 1 << 18
#: The end's stand-in among word hashes.
END = np.uint64(0)
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 1 << 20
DIMENSIONS, NOISE, STEPS, RATE = 32, 32.0, 240, 0.05
#: Training takes the contexts of so many first classes at a time.
BLOCK = 8


def endings(words) -> np.ndarray:
    """The last two bytes of each word as a number (the only one of a one-byte word)."""
    last = words.data[words.ends - 1].astype(np.int64)
    before = words.data[np.maximum(words.ends - 2, 0)].astype(np.int64)
    return np.where(words.ends - words.starts > 1, before * 256 + last, last)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def merged() -> tuple[np.ndarray, ...]:
        word, n, ending = (np.concatenate(x) for x in zip(*held))
        word, first, back = np.unique(word, return_index=True, return_inverse=True)
        return word, np.bincount(back, weights=n).astype(np.int64), ending[first]

    def batch_of(word, n, ending) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(as_long(word)), pa.array(n, pa.int64()), pa.array(ending, pa.int64())],
            names=["word", "n", "ending"],
        )

    separators = space_table()
    for batch in batches:
        for chunk in chunks(batch.column(0)):
            words = split_words(chunk, separators)
            word, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
            held.append((word, n, endings(words)[first]))
            end = np.array([END]), np.array([len(chunk)]), np.zeros(1, np.int64)
            held.append(end)
            if sum(len(x[0]) for x in held) > HELD_WORDS:
                held = [merged()]
                if len(held[0][0]) > HELD_WORDS // 2:
                    yield batch_of(*held[0])
                    held = []
    if held:
        yield batch_of(*merged())


@dataclass
class Classes:
    """Which class a word has: sorted hashes of the single words, and a class per ending."""

    words: np.ndarray
    word_class: np.ndarray
    ending_class: np.ndarray

    def of(self, hashes: np.ndarray, ending: np.ndarray) -> np.ndarray:
        found = self.ending_class[ending].astype(np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            found = np.where(self.words[at] == hashes, self.word_class[at], found)
        return found


def _stream(chunk: Chunk, words, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens of a chunk, ends included, the context of each as one
    number, and the places of the words among the tokens. Texts begin after two ends."""
    row = segment_of(words.offsets)
    place = np.arange(len(row)) + row
    stream = np.zeros(len(row) + len(chunk), dtype=np.int64)
    stream[place] = classes.of(words.hashes, endings(words))
    one, two = np.zeros_like(stream), np.zeros_like(stream)
    one[1:], two[2:] = stream[:-1], stream[:-2]
    first = words.offsets[:-1] + np.arange(len(chunk))
    two[first] = 0
    second = first[np.diff(words.offsets) > 0] + 1
    two[second] = 0
    return stream, two * CLASSES + one, place


def _count_triples(classes: Classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES**3, dtype=np.int64)
        separators = space_table()
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                stream, context, _ = _stream(chunk, split_words(chunk, separators), classes)
                counts += np.bincount(context * CLASSES + stream, minlength=len(counts))
        code = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(counts[code])], names=["code", "n"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a task as one, compressed: the driver gets some MB instead of 2**21 rows."""
    parts = [[batch.column(c).to_numpy(zero_copy_only=False) for c in range(2)] for batch in batches]
    if parts:
        code, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(code)
        data = code[order].astype(np.int32), n[order].astype(np.int64)
        columns = [pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in data]
        yield pa.RecordBatch.from_arrays(columns, names=["codes", "counts"])


def train(counts: np.ndarray, valid: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Normalised log10 probabilities [context, class] from triple counts.

    The objective is that of noise-contrastive estimation with the smoothed class
    frequencies as noise. Data and noise are averaged over exactly, as all contexts
    and classes fit one matrix product. It is formed in blocks of contexts.
    """
    weights = counts.reshape(CLASSES * CLASSES, CLASSES).astype(np.float32)
    weights /= np.float32(max(counts.sum(), 1))
    of_context = weights.sum(axis=1, keepdims=True)
    noise = weights.sum(axis=0) + 1e-6
    noise = noise / noise.sum()
    log_noise = np.log(NOISE * noise)
    rng = np.random.default_rng(7)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    eye = np.eye(DIMENSIONS, dtype=np.float32)
    params = {
        "context": draw(CLASSES, DIMENSIONS),
        "two": eye * np.float32(0.5),
        "one": eye.copy(),
        "output": draw(CLASSES, DIMENSIONS),
        "bias": np.log(noise).astype(np.float32),
    }
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    log_noise, noise_weight = log_noise.astype(np.float32), (NOISE * noise).astype(np.float32)

    def blocks() -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """The contexts by first classes: first of these, rows, predicted vectors, scores."""
        two, one = params["context"] @ params["two"], params["context"] @ params["one"]
        for a in range(0, CLASSES, BLOCK):
            predicted = (two[a : a + BLOCK, None, :] + one[None, :, :]).reshape(-1, DIMENSIONS)
            score = predicted @ params["output"].T + params["bias"]
            yield a, slice(a * CLASSES, (a + BLOCK) * CLASSES), predicted, score

    for step in range(1, steps + 1 if counts.any() else 1):
        to_two, to_one = (np.zeros_like(params["context"]) for _ in range(2))
        to_output, to_bias = np.zeros_like(params["output"]), np.zeros_like(params["bias"])
        for a, rows, predicted, score in blocks():
            from_data = 1 / (1 + np.exp(np.clip(log_noise - score, -30, 30)))
            pull = weights[rows] * (1 - from_data) - of_context[rows] * noise_weight * from_data
            back = (pull @ params["output"]).reshape(-1, CLASSES, DIMENSIONS)
            to_two[a : a + BLOCK] = back.sum(axis=1)
            to_one += back.sum(axis=0)
            to_output += pull.T @ predicted
            to_bias += pull.sum(axis=0)
        gradients = {
            "context": to_two @ params["two"].T + to_one @ params["one"].T,
            "two": params["context"].T @ to_two,
            "one": params["context"].T @ to_one,
            "output": to_output,
            "bias": to_bias,
        }
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for name, gradient in gradients.items():  # Adam
            mean, square = state[name]
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient * gradient - square)
            fixed = mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
            params[name] = params[name] + np.float32(rate) * fixed
    table = np.empty_like(weights)
    for _, rows, _, score in blocks():
        score = np.where(valid[None, :], score, -np.inf)
        score -= score.max(axis=1, keepdims=True)
        score -= np.log(np.exp(score).sum(axis=1, keepdims=True))
        table[rows] = score / np.log(10)
    return table


@dataclass
class Model:
    """All that a scoring task needs; its size does not depend on the corpus."""

    classes: Classes
    log_table: np.ndarray  # [context, class]
    log_class_mass: np.ndarray  # per class: log10 of the smoothed count within it
    hot_words: np.ndarray  # sorted hashes
    hot_logs: np.ndarray  # log10(count + 0.5)
    end_log: float
    total: int
    distinct: int


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the texts in column ``text``, and the counts of all their words."""
    counts = docs.select("text").mapInArrow(_count_words, "word long, n long, ending long")
    counts = write_stage(
        counts.groupBy("word").agg(F.sum("n").alias("n"), F.min("ending").alias("ending"))
    )
    end = F.col("word") == F.lit(int(END))
    total, distinct, n_end = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("word"), F.coalesce(F.max(F.when(end, F.col("n"))), F.lit(0))
    ).first()
    hot = counts.filter(~end).orderBy(F.desc("n"), "word").limit(AT_HAND).select("word", "n").toPandas()
    single = hot["word"].to_numpy(np.int64)[:SINGLE].view(np.uint64)
    rest = counts.filter(~end)
    if len(single):
        rest = rest.filter(~F.col("word").isin([int(w) for w in as_long(single)]))
    by_ending = rest.groupBy("ending").agg(F.sum("n").alias("n"), F.count("word").alias("words"))
    by_ending = by_ending.toPandas().sort_values(["n", "ending"], ascending=[False, True])  # 2**16 rows

    ending_class = np.full(1 << 16, OTHER, dtype=np.uint8)
    top = by_ending["ending"].to_numpy(np.int64)[:ENDINGS]
    ending_class[top] = FIRST_ENDING + np.arange(len(top))
    order = np.argsort(single)
    classes = Classes(single[order], (1 + np.arange(len(single)))[order], ending_class)
    # Each class has its words and one unknown word; single words are all of theirs.
    mass = np.full(CLASSES, 0.5)
    of_row = ending_class[by_ending["ending"].to_numpy(np.int64)]
    np.add.at(mass, of_row, by_ending["n"].to_numpy(float) + 0.5 * by_ending["words"].to_numpy(float))
    valid = np.ones(CLASSES, dtype=bool)
    valid[1 + len(single) : FIRST_ENDING] = False

    triples = docs.select("text").mapInArrow(_count_triples(classes), "code long, n long")
    triples = triples.groupBy("code").agg(F.sum("n").alias("n"))  # 2**21 rows at most
    table = np.zeros(CLASSES**3, dtype=np.int64)
    for codes, n in triples.mapInArrow(_packed, "codes binary, counts binary").collect():
        codes, n = zlib.decompress(codes), zlib.decompress(n)
        table[np.frombuffer(codes, np.int32)] = np.frombuffer(n, np.int64)
    hot_words = hot["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot_words)
    model = Model(
        classes,
        train(table, valid),
        np.log10(mass),
        hot_words[order],
        np.log10(hot["n"].to_numpy(float) + 0.5)[order],
        float(np.log10(n_end + 0.5)),
        int(total),
        int(distinct),
    )
    return model, counts


def _score(shared):
    """Sums per text that need no other count, and the words whose count is joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = shared.value
        model = Model(**fields | {"classes": Classes(**fields["classes"])})
        separators = space_table()
        task = TaskContext.get().partitionId() << 40
        seen = 0
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                words = split_words(chunk, separators)
                n = len(chunk)
                stream, context, place = _stream(chunk, words, model.classes)
                row = segment_of(words.offsets)
                row_of_token = np.empty(len(stream), dtype=np.int64)
                row_of_token[place] = row
                row_of_token[words.offsets[1:] + np.arange(n)] = np.arange(n)
                by_row = lambda at, w=None: np.bincount(at, weights=w, minlength=n)
                lm = by_row(row_of_token, model.log_table[context, stream].astype(np.float64))
                own = stream[place]
                open_class = own >= FIRST_ENDING
                lm -= by_row(row[open_class], model.log_class_mass[own[open_class]])
                hot = np.zeros(len(row), dtype=bool)
                logs = np.zeros(len(row))
                if len(model.hot_words):
                    at = np.minimum(
                        np.searchsorted(model.hot_words, words.hashes), len(model.hot_words) - 1
                    )
                    hot = model.hot_words[at] == words.hashes
                    logs[hot] = model.hot_logs[at[hot]]
                base = by_row(row, logs) + model.end_log
                lm += by_row(row[open_class], logs[open_class])
                known = by_row(row[hot]).astype(np.int64) + (model.total > 0)
                # Rare words, each once per text. They are all of open classes.
                rare = np.flatnonzero(~hot)
                order = rare[np.lexsort((words.hashes[rare], row[rare]))]
                word, owner = words.hashes[order], row[order]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
                heads = np.flatnonzero(new)
                times = np.diff(np.append(heads, len(order)))
                pairs = pa.StructArray.from_arrays(
                    [pa.array(as_long(word[heads])), pa.array(times, pa.int64())], names=["word", "n"]
                )
                limits = np.searchsorted(owner[heads], np.arange(n + 1))
                ids = batch.column(0).slice(chunk.first, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        batch.column(1).slice(chunk.first, n),
                        pa.array(task + seen + np.arange(n), pa.int64()),
                        pa.array(np.diff(words.offsets) + 1, pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(base),
                        pa.array(lm),
                        pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pairs),
                    ],
                    names=["id", "held_out", "row", "n_tokens", "n_known", "base", "lm", "rare"],
                )
                seen += n

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row under a model of the rows that are not held out.

    A row is held out if the CRC32 of its id as text leaves 1 when divided by 5. Returns
    ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score, the
    log10 probabilities of the text under the smoothed word counts and under the model.

    A null text is empty: it has one token, its end. A null id counts as the empty text
    for holding out. Repeated rows are all scored. With no training rows every class is
    as likely; an empty table gives an empty result. Other columns are not read.

    Whole texts are scored. Each task has the counts of the most frequent words at
    hand, a table of fixed size; those of all other words come by a join on the word,
    to which every text sends each of its rare words once.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 1
    docs = docs.select(
        F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text")
    )
    model, counts = fit(docs.filter("not held_out"))
    context = docs.sparkSession.sparkContext
    kind = docs.schema["id"].dataType.simpleString()
    scored = write_stage(
        docs.mapInArrow(
            _score(context.broadcast(asdict(model))),
            f"id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double,"
            " lm double, rare array<struct<word:long,n:long>>",
        )
    )
    log = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.5))
    rare = (
        scored.select("row", F.inline("rare"))
        .join(counts.select("word", F.col("n").alias("c")), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("n") * log).alias("logs"),
            F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("known"),
        )
    )
    size = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.drop("rare").join(rare, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(size)).alias("base_score"),
        (F.col("lm") + logs).alias("score"),
    )
