"""LM scoring: a log-bilinear neural model trained by noise-contrastive estimation, in numpy inside Spark tasks.

Contexts of a few words predict the next word in two steps, through diagonal position weights and products of two matrices,
each normalised over all its outputs. The first step's outputs are the most frequent words and classes of all others, by the
bytes that they end with; the second's are a class's own frequent words and the rest of it. In that rest the smoothed counts of
the whole training corpus give the word. The product is a proper distribution over the vocabulary and one unknown word per class.

Corpus work is done in Spark: word counts are summed over all training rows; every training row trains a copy of the model
in its partition, and copies are averaged by a group-by at the end of each round; counts of words beyond a fixed number
of frequent ones reach the texts through a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, chunks, lowered, mix, span_hashes, text_buffers
from .common import cut, held_out

#: Outputs for single words (the end among them), outputs for classes of the rest, outputs inside a class, words of context, model width.
SINGLES, CLASSES, INNER, CONTEXT, WIDTH = 128, 128, 16, 4, 16
#: Words whose counts travel to every task; the rest are joined.
HEAD_WORDS = 1 << 18
#: Passes over disjoint halves of the training rows; copies are averaged after each.
ROUNDS = 2
#: Occurrences from which a class's word can have an output of its own.
OWN_LEAST = 10
#: Noise samples per token in the loss, noise words drawn per batch, tokens per batch, tokens of a class per batch, step sizes.
NOISE, DRAWN, BATCH, INNER_BATCH, STEP, INNER_STEP = 12.0, 96, 2048, 512, 0.25, 0.25
#: Bytes of text whose words are counted together.
COUNT_BYTES = 3 << 20
END = np.uint64(0)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, class and document of every token: lower-cased words, and after each document's last the end (hash 0)."""
    low = lowered(raw)
    words = Words(low, offsets)
    n = len(offsets) - 1
    hashed = span_hashes(low, words.starts, words.ends)
    tail = np.zeros(len(words.starts), np.uint64)
    for k in range(1, 4):
        at = words.ends - k
        tail = (tail << np.uint64(8)) | np.where(at >= words.starts, low[np.maximum(at, 0)], 0).astype(np.uint64)
    with np.errstate(over="ignore"):
        kind = (mix(tail) % np.uint64(CLASSES)).astype(np.int64)
    at = words.first[1:] + np.arange(n)  # where ends go
    total = len(hashed) + n
    is_end = np.zeros(total, bool)
    is_end[at] = True
    h, c = np.zeros(total, np.uint64), np.zeros(total, np.int64)
    h[~is_end], c[~is_end] = np.where(hashed == END, np.uint64(1), hashed), kind
    return h, c, np.repeat(np.arange(n), words.count + 1)


class Parameters:
    """Context vectors, output vectors, position weights and biases, then the classes' inner vectors and biases, as one flat vector with views."""

    def __init__(self, flat: np.ndarray):
        k, d = SINGLES + CLASSES, WIDTH
        self.flat = flat
        shapes = ((k, d), (k, d), (CONTEXT, d), (k,), (CLASSES, INNER, d), (CLASSES, INNER))
        ends = np.cumsum([0, *(math.prod(x) for x in shapes)])
        views = [flat[i:j].reshape(x) for i, j, x in zip(ends[:-1], ends[1:], shapes)]
        self.context, self.output, self.position, self.bias, self.inner, self.inner_bias = views
        self.first_step = int(ends[4])

    @staticmethod
    def size() -> int:
        k, d = SINGLES + CLASSES, WIDTH
        return 2 * k * d + CONTEXT * d + k + CLASSES * INNER * (d + 1)

    @classmethod
    def start(cls, unigram: np.ndarray, inner_unigram: np.ndarray) -> Parameters:
        k, d = SINGLES + CLASSES, WIDTH
        out = cls(np.zeros(cls.size()))
        draw = np.random.default_rng(5)
        out.context[:], out.output[:] = draw.normal(0, 0.3, (k, d)), draw.normal(0, 0.1, (k, d))
        out.position[:] = 1.0 / CONTEXT
        out.bias[:], out.inner_bias[:] = np.log(unigram), np.log(inner_unigram)
        return out


def outputs(h: np.ndarray, c: np.ndarray, singles: np.ndarray) -> np.ndarray:
    """The model's output of each token: singles is sorted, its place is the output; classes come after all singles."""
    at = np.minimum(np.searchsorted(singles, h), len(singles) - 1)
    return np.where(singles[at] == h, at, SINGLES + c)


def contexts(out: np.ndarray, doc: np.ndarray, end: int) -> np.ndarray:
    """The outputs of the words before each token, nearest first; before the first word stands the end."""
    found = np.full((CONTEXT, len(out)), end)
    for k in range(1, CONTEXT + 1):
        same = doc[k:] == doc[:-k]
        found[k - 1, k:][same] = out[:-k][same]
    return found


def _gathered(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by index."""
    d = values.shape[1]
    return np.bincount((index[:, None] * d + np.arange(d)).ravel(), values.ravel(), n * d).reshape(n, d)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def predictions(p: Parameters, context: np.ndarray) -> np.ndarray:
    """The vector that each context predicts."""
    return sum(p.context[c] * w for c, w in zip(context, p.position))


class Trainer:
    """Noise-contrastive steps with per-parameter step sizes, in single precision."""

    def __init__(self, start: np.ndarray, noise: np.ndarray, inner_noise: np.ndarray, seed: int):
        self.p = Parameters(start.astype(np.float32))
        self.log_noise, self.log_inner_noise = np.log(NOISE * noise).astype(np.float32), np.log(NOISE * inner_noise).astype(np.float32)
        self.cumulative, self.draw = np.cumsum(noise), np.random.default_rng(seed)
        self.grown = Parameters(np.full(len(start), 1e-3, np.float32))
        self.seen = 0

    def _move(self, values: np.ndarray, grown: np.ndarray, slope: np.ndarray, size: float) -> None:
        grown += slope * slope
        values -= size * slope / np.sqrt(grown)

    def step(self, target: np.ndarray, context: np.ndarray) -> None:
        """One step of the first outputs, for tokens and their contexts."""
        p, k, n = self.p, SINGLES + CLASSES, len(target)
        drawn = np.minimum(np.searchsorted(self.cumulative, self.draw.random(DRAWN)), k - 1)
        vectors = p.context[context]
        predicted = np.einsum("cnd,cd->nd", vectors, p.position)
        own, noise = p.output[target], p.output[drawn]
        real = _sigmoid((predicted * own).sum(1) + p.bias[target] - self.log_noise[target]) - 1
        false = _sigmoid(predicted @ noise.T + (p.bias[drawn] - self.log_noise[drawn])) * np.float32(NOISE / DRAWN)
        back = real[:, None] * own + false @ noise
        slope = Parameters(np.zeros_like(p.flat))
        slope.output[:] = _gathered(target, real[:, None] * predicted, k)
        np.add.at(slope.output, drawn, false.T @ predicted)
        slope.bias[:] = np.bincount(target, real, k)
        np.add.at(slope.bias, drawn, false.sum(0))
        slope.context[:] = _gathered(context.ravel(), (back[None] * p.position[:, None]).reshape(-1, WIDTH), k)
        slope.position[:] = np.einsum("nd,cnd->cd", back, vectors)
        first = slice(0, p.first_step)
        self._move(p.flat[first], self.grown.flat[first], slope.flat[first] / np.float32(n), STEP)
        self.seen += n

    def inner_steps(self, kind: np.ndarray, place: np.ndarray, context: np.ndarray) -> None:
        """Steps inside the classes, for tokens by class and place in it; all of a class's outputs are its noise, by their shares."""
        predicted = predictions(self.p, context)
        order = np.argsort(kind, kind="stable")
        edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            log_noise = self.log_inner_noise[c]
            for a in range(edges[c], edges[c + 1], INNER_BATCH):
                at = order[a : min(a + INNER_BATCH, edges[c + 1])]
                x, t, rows = predicted[at], place[at], np.arange(len(at))
                chance = _sigmoid(x @ self.p.inner[c].T + (self.p.inner_bias[c] - log_noise))
                slope = chance * np.exp(log_noise)
                slope[rows, t] += chance[rows, t] - 1
                slope /= np.float32(INNER_BATCH)  # a few tokens move little
                self._move(self.p.inner[c], self.grown.inner[c], slope.T @ x, INNER_STEP)
                self._move(self.p.inner_bias[c], self.grown.inner_bias[c], slope.sum(0), INNER_STEP)


def _log_softmax_at(score: np.ndarray, target: np.ndarray) -> np.ndarray:
    own = score[np.arange(len(target)), target].copy()
    top = score.max(axis=1, keepdims=True)
    score -= top
    np.exp(score, out=score)
    return own - top[:, 0] - np.log(score.sum(axis=1))


def log_probabilities(p: Parameters, target: np.ndarray, place: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Normalised natural-log probability of each target output, and of its place where it is a class, in batches of matrix products."""
    found = np.empty(len(target))
    p = Parameters(p.flat.astype(np.float32))
    output, weighted = p.output.T.copy(), [p.context * w for w in p.position]
    predicted = np.empty((len(target), WIDTH), np.float32)
    for a in range(0, len(target), 2048):
        b = min(a + 2048, len(target))
        predicted[a:b] = sum(w[c[a:b]] for w, c in zip(weighted, context))
        score = predicted[a:b] @ output
        score += p.bias
        found[a:b] = _log_softmax_at(score, target[a:b])
    order = np.argsort(target, kind="stable")
    edges = np.searchsorted(target[order], np.arange(SINGLES, SINGLES + CLASSES + 1))
    for c in range(CLASSES):
        at = order[edges[c] : edges[c + 1]]
        if len(at):
            found[at] += _log_softmax_at(predicted[at] @ p.inner[c].T + p.inner_bias[c], place[at])
    return found


class Model:
    """What scoring needs: totals, single words, the classes' own words and their places, frequent words' counts, totals of the classes' rests, parameters."""

    NAMES = ("n", "v", "singles", "own", "places", "head", "counts", "class_n", "class_v", "flat")

    def __init__(self, n: int, v: int, singles: np.ndarray, own: np.ndarray, places: np.ndarray, head: np.ndarray, counts: np.ndarray, class_n: np.ndarray, class_v: np.ndarray, flat: np.ndarray):
        self.n, self.v, self.singles, self.own, self.places, self.head, self.counts = n, v, singles, own, places, head, counts
        self.class_n, self.class_v, self.flat = class_n, class_v, flat

    def place(self, h: np.ndarray) -> np.ndarray:
        """The place of each word in its class; 0 is the rest's."""
        if not len(self.own):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
        return np.where(self.own[at] == h, self.places[at], 0)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffers(batch.column(0))
        for _, _, part, at in chunks(raw, offsets, COUNT_BYTES):
            h, c, _ = tokens(part, at)
            keys, where, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c[where].astype(np.int32)), pa.array(n.astype(np.int64))], names=["h", "kind", "n"])


def count_words(training: DataFrame) -> DataFrame:
    """h, kind, c of every distinct training token, kept in the shared folder."""
    counted = training.select("text").mapInArrow(_word_counts, "h long, kind int, n long")
    return cut(counted.groupBy("h").agg(F.first("kind").alias("kind"), F.sum("n").alias("c")))


def _frequent(vocabulary: DataFrame, most: int) -> DataFrame:
    """The words above the least count that at most ``most`` words reach, by a histogram of counts in steps of a percent; and the end."""
    step = F.floor(F.log(F.col("c").cast("double")) * 100)
    room, least = most, 0
    for row in vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("c").alias("c")).orderBy(F.desc("step")).collect():
        room -= row["words"]
        if room < 0:
            break
        least = row["c"]
    frequent = F.col("c") >= least if least else F.lit(False)
    return vocabulary.where(frequent | (F.col("h") == int(END))).select("h", "kind", "c")


def spark_rows(like: DataFrame, hashes: list[int]) -> DataFrame:
    """A table of the given hashes: those of the model's own words, a fixed number at most."""
    return like.sparkSession.createDataFrame([(h,) for h in hashes], "h long")


def train(documents: DataFrame, modulus: int = 5, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """A model of all rows outside the held-out fold, and the table of all training tokens' counts (h, c)."""
    training = documents.where(~held_out("doc_id", modulus)).select("doc_id", "text")
    vocabulary = count_words(training)
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = _frequent(vocabulary, HEAD_WORDS).toPandas().sort_values(["c", "h"], ascending=[False, True])
    keys = head["h"].to_numpy(np.int64).view(np.uint64)
    singles = np.unique(np.concatenate([[END], keys[keys != END][: SINGLES - 1]]).astype(np.uint64))
    apart = head.iloc[np.flatnonzero(~np.isin(keys, singles) & (head["c"].to_numpy(np.int64) >= OWN_LEAST))]  # no outputs of the first step
    apart = apart.assign(place=apart.groupby("kind").cumcount() + 1)
    apart = apart[apart["place"] < INNER].sort_values("h", key=lambda h: h.to_numpy(np.int64).view(np.uint64))
    own, places = apart["h"].to_numpy(np.int64).view(np.uint64), apart["place"].to_numpy(np.int64)
    class_n, class_v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    listed = spark_rows(vocabulary, [*singles.view(np.int64).tolist(), *own.view(np.int64).tolist()])
    for row in vocabulary.join(F.broadcast(listed), "h", "left_anti").groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        class_n[row["kind"]], class_v[row["kind"]] = row["n"], row["v"]
    inner_n = np.zeros((CLASSES, INNER))
    inner_n[:, 0] = class_n
    inner_n[apart["kind"].to_numpy(np.int64), places] = apart["c"].to_numpy(float)
    order = np.argsort(keys)
    keys, counts = keys[order], head["c"].to_numpy(np.int64)[order]
    single_n = np.zeros(SINGLES, np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, singles), len(keys) - 1)
        single_n[: len(singles)] = np.where(keys[at] == singles, counts[at], 0)
    unigram = (np.concatenate([single_n, inner_n.sum(1)]) + 0.5) / (n + 0.5 * (SINGLES + CLASSES))
    taken = inner_n > 0
    taken[:, 0] = True
    inner_unigram = np.where(taken, inner_n + 0.5, 1e-9)  # places that no word takes have next to no share
    inner_unigram /= inner_unigram.sum(1, keepdims=True)
    model = Model(n, v, singles, own, places, keys, counts, class_n, class_v, Parameters.start(unigram, inner_unigram).flat)
    for turn in range(rounds):
        part = training.where(F.pmod(F.xxhash64("doc_id", F.lit("turn")), F.lit(rounds)) == turn) if rounds > 1 else training
        model.flat = _round(part, model, unigram, inner_unigram, turn)
    return model, vocabulary.select("h", "c")


def _round(training: DataFrame, model: Model, unigram: np.ndarray, inner_unigram: np.ndarray, turn: int) -> np.ndarray:
    """The parameters after every partition has trained a copy: copies averaged by the tokens that they have seen."""
    start, singles = model.flat, model.singles
    end = int(np.searchsorted(singles, END))

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(start, unigram, inner_unigram, 17 + turn)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            for _, _, part, at in chunks(raw, offsets):
                h, c, doc = tokens(part, at)
                out = outputs(h, c, singles)
                before = contexts(out, doc, end)
                order = trainer.draw.permutation(len(out))
                for a in range(0, len(order), BATCH):
                    chosen = order[a : a + BATCH]
                    trainer.step(out[chosen], before[:, chosen])
                inside = order[out[order] >= SINGLES]
                trainer.inner_steps(out[inside] - SINGLES, model.place(h[inside]), before[:, inside])
        if trainer.seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(start), dtype=np.int32)), pa.array(trainer.p.flat.astype(float) * trainer.seen), pa.array(np.full(len(start), float(trainer.seen)))],
                names=["i", "value", "weight"],
            )

    averaged = (
        training.select("text").mapInArrow(trained, "i int, value double, weight double")
        .groupBy("i").agg((F.sum("value") / F.sum("weight")).alias("value")).toPandas()
    )
    out = start.copy()
    out[averaged["i"].to_numpy()] = averaged["value"].to_numpy()
    return out


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc_id, h, word, tf, n_tokens, n_known, base, score): one per text (word false), then one per rarer word of it."""
    p, end = Parameters(model.flat), int(np.searchsorted(model.singles, END))
    base_total = math.log10(model.n + 0.5 * (model.v + 1))
    class_total = np.log10(model.class_n + 0.5 * (model.class_v + 1))
    for batch in batches:
        key = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
        raw, offsets = text_buffers(batch.column(2))
        for a, b, part, at in chunks(raw, offsets):
            n = b - a
            h, c, doc = tokens(part, at)
            out = outputs(h, c, model.singles)
            place = model.place(h)
            log_p = log_probabilities(p, out, place, contexts(out, doc, end)) / math.log(10)
            single = (out < SINGLES) | (place > 0)  # outputs of their own
            where = np.minimum(np.searchsorted(model.head, h), max(0, len(model.head) - 1))
            known = model.head[where] == h if len(model.head) else np.zeros(len(h), bool)
            count = np.where(known, model.counts[where], 0) if len(model.head) else np.zeros(len(h))
            log_c = np.log10(count + 0.5)
            settled = known | single  # tokens whose count is decided here; a rarer word's comes by the join
            base = np.bincount(doc, np.where(settled, log_c, 0.0) - base_total, n)
            within = np.where(single, 0.0, np.where(settled, log_c, 0.0) - class_total[np.where(single, 0, np.maximum(out - SINGLES, 0))])
            score = np.bincount(doc, log_p + within, n)
            number = np.bincount(doc, minlength=n).astype(np.int64)
            n_known = np.bincount(doc, known & (count > 0), n).astype(np.int64)
            rare = ~settled
            order = np.lexsort((h[rare], doc[rare]))
            d, w = doc[rare][order], h[rare][order]
            new = np.flatnonzero(np.concatenate([np.ones(min(1, len(d)), bool), (d[1:] != d[:-1]) | (w[1:] != w[:-1])]))
            tf = np.diff(np.append(new, len(d)))
            own = [pa.array(key[a:b]), batch.column(1).slice(a, n), pa.array(key[a:b]), pa.array([False] * n), pa.nulls(n, pa.int64())]
            names = ["key", "doc_id", "h", "word", "tf", "n_tokens", "n_known", "base", "score"]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (number, n_known, base, score))], names=names)
            if len(new):
                m, of = len(new), d[new]
                own = [pa.array(key[a:b][of]), batch.column(1).slice(a, n).take(pa.array(of)), pa.array(w[new].view(np.int64)), pa.array([True] * m), pa.array(tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names=names)


def score_texts(documents: DataFrame, model: Model, counts: DataFrame, modulus: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row's text.

    A null text counts as empty and has one token, the end; a very long text is scored whole. Repeated rows each get a result, an
    empty table gives none; with no training rows every word is unknown. Columns but doc_id and text are ignored. Scores are
    log10; score is that of the neural model, base_score that of smoothed single-word counts.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model.__dict__)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scored(batches, Model(**{k: shared.value[k] for k in Model.NAMES}))

    keyed = documents.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = keyed.mapInArrow(scored, "key long, doc_id long, h long, word boolean, tf long, n_tokens long, n_known long, base double, score double")
    # A text's own row goes along under its key, so that all rows are computed once and meet again in one group.
    counted = rows.join(counts.select("h", "c", F.lit(True).alias("word")), ["h", "word"], "left")
    c = F.coalesce("c", F.lit(0))
    out = counted.groupBy("key", "doc_id").agg(
        F.sum((~F.col("word")).cast("long")).alias("copies"),
        *[F.max(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")],
        F.sum(F.when(F.col("word"), F.col("tf") * F.log10(c + 0.5))).alias("log_c"),
        F.sum(F.when(F.col("word") & (c > 0), F.col("tf"))).alias("known"),
    )
    one = F.coalesce(F.col("log_c") / F.col("copies"), F.lit(0.0))
    known = F.coalesce(F.expr("known div copies"), F.lit(0))
    return out.select(
        "doc_id", held_out("doc_id", modulus).alias("held_out"), "n_tokens", (F.col("n_known") + known).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") + one).alias("base_score"), (F.col("score") + one).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    ).drop("_copy")
