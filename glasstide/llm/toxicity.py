"""Toxicity: noisy-channel deobfuscation of words, then a score of the restored text.

Words of plain letters have one reading. Any other word (digits or symbols inside, letters drawn out) is a lattice, however long:
each character may stand for letters, a run may stand for one or two letters, separators for nothing. A stretch of pieces of
one or two letters is one lattice too, in which each gap may be nothing or the end of a word. Viterbi picks the likeliest path
under a character bigram model. Restored words and their first letters are then looked up in two tables of telling features
learned from labelled documents (restored alike): features whose presence tells, and features whose density does, being many times as
dense in the toxic documents that have them as in the others that do. A feature is judged by the documents that have it, so that
it need not tell anything about other languages' documents. Both kinds of evidence give the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Words, chunks, lowered, span_hashes, text_buffers, window_hashes
from .common import cut, without_dots
from .training import labelled_texts

# Letters that a digit or symbol may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
OPENING = np.frombuffer(b"$@", np.uint8)
SEPARATORS = frozenset("._-*~'`^ /\\,:;")
#: Log10 prices of the channel: a stand-in, a dropped separator, each letter of a run that is dropped (1 more for one of two).
PRICE_STAND, PRICE_DROP, PRICE_RUN = -0.4, -0.2, -0.2
#: Bytes of a word's beginning that serve as features besides the whole word.
PREFIXES = (4, 5, 6)
#: Size of the model: features kept (the most telling) and letter pairs (the commonest); no text is left out by these.
FEATURES, LETTER_PAIRS = 4_000, 10_000
#: Bonferroni-corrected chance below which a feature counts as telling.
CHANCE = 1e-3
#: How many times as dense a feature of density is in toxic documents, at least; and the evidence of density that counts at most.
DENSER, MOST_DENSITY = 4.0, 25.0
#: Evidence of density from which on a document counts as dense when features are confirmed.
DENSE = 2.0

LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


class CharacterModel:
    """Log10 probabilities of a letter after another; "^" opens and "$" closes a word. Unseen pairs get a floor."""

    def __init__(self, pairs: dict[str, float]):
        self.log = {}
        totals: dict[str, float] = {}
        for pair, n in pairs.items():
            totals[pair[0]] = totals.get(pair[0], 0.0) + n
        for pair, n in pairs.items():
            self.log[pair] = float(np.log10((n + 0.1) / (totals[pair[0]] + 4)))
        self.floor = -3.5

    def __call__(self, a: str, b: str) -> float:
        return self.log.get(a + b, self.floor)


def restore(word: str, model: CharacterModel) -> str:
    """The likeliest plain words behind word, in which a space may be nothing or a word's end; plain letters without long runs stay.

    Work grows in proportion to the length: paths are linked lists, one for each letter that a path may end with.
    """
    runs: list[list] = []
    for c in word:
        if runs and runs[-1][0] == c:
            runs[-1][1] += 1
        else:
            runs.append([c, 1])
    paths: dict[str, tuple[float, tuple]] = {"^": (0.0, ())}
    for c, n in runs:
        if c.isalpha():
            readings = [(c * min(n, 2), PRICE_RUN * max(0, n - 2)), *([(c, PRICE_RUN * (n - 1) - (n == 2))] if n > 1 else [])]
        elif c == " ":
            readings = [("", 0.0), (" ", 0.0)]
        else:
            readings = [(x * k, PRICE_STAND + PRICE_RUN * abs(n - k)) for x in STANDS_FOR.get(c, "") for k in ((1, 2) if n > 1 else (1,))]
            if c in SEPARATORS or not readings:
                readings.append(("", PRICE_DROP * n))
        step: dict[str, tuple[float, tuple]] = {}
        for last, (score, text) in paths.items():
            for reading, price in readings:
                s, a = score + price, last
                if reading == " ":
                    s, a = s + model(a, "$"), "^"
                else:
                    for x in reading:
                        s += model(a, x)
                        a = x
                if a not in step or s > step[a][0]:
                    step[a] = (s, (text, reading))
        paths = step
    _, path = max(((s + model(a, "$"), a, t) for a, (s, t) in paths.items()), key=lambda x: x[:2])[0::2]
    out = []
    while path:
        path, reading = path
        out.append(reading)
    return "".join(reversed(out))


class RestoredWords:
    """Restored, lower-cased words of a run of documents, as bytes: raw, starts, ends, doc."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, model: CharacterModel | None):
        low = lowered(raw)
        words = Words(low, offsets)
        starts, ends, doc = words.starts.copy(), words.ends.copy(), words.doc()
        solid = LETTER[low] | DIGIT[low]
        # Trim to the first and last letter or digit.
        before = np.concatenate([[0], np.cumsum(solid)])
        has = before[ends] > before[starts]
        at = np.flatnonzero(solid)
        opens, ends, doc = starts[has], ends[has], doc[has]
        starts = opens
        if len(at):
            starts, ends = at[before[opens]], at[before[ends] - 1] + 1
        odd_byte = np.concatenate([[0], np.cumsum(~LETTER[low])])
        triple = np.zeros(len(low), bool)
        triple[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
        runs = np.concatenate([[0], np.cumsum(triple)])
        length = ends - starts
        odd = ((odd_byte[ends] > odd_byte[starts]) & (before[ends] - before[starts] > 1)) | ((length > 2) & (runs[ends] > runs[np.minimum(starts + 2, ends)]))
        # One sign that often opens a disguised word is read as its letter too; the word without it stays as well.
        signed = (starts > opens) & np.isin(low[np.maximum(starts - 1, 0)], OPENING) & ~odd if len(starts) else odd
        letter = 1 + (low[starts] >= 128) if len(starts) else length  # bytes of a first letter
        extra: list[tuple[int, str]] = []
        if model is not None:
            read = lambda i, j: low[i:j].tobytes().decode(errors="ignore")
            for i in np.flatnonzero(odd).tolist():
                extra.append((int(doc[i]), restore(read(starts[i], ends[i]), model)))
            for i in np.flatnonzero(signed).tolist():
                extra.append((int(doc[i]), restore(read(starts[i] - 1, ends[i]), model)))
            for i, j in _rows_of(length <= 2 * letter, length <= letter, doc):
                spelt = restore(" ".join(read(starts[k], ends[k]) for k in range(i, j)), model)
                extra += [(int(doc[i]), w) for w in {*spelt.split(), spelt.replace(" ", "")}]
        keep = ~odd if model is not None else np.ones(len(starts), bool)
        own = [w.encode() for _, w in extra]
        sizes = np.array([len(w) for w in own], np.int64)
        tail = np.frombuffer(b"".join(own), np.uint8)
        first = len(low) + np.cumsum(sizes) - sizes
        self.raw = np.concatenate([low, tail])
        self.starts = np.concatenate([starts[keep], first]).astype(np.int64)
        self.ends = np.concatenate([ends[keep], first + sizes]).astype(np.int64)
        self.doc = np.concatenate([doc[keep], np.array([d for d, _ in extra], np.int64)])

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """doc and hash of every distinct feature of a document: whole words, and beginnings of longer ones."""
        found = [span_hashes(self.raw, self.starts, self.ends)]
        doc = [self.doc]
        for k in PREFIXES:
            longer = self.ends - self.starts > k
            found.append(span_hashes(self.raw, self.starts[longer], self.starts[longer] + k, seed=20 + k))
            doc.append(self.doc[longer])
        return np.concatenate(doc), np.concatenate(found)


def _rows_of(short: np.ndarray, single: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of three or more short pieces, some of them single letters, in one document."""
    if not short.any():
        return []
    edge = np.flatnonzero(np.concatenate([[True], (short[1:] != short[:-1]) | (doc[1:] != doc[:-1]), [True]]))
    ones = np.concatenate([[0], np.cumsum(single)])
    i, j = edge[:-1], edge[1:]
    keep = short[i] & (j - i >= 3) & (ones[j] > ones[i])
    return list(zip(i[keep].tolist(), j[keep].tolist()))


def _pairs(place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a feature's place and a document, in order, and how often each occurs."""
    pair = np.sort((place.astype(np.int64) << 32) | doc)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1]]))
    return pair[first] >> 32, pair[first] & 0xFFFFFFFF, np.diff(np.append(first, len(pair)))


def _met(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of key's hashes that stand in sorted keys, and where; the first 20 bits tell most strangers."""
    likely = np.zeros(1 << 20, bool)
    likely[keys >> np.uint64(44)] = True
    near = np.flatnonzero(likely[key >> np.uint64(44)])
    at = np.searchsorted(keys, key[near])
    hit = keys[np.minimum(at, len(keys) - 1)] == key[near] if len(keys) else np.zeros(0, bool)
    return near[hit], at[hit]


class Model:
    """pairs of the character model; sorted hashes of features whose presence tells, with weights; sorted hashes of those whose density
    does, with the gain of each occurrence and the cost of each word of a document; the slopes and the shift of the final score."""

    def __init__(self, pairs: dict[str, float], presence: tuple[np.ndarray, np.ndarray], density: tuple[np.ndarray, np.ndarray, np.ndarray], slopes: tuple[float, float] = (1.0, 0.0), shift: float = -3.0):
        self.pairs, self.presence, self.density, self.slopes, self.shift = pairs, presence, density, slopes, shift

    def evidence(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Two numbers for each document: the greatest weight of a feature present plus a tenth of the others', and the greatest
        log-likelihood ratio of a feature's occurrences among its words, from 0 to MOST_DENSITY."""
        n = len(offsets) - 1
        out = np.zeros((n, 2))
        if not len(self.presence[0]) and not len(self.density[0]):
            return out
        words = RestoredWords(raw, offsets, CharacterModel(self.pairs))
        length = np.bincount(words.doc, minlength=n)
        of, key = words.features()
        hit, at = _met(self.presence[0], key)
        at, doc, _ = _pairs(at, of[hit])
        weight = self.presence[1][at]
        np.maximum.at(out[:, 0], doc, weight)
        out[:, 0] += 0.1 * (np.bincount(doc, weight, n) - out[:, 0])
        hit, at = _met(self.density[0], key)
        at, doc, times = _pairs(at, of[hit])
        ratio = times * self.density[1][at] - length[doc] * self.density[2][at]
        np.maximum.at(out[:, 1], doc, np.minimum(ratio, MOST_DENSITY))
        return out

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(raw, offsets) @ np.array(self.slopes) + self.shift, -30, 30)))


_COUNTS = ("toxic", "clean", "toxic_times", "clean_times", "toxic_words", "clean_words")


def _counted(batches: Iterator[pa.RecordBatch], pairs: dict[str, float] | None) -> Iterator[pa.RecordBatch]:
    """Rows of a feature's documents in a chunk, its occurrences in them, and all their words, toxic and clean; words are restored if
    there are letter pairs."""
    model = CharacterModel(pairs) if pairs else None
    for batch in batches:
        raw, offsets = text_buffers(batch.column(0))
        y = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.int64)
        for a, b, part, at in chunks(raw, offsets):
            words = RestoredWords(part, at, model)
            length = np.bincount(words.doc, minlength=b - a)
            doc, key = words.features()
            keys, place = np.unique(key, return_inverse=True)
            place, doc, times = _pairs(place, doc)
            own = y[a:b][doc]
            counts = [np.bincount(place, v * w, len(keys)).astype(np.int64) for w in (1, times, length[doc]) for v in (own, 1 - own)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, counts)], names=["key", *_COUNTS])


def _dense_documents(batches: Iterator[pa.RecordBatch], pairs: dict[str, float] | None, density: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """Rows (key, toxic, clean): how many documents of a batch are dense in each feature."""
    model = CharacterModel(pairs) if pairs else None
    keys, gains, costs = density
    for batch in batches:
        raw, offsets = text_buffers(batch.column(0))
        y = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.int64)
        for a, b, part, at in chunks(raw, offsets):
            words = RestoredWords(part, at, model)
            length = np.bincount(words.doc, minlength=b - a)
            doc, key = words.features()
            hit, place = _met(keys, key)
            place, doc, times = _pairs(place, doc[hit])
            is_dense = times * gains[place] - length[doc] * costs[place] > DENSE
            doc, place = doc[is_dense], place[is_dense]
            counts = [np.bincount(place, v, len(keys)).astype(np.int64) for v in (y[a:b][doc], 1 - y[a:b][doc])]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, counts)], names=["key", "toxic", "clean"])


def _letter_pairs(batches: Iterator[pa.RecordBatch], telling: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (pair, n, telling): letter pairs of all words, and again of the words that are telling features themselves."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column(0))
        for _, _, part, at in chunks(raw, offsets):
            words = RestoredWords(part, at, None)
            is_telling = np.isin(span_hashes(words.raw, words.starts, words.ends), telling)
            for flag in (False, True):
                chosen = is_telling if flag else np.ones(len(is_telling), bool)
                spans = zip(words.starts[chosen].tolist(), words.ends[chosen].tolist())
                blob = words.raw.tobytes()
                code = np.frombuffer(("$^".join(["", *(blob[i:j].decode(errors="ignore") for i, j in spans), ""])[1:-1] or "^$").encode("utf-32-le"), np.uint32).astype(np.int64)
                pair, n = np.unique((code[:-1] << 21) | code[1:], return_counts=True)
                names = [chr(x >> 21) + chr(x & 0x1FFFFF) for x in pair.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n.astype(np.int64)), pa.array([flag] * len(n))], names=["pair", "n", "telling"])


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, y, near: the least hash of a document's word 5-grams, which near copies mostly share."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column(0))
        words = Words(raw, offsets)
        grams = window_hashes(words.hashes(), 5)
        near = np.arange(batch.num_rows, dtype=np.int64)
        for i in range(batch.num_rows):
            lo, hi = words.first[i], min(words.first[i + 1] - 4, len(grams))
            own = grams[lo:hi] if hi > lo else span_hashes(raw, offsets[i : i + 1], offsets[i + 1 : i + 2])
            near[i] = own.min().view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=["text", "y", "near"])


def _surprise(part: Column, n: Column, share: Column) -> Column:
    """About minus log10 of the chance that ``part`` of n fall where each does with probability ``share``: n KL(part / n || share)."""
    rate = part / n
    return n * (F.when(rate > 0, rate * F.log10(rate / share)).otherwise(0.0) + F.when(rate < 1, (1 - rate) * F.log10((1 - rate) / (1 - share))).otherwise(0.0))


def _sorted(rows: list, *values: str) -> tuple[np.ndarray, ...]:
    """Hashes in order, and the values that belong to them."""
    keys = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], *(np.array([r[v] for r in rows], float)[order] for v in values)


def _telling(learned: DataFrame, toxic: int, total: int, pairs: dict[str, float] | None) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """What of a model tells by presence (hashes, weights), and what by density (hashes, gains, costs)."""
    counted = learned.mapInArrow(lambda it: _counted(it, pairs), "key long, " + ", ".join(f"{c} long" for c in _COUNTS))
    features = cut(counted.groupBy("key").agg(*[F.sum(c).alias(c) for c in _COUNTS]))
    size = features.agg(F.count("*").alias("n"), F.max("clean_words").alias("words")).first()
    least = float(np.log10(max(1, size["n"]) / CHANCE))
    t, c, share = F.col("toxic"), F.col("clean"), F.lit(toxic / total)
    best = lambda df: df.where(F.col("surprise") > least).orderBy(F.desc("surprise"), "key").limit(FEATURES).collect()
    weight = F.log((t + 0.5) / (c + 0.5) * ((total - toxic) / toxic))
    present = features.where((t > 3) & (t / (t + c) > share) & (t > c)).withColumn("surprise", _surprise(t, t + c, share)).withColumn("weight", weight)
    # Where no clean document has a feature, one of mean length stands for them.
    mean = max(1.0, (size["words"] or 0) / (total - toxic))
    words = F.col("clean_words") + mean
    dense, thin = F.col("toxic_times") / F.col("toxic_words"), (F.col("clean_times") + 0.5) / words
    of_words = F.col("toxic_words") / (F.col("toxic_words") + words)
    by_density = (
        features.where((t > 3) & (dense > DENSER * thin)).withColumn("surprise", _surprise(F.col("toxic_times"), F.col("toxic_times") + F.col("clean_times"), of_words))
        .withColumns({"gain": F.log(dense / thin), "cost": dense - thin})
    )
    density = _sorted(best(by_density), "gain", "cost")
    # Occurrences come in bursts, so what they suggest is confirmed by documents that are dense in it.
    shown = learned.mapInArrow(lambda it: _dense_documents(it, pairs, density), "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sure = shown.where((t > 3) & (t > c) & (_surprise(t, t + c, share) > float(np.log10(max(1, len(density[0])) / CHANCE)))).collect()
    keep = np.isin(density[0].view(np.int64), [r["key"] for r in sure])
    return _sorted(best(present), "weight"), tuple(x[keep] for x in density)


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3) -> Model:
    """A model fitted on all labelled rows outside the held-out fold, of which near copies count once.

    A feature is telling if the chance of its being so often toxic, Bonferroni-corrected, is small. Words are counted as they
    stand first, which gives the character model, and then restored by it. The driver gets at most FEATURES features, LETTER_PAIRS
    letter pairs, and ten sums over the rows' evidence for each step of the final curve.
    """
    learned = labelled_texts(documents, labels, label, modulus, None).mapInArrow(_anchored, "text string, y int, near long")
    learned = cut(learned.groupBy("near", "y").agg(F.min("text").alias("text")).select("text", "y"))
    sizes = learned.groupBy("y").count().collect()
    toxic = sum(r["count"] for r in sizes if r["y"] == 1)
    total = sum(r["count"] for r in sizes)
    if not toxic or toxic == total:
        none, nothing = np.zeros(0, np.uint64), np.zeros(0)
        return Model({}, (none, nothing), (none, nothing, nothing))
    (by_presence, _), (by_density, _, _) = _telling(learned, toxic, total, None)
    keys = np.union1d(by_presence, by_density)
    paired = learned.mapInArrow(lambda it: _letter_pairs(it, keys), "pair string, n long, telling boolean")
    pairs = _blended(paired.groupBy("pair", "telling").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(LETTER_PAIRS).collect())
    model = Model(pairs, *_telling(learned, toxic, total, pairs))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            values = np.concatenate([np.zeros((0, 2)), *(model.evidence(part, at) for _, _, part, at in chunks(raw, offsets))])
            yield pa.RecordBatch.from_arrays([pa.array(values[:, 0]), pa.array(values[:, 1]), batch.column(1)], names=["present", "dense", "y"])

    evidence = learned.mapInArrow(measured, "present double, dense double, y int")
    *slopes, model.shift = _logistic(cut(evidence.groupBy("present", "dense", "y").agg(F.count("*").alias("n"))), ["present", "dense"])
    model.slopes = tuple(slopes)
    return model


def _blended(rows: list) -> dict[str, float]:
    """Letter pair counts in which all words and the telling words weigh alike."""
    total = {flag: sum(r["n"] for r in rows if r["telling"] == flag) for flag in (False, True)}
    out: dict[str, float] = {}
    for r in rows:
        if "$^" != r["pair"]:
            out[r["pair"]] = out.get(r["pair"], 0.0) + 1e5 * r["n"] / total[r["telling"]]
    return out


def _logistic(rows: DataFrame, columns: list[str], rounds: int = 60, ridge: float = 0.01) -> list[float]:
    """Slopes and shift of a logistic curve over columns, by Newton steps that are halved where they do not lower the loss.

    rows have columns, y and n (how many they stand for). Sums are decimal, so that they do not depend on the order of rows.
    """
    x = [*map(F.col, columns), F.lit(1.0)]
    size, n, y = len(x), F.col("n"), F.col("y")
    above = [(i, j) for i in range(size) for j in range(i, size)]

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        margin = sum((F.lit(float(a)) * b for a, b in zip(w, x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-margin))
        loss = F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin))) - y * margin
        wanted = [loss, *((p - y) * a for a in x), *(p * (1 - p) * x[i] * x[j] for i, j in above)]
        first, *rest = map(float, rows.agg(*[F.sum((n * c).cast("decimal(38,15)")).alias(f"c{i}") for i, c in enumerate(wanted)]).first())
        hess = np.zeros((size, size))
        for (i, j), v in zip(above, rest[size:]):
            hess[i, j] = hess[j, i] = v
        return first + ridge / 2 * float(w @ w), np.array(rest[:size]) + ridge * w, hess + ridge * np.eye(size)

    w = np.zeros(size)
    loss, gradient, hess = sums(w)
    step = np.linalg.solve(hess, gradient)
    for _ in range(rounds):
        if np.abs(step).max() < 1e-9:
            break
        new = sums(w - step)
        if new[0] <= loss:
            w, (loss, gradient, hess) = w - step, new
            step = np.linalg.solve(hess, gradient)
        else:
            step = step / 2
    return w.tolist()


def score_toxicity(documents: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """documents' rows with score (0 to 1) and predicted (1 from the threshold on).

    Only the text counts: null is empty, an empty text gets the score of no evidence, a very long one is read whole. Repeated
    rows each get their score, an empty table gives no rows. Other columns stay, but for ones named like a result, whatever the case.
    """
    columns = [c for c in documents.columns if c.lower() not in ("score", "predicted")]
    source, names = without_dots(documents, columns)
    state = (model.pairs, model.presence, model.density, model.slopes, model.shift)
    shared = documents.sparkSession.sparkContext.broadcast(state)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(columns.index("text")))
            values = [own.score(part, at) for _, _, part, at in chunks(raw, offsets)]
            score = np.concatenate(values) if values else np.zeros(0)
            new = [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(scored, f"{kinds}, score double, predicted int").toDF(*columns, "score", "predicted")
