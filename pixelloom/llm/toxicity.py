"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a fixed and of a learned lexicon, lexicon words near
second-person words, capitals, punctuation and obfuscation rates, and for long texts the
logarithms of the lexicon counts.  They are computed for
all rows in one narrow pass; a text's features depend on that text alone.  The model is fitted
on at most ``TRAIN_ROWS`` labelled rows, taken in the order of a hash of the id, in ``FOLDS``
folds: trees see features under the lexicon that the other folds teach, and the calibration
sees the scores of trees fitted on the other folds.  The learned lexicon is every word that
stands in ``SUPPORT`` toxic training texts at least and is as much likelier there as
``LEAST_WEIGHT`` says; it is bounded by the training rows alone.

Cases: null and empty texts have zero features and get the calibrated score of such a text;
labels that are null, or whose document or id is missing, teach nothing; of repeated labels
the larger counts; with no or one class of labels the score is that class's share (0.5
without labels); repeated rows and null ids are scored row by row; other columns, language
and source among them, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .language_id import remainder
from .shared import load, stored
from .textbuf import NOT_ALNUM, Hasher, buffer, slices, word_hashes

TRAIN_ROWS = 20_000
SUPPORT, LEAST_WEIGHT, FOLDS = 3, 1.0, 4
NEAR = 4

# Insults, and second-person words of several languages.
INSULTS = """idiot idiots stupid moron morons trash garbage scum loser losers pathetic worthless disgusting clown
clowns dumb fool fools filth filthy vermin hate ugly shut die kill scumbag imbecile jerk creep pig pigs coward
dummkopf abschaum arschloch dreck trottel salaud connard connasse ordure imbécile idiota estúpido basura imbécil asco""".split()
SECOND = "you your yours yourself ya u tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes tú ti vosotros".split()
FEATURES = ("log_words", "insults", "learned", "learned_weight", "learned_max", "near_second", "second", "capitals", "all_caps", "exclaim", "question", "masks", "mixed_digits", "runs", "word_size", "log_insults", "log_learned", "log_near")


def hashes_of(words):
    data = " ".join(words).encode()
    raw = np.frombuffer(data, np.uint8)
    return np.unique(word_hashes(raw, np.array([0, len(raw)]), Hasher(), NOT_ALNUM)[0])


def member(values, table):
    """(whether each value is in the sorted table, its place)."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def per_text(values, first):
    return np.diff(np.r_[0, np.cumsum(values)][first])


def features(column, hasher, learned):
    """Matrix texts x FEATURES (float32); learned: sorted hashes and their weights."""
    data, offsets = buffer(column)
    hashes, starts, ends, first = word_hashes(data, offsets, hasher, NOT_ALNUM)
    n = np.diff(first)
    bytes_ = np.maximum(np.diff(offsets), 1)
    insult = member(hashes, hashes_of(INSULTS))[0]
    second = member(hashes, hashes_of(SECOND))[0]
    known, at = member(hashes, learned[0])
    weight = np.where(known, learned[1][at] if len(learned[1]) else 0.0, 0.0)
    bad = insult | (weight > 1.5)
    near = np.zeros(len(hashes), bool)
    doc = np.repeat(np.arange(len(n)), n)
    for d in range(1, NEAR + 1):
        same = doc[d:] == doc[:-d]
        near[d:] |= bad[d:] & second[:-d] & same
        near[:-d] |= bad[:-d] & second[d:] & same
    top = np.zeros(len(n))
    some = np.flatnonzero(n > 0)
    if len(some):
        top[some] = np.maximum.reduceat(weight, first[some])
    prefix = lambda mask: np.r_[0, np.cumsum(mask)]
    by_byte = lambda mask: np.diff(prefix(mask)[offsets])
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    letter = upper | ((data >= 97) & (data <= 122))
    up, dg, size = prefix(upper), prefix(digit), ends - starts
    caps = (up[ends] - up[starts] == size) & (size > 1)
    mixed = (dg[ends] > dg[starts]) & (dg[ends] - dg[starts] < size)
    runs = np.zeros(len(data) + 2, bool)
    runs[2 : len(data)] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    runs[offsets[:-1]] = runs[offsets[:-1] + 1] = False  # The bytes before a text's first two are another text's.
    runs = runs[: len(data)]
    masks = np.isin(data, np.frombuffer(b"*#$%&@", np.uint8))
    w = np.maximum(n, 1)
    cols = [np.log1p(n), per_text(insult, first) / w, per_text(weight > 1.5, first) / w, per_text(weight, first) / w, top, per_text(near, first) / w,
            per_text(second, first) / w, by_byte(upper) / np.maximum(by_byte(letter), 1), per_text(caps, first) / w, by_byte(data == 33) / bytes_, by_byte(data == 63) / bytes_,
            by_byte(masks) / bytes_, per_text(mixed, first) / w, by_byte(runs) / bytes_, per_text(size, first) / w,
            np.log1p(per_text(insult, first)), np.log1p(per_text(weight > 1.5, first)), np.log1p(per_text(near, first))]
    return np.stack(cols, 1).astype(np.float32)


class Trees:
    """Boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, rounds=80, depth=3, rate=0.15, bins=48, least=20):
        self.rounds, self.depth, self.rate, self.bins, self.most = rounds, depth, rate, bins, least

    def fit(self, x, y):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        # Leaves of few rows where one class has few.
        self.least = max(3, min(self.most, int(min(y.sum(), len(y) - y.sum())) // 5))
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self.rate * self._one(tree, b)
        return self

    def _binned(self, x):
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)

    def _grow(self, b, g, h, rows, depth):
        gt, ht, n = g[rows].sum(), h[rows].sum(), len(rows)
        value = gt / (ht + 1.0)
        if not depth or n < 2 * self.least:
            return float(value)
        # Histograms of all features at once: one row of bins for each.
        wide = (b[rows] + np.arange(b.shape[1]) * self.bins).ravel()
        sums = [np.bincount(wide, None if w is None else np.repeat(w[rows], b.shape[1]), b.shape[1] * self.bins).reshape(-1, self.bins).cumsum(1) for w in (g, h, None)]
        gs, hs, ns = sums
        gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1.0)
        gain[(ns < self.least) | (n - ns < self.least)] = 0
        j, k = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[j, k] <= 1e-6:
            return float(value)
        left = b[rows, j] <= k
        return int(j), int(k), self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1)

    def _one(self, tree, b):
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        j, k, low, high = tree
        return np.where(b[:, j] <= k, self._one(low, b), self._one(high, b))

    def raw(self, x):
        b = self._binned(x)
        return self.start + self.rate * sum((self._one(t, b) for t in self.trees), np.zeros(len(b)))


def isotonic(raw, y):
    """Pool adjacent violators: knots (raw, probability), to be interpolated."""
    order = np.argsort(raw, kind="stable")
    blocks = []
    for r, v in zip(raw[order], y[order]):
        blocks.append([float(v), 1, float(r)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, r2 = blocks.pop()
            v1, n1, r1 = blocks[-1]
            blocks[-1] = [v1 + v2, n1 + n2, (r1 * n1 + r2 * n2) / (n1 + n2)]
    # One observation of each class in the ends keeps shares off 0 and 1.
    xs, ys = np.array([b[2] for b in blocks]), np.array([(b[0] + 0.5 * (i == 0)) / (b[1] + 1.0 * (i in (0, len(blocks) - 1))) for i, b in enumerate(blocks)])
    return xs, np.maximum.accumulate(ys)


class Model:
    learned = (np.zeros(0, np.uint64), np.zeros(0))
    trees = knots = None
    share = 0.5

    def scores(self, x):
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        # The raw score's own slope, kept small, orders what one calibrated step holds.
        return np.clip(0.99 * np.interp(raw, *self.knots) + 0.01 / (1 + np.exp(-raw)), 0, 1)


def train(docs: DataFrame, labels: DataFrame, learn=None, id_col="doc_id", text_col="text", label_col="toxic", rows=TRAIN_ROWS) -> Model:
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marks = marks.where(learn) if learn is not None else marks
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(rows)
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "id")
    held = stored(held.select("id", "y", (F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(FOLDS))).cast("int").alias("part"), "text"), "toxicity-train")

    def count(batches):
        hasher, tally = Hasher(), {}
        for b in slices(batches, "text"):
            at = np.array(b.column(0).to_pylist()).clip(0, 1) * FOLDS + np.array(b.column(1).to_pylist())
            data, offsets = buffer(b.column(2))
            hashes, _, _, first = word_hashes(data, offsets, hasher, NOT_ALNUM)
            for d in range(b.num_rows):
                for h in np.unique(hashes[first[d] : first[d + 1]]).tolist():
                    tally.setdefault(h, [0] * (2 * FOLDS))[at[d]] += 1
        keys = np.fromiter(tally, np.uint64, len(tally)).view(np.int64)
        n = np.array(list(tally.values()), np.int64).reshape(-1, 2 * FOLDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(n[:, k]) for k in range(2 * FOLDS)]], ["h", *columns])

    model = Model()
    columns = [f"n{k}" for k in range(2 * FOLDS)]
    total = {(int(r["y"] > 0), r["part"]): r["count"] for r in held.groupBy((F.col("y") > 0).cast("int").alias("y"), "part").count().collect()}
    sizes = np.array([[total.get((y, k), 0) for k in range(FOLDS)] for y in (0, 1)])
    if not sizes.sum(1).all():
        model.share = float(sizes[1].sum() / sizes.sum()) if sizes.sum() else 0.5
        return model
    words = held.select("y", "part", "text").mapInArrow(count, "h long, " + ", ".join(f"{c} long" for c in columns))
    words = words.groupBy("h").agg(*[F.sum(c).alias(c) for c in columns]).where(" + ".join(columns[FOLDS:]) + f" >= {SUPPORT}")
    found = words.toPandas().sort_values("h", kind="stable")
    h, seen = found["h"].to_numpy(np.int64).view(np.uint64), found[columns].to_numpy(np.int64).reshape(len(found), 2, FOLDS)

    def lexicon(folds):
        """Sorted hashes and weights of the words that these folds teach."""
        clean, toxic = seen[:, 0, folds].sum(1), seen[:, 1, folds].sum(1)
        n0, n1 = sizes[0, folds].sum(), sizes[1, folds].sum()
        w = np.log((toxic + 0.5) / (n1 + 1.0)) - np.log((clean + 0.5) / (n0 + 1.0))
        at = np.flatnonzero((toxic >= SUPPORT) & (w > LEAST_WEIGHT))
        at = at[np.argsort(h[at])]
        return h[at], w[at]

    every = list(range(FOLDS))
    others = [[j for j in every if j != k] for k in every]
    lexicons = [lexicon(x) for x in others]
    model.learned = lexicon(every)

    def measure(batches):
        hasher = Hasher()
        for b in slices(batches, "text"):
            part = np.array(b.column(2).to_pylist())
            x = np.zeros((b.num_rows, len(FEATURES)), np.float32)
            for k in np.unique(part):
                x[part == k] = features(b.column(3).filter(pa.array(part == k)), hasher, lexicons[k])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(list(x), pa.list_(pa.float32()))], ["id", "y", "part", "x"])

    got = held.mapInArrow(measure, f"id {held.schema['id'].dataType.simpleString()}, y int, part int, x array<float>").toPandas().sort_values("id", kind="stable")
    x, y, part = np.stack(got["x"].to_numpy()), (got["y"].to_numpy() > 0).astype(float), got["part"].to_numpy()
    raw, told = np.zeros(len(y)), np.zeros(len(y), bool)
    for k in every:
        fit = part != k
        if 0 < y[fit].sum() < fit.sum() and not fit.all():
            raw[~fit], told[~fit] = Trees().fit(x[fit], y[fit]).raw(x[~fit]), True
    model.trees = Trees().fit(x, y)
    if not 0 < y[told].sum() < told.sum():
        raw, told = model.trees.raw(x), np.ones(len(y), bool)
    model.knots = isotonic(raw[told], y[told])
    return model


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, score, features array<float>) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hasher, model = Hasher(), held.value
        for b in slices(batches, "text"):
            x = features(b.column(1), hasher, model.learned)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x), pa.float64()), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "score", "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, features array<float>")


def op3_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    model = train(docs, load(spark, sf_dir, "labels"), F.coalesce(remainder(5) != 0, F.lit(False)))
    return score(docs, model).select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
