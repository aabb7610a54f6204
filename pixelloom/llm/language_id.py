"""Language identification by multilingual mixture inference.

Training counts byte trigrams of words for each language over all labelled rows (a bounded
table: languages x ``BUCKETS``).  A document is a mixture of languages at the level of
words: each word's likelihood in each language comes from its trigrams, and expectation-
maximisation estimates the document's proportions.  For the most likely one, two, three and
so on up to all languages the mixture is fitted again, and the set with the best likelihood
less ``PENALTY * log(words)`` for each language is selected.  Its largest share is the score.
The fits of a text grow with the number of languages learned.

Everything is one narrow pass for the counts and one for the answers; only the counts are
shuffled.

Cases: null texts and texts without a letter are ``und`` with score 0 and no languages; so
are all texts where nothing can be learned; rows with a null language or id take no part in
learning; repeated rows count as often as they stand; ties between languages go to the
smaller name; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import apart, load
from .textbuf import Hasher, buffer, ramp, separators, slices, word_hashes

BUCKETS = 1 << 15
PENALTY = 2.0
ROUNDS = 8
NOT_LETTER = separators((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
UNDETERMINED = "und"


def distinct_words(column, hasher):
    """(word index into the distinct words, first word of each text, trigram buckets of the distinct words, words' sizes)."""
    data, offsets = buffer(column)
    hashes, starts, ends, first = word_hashes(data, offsets, hasher, NOT_LETTER)
    _, seen, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    s, size = starts[seen], (ends - starts)[seen]
    at = np.repeat(s, size) + ramp(size)
    low = data.astype(np.int64)
    low[(low >= 65) & (low <= 90)] += 32
    low = np.r_[low, 32]
    edge_l = np.zeros(len(at), bool)
    edge_l[np.cumsum(size) - size] = True
    edge_r = np.zeros(len(at), bool)
    edge_r[np.cumsum(size) - 1] = True
    left, right = np.where(edge_l, 32, low[at - 1]), np.where(edge_r, 32, low[at + 1])
    code = (left << 16) + (low[at] << 8) + right
    return inverse, first, (code * 2654435761 % (1 << 32)) >> 17, size


def train(docs: DataFrame, learn: Column | None = None, text_col="text", lang_col="lang", buckets=BUCKETS):
    """(languages sorted by name, log-probabilities as float32 of shape languages x buckets)."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if learn is not None:
        rows = rows.where(learn)

    def count(batches):
        hasher, held = Hasher(), {}
        for b in slices(batches, "text"):
            langs = b.column(0).to_pylist()
            word, first, grams, size = distinct_words(b.column(1), hasher)
            begin = np.cumsum(size) - size
            names = sorted(set(langs))
            code = np.repeat([names.index(x) for x in langs], np.diff(first))
            for k, name in enumerate(names):
                times = np.bincount(word[code == k], minlength=len(size))
                got = np.bincount(grams, np.repeat(times, size), minlength=buckets)
                held[name] = held.get(name, 0) + got
        for name, got in held.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int64()), pa.array(got[at].astype(np.int64))], ["lang", "bucket", "n"])

    counts = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, bucket long, n long")
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(table["lang"].unique())
    out = np.zeros((len(names), buckets))
    for k, name in enumerate(names):
        part = table[table["lang"] == name]
        out[k, part["bucket"]] = part["n"]
    out = np.log((out + 0.5) / (out.sum(1, keepdims=True) + 0.5 * buckets)) if names else out
    return names, out.astype(np.float32)


def fit(p, doc, first, theta, rounds):
    """EM for the proportions of each text; p: words x languages.  Returns theta and the log-likelihood."""
    n = np.maximum(np.diff(first), 1)[:, None]
    some = np.flatnonzero(np.diff(first) > 0)
    for _ in range(rounds):
        r = p * theta[doc]
        r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
        theta = theta.copy()
        theta[some] = np.add.reduceat(r, first[some]) / n[some] if len(some) else theta[some]
    like = np.zeros(len(n))
    if len(some):
        like[some] = np.add.reduceat(np.log(np.maximum((p * theta[doc]).sum(1), 1e-30)), first[some])
    return theta, like


def mixtures(column, names, logp, hasher, penalty=PENALTY, rounds=ROUNDS):
    """Proportions of the selected languages for each text (texts x languages)."""
    word, first, grams, size = distinct_words(column, hasher)
    k, docs = len(names), len(first) - 1
    if not len(word) or not k:
        return np.zeros((docs, k)), first
    scores = np.add.reduceat(logp[:, grams], np.cumsum(size) - size, axis=1).T
    p = np.exp(scores - scores.max(1, keepdims=True))[word].astype(np.float32)
    doc = np.repeat(np.arange(docs), np.diff(first))
    theta, _ = fit(p, doc, first, np.full((docs, k), 1 / k, np.float32), rounds)
    order = np.argsort(-theta, axis=1, kind="stable")
    best, best_value = None, None
    for m in range(1, k + 1):
        start = np.zeros_like(theta)
        rows = np.arange(docs)[:, None]
        start[rows, order[:, :m]] = np.maximum(theta[rows, order[:, :m]], 1e-4)
        start /= np.maximum(start.sum(1, keepdims=True), 1e-30)
        got, like = fit(p, doc, first, start, 0 if m == 1 else 3)
        value = like - penalty * m * np.log(np.maximum(np.diff(first), 2))
        if best is None:
            best, best_value = got, value
        else:
            better = value > best_value
            best[better], best_value[better] = got[better], value[better]
    return best, first


def identify(docs: DataFrame, model, text_col="text", id_col="doc_id", keep=()) -> DataFrame:
    """(doc_id, lang_pred, score, languages array<struct<lang,share>>) and the columns ``keep`` of every row."""
    names, logp = model
    held = docs.sparkSession.sparkContext.broadcast((names, logp))

    def run(batches):
        names, logp = held.value
        hasher = Hasher()
        for b in slices(batches, "text"):
            shares, first = mixtures(b.column(1), names, logp, hasher)
            texts, some = b.column(1), np.diff(first) > 0
            for d in np.flatnonzero(some):
                # Words of other scripts may hold no letter; ASCII letters are told by the bytes.
                t = texts[int(d)].as_py()
                some[d] = t[:64].isalpha() or any(c.isalpha() for c in t)
            if len(names):
                top = shares.argmax(1)
                pred = [names[t] if ok else UNDETERMINED for t, ok in zip(top, some)]
                score = np.where(some, np.clip(shares.max(1), 0, 1), 0.0)
                langs = [[{"lang": names[k], "share": float(s[k])} for k in np.flatnonzero(s > 0)] if ok else [] for s, ok in zip(shares, some)]
            else:
                pred, score, langs = [UNDETERMINED] * b.num_rows, np.zeros(b.num_rows), [[]] * b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                 pa.array(langs, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))), *[b.column(2 + i) for i in range(len(keep))], *([b.column(1)] if keep else [])],
                ["doc_id", "lang_pred", "score", "languages", *[f"x{i}" for i in range(len(keep))], *(["text"] if keep else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    schema += "".join(f", x{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + ", text string" * bool(keep)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(keep)])
    return source.mapInArrow(run, schema).withColumnsRenamed({f"x{i}": c for i, c in enumerate(keep)})


def remainder(modulus: int, id_col="doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def op6_language_id(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    model = train(docs, F.coalesce(remainder(4) != 2, F.lit(False)))
    return identify(docs, model).select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def stage(spark, docs, sf_dir):
    """Documents in no language (``und``) go; the others keep their columns.

    All labelled rows are learned from.  Where none of them teaches a language, only texts without a letter go.
    """
    model = train(docs)
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own, was = apart(docs)
    found = identify(own, model, keep=[c for c in own.columns if c not in ("doc_id", "text")])
    return found.where(F.col("lang_pred") != UNDETERMINED).select(*[c.alias(n) for n, c in was.items()])
