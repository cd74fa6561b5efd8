"""Toxicity (operator 10): a linear-chain conditional random field tags toxic words.

Learning. Of the labelled rows outside the held-out part a sample of at most SAMPLE_DOCS of
each label, of texts of at most SAMPLE_CHARS characters, is taken in the order of a hash of the
id (both bounds are parameters, of teaching alone); distinct texts of it are tokenised. Words and word beginnings far more frequent, by documents with them once or
twice, in toxic texts than in others label the tokens of toxic texts; a two-state chain over these features is fitted to the labelled
tokens of all sentences of the sample. A
logistic curve from a text's marginals to its label is fitted on the sample, weighted to the
labels' true proportions.

Scoring. Each sentence (up to . ! ? or a line end) is a chain; forward and backward messages
run over all sentences of a batch at once, longest first. A text's marginals are put together
to its score; neighbouring words with a marginal of one half or more are the offending spans
(code points, ends exclusive).

Defined results: a null text is empty; an empty text has the score of a text without toxic
words. Rows without an id or with a null label do not teach. Without toxic or without clean
teaching rows, every score is the proportion of toxic rows (0 if there are none). Rows are
independent; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import append_arrow, joined_bytes, placed_words, prefix_hashes

SAMPLE_DOCS = 800
SAMPLE_CHARS = 30_000
MIN_DOCS = 3
MIN_LOG_ODDS = 2.3
#: Bytes of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6, 7)
#: Least part of the toxic texts that a labelling feature occurs in.
MIN_SHARE = 0.03
ITERATIONS = 60
RIDGE = 1e-3
#: Letters and digits make words, ASCII in lower case; other ASCII separates.
_TABLE = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


@dataclass
class Tokens:
    #: hashes of the word and its beginnings, a row each; 0 where a word has no such beginning
    features: np.ndarray
    doc: np.ndarray
    sentence: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n_docs: int


def tokenise(texts: pa.Array) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """Tokens of the texts with the joined bytes and where each text ends."""
    data, ends = joined_bytes(texts)
    plain = _TABLE[data]
    word, doc, start, end = placed_words(plain, ends)
    features = np.stack([word, *[prefix_hashes(plain, start, end, k) for k in BEGINNINGS]]) if len(word) else np.empty((1 + len(BEGINNINGS), 0), np.uint64)
    stop = np.cumsum((data == 46) | (data == 33) | (data == 63) | (data == 10))
    return Tokens(features, doc, stop[start] if len(start) else start, start, end, len(texts)), data, ends


def chains(sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token and length of each chain: a sentence."""
    first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(sentence) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(sentence)))


def forward_backward(emission: np.ndarray, first: np.ndarray, length: np.ndarray, step: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of state 1, summed pair marginals (2 by 2) and the log of the partition functions' product.

    emission: log potential of state 1 (state 0 has 0) of each token; chains begin at first. step: 2 by 2 log
    potentials. Chains are taken longest first, so that those still running are a prefix.
    """
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    longest = int(length[0]) if len(length) else 0
    running = [int(np.searchsorted(-length, -t, side="left")) for t in range(longest + 1)]  # chains of more than t tokens
    a = np.empty((len(emission), 2))
    b = np.zeros((len(emission), 2))
    add = np.logaddexp
    for t in range(longest):
        at = first[: running[t]] + t
        if t == 0:
            a[at, 0], a[at, 1] = 0.0, start + emission[at]
        else:
            p = a[at - 1]
            a[at, 0] = add(p[:, 0] + step[0, 0], p[:, 1] + step[1, 0])
            a[at, 1] = add(p[:, 0] + step[0, 1], p[:, 1] + step[1, 1]) + emission[at]
    for t in range(longest - 2, -1, -1):
        at = first[: running[t + 1]] + t
        q0, q1 = b[at + 1, 0], b[at + 1, 1] + emission[at + 1]
        b[at, 0] = add(step[0, 0] + q0, step[0, 1] + q1)
        b[at, 1] = add(step[1, 0] + q0, step[1, 1] + q1)
    whole = a + b
    z = add(whole[:, 0], whole[:, 1])
    pairs = np.zeros((2, 2))
    inner = np.ones(len(emission), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    for i in (0, 1):
        for j in (0, 1):
            pairs[i, j] = np.exp(a[at - 1, i] + step[i, j] + (emission[at] if j else 0) + b[at, j] - z[at]).sum()
    return np.exp(whole[:, 1] - z), pairs, float(z[first].sum())


@dataclass
class Model:
    """Sorted feature hashes with weights, bias, step and start potentials, and the logistic curve of the text score."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    step: np.ndarray
    start: float
    curve: np.ndarray
    constant: float | None = None

    def emission(self, features: np.ndarray) -> np.ndarray:
        total = np.full(features.shape[1], self.bias)
        for f in features if len(self.words) else ():
            i = np.minimum(np.searchsorted(self.words, f), len(self.words) - 1)
            total += np.where(self.words[i] == f, self.weights[i], 0.0)
        return total

    def marginals(self, tokens: Tokens) -> np.ndarray:
        first, length = chains(tokens.sentence)
        return forward_backward(self.emission(tokens.features), first, length, self.step, self.start)[0] if len(first) else np.empty(0)

    def scores(self, tokens: Tokens, marginal: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(tokens.n_docs, self.constant)
        return 1 / (1 + np.exp(-(text_features(tokens, marginal) @ self.curve)))


def text_features(tokens: Tokens, marginal: np.ndarray) -> np.ndarray:
    """For each text: one, the chance that any word is toxic, and of the expected number of toxic words the log, the part up to two and to four, and the share of all words."""
    none = np.bincount(tokens.doc, np.log1p(-np.minimum(marginal, 1 - 1e-9)), tokens.n_docs)
    many = np.bincount(tokens.doc, marginal, tokens.n_docs)
    share = many / np.maximum(1, np.bincount(tokens.doc, minlength=tokens.n_docs))
    return np.stack([np.ones(tokens.n_docs), 1 - np.exp(none), np.log1p(many), np.minimum(many, 2) / 2, np.minimum(many, 4) / 4, np.minimum(100 * share, 2)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (weight * (y - p)) - RIDGE * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], labels: np.ndarray, toxic_share: float) -> Model:
    """The model from distinct texts with 0/1 labels; toxic_share: proportion of label 1 among all teaching rows."""
    empty = Model(np.empty(0, np.uint64), np.empty(0), 0.0, np.zeros((2, 2)), 0.0, np.zeros(6), toxic_share)
    if not len(labels) or labels.min() == labels.max():
        return empty
    tokens, _, _ = tokenise(pa.array(texts, pa.string()))
    label = labels.astype(bool)
    vocabulary, at = np.unique(tokens.features, return_inverse=True)
    at = at.reshape(tokens.features.shape)
    pair, times = np.unique((tokens.doc * len(vocabulary) + at)[tokens.features != 0], return_counts=True)
    doc, which = np.divmod(pair, len(vocabulary))
    lexicon = np.zeros(len(vocabulary), bool)
    for least in (1, 2):  # texts that hold a feature so many times
        some = times >= least
        toxic = np.bincount(which[some], label[doc[some]], len(vocabulary))
        clean = np.bincount(which[some], ~label[doc[some]], len(vocabulary))
        odds = np.log((toxic + 0.5) / (label.sum() + 1)) - np.log((clean + 0.5) / ((~label).sum() + 1))
        lexicon |= (toxic >= max(MIN_DOCS, MIN_SHARE * label.sum())) & (odds >= MIN_LOG_ODDS)
        if least == 1:
            known = vocabulary[toxic + clean >= MIN_DOCS]
    tagged = lexicon[at].any(axis=0) & label[tokens.doc]
    if not tagged.any():
        return empty
    features, y = tokens.features, tagged
    first, length = chains(tokens.sentence)
    place = np.minimum(np.searchsorted(known, features), len(known) - 1)
    has = known[place] == features
    by_feature = lambda x: sum(np.bincount(p[h], x[h], len(known)) for p, h in zip(place, has, strict=True))
    weights, bias, step, start = np.zeros(len(known)), -2.0, np.zeros((2, 2)), 0.0
    head = np.zeros(len(y), bool)
    head[first] = True
    inner = np.flatnonzero(~head)
    seen_pairs = np.array([[((y[inner - 1] == i) & (y[inner] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    seen_words = by_feature(y)
    m = v = np.zeros(len(known) + 6)
    for k in range(1, ITERATIONS + 1):  # Adam on the log likelihood
        emission = np.where(has, weights[place], 0.0).sum(axis=0) + bias
        p, pairs, _ = forward_backward(emission, first, length, step, start)
        g = np.concatenate([seen_words - by_feature(p), [(y - p).sum()], (seen_pairs - pairs).ravel(), [(y[first] - p[first]).sum()]])
        g -= RIDGE * np.concatenate([weights, [bias], step.ravel(), [start]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        weights, bias, step, start = weights + move[:-6], bias + move[-6], step + move[-5:-1].reshape(2, 2), start + move[-1]
    model = Model(known, weights, float(bias), step, float(start), np.zeros(6))
    x = text_features(tokens, model.marginals(tokens))
    share = label.mean()
    model.curve = _logistic(x, labels.astype(float), np.where(label, toxic_share / share, (1 - toxic_share) / (1 - share)))
    return model


def teaching_rows(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, teach: Column) -> tuple[list[str], np.ndarray, float]:
    """(distinct texts, labels, share of label 1 among all) of the bounded sample."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & teach).select(F.col(id_col), (F.col(label) == 1).cast("int").alias("y"))
    short = docs.where(F.coalesce(F.length(text), F.lit(0)) <= SAMPLE_CHARS)
    rows = rows.groupBy(id_col).agg(F.max("y").alias("y"))
    n, share = rows.agg(F.count("*"), F.coalesce(F.avg("y"), F.lit(0.0))).first()
    if not n:
        return [], np.empty(0, int), 0.0
    order = [F.xxhash64(id_col), F.col(id_col)]
    some = rows.join(short.select(id_col).distinct(), id_col, "left_semi")
    sample = some.where("y = 1").orderBy(*order).limit(SAMPLE_DOCS).unionByName(some.where("y = 0").orderBy(*order).limit(SAMPLE_DOCS))
    # at most two times SAMPLE_DOCS ids; texts of repeated ids all teach
    found = short.select(id_col, F.col(text).alias("t")).join(F.broadcast(sample), id_col).select("t", "y").toArrow()
    texts: dict[str, int] = {}
    for t, y in zip(found["t"].to_pylist(), found["y"].to_pylist(), strict=True):
        texts[t or ""] = max(y, texts.get(t or "", 0))
    ordered = sorted(texts.items())
    return [t for t, _ in ordered], np.array([y for _, y in ordered], int), float(share)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def spans(tokens: Tokens, marginal: np.ndarray, data: np.ndarray, ends: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(tokens.n_docs)]
    hit = np.flatnonzero(marginal >= 0.5)
    if not len(hit):
        return out
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    last = -2
    for i in hit.tolist():
        d = int(tokens.doc[i])
        base = points[ends[d - 1]] if d else 0
        a, b, p = int(points[tokens.start[i]] - base), int(points[tokens.end[i]] - base), float(marginal[i])
        if last == i - 1 and tokens.sentence[i] == tokens.sentence[last] and out[d]:
            out[d][-1]["end"], out[d][-1]["score"] = b, max(p, out[d][-1]["score"])
        else:
            out[d].append({"start": a, "end": b, "score": p})
        last = i
    return out


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with toxicity (0 to 1) and toxic_spans."""

    def make() -> Callable:
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            tokens, data, ends = tokenise(batch.column(batch.schema.get_field_index(text)))
            marginal = model.marginals(tokens)
            return [pa.array(model.scores(tokens, marginal), pa.float64()), pa.array(spans(tokens, marginal, data, ends), _ARROW)]

        return run

    return append_arrow(df, make, [T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_spans", SPANS)], sized_by=text)
