"""Toxicity: a chain of linear models, one for each category, each seeing the probabilities of those before it.

Features of a whole text: its different words and the first 4 to 8 bytes of each, lower-cased, hashed;
each counts once. In training the probabilities that a model sees are out-of-fold: those of a model
that has not seen the row, nor have its features and categories been chosen by it. Training takes a bounded sample (TRAIN_ROWS) of the labelled rows whose
crc32(doc_id) mod 5 is not 0. The table has one label, toxic; the categories before it are drawn from
the sample's toxic rows: `insult` holds a feature that stands in toxic rows nearly alone, `severe` at
least SEVERE_HITS of them.

Cases at the edge: a null or empty text is scored by the biases alone; a null doc_id stays; of several
labels of one document the mean decides; without labels every probability is 0.5 and nothing is toxic;
repeated rows are scored alike; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, linear, words
from .quality import sampled_labels, training_rows

SEPARATORS = words.separators(bytes(c for c in range(128) if not chr(c).isalnum()))
PREFIXES = (4, 5, 6, 7, 8)
CATEGORIES = ("insult", "severe", "toxic")
TRAIN_ROWS = 8_000
FOLDS = 3
CUT = 0.5
LEAST_ROWS, KEEP = 5, 4_000
#: Feature numbers kept for the probabilities of earlier categories.
RESERVED = 8
PARAMS = linear.Params(bits=20, alpha=0.5, beta=1.0, l1=4.0, l2=0.05, epochs=3)
LEAST_SEEN, LEAST_SHARE, SEVERE_HITS = 8, 0.9, 6


def all_features(texts: list[str], bits: int = PARAMS.bits) -> list[linear.Row]:
    """Numbers and values (ones) of each text's features."""
    size = np.uint64((1 << bits) - RESERVED)
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for data, starts, ends, of in words.pieces([t.lower() for t in texts], SEPARATORS):
        h = words.hash_words(data, starts, ends)
        cuts = np.searchsorted(of, np.arange(of[0], of[-1] + 2)) if len(of) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                own, first = np.unique(h[a:b], return_index=True)
                pre = words.hash_prefixes(data, starts[a:b][first], ends[a:b][first], PREFIXES)
                parts[of[a]] += [own % size, np.unique(pre) % size]
    none = np.zeros(0, dtype=np.uint64)
    idx = [np.unique(np.concatenate([none, *p])).astype(np.int64) for p in parts]
    return [(i, np.ones(len(i))) for i in idx]


def chi_square(rows: list[linear.Row], labels: np.ndarray, bits: int) -> np.ndarray:
    """For each feature that LEAST_ROWS rows hold, how far its rows' labels are from the rest's; 0 for others."""
    seen, pos, n = np.zeros(1 << bits), np.zeros(1 << bits), len(rows)
    for (idx, _), label in zip(rows, labels, strict=True):
        seen[idx] += 1
        pos[idx] += label
    share = labels.mean() if n else 0.0
    spread = seen * share * (1 - share) * (1 - seen / max(1, n))
    return np.where((seen >= LEAST_ROWS) & (spread > 0), (pos - seen * share) ** 2 / np.maximum(spread, 1e-12), 0.0)


class Chain:
    """Models of the categories in their order."""

    def __init__(self, categories: tuple[str, ...], params: linear.Params = PARAMS):
        self.categories, self.params, self.models = categories, params, []

    def _with(self, rows: list[linear.Row], earlier: list[np.ndarray]) -> list[linear.Row]:
        top = (1 << self.params.bits) - 1
        extra = top - np.arange(len(earlier))
        return [(np.concatenate([i, extra]), np.concatenate([v, [p[k] for p in earlier]])) for k, (i, v) in enumerate(rows)] if earlier else rows

    def _telling(self, rows: list[linear.Row], y: np.ndarray) -> np.ndarray:
        """Which features are among the KEEP that tell most about any of the categories (by chi-square)."""
        told = np.max([chi_square(rows, labels, self.params.bits) for labels in y], axis=0)
        least = max(np.partition(told, -KEEP)[-KEEP], 1e-9) if len(told) > KEEP else 1e-9
        return told >= least

    def fit(self, rows: list[linear.Row], y: np.ndarray, folds: int = FOLDS, draw=None) -> Chain:
        """y: one row of labels for each category. Later categories learn from out-of-fold probabilities.

        draw: gives the labels of some rows from those rows and their last labels alone, so that a fold's
        labels, and the features that are kept for it, are not drawn with the rows that it leaves out.
        """
        only = lambda telling, some: [(i[telling[i]], v[telling[i]]) for i, v in some]
        fold, inner = np.arange(len(rows)) % folds, []
        for f in range(folds):
            inside = np.flatnonzero(fold != f)
            own = [rows[i] for i in inside]
            labels = draw(own, y[-1][inside]) if draw else y[:, inside]
            inner.append((inside, np.flatnonzero(fold == f), labels, self._telling(own, labels)))
        rows, source = only(self._telling(rows, y), rows), rows
        earlier: list[np.ndarray] = []
        for k in range(len(self.categories)):
            self.models.append(linear.train(self._with(rows, earlier), y[k], self.params))
            if k + 1 < len(self.categories):
                out = np.zeros(len(rows))
                for inside, left, labels, telling in inner:
                    part = lambda at: self._with(only(telling, [source[i] for i in at]), [p[at] for p in earlier])  # noqa: B023, E731
                    out[left] = linear.score(part(left), *linear.train(part(inside), labels[k], self.params))
                earlier.append(out)
        return self

    def predict(self, rows: list[linear.Row]) -> np.ndarray:
        """(categories x rows) probabilities, each from the features and the probabilities before it."""
        out: list[np.ndarray] = []
        for model in self.models:
            out.append(linear.score(self._with(rows, out), *model))
        return np.array(out).reshape(len(self.models), len(rows))


def drawn_categories(rows: list[linear.Row], toxic: np.ndarray, bits: int = PARAMS.bits) -> np.ndarray:
    """Labels of insult, severe and toxic from the toxic labels and the features of the same rows."""
    size = 1 << bits
    seen, in_toxic = np.zeros(size), np.zeros(size)
    for (idx, _), t in zip(rows, toxic, strict=True):
        seen[idx] += 1
        in_toxic[idx] += t
    telling = (in_toxic >= LEAST_SEEN) & (in_toxic >= LEAST_SHARE * seen)
    hits = np.array([telling[idx].sum() for idx, _ in rows])
    return np.array([toxic * (hits >= 1), toxic * (hits >= SEVERE_HITS), toxic], dtype=np.float64).reshape(3, -1)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, params: linear.Params = PARAMS) -> Chain:
    common.small_batches(docs.sparkSession)
    data, y, _ = training_rows(docs, sampled_labels(labels, "toxic", rows), lambda t: all_features(t, params.bits))
    chain = Chain(CATEGORIES, params).fit(data, drawn_categories(data, y[0], params.bits), draw=lambda rows, toxic: drawn_categories(rows, toxic, params.bits))
    del data
    common.give_back()
    return chain


def scored(docs: DataFrame, chain: Chain, id_col: str = "doc_id") -> DataFrame:
    """The id of each row and the probability of each category from its whole text."""
    common.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(chain)  # categories x 2^bits floats, whatever the data
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        model = held.value
        p = model.predict(all_features(common.texts(batch, "t"), model.params.bits))
        return {"id": batch.column("id")} | {f"p_{c}": p[k] for k, c in enumerate(model.categories)}

    return common.mapped(docs.selectExpr(f"`{id_col}` as id", "text as t"), run, f"id {kind}, " + ", ".join(f"p_{c} double" for c in chain.categories))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the three probabilities, toxic (1 if p_toxic > 0.5)."""
    docs = common.table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return out.selectExpr("id as doc_id", *[f"p_{c}" for c in CATEGORIES], f"cast(p_toxic > {CUT} as int) as toxic")
