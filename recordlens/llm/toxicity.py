"""Toxicity by a classifier chain of linear models over words.

The categories are predicted one after the other; a later model also sees the probabilities of
the earlier ones. It is trained on out-of-fold probabilities, as those of a model on its own
training rows would promise more than they hold for new documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.scratch import Scratch

#: Words are hashed into this many features.
FEATURES = 1 << 17
#: Labelled documents used for fitting, at most.
MAX_LABELLED = 12_000
FOLDS = 4
STEPS = 120
#: Standard deviations by which a word's share of positive documents must differ from the whole,
#: else its many chance differences would outweigh a few telling words in a long text.
SIGNIFICANT = 4.0
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Chain:
    """Per category: weights of the words, of the earlier probabilities, bias and threshold."""

    categories: tuple[str, ...]
    words: tuple[np.ndarray, ...]
    earlier: tuple[np.ndarray, ...]
    bias: tuple[float, ...]
    threshold: tuple[float, ...]


_known: dict[str, int] = {}


def word_features(text: str | None) -> np.ndarray:
    """Distinct features of a text, ascending."""
    found = set(_WORD.findall((text or "").lower()))
    if len(_known) > 1_000_000:
        _known.clear()
    for w in found.difference(_known):
        _known[w] = xxhash.xxh64_intdigest(w) % FEATURES
    return np.unique(np.fromiter(map(_known.__getitem__, found), np.int32, len(found)))


def fit(features: list[np.ndarray], earlier: np.ndarray,
        label: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on word presence. A word's feature is scaled by the log-ratio of its
    document shares in the two classes, so that words common to both hardly count."""
    sizes = np.array([len(f) for f in features])
    words = np.concatenate(features) if len(features) else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(features)), sizes)
    yes = np.bincount(words, label[row], FEATURES)
    n = np.bincount(words, minlength=FEATURES)
    ratio = np.log((yes + 0.5) / (label.sum() + 1)) - np.log(
        (n - yes + 0.5) / (len(label) - label.sum() + 1))
    share = label.sum() / max(len(label), 1)
    distance = (yes - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
    ratio[(n < 3) | (np.abs(distance) < SIGNIFICANT)] = 0
    value = ratio[words]
    keep = value != 0
    words, row, value = words[keep], row[keep], value[keep]
    w, v, b = np.zeros(FEATURES), np.zeros(earlier.shape[1]), float(np.log(
        (label.sum() + 1) / (len(label) - label.sum() + 1)))
    grad_w, grad_v, grad_b = np.zeros(FEATURES), np.zeros(len(v)), 0.0
    for _ in range(STEPS):  # adaptive gradient steps
        score = b + earlier @ v + np.bincount(row, w[words] * value, len(label))
        miss = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - label
        gw = np.bincount(words, miss[row] * value, FEATURES) + 0.05 * w
        gv, gb = miss @ earlier + 0.05 * v, miss.sum()
        grad_w, grad_v, grad_b = grad_w + gw * gw, grad_v + gv * gv, grad_b + gb * gb
        w -= 0.3 * gw / np.sqrt(grad_w + 1e-8)
        v -= 0.3 * gv / np.sqrt(grad_v + 1e-8)
        b -= 0.3 * gb / np.sqrt(grad_b + 1e-8)
    return (w * ratio).astype(np.float32), v, b


def predict(features: list[np.ndarray], earlier: np.ndarray, w: np.ndarray, v: np.ndarray,
            b: float) -> np.ndarray:
    score = np.array([w[f].sum(dtype=np.float64) for f in features]) + earlier @ v + b
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def best_threshold(probability: np.ndarray, label: np.ndarray) -> float:
    """The middle of the gap at which F1 over out-of-fold probabilities is highest."""
    order = np.argsort(-probability, kind="stable")
    p, hits = probability[order], np.cumsum(label[order])
    last = np.r_[p[1:] != p[:-1], True]
    score = np.where(last, 2 * hits / (np.arange(1, len(p) + 1) + max(label.sum(), 1)), -1)
    at = int(score.argmax())
    return float((p[at] + (p[at + 1] if at + 1 < len(p) else 0.0)) / 2)


def _trainer(name: str, before: list[str]):
    """Fits one model without a fold and predicts that fold, or fits on all rows."""
    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        features = [np.frombuffer(b, np.int32) for b in part["words"]]
        seen = part[[f"p_{b}" for b in before]].to_numpy(float).reshape(len(part), -1)
        model = int(part["model"].iloc[0])
        label, own = part[name].to_numpy(float), part["fold"].to_numpy() == model
        fitted = fit([f for f, o in zip(features, own, strict=True) if not o], seen[~own],
                     label[~own])
        if model == FOLDS:
            return pd.DataFrame({"doc_id": [None], "p": [None], "w": [fitted[0].tobytes()],
                                 "v": [list(map(float, fitted[1]))], "b": [fitted[2]]})
        p = predict([f for f, o in zip(features, own, strict=True) if o], seen[own], *fitted)
        return pd.DataFrame({"doc_id": part["doc_id"][own], "p": p, "w": None, "v": None,
                             "b": None})

    return train


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str],
              max_labelled: int = MAX_LABELLED, id_col: str = "doc_id",
              text_col: str = "text") -> Chain:
    """Fit on at most ``max_labelled`` labelled documents, the first by hash of their id.

    ``categories`` has an SQL condition on the labels per name, in the order of the chain. Repeated labels of a document
    count as true if one is; rows with a null label or id are left out, and of rows that share
    an id one text is used. The folds of a category are fitted side by side, as are the models.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    names = list(categories)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), *[
        F.expr(c).cast("int").alias(n) for n, c in categories.items()]).dropna() \
        .groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    known = scratch.keep(known.orderBy(F.xxhash64("doc_id")).limit(max_labelled), "labels")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)
                        .cast("string").alias("text"))

    def work(batches):
        for batch in batches:
            found = [word_features(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.binary()),
                 *(batch.column(2 + i) for i in range(len(names)))], ["doc_id", "words", *names])

    schema = "doc_id long, words binary, " + ", ".join(f"{n} int" for n in names)
    rows = texts.join(F.broadcast(known), "doc_id").mapInArrow(work, schema)  # at most the bound
    rows = scratch.keep(rows.groupBy("doc_id").agg(F.min("words").alias("words"), *[
        F.min(n).alias(n) for n in names]).withColumn(
            "fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")), "rows")
    words, earlier, bias, threshold = [], [], [], []
    for i, name in enumerate(names):
        made = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))) \
            .groupBy("model").applyInPandas(
                _trainer(name, names[:i]),
                "doc_id long, p double, w binary, v array<double>, b double")
        made = scratch.keep(made, f"model_{i}")
        fitted = made.where("w IS NOT NULL").select("w", "v", "b").first()
        if fitted is None:
            fitted = (np.zeros(FEATURES, np.float32).tobytes(), [0.0] * i, -30.0)
        folds = made.where("p IS NOT NULL").select("doc_id", F.col("p").alias(f"p_{name}"))
        rows = scratch.keep(rows.join(folds, "doc_id"), f"rows_{i}")
        # two numbers per labelled document of the bounded sample
        pairs = np.array(rows.select(f"p_{name}", name).collect(), float).reshape(-1, 2)
        words.append(np.frombuffer(fitted[0], np.float32))
        earlier.append(np.array(fitted[1], float))
        bias.append(fitted[2])
        threshold.append(best_threshold(pairs[:, 0], pairs[:, 1]) if len(pairs) else 1.0)
    return Chain(tuple(names), tuple(words), tuple(earlier), tuple(bias), tuple(threshold))


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, and per category its probability ``p_<name>`` and verdict ``<name>``.

    Whole texts are judged; null and empty ones have no words and are judged by the bias and the
    earlier categories alone. Null and repeated ids pass through; other columns are ignored.
    """
    names = chain.categories

    def work(batches):
        for batch in batches:
            features = [word_features(t.as_py()) for t in batch.column(1)]
            seen = np.zeros((len(features), 0))
            for w, v, b in zip(chain.words, chain.earlier, chain.bias, strict=True):
                seen = np.column_stack([seen, predict(features, seen, w, v, b)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(seen[:, i]) for i in range(len(names))),
                 *(pa.array(seen[:, i] > t) for i, t in enumerate(chain.threshold))],
                ["doc_id", *(f"p_{n}" for n in names), *names])

    schema = ", ".join(["doc_id long", *(f"p_{n} double" for n in names),
                        *(f"{n} boolean" for n in names)])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string")).mapInArrow(work, schema)
