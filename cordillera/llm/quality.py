"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Each passage is encoded: shares of byte classes, word lengths and
repetition go through a learned layer. Gated attention (tanh times sigmoid, then a softmax over the bag) gives every passage
a weight, learned from document labels alone, and the weighted sum of the encodings is scored. The model is fitted on the
driver, on all passages of at most `ROWS` labelled documents outside the held-out fifth; a document is scored on all its
passages, a slice of a batch at a time.

Defined cases: a null or empty text is a bag of one passage of zeros; a text without spaces is one passage, a very long one
a bag of many; rows that
repeat are scored each; without labelled rows or with one class alone, the score is that class's share, 0.5 without any; a
null doc_id counts as not held out; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHasher, chunks, frames, held_out, labelled_sample, mix, text_of

ROWS, PASSAGE = 4000, 64
HIDDEN, GATES, EPOCHS, BATCH, RATE, DECAY = 24, 12, 40, 128, 0.01, 1e-4


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.int64)  # 0: control
    for k, (lo, hi) in enumerate(((97, 122), (65, 90), (48, 57), (32, 32), (10, 10), (9, 9), (128, 191), (192, 255)), 1):
        out[lo : hi + 1] = k
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    out[marks] = np.arange(9, 9 + len(marks))
    return out


CLASSES = _byte_classes()
WIDTH = int(CLASSES.max()) + 1
FEATURES = WIDTH + 7


class Encoder:
    """texts -> (passage features, for each text the number of its first passage and one past the last)."""

    def __init__(self) -> None:
        self.hasher = WordHasher()

    def __call__(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words, at = self.hasher(raw)
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        gap = self.hasher.space[data]
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
        starts, lengths = edge[0::2], (edge[1::2] - edge[0::2]).astype(float)
        offset = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)))
        many = np.maximum((np.diff(at) + PASSAGE - 1) // PASSAGE, 1)
        first = np.concatenate(([0], np.cumsum(many)))
        n = int(first[-1])
        doc = np.repeat(np.arange(len(raw)), np.diff(at))
        of_word = first[doc] + (np.arange(len(words)) - at[doc]) // PASSAGE
        begin = np.empty(n, np.int64)
        begin[first[:-1]] = offset[:-1]
        lead = np.flatnonzero(np.diff(of_word, prepend=-1)) if len(words) else of_word
        inner = (np.arange(len(words))[lead] - at[doc[lead]]) > 0
        begin[of_word[lead][inner]] = starts[lead][inner]
        size = np.diff(np.append(begin, len(data)))
        counts = np.bincount(np.repeat(np.arange(n), size) * WIDTH + CLASSES[data], minlength=n * WIDTH).reshape(n, WIDTH)
        x = np.zeros((n, FEATURES), np.float32)
        x[:, :WIDTH] = counts / np.maximum(size, 1)[:, None]
        total = np.bincount(of_word, minlength=n).astype(float)
        some = np.maximum(total, 1)
        mean = np.bincount(of_word, lengths, n) / some
        x[:, WIDTH] = mean / 10
        x[:, WIDTH + 1] = np.sqrt(np.maximum(np.bincount(of_word, lengths**2, n) / some - mean**2, 0)) / 10
        x[:, WIDTH + 2] = np.log1p(total) / 4
        if len(words):
            order = np.argsort(words ^ mix(of_word.astype(np.uint64)))  # equal words of a passage meet
            w, p = words[order], of_word[order]
            same = (w[1:] == w[:-1]) & (p[1:] == p[:-1])
            x[:, WIDTH + 3] = np.bincount(p[1:][same], minlength=n) / some
            follow = (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])
            x[:, WIDTH + 4] = np.bincount(of_word[1:][follow], minlength=n) / some
            order = np.argsort(words ^ mix(doc.astype(np.uint64)))
            w, d = words[order], doc[order]
            fresh = np.ones(len(w), bool)
            fresh[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
            x[:, WIDTH + 5] = np.repeat(np.bincount(d[fresh], minlength=len(raw)) / np.maximum(np.diff(at), 1), many)
        x[:, WIDTH + 6] = np.log1p(size / (counts[:, CLASSES[10]] + 1)) / 6
        return x, first


def _forward(m: dict, x: np.ndarray, first: np.ndarray) -> dict:
    h = np.tanh(x @ m["w"] + m["b"])
    t, g = np.tanh(h @ m["v"]), 1 / (1 + np.exp(-(h @ m["u"])))
    e = (t * g) @ m["a"]
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
    attention = e / np.add.reduceat(e, first[:-1])[bag]
    z = np.add.reduceat(attention[:, None] * h, first[:-1])
    return {"h": h, "t": t, "g": g, "bag": bag, "attention": attention, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ m["o"] + m["c"], -30, 30)))}


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = 0) -> dict:
    """The model of bags (passages x features each) and their labels, by Adam."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    bags = [(b - mean) / scale for b in bags]
    d = every.shape[1]
    m = {"w": rng.normal(0, d**-0.5, (d, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "a": rng.normal(0, GATES**-0.5, GATES), "o": rng.normal(0, HIDDEN**-0.5, HIDDEN), "c": np.zeros(1)}
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for lo in range(0, len(bags), BATCH):
            own = order[lo : lo + BATCH]
            x, at = np.concatenate([bags[i] for i in own]), np.concatenate(([0], np.cumsum([len(bags[i]) for i in own])))
            f = _forward(m, x, at)
            out = (f["p"] - y[own]) / len(own)
            dz = out[:, None] * m["o"]
            dh = f["attention"][:, None] * dz[f["bag"]]
            da = (f["h"] * dz[f["bag"]]).sum(1)
            de = f["attention"] * (da - np.add.reduceat(f["attention"] * da, at[:-1])[f["bag"]])
            gate = de[:, None] * m["a"]
            dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
            dh += dt @ m["v"].T + dg @ m["u"].T
            dh *= 1 - f["h"] ** 2
            grads = {"w": x.T @ dh, "b": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "o": f["z"].T @ out, "c": out.sum(keepdims=True)}
            step += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
            for k, g in grads.items():
                g = g + DECAY * m[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m[k] = m[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in (m | {"mean": mean, "scale": scale}).items()}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict | float:
    """A model, or the share of label 1 where the labels can't teach one."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder()
        for batch in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
            bags = []
            for a, b in chunks(raw):
                x, first = encode(raw[a:b])
                bags += [x[lo:hi].tobytes() for lo, hi in zip(first[:-1], first[1:])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "bag": bags})

    table = labelled_sample(docs, labels, label, ROWS).mapInPandas(rows, "doc_id long, label int, bag binary").toPandas()  # ROWS bags at most
    table = table.sort_values(["doc_id", "bag"])
    y = table["label"].to_numpy(float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    return fit([np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in table["bag"]], y)


def score(docs: DataFrame, model: dict | float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder()
        for batch in frames(batches):
            raw = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
            out = []
            for a, b in chunks(raw):
                if isinstance(model, float):
                    out.append(np.full(b - a, model))
                else:
                    x, first = encode(raw[a:b])
                    out.append(_forward(model, (x - model["mean"]) / model["scale"], first)["p"].astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(batch["doc_id"], pa.int64(), from_pandas=True), pa.array(np.concatenate(out) if out else np.empty(0))], ["doc_id", "score"])

    return text_of(docs).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_query(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
