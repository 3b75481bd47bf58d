"""Byte-level convolutional quality classifier in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by ``OVERLAP`` and cover the
whole text.  Inside a chunk every byte becomes a small learned vector, learned filters slide over it
(width ``WIDTH``, step ``STRIDE``), each filter's strongest response is kept (max pooling), and a
small hidden layer turns the responses into the chunk's logit.  A document's probability is the
sigmoid of the mean logit of its chunks, weighted by their bytes.

Training: labelled rows outside the held-out fold, at most ``SAMPLE`` per class, chosen by a hash of
the id, and at most ``SAMPLE_CHUNKS`` evenly spaced chunks of each; Adam on the chunks from a fixed
seed.  The bound keeps what the driver holds at SAMPLE * 2 * SAMPLE_CHUNKS * CHUNK bytes whatever the
corpus.  Scoring runs over all rows and whole texts.

Defined cases: a null or empty text is one chunk of padding; null ids are never used in training;
with labels of one class only (or none) every score is 0.5; equal texts score alike; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 1024
OVERLAP = 128
WIDTH = 8
STRIDE = 4
EMBED = 8
FILTERS = 24
HIDDEN = 16
#: Training rows per label, and the bytes that they and each of them may have; chosen texts are learned from whole.
SAMPLE = 1500
SAMPLE_BYTES = 12 << 20
SAMPLE_TEXT_BYTES = 1 << 20
EPOCHS = 14
BATCH = 64
FOLDS = 5
CUT = 0.3
#: Chunks scored at once (bounds a task's memory: frames of 64 floats per 4 bytes).
SCORE_CHUNKS = 64


def chunk_starts(n_bytes: int) -> range:
    """Starts of the chunks that cover ``n_bytes`` bytes; one chunk for an empty text."""
    step = CHUNK - OVERLAP
    return range(0, max(1, n_bytes - OVERLAP), step)


def chunk_matrix(data: bytes, starts) -> np.ndarray:
    """uint8 chunks, zero-padded."""
    out = np.zeros((len(starts), CHUNK), dtype=np.uint8)
    raw = np.frombuffer(data, dtype=np.uint8)
    for i, s in enumerate(starts):
        part = raw[s:s + CHUNK]
        out[i, :len(part)] = part
    return out


class ByteCNN:
    """Weights and the forward and backward pass on a matrix of chunks."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"E": f32(256, EMBED, scale=0.5), "W": f32(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5 * 2),
                  "b": np.zeros(FILTERS, np.float32), "V": f32(FILTERS, HIDDEN, scale=FILTERS**-0.5),
                  "c": np.zeros(HIDDEN, np.float32), "u": f32(HIDDEN, scale=HIDDEN**-0.5), "d": np.zeros(1, np.float32)}
        self.p["E"][0] = 0  # padding

    def _frames(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, positions, WIDTH * EMBED) view of the embedded bytes."""
        embedded = self.p["E"][chunks].reshape(len(chunks), CHUNK * EMBED)
        return np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBED, axis=1)[:, ::STRIDE * EMBED]

    def forward(self, chunks: np.ndarray):
        frames = self._frames(chunks)
        response = np.ascontiguousarray(frames).reshape(-1, WIDTH * EMBED) @ self.p["W"]
        response = response.reshape(len(chunks), -1, FILTERS)
        where = response.argmax(axis=1)
        pooled = np.tanh(np.take_along_axis(response, where[:, None, :], axis=1)[:, 0] + self.p["b"])
        pre = pooled @ self.p["V"] + self.p["c"]
        hidden = np.maximum(pre, 0)
        return hidden @ self.p["u"] + self.p["d"], (where, pooled, pre, hidden)

    def logits(self, chunks: np.ndarray) -> np.ndarray:
        parts = [self.forward(chunks[i:i + SCORE_CHUNKS])[0] for i in range(0, len(chunks), SCORE_CHUNKS)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def gradients(self, chunks: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        logit, (where, pooled, pre, hidden) = self.forward(chunks)
        g = (1 / (1 + np.exp(-logit)) - y) / len(y)
        out = {"u": hidden.T @ g, "d": g.sum(keepdims=True)}
        g_pre = g[:, None] * self.p["u"] * (pre > 0)
        out["V"], out["c"] = pooled.T @ g_pre, g_pre.sum(0)
        g_resp = (g_pre @ self.p["V"].T) * (1 - pooled**2)  # only the strongest frame of a filter has a gradient
        out["b"] = g_resp.sum(0)
        first = where * STRIDE
        window = chunks[np.arange(len(chunks))[:, None, None], first[:, :, None] + np.arange(WIDTH)]  # (n, F, WIDTH) bytes
        vectors = self.p["E"][window].reshape(len(chunks), FILTERS, WIDTH * EMBED)
        out["W"] = np.einsum("nfk,nf->kf", vectors, g_resp)
        g_vec = np.einsum("kf,nf->nfk", self.p["W"], g_resp).reshape(-1, EMBED)
        g_embed = np.zeros_like(self.p["E"])
        np.add.at(g_embed, window.reshape(-1), g_vec)
        g_embed[0] = 0
        out["E"] = g_embed
        return out


def train(chunks: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> ByteCNN | None:
    """Adam on chunks, classes weighed alike by repetition; None without both classes."""
    labels = labels.astype(np.float32)
    pos, neg = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(pos) or not len(neg):
        return None
    rng, model = np.random.default_rng(seed), ByteCNN(seed)
    half = max(len(pos), len(neg))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    t = 0
    for epoch in range(epochs):
        order = np.concatenate([rng.permutation(np.resize(rng.permutation(x), half)) for x in (pos, neg)])
        order = rng.permutation(order)
        rate = 4e-3 * (1 - 0.9 * epoch / max(1, epochs - 1))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            t += 1
            for k, g in model.gradients(chunks[pick], labels[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                model.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def score_texts(model: ByteCNN | None, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 per text."""
    out = np.full(len(texts), 0.5)
    if model is None:
        return out
    weights, owners, pending, held = [], [], [], 0
    total, mass = np.zeros(len(texts)), np.zeros(len(texts))

    def flush() -> None:
        nonlocal weights, owners, pending, held
        if pending:
            logit = model.logits(np.concatenate(pending)).astype(np.float64)
            w = np.array(weights, dtype=np.float64)
            np.add.at(total, owners, w * logit)
            np.add.at(mass, owners, w)
        weights, owners, pending, held = [], [], [], 0

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        starts = chunk_starts(len(data))
        for a in range(0, len(starts), SCORE_CHUNKS):  # a very long text in several rounds
            some = starts[a:a + SCORE_CHUNKS]
            pending.append(chunk_matrix(data, some))
            owners += [i] * len(some)
            weights += [max(1, min(CHUNK, len(data) - s)) for s in some]
            held += len(some)
            if held >= 4 * SCORE_CHUNKS:
                flush()
    flush()
    return 1 / (1 + np.exp(-total / np.maximum(mass, 1e-9)))


def fold_of(id_col: str) -> Column:
    """crc32 of the id as text, modulo the number of folds; 0 is held out."""
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = SAMPLE) -> ByteCNN | None:
    """Train on the bounded sample of labelled rows outside the held-out fold: up to ``sample`` rows per label in the
    order of a hash, as long as their texts have ``SAMPLE_BYTES`` together, each with all its chunks."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id is not null and y in (0, 1)")
    known = known.filter(fold_of("id") != 0).groupBy("id").agg(F.max("y").alias("y"))
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1])  # at most 2 * sample rows
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).filter(F.octet_length("text") <= SAMPLE_TEXT_BYTES).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # one row of a repeated id
    so_far = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id")
    rows = rows.withColumn("bytes", F.sum(F.octet_length("text")).over(so_far)).filter(F.col("bytes") <= SAMPLE_BYTES)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text, y in zip(pdf["id"], pdf["text"], pdf["y"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                out += [(key, c.tobytes(), int(y)) for c in chunk_matrix(data, chunk_starts(len(data)))]
            yield pd.DataFrame(out, columns=["id", "chunk", "y"])

    got = rows.mapInPandas(cut, "id long, chunk binary, y int").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["id", "chunk"], kind="stable")  # the same order in every run
    chunks = np.frombuffer(b"".join(bytes(c) for c in got["chunk"]), dtype=np.uint8).reshape(-1, CHUNK)
    return train(chunks, got["y"].to_numpy())


def score(docs: DataFrame, model: ByteCNN | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``' ids with held_out and score."""
    packed = None if model is None else {k: v.copy() for k, v in model.p.items()}

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = None
        if packed is not None:
            net = ByteCNN()
            net.p = packed
        for texts in batches:
            yield pd.Series(score_texts(net, texts.tolist()))

    return docs.select(F.col(id_col), (F.coalesce(fold_of(id_col), F.lit(1)) == 0).alias("held_out"), probability(F.col(text_col)).alias("score"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score(docs, fit(docs, labels))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
