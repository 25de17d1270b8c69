"""Language identification with a byte convolutional network.

Bytes of fixed-length windows are embedded, convolved with filters of several widths, max-pooled over
the window and put through a softmax. The network is trained here in numpy on a bounded sample of
labelled windows (`PER_LANGUAGE` texts of each label, `WINDOWS` windows of each text, picked by hashes of
ids); it is applied to every window of every whole text, in batches, and a text's probabilities are the
means over its windows, weighted by bytes.

Null texts and texts without a letter give `und` with score 0; so does everything where no label can be
learnt. Ties go to the label first in order. Rows with the same id are predicted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.llm.common import bounded_batches, crc_mod, pieces, stored, table, utf8

WINDOW = 256
PER_LANGUAGE = 400
WINDOWS = 4
#: Labels up to which their sizes and chosen hashes are broadcast (PER_LANGUAGE rows of about 30 bytes each); beyond it they are joined.
MOST_LABELS = 500
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


class ByteCnn:
    """Embedding, filters of the given widths, max pooling, softmax; all parameters are arrays."""

    def __init__(self, labels: list[str], window: int = WINDOW, dim: int = 6, widths: tuple[int, ...] = (2, 3, 4), filters: int = 12, seed: int = 7):
        g = np.random.default_rng(seed)
        self.labels, self.window, self.dim, self.wide = labels, window, dim, max(widths)
        out = filters * len(widths)
        self.E = g.normal(0, 0.3, (256, dim)).astype(np.float32)
        self.W = g.normal(0, 0.3, (self.wide * dim, out)).astype(np.float32)
        # one product serves all widths: the rows beyond a filter's width are held at zero
        self.mask = np.concatenate([np.repeat(np.arange(self.wide * dim)[:, None] < w * dim, filters, 1) for w in widths], 1).astype(np.float32)
        self.W *= self.mask
        self.b = np.zeros(out, np.float32)
        self.V = g.normal(0, 0.2, (out, len(labels))).astype(np.float32)
        self.c = np.zeros(len(labels), np.float32)

    def unfold(self, x: np.ndarray) -> np.ndarray:
        """The embedded bytes under the widest filter at each position: (windows, positions, wide * dim)."""
        n = x.shape[1] - self.wide + 1
        e = self.E[x]
        return np.concatenate([e[:, k : k + n] for k in range(self.wide)], axis=2)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        u = self.unfold(x)
        h = u.reshape(-1, u.shape[2]) @ self.W
        return np.maximum(h.reshape(len(x), u.shape[1], -1).max(1) + self.b, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.V + self.c
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 11) -> None:
        """Cross-entropy with Adam; each label weighs the same."""
        g = np.random.default_rng(seed)
        weight = (len(y) / np.maximum(np.bincount(y, minlength=len(self.labels)), 1) / len(self.labels)).astype(np.float32)
        names = ("E", "W", "b", "V", "c")
        m, v, t = {k: np.zeros_like(getattr(self, k)) for k in names}, {k: np.zeros_like(getattr(self, k)) for k in names}, 0
        for _ in range(epochs):
            order = g.permutation(len(y))
            for k in range(0, len(y), batch):
                at = order[k : k + batch]
                xb, yb = x[at], y[at]
                u = self.unfold(xb)
                h = (u.reshape(-1, u.shape[2]) @ self.W).reshape(len(xb), u.shape[1], -1)
                best = h.argmax(1)
                top = np.take_along_axis(h, best[:, None, :], 1)[:, 0] + self.b
                act = np.maximum(top, 0)
                z = act @ self.V + self.c
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p *= weight[yb][:, None] / len(yb)
                d_act = (p @ self.V.T) * (top > 0)
                picked = np.take_along_axis(u[:, :, :, None], best[:, None, None, :], 1)[:, 0]  # (batch, wide*dim, out)
                grads = {"V": act.T @ p, "c": p.sum(0), "b": d_act.sum(0), "W": np.einsum("nko,no->ko", picked, d_act) * self.mask}
                d_in = d_act[:, None, :] * self.W[None]  # (batch, wide*dim, out)
                d_e = np.zeros_like(self.E)
                rows = np.arange(len(xb))[:, None]
                for j in range(self.wide):
                    np.add.at(d_e, xb[rows, best + j], d_in[:, j * self.dim : (j + 1) * self.dim].transpose(0, 2, 1))
                grads["E"] = d_e
                t += 1
                for n, gr in grads.items():
                    m[n] = 0.9 * m[n] + 0.1 * gr
                    v[n] = 0.999 * v[n] + 0.001 * gr * gr
                    step = rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - step).astype(np.float32))


def windows(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all rows, padded with zeros: bytes, the row of each, and its bytes within the row."""
    n = -(-np.diff(off) // size)
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = off[row] + nth * size
    end = np.minimum(start + size, off[row + 1])
    at = start[:, None] + np.arange(size)
    inside = at < end[:, None]
    return np.where(inside, buf[np.minimum(at, len(buf) - 1)], 0) if len(buf) else np.zeros((0, size), np.uint8), row, end - start


def classify(net: ByteCnn, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean probabilities of each row over its whole text; rows of no bytes give zeros."""
    total = np.zeros((len(off) - 1, len(net.labels)))
    for a, b in pieces(off, 1 << 19):
        x, row, size = windows(buf[off[a] : off[b]], off[a : b + 1] - off[a], net.window)
        for k in range(0, len(x), 512):
            np.add.at(total, a + row[k : k + 512], net.probabilities(x[k : k + 512]) * size[k : k + 512, None])
    return total / np.maximum(np.diff(off), 1)[:, None]


def labelled_windows(docs: DataFrame, doc_id: str, text: str, lang: str, train: Column, per_language: int, count: int, window: int) -> tuple[np.ndarray, list[str]]:
    """A bounded sample: of each label at most `per_language` different texts, `count` windows each, chosen by hashes of id and text.

    Hashes below a share of their range are looked at, four times what is needed, and the label's least one, so
    that a label of few texts in many rows is not missed. Only hashes are shuffled; the chosen ones, which are bounded,
    then pick their texts out of the table. Labels are one row each, and broadcast where they are checked to be few.
    """
    own = F.xxhash64(doc_id, text)
    known = docs.filter(train & F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(own.alias("__h"), F.col(text).alias("__t"), F.col(lang).alias("__l"))
    hashes = known.select("__h", "__l")
    sizes = stored(hashes.groupBy("__l").agg(F.count("*").alias("n"), F.min("__h").alias("least")), "labels")
    few = sizes.count() <= MOST_LABELS
    dice = F.pmod(F.xxhash64("__h"), F.lit(1_000_003)) / 1_000_003.0
    some = hashes.join(F.broadcast(sizes) if few else sizes, "__l").filter((dice < F.lit(4.0 * per_language) / F.col("n")) | (F.col("__h") == F.col("least"))).select("__l", "__h").distinct()
    best = some.withColumn("k", F.row_number().over(Window.partitionBy("__l").orderBy("__h"))).filter(F.col("k") <= per_language).select("__l", "__h")
    best = stored(best, "chosen")
    chosen = known.join(F.broadcast(best) if few else best, ["__l", "__h"]).groupBy("__l", "__h").agg(F.min("__t").alias("__t"))
    body = F.encode("__t", "UTF-8")
    room = F.greatest(F.octet_length("__t") - window, F.lit(0)) + 1
    cut = F.array(*[F.substring(body, F.pmod(F.xxhash64("__h", F.lit(k)), room.cast("long")).cast("int") + 1, F.lit(window)) for k in range(count)])
    rows = chosen.select("__l", F.explode(F.array_distinct(cut)).alias("w"), "__h").orderBy("__l", "__h", "w").select("__l", "w").collect()
    x = np.zeros((len(rows), window), np.uint8)
    for k, r in enumerate(rows):
        x[k, : len(r.w)] = np.frombuffer(bytes(r.w), np.uint8)
    return x, [r[0] for r in rows]


def fit(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, count: int = WINDOWS, window: int = WINDOW) -> ByteCnn | None:
    """A network for the labels that the rows under `train` have; None where there are none."""
    x, y = labelled_windows(docs, doc_id, text, lang, train, per_language, count, window)
    if not len(x):
        return None
    labels = sorted(set(y))
    net = ByteCnn(labels, window)
    place = {k: i for i, k in enumerate(labels)}
    net.train(x, np.array([place[k] for k in y]))
    return net


def predict(docs: DataFrame, net: ByteCnn | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns with lang_pred and score."""
    bounded_batches(docs.sparkSession)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            buf, off = utf8(texts)
            p = classify(net, buf, off) if net else np.zeros((len(texts), 1))
            blank = np.array([net is None or not x or _LETTER.search(x) is None for x in texts.to_pylist()], dtype=bool)
            labels = np.array([*(net.labels if net else []), UNDETERMINED], dtype=object)
            best = np.where(blank, len(labels) - 1, p.argmax(1))
            score = np.where(blank, 0.0, np.clip(p.max(1), 0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(labels[best], pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 3) == 1
    net = fit(docs, ~held)
    return predict(docs.withColumn("held_out", F.coalesce(held, F.lit(False))), net, keep=("doc_id", "held_out"))
