"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import Scratch, crc_bucket

#: Bound of the training sample: documents of each language, different words of them, and training steps of so many words.
DOCS, WORDS, STEPS, BATCH = 400, 40_000, 500, 256
#: Width of the hidden state of each direction, and bytes of a sequence: a longer word is read in several.
HIDDEN, SPAN = 16, 32
#: Words a worker remembers, and words of one pass through the network.
MEMORY, PASS = 400_000, 4096
LETTER = regex.compile(r"\p{L}")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two gated recurrent layers, one in each direction, over the bytes of a word; a soft-max labels every byte.

    Sequences are whole words with their length, shorter ones padded; ``p`` holds all weights.
    """

    def __init__(self, classes: int, seed: int = 7):
        rng, h = np.random.default_rng(seed), HIDDEN
        draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("x", draw(256, 3 * h)), ("u", draw(h, 3 * h)))}
        self.p |= {"o": draw(2 * h, classes), "c": np.zeros(classes, np.float32)}

    def run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states ``(time, words, hidden)`` of a direction, and what the way back needs."""
        wx, u, h = self.p["x" + d], self.p["u" + d], HIDDEN
        state = np.zeros((x.shape[1], h), np.float32)
        out, tape = np.zeros((*x.shape, h), np.float32), [None] * len(x)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = wx[x[t]]
            g = sigmoid(a[:, :2 * h] + state @ u[:, :2 * h])
            z, r = g[:, :h], g[:, h:]
            n = np.tanh(a[:, 2 * h:] + (r * state) @ u[:, 2 * h:])
            new = state + z * (n - state)
            m = mask[t][:, None]
            tape[t] = (state, z, r, n, m)
            state = np.where(m, new, state)
            out[t] = state
        return out, tape

    def labels(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Class probabilities of every byte, ``(time, words, classes)``."""
        both = np.concatenate([self.run(x, mask, "f")[0], self.run(x, mask, "b")[0]], axis=2)
        logits = both @ self.p["o"] + self.p["c"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the labels of all bytes, and its gradients by backpropagation through time."""
        p, h = self.p, HIDDEN
        outs, tapes = zip(*(self.run(x, mask, d) for d in "fb"))
        both = np.concatenate(outs, axis=2)
        logits = both @ p["o"] + p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        total = mask.sum()
        own = np.take_along_axis(prob, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2)[:, :, 0]
        loss = float(-(np.log(own + 1e-9) * mask).sum() / total)
        delta = prob.copy()
        np.put_along_axis(delta, np.broadcast_to(y[None, :, None], (*x.shape, 1)), (own - 1)[:, :, None], 2)
        delta *= mask[:, :, None] / total
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["o"] = np.einsum("tbh,tbc->hc", both, delta)
        grad["c"] = delta.sum(axis=(0, 1))
        back = delta @ p["o"].T
        for i, d in enumerate("fb"):
            wx, u = grad["x" + d], p["u" + d]
            carry = np.zeros((x.shape[1], h), np.float32)
            for t in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
                state, z, r, n, m = tapes[i][t]
                g = carry + back[t][:, i * h:(i + 1) * h]
                live = np.where(m, g, 0)
                dn = live * z * (1 - n * n)
                dz = live * (n - state) * z * (1 - z)
                drs = dn @ u[:, 2 * h:].T
                dr = drs * state * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                np.add.at(wx, x[t], da)
                gu = grad["u" + d]
                gu[:, :2 * h] += state.T @ da[:, :2 * h]
                gu[:, 2 * h:] += (r * state).T @ dn
                carry = np.where(m, live * (1 - z) + drs * r + da[:, :2 * h] @ u[:, :2 * h].T, g)
        return loss, grad

    def fit(self, words: list[bytes], y: np.ndarray, weight: np.ndarray, steps: int = STEPS, seed: int = 3) -> float:
        """Adam on words drawn by weight; returns the last smoothed loss."""
        rng = np.random.default_rng(seed)
        chance = weight / weight.sum()
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        smooth = 0.0
        for step in range(1, steps + 1):
            pick = rng.choice(len(words), BATCH, p=chance)
            x, mask = pack([words[i] for i in pick])
            loss, grad = self.gradients(x, mask, y[pick])
            smooth = loss if step == 1 else 0.95 * smooth + 0.05 * loss
            rate = 0.02 * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                np.clip(g, -1, 1, out=g)
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                self.p[k] -= rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-6)
        return smooth

    def sums(self, words: list[bytes]) -> np.ndarray:
        """Sum over the bytes of each word of the class probabilities; a longer word is read in spans."""
        out = np.zeros((len(words), len(self.p["c"])), np.float32)
        parts = [(len(w[a:a + SPAN]), i, w[a:a + SPAN]) for i, w in enumerate(words) for a in range(0, len(w), SPAN)]
        parts.sort(key=lambda v: v[0])
        for at in range(0, len(parts), PASS):
            some = parts[at:at + PASS]
            x, mask = pack([v[2] for v in some])
            np.add.at(out, [v[1] for v in some], (self.labels(x, mask) * mask[:, :, None]).sum(axis=0))
        return out


def pack(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes ``(time, words)``, padded with zeros, and which of them are real."""
    size = np.array([len(w) for w in words])
    width = int(size.max())
    x = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    return np.ascontiguousarray(x.T), np.arange(width)[:, None] < size[None, :]


def train_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, text)`` to different words and their counts."""
    count: dict[tuple[str, bytes], int] = {}
    for b in batches:
        for lang, t in zip(b.column(0).to_pylist(), b.column(1)):
            for w in (t.as_py() or "").encode().split():
                for at in range(0, len(w), SPAN):
                    k = (lang, w[at:at + SPAN])
                    count[k] = count.get(k, 0) + 1
    items = list(count.items())
    for at in range(0, len(items), 50_000):
        some = items[at:at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in some], pa.string()), pa.array([k[1] for k, _ in some], pa.binary()),
                                          pa.array([n for _, n in some], pa.int64())], ["lang", "word", "n"])


def train(docs: DataFrame, scratch: Scratch) -> tuple[list[str], Network | None]:
    """Languages and network, learned from rows whose crc32 of the id modulo 3 is not 1.

    The sample is bounded: ``DOCS`` documents a language and ``WORDS`` words of them in all, both by hash.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket("doc_id", 3) != 1))
    own = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id")
    ids = scratch.keep(rows.select("doc_id", "lang").withColumn("k", F.row_number().over(own)).where(F.col("k") <= DOCS).select("doc_id", "lang").distinct())
    some = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).join(ids, ["doc_id", "lang"])
    words = some.select("lang", "text").mapInArrow(train_words, "lang string, word binary, n long")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = words.orderBy(F.xxhash64("word", "lang"), "word", "lang").limit(WORDS).collect()
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return [], None
    y = np.array([langs.index(r["lang"]) for r in got])
    n = np.array([r["n"] for r in got], np.float64)
    net = Network(len(langs))
    if len(langs) > 1:
        per = np.bincount(y, weights=n)
        net.fit([bytes(r["word"]) for r in got], y, n / per[y])
    return langs, net


def predicted(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """``(doc_id, text)`` to language and score. The network is a function of a word alone, so a word is read once."""
    langs, net = model.value
    place: dict[bytes, int] = {}
    sums = np.zeros((0, len(langs)), np.float32)
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            if len(place) > MEMORY:
                place, sums = {}, np.zeros((0, len(langs)), np.float32)
            texts = [t.as_py() for t in part.column(1)]
            texts = [t if t and net is not None and LETTER.search(t) else None for t in texts]
            words = [t.encode().split() if t else [] for t in texts]
            new = list(set().union(*words).difference(place))
            if new:
                place.update(zip(new, range(len(place), len(place) + len(new))))
                sums = np.concatenate([sums, net.sums(new)])
            lang, score = [], []
            for t, ws in zip(texts, words):
                if t is None:
                    lang.append("und")
                    score.append(0.0)
                    continue
                total = sums[np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))].sum(axis=0, dtype=np.float64)
                k = int(total.argmax())
                lang.append(langs[k])
                score.append(float(min(1.0, total[k] / total.sum())))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])


def language_id(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    The document's probability of a language is the mean over all its bytes. A null text, one without a letter, and every text
    if nothing can be learned, is ``und`` with score 0. Repeated rows and null ids are rows like others; an empty
    table gives no rows; of other columns only ``lang`` is read, and only to learn.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, scratch))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(partial(predicted, model=model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
