"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in windows of ``WINDOW``. In each window one recurrent unit runs
forward and one backward; at every position both states give a probability for each language,
and a document's probabilities are the means over all of its positions. The network is trained
here by backpropagation through time with Adam, on whole texts: of each language those of at most
``LEARN_DOCS`` documents, in the order of the hash of their ids, that fit in ``LEARN_BYTES`` together, and the
shortest if none fits.

Defined results: ``und`` with score 0 for a null text, a text without a letter, and any text where
nothing could be learned. Of equal probabilities the first language by name wins. Repeated rows
are all returned. Columns besides id, text and language are ignored. More than ``LANGUAGES`` raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from quillgraph.llm.common import Carried, bound_batches, hash_unit, held_out

WINDOW, HIDDEN = 64, 8
#: Documents of each language to learn from, and bytes of them, at most. More languages than these raise an error, as each takes outputs at every position.
LEARN_DOCS, LEARN_BYTES, LANGUAGES = 400, 400_000, 512
#: Windows that are read at once.
LANES = 4096
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}").search


def windows(raw: bytes) -> np.ndarray:
    """The bytes in rows of ``WINDOW``; the last is filled with zeros."""
    rows = -(-len(raw) // WINDOW)
    out = np.zeros(rows * WINDOW, dtype=np.uint8)
    out[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return out.reshape(rows, WINDOW)


@dataclass
class Network:
    """Two gated recurrent units and the weights of their outputs.

    For each direction d: ``input[d]`` (256, 3H) are the gates' terms for a byte, ``state[d]`` (H, 3H)
    those for the state, ``out[d]`` (H, K) the outputs. Gates are in the order update, reset, candidate.
    """

    languages: list[str]
    input: np.ndarray
    state: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def states(self, x: np.ndarray, d: int, keep: list | None = None) -> np.ndarray:
        """States (T, B, H) of direction d over bytes (T, B); ``keep`` gets what backpropagation needs."""
        steps, lanes = x.shape
        h2 = 2 * HIDDEN
        h = np.zeros((lanes, HIDDEN), dtype=np.float32)
        hs = np.empty((steps, lanes, HIDDEN), dtype=np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            given, fed = self.input[d][x[t]], h @ self.state[d]
            gates = np.tanh(0.5 * (given[:, :h2] + fed[:, :h2]))
            gates *= 0.5
            gates += 0.5
            update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
            candidate = np.tanh(given[:, h2:] + reset * fed[:, h2:])
            if keep is not None:
                keep.append((t, h, update, reset, candidate, fed[:, h2:]))
            h = candidate + update * (h - candidate)
            hs[t] = h
        return hs

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, K) at every position of bytes (T, B)."""
        raw = self.states(x, 0) @ self.out[0] + self.states(x, 1) @ self.out[1] + self.bias
        raw -= raw.max(axis=-1, keepdims=True)
        np.exp(raw, out=raw)
        raw /= raw.sum(axis=-1, keepdims=True)
        return raw

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (documents, K) over all positions of each non-empty text."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        counts = -(-lengths // WINDOW)
        owner = np.repeat(np.arange(len(texts)), counts)
        within = np.arange(owner.size) - np.repeat(np.cumsum(counts) - counts, counts)
        filled = np.minimum(WINDOW, lengths[owner] - within * WINDOW)
        flat = np.concatenate([windows(t) for t in texts]) if texts else np.empty((0, WINDOW), np.uint8)
        sums = np.zeros((len(texts), len(self.languages)))
        for at in range(0, owner.size, LANES):
            part = slice(at, at + LANES)
            p = self.positions(np.ascontiguousarray(flat[part].T))
            p *= (np.arange(WINDOW)[:, None] < filled[part][None, :])[..., None]
            own = p.sum(axis=0)
            for k in range(own.shape[1]):
                sums[:, k] += np.bincount(owner[part], own[:, k], minlength=len(texts))
        return sums / np.maximum(lengths, 1)[:, None]

    def gradients(self, x: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Gradients of the mean cross-entropy over positions (input, state, out, bias), and the loss."""
        h2 = 2 * HIDDEN
        kept: list[list] = [[], []]
        hs = [self.states(x, d, kept[d]) for d in (0, 1)]
        raw = hs[0] @ self.out[0] + hs[1] @ self.out[1] + self.bias
        raw -= raw.max(axis=-1, keepdims=True)
        p = np.exp(raw)
        p /= p.sum(axis=-1, keepdims=True)
        total = float(mask.sum())
        picked = np.take_along_axis(p, np.broadcast_to(labels[None, :, None], (*x.shape, 1)), axis=2)[..., 0]
        loss = float(-(np.log(picked + 1e-9) * mask).sum() / total)
        np.put_along_axis(p, np.broadcast_to(labels[None, :, None], (*x.shape, 1)), picked[..., None] - 1, axis=2)
        error = p * (mask / total)[..., None]
        d_input, d_state, d_out = np.zeros_like(self.input), np.zeros_like(self.state), np.zeros_like(self.out)
        for d in (0, 1):
            d_out[d] = np.einsum("tbh,tbk->hk", hs[d], error)
            passed = np.zeros_like(hs[d][0])
            d_given = np.empty((*x.shape, 3 * HIDDEN), dtype=np.float32)
            for t, before, update, reset, candidate, fed in reversed(kept[d]):
                dh = error[t] @ self.out[d].T + passed
                d_update = dh * (before - candidate) * update * (1 - update)
                d_candidate = dh * (1 - update) * (1 - candidate * candidate)
                d_reset = d_candidate * fed * reset * (1 - reset)
                d_fed = np.concatenate((d_update, d_reset, d_candidate * reset), axis=1)
                d_given[t] = np.concatenate((d_update, d_reset, d_candidate), axis=1)
                d_state[d] += before.T @ d_fed
                passed = dh * update + d_fed @ self.state[d].T
            for c in range(3 * HIDDEN):
                d_input[d][:, c] = np.bincount(x.ravel(), d_given[..., c].ravel(), minlength=256)
        return [d_input, d_state, d_out, error.sum(axis=(0, 1))], loss


def train(texts: list[bytes], labels: list[str], steps: int = 300, batch: int = 192, rate: float = 0.02, seed: int = 5) -> Network:
    """A network for the labels that occur, trained on all windows of the texts."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    k = len(languages)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    net = Network(languages, draw(2, 256, 3 * HIDDEN), draw(2, HIDDEN, 3 * HIDDEN), draw(2, HIDDEN, k), np.zeros(k, np.float32))
    cut = [windows(t) for t in texts]
    x = np.concatenate(cut)
    y = np.repeat([languages.index(v) for v in labels], [len(c) for c in cut])
    filled = np.concatenate([np.minimum(WINDOW, len(t) - WINDOW * np.arange(len(c))) for t, c in zip(texts, cut, strict=True)])
    weights = [net.input, net.state, net.out, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    shares = 1.0 / np.bincount(y, minlength=k)[y]
    shares /= shares.sum()
    for step in range(1, steps + 1):
        pick = rng.choice(len(x), batch, p=shares)
        mask = (np.arange(WINDOW)[:, None] < filled[pick][None, :]).astype(np.float32)
        grads, _ = net.gradients(np.ascontiguousarray(x[pick].T), y[pick], mask)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1.0, 2.0 * (1 - (step - 1) / steps))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network from documents with a language that are not held out; None if there are none."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = given.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").count().orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages; group them first")
    if not sizes:
        return None
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], min(1.0, LEARN_DOCS / r["count"])).otherwise(share)
    sampled = known.where((hash_unit(F.col("doc_id"), F.lit(3)) < share) & (F.length("text") > 0)).withColumn("h", F.xxhash64("doc_id", "text"))
    room: dict[str, int] = {}
    chosen: list[int] = []
    found = sampled.select("lang", "h", F.octet_length("text").alias("n")).distinct().orderBy("h", "lang").limit(2 * LEARN_DOCS * len(sizes)).collect()
    for r in found:
        if r.n <= room.setdefault(r.lang, LEARN_BYTES):
            room[r.lang] -= r.n
            chosen.append(r.h)
    chosen += [min((r.n, r.h) for r in found if r.lang == lang)[1] for lang, left in room.items() if left == LEARN_BYTES]
    picked = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in sorted(set(chosen))], "h long"))  # at most LEARN_DOCS a language, twice
    rows = sampled.join(picked, "h", "left_semi").select("lang", "h", "text").distinct().orderBy("h", "lang", "text").collect()
    texts = [(r.text.encode(), r.lang) for r in rows if _LETTER(r.text)]
    return train([t for t, _ in texts], [v for _, v in texts]) if texts else None


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, keep: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; with ``carry``, those columns of the rows for which ``keep``, a condition on the former, holds."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights a language

    carried = Carried(docs, carry or [], text_col)
    passed, names = carried.arrays(), carried.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            read = [i for i, t in enumerate(texts) if own is not None and t and _LETTER(t)]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if read:
                p = own.documents([texts[i].encode() for i in read])
                for i, k, s in zip(read, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    langs[i], scores[i] = own.languages[k], min(1.0, s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *passed(b, 1, 3)], names=["doc_id", "held_out", "lang_pred", "score", *names])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"), *carried.given)
    out = given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double" + carried.schema)
    return out.where(F.lit(True) if keep is None else keep).select(*carried.restored()) if carry else out.select(F.col("doc_id").alias(id_col), "held_out", "lang_pred", "score")
