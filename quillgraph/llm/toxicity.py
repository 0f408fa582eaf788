"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-cased words and their beginnings of four to six letters, hashed to
``BUCKETS`` buckets and taken once each. The score is the logistic of

    w0 + sum_i w_i + 1/2 sum_f ((sum_i v_if)^2 - sum_i v_if^2),

so a pair of terms, such as an insult with a group's name, may count where neither does alone.
It is learned on at most ``LEARN_ROWS`` labelled rows, chosen by the hash of their ids, of at most
``LEARN_BYTES`` bytes together, in three steps. Dual averaging with an L1 term that grows with a
term's own noise gives sparse linear weights. Pairs of terms are then tested on what is left of the
error: any two that meet in enough rows, whether or not either has a weight. The leading
directions of the pairs found start the factors, and AdaGrad fits all weights and factors together.

Defined results: a null or empty text has no terms and scores as w0 alone. Without labelled rows
of both classes every score is the share of toxic ones, or 0 without any. Of several labels for a
document the largest counts, of several texts the smallest is learned from; copies of a text are
learned from once, with their largest label. Repeated rows are all scored. Columns besides id, text and label are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import Carried, bound_batches, held_out

#: Labelled rows to learn from, and bytes of their texts, at most.
LEARN_ROWS, LEARN_BYTES = 8000, 64 << 20
#: Rows of the learned sample in which a term must occur.
LEAST_ROWS = 3
#: Standard errors that a term's mean gradient must exceed, and that a pair's joint error must differ by from what its terms explain.
LEAST_Z, LEAST_PAIR_Z = 3.5, 9.0
#: Share of the squared error that the rows hold in which pairs are looked for, and columns of terms that are compared at once.
ENERGY, BLOCK = 0.9, 512
BUCKETS = 1 << 18
FACTORS = 4
#: Distinct pieces of text whose terms a worker keeps.
KEEP_PIECES = 200_000
_WORD = regex.compile(r"[\p{L}\p{M}]+")


def word_terms(word: str) -> set[int]:
    """Buckets of a word and of its beginnings."""
    names = {"=" + word} | {word[:n] for n in (4, 5, 6) if len(word) >= n}
    return {zlib.crc32(n.encode("utf-8", "replace")) % BUCKETS for n in names}


class Terms:
    """Finds the distinct term buckets of texts and keeps those of pieces it has met; ``only`` names the buckets that count."""

    def __init__(self, only: np.ndarray | None = None) -> None:
        self.only = None if only is None else frozenset(only.tolist())
        self._start()

    def _start(self) -> None:
        self.codes: defaultdict[str, int] = defaultdict(count().__next__)
        self.found: list[tuple[int, ...]] = []

    def of(self, text: str | None) -> np.ndarray:
        """Distinct buckets in rising order."""
        if len(self.codes) > KEEP_PIECES:
            self._start()
        own = set(map(self.codes.__getitem__, (text or "").lower().split()))
        fresh = list(islice(reversed(self.codes), len(self.codes) - len(self.found)))
        for piece in reversed(fresh):
            terms = set().union(*map(word_terms, _WORD.findall(piece)))
            self.found.append(tuple(terms if self.only is None else terms & self.only))
        found = self.found
        return np.array(sorted(set().union(*[f for c in own if (f := found[c])])), dtype=np.int32)


@dataclass
class Machine:
    """A fitted factorization machine."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities of rows of buckets."""
        out = np.empty(len(rows))
        for i, idx in enumerate(rows):
            v = self.v[idx]
            total = v.sum(axis=0)
            out[i] = self.w0 + self.w[idx].sum() + 0.5 * float(total @ total - (v * v).sum())
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def _logistic(raw: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30)))


class Rows:
    """Rows of term numbers, flat, with the row of each."""

    def __init__(self, idx: np.ndarray, sizes: np.ndarray, terms: int) -> None:
        self.idx, self.sizes, self.terms = idx, sizes, terms
        self.ends = np.cumsum(sizes)
        self.row = np.repeat(np.arange(sizes.size, dtype=np.int32), sizes)

    @property
    def seen(self) -> np.ndarray:
        """The rows of each term."""
        return np.bincount(self.idx, minlength=self.terms)

    def to_terms(self, values: np.ndarray) -> np.ndarray:
        """Sums of the rows' values over each term's rows."""
        return np.bincount(self.idx, values[self.row], minlength=self.terms)

    def to_rows(self, values: np.ndarray) -> np.ndarray:
        """Sums of the terms' values over each row's terms."""
        return np.bincount(self.row, values[self.idx], minlength=self.sizes.size)

    def only(self, terms: np.ndarray) -> Rows:
        """The rows with these terms alone, numbered anew."""
        place = np.full(self.terms, -1, dtype=np.int32)
        place[terms] = np.arange(terms.size)
        moved = place[self.idx]
        kept = moved >= 0
        return Rows(moved[kept], np.bincount(self.row[kept], minlength=self.sizes.size), terms.size)

    def part(self, pick: np.ndarray) -> Rows:
        """Some of the rows."""
        own = [self.idx[e - n : e] for e, n in zip(self.ends[pick].tolist(), self.sizes[pick].tolist(), strict=True)]
        return Rows(np.concatenate([np.zeros(0, np.int32), *own]), self.sizes[pick], self.terms)


def _linear(rows: Rows, labels: np.ndarray, weight: np.ndarray, rng: np.random.Generator, epochs: int = 10, batch: int = 128, rate: float = 0.1) -> tuple[float, np.ndarray]:
    """The constant and sparse weights by dual averaging: a term whose mean gradient is within its noise has none."""
    share = float((weight * labels).sum() / weight.sum())
    noise = LEAST_Z * np.sqrt(rows.seen * (weight**2).mean() * share * (1 - share)) / labels.size
    sums, squares, w = np.zeros(rows.terms), np.full(rows.terms, 1e-3), np.zeros(rows.terms)
    w0, g0, step = math.log(share / (1 - share)), 1e-3, 0
    for _ in range(epochs):
        order = rng.permutation(labels.size)
        for at in range(0, order.size, batch):
            pick = order[at : at + batch]
            own = rows.part(pick)
            error = weight[pick] * (_logistic(w0 + own.to_rows(w)) - labels[pick])
            g, step = own.to_terms(error) / pick.size, step + 1
            sums += g
            squares += g * g
            w = -rate * step / np.sqrt(squares) * np.sign(sums) * np.maximum(np.abs(sums) / step - noise, 0)
            d0 = float(error.mean())
            g0 += d0 * d0
            w0 -= rate * d0 / math.sqrt(g0)
    return w0, w


def _pairs(rows: Rows, error: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of terms (i, j, strength) in whose common rows the error differs from what either alone has.

    A sum of n numbers is at most sqrt(n) times the root of the sum of their squares, so terms in
    fewer than ``LEAST_PAIR_Z`` squared rows have no such pair. Terms in the same rows are taken once.
    """
    by = np.argsort(-np.abs(error), kind="stable")
    energy = np.cumsum(error[by] ** 2)
    by = np.sort(by[: int(np.searchsorted(energy, ENERGY * energy[-1])) + 1])
    rows, error = rows.part(by), error[by]
    often = np.flatnonzero(rows.seen >= LEAST_PAIR_Z**2)
    marks = rows.to_terms(np.random.default_rng(0).random(by.size))  # terms in the same rows have the same mark
    cols = often[np.unique(np.round(marks[often], 6), return_index=True)[1]]
    kept = rows.only(cols)
    seen = kept.seen
    own = kept.to_terms(error) / np.maximum(seen, 1)

    def dense(at: int) -> np.ndarray:
        x = np.zeros((by.size, min(BLOCK, cols.size - at)), np.float32)
        inside = (kept.idx >= at) & (kept.idx < at + BLOCK)
        x[kept.row[inside], kept.idx[inside] - at] = 1
        return x

    found, e = [], error.astype(np.float32)[:, None]
    for a in range(0, cols.size, BLOCK):
        left = dense(a)
        for b in range(a, cols.size, BLOCK):
            right = left if a == b else dense(b)
            apart = (left * e).T @ right - (left.T @ right) * (own[a : a + BLOCK, None] + own[None, b : b + BLOCK] - error.mean())
            i, j = np.nonzero(np.abs(apart) >= LEAST_PAIR_Z * np.sqrt((left * e * e).T @ right + 1e-3))
            strength = apart[i, j] / np.sqrt(seen[i + a] * seen[j + b])
            found += [(cols[i[i + a < j + b] + a], cols[j[i + a < j + b] + b], strength[i + a < j + b])]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _factors(rows: Rows, error: np.ndarray, rng: np.random.Generator, scale: float = 0.1) -> np.ndarray:
    """Factors that start along the leading directions of the pairs found."""
    v = np.zeros((rows.terms, FACTORS))
    i, j, strength = _pairs(rows, error)
    if not i.size:
        return v
    used = np.unique(np.concatenate((i, j)))
    i, j = np.searchsorted(used, i), np.searchsorted(used, j)
    q = np.linalg.qr(rng.normal(0, 1, (used.size, min(2 * FACTORS, used.size))))[0]
    for _ in range(20):
        moved = np.stack([-np.bincount(i, strength * c[j], minlength=used.size) - np.bincount(j, strength * c[i], minlength=used.size) for c in q.T], axis=1)
        values, vectors = np.linalg.eigh((q.T @ moved + moved.T @ q) / 2)
        directions = q @ vectors
        q = np.linalg.qr(moved)[0]
    for f in range(min(FACTORS, values.size)):
        if values[-1 - f] > 0:
            v[used, f] = scale * directions[:, -1 - f] / np.abs(directions[:, -1 - f]).max()
    return v


def _joint(rows: Rows, labels: np.ndarray, weight: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray, rng: np.random.Generator, least_steps: int, epochs: int, batch: int, rate: float, l2: float) -> float:
    """Fit weights and factors in place by AdaGrad over mini-batches; the constant is returned."""
    gw, gv, g0 = np.full(w.shape, 1e-3), np.full(v.shape, 1e-3), 1e-3
    for _ in range(max(epochs, -(-least_steps * batch // labels.size))):
        order = rng.permutation(labels.size)
        for at in range(0, order.size, batch):
            pick = order[at : at + batch]
            own = rows.part(pick)
            totals = np.stack([own.to_rows(c) for c in v.T], axis=1)
            error = weight[pick] * (_logistic(w0 + own.to_rows(w) + 0.5 * ((totals**2).sum(axis=1) - own.to_rows((v * v).sum(axis=1)))) - labels[pick]) / pick.size
            dw = own.to_terms(error)
            dv = np.stack([own.to_terms(error * t) for t in totals.T], axis=1) - dw[:, None] * v + 10 * l2 * v
            dw = dw + l2 * w
            gw += dw * dw
            gv += dv * dv
            w -= rate * dw / np.sqrt(gw)
            v -= 0.5 * rate * dv / np.sqrt(gv)
            d0 = float(error.sum())
            g0 += d0 * d0
            w0 -= 0.2 * rate * d0 / math.sqrt(g0)
    return w0


def fit(found: list[np.ndarray], labels: np.ndarray, least_steps: int = 2000, epochs: int = 12, batch: int = 64, rate: float = 0.1, l2: float = 1e-4, seed: int = 17) -> Machine:
    """A machine for rows of buckets; the same rows in the same order give the same machine."""
    share = float(labels.mean()) if labels.size else 0.0
    machine = Machine(math.log(max(share, 1e-12) / max(1 - share, 1e-12)), np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32))
    if share in (0.0, 1.0):
        return machine
    rng = np.random.default_rng(seed)
    rows = Rows(np.concatenate([np.zeros(0, np.int32), *found]), np.array([r.size for r in found], dtype=np.int64), BUCKETS)
    known = np.flatnonzero(rows.seen >= LEAST_ROWS)
    rows = rows.only(known)
    weight = np.where(labels > 0, min(4.0, 0.5 / share), 1.0)
    w0, w = _linear(rows, labels, weight, rng)
    v = _factors(rows, weight * (_logistic(w0 + rows.to_rows(w)) - labels), rng)
    active = np.flatnonzero((w != 0) | (v != 0).any(axis=1))
    w, v = w[active], v[active]
    machine.w0 = _joint(rows.only(active), labels, weight, w0, w, v, rng, least_steps, epochs, batch, rate, l2)
    machine.w[known[active]], machine.v[known[active]] = w, v
    return machine


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine from the labelled rows that are not held out."""
    bound_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEARN_ROWS)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most LEARN_ROWS rows
    once = texts.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sizes = sorted((zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.n) for r in once.select("doc_id", F.octet_length("text").alias("n")).collect())  # at most LEARN_ROWS rows
    room = np.cumsum([n for _, _, n in sizes])
    within = [i for (_, i, _), n in zip(sizes, room.tolist(), strict=True) if n <= LEARN_BYTES]
    if len(within) < len(sizes):
        once = once.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in within], chosen.select("doc_id").schema)), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.float64()), b.column(2), pa.array([terms.of(t.as_py()).tobytes() for t in b.column(3)], pa.binary())], names=["doc_id", "y", "h", "terms"])

    given = once.select("doc_id", "y", F.xxhash64("text").alias("h"), "text")
    rows = given.mapInArrow(run, "doc_id string, y double, h bigint, terms binary").toArrow().sort_by([("doc_id", "ascending"), ("h", "ascending")])
    greatest: dict[int, float] = {}
    first: dict[int, int] = {}
    for i, (h, y) in enumerate(zip(rows.column("h").to_pylist(), rows.column("y").to_pylist(), strict=True)):
        greatest[h] = max(y, greatest.get(h, y))
        first.setdefault(h, i)
    cells = rows.column("terms").combine_chunks()
    return fit([np.frombuffer(cells[i].as_buffer(), np.int32) for i in first.values()], np.array([float(greatest[h] > 0) for h in first]))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; with ``carry``, those columns of the rows that are not predicted toxic."""
    spark = docs.sparkSession
    bound_batches(spark)
    active = np.flatnonzero((machine.w != 0) | (machine.v != 0).any(axis=1))
    shared = spark.sparkContext.broadcast((machine.w0, active, machine.w[active], machine.v[active]))  # at most BUCKETS weights

    carried = Carried(docs, carry or [], text_col)
    passed, names = carried.arrays(), carried.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w0, active, w, v = shared.value
        place = np.full(BUCKETS, -1, dtype=np.int32)
        place[active] = np.arange(active.size)
        own, terms = Machine(w0, w, v), Terms(active)
        for b in batches:
            rows = [place[terms.of(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(own.scores(rows), pa.float64()), *passed(b, 1, 3)], names=["doc_id", "held_out", "score", *names])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"), *carried.given)
    out = given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double" + carried.schema)
    judged = (F.col("score") >= threshold).cast("int").alias("predicted")
    return out.where(F.col("score") < threshold).select(*carried.restored()) if carry else out.select(F.col("doc_id").alias(id_col), "held_out", "score", judged)
