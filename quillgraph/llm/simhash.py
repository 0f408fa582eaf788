"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits agree in at least 5 of their 8 bytes. The
index has an entry for each position and byte value. A single entry's list holds a 256th of all
fingerprints, so lists are kept for entries that meet: the fingerprints that four entries share, for
14 sets of four positions, of which any five agreeing positions hold one. Within a list the
agreeing bytes of a pair are tallied, pairs with fewer than five are dropped and the rest verified
bit by bit. No pair is ever written as a row: a list gives one row per member that is linked to a
smaller one, so a group of copies costs as many rows as it has members. Equal fingerprints are
merged before posting.

A list of more than ``SPLIT_ABOVE`` members is not compared where it is found but dealt out again by
a fifth entry, four lists a member, over other tasks. All members of such a list have the tally; if it
is long still, each is looked up with every change of up to three of the other 24 bits, which takes
time in proportion to the members, and ``SHARES`` tasks take a part of the changes each.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; a
repeated row shares its copies' component. A null id takes part but is never a component's id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from quillgraph.llm.common import bound_batches, checkpoint

SEED = 42
BYTES = 8
#: Shingles hashed at once, which bounds memory for long texts.
CHUNK = 1 << 16
#: Members of a list above which it is dealt out by one more entry, and tasks that share the changes to look up in a list that is long still.
SPLIT_ABOVE, SHARES = 4096, 4


def fingerprint(raw: bytes | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text: bit i is 1 if set in over half of the shingle hashes."""
    words = (raw or b"").lower().split()  # of bytes, lower() is A-Z only and split() is at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    total = len(words) - width + 1
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, CHUNK):
        to = min(total, at + CHUNK)
        hashes = np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts[at:to], ends[at + width - 1 : to + width - 1])], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint for every row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, fp bigint")


def covering_blocks(agreeing: int, size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` byte positions such that any ``agreeing`` positions contain one of them (greedy choice)."""
    open_sets = set(combinations(range(BYTES), agreeing))
    blocks = list(combinations(range(BYTES), size))
    chosen = []
    while open_sets:
        best = max(blocks, key=lambda b: sum(set(b) <= set(s) for s in open_sets))
        chosen.append(best)
        open_sets = {s for s in open_sets if not set(best) <= set(s)}
    return chosen


def _linked(values: np.ndarray, max_bits: int, least: int) -> np.ndarray:
    """For sorted distinct values, the index of the smallest value each is linked to, directly or not."""
    root = np.arange(values.size)
    rest = np.arange(values.size)
    while rest.size:
        first, frontier, rest = rest[0], rest[:1], rest[1:]
        while frontier.size and rest.size:
            hit = np.zeros(rest.size, dtype=bool)
            step = max(1, (1 << 18) // rest.size)
            for at in range(0, frontier.size, step):
                x = values[frontier[at : at + step]][:, None] ^ values[rest][None, :]
                tally = (x.view(np.uint8).reshape(*x.shape, BYTES) == 0).sum(axis=-1)
                kept = tally >= least
                hit |= (kept & (np.bitwise_count(x.view(np.uint64)) <= max_bits)).any(axis=0)
            frontier, rest = rest[hit], rest[~hit]
            root[frontier] = first
    return root


def _changed(values: np.ndarray, block: tuple[int, ...], max_bits: int, share: int) -> np.ndarray:
    """For distinct values, sorted as unsigned, that agree in the bytes of ``block``: the index of the first one that each is joined to by a share of the changes in the other bytes."""
    bits = [8 * p + b for p in range(BYTES) if p not in block for b in range(8)]
    changes = [sum(1 << b for b in c) for n in range(1, max_bits + 1) for c in combinations(bits, n)]
    root = np.arange(values.size)
    for change in changes[share::SHARES]:
        other = values ^ np.uint64(change)
        at = np.minimum(np.searchsorted(values, other), values.size - 1)
        i = np.flatnonzero(values[at] == other)
        while (apart := root[i] != root[at[i]]).any():
            i = i[apart]
            np.minimum.at(root, np.maximum(root[i], root[at[i]]), np.minimum(root[i], root[at[i]]))
            while (root[root] != root).any():
                root = root[root]
    return root


def _lists(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(key, members, whole) of rows (key, fp) sorted by key; a list of over ``most`` members comes in several parts that are not whole."""
    key, held, split = None, [], False
    for b in batches:
        keys, values = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [keys.size])) if keys.size else np.zeros(1, np.int64)
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if keys[s] != key:
                if held:
                    yield key, np.concatenate(held), not split
                key, held, split = keys[s], [], False
            held.append(values[s:e])
            if sum(h.size for h in held) > most:
                yield key, np.concatenate(held), False
                held, split = [], True
    if held:
        yield key, np.concatenate(held), not split


def _key(block: tuple[int, ...], number: int, fp: str = "fp") -> Column:
    key = F.lit(number).cast("long")
    for p in block:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)))
    return key


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Distinct (u, v), v < u, that join the distinct fingerprints ``fp`` to components within lists."""
    least = BYTES - max_bits
    blocks = covering_blocks(least, least - 1)
    posted = fps.select(F.explode(F.array(*[_key(b, n) for n, b in enumerate(blocks)])).alias("key"), "fp").repartition("key").sortWithinPartitions("key")

    def rows(u: list[np.ndarray], v: list[np.ndarray], more: bool) -> pa.RecordBatch:
        u, v = np.concatenate(u), np.concatenate(v)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(u.size, more))], names=["u", "v", "more"])

    def joined(values: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(root != np.arange(values.size))
        a, b = values[moved].view(np.int64), values[root[moved]].view(np.int64)
        return np.maximum(a, b), np.minimum(a, b)

    def compare(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = np.unique(values)
        return joined(values, _linked(values, max_bits, least))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for key, values, whole in _lists(batches, SPLIT_ABOVE):
            if not whole:
                yield rows([values], [np.full(values.size, key >> (8 * (least - 1)))], True)
            elif values.size > 1:
                u, v = compare(values)
                us.append(u)
                vs.append(v)
                if len(us) > 1 << 14:
                    yield rows(us, vs, False)
                    us, vs = [], []
        if us:
            yield rows(us, vs, False)

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, values, _ in _lists(batches, 1 << 62):
            share, block = key % SHARES, fifth[key // SHARES >> (8 * least)]
            values = np.unique(values.view(np.uint64))
            if values.size > SPLIT_ABOVE:
                u, v = joined(values, _changed(values, block, max_bits, int(share)))
            elif share == 0:
                u, v = compare(values.view(np.int64))
            else:
                continue
            yield rows([u], [v], False)

    once = checkpoint(posted.mapInArrow(short, "u bigint, v bigint, more boolean"))
    edges = once.where("not more").select("u", "v")
    if once.where("more").isEmpty():
        return edges.distinct()
    fifth = list(combinations(range(BYTES), least))  # a list goes on under the sets that hold its own
    under = F.lit(None).cast("array<bigint>")
    for n, block in enumerate(blocks):
        under = F.when(F.col("v") == n, F.array(*[_key(f, m, "u") for m, f in enumerate(fifth) if set(block) <= set(f)])).otherwise(under)
    dealt = once.where("more").select(F.col("u").alias("fp"), F.explode(under).alias("key")).distinct()
    shared = dealt.select(F.explode(F.array(*[F.col("key") * SHARES + i for i in range(SHARES)])).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    return edges.union(shared.mapInArrow(long, "u bigint, v bigint, more boolean").select("u", "v")).distinct()


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v): each member u of a component but its smallest, v. Alternates large and small stars until nothing changes."""
    edges, before = checkpoint(edges), None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; links are transitive and none is lost."""
    found = checkpoint(fingerprints(docs, id_col, text_col, width))
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    star = stars(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(star.select(F.col("u").alias("fp"), F.col("v").alias("up")), "fp", "left").select("fp", "first_id", F.coalesce("up", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return found.join(named, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
