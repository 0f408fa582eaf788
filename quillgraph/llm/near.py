"""Near-duplicates by SimHash, verified by the Jaccard similarity of word shingles: every pair of at least 0.8 is found.

SimHash goes first: fingerprints of the same shingles, linked through the byte-position index, its
count filter and the bit-by-bit verification of ``simhash.links``. A link holds if the sets verify it.
No 64-bit SimHash distance that an index could serve reaches all pairs of that similarity (the README has the
recall), so what it leaves apart is completed by an exact prefix filter: with the shingles of every text in one
total order, two sets of Jaccard 0.8 share a shingle among the first s - ceil(0.8 s) + 1 of each.
The order puts shingles that a sample of the texts holds often last, so that common lines and
passages are hardly ever posted; any order gives the same links. Sizes and places in the order
rule out most pairs of a posting list. Each set has a signature of about a bit a shingle, whose bits are
the parities of the shingles there; where two signatures differ, the sets do, so a pair whose
signatures differ in more bits than similar sets may differ in shingles is ruled out too. What is left is
verified on the sets themselves.

In a long posting list a pair is a candidate if the signatures of its sets, here of ``WORDS`` words whatever the set,
leave it a chance. The list first gives a spanning forest of its candidates, the nearest signatures
first, which has fewer rows than members; only members of different components after that are paired.
So a group of copies or of near copies costs as many rows as it has members.

Defined results: texts of up to ``width`` words are one shingle; texts without words are near each
other. Equal sets of shingles, and shingles, are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bound_batches, checkpoint, hash_unit
from quillgraph.llm.simhash import fingerprint, links, stars

SEED = 42
#: Texts in the sample that tells common shingles, and how many of these are told to the workers. They shift work only.
SAMPLE, COMMON = 4096, 1 << 16
#: Sets up to which the keys of those to verify are broadcast; beyond, they are joined.
FEW = 400_000
#: Members of a posting list up to which all pairs are candidates at once.
SHORT = 8
#: 64-bit words of the signatures that long lists are compared by.
WORDS = 16
#: Places in a long list's square that are looked at at once, and pairs whose signatures are: what a worker holds for a list besides its members.
BLOCK, SIGNED = 1 << 17, 1 << 13
#: What a pair's row has in place of a member's size and place.
PAIR = -1
PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)


def shingles(raw: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; words are as in SimHash."""
    words = (raw or b"").lower().split()
    if not words:
        return np.empty(0, np.int64)
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    w = np.fromiter((digest(x, SEED) for x in words), np.uint64, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        h = (h ^ w[k : k + n]) * PRIMES[k % len(PRIMES)]
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def signature(hashes: np.ndarray, bits: int = 0) -> bytes:
    """Parities of the shingles in so many bits, or in as many as the next power of two, 64 at least."""
    bits = bits or 1 << max(6, (hashes.size - 1).bit_length())
    counts = np.bincount((hashes.view(np.uint64) >> np.uint64(20)) & np.uint64(bits - 1), minlength=bits)
    return np.packbits((counts & 1).astype(bool), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """The least number of shingles that two sets differ in, by their signatures; the longer one is folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(x.size, y.size)
    fold = lambda s: np.bitwise_xor.reduce(s.reshape(-1, size), axis=0)
    return int(np.bitwise_count(fold(x) ^ fold(y)).sum())


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first s - ceil(0.8 s) + 1 of s shingles in the order of sampled count and hash."""
    if not hashes.size:
        return hashes
    often = np.zeros(hashes.size, np.int64)
    if common.size:
        at = np.minimum(np.searchsorted(common, hashes), common.size - 1)
        often = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, often))][: hashes.size - (4 * hashes.size + 4) // 5 + 1]


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a bounded sample hold, sorted, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), width))], names=["h"])

    rate = SAMPLE / max(1, docs.count())
    sample = docs.where(hash_unit(F.col("t"), F.col("doc_id").cast("string")) < rate).select("t")
    rows = sample.mapInArrow(run, "h bigint").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    rows.sort()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of (size, place in the order) that share the shingle there can reach Jaccard 0.8."""
    sa, pa_, sb, pb = a[:, None, 0], a[:, None, 1], b[None, :, 0], b[None, :, 1]
    near = 5 * np.minimum(sa, sb) >= 4 * np.maximum(sa, sb)
    return near & (9 * np.minimum(sa - pa_, sb - pb) >= 4 * (sa + sb))


def _near(at: np.ndarray, parts: np.ndarray, words: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the one, place before it, bits apart) of the fitting pairs that are in different parts and whose signatures, if given, are near enough."""
    step = max(1, BLOCK // len(at))
    for s in range(0, len(at), step):
        before = min(len(at), s + step)  # a pair's second is before its first, so what comes after this block is left to later ones
        i, j = np.nonzero(_fits(at[s : s + step], at[:before]) & (parts[s : s + step, None] != parts[None, :before]))
        i += s
        later = i > j
        i, j = i[later], j[later]
        for c in range(0, i.size, SIGNED):
            a, b = i[c : c + SIGNED], j[c : c + SIGNED]
            apart = np.zeros(a.size, np.int64)
            if words is not None:
                both = at[a, 0] + at[b, 0]
                apart = np.bitwise_count((words[a] ^ words[b]).view(np.uint64)).sum(axis=1, dtype=np.int64)  # unsigned, as counts of signed numbers are of their magnitude
                near = 9 * (both - apart) >= 8 * both
                a, b, apart = a[near], b[near], apart[near]
            if a.size:
                yield a, b, apart


def _pairs(ids: np.ndarray, at: np.ndarray, parts: np.ndarray, words: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(larger, smaller) of the pairs of sorted ids that ``_near`` finds."""
    for a, b, _ in _near(at, parts, words):
        yield ids[a], ids[b]


def _spanning(a: np.ndarray, b: np.ndarray, groups: int) -> np.ndarray:
    """Which of the edges (a, b) between groups join them to a forest; an edge goes before those after it."""
    root, live, kept = np.arange(groups), np.arange(a.size), []
    while (live := live[root[a[live]] != root[b[live]]]).size:
        first = np.full(groups, a.size)
        np.minimum.at(first, root[a[live]], live)
        np.minimum.at(first, root[b[live]], live)
        chosen = np.unique(first[first < a.size])
        kept.append(chosen)
        i, j = root[a[chosen]], root[b[chosen]]
        while (open_ := root[i] != root[j]).any():
            i, j = i[open_], j[open_]
            np.minimum.at(root, np.maximum(root[i], root[j]), np.minimum(root[i], root[j]))
            while (root[root] != root).any():
                root = root[root]
    return np.sort(np.concatenate(kept)) if kept else live


def _forest(ids: np.ndarray, at: np.ndarray, parts: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(larger, smaller) of pairs that ``_near`` finds, which join all parts that any of them join: a forest, those of the least share of bits apart first."""
    names, part = np.unique(parts, return_inverse=True)
    if names.size == 1:
        return
    held, fresh, count = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), [], 0

    def spanned() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, share = (np.concatenate(x) for x in zip(held, *fresh, strict=True))
        order = np.lexsort((b, a, share))
        kept = order[_spanning(part[a[order]], part[b[order]], names.size)]
        return a[kept], b[kept], share[kept]

    for x, y, apart in _near(at, part, words):
        fresh.append((x, y, apart / (at[x, 0] + at[y, 0])))
        count += x.size
        if count > 1 << 16:  # a search for each of the small blocks would go over all groups too often
            held, fresh, count = spanned(), [], 0
    a, b, _ = spanned()
    if a.size:
        yield ids[a], ids[b]


def _candidates(posted: DataFrame, pairs: Callable | None = None) -> DataFrame:
    """Of rows (key, id, at): the pairs (u, v), v < u, of short lists, and the long lists' rows. Of these with part and the words of the signature: what ``pairs`` gives. ``at`` packs size and place."""
    signed = pairs is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["u", "v", "at"], np.empty((0, 3 + signed * (1 + WORDS)), np.int64)

        def rows(u: np.ndarray, v: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*map(pa.array, (u, v, at))], names=names)

        def lists(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(x[:, 0])) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(x)]))
            us, vs, count = [], [], 0
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                own = x[s:e][np.argsort(x[s:e, 1], kind="stable")]
                ids, at = own[:, 1], np.stack((own[:, 2] >> 32, own[:, 2] & 0xFFFFFFFF), axis=1)
                if not signed and e - s > SHORT:
                    yield rows(own[:, 0], ids, own[:, 2])
                    continue
                for u, v in pairs(ids, at, own[:, 3], own[:, 4:]) if signed else _pairs(ids, at, ids):
                    us.append(u)
                    vs.append(v)
                    count += u.size
                    if count > 1 << 16:
                        u, v = np.concatenate(us), np.concatenate(vs)
                        yield rows(u, v, np.full(u.size, PAIR))
                        us, vs, count = [], [], 0
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                yield rows(u, v, np.full(u.size, PAIR))

        for b in batches:
            now = np.concatenate((held, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)))
            if not len(now):
                continue
            end = int(np.searchsorted(now[:, 0], now[-1, 0]))
            if end:
                yield from lists(now[:end])
            held = now[end:]
        if len(held):
            yield from lists(held)

    dealt = posted.select("key", "id", "at", *["part", *[F.element_at("words", w + 1).alias(f"w{w}") for w in range(WORDS)]] * signed).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "u bigint, v bigint, at bigint")


def _fingerprint_links(sets: DataFrame, max_bits: int) -> DataFrame:
    """Of rows (id, fp): pairs (u, v), v < u, of sets whose fingerprints SimHash links; sets of one fingerprint with the first of them."""
    sets = sets.select("fp", "id")
    first = checkpoint(sets.groupBy("fp").agg(F.min("id").alias("first")))
    one = lambda end: first.select(F.col("fp").alias(end), F.col("first").alias(f"i{end}"))
    apart = links(first.select("fp"), max_bits).join(one("u"), "u").join(one("v"), "v").select(F.greatest("iu", "iv").alias("u"), F.least("iu", "iv").alias("v"))
    return apart.union(sets.join(first, "fp").where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v")))


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs (u, v) of sets whose Jaccard similarity is 0.8 at least; the sets are made again from one text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).to_numpy() + b.column(3).to_numpy()
            apart = np.array([differing(x.as_py(), y.as_py()) for x, y in zip(b.column(4), b.column(5), strict=True)], dtype=np.int64)
            yield b.filter(pa.array(9 * (sizes - apart) >= 8 * sizes)).select(["u", "v"])

    one = lambda end: reps.select(F.col("id").alias(end), F.col("size").alias(f"s{end}"), F.col("sig").alias(f"g{end}"))
    signed = pairs.join(one("u"), "u").join(one("v"), "v").select("u", "v", "su", "sv", "gu", "gv")
    pairs = checkpoint(signed.mapInArrow(likely, "u bigint, v bigint"))
    needed = checkpoint(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(reps, "id").select("id", "rep.*"))
    if needed.count() <= FEW:
        needed = F.broadcast(needed)
    texts = docs.select("t", F.xxhash64("t").alias("k"), F.col("doc_id").alias("d"))
    same = (F.col("k") == F.col("tk")) & F.col("d").eqNullSafe(F.col("doc_id"))
    sets = checkpoint(texts.join(needed, same).select("id", "t").dropDuplicates(["id"]).mapInArrow(run, "id bigint, s array<bigint>"))
    a, b = sets.select(F.col("id").alias("u"), F.col("s").alias("a")), sets.select(F.col("id").alias("v"), F.col("s").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return checkpoint(pairs.join(a, "u").join(b, "v").where(9 * shared >= 4 * (F.size("a") + F.size("b"))).select("u", "v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, max_bits: int = 3) -> DataFrame:
    """(doc_id, text_key, component, component_id) for every row; links are transitive. Fingerprints link at ``max_bits``, which shifts work only.

    text_key is xxhash64 of the text's bytes, component one of its set hashes and component_id its smallest id, which
    components share if rows with different texts share an id.
    """
    bound_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(_common(given, width))  # at most COMMON numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), width) for t in b.column(2)]
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            first = pa.array([prefix(s, *shared.value) for s in sets], pa.list_(pa.int64()))
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(2)], dtype=np.uint64).view(np.int64)
            words = pa.array([np.frombuffer(signature(s, 64 * WORDS), np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids), pa.array([s.size for s in sets], pa.int64()), first, pa.array([signature(s) for s in sets], pa.binary()), words, pa.array(fps)], names=["doc_id", "tk", "id", "size", "first", "sig", "words", "fp"])

    kind = given.schema["doc_id"].dataType.simpleString()
    found = checkpoint(given.select("doc_id", F.xxhash64("t").alias("tk"), "t").mapInArrow(run, f"doc_id {kind}, tk bigint, id bigint, size bigint, first array<bigint>, sig binary, words array<bigint>, fp bigint"))
    sets = found.groupBy("id").agg(F.min(F.struct("tk", "doc_id")).alias("rep"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("first").alias("first"), F.first("words").alias("words"), F.min("fp").alias("fp"))
    posted = sets.select("id", "size", F.posexplode("first").alias("place", "key")).select("key", "id", (F.shiftleft("size", 32) + F.col("place")).alias("at"))
    reps, found = checkpoint(sets.select("id", "rep", "size", "sig", "words", "fp")), found.select("doc_id", "tk", "id")
    linked = _verified(checkpoint(_fingerprint_links(reps, max_bits).distinct()), reps, given, width)
    once = checkpoint(_candidates(posted))
    short = once.where(F.col("at") == PAIR).select("u", "v").distinct()
    star = stars(linked.union(_verified(short, reps, given, width)))  # one search for components serves both
    long = once.where(F.col("at") != PAIR).select(F.col("u").alias("key"), F.col("v").alias("id"), "at")
    for pairs in (_forest, _pairs):
        parts = star.select(F.col("u").alias("id"), F.col("v").alias("part"))
        rest = long.join(parts, "id", "left").join(reps.select("id", "words"), "id").withColumn("part", F.coalesce("part", "id"))
        star = stars(star.union(_verified(checkpoint(_candidates(rest, pairs).select("u", "v").distinct()), reps, given, width)))
    rooted = found.groupBy("id").agg(F.min("doc_id").alias("first_id")).join(star.select(F.col("u").alias("id"), F.col("v").alias("up")), "id", "left")
    rooted = rooted.select("id", "first_id", F.coalesce("up", "id").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("id", F.col("root").alias("component"), "component_id")
    return found.join(named, "id").select(F.col("doc_id").alias(id_col), F.col("tk").alias("text_key"), "component", "component_id")
