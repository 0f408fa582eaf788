"""Byte-level BPE encoding and decoding by DuckDB recursive queries in each partition.

Every match of the split pattern is one word. A partition collects the distinct words it has not
met yet; a recursive query over token-position rows joins neighbouring tokens to the merge
table and contracts each word's leftmost pair of the least rank, until no word has a pair left.
Decoding is an ordered aggregation of the tokens' bytes by position. Documents are then put
together from their words' ids and bytes.

A recursion keeps the rows of all its rounds, so words are dealt to queries by the rows that they
may make, and ``QUERY_ROWS`` bounds a query's memory whatever the words. A word of L bytes may make
L * L / 2 rows; words longer than ``LONG`` bytes, of which none would fit, are contracted by the
same rule with a heap and decoded by the same aggregation.

Defined results: a null or empty text has no ids and no bytes. Repeated rows are all returned.
Special tokens are never made; their text is ordinary text. Columns besides id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bound_batches

#: Rows that one recursive query may make over all its rounds, at most; with about 40 bytes a row, a third of the memory limit.
QUERY_ROWS = 2_500_000
#: Bytes of the longest word that the recursive query contracts; the rows of a longer one do not fit.
LONG = 2048
#: Distinct words that a worker keeps; beyond it, those met once or twice are forgotten.
KEEP_WORDS = 400_000
#: Characters of a text whose words are held at once.
HOLD = 1 << 20

#: A row is a token with its successor: word, place, place and id of the next token. A pair's key packs rank, place and the next token's place, so that the least key is the leftmost pair of the least rank. The pair's second row becomes the merged token, which leaves the successor as it is.
CONTRACT = """
WITH RECURSIVE whole AS MATERIALIZED (
  SELECT words.w, vocabulary.id FROM words JOIN vocabulary ON words.piece = vocabulary.piece
), t(round, w, g, n, id, nid) AS (
  SELECT 0, w, g, n, id, nid FROM start ANTI JOIN whole USING (w)
  UNION ALL
  SELECT t.round + 1, t.w,
    CASE WHEN t.g = (b.best & 4194303) THEN (b.best >> 22) & 4194303 ELSE t.g END,
    t.n,
    CASE WHEN t.g = (b.best & 4194303) THEN (b.best >> 44)::INTEGER ELSE t.id END,
    CASE WHEN t.n = ((b.best >> 22) & 4194303) THEN (b.best >> 44)::INTEGER ELSE t.nid END
  FROM t JOIN (
    SELECT x.w AS w, min((m.id::BIGINT << 44) | (x.g << 22) | x.n) AS best
    FROM t AS x JOIN merges AS m ON m.pair = ((x.id::BIGINT << 32) | x.nid)
    GROUP BY x.w
  ) AS b ON t.w = b.w
  WHERE t.g <> ((b.best >> 22) & 4194303)
), last AS (
  SELECT t.w, t.g, t.id FROM t JOIN (SELECT w, max(round) AS round FROM t GROUP BY w) AS r ON t.w = r.w AND t.round = r.round
  UNION ALL
  SELECT w, 0, id FROM whole
)
SELECT w, g, id FROM last ORDER BY w, g
"""
#: The bytes of each word's tokens, by place.
DECODE = """
SELECT tokens.w AS w, string_agg(vocabulary.digits, '' ORDER BY tokens.g) AS decoded
FROM tokens JOIN vocabulary ON tokens.id = vocabulary.id GROUP BY tokens.w ORDER BY tokens.w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes and decodes words by DuckDB and keeps what it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [((ranks[token[:i]] << 32) | ranks[token[i:]], rank) for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self._table("merges", {"pair": [p for p, _ in pairs], "id": pa.array([r for _, r in pairs], pa.int32())})
        self._table("vocabulary", {"piece": pa.array(list(ranks), pa.binary()), "id": pa.array(list(ranks.values()), pa.int32()), "digits": [t.hex() for t in ranks]})
        self._start()

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _start(self, words: dict[str, int] | None = None) -> None:
        """Keep the given words with their codes and forget the others."""
        old = list((words or {}).values())
        self.ids, self.decoded = ([self.ids[c] for c in old], [self.decoded[c] for c in old]) if old else ([], [])
        self.codes = defaultdict(count(len(old)).__next__, zip(words or (), range(len(old))))
        self.uses = np.ones(len(old), dtype=np.int64)

    def words(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, in lists of bounded size."""
        if len(text) <= HOLD:
            yield self.split.findall(text)
            return
        matches = self.split.finditer(text)
        while some := [m[0] for m in islice(matches, HOLD // 4)]:
            yield some

    def texts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """The ids and the decoded bytes of every text."""
        if len(self.codes) > KEEP_WORDS:  # those met most often stay, so that memory stays bounded
            self._start({w: c for w, c in islice(self.codes.items(), self.uses.size) if self.uses[c] > 2} if (self.uses > 2).sum() <= KEEP_WORDS // 2 else None)
        try:
            coded = [np.concatenate([np.zeros(0, np.int32), *(np.fromiter(map(self.codes.__getitem__, own), np.int32, len(own)) for own in self.words(text))]) for text in texts]
            self._learn()
        except BaseException:
            self._start()
            raise
        uses = np.bincount(np.concatenate(coded), minlength=len(self.codes)) if coded else np.zeros(len(self.codes), np.int64)
        uses[: self.uses.size] += self.uses
        self.uses = uses
        ids, decoded = self.ids, self.decoded
        for codes in coded:
            own = codes.tolist()
            yield (np.frombuffer(b"".join([ids[c] for c in own]), dtype="<u4"), b"".join([decoded[c] for c in own]))

    def _learn(self) -> None:
        """Ids and bytes for the words that are new; each is contracted once."""
        met = len(self.ids)
        words = [w.encode() for w in islice(self.codes, met, None)]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(lengths, kind="stable")
        short = int((lengths <= LONG).sum())
        rows = np.cumsum(lengths[order] * (lengths[order] + 1) // 2 + 1)
        self.ids += [b""] * len(words)
        self.decoded += [b""] * len(words)
        at = 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(rows[:short], (rows[at - 1] if at else 0) + QUERY_ROWS, side="right"))) if at < short else at + 1
            own = [words[i] for i in order[at:to].tolist()]
            for i, ids, decoded in zip(order[at:to].tolist(), *self._decoded(self._contract(own) if at < short else self._heap(own[0])), strict=True):
                self.ids[met + i], self.decoded[met + i] = ids, decoded
            at = to

    def _contract(self, words: list[bytes]) -> pa.Table:
        """The tokens (w, g, id) of each word, in order."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        g = np.arange(flat.size, dtype=np.int64) + w  # a word's end is no other word's start
        ids = self.byte_rank[flat]
        following = np.concatenate((ids[1:], [-1])).astype(np.int64)
        following[np.cumsum(lengths) - 1] = 1 << 30  # no token: a word's last has no pair
        self.db.register("start", pa.table({"w": w, "g": g, "n": g + 1, "id": ids, "nid": following.astype(np.int32)}))
        self.db.register("words", pa.table({"w": np.arange(len(words), dtype=np.int32), "piece": pa.array(words, pa.binary())}))
        try:
            return self.db.sql(CONTRACT).to_arrow_table()
        finally:
            self.db.unregister("start")
            self.db.unregister("words")

    def _decoded(self, tokens: pa.Table) -> tuple[list[bytes], list[bytes]]:
        """The ids and the bytes of each word."""
        self.db.register("tokens", tokens)
        try:
            out = self.db.sql(DECODE).to_arrow_table().combine_chunks()
        finally:
            self.db.unregister("tokens")
        packed = tokens.column("id").to_numpy().astype("<u4").tobytes()
        cuts = np.concatenate(([0], np.cumsum(np.bincount(tokens.column("w").to_numpy(), minlength=out.num_rows)) * 4)).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])], [bytes.fromhex(x) for x in out.column("decoded").to_pylist()]

    def _heap(self, word: bytes) -> pa.Table:
        """The same contraction for a long word: neighbours linked both ways, pairs in a heap by rank and place."""
        if word in self.ranks:
            return pa.table({"w": [0], "g": [0], "id": [self.ranks[word]]})
        size = len(word)
        ends, before, alive = list(range(1, size + 1)), list(range(-1, size - 1)), [True] * size
        heap = [(self.ranks[word[i : i + 2]], i, i + 2) for i in range(size - 1) if word[i : i + 2] in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = ends[i]
            if not alive[i] or j >= size or ends[j] != to:
                continue
            alive[j], ends[i] = False, to
            if to < size:
                before[to] = i
                if (r := self.ranks.get(word[i : ends[to]])) is not None:
                    heapq.heappush(heap, (r, i, ends[to]))
            if (p := before[i]) >= 0 and (r := self.ranks.get(word[p:to])) is not None:
                heapq.heappush(heap, (r, p, to))
        starts = [i for i in range(size) if alive[i]]
        return pa.table({"w": np.zeros(len(starts), np.int32), "g": starts, "id": pa.array([self.ranks[word[i : ends[i]]] for i in starts], pa.int32())})


_kept: dict[tuple[int, str], Encoder] = {}


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row; ``with_ids`` adds ids and decoded text."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        key = (ranks_path, pattern)
        if key not in _kept:
            _kept.clear()
            _kept[key] = Encoder(ranks, pattern)
        encoder = _kept[key]
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            counts, sums, backs, lists, bytes_back = [], [], [], [], []
            for ids, decoded in encoder.texts(texts):
                counts.append(ids.size)
                sums.append(hashlib.sha256(ids).hexdigest())
                backs.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    lists.append(ids.astype(np.int32))
                    bytes_back.append(decoded)
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(backs, pa.string())]
            if with_ids:
                columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(bytes_back, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if with_ids else 4]
    return given.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
