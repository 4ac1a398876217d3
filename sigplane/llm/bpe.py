"""Byte-level BPE with a rank queue of hierarchical bitmaps.

All pre-tokens of a batch lie in one doubly linked list of tokens, with breaks that never merge.  For
each merge rank a bucket holds the list positions whose pair has that rank, and a three-level bitmap
marks the buckets that hold something, so the next rank is found with three find-first-set steps however
long the text.  A position whose pair has changed since it was queued is stale and skipped.  Every
merge is constant work, so a pre-token of n bytes costs O(n log n) at worst, for the sorting of buckets.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigplane.llm.chunks import UnitCache

RANKS = "byte_bpe_multi_50k.tiktoken"


class RankQueue:
    """Buckets of positions by rank; the least non-empty rank by find-first-set on three levels."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int] | None] = [None] * ranks
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            self.buckets[rank] = [position]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank and its positions, in order; its bucket is then empty."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = (a << 6) + (word & -word).bit_length() - 1
        word = self.low[b]
        rank = (b << 6) + (word & -word).bit_length() - 1
        bucket, self.buckets[rank] = self.buckets[rank], None
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        bucket.sort()
        return rank, bucket


class Encoder:
    """Encoding and decoding by a table of ranks; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        # The rank of a pair of ids is that of their joined bytes.
        self.pair: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pair[left * self.size + right] = rank

    @classmethod
    def from_file(cls, path: str) -> Encoder:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def encode_many(self, pretokens: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token: always the pair of least rank first, the leftmost of equals."""
        size, pair, byte_id = self.size, self.pair, self.byte_id
        token: list[int] = []
        begins = []
        for p in pretokens:
            begins.append(len(token))
            token += [byte_id[b] for b in p]
            token.append(-1)  # a break: no pair with it has a rank
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [-1] * n  # the rank of the pair that begins at a position, -1: none
        queue = RankQueue(size)
        push, get = queue.push, pair.get
        for i in range(n - 1):
            if token[i] >= 0 <= token[i + 1]:
                r = get(token[i] * size + token[i + 1], -1)
                if r >= 0:
                    now[i] = r
                    push(r, i)
        while (found := queue.pop()) is not None:
            rank, bucket = found
            for k, i in enumerate(bucket):
                if now[i] != rank:
                    continue  # stale
                j = after[i]
                token[i], now[j] = rank, -1
                follows = after[i] = after[j]
                before[follows] = i
                lower = False
                right = token[follows]
                r = now[i] = get(rank * size + right, -1) if right >= 0 else -1
                if r >= 0:
                    push(r, i)
                    lower = r < rank
                h = before[i]
                if h >= 0 and token[h] >= 0:
                    r = now[h] = get(token[h] * size + rank, -1)
                    if r >= 0:
                        push(r, h)
                        lower = lower or r < rank
                if lower:  # a pair of lower rank goes before the rest of this bucket
                    for x in bucket[k + 1 :]:
                        push(rank, x)
                    break
        out = []
        for i in begins:
            ids = []
            while token[i] >= 0:
                ids.append(token[i])
                i = after[i]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; those of a text's ids are its UTF-8."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _joined(parts: list) -> list[int]:
    out: list[int] = []
    for p in parts:
        out += p
    return out


@lru_cache(maxsize=1)
def _tools(path: str) -> tuple[Encoder, UnitCache]:
    encoder = Encoder.from_file(path)
    return encoder, UnitCache(lambda pretokens: [tuple(x) for x in encoder.encode_many([p.encode("utf-8", "surrogatepass") for p in pretokens])], _joined)


def encode_texts(texts: list[str], path: str) -> list[list[int]]:
    """Ids of each text; each match of the pattern is encoded separately, without special tokens."""
    return _tools(path)[1].texts(texts)


def encode(docs: DataFrame, *, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each row.

    A null or empty text has no ids.  Rows that repeat are encoded each.  A null doc_id is kept.  An
    empty table gives no rows.  Other columns of ``docs`` are ignored, whatever their names.
    """
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), 1024):
                batch = whole.slice(low, 1024)
                ids = encode_texts([t or "" for t in batch["text"].to_pylist()], path)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def digest(docs: DataFrame, *, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, in the same pass as the encoding."""
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tools(path)[0]
        names = [str(i) for i in range(encoder.size)]
        for whole in batches:
            for low in range(0, len(whole), 1024):
                batch = whole.slice(low, 1024)
                counts, encoded, decoded = [], [], []
                for ids in encode_texts([t or "" for t in batch["text"].to_pylist()], path):
                    counts.append(len(ids))
                    encoded.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding of every document by the multilingual ranks, decoded again."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
