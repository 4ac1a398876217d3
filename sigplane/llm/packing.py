"""Packing of documents into fixed sequences: concatenate and cut.

Pass one tokenizes each document once and writes (partition, offset in the partition, ids).  The
partition totals, one number per task, are summed into prefix sums, which give every document a global
offset without moving a row.  Pass two cuts at the fixed windows with built-in functions: a document
that crosses a window's end leaves one boundary record per window.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigplane.llm import storage
from sigplane.llm.chunks import is_plain

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
SEQUENCE = 1024
_WIDTH = 4  # bytes of an id, little-endian unsigned
#: Bytes of text told apart at a time, and given to the library at a time: both bound memory only.
SLICE, BLOCK = 4 << 20, 1 << 18


#: All but letters, digits and signs that have had their class since Unicode 4.
_RARE = re.compile("[^\n\x20-\x7e\u00a1-\u00ac\u00ae-\u0220\u0400-\u045f\u05d0-\u05ea\u0621-\u063a\u0905-\u0939\u0e01-\u0e30\u2010-\u2027\u2030-\u203a\u3001-\u3003\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones themselves, the others counted from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """Ids of many texts at once: each different word of a slice is encoded once, all else is array work.

    A single space between two other characters always starts a new match of the pre-tokenizer's pattern,
    so the words of a text can be encoded apart.  The different words of a slice are joined and encoded in
    blocks; as each word begins a token, the tokens' lengths in bytes tell where its ids begin.  Texts in
    which white space meets white space, with an added token, or with characters whose class may follow the
    Unicode version, are encoded whole by the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token)  # a character stands for a byte
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.quick = self._quick(path)

    def _quick(self, path: str):
        """The same encoding by ranks instead of merges, or None if it could differ.

        Merges by rank of the joined token equal merges by pair if each merge makes a new token of the next
        higher id and each token's own bytes are encoded as that token: then the last pair before a token is
        the same whatever surrounds it.
        """
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
        made = [model["vocab"].get(a + b, -1) for a, b in merges]
        plain = [t for t in model["vocab"] if all(c in alphabet for c in t)]
        own = [t for t in plain if len(t) > 1]
        odd = model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if odd or len(plain) - len(own) != 256 or sorted(set(made)) != made or {model["vocab"][t] for t in own} != set(made):
            return None
        if any(len(x) != 1 or x[0].value != t for t in own if (x := self.whole.model.tokenize(t)) is not None):
            return None
        return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes(alphabet[c] for c in t): model["vocab"][t] for t in plain}, special_tokens={})

    def _ids(self, text: str, quick: bool = False) -> np.ndarray:
        if quick and self.quick:
            return self.quick.encode_to_numpy(text)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _units(self, units: list[str], space: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of the units, each behind a space, and where each unit's ids begin and end; None if a boundary isn't one."""
        sizes = np.array([len(u.encode()) for u in units], np.int64) + 1
        ends = np.cumsum(sizes)
        found, low, before = [np.empty(0, np.uint32)], 0, 0
        while low < len(units):
            high = max(low + 1, int(np.searchsorted(ends, before + BLOCK)))
            found.append(self._ids(space + space.join(units[low:high]), quick=True))
            low, before = high, int(ends[high - 1])
        ids = np.concatenate(found)
        bytes_to = np.cumsum(self.size[ids])
        at = np.searchsorted(bytes_to, ends)
        if len(ends) and not (at[-1] == len(ids) - 1 and np.array_equal(bytes_to[at], ends)):
            return None
        return ids, np.concatenate([[0], at + 1]).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        apart = [is_plain(t) and t[:1] not in ("", " ", "\n") and not _RARE.search(t) and not (self.added and self.added.search(t)) for t in texts]
        got = self._apart([t for t, ok in zip(texts, apart, strict=True) if ok])
        if got is None or not all(apart):
            others = iter(np.split(got[0], np.cumsum(got[1])[:-1])) if got is not None else None
            each = [next(others) if ok and others is not None else self._ids(t) for t, ok in zip(texts, apart, strict=True)]
            return np.concatenate([*each, np.empty(0, np.uint32)]), np.array([len(x) for x in each], np.int64)
        return got

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        heads = [t.split(" ", 1)[0] for t in texts]
        tails = pa.array([t[len(h) + 1 :] if len(t) > len(h) else None for t, h in zip(texts, heads, strict=True)], pa.large_string())
        split = pc.split_pattern(tails, " ")
        coded = pc.list_flatten(split).dictionary_encode()
        first, rest = self._units(heads, "\n"), self._units(coded.dictionary.to_pylist(), " ")
        if first is None or rest is None:
            return None
        # A head's line feed is its first id, which is left out.
        head_begin, head_n = first[1][:-1] + 1, np.diff(first[1]) - 1
        codes, n_units = coded.indices.to_numpy(), pc.list_value_length(split).fill_null(0).to_numpy()
        begin, n = rest[1][:-1], np.diff(rest[1])
        at = np.cumsum(n_units) - n_units  # each head goes before its text's units
        begins = np.insert(begin[codes] + len(first[0]), at, head_begin)
        lengths = np.insert(n[codes], at, head_n)
        counts = np.add.reduceat(lengths, np.arange(len(at)) + at) if len(at) else np.empty(0, np.int64)
        # The place of each id: a unit's begin, then one further each.
        to = np.cumsum(lengths)
        place = np.ones(int(to[-1]) if len(to) else 0, np.int64)
        some = np.flatnonzero(lengths)
        jumps = begins[some]
        jumps[1:] -= begins[some[:-1]] + lengths[some[:-1]] - 1
        place[to[some] - lengths[some]] = jumps
        return np.concatenate([first[0], rest[0]])[np.cumsum(place)], counts.astype(np.int64)


@lru_cache(maxsize=1)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers; none are put around a text."""
    ids, counts = _tokens(path).encode(texts)
    ends = np.cumsum(counts)
    return [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of rows with at most SLICE bytes, or of a single row."""
    ends, low, before = np.cumsum(sizes), 0, 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield low, high - low
        low, before = high, int(ends[high - 1])


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(part, local_start, doc_id, doc_tokens, ids) of each row; ``part`` is the task that made it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for whole in batches:
            for low, n in _slices(pc.binary_length(whole["text"]).fill_null(0).to_numpy()):
                batch = whole.slice(low, n)
                ids, counts = _tokens(path).encode([t or "" for t in batch["text"].to_pylist()])
                ids, counts = np.insert(ids, np.cumsum(counts), end_id).astype("<u4"), counts + 1
                ends = np.cumsum(counts)
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate([[0], ends * _WIDTH]).astype(np.int64)), pa.py_buffer(ids)])
                starts, parts = at + ends - counts, pa.array(np.full(n, part, "int32"))
                at += int(ends[-1])
                yield pa.RecordBatch.from_arrays([parts, pa.array(starts), batch["doc_id"], pa.array(counts), column.cast(pa.binary())], ["part", "local_start", "doc_id", "doc_tokens", "ids"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"part int, local_start long, doc_id {id_type}, doc_tokens long, ids binary")


def pack(docs: DataFrame, *, tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of full sequences.

    Every id of every document, the end id included, lies in exactly one piece; only the last sequence
    may be short.  A null or empty text is its end id alone.  Repeated rows and equal ids of rows are
    packed as often as they occur.  A null doc_id is kept.  An empty table gives no pieces.  Other
    columns of ``docs`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    tokens = storage.written(tokenized(docs, path, id_col, text_col, end_id), "tokens")
    # One row per task of the first pass, not per document: a few MB at a hundred thousand tasks.
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total")).orderBy("part").collect()
    before = [0, *accumulate(r["total"] for r in totals)]
    offsets = spark.createDataFrame([(r["part"], b) for r, b in zip(totals, before, strict=False)], "part int, part_start long")
    placed = tokens.join(F.broadcast(offsets), "part").withColumn("first", F.col("part_start") + F.col("local_start"))
    size = F.lit(sequence)
    window = F.explode(F.expr(f"sequence(first div {sequence}, (first + doc_tokens - 1) div {sequence})"))
    cut = placed.select("doc_id", "doc_tokens", "first", "ids", window.alias("sequence_id"))
    begin = F.greatest(F.col("sequence_id") * size - F.col("first"), F.lit(0))
    end = F.least((F.col("sequence_id") + 1) * size - F.col("first"), F.col("doc_tokens"))
    return cut.select(
        "doc_id",
        begin.alias("start"),
        (end - begin).alias("length"),
        F.substring("ids", (begin * _WIDTH + 1).cast("int"), ((end - begin) * _WIDTH).cast("int")).alias("ids"),
        "doc_tokens",
        "sequence_id",
        (F.col("first") + begin - F.col("sequence_id") * size).alias("offset"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids, with the crc32 of each piece's ids."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
