"""Order-MinHash signatures against a plain computation, and the likeness of the query's rows."""

from __future__ import annotations

import random
import re
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sigplane.llm import fingerprint

MASK = (1 << 64) - 1


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _longs(*values):
    """The engine's 64-bit hash of several longs: each value's hash is the next one's seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return _signed(seed)


def _ints_last(long, number):
    """The hash of a long and a 32-bit number."""
    return _signed(xxhash.xxh64_intdigest(struct.pack("<i", number), _longs(long) & MASK))


def _plain(text, k=fingerprint.K, entries=fingerprint.ENTRIES):
    words = [_signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not words:
        return []
    kmers = [_longs(*words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [_longs(*words)]
    seen: dict[int, int] = {}
    numbered = []
    for place, kmer in enumerate(kmers):
        seen[kmer] = seen.get(kmer, 0) + 1
        numbered.append((_ints_last(kmer, seen[kmer]) & ~fingerprint._PLACE, place))
    constants = fingerprint._constants(entries * fingerprint.PER_TUPLE)
    out = []
    for e in range(entries):
        picked = []
        for c in constants[e * fingerprint.PER_TUPLE : (e + 1) * fingerprint.PER_TUPLE]:
            least = min((x ^ c) | place for x, place in numbered)
            picked.append((least & fingerprint._PLACE, (least ^ c) & ~fingerprint._PLACE))
        first, second = picked
        if first[0] > second[0]:
            first, second = second, first
        out.append(_longs(first[1], second[1]))
    return out


def test_signatures_equal_a_plain_computation(spark):
    r = random.Random(11)
    texts = [" ".join(f"w{r.randrange(12)}" for _ in range(r.randrange(0, 40))) for _ in range(30)] + ["", "one", "one two", "a a a a a a", "é\tü  ß\nx"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {x["k"]: x["signature"] for x in fingerprint.signatures(df, ["k"]).collect()}
    assert got == {i: _plain(t) for i, t in enumerate(texts)}


def test_likeness_of_the_query(spark):
    r = random.Random(12)
    docs = [(i, " ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(1, 60)))) for i in range(20)] + [(40, None), (41, "")]
    rows = {x["doc_id"]: x for x in fingerprint.fingerprint(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    order = sorted((i for i, _ in docs), reverse=True)
    text = {i: t or "" for i, t in docs}
    hexed = lambda s: "".join(f"{x & MASK:016X}" for x in s)

    def like(a, b):
        if not a and not b:
            return 1.0
        return sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b)) if a and b else 0.0

    for i, after in zip(order, order[1:] + order[:1], strict=True):
        n = len(text[i])
        edited = text[i][: n - n // 2] + text[after][: n // 2]
        mine, other, following = _plain(text[i]), _plain(edited), _plain(text[after])
        assert rows[i]["fingerprint"] == hexed(mine) and rows[i]["edited_fingerprint"] == hexed(other)
        assert np.isclose(rows[i]["near_edited"], like(mine, other)) and np.isclose(rows[i]["near_next"], like(mine, following))


def test_repeated_ids_are_ordered_by_their_text(spark):
    docs = spark.createDataFrame([(1, "b b b b"), (1, "a a a a"), (2, "c c c c")], "doc_id long, text string")
    found = fingerprint.fingerprint(docs).select("doc_id", F.col("n_chars"), "edited_sha256").collect()
    assert sorted(x["doc_id"] for x in found) == [1, 1, 2] and len({x["edited_sha256"] for x in found}) == 3
