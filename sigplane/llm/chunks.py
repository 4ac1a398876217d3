"""Cut a text into pieces that the public pre-tokenizer pattern treats independently.

The pattern attaches one space to what follows it, so a single space between two non-spaces always
starts a new match.  Cutting there turns a text into words that repeat, and what is computed for a
word can be kept and joined.  Where white space meets white space the pattern looks further, so such
a text is cut by the pattern itself.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex


@lru_cache(maxsize=1)
def newer_letters() -> frozenset[str]:
    """Characters that one library counts as letters or digits and the tokenizer's, of another Unicode version, doesn't.

    Only characters that Python's own tables don't know yet can differ.  Behind an "a" or a "1" such a character
    belongs to the same match or not; byte pairs that only merge within a match tell which.
    """
    import tiktoken

    unknown = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    found = []
    for kind, before in (("L", "a"), ("N", "1")):
        ranks = {bytes([b]): b for b in range(256)} | {before.encode() + bytes([b]): 256 + b for b in range(0xC2, 0xF5)}
        probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        found += [c for c in regex.findall(rf"\p{{{kind}}}", unknown) if len(probe.encode_ordinary(before + c)) > len(c.encode())]
    return frozenset(found)


def _ranges(chars: Iterable[str]) -> str:
    """The characters as ranges of a class."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in out)


PATTERN = regex.compile(public_tokenizers.PATTERN)


@lru_cache(maxsize=1)
def _newer() -> tuple[re.Pattern[str] | None, regex.Pattern]:
    """A search for newer letters, and the public pattern with the classes of the tokenizer's own Unicode version."""
    ranges = _ranges(newer_letters())
    if not ranges:
        return None, PATTERN
    own = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}][{ranges}]]")
    own = own.replace(r" ?\p{L}+", rf" ?[\p{{L}}--[{ranges}]]+").replace(r" ?\p{N}+", rf" ?[\p{{N}}--[{ranges}]]+")
    return re.compile(f"[{ranges}]"), regex.compile(own, regex.V1)


@lru_cache(maxsize=1)
def _beyond() -> re.Pattern[str]:
    """A quick search for characters from the first newer letter on."""
    return re.compile(f"[^\\x00-\\U{ord(min(newer_letters(), default=chr(0x10FFFF))) - 1:08x}]")


def has_newer(text: str) -> bool:
    """Whether the plain pattern could cut the text otherwise than the tokenizer."""
    if text.isascii():
        return False
    newer, beyond = _newer()[0], _beyond()
    return bool(newer and beyond.search(text) and newer.search(text))


#: White space other than the space and the line feed; texts with any of it take the pattern.
_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_ENDS = frozenset(".,;:!?")


def matches(text: str) -> list[str]:
    """All matches of the pattern, in order; joined they give the text."""
    if text.isascii() and text[:1] == " " and text[1:].isalpha():
        return [text]
    return (_newer()[1] if has_newer(text) else PATTERN).findall(text)


def is_plain(text: str) -> bool:
    """Whether each single space of the text begins a match, so that it can be cut there."""
    return not ("  " in text or " \n" in text or "\n " in text or _RARE_SPACE.search(text))


def unit_matches(unit: str) -> list[str]:
    """Matches of a space and the unit, which holds no newer letter; plain words skip the regular expression."""
    if unit.isalpha():
        return [" " + unit]
    if unit and unit[-1] in _ENDS and unit[:-1].isalpha():
        return [" " + unit[:-1], unit[-1]]
    return PATTERN.findall(" " + unit)


class UnitCache:
    """What ``encode`` gives for each pre-token, joined per unit, bounded in entries.

    ``encode(list of pre-tokens) -> list of values`` is asked for the unknown ones of a batch at once;
    ``join(values) -> value`` puts those of a unit or text together.  The units of a batch are told
    apart in Arrow, so what is looked up in Python is one entry per different unit.  Two generations
    of entries are kept: when the younger holds ``limit`` it becomes the older, and what is used again
    moves on.  That changes speed only.
    """

    def __init__(self, encode: Callable[[list[str]], list], join: Callable[[Iterable], object], limit: int = 250_000):
        self.encode, self.join, self.limit = encode, join, limit
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def _values(self, keys: list[str], parted: Callable[[str], list[str]], mark: str) -> list:
        """The joined value of each key; ``mark`` tells apart what is cut differently."""
        young, old, join = self.young, self.old, self.join
        out = [young.get(mark + k) for k in keys] if mark else [young.get(k) for k in keys]
        unknown = {}
        for i, v in enumerate(out):
            if v is None:
                k = mark + keys[i]
                v = old.get(k)
                if v is None:
                    unknown[i] = parted(keys[i])
                else:
                    young[k] = out[i] = v
        if unknown:
            wanted = list(dict.fromkeys(m for ms in unknown.values() for m in ms))
            value = dict(zip(wanted, self.encode(wanted), strict=True))
            for i, ms in unknown.items():
                out[i] = value[ms[0]] if len(ms) == 1 else join([value[m] for m in ms])
                if len(keys[i]) < 64:
                    young[mark + keys[i]] = out[i]
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out

    def texts(self, texts: list[str]) -> list:
        """The joined value of each text."""
        collects = gc.isenabled()
        gc.disable()  # the many small lists of a batch hold no cycles
        try:
            return self._texts(texts)
        finally:
            if collects:
                gc.enable()

    def _texts(self, texts: list[str]) -> list:
        plain = [is_plain(t) and not has_newer(t) for t in texts]
        heads = [t.split(" ", 1)[0] if ok else t for t, ok in zip(texts, plain, strict=True)]
        tails = pa.array([t[len(h) + 1 :] if len(t) > len(h) else None for t, h in zip(texts, heads, strict=True)], pa.large_string())
        units = pc.split_pattern(tails, " ")
        coded = pc.list_flatten(units).dictionary_encode()
        codes, counts = coded.indices.to_numpy(), pc.list_value_length(units).fill_null(0).to_numpy()
        values = self._values(coded.dictionary.to_pylist(), unit_matches, "")
        # A unit that follows a space holds none, so the mark of first words can't clash.
        first = self._values(heads, matches, " ")
        out, at = [], 0
        for head, n in zip(first, counts.tolist(), strict=True):
            out.append(self.join([head, *map(values.__getitem__, codes[at : at + n].tolist())]))
            at += n
        return out
