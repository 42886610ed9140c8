"""The finite-state first half of a word BPE tokenizer, over many texts at once.

Reads what the second half needs from a tokenizer's JSON file, normalises texts and
cuts them into pre-tokens: contractions, runs of letters, single digits, runs of
other characters. White space separates and is dropped. Character classes come from
a table over code points, and all cuts of a slice of texts are made in numpy.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The tokenizer's own normal form and split pattern, which this module states as numpy.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    first = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    table = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[[*range(0x09, 0x0E), 0x85]] = SPACE
    return table


@lru_cache(1)
def byte_chars() -> dict[str, int]:
    """Byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 stands for itself, the other bytes in turn for what follows U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def read_model(path: str) -> tuple[dict, list, dict[str, int]]:
    """Vocabulary, merges and special strings with ids. Raises for another kind of tokenizer."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    steps = [n["type"] for n in j["normalizer"]["normalizers"]]
    pattern = j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    if steps != NORMALIZERS or pattern != PATTERN or j["model"]["end_of_word_suffix"] != WORD_END:
        raise ValueError(f"{path} is not a lower-case word BPE with word ends")
    return j["model"]["vocab"], j["model"]["merges"], {t["content"]: t["id"] for t in j["added_tokens"]}


def normal(text: str) -> str:
    """NFC and lower case, character by character. White space is left for the cut."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # the final form of sigma depends on what follows
    return text.lower()


class Cut:
    """Pre-tokens of a list of texts.

    ``raw`` holds the bytes of all pre-tokens and ``last`` marks the last byte of
    each. ``bounds[d]:bounds[d + 1]`` are the bytes of text ``d``; ``special[d]`` is
    the list of special strings in it, as pairs of byte position and number.
    """

    def __init__(self, texts: list[str], specials: list[str]):
        parts, owner, self.special = [], [], [[] for _ in texts]
        splitter = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        marks = []
        for d, text in enumerate(texts):
            pieces = splitter.split(text) if splitter and any(s in text for s in specials) else [text]
            for k, piece in enumerate(pieces):
                if k % 2:
                    marks.append((d, len(parts), specials.index(piece)))
                else:
                    parts.append(normal(piece))
                    owner.append(d)
        joined = "".join(parts)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(code)
        edges = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=edges[1:])
        edge = np.zeros(n + 3, bool)
        edge[edges] = True
        kind = np.zeros(n + 3, np.uint8)
        kind[:n] = classes()[code]
        starts = np.zeros(n + 3, bool)
        starts[1:n] = kind[1:n] != kind[: n - 1] if n else False
        starts |= edge
        starts[:n] |= kind[:n] == NUMBER
        starts[:n] &= kind[:n] != SPACE
        quotes = np.flatnonzero((code == 39) & starts[:n])
        if len(quotes):
            padded = np.zeros(n + 3, np.uint32)
            padded[:n] = code
            one, two = padded[quotes + 1], padded[quotes + 2]
            joins = ~edge[quotes + 1]
            short = joins & np.isin(one, [ord(c) for c in "stmd"])
            pair = (one.astype(np.uint64) << np.uint64(32)) | two
            long = joins & ~edge[quotes + 2] & np.isin(pair, np.array([(ord(a) << 32) | ord(b) for a, b in ("re", "ve", "ll")], np.uint64))
            starts[quotes[short | long] + 1] = False
            for after in (quotes[short] + 2, quotes[long] + 3):
                starts[after] |= kind[after] == LETTER
        ends = (kind[:n] != SPACE) & (starts[1 : n + 1] | (kind[1 : n + 1] == SPACE) | edge[1 : n + 1])
        raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
        solid = kind[:n] != SPACE
        if len(raw) == n:
            keep, last, bounds = solid, ends, edges
        else:
            size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            at = np.zeros(n + 1, np.int64)
            np.cumsum(size, out=at[1:])
            keep = np.repeat(solid, size)
            last = np.zeros(len(raw), bool)
            last[at[1:][ends] - 1] = True
            bounds = at[edges]
        self.raw, self.last = raw[keep], last[keep]
        kept = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        of_part = kept[bounds]
        first = np.searchsorted(np.asarray(owner, np.int64), np.arange(len(texts) + 1))
        self.bounds = of_part[first]
        for d, part, number in marks:
            self.special[d].append((int(of_part[part]), number))
