"""URL filtering: host and path rules, then exact membership by a cascade of Bloom filters.

The first filter of a cascade holds the listed keys. Tested with every key of the
corpus it also passes some that are not listed; the second filter holds those, the
third holds listed keys that the second passes, and so on until nothing passes
wrongly. Since all keys of the corpus went through the building, the answer for
each of them is exact. A cascade is a few bitmaps that travel inside the query's
expression: judging a page needs neither a join nor a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for NULL or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def first_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or NULLs."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    words: list[int]


@dataclass(frozen=True)
class Cascade:
    levels: list[Level]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        answer = F.lit(False)
        for level in reversed(self.levels):
            answer = passes(level, key) & ~answer
        return answer


HASHES = 5
BITS_PER_KEY = 8


def _positions(level: int, bits: int, key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(j), key), F.lit(bits)) for j in range(HASHES)]


def passes(level: Level, key: Column) -> Column:
    """Whether all of the key's bits are set. The bitmap is one constant of the plan."""
    bitmap = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    out = F.lit(True)
    for p in _positions(level.number, level.bits, key):
        out = out & (F.getbit(F.get(bitmap, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
    return out


def _build(keys: DataFrame, number: int, n: int) -> Level:
    words = max(1, -(-n * BITS_PER_KEY // 64))
    bits = words * 64
    at = keys.select(F.explode(F.array(*_positions(number, bits, F.col("key")))).alias("p"))
    set_bits = F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))"))
    rows = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(set_bits.alias("b")).collect()  # at most ``words`` rows
    bitmap = [0] * words
    for w, b in rows:
        bitmap[w] = b
    return Level(number, bits, bitmap)


def build_cascade(universe: DataFrame, max_words: int = 1 << 20) -> Cascade | None:
    """A cascade for ``universe`` (``key`` distinct, ``listed`` boolean), one row per key.

    Every level is an aggregation to its bitmap. Returns None when the bitmaps
    would together pass ``max_words`` words of 8 bytes; then the caller looks keys
    up by a join.
    """
    inside, outside = universe.where("listed"), universe.where("not listed")
    levels: list[Level] = []
    held, other, spent = inside, outside, 0
    while n := held.count():
        spent += n * BITS_PER_KEY // 64 + 1
        if spent > max_words:
            return None
        level = _build(held, len(levels) + 1, n)
        levels.append(level)
        held, other = other.where(passes(level, F.col("key"))), held
    return Cascade(levels)


def judge_urls(pages: DataFrame, rules: list[Rule], listed: Column, max_words: int = 1 << 20) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for every row of ``pages``.

    ``listed`` is a condition on a page; a key (host and path) is listed if any of
    its pages meets it, and listed keys are blocked where no rule fits. A NULL
    condition does not list. URLs that are NULL or without ``://`` share the empty
    key. Repeated rows are judged alike; other columns are only read by ``listed``.
    """
    host, path = host_and_path(F.col("url"))
    keyed = pages.select("page_id", host.alias("host"), path.alias("path"), F.coalesce(listed, F.lit(False)).alias("_l"))
    key = F.concat("host", "path")
    universe = stored(keyed.groupBy(key.alias("key")).agg(F.max("_l").alias("listed")), "url-keys")
    cascade = build_cascade(universe, max_words)
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    if cascade is None:
        looked = named.withColumn("key", key).join(universe, "key").drop("key")
    else:
        looked = named.withColumn("listed", cascade.contains(key))
    text, verdict = first_rule(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return looked.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), "listed")
