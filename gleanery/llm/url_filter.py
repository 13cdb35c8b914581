"""URL rules by a Bloom filter cascade, in DataFrame operations only.

Every URL yields its candidate keys: each suffix of its host that has as many labels as some rule's host, with each prefix
of its path that has the length of some rule's path. The distinct candidates of the whole corpus are the key universe. A
first Bloom filter encodes the listed keys; a second one the universe's keys that pass the first without being listed; a
third one the listed keys that pass the second; and so on until none is left. Membership of any key of the universe is then
exact: the first level that rejects it decides. The filters are bit words in literals of the query, so judging needs neither
join nor shuffle. Their size grows with the rules and the false positives of the level before, ``bits_per_key`` each, not with the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame) -> DataFrame:
    """page_id, host, path: null urls and urls without ``://`` have both empty."""
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("__u"))
    df = df.withColumn("__r", F.expr("if(instr(__u, '://') > 0, substring(__u, instr(__u, '://') + 3), '')"))
    host = F.translate(F.regexp_extract("__r", "^[^/?#]*", 0), UPPER, LOWER)
    return df.select("page_id", host.alias("host"), F.regexp_extract("__r", "^[^/?#]*([^?#]*)", 1).alias("path"))


def candidates(rules: list[tuple[str, str, str]]) -> Column:
    """All keys that a rule fitting (host, path) can have."""
    numbers = lambda xs: f"array({', '.join(map(str, xs))})" if xs else "cast(array() as array<int>)"
    labels, sizes = numbers(sorted({h.count(".") + 1 for _, h, _ in rules})), numbers(sorted({len(p) for _, _, p in rules}))
    hosts = f"transform(filter({labels}, n -> n <= length(host) - length(replace(host, '.', '')) + 1), n -> substring_index(host, '.', -n))"
    keys = f"flatten(transform({hosts}, h -> transform(filter({sizes}, n -> n <= length(path)), n -> concat(h, substring(path, 1, n)))))"
    return F.expr(f"if(host = '', cast(array() as array<string>), {keys})")


@dataclass
class Level:
    words: list[int]
    bits: int


def _place(key: str, level: int, j: int, bits: int) -> str:
    return f"pmod(xxhash64({key}, {level}, {j}), {bits}L)"


def bloom(keys: DataFrame, level: int, count: int, bits_per_key: int, hashes: int) -> Level:
    """A Bloom filter of ``keys`` (key): its words are set by a grouped bitwise or, so what comes to the driver is bounded by the bits."""
    bits = max(64, 64 * math.ceil(count * bits_per_key / 64))
    places = F.explode(F.array(*[F.expr(_place("key", level, j, bits)) for j in range(hashes)])).alias("p")
    rows = keys.select(places).groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(p % 64)))").alias("v")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r.w] = r.v
    return Level(words, bits)


@dataclass
class Cascade:
    """Exact membership for keys of the universe it was built over; ``levels`` is empty if nothing is listed."""

    levels: list[Level]
    hashes: int

    def passes(self, key: str, k: int) -> str:
        """SQL text: whether level ``k`` lets a key pass. The words are in it once."""
        x = self.levels[k]
        words = f"array(cast(split('{','.join(map(str, x.words))}', ',') as array<bigint>))"
        each = (f"(get(w, int({p} div 64)) & shiftleft(1L, int({p} % 64))) <> 0" for p in (_place(key, k, j, x.bits) for j in range(self.hashes)))
        return f"exists({words}, w -> {' and '.join(each)})"

    def contains(self, key: str) -> str:
        """SQL text that is true for listed keys of the universe and false for its others."""
        out = "true" if len(self.levels) % 2 else "false"
        for k in reversed(range(len(self.levels))):
            out = f"if({self.passes(key, k)}, {out}, {'true' if k % 2 else 'false'})"
        return out


def build(universe: DataFrame, listed: DataFrame, bits_per_key: int = 12, hashes: int = 4, max_levels: int = 40) -> Cascade:
    """A cascade that tells ``listed`` (key) from the other keys of ``universe`` (key), both distinct. The universe is read
    once, against the first level; only what passes it is held against the list. Each further level is one pass over what the level before left."""
    cascade = Cascade([], hashes)
    inside, outside = listed, None
    while count := inside.count():
        if len(cascade.levels) == max_levels:
            raise RuntimeError("the cascade does not end; raise bits_per_key")
        cascade.levels.append(bloom(inside, len(cascade.levels), count, bits_per_key, hashes))
        passing = F.expr(cascade.passes("key", len(cascade.levels) - 1))
        if outside is None:  # the false positives of the first level, over the whole universe
            outside = materialize(universe.where(passing).join(listed, "key", "left_anti"))
        else:
            outside = outside.where(passing)
        inside, outside = outside, inside
    return cascade


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rules``: (verdict, host, path) with verdict allow or block. A rule fits its host and all subdomains if the url's
    path starts with the rule's; the longest host and path together wins, of equally long ones the later in code point
    order. rule is null where none fits; the verdict is then ``default``, as the cascade says that no listed key covers the
    page. Null urls and urls without ``://`` have an empty host and path and no rule; very long urls have no more
    candidates than others. Of rules given twice, block wins. page_id may be null or repeat; other columns are ignored; no rows give none.
    """
    spark = pages.sparkSession
    verdicts = {f"{h}{p}": v for v, h, p in sorted(rules)}  # block comes after allow
    df = split_url(pages).withColumn("__k", candidates(rules))
    universe = materialize(df.select(F.explode("__k").alias("key")).distinct())
    listed = {v: spark.createDataFrame([(k,) for k, own in verdicts.items() if own == v], "key string") for v in ("allow", "block")}
    cascades = {v: build(universe, keys) for v, keys in listed.items()}
    tagged = f"transform(__k, k -> struct(length(k) as n, k as k, if({cascades['block'].contains('k')}, 'block', if({cascades['allow'].contains('k')}, 'allow', null)) as v))"
    df = df.withColumn("__b", F.expr(f"array_max(filter({tagged}, x -> x.v is not null))"))
    return df.select("page_id", "host", "path", F.col("__b.k").alias("rule"), F.coalesce("__b.v", F.lit(default)).alias("verdict"))
