"""URL filters: rules and block lists as Bloom filter cascades.

A cascade gives exact membership for every key of a known universe.  Level 0
encodes the listed keys; level 1 the other keys of the universe that level 0
lets through; level 2 the listed keys that level 1 lets through, and so on until
a level lets none through.  A key's place is the first level that rejects it.
Looking up a key tests bits of constants: no join, no Python.  The filter of a
long list is cut into slices by a hash of the key.  Driver and plan hold about
1.4 bits for each listed key and probe, so the list's length is bounded by their
memory alone (60 million keys at one probe: 11 MB in two slices).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalsweep.llm.common import staged

# A level's bits travel as constants of the plan, cut into slices of at most 8 MB each.
MAX_BITS = 1 << 26


@dataclass
class Level:
    """A Bloom filter cut by a hash of the key into slices of equal size."""

    bits: int  # of each slice
    probes: int
    seed: int
    slices: list[list[int]]  # 64 bits to a word

    def slice_of(self, key: Column) -> Column:
        # One argument less than the probes have, so that the hashes are independent.
        return F.pmod(F.xxhash64(key, F.lit(self.seed)), F.lit(len(self.slices)).cast("long")).cast("int")

    def positions(self, key: Column) -> list[Column]:
        return [
            F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.bits).cast("long"))
            for i in range(self.probes)
        ]

    def might_hold(self, key: Column) -> Column:
        # One text constant, cut by the optimizer once, is far lighter than a list of literals.
        constants = [F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>") for words in self.slices]
        words = constants[-1]
        for i in range(len(constants) - 2, -1, -1):
            words = F.when(self.slice_of(key) == i, constants[i]).otherwise(words)
        hit = F.lit(True)
        for at in self.positions(key):
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            bit = F.call_function("getbit", word, F.pmod(at, F.lit(64)).cast("int"))
            hit = hit & (bit == 1)
        return hit


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed; false for null."""
        # After the last level no key of the other kind is left.
        answer = F.lit(bool(self.levels) and len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            rejected = depth % 2 == 1  # a key that an odd level rejects is listed
            answer = F.when(self.levels[depth].might_hold(key), answer).otherwise(F.lit(rejected))
        return F.coalesce(answer & key.isNotNull(), F.lit(False))


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    probes = max(1, round(-math.log2(rate)))
    needed = max(64, math.ceil(n * probes * 1.4427))
    n_slices = -(-needed // MAX_BITS)
    bits = 64 * math.ceil(needed / n_slices / 64)
    level = Level(bits, probes, seed, [[0] * (bits // 64) for _ in range(n_slices)])
    key = F.col("key")
    at = F.explode(F.array(*level.positions(key))).alias("at")
    words = (
        keys.select(level.slice_of(key).alias("slice"), at)
        .groupBy("slice", F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    )
    for row in words.toLocalIterator():  # as many rows as the filter has words
        level.slices[row["slice"]][row["word"]] = row["bits"]
    return level


def fit_cascade(universe: DataFrame, seed: int = 17) -> Cascade:
    """Cascade over ``(key, listed)`` rows that hold each key once.

    The first level's rate follows the share of listed keys, so that listed and
    falsely passed keys are about as many; later levels halve what is left.
    """
    n_listed, n_other = (
        universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    )
    cascade, rate = Cascade(), min(0.5, n_listed * math.sqrt(2) / max(1, n_other))
    left = {True: n_listed, False: n_other}
    passing, kind = universe, True
    while left[kind]:
        if len(cascade.levels) > 60:
            raise RuntimeError("the cascade does not end; are keys repeated?")
        own = passing.filter(F.col("listed") == F.lit(kind))
        level = _level(own, left[kind], rate, seed + len(cascade.levels))
        cascade.levels.append(level)
        rate = 0.5
        # Keys of this kind all pass; of the other kind, those passed falsely must be encoded next.
        passing = passing.filter((F.col("listed") == F.lit(kind)) | level.might_hold(F.col("key")))
        kind = not kind
        left[kind] = passing.filter(F.col("listed") == F.lit(kind)).count()
    return cascade


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; only A-Z are lower-cased."""
    found = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``, which ends with a slash."""

    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.host.split(".")), self.path.count("/")


def rule_key(shape: tuple[int, int], host: Column, path: Column) -> Column:
    """The one key of a rule of this shape that can fit a URL: its last labels and first folders."""
    labels, slashes = shape
    enough = F.size(F.split(host, r"\.")) >= labels
    folder = F.regexp_extract(path, "^(?:[^/]*/){%d}" % slashes, 0)
    return F.when(enough & (folder != ""), F.concat(F.substring_index(host, ".", -labels), folder))


def marked(universe: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct non-null keys of both, with a flag for the listed ones."""
    both = universe.select("key", F.lit(0).alias("flag")).unionByName(
        listed.select("key", F.lit(1).alias("flag"))
    )
    return (
        both.filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg((F.max("flag") == 1).alias("listed"))
    )


def judge_urls(pages: DataFrame, rules: Sequence[Rule], blocked: DataFrame) -> DataFrame:
    """Host, path, deciding rule and verdict of every page.

    The longest rule that fits decides.  Where none does, the method decides:
    block if the host is in ``blocked`` (rows ``key``, any number), else allow.
    Rules and blocked hosts are looked up in cascades whose universe is every key
    that these pages can ask for, so the answers are exact.  A null URL or one
    without ``://`` has an empty host and path and is allowed; a null ``page_id``
    is kept; repeated rows give repeated rows; of two rules of one length only one
    can fit a URL, so there are no ties; URLs of any length are read whole; other
    columns are left out; an empty table gives no rows, an empty list blocks nothing.
    """
    for rule in rules:
        if not rule.path.endswith("/"):
            raise ValueError(f"the path of rule {rule.key} must end with a slash")
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    shapes = sorted({rule.shape for rule in rules})
    asked = split.select(
        host, F.array_compact(F.array(*[rule_key(s, host, path) for s in shapes])).alias("keys")
    ).distinct()
    keys = staged(
        asked.select(F.explode("keys").alias("key")).distinct(), "url-keys"
    )
    hosts = staged(marked(asked.select(host.alias("key")), blocked), "url-hosts")
    spark = pages.sparkSession
    of_verdict = {}
    for verdict in ("allow", "block"):
        own = [(r.key,) for r in rules if r.verdict == verdict]
        rows = spark.createDataFrame(own, "key string")
        of_verdict[verdict] = fit_cascade(staged(marked(keys, rows), f"url-{verdict}"))
    blocklist = fit_cascade(hosts)

    # Longest key first; of two shapes only one key each can fit.
    hits = [
        F.when(
            of_verdict[verdict].contains(rule_key(shape, host, path)),
            F.struct(
                F.length(rule_key(shape, host, path)).alias("size"),
                rule_key(shape, host, path).alias("rule"),
                F.lit(verdict).alias("verdict"),
            ),
        )
        for shape in shapes
        for verdict in ("allow", "block")
    ]
    if hits:
        best = F.array_max(F.array_compact(F.array(*hits)))
        split = split.withColumn("best", best)
        rule, verdict = F.col("best.rule"), F.col("best.verdict")
    else:
        rule = verdict = F.lit(None).cast("string")
    method = F.when(blocklist.contains(host), "block").otherwise("allow")
    return split.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict")
    )
