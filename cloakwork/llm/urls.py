"""URL filters (operator 4): a Bloom filter cascade over the corpus's complete key universe.

A key is a host's last labels and the first characters of a path, of those lengths that the rules have: a URL has at most
one key for each shape (labels, characters) among the rules, and a rule fits the URL if it is one of its keys. The cascade
answers exactly, for every key in the corpus, whether it is listed: level 1 is a Bloom filter of the listed keys, level 2
one of those keys in the universe that level 1 takes for listed but are not, level 3 one of the listed keys that level 2
takes for those, and so on until a level is mistaken for none. A key is listed if the first level that lacks it is an even
one. A second cascade, over the listed keys, tells those that block from those that allow. Levels are built in Spark: of
each level only the words of its bit array reach the driver, and they become a literal in the plan, so looking a key up
joins nothing.

A level has 2 sqrt(n u) bits, or 8 n if that is more, for n keys to encode and u keys to tell them from, in powers of two:
with two hashes it then mistakes at most about n keys, so levels don't grow with the universe (0.5 million bits for 5 rules and 10^10 keys). MAX_BITS bounds
what is sent along; where it is not enough there are more levels.
A null URL, or one without `://`, has empty host and path, no key, and is allowed. Equal URLs get equal results; repeated
rows and extra columns do not matter. An empty table gives no rows. A URL that no rule fits is allowed by the cascade, as
none of its keys is listed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

HASHES = 2
MIN_BITS, MAX_BITS, MAX_LEVELS = 1 << 8, 1 << 24, 64


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    bits: int
    seed: int
    words: tuple[int, ...]  # 64 bits each


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def shapes(rules: list[Rule]) -> list[tuple[int, int]]:
    """(labels, characters) of the rules, the longest first."""
    return sorted({(r.host.count(".") + 1, len(r.path)) for r in rules}, key=lambda s: (-s[1], -s[0]))


def keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The URL's keys, one for each shape that it is long enough for."""
    labels = F.size(F.split(host, r"\.", -1))
    found = [F.when((labels >= n) & (F.length(path) >= m) & (host != ""), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m))) for n, m in shapes(rules)]
    return F.array_distinct(F.array_compact(F.array(*found)))


def positions(key: Column, level: Level | tuple[int, int]) -> list[Column]:
    bits, seed = (level.bits, level.seed) if isinstance(level, Level) else level
    return [F.pmod(F.xxhash64(key, F.lit(1000 * seed + k)), F.lit(bits)) for k in range(HASHES)]


def within(key: Column, level: Level) -> Column:
    """Whether the level's filter takes the key."""
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")

    def both(w: Column) -> Column:
        first, second = (F.getbit(F.element_at(w, (p / 64).cast("int") + 1), (p % 64).cast("int")) == 1 for p in positions(key, level))
        return first & second

    return F.element_at(F.transform(F.array(words), both), 1)  # the words are folded to one literal, met once


def listed(key: Column, levels: list[Level]) -> Column:
    """Whether the key is in the set that the cascade encodes: exact for every key of its universe."""
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        out = F.when(within(key, levels[k]), out).otherwise(F.lit(k % 2 == 1))
    return out


def level(keys_in: DataFrame, n: int, others: int, seed: int) -> Level:
    """A Bloom filter of the column key of keys_in, of which there are n, to be told from so many others."""
    bits = MIN_BITS
    while bits < MAX_BITS and (bits < 8 * n or bits**2 < 4 * n * others):
        bits *= 2
    at = F.explode(F.array(*positions(F.col("key"), (bits, seed)))).alias("at")
    words = keys_in.select(at).groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("set"))
    out = [0] * (bits // 64)
    for r in words.collect():
        out[r["word"]] = r["set"]
    return Level(bits, seed, tuple(out))


def cascade(members: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that tell members from the rest of the universe. Both have the column key alone; members may hold keys beyond the universe.

    The universe should be stored, as each level reads it.
    """
    members = members.distinct()
    inside, outside = members, universe.join(members, "key", "left_anti").distinct() if len(members.take(1)) else universe
    levels: list[Level] = []
    mine, other = inside, outside
    n, others = mine.count(), other.count()
    while n and len(levels) < MAX_LEVELS:
        now = level(mine, n, others, len(levels) + 1)
        levels.append(now)
        # What this level mistakes for its own is what the next one encodes.
        mistaken = other.where(within(F.col("key"), now))
        mine, other = mistaken, mine
        n, others = mine.count(), n
    if n:
        raise ValueError(f"{n} keys are still mistaken after {MAX_LEVELS} levels; raise MAX_BITS")
    return levels


def rule_keys(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.range(1).select(F.explode(F.lit([r.key for r in rules]) if rules else F.array().cast("array<string>")).alias("key"))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (the longest that fits, as host and path; else null), verdict."""
    spark = pages.sparkSession
    host, path = parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    universe = cut(rows.select(F.explode(keys(F.col("host"), F.col("path"), rules)).alias("key")).distinct(), "url-keys")
    known = cascade(rule_keys(spark, rules), universe)
    blocked = cascade(rule_keys(spark, [r for r in rules if r.verdict == "block"]), rule_keys(spark, rules))
    fits = F.filter(keys(F.col("host"), F.col("path"), rules), lambda k: listed(k, known))
    best = F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    judged = rows.withColumn("rule", best)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull() & listed(F.col("rule"), blocked), "block").otherwise("allow").alias("verdict"))


#: The rules of the registered query.
RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
