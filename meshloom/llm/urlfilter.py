"""URL verdicts by host and path rules, and by a Bloom filter cascade of listed hosts where no rule fits.

The cascade is built over the complete universe of keys, which is all hosts of the table. Level 0 encodes the listed
keys; level 1 the keys that aren't listed but pass level 0; level 2 the listed keys that pass level 1; and so on, until
no key is wrong. A key's first level that it doesn't pass tells what it is, so for every key of the universe the answer is
exact, and pages are joined with nothing. Level 0's false positive rate is set to about the share of listed keys, so the levels
above hold about as many keys as the list: the cascade's size follows the list, not the universe. Keys are dealt by hash to as
many cascades as it takes for each to stay below CASCADE_BYTES; beyond one, they are broadcast one after the other, and what
each has judged is written before the next.

The list is a table. Which hosts of the universe it has is found once, by an equality join of the distinct hosts' domain suffixes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, read_table, stash

#: Fixed values of the query: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Parameter of the query: hosts to block where no rule fits, with their subdomains.
LISTED = ("free-bets.example.com", "casino.example.net", "pills.example.org", "adult-x.example.net")
#: Bytes of a cascade that is broadcast, and the most listed keys that are expected to fit: a level takes less than 4 bytes a key,
#: but for one that isn't rare, and all levels together no more than twice that.
CASCADE_BYTES = 64 << 20
BYTES_PER_KEY = 16
HASHES = 4
#: Parts that rows of one suffix are dealt to.
SALTS = 16


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host, up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as text, its verdict), null where none fits. The rules are few and become one expression; the longest first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(of + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def listed_hosts(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """hosts (key), distinct; listed (host) -> (key, listed): whether the key or a domain above it is listed, A-Z lower-cased.

    Only suffixes no longer than the longest listed host are looked for. Those of many hosts, as com is, are salted."""
    low = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    names = listed.select(low.alias("suffix")).where("suffix <> ''").distinct()
    longest = names.agg(F.max(F.length("suffix"))).first()[0] or 0
    tail = F.expr(f"right(key, {longest + 1})")
    labels = F.split(tail, r"\.")
    # a suffix begins a host or stands behind a dot
    first = F.when(F.length("key") > longest, F.lit(2)).otherwise(F.lit(1))
    suffixes = F.when(F.size(labels) >= first, F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    each = hosts.select("key", F.explode(suffixes).alias("suffix")).where("suffix <> ''").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    salted = names.select("suffix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    bad = each.join(salted, ["suffix", "salt"], "left_semi").select("key").distinct().withColumn("hit", F.lit(True))
    return hosts.join(bad, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("listed"))


class Cascade:
    """Levels are (seed, number of bits, bit array). Built level by level from the outside."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, int, np.ndarray]] = []

    @staticmethod
    def places(keys: list[str], seed: int, bits: int) -> np.ndarray:
        import xxhash

        pairs = [xxhash.xxh3_128_intdigest(k.encode(), seed) for k in keys]
        a = np.array([p & (1 << 64) - 1 for p in pairs], np.uint64)
        b = np.array([p >> 64 | 1 for p in pairs], np.uint64)
        return np.stack([(a + np.uint64(j) * b) % np.uint64(bits) for j in range(HASHES)], axis=1)

    def passes(self, level: int, keys: list[str]) -> np.ndarray:
        seed, bits, filled = self.levels[level]
        if not keys:
            return np.zeros(0, bool)
        at = self.places(keys, seed, bits)
        return ((filled[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def listed(self, keys: list[str]) -> np.ndarray:
        """Whether each key is listed; exact for keys of the universe."""
        answer, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
        for level in range(len(self.levels)):
            through = self.passes(level, [keys[k] for k in open_])
            answer[open_[~through]] = level % 2 == 1
            open_ = open_[through]
        answer[open_] = len(self.levels) % 2 == 1
        return answer


def bits_for(n: int, rate: float) -> int:
    """Bits of a filter of n keys with HASHES hash functions and this false positive rate, whole bytes."""
    per_key = -HASHES / math.log(1 - min(max(rate, 1e-9), 0.5) ** (1 / HASHES))
    return max(64, 8 * math.ceil(per_key * n / 8))


def _places_column(seed: int, bits: int):
    @F.arrow_udf("array<long>")
    def at(keys: pa.Array) -> pa.Array:
        got = Cascade.places(keys.to_pylist(), seed, bits)
        return pa.array(got.astype(np.int64).tolist(), pa.list_(pa.int64()))

    return at


def _through(held, level: int):
    @F.arrow_udf("boolean")
    def through(keys: pa.Array) -> pa.Array:
        return pa.array(held.value.passes(level, keys.to_pylist()), pa.bool_())

    return through


def _level(keys: DataFrame, seed: int, bits: int) -> np.ndarray:
    """The bit array of a level. It is put together by an aggregate; the driver receives its bytes, not the keys."""
    at = keys.select(F.explode(_places_column(seed, bits)(F.col("key"))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("mask"))
    filled = np.zeros((bits + 63) // 64, np.uint64)
    for word, mask in words.toLocalIterator():
        filled[word] = mask & (1 << 64) - 1
    return filled.astype("<u8").view(np.uint8)


def build_cascade(universe: DataFrame, most_levels: int = 64) -> Cascade:
    """universe (key, listed): distinct keys, written already. Each level's keys are what the levels before get wrong."""
    spark, keys = universe.sparkSession, universe
    n_listed, n_all = keys.agg(F.count(F.when(F.col("listed"), 1)), F.count("*")).first()
    cascade = Cascade()
    side, n, open_ = True, n_listed, keys
    for level in range(most_levels):
        if not n:
            return cascade
        rate = min(0.5, n_listed / max(1, n_all - n_listed) / 2) if level == 0 else 0.5
        bits = bits_for(n, rate)
        cascade.levels.append((level, bits, _level(open_.where(F.col("listed") == side), level, bits)))
        through = _through(spark.sparkContext.broadcast(cascade), level)
        # the other side's keys that pass are wrong at this level; the keys encoded here stay in question
        open_ = open_.where((F.col("listed") == side) | through(F.col("key")))
        side = not side
        n = open_.where(F.col("listed") == side).count()
    raise ValueError("the cascade did not end")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, listed: Sequence[str] | DataFrame = LISTED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, listed.

    listed: hosts, or a table with a column host; null and empty ones are ignored. rule is the longest that fits (host or
    subdomain, path begins with its path), else null. The verdict is the rule's; without one, block if the host or a domain above
    it is listed, else allow. A null url, or one without ://, has an empty host and path: no rule fits and it is allowed, as empty
    keys are never listed. Very long urls are cut whole. Repeated rows stay. Other columns are ignored. An empty table gives no rows."""
    spark = pages.sparkSession
    names = listed if isinstance(listed, DataFrame) else spark.createDataFrame([(x,) for x in listed], "host string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    universe = stash(listed_hosts(rows.select(F.col("host").alias("key")).distinct(), names.select("host")), "universe")
    shards = max(1, -(-universe.where("listed").count() * BYTES_PER_KEY // CASCADE_BYTES))
    done = None
    for k in range(shards):
        own = lambda key: F.pmod(F.xxhash64(F.col(key)), F.lit(shards)) == k  # noqa: E731, B023
        held = spark.sparkContext.broadcast(build_cascade(universe if shards == 1 else universe.where(own("key"))))
        judged = (rows if shards == 1 else rows.where(own("host"))).select("*", rule.alias("rule"), verdict.alias("by_rule"), _member(held)(F.col("host")).alias("listed"))
        judged = judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
        if shards > 1:
            judged = stash(judged, "judged")
            held.destroy()
        done = judged if done is None else done.union(judged)
    forget(universe)
    return done


def _member(held):
    @F.arrow_udf("boolean")
    def member(hosts: pa.Array) -> pa.Array:
        return pa.array(held.value.listed(hosts.to_pylist()), pa.bool_())

    return member


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))


def _sql() -> str:
    def case(of) -> str:
        whens = [f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{of(v, h, p)}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
        return f"CASE {' '.join(whens)} END"

    listed = " OR ".join(f"host = '{x}' OR host LIKE '%.{x}'" for x in LISTED)
    return f"""
    WITH cut AS (
      SELECT page_id,
             translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
      FROM pages)
    SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule,
           coalesce({case(lambda v, h, p: v)}, CASE WHEN {listed} THEN 'block' ELSE 'allow' END) AS verdict,
           ({listed}) AS listed
    FROM cut"""


ORACLE = _sql()
