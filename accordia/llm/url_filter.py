"""URL filters by a Bloom filter cascade, with DataFrame functions only.

Level 1 encodes the listed keys, level 2 those keys of the corpus that wrongly pass level 1, level 3 those listed keys
that wrongly pass level 2, and so on until a level lets nothing wrong pass. Because the false positives come from every
key of the corpus, membership is exact for each of them and takes no join.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordia.llm.common import fresh, materialize

#: The largest filter that one pass sends to the executors; a longer list is dealt out by a hash into more cascades.
MAX_FILTER_BITS = 1 << 25
LATER_FPP = 0.5


#: Stands between a key's host and path: no host and no path of a url holds it.
MARK = "#"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str  # A-Z count as a-z, as they do in urls
    path: str  # a url's path is empty or begins with a slash; a rule's that is neither fits none

    @property
    def key(self) -> str:
        return "".join(c.lower() if c < "\x80" else c for c in self.host) + MARK + self.path


class Level(NamedTuple):
    bits: int
    probes: int
    words: list[int]
    seed: int

    def passes(self, key: Column) -> Column:
        """Whether all bits of the key are set; the words are in the plan once, as one folded constant."""
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        at = F.array(*positions(key, self.bits, self.probes, self.seed))
        return F.forall(at, lambda x: F.getbit(F.element_at(words, (F.floor(x / 64) + 1).cast("int")), (x % 64).cast("int")) == 1)


def positions(key: Column, bits: int, probes: int, seed: int) -> list[Column]:
    """Double hashing; both hashes are cut to 40 bits, so that nothing overflows."""
    low = F.lit((1 << 40) - 1)
    one, two = F.xxhash64(key, F.lit(2 * seed)).bitwiseAND(low), F.xxhash64(key, F.lit(2 * seed + 1)).bitwiseAND(low).bitwiseOR(F.lit(1))
    return [(one + two * i) % F.lit(bits).cast("long") for i in range(probes)]


def filter_bits(n: int, fpp: float) -> int:
    return 64 * max(1, math.ceil(n * -math.log(fpp) / math.log(2) ** 2 / 64))


def make_level(keys: DataFrame, n: int, fpp: float, seed: int) -> Level:
    """A Bloom filter of n keys (column key). Its words, at most MAX_FILTER_BITS / 16, come to the driver."""
    bits, probes = filter_bits(n, fpp), max(1, round(-math.log2(fpp)))
    if bits > 4 * MAX_FILTER_BITS:
        raise ValueError(f"a level of {bits} bits is over the bound of {4 * MAX_FILTER_BITS}")
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, probes, seed))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    found = at.groupBy(F.floor(F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(one).alias("value")).collect()
    words = [0] * (bits // 64)
    for x in found:
        words[x["word"]] = x["value"]
    return Level(bits, probes, words, seed)


class Cascade(NamedTuple):
    levels: list[Level]

    def contains(self, key: Column) -> Column:
        """Exact for listed keys and for all keys of the universe it was built over."""
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.passes(key) & ~out
        return out


def make_cascade(listed: DataFrame, universe: DataFrame, first_fpp: float, later_fpp: float = LATER_FPP, most_levels: int = 40) -> Cascade:
    """listed, universe: DataFrames with a string column key; universe may repeat keys and may hold listed ones."""
    inside = materialize(listed.select("key").where("key is not null").distinct(), "listed")
    n, levels = inside.count(), []
    if not n:
        return Cascade([])
    levels.append(make_level(inside, n, first_fpp, 0))
    passing = universe.select("key").where(levels[0].passes(F.col("key"))).distinct().withColumn("listed", F.lit(0))
    # One grouped union tells the listed keys from the false positives; only the latter, about as many as are listed, stay.
    outside = passing.unionByName(inside.withColumn("listed", F.lit(1))).groupBy("key").agg(F.max("listed").alias("listed")).where("listed = 0").select("key")
    outside = materialize(outside, "outside")
    encode, other = outside, inside
    while (n := encode.count()) and len(levels) < most_levels:
        levels.append(level := make_level(encode, n, later_fpp, len(levels)))
        encode, other = materialize(other.where(level.passes(F.col("key"))), "passing"), encode
    if n:
        raise ValueError("the cascade did not end")
    return Cascade(levels)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path) as strings; both empty for a null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.call_function("substring", url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Keys that a rule of one of the rules' shapes could have, the longest first, then the longest host."""
    labels, lengths = sorted({r.host.count(".") + 1 for r in rules}), sorted({len(r.path) for r in rules})
    parts = F.split(host, r"\.")
    hosts = F.transform(F.filter(F.array(*map(F.lit, labels)), lambda k: k <= F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    paths = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length(path)), lambda k: F.call_function("substring", path, F.lit(1), k))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct((F.length(h) + F.length(p)).alias("n"), F.length(h).alias("h"), F.concat(h, F.lit(MARK), p).alias("key")))))
    return F.transform(F.sort_array(keys, asc=False), lambda x: x["key"])


def judge_urls(urls: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", first_fpp: float | None = None, max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """urls with host, path, rule and verdict added (replacing columns of those names).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, then the longest host.
    An empty path of a rule fits all paths. The rule of a row is its host, lower-cased, and its path as one string.
    A null url, or one without ://, has an empty host and path, no rule and the default verdict. Repeated rows are
    judged alike; an empty table gives an empty result. A host and path listed as block and as allow are an error. Lists whose
    levels would be over max_bits are dealt out by a hash of the key into cascades of their own, with a pass over the urls each.
    """
    if any(not r.host or r.verdict not in ("allow", "block") for r in rules) or len({r.key for r in rules}) < len({(r.verdict, r.key) for r in rules}):
        raise ValueError("each rule needs a host, a verdict of allow or block, and a host and path of its own")
    host, path = split_url(F.col(url))
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    out = urls.select(*kept, host.alias("host"), path.alias("path"))
    if not rules:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    verdicts = {r.key: r.verdict for r in rules}
    listed = urls.sparkSession.createDataFrame([*verdicts.items()], "key string, verdict string")
    shapes = len({r.host.count(".") for r in rules}) * len({len(r.path) for r in rules})
    keys_at_most = urls.count() * shapes
    fpp = first_fpp or min(0.25, max(1e-9, len(verdicts) / max(1, keys_at_most)))
    # The second level holds what wrongly passes the first; later ones are smaller.
    wrong = math.ceil(2 * fpp * keys_at_most)
    shards = -(-max(filter_bits(len(verdicts), fpp), filter_bits(wrong, LATER_FPP)) // max_bits)
    hit_, first_ = fresh(out, "hit", "first")
    out = out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    every = candidates(F.col("host"), F.col("path"), rules)
    for shard in range(shards):
        deal = lambda key: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards))
        own = listed.where(deal(F.col("key")) == shard)
        at = F.lit(shard)
        keys = F.filter(every, lambda key: deal(key) == at) if shards > 1 else every  # noqa: B023
        listing = make_cascade(own, out.select(F.explode(keys).alias("key")), fpp)
        blocking = make_cascade(own.where("verdict = 'block'"), own, LATER_FPP)
        met = out.withColumn(hit_, F.try_element_at(F.filter(keys, listing.contains), F.lit(1)))
        # Of two rules that fit, the one whose key comes first among all candidates is the longer.
        longer = F.col("rule").isNull() | (F.array_position(every, F.col(hit_)) < F.array_position(every, F.col("rule"))) if shard else F.lit(True)
        met = met.withColumn(first_, F.col(hit_).isNotNull() & longer)
        met = met.withColumn("verdict", F.when(~F.col(first_), F.col("verdict")).when(blocking.contains(F.col(hit_)), "block").otherwise("allow"))
        out = met.withColumn("rule", F.when(F.col(first_), F.col(hit_)).otherwise(F.col("rule"))).drop(hit_, first_)
        if shards > 1:  # each pass has its own filters alone in its plan
            out = materialize(out, "judged")
    return out.withColumn("rule", F.replace("rule", F.lit(MARK), F.lit("")))
