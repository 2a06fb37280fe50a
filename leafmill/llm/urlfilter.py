"""URL filters: a blocked Bloom filter of listed keys passes possible hits to an exact hash join. DataFrame functions only.

A list entry is a host with a path prefix; it fits the host and all subdomains if the path starts with the prefix. A URL's keys
are its host's suffixes of as many labels as some entry has, each with the path's beginnings of as many characters as some entry
has. Each key is looked up in the filter row by row, before anything is moved: a hash picks the block (64 bits), others the four
bits in it. URLs without a possible hit are judged on the spot. The others are joined to the list on the key, once for each
different host and path, which removes false positives, and the longest entry wins.

The filter has BITS bits for each entry, up to MAX_WORDS words (8 MiB); a longer list only lets more false positives through to the
join. It stands in the plan as one constant. Whether the list is broadcast in the join is up to Spark, which checks its size.

Defined results: a null URL or one without "://" has empty host and path and fits nothing; hosts are lower-cased (A-Z) and
otherwise taken literally; very long URLs are judged whole; repeated URLs get equal verdicts; of entries with one key (ties), the
action that sorts last wins; an empty list leaves every URL to the default; an empty table gives an empty result; extra columns
pass through judge(), whatever their names, but that its own four replace any of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import free_names

#: Action and entry of the base rules (fixed values).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MAX_WORDS = 1 << 20
#: Bits of the filter for each key that it lists.
BITS = 16
#: Words of the filter that come to the driver in one row.
_GROUP = 1 << 10
DEFAULT = "allow"
OWN = ("host", "path", "rule", "verdict")
#: Names of sites to block where no rule decides, under each of the domains (fixed values).
SITES = ("adult-x", "spam-farm", "cheap-pills", "ads-track", "casino-win", "free-bets")
DOMAINS = ("example.com", "example.net", "example.org")


def listed_table(spark: SparkSession, rules=RULES, sites=SITES, domains=DOMAINS) -> DataFrame:
    """key, action and is_rule of each rule and each listed site."""
    rows = [(k, a, True) for a, k in rules] + [(f"{s}.{d}/", "block", False) for s in sites for d in domains]
    if not rows:
        return spark.sql("SELECT '' AS key, '' AS action, true AS is_rule WHERE false")
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', '{a}', {r})" for k, a, r in rows) + " AS t(key, action, is_rule)")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def _block(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def _bits(key: Column) -> list[Column]:
    """The four places in a word that a key sets."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(4)]


class Filter:
    """The words of a blocked Bloom filter, and the shapes of the keys that it lists."""

    def __init__(self, listed: DataFrame, max_words: int | None = None) -> None:
        most = MAX_WORDS if max_words is None else max_words
        host = F.substring_index("key", "/", 1)
        # As many different numbers of labels and characters as entries have: a few dozen.
        shapes = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.size(F.split(host, r"\."))).alias("labels"), F.collect_set(F.length("key") - F.length(host)).alias("paths")).first()
        self.labels, self.paths = sorted(shapes.labels), sorted(shapes.paths)
        self.n_words = 1
        while self.n_words * 64 < shapes.n * BITS and self.n_words < most:
            self.n_words *= 2
        places = F.array_distinct(F.array(*_bits(F.col("key"))))
        mask = F.aggregate(places, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.element_at(_powers(), b + 1)))
        words = listed.groupBy(_block(F.col("key"), self.n_words).alias("w")).agg(F.bit_or(mask).alias("bits"))
        # A group has _GROUP words, so the rows are bounded by the filter's size, whatever the list's.
        grouped = words.groupBy(F.floor(F.col("w") / _GROUP).alias("g")).agg(F.collect_list(F.struct("w", "bits")).alias("own"))
        held = bytearray(8 * self.n_words)
        for r in grouped.collect():
            for w, bits in r.own:
                held[8 * w : 8 * w + 8] = (bits & (1 << 64) - 1).to_bytes(8, "big")
        self.held = bytes(held)

    def may_hold(self, key: Column) -> Column:
        # The word as text of 16 digits, of which each bit's digit is looked at.
        word = F.hex(F.substring(F.lit(self.held), _block(key, self.n_words) * 8 + 1, F.lit(8)))
        out = None
        for b in _bits(key):
            digit = F.conv(F.substring(word, F.lit(16) - F.floor(b / 4).cast("int"), F.lit(1)), 16, 10).cast("int")
            on = digit.bitwiseAND(F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4), F.lit(8)), b % 4 + 1)) != 0
            out = on if out is None else out & on
        return out

    def keys(self, host: Column, path: Column) -> Column:
        """The keys of a URL that the list may hold."""
        hosts = F.array_distinct(F.array(*[F.substring_index(host, ".", -k) for k in self.labels]))
        starts = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in self.paths]))
        return F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda p: F.concat(h, p))))


def _powers() -> Column:
    """1, 2, 4 and so on in 64 bits."""
    return F.array(*[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(64)])


def judge(pages: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; listed has key, action and is_rule. A rule decides before any other entry, and is named."""
    bloom = Filter(listed)
    host, path = split_url(F.col(f"`{url}`"))
    passed = [c for c in pages.columns if c.lower() not in OWN]
    hits, = free_names([*passed, *OWN], "_lm_hits")
    named = pages.select(*[F.col(f"`{c}`") for c in passed], host.alias("host"), path.alias("path"))
    shown = [F.col(f"`{c}`") for c in passed] + [F.col("host"), F.col("path")]
    undecided = [F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT).alias("verdict")]
    if not bloom.labels:
        return named.select(*shown, *undecided)
    held = F.filter(bloom.keys(F.col("host"), F.col("path")), bloom.may_hold)
    probed = named.withColumn(hits, held)
    clear, asked = probed.where(F.size(hits) == 0), probed.where(F.size(hits) > 0)
    # Verdicts hang on host and path alone, so repeated ones are looked up once.
    keys = asked.select("host", "path", F.col(hits).alias("hits")).dropDuplicates(["host", "path"]).select("host", "path", F.explode("hits").alias("key"))
    best = lambda own: F.max(F.when(own, F.struct(F.length("key").alias("n"), F.col("action").alias("action"), F.col("key").alias("key"))))
    found = keys.join(listed, "key").groupBy("host", "path").agg(best(F.col("is_rule")).alias("of_rule"), best(~F.col("is_rule")).alias("of_site"))
    found = found.select(F.col("host").alias("_f_host"), F.col("path").alias("_f_path"), F.struct(F.col("of_rule.key").alias("rule"), F.coalesce("of_rule.action", "of_site.action").alias("action")).alias("_f_made"))
    slim = asked.select(F.struct(*shown).alias("_f_row"), "host", "path")
    judged = slim.join(found, (F.col("host") == F.col("_f_host")) & (F.col("path") == F.col("_f_path")), "left")
    out = judged.select("_f_row.*", F.col("_f_made.rule").alias("rule"), F.coalesce("_f_made.action", F.lit(DEFAULT)).alias("verdict"))
    return clear.select(*shown, *undecided).unionByName(out)
