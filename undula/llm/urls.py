"""URL filters: a rule list first, then association rules mined from labelled URLs, combinations of tokens by Spark's FP-growth and rare single tokens by counting.

A URL's tokens are its host's suffixes of two labels or more, the words of its host, its path segments (digits as one sign) and the names of its query's
parameters. FP-growth runs over the labelled URLs with the label as one more token; combinations that imply it are rules. A rule stays if the lower Wilson
bound of its confidence reaches `confidence` and no shorter rule is contained in it. Before mining, tokens that no rule can use go (fewer than `least` bad rows), of tokens that occur in the
same labelled rows one stays (a page template's tokens are one). FP-growth takes the URLs of at most `TOGETHER` such tokens, which have at most 2 ** TOGETHER combinations each; combinations that
occur in a longer URL are counted over all URLs by levels, one token more at a time, and a combination grows only while it is frequent, no rule, and in fewer URLs than each of its parts (else a
shorter rule says the same). So no rule is lost, and what is held is bounded by disk. Rules match through an inverted index on one token each. Every such rule has
a support of at least `support` of the labelled rows (and `least` rows), so 1 / support bounds the combinations through each of a URL's tokens; these rules, not the
URLs, are sent to the tasks. A single token needs only `least` rows at any size of the input: such tokens stay a table, whose number may grow with the input, and
match by a join on the token. Ties of equal tokens and strengths go by the token.

URLs of any length are read whole. Null URLs and URLs without `://` have empty host and path, no rule and the verdict allow. With no labelled row no rule is mined. Repeated rows are judged
alike, and an empty table gives no rows; only the id, url and label columns are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm.common import few, materialize

SUPPORT, LEAST, CONFIDENCE, Z = 2e-4, 9, 0.5, 3.0
#: Tokens of a URL that FP-growth takes; longer URLs are mined by levels.
TOGETHER = 12
#: The label's token; no URL token starts with a sign of this kind.
BAD = "!bad"
#: (host, path, verdict) of the list that goes before the mined rules (fixed values).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def tokens(url: str | None) -> list[str]:
    """The distinct tokens of a URL, sorted."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return []
    host, tail = re.match(r"(?s)([^/?#]*)(.*)", rest).groups()
    labels = [x for x in host.lower().split(".") if x]
    out = {"h:" + ".".join(labels[i:]) for i in range(len(labels) - 1)} | {"w:" + w for w in re.split(r"[.\-_:@]+", host.lower()) if w}
    path, _, query = tail.partition("#")[0].partition("?")
    out |= {"p:" + re.sub(r"\d+", "0", s.lower()) for s in path.split("/") if s}
    out |= {"q:" + q.partition("=")[0].lower() for q in query.split("&") if q}
    return sorted(out)


def _tokens_column(rows: DataFrame, *keep: str) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([tokens(u) for u in b.column("url").to_pylist()], pa.list_(pa.string()))], names=[*keep, "tokens"])

    return rows.select(*keep, "url").mapInArrow(run, f"{kinds}, tokens array<string>")


@dataclass(frozen=True)
class Rule:
    tokens: tuple[str, ...]
    confidence: float
    support: float


def wilson(hits: float, n: float, z: float) -> float:
    """The lower bound of a share of hits in n."""
    p = hits / n
    return (p + z * z / (2 * n) - z * ((p * (1 - p) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)


def prune(rules: list[Rule], n: int, confidence: float = CONFIDENCE, z: float = Z) -> list[Rule]:
    """Rules whose lower bound reaches confidence, without those that contain a shorter one."""
    out: list[Rule] = []
    by_token: dict[str, list[frozenset]] = {}
    for r in sorted(rules, key=lambda r: (len(r.tokens), r.tokens)):
        hits = r.support * n
        if wilson(hits, hits / r.confidence, z) < confidence:
            continue
        if any(s <= set(r.tokens) for t in r.tokens for s in by_token.get(t, [])):
            continue
        out.append(r)
        by_token.setdefault(r.tokens[0], []).append(frozenset(r.tokens))
    return out


def labelled_tokens(labelled: DataFrame) -> DataFrame:
    """tokens, bad of the rows of labelled (url, bad boolean) that have both; written, as both kinds of rules are counted from it."""
    items = _tokens_column(labelled.filter("url is not null and bad is not null").select("url", "bad"), "bad").filter(F.size("tokens") > 0)
    return materialize(items.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _low(hits: Column, n: Column, z: float) -> Column:
    """wilson() of columns."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def minable(items: DataFrame, least: int = LEAST) -> DataFrame:
    """row, tokens, bad of the rows of items (written) that have a token to be mined, with these tokens only.

    Tokens occur in the same rows if the counts and the sums of two hashes of their rows agree.
    """
    row = items.select("tokens", "bad", F.monotonically_increasing_id().alias("row"))
    each = row.select(F.explode("tokens").alias("token"), F.col("bad").cast("int").alias("bad"), "row")
    sums = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("hits"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "row")).alias("y"))
    kept = materialize(sums.filter(F.col("hits") >= least).groupBy("n", "hits", "x", "y").agg(F.min("token").alias("token")).select("token"))
    return each.join(few(kept), "token").groupBy("row").agg((F.max("bad") == 1).alias("bad"), F.sort_array(F.collect_list("token")).alias("tokens"))


def by_levels(own: DataFrame, least: int, confidence: float = CONFIDENCE, z: float = Z, together: int = TOGETHER) -> list[Rule]:
    """Rules that contain no shorter one and occur in a row of more than `together` tokens, with their counts in all rows. own: row, tokens, bad, written."""
    total, rules, alive, single = own.count(), [], None, None
    grown = own.select("row", F.col("bad").cast("int").alias("bad"), (F.size("tokens") > together).alias("long"), F.explode("tokens").alias("token")).withColumn("set", F.array("token"))
    while True:
        sums = grown.groupBy("set").agg(F.count("*").alias("n"), F.sum("bad").alias("hits"), F.max("long").alias("long")).filter((F.col("hits") >= least) & F.col("long"))
        if alive is not None:
            parts = sums.select("set", "n", F.explode(F.expr("transform(sequence(0, size(set) - 1), i -> filter(set, (x, j) -> j != i))")).alias("part"))
            lives = parts.join(alive.select(F.col("set").alias("part"), F.col("n").alias("m")), "part").filter("m > n").groupBy("set").count().filter("count = size(set)")
            sums = sums.join(lives.select("set"), "set")
        level = materialize(sums.withColumn("sure", _low(F.col("hits"), F.col("n"), z) >= confidence))
        rules += [Rule(tuple(sorted(r.set)), r.hits / r.n, r.hits / total) for r in level.filter("sure").toLocalIterator()]
        alive = level.filter("not sure")
        if alive.isEmpty():
            return rules
        lived = grown.join(few(alive.select("set", "n")).select("set"), "set", "left_semi")
        if single is None:
            single = materialize(lived.select("row", "token"))
        grown = materialize(lived.select("row", "bad", "long", "set").join(single, "row").filter(F.col("token") > F.element_at("set", -1)).select("row", "bad", "long", F.concat("set", F.array("token")).alias("set")))


def within(rules: list[Rule], long: DataFrame) -> set[int]:
    """The numbers of the rules that occur in a row of long (tokens)."""
    index, number = Index(rules), {r: i for i, r in enumerate(rules)}

    def run(batches):
        for b in batches:
            found = {number[r] for own in b.column("tokens").to_pylist() for have in (set(own),) for t in own for r in index.by.get(t, []) if have.issuperset(r.tokens)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["rule"])

    return {r.rule for r in long.select("tokens").mapInArrow(run, "rule long").distinct().toLocalIterator()}


def rare(items: DataFrame, least: int = LEAST, confidence: float = CONFIDENCE, z: float = Z) -> DataFrame:
    """token, confidence, n of the single tokens of at least `least` bad rows whose lower bound reaches confidence. items: tokens, bad."""
    found = items.select(F.explode("tokens").alias("token"), F.col("bad").cast("int").alias("bad")).groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("hits")).filter(F.col("hits") >= least)
    return materialize(found.filter(_low(F.col("hits"), F.col("n"), z) >= confidence).select("token", (F.col("hits") / F.col("n")).alias("confidence"), "n"))


def mine(items: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE, z: float = Z, together: int = TOGETHER) -> list[Rule]:
    """Rules of frequent combinations; items: tokens, bad, written."""
    n = items.count()
    if n < least:
        return []
    own = materialize(minable(items, least))
    total = own.count()
    if not total:
        return []
    need = math.ceil(min(total, max(support, least / n) * n))  # rows of a rule, of those that are left as many as of all
    short, long = (own.filter(F.size("tokens") <= together), own.filter(F.size("tokens") > together))
    rows, rules = short.count(), []
    if rows >= need:
        items = short.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
        parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        model = FPGrowth(itemsCol="items", minSupport=max(0.0, (need - 0.5) / rows), minConfidence=confidence, numPartitions=parts).fit(items)
        found = model.associationRules.filter(F.col("consequent")[0] == BAD).select("antecedent", "confidence", "support")
        rules = [Rule(tuple(sorted(r.antecedent)), r.confidence, r.support * rows / total) for r in found.toLocalIterator()]
    if rows < total:
        gone = within(rules, long)  # short rows alone don't tell their counts
        rules = [r for i, r in enumerate(rules) if i not in gone] + by_levels(own, need, confidence, z, together)
    return prune(rules, total, confidence, z)


class Index:
    """An inverted index: each rule under one token, and how many of its other tokens a URL must have."""

    def __init__(self, rules: list[Rule]):
        number: dict[str, int] = {}
        for r in rules:
            for t in r.tokens:
                number[t] = number.get(t, 0) + 1
        self.by: dict[str, list[Rule]] = {}
        for r in rules:
            self.by.setdefault(min(r.tokens, key=lambda t: (number[t], t)), []).append(r)

    def match(self, url: str | None) -> Rule | None:
        """The surest rule that fits, ties by its tokens."""
        own = tokens(url)
        have = set(own)
        fits = [r for t in own for r in self.by.get(t, []) if have.issuperset(r.tokens)]
        return max(fits, key=lambda r: (r.confidence, r.support, r.tokens), default=None)


def judge(pages: DataFrame, mined: list[Rule], tokens_: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and mined (the association rule, or else the rare token of tokens_, that blocked; or null)."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"))
    index = Index(mined)

    def run(batches):
        for b in batches:
            fits = [index.match(u) for u in b.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([" & ".join(r.tokens) if r else None for r in fits], pa.string())], names=["page_id", "url", "mined"])

    found = rows.mapInArrow(run, "page_id long, url string, mined string")
    if tokens_ is not None and not tokens_.isEmpty():
        # one row for each different URL that has such a token, the surest of them, ties by the token
        spread = _tokens_column(rows.select("url").distinct().withColumn("key", F.col("url")), "key").select("key", F.explode("tokens").alias("token"))
        hits = spread.join(few(tokens_), "token").groupBy(F.col("key").alias("url")).agg(F.max_by("token", F.struct("confidence", "n", "token")).alias("token"))
        found = found.join(few(materialize(hits)), "url", "left").select("page_id", "url", F.coalesce("mined", "token").alias("mined"))
    out = found.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "mined")
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose id has labels: bad if any of them says toxic or of low quality."""
    bad = labels.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).join(bad, "page_id").select("url", "bad")
