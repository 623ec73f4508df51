"""URL filters: fixed host rules first, mined association rules for the rest.

A fixed rule has a host and a path; it fits its host and all subdomains where the
url's path begins with its own. The longest rule that fits gives the verdict.

For urls that no fixed rule fits, FP-growth mines combinations of url tokens (scheme,
labels of the host by their place, segments of the path by theirs and its extension, keys
of the query) that go with a verdict in labelled urls. Rules are pruned by
support and confidence, and where a shorter rule with the same verdict is no less
confident. An inverted index from each rule's rarest token to the rule finds
candidates by a join; a candidate fits if the url has all its tokens. The most
confident rule wins, then the longer, the better supported, a block before an
allow, and the first in order of its tokens. Where none fits, the default holds.

The miner sees a bounded sample of the labelled urls; support and confidence bound
the number of rules, whatever the size of the table. Where a sampled url has more than
``GROWTH_TOKENS`` frequent tokens, whose combinations of all sizes FP-growth would make,
those of up to ``max_tokens`` are counted size by size, which gives the same rules.
Every url is judged.

Cases: a null url, or one without ``://``, has empty host and path, no tokens and
the default verdict; urls of any length are judged whole; equal urls get equal
verdicts; without labelled urls no rule is mined; a null id is kept as it is; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import saved

#: Fixed rules of the contract: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.01, 0.8, 4
#: Labelled urls that the miner sees, about.
SAMPLE_ROWS = 50_000
#: The most frequent tokens of a url for FP-growth: it makes all their combinations.
GROWTH_TOKENS = 18
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    known = F.coalesce(at > 0, F.lit(False))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    empty = F.lit("")
    return F.when(known, F.translate(raw, _UPPER, _LOWER)).otherwise(empty), F.when(known, path).otherwise(empty)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")),
        )
        for v, h, p in ordered
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<verdict: string, rule: string>")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url, each marked with where it stands; numbers are one token."""
    plain = lambda part: F.regexp_replace(F.lower(part), r"\d+", "#")
    labels = F.reverse(F.split(host, r"\."))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.split(query, "&"), lambda p: p != "")
    extension = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    found = F.concat(
        F.transform(labels, lambda p, i: F.concat(F.lit("host"), i.cast("string"), F.lit(" "), plain(p))),
        F.transform(parts, lambda p, i: F.concat(F.lit("path"), i.cast("string"), F.lit(" "), plain(p))),
        F.transform(keys, lambda p: F.concat(F.lit("key "), plain(F.regexp_extract(p, "^[^=]*", 0)))),
        F.when(extension != "", F.array(F.concat(F.lit("extension "), plain(extension)))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("scheme "), F.lower(F.regexp_extract(url, "^[^:]*", 0)))),
    )
    return F.when(host != "", F.array_sort(F.array_distinct(found))).otherwise(F.array().cast("array<string>"))


def _counted(sets: DataFrame, least: int, max_tokens: int) -> DataFrame:
    """(needs, block, allow): counts of the token combinations that ``least`` urls of a verdict have.

    :param sets: columns items (sorted), label and n.
    """
    rows = sets.select("items", "label", "n", F.explode("items").alias("last")).withColumn("needs", F.array("last"))
    out = None
    for size in range(1, max_tokens + 1):
        of = lambda v: F.sum(F.when(F.col("label") == v, F.col("n")).otherwise(0)).alias(v)
        counts = rows.groupBy("needs").agg(of("block"), of("allow")).where(F.greatest("block", "allow") >= least)
        counts = saved(counts, f"combinations_{size}")
        out = counts if out is None else out.unionAll(counts)
        rows = rows.join(counts.select("needs"), "needs", "left_semi")
        more = F.explode(F.filter("items", lambda t: t > F.col("last")))
        rows = rows.select("items", "label", "n", "needs", more.alias("last")).withColumn("needs", F.concat("needs", F.array("last")))
    return out


def mine(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
    max_tokens: int = MAX_TOKENS, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(anchor, needs, verdict, confidence, support, name): rules from labelled urls.

    :param labelled: columns url and verdict (block or allow).
    """
    known = labelled.select("url", F.col("verdict").alias("label")).where(F.col("verdict").isin("block", "allow") & F.col("url").isNotNull())
    n = known.count()
    place = F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(1 << 30)) / float(1 << 30)
    known = known.where(place < min(1.0, sample_rows / max(1, n)))
    own = tokens(F.col("url"), *host_and_path(F.col("url")))
    sets = saved(known.select(own.alias("own"), "label").where(F.size("own") > 0).groupBy("own", "label").agg(F.count("*").alias("n")), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    least = max(1, math.ceil(min_support * total))
    counts = sets.select(F.explode("own").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("freq")).where(F.col("freq") >= least)
    counts = saved(counts, "tokens")  # at most a url's tokens / min_support
    frequent = sets.select("own", "label", "n", F.explode("own").alias("token")).join(F.broadcast(counts.select("token")), "token")
    items = frequent.groupBy("own", "label", "n").agg(F.array_sort(F.collect_list("token")).alias("items")).select("items", "label", "n")
    if (items.agg(F.max(F.size("items"))).first()[0] or 0) > GROWTH_TOKENS:
        merged = items.groupBy("items", "label").agg(F.sum("n").alias("n"))
        each = F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("hits")) for v in ("block", "allow")]))
        found = _counted(merged, least, max_tokens).select("needs", (F.col("block") + F.col("allow")).alias("fit"), each.alias("each"))
        rules = found.select(
            "needs", "each.verdict", (F.col("each.hits") / F.col("fit")).alias("confidence"), (F.col("each.hits") / F.lit(float(total))).alias("support"),
            F.col("each.hits").alias("hits"),
        ).where((F.col("hits") >= least) & (F.col("confidence") >= min_confidence)).drop("hits")
    else:
        baskets = known.select(F.concat(own, F.array(F.concat(F.lit("verdict "), "label"))).alias("items")).where(F.size("items") > 1)
        model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=12).fit(baskets)
        verdict = F.element_at("consequent", 1)
        rules = model.associationRules.where(
            verdict.startswith("verdict ") & (F.size("antecedent") <= max_tokens) & ~F.exists("antecedent", lambda t: t.startswith("verdict "))
        ).select(F.array_sort("antecedent").alias("needs"), F.substring(verdict, 9, 9).alias("verdict"), "confidence", "support")
    # A rule goes where a shorter one of the same verdict says as much: seen from its parts with one token left out.
    parts = rules.select("needs", "verdict", "confidence", F.explode("needs").alias("gone")).select(
        "needs", "verdict", "confidence", F.filter("needs", lambda t: t != F.col("gone")).alias("part")
    )
    shorter = rules.select(F.col("needs").alias("part"), "verdict", F.col("confidence").alias("as_sure"))
    idle = parts.join(shorter, ["part", "verdict"]).where("as_sure >= confidence").select("needs", "verdict").distinct()
    rules = rules.join(idle, ["needs", "verdict"], "left_anti")
    anchors = (
        rules.select("needs", "verdict", F.explode("needs").alias("token")).join(counts, "token")
        .groupBy("needs", "verdict").agg(F.min(F.struct("freq", "token"))["token"].alias("anchor"))
    )
    return rules.join(anchors, ["needs", "verdict"]).select(
        "anchor", "needs", "verdict", "confidence", "support", F.concat_ws(" & ", "needs").alias("name")
    )


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None,
    page_id: str = "page_id", url: str = "url", default: str = DEFAULT, **mining,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence) of every row.

    :param labelled: urls with their verdict to mine from; without it, the urls of
        ``pages`` that a fixed rule fits.
    """
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    split = source.select("page_id", "url", host.alias("host"), path.alias("path"))
    split = split.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = split.where("fixed is not null").select("url", F.col("fixed.verdict").alias("verdict"))
    mined = mine(labelled, **mining)
    # Verdicts are sought for distinct token sets, of which there are fewer than urls.
    own = F.when(F.col("fixed").isNull(), tokens(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>"))
    # A token set is named by two hashes, for a long url has many tokens.
    key = lambda: F.struct(F.xxhash64("own"), F.xxhash64(F.lit(1), "own"))
    split = split.withColumn("own", own).withColumn("key", key())
    sets = saved(split.where(F.size("own") > 0).select("key", "own").dropDuplicates(["key"]), "token_sets")
    found = sets.select("key", F.explode("own").alias("anchor")).join(mined, "anchor")
    fits = found.join(sets, "key").where(F.size(F.array_except("needs", "own")) == 0)
    order = F.struct("confidence", F.size("needs").alias("size"), "support", (F.col("verdict") == "block").alias("block"))
    best = fits.groupBy("key").agg(F.max(F.struct(order.alias("order"), "verdict", "name", "confidence")).alias("best"))
    # Written, so that the join deals both sides anew and a token set with many urls can be split.
    judged = split.drop("own").join(saved(best, "verdicts"), "key", "left")
    return judged.select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", "best.verdict", F.lit(default)).alias("verdict"),
        F.col("best.name").alias("mined_rule"), F.col("best.confidence").alias("confidence"),
    )
