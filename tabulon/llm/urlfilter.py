"""URL filters: fixed rules first, then association rules, with DataFrame functions only.

Tokens of a URL are its host's labels, its path's segments, the extension and the query's keys, with digits as one
sign. Spark's FP-growth mines combinations of tokens and label over labelled pages; a combination with the label
``block`` that holds often enough (support) and reliably enough (confidence) becomes a rule, unless a rule with fewer
tokens is as reliable. An inverted index has each rule under its rarest token: a page's tokens look up the rules, and
a rule matches if all its tokens are there. A page that no rule matches is allowed.

At most ``SAMPLE`` labelled pages are mined, taken by a hash of the id, each with all its tokens. Tokens that are rarer
among pages labelled bad than the support are in no rule and are left out. Tokens that the same labelled pages have, as
the keys of one form of query, are mined as one: a rule with two of them says no more than with either, so each rule
stands for those with another of the same pages' tokens in its place. The support bounds the number of rules; it is
that of ``LEAST`` bad pages at least, as fewer prove nothing.

Nulls: a null url, or one without ``://``, has empty host and path and no tokens, and is allowed. Labels that are null
are not mined. Repeated rows are judged alike. An empty table gives no row; without labels there are no rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import persist

#: Verdict, host and path of the rules that come before the method's.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SAMPLE = 200_000
MIN_SUPPORT, MIN_CONFIDENCE, LEAST = 0.002, 0.5, 5
BLOCK = "=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens, sorted; null and relative URLs have none."""
    plain = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    labels = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("h:"), plain(x)))
    parts = F.transform(F.split(path_of(url), "/"), lambda x: F.concat(F.lit("p:"), plain(F.regexp_replace(x, r"\.[A-Za-z0-9]+$", ""))))
    ending = F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]+)$", 1)
    query = F.regexp_extract(_rest(url), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), plain(F.substring_index(x, "=", 1))))
    every = F.concat(labels, parts, F.array(F.concat(F.lit("e:"), ending)), keys)
    found = F.array_sort(F.array_distinct(F.filter(every, lambda x: F.length(x) > 2)))
    return F.coalesce(found, F.array().cast("array<string>"))


def fixed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fixed rule that fits, as ``host + path``, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def mine(pages: DataFrame, labels: DataFrame, sample: int = SAMPLE, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, least: int = LEAST) -> DataFrame:
    """Rules ``(tokens, support, confidence)``; labels speak of the page whose id is their doc_id, 0 in ``quality`` is bad."""
    some = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    known = pages.join(some, pages.page_id == some.doc_id).select(tokens_of(F.col("url")).alias("tokens"), "quality").where(F.size("tokens") > 0)
    known = persist(known.withColumn("row", F.monotonically_increasing_id()), "labelled")
    total = known.count()
    if not total:
        return known.select("tokens", F.lit(0.0).alias("support"), F.lit(0.0).alias("confidence"))
    min_support = max(min_support, min(1.0, least / total))
    each = known.select("row", "quality", F.explode("tokens").alias("token"))
    same = F.struct(*(F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"x{i}") for i in (0, 1)), F.count(F.lit(1)).alias("n"))
    often = each.groupBy("token").agg(F.count(F.when(F.col("quality") == 0, 1)).alias("bad"), same.alias("same")).where(F.col("bad") >= min_support * total)
    classes = persist(often.groupBy("same").agg(F.min("token").alias("token"), F.collect_list("token").alias("members")), "classes")
    mined = each.join(classes, "token").groupBy("row").agg(F.collect_list("token").alias("items"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    baskets = persist(known.join(mined, "row", "left").select(F.when(F.col("quality") == 0, F.array_append(items, F.lit(BLOCK))).otherwise(items).alias("items")), "baskets")
    sets = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets).freqItemsets
    sets = persist(sets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    blocked = sets.where(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("items"), F.col("freq").alias("both"))
    rules = blocked.join(sets, "items").select(F.col("items").alias("tokens"), (F.col("both") / total).alias("support"), (F.col("both") / F.col("freq")).alias("confidence"))
    rules = persist(rules.where(F.col("confidence") >= min_confidence), "rules")
    # a rule is dropped if leaving out one of its tokens gives a rule that is as reliable
    fewer = rules.where(F.size("tokens") > 1).select("tokens", "confidence", F.explode("tokens").alias("out")).select("tokens", "confidence", F.array_remove("tokens", F.col("out")).alias("less"))
    general = rules.select(F.col("tokens").alias("less"), F.col("confidence").alias("other"))
    idle = fewer.join(general, "less").where("other >= confidence").select("tokens").distinct()
    rules = rules.join(idle, "tokens", "left_anti")
    # a rule for each choice of one of the tokens that its own stand for
    split = rules.withColumn("token", F.explode("tokens")).join(classes.select("token", "members"), "token")
    split = split.groupBy("tokens", "support", "confidence").agg(F.collect_list("members").alias("choices"))
    start = F.array(F.array().cast("array<string>"))
    every = F.aggregate("choices", start, lambda done, some: F.flatten(F.transform(done, lambda d: F.transform(some, lambda t: F.array_append(d, t)))))
    return split.select(F.explode(every).alias("tokens"), "support", "confidence").withColumn("tokens", F.array_sort("tokens"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(url, tokens)`` that some rule matches, with the best confidence."""
    uses = rules.select(F.explode("tokens").alias("token")).groupBy("token").count()
    rare = rules.withColumn("token", F.explode("tokens")).join(uses, "token").groupBy("tokens", "confidence").agg(F.min(F.struct("count", "token")).alias("rare"))
    index = rare.select(F.col("rare.token").alias("token"), F.col("tokens").alias("needed"), "confidence")
    looked = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return looked.where(F.size(F.array_except("needed", "tokens")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``pages(page_id, url)`` to ``(page_id, url, host, path, rule, verdict, confidence)``."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = rows.where("url is not null").select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
    bad = matched(urls, mine(rows, labels, **options))
    rows = rows.join(bad, "url", "left").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    own = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return rows.select("page_id", "url", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "confidence")
