"""URL filtering by explicit rules and mined association rules.

An explicit rule names a host and a path prefix. URLs that none fits are judged
by rules mined with FP-growth from labelled URLs: combinations of tokens that
imply an unwanted label with enough support and confidence. Mined rules are
matched by an inverted index from token to rule.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: (verdict, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
#: Unwanted labelled urls that a rule needs: of some 2000 frequent sets, with a quarter
#: of the labels unwanted, about ten reach the confidence by chance with five.
LEAST_ROWS = 20
BLOCK_ITEM = "label=block"
#: Mined rules are broadcast up to this many index rows, and shuffled beyond.
BROADCAST_ROWS = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path:
    from there up to ?, # or the end. Both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def explicit_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path words and query keys, marked by place;
    words without a letter are left out."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)

    def marked(words: Column, mark: str) -> Column:
        return F.transform(F.filter(words, lambda w: w.rlike("[^0-9]")), lambda w: F.concat(F.lit(mark), w))

    keys = F.transform(F.split(query, "&"), lambda kv: F.regexp_extract(kv, r"^[^=]*", 0))
    return F.array_distinct(F.concat(marked(F.split(host, r"\."), "h:"), marked(F.split(ascii_lower(path), r"[^\p{L}\p{N}]+"), "p:"), marked(keys, "q:")))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """labelled(url, blocked) to (rule_id, tokens, confidence, support): token sets
    that imply blocked. A rule is left out if a part of it is as confident. Null
    urls and labels don't count. The number of frequent sets, and so of rules, is
    bounded by the support."""
    items = F.array_union(url_tokens(F.col("url")), F.when(F.col("blocked"), F.array(F.lit(BLOCK_ITEM))).otherwise(F.array().cast("array<string>")))
    baskets = materialize(labelled.where("url is not null and blocked is not null").select(items.alias("items")), "baskets")
    n = baskets.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double")
    # support in rows: never below LEAST_ROWS, or chance sets pass
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min(1.0, LEAST_ROWS / n)), minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BLOCK_ITEM))
    found = materialize(found.select(F.xxhash64(F.array_sort("antecedent")).alias("rule_id"), F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "rules")
    # a redundant rule shares a token with the part that makes it so
    parts = found.select(F.col("rule_id").alias("part"), F.col("tokens").alias("few"), F.col("confidence").alias("sure"), F.explode("tokens").alias("token"))
    wholes = found.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token"))
    covered = wholes.join(parts, "token").where((F.size("few") < F.size("tokens")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("few", "tokens")) == 0))
    return found.join(covered.select("rule_id").distinct(), "rule_id", "left_anti")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct tokens arrays of urls(tokens) that some rule is contained in:
    tokens lead to rules, and a rule holds where all of its tokens led to it."""
    index = materialize(rules.select("rule_id", F.size("tokens").alias("size"), F.explode("tokens").alias("token")), "index")
    small = index.count() <= BROADCAST_ROWS
    sets = urls.select("tokens").distinct()
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(F.broadcast(index) if small else index, "token")
    return hits.groupBy("tokens", "rule_id", "size").count().where("count = size").select("tokens").distinct()


def shown_document(url: Column) -> Column:
    """The id of the document that a page shows: the number that ends its path."""
    return F.regexp_extract(host_and_path(url)[1], r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1).try_cast("long")


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per row of pages(page_id, url): page_id, host, path, rule, verdict.

    labels(doc_id, quality, toxic) mark the pages that show a document as unwanted
    if its quality is 0 or toxic is 1; shown_document() tells which that is, and
    other pages aren't learnt from. A fitting explicit rule decides, the longest one; else a
    mined rule blocks; else the verdict is allow. Null urls and urls without ://
    have an empty host and path. Repeated or null page_ids do no harm; a
    document labelled twice is unwanted if either row says so. An empty pages table
    gives no rows, without labels only the explicit rules decide. Extra columns are
    ignored. Of rules of equal length that fit, which can only differ in host, the
    first in RULES wins.
    """
    host, path = host_and_path(F.col("url"))
    given = pages.select("page_id", F.col("url").cast("string").alias("url"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("shown")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("bad"))
    labelled = given.select("url", shown_document(F.col("url")).alias("shown")).join(marks, "shown").select("url", (F.col("bad") == 1).alias("blocked"))
    mined = materialize(mine_rules(labelled, min_support, min_confidence), "mined")
    parsed = given.select("page_id", "url", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("fit", explicit_rule(F.col("host"), F.col("path"), rules))
    if mined.isEmpty():
        return parsed.select("page_id", "host", "path", "fit.rule", F.coalesce("fit.verdict", F.lit("allow")).alias("verdict"))
    parsed = parsed.withColumn("tokens", F.coalesce(url_tokens(F.col("url")), F.array().cast("array<string>")))
    bad = matched(parsed.where("fit is null"), mined).withColumn("bad", F.lit(True))
    return parsed.join(bad, "tokens", "left").select(
        "page_id", "host", "path", "fit.rule", F.coalesce("fit.verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict")
    )
