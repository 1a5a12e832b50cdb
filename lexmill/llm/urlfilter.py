"""URL filtering by rules given and rules mined, with DataFrame operations alone.

A given rule is a host and a path prefix with a verdict; the longest that fits a URL decides. Where
none fits, association rules decide: FP-growth mines combinations of URL tokens that go with a
verdict in labelled URLs, rules are pruned by support and confidence, found for a URL through an
inverted index under their rarest token, and the one of highest confidence wins.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import temporary, written

ALLOW, BLOCK = "allow", "block"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty if there is no host's place."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def table_of(spark: SparkSession, rules: dict[str, str]) -> DataFrame:
    """rule, verdict, own (host), start (path) of given rules."""
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("own"), F.lit("/" + r.partition("/")[2]).alias("start")) for r, v in rules.items()]
    out = spark.range(0).select(F.lit("").alias("rule"), F.lit("").alias("verdict"), F.lit("").alias("own"), F.lit("").alias("start"))
    for k in range(0, len(rows), 500):
        out = out.unionByName(spark.range(1).select(F.inline(F.array(*rows[k : k + 500]))))
    return out


def given(urls: DataFrame, rules: DataFrame, depth: int) -> DataFrame:
    """urls (host, path) with rule and by_rule, the longest of rules (see table_of) that fits and its verdict, else nulls.

    A rule fits its host and every subdomain, if the path starts with the rule's. An empty path of a
    URL counts as it stands: it starts with nothing but an empty path. Each host is joined with the rules of its domains
    of up to depth labels (no rule has more) once; ties in length go to the last by name.
    """
    hosts = urls.select("host").distinct()
    labels = F.slice(F.reverse(F.split("host", r"\.", -1)), 1, depth)
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.reverse(F.slice(labels, 1, k)), "."))
    fits = hosts.select("host", F.explode(ends).alias("own")).join(rules, "own")
    fits = fits.groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "verdict", "start")).alias("fits"))
    # Written before it is joined: Spark can split a frequent host's rows only in a join of plain shuffles.
    fits = written(fits.withColumnRenamed("host", "fits_host"), "host-rules")
    best = F.array_max(F.filter("fits", lambda r: F.startswith(F.col("path"), r["start"])))
    return urls.join(fits, F.col("host") == F.col("fits_host"), "left").withColumn("best", best).withColumns({"rule": F.col("best.rule"), "by_rule": F.col("best.verdict")}).drop("fits_host", "fits", "best")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: labels of its host, its top levels, the words of its path and of its query's names, how it ends."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & ~x.rlike(r"^\p{N}+$"))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), F.lower)
    parts = F.flatten(F.transform(labels, lambda x: F.filter(F.split(x, "-"), lambda y: y != "")))
    kinds = [
        F.transform(labels, lambda x: F.concat(F.lit("label:"), x)),
        F.when(F.size(labels) > 0, F.array(F.concat(F.lit("top:"), F.element_at(F.concat(labels, F.array(F.lit(""))), F.greatest(F.size(labels), F.lit(1)))))).otherwise(F.array().cast("array<string>")),
        F.transform(F.when(F.size(parts) > F.size(labels), parts).otherwise(F.array().cast("array<string>")), lambda x: F.concat(F.lit("part:"), x)),
        F.transform(words, lambda x: F.concat(F.lit("path:"), x)),
        F.transform(names, lambda x: F.concat(F.lit("query:"), x)),
    ]
    return F.array_distinct(F.concat(*kinds))


def classes(rows: DataFrame, least: int) -> DataFrame:
    """The tokens (token, item) of least rows or more: those that have the same rows are one item, or each set of them would be mined for itself.

    rows: items and verdict, n times each.
    """
    each = rows.select("n", F.xxhash64("items").alias("h"), F.xxhash64(F.lit(1), "items").alias("g"), F.explode("items").alias("token"))
    # What rows a token has, told by sums of their hashes.
    mark = [F.sum(F.col(c).cast("decimal(20)")).alias(c) for c in ("h", "g")]
    tokens = each.groupBy("token").agg(F.sum("n").alias("n"), *mark).where(F.col("n") >= least)
    return tokens.groupBy("n", "h", "g").agg(F.collect_list("token").alias("tokens"), F.min("token").alias("item")).select(F.explode("tokens").alias("token"), "item")


def mine(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_id, items, size, verdict, confidence, support) from labelled (items, verdict), and names (token, item): a URL that has a token has the item.

    FP-growth runs over every labelled row; all rules are its own. One is kept if no rule of the same verdict with a part
    of its items is as confident: the longer says nothing more. Null verdicts count for nothing; without
    labelled rows there are no rules.
    """
    verdicts = [ALLOW, BLOCK]
    marks = [f"verdict:{v}" for v in verdicts]
    rows = labelled.where(F.col("verdict").isin(verdicts)).groupBy(F.array_sort("items").alias("items"), "verdict").agg(F.count("*").alias("n"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "labelled")
    total = rows.agg(F.sum("n")).first()[0] or 0
    names = written(classes(rows, max(1, math.ceil(min_support * total - 1e-9))), "items")
    # A row's items, and how often it is there: rows without any count for the supports still.
    item = rows.select("row", F.explode("items").alias("token")).join(names, "token").groupBy("row").agg(F.collect_set("item").alias("own"))
    basket = F.concat(F.coalesce("own", F.array().cast("array<string>")), F.array(F.concat(F.lit("verdict:"), F.col("verdict"))))
    baskets = rows.join(item, "row", "left").groupBy(F.array_sort(basket).alias("items")).agg(F.sum("n").alias("n"))
    baskets = baskets.select("items", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).select("items")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent")[0].isin(marks) & ~F.arrays_overlap("antecedent", F.lit(marks)))
    rules = written(found.select(F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], 9, 10).alias("verdict"), "confidence", "support"), "rules")
    # A rule's parts lie within it: they are met under their own rarest item.
    part = rarest(rules).select("token", F.col("items").alias("part"), F.col("verdict").alias("part_verdict"), F.col("confidence").alias("part_confidence"))
    parts = rules.select("items", "verdict", "confidence", F.explode("items").alias("token")).join(part, "token")
    covered = parts.where((F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0) & (F.col("verdict") == F.col("part_verdict")) & (F.col("part_confidence") >= F.col("confidence"))).select("items", "verdict").distinct()
    kept = rules.join(covered, ["items", "verdict"], "left_anti")
    kept = written(kept.select(F.concat_ws(" ", F.col("verdict"), F.array_join("items", " ")).alias("rule_id"), "items", F.size("items").alias("size"), "verdict", "confidence", "support"), "rules")
    return kept, names


def rarest(rules: DataFrame) -> DataFrame:
    """rules with token: the rarest of their items among all rules, so that an item of nearly every rule indexes few."""
    numbered = rules.withColumn("row", F.monotonically_increasing_id())
    spread = rules.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    own = numbered.select("row", F.explode("items").alias("token")).join(spread, "token").groupBy("row").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return numbered.join(own, "row").drop("row")


def match(urls: DataFrame, rules: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """items and the verdict of the best rule for each distinct token set in urls (items); sets that no rule fits are left out.

    names: which tokens stand for which items of rules; other tokens stand for themselves. Best: highest confidence,
    then support, then the more specific, then by name.
    """
    sets = urls.select("items").distinct()
    tokens = sets.select("items", F.explode("items").alias("token"))
    if names is not None:
        tokens = tokens.join(names, "token", "left").withColumn("token", F.coalesce("item", "token")).drop("item").distinct()
    index = rarest(rules).select("token", F.col("items").alias("rule_items"), "verdict", F.struct("confidence", "support", "size", "rule_id").alias("rank"))
    # Written: Spark knows its size, and sends it to the workers only if it is small.
    index = written(index, "rule-index")
    spread = rules.select(F.explode("items").alias("token")).distinct()
    # The items of a set, as far as rules have them, then the rules under each of these.
    known = tokens.join(spread, "token", "left_semi").groupBy("items").agg(F.collect_set("token").alias("own"))
    hits = known.select("items", "own", F.explode("own").alias("token")).join(index, "token").where(F.size(F.array_except("rule_items", "own")) == 0)
    return hits.groupBy("items").agg(F.max_by("verdict", "rank").alias("mined"))


def judge(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None, default: str = ALLOW, min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    rules: given rules with their verdicts. Mined rules are learned from the URLs that a given rule
    decides and, if given, from labels (url, verdict); they decide the others, default where none fits.
    Null urls and urls without :// have an empty host and path, and so the default. Repeated rows are
    judged alike; an empty table gives no rows; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))

    def split(df: DataFrame) -> DataFrame:
        df = df.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
        return df.withColumn("items", tokens(F.col("url"), F.col("host"), F.col("path")))

    spark = pages.sparkSession
    with temporary(spark) as scope:
        rows = written(given(split(rows), table_of(spark, rules), max((r.partition("/")[0].count(".") + 1 for r in rules), default=1)).select("page_id", "host", "path", "items", "rule", "by_rule"), "urls")
        learn = rows.where("rule is not null").select("items", F.col("by_rule").alias("verdict"))
        if labels is not None:
            learn = learn.unionByName(split(labels.select("url", "verdict")).select("items", "verdict"))
        # Written before it is joined: Spark can split a frequent token set's rows only in a join of plain shuffles.
        mined = written(match(rows.where("rule is null"), *mine(learn, min_support, min_confidence)), "mined")
        scope.keep(rows, mined)
    out = rows.join(mined, "items", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "mined", F.lit(default)).alias("verdict"))
