"""Verdicts on urls: fixed rules first, then association rules mined from labels.

Only DataFrame functions and Spark's FP-growth; no Python code runs on rows.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Smallest share and number of labelled urls with a combination, and the smallest share of them
# that are labelled block, for a combination to become a rule.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.001, 20, 0.7
BLOCK = "label:block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return (F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase),
                       F.lit("")), F.coalesce(path, F.lit("")))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct of rule and verdict of the longest rule (verdict, host/path) that fits."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest goes outermost
        of, _, start = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"),
                                      F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct parts of a url that can recur: every domain it belongs to, host words, path
    words, file type, names of query keys, scheme. Numbers are left out, as they are ids."""
    def tagged(tag: str, parts: Column) -> Column:
        words = F.filter(parts, lambda p: p.rlike(r"\p{L}"))
        return F.transform(words, lambda p: F.concat(F.lit(tag + ":"), p))

    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    return F.array_distinct(F.concat(
        tagged("domain", domains), tagged("host", F.split(host, r"[.\-_]")),
        tagged("path", F.split(F.lower(path), r"[/.\-_]")),
        tagged("type", F.array(F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1))),
        tagged("key", keys), tagged("scheme", F.array(F.lower(F.substring_index(url, "://", 1))))))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule_tokens, confidence, support) of the combinations that mean block.

    `labelled` has tokens and blocked. Rules that a rule of fewer tokens already covers with at
    least the same confidence are redundant, but change no verdict, so they may stay.
    """
    spark = labelled.sparkSession
    baskets = written(labelled.select(F.when(
        F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(
            F.col("tokens")).alias("items")), "url-baskets")
    rows = baskets.count()
    support = max(min_support, min_count / rows if rows else 1.0)
    schema = "rule_tokens array<string>, confidence double, support double"
    if support > 1:  # too few labelled urls for any rule
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    return model.associationRules.filter(F.col("consequent") == F.array(F.lit(BLOCK))).select(
        F.col("antecedent").alias("rule_tokens"), "confidence", "support")


def matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct `tokens` of `pages` that hold all tokens of a rule, with the best rule.

    The inverted index lists each rule under its rarest token, so a url meets few rules.
    """
    distinct = written(pages.select("tokens").distinct(), "url-tokens")
    ranked = rules.withColumn("rule", F.sha2(F.array_join(F.array_sort("rule_tokens"), " "), 256))
    frequency = (distinct.select(F.explode("tokens").alias("token")).groupBy("token")
                 .agg(F.count(F.lit(1)).alias("n")))
    index = (ranked.select("*", F.explode("rule_tokens").alias("token"))
             .join(frequency, "token").groupBy("rule")
             .agg(F.min_by("token", F.struct("n", "token")).alias("token"),
                  F.first("rule_tokens").alias("rule_tokens"),
                  F.max(F.struct("confidence", "support")).alias("proof")))
    candidates = (distinct.select("tokens", F.explode("tokens").alias("token"))
                  .join(index, "token")
                  .filter(F.size(F.array_except("rule_tokens", "tokens")) == 0))
    best = F.struct("proof.confidence", "proof.support", F.array_sort("rule_tokens").alias("rule_tokens"))
    return candidates.groupBy("tokens").agg(F.max(best).alias("match"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]],
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, match) per row of `pages`.

    `rules` are (allow or block, "host/path"); the longest that fits decides. For other urls
    the verdict is block if they hold a mined combination, else allow; match tells which.
    `labels` (id, blocked) teach the combinations; a null in either column is no label, of
    several labels for an id one that blocks wins. Null or malformed urls have an empty host
    and path and no tokens but their scheme, if any. Rows with a null or repeated id are judged
    like any other; an empty table gives no rows. Only the two columns are read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select(
        "page_id", host.alias("host"), path.alias("path"),
        F.coalesce(tokens(F.col("url"), host, path), F.array().cast("array<string>"))
        .alias("tokens"))
    known = (labels.select(F.col("id").alias("page_id"), "blocked")
             .filter("page_id IS NOT NULL AND blocked IS NOT NULL")
             .groupBy("page_id").agg(F.max("blocked").alias("blocked")))
    mined = mine_rules(rows.filter(F.size("tokens") > 0).join(known, "page_id")
                       .select("tokens", "blocked"))
    found = matches(rows, written(mined, "url-rules"))
    fixed = fitting_rule(F.col("host"), F.col("path"), rules)
    return rows.join(found, "tokens", "left").withColumn("fixed", fixed).select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", F.when(F.col("match").isNotNull(), "block")
                   .otherwise("allow")).alias("verdict"), "match")
