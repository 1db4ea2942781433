"""URL filtering by association rules.

FP-growth mines combinations of URL tokens that go with the label ``bad``; rules of enough support and confidence stay.
They are matched by an inverted index: each rule is posted under its rarest token, a URL looks up its tokens there, and
a posting counts if the URL holds all tokens of the rule. Every distinct URL is judged once. Fixed rules on host and
path come before mined ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD = "#bad"
# Fixed rules of the public contract: verdict, host, path.
BASE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next of ``/ ? #``, A-Z in lower case; '' for NULL or without ``://``."""
    rest = _after_scheme(url)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to ``?`` or ``#``; '' for NULL or without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def base_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = BASE_RULES) -> Column:
    """(rule, verdict) of the longest fixed rule that fits, else NULL. A rule fits its host and all subdomains if the
    path starts with the rule's; of two rules the one with more characters in host and path is the longer."""
    choice = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        choice = F.when(fits, found) if choice is None else choice.when(fits, found)
    return choice


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: labels and parts of labels of the host, words of the path, names of the query. Numbers
    are left out. Each carries its place."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([A-Za-z_]+)="), F.lit(1))
    labels = F.concat(F.split(host, r"\."), F.split(host, r"[.-]"))

    def placed(tokens: Column, place: str) -> Column:
        kept = F.filter(tokens, lambda t: t.rlike(r"[A-Za-z]"))
        return F.transform(kept, lambda t: F.concat(F.lit(place), t))

    parts = F.concat(placed(labels, "h:"), placed(F.split(F.lower(path), r"[/._-]+"), "p:"), placed(query, "q:"))
    return F.array_distinct(parts)


def mine_rules(
    labelled: DataFrame, url: str = "url", bad: str = "bad", support: float = 0.002, rows: int = 30,
    confidence: float = 0.7, max_tokens: int = 4,
) -> DataFrame:
    """(tokens, confidence, support, n_tokens) of the rules "these tokens, hence bad". ``labelled`` has one row per
    labelled URL; rows whose label is NULL are left out. A rule needs ``support`` as a share of the labelled rows and at
    least ``rows`` of them."""
    known = labelled.filter(F.col(bad).isNotNull()).select(url_tokens(F.col(url)).alias("items"), F.col(bad).alias("_bad"))
    known = known.select(F.when(F.col("_bad"), F.array_append("items", BAD)).otherwise(F.col("items")).alias("items"))
    least = min(1.0, max(support, rows / max(1, known.count())))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(known)
    rules = model.associationRules.filter(
        (F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.size("antecedent") <= max_tokens)
    )
    return rules.select(
        F.array_sort("antecedent").alias("tokens"), "confidence", "support", F.size("antecedent").alias("n_tokens")
    )


def match_rules(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(url, confidence, tokens): each distinct URL that a rule fits, with its best rule (highest confidence, then most
    tokens, then first by tokens)."""
    # Tokens of all rules with the number of rules that hold them: the rarest one of a rule is its place in the index.
    spread = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    placed = rules.select("tokens", "confidence", "n_tokens", F.explode("tokens").alias("token")).join(spread, "token")
    index = placed.groupBy("tokens", "confidence", "n_tokens").agg(F.min(F.struct("n", "token")).alias("rarest"))
    index = index.select(F.col("rarest.token").alias("token"), "tokens", "confidence", "n_tokens")
    distinct = urls.select(url).filter(F.col(url).isNotNull()).distinct()
    looked = distinct.select(url, url_tokens(F.col(url)).alias("_has")).withColumn("token", F.explode("_has"))
    hits = looked.join(index, "token").filter(F.size(F.array_except("tokens", "_has")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("n_tokens")).alias("n"), F.col("tokens")))
    return hits.groupBy(url).agg(best.alias("best")).select(
        url, (-F.col("best.c")).alias("confidence"), F.col("best.tokens").alias("tokens")
    )


def filter_urls(pages: DataFrame, labelled: DataFrame, url: str = "url", **mining) -> DataFrame:
    """Add host, path, rule, verdict and ``mined`` (tokens of the mined rule that fits, else NULL).

    The verdict is that of the fixed rule; without one, ``block`` if a mined rule fits, else ``allow``. NULL URLs and
    such without ``://`` have empty host and path and are allowed. Repeated rows stay. Columns of these names are
    replaced. Fits the rules when called.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "mined")
    found = match_rules(pages, mine_rules(labelled, **mining), url).select(url, F.col("tokens").alias("mined"))
    judged = pages.join(found, url, "left")
    judged = judged.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    judged = judged.withColumn("__pm_base", base_rule(F.col("host"), F.col("path")))
    mined = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return judged.withColumns(
        {"rule": F.col("__pm_base.rule"), "verdict": F.coalesce(F.col("__pm_base.verdict"), mined)}
    ).drop("__pm_base")
