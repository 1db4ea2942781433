"""Secret scans through a trigram inverted index.

The pattern of every rule gives a Boolean trigram query. The index has postings (trigram, row key) for the trigrams that
some query names; a rule's candidates are the keys that all trigrams of one of its alternatives share. Only candidates
are verified with the pattern itself. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.llm.common import text_or_empty
from pairmill.llm.trigrams import ANY, trigram_query
from pairmill.operators.columns import compute_once


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has at least ``least`` characters. The pattern must
    mean the same in Java and in Python and must not match the empty string."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# Fixed patterns of the base rules. A run of one character class that must have a length is written with that length,
# which gives the same matches as taking all runs and dropping the short ones.
BASE_RULES = (
    Rule(
        "assign",
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# What the index adds at no cost for other texts: well-known secrets with a fixed head.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
PLACEHOLDER = "[SECRET]"


def candidates(keyed: DataFrame, rules: Sequence[Rule], key: str = "__pm_key", text: str = "text") -> DataFrame:
    """(key, rules): names of the indexed rules whose trigram query a row fulfils. Rows without any are left out."""
    spark = keyed.sparkSession
    lines = [
        (rule.kind, f"{rule.kind}-{n}", gram, len(grams))
        for rule in rules
        for n, grams in enumerate(sorted(map(sorted, trigram_query(rule.pattern))))
        for gram in grams
    ]
    # As many rows as the rules have trigrams.
    wanted = spark.createDataFrame(lines, "rule string, part string, gram string, of long")
    grams = F.array(*(F.lit(g) for g in sorted({line[2] for line in lines})))
    folded = compute_once(keyed.select(key, text), __pm_low=F.lower(text_or_empty(text))).drop(text)
    present = F.filter(grams, lambda g: F.contains(F.col("__pm_low"), g))
    postings = folded.select(key, F.explode(present).alias("gram"))
    met = postings.join(F.broadcast(wanted), "gram").groupBy(key, "rule", "part", "of")
    whole = met.agg(F.count_distinct("gram").alias("n")).filter("n = of")
    return whole.groupBy(key).agg(F.collect_set("rule").alias("__pm_rules"))


def match_spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of all matches of a rule, leftmost and non-overlapping, without those that fail; in code points, the end
    exclusive. Splitting by the pattern gives the gaps, extraction the matches, and their lengths the places."""
    pattern = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"), value.alias("value"))
    span = "struct<start:int,order:int,kind:string,end:int>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.length(part["gap"])
        end = begin + F.length(part["found"])
        one = F.struct(
            begin.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end")
        )
        spans = F.when(F.length(part["value"]) >= rule.least, F.array_append(acc["spans"], one)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    none = F.array().cast(f"array<{span}>")
    return F.when(text.rlike(rule.pattern), F.aggregate(parts, start, step, lambda a: a["spans"])).otherwise(none)


def find_secrets(
    df: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES, text: str = "text", name: str = "spans"
) -> DataFrame:
    """Add the spans of all secrets, in order of start and then of rule: an array of (start, order, kind, end).

    NULL and empty texts have none. Rows stay as they are, repeated ones too; other columns pass through, one called
    ``name`` is replaced. One exchange of the table, by a hash of all its columns.
    """
    indexed = [r for r in rules if trigram_query(r.pattern) != ANY]
    # Two rows of one key only share their candidates, and verification decides.
    columns = [F.col(c) for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    keyed = df.withColumn("__pm_key", F.xxhash64(*columns))
    joined = keyed.join(candidates(keyed, indexed, "__pm_key", text), "__pm_key", "left") if indexed else keyed
    found = []
    for order, rule in enumerate(rules):
        spans = match_spans(text_or_empty(text), rule, order)
        if rule in indexed:
            met = F.coalesce(F.array_contains("__pm_rules", rule.kind), F.lit(False))
            spans = F.when(met, spans).otherwise(F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>"))
        found.append(spans)
    spans = F.array_sort(F.flatten(F.array(*found)))
    return compute_once(joined, **{name: spans}).drop("__pm_key", "__pm_rules")


def span_list(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def redact(text: Column, spans: Column, placeholder: str = PLACEHOLDER) -> Column:
    """The text with each span, or chain of overlapping spans, replaced."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], between, F.lit(placeholder))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    rest = F.aggregate(
        spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
    )
    return F.when(F.size(spans) > 0, rest).otherwise(text)
