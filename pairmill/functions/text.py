"""Text functions as native column expressions.

Whitespace means Unicode whitespace plus the four separators U+001C..U+001F everywhere, so word
counts and trimming agree with Python's ``str`` methods. Java's ``\\s`` is ASCII only without the flag (?U).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------
# Whitespace, as the inside of a character class of a pattern with the flag (?U).
WS = r"\s\x1c\x1d\x1e\x1f"
# The same whitespace characters one by one, for trimming.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Wiki markup removal: (pattern, replacement) in order of application. (?s): dot matches newlines,
# (?md): line anchors at \n only.
WIKI_MARKUP = (
    (r"__[A-Z]+__", ""),
    (r"\{\{[^}]*\}\}", ""),
    (r"(?s)\{\|.*?\|\}", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"),
    (rf"(?U)\[https?://[^{WS}]+[{WS}]+([^\]]+)\]", "$1"),
    (rf"(?U)\[https?://[^{WS}]+\]", ""),
    (r"={2,}[^=]+=+", ""),
    (r"(?md)^\|.*$", ""),
    (rf"(?mdU)^[*#:;]+[{WS}]*$", ""),
)

# Removal for every source: tags, lower-case named entities, addresses, whitespace runs.
COMMON_MARKUP = (
    (r"<[^>]+>", ""),
    (r"&[a-z]+;", " "),
    (rf"(?U)https?://[^{WS}]+", ""),
    (rf"(?U)[{WS}]+", " "),
)

# Sources whose text carries wiki markup.
MARKUP_SOURCES = ("kk_wikipedia",)

# Punctuation that ends a sentence in lead extraction.
LEAD_STOPS = ".!?»"

# 13a tokenization of the public BLEU tool: entity replacements, then spacing rules. The first rule of the tool also puts
# blanks around blanks, which changes no token and is left out.
BLEU_ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
BLEU_SPACING = (
    (r"([{|}~\[\\\]^_`!\"#$%&()*+:;<=>?@/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
# ----------------------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _replace_all(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(replacement))
    return c


def strip(c: Column | str) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def words(c: Column | str) -> Column:
    """Whitespace-separated words."""
    # Splitting at whitespace is several times faster in Java than collecting runs of a negated class.
    return F.array_remove(F.split(_col(c), rf"(?U)[{WS}]+"), "")


def word_count(c: Column | str) -> Column:
    """Number of whitespace-separated words; '' has none, NULL stays NULL."""
    return F.array_size(words(c))


def spaced_word_count(c: Column | str) -> Column:
    """``word_count`` for text whose only whitespace is single inner spaces, without a regex."""
    c = _col(c)
    return F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def strip_wiki_markup(c: Column | str) -> Column:
    return _replace_all(_col(c), WIKI_MARKUP)


def clean_common(c: Column | str) -> Column:
    # After the last rule a plain space is the only whitespace left, so trim() is enough.
    return F.trim(_replace_all(_col(c), COMMON_MARKUP))


def clean_text(
    text: Column | str, source: Column | str | None = None, markup_sources: Sequence[str] = MARKUP_SOURCES
) -> Column:
    """Cleaned text: wiki markup removed for markup sources, common removal for all; NULL gives ''."""
    text = F.coalesce(_col(text), F.lit(""))
    if source is not None and markup_sources:
        is_markup = F.coalesce(_col(source).isin(*markup_sources), F.lit(False))
        text = F.when(is_markup, strip_wiki_markup(text)).otherwise(text)
    return clean_common(text)


def extract_lead(c: Column | str, n: int = 3, min_words: int = 5) -> Column:
    """The first ``n`` sentences of at least ``min_words`` words, joined by a space.

    Sentences end after one of ``. ! ? »`` that is followed by whitespace. Too short sentences are
    passed over, so the kept ones need not be neighbours.
    """
    pieces = F.split(strip(F.coalesce(_col(c), F.lit(""))), rf"(?U)(?<=[{LEAD_STOPS}])[{WS}]+")
    return F.array_join(F.slice(F.filter(pieces, lambda s: word_count(s) >= min_words), 1, n), " ")


def get_lead(c: Column | str, max_chars: int = 300) -> Column:
    """Leading sentences within a budget of ``max_chars`` characters.

    ``! ?`` count as dots. A piece is taken while result length plus raw piece length stays below the
    budget, and is added as the stripped piece plus ``'. '``; the first piece that does not fit ends the
    lead (an over-long first sentence gives ''). The empty piece after a final dot counts.

    Every taken piece adds at least two characters, hence at most ``max_chars / 2`` pieces can be taken;
    the rest of the text stays in one unsplit tail piece that cannot fit any more. This bound is exact.
    """
    most = max_chars // 2 + 1
    pieces = F.slice(F.split(_col(c), "[.!?]", most + 1), 1, most)
    start = F.struct(F.lit("").alias("lead"), F.lit(False).alias("full"))

    def take(acc: Column, piece: Column) -> Column:
        fits = ~acc["full"] & (F.length(acc["lead"]) + F.length(piece) < max_chars)
        return F.struct(
            F.when(fits, F.concat(acc["lead"], strip(piece), F.lit(". "))).otherwise(acc["lead"]).alias("lead"),
            (~fits).alias("full"),
        )

    return strip(F.aggregate(pieces, start, take, lambda acc: acc["lead"]))


def summary_sentences(c: Column | str, min_chars: int = 20) -> Column:
    """Stripped pieces between ``. ! ?`` that are longer than ``min_chars`` characters."""
    pieces = F.split(F.coalesce(_col(c), F.lit("")), "[.!?]", -1)
    return F.filter(F.transform(pieces, strip), lambda s: F.length(s) > min_chars)


def term_tokens(c: Column | str) -> Column:
    """Lower-cased runs of at least two word characters (letters, digits, underscore of any script)."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def rouge_tokens(c: Column | str, tokenizer: str = "ascii") -> Column:
    """ROUGE tokens. ``ascii`` keeps a-z and 0-9 only, as published ROUGE figures do, and so drops
    Cyrillic words; ``unicode`` keeps letters and digits of any script."""
    pattern = {"ascii": r"[a-z0-9]+", "unicode": r"[\p{L}\p{N}]+"}[tokenizer]
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(pattern), F.lit(0))


def bleu_tokens(c: Column | str) -> Column:
    """13a tokens."""
    c = F.rtrim(_col(c), F.lit(WS_CHARS))
    c = F.replace(c, F.lit("<skipped>"), F.lit(""))
    c = F.replace(F.replace(c, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for entity, char in BLEU_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    spaced = _replace_all(F.concat(F.lit(" "), c, F.lit(" ")), BLEU_SPACING[:-1])
    # Few texts have the dash of the last rule, and looking for it takes no pattern.
    return words(F.when(F.contains(spaced, F.lit("-")), _replace_all(spaced, BLEU_SPACING[-1:])).otherwise(spaced))


def squeezed(c: Column | str) -> Column:
    """The text without any whitespace, as chrF reads it."""
    return F.regexp_replace(_col(c), rf"(?U)[{WS}]+", "")


def word_ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by a space (tokens hold none)."""
    if n == 1:
        return tokens
    count = F.size(tokens) - (n - 1)
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def first_nonempty(*cols: Column) -> Column:
    """The first value that is neither NULL nor '', else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols), F.lit(""))


def seeded_key(id_col: Column | str, seed: int = 42) -> Column:
    """A hash that orders rows at random, the same in every run: md5 of seed and id."""
    return F.md5(F.concat(F.lit(str(seed)), _col(id_col).cast("string")).cast("binary"))
