"""Column functions over text: names, tokens, scores, hashes, page checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal suffixes that are cut from company names.
LEGAL_SUFFIXES = (
    "incorporated", "corporation", "international", "holdings", "technologies", "technology", "solutions", "pharmaceuticals", "financial",
    "services", "group", "limited", "enterprises", "partners", "associates", "inc", "corp", "ltd", "llc", "llp", "plc", "co", "sa", "ag",
    "nv", "bv", "se",
)
#: What navigation pages are full of.
NAVIGATION_MARKERS = (
    "skip to content", "home", "news", "sport", "business", "technology", "health", "culture", "travel", "audio", "video", "live", "weather",
    "newsletters", "share", "save",
)
#: Words of a question that say nothing of its subject.
QUESTION_STOP_WORDS = ("what", "when", "where", "which", "with", "from", "that", "this", "have")
#: White space at a text's ends.
ENDS = r"^\s+|\s+$"


def words(text: Column) -> Column:
    """Words between white space; none in a blank text."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def approx_tokens(text: Column) -> Column:
    """Words / 0.75, cut to an integer."""
    return (word_count(text) / F.lit(0.75)).cast("int")


def canonical_name(name: Column) -> Column:
    """Quotes dropped, anything but letters, digits, _, white space, & and - made a space, collapsed, lower-cased."""
    kept = F.regexp_replace(F.regexp_replace(name, "['`]", ""), r"(?U)[^\w\s&-]", " ")
    return F.lower(F.trim(F.regexp_replace(kept, r"\s+", " ")))


def strip_legal(name: Column, suffixes: Sequence[str] = LEGAL_SUFFIXES) -> Column:
    """Cuts legal suffixes, in any case and with the commas, points and spaces round them, off a name until none is left.

    A name of suffixes alone becomes empty.
    """
    cut = F.regexp_replace(name, rf"(?i)([\s,.]*\b({'|'.join(suffixes)})\b[\s.,]*)+$", "")
    return F.regexp_replace(cut, r"^\s+|[\s.,]+$", "")


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")


#: A word of near-duplicate removal, in lower-cased text.
DEDUP_TOKEN = r"[a-z0-9$_.-]+"


def dedup_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(DEDUP_TOKEN), F.lit(0))


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur as substrings of the lower-cased text."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))


def macro_score(text: Column, hard: Sequence[str], directional: Sequence[str], noise: Sequence[str]) -> Column:
    return 2 * term_hits(text, hard) + term_hits(text, directional) - 2 * term_hits(text, noise)


def keyword_overlap(query: Column, text: Column, stop: Sequence[str] = QUESTION_STOP_WORDS) -> Column:
    """Share of the query's distinct words of three letters or more, but stop words, that the text has; 0 without such words."""
    tokens = lambda c: F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0))), F.array(*[F.lit(s) for s in stop]) if stop else F.array().cast("array<string>"))
    q = tokens(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(F.lit(0.0))


def excerpt(text: Column, most: int = 400) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def content_hash(text: Column) -> Column:
    """The exact-dedup key: 16 hex digits of the SHA-256 of the text without white space at its ends."""
    return F.substring(F.sha2(F.regexp_replace(text, ENDS, "").cast("binary"), 256), 1, 16)


def scraped_hash(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")).cast("binary"), 256)


def stable_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("::", *parts).cast("binary"))


def strip_html(html: Column) -> Column:
    """Scripts and styles dropped, tags made spaces, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))


def is_boilerplate(text: Column, url: Column, markers: Sequence[str] = NAVIGATION_MARKERS, least_words: int = 80) -> Column:
    """Too short, too many navigation markers, too few distinct words, or a video page. A null text is boilerplate."""
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    n = word_count(low)
    marks = sum((F.regexp_count(low, F.lit(m)) for m in markers), F.lit(0))
    distinct = F.size(F.array_distinct(words(low))) / F.greatest(n, F.lit(1))
    return (n < least_words) | (marks / F.greatest(n, F.lit(1)) > 0.08) | (distinct < 0.35) | F.coalesce(F.contains(F.lower(url), F.lit("/videos/")), F.lit(False))


def sentences(text: Column) -> Column:
    """Split behind . ! or ? where white space follows."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")


def relevant_sentences(text: Column, *terms: Column, most: int = 3) -> Column:
    """The first sentences that hold one of the terms in any case; null and empty terms are in none."""
    low = [F.nullif(F.lower(t), F.lit("")) for t in terms]
    holds = lambda s: F.coalesce(F.greatest(*[F.contains(F.lower(s), t) for t in low], F.lit(False)), F.lit(False))
    return F.slice(F.filter(sentences(text), holds), 1, most)


def cited(text: Column) -> Column:
    """Distinct citations [S1], [S2], ... in order of first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(S[0-9]+)\]"), F.lit(1)))
