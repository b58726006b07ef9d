"""Reading and grading of answers: sections, direction, confidence, language checks, citations, pass or fail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegraph.functions import text as X

SECTIONS = ("answer", "evidence", "theory")
#: Patterns of a direction in the order they are tried, of hedging, overclaiming, dominance and counter-arguments.
DIRECTIONS = (
    (r"\bnegative\s+for\b|\bbearish\b", "negative"),
    (r"\bpositive\s+for\b|\bbullish\b", "positive"),
    (r"\bmixed\b", "mixed"),
    (r"\bunclear\b|\binsufficient\b", "unclear"),
    (r"\bpositive\b", "positive"),
    (r"\bnegative\b", "negative"),
    (r"\boffsets?\b.*\bgains?\b|\bgains?\b.*\boffsets?\b", "mixed"),
)
HEDGES = (
    r"\bmixed\b", r"\boffset(ting|s)?\b", r"\bcounterbalance[sd]?\b", r"\bpartly\s+offset\b", r"\bon\s+(the\s+)?one\s+hand\b", r"\bon\s+(the\s+)?other\s+hand\b",
    r"\bwhile\s+(also|simultaneously)\b", r"\bbut\s+(also|simultaneously)\b", r"\bdepends\s+on\b", r"\buncertain\b",
    r"\bconflict(ing|s)?\b.*\b(evidence|signal|data)\b", r"\b(evidence|signal|data)\b.*\bconflict(ing|s)?\b",
)
OVERCLAIMS = (
    r"\bwill\s+(certainly|definitely|surely)\b", r"\bclearly\s+(bullish|bearish|positive|negative)\b", r"\bno\s+doubt\b", r"\bguaranteed\s+to\b", r"\bwithout\s+question\b",
    r"\bonly\s+(positive|negative|bullish|bearish)\b", r"\bpurely\s+(positive|negative|bullish|bearish)\b", r"\bstraightforward(ly)?\b",
    r"\boverall(ly)?\s+(positive|negative|bullish|bearish)\b", r"\bnet\s+effect\s+is\s+(clearly|definitely|certainly)\b",
)
DOMINANCE = r"\b(dominates?|outweighs?|more\s+than\s+offsets?)\b"
COUNTER = r"\b(however|nevertheless|that said|on the other hand|offset|counteract|but also|though|mitigat(es?|ing)|headwind|tailwind|risk|caveat)\b"


def sections(answer: Column) -> Column:
    """struct<cur, answer, evidence, theory>: lines under each heading; a heading is a line that starts with its name."""
    lines = F.split(F.regexp_replace(F.coalesce(answer, F.lit("")), r"\r?\n$", ""), r"\r?\n")
    start = F.struct(*[F.lit("").alias(n) for n in ("cur", *SECTIONS)])

    def step(s: Column, line: Column) -> Column:
        head = F.lower(F.trim(line))
        named = F.coalesce(*[F.when(F.startswith(head, F.lit(n)), F.lit(n)) for n in SECTIONS])
        body = [F.when(named.isNull() & (s["cur"] == n), F.concat(s[n], line, F.lit("\n"))).otherwise(s[n]).alias(n) for n in SECTIONS]
        return F.struct(F.coalesce(named, s["cur"]).alias("cur"), *body)

    return F.aggregate(lines, start, step)


def direction(text: Column) -> Column:
    """negative, positive, mixed or unclear; the first pattern that is found decides, unclear if none is."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(d)) for p, d in DIRECTIONS], F.lit("unclear"))


def confidence(text: Column) -> Column:
    """The percentage of the first `confidence: n %` or `n % confident`, at most 100, else null."""
    got = F.regexp_extract(F.regexp_extract(text, r"(?i)confidence[:\s]+\d{1,3}\s*%|\d{1,3}\s*%\s+confident", 0), r"(\d{1,3})\s*%", 1)
    return F.when(got != "", F.least(got.cast("int"), F.lit(100)))


def hits(text: Column, patterns: Sequence[str]) -> Column:
    """The patterns that are found in the lower-cased text, in their order."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(low.rlike(p), F.lit(p)) for p in patterns]), lambda p: p.isNotNull())


def mechanisms(text: Column, known: Column) -> Column:
    """Of the known mechanisms, those of whose words one at least occurs in the text."""
    low = F.lower(text)
    return F.filter(known, lambda m: F.exists(X.words(F.replace(F.lower(m), F.lit("_"), F.lit(" "))), lambda w: F.contains(low, w)))


def grounding(answer: Column, labels: Column) -> Column:
    """struct<used, count, has_answer, has_evidence, has_theory>: citations that are known labels, sorted, and section words."""
    used = F.array_sort(F.array_intersect(X.cited(F.coalesce(answer, F.lit(""))), labels))
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.struct(used.alias("used"), F.size(used).alias("count"), *[F.contains(low, F.lit(n)).alias(f"has_{n}") for n in SECTIONS])


def read_answer(answer: Column, known: Column) -> Column:
    """struct of what an answer says; direction, confidence and overclaims are read from its answer section alone."""
    s = sections(answer)
    return F.struct(
        direction(s["answer"]).alias("direction"), confidence(s["answer"]).alias("confidence"), mechanisms(answer, known).alias("mechanisms"),
        F.lower(answer).rlike(COUNTER).alias("counter"), hits(answer, HEDGES).alias("hedges"), hits(s["answer"], OVERCLAIMS).alias("overclaims"), F.lower(answer).rlike(DOMINANCE).alias("dominance"),
    )


def case_passes(chunk: Column, entity: Column, event_type: Column, ground: Column, quality: Column, least: tuple[float, float, float] = (0.5, 1.0, 0.5), least_cited: int = 1) -> Column:
    """All of: three recalls, citations, both sections, and the quality check; a null recall counts as 0."""
    recalls = [F.coalesce(c, F.lit(0.0)) >= x for c, x in zip((chunk, entity, event_type), least, strict=True)]
    out = (ground["count"] > 0) & (ground["count"] >= least_cited) & ground["has_evidence"] & ground["has_theory"] & F.coalesce(quality, F.lit(True))
    for r in recalls:
        out = out & r
    return out
