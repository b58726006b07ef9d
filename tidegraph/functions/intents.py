"""Predicates over questions, titles and names, and the clean-up of model text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results must not differ in any of the lists below.
COUNTRIES = (
    "afghanistan", "albania", "algeria", "angola", "argentina", "australia", "austria", "bangladesh", "belgium", "bolivia", "brazil", "cambodia",
    "cameroon", "canada", "chile", "china", "colombia", "congo", "croatia", "cuba", "czech republic", "czechia", "denmark", "ecuador", "egypt",
    "ethiopia", "finland", "france", "germany", "ghana", "greece", "guatemala", "hungary", "india", "indonesia", "iran", "iraq", "ireland",
    "israel", "italy", "japan", "jordan", "kazakhstan", "kenya", "kuwait", "laos", "lebanon", "libya", "malaysia", "mexico", "morocco",
    "mozambique", "myanmar", "nepal", "netherlands", "new zealand", "nigeria", "north korea", "norway", "pakistan", "panama", "peru",
    "philippines", "poland", "portugal", "qatar", "romania", "russia", "saudi arabia", "senegal", "serbia", "singapore", "somalia",
    "south africa", "south korea", "spain", "sri lanka", "sudan", "sweden", "switzerland", "syria", "taiwan", "tanzania", "thailand", "tunisia",
    "turkey", "ukraine", "united arab emirates", "uae", "united kingdom", "uk", "united states", "usa", "us", "america", "uruguay",
    "uzbekistan", "venezuela", "vietnam", "yemen", "zimbabwe", "american", "chinese", "european", "british", "russian", "japanese", "german",
    "french", "indian", "korean", "iranian", "israeli",
)
REGIONS = (
    "middle east", "middle-east", "mena", "gulf", "gulf states", "gulf region", "eurozone", "euro area", "emerging markets", "latin america",
    "asia pacific", "southeast asia",
)
HARD_SOURCES = ("Federal Reserve", "BLS", "US Treasury", "OilPrice.com")
HARD_TITLES = (
    "inflation", "interest rate", "fed ", "federal reserve", "gdp", "tariff", "recession", "yield", "unemployment", "cpi", "opec", "oil price",
    "monetary", "fiscal", "treasury", "deficit", "currency", "trade war", "sanctions", "rate hike", "rate cut", "central bank",
)
MACRO_TERMS = (
    "inflation", "deflation", "stagflation", "interest rate", "rate hike", "rate cut", "rate decision", "federal reserve", "central bank", "ecb",
    "bank of england", "boj", "pboc", "fed funds", "quantitative easing", "quantitative tightening", "gdp", "gross domestic product", "cpi", "pce",
    "consumer price index", "yield", "treasury yield", "bond yield", "10-year yield", "tariff", "trade war", "trade deficit", "trade surplus", "crude oil",
    "brent", "wti", "opec", "fiscal policy", "monetary policy", "recession", "economic growth", "economic slowdown", "unemployment", "nonfarm payroll",
    "jobless claims", "exchange rate", "dollar index", "dxy", "sanctions", "export controls",
)
DIRECTIONAL_TERMS = (
    "surged", "plunged", "spiked", "tumbled", "tightened", "eased", "cut rates", "hiked rates", "accelerated", "contracted", "expanded", "widened",
    "narrowed",
)
NOISE_TERMS = (
    "quarterly earnings", "earnings per share", "eps beat", "product launch", "iphone", "android", "stock buyback", "share repurchase",
    "advertising revenue", "monthly active users",
)
MARKET_HINTS = (
    "price", "quote", "trading at", "market cap", "valuation", "p/e", "pe ratio", "eps", "fundamental", "balance sheet", "cash flow",
    "income statement", "company overview", "daily close", "open price", "high", "low", "volume", "performance", "return",
)
CAUSAL_HINTS = (
    "affect", "impact", "effect", "influence", "cause", "drive", "mean for", "implication", "what does", "how does", "why is", "because of",
    "result of", "due to", "respond to", "reaction", "stronger", "weaker", "rise", "fall", "rally", "selloff",
)
CAUSAL_ANCHORS = (
    "dollar", "usd", "currency", "forex", "fx", "rate", "fed", "inflation", "oil", "gold", "macro", "economy", "trade", "tariff", "yield",
    "bond", "iran", "china", "russia", "war", "sanction", "geopolit",
)
SUMMARY_TERMS = ("summary", "summarise", "summarize", "recap", "brief", "wrap-up", "wrap up", "overview")
SUMMARY_TIMES = ("today", "today's", "todays", "daily", "yesterday", "yesterday's")
SUMMARY_DOMAINS = ("macro", "news", "market", "markets")
SOURCE_KEYWORDS = (("bbc", "BBC"), ("bloomberg", "Bloomberg"), ("cnbc", "CNBC"), ("marketwatch", "MarketWatch"), ("nasdaq", "Nasdaq"), ("cbs", "CBS MoneyWatch"))


def has_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether the lower-cased text holds one of the terms; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))


def is_country(canonical: Column) -> Column:
    return canonical.isin(*COUNTRIES)


def is_known_location(canonical: Column) -> Column:
    return canonical.isin(*COUNTRIES, *REGIONS)


def is_prominent_person(canonical: Column, least_tokens: int = 2) -> Column:
    return F.regexp_count(canonical, F.lit(r"\S+")) >= least_tokens


def is_hard_include(source: Column, title: Column, sources: Sequence[str] = HARD_SOURCES, titles: Sequence[str] = HARD_TITLES) -> Column:
    """Articles whose chunks all go to extraction."""
    return F.coalesce(source.isin(*sources), F.lit(False)) | has_any(title, titles)


def is_market_question(question: Column) -> Column:
    return has_any(question, MARKET_HINTS)


def is_causal_question(question: Column) -> Column:
    return has_any(question, CAUSAL_HINTS) & has_any(question, CAUSAL_ANCHORS)


def is_summary_question(question: Column) -> Column:
    return has_any(question, SUMMARY_TERMS) & (has_any(question, SUMMARY_TIMES) | has_any(question, SUMMARY_DOMAINS))


def source_asked(question: Column) -> Column:
    """The label of the first keyword, in the list's order, that the question holds; else null."""
    return F.coalesce(*[F.when(F.contains(F.lower(question), F.lit(k)), F.lit(v)) for k, v in SOURCE_KEYWORDS])


def summary_dates(question: Column, today: Column) -> Column:
    """struct<start, end>: the day that a summary is asked of; nulls for none or for both today and yesterday."""
    now, before = has_any(question, ("today", "daily")), has_any(question, ("yesterday",))
    day = F.when(now & ~before, today).when(before & ~now, F.date_sub(today, 1))
    return F.struct(day.alias("start"), day.alias("end"))


def best_time_expression(expressions: Column) -> Column:
    """Of an array of time expressions: those with four digits in a row first, then the longest, then the first."""
    ranked = F.transform(expressions, lambda x, i: F.struct((~F.regexp_like(x, F.lit(r"\d{4}"))).alias("bare"), (-F.char_length(x)).alias("size"), i.alias("at"), x.alias("x")))
    return F.array_min(ranked)["x"]


def strip_think(text: Column) -> Column:
    """Text without <think> blocks, closed or not, and without white space at its ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*", ""), r"^\s+|\s+$", "")


def hops_of(answer: Column) -> Column:
    """The hops of the outermost {...} of a text, array<struct<cause, effect, query>>; null if it doesn't parse."""
    return F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), "hops array<struct<cause:string,effect:string,query:string>>")["hops"]


def epoch(day: Column) -> Column:
    """Seconds since 1970 of a date's midnight in UTC, whatever the session's time zone."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400
