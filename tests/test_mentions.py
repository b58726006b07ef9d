"""Spans against a scan of every place and length; the dictionary against a fold in order; links, filters and firsts."""

import random
import re

from pyspark.sql import functions as F

from tidegraph.functions import text as X
from tidegraph.operators import mentions as M
from tidegraph.sources.files import read_entity_dictionary


def canonical(s):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s&-]", " ", re.sub("['`]", "", s))).strip().lower()


def brute_spans(text, aliases):
    """Leftmost, longest stretches whose canonical form is an alias, with word boundaries."""
    out, i = [], 0
    while i < len(text):
        ends = [j for j in range(len(text), i, -1) if canonical(text[i:j]) in aliases]
        ends = [j for j in ends if not (j < len(text) and re.match(r"[\w&\-'`]", text[j]) and canonical(text[i : j + 1]) != canonical(text[i:j]))]
        starts_word = re.match(r"[\w&-]", text[i]) and not (i and re.match(r"[\w&-]", text[i - 1])) and not re.search(r"[\w&-]['`]+$", text[:i])
        if starts_word and ends:
            j = min(k for k in ends if canonical(text[i:k]) == canonical(text[i : ends[0]]))  # without what canonical forms drop
            out.append((i, j, canonical(text[i:j])))
            i = ends[0]
        else:
            i += 1
    return out


def test_spans_equal_a_scan(spark):
    rng = random.Random(3)
    words = ["Fed", "fed", "Bank", "of", "England", "Moody's", "S&P", "500", "A-B", "Über", "x"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", ", ", ". ", "\n", " 'n' "]) for _ in range(rng.randrange(1, 25))) for _ in range(120)]
    texts += ["", None, "England", "Englander", "xFed Fed-x 'Fed'", "bank, of... england bank of"]
    aliases = ["fed", "bank", "bank of england", "of england", "moodys", "s&p 500", "a-b", "über x", "x x x", "england bank"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    table = spark.createDataFrame([(a,) for a in [*aliases, "", "fed", None]], "alias string")
    want = sorted((i, s, e, a) for i, t in enumerate(texts) if t for s, e, a in brute_spans(t, set(aliases)))
    for most in (100, 3):  # as one automaton; by joins
        got = M.gazetteer_spans(chunks, table, most).collect()
        assert sorted((r.chunk_id, r.start, r.end, r.alias) for r in got) == want
        assert all(texts[r.chunk_id][r.start : r.end] == r.raw_name and canonical(r.raw_name) == r.alias for r in got)
    assert M.gazetteer_spans(chunks, table.limit(0)).count() == M.gazetteer_spans(chunks.limit(0), table).count() == 0


def test_resolved_mentions(spark):
    dictionary = spark.createDataFrame([("federal reserve", "federal-reserve", "Federal Reserve", "ORG", None), ("apple", "AAPL", "Apple Inc.", "ORG", "AAPL"), ("apple computer company", "AAPL", "Apple Inc.", "ORG", "AAPL")], "alias string, canonical_name string, display_name string, entity_type string, ticker string")
    spans = [
        (1, 0, "Apple", "ORG"), (1, 1, "APPLE", "ORG"), (1, 2, "Federal  Reserve", "MISC"), (1, 3, "Jane Doe", "PER"), (1, 4, "Jane", "PER"), (1, 5, "France", "LOC"), (1, 6, "Atlantis", "LOC"), (1, 7, "A", "ORG"),
        (1, 8, "Nobody Ltd", "ORG"), (1, 9, "Apple", "DATE"), (2, 0, "Federal Reserv", "ORG"), (2, 1, "Jane Doe", "PER"), (2, 2, "Federal Reserv", "PER"), (3, 0, "Sole Person", "PER"), (3, 1, None, "PER"), (3, 2, "Apple Company Computer", "MISC"),
    ]
    got = M.resolve_mentions(spark.createDataFrame(spans, "chunk_id int, ord int, raw_name string, label string"), dictionary)
    rows = sorted((r.chunk_id, r.ord, r.canonical_name, r.display_name, r.entity_type, r.ticker, r.link_method) for r in got.collect())
    assert rows == [
        (1, 0, "AAPL", "Apple Inc.", "ORG", "AAPL", "exact"), (1, 2, "federal-reserve", "Federal Reserve", "ORG", None, "exact"), (1, 3, "jane doe", "Jane Doe", "PER", None, "ner_heuristic"), (1, 5, "france", "France", "LOC", None, "ner_heuristic"),
        (2, 0, "federal-reserve", "Federal Reserve", "ORG", None, "fuzzy"), (2, 1, "jane doe", "Jane Doe", "PER", None, "ner_heuristic"), (2, 2, "federal reserv", "Federal Reserv", "PER", None, "ner_heuristic"),
        (3, 0, "sole person", "Sole Person", "PER", None, "ner_heuristic"), (3, 2, "AAPL", "Apple Inc.", "ORG", "AAPL", "fuzzy"),
    ]
    texts = spark.createDataFrame([(1, "Jane Doe of Apple in France."), (2, "jane doe and Sole Person"), (3, "")], "chunk_id int, text string")
    people = spark.createDataFrame([("jane doe",), ("sole person",), ("apple",)], "alias string")
    found = M.extract_mentions(texts, dictionary, people).collect()
    assert sorted((r.chunk_id, r.canonical_name, r.start, r.end) for r in found) == [(1, "AAPL", 12, 17), (1, "france", 21, 27), (1, "jane doe", 0, 8), (2, "jane doe", 0, 8)]


def fold(companies, institutions, strip):
    """Forms registered one after another, a better entity taking a form over."""
    claim, names = {}, {}
    for t, n, al in companies:
        if (t := (t or "").strip().upper()) and (n := (n or "").strip()):
            names[t] = n
            for f in [n, *(a.strip() for a in (al or "").split(";") if a.strip())]:
                for k in (canonical(f), canonical(strip(f))):
                    if k:
                        claim[k] = t
    out = {}

    def put(forms, e):
        for f in forms:
            for k in (canonical(f), canonical(strip(f))):
                old = out.get(k)
                if k and (not old or (bool(e[3]), len(e[1])) > (bool(old[3]), len(old[1]))):
                    out[k] = e

    for k, t in claim.items():
        put([k, t], (t, names[t], "ORG", t))
    for cid, n, kind, t, al in institutions:
        t = (t or "").strip().upper() or None
        name = t or re.sub("-+", "-", re.sub("[^a-z0-9]+", "-", canonical(cid or n or ""))).strip("-")
        if name:
            put([n or "", cid or "", *([t] if t else []), *((al or "").split(";"))], (name, n or name, (kind or "").strip().upper() or "ORG", t))
    return {k: v for k, v in out.items() if k}


def test_dictionary_equals_the_fold(spark, tmp_path):
    companies = [("AAA", "Alpha Inc.", "Alpha;Alfa Corp"), ("bbb", "Beta Holdings", "Alpha;Beta"), ("CCC", "Gamma, Inc", None), ("AAA", "Alpha Two Corporation", "Second"), ("", "Nameless", "n"), ("DDD", "", "d"), ("EEE", "Gamma Co", "Gamma Group;;EEE")]
    institutions = [("fed-res", "Federal Reserve", "org", None, "Fed;Alpha"), (None, "Gamma", "MISC", "ggg", "Fed"), ("only-id", None, None, None, "Only;Fed"), (None, None, "ORG", None, "lost"), ("x", "Very Long Display Name of a Bank Inc", "ORG", None, "Only;second")]
    q = lambda v: "" if v is None else f'"{v}"' if "," in v else v
    (tmp_path / "c.csv").write_text("ticker,company_name,aliases\n" + "".join(",".join(map(q, r)) + "\n" for r in companies))
    (tmp_path / "i.csv").write_text("canonical_id,display_name,entity_type,ticker,aliases\n" + "".join(",".join(map(q, r)) + "\n" for r in institutions))
    got = read_entity_dictionary(spark, str(tmp_path / "c.csv"), str(tmp_path / "i.csv")).collect()
    memo = {}

    def strip(s):
        if s not in memo:
            memo[s] = spark.range(1).select(X.strip_legal(F.lit(s))).first()[0]
        return memo[s]

    assert {r.alias: (r.canonical_name, r.display_name, r.entity_type, r.ticker) for r in got} == fold(companies, institutions, strip)


def test_sentences_by_three_terms(spark):
    df = spark.createDataFrame([("Fed cut. None here. The F.R.S. spoke! FRS rose? fed again.", "Fed", "Reserve", "FRS"), ("a. b. c", None, "", None)], "t string, r string, d string, c string")
    got = df.select(X.relevant_sentences(F.col("t"), F.col("r"), F.col("d"), F.col("c")).alias("s")).collect()
    assert [r.s for r in got] == [["Fed cut.", "FRS rose?", "fed again."], []]
