"""Conversation sessions as state: the last entity and period, recent turns, the summary of older ones.

turns: session_id, turn_index (from 0, without gaps), query, canonical_name, display_name, entity_type, date_start, date_end,
answer. The same processor runs over a stream and over a table; turns may come in any order, a turn waits until all before it
have come.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidegraph.operators.retrieval import REFERENCES, SAME_PERIOD

# Turns kept before the older ones are compressed, kept then, and shown; characters of an answer kept
MOST_TURNS, RECENT_TURNS, SHOWN_TURNS, ANSWER_CHARS = 8, 3, 3, 300
#: Characters of histories and summaries that a task holds before it hands its rows on.
OUTPUT_CHARS = 1 << 22

TURN = "turn_index int, query string, canonical_name string, display_name string, entity_type string, date_start string, date_end string, answer string"
OUTPUT = "session_id string, turn_index int, rewritten string, start string, end string, history string, kept int, summary string"
MEMORY = "next int, canonical_name string, display_name string, entity_type string, date_start string, date_end string, summary string"


def plain_summary(prior: str, turns: list[dict]) -> str:
    """Stands in for a language model's: what was asked of, with its period, one line a turn, after the prior summary."""
    lines = [f"{t['display_name'] or 'general'} ({t['date_start'] or ''}..{t['date_end'] or ''})" for t in turns]
    return "\n".join([*([prior] if prior else []), *lines])


_TITLE, _EARLIER = "[CONVERSATION HISTORY]", "Earlier in this session: "


class Digests:
    """SHA-256 digests of a session's summary and history. What a summary adds to the one before is hashed once, so that
    turns cost the same however long their session is; a summary that is no continuation is hashed anew."""

    def __init__(self) -> None:
        self._hashed, self._summary, self._history = "", hashlib.sha256(), hashlib.sha256(f"{_TITLE}\n{_EARLIER}".encode())

    def _follow(self, summary: str) -> None:
        if summary is not self._hashed:
            if not summary.startswith(self._hashed):
                self.__init__()
            more = summary[len(self._hashed) :].encode()
            self._summary.update(more)
            self._history.update(more)
            self._hashed = summary

    def summary(self, s: Session) -> str:
        self._follow(s.summary)
        return self._summary.hexdigest()

    def history(self, s: Session) -> str:
        if not s.summary:
            return hashlib.sha256(s.history().encode()).hexdigest()
        self._follow(s.summary)
        h = self._history.copy()
        h.update("".join(f"\n{x}" for x in s.shown()).encode())
        return h.hexdigest()


@dataclass
class Session:
    """What a session remembers; `step` takes its next turn."""

    next: int = 0
    canonical_name: str | None = None
    display_name: str | None = None
    entity_type: str | None = None
    date_start: str | None = None
    date_end: str | None = None
    summary: str = ""
    turns: list[dict] = field(default_factory=list)

    def rewritten(self, query: str | None) -> str | None:
        """The query with its references replaced by the last entity."""
        return re.sub(REFERENCES, lambda _: self.display_name, query) if query and self.display_name else query

    def period(self, turn: dict) -> tuple[str | None, str | None]:
        """The turn's own period, or the last one if it has none and its words keep the period."""
        own = (turn["date_start"], turn["date_end"])
        return (self.date_start, self.date_end) if not any(own) and re.search(SAME_PERIOD, turn["query"] or "") else own

    def shown(self) -> list[str]:
        """The lines of the turns that are shown before the next question."""
        lines = []
        for t in self.turns[-SHOWN_TURNS:]:
            period = f"{t['date_start']} -> {t['date_end']}" if t["date_start"] or t["date_end"] else "no time filter"
            lines.append(f"Turn {t['turn_index'] + 1}: Asked about {t['display_name'] or 'general query'} ({period}): {t['answer'] or ''}")
        return lines

    def history(self) -> str:
        """The block that is put before the next question."""
        lines = [*([f"{_EARLIER}{self.summary}"] if self.summary else []), *self.shown()]
        return "\n".join([_TITLE, *lines]) if lines else ""

    def step(self, turn: dict, summarise: Callable[[str, list[dict]], str], digests: Digests | None = None) -> dict:
        """What the turn is answered with: the rewritten query, its period, the history before it; then the turn is recorded,
        and beyond MOST_TURNS all but the last RECENT_TURNS go into the summary."""
        start, end = self.period(turn)
        out = {"turn_index": turn["turn_index"], "rewritten": self.rewritten(turn["query"]), "start": start, "end": end, "history": digests.history(self) if digests else self.history()}
        self.turns.append({**turn, "answer": (turn["answer"] or "")[:ANSWER_CHARS]})
        if turn["canonical_name"]:
            self.canonical_name, self.entity_type, self.display_name = turn["canonical_name"], turn["entity_type"], turn["display_name"]
        if turn["date_start"] or turn["date_end"]:
            self.date_start, self.date_end = turn["date_start"], turn["date_end"]
        if len(self.turns) > MOST_TURNS:
            self.summary = summarise(self.summary, self.turns[:-RECENT_TURNS])
            self.turns = self.turns[-RECENT_TURNS:]
        self.next += 1
        return out | {"kept": len(self.turns), "summary": digests.summary(self) if digests else self.summary}


_FIELDS = [c.split()[0] for c in TURN.split(", ")]
_HEAD = [c.split()[0] for c in MEMORY.split(", ")]


def _row(values: dict, names: list[str]) -> tuple:
    return tuple(None if v is None or v != v else int(v) if n in ("turn_index", "next") else v for n, v in ((n, values.get(n)) for n in names))


class SessionProcessor(StatefulProcessor):
    """Keeps a `Session` a key: its head as a value, recent turns as a list, turns that came too early by their index."""

    def __init__(self, summarise: Callable[[str, list[dict]], str] = plain_summary, digests: bool = False):
        self.summarise, self.digests = summarise, digests

    def init(self, handle) -> None:
        self.head = handle.getValueState("head", MEMORY)
        self.recent = handle.getListState("recent", TURN)
        self.early = handle.getMapState("early", "turn_index int", TURN)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        first = initialState.iloc[0].to_dict()
        turns = first.pop("turns")
        self.head.update(_row(first, _HEAD))
        self.recent.put([_row(t if isinstance(t, dict) else t.asDict(), _FIELDS) for t in turns])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = Session()
        if self.head.exists():
            s = Session(**dict(zip(_HEAD, self.head.get(), strict=True)), turns=[dict(zip(_FIELDS, t, strict=True)) for t in self.recent.get()] if self.recent.exists() else [])
        digests, early = Digests() if self.digests else None, self.early.exists()
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        out, held, waiting = [], 0, {}
        for batch in rows:
            for r in batch.itertuples(index=False):
                t = _row(r._asdict(), _FIELDS)
                if t[0] is not None and t[0] >= s.next:  # a turn that came before is not taken twice
                    waiting.setdefault(t[0], t)
                while s.next in waiting or (early and self.early.containsKey((s.next,))):
                    i = s.next
                    if i in waiting:
                        t = waiting.pop(i)
                    else:
                        t = self.early.getValue((i,))
                        self.early.removeKey((i,))
                    out.append({"session_id": str(key[0]), **s.step(dict(zip(_FIELDS, t, strict=True)), self.summarise, digests)})
                    held += len(out[-1]["history"]) + len(out[-1]["summary"])
                    if held > OUTPUT_CHARS:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
        for i, t in waiting.items():
            if not self.early.containsKey((i,)):
                self.early.updateValue((i,), t)
        self.head.update(tuple(getattr(s, n) for n in _HEAD))
        if s.turns:
            self.recent.put([_row(t, _FIELDS) for t in s.turns])
        if out:
            yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def session_turns(turns: DataFrame, saved: DataFrame | None = None, summarise: Callable[[str, list[dict]], str] = plain_summary, digests: bool = False) -> DataFrame:
    """(session_id, turn_index, rewritten, start, end, history, kept, summary) of every turn, over a stream or a table.

    kept: turns that stay verbatim after it. Repeated turn indexes count once, the first seen; a gap holds back what comes
    after it. saved (session_id, memory struct of `load_sessions`) are sessions that go on. A stream needs the RocksDB state store.
    A table's turns come to their session in order, so that none waits. Histories and summaries repeat all that was said before;
    with digests, they are given as SHA-256 digests (lowercase hex of UTF-8), whose rows don't grow with their session.
    """
    rows = turns.select(F.col("session_id").cast("string").alias("session_id"), *[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in TURN.split(", ")])
    first = saved.select("session_id", *_HEAD, "turns").groupBy("session_id") if saved is not None else None
    if not turns.isStreaming:
        _ = turns.sparkSession.streams.active  # the state stores' coordinator starts with the session's stream manager
        parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as the state's, so that rows aren't dealt again
        rows = rows.repartition(parts, "session_id").sortWithinPartitions("session_id", "turn_index")
    return rows.groupBy("session_id").transformWithStateInPandas(SessionProcessor(summarise, digests), OUTPUT, "append", "none", first)


def final_sessions(turns: DataFrame, summarise: Callable[[str, list[dict]], str] = plain_summary) -> DataFrame:
    """(session_id, ..., turns) of whole sessions, to be saved: what `SessionProcessor` holds after the last turn. A session is one group."""
    schema = f"session_id string, {MEMORY}, turns array<struct<{TURN.replace(' ', ':').replace(',:', ',')}>>"

    def fold(pool: pd.DataFrame) -> pd.DataFrame:
        s = Session()
        for r in pool.drop_duplicates("turn_index").sort_values("turn_index").to_dict("records"):
            t = dict(zip(_FIELDS, _row(r, _FIELDS), strict=True))
            if t["turn_index"] != s.next:
                break
            s.step(t, summarise)
        return pd.DataFrame([{"session_id": pool["session_id"].iloc[0], **asdict(s)}])

    rows = turns.select(F.col("session_id").cast("string").alias("session_id"), *[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in TURN.split(", ")])
    return rows.groupBy("session_id").applyInPandas(fold, schema)


def save_sessions(sessions: DataFrame, path: str) -> None:
    """A JSON object a line for each session."""
    sessions.write.mode("overwrite").json(path)


def load_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Saved sessions; a line that doesn't parse, or names no session, is left out, so that its session starts afresh."""
    schema = f"session_id string, {MEMORY}, turns array<struct<{TURN.replace(' ', ':').replace(',:', ',')}>>"
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("session_id is not null and _corrupt is null and next is not null").drop("_corrupt")
