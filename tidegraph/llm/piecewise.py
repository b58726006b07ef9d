"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with a score-ordered agenda.

The vocabulary is read from a model file through the sentencepiece library; segmentation is our own: adjacent symbols
that form a piece wait in an agenda ordered by score, then by position, and the best pair is merged until none is left.
A text is first cut before spaces and at line ends if no piece reaches across such a place, since then no merge can
either; words are encoded once and remembered. Each Arrow batch's newly met words are checked against the library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import sliced

SPACE = "▁"
#: Words a worker remembers.
REMEMBERED = 400_000
_NEVER = np.iinfo(np.int32).max


class AgendaEncoder:
    """Encodes as the library does for BPE models without normalisation rules, begin or end ids or sampling."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.unk = sp.unk_id()
        self.pieces: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.pieces[sp.id_to_piece(i)] = i
        self.score = {p: sp.get_score(i) for p, i in self.pieces.items()}
        meeting = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.words_part = not any(p[0] != SPACE and p[1] == SPACE for p in meeting)
        self.lines_part = not any("\n" in p for p in meeting)
        self.prefix = SPACE if len(sp.encode("a", out_type=str)) and sp.encode("a", out_type=str)[0].startswith(SPACE) else ""
        # runs of spaces go with the word behind them; a line end stands alone where no merge crosses it
        self.coarse = re.compile((f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.lines_part else f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.words_part else "(?s:.+)")
        self.known: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}
        self.text_of = [str(i) for i in range(sp.get_piece_size())]
        self._tables()

    def _tables(self) -> None:
        """Arrays for agendas of many parts at once: pairs of piece ids that merge, and ranks by falling score."""
        scores = sorted({-s for s in self.score.values()})
        place = {s: k for k, s in enumerate(scores)}
        size = self.library.get_piece_size()
        self.rank = np.full(size + 1, _NEVER, np.int32)
        for p, i in self.pieces.items():
            self.rank[i] = place[-self.score[p]]
        merges = {(self.pieces[p[:k]] * size + self.pieces[p[k:]]): i for p, i in self.pieces.items() for k in range(1, len(p)) if p[:k] in self.pieces and p[k:] in self.pieces}
        self.pairs = np.array(sorted(merges), np.int64)
        self.merged = np.array([merges[k] for k in sorted(merges)] + [size], np.int32)
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in self.pieces.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i

    def _ids(self, piece: str) -> list[int]:
        got = self.pieces.get(piece)
        if got is not None:
            return [got]
        if self.bytes:
            return [self.bytes[b] for b in piece.encode("utf-8", "replace")]
        return [self.unk]

    def agenda(self, text: str) -> list[str]:
        """The pieces of one part: best score first, leftmost among equals."""
        n = len(text)
        score = self.score
        symbols: list[str | None] = list(text)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(-score[p], i, i + 1, 2) for i in range(n - 1) if (p := text[i : i + 2]) in score]
        heapq.heapify(queue)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            a = symbols[i]
            if a is None or right[i] != j:
                continue
            b = symbols[j]
            if b is None or len(a) + len(b) != size:
                continue
            a += b
            symbols[i], symbols[j] = a, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (p := a + symbols[k]) in score:
                    heapq.heappush(queue, (-score[p], i, k, len(p)))
            h = left[i]
            if h >= 0 and (p := symbols[h] + a) in score:
                heapq.heappush(queue, (-score[p], h, i, len(p)))
        return [s for s in symbols if s is not None]

    def _merge_ids(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of the piece that two adjacent pieces form, or one beyond the vocabulary."""
        key = a.astype(np.int64) * (len(self.rank) - 1) + b
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.merged[at], self.merged[-1])

    def agendas(self, parts: list[str]) -> list[bytes]:
        """Agendas of parts of one length class side by side: each round, every part merges its best pair.

        Ids as little-endian 32-bit numbers; empty for a part with a character that no piece has.
        """
        rows = len(parts)
        length = np.array([len(p) for p in parts])
        width = int(length.max())
        ids = np.full((rows, width + 1), -1, np.int32)
        inside = np.arange(width + 1) < length[:, None]
        ids[inside] = self.of_char[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        odd = ((ids < 0) & inside).any(1)
        made = self._merge_ids(ids[:, :-1], ids[:, 1:])  # what each symbol forms with its right neighbour
        order = self.rank[made]
        done = [b""] * rows
        live = np.arange(rows)
        cols = np.arange(width)
        while True:
            best = order.argmin(1)
            some = order[np.arange(len(live)), best] != _NEVER
            if not some.all():
                raw, step = np.ascontiguousarray(ids[~some], "<i4").tobytes(), 4 * (width + 1)
                for k, (r, n) in enumerate(zip(live[~some].tolist(), length[~some].tolist(), strict=True)):
                    done[r] = raw[k * step : k * step + 4 * n]
                live, ids, made, order, best, length = live[some], ids[some], made[some], order[some], best[some], length[some]
                if not len(live):
                    break
            at = np.arange(len(live))
            ids[at, best] = made[at, best]
            length = length - 1
            ids[:, :-1] = np.take_along_axis(ids, cols + (cols > best[:, None]), 1)  # drop the right half of the merged pair
            ids[:, -1] = -1
            moved = np.minimum(cols + (cols >= best[:, None]), width - 1)
            order, made = np.take_along_axis(order, moved, 1), np.take_along_axis(made, moved, 1)
            order[:, -1] = _NEVER
            for col in (best, best - 1):
                ok = np.flatnonzero(col >= 0)
                m = self._merge_ids(ids[ok, col[ok]], ids[ok, col[ok] + 1])
                made[ok, col[ok]] = m
                order[ok, col[ok]] = self.rank[m]
        for r in np.flatnonzero(odd).tolist():
            done[r] = b""
        return done

    def one(self, part: str) -> bytes:
        return np.array([i for piece in self.agenda(part) for i in self._ids(piece)], "<i4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encodes words not yet known."""
        known, by_size = self.known, {}
        for p in words:
            if len(p) == 1 or len(p) > 48:
                known[p] = self.fresh[p] = self.one(p)
            else:
                by_size.setdefault((len(p) + 3) // 4, []).append(p)
        for some in by_size.values():
            got = dict(zip(some, self.agendas(some), strict=True))
            got |= {p: self.one(p) for p, ids in got.items() if not ids}
            known.update(got)
            self.fresh.update(got)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, 4 bytes each. Words learned after the memory is full are forgotten with the call."""
        known = self.known
        words = [self.coarse.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set().union(*words) - known.keys()
        self.learn(new)
        out = [b"".join(map(known.__getitem__, w)) for w in words]
        if len(known) > REMEMBERED:
            for w in new:
                del known[w]
        return out

    def verify(self) -> None:
        """Compares the words met since the last call with the library, all at once; raises where they differ."""
        parts, self.fresh = list(self.fresh.items()), {}
        # a word is shown to the library behind a line end, where no merge crosses
        head = len(self.library.encode("\n"))
        for (p, got), want in zip(parts, self.library.encode(["\n" + p.replace(SPACE, " ") for p, _ in parts], num_threads=1), strict=True):
            if np.array(want[head:], "<i4").tobytes() != got:
                raise ValueError(f"the agenda and the library part ways at {p!r}")


def encode_decode(docs: DataFrame, model_file: str, check: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string), one row per input row; null texts are empty and have no ids.

    decoded is the library's decode of the ids. Repeated rows repeat; an empty table gives an empty result; extra
    columns are not read. Texts are encoded whole. model_file must exist on every executor.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).transform(lambda d: _mapped(d, model_file, check, full=True))


def encode_digests(docs: DataFrame, model_file: str, check: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, lossless): `encode_decode` digested in the same pass.

    lossless: the decoded text equals the input.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).transform(lambda d: _mapped(d, model_file, check, full=False))


def _mapped(docs: DataFrame, model_file: str, check: bool, full: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ("ids array<int>, decoded string" if full else "n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model_file)
        for b in sliced(batches):
            texts = [t.as_py() or "" for t in b.column(1)]
            ids = [np.frombuffer(i, "<i4").tolist() for i in coder.encode(texts)]
            if check:
                coder.verify()
            else:
                coder.fresh.clear()
            decoded = coder.library.decode(ids) if ids else []
            if full:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
                continue
            hexed = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
            cols = [pa.array([len(i) for i in ids], pa.int64()), pa.array([hexed(",".join(map(coder.text_of.__getitem__, i))) for i in ids], pa.string()), pa.array([hexed(t) for t in decoded], pa.string()), pa.array([t == d for t, d in zip(texts, decoded, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"])

    return docs.mapInArrow(run, schema)


_encoders: dict[str, AgendaEncoder] = {}


def encoder(model_file: str) -> AgendaEncoder:
    """The worker's encoder of a model; Python workers are reused, and so are its remembered parts."""
    if model_file not in _encoders:
        _encoders[model_file] = AgendaEncoder(model_file)
    return _encoders[model_file]
