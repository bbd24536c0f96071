"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised by the model's rules, its spaces become the space mark, and every unit
(a mark and what follows it) is merged on its own: an agenda holds all adjacent symbol pairs
that make a piece, ordered by score and place, and the best pair merges first. Units are
independent because no piece has a mark behind another character, which is checked when the
model is loaded. Texts arrive in Arrow batches, and the new units of a batch are merged together:
short ones in rounds over one array that holds all their agendas, each round taking the best
pair of every unit (``merge_many``), long ones and those with unknown characters each with a
heap (``merge``). Every unit that a worker sees for the first time is also encoded by the
sentencepiece library; other ids than its own are an error.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Units that a worker learns before it forgets those met once alone; results do not depend on it.
UNITS = 300_000
#: Units merged and checked at once.
TOGETHER = 16_000
#: Characters of text handled at once.
SLICE_CHARS = 1_000_000
#: Longer units are merged one by one: rounds over many units would wait for them.
SHORT = 48


class Merger:
    """Encodes units with the scores of one vocabulary."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes_: dict[int, int] = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        # Units may be merged apart only if no piece joins a mark to the character before it.
        self.apart = not any(MARK in p.lstrip(MARK) for p in self.ids)
        if not self.apart:
            raise ValueError(f"{path}: pieces join words, so units can't be merged apart")
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()  # of the known ones, those met twice or more
        self.older: dict[str, bytes] = {}
        if any("\n" in p for p in self.ids) or not self.bytes_:
            raise ValueError(f"{path}: a line feed must be a byte token")
        self.cut = re.compile(rf"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n").findall
        # For merging many units at once: symbols of characters, and every pair that makes a piece.
        self.size = size
        self.of_char = np.full(0x110000, -1, np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        self.usual = re.compile("[" + "".join(re.escape(p) for p in self.ids if len(p) == 1) + "]+").fullmatch
        pairs = {
            (self.ids[p[:i]], self.ids[p[i:]]): made
            for p, made in self.ids.items()
            for i in range(1, len(p))
            if p[:i] in self.ids and p[i:] in self.ids
        }
        keys = np.array([a * size + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[order], np.array(list(pairs.values()), np.int64)[order]
        self.score_or_none = np.array([*(sp.get_score(i) for i in range(size)), -np.inf])  # the last is that of no piece

    def merge(self, unit: str) -> list[str]:
        """The unit's symbols after all merges."""
        symbols: list[str | None] = list(unit)
        n = len(symbols)
        scores = self.scores
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                agenda.append((-scores[pair], i, pair, i + 1))
        heapq.heapify(agenda)
        while agenda:
            _, left, pair, right = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or after[left] != right or a + b != pair:
                continue  # one of the two has merged with another meanwhile
            symbols[left], symbols[right] = pair, None
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                wider = pair + symbols[nxt]
                if wider in scores:
                    heapq.heappush(agenda, (-scores[wider], left, wider, nxt))
            prev = before[left]
            if prev >= 0:
                wider = symbols[prev] + pair
                if wider in scores:
                    heapq.heappush(agenda, (-scores[wider], prev, wider, left))
        return [s for s in symbols if s is not None]

    def encode_unit(self, unit: str) -> list[int]:
        out: list[int] = []
        for symbol in self.merge(unit):
            found = self.ids.get(symbol)
            if found is not None:
                out.append(found)
            elif self.bytes_:
                out.extend(self.bytes_[b] for b in symbol.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What the symbols at these places and the next ones make; -1 where that is no piece or the next one is of another unit."""
        nxt = np.minimum(at + 1, len(symbols) - 1)
        key = symbols[at] * self.size + symbols[nxt]
        slot = np.searchsorted(self.pair_keys, key)
        slot[slot == len(self.pair_keys)] = 0
        fits = (self.pair_keys[slot] == key) & (owner[at] == owner[nxt]) & (nxt > at)
        return np.where(fits, self.pair_made[slot], -1)

    def merge_many(self, units: list[str]) -> list[bytes]:
        """Ids of short units of known characters, as int32 bytes.

        All units' agendas are one array of pair scores: in every round the best pair of each
        unit merges (the first of equals), until no unit has a pair left. Pairs are looked up once,
        and then those that a merged symbol makes with its neighbours.
        """
        lens = np.fromiter(map(len, units), np.int64, len(units))
        symbols = self.of_char[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(units)), lens)
        made = self._pairs(symbols, owner, np.arange(len(symbols)))
        score = self.score_or_none[made]
        done_symbols, done_owner = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.repeat(np.maximum.reduceat(score, starts), np.diff(np.r_[starts, len(owner)]))
            over = best == -np.inf
            stay = ~over
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
            hits = np.flatnonzero((score == best) & stay)
            if not len(hits):
                break
            hits = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]
            symbols[hits] = made[hits]
            stay[hits + 1] = False
            symbols, owner, made, score, at = symbols[stay], owner[stay], made[stay], score[stay], np.cumsum(stay)[hits] - 1
            changed = np.concatenate([at, at[at > 0] - 1])
            made[changed] = self._pairs(symbols, owner, changed)
            score[changed] = self.score_or_none[made[changed]]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        raw = symbols[order].astype(np.int32).tobytes()
        ends = np.cumsum(np.bincount(owner, minlength=len(units))) * 4
        return [raw[i:j] for i, j in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]

    def learn(self, units: list[str]) -> None:
        """Merges units not seen before and checks them against the library."""
        plain = [u for u in units if len(u) <= SHORT and self.usual(u)]
        others = set(units).difference(plain) if len(plain) < len(units) else ()
        new = dict(zip(plain, self.merge_many(plain), strict=True)) if plain else {}
        new |= {u: np.array(self.encode_unit(u), np.int32).tobytes() for u in others}
        # Line feeds are tokens of their own, so one text with a unit in each line checks all.
        lines = [u for u in new if u != "\n"]
        theirs = np.array(self.library.encode("\n" + "\n".join(lines).replace(MARK, " ")), np.int32)
        feed = np.array(self.library.encode("\n"), np.int32)
        mine = np.frombuffer(feed[1:].tobytes().join([feed[:1].tobytes(), *(new[u] for u in lines)]), np.int32)
        if not np.array_equal(mine, theirs):
            for u in lines:
                ids = self.library.encode("\n" + u.replace(MARK, " "))[len(feed):]
                if ids != np.frombuffer(new[u], np.int32).tolist():
                    raise ValueError(f"unit {u!r}: merged to {np.frombuffer(new[u], np.int32).tolist()}, by the library to {ids}")
            raise ValueError(f"units merged to other ids than by the library, but only together: {lines[:20]}")
        self.known |= new

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its ids with the end id.

        Most units of a corpus are met once, so only those met again outlast the learning of UNITS.
        """
        if len(self.known) > UNITS:
            self.older = {u: self.known[u] for u in self.again}
            self.known, self.again = {}, set()
        parts = [self.cut(self.library.normalize(t)) if t else [] for t in texts]
        counts = Counter(chain.from_iterable(parts))
        new = set(counts).difference(self.known)
        met = new.intersection(self.older)
        self.known.update((u, self.older[u]) for u in met)
        self.again.update(u for u, n in counts.items() if n > 1 or u in self.known)
        new -= met
        new = sorted(new)
        for i in range(0, len(new), TOGETHER):  # the library takes a hundred bytes and more for a character that it checks
            self.learn(new[i : i + TOGETHER])
        end, ids_of = np.int32(self.end).tobytes(), self.known.__getitem__
        return [np.frombuffer(b"".join([*map(ids_of, units), end]), np.int32) for units in parts]


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    """One per worker and vocabulary."""
    return Merger(path)


def encode_texts(
    docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, decode: bool = True
) -> DataFrame:
    """The columns ``keep`` (all but the text, if not given), ``ids`` with the end id and
    ``decoded`` (the library's decode(ids)).

    ``model_path`` is a vocabulary file that every worker can open.

    * A null or empty text has the end id alone and decodes to "".
    * Long texts are handled whole; rows are independent, so ids may be null or repeated.
    * Columns of ``docs`` named like an output column are replaced. An empty table gives an empty one.
    """
    made = ("ids", "decoded")
    names = [c for c in (keep if keep is not None else docs.columns) if c not in (text_col, *made)]
    source = docs.select(*names, F.coalesce(F.col(text_col), F.lit("")).alias("_sp_text"))
    fields = [docs.schema[c] for c in names] + [
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        *([T.StructField("decoded", T.StringType())] if decode else []),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merger(model_path)
        for batch in batches:
            start, texts = 0, batch.column(len(names))
            sizes = pc.utf8_length(texts).to_pylist()
            while start < len(sizes):
                end, chars = start, 0
                while end < len(sizes) and (end == start or chars + sizes[end] <= SLICE_CHARS):
                    chars += sizes[end]
                    end += 1
                ids = model.encode(texts.slice(start, end - start).to_pylist())
                at = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=at[1:])
                columns = [batch.column(i).slice(start, end - start) for i in range(len(names))]
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids))))
                if decode:
                    columns.append(pa.array([model.library.decode(x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
                start = end

    return source.mapInArrow(run, T.StructType(fields))
