"""Token counts of a unigram tokenizer without building the tokens.

Aho-Corasick enumerates the vocabulary matches of a word; dynamic programming
over end positions carries the best score and the number of pieces. Ties go the
tokenizer's way: of paths of equal score to an end, the one whose last piece
starts first stays. Words (text between spaces, each led by the space mark)
don't influence each other, so a worker keeps the counts of words it has seen,
by hash, and walks the new words of a slice through the automaton together,
one character of all of them at a time. A long word is walked alone, with no
more of it held than the longest piece reaches back.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value: what an unknown character scores below the worst piece
LONG = 64  # characters
_BLANK = np.arange(256) == 0x20
TOGETHER = 1 << 19  # cells of the table of best scores


def load_pieces(model_path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file with the file's scores if it is a unigram model; else, as other models have no scores that add up, a Zipf law over the ids: -log(id + 1)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    scores = [model.get_score(i) for i in range(len(names))]
    whole = all(float(s).is_integer() for s in scores)  # ranks or nothing: not log probabilities
    return [(name, -math.log(i + 1.0) if whole else score) for i, (name, score) in enumerate(zip(names, scores))]


class Automaton:
    """Aho-Corasick over characters as arrays: state 0 is the root."""

    def __init__(self, scores: dict[str, float]):
        step: list[dict[str, int]] = [{}]
        length, score = [0], [0.0]
        for piece, value in scores.items():
            at = 0
            for char in piece:
                if char not in step[at]:
                    step[at][char] = len(step)
                    step.append({})
                    length.append(0)
                    score.append(0.0)
                at = step[at][char]
            length[at], score[at] = len(piece), value
        fail, found = [0] * len(step), [0] * len(step)  # found: the longest piece that ends here
        todo = deque([0])
        while todo:
            at = todo.popleft()
            found[at] = at if length[at] else found[fail[at]]
            for char, to in step[at].items():
                back = fail[at]
                while at and back and char not in step[back]:
                    back = fail[back]
                fail[to] = step[back].get(char, 0) if at else 0
                todo.append(to)
        rows = sorted((at << 21 | ord(char), to) for at, row in enumerate(step) for char, to in row.items())
        self.keys = np.array([k for k, _ in rows] + [2**62], dtype=np.int64)
        self.to = np.array([t for _, t in rows] + [0], dtype=np.int64)
        self.fail, self.found = np.array(fail), np.array(found)
        self.length, self.score = np.array(length), np.array(score)
        self.shorter = self.found[self.fail]  # the next shorter piece that ends there too
        self.longest = max(length)

    def advance(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state), dtype=np.int64)
        open_ = np.arange(len(state))
        at = state
        while len(open_):
            key = at << 21 | char[open_]
            place = np.searchsorted(self.keys, key)
            hit = self.keys[place] == key
            out[open_[hit]] = self.to[place[hit]]
            rest = ~hit & (at > 0)
            open_, at = open_[rest], self.fail[at[rest]]
        return out


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True, keep: int = 1 << 19):
        self.scores = {piece: score for piece, score in pieces if piece}
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback and all(f"<0x{b:02X}>" in self.scores for b in range(256))
        self.automaton = Automaton(self.scores)
        self.keep = keep
        self.seen: dict[int, int] = {}

    def _together(self, chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Pieces of each word chars[start : start + size]; the longest first."""
        auto, n, most = self.automaton, len(size), int(size[0])
        best = np.full((most + 1, n), -np.inf)
        count, last_unknown = np.zeros((most + 1, n), dtype=np.int32), np.zeros((most + 1, n), dtype=bool)
        best[0] = 0.0
        state = np.zeros(n, dtype=np.int64)
        for end in range(1, most + 1):
            m = int(np.searchsorted(-size, -end, side="right"))  # words that reach so far
            char = chars[start[:m] + end - 1]
            state = auto.advance(state[:m], char)
            top, pieces, single = best[end], count[end], np.zeros(m, dtype=bool)
            open_, at = np.arange(m), auto.found[state]
            while len(open_):
                hit = at > 0
                open_, at = open_[hit], at[hit]
                if not len(open_):
                    break
                length = auto.length[at]  # the longest first: its piece starts first
                total = best[end - length, open_] + auto.score[at]
                single[open_[length == 1]] = True
                better = total > top[open_]
                mine = open_[better]
                top[mine], pieces[mine] = total[better], count[end - length[better], mine] + 1
                at = auto.shorter[at]
            alone = np.flatnonzero(~single)
            if len(alone):
                total = best[end - 1, alone] + self.unknown
                better = total > top[alone]
                mine = alone[better]
                if self.byte_fallback:
                    more = 1 + (char[mine] > 0x7F) + (char[mine] > 0x7FF) + (char[mine] > 0xFFFF)
                else:
                    more = 1 - last_unknown[end - 1, mine]
                top[mine], pieces[mine] = total[better], count[end - 1, mine] + more
                last_unknown[end, mine] = True
        return count[size, np.arange(n)]

    def _alone(self, chars: np.ndarray) -> int:
        """Pieces of one long word."""
        auto, reach = self.automaton, self.automaton.longest
        held = deque([(0.0, 0, False)], maxlen=reach + 1)  # score, pieces, whether the last one is unknown; up to the character before
        keys = dict(zip(auto.keys.tolist(), auto.to.tolist()))
        fail, found, shorter, length, score = (x.tolist() for x in (auto.fail, auto.found, auto.shorter, auto.length, auto.score))
        state = 0
        for s in range(0, len(chars), 1 << 16):
            for char in chars[s : s + (1 << 16)].tolist():
                while (to := keys.get(state << 21 | char)) is None and state:
                    state = fail[state]
                state = to or 0
                top, single, at = None, False, found[state]
                while at:
                    before = held[-length[at]]
                    single = single or length[at] == 1
                    total = before[0] + score[at]
                    if top is None or total > top[0]:
                        top = (total, before[1] + 1, False)
                    at = shorter[at]
                if not single:
                    before = held[-1]
                    total = before[0] + self.unknown
                    if top is None or total > top[0]:
                        more = len(chr(char).encode("utf-8", "surrogatepass")) if self.byte_fallback else 0 if before[2] else 1
                        top = (total, before[1] + more, True)
                held.append(top)
        return held[-1][1]

    def _count(self, chars: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Pieces of words that stand one after the other in chars."""
        start = np.cumsum(size) - size
        out = np.zeros(len(size), dtype=np.int64)
        for i in np.flatnonzero(size > LONG):
            out[i] = self._alone(chars[start[i] : start[i] + size[i]])
        order = np.argsort(-size, kind="stable")
        order = order[size[order] <= LONG]
        at = 0
        while at < len(order):
            mine = order[at : at + max(1, TOGETHER // (int(size[order[at]]) + 1))]
            out[mine] = self._together(chars, start[mine], size[mine])
            at += len(mine)
        return out

    def texts(self, texts) -> np.ndarray:
        """Pieces of each text (an Arrow array of strings)."""
        buf, offsets = tk.flat(texts)
        out = np.zeros(len(offsets) - 1, dtype=np.int64)
        for doc, piece, at in tk.word_pieces(buf, offsets, space=_BLANK):
            out[doc : doc + len(at) - 1] += self._texts(piece, at)
        return out

    def _texts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not len(buf):
            return np.zeros(n, dtype=np.int64)
        mark = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81)) if len(buf) > 2 else np.zeros(0, np.int64)
        space = np.flatnonzero(buf == 0x20)
        lo = np.sort(np.concatenate([offsets[:-1], space + 1, mark + 3]))
        hi = np.sort(np.concatenate([space, mark, offsets[1:]]))
        first = np.searchsorted(np.sort(np.concatenate([space, mark])), offsets) + np.arange(n + 1)  # of each text's parts
        doc = np.repeat(np.arange(n), np.diff(first))
        use = np.ones(len(lo), dtype=bool)
        use[first[:-1]] = lo[first[:-1]] < hi[first[:-1]]  # an empty part counts unless it is a text's first
        lo, hi, doc = lo[use], hi[use], doc[use]
        h = tk.span_hash(tk.prefix_hash(buf), lo, hi) ^ tk.mix64((hi - lo).astype(np.uint64))
        words, at, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.seen) + len(words) > self.keep:
            self.seen.clear()
        names = words.tolist()
        counts = np.array([self.seen.get(x, -1) for x in names], dtype=np.int64)
        new = np.flatnonzero(counts < 0)
        if len(new):
            lo, hi = lo[at[new]], hi[at[new]]
            begins = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # characters before each byte
            size = begins[hi] - begins[lo]
            raw = buf.tobytes()
            chars = MARK + MARK.join([raw[a:b].decode("utf-8", "replace") for a, b in zip(lo.tolist(), hi.tolist())])
            counts[new] = self._count(np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64), size + 1)
            self.seen.update((names[i], c) for i, c in zip(new.tolist(), counts[new].tolist()))
        return np.bincount(doc, counts[which], n).astype(np.int64)

    def text(self, text: str) -> int:
        return int(self.texts(pa.array([text], pa.large_string()))[0])


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_tokens: pieces of each whole text. Null or empty text: 0.

    Rows that repeat are counted each; other columns are left out. An unknown
    character counts its bytes where the vocabulary has all byte pieces, else
    a run of unknown characters counts 1. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Counter(pieces, byte_fallback))  # a vocabulary, whatever the corpus

    def count(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sent.value.texts(part.column("text")))], names=["doc_id", "n_tokens"])
        tk.release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_tokens long")
