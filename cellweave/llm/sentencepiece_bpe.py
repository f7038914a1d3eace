"""SentencePiece BPE by vectorised merge rounds.

The distinct words of a slice of documents are encoded together. Their symbols lie in one flat numpy
array; each round looks up the rank of every adjacent pair, takes the least rank of each word
(segmented minimum) and merges, in all words at once, the leftmost pairs of that rank; the array is
compacted and words without a pair leave it, until none remains.

A round may merge every (non-overlapping, from the left) pair of a word's least rank if no merge of
that piece can bring forth a pair of the same or a better rank; for other pieces (`careful`) a round
merges the leftmost pair alone. So the order is the library's. Words beyond `LONG` symbols go through
the same rule with a heap, since a run of careful merges would need as many rounds as symbols.

Words: no piece holds a word mark after another character, nor a line break beside another
character (checked when a model is loaded), so a text can be cut before each run of marks and around
each line break. Nulls: a null text is empty and holds only begin and end; a null doc_id is passed
through; repeated rows each get a row; an empty table gives an empty result. Further columns of the
input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellweave.llm.common import slices
from cellweave.llm.pretoken import gather

MARK = "▁"
NONE = np.iinfo(np.int64).max
#: Symbols of a word from which on it is encoded by itself.
LONG = 2048
#: Distinct words that a worker keeps.
CACHE_WORDS = 500_000


class PieceModel:
    """Tables of a sentencepiece BPE model: characters, pairs, ranks, byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.bytes = np.asarray([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        usable = {sp.id_to_piece(i): i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if any(re.search(f"[^{MARK}]{MARK}|[^\\n]\\n|\\n[^\\n]", p) for p in usable):
            raise ValueError("a piece of this model crosses words")
        levels = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in usable.values()}, reverse=True))}
        self.rank = np.full(size, NONE)
        for i in usable.values():
            self.rank[i] = levels[sp.get_score(i)]
        # Symbols: ids of pieces, then characters that only occur inside pieces, then any other character by itself.
        self.symbol = {p: i for p, i in usable.items() if len(p) == 1}
        inside = sorted({c for p in usable for c in p} - set(self.symbol))
        self.symbol |= {c: size + k for k, c in enumerate(inside)}
        self.known = len(inside) + size
        self.size = size
        of = lambda s: usable.get(s, self.symbol.get(s) if len(s) == 1 else None)
        pairs, careful = {}, np.zeros(size, bool)
        for p, i in usable.items():
            for k in range(1, len(p)):
                left, right = p[:k], p[k:]
                if (a := of(left)) is not None and (b := of(right)) is not None:
                    pairs[(a, b)] = i
                for part in (left, right):
                    # Once the part stands, its neighbour may join it at the same or a better rank.
                    if len(part) > 1 and part in usable and self.rank[usable[part]] >= self.rank[i]:
                        careful[usable[part]] = True
        self.careful = careful
        keys = np.asarray([a * self.known + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.asarray(list(pairs.values()), np.int64)[order]
        self.words: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.words.clear()
        self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, -1 if there is none."""
        key = left * self.known + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left < self.known) & (right < self.known), self.made[at], -1)

    def _rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that remain of the words, and the word of each."""
        done_symbols, done_words = [], []
        # The piece and rank of the pair that starts at each symbol; only pairs beside a merge are looked up again.
        made = np.append(np.where(word[:-1] == word[1:], self.merged(symbols[:-1], symbols[1:]), -1), -1) if len(symbols) else symbols
        rank = np.where(made >= 0, self.rank[made], NONE)
        while len(symbols):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.append(first, len(word)))
            if (least == NONE).any():
                live = np.repeat(least < NONE, lengths)
                done_symbols.append(symbols[~live])
                done_words.append(word[~live])
                symbols, word, made, rank = symbols[live], word[live], made[live], rank[live]
                lengths, least = lengths[least < NONE], least[least < NONE]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            # Among pairs of one word that touch, every second one merges; a careful piece merges once a word.
            count = np.arange(len(at))
            nth = count - np.maximum.accumulate(np.where(np.append(True, np.diff(at) != 1), count, 0))
            leftmost = np.append(True, word[at[1:]] != word[at[:-1]])
            starts = np.flatnonzero(leftmost)
            has_careful = np.logical_or.reduceat(self.careful[made[at]], starts)
            once = np.repeat(has_careful, np.diff(np.append(starts, len(at))))
            at = at[np.where(once, leftmost, nth % 2 == 0)]
            symbols[at] = made[at]
            made[at], rank[at] = made[at + 1], rank[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word, made, rank = symbols[keep], word[keep], made[keep], rank[keep]
            now = at - np.arange(len(at))  # where the merged symbols stand after compaction
            again = np.concatenate([now, now[now > 0] - 1])
            again = again[again < len(symbols) - 1]
            again = again[word[again] == word[again + 1]]
            made[again] = found = self.merged(symbols[again], symbols[again + 1])
            rank[again] = np.where(found >= 0, self.rank[found], NONE)
        if not done_symbols:
            return symbols, word
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _heap(self, symbols: list[int]) -> list[int]:
        """One long word: the best pair first, the leftmost of equals."""
        n = len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        table = dict(zip(self.keys.tolist(), self.made.tolist(), strict=True)) if not hasattr(self, "_table") else self._table
        self._table = table
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and symbols[i] < self.known and symbols[j] < self.known and (m := table.get(symbols[i] * self.known + symbols[j])) is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, symbols[i], symbols[j], m))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            if not alive[i] or symbols[i] != a or (j := after[i]) >= n or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = m, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s, live in zip(symbols, alive, strict=True) if live]

    def _symbols(self, text: str) -> list[int]:
        get = self.symbol.get
        return [s if (s := get(c)) is not None else self.known + ord(c) for c in text]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has."""
        short = [w if len(w) <= LONG else "" for w in words]
        symbols = np.asarray(self._symbols("".join(short)), np.int64)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, short), np.int64, len(short)))
        symbols, word = self._rounds(symbols, word)
        long = [(k, np.asarray(self._heap(self._symbols(w)), np.int64)) for k, w in enumerate(words) if len(w) > LONG]
        if long:
            symbols = np.concatenate([symbols, *(s for _, s in long)])
            word = np.concatenate([word, *(np.full(len(s), k) for k, s in long)])
            order = np.argsort(word, kind="stable")
            symbols, word = symbols[order], word[order]
        odd = np.flatnonzero(symbols >= self.size)
        if len(odd):
            inside = {v: k for k, v in self.symbol.items() if v >= self.size}
            spelled = [(inside[s] if s < self.known else chr(s - self.known)).encode() for s in symbols[odd].tolist()]
            times = np.ones(len(symbols), np.int64)
            times[odd] = [len(b) for b in spelled]
            out = np.repeat(symbols, times)
            out[np.repeat(np.isin(np.arange(len(symbols)), odd), times)] = self.bytes[np.frombuffer(b"".join(spelled), np.uint8)]
            symbols, word = out, np.repeat(word, times)
        return symbols.astype(np.int32), np.bincount(word, minlength=len(words))

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with begin and end."""
        if len(self.words) > CACHE_WORDS:
            self.clear()
        cut = re.compile(f"\\n|{MARK}*[^{MARK}\\n]+|{MARK}+")
        words = [cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list(dict.fromkeys(w for ws in words for w in ws if w not in self.words))
        if new:
            flat, lengths = self.encode_words(new)
            base = len(self.lengths)
            self.words.update((w, base + k) for k, w in enumerate(new))
            self.flat, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])
        starts = np.cumsum(self.lengths) - self.lengths
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        rows = np.fromiter((self.words[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
        flat = gather(self.flat, starts[rows], self.lengths[rows])
        ends = np.append(0, np.cumsum(self.lengths[rows]))[np.cumsum(sizes)]
        edge = lambda i: np.asarray([i], np.int32)
        return [np.concatenate([edge(self.bos), part, edge(self.eos)]) for part in np.split(flat, ends[:-1])] if texts else []

    def decode_many(self, ids: list[np.ndarray]) -> list[str]:
        return [self.library.decode(x.tolist()) for x in ids]


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (list of int, with begin and end) and the decoded text of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            for part in slices(batch, 1):
                ids = pieces.encode_many([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(pieces.decode_many(ids), pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as encode, digested where the ids are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            for part in slices(batch, 1):
                ids = pieces.encode_many([t or "" for t in part.column(1).to_pylist()])
                decoded = pieces.decode_many(ids)
                hashed = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(hashed), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
