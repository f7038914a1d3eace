"""Pre-token caches over public tokenizer files.

A text made only of characters on which every regular-expression library agrees ("plain") is cut by
``re`` and each distinct pre-token is encoded once. Any other text, or one that holds a special string, is
cut by the file's own normalizer and pre-tokenizer where counts are asked for, and encoded whole by the
tokenizers library where ids are. All ways give the library's ids.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import Counter
from functools import cached_property, lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# ASCII, Latin letters and general punctuation, without digits that aren't decimal, odd spaces and the dotted capital I.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-įı-ɏ‐-‧‰-‸]*")
# How the two tokenizer files cut a text, for plain texts.
_BYTE_PATTERN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
_WORD_PATTERN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+""")

#: Distinct pre-tokens that a worker keeps for good: frequent ones come early. Later ones stay until RECENT_ENTRIES of them are held.
CACHE_ENTRIES, RECENT_ENTRIES = 500_000, 150_000
#: Longer pieces are not kept.
LONG_PIECE = 200


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class OddSizes(dict):
    """Pre-token as the file's own pre-tokenizer writes it -> how many ids it has."""

    def __init__(self, library):  # noqa: ANN001
        super().__init__()
        self.library = library

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[piece] = n = len(self.library.model.tokenize(piece))
        return n

    def count(self, part: str) -> int:
        """Ids of a text without special strings: frequencies of its pre-tokens times the size of each distinct one."""
        normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
        times = Counter(piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)) if normal else {}
        return sum(n * self[piece] for piece, n in times.items())


class PretokenTable(dict):
    """Pre-token -> row of a growing table of ids (or of id counts only)."""

    def __init__(self, path: str, counts_only: bool = False):
        super().__init__()
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        self.lower = spec["normalizer"] is not None
        self.pattern = _WORD_PATTERN if self.lower else _BYTE_PATTERN
        self.counts_only = counts_only
        self.suffix, self.encode_piece, self.encode_text, self.id_of = b"", None, None, None
        self._ranked(spec["model"])
        self.id_list = self.id_of.tolist() if self.id_of is not None else []
        self.lengths, self.flat = array("i"), array("i")
        self.recent: dict[str, int] = {}
        self.kept = 0, 0

    @cached_property
    def library(self):  # noqa: ANN201
        """The file's own tokenizer, loaded when a text or the file needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def odd(self) -> OddSizes:
        """Sizes of the pre-tokens of texts that aren't plain."""
        return OddSizes(self.library)

    def odd_count(self, text: str) -> int:
        """Ids of any text: a special string is one id, what lies between them is counted by pre-tokens."""
        parts = re.split("|".join(map(re.escape, self.special)), text) if self.special else [text]
        return len(parts) - 1 + sum(self.odd.count(p) for p in parts if p)

    def _ranked(self, model: dict) -> None:
        """A ranks-by-id encoder of the same vocabulary, if the file's merges are in the order of its ids."""
        import public_tokenizers
        import tiktoken

        byte, end = _byte_of_char(), model["end_of_word_suffix"] or ""

        def raw(token: str) -> bytes:
            # No UTF-8 text holds the byte FF: it stands for the end of a word.
            body = token.removesuffix(end) if end else token
            return bytes(byte[c] for c in body) + b"\xff" * (body != token)

        unused = {c for c, b in byte.items() if b == 255} if end else set()
        ids = {raw(s): i for s, i in model["vocab"].items() if s not in self.special and not unused & set(s)}
        made = [ids[raw(a + b)] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        single = [i for s, i in ids.items() if len(s.removesuffix(b"\xff") if end else s) == 1]
        if made != sorted(made) or (made and made[0] <= max(single, default=0)):
            return
        # A word's last byte joins its end before any merge, so those tokens rank right after the single bytes.
        order = sorted(ids, key=lambda s: (ids[s] not in single_set, len(s) if ids[s] in single_set else 0, ids[s])) if (single_set := set(single)) else []
        order = [bytes([255])] * bool(end) + order
        ranks = {s: r for r, s in enumerate(order)}
        if any(bytes([b]) not in ranks for b in range(256)):
            return
        self.suffix = b"\xff" * bool(end)
        self.id_of = np.asarray([ids.get(s, -1) for s in order], np.int32)
        encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode_piece = encoder._encode_single_piece
        self.encode_text = None if end else encoder.encode_to_numpy

    def add(self, got: list[int]) -> int:
        """A new row of the table."""
        self.lengths.append(len(got))
        if not self.counts_only:
            self.flat.extend(got)
        return len(self.lengths) - 1

    def __missing__(self, piece: str) -> int:
        row = self.recent.get(piece)
        if row is None:
            if self.encode_piece is None:
                got = self.library.encode(piece, add_special_tokens=False).ids
            elif len(piece) > LONG_PIECE:
                return self.add(self.library.encode(piece, add_special_tokens=False).ids)
            else:
                got = [r for p in self.pieces(piece) for r in self.encode_piece(p.encode() + self.suffix)]
                if not self.counts_only:
                    got = [self.id_list[r] for r in got]
            row = self.add(got)
            if len(self) < CACHE_ENTRIES:
                self[piece] = row
                self.kept = len(self.lengths), len(self.flat)
            else:
                self.recent[piece] = row
        return row

    def pieces(self, key: str) -> list[str]:
        """The pre-tokens that a row stands for."""
        return self.pattern.findall(key) if self.lower else [key]

    def room(self) -> None:
        """Drop the late rows if there are many."""
        if len(self.recent) > RECENT_ENTRIES:
            self.recent.clear()
            self.cut(*self.kept)

    def cut(self, rows: int, ids: int) -> None:
        del self.lengths[rows:], self.flat[ids:]

    def plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def rows(self, text: str) -> np.ndarray:
        """Table rows of a plain text's pre-tokens, in order.

        Where white space only separates, a row stands for all pre-tokens between two spaces: splitting is cheaper than matching.
        """
        cut = text.lower().split() if self.lower else self.pattern.findall(text)
        return np.fromiter(map(self.__getitem__, cut), np.int64, len(cut))

    def rows_of(self, texts: list[str]) -> tuple[list[np.ndarray], tuple[int, int]]:
        """Rows of all texts, a text that isn't plain having one row of its own; and where those rows begin, to be cut off after use."""
        self.room()
        plain = [bool(t) and self.plain(t) for t in texts]
        out = [self.rows(t) if ok else np.zeros(0, np.int64) for t, ok in zip(texts, plain, strict=True)]
        end = len(self.lengths), len(self.flat)
        for k, (t, ok) in enumerate(zip(texts, plain, strict=True)):
            if t and not ok:
                out[k] = np.asarray([self.add(self.library.encode(t, add_special_tokens=False).ids)])
        return out, end

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and how many each text has."""
        if self.encode_text is not None:
            parts = [(self.id_of[self.encode_text(t)] if self.plain(t) else np.asarray(self.library.encode(t, add_special_tokens=False).ids, np.int32)) if t else np.zeros(0, np.int32) for t in texts]
            return np.concatenate(parts or [np.zeros(0, np.int32)]), np.asarray([len(p) for p in parts], np.int64)
        rows, end = self.rows_of(texts)
        sizes = np.array(self.lengths, np.int64)
        starts = np.cumsum(sizes) - sizes
        every = np.concatenate(rows or [np.zeros(0, np.int64)])
        out = gather(np.array(self.flat, np.int32), starts[every], sizes[every])
        self.cut(*end)
        return out, np.asarray([int(sizes[r].sum()) for r in rows], np.int64)

    def count_many(self, texts: list[str]) -> list[int]:
        """The number of ids of each text: pre-token frequencies times the size of each distinct pre-token."""
        self.room()
        plain = [self.plain(t) for t in texts]
        rows = [self.rows(t) if ok else None for t, ok in zip(texts, plain, strict=True)]
        sizes, out = np.array(self.lengths, np.int64), []
        for text, own in zip(texts, rows, strict=True):
            if own is None:
                out.append(self.odd_count(text))
            else:
                piece, times = np.unique(own, return_counts=True)
                out.append(int(sizes[piece] @ times))
        return out


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[s : s + n] one after another."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(lengths) - lengths
    return flat[np.arange(total) + np.repeat(starts - before, lengths)]


@lru_cache(maxsize=4)
def table(path: str, counts_only: bool = False) -> PretokenTable:
    """The worker's table for a file."""
    return PretokenTable(path, counts_only)
