"""Byte-pair merging for word-end vocabularies, on the executors.

``MergeCounter`` counts tokens without making identifiers: a heap of adjacent pairs by merge rank
over a linked list of symbols. ``WordEncoder`` gives identifiers through the tokenizers library.
Both rely on this: the normaliser only composes characters, folds case and squeezes white space, and the
splitter never crosses white space, so the tokens of a text are those of its ASCII-white-space words in turn.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
import unicodedata

from confluo.llm.common import KEPT, Memo, release

WORD_BOUND, PIECE_BOUND = 20_000, 150_000
#: What a worker's memos may hold while others work.
IDLE_BOUND = 50_000
#: Up to here letters and digits are the same in all versions of Unicode, nothing composes, and one letter's lower case is one letter.
_LAST = 0x17F
_RANGE = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, _LAST + 1)) if c != 0x130]
_PLAIN = re.compile(f"[\\t\\n\\r{re.escape(''.join(_RANGE))}]*")
_L, _N = (re.escape("".join(c for c in _RANGE if unicodedata.category(c)[0] == k)) for k in "LN")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\t\\n\\r {_L}{_N}]+")


#: Bytes that aren't printable get letters from 256 on, in order; the others stand for themselves.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def plain_pieces(text: str) -> list[str] | None:
    """The pre-tokens of a text of common Latin characters without special strings; None for any other text."""
    if "<|" in text or not _PLAIN.fullmatch(text):
        return None
    return _PIECES.findall(text.lower())


def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class MergeCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: pair of symbols -> (rank, merged symbol)
        self.ranks = {p: (i, p[0] + p[1]) for i, p in enumerate(pairs)}
        tok = _load(path)
        self.normalize, self.pre = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        self.words, self.pieces, self.byte_pieces = Memo(self._word, WORD_BOUND), Memo(self._letters, PIECE_BOUND), Memo(self._piece, WORD_BOUND)

    def _piece(self, piece: str) -> int:
        """Tokens of one pre-token in byte letters: its symbols less the merges done on it."""
        left = list(piece)
        if not left:
            return 0
        left[-1] += self.suffix
        left = [s for s in left if s in self.vocab]
        n = len(left)
        ranks, before, after = self.ranks, list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r[0], i, left[i], left[i + 1]) for i in range(n - 1) if (r := ranks.get((left[i], left[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if left[i] is not None else n
            if j >= n or left[i] != a or left[j] != b:
                continue  # one side has merged meanwhile
            left[i], left[j] = ranks[a, b][1], None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((left[i], left[k])):
                    heapq.heappush(heap, (r[0], i, left[i], left[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((left[h], left[i]))):
                heapq.heappush(heap, (r[0], h, left[h], left[i]))
        return n - merges

    def _plain(self, text: str) -> int:
        return sum(self.byte_pieces[p] for p, _ in self.pre(self.normalize(text)))

    def _word(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        if self.split_special and "<|" in text:
            return sum(1 if i % 2 else self._plain(part) for i, part in enumerate(self.split_special.split(text)) if part)
        return self._plain(text)

    def _letters(self, piece: str) -> int:
        return sum(self.byte_pieces[p] for p, _ in self.pre(piece))

    def count(self, text: bytes) -> int:
        pieces = plain_pieces(text.decode("utf-8", "replace"))
        return sum(map(self.words.__getitem__, text.split())) if pieces is None else sum(map(self.pieces.__getitem__, pieces))


class WordEncoder:
    """Identifiers of whole texts as little-endian uint32 bytes."""

    def __init__(self, path: str):
        self.tok = _load(path)
        self.words, self.pieces = Memo(self._word, WORD_BOUND), Memo(self._letters, PIECE_BOUND)
        self.model = self.tok.model

    def _encode(self, text: str) -> bytes:
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _letters(self, piece: str) -> bytes:
        """A pre-token by the model alone, in the letters that stand for its bytes."""
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_LETTERS))])

    def _word(self, word: bytes) -> bytes:
        return self._encode(word.decode("utf-8", "replace"))

    def encode(self, text: bytes) -> bytes:
        pieces = plain_pieces(text.decode("utf-8", "replace"))
        return b"".join(map(self.words.__getitem__, text.split())) if pieces is None else b"".join(map(self.pieces.__getitem__, pieces))


def once(kind, path: str):
    """One object a worker process and file, kept between the tasks of a stage; what earlier stages left goes first."""
    if (kind, path) not in KEPT:
        release()
        KEPT[kind, path] = kind(path)
    return KEPT[kind, path]


def rest() -> None:
    """At the end of a task: workers take turns, so each would keep full memos while others work. Small tasks go on with theirs."""
    if any(len(m) + len(m.older) > IDLE_BOUND for kept in KEPT.values() for m in vars(kept).values() if isinstance(m, Memo)):
        release()
