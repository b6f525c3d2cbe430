"""Byte-level BPE by backtracking over longest matches.

The plain merge loop is quadratic in the length of a piece. Here an
Aho-Corasick automaton lists every vocabulary entry at every place, the encoder
walks from the start taking the longest entry, and a pair table says whether
two neighbours could stand side by side in the result of the merges. If they
couldn't, the next shorter entry is tried; a place from which nothing fits is
marked dead and never entered again, which keeps the walk linear.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata

import ahocorasick
import numpy as np

#: Pieces kept encoded by one Python worker before the store starts afresh.
CACHE_PIECES = 1_000_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k, from the installed package or its usual place."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.json"


def _ranges(categories: set[str]) -> str:
    out, start = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code)) in categories
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


@functools.cache
def piece_pattern() -> re.Pattern:
    """The public splitting pattern, spelled for ``re``.

    ``re`` has no ``\\p{L}``; letters are its word characters less the
    underscore and every number, and white space is Unicode's White_Space.
    """
    number = f"\\d{_ranges({'Nl', 'No'})}"
    letter = f"[^\\W_{number}]"
    # Chinese numerals are letters to Unicode although Python calls them numeric; Lo isn't in the ranges.
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?[{number}]+"
        f"| ?(?:[^{space}\\w{number}]|_)+|[{space}]+(?![^{space}])|[{space}]+"
    )


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    for i, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + i)
    return [letters[b] for b in range(256)]


class _Pieces(dict):
    """Piece of text -> its ids as little-endian int32 bytes, filled on demand."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = np.asarray(self._encode(piece), dtype="<i4").tobytes()
        if len(piece) <= 64:  # very long pieces don't come again
            self[piece] = ids
        return ids


class ByteBpe:
    """Encoder and decoder of one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        letters = _byte_letters()
        self._to_letters = {b: letters[b] for b in range(256)}
        size = max(vocab.values()) + 1
        # A merge made of (head, tail); a single byte is its own head and tail.
        self._head, self._tail = list(range(size)), list(range(size))
        self._joined: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            whole = vocab[left + right]
            pair = (vocab[left], vocab[right])
            self._joined[pair] = whole
            self._head[whole], self._tail[whole] = pair
        special = {"<|endoftext|>"}
        self._vocab = {t: i for t, i in vocab.items() if t not in special}
        self._automaton = ahocorasick.Automaton()
        for token, i in self._vocab.items():
            self._automaton.add_word(token, (len(token), i))
        self._automaton.make_automaton()
        self._compatible: dict[tuple[int, int], bool] = {}
        self._pieces = _Pieces(self.encode_piece)
        back = {c: b for b, c in enumerate(letters)}
        by_id = {i: bytes(back[c] for c in t) for t, i in self._vocab.items()}
        self._blob = b"".join(by_id.get(i, b"") for i in range(size))
        self._offset = np.concatenate([[0], np.cumsum([len(by_id.get(i, b"")) for i in range(size)])])

    def _can_stand(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` unjoined at their border.

        Undoes the merges of both sides, latest first; if at some time the two
        parts at the border had a merge earlier than the one undone last, it
        would have been made.
        """
        pair = (left, right)
        known = self._compatible.get(pair)
        if known is not None:
            return known
        latest, fits = 1 << 30, None
        while fits is None:
            joined = self._joined.get((left, right))
            if joined is not None and joined < latest:
                fits = False
            elif left > right and self._tail[left] != left:
                latest, left = left, self._tail[left]
            elif self._head[right] != right:
                latest, right = right + 1, self._head[right]
            elif self._tail[left] != left:
                latest, left = left, self._tail[left]
            else:
                fits = True
        if len(self._compatible) < 4_000_000:
            self._compatible[pair] = fits
        return fits

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece of the splitting pattern."""
        text = piece.encode("utf-8").decode("latin-1").translate(self._to_letters)
        whole = self._vocab.get(text)
        if whole is not None:
            return [whole]
        end = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(end)]
        for last, found in self._automaton.iter(text):  # shorter ones first at each start
            starts[last - found[0] + 1].append(found)
        dead = bytearray(end + 1)
        path: list[tuple[int, int, int]] = []
        at, choice = 0, len(starts[0]) - 1
        while at < end:
            here, before = starts[at], path[-1][2] if path else -1
            while choice >= 0:
                length, token = here[choice]
                if not dead[at + length] and (before < 0 or self._can_stand(before, token)):
                    break
                choice -= 1
            if choice >= 0:
                path.append((at, choice, token))
                at += length
                choice = len(starts[at]) - 1 if at < end else 0
            else:
                dead[at] = 1
                at, choice, _ = path.pop()
                choice -= 1
        return [token for _, _, token in path]

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian int32; none for null and empty."""
        if not text:
            return b""
        return b"".join(map(self._pieces.__getitem__, piece_pattern().findall(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<i4").tolist()

    def decode(self, ids) -> str:
        """Text of ids, by slices of one blob through the offset table."""
        offset, blob = self._offset, self._blob
        return b"".join(blob[offset[i] : offset[i + 1]] for i in ids).decode("utf-8", errors="replace")


@functools.cache
def encoder(path: str) -> ByteBpe:
    """The encoder of a file, built once in each Python worker."""
    return ByteBpe(path)
