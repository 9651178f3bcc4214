"""Token ids of whole texts, exactly as the tokenizers library gives them.

The vocabulary splits a text at white space before anything else, so ids are
looked up chunk by chunk. Chunks of plain Latin-1 letters and signs go through
a bounded cache, piece by piece, straight to the BPE model; every other chunk,
and any text with control characters on whose class libraries differ, goes
through the library's own ``encode``.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import regex
import tiktoken
from tokenizers import Tokenizer

from .memory import cache

#: Control characters on whose class libraries differ.
_ODD = "\x1c\x1d\x1e\x1f"
_SLOW = regex.compile("[^\x00-\xff]|<\\|")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: How byte-level BPE of this kind cuts a text (a fixed value).
_SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space besides spaces and line feeds, and runs of white space.
_WIDE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
_KNOTS = (*_WIDE, "  ", "\n\n", " \n", "\n ")
_KNOT = regex.compile("[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Entries of a generation of a worker's cache (a full one replaces the older one), and characters of the longest chunk that it holds.
ENTRIES, SPACED_ENTRIES, LONGEST = 150_000, 250_000, 64


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Chunks(dict):
    """Ids of chunks and of the pieces they are made of, in two generations of at most ENTRIES each."""

    def __init__(self, tokenizer: Tokenizer, code: str) -> None:
        self.tokenizer, self.code, self.older = tokenizer, code, {}
        self.tokenize = tokenizer.model.tokenize
        self.table = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        #: Whether the text at hand has nothing but Latin-1 characters and no special token's opening.
        self.plain = False

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.table)
        return array(self.code, [t.id for t in self.tokenize(spelled)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            low = chunk.lower()
            if not self.plain and _SLOW.search(chunk):
                ids = self.whole(chunk)
            elif low.isalpha():
                ids = self.piece(low) if low == chunk else self[low]
            else:
                head, last = low[:-1], low[-1]
                if head.isalpha() and "!" <= last <= "~" and not last.isalnum():  # a word and one sign
                    ids = self[head] + self[last]
                else:
                    parts = _PIECES.findall(low)
                    ids = self.piece(chunk) if parts == [chunk] else b"".join([self[p] for p in parts])
        if len(chunk) <= LONGEST:
            if len(self) >= ENTRIES:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class WordEncoder:
    """Ids as little-endian unsigned integers of ``width`` bytes, 2 or 4 (in the order of bytes of every machine that Spark's Arrow exchange runs on)."""

    def __init__(self, path: str, width: int = 4, special: bool = True) -> None:
        tokenizer = Tokenizer.from_file(path)
        if not special:
            tokenizer.encode_special_tokens = True
        if tokenizer.get_vocab_size() > 1 << (8 * width):
            raise ValueError(f"ids of this vocabulary don't fit {width} bytes")
        self.width = width
        self.chunks = _Chunks(tokenizer, {2: "H", 4: "I"}[width])

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in _ODD):
            return self.chunks.whole(text)
        try:
            text.encode("latin-1")
            self.chunks.plain = "<|" not in text
        except UnicodeEncodeError:
            self.chunks.plain = False
        return b"".join(map(self.chunks.__getitem__, text.split()))


@lru_cache(maxsize=2)
def encoder(path: str, width: int = 4, special: bool = True) -> WordEncoder:
    """One encoder for each Python worker, kept between its tasks."""
    return WordEncoder(path, width, special)


class _Spaced(dict):
    """Ids of chunks in two generations of at most SPACED_ENTRIES each. A chunk stands for a space and what follows it up to the next white space, or for a line feed and what follows, if it begins with one."""

    def __init__(self, tokenizer: Tokenizer, ranks: tiktoken.Encoding) -> None:
        self.tokenizer, self.ranks, self.older = tokenizer, ranks.encode_ordinary, {}
        self.piece = ranks._core_bpe.encode_single_piece
        self.signs = {chr(c): self.whole(chr(c)) for c in range(33, 127)}
        self.line = self.whole("\n")

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if _SLOW.search(text) or any(c in text for c in _WIDE) else self.ranks(text)
        return array("H", ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            last = chunk[-1:]
            if chunk.isalpha() and (chunk.isascii() or max(chunk) <= "\xff"):  # one piece
                ids = array("H", self.piece(b" " + chunk.encode())).tobytes()
            elif last in self.signs and not last.isalnum() and chunk[:-1].isalpha():  # a word and one sign
                ids = self[chunk[:-1]] + self.signs[last]
            elif last and chunk[0] == "\n":
                word = chunk[1:]
                ids = self.line + array("H", self.piece(word.encode())).tobytes() if word.isascii() and word.isalpha() else self.whole(chunk)
            else:
                ids = self.whole(" " + chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= SPACED_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class ByteEncoder:
    """Ids of a byte-level BPE as little-endian unsigned integers of 2 bytes.

    A word takes over one space before it, so a text falls apart at single
    spaces and line feeds. Texts with longer runs of white space, or white
    space of other kinds, are encoded whole; characters beyond Latin-1 and
    special tokens are left to the library.
    """

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit 2 bytes")
        back = {c: b for b, c in _byte_letters().items()}
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(back[c] for c in token): i for token, i in tokenizer.get_vocab().items() if token not in special}
        self.chunks = _Spaced(tokenizer, tiktoken.Encoding("own", pat_str=_SPACED, mergeable_ranks=ranks, special_tokens={}))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(k in text for k in _KNOTS) or (not text.isascii() and _KNOT.search(text)):
            return self.chunks.whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return (self.chunks.whole(first) if first else b"") + b"".join(map(self.chunks.__getitem__, rest))


@lru_cache(maxsize=1)
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder for each Python worker, kept between its tasks."""
    return ByteEncoder(path)


def _clear() -> None:
    encoder.cache_clear()
    byte_encoder.cache_clear()


cache("tokens", _clear)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
