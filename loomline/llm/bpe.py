"""Byte-level BPE as a streaming transducer, and its inverse."""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator

import regex

#: Splits text before the merges; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Merges:
    """A vocabulary of byte strings whose ids are their merge ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes = {i: b for b, i in self.ids.items()}
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._merged: dict[bytes, list[bytes]] = {}
        #: The sufficient look-ahead: no token that the merges can reach is longer, so one that is still to come begins at most so many bytes before the end.
        self.lookahead = next(len(t) for t in sorted(self.ids, key=len, reverse=True) if self.whole(t))

    def merge(self, piece: bytes) -> list[bytes]:
        """The tokens of a short piece, by applying the merges in order of rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ids.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            joined, out, i = parts[at] + parts[at + 1], [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == parts[at] and parts[i + 1] == parts[at + 1]:
                    out.append(joined)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether ``right`` may follow ``left``: the two, merged as one string, come out as themselves.

        A sequence of tokens is the encoding of its bytes just if each pair of
        neighbours fits, which is what lets a transducer decide locally.
        """
        pair = (left, right)
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            known = self._fits[pair] = self.merge(left + right) == [left, right]
        return known

    def whole(self, token: bytes) -> bool:
        """Whether a token is reached by merging its own bytes."""
        known = self._merged.get(token)
        if known is None:
            if len(self._merged) > 500_000:
                self._merged.clear()
            known = self._merged[token] = self.merge(token)
        return len(known) == 1


class PieceTransducer:
    """Encodes one piece fed byte by byte; emits ids as soon as no further byte can change them.

    For each end among the last ``lookahead`` bytes the last token of the
    prefix that ends there is kept: the one token that is whole and fits the
    last token of the prefix before it.  Every token still to come starts at
    one of these ends, so what all their chains have in common is stable; it
    is emitted and forgotten, and the state stays bounded.
    """

    def __init__(self, merges: Merges):
        self.m = merges
        self.base = 0  # the position of tail[0]
        self.tail = b""
        self.last: dict[int, tuple[int, bytes]] = {}  # end -> start and token
        self.origin = 0
        self.left: bytes | None = None  # the last token emitted
        self.at = 0

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for i in range(len(data)):
            self.tail += data[i : i + 1]
            self.at += 1
            self._close(self.at)
            if self.at - self.origin > 2 * self.m.lookahead and self.at % self.m.lookahead == 0:
                out += self._stable()
        return out

    def _close(self, end: int) -> None:
        for start in range(max(self.origin, end - self.m.lookahead), end):
            before = self.left if start == self.origin else self.last.get(start, (0, None))[1]
            if before is None and start != self.origin:
                continue
            token = self.tail[start - self.base : end - self.base]
            if token in self.m.ids and self.m.whole(token) and (before is None or self.m.fits(before, token)):
                self.last[end] = (start, token)
                return
        raise ValueError("the vocabulary lacks a byte")

    def _chain(self, end: int) -> list[tuple[int, bytes]]:
        chain = []
        while end > self.origin:
            start, token = self.last[end]
            chain.append((end, token))
            end = start
        return chain[::-1]

    def _emit(self, steps: Iterable[tuple[int, bytes]]) -> list[int]:
        out = []
        for end, token in steps:
            out.append(self.m.ids[token])
            self.origin, self.left = end, token
        self.tail = self.tail[self.origin - self.base :]
        self.base = self.origin
        self.last = {e: x for e, x in self.last.items() if e > self.origin}
        return out

    def _stable(self) -> list[int]:
        common = self._chain(self.at)
        for end in range(max(self.origin, self.at - self.m.lookahead), self.at):
            own = set(self._chain(end))
            while common and common[-1] not in own:
                common.pop()
        return self._emit(common)

    def finish(self) -> list[int]:
        return self._emit(self._chain(self.at))


class Encoder:
    """Texts to ids by ``StreamEncoder``; ids of pieces of ordinary length are remembered."""

    def __init__(self, merges: Merges, remembered: int = 400_000, short: int = 64):
        self.m, self.split, self.short = merges, regex.compile(PATTERN), short
        self.known: dict[str, tuple[int, ...]] = {}
        self.remembered = remembered

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one piece.  Up to ``short`` bytes the transducer would hold all back, so its merges are applied at once."""
        ids = self.known.get(text)
        if ids is None:
            raw = text.encode()
            if len(raw) <= self.short:
                ids = tuple(self.m.ids[x] for x in self.m.merge(raw))
                if len(self.known) >= self.remembered:
                    self.known.clear()
                self.known[text] = ids
            else:
                stream = PieceTransducer(self.m)
                ids = (*stream.feed(raw), *stream.finish())
        return ids

    def encode(self, text: str | None, chunk: int = 1 << 16) -> list[int]:
        """The ids of a text, which is read in parts of ``chunk`` characters."""
        out: list[int] = []
        if text:
            stream = StreamEncoder(self)
            for at in range(0, len(text), chunk):
                out += stream.feed(text[at : at + chunk])
            out += stream.finish()
        return out


class StreamEncoder:
    """Encodes a text that arrives in parts, holding back only what a later part can change.

    Pieces that have ended are encoded at once.  A piece that goes on for
    more than ``LONG`` characters is not gathered: its transducer takes it as
    it comes, so what is held is bounded whatever the text.
    """

    #: Characters after the end of a piece that the pattern looks at: two of a contraction.
    AHEAD, LONG = 3, 512
    _RUNS = tuple(regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+"))

    def __init__(self, encoder: Encoder):
        self.e, self.held = encoder, ""
        self.open: PieceTransducer | None = None
        self.run = self._RUNS[0]

    def feed(self, part: str) -> list[int]:
        out: list[int] = []
        if self.open is not None:
            part = self._extend(part, out)
            if self.open is not None:
                return out
        self.held += part
        last, done, piece = len(self.held) - self.AHEAD, 0, self.e.piece
        for m in self.e.split.finditer(self.held):
            end = m.end()
            if end > last:
                break
            out += piece(m.group())
            done = end
        self.held = self.held[done:]
        if len(self.held) > self.LONG:
            # what is left begins with one piece that has not ended
            first = self.e.split.match(self.held).group()
            self.run = next(r for r in self._RUNS if r.match(first[-1]))
            self.open, part, self.held = PieceTransducer(self.e.m), self.held, ""
            if first[0] == " " and self.run is not self._RUNS[2]:
                out += self.open.feed(b" ")
                part = part[1:]
            rest = self._extend(part, out)
            if self.open is None:
                self.held = rest
        return out

    def _extend(self, part: str, out: list[int]) -> str:
        """Give the open piece what of ``part`` belongs to it; what does not is returned, and the piece ended."""
        text, self.held = self.held + part, ""
        m = self.run.match(text)
        end = m.end() if m else 0
        # the last of a run of spaces may begin the next piece
        keep = 1 if self.run is self._RUNS[2] and end else 0
        out += self.open.feed(text[: end - keep].encode())
        if end == len(text):
            self.held = text[end - keep :] if keep else ""
            return ""
        out += self.open.finish()
        self.open = None
        return text[end - keep :]

    def finish(self) -> list[int]:
        held, self.held = self.held, ""
        if self.open is not None:
            out = [*self.open.feed(held.encode()), *self.open.finish()]
            self.open = None
            return out
        return [i for word in self.e.split.findall(held) for i in self.e.piece(word)]


def decode_stream(merges: Merges, ids: Iterable[int]) -> Iterator[str]:
    """Text of each id as soon as its characters are complete; broken sequences give U+FFFD."""
    state = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        if text := state.decode(merges.bytes[i]):
            yield text
    if text := state.decode(b"", True):
        yield text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per vocabulary file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Merges(path))
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), f"{name}.tiktoken")
