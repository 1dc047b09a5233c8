"""Token ids of whole texts, with a table of the pieces that a tokenizer treats on their own.

A tokenizer cuts a text into pieces by a pattern and encodes each by itself.  Here many texts are cut at once by array
operations on their bytes; a piece is known by its bytes, held in three 64-bit words, and looked up in an open hash
table; the tokenizers library encodes each piece that isn't there yet.  Texts with characters or special tokens for
which the pattern isn't known for sure go to the library whole, so the ids are always the library's own.
"""

from __future__ import annotations

import codecs
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ridgeline.llm.workers import cache

#: Pieces that a worker keeps.  A full table keeps those met again since they were learned; the ids don't depend on it.
PIECES = 1 << 20
#: Bytes of text cut at a time; a longer text is divided where a space stands between two letters.
TOGETHER = 1 << 20
#: Bytes of the longest piece in the table; a longer one is encoded each time.
LONG_PIECE = 24

_SPACE, _OTHER_SPACE, _LETTER, _NUMBER, _SIGN, _ODD = range(6)
#: Characters whose class and lower case are the same in all versions of Unicode in use; others are odd.
_LETTERS = r"A-Za-zªµºÀ-ÖØ-öø-įı-ɏЀ-џ぀-゚一-龥가-힣"
_NUMBERS = r"0-9²³¹¼-¾"
_SIGNS = r"!-/:-@\[-`{-~¡-©«-±´¶-¸»¿×÷‐-‧‰-⁃、。「-』！，：；？"
_ALPHABET_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_CUT = re.compile(rb"[A-Za-z](?= [A-Za-z])")
_ENCODERS: dict[str, PieceEncoder] = cache("encoders")


def _classes() -> np.ndarray:
    out = np.full(1 << 16, _ODD, np.uint8)
    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 1 << 16)]))
    for kind, members in ((_SIGN, _SIGNS), (_NUMBER, _NUMBERS), (_LETTER, _LETTERS), (_OTHER_SPACE, r"\n"), (_SPACE, " ")):
        out[[ord(c) for c in re.findall(f"[{members}]", every)]] = kind
    out[0x3040], out[0x3097:0x309B] = _ODD, _ODD  # not assigned, or marks that join with the letter before
    return out


_CLASSES = _classes()
_BYTES = _CLASSES[:256].tobytes()


def byte_alphabet() -> str:
    """The printable characters by which byte-level tokenizers write the 256 bytes."""
    free = (chr(256 + k) for k in range(256))
    return "".join(chr(b) if b in _ALPHABET_KEPT else next(free) for b in range(256))


def byte_kinds(b: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    out = np.frombuffer(bytearray(b.tobytes().translate(_BYTES)), np.uint8)
    lead = np.flatnonzero(b >= 0xC0)
    if len(lead):
        first = b[lead]
        two, three = lead[first < 0xE0], lead[(first >= 0xE0) & (first < 0xF0)]
        low = lambda at: (b[at] & 0x3F).astype(np.int64)
        kind = _CLASSES[((b[two] & 0x1F).astype(np.int64) << 6) | low(two + 1)]
        out[two] = out[two + 1] = kind
        kind = _CLASSES[((b[three] & 0x0F).astype(np.int64) << 12) | (low(three + 1) << 6) | low(three + 2)]
        out[three] = out[three + 1] = out[three + 2] = kind
        out[lead[first >= 0xF0]] = _ODD
    return out


def is_letter(kinds: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a letter; characters of no sure class beyond ASCII count as letters."""
    return (kinds == _LETTER) | ((kinds == _ODD) & (b >= 0x80))


def cut_pieces(b: np.ndarray, kinds: np.ndarray, first: np.ndarray, word_level: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of texts that begin at ``first`` and have no odd characters."""
    n = len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.maximum(kinds, _OTHER_SPACE)  # any white space is one class
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(own[1:], own[:-1], out=begin[1:])
    begin[first[first < n]] = True
    if word_level:
        begin |= (own == _NUMBER) & ((b & 0xC0) != 0x80)
    start = np.flatnonzero(begin)
    end = np.r_[start[1:], n]
    kind = own[start]
    opens = np.zeros(n + 1, bool)
    opens[first] = opens[n] = True
    goes_on = ~opens[end]  # the next run is in the same text
    space = kind == _OTHER_SPACE
    extra = np.zeros(0, np.int64)
    if not word_level:
        before = np.flatnonzero(space & goes_on)
        is_space = b[end[before] - 1] == 0x20
        # a space goes with what follows; another white character before a word is a piece of its own
        with_next = before[is_space]
        end[with_next] -= 1
        start[with_next + 1] -= 1
        alone = before[~is_space]
        alone = alone[end[alone] - start[alone] > 1]
        end[alone] -= 1
        extra = end[alone]
    # short forms that follow a word: ' with the letters after it
    at = np.flatnonzero((b[start] == 0x27) & (end - start == 1) & (kind == _SIGN) & goes_on)
    at = at[own[end[at]] == _LETTER]
    if len(at):
        room = np.minimum(end[at + 1] - end[at], 2)
        one, two = b[end[at]], np.where(room > 1, b[np.minimum(end[at] + 1, n - 1)], 0)
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, np.where(pair, 2, 0))
        end[at] += size
        start[at + 1] = np.maximum(start[at + 1], end[at])
    good = end > start
    if word_level:
        good &= ~space
        return start[good], end[good]
    start, end = start[good], end[good]
    if len(extra):
        place = np.searchsorted(start, extra)
        start, end = np.insert(start, place, extra), np.insert(end, place, extra + 1)
    return start, end


class PieceEncoder:
    """Encodes texts as the tokenizers library does by ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, pieces: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        ids = lambda x: self.library.encode(x, add_special_tokens=False).ids
        self.word_level = ids(" Bb") == ids("bb")
        if not self.word_level and ids("a b") != ids("a") + ids(" b"):
            raise ValueError(f"{path}: white space isn't treated as this encoder expects")
        # pieces are given to the same model one after another, written in the byte alphabet, in which no space occurs
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.CharDelimiterSplit(" ")
        self.plain.encode_special_tokens = True
        self.plain.model._resize_cache(0)
        self.alphabet = " " + byte_alphabet()[1:]  # NUL, which no piece has, divides them
        self.special = [x.content.lower().encode() for x in self.library.get_added_tokens_decoder().values()]
        suffix = self.plain.model.end_of_word_suffix or ""
        tokens = self.plain.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(tokens.values()) + 1, np.int64)
        for x, k in tokens.items():
            self.sizes[k] = len(x.removesuffix(suffix) if suffix else x)
        self.pieces = pieces
        # never more than three quarters full: what one part of the texts adds is less than TOGETHER
        self.table = np.full(1 << (4 * (pieces + TOGETHER) // 3).bit_length(), -1, np.int32)
        self.shift = np.uint64(65 - len(self.table).bit_length())
        self.known = 0
        self.room = min(pieces, 1 << 14)
        self.key = np.zeros((3, self.room), np.uint64)
        self.place = np.zeros((3, self.room), np.int32)  # first id, ids, the round it was learned in
        self.met = np.zeros(self.room, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.round = 0

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    # the table of pieces

    def _hash(self, key: np.ndarray) -> np.ndarray:
        x = (key[0] ^ (key[1] * _MIX[1]) ^ (key[2] * _MIX[2])) * _MIX[0]
        return ((x ^ (x >> np.uint64(29))) * _MIX[2] >> self.shift).astype(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 for those not known."""
        at, last = self._hash(key), len(self.table) - 1
        found = self.table[at]
        todo = np.flatnonzero(found >= 0)
        while len(todo):
            mine = found[todo]
            same = (self.key[0][mine] == key[0][todo]) & (self.key[1][mine] == key[1][todo]) & (self.key[2][mine] == key[2][todo])
            todo = todo[~same]
            at[todo] = (at[todo] + 1) & last
            found[todo] = self.table[at[todo]]
            todo = todo[found[todo] >= 0]
        return found

    def _enter(self, numbers: np.ndarray) -> None:
        at, last = self._hash(self.key[:, numbers]), len(self.table) - 1
        while len(numbers):
            free = self.table[at] < 0
            self.table[at[free]] = numbers[free]
            left = self.table[at] != numbers
            numbers, at = numbers[left], (at[left] + 1) & last

    def _forget(self) -> None:
        """Keep the pieces met again since they were learned, or of those the ones met last, half the table at most."""
        keep = np.flatnonzero(self.met[: self.known] > self.place[2][: self.known])
        if len(keep) > self.pieces // 2:
            keep = np.sort(keep[np.argsort(self.met[keep], kind="stable")[-self.pieces // 2 :]])
        first, n = self.place[0][keep], self.place[1][keep]
        starts = np.cumsum(n) - n
        ids = self.ids[np.repeat(first - starts, n) + np.arange(n.sum())]
        self.used, self.known = len(ids), len(keep)
        self.ids[: self.used] = ids
        self.key[:, : self.known] = self.key[:, keep]
        self.place[:, : self.known] = np.stack([starts, n, np.full(len(keep), self.round)])
        self.met[: self.known] = self.round
        self.table[:] = -1
        self._enter(np.arange(self.known))

    def _grow(self, pieces: int, ids: int) -> None:
        if self.known + pieces > self.room:
            self.room = max(2 * self.room, self.known + pieces)
            self.key, self.place = (np.concatenate([x, np.zeros((3, self.room - x.shape[1]), x.dtype)], axis=1) for x in (self.key, self.place))
            self.met = np.concatenate([self.met, np.zeros(self.room - len(self.met), np.int32)])
        if self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), ids), np.uint32)])

    def _by_library(self, joined: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of such sizes, divided by NUL, and how many each has; where they end is known by the bytes that the tokens stand for."""
        text = codecs.charmap_decode(joined, "strict", self.alphabet)[0]
        ids = np.asarray(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends, stops = np.cumsum(sizes), np.cumsum(self.sizes[ids])
        last = np.searchsorted(stops, ends)
        if len(stops) != (last[-1] + 1 if len(last) else 0) or (stops[last] != ends).any():
            raise ArithmeticError("tokens don't cover the pieces")
        return ids, np.diff(np.r_[0, last + 1])

    def _learn(self, key: np.ndarray, size: np.ndarray) -> None:
        """Enter distinct new pieces; those of a byte-level text may begin with a space."""
        padded = np.zeros((len(size), LONG_PIECE + 1), np.uint8)
        padded[:, :LONG_PIECE] = np.ascontiguousarray(key.T).view(np.uint8)
        ids, n = self._by_library(padded[np.arange(LONG_PIECE + 1) <= size[:, None]].tobytes()[:-1], size)
        self._grow(len(size), len(ids))
        new = np.arange(self.known, self.known + len(size))
        self.key[:, new] = key
        self.place[:, new] = np.stack([self.used + np.cumsum(n) - n, n, np.full(len(n), self.round)])
        self.met[new] = self.round
        self.ids[self.used : self.used + len(ids)] = ids
        self.known, self.used = self.known + len(size), self.used + len(ids)
        self._enter(new.astype(np.int32))

    def _numbers(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of pieces no longer than LONG_PIECE; ``data`` has as many bytes more at its end."""
        word = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        key = np.stack([word[start + 8 * k] & _MASK[np.clip(size - 8 * k, 0, 8)] for k in range(3)])
        found = self._find(key)
        new = np.flatnonzero(found < 0)
        if len(new):
            some = key[:, new]
            order = np.lexsort(some)
            some = some[:, order]
            pick = np.r_[True, (some[:, 1:] != some[:, :-1]).any(axis=0)]
            self._learn(some[:, pick], size[new[order[pick]]])
            found[new[order]] = self.known - pick.sum() + np.cumsum(pick) - 1
        self.met[found] = self.round
        return found

    def _encode(self, data: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that begin at ``first`` (the last entry is where all end), and where each text's ids end."""
        self.round += 1
        if self.known > self.pieces:
            self._forget()
        start, end = cut_pieces(data[: len(kinds)], kinds, first[:-1], self.word_level)
        size = end - start
        long = np.flatnonzero(size > LONG_PIECE)
        short = np.flatnonzero(size <= LONG_PIECE) if len(long) else slice(None)
        number = self._numbers(data, start[short], size[short])
        place, count = self.place[0][number].astype(np.int64), self.place[1][number].astype(np.int64)
        pool = self.ids
        if len(long):
            ids, n_long = self._by_library(b"\0".join(bytes(data[a:z]) for a, z in zip(start[long].tolist(), end[long].tolist())), size[long])
            pool = np.concatenate([pool[: self.used], ids])
            places, counts = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            places[short], counts[short] = place, count
            places[long], counts[long] = self.used + np.cumsum(n_long) - n_long, n_long
            place, count = places, counts
        total = np.r_[0, np.cumsum(count)]
        out = pool[np.repeat(place - total[:-1], count) + np.arange(total[-1])]
        return out, total[np.searchsorted(start, first[1:])]

    def _parts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text in ``(ids, ends)`` blocks."""
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOGETHER, "right")) - 1)
            some = pc.fill_null(texts.slice(at, to - at), "")
            # the library lowers İ to two characters, which Arrow doesn't: a character of the odd class in its place
            lower = pc.utf8_lower(pc.replace_substring(some, "İ", "\U00010000")) if self.word_level else some
            first = np.frombuffer(lower.buffers()[1], np.int64, len(lower) + 1, 8 * lower.offset)
            a, z = int(first[0]), int(first[-1])
            first = first - a
            data = np.zeros(z - a + LONG_PIECE + 8, np.uint8)
            if z > a:
                data[: z - a] = np.frombuffer(lower.buffers()[2], np.uint8)[a:z]
            odd = np.zeros(to - at, bool)
            kinds = byte_kinds(data[: z - a])
            places = np.flatnonzero(kinds == _ODD)
            odd[np.unique(np.searchsorted(first, places, "right") - 1)] = True
            raw = data[: z - a].tobytes()
            text = raw if self.word_level else raw.lower()
            for x in self.special:
                k = text.find(x)
                while k >= 0:
                    odd[np.searchsorted(first, k, "right") - 1] = True
                    k = text.find(x, k + 1)
            if not odd.any() and z - a <= 2 * TOGETHER:
                yield self._encode(data, kinds, first)
            else:
                for k in range(at, to):
                    if odd[k - at]:
                        ids = self.whole(some[k - at].as_py())
                    else:
                        ids = self._long(raw[first[k - at] : first[k - at + 1]])
                    yield ids, np.array([len(ids)])
            at = to

    def _long(self, raw: bytes) -> np.ndarray:
        """The ids of one text, cut where a space stands between two letters, so that a part is of bounded size."""
        out, at = [], 0
        while at < len(raw):
            found = _CUT.search(raw, at + TOGETHER)
            to = found.end() if found else len(raw)
            data = np.frombuffer(raw[at:to] + bytes(LONG_PIECE + 8), np.uint8)
            out.append(self._encode(data, byte_kinds(data[: to - at]), np.array([0, to - at]))[0])
            at = to
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, NULL being empty, as little-endian unsigned 32-bit integers."""
        for ids, ends in self._parts(texts):
            raw = ids.astype("<u4", copy=False).tobytes()
            start = 0
            for end in (4 * ends).tolist():
                yield raw[start:end]
                start = end

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        return self.encode_column(pa.array(list(texts), pa.large_string()))

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
