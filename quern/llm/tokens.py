"""Token ids of whole texts, encoding each distinct piece once.

The pre-tokenizers of both vocabularies never join what lies on two sides of a space between two characters
that are not white space, nor Latin letters and the punctuation behind them, so a text's ids are the ids of such pieces one after the
other.  The pieces of about half a megabyte of texts are cut and looked up with numpy in a compact table by their bytes, sixteen at once; those
not met before are encoded together.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from quern.llm.common import keep_in_worker, pieces

# Pieces in the table, at about 50 bytes each, before it starts anew; and other pieces kept as objects.
TABLE_PIECES = 1_500_000
_TABLE_BYTES = 1 << 30
CACHED_WORDS = 20_000
_AT_ONCE = 20_000
# The library is faster with a few pieces at a time, which stay in caches.
_MODEL_AT_ONCE = 200
_LEARN_CHARS = 1 << 19
# Spark runs a task on every core already; more threads of the library would only take turns.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
# White space other than space and line feed, in either Python's or the tokenizer's sense.
_ODD_SPACE = re.compile(r"[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


# A line feed or none, Latin letters that are their own canonical form, then punctuation: pieces of either pre-tokenizer.
_SIMPLE = re.compile("(\\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\\[-`{-~]*)")


def _byte_letters() -> str:
    """For each byte the letter that stands for it in byte-level vocabularies: itself, or one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    letters = dict(zip(shown, shown)) | {b: 256 + i for i, b in enumerate(others)}
    return "".join(chr(letters[b]) for b in range(256))


_LETTERS = _byte_letters()
# Their code points, where line feeds stand between pieces.
_POINTS = np.array([ord(c) for c in _LETTERS[:10] + " " + _LETTERS[11:]], "<u4")

# Kinds of pieces: a word of any other shape, letters after a space, letters after a line feed (with it), punctuation behind letters,
# letters at the start of a text, and any other shape there.
_OTHER, _WORD, _LINE, _TAIL, _START, _OPEN = range(6)


def _classes() -> bytes:
    """For each byte what it may be."""
    held = np.zeros(256, np.uint8)
    held[[*range(65, 91), *range(97, 123)]] |= _LETTER
    # Without "<", which may begin a special token.
    held[list(b"!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~")] |= _MARK
    held[[10, 32]] |= _GAP
    # First bytes of the UTF-8 of white space beyond ASCII; few texts have one.
    held[[*range(9), 9, 11, 12, 13, *range(14, 32), 0xC2, 0xE1, 0xE2, 0xE3]] |= _ODD_FIRST
    return held.tobytes()


_LETTER, _MARK, _GAP, _ODD_FIRST = 1, 2, 4, 8
_CLASSES = _classes()
# Longer pieces are looked up one by one.
_SHORT = 16
_MASKS = np.array([[(1 << 8 * min(max(n - at, 0), 8)) - 1 for n in range(_SHORT + 1)] for at in (0, 8)], np.uint64)
_LOW, _HIGH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[0] .. starts[0] + lengths[0] - 1, then those of the next range, and so on."""
    starts, lengths = starts.astype(np.int64), lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class _Buffer:
    """A growing array."""

    def __init__(self, dtype: str):
        self._held, self.size = np.zeros(1024, dtype), 0

    def append(self, new: np.ndarray) -> None:
        if self.size + len(new) > len(self._held):
            self._held = np.concatenate((self._held[: self.size], np.zeros(max(len(new), self.size // 4 + 1024), self._held.dtype)))
        self._held[self.size : self.size + len(new)] = new
        self.size += len(new)

    @property
    def all(self) -> np.ndarray:
        return self._held[: self.size]


class _Table:
    """Pieces by their bytes, length and kind, and the ids of each in one flat array.

    Each row has up to sixteen bytes of a piece, its length and kind, and where its ids begin and how many they are.  Rows are found by
    a hash over slots that go on to the next one when taken; those of longer pieces by a dictionary.
    """

    def __init__(self) -> None:
        self.rows, self.size = np.zeros((1024, 4), np.uint64), 0
        self.slots = np.full(4096, -1, np.int32)
        self.ids = _Buffer("<u4")
        self.long: dict[bytes, int] = {}
        self.bytes = 0

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The row of each piece of at most sixteen bytes, -1 if there is none."""
        at = self._places(hashes)
        found = self.slots[at].astype(np.int64)
        left = np.flatnonzero(self._differ(found, keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            found[left] = self.slots[at[left]]
            left = left[self._differ(found[left], keys[left]) & (found[left] >= 0)]
        return found

    def _differ(self, found: np.ndarray, keys: np.ndarray) -> np.ndarray:
        rows = self.rows.take(found, axis=0, mode="clip")
        return (rows[:, 0] != keys[:, 0]) | (rows[:, 1] != keys[:, 1]) | (rows[:, 2] != keys[:, 2])

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Add rows, whose ids follow each other, and give their numbers."""
        first, n = self.size, len(keys)
        if first + n > len(self.rows):
            self.rows = np.concatenate((self.rows[:first], np.zeros((max(n, first // 4 + 1024), 4), np.uint64)))
        self.rows[first : first + n, :3] = keys
        starts = (self.ids.size + np.cumsum(counts) - counts).astype(np.uint64)
        self.rows[first : first + n, 3] = starts << np.uint64(32) | counts.astype(np.uint64)
        self.ids.append(ids)
        self.bytes += 4 * len(ids)
        self.size += n
        return np.arange(first, first + n)

    def place(self, rows: np.ndarray) -> None:
        """Let ``find`` find these rows, no two of them alike."""
        if 2 * self.size > len(self.slots):
            rows = np.concatenate((self.slots[self.slots >= 0], rows))
            self.slots = np.full(2 * (1 << self.size.bit_length()), -1, np.int32)
        at = self._places(_hashes(self.rows[rows]))
        while len(rows):
            free = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[free]] = rows[free]
            left = np.flatnonzero(self.slots[at] != rows)
            rows, at = rows[left], (at[left] + 1) & (len(self.slots) - 1)


def _hashes(keys: np.ndarray) -> np.ndarray:
    hashes = keys[:, 0] * _LOW ^ (keys[:, 1] + keys[:, 2]) * _HIGH
    return (hashes ^ (hashes >> np.uint64(32))) * _MIX


class Encoder:
    """``ids`` gives the ids of a text, as the tokenizer without added special tokens would.

    ``separator`` is a special token of the vocabulary.  ``spaced`` tells that a space before a word
    belongs to the word's tokens and that case counts; otherwise white space only separates and texts are lower-cased.
    """

    def __init__(
        self, path: str, separator: str, spaced: bool, cached_words: int = CACHED_WORDS, table_pieces: int = TABLE_PIECES
    ):
        self.tokenizer = Tokenizer.from_file(path)
        # The same model over pieces in byte letters that spaces divide.
        self.model_only = Tokenizer(self.tokenizer.model)
        self.model_only.pre_tokenizer = CharDelimiterSplit(" ")
        self.separator, self.separator_id = separator, self.tokenizer.token_to_id(separator)
        self.spaced, self.cached_words, self.table_pieces = spaced, cached_words, table_pieces
        self.table = _Table()
        self.cache: dict[str, bytes] = {}  # words being learned
        self.pieces: dict[str, bytes] = {"": b""}
        # Letters of each token, without the mark of a word's end.
        ending = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        vocabulary = self.tokenizer.get_vocab()
        self.letters = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, number in vocabulary.items():
            self.letters[number] = len(token.removesuffix(ending))
        self.line = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, wanted: list[str]) -> None:
        """Encode new pieces, which the pre-tokenizer would leave whole, with line feeds between them."""
        new = [p for p in dict.fromkeys(wanted) if p not in self.pieces]
        if len(self.pieces) + len(new) > self.cached_words:
            self.pieces = {"": b""}
            new = [p for p in dict.fromkeys(wanted) if p]
        self._encode(self.pieces, new, new)

    def _encode(self, into: dict[str, bytes], keys: list[str], shown: list[str]) -> None:
        """Encode pieces by the model alone."""
        ids, counts = self._by_model([p.encode() for p in shown])
        raw, ends = ids.tobytes(), np.cumsum(counts) * 4
        into.update((k, raw[a:b]) for k, a, b in zip(keys, (ends - counts * 4).tolist(), ends.tolist()))

    def _by_model(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, which the pre-tokenizer would leave whole, by the model alone, and how many each has.

        Every byte is a letter of exactly one token, so that the letters tell the pieces apart.
        """
        found: list[int] = []
        for at in range(0, len(raw), _MODEL_AT_ONCE):
            letters = _POINTS[np.frombuffer(b"\n".join(raw[at : at + _MODEL_AT_ONCE]), np.uint8)].tobytes().decode("utf-32-le")
            found += self.model_only.encode_batch_fast([letters], add_special_tokens=False)[0].ids
        ids, ends = np.array(found, "<u4"), np.cumsum([len(r) for r in raw], dtype=np.int64)
        reached = np.concatenate(([0], np.cumsum(self.letters[ids])))
        stops = np.searchsorted(reached, ends)
        if reached[-1] != (ends[-1] if len(ends) else 0) or (reached[stops] != ends).any():
            raise ValueError("a piece was not encoded by itself")
        return ids, np.diff(stops, prepend=0)

    @staticmethod
    def _cut(into: dict[str, bytes], keys: list[str], ids: list[int], separator: int) -> None:
        """Keep the ids of each key, cut at the separators between them."""
        found = np.array(ids, "<u4")
        cuts = np.flatnonzero(found == separator)
        if len(cuts) != len(keys) - 1:
            raise ValueError("a separator was not encoded as one token")
        raw = found.tobytes()
        starts = [0, *((cuts + 1) * 4).tolist()]
        into.update((k, raw[a:b]) for k, a, b in zip(keys, starts, [*(cuts * 4).tolist(), len(raw)]))

    def _learn(self, words: list[str]) -> None:
        """Encode new words; a word's key is its text as it stands after a space."""
        cache, plain, direct, tailed, bare = self.cache, [], [], [], []
        for w in words:
            if w.isascii() and w.isalpha():
                direct.append(w)
                continue
            found = None if "<|" in w else _SIMPLE.fullmatch(w)
            if found:
                line, head, tail = found.groups()
                (bare if line else tailed if tail else direct).append((w, head, tail) if line or tail else w)
            elif "<|" in w:
                cache[w] = self._whole(w if not self.spaced or w[:1] == "\n" else " " + w)
            else:
                plain.append(w)
        # A word with punctuation behind it is the word and the punctuation.
        direct = list(dict.fromkeys([*direct, *(head for _, head, _ in tailed if head not in cache)]))
        self._encode(cache, direct, [self._head(w, True) for w in direct])
        self._pieces([p for _, head, tail in bare for p in (self._head(head, False), tail)] + [tail for _, _, tail in tailed])
        known = self.pieces
        cache.update((w, cache[head] + known[tail]) for w, head, tail in tailed)
        cache.update((w, self.line + known[self._head(head, False)] + known[tail]) for w, head, tail in bare)
        shown = (lambda w: w if w[:1] == "\n" else " " + w) if self.spaced else str
        for at in range(0, len(plain), _AT_ONCE):
            some = plain[at : at + _AT_ONCE]
            found = self.tokenizer.encode_batch_fast([self.separator.join(map(shown, some))], add_special_tokens=False)
            self._cut(self.cache, some, found[0].ids, self.separator_id)

    def _head(self, letters: str, after_space: bool) -> str:
        """The piece of a word's letters."""
        if not self.spaced:
            return letters.lower()
        return " " + letters if after_space else letters

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return next(self.batch([text]))

    def batch(self, texts: list[str] | list[bytes]) -> Iterator[bytes]:
        """``ids`` of each text, given as text or UTF-8; the pieces of about half a megabyte are looked up together."""
        for start, stop in pieces(np.array([len(t) for t in texts]), _LEARN_CHARS):
            raws = [t if isinstance(t, bytes) else t.encode("utf-8", "replace") for t in texts[start:stop]]
            data, bounds, classes = self._joined(raws)
            odd = self._odd(raws, bounds, classes)
            if odd.any():
                data, bounds, classes = self._joined([r for r, is_odd in zip(raws, odd.tolist()) if not is_odd])
            ids, cuts = self._of_bodies(data, bounds, classes)
            at = iter(zip(cuts, cuts[1:]))
            for raw, is_odd in zip(raws, odd.tolist()):
                if is_odd:
                    yield self._whole(raw.decode())
                else:
                    a, b = next(at)
                    yield ids[a:b].tobytes()

    @staticmethod
    def _joined(raws: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Texts with a space before each and behind the last, the places of these spaces, and the class of every byte."""
        data = b" ".join((b"", *raws, b""))
        bounds = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws]))).astype(np.int64)
        return data, bounds, np.frombuffer(data.translate(_CLASSES), np.uint8)

    def _odd(self, raws: list[bytes], bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The texts with odd white space, which are encoded whole."""

        def texts_at(places: np.ndarray) -> np.ndarray:
            return np.unique(np.searchsorted(bounds, places, "right") - 1)

        odd = np.zeros(len(raws), bool)
        for text in texts_at(np.flatnonzero((classes & _ODD_FIRST) != 0)).tolist():
            odd[text] = _ODD_SPACE.search(raws[text].decode()) is not None
        if self.spaced:
            gap = (classes & _GAP) != 0
            twice = np.flatnonzero(gap[1:] & gap[:-1])
            edge = np.zeros(len(classes), bool)
            edge[bounds] = True
            odd[texts_at(twice[~(edge[twice] | edge[twice + 1])])] = True
            odd |= np.array([r[:1] == b" " or r[-1:] == b" " for r in raws], bool)
        return odd

    def _of_bodies(self, data: bytes, bounds: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The ids of all texts one after the other, and where each begins and the last ends."""
        starts, ends, kinds = self._cut_pieces(np.frombuffer(data, np.uint8), bounds, classes)
        if not len(starts):
            return np.zeros(0, "<u4"), [0] * len(bounds)
        entries = self._entries(data, starts, ends, kinds)
        where = self.table.rows[:, 3].take(entries)
        counts = (where & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ids = self.table.ids.all[_gather(where >> np.uint64(32), counts)]
        before = np.concatenate(([0], np.cumsum(counts)))
        return ids, before[np.searchsorted(starts, bounds)].tolist()

    def _cut_pieces(self, data: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and kind of the pieces of texts, in order; the line feed before a word belongs to it."""
        letter, mark, gap = ((classes & c) != 0 for c in (_LETTER, _MARK, _GAP))
        lead = np.flatnonzero(data == 0xC3)
        after = data[lead + 1]
        lead = lead[(after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)]
        letter[lead] = letter[lead + 1] = True
        gaps = np.flatnonzero(gap)
        # The number of the word of every byte; a gap belongs to the word behind it.
        word = np.cumsum(gap, dtype=np.int32) - np.int32(1)
        begins, ends = gaps[:-1] + 1, gaps[1:]
        lines = data[gaps[:-1]] == 10 if self.spaced else np.zeros(len(begins), bool)
        simple = letter[begins]
        simple[word[np.flatnonzero(~(letter | mark | gap))]] = False
        simple[word[np.flatnonzero(mark[:-1] & letter[1:])]] = False
        marks = np.where(simple, np.bincount(word[np.flatnonzero(mark)], minlength=len(gaps))[:-1], 0)
        kind = np.where(simple, np.where(lines, np.uint8(_LINE), np.uint8(_WORD)), np.uint8(_OTHER))
        if self.spaced:
            first = word[bounds[:-1]]
            kind[first] = np.where(simple[first], np.uint8(_START), np.uint8(_OPEN))
        full = np.flatnonzero((begins < ends) | lines)
        starts, heads, marks, kind = (begins - (lines & ~simple))[full], (ends - marks)[full], marks[full], kind[full]
        tailed = np.flatnonzero(marks)
        if not len(tailed):
            return starts, heads, kind
        at = tailed + 1
        return np.insert(starts, at, heads[tailed]), np.insert(heads, at, heads[tailed] + marks[tailed]), np.insert(kind, at, np.uint8(_TAIL))

    def _entries(self, data: bytes, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The table's row of each piece; new pieces are encoded."""
        if self.table.size > self.table_pieces or self.table.bytes > _TABLE_BYTES:
            self.table = _Table()
        table, lengths = self.table, ends - starts
        padded = data + bytes(_SHORT)
        keys = np.empty((3, len(starts)), np.uint64).T
        keys[:, :2] = np.ndarray(len(data), f"V{_SHORT}", padded, strides=(1,))[starts].view("<u8").reshape(-1, 2)
        for word in (0, 1):
            keys[:, word] &= _MASKS[word].take(lengths, mode="clip")
        keys[:, 2] = lengths * 8 + kinds
        hashes = _hashes(keys)
        found = table.find(keys, hashes)
        large = np.flatnonzero(lengths > _SHORT)
        if len(large):
            found[large] = self._large(keys[large], kinds[large], [data[a:b] for a, b in zip(starts[large].tolist(), ends[large].tolist())])
        new = np.flatnonzero(found < 0)
        while len(new):
            # One piece of each hash at a time; others with the same hash go again.
            some = new[np.unique(hashes[new], return_index=True)[1]]
            raw = [data[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())]
            order, ids, counts = self._learned(kinds[some], raw)
            table.place(table.add(keys[some[order]], ids, counts))
            found[new] = table.find(keys[new], hashes[new])
            new = new[found[new] < 0]
        return found

    def _large(self, keys: np.ndarray, kinds: np.ndarray, raw: list[bytes]) -> list[int]:
        """The rows of pieces that the slots do not hold."""
        table, names = self.table, [bytes((k,)) + r for k, r in zip(kinds.tolist(), raw)]
        new = np.array([i for n, i in {n: i for i, n in enumerate(names)}.items() if n not in table.long], np.int64)
        if len(new):
            order, ids, counts = self._learned(kinds[new], [raw[i] for i in new.tolist()])
            new = new[order]
            table.long.update((names[i], row) for i, row in zip(new.tolist(), table.add(keys[new], ids, counts).tolist()))
            table.bytes += sum(len(names[i]) + 100 for i in new.tolist())
        return [table.long[n] for n in names]

    def _learned(self, kinds: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order in which new pieces were encoded, their ids in it, and how many each has."""
        plain = (kinds != _OTHER) & (kinds != _OPEN)
        direct, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        lines = kinds[direct] == _LINE
        if self.spaced:
            shown = [b" " + raw[i] if spaced else raw[i] for i, spaced in zip(direct.tolist(), (kinds[direct] == _WORD).tolist())]
        else:
            shown = [raw[i] if raw[i].islower() and raw[i].isascii() else raw[i].decode().lower().encode() for i in direct.tolist()]
        ids, counts = self._by_model(shown)
        if lines.any():
            # The ids of a line feed go before those of its word.
            feed = np.frombuffer(self.line, "<u4")
            at = (np.cumsum(counts) - counts)[lines]
            ids = np.insert(ids, np.repeat(at, len(feed)), np.tile(feed, len(at)))
            counts = counts + len(feed) * lines
        if not len(others):
            return direct, ids, counts
        texts = [raw[i].decode() for i in others.tolist()]
        after = [t for t, k in zip(texts, kinds[others].tolist()) if k == _OTHER]
        self._learn(list(dict.fromkeys(after)))
        known, self.cache = self.cache, {}
        found = [known[t] if k == _OTHER else self._whole(t) for t, k in zip(texts, kinds[others].tolist())]
        return (
            np.concatenate((direct, others)),
            np.concatenate((ids, np.frombuffer(b"".join(found), "<u4"))),
            np.concatenate((counts, np.array([len(f) // 4 for f in found], np.int64))),
        )


@lru_cache
def _shared(path: str, separator: str, spaced: bool) -> Encoder:
    return Encoder(path, separator, spaced)


# What a worker keeps of this module from task to task.
KEPT = "tokens"
keep_in_worker(KEPT, _shared.cache_clear)


def byte_encoder(path: str) -> Encoder:
    """For the byte-level vocabulary, kept for all tasks of a Python worker."""
    return _shared(path, "<|endoftext|>", True)


def word_encoder(path: str) -> Encoder:
    """For the vocabulary with word ends, kept for all tasks of a Python worker."""
    return _shared(path, "<|startoftext|>", False)
