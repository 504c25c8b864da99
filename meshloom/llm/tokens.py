"""Token ids of whole texts, by the tokenizers library.

Texts are cut where the pre-tokenizers have a boundary in any case: at every space behind a character that isn't white
space. A part made of letters, ASCII signs and single line ends alone is cut once more, into runs of letters, runs of signs
and line ends, which the pre-tokenizers keep apart too. So the ids of all these, in order, are the ids of the text. Runs come
again and again: they are found with array operations over the bytes of many texts, looked up together in a table that the
worker process keeps, and only runs that it doesn't know go to the library. A run's bytes are its key, so a hit is exact.
Parts with anything else in them go to the library as they are, or to a dictionary of earlier ones.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Classes of bytes: other, letter, space, line end, sign, end of a text.
OTHER, LETTER, SPACE, LINE, MARK, END = range(6)
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = MARK
_CLASS[[c for c in range(128) if chr(c).isalpha()]] = LETTER
# digits and apostrophes follow rules that differ by vocabulary
_CLASS[[ord(c) for c in "0123456789'"]] = OTHER
_CLASS[[ord(" "), ord("\n"), 0]] = SPACE, LINE, END
#: Lead byte of U+00C0 to U+00FF, which are letters but for two signs.
_LATIN, _NO_LETTERS = 0xC3, (0x97, 0xB7)
#: What may not follow what in a part that is cut into runs: a byte of another kind, a line end behind white space, a space behind
#: white space, anything but a run behind a space.
_MISFIT = np.zeros((6, 6), bool)
_MISFIT[:, OTHER] = True
_MISFIT[LINE, [SPACE, LINE]] = _MISFIT[SPACE, [SPACE, LINE, END]] = _MISFIT[END, LINE] = True
_MISFIT = _MISFIT.ravel()
#: Visible ASCII: a space behind one of these is a cut.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_CUT = re.compile(rb"[!-~] ")
_LOWER = bytes(range(256)).lower()
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that fit a key, which holds three numbers and, in its last byte, whether a space is before the word.
KEY_BYTES = 23
#: Words that the table holds, and bytes of text that are worked off together.
WORDS, TOGETHER = 500_000, 1 << 19
#: Other parts that are kept, and how long they may be.
PARTS, PART_BYTES = 300_000, 200
#: Tokens of their own in both vocabularies: one that no run has, and one for parts that don't have it.
DIGIT, SIGN = "7", "|"
_PLAIN = re.compile(r" [!-{}~]+")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache
def vocabulary_size(name: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name)).get_vocab_size(with_added_tokens=True)


class Table:
    """Open addressing over rows of three key numbers and a place in the pool of ids (first << 16 | count; 0: free)."""

    def __init__(self, most: int):
        self.most, self.size = most, 1 << (2 * most - 1).bit_length()
        self.rows, self.used = np.zeros((self.size, 4), np.uint64), np.zeros(self.size, bool)
        self.entries, self.pool, self.ids = 0, np.zeros(1 << 16, np.uint32), 1

    @staticmethod
    def hashed(keys: np.ndarray) -> np.ndarray:
        h = keys[0] * np.uint64(0x9E3779B97F4A7C15) + keys[1] * np.uint64(0xC2B2AE3D27D4EB4F) + keys[2] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def find(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The place of each key; 0 for one that isn't here."""
        out, open_ = np.zeros(len(h), np.uint64), None
        slot, mask = (h & np.uint64(self.size - 1)).astype(np.int64), self.size - 1
        while len(slot):
            got, (one, two, three) = self.rows[slot], keys if open_ is None else keys[:, open_]
            taken = got[:, 3] != 0
            same = (got[:, 0] == one) & (got[:, 1] == two) & (got[:, 2] == three) & taken
            self.used[slot[same]] = True
            if open_ is None:
                out = np.where(same, got[:, 3], out)
            else:
                out[open_[same]] = got[same, 3]
            on = np.nonzero(taken & ~same)[0]
            open_ = on if open_ is None else open_[on]
            slot = (slot[on] + 1) & mask
        return out

    def room(self, n: int) -> None:
        """Make room for n words: those not asked for again since they came, or since the last time, go first."""
        if self.entries + n <= self.most:
            return
        kept = self.rows[self.used & (self.rows[:, 3] != 0)]
        if len(kept) + n > self.most // 4 * 3:
            kept = kept[: max(0, self.most // 2 - n)]
        first, count = (kept[:, 3] >> np.uint64(16)).astype(np.int64), (kept[:, 3] & np.uint64(0xFFFF)).astype(np.int64)
        ids = gather(self.pool, first, count)
        self.rows[:], self.used[:], self.entries, self.ids = 0, False, 0, 1
        keys = np.ascontiguousarray(kept[:, :3].T)
        self.put(keys, self.hashed(keys), ids, count)

    def hold(self, ids: np.ndarray) -> int:
        """Write ids behind the pool's; returns their place there. They stay if self.ids is moved on."""
        while self.ids + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), np.uint32)))
        self.pool[self.ids : self.ids + len(ids)] = ids
        return self.ids

    def put(self, keys: np.ndarray, h: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Add keys, all different and none of them here."""
        first = self.hold(ids) + np.cumsum(count) - count
        self.ids += len(ids)
        self.entries += len(h)
        value = first.astype(np.uint64) << np.uint64(16) | count.astype(np.uint64)
        slot, left = (h & np.uint64(self.size - 1)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = self.rows[slot, 3] == 0
            at, who = np.unique(slot[free], return_index=True)
            who = left[free][who]
            self.rows[at, :3], self.rows[at, 3] = keys[:, who].T, value[who]
            over = self.rows[slot, 3] != value[left]
            left, slot = left[over], (slot[over] + 1) & (self.size - 1)


def gather(source: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The stretches source[first : first + count], one behind the other."""
    ends = np.cumsum(count)
    return source[np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of texts. Strings of special tokens in a text are ordinary text."""

    def __init__(self, name: str, words: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(vocabulary(name))
        self.model.encode_special_tokens = True
        # a vocabulary of small letters knows no white space either
        self.folds = self.model.normalizer is not None and self.model.normalizer.normalize_str("AÉ") == "aé"
        # the same model for words that are cut and written in the byte alphabet already
        self.plain = Tokenizer(self.model.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {c: alphabet.pre_tokenize_str(chr(c))[0][0] for c in (32, *range(0xC0, 0x100))}
        (self.digit,) = self.plain.encode(DIGIT).ids
        (self.sign,) = self.model.encode(" " + SIGN, add_special_tokens=False).ids
        self.line = self.model.encode("\n", add_special_tokens=False).ids
        self.table, self.parts = Table(words), {}

    def words(self, found: list[bytes]) -> list[list[int]]:
        """The ids of runs, with the space before them if there is one."""
        texts = [(x.decode().lower() if self.folds else x.decode()).translate(self.written) for x in found]
        joined = [f" {DIGIT} ".join(texts[k : k + 64]) for k in range(0, len(texts), 64)]
        return [own for e in self.plain.encode_batch_fast(joined, add_special_tokens=False) for own in _cut(e.ids, self.digit)]

    def others(self, parts: list[bytes]) -> list[list[int]]:
        """The ids of parts of any kind. Those of visible ASCII behind a space are joined by a sign that none of them has, encoded in
        one call, and cut at the sign's id: between spaces, it is a token of its own."""
        texts = [p.decode("utf-8", "replace") for p in parts]
        plain = [k for k, x in enumerate(texts) if _PLAIN.fullmatch(x)]
        found: list[list[int]] = [[] for _ in parts]
        if plain:
            groups = [f" {SIGN}".join([texts[k] for k in plain[at : at + 64]]) for at in range(0, len(plain), 64)]
            ids = [own for e in self.model.encode_batch_fast(groups, add_special_tokens=False) for own in _cut(e.ids, self.sign)]
            for k, own in zip(plain, ids, strict=True):
                found[k] = own
        known = set(plain)
        rest = [k for k in range(len(parts)) if k not in known]
        for k, e in zip(rest, self.model.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            found[k] = e.ids
        return found

    def slow(self, parts: list[bytes]) -> list[list[int]]:
        if len(self.parts) > PARTS:
            self.parts.clear()
        new = list({p: None for p in parts if p not in self.parts})
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            self.parts.update(zip(some, self.others(some), strict=True))
        out = [self.parts[p] for p in parts]
        for p in new:
            if len(p) > PART_BYTES:
                del self.parts[p]
        return out

    def known(self, keys: np.ndarray, buffer: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places in the pool of the words buffer[start:end] with these keys; what isn't in the table is added to it."""
        h = Table.hashed(keys)
        place = self.table.find(keys, h)
        missing = np.nonzero(place == 0)[0]
        if len(missing):
            _, first = np.unique(h[missing], return_index=True)
            before = self.table.entries
            self.table.room(len(first))
            # places of words found before are void if others had to go
            again = np.arange(len(h)) if self.table.entries < before else missing
            while len(missing):
                _, first = np.unique(h[missing], return_index=True)
                one = missing[first]
                if self.table.entries < before:
                    one = one[self.table.find(keys[:, one], h[one]) == 0]
                ids = self.words([buffer[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)])
                count = np.fromiter(map(len, ids), np.int64, len(ids))
                self.table.put(keys[:, one], h[one], np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum())), count)
                place[again] = self.table.find(keys[:, again], h[again])
                missing = again = np.nonzero(place == 0)[0]
                before = 0
        return place

    def window(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each). No text has a zero byte."""
        text = b"\0".join([b"", *bodies, bytes(32)])
        b = np.frombuffer(text, np.uint8)[:-32]
        kinds = _CLASS[b]
        latin = np.nonzero(b == _LATIN)[0]
        if len(latin):
            latin = latin[~np.isin(b[latin + 1], _NO_LETTERS)]
            kinds[latin] = kinds[latin + 1] = LETTER
        ends = np.nonzero(kinds == END)[0]
        begins = np.zeros(len(b), bool)
        begins[1:] = ((b[1:] == 32) & (_SOLID[b[:-1]] | (kinds[:-1] == LETTER))) | (kinds[:-1] == END)
        begins[ends] = False
        first = np.nonzero(begins)[0]
        odd = np.nonzero(_MISFIT[kinds[:-1] * np.uint8(6) + kinds[1:]])[0] + 1
        odd = np.where(kinds[odd] == END, odd - 1, odd)
        mixed = np.zeros(len(first), bool)
        mixed[np.searchsorted(first, odd, "right") - 1] = True
        # parts that go as they are, up to the next part or the end of the text
        whole_first = first[mixed]
        whole_stop = np.append(first[1:], len(b))[mixed]
        whole_stop = np.minimum(whole_stop, ends[np.searchsorted(ends, whole_first)])
        cover = np.zeros(len(b) + 1, np.int8)
        cover[whole_first] = 1
        np.subtract.at(cover, whole_stop, 1)
        kinds[np.cumsum(cover[:-1], dtype=np.int8) > 0] = OTHER

        run = (kinds == LETTER) | (kinds == MARK)
        change = kinds[1:] != kinds[:-1]
        start, end = np.nonzero(run[1:] & change)[0] + 1, np.nonzero(run[:-1] & change)[0] + 1
        length, spaced = end - start, b[start - 1] == 32
        long = length > KEY_BYTES
        slow_first, slow_stop = whole_first, whole_stop
        if long.any():
            slow_first, slow_stop = np.concatenate((whole_first, (start - spaced)[long])), np.concatenate((whole_stop, end[long]))
            start, end, length, spaced = start[~long], end[~long], length[~long], spaced[~long]
        slow = self.slow([text[a:z] for a, z in zip(slow_first.tolist(), slow_stop.tolist(), strict=True)])

        folded = text.translate(_LOWER) if self.folds else text
        eight = np.lib.stride_tricks.as_strided(np.frombuffer(folded, "<u8", 1), (len(text) - 7,), (1,))
        keys = np.zeros((3, len(start)), np.uint64)
        keys[0] = eight[start] & _KEEP[np.minimum(length, 8)]
        for k in (1, 2):
            more = np.nonzero(length > 8 * k)[0]
            keys[k, more] = eight[start[more] + 8 * k] & _KEEP[np.minimum(length[more] - 8 * k, 8)]
        if not self.folds:
            keys[2] |= spaced.astype(np.uint64) << np.uint64(56)
        place = self.known(keys, text, start if self.folds else start - spaced, end)

        # the table's ids, then those of this window that aren't kept
        lines = np.nonzero(kinds == LINE)[0] if self.line else start[:0]
        extra = [self.line, *slow]
        counts = np.fromiter(map(len, extra), np.int64, len(extra))
        at = self.table.hold(np.fromiter((i for x in extra for i in x), np.uint32, int(counts.sum()))) + np.cumsum(counts) - counts
        where = np.concatenate((start, lines, slow_first))
        order = np.argsort(where, kind="stable")  # three sorted stretches: one merge
        where = where[order]
        from_ = np.concatenate(((place >> np.uint64(16)).astype(np.int64), np.full(len(lines), at[0]), at[1:]))[order]
        count = np.concatenate(((place & np.uint64(0xFFFF)).astype(np.int64), np.full(len(lines), counts[0]), counts[1:]))[order]
        totals = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(where, ends)]
        return gather(self.table.pool, from_, count), np.diff(totals)

    def encode(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one behind the other; where each begins, and the end of the last). Texts are UTF-8."""
        pieces, of = [], []
        out, sizes, pending = [], np.zeros(len(bodies), np.int64), 0

        def flush() -> None:
            nonlocal pieces, of, pending
            if pieces:
                ids, counts = self.window(pieces)
                out.append(ids)
                np.add.at(sizes, of, counts)
            pieces, of, pending = [], [], 0

        for k, body in enumerate(bodies):
            if b"\0" in body or b"<|" in body:  # near a special token's string nothing is assumed
                flush()
                (ids,) = self.slow([body])
                out.append(np.array(ids, np.uint32))
                sizes[k] = len(ids)
                continue
            at = 0
            while at < len(body) or not at:
                met = _CUT.search(body, at + TOGETHER) if len(body) - at > TOGETHER else None
                stop = met.start() + 1 if met else len(body)
                pieces.append(body[at:stop])
                of.append(k)
                pending += stop - at
                at = stop
                if pending > TOGETHER:
                    flush()
                if not len(body):
                    break
        flush()
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.concatenate(([0], np.cumsum(sizes)))

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() of a column of strings without nulls."""
        return self.encode(texts.cast(pa.binary()).to_pylist())


def _cut(ids: list[int], sign: int) -> list[list[int]]:
    out, at = [], 0
    for _ in range(ids.count(sign)):
        to = ids.index(sign, at)
        out.append(ids[at:to])
        at = to + 1
    out.append(ids[at:])
    return out


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The one of this process."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def release() -> None:
    """Drop the encoders of this process, which operators that don't encode have no use for, and give their memory back."""
    if _encoders:
        _encoders.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
