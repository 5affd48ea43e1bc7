"""Byte-level BPE ids of whole texts, at the price of the distinct words.

The vocabulary is read from a tokenizer JSON file, whose ids are in merge order, so they are the
ranks that byte-pair merging needs. Pre-tokens never join two words: a word with the space before
it, and what else lies between words, can be encoded alone. Texts with white space other than space
and line feed go to the encoder whole. The names of special tokens are ordinary text.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from tessera.llm.bytetext import chunks, hash_spans

#: The public pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = np.ones(256, dtype=bool)
_PLAIN[[0x20, 0x0A]] = False
_OTHER_SPACE = np.zeros(256, dtype=bool)
_OTHER_SPACE[[0x09, 0x0B, 0x0C, 0x0D]] = True
_LEADS = np.zeros(256, dtype=bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _byte_letters() -> dict[str, int]:
    """The public byte-to-letter table: printable bytes stand for themselves, the rest for letters from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids(column) of texts; the cache of distinct words is bounded by ``most_words`` and then starts anew."""

    def __init__(self, path: str, most_words: int = 400_000):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocab.items() if all(c in letters for c in piece) and not piece.startswith("<|")}
        self.encode = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most_words = most_words
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.length[i] = len(piece)
        self.reset()

    def reset(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.at = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)

    def _encoded(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spans that start with a space, and how many each has. The pattern itself cuts
        before them, so they are encoded in one call and told apart by their lengths."""
        size = stop - start
        ends = np.cumsum(size)
        text = buf[np.repeat(start - ends + size, size) + np.arange(ends[-1])].tobytes()
        flat = np.asarray(self.encode(text.decode("utf-8", "replace")), np.uint32)
        got = np.cumsum(self.length[flat])
        at = np.searchsorted(got, ends)
        if at[-1] < len(got) and np.array_equal(got[at], ends):
            return flat, np.diff(at + 1, prepend=0)
        return self._each(buf, start, stop)

    def _each(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.encode(buf[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        return np.fromiter((i for x in lists for i in x), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))

    def _add(self, keys: np.ndarray, buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        spaced = buf[start] == 0x20
        order = np.argsort(~spaced, kind="stable")
        keys, start, stop, k = keys[order], start[order], stop[order], int(spaced.sum())
        parts = [f(buf, start[x], stop[x]) for f, x in ((self._encoded, slice(0, k)), (self._each, slice(k, None))) if len(start[x])]
        flat, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        lists, keys = sizes, keys.tolist()
        n = len(self.known)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        while n + len(lists) > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(len(self.at), np.int64)])
            self.size = np.concatenate([self.size, np.zeros(len(self.size), np.int32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[n : n + len(lists)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(lists)] = sizes
        self.used += len(flat)
        self.known.update(zip(keys, range(n, n + len(lists)), strict=True))

    def _units(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Starts of the parts that can be encoded alone."""
        n = len(buf)
        word = _PLAIN[buf]
        first = np.zeros(n + 1, dtype=bool)
        first[off] = True
        mark = first[:n].copy()
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        mark[1:] |= word[:-1] & ~word[1:]
        start = np.flatnonzero(begin)
        inner = ~first[start]
        mark[start[~inner]] = True
        mark[start[inner] - 1] = True
        # a line feed before a word stands alone, and the word then starts itself
        feed = start[inner][buf[start[inner] - 1] == 0x0A]
        mark[feed] = True
        return np.flatnonzero(mark)

    def counts_and_ids(self, column: pa.Array, want_ids: bool = True):
        """Per run of texts: (first row, end row, tokens of each text, ids or None)."""
        for row, end, buf, off in chunks(column, 8 << 20):
            if len(self.known) > self.most_words:
                self.reset()
            start = self._units(buf, off) if len(buf) else np.zeros(0, np.int64)
            stop = np.append(start[1:], len(buf)) if len(start) else start
            key, where, back = np.unique(hash_spans(buf, start, stop), return_index=True, return_inverse=True) if len(start) else (start, start, start)
            keys = key.tolist()
            get = self.known.get
            found = np.fromiter((get(k, -1) for k in keys), np.int64, len(keys))
            new = np.flatnonzero(found < 0)
            if len(new):
                self._add(key[new], buf, start[where[new]], stop[where[new]])
                found[new] = np.fromiter(map(self.known.__getitem__, key[new].tolist()), np.int64, len(new))
            entry = found[back] if keys else start
            size = self.size[entry].astype(np.int64)
            total = np.concatenate([[0], np.cumsum(size)])
            bounds = total[np.searchsorted(start, off)]
            ids = None
            if want_ids:
                ids = self.ids[np.repeat(self.at[entry] - total[:-1], size) + np.arange(total[-1])]
            count = np.diff(bounds)
            odd = self._odd(buf, off)
            if len(odd):
                parts = np.split(ids, bounds[1:-1]) if want_ids else None
                for i in odd.tolist():
                    own = self.encode(buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
                    count[i] = len(own)
                    if want_ids:
                        parts[i] = np.asarray(own, np.uint32)
                if want_ids:
                    ids = np.concatenate(parts) if parts else ids
            yield row, end, count, ids

    @staticmethod
    def _odd(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Documents with white space other than space and line feed."""
        if not len(buf):
            return np.zeros(0, np.int64)
        found = [np.flatnonzero(_OTHER_SPACE[buf])]
        lead = np.flatnonzero(_LEADS[buf])
        if len(lead):
            more = np.concatenate([buf, np.zeros(2, np.uint8)])
            a, b, c = more[lead], more[lead + 1], more[lead + 2]
            is_space = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
            is_space |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
            found.append(lead[is_space])
        return np.unique(np.searchsorted(off, np.concatenate(found), "right") - 1)
