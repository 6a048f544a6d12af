"""Token ids of many texts by a public byte-level BPE, with a cache of word pieces.

The vocabulary's split pattern never joins a word with what follows the next white
space, so a text is cut into pieces (a word with the single space before it, or the
rest of a run of white space) whose ids do not depend on their neighbours. Pieces are
cut and hashed with numpy for a group of texts at once, and only pieces not seen
before in this worker are given to the tokenizer. Texts with white space outside ASCII
or with a special token's string are encoded whole.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa

from rollcall.llm import kernels as K

#: Characters that count as white space for the pattern but not for the cutting.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_SLOT_BITS = 20
_SLOTS = 1 << _SLOT_BITS
#: Ids that the cache holds at most before it starts again: bounded memory.
_MOST_IDS = 5_000_000
#: Split pattern of the byte-level vocabularies, a fixed value, and a text on which
#: both tokenizers are compared when a vocabulary is loaded.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBE = "It's 12 o'clock,\n\n  Größe naïve 😀 (x_y)...\t end  "
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; the folder is installed on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts, equal to those of ``tokenizers`` with add_special_tokens=False."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        size = self.whole.get_vocab_size()
        ranks = _ranks(self.whole)
        self.bytes = np.zeros(size, np.int32)
        self.bytes[list(ranks.values())] = [len(k) for k in ranks]
        for i, t in self.whole.get_added_tokens_decoder().items():
            self.bytes[i] = len(t.content.encode())
        # the ids of single pieces come from the same vocabulary, a few times faster
        self.fast = tiktoken.Encoding("pieces", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        if self.fast.encode_ordinary(_PROBE) != self.whole.encode(_PROBE, add_special_tokens=False).ids:
            raise ValueError(f"{path} is not a byte-level vocabulary with the usual split pattern")
        self._forget()

    def _forget(self) -> None:
        """Direct-mapped cache of pieces by hash: hash, place and number of the ids."""
        self.hash = np.zeros(_SLOTS, np.uint64)
        self.place = np.zeros(_SLOTS, np.int64)
        self.count = np.zeros(_SLOTS, np.int32)
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the ids of pieces."""
        encode = self.fast.encode_ordinary
        found = [encode(p) for p in pieces]
        count = np.array([len(x) for x in found], np.int64)
        place = self.used + np.cumsum(count) - count
        end = self.used + int(count.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), end - len(self.ids)), np.int32)])
        self.ids[self.used: end] = np.fromiter((i for x in found for i in x), np.int32, end - self.used)
        self.used = end
        return place, count

    def group(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a group of texts, behind each other, and where each text's begin."""
        if self.used > _MOST_IDS:
            self._forget()
        texts = len(offsets) - 1
        plain = np.ones(texts, bool)
        joined = data.tobytes()
        if _ODD.search(joined.decode()) or any(s.encode() in joined for s in self.special):
            for i in range(texts):
                t = joined[offsets[i]: offsets[i + 1]].decode()
                plain[i] = not (_ODD.search(t) or any(s in t for s in self.special))
        starts, ends = _pieces(data, offsets)
        hashes = K.run_hashes(data, starts, ends)
        slot = (hashes >> K.U64(64 - _SLOT_BITS)).astype(np.int64)
        missed = np.flatnonzero(self.hash[slot] != hashes)
        place, count = self.place[slot], self.count[slot].astype(np.int64)
        if len(missed):
            fresh, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            at = missed[first]
            new_place, new_count = self._learn([joined[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            # several pieces may want one slot: those of this group are answered from
            # what was just learnt, and the slot keeps the last
            place[missed], count[missed] = new_place[back], new_count[back]
            s = slot[at]
            self.hash[s], self.place[s], self.count[s] = fresh, new_place, new_count
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(place - total[:-1], count) + np.arange(total[-1])]
        bounds = total[np.searchsorted(starts, offsets)]
        if plain.all():
            return ids, bounds
        parts = []
        for i in range(texts):
            whole = None if plain[i] else self.whole.encode(joined[offsets[i]: offsets[i + 1]].decode(), add_special_tokens=False).ids
            parts.append(ids[bounds[i]: bounds[i + 1]] if plain[i] else np.array(whole, np.int32))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def texts(self, column: pa.Array):
        """Yield (first row, bytes, offsets, ids, where each text's ids begin)."""
        for row, data, offsets in K.groups(column):
            ids, bounds = self.group(data, offsets)
            yield row, data, offsets, ids, bounds


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of a group of texts. A run of white space before a
    word gives its last character away: a space to the word, another one to itself."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    white = _WHITE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins, closes = first[:-1], first[1:]
    prev_white = np.r_[True, white[:-1]]
    prev_space = np.r_[False, data[:-1] == 32] & ~begins
    next_word = np.r_[~white[1:], False] & ~closes
    start = np.where(white, next_word | ~prev_white | begins, (prev_white & ~prev_space) | begins)
    starts = np.flatnonzero(start)
    return starts, np.r_[starts[1:], n]


def _ranks(tokenizer) -> dict[bytes, int]:
    """The vocabulary's tokens as bytes. A byte-level vocabulary writes each byte as one
    printable sign: printable Latin bytes as themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    return {bytes(byte_of[c] for c in token): i for token, i in tokenizer.get_vocab().items() if token not in special}


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """The worker's encoder; kept between the tasks of a worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
