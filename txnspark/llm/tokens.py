"""Token ids of whole texts with a public tokenizer file.

A batch of texts is cut into words by Arrow, each distinct word is encoded once and
looked up afterwards, and numpy puts the ids together. A text is only cut at single
blanks and line feeds between visible characters, where the patterns of the supported
files always begin a new word, so the ids equal those of the whole text. Texts with
other white space, and texts that hold the beginning of a special token, are encoded
as they are. The tests compare both ways with the library.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEEN = r"!-~À-ɏ"
#: White space that may be no cut: at an end, doubled, of another kind, or beside a
#: character that is not plainly visible; special tokens; no text at all.
_ODD = rf"^$|^[ \n]|[ \n]$|[ \n][ \n]|<\||[^{_SEEN} \n][ \n]|[ \n][^{_SEEN} \n]|[\t\x0b-\r]"
#: Stands before the first word of a text, which has no blank before it.
_FIRST = "\r"
#: Words in one call of the library, put apart by a special token that ends any word.
_GROUP = 256


class Encoder:
    """``encode`` gives little-endian unsigned 32-bit ids of texts as bytes.

    Holds at most ``most`` words of up to ``longest`` characters, as Arrow arrays. A full
    table keeps its oldest three fifths: frequent words come in first.
    """

    def __init__(self, path: str, most: int = 250_000, longest: int = 48):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.longest = most, longest
        self.known = pa.array([], pa.string())
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        special = sorted(self.tokenizer.get_added_tokens_decoder().items(), reverse=True)
        self.apart_id, self.apart = (special[0][0], special[0][1].content) if special else (None, None)
        ids = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in (" b", "b", "AB", "ab")]
        self.drops, self.folds = ids[0] == ids[1], ids[2] == ids[3]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, np.uint32) for e in found]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.drops:
            words = [w[1:] if w[0] == _FIRST else w if w[0] == "\n" else " " + w for w in words]
        if not self.apart:
            found = self._plain(words)
            return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
        groups = [self.apart.join(words[i : i + _GROUP]) for i in range(0, len(words), _GROUP)]
        end = np.array([self.apart_id], np.uint32)
        ids = np.concatenate([part for found in self._plain(groups) for part in (found, end)])
        marks = ids == self.apart_id
        return ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1) - 1

    def _ids_of(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): where in ``ids`` those of each name are."""
        place = pc.index_in(names, value_set=self.known)
        new = names.filter(place.is_null())
        made, sizes = self._words(new.to_pylist())
        place = place.to_numpy(zero_copy_only=False) if not place.null_count else pc.fill_null(place, -1).to_numpy()
        at = place.astype(np.int64)
        at[at < 0] = len(self.known) + np.arange(len(new))
        ids, every = np.concatenate([self.ids, made]), np.concatenate([self.sizes, sizes])
        start = (np.cumsum(every) - every)[at]
        self._keep(new, made, sizes)
        return ids, start, every[at]

    def _keep(self, new: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        short = pc.less_equal(pc.utf8_length(new), self.longest).to_numpy(zero_copy_only=False)
        if not short.all():
            new, ids, sizes = new.filter(pa.array(short)), ids[np.repeat(short, sizes)], sizes[short]
        if len(self.known) + len(new) > self.most:
            held = min(len(self.known), self.most * 3 // 5)
            self.known, self.sizes = self.known.slice(0, held), self.sizes[:held]
            self.ids = self.ids[: self.sizes.sum()]
            room = self.most - held
            new, sizes = new.slice(0, room), sizes[:room]
            ids = ids[: sizes.sum()]
        self.known = pa.concat_arrays([self.known, new])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def _cut(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that may be cut into words."""
        if self.folds:
            texts = pc.ascii_lower(texts)
        if self.drops:
            texts = pc.replace_substring(texts, "\n", " ")
        else:
            # A line feed begins a word of its own line, which has no blank before it.
            texts = pc.replace_substring(texts, "\n", " \n")
            texts = pc.binary_join_element_wise(pa.scalar(_FIRST), texts, "")
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        values, start, size = self._ids_of(words.dictionary)
        index = words.indices.to_numpy()
        length = size[index]
        ends = np.cumsum(length)
        flat = values[np.arange(ends[-1]) + np.repeat(start[index] - ends + length, length)].astype("<u4").tobytes()
        last = 4 * ends[pc.list_value_length(split).to_numpy().cumsum() - 1]
        return [flat[a:b] for a, b in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]

    def _whole(self, texts: pa.Array) -> list[bytes]:
        return [ids.astype("<u4").tobytes() for ids in self._plain(texts.to_pylist())]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain, whole = np.flatnonzero(~odd), np.flatnonzero(odd)
        out: list[bytes] = [b""] * len(texts)
        for places, fn in ((plain, self._cut), (whole, self._whole)):
            if len(places):
                for i, ids in zip(places.tolist(), fn(texts.take(pa.array(places))), strict=True):
                    out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
