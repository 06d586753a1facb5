"""Token ids of a batch of texts: every different stretch between cuts is encoded once per worker and then looked up."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bytewords import _LOWER, text_buffers
from .common import one_thread_libraries
from .stretches import Flat, Seen, different, strings

#: Stretches remembered by one worker process before it starts anew, at some 80 bytes each, and their bytes.
REMEMBERED = 1_200_000
REMEMBERED_BYTES = 1 << 25
#: Text encoded at once, and new stretches handed to the library at once.
PIECE = 1 << 19
LEARNED = 2048
_SPACE_BEFORE = np.zeros(256, bool)
_SPACE_BEFORE[0x21:0x7F] = True
_SPACE_BEFORE[0xC3:0xE0] = True  # two-byte letters; no Unicode space starts with these bytes
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_POINT = np.zeros(256, bool)
_POINT[[ord(c) for c in ".,!"]] = True


class Encoder:
    """Encodes Arrow string columns with a tokenizer file of the ``tokenizers`` library, as the library does by default.

    Both vocabularies used here split a text before merging, always before a space that stands before a visible
    character and always between an ASCII letter and a point, comma or exclamation mark, so a text may be cut there:
    the ids of the stretches, joined, are the ids of the text. ``fold_case`` maps A-Z to a-z first, for a tokenizer
    that does so itself. The library finds its special strings before it does anything else: a text that holds one, in
    letters of either case, is one stretch and isn't folded. ``end_id`` follows every text.
    """

    def __init__(self, path: str, end_id: int, fold_case: bool = False):
        one_thread_libraries()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end_id, self.fold_case = end_id, fold_case
        self._forget()

    def _forget(self) -> None:
        self._seen, self._ids = Seen(), Flat(np.uint32)

    def _learn(self, units: list[bytes], hashes: np.ndarray) -> None:
        for at in range(0, len(units), LEARNED):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([u.decode() for u in units[at : at + LEARNED]], add_special_tokens=False)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self._ids.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths)
        self._seen.add(np.frombuffer(b"".join(units), np.uint8), np.fromiter(map(len, units), np.int64, len(units)), hashes)

    def _whole(self, column: pa.Array, data: np.ndarray) -> np.ndarray:
        """Which texts hold a special string."""
        out = np.zeros(len(column), bool)
        for text in self.special:
            first = ord(text[0])
            if (data[np.flatnonzero(data[:-1] == first) + 1] == ord(text[1])).any():  # two ASCII characters, of no case
                out |= pc.match_substring(column, text, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column's texts, each followed by the end id, and the offsets of the texts in them."""
        data, offsets = text_buffers(column)
        n_texts = len(offsets) - 1
        whole = [(offsets[i], offsets[i + 1]) for i in np.flatnonzero(self._whole(column, data))]
        if self.fold_case:
            folded = _LOWER[data]
            for a, b in whole:
                folded[a:b] = data[a:b]
            data = folded
        begins = np.zeros(len(data), bool)
        begins[:-1] |= (data[:-1] == 0x20) & _SPACE_BEFORE[data[1:]]
        begins[1:] |= _LETTER[data[:-1]] & _POINT[data[1:]]
        for a, b in whole:
            begins[a:b] = False
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(begins)
        content, bounds, unit = different(data, starts)
        if len(self._seen) > REMEMBERED or self._seen.bytes.used > REMEMBERED_BYTES:
            self._forget()
        row, hashes = self._seen.find(content, bounds)
        new = np.flatnonzero(row < 0)
        row[new] = len(self._seen) + np.arange(len(new))
        self._learn(strings(content, bounds, new), hashes[new])
        ids, length = self._ids.rows(row[unit])
        text = np.searchsorted(offsets, starts, side="right") - 1
        per_text = np.bincount(text, length, n_texts).astype(np.int64)
        out_offsets = np.zeros(n_texts + 1, np.int64)
        np.cumsum(per_text + 1, out=out_offsets[1:])
        out = np.full(out_offsets[-1], self.end_id, np.uint32)
        body = np.ones(len(out), bool)
        body[out_offsets[1:] - 1] = False
        out[body] = ids
        return out, out_offsets


_encoders: dict[tuple[str, int, bool], Encoder] = {}


def encoder(path: str, end_id: int, fold_case: bool = False) -> Encoder:
    """The encoder of this worker process, kept between its tasks."""
    key = (path, end_id, fold_case)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
