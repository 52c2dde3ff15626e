"""Exact, memoised encoding with a public tokenizer file.

A text is cut only where no pre-token can span the cut, so the ids of the pieces, joined,
are the ids of the whole text.  Pieces repeat (words do): Arrow numbers the distinct pieces
of a batch, each new piece is encoded once and kept in a memo of Arrow and numpy arrays, and
the ids of all texts are gathered in one vectorised step.  A memo of more than ``MEMO_ENTRIES`` pieces is cut back to
those of the last slice, so its size does not follow the corpus.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: pieces of the memo (about 40 bytes each)
MEMO_ENTRIES = 1_500_000
#: pieces passed to the tokenizer at a time
MISS_BATCH = 50_000
#: new pieces of a text that is passed to the tokenizer
JOINED = 32
#: text bytes encoded at a time (a single longer text goes alone)
SLICE_BYTES = 8 << 20
#: words whose ids are gathered at a time
GATHER = 1 << 17
#: fixed values: punctuation that may be cut off the end of a word of letters
TAIL = ".,;:!?%&*#$|"
#: fixed values: what str.split takes for white space
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file (kept while the worker lives)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


@contextmanager
def task_encoder(path: str) -> Iterator["Encoder"]:
    """The worker's encoder, which keeps little of its memo beyond the task: the worker lives on
    beside the other stages of its executor."""
    try:
        yield encoder(path)
    finally:
        encoder(path).keep_common()
        give_back()


def give_back() -> None:
    """Returns what Arrow and the C library hold of freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)        # glibc's
    if trim is not None:
        trim(0)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each (start, length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def _behind(words: pa.Array, sizes: np.ndarray) -> pa.Array:
    """What is left of each word behind its first bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    lens = np.diff(offsets) - sizes
    ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    held = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ragged(offsets[:-1] + sizes, lens)]
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(held))


class Encoder:
    """``encode(texts)`` gives the ids of whole texts, as ids and the bounds of each text.

    Pieces are words, cut before each single space or line end.  A pre-token of the byte-level
    tokenizer starts with at most one space, or is a run of white space; so the cut is exact
    when the character before it is no white space.  A word that breaks this (an empty one, or
    one with other white space in it) is marked unsafe, and texts that hold one are encoded in
    one go, as are texts with a carriage return, which marks the first piece of a text, and texts
    with the spelling of an added token, which gets that token's id as in a plain call of the
    tokenizer.  A tokenizer that drops white space can be cut at every space or line end.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [(t.content, t.normalized) for t in added]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        one, two = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("a", "a a"))
        self.drops_space = two == one + one
        self.separator = " \x01 " if self.drops_space else "\n"
        self.separator_id = self.tokenizer.encode(self.separator, add_special_tokens=False).ids[0]
        self._forget()

    def _forget(self) -> None:
        self._pieces = pa.array([], pa.large_string())
        self._flat = np.zeros(0, self.dtype)                 # ids of all pieces
        self._starts, self._lens = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._unsafe = np.zeros(0, bool)
        self._common = np.zeros(0, np.int64)                 # places of what the last slice repeats

    def keep_common(self) -> None:
        """Cuts the memo back to the pieces that the last slice has more than once."""
        self._cut_back(self._common)

    def _spelt(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The texts that pieces stand for; which of them start a line, and which are unsafe."""
        none = np.zeros(len(pieces), bool)
        if self.drops_space:
            return pieces, none, none
        first, line = pc.starts_with(pieces, "\r"), pc.starts_with(pieces, "\n")
        body = pc.if_else(pc.or_(first, line), pc.utf8_slice_codeunits(pieces, 1), pieces)
        unsafe = pc.or_(pc.equal(body, ""), pc.match_substring_regex(body, SPACE))
        unsafe = pc.and_(unsafe, pc.not_equal(pieces, "\r"))
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pieces, pa.scalar(" ", pa.large_string()))
        spelt = pc.if_else(first, body, pc.if_else(line, pieces, spaced))
        return spelt, np.asarray(line), np.asarray(unsafe)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), MISS_BATCH):
            encs = self.tokenizer.encode_batch_fast(texts[at:at + MISS_BATCH], add_special_tokens=False)
            out += [np.array(e.ids, dtype=self.dtype) for e in encs]
        return out

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, their numbers, and which pieces are unsafe (no ids).

        Pieces go to the tokenizer by ``JOINED`` in one text, each behind a separator that is a pre-token
        and an id of its own; a piece that starts a line has that id once more.  If a text has another
        number of separators than it should, its pieces go one by one."""
        spelt, line, unsafe = self._spelt(pieces)
        lens = np.zeros(len(pieces), np.int64)
        some = np.flatnonzero(~unsafe & (np.asarray(pc.binary_length(spelt)) > 0))
        texts = spelt.take(pa.array(some)).to_pylist()
        groups = [slice(i, i + JOINED) for i in range(0, len(texts), JOINED)]
        flat = [np.zeros(0, self.dtype)]
        for g, ids in zip(groups, self._raw([self.separator + self.separator.join(texts[g]) for g in groups])):
            hits, seps = np.flatnonzero(ids == self.separator_id), 1 + line[some[g]]
            at = np.cumsum(seps) - seps
            if len(hits) == seps.sum() and hits[0] == 0:
                n = np.diff(np.append(hits[at], len(ids))) - 1
                flat.append(np.delete(ids, hits[at]))
            else:
                alone = self._raw(texts[g])
                n = np.array([len(x) for x in alone], np.int64)
                flat += alone
            lens[some[g]] = n
        return np.concatenate(flat), lens, unsafe

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the memo has each of distinct pieces; -1 if it hasn't."""
        found = pc.index_in(self._pieces, value_set=pieces)
        held = np.flatnonzero(np.asarray(found.is_valid()))
        out = np.full(len(pieces), -1, np.int64)
        out[np.asarray(found.drop_null())] = held
        return out

    def _add(self, pieces: pa.Array, flat: np.ndarray, lens: np.ndarray, unsafe: np.ndarray) -> np.ndarray:
        """Adds pieces, whose ids follow each other in ``flat``; returns their places."""
        first = len(self._lens)
        self._pieces = pa.concat_arrays([self._pieces, pieces])
        self._starts = np.concatenate([self._starts, len(self._flat) + np.cumsum(lens) - lens])
        self._lens, self._unsafe = np.concatenate([self._lens, lens]), np.concatenate([self._unsafe, unsafe])
        self._flat = np.concatenate([self._flat, flat])
        return np.arange(first, first + len(pieces))

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Places of new pieces, encoded word and closing marks apart (a pre-token of letters
        ends where the marks begin)."""
        mark = "" if self.drops_space else "\r"      # marks after a word have no space before them
        stems = pc.utf8_rtrim(pieces, TAIL)
        sizes = np.asarray(pc.binary_length(stems))
        marked = np.asarray(pc.utf8_is_alpha(stems)) & (sizes < np.asarray(pc.binary_length(pieces)))
        both = np.flatnonzero(marked)
        words = pieces.take(pa.array(both))
        tails = pc.binary_join_element_wise(pa.scalar(mark, pa.large_string()), _behind(words, sizes[both]),
                                            pa.scalar("", pa.large_string()))
        numbered = pa.concat_arrays([pc.if_else(pa.array(marked), stems, pieces), tails]).dictionary_encode()
        del stems, tails
        parts, codes = numbered.dictionary, np.asarray(numbered.indices)
        at = self._places(parts)
        fresh = np.flatnonzero(at < 0)
        for lo in range(0, len(fresh), MISS_BATCH):
            some = fresh[lo:lo + MISS_BATCH]
            few = parts.take(pa.array(some))
            at[some] = self._add(few, *self._joined(few))
        out = at[codes[:len(pieces)]]
        if len(both):
            pair = np.empty(2 * len(both), np.int64)
            pair[0::2], pair[1::2] = out[both], at[codes[len(pieces):]]
            lens = self._lens[pair]
            flat = self._flat[ragged(self._starts[pair], lens)]
            out[both] = self._add(words, flat, lens[0::2] + lens[1::2], np.zeros(len(both), bool))
        return out

    def _in_one_go(self, texts: pa.Array) -> np.ndarray:
        """Which texts may not be cut, whatever their pieces are."""
        whole = np.zeros(len(texts), bool)
        if not self.drops_space:
            whole |= np.asarray(pc.match_substring(texts, "\r"))
        normalizer = self.tokenizer.normalizer
        for content, normalized in self.added:
            whole |= np.asarray(pc.match_substring(texts, content))
            if normalized and normalizer is not None:        # looked for in the normalised text
                spelt = normalizer.normalize_str(content)
                whole |= np.array([spelt in normalizer.normalize_str(t) for t in texts.to_pylist()], bool)
        return whole

    def _encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.drops_space:
            cut = pc.replace_substring(texts, "\n", " ")
        else:
            cut = pc.binary_join_element_wise(pa.scalar("\r", pa.large_string()),
                                              pc.replace_substring(texts, "\n", " \n"),
                                              pa.scalar("", pa.large_string()))
        words = pc.split_pattern(cut, " ")
        bounds = np.asarray(words.offsets)
        numbered = words.values[bounds[0]:bounds[-1]].dictionary_encode()
        bounds = bounds - bounds[0]
        codes = np.asarray(numbered.indices)
        at = self._places(numbered.dictionary)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._learn(numbered.dictionary.take(pa.array(new)))
        unsafe = self._unsafe[at]
        del cut, words, numbered
        ends, out = self._gathered(at, codes)
        ends = ends[bounds]
        if len(self._lens) > MEMO_ENTRIES:
            self._cut_back(at)
            at = np.arange(len(at))
        self._common = at[np.bincount(codes, minlength=len(at)) > 1]
        uncut = self._in_one_go(texts)
        if not unsafe.any() and not uncut.any():
            return out, ends
        bad = np.concatenate([[0], np.cumsum(unsafe[codes])])[bounds]
        whole = np.flatnonzero((np.diff(bad) > 0) | uncut)
        again = dict(zip(whole.tolist(), self._raw(texts.take(pa.array(whole)).to_pylist())))
        parts = [again[i] if i in again else out[ends[i]:ends[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _gathered(self, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bounds of each word's ids and the ids, of words ``codes`` that are pieces ``at``.

        Ids are gathered by blocks of words: their places take several times the room of the ids."""
        starts, lens = self._starts[at], self._lens[at]
        ends = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(lens[codes], out=ends[1:])
        out = np.empty(ends[-1], self.dtype)
        for lo in range(0, len(codes), GATHER):
            some = codes[lo:lo + GATHER]
            out[ends[lo]:ends[lo + len(some)]] = self._flat[ragged(starts[some], lens[some])]
        return ends, out

    def _cut_back(self, at: np.ndarray) -> None:
        """Keeps the pieces at the given places only."""
        pieces, lens = self._pieces.take(pa.array(at)), self._lens[at]
        flat, unsafe = self._flat[ragged(self._starts[at], lens)], self._unsafe[at]
        self._forget()
        self._add(pieces, flat, lens, unsafe)

    def encode(self, texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For an Arrow string array (null: empty), yields (first text, ids, bounds) of slices of
        about ``SLICE_BYTES``; text ``first + i`` has ``ids[bounds[i]:bounds[i + 1]]``."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
        at = 0
        while at < len(texts):
            upto = sizes[at - 1] + SLICE_BYTES if at else SLICE_BYTES
            to = max(at + 1, int(np.searchsorted(sizes, upto, side="right")))
            ids, bounds = self._encode_slice(texts.slice(at, to - at))
            yield at, ids, bounds
            at = to
            pa.default_memory_pool().release_unused()
