"""Tokenizer libraries over Arrow columns.

The library encodes each distinct space-separated piece of a batch once, and the
ids of a text are gathered from its pieces. That gives the library's own ids where
no piece can influence the next one:

* byte-level BPE splits before every space that follows a non-space, and a piece
  keeps its leading space;
* the lower-casing word BPE drops white space and never merges across it;
* the sentencepiece model has no piece with a space mark behind another
  character, so a merge never crosses the start of a word.

For both JSON tokenizers' splitters Latin-1 letters are one word and the ASCII punctuation behind
them is another, so of such pieces only distinct words and distinct punctuation are encoded, the words straight by the library's model.

Texts where a space touches other white space or an end of the text, and texts
with a special token's string or a literal space mark, are encoded whole instead.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at a time, and words and other pieces that a worker remembers.
SLICE_BYTES = 4 << 20
REMEMBERED = 400_000
# Latin-1 letters, perhaps behind a space, and the ASCII punctuation after them.
SIMPLE = r"^(?P<word> ?[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"


@dataclass(frozen=True)
class TokenizerSpec:
    """A tokenizer file: .json for the tokenizers library, .model for sentencepiece."""

    path: str

    @property
    def library(self) -> str:
        return "sentencepiece" if self.path.endswith(".model") else "tokenizers"


def public_spec(name: str) -> TokenizerSpec:
    import public_tokenizers

    return TokenizerSpec(public_tokenizers.path(name))


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level tokenizers write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids in turn, number of those of each)."""
    length = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum())), length


class _Encoder:
    """ids() and counts() of Arrow string arrays; keeps the pieces it has met."""

    def __init__(self, spec: TokenizerSpec) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lead = ""
        self.remembered = REMEMBERED
        if spec.library == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=spec.path)
            self.library = lambda texts: model.encode(texts, num_threads=1)
            self.pieces = self.library
            self.special = ["▁"]
            self.line: list[int] = []
        else:
            import json

            from tokenizers import Tokenizer

            model = Tokenizer.from_file(spec.path)
            self.library = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            self.pieces = None
            self.special = [t.content for t in model.get_added_tokens_decoder().values()]
            # Byte-level BPE without a normaliser keeps case and the space of a piece.
            self.lower = json.loads(model.to_str())["normalizer"] is not None
            self.lead = "" if self.lower else " "
            # What the model sees for a letter beyond ASCII.
            self.letters = {chr(c): "".join(_byte_letters()[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}
            self.space = "" if self.lower else _byte_letters()[32]
            self.tokenize = model.model.tokenize
            self.line = self.library(["a\nb"])[0][1:-1]
        self._forget()

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of those of each) of Latin-1 words, perhaps behind a space."""
        if self.space:
            words = "\n".join(words).replace(" ", self.space).split("\n")
        tokenize, letters = self.tokenize, self.letters
        return _flat([[t.id for t in tokenize(w if w.isascii() else "".join([letters.get(c, c) for c in w]))] for w in words])

    def _rest(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any pieces; words around single line feeds, which are a token of their own or none, are encoded as such."""
        if self.pieces == self.library:
            return _flat(self.library(pieces))
        parts = np.array([p.count("\n") for p in pieces]) + 1
        good = parts > 1
        if good.any():
            lines = "\n".join(p for p, g in zip(pieces, good.tolist(), strict=True) if g).split("\n")
            word, tail = self._simple(pa.array(lines, pa.string()))
            each = parts[good]
            at = np.cumsum(each) - each
            simple = np.minimum.reduceat(word, at) >= 0
            good[good] = simple
            entries = np.stack([np.ones(len(word), np.int64), word, tail], 1)
            entries[at, 0] = 0
            entries = entries[np.repeat(simple, each)].ravel()
        other, number = _flat(self.library([p for p, g in zip(pieces, good.tolist(), strict=True) if not g]))
        length = np.zeros(len(pieces), np.int64)
        length[~good] = number
        if not good.any():
            return other, length
        flat = self._gather(entries)
        each = 3 * parts[good]
        length[good] = np.add.reduceat(self.length[entries], np.cumsum(each) - each)
        out, mine = np.empty(int(length.sum()), np.uint32), np.repeat(good, length)
        out[mine], out[~mine] = flat, other
        return out, length

    def _gather(self, entries: np.ndarray) -> np.ndarray:
        """The ids of the entries in turn."""
        each = self.length[entries]
        return self.flat[np.repeat(self.start[entries] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]

    def _forget(self) -> None:
        # What is known of words, punctuation and other pieces: the entry with their ids. Entry 0 has none, entry 1 those of a line feed.
        self.known: list[dict[str, int]] = [{}, {"": 0}, {}]
        self.flat = np.array(self.line, np.uint32)
        self.length = np.array([0, len(self.flat)], np.int64)
        self.start = np.zeros(2, np.int64)

    def _entries(self, kind: int, names: list[str], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The entries of distinct names; new ones are encoded first."""
        known = self.known[kind]
        found = np.fromiter(map(known.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [names[i] for i in missing.tolist()]
            flat, length = encode(new)
            found[missing] = len(self.length) + np.arange(len(new))
            known.update(zip(new, found[missing].tolist(), strict=True))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.flat = np.concatenate([self.flat, flat])
        return found

    def _simple(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each piece that is a word with punctuation behind it the entries of both; -1 for others."""
        parts = pc.extract_regex(pieces, SIMPLE)
        is_one = np.asarray(parts.is_valid())
        word, tail = parts.field("word").filter(pa.array(is_one)), parts.field("tail").filter(pa.array(is_one))
        out = np.full((2, len(pieces)), -1, np.int64)
        for k, (column, encode) in enumerate((((pc.utf8_lower(word) if self.lower else word), self._words), (tail, lambda x: _flat(self.library(x))))):
            coded = column.dictionary_encode()
            if len(coded):
                out[k][is_one] = self._entries(k, coded.dictionary.to_pylist(), encode)[coded.indices.to_numpy(zero_copy_only=False)]
        return out[0], out[1]

    def _spans(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, and for each distinct piece where they start there and how many they are)."""
        if self.pieces == self.library:
            first, second = np.full(len(pieces), -1, np.int64), np.zeros(len(pieces), np.int64)
        else:
            first, second = self._simple(pieces)
        others = np.flatnonzero(first < 0)
        if len(others):
            first[others], second[others] = self._entries(2, pieces.take(pa.array(others)).to_pylist(), self._rest), 0
        both = np.stack([first, second], 1).ravel()
        length = self.length[both].reshape(-1, 2).sum(1)
        return self._gather(both), np.cumsum(length) - length, length

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts the pieces can't stand for."""
        # Any white space before a space, or a space at either end.
        found = pc.match_substring_regex(texts, r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] |^ | $|^$|\x00")
        for s in self.special:
            found = pc.or_(found, pc.match_substring(texts, s))
        return np.asarray(found.fill_null(True).to_numpy(zero_copy_only=False), bool)

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of each piece, pieces before each text, ids, and the start and number of those of each place)."""
        if sum(map(len, self.known)) > self.remembered:
            self._forget()
        split = pc.split_pattern(texts, " ")
        offsets = np.asarray(split.offsets, np.int64)
        offsets -= offsets[0]
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary
        places = coded.indices.to_numpy(zero_copy_only=False)
        if self.lead:
            # The first piece of a text has no space before it.
            first = names.take(pa.array(places[offsets[:-1]])).dictionary_encode()
            places = places.copy()
            places[offsets[:-1]] = len(names) + first.indices.to_numpy(zero_copy_only=False)
            names = pa.concat_arrays([pc.binary_join_element_wise(self.lead, names, ""), first.dictionary])
        return places, offsets, *self._spans(names)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text; no text is null."""
        n = np.zeros(len(texts), np.int64)
        whole = self._whole(texts)
        if whole.any():
            n[whole] = [len(x) for x in self.library(texts.filter(pa.array(whole)).to_pylist())]
        if not whole.all():
            places, offsets, _, _, each = self._split(texts.filter(pa.array(~whole)))
            n[~whole] = np.add.reduceat(each[places], offsets[:-1])
        return n

    def ids(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in turn, ids before each text and in all), with ``end`` after each text."""
        extra = int(end is not None)
        whole = self._whole(texts)
        n = np.zeros(len(texts), np.int64)
        direct = self.library(texts.filter(pa.array(whole)).to_pylist()) if whole.any() else []
        n[whole] = [len(x) for x in direct]
        if not whole.all():
            places, offsets, known, start, each = self._split(texts.filter(pa.array(~whole)))
            length = each[places]
            n[~whole] = np.add.reduceat(length, offsets[:-1])
        before = np.concatenate([[0], np.cumsum(n + extra)])
        out = np.empty(before[-1], np.uint32)
        if extra:
            out[before[1:] - 1] = end
        for at, x in zip(np.flatnonzero(whole), direct, strict=True):
            out[before[at] : before[at] + len(x)] = x
        if not whole.all():
            total = int(length.sum())
            shift = np.cumsum(length) - length
            flat = known[np.repeat(start[places] - shift, length) + np.arange(total)]
            if not whole.any():
                mask = np.ones(len(out), bool)
                if extra:
                    mask[before[1:] - 1] = False
                out[mask] = flat
            else:
                own = np.flatnonzero(~whole)
                target = np.repeat(before[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(total)
                out[target] = flat
        return out, before


_ENCODERS: dict[TokenizerSpec, _Encoder] = {}


def encoder(spec: TokenizerSpec, remembered: int = REMEMBERED) -> _Encoder:
    """This worker's encoder; it outlives a task."""
    if spec not in _ENCODERS:
        _ENCODERS[spec] = _Encoder(spec)
    _ENCODERS[spec].remembered = remembered
    return _ENCODERS[spec]


def batches(parts: Iterable[pa.RecordBatch], id_name: str, text_name: str, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of at most about slice_bytes of text, or one text."""
    for part in parts:
        ids, texts = part.column(id_name), part.column(text_name)
        if not len(texts):
            continue
        size = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64))
        at = 0
        while at < len(texts):
            done = int(size[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + slice_bytes, "right")))
            yield ids.slice(at, to - at), texts.slice(at, to - at)
            at = to
