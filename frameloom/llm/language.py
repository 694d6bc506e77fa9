"""Language identification by unigram models whose segmentations are summed out.

A language is a table of probabilities over the pieces of a fixed public vocabulary. A word,
with its word start, may be cut into pieces in many ways; its probability is the sum over all of them of the product
of their pieces' probabilities, which a forward algorithm adds up from left to right. A text's
logarithm is the sum of its words', and its language the one with the largest posterior, the
languages' shares of the learned documents being the prior.

The probabilities are learned by expectation-maximisation: a pass over all learned documents counts how often each piece is
expected in each language (forward-backward over the distinct words of a task, in whole units of
2 ** -UNIT, so that sums don't depend on partitions), and Spark adds the counts up. The driver
holds languages x pieces numbers, whatever the size of the corpus.

A word is a run of letters, lower-cased; a run of more than LONGEST letters is several words. Characters without
a piece are cut into the vocabulary's bytes, so every word has a segmentation.

Cases: a null text, or one without a letter, is ``und`` with score 0, and so is any where nothing could be learned. Null ids
are scored and never held out from learning; rows that repeat an id each get their row. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST, UNIT = 1024, 16
#: Distinct words that are cut at a time, that a worker remembers scores of, and that it counts before it adds them up.
CHUNK, REMEMBERED, COUNTED = 4096, 300_000, 300_000
WORD = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")
#: Characters of a text that are matched at a time.
PART = 1 << 20


class Vocabulary:
    """The lower-case words' pieces of a sentencepiece model as a byte trie."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        pieces: dict[bytes, int] = {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                pieces.setdefault(bytes([int(piece[1:-1], 16)]), i)
            else:
                letters = piece.removeprefix("▁")
                if letters == letters.lower() and (letters.isalpha() or piece == "▁"):
                    pieces[piece.replace("▁", " ").encode()] = i
        self.single = np.array(sorted(i for p, i in pieces.items() if len(p) == 1 and p[0] >= 0x80))
        used = sorted({b for p in pieces for b in p})
        self.kind = np.zeros(256, np.int32)
        self.kind[used] = np.arange(len(used))
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for piece, i in pieces.items():
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = i
        self.next = np.zeros((len(children), len(used)), np.int32)
        for node, below in enumerate(children):
            for b, child in below.items():
                self.next[node, self.kind[b]] = child
        self.ends = np.array(ends, np.int32)
        self.ids = np.array(sorted(pieces.values()))
        self.depth = max(map(len, pieces))

    def matches(self, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, length, piece) of every piece in data; end: of each byte, where its word ends."""
        at = np.arange(len(data))
        node = np.zeros(len(data), np.int32)
        kinds = self.kind[data]
        found = []
        for d in range(self.depth):
            alive = at + d < end[at]
            at, node = at[alive], node[alive]
            node = self.next[node, kinds[at + d]]
            at, node = at[node > 0], node[node > 0]
            if not len(at):
                break
            piece = self.ends[node]
            whole = piece >= 0
            found.append((at[whole], np.full(int(whole.sum()), d + 1, np.int32), piece[whole]))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@dataclass
class Lattice:
    """Distinct words of similar length, and the pieces in them."""

    words: np.ndarray  # of each piece: its word
    first: np.ndarray  # its first byte in the word
    length: np.ndarray
    piece: np.ndarray
    sizes: np.ndarray  # of each word: bytes


def lattices(vocab: Vocabulary, words: list[str]) -> Iterator[tuple[np.ndarray, Lattice]]:
    """(places of words, their lattice), shorter words first."""
    coded = [b" " + w.encode() for w in words]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        # About as many bytes as CHUNK words of usual length have.
        part = order[at : at + max(1, CHUNK * 12 // int(sizes[order[min(len(order) - 1, at + CHUNK - 1)]]))][:CHUNK]
        at += len(part)
        data = np.frombuffer(b"".join([coded[i] for i in part.tolist()]), np.uint8)
        size = sizes[part]
        start = np.cumsum(size) - size
        word = np.repeat(np.arange(len(part)), size)
        first, length, piece = vocab.matches(data, (start + size)[word])
        yield part, Lattice(word[first], first - start[word[first]], length, piece, size)


def _sums(lattice: Lattice, p: np.ndarray, depth: int, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(mantissas, exponents) by word, byte and model: the sum over all segmentations of what stands before a byte, or behind it.

    Whole powers of two are taken out of long words as sums get small, which rounds nothing.
    """
    n, top, models = len(lattice.sizes), int(lattice.sizes.max()), p.shape[1]
    value, exponent = np.zeros((n, top + 1, models)), np.zeros((n, top + 1), np.int64)
    value[np.arange(n), lattice.sizes if backward else 0] = 1
    end = lattice.first + lattice.length
    source, target = (end, lattice.first) if backward else (lattice.first, end)
    # Pieces of one target and length belong to different words.
    key = ((top - target) if backward else target) * (depth + 1) + lattice.length
    order = np.argsort(key.astype(np.int16 if top * (depth + 1) + depth < 1 << 15 else np.int64), kind="stable")
    ends = np.flatnonzero(np.append(np.diff(key[order]) != 0, True)) + 1
    w = lattice.words[order] * (top + 1)
    a, b, weight = w + source[order], w + target[order], p[lattice.piece[order]]
    flat, exponents = value.reshape(-1, models), exponent.reshape(-1)
    start, done = 0, 0
    for stop in ends.tolist():
        if top > 2 * depth:
            t = int(b[start]) % (top + 1)
            if t != done:
                done = t
                near = slice(t, t + depth + 1) if backward else slice(max(0, t - depth), t + 1)
                high = value[:, near].max((1, 2))
                small = np.flatnonzero((high > 0) & (high < 2.0**-200))
                if len(small):
                    value[small, near] *= 2.0**200
                    exponent[small, near] -= 200
            exponents[b[start:stop]] = exponents[a[start:stop]]
        flat[b[start:stop]] += flat[a[start:stop]] * weight[start:stop]
        start = stop
    return value, exponent


def log_words(vocab: Vocabulary, words: list[str], p: np.ndarray) -> np.ndarray:
    """The logarithm of each word's probability under each model; p: pieces x models."""
    out = np.zeros((len(words), p.shape[1]))
    for part, lattice in lattices(vocab, words):
        value, exponent = _sums(lattice, p, vocab.depth)
        rows = np.arange(len(part))
        out[part] = np.log(value[rows, lattice.sizes]) + (exponent[rows, lattice.sizes] * np.log(2))[:, None]
    return out


def expected_pieces(vocab: Vocabulary, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """pieces x languages: how often each piece is expected, in units of 2 ** -UNIT.

    counts: words x languages; p: pieces x languages, or one model for all of them.
    """
    out = np.zeros((vocab.size, counts.shape[1]), np.int64)
    for part, lattice in lattices(vocab, words):
        (a, ea), (b, eb) = _sums(lattice, p, vocab.depth), _sums(lattice, p, vocab.depth, True)
        w, end = lattice.words, lattice.first + lattice.length
        whole, shift = a[w, lattice.sizes[w]], ea[w, lattice.first] + eb[w, end] - ea[w, lattice.sizes[w]]
        share = np.ldexp(a[w, lattice.first] * p[lattice.piece] * b[w, end] / whole, shift[:, None].astype(np.int32))
        units = np.rint(share * (1 << UNIT)).astype(np.int64)
        mine = counts[part]
        for language in range(counts.shape[1]):
            times = mine[w, language]
            some = np.flatnonzero(times)
            np.add.at(out[:, language], lattice.piece[some], units[some, min(language, units.shape[1] - 1)] * times[some])
    return out


def together(texts: list[str]) -> Iterator[str]:
    """The texts, neighbours joined by a line feed up to PART characters; no word crosses it."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) >= PART:
            yield "\n".join(held)
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield "\n".join(held)


@dataclass
class Model:
    """p: pieces x languages; prior: logarithms of the languages' shares."""

    path: str
    languages: list[str]
    p: np.ndarray
    prior: np.ndarray


def _letters(word: str) -> str:
    """The word's letters; runs may hold number-like characters that aren't letters."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def _learn_pass(docs: DataFrame, path: str, languages: list[str] | None, p: np.ndarray | None) -> DataFrame:
    """(lang, piece, n): expected pieces, and under piece -1 the number of documents, of docs (lang, text)."""

    def run(batches):
        vocab = vocabulary(path)
        known = {x: i for i, x in enumerate(languages)} if languages else {}
        base = p if p is not None else start_model(vocab)
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(vocab.size, np.int64))
        n_docs: Counter[str] = Counter()
        held: dict[str, Counter[str]] = defaultdict(Counter)

        def close() -> None:
            for name, c in held.items():
                for w in [w for w in c if not w.isalpha()]:
                    n = c.pop(w)
                    if w := _letters(w):
                        c[w] += n
            words = sorted({w for c in held.values() for w in c})
            place = {w: i for i, w in enumerate(words)}
            names = sorted(held)
            counts = np.zeros((len(words), len(names)), np.int64)
            for j, name in enumerate(names):
                counts[[place[w] for w in held[name]], j] = list(held[name].values())
            units = expected_pieces(vocab, words, counts, base if p is None else p[:, [known[x] for x in names]])
            for j, name in enumerate(names):
                total[name] += units[:, j]
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                names = np.array(batch.column("lang").slice(at, 512).to_pylist(), object)
                texts = batch.column("text").slice(at, 512).to_pylist()
                for name in dict.fromkeys(names.tolist()):
                    mine = np.flatnonzero(names == name).tolist()
                    n_docs[name] += len(mine)
                    for part in together([texts[i] or "" for i in mine]):
                        held[name].update(WORD.findall(part.lower()))
                        if sum(map(len, held.values())) > COUNTED:
                            close()
        close()
        for lang, n in sorted(n_docs.items()):
            some = np.flatnonzero(total[lang])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(some) + 1), pa.string()), pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(total[lang][some], n).astype(np.int64))], ["lang", "piece", "n"]
            )

    return docs.mapInArrow(run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))


def start_model(vocab: Vocabulary) -> np.ndarray:
    """Every piece alike, so that few long pieces beat many short ones; bytes of characters without a piece much rarer."""
    p = np.zeros((vocab.size, 1))
    p[vocab.ids] = 1
    p[vocab.single] = 1e-3
    return p / p.sum()


def learn(docs: DataFrame, path: str, passes: int = 1, smoothing: float = 1000.0, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model of every language of docs, learned on all of them; rows without a language are left out.

    passes: of expectation-maximisation; on sf0.1 a second one leaves the held-out accuracy on whole texts as it is.
    smoothing: pieces of all languages together that are added to each language. There are few languages, each a row of counts on the driver.
    """
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    vocab = vocabulary(path)
    languages, p, n_docs = None, None, {}
    for _ in range(passes):
        # Languages x pieces rows at most.
        rows = _learn_pass(known, path, languages, p).collect()
        n_docs = {r["lang"]: int(r["n"]) for r in rows if r["piece"] < 0}
        languages = sorted(n_docs)
        place = {x: i for i, x in enumerate(languages)}
        counts = np.zeros((vocab.size, len(languages)))
        for r in rows:
            if r["piece"] >= 0:
                counts[r["piece"], place[r["lang"]]] = float(r["n"]) / (1 << UNIT)
        if not languages:
            break
        rare = start_model(vocab)[:, 0]
        common = counts.sum(1) + rare * len(vocab.ids) / 2
        p = counts + (smoothing * common / common.sum())[:, None]
        p /= p.sum(0)
    if not languages:
        return Model(path, [], np.zeros((vocab.size, 0)), np.zeros(0))
    share = np.array([n_docs[x] for x in languages], float)
    return Model(path, languages, p, np.log(share / share.sum()))


class Scorer:
    """(language, posterior) of texts; remembers words, which changes no score."""

    def __init__(self, model: Model) -> None:
        self.model, self.vocab = model, vocabulary(model.path)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.model.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        # Words of short texts one by one, in their order; of long ones each distinct word once.
        counted = [Counter(m.group() for m in WORD.finditer(t.lower())) if t and len(t) > PART else None for t in texts]
        lists = [(WORD.findall(t.lower()) if t else []) if c is None else list(c) for t, c in zip(texts, counted, strict=True)]
        if len(self.place) > REMEMBERED:
            self._forget()
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        words = list(chain.from_iterable(lists))
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        real = [x for x in dict.fromkeys(w if w.isalpha() else _letters(w) for w in new) if x and x not in self.place]
        start = len(self.table)
        self.place.update(zip(real, range(start, start + len(real)), strict=True))
        for w in new:
            if not w.isalpha():
                self.place[w] = self.place[x] if (x := _letters(w)) else -1
        if real:
            self.table = np.concatenate([self.table, log_words(self.vocab, real, self.model.p)])
        rows = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        times = np.fromiter(chain.from_iterable(repeat(1, n) if c is None else c.values() for n, c in zip(sizes.tolist(), counted, strict=True)), np.float64, len(words)) * (rows >= 0)
        known = np.zeros(len(texts), bool)
        total = np.tile(self.model.prior, (len(texts), 1))
        if len(words) and len(self.table):
            full = np.flatnonzero(sizes)
            # Each text's words are added up on their own, in their order in it.
            starts = (np.cumsum(sizes) - sizes)[full]
            total[full] += np.add.reduceat(self.table[rows] * times[:, None], starts)
            known[full] = np.add.reduceat(times, starts) > 0
        best = total.argmax(1)
        shares = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.model.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, shares, 0.0)


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score (posterior of that language)."""
    kept = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        score = Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                languages, found = score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(languages, pa.string()), pa.array(found)], ["id", "held_out", "lang_pred", "score"])

    return kept.mapInArrow(run, f"id {dict(kept.dtypes)['id']}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
