"""Re-Pair grammar compression of token ids, and its random-access decoding.

Rounds replace frequent neighbouring pairs by new symbols, many pairs at a time: where chosen pairs overlap, the more
frequent one goes first, and in a run of one symbol every other pair. Rounds go on until no pair occurs LEAST times; after the first one only pairs
with a symbol of the last round, and those that were passed over, are counted anew, as no other pair can have become more frequent.
Pairs never span two documents, so a document can be decoded alone. A rule stores its two symbols and the
number of ids it stands for.
"""

from __future__ import annotations

import numpy as np

#: Occurrences that pay for a rule: it takes two symbols and a length itself.
LEAST = 8
LAST = np.uint32(1 << 31)


def _frequent(pairs: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs of at least LEAST occurrences, most frequent first; for each given pair its place among them, or their number; pairs not counted).

    Pairs are counted in a hash table without a sort. A bucket counts its first pair; others that fall into it often enough wait for
    another turn, which has another hash.
    """
    bits = max(8, min(20, int(len(pairs)).bit_length()))
    bucket = ((pairs * (np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * turn))) >> np.uint64(64 - bits)).astype(np.int32)
    # The pairs themselves, as their places would be looked up all over the pairs.
    owner = np.empty(1 << bits, np.uint64)
    owner[bucket[::-1]] = pairs[::-1]
    same = owner[bucket] == pairs
    counts = np.bincount(bucket[same], minlength=1 << bits)
    often = np.flatnonzero(counts >= LEAST)
    often = often[np.lexsort((owner[often], -counts[often]))]
    rank = np.full(1 << bits, len(often), np.int32)
    rank[often] = np.arange(len(often), dtype=np.int32)
    other = bucket[~same]
    waits = np.zeros(len(pairs), bool)
    waits[~same] = (np.bincount(other, minlength=1 << bits) >= LEAST)[other]
    return owner[often], np.where(same, rank[bucket], np.int32(len(often))), waits


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends of the documents in symbols, rules as pairs, expansion length of each rule).

    ends: for each document, the index behind its last id. Symbols from ``vocabulary`` on are rules.
    """
    symbols, ends = ids.astype(np.uint32), ends.astype(np.int64)
    rules, length = [np.zeros((0, 2), np.uint32)], np.ones(vocabulary, np.uint32)
    # A document's last symbol begins no pair and is marked.
    symbols[ends[ends > 0] - 1] |= LAST
    # Places whose symbol and the next one are looked at as a pair.
    at = np.flatnonzero(symbols < LAST).astype(np.int32)
    turn = 0
    while len(at):
        turn += 1
        pairs = (symbols[at].astype(np.uint64) << np.uint64(32)) | (symbols[at + 1] & ~LAST)
        keys, place, waits = _frequent(pairs, turn)
        none = np.int32(len(keys))
        some = waits | (place < none)
        at, pairs, place = at[some], pairs[some], place[some]
        beside = at[1:] == at[:-1] + 1
        # Of overlapping equal pairs every other one.
        again = np.flatnonzero(beside & (pairs[1:] == pairs[:-1])) + 1
        mine = place
        if len(again):
            new = np.ones(len(again), bool)
            new[1:] = again[1:] != again[:-1] + 1
            inner = np.arange(len(again))
            odd = again[(inner - np.maximum.accumulate(np.where(new, inner, 0))) % 2 == 0]
            mine = place.copy()
            mine[odd] = none
        took = mine < none
        took[1:] &= ~beside | (mine[1:] < mine[:-1])
        took[:-1] &= ~beside | (mine[:-1] <= mine[1:])
        # A rule that hardly anything is left for isn't made.
        often = np.bincount(mine[took], minlength=len(keys)) >= LEAST // 2
        took[took] = often[mine[took]]
        if not took.any():
            at = at[place == none]  # those that wait
            continue
        base, number = len(length), np.cumsum(often, dtype=np.int64) - 1
        taken = at[took]
        # Pairs that were passed over and are still there: they neither begin nor end in a taken pair.
        free = ~took
        free[1:] &= ~(beside & took[:-1])
        free[:-1] &= ~(beside & took[1:])
        left = at[free]
        symbols[taken] = (base + number[mine[took]]).astype(np.uint32) | (symbols[taken + 1] & LAST)
        keep = np.ones(len(symbols), bool)
        keep[taken + 1] = False
        symbols = symbols[keep]
        ends -= np.searchsorted(taken, ends - 1)
        # Each place moves down by the taken ones before it.
        first = taken - np.arange(len(taken), dtype=np.int32)
        left = left - np.searchsorted(taken, left).astype(np.int32)
        if 16 * (2 * len(first) + len(left)) > len(symbols):
            around = np.zeros(len(symbols), bool)
            around[first] = around[np.maximum(first - 1, 0)] = around[left] = True
            at = np.flatnonzero(around & (symbols < LAST)).astype(np.int32)
        else:
            at = np.sort(np.concatenate([first, np.maximum(first - 1, 0), left]))
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1]
            at = at[new & (symbols[at] < LAST)]
        keys = keys[often]
        new = np.stack([keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        rules.append(new)
        length = np.concatenate([length, length[new[:, 0]] + length[new[:, 1]]])
    return symbols & ~LAST, ends, np.concatenate(rules), length[vocabulary:]


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids that symbols stand for."""
    rule = symbols[symbols >= vocabulary]
    if len(rule) > len(rules):
        # Each rule is expanded once, and symbols are gathered from their expansions.
        whole = _descend(np.arange(vocabulary, vocabulary + len(rules), dtype=np.uint32), rules, lengths, vocabulary)
        flat = np.concatenate([np.arange(vocabulary, dtype=np.uint32), whole])
        length = np.concatenate([np.ones(vocabulary, np.int64), lengths.astype(np.int64)])
        start = np.cumsum(length) - length
        each = length[symbols]
        shift = np.cumsum(each) - each
        return flat[np.repeat(start[symbols] - shift, each) + np.arange(int(each.sum()))]
    return _descend(symbols, rules, lengths, vocabulary)


def _descend(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    length = np.concatenate([np.ones(vocabulary, np.uint32), lengths])
    first = np.concatenate([np.zeros(vocabulary, np.uint32), rules[:, 0]])
    second = np.concatenate([np.zeros(vocabulary, np.uint32), rules[:, 1]])
    out = np.empty(int(length[symbols].sum(dtype=np.int64)), np.uint32)
    at = np.cumsum(length[symbols], dtype=np.int64) - length[symbols]
    while len(symbols):
        out[at] = symbols
        open_ = np.flatnonzero(symbols >= vocabulary)
        symbols, at = symbols[open_], at[open_]
        a, b = first[symbols], second[symbols]
        symbols, at = np.concatenate([a, b]), np.concatenate([at, at + length[a]])
    return out
