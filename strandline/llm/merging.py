"""Merging many short byte strings by one BPE merge list at a time, in numpy.

All words of a batch lie one after another in one array of token ids. A round finds
each word's best-ranked pair and merges its occurrences from left to right; words
without a pair left are done. A pair's rank comes from an open-addressing hash table.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)
_EMPTY = np.uint32(0xFFFFFFFF)


class MergeTable:
    def __init__(self, merges: list[tuple[int, int, int]]):
        """merges: (left id, right id, id of the merged token), best first; ids below 65535."""
        self.bits = max(12, int(4 * len(merges)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, _EMPTY, np.uint32)
        self.ranks = np.full(size, NONE, np.int32)
        self.made = np.array([m[2] for m in merges] or [0], np.int32)
        mask = size - 1
        for rank, (a, b, _) in enumerate(merges):
            key = (a << 16) | b
            slot = ((key * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - self.bits)
            while self.keys[slot] != _EMPTY and self.keys[slot] != key:
                slot = (slot + 1) & mask
            if self.keys[slot] == _EMPTY:
                self.keys[slot] = key
                self.ranks[slot] = rank

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        slot = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint32(1)) & np.uint32(len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != _EMPTY)]
        return out

    def merge(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """tokens: the starting ids of all words, which have ``sizes`` (at least 1) of them. Returns the final ids of all words
        and how many each has."""
        n_words = len(sizes)
        word = np.repeat(np.arange(n_words, dtype=np.int32), sizes)
        tokens = tokens.astype(np.int32)
        rank = np.full(len(tokens), NONE, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.rank(tokens[inner], tokens[inner + 1])
        done_tokens, done_words = [], []
        while len(tokens):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(tokens)))
            over = best == NONE
            if over.any():
                gone = np.repeat(over, length)
                done_tokens.append(tokens[gone])
                done_words.append(word[gone])
                stay = ~gone
                tokens, word, rank = tokens[stay], word[stay], rank[stay]
                best, length = best[~over], length[~over]
                if not len(tokens):
                    break
            chosen = rank == np.repeat(best, length)
            beside = np.flatnonzero(chosen[1:] & chosen[:-1])
            if len(beside):  # a run of one repeated token: every second pair
                at = np.flatnonzero(chosen)
                starts = np.concatenate(([True], np.diff(at) > 1))
                chosen[at[(np.arange(len(at)) - np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))) % 2 == 1]] = False
            at = np.flatnonzero(chosen)
            tokens[at] = self.made[rank[at]]
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            tokens, word, rank = tokens[keep], word[keep], rank[keep]
            at = place[at]
            changed = np.zeros(len(tokens), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            rank[changed] = NONE
            changed[:-1] &= word[1:] == word[:-1]
            changed[-1] = False
            around = np.flatnonzero(changed)
            rank[around] = self.rank(tokens[around], tokens[around + 1])
        if not done_tokens:
            return tokens, np.zeros(n_words, np.int64)
        tokens, word = np.concatenate(done_tokens), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return tokens[order], np.bincount(word, minlength=n_words)
