"""Greedy word-piece counts by a linear longest-match automaton (operator 8).

A trie of the vocabulary gets failure links, and with each link the number of pieces popped on it,
computed once. A word is then read symbol by symbol: where no edge fits, the popped pieces are
added and the link is followed, until an edge fits. Every symbol is read once and links only
shorten what is pending, so the work is linear, and pieces themselves are never built. Distinct
words of a batch walk the automaton side by side in numpy.

Words are runs outside ASCII white space, A-Z lowered, as UTF-8 bytes closed by a word end. A word
with a symbol that no piece covers is one unknown piece.

Results in edge cases: null, empty and blank texts have no words and no pieces. Repeated rows get
equal results; doc_ids play no part. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from credscan.llm.words import hash_spans, text_bytes, word_spans

#: The symbol that closes a word, and its spelling in the vocabulary.
END, SUFFIX = 256, "</w>"
#: Symbols read side by side; the rest of longer words is read one by one.
WIDE = 48
AT_ONCE = 1 << 22


class Automaton:
    """The trie of ``pieces`` (tuples of symbols) with its failure links."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]) -> None:
        edges: dict[int, int] = {}  # node * 512 + symbol -> node
        order, ends = [], {0: False}
        for piece in pieces:
            node = 0
            for symbol in piece:
                key = node << 9 | symbol
                if key not in edges:
                    edges[key] = len(ends)
                    ends[edges[key]] = False
                    order.append((node, symbol, edges[key]))
                node = edges[key]
            ends[node] = node > 0
        depth = np.zeros(len(ends), int)
        for parent, _, node in order:
            depth[node] = depth[parent] + 1
        fail, popped = [-1] * len(ends), [0] * len(ends)
        for parent, symbol, node in sorted(order, key=lambda x: depth[x[2]]):
            if ends[node]:
                fail[node], popped[node] = 0, 1
                continue
            at, n = fail[parent], popped[parent]
            while at >= 0 and at << 9 | symbol not in edges:
                n += popped[at]
                at = fail[at]
            if at >= 0:
                fail[node], popped[node] = edges[at << 9 | symbol], n
        self.edges, self.fail, self.popped = edges, fail, popped
        keys = np.array(sorted(edges), np.int64)
        self.keys, self.targets = keys, np.array([edges[k] for k in keys.tolist()], np.int64)
        self.links, self.pops = np.array(fail), np.array(popped)

    def _step(self, state: int, n: int, symbol: int) -> tuple[int, int]:
        while (target := self.edges.get(state << 9 | symbol)) is None:
            n += self.popped[state]
            state = self.fail[state]
            if state < 0:
                return -1, 1
        return target, n

    def count(self, symbols: Iterable[int], state: int = 0, n: int = 0) -> int:
        """Pieces of one word without its end; from ``state`` with ``n`` pieces so far."""
        for symbol in [*symbols, END]:
            state, n = self._step(state, n, symbol)
            if state < 0:
                return 1
        while state > 0:
            n += self.popped[state]
            state = self.fail[state]
        return n if state == 0 else 1

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of the words data[start:end]."""
        order = np.argsort(starts - ends, kind="stable")  # longest first
        starts, sizes = starts[order], (ends - starts)[order]
        state, n = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for t in range(min(WIDE, int(sizes[0]) + 1) if len(sizes) else 0):
            live = np.flatnonzero((sizes[: np.searchsorted(-sizes, -t, side="right")] >= t) & (state[: np.searchsorted(-sizes, -t, side="right")] >= 0))
            at = np.minimum(starts[live] + t, len(data) - 1)
            symbol = np.where(sizes[live] == t, END, data[at].astype(np.int64))
            while len(live):
                key = state[live] << 9 | symbol
                place = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
                fits = self.keys[place] == key if len(self.keys) else np.zeros(len(live), bool)
                state[live[fits]] = self.targets[place[fits]] if len(self.keys) else 0
                live, symbol = live[~fits], symbol[~fits]
                n[live] += self.pops[state[live]]
                state[live] = self.links[state[live]]
                good = state[live] >= 0
                live, symbol = live[good], symbol[good]
        done = sizes < WIDE
        live = np.flatnonzero(done & (state > 0))
        while len(live):
            n[live] += self.pops[state[live]]
            state[live] = self.links[state[live]]
            live = live[state[live] > 0]
        for i in np.flatnonzero(~done & (state >= 0)):
            n[i] = self.count(data[starts[i] + WIDE : starts[i] + sizes[i]].tolist(), int(state[i]), int(n[i]))
            state[i] = 0
        out = np.empty(len(order), np.int64)
        out[order] = np.where(state < 0, 1, n)
        return out


@cache
def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def automaton(path: str) -> Automaton:
    """The automaton of a byte-level vocabulary file with word ends; special tokens are left out."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    special = {t["content"] for t in held["added_tokens"]}
    letters = byte_letters()
    pieces = []
    for token in held["model"]["vocab"]:
        if token not in special:
            closed = token.endswith(SUFFIX)
            symbols = tuple(letters[c] for c in (token[: -len(SUFFIX)] if closed else token))
            pieces.append((*symbols, END) if closed else symbols)
    return Automaton(pieces)


def counted(machine: Automaton, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and pieces of each text."""
    _, offsets = text_bytes(column)
    words, pieces = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, side="right")) - 1)
        data, starts, ends, bounds = word_spans(column.slice(at, upto - at))
        _, first, inverse = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        each = machine.counts(data, starts[first], ends[first])
        sums = np.concatenate([[0], np.cumsum(each[inverse])]) if len(first) else np.zeros(1, np.int64)
        words[at:upto] = np.diff(bounds)
        pieces[at:upto] = np.diff(sums[bounds])
        at = upto
    return words, pieces


def piece_counts(text: Column, vocabulary: str) -> Column:
    """struct<n_words long, n_pieces long> of a text column."""

    @F.arrow_udf("struct<n_words: bigint, n_pieces: bigint>")
    def run(column: pa.Array) -> pa.Array:
        words, pieces = counted(automaton(vocabulary), column)
        return pa.StructArray.from_arrays([pa.array(words), pa.array(pieces)], ["n_words", "n_pieces"])

    return run(text)
