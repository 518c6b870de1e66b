"""Word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie of word starts and continuations. Every node has a failure link to the
node of the text left over when the longest pieces in front of it are taken, and the number of pieces
that this takes; a word is matched in one pass over its characters, without backing up and without
building pieces. A word that cannot be matched to its end counts as one unknown piece. Counts of
recent words are kept in a bounded table, since words repeat.

Words are `[^\\x20\\x09-\\x0D]+`. Nulls and empty texts have no words and no pieces. Rows do not
depend on each other, so repeated rows and ties need no rule. An empty table gives an empty result.
Extra columns are carried; columns named like the results are replaced.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import ROW, WORD_PATTERN, column, kept_columns, mapped, named, packed, unpacked, with_fields

WORD = re.compile(WORD_PATTERN)
CACHED_WORDS = 400_000


class LongestMatch:
    """starts: pieces that begin a word; inner: pieces that continue one (without a marker)."""

    def __init__(self, starts: Iterable[str], inner: Iterable[str]) -> None:
        self.edges: list[dict[str, int]] = [{}, {}]  # 0: root of starts, 1: root of continuations
        piece = [False, False]
        for root, vocabulary in ((0, starts), (1, inner)):
            for word in vocabulary:
                at = root
                for c in word:
                    if c not in self.edges[at]:
                        self.edges[at][c] = len(self.edges)
                        self.edges.append({})
                        piece.append(False)
                    at = self.edges[at][c]
                if at > 1:
                    piece[at] = True
        n = len(self.edges)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque((c, child, root) for root in (0, 1) for c, child in self.edges[root].items())
        while queue:
            c, node, parent = queue.popleft()
            if piece[node]:
                self.fail[node], self.popped[node] = 1, 1
            else:
                z, count = self.fail[parent], self.popped[parent]
                while z >= 0 and c not in self.edges[z]:
                    count += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[node], self.popped[node] = self.edges[z][c], count
            queue.extend((d, child, node) for d, child in self.edges[node].items())

    def count(self, word: str) -> int:
        """Pieces of the word by greedy longest match; -1 if it has no such match."""
        edges, fail, popped = self.edges, self.fail, self.popped
        at, n = 0, 0
        for c in word:
            nxt = edges[at].get(c)
            while nxt is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
                nxt = edges[at].get(c)
            at = nxt
        while at != 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return -1
        return n


class WordCounter(dict):
    """Pieces and unknown words of a word as pieces * 2^32 + unknown, kept for recent words."""

    def __init__(self, automaton: LongestMatch) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word)
        out = n << 32 if n >= 0 else (1 << 32) | 1
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = out
        return out


def vocabulary_of_pieces(model: bytes) -> tuple[list[str], list[str]]:
    """Word starts and continuations of a SentencePiece model file; its control and byte pieces are left out."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    return [x[1:] for x in names if x.startswith("▁") and len(x) > 1], [x for x in names if not x.startswith("▁")]


def count_pieces(df: DataFrame, model: bytes, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """df's columns (or those in `carry`) with n_words, n_pieces and n_unknown; the model file (some MB at most) goes to the tasks with the code."""
    made = ["n_words", "n_pieces", "n_unknown"]
    carry = kept_columns(df, carry, made)
    source = df.select(packed(carry), named(text).alias("_text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or WordCounter(LongestMatch(*vocabulary_of_pieces(shared.value)))
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, value in enumerate(column(batch, "_text")):
                words = WORD.findall(value.as_py() or "")
                total = sum(map(counter.__getitem__, words))
                out[:, i] = len(words), total >> 32, total & 0xFFFFFFFF
            yield pa.RecordBatch.from_arrays([column(batch, ROW), *map(pa.array, out)], names=[ROW, *made])

    return unpacked(source.transform(mapped(run, with_fields(source, [ROW], ", ".join(f"{c} long" for c in made)))), carry, *made)
