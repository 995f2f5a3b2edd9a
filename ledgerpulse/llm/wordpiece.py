"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

The pieces form a trie with two roots, for the start and for the rest of a word.
Every node knows where to go on when the next character does not fit (failure
link) and how many pieces are then complete (popped count), both computed once.
A word is read once, character by character, and its greedy piece count is the
sum of popped counts; no piece is ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The character that marks the start of a word in the vocabulary.
MARK = "▁"
#: Distinct words whose counts a task remembers, and the longest of them.
REMEMBERED, LONGEST = 500_000, 64
_UNKNOWN = 1 << 40
_NONE = -1


def pieces_of(model_path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece vocabulary: neither control, unknown, unused nor byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_path)
    special = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)]


class Automaton:
    """Greedy piece counts of words; a word that pieces cannot spell counts as one unknown token."""

    def __init__(self, pieces: Iterable[str], mark: str = MARK):
        self.mark = mark
        self.goto: dict[int, int] = {}  # node << 21 | code point: node
        self.fail: list[int] = [_NONE, _NONE]  # root of word starts, root of the rest
        self.popped: list[int] = [0, 0]
        ends, children = set(), {0: [], 1: []}
        for piece in pieces:
            node = 0 if piece.startswith(mark) else 1
            for c in piece:
                step = node << 21 | ord(c)
                if step not in self.goto:
                    self.goto[step] = len(self.fail)
                    children[node].append((ord(c), len(self.fail)))
                    children[len(self.fail)] = []
                    self.fail.append(_NONE)
                    self.popped.append(0)
                node = self.goto[step]
            if piece:
                ends.add(node)
        # level by level: links of shorter prefixes are known before they are needed
        queue = deque((0, *edge) for edge in children[0])
        queue.extend((1, *edge) for edge in children[1])
        while queue:
            parent, code, node = queue.popleft()
            if node in ends:
                self.fail[node], self.popped[node] = 1, 1
            else:
                count, back = self.popped[parent], self.fail[parent]
                while back != _NONE and (back << 21 | code) not in self.goto:
                    count += self.popped[back]
                    back = self.fail[back]
                if back != _NONE:
                    self.fail[node], self.popped[node] = self.goto[back << 21 | code], count
            queue.extend((node, *edge) for edge in children[node])

    def count(self, word: str) -> int | None:
        """Pieces of the greedy longest match, None if there is no match."""
        goto, fail, popped = self.goto, self.fail, self.popped
        node = total = 0
        for c in self.mark + word:
            code = ord(c)
            following = goto.get(node << 21 | code)
            while following is None:
                total += popped[node]
                node = fail[node]
                if node == _NONE:
                    return None
                following = goto.get(node << 21 | code)
            node = following
        while node != 1:
            total += popped[node]
            node = fail[node]
            if node == _NONE:
                return None
        return total


class Counter:
    """Words, tokens and unknown words of texts; counts of short words are remembered."""

    def __init__(self, pieces: Iterable[str]):
        self.automaton = Automaton(pieces)
        self.known: dict[str, int] = {}

    def _of(self, word: str) -> int:
        count = self.automaton.count(word)
        value = 1 + _UNKNOWN if count is None else count
        if len(word) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = value
        return value

    def __call__(self, text: str | None) -> tuple[int, int, int]:
        words = text.split() if text else []
        found = list(map(self.known.get, words))
        if None in found:
            found = [self._of(w) if f is None else f for w, f in zip(words, found, strict=True)]
        total = sum(found)
        return len(words), total % _UNKNOWN, total // _UNKNOWN


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """``docs`` with n_words, n_tokens and n_unknown of the whole text: words are what white space separates.

    A null or empty text has none. Columns of these names are replaced; every row of ``docs`` stays, repeated ones too, and an
    empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # as large as the vocabulary file

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(shared.value)
        for texts in batches:
            yield pd.DataFrame([counter(t) for t in texts], columns=["n_words", "n_tokens", "n_unknown"])

    names = ["n_words", "n_tokens", "n_unknown"]
    counted = F.pandas_udf(run, ", ".join(f"{n} bigint" for n in names)).asNondeterministic()
    docs = docs.drop(*names)
    return docs.withColumn("n_words", counted("text")).select(*docs.columns, "n_words.*")
