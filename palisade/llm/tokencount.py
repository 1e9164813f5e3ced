"""Token counts by Viterbi: the number of pieces of the best unigram segmentation, no ids.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; dynamic
programming keeps the best score and its piece count.  Ties follow the unigram model of the
public tokenizers library: candidates come in order of their start, and a later one must
score strictly more.  A character that no piece covers alone costs the least score less
ten and counts its UTF-8 bytes (byte fallback).

Cases: null and empty texts have no tokens; rows repeat as often as they come; an empty
table gives an empty result.  No shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from palisade.llm.common import pieces

SPACE_MARK = "▁"


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)]


class Spaced(dict):
    """Piece counts of words with one mark before each, worked out when first asked for."""

    def __init__(self, best, memory: int):
        super().__init__()
        self.best, self.memory = best, memory

    def __missing__(self, word: str) -> int:
        found = self.best(SPACE_MARK + word)
        if len(word) <= 64:
            if len(self) >= self.memory:
                self.clear()
            self[word] = found
        return found


class Counter:
    """Counts pieces; chunks that no piece can cross are counted once and remembered."""

    def __init__(self, vocabulary: list[tuple[str, float]], memory: int = 300_000):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - 10.0
        # Chunks start at a mark after another character, and line feeds stand alone, if no
        # piece reaches across.
        self.by_space = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p, _ in vocabulary)
        self.by_line = not any("\n" in p for p, _ in vocabulary)
        self.memory, self.known = memory, {}
        self.spaced = Spaced(self.best, memory)

    def best(self, text: str) -> int:
        """Piece count of the best segmentation of a text of marks and characters."""
        n = len(text)
        if not n:
            return 0
        score, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        if self.single.issuperset(text):
            # Every position is reached; pieces that end together come longest first.
            for at, (length, value) in self.machine.iter(text):
                at += 1
                total = score[at - length] + value
                if total > score[at]:
                    score[at], count[at] = total, count[at - length] + 1
            return count[n]
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for at, found in self.machine.iter(text):
            ending[at].append(found)
        for at in range(n):
            top, pieces_top = None, 0
            options = sorted(ending[at], reverse=True)  # the longest starts first
            if text[at] not in self.single:
                options.append((1, self.unknown))
            for length, value in options:
                total = score[at + 1 - length] + value
                if top is None or total > top:
                    unknown = length == 1 and text[at] not in self.single
                    added = len(text[at].encode("utf-8", "surrogatepass")) if unknown else 1
                    top, pieces_top = total, count[at + 1 - length] + added
            score[at + 1], count[at + 1] = top, pieces_top
        return count[n]

    def chunk(self, text: str) -> int:
        found = self.known.get(text)
        if found is None:
            found = self.best(text)
            if len(text) <= 64:
                if len(self.known) >= self.memory:
                    self.known.clear()
                self.known[text] = found
        return found

    def count(self, text: str | None) -> int:
        """Tokens of a text, with a mark for every space and one before the text."""
        if not text:
            return 0
        if not self.by_space:
            return self.best(SPACE_MARK + text.replace(" ", SPACE_MARK))
        lines = text.split("\n") if self.by_line else [text]
        total, get, spaced = len(lines) - 1, self.known.get, self.spaced.__getitem__
        for number, line in enumerate(lines):
            words = line.split(" ")
            if "" not in words:
                total += spaced(words[0]) if number == 0 else self.chunk(words[0])
                total += sum(map(spaced, words[1:]))
                continue
            head, rest = (SPACE_MARK + words[0], words[1:]) if number == 0 else (words[0], words[1:])
            marks = 0
            if head == SPACE_MARK and rest:  # marks before a word belong to its chunk
                marks, head = 1, ""
            if head:
                total += self.chunk(head)
            for word in rest:
                marks += 1
                if word:
                    key = SPACE_MARK * marks + word if marks > 1 else SPACE_MARK + word
                    found = get(key)
                    total += self.chunk(key) if found is None else found
                    marks = 0
            if marks:
                total += self.chunk(SPACE_MARK * marks)
        return total


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(read_pieces(path))


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every row; ``path`` is installed on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in pieces(batches, 1):
            found = [counts.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], [doc_id, "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens long")
