"""Unigram token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word (``[^\\x20\\x09-\\x0D]+``) with the piece file's word mark before it.
Its tokens are the segmentation with the highest sum of piece scores. The score of a
piece is its Zipf log-probability by rank, -ln(rank + 2.7), since the file at hand ranks
its pieces and gives no probabilities. A character outside the vocabulary is one token
per UTF-8 byte, each scored as the last rank.

Each task takes the distinct pre-tokens of its documents in sorted order, which walks
their trie depth first: forward scores of a prefix are computed once and kept on a stack
for all pre-tokens that share it, and the token count at a pre-token's last node is its
answer. Answers are remembered in a bounded table that starts anew when it is full.

Null and empty texts have no words and no tokens. Repeated rows count one by one. Other
columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MEMORY = 600_000
_END = ""


class Vocabulary:
    """Pieces in a trie of nested dictionaries; a piece's score is under the empty key."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.root: dict = {}
        n = model.get_piece_size()
        for rank in range(n):
            piece = model.id_to_piece(rank)
            if model.is_control(rank) or model.is_unknown(rank) or model.is_byte(rank) or MARK in piece[1:]:
                continue
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[_END] = -math.log(rank + 2.7)
        self.unknown = -math.log(n + 2.7)


def count_sorted(words: list[str], vocabulary: Vocabulary) -> list[int]:
    """Token counts of sorted words."""
    root, unknown = vocabulary.root, vocabulary.unknown
    # per depth: best score, its token count, and the trie nodes of pieces that are still open, by their start
    start = root.get(MARK, {})
    score, count = [0.0, start.get(_END, unknown * 3)], [0, 1 if _END in start else 3]
    open_: list[list] = [[], [(0, start)] if start else []]
    out, before = [], ""
    for word in words:
        shared = 0
        for a, b in zip(word, before, strict=False):
            if a != b:
                break
            shared += 1
        del score[shared + 2 :], count[shared + 2 :], open_[shared + 2 :]
        for at in range(shared, len(word)):
            c = word[at]
            here = at + 1  # depth 1 is the mark
            best, tokens = -math.inf, 0
            going = []
            for begin, node in (*open_[here], (here, root)):
                after = node.get(c)
                if after is not None:
                    going.append((begin, after))
                    s = after.get(_END)
                    if s is not None and (s := s + score[begin]) > best:
                        best, tokens = s, count[begin] + 1
            n = len(c.encode())
            if not (going and going[-1][0] == here and _END in going[-1][1]) and (s := score[here] + n * unknown) > best:
                best, tokens = s, count[here] + n
            score.append(best)
            count.append(tokens)
            open_.append(going)
        out.append(count[len(word) + 1])
        before = word
    return out


_vocabularies: dict[str, tuple[Vocabulary, dict[str, int]]] = {}


def _counter(path: str):
    def run(batches):
        if path not in _vocabularies:
            _vocabularies[path] = (Vocabulary(path), {"": 0})
        vocabulary, known = _vocabularies[path]
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                split = [[] if t is None else _split(t) for t in part.column(1).to_pylist()]
                new = set()
                for words in split:
                    new.update(w for w in words if w not in known)
                if len(known) + len(new) > MEMORY:
                    known.clear()
                    known[""] = 0
                    new = set().union(*split) - {""}
                ordered = sorted(new)
                known.update(zip(ordered, count_sorted(ordered, vocabulary), strict=True))
                look = known.__getitem__
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(w) - w.count("") for w in split], pa.int64()), pa.array([sum(map(look, w)) for w in split], pa.int64())],
                    ["doc_id", "n_words", "n_tokens"],
                )

    return run


def _split(text: str) -> list[str]:
    for c in "\t\n\x0b\f\r":
        text = text.replace(c, " ")
    return text.split(" ")


def counts(docs: DataFrame, model: str) -> DataFrame:
    """Per document row: doc_id, n_words, n_tokens."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counter(model), "doc_id long, n_words long, n_tokens long")
