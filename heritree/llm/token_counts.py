"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

The distinct pre-tokens of a task's texts are walked in sorted order, which is the depth-first order of their trie; the
stack of that walk holds, for every prefix on the path, its best forward score and the tokens of the segmentation that
has it. A pre-token shares what its neighbour has computed for their common prefix, and its terminal count is stored.
Texts then add up their pre-tokens' counts. Nothing is shuffled, and no pre-token's rows meet anywhere.

Pre-tokens are runs of anything but ASCII white space, with a word mark in front. Pieces are those of a public
vocabulary file; as it holds ranks and no probabilities, and tokenizers are not trained here, a piece scores
-log(rank + 2). A character without a piece counts as its UTF-8 bytes' pieces. Of equal scores the fewest tokens count.

Defined results: a null or blank text has no pre-tokens, no tokens and score 0; null ids are ids like others; equal
rows count alike; an empty table gives no rows; other columns are ignored. A worker keeps the counts of at most
WORDS_KEPT pre-tokens between texts; dropping them costs time only.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

WORDS_KEPT, _GROUP_CHARS, MARK = 400_000, 500_000, "▁"


def pieces(path: str) -> dict[str, float]:
    """Piece to score, from a sentencepiece file; byte pieces keep their form <0x..>."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return {p.id_to_piece(i): -log(i + 2) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i))}


class PrefixWalk:
    """Counts of pre-tokens; those of one call share prefixes."""

    def __init__(self, scores: dict[str, float]) -> None:
        # every ending of a piece: the score if it is a piece itself, else None; a walk backwards stops where no piece ends
        self.endings: dict[str, float | None] = {}
        for p in scores:
            for k in range(len(p)):
                self.endings.setdefault(p[k:], None)
        self.endings.update(scores)
        self.bytes = [scores[f"<0x{b:02X}>"] for b in range(256)]

    def counts(self, words: list[str]) -> dict[str, tuple[int, float]]:
        """(tokens, score) of each word."""
        out, endings = {}, self.endings
        path, best, tokens = "", [0.0], [0]
        for word in sorted(set(words)):
            text = MARK + word
            shared, limit = 0, min(len(path), len(text))
            while shared < limit and path[shared] == text[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                c = text[end - 1]
                top, least = None, 0
                if endings.get(c) is None:
                    raw = c.encode("utf-8", "surrogatepass")
                    top, least = best[end - 1] + sum(self.bytes[b] for b in raw), tokens[end - 1] + len(raw)
                start = end - 1
                while start >= 0:
                    score = endings.get(text[start:end], 0.0)
                    if score == 0.0:  # no piece ends so
                        break
                    if score is not None:
                        now, n = best[start] + score, tokens[start] + 1
                        if top is None or now > top or now == top and n < least:
                            top, least = now, n
                    start -= 1
                best.append(top)
                tokens.append(least)
            path = text
            out[word] = (tokens[-1], best[-1])
        return out


class _Index(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = k = len(self)
        self.new.append(key)
        return k


class Counter:
    def __init__(self, path: str) -> None:
        self.walk = PrefixWalk(pieces(path))
        self.clear()

    def clear(self) -> None:
        self.index, self.tokens, self.scores = _Index(), np.empty(0, np.int64), np.empty(0)

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int], list[float]]:
        """Pre-tokens, tokens and score of each text."""
        if len(self.index) > WORDS_KEPT:
            self.clear()
        places = []
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").split()
            places.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
        if self.index.new:
            new = [w.decode("utf-8", "surrogatepass") for w in self.index.new]
            found = self.walk.counts(new)
            self.tokens = np.concatenate([self.tokens, np.array([found[w][0] for w in new], np.int64)])
            self.scores = np.concatenate([self.scores, np.array([found[w][1] for w in new])])
            self.index.new.clear()
        return [len(p) for p in places], [int(self.tokens[p].sum()) for p in places], [float(self.scores[p].sum()) for p in places]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each worker process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score (the best segmentations' log scores, added up)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for b in batches:
            texts, at, out = b.column("text"), 0, ([], [], [])
            while at < len(texts):
                group, size = [], 0
                while at < len(texts) and size < _GROUP_CHARS:
                    group.append(texts[at].as_py())
                    size += len(group[-1] or "")
                    at += 1
                for have, new in zip(out, count(group)):
                    have.extend(new)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, out[:2], [pa.int64()] * 2), pa.array(out[2], pa.float64())], names=["doc_id", "n_pretokens", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")
