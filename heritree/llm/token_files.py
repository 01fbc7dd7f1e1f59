"""Token-id files: every text encoded, an end id after each, one wavelet matrix per shard, in ascending document order.

Documents are range-partitioned by (doc_id, hash of the text), so that an id with a third of all rows is still many
tasks' work, and sorted within. A task encodes its documents as they come and closes a shard file when it holds
SHARD_TOKENS ids, so its memory is that of one shard (or one longer document). Shard files are the binary column of a
table that Spark writes and commits, so a lost task leaves no half files; `blob` is the whole file. A file knows how many
ids of its part come before it, so only the parts' totals, MAX_PARTS at most, are summed up and sent to the executors.

Texts are shuffled, not ids: 16-bit ids take about 0.7 bytes for each byte of text, so ids would spare little, and the
ranges' bounds are found by reading the table twice, which would encode twice or need a stored copy of all ids.

The tokenizer works word by word (its pre-tokenizer never crosses white space), so each distinct word is encoded once
per worker; the store of words is emptied when it holds WORDS_KEPT.

Defined results: a null text is an empty one (just the end id); null ids come last; equal rows stand side by side;
special tokens' strings in a text are those tokens, as the library has it; an empty table gives no files and no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wavelet
from .common import ship, stored

END_ID, SHARD_TOKENS, PART_BYTES, WORDS_KEPT = 1, 1 << 21, 16 << 20, 1_000_000
MAX_PARTS = 50_000  # tasks; beyond PART_BYTES times that, parts grow with the table
GROUP_CHARS = 500_000  # characters that are encoded at a time
_PUNCTUATION = string.punctuation
_ODD = "\x1c\x1d\x1e\x1f"  # str.split() parts words at these, the tokenizer doesn't


class Encoder:
    """ids of texts with the library's results, by words."""

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _for_letters(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        greatest = max(end_id, *vocabulary.values())
        self.width = np.dtype("<u2" if greatest < 1 << 16 else "<u4")
        self.end = np.array([end_id], self.width).tobytes()
        self.word_end = np.zeros(greatest + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.words = _Words()
        self.cores: dict[str, bytes] = {"": b""}
        self.tails: dict[str, bytes] = {"": b""}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width).tobytes()

    def _learn(self) -> None:
        """The ids of new words: letters, then punctuation, are encoded apart (as pre-tokens); other words as they are."""
        words, cores, tails = self.words, self.cores, self.tails
        new, words.new = words.new, []
        split, letters, others = [], {}, {}
        for w in new:
            core = w if w.isalpha() else w.rstrip(_PUNCTUATION)
            if core.isascii() and core.isalpha() or not core:
                lower = core.lower()
                if lower not in cores:
                    letters[lower] = True
            elif _letters(core):
                lower = core.lower()
                if lower not in cores:
                    others[lower] = True
            else:
                lower = None
            split.append(lower)
        self._spell(list(letters), self.letters)
        self._spell(list(others), self.tokenizer)
        for w, lower in zip(new, split):
            if lower is None:
                ids = self._plain(w)
            else:
                ids = cores[lower]
                if len(lower) < len(w):
                    tail = w[len(lower) :]
                    if tail not in tails:
                        tails[tail] = self._plain(tail)
                    ids += tails[tail]
            words[w].extend(ids)  # where texts at hand have it
            words[w] = ids

    def _spell(self, asked: list[str], tokenizer) -> None:
        """The ids of words of letters, many at a time, as the tokenizer has them."""
        size = self.width.itemsize
        for k in range(0, len(asked), 200):
            part = asked[k : k + 200]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.width)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, at = ids.tobytes(), (size * ends).tolist()
                self.cores.update(zip(part, [raw[s:e] for s, e in zip([0, *at], at)]))
            else:
                self.cores.update((w, self._plain(w)) for w in part)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, with the end id after them."""
        if len(self.words) > WORDS_KEPT:
            self.clear()
        of_word, parts = self.words.__getitem__, []
        for t in texts:
            t = t or ""
            if any(c in t for c in _ODD):
                parts.append([self._plain(t)])
            else:
                # upper case makes no difference, but in the special tokens' strings
                parts.append(list(map(of_word, (t.lower() if t.isascii() and "<|" not in t else t).split())))
        self._learn()
        return [b"".join(p) + self.end for p in parts]


#: Steps that leave lower-case ASCII letters with blanks between words as they are, a pre-token for each word.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


def _for_letters(path: str):
    """The tokenizer for lower-case ASCII letters with blanks between words: without its first steps if they are those that change nothing there, else whole."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    out = Tokenizer.from_file(path)
    spec = json.loads(out.to_str())
    steps = (spec["normalizer"] or {}).get("normalizers"), (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    pieces, rest = steps[1][0], [s["type"] for s in steps[1][1:]]
    known = steps[0] == _NORMALIZERS and (pieces.get("pattern"), pieces.get("behavior"), pieces.get("invert")) == (_SPLIT, "Removed", True) and rest == ["ByteLevel"] and not steps[1][1]["add_prefix_space"]
    if known and not any(c.isalpha() for t in spec["added_tokens"] for c in t["content"] if t["content"].isalnum()):
        out.normalizer, out.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
    return out


def _letters(word: str) -> bool:
    """Letters only, as they are, in lower case and when composed: some come apart into a letter and a mark, which goes with punctuation."""
    lower = word.lower()
    return word.isalpha() and lower.isalpha() and "Σ" not in word and all(unicodedata.normalize("NFC", w).isalpha() for w in (word, lower))


class _Words(dict):
    """Word to ids. A word not known yet gets an empty place, which is filled when its ids have been found."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> bytearray:
        self[word] = place = bytearray()
        self.new.append(word)
        return place


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """One for each worker process, whose words serve later tasks."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, part_bytes: int = PART_BYTES) -> DataFrame:
    """The written table of shard files: part, nth, at (ids of the part before it), n_tokens, blob; ascending (part, nth) is ascending document order."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, nth, at_part = encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0, 0
        size = coder.width.itemsize
        ids, found, held = [], [], 0

        def shard() -> pa.RecordBatch:
            ends = np.cumsum([len(f) for f in found]) // size
            blob = wavelet.build(np.frombuffer(b"".join(found), coder.width), ends, ids)
            row = [pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([at_part], pa.int64()), pa.array([held], pa.int64()), pa.array([blob], pa.large_binary()).cast(pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["part", "nth", "at", "n_tokens", "blob"])

        for b in batches:
            texts, k = b.column("text"), 0
            doc_ids = b.column("doc_id").to_pylist()
            while k < len(doc_ids):
                group, chars, low = [], 0, k
                while k < len(doc_ids) and chars < min(GROUP_CHARS, shard_tokens):
                    group.append(texts[k].as_py())
                    chars += len(group[-1] or "")
                    k += 1
                ids += doc_ids[low:k]
                more = coder.encode(group)
                found += more
                held += sum(map(len, more)) // size
                if held >= shard_tokens:
                    yield shard()
                    nth, at_part = nth + 1, at_part + held
                    ids, found, held = [], [], 0
        if ids:
            yield shard()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    total = docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    ranged = narrow.repartitionByRange(min(MAX_PARTS, max(1, -(-total // part_bytes))), *order).sortWithinPartitions(*order).drop("tie")
    return stored(ranged.mapInArrow(run, "part int, nth int, at long, n_tokens long, blob binary"), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (array) of every document, from the files."""
    return _read(shards, lambda tokens, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens, pa.int64())), "array<long>", "ids")


def _crc32(tokens: np.ndarray, at: np.ndarray) -> pa.Array:
    """Of each document's ids as little-endian unsigned 32-bit integers."""
    raw, at = memoryview(tokens.astype("<u4", copy=False).tobytes()), (4 * at).tolist()
    return pa.array([zlib.crc32(raw[s:e]) for s, e in zip(at, at[1:])], pa.int64())


def _read(shards: DataFrame, values: Callable[[np.ndarray, np.ndarray], pa.Array], kind: str, name: str) -> DataFrame:
    """values: of all ids of a shard and where its documents start and end."""
    ship(shards.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, at_part, blob in zip(b.column("part").to_pylist(), b.column("at").to_pylist(), b.column("blob")):
                w = wavelet.WaveletMatrix(blob.as_py())
                at = np.concatenate([[0], w.ends]).astype(np.int64)
                columns = [pa.array([part] * len(w.ends), pa.int32()), pa.array(w.doc_ids, pa.int64()), pa.array(at_part + at[:-1]), pa.array(np.diff(at)), values(w.tokens(), at)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "at", "n_tokens", name])

    # a row for each part, MAX_PARTS at most, whose ids are added up; files aren't read for it
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = shards.select("part", "at", "blob").mapInArrow(run, f"part int, doc_id long, at long, n_tokens long, {name} {kind}")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", name)


def token_file_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    return _read(write_shards(docs, tokenizer), _crc32, "long", "ids_crc32")
