"""Cost-balanced packing of token sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n. Pieces go, the longest first, to the
sequence with the lowest cost so far that still has room; a piece that fits nowhere is cut to fill
the cheapest sequence with room, and its rest goes on.

Each task packs what it reads, in blocks of bounded size: nothing is shuffled. Within a block all
sequences get exactly CAPACITY tokens; what is left at a task's end gets sequences of the powers of
two that add up to it, so nothing is padded. Sequence ids hold the partition in their upper bits.

Defined cases: a null text is empty and gives just the end id; a null doc_id stays null; repeated rows
are packed each; an empty table gives no rows; further columns are ignored; a document longer than a
sequence is cut into full sequences and a rest; pieces of equal length go in the order in which their
documents were read, equally cheap sequences in the order of their numbers.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Split

from twinweave.llm.common import batches_of, lots, table

CAPACITY = 4096
END_ID = 2
#: Cost of a token, and of a pair of tokens that attend to each other (for a model width of 4096).
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Tokens packed together; a block takes some ten MB.
BLOCK_TOKENS = 1024 * CAPACITY
#: Remembered words in a Python worker.
CACHE = 1_000_000
PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long"
)


class WordTokenizer:
    """The ids that a word BPE of the tokenizers library gives, with words remembered.

    Texts of plain Latin letters, digits and marks are normalised, split and mapped to byte characters
    here, as the file's own steps would, and all new words of a batch go through the library's model in
    one call. Parts with any other character go through the library's whole encoder: words never span
    white space, so a text's ids are those of its parts in turn.
    """

    #: Characters whose normal form, lower case and class are plain.
    PLAIN = re.compile(r"[\t\n\r\x20-\x3b\x3d-\x7e¡-¬®-ĮĹ-ňŊ-ž]*")
    #: The file's own pattern, its classes of letters and numbers spelled out for these characters.
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ž]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ž0-9²³¹¼-¾]+")

    def __init__(self, path: str):
        self.whole, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.model.normalizer, self.model.pre_tokenizer = None, Split(" ", "removed")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        mapped = "\n".join(words).encode().decode("latin-1").translate(self.chars | {10: " "})
        ids = np.array(self.model.encode(mapped, add_special_tokens=False).ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            raise ValueError("the vocabulary doesn't mark the ends of words")
        flat, at = ids.tobytes(), 0
        for word, cut in zip(words, (cuts * 4).tolist(), strict=True):
            self.known[word] = flat[at:cut]
            at = cut

    def _split(self, text: str) -> list[str]:
        """Its words; what isn't plain stays whole, is remembered at once, and can't be a word's text."""
        if self.PLAIN.fullmatch(text):
            return self.SPLIT.findall(text.lower())
        out: list[str] = []
        for part in re.split(r"([ \t\n\r]+)", text):
            if self.PLAIN.fullmatch(part):
                out += self.SPLIT.findall(part.lower())
            else:
                if part not in self.known:
                    ids = self.whole.encode(part, add_special_tokens=False).ids
                    self.known[part] = np.array(ids, dtype="<u4").tobytes()
                out.append(part)
        return out

    def batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        if len(self.known) > CACHE:
            self.known.clear()
        split = [self._split(x) for x in texts]
        if new := set(chain.from_iterable(split)).difference(self.known):
            self.learn(list(new))
        for words in split:
            yield b"".join(map(self.known.__getitem__, words))


def cost(tokens: int) -> float:
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def assign(lengths: list[int], rooms: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(document, start, length, sequence) of each piece; the rooms hold at least all lengths."""
    open_ = [(0.0, k) for k in range(len(rooms))]
    heapq.heapify(open_)
    left = list(rooms)
    todo = [(-n, k, 0) for k, n in enumerate(lengths)]
    heapq.heapify(todo)
    while todo:
        size, doc, start = heapq.heappop(todo)
        size, full = -size, []
        while open_ and left[open_[0][1]] < size:
            full.append(heapq.heappop(open_))
        # where none has room for all of it, the cheapest takes what fits
        so_far, seq = heapq.heappop(open_) if open_ else full.pop(0)
        for x in full:
            heapq.heappush(open_, x)
        taken = min(size, left[seq])
        left[seq] -= taken
        if left[seq]:
            heapq.heappush(open_, (so_far + cost(taken), seq))
        if taken < size:
            heapq.heappush(todo, (taken - size, doc, start + taken))
        yield doc, start, taken, seq


class Packer:
    """Packs the documents of one task, a block at a time."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.next, self.capacity = first_sequence, capacity
        self.held: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, start, ids, tokens of the document
        self.tokens = 0

    def _sequence(self, pieces: list[tuple], tokens: int) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, whole in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.tobytes()), whole, self.next, offset, tokens
            offset += len(ids)
        self.next += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        n, start = len(ids), 0
        while n - start >= self.capacity:  # a full sequence of its own
            yield from self._sequence([(doc_id, start, ids[start : start + self.capacity], n)], self.capacity)
            start += self.capacity
        if start < n:
            self.held.append((doc_id, start, ids[start:], n))
            self.tokens += n - start
        if self.tokens >= BLOCK_TOKENS:
            yield from self._pack(last=False)

    def _pack(self, last: bool) -> Iterator[tuple]:
        full, rest = divmod(self.tokens, self.capacity)
        rooms = [self.capacity] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        pieces: list[list[tuple]] = [[] for _ in rooms]
        for k, start, length, seq in assign([len(x[2]) for x in self.held], rooms):
            doc, first, ids, whole = self.held[k]
            pieces[seq].append((doc, first + start, ids[start : start + length], whole))
        self.held, self.tokens = [], 0
        for seq, own in enumerate(pieces):
            if seq < full or last:
                yield from self._sequence(own, rooms[seq])
            else:  # goes on with the next block
                self.held += own
                self.tokens += rooms[seq]

    def end(self) -> Iterator[tuple]:
        if self.held:
            yield from self._pack(last=True)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece: which ids of which document lie where in which sequence."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.array([end_id], dtype="<u4").tobytes()
        words, packer = WordTokenizer(path), Packer(TaskContext.get().partitionId() << 40, capacity)

        def rows() -> Iterator[tuple]:
            for frame in lots(frames):
                for doc_id, none, ids in zip(frame.doc_id, frame.no_id, words.batch(frame.text), strict=True):
                    whole = np.frombuffer(ids + end, dtype="<u4")
                    yield from packer.add(None if none else int(doc_id), whole)
            yield from packer.end()

        for frame in batches_of(rows(), [x.split()[0] for x in PIECE.split(", ")], 5000):
            yield frame.astype({"doc_id": "Int64"})

    rows = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc_id"),
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return rows.mapInPandas(run, PIECE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
