"""Likelihood of texts over all segmentations into subwords of an existing vocabulary.

A word, with the vocabulary's mark for a word's start before it, is a lattice whose edges are pieces of
the vocabulary; the forward recursion in log space sums the probabilities of all paths, so a word's
probability is the marginal over its segmentations. A text is its words in turn and an end. A character
outside the vocabulary goes by its bytes. A word of the learning fold is also an edge of its own, over the
whole word: it has its count less a discount, and what is taken off all words is the share of the pieces.
The discount is what leaving one out of the learned words' counts asks for: n1 / (n1 + 2 n2), with n1 and
n2 the words that occur once and twice.

Pieces and words are weighted for each of the learning fold's languages (the CLASSES - 1 most common ones,
and the others together); a text's probability is the sum over the languages, whatever its own lang says.

The vocabulary comes from a file and isn't changed. Its own scores are merge ranks, not probabilities, so
the pieces' probabilities are learned: how often the vocabulary's own segmentation uses each piece in the
distinct words of the learning fold, then ROUNDS of expectation-maximisation over all segmentations.

Counts of words are sums over the whole corpus and grow with it, so they aren't broadcast. Texts are read
once, in chunks of some CHUNK_BYTES: a chunk becomes a row for each of its distinct words and one that says
how often its documents have them. One shuffle brings a word's rows together (at most one from each chunk),
where it is counted, learned from and weighted; a second one brings the weights back to the chunks, whose
documents are summed up from them, as 32-bit numbers. The texts themselves are never moved.

Defined cases: a null text is empty and is just an end; a null doc_id counts as empty text for the folds;
without any learning text each base term is 0 and pieces are equally likely; very long words are scored
whole; repeated rows are scored each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinweave.llm.common import fold, table, written

#: Text whose words are gathered together.
CHUNK_BYTES = 16_000_000
ROUNDS = 2
CLASSES = 6
#: Added to each piece's count, and the weight of all languages' uses of a piece in each one's.
SMOOTHING, SHARED = 0.1, 200.0
#: Words whose lattices are computed together.
LOT = 20_000
#: Rows in one output batch.
BATCH = 50_000


def words_of(text: str) -> list[bytes]:
    """UTF-8 words, A-Z lower-cased, parted by ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def as_text(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


class Pieces:
    """Finds pieces in many words at once: a hash table of all beginnings of pieces, one probe after the other."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    BITS = 20

    def __init__(self, names: list[str]):
        self.names = names
        beginnings: dict[str, int] = {}
        for k, name in enumerate(names):
            for n in range(1, len(name)):
                beginnings.setdefault(name[:n], -1)
            beginnings[name] = k
        self.numbers = np.zeros(1 << self.BITS, dtype=np.uint64)
        self.piece = np.full(1 << self.BITS, -2, dtype=np.int32)  # -2: empty, -1: only a beginning
        for text, k in beginnings.items():
            number = 0
            for c in map(ord, text):
                number = (number * int(self.BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
            at = self._first(np.array([number], dtype=np.uint64))[0]
            while self.piece[at] != -2:
                if self.numbers[at] == number:
                    raise ValueError("two beginnings have the same number")
                at = (at + 1) & ((1 << self.BITS) - 1)
            self.numbers[at], self.piece[at] = number, k

    def _first(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers * self.BASE) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """Of each number the piece, -1 if it is only a beginning, -2 if it is neither."""
        at = self._first(numbers)
        out = self.piece[at]
        left = np.flatnonzero((out != -2) & (self.numbers[at] != numbers))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.BITS) - 1)
            out[left] = self.piece[at[left]]
            left = left[(out[left] != -2) & (self.numbers[at[left]] != numbers[left])]
        return out


class Edges:
    """The lattices of some words as flat arrays, with a place before each character and after the last one."""

    def __init__(self, pieces: Pieces, words: list[str], mark: str):
        sizes = np.array([len(w) + len(mark) for w in words], dtype=np.int64)
        joined = "".join([mark + w for w in words]).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(joined, dtype="<u4").astype(np.uint64)
        ends = np.cumsum(sizes)
        offset = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
        room = np.repeat(sizes, sizes) - offset
        place = np.arange(len(codes)) + np.repeat(np.arange(len(words)), sizes)
        self.first, self.last, self.places = ends - sizes + np.arange(len(words)), ends + np.arange(len(words)), len(codes) + len(words)
        starts, lengths, found = [], [], []
        at, numbers = np.arange(len(codes)), codes + np.uint64(1)
        piece = pieces.find(numbers)
        # characters that are no piece: numbered from the last piece on
        none = piece < 0
        self.unknown, which = np.unique(codes[none], return_inverse=True)
        single = piece.copy()
        single[none] = len(pieces.names) + which
        starts.append(at), lengths.append(np.ones(len(at), dtype=np.int64)), found.append(single)
        n = 1
        while len(at):
            n += 1
            going = (piece != -2) & (room[at] >= n)
            at, numbers = at[going], numbers[going] * pieces.BASE + codes[at[going] + n - 1] + np.uint64(1)
            piece = pieces.find(numbers)
            hit = piece >= 0
            starts.append(at[hit]), lengths.append(np.full(int(hit.sum()), n)), found.append(piece[hit])
        begin, length = np.concatenate(starts), np.concatenate(lengths)
        self.piece = np.concatenate(found).astype(np.int64)
        self.start = place[begin]
        self.end = self.start + length
        self.start_offset, self.end_offset = offset[begin], offset[begin] + length
        self.word = np.repeat(np.arange(len(words)), sizes)[begin]
        self.longest = int(sizes.max(initial=0))

    def sums(self, logs: np.ndarray, back: bool = False) -> np.ndarray:
        """For each place and column of logs (a row for each edge) the log sum over all paths from the word's
        start to it, or from it to the word's end."""
        here, there, offset = (self.start, self.end, self.start_offset) if back else (self.end, self.start, self.end_offset)
        order = np.lexsort((here, offset))
        here, there, offset, logs = here[order], there[order], offset[order], logs[order]
        group = np.flatnonzero(np.r_[True, here[1:] != here[:-1]]) if len(here) else np.array([], dtype=np.int64)
        steps = np.searchsorted(offset, np.arange(self.longest + 2))
        of_group = np.searchsorted(group, steps)
        out = np.full((self.places, logs.shape[1]), -np.inf)
        out[self.last if back else self.first] = 0.0
        for k in range(self.longest, -1, -1) if back else range(self.longest + 1):
            a, b = steps[k], steps[k + 1]
            if a == b:
                continue
            own = group[of_group[k] : of_group[k + 1]]
            terms = out[there[a:b]] + logs[a:b]
            top = np.maximum.reduceat(terms, own - a, axis=0)
            terms -= np.repeat(top, np.diff(np.r_[own, b]), axis=0)
            out[here[own]] = top + np.log(np.add.reduceat(np.exp(terms), own - a, axis=0))
        return out


class Lattice:
    """Pieces and bytes with natural log probabilities, a column for each class."""

    def __init__(self, pieces: Pieces, logs: np.ndarray, byte: np.ndarray, mark: str):
        self.pieces, self.logs, self.byte, self.mark = pieces, logs, byte, mark

    def _logs(self, edges: Edges) -> np.ndarray:
        spelled = [self.byte[list(chr(int(c)).encode("utf-8", "surrogatepass"))].sum(axis=0) for c in edges.unknown]
        known = np.concatenate((self.logs, np.array(spelled))) if spelled else self.logs
        return known[edges.piece]

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Of each word and class the sum over all segmentations, by the forward recursion."""
        out = np.zeros((len(words), self.logs.shape[1]))
        for k in range(0, len(words), LOT):
            edges = Edges(self.pieces, words[k : k + LOT], self.mark)
            out[k : k + LOT] = edges.sums(self._logs(edges))[edges.last]
        return out

    def expected(self, words: list[str], class_: int = 0) -> np.ndarray:
        """How often the pieces, then the 256 bytes, are used in the words, on average over all segmentations."""
        uses = np.zeros(len(self.pieces.names) + 256)
        for k in range(0, len(words), LOT):
            edges = Edges(self.pieces, words[k : k + LOT], self.mark)
            logs = self._logs(edges)[:, class_ : class_ + 1]
            before, after = edges.sums(logs)[:, 0], edges.sums(logs, back=True)[:, 0]
            share = np.exp(before[edges.start] + logs[:, 0] + after[edges.end] - before[edges.last][edges.word])
            own = np.bincount(edges.piece, share, len(self.pieces.names) + len(edges.unknown))
            uses[: len(self.pieces.names)] += own[: len(self.pieces.names)]
            for c, x in zip(edges.unknown, own[len(self.pieces.names) :], strict=True):
                for b in chr(int(c)).encode("utf-8", "surrogatepass"):
                    uses[len(self.pieces.names) + b] += x
        return uses


class Vocabulary:
    """A sentencepiece file's pieces and bytes."""

    mark = "▁"

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        plain = [i for i in ids if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.names = [self.model.id_to_piece(i) for i in plain]
        self.place = {name: k for k, name in enumerate(self.names)}
        self.place |= {f"<0x{b:02X}>": len(plain) + b for b in range(256)}
        self.size = len(plain) + 256
        self.pieces = Pieces(self.names)

    def lattice(self, uses: np.ndarray) -> Lattice:
        """With probabilities in proportion to the uses, which have a row for each class."""
        counts = uses.T + SMOOTHING
        logs = np.log(counts / counts.sum(axis=0))
        return Lattice(self.pieces, logs[: len(self.names)], logs[len(self.names) :], self.mark)

    def segmented(self, words: list[str]) -> np.ndarray:
        """How often the pieces are used by the vocabulary's own segmentation."""
        uses = Counter(p for own in self.model.encode(words, out_type=str, num_threads=1) for p in own)
        out = np.zeros(self.size)
        for p, n in uses.items():
            if p in self.place:
                out[self.place[p]] += n
        return out


@cache
def vocabulary_at(path: str) -> Vocabulary:
    """Read once in a worker."""
    return Vocabulary(path)


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(values: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(values, 4 * size, codec="zstd", asbytes=True), dtype="<i4")


#: What a chunk's own row holds: its documents in order, and for each of its words in turn how many documents
#: have it, which ones, and how often.
CHUNK = "doc_ids array<long>, held array<boolean>, tokens array<long>, spread binary, docs binary, times binary, pairs long"


def gathered(rows: DataFrame, classes: int) -> DataFrame:
    """From (doc_id, class, held_out, text): a row for each chunk (CHUNK), and one for each of its distinct words with
    the word's place in the chunk and its counts in the learned texts of each class."""
    words_schema = pa.schema([("chunk", pa.int64()), ("word", pa.binary()), ("place", pa.int32()), *[(f"c{k}", pa.int64()) for k in range(classes)]])
    types = {"array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "binary": pa.binary(), "long": pa.int64()}
    fields = [x.split() for x in CHUNK.split(", ")]
    schema = pa.schema([*words_schema, *[(name, types[t]) for name, t in fields]])

    def of_chunk(chunk: int, known: dict, ids: list, docs: list, about: list) -> Iterator[pa.RecordBatch]:
        n = len(about)
        doc_ids, class_, held = (list(x) for x in zip(*about, strict=True))
        doc = np.concatenate(docs)
        tokens = np.bincount(doc, minlength=n) + 1
        key, times = np.unique(np.concatenate(ids).astype(np.int64) * n + doc, return_counts=True)
        word, doc = key // n, key % n
        learned = np.where(np.array(held)[doc], 0, times)
        by_class = np.bincount(word * classes + np.array(class_)[doc], learned, len(known) * classes).reshape(-1, classes)
        names, by_class = list(known), by_class.astype(np.int64)
        for k in range(0, len(names), BATCH):
            part = slice(k, min(len(names), k + BATCH))
            size = part.stop - k
            counts = [pa.array(by_class[part, c]) for c in range(classes)]
            own = [pa.array(np.full(size, chunk)), pa.array(names[part], pa.binary()), pa.array(np.arange(k, part.stop, dtype=np.int32)), *counts]
            yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(size, types[t]) for _, t in fields]], schema=schema)
        spread = np.bincount(word, minlength=len(names))
        row = [[doc_ids], [held], [tokens.tolist()], [_packed(spread)], [_packed(doc)], [_packed(times)], [len(doc)]]
        none = [pa.nulls(1, f.type) for f in list(words_schema)[1:]]
        cells = [pa.array(x, types[t]) for x, (_, t) in zip(row, fields, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), *none, *cells], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 16, 0
        known, ids, docs, about = defaultdict(count().__next__), [], [], []
        for batch in batches:
            columns = [batch.column(name) for name in ("doc_id", "class", "held_out", "text")]
            for doc_id, class_, held, text in zip(*columns, strict=True):
                words = words_of(text.as_py())
                ids.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                docs.append(np.full(len(words), len(about), dtype=np.int64))
                about.append((doc_id.as_py(), class_.as_py(), held.as_py()))
                size += sum(map(len, words)) + len(words) + 16
                if size >= CHUNK_BYTES:
                    yield from of_chunk(chunk, known, ids, docs, about)
                    chunk, size = chunk + 1, 0
                    known, ids, docs, about = defaultdict(count().__next__), [], [], []
        if about:
            yield from of_chunk(chunk, known, ids, docs, about)

    cells = ", ".join(f"c{k} long" for k in range(classes))
    return rows.mapInArrow(run, f"chunk long, word binary, place int, {cells}, {CHUNK}")


def _uses(counts: DataFrame, path: str, classes: int, start: np.ndarray | None) -> np.ndarray:
    """Uses of the pieces in the words that each class has learned, by the vocabulary's own segmentation or
    expected from a start; a row for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_at(path)
        lattice = vocabulary.lattice(shared(start)) if start is not None else None
        uses = np.zeros((classes, vocabulary.size))
        for batch in batches:
            words = [as_text(w) for w in batch.column(0).to_pylist()]
            for k in range(classes):
                own = [words[i] for i in np.flatnonzero(batch.column(k + 1).to_numpy(zero_copy_only=False))]
                if own:
                    uses[k] += lattice.expected(own, k) if lattice else vocabulary.segmented(own)
        class_, place = np.nonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(class_.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(uses[class_, place])], ["class", "place", "uses"])

    learned = [(F.col(f"c{k}") > 0).alias(f"has{k}") for k in range(classes)]
    found = counts.select("word", *learned).mapInArrow(run, "class int, place int, uses double")
    out = np.zeros((classes, vocabulary_at(path).size))
    # a row for each class and piece at most
    for r in found.groupBy("class", "place").agg(F.sum("uses").alias("uses")).collect():
        out[r["class"], r.place] = r.uses
    return out


def shared(uses: np.ndarray) -> np.ndarray:
    """Each class's uses with those of all classes, whose weight is SHARED."""
    every = uses.sum(axis=0)
    return uses + SHARED * every / max(1.0, every.sum())


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The SCORES of each document."""
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    held_out = fold(F.col("doc_id"), 10) == 0
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    common = docs.filter(~held_out).groupBy(lang.alias("lang")).count().orderBy(F.desc("count"), "lang")
    names = [r.lang for r in common.limit(CLASSES).collect()]
    if len(names) == CLASSES:
        names[-1:] = []
    class_ = F.lit(len(names))
    for k, name in enumerate(names):
        class_ = F.when(lang == name, k).otherwise(class_)
    n_classes = len(names) + 1
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        class_.alias("class"),
        held_out.alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # a row for each class
    own_ends = {r["class"]: r["count"] for r in rows.filter("NOT held_out").groupBy("class").count().collect()}
    ends = sum(own_ends.values())
    if ends and len(names) not in own_ends:  # no others: those who aren't learned from need no class
        n_classes, rows = len(names), rows.withColumn("class", F.least("class", F.lit(len(names) - 1)))
    found = written(gathered(rows, n_classes), "gathered")
    columns = [f"c{k}" for k in range(n_classes)]
    # each word with its counts in the whole table; a word has a row for each chunk that it occurs in
    same = Window.partitionBy("word")
    counted = written(
        found.filter("word IS NOT NULL").select(
            "word", "chunk", "place", (F.col("chunk") == F.min("chunk").over(same)).alias("first"),
            *[F.sum(c).over(same).alias(c) for c in columns],
        ),
        "words",
    )
    counts = counted.filter("first")
    total = sum(map(F.col, columns), F.lit(0))
    # one row
    whole = counts.agg(
        F.sum(total).alias("n"), F.count_if(total > 0).alias("v"), *[F.sum(c).alias(f"n_{c}") for c in columns],
        *[F.count_if(F.col(c) > 0).alias(f"v_{c}") for c in columns], *[F.count_if(F.col(c) == 1).alias(f"n1_{c}") for c in columns],
        *[F.count_if(F.col(c) == 2).alias(f"n2_{c}") for c in columns],
    ).first()
    tokens, distinct = (whole.n or 0) + ends, (whole.v or 0) + (ends > 0)
    uses = _uses(counts, path, n_classes, None)
    for _ in range(ROUNDS):
        uses = _uses(counts, path, n_classes, uses)
    base_norm = math.log10(tokens + 0.1 * (distinct + 1))
    base_end = math.log10(ends + 0.1) - base_norm
    # of each class: its share of the texts, of its tokens the ends, its words, their discount
    classed = []
    for k in range(n_classes):
        n, once, twice = whole[f"n_c{k}"] or 0, whole[f"n1_c{k}"] or 0, whole[f"n2_c{k}"] or 0
        discount = once / (once + 2 * twice) if 0 < once and 0 < twice else 0.5
        end = own_ends.get(k, 0)
        classed.append((math.log((end + 0.1) / (ends + 0.1 * n_classes)), (end + 1) / (n + end + 2), n, discount, (whole[f"v_c{k}"] or 0) * discount))
    row = np.dtype([("place", "<i4"), ("c", "<i8"), ("logs", "<f4", (n_classes,))])

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's place, its word's count, and its log probabilities, as one binary value. Rows of a word
        follow each other, so that its lattice is computed once."""
        lattice = vocabulary_at(path).lattice(shared(uses))
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy() for c in columns], axis=1).astype(np.float64)
            coded = batch.column("word").dictionary_encode()
            which, at = coded.indices.to_numpy(), np.unique(coded.indices.to_numpy(), return_index=True)[1]
            logs = lattice.log_probabilities([as_text(w) for w in coded.dictionary.to_pylist()])
            for k, (_, stop, n, discount, taken) in enumerate(classed):
                with np.errstate(divide="ignore"):
                    alone = np.log(np.maximum(own[at, k] - discount, 0.0) / max(1, n))
                logs[:, k] = np.logaddexp(logs[:, k] + (math.log(taken / n) if n else 0.0), alone) + math.log1p(-stop)
            out = np.zeros(batch.num_rows, dtype=row)
            out["place"], out["c"], out["logs"] = batch.column("place").to_numpy(), own.sum(axis=1), logs[which]
            ends_ = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * row.itemsize)
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends_.buffers()[1], pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), packed], ["chunk", "packed"])

    weights = counted.mapInArrow(weighted, "chunk long, packed binary")
    chunks = found.filter("word IS NULL").select("chunk", *[x.split()[0] for x in CHUNK.split(", ")])

    def of_chunk(words: pa.Table, about: pa.Table) -> pa.Table:
        about = about.to_pylist()[0]
        n = len(about["doc_ids"])
        own = np.frombuffer(b"".join(words["packed"].to_pylist()), dtype=row)
        own = own[np.argsort(own["place"])]
        docs_, times = (_unpacked(about[c], about["pairs"]) for c in ("docs", "times"))
        spread = _unpacked(about["spread"], len(own))

        def summed(values: np.ndarray) -> np.ndarray:
            return np.bincount(docs_, np.repeat(values.astype(np.float64), spread) * times, n)

        each = np.stack([summed(own["logs"][:, k]) + prior + math.log(stop) for k, (prior, stop, *_) in enumerate(classed)])
        known = summed(own["c"] > 0).round().astype(np.int64) + (ends > 0)
        base = summed(np.log10(own["c"] + 0.1) - base_norm) + base_end
        out = [pa.array(about["doc_ids"], pa.int64()), pa.array(about["held"], pa.bool_()), pa.array(about["tokens"], pa.int64()), pa.array(known),
               pa.array(np.full(n, tokens)), pa.array(base), pa.array(np.logaddexp.reduce(each, axis=0) / math.log(10))]
        return pa.table(out, names=[x.split()[0] for x in SCORES.split(", ")])

    return weights.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(of_chunk, SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
