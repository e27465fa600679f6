"""Phrases of 2 to 5 words that hang together, by mergeable Misra-Gries summaries and an exact second pass.

A chunk is some MB of text as word numbers; chunks are made once and written. A phrase's hash says which of the hash
partitions counts it; their number grows with the text, so that each has about PART_MASS occurrences. First pass:
a chunk sends each partition a summary of its phrases of 1 to 5 words (hash and count), and the partition merges what it
gets into a Misra-Gries summary of more counters than its occurrences divided by the threshold. Reducing a summary takes
away at least as many occurrences as it has counters and one more for each unit that counts lose, so no phrase's count
loses the threshold, and every phrase that has it survives. Hashes that meet can only add survivors.

Each partition answers every chunk with those of the chunk's own hashes that survived. Second pass: each chunk,
joined with its answers, counts the surviving phrases by their words, and a phrase's partition adds up the counts of
all chunks, which are exact. Neither survivors nor counts go to the driver or to all workers.

A part of a frequent phrase is itself as frequent, so all that the scores need is among the exact counts.

Defined cases: a null text is empty, a null lang is "und"; repeated rows count each; equal scores go by count, then by
the phrase's bytes; a very long text is cut where its pieces end; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinweave.llm.common import lots, table, written

#: Words of the longest phrase.
WIDTH = 5
#: What a phrase's count must reach, and how many phrases of each language are listed.
THRESHOLD, LISTED = 100, 2000
#: Bytes of text in a chunk, occurrences in a hash partition, and counts merged at once.
CHUNK_BYTES, PART_MASS, MERGED = 4_000_000, 4_000_000, 1_000_000
#: Hash partitions that one task counts, one after the other.
TASK_PARTS = 2
#: Bits of a hash within its partition.
KEY_BITS = 40
#: Keys in one row of a summary.
ROW_KEYS = 50_000
#: Counted phrases that a task of the second pass holds before it sends them.
HELD = 200_000
#: Groups into which a language's phrases are dealt before the last step of the ranking.
SPREAD = 64

#: Capitals are lowered, what ends a piece becomes a line end, tabs are spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on; bytes of equal weight lie together, so that few are compressed to few."""
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return np.array([len(values)], "<u4").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data[:4], "<u4")[0])
    raw = pa.decompress(data[4:], 8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).reshape(-1).view("<u8")


def packed_text(lines: list[str]) -> bytes:
    """Lines that hold no line end."""
    raw = "\n".join(lines).encode("utf-8", "surrogatepass")
    return np.array([len(raw)], "<u8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked_text(data: bytes) -> list[str]:
    size = int(np.frombuffer(data[:8], "<u8")[0])
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\n")


class Chunk:
    """Texts as word numbers: 0 where a piece ends, the others stand for a word of a language."""

    def __init__(self):
        self.known: dict[str, dict[bytes, int]] = {}
        self.words: list[tuple[str, bytes]] = []
        self.ids: list[int] = [0]
        self.size = 0

    def add(self, lang: str, plain: bytes) -> None:
        known, ids = self.known.setdefault(lang, {}), self.ids
        for word in plain.replace(b"\n", b" \n ").split(b" "):
            if word == b"\n":
                ids.append(0)
            elif word:
                if (k := known.get(word)) is None:
                    self.words.append((lang, word))
                    k = known[word] = len(self.words)
                ids.append(k)
        ids.append(0)
        self.size += len(plain)

    def row(self) -> tuple:
        """(mass, langs, words, ids): mass counts the phrases of all lengths."""
        ids = np.array(self.ids, dtype=np.int64)
        langs = list(self.known)
        places = {lang: k for k, lang in enumerate(langs)}
        ends = np.cumsum([len(w) for _, w in self.words])
        of_lang = np.array([places[lang] for lang, _ in self.words], dtype=np.int64)
        mass = sum(int(whole.sum()) for whole in runs_of(ids))
        words = b"".join(w for _, w in self.words)
        return mass, langs, packed(ends), packed(of_lang), pa.compress(words, codec="zstd", asbytes=True), len(words), packed(ids)


CHUNK = "chunk long, mass long, langs array<string>, ends binary, of_lang binary, words binary, words_size long, ids binary"


def runs_of(ids: np.ndarray) -> Iterator[np.ndarray]:
    """For 1 to WIDTH words: where a phrase of so many begins that lies within a piece."""
    whole = ids > 0
    for n in range(1, WIDTH + 1):
        if n > 1:
            whole = whole[:-1] & (ids[n - 1 :] > 0)
        yield whole


def chunks(docs: DataFrame) -> DataFrame:
    """The texts as chunks, a task's one after the other."""

    def slices(plain: bytes) -> Iterator[bytes]:
        while len(plain) > CHUNK_BYTES and (cut := plain.rfind(b"\n", 0, CHUNK_BYTES)) > 0:
            yield plain[:cut]
            plain = plain[cut:]
        yield plain

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, number, now = [x.split()[0] for x in CHUNK.split(", ")], TaskContext.get().partitionId() << 32, Chunk()
        for frame in lots(frames):
            for lang, text in zip(frame.lang, frame.text, strict=True):
                for part in slices(text.encode("utf-8", "surrogatepass").translate(_PLAIN)):
                    now.add(lang, part)
                    if now.size >= CHUNK_BYTES:
                        yield pd.DataFrame([(number, *now.row())], columns=names)
                        number, now = number + 1, Chunk()
        if now.words:
            yield pd.DataFrame([(number, *now.row())], columns=names)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, CHUNK)


def opened(row: dict) -> tuple[np.ndarray, list[str], np.ndarray, list[bytes]]:
    """A chunk's ids, languages, each word's language, and words."""
    ends = unpacked(row["ends"]).astype(np.int64)
    raw = pa.decompress(row["words"], row["words_size"], codec="zstd", asbytes=True)
    words = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    return unpacked(row["ids"]).astype(np.int64), list(row["langs"]), unpacked(row["of_lang"]).astype(np.int64), words


def word_hashes(langs: list[str], of_lang: np.ndarray, words: list[bytes]) -> np.ndarray:
    """A hash of each word and its language, by number; the first is that of no word."""
    seeds = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in langs]
    found = [xxhash.xxh64_intdigest(w, seeds[k]) for w, k in zip(words, of_lang.tolist(), strict=True)]
    return np.array([0, *found], dtype=np.uint64)


def phrase_hashes(ids: np.ndarray, hashes: np.ndarray, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to WIDTH words: where a phrase begins, and its partition above the KEY_BITS bits of its key."""
    value = np.zeros(len(ids), dtype=np.uint64)
    for n, whole in enumerate(runs_of(ids), 1):
        with np.errstate(over="ignore"):
            value = (value[: len(whole)] ^ hashes[ids[n - 1 :]]) * _ODD
            value ^= value >> np.uint64(29)
            at = np.flatnonzero(whole)
            mixed = (value[at] + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0x94D049BB133111EB)
        part = (mixed >> np.uint64(KEY_BITS)) % np.uint64(parts)
        yield at, part << np.uint64(KEY_BITS) | mixed & np.uint64((1 << KEY_BITS) - 1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of KEY_BITS bits in order with the sums of their counts."""
    rest = np.uint64(64 - KEY_BITS)
    if counts.max(initial=0) >> int(rest):
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    else:  # both fit into one number, which is sorted sooner
        both = np.sort(keys << rest | counts.astype(np.uint64))
        keys, counts = both >> rest, (both & np.uint64((1 << int(rest)) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Summary:
    """A Misra-Gries summary: counts fall short by at most lost, and keys without a counter have at most lost."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        """Adds the counters of another one; more than the capacity are reduced by the largest count beyond it."""
        self.keys, self.counts = summed(np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts)))
        self.lost += lost
        if len(self.keys) > self.capacity:
            less = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            self.lost += less
            kept = self.counts > less
            self.keys, self.counts = self.keys[kept], self.counts[kept] - less

    def reaching(self, threshold: int) -> np.ndarray:
        """Keys whose true count may reach the threshold, among them all that do."""
        return self.keys[self.counts + self.lost >= threshold]


def _summaries(parts: int):
    """From chunks: (part, chunk, keys, counts), each chunk's own phrases."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                ids, langs, of_lang, words = opened(row)
                found = [x for _, x in phrase_hashes(ids, word_hashes(langs, of_lang, words), parts)]
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                part = (keys >> np.uint64(KEY_BITS)).astype(np.int64)
                keys &= np.uint64((1 << KEY_BITS) - 1)
                begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
                out = []
                for a, b in zip(begin, [*begin[1:], len(part)], strict=True):
                    for k in range(a, b, ROW_KEYS):
                        own = slice(k, min(b, k + ROW_KEYS))
                        steps = np.diff(keys[own], prepend=np.uint64(0))
                        out.append((int(part[a]), row["chunk"], packed(steps), packed(counts[own])))
                yield pd.DataFrame(out, columns=["part", "chunk", "keys", "counts"])

    return run


def _answers(threshold: int):
    """From the summaries of each partition, which follow each other: (chunk, found), the surviving hashes of each chunk."""

    def answer(part: int, rows: list[tuple[int, bytes, bytes]]) -> Iterator[tuple[int, bytes]]:
        mass = sum(int(unpacked(counts).sum()) for _, _, counts in rows)
        summary, keys, counts = Summary(mass // threshold + 1), [], []
        for _, own, times in rows:
            keys.append(np.cumsum(unpacked(own), dtype=np.uint64))
            counts.append(unpacked(times).astype(np.int64))
            if sum(map(len, keys)) >= MERGED:
                summary.merge(np.concatenate(keys), np.concatenate(counts))
                keys, counts = [], []
        if keys:
            summary.merge(np.concatenate(keys), np.concatenate(counts))
        survivors = summary.reaching(threshold)
        if not len(survivors):
            return
        for chunk, own, _ in rows:
            own = np.cumsum(unpacked(own), dtype=np.uint64)
            at = np.minimum(np.searchsorted(own, survivors), len(own) - 1)
            if (mine := survivors[own[at] == survivors]).size:
                yield chunk, packed(mine | np.uint64(part << KEY_BITS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def answers() -> Iterator[tuple[int, bytes]]:
            now, rows = None, []
            for frame in frames:
                for part, *row in frame.itertuples(index=False):
                    if part != now and rows:
                        yield from answer(now, rows)
                        rows = []
                    now = part
                    rows.append(row)
            if rows:
                yield from answer(now, rows)

        for chunk, found in answers():
            yield pd.DataFrame([(chunk, found)], columns=["chunk", "found"])

    return run


def _exact(parts: int):
    """From chunks with their answers: (part, lang, phrases, counts), the surviving phrases of a task's chunks by their
    partition; the empty phrase has the number of all words."""

    def counts_of(row: dict) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
        ids, langs, of_lang, words = opened(row)
        name = np.array([None, *(w.decode("utf-8", "surrogatepass") for w in words)], dtype=object)
        language = np.r_[-1, of_lang]
        mine = np.sort(np.concatenate([unpacked(x) for x in row["found"]])) if len(row["found"]) else np.zeros(0, np.uint64)
        totals = np.bincount(of_lang, np.bincount(ids, minlength=len(name))[1:], len(langs)).astype(np.int64)
        for lang, total in zip(langs, totals.tolist(), strict=True):
            yield 0, lang, [""], [total]
        # a number for the phrase of n words that begins at each place, from those of n - 1; 0 if none survived
        code, phrase, lang, found = np.zeros(len(ids), dtype=np.int64), None, None, []
        for n, (at, hashes) in enumerate(phrase_hashes(ids, word_hashes(langs, of_lang, words), parts), 1):
            place = np.minimum(np.searchsorted(mine, hashes), len(mine) - 1)
            kept = mine[place] == hashes if len(mine) else np.zeros(len(at), dtype=bool)
            at, part = at[kept], (hashes[kept] >> np.uint64(KEY_BITS)).astype(np.int64)
            if n == 1:
                pair = ids[at]
            else:
                known = code[at] > 0
                at, part = at[known], part[known]
                pair = code[at] * len(name) + ids[at + n - 1]
            distinct, first, own, times = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
            if not len(distinct):
                break
            if n == 1:
                phrase, lang = name[distinct], language[distinct]
            else:
                before, last = np.divmod(distinct, len(name))
                phrase, lang = phrase[before - 1] + " " + name[last], lang[before - 1]
            found.append((part[first], lang, phrase, times))
            code[:] = 0
            code[at] = own + 1
        if found:
            part, lang, phrase, times = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((lang, part))
            part, lang, phrase, times = part[order], lang[order], phrase[order], times[order]
            begin = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (lang[1:] != lang[:-1])])
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(part)], strict=True):
                yield int(part[a]), langs[lang[a]], phrase[a:b], times[a:b].tolist()

    def sent(sums: dict[tuple[int, str], Counter]) -> pd.DataFrame:
        rows = []
        for (part, lang), own in sums.items():
            phrases = sorted(own)
            rows.append((part, lang, packed_text(phrases), packed(np.array([own[x] for x in phrases]))))
        return pd.DataFrame(rows, columns=["part", "lang", "phrases", "counts"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, str], Counter] = defaultdict(Counter)
        for frame in frames:
            for row in frame.to_dict("records"):
                for part, lang, phrases, counts in counts_of(row):
                    own = sums[part, lang]
                    for phrase, n in zip(phrases, counts, strict=True):
                        own[phrase] += n
                if sum(map(len, sums.values())) >= HELD:
                    yield sent(sums)
                    sums.clear()
        yield sent(sums)

    return run


def _added(threshold: int):
    """From the exact counts of each partition, which follow each other: (lang, phrase, n) of those that reach the
    threshold, and of null phrases. A partition has no more phrases than its summary had counters."""

    def reaching(sums: Counter) -> pd.DataFrame:
        rows = [(lang, phrase or None, n) for (lang, phrase), n in sums.items() if not phrase or n >= threshold]
        return pd.DataFrame(rows, columns=["lang", "phrase", "n"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sums = None, Counter()
        for frame in frames:
            for part, lang, phrases, counts in frame.itertuples(index=False):
                if part != now:
                    yield reaching(sums)
                    now, sums = part, Counter()
                for phrase, n in zip(unpacked_text(phrases), unpacked(counts).tolist(), strict=True):
                    sums[lang, phrase] += n
        yield reaching(sums)

    return run


def frequent(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(lang, phrase, n): all phrases of 1 to WIDTH words that occur so often in a language; a null phrase has the number of its words."""
    made = written(chunks(docs), "chunks")
    mass = made.agg(F.sum("mass")).first()[0] or 0
    parts = max(1, -(-mass // PART_MASS))
    sent = made.mapInPandas(_summaries(parts), "part long, chunk long, keys binary, counts binary")
    dealt = sent.repartition(-(-parts // TASK_PARTS), "part").sortWithinPartitions("part", "chunk")
    answers = dealt.mapInPandas(_answers(threshold), "chunk long, found binary")
    # a chunk gets no more hashes than it sent
    answered = answers.groupBy("chunk").agg(F.collect_list("found").alias("found"))
    both = made.drop("mass").join(answered, "chunk", "left").withColumn("found", F.coalesce("found", F.array().cast("array<binary>")))
    counts = both.mapInPandas(_exact(parts), "part long, lang string, phrases binary, counts binary")
    dealt = counts.repartition(-(-parts // TASK_PARTS), "part").sortWithinPartitions("part")
    return dealt.mapInPandas(_added(threshold), "lang string, phrase string, n long")


def _big(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(38,0)")


def phrases(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of each phrase of at least 2 words that no longer one makes needless."""
    counts = written(frequent(docs, threshold), "phrase_counts")
    total = counts.filter(F.col("phrase").isNull()).select("lang", F.col("n").alias("total"))
    every = counts.filter(F.col("phrase").isNotNull())
    found = every.filter(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    piece = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    left, right = (every.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    # few languages, so the planner sends their totals to all
    met = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(total, "lang")
    # whole numbers of up to 38 digits: counts below 10^12 and 1000 fit
    scored = met.withColumn("score", F.expr("(1000BD * CAST(a AS DECIMAL(17,0)) * CAST(total AS DECIMAL(17,0))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    least = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", F.col("total").alias("n"))).alias("own"))
    # all shorter phrases within each phrase, by where they begin and how long they are
    spans = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(1), F.size("words") - 1),
        lambda i: F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("words") - i + 1)), lambda size: F.struct(i.alias("i"), size.alias("size"))),
    )))
    inside = found.withColumn("span", spans).filter((F.col("span.size") < F.size("words")) & (F.col("span.i") + F.col("span.size") - 1 <= F.size("words")))
    longer = inside.select("lang", piece(F.col("span.i"), F.col("span.size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = least.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("own.a")))
    return kept.select("lang", "phrase", "own.a", "own.l", "own.r", "own.n", "own.score")


def ranked(docs: DataFrame, threshold: int = THRESHOLD, listed: int = LISTED) -> DataFrame:
    """The first phrases of each language by score."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = phrases(docs, threshold).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))
    few = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= listed)
    last = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= listed)
    return last.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
begins AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM split),
spans AS (SELECT lang, words, i, unnest(range(1, least({WIDTH}, len(words) - i + 1) + 1)) AS size FROM begins),
counts AS (
  SELECT lang, phrase, count(*) AS a FROM (SELECT lang, array_to_string(words[i:i + size - 1], ' ') AS phrase FROM spans)
  GROUP BY ALL HAVING count(*) >= {THRESHOLD}),
total AS (SELECT lang, count(*) AS n FROM spans WHERE size = 1 GROUP BY lang),
found AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS words FROM counts WHERE contains(phrase, ' ')),
cut AS (SELECT *, unnest(range(1, len(words))) AS k FROM found),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * cut.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM cut JOIN counts x ON x.lang = cut.lang AND x.phrase = array_to_string(words[:k], ' ')
  JOIN counts y ON y.lang = cut.lang AND y.phrase = array_to_string(words[k + 1:], ' ') JOIN total ON total.lang = cut.lang),
least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(words[i:i + size - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(2, len(words))) AS size FROM (SELECT *, unnest(range(1, len(words))) AS i FROM found))
  WHERE i + size - 1 <= len(words) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM least_cut LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
WHERE rank <= {LISTED}
"""
