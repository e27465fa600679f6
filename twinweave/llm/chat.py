"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only the
text of that reply is trainable. Turns after a conversation's last assistant turn (or a conversation
without any) give one further example with an empty mask, so that no turn is lost.

Defined cases: a null text or role is empty; turns go by (turn, role, text), nulls first, and repeated
rows stay; a null conv_id is a conversation of its own; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.llm.common import table

TURN, ROLE_END, END = "<|turn|>", "\n", "<|end|>\n"
#: Strings that steer a chat model; inside a text they are broken up with a backslash.
CONTROL = (
    "<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
    "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<unk>", "<pad>",
)
_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(x) for x in CONTROL))
_UNESCAPE = re.compile(r"\\(.)", re.S)
EXAMPLE = "conv_id long, example long, n_turns long, formatted string, loss_start long, loss_chars long"
#: Characters in one output batch.
BATCH_CHARS = 8_000_000


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of each control string."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" if m[1] == "\\" else m[1], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the text, what stands after it."""
    return f"{TURN}{escape_role(role)}{ROLE_END}", escape(text), END


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of a formatted example."""
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.partition(ROLE_END)
        yield unescape_role(role), unescape(text.removesuffix(END))


def examples(turns: Iterable[tuple[str, str]]) -> Iterator[tuple[int, str, int, int]]:
    """(turns, formatted text, start and length of the trainable text) of each example."""
    parts: list[str] = []
    at, n, open_turns = 0, 0, False
    for n, (role, text) in enumerate(turns, 1):
        before, body, after = format_turn(role, text)
        parts += (before, body, after)
        open_turns = role != "assistant"
        if not open_turns:
            parts = ["".join(parts)]
            yield n, parts[0], at + len(before), len(body)
        at += len(before) + len(body) + len(after)
    if open_turns:
        yield n, "".join(parts), at, 0


def _conversations(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    now, turns = None, []
    for frame in frames:
        for conv, none, role, text in zip(frame.conv_id, frame.no_id, frame.role, frame.text, strict=True):
            key = None if none else int(conv)
            if turns and key != now:
                yield now, turns
                turns = []
            now = key
            turns.append((role, text))
    if turns:
        yield now, turns


def _expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, chars = [], 0
    columns = [x.split()[0] for x in EXAMPLE.split(", ")]

    def frame() -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})

    for conv, turns in _conversations(frames):
        for k, (n, formatted, start, length) in enumerate(examples(turns)):
            rows.append((conv, k, n, formatted, start, length))
            chars += len(formatted)
            if chars > BATCH_CHARS or len(rows) >= 2000:
                yield frame()
                rows, chars = [], 0
    if rows:
        yield frame()


def expand(conversations: DataFrame) -> DataFrame:
    """One row per example; the examples of a conversation follow each other within a partition.

    The one shuffle brings a conversation's rows together; the examples themselves, whose size grows
    with the square of a conversation's turns, are made after it and aren't moved.
    """
    rows = conversations.select(
        F.coalesce(F.col("conv_id"), F.lit(0)).cast("long").alias("conv_id"),
        F.col("conv_id").isNull().alias("no_id"),
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id", "no_id").sortWithinPartitions("conv_id", "no_id", "turn", "role", "text")
    return dealt.mapInPandas(_expand, EXAMPLE)


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, n_examples long"
)


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads examples back; those of a conversation follow each other, the last one has all its turns."""
    columns = [x.split()[0] for x in DIGEST.split(", ")]
    now, last, loss, chars, size, n, begun = None, "", hashlib.sha256(), 0, 0, 0, False
    rows: list[tuple] = []

    def close() -> None:
        turns, count = hashlib.sha256(), 0
        for role, text in read_turns(last):
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            count += 1
        rows.append((now, count, turns.hexdigest(), chars, loss.hexdigest(), size, n))

    def frame() -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})

    for batch in frames:
        for conv, k, formatted, start, length in zip(
            batch.conv_id, batch.example, batch.formatted, batch.loss_start, batch.loss_chars, strict=True
        ):
            if k == 0:
                if begun:
                    close()
                now = None if pd.isna(conv) else int(conv)
                loss, chars, size, n, begun = hashlib.sha256(), 0, 0, 0, True
            reply = unescape(formatted[start : start + length])
            loss.update(reply.encode("utf-8", "surrogatepass"))
            last, chars, size, n = formatted, chars + len(reply), size + len(formatted), n + 1
        if rows:
            yield frame()
            rows = []
    if begun:
        close()
        yield frame()


def digests(expanded: DataFrame) -> DataFrame:
    """A row per conversation, read from the formatted examples where they lie."""
    return expanded.mapInPandas(_digest, DIGEST)


#: Two turns that hold control strings.
PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return digests(expand(rows.unionByName(probe)))


def _oracle() -> str:
    """The same digests in DuckDB: the turns as they were, and the length of the escaped form."""
    escaped = "replace(t, '\\', '\\\\')"
    for x in CONTROL:
        escaped = f"replace({escaped}, '{x}', '{x[0]}\\{x[1:]}')"
    role = escaped.replace("(t, '\\'", "(r, '\\'")
    fixed = len(TURN) + len(ROLE_END) + len(END)
    return f"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), sized AS (
  SELECT *, {fixed} + length(replace({role}, chr(10), '\\n')) + length({escaped}) AS len,
    row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n
  FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t)
), run AS (
  SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY rn) AS so_far FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY rn) FILTER (r = 'assistant'), '')) AS loss_sha256,
  (sum(so_far) FILTER (r = 'assistant' OR rn = n))::BIGINT AS formatted_chars,
  count(*) FILTER (r = 'assistant' OR rn = n) AS n_examples
FROM run GROUP BY conv_id
"""


ORACLE_SQL = _oracle()
