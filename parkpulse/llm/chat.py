"""Chat formatting from an event log.

Events (conv_id, seq, kind, message, role, text): `open` starts a message (role), `delta` appends to
it, `edit` replaces its text, `regenerate` drops its text and every later message. They are dealt out
by conversation and sorted by (conv_id, seq); one pass folds the sorted stream, holding one
conversation at a time.

Rendering: each message is `### ` + role + `: ` + text + `</turn>` and a line end. In roles and texts
a backslash stands before every backslash, `#`, `<` and (roles) `:`; so no control string can be read
inside a text, and parsing gives back exactly what was written. The loss mask covers the escaped
texts of the assistant.

Null text counts as empty, a null role as the role "". Events with one seq are taken in the order of
kind, message, role and text; events for a message that was never opened open it without a role. A
null conv_id is a conversation of its own. Repeated rows count one by one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parkpulse.llm.shared import partitions, read_table

HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"
KINDS = ("open", "delta", "edit", "regenerate")
_EVENTS = "conv_id bigint, seq bigint, kind string, message bigint, role string, text string"
_FORMATTED = "conv_id bigint, formatted string, mask array<struct<begin:int,end:int>>"
_MESSAGE = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")
    return text.replace(":", "\\:") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def render(messages: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The formatted text, and the [begin, end) character spans under the loss mask."""
    out, mask, at = [], [], 0
    for role, text in messages:
        head, body = f"{HEAD}{escape(role, True)}{COLON}", escape(text)
        if role == ASSISTANT:
            mask.append({"begin": at + len(head), "end": at + len(head) + len(body)})
        out += [head, body, TAIL]
        at += len(head) + len(body) + len(TAIL)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted text; raises if it is not one."""
    out, at = [], 0
    while at < len(formatted):
        found = _MESSAGE.match(formatted, at)
        if not found:
            raise ValueError(f"no message at character {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


class Conversation:
    """Folds the events of one conversation."""

    def __init__(self):
        self.roles: dict[int, str] = {}
        self.texts: dict[int, list[str]] = {}

    def take(self, kind: str, message: int, role: str | None, text: str | None) -> None:
        if kind == "regenerate":
            for later in [m for m in self.texts if m > message]:
                del self.texts[later], self.roles[later]
        if kind == "open":
            self.roles[message] = role or ""
            self.texts.setdefault(message, [])
            return
        self.roles.setdefault(message, role or "")
        if kind == "delta":
            self.texts.setdefault(message, []).append(text or "")
        else:
            self.texts[message] = [text or ""] if kind == "edit" else []

    def messages(self) -> list[tuple[str, str]]:
        return [(self.roles[m], "".join(self.texts[m])) for m in sorted(self.texts)]


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id, formatted, mask of each conversation of an event log."""

    def run(batches):
        current, fold, seen = None, None, False
        done: list[tuple] = []

        def rows():
            ids, texts, masks = zip(*done, strict=True)
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(masks, kind)],
                ["conv_id", "formatted", "mask"],
            )

        for batch in batches:
            for conv_id, kind, message, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not seen or conv_id != current:
                    if seen:
                        done.append((current, *render(fold.messages())))
                    current, fold, seen = conv_id, Conversation(), True
                fold.take(kind, message, role, text)
            if len(done) >= 1000:
                yield rows()
                done = []
        if seen:
            done.append((current, *render(fold.messages())))
        if done:
            yield rows()

    return (
        events.repartition(partitions(events.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "seq", "kind", "message", "role", "text")
        .select("conv_id", "kind", "message", "role", "text")
        .mapInArrow(run, _FORMATTED)
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text says when it is parsed again, as digests."""

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            out = []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[m["begin"] : m["end"]]) for m in mask)
                out.append((len(turns), _sha256(said), len(loss), _sha256(loss), len(text)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names
            )

    return formatted.mapInArrow(
        run,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def turns_as_events(turns: DataFrame) -> DataFrame:
    """The event log of finished conversations (conv_id, turn, role, text).

    A message is opened and streamed as two deltas, the halves of its text. Rows of one turn are
    messages in the order of role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    no_text = F.lit(None).cast("string")

    def event(k, kind, text):
        seq = F.col("message") * 3 + k
        return F.struct(seq.alias("seq"), F.lit(kind).alias("kind"), "message", "role", text.alias("text"))

    return (
        turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
        .withColumn("message", F.row_number().over(order).cast("bigint"))
        .select(
            "conv_id",
            F.inline(
                F.array(
                    event(0, "open", no_text),
                    event(1, "delta", F.expr("left(text, CAST(ceil(char_length(text) / 2) AS INT))")),
                    event(2, "delta", F.expr("substr(text, CAST(ceil(char_length(text) / 2) AS INT) + 1)")),
                )
            ),
        )
    )


#: The planted conversation: control strings as ordinary text.
PLANTED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op2_chat(spark, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id bigint, turn int, role string, text string")
    return digests(format_conversations(turns_as_events(turns.union(planted))))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) AS escapes,
         length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) AS role_escapes
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(role) + role_escapes + 2 + length(text) + escapes + 8) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
