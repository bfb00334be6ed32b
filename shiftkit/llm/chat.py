"""Chat formatting from event logs: fold streamed deltas, edits and regenerations, then render."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftkit.llm.common import ship_by_value

#: Control strings of the template written here, and those of other common chat templates,
#: which must not reach a tokenizer out of a text either.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROL = (TURN, BODY, END, "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")

FORMAT_SCHEMA = "conv_id long, n_turns long, formatted string, mask array<struct<start: long, end: long>>"
READ_SCHEMA = "conv_id long, roles array<string>, texts array<string>, masked array<string>, formatted_chars long"


def escape(text: str) -> str:
    """Make control strings harmless: double each backslash, then put one after a control string's first character."""
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    """Exact inverse of :func:`escape`: every backslash quotes the character after it."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def fold(messages: list[list], event: str, role: str, text: str, back: int) -> None:
    """Apply one event to the messages so far (``[role, pieces]`` each).

    ``open`` starts a message, ``delta`` adds text to one, ``edit`` replaces its text, ``regenerate`` takes it
    and all after it away and opens it anew, ``delete`` takes it away. ``back`` counts from the last
    message (0). An event that points before the first message, or an unknown one, changes nothing.
    """
    if event == "open":
        messages.append([role, [text]])
        return
    at = len(messages) - 1 - back
    if at < 0 or back < 0:
        return
    if event == "delta":
        messages[at][1].append(text)
    elif event == "edit":
        messages[at][1] = [text]
    elif event == "regenerate":
        role = messages[at][0]
        del messages[at:]
        messages.append([role, [text]])
    elif event == "delete":
        del messages[at]


def render(messages: list[list], learn: str = "assistant") -> tuple[str, list[dict]]:
    """The formatted conversation and its loss mask: spans (code points) of the bodies of ``learn`` turns."""
    out, at, mask = [], 0, []
    for role, pieces in messages:
        head, body = TURN + escape(role) + BODY, escape("".join(pieces))
        out += [head, body, END]
        at += len(head)
        if role == learn:
            mask.append({"start": at, "end": at + len(body)})
        at += len(body) + len(END)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """Read the turns back; escaped texts hold no control string, so cutting at them is exact."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, body = part.partition(BODY)
        turns.append((unescape(role), unescape(body.removesuffix(END))))
    return turns


def format_events(events: DataFrame, order: list[str], learn: str = "assistant") -> DataFrame:
    """Rebuild each conversation of an event log and render it: ``conv_id, n_turns, formatted, mask``.

    ``events`` has conv_id, event, role, text, back (see :func:`fold`; null texts and roles are empty, a null back
    is 0) and the ``order`` columns, the sequence inside a conversation. The log is partitioned by
    conversation and sorted once; each task folds it as a stream and holds one conversation at a time, never a
    partition. Events equal in all order columns are interchangeable only if equal, so give enough columns.
    Rows of a null conv_id are one conversation. No events, no rows; further columns are ignored.
    """
    ship_by_value()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, messages, done = None, None, []

        def close() -> None:
            if messages is not None:
                text, mask = render(messages, learn)
                done.append((None if here == "" else int(here), len(messages), text, mask))

        for batch in batches:
            for conv, event, role, text, back in zip(*(batch[c] for c in ("conv", "event", "role", "text", "back")), strict=True):
                if messages is None or conv != here:
                    close()
                    here, messages = conv, []
                fold(messages, event, role, text, int(back))
            if done:
                yield pd.DataFrame(done, columns=["conv_id", "n_turns", "formatted", "mask"]).astype({"conv_id": "Int64"})
                done = []
        close()
        if done:
            yield pd.DataFrame(done, columns=["conv_id", "n_turns", "formatted", "mask"]).astype({"conv_id": "Int64"})

    empty = F.lit("")
    log = events.select(
        F.coalesce(F.col("conv_id").cast("string"), empty).alias("conv"), F.coalesce("event", empty).alias("event"),
        F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"), F.coalesce(F.col("back").cast("long"), F.lit(0)).alias("back"),
        *[F.col(c).alias(f"order_{i}") for i, c in enumerate(order)],
    )
    sorted_log = log.repartition("conv").sortWithinPartitions("conv", *[f"order_{i}" for i in range(len(order))])
    return sorted_log.mapInPandas(run, FORMAT_SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations: ``conv_id, roles, texts, masked, formatted_chars``; masked has the texts under the mask."""
    ship_by_value()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, mask in zip(batch["formatted"], batch["mask"], strict=True):
                turns = parse(text)
                rows.append(([r for r, _ in turns], [t for _, t in turns], [unescape(text[m["start"] : m["end"]]) for m in mask], len(text)))
            out = pd.DataFrame(rows, columns=["roles", "texts", "masked", "formatted_chars"])
            out.insert(0, "conv_id", batch["conv_id"].astype("Int64").to_numpy())
            yield out

    return formatted.select("conv_id", "formatted", "mask").mapInPandas(run, READ_SCHEMA)


def log_of(rows: DataFrame, piece: int = 80) -> DataFrame:
    """An event log of finished rows (conv_id, turn, role, text), as a streaming service would write it.

    A turn is opened empty and streamed as deltas of ``piece`` code points; an assistant's turn is first
    streamed up to its half, then regenerated. Any other turn is first streamed with a wrong text, and a stray
    message is opened behind it; the turn is edited to its first piece and the stray message deleted.
    Order: turn, role, text digest, copy, step; copy tells equal rows apart, so each is a turn of its own.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    half = F.substring(body, F.lit(1), F.floor(F.length(body) / 2).cast("int"))
    pieces = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))

    def step(event: str, text: Column, back: int = 0) -> Column:
        return F.struct(F.lit(event).alias("event"), text.alias("text"), F.lit(back).alias("back"))

    nothing = F.lit("")
    drafted = F.array(step("open", nothing), step("delta", half), step("regenerate", nothing))
    edited = F.array(
        step("open", nothing), step("delta", F.concat(half, F.lit(" (wrong)"))), step("open", half),
        step("edit", F.coalesce(F.get(pieces, F.lit(0)), nothing), 1), step("delete", nothing),
    )
    steps = F.when(F.col("role") == "assistant", F.concat(drafted, F.transform(pieces, lambda t: step("delta", t)))).otherwise(
        F.concat(edited, F.transform(F.filter(pieces, lambda _, i: i > 0), lambda t: step("delta", t)))
    )
    numbered = rows.select("conv_id", "turn", "role", F.xxhash64("text").alias("row"), F.monotonically_increasing_id().alias("copy"), steps.alias("steps"))
    return numbered.select("conv_id", "turn", "role", "row", "copy", F.posexplode("steps").alias("step", "e")).select(
        "conv_id", "turn", "role", "row", "copy", "step", F.col("e.event").alias("event"), F.col("e.text").alias("text"), F.col("e.back").alias("back")
    )
