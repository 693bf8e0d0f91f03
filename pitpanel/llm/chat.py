"""Chat formatting by token-level assembly.

Every turn's segments are encoded by themselves; reserved ids, one for each control string, are spliced between
them. Control strings of turns in a text are broken by a backslash after their first letter, and backslashes
doubled, so that no text can hold one and the text can be read back; in a role, so is the colon that ends it. Where a turn starts in its conversation and
which ids carry loss follows from prefix sums of lengths.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM, USER, ASSISTANT, ROLE, COLON, END = CONTROLS = (
    "### System: ",
    "### User: ",
    "### Assistant: ",
    "### Role ",
    ": ",
    "</turn>\n",
)
KNOWN = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
_BREAK = re.compile(r"#(?=##)|<(?=/turn>)")
_BACK = re.compile(r"\\(.)", re.S)
_held: dict[str, tiktoken.Encoding] = {}


def escape(text: str) -> str:
    return _BREAK.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    return escape(role).replace(": ", ":\\ ")


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def encoding(path: str) -> tiktoken.Encoding:
    """The rank file's encoding, the control strings behind its ids."""
    if path not in _held:
        from pitpanel.llm.bpe import SPLIT

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        first = max(ranks.values()) + 2
        special = {c: first + i for i, c in enumerate(CONTROLS)}
        _held[path] = tiktoken.Encoding("chat", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return _held[path]


def format_conversations(
    rows: DataFrame, tokenizer: str, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"
) -> DataFrame:
    """(conv_id long, position long, ids array<int>, start long, loss_from long, loss_to long), a row for each turn.

    ids are the turn's; start is where they begin in the conversation, and those from loss_from to before loss_to
    (counted from the conversation's start) carry loss: an assistant's text. Rows are in partitions by
    conversation, sorted by position. Turns are ordered by turn (nulls first), role, SHA-256 of the text; repeated rows stay.
    Null role or text: empty. Rows with a null conv_id form one conversation. A role other than system, user and
    assistant is spelled out between two reserved ids. An empty table gives no rows. Other columns are not looked at.
    Formatting takes turns by themselves; a conversation is one task's only for the order of its turns, which are
    sorted on disk and streamed.
    """

    def run(frames):
        enc = encoding(tokenizer)
        code = {c: enc.encode_single_token(c) for c in CONTROLS}
        for df in frames:
            ids, head, body = [], [], []
            for role, text in zip(df["role"], df["text"], strict=True):
                mark = KNOWN.get(role)
                front = [code[mark]] if mark else [code[ROLE], *enc.encode_ordinary(escape_role(role)), code[COLON]]
                content = enc.encode_ordinary(escape(text))
                ids.append([*front, *content, code[END]])
                head.append(len(front))
                body.append(len(content) if role == "assistant" else 0)
            yield pd.DataFrame(
                {"conv_id": df["conv_id"], "turn": df["turn"], "role": df["role"], "text_key": df["text"]}
            ).assign(ids=ids, head=head, body=body)

    rows = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    kind = "conv_id long, turn long, role string, text_key string, ids array<int>, head int, body int"
    coded = rows.mapInPandas(run, kind).withColumn("text_key", F.sha2("text_key", 256))
    order = ["turn", "role", "text_key"]
    coded = coded.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    w = Window.partitionBy("conv_id").orderBy(*order)
    before = F.sum(F.size("ids").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = coded.withColumns({"position": F.row_number().over(w).cast("long"), "start": F.coalesce(before, F.lit(0))})
    loss_from = F.col("start") + F.col("head")
    return out.select(
        "conv_id", "position", "ids", "start", loss_from.alias("loss_from"), (loss_from + F.col("body")).alias("loss_to")
    )


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each conversation of format_conversations' rows: what its ids and loss spans decode to.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars). Turns stream through, so a
    conversation of any length needs the memory of one batch.
    """

    def run(frames):
        enc = encoding(tokenizer)
        name = {enc.encode_single_token(c): c for c in CONTROLS}
        role_of = {c: r for r, c in KNOWN.items()}
        now, out = None, []

        def done():
            if now is not None:
                out.append((now["id"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["all"]))

        for df in frames:
            for conv, ids, start, a, b in zip(*(df[c] for c in df.columns), strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if now is None or now["id"] != conv:
                    done()
                    now = {"id": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
                ids = np.asarray(ids)
                mask = np.zeros(len(ids) + 1, dtype=np.int64)
                mask[a - start] += 1
                mask[b - start] -= 1
                mask = np.cumsum(mask)[:-1].astype(bool)
                ends = [i for i, x in enumerate(ids) if name.get(int(x)) == END]
                first = 0
                for end in ends:
                    turn = ids[first:end].tolist()
                    if name[turn[0]] == ROLE:
                        colon = next(i for i, x in enumerate(turn) if name.get(x) == COLON)
                        role, content = unescape(enc.decode(turn[1:colon])), turn[colon + 1 :]
                    else:
                        role, content = role_of[name[turn[0]]], turn[1:]
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{unescape(enc.decode(content))}\n".encode())
                    first = end + 1
                loss = unescape(enc.decode(ids[mask].tolist()))
                now["chars"] += len(loss)
                now["loss"].update(loss.encode())
                now["all"] += len(enc.decode(ids.tolist()))
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=cols)
                out = []
        done()
        if out:
            yield pd.DataFrame(out, columns=cols)

    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "ids", "start", "loss_from", "loss_to").mapInPandas(run, kind)
