"""Chat formatting by token-level assembly.

Every segment (a role, a text) is encoded on its own, so no token spans a boundary, and reserved ids
beyond the tokenizer's vocabulary are spliced between segments: no content can produce them. The
loss mask is the prefix sum of +1 where an assistant text begins and -1 where it ends. In the readable
form the reserved ids have names; names that occur inside a text are escaped, reversibly, before the
text is encoded, so reading either form back gives the texts as they were.

Template of a turn: `<s>` role `[INST]` text `[/INST]` `</s>`. A conversation is the turns in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings; string number k has the reserved id vocabulary size + k.
CONTROLS = ("<s>", "[INST]", "[/INST]", "</s>")
BEGIN, OPEN, CLOSE, END = range(4)
_FIND = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_UNDO = re.compile(r"\\([\\-])")


def escape(text: str) -> str:
    r"""Double each backslash and put `\-` after the first character of each control string."""
    return _FIND.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\-", text)


def unescape(text: str) -> str:
    return _UNDO.sub(lambda m: "\\" if m[1] == "\\" else "", text)


class Assembler:
    """Encodes and decodes with one tokenizer file; strings of its special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([escape(t) for t in texts], add_special_tokens=False)]

    def decode(self, ids: Sequence[Sequence[int]]) -> list[str]:
        return [unescape(t) for t in self.tokenizer.decode_batch([list(map(int, x)) for x in ids], skip_special_tokens=False)]


def _segments(path: str):
    """A turn's ids, mask markers and readable form, from its row alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a = Assembler(path)
        for b in batches:
            roles, texts = (["" if x is None else x for x in b[c]] for c in ("role", "text"))
            known = dict(zip(names := list(dict.fromkeys(roles)), a.encode(names)))
            ids, masks, shown = [], [], []
            for role, text, t in zip(roles, texts, a.encode(texts)):
                r = known[role]
                x = np.concatenate([[a.base + BEGIN], r, [a.base + OPEN], t, [a.base + CLOSE, a.base + END]]).astype(np.int32)
                marks = np.zeros(len(x), np.int8)
                if role == "assistant" and t:
                    marks[2 + len(r)] += 1
                    marks[2 + len(r) + len(t)] -= 1
                ids.append(x)
                masks.append(np.cumsum(marks, dtype=np.int8))
                shown.append(f"{CONTROLS[BEGIN]}{escape(role)}{CONTROLS[OPEN]}{escape(text)}{CONTROLS[CLOSE]}{CONTROLS[END]}")
            yield pd.DataFrame({"conv_id": b["conv_id"], "turn": b["turn"], "role": roles, "ids": ids, "loss_mask": masks, "formatted": shown})

    return run


def format_conversations(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """The formatted turns: conv_id, turn, role, ids array<int>, loss_mask array<tinyint>, formatted string.

    A conversation's output is its rows' concatenation by turn; it stays in rows of one turn each, so a
    conversation of any length fits. Null roles and texts count as empty. Roles other than `assistant`
    carry no loss. Repeated rows are turns of their own. Extra columns have no effect.
    """
    schema = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, turn {conversations.schema['turn'].dataType.simpleString()}, role string, ids array<int>, loss_mask array<tinyint>, formatted string"
    return conversations.select("conv_id", "turn", "role", "text").mapInPandas(_segments(tokenizer), schema)


class _Reader:
    """Digests of one conversation, read back from its ids and masks in turn order."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self, conv_id) -> tuple:
        return conv_id, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_back(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a = Assembler(path)
        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        current, reader = None, None
        for b in batches:
            done = []
            convs = [int(c) if k else None for c, k in zip(b["conv_id"], b["known"])]
            parts, masked = [], []
            for x, m in zip(b["ids"], b["loss_mask"]):
                x, m = np.asarray(x), np.asarray(m)
                at = {int(v) - a.base: int(p) for p, v in zip(np.flatnonzero(x >= a.base), x[x >= a.base])}
                parts += [x[at[BEGIN] + 1 : at[OPEN]], x[at[OPEN] + 1 : at[CLOSE]]]
                masked.append(x[m > 0])
            texts, losses = a.decode(parts), a.decode(masked)
            for i, conv in enumerate(convs):
                if reader is None or conv != current:
                    if reader:
                        done.append(reader.row(current))
                    current, reader = conv, _Reader()
                role, text = texts[2 * i], texts[2 * i + 1]
                reader.turns += 1
                reader.said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                reader.loss.update(losses[i].encode("utf-8", "surrogatepass"))
                reader.loss_chars += len(losses[i])
                reader.chars += len(b["formatted"].iloc[i])
            yield pd.DataFrame(done, columns=columns)
        if reader:
            yield pd.DataFrame([reader.row(current)], columns=columns)

    return run


def conversation_digests(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation, read back from format_conversations' ids and masks.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline per turn), loss_chars and loss_sha256 (all
    text under the mask, unescaped), formatted_chars. Turns are in ascending order, null ones first,
    equal ones by role, then text; a null conv_id is a conversation of its own. A conversation of any length streams
    through one digest.
    """
    rows = formatted.withColumns({"known": F.col("conv_id").isNotNull(), "conv_id": F.coalesce(F.col("conv_id").cast("long"), F.lit(0))})
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "known", "conv_id").sortWithinPartitions("known", "conv_id", "turn", "role", "formatted")
    return dealt.select("conv_id", "known", "ids", "loss_mask", "formatted").mapInPandas(_read_back(tokenizer), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
