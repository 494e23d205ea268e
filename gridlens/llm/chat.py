"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor
walks the parts in order: neighbouring texts are joined and escaped as one, since a control string may be
cut between them; every other part becomes an ordered
placeholder such as `<|image:2|>`, its reference is noted as an attachment and
its expanded token count is added up. The template marks turns, and the control
strings that occur in a text are escaped reversibly, so the turns can be read
back from the formatted string alone.

Escaping: every backslash is doubled, and a backslash is put after the first
character of every control string. Taking it back: a backslash stands for the
character after it (its double for itself).

Ties and repeated rows: turns sort by turn, then role, then text; a null turn
comes first; repeated rows stay as turns. Null role is `user`, null text is
empty. Turns with a null conversation id form one conversation of that id. A
conversation of no rows does not appear, so an empty table gives no rows. A
conversation is formatted in one row and has to fit a task, however long. Columns
other than the four named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.llm.text import as_key, exact, longs

#: fixed values: strings that chat templates in public use treat as control.
CONTROLS = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]
_BREAK = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.S)
_TURN = re.compile(r"<\|turn:((?:[^\\|]|\\.)*)\|>\n((?:[^<\\]|\\.|<(?!\|end\|>))*)<\|end\|>\n", re.S)

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("units", T.LongType())])
FORMATTED = "conv_id long, formatted string, loss_spans array<struct<begin:long,stop:long>>, attachments array<struct<placeholder:string,kind:string,ref:string,turn_index:int,tokens:long>>, expanded_tokens long"
#: expanded tokens of one unit: an image tile, a second of sound, a page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 600}


def escape(text: str) -> str:
    return _BREAK.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return re.sub(r"([\\|<\[])", r"\\\1", role)


@dataclass
class Visitor:
    """Flattens the parts of a conversation; one method for each kind of part."""

    attachments: list = field(default_factory=list)
    seen: dict = field(default_factory=dict)
    tokens: int = 0

    def visit(self, parts: list[dict], turn: int) -> str:
        out = []
        for kind, run in groupby(parts, lambda p: p["type"] or "text"):
            out += [self.text(run)] if kind == "text" else [self.attachment(kind, p, turn) for p in run]
        return "".join(out)

    def text(self, run: Iterable[dict]) -> str:
        return escape("".join(p["text"] or "" for p in run))

    def attachment(self, kind: str, part: dict, turn: int) -> str:
        self.seen[kind] = n = self.seen.get(kind, 0) + 1
        mark = f"<|{escape_role(kind)}:{n}|>"
        cost = TOKENS_PER_UNIT.get(kind, 1) * int(part["units"] or 1)
        self.tokens += cost
        self.attachments.append({"placeholder": mark, "kind": kind, "ref": part["ref"], "turn_index": turn, "tokens": cost})
        return mark


def render(turns: list[dict]) -> tuple[str, list[dict], Visitor]:
    """The formatted conversation, the spans under the loss (assistant texts) and the visitor."""
    out, spans, at, visitor = [], [], 0, Visitor()
    for i, turn in enumerate(turns):
        role = turn["role"] or "user"
        head = f"<|turn:{escape_role(role)}|>\n"
        body = visitor.visit([] if turn["parts"] is None else list(turn["parts"]), i)
        if role == "assistant":
            spans.append({"begin": at + len(head), "stop": at + len(head) + len(body)})
        text = f"{head}{body}<|end|>\n"
        out.append(text)
        at += len(text)
    return "".join(out), spans, visitor


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn; placeholders stay in the text as they stand."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def text_parts(*texts: Column) -> Column:
    """Plain texts as a list of text parts."""
    none = F.lit(None)
    return F.array(*[F.struct(F.lit("text").alias("type"), F.coalesce(t, F.lit("")).alias("text"), none.cast("string").alias("ref"), none.cast("long").alias("units")) for t in texts])


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: str | Column = "parts") -> DataFrame:
    """One row per conversation: formatted text, loss spans (code points), attachments, expanded tokens.

    One shuffle on the conversation id gathers the turns; a conversation is what
    a model reads at once, so it fits a task. `parts` is array<PART>.
    """
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), (F.col(parts) if isinstance(parts, str) else parts).cast(T.ArrayType(PART)).alias("parts")).alias("row"),
    )
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def form(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, convs = [], []
            for conv, items in zip(exact(batch["conv_id"]), batch["rows"], strict=True):
                text, spans, visitor = render([{"role": r["role"], "parts": r["parts"]} for r in items])
                found.append((text, spans, visitor.attachments, visitor.tokens))
                convs.append(conv)
            yield pd.DataFrame(found, columns=["formatted", "loss_spans", "attachments", "expanded_tokens"]).assign(conv_id=longs(convs))

    return gathered.withColumn("conv_id", as_key(F.col("conv_id"))).mapInPandas(form, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings say when they are read back."""
    import hashlib

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            found, convs = [], []
            for conv, text, spans in zip(exact(batch["conv_id"]), batch["formatted"], batch["loss_spans"], strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["begin"] : s["stop"]]) for s in spans)
                convs.append(conv)
                found.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pd.DataFrame(found, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).assign(conv_id=longs(convs))

    return formatted.select(as_key(F.col("conv_id")).alias("conv_id"), "formatted", "loss_spans").mapInPandas(read, DIGEST)
