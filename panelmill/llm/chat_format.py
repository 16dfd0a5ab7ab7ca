"""Chat formatting by a declarative template and a finite-state machine over roles.

A template names the markers around each turn, the control strings that may not occur raw in
a text, the roles that bear loss, and the transitions of the machine. The state after a turn is
the role of that turn, so the machine runs as one look back inside a conversation: a turn whose
(state, role) pair is not in the table is a fault, and the machine goes on from its role.

``segments`` emits one row per piece of formatted text with its loss flag; joined in order they
are the formatted conversation. Texts are escaped reversibly: a backslash doubles, and every
control string gets a backslash after its first character, so no marker appears inside a text.

Defined cases: a null role or text is empty; turns with the same number are ordered by role and
text, repeated rows stay repeated turns; null conv_id and turn form a conversation and come first;
an empty table gives no segments; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<|turn|>"
    between: str = "<|text|>"
    end: str = "<|end|>\n"
    controls: tuple[str, ...] = ("<|turn|>", "<|text|>", "<|end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: tuple[str, ...] = ("assistant",)
    # (state, role) pairs the machine accepts; "" is the state before the first turn.
    transitions: tuple[tuple[str, str], ...] = (
        ("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")
    )
    finals: tuple[str, ...] = ("assistant",)
    _escape: str = field(default="\\", repr=False)

    def __post_init__(self):
        markers = {m.strip() for m in (self.begin, self.between, self.end)}
        if not markers <= set(self.controls):
            raise ValueError("every marker must be a control string")
        if any("\\" in c or len(c) < 2 for c in self.controls):
            raise ValueError("control strings have two characters or more and no backslash")


def escaped(text: Column, template: Template) -> Column:
    any_control = "|".join(_quoted(c) for c in template.controls)
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"(?=(?:{any_control}))(.)", r"$1\\")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" for c in text)


UNESCAPE = re.compile(r"\\(.)", re.S)


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def segments(turns: DataFrame, template: Template) -> DataFrame:
    """conv_id, turn_no, part, text, loss, fault: the formatted pieces, in (turn_no, part) order.

    Parts of a turn: 0 header, 1 text, 2 end. ``fault``: the machine rejected the turn, or, on the
    last one, ends in a state that is not final.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    allowed = F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("r")) for a, b in template.transitions])
    state = F.coalesce(F.lag("role").over(order), F.lit(""))
    rows = rows.select(
        "conv_id", "role", "text",
        (F.row_number().over(order) - 1).cast("long").alias("turn_no"),
        state.alias("state"),
        F.lead("role").over(order).isNull().alias("last"),
    )
    fault = ~F.array_contains(allowed, F.struct(F.col("state").alias("s"), F.col("role").alias("r"))) | (
        F.col("last") & ~F.col("role").isin(*template.finals)
    )
    header = F.concat(F.lit(template.begin), escaped(F.col("role"), template), F.lit(template.between))
    pieces = F.array(
        F.struct(F.lit(0).alias("part"), header.alias("text"), F.lit(False).alias("loss")),
        F.struct(F.lit(1).alias("part"), escaped(F.col("text"), template).alias("text"), F.col("role").isin(*template.loss_roles).alias("loss")),
        F.struct(F.lit(2).alias("part"), F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
    )
    return rows.select("conv_id", "turn_no", fault.alias("fault"), F.explode(pieces).alias("p")).select(
        "conv_id", "turn_no", "p.part", "p.text", "p.loss", "fault"
    )


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_faults long"
)


def read_back(pieces: DataFrame, template: Template) -> DataFrame:
    """Digests of every conversation, read from its formatted pieces alone.

    Pieces arrive by conversation and in order; the digests grow piece by piece, so a task holds
    one batch whatever the length of a conversation.
    """
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_pieces = (
        pieces.withColumn("conv_id", F.col("conv_id").cast("long"))
        .repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn_no", "part")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Reader | None = None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "fault", "part")]
            for conv, text, loss, fault, part in zip(*columns, strict=True):
                if state is None or conv != state.conv:
                    if state is not None:
                        done.append(state.result())
                    state = _Reader(conv, template)
                state.take(text, loss)
                state.faults += fault and part == 0
            if done:
                yield _rows(done)
        if state is not None:
            yield _rows([state.result()])

    return sorted_pieces.mapInArrow(digest, DIGESTS)


def _rows(done: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(pd.DataFrame(done).astype({"conv_id": "Int64"}), preserve_index=False)


class _Reader:
    """Parses one formatted conversation as it streams by: markers first, then unescaping."""

    def __init__(self, conv, template: Template):
        self.conv, self.template = conv, template
        self.marks = re.compile("|".join(re.escape(m) for m in (template.begin, template.between, template.end)))
        self.turns = self.chars = self.loss_chars = self.faults = 0
        self.all, self.lossy = hashlib.sha256(), hashlib.sha256()

    def take(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if loss:
            plain = unescaped(text)
            self.loss_chars += len(plain)
            self.lossy.update(plain.encode())
        at = 0
        for mark in self.marks.finditer(text):
            self._plain(text[at : mark.start()])
            if mark.group() == self.template.begin:
                self.turns += 1
            else:  # after the role, and after the text
                self.all.update(b"\n")
            at = mark.end()
        self._plain(text[at:])

    def _plain(self, text: str) -> None:
        self.all.update(unescaped(text).encode())

    def result(self) -> dict:
        return {
            "conv_id": self.conv, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.lossy.hexdigest(), "formatted_chars": self.chars, "n_faults": self.faults,
        }
