"""Chat formatting with typed content parts.

A message is a plain text or a list of parts. A visitor walks the parts in order and flattens them: text
is escaped, an image, audio or document part becomes one placeholder, and its attachment is recorded with
reference, offset and the number of tokens it expands to. Turns are set between control strings; control strings
inside texts and roles get a backslash after their first character (more if they have some already), so
nothing in a text is ever read as a mark and unescaping is exact.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: Control strings of common chat templates; "<|" begins every mark of this one.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join(rf"(?<={re.escape(c[0])})(?=\\*{re.escape(c[1:])})" for c in CONTROLS))
_UNESCAPE = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in CONTROLS))
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


def _number(value, least: float, most: float = 1 << 40) -> float:
    """A number within bounds; least for what is none."""
    try:
        out = float(value)
    except (TypeError, ValueError, OverflowError):
        return least
    return min(max(out, least), most) if out == out else least


def _plain(value) -> str:
    """What stands for text in a part as text that UTF-8 can hold: none is empty, other values are their JSON."""
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@dataclass
class Budget:
    """How many tokens an attachment expands to; sizes that are missing or no numbers count as the least."""

    patch: int = 28
    audio_per_second: float = 25.0
    per_page: int = 256

    def image(self, part: dict) -> int:
        across, down = (math.ceil(_number(part.get(k), 1, 1 << 20) / self.patch) for k in ("width", "height"))
        return across * down

    def audio(self, part: dict) -> int:
        return max(1, math.ceil(_number(part.get("seconds"), 0) * self.audio_per_second))

    def document(self, part: dict) -> int:
        return math.floor(_number(part.get("pages"), 1)) * self.per_page


@dataclass
class Flattened:
    text: str = ""
    attachments: list[tuple[str, str, int, int]] = field(default_factory=list)  # kind, reference, offset, tokens
    pending: str = ""  # text since the last placeholder; escaped whole, as a control string may be spread over parts

    def flush(self) -> None:
        self.text, self.pending = self.text + escape(self.pending), ""


class Flattener:
    """Visits the parts of one conversation; attachments are numbered through all its messages."""

    def __init__(self, budget: Budget | None = None):
        self.budget, self.count = budget or Budget(), 0

    def visit(self, content) -> Flattened:
        """content: a text or a list of parts; anything else is a single part. A part is an object with a type, or its text."""
        out = Flattened()
        for part in content if isinstance(content, list) else [content]:
            kind = part.get("type", "text") if isinstance(part, dict) else "text"
            visit = {"text": self.visit_text, "image": self.visit_attached, "audio": self.visit_attached, "document": self.visit_attached}
            visit.get(kind if isinstance(kind, str) else "", self.visit_unknown)(part, out)
        out.flush()
        return out

    def visit_text(self, part, out: Flattened) -> None:
        out.pending += _plain(part.get("text") if isinstance(part, dict) else part)

    def visit_attached(self, part: dict, out: Flattened) -> None:
        out.flush()
        kind = part["type"]
        out.attachments.append((kind, _plain(part.get("ref") or part.get("url")), len(out.text), getattr(self.budget, kind)(part)))
        out.text += f"<|{kind}:{self.count}|>"
        self.count += 1

    def visit_unknown(self, part: dict, out: Flattened) -> None:
        """Parts of another type are kept as the text of their JSON, so nothing is lost."""
        out.pending += _plain(part)


def parse_parts(value: str):
    """The parts of a JSON list; what is no JSON is one part of text."""
    try:
        return json.loads(value)
    except (ValueError, RecursionError):
        return value


def format_turns(turns: list[tuple[str, str | list]], budget: Budget | None = None) -> tuple[str, list[tuple[int, int]], list[tuple]]:
    """(formatted, loss mask as code point ranges, attachments) of (role, content) turns. The mask covers what
    assistants say, without any mark."""
    pieces, mask, attachments, at = [], [], [], 0
    visitor = Flattener(budget)
    for role, content in turns:
        flat = visitor.visit(content)
        head = TURN + escape(_plain(role)) + BODY
        start = at + len(head)
        if role == "assistant":
            mask.append((start, start + len(flat.text)))
        attachments += [(kind, ref, start + offset, n) for kind, ref, offset, n in flat.attachments]
        pieces.append(head + flat.text + END)
        at += len(pieces[-1])
    return "".join(pieces), mask, attachments


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn, unescaped; placeholders stay as they are."""
    out = []
    for piece in formatted.split(TURN)[1:]:
        role, _, body = piece.partition(BODY)
        out.append((unescape(role), unescape(body.removesuffix(END))))
    return out


SCHEMA = "conv_id string, formatted string, loss_spans array<struct<start:long,end:long>>, attachments array<struct<kind:string,ref:string,offset:long,tokens:long>>, n_tokens_attached long"


def format_conversations(rows: DataFrame, parts: str | None = None, budget: Budget | None = None) -> DataFrame:
    """One row per conversation: formatted text, loss mask and attachments.

    rows: conv_id, turn, role, text; parts names a further column with a JSON list of typed parts, used instead of text
    where it isn't null or empty; malformed JSON counts as text, lone surrogates as replacement characters. Turns go by turn, ties by role and text; null turns come first, null roles and texts count as
    empty, a null conv_id is a conversation of its own. Other columns aren't read. A conversation is one
    record of the output and is assembled whole, so it must fit in a task; nothing else is gathered."""
    more = F.col(parts) if parts else F.lit(None).cast("string")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), more.alias("parts"))
    # The id travels through pandas as a string, which keeps nulls and all 64 bits.
    whole = rows.groupBy(F.col("conv_id").cast("long").cast("string").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [format_turns([(t["role"], parse_parts(t["parts"]) if t["parts"] else t["text"]) for t in turns], budget) for turns in b["turns"]]
            yield pd.DataFrame(
                {
                    "conv_id": b["conv_id"],
                    "formatted": [f for f, _, _ in made],
                    "loss_spans": [[{"start": s, "end": e} for s, e in m] for _, m, _ in made],
                    "attachments": [[dict(zip(("kind", "ref", "offset", "tokens"), a, strict=True)) for a in x] for _, _, x in made],
                    "n_tokens_attached": [sum(a[3] for a in x) for _, _, x in made],
                }
            )

    return whole.mapInPandas(run, SCHEMA).withColumn("conv_id", F.col("conv_id").cast("long"))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted text and its mask: a row for each row, in any number; a conversation without
    turns has zero turns and the digests of nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for conv, text, spans in zip(b["conv_id"], b["formatted"], b["loss_spans"], strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = hashlib.sha256()
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                for k, v in zip(out, (conv, len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    out[k].append(v)
            yield pd.DataFrame(out)

    plain = formatted.select(F.col("conv_id").cast("string"), "formatted", "loss_spans")
    schema = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return plain.mapInPandas(run, schema).withColumn("conv_id", F.col("conv_id").cast("long"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation, read back from the formatted text. Null texts and roles are empty, null turns come first, a null
    conv_id is a conversation of its own; repeated rows are turns of their own; without rows there is only conversation -7."""
    said = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return digests(format_conversations(rows.union(planted)))
