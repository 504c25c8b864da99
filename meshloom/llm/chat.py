"""Chat formatting with an offset-aligned loss mask.

A conversation is rendered whole and encoded once, with offsets. The spans of the assistant's texts are sorted, and so are
the tokens' spans; binary search finds the tokens that meet each turn span, and what counts for the loss is the
intersection. So a token over the border of a turn trains nothing outside it, and no character counts twice.

Template: a turn is [INST]role[/INST]text</s>. Control strings inside roles and texts are broken by a backslash after
their first character, and backslashes are doubled before, so both are read back exactly.

Turns are sorted by Spark and streamed. What a task renders is encoded from SEGMENT_CHARS characters on, up to the last space behind
a visible ASCII character, where the pre-tokenizer has a boundary in any case and no escape is open: ids, offsets and masks of the
segments, one behind the other, are those of the whole conversation encoded once, and one of any length needs the memory of its
longest text. (A conversation's digest is one sequence, so all its turns pass through one task.)
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table
from .tokens import vocabulary

CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>")
SEGMENT_CHARS = 2_000_000
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
#: The last of these in a text, as it is read from the end.
_CUT = re.compile(r" [!-~]")
_OUT = pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("in_loss", pa.list_(pa.bool_())), ("loss_spans", pa.list_(pa.list_(pa.int32())))])


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the span of each assistant text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"[INST]{escape(role)}[/INST]", escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(head + body + "</s>")
        at += len(parts[-1])
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


def mask(turns: list[tuple[int, int]], tokens: list[tuple[int, int]]) -> tuple[list[bool], list[list[int]]]:
    """Which tokens meet a turn span, and the merged intersections. Both lists are sorted; tokens of one character overlap."""
    starts, ends = [t[0] for t in tokens], [t[1] for t in tokens]
    hit, spans = [False] * len(tokens), []
    for start, end in turns:
        covered = start
        own: list[list[int]] = []
        for k in range(bisect_right(ends, start), bisect_left(starts, end)):
            a, b = max(tokens[k][0], covered), min(tokens[k][1], end)
            hit[k] = True
            if b <= a:
                continue
            if own and own[-1][1] == a:
                own[-1][1] = b
            else:
                own.append([a, b])
            covered = b
        spans += own
    return hit, spans


class _Rendering:
    """One conversation: what is rendered and not encoded yet, and the spans in it."""

    def __init__(self, conv: int | None, model):
        self.conv, self.model, self.segment, self.parts, self.spans, self.size = conv, model, 0, [], [], 0

    def add(self, role: str, text: str) -> None:
        formatted, spans = render([(role, text)])
        self.spans += [(a + self.size, b + self.size) for a, b in spans]
        self.parts.append(formatted)
        self.size += len(formatted)

    def row(self, text: str, spans: list[tuple[int, int]]) -> list:
        encoded = self.model.encode(text, add_special_tokens=False)
        self.segment += 1
        return [self.conv, self.segment - 1, text, encoded.ids, *mask(spans, encoded.offsets)]

    def cut(self) -> list | None:
        """All up to the last place where a cut changes nothing; None if there is none."""
        text = "".join(self.parts)
        self.parts = [text]
        found = _CUT.search(text[::-1])
        at = len(text) - found.start() - 1 if found else 0
        if not at:
            return None
        before, after = [(a, min(b, at)) for a, b in self.spans if a < at], [(max(a, at) - at, b - at) for a, b in self.spans if b > at]
        self.parts, self.spans, self.size = [text[at:]], after, len(text) - at
        return self.row(text[:at], before)

    def rest(self) -> list:
        return self.row("".join(self.parts), self.spans)


def _format(tokenizer: str, segment_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(vocabulary(tokenizer))
        model.encode_special_tokens = True
        now, open_, out, limit = None, None, [], segment_chars

        def full() -> Iterator[pa.RecordBatch]:
            if len(out) >= 64 or out and len(out[-1][2]) >= segment_chars // 2:
                yield table()
                out.clear()

        def table() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT.types, strict=True)], schema=_OUT)

        for batch in batches:
            for conv, alone, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv, alone) or conv is None:
                    if open_:
                        out.append(open_.rest())
                        yield from full()
                    now, open_, limit = (conv, alone), _Rendering(conv, model), segment_chars
                open_.add(role, text)
                if open_.size > limit:
                    # where nothing can be cut, it is tried again at twice the length
                    got = open_.cut()
                    limit = segment_chars if got else 2 * open_.size
                    if got:
                        out.append(got)
                        yield from full()
        if open_:
            out.append(open_.rest())
        if out:
            yield table()

    return rows


def format_conversations(rows: DataFrame, tokenizer: str = "byte_bpe_50k.json", segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """(conv_id, segment, formatted, ids, in_loss, loss_spans), a row per conversation or segment of one, sorted in each partition.
    Segments joined in their order are the conversation encoded once.

    Turns are ordered by turn, and ties by role and text; repeated rows stay. Null turns come first, null texts and roles
    are empty. Rows with a null conv_id belong to no conversation: each is one of its own, so they are dealt out. Long texts are
    encoded whole. Other columns are ignored. An empty table gives no rows."""
    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    clean = clean.withColumn("alone", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")))
    ordered = clean.repartition("conv_id", "alone").sortWithinPartitions("conv_id", "alone", "turn", "role", "text").select("conv_id", "alone", "role", "text")
    return ordered.mapInArrow(_format(tokenizer, segment_chars), "conv_id long, segment int, formatted string, ids array<int>, in_loss array<boolean>, loss_spans array<array<int>>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the output alone: what the turns and the text under the mask are."""
    state, left = None, ""
    out: list[tuple] = []

    def finish() -> None:
        out.append((state[5], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        for conv, segment, formatted, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not segment:
                if state:
                    finish()
                state, left = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, conv], ""
            # a turn may end in a later segment
            text = left + formatted
            turns = text.rfind("</s>") + 4 if "</s>" in text else 0
            for role, said in parse(text[:turns]):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            left = text[turns:]
            for start, end in spans:
                said = unescape(formatted[start:end])
                state[2] += len(said)
                state[3].update(said.encode("utf-8", "surrogatepass"))
            state[4] += len(formatted)
        if len(out) > 1:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out = []
    if state:
        finish()
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    formatted = format_conversations(rows).select("conv_id", "segment", "formatted", "loss_spans")
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
