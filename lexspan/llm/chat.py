"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the sorted spans of its turns are intersected with the
sorted token spans by binary search: the tokens that touch an assistant's text are under the loss mask.

Template: `<|im_start|>role<|im_sep|>text<|im_end|>\\n` for each turn. The three marks are added to the tokenizer as special tokens (with the next free
ids), so a token ends where a text begins and where it ends: the masked tokens hold the assistant's texts and nothing else, which is
checked. Inside roles and texts `<`, any number of backslashes and `|` get one backslash more, so no control string remains and
the escape can be undone.

Turns are ordered by turn, then role and text, nulls first. Cases: a null text or role is the empty one; rows without conv_id
take no part; repeated rows are repeated turns; an empty table gives no rows; other columns are ignored. A conversation is held whole by the
task that renders it, one at a time, as its one encoding needs.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.common import arrow, as_batch, partitions, whole_groups

# The template's marks.
START, HEAD, END, SPEAKER = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "assistant"
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(HEAD) + "(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "<" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and where each turn's text stands in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{HEAD}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each span the range of tokens that touch it; offsets and spans are sorted. An empty span has none."""
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    out = []
    for a, b in spans:
        low, high = bisect_right(ends, a), bisect_left(starts, b)
        out.append((low, max(low, high)) if b > a else (low, low))
    return out


def under_mask(formatted: str, offsets: list[tuple[int, int]], ranges: list[tuple[int, int]]) -> list[str]:
    """The text of each range of masked tokens, whole. Tokens of one character's bytes share its offsets; it counts once."""
    out = []
    for low, high in ranges:
        parts, done = [], 0
        for x, y in offsets[low:high]:
            if y > done:
                parts.append(formatted[max(x, done) : y])
                done = y
        out.append("".join(parts))
    return out


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    made = Tokenizer.from_file(path)
    made.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, HEAD, END)])
    return made


FIELDS = "conv_id long, formatted string, ids array<int>, loss array<boolean>, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def format_conversation(turns: list[tuple[str, str]], path: str) -> tuple:
    """(formatted, ids, loss, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), the digests read back from what is
    formatted and masked."""
    formatted, spans = render(turns)
    coded = _tokenizer(path).encode(formatted, add_special_tokens=False)
    own = [s for s, (role, _) in zip(spans, turns, strict=True) if role == SPEAKER]
    offsets = coded.offsets
    ranges = mask(offsets, own)
    loss = [False] * len(offsets)
    for low, high in ranges:
        loss[low:high] = [True] * (high - low)
    back = parse(formatted)
    covered = under_mask(formatted, offsets, ranges)
    if covered != [formatted[a:b] for a, b in own]:
        raise ValueError("the tokenizer's tokens do not end where the turns do")
    covered = [unescape(x) for x in covered]
    said = "".join(f"{role}\n{text}\n" for role, text in back)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return formatted, coded.ids, loss, len(back), sha(said), sum(map(len, covered)), sha("".join(covered)), len(formatted)


def format_chats(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """One row a conversation, as FIELDS says. `path`: a tokenizer file that every worker has."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        file = path or public_tokenizers.path("byte_bpe_50k.json")
        for conv, role, text in whole_groups(batches):
            edges = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
            rows, size = [], 0
            for a, b in zip(edges, edges[1:], strict=False):
                rows.append((int(conv[a]), *format_conversation(list(zip(role[a:b], text[a:b], strict=True)), file)))
                size += rows[-1][-1]
                if size >= 1 << 20 or b == len(conv):
                    yield as_batch(_SCHEMA, *zip(*rows, strict=True))
                    rows, size = [], 0

    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return arrow(dealt.select("conv_id", "role", "text"), task, FIELDS)
