"""Chat formatting at the level of tokens, with a loss mask, and reading back.

A template of reserved ids marks the turns: every segment of text is encoded by itself and the
reserved ids are spliced between segments, so no text can make a control token. So that the rendered string is
unambiguous too, control strings inside texts are escaped: a backslash goes after their first character,
one more if backslashes stand there already, which ``unescape`` takes back exactly. Places in a conversation and the
loss mask come from prefix sums over segment lengths. The mask covers the texts of assistants.

Conversations are streams: rows are shuffled by conversation, sorted by turn, and assembled turn
by turn, so a conversation of any length passes through a task without being held.

Null text is the empty text and a null role the empty role; any other role is named in the output. Null
conversation ids are one conversation. Equal turns are ordered by role, then text; repeated rows are
repeated turns. An empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcomp.llm import common as C
from haulcomp.llm import vocabulary as V

#: The control strings, in the order of their reserved ids.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>"]
BOS, EOS, USER, USER_END, SYS, SYS_END, ROLE, TEXT, END = range(len(CONTROL))
_BODY = "|".join(re.escape(c[1:]) for c in CONTROL)
_PLAIN = re.compile(rf"([<\[])(\\*)({_BODY})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_BODY})")
ASSISTANT = "assistant"


def escape(text: str) -> str:
    """The text without any control string."""
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def segments(role: str, text: str, first: bool) -> list[tuple[int | str, bool]]:
    """A turn as control numbers and texts, with whether each is learned."""
    start: list[tuple[int | str, bool]] = [(BOS, False)] if first else []
    if role == "user":
        return [*start, (USER, False), (text, False), (USER_END, False)]
    if role == "system":
        return [*start, (SYS, False), (text, False), (SYS_END, False)]
    if role == ASSISTANT:
        return [*start, (text, True), (EOS, False)]
    return [*start, (ROLE, False), (role, False), (TEXT, False), (text, False), (END, False)]


def assemble(bpe: V.ByteBpe, turn: list[tuple[int | str, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of a turn."""
    parts = [np.array([bpe.size + s]) if isinstance(s, int) else np.frombuffer(bpe.pack(escape(s)), bpe.dtype) for s, _ in turn]
    ends = np.cumsum([len(p) for p in parts])
    change = np.zeros(int(ends[-1]) + 1, np.int8)
    learned = np.array([x for _, x in turn], np.int8)
    np.add.at(change, ends - [len(p) for p in parts], learned)
    np.subtract.at(change, ends, learned)
    return np.concatenate(parts).astype(np.int32), np.cumsum(change)[:-1].astype(bool)


def format_chats(rows: DataFrame, vocabulary: str = V.BYTE_BPE) -> DataFrame:
    """One row per turn: conv_id, turn_no, first (its place in the conversation), ids, mask.

    Rows of a conversation stand together and in order within one partition.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = C.fields(f"conv_id {kind}, turn_no bigint, first bigint, ids array<int>, mask array<boolean>")
    narrow = rows.select(
        rows["conv_id"], rows["turn"].alias("turn"), F.coalesce(rows["role"].cast("string"), F.lit("")).alias("role"),
        F.coalesce(rows["text"], F.lit("")).alias("text"),
    )
    sorted_rows = narrow.repartition(C.parts_of(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(it):
        bpe, last, number, place = V.byte_bpe(vocabulary), (None,), 0, 0
        for batch in it:
            for lo in range(0, batch.num_rows, 1000):
                few = batch.slice(lo, 1000)
                out = []
                for conv, role, text in zip(few.column(0).to_pylist(), few.column(2).to_pylist(), few.column(3).to_pylist()):
                    if last != (conv, True):
                        last, number, place = (conv, True), 0, 0
                    ids, mask = assemble(bpe, segments(role, text, number == 0))
                    out.append((number, place, ids, mask))
                    number, place = number + 1, place + len(ids)
                numbers, places, ids, masks = zip(*out)
                yield C.batches(schema, few.column(0), numbers, places, list(ids), list(masks))

    return C.map_arrow(sorted_rows, run, schema)


def read_turns(bpe: V.ByteBpe, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, learned text, rendered length) of each turn in a run of ids."""
    at = np.flatnonzero(ids >= bpe.size)
    marks = ids[at] - bpe.size
    texts = [bpe.text(x) for x in np.split(ids, at)[:1] + [p[1:] for p in np.split(ids, at)[1:]]]
    shown = sum(map(len, texts)) + sum(len(CONTROL[m]) for m in marks)
    bounds = [0, *(at + 1)]
    learned = [bpe.text(ids[lo:hi][mask[lo:hi]]) for lo, hi in zip(bounds, [*at, len(ids)])]
    role = ""
    for m, text, taught in zip(marks, texts, learned):
        done = {USER_END: "user", SYS_END: "system", EOS: ASSISTANT, END: role}
        if m == TEXT:
            role = unescape(text)
        elif m in done:
            yield done[m], unescape(text), unescape(taught), shown
            shown = 0


def digests(turns: DataFrame, vocabulary: str = V.BYTE_BPE) -> DataFrame:
    """What each conversation says, read back from its ids and masks; rows must come in the order of ``format_chats``."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = C.fields(f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")

    def run(it):
        bpe, last, state, done = V.byte_bpe(vocabulary), (None,), None, []

        def close():
            if state:
                done.append((last[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in it:
            for i in range(batch.num_rows):
                conv = batch.column(0)[i].as_py()
                if last != (conv, True):
                    close()
                    last, state = (conv, True), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = batch.column(3)[i].values.to_numpy()
                mask = batch.column(4)[i].values.to_numpy(zero_copy_only=False)
                for role, text, learned, shown in read_turns(bpe, ids, mask):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                    state[4] += shown
            if len(done) > 5000:
                yield C.batches(schema, *zip(*done))
                done = []
        close()
        if done:
            yield C.batches(schema, *zip(*done))

    return C.map_arrow(turns, run, schema)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(said).alias("text"),
    )
    return digests(format_chats(rows.unionByName(more)))
