"""Chat formatting in budgeted windows.

Prefix sums of turn tokens choose which turns a window adds: turn-aligned spans of about half the budget. Each window starts with the system turn, then repeats a
limited stretch of the history before its span; the loss covers the assistant turns that it adds, and nothing that it repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Tokens of a window, and what a turn's marks count. New turns start within half of a window; history and system turn have a quarter each.
BUDGET, MARKS = 2048, 4
OPEN, CLOSE = "<s>", "</s>"
#: Control strings of chat templates in use, which no text may hold as they are: fixed values.
CONTROL = re.compile(r"<(?=/?s>|</?SYS>>|\|)|\[(?=/?INST\])")
_BACK = {"\\": "\\", "l": "<", "b": "[", "n": "\n", "0": ""}


def escape(text: str) -> str:
    """No control string is left; unescape() gives the text back."""
    return CONTROL.sub(lambda m: "\\l" if m[0] == "<" else "\\b", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def turn(role: str | None, text: str) -> tuple[str, int]:
    """A turn in the template, and where its text starts."""
    head = OPEN + (r"\0" if role is None else escape(role).replace("\n", r"\n")) + "\n"
    return head + escape(text) + CLOSE, len(head)


def parse(formatted: str) -> list[tuple[str | None, str, int, int]]:
    """Role, text, and where the escaped text starts and ends, of each turn."""
    out, at = [], 0
    while at < len(formatted):
        line, stop = formatted.index("\n", at), formatted.index(CLOSE, at)
        role = formatted[at + len(OPEN) : line]
        out.append((None if role == r"\0" else unescape(role), unescape(formatted[line + 1 : stop]), line + 1, stop))
        at = stop + len(CLOSE)
    return out


def _count(tokenizer: str):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for a in texts:
            yield pa.array([len(e.ids) for e in t.encode_batch(a.to_pylist(), add_special_tokens=False)], pa.int64())

    return F.arrow_udf(run, "long")


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens and turns of the conversation before each turn, within the partition."""
    conv, tokens, turns, pid = object(), 0, 0, TaskContext.get().partitionId()
    for rows in batches:
        before, pos = [], []
        for c, n in zip(rows["conv"].tolist(), rows["n"].tolist(), strict=True):
            if c != conv:
                conv, tokens, turns = c, 0, 0
            before.append(tokens)
            pos.append(turns)
            tokens += n
            turns += 1
        yield rows.assign(before=before, pos=pos, pid=pid)


def _format(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for conv, window, turns in zip(rows["conv"], rows["win"], rows["turns"], strict=True):
            text, loss, repeated = "", [], 0
            for t in turns:
                said, head = turn(t["role"], t["text"])
                if t["kind"] < 2:
                    repeated += 1
                elif t["role"] == "assistant":
                    loss.append({"start": len(text) + head, "end": len(text) + len(said) - len(CLOSE)})
                text += said
            out.append((conv, window, text, len(turns), repeated, loss))
        yield pd.DataFrame(out, columns=["conv", "window", "formatted", "n_turns", "n_repeated", "loss"])


def chat_windows(conversations: DataFrame, budget: int = BUDGET, tokenizer: str | None = None) -> DataFrame:
    """conv_id, window, formatted, n_turns, n_repeated (how many turns at its start are repeated) and loss: spans (start, end; code points) of formatted.

    Turns go by `turn`, then role and text; null texts are empty and null roles and ids stay apart from all others. A turn is never cut: a window is over
    budget only by its last turn. The first turn is the system turn if that is its role; over a quarter of the budget it is not repeated. Rows that repeat are
    turns of their own. A conversation may be of any length: it is dealt by ranges of turns, whose totals meet by prefix sums. Other columns are not read."""
    import public_tokenizers

    step, quarter = budget // 2, budget // 4
    rows = conversations.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = save(rows.withColumn("n", _count(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))("text") + MARKS), "turns")
    keys = ["conv", "turn", "role", F.xxhash64("text"), "text"]
    dealt = rows.repartitionByRange(*keys[:4]).sortWithinPartitions(*keys)
    dealt = save(dealt.mapInPandas(_running, "conv string, turn long, role string, text string, n long, before long, pos long, pid int"), "running")
    totals = dealt.groupBy("conv", "pid").agg(F.sum("n").alias("n"), F.count("*").alias("turns"))
    earlier = Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "pid", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("t0"))
    turns = dealt.join(totals, ["conv", "pid"]).select("conv", "role", "text", "n", (F.col("before") + F.col("n0")).alias("before"), (F.col("pos") + F.col("t0")).alias("pos"))
    turns = turns.withColumn("win", F.floor(F.col("before") / step).cast("long"))
    system = (F.col("pos") == 0) & (F.coalesce("role", F.lit("")) == "system") & (F.col("n") <= quarter)

    new = turns.select("conv", "win", F.lit(2).alias("kind"), "pos", "role", "text")
    history = turns.where(((F.col("win") + 1) * step - F.col("before") <= quarter) & ~system).select("conv", (F.col("win") + 1).alias("win"), F.lit(1).alias("kind"), "pos", "role", "text")
    windows = new.select("conv", "win").distinct()
    first = windows.where("win > 0").join(turns.where(system).select("conv", "role", "text"), "conv").select("conv", "win", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), "role", "text")
    gathered = new.unionByName(history).unionByName(first).groupBy("conv", "win").agg(F.array_sort(F.collect_list(F.struct("kind", "pos", "role", "text"))).alias("turns"))
    gathered = gathered.where(F.element_at("turns", -1)["kind"] == 2)
    out = gathered.mapInPandas(_format, "conv string, window long, formatted string, n_turns int, n_repeated int, loss array<struct<start: int, end: int>>")
    kind = conversations.schema["conv_id"].dataType
    return out.select(F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(kind).alias("conv_id"), "window", "formatted", "n_turns", "n_repeated", "loss")


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams conversations in order of window, holding one window and two hashes at a time."""
    conv, own = None, None

    def done() -> tuple:
        return (conv, own[0], own[1].hexdigest(), own[2], own[3].hexdigest(), own[4])

    for rows in batches:
        out = []
        for c, formatted, repeated, loss in zip(rows["conv_id"], rows["formatted"], rows["n_repeated"], rows["loss"], strict=True):
            if own is None or c != conv and not (pd.isna(c) and pd.isna(conv)):
                if own is not None:
                    out.append(done())
                conv, own = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(formatted)[repeated:]:
                own[0] += 1
                own[1].update(f"{role or ''}\n{text}\n".encode())
            for s in loss:
                said = unescape(formatted[s["start"] : s["end"]])
                own[2] += len(said)
                own[3].update(said.encode())
            own[4] += len(formatted)
        yield pd.DataFrame(out, columns=_DIGEST).astype({"conv_id": "Int64"})
    if own is not None:
        yield pd.DataFrame([done()], columns=_DIGEST).astype({"conv_id": "Int64"})


_DIGEST = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted windows of each conversation say, by digests; needs whole 64-bit ids."""
    rows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInPandas(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_windows(spark, sf_dir: str) -> DataFrame:
    """chat_windows over all conversations and one that says control strings, read back; nulls, ties and repeated rows as there."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return read_back(chat_windows(rows.unionByName(extra)))
