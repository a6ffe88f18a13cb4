"""Quality rules whose cutoffs are chosen under risk control: few good documents of any stratum may be rejected."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, find_words, save, text_slices, word_ids

#: Good documents that all rules together may reject, by stratum; the chance that any bound is wrong; steps of a rule's measure; bad documents that a cutoff
#: must reject for each good one, among the labelled rows that choose it.
ALPHA, DELTA, STEPS, LIFT = 0.05, 0.05, 100, 10
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper", "n_distinct", "n_ends")
_CLASS = {"n_symbols": b"#*$%&|<>", "n_digits": b"0123456789", "n_upper": bytes(range(65, 91)), "n_ends": b".!?"}


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))


def rules() -> dict[str, Column]:
    """Each rule's measure, from 0 to 1; a document is rejected at or above the cutoff."""
    return {
        "symbols": _share("n_symbols", "word_chars"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeats": _share("n_repeat_words", "n_words"),
        "digits": _share("n_digits", "word_chars"),
        "capitals": _share("n_upper", "word_chars"),
        "sameness": 1 - _share("n_distinct", "n_words"),
        "endless": 1 - F.least(F.lit(1.0), 8 * _share("n_ends", "n_words")),
        "long_words": F.least(F.lit(1.0), _share("word_chars", "n_words") / 20),
    }


def measure(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for each text; words are [^\\x20\\x09-\\x0D]+."""
    docs = len(starts) - 1
    begin, end, first = find_words(data, starts)
    of = np.repeat(np.arange(docs), np.diff(first))
    upto = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    out = {"n_words": np.diff(first)}
    points = upto((data & 0xC0) != 0x80)
    out["word_chars"] = np.bincount(of, points[end] - points[begin], docs).astype(np.int64)
    for name, chars in _CLASS.items():
        table = np.zeros(256, bool)
        table[list(chars)] = True
        out[name] = np.diff(upto(table[data])[starts])

    cuts = np.flatnonzero(data == 10)
    line_of = np.concatenate([np.arange(docs), np.searchsorted(starts, cuts, "right") - 1])
    line_start = np.concatenate([starts[:-1], cuts + 1])
    order = np.lexsort((line_start, line_of))
    line_of, line_start = line_of[order], line_start[order]
    line_end = np.concatenate([line_start[1:] - 1, [len(data)]])
    last = np.concatenate([line_of[1:] != line_of[:-1], [True]])
    line_end[last] = starts[line_of[last] + 1]
    out["n_lines"] = np.bincount(line_of, minlength=docs)
    worded = np.searchsorted(begin, line_start) < np.searchsorted(begin, line_end)
    line, kinds = word_ids(data, data != 10, line_start, line_end)
    line_of, own_line = line_of[worded], line_of[worded] * len(kinds) + line[worded]
    distinct = np.unique(own_line, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(line_of, minlength=docs) - np.bincount(line_of[distinct], minlength=docs)

    word, kinds = word_ids(data, ~WHITE[data], begin, end)
    # a number for each word of each text
    _, at, word = np.unique(of * max(1, len(kinds)) + word, return_index=True, return_inverse=True)
    out["n_distinct"] = np.bincount(of[at], minlength=docs)
    n, many = max(0, len(word) - 2), len(at)
    at = np.flatnonzero(of[:n] == of[2 : n + 2])
    two = word[at] * many + word[at + 1]
    if many >= 1 << 20:
        two = np.unique(two, return_inverse=True)[1]
    _, where, size = np.unique(two * many + word[at + 2], return_inverse=True, return_counts=True)
    again = at[size[where] > 1]
    hit = np.zeros(len(word), bool)
    for k in range(3):
        hit[again + k] = True
    out["n_repeat_words"] = np.bincount(of[hit], minlength=docs)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, starts in text_slices(batches):
        out = measure(data, starts)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("lang"), *[pa.array(out[c].astype(np.int64)) for c in _COUNTS]], ["doc_id", "lang", *_COUNTS])


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p): the exact upper bound of a rate, k of n, is at most p just if this is at most the bound's level."""
    i = np.arange(k)
    return float(np.exp(np.concatenate([[0.0], np.cumsum(np.log((n - i) / (i + 1)) + np.log(p / (1 - p)))]) + n * np.log1p(-p)).sum()) if k < n else 1.0


def cutoffs(counts: list[tuple], alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], int]:
    """By stratum and rule, the step from which documents are rejected. counts: (stratum, rule, step, chooses, good, n).

    Rows that choose propose the cutoff with the most bad documents beyond LIFT times the good ones rejected. The held-out rows then test it by a fixed
    sequence, from the laxest cutoff on to the one proposed, as long as the exact bound shows that it rejects at most alpha / (the stratum's
    proposals) of the good; the last one that stands is taken. Over the proposals of all strata and rules the level is Bonferroni's."""
    tables: dict[tuple[str, str], np.ndarray] = {}
    for stratum, rule, step, chooses, good, n in counts:
        tables.setdefault((stratum, rule), np.zeros((2, 2, STEPS + 1), np.int64))[int(chooses), int(good), step] += n
    beyond = {key: t[..., ::-1].cumsum(-1)[..., ::-1] for key, t in tables.items()}  # rejected at each cutoff
    proposed = {}
    for key, t in beyond.items():
        gain = t[1, 0] - LIFT * t[1, 1]
        best = STEPS - int(np.argmax(gain[:0:-1]))  # the laxest of equals; a cutoff of nothing would reject all
        if gain[best] > 0:
            proposed[key] = best
    out = {}
    for key, best in proposed.items():
        rejected, n = beyond[key][0, 1], int(tables[key][0, 1].sum())
        share = alpha / sum(s == key[0] for s, _ in proposed)
        for step in range(STEPS, best - 1, -1):
            if at_most(int(rejected[step]), n, share) > delta / len(proposed):
                break
            out[key] = step
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of each row, base_failed and kept, beside doc_id.

    Strata are languages; null is one of its own. Cutoffs come from the counts of all labelled rows, by
    stratum, rule and step; rows whose label is null take no part, and a stratum with too few labels for any bound rejects nothing but what fails the base.
    A null text has no words. Rows that repeat are judged each."""
    seen = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).mapInArrow(_measure, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in _COUNTS)), "measures")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    step = lambda m: F.greatest(F.lit(0), F.least(F.lit(STEPS), F.floor(m * STEPS))).cast("int")
    seen = seen.withColumn("stratum", F.coalesce("lang", F.lit("?"))).withColumn("base_failed", failed)
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), step(m).alias("step")) for k, m in rules().items()]))
    labelled = seen.where("not base_failed").join(known, "doc_id").select("stratum", "good", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("chooses"), each.alias("r"))
    counts = labelled.groupBy("stratum", "r.rule", "r.step", "chooses", "good").count().select("stratum", "rule", "step", "chooses", "good", "count").collect()  # strata x rules x steps
    chosen = cutoffs([tuple(r) for r in counts])
    hit = [(F.col("stratum") == s) & (step(rules()[r]) >= k) for (s, r), k in sorted(chosen.items())]
    rejected = reduce(lambda a, b: a | b, hit, F.lit(False))
    return seen.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("stratum")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """judge over all documents and labels; nulls, empties, ties and repeated rows as there."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
