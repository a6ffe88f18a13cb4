"""Suffix-array dedup by prefix-free parsing: removes every byte that a long repeated string covers.

A rolling hash picks triggers: of every 128 neighbouring starts, the one whose 16 bytes hash least. The choice depends on these bytes alone, so equal strings
have equal triggers at equal places. Triggers cut a text into phrases: the starts that share a trigger. The corpus order of suffixes then follows from two
smaller ones: a suffix is the end of its phrase, down to the trigger, and what follows from the trigger on.

First the parse is sorted by fingerprints of what follows a trigger. Phrases with no neighbour there are unique and go no further; those that are equal with all
that their strings span repeat as a whole, by 128 bits. What is left are phrases at the ends of repeats, a small part of any text. Their bytes meet by what
follows the trigger, and in each task the suffix array of the dictionary (phrases in order of their ends, so that those that share a suffix are
neighbours, with the length that they share) and that of the parse (what follows from the trigger on, with common prefixes) combine: suffixes as far from their
trigger are equal to the full length where both arrays say that their parts are. These are compared on bytes.

Where more than `crowd` ends have one and the same continuation (a footer under many unlike texts), they would be one task's suffix arrays however many they are.
These alone are taken apart: each of their strings goes by its own 122 bits to a part of the order, and of those that are equal within a slice one goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, SpanHash, give_back, mix, save, text_slices

LENGTH = 400
TRIGGER, REACH = 16, 128
#: Parse entries that a task sorts at once, and phrases whose suffix arrays it builds.
ENTRIES_A_TASK, PHRASES_A_TASK = 2_000_000, 40_000
#: Ends with one continuation that still meet in one task's suffix arrays, at most 527 bytes of text each.
CROWD = 8_000


def phrases(data: np.ndarray, starts: np.ndarray, length: int, h: SpanHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts of whole strings that share a trigger: first, last, and the trigger, by document and place."""
    reach = min(REACH, length // 3)
    width = min(TRIGGER, length // 3)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none
    bits = U64(31)  # places up to 2 GB; the same for all texts, so that ties fall alike
    near = (h.width(width) >> bits << bits) | np.arange(len(data) - width + 1, dtype=np.uint64)
    span = 1
    while span < reach:
        step = min(span, reach - span)
        near = np.minimum(near[:-step], near[step:])
        span += step
    trigger = (near & U64((1 << int(bits)) - 1)).astype(np.int64)
    marks = np.zeros(len(data) + 2, np.int8)
    whole = np.flatnonzero(np.diff(starts) >= length)
    np.add.at(marks, starts[whole], 1)
    np.add.at(marks, starts[whole + 1] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(marks)[: len(data)])
    if not len(at):
        return none, none, none
    new = np.concatenate([[True], (np.diff(at) != 1) | (trigger[at[1:]] != trigger[at[:-1]]) | np.isin(at[1:], starts)])
    first = at[new]
    return first, at[np.concatenate([new[1:], [True]])], trigger[first]


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> U64(40)) % U64(parts)).astype(np.int64)


def _send(part: np.ndarray, columns: dict[str, np.ndarray], extra: dict[str, np.ndarray] | None = None) -> dict[str, pa.Array]:
    """Rows as one message for each part; extra goes with the first."""
    order = np.argsort(part, kind="stable")
    used, cut = np.unique(part[order], return_index=True)
    cut = [*cut.tolist(), len(order)]
    out = {"part": pa.array(used, pa.int32())}
    for name, v in columns.items():
        v = v[order]
        out[name] = pa.array([v[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
    for name, v in (extra or {}).items():
        out[name] = pa.array([v.tobytes() if k == 0 else b"" for k in range(len(used))], pa.binary())
    return out


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys, and where in it a new value begins."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new


def _parse(parts: int, length: int):
    """Parse entries: what follows the trigger, the whole stretch of the phrase's strings, and whose it is. Of entries equal within a slice
    one goes on, and the others are known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, starts in text_slices(batches):
            h = SpanHash(data)
            first, last, trigger = phrases(data, starts, length, h)
            if not len(first):
                continue
            after = h(trigger, trigger + (length - min(REACH, length // 3)))
            stretch = mix(h(first, last + length) + (trigger - first).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
            doc = np.searchsorted(starts, first, "right") - 1
            entry = {"after": after, "stretch": stretch, "did": np.asarray(rows.column("did"))[doc], "doc": np.asarray(rows.column("uid"))[doc], "at": (first - starts[doc]).astype(np.int64), "n": (last - first + 1).astype(np.int32)}
            order = np.lexsort((stretch, after))
            new = np.concatenate([[True], (after[order][1:] != after[order][:-1]) | (stretch[order][1:] != stretch[order][:-1])])
            size = np.diff(np.append(np.flatnonzero(new), len(order)))
            kept, rest = order[new], order[~new]
            entry = {k: v[kept] for k, v in entry.items()} | {"twice": (size > 1).astype(np.int8)} | {f"r_{k}": entry[k][rest] for k in ("did", "doc", "at", "n")}
            yield pa.RecordBatch.from_pydict(_send(_part(entry["after"], parts), {k: v for k, v in entry.items() if k[:2] != "r_"}, {k: v for k, v in entry.items() if k[:2] == "r_"}))

    return run


_ENTRY = {"after": np.uint64, "stretch": np.uint64, "did": np.int64, "doc": np.int64, "at": np.int64, "n": np.int32, "twice": np.int8}
_PARSE_SCHEMA = "part int, " + ", ".join(f"{k} binary" for k in (*_ENTRY, "r_did", "r_doc", "r_at", "r_n"))


def _unpack(group: pd.DataFrame, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(b"".join(group[k]), t) for k, t in kinds.items()}


def _sort_parse(crowd: int):
    """whole: the phrase's strings all repeat; else they may. crowded: too many that may have its continuation."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        e = _unpack(group, _ENTRY)
        r = _unpack(group, {"r_did": np.int64, "r_doc": np.int64, "r_at": np.int64, "r_n": np.int32})
        order, new = _runs(e["after"], e["stretch"])
        e = {k: v[order] for k, v in e.items()}
        new_after = np.concatenate([[True], e["after"][1:] != e["after"][:-1]])[: len(order)]
        runs = np.cumsum(new) - 1
        of = np.cumsum(new_after) - 1
        if len(runs):
            whole = (np.bincount(runs)[runs] > 1) | (np.bincount(runs, e["twice"])[runs] > 0)
            shared = (np.bincount(of)[of] > 1) | whole
            again = whole & new & (np.bincount(of, shared & ~whole)[of] > 0)  # one of each repeat stands beside the ends that may hold parts of it
            crowded = np.bincount(of, (shared & ~whole) | again)[of] > crowd
        else:
            whole = shared = again = crowded = np.zeros(0, bool)
        pick = lambda k: np.concatenate([e[k][shared], e[k][again], r[f"r_{k}"]])
        known = len(r["r_doc"])
        return pd.DataFrame(
            {"did": pick("did"), "uid": pick("doc"), "at": pick("at"), "n": pick("n")}
            | {"whole": np.concatenate([whole[shared], np.zeros(int(again.sum()), bool), np.ones(known, bool)])}
            | {"crowded": np.concatenate([crowded[shared], crowded[again], np.zeros(known, bool)])}
        )

    return run


_SPAN = {"did": np.int64, "uid": np.int64, "at": np.int64, "n": np.int32, "t": np.int32, "bytes": np.uint8}
_START = {"did": np.int64, "uid": np.int64, "at": np.int64, "n": np.int32, "key": np.uint64, "check": np.uint64, "twice": np.int8}
_ENDS_SCHEMA = "part int, " + ", ".join(f"{k} binary" for k in dict.fromkeys((*_SPAN, *_START)))


def _message(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """With columns of the other kind empty."""
    none = pa.array([b""] * len(columns["part"]), pa.binary())
    return pa.RecordBatch.from_pydict({"part": columns["part"]} | {k: columns.get(k, none) for k in dict.fromkeys((*_SPAN, *_START))})


def _ends(parts: int, apart: int, length: int):
    """Phrases at the ends of repeats, with the bytes that their strings span, as one message for each of `parts` parts of the order of what follows
    their triggers. Crowded ones go string by string, to `apart` parts more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, starts in text_slices(batches):
            h = SpanHash(data)
            first, last, trigger = phrases(data, starts, length, h)
            at = rows.column("ats")
            doc = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(at.offsets)))
            crowded = rows.column("crowds").flatten().to_numpy(zero_copy_only=False)
            k = np.searchsorted(first, starts[doc] + at.flatten().to_numpy())
            did, uid = np.asarray(rows.column("did")), np.asarray(rows.column("uid"))
            if crowded.any():
                yield _message(_strings(data, h, first[k[crowded]], last[k[crowded]], doc[crowded], starts, did, uid, parts, apart, length))
            k, doc = k[~crowded], doc[~crowded]
            if not len(k):
                continue
            part = _part(h(trigger[k], trigger[k] + (length - min(REACH, length // 3))), parts)
            order = np.argsort(part, kind="stable")
            k, doc, part = k[order], doc[order], part[order]
            spans = np.empty(len(k), object)
            spans[:] = [data[a:b].tobytes() for a, b in zip(first[k].tolist(), (last[k] + length).tolist(), strict=True)]
            columns = {"did": did[doc], "uid": uid[doc], "at": first[k] - starts[doc], "n": (last - first + 1)[k].astype(np.int32), "t": (trigger - first)[k].astype(np.int32)}
            cut = np.searchsorted(part, np.unique(part)).tolist()
            joined = pa.array([b"".join(spans[a:b]) for a, b in zip(cut, [*cut[1:], len(k)])], pa.binary())
            yield _message(_send(part, columns) | {"bytes": joined})

    return run


def _strings(data: np.ndarray, h: SpanHash, first: np.ndarray, last: np.ndarray, doc: np.ndarray, starts: np.ndarray, did: np.ndarray, uid: np.ndarray, parts: int, apart: int, length: int) -> dict[str, pa.Array]:
    """Each string of the phrases by its hashes. Of those that are equal within the slice one goes on with the mark that it repeats; the others are known to
    repeat and need no meeting, so they go as runs of starts wherever their text's name says."""
    n = last - first + 1
    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    doc = np.repeat(doc, n)
    key, check = h(at, at + length), SpanHash(data, 3)(at, at + length)
    order, new = _runs(key, check)
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    one, known = order[new], order[~new]
    known = known[np.argsort(at[known], kind="stable")]
    begins = np.ones(len(known), bool)
    begins[1:] = (at[known][1:] != at[known][:-1] + 1) | (doc[known][1:] != doc[known][:-1])
    long = np.diff(np.append(np.flatnonzero(begins), len(known)))
    known = known[begins]
    both = np.concatenate([one, known])
    part = parts + np.concatenate([_part(key[one], apart), _part(mix(uid[doc[known]].view(np.uint64)), apart)])
    columns = {"did": did[doc[both]], "uid": uid[doc[both]], "at": at[both] - starts[doc[both]], "n": np.concatenate([np.ones(len(one), np.int64), long]).astype(np.int32)}
    return _send(part, columns | {"key": key[both], "check": check[both], "twice": np.concatenate([size > 1, np.ones(len(known), bool)]).astype(np.int8)})


def _rows_of(data: np.ndarray, begin: np.ndarray, step: int, size: np.ndarray, width: int) -> np.ndarray:
    """A row of `width` bytes for each begin: data at begin, begin + step and so on, `size` of them, then zeros."""
    out = np.zeros((len(begin), width), np.uint8)
    along = np.arange(width)
    for lo in range(0, len(begin), 4_000):
        inside = along < size[lo : lo + 4_000, None]
        at = np.where(inside, begin[lo : lo + 4_000, None] + step * along, 0)
        out[lo : lo + 4_000] = np.where(inside, data[at], 0)
    return out


def suffix_array(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes (a shorter one before those that it begins), and how many bytes each has in common with the one before it."""
    _, rank = np.unique(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((size, rank))
    common = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 4_000):
        differ = rows[order[lo : lo + 4_000]] != rows[order[lo - 1 : lo + 3_999][: len(order[lo : lo + 4_000])]]
        common[lo : lo + 4_000] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    common[1:] = np.minimum(common[1:], np.minimum(size[order[1:]], size[order[:-1]]))
    return order, common


def combine(data: np.ndarray, n: np.ndarray, t: np.ndarray, length: int) -> np.ndarray:
    """Which starts repeat, by phrase and distance before the trigger. data: the bytes that each phrase's n strings span, end to end; t: where triggers are.

    A start `d` bytes before its trigger stands in the dictionary's order with those whose phrases share d bytes there, and in the parse's order with
    those whose next `length` - d bytes are the same; its string repeats if another start is with it in both."""
    reach = min(REACH, length // 3)
    begin = np.concatenate([[0], np.cumsum(n + length - 1)[:-1]]) + t
    after, nearest = n + length - 1 - t, t - n + 1
    dictionary, shared = suffix_array(_rows_of(data, begin - 1, -1, t, reach), t)
    parse, common = suffix_array(_rows_of(data, begin, 1, after, length), after)
    repeats = np.zeros((len(n), reach), bool)
    left, right = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
    for d in range(reach):
        some = np.flatnonzero((nearest <= d) & (d <= t))
        if len(some) > 1:
            left[dictionary] = np.cumsum(shared < d)
            right[parse] = np.cumsum(common < length - d)
            _, which, count = np.unique(left[some] * (len(n) + 1) + right[some], return_inverse=True, return_counts=True)
            repeats[some, d] = count[which] > 1
    return repeats


def _sort_ends(parts: int, length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        if group["part"].iloc[0] >= parts:
            e = _unpack(group, _START)
            order, new = _runs(e["key"], e["check"])
            of = np.cumsum(new) - 1
            gone = order[(np.bincount(of)[of] > 1) | (e["twice"][order] > 0)]
            give_back()
            return pd.DataFrame({k: e[k][gone] for k in ("did", "uid", "at", "n")})
        e = _unpack(group, _SPAN)
        n, t = e["n"].astype(np.int64), e["t"].astype(np.int64)
        k, d = np.nonzero(combine(e["bytes"], n, t, length))
        place = e["at"][k] + t[k] - d
        order = np.lexsort((place, k))
        k, place = k[order], place[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (place[1:] != place[:-1] + 1)])[: len(k)]
        begin = np.flatnonzero(new)
        give_back()
        return pd.DataFrame({"did": e["did"][k[begin]], "uid": e["uid"][k[begin]], "at": place[begin], "n": np.diff(np.append(begin, len(k))).astype(np.int32)})

    return run


def _cut(length: int):
    """The bytes left of each text, and what went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, starts in text_slices(batches):
            at, n = rows.column("ats"), rows.column("ns")
            off = np.concatenate([[0], np.cumsum(np.diff(np.asarray(at.offsets)))])
            at, n = at.flatten().to_numpy(), n.flatten().to_numpy()
            sizes, removed, spans, kept = np.diff(starts), [], [], []
            for k in range(rows.num_rows):
                text = data[starts[k] : starts[k + 1]]
                if off[k] == off[k + 1]:
                    removed.append(0)
                    spans.append(0)
                    kept.append(text.tobytes())
                    continue
                marks = np.zeros(len(text) + 1, np.int64)
                lo, hi = at[off[k] : off[k + 1]], at[off[k] : off[k + 1]] + n[off[k] : off[k + 1]] - 1 + length
                np.add.at(marks, lo, 1)
                np.add.at(marks, hi, -1)
                gone = np.cumsum(marks)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """Each row's doc_id, n_bytes, n_removed, n_spans and kept (binary: what is left may end inside a character).

    A byte goes if a string of `length` bytes that covers it starts anywhere else too, in any row or the same one; strings are judged on the
    input. A null text is empty, and texts shorter than `length` stay whole. Rows that repeat a doc_id are texts of their own, so equal rows repeat each
    other. Other columns are not read. crowd: more ends of repeats with one continuation than this are dealt out string by string; no result depends on it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a row goes by both, so texts of one doc_id alone could share a name
    docs = docs.withColumn("did", F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn("uid", F.xxhash64("doc_id", "text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(16, -(-total // 60 // ENTRIES_A_TASK))
    entries = docs.mapInArrow(_parse(parts, length), _PARSE_SCHEMA).groupBy("part")
    spans = save(entries.applyInPandas(_sort_parse(crowd), "did long, uid long, at long, n int, whole boolean, crowded boolean"), "phrases")
    ends = spans.where("not whole")
    calm, strings = ends.agg(F.count_if(~F.col("crowded")), F.coalesce(F.sum(F.when(F.col("crowded"), F.col("n"))), F.lit(0))).first()
    parts, apart = max(16, -(-calm // PHRASES_A_TASK)), max(1, -(-strings // ENTRIES_A_TASK))
    found = ends.distinct().groupBy("did", "uid").agg(F.collect_list(F.struct("at", "crowded")).alias("s"))
    texts = docs.select("did", "uid", "text").join(found.select("did", "uid", F.col("s.at").alias("ats"), F.col("s.crowded").alias("crowds")), ["did", "uid"])
    messages = texts.mapInArrow(_ends(parts, apart, length), _ENDS_SCHEMA)
    single = messages.groupBy("part").applyInPandas(_sort_ends(parts, length), "did long, uid long, at long, n int")
    once = lambda rows: rows.groupBy("did", "uid").agg(F.collect_list(F.struct("at", "n")).alias("s")).select("did", "uid", F.col("s.at").alias("ats"), F.col("s.n").alias("ns"))
    gone = save(spans.where("whole").select("did", "uid", "at", "n").union(single), "repeats")
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    whole = docs.join(once(gone), ["did", "uid"], "left").select("doc_id", "text", empty("ats", "bigint"), empty("ns", "int"))
    return whole.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """remove_repeats over all documents; nulls, empties and repeated rows as there."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
