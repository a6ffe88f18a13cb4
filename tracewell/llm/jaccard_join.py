"""N-gram Jaccard join: exact links between documents whose sets of word shingles are alike.

Sets that can link differ in few members, so of enough disjoint parts of their members some are equal and not empty. Documents that share one of their rarest parts
are candidates; each group of candidates becomes a signature tree, whose nodes hold the OR of their sets' bitmaps and their range of sizes, and a traversal
of node pairs prunes those whose largest possible overlap is too small. What is left is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, U64, WHITE, components, find_words, give_back, mix, save, text_slices, word_hashes, word_ids

WORDS = 5
#: Keys that a task compares at once, and distinct sets in a block.
KEYS_A_TASK, BLOCK = 500_000, 4_000
_STEPS = np.random.default_rng(11).integers(1, 2**62, 64, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each document's shingles; a shorter text is one shingle, no word gives none."""
    data = ASCII_LOWER[data]
    begin, end, first = find_words(data, starts)
    ids, distinct = word_ids(data, ~WHITE[data], begin, end)
    word = word_hashes(distinct)[ids]
    n = max(0, len(word) - words + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(words):
        grams += word[k : k + n] * _STEPS[k]
    grams = mix(grams)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(grams[lo : hi - words + 1]))
        elif hi > lo:
            out.append(mix(np.array([(word[lo:hi] * _STEPS[: hi - lo]).sum(dtype=np.uint64) + U64(hi - lo)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _classes(n: int, num: int, den: int) -> list[tuple[int, int]]:
    """The size classes, each twice as wide as the one before, where a set of n members can meet a partner: its own, and the next if that is in reach.
    With each, how many members two linked sets of the class may differ in."""
    j = n.bit_length()
    return [(k, (2**k - 1) * 2 * (den - num) // (den + num)) for k in ([j, j + 1] if n * den >= num * 2**j else [j])]


def part_keys(members: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, int, int]]:
    """Lists of keys, each with its number and how many of its rarest keys hold one that any linked set has as well, if its other keys are in no other set.

    A set and any linked one differ in at most `own` members. Parted alike, of the m parts of the set that are not empty at least m - own are then equal in
    both, and of any own + 1 of its keys one is a key of the partner; both keep such a key if both keep their own + 1 rarest. A set with m <= own lists
    its smallest members too: of these, two sets that both do so share one."""
    n, out = len(members), []
    if not n:
        return out
    own, weak = (n + n * den // num) * (den - num) // (den + num), False
    for j, d in _classes(n, num, den):
        parts = d * 3 // 2 + 2
        part = (mix(members ^ U64(0x9E3779B97F4A7C15 * (j + 1) & (2**64 - 1))) >> U64(16)) % U64(parts)
        order = np.argsort(part, kind="stable")
        part = part[order]
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums = np.add.reduceat(mix(members[order] + U64(j)), edge)
        out.append((mix(sums + part[edge] * _STEPS[40] + _STEPS[j % 40]), j % 2, own + 1 - len(edge)))
        weak |= len(edge) <= own
    if weak:
        out.append((mix(members[: n - (n * num + den - 1) // den + 1] + _STEPS[42]), 2, 1 << 30))
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, starts in text_slices(batches):
        sets = shingle_sets(data, starts)
        n = [len(s) for s in sets]
        a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
        b = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_shingles", "k1", "k2"])


_ROW = {"keys": np.uint64, "docs": np.int64, "list": np.int8, "spare": np.int32}


def _messages(parts: int, num: int, den: int):
    """Keys as one message for each part of their range. Of equal sets in a slice the smallest doc_id speaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, starts in text_slices(batches):
            sets: dict[bytes, tuple[int, np.ndarray]] = {}
            for doc, s in zip(rows.column("doc_id").to_pylist(), shingle_sets(data, starts), strict=True):
                if len(s) and doc <= sets.get(name := s.tobytes(), (doc,))[0]:
                    sets[name] = doc, s
            lists = [(doc, *x) for doc, s in sets.values() for x in part_keys(s, num, den)]
            if not lists:
                continue
            sizes = [len(x[1]) for x in lists]
            row = {"keys": np.concatenate([x[1] for x in lists])} | {k: np.repeat(np.array([x[i] for x in lists], _ROW[k]), sizes) for k, i in (("docs", 0), ("list", 2), ("spare", 3))}
            part = (row["keys"] >> U64(40)) % U64(parts)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            used = [p for p in range(parts) if cut[p] < cut[p + 1]]
            yield pa.RecordBatch.from_pydict({"part": pa.array(used, pa.int32())} | {k: pa.array([v[order[cut[p] : cut[p + 1]]].tobytes() for p in used], pa.binary()) for k, v in row.items()})

    return run


def _meet(group: pd.DataFrame) -> pd.DataFrame:
    """The keys of more than one document, and how many have them."""
    row = {k: np.frombuffer(b"".join(group[k]), t) for k, t in _ROW.items()}
    order = np.argsort(row["keys"], kind="stable")
    new = np.concatenate([[True], row["keys"][order][1:] != row["keys"][order][:-1]])
    size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
    on = order[size > 1]
    give_back()
    return pd.DataFrame({"key": row["keys"][on].view(np.int64), "doc": row["docs"][on], "list": row["list"][on].astype(np.int32), "spare": row["spare"][on], "df": size[size > 1].astype(np.int32)})


def _candidates(docs: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """Links between documents that share one of the rarest keys of both, in the form of stars."""
    messages = docs.mapInArrow(_messages(parts, num, den), "part int, keys binary, docs binary, list binary, spare binary")
    shared = messages.groupBy("part").applyInPandas(_meet, "key long, doc long, list int, spare int, df int")
    own = Window.partitionBy("doc", "list")
    ranked = shared.withColumn("rank", F.row_number().over(own.orderBy("df", "key"))).withColumn("all", F.count("*").over(own))
    kept = save(ranked.where(F.col("rank") <= F.col("spare") + F.col("all")).select("key", "doc"), "rare-keys")
    hubs = kept.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("far")).where("hub <> far").select("key", "hub")
    return kept.join(hubs, "key").where("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct()


class _Tree:
    """Bulk-loaded signature tree: sets ordered by size and smallest member, leaves of 16, inner nodes of 8."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, excess: np.ndarray):
        edges = np.arange(0, len(sizes), 16)
        self.levels = [(edges, np.append(edges[1:], len(sizes)), np.bitwise_or.reduceat(bits, edges), np.minimum.reduceat(sizes, edges), np.maximum.reduceat(sizes, edges), np.maximum.reduceat(excess, edges))]
        while len(self.levels[-1][0]) > 1:
            lo, hi, up, least, most, over = self.levels[-1]
            edges = np.arange(0, len(lo), 8)
            last = np.append(edges[1:], len(lo)) - 1
            self.levels.append((lo[edges], hi[last], np.bitwise_or.reduceat(up, edges), np.minimum.reduceat(least, edges), np.maximum.reduceat(most, edges), np.maximum.reduceat(over, edges)))


def tree_links(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect just what all links connect. side: if given, links between equal sides are left to others.

    A node pair can't hold a link if its sets' sizes are too far apart, or if its bitmaps have too few bits in common: a common member sets a common bit,
    and a set has at most `excess` more members than bits. Pairs already connected are skipped, so a group of near copies takes few comparisons."""
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((np.array([s[0] for s in sets]), sizes))
    sets, sizes = [sets[i] for i in order], sizes[order]
    side = None if side is None else side[order]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    width = 1 << min(14, max(8, int(sizes[-1] * 4 - 1).bit_length()))
    flags = np.zeros((len(sets), width // 8), np.uint8)
    for i, s in enumerate(sets):
        row = np.zeros(width, bool)
        row[(s >> U64(20)) & U64(width - 1)] = True
        flags[i] = np.packbits(row)
    bits = flags.view(np.uint64)
    excess = sizes - np.bitwise_count(bits).sum(1)
    tree = _Tree(bits, sizes, excess)
    root = np.arange(len(sets))
    member = np.zeros(len(names), bool)
    links = []

    def compare(i: int, lo: int, hi: int) -> None:
        """Set i with sets lo to hi."""
        c = np.arange(lo, hi)
        c = c[(root[lo:hi] != root[i]) & (sizes[lo:hi] * den >= num * sizes[i]) & (sizes[i] * den >= num * sizes[lo:hi])]
        if side is not None:
            c = c[side[c] != side[i]]
        if len(c):
            common = np.bitwise_count(bits[c] & bits[i]).sum(1) + np.minimum(excess[c], excess[i])
            c = c[common * (num + den) >= num * (sizes[c] + sizes[i])]
        if not len(c):
            return
        member[ids[offsets[i] : offsets[i + 1]]] = True
        for j in c.tolist():
            both = int(member[ids[offsets[j] : offsets[j + 1]]].sum())
            if root[j] != root[i] and both * den >= num * (sizes[i] + sizes[j] - both):
                links.append((int(order[i]), int(order[j])))
                root[root == max(root[i], root[j])] = min(root[i], root[j])
        member[ids[offsets[i] : offsets[i + 1]]] = False

    for i in range(len(sets) - 1):
        compare(i + 1, i, i + 1)
    top = len(tree.levels) - 1
    stack = [(top, 0, 0)]
    while stack:
        level, a, b = stack.pop()
        lo, hi, up, least, most, over = tree.levels[level]
        if most[a] * den < num * least[b] or most[b] * den < num * least[a]:
            continue
        if a != b:
            reach = min(int(np.bitwise_count(up[a] & up[b]).sum()) + min(over[a], over[b]), most[a], most[b])
            if reach * (num + den) < num * (least[a] + least[b]):
                continue
        one = root[lo[a]]
        if (root[lo[a] : hi[a]] == one).all() and (root[lo[b] : hi[b]] == one).all():
            continue
        if level == 0:
            for i in range(lo[a], hi[a]):
                compare(i, max(lo[b], i + 1) if a == b else lo[b], hi[b])
            continue
        below = len(tree.levels[level - 1][0])
        left, right = range(8 * a, min(8 * a + 8, below)), range(8 * b, min(8 * b + 8, below))
        stack += [(level - 1, x, y) for x in left for y in right if x <= y]
    return links


def _link_groups(num: int, den: int):
    """One task's groups of candidates: a row for each link kept."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, group in batch.groupby("grp", sort=False):
            sets = shingle_sets(*_joined(group["text"]))
            docs, side = group["doc_id"].to_numpy(), group["side"].to_numpy()
            for i, j in tree_links(sets, num, den, side if side.max() else None):
                a.append(docs[i])
                b.append(docs[j])
        give_back()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def _link_fans(num: int, den: int):
    """Links of a group's hub (side 2) with its other sets."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, group in batch.groupby("grp", sort=False):
            sets, docs, hub = shingle_sets(*_joined(group["text"])), group["doc_id"].to_numpy(), group["side"].to_numpy() == 2
            for h in np.flatnonzero(hub).tolist():
                for i in np.flatnonzero(~hub).tolist():
                    both = int(np.isin(sets[i], sets[h], assume_unique=True).sum())
                    if both * den >= num * (len(sets[i]) + len(sets[h]) - both):
                        a.append(docs[i])
                        b.append(docs[h])
        give_back()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def _joined(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    parts = [x.encode() for x in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def jaccard_components(docs: DataFrame, threshold: tuple[int, int] = (4, 5), block: int = BLOCK) -> DataFrame:
    """Each row's doc_id, n_shingles and component_id: the smallest doc_id that links reach, itself included.

    Two documents link when the Jaccard similarity of their sets of lower-cased 5-word shingles is at least threshold (a fraction of integers).
    A null or empty text, and one without words, has an empty set and links with nothing; so does a row whose doc_id is null (its component_id is null).
    Rows that repeat a doc_id are one node. Of equal sets only the smallest doc_id is compared. Other columns are not read."""
    num, den = threshold
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = save(docs.mapInArrow(_measure, "doc_id long, n_shingles long, k1 long, k2 long"), "sets")
    some = rows.where("doc_id is not null and n_shingles > 0")
    same = some.groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    parts = max(16, -(-total * 6 // 10 // KEYS_A_TASK))

    stars = save(_candidates(docs.where("doc_id is not null"), parts, num, den), "stars")
    near = components(stars)

    reps = some.join(same, ["n_shingles", "k1", "k2"]).where("doc_id = rep").groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    asked = save(reps.join(near.withColumnRenamed("node", "doc_id"), "doc_id"), "candidates")
    groups = asked.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("members")).where("size > 1")
    bins = max(16, -(-(groups.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]) // 1_000_000))
    small = asked.join(groups.where(F.col("size") <= block), "root").select("doc_id", F.col("root").alias("grp"), F.pmod(F.xxhash64("root"), F.lit(bins)).alias("bin"), F.lit(0).alias("side"))
    large, hub_links = asked.join(groups.where(F.col("size") > block).select("root", "size"), "root"), None
    if groups.where(F.col("size") > block).limit(1).count():
        hub_links = _hub_links(docs, large, stars, num, den, block)
        large = large.join(components(hub_links).select(F.col("node").alias("doc_id"), F.col("root").alias("piece")), "doc_id", "left").withColumn("piece", F.coalesce("piece", "doc_id"))
        large = save(large, "contracted")
        small = small.unionByName(_block_pairs(large, num, den, block))
    whole = docs.join(small.hint("merge"), "doc_id")  # of any size: the candidates grow with the documents
    links = save(whole.groupBy("bin").applyInPandas(_link_groups(num, den), "a long, b long"), "verified")
    linked = components(links.union(hub_links) if hub_links is not None else links)

    out = rows.join(same, ["n_shingles", "k1", "k2"], "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")).alias("component_id"))


def _hub_links(docs: DataFrame, large: DataFrame, stars: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Links of the large groups' documents with one hub each, the least: a text is sent once, and a hub's once for each block / 2 documents that have it."""
    known = large.select("doc_id", "n")
    one = stars.join(known.withColumnRenamed("doc_id", "a"), "a").join(known.select(F.col("doc_id").alias("b"), F.col("n").alias("m")), "b")
    one = one.where((F.col("n") * den >= F.col("m") * num) & (F.col("m") * den >= F.col("n") * num)).groupBy("a").agg(F.min("b").alias("b"))
    fans = one.groupBy("b").agg(F.ceil(F.count("*") / max(1, block // 2)).cast("int").alias("slots"))
    one = one.join(fans, "b").select("a", "b", F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("slots"))).alias("grp"))
    one = save(one, "fans")
    bins = max(16, -(-known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 1_000_000))
    sent = one.select(F.col("a").alias("doc_id"), "grp", F.lit(1).alias("side")).union(one.select("b", "grp", F.lit(2)).distinct())
    whole = docs.join(sent.withColumn("bin", F.pmod("grp", F.lit(bins))).hint("merge"), "doc_id")
    return save(whole.groupBy("bin").applyInPandas(_link_fans(num, den), "a long, b long"), "hub-links")


def _block_pairs(large: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Groups beyond one block: sets of about one size share a block, and each two blocks whose sizes are within reach meet as a group of their own.

    A piece, sets that are linked already, of over a quarter of a block has blocks of its own, and no two of these meet; other sets share blocks."""
    tier = F.floor(F.log2("n") * 4).cast("int")
    big = large.groupBy("piece").agg(F.count("*").alias("all")).where(F.col("all") > block // 4).select("piece", F.col("piece").alias("own"))
    large = large.join(big, "piece", "left").withColumn("own", F.coalesce("own", F.lit(-(2**63)))).withColumn("tier", tier)
    counts = large.groupBy("root", "own", "tier").agg(F.count("*").alias("sets"), F.min("n").alias("least"), F.max("n").alias("most"))
    salted = counts.withColumn("slots", F.ceil(F.col("sets") / (block // 2)).cast("int"))
    large = large.join(salted.select("root", "own", "tier", "slots"), ["root", "own", "tier"]).withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.col("slots")))
    blocks = salted.select("root", "own", "tier", "least", "most", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    x, y = (blocks.select("root", *[F.col(c).alias(f"{c}{k}") for c in ("own", "tier", "least", "most", "slot")]) for k in (1, 2))
    pairs = x.join(y, "root").where((F.struct("own1", "tier1", "slot1") <= F.struct("own2", "tier2", "slot2")) & ((F.col("own1") != F.col("own2")) | (F.col("own1") == -(2**63))) & (F.col("most1") * den >= F.col("least2") * num) & (F.col("most2") * den >= F.col("least1") * num))
    pairs = pairs.withColumn("grp", F.xxhash64("root", "own1", "tier1", "slot1", "own2", "tier2", "slot2")).withColumn("self", (F.col("own1") == F.col("own2")) & (F.col("tier1") == F.col("tier2")) & (F.col("slot1") == F.col("slot2")))
    ends = pairs.select("root", "grp", F.col("own1").alias("own"), F.col("tier1").alias("tier"), F.col("slot1").cast("long").alias("slot"), F.when(F.col("self"), 0).otherwise(1).alias("side")).union(
        pairs.where("not self").select("root", "grp", F.col("own2"), F.col("tier2"), F.col("slot2").cast("long"), F.lit(2))
    )
    return large.join(ends, ["root", "own", "tier", "slot"]).select("doc_id", "grp", F.col("grp").alias("bin"), "side")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """jaccard_components over all documents; nulls, empties and repeated rows as there."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
