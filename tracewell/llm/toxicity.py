"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two strings counts the subsequences of four symbols that they share, each occurrence worth less for every symbol it skips, so an insult keeps most
of its weight with letters put in or left out. A sentence is judged by its worst fragment, a word (also one spelled out letter by letter) or two neighbouring
words, and a text by its two worst sentences. Landmarks are a few fragments of the labelled texts; a string's kernel values to them are its features. The
machine is linear in these, and each kernel value is linear in the string's subsequence counts, so the whole machine is one weight for each of the possible
subsequences: scoring a text is looking these up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Symbols of a subsequence, what a skipped symbol leaves of the weight, the most symbols skipped, landmarks, and labelled texts of each label to learn from
#: (those of least hash, whole), of MAX_CHARS code points together.
LENGTH, DECAY, GAPS, LANDMARKS, SAMPLE, MAX_CHARS = 4, 0.5, 2, 256, 2_500, 8_000_000
#: Distinct clean fragments in the first training (of least hash), rounds in which witnesses and hard clean fragments are named anew, a toxic text's fragments of
#: highest odds, of which one is its witness, and the symbols of a word that is learnt from, at least and at most.
CLEAN_WORDS, ROUNDS, BAG, SHORT, WIDE = 30_000, 5, 20, 3, 40
CODES = 32**LENGTH
PATTERNS = [(a, b, c, DECAY ** (c - 3)) for c in range(3, 6) for b in range(2, c) for a in range(1, b) if c - 3 <= GAPS]


def _symbols() -> np.ndarray:
    """a to z are 1 to 26, other letters share 27 to 30, digits are 31, all else is 0."""
    out = np.zeros(0x3000, np.int32)
    for i in range(len(out)):
        c = chr(i).lower()[:1]
        out[i] = ord(c) - 96 if "a" <= c <= "z" else 31 if c.isdigit() else 27 + ord(c) % 4 if c.isalpha() else 0
    return out


SYMBOLS = _symbols()
_code = np.arange(CODES)
#: Subsequences that count: a zero, which parts words, may be their first or last symbol.
EDGES = ((_code >> 10 & 31) > 0) & ((_code >> 5 & 31) > 0)


def symbols(text: str) -> np.ndarray:
    """The text's symbols, with a zero before and six after."""
    return _symbols_of(_points(text))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _symbols_of(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points) + 7, np.int32)
    out[1 : len(points) + 1] = np.where(points < len(SYMBOLS), SYMBOLS[np.minimum(points, len(SYMBOLS) - 1)], 27 + points % 4)
    return out


_WHITE, _MARKS = np.zeros(128, bool), np.zeros(128, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = _MARKS[[33, 46, 63]] = True


def sentences(points: np.ndarray) -> np.ndarray:
    """Which sentence each symbol of a text is in: one ends with a line, or with a mark before white space."""
    plain = np.minimum(points, 127)
    end = points == 10
    end[:-1] |= _MARKS[plain[:-1]] & _WHITE[plain[1:]]
    number = np.zeros(len(points) + 7, np.int64)
    np.cumsum(end, out=number[1 : len(points) + 1])
    return number


def fragments(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols with what parts lone ones left out, as of a word spelled out with spaces or dots; and the starts and ends of the words."""
    return _split(s, np.zeros(len(s), np.int64))[:3]


def _split(s: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """fragments(), and the sentence of each word."""
    inside = s > 0
    begin = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    end = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    of = sentence[begin]
    if len(begin) < 2:
        return s, begin, end, of
    lone = end - begin == 1
    joins = np.concatenate([[False], lone[1:] & lone[:-1] & (begin[1:] - end[:-1] <= 2)])
    if joins.any():
        gone = np.concatenate([np.arange(a, b) for a, b in zip(end[:-1][joins[1:]], begin[1:][joins[1:]], strict=True)])
        stays = np.ones(len(s), bool)
        stays[gone] = False
        shift = np.cumsum(~stays)
        begin, end = begin - shift[begin], end - shift[end - 1]
        return s[stays], begin[~joins], end[np.concatenate([~joins[1:], [True]])], of[~joins]
    return s, begin, end, of


def _neighbours(begin: np.ndarray, end: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Numbers of the words that stand before another one of their sentence, at most two symbols apart."""
    return np.flatnonzero((sentence[1:] == sentence[:-1]) & (begin[1:] - end[:-1] <= 2))


def positions(s: np.ndarray) -> Iterator[tuple[np.ndarray, int, float]]:
    """For each way to skip symbols: the code of the subsequence that starts at each place, its width, and its weight."""
    n = len(s) - 6
    for a, b, c, weight in PATTERNS:
        yield (s[:n] << 15) | (s[a : n + a] << 10) | (s[b : n + b] << 5) | s[c : n + c], c + 1, weight


def norms(n: np.ndarray) -> np.ndarray:
    """The length of a string of n symbols in the kernel's space if its subsequences are distinct."""
    return np.sqrt(sum(np.maximum(0, n + 2 - c) * w * w for _, _, c, w in PATTERNS) + 1.0)


def local_scores(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(s) - 6, np.float32)
    for code, _, weight in positions(s):
        out += table[code] * np.float32(weight)
    return out


class Model:
    """table: a weight for each subsequence; bias; and the slope and shift that make a text's largest fragment score a probability."""

    def __init__(self, table: np.ndarray, bias: float, calibration: tuple[float, float, float]):
        self.table, self.bias, self.calibration = table, bias, calibration

    def rate(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The text's symbols, and its fragments' starts, ends, scores and sentences."""
        points = _points(text)
        s, begin, end, of = _split(_symbols_of(points), sentences(points))
        two = _neighbours(begin, end, of)
        begin, end, of = np.concatenate([begin, begin[two]]), np.concatenate([end, end[two + 1]]), np.concatenate([of, of[two]])
        sums = np.concatenate([[0.0], np.cumsum(local_scores(s, self.table), dtype=np.float64)])
        return s, begin, end, (sums[end] - sums[begin - 1]) / norms(end - begin) + self.bias, of  # with the zero before

    def margins(self, text: str) -> tuple[float, float]:
        """The scores of the worst sentence, which is its worst fragment's, and of the second worst."""
        *_, f, of = self.rate(text)
        if not len(f):
            return -2.0, -2.0
        worst = int(np.argmax(f))
        rest = f[of != of[worst]]
        return float(f[worst]), float(rest.max()) if len(rest) else -2.0

    def score(self, text: str) -> float:
        a, b = self.margins(text)
        k = self.calibration
        return float(1 / (1 + np.exp(-np.clip(k[0] * np.clip(a, -3, 3) + k[1] * np.clip(b, -3, 3) + k[2], -30, 30))))


def _features(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The kernel of each word with each landmark over the word's norm, and the landmarks' weights by subsequence."""
    join = lambda some: symbols("".join(" " + w + "      " for w in some))
    psi: dict[tuple[int, int], float] = {}
    for j, w in enumerate(landmarks):
        s = symbols(w)
        for code, _, weight in positions(s):
            for c in code[EDGES[code]].tolist():
                psi[(c, j)] = psi.get((c, j), 0.0) + weight
    codes = sorted({c for c, _ in psi})
    row = np.full(CODES, -1, np.int32)
    row[codes] = np.arange(len(codes))
    own = np.zeros((len(codes), len(landmarks)), np.float32)
    for (c, j), v in psi.items():
        own[row[c], j] = v
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for lo in range(0, len(words), 2_000):  # a kilobyte of products for each subsequence of these
        part = words[lo : lo + 2_000]
        s = join(part)
        lengths = np.array([len(w) for w in part])
        of = np.concatenate([[0], np.repeat(np.arange(len(part)), lengths + 7)])[: len(s) - 6]
        # a word's subsequences start in it or at the zero directly before, as those that are scored
        inside = np.concatenate([[False], np.arange(len(of) - 1) - np.repeat(np.cumsum(lengths + 7) - lengths - 7, lengths + 7) <= np.repeat(lengths, lengths + 7)])
        for code, _, weight in positions(s):
            hit = np.flatnonzero((row[code] >= 0) & inside)
            if len(hit):
                first = np.concatenate([[True], of[hit][1:] != of[hit][:-1]])
                out[lo + of[hit][first]] += np.add.reduceat(own[row[code[hit]]], np.flatnonzero(first)) * np.float32(weight)
        out[lo : lo + 2_000] /= norms(lengths)[:, None]
    return out, own, np.array(codes)


def _svm(sides: list[tuple[np.ndarray, float, float]], ridge: float = 0.3) -> np.ndarray:
    """A linear machine with squared hinge loss by Newton's steps; the last value is the bias. sides: rows with the label and the weight that they share."""
    size = sides[0][0].shape[1] + 1
    w = np.zeros(size)
    for _ in range(12):
        left, right = np.diag([*[ridge] * (size - 1), 1e-6]), np.zeros(size)
        for rows, y, weight in sides:
            for lo in range(0, len(rows), 4_000):  # these rows alone are held in full precision
                x = np.hstack([rows[lo : lo + 4_000], np.ones((len(rows[lo : lo + 4_000]), 1))])
                x = x[y * (x @ w) < 1]
                left += weight * (x.T @ x)
                right += weight * y * x.sum(0)
        w = np.linalg.solve(left, right)
    return w


_LETTERS = " abcdefghijklmnopqrstuvwxyzàáâã0"  # of each symbol


def _words(text: str) -> tuple[set[str], set[str]]:
    """The distinct words, and the distinct pairs of neighbours, spelled in symbols; words under SHORT or over WIDE symbols are not learnt from."""
    points = _points(text)
    s, begin, end, of = _split(_symbols_of(points), sentences(points))
    line = "".join(map(_LETTERS.__getitem__, s.tolist()))
    words = [line[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    fits = lambda w: SHORT <= len(w) <= WIDE
    two = {f"{words[k]} {words[k + 1]}" for k in _neighbours(begin, end, of).tolist() if fits(words[k]) and fits(words[k + 1])}
    return {w for w in words if fits(w)}, two


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Learn from whole texts with a label each. A toxic text is a bag of sentences of which at least one is toxic; which fragment of which sentence convicts it
    is found by turns: the machine names each bag's fragment of largest score and each clean text's two worst ones, and is trained anew.

    Fragments to learn from are words of SHORT to WIDE symbols, and pairs of such neighbours that two toxic texts or more have. A bag is the BAG fragments of highest
    odds to stand in toxic texts; the clean side begins with the CLEAN_WORDS clean words of least hash. Texts are scored on all their fragments all the same."""
    pieces, seen = [], [{}, {}]
    # pairs are many, and most stand in one text: a first turn holds their hashes alone
    code = lambda w: zlib.crc32(w.encode())
    codes = [np.unique(np.array([code(w) for w in _words(text)[1]], np.uint32)) for text, t in zip(texts, toxic, strict=True) if t]
    values, counts = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.uint32),) * 2
    shared = set(values[counts > 1].tolist())
    for text, t in zip(texts, toxic, strict=True):
        if t:
            words, two = _words(text)
            pieces.append(words | {w for w in two if code(w) in shared})
            for w in pieces[-1]:
                seen[1][w] = seen[1].get(w, 0) + 1
    seen[1] = {w: k for w, k in seen[1].items() if k > 1 or " " not in w}
    for text, t in zip(texts, toxic, strict=True):
        if not t:
            words, two = _words(text)
            for w in words | {w for w in two if w in seen[1]}:
                seen[0][w] = seen[0].get(w, 0) + 1
    pieces = [{w for w in own if w in seen[1]} for own in pieces]
    n = [max(1, toxic.count(0)), max(1, toxic.count(1))]
    odds = {w: np.log((k + 0.05) / n[1]) - np.log((seen[0].get(w, 0) + 0.5) / n[0]) for w, k in seen[1].items()}
    if not odds or not seen[0]:
        return Model(np.zeros(CODES, np.float32), 0.0, (0.0, 0.0, -3.0))
    ranked = sorted(odds, key=lambda w: (-odds[w], w))
    common = sorted((w for w in seen[0] if " " not in w), key=lambda w: (-seen[0][w], w))
    landmarks = list(dict.fromkeys([*ranked[: LANDMARKS * 3 // 4], *common[: LANDMARKS // 4]]))
    scale = norms(np.array([len(w) for w in landmarks]))
    gram, own, codes = _features(landmarks, landmarks)
    gram = (gram / scale[None, :]).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector[:, value > 1e-4] / np.sqrt(value[value > 1e-4])
    turned = (root / scale[:, None]).astype(np.float32)
    features = lambda some: _features(some, landmarks)[0] @ turned

    likely = lambda some: sorted((w for w in some if odds[w] > 0), key=lambda w: (-odds[w], w))[:BAG]
    bags = [b for b in map(likely, pieces) if b]
    clean = sorted(seen[0], key=lambda w: zlib.crc32(w.encode()))[:CLEAN_WORDS]
    hard: dict[str, int] = {}
    witness = [max(b, key=lambda w: (odds[w], w)) for b in bags]
    x_clean, model = features(clean), None
    bag_words = sorted({w for b in bags for w in b})
    place, x_bags = {w: k for k, w in enumerate(bag_words)}, features(bag_words)
    for turn in range(ROUNDS):
        named = [w for w in witness if seen[0].get(w, 0) * n[1] <= 0.1 * n[0] * seen[1][w]]
        if not named:
            break
        w = _svm([(x_bags[[place[w] for w in named]], 1.0, 3.0), (x_clean, -1.0, 1.0), (features(list(hard)), -1.0, 3.0)])
        table = np.zeros(CODES, np.float32)
        table[codes] = (own.astype(np.float64) / scale[None, :]) @ (root @ w[:-1])
        model = Model(table, float(w[-1]), (1.0, 0.0, 0.0))
        f = x_bags @ w[:-1] + w[-1]
        witness = [max(b, key=lambda v: (f[place[v]] + 0.1 * odds[v], v)) for b in bags]
        for text, t in zip(texts, toxic, strict=True):
            if not t and turn < ROUNDS - 1:
                s, begin, end, f_text, _ = model.rate(text)
                for k in np.argsort(-f_text)[:2].tolist():
                    if f_text[k] > -0.8 and end[k] - begin[k] <= 2 * WIDE + 2:
                        hard["".join(map(_LETTERS.__getitem__, s[begin[k] : end[k]].tolist()))] = 1
    if model is None:
        return Model(np.zeros(CODES, np.float32), 0.0, (0.0, 0.0, -3.0))
    margins = np.clip(np.array([model.margins(t) for t in texts]), -3, 3)
    model.calibration = _platt(margins, np.array(toxic))
    return model


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    x = np.hstack([margins, np.ones((len(margins), 1))])
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + 1e-3 * np.eye(3), x.T @ (p - y) + 1e-3 * w)
    return tuple(w.tolist())


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, where: str = "crc32(cast(doc_id as string)) % 3 <> 1", longest: int = MAX_CHARS // 40) -> Model:
    """Learn from up to `sample` labelled texts of each label that meet `where`: those of least hash, whole, as far as they hold MAX_CHARS code points.
    Texts over `longest` code points, null labels and null texts take no part; long texts are scored whole all the same. What is learnt from these texts is
    told at fit(). Ties in hash go by doc_id. Rows that repeat count each, and a doc_id with both labels counts for either. Without a text of each label the
    model scores every text 0.05."""
    known = labels.where("toxic in (0, 1)").where(where).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    docs = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.select("doc_id", F.length("text").alias("n")).join(known, "doc_id")  # texts take no part in the choice
    size = rows.agg(F.coalesce(F.avg("n"), F.lit(0.0))).first()[0]
    each = max(1, min(sample, int(MAX_CHARS / 2 / max(1.0, size))))
    ids = [rows.where(F.col("toxic") == t).where(F.col("n") <= longest).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each).select("doc_id", "toxic") for t in (0, 1)]
    chosen = docs.join(F.broadcast(ids[0].union(ids[1])), "doc_id")  # 2 * sample rows at most

    def learn(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["toxic", "text"])
        m = fit(sample["text"].tolist(), sample["toxic"].astype(int).tolist())
        give_back()
        return pd.DataFrame([(m.table.tobytes(), m.bias, list(m.calibration))], columns=["table", "bias", "calibration"])

    # the sample is bounded, so one task learns from it, and the driver sees the weights alone
    found = chosen.select("text", "toxic", F.lit(0).alias("all")).groupBy("all").applyInPandas(learn, "table binary, bias double, calibration array<double>").first()
    return Model(np.frombuffer(found.table, np.float32), found.bias, tuple(found.calibration)) if found else fit([], [])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the column `name`, which replaces one of that name: the score, from 0 to 1, of each whole text; a null text counts as empty. Other columns stay,
    and so do rows that repeat and rows without a doc_id."""
    broadcast = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.calibration))  # CODES numbers

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*broadcast.value)
        for t in texts:
            yield pa.array([own.score(x.as_py() or "") for x in t], pa.float64())
        give_back()

    return docs.withColumn(name, F.arrow_udf(run, "double")("text"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """score of all documents by a model of the labels that are not held out; nulls, empties and repeated rows as there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs.select("doc_id", "text"), train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", F.expr("crc32(cast(doc_id as string)) % 3 = 1").alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
