import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracewell.llm import packing
from tracewell.llm.packing import WordTokenizer, best_fit, default_tokenizer, lower_bound, op1_best_fit_packing, pack, sequences


def test_query(spark, sf01):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    whole = Tokenizer.from_file(default_tokenizer())
    want = {}
    for d, t in texts.items():
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[(d, k // 4096)] = (k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))
    rows = op1_best_fit_packing(spark, sf01).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 4096
    values, counts = np.unique([v[1] for v in want.values()], return_counts=True)
    assert len(used) <= lower_bound(values, counts) + 1


@pytest.mark.parametrize("text", ["", "It's I'LL re're \t\n 12a3 __x-_y...'s", "ÀÉß œuvre ñ ¿qué? µ ª º ŉ Œ", "²³ ½ İı 中文 ́e ﬁ", "<|endoftext|> a", "a\x0bb\x1cc d e"])
def test_words_are_as_in_the_whole(text):
    ids = WordTokenizer(default_tokenizer()).encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == Tokenizer.from_file(default_tokenizer()).encode(text, add_special_tokens=False).ids


class Told:
    """A tokenizer that tells what it is given."""

    def __init__(self, own, sent):
        self.own, self.sent = own, sent

    def encode_batch_fast(self, texts, **options):
        self.sent += texts
        return self.own.encode_batch_fast(texts, **options)


def test_a_word_in_many_chunks_is_encoded_once():
    tokenizer, whole, sent = WordTokenizer(default_tokenizer()), Tokenizer.from_file(default_tokenizer()), []
    for name, v in list(vars(tokenizer).items()):
        if isinstance(v, Tokenizer):
            setattr(tokenizer, name, Told(v, sent))
    for text in ["Word, word. (word) word-word's", "WORD; été ÉTÉ. word_1", "word's Été,"]:
        assert np.frombuffer(tokenizer.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    words = WordTokenizer.WORDS.findall(" ".join(sent))
    assert len(words) == len(set(words)) >= 8


@pytest.mark.parametrize("kept", [0, 50, 400_000])
def test_texts_together_are_as_each_alone(monkeypatch, kept):
    monkeypatch.setattr(WordTokenizer, "KEPT", kept)
    rng, whole, tokenizer = random.Random(3), Tokenizer.from_file(default_tokenizer()), WordTokenizer(default_tokenizer())
    for _ in range(20):
        texts = ["".join(rng.choice("aetsTrd'lvm\"$_-.,<|0\xa1\xaeßÉñœŁžÄ \t\n²中") for _ in range(rng.randint(0, 60))) for _ in range(20)]
        texts += ["".join(rng.choice("aetsTrd'lvm_-.,0ßÉñœŁ  \n") for _ in range(rng.randint(0, 60))) for _ in range(20)]
        assert [np.frombuffer(x, "<u4").tolist() for x in tokenizer.encode_all(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_exchange(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_TASK", 15)
    docs = spark.createDataFrame([(i, "word " * (7 + i % 13)) for i in range(300)] + [(1, None), (1, ""), (None, "a")], "doc_id long, text string").selectExpr("*", "0 as rid", "0 as length")
    rows = pack(docs, 32, with_ids=True)
    placed = rows.collect()
    assert len(placed) == 303 and all(r.length * 4 == len(r.ids) for r in placed)
    values, counts = np.unique([r.length for r in placed], return_counts=True)
    n = len({r.sequence_id for r in placed})
    assert n <= 1.05 * lower_bound(values, counts, 32)
    out = {r.sequence_id: bytes(r.ids) for r in sequences(rows).collect()}
    assert len(out) == n and all(out[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) for r in placed)
    assert pack(docs.limit(0)).count() == 0


def test_bound_and_fit():
    rng = np.random.default_rng(2)
    for _ in range(60):
        items = np.sort(rng.integers(1, 13, 7))[::-1]
        place, offset, free = best_fit(items, 12)
        least = next(k for k in range(1, 8) if any(max(np.bincount(c, items, k)) <= 12 for c in itertools.product(range(k), repeat=7)))
        assert lower_bound(*np.unique(items, return_counts=True), 12) <= least <= len(free)
        assert (np.bincount(place, items) == 12 - free).all()
