import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsflow.llm import packing as p

TEXTS = [
    "Hello's world, we're 42 don't ÄÖÜ straße", "", None, "a" * 5000, "½ ² ª ﬁ İstanbul ΣΑΣ <|endoftext|> x<|startoftext|>", "tabs\tand\nlines\x0b\x0c\x1c\x85 done",
    "plain words <|endoftext|> more", "<|ENDOFTEXT|> x<|startoftext|>y", "__init__ (x)->y!='s' '' ''s", "日本語 текст 😀😀", "é é", "word " * 3000, "   ​", "don’t “quote” – ok…", "  ", "ſ K İ",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_word_lookup_equals_tokenizer(tokenizer):
    r = random.Random(5)
    pool = [*"abcXYZ'’éÀß_-.,!?0129 \n\t½²ªµſKﬁ日😀́ ​\x1c", "<|endoftext|>"]
    texts = [t or "" for t in TEXTS] + ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(800)]
    for limit in (300_000, 7):
        coder = p.Words("word_bpe_49k.json", limit)
        for text, got in zip(texts, coder.encode(texts)):
            assert np.frombuffer(got, "<u4").tolist() == ids(tokenizer, text)[:-1], repr(text)


def test_pieces_rebuild_each_document(spark, tokenizer):
    docs = spark.createDataFrame([(i if i % 5 else None, t, 7) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, piece int")
    got = p.packed(docs, keep_ids=True).collect()
    whole = sorted((d if d is not None else -1, t or "") for d, t in docs.select("doc_id", "text").collect())
    by_sequence, total = {}, 0
    for r in got:
        assert r["length"] * 4 == len(r["ids"]) and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["start"] == r["piece"] * 2048
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(len(ids(tokenizer, t)) for _, t in whole)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by_sequence) == -(-total // 2048) or len(by_sequence) >= p.lower_bound(np.array([r["length"] for r in got]), 2048)


def test_bound_never_exceeds_best_packing():
    r = random.Random(2)

    def best(items, capacity):
        items, top = sorted(items, reverse=True), [len(items)]

        def go(i, bins):
            if len(bins) >= top[0]:
                return
            if i == len(items):
                top[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                    bins[k] += items[i]
                    go(i + 1, bins)
                    bins[k] -= items[i]
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return top[0]

    for _ in range(150):
        capacity = r.choice([7, 10, 12, 30])
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        found = p.best_fit(np.array(items), capacity)
        assert p.lower_bound(np.array(items), capacity) <= best(items, capacity) <= found[2]
        fill = np.bincount(found[0], weights=items)
        assert fill.max() <= capacity and len(fill) == found[2]
    assert p.lower_bound(np.array([6, 6, 6]), 10) == 3


def test_exchange_between_tasks_saves_bins(spark):
    """Shares that pack badly alone give their open bins to each other."""
    r = random.Random(4)
    rows = [(i, 0, 0, r.randint(300, 1500), i) for i in range(400)]
    df = spark.createDataFrame(rows, p.PIECES)
    alone = p.pack(df, p.Packing(rows_per_task=20, rounds=0)).select("sequence_id").distinct().count()
    shared = p.pack(df, p.Packing(rows_per_task=20, rounds=3)).select("sequence_id").distinct().count()
    assert shared <= alone
    assert p.pack(df, p.Packing(rows_per_task=20)).count() == 400


def test_empty_table(spark):
    assert p.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
