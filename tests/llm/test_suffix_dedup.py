import hashlib
import random

import numpy as np
import pytest

from newsflow.llm import suffix_dedup as sd


def brute(texts):
    """(bytes, removed, spans, digest) of each text by looking at every string."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for i in range(len(raw) - sd.LENGTH + 1):
            s = raw[i : i + sd.LENGTH]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - sd.LENGTH + 1):
            if seen[raw[i : i + sd.LENGTH]] > 1:
                gone[i : i + sd.LENGTH] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def rows(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: tuple(r)[1:] for r in sd.suffix_dedup(docs).collect()}
    return [found[i] for i in range(len(texts))]


def prose(r, n):
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(n))


def fixture():
    r = random.Random(7)
    shared = [prose(r, 80) for _ in range(4)]
    texts = [prose(r, 60) + r.choice(shared) + prose(r, 50) + r.choice(shared)[: r.randint(150, 400)] for _ in range(40)]
    near = prose(r, 300)
    for _ in range(15):
        cut = r.randint(0, len(near) - 1)
        texts.append(near[:cut] + "#" + near[cut + 1 :])
    texts += [near, near, "", None, "x" * 199, "x" * 200, "y" * 700, "ab" * 300, prose(r, 20), "é" * 150, shared[0][:199], shared[0][:200]]
    texts.append(prose(r, 200) + shared[1] + prose(r, 9) + shared[1])
    return texts


def test_equals_brute_force(spark):
    texts = fixture()
    assert rows(spark, texts) == brute(texts)


def test_crowded_anchors(spark, monkeypatch):
    """Groups over the limit go by finer keys to the same result."""
    texts = fixture()
    monkeypatch.setattr(sd, "CROWD", 3)
    assert rows(spark, texts) == brute(texts)


def test_blocks(monkeypatch):
    """A text looked at in blocks has the same strings and anchors."""
    raw = np.frombuffer(fixture()[0].encode() * 3, np.uint8)

    def strings():
        start, before, n, key = sd.anchors_of(raw)
        return [(s + i, b - i, int(k)) for s, b, m, k in zip(start, before, n, key) for i in range(m)]

    whole = strings()
    monkeypatch.setattr(sd, "BLOCK", 101)
    assert strings() == whole


def test_collisions_are_found(monkeypatch):
    """With hashes that say nothing the bytes decide."""
    r = random.Random(3)
    held = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 9))) for _ in range(60)]
    size = np.array([len(h) for h in held])
    suffixes = sd.Suffixes(np.frombuffer(b"".join(held), np.uint8), np.cumsum(size) - size, size)
    group = np.arange(60) // 13
    order, shared = suffixes.sorted(group)
    assert [held[i] for i in order] == [h for g in range(5) for h in sorted(held[i] for i in range(60) if group[i] == g)]
    suffixes.prefix = np.zeros_like(suffixes.prefix)
    again, shared_again = suffixes.sorted(group)
    assert [held[i] for i in again] == [held[i] for i in order]
    assert shared_again.tolist() == shared.tolist()


def test_empty_repeated_and_extra_columns(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "word " * 60
    docs = spark.createDataFrame([(1, text, "k", 1), (1, text, "k", 1), (None, text, None, 2)], "doc_id long, text string, key string, place long")
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in sd.suffix_dedup(docs).collect()) == [(300, 300, 1)] * 3


@pytest.mark.parametrize("n", [199, 200])
def test_limits_of_length(spark, n):
    a = "".join(random.Random(n).choice("abcdef") for _ in range(n))
    assert rows(spark, ["1" + a + "2", "3" + a + "4"]) == brute(["1" + a + "2", "3" + a + "4"])
