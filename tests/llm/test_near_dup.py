import random
import re

import numpy as np

from newsflow.llm import near_dup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, options):
    sets = [shingle_set(t, options.words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= options.percent * (len(sets[i]) + len(sets[j]) - common):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows))


def fixture():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    texts = []
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([2, 5, 9, 30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 8)):
            edited = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                edited[r.randrange(len(edited))] = r.choice(vocabulary)
            texts.append(r.choice([" ", "\n", "\t "]).join(edited))
    drift = [r.choice(vocabulary) for _ in range(300)]
    for _ in range(30):
        drift[r.randrange(300)] = r.choice(vocabulary)
        texts.append(" ".join(drift).upper())
    texts += ["", None, " \n", "one", "ONE", "Straße É", "straße É", "straße é", "a b"]
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(1000 + i, texts[k]) for i, k in enumerate(order)]


def test_equals_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, band int")
    for options in (nd.NearDuplicates(words=3, percent=85), nd.NearDuplicates(), nd.NearDuplicates(words=3, percent=85, block=4, set_block=3)):
        assert sorted(tuple(r) for r in nd.near_duplicates(docs, options).collect()) == brute(rows, options)


def test_estimate_is_corrected():
    """Registers of unrelated sets agree by chance only as often as the correction expects."""
    options = nd.NearDuplicates(mantissa_bits=1)
    r = np.random.default_rng(5)
    got = []
    for _ in range(60):
        a, b = (np.unique(r.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2)) for _ in range(2))
        one, other = nd.registers_of(a, options), nd.registers_of(b, options)
        got.append(nd.estimates(one[None], np.array([len(a)]), other[None], np.array([len(b)]), options)[0][0, 0])
    assert abs(np.mean(got)) < 0.03
    a = np.unique(r.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
    one, other = nd.registers_of(a[:2700], options), nd.registers_of(a[300:], options)
    assert abs(nd.estimates(one[None], np.array([2700]), other[None], np.array([2700]), options)[0][0, 0] - 0.8) < 0.15


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert nd.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    text = "a b c d e f g"
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (3, text), (None, ""), (None, "other words entirely here now")], schema)
    got = sorted(map(str, (tuple(r) for r in nd.near_duplicates(docs).collect())))
    assert got == sorted(map(str, [(5, 3, 3, False), (5, 3, 3, False), (None, 3, 3, False), (3, 3, 3, True), (None, 0, None, True), (None, 1, None, True)]))


def test_filter_keeps_one_of_each_group(spark):
    rows = fixture()
    docs = spark.createDataFrame([(*r, "x") for r in rows] + [(*rows[0], "x")], "doc_id long, text string, lang string")
    kept = nd.deduplicated(docs)
    assert kept.columns == docs.columns
    expected = [d for d, _, _, keep in brute(rows, nd.NearDuplicates()) if keep]
    assert sorted(r["doc_id"] for r in kept.collect()) == expected


def test_filter_judges_id_and_text_together(spark):
    a, b = "one two three four five six seven", "red green blue black white brown grey"
    schema = "doc_id long, text string, gone_id int"
    docs = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], schema)
    kept = lambda rows: sorted((r["doc_id"], r["text"]) for r in nd.deduplicated(docs(rows)).collect())
    # The same id with two texts: each group keeps one document.
    assert kept([(1, b), (5, a), (5, b), (7, a)]) == [(1, b), (5, a)]
    # Two near texts under the smallest id of their group: one of them stays.
    near = " ".join(f"w{i}" for i in range(60))
    left = kept([(1, near + " x"), (1, near + " y"), (2, near)])
    assert len(left) == 1 and left[0][0] == 1


def test_long_paths_join(spark):
    path = [(bytes([i + 1]), bytes([i])) for i in range(40)] + [(bytes([90]), bytes([91]))]
    edges = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in path], "a binary, b binary")
    got = {bytes(r["key"]): bytes(r["label"]) for r in nd.components(edges).collect()}
    assert got == {bytes([i]): bytes([0]) for i in range(41)} | {bytes([90]): bytes([90]), bytes([91]): bytes([90])}


def test_common_sizes():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 50, r.integers(1, 40), dtype=np.uint64)) for _ in range(20)]
    got = nd.common_sizes(sets[:8], sets[8:], columns=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[8:]] for a in sets[:8]]
