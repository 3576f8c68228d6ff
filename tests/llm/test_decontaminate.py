import random

import numpy as np

from newsflow.llm import decontaminate as d


def plain_score(a, b, o):
    """Smith-Waterman by its recurrence."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            step = o.match if a[i - 1] == b[j - 1] else o.mismatch
            table[i][j] = max(0, table[i - 1][j - 1] + step, table[i - 1][j] + o.gap, table[i][j - 1] + o.gap)
            best = max(best, table[i][j])
    return best


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n)]


def fixture():
    r = random.Random(8)
    items = [(i, " ".join(words(r, r.randint(12, 50)))) for i in range(12)] + [(50, None), (51, ""), (52, "too short now"), (3, None)]
    rows = []
    for k in range(60):
        body = words(r, r.choice([0, 5, 80, 300]))
        if k % 3 == 0:
            item = items[k % 12][1].split()
            for _ in range(k % 4):
                item[r.randrange(len(item))] = "other"
            at = r.randint(0, len(body))
            body = body[:at] + item + body[at:]
        rows.append((k if k % 7 else None, r.choice([" ", ", "]).join(body).upper() if k % 2 else " ".join(body)))
    return rows + [(70, None), (71, ""), rows[3], rows[3]], items


def test_alignment_equals_recurrence():
    r = random.Random(1)
    o = d.Alignment()
    for _ in range(200):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(1, 12))] for _ in range(2))
        score, first, end = d.smith_waterman(np.array(a), np.array(b), o)
        assert score == plain_score(a, b, o)
        if score:
            assert 0 <= first < end <= len(b) and plain_score(a, b[first:end], o) == score


def test_equals_alignment_of_every_pair(spark):
    rows, items = fixture()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    got = {(x["doc_id"], x["item_id"], round(x["score"], 6)) for x in d.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    o, expected = d.Alignment(), set()
    for doc_id, text in rows:
        own = d.words_of(text or "")[3].tolist()
        for item_id, item in items:
            item = d.words_of(item or "")[3].tolist()
            grams = {tuple(item[i : i + 5]) for i in range(len(item) - 4)}
            if any(tuple(own[i : i + 5]) in grams for i in range(len(own) - 4)):
                score = plain_score(item, own, o)
                if score >= o.floor * 2 * len(item) or score >= 2 * o.long_match:
                    expected.add((doc_id, item_id, round(score / (2 * len(item)), 6)))
    assert got == expected and len(got) > 10


def test_filter_keeps_clean_rows_and_columns(spark):
    rows, items = fixture()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, passage string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {(x["doc_id"], x["text_id"]) for x in d.contaminated(docs, bench).collect()}
    kept = d.decontaminated(docs, bench)
    import hashlib

    clean = [r for r in rows if r[1] is None or (r[0], hashlib.md5(r[1].encode()).hexdigest()) not in bad]
    assert sorted(map(str, [(x["doc_id"], x["text"]) for x in kept.collect()])) == sorted(map(str, clean)) and kept.columns == docs.columns


def test_shared_passage_short_items_and_scripts_without_blanks(spark):
    r = random.Random(3)
    passage, tails = words(r, 30), [words(r, 10) for _ in range(4)]
    items = [(i, " ".join(passage + t)) for i, t in enumerate(tails)] + [(10, "Very odd item"), (11, "漢字かな交じり文の問題です"), (12, "ภาษาไทย"), (13, None)]
    clean = " ".join(words(r, 60))
    rows = [(1, f"{clean} {' '.join(passage)} {clean}"), (2, f"{clean}, very odd ITEM."), (3, f"前文、漢字かな交じり文の問題です。{clean}"), (4, f"นี่คือภาษาไทยครับ {clean}"), (5, clean), (6, "very odd"), (7, "漢字")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in d.contaminated(docs, bench).collect()}
    assert got == {**{(1, i): 0.75 for i in range(4)}, (2, 10): 1.0, (3, 11): 1.0, (4, 12): 1.0}
    assert sorted(x["doc_id"] for x in d.decontaminated(docs, bench).collect()) == [5, 6, 7]


def test_words_of_scripts_without_blanks():
    cut = lambda text: [w.decode() for raw, a, b, _ in [d.words_of(text)] for w in (raw[i:j] for i, j in zip(a, b))]
    assert cut("Abc漢字é1 カナx,ไทย 𠀀y é") == ["abc", "漢", "字", "é1", "カ", "ナ", "x", "ไ", "ท", "ย", "𠀀", "y", "é"]
    assert cut("") == cut(" -") == [] and cut("文") == ["文"] and cut("한국 Привет") == ["한국", "привет"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert d.contaminated(docs, none).count() == 0
    assert d.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], none.schema)).count() == 0
