import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from newsflow.llm import divergence, queries
from newsflow.llm.divergence import Cube

UNIT = 1_000_000_000


def brute(rows, cube):
    docs, count, seen = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        seen.add((lang, source))
        docs[lang].update(set(words))
        count[lang, source].update(words)
    out = set()
    for lang in {g[0] for g in seen}:
        kept = [t for t, n in docs[lang].items() if n >= cube.least_documents]
        share = lambda c: {t: 1 + UNIT * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        sources = [s for g, s in seen if g == lang]
        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -v, n + 1) for n, (v, _, o) in enumerate(sorted(pair))}
            out |= {(lang, s, "term", t, -v, n + 1) for n, (v, _, t) in enumerate(sorted(term)[: cube.terms])}
    return out


def test_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = queries.QUERIES["op12_source_divergence"](spark, folder)
    want = con.sql(queries.SQL["op12_source_divergence"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("cube", [Cube(), Cube(terms=4, group_block=2, term_block=3, batch_bytes=90, held_terms=50), Cube(least_documents=1, group_block=3)])
def test_equals_brute_force_on_odd_rows(spark, cube):
    rng = random.Random(2)
    words = [f"w{chr(97 + i)}" for i in range(25)] + ["É", "é", "ÄB", "漢字", "😀x", "Z", "z"]
    rows = []
    for n in range(160):
        text = rng.choice(" \n.1_\x00-").join(rng.choice(words[: 5 + n % 28]) for _ in range(rng.randrange(30)))
        rows.append((text, rng.choice(["en", "EN", "", None]), rng.choice(["a", "b", "é", "z", None, "", "src9", "hot", "hot", "hot"])))
    rows += [rows[0]] * 5 + [(None, "en", "only"), ("", "xx", "lone"), ("rare words here", "yy", "p"), ("other", "yy", "q")]
    rows += [("long " * 3000 + "x" * 5000, "en", "b")] * 3
    docs = spark.createDataFrame([(i, *r, "t", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, p int")
    got = [tuple(r) for r in divergence.audit(docs.repartition(4), cube).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, cube)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_counts_beyond_a_long_keep_exact(spark):
    n = 7 * 10**18
    got = spark.sql(f"SELECT {n}L AS n, {n}L AS total, 5L AS terms").select(divergence.share(*[divergence.F.col(c) for c in ("n", "total", "terms")])).first()[0]
    assert got == 1 + UNIT * (n + 1) // (n + 5)
