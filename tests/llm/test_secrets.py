import hashlib
import random
import re

from newsflow.llm import secrets as s

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
SCHEMA = "doc_id long, text string"


def brute(text):
    """Base spans by the plain patterns, failing matches dropped afterwards."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort()
    written = ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in out)
    return (*[sum(x[1] == k for x in out) for k in range(3)], hashlib.sha256(written.encode()).hexdigest())


def hexes(r, n, size):
    return ["".join(r.choice("0123456789abcdef") for _ in range(size)) for _ in range(n)]


def test_base_equals_plain_patterns(spark):
    r = random.Random(1)
    parts = [
        "password", "PassWd", "ſecret", "tokeN", "toKen", "api_key", "apikey", "=", ":", " ", "'", '"', "abc", "x1y2z3", "AKIA", "AKIA" + "Q" * 16,
        "AKIA" * 6, *hexes(r, 3, 24), "f" * 23, "é", "\n", "secret: secret=abcdef", "token = \"" + "a" * 40, "A" * 15,
    ]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(300)] + [None, "", "x" * 100_000 + "token=abcdef"]
    docs = spark.createDataFrame([(i, t, 9, "k") for i, t in enumerate(texts)], SCHEMA + ", n_hex int, base string")
    got = {x["doc_id"]: (x["n_assign"], x["n_access"], x["n_hex"], x["base_sha256"]) for x in s.digests(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_grammar_finds_the_same_format(spark):
    """Hexadecimal strings too short for the pattern are known by the automaton learned from longer ones; words are not."""
    r = random.Random(2)
    rows = [(i, "say token = " + h) for i, h in enumerate(hexes(r, 60, 40))]
    rows += [(100, "see " + hexes(r, 1, 20)[0] + " there"), (101, "extraordinarily2023words and INTERNATIONALISATION99X"), (102, "é" * 9 + " " + hexes(r, 1, 20)[0])]
    got = {x["doc_id"]: x["spans"] for x in s.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[100] == "format:4:24" and got[101] == "" and got[102] == "format:10:30"
    assert got[0] == "assign:4:52,hex:12:52"


def test_every_candidate_is_scored(spark):
    """Beside and between base spans, joined by any character, without digits or without letters."""
    r = random.Random(5)
    key = lambda n: "".join(r.choice("ABCDEF0123456789") for _ in range(n))
    rows = [(i, f"token = {key(36)} said") for i in range(80)]
    long, one, two = hexes(r, 1, 26)[0], key(36), key(30)
    rows += [(100, f"x {one}-{long} y"), (101, f"x {long}-{one} y"), (102, f"{one}/{long}={two}"), (103, "see " + "ABCDEFFEDCBA" * 2), (104, "call 4929 " + "1234567890" * 3)]
    rows += [(105, "INTERNATIONALISATION CONTEMPORAINEMENT donaudampfschifffahrt " * 3), (106, f"path/{two}.txt."), (107, "")]
    got = {x["doc_id"]: [p.split(":") for p in x["spans"].split(",") if p] for x in s.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    cut = lambda i: [rows_by[i][int(a) : int(b)] for k, a, b in got[i] if k == "format"]
    rows_by = dict(rows)
    assert cut(100) == [one] and cut(101) == [one] and cut(102) == [one, two]
    assert cut(104) == cut(105) == cut(107) == []
    # A run of its own keeps its path, the automaton then decides; the credential in it is longer than its evidence needs.
    assert all(k in ("format", "hex") for k, _, _ in got[106])


def test_dotted_credentials():
    r = random.Random(6)
    part = lambda n: "".join(r.choice("abcdef0123456789") for _ in range(n))
    automata = {"assign": s.infer([f"{part(12)}.{part(12)}" for _ in range(300)], 0.05)}
    scorer = s.Scorer(automata, s.Grammar())
    value = f"{part(9)}.{part(9)}"
    assert [text[a:b] for text in [f"so {value}, it"] for a, _, b, _ in scorer.spans(text, [])[0]] == [value]
    assert scorer.spans("plain words. More words.And others, v1.2.3 and a.b.c", [])[0] == []


def test_least_length_follows_the_automata():
    r = random.Random(7)
    options = s.Grammar()
    hexed = {"hex": s.infer(hexes(r, 300, 40), 0.05)}
    least = s.least_length(hexed, options)
    assert 12 <= least <= 16 and s.least_length({}, options) == 0
    fixed = s.least_length({"access": s.infer(["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOP0123456789") for _ in range(16)) for _ in range(300)], 0.05)}, options)
    assert 0 < fixed <= 20


def test_inference_merges_states_and_keeps_probabilities():
    r = random.Random(3)
    states = s.infer(hexes(r, 200, 30), 0.05)
    assert len(states) < 5
    for end, steps in states:
        assert abs(end + sum(p for p, _ in steps.values()) - 1) < 1e-9
    two = s.infer(["AB" * 10] * 50 + ["9z" * 10] * 50, 0.05)
    assert len(two) > 1
    assert s.likelihood("AB" * 8, two, 1e-4) > s.likelihood("A9" * 8, two, 1e-4)


def test_redaction_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a token=abcdef0123456789abcdef0123 b", "l"), (1, None, None), (1, "", "x"), (2, "plain", "y")], SCHEMA + ", lang string")
    got = [(x["doc_id"], x["text"], x["lang"]) for x in s.secrets(docs, redact="[S]", carry=("lang",)).collect()]
    assert sorted(got, key=str) == sorted([(None, "a [S] b", "l"), (1, None, None), (1, "", "x"), (2, "plain", "y")], key=str)
    assert s.digests(spark.createDataFrame([], SCHEMA)).count() == 0
