"""Secret scans against Python's own expressions over random texts, and edge cases."""

import hashlib
import random
import re

import pytest

from driftwatch.llm import queries
from driftwatch.llm import secret_scan as S
from driftwatch.llm.automata import compiled, parse

PIECES = [
    "password", "PassWord", "passwd", "secret", "token", "api_key", "apikey", "API-KEY", '"', "'", " ", "  ", ":", "=", "==", "abcd1234", "x", "a/b+c.d-e_f=", "AKIA", "AKIAABCDEFGH1234",
    "deadbeef", "0123456789abcdef", "f" * 32, "\n", ", ", "é", "中文", "😀", "ghp_", "A" * 36, "glpat-", "xoxb-", "1" * 20, "AIza", "sk_live_", "eyJ", ".", "ab" * 20, "https://", "u:p@", "@",
    "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ſecret", "Kelvin K",
]


def plainly(text):
    """All spans by Python's expressions, in code points."""
    out = []
    for r, rule in enumerate(S.RULES):
        pattern = rule.pattern.replace("[0-9a-f]{32,}", "[0-9a-f]+")
        for m in re.finditer(pattern, text, re.IGNORECASE | re.ASCII if rule.fold else 0):
            least = 32 if rule.kind == "hex" else rule.least
            part = re.search(r"[A-Za-z0-9+/_.=-]+$", re.sub(r"^.*?[:=]\x20*", "", m[0])) if rule.kind == "assign" else None
            if m.end() - m.start() >= least and (not part or len(part[0]) >= 8):
                out.append((m.start(), r, m.end()))
    return [(S.RULES[r].kind, a, b) for a, r, b in sorted(out)]


def test_random_texts_and_stretches(monkeypatch):
    draw, scanner = random.Random(1), S.Scanner()
    texts = ["".join(draw.choices(PIECES, k=draw.randrange(0, 40))) for _ in range(3000)] + ["", "x" * 5000, "e" * 5000, "token: " + "a" * 5000 + "\n" + "b" * 3000]
    want = [plainly(t) for t in texts]
    assert sum(map(len, want)) > 3000 and {k for w in want for k, _, _ in w} == {rule.kind for rule in S.RULES}
    for stretch in (1, 7, 1024):
        monkeypatch.setattr(S, "STRETCH", stretch)
        assert scanner.spans([t.encode() for t in texts]) == want


@pytest.mark.parametrize("pattern", ["a(b|c)*d", "(ab?){2,3}", "[^a-c]x+|b{2}", "a{2,}b?", r"\x61\.[a\-c]"])
def test_automata_accept_what_expressions_accept(pattern):
    one, draw = compiled([parse(pattern)], anywhere=False), random.Random(2)
    for _ in range(2000):
        word = "".join(draw.choices("abcdx.-", k=draw.randrange(0, 8)))
        state = one.start
        for b in word.encode():
            state = one.delta[state, one.classes[b]]
        assert bool(one.accepts[state]) == bool(re.fullmatch(pattern, word)), word


def test_automata_are_minimal_and_reject_unknown_syntax():
    assert len(compiled([parse("(a|b)(a|b)|aa|ab")], anywhere=False).delta) == 4
    for bad in ("(a", "a)", "*", r"\d", "é", "[a"):
        with pytest.raises(ValueError):
            parse(bad)


def test_a_short_match_covers_what_it_holds(frame):
    rows = frame([(1, "token: secret: abcdefgh"), (2, "secret=token=abcdefgh"), (3, "AKIAAKIA1234567890")], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in S.scan(rows).collect()}
    assert got == {1: [], 2: [("assign", 0, 21)], 3: [("access", 0, 18)]}


def test_nulls_repeats_clashes_and_empty_tables(frame, spark):
    rows = frame([(1, None, "x"), (None, "é token=12345678", "y"), (1, "", "z"), (1, "", "z")], "doc_id long, text string, spans string")
    got = [(r["doc_id"], r["text"], [tuple(s) for s in r["spans"]]) for r in S.scan(rows).collect()]
    assert sorted(got, key=str) == sorted([(1, None, []), (None, "é token=12345678", [("assign", 2, 16)]), (1, "", []), (1, "", [])], key=str)
    assert S.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_masks(frame):
    key = "0123456789abcdef" * 2
    rows = frame([(1, f"é token={key}! and AKIAABCDEFGH1234 end"), (2, "plain"), (3, None), (4, key)], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_masked"]) for r in S.mask(rows).collect()}
    assert got == {1: ("é [assign]! and [access] end", 2), 2: ("plain", 0), 3: (None, 0), 4: ("[hex]", 1)}


def test_query_digests(spark, tmp_path):
    texts = ["é token=12345678 and AKIAABCDEFGH1234", "0123456789abcdef" * 2 + " ghp_" + "A" * 36, None, "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op11_secret_scan(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        spans = plainly(text or "")
        base = [s for s in spans if s[0] in ("assign", "access", "hex")]
        text_of = lambda own: ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert got[i]["spans"] == text_of(spans) and got[i]["base_sha256"] == hashlib.sha256(text_of(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
