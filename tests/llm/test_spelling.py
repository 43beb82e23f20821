"""Spelling variants against neighbourhoods of single edits, and edge cases."""

import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import pytest
from conftest import SMALL

from driftwatch.llm import queries, spelling


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (out | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}) - {word}


def plainly(docs, least_chars=5, least=3):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= least_chars and k >= least}
    letters, form, near = {c for w in n for c in w}, {}, {}
    for w in n:
        own = [x for x in edits(w, letters) if x in n]
        near[w] = len(own)
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if own and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], near[w], n[form[w]] if form[w] else 0) for w in n)


def rows_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def test_query(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    got = rows_of(queries.op13_spelling_variants(spark, SMALL))
    assert got == plainly(docs) and sum(r[1] != "" for r in got) > 10


@pytest.mark.parametrize("large", [1, 4, 1 << 13])
def test_crowded_keys_and_chains(frame, large):
    draw = random.Random(5)
    words = ["".join(draw.choices("abé", k=draw.randrange(5, 9))) for _ in range(400)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaa", "aaaaab", "abaaaa"]
    docs = [(i, " ".join(draw.choices(words, weights=[1 + 2 ** (i % 9) for i in range(len(words))], k=300))) for i in range(60)]
    want = plainly(docs)
    assert rows_of(spelling.variants(frame(docs, "doc_id long, text string"), large=large)) == want
    by = {r[0]: r[1] for r in want}
    assert any(r[2] != r[1] and by.get(r[1]) for r in want)  # some root lies behind a form's form


def test_nulls_repeats_clashes_case_and_empty_tables(frame, spark):
    rows = [(None, "Ärger Ärger ärger WORDS words", 1), (1, None, 2), (1, "", 3), (2, "words wörds-wörds wörds", 4), (2, "words wörds-wörds wörds", 4), (3, "x" * 20_000, 5)]
    got = rows_of(spelling.variants(frame(rows, "doc_id long, text string, word long"), least=2))
    assert got == plainly([r[:2] for r in rows], least=2) and {r[0] for r in got} >= {"words", "wörds"}
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("last", [False, True])
def test_near_sets(last):
    middles = ["ab", "ac", "abc", "aab", "ba", "cab", "abx", "aé"]
    got = {middles[i]: {m for j, m in enumerate(middles) if near >> j & 1} for i, near in spelling.near_sets(middles, 2, last)}
    for a in middles:
        want = {b for b in middles if b in edits(a, "abcxé") and 2 in (len(a), len(b))}
        if not last:
            want = {b for b in want if not (len(a) != len(b) and (a.startswith(b) or b.startswith(a)))}
        assert got.get(a, set()) == want
