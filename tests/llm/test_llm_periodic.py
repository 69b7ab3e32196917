"""Periodic runs against a search by every period, and the grammar's own properties."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import periodic
from tessera.llm.queries import QUERIES


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


PART = st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=7), st.integers(1, 9))
TEXT = st.lists(PART, max_size=6).map(lambda parts: [w for words, times in parts for w in words * times])


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_all_runs(texts):
    for words, rows in zip(texts, periodic.texts_runs(texts), strict=True):
        runs = [tuple(r) for r in rows.tolist()]
        assert runs == plain_runs(words)
        assert periodic.collapsed(words, rows) == plain_collapsed(words, runs)


def _nested(depth):
    return [b"a"] if not depth else (_nested(depth - 1) * 4 + [b"%d" % depth]) * 2


@pytest.mark.parametrize("words", [[b"a"] * 5000, [b"a", b"b"] * 3000, [b"%d" % i for i in range(700)] * 9, _nested(4)])
def test_long_runs(words):
    (rows,) = periodic.texts_runs([words])
    assert [tuple(r) for r in rows.tolist()] == plain_runs(words)


def test_grammar_derives_its_text():
    random = np.random.RandomState(2)
    words = np.concatenate([np.tile(random.randint(0, 9, 12), 5), random.randint(0, 9, 300)])
    every, rule_at, (rule, at) = periodic.grammar(words, np.zeros(len(words), dtype=np.int64))
    size = every.high[: len(rule_at)] - rule_at
    assert len(np.unique(rule)) == len(rule_at) and (np.bincount(rule) > 1).all()
    for r, a in zip(rule, at, strict=True):
        assert (words[a : a + size[r]] == words[rule_at[r] : rule_at[r] + size[r]]).all()
    # What is left of the text has no pair twice, each symbol being the longest derivation that begins there.
    left = [0, *sorted(every.at[len(rule_at) :].tolist()), len(words)]
    parts = [bytes(words[a:b].astype(np.uint8)) for a, b in zip(left, left[1:], strict=False)]
    pairs = list(zip(parts, parts[1:], strict=False))
    assert all(a == b or pairs.count((a, b)) == 1 for a, b in pairs)


def test_planted(spark):
    directory = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"].encode().split() for r in spark.read.parquet(f"{directory}/documents.parquet").collect()}
    found = QUERIES["op11_grammar_runs"](spark, directory).collect()
    assert len(found) == len(texts) and sum(r["n_runs"] > 0 for r in found) > len(texts) // 20
    for r in found:
        words = texts[r["doc_id"]]
        h = zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert (r["n_runs"], r["runs_sha256"]) == (len(runs), hashlib.sha256(lines.encode()).hexdigest())
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapsed(words, runs)).hexdigest()
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == (s, n, q)
        assert r["exponent_milli"] == (n and 1000 * n // q)


def test_edges(spark):
    rows = [
        (1, "x " * 9, "k"), (1, "x " * 9, "k"), (2, None, None), (3, "", "k"), (None, " \n\t", "k"), (4, "la   " * 40_000, "k"),
        (5, "A a A a A a A a", "k"), (6, "u v w " * 4 + "u x", "k"), (None, "é é é é é é", None),
    ]
    names = ["runs", "collapsed", "_words", "_a", "text_of"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumns({n: F.lit("z") for n in names})
    found = periodic.periodic_runs(docs.repartition(2), ["doc_id", "kept", "runs", "_a"], "text")
    assert found.columns == ["doc_id", "kept", "runs", "_a", "runs_", "collapsed"]
    got = sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs_"]], r["collapsed"]) for r in found.collect())
    assert got == [
        (0, [], ""), (0, [(0, 6, 1)], "é"), (1, [(0, 9, 1)], "x"), (1, [(0, 9, 1)], "x"), (2, [], ""), (3, [], ""),
        (4, [(0, 80_000, 2)], "la  "), (5, [(0, 8, 2)], "A a"), (6, [(0, 13, 3)], "u v w x"),
    ]
    assert periodic.periodic_runs(docs.where("false"), ["doc_id"], "text").collect() == []
    made = periodic.with_repeats(docs, "doc_id", "text", every=1)
    assert made.columns == docs.columns
    told = {r["doc_id"]: r["text"] for r in made.collect()}
    assert told[2] is None and told[3] == "" and told[None] in (" \n\t", "é é é é é é")
