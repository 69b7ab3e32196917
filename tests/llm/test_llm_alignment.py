"""Token alignments against a plain walk over whole texts."""

import collections
import hashlib

import pytest
import sentencepiece
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import alignment
from tessera.llm.queries import QUERIES

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
LETTERS = {letter: bytes([b]) for letter, b in alignment._byte_of_letter().items()}


class Plain:
    """Whole texts, one by one, by the libraries that the vocabularies were made for."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)

    def tokens(self, text):
        if not text:
            return [], []
        coded = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, b"".join(LETTERS[c] for c in t)) for i, t in zip(coded.ids, coded.tokens, strict=True)]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == whole else ([], [])


def ends(tokens):
    at, found = 0, []
    for i, data in tokens:
        at += len(data)
        found.append((at, i))
    return found


def expected(texts):
    plain = Plain()
    counts, rows = collections.Counter(), []
    for text in texts:
        a, b = map(ends, plain.tokens(text))
        b_at = dict(b)
        links = [(i, b_at[end]) for end, i in a if end in b_at]
        counts.update(links)
        rows.append((a, b, links))
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for a, b, links in rows:
        shared = {end for end, _ in a} & {end for end, _ in b}
        sides = []
        for side in (a, b):
            parts = [[]]
            for at, i in side:
                parts[-1].append(str(i))
                if at in shared:
                    parts.append([])
            sides.append([",".join(p) for p in parts[:-1]])
        groups = ["|".join(x) for x in zip(*sides, strict=True)]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        best = sum(counts[x] == most[x[1]] for x in links)
        out.append((len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), digest))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_documents(spark):
    directory = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{directory}/documents.parquet").collect()
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_token_alignment"](spark, directory).collect()}
    assert found == dict(zip([r["doc_id"] for r in rows], expected([r["text"] for r in rows]), strict=True))


ODD = [
    None, "", " ", "  ", "\n", "\t", "a ", "a  ", " a", "  a  b ", "a\n\nb\n", "a\tb\t\tc", "x\r\ny\r\n\r\nz;\r w\r", "x \r y", "x\r", "\r",
    "<|endoftext|> a<|endoftext|>b", "<s> </s><unk> <0x0A>", "don't we'll I'VE 'tis", "café naïve 你好 \U0001f600x",
    "a b  c  d", "　x 　", "a\u0085b c", "a.\x1cb \x1f c", "\x00a \x00", "a▁b c", "▁", "é Å ﬁ",
    "def f(x):\n    return  x + 1;\n\tpass\n", "aaaa" * 50, "a\x0bb\x0cc", "12345 6789.50", "a᠎b ﻿c", "the same text", "the same text",
    " \n x", "\n x", "x\n \ny", "!!!???...", "lorem ipsum " * 5_000,
]


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "TOGETHER", 200)
    schema = "doc_id long, text string, key string, block int"
    docs = spark.createDataFrame([(i if i % 9 else None, t, "k", i) for i, t in enumerate(ODD)], schema)
    docs = docs.withColumns({"_key": F.lit(1), "n_a": F.lit("x"), "groups": F.lit(2), "copies": F.lit(0), "pairs": F.lit(0)})
    found = alignment.alignment_measures(docs.repartition(3), ["block", "doc_id", "n_a", "_key", "key"], "text")
    assert found.columns == ["block", "doc_id", "n_a", "_key", "key", "n_a_", *COLUMNS[1:]]
    rows = sorted(found.collect())
    assert [(r["doc_id"], r["n_a"], r["key"]) for r in rows] == [(i if i % 9 else None, "x", "k") for i in range(len(ODD))]
    plain = expected(ODD)
    for text, row, right in zip(ODD, rows, plain, strict=True):
        assert tuple(row)[5:] == right, text
    assert sum(r[0] == 0 for r in plain) == 4


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_measures(docs, ["doc_id"], "text").collect() == []
    blank = spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")
    assert [tuple(r) for r in alignment.alignment_measures(blank, ["doc_id"], "text").collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_remembered_chunks_may_go(monkeypatch):
    texts = [t for t in ODD[:-1] if t]
    one = alignment.Aligner(A, B)(texts)
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    aligner = alignment.Aligner(A, B)
    parts = [aligner([t]) for t in texts]
    assert one[1] == [p[1][0] for p in parts]
    assert one[0].tolist() == [p[0][0].tolist() for p in parts]


def test_vocabularies_that_cannot_be_cut(tmp_path):
    other = tmp_path / "other.json"
    text = open(A, encoding="utf-8").read()
    import json

    model = json.loads(text)
    model["model"]["merges"] = model["model"]["merges"][::-1]
    other.write_text(json.dumps(model), encoding="utf-8")
    with pytest.raises(ValueError, match="order"):
        alignment.byte_level(str(other))
