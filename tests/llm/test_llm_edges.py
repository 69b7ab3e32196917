"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import attention, backoff, chat, components, hosts, mixing, packing, pivots, sharding, simhash, topk
from tessera.llm.frames import found_again, row_key, row_numbers

LONG = "lorem ipsum dolor " * 60_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Repeated rows, an id with two texts, null ids, nulls in every column, empty and long texts.
ROWS = [
    (1, "The same text here", "en", "a", 18),
    (1, "The same text here", "en", "a", 18),
    (1, "Another text with this id", None, "b", 25),
    (2, "the SAME text   here", "en", None, None),
    (None, None, None, None, None),
    (None, "A text without any id", "en", "a", 21),
    (4, "", "en", "b", 0),
    (5, " \t\n", "de", "b", 3),
    (6, LONG, "la", "c", len(LONG)),
    (7, None, "en", "c", 0),
    (8, "word", "en", "a", 4),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns named like those the operators add."""
    names = ["size", "score", "_key", "_rows", "fp", "component", "component_id", "slot", "place", "target", "taken",
             "turn", "piece", "length", "host", "path", "label", "row", "node", "_chosen__id", "_own__key", "_turn", "_id"]
    return docs.withColumns({n: F.lit("x") for n in names})


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, None), (3, 0, 0), (None, 1, 1), (5, None, 1), (6, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int"
    )


def test_topk(spark):
    rows = [
        (0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []),
        (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [-1.0]), (None, [9.0, 9.0]), (9, [1e30, 0.0]),
    ]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, row int")
    vectors = topk.integer_vectors(table, "vec_id", "embedding")
    found = topk.top_inner_products(vectors, vectors.where("vec_id % 50 = 0"), 3, block=1).collect()
    by_query = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by_query[r["query_id"]].append((r["vec_id"], r["score"]))
    # The score of 1e30 fits no long; its rank is right.
    assert by_query == {0: [(9, None), (1, 65536), (50, 65536)], 50: [(9, None), (0, 65536), (1, 65536)]}
    assert topk.top_inner_products(vectors, vectors.where("vec_id = 51")).count() == 0
    nothing = topk.integer_vectors(empty(spark, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert topk.top_inner_products(nothing, nothing).columns == ["query_id", "rank", "vec_id", "score"]
    one = vectors.where("vec_id = 0")
    assert topk.top_inner_products(one, one).count() == 0


def test_topk_of_large_components_and_shared_ids(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [70000.0, 0.0]), (2, [90000.0, 0.0]), (3, [1e12, -1e12]), (4, [1e12, 1.0 - 1e12]),
        (5, [-1e300, 1e300]), (6, [1e308, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (100, [3e10, 1.0 / 256]), (7, [0.1, 0.2, 0.3]),
    ]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e")
    asked = vectors.where("vec_id % 50 = 0")
    for block, chunk in ((1, 2), (4096, 8192)):
        found = [tuple(r) for r in topk.top_inner_products(vectors, asked, 4, block=block, chunk=chunk).collect()]
        whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i != 6]
        expected = []
        for i, q in whole:
            if i % 50 == 0:
                scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in whole if j != i)[:4]
                expected += [(i, n, j, -s if abs(s) < 2**63 else None) for n, (s, j) in enumerate(scores, 1)]
        order = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted(found, key=order) == sorted(expected, key=order)


def test_topk_of_many_equal_vectors(spark):
    rows = [(i, [0.1 * (i % 3), 0.2]) for i in range(600)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e")
    found = topk.top_inner_products(vectors, vectors.where("vec_id in (0, 2)"), 4).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in found] == _best(rows, 0) + _best(rows, 2)


def _best(rows, query):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    scores = sorted((-sum(a * b for a, b in zip(whole[query], v, strict=True)), i) for i, v in whole.items() if i != query)
    return [i for _, i in scores[:4]]


def test_pivots(spark):
    rows = [
        (3, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (1, [1.0, 0.0], None), (0, [1.0, 0.0], 2), (4, None, 1),
        (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [0.0, 1.0], 1), (None, [1.0, 0.01], 1), (None, None, None), (9, [], 1),
        (10, [-0.0, 1.0], 1), (11, [None, 1.0], 1),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit("x"))
    found = pivots.near_duplicate_vectors(table, "vec_id", "embedding", "label").collect()
    got = sorted(tuple(-1 if x is None else x for x in r) for r in found)
    assert got == [
        (-1, 0, -1, False), (-1, 3, 2, False), (0, 0, 0, True), (1, 0, 1, True), (2, 3, 2, True), (2, 3, 2, True), (3, 3, 2, False),
        (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (9, 0, 9, True), (10, 1, 7, False), (11, 0, 11, True),
    ]
    nothing = empty(spark, "vec_id long, embedding array<float>, label int")
    assert pivots.near_duplicate_vectors(nothing, "vec_id", "embedding", "label").count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, part int"
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", None),
        (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 2, "user", ""),
        (4, 5, "user", "hi"), (5, None, "user", "hi"), (5, 2, None, "x"), (6, 2, None, "x"), (6, None, "user", "hi"),
        (None, 0, "user", "alone"), (None, 1, "user", "again"), (8, 0, "user", LONG),
    ]
    turns += [(9, k, "user", str(k)) for k in range(600)] + [(10, k, "user", str(k)) for k in range(599)]
    logs = spark.createDataFrame([(*t, 0) for t in turns], schema)
    kept = chat.maximal_conversations(logs, "conv_id", "turn", "role", "text").collect()
    assert {(r["conv_id"], r["turns"]) for r in kept} == {(2, 3), (3, 3), (5, 2), (None, 2), (8, 1), (9, 600)}
    found = {(r["conv_id"], r["part"]): r for r in chat.rendered(logs, "conv_id", "turn", "role", "text").collect()}
    assert found[2, 0]["text"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\n<|end|>\n"
    assert found[5, 0]["text"] == "<|user|>\nhi<|end|>\n<||>\nx<|end|>\n"
    assert [found[9, p]["turns"] for p in range(3)] == [256, 256, 88]
    assert "".join(found[9, p]["text"] for p in range(3)) == "".join(f"<|user|>\n{k}<|end|>\n" for k in range(600))
    assert len(found[8, 0]["text"]) > len(LONG)
    assert chat.rendered(empty(spark, schema), "conv_id", "turn", "role", "text").count() == 0


def test_mixing(spark, docs, clashing):
    for table in (docs, clashing.drop("size")):
        sized = table.withColumn("size", mixing.words(F.col("text")))
        pieces, rows = mixing.mixed(sized, ["doc_id"], "source", "size")
        found = rows.select("doc_id", "size", "source", "source_size", "target", "taken").collect()
        assert len(found) == len(ROWS)
        sizes = collections.Counter()
        for r in found:
            sizes[r["source"]] += r["size"]
            assert 0 <= r["taken"] <= 2 * r["size"]
        assert all(r["source_size"] == sizes[r["source"]] and r["target"] <= 2 * r["source_size"] for r in found)
        targets = {r["source"]: r["target"] for r in found}
        assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6
        assert targets["a"] == 2 * sizes["a"] and targets["b"] == 2 * sizes["b"]
        assert pieces.where("words < 1").count() == 0
    none = empty(spark).withColumn("size", mixing.words(F.col("text")))
    assert [x.count() for x in mixing.mixed(none, ["doc_id"], "source", "size")] == [0, 0]
    blank = docs.where("doc_id in (4, 5)").withColumn("size", mixing.words(F.col("text")))
    assert [r["taken"] for r in mixing.mixed(blank, ["doc_id"], "source", "size")[1].collect()] == [0, 0]


def test_sharding(spark, docs):
    found = sharding.feistel_shards(docs, ["doc_id", "text"], 4).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in found) == collections.Counter((r[0], r[1]) for r in ROWS)
    assert sorted((r["shard"], r["slot"]) for r in found) == sorted((k % 4, k // 4) for k in range(len(ROWS)))
    assert sharding.feistel_shards(empty(spark), ["doc_id"], 4).count() == 0
    many = spark.range(25_000).select(F.lit(3).alias("doc_id"))
    places = sharding.feistel_shards(many, ["doc_id"], 7).agg(F.count_distinct("shard", "slot"), F.max("slot")).first()
    assert tuple(places) == (25_000, 25_000 // 7)


def test_quality(spark, docs, clashing, labels):
    model = attention.learned(docs, labels, "doc_id", "text", "quality", longest=1 << 22)
    for table in (docs, clashing):
        found = attention.scored(table, ["doc_id"], "text", model).collect()
        assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 for r in found)
    assert attention.learned(docs, labels.where("false"), "doc_id", "text", "quality") is None
    assert attention.learned(empty(spark), labels, "doc_id", "text", "quality") is None
    assert {r["score"] for r in attention.scored(docs, ["doc_id"], "text", None).collect()} == {0.5}
    assert attention.scored(empty(spark), ["doc_id"], "text", model).count() == 0
    twice = spark.createDataFrame([(k // 2, f"text {k} " * (k + 1)) for k in range(60)], "doc_id long, text string")
    marks = spark.range(30).selectExpr("id AS doc_id", "int(id % 2) AS quality")
    learn = [attention.learned(t, marks, "doc_id", "text", "quality") for t in (twice, twice.orderBy(F.desc("text")).repartition(5))]
    assert all((a == b).all() for a, b in zip(learn[0].weights, learn[1].weights, strict=True))
    assert attention.learned(twice, marks, "doc_id", "text", "quality", budget=1) is None
    only_held_out = docs.select(attention.held_out(F.lit(None).cast("long")).alias("x")).first()
    assert only_held_out["x"]


def test_whole_text_counts():
    data = np.frombuffer((("good words here. " * 4000) + "%%%$$$ !!!! " * 400).encode(), dtype=np.uint8)
    sizes = np.array([len(data)])
    text, start, end = attention.passages(sizes)
    assert start[0] == 0 and end[-1] == len(data) and (start[1:] == end[:-1]).all() and (text == 0).all()


def test_simhash(spark, docs, clashing):
    prints = simhash.fingerprints(docs, ["doc_id"], "text")
    found = simhash.near_duplicates(prints, "doc_id", "fp").collect()
    assert len(found) == len(ROWS)
    by_print = collections.defaultdict(set)
    for r in found:
        by_print[r["fp"]].add(r["component_id"])
    assert by_print[0] == {4}  # null, empty and blank texts, ids 4, 5, 7 and null
    assert all(len(v) == 1 for v in by_print.values())
    for table in (docs, clashing):
        kept = simhash.representatives(table, "doc_id", "text")
        assert kept.columns == table.columns
        rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert collections.Counter(rows) == collections.Counter(
            [(1, ROWS[0][1]), (1, ROWS[2][1]), (None, ROWS[5][1]), (4, ""), (6, LONG), (8, "word")]
        )
    assert simhash.representatives(empty(spark), "doc_id", "text").count() == 0
    assert simhash.fingerprints_of(["", " \n", "a b", "A  B"]).tolist()[:2] == [0, 0]
    assert len(set(simhash.fingerprints_of(["a b", "A  B"]).tolist())) == 1
    # Counted in blocks or at once, a long text has one fingerprint.
    whole = simhash.fingerprints_of([LONG])
    blocks, simhash.COUNTED_TOGETHER = simhash.COUNTED_TOGETHER, 1000
    try:
        assert simhash.fingerprints_of([LONG]).tolist() == whole.tolist()
    finally:
        simhash.COUNTED_TOGETHER = blocks


def test_hosts(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTPS://WWW.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://notexample.org/en/1",
        "http://x.org", "http://x.org?/q", "http://x.com/de/#/fr/", "http://É.com:80/fr/a?b", "ftp://a://b/c", "http://bad.com/x",
    ]
    urls += ["http://bad.com/de/1"] * 200 + ["http://good.com/fr/1"] * 200
    rules = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("n", F.lit(1))
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in hosts.judged(pages, ["page_id"], "url", rules).collect()}
    assert [found[k] for k in range(4)] == [("", "", None, "allow")] * 4
    assert found[4] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert found[5] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert found[6] == ("notexample.org", "/en/1", "org/", "allow")
    assert found[7][:3] == ("x.org", "", None) and found[8][:3] == ("x.org", "", None)
    assert found[9] == ("x.com", "/de/", "com/de/", "block")
    assert found[10][:2] == ("É.com:80", "/fr/a")
    assert found[11][:2] == ("a:", "//b/c")
    assert found[12] == ("bad.com", "/x", None, "block")
    assert hosts.judged(empty(spark, "page_id long, url string"), ["page_id"], "url", rules).count() == 0


def test_reputation_shrinks(spark):
    seen = [("a.x.com", 1)] * 90 + [("b.x.com", 0)] + [("c.y.com", 0)] * 60 + [("d.y.com", None)]
    outcomes = spark.createDataFrame(seen, "host string, good int")
    found = {r["host"]: r for r in hosts.reputations(outcomes, outcomes, "host", "good").collect()}
    assert found["a.x.com"]["mean"] > 0.9 > found["b.x.com"]["mean"] > found["c.y.com"]["mean"]
    assert found["d.y.com"]["mean"] < 0.5 and found["d.y.com"]["high"] > found["c.y.com"]["high"]
    assert all(0 <= r["low"] <= r["mean"] <= r["high"] <= 1 for r in found.values())


def test_backoff(spark, docs, clashing):
    for table in (docs, clashing):
        found = backoff.backoff_scores(table, "doc_id", "text").collect()
        assert len(found) == len(ROWS)
        assert all((r["score"] is None) == (r["words"] == 0) for r in found)
        assert max(r["words"] for r in found) == 180_000
    assert backoff.backoff_scores(empty(spark), "doc_id", "text").count() == 0
    assert [tuple(r) for r in backoff.backoff_scores(docs.where("doc_id = 4"), "doc_id", "text").collect()] == [(4, 0, None)]


def test_packing(spark, docs):
    pieces = packing.token_pieces(docs, "doc_id", "text")
    found = packing.packed(packing.digests(pieces), "length").collect()
    ones = [r for r in found if r["length"] == 1 and r["start"] == 0]
    assert len(ones) == 4 and len({r["ids_crc32"] for r in ones}) == 1
    assert sum(r["piece"] == 0 for r in found) == len(ROWS)
    places = collections.defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in places.values():
        end = 0
        for offset, length in sorted(rows):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.packed(packing.token_pieces(empty(spark), "doc_id", "text"), "length").count() == 0


def test_components(spark):
    links = [(1, 2), (2, 1), (2, 3), (5, 5), (7, 6), (None, 1), (4, None), (7, 8), (8, 9)] + [(k, k + 1) for k in range(20, 90)]
    found = components.components(spark.createDataFrame(links, "a long, b long"), "a", "b")
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 6, 7: 6, 8: 6, 9: 6, **dict.fromkeys(range(20, 91), 20)}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_row_numbers_of_one_group(spark):
    rows = spark.range(3000).withColumn("g", F.lit(1))
    found = row_numbers(rows, ["g"], F.expr("id div 100"), [F.col("id")], "n").where("id <> n").count()
    assert found == 0


def test_found_again(docs):
    chosen = docs.groupBy(F.col("doc_id").alias("_id"), row_key(F.col("text")).alias("_key")).agg(F.count("*").alias("_rows"))
    found, _ = found_again(docs, {"_id": F.col("doc_id"), "_key": row_key(F.col("text"))}, chosen, [])
    assert collections.Counter((r[0], r[1]) for r in found.collect()) == collections.Counter({(r[0], r[1]) for r in ROWS})


@pytest.mark.parametrize("kind", ["odd", "clashing", "empty"])
def test_stages(spark, docs, clashing, labels, tmp_path, kind):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    table = {"odd": docs, "clashing": clashing, "empty": empty(spark)}[kind]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        found = stage(spark, table, str(tmp_path))
        assert found.columns == table.columns and [f.dataType for f in found.schema] == [f.dataType for f in table.schema]
        found.write.parquet(f"{tmp_path}/{n}")
        table = spark.read.parquet(f"{tmp_path}/{n}")
    packed = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).collect()
    assert sum(r["piece"] == 0 for r in packed) == table.count()
