"""Queries without SQL against plain Python over the same tables."""

import collections
import zlib

import numpy as np
import pytest
import xxhash
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import attention, backoff, mixing, packing, pivots, sharding, simhash
from tessera.llm.queries import QUERIES

DIRECTORY = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{DIRECTORY}/documents.parquet").collect()
    return {r["doc_id"]: r for r in rows}


def fingerprint(text, width=3):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(keys, links):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_simhash(spark, documents):
    found = {r["doc_id"]: r for r in QUERIES["op7_simhash_trie"](spark, DIRECTORY).collect()}
    assert set(found) == set(documents)
    prints = {i: int(r["fingerprint"], 16) for i, r in found.items()}
    for i in list(documents)[:150]:
        # bytes.lower() folds A-Z only, and split() knows the six ASCII white spaces.
        assert prints[i] == int(np.uint64(simhash.fingerprints_of([documents[i]["text"]])[0].view(np.uint64)))
        value = fingerprint(documents[i]["text"])
        assert f"{int.from_bytes(value.to_bytes(8, 'little'), 'little'):016x}" == found[i]["fingerprint"]
    ids = sorted(prints)
    close = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert close
    expected = grouped(ids, close)
    assert {i: r["component_id"] for i, r in found.items()} == expected


@pytest.mark.parametrize("level", [0, 2])
def test_trie_finds_every_close_pair(level):
    random = np.random.RandomState(3)
    centre = random.randint(0, 1 << 62, 12).astype(np.uint64)
    flips = [np.uint64(1 << b) for b in random.randint(0, 64, 400)]
    values = np.unique(np.array([centre[k % 12] ^ f ^ flips[(k * 7) % 400] for k, f in enumerate(flips)] + list(centre)))
    top = (values >> np.uint64(64 - level)) if level else np.zeros(len(values), dtype=np.uint64)
    found = set()
    for a in np.unique(top):
        for b in np.unique(top[top >= a]):
            left, right = values[top == a], values[top == b]
            for i, j in simhash.close_pairs(left, right, a == b, level, 2):
                pairs = list(zip(left[i].tolist(), right[j].tolist(), strict=True))
                assert not found & set(pairs)
                found |= set(pairs)
    plain = values.tolist()
    assert found == {(a, b) for n, a in enumerate(plain) for b in plain[n + 1 :] if (a ^ b).bit_count() <= 2}


def test_levels_of_the_trie_agree(spark, monkeypatch):
    prints = QUERIES["op7_simhash_trie"](spark, DIRECTORY).selectExpr("cast(conv(fingerprint, 16, -10) as long) fp", "doc_id")
    prints = prints.where("doc_id % 3 > 0")
    one = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(prints, "doc_id", "fp").collect()}
    monkeypatch.setattr(simhash, "SUBTREE", 64)
    many = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(prints, "doc_id", "fp").collect()}
    assert one == many


def test_shards(spark, documents):
    rows = QUERIES["op5_feistel_shards"](spark, DIRECTORY).collect()
    assert {r["doc_id"] for r in rows} == set(documents) and len(rows) == len(documents)
    for r in rows:
        text = (documents[r["doc_id"]]["text"] or "").encode()
        assert r["size"] == len(text) + 16 and r["text_crc32"] == zlib.crc32(text)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = spark.read.parquet(f"{DIRECTORY}/documents.parquet").repartition(7)
    columns = ["doc_id", "n_chars"]
    first = sharding.feistel_shards(again, columns, 40).collect()
    second = sharding.feistel_shards(again.repartition(3, "source"), columns, 40).collect()
    assert sorted(first) == sorted(second)


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_permutation_hits_every_place_once(count):
    places = sharding.permuted(np.arange(count), count, 5)
    assert sorted(places.tolist()) == list(range(count))
    if count > 100:
        assert abs(np.corrcoef(np.arange(count), places)[0, 1]) < 0.2


def test_packing(spark, documents):
    encoder = Tokenizer.from_file(path("word_bpe_49k.json"))
    pieces = collections.defaultdict(dict)
    sequences = collections.defaultdict(list)
    for r in QUERIES["op10_best_fit"](spark, DIRECTORY).collect():
        pieces[r["doc_id"]][r["piece"]] = r
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(documents)
    for i in list(documents)[::4]:
        ids = [*encoder.encode(documents[i]["text"], add_special_tokens=False).ids, 0]
        cut = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert len(cut) == len(pieces[i])
        for k, part in enumerate(cut):
            r = pieces[i][k]
            assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * k, len(part), packing.ids_checksum(part))
    total = 0
    for rows in sequences.values():
        rows = sorted(rows, key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in rows])
        assert [r["offset"] for r in rows] == [0, *ends[:-1]] and ends[-1] <= 2048
        total += ends[-1]
    assert len(sequences) <= 1.02 * total / 2048 + 1


def test_best_fit_takes_the_tightest_bin():
    random = np.random.RandomState(2)
    for _ in range(100):
        capacity = int(random.choice([5, 8, 31, 2048]))
        lengths = sorted(random.randint(1, capacity + 1, random.randint(0, 150)).tolist(), reverse=True)
        rooms = []
        for length, into, offset in zip(lengths, *packing.best_fit(lengths, capacity), strict=True):
            fitting = [room for room in rooms if room >= length]
            if fitting:
                assert rooms[into] == min(fitting)
            else:
                assert into == len(rooms)
                rooms.append(capacity)
            assert offset == capacity - rooms[into]
            rooms[into] -= length


@pytest.mark.parametrize("lengths", [(1500, 548), (1400, 648), (1030, 1018), (2048,), (1, 2, 3, 5, 700, 1024, 1025, 2047)])
def test_packing_is_one_best_fit_over_all_partitions(spark, lengths):
    rows = [(i, lengths[i * 7 % len(lengths)]) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "offset long, length int").repartition(13).withColumn("_row", F.lit("kept"))
    found = packing.packed(pieces.withColumn("id", F.col("offset")), "length").collect()
    assert sorted(r["id"] for r in found) == list(range(3000)) and {r["_row"] for r in found} == {"kept"}
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    bins, _ = packing.best_fit(sorted((n for _, n in rows), reverse=True), 2048)
    assert sorted(sequences) == list(range(max(bins) + 1))


def test_stretches_do_not_grow_with_the_pieces():
    random = np.random.RandomState(3)
    kinds = {n: int(random.randint(1, 50)) for n in range(1, 2049)}
    few = packing.best_fit_stretches(kinds, 2048)
    many = packing.best_fit_stretches({n: 10**9 * c + int(random.randint(1000)) for n, c in kinds.items()}, 2048)
    assert len(few) < 8 * 2048 and len(many) < 8 * 2048


def test_lengths_outside_fail(spark):
    for wrong in (None, 0, 2049, -1):
        with pytest.raises(ValueError, match="1 to 2048"):
            packing.packed(spark.createDataFrame([(1,), (wrong,)], "length long"), "length")


def test_chunks_encode_like_the_tokenizer():
    file = path("word_bpe_49k.json")
    whole, by_chunk = Tokenizer.from_file(file), packing.ChunkEncoder(file)
    assert by_chunk.by_chunk
    random = np.random.RandomState(1)
    letters = list("abzAZ'sStTreREveVE09 \t\n.,!%|<>_-éÈñßŸİſŉǅΣσςА ́̇\x85\xa0​\x1c\x00ªº²½\xad각😀ĳ")
    texts = ["".join(random.choice(letters, random.randint(0, 30))) for _ in range(3000)]
    texts += ["<|endoftext|> a<|startoftext|>b", "", "x" * 5000, *map(chr, range(1, 0x250))]
    for text in texts:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert by_chunk(text) == np.array(ids, dtype="<u4").tobytes()


def test_plain_words_are_cut_without_the_pattern(monkeypatch):
    file = path("word_bpe_49k.json")
    whole, by_chunk = Tokenizer.from_file(file), packing.ChunkEncoder(file)
    cut, seen = packing.CUT, []
    monkeypatch.setattr(packing, "CUT", lambda text: seen.append(text) or cut(text))
    simple = [c for c in map(chr, range(0x21, 0x180)) if packing.SIMPLE(c)]
    plain = ["word", "Straße", "étÉ", "naïve.", "end,", "s'", "x9", "ŉa", "word²", "º", "."]
    for text in [*plain, *[f"{c}{d}" for c in "aÉſ" for d in simple], *[f"Wort{d}" for d in simple]]:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert by_chunk(text) == np.array(ids, dtype="<u4").tobytes(), text
    assert all(len(text) < 2 for text in seen)
    assert by_chunk("it's") == np.array(whole.encode("it's", add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert seen[-1] == "it's"


def test_quality_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIRECTORY}/labels.parquet").collect()}
    rows = QUERIES["op6_attention_quality"](spark, DIRECTORY).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    tested = [(labels[r["doc_id"]], r["predicted"], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    bad, good = [t for t in tested if t[0] == 0], [t for t in tested if t[0] == 1]
    assert sum(t[1] for t in good) >= 0.97 * len(good)
    assert sum(1 - t[1] for t in bad) >= 0.85 * len(bad)
    assert np.mean([g[2] > b[2] for g in good for b in bad]) > 0.98


def test_gradients_of_the_network():
    random = np.random.RandomState(0)
    data = np.frombuffer(bytes(random.randint(32, 126, 9000).tolist()), dtype=np.uint8)
    sizes, labels = np.array([4000, 0, 3000, 2000]), np.array([1.0, 0.0, 1.0, 0.0])
    model = attention.trained(data, sizes, labels, hidden=3, steps=2)
    text, start, end = attention.passages(sizes)
    x = (attention.encoded(data, start, end) - model.mean).astype(np.float64) * model.scale
    first = np.flatnonzero(np.diff(text, prepend=-1))
    weights = [w.astype(np.float64) for w in model.weights]

    def loss(w):
        h, e = attention.GatedAttention(np.zeros(1), np.ones(1), tuple(w))._passages(x)[:2]
        p = attention._sigmoid(attention._pooled(h, e, text, first)[0] @ w[6] + w[7][0])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = attention._gradients(tuple(weights), x, labels, text, first)
    for k, w in enumerate(weights):
        at = tuple(random.randint(0, n) for n in w.shape)
        moved = [v.copy() for v in weights]
        moved[k][at] += 1e-6
        assert abs((loss(moved) - loss(weights)) / 1e-6 - grads[k][at]) < 1e-5


def test_pivot_index_recall(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 100)
    random = np.random.RandomState(4)
    rows = spark.read.parquet(f"{DIRECTORY}/embeddings.parquet").collect()
    values = [np.array(r["embedding"], dtype=np.float64) for r in rows]
    labels = [r["label"] for r in rows]
    for k in range(200):
        for noise in (0.005, 0.02, 0.024, 0.03):
            values.append(values[k] * random.uniform(0.5, 2) + random.normal(0, noise, 64))
            labels.append(labels[k])
    # One large group of near copies.
    values += [values[0] + random.normal(0, 0.012, 64) for _ in range(400)]
    labels += [labels[0]] * 400
    order = random.permutation(len(values)).tolist()
    table = [(order[i], v.astype(np.float32).tolist(), labels[i]) for i, v in enumerate(values)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    result = pivots.near_duplicate_vectors(frame, "vec_id", "embedding", "label").collect()
    found = {r["vec_id"]: r for r in result}
    unit = pivots.unit_rows(np.array([r[1] for r in table], dtype=np.float32).astype(np.float64))
    ids, labels = [r[0] for r in table], np.array(labels)
    close = (unit @ unit.T >= 0.98) & (labels[:, None] == labels) & ~np.eye(len(ids), dtype=bool)
    expected, got = close.sum(axis=1), np.array([found[i]["n_links"] for i in ids])
    assert expected.sum() > 10_000 and (got <= expected).all()
    assert got.sum() >= 0.99 * expected.sum()
    groups = grouped(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(close), strict=True)])
    assert sum(found[i]["component_id"] == groups[i] for i in ids) >= 0.99 * len(ids)


def test_mix_pieces_are_the_schedule(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    sized = docs.select("doc_id", "source", mixing.words(docs["text"]).alias("size"))
    pieces, rows = mixing.mixed(sized, ["doc_id"], "source", "size", slots=4096)
    taken = collections.Counter()
    by_slot = collections.defaultdict(int)
    for p in pieces.collect():
        taken[p["doc_id"]] += p["words"]
        by_slot[p["slot"]] += p["words"]
    found = rows.collect()
    assert all(taken[r["doc_id"]] == r["taken"] <= 2 * r["size"] for r in found)
    # All slots but a source's last block of a pass are equally long.
    block = max(by_slot.values())
    assert np.mean([w == block for w in by_slot.values()]) > 0.98
    sums, targets = collections.Counter(), {}
    for r in found:
        sums[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    assert all(abs(sums[s] - t) <= 0.02 * t for s, t in targets.items())
    assert abs(sum(targets.values()) - 1.5 * sum(r["size"] for r in found)) < 1


def test_backoff_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a B"), (2, "a c"), (3, None), (4, "")], "doc_id int, text string")
    found = {r["doc_id"]: r for r in backoff.backoff_scores(docs, "doc_id", "text", order=2).collect()}
    # The other text's words: for 1 a and c with one begin, for 2 a and b twice with one begin.
    log = np.log10
    assert found[1]["words"] == 4 and found[3]["words"] == 0 and found[3]["score"] is None
    one = log(1 / 1) + log(0.4 * 1 / 2) + log(0.4 * 1 / 2) + log(0.4 * 1 / 2)
    assert abs(found[1]["score"] - one / 4) < 1e-12
    assert abs(found[2]["score"] - (log(1 / 1) + log(0.4 * 1 / 4)) / 2) < 1e-12
    assert found[4]["score"] is None


@pytest.mark.parametrize("large", [1_000_000, 20_000_000])
def test_small_sources_of_a_large_mix(spark, large):
    # A block of the large sources is longer than all words of "few", "one" and "tiny".
    rows = [(i, "ab"[i % 2], large) for i in range(200)]
    rows += [(1000 + i, "tiny", 10) for i in range(5)] + [(2000 + i, "few", 25) for i in range(8)] + [(3000, "one", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    pieces, found = mixing.mixed(docs, ["doc_id"], "source", "size")
    found = found.collect()
    taken, targets = collections.Counter(), {r["source"]: r["target"] for r in found}
    for r in found:
        taken[r["source"]] += r["taken"]
    assert len(found) == len(rows) and set(taken) == {"a", "b", "few", "one", "tiny"}
    assert all(abs(taken[s] - t) <= max(0.5, 0.01 * t) for s, t in targets.items())
    slots = pieces.groupBy("slot").agg({"place": "min", "block": "max"}).count()
    assert slots == pieces.select("slot", "place", "block").distinct().count()


def backoff_in_python(texts, order, least, leave_out, alpha=0.4):
    words = [t.encode().lower().split() for t in texts]

    def runs_in(w):
        padded, counts = [b" "] * (order - 1) + w, collections.Counter()
        for i in range(order - 1, len(padded)):
            counts.update(tuple(padded[i - k : i + 1]) for k in range(order))
        counts.update([(b" ",) * k for k in range(1, order)] if w else [])
        return counts

    everywhere, total = sum(map(runs_in, words), collections.Counter()), sum(map(len, words))
    scores = []
    for w in words:
        counts, left = everywhere, total
        if leave_out:
            counts, left = everywhere - runs_in(w), max(1, total - len(w))

        def score(run, counts=counts, left=left):
            if len(run) == 1:
                return np.log10(max(1, counts[run]) / left)
            if counts[run] >= least:
                return np.log10(counts[run] / counts[run[:-1]])
            return np.log10(alpha) + score(run[1:])

        padded = [b" "] * (order - 1) + w
        scores.append(np.mean([score(tuple(padded[i - order + 1 : i + 1])) for i in range(order - 1, len(padded))]) if w else None)
    return scores


@pytest.mark.parametrize("leave_out", [True, False])
def test_backoff_counts_every_word(spark, leave_out):
    # More words than any vocabulary had; two texts of rare words, one of them repeated.
    texts = [" ".join(f"w{i}" for i in range(k, 20_000, 7)) for k in range(7)]
    texts += ["w1 w2 w3 w1 w2 w3", "w1 w2 w3", "", "rare words here", "rare words here", "the only"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    scores = backoff.backoff_scores(docs, "doc_id", "text", order=2, least=2, leave_out=leave_out)
    found = {r["doc_id"]: r for r in scores.collect()}
    expected = backoff_in_python(texts, 2, 2, leave_out)
    assert len(found) == len(texts) and found[9]["words"] == 0 and found[9]["score"] is None
    assert all(abs(found[i]["score"] - e) < 1e-9 for i, e in enumerate(expected) if e is not None)


@pytest.mark.parametrize(("order", "least", "leave_out", "block"), [(3, 1, True, 40), (3, 2, False, 1), (4, 1, True, 1 << 22), (1, 1, True, 40)])
def test_backoff_by_more_words(spark, monkeypatch, order, least, leave_out, block):
    monkeypatch.setattr(backoff, "BLOCK", block)
    texts = ["a b c a b d", "A b c", "b c a", "x", "", "b d", "a b c a b d", "q r s t u"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    more = {"order": order, "least": least, "leave_out": leave_out}
    found = {r["doc_id"]: r["score"] for r in backoff.backoff_scores(docs, "doc_id", "text", **more).collect()}
    expected = backoff_in_python(texts, order, least, leave_out)
    assert all((found[i] is None and e is None) or abs(found[i] - e) < 1e-9 for i, e in enumerate(expected))


def test_backoff_tells_repeated_texts(spark, documents):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    copies = docs.where("doc_id % 10 = 0").withColumn("doc_id", -1 - F.col("doc_id"))
    scores = backoff.backoff_scores(docs.unionByName(copies), "doc_id", "text", order=2).collect()
    copied = [r["score"] for r in scores if r["doc_id"] < 0 and r["words"] >= 50]
    texts = collections.Counter(d["text"] for d in documents.values())
    alone = {i for i, d in documents.items() if i % 10 and texts[d["text"]] == 1}
    single = [r["score"] for r in scores if r["doc_id"] in alone and r["words"] >= 50]
    assert np.mean(np.array(copied) > np.quantile(single, 0.9)) > 0.9


def test_pipeline(spark, documents):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    good = stages["quality"](spark, docs, DIRECTORY)
    scored = {r["doc_id"]: r["predicted"] for r in QUERIES["op6_attention_quality"](spark, DIRECTORY).collect()}
    good = spark.createDataFrame(good.collect(), docs.schema)
    assert good.columns == docs.columns
    assert {r["doc_id"] for r in good.collect()} == {i for i, p in scored.items() if p}
    single = stages["near_duplicates"](spark, good, DIRECTORY)
    kept = single.collect()
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in good.collect()}
    ids = sorted(prints)
    close = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {r["doc_id"] for r in kept} == set(grouped(ids, close).values())
    assert len(kept) == len({r["doc_id"] for r in kept}) and single.columns == docs.columns
    single = spark.createDataFrame(kept, docs.schema)
    mixed = stages["mix"](spark, single, DIRECTORY)
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns and max(copies.values()) <= 2
    words = sum(len(documents[i]["text"].encode().split()) * n for i, n in copies.items())
    assert abs(words / (1.5 * sum(len(r["text"].encode().split()) for r in kept)) - 1) < 0.05
    rows = corpus_pipeline.run(spark, DIRECTORY).collect()
    assert collections.Counter(r["doc_id"] for r in rows if r["piece"] == 0) == copies
