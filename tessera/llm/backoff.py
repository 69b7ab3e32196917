"""Stupid-backoff language-model scores, computed as joins of n-gram counts."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import written

#: Bytes of text whose words are counted together, and what a row counts beside its text.
BLOCK, ROW = 1 << 23, 16
#: Runs, repeats included, that meet in one part of the table of counts.
PART = 1 << 22
#: The begin of a text; no word has a space.
BEGIN = xxhash.xxh64_intdigest(b" ")


class Numbers(dict[bytes, int]):
    """Words by the order in which they were first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased: runs of anything but ASCII white space."""
    return (text or "").encode().lower().split()


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, high bytes of all of them together."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def expanded(data: bytes) -> np.ndarray:
    """The numbers that `squeezed` was given, as uint64."""
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(np.uint64)


def blocks_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(block, total, docs, words, hashes): the words of up to ``BLOCK`` bytes of texts and one more text.

    ``docs`` is an Arrow stream of ids and numbers of words, ``words`` the words as positions in
    ``hashes``, their 64-bit hashes, and ``total`` their number. The blocks are written, so that
    their numbers stay the same whatever is computed again.
    """

    def packed(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        number = Numbers()
        sizes, found = [], []
        for value in (t for batch in held for t in batch.column(1)):
            words = words_of(value.as_py())
            sizes.append(len(words))
            found.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
        ids = pa.chunked_array([batch.column(0) for batch in held]).combine_chunks()
        rows = pa.record_batch([ids, pa.array(sizes, pa.int64())], names=["doc_id", "words"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(rows)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
        binary = [sink.getvalue().to_pybytes(), squeezed(np.concatenate(found)), squeezed(hashes)]
        arrays = [pa.array([block]), pa.array([sum(sizes)]), *(pa.array([b], pa.binary()) for b in binary)]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "total", "docs", "words", "hashes"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []
        at = last = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW
            ends = at + np.cumsum(sizes)
            block, at = (ends - sizes) // BLOCK, int(ends[-1])
            cuts = np.flatnonzero(np.diff(block)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if held and block[start] != last:
                    yield packed(first + last, held)
                    held = []
                last = int(block[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield packed(first + last, held)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return written(rows.mapInArrow(dealt, "block long, total long, docs binary, words binary, hashes binary"))


class Runs:
    """The runs of up to ``order`` words of a block's texts, and how often each occurs there.

    A text with words has ``order`` - 1 begins before them; its places are the last begin, which
    ``first`` marks, and its words. ``doc`` is each place's text. ``gram`` are the distinct 64-bit
    hashes of the runs that end at the places, in order, ``own`` their numbers and ``codes`` the
    runs themselves as positions in ``gram``, length by length: at every place but the longest at
    the first.
    """

    def __init__(self, docs: bytes, words: bytes, hashes: bytes, order: int):
        self.rows = pa.ipc.open_stream(docs).read_all()
        self.words = self.rows.column("words").to_numpy()
        sizes = np.where(self.words > 0, self.words + order - 1, 0)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        every = np.full(len(place), BEGIN, dtype=np.uint64)
        every[place >= order - 1] = expanded(hashes)[expanded(words).astype(np.int64)]
        used = place >= max(0, order - 2)
        self.doc, self.first = doc[used], (place[used] == order - 2) & (order > 1)
        run, found = every, []
        for k in range(order):
            if k:
                # A run is hashed from the run before its last word, and that word.
                run = np.concatenate([every[:1], run[:-1]]) + np.uint64(k)
                run = (run ^ (run >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
                run = ((run ^ (run >> np.uint64(29))) + every) * np.uint64(0x94D049BB133111EB)
                run ^= run >> np.uint64(31)
            found.append(run[used] if k < order - 1 else run[used][~self.first])
        codes, gram = pd.factorize(np.concatenate(found))
        sorted_ = np.argsort(gram)
        place_of = np.empty(len(gram), dtype=np.int64)
        place_of[sorted_] = np.arange(len(gram))
        self.gram, self.codes = gram[sorted_], place_of[codes]
        self.own = np.bincount(self.codes, minlength=len(gram))

    def parts(self, many: int) -> Iterator[tuple[int, slice]]:
        """Which of ``many`` parts by hash hold runs, and where these are in ``gram``."""
        part = ((self.gram >> np.uint64(32)) * np.uint64(many)) >> np.uint64(32)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for start, end in itertools.pairwise(cuts):
            if start < end:
                yield int(part[start]), slice(start, end)


def added_counts(part: pa.Table) -> pa.Table:
    """(block, part, others): per block of a part, what the other blocks add to the counts of its runs."""
    steps, own = ([expanded(v.as_py()) for v in part.column(c)] for c in ("grams", "own"))
    codes, gram = pd.factorize(np.concatenate([np.cumsum(s, dtype=np.uint64) for s in steps]))
    every = np.concatenate(own).astype(np.int64)
    total = np.bincount(codes, weights=every, minlength=len(gram)).astype(np.int64)
    others = np.split(total[codes] - every, np.cumsum([len(o) for o in own])[:-1])
    arrays = [part.column("block"), part.column("part"), pa.array([squeezed(o) for o in others], pa.binary())]
    return pa.table(arrays, names=["block", "part", "others"]).filter(pa.array([bool(o.any()) for o in others]))


def backoff_scores(
    docs: DataFrame,
    doc_id: str,
    text: str,
    order: int = 3,
    least: int = 1,
    alpha: float = 0.4,
    leave_out: bool = True,
) -> DataFrame:
    """(doc_id, words, score): each document's mean log10 stupid-backoff score per word.

    Every word and every run of up to ``order`` words of all documents is counted, whatever the size
    of the input. A run of ``order`` words seen ``least`` times or more scores its count over that of
    the run without its last word; any other scores ``alpha`` times what the run without its first
    word does, down to a word's share of all words. The begin stands before a text as often as the
    first runs need. With ``leave_out`` a document's own occurrences are taken from every count that
    scores it, as a model that had not seen it would; a word that no other document has then counts
    as one. Null and texts without words have 0 words and a null score. Rows that repeat an id are
    rows of their own, and a repeated text is another document; no rows give none.

    Documents are dealt into written blocks of some megabytes. A block's distinct runs, each with
    its count there, go to the parts of the table of counts by their hash; a part sums them, joins
    the sums to the runs of each block and sends back what the others add to its counts. The block
    then sums its documents' scores. Runs travel packed, a row per block and part; there are as many
    parts as keep one at about ``PART`` runs. No row is empty, so at any size there are no more rows
    than runs, and a frequent run counts once per block. Only the number of words reaches the driver.
    """
    blocks = blocks_of(docs, doc_id, text)
    total = blocks.agg(F.sum("total")).first()[0] or 0
    parts = max(1, math.ceil(total * order / PART))

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, *packed = (c[row].as_py() for c in batch.columns)
                runs = Runs(*packed, order)
                found = [(p, np.diff(runs.gram[s], prepend=np.uint64(0)), runs.own[s]) for p, s in runs.parts(parts)]
                arrays = [
                    pa.array([p for p, _, _ in found], pa.int64()),
                    pa.array([block] * len(found), pa.int64()),
                    pa.array([squeezed(steps) for _, steps, _ in found], pa.binary()),
                    pa.array([squeezed(own) for _, _, own in found], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "block", "grams", "own"])

    def scored(block: pa.Table, other: pa.Table) -> pa.Table:
        runs = Runs(*(block.column(c)[0].as_py() for c in ("docs", "words", "hashes")), order)
        counts, doc, first = runs.own.copy(), runs.doc, runs.first
        where = dict(runs.parts(parts))
        for part, others in zip(other.column("part").to_pylist(), other.column("others"), strict=True):
            counts[where[part]] += expanded(others.as_py()).astype(np.int64)
        n, remain = counts[runs.codes], np.full(len(runs.words), total)
        if leave_out and len(n):
            holder = np.concatenate([*[doc] * (order - 1), doc[~first]])
            own, _ = pd.factorize(runs.codes * np.int64(len(runs.words)) + holder)
            n = n - np.bincount(own)[own]
            remain = remain - runs.words
        at = np.flatnonzero(~first)
        # Counts at the words' places, and at the places before them, length by length.
        levels = [n[k * len(doc) : (k + 1) * len(doc)] for k in range(order)]
        score = np.log10(np.maximum(levels[0][at], 1) / np.maximum(remain[doc[at]], 1))
        for k in range(1, order):
            seen = levels[k] if k == order - 1 else levels[k][at]
            ratio = np.maximum(seen, 1) / np.maximum(levels[k - 1][at - 1], 1)
            score = np.where(seen >= least, np.log10(ratio), math.log10(alpha) + score)
        sums = np.bincount(doc[at], weights=score, minlength=len(runs.words))
        mean = pa.array(sums / np.maximum(runs.words, 1), mask=runs.words == 0)
        return pa.table([runs.rows.column("doc_id"), runs.rows.column("words"), mean], names=["doc_id", "words", "score"])

    held = blocks.select("block", "docs", "words", "hashes")
    runs = held.mapInArrow(exploded, "part long, block long, grams binary, own binary")
    others = runs.groupBy("part").applyInArrow(added_counts, "block long, part long, others binary")
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema[0].dataType.simpleString()
    both = held.groupBy("block").cogroup(others.groupBy("block"))
    return both.applyInArrow(scored, f"doc_id {kind}, words long, score double")
