"""Alignment of two tokenizers' tokens over the distinct texts of a corpus."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import free_name, written

#: Chunks that a worker remembers, and bytes of text whose pairs are counted together.
REMEMBERED, TOGETHER = 1 << 18, 1 << 22
#: Chunks of a text: white space, then up to the next. Other white space than these three stays inside.
CHUNKS = re.compile(r"[ \n\t]*\S*(?:[^\S \n\t][ \n\t]*\S*)*").findall
#: Fixed value: the pattern by which the byte-level vocabulary cuts words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_level(path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The byte-level vocabulary at ``path`` with the bytes of each id; special tokens are plain text.

    Merges are taken by the number of what they make, as in the file the n-th merge makes the n-th id
    after the bytes; another file is refused.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters = _byte_of_letter()
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"][a + b] != 256 + k for k, (a, b) in enumerate(merges)):
        raise ValueError(f"the merges of {path} are not in the order of their ids")
    encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding, sorted(ranks, key=ranks.__getitem__)


class Aligner:
    """Tokens of both vocabularies and their links, for blocks of texts.

    A's words and B's pieces never go on from a character to a space, line feed or tab that follows,
    as no piece of B holds such a place (checked here), so a text's tokens are those of its chunks in
    a row. Chunks are encoded once, those that are new to a block together, and remembered.
    """

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, a_bytes = byte_level(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        b_bytes = []
        cut = re.compile(r"[^▁][▁ \n\t]|.[ \n\t]")
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                b_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                b_bytes.append(piece.replace("▁", " ").encode())
                if cut.search(piece):
                    raise ValueError(f"piece {piece!r} of {b_path} goes over the end of a chunk")
        self.b_bytes = b_bytes
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (a_bytes, b_bytes))
        # Each id's digits with what may follow: another token of its side, the other side, a group.
        self.digits = [[b"%d%s" % (i, end) for i in range(n) for end in (b",", b"|", b";")] for n in (len(a_bytes), len(b_bytes))]
        self.space = self.b.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.n_a = self.n_b = self.n_links = np.empty(0, dtype=np.int64)
        self.link_at, self.pairs = np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int64)

    def pieces(self, chunks: list[str]) -> list[list[int] | None]:
        """B's ids of each chunk as they are inside a text; None where their bytes are others."""
        # B puts a space before a text, which is the chunk's own if it begins with one.
        coded = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        found: list[list[int] | None] = []
        for chunk, ids in zip(chunks, coded, strict=True):
            if chunk == " ":
                ids = [self.space]
            elif chunk[0] != " ":
                if ids[:1] != [self.space]:
                    found.append(None)
                    continue
                ids = ids[1:]
            same = b"".join([self.b_bytes[i] for i in ids]) == chunk.encode()
            found.append(ids if same else None)
        return found

    def learn(self, chunks: list[str]) -> None:
        """Encode and align new chunks; one whose bytes B changes has no link and is marked by -1."""
        b_ids = self.pieces(chunks)
        a_ids = [self.a.encode_ordinary(c) if b is not None else [] for c, b in zip(chunks, b_ids, strict=True)]
        b_ids = [b if b is not None else [] for b in b_ids]
        n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (a_ids, b_ids))
        a, b = (np.array([i for x in ids for i in x], dtype=np.int64) for ids in (a_ids, b_ids))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        if len(a) and not np.array_equal(a_end[np.cumsum(n_a) - 1], b_end[np.cumsum(n_b) - 1]):
            raise ValueError("A's tokens have other bytes than their text")
        # Tokens end together where both have the same number of bytes before them.
        a_last, b_last = np.isin(a_end, b_end), np.isin(b_end, a_end)
        pairs = a[a_last] * len(self.b_size) + b[b_last]
        chunk_of = np.repeat(np.arange(len(chunks)), n_a)
        n_links = np.bincount(chunk_of[a_last], minlength=len(chunks))
        # Groups as text: A's tokens of a group, then B's.
        group = np.r_[np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last]
        side = np.r_[np.zeros(len(a), dtype=np.int64), np.ones(len(b), dtype=np.int64)]
        end = np.r_[a_last * 1, b_last * 2]
        order = np.lexsort((side, group))
        text = [self.digits[s][i] for s, i in zip(side[order].tolist(), (np.r_[a, b] * 3 + end)[order].tolist(), strict=True)]
        upto = np.cumsum(n_a + n_b).tolist()
        self.groups += [b"".join(text[x:y])[:-1] for x, y in zip([0, *upto], upto, strict=False)]
        self.known.update(zip(chunks, range(len(self.n_a), len(self.n_a) + len(chunks)), strict=True))
        wrong = n_b == 0
        self.n_a = np.r_[self.n_a, np.where(wrong, -1, n_a)]
        self.n_b, self.n_links = np.r_[self.n_b, n_b], np.r_[self.n_links, n_links]
        self.link_at = np.r_[self.link_at, self.link_at[-1] + np.cumsum(n_links)]
        self.pairs = np.r_[self.pairs, pairs]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For texts that are not empty: (n_a, n_b, n_links) of each, groups as digests, links.

        Links are (text, pair) one by one; a text that has no tokens has zeros and an empty digest.
        """
        if len(self.known) > REMEMBERED:
            self.forget()
        chunks = [c for text in texts for c in CHUNKS(" " + text)]
        # Each text's chunks end with an empty one, where the search has come to its end.
        ends = [k for k, c in enumerate(chunks) if not c]
        known = self.known
        new = [c for c in dict.fromkeys(chunks) if c and c not in known]
        if new:
            self.learn(new)
        places = [known[c] for c in chunks if c]
        index = np.array(places, dtype=np.int64)
        sizes = np.diff(np.r_[-1, ends]) - 1
        text_of = np.repeat(np.arange(len(texts)), sizes)
        wrong = np.zeros(len(texts), dtype=bool)
        wrong[text_of[self.n_a[index] < 0]] = True
        right = ~wrong[text_of]
        index, text_of = index[right], text_of[right]
        counts = np.stack([np.bincount(text_of, x[index], len(texts)).astype(np.int64) for x in (self.n_a, self.n_b, self.n_links)], axis=1)
        upto = np.r_[0, np.cumsum(sizes)].tolist()
        groups = self.groups
        digests = [
            "" if w else hashlib.sha256(b";".join([groups[i] for i in places[x:y]])).hexdigest()
            for w, x, y in zip(wrong.tolist(), upto, upto[1:], strict=False)
        ]
        many = self.n_links[index]
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return counts, digests, np.repeat(text_of, many), self.pairs[np.repeat(self.link_at[index], many) + offset]


def text_key(text: Column) -> Column:
    """Digest by which an exact text is known beside the text itself."""
    return F.unhex(F.sha2(text, 256))


TABLE = "block binary, key binary, n_a long, n_b long, n_links long, groups string, pairs array<int>, links array<long>"


def aligned(distinct: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Alignments of ``distinct`` (text, key, copies): a row per text, and one per block of texts.

    A text's row has its counts, the digest of its groups, and its links as (number of the pair in the
    block, how often). A block's row (null key) has the block's distinct pairs and their links, each
    text's as often as it has ``copies``. A pair is A's id times B's ids, plus B's. A block is named
    after its first text and holds about ``TOGETHER`` bytes, or one longer text.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for batch in batches:
            size = at = 0
            lengths = batch.column(0).cast(pa.large_binary()).to_pylist()
            for row, value in enumerate(lengths):
                size += len(value)
                if size < TOGETHER and row + 1 < batch.num_rows:
                    continue
                yield block(aligner, batch.slice(at, row + 1 - at))
                size, at = 0, row + 1

    def block(aligner: Aligner, part: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, text_of, pair = aligner(part.column(0).to_pylist())
        pairs, number = np.unique(pair, return_inverse=True)
        weight = np.bincount(number, part.column(2).to_numpy().astype(np.float64)[text_of], len(pairs))
        both, often = np.unique(text_of * max(len(pairs), 1) + number, return_counts=True)
        upto = np.searchsorted(both, np.arange(len(digests) + 1) * max(len(pairs), 1))
        rows = len(digests)
        lists = np.r_[upto, upto[-1] + len(pairs)].astype(np.int32)
        names = pa.array([part.column(1)[0].as_py()] * (rows + 1), pa.binary())
        of_pairs = np.r_[both % max(len(pairs), 1), pairs].astype(np.int32)
        of_links = np.r_[often, weight.astype(np.int64)]
        return pa.RecordBatch.from_arrays(
            [
                names,
                pa.array([*part.column(1).to_pylist(), None], pa.binary()),
                *(pa.array(np.r_[counts[:, c], 0]) for c in range(3)),
                pa.array([*digests, None], pa.string()),
                pa.ListArray.from_arrays(pa.array(lists), pa.array(of_pairs)),
                pa.ListArray.from_arrays(pa.array(lists), pa.array(of_links)),
            ],
            names=["block", "key", "n_a", "n_b", "n_links", "groups", "pairs", "links"],
        )

    return distinct.select("text", "key", "copies").mapInArrow(align, TABLE)


def pair_model(table: DataFrame, b_ids: int) -> DataFrame:
    """(pair, n, best): the corpus's links of each pair, and whether it has the most of its B id."""
    blocks = table.where("key is null").select(F.explode(F.arrays_zip("pairs", "links")).alias("x"))
    counts = written(blocks.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.links").alias("n")))
    most = counts.groupBy((F.col("pair") % b_ids).alias("b")).agg(F.max("n").alias("most"))
    joined = counts.withColumn("b", F.col("pair") % b_ids).join(most, "b")
    return joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _measures(texts: pa.Table, model: pa.Table) -> pa.Table:
    """Links of best pairs and the sum of counts of each text of a block."""
    at = model.column("at").to_numpy()
    n, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    n[at], best[at] = model.column("n").to_numpy(), model.column("best").to_numpy(zero_copy_only=False)
    pairs, links = (texts.column(c).combine_chunks() for c in ("pairs", "links"))
    sizes = np.diff(pairs.offsets.to_numpy())
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    number, often = pairs.flatten().to_numpy(), links.flatten().to_numpy()
    sums = []
    for each in (best[number] * often, n[number] * often):
        total = np.zeros(len(sizes), dtype=np.int64)
        np.add.at(total, text_of, each)
        sums.append(pa.array(total))
    kept = texts.select(["key", "n_a", "n_b", "n_links", "groups"])
    return kept.append_column("n_best", sums[0]).append_column("count_sum", sums[1])


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def alignment_measures(
    docs: DataFrame, columns: list[str], text: str, a_path: str | None = None, b_path: str | None = None
) -> DataFrame:
    """``columns`` with the alignment of two tokenizers on each text: counts, best links, groups.

    A, a byte-level vocabulary, reads a space and the text; B, pieces, the text, to which it adds the
    space itself. ``n_a`` and ``n_b`` count tokens; where an A and a B token end at the same byte a
    group ends and the two are linked (``n_groups``, ``n_links``). A pair's count is the number of
    links of all rows that hold it: ``n_best`` are the text's links whose count is the highest of
    their B id, ``count_sum`` sums the counts over its links. ``groups_sha256`` digests the groups,
    written like ``a1,a2|b1;a3|b2,b3``.

    Rows are dealt by their whole text, equal ones being counted before and after the shuffle; each
    distinct text is tokenized and aligned once, and what it adds to a pair's count is weighted by its
    copies. Alignments are written once. Pair counts meet the distinct pairs of blocks of some
    megabytes of text, not those of each text, and each block's pairs go back to its texts; the rows
    get their measures by the texts' digests, where a frequent one can be split at run time. Nothing
    is collected or broadcast.

    Null and empty texts, and those that B cannot give back, have zeros and an empty digest and add no
    link; repeated rows are rows of their own and count; no rows give none. Names that ``columns``
    hold already get a trailing underscore.
    """
    a_path, b_path = a_path or _public("byte_bpe_50k.json"), b_path or _public("piece_bpe_32k.model")
    b_ids = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    some = docs.where(F.length(text) > 0).groupBy(F.col(text).alias("text")).agg(F.count("*").alias("copies"))
    table = written(aligned(some.withColumn("key", text_key(F.col("text"))), a_path, b_path))
    model = pair_model(table, b_ids)
    blocks = table.where("key is null").select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("at", "pair"))
    known = blocks.join(model, "pair").select("of_block", "at", "n", "best")
    texts = table.where("key is not null")
    kinds = "key binary, n_a long, n_b long, n_links long, groups string, n_best long, count_sum long"
    found = texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(_measures, kinds)
    rows = docs.select(*columns, text)
    key = free_name(rows, "_key")
    rows = rows.withColumn(key, F.when(F.length(text) > 0, text_key(F.col(text)))).select(*columns, key)
    names = {n: free_name(rows, n) for n in (*MEASURES, "groups_sha256")}
    own = found.withColumn("n_groups", F.col("n_links")).select(
        F.col("key").alias("_of_text"), *[F.col(m).alias(f"_of_{m}") for m in MEASURES], F.col("groups").alias("_of_groups")
    )
    joined = rows.join(own, rows[key] == own["_of_text"], "left")
    measures = [F.coalesce(own[f"_of_{m}"], F.lit(0)).cast("long").alias(names[m]) for m in MEASURES]
    digest = F.coalesce(own["_of_groups"], F.lit("")).alias(names["groups_sha256"])
    return joined.select(*[rows[c] for c in columns], *measures, digest)


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
