"""Best-fit decreasing packing of tokenized documents into sequences."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.frames import checkpointed, free_name, row_numbers

#: Chunks or words in each of the two generations that a worker remembers, and the longest chunk.
REMEMBERED, REMEMBERED_BYTES = 1 << 18, 64
#: Fixed value: the pattern by which the 49k word vocabulary cuts words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CUT = regex.compile(WORDS).findall
#: Letters that are their own composition and whose lower case does not depend on their neighbours.
SIMPLE = re.compile("[!-~\u00a1-\u012f\u0131-\u017f]*").fullmatch
#: Bits of a piece's number among those of its length.
NUMBER_BITS = 46


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself, or one above 255."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


class ChunkEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    A tokenizer that drops white space and lets no token cross it gives a text the ids of its chunks
    in a row, and frequent chunks need to be encoded once. Chunks end at ASCII white space only,
    which nothing composes with. Chunks of Latin letters, which `WORDS` cuts as the tokenizer does,
    are put together from their words, so that a word is encoded once whatever stands around it; all
    other chunks go through the tokenizer whole, and so do all texts if it cuts words by another
    pattern.
    """

    def __init__(self, tokenizer_path: str) -> None:
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        cutter = json.loads(self.tokenizer.to_str()).get("pre_tokenizer") or {}
        cuts = [x.get("pattern", {}).get("Regex") for x in cutter.get("pretokenizers", []) if x.get("invert")]
        self.by_chunk = cuts == [WORDS]
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_chunks: dict[bytes, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if not self.by_chunk:
            return self._whole(text)
        if len(self.chunks) > REMEMBERED:
            self.chunks, self.old_chunks = {}, self.chunks
        if len(self.words) > REMEMBERED:
            self.words, self.old_words = {}, self.words
        known, old, chunks = self.chunks, self.old_chunks, text.encode().split()
        ids = list(map(known.get, chunks))
        for k in [k for k, found in enumerate(ids) if found is None]:
            c = chunks[k]
            found = known.get(c) or old.get(c)
            if found is None:
                found = self._chunk(c.decode())
            ids[k] = found
            if len(c) <= REMEMBERED_BYTES:
                known[c] = found
        return b"".join(ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if len(chunk) > REMEMBERED_BYTES or "<|" in chunk or not SIMPLE(chunk):
            return self._whole(chunk)
        lower = chunk.lower()
        # Letters alone, or before one other character, are cut as the pattern would without it.
        if lower.isalpha():
            return self._word(lower)
        if lower[:-1].isalpha():
            return self._word(lower[:-1]) + self._word(lower[-1])
        return b"".join([self._word(word) for word in CUT(lower)])

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.old_words.get(word)
            if found is None:
                # ASCII is spelt as it is.
                spelt = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = [x.id for x in self.model.tokenize(spelt)]
                found = struct.pack(f"<{len(ids)}I", *ids)
            self.words[word] = found
        return found


def token_pieces(
    docs: DataFrame, doc_id: str, text: str, tokenizer_path: str | None = None, capacity: int = 2048, end_id: int = 0
) -> DataFrame:
    """(doc_id, piece, start, length, ids): every document's ids and ``end_id``, cut at ``capacity``.

    ``ids`` are little-endian unsigned 32-bit. Only documents longer than ``capacity`` are cut; all
    their pieces but the last are full. A null text counts as empty and is one piece of one id.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    last = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ChunkEncoder(tokenizer_path or _default_tokenizer())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                whose, pieces, ids = [], [], []
                for row, value in enumerate(part.column(1)):
                    coded = encode(value.as_py() or "") + last
                    for piece, start in enumerate(range(0, len(coded), 4 * capacity)):
                        whose.append(row)
                        pieces.append(piece)
                        ids.append(coded[start : start + 4 * capacity])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(whose)),
                        pa.array(pieces, pa.int32()),
                        pa.array([p * capacity for p in pieces], pa.int64()),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids binary"
    )


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Stretch(NamedTuple):
    """Pieces of one length, numbered from ``first``, that fill sequences of one kind in turn.

    Each sequence from ``sequence`` on takes ``each`` of them, the first at ``offset``.
    """

    length: int
    first: int
    each: int
    sequence: int
    offset: int


def best_fit_stretches(counts: dict[int, int], capacity: int) -> list[Stretch]:
    """Best fit decreasing of ``counts[length]`` pieces of each length, longest first.

    Open sequences that were filled alike are one kind, and a segment tree over remaining capacities
    counts the kinds that have each; the tightest one that a length fits is found by one climb and one
    descent. A sequence that a piece went into is the tightest for the next piece of that length, so
    its kind takes as many as fit at once: pieces go where one after the other would go. A length adds
    at most three kinds, and each filling more than halves a kind's room, so the stretches are bounded
    by the capacity and do not grow with the pieces.
    """
    leaves = 1 << capacity.bit_length()
    tree = [0] * (2 * leaves)
    kinds: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    made, found = 0, []

    def add(room: int, sequence: int, count: int) -> None:
        if room and count:
            kinds[room].append((sequence, count))
            _count(tree, leaves + room, 1)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = _tightest(tree, leaves, length)
            if room:
                sequence, count = kinds[room].pop()
                _count(tree, leaves + room, -1)
            else:
                room, sequence, count = capacity, made, -(-left // (capacity // length))
                made += count
            first, each = counts[length] - left, room // length
            whole = min(count, left // each)
            if whole:
                found.append(Stretch(length, first, each, sequence, capacity - room))
                add(room - each * length, sequence, whole)
                left -= whole * each
            rest = count - whole
            if left and rest:
                found.append(Stretch(length, first + whole * each, left, sequence + whole, capacity - room))
                add(room - left * length, sequence + whole, 1)
                left, rest = 0, rest - 1
            add(room, sequence + count - rest, rest)
    return found


def _count(tree: list[int], node: int, change: int) -> None:
    while node:
        tree[node] += change
        node >>= 1


def _tightest(tree: list[int], leaves: int, length: int) -> int:
    """Smallest room of at least ``length`` that an open sequence has, or 0."""
    node = leaves + length
    if tree[node]:
        return length
    # Up to the first subtree on the right that holds a kind, then down to its left end.
    while node > 1 and (node & 1 or not tree[node + 1]):
        node >>= 1
    if node <= 1:
        return 0
    node += 1
    while node < leaves:
        node = 2 * node if tree[2 * node] else 2 * node + 1
    return node - leaves


def places(stretches: list[Stretch]) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function from lengths and numbers of pieces to their sequences and offsets."""
    table = np.array(sorted(stretches), dtype=np.int64).reshape(-1, len(Stretch._fields))
    starts = (table[:, 0] << NUMBER_BITS) + table[:, 1]

    def found(lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = table[np.searchsorted(starts, (lengths << NUMBER_BITS) + numbers, side="right") - 1]
        inside = numbers - of[:, 1]
        return of[:, 3] + inside // of[:, 2], of[:, 4] + inside % of[:, 2] * lengths

    return found


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item of a list that does not increase."""
    sizes = np.array(lengths, dtype=np.int64)
    if not len(sizes):
        return [], []
    values, begin, counts = np.unique(-sizes, return_index=True, return_counts=True)
    plan = best_fit_stretches(dict(zip((-values).tolist(), counts.tolist(), strict=True)), capacity)
    bins, offsets = places(plan)(sizes, np.arange(len(sizes)) - np.repeat(begin, counts))
    return bins.tolist(), offsets.tolist()


def packed(pieces: DataFrame, length: str, capacity: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: as few sequences as best fit decreasing finds.

    All pieces are packed together at any size: which sequences a length goes into follows from how
    many pieces each length has, at most ``capacity`` numbers, and the pieces of a length are numbered
    on the executors and look their places up. Sequences are filled without gaps, and nothing crosses
    one's end. Equal pieces are pieces of their own; an empty table stays empty. Columns that have the
    names of the new ones are replaced. A length that is null or not 1 to ``capacity`` fails.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    row, number, size = (free_name(pieces, n) for n in ("_row", "_number", "_length"))
    written = checkpointed(pieces).withColumns({row: F.monotonically_increasing_id(), size: F.col(length).cast("long")})
    allowed = F.when(F.col(size).between(1, capacity), F.col(size))
    counts = {r[0]: r[1] for r in written.groupBy(allowed).count().collect()}
    if None in counts:
        raise ValueError(f"lengths must be 1 to {capacity}")
    place = places(best_fit_stretches(counts, capacity))
    # rows of one written partition and length are a stretch, so a frequent length spreads over tasks
    numbered = row_numbers(written, [size], F.shiftright(row, 33), [F.col(row)], number)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences, offsets = place(batch.column(size).to_numpy(), batch.column(number).to_numpy())
            kept = batch.select(names).columns
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequences), pa.array(offsets)], names=[*names, "sequence_id", "offset"]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return numbered.select(*names, size, number).mapInArrow(placed, f"{kinds}, sequence_id long, offset long".lstrip(", "))


def digests(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the checksum of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def ids_checksum(ids: list[int]) -> int:
    """What `digests` returns, for one list of ids."""
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
