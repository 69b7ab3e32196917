"""Periodic runs of words, found on the grammar that Re-Pair makes of each text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import free_name

#: Words of neighbouring texts that are worked on together; a longer text comes alone.
TOGETHER = 1 << 18
#: Candidate periods that are measured at a time.
MEASURED = 1 << 20
#: A run has at least this many words and this many times its period.
LEAST, TIMES = 6, 4
#: Odd number that spreads the order of equally frequent pairs, so that a round replaces many.
MIX = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict[bytes, int]):
    """Numbers for words in order of first use; cleared between texts, which so share no number."""

    def __init__(self) -> None:
        self.used = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = self.used
        self.used += 1
        return self.used - 1


@dataclass
class Boundaries:
    """Places ``at`` between two parts of a stretch from ``low`` to ``high``.

    Stretches are the expansions of nonterminals, at one of their places, and whole texts.
    """

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray


def grammar(words: np.ndarray, text_of: np.ndarray) -> tuple[Boundaries, np.ndarray, np.ndarray]:
    """Re-Pair over texts laid end to end: boundaries, each nonterminal's place, all derivation places.

    Texts share no numbers, so each has a grammar of its own. In a round the pairs of neighbours are
    counted, and the more frequent of two that overlap is replaced wherever it stands, by a hash among
    equals; in a row of one symbol it is every other pair. Counts are taken anew after each round, not
    after each pair. A round replaces all places of the most frequent pair at
    least, so this ends when no pair occurs twice.

    Returned are the boundaries, first those of the nonterminals, one each, then those between the
    symbols that are left of a text; the start of each nonterminal's first place; and (nonterminal,
    start) of every place where it is derived, which is where it was put. All pairs of a run but its
    last period's occur again, so a text without ``LEAST - 1`` such pairs in a row has no run: it is
    left out after the first count.
    """
    begins = np.flatnonzero(np.r_[True, text_of[1:] != text_of[:-1]])
    ends = np.r_[begins[1:], len(words)]
    end_of = np.repeat(ends, ends - begins)
    symbols, place, text = words.astype(np.int64), np.arange(len(words)), text_of
    free = int(symbols.max(initial=-1)) + 1
    first_free = free
    at, low, high, put, put_at, over = [], [], [], [], [], []
    first = True
    while len(symbols) > 1:
        key = symbols[:-1] * free + symbols[1:]
        kinds, kind, often = np.unique(key, return_inverse=True, return_counts=True)
        if first:
            # Positions from which LEAST - 1 pairs in a row occur again.
            again = np.r_[0, np.cumsum(often[kind] > 1)]
            streak = np.flatnonzero(again[LEAST - 1 :] - again[: 1 - LEAST] == LEAST - 1)
            some = np.zeros(len(begins), dtype=bool)
            some[np.searchsorted(begins, streak, "right") - 1] = True
            stays = np.repeat(some, ends - begins)
            first = False
            if not stays.all():
                symbols, place, text = symbols[stays], place[stays], text[stays]
                continue
        # Every other pair of a row of equal pairs counts.
        turn = np.r_[True, kind[1:] != kind[:-1]]
        odd = (np.arange(len(kind)) - np.maximum.accumulate(np.where(turn, np.arange(len(kind)), 0))) & 1 == 1
        often = np.bincount(kind[~odd], minlength=len(kinds))
        rank = np.empty(len(kinds), dtype=np.int64)
        rank[np.lexsort((kinds.astype(np.uint64) * MIX, -often))] = np.arange(len(kinds))
        rank[often < 2] = len(kinds)
        own = rank[kind]
        before, after = np.r_[len(kinds), own[:-1]], np.r_[own[1:], len(kinds)]
        last = np.r_[turn[1:], True]
        taken = (own < len(kinds)) & ~odd & (~turn | (own < before)) & (~last | (own < after))
        # A pair that others leave at one place stays as it is until it is counted anew.
        taken &= (np.bincount(kind[taken], minlength=len(kinds)) > 1)[kind]
        # Texts in which nothing was replaced are done.
        chosen = np.flatnonzero(taken)
        if not len(chosen):
            over.append(place)
            break
        live = np.isin(text, text[chosen])
        # Rules: one per kind taken.
        used, start, which = np.unique(kind[chosen], return_index=True, return_inverse=True)
        length = np.minimum(np.r_[place[1:], len(words)], end_of[place]) - place
        head = chosen[start]
        at.append(place[head] + length[head])
        low.append(place[head])
        high.append(place[head] + length[head] + length[head + 1])
        put.append(which + (free - first_free))
        put_at.append(place[chosen])
        symbols = symbols.copy()
        symbols[chosen] = free + which
        free += len(used)
        stays = np.ones(len(symbols), dtype=bool)
        stays[chosen + 1] = False
        if not live.all():
            over.append(place[~live])
            stays &= live
        symbols, place, text = symbols[stays], place[stays], text[stays]
    else:
        over.append(place)
    none = [np.empty(0, dtype=np.int64)]
    rules = Boundaries(*(np.concatenate(x or none) for x in (at, low, high)))
    left = np.sort(np.concatenate(over or none))
    whose = np.searchsorted(begins, left, "right") - 1
    inner = left != begins[whose] if len(left) else np.zeros(0, dtype=bool)
    left, whose = left[inner], whose[inner]
    every = Boundaries(np.r_[rules.at, left], np.r_[rules.low, begins[whose]], np.r_[rules.high, ends[whose]])
    return every, rules.low, np.stack([np.concatenate(put or none), np.concatenate(put_at or none)])


class Names:
    """Names for the stretches of 1, 2, 4, ... words that occur more than once, by doubling.

    Two stretches of a length are equal if they have the same name; -1 names those that occur once.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.count = len(words)
        self.levels: list[np.ndarray] = []
        #: Of each level: name and place of the named stretches as one number, sorted.
        self.sorted: list[np.ndarray] = []
        places, key = np.arange(self.count), words.astype(np.int64)
        while len(places):
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            turn = np.r_[True, ordered[1:] != ordered[:-1]]
            twice = ~(turn & np.r_[turn[1:], True])
            name = (np.cumsum(turn) - 1)[twice]
            where = places[order][twice]
            level = np.full(self.count, -1, dtype=np.int64)
            level[where] = name
            step = 1 << len(self.levels)
            self.levels.append(level)
            self.sorted.append(name * (self.count + 1) + where)
            places = np.sort(where)
            places = places[places + step < self.count]
            second = level[places + step]
            places, second = places[second >= 0], second[second >= 0]
            key = level[places] * (self.count + 1) + second

    def same(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        inside = (np.minimum(a, b) >= 0) & (np.maximum(a, b) < self.count)
        names = self.levels[level]
        one = names[np.where(inside, a, 0)]
        return inside & (one >= 0) & (one == names[np.where(inside, b, 0)])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from ``a`` and ``b`` on."""
        done = np.zeros(len(a), dtype=np.int64)
        for level in reversed(range(len(self.levels))):
            done += self.same(level, a + done, b + done) * np.int64(1 << level)
        return done

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from ``a`` and ``b`` back."""
        done = np.zeros(len(a), dtype=np.int64)
        for level in reversed(range(len(self.levels))):
            step = np.int64(1 << level)
            done += self.same(level, a - done - step + 1, b - done - step + 1) * step
        return done

    def places(self, level: int, of: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index into ``of``, place) of stretches equal to those at ``of`` that begin in [least, most)."""
        inside = (of >= 0) & (of < self.count)
        name = np.where(inside, self.levels[level][np.where(inside, of, 0)], -1)
        asked = np.flatnonzero(name >= 0)
        base = name[asked] * (self.count + 1)
        begin = np.searchsorted(self.sorted[level], base + np.clip(least[asked], 0, self.count))
        end = np.searchsorted(self.sorted[level], base + np.clip(most[asked], 0, self.count))
        many = end - begin
        asked, begin, many = asked[many > 0], begin[many > 0], many[many > 0]
        upto = np.cumsum(many)
        at = 0
        while at < len(asked):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MEASURED, "right")))
            size = many[at:stop]
            offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            found = self.sorted[level][np.repeat(begin[at:stop], size) + offset]
            yield np.repeat(asked[at:stop], size), found % (self.count + 1)
            at = stop


def crossing(names: Names, where: Boundaries) -> np.ndarray:
    """(boundary, start, end, period) of the runs that cross each boundary, inside its stretch.

    A run of four periods has two of them on one side of the boundary. So for periods from k to 2k
    the k words on that side, next to the boundary, occur again a period further: these places are
    candidates, and both ends are measured for each.
    """
    found = [np.empty((4, 0), dtype=np.int64)]
    at, low, high = where.at, where.low, where.high

    def keep(i: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        long = end - start >= np.maximum(LEAST, TIMES * period)
        rows = np.stack([i, start, end, period])[:, long]
        # Of equal stretches the smallest period counts; it is found at the same boundary.
        rows = rows[:, np.lexsort(rows[::-1])]
        new = np.ones(rows.shape[1], dtype=bool)
        new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
        found.append(rows[:, new])

    for level in range(len(names.levels)):
        k = 1 << level
        # Two periods have to fit into the stretch on that side.
        for i, other in names.places(level, at, at + k, np.minimum(at + 2 * k, (at + high) // 2 + 1)):
            b, period = at[i], other - at[i]
            right = np.minimum(names.forward(b, other), high[i] - other)
            left = np.minimum(names.backward(b - 1, other - 1), b - low[i])
            keep(i, b - left, other + right, period)
        for i, other in names.places(level, at - k, np.maximum(at - 3 * k + 1, at - k - (at - low) // 2), at - 2 * k + 1):
            b, period = at[i], at[i] - k - other
            left = np.minimum(names.backward(b - 1, b - 1 - period), b - period - low[i])
            right = np.minimum(names.forward(b, b - period), high[i] - b)
            keep(i, b - period - left, b + right, period)
    return np.concatenate(found, axis=1)


def maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs that no other of the same period contains, with their smallest period, by start and period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    upto = np.maximum.accumulate(period * (end.max(initial=0) + 1) + end)
    new = np.r_[True, upto[1:] > upto[:-1]][: len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, period = start[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_of(words: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal runs of texts laid end to end, by start and period.

    ``words`` are numbers that no two texts share; ``text_of`` does not decrease.
    """
    none = np.empty(0, dtype=np.int64)
    if len(words) < LEAST:
        return none, none, none
    where, rule_at, (rule, derived_at) = grammar(words, text_of)
    if not len(where.at):
        return none, none, none
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(inside, where.low, 1)
    np.add.at(inside, where.high, -1)
    # Names are needed only in texts that have a grammar.
    covered = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    moved = np.full(len(words) + 1, len(covered), dtype=np.int64)
    moved[covered] = np.arange(len(covered))
    names = Names(words[covered])
    large = where.high - where.low >= LEAST
    index = np.flatnonzero(large)
    some = Boundaries(*(x[large] for x in (where.at, where.low, where.high)))
    # A stretch is covered whole, so its end follows its last word.
    near = Boundaries(moved[some.at], moved[some.low], moved[some.high - 1] + 1)
    i, start, end, period = crossing(names, near)
    start, end = covered[start], covered[end - 1] + 1
    i = index[i]
    top = i >= len(rule_at)
    # Runs of a nonterminal, wherever it is derived.
    order = np.argsort(rule, kind="stable")
    rule, derived_at = rule[order], derived_at[order]
    own = i[~top]
    first, last = np.searchsorted(rule, own), np.searchsorted(rule, own, "right")
    many = last - first
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    shift = derived_at[np.repeat(first, many) + offset] - np.repeat(rule_at[own], many)
    return maximal(
        np.r_[start[top], np.repeat(start[~top], many) + shift],
        np.r_[end[top], np.repeat(end[~top], many) + shift],
        np.r_[period[top], np.repeat(period[~top], many)],
    )


def texts_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Rows (start, length, period) of the runs of each text, a list of words."""
    numbers, ids = _Numbers(), []
    for words in texts:
        numbers.clear()
        ids.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    text_of = np.repeat(np.arange(len(ids)), sizes)
    start, end, period = runs_of(np.concatenate(ids), text_of) if ids else (np.empty(0, dtype=np.int64),) * 3
    whose = text_of[start] if len(start) else start
    rows = np.stack([start - begins[whose], end - start, period], axis=1)
    cuts = np.searchsorted(whose, np.arange(1, len(ids)))
    return np.split(rows, cuts) if ids else []


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that a run repeats after its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(change[:-1]) > 0
    return b" ".join([words[i] for i in np.flatnonzero(~dropped).tolist()])


RUN = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """(columns, runs, collapsed): the periodic runs of each row's words, and the text without repeats.

    Words are what stands between ASCII white space, compared byte by byte and numbered from 0. A run
    is a stretch with smallest period q, at least 6 words and 4 q long, that no neighbouring word
    extends; ``runs`` are (start, length, period) by start, then period. ``collapsed`` is the text's
    words joined by one space, without those that some run contains after its first q words. Names
    that ``columns`` hold already get a trailing underscore.

    Each text is compressed by Re-Pair; the runs that cross the boundary inside a nonterminal are
    found once and moved to all places where it is derived, those across the symbols that are left
    are found in the text, and of equal periods the maximal ones stay. Texts are worked on in tasks,
    several short ones together; no row meets another, nothing is shuffled and no text is cut.

    Null, empty and blank texts have no runs and an empty ``collapsed``; repeated rows are rows of
    their own; no rows give none.
    """
    runs_name, collapsed_name = (free_name(docs.select(*columns), n) for n in ("runs", "collapsed"))
    kept = docs.select(F.col(text), *columns)
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)
    run = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[list[bytes]] = []
            at, size = 0, 0
            for row, value in enumerate(batch.column(0)):
                texts.append((value.as_py() or "").encode().split())
                size += len(texts[-1])
                if size < TOGETHER and row + 1 < batch.num_rows:
                    continue
                found = texts_runs(texts)
                upto = np.cumsum([0, *map(len, found)]).astype(np.int32)
                rows = np.concatenate(found)
                parts = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(run.value_type))
                whole = [collapsed(words, r).decode() for words, r in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(at, len(texts)).columns[1:],
                        pa.ListArray.from_arrays(pa.array(upto), parts),
                        pa.array(whole, pa.string()),
                    ],
                    names=[*batch.schema.names[1:], runs_name, collapsed_name],
                )
                at, size, texts = row + 1, 0, []

    return kept.mapInArrow(detect, f"{kinds}`{runs_name}` {RUN}, `{collapsed_name}` string")


def with_repeats(docs: DataFrame, doc_id: str, text: str, every: int = 10) -> DataFrame:
    """``docs`` with one text in ``every`` ending in a stretch of itself, over and over, by its id.

    Let h be the checksum of the decimal id and g = h div ``every``. Where ``every`` divides h and the
    text has n > 0 words, word i >= a becomes word a + (i - a) % p with a = g % n and
    p = 1 + (n - a) div (3 + g % 8), and the words are joined by one space. Other texts, and those of
    rows with a null id, stay as they are.
    """
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / every)
    taken = (F.pmod(h, F.lit(every)) == 0) & F.regexp_like(F.col(text), F.lit(r"[^\x20\x09-\x0D]"))
    hidden = [free_name(docs, f"_{n}") for n in ("words", "a", "p")]
    listed, a, p = hidden
    some = docs.withColumn(listed, F.when(taken, words))
    some = some.withColumn(a, F.when(taken, F.pmod(g, F.size(listed)).cast("int")))
    some = some.withColumn(p, F.when(taken, (1 + F.floor((F.size(listed) - F.col(a)) / (3 + F.pmod(g, F.lit(8))))).cast("int")))
    moved = F.transform(
        F.col(listed),
        lambda x, i: F.when(i < F.col(a), x).otherwise(F.get(F.col(listed), (F.col(a) + F.pmod(i - F.col(a), F.col(p))).cast("int"))),
    )
    return some.withColumn(text, F.when(taken, F.array_join(moved, " ")).otherwise(F.col(text))).drop(*hidden)
