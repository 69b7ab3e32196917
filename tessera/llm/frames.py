"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.materialize import checkpointed, ensure_checkpoint_dir

__all__ = ["checkpointed", "dealt_by", "found_again", "free_name", "local_roots", "repeated", "row_key", "row_numbers", "running_start", "runs", "written"]

#: Stretches into which a hash deals a group, so that no group meets in one task.
STRETCHES = 4096
#: Copies of a row that are counted out at a time.
STEP = 10_000


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which is smaller than a checkpoint."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(text: Column) -> Column:
    """Hash of a whole text, by which a row is found again beside its id."""
    return F.xxhash64(text.isNull(), F.coalesce(text, F.lit("")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first longer one that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def found_again(docs: DataFrame, keys: dict[str, Column], chosen: DataFrame, extra: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows of ``docs``, each once, whose ``keys`` are in ``chosen`` (the keys' names, _rows, ``extra``).

    ``_rows`` says how many rows of ``docs`` have those keys; only where it is more than one are rows
    compared, and one of them stays. Also returned are the names under which ``extra`` was added.
    """
    own = {k: free_name(docs, f"_own_{k}") for k in keys}
    other = {c: free_name(docs, f"_chosen_{c}") for c in [*keys, "_rows", *extra]}
    named = chosen.select(*[F.col(c).alias(n) for c, n in other.items()])
    marked = docs.withColumns({own[k]: column for k, column in keys.items()})
    alike = [F.col(own[k]).eqNullSafe(F.col(other[k])) for k in keys]
    joined = marked.join(named, reduce(and_, alike))
    single = joined.where(F.col(other["_rows"]) == 1)
    several = joined.where(F.col(other["_rows"]) > 1).dropDuplicates(list(own.values()))
    added = [other[c] for c in extra]
    return single.unionByName(several).select(*docs.columns, *added), added


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` says, which goes; counted out in two steps.

    A row that stands for very many gets no array of that length.
    """
    step, copy = free_name(df, "_step"), free_name(df, "_copy")
    steps = df.where(F.col(times) > 0).withColumn(step, F.explode(F.expr(f"sequence(0L, (`{times}` - 1) div {STEP})")))
    inside = F.expr(f"sequence({step} * {STEP}, least(`{times}`, ({step} + 1) * {STEP}) - 1)")
    return steps.withColumn(copy, F.explode(inside)).drop(step, copy, times)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) for each stretch of equal integer keys in sorted batches without null keys."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        turn = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            turn[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(turn).tolist()
        for start, end in zip([0, *starts], [*starts, batch.num_rows], strict=True):
            key = tuple(c[start].item() for c in columns)
            if last is not None and key != last:
                yield last, pa.concat_tables(held)
                held = []
            held.append(pa.Table.from_batches([batch.slice(start, end - start)]))
            last = key
    if held:
        yield last, pa.concat_tables(held)


def running_start(
    df: DataFrame, group: list[str], stretch: Column, order: list[Column], sums: dict[str, str]
) -> DataFrame:
    """``df`` with running sums: ``sums`` names, per size column, the sum over all rows before.

    ``stretch`` cuts a group into stretches that follow each other in its order, and ``order``
    counts inside one. A window meets one stretch, and one more window a row per stretch, so a group
    that holds most rows still spreads over many tasks. ``group`` columns are never null.
    """
    until = Window.unboundedPreceding, Window.currentRow
    dealt = df.withColumn("_stretch", stretch)
    keys = [*group, "_stretch"]
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*until)
    outer = Window.partitionBy(*group).orderBy("_stretch").rowsBetween(*until)
    whole = dealt.groupBy(*keys).agg(*[F.sum(size).alias(f"_sum_{size}") for size in sums])
    before = whole.select(
        *keys, *[(F.sum(f"_sum_{size}").over(outer) - F.col(f"_sum_{size}")).alias(f"_to_{size}") for size in sums]
    )
    within = dealt.withColumns({name: F.sum(size).over(inner) - F.col(size) for size, name in sums.items()})
    joined = within.join(before, keys)
    joined = joined.withColumns({name: (F.col(name) + F.col(f"_to_{size}")).cast("long") for size, name in sums.items()})
    return joined.drop("_stretch", *[f"_to_{size}" for size in sums])


def row_numbers(df: DataFrame, group: list[str], stretch: Column, order: list[Column], number: str) -> DataFrame:
    """``df`` with ``number``: gapless positions from 0 inside each group, as in `running_start`."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return running_start(ones, group, stretch, order, {"_one": number}).drop("_one")


def dealt_by(hash_: Column) -> Column:
    """A stretch for rows in hash order: one of ``STRETCHES`` residues."""
    return F.pmod(hash_, F.lit(STRETCHES)).cast("int")


def local_roots(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``count`` positions by the links left[i]-right[i]."""
    root = np.arange(count)
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (shorter := root[root]).tobytes() != root.tobytes():
            root = shorter
    return root
