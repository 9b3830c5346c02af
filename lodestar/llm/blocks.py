"""All pairs inside buckets, in blocks of bounded size, for the similarity joins.

A bucket of more than ``BLOCK`` items is cut into blocks by a hash, and every pair of blocks becomes a group of
its own, so that no task holds more than two blocks whatever the bucket's size. Groups stream through Python in
sorted order; what comes out is linear in the rows of a group: sums of link weights and links to the smallest
member, never the pairs themselves. A pair that shares several buckets counts in the smallest of them only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.resident import trim

BLOCK = 1024

OUT = "item long, links long, root long"


def in_blocks(members: DataFrame, *, key: str = "item") -> DataFrame:
    """``members`` (bucket, n_blocks, key, ...) with (bi, bj, own): one row for each pair of blocks that it takes part in."""
    own = F.pmod(F.xxhash64(key), F.col("n_blocks")).cast("int")
    every = F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int"))
    pairs = F.transform(every, lambda j: F.struct(F.least(own, j).alias("bi"), F.greatest(own, j).alias("bj")))
    return members.withColumn("own", own).withColumn("p", F.explode(pairs)).withColumn("bi", F.col("p.bi")).withColumn("bj", F.col("p.bj")).drop("p", "n_blocks")


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("bucket", "bi", "bj")) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys; a group may span batches."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(c[a] for c in cols)
            if held and now != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = now
    if held:
        yield pa.concat_tables(held)


def allowed(own: np.ndarray, bi: int, bj: int) -> np.ndarray | None:
    """For a pair of different blocks, which pairs go across; None: all pairs."""
    return None if bi == bj else own[:, None] != own[None, :]


def shared_before(buckets: list[np.ndarray], bucket: int) -> np.ndarray | None:
    """Pairs that meet in a smaller bucket as well (and count there); None if there are none."""
    sizes = [len(b) for b in buckets]
    flat = np.concatenate(buckets)
    row = np.repeat(np.arange(len(buckets)), sizes)
    before = flat < bucket
    flat, row = flat[before], row[before]
    if not len(flat):
        return None
    _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    use = n[col] > 1
    if not use.any():
        return None
    cols, col = np.unique(col[use], return_inverse=True)
    row = row[use]
    common = np.zeros((len(buckets), len(buckets)), np.float32)
    for a in range(0, len(cols), 2048):
        part = (col >= a) & (col < a + 2048)
        m = np.zeros((len(buckets), min(2048, len(cols) - a)), np.float32)
        m[row[part], col[part] - a] = 1
        common += m @ m.T
    return common > 0


def summarize(items: np.ndarray, copies: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with links: item, copies linked to it, smallest item of its component within the group."""
    np.fill_diagonal(link, False)
    links = link @ copies.astype(np.float64)
    order = np.argsort(items, kind="stable")
    label = np.empty(len(items), np.int64)
    label[order] = np.arange(len(items))
    big = len(items)
    while True:
        near = np.where(link, label[None, :], big).min(axis=1)
        new = np.minimum(label, near)
        new = np.minimum(new, new[order[new]])  # pointer jump: a label is the rank of a node
        if (new == label).all():
            break
        label = new
    has = link.any(axis=1)
    return items[has], links[has].astype(np.int64), items[order[label]][has]


def link_groups(members: DataFrame, verify: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """(item, links, root) from blocked members (bucket, bi, bj, own, item, copies, buckets, ...).

    ``verify`` gives the square boolean matrix of the pairs of a group's rows that are linked.
    """
    keys = ["bucket", "bi", "bj"]
    dealt = members.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        held = 0
        for g in groups(batches):
            if g.num_rows < 2:
                continue
            bucket, bi, bj = (g.column(k)[0].as_py() for k in keys)
            link = verify(g)
            if (ok := allowed(g.column("own").to_numpy(), bi, bj)) is not None:
                link &= ok
            if not link.any():
                continue
            buckets = g.column("buckets").combine_chunks()
            lists = np.split(buckets.flatten().to_numpy(), np.cumsum(buckets.value_lengths().to_numpy())[:-1])
            if (seen := shared_before(lists, bucket)) is not None:
                link &= ~seen
            out.append(summarize(g.column("item").to_numpy(), g.column("copies").to_numpy(), link))
            held += len(out[-1][0])
            if held > 20_000:
                yield _batch(out)
                out, held = [], 0
        if held:
            yield _batch(out)
        trim()

    return dealt.mapInArrow(run, OUT)


def _batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts]), pa.int64()) for i in range(3)], names=["item", "links", "root"])
