"""Sharding by Karmarkar-Karp differencing: equal texts stay together, and shards have near
equal bytes.

Groups of equal texts are summed before they are dealt out, so a group of any size is one row. Each
bucket of groups is differenced alone: the two partial partitions of the largest spread are
combined, oppositely ordered, until one is left, which has a small spread. The partial partitions of
the buckets are then combined in the same way; they are one row of sums for each bucket of up to about
BUCKET_GROUPS groups, not one for each group. A group larger than a shard's share fills a
shard of its own as far as that goes.

Null and empty texts are one group of size 1 (a row of any kind counts its bytes plus 1). Null ids
and repeated rows are placed like others. An empty table gives an empty result. Extra columns are
ignored."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import common as c

#: Groups of a bucket, which one task differences.
BUCKET_GROUPS = 50_000


def difference(parts: Sequence[Sequence[int]], m: int) -> tuple[list[int], list[Sequence[int]]]:
    """Combines partial partitions (up to m sums each). Returns the sums, largest first, and for
    each partial partition the places that its sums have among them."""
    nodes: list[tuple[int, int, list[int], list[int]] | None] = []
    heap: list[tuple[int, int, list[int]]] = []
    first: list[list[int]] = []
    for i, sums in enumerate(parts):
        order = sorted(range(m), key=lambda k: -(sums[k] if k < len(sums) else 0))
        first.append(order)
        have = [sums[k] if k < len(sums) else 0 for k in order]
        nodes.append(None)
        heap.append((have[-1] - have[0], i, have))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        joint = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(m), key=lambda k: -joint[k])
        place = [0] * m
        for at, k in enumerate(order):
            place[k] = at
        nodes.append((a, b, place, place[::-1]))
        have = [joint[k] for k in order]
        heapq.heappush(heap, (have[-1] - have[0], len(nodes) - 1, have))
    out: list[Sequence[int]] = [()] * len(parts)
    if not heap:
        return [0] * m, out
    todo = [(heap[0][1], list(range(m)))]
    while todo:
        i, where = todo.pop()
        node = nodes[i]
        if node is None:
            own = [0] * m
            for at, k in enumerate(first[i]):
                own[k] = where[at]
            out[i] = own
        else:
            a, b, left, right = node
            todo += [(a, [where[k] for k in left]), (b, [where[k] for k in right])]
    return heap[0][2], out


def _local(m: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, t in c.groups(batches, "bucket"):
            keys, size = t.column("text_key").combine_chunks(), t.column("bytes").to_pylist()
            _, places = difference([(x,) for x in size], m)
            n = len(size)
            rest = [t.column(x).combine_chunks() for x in ("copies", "bytes")]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket, np.int32)), keys, *rest, pa.array([p[0] for p in places], pa.int32())], ["bucket", "text_key", "copies", "bytes", "place"])

    return run


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id_col, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_key"))
    rows = c.stash(rows.withColumn("tie", F.monotonically_increasing_id()))  # tells rows of one id, or of none, apart
    n = c.partitions(spark)
    groups = c.stash(rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")))
    n_groups = groups.count()
    buckets = max(n, -(-n_groups // BUCKET_GROUPS))
    groups = groups.withColumn("bucket", F.pmod("text_key", F.lit(buckets)).cast("int"))
    local = groups.repartition(n, "bucket").sortWithinPartitions("bucket", F.desc("bytes"), "text_key").mapInArrow(_local(shards), "bucket int, text_key long, copies long, bytes long, place int")
    local = c.stash(local)
    sums: dict[int, list[int]] = {}
    for r in local.groupBy("bucket", "place").agg(F.sum("bytes").alias("bytes")).collect():
        sums.setdefault(r["bucket"], [0] * shards)[r["place"]] = r["bytes"]
    order = sorted(sums)
    _, places = difference([sums[b] for b in order], shards)
    where = spark.createDataFrame([(b, k, p[k]) for b, p in zip(order, places, strict=True) for k in range(shards)], "bucket int, place int, shard int")
    of_group = c.join_small(local, where, ["bucket", "place"], "inner", buckets * shards).select("text_key", "shard", "copies")
    dealt = c.join_counted(rows, of_group, ["text_key"], "copies", n_groups).withColumn("chunk", F.pmod(F.xxhash64("id", "tie"), F.lit(4 * n)))
    counts = dealt.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(W.partitionBy("shard", "chunk").orderBy("id", "text_crc32", "size", "tie")) - 1
    out = dealt.withColumn("own", own).join(F.broadcast(before) if 4 * n * shards * 24 <= 32 << 20 else before, ["shard", "chunk"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
