"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of fixed size. All blocks are sorted and
every distinct block is named by its rank. Adjacent names of a text are paired,
the pairs are sorted and named by rank in turn, and so on until each text has
one name: two texts that took equally many levels have the same name exactly
if they are equal. Blocks are sorted by a hash first, so that range bounds are
short, and then by themselves; no hash stands for a text anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, discard, materialise, table

#: Code points of a block. The longest text sets the number of levels: log2 of its blocks.
BLOCK_CHARS = 2048
#: A group of more copies than this, and than a thousandth of all rows, is joined by broadcast: there are at most a thousand.
HOT_COPIES = 1000


def normalised(text: Column) -> Column:
    """A text without the six ASCII white-space characters; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def name_by_rank(rows: DataFrame, keys: list[str], keep: list[str], tie: list[str], tag: str, spread: str | None = None) -> DataFrame:
    """Replace ``keys`` by the rank of their values among all distinct ones, as column ``name``; the frame is materialised.

    Rows are range-sorted by the keys and by ``tie``, which spreads a value
    that very many rows share over several tasks. Each task ranks its own
    values and says what its first and last one are (two rows a task). Tasks
    next to each other compare these in a join, and the driver gets a number
    and a truth value of each task, from which the ranks follow at which they start.

    ``spread`` is a short column that depends on the keys alone. Ranges and the
    order are by it first, so no long key is sampled. If two keys share a value
    of it, that is seen, and rows are sorted by the keys alone instead.
    """

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, at, last, first, tied = TaskContext.get().partitionId(), 0, None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros((len(compared), batch.num_rows), bool)
            for k, key in enumerate(compared):
                col = batch.column(key)
                new[k, 1:] = pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
            head = [batch.column(k)[0].as_py() for k in compared]
            if last is not None:
                new[:, 0] = [x != y for x, y in zip(head, last)]
            if first is None:
                first = head
            if spread is not None:
                tied |= bool((new[1:].any(0) & ~new[0]).any())
            names = at + np.cumsum(new.any(0))
            at, last = int(names[-1]), [batch.column(k)[-1].as_py() for k in compared]
            n = batch.num_rows
            cols = [pa.nulls(n, batch.column(k).type) for k in compared] + [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(np.full(n, task), pa.int32()), pa.array(names, pa.int64()), pa.array(np.zeros(n), pa.int8()), pa.nulls(n, pa.bool_())], names=out_names
            )
        for kind, value in ((1, first), (2, last)) if first is not None else ():
            cols = [pa.array([v], t) for v, t in zip(value, types)] + [pa.nulls(1, t) for t in kept_types]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([task], pa.int32()), pa.array([at], pa.int64()), pa.array([kind], pa.int8()), pa.array([tied])], names=out_names
            )

    compared = [spread, *keys] if spread else keys
    out_names = [*compared, *keep, "task", "name", "edge", "tied"]
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    kind_of = lambda c: rows.schema[c].dataType.simpleString()
    types, kept_types = [arrow[kind_of(k)] for k in compared], [arrow[kind_of(k)] for k in keep]
    ranges, order = ([spread, *tie], [*compared, *tie]) if spread else ([*keys, *tie],) * 2
    ranked = rows.select(*compared, *keep).repartitionByRange(*ranges).sortWithinPartitions(*order)
    schema = ", ".join(f"{c} {kind_of(c)}" for c in [*compared, *keep])
    ranked = materialise(ranked.mapInArrow(rank, f"{schema}, task int, name long, edge byte, tied boolean"), tag)
    # each task's first value beside the last one of the task before it that has rows
    first = ranked.where("edge = 1").select("task", *[F.col(c).alias(f"first_{c}") for c in compared])
    before = first.select("task", F.lag("task").over(Window.orderBy("task")).alias("before"))
    last = ranked.where("edge = 2").select(F.col("task").alias("before"), *[F.col(c).alias(f"last_{c}") for c in compared])
    same = lambda cols: reduce(and_, [F.col(f"first_{c}") == F.col(f"last_{c}") for c in cols])
    met = first.join(before.where("before IS NOT NULL"), "task").join(last, "before")
    met = met.select("task", same(compared).alias("same"), (same([spread]) & ~same(keys) if spread else F.lit(False)).alias("tied"))
    follows = {r["task"]: (r["same"], r["tied"]) for r in met.collect()}
    edges = ranked.where("edge = 2").select("task", "name", "tied").collect()
    if spread and (any(r["tied"] for r in edges) or any(tied for _, tied in follows.values())):
        discard(ranked)
        return name_by_rank(rows, keys, keep, tie, tag)
    start: dict[int, int] = {}
    base = -1
    for r in sorted(edges, key=lambda r: r["task"]):
        base += not follows.get(r["task"], (False, False))[0]
        start[r["task"]] = base
        base += r["name"]
    starts = [start.get(t, 0) for t in range(max(start, default=0) + 1)]
    out = ranked.where("edge = 0").select(*keep, (F.get(F.lit(starts), F.col("task")) + F.col("name")).alias("name"))
    out._tesserae_path = ranked._tesserae_path
    return out


def name_texts(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of ``docs``: uid, doc_id, chars, text_sha256, levels, name; materialised.

    Rows have equal (levels, name) exactly if their normalised texts are equal.
    ``chars`` counts the original text; ``uid`` tells repeated rows apart.
    """
    text = normalised(F.col("text"))
    plain = docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), text.alias("t"),
    )
    blocks = F.greatest(F.lit(1), F.ceil(F.length("t") / block_chars)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.substring(F.col("t"), i * block_chars + 1, F.lit(block_chars)))
    rows = plain.select("uid", "doc_id", "chars", F.sha2("t", 256).alias("sha"), blocks.alias("blocks"), F.posexplode(cut).alias("pos", "block"))
    first = F.col("pos") == 0
    rows = rows.select(
        spread_of("block").alias("spread"), "block", "uid", "pos", "blocks", F.when(first, F.col("doc_id")).alias("doc_id"),
        F.when(first, F.col("chars")).alias("chars"), F.when(first, F.col("sha")).alias("sha"),
    )
    doc_type = docs.schema["doc_id"].dataType
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    named = name_by_rank(rows, ["block"], ["uid", "pos", "blocks", "doc_id", "chars", "sha"], ["uid", "pos"], "blocks", "spread")
    scratch = [named]
    heads = named.where("pos = 0").select(
        "uid", F.col("doc_id").cast(doc_type).alias("doc_id"), "chars", F.col("sha").alias("text_sha256"), "blocks",
        F.ceil(F.log2(F.col("blocks").cast("double"))).cast("int").alias("levels"), F.col("name").alias("block_name"),
    )
    level, names = 0, named.where("blocks > 1").select("uid", "pos", "blocks", "name")
    longest = named.agg(F.max("blocks")).first()[0] or 1
    done = []
    while longest > 1:
        level += 1
        pairs = names.groupBy("uid", (F.col("pos").bitwiseAND(F.lit(-2)) / 2).cast("int").alias("pos"), "blocks").agg(
            F.coalesce(F.min(F.when(F.col("pos") % 2 == 0, F.col("name"))), F.lit(-1)).alias("left"),
            F.coalesce(F.min(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = pairs.withColumn("blocks", F.ceil(F.col("blocks") / 2).cast("int"))
        named = name_by_rank(pairs, ["left", "right"], ["uid", "pos", "blocks"], ["uid", "pos"], f"pairs{level}")
        scratch.append(named)
        done.append(named.where("blocks = 1").select("uid", "name"))
        names = named.where("blocks > 1").select("uid", "pos", "blocks", "name")
        longest = -(-longest // 2)
    out = heads.where("blocks = 1").select("uid", "doc_id", "chars", "text_sha256", "levels", F.col("block_name").alias("name"))
    if done:
        final = reduce(DataFrame.unionAll, done)
        long = heads.where("blocks > 1").join(final, "uid").select("uid", "doc_id", "chars", "text_sha256", "levels", "name")
        out = out.unionAll(long)
    out = materialise(out, "identities")
    discard(*scratch)
    return out


def spread_of(block: str) -> Column:
    """What blocks are sorted by before themselves."""
    return F.xxhash64(block)


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Exact-duplicate groups: a row for each row of ``docs``, dropped ones too.

    Output: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised
    text). Of equal texts the row with the most code points, then the smallest
    doc_id, stays; null doc_ids come last.

    * Null text is empty text, and all empty texts are equal.
    * Repeated rows are rows of one group; of those that agree in doc_id and
      length as well, one stays.
    * Extra columns are ignored; an empty table gives no rows.
    """
    named = name_texts(docs, block_chars)
    best = F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid")))
    groups = named.groupBy("levels", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("levels", "name", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), "group_size")
    groups = materialise(groups, "groups")
    # a group of very many copies would meet in one task; there are few of them, by their size
    hot = F.col("group_size") > max(HOT_COPIES, named.count() // 1000)
    marked = named.join(F.broadcast(groups.where(hot)), ["levels", "name"], "left")
    rest = marked.where("keep_uid IS NULL").select(*named.columns).join(groups.where(~hot), ["levels", "name"])
    joined = marked.where("keep_uid IS NOT NULL").unionByName(rest)
    return joined.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Null and empty texts are one group, of which one row stays; of repeated
    rows one stays. An empty table gives no rows.
    """
    keep = exact_groups(docs, block_chars).where("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha"))
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.sha2(normalised(F.col("text")), 256).alias("sha"),
        F.length(F.coalesce("text", F.lit(""))).alias("chars"),
    )
    joined = rows.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha")))
    # rows of one doc_id may differ in white space alone: the longest is the one that stays
    one = Window.partitionBy("id", "sha").orderBy(F.desc("chars"))
    return joined.withColumn("place", F.row_number().over(one)).where("place = 1").select("row.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS pos,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id
  FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, pos = 1 AS kept, text_sha256 FROM g
"""
