"""Embedding near-dedup with hierarchical navigable small-world graphs.

The distinct vectors of a label are dealt into shards; each shard gets a graph,
and the vectors of every shard query every graph of their label. A query walks
down the layers with a beam and, from every link that it finds, on to further
links. Beams widen until an audit against brute force passes in that graph; its
queries are vectors of the graph and of other shards, and no vector counts as a
link of itself. Every similarity is verified in double precision. Two shards
meet in one task, which asks both graphs, so a link counts for both ends
whichever side found it. A task returns link counts and a spanning forest of the
links it found, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .components import components

LEAST_COSINE = 0.93
#: Vectors of a shard on average: a shard and its graph take 3 KB a vector of 64 numbers, and two of them meet in a task.
SHARD = 4096
#: Neighbours of a node (twice as many on the ground layer) and beams: of building, at first, and of a query block.
NEIGHBOURS, BUILD_BEAM, FIRST_BEAM, BLOCK = 12, 48, 32, 512
#: Audit queries of a graph from its own shard, and about as many from all of its label; the share of the true links they must find.
AUDIT, LEAST_RECALL = 64, 0.995
#: What the whole job must reach over all audits.
JOB_RECALL = 0.9
#: Similarities this near the threshold are verified from the unscaled vectors.
NEARLY = 1e-9
#: Pairs of a query and a node that are looked at together.
PAIRS = 200_000


class SmallWorld:
    """A graph over unit vectors: per layer a table of neighbours, -1 where there is none."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray] | None = None, entry: int = 0):
        self.unit = unit
        self.entry = entry
        self.layers = layers or []

    @classmethod
    def build(cls, unit: np.ndarray, seed: int = 7) -> SmallWorld:
        """Insert in doubling batches: a batch searches the graph so far and itself, then takes its neighbours."""
        n = len(unit)
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(NEIGHBOURS)).astype(int), 6)
        order = np.argsort(-level, kind="stable")  # the top layers come first, so every search starts from above
        graph = cls(unit, [np.full((n, NEIGHBOURS * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)], int(order[0]) if n else 0)
        done = 1
        while done < n:
            batch = order[done : min(n, done * 2, done + BLOCK)]
            start = np.full(len(batch), graph.entry)
            for k in range(len(graph.layers) - 1, -1, -1):
                inside = level[order[:done]] >= k
                if not inside.any():
                    continue
                beam = BUILD_BEAM if (level[batch] >= k).any() else 1
                found, _, _ = graph.search_layer(unit[batch], start, k, beam)
                start = found[:, 0]
                mine = np.flatnonzero(level[batch] >= k)
                if not len(mine):
                    continue
                among = unit[batch[mine]] @ unit[batch[mine]].T
                np.fill_diagonal(among, -2.0)
                for row, i in enumerate(mine.tolist()):
                    near = np.argsort(-among[row])[:NEIGHBOURS]
                    ids = np.r_[found[i][found[i] >= 0], batch[mine[near[among[row][near] > -2]]]]
                    graph.connect(int(batch[i]), ids.astype(np.int64), k)
            done += len(batch)
        return graph

    def pick(self, node: int, ids: np.ndarray, most: int) -> np.ndarray:
        """Neighbours in different directions first: each nearer to the node than to those picked before."""
        ids = np.unique(ids[ids != node])
        sims = self.unit[ids] @ self.unit[node]
        order = np.argsort(-sims, kind="stable")
        ids, sims = ids[order], sims[order]
        if len(ids) <= most:
            return ids
        among = self.unit[ids] @ self.unit[ids].T
        chosen: list[int] = []
        closest = np.full(len(ids), -2.0)
        for k in range(len(ids)):
            if closest[k] < sims[k]:
                chosen.append(k)
                if len(chosen) == most:
                    break
                closest = np.maximum(closest, among[k])
        rest = [k for k in range(len(ids)) if k not in set(chosen)]
        return ids[np.array((chosen + rest)[:most])]

    def connect(self, node: int, ids: np.ndarray, layer: int) -> None:
        links = self.layers[layer]
        most = links.shape[1]
        mine = self.pick(node, np.r_[ids, links[node][links[node] >= 0]], most if layer else most // 2)
        links[node] = -1
        links[node, : len(mine)] = mine
        for other in mine.tolist():
            row = links[other]
            if node in row:
                continue
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = node
            else:
                links[other] = self.pick(other, np.r_[row, node], most)

    def search_layer(self, queries: np.ndarray, start: np.ndarray, layer: int, beam: int, hit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best ``beam`` nodes of each query (-1 beyond), their similarities and what was looked at; ``hit`` marks all at the threshold or above."""
        links, n, q = self.layers[layer], len(self.unit), len(queries)
        seen = np.zeros((q, n), bool)
        every = np.arange(q)
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -2.0)
        open_ = np.zeros((q, beam), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = start, np.einsum("ij,ij->i", queries, self.unit[start]), True
        seen[every, start] = True
        if hit is not None:
            hit[every, start] = sims[:, 0] >= LEAST_COSINE - NEARLY
        active = every
        while len(active):
            best = np.where(open_[active], sims[active], -3.0).argmax(1)
            going = open_[active, best]
            active, best = active[going], best[going]
            if not len(active):
                break
            open_[active, best] = False
            near = links[ids[active, best]].astype(np.int64)
            fresh = (near >= 0) & ~seen[active[:, None], near]
            row, col = np.nonzero(fresh)
            a, b = active[row], near[row, col]
            seen[a, b] = True
            s = np.einsum("ij,ij->i", queries[a], self.unit[b])
            if hit is not None:
                hit[a, b] = s >= LEAST_COSINE - NEARLY
            new_s = np.full(near.shape, -2.0)
            new_s[row, col] = s
            all_s = np.concatenate([sims[active], new_s], 1)
            all_i = np.concatenate([ids[active], np.where(fresh, near, -1)], 1)
            all_o = np.concatenate([open_[active], fresh], 1)
            top = np.argpartition(-all_s, beam - 1, 1)[:, :beam] if all_s.shape[1] > beam else np.arange(all_s.shape[1])[None, :].repeat(len(active), 0)
            sims[active] = np.take_along_axis(all_s, top, 1)
            ids[active] = np.take_along_axis(all_i, top, 1)
            open_[active] = np.take_along_axis(all_o, top, 1)
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), seen

    def spread(self, queries: np.ndarray, hit: np.ndarray, seen: np.ndarray) -> None:
        """From every link on to the neighbours of its node, as long as they are links."""
        n = len(self.unit)
        q, node = np.nonzero(hit)
        while len(q):
            found = []
            for a in range(0, len(q), PAIRS):
                near = self.layers[0][node[a : a + PAIRS]].astype(np.int64)
                row, col = np.nonzero(near >= 0)
                pair = q[a : a + PAIRS][row] * n + near[row, col]
                pair = np.unique(pair[~seen.reshape(-1)[pair]])
                x, y = pair // n, pair % n
                seen[x, y] = True
                close = np.zeros(len(x), bool)
                for c in range(0, len(x), PAIRS):
                    close[c : c + PAIRS] = np.einsum("ij,ij->i", queries[x[c : c + PAIRS]], self.unit[y[c : c + PAIRS]]) >= LEAST_COSINE - NEARLY
                hit[x[close], y[close]] = True
                found.append((x[close], y[close]))
            q, node = (np.concatenate([f[k] for f in found]) for k in (0, 1))

    def links_of(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Which nodes are at the threshold or above, a row for each query; a beam of 0 looks at all nodes."""
        n = len(self.unit)
        hit = np.zeros((len(queries), n), bool)
        for a in range(0, len(queries), BLOCK):
            part = queries[a : a + BLOCK]
            if not beam:
                hit[a : a + BLOCK] = part @ self.unit.T >= LEAST_COSINE - NEARLY
                continue
            start = np.full(len(part), self.entry)
            for k in range(len(self.layers) - 1, 0, -1):
                start = self.search_layer(part, start, k, 1)[0][:, 0]
            seen = self.search_layer(part, start, 0, beam, hit[a : a + BLOCK])[2]
            self.spread(part, hit[a : a + BLOCK], seen)
        return hit

    def audited_beam(self, queries: np.ndarray, own: np.ndarray) -> tuple[int, int, int]:
        """The first beam, doubling, whose links pass against brute force, the true links and how many of them it found.

        ``own`` is the node that a query itself is, or -1. A graph that no beam
        below its size passes in is searched whole: its beam is 0.
        """
        true = queries @ self.unit.T >= LEAST_COSINE
        mine = np.flatnonzero(own >= 0)
        true[mine, own[mine]] = False
        beam, total = FIRST_BEAM, int(true.sum())
        while True:
            found = int((self.links_of(queries, beam) & true).sum())
            if found >= LEAST_RECALL * total:
                return beam, total, found
            beam = 0 if beam * 2 >= len(self.unit) else beam * 2


def unit_rows(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _build(group: pa.Table) -> pa.Table:
    """The graph of a shard, audited by its own vectors and the probes of its label."""
    probes = group.filter(group.column("probe"))
    group = group.filter(pa.compute.invert(group.column("probe"))).sort_by("rep")
    if not group.num_rows:
        return GRAPH.empty_table()
    as_array = lambda t: np.array(t.column("vector").to_pylist(), np.float64)
    raw, reps = as_array(group), group.column("rep").to_numpy()
    graph = SmallWorld.build(unit_rows(raw))
    own = np.unique(np.linspace(0, len(reps) - 1, min(len(reps), AUDIT)).astype(int))
    asked, nodes = graph.unit[own], own
    if probes.num_rows:
        other = probes.column("rep").to_numpy()
        at = np.minimum(np.searchsorted(reps, other), len(reps) - 1)
        asked, nodes = np.concatenate([asked, unit_rows(as_array(probes))]), np.r_[nodes, np.where(reps[at] == other, at, -1)]
    beam, true, found = graph.audited_beam(asked, nodes)
    row = [
        group.column("space")[0].as_py(), group.column("shard")[0].as_py(), group.column("shards")[0].as_py(), beam, graph.entry, true, found,
        reps.tobytes(), group.column("copies").to_numpy().tobytes(), raw.tobytes(), [x.tobytes() for x in graph.layers],
    ]
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, GRAPH)], schema=GRAPH)


GRAPH = pa.schema([
    ("space", pa.string()), ("shard", pa.int32()), ("shards", pa.int32()), ("beam", pa.int32()), ("entry", pa.int32()), ("audited", pa.int64()),
    ("found", pa.int64()), ("reps", pa.binary()), ("copies", pa.binary()), ("raw", pa.binary()), ("layers", pa.list_(pa.binary())),
])


class Shard:
    """A shard with its graph, as a row of ``GRAPH`` holds it."""

    def __init__(self, row: dict):
        self.reps, self.copies, self.beam = np.frombuffer(row["reps"], np.int64), np.frombuffer(row["copies"], np.int64), row["beam"]
        self.raw = np.frombuffer(row["raw"]).reshape(len(self.reps), -1)
        self.graph = SmallWorld(unit_rows(self.raw), [np.frombuffer(x, np.int32).reshape(len(self.reps), -1) for x in row["layers"]], row["entry"])


def _verified(hit: np.ndarray, a: Shard, b: Shard) -> np.ndarray:
    """``hit`` (rows of a, columns of b) without pairs that are below the threshold in double precision."""
    for start in range(0, len(hit), BLOCK):
        block = hit[start : start + BLOCK]
        x, y = np.nonzero(block)
        for k in range(0, len(x), PAIRS):
            i, j = x[k : k + PAIRS], y[k : k + PAIRS]
            s = np.einsum("ij,ij->i", a.graph.unit[start + i], b.graph.unit[j])
            close = np.flatnonzero(np.abs(s - LEAST_COSINE) <= NEARLY)
            if len(close):
                u, v = a.raw[start + i[close]], b.raw[j[close]]
                s[close] = (u * v).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1)))
            block[i, j] = s >= LEAST_COSINE
    return hit


def _forest(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (of the ids a and b) that connect what ``hit`` links; a row or column is looked at once."""
    edges, rows_left, columns_left = [], np.ones(len(a), bool), np.ones(len(b), bool)
    for first in np.flatnonzero(hit.any(1)).tolist():
        if not rows_left[first]:
            continue
        rows_left[first] = False
        rows = [first]
        while rows:
            row = rows.pop()
            columns = np.flatnonzero(hit[row] & columns_left)
            columns_left[columns] = False
            for c in columns.tolist():
                edges.append((int(a[row]), int(b[c])))
                more = np.flatnonzero(hit[:, c] & rows_left)
                rows_left[more] = False
                edges += [(int(a[r]), int(b[c])) for r in more.tolist()]
                rows += more.tolist()
    return edges


def _query(pair: pa.Table) -> pa.Table:
    """Links between two shards, or within one: what either graph finds for the vectors of the other."""
    rows = sorted(pair.to_pylist(), key=lambda r: r["shard"])
    if len(rows) < 2 and rows[0]["low"] < rows[0]["high"]:
        rows = []  # the other shard got no vector
    if not rows:
        return pa.table({k: pa.array([], pa.int64()) for k in ("a", "b", "links")})
    shards = [Shard(r) for r in rows]
    a, b = shards[0], shards[-1]
    hit = b.graph.links_of(a.graph.unit, b.beam)
    hit |= (hit if a is b else a.graph.links_of(b.graph.unit, a.beam)).T
    if a is b:
        np.fill_diagonal(hit, False)
    hit = _verified(hit, a, b)
    counted: list[tuple[int, int]] = []
    for mine, links in ((a, hit @ b.copies), *(((b, a.copies @ hit),) if a is not b else ())):
        counted += [(int(mine.reps[k]), int(links[k])) for k in np.flatnonzero(links).tolist()]
    edges = _forest(hit, a.reps, b.reps)
    return pa.table({
        "a": pa.array([r for r, _ in counted] + [x for x, _ in edges], pa.int64()),
        "b": pa.array([None] * len(counted) + [y for _, y in edges], pa.int64()),
        "links": pa.array([n for _, n in counted] + [0] * len(edges), pa.int64()),
    })


def shard_graphs(nodes: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """A row of ``GRAPH`` for each shard of ``nodes`` (space, vector_key, vector, rep, copies).

    ``audited`` and ``found`` are the true links of the audit's queries and how
    many of them the graph finds at its beam.
    """
    spaces = nodes.groupBy("space").agg(F.count(F.lit(1)).alias("size"))
    spaces = spaces.select("space", F.ceil(F.col("size") / shard_rows).cast("int").alias("shards"), F.ceil(F.col("size") / AUDIT).alias("every"))
    dealt = nodes.join(spaces, "space").withColumn("shard", F.pmod(F.xxhash64("vector_key"), F.col("shards")).cast("int"))
    # about AUDIT vectors of a label, by hash, ask each of its graphs: a share that is known beforehand
    sample = dealt.where(F.pmod(F.xxhash64("vector_key", F.lit(1)), F.col("every")) == 0)
    names = ["space", "shard", "shards", "rep", "copies", "vector"]
    probes = sample.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(*names, F.lit(True).alias("probe"))
    kind = "space string, shard int, shards int, beam int, entry int, audited long, found long, reps binary, copies binary, raw binary, layers array<binary>"
    return dealt.select(*names, F.lit(False).alias("probe")).unionAll(probes).groupBy("space", "shard").applyInArrow(_build, kind)


def audited_recall(graphs: DataFrame) -> float:
    """The share of the audits' true links that the graphs find; 1 if there are none."""
    true, found = graphs.agg(F.sum("audited"), F.sum("found")).first()
    return found / true if true else 1.0


def near_embeddings(vectors: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """Links and components of the vectors of equal, non-null labels.

    Output, a row for each row of ``vectors``: vec_id, n_links (other rows
    linked directly), component_id (smallest vec_id reachable), kept.

    * A null label, or a vector that is null, empty, zero or has a null or
      non-finite component, links with nothing and is kept. Vectors of
      different lengths do not link.
    * Equal vectors of a label are one node, however many rows have it; each of
      these rows counts in n_links.
    * A null vec_id is larger than any other. Extra columns are ignored; an
      empty table gives no rows.
    """
    vector = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", vector.alias("vector"))
    rows = rows.withColumn("space", F.when(usable(F.col("vector")) & F.col("label").isNotNull(), F.concat_ws(":", F.size("vector"), F.col("label").cast("string"))))
    rows = rows.withColumn("vector_key", F.xxhash64("vector"))
    rows = materialise(rows.drop("label"), "vectors")
    key = ["space", "vector_key", "vector"]
    nodes = rows.where("space IS NOT NULL").groupBy(*key).agg(F.min("uid").alias("rep"), F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    nodes = materialise(nodes, "nodes")
    graphs = materialise(shard_graphs(nodes, shard_rows), "graphs")
    if (recall := audited_recall(graphs)) < JOB_RECALL:
        raise RuntimeError(f"the audits found {recall:.3f} of the true links, {JOB_RECALL} is asked for")
    # every two shards of a label meet once; each ships its vectors and graph to the tasks it takes part in
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other")
    shipped = graphs.select("*", other).withColumn("low", F.least("shard", "other")).withColumn("high", F.greatest("shard", "other"))
    met = shipped.drop("other", "shards", "audited", "found").groupBy("space", "low", "high")
    found = materialise(met.applyInArrow(_query, "a long, b long, links long"), "links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("found"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    least = roots.join(nodes.select(F.col("rep").alias("node"), "least_id"), "node")
    ids = least.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_node = least.join(ids, "root").select(F.col("node").alias("rep"), "component_id")
    known = nodes.select(*key, "rep", "least_id", "copies").join(counts, "rep", "left").join(by_node, "rep", "left")
    known = known.select(
        F.col("space").alias("s"), F.col("vector_key").alias("k"), F.col("vector").alias("v"),
        (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"),
    )
    same = (F.col("space") == F.col("s")) & (F.col("vector_key") == F.col("k")) & (F.col("vector") == F.col("v"))
    component = F.when(F.col("s").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.join(known, same, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


OP5_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND a.usable AND b.usable AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, v.vec_id) AS component_id,
  coalesce(c.component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""
