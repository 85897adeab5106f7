"""Classifier, dedup, joins, scoring and the pipeline against brute force, with edge cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserae.llm import components, embeddings, exact_dedup, jaccard, lm, mixing, quality

DOCS = "doc_id long, text string"
SOURCED = f"{DOCS}, source string"


def ascii_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 120)] + [(7, 7), (3, 4)]
    rng.shuffle(chain)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 120)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ab \n") for _ in range(n)) for n in (0, 3, 15, 16, 17, 64, 65, 200)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, t.replace(" ", "\t ")) for k, t in enumerate(base)] + [(5, base[5]), (300, None), (None, base[2]), (301, "ab" * 100 + "c"), (302, "ab" * 100 + "d")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("name", F.lit(1)).withColumn("uid", F.lit(2))
    got = exact_dedup.exact_groups(docs, block_chars=4).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    want = collections.Counter()
    for members in groups.values():
        best = min(members)[2]
        for _, _, i in members:
            want[(i, best, len(members))] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_exact(docs, block_chars=4)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(docs.where("false")).count() == 0


@pytest.mark.parametrize("spread", ["0L", "pmod(xxhash64(block), 3)"])
def test_exact_dedup_when_spreads_tie(spark, monkeypatch, spread):
    """Blocks that share what they are sorted by first are still told apart."""
    monkeypatch.setattr(exact_dedup, "spread_of", lambda block: F.expr(spread))
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.choice([0, 3, 9, 20]))), "s") for k in range(120)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, SOURCED).repartition(5), 4).collect()}
    groups = collections.defaultdict(list)
    for k, t, _ in rows:
        groups[t].append(k)
    assert got == {k: (min(groups[t]), len(groups[t])) for k, t, _ in rows}


ODD = ["a.b", "_id", "_sha", "row", "id", "from", "hash", "copy", "words", "chars", "place", "keep_id", "unnamed", "text_hash", "rated", "size", "taken", "`q`"]


def test_stages_keep_columns_of_any_name(spark):
    rows = [(1, "one two three four five six", "s"), (1, "one two three four five six", "s"), (None, None, None), (2, "", "s"), (3, "alpha beta gamma delta", "t"), (4, " alpha beta\ngamma delta", "t"), (5, "word " * 30_000, "u")]
    docs = spark.createDataFrame(rows, SOURCED).select("*", *[F.lit(k).alias(c) for k, c in enumerate(ODD)])
    model = quality.OrdinalModel(np.zeros(1 << quality.FEATURE_BITS, np.float32), np.array([-40.0, -40.0]))
    for stage in (exact_dedup.drop_exact, jaccard.drop_near, mixing.mix_documents, lambda d: quality.rate(d, model).select(*[F.col("`" + c.replace("`", "``") + "`") for c in d.columns])):
        out = stage(docs)
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[len(docs.columns) - len(ODD) :] == tuple(range(len(ODD))) for r in found)
        assert stage(docs.where("false")).count() == 0
    assert sorted(r.doc_id or 0 for r in exact_dedup.drop_exact(docs).collect()) == [1, 2, 4, 5]


def brute_jaccard(rows, width, percent):
    sets, root = {}, {}
    for i, t in rows:
        w = ascii_words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        root[i] = i
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width, percent, tile", [(3, 90, 256), (3, 90, 6), (5, 80, 8)])
def test_jaccard_join(spark, monkeypatch, width, percent, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = random.Random(width + tile)
    vocabulary = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 11, 13, 30, 120]))]
        for _ in range(rng.choice([1, 3, 14])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    rows = list(enumerate([*texts, "", None, " \t", "A b", "a B"]))
    docs = spark.createDataFrame(rows, DOCS).withColumn("pivot", F.lit(1)).withColumn("uid", F.lit(1)).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs, width, percent).collect()}
    assert got == brute_jaccard(rows, width, percent)


def test_jaccard_edges(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (4, None)], DOCS)
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in jaccard.jaccard_groups(docs).collect()))) == sorted(map(str, [(1, 1), (1, 1), (None, 1), (None, None), (4, 4)]))
    assert jaccard.jaccard_groups(docs.where("false")).count() == 0
    near = jaccard.drop_near(docs)
    assert near.columns == docs.columns


def test_drop_near_by_class(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:-1], "other"])
    rows = [
        (None, "one two three four"), (None, "five six seven eight"), (None, "five six seven eight"), (7, "red green blue grey"), (7, "cat dog cow hen"),
        (3, " ".join(base)), (None, near), (9, near), (None, None), (None, ""), (4, None), (4, None), (5, "a b c d e"), (5, "a b c d e"),
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumn("uid", F.lit(1)).repartition(3)
    got = collections.Counter((r.doc_id, r.text) for r in jaccard.drop_near(docs, 5, 80).collect())
    assert got == collections.Counter([rows[k] for k in (0, 1, 3, 4, 5, 8, 9, 10, 11, 12)])


def test_region_recursion_is_exact():
    rng = np.random.default_rng(0)
    pool = [np.unique(rng.integers(0, 1 << 60, 60).astype(np.uint64)) for _ in range(4)]
    sets = []
    for _ in range(160):
        s = pool[rng.integers(4)].copy()
        for _ in range(rng.integers(0, 8)):
            s[rng.integers(len(s))] = rng.integers(0, 1 << 60)
        sets.append(np.unique(s))
    region = jaccard.Region(sets, 90)
    region.join(np.arange(len(sets)))
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert [region.find(k) for k in range(len(sets))] == [find(k) for k in range(len(sets))]


@pytest.mark.parametrize("n, tile, spread", [(10_000, 256, 12), (1_500, 32, 3)])
def test_large_region(spark, monkeypatch, n, tile, spread):
    """A region of many members, one of its clusters hot: all linked pairs are connected, whatever parities, cells and tiles do."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = np.random.default_rng(n)
    bases = [np.unique(rng.integers(0, 1 << 60, 40).astype(np.uint64)) for _ in range(n // 20)]
    sets = []
    for k in range(n):
        s = bases[0 if k % 5 == 0 else k % len(bases)].copy()
        s[rng.integers(0, len(s), rng.integers(0, spread))] = rng.integers(0, 1 << 60, 1)
        sets.append(np.unique(s))
    rows = [(k, len(s), s.tobytes(), jaccard.parity_bits(s)) for k, s in enumerate(sets)]
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=["uid", "n_shingles", "shingles", "parity"])).repartition(8)
    members = frame.selectExpr("-7L AS pivot", "uid")
    near = jaccard.materialise(jaccard.without_far(members, frame, 90), "near")
    links = jaccard.region_links(near, frame.select("uid", "shingles"), 90).collect()

    def roots(pairs):
        root = list(range(n))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in pairs:
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        return [find(k) for k in range(n)]

    by_base = collections.defaultdict(list)
    for k in range(n):
        by_base[0 if k % 5 == 0 else k % len(bases)].append(k)
    want = []
    for same in by_base.values():  # sets of different bases share nothing
        universe = np.unique(np.concatenate([sets[k] for k in same]))
        table = np.zeros((len(same), len(universe)), np.float32)
        for row, k in enumerate(same):
            table[row, np.searchsorted(universe, sets[k])] = 1
        both = table @ table.T
        size = table.sum(1)
        want += [(same[x], same[y]) for x, y in zip(*np.nonzero(100 * both >= 90 * (size[:, None] + size[None, :] - both))) if x < y]
    assert roots((r.a, r.b) for r in links) == roots(want)


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(k, [float(x) for x in centres[k % 12] + rng.normal(size=16) * (0.12 if k % 3 else 0.6)], int(k % 12 % 3)) for k in range(300)]
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (402, rows[0][1], None), (403, None, 0), (404, [0.0] * 16, 0), (405, [float("nan")] * 16, 0), (406, [None] * 16, 0), (407, [], 0), (None, rows[0][1], 0)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("space", F.lit(1))
    got = embeddings.near_embeddings(docs, shard_rows=64).collect()
    usable = [(i, np.array(v, np.float32).astype(float), c) for i, v, c in rows if c is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    root = list(range(len(usable)))
    find = lambda x: x if root[x] == x else find(root[x])
    links = [0] * len(usable)
    for a in range(len(usable)):
        for b in range(a):
            x, y = usable[a][1], usable[b][1]
            if usable[a][2] == usable[b][2] and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    key = lambda i: (i is None, i)
    least = {find(k): min((usable[j][0] for j in range(len(usable)) if find(j) == find(k)), key=key) for k in range(len(usable))}
    want = {i: (0, i) for i, _, _ in rows} | {usable[k][0]: (links[k], least[find(k)]) for k in range(len(usable))}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.near_embeddings(docs.where("false")).count() == 0


def test_embeddings_walk_the_graphs(spark):
    """Shards of some 500 vectors, one hot group of near copies: no graph is searched whole, and links equal brute force but for a few."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(150, 24))
    rows = [(k, (centres[k % 150] + rng.normal(size=24) * (0.16 if k % 4 else 0.5)).tolist(), 0) for k in range(1500)]
    rows += [(2000 + k, (centres[0] + rng.normal(size=24) * 0.05).tolist(), 0) for k in range(500)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    nodes = docs.selectExpr("'x' AS space", "xxhash64(embedding) AS vector_key", "embedding AS vector", "vec_id AS rep", "1L AS copies")
    graphs = embeddings.shard_graphs(nodes, shard_rows=500).select("shard", "beam", "audited", "found").collect()
    assert len(graphs) == 4 and all(g.beam > 0 for g in graphs) and all(g.audited > 500 and g.found >= 0.995 * g.audited for g in graphs)
    got = {r.vec_id: r for r in embeddings.near_embeddings(docs, shard_rows=500).collect()}
    unit = embeddings.unit_rows(np.array([r[1] for r in rows]))
    links = unit @ unit.T >= 0.93
    np.fill_diagonal(links, False)
    found = np.array([got[i].n_links for i, _, _ in rows])
    assert (found <= links.sum(1)).all() and found.sum() >= 0.99 * links.sum()
    whole = {k: got[i].component_id for k, (i, _, _) in enumerate(rows)}
    assert sum(whole[x] != whole[y] for x, y in zip(*np.nonzero(links))) <= 0.01 * links.sum()


def test_lm_scores(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "mat", "A", "dog"]) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    rows = [*enumerate(texts), (500, None), (501, ""), (501, ""), (None, "zebra cat")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1))
    got = lm.score_documents(docs).collect()
    assert len(got) == len(rows)
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    counts = collections.Counter(w for i, t in rows if crc(i) for w in [*ascii_words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    by_id = {r.doc_id: r for r in got}
    for i, t in rows:
        w = [*ascii_words(t), None]
        r = by_id[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[x] > 0 for x in w), total, crc(i) == 0)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w))
        assert math.isfinite(r.score) and r.score < 0
    assert lm.score_documents(docs.where("false")).count() == 0


def test_lm_sees_two_words_of_context(spark):
    crc = lambda i: zlib.crc32(str(i).encode()) % 10
    out = [i for i in range(200) if crc(i) == 0]
    rows = [(i, "a x p z z b x q z z") for i in range(200) if crc(i)] + [(out[0], "a x p z z"), (out[1], "a x q z z")]
    got = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[out[0]] > got[out[1]] + 0.1  # to one word of context they are alike


def brute_scores(rows, order):
    """Deleted interpolation written out over dictionaries; rows are (doc_id, text)."""
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10

    def grams(text):
        w = [*ascii_words(text), "</s>"]
        return [[tuple((["<s>"] * order + w)[k + order + 1 - n : k + order + 1]) for n in range(1, order + 1)] for k in range(len(w))]

    def counted(folds):
        c, docs, total = [collections.Counter() for _ in range(order + 1)], 0, 0
        for i, t in rows:
            if crc(i) in folds:
                docs += 1
                for by_order in grams(t):
                    total += 1
                    for n, g in enumerate(by_order, 1):
                        c[n][g] += 1
        return c, docs, total

    everything = counted(set(range(1, 10)))
    vocabulary = len(everything[0][1])

    def estimates(text, counts):
        c, docs, total = counts
        before = None
        for by_order in grams(text):
            f, bucket = [1 / (vocabulary + 1)], 0
            for n, g in enumerate(by_order, 1):
                context = total if n == 1 else docs if before is None else c[n - 1][before[n - 2]]
                f.append(c[n][g] / context if context else 0.0)
                if n > 1 and context:
                    bucket = n * 64 + int(math.log2(context))
            yield f, bucket
            before = by_order

    main, cells = counted(set(range(2, 10))), {}
    for i, t in rows:
        if crc(i) == 1:
            for f, bucket in estimates(t, main):
                cell = tuple(round(math.log2(x / f[0]) * lm.CELLS) if x else None for x in f[1:])
                cells.setdefault(bucket, collections.Counter())[cell] += 1
    learned = {}
    for bucket, some in cells.items():
        points = [([1.0, *(0.0 if x is None else 2 ** (x / lm.CELLS) for x in cell)], m) for cell, m in some.items()] + [([1.0] + [0.0] * order, 1)]
        w, mass = [1 / (order + 1)] * (order + 1), sum(m for _, m in points)
        for _ in range(lm.EM_STEPS):
            new = [0.0] * (order + 1)
            for r, m in points:
                joint = [x * y for x, y in zip(r, w)]
                for k, x in enumerate(joint):
                    new[k] += m * x / sum(joint)
            w = [x / mass for x in new]
        learned[bucket] = w
    out = []
    for _, t in rows:
        score = 0.0
        for f, bucket in estimates(t, everything):
            w = learned[min(learned, key=lambda k: (abs(k // 64 - bucket // 64), abs(k - bucket), k))] if learned else [1 / (order + 1)] * (order + 1)
            w = [x if n <= max(bucket // 64, 1 if everything[2] else 0) else 0.0 for n, x in enumerate(w)]
            score += math.log10(sum(x * y for x, y in zip(w, f)) / sum(w))
        out.append(score)
    return out


@pytest.mark.parametrize("order, fan, bundle", [(2, 256, 2_000_000), (3, 256, 300), (3, 2, 150), (4, 3, 200)])
def test_lm_scores_equal_brute_force(spark, monkeypatch, order, fan, bundle):
    monkeypatch.setattr(lm, "BUNDLE_TOKENS", bundle)
    monkeypatch.setattr(lm, "SLOT_TOKENS", 400)
    rng = random.Random(order)
    words = ["the", "cat", "sat", "on", "mat", "a", "dog", *(f"w{k}" for k in range(40))]
    rows = [(k, " ".join(rng.choice(words[: rng.choice([4, 8, 47])]) for _ in range(rng.randint(0, 25)))) for k in range(250)]
    rows += [(600, None), (601, ""), (None, "zebra the cat"), (602, "the cat " * 300)]
    got = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(rows, DOCS).repartition(3), order, fan).collect()}
    for (i, _), want in zip(rows, brute_scores(rows, order)):
        assert got[i] == pytest.approx(want, rel=1e-6), i


def test_lm_bundle_is_small_and_comes_in_pieces():
    import tracemalloc

    rng = np.random.default_rng(2)
    sizes = [1, 250_000, *rng.integers(1, 3000, 500).tolist()]
    vocabulary, place = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.zipf(1.3, sum(sizes)) % 5000
    packed = lm.pack(vocabulary), lm.pack(place.astype(np.uint32))
    tracemalloc.start()
    b = lm.Bundle(list(range(len(sizes))), sizes, *packed, 3, 48)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 85 * sum(sizes)
    pieces = list(b.pieces())
    assert [p.start for p, _ in pieces] == [0, *[p.stop for p, _ in pieces]][:-1] and pieces[-1][0].stop == sum(sizes)
    assert np.concatenate([s + p.start for p, s in pieces]).tolist() == b.start.tolist() and len(pieces) > 3
    counts = [rng.integers(0, 9, len(k)) for k in b.keys]
    assert np.array_equal(np.concatenate([b.buckets(counts, 7, p) for p, _ in pieces]), b.buckets(counts, 7))
    for n in (1, 2, 3):
        assert np.array_equal(np.concatenate([b.estimate(n, counts, 7, 99, p) for p, _ in pieces]), b.estimate(n, counts, 7, 99))


def test_lm_probabilities_sum_to_one():
    tokens = np.array([1, 2, 1, 3, int(lm.END), 1, 2, int(lm.END)], np.uint64)
    vocabulary, place = np.unique(tokens, return_inverse=True)
    b = lm.Bundle([3, 4], [5, 3], lm.pack(vocabulary), lm.pack(place.astype(np.uint32)), 2, 48)
    counts = [np.bincount(p, minlength=len(k)) for p, k in zip(b.place, b.keys)]
    after_one = [1, 3, 6]  # tokens whose context is the token 1, which occurs three times
    assert sorted(b.estimate(2, counts, 2, 8)[after_one]) == pytest.approx([1 / 3, 2 / 3, 2 / 3]) and b.estimate(1, counts, 2, 8)[0] == 3 / 8
    w = lm.learn_weights(np.array([[2.0, 8.0], [2.0, 0.0]]), np.array([9.0, 1.0]))
    assert w.sum() == pytest.approx(1) and w[0] > 0 and w[2] > 0.5


def test_quality_holds_out(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(600):
        kind = rng.choice(["good", "good", "junk", "toxic"])
        w = [rng.choice(["the", "house", "stands", "by", "river", "and", "trees"]) for _ in range(rng.randint(15, 60))]
        if kind == "toxic":
            w[3:3] = [rng.choice(["idiot", "moron"])] * 2
        rows.append((k, " ".join(w) if kind != "junk" else "!! ".join(x.upper() for x in w) + "!!"))
        if k < 400:
            labels.append((k, int(kind != "junk"), int(kind == "toxic")))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], DOCS).withColumn("grade", F.lit(1)).withColumn("selected", F.lit(1))
    marks = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, marks)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality.rate(docs, model).collect()}
    good = {k for k, t in rows if "!!" not in t and not re.search("idiot|moron", t)}
    wrong = [k for k, _ in rows[400:] if got[k].selected != (k in good)]
    assert len(wrong) <= 6 and len(got) == 602 and 0 <= got[900].tail_probability <= 1
    empty = quality.train(docs, marks.where("false"))
    assert all(r.selected for r in quality.rate(docs.limit(5), empty).collect())
    assert quality.rate(docs.where("false"), model).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, sf)
        assert docs.columns == before.columns, name
        docs = spark.createDataFrame(docs.collect(), before.schema)
        if name == "exact dedup":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
            assert collections.Counter({norm(r.text): 1 for r in before.collect()}) == collections.Counter(norm(r.text) for r in docs.collect())
        if name == "n-gram Jaccard join":
            want = brute_jaccard([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert {r.doc_id for r in docs.collect()} == {root for _, root in want.values()}
    out = p.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count()


def test_pipeline_odd_rows(spark):
    """Nulls, repeated rows, empty texts, ties and a clashing column go through all five stages; an empty table stays empty."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    some = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    nothing = some.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in some.schema])
    blank = some.limit(2).withColumn("text", F.lit(" \n "))
    docs = some.unionAll(some.where("doc_id < 5")).unionAll(nothing).unionAll(nothing).unionAll(blank).withColumn("row", F.lit(9))
    for start in (docs, docs.where("false")):
        now = start
        for name, stage in p.STAGES:
            now = p.materialise(stage(spark, now, sf), "test")
            assert name == p.STAGES[-1][0] or now.columns == docs.columns
        assert (now.count() > 0) == (start is docs)


def test_pipeline_gives_workers_small_batches(spark):
    """However many rows a partition has, a worker gets few bytes of them at a time; a session's own smaller batches stay."""
    import corpus_pipeline as p

    common = p.quality_stage.__globals__["small_batches"].__globals__
    was = spark.conf.get(common["BATCH_SETTING"])
    docs = spark.range(400, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 10000) AS text", "'s' AS source")

    def sizes(batches):
        for batch in batches:
            yield batch.from_pydict({"bytes": [batch.nbytes]})

    try:
        for _, stage in (p.STAGES[1], p.STAGES[4]):
            spark.conf.set(common["BATCH_SETTING"], "64m")
            stage(spark, docs, "")
            got = [r.bytes for r in docs.mapInArrow(sizes, "bytes long").collect()]
            assert sum(got) >= 400 * 50_000 and max(got) <= common["BATCH_BYTES"] + 60_000
        spark.conf.set(common["BATCH_SETTING"], "1m")
        p.bpe_stage(spark, docs, "")
        assert spark.conf.get(common["BATCH_SETTING"]) == "1m"
    finally:
        spark.conf.set(common["BATCH_SETTING"], was)


def test_worker_keeps_one_operator():
    """A Python worker lives on after its task; what one operator remembers must not be added to what the next one needs."""
    from tesserae.llm import bpe, common

    def remembers(batches):
        encoder = bpe.encoder(open(bpe.default_tokenizer(), encoding="utf-8").read())
        for batch in batches:
            encoder.learn(batch)
            yield len(encoder.units)

    def other(batches):
        assert not common._kept
        yield from batches

    try:
        assert list(common.frugal(remembers, keeps=True)([["one two three"]])) == [2]
        assert list(common.frugal(remembers, keeps=True)([["four five"]])) == [3]  # the next task of the operator goes on
        assert list(common.frugal(other)([5, 6])) == [5, 6]
        common.kept("a", list)
        assert common.kept("b", dict) == {} and list(common._kept) == ["b"]
    finally:
        common._kept.clear()
