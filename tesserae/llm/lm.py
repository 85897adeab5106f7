"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of all orders are mixed; the weights depend on how
often the context was seen and are learned by expectation-maximisation on
tokens whose own counts were deleted from the estimates.

Documents are packed into bundles of some 1.6 million tokens. A bundle sends
each distinct n-gram once, in sorted blocks by hash range, and gets the
corpus-wide counts back in the same order, so that what is exchanged follows
the distinct n-grams and no frequent one makes a hot key. Up to ``FAN`` bundles
meet directly. More are merged as a tree: groups of ``FAN`` bundles by hash
range, groups of groups by finer ranges, and the answers come back along it, so
the number of blocks grows with the input and not with its square.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_shuffles, materialise, table, words
from .shingles import Shingler, mix, pack, unpack

#: Longest n-gram.
ORDER = 3
#: Tokens of a bundle, and those whose n-grams meet in one task; bundles that meet directly.
BUNDLE_TOKENS, SLOT_TOKENS, FAN = 1_600_000, 400_000, 256
#: Documents with this remainder are held out; with the next one, deleted counts teach the weights.
FOLDS, HELD_OUT, TUNING = 10, 0, 1
EM_STEPS = 60
#: Ratios of estimates are put in cells of this many to an octave for the expectation step.
CELLS = 8
NONE = -(1 << 14)
#: Tokens of a bundle that are looked at together once it has its counts: whole documents, this many tokens or one document more.
PIECE_TOKENS = 200_000
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def key_bits(tokens: int) -> int:
    """Bits of the hash that stands for an n-gram of two words or more: one in 2^24 or fewer meets another in a corpus of so many tokens.

    Single words always have 64 bits.
    """
    return min(64, max(48, tokens.bit_length() + 24))


def remainder(doc_id: object) -> int:
    """crc32 of the id as text, modulo the folds; a null id is the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def bundle_rows(docs: DataFrame) -> DataFrame:
    """bundle, tuning, doc_ids, sizes (tokens with the end), vocabulary (hashes), tokens (places in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, shingler = TaskContext.get().partitionId(), 0, Shingler(1)
        open_: dict[bool, list] = {False: [], True: []}
        count = {False: 0, True: 0}

        def close(tuning: bool) -> pa.RecordBatch:
            nonlocal made
            ids, tokens = zip(*open_[tuning])
            joined = np.concatenate(tokens)
            vocabulary, place, seen = np.unique(joined, return_inverse=True, return_counts=True)
            order = np.argsort(-seen, kind="stable")
            back = np.empty(len(order), np.uint32)
            back[order] = np.arange(len(order), dtype=np.uint32)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) + made], pa.int64()), pa.array([tuning]), pa.array([list(ids)], pa.list_(id_type)),
                    pa.array([[len(t) for t in tokens]], pa.list_(pa.int64())),
                    pa.array([pack(vocabulary[order])], pa.binary()), pa.array([pack(back[place])], pa.binary()),
                ],
                names=["bundle", "tuning", "doc_ids", "sizes", "vocabulary", "tokens"],
            )
            made += 1
            open_[tuning], count[tuning] = [], 0
            return row

        for batch in batches:
            id_type = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                tuning = remainder(doc_id) == TUNING
                tokens = np.append(shingler.word_hashes(words(text.as_py())), END)
                open_[tuning].append((doc_id, tokens))
                count[tuning] += len(tokens)
                if count[tuning] >= BUNDLE_TOKENS:
                    yield close(tuning)
        for tuning in (False, True):
            if open_[tuning]:
                yield close(tuning)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"bundle long, tuning boolean, doc_ids array<{kind}>, sizes array<long>, vocabulary binary, tokens binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them as a 32-bit number: ``np.unique`` with less memory."""
    order = np.argsort(values)
    values = values[order]
    new = np.empty(len(values), bool)
    new[:1], new[1:] = True, values[1:] != values[:-1]
    values = values[new]
    place = np.empty(len(new), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return values, place


class Bundle:
    """The n-grams of a bundle: per order the distinct keys, and the place of each token's n-gram among them."""

    def __init__(self, doc_ids: list, sizes: list[int], vocabulary: bytes, tokens: bytes, order: int, bits: int):
        self.ids, self.sizes = doc_ids, np.array(sizes, np.int64)
        token = unpack(vocabulary, np.uint64)[unpack(tokens, np.uint32)]
        self.start = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.first = np.zeros(len(token), bool)
        self.first[self.start] = True
        self.fold = np.repeat(np.array([remainder(i) for i in doc_ids], np.int8), self.sizes)
        self.keys, self.place = [], []
        gram, before = mix(token + np.uint64(1)), token
        depth = (np.arange(len(token)) - np.repeat(self.start, self.sizes)).astype(np.int32)
        for n in range(1, order + 1):
            if n > 1:
                before = np.r_[BEGIN, before[:-1]]
                before[depth < n - 1] = BEGIN
                gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + before + np.uint64(n))
            keys, place = _distinct(gram >> np.uint64(64 - _width(n, bits)))
            self.keys.append(keys)
            self.place.append(place)

    def pieces(self) -> Iterator[tuple[slice, np.ndarray]]:
        """The tokens in pieces of whole documents, and where the documents of a piece start in it."""
        i = 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.start, self.start[i] + PIECE_TOKENS)))
            end = self.start[j] if j < len(self.start) else len(self.first)
            yield slice(int(self.start[i]), int(end)), self.start[i:j] - self.start[i]
            i = j

    def counts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the keys of order n in training documents: those that do not tune, those that do."""
        place, size = self.place[n - 1], len(self.keys[n - 1])
        return tuple(np.bincount(place[fold], minlength=size) for fold in ((self.fold != TUNING) & (self.fold != HELD_OUT), self.fold == TUNING))

    def contexts(self, n: int, counts: list[np.ndarray], docs: int, total: int, piece: slice = slice(None)) -> np.ndarray:
        """How often the context of the n-gram of every token of a piece was seen."""
        first = self.first[piece]
        if n == 1:
            return np.full(len(first), total)
        context = np.r_[0, counts[n - 2][self.place[n - 2][piece]][:-1]]
        context[first] = docs
        return context

    def buckets(self, counts: list[np.ndarray], docs: int, piece: slice = slice(None)) -> np.ndarray:
        """The longest known context of every token of a piece: 64 times its order, and the octave of its count; 0 if none is known."""
        bucket = np.zeros(len(self.first[piece]), np.int16)
        for n in range(2, len(counts) + 1):
            context = self.contexts(n, counts, docs, 0, piece)
            bucket = np.where(context > 0, (n * 64 + np.log2(np.maximum(context, 1))).astype(np.int16), bucket)
        return bucket

    def estimate(self, n: int, counts: list[np.ndarray], docs: int, total: int, piece: slice = slice(None)) -> np.ndarray:
        """The maximum-likelihood estimate of every token of a piece by order n, 0 where the context is unknown."""
        context = self.contexts(n, counts, docs, total, piece)
        return np.divide(counts[n - 1][self.place[n - 1][piece]], context, out=np.zeros(len(context)), where=context > 0)


def _width(n: int, bits: int) -> int:
    return 64 if n == 1 else bits


def _ranges(keys: np.ndarray, width: int, ranges: int) -> np.ndarray:
    """The hash range of each key; ranges of a multiple of their number nest."""
    return ((keys >> np.uint64(width - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


#: A block: sorted keys of one order in one hash range, as gaps, and their counts. It comes from ``child`` and its range there.
BLOCK = "grp long, rng long, child long, child_rng long, n int, gaps binary, main binary, tuning binary"
ANSWER = "child long, child_rng long, rng long, n int, main binary, tuning binary, found long"


def _blocks(group: int, child: int, child_rng: int, n: int, keys: np.ndarray, main: np.ndarray, tuning: np.ndarray, width: int, ranges: int) -> Iterator[tuple]:
    if not len(keys):
        return
    at = _ranges(keys, width, ranges)
    edges = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)].tolist()
    for i, j in zip(edges, edges[1:]):
        gaps = np.diff(keys[i:j], prepend=np.uint64(0))
        yield group, int(at[i]), child, child_rng, n, pack(gaps), pack(main[i:j].astype(np.uint64)), pack(tuning[i:j].astype(np.uint64))


def _arrow(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})


def _merged(blocks: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of blocks of one order, their summed counts, and the places of each block's keys among them."""
    keys = [np.cumsum(unpack(b["gaps"], np.uint64), dtype=np.uint64) for b in blocks]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(place, np.concatenate([unpack(b[c], np.uint64) for b in blocks]), len(distinct)).astype(np.int64) for c in ("main", "tuning")]
    return distinct, *sums, np.split(place, np.cumsum([len(k) for k in keys])[:-1])


def _by_order(blocks: pa.Table, order: int) -> Iterator[tuple[int, list[dict]]]:
    rows = blocks.to_pylist()
    for n in range(1, order + 1):
        if mine := [r for r in rows if r["n"] == n]:
            yield n, mine


def exchange(blocks: DataFrame, groups: int, ranges: int, order: int, bits: int, fan: int) -> tuple[DataFrame, int]:
    """What the corpus has of every block's keys, in their order (``ANSWER``), and the number of distinct unigrams in training documents."""

    def answer(blocks: list[dict], n: int, main: np.ndarray, tuning: np.ndarray, places: list[np.ndarray]) -> list[tuple]:
        return [(b["child"], b["child_rng"], b["rng"], n, pack(main[p]), pack(tuning[p]), None) for b, p in zip(blocks, places)]

    def add(range_: pa.Table) -> pa.Table:
        out = []
        for n, mine in _by_order(range_, order):
            _, main, tuning, places = _merged(mine)
            out += answer(mine, n, main, tuning, places)
            if n == 1:
                out.append((-1, 0, mine[0]["rng"], n, None, None, int(np.count_nonzero(main + tuning))))
        return _arrow(out, ANSWER)

    if groups == 1:
        counts = materialise(blocks.groupBy("rng").applyInArrow(add, ANSWER), "counts")
        distinct = counts.where("child = -1").agg(F.sum("found")).first()[0] or 0
        return counts.where("child >= 0"), distinct

    above = -(-groups // fan)

    def merge(group: pa.Table) -> pa.Table:
        out = []
        for n, mine in _by_order(group, order):
            keys, main, tuning, _ = _merged(mine)
            g, r = mine[0]["grp"], mine[0]["rng"]
            out += _blocks(g % above, g, r, n, keys, main, tuning, _width(n, bits), ranges * fan)
        return _arrow(out, BLOCK)

    def back(group: pa.Table, totals: pa.Table) -> pa.Table:
        out, found = [], sorted(totals.to_pylist(), key=lambda r: r["rng"])
        for n, mine in _by_order(group, order):
            places = _merged(mine)[3]
            main, tuning = (np.concatenate([unpack(r[c], np.int64) for r in found if r["n"] == n]) for c in ("main", "tuning"))
            out += answer(mine, n, main, tuning, places)
        return _arrow(out, ANSWER)

    blocks = materialise(blocks, "blocks")
    upper = blocks.groupBy("grp", "rng").applyInArrow(merge, BLOCK)
    totals, distinct = exchange(upper, above, ranges * fan, order, bits, fan)
    keyed = totals.withColumnRenamed("rng", "at").selectExpr("child AS grp", "child_rng AS rng", "at", "n", "main", "tuning")

    def back_keyed(key: tuple, group: pa.Table, totals: pa.Table) -> pa.Table:
        return back(group, totals.drop_columns(["grp", "rng"]).rename_columns(["rng", "n", "main", "tuning"]))

    answers = blocks.groupBy("grp", "rng").cogroup(keyed.groupBy("grp", "rng")).applyInArrow(back_keyed, ANSWER)
    return materialise(answers, "answers"), distinct


def corpus_counts(bundles: DataFrame, order: int, tokens: int, bits: int, fan: int = FAN) -> tuple[DataFrame, int]:
    """Corpus-wide counts of the keys of every bundle: answers whose ``child`` is the bundle, and the number of distinct unigrams."""
    groups = max(1, -(-bundles.count() // fan))
    ranges = max(1, -(-tokens // (groups * SLOT_TOKENS)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                b = Bundle(row["doc_ids"], row["sizes"], row["vocabulary"], row["tokens"], order, bits)
                group = int(mix(np.array([row["bundle"]], np.uint64))[0] % np.uint64(groups))
                for n in range(1, order + 1):
                    out = list(_blocks(group, row["bundle"], 0, n, b.keys[n - 1], *b.counts(n), _width(n, bits), ranges))
                    yield from _arrow(out, BLOCK).to_batches()

    blocks = bundles.select("bundle", "doc_ids", "sizes", "vocabulary", "tokens").mapInArrow(send, BLOCK)
    return exchange(blocks, groups, ranges, order, bits, fan)


def _with_counts(bundle: pa.Table, counts: pa.Table, order: int, bits: int, parts: tuple[str, ...]) -> tuple[Bundle, list[np.ndarray]]:
    """A bundle and, for each order, the corpus-wide counts of its keys, summed over ``parts``; one order is unpacked at a time."""
    row = bundle.to_pylist()[0]
    b = Bundle(row["doc_ids"], row["sizes"], row["vocabulary"], row["tokens"], order, bits)
    found = []
    for n in range(1, order + 1):
        rows = sorted(counts.filter(pc.equal(counts.column("n"), n)).select(["rng", *parts]).to_pylist(), key=lambda r: r["rng"])
        found.append(np.concatenate([sum(unpack(r[c], np.int64) for c in parts) for r in rows]))
        assert len(found[-1]) == len(b.keys[n - 1])
        b.keys[n - 1] = None  # what is left to do goes by place
    return b, found


def learn_weights(ratio: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mixture weights of a bucket by expectation-maximisation.

    ``ratio``: the estimates of orders 1 and up relative to order 0 (rows:
    cells); ``n``: how many tuning tokens each cell has. One token's worth of
    the uniform estimate is added, so that its weight is never zero.
    """
    order = ratio.shape[1]
    ratio = np.c_[np.ones(len(ratio) + 1), np.r_[ratio, np.zeros((1, order))]]
    n = np.r_[n, 1.0]
    weight = np.full(order + 1, 1 / (order + 1))
    for _ in range(EM_STEPS):
        joint = ratio * weight
        weight = (n[:, None] * joint / joint.sum(1, keepdims=True)).sum(0) / n.sum()
    return weight


def weights_of(bucket: int, learned: dict[int, np.ndarray], order: int, total: int) -> np.ndarray:
    """The weights of a bucket: its own, or those of the nearest bucket that tuning tokens were in (of its order if there is one).

    The mass of orders whose context is unknown goes to the rest.
    """
    if not learned:
        weight = np.full(order + 1, 1 / (order + 1))
    else:
        weight = learned[min(learned, key=lambda k: (abs(k // 64 - bucket // 64), abs(k - bucket), k))]
    usable = weight.copy()
    usable[max(bucket // 64, 1 if total else 0) + 1 :] = 0
    return usable / usable.sum()


def score_documents(docs: DataFrame, order: int = ORDER, fan: int = FAN) -> DataFrame:
    """Unigram base score and interpolated score (log10) of every whole text.

    Output, a row for each row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    * Null and empty texts have one token, the end.
    * A null doc_id hashes as the empty text. Repeated rows are scored each
      and, in training, counted each.
    * Without training documents all counts are 0 and both scores are those of
      the uniform estimate. Extra columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    bundles = materialise(bundle_rows(docs), "bundles")
    folds = bundles.select("tuning", F.explode(F.arrays_zip("doc_ids", "sizes")).alias("d")).select("tuning", "d.doc_ids", "d.sizes")
    fold = F.crc32(F.coalesce(F.col("doc_ids").cast("string"), F.lit("")).cast("binary")) % FOLDS
    kept = folds.groupBy("tuning", (fold != HELD_OUT).alias("trains")).agg(F.sum("sizes").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()
    tokens = {r["tuning"]: r["tokens"] for r in kept if r["trains"]}
    n_docs = {r["tuning"]: r["docs"] for r in kept if r["trains"]}
    all_tokens = sum(r["tokens"] for r in kept)
    total, train_docs = sum(tokens.values()), sum(n_docs.values())
    bits = key_bits(all_tokens)
    counts, vocabulary = corpus_counts(bundles, order, all_tokens, bits, fan)
    free_shuffles(spark)
    main_total, main_docs = tokens.get(False, 0), n_docs.get(False, 0)
    uniform = 1 / (vocabulary + 1)

    def cells_of(key: tuple, bundle: pa.Table, found: pa.Table) -> pa.Table:
        b, main = _with_counts(bundle, found, order, bits, ("main",))
        columns = np.empty((order + 1, len(b.first)), np.int16)
        for piece, _ in b.pieces():
            columns[0, piece] = b.buckets(main, main_docs, piece)
            for n in range(1, order + 1):
                with np.errstate(divide="ignore"):
                    f = b.estimate(n, main, main_docs, main_total, piece)
                    columns[n, piece] = np.where(f > 0, np.round(np.log2(f / uniform) * CELLS), NONE)
        del b, main
        stacked, n = np.unique(columns, axis=1, return_counts=True)
        return pa.table({"bucket": pa.array(stacked[0], pa.int64()), "cell": pa.array(stacked[1:].T.astype(np.int64).tolist(), pa.list_(pa.int64())), "n": n})

    def learn(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("cell_key").select(["bucket", "cell", "n"])
        cell = np.array(bucket.column("cell").to_pylist(), float).reshape(bucket.num_rows, order)
        ratio = np.where(cell == NONE, 0.0, np.exp2(cell / CELLS))
        weight = learn_weights(ratio, bucket.column("n").to_numpy().astype(float))
        return pa.table({"bucket": bucket.column("bucket")[:1], "weight": pa.array([weight.tolist()], pa.list_(pa.float64()))})

    tuned = counts.join(bundles.where("tuning").select(F.col("bundle").alias("child")), "child", "left_semi")
    tuning = bundles.where("tuning").drop("tuning").groupBy("bundle").cogroup(tuned.groupBy("child"))
    seen = tuning.applyInArrow(cells_of, "bucket long, cell array<long>, n long").groupBy("bucket", "cell").agg(F.sum("n").alias("n"))
    # a bucket's cells are as many as estimates differ at the resolution of ``CELLS``, whatever the corpus; one row a bucket comes to the driver
    seen = seen.withColumn("cell_key", F.concat_ws(",", F.transform("cell", lambda c: c.cast("string"))))
    learned = {r["bucket"]: np.array(r["weight"]) for r in seen.groupBy("bucket").applyInArrow(learn, "bucket long, weight array<double>").collect()}

    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(key: tuple, bundle: pa.Table, found: pa.Table) -> pa.Table:
        b, whole = _with_counts(bundle, found, order, bits, ("main", "tuning"))
        sums = []
        for piece, start in b.pieces():
            c = whole[0][b.place[0][piece]]
            names, place = np.unique(b.buckets(whole, train_docs, piece), return_inverse=True)
            lam = np.array([weights_of(k, learned, order, total) for k in names.tolist()])
            mixed = lam[place, 0] * uniform
            for n in range(1, order + 1):
                mixed += lam[place, n] * b.estimate(n, whole, train_docs, total, piece)
            by_token = (c > 0).astype(np.int64), np.log10((c + 0.1) / (total + 0.1 * (vocabulary + 1))), np.log10(mixed)
            sums.append([np.add.reduceat(x, start) for x in by_token])
        known, base, scores = map(np.concatenate, zip(*sums))
        return pa.table({
            "doc_id": pa.array(b.ids, bundle.schema.field("doc_ids").type.value_type),
            "held_out": pa.array([remainder(i) == HELD_OUT for i in b.ids]), "n_tokens": b.sizes,
            "n_known": known, "train_tokens": np.full(len(b.ids), total, np.int64),
            "base_score": base, "score": scores,
        })

    matched = bundles.drop("tuning").groupBy("bundle").cogroup(counts.drop("found", "child_rng").groupBy("child"))
    return matched.applyInArrow(
        score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
