"""Byte-level BPE encoding and decoding over a contiguous rank array.

A short word is a row of two flat arrays: its parts (in order, so the boundaries
are the positions) and the merge rank of every adjacent pair. Encoding
repeatedly scans the ranks for the minimum, deletes that boundary and refreshes
the two neighbouring ranks; the new words of a batch take these steps together,
a row each, and few words one after the other. Long words use the same rule on a heap, so that a word of n bytes
costs n log n.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import frugal, kept, table

#: Fixed value: the split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of at most this many bytes are scanned; longer ones use the heap.
SHORT = 64
#: Encoded words that a Python worker remembers before it starts afresh.
CACHE_WORDS = 300_000
NO_RANK = 1 << 30
#: Rows and width of one array of short words, and the widths they are sorted into.
ROWS, WIDTHS = 20_000, (8, 12, 16, 24, 40, SHORT)
#: Fewer words than this are scanned one by one, not in arrays of many.
FEW = 40
#: Characters of text whose new words are encoded together.
LEARN_CHARS = 4_000_000
#: A space that does not stand directly before a character of the next word.
LOOSE_SPACE = re.compile(r" (?=\s|$)")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class RankBpe:
    """Encoder and decoder for one ``tokenizer.json`` with a byte-level BPE model."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        model, letters = parsed["model"], byte_letters()
        vocab: dict[str, int] = model["vocab"]
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.byte_id = [vocab[letter] for letter in letters]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for left, right in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            self.rank.setdefault((vocab[left], vocab[right]), len(self.merged))
            self.merged.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        keys = np.array([a << 17 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = np.append(keys[order], np.int64(1) << 62), np.append(np.fromiter(self.rank.values(), np.int32)[order], np.int32(NO_RANK))
        self.merged_ids, self.byte_ids = np.array(self.merged, np.int32), np.array(self.byte_id, np.int32)
        both = self.byte_ids.astype(np.int64)
        self.byte_pairs = self.ranks_of((both[:, None] << 17 | both[None, :]).ravel()).reshape(256, 256)
        self.token_bytes: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.split = regex.compile(SPLIT)
        self.units: dict[str, bytes] = {}

    def ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, pairs)
        return np.where(self.keys[at] == pairs, self.key_rank[at], np.int32(NO_RANK))

    def merge_rows(self, raw: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of short words that are held a row each."""
        out: list[bytes] = [b""] * len(raw)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        width = int(size.max())
        cell = np.arange(width)[None, :] < size[:, None]
        letters = np.zeros(cell.shape, np.uint8)
        letters[cell] = np.frombuffer(b"".join(raw), np.uint8)
        parts = self.byte_ids[letters]
        ranks = self.byte_pairs[letters[:, :-1], letters[:, 1:]]
        ranks[~cell[:, 1:]] = NO_RANK
        ranks = np.concatenate([ranks, np.full((len(raw), 1), NO_RANK, np.int32)], 1)
        row = np.arange(len(raw))
        column = np.arange(width)[None, :]
        while True:
            at = ranks.argmin(1)
            least = ranks[np.arange(len(row)), at]
            done = least == NO_RANK
            if done.any():
                ended = np.flatnonzero(done)
                ids = parts[ended][np.arange(width)[None, :] < size[ended][:, None]].astype("<u4").tobytes()
                stop = np.cumsum(size[ended]) * 4
                for k, (a, b) in enumerate(zip((stop - size[ended] * 4).tolist(), stop.tolist())):
                    out[row[ended[k]]] = ids[a:b]
                left = ~done
                parts, ranks, row, size, at, least = parts[left], ranks[left], row[left], size[left], at[left], least[left]
            if not len(row):
                return out
            each = np.arange(len(row))
            shift = np.minimum(column + (column > at[:, None]), width - 1)
            parts = np.take_along_axis(parts, shift, 1)
            parts[each, at] = self.merged_ids[least]
            # the rank of a deleted boundary goes, and those on both of its sides are looked up again
            ranks = np.take_along_axis(ranks, np.minimum(column + (column >= at[:, None]), width - 1), 1)
            size = size - 1
            here = np.flatnonzero(at + 1 < size)
            ranks[here, at[here]] = self.ranks_of(parts[here, at[here]].astype(np.int64) << 17 | parts[here, at[here] + 1])
            here = np.flatnonzero(at > 0)
            ranks[here, at[here] - 1] = self.ranks_of(parts[here, at[here] - 1].astype(np.int64) << 17 | parts[here, at[here]])

    def merge_scan(self, parts: list[int]) -> list[int]:
        """The same steps for one short word: two flat lists, its parts and the ranks between them."""
        rank = self.rank.get
        ranks = [rank(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NO_RANK:
            at = ranks.index(least)
            parts[at : at + 2] = [self.merged[least]]
            del ranks[at]
            for k in (at - 1, at):
                if 0 <= k < len(ranks):
                    ranks[k] = rank((parts[k], parts[k + 1]), NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank.get
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, pair) for i, pair in enumerate(zip(parts, parts[1:])) if (r := rank(pair, NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := rank(pair := (parts[left], parts[right]), NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (r, left, pair))
        return [p for p in parts if p >= 0]

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of split words, short ones in arrays of like width."""
        raw = [w.encode() for w in words]
        out = [b""] * len(raw)
        rows: list[list[int]] = [[] for _ in WIDTHS]
        for k, word in enumerate(raw):
            if len(word) <= SHORT:
                rows[bisect.bisect_left(WIDTHS, len(word))].append(k)
            else:
                out[k] = b"".join(p.to_bytes(4, "little") for p in self.merge_long([self.byte_id[b] for b in word]))
        for group in rows:
            for a in range(0, len(group), ROWS):
                for k, ids in zip(group[a : a + ROWS], self.merge_rows([raw[k] for k in group[a : a + ROWS]])):
                    out[k] = ids
        return out

    def learn(self, texts: list[str]) -> None:
        """Encode the units of ``texts`` that are not known yet, all together."""
        if len(self.units) > CACHE_WORDS:
            self.units.clear()
        fresh = list({u for t in texts for u in t.split(" ")[1:] if u not in self.units})
        fresh = [u for u in fresh if len(u) <= SHORT]
        words = [[" " + u] if u.isalpha() else self.split.findall(" " + u) for u in fresh]
        ids = iter(self.merge_words([w for ws in words for w in ws]))
        for unit, ws in zip(fresh, words):
            self.units[unit] = next(ids) if len(ws) == 1 else b"".join([next(ids) for _ in ws])

    def encode_words(self, text: str) -> bytes:
        words = self.split.findall(text)
        if len(words) >= FEW:
            return b"".join(self.merge_words(words))
        ids = []
        for raw in map(str.encode, words):
            parts = [self.byte_id[b] for b in raw]
            ids += self.merge_scan(parts) if len(raw) <= SHORT else self.merge_long(parts)
        return b"".join([p.to_bytes(4, "little") for p in ids])

    def encode_unit(self, unit: str) -> bytes:
        return self.encode_words(" " + unit)

    def encode_plain(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        The split pattern always starts a new word at a space directly before a
        non-space, so the text is cut there and each unit is looked up whole.
        """
        if LOOSE_SPACE.search(text):
            return self.encode_words(text)
        first, *units = text.split(" ")
        known, slow = self.units.get, self.encode_unit
        return self.encode_words(first) + b"".join([known(u) or slow(u) for u in units])

    def encode(self, text: str) -> bytes:
        if not self.special or not self.cut.search(text):
            return self.encode_plain(text)
        pieces = self.cut.split(text)
        pieces[1::2] = [self.special[p].to_bytes(4, "little") for p in pieces[1::2]]
        pieces[::2] = [self.encode_plain(p) for p in pieces[::2]]
        return b"".join(pieces)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def learned(bpe: RankBpe, column: pa.Array) -> Iterator[str]:
    """The texts of a column, each after the units of its block are known."""
    block, chars = [], 0
    for value in column:
        block.append(value.as_py() or "")
        chars += len(block[-1])
        if chars > LEARN_CHARS:
            bpe.learn(block)
            yield from block
            block, chars = [], 0
    bpe.learn(block)
    yield from block


def encoder(spec: str) -> RankBpe:
    """The encoder of a vocabulary, kept by the Python worker for its next task."""
    return kept(hashlib.sha256(spec.encode()).hexdigest(), lambda: RankBpe(spec))


def encode_documents(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Output, a row for each row of ``docs``: doc_id, n_tokens, ids_sha256,
    decoded_sha256, and with ``keep_ids`` also ids (array<int>) and decoded.
    Null text is empty text (no tokens, hashes of nothing). Repeated rows and
    null doc_ids are kept; other columns are ignored; an empty table gives none.
    The vocabulary file has a fixed size (1.5 MB) and is broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value)
        for batch in batches:
            n, ids_hash, text_hash, ids, texts = [], [], [], [], []
            for text in learned(bpe, batch.column("text")):
                coded = bpe.encode(text)
                back = bpe.decode(coded)
                n.append(len(coded) // 4)
                ids_hash.append(hashlib.sha256(coded).hexdigest())
                text_hash.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                if keep_ids:
                    ids.append(list(memoryview(coded).cast("I")))
                    texts.append(back)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(frugal(run, keeps=True), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), default_tokenizer())
