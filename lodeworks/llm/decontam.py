"""Held-out test passages inside a corpus.

The test items' n-grams of normalised words become a set of 64-bit hashes in
one sorted array, with the place of each n-gram in its item's text. The array
and the texts are broadcast after a check of the number of n-grams; each
document is scanned once, in place, with no shuffle of the corpus, and a hit
counts only if the n-gram's text agrees.

A larger set is met in two steps: a Bloom filter of fixed size, built without
gathering the hashes, picks the documents that may hold an n-gram, and only
their suspicious n-grams meet those of the items in a shuffled join, by hash
and text.

Defined results: null or empty texts and items of fewer than n words hold
nothing; repeated rows give their result once; rows of one doc_id that differ
in their text are cleaned apart; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.hashing import MIX, mixed
from lodeworks.functions.text import normalised
from lodeworks.operators.pairs import meet
from lodeworks.session import materialize

N = 12
#: n-grams up to which the set is broadcast; with their texts they take about 30 bytes each in a Python worker.
MAX_BROADCAST = 4_000_000
#: The Bloom filter beyond it: BLOOM_BLOCKS blocks of 2**BLOOM_BITS bits, 64 MB in all, and the bits set for an n-gram.
BLOOM_BLOCKS, BLOOM_BITS, BLOOM_HASHES = 512, 20, 4
_TOKEN = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_CACHE = 500_000


def grams(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


class Hasher:
    """64-bit hashes of the n-grams of lists of words; each word is hashed once."""

    def __init__(self, n: int) -> None:
        self.n, self.known, self.table = n, {}, np.zeros(0, dtype=np.uint64)

    def __getstate__(self):
        return {"n": self.n, "known": {}, "table": np.zeros(0, dtype=np.uint64)}

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, offsets): those of every n consecutive words, text after text."""
        if len(self.known) > _CACHE:
            self.known, self.table = {}, np.zeros(0, dtype=np.uint64)
        new = list(set().union(*texts).difference(self.known))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.table = np.concatenate([self.table, np.array([xxhash.xxh64_intdigest(w) for w in new], dtype=np.uint64)])
        number, flat = self.known.__getitem__, []
        for words in texts:
            flat += map(number, words)
        values, counts = self.table[np.array(flat, dtype=np.int64)], np.array([len(w) for w in texts], dtype=np.int64)
        windows = np.maximum(counts - self.n + 1, 0)
        rolled = np.zeros(max(0, len(values) - self.n + 1), dtype=np.uint64)
        for j in range(self.n):
            rolled = rolled * MIX + values[j : len(rolled) + j]
        starts = np.cumsum(counts) - counts
        keep = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        return mixed(rolled[keep]), np.concatenate([[0], np.cumsum(windows)])


class Scanner:
    """The n-grams of test items: sorted hashes with the item and place of each, the items' texts, and a bitmap of the hashes that are there at all."""

    def __init__(self, items: list[tuple[int, str | None]], n: int) -> None:
        self.n, self.hasher = n, Hasher(n)
        words = [normalised(text).split() for _, text in items]
        self.ids, self.texts = [i for i, _ in items], [" ".join(w) for w in words]
        hashes, offsets = self.hasher(words)
        owner = np.repeat(np.arange(len(items), dtype=np.int32), np.diff(offsets))
        starts = [np.cumsum([0, *(len(x) + 1 for x in w)])[: max(0, len(w) - n + 1)] for w in words]
        place = np.concatenate([*starts, np.zeros(0)]).astype(np.int32)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], owner[order], place[order]
        self.shift = np.uint64(64 - int(np.clip(np.ceil(np.log2(len(hashes) * 16 + 1)), 10, 28)))
        self.there = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.there[self.hashes >> self.shift] = True

    def hits(self, texts: list[list[str]]):
        """(text number, start word, item id) of each n-gram of the texts that is one of an item."""
        hashes, offsets = self.hasher(texts)
        some = np.flatnonzero(self.there[hashes >> self.shift])
        low, high = (np.searchsorted(self.hashes, hashes[some], side) for side in ("left", "right"))
        for at, lo, hi in zip(some[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
            text = int(np.searchsorted(offsets, at, "right")) - 1
            start = at - int(offsets[text])
            gram = " ".join(texts[text][start : start + self.n])
            for k in range(lo, hi):
                item, place = self.owner[k], self.place[k]
                if self.texts[item][place : place + len(gram) + 1].rstrip(" ") == gram:
                    yield text, start, self.ids[item]


def _batches_of_words(batch: pd.DataFrame, characters: int = 4_000_000):
    """(rows, their words) of parts of a batch of about that many characters."""
    rows, words, held = [], [], 0
    for row, text in enumerate(batch["text"]):
        rows.append(row)
        words.append(normalised(text).split() if text else [])
        held += len(text or "")
        if held > characters:
            yield rows, words
            rows, words, held = [], [], 0
    if rows:
        yield rows, words


def _few(items: DataFrame, n: int, most: int) -> bool:
    """Whether the items surely have at most `most` n-grams; a text has fewer than characters / 2."""
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()["c"]
    return size / 2 <= most


def leaks(documents: DataFrame, items: DataFrame, n: int = N, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, item_id): documents that hold at least n consecutive words of a test item."""
    documents, items = documents.select("doc_id", "text"), items.select("item_id", "text").distinct()
    if not _few(items, n, max_broadcast):
        return _verified(_suspects(documents, items, n), items, n).select("doc_id", "item_id").distinct()
    scanner = documents.sparkSession.sparkContext.broadcast(Scanner([tuple(r) for r in items.collect()], n))

    def scan(batches):
        for batch in batches:
            ids = batch["doc_id"].tolist()
            for rows, words in _batches_of_words(batch):
                found = {(ids[rows[k]], item) for k, _, item in scanner.value.hits(words)}
                yield pd.DataFrame(list(found), columns=["doc_id", "item_id"])

    return documents.mapInPandas(scan, "doc_id bigint, item_id bigint").distinct()


def bloom_places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(block, bits within it) of each hash."""
    return (hashes % np.uint64(blocks)).astype(np.int64), [(mixed(hashes + np.uint64(k + 1)) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64) for k in range(BLOOM_HASHES)]


def _item_grams(items: DataFrame, n: int) -> DataFrame:
    """(item_id, hash, gram) of every n-gram of the items, once an item."""

    def cut(batches):
        hasher = Hasher(n)
        for batch in batches:
            ids = batch["item_id"].tolist()
            for rows, words in _batches_of_words(batch):
                hashes, offsets = hasher(words)
                names = [g for w in words for g in grams(w, n)]
                owner = np.repeat(rows, np.diff(offsets))
                yield pd.DataFrame({"item_id": pd.array([ids[k] for k in owner], dtype="Int64"), "hash": hashes.view(np.int64), "gram": names}).drop_duplicates()

    return items.mapInPandas(cut, "item_id bigint, hash bigint, gram string")


def _bloom(tests: DataFrame) -> np.ndarray:
    """(BLOOM_BLOCKS, bytes): each block is filled by one task; the blocks together have a fixed size."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << BLOOM_BITS, dtype=bool)
        for part in pdf["bits"]:
            bits |= np.unpackbits(np.frombuffer(part, dtype=np.uint8)).astype(bool)
        return pd.DataFrame({"block": [pdf["block"].iat[0]], "bits": [np.packbits(bits).tobytes()]})

    def partial(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            block, places = bloom_places(batch["hash"].to_numpy().view(np.uint64), BLOOM_BLOCKS)
            for b in np.unique(block).tolist():
                bits = held.setdefault(b, np.zeros(1 << (BLOOM_BITS - 3), dtype=np.uint8))
                here = np.zeros(1 << BLOOM_BITS, dtype=bool)
                for p in places:
                    here[p[block == b]] = True
                bits |= np.packbits(here)
        for b, bits in held.items():
            yield pd.DataFrame({"block": [b], "bits": [bits.tobytes()]})

    spread = tests.select("hash").distinct().repartitionByRange(F.pmod("hash", F.lit(BLOOM_BLOCKS)))
    rows = spread.mapInPandas(partial, "block int, bits binary").groupBy("block").applyInPandas(fill, "block int, bits binary").collect()
    out = np.zeros((BLOOM_BLOCKS, 1 << (BLOOM_BITS - 3)), dtype=np.uint8)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _suspects(documents: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(row, doc_id, text, starts, hashes, grams): the documents with n-grams that the Bloom filter lets pass, stored."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(_bloom(_item_grams(items, n)))

    def scan(batches):
        hasher, bloom = Hasher(n), shared.value
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for rows, words in _batches_of_words(batch):
                hashes, offsets = hasher(words)
                block, places = bloom_places(hashes, BLOOM_BLOCKS)
                maybe = np.ones(len(hashes), dtype=bool)
                for p in places:
                    maybe &= (bloom[block, p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
                found: dict[int, list[int]] = {}
                for at in np.flatnonzero(maybe).tolist():
                    found.setdefault(int(np.searchsorted(offsets, at, "right")) - 1, []).append(at)
                out = []
                for k, places_k in found.items():
                    starts = [at - int(offsets[k]) for at in places_k]
                    out.append((ids[rows[k]], texts[rows[k]], starts, hashes.view(np.int64)[places_k].tolist(), [" ".join(words[k][s : s + n]) for s in starts]))
                yield pd.DataFrame(out, columns=["doc_id", "text", "starts", "hashes", "grams"])

    found = documents.mapInPandas(scan, "doc_id bigint, text string, starts array<int>, hashes array<bigint>, grams array<string>")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "leak-suspects")


def _verified(suspects: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(row, doc_id, start, item_id): suspicious n-grams that are an item's."""
    each = suspects.select("row", "doc_id", F.explode(F.arrays_zip("starts", "hashes", "grams")).alias("z"))
    each = each.select("row", "doc_id", F.col("z.starts").alias("start"), F.struct(F.col("z.hashes").alias("hash"), F.col("z.grams").alias("gram")).alias("key"))
    tests = _item_grams(items, n).select("item_id", F.struct("hash", "gram").alias("key"))
    return meet(each, materialize(tests, "leak-grams"), "key").drop("key")


def spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of normalised(text) and the place of each in the text; marks that stand alone are no words."""
    low = text.lower()
    at = range(len(text) + 1)
    if len(low) != len(text):  # a capital that becomes two characters
        at = [k for k, c in enumerate(text) for _ in c.lower()]
    words, places = [], []
    for m in _TOKEN.finditer(low):
        if word := normalised(m.group()):
            words.append(word)
            places.append((at[m.start()], at[m.end() - 1] + 1))
    return words, places


def without(text: str, starts: set[int], n: int, drop_share: float) -> tuple[str | None, int, bool]:
    """(text without the n words from each start on, removed words, dropped)."""
    words, places = spans(text)
    gone = {k for s in starts for k in range(s, s + n)}
    if len(gone) > drop_share * len(words):
        return None, len(gone), True
    kept, at = [], 0
    for k in sorted(gone):
        if k - 1 not in gone:
            kept.append(text[at : places[k][0]])
        at = places[k][1]
    return "".join([*kept, text[at:]]), len(gone), False


_CLEANED = "doc_id bigint, text string, removed_words bigint, dropped boolean"


def cleaned(documents: DataFrame, items: DataFrame, n: int = N, drop_share: float = 0.5, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, text, removed_words, dropped) of each document with a hit: its text without the leaked spans.

    Where more than drop_share of the words leaked the document is dropped:
    its text is null. Documents without a hit have no row; the doc_ids are
    those of leaks().
    """
    documents, items = documents.select("doc_id", "text"), items.select("item_id", "text").distinct()
    names = [c.split()[0] for c in _CLEANED.split(", ")]
    if not _few(items, n, max_broadcast):
        suspects = _suspects(documents, items, n)
        hits = _verified(suspects, items, n).groupBy("row").agg(F.collect_set("start").alias("hits"))  # at most a document's words

        def clean_joined(batches):
            for batch in batches:
                rows = [(d, *without(text, set(map(int, starts)), n, drop_share)) for d, text, starts in zip(batch["doc_id"], batch["text"], batch["hits"])]
                yield pd.DataFrame(rows, columns=names)

        return suspects.select("row", "doc_id", "text").join(hits, "row").select("doc_id", "text", "hits").mapInPandas(clean_joined, _CLEANED).distinct()
    scanner = documents.sparkSession.sparkContext.broadcast(Scanner([tuple(r) for r in items.collect()], n))

    def clean(batches):
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for rows, words in _batches_of_words(batch):
                starts: dict[int, set[int]] = {}
                for k, start, _ in scanner.value.hits(words):
                    starts.setdefault(rows[k], set()).add(start)
                yield pd.DataFrame([(ids[k], *without(texts[k], s, n, drop_share)) for k, s in starts.items()], columns=names)

    return documents.mapInPandas(clean, _CLEANED).distinct()
