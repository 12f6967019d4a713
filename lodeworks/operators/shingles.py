"""Character shingles, minhash signatures, banding and exact Jaccard self-joins.

Texts that are equal form one class; pairs are of class representatives (the
smallest key), and class_members() names the rest, so copies never multiply.
"""

from __future__ import annotations

from hashlib import sha1

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.hashing import char_shingles, in_chunks
from lodeworks.operators.pairs import pairs_within
from lodeworks.operators.skew import with_sizes
from lodeworks.session import materialize, partitions_for

SHINGLE, HASHES, LEAST_EQUAL = 10, 10, 8
#: Groups of hashes of which one at least is equal throughout if no more than HASHES - LEAST_EQUAL hashes differ.
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7, 8, 9))
#: Shingles whose salted hashes a task keeps, of some 240 bytes each.
HELD_TAILS = 400_000
#: Characters of a block of texts that the exact join holds at a time, of a chunk that is hashed at once, and texts of a stored file.
BLOCK, CHUNK, FILE_ROWS = 24_000_000, 250_000, 4000
#: Buckets that shingles fall on when rare ones are looked for, cells of a text's bitmap (both as powers of two), and meetings that are looked at together.
BUCKET_BITS, BITMAP_BITS, MEETINGS = 22, 9, 500_000
BUCKETS, BITMAP = 1 << BUCKET_BITS, 1 << BITMAP_BITS
#: Shingle sets held while candidates are compared.
HELD_SETS = 1000
#: What fills up a row of hashes.
PAD = np.uint64(2**64 - 1)


def shingles(text: Column, k: int = SHINGLE) -> Column:
    """Distinct k-character substrings; texts below k characters and nulls have none."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))
    return F.when(F.length(text) >= k, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def class_members(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rep, copies): the smallest key among those of the same text, and their number. Null keys and texts are left out."""
    keyed = materialize(texts.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.sha2(text, 256).alias("h")).distinct(), "class-texts")
    groups = materialize(keyed.groupBy("h").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "class-groups")
    known = with_sizes(keyed, groups, ["h"], "copies", keyed.count(), "left")
    return known.select("key", F.coalesce("rep", "key").alias("rep"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))


def distinct_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): each text once, under its smallest key."""
    return texts.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.min(key).alias("key")).select("key", "text")


def _dealt(texts: DataFrame, k: int) -> DataFrame:
    """(key, text) of the texts that have shingles, spread over the session's tasks."""
    return texts.filter(F.length("text") >= k).select("key", "text").repartition(partitions_for(texts.sparkSession, 0, 1), "key")


def _tails(shingle: str) -> bytes:
    """The last five bytes of the HASHES salted hashes of a shingle's hash."""
    base = sha1(shingle.encode()).hexdigest().encode()
    return b"".join([sha1(base + salt).digest()[15:] for salt in _SALTS])


_SALTS = [f"{i:020d}".encode() for i in range(HASHES)]


def signatures(texts: DataFrame) -> DataFrame:
    """(key, signature) of (key, text): for i in 0..9 the least last-ten-hex of sha1(sha1(shingle) + i as twenty digits).

    Texts go through in chunks; a shingle that many texts of a chunk share is
    hashed once, and the first HELD_TAILS shingles of a task, among which are
    the frequent ones, are hashed once a task.
    """

    def sign(batches):
        known: dict[str, bytes] = {}

        def tails(shingle: str) -> bytes:
            found = known.get(shingle)
            if found is None:
                found = _tails(shingle)
                if len(known) < HELD_TAILS:
                    known[shingle] = found
            return found

        for batch in batches:
            keys, all_texts = batch["key"].tolist(), batch["text"].tolist()
            for start, end in in_chunks(all_texts, 500_000):
                numbers: dict[str, int] = {}
                places = []
                for text in all_texts[start:end]:
                    cut = {text[i : i + SHINGLE] for i in range(len(text) - SHINGLE + 1)}
                    places.append([numbers.setdefault(s, len(numbers)) for s in cut])
                raw = np.frombuffer(b"".join(map(tails, numbers)), dtype=np.uint8).reshape(-1, HASHES, 5).astype(np.uint64)
                values = (raw << np.arange(32, -1, -8, dtype=np.uint64)).sum(axis=2)
                least = np.minimum.reduceat(values[np.concatenate(places)], np.cumsum([0, *map(len, places)])[:-1], axis=0)
                yield pd.DataFrame({"key": keys[start:end], "signature": [[f"{v:010x}" for v in row] for row in least.tolist()]})

    return _dealt(texts, SHINGLE).mapInPandas(sign, "key string, signature array<string>")


def bands(signed: DataFrame) -> DataFrame:
    """(key, band, bucket): band b holds the sha1 of hash b alone."""
    return signed.select("key", F.posexplode("signature").alias("b", "h")).select("key", (F.col("b") + 1).alias("band"), F.sha1("h").alias("bucket"))


def lsh_pairs(signed: DataFrame, least: int = LEAST_EQUAL) -> DataFrame:
    """(a, b, score), a < b: pairs with at least `least` of ten equal hashes; score is their share.

    Instead of pairing every bucket, pairs meet on GROUPS of three or four
    hashes: with two hashes unequal at most, one group is equal throughout, so
    nothing is lost, and a meeting is far rarer.
    """
    if HASHES - least >= len(GROUPS):
        raise ValueError("so few equal hashes may leave no group equal")
    keys = F.array(*(F.concat_ws("|", F.lit(str(g)), *(F.col("signature")[i] for i in group)) for g, group in enumerate(GROUPS)))
    met = signed.select("key", "signature", F.explode(keys).alias("group"))
    equal = F.size(F.filter(F.zip_with("signature_x", "signature_y", lambda x, y: x == y), lambda e: e))
    pairs = pairs_within(met, "group", "key", ["signature"]).withColumn("equal", equal).filter(F.col("equal") >= least)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("equal") / HASHES).alias("score")).distinct()


def later_copies(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(key): the duplicates as the replaced system counts them, the larger keys of all pairs, every copy of a text counted.

    A key is one if its own text or a similar one has a smaller key; pairs are
    of representatives, members those of class_members() that have shingles.
    """
    near = pairs.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("least"))
    reps = members.filter("key = rep").select("rep", "copies")
    known = materialize(reps.join(near, "rep", "left").select("rep", "copies", F.coalesce("least", "rep").alias("least")), "later-copies")
    return with_sizes(members.select("key", "rep"), known, ["rep"], "copies", members.count()).filter("key > least").select("key")


def _hash_rows(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sizes): the distinct shingle hashes of each text, in order and padded with PAD; texts should be of like length."""
    hashes, offsets = char_shingles(texts, k)
    counts = np.diff(offsets)
    rows = np.full((len(texts), counts.max()), PAD)
    rows[np.arange(rows.shape[1]) < counts[:, None]] = np.minimum(hashes, PAD - np.uint64(1))
    rows.sort(axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = PAD
    return rows, (rows != PAD).sum(axis=1)


def _bitmaps(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, BITMAP / 64): for each cell the parity of the shingles that fall on it, so two texts differ in no more cells than shingles."""
    cells = (rows >> np.uint64(64 - BITMAP_BITS)).astype(np.int64) + np.arange(len(rows))[:, None] * BITMAP
    held = np.bincount(cells.ravel(), minlength=len(rows) * BITMAP).reshape(len(rows), BITMAP)
    held[:, -1] -= rows.shape[1] - sizes  # what fills up the row
    return np.packbits((held & 1).astype(np.uint8), axis=1).view(np.uint64)


def _buckets(rows: np.ndarray) -> np.ndarray:
    """The bucket of each shingle; BUCKETS for what fills up a row."""
    buckets = (rows & np.uint64(BUCKETS - 1)).astype(np.uint32)
    buckets[rows == PAD] = BUCKETS
    return buckets


class _Block:
    """Texts by length, each known by its place; the held side of a meeting has an index of their rarest shingles.

    There, shingles are told apart by the buckets they fall on, and ordered by
    how many of the held texts' shingles fall there. Prefix filtering allows
    both: texts that share s shingles share s bucket entries at least.
    """

    def __init__(self, keys: list[str], texts: list[str], k: int, threshold: float):
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        self.keys, self.texts, self.k, self.threshold = [keys[i] for i in order], [texts[i] for i in order], k, threshold

    def chunks(self):
        """(first place, rows, sizes) of a few texts at a time."""
        for start, end in in_chunks(self.texts, CHUNK):
            yield start, *_hash_rows(self.texts[start:end], self.k)

    def prefixes(self, buckets: np.ndarray, sizes: np.ndarray):
        """(row, bucket, cap) of each text's rarest entries, of which a similar text shares one, and the largest size of a similar text that shares no rarer one."""
        entries = self.ranked[buckets]
        entries.sort(axis=1)
        length = sizes - np.ceil(sizes * self.threshold - 1e-9).astype(np.int64) + 1
        row, place = np.nonzero(np.arange(length.max()) < length[:, None])
        cap = np.floor((sizes[row] - place + 1e-6) * ((1 + self.threshold) / self.threshold)) - sizes[row]
        return row.astype(np.int32), entries[row, place] & np.uint32(BUCKETS - 1), cap.astype(np.int32)

    def index(self) -> None:
        often, sizes, maps, buckets = np.zeros(BUCKETS + 1, dtype=np.int64), [], [], []
        for _, rows, n in self.chunks():
            sizes.append(n.astype(np.int32))
            maps.append(_bitmaps(rows, n))
            buckets.append(_buckets(rows))
        for i in range(0, len(buckets), 16):
            often += np.bincount(np.concatenate([b.ravel() for b in buckets[i : i + 16]]), minlength=BUCKETS + 1)
        self.ranked = (np.minimum(often, 2 ** (32 - BUCKET_BITS) - 2).astype(np.uint32) << np.uint32(BUCKET_BITS)) | np.arange(BUCKETS + 1, dtype=np.uint32)
        self.ranked[BUCKETS] = 2**32 - 1
        found, first = [], 0
        for i, n in enumerate(sizes):
            row, bucket, cap = self.prefixes(buckets[i], n)
            found.append((row + np.int32(first), bucket, cap))
            buckets[i], first = None, first + len(n)
        text, bucket, cap = (np.concatenate([f[i] for f in found]) for i in range(3))
        del found
        order = np.argsort(bucket)
        self.held, self.caps, self.sizes, self.maps = text[order], cap[order], np.concatenate(sizes), np.concatenate(maps)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=BUCKETS))])

    def similar(self, other: _Block):
        """(key, key, jaccard) of the similar pairs of a held text and one of the other block; of this block itself, each pair once."""
        for first, rows, sizes in other.chunks():
            row, bucket, cap = self.prefixes(_buckets(rows), sizes)
            count = self.starts[bucket + 1] - self.starts[bucket]
            maps = _bitmaps(rows, sizes)
            met = np.concatenate([np.zeros(0, dtype=np.int64), *self._met(row[count > 0], bucket[count > 0], cap[count > 0], count[count > 0], sizes, maps, first if other is self else None)])
            sets: dict[str, set[str]] = {}
            for pair in np.unique(met).tolist():
                if len(sets) > HELD_SETS:
                    sets.clear()
                y, x = divmod(pair, len(self.texts))
                a, b = (sets.get(t) or sets.setdefault(t, {t[i : i + self.k] for i in range(len(t) - self.k + 1)}) for t in (self.texts[x], other.texts[first + y]))
                shared = len(a & b)
                if (jaccard := shared / (len(a) + len(b) - shared)) >= self.threshold:
                    yield *sorted((self.keys[x], other.keys[first + y])), jaccard

    def _met(self, row, bucket, cap, count, sizes, maps, own):
        """Pairs, as row * texts + place, that meet in a bucket and that neither sizes, places nor bitmaps rule out; own: the place of row 0 if the block meets itself."""
        ends = np.cumsum(count)
        cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, MEETINGS), side="left").tolist()
        for a, b in zip(cuts, [*cuts[1:], len(count)]):
            if a == b:
                continue
            n = count[a:b]
            entry = np.repeat(self.starts[bucket[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            x = self.held[entry]
            keep = (np.repeat(sizes[row[a:b]].astype(np.int32), n) <= self.caps[entry]) & (self.sizes[x] <= np.repeat(cap[a:b], n))
            if own is not None:
                keep &= x < np.repeat((row[a:b] + own).astype(np.int32), n)
            x, y = x[keep], np.repeat(row[a:b], n)[keep]
            total = self.sizes[x] + sizes[y]
            differ = total - 2 * np.ceil(total * (self.threshold / (1 + self.threshold)) - 1e-6).astype(np.int64)
            keep = np.bitwise_count(self.maps[x] ^ maps[y]).sum(axis=1, dtype=np.int64) <= differ
            yield np.unique(y[keep].astype(np.int64) * len(self.texts) + x[keep])


def _blocks(texts: DataFrame, least: int) -> list[list[str]]:
    """The files of a stored table of texts, put together to blocks of about BLOCK characters, or fewer where that gives at least so many blocks."""
    files = texts.groupBy(F.input_file_name().alias("path")).agg(F.sum(F.length("text").cast("bigint")).alias("n")).orderBy("path").collect()
    most = min(BLOCK, sum(f["n"] for f in files) // least)
    blocks: list[list[str]] = []
    held = most
    for f in files:
        if not blocks or held + f["n"] > most:
            blocks.append([])
            held = 0
        blocks[-1].append(f["path"])
        held += f["n"]
    return blocks


def jaccard_pairs(texts: DataFrame, threshold: float = 0.8, k: int = SHINGLE) -> DataFrame:
    """(a, b, jaccard), a < b: all pairs of (key, text) whose shingle sets reach the threshold, exactly.

    Only the texts are stored. They are cut into blocks, and every two blocks
    meet in a task that reads both from the shared folder, so neither shingles
    nor candidates are written or shuffled. Within a task, prefix filtering:
    with the shingles of each text in order of rarity, two similar texts share
    one of their rarest n - ceil(threshold * n) + 1. What meets so goes on if
    sizes, the places of the shared shingle and a bitmap of each text leave
    room for enough shared shingles, and is compared on the shingles
    themselves. Each block is read once for every other one.
    """
    spark = texts.sparkSession
    known = materialize(texts.filter((F.length("text") >= k) & F.col("key").isNotNull()).select("key", "text"), "jaccard-texts", maxRecordsPerFile=FILE_ROWS, compression="zstd")
    cores = spark.sparkContext.defaultParallelism
    blocks = _blocks(known, cores)
    starts = np.cumsum([0, *range(len(blocks), 0, -1)])  # meetings of block 0, of block 1 with those from 1 on, ...
    meetings = int(starts[-1])

    def read(i: int) -> _Block:
        tables = [pq.read_table(path, filesystem=fs, columns=["key", "text"]) for fs, path in map(FileSystem.from_uri, blocks[i])]
        return _Block([x for t in tables for x in t["key"].to_pylist()], [x for t in tables for x in t["text"].to_pylist()], k, threshold)

    def meet_blocks(batches):
        held, at = None, -1
        for batch in batches:
            for m in batch.column(0).to_pylist():
                i = int(np.searchsorted(starts, m, side="right")) - 1
                if at != i:
                    held, at = read(i), i
                    held.index()
                j = i + m - int(starts[i])
                found = list(held.similar(held if i == j else read(j)))
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["a", "b", "jaccard"])

    tasks = min(meetings, max(4 * cores, meetings // 4))
    pairs = spark.range(0, meetings, 1, max(1, tasks)).mapInArrow(meet_blocks, "a string, b string, jaccard double")
    return pairs.select("a", "b", F.round("jaccard", 6).alias("jaccard"))
