"""Near-duplicate texts by HyperMinHash sketches.

1. Texts equal after normalisation are one class; only its representative,
   the smallest id, goes on.
2. A sketch holds, for BUCKETS buckets in each of ROUNDS keyed hashings of the
   text's shingles, the smallest hash as a leading-zero count (6 bits) and a
   mantissa (10 bits).
3. BANDS bands of ROWS registers each are candidate keys. Buckets of few texts
   are paired by an equi-join; those of many are cut into blocks, and block
   meets block in tasks of bounded size that compare the sketches at once.
4. The share of equal registers, corrected for chance collisions, estimates
   the similarity; pairs far below the threshold go.
5. The rest is verified on the texts' whole shingle sets, as 64-bit hashes.

A pair of similarity 0.7 shares a band, and a longer band, with probability
above 0.9998; no cap limits a bucket, a text's copies, its partners or the
candidates, and the result has one form at every size.

Defined results: null texts and texts below min_chars after normalisation
have no pairs (classes() gives them a class of their own); a null id is left
out; an id that occurs twice keeps its smallest normalised text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.hashing import MIX, char_shingles, distinct, in_chunks, mixed
from lodeworks.functions.text import normalised
from lodeworks.operators.pairs import meet, pairs_within
from lodeworks.operators.skew import with_sizes
from lodeworks.session import materialize, release

BUCKETS, ROUNDS = 16, 15
ROWS, BANDS = 5, 48
ZERO_BITS, MANTISSA_BITS = 6, 10
REGISTERS = BUCKETS * ROUNDS
EMPTY = 0xFFFF
#: Texts of a band bucket that are paired by the join; greater buckets are compared in blocks of BLOCK.
DIRECT, BLOCK = 64, 1000
#: Standard errors of the estimate that a candidate may lie below the threshold.
SLACK = 5.0

#: Buckets of more texts are banded anew by longer bands before any block is compared.
REBAND = 4000
LONG_ROWS, LONG_BANDS = 8, 150

_KEYS = np.random.default_rng(20240229).integers(1, 2**63, ROUNDS, dtype=np.uint64) | np.uint64(1)
_LONG = np.stack([np.random.default_rng(b).choice(REGISTERS, LONG_ROWS, replace=False) for b in range(LONG_BANDS)], axis=1)


def word_shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same over k consecutive words; texts have at least k."""
    import xxhash

    each = []
    for t in texts:
        words = t.split(" ")
        each.append([xxhash.xxh64_intdigest(" ".join(words[i : i + k])) for i in range(len(words) - k + 1)])
    offsets = np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)
    return np.array([h for e in each for h in e], dtype=np.uint64), offsets


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, REGISTERS) uint16 registers: leading zeros and mantissa of each bucket's smallest hash, EMPTY without one."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) * BUCKETS
    out = np.empty((n, ROUNDS, BUCKETS), dtype=np.uint16)
    for r in range(ROUNDS):
        x = mixed(hashes * _KEYS[r])
        cell = owner + (x & np.uint64(BUCKETS - 1)).astype(np.int64)
        least = np.full(n * BUCKETS, np.iinfo(np.uint64).max, dtype=np.uint64)
        np.minimum.at(least, cell, x >> np.uint64(4))  # 60 bits
        # frexp is exact for the leading bits once the low ones are cut off
        top = (least >> np.uint64(8)).astype(np.float64)
        mantissa, exponent = np.frexp(top)
        zeros = np.clip(52 - exponent, 0, 2**ZERO_BITS - 2).astype(np.uint16)
        tail = ((mantissa * 2 - 1) * 2**MANTISSA_BITS).astype(np.int64).clip(0, 2**MANTISSA_BITS - 1).astype(np.uint16)
        register = (zeros << np.uint16(MANTISSA_BITS)) | tail
        register[least == np.iinfo(np.uint64).max] = EMPTY
        out[:, r, :] = register.reshape(n, BUCKETS)
    return out.reshape(n, REGISTERS)


def bands(registers: np.ndarray, long: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """((texts, bands) keys, mask of bands with a filled register): BANDS bands of ROWS registers, or LONG_BANDS of LONG_ROWS."""
    cut = registers[:, _LONG] if long else registers.reshape(len(registers), ROWS, BANDS)
    cut, count = cut.astype(np.uint64), cut.shape[2]
    keys = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) * MIX, (len(registers), count)).copy()
    for row in range(cut.shape[1]):
        keys = mixed((keys ^ cut[:, row, :]) * MIX + np.uint64(row + 1))
    return keys.view(np.int64), (cut != EMPTY).any(axis=1)


def zero_shares(registers: np.ndarray) -> np.ndarray:
    """(texts, 2**ZERO_BITS): how the leading-zero counts of each text's registers are spread; EMPTY counts as none."""
    n, width = len(registers), 2**ZERO_BITS
    cells = (registers >> MANTISSA_BITS).astype(np.int64) + np.arange(n, dtype=np.int64)[:, None] * width
    shares = np.bincount(cells.ravel(), minlength=n * width).reshape(n, width) / REGISTERS
    shares[:, -1] = 0
    return shares


def estimated_similarity(a: np.ndarray, b: np.ndarray, chance: np.ndarray | None = None) -> np.ndarray:
    """Jaccard estimates of rows of registers: equal ones over filled ones, less the expected chance collisions.

    Two unequal minima collide if they have the same leading zeros and the
    same mantissa; the first has the probability of the two texts' own
    leading-zero counts agreeing, the second 2**-MANTISSA_BITS.
    """
    filled = (a != EMPTY) | (b != EMPTY)
    equal = ((a == b) & filled).sum(axis=1) / np.maximum(filled.sum(axis=1), 1)
    if chance is None:
        chance = (zero_shares(a) * zero_shares(b)).sum(axis=1) * 2.0**-MANTISSA_BITS
    return (equal - chance) / (1 - chance)


def _cutoff(threshold: float) -> float:
    return max(0.0, threshold - SLACK * (threshold * (1 - threshold) / REGISTERS) ** 0.5)


def normal_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, norm): one row for each id."""

    def norm(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "norm": [normalised(t) for t in batch["text"]]})

    return df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL").mapInPandas(norm, "id string, norm string")


def copy_classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, texts of representatives): members (id, rep, copies), texts (rep, norm). Texts meet by a 128-bit hash."""
    once = texts.groupBy("id").agg(F.min("norm").alias("norm")).select("id", "norm", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"))
    once = materialize(once, "neardup-texts")
    groups = materialize(once.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "neardup-copies")
    known = with_sizes(once, groups, ["h1", "h2"], "copies", once.count(), "left").withColumn("rep", F.coalesce("rep", "id"))
    members = materialize(known.select("id", "rep", F.coalesce("copies", F.lit(1)).alias("copies")), "neardup-members")
    return members, known.filter("id = rep").select("rep", "norm")


def similar_representatives(texts: DataFrame, shingle: int, threshold: float, words: bool = False) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of (rep, norm) rows whose shingle sets have at least the given Jaccard similarity."""
    cutter = word_shingles if words else char_shingles
    cutoff = _cutoff(threshold)

    def sketch(batches):
        for batch in batches:
            for at, end in in_chunks(batch["norm"].tolist(), 200_000):
                part = batch.iloc[at:end]
                registers = sketches(*cutter(part["norm"].tolist(), shingle))
                keys, used = bands(registers)
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "norm": part["norm"].to_numpy(), "sketch": [r.tobytes() for r in registers], "bands": [k[u] for k, u in zip(keys, used)]})

    numbered = materialize(
        texts.mapInPandas(sketch, "rep string, norm string, sketch binary, bands array<bigint>").withColumn("no", F.monotonically_increasing_id()), "neardup-sketches"
    )
    pairs = _candidates(numbered.select("no", F.explode("bands").alias("band")), numbered, cutoff).distinct()
    left = numbered.select(F.col("no").alias("x"), F.col("sketch").alias("sx"))
    right = numbered.select(F.col("no").alias("y"), F.col("sketch").alias("sy"))

    def estimate(batches):
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("sx", "sy"))
                yield batch.loc[estimated_similarity(a, b) >= cutoff, ["x", "y"]]

    likely = materialize(pairs.join(left, "x").join(right, "y").mapInPandas(estimate, "x bigint, y bigint"), "neardup-candidates")

    def verify(batches):
        for batch in batches:
            for at, end in in_chunks((batch["s"] + batch["t"]).tolist(), 4_000_000):
                part = batch.iloc[at:end]
                texts = dict(zip(part["a"], part["s"])) | dict(zip(part["b"], part["t"]))  # a text of many partners is cut once
                hashes, offsets = cutter(list(texts.values()), shingle)
                sets = {key: distinct(hashes[i:j]) for key, i, j in zip(texts, offsets, offsets[1:])}
                found = []
                for a, b in zip(part["a"], part["b"]):
                    one, two = sets[a], sets[b]
                    same = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
                    if same and same >= threshold * (len(one) + len(two) - same) - 1e-9:
                        found.append((*sorted((a, b)), same / (len(one) + len(two) - same)))
                yield pd.DataFrame(found, columns=["a", "b", "similarity"])

    left = numbered.select(F.col("no").alias("x"), F.col("rep").alias("a"), F.col("norm").alias("s"))
    right = numbered.select(F.col("no").alias("y"), F.col("rep").alias("b"), F.col("norm").alias("t"))
    found = materialize(likely.join(left, "x").join(right, "y").mapInPandas(verify, "a string, b string, similarity double"), "neardup-pairs")
    release(numbered, likely)
    return found


def _candidates(keyed: DataFrame, numbered: DataFrame, cutoff: float, long: bool = False) -> DataFrame:
    """(x, y), x < y: texts that share a band of keyed (no, band), pairs of great buckets by their sketches; may repeat.

    Buckets of two need no join. Those of up to DIRECT texts meet in a
    self-join. Texts of buckets of more than REBAND are banded anew, all at
    once, by longer bands, which part what a stock phrase brought together and
    find a pair with the same probability. Other great buckets are compared in
    blocks.
    """
    sizes = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("no").alias("x"), F.max("no").alias("y")).filter("n > 1")
    sizes = materialize(sizes, "neardup-bands")
    pairs = sizes.filter("n = 2").select("x", "y")
    more = sizes.filter("n > 2").select("band", "n")
    known = more.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if not known["most"]:
        return pairs
    shared = materialize(with_sizes(keyed, more, ["band"], "n", known["rows"]), "neardup-buckets")
    small = shared.filter(F.col("n") <= DIRECT).select("band", "no")
    pairs = pairs.unionByName(small.select("band", F.col("no").alias("x")).join(small.select("band", F.col("no").alias("y")), "band").filter("x < y").select("x", "y"))
    if known["most"] > DIRECT:
        great = F.col("n") > DIRECT if long else (F.col("n") > DIRECT) & (F.col("n") <= REBAND)
        pairs = pairs.unionByName(_block_pairs(shared.filter(great), numbered, cutoff))
    if known["most"] > REBAND and not long:

        def rebanded(batches):
            for batch in batches:
                for at in range(0, len(batch), 500):
                    part = batch.iloc[at : at + 500]
                    keys, used = bands(np.frombuffer(b"".join(part["sketch"]), dtype=np.uint16).reshape(-1, REGISTERS), long=True)
                    yield pd.DataFrame({"no": part["no"].to_numpy(), "bands": [k[u] for k, u in zip(keys, used)]})

        hot = numbered.select("no", "sketch").join(shared.filter(F.col("n") > REBAND).select("no").distinct(), "no", "left_semi")
        longer = materialize(hot.mapInPandas(rebanded, "no bigint, bands array<bigint>"), "neardup-long-bands")
        pairs = pairs.unionByName(_candidates(longer.select("no", F.explode("bands").alias("band")), numbered, cutoff, long=True))
    return pairs


def _block_pairs(large: DataFrame, numbered: DataFrame, cutoff: float) -> DataFrame:
    """(x, y) of great buckets: blocks of about BLOCK texts meet two by two, each meeting one task's sketch comparison."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = large.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
    other = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = other.select("band", "no", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        i, j = pdf["i"].iat[0], pdf["j"].iat[0]
        registers = np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint16).reshape(-1, REGISTERS)
        numbers, own, zeros = pdf["no"].to_numpy(), pdf["own"].to_numpy(), zero_shares(registers)
        found = []
        for k in range(len(pdf)):
            against = np.flatnonzero(own == j) if i != j else np.arange(k + 1, len(pdf))
            if i != j and own[k] != i or not len(against):
                continue
            chance = zeros[against] @ zeros[k] * 2.0**-MANTISSA_BITS
            near = against[estimated_similarity(registers[k][None, :], registers[against], chance) >= cutoff]
            found += [(min(a, b), max(a, b)) for a, b in ((numbers[k], numbers[m]) for m in near)]
        return pd.DataFrame(found, columns=["x", "y"])

    return meet.join(numbered.select("no", "sketch"), "no").groupBy("band", "i", "j").applyInPandas(compare, "x bigint, y bigint")


def representative_pairs(df: DataFrame, key: str, text: str, shingle: int, threshold: float, min_chars: int, words: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, similarity) of representatives of different texts, members (id, rep, copies) of every id."""
    texts = normal_texts(df, key, text).filter(F.length("norm") >= min_chars)
    if words:
        texts = texts.filter(F.size(F.split("norm", " ")) >= shingle)
    members, reps = copy_classes(texts)
    return similar_representatives(reps, shingle, threshold, words), members


def similar_pairs(df: DataFrame, key: str, text: str, shingle: int, threshold: float, min_chars: int, words: bool = False) -> DataFrame:
    """(a, b), a < b: all pairs of ids whose normalised texts are that similar, every copy of a text listed.

    n copies of one text are n * (n - 1) / 2 pairs; where that is too much,
    representative_pairs() gives the same links without them.
    """
    near, members = representative_pairs(df, key, text, shingle, threshold, min_chars, words)
    pairs = near.select("a", "b")
    copies = members.filter("copies > 1")
    if copies.isEmpty():
        return pairs
    one, two = (members.select(F.col("id").alias(f"id_{c}"), F.col("rep").alias(c)) for c in "ab")
    if copies.agg(F.max("copies")).first()[0] <= DIRECT:
        across = pairs.join(one, "a").join(two, "b")
    else:
        across = meet(materialize(meet(pairs, one, "a"), "neardup-copied"), two, "b")
    within = pairs_within(copies, "rep", "id").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return across.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).unionByName(within)


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each connected set of (a, b) edges, by alternating star contractions.

    Every step aggregates the edges by node and is written to the shared
    folder, so no set is gathered in the driver or in one task; the number of
    steps grows with the logarithm of the longest chain.
    """
    edges = materialize(edges.select("a", "b"), "components")
    while True:
        large, one = _star(edges, large=True)
        large = materialize(large, "components-large")
        small, two = _star(large, large=False)
        small = materialize(small.distinct(), "components")
        release(large, one, two)
        changed = not small.join(edges, ["a", "b"], "left_anti").isEmpty() or not edges.join(small, ["a", "b"], "left_anti").isEmpty()
        release(edges)
        edges = small
        if not changed:
            break
    flat = edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
    return flat.unionByName(flat.select(F.col("root").alias("id"), "root")).distinct()


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """One contraction, and the table it reads: neighbours of each node are linked to the smallest of them and the node itself; a node of many edges is no burden."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m")), "components-least")
    linked = with_sizes(both, least, ["u"], "n", 2 * edges.count())
    if large:
        return linked.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct(), least
    linked = linked.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a < b")
    return linked, least


def classes(df: DataFrame, key: str, text: str, shingle: int, threshold: float, min_chars: int, words: bool = False) -> DataFrame:
    """(id, class_id, links): for every id its class, named by its smallest id, and its number of similar other texts and copies."""
    near, members = representative_pairs(df, key, text, shingle, threshold, min_chars, words)
    sizes = members.filter("id = rep").select("rep", "copies")
    roots = components(near)
    sides = near.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    links = sides.join(sizes.select(F.col("rep").alias("other"), "copies"), "other").groupBy("rep").agg(F.sum("copies").alias("near"))
    info = materialize(sizes.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").join(links, "rep", "left"), "neardup-classes")
    known = with_sizes(members.select("id", "rep"), info, ["rep"], "copies", members.count())
    known = known.select("id", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"))
    every = df.select(F.col(key).cast("string").alias("id")).filter("id IS NOT NULL").distinct()
    return every.join(known, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
