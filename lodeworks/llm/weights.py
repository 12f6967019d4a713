"""How characteristic a term is of a record: graph-of-words weights.

Within each record every term is a node; terms at most `window` - 1 places
apart in the same field are joined by an edge. A term's degree, its number of
distinct neighbours, replaces its frequency, and the weight is
(1 + log10 degree) * (1 + log10(N / df)), rounded to 6 decimals; a term with
no neighbour has degree 1. With local="tf" the frequency takes the degree's
place.

Defined results: rows equal in link and both texts count once; null texts are
empty; a record with no term is not counted in N and has no rows; a null link
is kept and marks a record of its own; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.hashing import distinct
from lodeworks.operators.skew import with_sizes
from lodeworks.session import materialize

WINDOW = 4
#: Terms with more than this part of all postings stay in place; they are fewer than HOT_TERMS.
HOT_TERMS = 10_000
#: Bytes of text whose graphs are built at once.
CHUNK = 4_000_000


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, record of each): the non-empty pieces between spaces of all texts, one after another."""
    pieces = pc.split_pattern(pc.fill_null(column, "").cast(pa.string()), " ")
    words, owner = pc.list_flatten(pieces), pc.list_parent_indices(pieces)
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), owner.filter(some).to_numpy().astype(np.int64)


def term_graphs(fields: list[pa.Array], window: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(record, term, frequency, distinct neighbours) of every term of every record, the graphs of all records at once.

    Each array of fields holds one text a record. Edges join terms at most
    window - 1 places apart in the same field.
    """
    split = [_words(f) for f in fields]
    words = pa.concat_arrays([w for w, _ in split])
    owner = np.concatenate([o for _, o in split])
    spot = np.concatenate([o * len(fields) + k for k, (_, o) in enumerate(split)])  # record and field
    coded = words.dictionary_encode()
    codes, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    cells = owner * max(1, len(terms)) + codes
    nodes = distinct(cells)
    node = np.searchsorted(nodes, cells)
    edges = []
    for step in range(1, window):
        a, b = node[:-step], node[step:]
        near = (spot[:-step] == spot[step:]) & (a != b)
        a, b = a[near], b[near]
        edges.append(np.minimum(a, b) * len(nodes) + np.maximum(a, b))
    both = distinct(np.concatenate(edges)) if edges else np.zeros(0, dtype=np.int64)
    degree = np.bincount(both // max(1, len(nodes)), minlength=len(nodes)) + np.bincount(both % max(1, len(nodes)), minlength=len(nodes))
    return nodes // max(1, len(terms)), terms.take(pa.array(nodes % max(1, len(terms)))), np.bincount(node, minlength=len(nodes)), degree


def record_terms(ads: DataFrame, window: int = WINDOW, local: str = "degree") -> DataFrame:
    """(link, terms, counts): the distinct records with their terms and the degree, or with local="tf" the frequency, of each."""
    names = ["link", "terms", "counts"]

    def graphs(batches):
        for batch in batches:
            sizes = pc.add(*(pc.coalesce(pc.binary_length(batch.column(c)), pa.scalar(0, pa.int32())) for c in ("titles", "descriptions"))).to_numpy(zero_copy_only=False)
            ends = [*np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // CHUNK)).tolist(), len(sizes) - 1] if len(sizes) else []
            start = 0
            for end in ends:
                part = batch.slice(start, end + 1 - start)
                start = end + 1
                record, terms, tf, degree = term_graphs([part.column(c) for c in ("titles", "descriptions")], window)
                offsets = pa.array(np.searchsorted(record, np.arange(len(part) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (terms.cast(pa.string()), pa.array(degree if local == "degree" else tf, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("links"), *lists], names=names)

    once = ads.select("links", "titles", "descriptions").distinct()
    return once.mapInArrow(graphs, "link string, terms array<string>, counts array<int>")


def term_weights(ads: DataFrame, window: int = WINDOW, local: str = "degree", min_df: int = 1) -> tuple[DataFrame, DataFrame]:
    """(postings, records): postings (record, term, tf or degree, df, weight) and records (record, link).

    Terms of fewer than min_df records have no postings. Postings meet the
    document frequencies in a join that leaves those of frequent terms in
    place.
    """
    records = materialize(record_terms(ads, window, local).filter("size(terms) > 0").withColumn("record", F.monotonically_increasing_id()), "term-records")
    n = records.count()
    df = materialize(records.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df), "term-df")
    postings = records.select("record", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("record", F.col("t.terms").alias("term"), F.col("t.counts").alias(local))
    total = df.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    count = F.greatest(F.col("degree"), F.lit(1)) if local == "degree" else F.col("tf")
    weight = F.round((1 + F.log10(count.cast("double"))) * (1 + F.log10(F.lit(float(n)) / F.col("df"))), 6)
    return with_sizes(postings, df, ["term"], "df", total, hot_keys=HOT_TERMS).withColumn("weight", weight), records.select("record", "link")


def top_terms(postings: DataFrame, records: DataFrame) -> DataFrame:
    """(link, term): each link's term of greatest weight, ties to the smaller term."""
    best = postings.groupBy("record").agg(F.min(F.struct((-F.col("weight")).alias("less"), F.col("term"))).alias("best"))
    return best.join(records, "record").groupBy("link").agg(F.min("best").alias("best")).select("link", "best.term")
