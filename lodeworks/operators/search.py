"""TF-IDF index, stored by term, and ranked retrieval.

Index weight (1 + log10 tf) * (1 + log10(N / df)); query weight
(1 / query tokens) * (1 + log10((N + offset) / df)); scores are divided by the
characters of title and description. Terms that the index lacks add nothing
but count as query tokens.
"""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.text import WORD, tokens
from lodeworks.functions.words import ITALIAN, stem_italian, without
from lodeworks.operators.skew import with_sizes
from lodeworks.session import materialize

#: Folders of a stored index; a search reads those of its terms.
BUCKETS = 64


def term_counts(texts: DataFrame, key: str, columns: list[str], stop: list[str]) -> DataFrame:
    """(doc, term, tf) over the tokens of all columns, stop words dropped; null texts have none."""
    lists = [F.coalesce(without(tokens(F.col(c)), stop), F.array().cast("array<string>")) for c in columns]
    return texts.select(F.col(key).alias("doc"), F.explode(F.concat(*lists)).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def index(counts: DataFrame, n: int) -> DataFrame:
    """(term, doc, tf, df, weight): long postings; those of frequent terms stay where they are."""
    counts = materialize(counts, "term-counts")
    df = materialize(document_frequencies(counts), "term-df")
    weight = (1 + F.log10(F.col("tf").cast("double"))) * (1 + F.log10(F.lit(float(n)) / F.col("df")))
    return with_sizes(counts, df, ["term"], "df", counts.count()).select("term", "doc", "tf", "df", F.round(weight, 6).alias("weight"))


def store_index(postings: DataFrame, lengths: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the postings with their documents' (doc, length), in folders by the term's hash and sorted by term, so a term's are read alone.

    A bucket's rows are spread over several files, for a frequent term may
    hold most of it. Documents without a row in lengths keep a null length.
    """
    spread = max(1, int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    placed = postings.join(lengths, "doc", "left").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    placed.repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(spread))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def stored_postings(spark: SparkSession, path: str, terms: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The postings of store_index(); with terms, only the folders and row groups of those are read."""
    rows = spark.read.parquet(path)
    if terms is None:
        return rows.drop("bucket")
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")).alias("t")).select(F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int"))
    numbers = sorted({r[0] for r in wanted.collect()})  # one a query term
    return rows.filter(F.col("bucket").isin(numbers) & F.col("term").isin(terms)).drop("bucket")


def search(postings: DataFrame, n: int, query: list[str], k: int = 22, n_offset: int = 1) -> DataFrame:
    """(doc, score) of the k best documents for the query's tokens, out of their terms' postings with length.

    A token that occurs twice in the query counts twice in its length and
    scores once. Documents of no or null length are left out.
    """
    mine = postings.filter(F.col("term").isin(list(dict.fromkeys(query))) & (F.col("length") > 0))
    gain = F.col("weight") * (F.lit(1 / max(1, len(query))) * (1 + F.log10(F.lit(float(n + n_offset)) / F.col("df"))))
    scored = mine.groupBy("doc").agg(F.sum(gain).alias("sum"), F.max("length").alias("length"))
    return scored.select("doc", F.round(F.col("sum") / F.col("length"), 8).alias("score")).orderBy(F.desc("score"), "doc").limit(k)


def query_tokens(text: str) -> list[str]:
    """Stems of the query's distinct words that are no stop words."""
    words = regex.findall(WORD, text.lower())
    return [stem_italian(w) for w in dict.fromkeys(words) if w not in ITALIAN]
