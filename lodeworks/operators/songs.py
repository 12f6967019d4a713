"""Preparing song lyrics for classification: cleaning, balancing, splitting, vocabulary, encoding, metrics."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import tokens
from lodeworks.functions.words import ENGLISH, without
from lodeworks.operators.skew import with_sizes
from lodeworks.session import materialize, partitions_for

#: The classes, and the words cut out of lyrics.
CLASSES = ("Rock", "Hip-Hop", "Electronic", "Jazz", "Country")
CUT = ("chorus", "verse", "intro")
MIN_CHARS, PER_CLASS, LENGTH = 10, 1500, 100


def clean(lyrics: Column) -> Column:
    """Lower case, brackets off both ends, then parentheses, then the words of CUT even inside others; null is 'nan'."""
    text = F.btrim(F.btrim(F.lower(F.coalesce(lyrics, F.lit("nan"))), F.lit("[]")), F.lit("()"))
    for word in CUT:
        text = F.replace(text, F.lit(word), F.lit(""))
    return text


def cleaned(songs: DataFrame) -> DataFrame:
    """(idx, genre, text): songs once each, whose cleaned lyrics have more than MIN_CHARS characters."""
    return songs.select("idx", "genre", clean(F.col("lyrics")).alias("text")).distinct().filter(F.length("text") > MIN_CHARS)


def balanced(rows: DataFrame, classes: tuple[str, ...] = CLASSES, k: int = PER_CLASS) -> DataFrame:
    """The first k rows by idx of each class; the rank is cut per partition before the shuffle."""
    order = Window.partitionBy("genre").orderBy("idx", "text")
    return rows.filter(F.col("genre").isin(*classes)).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def split(key: Column) -> Column:
    """'train', 'dev' or 'test' (81, 9 and 10 of 100) by the key's md5."""
    bucket = F.conv(F.left(F.md5(key.cast("string")), F.lit(4)), 16, 10).cast("int") % 100
    return F.when(bucket < 81, "train").when(bucket < 90, "dev").otherwise("test")


def song_tokens(rows: DataFrame, distinct: bool = True) -> DataFrame:
    """(idx, genre, tokens): words without stop words, repeats dropped in order if distinct."""
    words = without(tokens(F.col("text")), ENGLISH)
    return rows.select("idx", "genre", (F.array_distinct(words) if distinct else words).alias("tokens"))


def word_class_presence(rows: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """(word, one 0/1 column a class): whether the word occurs in any song of the class."""
    words = rows.select("genre", F.explode("tokens").alias("word"))
    return words.groupBy("word").agg(*(F.max((F.col("genre") == c).cast("int")).alias(c.lower().replace("-", "_")) for c in classes))


def numbered(rows: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """rows with a column counting from 0 in the given order, without gathering them in one task.

    Ranges are sorted apart, their sizes summed up, and each row gets its
    range's start plus its place. The order should have no ties.
    """
    spark = rows.sparkSession
    n = partitions or partitions_for(spark, 0, 1)
    sorted_rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = materialize(sorted_rows.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = placed.withColumn("__part", F.shiftright("__id", 33))
    sizes = part.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row a range
    starts = sizes.withColumn("__start", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    return part.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__id").bitwiseAND(F.lit(2**33 - 1))).drop("__part", "__id", "__start")


def vocabulary(rows: DataFrame, reserve_zero: bool = False) -> DataFrame:
    """(word, df, word_id): words by falling document frequency, then by the word; from 0, or from 1 if zero is kept for padding."""
    counts = rows.select(F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    out = numbered(counts, [F.desc("df"), F.col("word")], "word_id")
    return out.withColumn("word_id", F.col("word_id") + 1) if reserve_zero else out


def encoded(rows: DataFrame, words: DataFrame, length: int = LENGTH) -> DataFrame:
    """(idx, ids): each song's first `length` words as ids, unknown words and padding 0. idx should be unique.

    Words are very uneven, so those of frequent ones are looked up in place.
    """
    known = materialize(words.select("word", "df", "word_id"), "vocabulary")
    total = known.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    head = rows.select("idx", F.posexplode_outer(F.slice("tokens", 1, length)).alias("place", "word"))
    met = with_sizes(head, known, ["word"], "df", total, "left")
    lists = met.groupBy("idx").agg(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", F.coalesce("word_id", F.lit(0)).alias("id"))))).alias("s"))
    ids = F.transform("s", lambda x: x["id"])
    return lists.select("idx", F.slice(F.concat(ids, F.array_repeat(F.lit(0).cast("bigint"), length)), 1, length).alias("ids"))


def label_ids(rows: DataFrame, column: str) -> DataFrame:
    """(label, label_id): labels in order, from 0, however many there are."""
    labels = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct()
    return numbered(labels, [F.col("label")], "label_id").withColumn("label_id", F.col("label_id").cast("int"))


def long_items(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(idx, tokens, mask, segments) of the songs with more than `length` tokens, cut to it; shorter ones are left out, as in the system replaced."""
    long = rows.filter(F.size("tokens") > length)
    return long.select("idx", F.slice("tokens", 1, length).alias("tokens"), F.array_repeat(F.lit(1), length).alias("mask"), F.array_repeat(F.lit(0), length).alias("segments"))


def confusion(predicted: DataFrame, truth: str = "label", guess: str = "predicted") -> DataFrame:
    return predicted.groupBy(F.col(truth).alias("label"), F.col(guess).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(cells: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) out of confusion(); a class never guessed has precision 0."""
    rows = cells.select(F.col("label").alias("c"), "n", F.lit(1).alias("true"), (F.col("label") == F.col("predicted")).cast("int").alias("hit"))
    cols = cells.select(F.col("predicted").alias("c"), "n", F.lit(0).alias("true"), F.lit(0).alias("hit"))
    sums = rows.unionByName(cols).groupBy("c").agg(F.sum(F.col("n") * F.col("true")).alias("support"), F.sum(F.col("n") * (1 - F.col("true"))).alias("guessed"), F.sum(F.col("n") * F.col("hit")).alias("hits"))
    precision = F.when(F.col("guessed") > 0, F.col("hits") / F.col("guessed")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("hits") > 0, 2 * F.col("hits") / (F.col("guessed") + F.col("support"))).otherwise(0.0)
    return sums.select(F.col("c").alias("label"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def micro_metrics(cells: DataFrame) -> DataFrame:
    """(n, accuracy, micro_f1): with one label a row the micro averages equal the accuracy."""
    hits = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    return cells.agg(F.sum("n").alias("n"), F.round(hits / F.sum("n"), 6).alias("accuracy"), F.round(hits / F.sum("n"), 6).alias("micro_f1"))


def multi_hot(rows: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """(word_id, word, hot): the rows of the word by class 0/1 matrix in order of the vocabulary."""
    presence = word_class_presence(rows, classes)
    hot = F.array(*(F.col(c) for c in presence.columns[1:]))
    return vocabulary(rows).join(presence.select("word", hot.alias("hot")), "word").select("word_id", "word", "hot")


def filter_features(rows: DataFrame, vectors: DataFrame, length: int = LENGTH, filters: int = 48, widths: tuple[int, ...] = (3, 4, 5), seed: int = 1) -> DataFrame:
    """(idx, genre, features): each song's first `length` words as vectors, under convolution filters of several widths, the greatest response of each.

    vectors: (word, df, vector); words without one are zero. The filters are
    drawn once from the seed and stay as they are; the layers above them are
    trained. idx should be unique.
    """
    from pyspark.ml.functions import array_to_vector

    known = materialize(vectors.select("word", "df", F.col("vector").cast("array<float>").alias("vector")), "word-rows")
    first = known.select(F.size("vector").alias("d")).first()
    d, total = (first["d"] if first else 1), known.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    head = rows.select("idx", "genre", F.posexplode_outer(F.slice("tokens", 1, length)).alias("place", "word"))
    met = with_sizes(head, known, ["word"], "df", total, "left").filter("vector IS NOT NULL").groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("place", "vector"))).alias("s"))  # at most `length` a song
    rng = np.random.default_rng(seed)
    kernels = [rng.normal(size=(w * d, filters)).astype(np.float32) / np.sqrt(w * d) for w in widths]

    @F.pandas_udf("array<double>")
    def pooled(places: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for at, words in zip(places, found):
            x = np.zeros((length, d), dtype=np.float32)
            if at is not None and len(at):
                x[np.asarray(at)] = np.stack(list(words))
            parts = []
            for w, kernel in zip(widths, kernels):
                windows = np.lib.stride_tricks.sliding_window_view(x, w, axis=0).transpose(0, 2, 1).reshape(-1, w * d)
                parts.append(np.maximum(windows @ kernel, 0).max(axis=0))
            out.append(np.concatenate(parts).astype(np.float64))
        return pd.Series(out)

    songs = rows.select("idx", "genre").join(met, "idx", "left")
    features = pooled(F.transform("s", lambda x: x["place"]), F.transform("s", lambda x: x["vector"]))
    return songs.select("idx", "genre", array_to_vector(features).alias("features"))


def network_classifier(features: DataFrame, hidden: int = 32, passes: int = 80, seed: int = 1) -> DataFrame:
    """(idx, label, predicted) of the test split by a network of one hidden layer over (idx, genre, features), trained on the train split."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    labels = materialize(label_ids(features, "genre"), "labels")
    parts = materialize(features.join(labels, features["genre"] == labels["label"]).select("idx", "genre", "features", "label_id", split(F.col("idx")).alias("part")), "network-parts")
    first = parts.select("features").first()
    if first is None:
        return features.select("idx", F.col("genre").alias("label"), F.col("genre").alias("predicted")).limit(0)
    layers = [len(first["features"]), hidden, labels.count()]
    model = MultilayerPerceptronClassifier(layers=layers, maxIter=passes, seed=seed, labelCol="label_id").fit(parts.filter("part = 'train'"))
    guessed = model.transform(parts.filter("part = 'test'")).select("idx", F.col("genre").alias("label"), F.col("prediction").cast("int").alias("label_id"))
    return guessed.join(labels.select(F.col("label").alias("predicted"), "label_id"), "label_id").select("idx", "label", "predicted")


def subword_items(songs: DataFrame, vocabulary_file: str, length: int = LENGTH, start: str = "<|startoftext|>", end: str = "<|endoftext|>") -> DataFrame:
    """(idx, ids, mask, segments) of (idx, text) songs for a sentence model: ids of start, the text's subwords and end.

    Only songs of more than `length` ids are kept, cut to it, as in the
    system replaced. The file is a vocabulary in the tokenizers library's
    form; it goes out with the job. Null texts are empty.
    """
    songs.sparkSession.sparkContext.addFile(vocabulary_file)
    name = Path(vocabulary_file).name

    def encode(batches):
        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        pieces = Tokenizer.from_file(SparkFiles.get(name))
        pieces.encode_special_tokens = True
        first, last = pieces.token_to_id(start), pieces.token_to_id(end)
        for batch in batches:
            ids = [[first, *e.ids, last] for e in pieces.encode_batch([t or "" for t in batch["text"]], add_special_tokens=False)]
            rows = [(i, x[:length], [1] * length, [0] * length) for i, x in zip(batch["idx"], ids) if len(x) > length]
            yield pd.DataFrame(rows, columns=["idx", "ids", "mask", "segments"])

    return songs.select("idx", "text").mapInPandas(encode, "idx bigint, ids array<int>, mask array<int>, segments array<int>")


def word_vectors(rows: DataFrame, size: int = 100, window: int = 5, seed: int = 1, iterations: int = 1):
    """A skip-gram model over the songs' tokens, of the library's own kind."""
    from pyspark.ml.feature import Word2Vec

    return Word2Vec(vectorSize=size, windowSize=window, minCount=1, seed=seed, maxIter=iterations, inputCol="tokens", outputCol="vector").fit(rows)


def _labelled(rows: DataFrame, features: int) -> DataFrame:
    """rows with hashed word features, label_id and the part of the split."""
    from pyspark.ml.feature import HashingTF

    labels = label_ids(rows, "genre")
    hashed = HashingTF(numFeatures=features, inputCol="tokens", outputCol="features").transform(rows)
    return hashed.join(labels, hashed["genre"] == labels["label"]).withColumn("part", split(F.col("idx")))


def best_classifier(rows: DataFrame, path: str, strengths: tuple[float, ...] = (0.2, 0.05, 0.01), features: int = 1 << 12, patience: int = 2):
    """The logistic regression of least log loss on the dev split; each better one is saved to path, and the saved one is read back.

    Ends early once `patience` strengths in a row were no better.
    """
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    parts = materialize(_labelled(rows, features).select("idx", "genre", "features", "label_id", "part"), "classifier-parts")
    loss = MulticlassClassificationEvaluator(labelCol="label_id", metricName="logLoss")
    least, worse = float("inf"), 0
    for strength in strengths:
        model = LogisticRegression(maxIter=20, regParam=strength, labelCol="label_id").fit(parts.filter("part = 'train'"))
        now = loss.evaluate(model.transform(parts.filter("part = 'dev'")))
        if now < least:
            least, worse = now, 0
            model.write().overwrite().save(path)
        else:
            worse += 1
            if worse == patience:
                break
    return LogisticRegressionModel.load(path)


def predicted(model, rows: DataFrame) -> DataFrame:
    """(idx, label, predicted) of the test split by a logistic regression over hashed words."""
    parts = _labelled(rows, model.numFeatures)
    guessed = model.transform(parts.filter("part = 'test'")).select("idx", F.col("genre").alias("label"), F.col("prediction").cast("int").alias("label_id"))
    labels = label_ids(rows, "genre")
    return guessed.join(labels.select(F.col("label").alias("predicted"), "label_id"), "label_id").select("idx", "label", "predicted")


def baseline_classifier(rows: DataFrame, features: int = 1 << 12) -> DataFrame:
    """(idx, label, predicted) of the test split by logistic regression over hashed words; stands in for the neural networks."""
    from pyspark.ml.classification import LogisticRegression

    parts = _labelled(rows, features)
    return predicted(LogisticRegression(maxIter=20, regParam=0.05, labelCol="label_id").fit(parts.filter("part = 'train'")), rows)
