"""One query for each operator of the inventory, over whole tables, and its SQL twin."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from lodeworks.functions.text import tokens
from lodeworks.functions.words import ENGLISH, ITALIAN, stemmed
from lodeworks.operators import ads, baskets, cluster, search, shingles, songs
from lodeworks.session import keep, materialize, shared_dir, stored
from lodeworks.sources.tables import ADS, LISTENING_LOG, LOG, NULL, SONGS, extract_ads, read_csv, read_tsv, table, with_file_order, write_csv, write_tsv

#: Plays that make a track part of a user's basket.
LEAST_PLAYS = 3
QUERY = "bilocale arredato"
CLEARED, PREPARED, SCRAPED = "dataset_kijiji_cleared", "preprocessed_dataset_kijiji", "dataset_kijiji"


def _plays(spark, sf_dir):
    return baskets.play_counts(table(spark, sf_dir, LOG), LEAST_PLAYS)


def play_counts_having(spark, sf_dir):
    return _plays(spark, sf_dir)


def play_counts_20(spark, sf_dir):
    """With the bar of the system replaced, which few pairs of small logs reach."""
    return baskets.play_counts(table(spark, sf_dir, LOG))


def basket_lists(spark, sf_dir):
    return baskets.baskets(_plays(spark, sf_dir))


def postings(spark, sf_dir):
    return baskets.postings(_plays(spark, sf_dir))


def track_users(spark, sf_dir):
    return baskets.track_users(_plays(spark, sf_dir))


def top_tracks(spark, sf_dir):
    return baskets.top_tracks(track_users(spark, sf_dir))


def top_pairs(spark, sf_dir):
    return baskets.top_pairs(top_tracks(spark, sf_dir))


def grouped_avg(spark, sf_dir):
    return ads.average_price(table(spark, sf_dir, CLEARED))


def dedup_first(spark, sf_dir):
    rows = table(spark, sf_dir, SCRAPED).filter("links <> 'links'")
    return ads.first_by_key(rows, "links", ["timestamps", "prices", "titles", "locations", "descriptions"])


def dedup_file_order(spark, sf_dir):
    """The first row of each link as the file has them."""
    rows = with_file_order(table(spark, sf_dir, SCRAPED)).filter("links <> 'links'")
    return ads.first_by_key(rows, "links", ["__file", "__row"]).drop("__file", "__row")


def distinct_links(spark, sf_dir):
    return table(spark, sf_dir, SCRAPED).filter("links <> 'links'").agg(F.count_distinct("links").alias("n"))


def extract_pages(spark, sf_dir):
    """The cleared ads written as HTML pages and read out of them again."""

    def safe(c):
        text = F.coalesce(c, F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(a), F.lit(b))
        return text

    c = {name: safe(F.col(name)) for name in ("links", "titles", "timestamps", "locations", "descriptions", "prices")}
    parts = ['<div id="search-result"><div class="item"><a class="cta" href="', c["links"], '">', c["titles"], '</a><p class="timestamp">', c["timestamps"], '</p><p class="locale">', c["locations"], '</p><p class="description">', c["descriptions"], '</p><h4 class="price">', c["prices"], "</h4></div></div>"]
    return extract_ads(table(spark, sf_dir, CLEARED).select(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("html")))


def _ad_counts(spark, sf_dir):
    return search.term_counts(table(spark, sf_dir, CLEARED), "links", ["descriptions", "titles"], ITALIAN)


def tokenize_counts(spark, sf_dir):
    return _ad_counts(spark, sf_dir)


def doc_freq(spark, sf_dir):
    return search.document_frequencies(_ad_counts(spark, sf_dir))


def _prepared(spark, sf_dir):
    return table(spark, sf_dir, PREPARED).select("links", "titles", "descriptions").distinct()


def tfidf_index(spark, sf_dir):
    rows = _prepared(spark, sf_dir)
    return search.index(search.term_counts(rows, "links", ["descriptions", "titles"], []), rows.select("links").distinct().count())


def _stored_index(spark, sf_dir) -> tuple[str, int]:
    """(path, number of documents) of the prepared ads' index, written once a session."""

    def build(path):
        rows = materialize(_prepared(spark, sf_dir), "prepared")
        length = F.coalesce(F.length("titles"), F.lit(0)) + F.coalesce(F.length("descriptions"), F.lit(0))
        lengths = rows.groupBy(F.col("links").alias("doc")).agg(F.max(length).alias("length"))
        n = rows.select("links").distinct().count()
        search.store_index(search.index(search.term_counts(rows, "links", ["descriptions", "titles"], []), n), lengths, f"{path}/postings")
        spark.createDataFrame([(n,)], "n bigint").write.parquet(f"{path}/size")

    path = stored(spark, f"index of {sf_dir}", build)
    return f"{path}/postings", spark.read.parquet(f"{path}/size").first()["n"]


def index_stored(spark, sf_dir):
    """The whole index as it is read back from where it is stored."""
    return search.stored_postings(spark, _stored_index(spark, sf_dir)[0])


def search_top22(spark, sf_dir):
    """Ranked search in the stored index: only the postings of the query's terms are read."""
    query = search.query_tokens(QUERY)
    path, n = _stored_index(spark, sf_dir)
    return search.search(search.stored_postings(spark, path, query), n, query)


def stemmed_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, CLEARED).filter("descriptions IS NOT NULL")
    return rows.select("links", F.array_join(stemmed(tokens(F.col("descriptions"))), " ").alias("stems"))


def shingle_counts(spark, sf_dir):
    rows = table(spark, sf_dir, CLEARED).filter("descriptions IS NOT NULL")
    return rows.select("links", F.size(shingles.shingles(F.col("descriptions"))).cast("bigint").alias("shingles"))


def _distinct_ads(spark, sf_dir):
    return shingles.distinct_texts(table(spark, sf_dir, CLEARED), "links", "descriptions")


def _signed(spark, sf_dir):
    return materialize(shingles.signatures(_distinct_ads(spark, sf_dir)), "signatures")


def class_members(spark, sf_dir):
    return _members(spark, sf_dir).select("key", "rep")


def _members(spark, sf_dir):
    return shingles.class_members(table(spark, sf_dir, CLEARED), "links", "descriptions")


def _shingled_members(spark, sf_dir):
    return materialize(shingles.class_members(table(spark, sf_dir, CLEARED).filter(F.length("descriptions") >= shingles.SHINGLE), "links", "descriptions"), "members")


def minhash_signature(spark, sf_dir):
    return _signed(spark, sf_dir).select("key", F.array_join("signature", "").alias("signature"))


def lsh_bands(spark, sf_dir):
    """The ads of each bucket of each band, every copy counted."""
    copies = _shingled_members(spark, sf_dir).filter("key = rep").select("key", "copies")
    buckets = shingles.bands(_signed(spark, sf_dir)).join(copies, "key").groupBy("band", "bucket").agg(F.sum("copies").alias("ads"))
    return buckets.select(F.col("band").cast("bigint").alias("band"), "bucket", "ads")


def lsh_pairs(spark, sf_dir):
    return shingles.lsh_pairs(_signed(spark, sf_dir))


def lsh_duplicates(spark, sf_dir):
    return shingles.later_copies(lsh_pairs(spark, sf_dir), _shingled_members(spark, sf_dir))


def jaccard_exact(spark, sf_dir):
    return shingles.jaccard_pairs(_distinct_ads(spark, sf_dir))


def lsh_recall(spark, sf_dir):
    texts, members = materialize(_distinct_ads(spark, sf_dir), "distinct-ads", compression="zstd"), _shingled_members(spark, sf_dir)
    signed = materialize(shingles.signatures(texts), "signatures")
    found = shingles.later_copies(shingles.lsh_pairs(signed), members).withColumn("lsh", F.lit(1))
    exact = shingles.later_copies(shingles.jaccard_pairs(texts), members).withColumn("exact", F.lit(1))
    both = found.join(exact, "key", "full").select(F.coalesce("lsh", F.lit(0)).alias("lsh"), F.coalesce("exact", F.lit(0)).alias("exact"))
    return both.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for c, n in ((F.col("lsh"), "n_lsh"), (F.col("exact"), "n_exact"), (F.col("lsh") * F.col("exact"), "n_both"))))


SEEDS = list(range(10))


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _assigned(spark, sf_dir):
    points = _points(spark, sf_dir)
    return cluster.assign(points, cluster.seeds(points, SEEDS))


def kmeans_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select(F.col("id").alias("vec_id"), "cluster", F.round("distance", 4).alias("distance"))


def kmeans_step(spark, sf_dir):
    return cluster.means(_assigned(spark, sf_dir)).select("cluster", "dim", F.round("mean", 5).alias("mean"))


def kmeans(spark, sf_dir):
    points = _points(spark, sf_dir)
    return cluster.kmeans(points, cluster.seeds(points, cluster.farthest_first(points, 10, 0)))[0].select(F.col("id").alias("vec_id"), "cluster")


def farthest_first(spark, sf_dir):
    chosen = cluster.farthest_first(_points(spark, sf_dir), 10, 0)
    return spark.createDataFrame(list(enumerate(chosen)), "step int, vec_id bigint")


def cluster_agreement(spark, sf_dir):
    return cluster.agreement(_assigned(spark, sf_dir), _points(spark, sf_dir))


def kmeans_agreement(spark, sf_dir):
    points = _points(spark, sf_dir)
    return cluster.agreement(kmeans(spark, sf_dir).withColumnRenamed("vec_id", "id"), points)


def svd_reduce(spark, sf_dir):
    return cluster.svd(_points(spark, sf_dir), 10)[0].select(F.col("id").alias("vec_id"), F.transform("reduced", lambda x: F.round(x, 4)).alias("reduced"))


def svd_singular_values(spark, sf_dir):
    values = cluster.svd(_points(spark, sf_dir), 10)[1]
    return spark.createDataFrame([(i, round(float(v), 4)) for i, v in enumerate(values)], "place int, value double")


def svd_reconstruct(spark, sf_dir):
    return cluster.reconstructed(_points(spark, sf_dir), 10).select(F.col("id").alias("vec_id"), F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


def svd_energy(spark, sf_dir):
    """The squares of all singular values add up to those of the points' places."""
    points = _points(spark, sf_dir)
    width = points.select(F.size("vector").alias("d")).first()["d"]
    values = cluster.svd(points, width)[1]
    return spark.createDataFrame([(len(values), round(float((values**2).sum()), 3))], "places int, energy double")


def svd_synthetic(spark, sf_dir):
    points = materialize(synthetic_points(spark, sf_dir), "synthetic")
    return cluster.svd(points, 50)[0]


def synthetic_points(spark, sf_dir):
    return cluster.without_hot_scale(synthetic_raw(spark, sf_dir), 50)


def synthetic_raw(spark, sf_dir):
    """The generated points before any scaling; generated, not read."""
    return cluster.synthetic_points(spark, 50, 1000, 50)


def synthetic_labels(spark, sf_dir):
    """The cluster each generated point belongs to, and where its one-hot part has its one."""
    return synthetic_raw(spark, sf_dir).select("id", "label", (F.array_position(F.slice("vector", 1, 50), 1.0) - 1).cast("int").alias("hot"))


def ground_clusters(spark, sf_dir):
    """The known clusters of the vectors, with their sizes and first members."""
    return _points(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("points"), F.min("id").alias("first_id"))


def synthetic_agreement(spark, sf_dir):
    """Agreement with the known clusters of k-means over the reduced synthetic points."""
    points = materialize(synthetic_points(spark, sf_dir), "synthetic")
    reduced = materialize(cluster.svd(points, 50)[0].withColumnRenamed("reduced", "vector"), "synthetic-reduced")
    found = cluster.kmeans(reduced, cluster.seeds(reduced, cluster.farthest_first(reduced, 50, 0)))[0]
    return cluster.agreement(found, points)


def _songs(spark, sf_dir):
    return songs.cleaned(table(spark, sf_dir, "lyrics"))


def _of_classes(spark, sf_dir):
    """All cleaned songs of the classes; only balanced_head takes the first of each class."""
    return _songs(spark, sf_dir).filter(F.col("genre").isin(*songs.CLASSES))


def _worded(spark, sf_dir):
    return songs.song_tokens(_of_classes(spark, sf_dir))


def clean_text(spark, sf_dir):
    return _songs(spark, sf_dir)


def class_counts(spark, sf_dir):
    return _songs(spark, sf_dir).groupBy("genre").agg(F.count(F.lit(1)).alias("songs"))


def balanced_head(spark, sf_dir):
    return songs.balanced(_songs(spark, sf_dir)).select("genre", "idx")


def song_words(spark, sf_dir):
    rows = _worded(spark, sf_dir)
    return rows.select("idx", F.array_join(F.array_sort("tokens"), " ").alias("words"))


def split_counts(spark, sf_dir):
    return _songs(spark, sf_dir).groupBy(songs.split(F.col("idx")).alias("part")).agg(F.count(F.lit(1)).alias("songs"))


def word_class_presence(spark, sf_dir):
    return songs.word_class_presence(_worded(spark, sf_dir))


def vocab_index(spark, sf_dir):
    return songs.vocabulary(_worded(spark, sf_dir))


def encode_pad(spark, sf_dir):
    rows = songs.song_tokens(_of_classes(spark, sf_dir), distinct=False)
    ids = songs.encoded(rows, songs.vocabulary(rows))
    return ids.select("idx", F.array_join("ids", " ").alias("ids"))


def label_index(spark, sf_dir):
    return songs.label_ids(_songs(spark, sf_dir), "genre").select("label", F.col("label_id").cast("bigint").alias("label_id"))


def long_items(spark, sf_dir):
    rows = songs.song_tokens(_of_classes(spark, sf_dir), distinct=False)
    return songs.long_items(rows).select("idx", *(F.array_join(c, " ").alias(c) for c in ("tokens", "mask", "segments")))


#: Vocabulary of a public subword tokenizer with marks of a text's start and end.
SUBWORDS = os.environ.get("LODEWORKS_SUBWORDS", "/opt/tokenizers/word_bpe_49k.json")


def multi_hot(spark, sf_dir):
    return songs.multi_hot(_worded(spark, sf_dir)).select("word_id", "word", F.array_join("hot", " ").alias("hot"))


def subword_items(spark, sf_dir):
    items = songs.subword_items(_of_classes(spark, sf_dir), SUBWORDS)
    return items.select("idx", *(F.array_join(c, " ").alias(c) for c in ("ids", "mask", "segments")))


def _read_again(spark, df, write, read):
    path = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    write(df, path)
    keep(spark, path)
    return read(path)


def tsv_log(spark, sf_dir):
    """The listening log as tab-separated text without header, written and read again."""
    return _read_again(spark, table(spark, sf_dir, LOG).select(*LISTENING_LOG.names), lambda df, p: write_tsv(df, p, header=False), lambda p: read_tsv(spark, p, LISTENING_LOG, null=NULL))


def tsv_ads(spark, sf_dir):
    """The prepared ads as tab-separated text with header, written and read again."""
    return _read_again(spark, table(spark, sf_dir, PREPARED).select(*ADS.names), write_tsv, lambda p: read_csv(spark, p, ADS, "\t", NULL))


def csv_songs(spark, sf_dir):
    """The songs, whose lyrics span lines, as comma-separated text, written and read again."""
    return _read_again(spark, table(spark, sf_dir, "lyrics").select(*SONGS.names), write_csv, lambda p: read_csv(spark, p, SONGS, null=NULL))


def _in_order(spark, sf_dir):
    return materialize(songs.song_tokens(_of_classes(spark, sf_dir), distinct=False), "songs")


def network_multi_hot(spark, sf_dir):
    """Metrics of a network with convolution filters over the words' class presence."""
    rows = _in_order(spark, sf_dir)
    train = rows.filter(songs.split(F.col("idx")) == "train")  # presence is learnt from the train split
    hot = songs.multi_hot(train).join(songs.vocabulary(train).select("word", "df"), "word")
    features = songs.filter_features(rows, hot.select("word", "df", F.col("hot").alias("vector")))
    return songs.class_metrics(songs.confusion(songs.network_classifier(features)))


def network_word2vec(spark, sf_dir):
    """Metrics of a network with convolution filters over word vectors."""
    from pyspark.ml.functions import vector_to_array

    rows = _in_order(spark, sf_dir)
    vectors = songs.word_vectors(rows, size=50).getVectors().select("word", vector_to_array("vector").alias("vector"))
    features = songs.filter_features(rows, songs.vocabulary(rows).join(vectors, "word").select("word", "df", "vector"))
    return songs.class_metrics(songs.confusion(songs.network_classifier(features)))


def model_checkpoint(spark, sf_dir):
    """The test songs' classes by the classifier that was best on the dev split, stored and loaded again."""
    rows = materialize(_worded(spark, sf_dir), "songs")
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    model = songs.best_classifier(rows, path)
    keep(spark, path)
    return songs.class_metrics(songs.confusion(songs.predicted(model, rows)))


def _cells(spark, sf_dir):
    points = _points(spark, sf_dir)
    assigned = _assigned(spark, sf_dir)
    names = points.filter(F.col("id").isin(SEEDS)).select(F.col("id").cast("int").alias("cluster"), F.col("label").alias("predicted"))  # one row a seed
    return songs.confusion(assigned.join(points.select("id", "label"), "id").join(F.broadcast(names), "cluster"))


def confusion_matrix(spark, sf_dir):
    return _cells(spark, sf_dir)


def class_metrics(spark, sf_dir):
    return songs.class_metrics(_cells(spark, sf_dir))


def micro_metrics(spark, sf_dir):
    return songs.micro_metrics(_cells(spark, sf_dir))


def word2vec(spark, sf_dir):
    vectors = songs.word_vectors(_worded(spark, sf_dir)).getVectors()
    from pyspark.ml.functions import vector_to_array

    return vectors.select("word", vector_to_array("vector").alias("vector"))


def classifier_eval(spark, sf_dir):
    rows = materialize(_worded(spark, sf_dir), "songs")
    return songs.class_metrics(songs.confusion(songs.baseline_classifier(rows)))


QUERIES = {
    f.__name__: f
    for f in (
        play_counts_having, play_counts_20, basket_lists, postings, track_users, top_tracks, top_pairs, grouped_avg, dedup_first, dedup_file_order, distinct_links, extract_pages,
        tokenize_counts, doc_freq, tfidf_index, index_stored, search_top22, stemmed_tokens, shingle_counts, class_members, minhash_signature, lsh_bands, lsh_pairs,
        lsh_duplicates, jaccard_exact, lsh_recall, kmeans_assign, kmeans_step, kmeans, farthest_first, cluster_agreement, kmeans_agreement, svd_reduce,
        svd_singular_values, svd_reconstruct, svd_energy, svd_synthetic, synthetic_points, synthetic_raw, synthetic_labels, synthetic_agreement, ground_clusters,
        tsv_log, tsv_ads, csv_songs, clean_text, class_counts, balanced_head, song_words, split_counts, word_class_presence, vocab_index,
        multi_hot, subword_items, encode_pad, label_index, long_items, confusion_matrix, class_metrics, micro_metrics, word2vec, classifier_eval, network_multi_hot, network_word2vec, model_checkpoint,
    )
}


def _listed(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_PLAYS = f"""plays AS (SELECT trim(userid) AS "user", trim(traid) AS track, count(*) AS plays FROM {LOG}
    WHERE trim(userid) <> '' AND trim(traid) <> '' GROUP BY ALL HAVING count(*) >= {LEAST_PLAYS}),
users AS (SELECT track, count(*) AS users FROM plays GROUP BY ALL),
top AS (SELECT * FROM users ORDER BY users DESC, track LIMIT 20)"""


def _counts(source: str, stop: list[str]) -> str:
    kept = f"list_filter(%s, lambda w: NOT list_contains({_listed(stop)}, w))" if stop else "%s"
    words = [kept % f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')" for c in ("descriptions", "titles")]
    both = " UNION ALL ".join(f"SELECT links AS doc, unnest({w}) AS term FROM {source}" for w in words)
    return f"counts AS (SELECT doc, term, count(*) AS tf FROM ({both}) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY ALL)"


_ADS = _counts(CLEARED, ITALIAN)
_INDEX = f"rows_once AS (SELECT DISTINCT links, titles, descriptions FROM {PREPARED}), " + _counts("rows_once", []) + """,
total AS (SELECT count(DISTINCT links) AS n FROM rows_once),
weights AS (SELECT term, doc, tf, df, round((1 + log10(tf)) * (1 + log10(n / df)), 6) AS weight FROM counts JOIN dfs USING (term) CROSS JOIN total)"""
_SHINGLES = f"""texts AS (SELECT min(links) AS key, descriptions AS text FROM {CLEARED} WHERE descriptions IS NOT NULL AND links IS NOT NULL GROUP BY descriptions),
shingles AS (SELECT key, list_distinct(list_transform(range(1, length(text) - 8), lambda i: substr(text, i, 10))) AS s FROM texts WHERE length(text) >= 10)"""
#: The same with every ad a text of its own, copies too.
_EVERY = _SHINGLES.replace("min(links) AS key", "links AS key").replace("GROUP BY descriptions", "GROUP BY ALL")
_SIGN = """, hexed AS (SELECT key, list_transform(s, lambda x: sha1(x)) AS s FROM shingles),
signed AS (SELECT key, list_transform(range(0, 10), lambda i: list_min(list_transform(s, lambda x: right(sha1(x || lpad(i::VARCHAR, 20, '0')), 10)))) AS signature FROM hexed),
hashes AS (SELECT key, unnest(signature) AS h, generate_subscripts(signature, 1) AS band FROM signed)"""
_SIGNED = _SHINGLES + _SIGN
_SIGNED_EVERY = _EVERY + _SIGN
_PAIRS = """, pairs AS (SELECT a.key AS a, b.key AS b, count(*) / 10 AS score FROM hashes a JOIN hashes b ON a.band = b.band AND a.h = b.h AND a.key < b.key GROUP BY ALL HAVING count(*) >= 8)"""
_LSH, _LSH_EVERY = _SIGNED + _PAIRS, _SIGNED_EVERY + _PAIRS
_EXACT = """sizes AS (SELECT key, len(s) AS n FROM shingles), flat AS (SELECT key, unnest(s) AS s FROM shingles),
shared AS (SELECT a.key AS a, b.key AS b, count(*) AS k FROM flat a JOIN flat b ON a.s = b.s AND a.key < b.key GROUP BY ALL),
exact AS (SELECT a, b, k / (x.n + y.n - k) AS jaccard FROM shared JOIN sizes x ON x.key = a JOIN sizes y ON y.key = b WHERE k / (x.n + y.n - k) >= 0.8)"""
_ASSIGNED = f"""points AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
gaps AS (SELECT p.vec_id, p.v, p.label, s.vec_id::INTEGER AS cluster, s.label AS predicted, list_distance(p.v, s.v) ** 2 AS distance FROM points p JOIN points s ON s.vec_id < {len(SEEDS)}),
assigned AS (SELECT vec_id, v, label, arg_min(cluster, (distance, cluster)) AS cluster, arg_min(predicted, (distance, cluster)) AS predicted, min(distance) AS distance FROM gaps GROUP BY ALL)"""
K = len(SEEDS)
_FARTHEST = "p0 AS (SELECT vec_id, embedding::DOUBLE[] AS v, NULL::DOUBLE AS gap FROM embeddings), c0 AS (SELECT 0 AS step, vec_id, v FROM p0 WHERE vec_id = 0), " + ", ".join(
    f"p{i} AS (SELECT p.vec_id, p.v, least(p.gap, list_distance(p.v, c.v) ** 2) AS gap FROM p{i - 1} p JOIN c{i - 1} c ON true), c{i} AS (SELECT {i} AS step, vec_id, v FROM p{i} ORDER BY gap DESC, vec_id LIMIT 1)" for i in range(1, K)
) + ", chosen AS (" + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(K)) + ")"
# passes go on to a number beyond which no center of the given vectors moves; further ones change nothing
_LLOYD = _FARTHEST + f""", passes AS (
    SELECT 0 AS pass, step AS cluster, v AS center FROM chosen
    UNION ALL
    SELECT pass, cluster, list(x ORDER BY dim) AS center FROM (
        SELECT pass + 1 AS pass, cluster, dim, avg(x) AS x
        FROM (SELECT pass, cluster, unnest(v) AS x, generate_subscripts(v, 1) AS dim
              FROM (SELECT pass, vec_id, any_value(p.v) AS v, arg_min(cluster, (list_distance(p.v, center) ** 2, cluster)) AS cluster FROM p0 p JOIN passes ON pass < 60 GROUP BY ALL))
        GROUP BY ALL) GROUP BY ALL),
final AS (SELECT vec_id, arg_min(cluster, (list_distance(p.v, center) ** 2, cluster))::INTEGER AS cluster FROM p0 p JOIN passes ON pass = 60 GROUP BY ALL)"""
_CELLS = _ASSIGNED + ", cells AS (SELECT label, predicted, count(*) AS n FROM assigned GROUP BY ALL)"
_SONGS = """songs AS (SELECT DISTINCT idx, genre, replace(replace(replace(trim(trim(lower(coalesce(lyrics, 'nan')), '[]'), '()'), 'chorus', ''), 'verse', ''), 'intro', '') AS text FROM lyrics),
cleaned AS (SELECT * FROM songs WHERE length(text) > 10)"""
_HEAD = _SONGS + f""", chosen AS (SELECT idx, genre, text FROM cleaned WHERE list_contains({_listed(songs.CLASSES)}, genre)),
worded AS (SELECT idx, genre, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: NOT list_contains({_listed(ENGLISH)}, w)) AS tokens FROM chosen),
words AS (SELECT idx, genre, unnest(list_distinct(tokens)) AS word FROM worded),
vocabulary AS (SELECT word, df, row_number() OVER (ORDER BY df DESC, word) - 1 AS word_id FROM (SELECT word, count(*) AS df FROM words GROUP BY ALL))"""

SQL = {
    "play_counts_having": f"WITH {_PLAYS} SELECT * FROM plays",
    "play_counts_20": f"WITH {_PLAYS.replace(f'>= {LEAST_PLAYS}', '>= 20')} SELECT * FROM plays",
    "basket_lists": f"""WITH {_PLAYS} SELECT "user", string_agg(track, ' ' ORDER BY track) AS tracks FROM plays GROUP BY ALL""",
    "postings": f"""WITH {_PLAYS} SELECT track, "user" FROM plays""",
    "track_users": f"WITH {_PLAYS} SELECT * FROM users",
    "top_tracks": f"WITH {_PLAYS} SELECT * FROM top",
    "top_pairs": f"""WITH {_PLAYS}, ranked AS (SELECT *, row_number() OVER (ORDER BY track) AS place FROM top)
        SELECT a.track AS track_a, b.track AS track_b, a.users + b.users AS score FROM ranked a JOIN ranked b ON a.place < b.place ORDER BY score DESC, track_a, track_b LIMIT 10""",
    "grouped_avg": f"""WITH priced AS (SELECT locations AS location, try_cast(replace(replace(left(prices, greatest(length(prices) - 2, 0)), '.', ''), ',', '.') AS DOUBLE) AS price
        FROM {CLEARED} WHERE prices NOT IN ('Contatta l''utente', 'prices'))
        SELECT location, count(*) AS ads, round(avg(price), 4) AS avg_price FROM priced WHERE price IS NOT NULL AND location IS NOT NULL GROUP BY ALL""",
    "dedup_first": f"""SELECT links, titles, timestamps, locations, descriptions, prices FROM {SCRAPED} WHERE links <> 'links'
        QUALIFY row_number() OVER (PARTITION BY links ORDER BY timestamps NULLS FIRST, prices NULLS FIRST, titles NULLS FIRST, locations NULLS FIRST, descriptions NULLS FIRST) = 1""",
    "dedup_file_order": f"""SELECT links, titles, timestamps, locations, descriptions, prices FROM (SELECT *, row_number() OVER () AS place FROM {SCRAPED}) WHERE links <> 'links'
        QUALIFY row_number() OVER (PARTITION BY links ORDER BY place) = 1""",
    "distinct_links": f"SELECT count(DISTINCT links) AS n FROM {SCRAPED} WHERE links <> 'links'",
    "extract_pages": "SELECT links, " + ", ".join(f"nullif(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '') AS {c}" for c in ("titles", "timestamps", "locations", "descriptions", "prices")) + f" FROM {CLEARED}",
    "tokenize_counts": f"WITH {_ADS} SELECT * FROM counts",
    "doc_freq": f"WITH {_ADS} SELECT * FROM dfs",
    "tfidf_index": f"WITH {_INDEX} SELECT * FROM weights",
    "index_stored": f"""WITH {_INDEX}, lengths AS (SELECT links AS doc, max(coalesce(length(titles), 0) + coalesce(length(descriptions), 0)) AS length FROM rows_once GROUP BY ALL)
        SELECT weights.*, length::INTEGER AS length FROM weights LEFT JOIN lengths USING (doc)""",
    "search_top22": f"""WITH {_INDEX}, query AS (SELECT unnest({_listed(search.query_tokens(QUERY))}) AS term),
        lengths AS (SELECT links AS doc, max(coalesce(length(titles), 0) + coalesce(length(descriptions), 0)) AS length FROM rows_once GROUP BY ALL)
        SELECT doc, round(sum(weight * (1.0 / (SELECT count(*) FROM query)) * (1 + log10((n + 1) / df))) / any_value(length), 8) AS score
        FROM weights JOIN query USING (term) JOIN lengths USING (doc) CROSS JOIN total WHERE length > 0 GROUP BY doc ORDER BY score DESC, doc LIMIT 22""",
    "shingle_counts": f"SELECT links, CASE WHEN length(descriptions) >= 10 THEN len(list_distinct(list_transform(range(1, length(descriptions) - 8), lambda i: substr(descriptions, i, 10)))) ELSE 0 END AS shingles FROM {CLEARED} WHERE descriptions IS NOT NULL",
    "class_members": f"SELECT DISTINCT links AS key, min(links) OVER (PARTITION BY descriptions) AS rep FROM {CLEARED} WHERE descriptions IS NOT NULL AND links IS NOT NULL",
    "minhash_signature": f"WITH {_SIGNED} SELECT key, array_to_string(signature, '') AS signature FROM signed",
    "lsh_bands": f"WITH {_SIGNED_EVERY} SELECT band, sha1(h) AS bucket, count(*) AS ads FROM hashes GROUP BY ALL",
    "lsh_pairs": f"WITH {_LSH} SELECT * FROM pairs",
    "lsh_duplicates": f"WITH {_LSH_EVERY} SELECT DISTINCT b AS key FROM pairs",
    "jaccard_exact": f"WITH {_SHINGLES}, {_EXACT} SELECT a, b, round(jaccard, 6) AS jaccard FROM exact",
    "lsh_recall": f"""WITH {_LSH_EVERY}, {_EXACT}, found AS (SELECT DISTINCT b FROM pairs), true_ones AS (SELECT DISTINCT b FROM exact)
        SELECT (SELECT count(*) FROM found) AS n_lsh, (SELECT count(*) FROM true_ones) AS n_exact, (SELECT count(*) FROM found JOIN true_ones USING (b)) AS n_both""",
    "kmeans_assign": f"WITH {_ASSIGNED} SELECT vec_id, cluster, round(distance, 4) AS distance FROM assigned",
    "kmeans_step": f"WITH {_ASSIGNED}, cells AS (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM assigned) SELECT cluster, dim::INTEGER AS dim, round(avg(x), 5) AS mean FROM cells GROUP BY ALL",
    "farthest_first": f"WITH {_FARTHEST} SELECT step::INTEGER AS step, vec_id FROM chosen",
    "kmeans": f"WITH RECURSIVE {_LLOYD} SELECT vec_id, cluster FROM final",
    "kmeans_agreement": f"""WITH RECURSIVE {_LLOYD}, cells AS (SELECT label, cluster, count(*) AS n FROM final JOIN embeddings USING (vec_id) GROUP BY ALL)
        SELECT label, round(max(n / (found + known - n)), 6) AS jaccard
        FROM (SELECT *, sum(n) OVER (PARTITION BY cluster) AS found, sum(n) OVER (PARTITION BY label) AS known FROM cells) GROUP BY label""",
    "svd_energy": "SELECT max(d)::INTEGER AS places, round(sum(x), 3) AS energy FROM (SELECT len(embedding) AS d, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS x FROM embeddings)",
    "synthetic_labels": "SELECT i AS id, (i % 50)::INTEGER AS label, (i % 50)::INTEGER AS hot FROM range(50000) r(i)",
    "ground_clusters": "SELECT label, count(*) AS points, min(vec_id) AS first_id FROM embeddings GROUP BY ALL",
    "tsv_log": f"SELECT {', '.join(LISTENING_LOG.names)} FROM {LOG}",
    "tsv_ads": f"SELECT {', '.join(ADS.names)} FROM {PREPARED}",
    "csv_songs": f"SELECT {', '.join(SONGS.names)} FROM lyrics",
    "multi_hot": f"WITH {_HEAD}, hot AS (SELECT word, concat_ws(' ', " + ", ".join(f"max((genre = '{c}')::INTEGER)" for c in songs.CLASSES) + ") AS hot FROM words GROUP BY word) SELECT word_id, word, hot FROM hot JOIN vocabulary USING (word)",
    "cluster_agreement": f"""WITH {_ASSIGNED}, cells AS (SELECT label, cluster, count(*) AS n FROM assigned GROUP BY ALL)
        SELECT label, round(max(n / (found + known - n)), 6) AS jaccard
        FROM (SELECT *, sum(n) OVER (PARTITION BY cluster) AS found, sum(n) OVER (PARTITION BY label) AS known FROM cells) GROUP BY label""",
    "clean_text": f"WITH {_SONGS} SELECT * FROM cleaned",
    "class_counts": f"WITH {_SONGS} SELECT genre, count(*) AS songs FROM cleaned GROUP BY ALL",
    "balanced_head": f"""WITH {_HEAD} SELECT genre, idx FROM chosen QUALIFY row_number() OVER (PARTITION BY genre ORDER BY idx, text) <= {songs.PER_CLASS}""",
    "song_words": f"WITH {_HEAD} SELECT idx, array_to_string(list_sort(list_distinct(tokens)), ' ') AS words FROM worded",
    "split_counts": f"""WITH {_SONGS}, buckets AS (SELECT ('0x' || left(md5(idx::VARCHAR), 4))::INT % 100 AS b FROM cleaned)
        SELECT CASE WHEN b < 81 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'test' END AS part, count(*) AS songs FROM buckets GROUP BY ALL""",
    "word_class_presence": f"WITH {_HEAD} SELECT word, " + ", ".join(f"max((genre = '{c}')::INTEGER) AS {c.lower().replace('-', '_')}" for c in songs.CLASSES) + " FROM words GROUP BY word",
    "vocab_index": f"WITH {_HEAD} SELECT * FROM vocabulary",
    "encode_pad": f"""WITH {_HEAD}, heads AS (SELECT idx, unnest(tokens[1:100]) AS word, generate_subscripts(tokens[1:100], 1) AS place FROM worded),
        ids AS (SELECT idx, list(coalesce(word_id, 0) ORDER BY place) AS ids FROM heads LEFT JOIN vocabulary USING (word) GROUP BY ALL)
        SELECT idx, array_to_string(list_transform(range(1, 101), lambda i: coalesce(ids[i], 0)), ' ') AS ids FROM worded LEFT JOIN ids USING (idx)""",
    "label_index": f"WITH {_SONGS} SELECT genre AS label, row_number() OVER (ORDER BY genre) - 1 AS label_id FROM (SELECT DISTINCT genre FROM cleaned WHERE genre IS NOT NULL)",
    "long_items": f"""WITH {_HEAD} SELECT idx, array_to_string(tokens[1:100], ' ') AS tokens, array_to_string(list_transform(range(100), lambda i: 1), ' ') AS mask,
        array_to_string(list_transform(range(100), lambda i: 0), ' ') AS segments FROM worded WHERE len(tokens) > 100""",
    "confusion_matrix": f"WITH {_CELLS} SELECT * FROM cells",
    "class_metrics": f"""WITH {_CELLS}, k AS (SELECT label, sum(n) AS support, sum(n) FILTER (label = predicted) AS hits FROM cells GROUP BY ALL),
        g AS (SELECT predicted AS label, sum(n) AS guessed FROM cells GROUP BY ALL)
        SELECT label, round(coalesce(coalesce(hits, 0) / guessed, 0), 6) AS precision, round(coalesce(coalesce(hits, 0) / support, 0), 6) AS recall,
        round(coalesce(2 * hits / (coalesce(guessed, 0) + coalesce(support, 0)), 0), 6) AS f1, coalesce(support, 0)::BIGINT AS support FROM k FULL JOIN g USING (label)""",
    "micro_metrics": f"""WITH {_CELLS} SELECT sum(n)::BIGINT AS n, round(sum(n) FILTER (label = predicted) / sum(n), 6) AS accuracy, round(sum(n) FILTER (label = predicted) / sum(n), 6) AS micro_f1 FROM cells""",
}
