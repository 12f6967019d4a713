"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lodeworks.llm import decontam, langid, neardup, packing, pagespam, quota, weights
from lodeworks.sources.tables import spread_table, table


#: Shingles of ten characters, similarity and least length of an ad's description.
ADS = {"key": "links", "text": "descriptions", "shingle": 10, "threshold": 0.7, "min_chars": 80}


def p1_found(spark, sf_dir):
    pairs = neardup.similar_pairs(table(spark, sf_dir, "dataset_kijiji_cleared"), **ADS)
    return pairs.select(F.col("a").alias("link_a"), F.col("b").alias("link_b"))


def p1_classes(spark, sf_dir):
    return neardup.classes(table(spark, sf_dir, "dataset_kijiji_cleared"), **ADS).withColumnRenamed("id", "link")


def p2_sample(spark, sf_dir):
    sample, report = quota.sample_by_targets(table(spark, sf_dir, "lyrics"), table(spark, sf_dir, "genre_targets"))
    names = report.groupBy("set_id", "category").agg(F.min("genre").alias("genre"))
    return sample.join(names, ["set_id", "category"]).select("set_id", "genre", "idx")


def p2_report(spark, sf_dir):
    candidates = quota.eligible(table(spark, sf_dir, "lyrics"))
    return quota.quota_report(candidates, table(spark, sf_dir, "genre_targets")).drop("category")


def p2_found(spark, sf_dir):
    return p2_report(spark, sf_dir).filter("shortfall > 0").select("set_id", "genre").distinct()


def _stanzas(spark, sf_dir):
    return langid.stanza_languages(table(spark, sf_dir, "lyrics"), table(spark, sf_dir, "lyrics_labels"))


def p3_stanzas(spark, sf_dir):
    return _stanzas(spark, sf_dir).select("idx", "stanza", "lang", "confidence")


def p3_songs(spark, sf_dir):
    songs = _stanzas(spark, sf_dir).select("idx", F.col("song_lang").alias("lang"), F.col("song_confidence").alias("confidence"), "label", (F.col("languages") > 1).alias("mixed"))
    return songs.distinct()


def p3_found(spark, sf_dir):
    return langid.relabelled(_stanzas(spark, sf_dir)).select("idx", "stanza", "lang")


def p5_weights(spark, sf_dir):
    postings, records = weights.term_weights(table(spark, sf_dir, "preprocessed_dataset_kijiji"))
    return postings.join(records, "record").select("link", "term", "weight")


def p5_found(spark, sf_dir):
    return weights.top_terms(*weights.term_weights(table(spark, sf_dir, "preprocessed_dataset_kijiji"), local="tf", min_df=2))


#: Vocabulary of the public byte-level BPE that p6_pack_bpe measures with, and how it splits a text before its merges.
BPE = os.environ.get("LODEWORKS_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
BPE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of a partition in p6_exchange, few enough that the partitions have gaps to close.
FEW = 500


def _packed(spark, sf_dir):
    return packing.pack(packing.sized_by_words(table(spark, sf_dir, "documents")), table(spark, sf_dir, "containers"))


def p6_pack(spark, sf_dir):
    return _packed(spark, sf_dir).withColumnRenamed("id", "doc_id")


def p6_pack_bpe(spark, sf_dir):
    items = packing.sized_by_bpe(spread_table(spark, sf_dir, "documents", ["doc_id", "text"]), BPE, BPE_PATTERN)
    return packing.pack(items, table(spark, sf_dir, "containers")).withColumnRenamed("id", "doc_id")


def p6_certificate(spark, sf_dir):
    return packing.certificate(_packed(spark, sf_dir))


def p6_partitions(spark, sf_dir):
    return packing.partition_certificate(_packed(spark, sf_dir))


def p6_exchange(spark, sf_dir):
    """The certificate of a packing over many small partitions, which exchange their documents."""
    packed = packing.pack(packing.sized_by_words(table(spark, sf_dir, "documents")), table(spark, sf_dir, "containers"), per_partition=FEW)
    return packing.certificate(packed)


def p6_found(spark, sf_dir):
    return packing.cut_items(_packed(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def p7_found(spark, sf_dir):
    return decontam.leaks(spread_table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "eval_items"))


def p7_cleaned(spark, sf_dir):
    return decontam.cleaned(spread_table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "eval_items"))


PAGE = ["doc_id", "lang", "text"]


def p8_scores(spark, sf_dir):
    return pagespam.page_scores(spread_table(spark, sf_dir, "documents", PAGE))


def p8_found(spark, sf_dir):
    return pagespam.spam_pages(spread_table(spark, sf_dir, "documents", PAGE))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p2_sample, p2_report, p2_found, p3_stanzas, p3_songs, p3_found, p5_weights, p5_found, p6_pack, p6_pack_bpe, p6_certificate, p6_partitions, p6_exchange, p6_found, p7_found, p7_cleaned, p8_scores, p8_found)}

_CATEGORY = "regexp_replace(lower(genre), '[^a-z0-9]', '', 'g')"
_ELIGIBLE = f"""eligible AS (SELECT idx, min({_CATEGORY}) AS category FROM lyrics
    WHERE idx IS NOT NULL AND length(regexp_replace(lyrics, '^\\s+|\\s+$', '', 'g')) > 10 GROUP BY ALL),
counts AS (SELECT category, count(*) AS available FROM eligible GROUP BY ALL)"""
# one row a step and category; each step binds categories to their floor or cap until none is left to bind
_QUOTAS = f"""WITH RECURSIVE {_ELIGIBLE},
wanted AS (SELECT DISTINCT set_id, genre, {_CATEGORY} AS category, coalesce(target_pct, 0)::BIGINT AS pct, coalesce(min_rows, 0)::BIGINT AS least, coalesce(sample_rows, 0)::BIGINT AS sample_rows FROM genre_targets),
parts AS (SELECT set_id, coalesce(category, chr(1)) AS c, sum(pct)::BIGINT AS share, coalesce(max(available), 0) AS cap, least(max(least), coalesce(max(available), 0)) AS floor
          FROM wanted LEFT JOIN counts USING (category) GROUP BY ALL),
totals AS (SELECT set_id, max(sample_rows) AS total FROM wanted GROUP BY ALL),
steps AS (
    SELECT 0 AS step, set_id, c, share, cap, floor, total, NULL::BIGINT AS quota FROM parts JOIN totals USING (set_id)
    UNION ALL
    SELECT step + 1, set_id, c, share, cap, floor, total,
        CASE WHEN quota IS NOT NULL THEN quota WHEN NOT bool_or(low OR high) OVER s THEN part
             WHEN coalesce(sum(floor - part) FILTER (low) OVER s, 0) >= coalesce(sum(part - cap) FILTER (high) OVER s, 0) THEN CASE WHEN low THEN floor END
             WHEN high THEN cap END::BIGINT
    FROM (SELECT *, quota IS NULL AND part < floor AS low, quota IS NULL AND part > cap AS high
          FROM (SELECT *, whole + (row_number() OVER (PARTITION BY set_id, quota IS NULL ORDER BY rem DESC, c) <= CASE WHEN weight > 0 THEN rest - sum(whole) FILTER (quota IS NULL) OVER (PARTITION BY set_id) ELSE 0 END)::INT AS part
                FROM (SELECT *, CASE WHEN weight > 0 THEN rest * share // weight ELSE 0 END AS whole, CASE WHEN weight > 0 THEN rest * share % weight ELSE 0 END AS rem
                      FROM (SELECT *, greatest(0, total - coalesce(sum(quota) OVER (PARTITION BY set_id), 0))::BIGINT AS rest, coalesce(sum(share) FILTER (quota IS NULL) OVER (PARTITION BY set_id), 0)::BIGINT AS weight
                            FROM (SELECT *, count(*) FILTER (quota IS NULL) OVER (PARTITION BY set_id) AS open FROM steps) WHERE open > 0))))
    WINDOW s AS (PARTITION BY set_id)),
settled AS (SELECT * FROM steps QUALIFY step = max(step) OVER (PARTITION BY set_id)),
quotas AS (SELECT set_id, c, quota, sum(quota) OVER (PARTITION BY set_id) AS drawn FROM settled)"""
#: The normalised form of a text.
_NORM = "trim(regexp_replace(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_TERMS = """
WITH rows_once AS (SELECT DISTINCT links, titles, descriptions FROM preprocessed_dataset_kijiji),
records AS (SELECT row_number() OVER () AS record, * FROM rows_once),
fields AS (SELECT record, links, 1 AS field, list_filter(string_split(titles, ' '), lambda w: w <> '') AS words FROM records
           UNION ALL SELECT record, links, 2, list_filter(string_split(descriptions, ' '), lambda w: w <> '') FROM records),
places AS (SELECT record, links, field, unnest(words) AS term, generate_subscripts(words, 1) AS place FROM fields),
tfs AS (SELECT record, links, term, count(*) AS tf FROM places GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY ALL),
total AS (SELECT count(DISTINCT record) AS n FROM tfs)
"""
SQL = {
    "p6_found": """SELECT DISTINCT container, doc_id FROM documents JOIN containers
        ON length(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) > capacity_tokens""",
    "p1_found": f"""
        WITH normed AS (SELECT links AS link, min({_NORM.format("coalesce(descriptions, '')")}) AS norm FROM dataset_kijiji_cleared WHERE links IS NOT NULL GROUP BY ALL),
        shingles AS (SELECT link, list_distinct(list_transform(range(1, length(norm) - 8), lambda i: substr(norm, i, 10))) AS s FROM normed WHERE length(norm) >= 80),
        flat AS (SELECT link, len(s) AS n, unnest(s) AS s FROM shingles),
        shared AS (SELECT a.link AS link_a, b.link AS link_b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM flat a JOIN flat b ON a.s = b.s AND a.link < b.link GROUP BY ALL)
        SELECT link_a, link_b FROM shared WHERE k >= 0.7 * (na + nb - k)""",
    "p2_found": f"""
        WITH {_ELIGIBLE}
        SELECT DISTINCT set_id, genre FROM genre_targets LEFT JOIN counts ON category = {_CATEGORY}
        WHERE coalesce(available, 0) < greatest(coalesce(min_rows, 0), ceil(sample_rows * target_pct / 100))""",
    "p2_report": f"""{_QUOTAS}, needs AS (SELECT *, greatest(least, (sample_rows * pct + 99) // 100) AS needed FROM wanted)
        SELECT set_id, genre, sample_rows, needed, coalesce(available, 0) AS available, quota, greatest(0, needed - coalesce(available, 0)) AS shortfall,
        greatest(0, needed - quota) AS unmet, greatest(0, drawn - total)::BIGINT AS overdrawn
        FROM needs JOIN quotas USING (set_id) JOIN totals USING (set_id) LEFT JOIN counts USING (category) WHERE c = coalesce(needs.category, chr(1))""",
    "p2_sample": f"""{_QUOTAS}, names AS (SELECT set_id, category, min(genre) AS genre FROM wanted WHERE category IS NOT NULL GROUP BY ALL)
        SELECT names.set_id, genre, idx FROM names JOIN quotas ON quotas.set_id = names.set_id AND c = names.category JOIN eligible USING (category)
        QUALIFY row_number() OVER (PARTITION BY names.set_id, category ORDER BY left(md5('7|' || names.set_id || '|' || idx), 15), idx) <= quota""",
    "p7_found": f"""
        WITH docs AS (SELECT doc_id, string_split({_NORM.format("text")}, ' ') AS w FROM documents), items AS (SELECT item_id, string_split({_NORM.format("text")}, ' ') AS w FROM eval_items),
        a AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS gram FROM docs WHERE len(w) >= 12),
        b AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS gram FROM items WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (gram)""",
    "p5_weights": _TERMS
    + """, edges AS (SELECT a.record, a.term, count(DISTINCT b.term) AS degree FROM places a
                     JOIN places b ON a.record = b.record AND a.field = b.field AND abs(a.place - b.place) BETWEEN 1 AND 3 AND a.term <> b.term GROUP BY ALL)
        SELECT tfs.links AS link, tfs.term, round((1 + log10(coalesce(degree, 1))) * (1 + log10(n / df)), 6) AS weight
        FROM tfs JOIN dfs USING (term) CROSS JOIN total LEFT JOIN edges ON edges.record = tfs.record AND edges.term = tfs.term""",
    "p5_found": _TERMS
    + """, weighed AS (SELECT links, term, round((1 + log10(tf)) * (1 + log10(n / df)), 6) AS weight FROM tfs JOIN dfs USING (term) CROSS JOIN total WHERE df >= 2)
        SELECT links AS link, arg_min(term, (-weight, term)) AS term FROM weighed GROUP BY ALL""",
}


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
