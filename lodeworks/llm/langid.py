"""Languages of documents and of their segments by nearest clustered centroids.

A line's vector holds the words and the 2- to 4-character n-grams of its
words, hashed to DIMS places, weighted tf * idf and normalised. Each
language has several centroids, clustered by spherical k-means over the lines
of labelled songs. A line takes the language of the centroid with the greatest
cosine; one below that language's rejection threshold has none. Lines vote
with their words for the segment (stanza) and the song.

The model is fitted in the driver on a bounded sample: of each language the
`songs_per_language` songs of smallest hash key. Labels may be wrong and
songs mixed, so lines are assigned anew before clustering. Everything else
runs over all rows and whole texts.

Defined results: rows with a null idx are left out; of rows that share an idx
the smallest lyrics hold; null lyrics and lyrics of at most MIN_CHARS
characters give no rows; stanzas of vocalises only count in the numbering but
give no row; a stanza whose lines are all rejected has a null language and
confidence 0; without any usable label there is no model and no row.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import longer_than, trimmed

DIMS = 1 << 15
SONGS_PER_LANGUAGE, CLUSTERS, PASSES = 300, 4, 8
MIN_CHARS = 10
#: A line is rejected below this part of the cosine that all but one in two hundred training lines of its language reach.
REJECT_PART = 0.6
#: Places that a whole word takes in a vector, beside its n-grams.
WORD_WEIGHT = 3
#: A line of less confidence follows the sure lines around it: those of its stanza, else those of its song.
UNSURE = 0.15

#: Spellings of the languages, without region; a collection of others passes its own.
SPELLINGS = {
    "en": "en eng english inglese inglés anglais englisch",
    "it": "it ita italian italiano italien italienisch",
    "es": "es spa spanish español espanol spagnolo espagnol spanisch castellano",
    "fr": "fr fra fre french français francais francese francés französisch",
    "de": "de deu ger german deutsch tedesco alemán allemand",
    "pt": "pt por portuguese português portugues portoghese portugués portugais",
    "ru": "ru rus russian русский russo ruso russe russisch",
}
#: Syllables sung without meaning, and words that are such only in a line of nothing else.
VOCALISES = frozenset("la na oh ooh oooh ohh yeah yea yeh hey uh huh mmm mm hmm hm ah aah eh woah whoa".split())
SUNG = VOCALISES | frozenset("ha ho wo da doo du dum do sha ya yo a e o u ла на о а эй".split())

_BREAK = re.compile(r"\r\n|\r|\n")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_CACHE = 200_000


def language_code(column: Column, spellings: dict[str, str] = SPELLINGS) -> Column:
    """Code of a language's spelling, regions dropped; null for anything unknown."""
    name = F.regexp_replace(F.lower(trimmed(column)), r"[-_].*$", "")
    pairs = [F.lit(x) for code, names in spellings.items() for spelling in names.split() for x in (spelling, code)]
    return F.try_element_at(F.create_map(*pairs), name)


def stanzas_of(text: str | None) -> list[list[str]]:
    """The blocks of lines between blank lines, section markers removed first."""
    blocks: list[list[str]] = [[]]
    for line in _BREAK.split(text or ""):
        line = line.strip()
        if line[:1] in ("[", "(") and line[-1:] in ("]", ")") and line:
            continue
        if line:
            blocks[-1].append(line)
        elif blocks[-1]:
            blocks.append([])
    return [b for b in blocks if b]


def words_of(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def spoken(words: list[str]) -> int:
    """Words that are no vocalises; none in a line of sung syllables."""
    return 0 if SUNG.issuperset(words) else sum(w not in VOCALISES for w in words)


@dataclass
class Model:
    """Centroids as a (DIMS, languages * clusters) matrix, their languages, idf and rejection thresholds.

    A line's vector is the sum of its words' vectors, so its products with the
    centroids are sums of one short row a word, computed once for each
    distinct word.
    """

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    reject: np.ndarray
    _words: dict = field(default_factory=dict, repr=False)
    _ids: list = field(default_factory=list, repr=False)
    _rows: np.ndarray | None = field(default=None, repr=False)
    _lines: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_words": {}, "_ids": [], "_rows": None, "_lines": {}}

    def judge(self, lines: list[str]) -> list[tuple[int, float, int]]:
        """(language number or -1, confidence, spoken words) of each line; the confidence is the lead over the next language, as a part of the best cosine."""
        if len(self._lines) > _CACHE:
            self._lines.clear()
        known = self._lines
        new = [x for x in dict.fromkeys(lines) if x not in known]
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            words = [words_of(x) for x in part]
            top, sure = self.nearest(words)
            known.update(zip(part, zip(top.tolist(), sure.tolist(), map(spoken, words))))
        return [known[x] for x in lines]

    def nearest(self, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(language numbers or -1, confidences) of lists of words."""
        filled = np.array([k for k, words in enumerate(lines) if words], dtype=np.int64)
        top, sure = np.full(len(lines), -1), np.zeros(len(lines))
        if not len(filled):
            return top, sure
        rows = self._known({w for words in lines for w in words})
        numbers, place = self._words, np.cumsum([0, *(len(lines[k]) for k in filled)])[:-1]
        each = rows[[numbers[w] for k in filled for w in lines[k]]]
        sums = np.add.reduceat(each, place, axis=0)
        squares = np.add.reduceat(each[:, -1] ** 2, place)
        best = np.stack([sums[:, :-1][:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
        order = np.sort(best, axis=1)
        first = best.argmax(axis=1)
        lead = order[:, -1] - order[:, -2] if best.shape[1] > 1 else order[:, -1]
        sure[filled] = np.where(order[:, -1] > 0, lead / np.maximum(order[:, -1], 1e-9), 0.0)
        # the norm of a line lies between the root of its words' squares and the sum of their norms; where that does not settle the rejection it is computed
        bar = self.reject[first]
        near = order[:, -1] >= bar * sums[:, -1]
        open_ones = np.flatnonzero(~near & (order[:, -1] >= bar * np.sqrt(squares)))
        if len(open_ones):
            ids = [self._ids[numbers[w]] for k in open_ones for w in lines[filled[k]]]
            width = np.add.reduceat([len(x) for x in ids], np.cumsum([0, *(len(lines[filled[k]]) for k in open_ones)])[:-1])
            cells, counts = np.unique(np.repeat(np.arange(len(open_ones), dtype=np.int64) * DIMS, width) + np.concatenate(ids), return_counts=True)
            norms = np.sqrt(np.bincount(cells // DIMS, (counts * self.idf[cells % DIMS]) ** 2))
            near[open_ones] = order[open_ones, -1] >= bar[open_ones] * norms
        top[filled] = np.where(near & (order[:, -1] > 0), first, -1)
        return top, sure

    def _known(self, words: set[str]) -> np.ndarray:
        """Rows of products with each centroid and the norm, of at least the given words; _words has their numbers."""
        if self._rows is None or len(self._words) > _CACHE:
            self._words, self._ids, self._rows = {}, [], np.zeros((0, len(self.owner) + 1), dtype=np.float32)
        new = [w for w in words if w not in self._words]
        if new:
            ids = [_word_ids(w) for w in new]
            place, flat = np.cumsum([0, *map(len, ids)])[:-1], np.concatenate(ids)
            weight = self.idf[flat]
            products = np.add.reduceat(self.centroids[flat] * weight[:, None].astype(np.float32), place, axis=0)
            norms = np.sqrt(np.add.reduceat(weight**2, place))
            self._ids += ids
            self._words.update((w, len(self._rows) + k) for k, w in enumerate(new))
            self._rows = np.concatenate([self._rows, np.column_stack([products, norms]).astype(np.float32)])
        return self._rows


def _word_ids(word: str) -> np.ndarray:
    padded = f"_{word}_"
    grams = {padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1)} | {f"{k}={word}" for k in range(WORD_WEIGHT)}
    return np.array([zlib.crc32(g.encode()) % DIMS for g in grams], dtype=np.int64)


def vectors(lines: list[str], idf: np.ndarray | None, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sparse rows (row, place, value) sorted by row, and their number; without idf the values are the plain counts."""
    rows, parts = [], []
    for k, line in enumerate(lines):
        for w in words_of(line):
            if (ids := cache.get(w)) is None:
                if len(cache) > _CACHE:
                    cache.clear()
                ids = cache[w] = _word_ids(w)
            rows.append(np.full(len(ids), k * DIMS, dtype=np.int64))
            parts.append(ids)
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0), len(lines)
    cells, counts = np.unique(np.concatenate(rows) + np.concatenate(parts), return_counts=True)
    row, ids = cells // DIMS, cells % DIMS
    if idf is None:
        return row, ids, counts.astype(float), len(lines)
    values = counts * idf[ids]
    norm = np.sqrt(np.bincount(row, values**2, minlength=len(lines)))
    return row, ids, values / np.maximum(norm[row], 1e-12), len(lines)


def _centroids(row, ids, values, group: np.ndarray, n: int) -> np.ndarray:
    """(DIMS, n) normalised sums of the rows of each group."""
    sums = np.bincount(group[row] * DIMS + ids, values, minlength=n * DIMS).reshape(n, DIMS).T
    return sums / np.maximum(np.linalg.norm(sums, axis=0), 1e-12)


def _cosines(row, ids, values, lines: int, centroids: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(row, values * np.ascontiguousarray(c)[ids], minlength=lines) for c in centroids.T], axis=1)


def train(texts: list[tuple[str, str]], clusters: int = CLUSTERS) -> Model | None:
    """A model from (language, lyrics) pairs."""
    votes: dict[str, dict[str, int]] = {}
    for language, lyrics in texts:
        for line in {x for s in stanzas_of(lyrics) for x in s}:
            if spoken(words_of(line)) > 1:
                mine = votes.setdefault(line, {})
                mine[language] = mine.get(language, 0) + 1
    lines = sorted(votes)
    if not lines:
        return None
    languages = sorted({c for v in votes.values() for c in v})
    label = np.array([languages.index(max(sorted(votes[x]), key=votes[x].get)) for x in lines])
    row, ids, counts, n = vectors(lines, None, {})
    idf = np.log((1 + n) / (1 + np.bincount(ids, minlength=DIMS))) + 1
    values = counts * idf[ids]
    values /= np.sqrt(np.bincount(row, values**2, minlength=n))[row]
    for _ in range(3):  # lines in another language than their song's label move to it
        label = _cosines(row, ids, values, n, _centroids(row, ids, values, label, len(languages))).argmax(axis=1)
    centroids, owner, reject = [], [], np.zeros(len(languages))
    for k in range(len(languages)):
        mine = np.flatnonzero(label == k)
        size = max(1, min(clusters, len(mine) // 20))
        use = label[row] == k
        own = (np.searchsorted(mine, row[use]), ids[use], values[use])
        group = np.arange(len(mine)) % size
        for _ in range(PASSES):
            near = _cosines(*own, len(mine), _centroids(*own, group, size))
            group = near.argmax(axis=1)
        centroids.append(_centroids(*own, group, size))
        owner += [k] * size
        if len(mine):
            reject[k] = REJECT_PART * np.quantile(near.max(axis=1), 0.005)
    return Model(languages, np.array(owner), np.concatenate(centroids, axis=1).astype(np.float32), idf, reject)


def songs_once(songs: DataFrame, labels: DataFrame, spellings: dict[str, str] = SPELLINGS) -> DataFrame:
    """(idx, lyrics, label): one row for each idx with lyrics; label is a language code or null."""
    usable = songs.filter(F.col("idx").isNotNull() & longer_than(F.col("lyrics"), MIN_CHARS))
    codes = labels.select("idx", language_code(F.col("lang"), spellings).alias("label")).groupBy("idx").agg(F.min("label").alias("label"))
    return usable.groupBy("idx").agg(F.min("lyrics").alias("lyrics")).join(codes, "idx", "left")


def fit(songs: DataFrame, labels: DataFrame, songs_per_language: int = SONGS_PER_LANGUAGE, clusters: int = CLUSTERS, spellings: dict[str, str] = SPELLINGS) -> Model | None:
    """The model from at most songs_per_language labelled songs of each language that the labels name; spellings says how they may be written."""
    order = Window.partitionBy("label").orderBy(F.xxhash64("idx"), "idx")
    labelled = labels.select("idx", language_code(F.col("lang"), spellings).alias("label")).filter("idx IS NOT NULL AND label IS NOT NULL").distinct()
    chosen = labelled.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= songs_per_language)
    sample = songs.select("idx", "lyrics").join(F.broadcast(chosen), "idx").select("label", "lyrics").distinct()
    return train(sorted((r["label"], r["lyrics"] or "") for r in sample.collect()), clusters)


def settle(verdicts: list[tuple[int, float]], counts: list[int], at: int, blocks: list[int]) -> None:
    """Give each unsure line of one song, its stanzas' lines from `at` on, the language of the sure words around it."""

    def sure(start: int, end: int) -> int | None:
        words: dict[int, int] = {}
        for (language, confidence), n in zip(verdicts[start:end], counts[start:end]):
            if n and language >= 0 and confidence >= UNSURE:
                words[language] = words.get(language, 0) + n
        return max(words, key=lambda k: (words[k], -k)) if words else None

    around, changes = sure(at, at + sum(blocks)), {}
    for size in blocks:
        near = sure(at, at + size)
        for k in range(at, at + size):
            language, confidence = verdicts[k]
            follow = near if near is not None else around
            if language >= 0 and confidence < UNSURE and follow is not None:
                changes[k] = (follow, confidence)
        at += size
    for k, verdict in changes.items():
        verdicts[k] = verdict


STANZAS = "idx bigint, stanza bigint, lang string, confidence double, words bigint, label string, song_lang string, song_confidence double, languages int"


def stanza_languages(songs: DataFrame, labels: DataFrame, model: Model | None = None, spellings: dict[str, str] = SPELLINGS) -> DataFrame:
    """One row per stanza with its language, its confidence and its song's label, language, confidence and number of languages."""
    spark = songs.sparkSession
    model = model or fit(songs, labels, spellings=spellings)
    if model is None:
        return spark.createDataFrame([], STANZAS)
    shared = spark.sparkContext.broadcast(model)

    def vote(ballots: list[tuple[int, float, int]]) -> tuple[str | None, float]:
        """The language of most words, ties to the surer one; the confidence is its share of the words times their mean confidence."""
        words, sure = {}, {}
        for language, confidence, n in ballots:
            if language >= 0:
                words[language] = words.get(language, 0) + n
                sure[language] = sure.get(language, 0) + n * confidence
        if not words:
            return None, 0.0
        best = max(words, key=lambda k: (words[k], sure[k], -k))
        return shared.value.languages[best], round(sure[best] / max(1, sum(n for _, _, n in ballots)), 6)

    def segments(batches):
        for batch in batches:
            lines, spans = [], []
            for text in batch["lyrics"]:
                blocks = stanzas_of(text)
                spans.append([len(b) for b in blocks])
                lines += [x for b in blocks for x in b]
            judged = shared.value.judge([x.lower() for x in lines])
            verdicts, counts = [(k, c) for k, c, _ in judged], [n for _, _, n in judged]
            rows, at = [], 0
            for idx, label, blocks in zip(batch["idx"], batch["label"], spans):
                mine, ballots = [], []
                settle(verdicts, counts, at, blocks)
                for number, size in enumerate(blocks, 1):
                    block = [(k, c, n) for (k, c), n in zip(verdicts[at : at + size], counts[at : at + size]) if n]
                    at += size
                    if block:
                        mine.append((number, *vote(block), sum(n for _, _, n in block)))
                        ballots += block
                own, sure = vote(ballots)
                kinds = len({m[1] for m in mine if m[1]})
                rows += [(idx, number, lang, confidence, words, label, own, sure, kinds) for number, lang, confidence, words in mine]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STANZAS.split(", ")])

    return songs_once(songs, labels, spellings).mapInPandas(segments, STANZAS)


def relabelled(stanzas: DataFrame) -> DataFrame:
    """The stanzas of songs without a usable label, with a label other than their own language, or of several languages."""
    return stanzas.filter("lang IS NOT NULL AND (label IS NULL OR label <> song_lang OR languages > 1)")
