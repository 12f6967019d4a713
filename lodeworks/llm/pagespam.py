"""Pages of repeated keywords, link lists and product tags.

A page is cut into blocks, runs of lines of one shape: links, tags, product
codes, delimited lists, numbered tracks, short lines, sentences. For each block
SQL windows rank its terms by frequency and fit the rank-frequency curve: the
slope of ln f over ln rank, the curve's level (the mean ln f of the ranks), its
tail (the share of terms that occur once) and the fit's residual (the root of
its mean square). The block's divergence is that of its terms from the prose
of the language it is nearest to, over that language's COMMON terms of most
blocks and one class for all others; its excess is what repeats beyond that
prose. These measures are held against sentence blocks of the same language
and comparable length (powers of two). How far off a block must lie depends on
its shape, and a page is found if such blocks cover more than half of its
characters.

In sentences and verse a term counts once in its block's curve for each
different word before it (in short lines: within a line, equal lines once), so refrains and stock sentences, which bring the same words in the
same order, do not look like keywords, which recur in ever new places. Verse,
long lines without sentence marks, must lie much farther off. Few lines without
function words that make up a block by recurring over and over are spam
whatever their curve. Numbered tracks with durations never are.

Defined results: null and empty texts are no pages; rows
with a null id are left out; rows that share an id are pages of their own, and
the id is found if one of them is; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.words import ENGLISH, ITALIAN
from lodeworks.llm.langid import language_code
from lodeworks.session import materialize, release

COMMON = 400
#: Spreads off prose that are extreme, those of any measure that put a list outside of it (85 % of sentence blocks lie
#: within), and those of the level that sentences and verse need.
EXTREME, LISTED, SENTENCES, VERSES = 3.0, 2.0, 2.5, 6.0
#: The part of prose's tail (the share of terms that occur once) below which sentences and verse are repeated keywords,
#: and the share of a block's terms in excess of prose and the frequency of its first term that sentences need as well.
TAIL_PART, VERSE_TAIL_PART, EXCESS, TOP = 0.72, 0.5, 0.19, 3
#: A sentence block this clearly below prose's tail needs no more proof than an extreme level.
CLEAR_TAIL_PART = 0.55
#: Occurrences of a common term, as a multiple of those that prose of the language has, that are no excess.
USUAL = 4
#: Sentence blocks that a language needs at a length to be its own standard.
LEAST_BLOCKS = 30
MEASURES = ("slope", "level", "tail", "residual", "divergence")
#: Blocks of fewer terms have no curve.
LEAST_TERMS = 8
#: Lines of a block for each distinct one from which lines without function words are repeated keywords; refrains stay below.
REPEATS = 8
SHARE = 0.5

_BREAK = re.compile(r"\r\n|\r|\n")
_TERM, _MARK = regex.compile(r"[\p{L}\p{M}\p{N}]+"), regex.compile(r"\p{M}")
_PLAIN_TERM = re.compile(r"[^\W_]+")  # the same in text without marks, for characters that both libraries know, and faster
_LINK = re.compile(r"<a\b[^>]*>.*?</a>|!?\[[^\]]*\]\([^)\s]*\)|(?:https?://|www\.)[^\s<>\"]+|\b(?:[\w-]+\.)+[a-z]{2,}/[^\s<>\"]*", re.I | re.S)
_TAG = re.compile(r"(?<!\w)#\w+")
_CODE = re.compile(r"\b(?:cod|art|sku|ref|mod|item|code)\b\.? ?[a-z]{0,3}\d{2,}", re.I)
_DIGITS = re.compile(r"\d\d")
_TRACK = re.compile(r"^\W*\d{1,3}\s*[.)\-]?\s+.*\d{1,2}:\d\d\W*$")
_SENTENCE = re.compile(r"[.!?…](?:[\"')\]]*\s|[\"')\]]*$)")
_LABEL = re.compile(r"^\w[\w ]{0,20}: ")
#: What separates the entries of a list, and the entries it takes to be one.
_DELIMITERS = ((" • ", 3), (" · ", 3), (" | ", 3), (" - ", 3), (";", 3), (">", 3), ("/", 3), (", ", 4))

LINKS, TAGS, CODES, LIST, TRACKS, SHORT, PROSE, VERSE, REPEATED = "links", "tags", "codes", "list", "tracks", "short", "prose", "verse", "repeated"
_LISTED = (LINKS, TAGS, CODES, LIST)
#: Lines without a sentence mark that make a block of long lines verse.
VERSE_LINES = 3
_FUNCTION = frozenset(ENGLISH) | frozenset(ITALIAN)


def shape(line: str, sentence: bool | None = None) -> str:
    """The shape of one line without white space at its ends; sentence says whether it holds a sentence mark, if that is known."""
    if "/" in line or "www." in line or "](" in line:
        if sum(len(m.group()) for m in _LINK.finditer(line)) >= 0.4 * len(line):
            return LINKS
    tags = _TAG.findall(line) if "#" in line else []
    if tags and sum(map(len, tags)) >= 0.5 * len(line):
        return TAGS
    if ":" in line and _TRACK.match(line):
        return TRACKS
    words, codes = line.count(" ") + 1, len(_CODE.findall(line)) if _DIGITS.search(line) else 0
    if codes and words <= 10 * codes:
        return CODES
    if not (_SENTENCE.search(line) if sentence is None else sentence):
        label = _LABEL.match(line)
        listed = line[label.end() :] if label else line
        for delimiter, least in _DELIMITERS:
            entries = listed.count(delimiter) + 1
            if entries >= (2 if label else least):
                words = len(listed.replace(delimiter, " ").split())
                if 1.3 * entries <= words <= (4 if delimiter == ", " else 5) * entries:
                    return LIST
        if line.count(" ") < 6:
            return SHORT
    return PROSE


def keywords_repeated(lines: list[str]) -> bool:
    """Whether lines without a sentence mark recur REPEATS times on average and most distinct ones hold no function word, as refrains do."""
    distinct = set(lines)
    if len(lines) < REPEATS * len(distinct) or any(_SENTENCE.search(x) for x in distinct):
        return False
    return 2 * sum(_FUNCTION.isdisjoint(_TERM.findall(x)) for x in distinct) > len(distinct)


def terms_of(text: str) -> list[str]:
    """The runs of letters, marks and digits."""
    return (_TERM if _MARK.search(text) else _PLAIN_TERM).findall(text)


def _placed(text: str) -> list[str]:
    """The terms, each once for every different term before it."""
    terms = terms_of(text)
    return [b for _, b in dict.fromkeys(zip(["", *terms], terms))]


def blocks_of(text: str | None) -> list[tuple[str, int, float, list[str]]]:
    """(shape, characters, mean words a line, terms) of each block of a page; in sentences a term counts once for each different word before it."""
    runs: list[tuple[str, list[str], list[bool]]] = []
    for line in _BREAK.split(text or ""):
        if line := line.strip():
            mark = _SENTENCE.search(line) is not None
            kind = shape(line, mark)
            last = runs[-1] if runs else None
            plain = kind in (SHORT, PROSE)
            if last and plain and not (kind == PROSE and mark) and last[0] in (SHORT, PROSE) and not last[2][-1]:  # short and long lines in turn
                last[1].append(line)
                last[2].append(mark)
                if kind == PROSE != last[0]:
                    runs[-1] = (PROSE, last[1], last[2])
            elif last and last[0] == kind and not plain:
                last[1].append(line)
                last[2].append(mark)
            else:
                runs.append((kind, [line], [mark]))
    out = []
    for kind, lines, marks in runs:
        lower = [x.lower() for x in lines]
        if kind in (SHORT, PROSE) and keywords_repeated(lower):
            kind = REPEATED
        elif kind == PROSE and len(lines) >= VERSE_LINES and sum(marks) <= 0.2 * len(lines):
            kind = VERSE
        if kind in _LISTED:
            terms = terms_of("\n".join(lower))
        elif kind == SHORT:  # entries are what recurs in a list of keywords, so only equal lines count once
            terms = [b for x in dict.fromkeys(lower) for b in _placed(x)]
        else:
            terms = _placed("\n".join(lower))
        out.append((kind, sum(map(len, lines)), sum(x.count(" ") + 1 for x in lines) / len(lines), terms))
    return out


_BLOCKS = "page bigint, doc_id bigint, shape string, chars bigint, page_chars bigint, line_words double, lang string, terms array<string>, freqs array<int>, steps array<int>, widths array<int>, n int"


def page_blocks(documents: DataFrame) -> DataFrame:
    """One row per block with its terms and their frequencies, and the steps of its curve: each frequency and how many terms have it.

    page numbers the rows of documents, block the rows of the result.
    """
    names = [c.split()[0] for c in _BLOCKS.split(", ")]

    def cut(batches):
        for batch in batches:
            rows, terms, freqs, ends, steps, widths, ends_of_steps = [], [], [], [0], [], [], [0]
            for page, doc, lang, text in zip(*(batch.column(c).to_pylist() for c in ("page", "doc_id", "lang", "text"))):
                found = blocks_of(text)
                total = sum(b[1] for b in found)
                for kind, chars, words, mine in found:
                    rows.append((page, doc, kind, chars, total, words, lang, len(mine)))
                    if len(mine) >= LEAST_TERMS:  # shorter ones have no curve
                        counts = Counter(mine)
                        terms += counts
                        freqs += counts.values()
                        equal = Counter(counts.values())
                        steps += equal
                        widths += equal.values()
                    ends.append(len(terms))
                    ends_of_steps.append(len(steps))
            plain = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int32()))]
            offsets, few = pa.array(ends, pa.int32()), pa.array(ends_of_steps, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(terms, pa.string())), *(pa.ListArray.from_arrays(o, pa.array(x, pa.int32())) for o, x in ((offsets, freqs), (few, steps), (few, widths)))]
            yield pa.RecordBatch.from_arrays([*plain[:7], *lists, plain[7]], names=names)

    pages = documents.filter("doc_id IS NOT NULL AND length(text) > 0")
    numbered = pages.select(F.monotonically_increasing_id().alias("page"), "doc_id", language_code(F.col("lang")).alias("lang"), "text")
    return numbered.mapInArrow(cut, _BLOCKS).withColumn("block", F.monotonically_increasing_id())


def prose_terms(blocks: DataFrame, common: int = COMMON) -> dict[str, list[tuple[str, float]]]:
    """Of each language the `common` terms in most prose blocks with their share of all such occurrences."""
    prose = blocks.filter(F.col("shape").isin(PROSE, VERSE) & F.col("lang").isNotNull() & (F.col("n") >= LEAST_TERMS))
    counts = prose.select("lang", F.explode("terms").alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("blocks"))
    counts = materialize(counts, "prose-terms")
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("blocks").alias("total")).collect()}  # one row a language
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("blocks"), "term"))  # cut to `common` a task before the shuffle
    top: dict[str, list[tuple[str, float]]] = {language: [] for language in sorted(totals)}
    for r in counts.withColumn("place", place).filter(F.col("place") <= common).orderBy("lang", "place").collect():
        top[r["lang"]].append((r["term"], r["blocks"] / totals[r["lang"]]))
    release(counts)
    return top


#: Sums of the logarithms of 1 to n and of their squares, for small n; beyond by the Euler-Maclaurin formula.
_SUMS = {p: np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 65)) ** p)]) for p in (1, 2)}


def _beyond(n, p: int, log):
    """The formula without its constant, for numbers or columns."""
    x = log(n)
    return n * x - n + x / 2 + 1 / (12 * n) if p == 1 else n * (x * x - 2 * x + 2) + x * x / 2 + x / (6 * n)


def log_sum(n: Column, p: int) -> Column:
    """The sum over j from 1 to n of the natural logarithm of j to the power of p, 1 or 2."""
    large = F.greatest(n, F.lit(64)).cast("double")
    constant = float(_SUMS[p][64] - _beyond(64.0, p, np.log))
    return F.when(n <= 64, F.array(*(F.lit(float(v)) for v in _SUMS[p]))[F.least(n, F.lit(64)).cast("int")]).otherwise(_beyond(large, p, F.log) + constant)


def curves(blocks: DataFrame, reference: dict[str, list[tuple[str, float]]]) -> DataFrame:
    """(block, slope, level, tail, residual, top, divergence, excess, near): the curve of each block of LEAST_TERMS terms or more.

    excess is the share of the block's terms that repeat others beyond what
    prose of the nearest language has of them.
    """
    languages = sorted(reference)
    spark = blocks.sparkSession
    shares: dict[str, list[float | None]] = {}
    for k, language in enumerate(languages):
        for term, q in reference[language]:
            shares.setdefault(term, [None] * len(languages))[k] = q
    known = spark.createDataFrame(list(shares.items()), "term string, q array<double>")  # at most COMMON rows a language
    curved = blocks.filter(F.col("n") >= LEAST_TERMS)
    # the curve needs its steps alone: terms of equal frequency hold consecutive ranks, whose logarithms are summed at once
    steps = curved.select("block", F.explode(F.arrays_zip("steps", "widths")).alias("t")).select("block", F.col("t.steps").alias("f"), F.col("t.widths").alias("m"))
    higher = F.sum("m").over(Window.partitionBy("block").orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1))
    ranked = steps.withColumn("above", F.coalesce(higher, F.lit(0)))
    first, last, y = F.col("above"), F.col("above") + F.col("m"), F.log(F.col("f").cast("double"))
    x, xx = (log_sum(last, power) - log_sum(first, power) for power in (1, 2))
    once = F.sum(F.when(F.col("f") == 1, F.col("m")).otherwise(0))
    total = ranked.groupBy("block").agg(
        F.sum("m").alias("terms"), F.sum(F.col("m") * F.col("f")).alias("all"), F.max("f").alias("top"), once.alias("once"),
        F.sum(x).alias("x"), F.sum(xx).alias("xx"), F.sum(F.col("m") * y).alias("y"), F.sum(F.col("m") * y * y).alias("yy"), F.sum(x * y).alias("xy"),
    )
    k = F.col("terms")
    vx, vy, cov = (F.expr(f"{a}{b} - {a} * {b} / terms") for a, b in ("xx", "yy", "xy"))
    slope = F.when(k > 1, cov / vx).otherwise(0.0)
    off_line = F.sqrt(F.greatest(vy - slope * cov, F.lit(0.0)) / k)
    fits = total.select("block", slope.alias("slope"), off_line.alias("residual"), (F.col("y") / k).alias("level"), (F.col("once") / F.col("all")).alias("tail"), "top", (1 - k / F.col("all")).alias("repeats"))
    # a block's terms lie in one task, so its divergence sums are whole before their shuffle
    met = curved.select("block", "n", F.explode(F.arrays_zip("terms", "freqs")).alias("t")).select("block", "n", F.col("t.freqs").alias("f"), (F.col("t.freqs") / F.col("n")).alias("p"), F.col("t.terms").alias("term")).join(F.broadcast(known), "term")
    sums = []
    for k in range(len(languages)):
        q = F.col("q")[k]
        sums += [F.sum(F.when(q.isNotNull(), F.col("p") * F.log(F.col("p") / q)).otherwise(0.0)).alias(f"d{k}"), F.sum(F.when(q.isNotNull(), F.col("p")).otherwise(0.0)).alias(f"s{k}"), F.sum(F.when(q.isNotNull(), F.least((F.col("f") - 1) / F.col("n"), USUAL * q)).otherwise(0.0)).alias(f"e{k}")]
    joined = fits.join(met.groupBy("block").agg(*sums), "block", "left") if sums else fits
    options = []
    for k, language in enumerate(languages):
        other = F.greatest(1 - F.coalesce(f"s{k}", F.lit(0.0)), F.lit(1e-9))
        rest = max(1e-3, 1 - sum(q for _, q in reference[language]))
        options.append(F.struct((F.coalesce(f"d{k}", F.lit(0.0)) + other * F.log(other / rest)).alias("divergence"), F.lit(language).alias("near"), (F.col("repeats") - F.coalesce(f"e{k}", F.lit(0.0))).alias("excess")))
    best = F.array_min(F.array(*options)) if options else F.struct(F.lit(0.0).alias("divergence"), F.lit(None).cast("string").alias("near"), F.col("repeats").alias("excess"))
    return joined.withColumn("best", best).select("block", "slope", "level", "tail", "residual", "top", "best.divergence", "best.excess", "best.near")


def _middles(prose: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles of the measures and the number of blocks of each group; a row a language and power of two."""
    return prose.groupBy(*by).agg(F.count(F.lit(1)).alias("blocks"), *(F.percentile_approx(m, [0.25, 0.5, 0.75], 1000).alias(f"{m}_q") for m in MEASURES))


def judged(blocks: DataFrame, fits: DataFrame) -> DataFrame:
    """Blocks with, for each measure, how many spreads they lie off the prose of their language and length, and the tail as a part of that prose's.

    Prose is the sentence blocks whose tail is not already far below that of
    all sentence blocks of the length, so spam does not set the standard. A
    language with fewer than LEAST_BLOCKS at a length is held against all
    languages; a length beyond all prose against the longest there is. Without
    any prose the standard is a text that repeats no term.
    """
    full = blocks.drop("terms", "freqs", "steps", "widths").join(fits, "block", "left").withColumn("bin", F.floor(F.log2(F.greatest("n", F.lit(1)))).cast("int"))
    full = materialize(full, "page-fits")
    sentences = full.filter(F.col("shape").isin(PROSE, VERSE) & F.col("level").isNotNull())
    first = sentences.groupBy("bin").agg(F.percentile_approx("tail", 0.5, 1000).alias("usual"))
    prose = materialize(sentences.join(F.broadcast(first), "bin").filter(F.col("tail") > VERSE_TAIL_PART * F.col("usual")).select("near", "bin", *MEASURES), "page-prose")
    longest = prose.agg(F.max("bin").alias("b")).first()["b"]
    keyed = full.withColumn("bin", F.least("bin", F.lit(longest)))
    own = _middles(prose, ["near", "bin"]).filter(F.col("blocks") >= LEAST_BLOCKS)
    every = _middles(prose, ["bin"])
    off = keyed.join(F.broadcast(own), ["near", "bin"], "left").join(F.broadcast(every.select("bin", *(F.col(f"{m}_q").alias(f"{m}_all") for m in MEASURES))), "bin", "left")
    for m in MEASURES:
        q = F.coalesce(f"{m}_q", f"{m}_all", F.array(F.lit(1.0 if m == "tail" else 0.0)))
        low, middle, high = (F.coalesce(F.try_element_at(q, F.lit(k)), q[0]) for k in (1, 2, 3))
        off = off.withColumn(f"{m}_off", (F.col(m) - middle) / (F.greatest(high - low, F.lit(0.05)) / 1.349))
        if m == "tail":
            off = off.withColumn("tail_part", F.col("tail") / F.greatest(middle, F.lit(1e-9)))
    widest = F.greatest(*(F.abs(f"{m}_off") for m in MEASURES))
    return off.drop(*(f"{m}_{k}" for m in MEASURES for k in ("q", "all")), "blocks").withColumn("widest", widest)


def spam_block() -> Column:
    """Whether a block is spam: off the curves of prose as far as its kind must be.

    Links, tags, codes, lists and short entries line by line are spam if any
    measure is LISTED spreads off. Sentences need a level SENTENCES spreads above prose
    and a tail below TAIL_PART of its, and either a clear tail or terms in
    EXCESS of prose of which one occurs TOP times; verse, whose refrains raise
    its curve, needs VERSES spreads and VERSE_TAIL_PART. Repeated keyword lines
    are spam by their repetition, however few terms they leave. Blocks of
    fewer than LEAST_TERMS terms have no curve and are none.
    """
    shape, outside = F.col("shape"), F.col("widest") > LISTED
    entries = (shape == SHORT) & (F.col("line_words") <= 4.5)
    proof = ((F.col("level_off") > EXTREME) & (F.col("tail_part") < CLEAR_TAIL_PART)) | (F.col("excess") > EXCESS) & (F.col("top") >= TOP)
    sentences = (shape == PROSE) & (F.col("level_off") > SENTENCES) & (F.col("tail_part") < TAIL_PART) & proof
    verse = (shape == VERSE) & (F.col("level_off") > VERSES) & (F.col("tail_part") < VERSE_TAIL_PART)
    return F.coalesce((shape.isin(*_LISTED) | entries) & outside, F.lit(False)) | F.coalesce(sentences | verse, F.lit(False)) | (shape == REPEATED)


def page_scores(documents: DataFrame) -> DataFrame:
    """(doc_id, spam_share, slope_off, level_off, tail_off, residual_off, divergence_off) of each page: the share of its characters in spam blocks, and its blocks' widest distances from prose."""
    blocks = materialize(page_blocks(documents), "page-blocks")
    marked = judged(blocks, curves(blocks, prose_terms(blocks)))
    release(blocks)
    spam = F.sum(F.when(spam_block(), F.col("chars")).otherwise(F.lit(0)))
    widest = [F.max(F.abs(f"{m}_off")).alias(f"{m}_off") for m in MEASURES]
    return marked.groupBy("page", "doc_id").agg((spam / F.max("page_chars")).alias("spam_share"), *widest).drop("page")


def spam_pages(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id) of the pages whose spam blocks cover more than `share` of their characters."""
    return page_scores(documents).filter(F.col("spam_share") > share).select("doc_id").distinct()
