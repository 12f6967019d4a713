import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeworks.llm import pagespam

SUBJECTS = "the owner|a neighbour|my sister|the old baker|one singer|the tall guard|his friend|the new tenant".split("|")
VERBS = "opened|carried|found|sold|painted|forgot|repaired|borrowed".split("|")
OBJECTS = "a blue window|the wooden chair|an empty box|that heavy door|some old records|the garden lamp|a broken radio|two small keys".split("|")
TAILS = "in the morning|before the rain|after a long trip|near the river|with great care|for no reason|during the winter|on the way home".split("|")


def prose(rng, n):
    return " ".join(f"{rng.choice(SUBJECTS).capitalize()} {rng.choice(VERBS)} {rng.choice(OBJECTS)} of {''.join(rng.choice(list('abdeilnorst'), 8))} {rng.choice(TAILS)} {''.join(rng.choice(list('abdeilnorst'), 7))}." for _ in range(n))


KEYWORDS = ["cheap flats", "free ringtones", "best guitar chords", "moving boxes online"]


def stuffed(rng, n):
    k = lambda: str(rng.choice(KEYWORDS))
    return " ".join(f"If you want {k()} or {k()}, our {k()} is the {k()} you need." for _ in range(n))


def pages():
    rng = np.random.default_rng(1)
    rows = [(i, prose(rng, 2 + i % 12)) for i in range(160)]
    spam = {
        200: prose(rng, 1) + "\n" + stuffed(rng, 14),
        201: prose(rng, 1) + "\n" + " ".join(f'<a href="http://w{i}.example/?q=x">cheap flats</a>,' for i in range(20)),
        202: "\n".join(f"https://w{i}.example/cheap-flats" for i in range(20)),
        203: prose(rng, 1) + "\n" + " ".join(f"#{rng.choice(['flats', 'rent', 'music', 'cheap'])}" for _ in range(60)),
        204: ", ".join(f"Delinte blue cod. C{rng.integers(1000, 9999)} new" for i in range(25)),
        205: "\n".join("Tag: " + "/".join(rng.choice(KEYWORDS, 4)) for _ in range(15)),
        206: " • ".join(rng.choice(KEYWORDS, 60)),
        207: "\n".join(str(x) for x in rng.choice(["cheap flats", "free ringtones", "flats rome", "cheap rent now", "best chords"], 40)),
    }
    verse = "\n".join(f"we were {rng.choice(VERBS)} {rng.choice(OBJECTS)} {rng.choice(TAILS)}" for _ in range(4))
    fine = {
        300: "\n\n".join(["[Chorus]\n" + verse] * 6),
        301: "\n".join(f"{i}. {rng.choice(OBJECTS)} {i % 7}:{10 + i}" for i in range(1, 20)),
        302: prose(rng, 8) + "\n\nSources:\nhttps://one.example/page\nhttps://two.example/page",
        303: prose(rng, 4) + "\n#music #flats #live",
        304: "tiny",
        305: "",
        306: None,
        307: "   \n \n",
    }
    return rows, spam, fine


def test_pages(spark):
    rows, spam, fine = pages()
    data = [(i, t, "en" if i % 9 else None, 1) for i, t in [*rows, *spam.items(), *fine.items()]]
    data += [(None, spam[202], "en", 1), (202, spam[202], "en", 1)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, block int")
    got = [r["doc_id"] for r in pagespam.spam_pages(df).collect()]
    assert len(got) == len(set(got)) and set(got) == set(spam)


def test_shapes():
    assert pagespam.shape("see www.example.org/page - https://other.example/x") == pagespam.LINKS
    assert pagespam.shape("#one #two #three") == pagespam.TAGS
    assert pagespam.shape("12) Some title 3:45") == pagespam.TRACKS
    assert pagespam.shape("Delinte blue cod. C3460 new") == pagespam.CODES
    assert pagespam.shape("Tag: cheap flats/rent now") == pagespam.LIST
    assert pagespam.shape("just a heading") == pagespam.SHORT
    assert pagespam.shape("The house, the garden, the street and the sea were all there.") == pagespam.PROSE
    assert pagespam.shape("The - line - meant - for - someone - one - winter") != pagespam.LIST


def test_blocks_drop_refrains_from_the_curve():
    (kind, chars, _, terms),  = pagespam.blocks_of("la notte è lunga\nla notte è lunga\nsenza di te non so")
    assert kind == pagespam.SHORT and chars == 50 and terms.count("notte") == 1


def test_a_term_counts_once_for_each_word_before_it():
    (_, _, _, terms),  = pagespam.blocks_of("Does anyone know whether Melor was released? Does anyone know whether Macre was released?")
    assert terms.count("know") == 1 and terms.count("does") == 2 and terms.count("was") == 2 and terms.count("released") == 1
    (kind, _, _, terms),  = pagespam.blocks_of("https://one.example/a\nhttps://one.example/a\nhttps://one.example/a")
    assert kind == pagespam.LINKS and terms.count("example") == 3
    (kind, _, _, _),  = pagespam.blocks_of("we were waiting here all night long\nand no one came to see us\n" * 2 + "only the rain")
    assert kind == pagespam.VERSE


def test_short_stuffed_sentences_and_stock_ones(spark):
    rows, _, _ = pages()
    stuffed_ones = {
        500: "If you are looking for deals sheet music and music streaming luxury, our deals sheet music is the today moving boxes you need. This is the place for near me music streaming, for deals sheet music and for more best loft. Why near me music streaming? Because deals mp3 and deals sheet music make the best loft of your dreams.",
    }
    stock = {501: "Does anyone know whether Timiminto can still be found? Many thanks. Does anyone know whether Forterselstro can still be found? Many thanks. Does anyone know whether Neltusia came out on vinyl? Many thanks."}
    df = spark.createDataFrame([(i, t, "en") for i, t in [*rows, *stuffed_ones.items(), *stock.items()]], "doc_id bigint, text string, lang string")
    assert {r["doc_id"] for r in pagespam.spam_pages(df).collect()} == {500}


def test_empty_and_one_page(spark):
    schema = "doc_id bigint, text string, lang string"
    assert pagespam.spam_pages(spark.createDataFrame([], schema)).collect() == []
    one = spark.createDataFrame([(1, "\n".join(f"https://w{i}.example/a" for i in range(30)), None)], schema)
    assert [r[0] for r in pagespam.spam_pages(one).collect()] == [1]


@given(st.text(st.characters(exclude_categories=["Cn", "Cs"]), max_size=80))
@settings(max_examples=500, deadline=None)
def test_both_patterns_find_the_same_terms(text):
    assert pagespam.terms_of(text) == regex.findall(r"[\p{L}\p{M}\p{N}]+", text)


def test_sums_of_logarithms(spark):
    df = spark.range(0, 3000).select("id", *(pagespam.log_sum(F.col("id"), p).alias(f"s{p}") for p in (1, 2)))
    rows = df.orderBy("id").collect()
    for p in (1, 2):
        want = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 3000)) ** p)])
        assert np.allclose([r[f"s{p}"] for r in rows], want, rtol=1e-9, atol=1e-6)


def test_residual_of_the_fit(spark):
    text = "one a one b one c one d two e two f two g h i j k l m, one."
    blocks = pagespam.page_blocks(spark.createDataFrame([(1, text, "en"), (2, "a b c d e f g h i j.", "en")], "doc_id bigint, text string, lang string"))
    rows = pagespam.curves(blocks, {}).orderBy("block").collect()
    got = [r["residual"] for r in rows]
    y = np.log([5, 3] + [1] * 13)
    x = np.log(np.arange(1, 16))
    assert np.isclose(got[0], np.sqrt(np.mean((y - np.polyval(np.polyfit(x, y, 1), x)) ** 2))) and np.isclose(got[1], 0)
    assert np.isclose(rows[0]["slope"], np.polyfit(x, y, 1)[0]) and np.isclose(rows[0]["level"], y.mean()) and rows[0]["tail"] == 13 / 21 and rows[0]["top"] == 5


def test_few_lines_repeated_throughout(spark):
    rng = np.random.default_rng(2)
    rows, _, fine = pages()
    spam = {
        400: prose(rng, 1) + "\n" + "\n".join(str(x) for x in rng.choice(["cheap flats", "free ringtones", "moving boxes"], 300)),
        401: "\n".join(["cheap flats rome free ringtones best guitar chords"] * 60),
        402: "\n".join(["cheap flats rome free ringtones", "best guitar chords moving boxes"] * 60),
    }
    sung = {
        403: "\n".join(["we were waiting for the rain"] * 40 + ["and you never came"] * 8),
        404: "\n".join(["la notte è lunga", "senza di te non so che fare"] * 30),
        405: "\n".join(["cheap flats", "free ringtones"] * 2) + "\n" + prose(rng, 6),
    }
    df = spark.createDataFrame([(i, t, "en") for i, t in [*rows, *fine.items(), *spam.items(), *sung.items()]], "doc_id bigint, text string, lang string")
    assert {r["doc_id"] for r in pagespam.spam_pages(df).collect()} == set(spam)
