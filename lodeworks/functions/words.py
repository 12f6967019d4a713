"""Stop words and the Italian stemmer."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common Italian function words.
ITALIAN = """a ad agli ai al alla alle allo anche avere aveva c che chi ci coi col come con cui da dagli dai dal dalla dalle
dallo degli dei del dell della delle dello di dove e ed era erano essere fra gli ha hai hanno ho i il in io l la le lei li lo
loro lui ma me mi mia mie miei mio ne negli nei nel nell nella nelle nello noi non nostra nostro o per perché più quale quando
quanto quella quelle quelli quello questa queste questi questo se sei si sia siamo sono sta su sua sue sugli sui sul sull sulla
sulle sullo suo suoi tra tu tua tue tuo tuoi tutti tutto un una uno vi voi""".split()

#: Common English function words.
ENGLISH = """a about after all am an and any are as at be been before but by can could did do does down for from had has have
he her here him his how i if in into is it its just me more my no not now of off on one only or our out over said she so some
than that the their them then there these they this those through to too under until up us was we were what when where which
while who whom why will with would you your""".split()


def without(tokens: Column, stop: list[str]) -> Column:
    """The tokens that are no stop words, repeats kept."""
    listed = F.array(*map(F.lit, stop))
    return F.filter(tokens, lambda w: ~F.array_contains(listed, w))


_VOWELS = "aeiouàèìòù"
#: Fixed values of the published Snowball description of Italian: pronouns, suffixes by step.
_PRONOUNS = ("gliela glielo gliele glieli gliene sene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene gli ci la le li lo mi ne si ti vi").split()
_DELETE = ("anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti").split()
_AZIONE = ("azione azioni atore atori").split()
_LOGIA, _UZIONE, _ENZA = ("logia logie").split(), ("uzione uzioni usione usioni").split(), ("enza enze").split()
_MENTO = ("amento amenti imento imenti").split()
_IVO = ("ivo ivi iva ive").split()
_VERB = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere "
    "erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire "
    "irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate "
    "ivi ivo ono uta ute uti uto ar ir"
).split()


def _regions(w: str) -> tuple[int, int, int]:
    """Starts of the regions RV, R1 and R2."""

    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
                return i + 1
        return len(w)

    r1 = after(0)
    r2 = after(r1) if r1 < len(w) else len(w)
    rv = len(w)
    if len(w) > 3:
        if w[1] not in _VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in _VOWELS), len(w))
        elif w[0] in _VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in _VOWELS), len(w))
        else:
            rv = 3
    return rv, r1, r2


def _longest(w: str, suffixes: list[str]) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem_italian(word: str) -> str:
    """The Snowball stem of a lower-case Italian word."""
    w = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    w = "".join(c.upper() if c in "ui" and 0 < i < len(w) - 1 and w[i - 1] in _VOWELS and w[i + 1] in _VOWELS else c for i, c in enumerate(w))
    rv, r1, r2 = _regions(w)

    def within(suffix: str, region: int) -> bool:
        return len(w) - len(suffix) >= region

    pronoun = _longest(w, _PRONOUNS)
    if pronoun:
        head = w[: -len(pronoun)]
        if len(head) >= rv and head.endswith(("ando", "endo")) and len(head) - 4 >= rv:
            w = head
        elif head.endswith(("ar", "er", "ir")) and len(head) - 2 >= rv:
            w = head + "e"
    before = w
    suffix = _longest(w, [*_DELETE, *_AZIONE, *_LOGIA, *_UZIONE, *_ENZA, *_MENTO, *_IVO, "amente", "ità"])
    if suffix == "amente" and within(suffix, r1):
        w = w[:-6]
        if w.endswith("iv") and len(w) - 2 >= r2:
            w = w[:-2]
            if w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
        elif w.endswith(("os", "ic")) and len(w) - 2 >= r2:
            w = w[:-2]
        elif w.endswith("abil") and len(w) - 4 >= r2:
            w = w[:-4]
    elif suffix in _MENTO and within(suffix, rv):
        w = w[: -len(suffix)]
    elif suffix and suffix not in ("amente", *_MENTO) and within(suffix, r2):
        w = w[: -len(suffix)]
        if suffix in _AZIONE and w.endswith("ic") and len(w) - 2 >= r2:
            w = w[:-2]
        elif suffix in _LOGIA:
            w += "log"
        elif suffix in _UZIONE:
            w += "u"
        elif suffix in _ENZA:
            w += "ente"
        elif suffix == "ità":
            ending = next((e for e in ("abil", "ic", "iv") if w.endswith(e) and len(w) - len(e) >= r2), None)
            if ending:
                w = w[: -len(ending)]
        elif suffix in _IVO and w.endswith("at") and len(w) - 2 >= r2:
            w = w[:-2]
            if w.endswith("ic") and len(w) - 2 >= r2:
                w = w[:-2]
    if w == before:
        verb = _longest(w, [s for s in _VERB if len(w) - len(s) >= rv])
        if verb:
            w = w[: -len(verb)]
    if w and w[-1] in "aeioàèìò" and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith("i") and len(w) - 1 >= rv:
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) - 1 >= rv:
        w = w[:-1]
    return w.replace("I", "i").replace("U", "u")


def stemmed(tokens: Column) -> Column:
    """Stems of a list of lower-case tokens; null stays null."""

    @F.pandas_udf("array<string>")
    def stems(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: None if ws is None else [stem_italian(w) for w in ws])

    return stems(tokens)
