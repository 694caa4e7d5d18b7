"""Stems of Spanish words by suffix rules, as column expressions: no model, no rows of Python.

The rules are those of the published Snowball stemmer for Spanish: an attached pronoun goes, then a standard suffix, else a verb's ending, then what is left of gender and mood, then accents. Regions say how much of a
word must stay: RV, R1 and R2 are offsets into the word.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

V = "aeiouáéíóúü"
#: Where each region begins.
RV = f"^(?:.[^{V}][^{V}]*[{V}]|[{V}][{V}][{V}]*[^{V}]|[^{V}][{V}].)"
R1 = f"^[^{V}]*[{V}]+[^{V}]"
R2 = f"^[^{V}]*[{V}]+[^{V}][^{V}]*[{V}]+[^{V}]"
#: The suffixes of each rule.
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
ACCENTED = "iéndo ándo ár ér ír".split()
PLAIN = "iendo ando ar er ir".split()
DELETED = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
AFTER_IC = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
TO_LOG, TO_U, TO_ENTE = "logía logías".split(), "ución uciones".split(), "encia encias".split()
QUALITY, ACTIVE = "idad idades".split(), "iva ivo ivas ivos".split()
STANDARD = [*DELETED, *AFTER_IC, *TO_LOG, *TO_U, *TO_ENTE, "amente", "mente", *QUALITY, *ACTIVE]
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
SOFT_VERBS = "en es éis emos".split()
VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis "
    "asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
RESIDUAL, RESIDUAL_E = "os a o á í ó".split(), "e é".split()


def either(suffixes: Sequence[str]) -> str:
    """A pattern for the longest of the suffixes at the end of a word: the leftmost match that reaches the end."""
    return f"(?:{'|'.join(suffixes)})$"


def branched(suffixes: Sequence[str]) -> str:
    """The pattern of ``either``, common beginnings put together: a search tries a few letters at each place, not every suffix."""

    def after(rest: Sequence[str]) -> str:
        heads = {x[0]: [y[1:] for y in rest if y[:1] == x[0]] for x in rest if x}
        either_of = "|".join(c + after(tails) for c, tails in heads.items())
        return "" if not heads else f"(?:{either_of}){'?' if '' in rest else ''}" if len(heads) > 1 or "" in rest else either_of

    return f"(?:{after(suffixes)})$"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _end(w: Column, suffixes: Sequence[str]) -> Column:
    return F.regexp_extract(w, branched(suffixes), 0)


def _cut(w: Column, end: Column) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - F.length(end))


def _without(w: Column, suffixes: Sequence[str], least: Column) -> Column:
    """The word without its longest such suffix, if so much of it stays."""
    return _let(_end(w, suffixes), lambda e: F.when(F.length(w) - F.length(e) >= least, _cut(w, e)).otherwise(w))


def _offset(w: Column, pattern: str) -> Column:
    return _let(F.regexp_extract(w, pattern, 0), lambda x: F.when(x == "", F.length(w)).otherwise(F.length(x)))


def _pronoun(w: Column, rv: Column) -> Column:
    def after(p: Column) -> Column:
        def verb(s: Column) -> Column:
            accented = F.translate(s, "áéíóú", "aeiou")
            return _let(_end(s, [*ACCENTED, *PLAIN, "yendo"]), lambda g: F.when((g != "") & (F.length(s) - F.length(g) >= rv), F.when(g.isin(ACCENTED), F.concat(_cut(s, g), F.right(accented, F.length(g)))).when((g != "yendo") | F.endswith(s, F.lit("uyendo")), s).otherwise(w)).otherwise(w))

        return F.when(p == "", w).otherwise(_let(_cut(w, p), verb))

    return _let(_end(w, PRONOUNS), after)


def _standard(w: Column, r1: Column, r2: Column) -> Column:
    def found(e: Column) -> Column:
        def left(s: Column) -> Column:
            far = F.length(s) >= r2
            mente = _let(_without(s, ["iv"], r2), lambda x: F.when(x != s, _without(x, ["at"], r2)).otherwise(_without(s, ["os", "ic", "ad"], r2)))
            return (
                F.when(e == "amente", F.when(F.length(s) >= r1, mente).otherwise(w)).when(~far, w).when(e.isin(DELETED), s).when(e.isin(AFTER_IC), _without(s, ["ic"], r2)).when(e.isin(TO_LOG), F.concat(s, F.lit("log"))).when(e.isin(TO_U), F.concat(s, F.lit("u")))
                .when(e.isin(TO_ENTE), F.concat(s, F.lit("ente"))).when(e == "mente", _without(s, ["ante", "able", "ible"], r2)).when(e.isin(QUALITY), _without(s, ["abil", "ic", "iv"], r2)).otherwise(_without(s, ["at"], r2))
            )

        return F.when(e == "", w).otherwise(_let(_cut(w, e), left))

    return _let(_end(w, STANDARD), found)


def _verb(w: Column, rv: Column) -> Column:
    region = F.substring(w, rv + 1, F.length(w))

    def y_verb(e: Column) -> Column:
        return _let(_cut(w, e), lambda s: F.when((e != "") & F.endswith(s, F.lit("u")), s).otherwise(other))

    def ending(e: Column) -> Column:
        return _let(_cut(w, e), lambda s: F.when(e.isin(SOFT_VERBS) & F.endswith(s, F.lit("gu")), _cut(s, F.lit("u"))).otherwise(s))

    other = _let(_end(region, [*SOFT_VERBS, *VERBS]), ending)
    return _let(_end(region, Y_VERBS), y_verb)


def _residual(w: Column, rv: Column) -> Column:
    def ending(e: Column) -> Column:
        def left(s: Column) -> Column:
            hard = e.isin(RESIDUAL_E) & F.endswith(s, F.lit("gu")) & (F.length(s) - 1 >= rv)
            return F.when((e == "") | (F.length(s) < rv), w).when(hard, _cut(s, F.lit("u"))).otherwise(s)

        return _let(_cut(w, e), left)

    return _let(_end(w, [*RESIDUAL, *RESIDUAL_E]), ending)


def stem(word: Column) -> Column:
    """The stem of a word in lower case; null stays null."""

    def of(w: Column) -> Column:
        regions = F.struct(_offset(w, RV).alias("v"), _offset(w, R1).alias("r1"), _offset(w, R2).alias("r2"))

        def steps(r: Column) -> Column:
            def rest(a: Column) -> Column:
                done = lambda x: F.translate(_residual(x, r["v"]), "áéíóú", "aeiou")
                return _let(_standard(a, r["r1"], r["r2"]), lambda b: _let(F.when(b != a, b).otherwise(_verb(a, r["v"])), done))

            return _let(_pronoun(w, r["v"]), rest)

        return _let(regions, steps)

    return F.when(word.isNotNull(), _let(F.lower(word), of))
