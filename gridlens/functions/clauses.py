"""Clauses as short strings of token classes, and small grammars over them.

A clause becomes one character a token: an upper-case letter for an option (named by its label or in full), a lower-case
letter or digit for a class of words, ``x`` for anything else; articles and adverbs of degree disappear.  What a clause says
about options is then a handful of patterns over a few characters instead of over prose.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlens.functions import text as X

#: Word classes.
CLASSES = {
    "m": "would could might may", "b": "is be become becomes are was were been represent represents appear appears seem seems looks = :",
    "o": "to toward towards", "t": "best correct preferred right strongest leading better", "q": "most", "2": "more",
    "l": "likely appropriate plausible consistent suspect specific suitable significant", "j": "only",
    "f": "suggest suggests support supports indicate indicates point points", "1": "favor favors favour favours", "k": "make makes making",
    "c": "choose select pick go", "v": "shift shifts change changes changed changing switch switches alter altered",
    "n": "answer choice option", "3": "diagnosis treatment selection preference management cause candidate finding step approach explanation fit",
    "r": "alternative", "e": "not never cannot doesn don isn wouldn neither nor", "w": "or", "h": "over versus than against", "i": "if unless",
    "s": "stem question", "p": "rephrase rephrased rephrasing reword reworded rewrite rewriting rewritten modify modified modifying",
    "a": "ask asks asked asking focus focused focuses wording phrasing intent", "y": "which what who when where how", "d": "said",
    "g": "stated specified", "u": "possible possibility consideration less unlikely excluded", "z": "this that it feature fact scenario presence absence",
    "": "the a an then now strongly therefore thus hence so with",
}
_TOP = "(?:t|[q2]l)"
#: A hypothetical under which the captured option wins; the last one holds the first of two that win together.
WINNERS = (
    rf"([A-Z])[^A-Zme]{{0,15}}m[^A-Ze]{{0,3}}b[^A-Ze]{{0,4}}{_TOP}", rf"k[^A-Ze]{{0,4}}([A-Z])[^A-Ze]{{0,8}}{_TOP}",
    "m[^A-Ze]{0,4}[f1][^A-Ze]{0,3}([A-Z])", "[f1]([A-Z])h", "v[^A-Ze]{0,3}o[^A-Ze]{0,4}([A-Z])",
    "v[^A-Ze]{0,4}[A-Z][^A-Ze]{0,4}o[^A-Ze]{0,3}([A-Z])", rf"([A-Z])[^A-Zme]{{0,4}}{_TOP}[n3]", "[n3]m[^A-Ze]{0,2}[bv][^A-Ze]{0,3}([A-Z])",
    rf"([A-Z])[^A-Ze]{{0,2}}w[^A-Ze]{{0,2}}[A-Z][^A-Ze]{{0,15}}m[^A-Ze]{{0,3}}b[^A-Ze]{{0,4}}{_TOP}",
)
#: Another task or another option in place of another case.
REWRITTEN = ("(?:[pv][^A-Z]{0,8}s[^A-Z]{0,10}a)|(?:s[^A-Z]{0,3}[pv]o[^A-Z]{0,2}[ay])|(?:sb?x?a)|(?:sx?gb?y)|"
             "(?:[A-Z][^A-Zm]{0,3}(?:d|b[pv]))")
#: An answer that is settled on, with its option.
SETTLED = (
    "[n3]m?b(?:ob)?([A-Z])(?!b?[um])", "([A-Z])b(?:ob)?(?:t|ql|j)", "[c1]([A-Z])(?!b?u)", "[f1]([A-Z])x?(?:t|ql|l)",
    "(?:j|t|ql)n?([A-Z])(?!b?[um])", "([A-Z])(?:t|ql)n",
)
#: One that is settled on without saying which.
SETTLED_UNNAMED = "b(?:ob)?(?:t|ql)n"
#: Only under a condition, or as what some finding would do.
HYPOTHETICAL = "i.*m|[zy3]m[c1]"


def marked(text: Column) -> Column:
    """Text with ``§`` before every letter that stands for an option."""
    naming = F.regexp_replace(text, r"\b(?i:option|choice|answer)\s*\(?([A-Z])\)?(?![\w'’])", " §$1 ")
    framed = F.regexp_replace(naming, r"\(([A-Z])\)", " §$1 ")
    dotted = F.regexp_replace(framed, r"(?<![\w'’§])([A-Z])[.):](?=\s|$)", " §$1 ")
    bare = F.regexp_replace(dotted, r"(?<![\w'’§])([B-HJ-Z])(?![\w'’])", " §$1 ")
    article = F.regexp_replace(bare, r"(?<![\w'’§])A(?=\s+(?:would|could|might|is|seems|appears|as)\b)", " §A ")
    return F.regexp_replace(article, r"(?<=\b(?:is|be|to|choose|select|pick|favor|favour|with)\s)A(?=\s*(?:$|[.,;!?)]|because|since|as\b|but\b|and\b))", " §A ")


def _aliases(labels: Column, choice_texts: Column) -> Column:
    """(text, mark) of every choice, without leading articles, longest first."""
    bare = F.transform(choice_texts, lambda c: F.regexp_replace(c, r"^(?:(?:the|an?|his|her|their) )*", ""))
    pairs = F.transform(F.arrays_zip(bare.alias("t"), labels.alias("l")), lambda p: F.struct(
        (-F.length(p["t"])).alias("size"), p["t"].alias("text"), F.lower(p["l"]).alias("label")))
    return F.sort_array(F.filter(pairs, lambda p: p["size"] <= -3))


def encoded(clause: Column, labels: Column, choice_texts: Column) -> Column:
    """Token classes of a clause of :func:`marked` text; ``choice_texts`` are normalised."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower(clause), r"([=:])", " $1 "), r"[^\p{L}\p{N}§=:]+", " "), F.lit(" "))
    named = F.aggregate(_aliases(labels, choice_texts), plain, lambda t, c: F.replace(
        t, F.concat(F.lit(" "), c["text"], F.lit(" ")), F.concat(F.lit(" §"), c["label"], F.lit(" "))))
    classes = F.create_map(*[F.lit(x) for name, words in CLASSES.items() for word in words.split() for x in (word, name)])
    letters = F.transform(F.split(F.trim(named), " +"), lambda t: F.when(
        t.startswith("§"), F.when(F.array_contains(labels, F.upper(F.substring(t, 2, 1))), F.upper(F.substring(t, 2, 1))).otherwise("x")).otherwise(
        F.coalesce(F.try_element_at(classes, t), F.lit("x"))))
    return F.regexp_replace(F.array_join(letters, ""), r"([A-Z])\1+", "$1")


def options_in(code: Column, grammar: tuple[str, ...]) -> Column:
    """Options that a grammar captures, each once."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(code, F.lit(rule), F.lit(1)) for rule in grammar])))


def wins_alone(text: Column, option: Column, labels: Column, choice_texts: Column) -> Column:
    """Whether in some sentence exactly this option is said to win, and none rewrites the task or an option.

    The best alternative without a name is the option itself.
    """
    sentences = F.split(marked(text), r"(?<=[.!?])\s+|\n{2,}")
    codes = F.transform(sentences, lambda s: F.regexp_replace(F.replace(encoded(s, labels, choice_texts), F.lit("tr"), option), r"([A-Z])\1+", "$1"))
    return X.let(codes, lambda found: F.exists(found, lambda c: X.let(options_in(c, WINNERS), lambda w: (F.size(w) == 1) & F.array_contains(w, option)))
                 & ~F.exists(found, lambda c: c.rlike(REWRITTEN)))
