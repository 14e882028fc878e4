"""Text functions as Column expressions: normal forms, tokens, keys, identifiers, markup.

Spark has no Unicode decomposition, so accents are folded by one translate table, generated from the Latin letters whose
decomposition is a plain letter and marks. Everything else stays in generated code.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Latin letters with marks and the letters without."""
    pairs = []
    for c in map(chr, range(0xC0, 0x250)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c and plain.isascii():
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _folding()
#: Letters and digits for character classes, written out: Java looks such a class up in a table, one of ranges is several times slower.
ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"

#: Words that carry no meaning in an option's or a stem's key.
STOP = """a an the of is are be to in on and or with for by its it this that as at from was were has have can its
which what who following regarding concerning about during among statement statements proposition
propositions true correct right exact answer answers check select choose""".split()
#: Words whose difference changes what a proposition says.
FLIP = """not no without never always only all none any never neither nor except false incorrect wrong inexact
increase increased increases decrease decreased decreases high higher low lower elevated reduced normal
abnormal left right upper lower acute chronic subacute bacterial viral fungal positive negative sudden
progressive gradual dry productive wet unilateral bilateral rare frequent common uncommon often seldom
major minor primary secondary early late before after above below less more most least first last
typical atypical benign malignant severe mild absent present absence presence urgency emergency
contraindicated indicated systematic systematically necessary unnecessary useful useless""".split()
#: Abbreviations and plain synonyms, written out.
ABBREVIATIONS = {
    "atb": "antibiotic", "atbs": "antibiotic", "antibiotics": "antibiotic", "alrti": "acute lower respiratory tract infection",
    "ild": "interstitial lung disease", "cap": "community acquired pneumonia", "cxr": "chest x ray",
    "xray": "x ray", "tb": "tuberculosis", "bal": "bronchoalveolar lavage", "bp": "blood pressure",
    "chf": "congestive heart failure", "pneumococcus": "streptococcus pneumoniae", "pneumococci": "streptococcus pneumoniae",
    "insidious": "progressive", "gradual": "progressive", "aetiology": "etiology",
}
#: Words that are dropped before stems and options are compared by TF-IDF.
SEARCH_STOP = """a an the of in on at to for with and or is are be was were by as it its this that these those which what
who whom whose when where why how following statement statements correct true false exact accurate right answer answers
proposition propositions regarding concerning about among during case cases select choose check specify identify correspond
corresponding those following one ones can may often most usually typically commonly common main primary classic
is are (are) (s) s mention we cite following: following? include includes including based be being there their
patient patients mr mrs miss m year old man woman male female presents presenting consult consults consultation
will would should could do does did has have had not no any all none best more less very""".split()
#: Fixed value: words that deny.
NEGATION = r"\b(not|except|false|incorrect|wrong|inexact|untrue|inaccurate|mistakes?|avoid)\b"


def fold(text: Column) -> Column:
    """text without the marks of Latin letters."""
    return F.translate(text, MARKED, PLAIN)


def norm(text: Column) -> Column:
    """The tagger's normal form, padded with a space at both ends."""
    t = F.lower(F.translate(text, MARKED + "’`", PLAIN + "''"))
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = F.regexp_replace(t, "&[a-z#0-9]+;", " ")
    t = F.regexp_replace(t, rf"[^{ALNUM}'+\-/ ]+", " ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r" {2,}", " ")), F.lit(" "))


def plain_words(normal: Column) -> Column:
    """The runs of letters and digits of a text in normal form."""
    return F.regexp_extract_all(normal, F.lit(f"[{ALNUM}]+"), F.lit(0))


def unescape(text: Column) -> Column:
    """The common entities of markup; the rest stay."""
    for code, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escape(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def letters_only(text: Column) -> Column:
    """The merge's normal form: no tags, no entities, lower case, only a-z and 0-9 (letters with marks go)."""
    return F.regexp_replace(F.lower(unescape(F.regexp_replace(text, "<[^>]+>", ""))), "[^a-z0-9]+", "")


def plain(html: Column) -> Column:
    """Text of markup in ASCII, white space squeezed."""
    t = fold(unescape(F.regexp_replace(html, "<[^>]+>", " ")))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\x00-\x7F]", ""), r"\s+", " "))


def words(html: Column) -> Column:
    """Tokens of markup: bracketed abbreviations dropped, digits apart from letters, synonyms written out, plain singulars."""
    t = F.regexp_replace(F.lower(plain(html)), r"\([a-z0-9]{2,8}\)", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"([0-9])([a-z])", "$1 $2"), r"([a-z])([0-9])", "$1 $2")
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    full = F.transform(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.coalesce(table[w], w))
    single = lambda w: F.when((F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.transform(F.filter(F.split(F.array_join(full, " "), " "), lambda w: w != ""), single)


def key(html: Column) -> Column:
    """The distinct words that matter."""
    return F.array_distinct(F.filter(words(html), lambda w: ~w.isin(STOP)))


def compact(html: Column) -> Column:
    """The words that matter, run together."""
    return F.array_join(F.filter(words(html), lambda w: ~w.isin(STOP)), "")


def search_tokens(text: Column) -> Column:
    """Tokens for TF-IDF: stop words and single letters dropped, -ies to -y, -s off."""
    return normal_tokens(norm(text))


def normal_tokens(normal: Column) -> Column:
    """search_tokens of a text that is in normal form."""
    # a token ends before its last apostrophes, hyphens and slashes
    bare = F.regexp_extract_all(normal, F.lit(rf"[{ALNUM}](?:[{ALNUM}'+\-/]*[{ALNUM}+])?"), F.lit(0))
    kept = F.filter(bare, lambda w: (F.length(w) >= 2) & ~w.isin(SEARCH_STOP))

    def stem(w: Column) -> Column:
        n = F.length(w)
        return (
            F.when((n > 4) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
            .when((n > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), n - 1))
            .otherwise(w)
        )

    return F.transform(kept, stem)


def near(a: Column, b: Column) -> Column:
    """Whether two words differ by typing errors only."""
    flip = lambda w: w.isin(sorted(set(FLIP)))
    digits = lambda w: w.rlike("^[0-9]+$")
    hyper = lambda w: w.startswith("hyper") | w.startswith("hypo")
    barred = flip(a) | flip(b) | digits(a) | digits(b) | (F.least(F.length(a), F.length(b)) < 5)
    barred = barred | ((F.substring(a, 1, 4) != F.substring(b, 1, 4)) & (hyper(a) | hyper(b))) | (F.abs(F.length(a) - F.length(b)) > 2)
    one, two = F.levenshtein(a, b, 1) >= 0, F.levenshtein(a, b, 2) >= 0
    return (a == b) | (~barred & F.when(F.greatest(F.length(a), F.length(b)) < 9, one).otherwise(two))


def denies(text: Column) -> Column:
    return F.lower(text).rlike(NEGATION)


def term_pattern(term: str) -> str:
    """A whole word, with a plural; the same in every regular-expression dialect."""
    return f"(^|[^a-z0-9]){term}(s|es)?([^a-z0-9]|$)"


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def set_slug(text: Column) -> Column:
    """A slug whose repeated words stand once."""
    return F.array_join(F.array_distinct(F.split(slug(text), "-")), "-")


def letters_to_indexes(letters: Column) -> Column:
    """BCD to 1, 2, 3."""
    return F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: F.ascii(c) - 65)


def indexes_to_letters(indexes: Column) -> Column:
    return F.array_join(F.transform(indexes, lambda i: F.char(i + 65)), "")


def shortened(text: Column, limit: int = 400) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("…"))).otherwise(text)


def short_number(x: Column) -> Column:
    """At most two decimals, without trailing zeros."""
    fixed = F.format_string("%.2f", F.floor(x * 100 + 0.5) / 100)
    return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")


def name_key(name: Column) -> Column:
    """What makes two display names the same: letters and digits without case, marks and separators."""
    return F.regexp_replace(F.lower(fold(name)), "[^a-z0-9]", "")


def too_close(a: Column, b: Column) -> Column:
    """An assumption (the rule is not published): name keys at most one edit apart."""
    return F.levenshtein(name_key(a), name_key(b), 1) >= 0


def from_base64url(text: Column) -> Column:
    """The text coded in base64url, with or without padding; null if it is none."""
    standard = F.translate(text, "-_", "+/")
    padded = F.concat(standard, F.substring(F.lit("==="), F.lit(1), (F.lit(4) - F.length(standard) % 4) % 4))
    return F.try_to_binary(F.rtrim(padded), F.lit("base64")).cast("string")
