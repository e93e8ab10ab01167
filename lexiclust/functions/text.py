"""Text column expressions (JVM-side regex, no Python per row).

Java regex ``\\w`` is ASCII-only while the reference's Python ``\\w`` is
Unicode, so word classes are spelled ``\\p{L}\\p{N}_``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# Contraction rules, applied in this order, case-sensitive; the quote class
# holds the four apostrophe-like characters ' ’ ‘ `.
QUOTES = "['’‘`]"
CONTRACTION_RULES = [
    (f"won{QUOTES}t", "will not"),
    (f"can{QUOTES}t", "can not"),
    (f"ain{QUOTES}t", "am not"),
    (f"n{QUOTES}t", " not"),
    (f"{QUOTES}re", " are"),
    (f"{QUOTES}s", " is"),
    (f"{QUOTES}d", " would"),
    (f"{QUOTES}ll", " will"),
    (f"{QUOTES}t", " not"),
    (f"{QUOTES}ve", " have"),
    (f"{QUOTES}m", " am"),
]
# Characters kept by the symbol filter: word characters and . ? ! ;
SYMBOL_FILTER = r"[^\p{L}\p{N}_.?!;]"
# White space as Unicode has it (\s of Java and of RE2 is ASCII only).
SPACE = (r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# The same set of characters for Java, whose own class is faster than a list of ranges.
SPACE_JVM = r"(?U:[\s\x{1c}-\x{1f}])"
# Sentence delimiter of the plain splitter.
SENTENCE_DELIMS = r"[.;!?]" + SPACE + "*"
# Delimiter kept by the delimiter-keeping splitter.
KEPT_DELIMS = r"([.;!?] *)"
# Rule-based sentence splitter pieces.
RULE_ALPHABETS = "([A-Za-z])"
RULE_DIGITS = "([0-9])"
RULE_PREFIXES = "(Mr|St|Mrs|Ms|Dr)[.]"
RULE_SUFFIXES = "(Inc|Ltd|Jr|Sr|Co)"
RULE_STARTERS = (r"(Mr|Mrs|Ms|Dr|He\s|She\s|It\s|They\s|Their\s|Our\s|We\s|But\s"
                 r"|However\s|That\s|This\s|Wherever)").replace(r"\s", SPACE)
RULE_ACRONYMS = "([A-Z][.][A-Z][.](?:[A-Z][.])?)"
RULE_WEBSITES = "[.](com|net|org|io|gov)"
# Steps of the rule-based splitter in their order: (kind, what, replacement).
RULE_STEPS = [
    ("text", "\n", " "),
    ("pattern", RULE_PREFIXES, "$1<prd>"),
    ("pattern", RULE_WEBSITES, "<prd>$1"),
    ("text", "Ph.D.", "Ph<prd>D<prd>"),
    ("pattern", SPACE + RULE_ALPHABETS + "[.] ", " $1<prd> "),
    ("pattern", RULE_ACRONYMS + " " + RULE_STARTERS, "$1<stop> $2"),
    ("pattern", "[.]".join([RULE_ALPHABETS] * 3) + "[.]", "$1<prd>$2<prd>$3<prd>"),
    ("pattern", "[.]".join([RULE_ALPHABETS] * 2) + "[.]", "$1<prd>$2<prd>"),
    ("pattern", RULE_DIGITS + "[.]" + RULE_DIGITS, "$1<prd>$2"),
    ("pattern", " " + RULE_SUFFIXES + "[.] " + RULE_STARTERS, " $1<stop> $2"),
    ("pattern", " " + RULE_SUFFIXES + "[.]", " $1<prd>"),
    ("pattern", " " + RULE_ALPHABETS + "[.]", " $1<prd>"),
    ("text", ".”", "”."),
    ("text", ".\"", "\"."),
    ("text", "!\"", "\"!"),
    ("text", "?\"", "\"?"),
    ("text", ".", ".<stop>"),
    ("text", "?", "?<stop>"),
    ("text", "!", "!<stop>"),
    ("text", "<prd>", "."),
]
# ASCII punctuation (Python's string.punctuation) for the token filter chain.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Entity label -> replacement word (18 classes).
ENTITY_WORDS = {
    "CARDINAL": "NUMBER", "DATE": "DATE", "EVENT": "EVENT", "FAC": "FACILITY",
    "GPE": "COUNTRY", "LANGUAGE": "LANGUAGE", "LAW": "LAW", "LOC": "LOCATION",
    "MONEY": "MONEY", "NORP": "NATION", "ORDINAL": "FIRST", "ORG": "COMPANY",
    "PERCENT": "PERCENT", "PERSON": "PERSON", "PRODUCT": "PRODUCT",
    "QUANTITY": "QUANTITY", "TIME": "TIME", "WORK_OF_ART": "ART",
}
# Part-of-speech -> replacement word.
POS_WORDS = {"PRON": "HE", "NUM": "NUMBER"}
# Older tagging variant: suffix-1 words.
POS_WORDS_SUFFIX1 = {"PROPN": "PERSON1", "PRON": "PRON1", "NUM": "ORDINAL1"}
# ---------------------------------------------------------------------------

_PUNCT_CLASS = "[" + "".join("\\" + c if c in "\\[]^-" else c for c in PUNCTUATION) + "]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def expand_contractions(col) -> Column:
    """The rules in order; texts without any quote character skip the 11
    regex passes (same result, one scan)."""
    src = _c(col)
    out = src
    for pattern, repl in CONTRACTION_RULES:
        out = F.regexp_replace(out, pattern, repl)
    return F.when(src.rlike(QUOTES), out).otherwise(src)


def strip_symbols(col) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(col), SYMBOL_FILTER, " "), " +", " ")


def decontract(col) -> Column:
    """Contractions expanded, symbols stripped (the cleaning step before splitting)."""
    return strip_symbols(expand_contractions(col))


def sentence_array(col) -> Column:
    """Split on . ; ! ? (plus following spaces), trim, drop blanks; order kept."""
    parts = F.split(_c(col), SENTENCE_DELIMS.replace(SPACE, SPACE_JVM))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def split_keep_delims(col) -> Column:
    """Like Python ``re.split`` with a capture group: delimiters are pieces too."""
    marked = F.regexp_replace(_c(col), KEPT_DELIMS, "\u0001$1\u0001")
    return F.split(marked, "\u0001")


def capitalize(col) -> Column:
    c = _c(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def capitalized_pieces(col) -> Column:
    """Each piece capitalised (first letter upper, rest lower), joined by a space."""
    return F.array_join(F.transform(split_keep_delims(col), capitalize), " ")


def pystrip(col) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(_c(col), f"\\A{SPACE_JVM}+|{SPACE_JVM}+\\z", "")


def rule_sentence_split(col) -> Column:
    """Rule-based splitter: protects titles, acronyms, decimals, web names...;
    breaks after . ? !, drops the final fragment, strips each sentence."""
    t = F.concat(F.lit(" "), _c(col), F.lit("  "))
    for kind, what, by in RULE_STEPS:
        t = F.replace(t, F.lit(what), F.lit(by)) if kind == "text" else F.regexp_replace(t, what, by)
    pieces = F.split(t, "<stop>")
    kept = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(kept, pystrip)


def normalize_filters(col) -> Column:
    """Lower, strip <tags>, punctuation -> space, squeeze whitespace, strip
    digits, whitespace split (empty pieces dropped)."""
    t = F.lower(_c(col))
    t = F.regexp_replace(t, "<([^>]+)>", "")
    t = F.regexp_replace(t, _PUNCT_CLASS + "+", " ")
    t = F.regexp_replace(t, SPACE_JVM + "+", " ")
    t = F.regexp_replace(t, "[0-9]+", "")
    return F.filter(F.split(t, SPACE_JVM + "+"), lambda w: w != "")


def words(col) -> Column:
    """Python ``str.split()``: whitespace split, empty pieces dropped."""
    return F.filter(F.split(_c(col), SPACE_JVM + "+"), lambda w: w != "")


def wc_regex_split(col) -> Column:
    """``len(re.split(r'\\s+', t))``: empty edge pieces count."""
    return F.size(F.split(_c(col), SPACE_JVM + "+", -1))


def wc_split(col) -> Column:
    return F.size(words(col))


def wc_spaces(col) -> Column:
    c = _c(col)
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def clean_book_text(col) -> Column:
    """Blank-line runs -> one newline, space runs -> one space, then every
    line prefixed by a space."""
    t = F.regexp_replace(_c(col), "\n" + SPACE_JVM + "*\n", "\n")
    t = F.regexp_replace(t, " +", " ")
    return F.concat(F.lit(" "), F.replace(t, F.lit("\n"), F.lit("\n ")))


def is_not_lower(col) -> Column:
    """``not word.islower()``: islower needs at least one cased character."""
    c = _c(col)
    return ~((c == F.lower(c)) & (c != F.upper(c)))


def posexplode_rows(df, arr, pos: str, val: str, *keep):
    """``posexplode`` of a computed array without the inferred
    ``size(arr) > 0`` pre-filter (Spark would inline and evaluate the whole
    array expression twice): outer explode, then drop the empty marker row."""
    from pyspark.sql import DataFrame  # noqa: F401
    out = df.select(*keep, F.posexplode_outer(arr).alias(pos, val))
    return out.where(F.col(pos).isNotNull()).withColumn(pos, F.col(pos).cast("long"))


def explode_rows(df, arr, val: str, *keep):
    out = df.select(*keep, F.explode_outer(arr).alias(val))
    return out.where(F.col(val).isNotNull())
