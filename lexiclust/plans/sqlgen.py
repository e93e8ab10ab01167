"""DuckDB SQL fragments mirroring the column expressions in ``functions``.

They only build oracle strings for the correctness check; nothing here runs
on Spark.
"""

from __future__ import annotations

from ..functions import text as tx


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def contractions(e: str) -> str:
    for pattern, repl in tx.CONTRACTION_RULES:
        e = f"regexp_replace({e}, {lit(pattern)}, {lit(repl)}, 'g')"
    return e


def strip_symbols(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, {lit(tx.SYMBOL_FILTER)}, ' ', 'g'), ' +', ' ', 'g')"


def decontract(e: str) -> str:
    return strip_symbols(contractions(e))


def sentence_array(e: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({e}, {lit(tx.SENTENCE_DELIMS)}), "
            f"lambda x: trim(x)), lambda x: x <> '')")


def clean_tokens(e: str) -> str:
    return f"flatten(list_transform({sentence_array(decontract(e))}, lambda s: string_split(s, ' ')))"


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{tx.SPACE}+'), lambda w: w <> '')"


def normalize_filters(e: str) -> str:
    t = f"lower({e})"
    t = f"regexp_replace({t}, '<([^>]+)>', '', 'g')"
    t = f"regexp_replace({t}, {lit(tx._PUNCT_CLASS + '+')}, ' ', 'g')"
    t = f"regexp_replace({t}, '{tx.SPACE}+', ' ', 'g')"
    t = f"regexp_replace({t}, '[0-9]+', '', 'g')"
    return f"list_filter(regexp_split_to_array({t}, '{tx.SPACE}+'), lambda w: w <> '')"


def pystrip(e: str) -> str:
    return f"regexp_replace({e}, '\\A{tx.SPACE}+|{tx.SPACE}+\\z', '', 'g')"


def rule_sentence_split(e: str) -> str:
    t = f"(' ' || {e} || '  ')"
    for kind, what, by in tx.RULE_STEPS:
        if kind == "text":
            t = f"replace({t}, {lit(what)}, {lit(by)})"
        else:
            t = f"regexp_replace({t}, {lit(what)}, {lit(by.replace('$', chr(92)))}, 'g')"
    return (f"list_transform(list_slice(string_split({t}, '<stop>'), 1, "
            f"len(string_split({t}, '<stop>')) - 1), lambda s: {pystrip('s')})")


def posexplode(arr: str, val: str, pos: str) -> str:
    """SELECT-list items that unnest ``arr`` with a 0-based position."""
    return f"unnest({arr}) AS {val}, unnest(range(len({arr}))) AS {pos}"


def hash_int(seed, *cols: str, digits: int = 15) -> str:
    key = " || ':' || ".join([lit(str(seed))] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"CAST(('0x' || substr(md5({key}), 1, {digits})) AS BIGINT)"


def hash_key(seed, *cols: str) -> str:
    key = " || ':' || ".join([lit(str(seed))] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"md5({key})"
