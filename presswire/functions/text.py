"""Text cleaning as Column expressions.

All steps are built-in regex / array functions, so they stay in the JVM and
run per row without any Python worker.  The character classes reproduce
Python's Unicode ``\\w`` / ``\\s`` / ``\\d`` (Java's defaults are ASCII-only
and ``(?U)`` would count combining marks as word characters).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswire import constants as C

# Python ``\s`` for str patterns.
WS_CLASS = r"\t-\r\x{1c}-\x{1f}\x{85}\p{Z}"
WS = f"[{WS_CLASS}]"
# Python ``[^\w\s]``: not a letter, number, underscore or whitespace.
NONWORD = rf"[^\p{{L}}\p{{N}}_{WS_CLASS}]"
# ``[^\w\s]`` or whitespace: whitespace is neither letter, number nor underscore.
NONWORD_OR_WS = r"[^\p{L}\p{N}_]"
# Python ``\d`` for str patterns: decimal digits only.
DIGITS = r"\p{Nd}+"
# Python ``[^a-zA-Z0-9\s]``
NON_ASCII_ALNUM = rf"[^a-zA-Z0-9{WS_CLASS}]"


# The same whitespace set as characters, for btrim (no regex, no re-encoding).
WS_CHARS = ("".join(chr(i) for i in range(0x09, 0x0E)) + "".join(chr(i) for i in range(0x1C, 0x20))
            + "\x85 \xa0\u1680" + "".join(chr(i) for i in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c: Column) -> Column:
    """fn_strip: remove leading / trailing Unicode whitespace (``trim`` only removes spaces)."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    """fn_collapse_ws: runs of whitespace -> one space."""
    return F.regexp_replace(c, f"{WS}+", " ")


def is_blank(c: Column) -> Column:
    """NULL or only whitespace."""
    return c.isNull() | (strip_ws(c) == F.lit(""))


def contraction_pattern(word: str) -> str:
    """Regex for one contraction with either apostrophe form."""
    return re.escape(word).replace("'", "['’]").replace("\\ ", " ")


def contraction_passes(table: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """(regex, replacement) passes for the contraction table, in table order.

    Consecutive entries of the form ``X's -> X is`` only turn "'s" into " is"
    after a listed word, so they are merged into one alternation pass; every
    other entry is its own pass.  Each pass converts the whole text, so fewer
    passes is the main cost saving of the cleaner.
    """
    passes: list[tuple[str, str]] = []
    group: list[str] = []
    for word, repl in (table or C.CONTRACTIONS):
        if word.endswith("'s") and repl == word[:-2] + " is":
            group.append(re.escape(word[:-2]))
            continue
        if group:
            passes.append((f"({'|'.join(group)})['’]s", "$1 is"))
            group = []
        passes.append((contraction_pattern(word), repl))
    if group:
        passes.append((f"({'|'.join(group)})['’]s", "$1 is"))
    return passes


def expand_contractions(c: Column, table: list[tuple[str, str]] | None = None) -> Column:
    """txt_contractions: apply the contraction table in order.

    Texts without an apostrophe skip every pass (one byte search instead of
    a decode / re-encode of the text per pass).
    """
    out = c
    for pat, repl in contraction_passes(table):
        out = F.regexp_replace(out, pat, repl)
    has_apostrophe = (F.instr(c, "'") > F.lit(0)) | (F.instr(c, "’") > F.lit(0))
    return F.when(has_apostrophe, out).otherwise(c)


def drop_tokens(text: Column, stopwords: list[str], min_len: int = 2) -> Column:
    """txt_stopwords: split on single spaces, drop stop words and tokens shorter than ``min_len``.

    The IN-list inside the lambda is rewritten to a hash set (INSET) by the optimizer.
    """
    toks = F.split(text, " ")
    kept = F.filter(toks, lambda t: (~t.isin(*stopwords)) & (F.length(t) >= F.lit(min_len)))
    return F.array_join(kept, " ")


def clean_silver(body: Column, stopwords: list[str] | None = None,
                 contractions: list[tuple[str, str]] | None = None) -> Column:
    """txt_clean_silver.

    blank / NULL -> ""; lower; expand contractions; ``[^\\w\\s]`` -> space;
    digits removed; whitespace collapsed and stripped; stop words and
    one-character tokens dropped.
    """
    return clean_lowered(F.lower(body), stopwords, contractions)


def clean_lowered(lowered: Column, stopwords: list[str] | None = None,
                  contractions: list[tuple[str, str]] | None = None) -> Column:
    """txt_clean_silver of a body that is lower-cased already.

    The text is named several times in the expression and evaluated as often, so a caller with many rows gives a
    column that was worked out before.
    """
    t = expand_contractions(lowered, contractions)
    # digits are word characters, so they may go first; then what would become a space, and whitespace, parts the
    # tokens, and empties are dropped with the short ones
    t = F.regexp_replace(t, DIGITS, "")
    sw = stopwords if stopwords is not None else C.SILVER_STOPWORDS
    kept = F.filter(F.split(t, NONWORD_OR_WS + "+"),
                    lambda w: (F.length(w) >= F.lit(2)) & ~w.isin(*sw))
    # a blank body already cleans to ""; only NULL needs the default
    return F.coalesce(F.array_join(kept, " "), F.lit(""))


def clean_english_base(body: Column, contractions: list[tuple[str, str]] | None = None) -> Column:
    """txt_clean_english up to (not including) lemmatisation.

    lower; contractions; ``[^\\w\\s]`` -> "" (joins words: "don-t" -> "dont");
    non-ASCII-alphanumerics -> ""; digits and remaining symbols -> "".
    """
    t = F.lower(body)
    t = expand_contractions(t, contractions)
    # the original's third pattern keeps letters, a few punctuation marks and whitespace; after the two
    # passes before it only digits can still be removed, so that one pass leaves letters and whitespace
    return F.regexp_replace(t, rf"[^a-zA-Z{WS_CLASS}]+", "")


def english_stopwords() -> list[str]:
    """The workspace's English stop words, minus "not"."""
    return [w for w in C.ENGLISH_STOPWORDS if w != "not"]


def remove_stopwords_ci(text: Column, stopwords: list[str]) -> Column:
    """Whitespace tokens; drop case-insensitive stop words; re-join with one space."""
    return join_kept(F.split(strip_ws(text), f"{WS}+"), stopwords)


def join_kept(toks: Column, stopwords: list[str]) -> Column:
    """The tokens that are neither empty nor stop words (in any case), joined by one space."""
    return F.array_join(F.filter(toks, lambda t: (t != F.lit("")) & ~F.lower(t).isin(*stopwords)), " ")


def native_digits(c: Column) -> Column:
    """txt_native_digits: Devanagari digits -> ASCII digits."""
    return F.translate(c, C.DEVANAGARI_DIGITS, "0123456789")


def replace_nbsp(c: Column) -> Column:
    """fn_replace_nbsp: delete NBSP and newlines."""
    return F.translate(c, "\u00a0\n", "")


def clean_hindi(body: Column) -> Column:
    """txt_clean_hindi.

    punctuation -> ""; newline / NBSP -> ""; drop Hindi + English stop words
    and symbol tokens; native digits -> ASCII -> removed.
    """
    t = F.regexp_replace(body, NONWORD, "")
    t = replace_nbsp(t)
    drop = set(C.HINDI_STOPWORDS) | set(english_stopwords() + ["not"]) | set(C.HINDI_SYMBOL_TOKENS)
    toks = F.filter(F.split(strip_ws(t), f"{WS}+"), lambda x: x != F.lit(""))
    t = F.array_join(F.filter(toks, lambda x: ~x.isin(*sorted(drop))), " ")
    t = native_digits(t)
    return F.regexp_replace(t, DIGITS, "")


def clean_punjabi(body: Column) -> Column:
    """txt_clean_punjabi: punctuation -> ""; native digits -> ASCII -> removed."""
    # native digits are decimal digits too: they go in the same pass as the punctuation
    return F.regexp_replace(body, rf"[\p{{Nd}}{NONWORD}]+", "")


def truncate(c: Column, n: int) -> Column:
    """fn_truncate: first n characters."""
    return F.substring(c, 1, n)


def before_marker(c: Column, marker: str) -> Column:
    """prj_edited_by: text before the first marker (whole text when absent)."""
    return F.substring_index(c, marker, 1)
