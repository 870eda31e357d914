"""Scalar text functions: canonical form, folding, lengths, previews, prompts, tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .. import rules
from .bind import let

# Fixed value: every character that str.strip() and str.split() treat as space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as a class: Unicode white space and the four separators U+001C..U+001F.
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

LEVELS = ("light", "search", "full")


def strip(c: Column) -> Column:
    """Both ends without white space; looks at the ends only, no regex scan."""
    return F.btrim(c, F.lit(WHITESPACE))


def _plain_characters(t: Column) -> Column:
    """NBSP, ``**`` and CR out; texts without any of them are left alone."""
    out = t
    for old, new in (("\xa0", " "), ("**", ""), ("\r\n", "\n"), ("\r", "\n")):
        out = F.replace(out, F.lit(old), F.lit(new))
    dirty = t.contains("\xa0") | t.contains("**") | t.contains("\r")
    return F.when(dirty, out).otherwise(t)


def canonicalize(c: Column, level: str = "full", null_as_empty: bool = False) -> Column:
    """Canonical text.

    ``light``: NBSP to space, no ``**``, LF line ends, one space per blank run.
    ``search``: also at most two LF in a row. ``full``: also stripped.

    Every step runs only on texts that need it; the guards are plain byte searches.
    """
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}, expected one of {LEVELS}")
    if null_as_empty:
        c = F.coalesce(c, F.lit(""))
    c = let(c, _plain_characters)
    c = let(
        c,
        lambda t: F.when(
            t.contains("  ") | t.contains("\t"), F.regexp_replace(t, r"[ \t]+", " ")
        ).otherwise(t),
    )
    if level == "light":
        return c
    c = let(
        c,
        lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t),
    )
    return c if level == "search" else strip(c)


def fold_tr(c: Column) -> Column:
    """Turkish letters to ASCII, then lower case; both capital I forms give ``i``."""
    return let(
        c,
        lambda t: F.lower(
            F.when(F.octet_length(t) == F.length(t), t).otherwise(
                F.translate(t, rules.FOLD_FROM, rules.FOLD_TO)
            )
        ),
    )


def tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def head(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def preview(c: Column, n: int, side: str = "left", mark: str = "", line_end: str = " ") -> Column:
    """First or last ``n`` characters on one line, after an optional mark."""
    cut = head(c, n) if side == "left" else tail(c, n)
    cut = F.replace(cut, F.lit("\n"), F.lit(line_end))
    return F.concat(F.lit(mark), cut) if mark else cut


def char_count(c: Column) -> Column:
    return F.length(c)


def word_count(c: Column) -> Column:
    """Number of runs of non-space characters."""
    return let(
        strip(c),
        lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WHITESPACE_RUN))),
    )


def words(c: Column) -> Column:
    """Runs of non-space characters, as an array."""
    return let(
        strip(c),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(
            F.split(t, WHITESPACE_RUN)
        ),
    )


def default_if_blank(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def still_contains(text: Column, span: Column) -> Column:
    """Whether a non-empty span is found in the text; never null."""
    return F.coalesce((F.length(span) > 0) & F.contains(text, span), F.lit(False))


def clean_label(c: Column) -> Column:
    """Reply of a naming model without quotes, marker and outer space."""
    c = F.translate(strip(c), "\"'", "")
    return strip(F.replace(c, F.lit(rules.LABEL_MARKER), F.lit("")))


def build_prompt(
    c: Column,
    instruction: str = rules.EXTRACTION_INSTRUCTION,
    tail_chars: int = rules.PROMPT_TAIL_CHARS,
) -> Column:
    return F.concat(F.lit(instruction + "\n\n"), tail(c, tail_chars))


def build_samples_prompt(samples: Column, instruction: str = rules.NAMING_INSTRUCTION) -> Column:
    """Instruction and the numbered samples of one cluster."""
    numbered = F.transform(
        samples,
        lambda s, i: F.concat(F.lit(rules.SAMPLE_WORD + " "), (i + 1).cast("string"), F.lit(": "), s),
    )
    return F.concat(F.lit(instruction + "\n\n"), F.concat_ws(rules.SAMPLE_SEPARATOR, numbered))


def tokens(c: Column, pattern: str, stop: Sequence[str] = (), lower_first: bool = False) -> Column:
    """Lower-cased matches of ``pattern`` that are not stop words."""
    if lower_first:
        found = F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))
    else:
        found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lower)
    stop = sorted(set(stop))
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def bigrams(toks: Column) -> Column:
    """Neighbours in a token array, joined by a space."""
    return let(
        toks,
        lambda a: F.transform(
            F.slice(a, 2, F.size(a)), lambda t, i: F.concat_ws(" ", F.get(a, i), t)
        ),
    )


def token_budget(c: Column, max_tokens: int, pad: bool = False, pad_token: str = "[PAD]") -> Column:
    """``struct<tokens, n_tokens, truncated>`` of at most ``max_tokens`` words."""

    def cut(a: Column) -> Column:
        kept = F.slice(a, 1, max_tokens)
        n = F.least(F.size(a), F.lit(max_tokens))
        if pad:
            kept = F.concat(kept, F.array_repeat(F.lit(pad_token), F.lit(max_tokens) - n))
        return F.struct(
            kept.alias("tokens"), n.alias("n_tokens"), (F.size(a) > max_tokens).alias("truncated")
        )

    return let(words(c), cut)
