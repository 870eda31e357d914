"""Columns that find headings and cut or label the text behind them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from .. import rules
from .bind import let
from .text import canonicalize, fold_tr, head, strip, tail


def holds_needle(text: Column, rule: rules.Rule | str) -> Column | None:
    """Cheap condition that every match of the rule needs; None when there is none."""
    needles = rule.needles if isinstance(rule, rules.Rule) else ()
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles]) if needles else None


def pattern_of(rule: rules.Rule | str) -> str:
    return rule.pattern if isinstance(rule, rules.Rule) else rule


def matches(text: Column, rule: rules.Rule | str) -> Column:
    """``rlike`` behind the search for the rule's literals."""
    hit = text.rlike(pattern_of(rule))
    needle = holds_needle(text, rule)
    return hit if needle is None else needle & hit


def last_match_start(text: Column, pieces: Column, pattern: str, group: int = 0) -> Column:
    """Code-point offset of ``group`` in the last match; the group must end the match.

    ``pieces`` is ``split(text, pattern)``. Lengths count code points, whereas
    offsets of the regex functions count UTF-16 units.
    """
    hit = F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))
    return F.length(text) - F.length(F.element_at(pieces, -1)) - F.length(hit)


def extract_tail(
    c: Column,
    patterns: Sequence[rules.Rule | str] = rules.STRICT,
    min_pos: float = rules.MIN_HEADING_POSITION,
    min_len: int = rules.MIN_VERDICT_CHARS,
    max_len: int | None = None,
) -> Column:
    """Text after the last heading in the later part of the text, or null.

    Patterns are tried in order; a pattern whose tail is too short (or longer
    than ``max_len``) gives way to the next one. When every rule declares its
    context, only the part of the text where a heading counts is scanned. A pattern must not be able to match
    inside another match of itself; then the last match is the same wherever
    the scan starts, and one ``split`` finds its tail.
    """

    def by_pattern(n: Column, late: Column, pattern: str) -> Column:
        def accept(pieces: Column, found: Column) -> Column:
            ok = (F.size(pieces) > 1) & (F.length(found) > min_len)
            if max_len is not None:
                ok = ok & (F.length(found) <= max_len)
            # the offset needs a second scan: asked last
            start = n - F.length(late) + last_match_start(late, pieces, pattern)
            return F.when(ok & (start > n * F.lit(float(min_pos))), found)

        return let(
            F.split(late, pattern),
            lambda pieces: let(strip(F.element_at(pieces, -1)), lambda f: accept(pieces, f)),
        )

    def tails(n: Column, late: Column) -> Column:
        return F.coalesce(*[by_pattern(n, late, pattern_of(p)) for p in patterns])

    def scanned(text: Column, n: Column) -> Column:
        contexts = [p.context if isinstance(p, rules.Rule) else None for p in patterns]
        if None in contexts:
            return tails(n, text)
        kept = n - F.floor(n * F.lit(float(min_pos))).cast("int") + max(contexts, default=0)
        return let(F.right(text, kept), lambda late: tails(n, late))

    return let(
        canonicalize(c, "light"), lambda t: let(F.length(t), lambda n: scanned(t, n))
    )


def extract_section(
    c: Column,
    max_chars: int = rules.SECTION_CHARS,
    headers: Sequence[rules.Rule | str] = rules.SECTION_HEADERS,
    fallbacks: Sequence[rules.Rule | str] = rules.SECTION_FALLBACKS,
    folded: bool = False,
) -> Column:
    """``struct<section, mode>``: behind a header line, around a phrase, or the start.

    The first pattern in list order that matches anywhere decides. ``folded``
    says that the column went through :func:`fold_tr` already.
    """

    def named(section: Column, mode: str) -> Column:
        return F.struct(strip(section).alias("section"), F.lit(mode).alias("mode"))

    def cut(text: Column, rule: rules.Rule | str, piece) -> Column:
        pattern = pattern_of(rule)
        found = let(F.split(text, pattern, 2), lambda p: F.when(F.size(p) == 2, piece(p, pattern)))
        needle = holds_needle(text, rule)
        return found if needle is None else F.when(needle, found)

    def after_header(text: Column, rule: rules.Rule | str) -> Column:
        return cut(
            text, rule, lambda p, _: named(head(F.get(p, F.lit(1)), max_chars), "header")
        )

    def around_phrase(text: Column, rule: rules.Rule | str) -> Column:
        def around(p: Column, pattern: str) -> Column:
            before = tail(F.get(p, F.lit(0)), rules.FALLBACK_BEFORE)
            after = head(F.get(p, F.lit(1)), rules.FALLBACK_AFTER)
            return named(F.concat(before, F.regexp_extract(text, pattern, 0), after), "fallback")

        return cut(text, rule, around)

    return let(
        c if folded else fold_tr(c),
        lambda t: F.coalesce(
            *[after_header(t, p) for p in headers],
            *[around_phrase(t, p) for p in fallbacks],
            F.when(t.isNotNull(), named(head(t, max_chars), "prefix")),
        ),
    )


def heading_hits(c: Column, patterns: Mapping[str, rules.Rule | str]) -> Column:
    """Names of the patterns found in the text, in the order given."""
    return let(
        c,
        lambda t: F.filter(
            F.array(*[F.when(matches(t, p), F.lit(name)) for name, p in patterns.items()]),
            lambda n: n.isNotNull(),
        ),
    )


def heading_flags(c: Column, patterns: Mapping[str, rules.Rule | str]) -> Column:
    """One boolean per pattern, as a struct."""
    return let(
        c,
        lambda t: F.struct(
            *[F.coalesce(matches(t, p), F.lit(False)).alias(n) for n, p in patterns.items()]
        ),
    )


def classify_rules(
    section: Column, ruleset: Mapping[str, rules.Rule | str] = rules.CATEGORIES, unknown: str = "unknown"
) -> Column:
    """All categories whose phrases occur in a folded section, else ``[unknown]``."""
    return let(
        heading_hits(section, ruleset),
        lambda a: F.when(F.size(a) == 0, F.array(F.lit(unknown))).otherwise(a),
    )
