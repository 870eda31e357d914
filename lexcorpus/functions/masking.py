"""Columns that take the verdict and its cues out of a text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import rules
from .bind import let
from .headings import last_match_start
from .text import canonicalize, strip

SENTENCE_GAP = rules.exact_case(r"(?<=[.!?])\s+")
PARAGRAPH_GAP = rules.exact_case(r"\n\s*\n")


def _drop_trailing(items: Column, cue: str) -> Column:
    """Array without the trailing run of elements that hold a cue.

    Most texts end without a cue, so the last element is looked at first; the
    whole array is scanned only when it has one.
    """
    keep = F.array_max(
        F.transform(items, lambda s, i: F.when(s.rlike(cue), F.lit(0)).otherwise(i + 1))
    )
    return F.when(
        F.element_at(items, -1).rlike(cue), F.slice(items, F.lit(1), F.coalesce(keep, F.lit(0)))
    ).otherwise(items)


def _strip_canonical(
    text: Column, heading: str, cue: str, min_frac: float, max_tail: int
) -> Column:
    """``struct<text, changed>`` for a text in canonical form."""

    def at_heading(pieces: Column) -> Column:
        start = last_match_start(text, pieces, heading, group=1)
        late = (start >= F.length(text) * F.lit(float(min_frac))) | (
            F.length(text) - start <= max_tail
        )
        # nested when: the offset is only asked for when there is a match
        return F.when(F.size(pieces) > 1, F.when(late, strip(F.left(text, start))))

    def sentences(before: Column, body: Column) -> Column:
        return let(
            F.split(body, SENTENCE_GAP),
            lambda a: let(
                _drop_trailing(a, cue),
                lambda kept: F.struct(
                    strip(F.array_join(kept, " ")).alias("text"),
                    (before | (F.size(kept) < F.size(a))).alias("changed"),
                ),
            ),
        )

    def paragraphs(cut: Column) -> Column:
        return let(
            F.split(F.coalesce(cut, text), PARAGRAPH_GAP),
            lambda a: let(
                _drop_trailing(a, cue),
                lambda kept: sentences(
                    cut.isNotNull() | (F.size(kept) < F.size(a)),
                    strip(F.array_join(kept, "\n\n")),
                ),
            ),
        )

    return let(F.split(text, heading), lambda pieces: let(at_heading(pieces), paragraphs))


def strip_trailing_cues(
    c: Column,
    heading: str = rules.MASK_HEADING,
    cue: str = rules.MASK_CUE,
    min_frac: float = rules.MASK_MIN_POSITION,
    max_tail: int = rules.MASK_MAX_TAIL,
) -> Column:
    """``struct<text, changed>``: cut at the last late heading, then drop trailing
    paragraphs and trailing sentences that hold a cue."""
    return let(
        canonicalize(c, null_as_empty=True),
        lambda t: _strip_canonical(t, heading, cue, min_frac, max_tail),
    )


def mask_span(
    text: Column,
    span: Column,
    heading: str = rules.MASK_HEADING,
    cue: str = rules.MASK_CUE,
    min_frac: float = rules.MASK_MIN_POSITION,
    max_tail: int = rules.MASK_MAX_TAIL,
) -> Column:
    """``struct<text, removed, cues_removed, span>``.

    Keeps what lies before the last occurrence of the span, then strips
    trailing cues. ``span`` in the result is the canonical span.
    """

    def cut(t: Column, v: Column) -> Column:
        # what follows the last occurrence, by a byte search from the right
        rest = F.call_function("substring_index", t, v, F.lit(-1))
        start = F.length(t) - F.length(rest) - F.length(v)
        return F.when((v != "") & F.contains(t, v), strip(F.left(t, start)))

    def masked(t: Column, v: Column) -> Column:
        return let(
            cut(t, v),
            lambda before: let(
                _strip_canonical(F.coalesce(before, t), heading, cue, min_frac, max_tail),
                lambda s: F.struct(
                    s["text"].alias("text"),
                    before.isNotNull().alias("removed"),
                    s["changed"].alias("cues_removed"),
                    v.alias("span"),
                ),
            ),
        )

    return let(
        canonicalize(text, null_as_empty=True),
        lambda t: let(canonicalize(span, null_as_empty=True), lambda v: masked(t, v)),
    )
