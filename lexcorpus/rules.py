"""Heading, cue and category rules as data.

Rules are regular expressions for Spark's (Java) engine. ``ignore_case`` and
``exact_case`` add the flags: U for Unicode classes, d so that only LF ends a
line, i for case-insensitive matching.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple


class Rule(NamedTuple):
    """A pattern and literals of which every match holds at least one.

    A search for a literal is many times cheaper than a regex scan, so the
    pattern is only tried on texts that hold one of them. ``context`` is how many
    characters before a match decide whether it is one; None if that is not known.
    """

    pattern: str
    needles: tuple[str, ...] = ()
    context: int | None = None


def white_space(pattern: str) -> str:
    """``\\s`` with the separators U+001C to U+001F, which the Java class lacks."""
    return pattern.replace(r"\s", r"[\s\x1c-\x1f]")


def ignore_case(pattern: str) -> str:
    return "(?iUd)" + white_space(pattern)


def exact_case(pattern: str) -> str:
    return "(?Ud)" + white_space(pattern)


def any_of(patterns: Iterable[str]) -> str:
    """One alternation in place of several scans."""
    return "|".join(f"(?:{p})" for p in patterns)


def opening_literal(pattern: str) -> str:
    """Literal at the start of a pattern of the form ``\\b<literal>``."""
    literal = re.fullmatch(r"\\b([a-z ]*[a-z])(?:\\.*)?", pattern)
    if literal is None:
        raise ValueError(f"no opening literal: {pattern!r}")
    return literal.group(1)


def phrase_tree(phrases: Iterable[str]) -> str:
    """Alternation of phrases with shared beginnings factored out.

    Finds a phrase wherever the plain alternation does, without trying every
    phrase at every character. A phrase that begins with another one is
    dropped: the shorter one is found there anyway.
    """
    tree: dict = {}
    for phrase in phrases:
        node = tree
        for ch in phrase:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        if "" in node:
            return ""
        parts = [re.escape(ch) + pattern(rest) for ch, rest in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return pattern(tree)


# --------------------------------------------------------------------------
# Patterns, phrases and word lists that decide the results.
# --------------------------------------------------------------------------

# Headings that open the operative part, in priority order (original text).
STRICT_PATTERNS = (
    r"\b(?:H\s*Ü\s*K\s*Ü\s*M|S\s*O\s*N\s*U\s*Ç)\s*(?:[:：]|[\n\r]+)",
    r"\bG\s*E\s*R\s*E\s*Ğ\s*İ\s+D\s*Ü\s*Ş\s*Ü\s*N\s*Ü\s*L\s*D\s*Ü\s*(?:[:：]|[\n\r]+)",
)

# Headings directly before a colon (original text).
COLON_HEADING_PATTERNS = {
    "SONUÇ": r"\bSONUÇ\s*:",
    "HÜKÜM": r"\bHÜKÜM\s*:",
    "KARAR": r"\bKARAR\s*:",
    "GEREĞİ DÜŞÜNÜLDÜ": r"\bGEREĞİ\s+DÜŞÜNÜLDÜ\s*:",
}

# Headings with letters set apart (original text).
SPACED_HEADING_PATTERNS = {
    "K A R A R": r"K\s*A\s*R\s*A\s*R\s*[:：]?",
    "H Ü K Ü M": r"H\s*Ü\s*K\s*Ü\s*M\s*[:：]?",
    "S O N U Ç": r"S\s*O\s*N\s*U\s*Ç\s*[:：]?",
    "G E R E Ğ İ D Ü Ş Ü N Ü L D Ü": r"G\s*E\s*R\s*E\s*Ğ\s*İ\s+D\s*Ü\s*Ş\s*Ü\s*N\s*Ü\s*L\s*D\s*Ü\s*[:：]?",
}

# Headings counted by the audit (folded text).
AUDIT_HEADING_PATTERNS = {
    "gerekce_dusunuldu": r"\bgeregi dusunuldu\b",
    "hukum": r"\bhukum\b\s*[:\-]?",
    "karar": r"\bkarar\b\s*[:\-]?",
}

# Lines that open the decision section, in priority order (folded text).
SECTION_HEADER_PATTERNS = (
    r"(?m)^\s*(hukum|sonuc|karar sonucu|hukum sonucu)\s*[:\-]?\s*$",
    r"(?m)^\s*(hukum:)",
    r"(?m)^\s*(sonuc:)",
)

# Phrases around which a section is cut when no header exists (folded text).
SECTION_FALLBACK_PATTERNS = (
    r"\bsanigin[^\n\.]{0,180}(cezalandirilmasina|beraatine|mahkumiyetine|dusmesine|ceza verilmesine yer olmadigina)",
    r"\bmahkumiyet\b",
    r"\bberaat\b",
)

# Outcome categories of a decision section (folded text).
CATEGORY_PATTERNS = {
    "beraat": (r"\bberaat\b",),
    "hapis": (r"\bhapis\b", r"\bhurriyeti baglayici\b"),
    "adli_para_cezasi": (r"\badli para ceza", r"\bpara ceza"),
    "hagb": (r"\bhukmun aciklanmasinin geri birak", r"\bhagb\b"),
    "ceza_ertelenmesi": (r"\bcezanin ertelenmesine\b", r"\bertele\b"),
    "cvyok": (r"\bceza verilmesine yer olmadigi\b",),
    "dusme": (r"\bdavanin dusmesi\b", r"\bdusmesine\b"),
    "guvenlik_tedbiri": (r"\bguvenlik tedbiri\b", r"\btck\s*53\b"),
    "ret": (r"\btemyiz isteminin reddine\b", r"\bistinaf basvurusunun reddine\b"),
    "bozma": (r"\bbozulmasina\b", r"\bbozularak\b"),
    "onama": (r"\bonanmasina\b",),
}

# Heading (group 1) after which a text is cut when the verdict is masked.
MASK_HEADING_PATTERN = (
    r"(?:^|\n|[.!?]\s+)"
    r"((?:SONUÇ|S\s*O\s*N\s*U\s*Ç|HÜKÜM|H\s*Ü\s*K\s*Ü\s*M|KARAR|K\s*A\s*R\s*A\s*R|"
    r"NETİCE|GEREĞİ DÜŞÜNÜLDÜ)\s*[:;]?)"
)

# Phrases that give a decision away at the end of a text.
MASK_CUES = (
    "bozulmalı", "bozulmasına", "onanmalı", "onanmasına",
    "bozulmamalı", "onanmalıdır", "bozulmalıdır",
    "reddedilmeli", "reddine", "kabul edilmeli", "kabul edilmelidir", "kabulüne",
    "düzeltilerek", "ortadan kaldırılmasına", "gönderilmesine", "tevdiine",
    "bozma nedenidir", "hatalı olmuştur", "yerinde değildir", "isabetsizdir",
    "bozmayı gerektirmiştir", "bozulması gerekmiştir",
    "usul ve yasaya aykırı", "karar vermek gerekmiştir", "karar verildi",
    "yerinde görülmemiştir", "doğru görülmemiştir", "reddi gerekmiştir",
    "incelenmesine gerek görülmemiştir",
    "oybirliğiyle", "oyçokluğuyla",
)

# Words left out of the residual vocabulary report.
RESIDUAL_STOP_WORDS = (
    "ve", "veya", "ile", "bu", "şu", "o", "bir", "da", "de", "ki", "mi", "mı", "mu", "mü",
    "için", "gibi", "olan", "olarak", "çok", "az", "daha", "en", "ama", "fakat", "ise", "dır",
    "dir", "tır", "tir", "tur", "tür", "tarafından", "hakkında", "sonra", "önce", "göre",
    "yapılan", "edilen", "olup", "olduğu", "sayılı", "maddesi", "maddesine", "mahkeme",
    "mahkemesi", "dosya", "karar", "hüküm", "sonuç", "gereği", "düşünüldü", "temyiz", "istinaf",
    "dava", "davacı", "davalı", "sanık", "sanığın", "müvekkil", "vekil", "dosyanın",
)

# Words left out of the TF-IDF vocabulary.
TFIDF_STOP_WORDS = (
    "ve", "veya", "ile", "için", "gibi", "kadar", "olan", "olarak", "dava", "davası", "davaya",
    "karar", "hüküm", "tarih", "madde", "göre", "tarafından", "hakkında", "sayılı", "mahkemesi",
)

# Letters folded to ASCII, pairwise.
FOLD_FROM = "çğıöşüÇĞİÖŞÜ"
FOLD_TO = "cgiosucgiosu"

# Tokens of the residual vocabulary report.
RESIDUAL_TOKEN_PATTERN = r"[a-zA-ZçğıöşüÇĞİÖŞÜ]{3,}"

# Cluster names that hold this word are renamed.
MERGE_KEYWORD, MERGE_NAME = "Temyiz", "Temyiz Davası"

# Instruction sent with the last 2,000 characters of a text.
EXTRACTION_INSTRUCTION = (
    "Aşağıdaki hukuki metnin sadece hüküm (sonuç/karar) kısmını aynen yaz. "
    "Ekstra hiçbir yorum veya açıklama ekleme:"
)

# Instruction sent with the samples of one cluster.
NAMING_INSTRUCTION = (
    "Aşağıda aynı hukuki konuya (kategoriye) ait 10 farklı mahkeme kararının sonuç kısımları verilmiştir.\n"
    "Lütfen bu kararların ortak noktasını bularak bu gruba 1-3 kelimelik kısa bir KATEGORİ İSMİ ver.\n"
    "Örneğin: 'Ceza Davası', 'Boşanma Davası', 'İş Hukuku', 'Tazminat Davası' gibi.\n"
    "Sadece kategori ismini yaz, başka hiçbir açıklama ekleme."
)
LABEL_MARKER = "Kategori:"
SAMPLE_WORD = "Örnek"
SAMPLE_SEPARATOR = "\n\n---\n\n"

# Limits.
MIN_HEADING_POSITION = 0.5
MIN_VERDICT_CHARS = 25
MAX_VERDICT_CHARS = 1500
SECTION_CHARS, FALLBACK_BEFORE, FALLBACK_AFTER = 1400, 160, 500
MASK_MIN_POSITION, MASK_MAX_TAIL = 0.4, 8000
PROMPT_TAIL_CHARS = 2000

# --------------------------------------------------------------------------
# Rule sets with flags, as used by the operators.
# --------------------------------------------------------------------------

# the word boundary looks at one character before the heading
STRICT = tuple(Rule(ignore_case(p), context=1) for p in STRICT_PATTERNS)
COLON_HEADINGS = {k: ignore_case(p) for k, p in COLON_HEADING_PATTERNS.items()}
SPACED_HEADINGS = {k: ignore_case(p) for k, p in SPACED_HEADING_PATTERNS.items()}
AUDIT_HEADINGS = {
    k: Rule(exact_case(p), (opening_literal(p),)) for k, p in AUDIT_HEADING_PATTERNS.items()
}
SECTION_HEADERS = tuple(
    Rule(exact_case(p), needles)
    for p, needles in zip(SECTION_HEADER_PATTERNS, (("hukum", "sonuc"), ("hukum:",), ("sonuc:",)))
)
SECTION_FALLBACKS = tuple(
    Rule(exact_case(p), needles)
    for p, needles in zip(SECTION_FALLBACK_PATTERNS, (("sanigin",), ("mahkumiyet",), ("beraat",)))
)
CATEGORIES = {
    k: Rule(exact_case(any_of(ps)), tuple(opening_literal(p) for p in ps))
    for k, ps in CATEGORY_PATTERNS.items()
}
# RESIDUAL_TOKEN_PATTERN as a union of classes: ASCII letters are decided first.
RESIDUAL_TOKENS = r"[a-zA-Z[çğıöşüÇĞİÖŞÜ]]{3,}"
MASK_HEADING = ignore_case(MASK_HEADING_PATTERN)
MASK_CUE = ignore_case(phrase_tree(MASK_CUES))
