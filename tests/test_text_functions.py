import random
import re

import pytest
from pyspark.sql import functions as F

from lexcorpus import rules
from lexcorpus.functions import headings as H
from lexcorpus.functions import masking as M
from lexcorpus.functions import text as T

PIECES = [
    "HÜKÜM", "H Ü K Ü M", "hüküm", "SONUÇ", "S O N U Ç", "Sonuç", "KARAR", "K A R A R", "NETİCE",
    "GEREĞİ DÜŞÜNÜLDÜ", "gereği düşünüldü", "G E R E Ğ İ D Ü Ş Ü N Ü L D Ü", "Gereğı Düşünüldü",
    ":", "：", ";", "\n", "\n\n", "\n\n\n\n", "\r\n", "\r", "\t", "  ", " ", " ", " ", "\xa0", "**",
    ".", ". ", "! ", "? ", "reddine", "BOZULMASINA", "karar verildi", "oybirliğiyle", "onanmasına",
    "Mahkeme", "davanın kabulüne", "uzun bir cümle daha yazıldı", "😀", "ışık", "İstanbul", "a", "x y z",
    "sanığın beş yıl hapis ile cezalandırılmasına", "beraat", "mahkumiyet", "hukum:", "\nsonuc:",
    "\nHÜKÜM:\n", "\nKarar Sonucu -\n", "\nsonuç\n", "adli para cezası", "TCK 53", "davanın düşmesi", "\x1c", "\x1f", "HÜKÜM\x1d:",
]


def random_texts(n, seed, longest=45):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = rng.choices(PIECES, k=rng.randint(0, longest))
        out.append("".join(p + rng.choice(["", " ", " "]) for p in parts))
    return out


def column(spark, texts, expr):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r.v for r in df.select("i", expr.alias("v")).collect()}
    return [got[i] for i in range(len(rows))]


CANONICAL = {  # text: (light, search, full)
    "": ("", "", ""),
    " \t\n": (" \n", " \n", ""),
    "a\r\rb": ("a\n\nb", "a\n\nb", "a\n\nb"),
    "a\r\nb\rc": ("a\nb\nc",) * 3,
    "***x**": ("*x",) * 3,
    "**bold** and\xa0\xa0 on": ("bold and on",) * 3,
    "\x1c a \u2003": ("\x1c a \u2003", "\x1c a \u2003", "a"),
    "a\n\n\n\n\nb": ("a\n\n\n\n\nb", "a\n\nb", "a\n\nb"),
    "a\n\n\nb": ("a\n\n\nb", "a\n\nb", "a\n\nb"),
    "\t a": (" a", " a", "a"),
}


@pytest.mark.parametrize("level", T.LEVELS)
def test_canonicalize(spark, level):
    place = ("light", "search", "full").index(level)
    assert column(spark, list(CANONICAL), T.canonicalize(F.col("t"), level)) == [v[place] for v in CANONICAL.values()]
    texts = random_texts(800, 1)
    got = column(spark, texts, T.canonicalize(F.col("t"), level))
    assert column(spark, got, T.canonicalize(F.col("t"), level)) == got  # nothing left to do
    for text, value in zip(texts, got):
        assert not re.search("\xa0|\\*\\*|\r|\t|  ", value)
        assert re.sub(r"[\s*]", "", text) == re.sub(r"[\s*]", "", value)
        assert level == "light" or "\n\n\n" not in value
        assert level != "full" or value == value.strip()


def test_canonicalize_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    row = df.select(T.canonicalize(F.col("t")), T.canonicalize(F.col("t"), null_as_empty=True)).first()
    assert list(row) == [None, ""]
    with pytest.raises(ValueError):
        T.canonicalize(F.col("t"), "other")


def test_fold_and_counts(spark):
    texts = random_texts(300, 2) + ["ÇĞIİÖŞÜçğıöşü ABC", "", "  ", "a b\u2003c\x1cd"]
    folded = column(spark, texts, T.fold_tr(F.col("t")))
    assert folded[-4:] == ["cgiiosucgiosu abc", "", "  ", "a b\u2003c\x1cd"]
    assert all(not set(f) & set("çğıöşüÇĞİÖŞÜ") and len(f) == len(t) for f, t in zip(folded, texts))
    assert column(spark, texts, T.word_count(F.col("t"))) == [len(t.split()) for t in texts]
    assert column(spark, texts, T.words(F.col("t"))) == [t.split() for t in texts]
    assert column(spark, texts, T.char_count(F.col("t"))) == [len(t) for t in texts]


def test_preview_and_prompt(spark):
    texts = ["abc\ndef", "x" * 3000, ""]
    c = F.col("t")
    assert column(spark, texts, T.preview(c, 5, "right", "...")) == [
        "..." + t[-5:].replace("\n", " ") for t in texts
    ]
    assert column(spark, texts, T.preview(c, 300, "right", line_end="  ")) == [
        t[-300:].replace("\n", "  ") for t in texts
    ]
    assert column(spark, texts, T.preview(c, 4)) == [t[:4].replace("\n", " ") for t in texts]
    assert column(spark, texts, T.build_prompt(c)) == [
        rules.EXTRACTION_INSTRUCTION + "\n\n" + t[-2000:] for t in texts
    ]
    df = spark.createDataFrame([(["a", "b"],)], "s array<string>")
    prompt = df.select(T.build_samples_prompt(F.col("s"), "I")).first()[0]
    assert prompt == "I\n\nÖrnek 1: a\n\n---\n\nÖrnek 2: b"


def test_clean_label_and_defaults(spark):
    texts = ['"Kategori: İş Hukuku"\n', " 'Ceza'", "Kategori:", ""]
    assert column(spark, texts, T.clean_label(F.col("t"))) == ["İş Hukuku", "Ceza", "", ""]
    df = spark.createDataFrame([("",), (None,), ("a",)], "t string")
    assert [r[0] for r in df.select(T.default_if_blank(F.col("t"), "unknown")).collect()] == [
        "unknown", "unknown", "a",
    ]


def test_tokens_bigrams_budget(spark):
    texts = ["Bu KARAR çok uzun İşte ab", "", "bir iki üç dört"]
    toks = column(spark, texts, T.tokens(F.col("t"), rules.RESIDUAL_TOKEN_PATTERN, ["karar", "çok"]))
    assert toks == [["uzun", "i̇şte"], [], ["bir", "iki", "dört"]]
    grams = column(spark, texts, T.bigrams(T.tokens(F.col("t"), rules.RESIDUAL_TOKEN_PATTERN, ["çok"])))
    assert grams == [["karar uzun", "uzun i̇şte"], [], ["bir iki", "iki dört"]]
    many = random_texts(400, 7)
    want = [[w.lower() for w in re.findall(rules.RESIDUAL_TOKEN_PATTERN, t)] for t in many]
    assert column(spark, many, T.tokens(F.col("t"), rules.RESIDUAL_TOKENS)) == want
    cut = column(spark, texts, T.token_budget(F.col("t"), 3, pad=True))
    assert [r.asDict() for r in cut] == [
        {"tokens": ["Bu", "KARAR", "çok"], "n_tokens": 3, "truncated": True},
        {"tokens": ["[PAD]"] * 3, "n_tokens": 0, "truncated": False},
        {"tokens": ["bir", "iki", "üç"], "n_tokens": 3, "truncated": True},
    ]


HEADING = re.compile("|".join(f"(?:{p})" for p in rules.STRICT_PATTERNS) + r"|\Z", re.I)


@pytest.mark.parametrize("max_len", [None, 60])
def test_extract_tail_random(spark, max_len):
    texts = random_texts(3000, 3)
    light = column(spark, texts, T.canonicalize(F.col("t"), "light"))
    got = column(spark, texts, H.extract_tail(F.col("t"), max_len=max_len))
    assert 200 < sum(v is not None for v in got) < 2900
    for text, value in zip(light, got):
        late = [m for m in HEADING.finditer(text) if m[0] and m.start() > 0.5 * len(text)]
        if value is None:
            rest = text[late[-1].end() :].strip() if late else ""
            assert len(rest) <= 25 or (max_len and len(rest) > max_len) or len({m[0][0].upper() for m in late}) > 1
        else:
            before = text.rstrip().removesuffix(value).rstrip()
            assert text.rstrip().endswith(value) and 25 < len(value) <= (max_len or len(value))
            assert any(m.end() >= len(before) >= m.start() for m in late)


def test_extract_tail_edges(spark):
    pad, body = "x" * 200 + " ", "y" * 30
    texts = [
        "HÜKÜM: " + pad + body,
        pad + "HÜKÜM: " + body,
        pad + "HÜKÜM: " + body + " SONUÇ\n" + "z" * 40,
        pad + "h ü k ü m ：" + body,
        pad + "HÜKÜM: " + "y" * 25,
        pad + "HÜKÜM: " + "y" * 26,
        pad * 20 + "HÜKÜM: " + "y" * 1500,
        pad * 20 + "HÜKÜM: " + "y" * 1501,
        pad + "Gereği düşünüldü: " + body + " SONUÇ: kısa",
        pad + "no heading " + body,
    ]
    got = column(spark, texts, H.extract_tail(F.col("t"), max_len=1500))
    assert got[1] == body and got[3] == body
    assert got[0] is None and got[4] is None and got[7] is None and got[9] is None
    assert got[2] == "z" * 40 and got[5] == "y" * 26 and len(got[6]) == 1500
    assert got[8] == body + " SONUÇ: kısa"
    separated = pad + "H\x1cÜ\x1dK\x1eÜ\x1fM\x1c: " + body
    assert column(spark, [separated], H.extract_tail(F.col("t"))) == [body]
    # a heading that starts exactly at the midpoint does not count
    mid = "x" * 39 + " HÜKÜM: " + "y" * 33
    assert len(mid) == 80 and column(spark, [mid], H.extract_tail(F.col("t"))) == [None]
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(H.extract_tail(F.col("t"))).first()[0] is None


SECTIONS = [  # text, section, mode
    ("Olay.\nHÜKÜM:\nSanığın beraatine karar verildi.", "sanigin beraatine karar verildi.", "header"),
    ("a\nKarar Sonucu -\nRet", "ret", "header"),
    ("a\n hukum: ceza\nson", "ceza\nson", "header"),
    ("x sonuc: y\nsonuc: z", "z", "header"),
    ("beraat\nsonuç\nceza", "ceza", "header"),  # a header wins over a phrase before it
    ("😀" * 200 + " mahkumiyet tamam", "😀" * 159 + " mahkumiyet tamam", "fallback"),
    ("önce beraat sonra mahkumiyet", "once beraat sonra mahkumiyet", "fallback"),
    ("sanığın 5 yıl\nhapsine beraat", "sanigin 5 yil\nhapsine beraat", "fallback"),
    ("a" * 500 + " beraat " + "b" * 900, "a" * 159 + " beraat " + "b" * 499, "fallback"),
    ("p" * 2000, "p" * 1400, "prefix"),
    ("", "", "prefix"),
]
CATEGORY_CASES = {
    "sanigin beraatine": ["unknown"],
    "beraat": ["beraat"],
    "hurriyeti baglayici ceza": ["hapis"],
    "adli para cezasi": ["adli_para_cezasi"],
    "hukmun aciklanmasinin geri birakilmasina": ["hagb"],
    "cezanin ertelenmesine": ["ceza_ertelenmesi"],
    "ceza verilmesine yer olmadigi": ["cvyok"],
    "davanin dusmesi": ["dusme"],
    "guvenlik tedbiri, tck 53": ["guvenlik_tedbiri"],
    "temyiz isteminin reddine": ["ret"],
    "bozularak geri": ["bozma"],
    "onanmasina": ["onama"],
    "onanmasina, hapis ve beraat": ["beraat", "hapis", "onama"],
}


def test_sections_and_categories(spark):
    got = column(spark, [t for t, _, _ in SECTIONS], H.extract_section(F.col("t")))
    assert [(r.section, r.mode) for r in got] == [(s, m) for _, s, m in SECTIONS]
    texts = random_texts(2500, 4)
    folded = column(spark, texts, T.fold_tr(F.col("t")))
    modes = set()
    for text, row in zip(folded, column(spark, texts, H.extract_section(F.col("t")))):
        assert row.section in text and row.section == row.section.strip()
        assert row.mode != "prefix" or text[:1400].strip() == row.section
        assert len(row.section) <= 1400
        modes.add(row.mode)
    assert modes == {"header", "fallback", "prefix"}
    assert column(spark, list(CATEGORY_CASES), H.classify_rules(F.col("t"))) == list(CATEGORY_CASES.values())


def test_phrase_tree_finds_what_the_plain_list_finds():
    tree = re.compile(rules.phrase_tree(rules.MASK_CUES))
    plain = re.compile("|".join(rules.MASK_CUES))
    probes = random_texts(500, 8) + [f"x {c}y" for c in rules.MASK_CUES] + [c[:-1] for c in rules.MASK_CUES]
    assert [bool(tree.search(t)) for t in probes] == [bool(plain.search(t)) for t in probes]


def test_heading_flags(spark):
    df = spark.createDataFrame([("HÜKÜM : a KARAR:",), ("none",), (None,)], "t string")
    flags = [r[0].asDict() for r in df.select(H.heading_flags(F.col("t"), rules.COLON_HEADINGS)).collect()]
    assert [sum(f.values()) for f in flags] == [2, 0, 0]
    hits = [r[0] for r in df.select(H.heading_hits(F.col("t"), rules.COLON_HEADINGS)).collect()]
    assert hits[0] == ["HÜKÜM", "KARAR"] and hits[1] == []


CUE = re.compile("|".join(rules.MASK_CUES), re.I)


@pytest.mark.parametrize("max_tail", [8000, 60])
def test_strip_trailing_cues_random(spark, max_tail):
    texts = random_texts(3000, 5)
    full = column(spark, texts, T.canonicalize(F.col("t")))
    got = column(spark, texts, M.strip_trailing_cues(F.col("t"), max_tail=max_tail))
    for text, row in zip(full, got):
        squeezed = re.sub(r"\s", "", row.text)
        assert re.sub(r"\s", "", text).startswith(squeezed)  # only an end is taken away
        assert row.changed or squeezed == re.sub(r"\s", "", text)
        assert not CUE.search(re.split(r"(?<=[.!?])\s+", row.text)[-1])
    assert 500 < sum(r.changed for r in got) < 3000


def test_mask_span_random(spark):
    rng = random.Random(6)
    texts = random_texts(2500, 6)
    full = column(spark, texts, T.canonicalize(F.col("t")))
    spans = []
    for c in full:
        i = rng.randint(0, max(0, len(c) - 1))
        spans.append(rng.choice([c[i:i + rng.randint(0, 25)], "", None, "not there", "a"]))
    clean = column(spark, [s or "" for s in spans], T.canonicalize(F.col("t")))
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, spans)), "i int, t string, s string")
    got = {r.i: r.v for r in df.select("i", M.mask_span(F.col("t"), F.col("s"), max_tail=60).alias("v")).collect()}
    for i, (text, span) in enumerate(zip(full, clean)):
        assert got[i].removed == (span != "" and span in text) and got[i].span == span
        kept = text[: text.rindex(span)] if got[i].removed else text
        squeezed = re.sub(r"\s", "", got[i].text)
        assert re.sub(r"\s", "", kept).startswith(squeezed)
        assert got[i].cues_removed or squeezed == re.sub(r"\s", "", kept)
    assert sum(v.removed for v in got.values()) > 400


def test_mask_span_cases(spark):
    cases = [  # text, span, (masked text, span removed, cues removed)
        ("Bir. SPAN orta SPAN son", "SPAN", ("Bir. SPAN orta", True, False)),
        ("Olay anlatıldı. Dava reddine oybirliğiyle.", None, ("", False, True)),  # its paragraph goes
        ("Olay anlatıldı. Dava reddi gerekti. KARAR VERİLDİ", None, ("Olay anlatıldı. Dava reddi gerekti.", False, True)),
        ("İlk paragraf.\n\nİkinci reddine.\n\nÜçüncü onanmasına.", "", ("İlk paragraf.", False, True)),
        ("Hepsi reddine.\n\nOnanmasına.", None, ("", False, True)),
        ("Bir.\x1c\nİki.", None, ("Bir. İki.", False, False)),
        ("Bir.\n\x1c\nİki reddine.", None, ("Bir.", False, True)),
        ("a" * 39 + "\nKARAR: " + "b" * 52, None, ("a" * 39, False, True)),
        (None, "x", ("", False, False)),
        ("x" * 9000 + "\nKARAR " + "y" * 20000, None, ("x" * 9000 + "\nKARAR " + "y" * 20000, False, False)),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, t string, s string")
    got = [r.v for r in df.select("i", M.mask_span(F.col("t"), F.col("s")).alias("v")).orderBy("i").collect()]
    assert [(g.text, g.removed, g.cues_removed) for g in got] == [c[2] for c in cases]


def test_tail_looks_at_all_the_context_a_pattern_needs(spark):
    text = "w" * 30 + "MARK" + "x" * 100 + "HEAD" + "y" * 300
    pattern = "(?<=MARKx{100})HEAD"
    assert column(spark, [text], H.extract_tail(F.col("t"), [pattern], min_pos=0.2)) == ["y" * 300]
