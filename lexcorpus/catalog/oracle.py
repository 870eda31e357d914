"""SQL for DuckDB that states what each catalogued query must return.

The SQL is built from the same fixed values (rules, limits, renderings) but
with DuckDB's own functions: positions by ``string_split_regex``, last
occurrences by reversed search, ranks by plain windows over all rows.
"""

from __future__ import annotations

from .. import rules
from ..functions.text import WHITESPACE
from ..plans import audit, datasets
from ..plans.categorize import SAMPLES_PER_CLUSTER
from .corpus import RENDER
from .queries import ECHO_CHARS, GRID, OWN_NAMES, RESIDUAL_ROWS, RUN_WORDS


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def any_case(pattern: str) -> str:
    return q("(?i)" + pattern)


def alternation(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


SPACE = q(WHITESPACE)


def trim(x: str) -> str:
    return f"trim({x}, {SPACE})"


def replaced(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, {q(old)}, {q(new)})"
    return x


def light(x: str) -> str:
    x = replaced(x, [("\xa0", " "), ("**", ""), ("\r\n", "\n"), ("\r", "\n")])
    return f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"


def search(x: str) -> str:
    return f"regexp_replace({light(x)}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def full(x: str) -> str:
    return trim(search(x))


def fold(x: str) -> str:
    return f"lower(translate({x}, {q(rules.FOLD_FROM)}, {q(rules.FOLD_TO)}))"


def words(x: str) -> str:
    return f"len(regexp_extract_all(replace({x}, {q(chr(0xA0))}, ' '), '\\S+'))"


def rank_of(key: str = "id", seed: int = 42) -> str:
    return f"md5('{seed}:' || {key}), {key}"


CORPUS = (
    "corpus as (select cast(doc_id as varchar) as id, "
    + replaced("text", RENDER)
    + " as text, source from documents)"
)
ASSIGNED = (
    "assigned as (select cast(doc_id as varchar) as id, quality * 5 + toxic * 2 as cluster_id from labels)"
)
CLUSTERED = """clustered as (
  select cast(doc_id as varchar) as id,
         n * 4 + case lang when 'de' then 0 when 'en' then 1 when 'es' then 2 else 3 end as cluster_id,
         case when n % 5 = 0 then 'x Temyiz ' || source else 'Grup ' || lang || (n % 3) end as name
  from (select *, cast(substr(source, 4) as int) as n from documents))"""
MERGED = (
    CLUSTERED
    + f""",
named as (select distinct cluster_id,
                 case when contains(name, {q(rules.MERGE_KEYWORD)}) then {q(rules.MERGE_NAME)} else name end as name
          from clustered),
firsts as (select *, min(cluster_id) over (partition by name) as f from named),
merged as (select cluster_id, dense_rank() over (order by f) - 1 as new_id, name from firsts)"""
)


def tails(name: str, max_len: int | None) -> str:
    """CTEs that end in ``name(id, text, source, verdict)``, verdict null when there is none."""
    tries = []
    for i, pattern in enumerate(rules.STRICT_PATTERNS):
        p = any_case(pattern)
        bound = f" and len(t{i}) <= {max_len}" if max_len else ""
        tries.append(
            f"case when len(h{i}) > 0 and len(n) - len(list_last(s{i})) - len(list_last(h{i})) > 0.5 * len(n)"
            f" and len(t{i}) > {rules.MIN_VERDICT_CHARS}{bound} then t{i} end"
        )
    pieces = ", ".join(
        f"string_split_regex(n, {any_case(p)}) as s{i}, regexp_extract_all(n, {any_case(p)}) as h{i}"
        for i, p in enumerate(rules.STRICT_PATTERNS)
    )
    trimmed = ", ".join(f"{trim(f'list_last(s{i})')} as t{i}" for i in range(len(rules.STRICT_PATTERNS)))
    return f"""{name}_n as (select *, {light('text')} as n from corpus),
{name}_p as (select *, {pieces} from {name}_n),
{name}_t as (select *, {trimmed} from {name}_p),
{name} as (select id, text, source, coalesce({', '.join(tries)}) as verdict from {name}_t)"""


def found(max_len: int | None = rules.MAX_VERDICT_CHARS) -> str:
    """CTEs that end in ``v``: the rows with a verdict."""
    return f"{CORPUS}, {tails('every', max_len)}, v as (select * from every where verdict is not null)"


SECTIONS = (
    f"folded as (select id, source, text, {fold('text')} as f from corpus), sections as (select *, case "
    + " ".join(
        f"when regexp_matches(f, {q(p)}) then {{'s': {trim(f'''substr(f, len(string_split_regex(f, {q(p)})[1]) + len(regexp_extract(f, {q(p)})) + 1, {rules.SECTION_CHARS})''')}, 'm': 'header'}}"
        for p in rules.SECTION_HEADER_PATTERNS
    )
    + " "
    + " ".join(
        f"when regexp_matches(f, {q(p)}) then {{'s': "
        + trim(
            f"right(string_split_regex(f, {q(p)})[1], {rules.FALLBACK_BEFORE}) || "
            f"substr(f, len(string_split_regex(f, {q(p)})[1]) + 1, len(regexp_extract(f, {q(p)})) + {rules.FALLBACK_AFTER})"
        )
        + ", 'm': 'fallback'}"
        for p in rules.SECTION_FALLBACK_PATTERNS
    )
    + f" else {{'s': {trim(f'left(f, {rules.SECTION_CHARS})')}, 'm': 'prefix'}} end as r from folded)"
)


def hits(x: str, patterns: dict[str, str], prefix: str = "(?i)") -> str:
    """List of the names whose pattern is found in ``x``."""
    cases = ", ".join(f"case when regexp_matches({x}, {q(prefix + p)}) then {q(n)} end" for n, p in patterns.items())
    return f"list_filter([{cases}], lambda h: h is not null)"


CATEGORY_LIST = (
    "categories as (select *, case when len(c) = 0 then ['unknown'] else c end as cats from (select id, source, text, f, r, "
    + hits("r.s", {n: alternation(p) for n, p in rules.CATEGORY_PATTERNS.items()}, "")
    + " as c from sections))"
)
AUDITED = f"{CORPUS}, {SECTIONS}, {CATEGORY_LIST}"


def masking(source: str, name: str = "masked") -> str:
    """CTEs from ``source(id, text, span, …)`` to ``name(…, out, removed, changed, span_text)``."""
    cue = any_case("|".join(rules.MASK_CUES))
    head = any_case(rules.MASK_HEADING_PATTERN)

    def kept(items: str) -> str:
        last = (
            f"coalesce(list_max(list_transform({items}, lambda x, i: "
            f"case when regexp_matches(x, {cue}) then 0 else i end)), 0)"
        )
        return f"list_slice({items}, 1, {last})"

    return f"""{name}_a as materialized (select *, coalesce({full('text')}, '') as t, coalesce({full('span')}, '') as span_text from {source}),
{name}_b as materialized (select *, span_text <> '' and contains(t, span_text) as removed from {name}_a),
{name}_c as materialized (select *, case when removed
    then {trim("left(t, len(t) - strpos(reverse(t), reverse(span_text)) - len(span_text) + 1)")} else t end as u from {name}_b),
{name}_d as materialized (select *, regexp_extract_all(u, {head}, 1) as hs, string_split_regex(u, {head}) as ps from {name}_c),
{name}_e as materialized (select *, case when len(hs) > 0 then len(u) - len(list_last(ps)) - len(list_last(hs)) end as cut from {name}_d),
{name}_f as materialized (select *, coalesce(cut >= 0.4 * len(u) or len(u) - cut <= {rules.MASK_MAX_TAIL}, false) as was_cut from {name}_e),
{name}_g as materialized (select *, string_split_regex(case when was_cut then {trim('left(u, cut)')} else u end, '\\n\\s*\\n') as para from {name}_f),
{name}_h as materialized (select *, {kept('para')} as para_kept from {name}_g),
{name}_i as materialized (select *, string_split(regexp_replace({trim("array_to_string(para_kept, chr(10) || chr(10))")},
    '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as sent from {name}_h),
{name}_j as materialized (select *, {kept('sent')} as sent_kept from {name}_i),
{name} as materialized (select *, {trim("array_to_string(sent_kept, ' ')")} as out,
    was_cut or len(para_kept) < len(para) or len(sent_kept) < len(sent) as changed from {name}_j)"""


LABELED = (
    f"{found()}, {ASSIGNED}, lab_in as (select id, text, verdict as span, cluster_id from v join assigned using (id)), "
    + masking("lab_in")
    + """, labeled as (select id, out as text, cluster_id as label, 'train_regex_masked' as source, span_text as verdict_text,
    removed as verdict_removed, changed as tail_cues_removed, span_text <> '' and contains(out, span_text) as possible_leakage,
    len(out) as input_char_len, len(span_text) as verdict_char_len from masked)"""
)

LENGTHS_TEMPLATE = """select metric, count(*) as n, round(avg(value), 2) as mean, median(value) as median,
  cast(list_sort(list(value))[cast(least(count(*) - 1, floor(0.95::double * count(*))) as bigint) + 1] as double) as p95,
  cast(min(value) as double) as min, cast(max(value) as double) as max
from ({rows}) group by metric"""

LENGTH_ROWS = (
    "select {chars} as metric, len(text) as value from corpus union all "
    f"select {{words}} as metric, {words('text')} as value from corpus"
)


def prevalence(source: str, patterns: dict[str, str]) -> str:
    flags = ", ".join(f"regexp_matches(n, {any_case(p)}) as h{i}" for i, p in enumerate(patterns.values()))
    number = " + ".join(f"h{i}::int" for i in range(len(patterns)))
    parts = [
        *[(name, f"h{i}") for i, name in enumerate(patterns)],
        ("any", f"{number} >= 1"),
        ("two_or_more", f"{number} >= 2"),
    ]
    rows = " union all ".join(
        f"select {q(name)} as heading, count(*) filter ({cond}) as n, count(*) as total from flags" for name, cond in parts
    )
    return (
        f"flags as (select {flags} from {source}) "
        f"select heading, n, total, case when total = 0 then 0.0 else round(n / total, 6) end as rate from ({rows})"
    )


SEARCHABLE = f"{CORPUS}, searchable as (select id, {search('text')} as n from corpus)"
RESIDUAL = (
    SEARCHABLE
    + f", rest as (select * from searchable where not regexp_matches(n, {any_case(alternation(rules.COLON_HEADING_PATTERNS.values()))}))"
)
TOKENS = (
    RESIDUAL
    + ", toks as (select id, list_filter(list_transform(regexp_extract_all(n, "
    + q(rules.RESIDUAL_TOKEN_PATTERN)
    + "), lambda w: lower(w)), lambda w: not list_contains(["
    + ", ".join(q(w) for w in rules.RESIDUAL_STOP_WORDS)
    + "], w)) as a from rest)"
)

GRAMS = (
    found()
    + ", uni as (select id, list_filter(regexp_extract_all(lower(verdict), '[\\p{L}\\p{N}_]{2,}'), lambda w: not list_contains(["
    + ", ".join(q(w) for w in rules.TFIDF_STOP_WORDS)
    + "], w)) as a from v), "
    "grams as (select id, unnest(a) as term from uni union all "
    "select id, unnest(list_transform(list_slice(a, 2, len(a)), lambda w, i: a[i] || ' ' || w)) as term from uni), "
    "freq as (select term, count(*) as tf, count(distinct id) as df from grams group by term), "
    "docs as (select count(*) as n from v), "
    "top as (select term, tf, df, n from freq, docs where df >= 10 and df <= 0.8 * n order by tf desc, term limit 10000), "
    "vocab as (select row_number() over (order by term) - 1 as idx, term, tf, df, ln((1.0 + n) / (1.0 + df)) + 1.0 as idf from top), "
    "raw as (select id, term, count(*) * any_value(idf) as w, any_value(idx) as idx from grams join vocab using (term) group by id, term), "
    "weights as (select id, term, idx, w / sqrt(sum(w * w) over (partition by id)) as weight from raw)"
)

PROMPTS = (
    f"{CORPUS}, prompts as (select id, {q(rules.EXTRACTION_INSTRUCTION + chr(10) * 2)} || "
    f"right(text, {rules.PROMPT_TAIL_CHARS}) as prompt from corpus)"
)


def one_line(x: str) -> str:
    return f"replace({x}, chr(10), ' ')"


def without(word: str, x: str) -> str:
    return f"replace({x}, {q(f' {word} ')}, ' ')"


TWO = (
    found()
    + f", two as (select id, {trim('verdict')} as a, {trim(without(RUN_WORDS[0], without(RUN_WORDS[1], 'verdict')))} as b from v)"
)


# The edit distance here counts bytes: letters of several bytes become free single ones.
WIDE = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüĞİŞğışÀâ"
NARROW = "".join(map(chr, [*range(1, 9), 11, 12, *range(14, 28), 127, 94, 95, 96, 126]))[: len(WIDE)]


def narrow(x: str) -> str:
    return f"translate({x}, {q(WIDE)}, {q(NARROW)})"


def word_set(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '\\S+'))"


def jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({word_set(a)}, {word_set(b)}))"
    return (
        f"case when {a} = '' or {b} = '' then 0.0 else "
        f"coalesce({shared} / nullif(len({word_set(a)}) + len({word_set(b)}) - {shared}, 0), 0.0) end"
    )


RUNS = (
    found()
    + ", runs as ("
    + " union all ".join(
        f"select id, {i} as run, {without(w, 'verdict')} as output from v"
        + (" where len(verdict) > 300" if i == 5 else "")
        for i, w in enumerate(RUN_WORDS, 1)
    )
    + ")"
)

SPLIT_SETS = (
    f"{found()}, ranked as (select *, row_number() over (order by {rank_of()}) as r from v), "
    "sets as (select *, case when r <= 50 then 'test' else 'train' end as part from ranked)"
)

METRICS = """scored as (select list_position(embedding, list_max(embedding)) - 1 as p, label as l from embeddings),
classes as (select distinct l as class from scored union select distinct p from scored),
stats as (select class, (select count(*) from scored where l = class and p = class) as tp,
  (select count(*) from scored where l = class) as support,
  (select count(*) from scored where p = class) as predicted from classes),
scores as (select *, case when predicted = 0 then 0.0 else tp / predicted end as precision,
  case when support = 0 then 0.0 else tp / support end as recall, 2 * tp / (support + predicted) as f1 from stats)"""


def shares(rows: str, label: str) -> str:
    """CTE ``shares(label, wanted)``: a tenth of all rows, dealt by largest remainder."""
    return (
        f"sizes as (select {label}, count(*) as n from {rows} group by 1), "
        f"shares as (select {label}, n // 10 + (row_number() over (order by n % 10 desc, {label}) "
        "<= (sum(n) over () + 9) // 10 - sum(n // 10) over ())::int as wanted from sizes)"
    )


def oracle() -> dict[str, str]:
    sql: dict[str, str] = {}

    # text
    sql["canonical_lengths"] = f"""with {CORPUS} select id, len({light('text')}) as light_chars,
        len({search('text')}) as search_chars, len({full('text')}) as full_chars, {words('text')} as words from corpus"""
    sql["canonical_text"] = f"""with {CORPUS} select id, md5({light('text')}) as light_md5, md5({search('text')}) as search_md5,
        md5({full('text')}) as full_md5, md5({fold('text')}) as folded_md5 from corpus"""
    sql["prompts_and_previews"] = f"""with {PROMPTS} select p.id, md5(prompt) as prompt_md5,
        '...' || {one_line('right(text, 50)')} as tail_preview, {one_line('left(text, 50)')} as head_preview
        from prompts p join corpus c on p.id = c.id"""
    sql["cleaned_labels"] = "select cast(doc_id as varchar) as id, source || 's' as name from documents"
    sql["token_budget"] = f"""with {CORPUS}, w as (select id, regexp_extract_all(replace(text, {q(chr(0xA0))}, ' '), '\\S+') as a from corpus)
        select id, least(len(a), 512) as n_tokens, len(a) > 512 as truncated, md5(array_to_string(a[1:512], ' ')) as tokens_md5 from w"""

    # extraction
    sql["extraction_rate_by_source"] = f"""with {CORPUS}, {tails('every', rules.MAX_VERDICT_CHARS)}
        select source, count(*) as total, count(verdict) as extracted, count(*) - count(verdict) as remaining,
        round(100.0 * count(verdict) / count(*), 2) as rate from every group by source"""
    sql["extract_tail_rows"] = f"with {found(None)} select id, verdict from v"
    sql["extract_bounded_rows"] = f"with {found()} select id, verdict from v"
    both = (
        f"{CORPUS}, {tails('old', None)}, {tails('new', rules.MAX_VERDICT_CHARS)}, "
        "pairs as (select old.id, old.verdict as a, new.verdict as b, "
        "case when old.verdict is not null and new.verdict is null then len(old.verdict) end as n "
        "from old join new on old.id = new.id)"
    )
    sql["compare_extractors"] = f"""with {both} select count(a) as a_count, count(b) as b_count, count(n) as eliminated,
        round(avg(n), 2) as mean_length, min(n) as min_length, max(n) as max_length from pairs"""
    sql["eliminated_sample"] = f"""with {both} select id, n as eliminated_length from pairs where n is not null
        order by {rank_of()} limit 20"""
    sql["section_rows"] = f"with {CORPUS}, {SECTIONS} select id, r.m as mode, md5(r.s) as section_md5 from sections"
    sql["section_modes"] = f"with {CORPUS}, {SECTIONS} select r.m as mode, count(*) as n from sections group by 1"
    sql["rule_categories"] = f"""with {AUDITED} select category, count(*) as n
        from (select unnest(cats) as category from categories) group by 1"""
    audit_hits = hits("f", rules.AUDIT_HEADING_PATTERNS, "")
    sql["heading_flags"] = f"with {CORPUS}, {SECTIONS} select id, array_to_string({audit_hits}, '|') as headings from sections"
    sql["heading_prevalence"] = f"with {SEARCHABLE}, {prevalence('searchable', rules.COLON_HEADING_PATTERNS)}"
    sql["residual_prevalence"] = f"with {RESIDUAL}, {prevalence('rest', rules.SPACED_HEADING_PATTERNS)}"
    sql["residual_terms"] = f"""with {TOKENS} select term, count(*) as n from (select unnest(a) as term from toks)
        group by 1 order by n desc, term limit 40"""
    sql["residual_bigrams"] = f"""with {TOKENS} select bigram, count(*) as n from (
        select unnest(list_transform(list_slice(a, 2, len(a)), lambda w, i: a[i] || ' ' || w)) as bigram from toks)
        group by 1 order by n desc, bigram limit 40"""
    picked = RESIDUAL + f", picked as (select * from rest order by {rank_of()} limit {RESIDUAL_ROWS})"
    sampled = TOKENS.replace(RESIDUAL, picked).replace("from rest)", "from picked)")
    sql["residual_sample_terms"] = f"""with {sampled} select term, count(*) as n from (select unnest(a) as term from toks)
        group by 1 order by n desc, term limit 40"""
    sql["residual_sample_examples"] = f"with {picked} select id, left(n, 500) as example from picked order by {rank_of()} limit 5"

    # masking
    sql["mask_rows"] = f"""with {CORPUS}, {tails('every', rules.MAX_VERDICT_CHARS)},
        pairs as (select id, text, verdict as span from every), {masking('pairs')}
        select id, md5(out) as text_md5, len(out) as chars, removed, changed as cues_removed,
        span_text <> '' and contains(out, span_text) as leak from masked"""
    sql["trailing_cue_rows"] = f"""with {CORPUS}, pairs as (select id, text, '' as span from corpus), {masking('pairs')}
        select id, md5(out) as text_md5, changed from masked"""
    sql["labeled_frame"] = f"with {LABELED} select {', '.join(datasets.LABELED_COLUMNS)} from labeled"
    sql["leakage_rate"] = f"""with {LABELED} select label, count(*) as rows, round(avg(verdict_removed::int), 4) as removal_rate,
        round(avg(possible_leakage::int), 4) as leakage_rate from labeled group by label"""

    # counts and statistics
    rows = LENGTH_ROWS.format(chars="'chars'", words="'words'")
    sql["length_stats"] = f"with {CORPUS} {LENGTHS_TEMPLATE.format(rows=rows)}"
    sql["value_counts"] = "select source, lang, count(*) as n from documents group by 1, 2"
    sql["top_sources"] = """select host, count(*) as n from (select regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host from pages)
        group by 1 order by n desc, host limit 20"""
    audit_lengths = LENGTHS_TEMPLATE.format(
        rows=LENGTH_ROWS.format(chars="'char_length'", words="'word_length'")
    )
    stat_rows = " union all ".join(f"select metric, '{s}' as key, {s} as value from lens" for s in audit.STATS)
    sql["audit_metrics"] = f"""with {AUDITED}, heads as (select unnest({audit_hits}) as h from categories), lens as ({audit_lengths}),
        srcs as (select source, count(*) as n from corpus group by 1 order by n desc, source limit 20)
        select 'rows' as metric, '' as key, cast(count(*) as double) as value from corpus
        union all select 'mode', r.m, count(*) from categories group by 2
        union all select 'category', c, count(*) from (select unnest(cats) as c from categories) group by 2
        union all select 'heading', h, count(*) from heads group by 2
        union all select 'heading_rate', h, round(count(*) / (select count(*) from corpus), 4) from heads group by 2
        union all select 'source_top', source, n from srcs
        union all {stat_rows}"""
    sql["audit_predictions"] = f"""with {AUDITED} select id, source, r.m as extraction_mode, array_to_string(cats, '|') as predicted_categories,
        {one_line('left(r.s, 500)')} as decision_excerpt, {one_line('left(f, 200)')} as text_preview from categories"""
    sql["audit_examples"] = f"""with {AUDITED}, listed as (select id, unnest(cats) as category, left(r.s, {audit.EXAMPLE_CHARS}) as example from categories)
        select category, id, example from (select *, row_number() over (partition by category order by {rank_of()}) as r from listed)
        where r <= {audit.EXAMPLES}"""
    lens = "select metric, " + ", ".join(audit.STATS) + f" from ({audit_lengths})"
    stats = ", ".join(
        f"(select {s} from lens where metric = '{part}_length') as {part}_{s}" for part in ("char", "word") for s in audit.STATS
    )

    def listed(name: str, rows: str) -> str:
        return f"(select string_agg(k || '=' || n, '|' order by k || '=' || n) from ({rows})) as {name}"

    sql["audit_report"] = f"""with {AUDITED}, lens as ({lens}), total as (select count(*) as n from documents),
        heads as (select h as k, count(*) as n from (select unnest({audit_hits}) as h from categories) group by 1),
        named as (select id, unnest(cats) as category, left(r.s, {audit.EXAMPLE_CHARS}) as example from categories),
        chosen as (select category as k, string_agg(example, ';' order by example) as n from (
            select *, row_number() over (partition by category order by {rank_of()}) as r from named) where r <= {audit.EXAMPLES} group by 1)
        select n as total_rows, n as sample_size, {stats},
        (select string_agg(source || '=' || c, '|' order by c desc, source) from (
            select source, count(*) as c from corpus group by 1 order by 2 desc, 1 limit 20)) as sources,
        {listed('heading_counts', 'select * from heads')},
        {listed('extraction_mode_counts', 'select r.m as k, count(*) as n from categories group by 1')},
        {listed('category_counts', 'select category as k, count(*) as n from named group by 1')},
        {listed('heading_rates', 'select k, cast(round(round(heads.n / total.n, 4) * 10000) as int) as n from heads, total')},
        md5({listed('x', 'select * from chosen').rsplit(' as ', 1)[0]}) as examples_md5 from total"""
    sql["price_stats"] = " union all ".join(
        f"""select '{m}' as metric, count({c}) as n, round(avg({c}), 2) as mean, median({c})::double as median,
        (list({c} order by {c}))[least(count({c}) - 1, count({c}) * 95 // 100) + 1]::double as p95,
        min({c})::double as min, max({c})::double as max from lineitem"""
        for m, c in (("price", "l_extendedprice"), ("quantity", "l_quantity"), ("order", "l_orderkey"))
    )
    sql["residual_bigrams_top"] = sql["residual_bigrams"]
    sql["quality_summary"] = f"""with {LABELED}
        select 'rows_per_source' as metric, source as key, cast(count(*) as double) as value from labeled group by source
        union all select 'rows_per_label', cast(label as varchar), count(*) from labeled group by label
        union all select 'rate', 'verdict_removed', round(avg(verdict_removed::int), 4) from labeled
        union all select 'rate', 'possible_leakage', round(avg(possible_leakage::int), 4) from labeled"""

    # samples and splits
    ids = "select cast(doc_id as varchar) as id, source from documents"
    sql["sample_exact"] = f"select id, source from ({ids}) order by {rank_of()} limit 150"
    sql["slice_rows"] = f"select id, source from ({ids}) order by {rank_of()} limit 75 offset 50"
    sql["shuffle_rows"] = ids
    sql["holdout_split"] = f"with {SPLIT_SETS} select id, source, verdict, part as split from sets"
    sql["stratified_split"] = f"""with {ASSIGNED}, {shares('assigned', 'cluster_id')}, ranked as (
        select *, row_number() over (partition by cluster_id order by {rank_of()}) as r from assigned)
        select id, cluster_id, case when r <= wanted then 'test' else 'train' end as split from ranked join shares using (cluster_id)"""
    sql["stratified_split_many_labels"] = f"""with rows as (select o_orderkey as id, o_custkey % 400 as label from orders),
        {shares('rows', 'label')}, ranked as (select *, row_number() over (partition by label order by {rank_of()}) as r from rows)
        select id, label, case when r <= wanted then 'test' else 'train' end as split from ranked join shares using (label)"""
    sql["sample_exact_repeated_keys"] = """select conv_id, turn, role from conversations order by md5('42:' || role), role,
        md5('42:{\"conv_id\":' || conv_id || ',\"turn\":' || turn || ',\"role\":\"' || role || '\"}') limit 50"""
    sql["sample_per_group_nulls"] = """select l_orderkey, l_linenumber, flag from (
        select *, row_number() over (partition by flag order by md5('42:' || k), k) as r
        from (select *, nullif(l_returnflag, 'R') as flag, l_orderkey || ':' || l_linenumber as k from lineitem)) where r <= 700"""
    owned = "owned as (select " + ", ".join(f"{c} as {n}" for n, c in OWN_NAMES.items()) + " from orders)"
    sql["sample_exact_own_names"] = f"with {owned} select * from owned order by {rank_of()} limit 700"
    sql["sample_ties_own_names"] = "select 700 as rows, 700 as ids, 0 as wrong"
    sql["slice_rows_own_names"] = f"with {owned} select * from owned order by {rank_of()} limit 300 offset 100"
    sql["sample_per_group_own_names"] = f"""with {owned} select * from owned
        qualify row_number() over (partition by n order by {rank_of()}) <= 50"""
    sql["stratified_split_own_names"] = f"""with {owned}, {shares('owned', 'b')}, ranked as (
        select *, row_number() over (partition by b order by {rank_of()}) as r from owned)
        select {", ".join(f"ranked.{n}" for n in OWN_NAMES)}, case when r <= shares.wanted then 'test' else 'train' end as split
        from ranked join shares using (b)"""
    sql["sample_per_group"] = f"""select id, source from (select *, row_number() over (partition by source order by {rank_of()}) as r from ({ids}))
        where r <= 10"""
    sql["sample_per_group_large"] = """select l_orderkey, l_linenumber, l_returnflag from (
        select *, row_number() over (partition by l_returnflag order by md5('42:' || k), k) as r
        from (select *, l_orderkey || ':' || l_linenumber as k from lineitem)) where r <= 2000"""

    # labels
    sql["label_lookup"] = f"""with {CLUSTERED} select c.id, c.cluster_id, d.source, c.name as category
        from clustered c join documents d on c.id = cast(d.doc_id as varchar)"""
    sql["labeled_and_unlabeled"] = f"""select id, source, case when id in (select cast(doc_id as varchar) from labels)
        then 'labeled' else 'other' end as side from ({ids})"""
    sql["union_sources"] = """select doc_id as id, len(text) as chars, lang, 'documents' as origin from documents
        union all select page_id, len(html), null, 'pages' from pages"""
    sql["reindex_labels"] = f"with {ASSIGNED} select id, dense_rank() over (order by cluster_id) - 1 as cluster_id from assigned"
    sql["distinct_labels"] = f"with {ASSIGNED} select cluster_id as label from assigned union select label from embeddings"
    sql["class_weights"] = f"""with {ASSIGNED}, c as (select i as cluster_id, (select count(*) from assigned a where a.cluster_id = i) as n
        from range(8) t(i))
        select cluster_id, n, round(sum(greatest(n, 1)) over () / (8 * greatest(n, 1)), 6) as weight from c"""
    sql["label_names"] = f"""with {CLUSTERED}, {ASSIGNED}, names as (select distinct cluster_id, name from clustered where contains(name, {q(rules.MERGE_KEYWORD)}))
        select l.label, coalesce(n.name, 'LABEL_' || l.label) as name from (select distinct cluster_id as label from assigned) l
        left join names n on n.cluster_id = l.label"""
    sql["merge_clusters"] = f"with {MERGED} select distinct new_id as cluster_id, name from merged"
    moved = "select c.id, m.new_id as cluster_id from clustered c join merged m using (cluster_id)"
    sql["merged_assignments"] = f"with {MERGED} {moved}"

    # similarity and runs
    sql["similarity_levenshtein"] = f"""with {TWO} select id, round(case when a = '' or b = '' then 0.0
        else 1.0 - levenshtein({narrow('a')}, {narrow('b')}) / greatest(len(a), len(b)) end, 6) as score from two"""
    sql["similarity_jaccard"] = f"with {TWO} select id, round({jaccard('a', 'b')}, 6) as score from two"
    sql["mean_similarity"] = f"""with {TWO} select count(*) as rows, round(avg({jaccard('a', 'b')}), 4) as mean_score from two"""
    wide = ", ".join(f"md5(max(output) filter (run = {i})) as run_{i}_output" for i in range(1, 6))
    sql["runs_wide"] = f"with {RUNS} select id, {wide} from runs group by id"
    sql["run_consistency"] = f"""with {RUNS}, pairs as (select a.id, {jaccard('a.output', 'b.output')} as s
        from runs a join runs b on a.id = b.id and a.run < b.run)
        select id, round(avg(s), 6) as avg_consistency_score from pairs group by id"""

    # model-backed columns
    sql["pending_records"] = f"select id, source from ({ids}) where id not in (select cast(doc_id as varchar) from labels)"
    echo = f"md5(right(prompt, {ECHO_CHARS}))"
    sql["repeat_runs"] = f"""with {PROMPTS} select id, run, {echo} as output_md5, 'ok' as status, 1 as attempts
        from prompts cross join (values (1), (2)) r(run)"""
    sql["enrich_resume"] = f"""with {PROMPTS} select id, {echo} as output_md5, 'ok' as status,
        case when id in (select cast(doc_id as varchar) from labels) then 'first' else 'second' end as batch from prompts"""
    sql["enrich_bucketed"] = sql["enrich_resume"]
    sql["comparison_set"] = f"""with {found(None)}, picked as (select * from v order by {rank_of()} limit 100)
        select id, '...' || {one_line('right(text, 500)')} as text_tail_preview, verdict,
        right({q(rules.EXTRACTION_INSTRUCTION + chr(10) * 2)} || right(text, {rules.PROMPT_TAIL_CHARS}), {ECHO_CHARS}) as hukum_text_llm from picked"""
    sql["consistency_report"] = f"""with {found(None)}, picked as (select * from v order by {rank_of()} limit 100)
        select id, verdict, 1.0::double as avg_consistency_score,
        md5(right({q(rules.EXTRACTION_INSTRUCTION + chr(10) * 2)} || right(text, {rules.PROMPT_TAIL_CHARS}), {ECHO_CHARS})) as run_5_md5 from picked"""

    # features and metrics
    sql["tfidf_vocabulary"] = f"with {GRAMS} select idx, term, tf, df, round(idf, 6) as idf from vocab"
    sql["tfidf_weights"] = f"with {GRAMS} select id, term, round(weight, 6) as weight from weights"
    sql["tfidf_vectors"] = f"""with {GRAMS} select id, count(*) as terms, round(sum(weight), 6) as total, max(idx) as last_idx
        from weights group by id"""
    sql["categorize_from_map"] = f"""with {MERGED} select c.id, d.source, m.new_id as cluster_id, m.name as category
        from clustered c join merged m using (cluster_id) join documents d on c.id = cast(d.doc_id as varchar)"""
    sql["cluster_prompt_names"] = f"""with {CORPUS}, {ASSIGNED},
        ranked as (select cluster_id, text, row_number() over (partition by cluster_id order by {rank_of()}) as k
          from corpus join assigned using (id)),
        numbered as (select cluster_id, text, row_number() over (partition by cluster_id order by text) as i
          from ranked where k <= {SAMPLES_PER_CLUSTER}),
        prompts as (select cluster_id, {q(rules.NAMING_INSTRUCTION + chr(10) * 2)} || string_agg(
          {q(rules.SAMPLE_WORD + ' ')} || i || ': ' || text, {q(rules.SAMPLE_SEPARATOR)} order by i) as prompt
          from numbered group by cluster_id)
        select cluster_id, {trim(f"""replace(translate({trim("right(prompt, 200)")}, {q(chr(34) + chr(39))}, ''), {q(rules.LABEL_MARKER)}, '')""")} as name,
          md5(prompt) as prompt_md5 from prompts"""
    sql["cluster_check"] = f"with {found()} select count(*) as rows, count(distinct id) as ids, 0 as outside, 0 as unnamed from v"
    sql["classifier_check"] = f"""with {LABELED} select (count(*) + 9) // 10 as rows, 0 as outside, true as same_accuracy
        from labeled where verdict_text <> ''"""
    sql["categorize_saved"] = f"with {found()} select count(*) as rows, 0 as wrong, 0 as unnamed from v"
    sql["cluster_nearest_check"] = sql["categorize_saved"]
    sql["minibatch_check"] = f"with {found()} select count(*) as rows, 10 as centers, true as same, true as within_5_percent from v"
    sql["classifier_selection"] = f"""with {LABELED} select count(*) * {len(GRID)} as predicted, {len(GRID)} as entries, 0 as wrong,
        true as best_taken from labeled where verdict_text <> ''"""
    sql["classifier_fit_check"] = f"""with {LABELED} select count(*) as rows, count(distinct label) as classes, 0 as off
        from labeled where verdict_text <> ''"""
    sql["classification_metrics"] = f"""with {METRICS} select cast(sum(support) as bigint) as rows, round(sum(tp) / sum(support), 6) as accuracy,
        round(avg(f1), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1 from scores"""
    sql["class_scores"] = f"""with {METRICS} select class, tp, support, predicted, round(precision, 6) as precision,
        round(recall, 6) as recall, round(f1, 6) as f1 from scores"""

    # whole flows, sources and sinks
    every = f"""{SPLIT_SETS}, {ASSIGNED},
        lab_in as (select id, text, verdict as span, cluster_id, part, verdict from sets join assigned using (id)), {masking('lab_in')},
        usable as (select *, row_number() over (partition by cluster_id order by {rank_of()}) as k
          from masked where part = 'train' and len(out) > 0), {shares('usable', 'cluster_id')},
        every_row as (
          select id, cluster_id as label, 'train_regex_masked' as source,
            case when k <= wanted then 'test' else 'train' end as split, removed, changed, span_text, out, null as llm
          from usable join shares using (cluster_id)
          union all select id, cluster_id, 'gold_regex_masked', 'test', removed, changed, span_text, out, left(verdict, 20) from masked where part = 'test')"""
    sql["finetune_set"] = f"""with {every} select id, label, source, split, removed as verdict_removed, changed as tail_cues_removed,
          span_text <> '' and contains(out, span_text) as possible_leakage, md5(out) as text_md5, llm as llm_verdict_text from every_row"""
    sql["finetune_written"] = f"with {every} select id, md5(out) as text_md5, label, source, split from every_row"
    sql["quality_summary_all"] = f"""with {every}, leaks as (select *, span_text <> '' and contains(out, span_text) as leak from every_row)
        select 'rows_per_source' as metric, source as key, cast(count(*) as double) as value from leaks group by source
        union all select 'rows_per_label', cast(label as varchar), count(*) from leaks group by label
        union all select 'rate', 'verdict_removed', round(avg(removed::int), 4) from leaks
        union all select 'rate', 'possible_leakage', round(avg(leak::int), 4) from leaks"""
    sql["quality_rows"] = f"with {LABELED} select id, label, md5(text) as text_md5, md5(verdict_text) as span_md5 from labeled"
    sql["cleaned_shards"] = f"with {CORPUS} select id, md5({full('text')}) as clean_md5, true as has_shard from corpus"
    sql["ingest_corpus"] = "select doc_id, md5(text) as text_md5, lang, source, n_chars from documents"
    sql["label_map_import"] = f"with {MERGED} select c.id, m.new_id as cluster_id, m.name as category from clustered c join merged m using (cluster_id)"
    sql["peek_rows"] = "select doc_id, lang, source from documents order by doc_id limit 10"
    sql["categorize_together"] = f"""with {MERGED} select c.id, d.source, m.new_id as cluster_id, m.name as category,
        case when d.doc_id in (select doc_id from labels) then 'train' else 'test' end as part
        from clustered c join merged m using (cluster_id) join documents d on c.id = cast(d.doc_id as varchar)"""
    sql["separator_headings"] = sql["extract_bounded_rows"]
    sql["merge_clusters_unchanged"] = f"""with {CLUSTERED} select id, cluster_id,
        case when cluster_id = 1 then 'x Temyiz' else 'Grup ' || cluster_id end as category from clustered"""
    sql["label_ids"] = f"""with {ASSIGNED} select distinct cluster_id as label,
        case cluster_id when 0 then 'sıfır' when 5 then 'beş' else 'LABEL_' || cluster_id end as name from assigned"""
    sql["corpus_roundtrip"] = f"with {SPLIT_SETS} select id, verdict, part as split from sets where part = 'test'"
    sql["csv_roundtrip"] = f"with {found()} select id, source, verdict from v"
    sql["label_map_roundtrip"] = f"with {MERGED} select c.id, m.new_id as cluster_id, m.name as category from clustered c join merged m using (cluster_id)"
    rule, end = "-" * 40, "=" * 80
    tail_text = "'...' || replace(right(text, 300), chr(10), '  ')"
    block = (
        f"['DECISION: ' || id, {q(rule)}, 'END OF THE TEXT:', {tail_text}, '', 'EXTRACTED:', replace(verdict, chr(10), '  '), '', {q(end)}]"
    )
    sql["text_report"] = f"""with {found()} select md5(line) as line_md5, count(*) as count
        from (select unnest({block}) as line from v) group by 1"""
    sql["stream_extract"] = sql["extract_bounded_rows"]
    sql["stream_enrich"] = f"with {PROMPTS} select id, {echo} as output_md5, 'ok' as status from prompts"
    sql["stream_enrich_state"] = sql["stream_enrich"]
    return sql
