"""Oracle side of the keyword search: English stems of all words as one SQL chain, and documents as lists of stems.

The chain works on patterns from the start (regions) and the end (suffixes) of each distinct word; only the fixed tables
of the published algorithm are shared with the Spark side."""

from __future__ import annotations

from ...operators.retrieval import STOP_WORDS
from ...operators.stemmer import DOUBLES, FIRST_REGION, KEPT, STEP2, STEP3, STEP4, WHOLE
from ..registry import oracle_view

TOK = r"'[\p{L}\p{N}_]+'"
REGION = "'^[^aeiouy]*[aeiouy]+[^aeiouy]'"
SHORT = "'([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$'"


def _list(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def _map(d: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"


def _end(suffixes) -> str:
    return f"regexp_extract(w, '({'|'.join(suffixes)})$')"


WORD_STEMS = rf"""
    with words as (select distinct unnest(regexp_extract_all(lower(content), {TOK})) as word
                   from (select content from search_docs union all select content from comments)),
    a as (select word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g') as w from words
          where length(word) > 2 and not regexp_matches(word, '[\p{{N}}_]') and word not in ({_list(WHOLE)})),
    b as (select *, case when regexp_matches(w, '^({'|'.join(FIRST_REGION)})') then length(regexp_extract(w, '^({'|'.join(FIRST_REGION)})'))
                         when regexp_matches(w, {REGION}) then length(regexp_extract(w, {REGION})) else length(w) end as r1 from a),
    c as (select *, case when regexp_matches(w[r1 + 1:], {REGION}) then r1 + length(regexp_extract(w[r1 + 1:], {REGION})) else length(w) end as r2 from b),
    d as (select word, r1, r2, case when ends_with(w, 'sses') then left(w, -2)
                 when regexp_matches(w, 'ie[ds]$') then case when length(w) > 4 then left(w, -2) else left(w, -1) end
                 when regexp_matches(w, '(us|ss)$') then w
                 when ends_with(w, 's') and regexp_matches(left(w, -2), '[aeiouy]') then left(w, -1) else w end as w from c),
    e as (select *, {_end(['eedly', 'ingly', 'edly', 'eed', 'ing', 'ed'])} as s, w in ({_list(KEPT)}) as kept from d),
    f as (select *, s <> '' and not starts_with(s, 'eed') and regexp_matches(left(w, length(w) - length(s)), '[aeiouy]') as cut,
            left(w, length(w) - length(s)) as t from e),
    g as (select word, r1, r2, kept, w as w0, case when starts_with(s, 'eed') then case when length(t) >= r1 then t || 'ee' else w end
                 when not cut then w when regexp_matches(t, '(at|bl|iz)$') then t || 'e'
                 when regexp_matches(t, '({'|'.join(DOUBLES)})$') then left(t, -1)
                 when r1 >= length(t) and regexp_matches(t, {SHORT}) then t || 'e' else t end as w from f),
    h as (select word, r1, r2, kept, w0, case when regexp_matches(w, '.[^aeiouy][yY]$') then left(w, -1) || 'i' else w end as w from g),
    i as (select *, {_end(STEP2)} as s from h),
    j as (select word, r1, r2, kept, w0, case when s = '' or length(w) - length(s) < r1 then w
                 when s = 'ogi' and not ends_with(w, 'logi') then w
                 when s = 'li' and not regexp_matches(w, '[cdeghkmnrt]li$') then w
                 else left(w, length(w) - length(s)) || ({_map(STEP2)})[s] end as w from i),
    k as (select *, {_end(STEP3)} as s from j),
    l as (select word, r1, r2, kept, w0, case when s = '' or length(w) - length(s) < r1 or (s = 'ative' and length(w) - 5 < r2) then w
                 else left(w, length(w) - length(s)) || ({_map(STEP3)})[s] end as w from k),
    m as (select *, {_end(STEP4)} as s from l),
    n as (select word, r1, r2, kept, w0, case when s = '' or length(w) - length(s) < r2 then w
                 when s = 'ion' and not regexp_matches(w, '[st]ion$') then w else left(w, length(w) - length(s)) end as w from m),
    o as (select word, case when kept then w0
                 when ends_with(w, 'e') and (length(w) - 1 >= r2 or (length(w) - 1 >= r1 and not regexp_matches(left(w, -1), {SHORT}))) then left(w, -1)
                 when ends_with(w, 'll') and length(w) - 1 >= r2 then left(w, -1) else w end as w from n)
    select word, replace(w, 'Y', 'y') as stem from o
    union all select word, coalesce(({_map(WHOLE)})[word], word) from words where word not in (select word from o)"""


def _docs(source: str) -> str:
    return f"""
    with toks as (select source_type, source_id, regexp_extract_all(lower(content), {TOK}) as xs from {source}),
    each as (select source_type, source_id, unnest(xs) as word, generate_subscripts(xs, 1) as i from toks),
    held as (select source_type, source_id, list(case when word in ({_list(STOP_WORDS)}) then null else stem end order by i) as stems
             from (select each.*, stem from each inner join word_stems using (word)) group by source_type, source_id)
    select q.source_type, q.source_id, q.platform, q.content, coalesce(held.stems, []) as stems
    from {source} q left join held on held.source_type = q.source_type and held.source_id = q.source_id"""


oracle_view("word_stems", WORD_STEMS, ("search_docs", "comments"))
oracle_view("stem_docs", _docs("search_docs"), ("search_docs", "word_stems"))
oracle_view("stem_comments", _docs("(select 'comment' as source_type, comment_id as source_id, platform, content from comments)"),
            ("comments", "word_stems"))
