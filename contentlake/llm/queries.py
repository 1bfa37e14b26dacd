"""The registered queries of this subpackage: name -> fn(spark, sf_dir), and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (best_fit_packing, bit_sliced_topk, curriculum, importance_resampling, jaccard_join, language_id, license_scan,
               piece_codec, prefix_trie, pseudonyms, quality_rules, rule_ensemble, url_filter)
from .common import begin, table


# The rules of the url query.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin(spark)
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    rows, v = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return rows.select("page_id", f"{v}.*")


OP1_SQL = """
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select * from (values """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + """) as t(rh, rp, v)),
m as (select h.*, (select max(struct_pack(n := length(rh) + length(rp), m := length(rh), r := rh || rp, v := v)) from r
      where (h.host = rh or ends_with(h.host, '.' || rh)) and starts_with(h.path, rp)) as b from h)
select page_id, host, path, b.r as rule, coalesce(b.v, 'allow') as verdict from m"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin(spark)
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.fit(docs.where(~F.coalesce(held, F.lit(False))).select("text", "lang"))
    rows = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"),
                       language_id.predict(model, F.col("text")).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"),
                       F.col("p.accepted").alias("accepted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin(spark)
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin(spark)
    return best_fit_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows, v = quality_rules.judge(docs, labels, columns=["doc_id"])
    return rows.select("doc_id", *[F.col(v)[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")])


#: The whole method in SQL.
OP5_SQL = f"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from t),
g as (select rid, i, array_to_string(list_slice(w, i, i + 4), ' ') as g from (select rid, w, unnest(range(1, len(w) - 3)) as i from w)),
r as (select rid, i, lag(i) over (partition by rid order by i) as before
      from (select rid, i, count(*) over (partition by rid, g) as n from g) where n > 1),
c as (select rid, sum(least(5, coalesce(i - before, 5))) as n_repeat_words from r group by rid),
s as (select w.rid, doc_id, t, cast(len(w) as bigint) as n_words,
        cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
        cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, len(l) as n_lines, len(list_distinct(w)) as n_distinct,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper, length(t) - length(replace(t, '!', '')) as n_exclaim,
        cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words from w left join c on c.rid = w.rid),
v as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
        case {" ".join(f"when n_words <= {x} then {i}" for i, x in enumerate(quality_rules.STRATA))} else {len(quality_rules.STRATA)} end as stratum,
        [coalesce(n_symbols / nullif(word_chars, 0), 0.0), coalesce(n_dup_lines / nullif(n_lines, 0), 0.0),
         coalesce(n_repeat_words / nullif(n_words, 0), 0.0), 1.0 - coalesce(n_distinct / nullif(n_words, 0), 1.0),
         coalesce(n_upper / nullif(word_chars, 0), 0.0), coalesce(n_exclaim / nullif(word_chars, 0), 0.0)]::double[] as x from s),
names as (select unnest(['symbols', 'dup_lines', 'repeats', 'same_words', 'capitals', 'shouting']) as rule, unnest(range(1, 7)) as j),
good as (select distinct t, stratum, x from v where not base_failed and doc_id in (select doc_id from labels where quality is not null
      group by doc_id having min(quality) = 1)),
ladder as (select unnest(range(1, {quality_rules.STEPS + 1})) as step, unnest({[list(x) for x in zip(*quality_rules.LADDER.values(), strict=True)]}::double[][]) as c),
k as (select stratum, step, count(*) as n,
        count(*) filter (where list_bool_or(list_transform(range(1, 7), lambda j: x[j] > c[j]))) as k from good, ladder group by all),
tails as (select stratum, step, case when k > n * p then 1.0 else list_sum(list_transform(range(0, k + 1), lambda i:
        exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)))) end as tail
      from (select *, 0.01::double as p from k)),
certified as (select stratum, coalesce(min(step) filter (where tail > 0.05::double / {len(quality_rules.STRATA) + 1}) - 1, {quality_rules.STEPS}) as step
      from tails group by stratum),
cuts as (select stratum, j, rule, c[j] as cut from certified join ladder using (step), names),
fired as (select rid, string_agg(rule, ',' order by j) as rejected_by from v join cuts on cuts.stratum = v.stratum
      where x[j] > cut group by rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and rejected_by is null as kept, coalesce(rejected_by, '') as rejected_by
from v left join fired on fired.rid = v.rid"""


#: The key of the registered query and of the pipeline; a real run passes its own.
PSEUDONYM_KEY = b"contentlake-example-key"


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, the number of values and their kinds."""
    begin(spark)
    rows, v = pseudonyms.pseudonymize(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)
    return rows.select("doc_id", "text", F.size(v).cast("long").alias("n_found"),
                       F.concat_ws(",", F.sort_array(F.array_distinct(F.transform(v, lambda x: x["kind"])))).alias("kinds"))


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin(spark)
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = rule_ensemble.fit(docs.where(~held()), labels)
    rows, v = rule_ensemble.score(docs, model)
    return rows.select("doc_id", held().alias("held_out"), F.col(v).alias("score"), (F.col(v) >= 0.3).cast("int").alias("predicted"))


def op8_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin(spark)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return bit_sliced_topk.topk(rows, rows.where(F.col("vec_id") % 100 == 0), 10, "vec_id", "embedding")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin(spark)
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin(spark)
    return piece_codec.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


OP8_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
           where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v::double[], c.v::double[]) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per node of the trie over all rebuilt conversations: its smallest member, depth, parent's smallest
    member, numbers of members, children and leaves, words saved in its subtree, digest of the members that end there."""
    begin(spark)
    return prefix_trie.build(table(spark, sf_dir, "conversations"))


_BIT = "case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end"
for _ in range(7):
    _BIT = f"list_transform([{_BIT}], lambda c: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)[1]"

#: crc32 of a number's decimal digits: one fold over the digits, eight bits each.
CRC_SQL = """xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({x}::varchar, ''), lambda d: ascii(d)::ubigint)),
      lambda a, b: list_transform([xor(a, b)], lambda c: """ + _BIT + """)[1]))"""

OP11_SQL = f"""
with t as (select conv_id, coalesce(text, '') as text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as g, turn
           from conversations where conv_id is not null),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, g) as pos from t),
c as (select conv_id, count(*) as n, conv_id - conv_id % 20 as base, cast({CRC_SQL.format(x='conv_id')} % 4 as bigint) as h from t group by conv_id),
k as (select c.*, least(c.h, coalesce(b.n, 0)) as head from c left join c b on b.conv_id = c.base),
r as (select k.conv_id, o.pos as i, text, g from k join o on o.conv_id = k.base and o.pos <= k.h
      union all select k.conv_id, head + pos - h, text, g from k join o on o.conv_id = k.conv_id and o.pos > k.h),
p as (select conv_id, i, len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as words,
        string_agg(g, '') over (partition by conv_id order by i) as path from r
      union all select conv_id, 0, 0, '' from k),
m as (select conv_id, max(i) as len from p group by conv_id),
n as (select path, min(conv_id) as conv_id, any_value(i) as depth, count(*) as n_convs, any_value(words) as words from p group by path),
e as (select path, sha256(string_agg(m.conv_id::varchar, ',' order by m.conv_id)) as sha from p join m on m.conv_id = p.conv_id and m.len = p.i group by path),
d as (select left(path, 32 * (depth - 1)::bigint) as path, count(*) as n_children from n where depth > 0 group by all),
f as (select n.*, coalesce(d.n_children, 0) as n_children from n left join d on d.path = n.path),
s as (select left(path, 32 * a::bigint) as path, sum((n_convs - 1) * words) as saved, count(*) filter (where n_children = 0) as leaves
      from (select *, unnest(range(0, depth + 1)) as a from f) group by all)
select f.conv_id, cast(f.depth as bigint) as depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children, s.leaves as n_leaves,
  cast(s.saved as bigint) as saved_tokens, coalesce(e.sha, sha256('')) as ends_sha256
from f join s on s.path = f.path left join e on e.path = f.path
left join n u on f.depth > 0 and u.path = left(f.path, 32 * (f.depth - 1)::bigint)"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its n-gram features, weight towards the benchmark's texts, noisy score and place in the draw."""
    begin(spark)
    rows, v = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return rows.select("doc_id", *[F.col(v)[c].alias(c) for c in ("n_features", "weight", "score", "rank")])


#: Schedules of weight 1 (falling), 2 (level) and 3 (rising).
SCHEDULES = (((0, 1.5), (1, 0.5)), ((0, 2), (1, 2)), ((0, 2), (1, 4)))


def op13_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target, the words that the mix takes of it and the token position of its first copy."""
    begin(spark)
    rows, v = curriculum.mix(table(spark, sf_dir, "documents"), SCHEDULES, columns=["doc_id"])
    return rows.select("doc_id", *[F.col(v)[c].alias(c) for c in ("size", "source_size", "target", "taken")],
                       F.floor(F.col(v)["position"]).cast("long").alias("position"))


OP13_SQL = """
with d as (select doc_id, source, coalesce(doc_id::varchar, '') as id, md5('13:' || coalesce(doc_id::varchar, '')) as h,
             len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as size from documents),
z as (select source, sum(size) as z from d group by source),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 as choice, sum(z) over () as total from z),
c as (select *, choice + 1 as w, 3 * z as cap, sum(choice + 1) over () as w_all from w),
o as (select *, coalesce(sum(cap) over x, 0) as cap_before, coalesce(sum(w) over x, 0) as w_before from c
      window x as (order by cap / w, source rows between unbounded preceding and 1 preceding)),
l as (select total - cap_before as rest, w_all - w_before as open_w from o
      where not cap * (w_all - w_before) < (total - cap_before) * w order by cap / w, source limit 1),
t as (select source, z, choice, least(cap::double, rest::double * w / open_w) as target from o, l),
y as (select sum(target) filter (where choice = 0) as y0, sum(target) filter (where choice = 1) as y1, sum(target) filter (where choice = 2) as y2 from t),
s as (select d.*, z, choice, target, coalesce(sum(size) over (partition by d.source order by h, id, size rows between unbounded preceding and 1 preceding), 0) as start
      from d join t on t.source is not distinct from d.source),
a as (select *, cast(list_sum(list_transform(range(0, 3), lambda e: greatest(0, least(size, floor(target + 0.5) - e * z - start)))) as bigint) as taken from s),
u as (select *, least(greatest(case choice when 0 then 2 * g / greatest(1.5 + sqrt(greatest(2.25 - 2 * g, 0)), 1e-300) when 1 then 2 * (2 * g) / (2.0 + 2.0)
             else 2 * (3 * g) / (2.0 + sqrt(4.0 + 4.0 * (3 * g))) end, 0), 1) as u
      from (select *, least(start / nullif(target, 0), 1) as g from a))
select doc_id, size, cast(z as bigint) as source_size, target, taken,
  case when taken > 0 then cast(floor(coalesce(y0, 0) * (1.5 * u - 0.5 * u * u) + coalesce(y1, 0) * (2 * u) / 2 + coalesce(y2, 0) * (2 * u + u * u) / 3) as bigint) end as position
from u, y"""


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_language_id, op3_license_scan, op4_best_fit_packing, op5_quality_rules,
                                op6_pseudonyms, op7_rule_ensemble, op8_bit_sliced_topk,
                                op9_jaccard_join, op10_piece_codec, op11_prefix_trie, op12_importance_resampling,
                                op13_curriculum_mix)}
ORACLES: dict[str, str] = {"op1_url_filter": OP1_SQL, "op5_quality_rules": OP5_SQL, "op8_bit_sliced_topk": OP8_SQL, "op11_prefix_trie": OP11_SQL,
                           "op13_curriculum_mix": OP13_SQL}
