"""The registered queries of the training-data operators and their DuckDB SQL.

Each query applies its operator with production parameters to its whole
table and derives the digest columns from the operator's real outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fundflow.llm import (
    bpe, decontaminate, exact_dedup, fill_in_middle, language_id, license_scan, lm_scoring, piecewise, quality,
    resample, simhash, substring_dedup, suffix_dedup,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("detections")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.tokenise(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup_bytes(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.drop("n_words")


def op12_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.edited_neighbours(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle.transform(_table(spark, sf_dir, "documents"))
    restored = fill_in_middle.restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_substring_dedup, op2_license_scan, op3_decontamination, op4_exact_dedup, op5_lm_scoring, op6_bpe,
        op7_quality, op8_language_id, op9_simhash, op10_suffix_dedup, op11_importance_resampling,
        op12_piecewise_fingerprints, op13_fill_in_middle)
}

SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _windows(table: str, words: str, key: str, size: int) -> str:
    """(key, pos, text) of each run of ``size`` words in rows (key, pos, w); ``pos`` counts from 0."""
    parts = " || ' ' || ".join(["w", *(f"lead(w, {k}) over o" for k in range(1, size))])
    return (f"{table} as (select * from (select {key}, pos, {parts} as text from {words} "
            f"window o as (partition by {key} order by pos)) where text is not null)")


ORACLE_SQL = {
    "op1_substring_dedup": f"""
with dw as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as pos
            from (select doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') as ws from documents)),
{_windows('win', 'dw', 'doc_id', 13)},
lowest as (select text, min(doc_id) as low from win group by text),
gone as (select distinct doc_id, unnest(range(pos, pos + 13)) as pos
         from win join lowest using (text) where low < doc_id),
words as (select dw.doc_id, dw.pos, w, gone.pos is not null as out
          from dw left join gone on dw.doc_id = gone.doc_id and dw.pos = gone.pos),
kept as (select doc_id, count(*) as n_words, count(*) filter (out) as n_removed,
                string_agg(w, ' ' order by pos) filter (not out) as text from words group by doc_id)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed,
       sha256(coalesce(kept.text, '')) as kept_sha256
from documents left join kept using (doc_id)""",
    "op10_suffix_dedup": """
with h as (select doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as x from documents),
bytes as (select doc_id, unnest(x) as b, generate_subscripts(x, 1) - 1 as pos from h),
s2 as (select *, b || lead(b) over o as t2 from bytes window o as (partition by doc_id order by pos)),
s4 as (select *, t2 || lead(t2, 2) over o as t4 from s2 window o as (partition by doc_id order by pos)),
s8 as (select *, t4 || lead(t4, 4) over o as t8 from s4 window o as (partition by doc_id order by pos)),
s16 as (select doc_id, pos, t2, t8 || lead(t8, 8) over o as t16 from s8 window o as (partition by doc_id order by pos)),
s50 as (select doc_id, pos, t16 || lead(t16, 16) over o || lead(t16, 32) over o || lead(t2, 48) over o as s
        from s16 window o as (partition by doc_id order by pos)),
win as (select * from s50 where s is not null),
lowest as (select s, min(doc_id) as low from win group by s),
gone as (select distinct doc_id, unnest(range(pos, pos + 50)) as pos
         from win join lowest using (s) where low < doc_id),
marked as (select bytes.doc_id, bytes.pos, b, gone.pos is not null as out
           from bytes left join gone on bytes.doc_id = gone.doc_id and bytes.pos = gone.pos),
runs as (select *, out and not coalesce(lag(out) over (partition by doc_id order by pos), false) as begins from marked),
kept as (select doc_id, count(*) as n_bytes, count(*) filter (out) as n_removed, count(*) filter (begins) as n_spans,
                string_agg(b, '' order by pos) filter (not out) as x from runs group by doc_id)
select doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed,
       coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept.x, ''))) as kept_sha256
from documents left join kept using (doc_id)""",
    "op4_exact_dedup": r"""
with d as (select doc_id, coalesce(text, '') as text,
       regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by norm) as group_size,
       doc_id = first_value(doc_id) over w as kept,
       sha256(norm) as text_sha256
from d window w as (partition by norm order by length(text) desc, doc_id
                    rows between unbounded preceding and unbounded following)""",
    "op3_decontamination": f"""
with dw as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as pos
            from (select doc_id, regexp_extract_all({_lower('text')}, '{ALNUM}') as ws from documents)),
iw as (select item_id, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as pos, len(ws) as n
       from (select item_id, regexp_extract_all({_lower('text')}, '{ALNUM}') as ws from benchmark)),
{_windows('longer', '(select item_id, pos, w from iw where n >= 13)', 'item_id', 13)},
short as (select item_id, string_agg(w, ' ' order by pos) as text, max(n) as n from iw where n < 13 group by item_id),
dwin as (select doc_id, pos, 13 as n, text from (
           select doc_id, pos, {" || ' ' || ".join(["w", *(f"lead(w, {k}) over o" for k in range(1, 13))])} as text
           from dw window o as (partition by doc_id order by pos)) where text is not null),
found as (select d.doc_id, d.pos, d.n, l.item_id from dwin d join longer l on d.text = l.text
          union all
          select d.doc_id, d.pos, s.n, s.item_id
          from (select doc_id, pos, m, string_agg(w, ' ' order by p) as text, count(*) as k from (
                  select a.doc_id, a.pos, s.n as m, b.pos as p, b.w from dw a, (select distinct n from short) s, dw b
                  where b.doc_id = a.doc_id and b.pos >= a.pos and b.pos < a.pos + s.n) group by 1, 2, 3) d
          join short s on d.m = s.n and d.k = s.n and d.text = s.text),
hit as (select doc_id, count(distinct p) as n_hit from (
          select doc_id, unnest(range(pos, pos + n)) as p from found) group by 1),
its as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items
        from (select distinct doc_id, item_id::varchar as i from found) group by 1),
n as (select doc_id, count(*) as n_words from dw group by 1)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) as contaminated
from documents left join n using (doc_id) left join hit using (doc_id) left join its using (doc_id)""",
    "op11_importance_resampling": f"""
with dw as (select doc_id, regexp_extract_all({_lower('text')}, '{ALNUM}') as ws from documents),
tw as (select regexp_extract_all({_lower('text')}, '{ALNUM}') as ws from benchmark),
words as (select distinct w from (select unnest(ws) as w from dw union all select unnest(ws) from tw)),
bits as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
           lambda c, k: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end))) as t),
coded as (select w, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(w)), '..'),
            lambda x: ('0x' || x)::bigint)), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) % 10000 as b
          from words, bits),
dwords as (select doc_id, b from (select doc_id, unnest(ws) as w from dw) join coded using (w)),
corpus as (select b, count(*) as s from dwords group by b),
target as (select b, count(*) as t from (select unnest(ws) as w from tw) join coded using (w) group by b),
gain as (select b, floor(1000 * ln((coalesce(t, 0)::double + 1) * ((select coalesce(sum(s), 0) from corpus)::double + 10000)
           / ((s::double + 1) * ((select coalesce(sum(t), 0) from target)::double + 10000))))::bigint as g
         from corpus left join target using (b)),
weighed as (select doc_id, sum(g)::bigint as weight from dwords join gain using (b) group by doc_id),
scored as (select doc_id, len(ws)::bigint as n_features, coalesce(weight, 0) as weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double)
               / 4294967296::double)))::bigint as score
           from dw left join weighed using (doc_id)),
placed as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as r from scored)
select doc_id, n_features, weight, score,
  case when n_features >= 20 and r <= (select count(*) * 10 // 100 from scored where n_features >= 20) then r end as rank
from placed""",
    "op13_fill_in_middle": """
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
             sha256('1:' || doc_id) as h from documents),
n as (select *, len(u)::bigint as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
        ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as x, greatest(h1 % (n + 1), h2 % (n + 1)) as y,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90
          then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from n),
p as (select *, array_to_string(u[1:x], '') as pre, array_to_string(u[x + 1:y], '') as mid,
        array_to_string(u[y + 1:], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars,
  case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
         else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256
from p""",
}
