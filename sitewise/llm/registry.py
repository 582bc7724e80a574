"""The registered corpus queries, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitewise.llm import (
    centroids,
    credentials,
    dialogue,
    fingerprint,
    mixing,
    neardup,
    packing,
    quality_model,
    quality_rules,
    sharding,
    suffix,
    toxicity,
    warc,
)
from sitewise.llm.common import table
from sitewise.operators.staging import staging_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op2_toxic_lexicon(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_fast_sketches(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op4_fertility_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality_rules.judge(docs, text=False).select("doc_id", "_m.*", "_v.*")


@query
def op5_ring_shards(spark, sf_dir):
    from pyspark.sql import functions as F

    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "arc",
    )


@query
def op6_paragraph_sketch(spark, sf_dir):
    return fingerprint.fingerprint_versions(table(spark, sf_dir, "documents")).drop("recovered")


@query
def op7_fair_mix(spark, sf_dir):
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


ORACLE["op7_fair_mix"] = r"""
with sized as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('7|' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as h
  from documents),
per as (select source, sum(size)::bigint as source_size from sized group by 1),
numbered as (
  select *, row_number() over (order by source nulls last) - 1 as nth from per),
weighed as (
  select source, source_size, source_size * 2.0::double as most,
         [3, 1, 2][(nth % 3 + 1)::int] as w from numbered),
filled as (
  select *, most / w as ratio, sum(source_size) over () * 1.5::double as budget,
         coalesce(sum(most) over (order by most / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double) as below,
         sum(w) over (order by most / w, source nulls last rows between current row and unbounded following)::double as rest
  from weighed),
leveled as (select *, (budget - below) / rest as lvl from filled),
targets as (
  select source, source_size,
         coalesce(least(most, (max(case when lvl <= ratio then lvl end) over ()) * w), most) as target
  from leveled),
queued as (
  select s.*, t.source_size, t.target,
         sum(s.size) over (partition by s.source order by h, doc_id, size rows unbounded preceding) as done
  from sized s join targets t on s.source is not distinct from t.source),
turns as (
  select *, case when target > 0 then (turn * source_size + done)::double / target else 0.0 end as finish
  from queued, (values (0), (1)) v(turn)),
served as (
  select *, sum(size) over (order by finish, source nulls last, turn, h, doc_id, size rows unbounded preceding) as used
  from turns)
select doc_id, source, size, source_size, target,
       sum((used <= (select sum(size) * 1.5::double from sized))::int)::int as copies,
       (size * sum((used <= (select sum(size) * 1.5::double from sized))::int))::bigint as taken
from served group by doc_id, source, size, source_size, target
"""


@query
def op8_warc_segments(spark, sf_dir):
    path = staging_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path)


ORACLE["op8_warc_segments"] = """
with p as (select page_id, coalesce(html, '') as h from pages),
s as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha256(h) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from s where payload_bytes >= 100 group by 1)
select s.page_id, s.payload_bytes, s.payload_digest,
       case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
       case when first <> page_id then first end as refers_to,
       true as intact
from s left join f on f.payload_digest = s.payload_digest
"""


ORACLE["op6_paragraph_sketch"] = r"""
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, ''))::bigint as n_chars from documents),
n as (
  select *, coalesce(lead(text) over (order by doc_id, text), (select first(text order by doc_id, text) from d)) as next_text from d),
e as (
  select *, substr(text, 1, n_chars - n_chars // 4) || substr(next_text, 1, n_chars // 4) as edited from n),
k as (
  select doc_id, n_chars, sha256(edited) as edited_sha256,
         list_distinct([('0x' || substr(md5(x), 1, 15))::bigint for x in regexp_extract_all(text, '(?:[^ \n]+ ?){1,64}')]) as a,
         list_distinct([('0x' || substr(md5(x), 1, 15))::bigint for x in regexp_extract_all(edited, '(?:[^ \n]+ ?){1,64}')]) as b,
         list_distinct([('0x' || substr(md5(x), 1, 15))::bigint for x in regexp_extract_all(next_text, '(?:[^ \n]+ ?){1,64}')]) as c
  from e),
items as (
  select doc_id, 'a' as which, unnest(a) as x from k union all select doc_id, 'b', unnest(b) from k),
placed as (
  select doc_id, which, r * 8 + ((x >> (3 * r)) & 7) as cell, x, ((x % 2147483629) * 48271 + 11) % 2147483647 as c
  from items, (values (0), (1), (2), (3)) v(r)),
cells as (select doc_id, which, cell, count(*)::bigint as n, bit_xor(x) as k, bit_xor(c) as c from placed group by all),
grid as (
  select doc_id, which, cell from k, (values ('a'), ('b')) w(which), range(32) g(cell)),
shown as (
  select g.doc_id, g.which,
         string_agg(lower(hex(coalesce(n, 0))) || '.' || lower(hex(coalesce(k, 0))) || '.' || lower(hex(coalesce(c, 0))), ' ' order by g.cell) as t
  from grid g left join cells using (doc_id, which, cell) group by 1, 2),
near as (
  select doc_id, n_chars, edited_sha256, len(a) + len(b) as ab, len(list_intersect(a, b)) as iab,
         len(a) + len(c) as ac, len(list_intersect(a, c)) as iac from k)
select near.doc_id, n_chars, edited_sha256, sa.t as fingerprint, sb.t as edited_fingerprint,
       case when ab = 0 then 1.0::double else (2 * iab)::double / (2 * ab - 2 * iab)::double end as near_edited,
       case when ac = 0 then 1.0::double else (2 * iac)::double / (2 * ac - 2 * iac)::double end as near_next
from near join shown sa on sa.doc_id = near.doc_id and sa.which = 'a'
join shown sb on sb.doc_id = near.doc_id and sb.which = 'b'
"""


@query
def op10_additive_quality(spark, sf_dir):
    return quality_model.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_run_index(spark, sf_dir):
    return suffix.repeat_report(table(spark, sf_dir, "documents"))


@query
def op12_geometric_drift(spark, sf_dir):
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def _cluster_sql(k: int, rounds: int) -> str:
    """All rounds as a chain of table expressions; v is a list of integers, c a cluster number."""
    steps = [
        f"""
kept as (
  select vec_id, [floor(256.0::double * x::double)::bigint for x in embedding] as v from embeddings
  where len(embedding) = 64 and len([x for x in embedding if x is not null and isfinite(x)]) = 64),
c0 as (
  select (row_number() over (order by h) - 1)::int as c, v
  from (select v, sha256('2:' || vec_id) as h from kept order by h limit {k}))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} as (
  select vec_id, v, min({{'d': list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v, w)])::bigint, 'c': c}}) as m
  from (select kept.vec_id, kept.v, c{r}.c, c{r}.v as w from kept, c{r}) group by vec_id, v)""")
        if r < rounds:
            steps.append(f"""
m{r} as (
  select c, list(f order by i) as v
  from (
    select c, i, ((s - ((s % n) + n) % n) // n)::bigint as f
    from (select m.c as c, i, sum(x) as s, count(*) as n
          from (select m, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by 1, 2))
  group by c),
c{r + 1} as (select c{r}.c, coalesce(m{r}.v, c{r}.v) as v from c{r} left join m{r} using (c))""")
    return (
        "with"
        + ",".join(steps)
        + f"""
select vec_id, m.c as cluster, m.d as distance, (sum(m.d) over (partition by m.c))::bigint as cluster_inertia,
       (sum(m.d) over ())::bigint as inertia, sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
from a{rounds} join c{rounds} on c{rounds}.c = m.c"""
    )


ORACLE["op12_geometric_drift"] = _cluster_sql(40, 5)


@query
def op13_shared_endings(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations")
    return dialogue.repair_report(dialogue.damage(talks), talks)


#: crc32 bit by bit and byte by byte; `go` holds the ways of the grammar over one row, `cost` the
#: cost-to-go before row p (counted from the end) in state q. States: 0 nothing, 1 system, 2 user, 3 assistant.
ORACLE["op13_shared_endings"] = r"""
with recursive
bits(i, k, c) as (
  select i, 0, i::bigint from range(256) t(i)
  union all
  select i, k + 1, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end from bits where k < 8),
tab as (select i, c from bits where k = 8),
src as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
crcs(name, p, c) as (
  select distinct name, 0, 4294967295::bigint from src
  union all
  select name, p + 1, xor(crcs.c >> 8, tab.c) from crcs join tab on tab.i = xor(crcs.c, ascii(substr(name, p + 1, 1))) & 255
  where p < length(name)),
faulty as (
  select src.*, xor(c, 4294967295) % 20 as f from src join crcs on crcs.name = src.name and crcs.p = length(src.name)),
damaged as (
  select conv_id, turn, case when f = 4 then 'user' else role end as role,
         case when f = 1 then '' when f = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from faulty, range(2) r(n) where f <> 0 and (n = 0 or f = 3)),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as ord,
         count(*) over (partition by conv_id) as n
  from damaged),
rolled as (
  select *, n - ord as p, case when substr(role, 1, 1) in ('s', 'u', 'a') then substr(role, 1, 1) else 'x' end as r,
         row_number() over (partition by conv_id, role, text order by ord) as nth,
         lead(substr(role, 1, 1)) over (partition by conv_id order by ord) as next_r
  from numbered),
faults as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when nth > 1 then 'd'
                 when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 't' else 'k' end as f
  from rolled),
ins(q, n, ord) as (values (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
go as (
  select q, 5 * n + c as c, repeat('I', n) || e as e, need, dest from ins, (
    select s as at_, 2 as c, 'D' as e, 'any' as need, s as dest from range(4) t(s)
    union all select s, 1, 'R', 'live', case when s = 2 then 3 else 2 end from range(4) t(s)
    union all select s, 0, 'K', case when s = 2 then 'a' else 'u' end, case when s = 2 then 3 else 2 end from range(4) t(s)
    union all select 0, 0, 'K', 's', 1) m
  where m.at_ = ins.ord),
cost(conv_id, p, q, m) as (
  select conv_id, 0::bigint, q, {'c': c, 'a': a}
  from (select distinct conv_id from damaged), (values (0, 0, ''), (1, 10, 'II'), (2, 5, 'I'), (3, 0, '')) v(q, c, a)
  union all
  select cost.conv_id, cost.p + 1, go.q,
         min({'c': (m.c + go.c + case when f = 't' and need <> 'any' then 5 else 0 end)::int, 'a': go.e || m.a})
  from cost join faults on faults.p = cost.p and faults.conv_id is not distinct from cost.conv_id
  join go on go.dest = cost.q and (need = 'any' or (f in ('t', 'k') and need in ('live', r)))
  group by 1, 2, 3),
solved as (
  select conv_id, m.c as cost, m.a as audit from cost
  where q = 0 and p = (select count(*) from damaged d where d.conv_id is not distinct from cost.conv_id)),
letters as (select conv_id, audit, i, substr(audit, i::int, 1) as e from solved, range(1, 1 + (select max(length(audit)) from solved)) t(i) where i <= length(audit)),
walked as (
  select *, sum((e <> 'I')::int) over w as ord, sum((e <> 'D')::int) over w as nth, sum((e <> 'D')::int) over (partition by conv_id) % 2 as odd
  from letters window w as (partition by conv_id order by i)),
repaired as (
  select walked.conv_id, walked.nth,
         case when e = 'K' then role when (walked.nth + odd) % 2 = 1 then 'user' else 'assistant' end
         || ':' || case when e = 'I' then '' else text end as line
  from walked left join faults on faults.ord = walked.ord and faults.conv_id is not distinct from walked.conv_id where e <> 'D'),
shas as (select conv_id, sha256(string_agg(line, chr(10) order by nth)) as sha from repaired group by 1),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
         sum((f = 'b')::int) as blank, sum((f = 'd')::int) as duplicate, sum((f = 't')::int) as truncated,
         sum((next_r is not null and substr(role, 1, 1) || next_r not in ('su', 'ua', 'au'))::int) as illegal
  from faults group by 1)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
       coalesce(audit, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counted on counted.conv_id is not distinct from o.conv_id
left join solved on solved.conv_id is not distinct from o.conv_id
left join shas on shas.conv_id is not distinct from o.conv_id
"""


@query
def op11_guess_cost(spark, sf_dir):
    from pyspark.sql import functions as F

    found = credentials.find_secrets(table(spark, sf_dir, "documents"))
    spans = credentials.span_text(F.col("secrets"))
    added = F.size(F.filter("secrets", lambda s: s["bits"].isNotNull())).cast("long")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), added.alias("n_guess"))
