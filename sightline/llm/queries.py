"""One query for each operator over its whole table, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup as _embedding
from . import exact_dedup as _exact
from . import language_id as _language
from . import license_scan as _license
from . import mixing as _mixing
from . import packing as _packing
from . import periodic as _periodic
from . import pieces as _pieces
from . import quality as _quality
from . import simhash as _simhash
from . import suffix_dedup as _suffix
from . import url_filter as _url
from . import whitening as _whitening

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(table(spark, sf_dir, "documents")).drop("row_id")


OP1_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
r as (select doc_id, norm, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
             row_number() over w = 1 as kept
      from d window w as (partition by norm order by points desc, doc_id))
select doc_id, keep_id, group_size, kept, sha256(norm) as text_sha256 from r
"""


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.taken_words(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                  ('0x' || md5('mix:' || coalesce(doc_id::varchar, ''))[1:8])::bigint // 2 as spread from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
n as (select *, row_number() over (order by source nulls last) - 1 as rn from s),
w as (select *, case rn % 3 when 0 then 5 when 1 then 2 else 1 end as w, 3 * source_size as cap from n),
f as (select *, cap::double / w as ratio, sum(source_size) over () as total from w),
v as (select *, (total - coalesce(sum(cap) over (order by ratio, rn rows between unbounded preceding and 1 preceding), 0))::double
             / sum(w) over (order by ratio, rn rows between current row and unbounded following) as level from f),
l as (select level from v where level <= ratio order by ratio, rn limit 1),
t as (select source, source_size, least(w * l.level, cap::double) as target, floor(least(w * l.level, cap::double))::bigint as goal from v, l),
o as (select d.source, doc_id, size, source_size, target, goal, row_number() over () as row_id, coalesce(sum(size) over (partition by d.source
             order by spread, doc_id nulls last, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
      from d join t on d.source is not distinct from t.source),
e as (select t.source, goal, row_number() over (order by t.source nulls last) as rn,
             sum(goal) over (order by t.source nulls last) as high, sum(goal) over () as shares, sum(source_size) over () as words from t),
b as (select *, greatest(1, least(4096, words // 131072))::bigint as block from e),
c as (select *, ceil(goal / block)::bigint as need, ceil(words / block)::bigint as n_slots from b),
p as (select i as slot, floor((i % 1073741824 * 663608941 % 1073741824)::double / 1073741824 * shares)::bigint as pos
      from (select unnest(range(n_slots)) as i, greatest(shares, 1) as shares from (select distinct n_slots, shares from c))),
g as (select source, need, slot, row_number() over (partition by source order by slot) - 1 as rank
      from p join c on pos >= high - goal and pos < high),
h as (select source, count(*) as have from g group by source),
m as (select c.source, rn, n_slots, unnest(range(coalesce(have, 0), need)) as rank from c left join h on c.source is not distinct from h.source),
q as (select source, rank, slot from g where rank < need
      union all select source, rank, n_slots + row_number() over (order by rank, rn) - 1 as slot from m),
y as (select x.source, row_id, unnest(range(x.low // b.block, (x.top - 1) // b.block + 1)) as rank
      from (select source, row_id, k * source_size + before as low, least(k * source_size + before + size, goal) as top
            from o, (select unnest(range(3)) as k) where size > 0) x join b on x.source is not distinct from b.source where x.low < x.top),
z as (select row_id, min(slot)::bigint as first_slot, count(*)::bigint as n_slots
      from y join q on y.source is not distinct from q.source and y.rank = q.rank group by row_id)
select doc_id, size::bigint as size, source_size, round(target, 6) as target,
       (greatest(0, least(before + size, goal) - before)
        + greatest(0, least(source_size + before + size, goal) - source_size - before)
        + greatest(0, least(2 * source_size + before + size, goal) - 2 * source_size - before))::bigint as taken,
       first_slot, coalesce(n_slots, 0)::bigint as n_slots from o left join z using (row_id)
"""


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _simhash.simhash(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _license.license_scan(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language.language_id(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedding.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suffix.suffix_dedup(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _url.judge(table(spark, sf_dir, "pages"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces.piece_digests(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periodic.run_digests(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_source_mix": op2_source_mix,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_license_scan": op4_license_scan,
        "op5_language_id": op5_language_id,
        "op6_quality": op6_quality,
        "op7_embedding_near_dedup": op7_embedding_near_dedup,
        "op8_repeated_passages": op8_repeated_passages,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_url_filter": op10_url_filter,
        "op11_sentencepiece": op11_sentencepiece,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_source_mix": OP2_SQL}
