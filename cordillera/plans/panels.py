"""Panels, filters, links and keys of records and counts beyond the first sets. The stand-ins are those of `literature` and `spatial`."""

from .base import Catalog
from .spatial import COUNTS


def add(c: Catalog) -> None:
    def counts(name: str, rest: str) -> None:
        c.sql(name, "lineitem part", f"with counts as ({COUNTS}){rest}")

    # filters on records
    c.sql("enabled_records", "documents labels", "select d.doc_id, d.source from documents d left join labels l on d.doc_id = l.doc_id where coalesce(l.toxic = 0, true)")
    c.sql("manifest_filter", "orders customer", "select o.o_orderkey, o.o_custkey from orders o where lower(o.o_orderstatus) in ('f', 'o') and o.o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
    c.sql("excluded_relations", "orders", "select o_custkey, o_orderkey, o_orderpriority from orders where lower(trim(o_orderpriority)) not in ('4-not specified', '5-low')")
    c.sql("low_resolution_reasons", "part", "select p_partkey, case when greatest(p_size, p_retailprice / 40) > 40 then 'exclude' else 'keep' end as decision, case when p_size > 40 then 'first axis' when p_retailprice / 40 > 40 then 'second axis' end as reason from part")
    c.sql("result_limit_clamp", "documents", f"select doc_id, n_chars from documents order by n_chars desc, doc_id limit {max(1, min(250, 100))}")

    # links and keys of a graph
    c.sql("graph_links", "orders customer", "select cast(o.o_custkey as bigint) as source, cast(o.o_orderkey as bigint) as target, coalesce(nullif(trim(o.o_orderpriority), ''), 'related') as relation, c.c_custkey is null as concept from orders o left join (select c_custkey from customer where c_acctbal >= 0) c on o.o_custkey = c.c_custkey where o.o_custkey is not null and o.o_orderkey is not null")
    c.sql("absent_concepts", "part", "with known as (select p_partkey as id, lower(trim(p_name)) as name from part where p_size <= 25), fresh as (select case when p_partkey % 3 = 0 then null else p_partkey end as id, lower(trim(p_name)) as name, p_partkey as row_id from part where p_size > 10), ids as (select distinct id from known), names as (select distinct name from known) select f.row_id from fresh f left join ids i on f.id = i.id left join names n on f.name = n.name where case when f.id is not null then i.id is null else n.name is null end")
    c.sql("batch_keys", "documents", "select doc_id, concat_ws('|', source, lang) as batch from documents")
    c.sql("record_hash", "orders", "select o_orderkey, sha2(to_json(named_struct('custkey', cast(o_custkey as bigint), 'orderkey', cast(o_orderkey as bigint), 'status', o_orderstatus)), 256) as hash from orders", "select o_orderkey, sha256(cast(to_json({'custkey': cast(o_custkey as bigint), 'orderkey': cast(o_orderkey as bigint), 'status': o_orderstatus}) as varchar)) as hash from orders")
    # each word at its first place; the hash stands for the list
    c.sql("distinct_in_order", "documents", "select doc_id, size(w) as n, md5(array_join(w, ' ')) as words from (select doc_id, array_distinct(regexp_extract_all(text, '[a-z]+', 0)) as w from documents where text is not null) x", "select d.doc_id, coalesce(n, 0) as n, coalesce(words, md5('')) as words from (select doc_id from documents where text is not null) d left join (select doc_id, count(*) as n, md5(string_agg(word, ' ' order by pos)) as words from (select doc_id, word, min(pos) as pos from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from (select doc_id, regexp_extract_all(text, '[a-z]+') as w from documents) a) b group by doc_id, word) z group by doc_id) y on d.doc_id = y.doc_id")

    # counts, panels and links of measurements
    counts("zero_panel_filter", ", lib as (select spot, sum(n) as library, sum(case when gene in ('Brand#11', 'Brand#12', 'Brand#13') then n else 0 end) as panel from counts group by spot) select spot, round(cast(library as double), 4) as library, round(cast(panel as double), 4) as panel from lib where library > 0 and panel > 0")
    counts("panel_lookup", ", wanted as (select 1 as pos, 'Brand#33' as gene union all select 2, 'Brand#11' union all select 3, 'Brand#52'), genes as (select gene, count(*) as spots from counts group by gene) select w.pos, g.gene, g.spots from wanted w join genes g on w.gene = g.gene")
    counts("observed_probability", ", lib as (select spot, sum(n) as library from counts group by spot) select k.spot, k.gene, round(cast(k.n as double) / greatest(cast(l.library as double), 1e0), 8) as p from counts k join lib l on k.spot = l.spot")
    counts("expected_composition", ", a as (select spot, gene, cast(n as double) * (1 + length(gene) / 10e0) as xa from counts) select spot, gene, round(case when sum(xa) over (partition by spot) > 0 then xa / sum(xa) over (partition by spot) else 0 end, 8) as share from a")
    counts("integer_count_audit", " select count(*) as rows_read, cast(sum(case when n > 0 then 1 else 0 end) as bigint) as positive, cast(sum(case when n <> floor(n) then 1 else 0 end) as bigint) as fractional, count(distinct spot) as spots from counts")
    rest = ", w as (select grp, cls, cell, greatest(cast(v as double), 0e0) as w from links), t as (select *, sum(w) over (partition by grp, cls) as total, count(*) over (partition by grp, cls) as n from w) select grp, cls, cell, round(case when total > 0 then w / total else 1e0 / n end, 8) as share from t"
    c.sql("class_links", "embeddings", "with links as (select vec_id % 50 as grp, vec_id as cell, element_at(embedding, 1) as v, label as cls from embeddings)" + rest, "with links as (select vec_id % 50 as grp, vec_id as cell, embedding[1] as v, label as cls from embeddings)" + rest)
