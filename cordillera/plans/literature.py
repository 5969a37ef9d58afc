"""Records, normalisation, search, links, audits and exports of a literature graph.

Stand-ins: a paper is a row of documents, a journal one of part, an edge one of orders, a page one of pages.
"""

from .base import Catalog

#: Words that say nothing about a topic.
STOP = ("this", "that", "with", "from", "have", "were", "been", "which", "their", "also", "into", "than", "these", "those", "and", "the")
LIST = ", ".join(f"'{w}'" for w in STOP)


def add(c: Catalog) -> None:
    words_s = f"select doc_id, explode(array_except(array_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}', 0)), array({LIST}))) as word from documents"
    words_d = f"select doc_id, word from (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}'))) as word from documents) where word not in ({LIST})"
    # document frequency 2 to 100, at most 30 documents a word (by id), pairs that share 4 words: an inverted-index self-join
    pairs = """, df as (select word from w group by word having count(*) between 2 and 100),
    capped as (select doc_id, word from (select w.doc_id, w.word, row_number() over (partition by w.word order by w.doc_id) as rn from w join df on w.word = df.word) x where rn <= 30),
    pairs as (select a.doc_id as source, b.doc_id as target, count(*) as shared from capped a join capped b on a.word = b.word and a.doc_id < b.doc_id group by a.doc_id, b.doc_id having count(*) >= 4)"""
    c.sql("topic_edges", "documents", f"with w as ({words_s}){pairs} select source, target, shared from pairs", f"with w as ({words_d}){pairs} select source, target, shared from pairs")
    c.sql("topic_edge_stats", "documents", f"with w as ({words_s}){pairs} select shared, count(*) as n from pairs group by shared", f"with w as ({words_d}){pairs} select shared, count(*) as n from pairs group by shared")
    c.sql("search_all_words", "documents", "select doc_id from documents where forall(split('the and of', ' '), w -> contains(lower(text), w))", "select doc_id from documents where contains(lower(text), 'the') and contains(lower(text), 'and') and contains(lower(text), 'of')")
    c.sql("search_phrase", "documents", "select doc_id, source from documents where contains(lower(text), lower('Licensed under'))")
    c.sql("recent_window", "events", "select event_id, user_id from events where ts >= (select max(ts) from events) - interval 7 days", "select event_id, user_id from events where ts >= (select max(ts) from events) - interval 7 day")
    c.sql("normalize_title", "documents", r"select doc_id, trim(regexp_replace(regexp_replace(lower(text), '<[^>]+>', ' '), r'[^\p{L}\p{N}_]+', ' ')) as title from documents".replace("r'[", "'[").replace(r"\p", r"\\p"), r"select doc_id, trim(regexp_replace(regexp_replace(lower(text), '<[^>]+>', ' ', 'g'), '[^\p{L}\p{N}_]+', ' ', 'g')) as title from documents")
    c.sql("normalize_doi", "pages", r"select page_id, rtrim('.,;', regexp_replace(lower(trim(concat('https://doi.org/10.1000/', page_id, '.'))), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '')) as doi from pages", r"select page_id, rtrim(regexp_replace(lower(trim(concat('https://doi.org/10.1000/', page_id, '.'))), '^(https?://(dx\.)?doi\.org/|doi:\s*)', ''), '.,;') as doi from pages")
    c.sql("safe_name", "pages", "select page_id, coalesce(nullif(substring(regexp_replace(url, '[^A-Za-z0-9._-]+', '_'), 1, 180), ''), 'record') as name from pages", "select page_id, coalesce(nullif(substring(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 180), ''), 'record') as name from pages")
    c.sql("stable_id_hash", "documents", "select doc_id, concat('HASH:', substring(sha2(concat(lower(text), '|', n_chars), 256), 1, 16)) as id from documents", "select doc_id, concat('HASH:', substring(sha256(concat(lower(text), '|', n_chars)), 1, 16)) as id from documents")
    c.sql("second_id_hash", "documents", "select doc_id, concat('HASH:', substring(md5(concat(text, source)), 1, 12)) as id from documents")
    c.sql("seed_from_text", "documents", "select doc_id, cast(conv(concat(substring(h, 7, 2), substring(h, 5, 2), substring(h, 3, 2), substring(h, 1, 2)), 16, 10) as bigint) as seed from (select doc_id, sha2(text, 256) as h from documents) x", "select doc_id, cast(concat('0x', substring(h, 7, 2), substring(h, 5, 2), substring(h, 3, 2), substring(h, 1, 2)) as bigint) as seed from (select doc_id, sha256(text) as h from documents) x")
    c.sql("first_wins_dedup", "documents", "select doc_id, md5(text) as key from (select *, row_number() over (partition by md5(text) order by doc_id) as rn from documents) x where rn = 1")
    c.sql("content_duplicates", "documents", "select md5(text) as key, count(*) as n, min(doc_id) as first_id from documents group by md5(text) having count(*) > 1")
    c.sql("source_counts", "documents", "select source, lang, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by source, lang")
    c.sql("conditional_pass_counts", "documents labels", "select d.source, count(*) as n, cast(sum(case when l.quality = 1 then 1 else 0 end) as bigint) as good, cast(sum(case when l.doc_id is null then 1 else 0 end) as bigint) as unlabelled, cast(sum(case when length(d.text) < 500 then 1 else 0 end) as bigint) as short from documents d left join labels l on d.doc_id = l.doc_id group by d.source")
    c.sql("missing_required", "orders", "select o_orderkey from orders where nullif(trim(o_orderstatus), '') is null or o_totalprice is null or o_totalprice < 2000")
    c.sql("issue_list", "customer", "select c_custkey, array_join(array_compact(array(case when c_acctbal < 0 then 'negative' end, case when c_mktsegment not in ('BUILDING', 'MACHINERY') then 'segment' end, case when c_nationkey is null then 'nation' end)), ';') as issues from customer", "select c_custkey, concat_ws(';', case when c_acctbal < 0 then 'negative' end, case when c_mktsegment not in ('BUILDING', 'MACHINERY') then 'segment' end, case when c_nationkey is null then 'nation' end) as issues from customer")
    c.sql("orphan_edges", "orders customer", "select o.o_orderkey, o.o_custkey from orders o left anti join (select c_custkey from customer where c_acctbal > 0) k on o.o_custkey = k.c_custkey", "select o.o_orderkey, o.o_custkey from orders o where not exists (select 1 from customer c where c.c_custkey = o.o_custkey and c_acctbal > 0)")
    c.sql("edge_audit", "orders", "select count(*) as edges, cast(sum(case when o_orderkey = o_custkey then 1 else 0 end) as bigint) as loops, cast(sum(case when length(o_orderpriority) < 10 then 1 else 0 end) as bigint) as short, count(distinct o_orderstatus) as relations from orders")
    c.sql("duplicate_triples", "orders", "select o_custkey, o_orderstatus, o_orderpriority, count(*) as n from orders group by o_custkey, o_orderstatus, o_orderpriority having count(*) > 1")
    c.sql("text_meta_full_outer", "documents labels", "select coalesce(d.doc_id, l.doc_id) as id, case when d.doc_id is null then 'metadata only' else 'text only' end as side from documents d full outer join labels l on d.doc_id = l.doc_id where d.doc_id is null or l.doc_id is null")
    c.sql("anti_join_append", "orders", "select o_orderkey, o_custkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders where o_orderstatus = 'O') n left anti join (select distinct o_custkey as k from orders where o_orderstatus = 'F') e on n.o_custkey = e.k where rn = 1", "select o_orderkey, o_custkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders where o_orderstatus = 'O') n where rn = 1 and o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
    norm_s, norm_d = "regexp_replace(lower({0}), '[^a-z0-9]', '')", "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
    fuzzy = """with j as (select {pn} as k, min(p_partkey) as pos, max(p_retailprice) as jif from part group by {pn}),
    q as (select p_partkey, {qn} as k from part),
    exact as (select q.p_partkey, j.k as journal, j.jif, 'exact' as how from q join j on q.k = j.k),
    rest as (select distinct q.k from q left join j on q.k = j.k where j.k is null),
    near as (select r.k, j.k as journal, j.jif, row_number() over (partition by r.k order by j.pos) as rn from rest r join j on (contains(j.k, r.k) or contains(r.k, j.k)) and least(length(j.k), length(r.k)) > 0.7 * greatest(length(j.k), length(r.k)))
    select p_partkey, journal, jif, how from exact union all select q.p_partkey, near.journal, near.jif, 'near' from q join near on q.k = near.k where rn = 1"""
    c.sql("journal_exact_fuzzy", "part", fuzzy.format(pn=norm_s.format("p_name"), qn=norm_s.format("case when p_partkey % 2 = 0 then p_name else substring(p_name, 2) end")), fuzzy.format(pn=norm_d.format("p_name"), qn=norm_d.format("case when p_partkey % 2 = 0 then p_name else substring(p_name, 2) end")))
    c.sql("journal_lookup_or", "part", "select p_partkey, p_name from part where p_brand = 'Brand#11' or contains(lower(p_name), 'red') order by p_partkey limit 50")
    c.sql("top_n_journals", "part", "select p_partkey, p_name, p_retailprice from part order by p_retailprice desc, p_partkey limit 25")
    # a term's longest inner word stands whole in every text that holds the term: an equi-join on it, then the term itself;
    # terms without an inner word are compared with each text
    c.sql("vocabulary_substring_join", "benchmark documents", """with v as (select item_id, lower(text) as term, array_max(transform(regexp_extract_all(lower(text), '(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])', 0), w -> named_struct('n', length(w), 'w', w))).w as anchor from benchmark),
    w as (select doc_id, explode(array_distinct(regexp_extract_all(lower(text), '[a-z0-9]+', 0))) as word from documents), pairs as (select v.item_id, v.term, w.doc_id from w join v on w.word = v.anchor)
    select p.item_id, d.doc_id from pairs p join documents d on p.doc_id = d.doc_id where contains(lower(d.text), p.term)
    union all select v.item_id, d.doc_id from documents d join v on contains(lower(d.text), v.term) where v.anchor is null""", "select b.item_id, d.doc_id from documents d join benchmark b on contains(lower(d.text), lower(b.text))")
    c.sql("first_reason", "orders", "select o_orderkey, case when o_orderstatus is null then 'no status' when o_totalprice < 5000 then 'small' when o_orderstatus = 'P' then 'pending' when o_orderkey = o_custkey then 'loop' end as reason from orders")
    c.sql("doi_version", "pages", "select page_id, regexp_extract(d, '^(10[.][0-9]+/.+?)(?:v([0-9]+))?$', 1) as doi, regexp_extract(d, '^(10[.][0-9]+/.+?)(?:v([0-9]+))?$', 2) as version from (select page_id, case when page_id % 3 = 0 then concat('10.1101/', page_id) else concat('10.1101/', page_id, 'v', page_id % 4 + 1) end as d from pages) x")
    c.sql("excluded_names", "part", "select p_partkey from part where not regexp_like(p_name, '^(re|gr)') and not startswith(p_name, '__')", "select p_partkey from part where not regexp_matches(p_name, '^(re|gr)') and not starts_with(p_name, '__')")
    c.sql("digest_lines", "documents", "select lang, concat('- ', lang, ': ', listagg(source, ', ') within group (order by source)) as line from (select distinct lang, source from documents) x group by lang", "select lang, concat('- ', lang, ': ', string_agg(source, ', ' order by source)) as line from (select distinct lang, source from documents) x group by lang")
    c.sql("user_sessions", "events", "select user_id, s.start as began, n from (select user_id, session_window(ts, '6 hours') as s, count(*) as n from events group by user_id, session_window(ts, '6 hours')) x", "with g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 6 hour then 0 else 1 end as fresh from events), k as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as began, count(*) as n from k group by user_id, s")
    cand_s = "select doc_id, explode(array_distinct(regexp_extract_all(text, '[A-Z][A-Za-z]{2,7}', 0))) as term from documents"
    cand_d = "select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][A-Za-z]{2,7}'))) as term from documents"
    semi = ", voc as (select term from c group by term having count(*) between 20 and 200) select c.doc_id, count(*) as terms from c {} join voc on c.term = voc.term group by c.doc_id"
    c.sql("candidate_semi_join", "documents", f"with c as ({cand_s})" + semi.format("left semi"), f"with c as ({cand_d})" + semi.format(""))
    shared = """, d as (select term from c group by term having count(*) between 2 and 60), k as (select doc_id, term from (select c.doc_id, c.term, row_number() over (partition by c.term order by c.doc_id) as rn from c join d on c.term = d.term) x where rn <= 15)
    select a.doc_id as source, b.doc_id as target, count(*) as shared from k a join k b on a.term = b.term and a.doc_id < b.doc_id group by a.doc_id, b.doc_id having count(*) >= 2"""
    c.sql("shared_entity_edges", "documents", f"with c as ({cand_s}){shared}", f"with c as ({cand_d}){shared}")
    two = """with d as (select distinct l_orderkey as id, l_suppkey as k from lineitem), m as (select distinct l_orderkey as id, l_partkey as k from lineitem),
    dc as (select id, k from (select *, row_number() over (partition by k order by id) as rn from d) x where rn <= 20), mc as (select id, k from (select *, row_number() over (partition by k order by id) as rn from m) x where rn <= 20),
    dp as (select distinct a.id as s, b.id as t from dc a join dc b on a.k = b.k and a.id < b.id), mp as (select distinct a.id as s, b.id as t from mc a join mc b on a.k = b.k and a.id < b.id)
    select s as source, t as target from dp intersect select s, t from mp"""
    c.sql("disease_method_edges", "lineitem", two)
    c.sql("paradigm_edges", "documents", """with p as (select doc_id, w from (select doc_id, explode(array('erhea', 'thand', 'tionth', 'blethe', 'oner')) as w, text from (select * from documents order by doc_id limit 200) d) x where contains(lower(text), w))
    select a.doc_id as source, b.doc_id as target, count(*) as words from p a join p b on a.w = b.w and a.doc_id < b.doc_id group by a.doc_id, b.doc_id""", """with p as (select doc_id, w from (select doc_id, unnest(['erhea', 'thand', 'tionth', 'blethe', 'oner']) as w, text from (select * from documents order by doc_id limit 200) d) x where contains(lower(text), w))
    select a.doc_id as source, b.doc_id as target, count(*) as words from p a join p b on a.w = b.w and a.doc_id < b.doc_id group by a.doc_id, b.doc_id""")
    c.sql("explicit_reference_edges", "lineitem orders", "select distinct l.l_orderkey as source, o.o_orderkey as target from lineitem l join orders o on l.l_partkey = o.o_orderkey where l.l_orderkey <> o.o_orderkey")
    # concepts: a conversation, named by its first words; the paper of its first turn, and those of all its user's turns
    concepts = """with said as (select conv_id, turn, text, (conv_id * 7 + turn) % 400 as paper from conversations where role = 'user'),
    c as (select conv_id as id, min_by(paper, turn) as source_paper, {collect}(paper) as source_papers, min_by(text, turn) as definition from said group by conv_id),
    e as (select distinct id, definition, paper from (select id, definition, source_paper as paper from c union all {rest}) x where paper is not null and paper <> 0)
    select e.paper as source, e.id as target, 'defines_concept' as kind, substring(e.definition, 1, 120) as definition, d.lang from e join documents d on d.doc_id = e.paper"""
    c.sql("concept_edges", "conversations documents", concepts.format(collect="collect_list", rest="select id, definition, explode(source_papers) from c"), concepts.format(collect="list", rest="select id, definition, unnest(source_papers) from c"))
    c.sql("edge_priority_union", "orders lineitem", """with e as (select o_custkey as s, o_orderkey as t, 1 as pri from orders where o_orderstatus = 'F' union all select l_suppkey, l_orderkey, 2 from lineitem union all select o_custkey, o_orderkey, 3 from orders)
    select s as source, t as target, pri from (select *, row_number() over (partition by s, t order by pri) as rn from e) x where rn = 1""")
    html = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' '{g}), '(?is)<style[^>]*>.*?</style>', ' '{g}), '<[^>]+>', ' '{g}), '[ \t\n]+', ' '{g}))"
    c.sql("html_to_text", "pages", f"select page_id, {html.format(g='')} as text from pages", f"select page_id, {html.format(g=', chr(103)')} as text from pages")
    c.sql("json_props_extract", "events", "select event_type, sum(cast(get_json_object(props, '$.k') as bigint)) as k from events group by event_type", "select event_type, cast(sum(cast(props->>'$.k' as bigint)) as bigint) as k from events group by event_type")
    c.sql("boilerplate_line_filter", "documents", "select doc_id, count(*) as kept from (select doc_id, line, lag(line) over (partition by doc_id order by pos) as before from (select doc_id, posexplode(split(text, '\n')) as (pos, line) from documents) x) y where (before is null or before <> line) and not contains(line, 'Licensed under') group by doc_id", "select doc_id, count(*) as kept from (select doc_id, line, lag(line) over (partition by doc_id order by pos) as before from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents) x) y where (before is null or before <> line) and not contains(line, 'Licensed under') group by doc_id")
    c.sql("citation_format", "documents", "select doc_id, concat('@article{', source, '_', 2000 + doc_id % 25, '_', lower(split_part(regexp_replace(text, '[^A-Za-z ]', ''), ' ', 1)), ', lang = {', lang, '}}') as bib, concat('TY  - JOUR', chr(10), 'ID  - ', doc_id, chr(10), 'ER  - ') as ris from documents", "select doc_id, concat('@article{', source, '_', 2000 + doc_id % 25, '_', lower(split_part(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ', 1)), ', lang = {', lang, '}}') as bib, concat('TY  - JOUR', chr(10), 'ID  - ', doc_id, chr(10), 'ER  - ') as ris from documents")
    c.sql("source_group_rules", "pages", "select page_id, case when contains(lower(url), 'spam') then 'spam' when contains(lower(url), 'blog') then 'blog' when contains(lower(url), 'example.org') then 'org' else 'other' end as grp, substring(url, 1, 60) as label, case when length(html) > 4000 then 18 when length(html) > 2000 then 12 else 7 end as size from pages")
    c.sql("bad_content", "pages", "select page_id from pages where length(html) < 1000 or regexp_like(substring(html, 1, 2000), '(?i)captcha|access denied|just a moment')", "select page_id from pages where length(html) < 1000 or regexp_matches(substring(html, 1, 2000), '(?i)captcha|access denied|just a moment')")
    c.sql("lenient_numbers", "events", "select event_id, coalesce(try_cast(regexp_replace(get_json_object(props, '$.k'), '[<>]', '') as double), 0) as safe, case when get_json_object(props, '$.k') in ('', 'N/A', '-') then null else try_cast(replace(get_json_object(props, '$.k'), ',', '') as double) end as number from events", "select event_id, coalesce(try_cast(regexp_replace(props->>'$.k', '[<>]', '', 'g') as double), 0) as safe, case when props->>'$.k' in ('', 'N/A', '-') then null else try_cast(replace(props->>'$.k', ',', '') as double) end as number from events")
    c.sql("file_sizes", "documents", "select source, count(*) as files, cast(sum(n_chars) as bigint) as bytes, case when sum(n_chars) < 1024 then concat(sum(n_chars), ' B') when sum(n_chars) < 1048576 then concat(cast(floor(sum(n_chars) / 1024) as bigint), ' KB') else concat(cast(floor(sum(n_chars) / 1048576) as bigint), ' MB') end as shown from documents group by source")
    c.sql("snippets", "documents", "select doc_id, substring(regexp_replace(text, '[?？](.|\n)*', ''), 1, 50) as snippet from documents")
    c.sql("query_templates", "nation region", "select n_name, t.kind, concat('(', n_name, ' AND ', r_name, ') ', t.kind) as query from nation join region on n_regionkey = r_regionkey cross join (select 'review' as kind union all select 'trial') t")
    c.sql("distinct_versus_total", "documents", "select count(*) as total, count(distinct concat_ws('|', lang, source, md5(text))) as unique_rows from documents")
    c.sql("node_universe", "orders customer", "select o_custkey as id from orders union select c_custkey from customer")
    c.sql("set_differences", "orders", "select o_custkey from orders where o_orderstatus = 'O' except select o_custkey from orders where o_orderstatus = 'F'")
    c.sql("stream_dedup_final", "events", "select event_id, user_id, event_type from (select *, row_number() over (partition by event_id order by ts) as rn from events) x where rn = 1")
    c.sql("daily_digest_window", "events", "select cast(date_trunc('day', ts) as timestamp) as day, count(*) as n, count(distinct user_id) as users, round(sum(value), 4) as total from events group by date_trunc('day', ts)", "select cast(date_trunc('day', ts) as timestamp) as day, count(*) as n, count(distinct user_id) as users, round(sum(value), 4) as total from events group by date_trunc('day', ts)")
