"""Cells, spots, counts and slides: grids, neighbours, balanced aggregates, ranks, allocation and risk.

Stand-ins: a cell is a row of embeddings (x, y: its first two components, class: label), a spot a supplier, a gene a brand,
a count the quantity of a lineitem, a hierarchy region, nation, customer.
"""

from .base import Catalog

CELLS_S = "select vec_id as id, cast(element_at(embedding, 1) as double) as x, cast(element_at(embedding, 2) as double) as y, label as cls from embeddings"
CELLS_D = "select vec_id as id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, label as cls from embeddings"
COUNTS = "select l_suppkey as spot, p_brand as gene, sum(l_quantity) as n from lineitem join part on l_partkey = p_partkey group by l_suppkey, p_brand"
R = 0.05  # radius of neighbour joins, and the edge of a grid cell


def add(c: Catalog) -> None:
    def cells(name: str, rest: str, used: str = "embeddings") -> None:
        c.sql(name, used, f"with cells as ({CELLS_S}){rest}", f"with cells as ({CELLS_D}){rest}")

    # neighbours: an equi-join on grid cells as wide as the radius, each cell against nine
    near = f""", off as (select dx, dy from (select -1 as dx union all select 0 union all select 1) a cross join (select -1 as dy union all select 0 union all select 1) b),
    g as (select *, cast(floor(x / {R}) as bigint) as gx, cast(floor(y / {R}) as bigint) as gy from cells),
    probe as (select g.*, gx + dx as px, gy + dy as py from g cross join off),
    near as (select a.id as a, b.id as b, a.cls as ca, b.cls as cb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from probe a join g b on a.px = b.gx and a.py = b.gy where a.id <> b.id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {R * R})"""
    knn = near + ", k as (select a, b, d, ca, cb from (select *, row_number() over (partition by a order by d, b) as rn from near) z where rn <= 6), edges as (select distinct least(a, b) as u, greatest(a, b) as v, d, case when a < b then ca else cb end as cu, case when a < b then cb else ca end as cv from k)"
    cells("knn_union_edges", knn + " select u, v, round(d, 6) as dist from edges")
    cells("radius_counts", near + " select a as id, count(*) as n, count(case when ca = cb then 1 end) as same, round(avg(d), 6) as mean_dist from near group by a")
    cells("nearest_within_group", near + " select a as id, b as nearest, round(d, 6) as dist from (select *, row_number() over (partition by a order by d, b) as rn from near where ca = cb) z where rn = 1")
    cells("triplet_edges", knn + " select u, count(*) as degree, round(max(d), 6) as far from edges group by u")
    grid = f", g as (select *, cast(floor(x / 0.1) as bigint) as ix, cast(floor(y / 0.1) as bigint) as iy from cells), regions as (select ix, iy, count(*) as n, round(avg(x), 6) as cx, round(avg(y), 6) as cy from g group by ix, iy)"
    cells("grid_regions", grid + " select * from regions")
    cells("grid_adjacency_4", grid + ", o as (select 1 as dx, 0 as dy union all select 0, 1 union all select -1, 0 union all select 0, -1) select a.ix, a.iy, b.ix as jx, b.iy as jy from (select ix, iy, ix + dx as px, iy + dy as py from regions cross join o) a join regions b on a.px = b.ix and a.py = b.iy")
    cells("grid_adjacency_8", grid + ", o as (select 1 as dx, 0 as dy union all select 0, 1 union all select 1, 1 union all select 1, -1) select a.ix, a.iy, b.ix as jx, b.iy as jy, a.n + b.n as cells from (select ix, iy, n, ix + dx as px, iy + dy as py from regions cross join o) a join regions b on a.px = b.ix and a.py = b.iy")
    cells("halo_members", grid + ", o as (select dx, dy from (select -1 as dx union all select 0 union all select 1) a cross join (select -1 as dy union all select 0 union all select 1) b), t as (select r.ix, r.iy, r.ix + dx as px, r.iy + dy as py from regions r cross join o) select t.ix, t.iy, count(*) as members from t join g on t.px = g.ix and t.py = g.iy where g.x >= t.ix * 0.1 - 0.03 and g.x < (t.ix + 1) * 0.1 + 0.03 and g.y >= t.iy * 0.1 - 0.03 and g.y < (t.iy + 1) * 0.1 + 0.03 group by t.ix, t.iy")
    cells("dominant_class", grid + ", m as (select ix, iy, cls, count(*) as n from g group by ix, iy, cls) select ix, iy, cls, n from (select *, row_number() over (partition by ix, iy order by n desc, cls) as rn from m) z where rn = 1")
    cells("composition_census", grid + ", m as (select ix, iy, cls, count(*) as n from g group by ix, iy, cls) select ix, iy, cls, round(n / cast(sum(n) over (partition by ix, iy) as double), 6) as share from m")
    cells("composition_entropy", grid + ", m as (select ix, iy, cls, count(*) as n from g group by ix, iy, cls), p as (select ix, iy, n / cast(sum(n) over (partition by ix, iy) as double) as p from m) select ix, iy, round(abs(sum(p * ln(p))) / ln(10.0), 6) as entropy, round(exp(-sum(p * ln(p))), 6) as effective from p group by ix, iy")
    cells("region_mean_std", grid + " select ix, iy, round(avg(x), 6) as mx, round(stddev_pop(x), 6) as sx, round(avg(y), 6) as my, round(stddev_pop(y), 6) as sy from g group by ix, iy")
    cells("typed_enrichment", knn + ", o as (select least(cu, cv) as p, greatest(cu, cv) as q, count(*) as n from edges group by least(cu, cv), greatest(cu, cv)), st as (select cls, count(*) as n from (select cu as cls from edges union all select cv from edges) z group by cls), t as (select sum(n) as s from st), e as (select o.p, o.q, o.n, (case when o.p = o.q then 1 else 2 end) * cast(a.n as double) * b.n / (2.0 * t.s) as x from o join st a on o.p = a.cls join st b on o.q = b.cls cross join t) select p, q, n, round(greatest(-6.0, least(6.0, ln((n + 1) / (x + 1)) / ln(2.0))), 6) as enrichment from e")
    cells("edge_fractions", knn + " select round(avg(case when cu <> cv then 1e0 else 0e0 end), 6) as heterotypic, round(avg(case when d < 0.02 then 1e0 else 0e0 end), 6) as close, count(*) as edges from edges")
    hop = "select i, cls, sum(p) / max(deg) as p from (select n.i, l.cls, l.p, n.deg from nb n join {0} l on n.j = l.id) z group by i, cls"
    cells("propagate_2hop", knn + f", both_ways as (select u as i, v as j from edges union all select v, u from edges union all select id, id from cells), nb as (select i, j, count(*) over (partition by i) as deg from both_ways), l0 as (select id, cls, 1e0 as p from cells), l1 as (select i as id, cls, p from ({hop.format('l0')}) y), l2 as ({hop.format('l1')}) select i as id, cls, round(p, 6) as p from l2")
    cells("region_delta", grid + ", o as (select 0 as dx, 0 as dy union all select 1, 0 union all select 0, 1 union all select -1, 0 union all select 0, -1) select a.ix, a.iy, round(avg(cast(b.n as double)) - max(a.n), 6) as delta from (select ix, iy, n, ix + dx as px, iy + dy as py from regions cross join o) a join regions b on a.px = b.ix and a.py = b.iy group by a.ix, a.iy")
    cells("spatial_folds", " select id, ntile(5) over (order by x + y, id) as fold from cells")
    cells("spatial_blocks", ", m as (select min(x) as mx, min(y) as my from cells) select id, cast(floor((x - mx) / 0.2) as bigint) as bx, cast(floor((y - my) / 0.2) as bigint) as b_y from cells cross join m")
    cells("modular_folds", " select id, (3 * cast(floor((x + 10) / 0.1) as bigint) + 2 * cast(floor((y + 10) / 0.1) as bigint)) % 5 as fold from cells")
    cells("quota_topk", " select id, cls from (select *, row_number() over (partition by cls order by x desc, id) as rn from cells) z where rn <= 10")
    cells("hash_sample_balanced", " select id, cls from (select *, row_number() over (partition by cls order by md5(cast(id as string)), id) as rn from cells) z where rn <= 20")
    cells("soft_prototypes", ", c as (select cls, avg(x) as cx, avg(y) as cy from cells group by cls), e as (select id, c.cls, greatest(-40.0, -((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (2 * 0.01)) as l from cells cross join c), s as (select *, exp(l - max(l) over (partition by id)) as w from e) select id, cls, round(w / sum(w) over (partition by id), 6) as p from s")
    cells("risk_score", ", s as (select cls, avg(x) as m, stddev_pop(x) as s from cells group by cls), r as (select sum(m * (cls + 1) - s * (10 - cls)) as raw from s), q as (select avg(m) as centre, max(m) - min(m) as spread from s) select round((raw - centre) / spread, 6) as risk from r cross join q")
    cells("polygon_area", ", p as (select cls, x, y, row_number() over (partition by cls order by id) as i, count(*) over (partition by cls) as n from cells) select a.cls, round(abs(sum(a.x * b.y - b.x * a.y)) / 2, 6) as area from p a join p b on a.cls = b.cls and b.i = a.i % a.n + 1 group by a.cls")
    cells("kernel_weights", near + " select a as id, round(sum(exp(-d * d / (2 * 0.0004))), 6) as gauss, round(sum(exp(-d / 0.02)), 6) as expo from near group by a")
    cells("spline_basis", " select id, round(greatest(least(x * 4, 6.0) + 1, 0.0), 6) as h1, round(greatest(least(x * 4, 6.0), 0.0), 6) as h2, round(greatest(least(x * 4, 6.0) - 1, 0.0), 6) as h3 from cells")
    cells("buffered_training", near + " select c.id from cells c left join (select distinct near.a from near where near.b % 5 = 0) x on c.id = x.a where c.id % 5 <> 0 and x.a is null")
    cells("graph_smoothing", knn + ", w as (select u as i, v as j, exp(-d / 0.02) as w from edges union all select v, u, exp(-d / 0.02) from edges) select i as id, round(sum(w * c.x) / sum(w), 6) as smooth from w join cells c on w.j = c.id group by i")
    cells("pair_ids", knn + ", p as (select cast(least(cu, cv) * 10 - floor(least(cu, cv) * (least(cu, cv) - 1) / 2) + greatest(cu, cv) - least(cu, cv) as bigint) as pair from edges) select pair, count(*) as n from p group by pair")
    cells("grouped_folds", " select id, (dense_rank() over (order by floor(x / 0.2), floor(y / 0.2)) - 1) % 5 as fold from cells")
    c.sql("row_cosine", "embeddings", "select label, round(aggregate(zip_with(a, b, (x, y) -> cast(x as double) * y), cast(0 as double), (s, z) -> s + z) / sqrt(aggregate(transform(a, x -> cast(x as double) * x), cast(0 as double), (s, z) -> s + z) * aggregate(transform(b, x -> cast(x as double) * x), cast(0 as double), (s, z) -> s + z)), 6) as cosine from (select label, min_by(embedding, vec_id) as a, max_by(embedding, vec_id) as b from embeddings group by label) z", "select label, round(list_dot_product(list_transform(a, lambda x: x::double), list_transform(b, lambda x: x::double)) / sqrt(list_dot_product(list_transform(a, lambda x: x::double), list_transform(a, lambda x: x::double)) * list_dot_product(list_transform(b, lambda x: x::double), list_transform(b, lambda x: x::double))), 6) as cosine from (select label, min_by(embedding, vec_id) as a, max_by(embedding, vec_id) as b from embeddings group by label) z")

    def counts(name: str, rest: str, used: str = "lineitem part") -> None:
        c.sql(name, used, f"with counts as ({COUNTS}){rest}")

    lib = ", lib as (select spot, sum(n) as lib from counts group by spot), cp as (select c.spot, c.gene, c.n, l.lib, ln(1 + 10000 * c.n / l.lib) as v from counts c join lib l on c.spot = l.spot)"
    counts("cp10k_log1p", lib + " select spot, gene, round(v, 6) as v from cp")
    counts("hvg_rank_score", lib + ", s as (select count(*) as spots from lib), m as (select gene, sum(v) / max(spots) as mean, sum(v * v) / max(spots) as second from cp cross join s group by gene), d as (select gene, mean, second - mean * mean as var, (second - mean * mean) / greatest(mean, 0.05) as disp from m) select gene, round(mean, 6) as mean, round(var, 6) as var, round((row_number() over (order by round(var, 9), gene) - 1) / cast(count(*) over () - 1 as double), 6) as score from d")
    counts("panel_topk", " , t as (select gene, sum(n) as total, count(*) as spots from counts group by gene) select gene, total, spots from t order by total desc, spots desc, gene limit 12")
    counts("class_profiles", ", g as (select spot % 5 as cls, gene, sum(n) + 0.25 as n from counts group by spot % 5, gene) select cls, gene, round(n / sum(n) over (partition by cls), 6) as p from g")
    counts("theta_w_decode", ", th as (select spot, spot % 5 as k, 0.7 as p from counts group by spot union all select spot, (spot + 1) % 5, 0.3 from counts group by spot), g as (select spot % 5 as k, gene, sum(n) as n from counts group by spot % 5, gene), w as (select k, gene, n / sum(n) over (partition by k) as p from g) select th.spot, w.gene, round(sum(th.p * w.p), 6) as p from th join w on th.k = w.k group by th.spot, w.gene")
    counts("softmax_two_pass", ", m as (select *, n / 100.0 as l from counts), e as (select spot, gene, exp(l - max(l) over (partition by spot)) as e from m) select spot, gene, round(e / sum(e) over (partition by spot), 6) as p from e")
    counts("posterior_shrinkage", lib + ", t as (select sum(n) as total from counts), pr as (select gene, sum(n) / max(total) as prior from counts cross join t group by gene) select cp.spot, cp.gene, round((cp.n + 50 * prior) / (lib + 50), 6) as p from cp join pr on cp.gene = pr.gene")
    counts("nll_tau_select", lib + ", t as (select sum(n) as total from counts), pr as (select gene, sum(n) / max(total) as prior from counts cross join t group by gene), tau as (select 1e1 as tau union all select 5e1 union all select 2.5e2), s as (select tau, -sum(cp.n * ln(greatest((cp.n + tau * prior) / (lib + tau), 1e-12))) / sum(cp.n) as nll from cp join pr on cp.gene = pr.gene cross join tau group by tau) select tau, round(nll, 6) as nll, case when row_number() over (order by nll, tau) = 1 then 1 else 0 end as chosen from s")
    counts("proportional_allocation", ", links as (select s_suppkey as spot, s_suppkey * 10 + k as cell, 1.0 + k as w from supplier cross join (select 0 as k union all select 1 union all select 2) z) select l.cell, c.gene, round(c.n * w / sum(w) over (partition by c.spot, c.gene), 6) as n from counts c join links l on c.spot = l.spot", "lineitem part supplier")
    counts("conservation_audit", ", linked as (select s_suppkey as spot from supplier where s_acctbal > 0) select sum(c.n) as observed, sum(case when l.spot is not null then c.n else 0 end) as assigned, sum(case when l.spot is null then c.n else 0 end) as unassigned from counts c left join linked l on c.spot = l.spot", "lineitem part supplier")
    rounds, last = "", "p0"
    for i in range(4):  # iterative proportional fitting: rows to the spot's library, then columns to the gene's total
        rounds += f", r{i} as (select p.spot, p.gene, p.v * l.lib / sum(p.v) over (partition by p.spot) as v from {last} p join lib l on p.spot = l.spot), p{i + 1} as (select r.spot, r.gene, r.v * g.tot / sum(r.v) over (partition by r.gene) as v from r{i} r join gt g on r.gene = g.gene)"
        last = f"p{i + 1}"
    counts("ipf_4_rounds", lib + f", gt as (select gene, sum(n) as tot from counts group by gene), p0 as (select spot, gene, sqrt(n) as v from counts){rounds} select spot, gene, round(v, 4) as v from p4")
    counts("mass95_effective", ", p as (select spot, gene, n / sum(n) over (partition by spot) as p from counts), r as (select *, sum(p) over (partition by spot order by p desc, gene rows between unbounded preceding and 1 preceding) as before from p) select spot, count(case when coalesce(before, 0) < 0.95 then 1 end) as n95, round(exp(-sum(p * ln(p))), 6) as effective from r group by spot")
    counts("cumulative_support", ", p as (select spot, gene, n / sum(n) over (partition by spot) as p from counts), r as (select *, coalesce(sum(p) over (partition by spot order by p desc, gene rows between unbounded preceding and 1 preceding), 0) as before from p) select spot, gene, round(p, 6) as p from r where before < 0.5 or p >= 0.08")
    counts("top2_entropy", ", p as (select spot, gene, n / sum(n) over (partition by spot) as p from counts), r as (select *, row_number() over (partition by spot order by p desc, gene) as rn from p) select spot, max(case when rn = 1 then gene end) as first, max(case when rn = 2 then gene end) as second, round(max(p), 6) as weight, round(-sum(p * ln(p)) / ln(25.0), 6) as entropy from r group by spot")
    counts("recall_at_k", ", t as (select spot, gene, n, case when gene < 'Brand#3' then 1 else 0 end as hit, row_number() over (partition by spot order by n desc, gene) as rn, sum(case when gene < 'Brand#3' then 1 else 0 end) over (partition by spot) as k from counts) select spot, round(sum(case when rn <= k then hit else 0 end) / cast(max(k) as double), 6) as recall from t group by spot")
    counts("average_precision", ", t as (select spot, gene, case when gene < 'Brand#3' then 1 else 0 end as hit, row_number() over (partition by spot order by n desc, gene) as rn from counts), q as (select spot, hit, rn, sum(hit) over (partition by spot order by rn rows between unbounded preceding and current row) as got from t) select spot, round(avg(case when hit = 1 then got / cast(rn as double) end), 6) as ap from q group by spot")
    counts("weighted_idf", ", s as (select count(distinct spot) as n from counts) select gene, count(*) as df, round(ln((max(s.n) + 1) / cast(count(*) + 1 as double)) + 1, 6) as idf from counts cross join s group by gene")
    counts("marker_weights", ", m as (select gene, case when gene < 'Brand#2' then 4e0 else 5e-1 end as w from counts group by gene) select gene, round(w / sum(w) over (), 6) as w from m")
    counts("jensen_shannon", ", p as (select gene, sum(case when spot % 2 = 0 then n else 0 end) as a, sum(case when spot % 2 = 1 then n else 0 end) as b from counts group by gene), q as (select a / sum(a) over () as a, b / sum(b) over () as b from p) select round(sum(0.5 * a * ln(2 * a / (a + b)) + 0.5 * b * ln(2 * b / (a + b))), 8) as jsd, round(sqrt(0.5 * sum((sqrt(a) - sqrt(b)) * (sqrt(a) - sqrt(b)))), 8) as hellinger from q where a > 0 and b > 0")
    shares = ", p as (select spot, gene, n / sum(n) over (partition by spot) as p from counts)"
    counts("core_programs", shares + ", r as (select *, coalesce(sum(p) over (partition by spot order by p desc, gene rows between unbounded preceding and 1 preceding), 0) as before from p) select spot, gene from r where before < 0.99 or p >= 0.02")
    counts("relative_enrichment", shares + ", q as (select *, avg(p) over (partition by gene) as prev from p) select spot, gene, round(p / pow(prev, 0.5), 6) as enrichment from q")
    counts("detection_counts", " select gene, count(*) as spots, count(distinct spot % 10) as slides from counts where n > 0 group by gene")
    counts("forced_panel", ", t as (select gene, sum(n) as total, case when gene in ('Brand#11', 'Brand#55') then 1 else 0 end as forced from counts group by gene) select gene, total, forced from t order by forced desc, total desc, gene limit 8")
    counts("majority_part", ", m as (select spot, substring(gene, 1, 7) as part, sum(n) as n from counts group by spot, substring(gene, 1, 7)) select spot, part, n from (select *, row_number() over (partition by spot order by n desc, part) as rn from m) z where rn = 1")
    counts("gene_halves", ", t as (select gene, sum(n) as n from counts group by gene), r as (select gene, row_number() over (order by n desc, gene) as rn from t) select gene, case when rn % 2 = 0 then 'graph' else 'selection' end as half from r")
    c.sql("reliability_gate", "lineitem", "with l as (select l_linenumber as k, avg(pow(l_quantity - 25 + l_linenumber, 2)) as loss, avg(pow(l_quantity - 20, 2)) as base from lineitem group by l_linenumber) select k, round(case when loss >= base then 0e0 else greatest(0e0, least(1e0, 1 - loss / base)) end, 6) as reliability from l")
    c.sql("hex_grid", "region", "select i as r, j as c, j + 0.5e0 * (i % 2) as x, round(i * sqrt(0.75e0), 6) as y from (select explode(sequence(0, 19)) as i) a lateral view explode(sequence(0, 19)) b as j", "select i as r, j as c, j + 0.5e0 * (i % 2) as x, round(i * sqrt(0.75e0), 6) as y from range(0, 20) a(i), range(0, 20) b(j)")
    hier = "with h as (select r_name as source, n_name as patient, c_custkey as slide, o_totalprice as v from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
    four = "orders customer nation region"
    c.sql("balanced_mean_3level", four, hier + ", a as (select source, patient, slide, avg(v) as v from h group by source, patient, slide), b as (select source, patient, avg(v) as v from a group by source, patient), d as (select source, avg(v) as v from b group by source) select round(avg(v), 4) as balanced, count(*) as sources from d")
    c.sql("balanced_weights", four, hier + ", r as (select source, patient, slide from h group by source, patient, slide), p as (select source, patient, count(*) as n from r group by source, patient), s as (select source, count(*) as n from p group by source), t as (select count(*) as n from s) select r.slide, round(1e0 / (t.n * s.n * p.n), 9) as w from r join p on r.source = p.source and r.patient = p.patient join s on r.source = s.source cross join t")
    c.sql("source_weights", four, hier + ", s as (select source, count(*) as n from h group by source), w as (select source, pow(n, -0.5) as w from s) select source, round(w / avg(w) over (), 6) as w from w")
    c.sql("program_support_rollup", four, hier + " select source, count(*) as spots, count(distinct slide) as slides, count(distinct patient) as patients, round(median(v), 4) as med from h group by source")
    c.sql("rollup_report", four, hier + " select source, patient, count(*) as n, round(avg(v), 4) as v from h group by rollup (source, patient)")
    c.sql("category_codes", "nation", "select n_name, dense_rank() over (order by n_name) - 1 as code from nation")
    c.sql("patient_split", "customer", "select c_custkey, case when rn <= 0.6 * n then 'train' when rn <= 0.8 * n then 'val' else 'test' end as split from (select c_custkey, row_number() over (order by md5(cast(c_custkey as string)), c_custkey) as rn, count(*) over () as n from customer) z")
    c.sql("column_pearson", "lineitem", "select l_returnflag, round((avg(l_quantity * l_extendedprice) - avg(l_quantity) * avg(l_extendedprice)) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0), 5) as r from lineitem group by l_returnflag")
    c.sql("quantile_summary", "lineitem", "select l_returnflag, round(percentile(l_extendedprice, 0.05), 4) as q05, round(percentile(l_extendedprice, 0.5), 4) as q50, round(percentile(l_extendedprice, 0.95), 4) as q95, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem group by l_returnflag", "select l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) as q05, round(quantile_cont(l_extendedprice, 0.5), 4) as q50, round(quantile_cont(l_extendedprice, 0.95), 4) as q95, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem group by l_returnflag")
    c.sql("weighted_cvar", "orders", "with r as (select o_orderpriority as g, o_totalprice as v, 1.0 + o_orderkey % 3 as w, o_orderkey as k from orders), t as (select g, v, w, sum(w) over (partition by g) * 0.1 as target, coalesce(sum(w) over (partition by g order by v desc, k rows between unbounded preceding and 1 preceding), 0) as before from r), u as (select g, v, least(w, greatest(target - before, 0)) as w from t) select g, round(sum(v * w) / sum(w), 4) as cvar from u group by g")
    c.sql("weighted_means", "lineitem", "select l_linestatus, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) as weighted, round(exp(avg(ln(greatest(l_discount, 1e-6)))), 8) as geometric, round(pow(sum(l_quantity), 2) / sum(l_quantity * l_quantity), 4) as support from lineitem group by l_linestatus")
    c.sql("robust_scale", "lineitem", "with q as (select l_returnflag as g, percentile(l_quantity, 0.5) as m, percentile(l_quantity, 0.75) - percentile(l_quantity, 0.25) as i from lineitem group by l_returnflag) select l_orderkey, l_linenumber, round(greatest(-8.0, least(8.0, (l_quantity - m) / case when i < 1e-5 then 1.0 else i end)), 6) as z from lineitem join q on l_returnflag = g", "with q as (select l_returnflag as g, quantile_cont(l_quantity, 0.5) as m, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) as i from lineitem group by l_returnflag) select l_orderkey, l_linenumber, round(greatest(-8.0, least(8.0, (l_quantity - m) / case when i < 1e-5 then 1.0 else i end)), 6) as z from lineitem join q on l_returnflag = g")
    c.sql("mad_scale", "lineitem", "with q as (select l_returnflag as g, median(l_tax) as m from lineitem group by l_returnflag), d as (select l_returnflag as g, median(abs(l_tax - m)) * 1.4826 as s, max(m) as m from lineitem join q on l_returnflag = g group by l_returnflag) select l_orderkey, l_linenumber, round(greatest(-5.0, least(5.0, (l_tax - m) / s)), 6) as z from lineitem join d on l_returnflag = g")
    c.sql("fold_ensemble", "lineitem", "with f as (select l_orderkey % 5 as fold, avg(l_extendedprice) as v from lineitem group by l_orderkey % 5) select round(median(v), 4) as med, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as sd from f")
    c.sql("one_se_rule", "lineitem", "with l as (select l_linenumber as k, l_orderkey % 5 as fold, avg(abs(l_quantity - 25 + l_linenumber)) as loss from lineitem group by l_linenumber, l_orderkey % 5), s as (select k, avg(loss) as m, stddev_samp(loss) / sqrt(count(*)) as se from l group by k), b as (select m + se as bound from s order by m, k limit 1) select min(k) as k from s cross join b where m <= bound")
    c.sql("tolerance_nearest", "lineitem", "with s as (select l_linenumber as k, avg(l_discount) as m from lineitem group by l_linenumber) select k, round(m, 6) as m from s where m >= (select max(m) - 0.01 from s) order by abs(k - 4), k limit 1")
    c.sql("acceptance_gates", "lineitem", "select l_returnflag, avg(l_discount) >= 0.04 and max(l_tax) <= 0.08 and min(l_quantity) > 0 as accepted from lineitem group by l_returnflag")
    c.sql("probability_rows", "lineitem part", f"with counts as ({COUNTS}), p as (select spot, n / sum(n) over (partition by spot) as p from counts) select spot, count(*) as n, round(sum(p), 9) as total, case when min(p) >= 0 and abs(sum(p) - 1) < 1e-9 then 1 else 0 end as good from p group by spot")
    c.sql("column_r2", "lineitem", "with m as (select avg(l_extendedprice) as y, avg(l_quantity) as x from lineitem), b as (select sum((l_quantity - x) * (l_extendedprice - y)) / sum((l_quantity - x) * (l_quantity - x)) as b, max(x) as x, max(y) as y from lineitem cross join m) select round(1 - sum(pow(l_extendedprice - (y + b * (l_quantity - x)), 2)) / sum(pow(l_extendedprice - y, 2)), 6) as r2, round(max(b), 4) as slope from lineitem cross join b")
