"""All queries on the test tables by name, with the SQL that says the same."""

from .operators import geometry, graphs, models, ordering
from .plans import literature, panels, spatial, tissue
from .plans.base import Catalog
from .streaming import ingest

CATALOG = Catalog()
literature.add(CATALOG)
spatial.add(CATALOG)
tissue.add(CATALOG)
panels.add(CATALOG)

_NEAR = f"with recursive cells as ({spatial.CELLS_D}), e as (select a.id as u, b.id as v from cells a join cells b on a.id <> b.id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0025)"
CATALOG.frame("connected_components", graphs.components_query, _NEAR + ", r as (select id as s, id as t from cells union select r.s, e.v from r join e on r.t = e.u) select s as id, min(t) as component from r group by s")
CATALOG.frame("front_mask", graphs.front_query, _NEAR + """, k as (select id from cells where cls < 5), ke as (select u, v from e where u in (select id from k) and v in (select id from k)),
r as (select id as s, id as t from k union select r.s, ke.v from r join ke on r.t = ke.u), c as (select s as id, count(*) as n from r group by s), large as (select id from c where n >= 3),
b as (select u, v from e where u in (select id from large) and v not in (select id from large)), ring as (select u as id from b union select v from b)
select id, case when id in (select id from ring) then 'front' when id in (select id from large) then 'core' else 'peri' end as part from cells""")
CATALOG.frame("null_space_projection", graphs.null_space_query)
CATALOG.frame("ridge_fit", graphs.ridge_query)
CATALOG.frame("stream_dedup_ingest", ingest.ingest_query, "select event_id, user_id, event_type from (select *, row_number() over (partition by event_id order by ts) as rn from events) x where rn = 1")
CATALOG.frame("grid_overlap_areas", geometry.overlap_query, geometry.OVERLAP_SQL)
CATALOG.frame("global_index", ordering.index_query, ordering.INDEX_SQL)
CATALOG.frame("principal_components", models.pca_query)
CATALOG.frame("weighted_clusters", models.clusters_query)
CATALOG.frame("grouped_ridge", models.grouped_ridge_query, models.GROUPED_RIDGE_SQL)
CATALOG.frame("bootstrap_profiles", models.bootstrap_query)
QUERIES, ORACLE_SQL = CATALOG.queries, CATALOG.oracle
