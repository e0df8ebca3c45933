"""Queries over names, synonyms and hierarchies: part names, brands, regions and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import names as nm
from ..operators.components import connected_components
from .catalogue import Tables, query

REACH = "r(x, y) AS (SELECT x, x FROM (SELECT x FROM l UNION SELECT y FROM l) UNION SELECT r.x, u.y FROM r JOIN (SELECT x, y FROM l UNION ALL SELECT y, x FROM l) u ON r.y = u.x), c AS (SELECT x AS node, min(y) AS root FROM r GROUP BY x)"


@query(f"""WITH RECURSIVE n AS (SELECT DISTINCT p_name AS name, list_distinct(list_filter(list_transform(string_split(lower(p_name), ' '), lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END), lambda w: length(w) >= 3)) AS t FROM part),
l AS (SELECT a.name AS x, b.name AS y FROM n a JOIN n b ON a.name < b.name AND len(list_intersect(a.t, b.t)) > 0 AND (len(list_intersect(a.t, b.t)) = len(a.t) OR len(list_intersect(a.t, b.t)) = len(b.t) OR len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.6)),
{REACH} SELECT name, coalesce(root, name) AS component FROM n LEFT JOIN c ON name = node""")
def site_components(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    labels = connected_components(nm.similar_names(names, least=0.6))
    return names.join(labels, names["name"] == labels["node"], "left").select("name", F.coalesce("component", "name").alias("component"))


@query()
def site_canonical_names(t: Tables) -> DataFrame:
    return nm.canonical_names(t.part.select(F.col("p_name").alias("name")), least=0.6)


@query(f"""WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS x, (o_orderkey % 997) + 100000 AS y FROM orders), {REACH} SELECT node AS code, root FROM c""")
def synonym_components(t: Tables) -> DataFrame:
    pairs = t.orders.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 997 + 100000).alias("b"))
    return nm.synonym_groups(pairs, "a", "b")


@query("""WITH g AS (SELECT p_brand AS code, 'Brand#' || (substr(p_brand, 7)::INT // 3 * 3 + 1) AS root0, p_size, p_name, p_partkey FROM part),
v AS (SELECT code, min(p_size) AS date_start, max(p_size) + 10 AS date_end, min(p_name) AS name FROM g GROUP BY code), l AS (SELECT code, least(code, 'Brand#' || (substr(code, 7)::INT // 3 * 3 + 1)) AS o FROM v),
m AS (SELECT v.*, 'Brand#' || (substr(v.code, 7)::INT // 3 * 3 + 1) AS hub FROM v), r AS (SELECT hub, min(code) AS root FROM (SELECT hub, code FROM m UNION SELECT hub, hub FROM m) GROUP BY hub)
SELECT root, string_agg(code, '|' ORDER BY code) AS all_forms, min(date_start) AS date_start, max(date_end) AS date_end, (min((code <> root, code, name)))[3] AS name FROM m JOIN r USING (hub) GROUP BY root""")
def synonym_merge(t: Tables) -> DataFrame:
    vocabulary = t.part.groupBy(F.col("p_brand").alias("code")).agg(F.min("p_size").alias("date_start"), (F.max("p_size") + 10).alias("date_end"), F.min("p_name").alias("name"))
    hub = F.concat(F.lit("Brand#"), (F.floor(F.substring("code", 7, 9).cast("int") / 3) * 3 + 1).cast("int"))
    return nm.merge_groups(vocabulary, nm.synonym_groups(vocabulary.select("code", hub.alias("hub")), "code", "hub"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 3 AS parent FROM part), w(node, at, n) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT w.node, e.parent, n + 1 FROM w JOIN e ON w.at = e.node JOIN part p ON p.p_partkey = w.at WHERE n < 16 AND p.p_size % 4 <> 0),
f AS (SELECT w.node, w.at, n FROM w JOIN part ON p_partkey = w.at WHERE p_size % 4 = 0)
SELECT p_partkey AS node, (min((n, at)))[2] AS ancestor FROM part LEFT JOIN f ON node = p_partkey GROUP BY ALL""".replace(" at,", " pos,").replace(".at", ".pos").replace("(n, at)", "(n, pos)").replace("w(node, pos, n)", "w(node, pos, n)"))
def ancestor_walk(t: Tables) -> DataFrame:
    nodes = t.part.select(F.col("p_partkey").alias("node"), (F.col("p_size") % 4 == 0).alias("ok"))
    parents = t.part.select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 3).alias("parent"))
    return nm.first_ancestor(nodes, parents, "ok")


@query("""WITH n AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN string_split(p_name, ' ')[1] ELSE replace(p_name, ' ', ', ') END AS name FROM part),
b AS (SELECT name, lower(name) AS sig FROM n WHERE NOT contains(name, ',')), p AS (SELECT name, unnest(string_split(name, ',')) AS part, unnest(range(len(string_split(name, ',')))) AS i FROM n WHERE contains(name, ',')),
f AS (SELECT p.name, first(b.name ORDER BY i) AS bare FROM p JOIN b ON lower(trim(part)) = sig GROUP BY p.name) SELECT n.name, coalesce(bare, n.name) AS collapsed FROM n LEFT JOIN f USING (name)""")
def compound_collapse(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, F.split("p_name", " ")[0]).otherwise(F.replace("p_name", F.lit(" "), F.lit(", ")))
    return nm.collapse_compounds(t.part.select(name.alias("name")))


@query("""WITH x AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'site ' || o_orderkey % 2 ELSE '' END AS site FROM orders), s AS (SELECT o_custkey, min(nullif(site, '')) AS lo, max(nullif(site, '')) AS hi FROM x GROUP BY o_custkey)
SELECT o_orderkey, coalesce(nullif(site, ''), CASE WHEN lo = hi THEN lo END) AS site FROM x JOIN s USING (o_custkey)""")
def singleton_fill(t: Tables) -> DataFrame:
    site = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("site "), F.col("o_orderkey") % 2)).otherwise("")
    return nm.fill_singleton(t.orders.select("o_orderkey", "o_custkey", site.alias("site")), "o_custkey", "site").select("o_orderkey", "site")


@query("""WITH x AS (SELECT *, l_quantity > 45 AS anchor, l_partkey % 2 = 0 AS needs, l_tax > 0.04 AS mark, bool_or(l_quantity > 45) OVER (PARTITION BY l_suppkey, l_partkey % 30) AS any_a FROM lineitem),
y AS (SELECT *, NOT anchor AND any_a AND (NOT needs OR mark) AS dropped FROM x) SELECT l_orderkey, l_linenumber FROM y WHERE NOT dropped""")
def consolidate_mentions(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("ware", F.col("l_partkey") % 30)
    out = nm.consolidate(rows, ["l_suppkey", "ware"], F.col("l_quantity") > 45, F.col("l_partkey") % 2 == 0, F.col("l_tax") > 0.04, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber")
