"""The page tree as a recursive query over object_nodes: the tested equal of the walk in the parse stage.

Spark's own recursion bounds the rows of a query (a million, whatever number of documents they come of), gathers what it
found in as many tasks as its first step has, and makes its inputs again in each step. So each level is a join of the inner
nodes above with their kids, written before the next; pages, which are most of a tree, are joined once, when all inner nodes
have their places. A join holds the one row of a node, not its kids. A node that lies in itself is not entered again, and a
page is a leaf, as in the walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.plans.cut import cut

#: The nodes that tell the tree: kinds of objects, kids, and what catalogs name.
NODES = """
SELECT doc_id, num, gen, path[0] AS key, try_cast(get(path, 1) AS INT) AS ord, s, ref FROM {nodes}
WHERE revision = 0 AND (size(path) = 1 AND (path[0] = 'Type' AND kind = 'name' OR path[0] = 'Pages' AND kind = 'reference')
  OR size(path) = 2 AND path[0] = 'Kids' AND kind = 'reference')
"""
KIDS = """
SELECT k.doc_id, k.num, k.gen, k.ord, k.ref AS kid, t.s AS kind
FROM {nodes} k JOIN {nodes} t ON k.doc_id = t.doc_id AND k.ref.num = t.num AND k.ref.gen = t.gen
WHERE k.key = 'Kids' AND k.ord IS NOT NULL AND t.key = 'Type' AND t.s IN ('Page', 'Pages')
"""
ROOTS = """
SELECT n.doc_id, n.ref.num AS num, n.ref.gen AS gen, CAST(array() AS ARRAY<INT>) AS path, array(n.ref) AS above
FROM {nodes} n JOIN {nodes} t ON n.doc_id = t.doc_id AND n.num = t.num AND n.gen = t.gen
WHERE n.key = 'Pages' AND t.key = 'Type' AND t.s = 'Catalog'
"""
STEP = """
SELECT t.doc_id, k.kid.num AS num, k.kid.gen AS gen, array_append(t.path, k.ord) AS path, array_append(t.above, k.kid) AS above
FROM {kids} k JOIN {tree} t ON t.doc_id = k.doc_id AND t.num = k.num AND t.gen = k.gen WHERE NOT array_contains(t.above, k.kid)
"""
PAGES = """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path, num, gen) - 1 AS INT) AS page_index, num, gen, path FROM {pages}
"""


def flatten(spark: SparkSession, object_nodes: DataFrame, depth: int = 64) -> DataFrame:
    """(doc_id, page_index, num, gen, path). Of object_nodes it takes paths of two steps at most that begin with Type, Kids or Pages.

    Type and Kids count where they stand in a node; where they are references, only the table ``pages`` follows them.
    """
    nodes = cut(spark.sql(NODES, nodes=object_nodes), "nodes")
    kids = cut(spark.sql(KIDS, nodes=nodes), "kids")
    inner = cut(kids.where("kind = 'Pages'"), "inner")
    now = tree = cut(spark.sql(ROOTS, nodes=nodes), "tree")
    for _ in range(depth - 1):
        now = cut(spark.sql(STEP, tree=now, kids=inner), "tree")
        if now.isEmpty():
            break
        tree = tree.union(now)
    return spark.sql(PAGES, pages=spark.sql(STEP, tree=tree, kids=kids.where("kind = 'Page'")))
