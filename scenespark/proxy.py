"""Proxy scene tables over the test tables: plain SQL that Spark and DuckDB both accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

#: Each view may use the test tables and the views before it.
VIEWS = {
    "sc_nodes": """
        SELECT CAST(node_id AS BIGINT) AS node_id, CAST(parent_id AS BIGINT) AS parent_id, kind, name,
               CAST(k % 7 AS DOUBLE) AS tx, CAST(k % 5 AS DOUBLE) AS ty, CAST(k % 3 AS DOUBLE) AS tz,
               CASE k % 3 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END AS s, CAST(k % 4 AS INT) AS q
        FROM (SELECT 0 AS node_id, CAST(NULL AS BIGINT) AS parent_id, 'root' AS kind, 'root' AS name, 0 AS k
              UNION ALL SELECT 1 + r_regionkey, 0, 'group', r_name, r_regionkey FROM region
              UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, 'group', n_name, n_nationkey FROM nation
              UNION ALL SELECT 1000 + s_suppkey, 100 + s_nationkey, CASE WHEN s_suppkey % 4 = 0 THEN 'skeleton' ELSE 'group' END, s_name, s_suppkey FROM supplier) x""",
    "sc_geodes": """
        SELECT p_partkey AS geode_id, 100 + p_partkey % 25 AS node_id, p_name AS name, p_type AS class, p_brand AS brand, p_size AS size,
               CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS material_id,
               CAST(p_size AS DOUBLE) AS cx, CAST((p_partkey * 37) % 101 AS DOUBLE) AS cy, CAST((p_partkey * 13) % 17 AS DOUBLE) AS cz,
               p_retailprice / 1000.0 AS radius, CAST(p_partkey % 6 AS INT) AS mode_no
        FROM part""",
    "sc_vertices": """
        SELECT l_partkey AS prim_id,
               CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS BIGINT) AS vi,
               l_quantity AS x, l_extendedprice / 1000.0 AS y, CAST(l_linenumber AS DOUBLE) AS z,
               l_extendedprice / 100000.0 AS u, (l_tax + 0.0) * 12.5 AS v, l_suppkey AS s, l_discount + 0.0 AS w
        FROM lineitem""",
    "sc_counts": "SELECT prim_id, count(*) AS n FROM sc_vertices GROUP BY prim_id",
    "sc_triangles": """
        SELECT c.prim_id, CAST(t.vi / 3 AS BIGINT) AS ti, t.vi AS i0, t.vi + 1 AS i1, t.vi + 2 AS i2
        FROM (SELECT prim_id, vi FROM sc_vertices WHERE vi % 3 = 0) t JOIN sc_counts c ON c.prim_id = t.prim_id WHERE t.vi + 2 < c.n""",
    "sc_indices": """
        SELECT prim_id, CAST((vi - vi % 3) / 3 AS BIGINT) AS ti, vi % 3 AS corner, idx FROM (
          SELECT v.prim_id, v.vi, (v.s * 7 + v.vi) % c.n AS idx, c.n FROM sc_vertices v JOIN sc_counts c ON c.prim_id = v.prim_id) x
        WHERE vi - vi % 3 + 2 < n""",
    "sc_materials": """
        SELECT m AS material_id, CASE WHEN m % 7 < 4 THEN 'MR' ELSE 'SG' END AS kind, CAST(m % 7 AS DOUBLE) / 8 AS metallic, CAST(m % 7 * 3 % 5 AS DOUBLE) / 4 AS roughness, CASE WHEN m % 7 < 5 THEN m % 7 END AS color_tex
        FROM (SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS m FROM part) x""",
    "sc_keyframes": """
        SELECT user_id AS target, CASE event_type WHEN 'click' THEN 'X' WHEN 'view' THEN 'Y' ELSE 'Z' END AS axis,
               CAST(event_id AS BIGINT) AS event_id, ts, value
        FROM events WHERE event_type IN ('click', 'view', 'purchase')""",
    "sc_images": """
        SELECT doc_id AS image_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat(source, '/', CAST(doc_id % 50 AS VARCHAR(20))) END AS file,
               CAST(n_chars % 1000 + 1 AS INT) AS w, CAST(n_chars % 700 + 1 AS INT) AS h, CAST(doc_id % 3 AS INT) AS format, text
        FROM documents""",
}


def closure(names: tuple[str, ...]) -> list[str]:
    """The views and what they need, in order."""
    need = set(names)
    for name in reversed(list(VIEWS)):
        if name in need:
            need |= {v for v in VIEWS if v != name and v in VIEWS[name]}
    return [v for v in VIEWS if v in need]


def ctes(*names: str) -> str:
    """The views as common table expressions, without WITH."""
    return ",\n".join(f"{v} AS ({VIEWS[v]})" for v in closure(names))


def sql(body: str, *names: str) -> str:
    """An oracle: body with the views it uses in front; a body that begins with a comma brings further CTEs."""
    return f"WITH RECURSIVE {ctes(*names)}{body}" if body.lstrip().startswith(",") else f"WITH {ctes(*names)}\n{body}"


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views (or test tables) as DataFrames."""
    out = []
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name in names:
        out.append(spark.table(name) if name in TABLES else spark.sql(f"WITH {ctes(name)}\nSELECT * FROM {name}"))
    return out
