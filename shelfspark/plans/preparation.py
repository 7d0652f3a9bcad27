"""Queries of the core operators on quantities, nested records and packed values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspark.operators.nested import attribute_values, object_nodes
from shelfspark.operators.packed import split_values
from shelfspark.operators.units import usd_cents
from shelfspark.session import load_table

PACKED_FIELDS = ("tags", "sizes", "colors", "all_images")
NESTED_FIELDS = ("variants", "specifications")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, shops, units = (load_table(spark, sf_dir, t) for t in ("products", "shops", "currency_units"))
    return usd_cents(products, shops, units)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_nodes(load_table(spark, sf_dir, "products"), "row_id", NESTED_FIELDS)


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar entries of the objects, linked to them by row and path."""
    return attribute_values(load_table(spark, sf_dir, "products"), "row_id", NESTED_FIELDS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_values(load_table(spark, sf_dir, "products"), "row_id", PACKED_FIELDS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p4_found, p4_values, p6_found)}


# Objects and arrays at any depth, JSON text inside strings included.
_NODES = """WITH RECURSIVE t AS (SELECT row_id, 'variants' AS field_name, variants AS s FROM products UNION ALL SELECT row_id, 'specifications' AS field_name, specifications AS s FROM products),
a AS (SELECT row_id, field_name, CAST(s AS JSON) AS j FROM t WHERE json_valid(s)),
n AS (SELECT row_id, field_name, '' AS path, '-' AS owner, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) ELSE j END AS j FROM a
UNION ALL SELECT row_id, field_name, path, owner, CASE WHEN json_type(c) = 'VARCHAR' AND json_valid(c ->> '$') THEN CAST(c ->> '$' AS JSON) ELSE c END AS j
  FROM (SELECT row_id, field_name, path || '/' || k AS path, owner, json_extract(j, '/' || k) AS c
    FROM (SELECT row_id, field_name, path, CASE json_type(j) WHEN 'OBJECT' THEN path ELSE owner END AS owner, j,
      unnest(CASE json_type(j) WHEN 'OBJECT' THEN list_transform(json_keys(j), lambda k: replace(replace(k, '~', '~0'), '/', '~1'))
        WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(j) AS BIGINT)), lambda i: CAST(i AS VARCHAR)) ELSE [] END) AS k FROM n)))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _NODES + " SELECT row_id, field_name, path AS node_path, owner AS parent_path FROM n WHERE json_type(j) = 'OBJECT'",
        "p4_values": _NODES
        + """ SELECT row_id, field_name, node_path, attribute, CASE json_type(c) WHEN 'NULL' THEN NULL ELSE c ->> '$' END AS value
FROM (SELECT row_id, field_name, path AS node_path, attribute, json_extract(j, '/' || replace(replace(attribute, '~', '~0'), '/', '~1')) AS c
  FROM (SELECT *, unnest(json_keys(j)) AS attribute FROM n WHERE json_type(j) = 'OBJECT'))
WHERE json_type(c) NOT IN ('OBJECT', 'ARRAY') AND NOT (json_type(c) = 'VARCHAR' AND json_valid(c ->> '$') AND json_type(CASE WHEN json_valid(c ->> '$') THEN c ->> '$' END) IN ('OBJECT', 'ARRAY'))""",
    }
