"""Deeply nested JSON text into related flat tables, as one higher-order projection.

Each level is one ``transform`` over the nodes of the level above; it attaches the ancestor's path and the key or index,
``flatten`` joins the children and one ``inline`` per target table emits rows. ``from_json`` to ``map<string,string>`` or
``array<string>`` yields the raw text of nested containers and the content of strings alike, so that JSON text held inside
a string is walked as if it stood in the string's place.

Levels beyond ``LEVELS`` go, for the rows that have them, through an exact walk (:func:`_walk_rest`).
Null, blank, scalar and invalid values have no rows. Repeated rows give repeated nodes under their own ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of containers that are unrolled natively.
LEVELS = 14
NO_PARENT = "-"
_STRICT = "map('allowSingleQuotes', 'false')"
_NODE = "array<struct<path:string,owner:string,is_object:boolean,kids:array<struct<key:string,value:string>>>>"


def _container(value: str) -> str:
    return f"substring(ltrim({value}), 1, 1) in ('{{', '[', '\"')"


def _node(path: str, owner: str, text: str) -> str:
    """SQL of a node: its entries are null unless the whole text is one valid object or array."""
    plain = f"(case when startswith(ltrim({text}), '\"') then get(from_json(concat('[', {text}, ']'), 'array<string>', {_STRICT}), 0) else {text} end)"
    return (
        f"transform(array(struct({path} as path, {owner} as owner, {plain} as body)), b -> struct(b.path as path, b.owner as owner, startswith(ltrim(b.body), '{{') as is_object, "
        f"case when startswith(ltrim(b.body), '{{') then transform(map_entries(get(from_json(concat('[', b.body, ']'), 'array<map<string,string>>', {_STRICT}), 0)), e -> struct(e.key as key, e.value as value)) "
        f"when startswith(ltrim(b.body), '[') then transform(get(from_json(concat('[', b.body, ']'), 'array<array<string>>', {_STRICT}), 0), (x, i) -> struct(cast(i as string) as key, x as value)) end as kids))"
    )


def _first(column: str) -> Column:
    return F.expr(f"filter({_node(repr(''), repr(NO_PARENT), f'`{column}`')}, n -> n.kids is not null)").cast(_NODE)


def _next(level: str) -> Column:
    step = "replace(replace(k.key, '~', '~0'), '/', '~1')"
    child = _node(f"concat(n.path, '/', {step})", "case when n.is_object then n.path else n.owner end", "k.value")
    return F.expr(
        f"filter(flatten(flatten(transform({level}, n -> transform(filter(n.kids, k -> {_container('k.value')}), k -> {child})))), n -> n.kids is not null)"
    ).cast(_NODE)


def _levels(df: DataFrame, column: str, levels: int) -> DataFrame:
    df = df.withColumn("_l0", _first(column))
    for k in range(levels - 1):
        df = df.withColumn(f"_l{k + 1}", F.when(F.size(f"_l{k}") > 0, _next(f"_l{k}")).otherwise(F.expr("array()").cast(_NODE)))
    return df


def _walk_rest(seeds: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The exact way below the unrolled levels: every container under a seed, with its entries."""

    def entries(text: str | None) -> tuple[bool, list[tuple[str, str | None]]] | None:
        for _ in range(2):
            try:
                value = json.loads(text) if text else None
            except ValueError:
                return None
            if not isinstance(value, str):
                break
            text = value
        if isinstance(value, dict):
            pairs = list(value.items())
        elif isinstance(value, list):
            pairs = [(str(i), x) for i, x in enumerate(value)]
        else:
            return None
        return isinstance(value, dict), [(k, x if isinstance(x, str) or x is None else json.dumps(x)) for k, x in pairs]

    for batch in seeds:
        out = []
        for id_, field, path, owner, text in batch.itertuples(index=False):
            stack = [(path, owner, text)]
            while stack:
                path, owner, text = stack.pop()
                found = entries(text)
                if found is None:
                    continue
                is_object, pairs = found
                out.append((id_, field, path, owner, is_object, [{"key": k, "value": v} for k, v in pairs]))
                below = path if is_object else owner
                stack += [(f"{path}/{k.replace('~', '~0').replace('/', '~1')}", below, v) for k, v in pairs if v and v.lstrip()[:1] in ("{", "[", '"')]
        yield pd.DataFrame(out, columns=["_id", "field_name", "path", "owner", "is_object", "kids"])


def containers(df: DataFrame, id_col: str, columns: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """(id, field_name, path, owner, is_object, kids) of every object and array inside the JSON texts of ``columns``."""
    fields = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("_text")) for c in columns))
    base = df.select(F.col(id_col).alias("_id"), F.inline(fields)).filter(_container("_text"))
    names = [f"_l{k}" for k in range(levels)]
    native = _levels(base, "_text", levels).select("_id", "field_name", F.inline(F.concat(*names)))
    # A row can only be deeper than the levels if it opens more containers than that.
    opened = F.length("_text") - F.length(F.translate("_text", "{[", ""))
    step = "replace(replace(k.key, '~', '~0'), '/', '~1')"
    seeds = _levels(base.filter(opened > levels), "_text", levels).select(
        "_id",
        "field_name",
        F.inline(
            F.expr(
                f"flatten(transform({names[-1]}, n -> transform(filter(n.kids, k -> {_container('k.value')}), k -> struct(concat(n.path, '/', {step}) as path, "
                "case when n.is_object then n.path else n.owner end as owner, k.value as body))))"
            )
        ),
    )
    kind = dict(seeds.dtypes)["_id"]
    rest = seeds.mapInPandas(
        _walk_rest, f"_id {kind}, field_name string, path string, owner string, is_object boolean, kids array<struct<key:string,value:string>>"
    )
    return native.unionByName(rest).withColumnRenamed("_id", id_col)


def object_nodes(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(id, field_name, node_path, parent_path): every JSON object at any depth with the path of the nearest enclosing object."""
    nodes = containers(df, id_col, columns).filter("is_object")
    return nodes.select(id_col, "field_name", F.col("path").alias("node_path"), F.col("owner").alias("parent_path"))


def attribute_values(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(id, field_name, node_path, attribute, value): scalar entries of the objects, the child table of :func:`object_nodes`.

    A JSON null gives a row with a null value. Entries that hold a container are rows of the node table instead; texts
    that merely begin like one stay values.
    """
    scalar = F.expr(
        f"filter(kids, k -> k.value is null or not ({_container('k.value')}) or "
        f"(get(from_json(concat('[', k.value, ']'), 'array<array<string>>', {_STRICT}), 0) is null "
        f"and get(from_json(concat('[', k.value, ']'), 'array<map<string,string>>', {_STRICT}), 0) is null))"
    )
    nodes = containers(df, id_col, columns).filter("is_object")
    return nodes.select(id_col, "field_name", F.col("path").alias("node_path"), F.inline(scalar).alias("attribute", "value"))
