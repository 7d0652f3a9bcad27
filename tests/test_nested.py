import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfspark.operators.nested import attribute_values, object_nodes

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 5) | st.sampled_from(["", "a", "[x", '{"q": 1}', "[{}]", "~/"]),
    lambda v: st.lists(v, max_size=3) | st.dictionaries(st.sampled_from(["a", "b/c", "~d", ""]), v, max_size=3),
    max_leaves=12,
)


def walk(text):
    """Brute force: pointers of all objects with the nearest enclosing object."""
    out = set()

    def visit(v, path, owner):
        if isinstance(v, str):
            if v.lstrip()[:1] not in ("{", "[", '"') or not v:
                return
            try:
                inner = json.loads(v)
            except ValueError:
                return
            if isinstance(inner, (dict, list)):
                visit(inner, path, owner)
            return
        if isinstance(v, dict):
            out.add((path, owner))
            for k, x in v.items():
                visit(x, path + "/" + k.replace("~", "~0").replace("/", "~1"), path)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                visit(x, f"{path}/{i}", owner)

    try:
        visit(json.loads(text), "", "-")
    except ValueError:
        pass
    return out


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, doc string")
    return [(r.row_id, r.node_path, r.parent_path) for r in object_nodes(df, "row_id", ["doc"]).collect()]


def test_cases(spark):
    deep = '{"k": ' * 40 + "{}" + "}" * 40
    texts = [
        '{"a": [1, {"b": {}}]}', "[]", "", "  ", None, "null", "5", '{"a": 1', '{"a": 1} x', '"[{\\"q\\": {}}]"', '{"s": "{\\"t\\": [{}]}"}', '{"a/b": {"~": {}}}', deep,
        "{'a': 1}", '{"a": "{no json"}', '{"a": {}}', '{"a": {}}',
    ]
    got = found(spark, texts)
    assert sorted(got) == sorted((i, *n) for i, t in enumerate(texts) if t for n in walk(t))
    assert sum(1 for g in got if g[0] == 12) == 41
    assert len(set(got)) == len(got)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(VALUES, min_size=1, max_size=25))
def test_like_brute_force(spark, values):
    texts = [json.dumps(v) for v in values]
    assert sorted(found(spark, texts)) == sorted((i, *n) for i, t in enumerate(texts) for n in walk(t))


def test_values_and_empty_table(spark):
    df = spark.createDataFrame([(1, '{"a": "x", "b": null, "c": {"d": 2.50}, "e": "[oops"}')], "row_id long, doc string")
    got = {(r.node_path, r.attribute, r.value) for r in attribute_values(df, "row_id", ["doc"]).collect()}
    assert got == {("", "a", "x"), ("", "b", None), ("/c", "d", "2.50"), ("", "e", "[oops")} or got == {("", "a", "x"), ("", "b", None), ("/c", "d", "2.5"), ("", "e", "[oops")}
    assert object_nodes(df.limit(0), "row_id", ["doc"]).count() == 0
