from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfspark.operators.graph import connected_components


def brute(links):
    label = {i: i for i, _ in links}
    changed = True
    while changed:
        changed = False
        for i, k in links:
            for j, m in links:
                if k == m and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def run(spark, links):
    df = spark.createDataFrame(links, "item long, key string")
    return {r["item"]: r["component"] for r in connected_components(df).collect()}


def test_chain_and_nulls(spark):
    chain = [(i, f"k{i}") for i in range(30)] + [(i + 1, f"k{i}") for i in range(30)]
    assert set(run(spark, chain).values()) == {0}
    links = [(1, "a"), (1, "a"), (2, None), (None, "a"), (3, "b"), (5, "a")]
    assert run(spark, links) == {1: 1, 5: 1, 3: 3}
    assert run(spark, []) == {}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.sampled_from("abcdefgh")), min_size=1, max_size=20))
def test_like_brute_force(spark, links):
    assert run(spark, links) == brute(links)
