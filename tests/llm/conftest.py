import pytest


@pytest.fixture()
def scratch(spark):
    from vellum.llm.common import Scratch

    s = Scratch(spark)
    yield s
    s.clear()


def brute_components(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="session")
def components():
    return brute_components
