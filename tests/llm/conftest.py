import pytest

SF = "/root/testdata/sf0.001"


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="session")
def doc_rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()
