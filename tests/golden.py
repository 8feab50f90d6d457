"""Small graphs with known results (see FIXTURES.md)."""

T1 = [(0, 1, 4), (0, 1, 2), (0, 2, 1), (2, 1, 5), (1, 3, 3), (2, 3, 8), (3, 3, 7), (3, 0, 6), (3, 1, 1), (4, 5, 2), (5, 6, 1), (6, 4, 9), (9, 8, 5)]
T1_EDGES = {(0, 1, 2), (0, 2, 1), (1, 3, 3), (2, 1, 5), (2, 3, 8), (3, 0, 6), (3, 1, 1), (4, 5, 2), (5, 6, 1), (6, 4, 9), (9, 8, 5)}
T3 = [(0, 1, 1), (0, 2, 4), (1, 2, 1), (1, 3, 1), (2, 3, 1), (3, 4, 10)]
CYCLE = {(0, 1, 5), (1, 2, 7), (2, 0, 9)}
INF = 1073741823


def graph(spark, rows, symmetrize=False, weighted=True):
    from tessera.plans.graph import from_edges

    raw = spark.createDataFrame(rows, "src bigint, dst bigint, w int")
    return from_edges(raw if weighted else raw.drop("w"), symmetrize=symmetrize, weighted=weighted)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def rows(df):
    return {tuple(r) for r in df.collect()}
