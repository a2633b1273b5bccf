import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tools.check import compare, connect
from wearline.llm import queries, vectorcodes


def test_query_equals_sql(spark, sf_dir):
    name = "op12_vector_codes"
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.CHECKS[name]) == ""


def cases(seed, n, dim, spread):
    """Rows in tight groups, with copies, so that whole subtrees can be settled."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(-spread * 50, spread * 50 + 1, (5, dim))
    return centres[rng.integers(0, 5, n)] + rng.integers(-spread, spread + 1, (n, dim)) * rng.integers(0, 2, (n, 1))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 999), st.integers(1, 200), st.integers(1, 6), st.sampled_from([1, 9, 500, 1 << 33]), st.integers(1, 40))
def test_search_equals_comparing_all(seed, n, dim, spread, entries):
    points = cases(seed, n, dim, spread).astype(object if spread > 1 << 20 else np.int64)
    book = points[np.random.default_rng(seed).integers(0, n, entries)] + (seed % 3)
    tree = vectorcodes.unpacked(vectorcodes.grow(points).packed(), 1 << 29)
    lo, hi, best = vectorcodes.search(tree, book.astype(tree.points.dtype))
    rows = vectorcodes.runs(lo, hi - lo)
    assert sorted(rows.tolist()) == list(range(n))
    entry = np.empty(n, np.int64)
    entry[tree.order[rows]] = np.repeat(best, hi - lo)
    d = ((points[:, None] - book[None]) ** 2).sum(axis=2).tolist()
    assert entry.tolist() == [row.index(min(row)) for row in d]


def test_cover_tree_holds_its_bounds():
    points = cases(3, 400, 3, 20)
    tree = vectorcodes.grow(points)
    assert (tree.points == points[tree.order]).all()
    for node in range(len(tree.lo)):
        own = tree.points[tree.lo[node] : tree.hi[node]]
        away = np.sqrt(((own - own[0]) ** 2).sum(axis=1))
        assert away.max() <= tree.radius[node] <= away.max() * 1.001
        below = range(tree.child[node], tree.child[node] + tree.children[node])
        if tree.children[node]:
            assert [tree.lo[c] for c in below] == [tree.lo[node], *[tree.hi[c] for c in below][:-1]]
            assert tree.hi[below[-1]] == tree.hi[node]
            centres = tree.points[[tree.lo[c] for c in below]]
            gaps = ((centres[:, None] - centres[None]) ** 2).sum(axis=2) + np.eye(len(centres)) * 1e18
            assert (gaps * 4 > away.max() ** 2 * 0.999).all()


def test_settled_subtrees_are_not_compared(monkeypatch):
    points = np.concatenate([cases(5, 500, 4, 1), cases(6, 500, 4, 1)])
    book = np.unique(points // 40, axis=0) * 40
    tree, seen = vectorcodes.grow(points), []
    plain = vectorcodes.squares
    monkeypatch.setattr(vectorcodes, "squares", lambda a, b: seen.append(len(a)) or plain(a, b))
    vectorcodes.search(tree, book)
    assert sum(seen) < len(points) * len(book) / 3


def plain(rows, parts, entries, rounds):
    kept = []
    for i, v, label in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v], label, v))
    kept = [r for r in kept if len(r[1]) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    size = len(kept[0][1]) // parts
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    cut = [[v[p * size : (p + 1) * size] for _, v, _, _ in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]
    nearest = lambda p: [min((square(x, b), e) for e, b in enumerate(books[p])) for x in cut[p]]
    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for x, (_, e) in zip(cut[p], nearest(p), strict=True):
                mine[e].append(x)
            books[p] = [[sum(x) // len(m) for x in zip(*m)] if m else b for m, b in zip(mine, books[p])]
    found = list(zip(*map(nearest, range(parts)), strict=True))
    out = [(i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), label) for (i, _, label, _), f in zip(kept, found)]
    total = {label: sum(r[2] for r in out if r[3] == label) for label in {r[3] for r in out}}
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((*r[:3], total[r[3]]) for r in out), key=str), sha


@pytest.mark.parametrize("scale", [1.0, 0.003, 1e4])
def test_ties_repeats_and_bad_vectors(spark, scale, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * scale).tolist(), ["a", "b", None][i % 3]) for i in range(130)]
    rows += [(1000 + i, rows[3][1], "hot") for i in range(90)]
    rows += [(5, rows[9][1], "a"), (5, rows[9][1], "a"), (None, rows[11][1], None), (-7, [0.0] * 8, "b")]
    rows += [(300, None, "a"), (-301, [], "a"), (302, [1.0] * 4, "a"), (-303, [1.0] * 7, "a"), (304, [None] + [1.0] * 7, "b")]
    rows += [(305, [float("nan")] * 8, "b"), (306, [math.inf] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(5)
    df = df.withColumns({"x": F.lit(1), "code": F.lit("c"), "trees": F.lit(2)})
    found = vectorcodes.fit(df, parts=4, entries=20, rounds=3)
    coded = vectorcodes.with_label_error(vectorcodes.encode(found))
    got = sorted(map(tuple, coded.select("vec_id", "code", "error", "label_error").collect()), key=str)
    assert (got, vectorcodes.digest(found)) == plain(rows, 4, 20, 3)


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i), 1.0, 2.0, 3.0], i) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = vectorcodes.fit(df)
    assert [tuple(r) for r in vectorcodes.encode(found).orderBy("vec_id").collect()] == [
        (0, 0, "00000000", 0),
        (1, 1, "01000000", 0),
        (2, 2, "02000000", 0),
    ]
    none = vectorcodes.fit(df.limit(0))
    assert vectorcodes.with_label_error(vectorcodes.encode(none)).count() == 0
    assert vectorcodes.digest(none) == hashlib.sha256(b"").hexdigest()
