"""Vector codes: Orchard's search against the nearest of all entries, whole runs against plain Python."""

import math

import numpy as np
import pytest

from claimspark.llm import common, vectors


def brute(rows, parts=8, entries=16, rounds=6):
    """{(position of the row): (code, error)} and the codebooks, by Python's whole numbers."""
    numbers = [[math.floor(4096 * x) for x in v] for _, v in rows]
    w = len(numbers[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in numbers]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, numbers[i]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((far(v[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for j in range(len(first)):
                own = [cut[i][p] for i, f in enumerate(found) if f[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    return ["".join(f"{j:02x}" for _, j in f) for f in found], [sum(d for d, _ in f) for f in found], books


@pytest.mark.parametrize("seed,spread", [(1, 3), (2, 4000), (3, 1 << 26)])
def test_search_finds_the_nearest_entry(seed, spread):
    """Ties, equal entries and large numbers included."""
    r = np.random.default_rng(seed)
    books = r.integers(-spread, spread, (8, 16, 5))
    books[:, 9] = books[:, 4]
    rows = r.integers(-spread, spread, (300, 40))
    rows[:20] = books[:, 9].reshape(1, 40)
    codes, near = vectors.Search(books).nearest(rows)
    d = vectors.squared(rows.reshape(300, 8, 1, 5), books[None])
    assert (codes == d.argmin(2)).all() and (near == d.min(2)).all()


def test_search_visits_few_entries(monkeypatch):
    """In two far clusters the lists are left early."""
    r = np.random.default_rng(4)
    books = r.integers(0, 50, (8, 16, 4))
    books[:, 8:] += 100_000
    rows = np.repeat(books[:, 3:4], 200, 1).swapaxes(0, 1).reshape(200, 32)
    counted, real = [], vectors.squared
    search = vectors.Search(books)
    monkeypatch.setattr(vectors, "squared", lambda a, b: counted.append(len(a)) or real(a, b))
    search.nearest(rows)
    assert sum(counted) <= 8 * 200 * 8


ROWS = [(i, [((i * 7 + j * 3) % 11 - 5) / 7 for j in range(16)]) for i in range(40)] + [(100 + i, [0.25] * 16) for i in range(30)] + [(None, [0.5] * 16), (7, [-1.0] * 16), (7, [-1.0] * 16)]


def test_against_brute_force(spark):
    bad = [(200, None, 1), (201, [None] + [0.0] * 15, 1), (202, [float("nan")] * 16, 1), (203, [0.0] * 15 + [float("-inf")], 1)]
    label = lambda i: None if i is None or i % 5 == 0 else i % 3
    table = spark.createDataFrame([(i, v, label(i), "x") for i, v in ROWS] + [(*b, "x") for b in bad], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    found, books = vectors.compress(table)
    codes, errors, want = brute(ROWS)
    assert books.tolist() == want
    by_label = {}
    for (i, _), e in zip(ROWS, errors):
        by_label[label(i)] = by_label.get(label(i), 0) + e
    assert sorted(map(str, [(i, label(i), c, e, by_label[label(i)]) for (i, _), c, e in zip(ROWS, codes, errors)])) == sorted(str(tuple(r)) for r in found.collect())
    assert np.abs(vectors.decode(codes[0], books) - ROWS[0][1]).max() < 1


def test_hot_labels(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_SHARE", 100)
    table = spark.createDataFrame([(i, [float(i % 4)] * 8, [None, 1, 2 + i][i % 3]) for i in range(60)], "vec_id long, embedding array<float>, label int")
    found = vectors.compress(table)[0].collect()
    assert len(found) == 60 and {r["label_error"] for r in found} == {0}


def test_few_short_empty_and_huge_vectors(spark):
    table = spark.createDataFrame([(1, [0.5] * 3), (2, []), (3, [1e300, -1e300] + [0.0] * 7)], "vec_id long, embedding array<double>").selectExpr("*", "cast(null as string) label")
    found, books = vectors.compress(table)
    assert books.shape == (8, 3, 2) and [r["code"] for r in found.orderBy("vec_id").collect()] == ["0000000000000000", "0101000000000000", "0201000000000000"]
    none, books = vectors.compress(table.limit(0))
    assert none.count() == 0 and books.size == 0
    assert vectors.compress(table.where("vec_id = 2"))[0].first()["error"] == 0
