"""Zone map clustering, benchmark decontamination and periodic runs against brute-force versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from riskloom.llm import decontamination, periodic_runs, queries, zone_clustering
from tests.llm.test_operators import AWKWARD, awkward, empty  # noqa: F401  fixtures

SF = "/root/testdata/sf0.001"


# periodic runs


def brute_runs(words, least, times):
    found = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, times * q):
                part = words[i : i + n]
                if not any(part[p:] == part[: n - p] for p in range(1, q)):
                    found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(6, 4), (4, 2), (5, 3), (9, 2), (2, 2)])
def test_runs_of_many_short_texts(least, times):
    draw = random.Random(least * 10 + times)
    total = 0
    for _ in range(400):
        words, kinds = [], draw.choice([1, 2, 2, 3, 5])
        while len(words) < draw.randint(0, 70):
            if words and draw.random() < 0.4:
                at, p = draw.randrange(len(words)), draw.randint(1, 7)
                words += words[at : at + p] * draw.randint(1, 6)
            else:
                words.append(b"w%d" % draw.randrange(kinds))
        expected = brute_runs(words, least, times)
        assert periodic_runs.find_runs(words, least, times) == expected
        total += len(expected)
    assert total > 50


def test_automaton_finds_the_runs_without_the_cut():
    words = [int(c) for c in "0123012301230123012" + "9" * 7 + "45454545" + "6"]
    finder = periodic_runs.RunFinder(4)
    finder.read(words[:11])
    finder.read(words[11:])
    runs = [(s, last - s + 1, q) for (s, q), last in sorted(finder.found.items())]
    assert runs == [(0, 19, 4), (19, 7, 1), (26, 8, 2)]


def test_every_run_lies_in_one_stretch():
    assert periodic_runs.window(6, 4) == 5
    assert periodic_runs.window(4, 2) == 1
    marks = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 2, 3, 7, 8, 9, 1, 2, 3, 4, 5, 6], dtype=np.uint64)
    assert periodic_runs.stretches(marks, 5, 6) == [(0, 12)]
    assert periodic_runs.stretches(marks[:5], 5, 6) == []


def test_long_periodic_text_and_fibonacci_words():
    text = [b"x%d" % (i % 1500) for i in range(60_000)]
    assert periodic_runs.find_runs(text) == [(0, 60_000, 1500)]
    a, b = b"a", b"ab"
    while len(b) < 400:
        a, b = b, b + a
    fibonacci = [bytes([c]) for c in b]
    assert periodic_runs.find_runs(fibonacci, 4, 2) == brute_runs(fibonacci, 4, 2)


def test_rows_of_periodic_runs(awkward, empty):  # noqa: F811
    rows = periodic_runs.periodic_runs(awkward).collect()
    assert len(rows) == len(AWKWARD)
    for doc_id, text, _ in AWKWARD:
        words = (text or "").encode().split()
        runs = [(0, 80_000, 4)] if len(words) == 80_000 else brute_runs(words, 6, 4)
        kept = words[:4] if runs else words
        assert (doc_id, len(words), [tuple(r) for r in runs], b" ".join(kept).decode()) in [
            (r["doc_id"], r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"]) for r in rows
        ]
    assert periodic_runs.periodic_runs(empty).collect() == []


def test_periodic_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_periodic_runs(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    periodic = 0
    for r in rows:
        words = (docs[r["doc_id"]] or "").encode().split()
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words, 6, 4)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        listing = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256(listing.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
        periodic += bool(runs)
    assert periodic > 5


# benchmark decontamination


def brute_contamination(text, items, size):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    words = pattern.findall(lower(text or ""))
    hit, found = set(), set()
    for item, body in items:
        ws = pattern.findall(lower(body or ""))
        n = min(size, len(ws))
        for a in range(len(ws) - n + 1 if ws else 0):
            for b in range(len(words) - n + 1):
                if words[b : b + n] == ws[a : a + n]:
                    hit |= set(range(b, b + n))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), sorted(found)


ITEMS = [
    (1, "What is the Capital, of France? It is the city of Paris on the Seine."),
    (2, "Größe ändert"),
    (2, "Größe ändert"),
    (3, "what is the capital of France it is the city of Lyon"),
    (4, None),
    (5, " ... "),
    (None, "nobody owns this"),
    (10, "Größe ändert"),
]
TEXTS = [
    (1, "So: WHAT is the capital of -- France? It is the city of Rome. Große; größe/ändert! nobody owns  this"),
    (2, "größeändert nobody owns"),
    (2, "Größe ändert sich"),
    (2, "Größe ändert sich"),
    (None, "Größe ändert"),
    (3, None),
    (4, ""),
    (5, "größe ÄNDERT, größe ändert größe 𝒳 ändert"),
    (6, "x1 what is the capital of france it is the city of paris on the seine " * 3),
]


@pytest.mark.parametrize("most", [100_000, 3])
def test_contamination(spark, most, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 40)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("_id", "_key", "_text", "items")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit("x"))
    rows = decontamination.contamination(docs, items, size=10, most_windows=most).collect()
    expected = sorted((str(i), *brute_contamination(t, ITEMS, 10)) for i, t in TEXTS)
    assert sorted((str(r["doc_id"]), r["n_words"], sum(p["n_words"] for p in r["passages"]), r["items"]) for r in rows) == expected
    passages = {r["doc_id"]: r["passages"] for r in rows}
    assert [TEXTS[0][1][p["start"] : p["end"]] for p in passages[1]] == ["WHAT is the capital of -- France? It is the city of", "größe/ändert! nobody owns  this"]
    assert [TEXTS[7][1][p["start"] : p["end"]] for p in passages[5]] == ["größe ÄNDERT, größe ändert"] or most  # ÄNDERT keeps its Ä
    assert all(a["first_word"] + a["n_words"] < b["first_word"] for p in passages.values() for a, b in zip(p, p[1:], strict=False))


def test_contamination_of_awkward_rows(spark, awkward, empty):  # noqa: F811
    items = spark.createDataFrame([(7, "alpha beta gamma delta " * 3), (8, "three four")], "item_id long, text string")
    rows = decontamination.contamination(awkward, items).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], sum(p["n_words"] for p in r["passages"]), r["items"]) for r in rows)
    expected = []
    for doc_id, text, _ in AWKWARD:
        n = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text or ""))
        hits = (80_000, ["7"]) if n == 80_000 else (2, ["8"]) if text and "three four" in text else (0, [])
        expected.append((str(doc_id), n, *hits))
    assert got == sorted(expected)
    assert decontamination.contamination(empty, items).collect() == []
    none = decontamination.contamination(awkward, items.limit(0)).collect()
    assert len(none) == len(AWKWARD) and not any(r["passages"] or r["items"] for r in none)


def test_spans_unite():
    assert decontamination.merged([(5, 7), (0, 2), (2, 3), (6, 9), (11, 12)]) == [(0, 3), (5, 9), (11, 12)]


# zone map clustering


def brute_clusters(rows, k, rounds, dims, scale=256):
    kept = [(i, [int(np.floor(scale * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((str(i), c, d) for (i, _), (d, c) in zip(kept, assign(), strict=True)), centroids


@pytest.mark.parametrize("block", [1, 7, 128])
def test_clusters(spark, block):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 5)) * 4
    rows = [(i, [float(x) for x in centres[i % 6] + draw.normal(size=5) * 0.3]) for i in range(150)]
    rows += [(1, rows[1][1])] * 40 + [(None, rows[2][1]), (200, [3000.0] * 5), (201, [-1e5] * 5)]
    rows += [(300, None), (301, []), (302, [1.0] * 4), (303, [1.0] * 6), (304, [1.0, None, 1.0, 1.0, 1.0]), (305, [float("nan")] * 5), (306, [float("inf")] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("_id", "_v", "_place", "cluster", "distance")})
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    found = zone_clustering.cluster(table, k=9, rounds=3, dims=5, block=block)
    expected, centroids = brute_clusters(rows, 9, 3, 5)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.assigned.collect()) == expected
    assert found.centroids == centroids
    each, total = zone_clustering.inertias(found)
    assert total == sum(d for _, _, d in expected) and each[0] == sum(d for _, c, d in expected if c == 0)


def test_few_and_no_vectors(spark):
    table = spark.createDataFrame([Row(vec_id=1, embedding=[0.5] * 64), Row(vec_id=1, embedding=[0.5] * 64)])
    found = zone_clustering.cluster(table, k=40)
    assert [tuple(r) for r in found.assigned.collect()] == [(1, 0, 0)] * 2 and len(found.centroids) == 2
    none = zone_clustering.cluster(table.limit(0))
    assert none.assigned.collect() == [] and none.centroids == [] and none.assigned.columns == ["vec_id", "cluster", "distance"]


def test_boxes_leave_few_candidates_and_lose_none():
    draw = np.random.default_rng(5)
    centroids = draw.integers(-2000, 2000, size=(40, 8))
    shares = []
    for c in centroids:
        v = c + draw.integers(-60, 60, size=(128, 8))
        near = zone_clustering.candidates(v.min(axis=0), v.max(axis=0), centroids)
        best, distance = zone_clustering.nearest(v, centroids)
        assert set(best) <= set(near)
        again, same = zone_clustering.nearest(v, centroids[near])
        assert (near[again] == best).all() and (same == distance).all()
        shares.append(len(near))
    assert np.mean(shares) < 4


def test_large_components_are_exact():
    v, c = np.array([[1 << 26, 3], [-(1 << 26), 0]]), np.array([[-(1 << 26), 0], [1 << 26, 2]])
    best, distance = zone_clustering.nearest(v, c)
    assert best.tolist() == [1, 0] and distance.tolist() == [1, 0]


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
    order = sorted(range(len(cells)), key=lambda i: zone_clustering.hilbert(cells, bits)[i].tobytes())
    steps = np.abs(np.diff(cells[order], axis=0)).sum(axis=1)
    assert (steps == 1).all()
