"""Operators that cut texts or turn vectors: whitening, fill-in-the-middle, repeated passages."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import infill, relative_parse, whitening
from bazaarlens.llm.queries import QUERIES
from bazaarlens.llm.statements import STATEMENTS

from .conftest import ODD, SF_DIR


def _symmetric(values, seed=1):
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return basis @ np.diag(values) @ basis.T


def test_counts_of_eigenvalues_above_a_shift():
    for seed in range(20):
        values = np.random.default_rng(seed).normal(size=12)
        matrix = _symmetric(values, seed)
        for shift in [*(np.sort(values)[:-1] + np.diff(np.sort(values)) / 2), -9.0, 9.0]:
            assert whitening.count_above(matrix, shift) == (values > shift).sum()
    assert whitening.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.count_above(np.zeros((3, 3)), 0.0) == 0


@pytest.mark.parametrize("values", [
    [9.0, 7, 5, 3, 1, 0.5, 0.2, 0.1, 0.05, 0.01], [5.0, 5, 5, 2, 2, 1, 1, 1, 1, 1], [1e6, 1, 1 - 1e-9, 1e-3, 0, 0],
    [3.0], [4.0, 4.0], list(np.linspace(1, 1.000001, 9)),
])
def test_pairs_equal_those_of_a_full_solver(values):
    matrix = _symmetric(values)
    matrix = (matrix + matrix.T) / 2
    pairs = whitening.leading_pairs(matrix, 8)
    want = np.linalg.eigvalsh(matrix)[::-1][: len(pairs)]
    assert len(pairs) == min(8, len(values))
    assert np.allclose([p.value for p in pairs], want, rtol=0, atol=1e-13 * max(values) * len(values))
    vectors = np.array([p.vector for p in pairs])
    assert np.allclose(vectors @ vectors.T, np.eye(len(pairs)), atol=1e-12)
    assert np.allclose(matrix @ vectors.T, vectors.T * [p.value for p in pairs], atol=1e-12 * max(values) * len(values))
    assert all(p.low <= p.value <= p.high for p in pairs)


def _plain_whitening(rows):
    """Component by component from a full solver: deviation, whitened up to the sign, explained."""
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in rows], dtype=object)
    n, total = len(x), x.sum(axis=0)
    deviation = [int(((n * row - total) ** 2).sum()) for row in x]
    centred = (n * x - total).astype(float) / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    return deviation, np.abs(centred @ vectors / np.sqrt(values)), values / np.trace(covariance)


@pytest.mark.parametrize("folder", [SF_DIR, "/root/testdata/sf0.1"])
def test_whitening_of_a_given_table(spark, folder):
    table = pq.read_table(f"{folder}/embeddings.parquet").to_pydict()
    deviation, whitened, explained = _plain_whitening(table["embedding"])
    place = {v: i for i, v in enumerate(table["vec_id"])}
    rows = QUERIES["op11_whitening"](spark, folder).collect()
    assert len(rows) == 8 * len(place)
    for r in rows:
        i, c = place[r["vec_id"]], r["component"] - 1
        assert (r["n"], r["deviation"]) == (len(place), deviation[i])
        assert abs(abs(r["whitened"]) - whitened[i, c]) < 1e-8
        assert abs(r["explained"] - explained[c]) < 1e-12
    assert len({r["identity_error"] for r in rows}) == 1
    assert rows[0]["identity_error"] < 1e-10


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (2, [0.25, 3.0]), (2, [0.25, 3.0]), (None, [2.0, -1.0]), (3, None), (4, []), (5, [nan, 1.0]),
            (6, [inf, 0.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [1e30, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, n int, vector string")
    got = whitening.whiten(df.withColumnRenamed("vector", "parts"), "vec_id", "embedding").collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]
    deviation, whitened, _ = _plain_whitening([v for i, v in rows[:4]])
    for r in got:
        at = {1: 0, 2: 1, None: 3}[r["vec_id"]]
        assert (r["n"], r["deviation"]) == (4, deviation[at])
        assert abs(abs(r["whitened"]) - whitened[at, r["component"] - 1]) < 1e-9
    for few in (df.limit(0), df.filter("vec_id = 2"), df.filter("vec_id = 3")):
        assert whitening.whiten(few, "vec_id", "embedding").collect() == []
    large = spark.createDataFrame([(1, [4e15, 0.0]), (2, [-4e15, 1.0])], "vec_id bigint, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(large, "vec_id", "embedding").collect()} == {None}


def test_rank_index_is_exact_and_off_by_no_more_than_its_bound():
    draw = random.Random(3)
    for lengths in ([], [1], [5] * 3000, [draw.randrange(1, 400) for _ in range(2000)], [1] * 500 + [100000] + [3] * 700,
                    [10**6, 1, 1, 10**6]):
        offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype(np.int64)
        index = infill.RankIndex.fit(offsets, 20)
        ranks = np.arange(len(offsets))
        assert (index.offsets(ranks) == offsets).all()
        assert np.abs(index.residual).max() <= 21
    assert len(infill.RankIndex.fit(np.arange(0, 50000, 5)).first) == 1


def _plain_infill(key, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infill_of_odd_texts(spark, texts):
    draw = random.Random(5)
    rows = [(i, "".join(draw.choice(["a", "é\n", "\n", "\r\n", "日", "😀 ", "<", "S", ">", " ", "<P", "M>"]) for _ in range(draw.randrange(60))))
            for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate([None, "", "\n", "x" * 300000, "line\n" * 50000, "a<P>b", "a<S", "M>"])]
    rows += [(None, "a\nb\nc"), (None, "a\nb\nc"), (7, rows[7][1]), (-5, "a\nb")]
    made = infill.fill_in_middle(texts(rows).withColumn("output", F.lit(1)), "doc_id", "text")
    got = made.withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    tell = lambda rs: sorted(rs, key=repr)
    assert tell((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == tell(
        (i, *_plain_infill("" if i is None else i, t or "")) for i, t in rows
    )
    assert tell((r["doc_id"], r["again"]) for r in got) == tell((i, t or "") for i, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(texts([]), "doc_id", "text").count() == 0
    none = infill.fill_in_middle(texts([(1, "a\nb")]), "doc_id", "text", rate=0).collect()
    assert [r["form"] for r in none] == ["plain"]
    with pytest.raises(ValueError):
        infill.fill_in_middle(texts([]), "doc_id", "text", marks=("<P>", "<P>", "<M>"))


def test_infill_equals_its_statement(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    want = connection.sql(STATEMENTS["op12_infill"]).fetchall()
    got = [tuple(r) for r in QUERIES["op12_infill"](spark, SF_DIR).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def _plain_repeats(rows, window=50):
    """Words and removed places of every row, by a table of all windows."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first: dict[tuple, int] = {}
    for (i, _), words in zip(rows, split):
        if i is not None:
            for s in range(len(words) - window + 1):
                key = tuple(words[s : s + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), words in zip(rows, split):
        gone: set[int] = set()
        if i is not None:
            for s in range(len(words) - window + 1):
                if first[tuple(words[s : s + window])] < i:
                    gone.update(range(s, s + window))
        out.append((i, len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone)))
    return sorted(out, key=repr)


def _made(spark, texts, rows, **how):
    got = relative_parse.drop_repeats(texts(rows).withColumn("row", F.lit(1)), "doc_id", "text", **how).collect()
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("window", [50, 9])
def test_repeats_equal_a_table_of_all_windows(spark, texts, window):
    draw = random.Random(window)
    words = [f"w{i}" for i in range(3000)]
    passages = [draw.choices(words, k=draw.choice([window - 1, window, window + 1, 2 * window, 5 * window])) for _ in range(12)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(draw.randrange(5)):
            part = list(draw.choice(passages))
            if draw.random() < 0.4:
                part[draw.randrange(len(part))] = draw.choice(words)
            text += part + draw.choices(words, k=draw.choice([0, 0, 3, 40, 300]))
        rows.append((draw.randrange(1000), draw.choice([" ", "\n", "\t "]).join(text)))
    # Few words, so windows repeat everywhere; one word only; copies; repeated and missing ids.
    rows += [(1000 + i, " ".join(draw.choices("ab", k=400))) for i in range(3)]
    rows += [(2000 + i, "a b " * n) for i, n in enumerate([10, 25, 26, 300, 1500])]
    rows += [(3000, "x " * 2000), (2999, "x " * 600), (3001, "x " * (window - 1)), (3002, "x " * window)]
    rows += [(i, rows[3][1]) for i in (5000, 4000, 4500, 4000)] + [(None, rows[3][1]), (None, rows[3][1]), (4000, rows[4][1])]
    assert _made(spark, texts, rows, window=window) == _plain_repeats(rows, window)


def test_repeats_of_odd_rows(spark, texts):
    long = " ".join(f"n{i}" for i in range(40000))
    rows = [*ODD, (8, "w" * 400000 + " é é " + long), (9, "other " + long + " more"), (10, long[:-7] + "x")]
    assert _made(spark, texts, rows) == _plain_repeats(rows)
    assert _made(spark, texts, []) == []


def test_a_window_of_later_documents_that_the_first_holder_of_its_anchor_does_not_have(spark, texts):
    words = [f"u{i}" for i in range(400)]
    middle = words[:20]
    rows = [(1, " ".join([*words[100:160], *middle, *words[160:220]])),
            (2, " ".join([*words[220:260], *middle, *words[260:300]])),
            (3, " ".join([*words[220:260], *middle, *words[260:300]]) + " tail")]
    got = _made(spark, texts, rows)
    assert got == _plain_repeats(rows)
    assert got[2][2] == 100


def test_repeats_of_the_given_table(spark):
    table = pq.read_table(f"{SF_DIR}/documents.parquet").to_pydict()
    rows = list(zip(table["doc_id"], table["text"]))
    got = sorted((tuple(r) for r in QUERIES["op13_repeats"](spark, SF_DIR).collect()), key=repr)
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in _plain_repeats(rows)]
    assert got == sorted(want, key=repr)
    assert sum(r[2] for r in got) > 0
