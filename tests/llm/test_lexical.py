"""Tiered lexical search against scores of all documents."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.llm import lexical as L


def slow(docs, items, k):
    held = [(i, n, Counter(L.terms(t))) for n, (i, t) in enumerate(docs) if L.terms(t)]
    n, length = len(held), sum(sum(c.values()) for *_, c in held)
    df = Counter(t for *_, c in held for t in c)
    out = set()
    for at, (item, text) in enumerate(items):
        scored = []
        for doc, row, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n) // length
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in Counter(L.terms(text)).items() if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out |= {(at, item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)}
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(3, 150)))) for i in range(900)]
    docs += [(900 + i, docs[3][1]) for i in range(60)] + [(5, docs[5][1]), (5, docs[5][1])]  # copies, repeated rows
    docs += [(2000, None), (2001, ""), (2002, "% $ #"), (None, docs[8][1]), (2003, "w399 " * 3000 + "É été ÉTÉ")]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 30)))) for i in range(30)]
    items += [(100, "w399 w0 w0 W0"), (101, docs[3][1]), (102, None), (103, "nowhere"), (104, "É w398"), (100, "w7")]
    # rare words that a few documents hold together are proven early
    docs += [(3000 + i, f"rare{i // 25} other{i // 25} w0 " + " ".join(rng.choices(vocabulary, weights, k=i % 25))) for i in range(100)]
    items += [(200 + i, f"rare{i} other{i}") for i in range(4)]
    return docs, items


@pytest.mark.parametrize("tiers", [(256, 8192), (5, 40), (1, 2), (1000000, 1000001)])
def test_search(spark, corpus, tiers, monkeypatch):
    monkeypatch.setattr(L, "HELD", 1000)
    docs, items = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    held = L.build(df, {t: i for i, t in enumerate(sorted({t for _, x in items for t in L.terms(x)}))}, tiers=tiers)
    assert held.docs == len([1 for _, t in docs if L.terms(t)])
    found, settled = L.search_load(df, [t for _, t in items], 20, "doc_id", "text", tiers)
    got = {(r["item"], items[r["item"]][0], r["rank"], r["doc_id"], r["score"]) for x in found for r in x.collect()}
    assert got == slow(docs, items, 20)
    assert sum(settled) == 38  # all but the items without a term and with none that is found
    if tiers[0] == 256:
        assert settled[0] >= 30 and len(settled) > 1
    if tiers[0] == 1000000:
        assert settled == [38]


def test_candidates_of_many_batches(spark, corpus):
    """A task's bounds come from all of its batches, in whatever order documents come."""
    docs, items = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string")
    counts = [Counter(L.terms(t)) for _, t in items]
    names = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
    index = L.build(df, names, tiers=(5, 40))
    columns = [f"{c}{t}" for t in range(3) for c in ("tids", "imps")]
    held = index.rows.select("row", "doc_id", *columns).coalesce(1).toArrow().to_batches()
    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    want = slow(docs, items, 20)
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(whole.num_rows)
        batches = [whole.take(pa.array(order[i : i + 37])) for i in range(0, whole.num_rows, 37)]
        for tier in range(3):
            asked = L.Asked(counts, names, index)
            found: dict = {}
            for b in L.scan(batches, index, asked, tier, 20):
                for item, low, high, doc, row, null in zip(*(c.to_pylist() for c in b.columns)):
                    found.setdefault(item, []).append((low, high, None if null else doc, row))
            for at, (item, _) in enumerate(items):
                best = {d for a, _, _, d, _ in want if a == at}
                mine = [x for x in found.get(at, []) if x[3] >= 0]
                spilt = max((x[1] for x in found.get(at, []) if x[3] < 0), default=0)
                bound = sorted((x[0] for x in mine), reverse=True)[19] if len(mine) >= 20 else 1
                # whoever is not there is below what was left out, or below the bound of those not met
                assert best <= {x[2] for x in mine} or spilt >= bound or asked.rest[tier, at] >= bound
                if tier == 2 and best:
                    assert best <= {x[2] for x in mine}


def test_tiers_hold_every_posting_once(spark, corpus):
    docs, _ = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string")
    names = {f"w{i}": i for i in range(400)}
    index = L.build(df, names, tiers=(5, 40))
    held = Counter()
    for r in index.rows.collect():
        c = Counter(L.terms(dict(docs)[r["doc_id"]])) if r["doc_id"] not in (5, None) else None
        tids = [t for k in range(3) for t in r[f"tids{k}"]]
        assert len(set(tids)) == len(tids) and (c is None or set(tids) == {names[t] for t in c if t in names})
        for k in range(3):
            for t, imp in zip(r[f"tids{k}"], r[f"imps{k}"]):
                held[t, k] += 1
                assert all(imp <= index.left[j, t] for j in range(k))
    assert all(sum(held[t, k] for k in range(3)) == index.df[t] for t in range(400))
    assert all(held[t, 0] == index.df[t] for t in range(400) if index.df[t] <= 5) and any(held[t, 2] for t in range(400))


def test_loads_do_not_change_the_result(spark, corpus):
    docs, items = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("rank", F.lit("x"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("x"))
    rows = lambda load: sorted(map(str, L.search(df, asked, load=load).collect()))
    want = rows(1 << 15)
    assert want == rows(150) and len(want) > 500


def test_edges(spark):
    docs, items = (spark.createDataFrame([], s) for s in ("doc_id long, text string", "item_id long, text string"))
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    ask = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert L.search(docs, ask).count() == 0 and L.search(one, items).count() == 0
    assert L.search(one.withColumn("text", F.lit(None).cast("string")), ask).count() == 0
    assert [tuple(r) for r in L.search(one, ask).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 1200)))]
