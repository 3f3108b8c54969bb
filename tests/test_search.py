from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from offerscope.operators import evaluate as K
from offerscope.operators import search as S

ROUTE = "query_id long, vector array<double>, terms array<string>, intent string, banks array<string>, products array<string>, fields array<string>"
CHUNK = "chunk_id long, doc_id long, offer_id string, bank string, product string, fields array<string>, vector array<double>, verified boolean, primary boolean, confidence double, searchable boolean, quality_status string, has_facts boolean, day date"


def tables(spark, seed=4, n=120):
    rng = random.Random(seed)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    some = lambda xs: rng.sample(xs, rng.randint(0, 2))
    routes = [(q, vector(), rng.sample("abcdefgh", 3), rng.choice(["compare", "lookup", "list", "historical"]), some(["x", "y", "z"]), some(["p", "q"]), some(["f", "g"])) for q in range(12)]
    chunks = [(c, c % 40, f"o{c % 70}", rng.choice("xyz"), rng.choice("pqr"), some(["f", "g", "h"]), vector(), rng.random() < 0.3, rng.random() < 0.7, rng.random(), rng.random() < 0.8, rng.choice(["accepted", "review"]), rng.random() < 0.5, None) for c in range(n)]
    postings = [(c, t, rng.choice("ABC"), rng.randint(1, 4)) for c in range(n) for t in rng.sample("abcdefgh", 3)]
    return routes, chunks, postings, spark.createDataFrame(routes, ROUTE), spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(postings, "chunk_id long, term string, weight string, tf int")


def ranked(route, chunks, postings, n, weights):
    """rrf by chunk of one route, from all given chunks."""
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    near = sorted(chunks, key=lambda c: (-round(sum(a * b for a, b in zip(unit(route[1]), unit(c[6]), strict=True)), 6), c[0]))[:n]
    ids, score, matched = {c[0] for c in chunks}, defaultdict(float), defaultdict(set)
    for c, t, w, tf in postings:
        if c in ids and t in route[2]:
            score[c] += round({"A": 1, "B": 0.4, "C": 0.2}[w] * (1 + math.log(tf)), 6)
            matched[c].add(t)
    lexical = sorted(score, key=lambda c: (-round(score[c] * len(matched[c]) / len(route[2]) + 1e-9, 5), c))[:n]
    rrf = defaultdict(float)
    for w, order in zip(weights, ([c[0] for c in near], lexical), strict=True):
        for i, c in enumerate(order):
            rrf[c] += w / (60 + i + 1)
    return {c: round(s, 9) for c, s in rrf.items()}


def test_historical_search_filters_before_it_ranks(spark):
    routes, chunks, postings, r, c, p = tables(spark)
    got = S.historical_search(r, c, p, 5, banks=("x", "y"), has_facts=True, least=0.2).orderBy("query_id", "place").collect()
    fit = [x for x in chunks if x[3] in "xy" and x[9] >= 0.2 and x[10] and x[11] == "accepted" and x[12]]
    expected = []
    for route in routes:
        best = {}
        for chunk, s in sorted(ranked(route, fit, postings, 60, (1, 1)).items(), key=lambda kv: (-kv[1], kv[0])):
            best.setdefault(chunk % 40, (route[0], chunk))
        expected += list(best.values())[:5]
    assert [(x.query_id, x.chunk_id) for x in got] == expected
    assert S.historical_search(r, c, p, 5, since=F.lit("2020-01-01").cast("date")).count() == 0


@pytest.mark.parametrize("k", [4, 6])
def test_unified_search_equals_the_plain_one(spark, k):
    routes, chunks, postings, r, c, p = tables(spark)
    found = S.unified_search(r, c, p, k)
    got = [(x.query_id, x.chunk_id) for x in found.filter("final is not null").orderBy("query_id", "final").collect()]
    expected, sizes = [], {}
    by_id = {x[0]: x for x in chunks}
    for route in routes:
        q, _, _, intent, banks, products, fields = route
        fused = ranked(route, [x for x in chunks if not banks or x[3] in banks], postings, max(8 * k, 40), (1.0, 0.5))
        hits = []
        for i, s in fused.items():
            x = by_id[i]
            cover = len(set(x[5]) & set(fields))
            tier = {(True, True): 0, (False, True): 1, (True, False): 2, (False, False): 3}[x[4] in products, cover > 0]
            hits.append(((not x[7], tier, -cover, -s, x[3], x[1], i), tier, x))
        hits.sort()
        for key in (2, 1):
            seen = set()
            hits = [h for h in hits if not (h[2][key] in seen or seen.add(h[2][key]))]
        sizes[q] = (len(fused), len(hits))
        spread = intent == "compare" or (not banks and intent in ("lookup", "list") and (products or fields))
        order = []
        for primary in (True, False):
            part = [h for h in hits if h[2][8] == primary]
            if spread:
                for tier in range(4):
                    lists = defaultdict(list)
                    for h in part:
                        if h[1] == tier:
                            lists[h[2][3]].append(h)
                    for turn in range(len(part)):
                        order += [own[turn] for own in lists.values() if turn < len(own)]
            else:
                order += part
        expected += [(q, h[2][0]) for h in order[:k]]
    assert got == expected
    rows = S.search_diagnostics(r, found).collect()
    assert {x.query_id: (x.fused, x.deduplicated) for x in rows} == sizes
    assert all(x.returned == min(k, x.deduplicated) and x.issue is None for x in rows)
    none = S.search_diagnostics(r, S.unified_search(r, c.limit(0), p.limit(0), k)).collect()
    assert {x.issue for x in none} == {"no_matching_evidence"} and len(none) == len(routes)


def test_runs_are_checked(spark):
    cases = spark.createDataFrame([(1, "q"), (2, " "), (2, "q"), (3, "q")], "case_id int, query string")
    relevant = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 0), (2, "z", 1)], "case_id int, id string, grade int")
    corpus = spark.createDataFrame([("a",), ("b",)], "id string")
    run = spark.createDataFrame([(1, "a", 1), (2, "y", 1), (9, "a", 1)], "case_id int, id string, rank int")
    got = {(x.run, x.case_id, x.issue) for x in K.run_issues(cases, relevant, corpus, {"a": run}).collect()}
    assert got == {
        (None, 2, "duplicate_case"), (None, 2, "empty_query"), (None, 3, "no_relevant"), (None, 2, "bad_grade"), (None, 1, "duplicate_relevant"), (None, 2, "not_in_corpus"),
        ("a", 3, "missing_case"), ("a", 9, "unknown_case"), ("a", 2, "unknown_id"),
    }
    assert {x.delta for x in K.compare_retrievers(cases, relevant, run, run).collect()} == {None}
    with pytest.raises(ValueError):
        K.compare_retrievers(cases, relevant, run, run, 9)
