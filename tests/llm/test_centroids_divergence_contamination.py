"""Operators 11, 12 and 13 against plain versions on small tables with nulls, ties, repeats, long rows and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from talweg.llm import centroids, contamination, divergence

A_TO_Z = str.maketrans(contamination.UPPER, contamination.LOWER)


def clusters(rows, k=16, rounds=3, size=64):
    """Every vector against every centroid, in Python's integers."""
    fine = [(i, [math.floor(64 * float(x)) if abs(x) < 2**40 else 64 * int(x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(fine, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, m), a) for a, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in fine]
        c = [[sum(x) // len(x) for x in zip(*mine)] if (mine := [v for (_, v), o in zip(fine, own) if o == a]) else m for a, m in enumerate(c)]
    found = [(i, *near(v)[::-1]) for i, v in fine]
    total = Counter()
    for _, a, d in found:
        total[a] += d
    long = lambda x: x if x < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return Counter((i, a, long(d), long(total[a]), long(sum(total.values())), digest[a]) for i, a, d in found)


def vectors(n, seed=3):
    r = np.random.default_rng(seed)
    near = r.normal(size=(5, 64))
    return [(i, (near[i % 5] + 0.4 * r.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]


COLS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def clustered(spark, rows):
    # Columns that the operator has itself stand beside them.
    table = spark.createDataFrame([(i, v, 7, 8, 9) for i, v in rows], "vec_id long, embedding array<float>, v int, cluster int, distance int").repartition(5)
    return Counter(tuple(r[c] for c in COLS) for r in centroids.query(table).collect())


def test_centroids(spark):
    rows = vectors(300)
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [1.0] * 63 + [float("nan")]), (905, [float("inf")] * 64), (None, [0.5] * 64), rows[0], rows[0], (906, [0.0] * 64), (907, rows[1][1])]
    assert clustered(spark, rows + odd) == clusters(rows + odd)


def test_centroids_of_few_equal_and_huge_vectors(spark):
    assert clustered(spark, []) == Counter()
    few = [(i, [float(i % 2)] * 64) for i in range(7)]
    assert clustered(spark, few) == clusters(few)  # equal centroids: the smaller number has them all
    big = float(np.float32(3e38))
    huge = vectors(40) + [(100, [big] * 64), (101, [-big] + [1.0] * 63), (102, [float(2**22 + 1)] * 64)]
    assert clustered(spark, huge) == clusters(huge)


def test_sort_means_equals_all_pairs_at_ties():
    r = np.random.default_rng(1)
    for _ in range(50):
        x, c = r.integers(-2, 3, (60, 3)), r.integers(-2, 3, (8, 3))
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        best, near = centroids.sort_means(x, c, r.integers(0, 8, 60))
        assert (best == d.argmin(axis=1)).all() and (near == d.min(axis=1)).all()


def audited(rows, least=30, top=50):
    term = re.compile(divergence.PATTERN)
    docs = [((la or ""), (so or ""), term.findall((t or "").translate(A_TO_Z))) for _, t, la, so in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(w for d in mine for w in set(d[2]))
        kept = {w for w, n in held.items() if n >= least}
        groups = defaultdict(Counter)
        for _, so, w in mine:
            groups[so].update(x for x in w if x in kept)
        whole = sum(groups.values(), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        q, of = p(whole), {so: p(c) for so, c in groups.items()}
        for so in of:
            far = sorted((-sum(abs(of[so][w] - of[o][w]) for w in kept), o.encode()) for o in of if o != so)
            out |= {(lang, so, "pair", o.decode(), -v, n) for n, (v, o) in enumerate(far, 1)}
            more = sorted((q[w] - of[so][w], w.encode()) for w in kept if groups[so][w] and of[so][w] > q[w])
            out |= {(lang, so, "term", w.decode(), -v, n) for n, (v, w) in enumerate(more[:top], 1)}
    return out


DOCS = "doc_id long, text string, lang string, source string, n long, value int, term int, chunk int, total int"


def corpus(seed=5, n=160):
    r = random.Random(seed)
    words = ["river", "Stone", "ÉCOLE", "école", "日本", "naïve", "a\x00b", "don't", "x1y2", "KK"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 60))), r.choice(["en", "en", "de", None]), r.choice(["s0", "s1", "é", None, "zz", "S"])) for i in range(n)]
    return rows + [(900, None, "en", "bare"), (901, "", "fr", "one"), (902, "river", "fr", "two"), (903, "...", "xx", "y"), rows[0], rows[0], (904, "river " * 100_000, "en", "long"), (None, "Stone stone STONE", "de", "s1")]


@pytest.mark.parametrize(("chunk", "span", "block"), [(8192, 16, 32), (3, 2, 2)])
def test_divergence(spark, chunk, span, block):
    rows = corpus()
    table = spark.createDataFrame([(*r, 0, 1, 2, 3, 4) for r in rows], DOCS).repartition(4)
    got = divergence.audit(table, least_docs=12, top=5, chunk=chunk, span=span, block=block).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == audited(rows, 12, 5)


def test_divergence_of_nothing(spark):
    assert divergence.query(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b", "en", "x"), (2, "c", "en", "y"), (3, None, None, None)]
    assert {tuple(r) for r in divergence.query(spark.createDataFrame([(*r, 0, 1, 2, 3, 4) for r in rows], DOCS)).collect()} == audited(rows) == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    cases = [(0, 0, 1), (10**12, 3 * 10**14, 10**7), (9 * 10**14, 9 * 10**14, 123_456_789), (1, 5, 3)]
    want = [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in cases]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n long, t long, v long")
    assert [r["p"] for r in rows.select("i", divergence.share(F.col("n"), F.col("t"), F.col("v")).alias("p")).orderBy("i").collect()] == want
    assert [int(divergence.shares(np.array([[n]]), np.array([t]), v)[0, 0]) for n, t, v in cases] == want


WORD = re.compile(contamination.PATTERN)


def windows(docs, items, window=10):
    """Every window of every item at every place of every document."""
    sought = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(A_TO_Z))
        for a in range(max(1, len(w) - window + 1) if w else 0):
            sought[tuple(w[a : a + window])].add(i)
    out = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(A_TO_Z))
        hit, names = set(), set()
        for k in {len(x) for x in sought}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in sought:
                    hit |= set(range(a, a + k))
                    names |= sought[tuple(w[a : a + k])]
        names = sorted(str(x) for x in names - {None})
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def leaks(seed, vocabulary, n_items=30, n_docs=120):
    r = random.Random(seed)
    words = [*(f"W{i}" for i in range(vocabulary - 2)), "é", "Ñandú"]
    say = lambda n: r.choice([" ", "  ", ", ", "\n"]).join(r.choice(words) for _ in range(n))
    items = [(i, say(r.choice([1, 3, 9, 10, 11, 30]) if vocabulary > 20 or i % 3 else 12)) for i in range(n_items)]
    items += [(1, items[2][1]), (77, items[3][1].upper()), (78, None), (79, "..."), (None, say(14))]
    docs = []
    for i in range(n_docs):
        t = say(r.randint(0, 60))
        if i % 3 == 0 and items[i % n_items][1]:
            t += " " + items[i % n_items][1].lower().replace(" ", ". ") + " " + say(5)
        docs.append((i, t))
    return [*docs, (500, None), (501, ""), (501, ""), docs[0], (None, items[0][1]), (502, "x" * 200_000 + " " + say(20_000))], items


@pytest.mark.parametrize(("vocabulary", "pass_words"), [(300, 400_000), (6, 400_000), (40, 150)])
def test_decontamination(spark, vocabulary, pass_words):
    from pyspark.sql import functions as F

    docs, items = leaks(vocabulary, vocabulary)
    table = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, row int, spans int, items int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.spans(table, bench, pass_words=pass_words)
    got = got.select("row.doc_id", "n_words", contamination.hit(F.col("spans")), F.size("items"), F.sha2(F.array_join("items", ","), 256), contamination.hit(F.col("spans")) > 0)
    assert Counter(tuple(r) for r in got.collect()) == windows(docs, items)
    if pass_words > 1000:
        assert Counter(tuple(r) for r in contamination.query(table, bench).collect()) == windows(docs, items)


def test_long_items_lose_no_window_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(contamination, "PIECE", 25)
    docs, items = leaks(9, 50)
    r = random.Random(2)
    items.append((300, " ".join(f"q{i}" for i in range(133))))
    docs += [(600 + i, " ".join(f"q{j}" for j in range(a, a + r.choice([9, 10, 40])))) for i, a in enumerate(range(0, 125, 3))]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in contamination.query(table, bench).collect()) == windows(docs, items)


def test_decontamination_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert contamination.query(docs.limit(0), items).count() == 0
    assert [tuple(r)[1:4] for r in contamination.query(docs, items).collect()] == [(2, 0, 0)]


def test_clean_cuts_spans_and_turns_away_covered_documents(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    around = "Alpha beta: gamma delta epsilon zeta eta theta iota kappa; lambda mu nu"
    docs = [(1, f"{around} - {item.upper().replace(' ', ', ')}! {around}.", 5), (2, item + " end", 6), (3, around, 7), (4, None, 8), (5, f"{around} " + " ".join(item.split()[:10]) + f" {around}", 9)]
    table = spark.createDataFrame(docs, "doc_id long, text string, row int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["text"], r["row"]) for r in contamination.clean(table, bench, longest=10).collect()}
    assert got == {1: (f"{around} - ! {around}.", 5), 3: (around, 7), 4: (None, 8), 5: (docs[4][1], 9)}
