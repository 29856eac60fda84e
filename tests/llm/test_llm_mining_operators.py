"""Hard negatives, source mix and spelling variants against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import LONG, empty, odd

from lumenframe.llm import QUERIES, hard_negatives, source_mix, spelling_variants

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, label int, embedding array<double>, score int, h string, means int"


def mined(rows, anchor, low=30, high=90, positives=5, negatives=10):
    """Every pair scored, by the words of the task."""
    usable = {(i, la, tuple(math.floor(256 * x) for x in v)) for i, la, v in rows
              if i is not None and la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, la, v in usable:
        if i % anchor:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, lb) for j, lb, w in usable if len(w) == len(v)]
        for minus, j, _ in sorted(x for x in scored if x[2] == la and x[1] != i)[:positives]:
            inside = sorted(x for x in scored if x[2] != la and -low * minus <= -100 * x[0] <= -high * minus)[:negatives]
            out += [(i, j, r, k, -minus, -s) for r, (s, k, _) in enumerate(inside, 1)]
    return sorted(out)


def mine(spark, rows, anchor, **more):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)
    got = hard_negatives.hard_negatives(spark, frame, F.col("vec_id") % anchor == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def test_hard_negatives_against_every_pair(spark):
    rng = np.random.default_rng(1)
    steps = np.repeat(rng.normal(size=(40, 4)), 6, axis=1)  # vectors that their segments' means describe well
    rows = [(i, int(rng.integers(3)), (steps[i % 40] + rng.normal(size=24) * 0.05).tolist()) for i in range(260)]
    rows += [(i, i % 3, rows[0][2]) for i in range(300, 340)]  # one vector that many rows hold: ties
    rows += [rows[7], rows[7], (None, 1, rows[0][2]), (400, None, rows[0][2]), (401, 1, None), (402, 1, [1.0, None]), (403, 1, [math.nan]),
             (404, 1, [math.inf] * 24), (405, 1, []), (410, 2, []), (420, 1, [0.0] * 24), (430, 1, [1.0, 2.0]), (431, 1, [0.5, 2.0]), (432, 2, [0.4, 1.0])]
    want = mined(rows, 10)
    assert len(want) > 300
    assert mine(spark, rows, 10) == want


def test_hard_negatives_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(4)), rng.normal(size=16).tolist()) for i in range(300)] + [(i, 0, [0.5] * 16) for i in range(300, 400)]
    monkeypatch.setattr(hard_negatives, "BLOCK_NUMBERS", 500)
    assert mine(spark, rows, 7, low=10, high=95, positives=3, negatives=4) == mined(rows, 7, 10, 95, 3, 4)


def test_hard_negatives_of_nothing(spark):
    assert mine(spark, [], 1) == []
    assert mine(spark, [(0, 1, [1.0])], 1) == []
    assert mine(spark, [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [1.0])], 10) == []  # a positive below 0 has no window


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8, 9, 64, 100])
def test_segment_bounds_hold(size):
    rng = np.random.default_rng(size)
    x = np.floor(rng.normal(size=(50, size)) * 90).astype(np.int64)
    x[:5] = x[0]
    means, deviations = hard_negatives.summaries(x.astype(float))
    block = hard_negatives.Block.__new__(hard_negatives.Block)
    block.size, block.q, block.means, block.deviations = size, x, means, deviations
    block.norms = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    true, last = x @ x.T, None
    for level in range(len(hard_negatives.levels_of(size))):
        low, high = hard_negatives.bounds(block, block, level, slice(0, 50))
        assert (low <= true).all() and (true <= high).all()
        if last is not None:  # refining narrows the bounds on the whole
            assert (high - low).sum() <= last + 1e-6
        last = (high - low).sum()
        pairs = np.array([0, 3, 9]), np.array([1, 3, 40])
        for a, b in zip(hard_negatives.bounds(block, block, level, slice(0, 50), pairs), (low, high)):
            assert np.allclose(a, b[pairs])


def test_filter_leaves_few_pairs_of_vectors_with_structure(monkeypatch):
    """Rows whose segments' means differ are decided by the summaries: few pairs are scored exactly."""
    rng = np.random.default_rng(4)
    x = np.floor(256 * (np.repeat(rng.normal(size=(500, 8)), 8, axis=1) + rng.normal(size=(500, 64)) * 0.02)).astype(np.int64)
    block = hard_negatives.Block.__new__(hard_negatives.Block)
    block.size, block.q, block.ids, block.labels = 64, x, np.arange(500), np.arange(500) % 5
    block.means, block.deviations = hard_negatives.summaries(x.astype(float))
    block.norms = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    seen = []
    kept = hard_negatives.exact
    monkeypatch.setattr(hard_negatives, "exact", lambda a, b, pairs=None: (seen.append(len(pairs[0]) if pairs else len(a) * len(b)), kept(a, b, pairs))[1])
    list(hard_negatives.search(block, block, [[(-np.inf, np.inf)]] * 500, True, 5))
    assert sum(seen) < 0.1 * 500 * 500


def test_exact_scores_beyond_doubles():
    a = np.array([[2 ** 27 + 1, 1]], np.int64)
    assert hard_negatives.exact(a, a)[0, 0] == (2 ** 27 + 1) ** 2 + 1
    assert hard_negatives.exact(a, a, (np.array([0]), np.array([0])))[0] == (2 ** 27 + 1) ** 2 + 1


def sainte_lague(weights, seats):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        best = min(weights, key=lambda p: (-Fraction(weights[p]) / (2 * got[p] + 1), p))
        got[best] += 1
    return got


def test_apportionment_by_highest_quotients(spark):
    rng = random.Random(5)
    groups = {"a": {i: float(rng.randint(1, 50)) for i in range(40)}, "b": {0: 1e6, **{i: 1.0 for i in range(1, 30)}}, None: {3: 7.0}, "t": {i: 2.0 for i in range(10)}}
    seats = {"a": 101, "b": 57, None: 4, "t": 13}
    parties = spark.createDataFrame([(g, p, w) for g, ps in groups.items() for p, w in ps.items()], "g string, p int, w double")
    rows = source_mix.apportion(spark, parties, "p", "w", spark.createDataFrame(list(seats.items()), "g string, seats bigint"), ["g"]).collect()
    for g, ps in groups.items():
        assert {r.p: r.quota for r in rows if r.g == g} == sainte_lague(ps, seats[g])


def targets(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    free, left, out = set(names), Fraction(sum(sizes.values())), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = Fraction(most * sizes[s])
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def check_mix(rows, texts, tolerance):
    """rows of the mix against sizes and targets; texts: (doc_id, text, source)."""
    words = lambda t: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d, words(t)) for d, t, _ in texts)
    sizes = defaultdict(int)
    for _, t, s in texts:
        sizes[s] += words(t)
    want = targets(sizes)
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))
        assert r.taken == sum(p.words * p.times for p in r.pieces)
        ends = [0]
        for p in r.pieces:
            assert p.first >= ends[-1] and p.words > 0 and 1 <= p.times <= 3
            ends.append(p.first + p.words)
        assert ends[-1] <= r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - float(want[s])) <= tolerance, (s, taken[s], float(want[s]))


def test_mix_with_a_hot_source_and_long_documents(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "SHARD", 16)
    rng = random.Random(3)
    texts = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 3, 40, 200]))), rng.choice(["a", "a", "a", "b", "c", None, "é", "z"])) for i in range(400)]
    texts += [(1000, "one " * 5000, "a"), (1000, "one " * 5000, "a"), (None, "no id here", "b"), (1002, None, "c"), (1003, " \n ", "only blank"), (1004, "", None)]
    docs = spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id bigint, text string, source string, size int, pieces string")
    mixed = source_mix.mix(spark, docs, shard=16)
    rows = mixed.collect()
    check_mix(rows, texts, 32)
    again = source_mix.mix(spark, docs.repartition(7), shard=16).collect()
    assert Counter((r.doc_id, r.taken, str(r.pieces)) for r in rows) == Counter((r.doc_id, r.taken, str(r.pieces)) for r in again)


def test_mix_of_odd_and_empty_tables(spark):
    rows = [(r.doc_id, r.text, r.source) for r in odd(spark).collect()]
    check_mix(source_mix.mix(spark, odd(spark)).collect(), rows, 32)
    assert source_mix.mix(spark, empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in source_mix.mix(spark, blank).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_mixed_texts_hold_the_words_taken(spark):
    docs = spark.createDataFrame([(1, "a b\tc " * 30, "x"), (2, "d " * 200, "y"), (3, "e f", "z")], "doc_id bigint, text string, source string")
    mixed = source_mix.mix(spark, docs)
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    got = Counter()
    for r in source_mix.mixed_texts(docs, mixed).collect():
        assert len(r.text.split(" ")) == r.words
        got[r.doc_id] += r.words
    assert got == Counter({k: v for k, v in taken.items() if v})


def test_mix_query_shares_all_words(spark):
    rows = QUERIES["op12_source_mix"](spark, SF).collect()
    goal, got = {r.source_size: r.target for r in rows}, Counter()
    for r in rows:
        got[r.source_size] += r.taken
    assert all(abs(got[s] - goal[s]) <= 32 for s in goal) and sum(r.taken for r in rows) == pytest.approx(sum(r.size for r in rows), rel=0.01)


def words_of(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode()) & 0xFFFFFFFF
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def grouped(counts):
    """Near words through shared deletions, then forms and roots one by one."""
    holes = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            holes[w[:i], w[i + 1:], len(w)].add(w)
    near = defaultdict(set)
    for (a, b, _), ws in holes.items():
        for w in ws:
            near[w] |= ws - {w}
            if a + b in counts:
                near[w].add(a + b)
                near[a + b].add(w)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def variants(spark, docs):
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, word string, n int")
    rows = spelling_variants.spelling_variants(spark, spelling_variants.word_counts(frame)).collect()
    assert len(rows) == len({r.word for r in rows})
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def made_up(seed, words, times):
    """Texts over a small alphabet, so that many words are near each other, with anagrams and chains."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcpqÀz") for _ in range(rng.randint(4, 8))) for _ in range(words)]
    pool += ["".join(p) for p in __import__("itertools").permutations("abcde")]
    pool += [w[:i] + rng.choice("aq") + w[i:] for w in pool[:words // 2] for i in [rng.randint(0, len(w))]]
    return [(i, " ".join(rng.choice(pool).title() if rng.random() < .2 else rng.choice(pool[:1 + rng.randint(0, len(pool) - 1)]) for _ in range(60))) for i in range(times)]


@pytest.mark.parametrize("subtree", [50_000, 40, 1])
def test_variants_against_shared_deletions(spark, monkeypatch, subtree):
    monkeypatch.setattr(spelling_variants, "SUBTREE_WORDS", subtree)
    docs = made_up(3, 250, 150)
    docs += [(None, "without an id " * 3), (500, None), (501, ""), (502, "short a b c"), (503, LONG), (503, LONG), (504, "x" * 300 + " " + "x" * 301), (505, ("x" * 300 + " ") * 4 + ("x" * 301 + "-") * 9),
             (506, "×÷×÷× " * 4 + "ÉCOLE école Ecole " * 5), (507, "naïvé " * 5 + "İstanbul " * 4 + "straße " * 4)]
    want = grouped(words_of(docs))
    assert sum(1 for r in want if r[1]) > 50 and any(r[2] != r[1] for r in want if r[1])
    assert variants(spark, docs) == want


def test_variants_of_nothing(spark):
    assert variants(spark, []) == set()
    assert variants(spark, [(1, None), (2, "once more")]) == set()


def test_variants_query_on_whole_texts(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in QUERIES["op13_spelling_variants"](spark, SF).collect()}
    assert got == grouped(words_of(docs))


def test_roots_at_the_end_of_long_chains(spark):
    chain = [("a" * (5 + i), 3 * 2 ** i) for i in range(20)]
    rows = spelling_variants.spelling_variants(spark, spark.createDataFrame(chain, "word string, n bigint")).collect()
    assert {r.root for r in rows} == {"a" * 24} and {(r.word, r.form) for r in rows} == {(w, chain[i + 1][0] if i < 19 else None) for i, (w, _) in enumerate(chain)}


def test_words_are_counted_in_bounded_tables():
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array([" ".join(f"word{chr(97 + i % 26)}{chr(97 + j % 26)}x" for j in range(40)) for i in range(50)])], ["doc_id", "text"])
    old, spelling_variants.TABLE_WORDS = spelling_variants.TABLE_WORDS, 30
    try:
        parts = list(spelling_variants.count_words(iter([batch])))
    finally:
        spelling_variants.TABLE_WORDS = old
    assert len(parts) > 1 and max(p.num_rows for p in parts) <= 30 + 40
