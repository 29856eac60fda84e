"""Operators on documents against brute force, and on odd tables."""

import collections
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from rows import LONG, documents, empty, odd

from lumenframe.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup, perfect_hash, secret_scan, suffix_dedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    index = perfect_hash.PerfectHash.from_bytes(perfect_hash.PerfectHash.build(keys).to_bytes())
    assert sorted(index.place(keys)) == list(range(len(keys)))
    same = perfect_hash.PerfectHash.build(np.array([5, 5, 9], np.uint64))
    assert len(same.rest) == 2


def test_line_dedup_with_a_hot_line_and_odd_rows(spark):
    rng = random.Random(2)
    texts = {i: "\n".join(["One COMMON line " + "x" * (i % 2 == 5)] * (i % 3 == 0) + [sentence(rng, 3)] + ["short"] + ["pair %d of lines" % (i // 2)]) for i in range(60)}
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(spark, documents(spark, texts)).collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = collections.defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            held[key(line)].add(i)
    for i, t in texts.items():
        kept = [x for x in t.split("\n") if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == i]
        assert got[i]["kept"] == "\n".join(kept) and got[i]["n_dropped"] == t.count("\n") + 1 - len(kept)
    done = line_dedup.drop_repeated_lines(spark, odd(spark)).collect()
    assert len(done) == 10
    by = {(r["doc_id"], r["source"]): r for r in done}
    assert by[(None, "z")]["kept"] == "" and by[(7, "x")]["kept"] == "a line without an id"
    assert by[(1, "x")]["n_lines"] == 1 and by[(4, "y")]["n_dropped"] == 0
    assert line_dedup.drop_repeated_lines(spark, empty(spark)).count() == 0


def test_jaccard_join_against_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        base = sentence(rng, rng.choice([2, 5, 6, 9, 12, 14, 40, 120])).split()
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = "new%d" % rng.randrange(9)
            texts.append(" ".join(copy))
    texts += ["", None, " \n ", texts[0], texts[0].upper(), "one two", "ONE  two"]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r["doc_id"]: r for r in jaccard_join.similar_documents(spark, documents(spark, texts)).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == root
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]


def test_jaccard_join_on_odd_rows(spark):
    got = [(r["doc_id"], r["component_id"]) for r in jaccard_join.similar_documents(spark, odd(spark)).collect()]
    assert len(got) == 10 and (7, 7) in got and got.count((None, None)) == 2 and got.count((4, 4)) == 2
    assert jaccard_join.similar_documents(spark, empty(spark)).count() == 0


def test_subset_and_list_sizes_agree():
    for s in range(1, 30):
        for t in range(s, 30):
            need = jaccard_join.required(s, t)
            assert 100 * need >= 75 * (s + t - need) and 100 * (need - 1) < 75 * (s + t - need + 1)


@pytest.mark.parametrize("boundary", [0, 6])
def test_list_links_just_below_and_above_the_threshold(spark, boundary):
    rng = random.Random(5)
    sets = []
    for _ in range(20):
        base = [rng.getrandbits(63) for _ in range(rng.choice([1, 3, 5, 8, 12, 20, 40, 100, 300]))]
        for _ in range(10):
            loss = rng.choice([0.05, 0.1, 0.14, 0.18, 0.25])
            kept = {h for h in base if rng.random() > loss} | {rng.getrandbits(63) for _ in range(int(len(base) * loss * rng.random()))}
            sets += [np.unique(np.array(sorted(kept), np.uint64))] if kept else []
    rows = spark.createDataFrame([(i, len(s), i, s.tobytes()) for i, s in enumerate(sets)], "id bigint, n bigint, root bigint, hashes binary")
    got = [tuple(sorted(r)) for r in jaccard_join.list_links(rows, boundary).collect()]
    want = [(i, j) for j in range(len(sets)) for i in range(j) if max(len(sets[i]), len(sets[j])) > boundary and jaccard_join.similar(sets[i], sets[j])]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("rounds", ["round_links", "more_links"])
def test_hashes_are_joined_to_possible_pairs_only(spark, monkeypatch, rounds):
    rng = random.Random(6)
    common = [rng.getrandbits(63) for _ in range(60)]
    sets = [np.unique(np.array(common + [rng.getrandbits(63) for _ in range(rng.choice([60, 70, 200]))], np.uint64)) for _ in range(40)]
    sets += [np.delete(s, slice(3)) for s in sets[:10]]  # the only links
    rows = spark.createDataFrame([(i, len(s), i, s.tobytes()) for i, s in enumerate(sets)], "id bigint, n bigint, root bigint, hashes binary")
    checked, seen = jaccard_join._checked, []

    def kept(pairs, *rest):
        seen.extend((r["a"], r["b"]) for r in pairs.select("a", "b").collect())
        return checked(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_checked", kept)
    got = {tuple(sorted(r)) for r in getattr(jaccard_join, rounds)(rows, 8).collect()}
    assert got and got <= {(i, 40 + i) for i in range(10)}
    # A pair brings both sets' hashes along, so pairs that sizes and parities rule out are gone by then, and none comes twice.
    assert {tuple(sorted(p)) for p in seen} == got and len(seen) == len(set(seen))


def test_list_links_of_repeated_rows(spark):
    rng = random.Random(7)
    sets = []
    for _ in range(30):
        base = [rng.getrandbits(63) for _ in range(40)]
        sets += [np.unique(np.array(base[:36] + [rng.getrandbits(63) for _ in range(4)], np.uint64)) for _ in range(3)]
    rows = spark.createDataFrame([(i, len(s), i, s.tobytes()) for i, s in enumerate(sets) for _ in range(3)], "id bigint, n bigint, root bigint, hashes binary")
    got = {tuple(sorted(r)) for r in jaccard_join.list_links(rows, 0).collect()}
    assert got == {(i, j) for j in range(len(sets)) for i in range(j) if jaccard_join.similar(sets[i], sets[j])} and len(got) == 90


def test_suffix_order():
    rng = random.Random(4)
    for n in [*range(12), 50, 200]:
        t = np.array([rng.randrange(3) for _ in range(n)], np.int64)
        assert suffix_dedup.difference_cover_order(t, 300).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
    t = np.array([rng.choice([5, rng.randrange(1 << 22)]) for _ in range(500)] + [1 << 22], np.int64)  # symbols too wide to pack three
    assert suffix_dedup.difference_cover_order(t, 1000).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize("most", [3000, 1])  # 1: every anchor with several texts goes window by window
def test_suffix_dedup_against_all_strings(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_CLASSES", most)
    rng = random.Random(5)
    shared = [sentence(rng, 60), sentence(rng, 45), "é" * 300]
    texts = [" ".join(rng.choice([sentence(rng, 20), *shared]) for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    texts += [texts[0], "", None, "x" * 199, "y" * 200, "ab" * 400]
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i:i + 200] for d in data for i in range(len(d) - 199))
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark, documents(spark, texts)).collect()}
    for n, d in enumerate(data):
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(d, gone) if not g)
        assert bytes(got[n]["kept"]) == kept and got[n]["n_spans"] == len(re.findall(b"\1+", bytes(gone))) and got[n]["n_removed"] == sum(gone)


def test_suffix_dedup_on_odd_rows(spark):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark, odd(spark)).where("doc_id is not null").collect()}
    assert got[4]["n_removed"] == len(LONG) and got[1]["n_bytes"] == 0 and got[7]["n_removed"] == 0
    assert suffix_dedup.remove_repeats(spark, empty(spark)).count() == 0


def test_decontamination_finds_copies_with_edits_and_leaves_others(spark):
    rng = random.Random(6)
    items = [(i, sentence(rng, n)) for i, n in enumerate([8, 12, 20, 40])] + [(9, ""), (10, None), (None, sentence(rng, 15)), (11, "tiny")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    long = items[3][1]
    edited = list(long)
    for k in range(0, len(edited), 25):
        edited[k] = "#"
    texts = [sentence(rng, 50), "so " + items[0][1].upper().replace(" ", " \n ") + " end", "".join(edited), long[40:210], items[6][1], "a tiny bit", None, "", sentence(rng, 400),
             sentence(rng, 70000) + " " + items[1][1]]
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontaminate.with_leaks(spark, documents(spark, texts), bench).collect()}
    assert got == {0: [], 1: [0], 2: [3], 3: [3], 4: [None], 5: [11], 6: [], 7: [], 8: [], 9: [1]}
    assert decontaminate.with_leaks(spark, odd(spark), bench.where("false")).where("size(leaks) > 0").count() == 0
    assert len(list(decontaminate.blocks(bench, 100))) > 2
    small = decontaminate.Windows([(1, items[2][1])])
    found = small.hits("before " + items[2][1] + " after")[0]
    assert (found["start"], found["stop"], found["edits"]) == (7, 7 + len(items[2][1]), 0)


def test_q_gram_filter_loses_no_region(spark):
    rng = random.Random(7)
    item = "".join(rng.choice("abcdefgh ") for _ in range(100)).strip().ljust(100, "z")
    index = decontaminate.Windows([(1, item)])
    for _ in range(60):
        t = list(item)
        for _ in range(rng.randrange(0, 11)):
            k = rng.randrange(len(t))
            rng.choice([lambda: t.__setitem__(k, "Q"), lambda: t.pop(k), lambda: t.insert(k, "W")])()
        assert index.hits("x" * rng.randrange(40) + " " + "".join(t) + " yyyy")


def test_short_quotes_are_found_wherever_they_start():
    rng = random.Random(11)
    item = sentence(rng, 40)[:250].strip()
    index = decontaminate.Windows([(1, "some other item of the block"), (2, item)])
    quotes = [item[s:s + n] for n in (60, 85, 100, 130) for s in range(len(item) - n + 1)]
    for n, found in enumerate(index.search(pd.Series(["so " + q.upper() + " end" for q in quotes]))):
        assert [x["item_id"] for x in found] == [2], quotes[n]
    edited = [q[:20] + "#" + q[21:40] + q[41:55] + "##" + q[55:] for q in quotes if len(q) >= 130]
    assert all(index.search(pd.Series(edited)))
    assert not any(index.search(pd.Series([sentence(rng, 60) for _ in range(50)])))


def test_language_scores_are_exact_code_lengths(spark):
    rng = random.Random(8)
    docs = [("a", " ".join(rng.choice(["the", "thin", "ether", "hat"]) for _ in range(40))) for _ in range(6)]
    docs += [("b", " ".join(rng.choice(["uno", "nube", "bueno", "año"]) for _ in range(40))) for _ in range(6)] + [(None, "zzz"), ("a", None), ("b", "")]
    trees = language_id.learn(spark.createDataFrame(docs, "lang string, text string"), order=3)
    grams = {k: collections.Counter() for k in "ab"}
    for lang, t in docs:
        for d in [(t or "").encode()] if lang else []:
            for w in range(1, 5):
                grams[lang].update(d[i:i + w] for i in range(len(d) - w + 1))
    whole = grams["a"] + grams["b"]
    grams = {k: {g: n for g, n in v.items() if whole[g] >= language_id.LEAST_COUNT} for k, v in grams.items()}

    def bits(lang, d):
        total = 0.0
        for i in range(len(d)):
            for w in range(min(3, i) + 1, 0, -1):
                below = [n for g, n in grams[lang].items() if len(g) == w and g[:-1] == d[i - w + 1:i]]
                if not below:
                    continue
                n = grams[lang].get(d[i - w + 1:i + 1], 0)
                total -= np.log2((n or len(below)) / (sum(below) + len(below)))
                if n:
                    break
            else:
                total += 8
        return total

    for text in (b"the bueno", b"a", "xñ the".encode(), b"nube hat" * 3):
        assert np.allclose(trees.bits([b"pad", text, b"q"])[1], [bits("a", text), bits("b", text)])
    long = b"the hat " * 40000
    assert np.allclose(trees.bits([long])[0], trees.bits([b"x", long])[1])
    got = {r["doc_id"]: r for r in language_id.with_language(spark, odd(spark), trees).where("doc_id is not null").collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[5]["lang_pred"] == "und" and got[1]["score"] == 0
    assert got[4]["lang_pred"] == "a" and 0 <= got[6]["score"] <= 1
    assert language_id.learn(spark.createDataFrame([], "lang string, text string")) is None
    assert language_id.with_language(spark, odd(spark), None).where("lang_pred <> 'und'").count() == 0


def test_copies_do_not_fill_the_language_sample(spark):
    texts = [f"text{c} text{c}" for c in "abcdefgh"]
    once = spark.createDataFrame([("x", t) for t in texts], "lang string, text string")
    copies = spark.createDataFrame([("x", t) for t in texts for _ in range(50)], "lang string, text string")
    for most in (4, 8):
        want, got = (language_id.learn(d, order=3, sample_rows=most).bits([b"texta", b"texth texth"]) for d in (once, copies))
        assert np.array_equal(want, got)


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    done = language_id.with_language(spark, docs, language_id.learn_documents(docs)).where(language_id.held_out(F.col("doc_id")))
    assert done.where("lang = lang_pred").count() >= 0.97 * done.count() > 0


def test_secret_spans_against_a_scan(spark):
    texts = ["password = 'abcdefgh1' token=short API_KEY:\"0123456789abcdef0123456789abcdef\"", "token=token\"=abcdefgh", "AKIA" + "Z" * 12 + " AKIASHORT", "é漢 secret: aaaaaaaa", None, "",
             "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "f" * 64 + " " + "token=12345678 " * 500, "passwdpasswd=12345678"]
    base = {"assign": (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}
    got = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["spans"]] for r in secret_scan.scan_secrets(documents(spark, texts)).collect()}
    for n, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, (p, g, least) in base.items() for m in re.finditer(p, t or "") if len(m[g]) >= least]
        assert sorted(x for x in got[n] if x[0] in base) == sorted(want)
    assert got[6][0][0] == "private_key" and got[7][0][0] == "code_host"
    assert secret_scan.scan_secrets(odd(spark)).where("size(spans) > 0").count() == 0 and secret_scan.scan_secrets(empty(spark)).count() == 0


def test_trigram_queries_hold_for_every_match():
    samples = {"assign": "API_key=12345678", "access": "AKIA" + "Z" * 12, "private_key": "-----BEGIN EC PRIVATE KEY-----", "code_host": "gho_" + "x" * 36, "chat_host": "xoxp-1234567890"}

    def meets(need, text):
        if need is True or isinstance(need, str):
            return need is True or need in text
        return (all if need[0] == "and" else any)(meets(p, text) for p in need[1])

    for rule in secret_scan.RULES:
        need = secret_scan.trigram_query(rule.pattern)
        assert (need is True) == (rule.kind == "hex")
        if rule.kind in samples:
            assert re.search(rule.pattern, samples[rule.kind]) and meets(need, samples[rule.kind].lower()) and not meets(need, "plain text")


def test_secret_scan_uses_no_python(spark):
    plan = secret_scan.scan_secrets(documents(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer
    path = bpe.default_vocabulary()
    library, rng = Tokenizer.from_file(path), random.Random(9)
    letters = "ab 'sS\t\n\r\x1c\x85\xa0　᠎​é中1²Ⅳ٣😀.,-_́กª\0֋"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["a" * 3000, "abc" * 2000, "x<|endoftext|> <|endoftext|>", "word " * 60000, "", LONG]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = {r["doc_id"]: r for r in bpe.encode_rows(spark, documents(spark, texts), path).collect()}
    for n, t in enumerate(texts):
        assert np.frombuffer(bytes(got[n]["ids"]), "<u4").tolist() == want[n] and got[n]["decoded"] == library.decode(want[n], skip_special_tokens=False) == t
    done = {r["doc_id"]: r for r in bpe.encode_rows(spark, odd(spark), path).where("doc_id is not null").collect()}
    assert done[1]["n_tokens"] == 0 and done[1]["decoded"] == "" and done[6]["decoded"].startswith("Straße")
    assert bpe.encode_rows(spark, empty(spark), path).count() == 0


def test_scan_and_heap_merge_alike():
    with open(bpe.default_vocabulary(), "rb") as f:
        v = bpe.Vocabulary(f.read())
    rng = random.Random(10)
    for _ in range(300):
        parts = [v.first[b] for b in "".join(rng.choice("aabethnr ing") for _ in range(rng.randrange(1, 60))).encode()]
        assert v._scan(list(parts)) == v._heap(list(parts))


def test_decoded_digests_and_small_parts(spark, monkeypatch):
    import hashlib

    import pyarrow as pa
    monkeypatch.setattr(bpe, "PART_BYTES", 10)
    batch = pa.array(["a" * 8, None, "b" * 8, "", "c" * 40, "d"])
    assert [p.to_pylist() for p in bpe.few(batch)] == [["a" * 8, None, "b" * 8], ["", "c" * 40], ["d"]] and list(bpe.few(batch.slice(0, 0))) == []
    texts = ["plain text", None, "", "Straße 漢字 😀", LONG]
    path = bpe.default_vocabulary()
    whole = {r["doc_id"]: r["decoded"] for r in bpe.encode_rows(spark, documents(spark, texts), path).collect()}
    hashed = {r["doc_id"]: r["decoded_sha256"] for r in bpe.encode_rows(spark, documents(spark, texts), path, digest=True).collect()}
    assert hashed == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in whole.items()} and whole[3] == texts[3]


def test_words_split_alike_for_latin_texts():
    exact, latin = bpe.regex.compile(bpe.EXACT_PATTERN, bpe.regex.V1), bpe.re.compile(bpe.LATIN_PATTERN)
    rng = random.Random(11)
    texts = [t for c in map(chr, range(256)) for t in (c, "a" + c, " " + c, "1" + c + "1", c + " ", c + c + " x", "'" + c, c + "\n")]
    texts += ["".join(rng.choice("ab'sstmdrelv  \n\t1 9²¼éªµ×÷!.\x85\xa0\x1c\x1f\x0b") for _ in range(rng.randrange(25))) for _ in range(3000)]
    assert all(latin.findall(t) == exact.findall(t) for t in texts)


def test_a_full_word_table_keeps_its_later_words(monkeypatch):
    with open(bpe.default_vocabulary(), "rb") as f:
        v = bpe.Vocabulary(f.read())
    words = [f" word{i}" for i in range(100)]
    want = [v[w] for w in words]
    v.clear()
    v.held = 0
    monkeypatch.setattr(bpe, "KEPT_BYTES", 20 * bpe.ENTRY_BYTES)
    assert [v[w] for w in words] == want
    assert words[-2] in v and words[0] not in v and len(v) < 30
    assert v.held == sum(len(w) + len(ids) + bpe.ENTRY_BYTES for w, ids in v.items())


def test_decontamination_scans_without_hashing_its_hits(monkeypatch):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(20)]
    index = decontaminate.Windows(items)
    texts = [" ".join(rng.choice(words) for _ in range(50)) + (" " + items[i][1] + " tail" if i < 20 else "") for i in range(60)] + [None, "", "漢字 😀 " + items[3][1].upper()]

    def unique(*args, **kwargs):
        raise AssertionError("np.unique hashes integers, at several times the cost of a sort")

    monkeypatch.setattr(decontaminate.np, "unique", unique)
    got = [[h["item_id"] for h in x] for x in index.search(pd.Series(texts))]
    assert got == [[i] for i in range(20)] + [[]] * 42 + [[3]]


def test_decontamination_takes_runs_that_only_seem_known(spark):
    rng = random.Random(5)
    items = [(k, " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(60))) for k in range(30)]
    index = decontaminate.Windows(items)
    letters = [chr(c) for c in range(0x100, 0x3000) if chr(c).lower() == chr(c) and not chr(c).isspace()]
    h = np.concatenate([decontaminate.gram_hashes(decontaminate.normalize(c * decontaminate.Q)[0]) for c in letters])
    seen = index.seen[h >> np.uint64(64 - decontaminate.BITS)]
    runs = [c * 200 for c, one in zip(letters, seen) if one][:5]
    # Their hashes begin as those of items do, but none is one.
    assert len(runs) == 5 and not any(np.isin(h, g.keys).any() for g in index.grams)
    assert index.search(pd.Series(runs)) == [[]] * 5
    copy = "before it. " + items[7][1] + " after it."
    assert [[x["item_id"] for x in found] for found in index.search(pd.Series([runs[0], copy, runs[1]]))] == [[], [7], []]
    # Grams of an item that is too short for short windows are known to long windows only.
    short = decontaminate.Windows([(1, "one short item of fewer characters"), items[0]])
    got = short.search(pd.Series(["it holds one short item of fewer characters."]))
    assert [[x["item_id"] for x in found] for found in got] == [[1]]
    docs, bench = documents(spark, [*runs, copy]), spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontaminate.with_leaks(spark, docs, bench).collect()}
    assert got == {k: [] for k in range(5)} | {5: [7]}
