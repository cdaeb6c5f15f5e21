"""The text operators on small fixtures: brute force, nulls, empty tables, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import decontaminate, fingerprints, language_id, language_model, licenses, mixing, near_dedup, quality, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, row string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, **more):
    rows = [(i, t, more.get("lang", {}).get(i), more.get("source", {}).get(i), len(t or ""), 1, "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randint(0, words)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    a, shared = prose(1, 120), prose(2, 60)
    out = [a, a, shared + " " + prose(3, 80), prose(4, 50) + "\n" + shared, None, "", "one", "x " * 90, prose(5, 20_000)]
    out += [" ".join(a.split()[:100]) + " " + prose(6, 12), a.upper(), "été 中文 ok", a]
    return [*enumerate(out), (0, a), (3, "another text of doc three")]


def test_substring_dedup(spark, texts):
    window = 35
    docs = [WORD.findall(t or "") for _, t in texts]
    seen = {}
    for i, w in enumerate(docs):
        for j in range(len(w) - window + 1):
            seen.setdefault(tuple(w[j : j + window]), []).append((i, j))
    gone = {(i, j + o) for at in seen.values() if len(at) > 1 for i, j in at for o in range(window)}
    want = sorted((d, len(w), sum((i, j) in gone for j in range(len(w))), hashlib.sha256(" ".join(x for j, x in enumerate(w) if (i, j) not in gone).encode()).hexdigest()) for i, ((d, _), w) in enumerate(zip(texts, docs, strict=True)))
    for hot in (2000, 1):
        got = substring_dedup.remove_duplicates(table(spark, texts), window, hot).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got)) == want


def test_near_dedup(spark, texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [WORD.findall((t or "").translate(low)) for _, t in texts]
    sets = [set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set() for w in words]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {r: min(texts[i][0] for i in range(len(sets)) if root[i] == r) for r in root}
    want = sorted((texts[i][0], len(sets[i]), least[root[i]]) for i in range(len(sets)))
    got = near_dedup.near_duplicates(table(spark, texts), 2, 80).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("grams", [200_000, 20])
def test_decontamination(spark, texts, grams):
    items = [(1, " ".join(prose(2, 60).split()[5:30])), (2, "One!"), (10, None), (3, "Été 中文"), (4, prose(99, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.decontaminate(table(spark, texts), bench, 10, grams).select("row.doc_id", "n_words", "n_hit", "items").collect()}
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], []).append(r)
    assert by_id[2][0][2:] == (25, ("1",))
    assert {r[2:] for r in by_id[3]} == {(25, ("1",)), (0, ())}
    assert by_id[6][0] == (6, 1, 1, ("2",))
    assert by_id[4][0][1:] == (0, 0, ())


def test_mixing(spark):
    rows = [(i, prose(i, 5 + i % 90)) for i in range(600)] + [(600, None), (601, "")]
    docs = table(spark, rows, source={i: ("a" if i < 300 else f"s{i % 4}") if i % 50 else None for i in range(600)})
    got = mixing.repetitions(docs).collect()
    assert len(got) == 602 and sorted(got) == sorted(mixing.repetitions(docs.repartition(7)).collect())
    size, target, taken = {}, {}, {}
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        size[r["source"]] = r["source_size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        left = total - sum(2 * size[s] for s in capped)
        want = {s: 2 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in size if x not in capped) for s in size}
        over = {s for s in size if s not in capped and want[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert taken[s] == pytest.approx(target[s], rel=0.03, abs=10)
    assert mixing.mixture(docs).count() == sum(r["repeats"] for r in got)


def test_language_id(spark):
    r = random.Random(5)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"]}
    rows = [(i, " ".join("".join(r.choice(syllables["ab"[i % 2] * 2]) for _ in range(3)) for _ in range(12))) for i in range(80)]
    docs = table(spark, [*rows, (80, None), (81, "12 !?")], lang={i: "ab"[i % 2] * 2 for i in range(60)})
    model = language_id.fit(docs, F.lit(True))
    got = {x["doc_id"]: x for x in language_id.identify(docs, model).select("row.doc_id", "lang_pred", "score").collect()}
    assert all(got[i]["lang_pred"] == "ab"[i % 2] * 2 for i in range(80))
    assert got[80]["lang_pred"] == got[81]["lang_pred"] == "und"


@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints(spark, texts, parts):
    rows = sorted(((i, t or "") for i, t in texts), key=lambda x: (-x[0], x[1]))
    docs = table(spark, texts)
    got = fingerprints.compare_with_next(docs, fingerprints.lexicon(docs), parts).collect()
    want = []
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(t) // 3
        want.append((d, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    prints = {}
    for r in got:
        prints.setdefault(r["doc_id"], []).append(tuple(r["fingerprint"]))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert prints[0][0] == prints[0][1] == prints[1][0] == prints[12][0]


def test_lexicon_two_ways(spark, texts):
    docs = table(spark, texts)
    assert sorted(fingerprints.lexicon(docs, 0.1, 0.5).terms) == sorted(fingerprints.lexicon(docs, 0.1, 0.5, nominees=3).terms)


def test_licenses(spark):
    docs = table(spark, [(1, prose(1, 33) + " All rights reserved. " + prose(2, 9)), (2, licenses.TEMPLATES["MIT-grant"]), (3, None), (4, "rights"), (5, prose(3, 6) + " (Released under the MIT License)"), (6, "all rights are mine reserved")])
    assert {(r[0], r[1]) for r in licenses.scan(docs).collect()} == {(1, "all-rights-reserved"), (2, "MIT-grant"), (5, "MIT")}


def test_language_model(spark, texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    from collections import Counter
    from math import log10

    learn = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    tokens = [(i, [*WORD.findall((t or "").translate(low)), None]) for i, t in texts]
    count = Counter(x for i, w in tokens if learn(i) for x in w)
    n = sum(count.values())
    want = sorted((i, len(w), sum(x in count for x in w), n, round(sum(log10((count[x] + 1) / (n + len(count) + 1)) for x in w), 6)) for i, w in tokens)
    out = language_model.score(table(spark, texts), F.crc32(F.col("doc_id").cast("string")) % 7 != 2).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 for r in out)


def test_language_model_words_in_context(spark):
    """Tokens of one suffix and one count, outside the most frequent, have scores by context; these don't depend on the partitions."""
    r = random.Random(5)
    common = [f"c{i}" for i in range(170)]
    texts = [" ".join(x for _ in range(12) for x in (r.choice(common), r.choice(("left xaa", "right yaa") if i % 6 == 0 else ("left", "right")), *r.sample(common, 8))) for i in range(300)]
    docs = table(spark, [*enumerate(texts), (300, "left xaa"), (301, "left yaa"), (302, "right xaa"), (303, "right yaa")])
    one, many = ({x["doc_id"]: x["score"] for x in language_model.score(docs.repartition(n), F.col("doc_id") < 300).collect()} for n in (1, 7))
    assert all(one[i] == pytest.approx(many[i], abs=1e-4) for i in one)
    assert one[300] + one[303] > one[301] + one[302] + 0.2


def test_language_model_classes_grow():
    import numpy as np

    assert language_model.Vocabulary.sizes(0) == (language_model.OWN, language_model.RARE)
    assert sum(language_model.Vocabulary.sizes(4_000_000)) == language_model.OWN + language_model.RARE + 2 * 159
    assert sum(language_model.Vocabulary.sizes(10**9)) < 2400
    x = np.random.default_rng(1).normal(size=(9, 3))
    h, i, n = np.array([0, 0, 1, 1]), np.array([0, 1, 2, 3]), np.array([30, 2, 2, 30])
    mean, inverse = language_model.discriminant(x, np.bincount(i, n, 9))
    sums = np.stack([np.bincount(h, n * x[i, d]) for d in range(3)], 1)
    w = language_model.word_vectors(np.bincount(h, n), sums, np.stack([mean] * 2), np.stack([inverse] * 2))
    z = np.log1p(language_model.exponentials(x, w))
    p = np.exp(x @ w[:, :-1].T + w[:, -1] - z[:, None])
    assert np.allclose(p.sum(1) + np.exp(-z), 1, atol=1e-5) and p[0, 0] > p[0, 1] and p[3, 1] > p[3, 0]


def test_language_model_score_by_plain_sums(spark):
    """Scores are sums of log10 P(class | two classes before) + log10 P(token | class, class before), with both softmaxes written out over all
    tokens of a class and the unknown one; ids may be any type."""
    import numpy as np

    r = random.Random(9)
    pool = [f"w{i}" for i in range(700)]
    texts = [(f"id{i}" if i else None, " ".join(r.choice(pool[: 1 + int(700 * r.random() ** 2)]) for _ in range(r.randrange(60)))) for i in range(200)]
    texts += [("new", "w1 unseen w2 Unseen also"), ("none", None), ("one", "w699")]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    train = F.coalesce(F.crc32("doc_id") % 7 != 2, F.lit(True)) & ~F.coalesce(F.col("doc_id").isin("new", "none", "one"), F.lit(False))
    got = {x["doc_id"]: x["score"] for x in language_model.score(docs, train).collect()}
    assert len(got) == len(texts)
    vocabulary, model, pairs, fitted, _ = language_model.fit(docs.where(train).select(F.xxhash64("doc_id", "text").alias("k"), "text"))
    table_, near = model.table(), model.near().astype(np.float64)
    of, vector = {}, {}
    for x in language_model.word_lines(pairs, fitted).collect():
        of.setdefault(x["c"], []).append(x["h"])
        vector[x["h"]] = np.array(x["w"])
    assert sum(map(len, of.values())) > 300
    for i, text in texts:
        raw = (text or "").encode()
        hashes, rare, starts = language_model.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        classes, counts = vocabulary.look_up(hashes, rare)
        total, before = 0.0, [0, 0]
        for h, c, n in zip(hashes.view(np.int64).tolist(), classes.tolist(), counts.tolist(), strict=True):
            total += float(table_[before[-1] * vocabulary.size + before[-2], c])
            if n < 0:
                e = {k: np.exp(vector[k][:-1] @ near[before[-1]] + vector[k][-1]) for k in of.get(c, [])}
                total += float(np.log10(e.get(h, 1.0) / (1 + sum(e.values()))))
            before.append(c)
        assert got[i] == pytest.approx(total, abs=1e-3, rel=1e-4), i


def test_language_model_sums_of_runs():
    """Sums of a token don't depend on where batches are cut."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    near = rng.normal(size=(6, 4))
    h = np.sort(rng.integers(0, 40, 300))
    i, n = rng.integers(0, 6, 300), rng.integers(1, 9, 300)
    i[h % 3 == 0] = 2
    whole = pa.table({"c": (h % 5).astype(np.int32), "h": h, "i": i.astype(np.int32), "n": n})
    want = {k: (k % 5, n[h == k].sum(), len(set(i[h == k].tolist())) == 1, (n[h == k, None] * near[i[h == k]]).sum(0)) for k in set(h.tolist())}
    for size in (1, 2, 7, 300):
        got = {}
        for c, k, m, _, single, sums in language_model._runs(whole.to_batches(max_chunksize=size), near):
            for j in range(len(k)):
                assert int(k[j]) not in got
                got[int(k[j])] = (c[j], m[j], single[j], sums[j])
        assert got.keys() == want.keys()
        assert all(got[k][:3] == want[k][:3] and np.allclose(got[k][3], want[k][3]) for k in want)


def test_language_model_keeps_pairs_in_parts(spark, monkeypatch):
    """Pairs of tokens and contexts are whole and lie in one line for each part of the tokens, and scores are the same whether vectors are broadcast or joined."""
    import numpy as np

    r = random.Random(4)
    texts = [(i, " ".join(f"w{int(900 * r.random() ** 2)}" for _ in range(r.randrange(60)))) for i in range(150)] + [(150, "w1 unseen w899 unseen"), (151, None), (151, None)]
    docs, train = table(spark, texts), F.col("doc_id") < 150
    vocabulary, _, pairs, _, _ = language_model.fit(docs.where(train).select(F.xxhash64("doc_id", "text").alias("k"), "text"))
    want = {}
    for i, text in texts[:150]:
        raw = text.encode()
        hashes, rare, starts = language_model.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        classes, counts = vocabulary.look_up(hashes, rare)
        one, _ = language_model.contexts(classes, starts)
        for h, c, j in zip(hashes[counts < 0].tolist(), classes[counts < 0].tolist(), one[counts < 0].tolist(), strict=True):
            want[h, c, j] = want.get((h, c, j), 0) + 1
    assert len(want) > 1000 >= 128 >= pairs.count()
    got, parts = {}, []
    for x in pairs.collect():
        h, c, m, j, n = language_model._unpacked(x["h"], x["c"], x["m"], x["i"], x["n"])
        parts.append(x["part"])
        got |= dict(zip(zip(np.repeat(h, m).tolist(), np.repeat(c, m).tolist(), j.tolist(), strict=True), n.tolist(), strict=True))
    assert got == want and len(set(parts)) == len(parts)

    sums = lambda: sorted(map(tuple, language_model.score(docs, train).collect()))
    whole = sums()
    for known in (40, 0):
        monkeypatch.setattr(language_model, "KNOWN", known)
        few = sums()
        assert [x[:4] for x in few] == [x[:4] for x in whole] and np.allclose([x[4:] for x in few], [x[4:] for x in whole], rtol=1e-5)


def test_language_model_merges_and_finds():
    """Merged pairs don't depend on the order of lines or on where batches are cut; hashes are found at any place; exponentials may be large."""
    import numpy as np

    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    at, i, n = rng.integers(0, 500, 4000), rng.integers(0, 300, 4000), rng.integers(1, 400, 4000)
    want = {}
    for h, j, k in zip(pool[at].tolist(), i.tolist(), n.tolist(), strict=True):
        want[h, j] = want.get((h, j), 0) + k
    for cuts in (1, 9):
        lines = [language_model._packed(*language_model._merged(pool[at[x]], at[x] % 7, i[x], n[x], 300), 16) for x in np.array_split(np.arange(4000), cuts)]
        rows = sorted((tuple(x.values()) for line in lines for x in line.to_pylist()), key=lambda x: x[0])
        for size in (1, 5, 1000):
            batches = [pa_batch(rows[low : low + size]) for low in range(0, len(rows), size)]
            got = {}
            for line in language_model._merge(300, 16)(iter(batches)):
                assert line.num_rows == 1
                h, c, m, j, k = language_model._unpacked(*tuple(line.to_pylist()[0].values())[1:])
                got |= dict(zip(zip(np.repeat(h, m).tolist(), j.tolist(), strict=True), k.tolist(), strict=True))
            assert got == want
    known = np.unique(pool[:200])
    some, place = language_model.Finder(known).find(pool)
    assert set(pool[some].tolist()) == set(known.tolist()) and (known[place] == pool[some]).all()
    assert not len(language_model.Finder(known[:0]).find(pool)[0])
    x, w = rng.normal(size=(5, 3)), rng.normal(size=(40, 4)).astype(np.float32)
    for bias in (0, 90, 300):
        w[:, 3] += np.float32(bias)
        assert np.allclose(np.log(language_model.exponentials(x, w)), np.log(np.exp(x.astype(np.float32) @ w[:, :3].T.astype(np.float64) + w[:, 3]).sum(1)), rtol=1e-5)


def pa_batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), *(pa.array([x[k] for x in rows], pa.binary()) for k in range(1, 6))], ["part", "h", "c", "m", "i", "n"])


def test_log_bilinear_is_normalised():
    import numpy as np

    model = language_model.LogBilinear(np.ones(language_model.CLASSES))
    assert np.allclose((10.0 ** model.table()[:500]).sum(1), 1, atol=1e-3)


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers(spark, operator):
    good = [(i, prose(i, 60)) for i in range(120)]
    bad = [(i, " ".join(f"{w.upper()}!! vile{w[-1]}" for w in prose(i, 30).split())) for i in range(120, 200)]
    docs = table(spark, [*good, *bad, (200, None)])
    mark = (lambda i: int(i < 120)) if operator is quality else (lambda i: int(i >= 120))
    labels = spark.createDataFrame([(i, mark(i), mark(i)) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in operator.score(docs, operator.fit(docs, labels, F.lit(True))).select("row.doc_id", "score").collect()}
    assert len(got) == 201 and all(0 <= s <= 1 for s in got.values())
    hits = sum((got[i] > got[j]) == (mark(i) > mark(j)) for i in range(1, 120, 6) for j in range(121, 200, 6))
    assert hits / len(range(1, 120, 6)) / len(range(121, 200, 6)) > 0.95


def test_empty_tables(spark):
    docs, labels = table(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert substring_dedup.remove_duplicates(docs).count() == 0
    assert near_dedup.near_duplicates(docs).count() == 0
    assert decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert mixing.repetitions(docs).count() == 0
    assert language_id.identify(docs, language_id.fit(docs, F.lit(True))).count() == 0
    assert fingerprints.compare_with_next(docs, fingerprints.lexicon(docs)).count() == 0
    assert licenses.scan(docs).count() == 0
    assert language_model.score(docs, F.lit(True)).count() == 0
    for operator in (quality, toxicity):
        assert operator.score(docs, operator.fit(docs, labels, F.lit(True))).count() == 0
