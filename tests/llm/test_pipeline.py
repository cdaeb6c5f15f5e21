"""The corpus pipeline against a brute-force version, and what each operator makes of odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortloom.llm import components, decontaminate, fingerprints, language_id, language_model, licenses, mixing, near_dedup, quality, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k long, epoch int, repeats string, k long, row string"
WORD, PLAIN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"{r.choice('bcdfg')}{r.choice('aeiou')}w{r.randint(0, words)}" for _ in range(n))


def corpus():
    a, shared, leak = prose(1, 150), prose(2, 60), prose(3, 30)
    rows = [(0, a), (1, a), (2, " ".join(a.split()[:-4]) + " xa xb xc"), (3, shared + " " + prose(4, 70)), (4, prose(5, 80) + " " + shared), (5, prose(6, 40) + "\n" + leak + ". " + prose(7, 30))]
    rows += [(6, None), (7, ""), (8, "12 34 !"), (9, "one"), (10, leak), (11, prose(8, 3000)), (12, prose(9, 60)), (12, prose(10, 60)), (13, a)]
    rows += [(20 + i, prose(100 + i, 30 + i)) for i in range(40)]
    return rows, leak


def near(rows, shingle, percent):
    """Rows that stay: the smallest doc_id of each component."""
    words = [WORD.findall(t.translate(LOW)) for _, t in rows]
    sets = [{tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set() for w in words]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    return [rows[i] for i in range(len(rows)) if rows[i][0] == least[root[i]]]


def without_passages(rows, window):
    words, at = [WORD.findall(t) for _, t in rows], Counter()
    for w in words:
        at.update(tuple(w[j : j + window]) for j in range(len(w) - window + 1))
    out = []
    for (d, t), w in zip(rows, words, strict=True):
        gone = {j + o for j in range(len(w) - window + 1) if at[tuple(w[j : j + window])] > 1 for o in range(window)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        if not gone or kept:
            out.append((d, " ".join(kept) if gone else t))
    return out


def without_benchmark(rows, items, size):
    grams = {}
    for item in items:
        w = PLAIN.findall(item.translate(LOW))
        n = min(size, len(w))
        grams.setdefault(n, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for d, t in rows:
        found = list(PLAIN.finditer(t.translate(LOW)))
        hit = {i + o for n, g in grams.items() for i in range(len(found) - n + 1) if tuple(m.group() for m in found[i : i + n]) in g for o in range(n)}
        if len(hit) == len(found) and found:
            continue
        text, at, i = "", 0, 0
        while i < len(found):
            if i in hit:
                j = i
                while j + 1 in hit:
                    j += 1
                text, at, i = text + t[at : found[i].start()], found[j].end(), j
            i += 1
        out.append((d, text + t[at:]))
    return out


def test_pipeline(spark, tmp_path):
    rows, leak = corpus()
    table = spark.createDataFrame([(d, t, "aa", f"s{d % 3}", len(t or ""), 7, 9, "r", 1, "x") for d, t in rows], SCHEMA)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]
    want = without_benchmark(without_passages(list(dict.fromkeys(near(want, 5, 80))), 35), [leak], 10)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out[0].asDict().keys() == {*table.columns, "epoch_"} and {(r["_k"], r["epoch"], r["repeats"], r["k"], r["row"]) for r in out} == {(7, 9, "r", 1, "x")}
    often = Counter((r["doc_id"], r["text"]) for r in out)
    assert set(often) <= set(want) and max(often.values()) <= 2
    size = {x: len(WORD.findall(x[1])) for x in want}
    total, taken = sum(size.values()), sum(n * size[x] for x, n in often.items())
    assert taken == pytest.approx(1.5 * total, rel=0.05)
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_stages_keep_columns_and_handle_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == SCHEMA.replace(",", "").split()[::2]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_rejection_without_languages_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "12"), (3, None)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert [r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()] == [1]


def test_language_scores_equal_the_kernel(spark):
    """Scores by the matrix of n-grams are those of the kernels with the landmarks, computed one by one."""
    texts = [prose(i, 20, 30).upper() if i % 2 else " ".join(f"{i % 7}xyz"[j % 4 :] for j in range(20)) for i in range(30)]
    langs = ["ab"[i % 2] for i in range(30)]
    model = language_id.Model(texts, langs)

    def kernel(a, b):
        grams = lambda t, n: {t.lower().encode()[i : i + n] for i in range(len(t.encode()) - n + 1)}
        return sum(len(grams(a, n) & grams(b, n)) / max(1, len(grams(a, n)) * len(grams(b, n))) ** 0.5 for n in (1, 2, 3)) / 3

    marks = [t for t in texts]  # fewer than LANDMARKS of each language
    k = np.array([[kernel(a, b) for b in marks] for a in texts])
    values, vectors = np.linalg.eigh(k)
    good = values > 1e-8 * values.max()
    z = k @ (vectors[:, good] / np.sqrt(values[good]))
    y = 2.0 * (np.array(langs)[:, None] == np.array(model.langs)) - 1
    zc, yc = z - z.mean(0), y - y.mean(0)
    want = zc @ np.linalg.solve(zc.T @ zc + language_id.RIDGE * len(texts) * np.eye(z.shape[1]), zc.T @ yc) + y.mean(0)
    raw = [t.encode() for t in texts]
    got = model.scores(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    assert np.abs(got - want).max() < 0.02 and (got.argmax(1) == want.argmax(1)).all()


def test_fingerprints_by_hand(spark):
    """Terms in the band, as distinct sets: texts of equal sets have equal fingerprints, and likeness follows the share of equal subsets."""
    rows = [(i, " ".join(f"t{(i * 7 + j) % 40}" for j in range(12))) for i in range(60)]
    rows += [(100, rows[0][1]), (101, " ".join(reversed(rows[0][1].split()))), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = fingerprints.lexicon(docs, 0.05, 0.9)
    share = Counter(x for _, t in rows for x in set((t or "").split()))
    inside = {x for x, n in share.items() if 0.05 * len(rows) <= n <= 0.9 * len(rows)}
    assert len(terms.terms) == len(inside)
    out = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs, terms, 3).collect()}
    assert dict(fingerprints.compare_with_next(docs, terms, 3).dtypes)["fingerprint"] == "string"
    assert out[0]["fingerprint"] == out[100]["fingerprint"] == out[101]["fingerprint"] != out[1]["fingerprint"]
    assert int(out[102]["fingerprint"], 16) == 0 and out[101]["near_next"] == 1.0
    raw = lambda s: np.array([[int(s[i : i + 8], 16) for i in range(0, len(s), 8)]])
    for d, after in ((5, 4), (0, 102)):
        x, y = raw(out[d]["fingerprint"]), raw(out[after if after in out else 102]["fingerprint"])
        assert out[d]["near_next"] == pytest.approx(float(fingerprints.likeness(x, y)[0]))
    assert raw(out[5]["fingerprint"])[0, 0] == len(set(rows[5][1].split()) & inside)


def test_licenses_against_brute_force(spark):
    """Containment of a template's shingles around each place where one of them occurs."""
    r = random.Random(4)
    rows = []
    for i in range(60):
        words = prose(i, 40).split()
        template = r.choice(list(licenses.TEMPLATES.values())).split()
        if i % 3:
            if i % 5 == 0:
                template[r.randrange(len(template))] = "changed"
            at = r.randrange(40)
            words[at:at] = template
        rows.append((i, " ".join(words)))
    split = lambda t: [w for w in re.split(r"[^\w]+", t.lower().replace("_", " ")) if w]
    want = set()
    for d, t in rows:
        pairs = set(zip(split(t), split(t)[1:], strict=False))
        for name, template in licenses.TEMPLATES.items():
            own = set(zip(split(template), split(template)[1:], strict=False))
            if len(own & pairs) / len(own) >= 0.8:
                want.add((d, name))
    got = {(x["doc_id"], x["license"]) for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_odd_rows_in_every_operator(spark):
    """Null ids and texts, a very long text, repeated rows and clashing names: one row each, and no crash."""
    rows = [(1, prose(1, 20_000)), (2, prose(2, 50)), (2, prose(2, 50)), (None, prose(3, 50)), (None, None), (3, ""), (4, None), *((10 + i, prose(20 + i, 40)) for i in range(12))]
    docs = spark.createDataFrame([(d, t, "aa" if (d or 0) % 2 else "bb", "s", len(t or ""), 7, 9, "r", 1, "x") for d, t in rows], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(10, 22)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    n = len(rows)
    assert substring_dedup.remove_duplicates(docs).count() == n
    assert language_id.identify(docs, language_id.fit(docs, F.lit(True))).count() == n
    assert fingerprints.compare_with_next(docs, fingerprints.lexicon(docs)).count() == n
    assert near_dedup.near_duplicates(docs).count() == n
    assert licenses.scan(docs).count() == 0
    assert mixing.repetitions(docs).count() == n and "epoch_" in mixing.mixture(docs).columns
    assert decontaminate.decontaminate(docs, bench).count() == n
    assert language_model.score(docs, F.lit(True)).count() == n
    for operator in (quality, toxicity):
        scored = operator.score(docs, operator.fit(docs, labels, F.lit(True))).collect()
        assert len(scored) == n and all(0 <= r["score"] <= 1 for r in scored)
        assert len({r["score"] for r in scored if r["row"]["doc_id"] == 2}) == 1


def test_near_duplicates_by_blocks(spark, monkeypatch):
    """With small lists and blocks every way of comparing classes runs: results are those of brute force."""
    for name, value in (("SMALL", 2), ("BLOCK", 4), ("FEW", 2)):
        monkeypatch.setattr(near_dedup, name, value)
    r, base, rows = random.Random(8), prose(1, 60).split(), []
    for i in range(70):
        words = list(base if i % 2 else prose(500 + i % 6, 60).split())
        for _ in range(r.randint(0, 5)):
            words[r.randrange(60)] = f"n{r.randint(0, 99)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in near_dedup.near_duplicates(docs, 2, 80).where("kept").collect()}
    assert got == {d for d, _ in near(rows, 2, 80)}
    assert components.components(spark.createDataFrame([(5, 4), (4, 9), (1, 2)], "u long, v long")).count() == 5


def test_components(spark, monkeypatch):
    """Against a plain union-find, where one partition is left after contraction and where rounds follow; a path, a star around its largest node, copies, loops, none."""
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(90, i) for i in range(60, 70)] + [(1, 2), (2, 1), (1, 2), (7, 7)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    r.shuffle(edges)
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for u, v in edges:
        if u != v and root[u] != root[v]:
            low, high = sorted((root[u], root[v]))
            root = {x: low if y == high else y for x, y in root.items()}
    for most in (200_000, 10):
        monkeypatch.setattr(components, "EDGES", most)
        got = components.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()
        assert sorted(map(tuple, got)) == sorted(root.items())
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_prior_from_counts():
    p, u = np.zeros(100), np.zeros(100)
    p[80:], u[80:], u[:80] = 50, 25, 25 / 4 * 3
    assert quality.estimate_prior(p, u) == pytest.approx(0.25, abs=0.03)
