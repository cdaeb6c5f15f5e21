"""Registered queries of the text operators: whole tables, production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, language_id, language_model, licenses, merkle, periods, quality, secret_scan, toxicity
from ._text import documents
from .decontaminate import decontaminate
from .mixing import repetitions
from .near_dedup import near_duplicates
from .substring_dedup import remove_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_duplicates(documents(spark, sf_dir), window=35).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


SQL["op1_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM dup),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=2, percent=80).drop("k")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op4_near_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n AS a ON a.doc_id = u JOIN n AS b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS c FROM r GROUP BY u) AS m USING (doc_id)
"""


def _fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs, _fold(4) != 2)
    return language_id.identify(docs, model).select("row.doc_id", "lang_pred", "score").select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetitions(documents(spark, sf_dir), weights=(3, 1, 2), epochs_total=1.5, max_epochs=2.0).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)
    return marked.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL["op7_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
x AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, n FROM x JOIN g USING (n, g)),
k AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return fingerprints.compare_with_next(docs, fingerprints.lexicon(docs))


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).select("doc_id", "license", F.round("containment", 6).alias("containment"))


@query
def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score(documents(spark, sf_dir), _fold(7) != 2)
    return scored.select("doc_id", (_fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality.score(docs, quality.fit(docs, _labels(spark, sf_dir), _fold(5) != 0)).select("row.doc_id", "score")
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.fit(docs, _labels(spark, sf_dir), _fold(4) != 2)).select("row.doc_id", "score")
    return scored.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return merkle.manifest(docs, lowered).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text as DuckDB SQL, over `crc` (a row with t, the table of 256 values)."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


_CRC = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) AS t)"


def _field(c: str, text: str | None = None) -> str:
    value = f"CAST({text or c} AS VARCHAR)"
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} || {_field('text', text)})"


def _upwards(name: str, levels: int) -> str:
    """CTEs name1, name2, ... of (tree, i, d, n) above name0; a tree of one node stays as it is. SQL has no loop over them that keeps siblings: `levels` are written out."""
    return ", ".join(f"{name}{k} AS (SELECT tree, i // 16 AS i, CASE WHEN max(n) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (max(n) + 15) // 16 AS n FROM {name}{k - 1} GROUP BY tree, i // 16)" for k in range(1, levels + 1))


def _sibling(name: str, k: int) -> str:
    """(tree, i, a, b, up) of level k: what is left and right of a node in its run, and whether there is a level above."""
    return f"(SELECT tree, i, n > 1 AS up, coalesce(string_agg(d, '' ORDER BY i) OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(d, '' ORDER BY i) OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {name}{k})"


def _merkle(own: int = 6, roots: int = 4) -> str:
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    at, joins, folds = "x.d2", "", []
    for name, count, tree, i in (("s", own, "x.tree", "x.i"), ("r", roots, "''", "q.i")):
        for k in range(count):
            joins += f" JOIN {_sibling(name, k)} AS {name}s{k} ON {name}s{k}.tree = {tree} AND {name}s{k}.i = {i} // {16 ** k}"
            folds.append(f"{name}s{k}")
    proof = " || ".join(f"CASE WHEN {f}.up THEN {f}.a || {f}.b ELSE '' END" for f in folds)
    chain, last = "", "f"
    for j, f in enumerate(folds):
        chain += f", f{j + 1} AS (SELECT * EXCLUDE (h), CASE WHEN up{j} THEN sha256(a{j} || h || b{j}) ELSE h END AS h FROM f{j})"
        last = f"f{j + 1}"
    carried = ", ".join(f"{f}.up AS up{j}, {f}.a AS a{j}, {f}.b AS b{j}" for j, f in enumerate(folds))
    return f"""WITH {_CRC}, leaves AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS d, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_leaf(lowered)} END AS d2 FROM documents CROSS JOIN crc),
s0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i, d, count(*) OVER (PARTITION BY tree) AS n, doc_id, coalesce(d2, d) AS d2 FROM leaves), {_upwards('s', own)},
r0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, d, count(*) OVER () AS n, tree AS name FROM s{own}), {_upwards('r', roots)},
f0 AS (SELECT x.doc_id, x.d AS leaf, q.d AS subroot, (SELECT d FROM r{roots}) AS root, sha256({proof}) AS proof_sha256, {at} AS h, {carried} FROM s0 AS x JOIN r0 AS q ON q.name = x.tree{joins}){chain}
SELECT doc_id, leaf, subroot, root, proof_sha256, h AS folded_root, h = root AS verified FROM {last}"""


#: Written out for up to 16 ** 6 rows of a source and 16 ** 4 sources.
SQL["op12_merkle_manifest"] = _merkle()


WORD = r"[^\x20\x09-\x0D]+"


def _repeating(h: Column) -> Column:
    """The text of a document with the hash h, one in ten of them with a stretch that repeats its beginning up to the end."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    g, n = F.floor(h / 10), F.size(words)
    first = (g % F.greatest(n, F.lit(1))).cast("int")
    period = (F.floor((n - first) / (g % 8 + 3)) + 1).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, first + 1, period), F.ceil((n - first) / period).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), first), F.slice(again, F.lit(1), n - first)), " ")).otherwise(F.col("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", _repeating(F.crc32(F.col("doc_id").cast("string"))).alias("text"))
    found = periods.periodic_runs(docs)
    every = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    exponent = F.expr("1000 * best.length div best.period")
    return found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), F.sha2(every, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))


#: Words are put by their numbers within a document; equal words at most a quarter of its length apart are paired, and consecutive pairs of one distance make a stretch.
SQL["op13_periodic_runs"] = rf"""
WITH {_CRC}, d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, {_crc32('CAST(doc_id AS VARCHAR)')} AS h FROM documents CROSS JOIN crc),
e AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS m FROM d),
o AS (SELECT doc_id, row_number() OVER () AS k, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // m) END]) ELSE w END AS w FROM e),
t AS (SELECT k, n, unnest(w) AS x, unnest(range(n)) AS i FROM o), p AS (SELECT a.k, a.i, b.i - a.i AS q FROM t AS a JOIN t AS b ON a.k = b.k AND a.x = b.x AND b.i > a.i WHERE 4 * (b.i - a.i) <= a.n),
s AS (SELECT k, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS g FROM p) GROUP BY k, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM s ANTI JOIN s AS z ON z.k = s.k AND z.q < s.q AND z.s <= s.s AND z.s + z.l >= s.s + s.l),
gone AS (SELECT DISTINCT k, unnest(range(s + q, s + l)) AS i FROM r), kept AS (SELECT k, string_agg(x, ' ' ORDER BY i) AS x FROM t ANTI JOIN gone USING (k, i) GROUP BY k),
c AS (SELECT k, count(*) AS c, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS x FROM r GROUP BY k),
b AS (SELECT k, s, l, q FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) = 1)
SELECT doc_id, coalesce(c, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli, sha256(coalesce(c.x, '')) AS runs_sha256, sha256(coalesce(kept.x, '')) AS collapsed_sha256
FROM o LEFT JOIN c USING (k) LEFT JOIN b USING (k) LEFT JOIN kept USING (k)
"""


@query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["via"] == "")
    count = lambda kind: F.size(F.filter("spans", lambda s: (s["via"] == "") & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("row.doc_id", *(count(k) for k in secret_scan.KINDS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), "n_layers", "n_unopened")
