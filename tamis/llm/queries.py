"""The registered queries of this package: thin uses of its operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .centroids import cluster_vectors, hashed_starts
from .decontaminate import find_contamination
from .fill_in_middle import fill_in_middle, restore
from .language_model import score_texts
from .near_dup import near_duplicates
from .packing import pack
from .pii import BASE, find_pii, fit_pii
from .quality import THRESHOLD, fit_quality, score_quality
from .substring import repeated_windows
from .tables import ORACLE, QUERIES, query, table  # noqa: F401
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files
from .topk import top_k
from .toxicity import fit_toxicity, score_toxicity

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name=TOKENIZER):
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query("op1_topk", """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 20
""")
def topk(spark, sf_dir):
    x = F.col("embedding")
    whole = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    vectors = (table(spark, sf_dir, "embeddings").filter(whole)
               .select("vec_id", F.transform(x, lambda e: F.floor(F.lit(64.0) * e.cast("double"))).alias("vector")))
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20)


@query("op2_substring", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM g WHERE n > 1),
one AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
k AS (SELECT one.doc_id, string_agg(word, ' ' ORDER BY one.i) FILTER (gone.i IS NULL) AS kept, count(gone.i) AS n_removed
      FROM one LEFT JOIN gone ON one.doc_id = gone.doc_id AND one.i = gone.i GROUP BY one.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
""")
def substring(spark, sf_dir):
    return (repeated_windows(table(spark, sf_dir, "documents"), 20)
            .select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")))


@query("op3_toxicity")
def toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.filter(remainder(3) != 1))
    score = F.col("toxicity.score")
    return score_toxicity(docs, model).select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), score.alias("score"),
                                              (score >= 0.7).cast("int").alias("predicted"), "toxicity.sentences")


@query("op4_superminhash", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest([array_to_string(words[i:i + 1], ' ') FOR i IN range(1, greatest(len(words) - 1, 1) + 1)]) AS g
      FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 80 * (na.n + nb.n - n_both)),
r AS (SELECT doc_id, doc_id AS seen FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
""")
def superminhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), 2, 80)


@query("op5_packing")
def packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), 2048, 1).drop("ids")


@query("op6_pii")
def pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, fit_pii(docs)).drop("text")
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))

    def shown(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(of, BASE), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("pii")).alias("spans"))


@query("op7_decontamination", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, unnest([array_to_string(words[i:i + 9], ' ') FOR i IN range(1, greatest(len(words) - 9, 1) + 1)]) AS g
       FROM b WHERE len(words) > 0),
dw AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(words) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def decontamination(spark, sf_dir):
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), 10, with_text=False)
    c = F.col("contamination")
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
                        F.sha2(F.array_join(c["items"], ",").cast("binary"), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"))


@query("op8_token_files")
def token_files(spark, sf_dir):
    path = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), 2)
    return read_token_files(spark, path).drop("ids")


@query("op9_pitman_yor")
def pitman_yor(spark, sf_dir):
    scored = score_texts(table(spark, sf_dir, "documents"), remainder(10) != 0)
    return scored.select("doc_id", F.coalesce(remainder(10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op10_quality")
def quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.filter(remainder(5) != 0))
    return score_quality(docs, model).select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"),
                                             (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op11_token_counts")
def token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.col("n_tokens")
    return (count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
            .select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n, (n > 512).alias("over_limit")))


@query("op12_fill_in_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
r AS (SELECT *, len(u) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS x FROM d),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 100 THEN 'plain'
             WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle,
        coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
""")
def fim(spark, sf_dir):
    cut = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return restore(cut).select("doc_id", F.col("fim.n_lines").alias("n"), "fim.form", "fim.prefix_chars", "fim.middle_chars",
                               sha("fim.output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


CENTROIDS, ROUNDS, DIMENSIONS = 8, 10, 64


def _centroid_sql():
    """A pair of tables per round: the number of each vector's nearest centroid, and the centroids after it."""
    away = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(e, c)])::BIGINT"
    near = "SELECT r, min([{away}, j]) AS m FROM v, c{t} GROUP BY r".replace("{away}", away)
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e,
  sha256('3:' || CAST(vec_id AS VARCHAR)) AS h FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS j, e AS c FROM v ORDER BY h, e LIMIT {CENTROIDS})"]
    for t in range(ROUNDS):
        steps += [f"a{t} AS MATERIALIZED ({near.format(t=t)})", f"""c{t + 1} AS MATERIALIZED (SELECT c{t}.j, coalesce(fresh.c, c{t}.c) AS c FROM c{t} LEFT JOIN
  (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT j, i, sum(x) AS s, count(*) AS n FROM
    (SELECT m[2] AS j, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{t} JOIN v USING (r)) GROUP BY j, i) GROUP BY j) fresh ON fresh.j = c{t}.j)"""]
    return "WITH " + ",\n".join([*steps, f"a{ROUNDS} AS MATERIALIZED ({near.format(t=ROUNDS)})"]) + f"""
SELECT vec_id, CAST(m[2] AS INTEGER) AS cluster, m[1] AS distance, CAST(sum(m[1]) OVER (PARTITION BY m[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(m[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} ON j = m[2]"""


@query("op13_centroids", _centroid_sql())
def centroids(spark, sf_dir):
    x = F.col("embedding")
    whole = (F.size(x) == DIMENSIONS) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    vectors = (table(spark, sf_dir, "embeddings").filter(x.isNotNull() & whole)
               .select("vec_id", F.transform(x, lambda e: F.floor(F.lit(1024.0) * e.cast("double"))).alias("vector")))
    found = cluster_vectors(vectors, hashed_starts(vectors, CENTROIDS, 3), ROUNDS, dimensions=DIMENSIONS)
    of = found.clusters.select("cluster", F.col("inertia").alias("cluster_inertia"), F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256).alias("centroid_sha256"))
    return (found.vectors.join(F.broadcast(of), "cluster")  # a row per centroid
            .select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(found.inertia).cast("long").alias("inertia"), "centroid_sha256"))
