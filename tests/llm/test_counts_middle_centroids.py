"""Token counts, fill-in-the-middle and centroid clustering against plain readings of their contracts."""

import hashlib
import random
import re

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamis.llm import fill_in_middle as fim
from tamis.llm.centroids import LARGEST, assign, cluster_vectors, hashed_starts
from tamis.llm.fill_in_middle import fill_in_middle, restore
from tamis.llm.queries import QUERIES, tokenizer_path
from tamis.llm.token_counts import Counter, count_tokens, safe_places, splits_at_spaces

BYTES = "byte_bpe_50k.json"


def library(name=BYTES):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def content(name=BYTES):
    with open(tokenizer_path(name), "rb") as f:
        return f.read()


# --- 11 token counts ------------------------------------------------------------------

def counts(texts, lib):
    return [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]


def odd_texts(n=400):
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "1", "'s", "'", ".", "é", "ñ ", "漢", "😀 ", " ", " ", "　 ", "\u0085", "<|endoftext|>", "<|end", "\r\n"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 150))) for _ in range(n)] + [None, "", " ", "x" * 3000, "<|endoftext|>" * 3]


@pytest.mark.parametrize("stretch", [4, 32, 1 << 20])
def test_counts_do_not_depend_on_the_cuts(stretch):
    texts = odd_texts()
    assert Counter(content(), stretch, 16).count(pa.array(texts)).tolist() == counts(texts, library())


def test_counts_forget_and_learn_again(monkeypatch):
    monkeypatch.setattr("tamis.llm.token_counts.REMEMBERED", 50)
    texts, count = odd_texts(60), Counter(content(), 64, 64)
    want = counts(texts, library())
    assert [int(count.count(pa.array([t]))[0]) for t in texts] == want and len(count.known) <= 50 + 150


def test_no_cut_beside_other_white_space():
    for text in ("a  b", "a　 b", "a  b", "a\u0085 b", "a\t b", "  ", " a"):
        assert not len(safe_places(np.frombuffer(text.encode(), np.uint8)))
    assert safe_places(np.frombuffer("é b 漢 c".encode(), np.uint8)).tolist() == [2, 4, 8]


def test_counts_of_other_tokenizers(odd, odd_rows):
    assert not splits_at_spaces({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}, "model": {"type": "BPE"}})
    got = sorted((r["doc_id"], r["n"]) for r in count_tokens(odd.filter("doc_id IS NOT NULL"), tokenizer_path("word_bpe_49k.json"), name="n").collect())
    assert got == sorted(zip([i for i, _ in odd_rows], counts([t for _, t in odd_rows], library("word_bpe_49k.json"))))
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = sorted((r["doc_id"], r["n"]) for r in count_tokens(odd.filter("doc_id IS NOT NULL"), tokenizer_path("piece_bpe_32k.model"), name="n").collect())
    assert got == sorted((i, len(model.encode(t or ""))) for i, t in odd_rows)


def test_counts_keep_rows_and_columns(odd, odd_rows, nothing):
    got = count_tokens(odd, tokenizer_path(BYTES), name="n_words")  # a column of that name is replaced, the others stay
    assert set(got.columns) == set(odd.columns) and got.count() == odd.count()
    found = sorted((r["doc_id"], r["n_words"]) for r in got.filter("doc_id IS NOT NULL").collect())
    assert found == sorted(zip([i for i, _ in odd_rows], counts([t for _, t in odd_rows], library())))
    assert count_tokens(nothing, tokenizer_path(BYTES)).collect() == []


def test_counts_query(spark, sf, doc_rows):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op11_token_counts"](spark, sf).collect()}
    want = {i: (len((t or "").encode()), n, n > 512) for (i, t), n in zip(doc_rows, counts([t for _, t in doc_rows], library()))}
    assert got == want and {v[2] for v in want.values()} == {True, False}


# --- 12 fill in the middle --------------------------------------------------------------

def middle(doc_id, text, seed=7, rate=100, spm=50):
    """(n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def lines_of(n=300):
    rng = random.Random(3)
    parts = ["a", "\n", "\n\n", "é", "😀", "<", "<P", "S>", "M>", ">", "words and words ", "\r\n", "漢\n"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(n)]
    return rows + [(n, "<M>"), (n + 1, "a<S>\nb"), (n + 2, None), (n + 3, "\n"), (n + 4, "x\n" * 5000), (None, "a\nb\nc\n"), (5, "a\nb\n"), (5, "a\nb\n")]


@pytest.mark.parametrize("stretch, batch", [(7, 50), (1 << 20, 1 << 22)])
def test_middle_at_any_stretch(stretch, batch, monkeypatch):
    monkeypatch.setattr(fim, "STRETCH", stretch)
    rows = lines_of()
    digests = [hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest() for i, _ in rows]
    draws = [pa.array([int(d[8 * k:8 * k + 8], 16) for d in digests]) for k in range(4)]
    out = fim._cut_batch(pa.array([t for _, t in rows]), draws, 100, 50)
    got = [(r["n_lines"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out.to_pylist()]
    assert got == [middle(i, t) for i, t in rows] and {g[1] for g in got} == {"plain", "psm", "spm"}
    data, at = fim.text_bytes(out.field("output"))
    back, bounds = fim.gather(data, at, np.array([fim.FORMS.index(g[1]) for g in got]))
    assert fim._strings(back, bounds).to_pylist() == [t or "" for _, t in rows]


def test_middle_in_a_table(spark, odd, nothing):
    rows = lines_of()
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, form string").repartition(3)
    for rate, spm in ((100, 50), (60, 0), (0, 50)):
        got = restore(fill_in_middle(docs, 3, rate, spm)).collect()
        assert sorted(((r["doc_id"], r["text"], r["form"], *[r["fim"][c] for c in ("n_lines", "form", "prefix_chars", "middle_chars", "output")]) for r in got), key=repr) == \
            sorted(((i, t, "k", *middle(i, t, 3, rate, spm)) for i, t in rows), key=repr)
        assert all(r["restored"] == (r["text"] or "") for r in got)
    assert restore(fill_in_middle(nothing)).collect() == []
    kept = restore(fill_in_middle(odd, name="kept"), "kept.output", "kept.form")
    assert set(kept.columns) == {*odd.columns, "restored"}
    assert all(r["restored"] == (r["text"] or "") for r in kept.collect())


def test_middle_refuses_lost_marks(spark):
    broken = spark.createDataFrame([("<P>a<S>b", "psm")], "output string, form string")
    with pytest.raises(Exception, match="marks of its form"):
        restore(broken, "output", "form").collect()


# --- 13 centroids ------------------------------------------------------------------------

def lloyd(rows, starts, rounds):
    """{row index: (cluster, distance)}, centroids."""
    centroids = [list(c) for c in starts]

    def near():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)) for _, x in rows]

    for _ in range(rounds):
        own = near()
        for j in range(len(centroids)):
            if members := [x for (_, x), (_, k) in zip(rows, own) if k == j]:
                centroids[j] = [sum(c) // len(members) for c in zip(*members)]
    return [(i, j, away) for (i, _), (away, j) in zip(rows, near())], centroids


def points(seed, n=400, d=6):
    rng = np.random.default_rng(seed)
    heart = rng.integers(-400, 400, (7, d))
    rows = [(i, [int(c) for c in heart[i % 7] + rng.integers(-150, 150, d)]) for i in range(n)]
    return rows + [(3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (n, [0] * d), (n + 1, [0] * d)]


@pytest.mark.parametrize("seed", [0, 1])
def test_centroids_as_by_hand(spark, seed, monkeypatch):
    monkeypatch.setattr("tamis.llm.centroids.BLOCK_NUMBERS", 700)  # many blocks
    rows = points(seed)
    bad = [(900, None), (901, [1, None, 1, 1, 1, 1]), (902, [1, 2]), (903, [])]
    df = spark.createDataFrame([(i, x, 5) for i, x in rows + bad], "vec_id long, vector array<long>, cluster int").repartition(3)
    starts = [rows[k][1] for k in (0, 1, 2, 7, 14, 0)] + [[5000] * 6]  # equal ones, and one that stays empty
    found = cluster_vectors(df, starts, 9)
    want, centroids = lloyd(rows, starts, 9)
    assert sorted(map(tuple, found.vectors.collect()), key=repr) == sorted(want, key=repr)
    of = {r["cluster"]: r for r in found.clusters.collect()}
    assert [list(of[j]["centroid"]) for j in range(7)] == centroids
    assert {j: (r["n"], r["inertia"]) for j, r in of.items()} == {j: (sum(w[1] == j for w in want), sum(w[2] for w in want if w[1] == j)) for j in range(7)}
    assert found.inertia == sum(w[2] for w in want)
    assert found.evaluated[0] == len(rows) * 7 and sum(found.evaluated[5:]) < 0.5 * 7 * len(rows) * len(found.evaluated[5:])  # bounds spare most


def test_bounds_of_the_total_displacement():
    """A centroid that goes away and comes back loosens no bound: nothing is evaluated anew."""
    rng = np.random.default_rng(2)
    x = rng.integers(-100, 100, (50, 4))
    a, b = np.array([[0] * 4, [3000] * 4]), np.array([[900] * 4, [3000] * 4])
    distance, seen = np.zeros((50, 2)), np.zeros((50, 2), "<i4")
    cluster, n = assign(x, np.array([a]), np.zeros(50, int), distance, seen)
    assert n == 100 and (cluster == 0).all()
    _, n = assign(x, np.array([a, b, a]), cluster, distance, seen)
    assert n == 0


def test_centroids_of_nothing_little_and_too_much(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "vec_id long, vector array<long>")
    none = df.limit(0)
    assert hashed_starts(none, 8, 3) == [] and cluster_vectors(none, []).vectors.collect() == []
    assert cluster_vectors(none, [[1, 2]]).vectors.collect() == []
    starts = hashed_starts(df, 8, 3)
    assert starts == [x for _, x in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in ((1, [1, 2]), (2, [3, 4])))]
    assert {r["distance"] for r in cluster_vectors(df, starts).vectors.collect()} == {0}
    with pytest.raises(Exception, match="beyond"):
        cluster_vectors(spark.createDataFrame([(1, [LARGEST + 1])], "vec_id long, vector array<long>"), [[0]]).vectors.collect()


def test_centroids_delete_their_rounds(spark):
    import glob

    before = set(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/tamis-llm/centroids-*"))
    rows = points(4, 60)
    found = cluster_vectors(spark.createDataFrame(rows, "vec_id long, vector array<long>"), [r[1] for r in rows[:3]], 4)
    fresh = set(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/tamis-llm/centroids-*")) - before
    assert len(fresh) == 1 and len(glob.glob(fresh.pop() + "/*")) == 1 and found.vectors.count() == len(rows)
