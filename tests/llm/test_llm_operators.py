"""Each operator against a plain reading of its contract, on odd rows, on nothing, and on a small table."""

import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamis.llm import language_model
from tamis.llm.decontaminate import decontaminate, find_contamination
from tamis.llm.language_model import score_texts
from tamis.llm.near_dup import _compared, components, drop_near_duplicates, near_duplicates, super_minhash
from tamis.llm.packing import fill, pack, pack_lengths
from tamis.llm.pii import KINDS, find_pii, fit_pii, redact
from tamis.llm.quality import fit_quality, score_quality
from tamis.llm.queries import QUERIES, remainder, tokenizer_path
from tamis.llm.substring import COVER, PERIOD, repeated_windows
from tamis.llm.token_files import LEAST, compress, decode_document, expand, read_token_files, write_token_files
from tamis.llm.tokens import Encoder, read_tokenizer
from tamis.llm.topk import top_k
from tamis.llm.toxicity import fit_toxicity, score_toxicity


# --- 1 top-k ------------------------------------------------------------------------

def best(vectors, queries, k):
    out = []
    for q, x in queries:
        scored = sorted(((sum(a * b for a, b in zip(x, y)), i) for i, y in vectors if i != q), key=lambda s: (-s[0], s[1]))[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_topk_ties_nulls_ragged_and_repeated(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [int(v) for v in rng.integers(-3, 4, 20)]) for i in range(300)] + [(7, [1] * 20), (301, [1, 2]), (302, [])]
    bad = [(303, None), (304, [1, None]), (None, [1] * 20)]
    base = spark.createDataFrame(rows + bad, "vec_id long, vector array<long>")
    got = top_k(base, base.filter("vec_id % 50 = 0"), 5).collect()
    assert sorted(tuple(r) for r in got) == best(rows, [r for r in rows if r[0] % 50 == 0], 5)
    assert top_k(base.limit(0), base.limit(0), 5).collect() == []
    few = base.filter("vec_id IN (1, 2)")
    assert len(top_k(few, few, 20).collect()) == 2


def test_topk_large_numbers_stay_exact(spark):
    rows = [(i, [2 ** 27 + i, 2 ** 27 - i, i]) for i in range(40)]
    base = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    assert sorted(tuple(r) for r in top_k(base, base.filter("vec_id < 3"), 4).collect()) == best(rows, rows[:3], 4)


# --- 2 substrings ---------------------------------------------------------------------

def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_substrings(odd, odd_rows, nothing):
    got = sorted(tuple(r) for r in repeated_windows(odd).filter("doc_id IS NOT NULL").collect())
    assert got == sorted((i, *x) for (i, _), x in zip(odd_rows, brute.kept_words(odd_rows)))
    assert repeated_windows(odd).count() == odd.count() and repeated_windows(nothing).collect() == []


# --- 3 toxicity, 10 quality -------------------------------------------------------------

@pytest.mark.parametrize("label,fit,score,column", [("toxic", fit_toxicity, score_toxicity, "toxicity"), ("quality", fit_quality, score_quality, "quality_score")])
def test_classifiers(spark, odd, nothing, label, fit, score, column):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit(docs, labels.filter(remainder(3) != 1))
    value = F.col("s.score") if label == "toxic" else F.col("s")
    rows = score(docs, model, name="s").join(labels.filter(remainder(3) == 1), "doc_id").select(label, value.alias("s")).collect()
    good = np.mean([(r["s"] >= 0.5) == (r[label] == 1) for r in rows])
    assert good > 0.93, good  # held out
    out = score(odd, model)  # replaces the text column of that name
    assert out.count() == odd.count() and set(out.columns) == set(odd.columns)
    of = out.select((F.col(f"{column}.score") if label == "toxic" else F.col(column)).alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in of)
    assert score(nothing, model).collect() == []
    for none in (labels.limit(0), labels.filter(f"{label} = 1")):
        constant = fit(docs, none)
        assert len({r[0] for r in score(docs, constant, name="s").select(value).collect()}) == 1


def test_offending_sentence_is_located(spark, odd):
    sf = "/root/testdata/sf0.01"
    model = fit_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    row = score_toxicity(odd.filter("doc_id = 14"), model, name="s").first()
    assert [row["text"][s["start"]:s["end"]].strip() for s in row["s"]["sentences"]] == ["You idiot!"]


# --- 4 near-duplicates -------------------------------------------------------------------

def test_super_minhash_estimates_and_fills_small_sets():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 2 ** 63, 700, dtype=np.int64).view(np.uint64)
    s = super_minhash(np.concatenate([ids[:600], ids[100:]]), np.array([0, 600, 1200]), 200)
    assert abs((s[0] == s[1]).mean() - 500 / 700) < 0.12
    one = super_minhash(ids[:1], np.array([0, 1, 1]), 200)
    assert sorted((one[0] >> np.uint64(48)).tolist()) == list(range(200)) and (one[1] == ~np.uint64(0)).all()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (100, 60), (7, 7)], "a long, b long")
    assert {(r[0], r[1]) for r in components(edges).collect()} == {(i, 0) for i in range(1, 41)} | {(60, 50), (100, 50)}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(odd, odd_rows, nothing, docs, doc_rows, k):
    for df, rows in ((odd, odd_rows), (docs, doc_rows)):
        want, sets = brute.component_ids(rows, k), {i: len(brute.shingles(t, k)) for i, t in rows}
        got = near_duplicates(df, k).filter("doc_id IS NOT NULL").collect()
        assert sorted(tuple(r) for r in got) == sorted((i, sets[i], want[i], want[i] == i) for i, _ in rows)
    assert near_duplicates(nothing, k).collect() == []


def test_a_group_without_a_centre_is_found(spark):
    """A chain of texts, each alike to the next only, shares buckets with unlike ones."""
    words = [f"t{i}" for i in range(260)]
    rows = [(i, " ".join(words[4 * i:4 * i + 100])) for i in range(40)] + [(100 + i, " ".join(words[:60] + [f"u{i}-{j}" for j in range(40)])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(df, 2).collect()} == brute.component_ids(rows, 2)
    assert drop_near_duplicates(df, 2).columns == df.columns


def test_alike_sets_are_compared_though_their_signatures_differ_more(spark):
    """A pair of similarity 0.8 whose signatures agree in 130 of 200 places, as chance has it now and then."""
    x, places = np.arange(90, dtype="<u8"), np.arange(200, dtype=np.uint8)
    other = np.where(np.arange(200) < 130, places, places + 100).astype(np.uint8)
    store = spark.createDataFrame([(1, 90, bytearray(places.tobytes()), bytearray(x.tobytes())), (2, 90, bytearray(other.tobytes()), bytearray((x + 10).astype("<u8").tobytes()))],
                                  "rep long, n long, places binary, shingles binary")
    of = lambda i: spark.createDataFrame([(7, i, i)], "key long, rep long, component long")
    assert [tuple(r) for r in _compared(of(2), of(1), store, 80).collect()] == [(2, 1)]


# --- 5 packing ---------------------------------------------------------------------------

def test_fill_is_the_best_subset_sum():
    rng = np.random.default_rng(5)
    for _ in range(60):
        items = rng.integers(1, 40, 8).tolist()
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        counts = {x: items.count(x) for x in items}
        used = fill(70, counts)
        assert all(n <= counts[x] for x, n in used.items()) and sum(x * n for x, n in used.items()) == max(s for s in sums if s <= 70)
    plan = pack_lengths({5: 7, 3: 4}, 8)
    assert sum(len(p) * t for p, t in plan) == 11 and all(sum(p) <= 8 for p, _ in plan)


def test_packing_holds_each_id_once(odd, nothing, docs):
    encoder = Encoder(read_tokenizer(tokenizer_path()))
    for df in (odd, docs):
        rows = pack(df, tokenizer_path(), 2048, 1, with_ids=True).collect()
        by_sequence, by_doc = {}, {}
        for r in rows:
            by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            by_doc.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
            assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        for pieces in by_sequence.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 2048
        for d in df.select("doc_id", "text").dropDuplicates(["doc_id"]).collect():
            want = np.append(encoder.whole(d["text"] or ""), 1).astype("<u4").tobytes()
            got = b"".join(x for _, x in sorted(set(by_doc[d["doc_id"]])))
            assert got == want
        tokens = sum(r["length"] for r in rows)
        assert len(by_sequence) <= tokens // 2048 + 8
    assert pack(nothing, tokenizer_path()).collect() == []


# --- 6 personal data -------------------------------------------------------------------------

def test_pii(odd, odd_rows, nothing, docs, doc_rows):
    for df, rows in ((odd, odd_rows), (docs, doc_rows)):
        got = find_pii(df, name="spans").filter("doc_id IS NOT NULL").select("doc_id", "spans").collect()
        base = sorted((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in brute.PII]) for r in got)
        assert base == sorted((i, brute.base_spans(t)) for i, t in rows)
        assert {s["kind"] for r in got for s in r["spans"]} <= set(KINDS)
    assert find_pii(nothing).collect() == [] and fit_pii(nothing).accuracy == {}


def test_redaction(odd):
    rows = {r["doc_id"]: r for r in redact(odd).collect()}
    assert rows[12]["text"].startswith("Mail [EMAIL][EMAIL] or [IP].[IP], [CARD] and [PHONE]. 😀 é")
    assert rows[14]["text"] == "password=[SECRET]. You idiot! Fine." and rows[3]["text"] is None and rows[1]["toxicity"] == "toxicity"
    assert list(redact(odd).columns) == odd.columns


def test_overlapping_spans_are_cut_whole(spark):
    rows = [(1, "Call +1 555 123 4567-john.smith@example.com now, a@b.cc"), (2, "4111 1111-1111 1111.doe@example.com, x")]
    out = redact(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["Call [PHONE] now, [EMAIL]", "[CARD], x"]


# --- 7 decontamination ------------------------------------------------------------------------

@pytest.mark.parametrize("max_entries", [1_000_000, 0])
def test_decontamination_beside_columns_of_any_name_and_type(spark, odd_rows, max_entries):
    """Columns named like the operator's own, a map, and rows that differ in those alone."""
    bench = spark.createDataFrame([("i1", brute.words(odd_rows[0][1]) and " ".join(brute.words(odd_rows[0][1])[5:25]))], "item_id string, text string")
    rows = [(i, t, {"k": i}, i % 2, "h", f"key{k}") for i, t in odd_rows for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row map<string,long>, __row long, __hits string, __text_key string").repartition(4)
    want = {i: hit for (i, _), (_, hit, _) in zip(odd_rows, brute.benchmark_hits(odd_rows, [("i1", bench.first()["text"])]))}
    got = find_contamination(df, bench, max_entries=max_entries).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["contamination"]["n_hit"] for r in got} == want and any(want.values())
    assert sorted((r["doc_id"], r["row"]["k"], r["__row"], r["__text_key"]) for r in got) == sorted((i, m["k"], x, k) for i, _, m, x, _, k in rows)


@pytest.mark.parametrize("max_entries", [1_000_000, 2])
def test_decontamination(spark, odd, odd_rows, nothing, docs, doc_rows, sf, max_entries):
    items = spark.createDataFrame([(1, " ".join(f"Word{i}" for i in range(20, 35))), (2, "single"), (2, "single"), (3, None), (4, ""), (None, "no id here"),
                                   (5, "b. A-B! b")], "item_id long, text string")
    own = [(r["item_id"], r["text"]) for r in items.collect() if r["item_id"] is not None]
    for df, rows, bench, known in ((odd, odd_rows, items, own), (docs, doc_rows, spark.read.parquet(f"{sf}/benchmark.parquet"), None)):
        known = known or [(r["item_id"], r["text"]) for r in bench.collect()]
        got = find_contamination(df, bench, max_entries=max_entries).filter("doc_id IS NOT NULL").collect()
        assert sorted((r["doc_id"], r["contamination"]["n_words"], r["contamination"]["n_hit"], r["contamination"]["items"]) for r in got) == sorted(
            (i, *x) for (i, _), x in zip(rows, brute.benchmark_hits(rows, known)))
    assert find_contamination(nothing, items, max_entries=max_entries).collect() == []
    none = find_contamination(odd, items.limit(0), max_entries=max_entries).collect()
    assert all(r["contamination"]["n_hit"] == 0 for r in none)
    clean = {r["doc_id"]: r for r in decontaminate(odd, items, max_entries=max_entries).collect()}
    assert 6 not in clean and "word22" not in clean[1]["text"] and "word36" in clean[1]["text"] and clean[11]["text"].startswith("w0 w1")
    assert clean[1]["contamination"] == "toxicity"  # the column of that name was the input's own


# --- 8 token files ------------------------------------------------------------------------------

def test_units_are_those_of_the_library():
    encoder = Encoder(read_tokenizer(tokenizer_path()))
    texts = ["It's a TEST, don't! 12345 ÀÉß I'LL", "'said 'quoted' ''s ,'s rock'n'roll", "'l", "x'", None, "", "<|endoftext|> a <|STARTOFTEXT|>",
             "é ́x ﬁ Ǆ", "ªº½ µ × ÷a÷", "a\x1cb", "a" * 300 + " " + "!?" * 50, "😀 日本語 text"]
    assert encoder.independent
    assert [x.tolist() for x in encoder.encode_column(pa.array(texts))] == [encoder.whole(t or "").tolist() for t in texts]


def test_grammar_round_trip_and_random_access(spark, odd, tmp_path):
    ids = np.array(([1, 2, 3, 4] * 50 + [9, 9, 9, 2]) * 30, np.uint32)
    last = np.zeros(len(ids), bool)
    last[203::204] = True
    symbols, marks, rules = compress(ids, last.copy(), 10)
    assert len(symbols) < len(ids) / 3 and marks.sum() == last.sum() and (expand(symbols, rules, 10) == ids).all()
    path = write_token_files(odd, tokenizer_path(), 2, str(tmp_path / "tokens"), shard_ids=500)
    encoder = Encoder(read_tokenizer(tokenizer_path()))
    texts = {}
    for r in odd.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], np.append(encoder.whole(r["text"] or ""), 2).astype("<u4").tobytes())
    rows = sorted(read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert (r["start"], bytes(r["ids"]), r["ids_crc32"]) == (at, texts[r["doc_id"]], zlib.crc32(texts[r["doc_id"]]))
        at += r["n_tokens"]
    assert [r["doc_id"] or 0 for r in rows] == sorted(r["doc_id"] or 0 for r in rows) and len(rows) == odd.count()
    shard = spark.read.parquet(path).orderBy(F.desc("n_ids")).first().asDict()
    doc = int(np.frombuffer(shard["doc_ids"], "<i8")[0])
    assert decode_document(shard, 0).astype("<u4").tobytes() == texts[doc]


def test_equal_ids_pair_and_ranges_decode():
    from tamis.llm.token_files import _shard, decode_range

    rng = np.random.default_rng(3)
    docs = [np.full(n, 7, np.uint32) for n in (1, 2, 3, 40, 1001)] + [np.tile(np.arange(50, dtype=np.uint32), 9), rng.integers(0, 6, 3000).astype(np.uint32)]
    docs += [np.concatenate([np.full(5, 3), [9], np.full(4, 3), [7, 7, 3, 3]]).astype(np.uint32)] * 12
    shard = _shard(0, 0, 0, list(range(len(docs))), docs, 100)
    assert len(shard["symbols"]) // shard["width"] < sum(map(len, docs)) / 3
    symbols, at = np.frombuffer(shard["symbols"], "<u2"), set(np.frombuffer(shard["doc_at"], "<u4").tolist())
    pairs = Counter((a, b) for i, (a, b) in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist())) if i + 1 not in at and a != b)
    assert max(pairs.values()) < LEAST  # no frequent pair is left
    for k, ids in enumerate(docs):
        assert (decode_document(shard, k) == ids).all()
        for first, end in [(0, len(ids)), (0, 1), (len(ids) - 1, len(ids)), (3, 3), (5, 2), (-4, 2), (len(ids), len(ids) + 9), *(sorted(rng.integers(0, len(ids) + 1, 2)) for _ in range(20))]:
            assert (decode_range(shard, k, first, end) == ids[max(first, 0):max(end, 0)]).all(), (k, first, end)


def test_token_files_of_nothing(spark, nothing, tmp_path):
    assert read_token_files(spark, write_token_files(nothing, tokenizer_path(), 2, str(tmp_path / "none"))).collect() == []


# --- 9 language model ------------------------------------------------------------------------------

def test_language_model(odd, odd_rows, nothing, docs, doc_rows):
    for df, rows in ((odd.filter("doc_id IS NOT NULL"), odd_rows), (docs, doc_rows)):
        got = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in score_texts(df, remainder(10) != 0).collect())
        assert got == sorted((i, n, known, total, round(base, 6)) for (i, _), (n, known, total, base) in zip(rows, brute.unigram_scores(rows)))
    scored = score_texts(docs, remainder(10) != 0).agg(*[F.sum(F.when(~F.col("trained"), F.col(c))).alias(c) for c in ("score", "base_score")]).first()
    assert scored["base_score"] < scored["score"] < 0  # held-out texts
    assert score_texts(nothing, F.lit(True)).collect() == []
    untaught = score_texts(odd, F.lit(False)).collect()
    assert len(untaught) == odd.count() and all(r["n_known"] == 0 and r["score"] <= 0 for r in untaught)


def test_rare_contexts_have_restaurants(spark):
    """Pairs of words far below a share of 1/10000 are learnt: the second follows the first alone."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(4000):
        x = int(rng.integers(0, 12_000))
        rows.append((i, " ".join(f"a{y} b{y}" for y in [(x + 577 * j) % 12_000 for j in range(6)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = df.repartition(3)
    scored = score_texts(texts, F.col("doc_id") % 10 != 0).filter("NOT trained AND n_known = n_tokens").agg(F.sum("score"), F.sum("n_tokens"), F.count("*")).first()
    assert scored[2] > 20 and scored[0] / scored[1] > -2.9, tuple(scored)  # by the parent alone about -3.9 a word
    again = score_texts(df.repartition(7), F.col("doc_id") % 10 != 0).select("doc_id", "score").collect()
    assert sorted(tuple(r) for r in again) == sorted(tuple(r) for r in score_texts(texts, F.col("doc_id") % 10 != 0).select("doc_id", "score").collect())


def test_probabilities_of_the_vocabulary_sum_to_one(spark, monkeypatch):
    """In a frequent, a rare and an unknown context, over many buckets, with hot dishes and without."""
    monkeypatch.setattr("tamis.llm.language_model.BUCKET_BYTES", 1 << 10)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, 30, p=(p := 1 / np.arange(1, 61)) / p.sum()))) for i in range(40)] + [(40, "once upon w1 w2")]
    seconds = [*sorted({w for _, t in rows for w in t.split()}), "unseen", ""]  # the last: the end of the text, a token like others
    asked = [f"{c} {w}" for c in ("w0", "once", "never") for w in seconds]
    df = spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    for hot in (1e-4, 2.0):
        monkeypatch.setattr("tamis.llm.language_model.HOT", hot)
        scored = {r["doc_id"] - 1000: r for r in score_texts(df, F.col("doc_id") < 1000, with_tokens=True).collect()}
        each = [scored[i]["token_scores"] for i in range(len(asked))]
        assert all(sum(x) == pytest.approx(scored[i]["score"]) for i, x in enumerate(each))
        for k in range(3):
            assert sum(10 ** x[1] for x in each[k * len(seconds):(k + 1) * len(seconds)]) == pytest.approx(1, abs=1e-5), (hot, k)


def test_totals_while_seating_are_counted_over_all_buckets(spark, monkeypatch):
    """Types, pairs and contexts of hot dishes as a plain count gives them, however few of them one bucket holds."""
    monkeypatch.setattr("tamis.llm.language_model.BUCKET_BYTES", 1 << 9)
    monkeypatch.setattr("tamis.llm.language_model.BATCH_BYTES", 1 << 10)
    seen, plain = [], language_model._counts
    monkeypatch.setattr("tamis.llm.language_model._counts", lambda rows, n_hot: seen.append(plain(rows, n_hot)) or seen[-1])
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(300)], 25, p=(p := 1 / np.arange(1, 301)) / p.sum()))) for i in range(120)]
    tokens = [(before, word) for i, t in rows if i % 10 for before, word in zip(["", *t.split()], [*t.split(), ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1e-2, 2.0):
        monkeypatch.setattr("tamis.llm.language_model.HOT", hot)
        assert score_texts(df, F.col("doc_id") % 10 != 0).count() == 120
        words = Counter(word for _, word in tokens)
        follows = Counter(word for _, word in set(tokens))
        counted = seen.pop()
        assert counted["types"] == len(words) and counted["pairs"] == len(set(tokens))
        assert sorted(counted["hot"]) == sorted(follows[w] for w, n in words.items() if n >= hot * len(tokens))


# --- the queries -----------------------------------------------------------------------------------

def test_there_is_a_query_for_every_operator():
    assert [f"op{n}" for n in range(1, 14)] == sorted((k.partition("_")[0] for k in QUERIES), key=lambda k: int(k[2:]))
