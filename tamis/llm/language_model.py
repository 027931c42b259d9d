"""A hierarchical Pitman-Yor language model over words, sampled in blocks, and perplexity from its averaged seatings.

A token is a word or the end of a text. Every token of the training texts has a context restaurant for the token that follows it;
their parent is one restaurant of all tokens, whose base is uniform over the vocabulary and one unknown word. In a restaurant a
customer joins a table of its dish or opens one, and each table is a customer of the parent (Chinese-restaurant seating).

Pairs of a context and a dish are dealt into buckets by the dish's hash, those of a hot dish (a share of 1/10000 or more) by the
context's, so that no bucket grows with a hot word; which dishes are hot decides where pairs lie, not what has a restaurant. Given how
many tables each restaurant has in total, the seatings of different dishes are independent, so a bucket samples its own: a sweep unseats and
reseats every dish in the context restaurants, then in the parent, with blocks of customers that grow with those already seated.
Tables are averaged over the kept sweeps. Three steps read what the batches of documents sent, their distinct tokens and pairs, which is written once.
The first counts, over all buckets, the dishes of each context, the contexts of each hot dish, the types and the pairs: these are the totals while seating, for tables
that lie in other buckets are taken at their least, one a pair. Contexts are summed in a table dealt by context that answers each
bucket for its own. The second step samples, and sums the averages over each context, likewise, and over the parent. The third samples the same
seatings again, from the same seeds, and answers the batches. So customers, tables and totals of a prediction all come from one set
of averages, and the probabilities of the vocabulary and the unknown word sum to one in every context. The driver sees the hot dishes
and a few sums, nothing else.

Defined results: null and empty texts are the end alone; repeated rows are scored, and learnt from, one by one; without training
texts every token is unknown and has probability 1; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import U64, find_words, fresh_path, in_batches, materialise, mix, remove_folder, slices, text_size

HOT = 1e-4  # of the training tokens; pairs of such a dish are dealt by context
BATCH_BYTES, BUCKET_BYTES = 8 << 20, 12 << 20  # of text
END = mix(np.array([0xE0F], U64))[0]
BLOB = "batch long, bucket long, blob binary"
ROW_GROUP = 16 << 20  # bytes of blobs that a task writes or reads at once
SUMS = pa.schema([(n, t) for n, t in zip(("k", "x", "y", "owner", "bucket", "blob"), (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.binary()))])
BURN_IN, SAMPLES = 2, 3
THETA, ROUGH = 1.0, 0.75  # the strength of every restaurant; the discount while seating


def _tokens(texts):
    """(hash, previous hash, document) of all tokens; what precedes a text is the end of another."""
    words = find_words(texts, lower=True)
    n = words.count
    at = np.arange(len(words.hash)) + words.doc
    token = np.full(len(words.hash) + len(n), END)
    token[at] = words.hash
    doc = np.repeat(np.arange(len(n)), n + 1)
    before = np.empty_like(token)
    before[1:] = token[:-1]  # at the head of a text this is an end
    before[:1] = END
    return token, before, doc


def _rows(rows):
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("batch", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary())))})


def _owner(tokens, n_buckets):
    return ((tokens >> U64(32)) * U64(n_buckets) >> U64(32)).astype(np.int64)


class _Asked:
    """The distinct tokens of a batch and their pairs with the token before them, with the training counts of both."""

    def __init__(self, texts, train, hot, n_buckets):
        token, before, self.doc = _tokens(texts)
        learn = train[self.doc]
        self.tokens, self.which = np.unique(token, return_inverse=True)
        self.counts = np.bincount(self.which, learn, len(self.tokens)).astype(np.uint32)
        self.before = np.searchsorted(self.tokens, before)
        pairs, which_pair = np.unique(self.which.astype(np.int64) << 32 | self.before, return_inverse=True)
        pair_counts = np.bincount(which_pair, learn, len(pairs)).astype(np.uint32)
        dish, context = pairs >> 32, pairs & 0xFFFFFFFF
        self.owner, self.n_buckets = _owner(self.tokens, n_buckets), n_buckets
        at = np.searchsorted(hot, self.tokens)
        rank = np.where(np.append(hot, U64(0))[at] == self.tokens, at, -1) if len(hot) else np.full(len(self.tokens), -1)
        rank = rank[dish]
        bucket = np.where(rank < 0, self.owner[dish], self.owner[context])
        # of a bucket first the pairs of its own dishes; short numbers are sorted by radix
        order = np.argsort((bucket * 2 + (rank >= 0)).astype(np.uint16 if n_buckets <= 1 << 15 else np.int64), kind="stable")
        self.which_pair = np.empty(len(order), np.int64)
        self.which_pair[order] = np.arange(len(order))
        self.which_pair = self.which_pair[which_pair]
        self.bucket, self.dish, self.rank, self.context, self.pair_counts = bucket[order], dish[order], rank[order], context[order], pair_counts[order]

    def blobs(self):
        each = np.bincount(self.dish[self.rank < 0], minlength=len(self.tokens)).astype(np.uint32)
        cut, pair_cut = (np.searchsorted(x, np.arange(self.n_buckets + 1)) for x in (self.owner, self.bucket))
        for k in np.flatnonzero((cut[1:] > cut[:-1]) | (pair_cut[1:] > pair_cut[:-1])).tolist():
            i, j, p, q = cut[k], cut[k + 1], pair_cut[k], pair_cut[k + 1]
            ranks, of_rank = np.unique(self.rank[p:q][self.rank[p:q] >= 0], return_counts=True)
            contexts, which = np.unique(self.context[p:q], return_inverse=True)
            yield k, b"".join([np.array([j - i, len(ranks), len(contexts), q - p], "<u4").tobytes(), *map(_planes, (
                self.tokens[i:j], self.counts[i:j], each[i:j], ranks.astype("<u2"), of_rank.astype("<u4"), self.tokens[contexts],
                which.astype(_index(len(contexts))), self.pair_counts[p:q]))])


def _planes(x) -> bytes:
    """Numbers by byte place, all first bytes first: small numbers then leave long runs of zeros, which the shuffle's codec shrinks."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def _numbers(blob, kind, n, at):
    """What ``_planes`` wrote."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()


def _index(n):
    return "<u2" if n <= 1 << 16 else "<u4"


def _read(blob):
    n, h, c, m = np.frombuffer(blob, "<u4", 4).tolist()
    at, out = 16, []
    for kind, size in (("<u8", n), ("<u4", n), ("<u4", n), ("<u2", h), ("<u4", h), ("<u8", c), (_index(c), m), ("<u4", m)):
        out.append(_numbers(blob, kind, size, at))
        at += np.dtype(kind).itemsize * size
    return out


class _Bucket:
    """All counts of the pairs of a bucket, and where each batch's entries are among them. Dishes are its own tokens, then the hot ones."""

    def __init__(self, blobs, hot):
        parts = [_read(b) for b in blobs]
        tokens, counts, contexts, pair_counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 5, 7))
        self.tokens, self.which = np.unique(tokens, return_inverse=True)
        self.counts = np.bincount(self.which, counts, len(self.tokens))
        self.cut, self.pair_cut = np.cumsum([0, *(len(p[0]) for p in parts)]), np.cumsum([0, *(len(p[7]) for p in parts)])
        self.own, self.n_dishes = len(self.tokens), len(self.tokens) + len(hot)
        dish = np.concatenate([x for k, p in enumerate(parts) for x in (np.repeat(self.which[self.cut[k]:self.cut[k + 1]], p[2]),
                                                                        np.repeat(p[3].astype(np.int64), p[4]) + self.own)])
        # its own tokens are asked for too, for the batches
        self.contexts, context = np.unique(np.concatenate([contexts, self.tokens]), return_inverse=True)
        self.as_context = context[len(contexts):]
        at = np.cumsum([0, *(len(p[5]) for p in parts)])
        context = np.concatenate([context[i:][p[6]] for i, p in zip(at, parts)])
        pairs, self.which_pair = np.unique(dish.astype(np.int64) << 32 | context, return_inverse=True)
        self.pair_counts = np.bincount(self.which_pair, pair_counts, len(pairs))
        self.dish, self.context = pairs >> 32, pairs & 0xFFFFFFFF
        at = np.searchsorted(self.tokens, hot)
        self.held = np.flatnonzero(np.append(self.tokens, U64(0))[at] == hot) if len(hot) else np.zeros(0, np.int64)
        self.held_at = at[self.held]  # where hot dishes are among its own tokens

    @staticmethod
    def seat(customers, open_mass, discount, rng):
        """Tables after ``customers`` of each dish sat down one by one; ``open_mass``: weight of a new table."""
        tables = (customers > 0).astype(float)
        at = np.flatnonzero(customers > 1)
        seated = 1.0
        while len(at):
            left = customers[at] - seated
            block = np.minimum(max(1, int(seated) // 2), left).astype(np.int64)
            new = open_mass[at] / (open_mass[at] + np.maximum(seated - discount * tables[at], 1e-9))
            tables[at] += rng.binomial(block, new)
            seated += max(1, int(seated) // 2)
            at = at[customers[at] > seated]
        return tables

    def n_here(self):
        """How many dishes follow each context in training texts, of the pairs of this bucket."""
        return np.bincount(self.context, self.pair_counts > 0, len(self.contexts))

    def hot_here(self):
        """How many contexts each hot dish follows, of the pairs of this bucket."""
        return np.bincount(self.dish, self.pair_counts > 0, self.n_dishes)[self.own:]

    def sample(self, counted, n_contexts, seed):
        """(tables by pair, tables in the parent by dish, guests of the parent by dish), averaged over the kept sweeps.

        ``counted`` holds the types, pairs and contexts of each hot dish over all buckets, ``n_contexts`` the dishes of each context of this one. Tables
        in other buckets count as one a pair.
        """
        rng = np.random.default_rng(seed)
        open_mass = THETA + ROUGH * n_contexts[self.context]
        types, all_guests = counted["types"], counted["pairs"]
        elsewhere = np.concatenate([np.zeros(self.own), counted["hot"] - self.hot_here()])
        share = np.full(self.n_dishes, 1 / (types + 1))
        sums = None
        for sweep in range(BURN_IN + SAMPLES):
            tables = self.seat(self.pair_counts, open_mass * share[self.dish], ROUGH, rng)
            guests = np.bincount(self.dish, tables, self.n_dishes)
            everywhere = guests + elsewhere
            new = (THETA + ROUGH * types) / (types + 1)
            top = self.seat(everywhere, np.full(len(guests), new), ROUGH, rng)
            share = (everywhere - ROUGH * top + new) / (THETA + all_guests)
            if sweep >= BURN_IN:
                sums = [tables, top, guests] if sums is None else [a + b for a, b in zip(sums, (tables, top, guests))]
        return [x / SAMPLES for x in sums]


def _share(m, guests, top):
    """The parent's probability of dishes with these guests and tables; dishes without any have that of the unknown word."""
    return (guests - m["d0"] * top + (THETA + m["d0"] * m["top"]) / (m["types"] + 1)) / (THETA + m["guests"])


def _by_context(replies):
    """The numbers that the owners of a bucket's contexts replied, in the order of its contexts."""
    return np.frombuffer(b"".join(replies.sort_by("owner")["blob"].to_pylist()), "<u4")


def _counts(rows, n_hot) -> dict:
    """The types, pairs and contexts of each hot dish, summed over all buckets."""
    got = {r["k"]: (r["x"], r["y"]) for r in rows}
    return {"types": got.get(-1, (0.0, 0.0))[1], "pairs": got.get(-2, (0.0, 0.0))[0], "hot": np.array([got.get(k, (0.0, 0.0))[0] for k in range(n_hot)])}


def _totals(rows, n_hot, seed) -> dict:
    """The model's numbers from the sums over all buckets: the guests of each hot dish, and below 0 those of the other dishes' parent."""
    got = {r["k"]: (r["x"], r["y"]) for r in rows}
    discount = lambda once, twice: min(max(once / (once + 2 * twice), 0.1), 0.95) if once else ROUGH
    hot = np.array([got.get(k, (0.0, 0.0))[0] for k in range(n_hot)])
    tokens, types = got.get(-1, (0.0, 0.0))
    once, twice = got.get(-3, (0.0, 0.0))
    rest_top, rest = got.get(-4, (0.0, 0.0))
    m = {"d": discount(*got.get(-2, (0, 0))), "d0": discount(once + (hot == 1).sum(), twice + (hot == 2).sum()),
         "guests": rest + hot.sum(), "tokens": int(tokens), "types": int(types)}
    rng, top, sampled = np.random.default_rng((seed, 3)), (hot > 0).astype(float), []
    for _ in range(BURN_IN + SAMPLES):
        top = _Bucket.seat(np.round(hot), np.full(n_hot, (THETA + m["d0"] * (rest_top + top.sum())) / (m["types"] + 1)), m["d0"], rng)
        sampled.append(np.minimum(top, hot))
    top = np.mean(sampled[BURN_IN:], axis=0)
    m["top"] = rest_top + top.sum()
    return m | {"hot_share": _share(m, hot, top)}


def score_texts(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", seed: int = 1,
                with_tokens: bool = False) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score, perplexity): log10 probabilities of each whole
    text under additive unigrams and under the model, learnt from the rows where ``train`` holds; ``with_tokens``: also token_scores, those of
    each token."""
    spark = docs.sparkSession
    train = F.coalesce(train, F.lit(False))
    own = docs.select(F.col(text).cast("string").alias("text"), train.alias("train"))

    def count(batches):
        for whole in batches:
            for batch in slices(whole):
                token, _, doc = _tokens(batch["text"])
                found, n = np.unique(token[batch["train"].to_numpy(zero_copy_only=False)[doc]], return_counts=True)
                yield pa.RecordBatch.from_pydict({"token": pa.array(found.view(np.int64)), "n": pa.array(n)})

    counted = materialise(own.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "counted")
    tokens = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.filter(F.col("n") >= HOT * tokens).select("token").collect()
    size = text_size(docs, text)
    n_buckets = max(1, size // BUCKET_BYTES)
    dealt = in_batches(docs, size, doc_id, text, BATCH_BYTES, train=train)
    known = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in rows], np.int64).view(U64)))  # at most 1 / HOT hashes

    def ask(key, table):
        table = table.combine_chunks()
        asked = _Asked(table["text"], table["train"].to_numpy(), known.value, n_buckets)
        return _rows([(key[0].as_py(), k, blob) for k, blob in asked.blobs()])

    def send(bucket, number, of, of_contexts):
        """Sums to their owners, and a whole number per context to that of the context."""
        cut = np.searchsorted(_owner(bucket.contexts, n_buckets), np.arange(n_buckets + 1)).tolist()
        sent = [(k, bucket.contexts[i:j].tobytes() + of_contexts[i:j].astype("<u4").tobytes()) for k, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
        return pa.Table.from_pylist([{"k": k, "x": float(x), "y": float(y), "owner": int(o)} for k, x, y, o in of]
                                    + [{"owner": k, "bucket": number, "blob": b} for k, b in sent], SUMS)

    def of_hot(hot):
        at = _owner(known.value, n_buckets)
        return [(i, hot[i], 0, at[i]) for i in np.flatnonzero(hot).tolist()]

    def count_pairs(key, table):
        bucket, number = _Bucket(table["blob"].to_pylist(), known.value), key[0].as_py()
        of = [(-1, bucket.counts.sum(), (bucket.counts > 0).sum(), number), (-2, (bucket.pair_counts > 0).sum(), 0, number)]
        return send(bucket, number, of_hot(bucket.hot_here()) + of, bucket.n_here())

    def seated(key, table, of_contexts):
        """A bucket with its seatings; ``of_contexts``: what the owners of its contexts counted."""
        bucket, number = _Bucket(table["blob"].to_pylist(), known.value), key[0].as_py()
        return bucket, number, bucket.sample(counts_of.value, _by_context(of_contexts), (seed, number))

    def measure(key, table, of_contexts):
        bucket, number, (tables, top, guests) = seated(key, table, of_contexts)
        hot = guests[bucket.own:]
        top, guests = top[:bucket.own], guests[:bucket.own]
        of = [(-1, bucket.counts.sum(), (bucket.counts > 0).sum(), number), (-2, (bucket.pair_counts == 1).sum(), (bucket.pair_counts == 2).sum(), number),
              (-3, (guests == 1).sum(), (guests == 2).sum(), number), (-4, top.sum(), guests.sum(), number)]
        by_context = np.rint(np.bincount(bucket.context, tables, len(bucket.contexts)) * SAMPLES)  # whole numbers: sums over the sweeps
        return send(bucket, number, of_hot(hot) + of, by_context)

    def add(key, table):
        """The numbers of an owner's contexts summed over all buckets, for each bucket in the order of its contexts; and the sums it got."""
        owner, rows = key[0].as_py(), table.to_pylist()
        of: dict = {}
        for row in rows:
            if row["k"] is not None:
                x, y = of.get(row["k"], (0.0, 0.0))
                of[row["k"]] = x + row["x"], y + row["y"]
        sent = [row for row in rows if row["k"] is None]
        each = [len(row["blob"]) // 12 for row in sent]
        read = lambda kind, at: np.concatenate([np.frombuffer(row["blob"], kind, n, at * n) for row, n in zip(sent, each)] or [np.zeros(0, kind)])
        contexts, which = np.unique(read("<u8", 0), return_inverse=True)
        tables = np.bincount(which, read("<u4", 8), len(contexts)).astype("<u4")[which]
        cut = np.cumsum([0, *each])
        return pa.Table.from_pylist([{"k": k, "x": x, "y": y, "owner": owner} for k, (x, y) in of.items()]
                                    + [{"owner": owner, "bucket": row["bucket"], "blob": tables[i:j].tobytes()} for row, i, j in zip(sent, cut, cut[1:])], SUMS)

    kinds = "k long, x double, y double, owner long, bucket long, blob binary"

    def sum_up(parts, name):
        """What the owners summed up: rows to the driver, and a blob per owner and bucket."""
        summed = materialise(parts.groupBy("owner").applyInArrow(add, kinds), name)
        sums = summed.filter("k IS NOT NULL").groupBy("k").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()
        return sums, summed.filter("k IS NULL").select("owner", "bucket", "blob")

    path = fresh_path(spark, "asked")
    written = materialise(dealt.groupBy("batch").applyInArrow(ask, BLOB), "asked", path, ROW_GROUP)
    asked = written.groupBy("bucket")
    sums, n_contexts = sum_up(asked.applyInArrow(count_pairs, kinds), "pairs")
    counts_of = spark.sparkContext.broadcast(_counts(sums, len(known.value)))  # a number per hot dish
    sums, by_context = sum_up(asked.cogroup(n_contexts.groupBy("bucket")).applyInArrow(measure, kinds), "summed")
    totals = spark.sparkContext.broadcast(_totals(sums, len(known.value), seed))  # likewise

    def answer(key, table, of_contexts):
        m = totals.value
        counted = pc.equal(of_contexts["counted"], True)
        bucket, number, (tables, top, guests) = seated(key, table, of_contexts.filter(counted))
        context_tables = _by_context(of_contexts.filter(pc.invert(counted)))
        share = _share(m, guests[:bucket.own], top[:bucket.own])
        share[bucket.held_at] = m["hot_share"][bucket.held]
        customers = bucket.pair_counts - m["d"] * tables
        own_tables = context_tables[bucket.as_context]
        out = []
        for k, b in enumerate(table["batch"].to_pylist()):
            w, q = bucket.which[bucket.cut[k]:bucket.cut[k + 1]], bucket.which_pair[bucket.pair_cut[k]:bucket.pair_cut[k + 1]]
            out.append((b, number, b"".join([np.array([len(w), len(q)], "<u4").tobytes(), *map(_planes, (
                bucket.counts[w].astype("<u4"), own_tables[w], share[w].astype("<f4"), customers[q].astype("<f4")))])))
        return _rows(out)

    def score(key, table, replies):
        m, table = totals.value, table.combine_chunks()
        asked = _Asked(table["text"], table["train"].to_numpy(), known.value, n_buckets)
        parts = []
        for blob in replies.sort_by("bucket")["blob"].to_pylist():
            n, q = np.frombuffer(blob, "<u4", 2).tolist()
            parts.append([_numbers(blob, kind, size, at) for kind, size, at in (("<u4", n, 8), ("<u4", n, 8 + 4 * n), ("<f4", n, 8 + 8 * n), ("<f4", q, 8 + 12 * n))])
        counts, tables, share, seated = (np.concatenate([p[k] for p in parts]).astype(float) if parts else np.zeros(0) for k in range(4))
        # a token is followed by one token each time, so a context has as many customers as it has occurrences
        p = ((seated[asked.which_pair] + (THETA + m["d"] * tables[asked.before] / SAMPLES) * share[asked.which]) / (THETA + counts[asked.before]))
        counts = counts[asked.which]
        n_docs = table.num_rows
        tokens = np.bincount(asked.doc, minlength=n_docs)
        base = np.bincount(asked.doc, np.log10((counts + 0.1) / (m["tokens"] + 0.1 * (m["types"] + 1))), n_docs)
        whole = np.bincount(asked.doc, np.log10(p), n_docs)
        each = {"token_scores": pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(tokens)]), np.log10(p)).cast(pa.list_(pa.float64()))} if with_tokens else {}
        return pa.table({"doc_id": table["doc_id"], "trained": table["train"], "n_tokens": pa.array(tokens), "n_known": pa.array(np.bincount(asked.doc, counts > 0, n_docs).astype(np.int64)),
                         "train_tokens": pa.array(np.full(n_docs, m["tokens"])), "base_score": pa.array(base), "score": pa.array(whole),
                         "perplexity": pa.array(10 ** np.minimum(-whole / np.maximum(tokens, 1), 300))} | each)

    both = n_contexts.withColumn("counted", F.lit(True)).unionByName(by_context.withColumn("counted", F.lit(False)))
    parts = []
    for half in (0, 1):  # the buckets in two jobs, so that what was asked lies on disk once and a half
        own_half = F.col("bucket") % 2 == half
        parts.append(materialise(written.filter(own_half).groupBy("bucket").cogroup(both.filter(own_half).groupBy("bucket")).applyInArrow(answer, BLOB), "answers", None, ROW_GROUP))
    answers = parts[0].unionByName(parts[1])
    remove_folder(spark, path)  # it is large, and every answer is written
    return (dealt.groupBy("batch").cogroup(answers.groupBy("batch"))
            .applyInArrow(score, "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double" + ", token_scores array<double>" * with_tokens))

