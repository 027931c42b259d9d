"""Near-duplicates by SuperMinHash signatures, banding, verification on full shingle sets, and union-find grouping.

SuperMinHash gives each shingle its own random permutation of the signature's places; the shingle's j-th place gets the value
j + r, and a place keeps its least value. The places of a document are thus filled evenly, and as no later step can undercut
a full signature, a document stops after a few steps (all of a document's shingles take a step at once, in numpy).

Documents of the same set are one class from the start. The signatures of the classes are cut into 40 bands of 5, which misses a pair
of similarity 0.8 with a chance of 1.3e-7. In every bucket all classes are first compared with the least one. Buckets whose
members still belong to different groups go on, those with the same largest group together: first some members of that group
are compared with the members outside it; then, round by round, members outside it are compared with all members of other
groups and leave. A task holds some of these leaders with their sets and streams the other members past them, so no bucket is ever
expanded into its pairs, and yet no pair of different groups that share a bucket goes untested. In these rounds a pair is
compared by size and signature first and by the full sets only if the signatures agree in as many places as a similarity 0.2 below
the wanted one would give (for 0.8: 0.6 of 200 places, which a true pair misses with a chance of 2e-11). Groups are found by alternating large-star and small-star steps on tables in
the shared folder.

Defined results: texts without words, null and empty ones, have no shingles and are linked with nothing; rows of the same
doc_id are one document of the group; a null doc_id is linked with nothing, has no component and is kept; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import U64, chain, find_words, materialise, mix, partitions, slices

BANDS, ROWS = 40, 5
DRAWN, LEADERS = 32, 2048  # held at once for the buckets of a largest group
SALT = 256  # members of a leader, or of those buckets, that one task compares
SLACK = 20  # percent of the places that a signature may be short of the wanted similarity, for full sets to be compared
CHUNK = 1 << 17  # shingles that are ranked at once
LOW = U64((1 << 48) - 1)


def shingle_sets(texts, k: int):
    """(sorted distinct 64-bit shingle hashes, first index of each document): k words each; a text of fewer words is one."""
    words = find_words(texts, lower=True)
    n = words.count
    doc = words.doc
    left = words.first[1:].repeat(n) - np.arange(len(doc))
    size = np.minimum(n, k)[doc]
    at = np.flatnonzero(left >= size)
    h = mix(words.hash[at] + U64(1))
    for j in range(1, k):
        more = np.flatnonzero(size[at] > j)
        h[more] = chain(h[more], words.hash[at[more] + j])
    doc = doc[at]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def super_minhash(hashes: np.ndarray, first: np.ndarray, places: int) -> np.ndarray:
    """A row of ``places`` 64-bit values per document: the step in the upper 16 bits, the random part in the lower 48."""
    n_docs = len(first) - 1
    signature = np.full((n_docs, places), ~U64(0))
    flat = signature.ravel()
    h, doc = hashes, np.repeat(np.arange(n_docs), np.diff(first))
    order = None  # the not yet dealt places of each shingle, as far as its permutation is drawn
    for j in range(places):
        if not len(h):
            break
        draw = mix(h + U64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        pick = j + ((draw >> U64(48)) * U64(places - j) >> U64(16)).astype(np.int64)
        if j == 0:
            place = pick
        else:
            each = np.arange(len(h))
            place = order[each, pick].astype(np.int64)
            order[each, pick] = order[each, j]
        np.minimum.at(flat, doc * places + place, (U64(j) << U64(48)) | (draw & LOW))
        # a signature without a value above this step is final
        going = signature.max(axis=1) >= (U64(j + 1) << U64(48))
        stay = going[doc]
        if j == 0:
            h, doc, pick = h[stay], doc[stay], pick[stay]
            order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(h), 1))
            order[np.arange(len(h)), pick] = 0
        elif not stay.all():
            h, doc, order = h[stay], doc[stay], order[stay]
    return signature


def bands_of(signature: np.ndarray) -> np.ndarray:
    """A hash per band of ROWS places."""
    parts = signature.reshape(len(signature), -1, ROWS)
    h = mix(parts[:, :, 0] + np.arange(1, parts.shape[1] + 1, dtype=U64)[None, :])
    for k in range(1, ROWS):
        h = chain(h, parts[:, :, k])
    return h


def _sums(values, first):
    """Wrapping sums of 64-bit values by document."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    return total[first[1:]] - total[first[:-1]]


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for batch in slices(whole, size=1 << 20):
                h, first = shingle_sets(batch["text"], k)
                bands = np.zeros((batch.num_rows, BANDS), U64)
                low = np.zeros((batch.num_rows, BANDS * ROWS), np.uint8)  # a byte per place, to compare pairs by
                i = 0
                while i < batch.num_rows:  # some 100,000 shingles at a time
                    j = max(i + 1, int(np.searchsorted(first, first[i] + CHUNK, side="right")) - 1)
                    j = min(j, batch.num_rows)
                    signature = super_minhash(h[first[i]:first[j]], first[i:j + 1] - first[i], BANDS * ROWS)
                    bands[i:j], low[i:j] = bands_of(signature), mix(signature).astype(np.uint8)
                    i = j
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"], "n_shingles": pa.array(np.diff(first)),
                    "set_a": pa.array(_sums(mix(h + U64(11)), first).view(np.int64)), "set_b": pa.array(_sums(mix(h + U64(12)), first).view(np.int64)),
                    "bands": pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())), "places": pa.array([x.tobytes() for x in low], pa.binary())})

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, places binary")


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for batch in slices(whole, size=1 << 20):
                h, first = shingle_sets(batch["text"], k)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"], "set_a": pa.array(_sums(mix(h + U64(11)), first).view(np.int64)),
                    "set_b": pa.array(_sums(mix(h + U64(12)), first).view(np.int64)),
                    "shingles": pa.array([h[i:j].tobytes() for i, j in zip(first, first[1:])], pa.binary())})

    return docs.mapInArrow(run, "doc_id long, set_a long, set_b long, shingles binary")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar enough. Each task holds the set of one b and streams those of its a."""
    spark = pairs.sparkSession
    salts = pairs.groupBy("b").agg((F.floor(F.count("*") / SALT) + 1).alias("salts"))
    dealt = (pairs.join(salts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt")))
    members = dealt.join(sets.withColumnRenamed("rep", "a"), "a").select("b", "salt", F.lit(1).alias("kind"), "a", "shingles")
    leaders = (dealt.select("b", "salt").distinct().join(sets.withColumnRenamed("rep", "b"), "b")
               .select("b", "salt", F.lit(0).alias("kind"), F.col("b").alias("a"), "shingles"))

    def run(batches):
        now, own = None, []
        for batch in batches:
            found = []
            for b, salt, kind, a, blob in zip(*(batch[n].to_pylist() for n in ("b", "salt", "kind", "a", "shingles"))):
                other = np.frombuffer(blob, "<u8")
                if (b, salt) != now:
                    now, own = (b, salt), []
                if kind == 0:
                    own.append(other)
                elif any(_similar(x, other, percent) for x in own):
                    found.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return (members.unionByName(leaders).repartition(partitions(spark), "b", "salt").sortWithinPartitions("b", "salt", "kind")
            .mapInArrow(run, "a long, b long").distinct())


def _similar(x, y, percent):
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _compared(members: DataFrame, leaders: DataFrame, store: DataFrame, percent: int) -> DataFrame:
    """The similar pairs (a, b) of a member and a leader with the same key and of different groups. A task holds the
    leaders of a key and streams members past them; the members of a key are dealt out over as many tasks as they need."""
    spark = members.sparkSession
    columns = ["rep", "component", "n", "places", "shingles"]
    salts = members.groupBy("key").agg((F.floor(F.count("*") / SALT) + 1).alias("salts"))
    rows = (members.join(salts, "key").select("key", F.pmod(F.xxhash64("rep"), "salts").alias("salt"), F.lit(1).alias("kind"), "rep", "component")
            .unionByName(leaders.join(salts, "key").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
                                                           F.lit(0).alias("kind"), "rep", "component")))

    def run(batches):
        now, held = None, []
        for batch in batches:
            key = np.stack([batch["key"].to_numpy(), batch["salt"].to_numpy()], axis=1)
            kind, rep, group, n = (batch[c].to_numpy() for c in ("kind", "rep", "component", "n"))
            places = np.frombuffer(b"".join(batch["places"].to_pylist()), np.uint8).reshape(len(rep), -1)
            sets = [np.frombuffer(x, "<u8") for x in batch["shingles"].to_pylist()]
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1) | (kind[1:] != kind[:-1])])) if len(rep) else []
            found = []
            for i, j in zip(cut, [*cut[1:], len(rep)]):
                if (own := tuple(key[i])) != now:
                    now, held = own, []
                if kind[i] == 0:
                    held.append((rep[i:j], group[i:j], n[i:j], places[i:j], sets[i:j]))
                    continue
                for lead_rep, lead_group, lead_n, lead_places, lead_sets in held:
                    for k in range(i, j):
                        y = np.flatnonzero((lead_group != group[k]) & (100 * np.minimum(n[k], lead_n) >= percent * np.maximum(n[k], lead_n)))
                        for y in y[100 * (lead_places[y] == places[k]).sum(axis=1) >= (percent - SLACK) * places.shape[1]].tolist():
                            if _similar(sets[k], lead_sets[y], percent):
                                found.append((int(rep[k]), int(lead_rep[y])))
            yield pa.RecordBatch.from_pydict({"a": pa.array([max(x) for x in found], pa.int64()), "b": pa.array([min(x) for x in found], pa.int64())})

    return (rows.join(store, "rep").select("key", "salt", "kind", *columns).repartition(partitions(spark), "key", "salt")
            .sortWithinPartitions("key", "salt", "kind").mapInArrow(run, "a long, b long").distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of the edges (a, b) reaches, by large-star and small-star steps
    until every node points at one node that points at none."""
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    both = F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    for _ in range(max_rounds):
        # a node that points at two others, or is pointed at and points itself, is not settled
        pointing = now.groupBy("u").agg(F.count("*").alias("n")).unionByName(now.select(F.col("v").alias("u"), F.lit(1).alias("n")).distinct())
        if pointing.groupBy("u").agg(F.sum("n").alias("n")).filter("n > 1").join(now.select("u").distinct(), "u", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        around = now.select(F.explode(both).alias("e")).select("e.u", "e.v")
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialise(around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        now = materialise(small.filter("u > v").distinct(), "small-star")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Groups (node, component) after further links: only the links between groups are worked on."""
    of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    between = (links.join(of("a"), "a", "left").join(of("b"), "b", "left")
               .select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).filter("a <> b"))
    moved = components(between)
    old = groups.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return materialise(old.select("node", F.coalesce("to", "component").alias("component"))
                       .unionByName(moved.join(groups.select("node"), "node", "left_anti")).distinct(), "groups")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row: documents are linked when their shingle sets have a similarity
    of ``percent`` or more, a component is named by its least doc_id, and only that document is kept."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketches = materialise(_sketches(own, shingle), "sketches")
    classes = materialise(sketches.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("set_a", "set_b")
                          .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
                               F.first("places").alias("places")), "classes")
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    least = banded.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader < last")
    members = materialise(banded.join(least, "bucket").select("bucket", "rep", "leader"), "members")
    # the full sets and signatures of all classes that share a bucket with another one; a document that is the least of two classes,
    # by rows of the same id, stands for both
    reps = members.select("rep").distinct()
    texts = own.join(reps, own["doc_id"] == reps["rep"], "left_semi")
    chosen = classes.join(reps, "rep", "left_semi").select(F.col("rep").alias("doc_id"), "set_a", "set_b", "n", "places")
    store = materialise(_full_sets(texts, shingle).join(chosen, ["doc_id", "set_a", "set_b"]).dropDuplicates(["doc_id", "set_a", "set_b"])
                        .select(F.col("doc_id").alias("rep"), "n", "places", "shingles"), "sets")
    sets = store.select("rep", "shingles")
    pairs = members.filter("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    groups = materialise(components(materialise(_links(pairs, sets, percent), "links")), "groups")
    open_members, draw = members.select("bucket", "rep").filter("rep <> leader"), True
    while True:
        labelled = (open_members.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
                    .select("bucket", "rep", F.coalesce("component", "rep").alias("component")))
        sizes = labelled.groupBy("bucket", "component").agg(F.count("*").alias("size"))
        largest = (sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("groups")).filter("groups > 1")
                   .select("bucket", F.col("top.component").alias("largest")))
        left = materialise(labelled.join(largest, "bucket").withColumnRenamed("largest", "key"), "open")
        if left.isEmpty():
            break
        # the buckets of a largest group are one from here on
        at_key = left.select("key", "rep", "component").distinct()
        inside = F.col("component") == F.col("key")
        turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("rep"), "rep"))
        leaders = at_key.filter(inside if draw else ~inside).withColumn("turn", turn).filter(F.col("turn") <= (DRAWN if draw else LEADERS))
        leaders = materialise(leaders.drop("turn"), "leaders")
        fresh = materialise(_compared(at_key.filter(~inside) if draw else at_key, leaders, store, percent), "links")
        if not fresh.isEmpty():
            groups = _joined(groups, fresh)
        if not draw:  # these have met all others of their buckets
            open_members = materialise(left.join(leaders, ["key", "rep"], "left_anti").select("bucket", "rep"), "open")
        draw = False
    of_set = (classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
              .select("set_a", "set_b", F.coalesce("component", "rep").alias("of_set")))
    return (sketches.select("doc_id", "n_shingles", "set_a", "set_b").join(of_set, ["set_a", "set_b"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None).cast("long"))
                    .when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("of_set")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those of a group's documents that are not its least; of rows with the same doc_id all stay or go."""
    gone = near_duplicates(docs, shingle, percent, doc_id, text).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")
