"""Near-duplicate documents by DartMinHash signatures and banding.

A document is a weighted set of its five-word shingles; the weight is the count. Each unit of
weight is a strip of the board, and hashed darts land on it as a Poisson process along the rank
axis: the n-th gap of a strip is the logarithm of a hash of (shingle, strip, n). With total weight W
only darts of rank up to ``t / W`` are thrown, about ``t`` per document whatever its size. A dart's
hash names its coordinate; the earliest dart of each coordinate is kept. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. Coordinates left empty are
filled by throwing on to twice the rank.

``BANDS`` bands of ``ROWS`` coordinates give candidates: of a pair at 0.8 all but 4 in 10,000 are
found, of a pair at 0.85 all but 2 in 100,000. Every link is verified on the full shingles.

1. Documents with the same shingles are one node, so exact copies never meet.
2. In each bucket of a band every node is compared with the bucket's smallest node only. The links
   found make components; a bucket of thousands of near copies is one component after that.
3. Buckets that still hold several components are compared in blocks: members outside the smallest
   node's component against all, in chunks of ``CHUNK``, first those whose signatures come near the
   threshold, then the rest that is still in another component. All are verified in place, and a
   block returns one link for each component it joins. So no link between components is lost, and no
   pairs inside one are made.

Texts with one to four words are one shingle of all their words. Texts without words (and nulls)
link with nothing. Repeated rows are copies of each other; ``kept`` is true for exactly one row of a
class, the one with the smallest doc_id (null counts as largest). An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.batches import store, unpacked
from panelspark.llm.common import combine, components, mix, raw_bytes, slices, word_hashes, words_of
from panelspark.storage import cut_lineage

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 5
SIZE = BANDS * ROWS
THROWN = SIZE * (np.log(SIZE) + 2)
CHUNK, SALTS = 1024, 64
#: Pairs whose agreeing coordinates are within four deviations of the threshold are verified before the others.
NEAR = int(SIZE * THRESHOLD - 4 * np.sqrt(SIZE * THRESHOLD * (1 - THRESHOLD)))
BATCH, FLAT = 3 << 19, 1 << 20
LAST = (1 << 63) - 1


def strips(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every unit of weight: (shingle, which occurrence in the row)."""
    begin, end, row = words_of(data, starts)
    words = word_hashes(data, begin, end)
    n_rows = len(starts) - 1
    count = np.bincount(row, minlength=n_rows)
    whole = np.flatnonzero(row[: len(row) - SHINGLE + 1] == row[SHINGLE - 1 :]) if len(row) >= SHINGLE else np.zeros(0, np.int64)
    two = combine(words[:-1], words[1:])
    name = combine(combine(two[whole], two[whole + 2]), words[whole + SHINGLE - 1]) if len(whole) else np.zeros(0, np.uint64)
    owner = row[whole]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        first = np.searchsorted(row, short)
        few = mix(count[short].astype(np.uint64))
        for k in range(SHINGLE - 1):
            has = count[short] > k
            few[has] = combine(few[has], words[first[has] + k])
        name, owner = np.concatenate([name, few]), np.concatenate([owner, short])
    order = np.lexsort((name, owner))
    name, owner = name[order], owner[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    nth = np.arange(len(name)) - at[np.cumsum(new) - 1] if len(name) else np.zeros(0, np.int64)
    return owner, combine(name, nth.astype(np.uint64))


def gaps(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-th gap of each strip, and the hash of the dart behind it."""
    dart = mix(hashes + np.uint64((2 * n + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))
    return -np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53), mix(dart)


def signatures(owner: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
    """For each row the earliest dart of every coordinate: rank (float32) and name, as one number."""
    none = np.uint64((1 << 64) - 1)
    best = np.full(n_rows * SIZE, none)
    weight = np.bincount(owner, minlength=n_rows)
    reach = THROWN / np.maximum(weight, 1)
    rows = np.flatnonzero(weight)
    while len(rows):
        member = np.isin(owner, rows) if len(rows) < n_rows else slice(None)
        live, own, n = hashes[member], owner[member], 0
        rank = np.zeros(len(live))
        while len(live):
            gap, name = gaps(live, n)
            rank = rank + gap
            hit = rank <= reach[own]
            live, own, rank, name = live[hit], own[hit], rank[hit], name[hit]
            early = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
            np.minimum.at(best, own * SIZE + ((name >> np.uint64(32)) * np.uint64(SIZE) >> np.uint64(32)).astype(np.int64),
                          early | (name & np.uint64(0xFFFFFFFF)))
            n += 1
        rows = rows[(best.reshape(n_rows, SIZE)[rows] == none).any(axis=1)]
        reach[rows] *= 2
    return best.reshape(n_rows, SIZE)


def sign(batches):
    """Per row with words: rid, order, hashes of the shingle multiset, signature (32 bits a coordinate)."""
    for batch in batches:
        for number, payload in zip(batch.column("batch").to_pylist(), batch.column("payload"), strict=True):
            rows = unpacked(payload.as_buffer())
            owner, hashes = strips(*raw_bytes(rows.column("_text")))
            n = rows.num_rows
            table = mix(signatures(owner, hashes, n)) >> np.uint64(32)
            sums = []
            for salt in (1, 2):
                running = np.append(np.uint64(0), np.cumsum(mix(hashes + np.uint64(salt)), dtype=np.uint64))
                at = np.searchsorted(owner, np.arange(n + 1))
                sums.append((running[at[1:]] - running[at[:-1]]).view(np.int64))
            full = np.bincount(owner, minlength=n) > 0
            made = [x.tobytes() if ok else None for x, ok in zip(table.astype("<u4"), full, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array((number << 20) + np.arange(n)), rows.column("_order"), *(pa.array(x) for x in sums), pa.array(made, pa.binary())],
                names=["rid", "order", "c1", "c2", "sig"])


def band_keys(batches):
    for batch in batches:
        table = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(batch.num_rows, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (batch.num_rows, BANDS))
        for i in range(ROWS):
            key = combine(key, table[:, :, i])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("rid").to_numpy(), BANDS)), pa.array(key.ravel().view(np.int64))],
                                         names=["rid", "bucket"])


def shingle_sets(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """rid and its sorted strips (32 bits each) for every rid of ``wanted``."""
    wanted = wanted.groupBy(F.shiftright("rid", 20).alias("batch")).agg(F.collect_list((F.col("rid") % (1 << 20)).cast("int")).alias("places"))

    def shingles(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows = unpacked(row["payload"])
                places = np.sort(np.array(row["places"]))
                owner, hashes = strips(*raw_bytes(rows.column("_text").take(pa.array(places))))
                cut = np.searchsorted(owner, np.arange(1, len(places)))
                sets = [np.unique(x >> np.uint64(32)).astype("<u4").tobytes() for x in np.split(hashes, cut)]
                yield pa.RecordBatch.from_arrays([pa.array((row["batch"] << 20) + places), pa.array(sets, pa.binary())], names=["rid", "set"])

    # the same join at every size: a broadcast on small tables would hide what it moves on large ones
    return cut_lineage(stored.join(wanted.hint("merge"), "batch").mapInArrow(shingles, "rid long, set binary"), "shingles")


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least ``THRESHOLD``."""
    def similar(batches):
        for batch in slices(batches, "x", 4 << 20):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= THRESHOLD * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("rid").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return cut_lineage(both.mapInArrow(similar, "a long, b long"), "links")


def mixed_members(placed: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with the numbers of blocks (own, others) of their bucket.

    Own members are those of the smallest node's component. Members of one bucket lie in ``SALTS`` places
    when they meet the bucket's numbers, so a bucket with a third of all members is spread.
    """
    of_home = F.col("root") == F.col("home")
    blocks = lambda hit: F.ceil(F.sum(hit.cast("int")) / CHUNK).cast("int")
    mixed = placed.groupBy("bucket").agg(blocks(of_home).alias("own"), blocks(~of_home).alias("others")).filter("others > 0")
    salted = mixed.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return placed.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).join(salted, ["bucket", "salt"]).drop("salt")


def chunk_pairs(members: DataFrame) -> DataFrame:
    """Members of mixed buckets, dealt to blocks: (bucket, i, j, side, rid, root).

    Own members (of the smallest node's component) only meet others; others also meet each other.
    """
    dealt = members.withColumn("other", F.col("root") != F.col("home"))
    place = F.pmod(F.xxhash64("rid", F.lit(1)), F.when(F.col("other"), F.col("others")).otherwise(F.col("own"))).cast("int")
    dealt = dealt.withColumn("place", place)
    # blocks are (own chunk, -) numbered from 0 and (-, other chunk); an other's chunk i meets j >= i as left side
    left = F.when(~F.col("other"), F.transform(F.sequence(F.lit(0), F.col("others") - 1),
                                                lambda j: F.struct((-1 - F.col("place")).alias("i"), j.alias("j"), F.lit(0).alias("side"))))
    meet_own = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda i: F.struct((-1 - i).alias("i"), F.col("place").alias("j"), F.lit(1).alias("side")))
    meet_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(
        F.least(j, F.col("place")).alias("i"), F.greatest(j, F.col("place")).alias("j"), (j < F.col("place")).cast("int").alias("side")))
    return dealt.select("bucket", "rid", "root", F.explode(F.coalesce(left, F.concat(meet_own, meet_others))).alias("at")).select(
        "bucket", "at.i", "at.j", "at.side", "rid", "root")


def near_links(group: pa.Table) -> pa.Table:
    """Links of one block that join different components: at most one for each component that they join.

    Members are compared on their full shingles, one member with its candidates at a time: first those
    whose signatures come near the threshold, then the others. A link gives both components one label,
    so that the rest of them is not compared again. Sets whose sizes alone keep them below the
    threshold are left out, which loses nothing.
    """
    side, rid, label = (group.column(c).to_numpy() for c in ("side", "rid", "root"))
    label = label.copy()
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u4").reshape(-1, SIZE)
    sets = [np.frombuffer(x, "<u4") for x in group.column("set").to_pylist()]
    size = np.array([len(x) for x in sets])
    inside = group.column("i")[0].as_py() == group.column("j")[0].as_py()
    x, y = (np.arange(len(rid)),) * 2 if inside else (np.flatnonzero(side == 1), np.flatnonzero(side == 0))
    out = []

    def link(i, rest):
        """Compare member i with ``rest``, about ``FLAT`` shingles at a time."""
        for part in np.split(rest, np.flatnonzero(np.diff(np.cumsum(size[rest]) // FLAT)) + 1):
            part = part[label[part] != label[i]]
            if not len(part):
                continue
            flat = np.concatenate([sets[j] for j in part])
            own = sets[i]
            found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(found, np.append(0, np.cumsum(size[part])[:-1]), dtype=np.int64)
            for j in part[both >= THRESHOLD * (size[i] + size[part] - both)]:
                if label[j] != label[i]:
                    out.append((rid[i], rid[j]))
                    label[label == label[j]] = label[i]

    for near in (True, False):
        for i in x:
            rest = y[label[y] != label[i]]
            rest = rest[np.minimum(size[rest], size[i]) >= THRESHOLD * np.maximum(size[rest], size[i])]
            link(i, rest[((sig[rest] == sig[i]).sum(axis=1) >= NEAR) == near])
    made = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": made[:, 0], "b": made[:, 1]})


def stored_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rest = [F.col(c) for c in docs.columns if c != text] or [F.lit(0).alias("_none")]
    rows = docs.select(F.struct(*rest).alias("_rest"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("_order"),
                       F.col(text).cast("string").alias("_text"))
    return store(rows, "_text", BATCH)


def classes(stored: DataFrame) -> DataFrame:
    """rid, order (doc_id), class_id (smallest doc_id of the class) and kept, for every row."""
    signed = cut_lineage(stored.mapInArrow(sign, "rid long, order long, c1 long, c2 long, sig binary"), "signatures")
    valid = signed.filter("sig IS NOT NULL")
    copies = cut_lineage(valid.groupBy("c1", "c2").agg(F.min("rid").alias("node")), "nodes")
    nodes = cut_lineage(valid.join(copies.select(F.col("node").alias("rid")), "rid").select("rid", "sig"), "nodes")
    buckets = nodes.mapInArrow(band_keys, "rid long, bucket long")
    shared = buckets.groupBy("bucket").agg(F.min("rid").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = cut_lineage(buckets.join(shared, "bucket"), "members")
    sets = shingle_sets(stored, members.select("rid").distinct())
    links = verified(sets, members.filter("hub < rid").select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct())
    first = cut_lineage(components(links), "components")

    def rooted(df, node, root):
        known = first.select(F.col("node").alias(node), F.col("root").alias(root))
        return df.join(known, node, "left").withColumn(root, F.coalesce(root, node))

    placed = rooted(rooted(members, "rid", "root"), "hub", "home")
    open_ = cut_lineage(mixed_members(placed), "open")
    blocks = chunk_pairs(open_).join(nodes, "rid").join(sets, "rid")
    links = links.unionByName(blocks.groupBy("bucket", "i", "j").applyInArrow(near_links, "a long, b long"))
    roots = cut_lineage(components(links), "components").withColumnRenamed("node", "rid")

    whole = signed.drop("sig").join(copies, ["c1", "c2"], "left").select(
        "rid", "order", F.coalesce("node", "rid").alias("node")).join(roots.withColumnRenamed("rid", "node"), "node", "left")
    whole = cut_lineage(whole.select("rid", "order", F.coalesce("root", "node").alias("root")), "classes")
    best = whole.groupBy("root").agg(F.min(F.struct("order", "rid")).alias("best"))
    return whole.join(best, "root").select("rid", "order", F.col("best.order").alias("class_id"), (F.col("best.rid") == F.col("rid")).alias("kept"))


def document_classes(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id, kept."""
    shown = lambda c: F.when(F.col(c) < LAST, F.col(c))
    done = classes(stored_rows(docs.select("doc_id", "text")))
    return done.select(shown("order").alias("doc_id"), shown("class_id").alias("class_id"), "kept")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class, all columns as they were."""
    stored = stored_rows(docs, doc_id, text)
    kept = classes(stored).filter("kept").groupBy(F.shiftright("rid", 20).alias("batch")).agg(
        F.collect_list((F.col("rid") % (1 << 20)).cast("int")).alias("places"))
    rest = [c for c in docs.columns if c != text]
    kind = docs.select(F.struct(*rest).alias("_rest")).schema["_rest"].dataType.simpleString()

    def taken(batches):
        for batch in batches:
            for row in batch.to_pylist():
                whole, places = unpacked(row["payload"]), pa.array(sorted(row["places"]))
                yield pa.RecordBatch.from_arrays([whole.column(c).take(places) for c in ("_rest", "_text")], names=["_rest", "_text"])

    return stored.join(kept.hint("merge"), "batch").mapInArrow(taken, f"_rest {kind}, _text string").select(
        *[F.col("_text").cast(docs.schema[c].dataType).alias(c) if c == text else F.col("_rest")[c].alias(c) for c in docs.columns])
