"""Exact Jaccard join of documents on word n-gram sets, by grouped prefixes.

1. Shingles are hashed in chunks. Document frequencies come from a merge of the chunks' sorted runs, answered with one
   byte for each distinct shingle of a chunk, so every document can order its shingles rarest first.
2. A document's prefix is so long that two documents above the threshold share a prefix shingle. Shingles of frequency
   one match nothing, so only the others are kept; most documents have none in their prefix and are done.
3. Equal shingle sets are one node. Nodes with equal prefix and size are one group, and groups meet by prefix shingles.
4. Star pairs first: each member against its group's centre, each group against one centre for a shingle: the one with
   the fewest rarer shingles (of a family of edited copies the nearest to their source), and one drawn by chance.
   Verified links join nodes into components.
5. Group pairs that aren't yet wholly in one component are filtered by size, by the shingle's place and by bitmaps of
   their shingles and expanded into members of different components. Of the pairs between two components a few are
   verified in a round, ever more of them in later rounds; once two components are found to be one, their other pairs
   are settled. So each candidate pair is verified, or its two documents are known to be connected, and no group of
   copies is expanded into all its pairs.

Defined cases: words are lower-cased in A-Z only; fewer than n words give one shingle, none give the empty set, which is
linked with nothing; a null text is empty; rows with equal texts are linked whatever their doc_id; a null doc_id is no
one's smallest; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks, common
from .components import connected
from .wordhash import gram_hashes, grams_within

N, PERCENT = 3, 90
#: Kinds of star pairs between groups before the rest is paired exactly.
STARS = 2

RUN = "bucket int, chunk int, bits int, prints binary, counts binary"
SIGNATURE = "doc_id long, n_shingles long, set_key binary, prefix array<long>, places array<int>, shared binary, bits array<long>"
#: Text of a chunk: workers hold some twenty times that, two to four of them beside an executor's heap.
CHUNK_BYTES = 4 << 20
#: 64-bit parts of the bitmap that stands for a set's shared shingles.
PARTS = 8
#: Groups of a token that are paired with as many others in one task's key.
SLICE = 512


def shingle_sets(chunk: chunks.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and shingle hashes, sorted by both and distinct."""
    docs, hashes = [], []
    inside = grams_within(chunk.doc, n)
    docs.append(chunk.doc[: len(inside)][inside])
    hashes.append(gram_hashes(chunk.words, n)[inside])
    sizes = np.diff(chunk.first)
    for k in range(1, n):
        short = np.flatnonzero(sizes == k)
        docs.append(short.astype(np.int32))
        hashes.append(gram_hashes(chunk.words, k)[chunk.first[short]] if len(short) else np.zeros(0, np.uint64))
    doc, value = np.concatenate(docs), np.concatenate(hashes)
    del docs, hashes
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    del order
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def print_bits(size: int) -> int:
    """Bits of a shingle's fingerprint for counting: 13 more than the shingles of so many bytes of text need."""
    return min(64, max(1, size // 4).bit_length() + 13)


def _prints(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints (the hash's high bits), each value's entry among them, and the values of each."""
    cut = values >> np.uint64(64 - bits) << np.uint64(64 - bits) if bits < 64 else values
    order = np.argsort(cut)
    ordered = cut[order]
    new = np.ones(len(cut), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    entry = np.empty(len(cut), np.int32)
    entry[order] = np.cumsum(new, dtype=np.int32) - 1
    at = np.flatnonzero(new)
    return ordered[new], entry, np.diff(np.append(at, len(cut)))


def _planes(values: np.ndarray, bits: int) -> bytes:
    """The bytes that hold so many high bits, by position; the last one's unused bits are zero and cost nothing packed."""
    width = -(-bits // 8)
    return common.squeeze(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def _unplanes(data: bytes, bits: int) -> np.ndarray:
    width = -(-bits // 8)
    rows = np.frombuffer(common.unsqueeze(data), np.uint8).reshape(width, -1).T
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :width] = rows
    return out.view(">u8").ravel().astype(np.uint64)


def _levels(counts: np.ndarray) -> np.ndarray:
    """Frequencies as bytes: exact to 200, then four steps for each doubling."""
    high = 200 + 4 * np.log2(np.maximum(counts, 200) / 200)
    return np.where(counts <= 200, counts, np.minimum(high, 255)).astype(np.uint8)


def _runs(packed: DataFrame, buckets: int, n: int, bits: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        _, values = shingle_sets(chunks.Chunk(table, lower=True), n)
        prints, _, counts = _prints(values, bits)
        cuts = chunks.bucket_cuts(prints, buckets)
        key = table.column("chunk")[0].as_py()
        rows = [(b, key, bits, _planes(prints[i:j], bits), common.squeeze(counts[i:j].astype(np.uint32).tobytes())) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        return common.arrow_table(rows, RUN)

    return packed.groupBy("chunk").applyInArrow(common.one(run), RUN)


def _count(runs: DataFrame) -> DataFrame:
    ddl = "bucket int, chunk int, levels binary"

    def run(table: pa.Table) -> pa.Table:
        bits = table.column("bits")[0].as_py()
        parts = [_unplanes(x.as_buffer().to_pybytes(), bits) for x in table.column("prints")]
        counts = np.concatenate([np.frombuffer(common.unsqueeze(x.as_buffer().to_pybytes()), np.uint32) for x in table.column("counts")])
        sizes = [len(p) for p in parts]
        prints = np.concatenate(parts)
        del parts
        order = np.argsort(prints, kind="stable")
        ordered = prints[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        totals = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new)) if len(order) else counts.astype(np.int64)
        levels = np.empty(len(order), np.uint8)
        levels[order] = _levels(totals)[np.cumsum(new) - 1]
        ends = np.cumsum(sizes)
        bucket = table.column("bucket")[0].as_py()
        return common.arrow_table([(bucket, key, common.squeeze(levels[e - s : e].tobytes())) for key, s, e in zip(table.column("chunk").to_pylist(), sizes, ends, strict=True)], ddl)

    return runs.groupBy("bucket").applyInArrow(common.one(run), ddl)


def _bitmaps(rank: np.ndarray, values: np.ndarray, many: int) -> np.ndarray:
    """PARTS 64-bit words for each of many sets; rank is each value's set, ascending."""
    out = np.zeros((many, PARTS), np.int64)
    for lo in range(0, many, 10_000):
        i, j = np.searchsorted(rank, [lo, min(many, lo + 10_000)])
        bits = np.zeros((min(many, lo + 10_000) - lo, 64 * PARTS), bool)
        bits[rank[i:j] - lo, (values[i:j] % np.uint64(64 * PARTS)).astype(np.int64)] = True
        out[lo : lo + len(bits)] = np.packbits(bits, axis=1).view(np.int64)
    return out


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def _signature_table(chunk: chunks.Chunk, doc: np.ndarray, values: np.ndarray, level: np.ndarray, percent: int) -> pa.Table:
    """SIGNATURE's rows; columns are made from flat arrays, not from Python values."""
    many = len(chunk)
    first = np.searchsorted(doc, np.arange(many + 1, dtype=np.int32))
    low, size = first[:-1], np.diff(first)
    start = low + np.bincount(doc[level < 2], minlength=many)
    end = np.where(size > 0, low + size - (percent * size + 99) // 100 + 1, low)
    live = start < end
    none = pa.array(~live)
    # within a document by level, then value: values are in order already
    order = np.argsort(doc.astype(np.int64) << 8 | level, kind="stable")
    place = np.arange(len(doc))
    held = live[doc] & (place >= start[doc]) & (place < end[doc])
    prefix, places = values[order[held]].view(np.int64), (place - low[doc])[held].astype(np.int32)
    del order, place, held
    cuts = _offsets(np.where(live, end - start, 0))
    kept = (level >= 2) & live[doc]
    shared, owner = values[kept], doc[kept]
    bounds = _offsets(8 * np.bincount(owner, minlength=many))
    keys = [hashlib.blake2b(values[i:j].tobytes(), digest_size=16).digest() if ok else None for i, j, ok in zip(first[:-1].tolist(), first[1:].tolist(), live.tolist(), strict=True)]
    maps = _bitmaps((np.cumsum(live) - 1)[owner], shared, int(live.sum()))
    return pa.table(
        [
            pa.array(chunk.ids, mask=~chunk.known),
            pa.array(size.astype(np.int64)),
            pa.array(keys, pa.binary()),
            pa.ListArray.from_arrays(cuts, pa.array(prefix), mask=none),
            pa.ListArray.from_arrays(cuts, pa.array(places), mask=none),
            pa.Array.from_buffers(pa.binary(), many, [pa.array(live).buffers()[1], bounds.buffers()[1], pa.py_buffer(shared)]),
            pa.ListArray.from_arrays(_offsets(PARTS * live), pa.array(maps.ravel()), mask=none),
        ],
        names=[f.split()[0] for f in SIGNATURE.split(", ")],
    )


def _signatures(packed: DataFrame, counted: DataFrame, buckets: int, n: int, percent: int, bits: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = chunks.Chunk(left, lower=True)
        doc, values = shingle_sets(chunk, n)
        chunk.words = chunk.doc = None  # only ids are needed from here on
        prints, entry, _ = _prints(values, bits)
        cuts = chunks.bucket_cuts(prints, buckets)
        known = np.ones(len(prints), np.uint8)
        del prints
        for b, levels in zip(right.column("bucket").to_pylist(), right.column("levels").to_pylist(), strict=True):
            known[cuts[b] : cuts[b + 1]] = np.frombuffer(common.unsqueeze(levels), np.uint8)
        level = known[entry]
        del entry
        return _signature_table(chunk, doc, values, level, percent)

    return packed.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(common.two(run), SIGNATURE)


def _asked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that stored pairs (a, b, ..) name; where those are few, no other node's set travels."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    return nodes.join(common.small_side(keys, "shingle-asked"), "key", "left_semi")


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of stored pairs (a, b, ..) of node keys, those above the threshold, with _name()s beside; the sets are compared whole."""

    @F.arrow_udf("long")
    def common_shingles(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([len(np.intersect1d(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), assume_unique=True)) for p, q in zip(x, y, strict=True)], pa.int64())

    nodes = _asked(pairs, nodes)
    left = nodes.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"), _name().alias("named_a"))
    right = nodes.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"), _name().alias("named_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("met", common_shingles("sa", "sb"))
    return both.filter(100 * F.col("met") >= percent * (F.col("na") + F.col("nb") - F.col("met"))).select(*pairs.columns, "named_a", "named_b")


def _name() -> Column:
    """A node by its smallest doc_id (nodes without one come last), then its key: a component's smallest name tells its id."""
    return F.struct(F.col("low").isNull().alias("none"), F.coalesce("low", F.lit(0)).alias("low"), F.col("key").alias("key"))


def _settled(wide: DataFrame, nodes: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) between components from candidate pairs (a, b, cx, cy) of nodes in components cx < cy; None without any.

    A round verifies one pair from each of some hash classes of each two components, then forgets the pairs of components
    that have become one; classes grow eightfold, so rounds grow with the logarithm of the pairs between two components.
    """
    left, links, classes = common.stored(wide, "shingle-pairs"), None, 1
    if left.isEmpty():
        return None
    nodes = common.stored(_asked(left, nodes), "shingle-asked")
    while not left.isEmpty():
        chance = F.xxhash64("a", "b")
        drawn = left.groupBy("cx", "cy", F.pmod(chance, F.lit(classes)).alias("class")).agg(F.min(F.struct(chance.alias("chance"), "a", "b")).alias("one"))
        drawn = common.stored(drawn.select("one.a", "one.b", "cx", "cy"), "shingle-drawn")
        found = common.stored(_verified(drawn, nodes, percent).select(F.col("cx").alias("a"), F.col("cy").alias("b")).distinct(), "shingle-links")
        links = found if links is None else links.union(found)
        comps = connected(found)
        left = left.join(drawn.select("a", "b"), ["a", "b"], "left_anti")
        for c in ("cx", "cy"):
            named = left.select(c).distinct().join(comps.select(F.col("key").alias(c), "comp"), c, "left").select(c, F.coalesce("comp", c).alias("now"))
            left = common.split_join(common.stored(left, "shingle-pairs"), named, c).drop(c).withColumnRenamed("now", c)
        left = left.filter("cx <> cy").select("a", "b", F.least("cx", "cy").alias("cx"), F.greatest("cx", "cy").alias("cy"))
        left, classes = common.stored(left, "shingle-pairs"), classes * 8
    return links


def _may_link(nx: Column, px: Column, ny: Column, py: Column, percent: int) -> Column:
    """Whether sizes, and places of a shared shingle, allow the threshold if no rarer shingle is shared.

    What is left from the shingle on bounds the overlap then. Two documents that link pass at their first shared shingle.
    """
    sizes = (100 * nx >= percent * ny) & (100 * ny >= percent * nx)
    return sizes & ((100 + percent) * F.least(nx - px, ny - py) >= percent * (nx + ny))


def _maps_fit(percent: int, all_: str = "all", any_: str = "any") -> Column:
    """Whether the bitmaps of x and y, groups or members, allow the threshold.

    A bit that all members of one group have and no member of the other stands for a shingle that isn't shared.
    """

    def left(a: str, b: str) -> Column:
        lost = sum((F.bit_count(F.col(f"{all_}{i}{a}").bitwiseAND(F.bitwise_not(F.col(f"{any_}{i}{b}")))) for i in range(PARTS)), F.lit(0))
        return F.col(f"held{a}") - lost

    return (100 + percent) * F.least(left("x", "y"), left("y", "x")) >= percent * (F.col("nx") + F.col("ny"))


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT, stars: int = STARS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id; see the module's text."""
    common.session_setup(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = chunks.measure(docs, chunk_bytes=CHUNK_BYTES)
    buckets, bits = chunks.buckets_for(size["bytes"]), print_bits(size["bytes"])
    packed = chunks.pack(docs, size["bounds"])
    counted = _count(_runs(packed, buckets, n, bits))
    signs = common.stored(_signatures(packed, counted, buckets, n, percent, bits), "shingle-signatures")
    alone = signs.filter("set_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rest = signs.filter("set_key IS NOT NULL")

    nodes = rest.groupBy(F.col("set_key").alias("key")).agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"), F.first("places").alias("places"), F.first("shared").alias("shared"), F.first("bits").alias("bits"))
    nodes = nodes.withColumn("kind", F.sha2(F.concat_ws(",", F.col("n"), F.concat_ws(",", F.transform("prefix", lambda t: t.cast("string")))), 256))
    nodes = common.stored(nodes, "shingle-nodes")
    groups = nodes.groupBy("kind").agg(F.min("key").alias("centre"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("places").alias("places"), F.max(F.octet_length("shared") / 8).alias("held"), *(f(F.col("bits")[i]).alias(f"{c}{i}") for c, f in (("all", F.bit_and), ("any", F.bit_or)) for i in range(PARTS)))
    groups = common.stored(groups, "shingle-groups")
    maps = [F.col("bits")[i].alias(f"bits{i}") for i in range(PARTS)]
    members = nodes.select("key", "low", "kind", "n", (F.octet_length("shared") / 8).alias("held"), *maps).join(groups.select("kind", "centre"), "kind")
    members = common.stored(members.drop("kind"), "shingle-members")
    posts = common.stored(groups.selectExpr("centre AS g", "n", "inline(arrays_zip(prefix, places)) AS (token, place)"), "shingle-posts")

    pairs = members.filter("key <> centre").select(F.col("centre").alias("a"), F.col("key").alias("b"))
    for order in (["place", "chance"], ["chance"])[:stars]:
        drawn = posts.withColumn("chance", F.xxhash64("g", F.lit(len(order))))
        hub = drawn.groupBy("token").agg(F.min(F.struct(F.struct(*order).alias("rank"), "g", "n", "place")).alias("hub"), F.count(F.lit(1)).alias("many")).filter("many > 1")
        hub = hub.select("token", F.col("hub.g").alias("h"), F.col("hub.n").alias("hn"), F.col("hub.place").alias("hp"))
        met = posts.join(hub, "token").filter((F.col("g") != F.col("h")) & _may_link(F.col("n"), F.col("place"), F.col("hn"), F.col("hp"), percent))
        pairs = pairs.union(met.select(F.least("h", "g").alias("a"), F.greatest("h", "g").alias("b")))
    pairs = common.stored(pairs.distinct(), "shingle-stars")
    links = common.stored(_verified(pairs, nodes, percent).select(F.col("named_a").alias("a"), F.col("named_b").alias("b")), "shingle-links")
    comps = connected(links)

    placed = members.join(comps.select("key.key", "comp"), "key", "left").withColumn("comp", F.coalesce("comp", _name()))
    placed = common.stored(placed, "shingle-placed")
    span = placed.groupBy(F.col("centre").alias("g")).agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    posted = posts.join(span, "g")
    mixed = posted.groupBy("token").agg(F.min("c0").alias("t0"), F.max("c1").alias("t1"), F.count(F.lit(1)).alias("many")).filter("t0 <> t1").select("token", "many")
    posted = common.stored(common.split_join(common.stored(posted, "shingle-posted"), mixed, "token"), "shingle-mixed")
    maps = [f"{c}{i}" for c in ("all", "any") for i in range(PARTS)]
    posted = posted.join(groups.select(F.col("centre").alias("g"), "held", *maps), "g")
    # the groups of a token are dealt into slices, and a task gets a slice met by a slice
    slices = F.ceil(F.col("many") / SLICE).cast("int")
    own, every = F.pmod(F.xxhash64("g"), slices).cast("int"), F.explode(F.sequence(F.lit(0), slices - 1))
    p, q = (posted.select("token", F.col("g").alias(f"g{s}"), *(F.col(c).alias(c + s) for c in ("n", "place", "c0", "c1", "held", *maps)), own.alias(f"s{s}"), every.alias(f"s{o}")) for s, o in (("x", "y"), ("y", "x")))
    apart = (F.col("gx") < F.col("gy")) & ((F.col("c0x") != F.col("c0y")) | (F.col("c1x") != F.col("c1y")) | (F.col("c0x") != F.col("c1x")))
    within = (F.col("gx") == F.col("gy")) & (F.col("c0x") != F.col("c1x"))
    met = p.join(q, ["token", "sx", "sy"]).filter((apart & _may_link(F.col("nx"), F.col("placex"), F.col("ny"), F.col("placey"), percent) & _maps_fit(percent)) | within).select("gx", "gy").distinct()
    own = ["n", "held", *(f"bits{i}" for i in range(PARTS))]
    a, b = (placed.select(F.col("centre").alias(f"g{s}"), F.col("key").alias(k), F.col("comp").alias(f"c{s}"), *(F.col(c).alias(c + s) for c in own)) for s, k in (("x", "a"), ("y", "b")))
    wide = met.join(a, "gx").join(b, "gy").filter((F.col("cx") != F.col("cy")) & ((F.col("gx") != F.col("gy")) | (F.col("a") < F.col("b"))) & _maps_fit(percent, "bits", "bits"))
    turned = F.col("cx") > F.col("cy")
    x, y = (F.struct(F.col(k).alias("node"), F.col(c).alias("comp")) for k, c in (("a", "cx"), ("b", "cy")))
    wide = wide.select(F.when(turned, y).otherwise(x).alias("x"), F.when(turned, x).otherwise(y).alias("y")).distinct()
    more = _settled(wide.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.comp").alias("cx"), F.col("y.comp").alias("cy")), nodes, percent)

    ends = placed.select(F.col("key").alias("set_key"), "comp")
    if more is not None:
        named = ends.select("comp").distinct().join(connected(more).select(F.col("key").alias("comp"), F.col("comp").alias("whole")), "comp", "left").select("comp", F.coalesce("whole", "comp").alias("whole"))
        ends = common.split_join(common.stored(ends, "shingle-ends"), named, "comp").select("set_key", F.col("whole").alias("comp"))
    ends = ends.select("set_key", F.when(~F.col("comp.none"), F.col("comp.low")).alias("component_id"))
    return common.split_join(rest.select("doc_id", "n_shingles", "set_key"), ends, "set_key").select("doc_id", "n_shingles", "component_id").union(alone)
