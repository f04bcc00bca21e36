"""SimHash near-duplicates by pivot distance tables.

Texts with equal fingerprints are one point. Points meet only where a block of their bits agrees: fingerprints with
at most ``radius`` differing bits, cut into more blocks than that, share one. For each point the table of its Hamming
distances to many reference fingerprints is computed once; by the triangle inequality a pair whose distances to any
reference differ by more than ``radius`` is discarded, and the survivors are verified bit by bit. A block that many
points share is not paired off: its points meet at their one-bit neighbours instead, at most 65 points to a meeting,
which finds the same links (see ``_meeting_links``). Linked points are joined into components.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexilar.llm.arrow import map_arrow
from vexilar.llm.text import drop_rows, own_columns, text_key
from vexilar.operators.components import connected_components
from vexilar.session import materialize

#: Reference fingerprints of the distance table.
PIVOTS = 16
#: Points with an equal block that are paired off at most; larger groups meet at one-bit neighbours.
PAIR_GROUP = 64
#: Points up to which three blocks are enough; one block more for each further factor of 1000.
POINTS_OF_THREE = 4_000_000


def _make_fingerprints(shingle: int, seed: int):
    def make():
        from itertools import repeat

        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        def of(data: bytes | None) -> int:
            words = (data or b"").lower().split()  # bytes: A-Z only, and the six ASCII blanks
            if not words:
                return 0
            grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else (b" ".join(words),)
            h = np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64)
            ones = np.zeros(64, dtype=np.int64)
            for k in range(0, len(h), 65_536):  # bounds the table of bits of a long text
                ones += np.unpackbits(h[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), pa.array(map(of, texts), pa.int64())], names=["_id", "_key", "fp"])

        return step

    return make


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(_id, _key, fp): the 64-bit SimHash of every text, as a signed long, one row a row of ``docs``; _key: text_key.

    Words are split at ASCII blanks after lower-casing A-Z; a shingle's hash is the XXH64 of its words joined by
    spaces, repeats counted; a bit is 1 if set in over half of the hashes. A text with fewer words than a shingle is one
    shingle, and a null text or one without words has fingerprint zero.
    """
    own = own_columns(docs, _id=doc_id, _key=text_key(F.col(f"`{text}`")), _text=F.col(f"`{text}`").cast("string"))
    return map_arrow(own, _make_fingerprints(shingle, seed), f"_id {dict(docs.dtypes)[doc_id]}, _key binary, fp bigint", "_text")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _pivot(k: int) -> int:
    """The k-th reference fingerprint: a fixed pseudo-random 64-bit value."""
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(k.to_bytes(8, "little"), 7)
    return value - (1 << 64) if value >> 63 else value


def pivot_table(points: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """Adds d0, d1, ...: each point's Hamming distance to each reference fingerprint."""
    return points.select("*", *[_distance(F.col("fp"), F.lit(_pivot(k)).cast("bigint")).cast("tinyint").alias(f"d{k}") for k in range(pivots)])


def _blocks(n_points: int, radius: int) -> list[int]:
    """Masks of the bits that two linked points may share: all but ``radius`` of the blocks."""
    count = radius + 1
    limit = POINTS_OF_THREE
    while n_points > limit and count < 8:
        count, limit = count + 1, limit * 1000
    edges = [round(64 * i / count) for i in range(count + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(count)]
    return [sum(c) for c in combinations(masks, count - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _meeting_links(points: DataFrame) -> DataFrame:
    """Links between points at most two bits apart, through a key that each point and its one-bit neighbours have.

    Two fingerprints have a common key exactly if they differ in at most two bits, and a key has at most 65 points,
    so a dense group costs 65 rows a point and never all its pairs.
    """
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << k)).cast("bigint") for k in range(64)])
    keyed = points.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("key"))
    met = keyed.groupBy("key").agg(F.collect_list("fp").alias("all")).where("size(all) > 1")
    return met.select(F.explode("all").alias("src"), F.array_min("all").alias("dst")).where("src <> dst").distinct()


def links(points: DataFrame, radius: int = 2, pivots: int = PIVOTS, pair_group: int = PAIR_GROUP) -> DataFrame:
    """(src, dst): fingerprints whose links connect exactly the points that differ in at most ``radius`` bits.

    points: distinct fp. In groups of at most ``pair_group`` every link is listed; in larger ones (radius 2 or less)
    enough links that the components are the same.
    """
    if radius > 2:
        raise ValueError("one-bit neighbours meet at two bits at most; use a radius of 2 or less")
    n = points.count()
    table = pivot_table(points, pivots)
    masks = F.array(*[F.struct(F.lit(i).alias("b"), F.lit(_signed(m)).cast("bigint").alias("m")) for i, m in enumerate(_blocks(n, radius))])
    dealt = table.select("*", F.explode(masks).alias("_b")).select("fp", *[f"d{k}" for k in range(pivots)], F.col("_b.b").alias("block"), F.col("fp").bitwiseAND(F.col("_b.m")).alias("key"))
    sizes = dealt.groupBy("block", "key").count().where("count > 1")
    sizes = materialize(sizes, "block_sizes")
    shared = dealt.join(sizes.where(F.col("count") <= pair_group).select("block", "key"), ["block", "key"], "left_semi")
    a, b = shared.alias("a"), shared.alias("b")
    apart = [F.abs(F.col(f"a.d{k}") - F.col(f"b.d{k}")) for k in range(pivots)]
    close = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.greatest(*apart) <= radius))
    pairs = close.where(_distance(F.col("a.fp"), F.col("b.fp")) <= radius).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    large = sizes.where(F.col("count") > pair_group)
    if large.isEmpty():
        return pairs.distinct()
    dense = dealt.join(large.select("block", "key"), ["block", "key"], "left_semi").select("fp").distinct()
    met = _meeting_links(dense)
    if radius < 2:
        met = met.where(_distance(F.col("src"), F.col("dst")) <= radius)
    return pairs.union(met).distinct()


def _classes(docs: DataFrame, doc_id: str, text: str, shingle: int, seed: int, radius: int) -> DataFrame:
    """(_id, _key, fp, component_id, kept_key), one row a row of ``docs``: the component's row with the least id, then key."""
    prints = materialize(fingerprints(docs, doc_id, text, shingle, seed), "fingerprints")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key"))
    points = materialize(prints.groupBy("fp").agg(first.alias("least")), "points")
    joined = connected_components(links(points.select("fp"), radius))
    known = joined.join(points, joined["node"] == points["fp"]).select("node", "component", "least")
    best = known.groupBy("component").agg(F.min("least").alias("best"))
    renamed = known.join(best, "component").select(F.col("node").alias("fp"), "best")
    of_point = points.join(renamed, "fp", "left").select("fp", F.coalesce("best", "least").alias("best"))
    of_point = of_point.select("fp", F.col("best._id").alias("component_id"), F.col("best._key").alias("kept_key"))
    return prints.join(materialize(of_point, "classes"), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id that links reach, the document's own included. Null and empty texts have
    fingerprint zero and link like any other; repeated rows each get a row; null ids never become a component_id
    (null only where a whole component has none). Ids may be of any type with an order. Other columns are ignored; an empty table gives no row.
    """
    out = _classes(docs, doc_id, text, shingle, seed, radius)
    return out.select(F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of every component the row with the least doc_id stays.

    Rows that repeat both doc_id and text are one document, of which one row stays. Null ids come last; of texts with
    the same id, or without any, that with the least SHA-256 stays. All columns are unchanged; an empty table gives no
    row. The rows to drop are found among fingerprints, so texts are only shuffled where there are too many of those
    to broadcast.
    """
    found = materialize(_classes(docs, doc_id, text, shingle, seed, radius), "near_duplicates")
    goes = ~(F.col("_id").eqNullSafe(F.col("component_id")) & (F.col("_key") == F.col("kept_key")))
    left = drop_rows(docs, found.where(goes).select("_id", "_key"), doc_id, text)
    again = materialize(found.groupBy("_id", "_key").count().where("count > 1").select("_id", "_key"), "repeated_rows")
    if again.isEmpty():
        return left
    same = left[doc_id].eqNullSafe(again["_id"]) & (text_key(left[text]) == again["_key"])
    once = left.join(again, same, "left_semi").dropDuplicates([doc_id, text])
    return drop_rows(left, again, doc_id, text).unionByName(once)
