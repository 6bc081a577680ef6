"""Near-duplicate groups by SuperMinHash, banding, verification on full shingle sets and union-find.

SuperMinHash gives every shingle a random permutation of the signature's slots: at its j-th step it offers
j + u (u uniform in [0,1)) to the slot at place j. Offers of one shingle exclude each other's slots, which
lowers the variance against independent minima, and once all slots of a text hold values below j no later step
can change any, so the walk stops early. Here step j is taken for all shingles of a block of texts at once.

Candidates. Two texts at similarity s share all of a band's slots with chance s^ROWS: at 0.75, with 32 bands of 4, a linked
pair shares no bucket with chance 5e-6. Equal sets are one node. In the buckets of the first bands all are compared with
one pivot, which joins most of what belongs together in as many comparisons as there are members. Of groups that are still apart
and meet in a bucket of any band, pairs are made across groups only, once each, and only if their whole signatures
agree in AGREE of 512 slots (four bits each): an estimate of 0.68 or more, which a pair at 0.75 misses with chance 6e-5. Every
pair made is confirmed on full sets. Pairs inside a group that is joined already are never made, so thousands of copies
cost thousands of comparisons, not millions.

Edge cases: words are as in ``textkernel``; A-Z are lower-cased; a text without words (null, empty, blank) has an
empty set, links with nothing and keeps itself; fewer words than the shingle size give one shingle, the whole
sequence; rows with equal doc_id are one node; a row with a null doc_id is left out of linking, its
component is null and it is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .staging import pick, stage
from .textkernel import U64, mix, shingles, word_chunks

SLOTS = 512
BANDS = 32
ROWS = 4
AGREE = 358
SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
BLOCK = 1 << 13
FRACTION = 48
SMALL = 256
BROADCAST_IDS = 1_000_000
FIRST_BANDS = 8
MAX = U64(0xFFFFFFFFFFFFFFFF)


def superminhash(hashes: np.ndarray, bound: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts x slots). Step in the top bits, fraction below; MAX only for empty sets."""
    count = len(bound) - 1
    out = np.full((count, slots), MAX, U64)
    size = np.diff(bound)
    # texts with few shingles need many steps and others few: they go in blocks of their own
    for group in (np.flatnonzero((size > 0) & (size < SMALL)), np.flatnonzero(size >= SMALL)):
        at = 0
        while at < len(group):
            end, total = at, 0
            while end < len(group) and (end == at or total + size[group[end]] <= BLOCK):
                total += size[group[end]]
                end += 1
            rows = group[at:end]
            own = out[rows]
            block = np.concatenate([hashes[bound[i] : bound[i + 1]] for i in rows])
            owner = np.repeat(np.arange(len(rows)), size[rows])
            for first in range(0, len(block), BLOCK):  # a longer text in turns; what is found so far stops the later ones
                _offer(block[first : first + BLOCK], owner[first : first + BLOCK], own, slots)
            out[rows] = own
            at = end
    return out


def _offer(hashes: np.ndarray, owner: np.ndarray, signature: np.ndarray, slots: int) -> None:
    place = np.empty((len(hashes), slots), np.uint16)
    place[:] = np.arange(slots, dtype=np.uint16)
    flat = signature.reshape(-1)
    active = np.arange(len(hashes))
    for step in range(slots):
        rank = U64(step << FRACTION)
        open_rows = signature.max(axis=1) >= rank
        if not open_rows.all():
            active = active[open_rows[owner[active]]]
            if not len(active):
                return
        x = mix(hashes[active], 1000 + step)
        k = step + (((x & U64(0xFFFF)) * U64(slots - step)) >> U64(16)).astype(np.int64)
        slot = place[active, k]
        place[active, k] = place[active, step]
        np.minimum.at(flat, owner[active] * slots + slot, rank | (x >> U64(64 - FRACTION)))


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket for each band of ``rows`` slots."""
    parts = signature[:, : BANDS * rows].reshape(len(signature), -1, rows)
    factor = mix(np.arange(rows, dtype=U64), 31) | U64(1)
    total = (parts * factor).sum(axis=2, dtype=U64)
    return mix(total + mix(np.arange(parts.shape[1], dtype=U64), 32), 33)


def sketch(signature: np.ndarray) -> np.ndarray:
    """Four bits of every slot, sixteen slots a word."""
    bits = (mix(signature, 34) & U64(15)).reshape(len(signature), -1, 16)
    return (bits << (np.arange(16, dtype=U64) * U64(4))).sum(axis=2, dtype=U64)


def _agreement(a: str, b: str) -> str:
    """SQL for the number of slots in which two sketches agree."""
    differ = []
    for i in range(SLOTS // 16):
        x = f"({a}[{i}] ^ {b}[{i}])"
        y = f"({x} | shiftrightunsigned({x}, 1))"
        differ.append(f"bit_count(({y} | shiftrightunsigned({y}, 2)) & {0x1111111111111111}L)")
    return f"{SLOTS} - ({' + '.join(differ)})"


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.reshape(-1).view(np.int64)))


def _signed(batches):
    for batch in batches:
        for row, end, words in word_chunks(batch.column(1), lower=True):
            own, bound = shingles(words, SHINGLE)
            size = np.diff(bound)
            starts = np.minimum(bound[:-1], max(0, len(own) - 1))
            digest = [np.add.reduceat(mix(own, seed), starts) * (size > 0) if len(own) else np.zeros(len(size), U64) for seed in (41, 42)]
            signature = superminhash(own, bound)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, end - row).cast(pa.int64()), pa.array(size.astype(np.int64)), *(pa.array(d.view(np.int64)) for d in digest), _lists(bands(signature)), _lists(sketch(signature))],
                ["doc_id", "n_shingles", "k1", "k2", "buckets", "sketch"],
            )


def _confirm(batches):
    """Of (a, b, text_a, text_b) the verdict on the full sets."""
    for batch in batches:
        ends = []
        for c in (2, 3):
            sets = []
            for _, _, words in word_chunks(batch.column(c), lower=True):
                own, bound = shingles(words, SHINGLE)
                sets += [own[bound[i] : bound[i + 1]] for i in range(len(bound) - 1)]
            ends.append(sets)
        linked = []
        for x, y in zip(*ends, strict=True):
            if min(len(x), len(y)) * DENOMINATOR < max(len(x), len(y)) * NUMERATOR or not len(x):
                linked.append(False)
                continue
            both = np.concatenate((x, y))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            linked.append(common * DENOMINATOR >= (len(both) - common) * NUMERATOR)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def by_ids(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """``df`` semi- or anti-joined with ``ids``, which are sent to all executors only when counted and few; beyond that both sides are shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked) for ``pairs`` (a, b)."""
    pairs = stage(pairs, "pairs")
    ids = stage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    texts = stage(by_ids(texts, ids, "doc_id", "left_semi"), "texts")
    rows = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    rows = rows.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return stage(rows.mapInArrow(_confirm, "a long, b long, linked boolean"), "verified")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id of its group), kept (doc_id is the component_id)."""
    docs = pick(docs, doc_id=id_col, text=text_col)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = stage(docs.mapInArrow(_signed, "doc_id long, n_shingles long, k1 long, k2 long, buckets array<long>, sketch array<long>"), "signed")
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    nodes = stage(linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"), F.first("sketch").alias("sketch")), "nodes")

    seats = nodes.select("rep", F.explode(F.slice("buckets", 1, FIRST_BANDS)).alias("bucket"))
    pivots = seats.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("pivot")).where("c > 1").select("bucket", "pivot")
    pivots = stage(pivots, "pivots")  # read back, it joins as a plain side, and a hot bucket's rows can be split
    pairs = seats.join(pivots, "bucket").where("pivot != rep").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    tested = _verify(pairs, docs)
    label = connected_components(tested.where("linked").select("a", "b"))

    placed = nodes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", F.coalesce("component", "rep").alias("own"), "buckets", "sketch")
    placed = stage(placed, "placed")
    held = placed.select("own", F.explode("buckets").alias("bucket")).groupBy("bucket", "own").agg(F.lit(1).alias("one"))
    mixed = stage(held.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket"), "mixed")
    groups = stage(held.join(mixed, "bucket").select("own").distinct(), "groups")  # read back, it joins as a plain side, and a hot group can be split
    members = stage(placed.join(groups, "own", "left_semi"), "members")
    marks = F.transform("buckets", lambda b: b.bitwiseAND(0x7FFFFFFF).cast("int")).alias("marks")
    seats = members.select("rep", F.posexplode("buckets").alias("band", "bucket")).join(mixed, "bucket")  # of their buckets only those where groups meet
    sides = stage(seats.join(members.select("rep", "n", "own", "sketch", marks), "rep"), "sides")
    x, y = sides.alias("x"), sides.alias("y")
    apart = F.expr("x.bucket = y.bucket and x.rep < y.rep and x.own != y.own") & _sizes("x.n", "y.n") & F.expr(f"{_agreement('x.sketch', 'y.sketch')} >= {AGREE}")
    # only in the first band that they share, or a pair is made up to BANDS times; two marks of 31 bits are equal by chance in 1 of 2^31 cases
    once = F.array_position(F.zip_with("x.marks", "y.marks", lambda p, q: p == q), True) == F.col("x.band") + 1
    pairs = x.join(y, apart & once).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    new = _verify(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), docs)
    if not new.where("linked").isEmpty():
        label = connected_components(tested.union(new).where("linked").select("a", "b"))

    to_rep = signed.join(nodes.select("k1", "k2", "rep"), ["k1", "k2"], "left")
    own = to_rep.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return own.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _sizes(a: str, b: str):
    """Sets whose sizes differ more than this cannot be linked."""
    return F.expr(f"least({a}, {b}) * {DENOMINATOR} >= greatest({a}, {b}) * {NUMERATOR}")
