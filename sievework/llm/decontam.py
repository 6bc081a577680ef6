"""Benchmark decontamination by size-partitioned MinHash containment search.

Containment of a short item in a long text cannot be read from one signature a text: the Jaccard similarity of the two
falls with the text's length. So items are partitioned by size, and for each size class a text is taken in overlapping
blocks of twice that size: whatever the text's length, a block that holds an item has a similarity of at
least t / (4 + 1 - t). Signatures are one-permutation MinHash with BINS bins for each shingle of the class: an item's
signature is the least hash of every bin, and a block is a candidate if one of its own least hashes equals that of the
item. With about one shingle a bin, an item of q shingles at containment t is missed with a chance of some
(1 - 0.85 t)^q; for items of under FEW shingles every hit is a candidate and nothing is missed. Candidates are verified by exact
containment of their shingle set in the whole text.

The index is sorted arrays, some 30 bytes a word. It goes to the tasks in groups of about GROUP_WORDS words, so its size is bounded; a
benchmark of one group takes one scan of the texts, a larger one is searched group by group, and the driver holds one at a time.

Edge cases: shingles are as in ``textkernel`` (five words, A-Z lower-cased; fewer words give one shingle, the whole
sequence); an item or text without words (null, empty) matches nothing; repeated items and rows give repeated results; a null
id is an id like others, and verdicts are on rows; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import pick, stage
from .textkernel import U64, shingles, word_chunks

CONTAINMENT = 0.75
SHINGLE = 5
BINS = 4
GROUP_WORDS = 4_000_000
FEW = 8
FILTER_BITS = 20


class ContainmentIndex:
    """Signatures of the items, by size class."""

    def __init__(self, items: list[tuple[object, str]]):
        self.items: list[tuple[object, np.ndarray]] = []
        column = pa.array([t for _, t in items], pa.string())
        for row, _, words in word_chunks(column, lower=True):
            own, bound = shingles(words, SHINGLE)
            self.items += [(items[row + i][0], own[bound[i] : bound[i + 1]]) for i in range(len(bound) - 1) if bound[i + 1] > bound[i]]
        entries = [np.zeros((3, 0), U64)]  # least hash, class, item
        for i, (_, own) in enumerate(self.items):
            size = self.size_class(len(own))
            bins = own >> self.shift(size)
            first = np.ones(len(own), bool)
            first[1:] = bins[1:] != bins[:-1]  # sorted: the first of a bin is its least
            if len(own) < FEW:
                first[:] = True
            least = own[first]
            entries.append(np.stack([least, np.full(len(least), size, U64), np.full(len(least), i, U64)]))
        self.keys, self.sizes, self.owners = np.concatenate(entries, axis=1)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.sizes, self.owners = self.keys[order], self.sizes[order].astype(np.int8), self.owners[order].astype(np.int32)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys & U64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    @staticmethod
    def size_class(shingle_count: int) -> int:
        return (shingle_count - 1).bit_length()

    @staticmethod
    def shift(size: int) -> np.uint64:
        return U64(64 - (size + BINS.bit_length() - 1))

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes that stand in some item's signature."""
        at = np.flatnonzero(self.filter[(hashes & U64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        if len(at):
            place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            at = at[self.keys[place] == hashes[at]]
        return at

    def candidates(self, sequence: np.ndarray, hits: np.ndarray) -> set[int]:
        """Items that share a least hash with a block of the text; ``hits`` are the places worth a look."""
        found: set[int] = set()
        for place in hits.tolist():
            h = int(sequence[place])
            low, high = (int(np.searchsorted(self.keys, sequence[place], side)) for side in ("left", "right"))
            for size, item in zip(self.sizes[low:high].tolist(), self.owners[low:high].tolist(), strict=True):
                if item in found:
                    continue
                if len(self.items[item][1]) < FEW:
                    found.add(item)
                    continue
                step, shift = 1 << size, self.shift(size)
                for block in {place // step - 1, place // step}:
                    own = sequence[max(0, block * step) : (block + 2) * step]
                    if not ((own < U64(h)) & (own >> shift == U64(h) >> shift)).any():
                        found.add(item)
                        break
        return found


    def search(self, column: pa.Array, containment: float) -> list[tuple[int, object, int, int]]:
        """Of the texts of ``column``: place, item, shared shingles, shingles of the item."""
        found: list[tuple] = []
        for row, _, words in word_chunks(column, lower=True):
            sequence, at = words.ngrams(SHINGLE)
            bound = np.searchsorted(at, words.bound)
            hits = self.hits(sequence) if len(self.keys) else at[:0]
            short = np.flatnonzero((np.diff(bound) == 0) & (np.diff(words.bound) > 0))
            texts = np.unique(np.searchsorted(bound, hits, "right") - 1)
            for i in [*texts.tolist(), *(short.tolist() if len(self.keys) else ())]:
                if bound[i + 1] > bound[i]:
                    own = sequence[bound[i] : bound[i + 1]]
                    places = hits[np.searchsorted(hits, bound[i]) : np.searchsorted(hits, bound[i + 1])] - bound[i]
                else:
                    own = shingles_of(words, i)
                    places = self.hits(own)
                for item in sorted(self.candidates(own, places)):
                    key, wanted = self.items[item]
                    shared = int(np.isin(wanted, own).sum())
                    if shared >= containment * len(wanted):
                        found.append((row + i, key, shared, len(wanted)))
        return found


def _groups(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[int, DataFrame, Iterator[list[tuple[object, str]]]]:
    """How many groups, the items, and the groups one after another."""
    items = pick(benchmark, item=item_col, text=text_col).where("text is not null")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    groups = words // GROUP_WORDS + 1

    def each():
        for group in range(groups):
            yield [(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == group).orderBy("item", "text").toLocalIterator()]

    return groups, items, each()


def find_contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """A row for each text and each item whose shingles it holds to at least ``containment``: doc_id, item_id, n_shared, n_item."""
    source = pick(docs, key=id_col, text=text_col)
    groups, items, each = _groups(benchmark, item_col, item_text_col)
    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("item", items.schema["item"].dataType), *T._parse_datatype_string("n_shared long, n_item long").fields])
    item_type = T.StructType([schema["item"]])
    out = None
    for rows in each:
        part = source.mapInArrow(_searcher(rows, containment, item_type), schema)
        part = stage(part, "contained") if groups > 1 else part
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"key": id_col, "item": item_col})


def without_contained(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` that hold no item, whole. Only the texts go through Python."""
    groups, _, each = _groups(benchmark, item_col, item_text_col)
    for rows in each:
        docs = docs.where(~_holds_any(rows, containment)(F.col(f"`{text_col}`")))
        docs = stage(docs, "uncontained") if groups > 1 else docs
    return docs


def _holds_any(rows, containment):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = ContainmentIndex(rows)
        for column in columns:
            held = np.zeros(len(column), bool)
            held[[f[0] for f in index.search(column, containment)]] = True
            yield pa.array(held)

    return F.arrow_udf(run, T.BooleanType()).asNondeterministic()


def _searcher(rows, containment, item_type):
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        index = ContainmentIndex(rows)
        kind = to_arrow_type(item_type["item"].dataType)
        for batch in batches:
            found = index.search(batch.column(1), containment)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], kind), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())],
                ["key", "item", "n_shared", "n_item"],
            )

    return run


def shingles_of(words, i: int) -> np.ndarray:
    """The one shingle of a text of fewer words than a shingle has."""
    from .textkernel import sequence_hash

    return sequence_hash(words.hash[words.bound[i] : words.bound[i + 1]], 9)[None]
