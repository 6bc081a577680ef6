"""Substring deduplication: suffix automata of reference shards, matching statistics of the texts routed to them.

A window is WINDOW consecutive words. A word goes if a window that covers it also starts earlier: in a text of
smaller doc_id, or earlier in the same text. One automaton of all texts is out of the question (a node costs
hundreds of bytes a word), and sending each shard of it past every text is quadratic. So the shards hold only
what is known to repeat, and a text meets only the shards that hold its own repeats:

1. Every window is represented by its least hashed run of ANCHOR words (a minimiser). Windows in a row with one
   anchor form a stretch; equal windows have equal anchors, wherever they stand. Anchors that occur once are done.
2. Stretches with equal words have one first text: later ones are repeats as a whole. The first of each (in its
   text the earliest, as the later ones are its inner repeats) is opened into its windows, whose first texts are found in the same way. All is min and count by hash, summed
   before the shuffle, then joined back, so a passage in a third of all texts is no single task's work.
3. The first places form the reference, cut into shards of at most SHARD words. Each shard becomes a suffix
   automaton in one task; the stretches that refer to it stream past, and only where the matching statistic
   reaches WINDOW does a span count. Shards with many readers are salted, in up to SALTS copies, made after their words are read.

The texts are dealt once, by a row number, into a bucketed table in the shared folder; the three joins that bring spans to texts move
the spans alone. The plan is the same at every size. Repeats inside a text are found by hash and compared word by word.
So a hash collision can remove nothing.

Edge cases: words are kept as they are; a null or blank text has no words; repeats inside a text are found in
the text alone; rows with equal doc_id, whether of equal texts or not, do not count as earlier than each other; a row with a null
doc_id is neither earlier nor later than others, only its own inner repeats go; texts of any length; empty tables; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import stage, stage_by_key
from .textkernel import U64, Words, mix, word_chunks

WINDOW = 20
ANCHOR = 6
SHARD = 20_000
READERS = 500
SALTS = 1024


def minimisers(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window: its first word, its anchor's hash and its anchor's first word (the leftmost least)."""
    grams, at = words.ngrams(ANCHOR)
    span = WINDOW - ANCHOR + 1
    count = len(words.hash) - WINDOW + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    whole = np.full(len(words.hash), U64(0xFFFFFFFFFFFFFFFF))
    whole[at] = grams
    least, where = whole[:count].copy(), np.arange(count)
    for k in range(1, span):
        less = whole[k : k + count] < least
        least[less] = whole[k : k + count][less]
        where[less] = np.flatnonzero(less) + k
    fits = np.ones(count, bool)
    for bound in words.bound[1:-1]:
        fits[max(0, bound - WINDOW + 1) : bound] = False
    start = np.flatnonzero(fits)
    return start, least[start], where[start]


def stretches(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first word, number of windows, anchor's hash, hash of all words."""
    start, least, where = minimisers(words)
    if not len(start):
        return start, start, least, least
    new = np.ones(len(start), bool)
    new[1:] = (where[1:] != where[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(start)))
    begin = start[first]
    factor = mix(np.arange(2 * WINDOW, dtype=U64), 61) | U64(1)
    content = np.zeros(len(begin), U64)
    for k in range(int(size.max()) + WINDOW - 1):
        inside = k < size + WINDOW - 1
        content[inside] += words.hash[begin[inside] + k] * factor[k]
    return begin, size, least[first], mix(content + size.astype(U64), 62)


def _stretch_rows(batches):
    """Of (row, doc_id, text)."""
    for batch in batches:
        for row, end, words in word_chunks(batch.column(2), lower=False):
            begin, size, anchor, content = stretches(words)
            text = np.searchsorted(words.bound, begin, "right") - 1
            rows, ids = (batch.column(k).slice(row, end - row).to_numpy(zero_copy_only=False)[text].astype(np.int64) for k in (0, 1))
            order = np.lexsort((begin, content, text))
            earliest = np.ones(len(order), bool)
            earliest[order[1:]] = (content[order][1:] != content[order][:-1]) | (text[order][1:] != text[order][:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(rows), pa.array(ids), pa.array((begin - words.bound[text]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(earliest)],
                ["anchor", "content", "row", "doc_id", "start", "n", "earliest"],
            )


def packed(start: Column, size: Column) -> Column:
    """A span of a text as one long: its first word and its length."""
    return F.shiftleft(start.cast("long"), 32) + size.cast("long")


def unpacked(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return parts >> 32, parts & 0xFFFFFFFF


def _window_rows(batches):
    """Of (row, doc_id, text, parts) the windows of the named stretches, each hash once a text."""
    for batch in batches:
        asked = batch.column(3)
        for row, end, words in word_chunks(batch.column(2), lower=False):
            hashes, at = words.ngrams(WINDOW)
            lists = asked.slice(row, end - row)
            begin, size = unpacked(lists.flatten().to_numpy(zero_copy_only=False))
            text = np.repeat(np.arange(end - row), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            begin = np.repeat(begin + words.bound[text], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            text = np.repeat(text, size)
            own = hashes[np.searchsorted(at, begin)]
            order = np.lexsort((begin, own, text))
            once = np.ones(len(order), bool)
            once[1:] = (own[order][1:] != own[order][:-1]) | (text[order][1:] != text[order][:-1])
            keep = order[once]
            rows, ids = (batch.column(k).slice(row, end - row).to_numpy(zero_copy_only=False)[text[keep]].astype(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[keep].view(np.int64)), pa.array(rows), pa.array(ids), pa.array((begin[keep] - words.bound[text[keep]]).astype(np.int32))], ["hash", "row", "doc_id", "start"]
            )


def _merge_runs(batches):
    """Rows sorted by row, first_row and start: neighbours that continue each other become one run, cut at shard borders."""
    held = None
    out: list[tuple] = []

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], RUN_NAMES)
        out.clear()
        return batch

    for batch in batches:
        for own, start, n, first, first_start in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            while n > 0:  # a stretch may reach over a shard's border
                room = min(n, SHARD - first_start % SHARD)
                if held and held[0] == own and held[3] == first and start - held[1] == first_start - held[4] and start <= held[1] + held[2] and first_start // SHARD == held[4] // SHARD:
                    held[2] = max(held[2], start + room - held[1])
                else:
                    if held:
                        out.append(tuple(held))
                    held = [own, start, room, first, first_start]
                start, first_start, n = start + room, first_start + room, n - room
            if len(out) >= 20_000:
                yield flush()
    if held:
        out.append(tuple(held))
    yield flush()


RUN_NAMES = ["row", "start", "n", "first_row", "first_start"]


def _pieces(batches):
    """Of (row, text, parts) the words of the parts asked of each text."""
    for batch in batches:
        asked = batch.column(2)
        for row, end, words in word_chunks(batch.column(1), lower=False):
            rows: list[tuple] = []
            for i in range(row, end):
                low, high = words.bound[i - row], words.bound[i - row + 1]
                for part in asked[i].as_py():
                    a, b = low + part["start"], min(high, low + part["stop"])
                    rows.append((part["shard_row"], part["shard"], part["salt"], part["copies"], batch.column(0)[i].as_py(), part["start"], words.word_bytes(a, b)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], PIECE_NAMES)


#: copies: 0 for a reader, else in how many salts the reference is needed
PIECE_NAMES = ["shard_row", "shard", "salt", "copies", "row", "start", "words"]


class SuffixAutomaton:
    """All substrings, word by word, of the sequences added; matching statistics of other sequences."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def add(self, words) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            if (q := nxt[last].get(w)) is not None:  # known from a sequence before
                last = q if length[q] == length[last] + 1 else self._split(last, q, w)
                continue
            cur, p = len(nxt), last
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w)
            last = cur

    def _split(self, p: int, q: int, w) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def statistics(self, words):
        """For each word the length of the longest match that ends with it."""
        nxt, link, length = self.next, self.link, self.length
        at = size = 0
        for w in words:
            while at and w not in nxt[at]:
                at = link[at]
                size = length[at]
            if (to := nxt[at].get(w)) is not None:
                at, size = to, size + 1
            yield size


def covered(statistics, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal spans [start, stop) of words in matches of at least ``window`` words."""
    spans: list[tuple[int, int]] = []
    for i, size in enumerate(statistics, 1):
        if size >= window:
            if spans and spans[-1][1] >= i - size:
                spans[-1] = (min(spans[-1][0], i - size), i)
            else:
                spans.append((i - size, i))
    return spans


def _matched(batches):
    """Pieces sorted by shard, references first: builds each shard's automaton and streams its readers past."""
    shard, automaton = None, None
    for batch in batches:
        rows: list[tuple[int, int, int]] = []
        cols = [batch.column(k).to_pylist() for k in range(7)]
        for shard_row, part, salt, copies, row, start, data in zip(*cols, strict=True):
            if shard != (shard_row, part, salt):
                shard, automaton = (shard_row, part, salt), SuffixAutomaton()
            if copies:
                automaton.add(data.split())
            else:
                rows += [(row, start + a, start + b) for a, b in covered(automaton.statistics(data.split()))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["row", "start", "stop"])


def _listed(parts: DataFrame, name: str, part: Column) -> DataFrame:
    """(row, parts): what is asked of each text, in one row."""
    return stage(parts.groupBy("row").agg(F.collect_list(part).alias("parts")), name)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """Of ``texts`` (row, doc_id, text), bucketed by row, (row, parts): spans of words that also stand in a text of smaller
    doc_id, packed."""
    texts = texts.select("row", "doc_id", "text").where("doc_id is not null")
    found = texts.mapInArrow(_stretch_rows, "anchor long, content long, row long, doc_id long, start int, n int, earliest boolean")
    again = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor")
    again = stage(again, "again")  # read back, it joins as a plain side, and a hot anchor's rows can be split
    hot = stage(found.join(again, "anchor").select("content", "row", "doc_id", "start", "n", "earliest"), "hot")
    # min_by of plain numbers is summed by hash; both take the same row, of rows with one doc_id any, and in it the earliest
    least = F.when(F.col("earliest"), F.col("doc_id"))
    first = hot.groupBy("content").agg(F.min("doc_id").alias("first_doc"), F.min_by("row", least).alias("first_row"), F.min_by("start", least).alias("first_start"), F.first("n").alias("size"), F.count(F.lit(1)).alias("c"))
    first = stage(first, "first")
    late = hot.join(first.where("c > 1").drop("c", "size"), "content").where("doc_id > first_doc").select(*RUN_NAMES)

    asked = _listed(first.select(F.col("first_row").alias("row"), "first_start", "size"), "asked", packed(F.col("first_start"), F.col("size")))
    windows = texts.join(asked, "row").select("row", "doc_id", "text", "parts").mapInArrow(_window_rows, "hash long, row long, doc_id long, start int")
    windows = stage(windows, "windows")
    opened = windows.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.min_by("row", "doc_id").alias("first_row"), F.min_by("start", "doc_id").alias("first_start"), F.count(F.lit(1)).alias("c"))
    opened = stage(opened.where("c > 1").drop("c"), "opened")
    late_too = windows.join(opened, "hash").where("doc_id > first_doc").select("row", "start", F.lit(1).alias("n"), "first_row", "first_start")

    rows = late.union(late_too).select(*[F.col(c).cast("long").alias(c) for c in RUN_NAMES])
    rows = rows.repartition("row").sortWithinPartitions("row", "first_row", F.expr("start - first_start"), "start")
    runs = stage(rows.mapInArrow(_merge_runs, ", ".join(f"{c} long" for c in RUN_NAMES)).withColumn("shard", F.expr(f"first_start div {SHARD}")), "runs")

    shards = runs.groupBy("first_row", "shard").agg(F.min("first_start").alias("start"), F.max(F.expr(f"first_start + n + {WINDOW - 1}")).alias("stop"), F.expr(f"least({SALTS}, count(1) div {READERS} + 1)").alias("salts"))
    shards = stage(shards, "shards")
    readers = runs.join(shards.where("salts > 1").select("first_row", "shard", "salts"), ["first_row", "shard"], "left").select(
        "row", "start", F.expr(f"start + n + {WINDOW - 1}").alias("stop"), F.col("first_row").alias("shard_row"), "shard", F.expr("pmod(xxhash64(row, start), coalesce(salts, 1))").alias("salt"), F.lit(0).cast("long").alias("copies")
    )
    references = shards.select(F.col("first_row").alias("row"), "start", "stop", F.col("first_row").alias("shard_row"), "shard", F.lit(0).cast("long").alias("salt"), F.col("salts").cast("long").alias("copies"))
    needed = _listed(readers.union(references), "needed", F.struct("start", "stop", "shard_row", "shard", "salt", "copies"))
    kinds = "shard_row long, shard long, salt long, copies long, row long, start long, words binary"
    pieces = texts.join(needed, "row").select("row", "text", "parts").mapInArrow(_pieces, kinds)
    pieces = pieces.withColumn("salt", F.explode(F.when(F.col("copies") > 1, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array("salt"))))
    pieces = pieces.select(PIECE_NAMES).repartition("shard_row", "shard", "salt").sortWithinPartitions("shard_row", "shard", "salt", F.col("copies").desc())
    spans = pieces.mapInArrow(_matched, "row long, start long, stop long").distinct()
    return _listed(spans, "spans", packed(F.col("start"), F.col("stop") - F.col("start")))


def inner_repeats(words: Words, low: int, high: int) -> np.ndarray:
    """Windows of one text that start earlier in it, as indexes of first words from ``low`` on."""
    count = high - low - WINDOW + 1
    if count <= 1:
        return np.zeros(0, np.int64)
    total = np.zeros(count, U64)
    factor = mix(np.arange(WINDOW, dtype=U64), 63) | U64(1)
    for k in range(WINDOW):
        total += words.hash[low + k : low + k + count] * factor[k]
    total = mix(total, 64)
    order = np.argsort(total, kind="stable")
    same = np.flatnonzero(total[order][1:] == total[order][:-1]) + 1
    if not len(same):
        return same
    numbers: dict[bytes, int] = {}
    word = np.array([numbers.setdefault(w, len(numbers)) for w in words.word_bytes(low, high).split()], np.int64)
    later, before = order[same], order[same - 1]
    equal = np.ones(len(same), bool)
    for k in range(WINDOW):
        equal &= word[later + k] == word[before + k]
    if not equal.all():  # windows of other words with one hash stand between
        seen: set[bytes] = set()
        own = (word[i : i + WINDOW].tobytes() for i in range(count))
        return np.array([i for i, w in enumerate(own) if w in seen or seen.add(w)], np.int64)
    return np.sort(later)


def _cut(batches):
    """Of (key, text, parts): the counts, the kept words, and the text without the removed words."""
    for batch in batches:
        asked = batch.column(2)
        for row, end, words in word_chunks(batch.column(1), lower=False):
            counts, removed, kept, left = [], [], [], []
            for i in range(row, end):
                low, high = int(words.bound[i - row]), int(words.bound[i - row + 1])
                edge = np.zeros(high - low + 1, np.int64)
                start, size = unpacked(np.array(asked[i].as_py() or (), np.int64))
                np.add.at(edge, start, 1)
                np.add.at(edge, start + size, -1)
                inner = inner_repeats(words, low, high)
                np.add.at(edge, inner, 1)
                np.add.at(edge, inner + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
                counts.append(high - low)
                removed.append(int(gone.sum()))
                own = words.data[words.offset[i - row] : words.offset[i - row + 1]]
                if not removed[-1]:
                    whole = own.tobytes()
                    left.append(whole)
                    kept.append(b" ".join(whole.split()))
                    continue
                base = int(words.offset[i - row])
                stay = np.flatnonzero(~gone)
                starts, ends = words.start[low + stay] - base, words.end[low + stay] - base
                data = own.tobytes()
                kept.append(b" ".join([data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]))
                mask = np.zeros(len(own) + 1, np.int64)  # a removed word goes with the white space behind it
                away = np.flatnonzero(gone)
                np.add.at(mask, words.start[low + away] - base, 1)
                behind = np.append(words.start, len(words.data))[low + away + 1] - base
                np.add.at(mask, np.minimum(behind, len(own)), -1)
                left.append(own[np.cumsum(mask[:-1]) == 0].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, end - row), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(left, pa.binary()).cast(pa.string()), batch.column(3).slice(row, end - row)],
                ["doc_id", "n_words", "n_removed", "kept_words", "text", "carried"],
            )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_words (binary, joined by one space), the text without the removed words, and
    the columns named in ``carry`` as they are."""
    carry = carry or []
    carried = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("carried")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), carried)
    texts = stage_by_key(texts, "row", "dealt")
    schema = T.StructType([*T._parse_datatype_string("doc_id long, n_words long, n_removed long, kept_words binary, text string").fields, T.StructField("carried", texts.schema["carried"].dataType)])
    out = texts.join(repeated_spans(texts), "row", "left").select("doc_id", "text", "parts", "carried").mapInArrow(_cut, schema)
    return out.select(F.col("doc_id").alias(id_col), "n_words", "n_removed", "kept_words", "text", *[F.col(f"carried.`{c}`") for c in carry])
