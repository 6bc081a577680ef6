"""Cross-entropy difference: matched target and background n-gram models over one vocabulary.

Tokens are lower-cased words. Both models count unigrams and bigrams exactly, each by its own 64-bit hash, over all texts: the
background over every text, the target over the texts marked as wanted. The models are matched: the background's counts are scaled to the
target's number of tokens, which is what samples of the target's size hold on average, so that the models differ in what they have seen
and not in how much. They share one vocabulary, all distinct words of all texts, V of them. A word's probability is its bigram's relative
frequency, smoothed towards its unigram's with weight MU, and that towards 1 / V with weight ALPHA * V.

No text scores itself: its own counts are taken out of the background, and out of the target if it is wanted, before it is scored. A text
whose n-grams stand nowhere else is so judged by its words alone, while one of which another copy stands in the corpus is not. A text's score is the
mean over its tokens of the target's loss less the background's: low where a text looks like the wanted ones.

Counts grow with the input, so no task and not the driver holds them all. Texts are packed into chunks, one row each. A chunk
sends its distinct n-grams, sorted and cut into ranges of the hash, with its own counts; the task of a range adds up all chunks'
and answers each with the sums, in the order of its question. The chunk, followed by its answers, makes the same sorted
list again and scores its texts. A frequent n-gram is one entry a chunk, however often it stands in it. A task holds one chunk
with its answers, or one range, whatever the number of partitions: rows reach Python in batches of BATCH_BYTES, chunks are
written in row groups of GROUP_BYTES, the words of a chunk are hashed a few texts at a time and a range is added up in pieces.

Edge cases: a text without words (null, empty) has 0 tokens and null losses and score; without wanted texts the
background too is scaled to nothing, and all scores are 0; repeated rows count as often as they stand; a null id is never wanted; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import mark, pick, release, stage
from .textkernel import U64, mix, word_chunks

MU = 4.0
ALPHA = 0.1
CHUNK = 4 << 20
RANGES = 256
PIECE = 1 << 19
BATCH_BYTES = 8 << 20
GROUP_BYTES = 16 << 20
BROADCAST_IDS = 1_000_000
LOSSES = "n_tokens long, target_loss double, background_loss double"


def tokens(words: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unigrams (even), bigrams of a word and the one before (odd), and which words have none before them."""
    pair = np.zeros(len(words), U64)
    pair[1:] = mix(words[:-1] * U64(0x9E3779B97F4A7C15) + words[1:], 71) | U64(1)
    first = np.zeros(len(pair) + 1, bool)
    first[bound] = True
    return words & ~U64(1), pair, first[:-1]


def _chunks(batches):
    """Rows (doc_id, text, wanted) packed into one row a chunk, of CHUNK bytes of whole texts."""
    held, size = [], 0

    def flush():
        rows = pa.Table.from_batches(held).combine_chunks()
        out = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), c.chunk(0)) for c in rows.columns]
        return pa.RecordBatch.from_arrays(out, ["ids", "texts", "wanted"])

    for batch in batches:
        if not batch.num_rows:
            continue
        total = size + np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cut = np.flatnonzero(np.diff(total // CHUNK, prepend=size // CHUNK)) + 1
        begin = 0
        for end in cut.tolist():
            held.append(batch.slice(begin, end - begin))
            yield flush()
            held, begin = [], end
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
        size = int(total[-1])
    if held:
        yield flush()


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte of equal weight, compressed: high bytes that are mostly zero take no room."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * 8, codec="zstd", asbytes=True), np.uint8)
    return planes.reshape(8, n).T.copy(order="C").view(kind).reshape(n)


class Chunk:
    """A chunk's texts as tokens, and its distinct n-grams in order with the places of the tokens' own."""

    def __init__(self, texts: pa.Array):
        parts = [(words.hash, np.diff(words.bound)) for _, _, words in word_chunks(texts, lower=True)]
        self.size = np.concatenate([size for _, size in parts])
        self.bound = np.append(0, np.cumsum(self.size))
        one, pair, self.first = tokens(np.concatenate([words for words, _ in parts]), self.bound)
        self.keys, at = np.unique(np.concatenate([one, pair[~self.first]]), return_inverse=True)
        self.one, self.pair = at[: len(one)], np.zeros(len(one), np.int64)
        self.pair[~self.first] = at[len(one) :]

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        at = np.concatenate([self.one[chosen], self.pair[chosen & ~self.first]])
        return np.bincount(at, minlength=len(self.keys))

    @cached_property
    def places(self) -> np.ndarray:
        """Per token its bigram's place, or one past the last."""
        return np.where(self.first, len(self.keys), self.pair)

    @cached_property
    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Per token how often its word, and its bigram, stands in its own text."""
        text = np.repeat(np.arange(len(self.size)), self.size) * np.int64(len(self.keys) + 1)
        out = []
        for places in (self.one, self.places):
            _, at, n = np.unique(text + places, return_inverse=True, return_counts=True)
            out.append(n[at])
        return out[0], out[1]

    def losses(self, counts: np.ndarray, scale: float, total: int, vocabulary: int, without: np.ndarray) -> np.ndarray:
        """Per token in nats, from ``counts`` by n-gram of ``total`` tokens; of the texts marked in ``without`` the own counts
        are taken out first. All is scaled then."""
        out = np.repeat(without, self.size)
        single = (counts[self.one] - out * self.own[0]) * scale
        double = (np.append(counts, 0)[self.places] - out * ~self.first * self.own[1]) * scale
        # the word before stands in the same text, and is counted there as often
        rest = (total - np.repeat(without * self.size, self.size)) * scale
        p = (single + ALPHA) / (rest + ALPHA * vocabulary)
        before = np.zeros(len(single))
        before[1:] = single[:-1]
        return -np.log(np.where(self.first, p, (double + MU * p) / (before + MU)))


def _questions(bits: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(batch.column(1)[i].values)
                wanted = np.repeat(batch.column(2)[i].values.to_numpy(zero_copy_only=False).astype(bool), chunk.size)
                target, background = chunk.counts(wanted), chunk.counts(np.ones(len(wanted), bool))
                part = (chunk.keys >> U64(64 - bits)).astype(np.int64)
                begin = np.flatnonzero(np.diff(part, prepend=-1))
                end = np.append(begin[1:], len(part))
                rows = []
                for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
                    own = (int(wanted.sum()), len(wanted)) if not k else (0, 0)
                    rows.append((int(part[a]), batch.column(0)[i].as_py(), b - a, packed(np.diff(chunk.keys[a:b], prepend=U64(0))), packed(target[a:b]), packed(background[a:b]), *own))
                yield pa.RecordBatch.from_pylist([dict(zip(QUESTION.names, r, strict=True)) for r in rows], QUESTION)

    return run


QUESTION = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("target", pa.binary()), ("background", pa.binary()), ("n_target", pa.int64()), ("n_background", pa.int64())])
ANSWER = pa.schema([*(QUESTION.field(c) for c in ("part", "chunk", "n", "target", "background", "n_target", "n_background")), ("n_words", pa.int64())])


def _answers(batches):
    """Questions sorted by range: the sums over all chunks of each n-gram, to each chunk in its order."""
    held: list[dict] = []

    def flush():
        keys = [np.cumsum(unpacked(r.pop("keys"), r["n"], U64), dtype=U64) for r in held]
        n_words = 0
        values = {c: [unpacked(r.pop(c), r["n"]) for r in held] for c in ("target", "background")}
        low, high = min(int(k[0]) for k in keys), max(int(k[-1]) for k in keys)
        pieces = sum(map(len, keys)) // PIECE + 1
        # equal n-grams fall into one piece, as all rows are cut at the same hashes
        cuts = np.array([low + (high - low) * i // pieces for i in range(1, pieces)], U64)
        ends = np.array([[*np.searchsorted(k, cuts), len(k)] for k in keys])
        begins = np.zeros(len(keys), np.int64)
        for end in ends.T:
            distinct, at = np.unique(np.concatenate([k[a:b] for k, a, b in zip(keys, begins, end, strict=True)]), return_inverse=True)
            n_words += int((distinct & U64(1) == 0).sum())
            bound = np.cumsum([0, *(end - begins)])
            for c in values.values():
                sums = np.zeros(len(distinct), np.int64)
                np.add.at(sums, at, np.concatenate([v[a:b] for v, a, b in zip(c, begins, end, strict=True)]))
                sums = sums[at]
                for k, (a, b) in enumerate(zip(begins, end, strict=True)):
                    c[k][a:b] = sums[bound[k] : bound[k + 1]]
            begins = end
        del keys
        for k, r in enumerate(held):
            r |= {c: packed(v[k]) for c, v in values.items()} | {"n_words": 0 if k else n_words}
        return pa.RecordBatch.from_pylist(held, ANSWER)

    for batch in batches:
        for r in batch.to_pylist():
            if held and held[0]["part"] != r["part"]:
                yield flush()
                held = []
            held.append(r)
    if held:
        yield flush()


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in schema)


def score(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, n_tokens, target_loss, background_loss and score. ``wanted`` holds the ids of the target's texts."""
    source = pick(docs, doc_id=id_col, text=text_col)
    ids = pick(wanted, doc_id=wanted.columns[0]).where("doc_id is not null").distinct().withColumn("wanted", F.lit(True))
    marked = source.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left").select("doc_id", "text", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    key = source.schema["doc_id"].dataType
    kinds = T.StructType([T.StructField("ids", T.ArrayType(key)), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("wanted", T.ArrayType(T.BooleanType()))])
    since = mark()
    groups = {"parquet_block_size": GROUP_BYTES}
    chunks = stage(marked.mapInArrow(_chunks, kinds).withColumn("chunk", F.monotonically_increasing_id()), "chunks", BATCH_BYTES, **groups, parquet_page_size_row_check_min=1)
    bits = max(RANGES, chunks.count() // 4).bit_length() - 1
    asked = chunks.select("chunk", "texts", "wanted").mapInArrow(_questions(bits), _ddl(QUESTION))
    answers = stage(asked.repartition("part").sortWithinPartitions("part").mapInArrow(_answers, _ddl(ANSWER)), "answers", BATCH_BYTES, **groups)
    *total, vocabulary = [x or 0 for x in answers.agg(F.sum("n_target"), F.sum("n_background"), F.sum("n_words")).first()]
    scale = (1.0, total[0] / total[1] if total[1] else 1.0)

    def scores(row: pa.RecordBatch, replies: list[tuple]) -> pa.RecordBatch:
        ids, texts, wanted = (row.column(c)[0].values for c in ("ids", "texts", "wanted"))
        chunk = Chunk(texts)
        wanted = wanted.to_numpy(zero_copy_only=False).astype(bool)
        mean = []
        for k in range(2):
            counts = np.concatenate([np.zeros(0, np.int64), *(unpacked(r[k + 1], r[0]) for r in replies)])
            losses = chunk.losses(counts, scale[k], total[k], vocabulary, wanted | bool(k)) if len(counts) else np.zeros(0)
            sums = np.append(0.0, np.cumsum(losses))
            mean.append(pa.array((sums[chunk.bound[1:]] - sums[chunk.bound[:-1]]) / np.maximum(chunk.size, 1), mask=chunk.size == 0))
        return pa.RecordBatch.from_arrays([ids, pa.array(chunk.size.astype(np.int64)), *mean], ["key", "n_tokens", "target_loss", "background_loss"])

    def run(batches):
        row, replies = None, []
        for batch in batches:
            reply = [batch.column(c) for c in ("n", "target", "background")]
            for i, part in enumerate(batch.column("part").to_pylist()):
                if part >= 0:
                    replies.append(tuple(c[i].as_py() for c in reply))
                    continue
                if row:
                    yield scores(row, replies)
                row, replies = batch.slice(i, 1), []
        if row:
            yield scores(row, replies)

    schema = T.StructType([T.StructField("key", key), *T._parse_datatype_string(LOSSES).fields])
    questions = chunks.select("chunk", F.lit(-1).cast("long").alias("part"), "ids", "texts", "wanted")
    parts = questions.unionByName(answers.select("chunk", "part", "n", "target", "background"), allowMissingColumns=True)
    until = mark()
    scored = stage(parts.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(run, schema), "scores", BATCH_BYTES)
    release(since, until)
    return scored.withColumnRenamed("key", id_col).withColumn("score", F.col("target_loss") - F.col("background_loss"))
