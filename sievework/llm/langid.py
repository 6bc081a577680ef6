"""Language identification by compression.

For every language a zstandard raw-content dictionary is cut from labelled text. A text is reduced to lower-case
words of letters, taken in blocks of BLOCK_WORDS, each word once a block (so that a text cannot compress against its
own repetitions); each block is compressed with every dictionary, and the language of the smallest total wins.
Where the two best are closer than CLOSE, further dictionaries of other labelled text are added to the sums; a tie goes
to the more frequent language. A prediction whose margin stays under MARGIN is not accepted.

Fitting reads a bounded sample of labelled rows: about SAMPLE distinct texts a language, chosen by a hash of the text, each
whole. Their lines, in segments of SEGMENT words, go into the dictionaries by a hash of the segment until these are full (their size is the
model's). Counts are taken over all labelled rows. Prediction always reads whole texts.

Edge cases: a null text, or one without letters, is `und` with score 0 and is not accepted; without labelled rows all
are `und`; repeated rows give repeated results; a null id is carried along; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import pick, stage

UNKNOWN = "und"
SAMPLE = 500
SEGMENT = 60
DICTIONARY = 96 << 10
OPINION = 64 << 10
OPINIONS = 3
LEVEL = 6
ROWS = 500
BLOCK_WORDS = 500
CLOSE = 0.03
MARGIN = 0.002
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def blocks(text: str) -> list[bytes]:
    words = words_of(text)
    return [" ".join(dict.fromkeys(words[i : i + BLOCK_WORDS])).encode() for i in range(0, len(words), BLOCK_WORDS)]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept out of fitting: crc32 of its id as text leaves 1 when divided by 3. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def segments(text: str) -> list[str]:
    """The words of every line, at most SEGMENT of them together; of a text each once."""
    out: dict[str, None] = {}
    for line in text.split("\n"):
        words = words_of(line)
        for i in range(0, len(words), SEGMENT):
            out[" ".join(words[i : i + SEGMENT])] = None
    return list(out)


def _segments(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            found = [segments(t) for t in part.column(1).to_pylist()]
            rows = pa.array([i for i, own in enumerate(found) for _ in own], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array([x for own in found for x in own], pa.string())], ["lang", "segment"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[int, list[bytes]]]:
    """language -> (labelled rows, dictionaries). The driver receives segments of about twice the dictionaries' size a language."""
    rows = pick(labelled, text=text_col, lang=lang_col).where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}

    def chosen(df: DataFrame, value: str, wanted: dict[str, float], total: dict[str, float]) -> DataFrame:
        """The rows whose value's hash falls in its language's share, that share being wanted / total."""
        share = F.element_at(F.create_map(*[F.lit(x) for lang, n in total.items() for x in (lang, min(1.0, wanted[lang] / max(1, n)))]), F.col("lang"))
        place = F.pmod(F.xxhash64(value), F.lit(1 << 30)) / F.lit(float(1 << 30))
        return df.withColumn("place", place).where(F.col("place") < share)

    texts = chosen(rows, "text", dict.fromkeys(counts, SAMPLE), counts).select("lang", "text").distinct()
    parts = stage(texts.mapInArrow(_segments, "lang string, segment string").distinct(), "segments")
    total = {r["lang"]: r["n"] for r in parts.groupBy("lang").agg(F.sum(F.octet_length("segment")).alias("n")).collect()}
    room = DICTIONARY + OPINIONS * OPINION
    lines: dict[str, list[bytes]] = {lang: [] for lang in counts}
    held = dict.fromkeys(counts, 0)
    for r in chosen(parts, "segment", dict.fromkeys(total, 2 * room), total).orderBy("place", "lang", "segment").toLocalIterator() if total else ():
        if held[r["lang"]] < room:
            lines[r["lang"]].append(r["segment"].encode())
            held[r["lang"]] += len(lines[r["lang"]][-1]) + 1
    out = {}
    for lang, own in lines.items():
        data = b" ".join(own)
        cuts = [data[:DICTIONARY], *(data[DICTIONARY + i * OPINION :][:OPINION] for i in range(OPINIONS))]
        if len(data) > 8:
            out[lang] = (counts[lang], [c if len(c) >= OPINION // 2 else data[:DICTIONARY] for c in cuts])
    return out


class Classifier:
    def __init__(self, model: dict[str, tuple[int, list[bytes]]]):
        make = lambda data: zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.order = sorted(model, key=lambda lang: (-model[lang][0], lang))
        self.stages = [[make(model[lang][1][k]) for lang in self.order] for k in range(1 + OPINIONS)] if model else []

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, margin): 1 - best size / second size; a language learned alone has margin 1."""
        parts = blocks(text) if text and self.order else []
        if not parts or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        if len(self.order) == 1:
            return self.order[0], 1.0
        sizes = [sum(len(c.compress(p)) for p in parts) for c in self.stages[0]]
        if self._margin(sizes) < CLOSE:
            for stage in self.stages[1:]:
                sizes = [s + sum(len(c.compress(p)) for p in parts) for s, c in zip(sizes, stage, strict=True)]
        return self.order[sizes.index(min(sizes))], self._margin(sizes)

    @staticmethod
    def _margin(sizes: list[int]) -> float:
        best, second = sorted(sizes)[:2]
        return 1 - best / second


FOUND = "lang_pred string, score double, accepted boolean"


def language_of(text: Column, model: dict[str, tuple[int, list[bytes]]]) -> Column:
    """A struct of lang_pred, score (the margin, 0 to 1) and accepted. Only the text goes through Python; the row's other
    columns stay where they are. It counts as nondeterministic, so that a filter on it doesn't compute it again."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Classifier(model)
        for column in columns:
            found = []
            for at in range(0, len(column), ROWS):
                found += [own.predict(t.as_py()) for t in column.slice(at, ROWS)]
            yield pa.StructArray.from_arrays(
                [pa.array([x for x, _ in found], pa.string()), pa.array([m for _, m in found], pa.float64()), pa.array([x != UNKNOWN and m >= MARGIN for x, m in found], pa.bool_())],
                ["lang_pred", "score", "accepted"],
            )

    return F.arrow_udf(run, T._parse_datatype_string(FOUND)).asNondeterministic()(text)


def predict(docs: DataFrame, model: dict[str, tuple[int, list[bytes]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, lang_pred, score (the margin, 0 to 1) and accepted."""
    source = pick(docs, key=id_col, text=text_col)
    return source.select("key", language_of(F.col("text"), model).alias("found")).select(F.col("key").alias(id_col), "found.*")
