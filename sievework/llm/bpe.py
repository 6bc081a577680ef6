"""BPE encoding by prefix-sharing trie traversal.

The distinct words of a batch of texts go into a byte trie. A depth-first walk carries, for every node,
the last token of the encoding of the bytes on its path: among the tokens that end the path it is the one
that is compatible with the last token of the path before it, and there is exactly one. A prefix shared by
many words is so encoded once, and a word's ids are read off backwards from its node.

Edge cases: a null text counts as empty (no ids, empty decoded text); a text of any length is cut into words
block by block; words longer than ``LONG_WORD`` bytes are walked outside the trie with the same rule; repeated
rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .staging import pick

LONG_WORD = 1024
GOTO = COMPATIBLE = 1_000_000
CACHE_WORDS = 600_000
BLOCK_WORDS = 200_000
BATCH_CHARS = 1_500_000
SCHEMA = "n_tokens long, ids binary, decoded string"
#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind; L, N and S stand for Unicode
#: letters, numbers and white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
#: Below this code point all Unicode versions agree on the pattern's classes; other texts are split by the library.
STABLE_END = 0x530
UNSTABLE = re.compile(f"[^\\x00-\\u{STABLE_END - 1:04x}]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def stable_split() -> str:
    """SPLIT with its classes spelt out for the code points below STABLE_END."""
    space = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0}
    classes = {"S": space, **{k: {c for c in range(STABLE_END) if unicodedata.category(chr(c))[0] == k} for k in "LN"}}

    def spell(codes: set[int]) -> str:
        starts = sorted(c for c in codes if c - 1 not in codes)
        ends = sorted(c for c in codes if c + 1 not in codes)
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))

    out, inside = [], False
    for c in SPLIT:
        inside = c == "[" or (inside and c != "]")
        out.append(spell(classes[c]) if inside and c in classes else c)
    return "".join(out)


class TrieEncoder:
    """Encodes and decodes with one vocabulary file. Inside, a token is its rank: 0-255 the bytes, then merges in order."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocabulary = spec["model"]["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        of_byte = {b: c for c, b in letters.items()}
        names = [of_byte[b] for b in range(256)] + [a + b for a, b in merges]
        rank = {}
        for i, name in enumerate(names):
            if name in rank:
                raise ValueError("two merges make one token; last-token states would be ambiguous")
            rank[name] = i
        self.parts = [(i, i) for i in range(256)] + [(rank[a], rank[b]) for a, b in merges]
        self.merged = {(rank[a], rank[b]): 256 + i for i, (a, b) in enumerate(merges)}
        self.length = [1] * 256
        for a, b in self.parts[256:]:
            self.length.append(self.length[a] + self.length[b])
        self.rank_of = {raw(name): i for name, i in rank.items()}
        self.id_bytes = [int(vocabulary[name]).to_bytes(4, "little") for name in names]
        self.token_bytes = {int(i): raw(name) for name, i in vocabulary.items()}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.token_bytes |= {i: s.encode() for s, i in self.added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.split_words = re.compile(stable_split())
        self._suffix_automaton_of_tokens()
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.compatible: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` side by side: no merge across their border comes before
        the later of the merges that made the two pieces at the border. Pieces are undone from the latest back."""
        key = left << 20 | right
        known = self.compatible.get(key)
        if known is None:
            bound = len(self.parts)  # merges from here on would come too late to cross the border
            known = True
            while True:
                if self.merged.get((left, right), bound) < bound:
                    known = False
                    break
                if left < 256 and right < 256:
                    break
                if left > right:  # the left piece was made last; before that its right half stood at the border
                    bound, left = left, self.parts[left][1]
                else:  # on a tie the left one merges first, as it stands before
                    bound, right = right + 1, self.parts[right][0]
            if len(self.compatible) > COMPATIBLE:
                self.compatible.clear()
            self.compatible[key] = known
        return known

    def _suffix_automaton_of_tokens(self) -> None:
        """Aho-Corasick over the vocabulary: for a state, the tokens that end there, longest first."""
        child, fail, chain = [{}], [0], [()]
        for data, token in self.rank_of.items():
            at = 0
            for b in data:
                nxt = child[at].get(b)
                if nxt is None:
                    nxt = child[at][b] = len(child)
                    child.append({})
                    fail.append(0)
                    chain.append(())
                at = nxt
            chain[at] = (token,)
        level = list(child[0].values())
        while level:  # breadth first: what a state falls back to is complete before it
            below = []
            for at in level:
                chain[at] += chain[fail[at]]
                for b, nxt in child[at].items():
                    back = fail[at]
                    while back and b not in child[back]:
                        back = fail[back]
                    fail[nxt] = child[back].get(b, 0)
                    below.append(nxt)
            level = below
        self.child, self.fail, self.chain, self.goto = child, fail, chain, {}

    def step(self, at: int, b: int) -> int:
        """The state after byte ``b``; kept, so that fallbacks are followed once."""
        key = at << 8 | b
        while at and b not in self.child[at]:
            at = self.fail[at]
        if len(self.goto) > GOTO:
            self.goto.clear()
        self.goto[key] = at = self.child[at].get(b, 0)
        return at

    def long_word(self, word: bytes) -> bytes:
        """As the walk does it, but the ids are read off backwards at the end only."""
        last, at = [-1], 0
        for n, b in enumerate(word, 1):
            at = self.step(at, b)
            for token in self.chain[at]:
                start = n - self.length[token]
                if start == 0 or self.fits(last[start], token):
                    break
            last.append(token)
        out, n = [], len(word)
        while n:
            out.append(self.id_bytes[last[n]])
            n -= self.length[last[n]]
        return b"".join(reversed(out))

    def learn(self, words: set[str]) -> None:
        """Adds the encodings of ``words`` to the cache by one depth-first walk over their trie.

        The trie is laid out as its words in byte order, which is the order in which a depth-first walk meets
        them: the nodes that a word shares with those before it are the common prefix with the last one, and
        their states (last token, ids so far) are still on the stack. Only the nodes below are computed.
        """
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        cache, goto, chain, length, compatible = self.cache, self.goto.get, self.chain, self.length, self.compatible.get
        id_bytes, step, fits = self.id_bytes, self.step, self.fits
        state, last, ids = [0] * (LONG_WORD + 1), [-1] * (LONG_WORD + 1), [b""] * (LONG_WORD + 1)
        before = b""
        for data, word in sorted((w.encode(), w) for w in words):
            n = len(data)
            if n > LONG_WORD:
                cache[word] = self.long_word(data)
                continue
            shared, most = 0, min(n, len(before))
            if before[:most] == data[:most]:
                shared = most
            else:
                while before[shared] == data[shared]:
                    shared += 1
            at = state[shared]
            for d in range(shared, n):
                b = data[d]
                key = at << 8 | b
                at = goto(key)
                if at is None:
                    at = step(key >> 8, b)
                d += 1
                for token in chain[at]:
                    start = d - length[token]
                    if start == 0:
                        break
                    known = compatible(last[start] << 20 | token)
                    if known or (known is None and fits(last[start], token)):
                        break
                state[d], last[d], ids[d] = at, token, ids[start] + id_bytes[token]
            cache[word] = ids[n]
            before = data

    def words(self, text: str) -> Iterator[str]:
        if UNSTABLE.search(text) is None:
            return (m.group() for m in self.split_words.finditer(text))
        return (text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text))

    def pieces(self, text: str) -> Iterator[list[str] | bytes]:
        """Blocks of words, and the ids of added tokens, in order."""
        for part in self.split_added.split(text) if self.split_added else [text]:
            if part in self.added:
                yield self.added[part].to_bytes(4, "little")
            elif UNSTABLE.search(part) is None and len(part) < BATCH_CHARS:
                yield self.split_words.findall(part)
            else:
                words = self.words(part)
                while block := list(islice(words, BLOCK_WORDS)):
                    yield block

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, per text."""
        row = 0
        while row < len(texts):
            size, end = 0, row
            while end < len(texts) and (end == row or size + len(texts[end]) <= BATCH_CHARS):
                size += len(texts[end])
                end += 1
            if size > 2 * BATCH_CHARS:  # one long text, block by block
                yield b"".join(self.ids_of(x) for x in self.pieces(texts[row]))
            else:
                split = [list(self.pieces(t)) for t in texts[row:end]]
                new = {w for t in split for x in t if not isinstance(x, bytes) for w in x if w not in self.cache}
                if new:
                    self.learn(new)
                for t in split:
                    yield b"".join(self.ids_of(x) for x in t)
            row = end

    def ids_of(self, piece: list[str] | bytes) -> bytes:
        if isinstance(piece, bytes):
            return piece
        try:
            return b"".join(map(self.cache.__getitem__, piece))
        except KeyError:
            self.learn(set(piece))
            return b"".join(map(self.cache.__getitem__, piece))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_encoders: dict[str, TrieEncoder] = {}


def encoder(path: str | None) -> TrieEncoder:
    """One per Python worker and vocabulary."""
    path = path or default_vocabulary()
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per row: the id, n_tokens, ids (binary, little-endian unsigned 32-bit) and the text decoded from the ids."""
    source = pick(docs, key=id_col, text=text_col)

    def run(batches):
        own = encoder(vocabulary)
        for batch in batches:
            key, column = batch.column(0), batch.column(1)
            for at in range(0, len(batch), 1000):
                texts = [t or "" for t in column.slice(at, 1000).to_pylist()]
                ids = list(own.encode_batch(texts))
                yield pa.RecordBatch.from_arrays(
                    [key.slice(at, 1000), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.string())],
                    ["key", "n_tokens", "ids", "decoded"],
                )

    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), *T._parse_datatype_string(SCHEMA).fields])
    return source.mapInArrow(run, schema).withColumnRenamed("key", id_col)
