"""Byte-level BPE by dynamic programming over prefixes.

A byte string has one valid token sequence. A sequence is valid if and only if each neighbouring pair is, and
its prefixes are valid for the prefixes of the bytes. So every prefix has one valid last token: the token that
ends there and may follow the last token of the prefix before it. ``Prefixes`` keeps that table. Bytes can be
appended at the cost of the new ones, and after an edit the table is rebuilt from the edit until it agrees
with the old one over the longest token; the rest is carried over. The tokens that end at a byte come from an
automaton over all tokens, whose suffix links lead from the longest to the shortest.

Texts are cut by the tokenizer's pattern and each match is encoded by itself; a match that is a token as a
whole is that token. Null texts count as empty and have no ids; rows and further columns pass through.
The vocabulary is a file of fixed size: the driver reads it and broadcasts it.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from struct import pack

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_VOCABULARY_BYTES = 64 << 20
#: Bytes that the two generations of each cache may take, and what an entry takes besides its content.
CACHED_PIECES = 96 << 20
CACHED_PAIRS = 48 << 20
ENTRY_BYTES = 200
CACHED_LENGTH = 48
#: Documents encoded before a batch of results is handed on.
ROWS = 256


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        content = lines.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError("vocabulary too large to broadcast")
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Recent:
    """A mapping of two generations: when the young one is full it becomes the old one, and what is asked for returns."""

    def __init__(self, size: int):
        self.size, self.held, self.young, self.old = size // 2, 0, {}, {}

    def keep(self, key, value, content: int = 0) -> None:
        self.held += ENTRY_BYTES + content
        if self.held > self.size:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = value

    def again(self, key, content: int = 0):
        """A value that only the old generation has."""
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value, content)
        return value


class Vocabulary:
    """Ranks with the memoised answers to which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: tokens that merging their own bytes gives; others occur only as whole matches
        self.endings = ahocorasick.Automaton()
        #: the two tokens that the last merge of a token joins; bytes have none
        self.parts: dict[int, tuple[int, int] | None] = {}
        for token, rank in ranks.items():
            parts = self.merged(token, 2)
            if len(token) == 1 or len(parts) == 2 and all(p in ranks for p in parts):
                self.parts[rank] = (ranks[parts[0]], ranks[parts[1]]) if len(token) > 1 else None
                self.endings.add_word(token.decode("latin-1"), (rank, len(token)))
        self.endings.make_automaton()
        self.pairs = Recent(CACHED_PAIRS)
        self.ordered = all(rank > max(parts) for rank, parts in self.parts.items() if parts)

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """Merges by lowest rank, leftmost first, down to ``least`` parts; used on single tokens and pairs only."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > least:
            ranked = [(r, i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a + b)) is not None]
            if not ranked:
                break
            at = min(ranked)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, pair: int) -> bool:
        """Whether two tokens, the first one 32 bits up, are the encoding of their joined bytes."""
        known = self.pairs.again(pair)
        if known is None:
            a, b = pair >> 32, pair & 0xFFFFFFFF
            both = [self.tokens[a], self.tokens[b]]
            known = self.stays(a, b) if self.ordered else self.merged(b"".join(both)) == both
            self.pairs.keep(pair, known)
        return known

    def stays(self, a: int, b: int) -> bool:
        """Whether the border between two tokens is never merged away, when every merge has a rank above its parts.

        Merges then come in the order of their ranks: tokens that ever lie side by side are the parts of the token that
        joins them, so a merge makes only later ones possible. From the end back to the bytes, the merge made last at either
        side of the border is undone; the two tokens before it must not have been due earlier, or as early and
        further left.
        """
        rank, tokens, parts = self.ranks.get, self.tokens, self.parts
        due = None  # ranks below this come before the merge that was undone
        while True:
            joined = rank(tokens[a] + tokens[b])
            if joined is not None and (due is None or joined < due):
                return False
            left, right = parts[a], parts[b]
            if left and (not right or a > b):
                due, a = a, left[1]
            elif right:
                due, b = b + 1, right[0]
            else:
                return True

    def extend(self, data: bytes, last: list[int], until: int | None = None) -> None:
        """Add the last tokens of the prefixes of ``data`` that ``last`` does not cover yet."""
        until = len(data) if until is None else until
        done = len(last) - 1  # bytes covered
        begin = max(0, done + 1 - self.longest)
        for at, (token, size) in self.endings.iter(data[begin:until].decode("latin-1")):
            end = begin + at + 1
            if end <= done:
                continue
            if end > done + 1:
                raise ValueError("the vocabulary does not cover all bytes")
            if end > size:
                pair = last[end - size] << 32 | token
                good = self.pairs.young.get(pair)
                if not (self.follows(pair) if good is None else good):
                    continue
            last.append(token)
            done = end
        if done < until:
            raise ValueError("the vocabulary does not cover all bytes")

    def walk(self, last: list[int]) -> list[int]:
        """Tokens of the whole prefix table, from the end to the start and turned round."""
        out, at, tokens = [], len(last) - 1, self.tokens
        while at:
            out.append(last[at])
            at -= len(tokens[last[at]])
        return out[::-1]


class Prefixes:
    """Last token of each prefix of a byte string; supports appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.extend(self.data, self.last)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes ``start`` to ``end``; returns how many prefixes were computed anew."""
        old, shift = self.last, start + len(new) - end
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        done = start + len(new)
        self.vocabulary.extend(self.data, self.last, done)
        agree = 0
        while done < len(self.data) and agree < self.vocabulary.longest:
            done += 1
            self.vocabulary.extend(self.data, self.last, done)
            agree = agree + 1 if self.last[done] == old[done - shift] else 0
        self.last.extend(old[done + 1 - shift :])  # from here on choices see the same bytes and tokens as before
        return done - start

    def tokens(self) -> list[int]:
        return self.vocabulary.walk(self.last)


class Encoder:
    """Texts to packed ids (little-endian unsigned 32-bit integers) and back to bytes.

    ``words`` says that a match of the pattern reaches over a space only at its own start. A text without
    double spaces may then be cut before each space, and the ids of frequent words are looked up whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, words: bool = False):
        self.vocabulary = Vocabulary(ranks)
        self.matches = regex.compile(pattern).findall
        self.words = words
        self.cache = Recent(CACHED_PIECES)

    def match(self, text: str) -> bytes:
        data = text.encode()
        whole = self.vocabulary.ranks.get(data)
        if whole is not None:
            return pack("<I", whole)
        last = [-1]
        self.vocabulary.extend(data, last)
        ids = self.vocabulary.walk(last)
        return pack(f"<{len(ids)}I", *ids)

    def looked_up(self, text: str, make) -> bytes:
        """Ids that the young generation does not have."""
        if len(text) > CACHED_LENGTH:
            return make(text)
        packed = self.cache.again(text, 6 * len(text))
        if packed is None:
            self.cache.keep(text, packed := make(text), 6 * len(text))
        return packed

    def joined(self, texts: list[str], make) -> bytes:
        known = self.cache.young.get
        return b"".join([known(t) or self.looked_up(t, make) for t in texts])

    def word(self, text: str) -> bytes:
        found = self.matches(text)
        return self.match(text) if len(found) == 1 else self.joined(found, self.match)

    def encode(self, text: str) -> bytes:
        if not self.words or "  " in text:
            return self.joined(self.matches(text), self.match)
        return self.joined(cut_before_spaces(text), self.word)

    def decode(self, packed: bytes) -> bytes:
        ids = array("I", packed)
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


def cut_before_spaces(text: str) -> list[str]:
    first, *rest = text.split(" ")
    return [first, *[" " + w for w in rest]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(ranks: dict[bytes, int], pattern: str, words: bool, name: str) -> Encoder:
    """One encoder per Python worker and vocabulary, so that later tasks find its caches filled."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(ranks, pattern, words)
    return _ENCODERS[name]


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, *, words: bool = False, decode: bool = False
) -> DataFrame:
    """``docs`` with ``ids`` (packed) and, if asked for, ``decoded``, the bytes of the decoded ids."""
    ranks = load_ranks(ranks_path)
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern, words)).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(shared.value, pattern, words, name)
        for batch in (whole.slice(first, ROWS) for whole in batches for first in range(0, whole.num_rows, ROWS)):
            ids = [use.encode(text or "") for text in batch.column(at).to_pylist()]
            arrays = [*batch.columns, pa.array(ids, pa.binary())]
            if decode:
                arrays.append(pa.array(map(use.decode, ids), pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names)

    added = ["ids", "decoded"][: 1 + decode]
    names = [*docs.columns, *added]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.BinaryType()) for c in added]])
    return docs.mapInArrow(run, schema)


def token_report(docs: DataFrame, ranks_path: str, pattern: str, **options: bool) -> DataFrame:
    """Per document ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    coded = encode_documents(docs.select("doc_id", "text"), ranks_path, pattern, decode=True, **options)
    return coded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
