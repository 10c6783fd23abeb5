"""Byte-level BPE as a streaming transducer with bounded lookahead.

Text goes in by chunks and token ids come out as soon as nothing that follows can change
them, so memory doesn't grow with a text or with one of its pieces. Three machines are
chained:

1. special tokens: a chunk's end that could open one is held back;
2. pieces (the tokenizer's own split): a piece is final once two more characters are
   known; one that is still open after LONG characters is passed on in parts;
3. merges: a piece's bytes are held until the merge list's sufficient lookahead is
   beyond them.

The lookahead comes from the merge list alone. Say that more text on the right changes
what becomes of the boundary between two neighbouring parts, at the rank of some merge.
Then the boundary at the right end of the part after it, or one inside that part, was
changed before, by a merge of lower rank: merges of one rank go from left to right, so a
change never comes from the left. In the first case the part is the right operand of the
merge, and the earlier merge took a left operand that ends the part; in the second the
earlier merge is one of those that make the part. So a change wanders left along merges
of rising rank, and how far is a longest path over the merge list, worked out from the
last merge to the first. A boundary further than that from the end of the bytes known is
settled; bytes before it may go, as no merge ever crosses a boundary that stays.

Decoding is the reverse: ids to bytes, and an incremental UTF-8 machine that keeps what
a later byte can complete and puts U+FFFD for what none can.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import batches_of

TOKENIZER = "byte_bpe_50k.json"
WINDOW = 1 << 16  # characters of a text that are looked at together
LONG = 1024  # characters (over 3, a contraction) after which an open piece is passed on in parts
PART = 4096  # bytes beyond the lookahead at which an open piece's stable tokens go out
NEVER = 1 << 60  # the rank of a pair that no merge has
MEMORY = 300_000  # pieces whose ids a worker remembers

# Fixed value: the tokenizer's split, over text whose other characters than ASCII have
# been replaced by an ASCII one of their class (letter, number, blank, other).
PIECES = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
RUNS = {k: re.compile(p, re.ASCII) for k, p in {"letter": "[A-Za-z]+", "number": "[0-9]+", "blank": r"\s+", "other": r"[^\sA-Za-z0-9]+"}.items()}
STANDS_FOR = {"letter": "a", "number": "1", "blank": "\t", "other": "!"}


def lookahead(merges: list[tuple[str, str]]) -> int:
    """How many bytes after a boundary settle what becomes of it. Each merge's parts must
    be made by earlier merges, and no two merges may make the same."""
    made = {a + b: rank for rank, (a, b) in enumerate(merges)}
    if len(made) < len(merges) or any(max(made.get(a, -1), made.get(b, -1)) >= r for r, (a, b) in enumerate(merges)):
        raise ValueError("merges must be in the order in which their parts come to be")
    ends: dict[str, int] = {}  # a part to how far a merge that takes it as left operand is carried on
    within = [0] * len(merges)
    most = 0
    for rank in reversed(range(len(merges))):
        left, right = merges[rank]
        reach = max(ends.get(left, 0), within[rank])
        most = max(most, reach)
        part = right
        while True:  # what ends the right operand
            ends[part] = max(ends.get(part, 0), len(right) + reach)
            if part not in made:
                break
            part = merges[made[part]][1]
        parts = [(right, 0)]
        while parts:  # the merges that make the right operand, and where their boundary is
            part, at = parts.pop()
            if part in made:
                a, b = merges[made[part]]
                within[made[part]] = max(within[made[part]], at + len(a) + reach)
                parts += [(a, at), (b, at + len(a))]
    return most + 1


@functools.cache
def _byte_signs() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 ones for themselves, the others in order from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Vocabulary:
    """A tokenizer file's tables. A file with settings that this transducer doesn't
    follow is refused."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, split, added = told["model"], told["pre_tokenizer"] or {}, told["added_tokens"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain = plain and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        plain = plain and told["normalizer"] is None and (told["decoder"] or {}).get("type") == "ByteLevel"
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        self.ahead = lookahead(merges)
        self.rank = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.byte_id = [vocab[c] for c in _byte_signs()]
        value = {c: b for b, c in enumerate(_byte_signs())}
        self.special = {t["content"]: t["id"] for t in added}
        words = {i: w for w, i in vocab.items()} | {i: w for w, i in self.special.items()}
        self.bytes = _Bytes({i: bytes(value[c] for c in w) if all(c in value for c in w) else w.encode() for i, w in words.items()})
        self.specials = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.openings = {s[:n] for s in self.special for n in range(1, len(s))}
        self.hold = max(map(len, self.openings), default=0)
        self.classes = _Classes(Tokenizer.from_file(path).pre_tokenizer)
        self.memory = _Memory(self)

    def merged(self, data: bytes) -> list[int]:
        """The ids of a whole piece: the merge of lowest rank first, from the left."""
        ids, rank, made = [self.byte_id[b] for b in data], self.rank, self.made
        if len(ids) > 64:
            return self._merged_long(ids)
        pairs = [rank.get(a << 32 | b, NEVER) for a, b in pairwise(ids)]
        while pairs and (best := min(pairs)) < NEVER:
            i = pairs.index(best)
            ids[i] = made[best]
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = rank.get(ids[i - 1] << 32 | ids[i], NEVER)
            if i < len(pairs):
                pairs[i] = rank.get(ids[i] << 32 | ids[i + 1], NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs (rank, place)."""
        rank, n = self.rank, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(pairwise(ids)) if (r := rank.get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[best], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (r := rank.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return PIECES.findall(text)
        ends = accumulate(map(len, PIECES.findall(text.translate(self.classes))), initial=0)
        return [text[a:b] for a, b in pairwise(ends)]


class _Bytes(dict):
    """Bytes of ids; of ids that aren't there, none."""

    def __missing__(self, i: int) -> bytes:
        return b""


class _Classes(dict):
    """For str.translate: other characters than ASCII to one that stands for their class,
    which the tokenizer's own split is asked for when a character is first met."""

    def __init__(self, split):
        super().__init__((c, c) for c in range(128))
        self.split = split

    def __missing__(self, code: int) -> str:
        joins = lambda before: len(self.split.pre_tokenize_str(before + chr(code))) == 1
        kind = next((k for k in ("letter", "number", "other") if joins(STANDS_FOR[k])), "blank")
        self[code] = STANDS_FOR[kind]
        return self[code]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return struct.pack(f"<{len(ids)}i", *ids)


class _Memory(dict):
    """Ids of pieces, of the last MEMORY different ones at most."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        ids = packed(self.vocabulary.merged(piece.encode()))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Merger:
    """The bytes of one open piece to ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.data = vocabulary, b""

    def feed(self, data: bytes) -> bytes:
        out: list[int] = []
        for at in range(0, len(data), PART):
            self.data += data[at : at + PART]
            settled = len(self.data) - self.vocabulary.ahead
            if settled < PART:
                continue
            end = 0
            for i in self.vocabulary.merged(self.data):
                size = len(self.vocabulary.bytes[i])
                if end + size > settled:
                    break
                end += size
                out.append(i)
            self.data = self.data[end:]
        return packed(out)

    def finish(self) -> bytes:
        out, self.data = self.vocabulary.merged(self.data), b""
        return packed(out)


class Splitter:
    """Text without special tokens to packed ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.rest = vocabulary, ""
        self.run: re.Pattern | None = None  # of the piece that is open in the merger
        self.merger = Merger(vocabulary)

    def _ids(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.vocabulary.memory.__getitem__, pieces))

    def feed(self, text: str) -> bytes:
        text, out = self.rest + text, b""
        if self.run:
            out, text = self._carried_on(text, False)
            if self.run:
                self.rest = text
                return out
        pieces = self.vocabulary.pieces(text)
        end = len(text)
        while pieces and end > len(text) - 2:  # not final yet
            end -= len(pieces.pop())
        out += self._ids(pieces)
        self.rest = text[end:]
        if len(self.rest) > LONG and len(self.vocabulary.pieces(self.rest)) == 1:
            sign = self.rest[1].translate(self.vocabulary.classes)
            self.run = next(r for r in RUNS.values() if r.match(sign))
            blank = self.run is RUNS["blank"]
            out += self.merger.feed(self.rest[: len(self.rest) - blank].encode())
            self.rest = self.rest[-1] if blank else ""  # the last blank may belong to what follows
        return out

    def _carried_on(self, text: str, last: bool) -> tuple[bytes, str]:
        """What of text the open piece takes, and the rest; the piece is closed unless
        it takes all and more may come."""
        m = self.run.match(text.translate(self.vocabulary.classes))
        end, blank = m.end() if m else 0, self.run is RUNS["blank"]
        whole = end == len(text)
        if blank and not (whole and last):
            end -= 1
        out = self.merger.feed(text[:end].encode())
        if not whole or last:
            out += self.merger.finish()
            self.run = None
        return out, text[end:]

    def finish(self) -> bytes:
        text, out, self.rest = self.rest, b"", ""
        if self.run:
            out, text = self._carried_on(text, True)
        return out + self._ids(self.vocabulary.pieces(text))


def encode_stream(vocabulary: Vocabulary, chunks: Iterable[str]) -> Iterator[bytes]:
    """Token ids, packed, of a text that comes in chunks, as they become stable."""
    split, held = Splitter(vocabulary), ""
    for chunk in chunks:
        text, at = held + chunk, 0
        for m in vocabulary.specials.finditer(text) if vocabulary.specials else ():
            yield split.feed(text[at : m.start()])
            yield split.finish()
            yield packed([vocabulary.special[m[0]]])
            at = m.end()
        keep = next((n for n in range(min(vocabulary.hold, len(text) - at), 0, -1) if text[len(text) - n :] in vocabulary.openings), 0)
        yield split.feed(text[at : len(text) - keep])
        held = text[len(text) - keep :]
    yield split.feed(held)
    yield split.finish()


def decode_stream(vocabulary: Vocabulary, chunks: Iterable[Iterable[int]]) -> Iterator[str]:
    """Text of ids that come in chunks; ids that aren't in the vocabulary say nothing."""
    machine, told = codecs.getincrementaldecoder("utf-8")("replace"), vocabulary.bytes
    for chunk in chunks:
        yield machine.decode(b"".join(map(told.__getitem__, chunk)))
    yield machine.decode(b"", final=True)


@functools.lru_cache(2)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


def _path(tokenizer: str | None) -> str:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    return tokenizer


def _windows(text: str) -> Iterator[str]:
    return (text[a : a + WINDOW] for a in range(0, len(text), WINDOW))


def encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array<int>).

    Ids are those of the tokenizer file at the given path (None: the public 50k byte BPE)
    without what it adds around a text, truncation and padding; its special tokens' texts
    become their ids. Null and empty texts have none. Rows are encoded one by one, so
    repeated rows give repeated results. Other columns are ignored.
    """
    path = _path(tokenizer)

    def run(batches):
        vocabulary = vocabulary_of(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for first, stop in batches_of(texts):
                found = [b"".join(encode_stream(vocabulary, _windows(t))) for t in texts[first:stop]]
                starts = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in found], out=starts[1:])
                ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.record_batch([b.column(0).slice(first, stop - first), ids], names=["doc_id", "ids"])

    return common.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer: str | None = None, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep and text: what the ids say, special tokens as their texts,
    broken UTF-8 as U+FFFD. Null ids and ids unknown to the file say nothing; null or
    empty arrays give an empty text."""
    path = _path(tokenizer)
    rows = rows.select(*(F.col(common.quoted(c)) for c in keep), F.col(common.quoted(ids_col)).cast("array<int>").alias("__ids"))
    schema = ", ".join([*(f"{common.quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema[:-1]), "text string"])

    def run(batches):
        vocabulary = vocabulary_of(path)
        for b in batches:
            ids = b.column(b.num_columns - 1)
            flat = ids.values.fill_null(-1).to_numpy()
            ends = ids.offsets.to_numpy()
            parts = (flat[a:z] if valid else flat[:0] for a, z, valid in zip(ends[:-1], ends[1:], ids.is_valid().to_numpy(zero_copy_only=False), strict=True))
            texts = ["".join(decode_stream(vocabulary, (x[i : i + WINDOW].tolist() for i in range(0, len(x), WINDOW)))) for x in parts]
            yield pa.record_batch([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "text"])

    return rows.mapInArrow(run, schema)


def op13_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(common.documents(spark, sf_dir))
    said = F.array_join(F.col("ids").cast("array<string>"), ",")
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), "ids")
    back = decode(rows, keep=("doc_id", "n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
