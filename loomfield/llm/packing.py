"""Best-fit packing by bin completion.

Documents become token ids, longer ones are cut into full pieces, and pieces of less
than a full sequence are packed in groups of a bounded number of pieces. A group is a
depth-first branch and bound: at each level the largest piece left opens a sequence,
and the branches are the fillings of what is left of it, first the one of a short
search for little waste, then every filling from the largest pieces down that no other
dominates. The group's plain best-fit packing is the first incumbent. A branch is cut
off where its waste so far leaves no packing with fewer sequences than the incumbent.
The search ends with its tree, at the bound ceil(tokens / sequence), or after NODES
steps; the first two prove that no packing has fewer sequences.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import sys
import types
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import batches_of

TOKENIZER, END_ID, SEQUENCE = "word_bpe_49k.json", 1, 4096
GROUP = 8192  # pieces that are packed together
CACHE = 400_000  # parts of texts whose ids a worker remembers
# Fixed value: the tokenizer's own pattern of what is a unit of its own.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
_PARTS = regex.compile(PARTS).findall
# The same over ASCII and Latin letters to U+017F in lower case, where up to four
# digits are looked up together; U+0130 is not there, as its lower case has two characters.
_LATIN = re.compile("[\\t-\\r\\x20-\\x7e\\xa0-\u012f\u0131-\u017f\u2010-\u2027]*").fullmatch
_LATIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9]{1,4}|[\xb2\xb3\xb9\xbc-\xbe]|[^\\t-\\r \xa00-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\u017f]+").findall


@functools.cache
def _unsure():
    """Finds code points that are unassigned in Python's Unicode: there the tokenizer's
    classes and those of `regex` can be of different versions."""
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
    edges = [c for c in codes if unicodedata.category(chr(max(c - 1, 0))) != "Cn"]
    stops = [c for c in codes if c == sys.maxunicode or unicodedata.category(chr(c + 1)) != "Cn"]
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(edges, stops, strict=True)) + "]").search


NODES = 300_000  # steps of a group's search; beyond them the best packing so far stands
LEVEL_STEPS = 50  # what a level's first branch counts for

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# The byte alphabet of byte-level vocabularies. Bytes that print are
# themselves, all others are numbered from 256 on.
_PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(_PRINTS)))}


class Memory(dict):
    """Ids of parts as little-endian bytes, each encoded when it is first asked for."""

    def __init__(self, tok):
        super().__init__()
        self.model, self.pack = tok.model.tokenize, struct.Struct("<I").pack

    def __missing__(self, part: str) -> bytes:
        if "0" <= part[0] <= "9":
            units = list(part)
        else:
            units = [part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_BYTE_LETTERS)]
        out = self[part] = b"".join([self.pack(t.id) for u in units for t in self.model(u)])
        return out


def known(rules: dict) -> bool:
    """Whether a tokenizer's file lower-cases and parts texts as Ids does, and hides no
    special token's name but in `<|`."""
    pre = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    norm = (rules.get("normalizer") or {}).get("normalizers", [])
    model = rules["model"]
    return (
        [n["type"] for n in norm] == ["NFC", "Replace", "Lowercase"]
        and (norm[1]["pattern"], norm[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [p["type"] for p in pre] == ["Split", "ByteLevel"]
        and re.sub(r"\[(\\p\{.\})\]", r"\1", pre[0]["pattern"].get("Regex", "")) == PARTS
        and (pre[0]["behavior"], pre[0]["invert"], pre[1]["add_prefix_space"], pre[1]["use_regex"]) == ("Removed", True, False, False)
        and model["type"] == "BPE" and not model.get("dropout")
        and rules.get("truncation") is None and rules.get("padding") is None
        and all(a["content"].startswith("<|") and not a["lstrip"] and not a["normalized"] for a in rules["added_tokens"])
    )


class Ids:
    """Token ids of texts as little-endian bytes, with a memory of parts.

    The tokenizer lower-cases and parts a text into runs of letters, single digits and
    runs of signs, each encoded by itself, so a text's ids are those of its parts.
    Texts in Latin letters (most of a European corpus) are parted by a character class
    of the standard library, other ones by Unicode's own classes after the tokenizer's
    normaliser, and what may be a special token's name goes to the tokenizer whole.
    Of a file that parts texts in another way all texts do.
    """

    def __init__(self, path: str, most: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        self.memory = Memory(self.tok)
        self.known = known(json.loads(self.tok.to_str()))

    def plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def one(self, t: str) -> bytes:
        if not self.known or "<|" in t:
            return self.plain(t)
        if _LATIN(t):
            parts = _LATIN_PARTS(t.lower())
        elif _unsure()(t):
            return self.plain(t)
        else:
            parts = _PARTS(self.tok.normalizer.normalize_str(t))
        return b"".join(map(self.memory.__getitem__, parts))

    def of(self, texts: list[str]) -> list[bytes]:
        if len(self.memory) > self.most:
            self.memory.clear()
        return [self.one(t) for t in texts]


def _cut(path: str, end_id: int, sequence: int):
    """Texts to pieces."""

    def run(batches):
        # one memory for all tasks of a worker process, where modules outlive tasks
        held = sys.modules.setdefault("_loomfield_ids", types.ModuleType("_loomfield_ids")).__dict__
        if path not in held:
            held[path] = Ids(path)
        ids_of = held[path].of
        end, step = np.array([end_id], "<u4").tobytes(), 4 * sequence
        for b in batches:
            docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            cols: list[list] = [[], [], [], [], []]
            for lo, hi in batches_of(texts, 1 << 20):
                for doc, ids in zip(docs[lo:hi], ids_of(texts[lo:hi]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        for c, v in zip(cols, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class _Stock:
    """Pieces left, by length; a bit for each length that is there, in both directions."""

    def __init__(self, lengths: np.ndarray, most: int):
        self.most = most
        self.count = np.bincount(lengths, minlength=most + 1).tolist()
        self.mask = sum(1 << n for n, c in enumerate(self.count) if c)
        self.back_mask = sum(1 << (most - n) for n, c in enumerate(self.count) if c)

    def largest(self, upto: int) -> int:
        return (self.mask & ((2 << upto) - 1)).bit_length() - 1 if upto > 0 else -1

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.mask ^= 1 << n
            self.back_mask ^= 1 << (self.most - n)

    def back(self, n: int) -> None:
        if not self.count[n]:
            self.mask ^= 1 << n
            self.back_mask ^= 1 << (self.most - n)
        self.count[n] += 1

    def pair(self, size: int) -> list[int]:
        """One or two pieces of exactly this size, with the largest first piece."""
        if size <= 0:
            return []
        if self.count[size]:
            return [size]
        both = self.mask & (self.back_mask >> (self.most - size))  # a is there and size - a too
        if not size & 1 and self.count[size // 2] == 1:
            both &= ~(1 << (size // 2))
        return [n := both.bit_length() - 1, size - n] if both else []


def _best_fit(stock: _Stock, room: int) -> list[int]:
    """The largest that fits, again and again; the stock is left as it was."""
    out = []
    while (n := stock.largest(room)) > 0:
        stock.take(n)
        out.append(n)
        room -= n
    for n in out:
        stock.back(n)
    return out


def _fill(stock: _Stock, room: int, steps: list[int]) -> list[int]:
    """A filling with little waste: after each beginning of the best-fit one, and after
    each piece by itself, the one or two pieces that leave least of the room."""
    best = _best_fit(stock, room)
    least = room - sum(best)
    if not least:
        return best
    begins, n = [best[:i] for i in range(len(best))], stock.largest(room)
    while n > 0:
        begins.append([n])
        n = stock.largest(n - 1)
    rooms = [room - sum(b) for b in begins]
    for waste in range(least):
        steps[0] -= len(begins) // 2
        for begin, left in zip(begins, rooms, strict=True):
            rest = stock.pair(left - waste)
            if rest and all(stock.count[x] >= (begin + rest).count(x) for x in rest):
                return [*begin, *rest]
        if steps[0] <= 0:
            break
    return best


def _dominated(stock: _Stock, chosen: list[int], waste: int) -> bool:
    """Whether one larger piece left can join, or take the place of one or two of the
    chosen (chosen ones are out of the stock)."""
    if stock.largest(waste) > 0:
        return True
    kinds = sorted(set(chosen))
    if any(stock.largest(n + waste) > n for n in kinds):
        return True
    pairs = {a + b for i, a in enumerate(kinds) for b in kinds[i + 1 :]} | {2 * n for n in kinds if chosen.count(n) > 1}
    return any(stock.largest(n + waste) >= n for n in pairs)


def _fillings(stock: _Stock, room: int, most: int, steps: list[int]):
    """All undominated fillings that waste `most` or less, from the largest pieces down;
    stops where no steps are left. A filling's pieces are out of the stock only until
    it is handed out."""
    steps[0] -= LEVEL_STEPS
    first = _fill(stock, room, steps)
    yield first if room - sum(first) <= most else None
    chosen, left, upto = [], room, room
    while steps[0] > 0:
        steps[0] -= 1
        n = stock.largest(min(left, upto))
        if n > 0:
            stock.take(n)
            chosen.append(n)
            left, upto = left - n, n
            continue
        if left <= most:
            steps[0] -= len(chosen) ** 2 // 4  # what looking for dominance counts for
        if left <= most and chosen != first and not _dominated(stock, chosen, left):
            for x in chosen:
                stock.back(x)
            yield list(chosen)
            for x in chosen:
                stock.take(x)
        if not chosen:
            return
        n = chosen.pop()  # the next branch is without another piece of this length
        stock.back(n)
        left, upto = left + n, n - 1
    for x in chosen:
        stock.back(x)


def _bound(lengths: np.ndarray, sequence: int) -> int:
    """Of all packings: by volume, and for each size k up to a half by pieces that no two
    of which, or no piece of k or more beside which, fit together."""
    if not len(lengths):
        return 0
    x = np.sort(lengths)[::-1]
    upto = np.concatenate(([0], np.cumsum(x)))
    best = -(-int(upto[-1]) // sequence)
    over_half = int((2 * x > sequence).sum())
    for k in np.unique(x[2 * x <= sequence]).tolist():
        alone, upper = int((x > sequence - k).sum()), int((x >= k).sum())
        spare = (over_half - alone) * sequence - int(upto[over_half] - upto[alone])
        small = int(upto[upper] - upto[over_half])
        best = max(best, over_half + max(0, -(-(small - spare) // sequence)))
    return max(best, over_half)


def complete(lengths: np.ndarray, sequence: int = SEQUENCE, nodes: int = NODES) -> tuple[list[list[int]], bool]:
    """Sequences as lists of lengths, and whether it is proven that none has fewer."""
    stock, best = _Stock(lengths, sequence), []
    total = int(lengths.sum())
    bound = _bound(lengths, sequence)
    while stock.mask:
        n = stock.largest(sequence)
        stock.take(n)
        rest = _best_fit(stock, sequence - n)
        for x in rest:
            stock.take(x)
        best.append([n, *rest])
    if len(best) <= bound:
        return best, True
    stock, steps = _Stock(lengths, sequence), [nodes]
    bins: list[list[int]] = []
    tree: list = []  # for each level: largest piece, its fillings, waste before
    waste, down = 0, True
    while True:
        spare = (len(best) - 1) * sequence - total - waste  # waste that a packing with fewer sequences can still have
        if down and not stock.mask:
            best = list(bins)
            if len(best) <= bound:
                return best, True
        elif down and spare >= 0:
            n = stock.largest(sequence)
            stock.take(n)
            tree.append((n, _fillings(stock, sequence - n, spare, steps), waste))
        if not tree:
            return best, True
        n, fillings, before = tree[-1]
        if len(bins) == len(tree):  # what this level had last goes back
            for x in bins.pop()[1:]:
                stock.back(x)
        waste = before
        steps[0] -= 1
        down = False
        for filling in fillings:
            if filling is not None and before + sequence - n - sum(filling) <= (len(best) - 1) * sequence - total:
                for x in filling:
                    stock.take(x)
                bins.append([n, *filling])
                waste, down = before + sequence - n - sum(filling), True
                break
        if steps[0] <= 0 and not down:
            return best, False
        if not down:
            tree.pop()
            stock.back(n)


def pack_lengths(lengths: np.ndarray, sequence: int = SEQUENCE) -> list[list[int]]:
    """Sequences as lists of lengths."""
    return complete(lengths, sequence)[0]


def _pack(sequence: int):
    def run(key, table):
        lengths = table.column("length").to_numpy()
        order = np.argsort(lengths, kind="stable")
        at = np.searchsorted(lengths[order], np.arange(sequence + 1)).tolist()
        group = key[0].as_py()
        ids, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, lot in enumerate(pack_lengths(lengths, sequence)):
            place = 0
            for n in lot:
                row = order[at[n]]
                at[n] += 1
                ids[row], offsets[row] = -((group << 20) + k + 1), place
                place += n
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    sequence: int = SEQUENCE,
    group: int = GROUP,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer is the path of a tokenizers file whose words white space parts. Null
    counts as empty: one piece with the end id. Repeated rows, ties and null ids are
    pieces of their own. No rows in, no rows out. Other columns are ignored.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    base = common.id_text(docs, id_col, text_col)
    pieces = common.kept_in_store(base.mapInArrow(_cut(tokenizer, end_id, sequence), _PIECES))
    full = pieces.filter(F.col("length") == sequence)
    full = full.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.filter(F.col("length") < sequence)
    groups = max(1, -(-rest.count() // group))
    mark = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    rest = rest.withColumn("g", F.pmod(mark, F.lit(groups)))
    return full.unionByName(rest.groupBy("g").applyInArrow(_pack(sequence), _PIECES + ", sequence_id long, offset long"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
