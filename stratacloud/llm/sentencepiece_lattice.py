"""SentencePiece encoding and decoding as a relational lattice.

Distinct words are exploded into substrings of bounded length, these are joined by equality to the piece table, the
edges that match are grouped by word, and a fold goes over each word's lattice:

* files of the unigram type: Viterbi, the path with the greatest sum of scores;
* files of the byte-pair type: the sum of scores is not what such files are made for, and Viterbi gives other pieces
  than the format demands. There the fold merges, step by step, the two neighbours whose union is the edge with the
  best score, the leftmost first. Both folds run over the same lattice.

Two forms of it are here. ``encode_words`` is made of DataFrame operators alone: explode, broadcast equi-join to the
vocabulary file, groupBy, and higher-order ``aggregate``. It is right but took 2910 JVM CPU seconds and 4 times the
input as disk for 1 GB. ``Lattice`` holds the same relation in columns (substring hashes joined to sorted hashes of the
pieces, edges by start and length) and folds all words of a part step by step together; the texts go through this one.

A word is a run of spaces with the text after it, as no piece of such files goes on after a space (this is checked).
Characters that no piece covers become byte pieces, or the unknown piece in files without those. Words over LONG bytes
are cut where no piece holds both neighbours, as no merge goes over such a border, and merged by a heap instead, as the
fold is quadratic in their length; memory then grows with the longest stretch that pieces could cover.

Words are told apart by hash and compared byte by byte; where two of one hash differ, another hash decides.

What a task reads in one go, a *piece of the corpus*, becomes numbers of its own words, written once; it asks for each
distinct word once. Words are dealt to parts by hash, each part encodes its distinct words and answers, and answers
meet their texts by cogroup.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacloud.llm._shared import Scratch, bounded, column_bytes, packed, pieces_of, read_table, runs, unpacked
from stratacloud.llm._text import PIECE_BYTES as HASH_BYTES
from stratacloud.llm._text import Rolling

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PIECE_BYTES = 8 << 20
PIECE_ROWS = 2_500
#: The same where lists of piece numbers come back, and where texts do too, which take more memory.
ID_ROWS, LIST_ROWS = 1_600, 800
LONG = 200
#: Blocks in which words are asked and answered, and words that one part of a block should hold.
WORD_BLOCKS, PART_WORDS = 2, 300_000
#: Blocks of texts. Where texts don't come back, a block meets its answers, is written, and goes before the next.
TEXT_BLOCKS = 5
#: Words that the fold takes at a time.
FOLD_WORDS = 20_000
SPACE = "▁"
#: Fixed values of the format: kinds of pieces, and kinds of models.
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: numbers, and bytes, ints or floats."""
    i = 0

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        elif kind == 5:
            value, i = struct.unpack("<f", data[i : i + 4])[0], i + 4
        else:
            value, i = struct.unpack("<d", data[i : i + 8])[0], i + 8
        yield key >> 3, value


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_type: int
    add_prefix: bool

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        """From a .model file on the driver. Normalisation other than identity, or that drops spaces, is refused."""
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds, model_type, prefix = [], [], [], UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                entry = dict(_fields(value))
                pieces.append(entry[1].decode())
                scores.append(entry.get(2, 0.0))
                kinds.append(entry.get(3, NORMAL))
            elif number == 2:
                model_type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only files with identity normalisation are supported")
        out = cls(pieces, scores, kinds, model_type, prefix)
        if any(SPACE in p.lstrip(SPACE) for p in out.table()) or USER in kinds:
            raise ValueError("a piece goes on after a space; words can't be encoded apart")
        return out

    def table(self) -> dict[str, tuple[int, float]]:
        return {p: (i, s) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds)) if k == NORMAL}

    def byte_ids(self) -> list[int]:
        """The pieces of the 256 bytes; where the file has none, the unknown piece."""
        found = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        unknown = self.kinds.index(UNKNOWN)
        return [found.get(b, unknown) for b in range(256)]

    def surfaces(self) -> list[bytes]:
        """What each piece decodes to."""
        return [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds)]

    @property
    def longest(self) -> int:
        return max(map(len, self.table()))


def merge_word(word: str, table: dict[str, tuple[int, float]], byte_ids: list[int]) -> list[int]:
    """Byte-pair encoding of one word by a heap."""
    parts: list[str | None] = list(word)
    after = [*range(1, len(parts)), -1]
    before = [-1, *range(len(parts) - 1)]
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (hit := table.get(both := parts[i] + parts[after[i]])):
            heapq.heappush(heap, (-hit[1], i, both))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if parts[i] is None or after[i] < 0 or parts[i] + parts[after[i]] != both:
            continue
        j = after[i]
        parts[i], parts[j], after[i] = both, None, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [k for p in parts if p is not None for k in ([table[p][0]] if p in table else [byte_ids[b] for b in p.encode()])]


def viterbi_word(word: str, table: dict[str, tuple[int, float]], byte_ids: list[int], longest: int) -> list[int]:
    """The path with the greatest sum of scores; ties to the longer last piece."""
    floor = min(s for _, s in table.values()) - 10
    best: list[tuple[float, int]] = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        found = (best[e - 1][0] + floor, e - 1) if word[e - 1] not in table else (float("-inf"), e - 1)
        for s in range(max(0, e - longest), e):
            if hit := table.get(word[s:e]):
                found = max(found, (best[s][0] + hit[1], s), key=lambda x: (x[0], -x[1]))
        best.append(found)
    out, e = [], len(word)
    while e:
        s = best[e][1]
        out.append([table[word[s:e]][0]] if word[s:e] in table else [byte_ids[b] for b in word[s:e].encode()])
        e = s
    return [k for ids in reversed(out) for k in ids]


# --- the lattice of distinct words ------------------------------------------------------------------------------------


def _key(start: Column, end: Column) -> Column:
    return start * 1024 + end


def _merge_fold(n: Column, edges: Column) -> Column:
    """Borders of the pieces after all merges. edges: map of start and end to (score, id)."""

    def step(borders: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(borders) - 2), lambda j: F.struct((-edges[_key(F.get(borders, j - 1), F.get(borders, j + 1))]["score"]).alias("cost"), j.alias("j")))
        best = F.array_min(F.filter(pairs, lambda p: p["cost"].isNotNull()))
        merged = F.concat(F.slice(borders, F.lit(1), best["j"]), F.slice(borders, best["j"] + 2, F.size(borders)))
        return F.when(F.size(borders) > 2, F.coalesce(merged, borders)).otherwise(borders)

    return F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), step)


def _viterbi_fold(n: Column, edges: Column, floor: float, longest: int) -> Column:
    """Borders of the best path: per end the best score and start so far, then back from the end."""
    kind = "array<struct<score:double,start:int>>"

    def step(best: Column, e: Column) -> Column:
        ways = F.transform(
            F.sequence(F.greatest(e - longest, F.lit(0)), e - 1),
            lambda s: F.struct((F.get(best, s)["score"] + F.coalesce(edges[_key(s, e)]["score"].cast("double"), F.when(s == e - 1, F.lit(floor)))).alias("score"), (-s).alias("late"), s.cast("int").alias("start")),
        )
        top = F.array_max(F.filter(ways, lambda w: w["score"].isNotNull()))
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), top["start"].alias("start"))).cast(kind))

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"))).cast(kind)
    best = F.aggregate(F.sequence(F.lit(1), n), start, step)
    back = F.aggregate(F.sequence(F.lit(1), n), F.array(n), lambda path, _: F.when(F.get(path, F.lit(0)) > 0, F.concat(F.array(F.get(best, F.get(path, F.lit(0)))["start"]), path)).otherwise(path))
    return back


def encode_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Distinct words (word), spaces escaped, of at most LONG characters to (word, ids). The grouping keeps the partitioning by word."""
    spark = words.sparkSession
    longest = vocabulary.longest
    table = spark.createDataFrame([(p, i, float(s)) for p, (i, s) in vocabulary.table().items()], "piece string, id int, score float")
    n = F.length("word")
    subs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - s)), lambda l: F.struct(s.alias("s"), (s + l).alias("e"), F.substr(F.col("word"), s + 1, l).alias("sub")))))
    edges = words.select("word", F.explode(subs).alias("x")).select("word", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.sub").alias("sub"))
    found = edges.join(F.broadcast(table), edges["sub"] == table["piece"], "left").filter("id is not null or s = 0 and e = 1")
    grouped = found.groupBy("word").agg(F.collect_list(F.when(F.col("id").isNotNull(), F.struct(_key(F.col("s"), F.col("e")).alias("k"), F.struct("score", "id").alias("v")))).alias("edges"))
    with_map = grouped.select("word", n.alias("n"), F.map_from_entries("edges").alias("edges"))
    e = F.col("edges")
    floor = min(s for _, s in vocabulary.table().values()) - 10
    borders = _merge_fold(F.col("n"), e) if vocabulary.model_type == BPE else _viterbi_fold(F.col("n"), e, floor, longest)
    bytes_ = F.array(*[F.lit(i) for i in vocabulary.byte_ids()])

    def ids_of(j: Column) -> Column:
        s, t = F.get(F.col("borders"), j - 1), F.get(F.col("borders"), j)
        hexed = F.hex(F.substr(F.col("word"), s + 1, t - s).cast("binary"))
        fallback = F.transform(F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2)), lambda k: F.get(bytes_, F.conv(F.substr(hexed, k, F.lit(2)), 16, 10).cast("int")))
        return F.coalesce(F.when(e[_key(s, t)].isNotNull(), F.array(e[_key(s, t)]["id"])), fallback)

    ids = F.flatten(F.transform(F.sequence(F.lit(1), F.size("borders") - 1), ids_of))
    return with_map.withColumn("borders", borders).select("word", ids.alias("ids"))


def neighbours(table: dict[str, tuple[int, float]]) -> set[str]:
    """All pairs of characters that stand side by side in a piece."""
    return {p[i : i + 2] for p in table for i in range(len(p) - 1)}


def merge_long(word: str, table: dict[str, tuple[int, float]], byte_ids: list[int], pairs: set[str]) -> list[int]:
    """``merge_word`` of the stretches between borders that no piece goes over."""
    out, start = [], 0
    for i in range(1, len(word) + 1):
        if i == len(word) or word[i - 1 : i + 1] not in pairs:
            out += merge_word(word[start:i], table, byte_ids) if i - start > 1 else [table[word[start]][0]] if word[start] in table else [byte_ids[b] for b in word[start].encode("utf-8", "surrogateescape")]
            start = i
    return out


def distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of slices of a buffer the first of each, which one every slice equals, and how often each occurs. By hash, then by bytes."""
    keys = Rolling(data).of(starts, starts + lengths)
    for again in (True, False):
        _, first, where, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        like = first[where]
        if (lengths == lengths[like]).all() and np.array_equal(_slices(data, starts, lengths), _slices(data, starts[like], lengths)):
            return first, where, times
        keys = keys ^ (Rolling(data, again=again).of(starts, starts + lengths) << np.uint64(1))
    names: dict[bytes, int] = {}
    where = np.array([names.setdefault(data[a : a + n].tobytes(), len(names)) for a, n in zip(starts.tolist(), lengths.tolist())], np.int64)
    _, first, times = np.unique(where, return_index=True, return_counts=True)
    return first, where, times


class Lattice:
    """The same relation in columns, for many words at a time. Spaces are plain here, not escaped."""

    def __init__(self, vocabulary: Vocabulary):
        self.plain = {p.replace(SPACE, " "): v for p, v in vocabulary.table().items()}
        self.vocabulary, self.byte_ids, self.pairs = vocabulary, vocabulary.byte_ids(), neighbours(self.plain)
        raw = [p.encode() for p in self.plain]
        ends = np.cumsum([len(r) for r in raw])
        hashes = Rolling(np.frombuffer(b"".join(raw), np.uint8)).of(np.concatenate(([0], ends[:-1])), ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.checks = Rolling(np.frombuffer(b"".join(raw), np.uint8), again=True).of(np.concatenate(([0], ends[:-1])), ends)[order]
        self.ids = np.array([i for i, _ in self.plain.values()], np.int64)[order]
        # Ranks of scores: the lower the better; NONE where there is no piece.
        scores = np.array([s for _, s in self.plain.values()])[order]
        self.ranks = np.empty(len(scores), np.int32)
        self.ranks[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
        self.id_of_rank = np.empty(len(scores), np.int64)
        self.id_of_rank[self.ranks] = self.ids
        self.longest = max(len(r) for r in raw)
        self.byte_table = np.array(self.byte_ids, np.int64)

    NONE = np.iinfo(np.int32).max

    def edges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rank of the piece per start and length: all substrings of the words, joined to the pieces by two hashes."""
        rolling, again = Rolling(data), Rolling(data, again=True)
        size = int(min(self.longest, (ends - starts).max(initial=0)))
        out = np.full((len(data) + 1, size + 1), self.NONE, np.int32)
        stop = np.repeat(ends, ends - starts)
        at = np.arange(len(data))
        lead = (data & 0xC0) != 0x80
        for length in range(1, size + 1):
            p = at[lead & (at + length <= stop)]
            h = rolling.of(p, p + length)
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[k] == h)
            hit = hit[again.of(p[hit], p[hit] + length) == self.checks[k[hit]]]
            out[p[hit], length] = self.ranks[k[hit]]
        return out

    def merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte-pair pieces of words that lie one after the other: ids, and how many each word has."""
        edges = self.edges(data, starts, ends)
        size = edges.shape[1] - 1
        # Borders of the symbols, at first of the characters; the last of each word is its end.
        border = np.flatnonzero((data & 0xC0) != 0x80)
        word = np.repeat(np.arange(len(starts)), ends - starts)[border]
        done_at, done_word, done_len = [], [], []
        while len(border):
            after = np.append(border[1:], len(data))
            last = np.append(word[1:] != word[:-1], True)
            end_of = ends[word]
            stop = np.where(last, end_of, after)
            # The union with the next symbol.
            next_stop = np.append(stop[1:], 0)
            span = np.where(last, 0, next_stop - border)
            rank = np.where((span > 0) & (span <= size), edges[border, np.minimum(span, size)], self.NONE)
            rank[span <= 0] = self.NONE
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(border)))
            open_ = best < self.NONE
            stays = np.repeat(open_, count)
            shut = ~stays
            done_at.append(border[shut])
            done_word.append(word[shut])
            done_len.append((stop - border)[shut])
            if not open_.any():
                break
            hits = np.flatnonzero(stays & (rank == np.repeat(best, count)))
            lead = hits[np.append(True, word[hits[1:]] != word[hits[:-1]])]  # the leftmost of equals
            stays[lead + 1] = False
            border, word = border[stays], word[stays]
        at, of, length = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (done_at, done_word, done_len))
        order = np.argsort(at, kind="stable")
        at, of, length = at[order], of[order], length[order]
        rank = np.where(length <= size, edges[at, np.minimum(length, size)], self.NONE)
        known = rank < self.NONE
        n = np.where(known, 1, length)
        out_end = np.cumsum(n)
        ids = np.empty(int(out_end[-1]) if len(out_end) else 0, np.int64)
        ids[(out_end - n)[known]] = self.id_of_rank[rank[known]]
        u = np.flatnonzero(~known)
        if len(u):
            inner = np.arange(int(n[u].sum())) - np.repeat(np.cumsum(n[u]) - n[u], n[u])
            ids[np.repeat((out_end - n)[u], n[u]) + inner] = self.byte_table[data[np.repeat(at[u], n[u]) + inner]]
        return ids, np.bincount(of, n, len(starts)).astype(np.int64)

    def encode(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        ends = np.cumsum(lengths)
        flats, counts = [], []
        bpe = self.vocabulary.model_type == BPE
        long = np.flatnonzero(lengths > LONG) if bpe else np.arange(len(lengths))
        cuts = sorted({0, len(lengths), *long.tolist(), *(long + 1).tolist(), *range(0, len(lengths), FOLD_WORDS)})
        alone = set(long.tolist())
        for i, j in zip(cuts, cuts[1:]):
            a, b = int(ends[i] - lengths[i]), int(ends[j - 1])
            if i in alone:
                text = data[a:b].tobytes().decode("utf-8", "surrogateescape")
                ids = merge_long(text, self.plain, self.byte_ids, self.pairs) if bpe else viterbi_word(text, self.plain, self.byte_ids, self.longest)
                flats.append(np.array(ids, np.int64))
                counts.append(np.array([len(ids)]))
            else:
                flat, n = self.merged(data[a:b], ends[i:j] - lengths[i:j] - a, ends[i:j] - a)
                flats.append(flat)
                counts.append(n)
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return cat(flats), cat(counts)


# --- texts ------------------------------------------------------------------------------------------------------------

_PIECE = "piece long, kind int, doc_ids binary, no_id binary, lengths binary, tokens binary, n_words int, words binary, word_lengths binary, digests binary"
_PIECE_NAMES = [f.split()[0] for f in _PIECE.split(", ")]
_PIECE_KINDS = [pa.int64(), pa.int32()] + [pa.binary()] * 4 + [pa.int32()] + [pa.binary()] * 3
WORDS = -1  # of ``kind``; texts have the number of their block


def block_of(piece):
    """The block of a piece: of its number, or of a column of numbers."""
    return (piece // (1 << 24) + piece % (1 << 24)) % TEXT_BLOCKS


def _packed_ranks(ranks: np.ndarray) -> bytes:
    """Numbers by falling frequency: a byte for the 192 first, a byte of high bits and 12 low bits for others."""
    head = np.where(ranks < 192, ranks, 192 + np.minimum(ranks >> 12, 63)).astype(np.uint8)
    rest = ranks[ranks >= 192]
    columns = [packed(head), packed((rest & 255).astype(np.uint8)), packed((rest >> 8 & 15).astype(np.uint8)), packed(rest[rest >> 12 >= 63].astype(np.uint32))]
    return np.array([len(c) for c in columns], np.uint32).tobytes() + b"".join(columns)


def _unpacked_ranks(raw: bytes) -> np.ndarray:
    ends = np.cumsum(np.frombuffer(raw[:16], np.uint32)).tolist()
    head, low, middle, full = (unpacked(raw[16 + a : 16 + b], k) for a, b, k in zip([0, *ends], ends, (np.uint8, np.uint8, np.uint8, np.uint32)))
    out = head.astype(np.uint32)
    far = head >= 192
    rest = (head[far].astype(np.uint32) - 192 << 12) | (middle.astype(np.uint32) << 8) | low
    rest[head[far] == 255] = full
    out[far] = rest
    return out


def _slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of many slices one after the other."""
    stop = np.cumsum(lengths)
    return data[np.repeat(starts - (stop - lengths), lengths) + np.arange(int(stop[-1]) if len(stop) else 0)]


def _spaced(data: np.ndarray, offs: np.ndarray, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with one space before each text that is not empty; the escape sign counts as a space."""
    length = np.diff(offs)
    if len(data) and (raw := data.tobytes()).find(SPACE.encode()) >= 0:
        texts = [raw[a:b].replace(SPACE.encode(), b" ") for a, b in zip(offs[:-1], offs[1:])]
        data, length = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        offs = np.concatenate(([0], np.cumsum(length)))
    if not prefix:
        return data, offs
    more = np.concatenate(([0], np.cumsum(length > 0)))
    return np.insert(data, offs[:-1][length > 0], 32), offs + more


def _encoded(prefix: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = 0
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            data, offs = column_bytes(batch.column(1))
            for i, j, part, at in pieces_of(data, offs, PIECE_BYTES):
                digests = b"".join(hashlib.sha256(part[a:b].tobytes()).digest() for a, b in zip(at[:-1], at[1:]))
                counts, starts, sizes, raws, shift = [], [], [], [], 0
                for _, _, small, sat in pieces_of(part, at, HASH_BYTES):
                    small, sat = _spaced(small, sat, prefix)
                    space = small == 32
                    start = space.copy()
                    start[1:] &= ~space[:-1]
                    start[sat[:-1][np.diff(sat) > 0]] = True
                    first = np.flatnonzero(start)
                    last = np.append(first[1:], len(small))[: len(first)]
                    counts.append(np.diff(np.searchsorted(first, sat)))
                    starts.append(first + shift)
                    sizes.append(last - first)
                    raws.append(small)
                    shift += len(small)
                starts_, sizes_, raw = np.concatenate(starts), np.concatenate(sizes), np.concatenate(raws)
                del starts, sizes, raws
                first, local, times = distinct(raw, starts_, sizes_)
                order = np.argsort(-times, kind="stable")
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order))
                first = first[order]
                words = _slices(raw, starts_[first], sizes_[first])
                del raw
                row = [packed(ids[i:j].astype(np.int64)), packed(none[i:j]), packed(np.concatenate(counts).astype(np.int32)), _packed_ranks(rank[local])]
                piece = (TaskContext.get().partitionId() << 24) + serial
                serial += 1
                # Texts and words go to folders of their own, as the words can go once they are answered.
                rows = [(piece, block_of(piece), *row, len(first), None, None, digests), (piece, WORDS, *[None] * 4, len(first), packed(words), packed(sizes_[first].astype(np.uint32)), None)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _PIECE_KINDS)], names=_PIECE_NAMES)

    return bounded(run)


_ASK = "part int, piece long, at binary, words binary, word_lengths binary"
_ANSWER = "piece long, at binary, ids binary, counts binary"


def _requests(parts: int, block: int, blocks: int):
    """The distinct words of each piece, packed by the part of their hash; parts of one block only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, lengths = unpacked(row["words"], np.uint8), unpacked(row["word_lengths"], np.uint32).astype(np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                part = (Rolling(data).of(starts, ends) >> np.uint64(33)).astype(np.int64) % (parts * blocks)
                mine = np.flatnonzero(part % blocks == block)
                part //= blocks
                order = mine[np.argsort(part[mine], kind="stable")]
                for a, b in zip(*runs(part[order])):
                    at = order[a:b]
                    columns = [packed(at.astype(np.uint32), rising=True), packed(_slices(data, starts[at], lengths[at])), packed(lengths[at].astype(np.uint32))]
                    yield pa.RecordBatch.from_arrays([pa.array([int(part[at[0]])], pa.int32()), pa.array([row["piece"]], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], names=[f.split()[0] for f in _ASK.split(", ")])

    return bounded(run)


def _answered(vocabulary: Vocabulary):
    """Encode the distinct words of a part once; answer every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        lattice = Lattice(vocabulary)
        lengths = [unpacked(r["word_lengths"], np.uint32).astype(np.int64) for r in rows]
        data = np.concatenate([unpacked(r["words"], np.uint8) for r in rows])
        every = np.concatenate(lengths)
        ends = np.cumsum(every)
        starts = ends - every
        first, where, _ = distinct(data, starts, every)
        flat, size = lattice.encode(_slices(data, starts[first], every[first]), every[first])
        begin = np.cumsum(size) - size
        at = 0
        for r, own in zip(rows, lengths):
            k = where[at : at + len(own)]
            at += len(own)
            columns = [r["at"], packed(_slices(flat, begin[k], size[k]).astype(np.uint32)), packed(size[k].astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array([r["piece"]], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], names=["piece", "at", "ids", "counts"])

    return bounded(run)


#: What is made of a text: packed piece numbers and decoded bytes, a list and a digest, or a list and a string.
PACKED, IDS, LISTS = range(3)
_RESULT = "doc_id long, n_pieces long, ids binary, decoded binary, text_sha256 binary"
_FORMS = {PACKED: _RESULT, IDS: _RESULT.replace("ids binary", "ids array<int>"), LISTS: _RESULT.replace("ids binary, decoded binary", "ids array<int>, decoded string")}


def _assembled(vocabulary: Vocabulary, form: int):
    def run(_key, piece: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = [pa.int64(), pa.int64(), pa.binary() if form == PACKED else pa.list_(pa.int32()), pa.string() if form == LISTS else pa.binary(), pa.binary()]
        names = [f.split()[0] for f in _RESULT.split(", ")]
        if not piece.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        row = piece.to_pylist()[0]
        n_words = row["n_words"]
        # Encodings of the piece's words side by side.
        size, begin, flats, shift = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64), [], 0
        for a in answers.to_pylist():
            at, n = unpacked(a["at"], np.uint32, rising=True), unpacked(a["counts"], np.uint32).astype(np.int64)
            size[at], begin[at] = n, shift + np.cumsum(n) - n
            flats.append(unpacked(a["ids"], np.uint32))
            shift += len(flats[-1])
        flat = np.concatenate(flats) if flats else np.empty(0, np.uint32)
        tokens, lengths = _unpacked_ranks(row["tokens"]), unpacked(row["lengths"], np.int32)
        surfaces = vocabulary.surfaces()
        out: list[list] = [[], [], [], []]
        last, digests = np.cumsum(lengths), []
        for k, (a, b) in enumerate(zip((last - lengths).tolist(), last.tolist())):
            t = tokens[a:b]
            ids = _slices(flat, begin[t], size[t])
            text = b"".join([surfaces[i] for i in ids.tolist()])
            text = text[1:] if vocabulary.add_prefix and text[:1] == b" " else text
            out[0].append(len(ids))
            out[1].append(ids.tobytes() if form == PACKED else ids.astype(np.int32))
            out[2].append(hashlib.sha256(text).digest() if form == IDS else text.decode("utf-8", "replace") if form == LISTS else text)
            out[3].append(row["digests"][32 * k : 32 * k + 32])
        ids = pa.array(unpacked(row["doc_ids"], np.int64), mask=unpacked(row["no_id"], bool))
        return pa.table([ids, *(pa.array(c, k) for c, k in zip(out, kinds[1:]))], names=names)

    return bounded(run)


def encode_texts(docs: DataFrame, vocabulary: Vocabulary | None = None, form: int = PACKED, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded, text_sha256) per row of ``docs`` (doc_id, text).

    ``ids`` packs the piece numbers as 32-bit integers, ``decoded`` is the text that they decode to. In the form IDS
    ids are an array and decoded is the SHA-256 digest of the text, in the form LISTS an array and a string. Null and empty texts have no pieces. Repeated rows are encoded each; a null
    doc_id stays null. The escape sign U+2581 in a text counts as a space and so comes back as one; all else comes back
    as it was if the file has byte pieces. An empty table gives no rows.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or Vocabulary.read()
    scratch = Scratch(spark, "sentencepiece")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = range(TEXT_BLOCKS)
    words, *pieces = scratch.save_split(texts.mapInArrow(_encoded(vocabulary.add_prefix), _PIECE), "pieces", "kind", (WORDS, *blocks), batch_rows=piece_rows)
    n_pieces, n_words = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    parts = max(n_words // (WORD_BLOCKS * PART_WORDS) + 1, min(8, n_words // 5_000 + 1))
    answers: list[list[DataFrame]] = []
    for block in range(WORD_BLOCKS):
        asked = words.select("piece", "words", "word_lengths").mapInArrow(_requests(parts, block, WORD_BLOCKS), _ASK)
        done = asked.repartitionById(parts, F.col("part")).mapInArrow(_answered(vocabulary), _ANSWER)
        kind = ((F.floor(F.col("piece") / (1 << 24)) + F.col("piece") % (1 << 24)) % TEXT_BLOCKS).cast("int")
        answers.append(scratch.save_split(done.withColumn("kind", kind), "answers", "kind", tuple(blocks)))
    scratch.drop(words)
    # About a piece for each task, whatever the session's number of partitions is.
    by_piece = lambda frame: frame.repartition(n_pieces // TEXT_BLOCKS + 1, "piece").groupBy("piece")
    out = None
    for k in blocks:
        rest, told = pieces[k].select("piece", "doc_ids", "no_id", "lengths", "tokens", "n_words", "digests"), functools.reduce(DataFrame.unionAll, [a[k] for a in answers])
        met = by_piece(rest).cogroup(by_piece(told)).applyInArrow(_assembled(vocabulary, form), _FORMS[form])
        if form == IDS:
            met = scratch.save(met, "ids")
            for table in (pieces[k], *(a[k] for a in answers)):
                scratch.drop(table)
        out = met if out is None else out.unionAll(met)
    return out


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of piece numbers."""
    surfaces = vocabulary.surfaces()
    text = b"".join(surfaces[i] for i in ids)
    return (text[1:] if vocabulary.add_prefix and text[:1] == b" " else text).decode("utf-8", "replace")


def sentencepiece_stage(docs: DataFrame) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded) of every row: piece numbers, and the text that they decode to."""
    return encode_texts(docs, form=LISTS, piece_rows=LIST_ROWS).drop("text_sha256")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its piece numbers, a digest of the text that they decode to, and whether it came back whole."""
    out = encode_texts(read_table(spark, sf_dir, "documents"), form=IDS, piece_rows=ID_ROWS)
    return out.select("doc_id", "n_pieces", "ids", F.lower(F.hex("decoded")).alias("decoded_sha256"), (F.col("decoded") == F.col("text_sha256")).alias("round_trip"))
