"""Remove repeated passages: blockwise suffix sorting over a difference cover.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (in a smaller doc_id, or earlier in the same
document). Suffixes are compared to that depth only, matches never cross documents.

**Cover.** D is a difference cover modulo V = 57 with eight members: for any two positions some shift below V brings both
to cover positions, at the cost of V - 1 bytes. So if two strings of 100 bytes are equal, two cover suffixes inside them,
at the same distance from their starts, share at least 44 bytes. Cover suffixes are 14% of all.

**Blocks.** Cover suffixes are dealt into buckets by a fingerprint of those 44 bytes (any order that keeps equal prefixes
together serves, as only equality decides) and sorted one block of buckets after the other: a pass reads the texts,
sends the cover suffixes of its block only, and its shuffle files go before the next pass. Memory is bounded by the
size of a bucket, disk by that of a block.

**Long ties.** Where cover suffixes tie in 44 bytes, the rank of their whole surroundings (56 bytes before to 100 after)
decides. Equal surroundings mean that all 57 strings that hold the suffix at that place are equal, so all but the first
of a rank are repeats at once, however many copies there are. Prefixes with several ranks are contested; there the
strings around the first suffix of each rank are sorted themselves, by their own fingerprints, bucket by bucket.

A very frequent prefix with many different surroundings is salted: such suffixes are dealt by surroundings, and two
witnesses of every piece stay in the prefix's own bucket so that the others there know that they are contested.

Repeats inside one task's texts are settled there and never sent twice. Documents and verdicts meet by cogroup over
parts of bounded size, by doc_id and a hash of the text. Strings count as equal by 96 bits of two independent
fingerprints: among the 1.4e13 cover suffixes of 100 TB the expected number of false pairs is 1e-3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacloud.llm._shared import Scratch, bounded, bundle, column_bytes, pieces_of, read_table, runs, unbundle
from stratacloud.llm._text import Rolling, mix

LENGTH = 100
#: A perfect difference set modulo 57.
COVER_MODULUS = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
PREFIX = LENGTH - COVER_MODULUS + 1
BEFORE = COVER_MODULUS - 1
PIECE = 2 << 20
#: Cover suffixes that one bucket should hold.
BUCKET_SUFFIXES = 800_000
#: Different surroundings of one prefix in a piece from which on it is salted, at most.
HOT = 64
#: Bytes of text that a part of the cogroups should hold.
PART_BYTES = 6 << 20
BLOCKS = 2

SAMPLE, SALTED, REPEAT, CONTESTED, STRING = range(5)
_ROWS = "part int, what int, body binary"
_NAMES = ["part", "what", "body"]
_KINDS = [pa.int32(), pa.int32(), pa.binary()]


def cover_positions(n: int) -> np.ndarray:
    """Cover positions p < n."""
    grid = np.arange(0, n + COVER_MODULUS, COVER_MODULUS)[:, None] + np.array(COVER)
    flat = grid.reshape(-1)
    return flat[: np.searchsorted(flat, n)]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)] if rows else [], schema=pa.schema(list(zip(_NAMES, _KINDS))))


def steps(pos: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Rising positions of each text as differences; ``times`` are the numbers of positions of the texts."""
    out = np.diff(pos, prepend=0)
    starts = np.cumsum(times) - times
    out[starts] = pos[starts]
    return out


def positions(steps_: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The inverse of ``steps``."""
    up = np.cumsum(steps_)
    starts = np.cumsum(times) - times
    return up - np.repeat(up[starts] - steps_[starts], times)


class Texts:
    """Texts in the order of (doc_id, identity); a place is a position on the line on which they follow each other."""

    def __init__(self, doc: np.ndarray, ident: np.ndarray, length: np.ndarray):
        self.doc, self.ident = doc, ident
        self.starts = np.cumsum(length) - length

    def dealt(self, parts: np.ndarray, what: int, place: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
        """One message per part: rising places, the texts they need, and columns."""
        order = np.argsort(parts, kind="stable")
        parts, out = parts[order], []
        for a, b in zip(*runs(parts)):
            at = order[a:b]
            used, text = np.unique(np.searchsorted(self.starts, place[at], side="right") - 1, return_inverse=True)
            pos = place[at] - self.starts[used][text]
            out.append((int(parts[a]), what, bundle(self.doc[used], self.ident[used], np.bincount(text), steps(pos, np.bincount(text)), *(c[at] for c in columns))))
        return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[int, list[np.ndarray]]]:
    """All messages by part and by what they are: doc_id, identity, position and the columns of every entry."""
    found: dict[int, dict[int, list[list[np.ndarray]]]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            doc, ident, times, pos, *columns = unbundle(row["body"])
            found.setdefault(row["part"], {}).setdefault(row["what"], []).append([np.repeat(doc, times), np.repeat(ident, times), positions(pos, times), *columns])
    return {part: {what: [np.concatenate(x) for x in zip(*entries)] for what, entries in kinds.items()} for part, kinds in found.items()}


def _ties(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, and which entries in it share theirs with another one."""
    order = np.argsort(key)
    tie = np.zeros(len(key), bool)
    same = key[order][1:] == key[order][:-1]
    tie[1:] |= same
    tie[:-1] |= same
    return order, tie


class Groups:
    """Entries with equal keys: those alone first, the others in the order of key, doc_id, identity and position.

    ``later`` are those for which an earlier start exists: in a smaller doc_id, or in the same text. The others of a
    group are its first texts, which have one doc_id; they differ in text if there are several.
    """

    def __init__(self, keys: tuple[np.ndarray, ...], doc: np.ndarray, ident: np.ndarray, pos: np.ndarray):
        # Most keys are alone: only those that tie in the first are sorted by all.
        order, tie = _ties(keys[0])
        tied = order[tie]
        tied = tied[np.lexsort((pos[tied], ident[tied], doc[tied], *(k[tied] for k in reversed(keys))))]
        self.order = np.concatenate((order[~tie], tied))
        alone = len(order) - len(tied)
        doc, ident, pos = doc[tied], ident[tied], pos[tied]
        new = np.ones(len(tied), bool)
        new[1:] = np.logical_or.reduce([k[tied][1:] != k[tied][:-1] for k in keys])
        group = np.cumsum(new) - 1
        text = new.copy()
        text[1:] |= (doc[1:] != doc[:-1]) | (ident[1:] != ident[:-1])
        heads, own = np.flatnonzero(new), np.flatnonzero(text)[np.cumsum(text) - 1]
        later = (doc != doc[heads][group]) | (pos != pos[own])
        again = ~later & (np.arange(len(doc)) != own)  # the same place of a repeated row
        self.new = np.concatenate((np.ones(alone, bool), new))
        self.later, self.again = (np.concatenate((np.zeros(alone, bool), x)) for x in (later, again))


def _cover_rows(block: int, blocks: int, parts: int, hot_from: int):
    """Texts to the cover suffixes of a block, packed per bucket."""

    def piece(ids: np.ndarray, idents: np.ndarray, data: np.ndarray, offs: np.ndarray) -> list[tuple]:
        length = np.diff(offs)
        order = np.lexsort((idents, ids))
        order = order[length[order] >= LENGTH]
        if not len(order):
            return []
        rolling = Rolling(data)
        template = cover_positions(int(length.max()))
        counts = np.searchsorted(template, length[order] - PREFIX + 1)
        nth = np.repeat(np.arange(len(order)), counts)
        doc = order[nth]
        pos = np.concatenate([template[:c] for c in counts])
        at = offs[doc] + pos
        prefix = rolling.of(at, at + PREFIX)
        mine = (prefix >> np.uint64(56)).astype(np.int64) % blocks == block
        nth, doc, pos, at, prefix = nth[mine], doc[mine], pos[mine], at[mine], prefix[mine]
        low, high = np.maximum(at - BEFORE, offs[doc]), np.minimum(at + LENGTH, offs[doc + 1])
        edges = (at - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (high - at).astype(np.uint64)
        rank = mix(rolling.of(low, high) + edges)
        del rolling
        check = (Rolling(data, again=True).of(low, high) >> np.uint64(32)).astype(np.uint32)
        groups = Groups((rank, check), ids[doc], idents[doc], pos)
        texts = Texts(ids[order], idents[order], length[order])
        place = texts.starts[nth] + pos
        bucket = ((prefix >> np.uint64(32)) & np.uint64(0xFFFFFF)).astype(np.int64) % parts
        rows = []
        # What is later here is a repeat whatever the other pieces hold, and is sent no further.
        if (later := np.sort(groups.order[groups.later])).size:
            rows += texts.dealt(bucket[later], REPEAT, place[later])
        first = np.sort(groups.order[~groups.later & ~groups.again])
        prefix, rank, check, place, bucket = prefix[first], rank[first], check[first], place[first], bucket[first]
        _, where, times = np.unique(prefix, return_inverse=True, return_counts=True)
        hot = times[where] > hot_from
        plain = ~hot
        short = prefix.astype(np.uint32)
        if hot.any():
            salted = (rank >> np.uint64(32)).astype(np.int64) % parts
            rows += texts.dealt(salted[hot], SALTED, place[hot], rank[hot], check[hot])
            by = np.flatnonzero(hot)[np.lexsort((rank[hot], prefix[hot]))]
            starts, ends = runs(prefix[by])
            plain[by[starts]] = plain[by[ends - 1]] = True
        if plain.any():
            rows += texts.dealt(bucket[plain], SAMPLE, place[plain], short[plain], rank[plain], check[plain])
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, idents = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offs = column_bytes(batch.column(2))
            for i, j, part, at in pieces_of(data, offs, PIECE):
                if rows := piece(ids[i:j], idents[i:j], part, at):
                    yield _batch(rows)

    return bounded(run)


def _sent_back(found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], dests: int) -> Iterator[pa.RecordBatch]:
    """Verdicts (what, doc_id, identity, position) packed by the part that the text belongs to."""
    rows = []
    for what, doc, ident, pos in found:
        order = np.lexsort((pos, doc, ident, ident % dests))
        doc, ident, pos = doc[order], ident[order], pos[order]
        dest = ident % dests
        for a, b in zip(*runs(dest)):
            text = np.ones(b - a, bool)
            text[1:] = (ident[a + 1 : b] != ident[a : b - 1]) | (doc[a + 1 : b] != doc[a : b - 1])
            heads = np.flatnonzero(text)
            rows.append((int(dest[a]), what, bundle(doc[a:b][heads], ident[a:b][heads], times := np.diff(heads, append=b - a), steps(pos[a:b], times))))
    if rows:
        yield _batch(rows)


def _sorted_bucket(dests: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for have in _gathered(batches).values():
            found = [(REPEAT, *have[REPEAT])] if REPEAT in have else []
            if SALTED in have:
                doc, ident, pos, rank, check = have.pop(SALTED)
                g = Groups((rank, check), doc, ident, pos)
                later, first = g.order[g.later], g.order[~g.later & ~g.again]
                found += [(REPEAT, doc[later], ident[later], pos[later]), (CONTESTED, doc[first], ident[first], pos[first])]
            if SAMPLE in have:
                entries = have.pop(SAMPLE)
                order, tie = _ties(entries[3])
                tied = order[tie]
                doc, ident, pos, prefix, rank, check = (x[tied] for x in entries)
                del entries
                if len(tied):
                    g = Groups((rank, check, prefix), doc, ident, pos)
                    later, first = g.order[g.later], g.order[~g.later & ~g.again]
                    # A prefix with several ranks is contested.
                    _, where = np.unique(prefix, return_inverse=True)
                    ranks = np.bincount(where[g.order[g.new]])
                    first = first[ranks[where[first]] > 1]
                    found += [(REPEAT, doc[later], ident[later], pos[later]), (CONTESTED, doc[first], ident[first], pos[first])]
            yield from _sent_back(found, dests)

    return bounded(run)


def _verdicts(table: pa.Table, what: int) -> dict[tuple[int, int], np.ndarray]:
    """Positions per text, by doc_id and identity."""
    out: dict[tuple[int, int], list[np.ndarray]] = {}
    for w, body in zip(table.column("what"), table.column("body")):
        if w.as_py() == what:
            doc, ident, times, pos = unbundle(body.as_buffer())
            for d, i, p in zip(doc.tolist(), ident.tolist(), np.split(positions(pos, times), np.cumsum(times)[:-1])):
                out.setdefault((d, i), []).append(p)
    return {k: np.concatenate(v) for k, v in out.items()}


def _spans(places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings that hold these cover positions."""
    return np.maximum(places - BEFORE, 0), np.minimum(places, n - LENGTH)


def _string_rows(parts: int):
    """Of contested cover suffixes the strings around them, packed by fingerprint; repeats inside the part settled here."""

    def run(_key, texts: pa.Table, found: pa.Table) -> pa.Table:
        open_ = _verdicts(found, CONTESTED) if found.num_rows else {}
        ids, idents = texts.column("doc_id").to_numpy(), texts.column("ident").to_numpy()
        data, offs = column_bytes(texts.column("text"))
        hashes, checks, nth, starts, seen, chosen = [], [], [], [], set(), []
        for i in np.lexsort((idents, ids)).tolist():
            key, n = (int(ids[i]), int(idents[i])), int(offs[i + 1] - offs[i])
            if key not in open_ or key in seen or n < LENGTH:
                continue
            seen.add(key)
            low, high = _spans(open_[key], n)
            edge = np.bincount(low, minlength=n + 1) - np.bincount(high + 1, minlength=n + 1)
            at = np.flatnonzero(np.cumsum(edge) > 0)
            own = data[offs[i] : offs[i + 1]]
            hashes.append(Rolling(own).of(at, at + LENGTH))
            checks.append((Rolling(own, again=True).of(at, at + LENGTH) >> np.uint64(32)).astype(np.uint32))
            nth.append(np.full(len(at), len(chosen)))
            chosen.append(i)
            starts.append(at)
        rows = []
        if hashes:
            h, check, text, pos = (np.concatenate(x) for x in (hashes, checks, nth, starts))
            order = Texts(ids[chosen], idents[chosen], np.diff(offs)[chosen])
            place, bucket = order.starts[text] + pos, (h >> np.uint64(40)).astype(np.int64) % parts
            g = Groups((h, check), order.doc[text], order.ident[text], pos)
            if (later := np.sort(g.order[g.later])).size:
                rows += order.dealt(bucket[later], REPEAT, place[later])
            first = np.sort(g.order[~g.later & ~g.again])
            rows += order.dealt(bucket[first], STRING, place[first], h[first], check[first])
        return _table(rows)

    return bounded(run)


def _sorted_strings(dests: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for have in _gathered(batches).values():
            found = [(STRING, *have[REPEAT])] if REPEAT in have else []
            if STRING in have:
                entries = have.pop(STRING)
                order, tie = _ties(entries[3])
                tied = order[tie]
                doc, ident, pos, rank, check = (x[tied] for x in entries)
                if len(tied):
                    g = Groups((rank, check), doc, ident, pos)
                    later = g.order[g.later]
                    found.append((STRING, doc[later], ident[later], pos[later]))
            yield from _sent_back(found, dests)

    return bounded(run)


def removed_spans(n: int, repeats: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs of a text of n bytes."""
    if n < LENGTH or not (len(repeats) or len(strings)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low, high = _spans(repeats, n)
    edge = np.bincount(np.concatenate((low, strings)), minlength=n + 1) - np.bincount(np.concatenate((high + LENGTH, strings + LENGTH)), minlength=n + 1)
    gone = np.concatenate(([False], np.cumsum(edge)[:n] > 0, [False]))
    flips = np.flatnonzero(gone[1:] != gone[:-1])
    return flips[::2], flips[1::2]


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"


@bounded
def _judged(_key, texts: pa.Table, found: pa.Table) -> pa.Table:
    repeats, strings = (_verdicts(found, w) if found.num_rows else {} for w in (REPEAT, STRING))
    data, offs = column_bytes(texts.column("text"))
    none = np.empty(0, np.int64)
    rows = []
    for i, (doc, ident, null) in enumerate(zip(*(texts.column(c).to_pylist() for c in ("doc_id", "ident", "no_id")))):
        raw = data[offs[i] : offs[i + 1]]
        starts, ends = removed_spans(len(raw), repeats.get((doc, ident), none), strings.get((doc, ident), none))
        keep = np.ones(len(raw), bool)
        for a, b in zip(starts.tolist(), ends.tolist()):
            keep[a:b] = False
        rows.append((None if null else doc, len(raw), int((ends - starts).sum()), len(starts), hashlib.sha256(raw[keep].tobytes()).hexdigest(), np.stack([starts, ends], 1).astype(np.int64).tobytes()))
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_passages(docs: DataFrame, blocks: int = BLOCKS, bucket_suffixes: int = BUCKET_SUFFIXES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) per row of ``docs`` (doc_id, text).

    ``spans`` packs starts and ends (int64) of the removed byte runs. Null texts are empty. Rows that repeat a doc_id
    and its text are one document and get the same verdict; different texts of one doc_id are different documents,
    neither of which is before the other. Rows without doc_id come before all others and are told apart alike. An empty
    table gives no rows. ``blocks`` bounds disk: the cover suffixes of one block are shuffled at a time;
    ``bucket_suffixes`` bounds what one task sorts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    lowest = -(1 << 63)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").isNull().alias("no_id"))
    # The identity of a document among those of its doc_id; never negative, so that it deals them to parts.
    texts = texts.withColumn("ident", F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    few = 2 * spark.sparkContext.defaultParallelism
    dests = int(max(few, size // PART_BYTES + 1))
    suffixes = size * len(COVER) // COVER_MODULUS
    parts = max(min(few, suffixes // 20_000 + 1), suffixes // blocks // bucket_suffixes + 1)
    # Two witnesses of a salted prefix stay; a prefix that is not salted holds a part of a bucket at most.
    hot = max(2, min(HOT, bucket_suffixes // 4 // (size // PIECE + 1)))
    at = lambda frame: frame.repartitionById(parts, F.col("part"))
    found = []
    for block in range(blocks):
        rows = texts.select("doc_id", "ident", "text").mapInArrow(_cover_rows(block, blocks, parts, hot), _ROWS)
        found.append(scratch.save(at(rows).mapInArrow(_sorted_bucket(dests), _ROWS), "cover"))
    verdicts = found[0]
    for more in found[1:]:
        verdicts = verdicts.unionAll(more)
    placed = texts.withColumn("dest", (F.col("ident") % dests).cast("int"))
    by = lambda frame: frame.withColumnRenamed("part", "dest").repartitionById(dests, F.col("dest")).groupBy("dest")
    strings = by(placed).cogroup(by(verdicts.filter(F.col("what") == CONTESTED))).applyInArrow(_string_rows(parts), _ROWS)
    settled = scratch.save(at(strings).mapInArrow(_sorted_strings(dests), _ROWS), "strings")
    last = verdicts.filter(F.col("what") == REPEAT).unionAll(settled)
    return by(placed).cogroup(by(last)).applyInArrow(_judged, _RESULT)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its bytes, its removed bytes and runs, and a digest of what is kept."""
    return repeated_passages(read_table(spark, sf_dir, "documents")).drop("spans")
