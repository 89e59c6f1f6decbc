"""Hierarchical Pitman-Yor language model over words: training by Gibbs sampling and scoring of every document.

The model has a restaurant per context (the word before, or the start of a text). All context restaurants share one
parent, the restaurant of single words, whose base is uniform over the vocabulary and one unknown word. A restaurant
seats the occurrences of its words at tables; every table of a context restaurant is a customer of the parent.

**Sampler.** A sweep draws, each given the rest and all exactly:

1. the parent's tables per word, given its customers (the tables of all contexts) and a gamma variable that stands for
   its total of tables, so that words are independent;
2. the parent's distribution given its seating: per word a gamma variable for its seated customers and a tilted stable
   one for what the parent would draw anew from the base;
3. per context the gamma variable of its total of tables, and per cell (a word in a context) the number of tables at
   which all its customers sit, given that variable and the parent's distribution. This is done INNER times.

Contexts and parent are thus seated against each other's present state in every sweep. The predictive probability of a
state is the usual one of the seating, and it is averaged over SAMPLES states after BURN_IN sweeps.

**How it runs.** A *piece* is what one task reads of the documents (PIECE_BYTES at most), encoded to word numbers of its
own and written once. All that a piece asks of the corpus it asks once per distinct word or pair of words:

1. words: *owners* count the words over the training documents and number them, the frequent ones first;
2. pairs: each piece sends its distinct pairs with their training counts to the *part* of their context, which answers
   the counts over the corpus. Cells of one customer have one table for ever; only the others (a tenth) are kept;
3. sweeps: parts send tables per word to the owners, owners seat the parent and send its distribution back;
4. the parts answer the tables of the cells that a piece has asked for, the owners those of words; the piece adds up the
   logarithms of its documents' tokens.

A context that holds more than a quarter of a part is dealt by pairs; its tables are added up by an owner in every sweep.
Parts and owners are numbered by the size of the corpus, one task counts one of them, or sweeps TOGETHER of them one after
the other, and random numbers hang on words: scores depend on neither partitions nor executors. Messages hold what goes from one piece to one part, so there are never
more of them than pairs. Nothing is broadcast; the driver sees totals only. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from stratacloud.llm._seating import draw_tables, gammas, salted, stable_sum, tilted_stables, uniform
from stratacloud.llm._shared import Scratch, bounded, bundle, column_bytes, packed, pieces_of, read_table, runs, unbundle, unpacked
from stratacloud.llm._text import PIECE_BYTES as HASH_BYTES
from stratacloud.llm._text import Rolling, lower, mix, words

PIECE_BYTES = 12 << 20
PIECE_ROWS = 5_000
#: Tokens of the corpus for each part of the pairs, and for each owner of words.
PART_TOKENS, OWNER_TOKENS = 1_200_000, 3_000_000
#: Parts, or owners, that one task takes one after the other from the sweeps on, as little is left of each; the fewest such tasks.
TOGETHER, LEAST_TASKS = 8, 8
MODULUS, HELD_OUT = 7, 2
DISCOUNT, STRENGTH = 0.8, 1.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.7, 10.0
BURN_IN, SAMPLES, INNER = 4, 4, 3
END, START = np.uint64(0x1F3D5B79A2C4E680), 1 << 60
#: The parent's distribution is kept in whole multiples of 1 / UNIT, whose sums do not hang on their order.
UNIT = 1 << 16

_CELL, _CONTEXT, _WORD_TABLES, _WORD_MASS, _WORD_NEW, _DRIVER = range(6)


# --- pieces -----------------------------------------------------------------------------------------------------------

_PIECE = "piece long, n_tokens long, doc_ids binary, no_id binary, held binary, lengths binary, tokens binary, vocabulary binary, counts binary"


@bounded
def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, text) to pieces. Word numbers are by falling frequency; each text ends with the end token."""
    serial = 0
    for batch in batches:
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        data, offs = column_bytes(batch.column(1))
        for i, j, part, at in pieces_of(data, offs, PIECE_BYTES):
            hashes, counts = [], []
            for _, _, small, sat in pieces_of(part, at, HASH_BYTES):
                small = lower(small)
                starts, ends, first = words(small, sat)
                h = Rolling(small).of(starts, ends)
                n = np.diff(first)
                hashes.append(np.insert(h, first[1:], END))
                counts.append(n + 1)
            tokens, lengths = np.concatenate(hashes), np.concatenate(counts)
            key = ["" if x else str(d) for d, x in zip(ids[i:j].tolist(), none[i:j].tolist())]
            held = np.array([zlib.crc32(k.encode()) % MODULUS == HELD_OUT for k in key])
            vocabulary, local, times = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            local = rank[local]
            train = np.bincount(local[np.repeat(~held, lengths)], minlength=len(vocabulary))
            columns = [ids[i:j].astype(np.int64), none[i:j], held, lengths.astype(np.int32), local, vocabulary[order], train.astype(np.uint32)]
            piece = (TaskContext.get().partitionId() << 24) + serial
            serial += 1
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([len(tokens)], pa.int64()), *(pa.array([packed(c)], pa.binary()) for c in columns)], names=_PIECE.replace(" long", "").replace(" binary", "").split(", "))


@dataclass(frozen=True)
class Plan:
    """Sizes of the corpus, and into how many parts and owners it is dealt. ``samples``: customers and tables of the parent."""

    parts: int
    owners: int
    part_tokens: int
    tokens: int = 0
    vocabulary: int = 0
    once: int = 0
    ends: int = 0
    samples: tuple[tuple[int, int], ...] = ()


class Piece:
    """A piece whose words have got their numbers and counts; its distinct pairs in order of (context, word)."""

    def __init__(self, table: pa.Table, answers: dict[int, list[np.ndarray]], plan: Plan):
        get = lambda name, kind: unpacked(table.column(name)[0].as_py(), kind)
        self.piece = table.column("piece")[0].as_py()
        self.doc_ids, self.no_id, self.held = get("doc_ids", np.int64), get("no_id", bool), get("held", bool)
        self.lengths = get("lengths", np.int32)
        self.vocabulary = get("vocabulary", np.uint64)
        v = len(self.vocabulary)
        names, counts = np.zeros(v, np.int64), np.zeros(v, np.int64)
        for owner, at in _cut(_owner_of(self.vocabulary, plan.owners)):
            names[at], counts[at] = answers[owner]
        order = np.argsort(names)
        self.rank = np.empty(v, np.int64)
        self.rank[order] = np.arange(v)
        self.names, self.counts = names[order], counts[order]
        self.tokens = self.rank[get("tokens", np.uint32)]
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = v  # v stands for the start of a text
        self.pairs, self.where = np.unique(before * v + self.tokens, return_inverse=True)
        del before
        self.before, self.after = self.pairs // v, self.pairs % v
        self.context, self.customers = np.append(self.names, START), np.append(self.counts, plan.ends)

    def parts(self, plan: Plan) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per part its pairs, the first of each run of a context, the contexts (doubled, odd if dealt by pairs)."""
        hot = self.customers > plan.part_tokens // 4
        own = mix(self.context.astype(np.uint64))
        spread = np.where(hot[self.before], mix(own[self.before] ^ self.names.astype(np.uint64)[self.after]), own[self.before])
        for part, at in _cut((spread >> np.uint64(33)).astype(np.int64) % plan.parts):
            starts, _ = runs(self.before[at])
            heads = self.before[at[starts]]
            yield part, at, starts, self.context[heads] * 2 + hot[heads]


# --- messages ---------------------------------------------------------------------------------------------------------

_NAMES = ["part", "what", "sender", "body"]
_ROWS = "part int, what int, sender long, body binary"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
#: What a message is: counts and totals, words by number, cells, sweeps, answers.
COUNT, LISTED, ASKED_WORDS, PAIR, PAIR_COUNT, ASKED_CELLS, STATE, SINGLE, SUM, HOT_SUM, BASE, MASS, HOT, SEATED, CELL_TABLES, WORD_TABLES = range(16)
TOTAL = 100
(TOKENS, VOCABULARY, ONCE, ENDS, PARENT_TABLES, PARENT_CUSTOMERS, PARENT_MASS, QUIET, QUIET_TABLES, QUIET_CUSTOMERS) = range(TOTAL, TOTAL + 10)


_BATCH_ROWS, _BATCH_BYTES = 256, 4 << 20
Message = tuple[int, int, int, bytes]


def _row(part: int, what: int, sender: int, body: bytes = b"") -> Message:
    return part, what, sender, body


def _batch(rows: list[Message]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)


def _table(rows: list[Message]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)] if rows else [], schema=pa.schema(list(zip(_NAMES, _KINDS))))


def messages(f: Callable[[Iterator[pa.RecordBatch]], Iterator[Message]]):
    """A function that yields messages, as one of batches of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in f(batches):
            held.append(row)
            size += len(row[3])
            if len(held) >= _BATCH_ROWS or size > _BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    return bounded(run)


def _received(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[int, list[dict]]]:
    """All messages by part and by what they are, in the order of their senders."""
    out: dict[int, dict[int, list[dict]]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            out.setdefault(row["part"], {}).setdefault(row["what"], []).append(row)
    for kinds in out.values():
        for rows in kinds.values():
            rows.sort(key=lambda r: r["sender"])
    return out


def _cut(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with the places of its members, in order."""
    order = np.argsort(parts, kind="stable")
    for a, b in zip(*runs(parts[order])):
        yield int(parts[order[a]]), order[a:b]


def _owner_of(vocabulary: np.ndarray, owners: int) -> np.ndarray:
    return (vocabulary >> np.uint64(33)).astype(np.int64) % owners


# --- counts of words --------------------------------------------------------------------------------------------------


def _word_requests(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Message]:
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, counts = unpacked(row["vocabulary"], np.uint64), unpacked(row["counts"], np.uint32)
                for owner, at in _cut(_owner_of(vocabulary, owners)):
                    yield _row(owner, COUNT, row["piece"], bundle(vocabulary[at], counts[at]))

    return messages(run)


def _counted(owners: int):
    """Counts and numbers of the words of an owner; each piece gets those of its words.

    A word's number is 2 * (place by falling count * owners + owner), and one more if it occurs less than twice. The
    owner keeps which of its more frequent words a piece asks for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Message]:
        for owner, kinds in _received(batches).items():
            asked = [unbundle(r["body"]) for r in kinds[COUNT]]
            words_, where = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
            sums = np.bincount(where, np.concatenate([a[1] for a in asked]), len(words_)).astype(np.int64)
            order = np.argsort(-sums, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            names = 2 * (place * owners + owner) + (sums < 2)
            listed = int((sums > 1).sum())
            yield _row(owner, LISTED, listed)
            for what, n in ((TOKENS, sums.sum()), (VOCABULARY, (sums > 0).sum()), (ONCE, (sums == 1).sum()), (ENDS, sums[words_ == END].sum())):
                yield _row(owner, what, int(n))
            at = 0
            for r, (own, _) in zip(kinds[COUNT], asked):
                w = where[at : at + len(own)]
                at += len(own)
                yield _row(owner, COUNT, r["sender"], bundle(names[w], sums[w]))
                if len(mine := place[w][sums[w] > 1]):
                    yield _row(owner, ASKED_WORDS, r["sender"], bundle(mine.astype(np.uint32)))

    return messages(run)


# --- counts of pairs --------------------------------------------------------------------------------------------------


def _answers(table: pa.Table) -> dict[int, dict[int, list[np.ndarray]]]:
    """What a piece has been told, by what it is and by who has told it."""
    out: dict[int, dict[int, list[np.ndarray]]] = {}
    for what, part, body in zip(*(table.column(n) for n in ("what", "part", "body"))):
        out.setdefault(what.as_py(), {})[part.as_py()] = unbundle(body.as_buffer())
    return out


def _pair_requests(plan: Plan):
    def run(_key, piece: pa.Table, answers: pa.Table) -> pa.Table:
        if not piece.num_rows:
            return _table([])
        p = Piece(piece, _answers(answers)[COUNT], plan)
        train = np.bincount(p.where[np.repeat(~p.held, p.lengths)], minlength=len(p.pairs)).astype(np.uint32)
        out = []
        for part, at, starts, contexts in p.parts(plan):
            lengths = np.diff(starts, append=len(at)).astype(np.uint32)
            out.append(_row(part, PAIR, p.piece, bundle(np.diff(contexts, prepend=0), lengths, p.names[p.after[at]], train[at])))
        return _table(out)

    return bounded(run)


def _shares(names: np.ndarray, owners: int) -> Iterator[tuple[int, np.ndarray]]:
    """The owners of words by number."""
    return _cut((names >> 1) % owners)


def _paired(owners: int):
    """Cells of a part: the counts that each piece has asked for, and the cells of two or more customers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Message]:
        for part, kinds in _received(batches).items():
            asked = [unbundle(r["body"]) for r in kinds[PAIR]]
            kinds[PAIR] = [r["sender"] for r in kinds[PAIR]]
            contexts, room = np.unique(np.concatenate([np.cumsum(a[0]) for a in asked]), return_inverse=True)
            room_of = np.repeat(room, np.concatenate([a[1] for a in asked]).astype(np.int64))
            listed, word = np.unique(np.concatenate([a[2] for a in asked]), return_inverse=True)
            cells, cell = np.unique(room_of * len(listed) + word, return_inverse=True)
            del room_of, word
            c = np.bincount(cell, np.concatenate([a[3] for a in asked]), len(cells)).astype(np.int64)
            sizes = [(len(a[0]), len(a[2])) for a in asked]
            del asked
            cell_room, cell_word = cells // len(listed), cells % len(listed)
            del cells
            followers = np.bincount(cell_room[c > 0], minlength=len(contexts))
            many = c > 1
            active = (contexts & 1).astype(bool)
            active[cell_room[many]] = True
            number, of_cell = np.cumsum(active) - 1, np.cumsum(many) - 1
            at = head = 0
            for sender, (heads, n) in zip(kinds[PAIR], sizes):
                rooms, mine = room[head : head + heads], cell[at : at + n]
                head, at = head + heads, at + n
                yield _row(part, PAIR_COUNT, sender, bundle(c[mine], followers[rooms].astype(np.uint32), active[rooms]))
                kept, open_ = of_cell[mine[many[mine]]], number[rooms[active[rooms]]]
                if len(kept) + len(open_):
                    yield _row(part, ASKED_CELLS, sender, bundle(kept.astype(np.uint32), open_.astype(np.uint32)))
            # Words that occur once at all are known to their owner; the others' cells of one customer are reported.
            one = (c == 1) & ((listed[cell_word] & 1) == 0)
            ones = np.bincount(cell_word[one], minlength=len(listed))
            some = np.flatnonzero(ones)
            for owner, own in _shares(listed[some], owners):
                names = listed[some[own]]
                yield _row(owner, SINGLE, part, bundle((names >> 1) // owners, ones[some[own]]))
            singles = np.bincount(cell_room[c == 1], minlength=len(contexts))
            used, word = np.unique(cell_word[many], return_inverse=True)
            state = State(contexts[active], singles[active], number[cell_room[many]], listed[used], word, c[many], np.ones(int(many.sum()), np.int64))
            yield from state.rows(part, owners)

    return messages(run)


# --- sweeps -----------------------------------------------------------------------------------------------------------


class State:
    """The seating of a part: its contexts, and its cells of two or more customers with their numbers of tables."""

    def __init__(self, contexts: np.ndarray, singles: np.ndarray, room: np.ndarray, names: np.ndarray, word: np.ndarray, c: np.ndarray, t: np.ndarray, sums: np.ndarray | None = None, totals: list[np.ndarray] | None = None):
        self.contexts, self.singles, self.room, self.names, self.word, self.c, self.t = contexts, singles, room, names, word, c, t
        self.sums = np.zeros(len(t), np.int64) if sums is None else sums
        self.totals = totals or []
        self.hot = np.flatnonzero(contexts & 1)

    def tables(self) -> np.ndarray:
        """Tables of each context in this part."""
        return self.singles + np.bincount(self.room, self.t, len(self.contexts)).astype(np.int64)

    def rows(self, part: int, owners: int) -> Iterator[Message]:
        """What goes on to the next sweep, and to the owners: tables per word, tables of contexts that lie in several parts."""
        yield _row(part, STATE, part, bundle(self.contexts, self.names, self.singles, np.diff(self.room, prepend=0), self.word, self.c, self.t, self.sums, *self.totals))
        tables = np.bincount(self.word, self.t, len(self.names)).astype(np.int64)
        for owner, at in _shares(self.names, owners):
            yield _row(owner, SUM, part, bundle((self.names[at] >> 1) // owners, tables[at]))
        if len(self.hot):
            names, local = self.contexts[self.hot], self.tables()[self.hot]
            for owner, at in _cut((mix(names.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % owners):
                yield _row(owner, HOT_SUM, part, bundle(names[at], local[at]))

    @classmethod
    def of(cls, raw: bytes) -> State:
        contexts, names, singles, room, word, c, t, sums, *totals = unbundle(raw)
        return cls(contexts, singles, np.cumsum(room), names, word, c, t, sums, totals)

    def hear(self, kinds: dict[int, list[dict]], owners: int) -> tuple[np.ndarray, np.ndarray]:
        """The owners' answers: the parent's mass per word, and the tables of each context over all parts."""
        mass, tables = np.ones(len(self.names)), self.tables()
        given = {r["sender"]: r["body"] for r in kinds.get(MASS, [])}
        if given:
            for owner, at in _shares(self.names, owners):
                mass[at] = unbundle(given[owner])[0] / UNIT
        given = {r["sender"]: r["body"] for r in kinds.get(HOT, [])}
        names = self.contexts[self.hot]
        for owner, at in _cut((mix(names.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % owners):
            tables[self.hot[at]] = unbundle(given[owner])[0]
        return mass, tables


def seat(state: State, mass: np.ndarray, tables: np.ndarray, seed: int, sweep: int, inner: int = INNER, d: float = DISCOUNT, theta: float = STRENGTH) -> None:
    """Draw the tables of all cells ``inner`` times; ``mass`` is the parent's share of each word.

    Contexts that lie in several parts are drawn once, as their total is known between sweeps only.
    """
    context_key = mix(state.contexts.astype(np.uint64))
    cell_key = mix(context_key[state.room] + state.names.astype(np.uint64)[state.word])
    weight = d * mass[state.word]
    split = (state.contexts & 1).astype(bool)
    now = np.arange(len(state.c))
    for k in range(inner):
        g = gammas(theta / d + tables, salted(context_key, seed, sweep, k, _CONTEXT))
        room = state.room[now]
        state.t[now] = draw_tables(state.c[now], g[room] * weight[now], uniform(salted(cell_key[now], seed, sweep, k, _CELL), 0), d)
        tables = np.where(split, tables, state.tables())
        if not k and split.any():
            now = np.flatnonzero(~split[state.room])


def _swept(owners: int, seed: int, sweep: int, total_mass: float, note: bool, keep: bool):
    """A part's next seating. ``note``: the one before was a sample, so note the tables of contexts in several parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Message]:
        for part, kinds in _received(batches).items():
            if STATE not in kinds:
                continue
            state = State.of(kinds[STATE][0]["body"])
            mass, tables = state.hear(kinds, owners)
            if note and len(state.hot):
                state.totals[-1] = tables
            seat(state, mass / total_mass, tables, seed, sweep)
            if keep:
                state.sums += state.t
                state.totals.append(state.tables())
            yield from state.rows(part, owners)

    return messages(run)


def parent_mass(c: np.ndarray, t: np.ndarray, key: np.ndarray, new: float, seed: int, sweep: int) -> np.ndarray:
    """The parent's distribution, not scaled: customers less discounts, and what comes anew from the base."""
    own = np.maximum(c - PARENT_DISCOUNT * t, 1e-9)
    y = gammas(own, salted(key, seed, sweep, _WORD_MASS)) + tilted_stables(new, PARENT_DISCOUNT, salted(key, seed, sweep, _WORD_NEW))
    return np.maximum(np.round(y * UNIT), 1).astype(np.int64)


def _owned(owners: int, seed: int, sweep: int, gamma: float, vocabulary: int, keep: bool):
    """The parent's seating and distribution for the words of an owner, and the tables of contexts in several parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Message]:
        for owner, kinds in _received(batches).items():
            for r in kinds.get(STATE, []):
                yield _row(r["sender"], STATE, r["sender"], r["body"])
            if BASE in kinds:
                ones = unbundle(kinds[BASE][0]["body"])[0]
            else:
                ones = np.zeros(sum(r["sender"] for r in kinds.get(LISTED, [])), np.int64)
                for r in kinds.get(SINGLE, []):
                    at, n = unbundle(r["body"])
                    ones[at] += n
                yield _row(owner, BASE, 0, bundle(ones))
            customers = ones.copy()
            sums = [(r["sender"], *unbundle(r["body"])) for r in kinds.get(SUM, [])]
            for _, at, tables in sums:
                customers[at] += tables
            key = mix((2 * (np.arange(len(ones)) * owners + owner)).astype(np.uint64))
            t = draw_tables(customers, np.full(len(ones), PARENT_DISCOUNT * gamma / (vocabulary + 1)), uniform(salted(key, seed, sweep, _WORD_TABLES), 0), PARENT_DISCOUNT)
            # The mass of words that no part asks for is needed in all only; the driver draws it.
            asked = np.zeros(len(ones), bool)
            for _, at, _ in sums:
                asked[at] = True
            mass = np.zeros(len(ones), np.int64)
            mass[asked] = parent_mass(customers[asked], t[asked], key[asked], gamma / (vocabulary + 1), seed, sweep)
            for part, at, _ in sums:
                yield _row(part, MASS, owner, bundle(mass[at]))
            for what, n in ((PARENT_TABLES, t.sum()), (PARENT_CUSTOMERS, customers.sum()), (PARENT_MASS, mass.sum()), (QUIET, (~asked).sum()), (QUIET_TABLES, t[~asked].sum()), (QUIET_CUSTOMERS, customers[~asked].sum())):
                yield _row(owner, what, int(n))
            if keep and len(ones):
                yield _row(owner, SEATED, sweep, bundle(customers, t))
            hot = [(r["sender"], *unbundle(r["body"])) for r in kinds.get(HOT_SUM, [])]
            if hot:
                names, where = np.unique(np.concatenate([h[1] for h in hot]), return_inverse=True)
                totals = np.bincount(where, np.concatenate([h[2] for h in hot])).astype(np.int64)
                for part, own, _ in hot:
                    yield _row(part, HOT, owner, bundle(totals[np.searchsorted(names, own)]))

    return messages(run)


def _cell_answers(owners: int):
    """What pieces have asked of a part's cells: sums of tables over the samples, and tables of contexts per sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Message]:
        for part, kinds in _received(batches).items():
            if STATE not in kinds:
                continue
            state = State.of(kinds[STATE][0]["body"])
            if len(state.hot):
                state.totals[-1] = state.hear(kinds, owners)[1]
            for r in kinds.get(ASKED_CELLS, []):
                cells, rooms = unbundle(r["body"])
                yield _row(part, CELL_TABLES, r["sender"], bundle(state.sums[cells], *(t[rooms] for t in state.totals)))

    return messages(run)


@messages
def _seated_words(batches: Iterator[pa.RecordBatch]) -> Iterator[Message]:
    """What pieces have asked of an owner's words: customers and tables of the parent per sample."""
    for owner, kinds in _received(batches).items():
        columns = [x for r in kinds.get(SEATED, []) for x in unbundle(r["body"])]
        for r in kinds.get(ASKED_WORDS, []):
            (at,) = unbundle(r["body"])
            yield _row(owner, WORD_TABLES, r["sender"], bundle(*(x[at] for x in columns)))


# --- scores -----------------------------------------------------------------------------------------------------------

_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def parent_probability(c: np.ndarray, t: np.ndarray, customers: int, tables: int, vocabulary: int) -> np.ndarray:
    """The predictive probability of words with c customers at t tables in the parent."""
    return (c - PARENT_DISCOUNT * t + (PARENT_STRENGTH + PARENT_DISCOUNT * tables) / (vocabulary + 1)) / (PARENT_STRENGTH + customers)


def pair_probability(p: Piece, plan: Plan, counts: dict[int, list], cells: dict[int, list], seated: dict[int, list]) -> np.ndarray:
    """The probability of each pair of a piece, averaged over the samples."""
    samples = plan.samples
    many = (p.names & 1) == 0
    # A word that occurs once has one customer at one table; an unknown one has none.
    customers = np.repeat((p.counts == 1).astype(np.int64)[None], len(samples), 0)
    tables = customers.copy()
    for k, at in _cut(_owner_of(p.vocabulary, plan.owners)):
        at = p.rank[at]
        at = at[many[at]]
        if len(at):
            for s in range(len(samples)):
                customers[s, at], tables[s, at] = seated[k][2 * s], seated[k][2 * s + 1]
    probability = np.empty(len(p.pairs))
    parent = [parent_probability(c, t, *sample, plan.vocabulary) for c, t, sample in zip(customers, tables, samples)]
    for part, at, starts, contexts in p.parts(plan):
        c, followers, active = counts[part]
        lengths = np.diff(starts, append=len(at))
        given = cells.get(part)
        mean = np.minimum(c, 1).astype(np.float64)
        if given is not None:
            mean[c > 1] = given[0] / len(samples)
        below = np.zeros(len(at))
        for s in range(len(samples)):
            total = followers.astype(np.float64)
            if given is not None:
                total[active] = given[1 + s]
            below += np.repeat(STRENGTH + DISCOUNT * total, lengths) * parent[s][p.after[at]] / len(samples)
        probability[at] = (c - DISCOUNT * mean + below) / (STRENGTH + p.customers[p.before[at]])
    return probability


def _read_piece(piece: pa.Table, answers: pa.Table, plan: Plan) -> tuple[Piece, np.ndarray]:
    told = _answers(answers)
    p = Piece(piece, told[COUNT], plan)
    return p, pair_probability(p, plan, told[PAIR_COUNT], told.get(CELL_TABLES, {}), told.get(WORD_TABLES, {}))


def _summed(plan: Plan):
    def run(_key, piece: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        names = [f.split()[0] for f in _RESULT.split(", ")]
        if not piece.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        p, probability = _read_piece(piece, answers, plan)
        logs = np.log10(probability)[p.where]
        base = np.log10((p.counts + 1) / (plan.tokens + plan.vocabulary + 1))[p.tokens]
        doc = np.repeat(np.arange(len(p.lengths)), p.lengths)
        add = lambda x: np.bincount(doc, x, len(p.lengths))
        score = add(logs)
        columns = [pa.array(p.doc_ids, mask=p.no_id), p.held, p.lengths.astype(np.int64), add(p.counts[p.tokens] > 0).astype(np.int64), np.full(len(p.lengths), plan.tokens), add(base), score, 10 ** (-score / p.lengths)]
        return pa.Table.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(columns, kinds)], names=names)

    return bounded(run)


def _listed_pairs(plan: Plan):
    def run(_key, piece: pa.Table, answers: pa.Table) -> pa.Table:
        p, probability = _read_piece(piece, answers, plan) if piece.num_rows else (None, np.empty(0))
        columns = [p.context[p.before], p.names[p.after], p.counts[p.after]] if p else [np.empty(0, np.int64)] * 3
        return pa.table(dict(zip(("context", "word", "n"), columns)) | {"probability": probability})

    return bounded(run)


def together(n: int) -> int:
    """How many tasks take n parts, or owners, from the sweeps on."""
    return min(n, max(LEAST_TASKS, -(-n // TOGETHER)))


def _totals(table: DataFrame) -> dict[int, int]:
    return {r["what"]: r["n"] for r in table.filter(F.col("what") >= TOTAL).groupBy("what").agg(F.sum("sender").alias("n")).collect()}


def _of(table: DataFrame, *what: int) -> DataFrame:
    return table.filter(F.col("what").isin(*what))


def _trained(docs: DataFrame, seed: int, burn_in: int, samples: int, part_tokens: int) -> tuple[GroupedData, GroupedData, Plan]:
    """Pieces of the documents beside all that the trained model answers them."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pitman-yor")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.save(texts.mapInArrow(_encoded, _PIECE), "pieces", batch_rows=PIECE_ROWS)
    n_pieces, size = pieces.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    parts, owners = (size // n + 1 + min(7, size // 50_000) for n in (part_tokens, OWNER_TOKENS))
    at = lambda frame, n: frame.repartitionById(n, F.col("part"))
    few = lambda frame, n: frame.repartitionById(together(n), F.col("part") % together(n))
    # About a piece for each task, whatever the session's number of partitions is.
    by_piece = lambda frame: frame.withColumnRenamed("sender", "piece").repartition(max(n_pieces, 1), "piece").groupBy("piece")

    counted = scratch.save(at(pieces.select("piece", "vocabulary", "counts").mapInArrow(_word_requests(owners), _ROWS), owners).mapInArrow(_counted(owners), _ROWS), "counts")
    known = _totals(counted)
    plan = Plan(parts, owners, part_tokens, *(known.get(k, 0) for k in (TOKENS, VOCABULARY, ONCE, ENDS)))
    counts = _of(counted, COUNT)
    asked = by_piece(pieces).cogroup(by_piece(counts)).applyInArrow(_pair_requests(plan), _ROWS)
    paired = scratch.save(at(asked, parts).mapInArrow(_paired(owners), _ROWS), "pairs")

    before, base, read = paired, _of(counted, LISTED).unionAll(_of(paired, SINGLE)), [paired]
    tables = plan.vocabulary  # the parent starts with one table per word, as do all cells
    total_mass, totals = 1.0, []
    for sweep in range(burn_in + samples + 1):
        keep = sweep > burn_in
        gamma = float(gammas(np.array([PARENT_STRENGTH / PARENT_DISCOUNT + tables]), salted(np.zeros(1, np.uint64), seed, sweep, _DRIVER))[0])
        if sweep:
            moved = few(_of(before, STATE, MASS, HOT), parts).mapInArrow(_swept(owners, seed, sweep, total_mass, sweep > burn_in + 1, keep), _ROWS)
        else:
            moved = _of(before, STATE, SUM, HOT_SUM)
        # Seatings go past the owners unchanged, so that one job does both sides of a sweep.
        routed = moved.withColumn("part", F.when(F.col("what") == STATE, F.col("part") % owners).otherwise(F.col("part")).cast("int")).unionAll(base)
        after = scratch.save(few(routed, owners).mapInArrow(_owned(owners, seed, sweep, gamma, plan.vocabulary, keep), _ROWS), f"sweep-{sweep}")
        got = _totals(after)
        # In one draw what no part asks for: words that occur once, others without a cell of two, and the unknown word.
        own = got.get(QUIET_CUSTOMERS, 0) + plan.once - PARENT_DISCOUNT * (got.get(QUIET_TABLES, 0) + plan.once)
        alike = float(gammas(np.array([own]), salted(np.ones(1, np.uint64), seed, sweep))[0]) if own > 0 else 0.0
        alike += stable_sum(gamma / (plan.vocabulary + 1) * (got.get(QUIET, 0) + plan.once + 1), PARENT_DISCOUNT, seed * 1000 + sweep)
        total_mass = got.get(PARENT_MASS, 0) / UNIT + alike
        tables = got.get(PARENT_TABLES, 0) + plan.once
        if keep:
            totals.append((got.get(PARENT_CUSTOMERS, 0) + plan.once, tables))
        if not sweep:
            base = _of(after, BASE)
        if not sweep or keep:
            read.append(after)
        if not any(before is x for x in read):
            scratch.drop(before)
        before = after

    cells = few(_of(before, STATE, HOT).unionAll(_of(paired, ASKED_CELLS)), parts).mapInArrow(_cell_answers(owners), _ROWS)
    seated = _of(counted, ASKED_WORDS)
    for table in read[2:]:
        seated = seated.unionAll(_of(table, SEATED))
    answers = counts.unionAll(_of(paired, PAIR_COUNT)).unionAll(cells).unionAll(few(seated, owners).mapInArrow(_seated_words, _ROWS))
    return by_piece(pieces), by_piece(answers), replace(plan, samples=tuple(totals))


def score_documents(docs: DataFrame, seed: int = 3, burn_in: int = BURN_IN, samples: int = SAMPLES, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) per row of ``docs`` (doc_id, text).

    Documents with crc32(doc_id as text) mod 7 = 2 are held out of training; a null doc_id is the empty text there. A
    null text is empty and has one token, its end. Repeated rows count each. An empty table gives no rows. The base
    score is log10 of an add-one model of single words, ``score`` that of the Pitman-Yor model, ``perplexity`` its
    inverse geometric mean per token.
    """
    pieces, answers, plan = _trained(docs, seed, burn_in, samples, part_tokens)
    return pieces.cogroup(answers).applyInArrow(_summed(plan), _RESULT)


def pair_probabilities(docs: DataFrame, seed: int = 3, burn_in: int = BURN_IN, samples: int = SAMPLES, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(context, word, n, probability) of the pairs of words of ``docs``, once per piece.

    Words are numbers; the context START stands before the first word of a text, and n is the training count of the
    word. Null texts are empty, an empty table gives no rows.
    """
    pieces, answers, plan = _trained(docs, seed, burn_in, samples, part_tokens)
    return pieces.cogroup(answers).applyInArrow(_listed_pairs(plan), "context long, word long, n long, probability double")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its scores under the unigram base and under the hierarchical Pitman-Yor model."""
    return score_documents(read_table(spark, sf_dir, "documents"))
