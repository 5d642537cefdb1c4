"""Operator 11, cross-tokenizer alignment by lockstep vectorised merging.

A text, with one space put before it, is encoded by a byte-level BPE (A) and by a sentencepiece BPE with byte fallback
(B, which adds that space itself).  Both token sequences then spell the same bytes, and two tokens are *linked* where
their byte ranges end together; those ends cut both sequences into *groups*.

*Encoding.*  Neither tokenizer joins what stands left of a single space to what follows it (A's pre-tokens only begin
with a space; ``Pair`` refuses a B whose vocabulary has a piece with the space mark behind another mark), so a text is
the concatenation of its units, cut before such spaces.  Every distinct unit is encoded once per worker, ``LEARN`` units
at a time.  Units are remembered up to ``UNITS``, and up to ``UNIT_BYTES`` of units and ids; then only the half met most
often stays, which bounds memory and changes no result.

*Merging.*  ``lockstep`` holds one state vector, the A and B pointers of all lanes.  Each step compares the byte ends
under the pointers of all lanes at once, emits a link and a cut where they agree, advances the pointer that is behind
(both where they agree), and drops finished lanes.  A lane is a document, or a stretch of at least ``LANE`` bytes of a
longer one that ends at a unit, where both tokenizers have an end; so a very long text costs no more steps than others.

*Counts.*  Documents are taken in blocks of about ``BLOCK_BYTES`` of text.  A block keeps its distinct linked id pairs
once with their number of links, and each document's links as places in that list.  A worker holds the links of the block
that it fills in this form, too, one list for each batch of its texts, and joins these lists at the end.  Pair counts of the corpus are a
sum over the lists; they come back by a join of the lists (every pair at most once a block, so a frequent pair is not a
hot key of all its links), and each block's answers meet its documents in one shuffle by block.  Nothing of that size
passes through the driver or is broadcast.

Defined results: a null or empty text, or one whose joined A or B bytes differ from space + text, has no tokens: zeros,
an empty group string and no links; rows that repeat an id are documents of their own and count as such; null ids come
back null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .registry import query

LANE = 1 << 10
BLOCK_BYTES = 8 << 20
UNITS, UNIT_BYTES = 300_000, 32 << 20
LEARN = 1 << 13                                # units given to the tokenizers at once
MARK = "▁"                                    # stands for a space in B's pieces
# lead bytes of two-, three-byte marks among which white space or MARK occur: no cut before these
UNSAFE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)


def byte_of_mark() -> dict[str, int]:
    """The marks that stand for single bytes in a byte-level vocabulary: printable Latin-1 as itself, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Vocabulary:
    """Token bytes of one tokenizer, back to back, and the id's text form with each separator."""

    def __init__(self, tokens: list[bytes], seps: tuple[bytes, bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.shown = np.array([str(i).encode() + s for s in seps for i in range(len(tokens))], object)


class Grown:
    """An array that values are added to; it is copied only where it runs out of room."""

    def __init__(self, kind, values=()):
        self.room, self.n = np.array(values, kind), len(values)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]

    def add(self, values: np.ndarray) -> None:
        to = self.n + len(values)
        if to > len(self.room):
            room = np.zeros(to + to // 4, self.room.dtype)
            room[: self.n] = self.all
            self.room = room
        self.room[self.n: to] = values
        self.n = to


class Pair:
    """Both tokenizers, and the ids of every unit met so far in this worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        to_byte = byte_of_mark()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        a_bytes = [bytes(to_byte[c] for c in n) if all(c in to_byte for c in n) else n.encode() for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        crossing = [p for i, p in enumerate(pieces) if MARK in p.lstrip(MARK) and not self.b.is_control(i)]
        if crossing:
            raise ValueError(f"B has pieces across a space, such as {crossing[0]!r}: its texts cannot be cut into units")
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.va, self.vb = Vocabulary(a_bytes, (b",", b"|")), Vocabulary(b_bytes, (b",", b";"))
        self.number: dict[bytes, int] = {}
        self.met = Grown(np.int64)                                       # how often, since the last halving
        self.ids = [Grown(np.int32), Grown(np.int32)]                  # A and B ids of all units, back to back
        self.ends = [Grown(np.int64, [0]), Grown(np.int64, [0])]
        self.clean = Grown(bool)                                         # both spell the unit's bytes
        self.held = 0                                                    # bytes of all units and their ids

    def _learn(self, new: list[bytes]) -> None:
        text = [u.decode("utf-8") for u in new]
        got = ([e.ids for e in self.a.encode_batch_fast(text, add_special_tokens=False)],
               self.b.encode([t[1:] for t in text], num_threads=1))
        sizes = np.array([len(u) for u in new], np.int64)
        raw = np.frombuffer(b"".join(new), np.uint8)
        clean = np.ones(len(new), bool)
        for k, (lists, voc) in enumerate(zip(got, (self.va, self.vb))):
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum()))
            ends = np.concatenate([[0], np.cumsum(counts)])
            spelt = np.concatenate([[0], np.cumsum(voc.size[flat])])[ends]
            clean &= np.diff(spelt) == sizes
            own = flat[np.repeat(clean, counts)]                        # of the units whose length is right: byte by byte
            wrong = np.flatnonzero(voc.bytes[C.ranges(voc.start[own], voc.size[own])] != raw[np.repeat(clean, sizes)])
            right = np.flatnonzero(clean)
            clean[right[np.searchsorted(np.cumsum(sizes[right]), wrong, side="right")]] = False
            self.ends[k].add(len(self.ids[k].all) + ends[1:])
            self.ids[k].add(flat)
            self.held += flat.nbytes
        self.clean.add(clean)
        self.met.add(np.zeros(len(new), np.int64))
        first = len(self.number)
        self.number.update(zip(new, range(first, first + len(new))))
        self.held += len(raw)

    def _halve(self) -> None:
        stay = np.sort(np.argsort(-self.met.all, kind="stable")[: UNITS // 2])
        stay = stay[self.met.all[stay] > 1]
        own = np.fromiter(map(len, self.number), np.int64, len(self.number))[stay]
        own += sum(4 * (e.all[stay + 1] - e.all[stay]) for e in self.ends)
        if own.sum() > UNIT_BYTES // 2:                     # those met most often for their size
            best = np.argsort(-self.met.all[stay] / own, kind="stable")
            stay = np.sort(stay[best[np.cumsum(own[best]) <= UNIT_BYTES // 2]])
        stays = np.zeros(len(self.number), bool)
        stays[stay] = True
        self.number = dict(zip(compress(self.number, stays.tolist()), range(len(stay))))
        for k in (0, 1):
            ids, count = self.tokens(k, stay)
            self.ids[k], self.ends[k] = Grown(np.int32, ids), Grown(np.int64, np.concatenate([[0], np.cumsum(count)]))
        self.clean, self.met = Grown(bool, self.clean.all[stay]), Grown(np.int64, np.zeros(len(stay), np.int64))
        self.held = sum(map(len, self.number)) + sum(x.all.nbytes for x in self.ids)

    def numbers(self, units: list[bytes]) -> np.ndarray:
        new = [u for u in dict.fromkeys(units) if u not in self.number]
        if new and (len(self.number) + len(new) > UNITS or self.held + sum(map(len, new)) > UNIT_BYTES):
            self._halve()
            new = [u for u in dict.fromkeys(units) if u not in self.number]
        for at in range(0, len(new), LEARN):
            self._learn(new[at: at + LEARN])
        out = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
        self.met.all[:] += np.bincount(out, minlength=len(self.met.all))
        return out

    def tokens(self, k: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these units back to back, tokens per unit)."""
        ends = self.ends[k].all
        count = ends[numbers + 1] - ends[numbers]
        return self.ids[k].all[C.ranges(ends[numbers], count)], count


_PAIRS: dict[tuple[str, str], Pair] = {}           # one per worker process, kept between its tasks


def pair_of(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def unit_places(data: np.ndarray) -> np.ndarray:
    """Places of the spaces before which both tokenizers have an end, inside texts that begin with a space of their own."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[1:-1] == 0x20) + 1
    lead = data[at + 1]
    safe = (data[at - 1] != 0x20) & (lead > 0x20) & (lead != 0x7F) & ~np.isin(lead, UNSAFE_LEADS)
    mark = MARK.encode()
    back = np.maximum(at - 3, 0)
    safe &= ~((at >= 3) & (data[back] == mark[0]) & (data[np.maximum(at - 2, 0)] == mark[1]) & (data[at - 1] == mark[2]))
    return at[safe]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, lanes_a: np.ndarray, lanes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of all lanes: (places of the A tokens, of the B tokens), in text order.

    ``end_a``, ``end_b``: byte ends of all tokens, rising; lane k holds the tokens ``lanes_a[k]:lanes_a[k + 1]`` and
    ``lanes_b[k]:lanes_b[k + 1]``, which end at the same byte."""
    state = np.stack([lanes_a[:-1], lanes_b[:-1]])
    stop = np.stack([lanes_a[1:], lanes_b[1:]])
    live = (state < stop).all(0)
    state, stop = state[:, live], stop[:, live]
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    while state.shape[1]:
        a, b = end_a[state[0]], end_b[state[1]]
        linked = a == b
        cut_a[state[0][linked]] = True
        cut_b[state[1][linked]] = True
        state[0] += a <= b
        state[1] += b <= a
        live = (state < stop).all(0)
        if not live.all():
            state, stop = state[:, live], stop[:, live]
    return np.flatnonzero(cut_a), np.flatnonzero(cut_b)


class Aligned:
    """The documents of one stretch of text: ids, links and where each document's tokens and links begin."""

    def __init__(self, pair: Pair, data: np.ndarray, offs: np.ndarray):
        """``data``: texts back to back, each with its space in front (an empty text has none); ``offs``: their starts."""
        cuts = unit_places(data)
        edge = np.zeros(len(data) + 1, bool)
        edge[offs], edge[cuts] = True, True
        edges = np.flatnonzero(edge)
        raw, places = data.tobytes(), edges.tolist()
        number = pair.numbers([raw[x:y] for x, y in zip(places, places[1:])])
        first = np.searchsorted(edges, offs)                             # first unit of each text, plus the end
        bad = np.concatenate([[0], np.cumsum(~pair.clean.all[number])])
        self.clean = (bad[first[1:]] == bad[first[:-1]]) & (offs[1:] > offs[:-1])
        keep = np.repeat(self.clean, np.diff(first))
        number, size = number[keep], np.diff(edges)[keep]
        units_of = np.concatenate([[0], np.cumsum(np.diff(first) * self.clean)])
        self.ids, ends, token_of_unit = [], [], []
        for k, voc in enumerate((pair.va, pair.vb)):
            ids, count = pair.tokens(k, number)
            self.ids.append(ids)
            ends.append(np.cumsum(voc.size[ids]))
            token_of_unit.append(np.concatenate([[0], np.cumsum(count)]))
        self.first = [t[units_of] for t in token_of_unit]                # first token of each text, plus the end
        # lanes: a new one with every text, and with the first unit that begins LANE bytes or more after another multiple
        at = np.concatenate([[0], np.cumsum(size)])
        stride = np.flatnonzero(np.diff(at[:-1] // LANE) > 0) + 1
        lane = np.sort(np.concatenate([units_of, stride])).astype(np.int64)
        self.links = lockstep(*ends, token_of_unit[0][lane], token_of_unit[1][lane])
        self.ends = ends
        self.link_of = np.searchsorted(self.links[0], self.first[0])     # first link of each text, plus the end

    def pairs(self) -> np.ndarray:
        """A id << 32 | B id of every link."""
        return (self.ids[0][self.links[0]].astype(np.int64) << 32) | self.ids[1][self.links[1]]

    def group_strings(self, pair: Pair) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        n_a, n_b = len(self.ids[0]), len(self.ids[1])
        la, lb = self.links
        cut_a, cut_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        cut_a[la], cut_b[lb] = 1, 1
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        shown = np.empty(n_a + n_b, object)
        # an A token stands behind the B tokens of earlier groups, a B token behind the A tokens up to its own group
        shown[np.arange(n_a) + np.concatenate([[0], lb + 1])[group_a]] = pair.va.shown[self.ids[0] + cut_a * len(pair.va.size)]
        shown[np.arange(n_b) + (la + 1)[group_b]] = pair.vb.shown[self.ids[1] + cut_b * len(pair.vb.size)]
        shown = shown.tolist()
        starts = (self.first[0] + self.first[1]).tolist()
        return [b"".join(shown[x:y])[:-1] for x, y in zip(starts, starts[1:])]


def stretches(data: np.ndarray, offs: np.ndarray, limit: int = C.STAGE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, numbers of the texts) of at most about ``limit`` bytes; a longer text comes in several stretches, cut at
    units, one after the other.  Every text of more than nothing gets its space in front."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        size = np.diff(offs[at: to + 1])
        if size.max(initial=0) <= limit:
            starts = np.concatenate([[0], np.cumsum(size + (size > 0))])
            out = np.full(starts[-1], 0x20, np.uint8)
            out[C.ranges(starts[:-1] + (size > 0), size)] = data[offs[at]: offs[to]]
            yield out, starts, np.arange(at, to)
        else:                                       # one long text
            own = np.concatenate([np.array([0x20], np.uint8), data[offs[at]: offs[to]]])
            places = np.append(unit_places(own), len(own))
            x = 0
            while x < len(own):
                y = int(places[min(np.searchsorted(places, x + limit), len(places) - 1)])
                yield own[x:y], np.array([0, y - x]), np.array([at])
                x = y
        at = to


DETAIL = "_id long, _sub int, a_ids array<int>, b_ids array<int>, a_links array<int>, b_links array<int>, cuts array<long>"
BLOCKS = ("_id long, _sub int, block long, n_a long, n_b long, n_links long, groups_sha256 string, codes array<int>, "
          "pairs array<long>, counts array<long>")


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class _Document:
    """What the stretches of one text add up to."""

    def __init__(self):
        self.clean, self.parts = True, []

    def add(self, clean: bool, *parts) -> None:
        self.clean &= clean
        self.parts.append(parts)


def documents(pair: Pair, batch: pa.RecordBatch, digest: bool):
    """Each document of the batch in turn: (row, parts) where parts has, per stretch, either
    (n_a, n_b, pair codes, group string) or (a ids, b ids, linked a places, linked b places, byte ends of the cuts)."""
    data, offs = C.buffer_of(batch.column(batch.schema.get_field_index("_text")))
    row, open_doc = -1, None
    for piece, starts, rows in stretches(data, offs):
        al = Aligned(pair, piece, starts)
        strings = al.group_strings(pair) if digest else None
        codes = al.pairs() if digest else None
        for i, r in enumerate(rows.tolist()):
            if r != row:
                if open_doc is not None:
                    yield row, open_doc
                row, open_doc = r, _Document()
            lo, hi = al.link_of[i], al.link_of[i + 1]
            a0, a1, b0, b1 = al.first[0][i], al.first[0][i + 1], al.first[1][i], al.first[1][i + 1]
            clean = bool(al.clean[i]) or starts[i + 1] == starts[i]
            if digest:
                open_doc.add(clean, int(a1 - a0), int(b1 - b0), codes[lo:hi], strings[i])
            else:
                begin = al.ends[0][a0 - 1] if a0 else 0
                open_doc.add(clean, al.ids[0][a0:a1], al.ids[1][b0:b1], al.links[0][lo:hi] - a0, al.links[1][lo:hi] - b0,
                             al.ends[0][al.links[0][lo:hi]] - begin)
    if open_doc is not None:
        yield row, open_doc


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    sizes = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, kind.to_pandas_dtype()), *arrays]), kind))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """``(_id, _sub, a_ids, b_ids, a_links, b_links, cuts)``: the ids, the places of linked tokens and the byte ends (in
    space + text) that cut both sequences into groups."""
    paths = paths or default_paths()
    C.bounded_batches(docs.sparkSession)

    def run(batches):
        pair = pair_of(*paths)
        for batch in C.small_batches(batches, limit=C.STAGE_BYTES):
            columns = [[] for _ in range(5)]
            for _, doc in documents(pair, batch, digest=False):
                out, at = [[] for _ in range(5)], np.zeros(3, np.int64)
                for a, b, la, lb, cuts in doc.parts if doc.clean else []:
                    for col, values in zip(out, (a, b, la + at[0], lb + at[1], cuts + at[2])):
                        col.append(values)
                    at += len(a), len(b), cuts[-1] if len(cuts) else 0
                for col, values in zip(columns, out):
                    col.append(np.concatenate([np.zeros(0, np.int64), *values]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in ("_id", "_sub")]
                + [_lists(c, pa.int64() if i == 4 else pa.int32()) for i, c in enumerate(columns)],
                names=["_id", "_sub", "a_ids", "b_ids", "a_links", "b_links", "cuts"])

    return C.keyed(docs, id_col, text_col).mapInArrow(run, DETAIL)


class _Block:
    """Documents of one block, and their links as places in a list of distinct pairs: one list per batch of texts until the
    block is full, so that 4 bytes a link are held and only one batch's links are sorted at once."""

    def __init__(self, number: int):
        self.number, self.rows, self.held = number, [], 0
        self.lists = []                               # (distinct pairs, number of links of each, place of every link)

    def add(self, rows: list[tuple], links: list[np.ndarray], size: int) -> None:
        """``rows``: (id, sub, n_a, n_b, n_links, digest) of each document; ``links``: their pair codes, in order."""
        pairs, place, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *links]), return_inverse=True, return_counts=True)
        self.lists.append((pairs, counts, place.astype(np.int32)))
        self.rows += rows
        self.held += size

    def batches(self) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        pairs, place = np.unique(np.concatenate([x[0] for x in self.lists]), return_inverse=True)
        counts, first = np.zeros(len(pairs), np.int64), 0
        codes = np.zeros(sum(len(x[2]) for x in self.lists), np.int32)
        at = 0
        for own, n, links in self.lists:
            now = place[first: first + len(own)]
            counts[now] += n                              # a list has a pair once
            codes[at: at + len(links)] = now[links]
            first, at = first + len(own), at + len(links)
        self.lists = []
        n = len(self.rows)
        columns = list(zip(*self.rows))
        ends = np.concatenate([[0], np.cumsum(columns[4])]).astype(np.int32)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        cols = [pa.array(x, t) for x, t in zip(columns, kinds)]
        cols.insert(2, pa.array([self.number] * n, pa.int64()))
        cols += [pa.ListArray.from_arrays(pa.array(ends), pa.array(codes))] + [pa.nulls(n, pa.list_(pa.int64()))] * 2
        yield pa.RecordBatch.from_arrays(cols, names=names)
        if len(pairs):
            one = [pa.nulls(1, t) for t in (pa.int64(), pa.int32())] + [pa.array([self.number], pa.int64())]
            one += [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))]
            one += [_lists([pairs], pa.int64()), _lists([counts], pa.int64())]
            yield pa.RecordBatch.from_arrays(one, names=names)


def _blocks(docs: DataFrame, id_col: str, text_col: str, paths: tuple[str, str]) -> DataFrame:
    """One row per document and one per block (its distinct pairs and their numbers of links); see the module's text."""
    C.bounded_batches(docs.sparkSession)

    def run(batches):
        pair = pair_of(*paths)
        block = _Block(TaskContext.get().partitionId() << 32)
        for batch in C.small_batches(batches, limit=C.STAGE_BYTES):
            ids, subs = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("_id", "_sub"))
            rows, links = [], []
            for r, doc in documents(pair, batch, digest=True):
                if doc.clean and doc.parts and doc.parts[0][0]:
                    text = hashlib.sha256()
                    for i, part in enumerate(doc.parts):
                        text.update((b";" if i else b"") + part[3])
                    rows.append((ids[r], subs[r], *(sum(p[i] for p in doc.parts) for i in (0, 1)), sum(len(p[2]) for p in doc.parts),
                                 text.hexdigest()))
                    links += [p[2] for p in doc.parts]
                else:
                    rows.append((ids[r], subs[r], 0, 0, 0, ""))
            block.add(rows, links, batch.column(batch.schema.get_field_index("_text")).nbytes)
            if block.held >= BLOCK_BYTES:
                yield from block.batches()
                block = _Block(block.number + 1)
        if block.rows:
            yield from block.batches()

    return C.keyed(docs, id_col, text_col).mapInArrow(run, BLOCKS)


SUMS = "_id long, _sub int, n_a long, n_b long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _with_counts(batches):
    """Rows sorted by (block, kind, code): a block's answers, one row per pair in code order, then its documents."""
    block, counts, best = None, [], []
    for batch in batches:
        blocks, kinds = C.column(batch, "block"), C.column(batch, "kind")
        edge = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows] if batch.num_rows else []):
            part = batch.slice(lo, hi - lo)
            if blocks[lo] != block:
                block, counts, best = blocks[lo], [], []
            if kinds[lo] == 0:
                counts.append(C.column(part, "n").astype(np.int64))
                best.append(C.column(part, "best").astype(np.int64))
                continue
            if len(counts) != 1:
                counts = [np.concatenate([np.zeros(0, np.int64), *counts])]
                best = [np.concatenate([np.zeros(0, np.int64), *best])]
            lists = part.column(part.schema.get_field_index("codes"))
            codes = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            sums = [np.concatenate([[0], np.cumsum(x[0][codes])])[ends] for x in (best, counts)]
            named = {n: part.column(part.schema.get_field_index(n)) for n in ("_id", "_sub", "n_a", "n_b", "n_links", "groups_sha256")}
            named |= {n: pa.array(np.diff(s), pa.int64()) for n, s in zip(("n_best", "count_sum"), sums)}
            names = [f.split()[0] for f in SUMS.split(", ")]
            yield pa.RecordBatch.from_arrays([named[n] for n in names], names=names)


def link_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    paths: tuple[str, str] | None = None) -> DataFrame:
    """``(_id, _sub, n_a, n_b, n_links, n_best, count_sum, groups_sha256)`` with the corpus' pair counts."""
    blocks = C.stored(_blocks(docs, id_col, text_col, paths or default_paths()), "cross-align")
    lists = blocks.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("code", "x")) \
        .select("block", "code", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("own"))
    count = lists.groupBy("pair").agg(F.sum("own").alias("n"))
    # at most one row per A id in each window
    top = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    count = count.select("pair", "n", (F.col("n") == top).cast("int").alias("best"))
    answers = lists.select("block", "code", "pair").join(count, "pair").select("block", "code", "n", "best")
    docs_side = blocks.where("pairs IS NULL").drop("pairs", "counts").withColumn("kind", F.lit(1))
    both = docs_side.unionByName(answers.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "kind", "code").mapInArrow(_with_counts, SUMS)


@query("op11_cross_tokenizer_alignment")
def op11_cross_tokenizer_alignment(spark, sf_dir):
    out = link_statistics(C.table(spark, sf_dir, "documents"))
    return out.select(C.public_id(), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")
