"""Operator 8, benchmark decontamination: a generalised suffix automaton of the normalised test items.

The items are normalised into words, numbered, and put into one automaton (every item restarts at the root).
Training documents stream through it word by word; the state keeps the longest suffix of the words read that
occurs in any item.  A match of ``window`` words or more, or one whole shorter item, marks its words as hit.

Only words of the items can extend a match, and no match crosses another word, so the stream is first cut
(numpy, whole batch at once) into runs of item words that are long enough to hold a window; only those runs
go through the automaton.

Items of up to ``MAX_ITEM_BYTES`` together make one automaton, built on the driver and broadcast.  More items are dealt
as a Spark table to groups of ``GROUP_BYTES`` (a longer item is cut into pieces that overlap by a window less a word, so
that it keeps its windows), and each group's automaton is built in the tasks that stream documents against it.  A document
meets the groups that share a key with it: every window, of items and documents, names the least of its ``GRAM``-word grams,
so equal windows name equal keys and no match is lost.  Hits are a union, so the groups' spans and items add up exactly.

Defined results: a null text has no words; an item without words never matches; items with equal text each
count; null item ids are written as the empty string; an empty benchmark gives no hits; repeated documents each
get their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .registry import query

WINDOW = 13
COVERAGE = 20          # contaminated: 20 * hit words >= words
MAX_ITEM_BYTES = 4 << 20   # one broadcast automaton; more items are dealt to groups
GROUP_BYTES = 1 << 20
GRAM, KEY_BITS, SPLIT_DOCS = 5, 23, 5000


class ItemAutomaton:
    """Generalised suffix automaton over word numbers, with the item windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names: list[str] = []
        self.shortest = window
        owned: dict[int, dict[int, set[int]]] = {}   # state -> window length -> items with that window
        coded = []
        for name, words in items:
            if words:
                coded.append((len(self.names), [self.words.setdefault(w, len(self.words)) for w in words]))
                self.names.append(name)
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        for item, seq in coded:
            size = min(window, len(seq))
            self.shortest = min(self.shortest, size)
            state, length = 0, 0
            for c in seq:                        # every item is in the automaton: the walk never falls off
                state, length = self.next[state][c], length + 1
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                length = min(length, self.length[state])
                if length >= size:
                    owned.setdefault(state, {}).setdefault(size, set()).add(item)
        self.owned = owned

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def stream(self, codes) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans ``(start, end)`` and the items whose windows occur, for one run of word numbers."""
        spans, seen = [], set()
        state = length = 0
        nexts, links, lengths = self.next, self.link, self.length
        for i, c in enumerate(codes):
            while state and c not in nexts[state]:
                state = links[state]
                length = lengths[state]
            state = nexts[state].get(c, 0)
            length = length + 1 if state else 0
            if length < self.shortest:
                continue
            at, best = state, 0
            while at > 0:                        # windows that end here, longest state first
                for size, names in self.owned.get(at, {}).items():
                    if size <= length:
                        best = max(best, size)
                        seen |= names
                at = links[at]
            if best:
                spans.append((i + 1 - best, i + 1))
        return spans, seen


def _item_words(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    start, end, _ = C.word_spans(data, np.array([0, len(data)]), C.WORD_FOLDED)
    low = C.LOWER[data].tobytes()
    return [low[a:b] for a, b in zip(start.tolist(), end.tolist())]


def item_bytes(benchmark: DataFrame, text_col: str = "text") -> int:
    return benchmark.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def build_automaton(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                    window: int = WINDOW) -> ItemAutomaton:
    size = item_bytes(benchmark, text_col)
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"test items hold {size} bytes; the automaton is broadcast only up to {MAX_ITEM_BYTES}")
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).collect()
    return ItemAutomaton([(r.i or "", _item_words(r.t)) for r in rows], window)


OUT = "_id long, _sub int, n_words long, n_hit long, n_items long, items string, hits array<struct<start:int,end:int>>"


class Scanner:
    """The automaton with its vocabulary as sorted word hashes; one per task."""

    def __init__(self, automaton: ItemAutomaton):
        self.automaton = automaton
        vocab = sorted((int(h), c) for h, c in zip(_hashes(list(automaton.words)), automaton.words.values()))
        self.known = np.array([h for h, _ in vocab], C.U64)
        self.code_of = np.array([c for _, c in vocab], np.int64)

    def texts(self, column: pa.Array):
        """(words, hit words, item ids, hit spans in words and bytes) of each text."""
        a = self.automaton
        data, offs = C.buffer_of(column)
        start, end, first = C.word_spans(data, offs, C.WORD_FOLDED)
        hits: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        if len(start) and len(self.known):
            h = C.ROLL_A.span(C.ROLL_A.prefix(C.BYTE_A[C.LOWER[data]]), start, end)
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            code = np.where(self.known[at] == h, self.code_of[at], -1)
            for lo, hi in _runs(code, first, a.shortest):
                doc = int(np.searchsorted(first, lo, side="right")) - 1
                spans, seen = a.stream(code[lo:hi].tolist())
                if spans:
                    hits.setdefault(doc, []).extend((lo + s, lo + e) for s, e in spans)
                    items.setdefault(doc, set()).update(seen)
        n_words = np.diff(first).astype(np.int64)
        n_hit = np.zeros(len(n_words), np.int64)
        spans_out: list[list[dict]] = [[] for _ in n_words]
        for doc, spans in hits.items():
            base = first[doc]
            s = np.array(spans, np.int64) - base
            mask = C.cover(int(n_words[doc]), s[:, 0], s[:, 1])
            n_hit[doc] = mask.sum()
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
            o = offs[doc]
            spans_out[doc] = [{"from": int(x), "to": int(y), "start": int(start[base + x] - o), "end": int(end[base + y - 1] - o)}
                              for x, y in edge.reshape(-1, 2)]
        return n_words, n_hit, [sorted(a.names[i] for i in items.get(d, ())) for d in range(len(n_words))], spans_out


BYTES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, automaton: ItemAutomaton) -> DataFrame:
    """Per document: word counts, item ids (comma-joined, sorted as strings) and hit byte spans of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        scanner = Scanner(shared.value)
        for batch in C.small_batches(batches):
            n_words, n_hit, names, spans = scanner.texts(batch.column(batch.schema.get_field_index("_text")))
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("_id")), batch.column(batch.schema.get_field_index("_sub")),
                pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()),
                pa.array([",".join(x) for x in names], pa.string()),
                pa.array(spans, BYTES)],
                names=["_id", "_sub", "n_words", "n_hit", "n_items", "items", "hits"])

    return docs.mapInArrow(run, OUT)


ITEM = "g long, u long, name string, _text string"


def item_groups(benchmark: DataFrame, total: int, id_col: str = "item_id", text_col: str = "text",
                window: int = WINDOW) -> DataFrame:
    """``(g, u, name, _text)``: the items (``u`` numbers them) or their pieces, in groups of ``GROUP_BYTES``."""
    limit = GROUP_BYTES

    def pieces(text):
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        if len(data) <= limit:
            yield text
            return
        start, end, _ = C.word_spans(data, np.array([0, len(data)]), C.WORD_FOLDED)
        a, n = 0, len(start)
        while a < n:
            b = min(n, max(a + window, int(np.searchsorted(end, start[a] + limit, side="right"))))
            yield data[start[a]:end[b - 1]].tobytes().decode("utf-8")
            a = n if b == n else b - window + 1

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        g, held, u = 0, 0, 0
        for batch in C.small_batches(batches):
            out = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece in pieces(text):
                    size = len(piece.encode("utf-8"))
                    if held and held + size > limit:
                        g, held = g + 1, 0
                    held += size
                    out.append((base + g, base + u, name, piece))
                u += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                    zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["g", "u", "name", "_text"])

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"),
                            F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return C.stored(rows.coalesce(-(-total // limit)).mapInArrow(run, ITEM), "item-groups")


def _window_keys(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every window of ``size`` words: the hash of the window's least gram."""
    gram = min(size, GRAM)
    count = np.maximum(0, np.diff(first) - size + 1)
    doc = np.repeat(np.arange(len(count)), count)
    if not len(doc):
        return doc, np.zeros(0, C.U64)
    at = np.arange(len(h) - gram + 1)
    g = C.ROLL_B.span(C.ROLL_B.prefix(h), at, at + gram)
    return doc, C.mix(g[C.rightmost_minimum(g, size - gram + 1)[C.ranges(first[:-1], count)]] + C.U64(size))


def _words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offs = C.buffer_of(batch.column(batch.schema.get_field_index("_text")))
    start, end, first = C.word_spans(data, offs, C.WORD_FOLDED)
    return C.ROLL_A.span(C.ROLL_A.prefix(C.BYTE_A[C.LOWER[data]]), start, end), first


def _document_groups(docs: DataFrame, groups: DataFrame, window: int) -> DataFrame:
    """``(_id, _sub, g)``: the groups that share a window key with a document.  A bitmap of the items' keys (of a fixed
    size; where it fills up it lets more pass, never fewer) keeps most other keys from being shuffled."""

    def item_keys(batches):
        for batch in C.small_batches(batches):
            h, first = _words_of(batch)
            g, least = C.column(batch, "g"), np.minimum(np.diff(first), window)
            for size in np.unique(least[least > 0]).tolist():
                doc, key = _window_keys(h, first, size)
                use = least[doc] == size
                yield pa.RecordBatch.from_arrays([pa.array(key[use].view(np.int64)), pa.array(g[doc[use]]),
                                                  pa.array(np.full(use.sum(), size, np.int32))], names=["key", "g", "size"])

    keys = C.stored(groups.mapInArrow(item_keys, "key long, g long, size int").distinct(), "item-keys")
    sizes = sorted(r[0] for r in keys.select("size").distinct().collect())          # at most ``window`` rows
    bitmap = np.zeros(1 << (KEY_BITS - 6), C.U64)
    place = F.pmod("key", F.lit(1 << KEY_BITS))
    cells = keys.select(F.shiftright(place, 6).alias("c"), F.pmod(place, F.lit(64)).cast("int").alias("b"))
    for c, w in cells.select("c", F.expr("shiftleft(1L, b)").alias("w")).groupBy("c").agg(F.bit_or("w")).toLocalIterator():
        bitmap[c] = C.U64(w & C.MASK)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def document_keys(batches):
        bits = shared.value
        for batch in C.small_batches(batches):
            h, first = _words_of(batch)
            ids, subs = C.column(batch, "_id"), C.column(batch, "_sub")
            for size in sizes:
                doc, key = _window_keys(h, first, size)
                at = key & C.U64((1 << KEY_BITS) - 1)
                use = (bits[at >> C.U64(6)] >> (at & C.U64(63)) & C.U64(1)).astype(bool)
                doc, key = doc[use], key[use]
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                doc, key = doc[new], key[new]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[doc]), pa.array(subs[doc])],
                                                 names=["key", "_id", "_sub"])

    found = docs.mapInArrow(document_keys, "key long, _id long, _sub int")
    return C.stored(found.join(keys.select("key", "g").distinct(), "key").select("_id", "_sub", "g").distinct(), "document-groups")


HITS = "_id long, _sub int, own array<struct<u:long,name:string>>, spans array<struct<from:int,to:int,start:int,end:int>>"


def scan_dealt(docs: DataFrame, benchmark: DataFrame, total: int, window: int = WINDOW) -> DataFrame:
    """The result of ``scan`` for any number of items: one automaton per group of items, inside the tasks."""
    groups = item_groups(benchmark, total, window=window)
    pairs = _document_groups(docs, groups, window)
    splits = pairs.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / SPLIT_DOCS).cast("int").alias("n"))
    pairs = pairs.join(splits, "g").withColumn("s", F.pmod(F.xxhash64("_id", "_sub"), F.col("n")).cast("int"))
    texts = C.sieved(docs, pairs).join(pairs, ["_id", "_sub"]).select(
        "g", "s", F.lit(1).alias("kind"), "_id", "_sub", F.lit("").alias("name"), "_text")
    items = groups.join(splits, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"), F.lit(0).alias("kind"),
                                            F.col("u").alias("_id"), F.lit(0).alias("_sub"), "name", "_text")
    hits_type = pa.list_(pa.struct([(x, pa.int32()) for x in ("from", "to", "start", "end")]))

    def run(batches):
        key, held, scanner = None, [], None
        for batch in C.small_batches(batches):
            cols = [C.column(batch, x) for x in ("g", "s", "kind")]
            change = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            edges = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]]).tolist()
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if key != (cols[0][a], cols[1][a]):
                    key, held, scanner = (cols[0][a], cols[1][a]), [], None
                ids, subs, names, text = (part.column(part.schema.get_field_index(x)) for x in ("_id", "_sub", "name", "_text"))
                if cols[2][a] == 0:                                 # a group's items come before its documents
                    held += [((u, n), _item_words(t)) for u, n, t in zip(ids.to_pylist(), names.to_pylist(), text.to_pylist())]
                    continue
                if scanner is None:
                    scanner, held = Scanner(ItemAutomaton(held, window)), []
                _, n_hit, own, spans = scanner.texts(text)
                use = np.flatnonzero(n_hit)
                if len(use):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(use)), subs.take(pa.array(use)),
                         pa.array([[{"u": u, "name": n} for u, n in own[d]] for d in use],
                                  pa.list_(pa.struct([("u", pa.int64()), ("name", pa.string())]))),
                         pa.array([spans[d] for d in use], hits_type)], names=["_id", "_sub", "own", "spans"])

    def merge(batches):
        for batch in batches:
            rows = []
            for own, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                joined: list[dict] = []
                for s in sorted(spans, key=lambda x: (x["from"], x["to"])):
                    if joined and s["from"] <= joined[-1]["to"]:
                        if s["to"] > joined[-1]["to"]:
                            joined[-1] |= {"to": s["to"], "end": s["end"]}
                    else:
                        joined.append(s)
                names = sorted(n for _, n in {(o["u"], o["name"]) for o in own})
                rows.append((sum(s["to"] - s["from"] for s in joined), len(names), ",".join(names), joined))
            n_hit, n_items, names, spans = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()),
                 pa.array(names, pa.string()), pa.array(spans, BYTES)], names=["_id", "_sub", "n_hit", "n_items", "items", "hits"])

    def count(batches):
        for batch in C.small_batches(batches):
            _, first = _words_of(batch)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(x)) for x in ("_id", "_sub")]
                                             + [pa.array(np.diff(first).astype(np.int64))], names=["_id", "_sub", "n_words"])

    found = items.unionByName(texts).repartition("g", "s").sortWithinPartitions("g", "s", "kind").mapInArrow(run, HITS)
    hits = "array<struct<start:int,end:int>>"
    merged = found.groupBy("_id", "_sub").agg(F.flatten(F.collect_list("own")).alias("own"),
                                              F.flatten(F.collect_list("spans")).alias("spans")) \
        .mapInArrow(merge, f"_id long, _sub int, n_hit long, n_items long, items string, hits {hits}")
    zero = F.lit(0).cast("long")
    return docs.mapInArrow(count, "_id long, _sub int, n_words long").join(merged, ["_id", "_sub"], "left").select(
        "_id", "_sub", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"), F.coalesce("hits", F.array().cast(hits)).alias("hits"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    if item_bytes(benchmark) > MAX_ITEM_BYTES:
        gone = decontaminate(docs, benchmark, id_col, text_col).where("contaminated").select("_id", "_sub")
        return C.keyed(docs, id_col, text_col, row=True).join(gone, ["_id", "_sub"], "left_anti").select("_row.*")
    shared = docs.sparkSession.sparkContext.broadcast(build_automaton(benchmark))

    def run(batches):
        scanner = Scanner(shared.value)
        for batch in C.small_batches(batches, text_col, C.STAGE_BYTES):
            n_words, n_hit, _, _ = scanner.texts(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array(~((n_hit > 0) & (COVERAGE * n_hit >= n_words))))

    return docs.mapInArrow(run, docs.schema)


def _hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words]) if words else np.zeros(0, np.int64)
    starts = ends - np.array([len(w) for w in words], np.int64)
    return C.ROLL_A.span(C.ROLL_A.prefix(C.BYTE_A[data]), starts, ends) if words else np.zeros(0, C.U64)


def _runs(code: np.ndarray, first: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of item words inside one document, of ``least`` words or more."""
    known = np.concatenate([[False], code >= 0, [False]])
    begins = known[1:-1] & ~known[:-2]
    ends = known[1:-1] & ~known[2:]
    heads = first[:-1][first[:-1] < len(code)]
    begins[heads] |= known[1:-1][heads]
    tails = first[1:][first[1:] > 0] - 1
    ends[tails] |= known[1:-1][tails]
    lo, hi = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    keep = hi - lo >= least
    return list(zip(lo[keep].tolist(), hi[keep].tolist()))


CONTAMINATED = f"n_hit > 0 AND {COVERAGE} * n_hit >= n_words"


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan result with ``contaminated``: hit words reach a twentieth of the document's words."""
    rows, total = C.keyed(docs, id_col, text_col), item_bytes(benchmark)
    out = scan_dealt(rows, benchmark, total) if total > MAX_ITEM_BYTES else scan(rows, build_automaton(benchmark))
    return out.withColumn("contaminated", F.expr(CONTAMINATED))


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bw),
sizes AS (SELECT DISTINCT k FROM win),
dp AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, sizes WHERE len(w) >= k),
occ AS (SELECT DISTINCT p.doc_id, p.i, p.k, win.item_id FROM
        (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM dp) p JOIN win ON win.g = p.g AND win.k = p.k),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op8_benchmark_decontamination", ORACLE)
def op8_benchmark_decontamination(spark, sf_dir):
    out = decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select(C.public_id(), "n_words", "n_hit", "n_items",
                      F.sha2(F.col("items"), 256).alias("items_sha256"), "contaminated")
