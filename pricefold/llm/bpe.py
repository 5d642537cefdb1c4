"""Operator 2, BPE encoding and decoding with content-defined chunk reuse.

A text is cut into chunks where a rolling hash of the last ``ROLL`` bytes hits ``1 / 2**CUT_BITS`` and white space
follows, so that passages shared by documents give equal chunks wherever they stand.  Inside a worker every distinct
chunk is encoded once, whatever the number of documents that hold it; a new chunk is put together from its words, and
every distinct word is given to the tokenizer once.  Results beyond ``CHUNK_BYTES`` and ``WORDS`` are dropped, the
words met least often first, and rebuilt when needed, which bounds memory and changes no result.

Each join of two chunks is repaired: the words around it are re-encoded together, first one on each side, then twice as
many, until the outer words of the re-encoded stretch come out as they did alone; its ids then replace those of the
chunks.  (A vocabulary that drops white space, as the default one does, agrees at the first try.)  A vocabulary that
keeps white space has no words to share; its texts are encoded whole.

Special tokens' strings in a text are encoded as the library does.  Defined results: a null text is the empty text,
which has no ids and decodes to the empty text; repeated documents each get a row; extra columns are ignored.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .registry import query

ROLL, CUT_BITS = 12, 8            # a cut at one white space in 256: chunks of about 1.5 kB
CHUNK_BYTES, WORDS = 8 << 20, 300_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def cut_places(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places of the white space bytes at which the rolling hash cuts."""
    if len(data) <= ROLL:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(C.SPACE[data])
    at = at[at >= ROLL]
    h = C.ROLL_A.span(C.ROLL_A.prefix(C.BYTE_A[data]), at - ROLL, at)
    return at[(h & C.U64((1 << CUT_BITS) - 1)) == 0]


class Encoder:
    """Word and chunk results of one task."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        ids = [tokenizer.encode(x, add_special_tokens=False).ids for x in ("tea for\ntwo", " tea \t for  two ")]
        self.drops_space = ids[0] == ids[1]
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [(tokenizer.id_to_token(i) or "").encode("utf-8") for i in range(size)] if tokenizer.decoder is None else None
        self.chunks: dict[bytes, tuple[np.ndarray, bytes]] = {}
        self.chunk_bytes = 0
        self.joins: dict[tuple[bytes, bytes], bool] = {}
        # results of all words met, by number: ids back to back, their ends, decoded text, how often met since the last halving
        self.number: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.shown, self.met = np.zeros(0, object), np.zeros(0, np.int64)

    def _learn(self, new: list[bytes]):
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in new], add_special_tokens=False)
        ids = [e.ids for e in encoded]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum()))
        shown = np.empty(len(new), object)
        if self.names is not None:           # no decoder: a text is its tokens, joined by spaces
            shown[:] = [b" ".join(map(self.names.__getitem__, x)) for x in ids]
        else:
            shown[:] = [self.tokenizer.decode(x, skip_special_tokens=False).encode("utf-8") for x in ids]
        first = len(self.number)
        self.number.update(zip(new, range(first, first + len(new))))
        self.flat, self.ends = np.concatenate([self.flat, flat]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(count)])
        self.shown, self.met = np.concatenate([self.shown, shown]), np.concatenate([self.met, np.zeros(len(new), np.int64)])

    def _halve(self) -> None:
        """Only the half met most often stays."""
        stay = np.sort(np.argsort(-self.met, kind="stable")[: WORDS // 2])
        stay = stay[self.met[stay] > 1]
        names = list(self.number)
        self.number = {names[i]: k for k, i in enumerate(stay.tolist())}
        count = self.ends[stay + 1] - self.ends[stay]
        self.flat = self.flat[C.ranges(self.ends[stay], count)]
        self.ends = np.concatenate([[0], np.cumsum(count)])
        self.shown, self.met = self.shown[stay], np.zeros(len(stay), np.int64)

    def chunk_results(self, wanted: list[bytes]) -> None:
        """Fill ``self.chunks`` for all of ``wanted``."""
        if self.chunk_bytes > CHUNK_BYTES:
            self.chunks, self.chunk_bytes = {}, 0
        todo = [c for c in dict.fromkeys(wanted) if c not in self.chunks]
        words = [c.split() for c in todo]
        every = list(chain.from_iterable(words))
        missing = [w for w in dict.fromkeys(every) if w not in self.number]
        if missing and len(self.number) + len(missing) > WORDS:
            self._halve()
            missing = [w for w in dict.fromkeys(every) if w not in self.number]
        if missing:
            self._learn(missing)
        at = np.fromiter(map(self.number.__getitem__, every), np.int64, len(every))
        self.met += np.bincount(at, minlength=len(self.met))
        count = self.ends[at + 1] - self.ends[at]
        flat, shown = self.flat[C.ranges(self.ends[at], count)], self.shown[at].tolist()
        upto = np.concatenate([[0], np.cumsum(count)])
        lo = 0
        for c, own in zip(todo, words):
            hi = lo + len(own)
            ids = flat[upto[lo]: upto[hi]].copy()
            self.chunks[c] = (ids, b" ".join(filter(None, shown[lo:hi])))
            self.chunk_bytes += len(c) + 4 * len(ids) + len(self.chunks[c][1])
            lo = hi

    def agree(self, pairs: list[tuple[bytes, bytes]]) -> None:
        """Re-encode the two words around each new join."""
        if len(self.joins) > WORDS:
            self.joins = {}
        new = [p for p in dict.fromkeys(pairs) if p not in self.joins]
        text = [(a + b" " + b).decode("utf-8") for a, b in new]
        for (a, b), e in zip(new, self.tokenizer.encode_batch_fast(text, add_special_tokens=False)):
            self.joins[a, b] = e.ids == self._word(a) + self._word(b)

    def _word(self, w: bytes) -> list[int]:
        k = self.number.get(w)
        if k is None:
            return self.tokenizer.encode(w.decode("utf-8"), add_special_tokens=False).ids
        return self.flat[self.ends[k]: self.ends[k + 1]].tolist()

    def repaired(self, pieces: list[bytes], seam: int) -> tuple[int, int, list[int]]:
        """The join after ``pieces[seam]`` re-encoded over ever more words: (ids to drop on the left, on the right,
        ids to put in)."""
        left = b"".join(pieces[: seam + 1]).split()
        right = b"".join(pieces[seam + 1:]).split()
        k = 1
        while True:
            k *= 2
            a, b = left[-k:], right[:k]
            ids = self.tokenizer.encode(b" ".join(a + b).decode("utf-8"), add_special_tokens=False).ids
            head, tail = self._word(a[0]), self._word(b[-1])
            whole = k >= len(left) and k >= len(right)
            if whole or (ids[: len(head)] == head and ids[len(ids) - len(tail):] == tail):
                return sum(len(self._word(w)) for w in a), sum(len(self._word(w)) for w in b), ids

    def documents(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, bytes]]:
        """Ids and decoded text of each document, given as its chunks."""
        if not self.drops_space:
            whole = self.tokenizer.encode_batch_fast([b"".join(p).decode("utf-8") for p in texts], add_special_tokens=False)
            return [(np.array(e.ids, np.int32), self.tokenizer.decode(e.ids, skip_special_tokens=False).encode("utf-8"))
                    for e in whole]
        self.chunk_results([c for pieces in texts for c in pieces])
        seams = {}
        for d, pieces in enumerate(texts):
            ends = [(i, p.split(None, 1)[0], p.rsplit(None, 1)[-1]) for i, p in enumerate(pieces) if p.strip()]
            seams[d] = [(x[0], (x[2], y[1])) for x, y in zip(ends, ends[1:])]
        self.agree([p for s in seams.values() for _, p in s])
        out = []
        for d, pieces in enumerate(texts):
            parts = [self.chunks[c] for c in pieces]
            broken = [i for i, p in seams[d] if not self.joins[p]]
            if broken:
                out.append(self._mended(pieces, broken))
            else:
                out.append((np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32),
                            b" ".join([p[1] for p in parts if p[1]])))
        return out

    def _mended(self, pieces: list[bytes], broken: list[int]) -> tuple[np.ndarray, bytes]:
        ids: list[int] = []
        for i, piece in enumerate(pieces):
            own = self.chunks[piece][0].tolist()
            if i and i - 1 in broken:
                drop_left, drop_right, middle = self.repaired(pieces, i - 1)
                if drop_left > len(ids) or drop_right > len(own):     # the stretch outgrew its chunks
                    whole = self.tokenizer.encode(b"".join(pieces).decode("utf-8"), add_special_tokens=False).ids
                    ids = list(whole)
                    break
                ids = ids[: len(ids) - drop_left] + middle + own[drop_right:]
            else:
                ids += own
        return np.array(ids, np.int32), self.tokenizer.decode(ids, skip_special_tokens=False).encode("utf-8")


OUT = "_id long, _sub int, ids array<int>, decoded string"
_ENCODERS: dict[str, Encoder] = {}           # one per worker process, kept between its tasks


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(load(path))
    return _ENCODERS[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(_id, _sub, ids, decoded)``: the token ids of every whole text and the text they decode to."""
    path = path or tokenizer_path()
    C.bounded_batches(docs.sparkSession)

    def run(batches):
        encoder = encoder_of(path)
        for batch in C.small_batches(batches, limit=C.STAGE_BYTES):
            data, offs = C.buffer_of(batch.column(batch.schema.get_field_index("_text")))
            edges = np.unique(np.concatenate([offs, cut_places(data, offs)]))
            raw = data.tobytes()
            where = np.searchsorted(edges, offs)
            texts = [[raw[a:b] for a, b in zip(edges[lo:hi].tolist(), edges[lo + 1:hi + 1].tolist())]
                     for lo, hi in zip(where[:-1].tolist(), where[1:].tolist())]
            done = encoder.documents(texts)
            sizes = np.concatenate([[0], np.cumsum([len(ids) for ids, _ in done])]).astype(np.int32)
            flat = np.concatenate([ids for ids, _ in done])
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("_id")), batch.column(batch.schema.get_field_index("_sub")),
                 pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, pa.int32())),
                 pa.array([t for _, t in done], pa.binary()).cast(pa.string())], names=["_id", "_sub", "ids", "decoded"])

    return C.keyed(docs, id_col, text_col).mapInArrow(run, OUT)


def digest_columns() -> list:
    return [C.public_id(), F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
            F.sha2(F.col("decoded"), 256).alias("decoded_sha256")]


@query("op2_bpe_encoding")
def op2_bpe_encoding(spark, sf_dir):
    return encode(C.table(spark, sf_dir, "documents")).select(*digest_columns())
