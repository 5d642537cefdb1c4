"""Operator 13, chat formatting by a finite-state machine over roles and a declarative template.

A template (``Template``) states, as plain values, the segments that each role emits (literal text, the turn's text, its role,
and for each whether it counts for the loss), the role names that get segments of their own, the machine over roles
(state -> role -> next state) with the text that entering a conversation emits, and the escape mark.

*Escaping.*  Every literal is made of *control strings* and separators.  Inside a text (or a role name) the escape mark is
put behind the first mark of whatever begins like a control string, and an escape mark is doubled; so no control string
is left in it, what was escaped can be told from what was not, and ``unescape`` gives the text back.  ``Template`` refuses
literals in which a control string could arise across a text's edge, so read-back needs nothing but the output.

*Order.*  Turns are ordered by turn (null first), then role, then text.  The machine checks them: ``valid`` is false from
the first turn that the table has no entry for; that turn and all later ones are formatted all the same.  A conversation
is dealt out in blocks of ``BLOCK`` turn numbers, so one that holds a third of all rows is many tasks.  What a block does to
the machine is a map from states to states; the maps of a conversation of more than one block are composed in order, from
role names alone, and give each block its entry state.  Rows stream through a task, which never holds a block.

Defined results: a null text is the empty text; a null role, or one of a name without segments, is formatted under its
name by the template's segments for other roles (a null role as the empty name); rows that repeat a turn are turns of their
own; rows of null ``conv_id`` are one conversation, whose id comes back null; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .registry import query

BLOCK = 256                     # turn numbers that one task orders together
BROKEN = "broken"

Segment = tuple[str, bool]      # (literal, or TEXT / ROLE), counts for the loss
TEXT, ROLE = "{text}", "{role}"


@dataclass(frozen=True)
class Template:
    """Declarative chat format; see the module's text."""
    roles: dict[str, tuple[Segment, ...]]
    others: tuple[Segment, ...]                      # any other role
    order: dict[str, dict[str, str]]                 # state -> role -> next state; the first state is the start
    opening: str = ""                                # emitted before a conversation's first turn
    controls: tuple[str, ...] = ()
    escape: str = "␛"
    states: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        following = {s for row in self.order.values() for s in row.values()}
        object.__setattr__(self, "states", (*self.order, *sorted(following - set(self.order) - {BROKEN}), BROKEN))
        marks = set("".join(self.controls))
        if len(self.escape) != 1 or self.escape in marks or any(len(c) < 2 for c in self.controls):
            raise ValueError("the escape is one mark that no control string holds; control strings have two marks or more")
        for segments in (*self.roles.values(), self.others):
            for (a, _), (b, _) in zip(((None, False), *segments), (*segments, (None, False))):
                for edge in ((a, -1) if b in (TEXT, ROLE) else None, (b, 0) if a in (TEXT, ROLE) else None):
                    if edge and (not edge[0] or edge[0] in (TEXT, ROLE) or edge[0][edge[1]] in marks):
                        raise ValueError(f"beside a text there must be a literal whose edge is in no control string: {segments}")
        for segments in (*self.roles.values(), self.others):
            if not segments or not segments[0][0].startswith(self.controls) or not segments[-1][0].endswith(self.controls):
                raise ValueError(f"a turn begins and ends with a control string: {segments}")
        if len({s[0][0] for s in (*self.roles.values(), self.others)}) <= len(self.roles):
            raise ValueError("each role needs a first literal of its own")

    def escaper(self):
        starts: dict[str, list[str]] = {}
        for c in self.controls:
            starts.setdefault(c[0], []).append(re.escape(c[1:]))
        parts = [re.escape(self.escape)] + [f"{re.escape(a)}(?={'|'.join(rest)})" for a, rest in starts.items()]
        found, put = re.compile("|".join(parts)), self.escape
        return lambda text: found.sub(lambda m: m.group() + put, text)

    def unescaper(self):
        found = re.compile(re.escape(self.escape) + "(" + re.escape(self.escape) + ")?")
        return lambda text: found.sub(lambda m: m.group(1) or "", text)

    def step(self, state: str, role: str) -> str:
        return self.order.get(state, {}).get(role, BROKEN)


# The instruction format: control strings in square brackets and angle brackets, answers closed by the end mark.
INSTRUCT = Template(
    roles={"system": (("<<SYS>>\n", False), (TEXT, False), ("\n<</SYS>>", False)),
           "user": (("[INST] ", False), (TEXT, False), (" [/INST]", False)),
           "assistant": (("[ANS] ", False), (TEXT, True), (" </s>", False))},
    others=(("[ROLE] ", False), (ROLE, False), (" [SAYS] ", False), (TEXT, False), (" [/ROLE]", False)),
    order={"start": {"system": "primed", "user": "asked"}, "primed": {"user": "asked"},
           "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    opening="<s>",
    controls=("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ANS]", "[ROLE]", "[SAYS]", "[/ROLE]"))


def turn_segments(template: Template):
    """A function (role, text) -> [(emitted text, counts for the loss), ...] of one turn."""
    escape = template.escaper()
    own = {role: [(s, loss) for s, loss in segments] for role, segments in template.roles.items()}

    def emit(role: str, text: str) -> list[tuple[str, bool]]:
        return [(escape(text) if s == TEXT else escape(role) if s == ROLE else s, loss) for s, loss in own.get(role, template.others)]
    return emit


def reader(template: Template):
    """A function (formatted text of whole turns) -> [(role, text), ...], from the text alone."""
    unescape = template.unescaper()

    def pattern(segments, name):
        named = {TEXT: f"(?P<t{name}>.*?)", ROLE: f"(?P<r{name}>.*?)"}
        return "".join(named.get(s) or re.escape(s) for s, _ in segments)
    names = [*template.roles, None]
    turns = re.compile("|".join(pattern(template.roles.get(n, template.others), i) for i, n in enumerate(names)), re.S)

    def read(text: str) -> list[tuple[str, str]]:
        at, out = len(template.opening) if template.opening and text.startswith(template.opening) else 0, []
        while at < len(text):
            m = turns.match(text, at)
            if not m:
                raise ValueError(f"no turn at {at}: {text[at:at + 40]!r}")
            i = int(m.lastgroup[1:])
            out.append((names[i] if names[i] is not None else unescape(m.group(f"r{i}")), unescape(m.group(f"t{i}"))))
            at = m.end()
        return out
    return read


def ordered_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """``(_id, block, turn, role, text)``; the null turn is in the least block."""
    turn = F.col(turn_col).cast("long")
    return conversations.select(
        F.coalesce(F.col(conv_col).cast("long"), F.lit(C.NULL_ID)).alias("_id"),
        F.coalesce(F.floor(turn / BLOCK).cast("long"), F.lit(C.NULL_ID)).alias("block"), turn.alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def column_lists(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def entries(rows: DataFrame, template: Template) -> DataFrame:
    """``(_id, block, entry, first)`` for the blocks of conversations of more than one block: the state before the block.

    Maps of ``FOLD`` neighbouring block numbers are composed in one row; only those rows, one in ``BLOCK * FOLD`` turn
    numbers, are walked in order."""
    states, number = template.states, {s: i for i, s in enumerate(template.states)}
    many = rows.groupBy("_id").agg(F.min("block").alias("least"), F.max("block").alias("most")).where("least < most").select("_id")

    def maps(batches):
        key, state = None, []
        for batch in batches:
            done = []
            for i, b, role in zip(*column_lists(batch, "_id", "block", "role")):
                if (i, b) != key:
                    if key:
                        done.append((*key, state))
                    key, state = (i, b), list(range(len(states)))
                state = [number[template.step(states[s], role)] for s in state]
            yield from as_batch(done, pa.list_(pa.int32()), "map")
        if key:
            yield from as_batch([(*key, state)], pa.list_(pa.int32()), "map")

    def walk(batches):
        at, state = None, 0
        for batch in batches:
            done = []
            for i, fold, whole in zip(*column_lists(batch, "_id", "fold", "whole")):
                state = 0 if i != at else state
                done.append((i, fold, state))
                at, state = i, whole[state]
            yield from as_batch(done, pa.int32(), "entry", "fold")

    def as_batch(done, kind, name, middle="block"):
        if done:
            cols = [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), kind))]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", middle, name])

    names = rows.join(many, "_id", "left_semi").select("_id", "block", "turn", "role")
    per_block = names.repartition("_id", "block").sortWithinPartitions("_id", "block", F.asc_nulls_first("turn"), "role") \
        .mapInArrow(maps, "_id long, block long, map array<int>")
    fold = F.floor(F.col("block") / FOLD).cast("long")
    folds = per_block.withColumn("fold", fold).groupBy("_id", "fold").agg(F.array_sort(F.collect_list(F.struct("block", "map"))).alias("own"))
    same = F.expr(f"transform(sequence(0, {len(states) - 1}), s -> int(s))")
    folds = folds.withColumn("whole", F.aggregate("own", same, lambda acc, x: F.transform(acc, lambda s: F.get(x["map"], s))))
    folds = C.stored(folds, "chat-folds")
    started = folds.select("_id", "fold", "whole").repartition("_id").sortWithinPartitions("_id", "fold") \
        .mapInArrow(walk, "_id long, fold long, entry int")
    least = Window.partitionBy("_id")
    # states before each block of a fold: the entry state led through the maps before it
    walked = F.aggregate("own", F.array("entry"), lambda acc, x: F.array_append(acc, F.get(x["map"], F.element_at(acc, -1))))
    out = folds.join(started, ["_id", "fold"]).select("_id", F.posexplode("own").alias("k", "x"), walked.alias("walked"))
    return out.select("_id", F.col("x.block").alias("block"), F.get("walked", F.col("k")).alias("entry")) \
        .withColumn("first", F.col("block") == F.min("block").over(least))


FOLD = 512
TURNS = ("_id long, block long, seq long, many boolean, turn long, role string, state string, valid boolean, "
         "segments array<struct<text:string,loss:boolean>>")


def format_conversations(conversations: DataFrame, template: Template = INSTRUCT, **columns) -> DataFrame:
    """One row per turn, ``(_id, block, seq, many, turn, role, state, valid, segments)``: its segments with their loss flags, the
    machine's state after it, and whether the order was right up to it.  Rows of one (_id, block) lie together in
    one partition, in order of ``seq``; ``many`` says that the conversation has more blocks."""
    rows = ordered_rows(conversations, **columns)
    led = entries(rows, template).select("_id", "block", F.lit(0).alias("kind"), "entry", "first")
    both = rows.withColumn("kind", F.lit(1)).unionByName(led, allowMissingColumns=True)
    names = [f.split()[0] for f in TURNS.split(", ")]
    kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches):
        emit, key, many, first, state, seq = turn_segments(template), None, False, True, template.states[0], 0
        for batch in batches:
            done = []
            for i, b, k, entry, head, turn, role, text in zip(*column_lists(batch, "_id", "block", "kind", "entry", "first", "turn", "role", "text")):
                if (i, b) != key:
                    key, many, first, state, seq = (i, b), False, True, template.states[0], 0
                if k == 0:
                    many, first, state = True, head, template.states[entry]
                    continue
                state = template.step(state, role)
                segments = ([(template.opening, False)] if first and template.opening else []) + emit(role, text)
                done.append((i, b, seq, many, turn, role, state, state != BROKEN, segments))
                first, seq = False, seq + 1
            if done:
                cols = list(zip(*done))
                texts = [[{"text": t, "loss": loss} for t, loss in segments] for segments in cols[-1]]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)] + [pa.array(texts, kind)], names=names)

    return both.repartition("_id", "block") \
        .sortWithinPartitions("_id", "block", "kind", F.asc_nulls_first("turn"), "role", "text").mapInArrow(run, TURNS)


class Digest:
    """What is read back from the formatted turns of one conversation, in order."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.valid = True

    def add(self, turns: bytes, loss: bytes, n_turns: int, loss_chars: int, formatted_chars: int, valid: bool) -> None:
        self.turns.update(turns)
        self.loss.update(loss)
        self.n_turns += n_turns
        self.loss_chars += loss_chars
        self.formatted_chars += formatted_chars
        self.valid &= valid

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.valid


PIECES = ("_id long, block long, seq long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "valid boolean, turns binary, loss binary")
PIECE_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """``(_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid)`` from the segments alone: turns are parsed
    from their joined texts, the loss text is what the flags mark.

    A conversation of one block is digested where it was formatted.  A digest takes its bytes one after the other, so the
    blocks of a longer one come together once more, as bytes already read back, and stream through one task in order."""
    names = [f.split()[0] for f in PIECES.split(", ")]

    def as_batch(done):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), PIECE_TYPES)], names=names)

    def parse(batches):
        read, unescape = reader(template), template.unescaper()
        at, digest = None, Digest()
        for batch in batches:
            done = []
            for i, b, seq, many, valid, segments in zip(*column_lists(batch, "_id", "block", "seq", "many", "valid", "segments")):
                if at is not None and at != i:
                    done.append((at, 0, 0, *digest.row(), None, None))
                    at, digest = None, Digest()
                whole = "".join([s["text"] for s in segments])
                turns = read(whole)
                said = "".join([f"{role}\n{text}\n" for role, text in turns]).encode()
                loss = unescape("".join([s["text"] for s in segments if s["loss"]]))
                part = said, loss.encode(), len(turns), len(loss), len(whole), valid
                if many:
                    done.append((i, b, seq, part[2], None, part[3], None, *part[4:], *part[:2]))
                else:
                    at = i
                    digest.add(*part)
            if done:
                yield as_batch(done)
        if at is not None:
            yield as_batch([(at, 0, 0, *digest.row(), None, None)])

    def unite(batches):
        at, digest = None, Digest()
        for batch in batches:
            done = []
            for row in zip(*column_lists(batch, *names)):
                if at is not None and at != row[0]:
                    done.append((at, 0, 0, *digest.row(), None, None))
                    at, digest = None, Digest()
                if row[-1] is None:
                    done.append(row)
                else:
                    at = row[0]
                    digest.add(row[9], row[10], row[3], row[5], row[7], row[8])
            if done:
                yield as_batch(done)
        if at is not None:
            yield as_batch([(at, 0, 0, *digest.row(), None, None)])

    out = formatted.mapInArrow(parse, PIECES).repartition("_id").sortWithinPartitions("_id", "block", "seq").mapInArrow(unite, PIECES)
    return out.drop("block", "seq", "turns", "loss")


SPECIAL = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def _oracle(t: Template) -> str:
    """The contract in SQL.  An escaped text is longer by its escape marks and by the control strings in it."""
    fixed = lambda segments: sum(len(s) for s, _ in segments if s not in (TEXT, ROLE))      # noqa: E731
    marks = " + ".join([f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in (*t.controls, t.escape)])
    width = "CASE role " + " ".join(f"WHEN '{r}' THEN {fixed(s)}" for r, s in t.roles.items()) + \
        f" ELSE {fixed(t.others)} + length(role) + {marks.format('role')} END + length(text) + {marks.format('text')}"
    special = ", ".join(f"({i}, {n}, '{r}', '{x}')" for i, n, r, x in SPECIAL)
    said = "CASE WHEN role = 'assistant' THEN text ELSE '' END"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
    WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                  UNION ALL SELECT * FROM (VALUES {special}) AS v(conv_id, turn, role, text)),
    said AS (SELECT conv_id, turn, role, text, {width} AS width,
             lag(role) OVER (PARTITION BY conv_id {order}) AS before FROM rows)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
           CAST(sum(length({said})) AS BIGINT) AS loss_chars, sha256(string_agg({said}, '' {order})) AS loss_sha256,
           CAST({len(t.opening)} + sum(width) AS BIGINT) AS formatted_chars,
           bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'user' THEN role = 'assistant'
                         ELSE before IN ('system', 'assistant') AND role = 'user' END) AS valid
    FROM said GROUP BY conv_id"""


@query("op13_chat_formatting", oracle=_oracle(INSTRUCT))
def op13_chat_formatting(spark, sf_dir):
    given = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    given = given.unionByName(spark.createDataFrame(SPECIAL, "conv_id long, turn long, role string, text string"))
    return read_back(format_conversations(given)).select(C.public_id("conv_id"), "n_turns", "turns_sha256", "loss_chars",
                                                         "loss_sha256", "formatted_chars", "valid")
