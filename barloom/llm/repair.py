"""Repair of a conversation's structure at least cost, by a scan of matrices over (min, +).

A repaired conversation has roles s?(ua)+ by their initials, or no turns. An automaton with the states nothing, after s,
after u, after a reads it, and each turn becomes a 4 x 4 matrix: what it costs, and the edits (the audit), to go from one
state to another by keeping, rerolling or deleting it and then inserting turns. Elements (cost, audit) are added by taking
the lesser and multiplied by adding costs and joining audits; of equal cost none is the beginning of another, so the order
of audits outlasts both and the product is associative. Turns are dealt by ranges of (conversation, turn). A conversation
that lies within one task is reduced there as a tree; of others tasks reduce segments, whose matrices meet in rounds of a
tree over partitions. What a segment's turns become then follows from its part of the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructType

from barloom.llm.common import cut, lookup, map_in_arrow
from barloom.llm.sequences import as_batch, in_turn_order, sha256_of_chunks

#: Turns and characters of text in a segment at most (a longer text is one of its own), and matrices that meet in a round.
SEGMENT_TURNS, SEGMENT_CHARS, FAN = 1024, 1 << 20, 16
WHITE = " \t\n\v\f\r"

#: Costs of edits: reroling, deleting, inserting a turn, and what a truncated turn that stays costs more.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn with an initial, where that is legal; the state after a turn that may be chosen.
STEP = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}

Element = tuple[int, str] | None
Matrix = tuple[Element, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    out: list[Element] = []
    for i in (0, 4, 8, 12):
        row = a[i : i + 4]
        for j in range(4):
            best = None
            for k in range(4):
                x, y = row[k], b[4 * k + j]
                if x is not None and y is not None:
                    z = (x[0] + y[0], x[1] + y[1])
                    if best is None or z < best:
                        best = z
            out.append(best)
    return tuple(out)


def _matrix(entries: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(entries.get((i, j)) for i in range(4) for j in range(4))


def _closure() -> Matrix:
    """Any number of inserted turns, none included."""
    out = {(i, i): (0, "") for i in range(4)}
    for i in range(4):
        state, n = i, 0
        while (state := NEXT[state]) not in {j for k, j in out if k == i}:
            n += 1
            out[i, state] = (n * INSERT, "I" * n)
    return _matrix(out)


INSERTS = _closure()


@lru_cache(maxsize=64)
def turn(kind: str) -> Matrix:
    """The matrix of a turn, inserts after it included. kind: s, u, a or o, the initial of its role, upper case if it is truncated; x if it must go."""
    out = {(i, i): (DELETE, "D") for i in range(4)}
    if kind != "x":
        more = CUT_OFF if kind.isupper() else 0
        for i in range(4):
            out[i, NEXT[i]] = min((REROLE + more, "R"), out.get((i, NEXT[i]), (1 << 30, "")))
            if (j := STEP.get((i, kind.lower()))) is not None:
                out[i, j] = min((more, "K"), out.get((i, j), (1 << 30, "")))
    return times(_matrix(out), INSERTS)


def reduced(kinds: str) -> Matrix:
    """The product of turns, as a balanced tree; products of up to 8 turns are remembered."""
    if len(kinds) <= 8:
        return _short(kinds)
    half = 8
    while 2 * half < len(kinds):
        half *= 2
    return times(reduced(kinds[:half]), reduced(kinds[half:]))


@lru_cache(maxsize=1 << 16)
def _short(kinds: str) -> Matrix:
    if not kinds:
        return _matrix({(i, i): (0, "") for i in range(4)})
    if len(kinds) == 1:
        return turn(kinds)
    half = len(kinds) // 2
    return times(_short(kinds[:half]), _short(kinds[half:]))


def cheapest(product: Matrix) -> tuple[int, str]:
    """Cost and audit of a conversation whose turns have this product."""
    whole = times(INSERTS, product)
    return min(e for e in (whole[NONE], whole[ASSISTANT]) if e is not None)


def kinds_of(initials: str, faults: str) -> str:
    """faults: b blank, d duplicate, t truncated, or a dash for each turn."""
    return "".join("x" if f in "bd" else i.upper() if f == "t" else i for i, f in zip(initials, faults))


def applied(audit: str, state: int, initials: str, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """The lines role:text that edits leave of turns, from a state on; the state after them."""
    out, k = [], 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out.append(f"{ROLE[state]}:")
            continue
        if edit == "K":
            state = STATE[initials[k]]
            out.append(f"{roles[k]}:{texts[k]}")
        elif edit == "R":
            state = NEXT[state]
            out.append(f"{ROLE[state]}:{texts[k]}")
        k += 1
    return out, state


def illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
KEY = StructType().add("none", BooleanType()).add("conv", LongType())
DONE = StructType([*KEY.fields])
for _c in COUNTS:
    DONE = DONE.add(_c, LongType())
DONE = DONE.add("audit", StringType()).add("repaired_sha256", StringType())
SPAN = StructType().add("initials", StringType()).add("faults", StringType()).add("least", LongType()).add("most", LongType()).add("turns", LongType())
#: A conversation that is done, or a segment of one that isn't (part and no tell where it lies).
MIXED = StructType([*DONE.fields, *SPAN.fields]).add("part", IntegerType()).add("no", LongType()).add("roles", ArrayType(StringType())).add("texts", ArrayType(StringType())).add("md5s", ArrayType(BinaryType()))
#: What is known of neighbouring turns: counts, first and last initial, least, most and number of turn numbers, their product.
PIECE = StructType([*KEY.fields]).add("at", LongType()).add("blank", LongType()).add("duplicate", LongType()).add("truncated", LongType()).add("illegal", LongType()).add("first", StringType()).add("last", StringType())
PIECE = PIECE.add("least", LongType()).add("most", LongType()).add("turns", LongType()).add("costs", ArrayType(LongType())).add("audits", ArrayType(StringType()))


class Piece:
    """Of one run of neighbouring turns; added to the next it is that of both."""

    def __init__(self, blank: int, duplicate: int, truncated: int, illegal: int, first: str, last: str, least: int | None, most: int | None, turns: int, product: Matrix):
        self.counts, self.first, self.last, self.least, self.most, self.turns, self.product = (blank, duplicate, truncated, illegal), first, last, least, most, turns, product

    @classmethod
    def of(cls, initials: str, faults: str, least: int | None, most: int | None, turns: int) -> Piece:
        return cls(faults.count("b"), faults.count("d"), faults.count("t"), illegal(initials), initials[:1], initials[-1:], least, most, turns, reduced(kinds_of(initials, faults)))

    @classmethod
    def read(cls, r: dict) -> Piece:
        product = tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"]))
        return cls(r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["first"], r["last"], r["least"], r["most"], r["turns"], product)

    def row(self) -> tuple:
        return *self.counts, self.first, self.last, self.least, self.most, self.turns, [e and e[0] for e in self.product], [e and e[1] for e in self.product]

    def __add__(self, other: Piece) -> Piece:
        counts = [a + b for a, b in zip(self.counts, other.counts)]
        if self.last and other.first:
            counts[3] += illegal(self.last + other.first)
        both = self.most is not None and self.most == other.least
        return Piece(
            *counts, self.first or other.first, other.last or self.last, other.least if self.least is None else self.least, self.most if other.most is None else other.most,
            self.turns + other.turns - both, times(self.product, other.product),
        )

    def done(self) -> tuple:
        """gaps, counts, cost, audit."""
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return gaps, *self.counts, *cheapest(self.product)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows by crc32(conv_id:turn) % 20: 0 goes (its text and role do, the row is marked), 1 loses its text, 2 its marks .!?, 3 comes twice, 4 has the role user.

    Nulls in role and text are one space, and so they are in conv_id:turn.
    """
    said = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    said = said.withColumn("_kind", (F.crc32(name.cast("binary")) % 20).cast("int"))
    kind, gone = F.col("_kind"), F.col("_kind") == 0
    said = said.withColumns({
        "text": F.when(kind.isin(0, 1), "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "role": F.when(gone, "").when(kind == 4, "user").otherwise(F.col("role")),
        "gone": gone, "_copies": F.when(kind == 3, 2).otherwise(1),
    })
    return said.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_kind", "_copies", "_copy")


def repair(said: DataFrame) -> DataFrame:
    """A row for each conv_id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    said: conv_id, turn, role, text (role and text without nulls), gone (true: the row only tells that there is such a
    conversation). Rows come by turn, nulls first, ties as in_turn_order() says. Rows with a null conv_id are a conversation.
    A role without a first letter is as illegal as one with another. Duplicates are told by MD5 of role and text.
    Conversations without rows have zeros, an empty audit and the hash of no text. Empty tables give empty ones.
    """
    text, letter = F.rtrim("text", F.lit(WHITE)), F.substring("role", 1, 1)
    fault = F.when(text == "", "b").when(~F.substring(text, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    seen = in_turn_order(said).withColumns({"initial": F.when(letter.isin("s", "u", "a"), letter).otherwise("o"), "fault": fault})
    mixed = cut(map_in_arrow(seen, _by_task, MIXED), "repair")
    done = mixed.where("part IS NULL").select(*DONE.names)
    return done.unionByName(_across(mixed.where("part IS NOT NULL"))).select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), *DONE.names[2:])


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations that begin and end in this task, within a segment, done; segments of those that may go beyond."""
    part, no = TaskContext.get().partitionId(), 0
    key, held, size, whole, first = None, [], 0, True, True
    ready: list[tuple] = []

    def segment() -> tuple:
        numbers = sorted({r[0] for r in held} - {None})
        initials, faults = "".join(r[4] for r in held), "".join(r[5] for r in held)
        return (*key, *[None] * (len(DONE) - 2), initials, faults, *((numbers[0], numbers[-1]) if numbers else (None, None)), len(numbers), part, no, [r[1] for r in held], [r[2] for r in held], [r[3] for r in held])

    def finished() -> tuple:
        numbers, met, faults = {r[0] for r in held} - {None}, set(), ""
        for r in held:
            faults += "d" if r[5] != "b" and r[3] in met else r[5]
            met.add(r[3])
        initials = "".join(r[4] for r in held)
        counts = Piece.of(initials, faults, min(numbers, default=None), max(numbers, default=None), len(numbers)).done()
        lines, _ = applied(counts[-1], NONE, initials, [r[1] for r in held], [r[2] for r in held])
        return (*key, *counts, hashlib.sha256("\n".join(lines).encode()).hexdigest(), *[None] * (len(MIXED) - len(DONE)))

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("conv_id", "gone", "turn", "role", "text", "turn_md5", "initial", "fault")]
        for conv, gone, *row in zip(*columns):
            own = (conv is None, conv or 0)
            if key != own:
                if key is not None:
                    # The first conversation of a task may have begun in another.
                    ready.append(finished() if whole and not first else segment())
                    no, first = no + 1, False
                key, held, size, whole = own, [], 0, True
            elif held and (len(held) >= SEGMENT_TURNS or size + len(row[2]) > SEGMENT_CHARS):
                ready.append(segment())
                held, size, no, whole = [], 0, no + 1, False
            if not gone:
                held.append(row)
                size += len(row[2])
            if len(ready) >= 256:
                yield from as_batch(ready, MIXED)
                ready = []
        yield from as_batch(ready, MIXED)
        ready = []
    if key is not None:
        yield from as_batch([segment()], MIXED)  # it may go on in the next task


def _across(segments: DataFrame) -> DataFrame:
    """Conversations by segments that lie in several tasks."""
    keys, place = KEY.names, F.struct("part", "no", "i")
    # Which turns another before them repeats.
    marks = segments.select(*keys, "part", "no", F.posexplode("md5s").alias("i", "md5"))
    firsts = marks.groupBy(*keys, "md5").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = lookup(marks, [*keys, "md5"], "i", firsts).where(place != F.col("first")).groupBy(*keys, "part", "no").agg(F.collect_list("i").alias("again"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("part", "no")).cast("long") - 1
    slim = segments.select(*keys, "part", "no", *SPAN.names).withColumn("at", order).join(again, [*keys, "part", "no"], "left")
    known = F.transform(F.split("faults", ""), lambda f, k: F.when((f != "b") & F.array_contains(F.coalesce("again", F.array().cast("array<int>")), k), "d").otherwise(f))
    slim = cut(slim.withColumn("faults", F.array_join(known, "")).drop("again"), "segments")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from as_batch([(r["none"], r["conv"], r["at"], *Piece.of(r["initials"], r["faults"], r["least"], r["most"], r["turns"]).row()) for r in batch.to_pylist()], PIECE)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, piece = None, None
        for batch in batches:
            ready = []
            for r in batch.to_pylist():
                own = (r["none"], r["conv"], r["at"] // FAN)
                if key == own:
                    piece += Piece.read(r)
                    continue
                if key is not None:
                    ready.append((*key, *piece.row()))
                key, piece = own, Piece.read(r)
            yield from as_batch(ready, PIECE)
        if key is not None:
            yield from as_batch([(*key, *piece.row())], PIECE)

    pieces = map_in_arrow(slim, begin, PIECE)
    most = slim.agg(F.max("at")).first()[0] or 0
    while most > 0:
        pieces = pieces.withColumn("_to", F.floor(F.col("at") / FAN)).repartition(*keys, "_to").sortWithinPartitions(*keys, "at").drop("_to")
        pieces, most = cut(map_in_arrow(pieces, meet, PIECE), "pieces"), most // FAN

    result = StructType(DONE.fields[:-1])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from as_batch([(r["none"], r["conv"], *Piece.read(r).done()) for r in batch.to_pylist()], result)

    results = cut(map_in_arrow(pieces, end, result), "audits")

    # Each segment's part of the audit, by a stream over its conversation's segments.
    share = StructType([*KEY.fields]).add("part", IntegerType()).add("no", LongType()).add("edits", StringType()).add("state", IntegerType())
    stream = slim.select(*keys, "at", "part", "no", F.lit(None).cast("string").alias("audit"), "initials").unionByName(results.select(*keys, F.lit(-1).cast("long").alias("at"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("no"), "audit", F.lit("").alias("initials")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, held = "", 0, NONE, None
        for batch in batches:
            ready = []
            for r in batch.to_pylist():
                if held is not None:
                    # Inserted turns go with the turn after them; the last segment takes all that is left.
                    last, to, n = r["audit"] is not None, at, 0
                    while n < len(held["initials"]):
                        n += audit[to] != "I"
                        to += 1
                    edits = audit[at:] if last else audit[at:to]
                    ready.append((held["none"], held["conv"], held["part"], held["no"], edits, state))
                    state, at = applied(edits, state, held["initials"], [""] * len(held["initials"]), [""] * len(held["initials"]))[1], to
                held = r
                if r["audit"] is not None:
                    audit, at, state, held = r["audit"], 0, NONE, None
            yield from as_batch(ready, share)
        if held is not None:
            yield from as_batch([(held["none"], held["conv"], held["part"], held["no"], audit[at:], state)], share)

    shares = map_in_arrow(stream.repartition(*keys).sortWithinPartitions(*keys, "at"), deal, share)
    lines = StructType([*KEY.fields]).add("part", IntegerType()).add("no", LongType()).add("lines", StringType())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ready = []
            for r in batch.to_pylist():
                own, _ = applied(r["edits"], r["state"], r["initials"], r["roles"], r["texts"])
                if own:
                    ready.append((r["none"], r["conv"], r["part"], r["no"], "\n".join(own)))
            yield from as_batch(ready, lines)

    texts = segments.select(*keys, "part", "no", "initials", "roles", "texts").join(shares, [*keys, "part", "no"])
    hashes = sha256_of_chunks(map_in_arrow(texts, write, lines), keys, ["part", "no"], "lines", "\n")
    return results.join(hashes, keys, "left").select(*result.names, F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
