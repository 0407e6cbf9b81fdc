"""Faults of conversations and their cheapest repair, for whole tables (the search: `repair`).

Rows are dealt by ranges of conversation and turn and read in order. A conversation that lies
whole in a task and isn't long is settled there. Of all others (those at the ends of a task's
range, and long ones) the rows are stored; their duplicates are found by an aggregate, stretches
of them are searched in parallel, and the results per stretch are put together per conversation.
The last step reads the rows of such a conversation once more, in order, as one hash over all of
its text asks for that; it keeps one row at a time.
"""

import hashlib
from dataclasses import dataclass
from itertools import chain, groupby, pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import repair
from marketlens.llm.runtime import ship, stored

WHITE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
#: A conversation with more rows or characters isn't settled where its rows are read.
LONG_ROWS, LONG_CHARS = 1024, 4_000_000
#: Rows of a stretch, and rows per batch of results.
STRETCH, BATCH = 1024, 2048
#: Characters of a text by which rows of one turn and role are ordered before their hash is.
PREFIX = 64

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_AUDIT = ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"
_STRETCH = (
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role string, "
    "last_role string, first_turn bigint, last_turn bigint, turns bigint, "
    "costs array<bigint>, edits array<string>"
)


@dataclass(frozen=True)
class Repaired:
    """`audits` has a row per conversation, `turns` a row (conv_id, place, role, text) per turn left."""

    audits: DataFrame
    turns: DataFrame


def fault(text):
    """What a text shows by itself: blank, truncated, or nothing."""
    end = text.rstrip(WHITE)[-1:]
    return "blank" if not end else "" if end in ".!?" else "truncated"


def letter(role, found):
    """The letter of `repair` for a role and a fault."""
    if found in ("blank", "duplicate"):
        return "x"
    own = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return own.upper() if found == "truncated" else own


def _illegal(initials):
    return sum(a + b not in LEGAL for a, b in pairwise(initials))


def _gaps(turns):
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _hashed(rows):
    digest, between = hashlib.sha256(), b""
    for role, text in rows:
        digest.update(between + f"{role}:{text}".encode())
        between = b"\n"
    return digest.hexdigest()


def _settled(rows):
    """The audit of a conversation given by its rows (turn, role, text), and the repaired rows."""
    seen, faults = set(), []
    for _, role, text in rows:
        found = fault(text)
        if found != "blank" and (role, text) in seen:
            found = "duplicate"
        seen.add((role, text))
        faults.append(found)
    cost, edits = repair.repair("".join(letter(row[1], f) for row, f in zip(rows, faults)))
    left = list(repair.applied(edits, iter([row[1:] for row in rows]), repair.EMPTY))
    audit = dict(
        gaps=_gaps([row[0] for row in rows]),
        **{name: faults.count(name) for name in ("blank", "duplicate", "truncated")},
        illegal=_illegal([row[1][:1] for row in rows]),
        cost=cost,
        audit=edits,
        repaired_sha256=_hashed(left),
    )
    return audit, left


def _rows(batches, names):
    for batch in batches:
        yield from zip(*[batch.column(name).to_pylist() for name in names])


def _batches(dicts, schema):
    """Record batches of rows given as dicts; columns that a row doesn't name are null."""
    held, size = [], 0
    for row in dicts:
        held.append(row)
        size += len(row.get("text") or "")
        if len(held) == BATCH or size > LONG_CHARS:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows, schema):
    arrays = [pa.array([row.get(f.name) for row in rows], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def _read_in_order(schema):
    """Settle the conversations of a task's range; the rows of the others go on as `open`."""

    def settle(batches):
        part = TaskContext.get().partitionId()

        def opened(conv, rows, at):
            for i, (turn, role, text, gone) in enumerate(rows, at):
                yield dict(kind="open", conv_id=conv, part=part, pos=i, turn=turn, role=role, text=text,
                           own=fault(text), same=_key(role, text), gone=gone)

        def results():
            rows = _rows(batches, ("conv_id", "turn", "role", "text", "gone"))
            last = None
            for n, (conv, run) in enumerate(groupby(rows, key=lambda row: row[0])):
                if last:
                    yield from whole(*last)
                    last = None
                held, size = [], 0
                for row in run:
                    held.append(row[1:])
                    size += len(row[3])
                    if len(held) > LONG_ROWS or size > LONG_CHARS:
                        break
                else:
                    # The first of the range may have begun before, the last one may go on.
                    if n:
                        last = conv, held
                    else:
                        yield from opened(conv, held, 0)
                    continue
                yield from opened(conv, chain(held, (row[1:] for row in run)), 0)
            if last:
                yield from opened(*last, 0)

        def whole(conv, rows):
            audit, left = _settled([row[:3] for row in rows if not row[3]])
            yield dict(kind="audit", conv_id=conv, **audit)
            for place, (role, text) in enumerate(left):
                yield dict(kind="turn", conv_id=conv, place=place, role=role, text=text)

        yield from _batches(results(), schema)

    return settle


def _search_stretches(schema):
    """A row per stretch of the open rows, which come by conversation, part and position."""

    def search(batches):
        def results():
            names = ("conv_id", "part", "pos", "turn", "role", "fault")
            for (conv, part), run in groupby(_rows(batches, names), key=lambda row: row[:2]):
                held = []
                for row in run:
                    held.append(row[2:])
                    if len(held) == STRETCH:
                        yield stretch(conv, part, held)
                        held = []
                if held:
                    yield stretch(conv, part, held)

        def stretch(conv, part, rows):
            first = rows[0][0]
            rows = [row for row in rows if row[3] is not None]
            faults = [row[3] for row in rows]
            initials = [row[2][:1] for row in rows]
            turns = [row[1] for row in rows if row[1] is not None]
            found = repair.ways("".join(letter(row[2], f) for row, f in zip(rows, faults)))
            flat = [way for starts in found for way in starts]
            return dict(
                conv_id=conv, part=part, pos=first,
                **{name: faults.count(name) for name in ("blank", "duplicate", "truncated")},
                illegal=_illegal(initials),
                first_role=initials[0] if rows else None,
                last_role=initials[-1] if rows else None,
                first_turn=turns[0] if turns else None,
                last_turn=turns[-1] if turns else None,
                turns=len(set(turns)),
                costs=[way[0] if way else -1 for way in flat],
                edits=[way[1] if way else "" for way in flat],
            )

        yield from _batches(results(), schema)

    return search


def _join_stretches(schema):
    """Per conversation its audit, as the row before all others, and the edits of each stretch."""

    def join(batches):
        names = [f.split()[0] for f in ("conv_id", "part", "pos", *_STRETCH.split(", "))]

        def results():
            for conv, run in groupby(_rows(batches, names), key=lambda row: row[0]):
                yield from conversation(conv, [dict(zip(names, row)) for row in run])

        def conversation(conv, stretches):
            sums = {c: sum(s[c] for s in stretches) for c in ("blank", "duplicate", "truncated", "illegal")}
            filled = [s for s in stretches if s["first_role"] is not None]
            sums["illegal"] += sum(
                a["last_role"] + b["first_role"] not in LEGAL for a, b in pairwise(filled)
            )
            timed = [s for s in stretches if s["turns"]]
            shared = sum(a["last_turn"] == b["first_turn"] for a, b in pairwise(timed))
            if timed:
                distinct = sum(s["turns"] for s in timed) - shared
                sums["gaps"] = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - distinct
            ways = (
                [[(c, e) if c >= 0 else None for c, e in list(zip(s["costs"], s["edits"]))[i : i + 4]]
                 for i in range(0, 16, 4)]
                for s in stretches
            )
            cost, pieces = repair.joined(ways)
            audit = "".join(edits for _, edits in pieces)
            yield dict(conv_id=conv, part=-1, pos=-1, **{"gaps": 0, **sums}, cost=cost, audit=audit)
            for s, (state, edits) in zip(stretches, pieces):
                yield dict(conv_id=conv, part=s["part"], pos=s["pos"], state=state, edits=edits)

        yield from _batches(results(), schema)

    return join


def _apply_edits(schema):
    """Audit, stretches and rows of each open conversation come in order; edit and hash the rows."""
    names = ("conv_id", "state", "edits", "role", "text", *COUNTS, "audit")

    def apply(batches):
        def results():
            for conv, run in groupby(_rows(batches, names), key=lambda row: row[0]):
                audit = dict(zip(names[5:], next(run)[5:]))
                digest, place = hashlib.sha256(), 0
                edits, state = "", repair.EMPTY
                for role, text in edited(run):
                    digest.update((b"\n" if place else b"") + f"{role}:{text}".encode())
                    yield dict(kind="turn", conv_id=conv, place=place, role=role, text=text)
                    place += 1
                yield dict(kind="audit", conv_id=conv, **audit, repaired_sha256=digest.hexdigest())

        def edited(run):
            for _, state, edits, *_ in run:
                # A stretch is followed by its rows; the edits say how many there are.
                yield from repair.applied(edits, ((row[3], row[4]) for row in run), state)

        yield from _batches(results(), schema)

    return apply


def _arrow(spark, ddl):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _mapped(df, function, ddl):
    return df.mapInArrow(function(_arrow(df.sparkSession, ddl)), ddl)


def repaired(rows):
    """Audit and repair of conversations given as rows (conv_id, turn, role, text, gone).

    No value but turn and conv_id is null. Rows that are `gone` only say that there is such a
    conversation. Rows of a turn are ordered by role and text (beyond PREFIX characters of it, by
    its hash), null turns come first; rows without conv_id are one conversation. A conversation
    without rows has counts of zero, no edits and the hash of the empty text. Equal rows are
    duplicates of the first of them.
    """
    ship(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.select(
        "conv_id", "turn", "role", "text", "gone",
        F.left("text", F.lit(PREFIX)).alias("begins"),
        F.xxhash64("text").alias("hash"),
        F.monotonically_increasing_id().alias("number"),
    )
    order = ["conv_id", "turn", "role", "begins", "hash", "number"]
    turn = f"kind string, conv_id {kind}, place bigint, role string, text string"
    final = f"{turn}, {_AUDIT}"
    opened = ", part int, pos bigint, turn bigint, own string, same string, gone boolean"
    read = stored(
        _mapped(
            rows.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order[3:]),
            _read_in_order,
            final + opened,
        ),
        "conversations-read",
    )
    final_columns = ["kind", "conv_id", "place", "role", "text", *COUNTS, "audit", "repaired_sha256"]
    settled = read.filter("kind <> 'open'").select(final_columns)
    places = read.filter("kind = 'open'").select("conv_id", "part", "pos", "turn", "role", "own", "same", "gone")
    edits = stored(_edits_of_open(places, kind), "conversations-edits")
    texts = read.filter("kind = 'open' AND NOT gone").select("conv_id", "part", "pos", "role", "text")
    steps = edits.withColumn("is_row", F.lit(0)).unionByName(
        texts.withColumn("is_row", F.lit(1)), allowMissingColumns=True
    )
    steps = steps.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos", "is_row")
    rest = stored(_mapped(steps, _apply_edits, final), "conversations-rest").select(final_columns)
    both = settled.unionByName(rest)
    return Repaired(
        both.filter("kind = 'audit'").select("conv_id", *COUNTS, "audit", "repaired_sha256"),
        both.filter("kind = 'turn'").select("conv_id", "place", "role", "text"),
    )


def _edits_of_open(places, kind):
    """Edits per stretch of the open conversations, and their audits, from rows without texts."""
    first = (
        places.filter("NOT gone")
        .groupBy(F.col("conv_id").alias("_conv"), F.col("same").alias("_same"))
        .agg(F.min(F.struct("part", "pos")).alias("_first"))
    )
    marked = places.join(
        first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("same") == F.col("_same")), "left"
    )
    repeats = F.struct("part", "pos") > F.col("_first")
    marked = marked.select(
        "conv_id", "part", "pos", "turn", "role",
        F.when(F.col("gone"), None)
        .when(F.col("own") == "blank", "blank")
        .when(repeats, "duplicate")
        .otherwise(F.col("own"))
        .alias("fault"),
    )
    place = f"conv_id {kind}, part int, pos bigint"
    order = ["conv_id", "part", "pos"]
    searched = _mapped(
        marked.repartition("conv_id", "part").sortWithinPartitions(*order),
        _search_stretches,
        f"{place}, {_STRETCH}",
    )
    joined = searched.repartition("conv_id").sortWithinPartitions(*order)
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return _mapped(joined, _join_stretches, f"{place}, state int, edits string, {counts}, audit string")


def given(conversations, names=("conv_id", "turn", "role", "text")):
    """Rows for `repaired` from a table as it is; a null role or text is one space."""
    conv, turn, role, text = [F.col(f"`{name}`") for name in names]
    return conversations.select(
        conv.alias("conv_id"),
        turn.cast("long").alias("turn"),
        F.coalesce(role.cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(text.cast("string"), F.lit(" ")).alias("text"),
        F.lit(False).alias("gone"),
    )


def damaged(conversations, names=("conv_id", "turn", "role", "text")):
    """Rows for `repaired` with planted faults, by crc32(conv_id:turn) mod 20, nulls as one space.

    0 drops the row, 1 empties its text, 2 removes its `.!?`, 3 repeats it, 4 makes its role user.
    """
    rows = given(conversations, names)
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    chance = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    text = F.col("text")
    return rows.withColumn("chance", chance).select(
        "conv_id",
        "turn",
        F.when(F.col("chance") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("chance") == 1, "")
        .when(F.col("chance") == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        (F.col("chance") == 0).alias("gone"),
        F.explode(F.when(F.col("chance") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")
