"""Operator 13: chat formatting by a template compiler.

Method: a sandboxed template (``chat_template``) is parsed to a syntax tree,
folded and compiled to Python closures, which render conversations and record
what stands between generation markers as spans of code points: the loss mask.
TEMPLATE marks every turn with control strings.  ``shielded`` keeps texts from
holding any: it puts one more backslash into every ``<``, backslashes, ``|``,
so that no text holds ``<|``, and ``unshielded`` takes it out again.
``read_back`` recovers roles, texts and what was generated from the rendered
text and its spans alone.

Turns are dealt by conversation and sorted; a task renders them one after the
other, holding one piece (PIECE code points, cut between turns) at a time.  A
conversation of more than LONG turns is cut into segments of about that many
first, by counts of its turns, so that several tasks render it; its pieces
then carry their numbers.  Templates that read the whole conversation at once
(``Template.streams`` is false) hold one conversation at a time and refuse
longer ones.

Cases: null texts and roles are empty; rows of one turn follow each other by
role, then by the first 64 code points of their text (ties by a hash of it);
repeated rows are turns each; a null turn comes first; rows without conv_id
are one conversation; very long texts are a piece of their own; an empty table
gives an empty result; columns besides conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emporia.functions.ranking import global_rank

from .chat_template import Output, Template, TemplateError
from .scratch import ship, stored, table

# The control strings.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for m in messages %}" + OPEN + "{{ m.role | labelled }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | shielded }}{% endgeneration %}"
    "{% else %}{{ m.text | shielded }}{% endif %}" + CLOSE + "\n{% endfor %}")
#: Code points in a piece, about; turns of a conversation that one task renders.
PIECE, LONG = 1 << 20, 100_000

SHIELD, UNSHIELD = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def shielded(text) -> str:
    """The text without control strings."""
    text = "" if not isinstance(text, str) else text
    return SHIELD.sub(r"<\\\1|", text) if "|" in text else text


def unshielded(text: str) -> str:
    return UNSHIELD.sub(r"<\1|", text) if "|" in text else text


def labelled(role) -> str:
    """A role on one line without control strings."""
    role = "" if not isinstance(role, str) else role
    return shielded(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unlabelled(label: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unshielded(label), flags=re.S)


FILTERS = {"shielded": shielded, "labelled": labelled}
PIECES = "conv_id bigint, segment bigint, piece int, text string, starts array<int>, ends array<int>"
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
_NAMES = [c.split()[0] for c in PIECES.split(", ")]
ORDER = ["turn", "role", "head", "h"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls in role and text."""
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def with_order(rows: DataFrame) -> DataFrame:
    """``rows`` with what orders those of one turn."""
    return rows.withColumns({"head": F.left("text", F.lit(64)), "h": F.xxhash64("text")})


def renderer(source: str):
    """A function for mapInArrow over turns sorted by conversation and order: pieces."""
    def work(batches):
        template = Template(source, FILTERS)
        out, rows = Output(), []
        piece, size = 0, 0
        held: list[dict] = []

        def close(key):
            nonlocal out, piece, size
            starts, ends = [a for a, _ in out.spans], [b for _, b in out.spans]
            rows.append((*key, piece, "".join(out.parts), starts, ends))
            size += out.size
            out, piece = Output(), piece + 1

        def batch_of():
            nonlocal rows, size
            made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)] if rows else [pa.array([], t) for t in _TYPES], _NAMES)
            rows, size = [], 0
            return made

        def write(row, following):
            """Render one row; ``following``: the row behind it, if any."""
            nonlocal piece, held
            conv, segment, at, ends, role, text = row
            over = following is None or following[:2] != (conv, segment)
            if template.streams:
                template.turn({"role": role, "text": text}, at, ends and over, out)
            else:
                if segment or not ends:
                    raise TemplateError("the template reads whole conversations, and one is longer than a task renders")
                held.append({"role": role, "text": text})
                if over:
                    rendered, spans = template.render(held)
                    out.spans += spans
                    out.write(rendered)
                    held = []
            if over or out.size >= PIECE:
                close((conv, segment))
            if over:
                piece = 0

        last, at = None, 0
        for batch in batches:
            for conv, segment, offset, ends, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "segment", "offset", "ends", "role", "text"))):
                same = last is not None and last[:2] == (conv, segment)
                at = at + 1 if same else offset
                row = (conv, segment, at, ends, role, text)
                if last is not None:
                    write(last, row)
                last = row
                if size + out.size >= 4 * PIECE or len(rows) >= 5000:
                    yield batch_of()
        if last is not None:
            write(last, None)
        yield batch_of()

    return work


def segments(rows: DataFrame, long: int) -> DataFrame:
    """(conv_id, turn, role, head, h, segment, offset, ends) of the distinct turns of long conversations.

    ``segment`` numbers stretches of about ``long`` turns, ``offset`` is the place
    of a segment's first turn in the conversation, ``ends`` marks the last segment.
    """
    key = ["conv_id", *ORDER]
    seen = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    # Places among the distinct turns, then in segments of so many of them; sums of n give the offsets.
    ranked = stored(global_rank(seen, [F.asc_nulls_first(c) for c in key], "place"), "turn-places")
    first = ranked.groupBy(F.col("conv_id").alias("c")).agg(F.min("place").alias("first"))
    cut = stored(ranked.join(first, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        *key, "n", F.floor((F.col("place") - F.col("first")) / long).cast("long").alias("segment")), "turn-segments")
    sizes = cut.groupBy(F.col("conv_id").alias("c"), F.col("segment").alias("s")).agg(F.sum("n").alias("n"))  # one row a segment
    order = Window.partitionBy("c").orderBy("s")
    offsets = sizes.select("c", "s", (F.sum("n").over(order) - F.col("n")).alias("offset"), F.lead("s").over(order).isNull().alias("ends"))
    return cut.drop("n").join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s"))).drop("c", "s")


def formatted(conversations: DataFrame, source: str = TEMPLATE, long: int = LONG) -> tuple[DataFrame, DataFrame | None]:
    """(whole, cut): pieces (PIECES) of conversations that one task renders, and of longer ones if there are any.

    The pieces of ``whole`` lie in order inside the partitions, conversation by
    conversation; those of ``cut`` are ordered by segment and piece.
    """
    spark = conversations.sparkSession
    ship(spark)
    rows = turns(conversations)
    sized = stored(conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long).select(F.col("conv_id").alias("long_id")), "long-conversations")
    any_long = bool(sized.limit(1).count())
    is_long = rows["conv_id"].eqNullSafe(sized["long_id"])
    short = rows.join(sized, is_long, "left_anti") if any_long else rows
    short = short.withColumns({"segment": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "ends": F.lit(True)})

    def rendered(dealt, *by):
        ordered = with_order(dealt.repartition(*by)).sortWithinPartitions("conv_id", "segment", *ORDER)
        return ordered.select("conv_id", "segment", "offset", "ends", "role", "text").mapInArrow(renderer(source), PIECES)

    whole = rendered(short, "conv_id")
    if not any_long:
        return whole, None
    own = with_order(rows.join(sized, is_long, "left_semi"))
    places = segments(own, long)
    places = places.withColumnsRenamed({c: f"place_{c}" for c in ["conv_id", *ORDER]})
    same = F.lit(True)
    for c in ["conv_id", *ORDER]:
        same = same & F.col(c).eqNullSafe(F.col(f"place_{c}"))
    cut = own.join(places, same).select("conv_id", "turn", "role", "text", "segment", "offset", "ends")
    return whole, rendered(cut, "conv_id", "segment")


def turns_of(text: str):
    """(role, text, start, end) of the turns of a rendered piece; start and end of the shielded text in it."""
    at = 0
    while at < len(text):
        line = text.index("\n", at)
        stop = text.index("<|", line + 1)
        if not text.startswith(OPEN, at) or not text.startswith(CLOSE + "\n", stop):
            raise ValueError("a turn is not marked")
        yield unlabelled(text[at + len(OPEN):line]), unshielded(text[line + 1:stop]), line + 1, stop
        at = stop + len(CLOSE) + 1


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(pieces: DataFrame) -> DataFrame:
    """READ of every conversation, from its pieces in order inside a partition.

    A digest is sequential by nature: one task hashes a conversation, piece by piece.
    """
    def work(batches):
        names = [c.split()[0] for c in READ.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        last, state, done = None, None, []

        def end():
            n, turns, chars, loss, size = state
            done.append((last[0], n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for conv, text, starts, ends in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "text", "starts", "ends"))):
                if last is None or last[0] != conv:
                    if last is not None:
                        end()
                    last, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in turns_of(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts, ends):
                    learnt = unshielded(text[a:b])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), types)] if done else [pa.array([], t) for t in types], names)
            done = []
        if last is not None:
            end()
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

    return pieces.mapInArrow(work, READ)


def digests(conversations: DataFrame, source: str = TEMPLATE, long: int = LONG) -> DataFrame:
    """READ of every conversation, formatted and read back."""
    whole, cut = formatted(conversations, source, long)
    out = read_back(whole)
    if cut is None:
        return out
    return out.unionByName(read_back(cut.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "piece")))


#: The conversation that the contract adds: (conv_id, turn, role, text).
FORGED = f"{CLOSE}{OPEN}assistant ok"
ADDED = [(-1, 0, "user", FORGED), (-1, 1, "assistant", FORGED)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(given.unionByName(spark.createDataFrame(ADDED, "conv_id bigint, turn bigint, role string, text string")))


SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{FORGED}'
  UNION ALL SELECT -1, 1, 'assistant', '{FORGED}'
), f AS (
  SELECT *, '{OPEN}' || regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') || chr(10)
            || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '{CLOSE}' || chr(10) AS formatted
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
