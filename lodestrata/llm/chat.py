"""Chat formatting of typed content parts.

A turn's content is an array of parts (type, text, uri, units). A visitor, one expression for
each type, flattens them in order: a text becomes its escaped form, an image, audio or document
part a placeholder ``<|type:k|>`` with k its place among the conversation's attachments in turn. For each
attachment the reference and the number of tokens that its placeholder stands for are
recorded: units times the type's tokens a unit (image: patches, audio: seconds, document: pages).

The template is ``<|turn|>role``, a line feed, the content, ``<|end|>`` and a line feed. Inside texts and roles ``\\``,
``<`` and ``[`` are followed by a backslash, so neither the template's marks nor such as ``</s>`` or
``[INST]`` can occur in them, and the text is got back by dropping it; a line feed in a role is ``<n``. The output
has a row for each turn, with its place in the conversation's text and the spans, as code points, on which a loss
is taken: the texts of assistant turns. A conversation of any length is thus never one value.

Defined results: null texts and roles count as empty; turns are put in the order of turn, null first,
repeated ones by role, the first characters of their parts and a hash of all; rows of a null conv_id form a conversation; a turn without parts
is an empty one; parts of an unknown type are texts; an empty table gives an empty result; other columns of the input are not used.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import settle, table

TURN, END = "<|turn|>", "<|end|>\n"
TOKENS_A_UNIT = {"image": 1, "audio": 25, "document": 500}
PART = "struct<type: string, text: string, uri: string, units: int>"
_PIECE = re.compile(r"<\|turn\|>([^\n]*)\n(.*)<\|end\|>\n", re.S)
_ESCAPED = re.compile(r"([\\<\[])\\|<n")


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\<\[])", r"$1\\")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<n"))


def text_parts(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("units")))


def _visit(part: Column, ordinal: Column) -> Column:
    """The flat form of one part."""
    out = F.when(F.lit(False), F.lit(""))
    for kind in TOKENS_A_UNIT:
        out = out.when(part["type"] == kind, F.concat(F.lit(f"<|{kind}:"), ordinal.cast("string"), F.lit("|>")))
    return out.otherwise(escaped(part["text"]))


def _is_attached(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*TOKENS_A_UNIT), F.lit(False))


def _sums_before(rows: DataFrame, sizes: dict[str, Column]) -> DataFrame:
    """Adds, for each size, its sum over the rows of smaller _no of the same conversation.

    Rows stand in ranges of their order (_range, _no). Sums run inside ranges, a range starts with the sums of those before it, and a
    conversation's first row is at its least sum, so no task holds more than a range, whatever a conversation's length is.
    """
    rows = rows.withColumns({f"_size_{n}": c.cast("long") for n, c in sizes.items()})
    inside = W.partitionBy("_range").orderBy("_no").rowsBetween(W.unboundedPreceding, -1)
    ranges = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    whole = rows.groupBy("_range").agg(*[F.sum(f"_size_{n}").alias(f"_all_{n}") for n in sizes])
    starts = whole.select("_range", *[F.coalesce(F.sum(f"_all_{n}").over(ranges), F.lit(0)).alias(f"_start_{n}") for n in sizes])
    upto = rows.join(F.broadcast(starts), "_range").withColumns({n: F.col(f"_start_{n}") + F.coalesce(F.sum(f"_size_{n}").over(inside), F.lit(0)) for n in sizes})
    upto = settle(upto.drop(*[f"_{w}_{n}" for w in ("size", "start") for n in sizes]), "chat-sums")
    least = settle(upto.groupBy("conv_id").agg(*[F.min(n).alias(f"_least_{n}") for n in sizes]).withColumnRenamed("conv_id", "_conv"), "chat-least")
    got = upto.join(least.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_conv")))
    return got.withColumns({n: F.col(n) - F.col(f"_least_{n}") for n in sizes}).drop("_conv", *[f"_least_{n}" for n in sizes])


def format_chat(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, parts. -> conv_id, place, role, piece, at (code points before it), loss (spans in the
    conversation's text), attachments (ordinal, type, uri, tokens)."""
    row = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"))
    # a tie column parts equal rows that repeat very often; they may change places
    content = F.to_json("parts")
    row = row.withColumns({"_begin": F.substring(content, 1, 64), "_key": F.md5(content), "_tie": F.xxhash64(F.monotonically_increasing_id())})
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "_begin", "_key", "_tie")]
    row = settle(row.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "chat-ranges")
    row = row.withColumn("_no", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    n_attached = F.size(F.filter("parts", _is_attached))
    row = _sums_before(row, {"place": F.lit(1), "before": n_attached}).withColumns({"place": F.col("place").cast("int"), "before": F.col("before").cast("int")})
    # the places of the attachments, and the flat parts' ends, in one pass over the parts each
    nth = F.aggregate("parts", F.array().cast("array<int>"), lambda acc, p: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + _is_attached(p).cast("int")))
    row = row.withColumn("_nth", F.transform(nth, lambda n: n + F.col("before") - 1))
    row = row.withColumn("flat", F.zip_with("parts", "_nth", lambda p, n: _visit(p, n)))
    head = F.concat(F.lit(TURN), escaped_role(F.col("role")), F.lit("\n"))
    row = row.withColumn("head", F.length(head)).withColumn("piece", F.concat(head, F.array_join("flat", ""), F.lit(END)))
    row = _sums_before(row, {"at": F.length("piece")})
    ends = F.aggregate("flat", F.array().cast("array<long>"), lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + F.length(x)))
    row = row.withColumn("_ends", F.transform(ends, lambda x: x + F.col("at") + F.col("head")))
    spans = F.transform(F.arrays_zip("flat", "_ends", "parts"), lambda z: F.struct((z["_ends"] - F.length(z["flat"])).alias("start"), z["_ends"].alias("stop"), _is_attached(z["parts"]).alias("out")))
    kept = F.transform(F.filter(spans, lambda s: ~s["out"] & (s["stop"] > s["start"])), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    loss = F.when(F.col("role") == "assistant", kept).otherwise(F.array().cast("array<struct<start: long, stop: long>>"))
    rate = F.create_map(*[F.lit(x) for kv in TOKENS_A_UNIT.items() for x in kv])
    refs = F.filter(F.arrays_zip("parts", "_nth"), lambda z: _is_attached(z["parts"]))
    tokens = lambda p: F.coalesce(p["units"], F.lit(1)) * F.coalesce(F.element_at(rate, p["type"]), F.lit(0))
    refs = F.transform(refs, lambda z: F.struct(z["_nth"].alias("ordinal"), z["parts"]["type"].alias("type"), z["parts"]["uri"].alias("uri"), tokens(z["parts"]).alias("tokens")))
    return row.select("conv_id", "place", "role", "piece", "at", loss.alias("loss"), refs.alias("attachments"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or "\n", text)


def digests(formatted: DataFrame) -> DataFrame:
    """Reads the formatted turns back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Digests run over a conversation's turns in order, so each is read as one sorted stream; nothing of it is held.
    """
    rows = formatted.select("conv_id", "place", "piece", "at", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches):
        nothing = object()
        now, n, chars, size, turns, loss = nothing, 0, 0, 0, None, None
        done = []

        def out():
            return (now, n, turns.hexdigest(), chars, loss.hexdigest(), size)

        def given():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                if now is nothing or r["conv_id"] != now:
                    if now is not nothing:
                        done.append(out())
                    now, n, chars, size, turns, loss = r["conv_id"], 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, content = _PIECE.fullmatch(r["piece"]).groups()
                turns.update(f"{unescape(role)}\n{unescape(content)}\n".encode())
                for s in r["loss"]:
                    text = unescape(r["piece"][s["start"] - r["at"] : s["stop"] - r["at"]])
                    loss.update(text.encode())
                    chars += len(text)
                n, size = n + 1, size + len(r["piece"])
            if len(done) > 1000:
                yield given()
                done = []
        if now is not nothing:
            done.append(out())
        if done:
            yield given()

    return rows.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)
    return digests(settle(format_chat(turns.withColumn("parts", text_parts(F.col("text")))), "chat"))
