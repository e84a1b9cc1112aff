"""Does a value that was masked anywhere in a conversation still stand in one of its messages?

Detection depends on context, so a value can be masked in one turn and left in another.
All values of a conversation are looked for in all its sanitized texts at once, by an
Aho-Corasick automaton. A conversation with very many values has several automata of
bounded size (values are dealt to them by hash), and its messages go in chunks, so that
both a long conversation and one with many values are split over tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUES = 4096                                                    # of an automaton, about
TURNS = 256                                                      # of a chunk of messages


def conversation_leaks(masked: DataFrame, conv: str = "conv_id", turn: str = "turn", values: int = VALUES, turns: int = TURNS) -> DataFrame:
    """(conv, turn, type, value): masked values that occur in a sanitized text of the same conversation.

    ``masked`` has conv, turn, masked and tokens. Values are compared as they are, as
    parts of the text; a value masked as several types counts for each. Empty values and
    null texts don't count. A token's own text (its brackets and name) is not a leak.
    """
    known = masked.select(conv, F.explode("tokens").alias("t")).select(conv, F.col("t.type").alias("type"), F.col("t.value").alias("value"))
    known = known.where(F.col("value") != "").distinct()
    parts = known.groupBy(conv).agg(F.ceil(F.count(F.lit(1)) / F.lit(values)).cast("int").alias("parts"))
    dealt = known.join(parts, conv).groupBy(conv, F.pmod(F.xxhash64("value"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list(F.struct("type", "value")).alias("known"))
    texts = masked.where(F.length("masked") > 0).groupBy(conv, F.expr(f"cast({turn} div {turns} as bigint)").alias("chunk")).agg(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col("masked").alias("text"))).alias("texts"))
    kind, key = masked.schema[turn].dataType, masked.schema[conv]
    out = T.StructType([key, T.StructField(turn, kind), T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])
    both = dealt.join(texts, conv).select(conv, "known", "texts")

    def run(batches):
        import ahocorasick

        last, automaton, types = None, None, {}
        for batch in batches:
            at, rows = [], []
            for i in range(batch.num_rows):
                known = batch.column("known")[i]
                if last is None or not known.equals(last):       # the rows of a conversation come one after another
                    last, automaton, types = known, ahocorasick.Automaton(), {}
                    for k in known.as_py():
                        types.setdefault(k["value"], []).append(k["type"])
                        automaton.add_word(k["value"], k["value"])
                    automaton.make_automaton()
                for t in batch.column("texts")[i].as_py():
                    for value in sorted({v for _, v in automaton.iter(t["text"])}):
                        for name in types[value]:
                            at.append(i)
                            rows.append((t["turn"], name, value))
            turn_type = batch.schema.field("texts").type.value_type.field("turn").type
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(conv).take(pa.array(at, pa.int32())), pa.array(cols[0], turn_type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], out.names)

    return both.mapInArrow(run, out)
