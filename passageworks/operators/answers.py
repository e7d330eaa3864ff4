"""Which texts of a corpus contain which gold answers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from passageworks.functions.text import normalise
from passageworks.session import by_blocks

#: Characters of answers in one automaton; more answers are searched block by block.
BLOCK_CHARS = 4_000_000


def find_answers(docs: DataFrame, answers: DataFrame, key: str, text: str, answer_key: str, answer: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``key, answer_key`` of every text that contains an answer, both normalised; distinct.

    All answers of a block are looked for in one pass over a text
    (Aho-Corasick), so no text meets an answer in a join.  Null and blank
    answers and null texts match nothing.
    """
    import ahocorasick

    wanted = answers.select(F.col(answer_key).alias("id"), normalise(answer).alias("a")).where(F.length("a") > 0).distinct()
    total = wanted.agg(F.sum(F.length("a"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_chars))
    rows = docs.select(key, normalise(text).alias("__text")).where(F.length("__text") > 0)
    schema = docs.select(key).crossJoin(answers.select(answer_key).limit(0)).schema if key != answer_key else None
    if schema is None:
        raise ValueError("the two keys need different names")
    kind = to_arrow_type(answers.schema[answer_key].dataType)

    def one(i: int) -> tuple[DataFrame, Broadcast]:
        own = wanted.where(F.pmod(F.xxhash64("a"), F.lit(blocks)) == i) if blocks > 1 else wanted
        by: dict[str, list] = {}
        for r in own.collect():  # bounded by block_chars
            by.setdefault(r["a"], []).append(r["id"])
        shared = docs.sparkSession.sparkContext.broadcast(by)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for a, ids in shared.value.items():
                automaton.add_word(a, ids)
            automaton.make_automaton()
            for batch in batches:
                at, ids = [], []
                for j, value in enumerate(batch.column(1).to_pylist()):
                    hits = {x for _, own in automaton.iter(value) for x in own} if len(automaton) else ()
                    at += [j] * len(hits)
                    ids += hits
                if at:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(ids, kind)], [key, answer_key])

        return rows.mapInArrow(run, schema), shared

    return by_blocks(docs.sparkSession, "answers", blocks, one).distinct()
