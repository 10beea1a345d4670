"""Long lists of keywords looked for in texts, all at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..cluster import ship

#: Bytes of keywords that one automaton is made of; longer lists take several passes.
BLOCK = 8 << 20


def _blocks(words: Iterable[str], most: int) -> Iterator[list[str]]:
    block, size = [], 0
    for w in words:
        n = len(w.encode())
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append(w)
        size += n
    if block:
        yield block


def match_many(df: DataFrame, text: str, keywords: DataFrame | Iterable[str], out: str = "keywords", block: int = BLOCK) -> DataFrame:
    """``df`` with the keywords that are substrings of its lower-cased texts, in the list's order.

    ``keywords`` is a list or a frame of one column; they are lower-cased, and a repeated or
    empty one counts once or not at all.  An automaton reads each text once, however long the list is.  A
    frame comes through the driver in blocks of at most ``block`` bytes, in order of its words.
    """
    import ahocorasick

    if isinstance(keywords, DataFrame):
        one = keywords.select(F.lower(keywords.columns[0]).alias("k")).where("k <> ''").distinct().orderBy("k")
        words: Iterable[str] = (r.k for r in one.toLocalIterator())
    else:
        words = dict.fromkeys(w.lower() for w in keywords if w)
    low = "__low"
    while low in df.columns:
        low += "_"
    names = [c for c in df.columns if c.lower() != out.lower()]
    done = df.select(*names, F.lower(F.coalesce(F.col(text), F.lit(""))).alias(low), F.array().cast("array<string>").alias(out))
    for block_words in _blocks(words, block):
        sent = df.sparkSession.sparkContext.broadcast(block_words)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, w in enumerate(sent.value):
                automaton.add_word(w, k)
            automaton.make_automaton()
            for batch in batches:
                found = []
                for t, held in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                    found.append(held + [sent.value[k] for k in sorted({k for _, k in automaton.iter(t)})])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.string()))], batch.schema.names)

        ship(df.sparkSession)
        done = done.mapInArrow(run, done.schema)
    return done.drop(low)
