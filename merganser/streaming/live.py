"""Live scoring over Structured Streaming: state by key, each record scored before it is learned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from merganser.operators.novelty import RATE, score_rows, units


def scorer(cells: int, rate: float = RATE):
    """A function for `applyInPandasWithState`: the state of a key is the sum of logarithms of each cell and the last record's number.

    Rows of a micro-batch are taken in order of `seq`; a record that comes after a later one is scored as it comes and flagged late.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        logs, last = (np.frombuffer(state.get[0], np.int64), state.get[1]) if state.exists else (np.zeros(cells, np.int64), -1)
        seq, cells_of, acts = (np.concatenate(c) for c in zip(*((b["seq"].to_numpy(), b["cells"].to_numpy(), b["activations"].to_numpy()) for b in batches)))
        order = np.argsort(seq, kind="stable")
        seq, cells_of, acts = seq[order], cells_of[order], acts[order]
        size = np.fromiter(map(len, cells_of), np.int64, len(seq))
        # Tags as rows of one length: places past a tag's end are of a cell of their own and are not driven.
        in_tag = np.arange(size.max(initial=1)) < size[:, None]
        won, v, logs = np.full(in_tag.shape, cells), np.zeros(in_tag.shape), np.append(logs, 0)
        won[in_tag], v[in_tag] = np.concatenate(cells_of), np.maximum(np.concatenate(acts), 0)
        log = units(1 - rate * v / np.maximum(v.max(axis=1, keepdims=True), 1))
        then = np.empty_like(log)
        for i, (c, x) in enumerate(zip(won, log)):
            then[i] = logs[c]
            logs[c] += x
        state.update((logs[:cells].tobytes(), max(last, int(seq[-1]))))
        yield pd.DataFrame({"key": key[0], "seq": seq, "novelty": score_rows(v, then), "late": seq < last})

    return run


def live_scores(tags: DataFrame, cells: int, rate: float = RATE) -> DataFrame:
    """(key, seq, novelty, late) for a stream of tags (key, seq, cells, activations)."""
    return tags.groupBy("key").applyInPandasWithState(scorer(cells, rate), "key string, seq long, novelty double, late boolean", "logs binary, last long", "append", GroupStateTimeout.NoTimeout)


def follow(spark, path: str, schema: str = "value string") -> DataFrame:
    """Lines of files as they appear in a folder; a spooler moves whole files in, so no line is read in part."""
    return spark.readStream.schema(schema).text(path).filter(F.trim("value") != "")
