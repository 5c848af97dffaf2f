"""Which of many fixed strings stand in a text, in one pass over it: an Aho-Corasick automaton, built once by the driver and shared.

The automaton of a group of needles is broadcast; a list of more than ``GROUP_BYTES`` is cut into groups of that size, each with a pass of its own, so no automaton grows with the list.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of the needles of one automaton, which takes some 40 times as much memory.
GROUP_BYTES = 4 << 20


def _automaton(needles: list[tuple[int, str]]) -> bytes:
    same: dict[str, list[int]] = {}
    for key, needle in needles:
        same.setdefault(needle, []).append(key)
    found = ahocorasick.Automaton()
    for needle, keys in same.items():
        found.add_word(needle, tuple(keys))
    if same:
        found.make_automaton()
    return pickle.dumps(found)


def needles_in(df: DataFrame, text: Column, needles: list[tuple[int, str]], into: str = "needles") -> DataFrame:
    """All columns, and the sorted keys of the needles that stand in ``text``; null and empty needles stand nowhere, and nothing stands in a null text."""
    groups: list[list[tuple[int, str]]] = [[]]
    size = 0
    for key, needle in needles:
        if needle:
            size += len(needle.encode())
            if size > GROUP_BYTES and groups[-1]:
                groups.append([])
                size = len(needle.encode())
            groups[-1].append((int(key), needle))
    found = [_one_pass(df, text, group) for group in groups if group]
    return df.withColumn(into, F.array_sort(F.array_distinct(F.concat(*found))) if found else F.array().cast("array<bigint>"))


def _one_pass(df: DataFrame, text: Column, needles: list[tuple[int, str]]) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(_automaton(needles))

    @F.pandas_udf("array<bigint>")
    def stands(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = pickle.loads(shared.value)
        for texts in batches:
            yield pd.Series([sorted({key for _, keys in automaton.iter(t) for key in keys}) if t else [] for t in texts], dtype=object)

    return stands(text)


def needles_of(table: DataFrame, key: str, needle: str, most_bytes: int = 1 << 30) -> list[tuple[int, str]]:
    """The rows of a table of needles, which must not be larger than ``most_bytes``."""
    rows = table.select(F.col(key).alias("key"), F.col(needle).alias("needle")).filter("needle <> ''")
    size = rows.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of needles are more than {most_bytes}")
    return [(r["key"], r["needle"]) for r in rows.collect()]
