"""Quality rules, in DataFrame operations only: counts of each text, and line frequency across documents.

Base counts are made inside each row (arrays never leave it).  Across documents, lines are normalised
(lower case, runs of white space as one space, trimmed), hashed, and for each host the distinct documents with a line are
counted; exact copies are one document.  A line is boilerplate of its host if over ``LINE_DOCS`` documents
and over ``LINE_SHARE`` of the host's documents hold it.  Boilerplate lines are removed; a document that loses
over ``MOST_LOST`` of its words, or has under ``LEAST_LEFT`` words left, is rejected as depleted.

Distinct documents and the holders of a line are counted by partial sums, so a hot host or a hot line is spread there; the join of lines with
the boilerplate list is left to the planner, which broadcasts a short list and splits skewed partitions of a long one.

Defined cases: null text counts as empty and fails the base rules; null host is the host ''; a text without words has no windows;
repeated rows each get a row; an empty table gives no rows; other columns stay untouched, in the stage whatever their names
(but for ``__host``, ``__key``, ``__counts`` and names behind ``__quality_``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.llm.common import Scratch, table

WINDOW_WORDS, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
LINE_DOCS, LINE_SHARE_OF, MOST_LOST, LEAST_LEFT = 10, 20, 0.5, 10  # a share of one in LINE_SHARE_OF
LINE_SHARE = 1 / LINE_SHARE_OF
#: Bytes of a list that is broadcast, and bytes of one of its rows besides host and hashes of lines.
SHORT_LIST, ROW_BYTES = 16 << 20, 128
_SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACES))


def _covered(hashes: Column) -> Column:
    """Positions covered by windows whose hash is seen twice or more."""

    def from_sorted(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"]))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW_WORDS)))), F.lit(0), lambda a, x: a + x))

    return let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), from_sorted)


def repeat_words(w: Column) -> Column:
    """Words inside windows found twice or more in the text."""

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h))

    windows = let(F.transform(w, lambda x: F.xxhash64(x)), lambda wh: F.transform(F.sequence(F.lit(1), F.size(wh) - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(F.slice(wh, i, WINDOW_WORDS))))
    return F.when(F.size(w) <= WINDOW_WORDS, F.lit(0)).otherwise(let(windows, of_hashes))


def base_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed, each name behind ``prefix``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    counts = F.struct(
        (F.length(F.translate(t, _SPACE, ""))).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"))).alias("of_words"),
    )
    found = docs.withColumn("__counts", let(counts, lambda c: c))
    n, repeated = F.col("__counts.of_words.n_words"), F.col("__counts.of_words.n_repeat_words")
    added = {name: F.col(f"__counts.{name}") for name in ("word_chars", "n_symbols", "n_dup_lines")}
    added = {"n_words": n, **added, "n_repeat_words": repeated, "base_failed": (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)}
    return found.withColumns({prefix + name: column for name, column in added.items()}).drop("__counts")


def _normal(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(line, _SPACES, " ")))


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _host(host: Column) -> Column:
    return F.coalesce(host, F.lit(""))


def line_table(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Rows (host, text_key, lines): a row for each distinct document of a host, lines as (hash, words)."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), _normal), lambda x: x != "")
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("n")))
    return docs.select(_host(F.col(host)).alias("host"), _text_key(F.col(text)).alias("text_key"), hashed.alias("lines")).groupBy("host", "text_key").agg(F.first("lines").alias("lines"))


def boilerplate(lines: DataFrame) -> DataFrame:
    """Rows (host, h) of lines that too many documents of the host hold."""
    size = lines.groupBy("host").agg(F.count("*").alias("host_docs"))
    seen = lines.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n_docs"))
    return seen.filter(F.col("n_docs") > LINE_DOCS).join(size, "host").filter(F.col("n_docs") * LINE_SHARE_OF > F.col("host_docs")).select("host", "h")


def depletion(lines: DataFrame) -> DataFrame:
    """Rows (host, text_key, lost_words, lost_lines) of documents that hold boilerplate; ``lost_lines`` are hashes."""
    single = lines.select("host", "text_key", F.explode("lines").alias("line")).select("host", "text_key", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    return single.join(boilerplate(lines), ["host", "h"]).groupBy("host", "text_key").agg(F.sum("n").alias("lost_words"), F.collect_set("h").alias("lost_lines"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", scratch: Scratch | None = None, prefix: str = "") -> DataFrame:
    """All columns of ``docs``, the base counts, ``lost_words``, ``lost_lines`` and ``kept``, each name behind ``prefix``.

    A column that is added takes the place of one of its name; a prefix keeps both.
    With ``scratch`` the list of documents that hold boilerplate is written first; a list of ``SHORT_LIST`` bytes or fewer goes to the
    texts, which then aren't shuffled, and a longer one is joined by shuffles.
    """
    lost_words, lost_lines, n_words = prefix + "lost_words", prefix + "lost_lines", F.col(prefix + "n_words")
    keyed = base_counts(docs.drop(lost_words, lost_lines), text, prefix).withColumns({"__host": _host(F.col(host)), "__key": _text_key(F.col(text))})
    lost = depletion(line_table(docs, text, host)).withColumnsRenamed({"host": "__host", "text_key": "__key", "lost_words": lost_words, "lost_lines": lost_lines})
    if scratch is not None:
        lost = scratch.keep(lost, "lost")
        size = lost.agg(F.sum(ROW_BYTES + F.octet_length("__host") + 8 * F.size(lost_lines))).first()[0] or 0
        lost = F.broadcast(lost) if size <= SHORT_LIST else lost
    words_lost = F.coalesce(F.col(lost_words), F.lit(0))
    depleted = (words_lost > 0) & ((words_lost > MOST_LOST * n_words) | (n_words - words_lost < LEAST_LEFT))
    return keyed.join(lost, ["__host", "__key"], "left").withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & ~depleted).drop("__host", "__key")


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without the lines of these hashes."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(hashes, F.xxhash64(_normal(x))))
    return F.when(F.size(hashes) > 0, F.array_join(kept, "\n")).otherwise(text)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go, boilerplate lines go from the others."""
    columns = docs.columns
    kept = judge(docs, scratch=Scratch(spark, "quality"), prefix="__quality_").filter("__quality_kept")
    text = without_lines(F.col("text"), F.coalesce(F.col("__quality_lost_lines"), F.array().cast("array<bigint>")))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same in DuckDB.  Windows are compared as lists of words, lines as strings.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i : i + 7], ' ') AS s FROM w, unnest(range(1, len(ws) - 6)) AS u(i) WHERE len(ws) >= 8),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, range(8) AS q(k) GROUP BY r),
raw_lines AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT *, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
hosts AS (SELECT host, count(DISTINCT t) AS host_docs FROM d GROUP BY host),
boiler AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT t) AS c FROM lines GROUP BY host, norm) JOIN hosts USING (host) WHERE c > 10 AND c * 20 > host_docs),
lost AS (SELECT r, sum(len(regexp_extract_all(norm, '[^ ]+'))) AS n FROM lines JOIN boiler USING (host, norm) GROUP BY r),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0) AS lost_words
      FROM w LEFT JOIN rep USING (r) LEFT JOIN dl USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (lost_words > 0 AND (lost_words > 0.5 * n_words OR n_words - lost_words < 10)) AS kept
FROM b
"""
