"""Named queries over the dataset and the SQL that states each one's result.

Roles: chunk = document, scheme = ``lang``, global scheme = texts of ``es``, vector = ``embeddings`` on ``vec_id = doc_id``, source URL = made from the
document's source.  Questions and answers are literal rows (``QUESTIONS``, ``ANSWERS``), for phrases that the synthetic tables lack, and the turns of
``conversations``; queries with SQL over the literal answers alone have a form ``_turns`` over both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundspark.config import DEFAULT, DEMO, Profile
from groundspark.functions import contract, followup, routing, text, urls, vectors
from groundspark.cluster import shared_folder
from groundspark.operators import answer, boilerplate, cache, chunk, dialogue, embed, html, index, memory, needles, postings, report, running, search

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

QUESTIONS = [
    (1, "What is the expense ratio of Acorn Overnight Fund?"), (2, "Should I invest in Acorn Gilt Fund?"), (3, "Which fund gave the best returns last year?"),
    (4, "Who won the cricket world cup?"), (5, "My PAN is ABCDE1234F, what is my folio?"), (6, "minimum SIP for Acorn Multi Asset Fund and Acorn Gilt Fund"), (7, "   "),
    (8, "Tell me about arbitrage"), (9, "How do I download my account statement?"), (10, "call me on 9876543210 about exit load"), (11, "Is there a lock-in for multi asset?"),
    (12, "what is the price of gold"), (13, "compare the nav of two funds"), (14, "my otp is 445566"), (15, "mail a.b@example.com the factsheet"),
]
ANSWERS = [
    (1, "The expense ratio is 0.85% of assets. The minimum SIP is 500 rupees.", "expense ratio 0.85% and SIP of 500 rupees"),
    (2, "You should invest now. The exit load is 1% within 12 months.", "exit load 1% for 12 months"),
    (3, "That information is not in the sources provided.", "nothing"),
    (4, "The lock-in is 3 years, as of 1 May 2024. The ratio is 2.25% there.", "lock-in of 3 years, 12.25% once"),
    (5, "I recommend this fund.", "fund"),
    (6, "", ""),
]
_PROFILE = Profile(global_scheme="es")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(_quoted(v) if isinstance(v, str) else str(v) for v in r) + ')' for r in rows)}) AS v({names})"


def _of_texts(columns: Callable[[Column], dict[str, Column]]) -> Query:
    return lambda spark, sf_dir: _table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in columns(F.col("text")).items()])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "block"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal questions and all turns of users."""
    turns = _table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("query_id"), F.col("text").alias("question"))
    return spark.createDataFrame(QUESTIONS, "query_id long, question string").unionByName(turns)


_SQL_QUESTIONS = f"(SELECT * FROM {_values(QUESTIONS, 'query_id, question')} UNION ALL SELECT conv_id * 1000 + turn + 1000, text FROM conversations WHERE role = 'user')"
_SQL_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
_SQL_WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t\n\r\f\x0b]+'), lambda x: x <> '')"
_SQL_LINES = "(SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS pos, unnest(string_split(text, chr(10))) AS block FROM documents)"

# ---- text functions ---------------------------------------------------------------------------------------

query("text_normalize", r"SELECT doc_id, md5(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ') AS digest FROM documents")(_of_texts(lambda t: {"digest": F.md5(text.normalise(t))}))
query("text_fingerprint", f"SELECT doc_id, md5(array_to_string({_SQL_TOKENS.format('text')}, ' ')) AS digest FROM documents")(_of_texts(lambda t: {"digest": F.md5(text.fingerprint(t))}))
query("text_slug", "SELECT doc_id, trim(regexp_replace(lower(source || ' (' || lang || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")(
    lambda spark, sf_dir: _table(spark, sf_dir, "documents").select("doc_id", text.slug(F.concat("source", F.lit(" ("), "lang", F.lit(")"))).alias("slug"))
)
query("text_preview", f"SELECT doc_id, CASE WHEN length(s) <= 100 THEN s ELSE s[1:97] || '...' END AS preview FROM (SELECT doc_id, array_to_string({_SQL_WORDS.format('text')}, ' ') AS s FROM documents)")(_of_texts(lambda t: {"preview": text.preview(t, 100)}))
query("secret_mask", "SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN repeat('*', length(c_name)) ELSE c_name[1:4] || repeat('*', length(c_name) - 8) || right(c_name, 4) END AS masked FROM customer")(
    lambda spark, sf_dir: _table(spark, sf_dir, "customer").select("c_custkey", text.mask_secret(F.col("c_name")).alias("masked"))
)
query(
    "line_clean",
    rf"""SELECT doc_id, count(*) AS n_lines, sum(length(c))::BIGINT AS n_chars FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(translate(block, chr(160) || '–—', ' --'), '[\x{{E000}}-\x{{F8FF}}]', '', 'g'), '[ \t\x{{200B}}]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS c FROM {_SQL_LINES}) GROUP BY doc_id""",
)(lambda spark, sf_dir: _lines(spark, sf_dir).select("doc_id", text.clean_line(F.col("block")).alias("c")).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("c")).alias("n_chars")))
query(
    "junk_filter",
    rf"""SELECT doc_id, count(*) FILTER (WHERE regexp_matches(block, {_quoted(text.JUNK_LINE)}) OR regexp_matches(block, {_quoted(text.PLACEHOLDER)})) AS n_furniture FROM {_SQL_LINES} GROUP BY doc_id""",
)(lambda spark, sf_dir: _lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(text.is_furniture(F.col("block"))).alias("n_furniture")))
query("call_to_action", f"SELECT doc_id, md5(regexp_replace(text, {_quoted(text.CALL_TO_ACTION)}, '')) AS digest FROM documents")(_of_texts(lambda t: {"digest": F.md5(text.without_call_to_action(t))}))
query(
    "blank_runs",
    f"""WITH l AS (SELECT doc_id, pos, block, lag(block) OVER w AS before, max(CASE WHEN block <> '' THEN pos END) OVER (PARTITION BY doc_id) AS last FROM {_SQL_LINES} WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT d.doc_id, count(l.pos) FILTER (WHERE block <> '' OR (coalesce(before, '') <> '' AND pos < last)) AS n_lines FROM documents d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id""",
)(_of_texts(lambda t: {"n_lines": text.let(F.split(t, "\n"), lambda x: F.size(text.squeeze_blank_lines(x))).cast("long")}))
query(
    "sentence_count",
    r"""SELECT doc_id, CASE WHEN trim(text, E' \n\t\r') = '' THEN 0 ELSE 1 + len(regexp_extract_all(trim(text, E' \n\t\r'), '[.!?]\s+[A-Z0-9"''(“]')) END::INT AS n_sentences FROM documents""",
)(_of_texts(lambda t: {"n_sentences": F.size(text.split_sentences(text.strip(t)))}))
query("word_count", f"SELECT doc_id, len({_SQL_WORDS.format('text')})::INT AS n_words FROM documents")(_of_texts(lambda t: {"n_words": text.word_count(t)}))
query(
    "tail_overlap",
    f"SELECT doc_id, CASE WHEN len(w) > 30 THEN array_to_string(w[-30:], ' ') ELSE '' END AS tail FROM (SELECT doc_id, {_SQL_WORDS.format('text')} AS w FROM documents)",
)(_of_texts(lambda t: {"tail": text.tail_overlap(t)}))
_SQL_NUMERIC = r"^[^\w]*[\d.,%()/-]+[^\w]*$"
query(
    "table_block_detect",
    rf"""SELECT doc_id, (pipes >= 2 OR (t >= 2 AND 2 * t >= len(rows_))) AS is_table FROM (SELECT *, len(list_filter(rows_, lambda r: len({_SQL_WORDS.format('r')}) >= 3 AND len(list_filter({_SQL_WORDS.format('r')}, lambda x: regexp_matches(x, '{_SQL_NUMERIC}'))) >= 2)) AS t
    FROM (SELECT doc_id, length(text) - length(replace(text, '|', '')) AS pipes, list_filter(string_split(text, chr(10)), lambda r: regexp_matches(r, '\S')) AS rows_ FROM documents))""",
)(_of_texts(lambda t: {"is_table": text.is_table_block(t)}))
query(
    "heading_detect",
    rf"""SELECT doc_id, count(*) FILTER (WHERE NOT (pipes >= 2 OR n > 16 OR regexp_matches(block, '[.;,]$') OR s = '') AND (regexp_matches(s, '^(\d+(\.\d+)*\.?|[IVXLC]+\.|Section\s+\d+)\s+\S') OR s LIKE '%:' OR (upper(s) = s AND lower(s) <> s AND length(s) > 3) OR (length(s) <= 110 AND s NOT LIKE '%.'))) AS n_headings
    FROM (SELECT *, trim(block, E' \n\t\r\f') AS s, length(block) - length(replace(block, '|', '')) AS pipes, len({_SQL_WORDS.format('block')}) AS n FROM {_SQL_LINES}) GROUP BY doc_id""",
)(lambda spark, sf_dir: _lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(text.looks_like_heading(F.col("block"))).alias("n_headings")))
query(
    "tabular_run",
    rf"""SELECT doc_id, (len(w) >= 12 AND k >= 8 AND k >= 0.15 * len(w) AND len(list_filter(w, lambda x: length(x) > 3 AND regexp_matches(x, '[.!?]$') AND NOT regexp_matches(x, '{_SQL_NUMERIC}'))) = 0) AS tabular
    FROM (SELECT *, len(list_filter(w, lambda x: regexp_matches(x, '{_SQL_NUMERIC}'))) AS k FROM (SELECT doc_id, {_SQL_WORDS.format('text')} AS w FROM documents))""",
)(_of_texts(lambda t: {"tabular": text.let(text.words(t), text.looks_tabular)}))
query(
    "window_chunks",
    f"""SELECT doc_id, (i // 160)::INT AS pos, md5(array_to_string(w[i + 1 : i + 160], ' ')) AS digest FROM (SELECT doc_id, w, unnest(range(0, len(w), 160)) AS i FROM (SELECT doc_id, {_SQL_WORDS.format('text')} AS w FROM documents) WHERE len(w) > 0)""",
)(lambda spark, sf_dir: _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.word_windows(F.col("text"))).alias("pos", "t")).select("doc_id", "pos", F.md5("t").alias("digest")))

# ---- pages ------------------------------------------------------------------------------------------------

query(
    "url_allowlist",
    r"SELECT page_id, coalesce(h = 'example.com' OR h LIKE '%.example.com' OR h = 'example.org' OR h LIKE '%.example.org', false) AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h FROM pages)",
)(lambda spark, sf_dir: _table(spark, sf_dir, "pages").select("page_id", urls.is_allowed_url(F.col("url")).alias("allowed")))
query("html_title", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")(
    lambda spark, sf_dir: _table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))
)
query("html_blocks")(lambda spark, sf_dir: html.page_blocks(_table(spark, sf_dir, "pages")))
query("page_checks")(
    lambda spark, sf_dir: _table(spark, sf_dir, "pages").withColumn("p", html.html_parts("html")).select("page_id", html.is_soft_404(F.col("p.title"), F.col("p.blocks")).alias("soft_404"), html.has_enough_text(F.col("p.blocks")).alias("enough"))
)

# ---- boilerplate ------------------------------------------------------------------------------------------

_SQL_SHINGLED = f"(SELECT *, CASE WHEN len(t) >= 6 THEN array_to_string(t[1:12], ' ') END AS shingle FROM (SELECT *, {_SQL_TOKENS.format('block')} AS t FROM {_SQL_LINES}))"
_SQL_REPEAT = """rep AS (SELECT doc_id, pos, count(DISTINCT i + k)::DOUBLE / any_value(n) AS share FROM (SELECT doc_id, pos, i, n, count(*) OVER (PARTITION BY doc_id, pos, s) AS c FROM (SELECT doc_id, pos, len(t) AS n, i, array_to_string(t[i : i + 11], ' ') AS s FROM b, unnest(range(1, len(t) - 10)) AS u(i) WHERE len(t) >= 12)), range(12) AS q(k) WHERE c > 1 GROUP BY doc_id, pos)"""
_SQL_BAD = f"""b AS (SELECT * FROM {_SQL_SHINGLED}), {_SQL_REPEAT},
f AS (SELECT b.*, len(t) > 12 AND coalesce(share, 0) >= 0.5 AND len(list_filter(t, lambda x: list_contains([{', '.join(_quoted(w) for w in DEMO.chrome_vocabulary)}], x)))::DOUBLE / greatest(len(t), 1) >= 0.35 AS furniture FROM b LEFT JOIN rep USING (doc_id, pos)),
g AS (SELECT shingle, doc_id, count(*) FILTER (WHERE NOT furniture) AS plain, bool_or(furniture) AS furniture FROM f WHERE shingle IS NOT NULL GROUP BY shingle, doc_id),
bad AS (SELECT shingle, CASE WHEN bool_or(furniture) THEN 'furniture' WHEN count(*) FILTER (WHERE plain > 0) > 1 THEN 'shared' ELSE 'repeated' END AS reason FROM g GROUP BY shingle HAVING bool_or(furniture) OR count(*) FILTER (WHERE plain > 0) > 1 OR max(plain) > 1)"""
query("boilerplate_shingles", f"WITH {_SQL_BAD} SELECT shingle, reason FROM bad")(lambda spark, sf_dir: boilerplate.boilerplate_shingles(_lines(spark, sf_dir)))
query("boilerplate_removed", f"WITH {_SQL_BAD} SELECT doc_id, count(*) AS n_kept, sum(length(block))::BIGINT AS n_chars FROM f WHERE shingle IS NULL OR shingle NOT IN (SELECT shingle FROM bad) GROUP BY doc_id")(
    lambda spark, sf_dir: boilerplate.drop_boilerplate(_lines(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.sum(F.length("block")).alias("n_chars"))
)
query("boilerplate_emptied", f"WITH {_SQL_BAD} SELECT DISTINCT doc_id FROM b WHERE doc_id NOT IN (SELECT doc_id FROM f WHERE shingle IS NULL OR shingle NOT IN (SELECT shingle FROM bad))")(
    lambda spark, sf_dir: boilerplate.emptied(_lines(spark, sf_dir), boilerplate.drop_boilerplate(_lines(spark, sf_dir)))
)
query("repeat_share", f"WITH b AS (SELECT * FROM {_SQL_SHINGLED}), {_SQL_REPEAT} SELECT doc_id, pos, round(coalesce(share, 0), 6) AS share FROM b LEFT JOIN rep USING (doc_id, pos)")(
    lambda spark, sf_dir: _lines(spark, sf_dir).select("doc_id", "pos", F.round(boilerplate.repeat_share(F.col("block")), 6).alias("share"))
)

# ---- chunks and reports -----------------------------------------------------------------------------------


def _window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("scheme"), F.posexplode(text.word_windows(F.col("text"))).alias("chunk_pos", "text"))


def _chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks."""
    url = F.concat(F.lit("https://"), "source", F.when(F.col("doc_id") % 3 == 0, ".example.net/").otherwise(".example.com/"), F.col("doc_id").cast("string"))
    return _table(spark, sf_dir, "documents").select(
        (F.col("doc_id") - F.when(F.col("doc_id") % 97 == 96, 1).otherwise(0)).cast("string").alias("chunk_id"), F.col("lang").alias("scheme"), F.col("source").alias("doc_type"), url.alias("source_url"), F.concat(F.lit("page of "), "source").alias("page_title"),
        F.lit("").alias("section"), F.lit("2024-05-01").alias("fetched_at"), "text",
    )


query(
    "chunk_ids",
    f"""WITH c AS (SELECT doc_id, lang, (i // 160)::INT AS chunk_pos FROM (SELECT doc_id, lang, unnest(range(0, len(w), 160)) AS i FROM (SELECT doc_id, lang, {_SQL_WORDS.format('text')} AS w FROM documents) WHERE len(w) > 0))
    SELECT doc_id, chunk_pos, lang || '-' || lpad((row_number() OVER (ORDER BY doc_id, chunk_pos))::VARCHAR, greatest(4, length((row_number() OVER (ORDER BY doc_id, chunk_pos))::VARCHAR))::INT, '0') AS chunk_id FROM c""",
)(lambda spark, sf_dir: chunk.number_chunks(_window_rows(spark, sf_dir)).select("doc_id", "chunk_pos", "chunk_id"))
query("chunk_document")(lambda spark, sf_dir: chunk.chunk_documents(_table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("blocks"))))
_SQL_CHUNKS = """(SELECT CASE WHEN doc_id % 97 = 96 THEN doc_id - 1 ELSE doc_id END::VARCHAR AS chunk_id, lang AS scheme, source AS doc_type, 'https://' || source || CASE WHEN doc_id % 3 = 0 THEN '.example.net/' ELSE '.example.com/' END || doc_id AS source_url, 'page of ' || source AS page_title, text, doc_id FROM documents)"""
query(
    "chunk_validate",
    f"""SELECT chunk_id, 'too many words' AS problem FROM {_SQL_CHUNKS} WHERE len({_SQL_WORDS.format('text')}) > 160 UNION ALL SELECT chunk_id, 'source not allowed' FROM {_SQL_CHUNKS} WHERE doc_id % 3 = 0
    UNION ALL SELECT chunk_id, 'id is not unique' FROM {_SQL_CHUNKS} GROUP BY chunk_id HAVING count(*) > 1""",
)(lambda spark, sf_dir: report.validate(_chunk_rows(spark, sf_dir)))
query("group_counts", "SELECT scheme, count(*) AS n FROM (SELECT lang AS scheme FROM documents) GROUP BY scheme")(lambda spark, sf_dir: report.counts(_chunk_rows(spark, sf_dir), "scheme"))
query(
    "word_stats",
    rf"""WITH d AS (SELECT len({_SQL_WORDS.format('text')}) AS w, length(text) - length(replace(text, '|', '')) AS pipes, list_filter(string_split(text, chr(10)), lambda r: regexp_matches(r, '\S')) AS rows_ FROM documents),
    t AS (SELECT *, len(list_filter(rows_, lambda r: len({_SQL_WORDS.format('r')}) >= 3 AND len(list_filter({_SQL_WORDS.format('r')}, lambda x: regexp_matches(x, '{_SQL_NUMERIC}'))) >= 2)) AS k FROM d)
    SELECT count(*) AS n_chunks, min(w)::INT AS min_words, max(w)::INT AS max_words, (sum(w) // count(*))::BIGINT AS mean_words, count(*) FILTER (WHERE pipes >= 2 OR (k >= 2 AND 2 * k >= len(rows_))) AS n_tables FROM t""",
)(lambda spark, sf_dir: report.word_stats(_chunk_rows(spark, sf_dir)))
_FACTS = {"the": (" the ", "the "), "und": (" und ",), "absent": ("no such needle anywhere",), "mark": ("|", "#")}
query(
    "fact_coverage",
    "WITH f AS (SELECT * FROM (VALUES "
    + ", ".join(f"({_quoted(n)}, [{', '.join(_quoted(x) for x in needles)}])" for n, needles in _FACTS.items())
    + ") AS v(fact, needles)) SELECT fact, count(d.doc_id) AS n_chunks, count(DISTINCT d.lang) AS n_schemes, count(d.doc_id) > 0 AS found FROM f LEFT JOIN documents d ON len(list_filter(needles, lambda x: contains(lower(d.text), x))) > 0 GROUP BY fact",
)(lambda spark, sf_dir: report.fact_coverage(_chunk_rows(spark, sf_dir), _FACTS))

query("passage_hits", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)")(
    lambda spark, sf_dir: needles.needles_in(_table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), needles.needles_of(_table(spark, sf_dir, "benchmark"), "item_id", "text")).select("doc_id", F.explode("needles").alias("item_id"))
)


@query("chunk_limits")
def chunk_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their words and tokens; tests check both limits and that no word is lost."""
    found = chunk.chunk_documents(_table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("blocks")))
    pieces = F.regexp_count("text", F.lit(r"[\p{L}\p{N}]{1,6}|[^\p{L}\p{N}\s]"))
    return found.select("doc_id", "chunk_pos", text.word_count(F.col("text")).alias("n_words"), pieces.alias("n_tokens"), F.md5("text").alias("digest"))


# ---- search -----------------------------------------------------------------------------------------------


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return rows.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("scheme"), "embedding", "text", F.concat(F.lit("https://"), "source", F.lit(".example.com/thing")).alias("source_url"), F.concat(F.lit("page of "), "source").alias("page_title"), F.lit("2024-05-01").alias("fetched_at"))


def _asked(spark: SparkSession, sf_dir: str, filtered: bool) -> DataFrame:
    """A question for each vector whose id is divisible by 20: its document's text, and schemes by its id."""
    texts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    kind = F.col("query_id") % 60
    schemes = F.when(kind == 20, F.array(F.lit("de"), F.lit("fr"))).when(kind == 40, F.array(F.lit("en"))) if filtered else F.lit(None)
    asked = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding").filter("query_id % 20 = 0").join(texts, "query_id", "left")
    rows = asked.select("query_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce(schemes.cast("array<string>"), F.array().cast("array<string>")).alias("schemes"), "embedding")
    return rows.withColumn("windows", search.windows_of(F.col("schemes"), _PROFILE))


def _found(spark: SparkSession, sf_dir: str, filtered: bool, n: int) -> DataFrame:
    return search.nearest(_asked(spark, sf_dir, filtered), _indexed(spark, sf_dir), n)


def _with_terms(asked: DataFrame) -> DataFrame:
    return asked.select("query_id", "schemes", search.content_terms(F.col("question"), F.col("schemes"), _PROFILE).alias("terms"))


def _ranked(spark: SparkSession, sf_dir: str, filtered: bool) -> DataFrame:
    asked = _asked(spark, sf_dir, filtered)
    hits = search.merged(search.nearest(asked, _indexed(spark, sf_dir), DEFAULT.top_k_fetch)).join(_with_terms(asked), "query_id")
    return search.rerank(hits.join(search.with_normal_text(_indexed(spark, sf_dir).drop("embedding")), "chunk_id"), profile=_PROFILE)


_STOP = "[" + ", ".join(_quoted(w) for w in DEMO.stopwords) + "]"
_SQL_ASKED = "(SELECT e.vec_id AS query_id, coalesce(d.text, '') AS question, {0} AS schemes, embedding AS q FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 20 = 0)"
_SQL_RULE = "CASE e.vec_id % 60 WHEN 20 THEN ['de', 'fr'] WHEN 40 THEN ['en'] ELSE []::VARCHAR[] END"
_SQL_INDEX = "(SELECT d.doc_id, d.doc_id::VARCHAR AS chunk_id, lang AS scheme, embedding AS e, text, source FROM documents d JOIN embeddings ON vec_id = doc_id)"


def _sql_near(filtered: bool, n: int) -> str:
    asked = "SELECT query_id, q, 0 AS window_id, NULL::VARCHAR[] AS seen FROM a" if not filtered else (
        "SELECT query_id, q, 0 AS window_id, NULL::VARCHAR[] AS seen FROM a WHERE len(schemes) = 0 UNION ALL SELECT query_id, q, unnest(range(len(schemes))) AS window_id, [unnest(schemes), 'es'] AS seen FROM a WHERE len(schemes) > 0 UNION ALL SELECT query_id, q, len(schemes), ['es'] FROM a WHERE len(schemes) > 0"
    )
    source = _SQL_ASKED.format(_SQL_RULE if filtered else "[]::VARCHAR[]")
    return f"""a AS (SELECT * FROM {source}), w AS ({asked}), c AS (SELECT * FROM {_SQL_INDEX}),
    near AS (SELECT query_id, window_id::INT AS window_id, chunk_id, sim AS similarity FROM (SELECT query_id, window_id, chunk_id, list_cosine_similarity(e::DOUBLE[], q::DOUBLE[]) AS sim FROM w JOIN c ON seen IS NULL OR list_contains(seen, c.scheme)) QUALIFY row_number() OVER (PARTITION BY query_id, window_id ORDER BY sim DESC, chunk_id) <= {n}),
    merged AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY window_id) = 1)"""


_SQL_STRIPPED = "list_distinct(flatten(list_transform(schemes, lambda s: " + _SQL_TOKENS.format("s") + ")))"
_SQL_SCORED = f"""terms AS MATERIALIZED (SELECT query_id, schemes, list_filter(list_distinct(found), lambda x: length(x) > 1 AND NOT list_contains(no, x)) AS terms FROM (SELECT query_id, schemes, {_SQL_TOKENS.format('question')} AS found, list_concat({_STOP}, {_SQL_STRIPPED}) AS no FROM a)),
    words AS MATERIALIZED (SELECT chunk_id, list_distinct({_SQL_TOKENS.format('text')}) AS found, list_distinct({_SQL_TOKENS.format("'https://' || source || '.example.com/thing page of ' || source")}) AS about, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS normal, length(text) AS n_chars FROM c),
    hit AS (SELECT m.*, scheme, text, schemes, terms, list_intersect(terms, words.found) AS matched, len(list_filter(schemes, lambda s: contains(normal, ' ' || s || ' '))) > 0 AS named, len(list_intersect(terms, about)) > 0 AS subject, n_chars FROM merged m JOIN terms USING (query_id) JOIN c USING (chunk_id) JOIN words USING (chunk_id)),
    scored AS (SELECT *, similarity + 0.35 * CASE WHEN len(terms) > 0 THEN len(matched)::DOUBLE / len(terms) ELSE 0 END + CASE WHEN named AND subject AND scheme = 'es' THEN 0.4 ELSE 0 END AS score FROM hit),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, similarity DESC, window_id, chunk_id) AS rank, max(similarity) OVER (PARTITION BY query_id) AS best FROM scored)"""

query("vector_norms", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")(
    lambda spark, sf_dir: _table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"))
)
query("vector_unit", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 5) AS total FROM embeddings")(
    lambda spark, sf_dir: _table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(vectors.unit(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))
)
query("embed_hash")(lambda spark, sf_dir: embed.embed(_table(spark, sf_dir, "documents").select("doc_id", "text"), embed.HashingEmbedder(64)).select("doc_id", F.round(vectors.norm(F.col("embedding")), 4).alias("norm"), F.md5(F.array_join(F.col("embedding").cast("array<string>"), " ")).alias("digest")))
_SQL_BUDGET = "floor_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS block_no, sum(length(text) + 200) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ranked WHERE similarity >= 0.4)"


def _searches(suffix: str) -> None:
    """The search queries over one set of questions."""
    query("vector_topk_cosine" + suffix, f"WITH {_sql_near(False, 10)} SELECT query_id, chunk_id, round(similarity, 6) AS similarity FROM near")(lambda spark, sf_dir: _found(spark, sf_dir, False, 10).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity")))
    query("vector_topk_filtered" + suffix, f"WITH {_sql_near(True, 10)} SELECT query_id, window_id, chunk_id, round(similarity, 6) AS similarity FROM near")(
        lambda spark, sf_dir: _found(spark, sf_dir, True, 10).select("query_id", "window_id", "chunk_id", F.round("similarity", 6).alias("similarity"))
    )
    query("vector_window_merge" + suffix, f"WITH {_sql_near(True, 10)} SELECT query_id, window_id, chunk_id FROM merged")(lambda spark, sf_dir: search.merged(_found(spark, sf_dir, True, 10)).select("query_id", "window_id", "chunk_id"))
    query("hybrid_rerank_topk" + suffix, f"WITH {_sql_near(False, 60)}, {_SQL_SCORED} SELECT query_id, rank::INT AS rank, chunk_id, round(similarity, 6) AS similarity, round(score, 6) AS score, len(matched)::INT AS n_matched, round(best, 6) AS best_similarity FROM ranked WHERE rank <= 6")(
        lambda spark, sf_dir: search.cover(_ranked(spark, sf_dir, False)).select("query_id", "rank", "chunk_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), F.size("matched_terms").alias("n_matched"), F.round("best_similarity", 6).alias("best_similarity"))
    )
    query(
        "scheme_cover_topk" + suffix,
        f"WITH {_sql_near(True, 60)}, {_SQL_SCORED}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, scheme, rank > 6 ORDER BY rank) AS place FROM ranked) SELECT query_id, rank::INT AS rank, chunk_id, scheme FROM p WHERE rank <= 6 OR (len(schemes) >= 2 AND list_contains(schemes, scheme) AND place = 1)",
    )(lambda spark, sf_dir: search.cover(_ranked(spark, sf_dir, True)).select("query_id", "rank", "chunk_id", "scheme"))
    query("similarity_floor" + suffix, f"WITH {_sql_near(True, 60)}, {_SQL_SCORED} SELECT query_id, chunk_id FROM ranked WHERE similarity >= 0.4")(lambda spark, sf_dir: search.above_floor(_ranked(spark, sf_dir, True)).select("query_id", "chunk_id"))
    query("usable_context" + suffix, f"WITH {_sql_near(True, 60)}, {_SQL_SCORED} SELECT query_id, max(best) >= 0.4 AS usable, bool_or(len(matched) > 0) AS any_keyword_hit FROM ranked GROUP BY query_id")(lambda spark, sf_dir: search.has_usable_context(_ranked(spark, sf_dir, True)))
    query("context_budget" + suffix, f"WITH {_sql_near(False, 60)}, {_SQL_SCORED}, {_SQL_BUDGET} SELECT query_id, block_no::INT AS block_no, chunk_id, used::BIGINT AS used_chars FROM floor_ WHERE used <= 9000 OR block_no = 1")(
        lambda spark, sf_dir: answer.within_budget(_ranked(spark, sf_dir, False)).select("query_id", "block_no", "chunk_id", "used_chars")
    )
    query("citation_pick" + suffix, f"WITH {_sql_near(False, 60)}, {_SQL_SCORED} SELECT query_id, arg_min('https://' || source || '.example.com/thing', rank) AS citation FROM ranked JOIN (SELECT chunk_id, source FROM {_SQL_INDEX}) USING (chunk_id) WHERE similarity >= 0.4 GROUP BY query_id")(
        lambda spark, sf_dir: answer.pick_citation(_ranked(spark, sf_dir, False)).select("query_id", "citation")
    )


def _of_index(n: int, whole: bool) -> Query:
    """An index of all vectors, asked for every vector whose id is divisible by 20."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
        built = index.VectorIndex.build(rows, shared_folder(spark, "vector_index"), n=n)
        asked = _table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
        return built.nearest(asked, n, probes=index.MOST_CELLS if whole else 0).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"))

    return run


query("vector_index_every20")(_of_index(10, whole=False))  # approximate: tests measure its recall
query(
    "vector_index_whole_every20",
    "SELECT query_id, chunk_id, round(similarity, 6) AS similarity FROM (SELECT q.vec_id AS query_id, e.vec_id::VARCHAR AS chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) <= 10",
)(_of_index(10, whole=True))

@query("hybrid_postings_topk", f"WITH {_sql_near(False, 60)}, {_SQL_SCORED} SELECT query_id, rank::INT AS rank, chunk_id, round(similarity, 6) AS similarity, round(score, 6) AS score, array_to_string(list_sort(matched), ' ') AS matched FROM ranked WHERE rank <= 6")
def hybrid_postings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-ranking from written postings."""
    path, chunks, asked = shared_folder(spark, "postings"), _indexed(spark, sf_dir), _asked(spark, sf_dir, False)
    postings.write_postings(chunks, path, names=("de", "en", "es", "fr"))
    found = search.merged(search.nearest(asked, chunks, DEFAULT.top_k_fetch)).join(_with_terms(asked), "query_id")
    ranked = postings.rerank_stored(spark, found, path, profile=_PROFILE)
    return search.cover(ranked).select("query_id", "rank", "chunk_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), F.array_join(F.array_sort("matched_terms"), " ").alias("matched"))


query(
    "running_totals",
    "SELECT doc_id, (row_number() OVER (ORDER BY source, doc_id) - 1)::BIGINT AS rows_before, (sum(length(text)) OVER (ORDER BY source, doc_id) - length(text))::BIGINT AS chars_before FROM documents",
)(
    lambda spark, sf_dir: running.running_sums(_table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n")), {"rows_before": F.lit(1), "chars_before": F.col("n")}, ("source", "doc_id"), range_rows=1 << 16).select("doc_id", "rows_before", "chars_before")
)

_searches("")
_searches("_every20")  # the names of round 2

# ---- routing ----------------------------------------------------------------------------------------------

_SQL_PII = r"""CASE WHEN regexp_matches(%s, '(^|[^A-Za-z0-9])[A-Z]{5}[0-9]{4}[A-Z]([^A-Za-z0-9]|$)') THEN 'pan' WHEN regexp_matches(%s, '(^|[^0-9])\d{4}[\s-]?\d{4}[\s-]?\d{4}([^0-9]|$)') THEN 'aadhaar'
 WHEN regexp_matches(%s, '\b[A-Za-z0-9._%%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b') THEN 'email' WHEN regexp_matches(%s, '(^|[^0-9.])(\+?91[\s-]?)?[6-9]\d{9}([^0-9.]|$)') THEN 'phone'
 WHEN regexp_matches(%s, '(?i)\b(a/?c|acc(ount)?|folio|bank)\s*(no|number|#)?\s*[:-]?\s*(\d[\s-]?){9,18}\b') THEN 'account' WHEN regexp_matches(%s, '(?i)\b(otp|one[\s-]time\s+(password|code)|verification\s+code)\b[^0-9]{0,12}\d{4,8}\b') THEN 'otp' END"""
_pii_sql = lambda column: _SQL_PII % ((column,) * 6)
_match = lambda column, pattern: f"regexp_matches({column}, {_quoted('(?i)(' + pattern + ')')})"
_in_question = lambda pattern: _match("question", pattern)
query("pii_label", f"SELECT doc_id, {_pii_sql('text')} AS pii FROM documents")(_of_texts(lambda t: {"pii": routing.detect_pii(t)}))
query("pii_redact", f"SELECT doc_id, md5(CASE WHEN pii IS NOT NULL THEN '[withheld: ' || pii || ']' ELSE text END) AS digest FROM (SELECT doc_id, text, {_pii_sql('text')} AS pii FROM documents)")(_of_texts(lambda t: {"digest": F.md5(routing.redact(t))}))
# written out here, not taken from the engine
_SQL_ADVISORY = (
    " (should|ought) (i|we|you|my) | (can|could) (i|we) (buy|sell|invest|redeem|switch|purchase) | (is|are) (it|this|that|they|these|those) ([a-z0-9]+ )?(good|worth|safe|wise|better) "
    "| (good|worth|safe|wise|better|best|right) ([a-z0-9]+ )?for (me|us|my|our) | best (me|us|my|our) | which (one|should) | worth (it|buying|investing) | makes? sense | (recommend|suitab)[a-z0-9]* "
    "| advise (me|us) | help (me|us) (choose|pick|decide) | (opinions?|views?) (on|about) "
)
_SQL_PERFORMANCE = (
    " (best|top|highest|strongest|worst|lowest|better|most) ([a-z0-9]+ )?(perform[a-z0-9]*|return[a-z0-9]*|growth) | perform[a-z0-9]* ([a-z0-9]+ )?(best|better|worse|worst|well|poorly) | outperform[a-z0-9]* "
    "| compare ([a-z0-9]+ )?(perform[a-z0-9]*|return[a-z0-9]*|growth|nav|funds?) | (return[a-z0-9]*|cagr) (of|for) ([a-z0-9]+ ){0,6}(vs|versus|and) | (return[a-z0-9]*|performance) ([a-z0-9]+ ){0,4}(last|past|previous) "
    "| which (funds?|schemes?) (gave|has|had|performed|returned) | how much (did|has|have) ([a-z0-9]+ ){0,12}(return[a-z0-9]*|earn[a-z0-9]*|grow[a-z0-9]*|grew) "
)
_SQL_NORMAL = "' ' || trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) || ' '"
query(
    "route_category",
    f"SELECT query_id, CASE WHEN trim(question) = '' THEN 'off_topic' WHEN {_pii_sql('question')} IS NOT NULL THEN 'pii' WHEN regexp_matches({_SQL_NORMAL}, '{_SQL_ADVISORY}') THEN 'advisory' WHEN regexp_matches({_SQL_NORMAL}, '{_SQL_PERFORMANCE}') THEN 'performance' WHEN {_match('question', routing.OFF_TOPIC)} AND NOT {_match('question', routing.FUND_WORDS)} THEN 'off_topic' ELSE 'factual' END AS category FROM {_SQL_QUESTIONS}",
)(lambda spark, sf_dir: _questions(spark, sf_dir).select("query_id", routing.classify(F.col("question")).alias("category")))
query("topic_gate", f"SELECT query_id, {_match('question', routing.TOPICS)} AS supported FROM {_SQL_QUESTIONS}")(lambda spark, sf_dir: _questions(spark, sf_dir).select("query_id", routing.names_supported_topic(F.col("question")).alias("supported")))
query("refusal_lookup")(lambda spark, sf_dir: _questions(spark, sf_dir).select("query_id", routing.refusal(routing.classify(F.col("question"))).alias("message")).filter("message is not null"))
# the schemes of the profile, by their names, longest pattern first
_SQL_SCHEMES = """list_filter([CASE WHEN regexp_matches(question, '(?i)\\b(acorn[\\s-]+)?multi[\\s-]*asset\\b') THEN 'Acorn Multi Asset Fund' END, CASE WHEN regexp_matches(question, '(?i)\\b(acorn[\\s-]+)?arbitrage\\b') THEN 'Acorn Arbitrage Fund' END,
    CASE WHEN regexp_matches(question, '(?i)\\bacorn[\\s-]+infrastructure\\b') THEN 'Acorn Infrastructure Fund' END, CASE WHEN regexp_matches(question, '(?i)\\bacorn[\\s-]+overnight\\b') THEN 'Acorn Overnight Fund' END,
    CASE WHEN regexp_matches(question, '(?i)\\bacorn[\\s-]+gilt\\b') THEN 'Acorn Gilt Fund' END], lambda x: x IS NOT NULL)"""
query("scheme_detect", f"SELECT query_id, array_to_string(s, ' + ') AS schemes, s[1] AS first FROM (SELECT query_id, {_SQL_SCHEMES} AS s FROM {_SQL_QUESTIONS})")(
    lambda spark, sf_dir: _questions(spark, sf_dir).select("query_id", F.array_join(routing.detect_schemes(F.col("question")), " + ").alias("schemes"), routing.detect_scheme(F.col("question")).alias("first"))
)
query(
    "scheme_probable",
    f"""SELECT query_id, CASE WHEN regexp_matches(q, '\\bmulti[\\s-]*asset\\b') THEN 'Acorn Multi Asset Fund' WHEN regexp_matches(q, '\\binfrastructure\\b') THEN 'Acorn Infrastructure Fund' WHEN regexp_matches(q, '\\barbitrage\\b') THEN 'Acorn Arbitrage Fund'
    WHEN regexp_matches(q, '\\bovernight\\b') THEN 'Acorn Overnight Fund' WHEN regexp_matches(q, '\\bgilt\\b') THEN 'Acorn Gilt Fund' END AS scheme FROM (SELECT query_id, lower(question) AS q FROM {_SQL_QUESTIONS})""",
)(lambda spark, sf_dir: _questions(spark, sf_dir).select("query_id", routing.probable_scheme(F.col("question")).alias("scheme")))

# ---- answers ----------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str, turns: bool = False) -> DataFrame:
    """Literal answers, and with ``turns`` all turns of assistants; their context is as many turns before as the memory holds."""
    literal = spark.createDataFrame(ANSWERS, "answer_id long, answer string, context string")
    if not turns:
        return literal
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-DEFAULT.memory_max_messages, -1)
    said = _table(spark, sf_dir, "conversations").withColumn("context", F.array_join(F.collect_list("text").over(before), "\n")).filter("role = 'assistant'")
    return literal.unionByName(said.select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("answer_id"), F.col("text").alias("answer"), "context"))


_SQL_TURNS = f"""(SELECT * FROM {_values(ANSWERS, 'answer_id, answer, context')} UNION ALL SELECT conv_id * 1000 + turn + 1000, text, coalesce(context, '') FROM
    (SELECT *, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {DEFAULT.memory_max_messages} PRECEDING AND 1 PRECEDING) AS context FROM conversations) WHERE role = 'assistant')"""


query("url_count", rf"SELECT doc_id, len(regexp_extract_all(text, {_quoted(contract.URL)}))::INT AS n_urls FROM documents")(_of_texts(lambda t: {"n_urls": contract.count_urls(t)}))
query("contract_sentences")(_of_texts(lambda t: {"n_sentences": contract.count_sentences(t)}))

def _contract(suffix: str, turns: bool, source: str) -> None:
    """The queries of the answer contract over one set of answers."""
    query("decline_flag" + suffix, f"SELECT answer_id, regexp_matches(answer, {_quoted(contract.DECLINE)}) AS declined FROM {source}")(lambda spark, sf_dir: _answers(spark, sf_dir, turns).select("answer_id", contract.is_decline(F.col("answer")).alias("declined")))
    query("advice_flag" + suffix, f"SELECT answer_id, nullif(regexp_extract(answer, {_quoted(contract.ADVICE_GIVEN)}), '') AS advice FROM {source}")(lambda spark, sf_dir: _answers(spark, sf_dir, turns).select("answer_id", contract.find_advice(F.col("answer")).alias("advice")))
    query(
        "ungrounded_figures" + suffix,
        rf"SELECT answer_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(answer), '(\d[\d,]*(\.\d+)?)\s*(%|(per cent|percent|bps|rs|rupees|inr|lakhs?|crores?|years?|months?|days?|units?)\b)', 1)), lambda x: NOT list_contains(regexp_extract_all(replace(lower(context), ',', ''), '(\d+(\.\d+)?)', 1), replace(x, ',', '')))), ' ') AS figures FROM {source}",
    )(lambda spark, sf_dir: _answers(spark, sf_dir, turns).select("answer_id", F.array_join(F.array_sort(contract.ungrounded_figures(F.col("answer"), F.col("context"))), " ").alias("figures")))


_contract("", True, _SQL_TURNS)
_contract("_turns", True, _SQL_TURNS)  # the names of round 2
query("verify_answer")(lambda spark, sf_dir: _answers(spark, sf_dir, turns=True).select("answer_id", contract.verify(F.col("answer"), F.lit("https://www.example.com/a"), F.lit("2024-05-01"), F.col("context")).alias("v")).select("answer_id", "v.ok", "v.answer", F.array_join("v.problems", "; ").alias("problems"), "v.citation"))

# ---- memory -----------------------------------------------------------------------------------------------

_SQL_STORED = f"(SELECT conv_id, turn, role, trim(text) AS text FROM conversations WHERE trim(text) <> '' AND {_pii_sql('text')} IS NULL)"
query("memory_buffer", f"SELECT conv_id, turn, role, md5(text) AS digest FROM {_SQL_STORED} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10")(
    lambda spark, sf_dir: memory.buffer(_table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.md5("text").alias("digest"))
)
query(
    "memory_referent",
    f"""SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN named END IGNORE NULLS) OVER w, last_value(named IGNORE NULLS) OVER w) AS referent FROM (SELECT *, nullif(regexp_extract(text, '[A-Z][a-z]*ing\\b'), '') AS named FROM {_SQL_STORED}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
)(lambda spark, sf_dir: memory.with_referent(_table(spark, sf_dir, "conversations"), scheme=F.expr("nullif(regexp_extract(text, '[A-Z][a-z]*ing\\\\b', 0), '')")).select("conv_id", "turn", "referent"))
query("memory_transcript", f"WITH b AS (SELECT * FROM {_SQL_STORED} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10) SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM b GROUP BY conv_id")(
    lambda spark, sf_dir: memory.transcript(_table(spark, sf_dir, "conversations")).select("conv_id", F.md5("transcript").alias("digest"))
)
query("followup_rewrite")(
    lambda spark, sf_dir: _questions(spark, sf_dir).select("query_id", followup.resolve(F.col("question"), F.lit("Acorn Multi Asset Fund")).alias("r")).select("query_id", "r.*")
)

@query("dialogue_rounds")
def dialogue_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns in rounds; answers are made by a rule, so that only the rounds and the memory are under test."""
    turns = _table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")

    def told(asked: DataFrame) -> DataFrame:
        category = routing.classify(F.col("question"))
        return asked.select("query_id", category.alias("category"), F.when(category == "factual", "answered").otherwise("refused").alias("outcome"), F.concat(F.lit("You asked: "), routing.redact(F.col("question"))).alias("answer"), F.lit(None).cast("string").alias("citation"))

    found = dialogue.converse(turns, told, shared_folder(spark, "dialogue"))
    return found.select("conv_id", "turn", "category", "outcome", "inherited", F.md5("resolved").alias("digest"), F.col("round").alias("place"))


# ---- cache and orchestration ------------------------------------------------------------------------------

_key = lambda question: cache.request_key(F.lit("m"), F.lit("s"), question, F.lit(0.5), F.lit(64))
_SQL_KEY = r"""sha256('{"max_tokens":64,"model":"m","system":"s","temperature":0.5,"user":' || to_json(source) || ',"v":1}')"""
query("cache_key", f"SELECT doc_id, {_SQL_KEY} AS key FROM documents")(lambda spark, sf_dir: _table(spark, sf_dir, "documents").select("doc_id", _key(F.col("source")).alias("key")))
query("cache_lookup", f"WITH r AS (SELECT doc_id, {_SQL_KEY} AS key, source FROM documents), c AS (SELECT DISTINCT key, source AS text FROM r WHERE source LIKE '%1%') SELECT doc_id, c.text AS cached_text FROM r LEFT JOIN c USING (key)")(
    lambda spark, sf_dir: (
        lambda r: cache.lookup(r, r.filter("source like '%1%'").select("key", F.col("source").alias("text"), F.lit("m").alias("model")).unionByName(r.filter("source not like '%1%'").select("key", F.lit(" ").alias("text"), F.lit("m").alias("model")))).select("doc_id", "cached_text")
    )(_table(spark, sf_dir, "documents").select("doc_id", "source", _key(F.col("source")).alias("key")))
)


@query("ask_batch")
def ask_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about documents, through all stages."""
    documents = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit("All schemes").alias("scheme"), F.concat(F.lit("https://"), "source", F.lit(".example.com/")).alias("source_url"), F.lit("page").alias("page_title"), F.lit("2024-05-01").alias("fetched_at"), "text")
    embedder = embed.HashingEmbedder(64)
    asked = embed.embed(_questions(spark, sf_dir), embedder, "question")
    return answer.ask(asked, embed.embed(documents, embedder)).select("query_id", "category", "outcome", "answer", "citation")
