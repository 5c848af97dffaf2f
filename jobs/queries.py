"""The jobs as queries: each runs twice over the whole table into one new folder under the shared one, and returns what stands there after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.corpus_refresh import refresh
from jobs.turn_audit import audit


def new_folder(spark: SparkSession, name: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "/tmp/groundspark-jobs"  # one machine only
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_corpus_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = new_folder(spark, "job1")
    for _ in range(2):
        chunks = refresh(spark, f"{sf_dir}/documents.parquet", output)
    return chunks.select("doc_id", "pos", "scheme", "n_words", "pii", F.md5("text").alias("digest"))


def job2_turn_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = new_folder(spark, "job2")
    for _ in range(2):
        turns = audit(spark, f"{sf_dir}/conversations.parquet", output)
    return turns.select("conv_id", "turn", "role", "pii", "n_words", "n_figures", "declined", "advice", F.md5("text").alias("digest"))


_WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t\n\r\f\x0b]+'), lambda x: x <> '')"
_PII = r"""CASE WHEN regexp_matches({0}, '(^|[^A-Za-z0-9])[A-Z]{{5}}[0-9]{{4}}[A-Z]([^A-Za-z0-9]|$)') THEN 'pan' WHEN regexp_matches({0}, '(^|[^0-9])\d{{4}}[\s-]?\d{{4}}[\s-]?\d{{4}}([^0-9]|$)') THEN 'aadhaar'
 WHEN regexp_matches({0}, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b') THEN 'email' WHEN regexp_matches({0}, '(^|[^0-9.])(\+?91[\s-]?)?[6-9]\d{{9}}([^0-9.]|$)') THEN 'phone'
 WHEN regexp_matches({0}, '(?i)\b(a/?c|acc(ount)?|folio|bank)\s*(no|number|#)?\s*[:-]?\s*(\d[\s-]?){{9,18}}\b') THEN 'account' WHEN regexp_matches({0}, '(?i)\b(otp|one[\s-]time\s+(password|code)|verification\s+code)\b[^0-9]{{0,12}}\d{{4,8}}\b') THEN 'otp' END"""
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(translate(block, chr(160) || '–—', ' --'), '[\x{E000}-\x{F8FF}]', '', 'g'), '[ \t\x{200B}]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_FURNITURE = r"(?i)^(invest now|know more|click here|read more|view all|apply now|disclaimer|mutual fund investments are subject to market risks.*|join us|for distributor|english|hindi|skip to|contact us|\+?\d[\d\s\-()]{7,}|www\.[\w.]+|copyright.*|©.*)$"
_PLACEHOLDER = r"(?i)^(loading\.{0,3}|please wait\.{0,3}|let''?s connect\b.*|fill in the (below )?form.*|get a call (back )?from (one of )?our experts?.*|submit|search|menu|close|open|next|previous|back to top|skip to (main )?content)\s*$"
_WITHHELD = "md5(CASE WHEN pii IS NOT NULL THEN '[withheld: ' || pii || ']' ELSE {0} END)"

QUERIES = {"job1_corpus_refresh": job1_corpus_refresh, "job2_turn_audit": job2_turn_audit}
ORACLE_SQL = {
    "job1_corpus_refresh": f"""
WITH d AS (SELECT coalesce(text, '') AS text, min(doc_id) AS doc_id, arg_min(coalesce(lang, ''), doc_id) AS lang FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS block FROM d),
k AS (SELECT doc_id, string_agg(line, ' ' ORDER BY line_no) AS t FROM (SELECT doc_id, line_no, {_CLEAN} AS line FROM l) WHERE line <> '' AND NOT regexp_matches(line, '{_FURNITURE}') AND NOT regexp_matches(line, '{_PLACEHOLDER}') GROUP BY doc_id),
w AS (SELECT doc_id, {_WORDS.format('t')} AS w FROM k),
c AS (SELECT doc_id, (i // 160)::INT AS pos, array_to_string(w[i + 1 : i + 160], ' ') AS chunk, len(w[i + 1 : i + 160])::INT AS n_words FROM w, unnest(range(0, len(w), 160)) AS u(i)),
p AS (SELECT *, {_PII.format('chunk')} AS pii FROM c)
SELECT doc_id, pos, CASE WHEN trim(lang) = '' THEN 'unknown' ELSE lang END AS scheme, n_words, pii, {_WITHHELD.format('chunk')} AS digest FROM p JOIN d USING (doc_id)
""",
    "job2_turn_audit": rf"""
WITH t AS (SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE role END AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, {_PII.format('text')} AS pii FROM t)
SELECT conv_id, turn, role, pii, len({_WORDS.format('text')})::INT AS n_words,
  CASE WHEN role = 'assistant' THEN len(list_distinct(regexp_extract_all(lower(text), '(\d[\d,]*(\.\d+)?)\s*(%|(per cent|percent|bps|rs|rupees|inr|lakhs?|crores?|years?|months?|days?|units?)\b)', 1))) ELSE 0 END::INT AS n_figures,
  role = 'assistant' AND regexp_matches(split_part(text, 'Last updated from sources:', 1), '(?i)that information is not in|(provided|retrieved|given) (sources?|context|documents?) (do|does) not contain|not (available|mentioned|stated|specified|provided|found) in (the |any )?(\w+ )?(sources?|context|documents?)|does not contain (that|this|the answer)|do not have that information|cannot answer (that |this )?from the (sources?|context)') AS declined,
  CASE WHEN role = 'assistant' THEN nullif(regexp_extract(text, '(?i)\b(you (should|must|can consider|may consider|ought to)|(i|we) (recommend|suggest|advise)|good (for|choice|option|investment)|consider investing|should invest|good idea|best option for you)\b'), '') END AS advice,
  {_WITHHELD.format('text')} AS digest FROM p
""",
}
