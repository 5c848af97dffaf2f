"""URL filter: host rules first, then a logistic regression on hashed character n-grams of host and path.

Rules name a host and a path; a rule fits its host and all subdomains if the path starts with the rule's, and of the rules
that fit the longest decides.  Where none fits, the model does: n-grams of 3 to 5 bytes of host and path are hashed to
``BUCKETS`` features, each weighed by 1 / sqrt(number of n-grams); a probability of one half or more blocks.  The model
is trained by Newton-type steps on a small labelled URL table (a parameter; ``labelled_urls`` makes the default from word lists).

Defined cases: null, or no ``://``: host and path are empty, no rule fits, the model sees nothing and its intercept decides (allow);
repeated rows are judged one by one; an empty table gives no rows; other columns stay, but for those that ``judge`` names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.llm.common import bounded_batches, mix64, table

BUCKETS, GRAMS = 1 << 14, (3, 4, 5)

#: (action, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

_UNWANTED = "casino poker bets betting win jackpot slots pills cheap viagra pharma adult xxx sex porn cam dating spam farm ads track tracker popup click loans payday free prize lottery crypto double replica watches keygen crack warez torrent".split()
_WANTED = "news blog library museum university school science history garden recipes weather travel music city council research journal archive docs wiki forum photo art health sport market review story letters book paper cloud studio local valley river mountain".split()
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve tion ble ing ly".split()
_LANGUAGES = "en de fr es".split()


def labelled_urls(seed: int = 11, each: int = 150) -> list[tuple[str, int]]:
    """A small labelled URL table by rule: unwanted hosts are pairs of unwanted words, wanted ones wanted words or made-up names."""
    rng = np.random.default_rng(seed)
    pick = lambda words, n: [words[int(k)] for k in rng.integers(0, len(words), n)]
    tails = ["", ".html", "/", "?page=2", "#top"]
    rows = []
    for k in range(each):
        end, n = ["com", "org", "net"][k % 3], int(rng.integers(1, 60_000))
        path = f"/{pick(_LANGUAGES, 1)[0]}/{n}{tails[k % 5]}"
        front = ["", "www.", "blog.", "m."][k % 4]
        rows.append((f"https://{front}{'-'.join(pick(_UNWANTED, 2))}.example.{end}{path}", 1))
        name = "-".join(pick(_WANTED, 2)) if k % 3 == 0 else "".join(pick(_SYLLABLES, 2 + k % 3))
        rows.append((f"http://{front}{name}.example.{end}{path}", 0))
        rows.append((f"https://{'.'.join([*pick(_SYLLABLES, k % 2), ''.join(pick(_SYLLABLES, 3))])}.{end}{path}", 0))
    return rows


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) columns."""
    pattern = "^(?s:.*?)://([^/?#]*)([^?#]*)"
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.coalesce(url, F.lit(""))
    return fold(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; null where none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # longer ones wrap shorter ones
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of all n-grams of the texts."""
    rows, buckets, totals = [], [], np.zeros(len(texts))
    for k, t in enumerate(texts):
        raw = np.frombuffer(("^" + t + "$").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint64) if t else np.zeros(0, dtype=np.uint64)
        for n in GRAMS:
            if len(raw) >= n:
                code = np.full(len(raw) - n + 1, n, dtype=np.uint64)
                for j in range(n):
                    code = code << np.uint64(8) | raw[j : len(raw) - n + 1 + j]
                found = (mix64(code) % np.uint64(BUCKETS)).astype(np.int64)
                buckets.append(found)
                rows.append(np.full(len(found), k))
                totals[k] += len(found)
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    row = np.concatenate(rows)
    return row, np.concatenate(buckets), 1 / np.sqrt(totals[row])


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def probability(self, texts: list[str]) -> np.ndarray:
        row, bucket, value = features(texts)
        z = np.bincount(row, self.weights[bucket] * value, minlength=len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _text(url: str) -> str:
    rest = url.split("://", 1)[1]
    cut = min([len(rest), *(rest.find(c) for c in "?#" if c in rest)])
    head, slash, tail = rest[:cut].partition("/")
    return head.lower() + slash + tail


def train(rows: list[tuple[str, int]], steps: int = 400, rate: float = 0.5, ridge: float = 1e-4) -> Model:
    """Logistic regression by full-batch steps with per-feature rates; unseen features keep weight 0."""
    texts, y = [_text(u) for u, _ in rows], np.array([float(v) for _, v in rows])
    row, bucket, value = features(texts)
    w, b, scale, scale_b = np.zeros(BUCKETS), -1.0, np.full(BUCKETS, 1e-6), 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[bucket] * value, minlength=len(y)) + b, -40, 40)))
        error = (p - y) / len(y)
        gradient = np.bincount(bucket, error[row] * value, minlength=BUCKETS) + ridge * w
        scale += gradient**2
        w -= rate * gradient / np.sqrt(scale)
        scale_b += error.sum() ** 2
        b -= 0.1 * error.sum() / np.sqrt(scale_b)
    return Model(w, min(b, -0.1))  # with nothing to see, allow


@lru_cache(maxsize=4)
def default_model() -> Model:
    return train(labelled_urls())


def judge(pages: DataFrame, url: str = "url", rules=RULES, model: Model | None = None) -> DataFrame:
    """All columns of ``pages`` and host, path, rule, score (of the model), verdict, which take the place of columns of those names."""
    shared = pages.sparkSession.sparkContext.broadcast((lambda m: (m.weights, m.intercept))(model or default_model()))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(Model(*shared.value).probability(text.tolist()))

    host, path = parts(F.col(url))
    found = pages.withColumns({"host": host, "path": path})
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    found = found.withColumns({"rule": rule, "__action": action, "score": score(F.concat("host", "path"))})
    return found.withColumn("verdict", F.coalesce("__action", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))).drop("__action")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
