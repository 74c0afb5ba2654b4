"""URL filters: a weighted vocabulary over a table of host rules.

One Aho-Corasick automaton holds all strict and soft terms and reads every url once. A hit counts where
neither neighbour is a letter or digit. A strict term weighs as much as ``SOFT_LIMIT`` soft ones: one of
them, or so many distinct soft terms, reject a url that no host rule has decided. The vocabulary and the
rules are parameters (``read_terms`` reads a vocabulary from a file); each worker builds its automaton once.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule, and is judged by the
vocabulary alone (null: allow). Repeated rows are judged alike; a url of any length is read whole. Columns
named n_strict or n_soft are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.shipping import ship

# The vocabulary and the host rules (verdict, host, path).
STRICT_TERMS = ("porn", "xxx", "casino", "viagra", "cialis", "escort", "hentai", "malware", "phishing", "warez", "cheap-pills", "spam-farm", "link-farm", "torrent")
SOFT_TERMS = ("adult", "bet", "bonus", "cheap", "click", "dating", "deal", "free", "jackpot", "loan", "lottery", "pills", "poker", "prize", "promo", "replica", "sex", "spam", "win")
SOFT_LIMIT = 2
MOST_TERMS = 1_000_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def _bounded(text: str, end: int, length: int) -> bool:
    start = end - length + 1
    left = text[start - 1] if start else "/"
    right = text[end + 1] if end + 1 < len(text) else "/"
    return not (left.isascii() and left.isalnum()) and not (right.isascii() and right.isalnum())


_built: dict[tuple, ahocorasick.Automaton] = {}


def automaton(strict=STRICT_TERMS, soft=SOFT_TERMS):
    """The automaton of a vocabulary, built once in a worker."""
    key = (tuple(strict), tuple(soft))
    if key not in _built:
        found = ahocorasick.Automaton()
        for i, term in enumerate((*strict, *soft)):
            found.add_word(term, (i, len(term), i < len(strict)))
        found.make_automaton()
        _built.clear()
        _built[key] = found
    return _built[key]


def read_terms(spark: SparkSession, path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict, soft) terms of a file with a term and its weight, strict or soft, in each line; # begins a
    comment. A vocabulary may have ``MOST_TERMS``."""
    lines = [r.value.split("#")[0].split() for r in spark.read.text(path).limit(MOST_TERMS + 1).collect()]
    words = [x for x in lines if x]
    if len(lines) > MOST_TERMS or any(len(x) != 2 or x[1] not in ("strict", "soft") for x in words):
        raise ValueError(f"not a vocabulary: {path}")
    return tuple(x[0].translate(_LOWER) for x in words if x[1] == "strict"), tuple(x[0].translate(_LOWER) for x in words if x[1] == "soft")


def count_terms(found, url: str | None) -> tuple[int, int]:
    """Distinct strict and soft terms of a url (ASCII letters in either case)."""
    text = (url or "").translate(_LOWER)
    hits = {(i, is_strict) for end, (i, length, is_strict) in found.iter(text) if _bounded(text, end, length)}
    strict = sum(is_strict for _, is_strict in hits)
    return strict, len(hits) - strict


def with_term_counts(pages: DataFrame, url: str, strict=STRICT_TERMS, soft=SOFT_TERMS) -> DataFrame:
    """pages with n_strict and n_soft."""
    if len(strict) + len(soft) > MOST_TERMS:
        raise ValueError(f"a vocabulary may have {MOST_TERMS} terms")
    pages = pages.drop("n_strict", "n_soft")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(strict, soft)
        for batch in batches:
            counts = [count_terms(found, u) for u in batch.column(batch.schema.names.index(url)).to_pylist()]
            columns = [*batch.columns, pa.array([a for a, _ in counts], pa.int32()), pa.array([b for _, b in counts], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_strict", "n_soft"])

    ship(pages.sparkSession)
    out = pages.withColumn("n_strict", F.lit(0)).withColumn("n_soft", F.lit(0)).schema
    return pages.mapInArrow(run, out)


def judge(pages: DataFrame, rules=RULES, soft_limit: int = SOFT_LIMIT, strict=STRICT_TERMS, soft=SOFT_TERMS) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft for every row."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    parts = with_term_counts(pages.select("page_id", "url"), "url", strict, soft).withColumn("rest", F.coalesce(rest, F.lit("")))
    host = F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)
    parts = parts.withColumn("host", host).withColumn("path", path)
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p)) for _, h, p in longest]
    rule = F.coalesce(*[F.when(fit, F.lit(h + p)) for fit, (_, h, p) in zip(fits, longest, strict=True)])
    ruled = F.coalesce(*[F.when(fit, F.lit(v)) for fit, (v, _, _) in zip(fits, longest, strict=True)])
    own = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit), F.lit("block")).otherwise("allow")
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"), "n_strict", "n_soft")


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages)


def _term_sql(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::INT"


ORACLE = f"""
WITH p AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         ({" + ".join(map(_term_sql, STRICT_TERMS))})::INT AS n_strict,
         ({" + ".join(map(_term_sql, SOFT_TERMS))})::INT AS n_soft
  FROM p),
rules(verdict, h, rp) AS (VALUES {", ".join(str(r) for r in RULES)}),
best AS (
  SELECT q.page_id, q.host, q.path, max_by(h || rp, length(h || rp)) AS rule, max_by(rules.verdict, length(h || rp)) AS ruled
  FROM q JOIN rules ON (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, rp)
  GROUP BY q.page_id, q.host, q.path)
SELECT q.page_id, q.host, q.path, best.rule,
       coalesce(best.ruled, CASE WHEN n_strict >= 1 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
FROM q LEFT JOIN best ON q.page_id = best.page_id AND q.host = best.host AND q.path = best.path
"""
