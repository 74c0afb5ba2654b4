"""Secret scans with a trigram inverted index, in DataFrame operations alone.

From each rule's regex a Boolean query over trigrams is derived that every matching text must satisfy: an
OR of conjunctions. The index holds, for each trigram that occurs in some query, the rows whose lower-cased
text contains it; joining it with the (tiny, fixed) table of conjunctions and counting per row and
conjunction intersects the postings. Rules without mandatory trigrams scan every text. Regexes then run
over candidates only, on whole texts. Offsets follow from the lengths of matches and of what lies between
them, summed in order per row and rule.

Cases: a null text counts as empty and has no spans; a text of any length is scanned whole. Rows that repeat
are scanned each on their own (the row, not doc_id, is the key). Columns of docs stay, but for those named as
results. Overlapping spans of different kinds all stay; spans are ordered by start,
then by kind in the order listed. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import Rows, among, cut


@dataclass(frozen=True)
class Rule:
    """A match counts if its group ``group`` has at least ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The base rules, then those that the method adds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    Rule("url_login", r"[a-z]{3,10}://[^/\x20\x09-\x0D:@]+:[^/\x20\x09-\x0D:@]+@"),
)

_MOST = 64  # strings that an exact set may hold


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _both(left: set[frozenset], right: set[frozenset]) -> set[frozenset]:
    """Conjunction of two queries, each an OR of sets of trigrams."""
    if len(left) * len(right) > 4 * _MOST:
        return min(left, right, key=len)  # still implied
    return _least({a | b for a in left for b in right})


def _least(query: set[frozenset]) -> set[frozenset]:
    return {a for a in query if not any(b < a for b in query)}


def _class(items) -> set[str] | None:
    chars: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            chars.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < 4:
            chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return chars if len(chars) <= 8 else None


def _walk(items) -> tuple[set[str] | None, set[frozenset]]:
    """(all strings that the items can match, if few; query that holds for any match)."""
    query, now, exact = {frozenset()}, {""}, True

    def flush() -> None:
        nonlocal query, now, exact
        query, now, exact = _both(query, _least({_grams(s) for s in now})), {""}, False

    def extend(strings: set[str] | None, implied: set[frozenset]) -> None:
        nonlocal now, query
        if strings is not None and len(strings) * len(now) <= _MOST:
            now = {a + b for a in now for b in strings}
        elif strings is not None:
            flush()
            now = set(strings)
        else:
            flush()
            query = _both(query, implied)

    for op, value in items:
        if op is sre.LITERAL:
            extend({chr(value).lower()}, {frozenset()})
        elif op is sre.IN:
            extend(_class(value), {frozenset()})
        elif op is sre.SUBPATTERN:
            extend(*_walk(value[3]))
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in value[1]]
            if all(s is not None for s, _ in parts):
                extend(set().union(*(s for s, _ in parts)), {frozenset()})
            else:
                extend(None, _least(set().union(*({_grams(x) for x in s} if s is not None else q for s, q in parts))))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = value
            strings, implied = _walk(inner)
            if (low, high) == (0, 1) and strings is not None:
                extend(strings | {""}, {frozenset()})
            elif low and strings is not None and len(strings) ** low <= _MOST:
                for _ in range(low):
                    extend(strings, {frozenset()})
                if high != low:
                    flush()
            else:
                extend(None, implied if low else {frozenset()})
        elif op is not sre.AT:
            flush()
    if exact:
        return now, _least({_grams(s) for s in now})
    flush()
    return None, query


def trigram_query(regex: str) -> set[frozenset[str]]:
    """An OR of sets of lower-case trigrams, one of which any matching text (lower-cased) contains in
    full. A query with an empty set demands nothing: the rule must scan all texts."""
    _, query = _walk(parser.parse(regex, re.IGNORECASE))
    return {frozenset()} if frozenset() in query else query


def _candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rid and the indexes of the rules that its text may match, from the inverted index."""
    queries = [trigram_query(r.regex) for r in rules]
    needed = sorted({t for q in queries for c in q for t in c})
    place = {t: i for i, t in enumerate(needed)}
    conjunctions = [(k, n, place[t], len(c)) for k, q in enumerate(queries) if frozenset() not in q for n, c in enumerate(sorted(q, key=sorted)) for t in sorted(c)]
    if not conjunctions:
        return texts.select("rid", F.lit(0).alias("rule")).limit(0)
    held = texts.select("rid", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(needed)]))
    postings = held.select("rid", F.explode(found).alias("trigram"))
    table = texts.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(map(str, conjunctions))} AS t(rule, conjunction, trigram, need)")
    hits = postings.join(F.broadcast(table), "trigram").groupBy("rid", "rule", "conjunction").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    return hits.where(F.col("n") == F.col("need")).select("rid", "rule")


def _lengths(matches, least: int):
    """Of each match: length of the text before it since the last one, own length, and whether it counts."""
    return F.transform(
        matches,
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("size"), (F.length(x["counted"]) >= least).alias("counts")),
    )


def _matches(texts: DataFrame, rules: tuple[Rule, ...], chosen: list[int], asked) -> DataFrame:
    """rid, kind (of the chosen ones), pos, part: all matches in texts, in order, whether they count or not."""
    pieces = []
    for k in chosen:
        rule = rules[k]
        regex = F.lit(rule.regex)
        groups = F.regexp_extract_all("text", regex, F.lit(rule.group))
        whole = F.regexp_extract_all("text", regex, F.lit(0)) if rule.group else groups
        between = F.split("text", rule.regex, -1)
        parts = _lengths(F.arrays_zip(whole.alias("whole"), groups.alias("counted"), F.slice(between, F.lit(1), F.size(whole)).alias("gap")), rule.least)
        pieces.append(F.when(asked(k) & F.col("text").rlike(rule.regex), F.struct(F.lit(k).alias("kind"), parts.alias("parts"))))
    if not pieces:
        pieces = [F.lit(None).cast("struct<kind:int,parts:array<struct<gap:int,size:int,counts:boolean>>>")]
    found = texts.select("rid", F.explode(F.array_compact(F.array(*pieces))).alias("m"))
    return found.select("rid", "m.kind", F.posexplode("m.parts").alias("pos", "part"))


def spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> tuple[Rows, DataFrame]:
    """(keyed docs, table of rid, kind index, start, end): all spans that count, end exclusive."""
    rows = Rows(docs, ("text",))
    texts = rows.df.select("rid", F.coalesce(rows.col("text"), F.lit("")).alias("text"))
    indexed = cut(_candidates(texts, rules).groupBy("rid").agg(F.collect_set("rule").alias("rules")))
    scanned = [k for k, r in enumerate(rules) if frozenset() in trigram_query(r.regex)]
    # rules without mandatory trigrams read every text where it is; the others read the candidates' texts
    matched = _matches(texts, rules, scanned, lambda k: F.lit(True))
    candidates = among(texts, indexed, "rid")
    matched = matched.unionByName(_matches(candidates, rules, [k for k in range(len(rules)) if k not in scanned], lambda k: F.array_contains("rules", k)))
    ordered = W.partitionBy("rid", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("part.gap") + F.col("part.size")).over(ordered)
    placed = matched.select("rid", "kind", "part", end.alias("end")).where("part.counts")
    return rows, placed.select("rid", "kind", (F.col("end") - F.col("part.size")).alias("start"), "end")


def scan(docs: DataFrame, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """docs with a count for each base kind, the digest of the base spans, and all spans."""
    rules = BASE + added
    own = (*(f"n_{r.kind}" for r in BASE), "base_sha256", "spans")
    rows, found = spans(docs, rules)
    names = F.array(*[F.lit(r.kind) for r in rules])
    told = F.concat_ws(":", F.element_at(names, F.col("kind") + 1), F.col("start").cast("string"), F.col("end").cast("string"))
    listed = F.struct("start", "kind", told.alias("told"))
    base = F.col("kind") < len(BASE)
    text = lambda column: F.array_join(F.transform(F.array_sort(column), lambda x: x["told"]), ",")
    per = found.groupBy("rid").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        text(F.collect_list(F.when(base, listed))).alias("base_spans"), text(F.collect_list(listed)).alias("spans"),
    )
    out = rows.df.join(cut(per), "rid", "left")
    return out.select(
        *rows.back(own), *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(F.coalesce("base_spans", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).drop("text")
