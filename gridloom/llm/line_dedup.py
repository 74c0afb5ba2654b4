"""Line dedup by a segment-partition edit join, in DataFrame operations alone.

Distinct lines are cut into threshold-plus-one segments; by the pigeonhole principle two lines within the
threshold share a segment unchanged, at nearly the same place. Each line is indexed by (its length, segment
number, segment), and probes, for every length within the threshold, the substrings at the places where
that segment can lie. Candidates are verified with a banded bit-parallel edit distance. Lines connected by
links are one class, and of each class the first occurrence in the corpus stays.

Of each index list first only the line with the most occurrences, its centre, meets the probes. Lists of one
are done with that; of longer ones, lines that these links have not joined into one class meet each other, if
their letter counts, which an edit changes by two at most, allow it. So copies of one line with edits of
their own, however many, take one verification each, and no pair across classes is left out. Lists longer
than ``LONG`` are keyed once more by buckets of letter counts before they are compared within.

Lines shorter than ``shortest`` characters are compared for equality only; the query op1_line_dedup joins
lines from ``QUERY_SHORTEST`` characters on, at the same threshold. Rows that repeat, and lines that
repeat within a text, count as occurrences in the order of doc_id and line number.

Cases: a null text has no lines and stays null; an empty text has one empty line. Lines without a word are
never dropped. A null doc_id comes first. A line of any length is one line. Columns of other names are not
read; ``dedup`` hands them on, whatever they are called. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Rows, among, cut, drop
from gridloom.llm.components import components

THRESHOLD = 2
SHORTEST = 24  # of calls that name no floor of their own
QUERY_SHORTEST = 10  # of op1_line_dedup
LONG = 64
BUCKET = 8  # width of a bucket of letter counts; wider than twice the threshold

# The letter classes.
LETTER_CLASSES = ("eE", "aA", "tT", "iI", "nN", "oO", "sS", "rR", "hH", "lL", "dD", "uU", "cCmM", "fFgGwW", "bBpPvVyY", " .,")


def probe_places(threshold: int) -> list[tuple[int, int, int]]:
    """(difference in length, segment, offset of the substring from the segment's start) of all probes."""
    found = []
    for longer in range(threshold + 1):
        for i in range(threshold + 1):
            for offset in range(max(-i, longer - (threshold - i)), min(i, longer + (threshold - i)) + 1):
                found.append((longer, i, offset))
    return found


def _keyed(lines: DataFrame, places: list[tuple[int, int, int]], threshold: int, shortest: int) -> DataFrame:
    """lid, n, key, longer, own (whether it is the line's own segment): for lines (lid, line, size, n) the key of the substring at each place that lies within
    the line. Places come as rows, so that each key is a few generated instructions. Of a line of length l,
    the last l mod (threshold + 1) segments are longer by one."""
    parts = threshold + 1
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("longer", "i", "offset"), p, strict=True)]) for p in places])
    rows = lines.select("lid", "line", "size", "n", F.explode(listed).alias("p")).select("lid", "line", "size", "n", "p.longer", "p.i", "p.offset")
    rows = rows.withColumn("target", F.col("size") - F.col("longer")).where(F.col("target") >= shortest)
    rows = rows.withColumn("even", F.expr(f"target div {parts}").cast("int")).withColumn("ahead", F.col("i") - parts + F.col("target") % parts)
    rows = rows.withColumn("start", F.col("even") * F.col("i") + F.greatest(F.lit(0), F.col("ahead")) + F.col("offset"))
    rows = rows.withColumn("width", F.col("even") + F.when(F.col("ahead") >= 0, 1).otherwise(0)).where("start >= 0 and start + width <= size")
    key = F.xxhash64(F.substring("line", F.col("start") + 1, F.col("width")), "i", "target")
    return rows.select("lid", "n", key.alias("key"), "longer", ((F.col("longer") == 0) & (F.col("offset") == 0)).alias("own"))


def _letters(line):
    """How many letters of each class a line has, up to 255, eight classes to an integer."""
    counts = [F.least(F.length(line) - F.length(F.translate(line, c, "")), F.lit(255)).cast("long") for c in LETTER_CLASSES]
    return F.array(*[sum((F.shiftleft(c, 8 * i) for i, c in enumerate(counts[k : k + 8])), F.lit(0).cast("long")) for k in range(0, len(counts), 8)])


def _count(letters, i: int):
    return F.shiftright(F.get(letters, i // 8), 8 * (i % 8)).bitwiseAND(F.lit(255))


def _alike(a, b, threshold: int):
    """Whether letter counts allow two lines to be within the threshold: an edit takes one letter away, brings
    one, or both."""
    return sum((F.abs(_count(a, i) - _count(b, i)) for i in range(len(LETTER_CLASSES))), F.lit(0)) <= 2 * threshold


def _once(value, use):
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def _shared_start(x, y):
    """How many characters two strings have in common from their start, up to 2^21: halving steps, each of which
    compares the characters that it would add."""
    steps, least = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)]), F.least(F.length(x), F.length(y))

    def grown(at, step):
        same = F.when(at + step <= least, F.substring(x, at + 1, step) == F.substring(y, at + 1, step)).otherwise(False)
        return F.when(same, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), grown)


def trimmed(a, b):
    """The strings a and b as x and y, without what they have in common at their starts and ends; that leaves
    their edit distance as it is."""

    def turned(c):
        rest = lambda d, name: F.reverse(F.substring(d[name], d["at"] + 1, F.length(d[name]))).alias(name)
        return _once(F.struct(c["x"].alias("x"), c["y"].alias("y"), _shared_start(c["x"], c["y"]).alias("at")), lambda d: F.struct(rest(d, "x"), rest(d, "y")))

    return _once(_once(F.struct(a.alias("x"), b.alias("y")), turned), turned)


def within(a, b, threshold: int):
    """Whether the edit distance of two strings is at most the threshold. Bit d of state e says that, of a,
    the prefix that ends d - threshold characters off the characters of b read so far matches them with e
    edits; only 2 * threshold + 1 diagonals are held, all in one integer, and one step reads a character."""
    width = (1 << (2 * threshold + 1)) - 1
    start = [sum(1 << (threshold + d) for d in range(e + 1)) for e in range(threshold + 1)]

    def step(xs, ys, state, j):
        read = F.get(ys, j)
        same = F.lit(0)
        for d in range(-threshold, threshold + 1):
            same = same + F.when(F.get(xs, j + d) == read, 1 << (d + threshold)).otherwise(0)
        now = [state["r0"].bitwiseAND(same)]
        for e in range(1, threshold + 1):
            held, fewer = state[f"r{e}"], state[f"r{e - 1}"]
            now.append(held.bitwiseAND(same).bitwiseOR(fewer).bitwiseOR(F.shiftright(fewer, 1)).bitwiseOR(F.shiftleft(now[-1], 1)).bitwiseAND(F.lit(width)))
        return F.struct(*[n.alias(f"r{e}") for e, n in enumerate(now)])

    first = F.struct(*[F.lit(s).alias(f"r{e}") for e, s in enumerate(start)])
    # both strings are split once, as variables of an outer function
    chars = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")))
    places = F.sequence(F.lit(0), F.length(b) - 1)
    last = F.transform(chars, lambda c: F.aggregate(places, first, lambda s, j: step(c["x"], c["y"], s, j), lambda s: s[f"r{threshold}"]))[0]
    close = F.abs(F.length(a) - F.length(b)) <= threshold
    one_is_empty = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(~close, False).when(one_is_empty, True).otherwise(F.getbit(last, F.length(a) - F.length(b) + threshold) == 1)


def _verified(pairs: DataFrame, held: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b) of lines held (lid, line, letters) those within the threshold, each once."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for what in ("letters", "line"):
        for side in "ab":
            pairs = pairs.join(held.select(F.col("lid").alias(side), F.col(what).alias(f"{what}_{side}")), side)
        if what == "letters":
            pairs = pairs.where(_alike(F.col("letters_a"), F.col("letters_b"), threshold)).select("a", "b")
    near = _once(trimmed(F.col("line_a"), F.col("line_b")), lambda c: within(c["x"], c["y"], threshold))
    return pairs.where(near).select("a", "b")


def _within_lists(lists: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of probes and index entries of lists (key, lid, longer, own, n, letters, root, largest)
    whose classes differ and whose letter counts fit."""
    entries = lists.where("own").select("key", "n", *[F.col(c).alias("q_" + c) for c in ("lid", "letters", "root")])
    once = (F.col("lid") != F.col("q_lid")) & ((F.col("longer") > 0) | (F.col("lid") < F.col("q_lid"))) & (F.col("root") != F.col("q_root"))
    fit = F.when(once, _alike(F.col("letters"), F.col("q_letters"), threshold)).otherwise(False)
    short = lists.where(F.col("n") <= LONG).drop("n").alias("p").join(entries.drop("n").alias("q"), (F.col("p.key") == F.col("q.key")) & fit)
    # a probe asks for the bucket on either side; of the largest class only what is outside of it is asked for
    buckets = [f"b{i}" for i in range(3)]
    asked, held = lists.where(F.col("n") > LONG).drop("n"), entries.where(F.col("n") > LONG).drop("n")
    for i, b in enumerate(buckets):
        sides = F.array_distinct(F.array(*[F.floor((_count(F.col("letters"), i) + s) / BUCKET) for s in (-threshold, threshold)]))
        asked, held = asked.withColumn(b, F.explode(sides)), held.withColumn(b, F.floor(_count(F.col("q_letters"), i) / BUCKET))
    held = held.join(lists.select("key", "largest").distinct(), "key").withColumn("apart", F.col("q_root") != F.col("largest")).drop("largest")
    joined = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in ("key", *buckets)]
    found = short.select("lid", "q_lid")
    for some, others in ((asked.where("root <> largest"), held), (asked.where("root = largest"), held.where("apart"))):
        condition = fit
        for c in joined:
            condition = c & condition
        found = found.unionByName(some.alias("p").join(others.alias("q"), condition).select("lid", "q_lid"))
    return found.select(F.col("lid").alias("a"), F.col("q_lid").alias("b"))


def line_links(lines: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST) -> DataFrame:
    """From distinct lines (lid, line, size: its length, n: its occurrences): links (a, b) between lines within
    the threshold. Lines have a path of links between them if, and only if, they have one of such pairs."""
    able = lines.where(F.col("size") >= shortest).select("lid", "line", "size", "n")
    index = _keyed(able, [(0, i, 0) for i in range(threshold + 1)], threshold, shortest)
    lists = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("lid", F.struct("n", "lid")).alias("center"))
    probes = _keyed(able, probe_places(threshold), threshold, shortest).drop("n")
    matches = cut(probes.join(lists, "key").where("n > 1 or lid <> center"))
    ids = cut(matches.select("lid").unionByName(matches.select(F.col("center").alias("lid"))).distinct())
    # the texts of these lines, picked by a filter before they are joined
    held = cut(among(able.select("lid", "line"), ids, "lid").withColumn("letters", _letters(F.col("line"))), ids)
    links = cut(_verified(matches.where("lid <> center").select(F.col("lid").alias("a"), F.col("center").alias("b")), held, threshold))
    roots = components(links, native=True)
    several = matches.where("n > 1").join(held.select("lid", "letters"), "lid").join(roots, F.col("lid") == F.col("node"), "left")
    placed = cut(several.select("key", "lid", "longer", "own", "n", "letters", F.coalesce("root", "lid").alias("root")), roots)
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("largest"), F.count(F.lit(1)).alias("parts"))
    left = cut(placed.join(parts.where("parts > 1").select("key", "largest"), "key"), placed)
    if not left.isEmpty():
        links = cut(links.unionByName(_verified(_within_lists(left, threshold), held, threshold)), links)
    drop(left, held, matches)
    return links


def _occurrences(rows: Rows) -> DataFrame:
    """rid, doc_id, pos, line of each line that has a word."""
    lines = rows.df.select("rid", rows.col("doc_id").alias("doc_id"), F.posexplode(F.split(rows.col("text"), "\n", -1)).alias("pos", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def dropped_lines(docs: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST) -> tuple[Rows, DataFrame]:
    """(keyed docs, table of rid, dropped: numbers of lines that go and where the lines stand that stay for them,
    n_near: how many of them only resemble that line, n_class_lines: other lines in the classes of the text's
    lines)."""
    rows = Rows(docs, ("doc_id", "text"))
    named = _occurrences(rows).withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit(1), "line"))
    place = F.struct("doc_id", "rid", "pos")
    distinct = named.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.first("line").alias("line"))
    lines = cut(distinct.withColumn("lid", F.monotonically_increasing_id()).withColumn("size", F.length("line")))
    found = line_links(lines.select("lid", "line", "size", "n"), threshold, shortest)
    roots = components(found, native=True)
    slim = lines.select("lid", "h", "g", "first", "n").join(roots, F.col("lid") == F.col("node"), "left")
    classed = cut(slim.join(found.select(F.explode(F.array("a", "b")).alias("lid")).distinct().withColumn("linked", F.lit(True)), "lid", "left")
                  .where("n > 1 or linked").select("h", "g", "first", F.coalesce("root", "lid").alias("root")), found, roots, lines)
    keeper = classed.groupBy("root").agg(F.min("first").alias("keeper"), F.count(F.lit(1)).alias("size"))
    affected = cut(classed.join(keeper, "root").select("h", "g", "size", "keeper", (F.col("first") != F.col("keeper")).alias("near")), classed)
    seen = named.select("rid", "pos", "h", "g").join(affected, ["h", "g"])
    goes = ~((F.col("rid") == F.col("keeper.rid")) & (F.col("pos") == F.col("keeper.pos")))
    per = seen.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when(goes, F.struct("pos", F.col("keeper.doc_id").alias("by"), F.col("keeper.pos").alias("at"))))).alias("dropped"),
        F.count_if(goes & F.col("near")).alias("n_near"), F.sum(F.col("size") - 1).alias("n_class_lines"),
    )
    return rows, cut(per, affected)


def dedup(docs: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST) -> DataFrame:
    """docs with the lines that go taken out of their texts."""
    rows, per = dropped_lines(docs, threshold, shortest)
    text = rows.col("text")
    parts = F.transform(F.split(text, "\n", -1), lambda x, i: F.when(~F.array_contains("dropped.pos", i), x))
    left = F.when(F.size("dropped") > 0, F.array_join(F.array_compact(parts), "\n")).otherwise(text)
    joined = rows.df.join(per.where(F.size("dropped") > 0), "rid", "left").withColumn(rows.inner["text"], left)
    return joined.select(*rows.back())


def digest(docs: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST) -> DataFrame:
    """For every document: doc_id, n_lines, n_dropped, n_near, n_class_lines, the dropped lines' numbers, and for
    each of these its class, named by the line that stays (doc_id:number)."""
    rows, per = dropped_lines(docs.select("doc_id", "text"), threshold, shortest)
    lines = F.coalesce(F.size(F.split(rows.col("text"), "\n", -1)), F.lit(0))
    # a null text has no lines
    lines = F.when(rows.col("text").isNull(), 0).otherwise(lines).cast("long")
    joined = rows.df.select("rid", rows.col("doc_id").alias("doc_id"), lines.alias("n_lines")).join(per, "rid", "left")
    listed = lambda told: F.coalesce(F.array_join(F.transform("dropped", told), ","), F.lit(""))
    return joined.select(
        "doc_id", "n_lines", F.coalesce(F.array_size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.coalesce("n_class_lines", F.lit(0)).alias("n_class_lines"), listed(lambda x: x["pos"].cast("string")).alias("dropped"),
        listed(lambda x: F.concat_ws(":", F.coalesce(x["by"].cast("string"), F.lit("")), x["at"].cast("string"))).alias("kept_lines"),
    )
