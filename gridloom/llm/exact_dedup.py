"""Exact dedup by deterministic block naming.

Every text is read as fixed-size blocks of its UTF-8 bytes. Distinct blocks are sorted and numbered, so
equal blocks, and only those, share an integer name. Adjacent names are then paired and the pairs named
in the same way, level by level, until each text is one integer; together with the byte length that is
an identity without collisions (no hash decides anything). A text whose length and first block no other
text has is unique and enters no level; the others leave when they are one name.

Cases: a null text counts as empty; empty texts equal each other. Rows that repeat a doc_id are rows of
their own; if the largest doc_id of a group stands in several rows, one of them is kept. A null doc_id
is smaller than any other. A text of any length is named block by block. An empty table gives an empty result.
Other columns stay, but for those named as results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Rows, cut

BLOCK_BYTES = 512


def _named(rows: DataFrame, keys: list[str], at_least: int = 1) -> DataFrame:
    """Distinct keys, sorted within their partitions, with an integer name each. Copies are counted
    before the shuffle, and the table is written so that a join with it may split hot keys."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    return cut(counted.sortWithinPartitions(*keys).select(*keys, F.monotonically_increasing_id().alias("name")))


def identities(rows: Rows, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rid, n_bytes, name for the rows that may have copies: rows with the same n_bytes and name are equal
    texts, and rows missing from the table are unique."""
    data = F.coalesce(rows.col(text), F.lit("")).cast("binary")
    slim = rows.df.select("rid", F.octet_length(data).alias("n_bytes"), F.substring(data, 1, block_bytes).alias("first"))
    heads = _named(slim, ["n_bytes", "first"], at_least=2)
    active = cut(slim.join(heads, ["n_bytes", "first"]).select("rid", F.col("name").alias("head")))

    last = F.expr(f"(n_bytes - 1) div {block_bytes}").cast("int")
    texts = rows.df.select("rid", data.alias("data")).join(active.select("rid"), "rid").withColumn("n_bytes", F.octet_length("data"))
    blocks = cut(
        texts.withColumn("i", F.explode(F.sequence(F.lit(0), last))).select(
            "rid", "n_bytes", "i", F.expr(f"substring(data, i * {block_bytes} + 1, {block_bytes})").alias("block")
        )
    )
    level = blocks.join(_named(blocks, ["block"]), "block").select("rid", "n_bytes", "i", "name")
    most = blocks.agg(F.max("i")).first()[0] or 0
    done = level.limit(0).select("rid", "n_bytes", "name")
    depth = 0
    while True:
        level = cut(level)
        # texts that are one name by now leave; the others pair their names
        single = F.shiftright(last, depth) == 0
        done = done.unionByName(level.where(single).select("rid", "n_bytes", "name"))
        if not most:
            return done
        depth += 1
        pairs = (
            level.where(~single)
            .groupBy("rid", "n_bytes", F.expr("i div 2").cast("int").alias("i"))
            .agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        pairs = cut(pairs)
        level = pairs.join(_named(pairs, ["a", "b"]), ["a", "b"]).select("rid", "n_bytes", "i", "name")
        most //= 2


def _members(rows: Rows, names: DataFrame) -> DataFrame:
    return names.join(rows.df.select("rid", rows.col("doc_id").alias("doc_id")), "rid")


def duplicate_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with keep_id, group_size and kept; of equal texts the row with the largest doc_id stays."""
    own = ("keep_id", "group_size", "kept")
    rows = Rows(docs, ("doc_id", text))
    names = identities(rows, text)
    classes = cut(
        _members(rows, names)
        .groupBy("n_bytes", "name")
        .agg(F.max(F.struct("doc_id", "rid")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > 1)
    )
    copies = cut(names.join(classes, ["n_bytes", "name"]).select("rid", "keeper", "group_size"))
    return rows.df.join(copies, "rid", "left").select(
        *rows.back(own),
        F.when(F.col("keeper").isNull(), rows.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keeper.rid") == F.col("rid"), F.lit(True)).alias("kept"),
    )


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    rows = Rows(docs, ("doc_id", text))
    names = identities(rows, text)
    keepers = _members(rows, names).groupBy("n_bytes", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keeper"))
    dropped = cut(names.select("rid").join(keepers.select("keeper.rid"), "rid", "left_anti"))
    return rows.df.join(dropped, "rid", "left_anti").select(*rows.back())


def digest(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too."""
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    return duplicate_groups(docs.select("doc_id", "text", sha)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
