"""Exact dedup by deterministic block naming.

A text is cut into fixed-size byte blocks. The distinct blocks of the corpus
are sorted and get integer names; adjacent names are paired, the distinct
pairs are sorted and named in turn, and so on until each document has one
name. Documents that need the same number of rounds and end at the same name
have the same text, and no others do: naming never loses a difference.

Blocks are sorted by a 128-bit key instead of their bytes, so that only the
distinct blocks cross the network, once and combined on the map side. That the
keys tell all blocks apart is verified over the whole corpus (two blocks under
one key start the naming again with another seed), so no result rests on a hash.

Defined results: a null text counts as empty; an empty text is one empty
block; rows that repeat both id and text are copies of each other and all of
them stay; a null id is kept only where no copy has an id. An empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import ascii_lower
from weftgraph.plans.durable import drop_durable, durable

BLOCK_BYTES = 4096


def normalised(text) -> F.Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _named(keys: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Distinct keys, globally sorted, with an integer name that follows the order."""
    ordered = keys.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return durable(ordered.withColumn("name", F.monotonically_increasing_id()), label)


def _block_names(rows: DataFrame, block_bytes: int, most_seeds: int = 8) -> DataFrame:
    """(rid, pos, name) of every block of every text."""
    for seed in range(most_seeds):
        data = F.encode("text", "UTF-8")
        at = F.expr(f"sequence(0, cast(greatest(octet_length(text) - 1, 0) div {block_bytes} as int))")
        cut = rows.select("rid", data.alias("data"), F.explode(at).alias("pos")).select("rid", "pos", F.expr(f"substring(data, pos * {block_bytes} + 1, {block_bytes})").alias("block"))
        keyed = cut.select("rid", "pos", F.xxhash64("block").alias("k1"), F.xxhash64(F.lit(seed), "block").alias("k2"), "block")
        kinds = durable(keyed.select("k1", "k2", "block").distinct().groupBy("k1", "k2").agg(F.count("*").alias("blocks")), "blocks")
        if kinds.where("blocks > 1").isEmpty():
            names = _named(kinds.select("k1", "k2"), ["k1", "k2"], "block-names")
            return keyed.drop("block").join(names, ["k1", "k2"]).select("rid", "pos", "name")
    raise RuntimeError("block keys collide under every seed")


def identities(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(rid, level, name) for rows (rid, text): equal (level, name) if and only if equal text."""
    now = durable(_block_names(rows, block_bytes), "names")
    done, level = None, 0
    while True:
        pairs = now.groupBy("rid", F.expr("pos div 2").alias("pos")).agg(F.max(F.when(F.expr("pos % 2 = 0"), F.col("name"))).alias("l"), F.max(F.when(F.expr("pos % 2 = 1"), F.col("name"))).alias("r"))
        # a document is finished at the level where it has one name left: its first pair lacks a right half
        tagged = durable(pairs.withColumn("r", F.coalesce("r", F.lit(-1))), "pairs")
        finished = tagged.where("pos = 0 and r = -1").select("rid", F.lit(level).alias("level"), F.col("l").alias("name"))
        done = finished if done is None else done.unionByName(finished)
        rest = tagged.where("not (pos = 0 and r = -1)")
        if rest.isEmpty():
            return done
        names = _named(rest.select("l", "r").distinct(), ["l", "r"], "pair-names")
        drop_durable(now)
        now, level = durable(rest.join(names, ["l", "r"]).select("rid", "pos", "name"), "names"), level + 1


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    rows = durable(rows.withColumn("text_sha256", F.sha2("text", 256)), "numbered")  # whatever gave the rows, their numbers hold from here
    named = durable(rows.select("rid", "doc_id", "text_sha256").join(identities(rows.select("rid", "text"), block_bytes), "rid"), "named")
    drop_durable(rows)
    # groups are written first: a join of two tables is dealt anew where a name is crowded, one with a sum is not
    groups = durable(named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return named.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
