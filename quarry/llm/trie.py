"""Prefix trie of conversations: shared beginnings, found by chained digests.

A node is a sequence of first turns that some conversation begins with. Its key
is a chained SHA-256: each turn's digest is hashed onto the digest of the turns
before it, so equal prefixes have equal keys and no text is compared or moved. Every
conversation is exploded to all its prefixes, and grouping by (depth, digest)
makes the nodes.

Sums over subtrees explode nodes to their ancestors, after pre-aggregation: each
node is owned by its smallest conversation, and the nodes that a conversation owns
are the deepest stretch of its own path. Within a stretch sums run along it; what
a whole stretch weighs is exploded to the ancestors above it, which are the
prefixes of its owner that it does not own. So the exploded rows are never more
than the turns, however deep the trie is and however many share a node.

A node's many members are counted with partial sums; nodes with very many children
(more than 1/10000 of all nodes, so at most 10000 of them) meet their children through a
broadcast, the rest by key. The ids that end in one node are sorted by range,
joined to runs of text in many tasks, and only the runs go through its SHA-256.

Turns are carried as digest and word count: texts do not leave the task that
reads them. Chains run over sorted partitions row by row, so a conversation of any
length takes bounded memory.

Defined results: turns of equal number come by role, then by the SHA-256 of
their text; a null turn comes first; null role and text are empty ones; repeated
rows are turns each. Rows without conversation id belong to none and are left out
(``conversations`` without rows that have one give no rows, not even a root).
Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import settle_table, shuffle_partitions, small_batches

ROOT = hashlib.sha256(b"").digest()
#: Longest run of joined ids in one row.
_RUN = 1 << 16
#: Nodes with more than a ten-thousandth of all nodes as children are broadcast.
_BUSY = 10_000
PATHS = "conv_id long, depth long, digest binary, parent binary, n_words long, last boolean"


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, role digest and text digest in one, n_words): turns by number from 0."""
    small_batches(conversations.sparkSession)
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(text, 256)).alias("of_text"),
        word_count(text).alias("n_words"),
    ).filter("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "of_text")
    both = F.unhex(F.sha2(F.concat(F.unhex(F.sha2("role", 256)), F.col("of_text")), 256))
    return rows.withColumn("i", (F.row_number().over(order) - 1).cast("long")).select("conv_id", "i", both.alias("digest"), "n_words")


def word_count(text: Column) -> Column:
    """Runs of anything but the six ASCII spaces: each begins at the start or after a space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def graft(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations (conv_id, part, i, digest, n_words) whose first h turns are those of
    conversation c - c % every, h = crc32(c) % most; a row of null digest stands for each
    conversation itself, so that one without turns is there."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    ids = turns.select("conv_id").distinct()
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("i") < most - 1)).withColumnRenamed("conv_id", "base")
    wanted = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h")).filter("h > 0")
    taken = wanted.join(heads, "base").filter("i < h").select("conv_id", F.lit(1).alias("part"), "i", "digest", "n_words")
    own = turns.filter(F.col("i") >= h).select("conv_id", F.lit(2).alias("part"), "i", "digest", "n_words")
    start = ids.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("i"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_words"))
    return start.unionByName(taken).unionByName(own)


def paths(rebuilt: DataFrame) -> DataFrame:
    """Every prefix of every conversation of (conv_id, part, i, digest, n_words) rows, with its chained
    digest and that of the prefix before it; the longest one of a conversation is its ``last``."""

    def run(batches):
        conv, depth, above, here, words = None, 0, None, ROOT, 0
        out: tuple[list, ...] = ([], [], [], [], [], [])
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        names = ["conv_id", "depth", "digest", "parent", "n_words", "last"]

        def keep(last):
            for column, value in zip(out, (conv, depth, here, above, words, last)):
                column.append(value)

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
            for column in out:
                column.clear()
            return made

        for batch in batches:
            for c, digest, n in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "digest", "n_words"))):
                if digest is None:
                    if conv is not None:
                        keep(True)
                    conv, depth, above, here, words = c, 0, None, ROOT, 0
                else:
                    keep(False)
                    depth, above, words = depth + 1, here, n
                    here = hashlib.sha256(here + digest).digest()
            yield flush()
        if conv is not None:
            keep(True)
        yield flush()

    # an exchange of its own keeps a conversation in one partition whatever is planned around it
    dealt = rebuilt.repartition(shuffle_partitions(rebuilt.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "i")
    return dealt.select("conv_id", "digest", "n_words").mapInArrow(run, PATHS)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256) of (depth, digest, conv_id) rows: SHA-256 of each node's ids, ascending, comma-joined."""
    spark = ends.sparkSession
    parts = shuffle_partitions(spark)

    def runs(batches):
        """Ids of one node that follow each other, joined; a node may go on in the next partition."""
        key, first, ids, size = None, None, [], 0
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string())

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["depth", "digest", "first_id", "ids"])

        for batch in batches:
            done = []
            for depth, digest, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (depth, digest) or size > _RUN:
                    if key is not None:
                        done.append((*key, first, ",".join(ids)))
                    key, first, ids, size = (depth, digest), conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if done:
                yield made(done)
        if key is not None:
            yield made([(*key, first, ",".join(ids))])

    def hashes(batches):
        key, state = None, None
        kinds = (pa.int64(), pa.binary(), pa.string())

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["depth", "digest", "ends_sha256"])

        for batch in batches:
            done: list[tuple] = []
            for depth, digest, ids in zip(*(batch.column(k).to_pylist() for k in ("depth", "digest", "ids"))):
                if key != (depth, digest):
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (depth, digest), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield made(done)
        if key is not None:
            yield made([(*key, state.hexdigest())])

    sorted_ids = ends.select("depth", "digest", "conv_id").repartitionByRange(parts, "depth", "digest", "conv_id").sortWithinPartitions("depth", "digest", "conv_id")
    joined = sorted_ids.mapInArrow(runs, "depth long, digest binary, first_id long, ids string")
    dealt = joined.repartition(parts, "depth", "digest").sortWithinPartitions("depth", "digest", "first_id")
    return dealt.mapInArrow(hashes, "depth long, digest binary, ends_sha256 string")


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """The nodes of (conv_id, part, i, digest, n_words) conversations: conv_id (the smallest member), depth,
    digest, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    key = ["depth", "digest"]
    every = settle_table(paths(rebuilt))
    grouped = every.groupBy(*key).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"), F.first("n_words").alias("n_words"))
    grouped = settle_table(grouped)
    kids = grouped.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    saves = (F.col("n_convs") - 1) * F.col("n_words")
    nodes = settle_table(grouped.join(kids, key, "left").select(*key, "parent", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), saves.alias("saves")))

    # what each owner's stretch weighs, and from which depth on it is its own
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    stretch = nodes.groupBy("conv_id").agg(F.min("depth").alias("own_from"), F.sum("saves").alias("stretch_saves"), F.sum(leaf).alias("stretch_leaves"))
    above = every.select("conv_id", *key).join(stretch, "conv_id").filter(F.col("depth") < F.col("own_from"))
    hung = above.groupBy(*key).agg(F.sum("stretch_saves").alias("hung_saves"), F.sum("stretch_leaves").alias("hung_leaves"))

    # the owner of the parent: a stretch's own nodes have their owner's, its first one has another's
    busy_from = F.lit(max(1000, nodes.count() // _BUSY))
    owners = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    heads = nodes.join(stretch.select("conv_id", F.col("own_from").alias("depth")), ["conv_id", "depth"]).filter("depth > 0").select("conv_id", "depth", "parent")
    busy = heads.join(F.broadcast(owners.filter(F.col("n_children") > busy_from).drop("n_children")), ["depth", "parent"], "left")
    rest = busy.filter("parent_conv_id IS NULL").drop("parent_conv_id").join(owners.filter(F.col("n_children") <= busy_from).drop("n_children"), ["depth", "parent"])
    parents = busy.filter("parent_conv_id IS NOT NULL").unionByName(rest).select("conv_id", "depth", "parent_conv_id")

    along = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = (
        nodes.join(hung, key, "left")
        .join(end_digests(every.filter("last")), key, "left")
        .join(parents, ["conv_id", "depth"], "left")
        .withColumn("n_leaves", F.sum(leaf).over(along) + F.coalesce("hung_leaves", F.lit(0)))
        .withColumn("saved_tokens", F.sum("saves").over(along) + F.coalesce("hung_saves", F.lit(0)))
    )
    own_parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))
    return summed.select(
        "conv_id", "depth", "digest", own_parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(graft(settle_table(turn_digests(conversations))))


_BITS = "list_reduce([xor({}, {}), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
    "lambda a, b: xor(a // 256, " + _BITS.format("xor(a, b) % 256", "0::BIGINT") + ")), 4294967295)"
)
#: The query's rows by comparing whole sequences of turns.
ORACLE = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS i,
    sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS turn_key,
    length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_words
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
rebuilt AS (
  SELECT c.conv_id, 1 AS part, t.i, t.turn_key, t.n_words FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.i < c.h
  UNION ALL SELECT c.conv_id, 2, t.i, t.turn_key, t.n_words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i >= c.h),
whole AS (
  SELECT c.conv_id, coalesce(r.keys, []) AS keys, coalesce(r.sizes, []) AS sizes
  FROM convs c LEFT JOIN (SELECT conv_id, list(turn_key ORDER BY part, i) AS keys, list(n_words ORDER BY part, i) AS sizes FROM rebuilt GROUP BY 1) r ON r.conv_id = c.conv_id),
paths AS (SELECT conv_id, d AS depth, keys[1:d] AS path, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS n_words, d = len(keys) AS ends FROM whole, unnest(range(len(keys) + 1)) AS u(d)),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_words) AS saves,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY 1, 2),
kids AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
leaves AS (SELECT n.depth, n.path, n.saves, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path),
sums AS (SELECT a AS depth, path[1:a] AS path, sum(leaf) AS n_leaves, sum(saves) AS saved_tokens FROM leaves, unnest(range(depth + 1)) AS u(a) GROUP BY 1, 2)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.path = n.path
LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""
