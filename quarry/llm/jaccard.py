"""N-gram Jaccard join: size-aware, heavy and light, exact at its threshold.

1. Documents are dealt by a hash of doc_id to groups of a few MB. A group sends
   the distinct shingle hashes of its documents, packed by bucket, each with the
   number of its documents that have it; a bucket adds the numbers up and answers
   each group. These document frequencies may be too high when two shingles share
   a bucket and the 32 bits sent, never too low; they only filter and order.
2. A partner shares at least 3/4 of a set, so a set with fewer shingles that
   occur elsewhere has no partner. What is left, few documents, carries on with
   its shared shingles, rarest first. Equal sets fall together into one class,
   so copies meet in an aggregation and not in a join.
3. Sets up to a boundary enumerate the 2-subsets of their prefix (any two linked
   sets share one); larger ones, and those small ones that a larger one can be
   linked with, put each prefix shingle's inverted list to use. The boundary is
   where the two costs cross, taken from a histogram of what each would emit.
4. Sets that meet under a key are compared with the list's pivot first (the set
   with fewest shingles of its own: the likely original). A list whose members
   then are in one component is done, so a large group of near copies costs its
   size and not its square. In other lists some of the sets outside the pivot's
   component, drawn by a hash, are compared with all of other components: 16 the
   first time, 16 times as many each time after, until a list is in one component or
   all of its sets have been drawn: no link between components can be missed.
   A pair is compared by its exact intersection of 64-bit shingle hashes: at 10^13
   different shingles two of them share a hash in a few million cases, and a link
   is decided wrongly only if such a pair meets in two sets at the threshold's edge.
5. All links lie within components, so each set's links are counted there: the
   sets of a component are dealt by a hash to blocks, and each pair of blocks is
   one group, where products of 0/1 matrices give all intersections. No pair
   becomes a row; the work grows with the square of a component's different sets.

Words: maximal runs without ASCII white space, with A-Z in lower case.

Defined results: a null or empty text has no shingles and is its own component;
fewer words than the shingle form one shingle together; a null doc_id is larger
than all others and is null in the result; rows that share a doc_id are one node
of the graph, linked with whatever one of them is linked with, and have one
component (rows without an id stay apart); an empty table gives no rows; other
columns are ignored. The frequencies that order and filter shingles stop at 255 a
group and 65535 in all, which changes their order only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import hashing
from quarry.llm.common import grouped_text, keyed_text, settle, shuffle_partitions, sized, text_bytes
from quarry.llm.components import components

_LAST = np.iinfo(np.int64).max
_BASE = 0xD6E8FEB86659FD93
_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("toks", pa.list_(pa.int64())), ("freq", pa.list_(pa.int32()))])


class _Sets:
    """The shingle sets of one group of documents."""

    def __init__(self, table, width: int, buckets: int) -> None:
        self.ids = hashing.column(table, "doc_id")
        raw, at = hashing.text_buffer(hashing.column(table, "text"))
        starts, ends, first = hashing.word_spans(raw, at)
        words = hashing.span_hashes(raw, starts, ends, lower=True)
        counts = np.diff(first)
        owner = hashing.owners(counts)
        rolled = hashing.rolling(words, width, _BASE)
        inside = np.flatnonzero(owner[: len(rolled)] == owner[width - 1 :]) if len(rolled) else np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < width))
        whole = [hashing.rolling(words[first[i] : first[i + 1]], int(counts[i]), _BASE)[0] for i in short]
        hashes = np.concatenate((rolled[inside], hashing.mix(np.array(whole, np.uint64) + np.uint64(1))))
        owner = np.concatenate((owner[inside], short))
        if len(short):
            by_owner = np.argsort(owner, kind="stable")
            hashes, owner = hashes[by_owner], owner[by_owner]
        order = np.argsort(hashes, kind="stable")
        h, o = hashes[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        mine = new.copy()
        mine[1:] |= o[1:] != o[:-1]
        #: one entry per (hash, document), by hash; and where each hash begins
        self.h, self.o = h[mine], o[mine]
        self.begin = np.flatnonzero(new[mine])
        self.hash = self.h[self.begin]
        self.local = np.diff(np.append(self.begin, len(self.h)))
        self.n = np.bincount(self.o, minlength=len(self.ids))
        bucket = ((self.hash >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        self.dealt = np.argsort(bucket, kind="stable")
        self.bucket = bucket[self.dealt]

    def parts(self) -> list[tuple[int, int, int]]:
        if not len(self.bucket):
            return []
        cut = np.concatenate(([0], np.flatnonzero(np.diff(self.bucket)) + 1, [len(self.bucket)]))
        return [(int(self.bucket[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:])]


def _shingle_sets(keyed: DataFrame, width: int, num: int, den: int, group_bytes: int, bucket_hashes: int) -> DataFrame:
    """(doc_id, n, sig, toks, freq) of every document; the last three are null
    where too few shingles occur elsewhere. toks: shared shingles, rarest first."""
    total = text_bytes(keyed)
    buckets = max(1, total // 6 // bucket_hashes)
    grouped = grouped_text(keyed, total, group_bytes)

    def ask(key, table):
        sets = _Sets(table, width, buckets)
        hashing.release()
        rest = (sets.hash & np.uint64(0xFFFFFFFF)).astype("<u4")[sets.dealt]
        local = np.minimum(sets.local, 255).astype(np.uint8)[sets.dealt]
        rows = [(key[0].as_py(), b, rest[i:j].tobytes(), local[i:j].tobytes() if (local[i:j] > 1).any() else b"") for b, i, j in sets.parts()]
        return pa.table(list(zip(*rows)) or [[]] * 4, schema=pa.schema([("grp", pa.int64()), ("bucket", pa.int64()), ("rest", pa.binary()), ("local", pa.binary())]))

    def answer(table):
        rests = [np.frombuffer(r, "<u4") for r in table.column("rest").to_pylist()]
        local = [np.frombuffer(c, np.uint8) if c else np.ones(len(r), np.uint8) for c, r in zip(table.column("local").to_pylist(), rests)]
        _, which = np.unique(np.concatenate(rests), return_inverse=True)
        freq = np.minimum(np.bincount(which, weights=np.concatenate(local)), 65535).astype("<u2")[which]
        cut = np.concatenate(([0], np.cumsum([len(r) for r in rests])))
        hashing.release()
        parts = [freq[a:b] for a, b in zip(cut[:-1], cut[1:])]
        return pa.table(
            [table.column("grp"), table.column("bucket"), pa.array([np.packbits(f > 1).tobytes() for f in parts], pa.binary()), pa.array([f[f > 1].tobytes() for f in parts], pa.binary())],
            names=["grp", "bucket", "bits", "freq"],
        )

    def collect(table, answers):
        sets = _Sets(table, width, buckets)
        back = dict(zip(answers.column("bucket").to_pylist(), zip(answers.column("bits").to_pylist(), answers.column("freq").to_pylist())))
        freq = np.ones(len(sets.hash), np.int64)
        for b, i, j in sets.parts():
            many = np.unpackbits(np.frombuffer(back[b][0], np.uint8), count=j - i).astype(bool)
            freq[sets.dealt[i:j][many]] = np.frombuffer(back[b][1], "<u2")
        each = np.repeat(freq, sets.local)
        shared = np.flatnonzero(each > 1)
        held = np.bincount(sets.o[shared], minlength=len(sets.ids))
        alive = (sets.n > 0) & (den * held >= num * sets.n)
        shared = shared[alive[sets.o[shared]]]
        shared = shared[np.lexsort((sets.h[shared], each[shared], sets.o[shared]))]
        all_of = np.flatnonzero(alive[sets.o])
        all_of = all_of[np.argsort(sets.o[all_of], kind="stable")]
        end_all, end_shared = np.cumsum(np.where(alive, sets.n, 0)), np.cumsum(np.where(alive, held, 0))
        sig, toks, freqs = [], [], []
        hashing.release()
        for i in range(len(sets.ids)):
            if not alive[i]:
                sig.append(None), toks.append(None), freqs.append(None)
                continue
            at = shared[end_shared[i] - held[i] : end_shared[i]]
            sig.append(hashlib.blake2b(sets.h[all_of[end_all[i] - sets.n[i] : end_all[i]]].tobytes(), digest_size=16).digest())
            toks.append(sets.h[at].view(np.int64)), freqs.append(each[at].astype(np.int32))
        return pa.table([sets.ids, pa.array(sets.n, pa.int64()), pa.array(sig, pa.binary()), pa.array(toks, pa.list_(pa.int64())), pa.array(freqs, pa.list_(pa.int32()))], schema=_SETS)

    asked = grouped.groupBy("grp").applyInArrow(ask, "grp long, bucket long, rest binary, local binary")
    answered = asked.groupBy("bucket").applyInArrow(answer, "grp long, bucket long, bits binary, freq binary")
    return grouped.groupBy("grp").cogroup(answered.groupBy("grp")).applyInArrow(collect, "doc_id long, n long, sig binary, toks array<long>, freq array<int>")


def _need(n, num: int, den: int):
    return (num * n + den - 1) // den


def _costs(reps: DataFrame, num: int, den: int) -> DataFrame:
    """By size class (quarters of a doubling): rows that 2-subsets would emit, and
    rows that inverted lists would, each weighed by how often its list is read."""
    n, own = F.col("n"), F.col("n") - F.size("toks")
    need = F.ceil(F.lit(num) * n / F.lit(den))
    two = F.greatest(F.lit(0), n - need + 2 - own).cast("double")
    one = F.greatest(F.lit(0), n - need + 1 - own).cast("int")
    scans = F.aggregate(F.slice("freq", 1, F.greatest(one, F.lit(0))), F.lit(0.0), lambda s, f: s + 1 + F.log2(f.cast("double")))
    return (
        reps.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("class"))
        .agg(F.max("n").alias("top"), F.sum(two * (two - 1) / 2).alias("subsets"), F.sum(scans).alias("scans"))
        .orderBy("class")
    )


def boundary(costs: list[tuple[int, float, float]]) -> int:
    """The size up to which sets enumerate subsets: where the sum of (top, subsets,
    scans) over the classes below by subsets and above by scans is least."""
    best, size = sum(c[2] for c in costs), 0
    for i in range(len(costs)):
        cost = sum(c[1] for c in costs[: i + 1]) + sum(c[2] for c in costs[i + 1 :])
        if cost < best:
            best, size = cost, int(costs[i][0])
    return size


def _entries(reps: DataFrame, small: int, num: int, den: int) -> DataFrame:
    """(key, node, n, own, most): under each key the sets that meet there. A
    partner met at a set's position i has at most ``most`` shingles, as only
    n - i of the set's are left to share."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("most", pa.int64())])

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for node, n, toks in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "toks"))):
                own, need = n - len(toks), _need(n, num, den)
                t = np.array(toks, np.int64).view(np.uint64)
                keys, first = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                if n <= small and need >= 2:
                    p = t[: max(0, n - need + 2 - own)]
                    i, j = np.triu_indices(len(p), 1)
                    keys.append(hashing.mix(p[i] * np.uint64(_BASE) + p[j]))
                    first.append(own + i)
                # a set that enumerates subsets meets larger ones, which do not, in inverted lists
                if not (n <= small and need >= 2) or den * n >= num * (small + 1):
                    p = t[: max(0, n - need + 1 - own)]
                    keys.append(p)
                    first.append(own + np.arange(len(p)))
                at = np.concatenate(first)
                # overlap >= num * (n + m) / (num + den) and overlap <= n - i
                most = ((num + den) * (n - at)) // num - n
                for c, v in zip(out, (np.concatenate(keys).view(np.int64), np.full(len(at), node), np.full(len(at), n), np.full(len(at), own), most)):
                    c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], schema=schema)

    emitted = reps.select("node", "n", "toks").mapInArrow(run, "key long, node long, n long, own long, most long")
    return emitted.filter(F.col("most") * den >= F.col("n") * num)


def _linked(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are as like as asked, by their exact intersection."""
    left = reps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    right = reps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    same = F.size(F.array_intersect("ta", "tb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", (F.col("na") + F.col("nb")).alias("sizes"), same.alias("same"))
        .filter((num + den) * F.col("same") >= num * F.col("sizes"))
        .select("a", "b")
    )


def _fits(num: int, den: int):
    """Whether the sets of an entry and of another (``o_``) may be linked and are not in one component."""
    sizes = (den * F.col("n") >= num * F.col("o_n")) & (den * F.col("o_n") >= num * F.col("n"))
    return (F.col("n") <= F.col("o_most")) & (F.col("o_n") <= F.col("most")) & sizes & (F.col("comp") != F.col("o_comp")) & (F.col("node") != F.col("o_node"))


def _links(reps: DataFrame, entries: DataFrame, num: int, den: int, drawn: int = 16) -> DataFrame | None:
    """Labels (node, comp) over links among classes, or None without any."""
    cols = ["node", "n", "most", "comp"]
    others = [f"o_{c}" for c in cols]
    state, count = sized(entries.withColumn("comp", F.col("node")))
    pivot = F.min(F.struct("own", "n", "node", "most", "comp")).alias("p")
    links = labels = None
    turn = 0
    while count:
        lists = state.groupBy("key").agg(pivot, F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("len"))
        # settled, so that the join does not share the aggregation's exchange and a key with very many sets can be split
        live, _ = sized(lists.filter((F.col("lo") < F.col("hi")) & (F.lit(turn < 2) | (F.col("len") > drawn ** (turn - 1)))).select("key", "len", *(F.col(f"p.{c}").alias(f"o_{c}") for c in cols)))
        state, count = sized(state.join(live, "key"))
        if not count:
            break
        if turn == 0:
            met = state
        else:
            share = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) * F.col("len")
            now = (share < drawn**turn << 20) & (F.lit(turn == 1) | (share >= drawn ** (turn - 1) << 20))
            outside = state.filter((F.col("comp") != F.col("o_comp")) & now).select("key", *(F.col(c).alias(f"o_{c}") for c in cols))
            met = state.drop(*others).join(outside, "key")
        pairs = met.filter(_fits(num, den)).select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()
        found = _linked(pairs, reps, num, den)
        links, many = sized(found if links is None else links.unionByName(found).distinct())
        state = state.drop("len", *others)
        if many:
            labels = components(links)
            state = state.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        turn += 1
    return labels


def _links_within(n: np.ndarray, weight: np.ndarray, values: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray | None, num: int, den: int, slab: int = 4096) -> np.ndarray:
    """For each set (its shared shingles ``values[at[i]:at[i + 1]]``) the weight of the sets
    linked with it: over all pairs of sets, or of ``left`` with ``right`` ones if given."""
    known, col, times = np.unique(values, return_inverse=True, return_counts=True)
    row = hashing.owners(np.diff(at))
    # a shingle of one set alone is in no intersection
    several = times > 1
    row, col = row[several[col]], (np.cumsum(several) - 1)[col[several[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    other = left if right is None else right
    same = np.zeros((len(left), len(other)), np.int64)
    for lo in range(0, int(several.sum()), slab):
        i, j = np.searchsorted(col, (lo, lo + slab))
        held = np.zeros((len(n), min(slab, int(several.sum()) - lo)), np.float32)
        held[row[i:j], col[i:j] - lo] = 1
        same += (held[left] @ held[other].T).astype(np.int64)
    linked = (num + den) * same >= num * (n[left][:, None] + n[other][None, :])
    out = np.zeros(len(n), np.int64)
    if right is None:
        np.fill_diagonal(linked, False)
    else:
        out[right] = weight[left] @ linked
    out[left] = linked @ weight[other]
    return out


def _link_counts(reps: DataFrame, classes: DataFrame, labels: DataFrame | None, num: int, den: int, block_sets: int, block_shingles: int) -> DataFrame:
    """(sig, links): for each class in a component with others, the documents of
    the classes linked with it."""
    # different sets under one id are one node, and may be linked with each other
    alike = reps.groupBy("node").count().filter("count > 1").select("node", F.col("node").alias("comp"))
    inside = alike if labels is None else labels.select("node", "comp").unionByName(alike.join(labels, "node", "left_anti"))
    members = reps.join(inside, "node")
    sizes = settle(members.groupBy("comp").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")))
    # a component of several blocks has so many sets or shingles that there are few of them
    wide = sizes.select("comp", F.greatest(F.ceil(F.col("sets") / block_sets), F.ceil(F.col("shingles") / block_shingles)).cast("int").alias("blocks")).filter("blocks > 1")
    groups = max(shuffle_partitions(reps.sparkSession), int(sizes.agg(F.sum("shingles").alias("s")).first()["s"] or 0) // block_shingles)
    placed = members.join(F.broadcast(wide), "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    weighed = placed.join(classes.select("sig", "class_size"), "sig")
    dealt = weighed.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(groups))).otherwise(F.xxhash64("comp")).alias("grp"),
        F.least("block", "met").alias("lo"), F.greatest("block", "met").alias("hi"), "block", "comp", "sig", "n", "class_size", "toks",
    )

    def count(key, table):
        table = table.sort_by("comp").combine_chunks()
        comp, n, weight, block = (hashing.column(table, c).to_numpy(zero_copy_only=False) for c in ("comp", "n", "class_size", "block"))
        toks = hashing.column(table, "toks")
        at, values = np.array(toks.offsets, np.int64), np.array(toks.values, np.int64)
        cut = np.concatenate(([0], np.flatnonzero(np.diff(comp)) + 1, [len(comp)]))
        links = np.zeros(len(comp), np.int64)
        for a, b in zip(cut[:-1], cut[1:]):
            left, right = np.arange(b - a), None
            if key[1].as_py() != key[2].as_py():
                left, right = np.flatnonzero(block[a:b] == key[1].as_py()), np.flatnonzero(block[a:b] == key[2].as_py())
            links[a:b] = _links_within(n[a:b], weight[a:b], values[at[a] : at[b]], at[a : b + 1] - at[a], left, right, num, den)
        return pa.table([hashing.column(table, "sig"), pa.array(links, pa.int64())], names=["sig", "links"])

    return dealt.groupBy("grp", "lo", "hi").applyInArrow(count, "sig binary, links long").groupBy("sig").agg(F.sum("links").alias("links"))


def _of_repeated_ids(known: DataFrame, alone: DataFrame, placed: DataFrame) -> tuple[DataFrame | None, bool]:
    """(comp, whole): components that rows of one id have come to, and the one that they are together;
    and whether there are any."""
    rows = known.select("doc_id", "sig").join(placed.select("sig", "comp"), "sig").select("doc_id", "comp").unionByName(alone.select("doc_id", F.col("doc_id").alias("comp")))
    several = rows.filter(F.col("doc_id") != _LAST).groupBy("doc_id").agg(F.min("comp").alias("a"), F.max("comp").alias("hi")).filter("a < hi")
    repeated, many = sized(several)
    if not many:
        return None, False
    apart = rows.join(repeated.select("doc_id", "a"), "doc_id").select("a", F.col("comp").alias("b")).filter("a < b").distinct()
    return components(apart).select(F.col("node").alias("comp"), F.col("comp").alias("whole")), True


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    num: int = 3,
    den: int = 4,
    group_bytes: int = 2 << 20,
    bucket_hashes: int = 400_000,
    count_links: bool = True,
    block_sets: int = 512,
    block_shingles: int = 500_000,
) -> DataFrame:
    """One row per document: n_shingles, component_id (the smallest doc_id reachable
    over links of Jaccard similarity >= num/den), class_id (the smallest doc_id
    with an equal set), class_size and, if ``count_links``, n_links (how many other
    rows are linked with it, equal sets among them)."""
    keyed = keyed_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(_LAST)))
    sets = settle(_shingle_sets(keyed, width, num, den, group_bytes, bucket_hashes))
    known = sets.filter(F.col("sig").isNotNull())
    classes = settle(known.groupBy("sig").agg(F.min("doc_id").alias("node"), F.count("*").alias("class_size")))
    of_class = Window.partitionBy("sig", "doc_id").orderBy("n")
    # a class's set is that of its smallest doc_id; repeated rows of that id carry the same one
    reps, _ = sized(
        known.join(classes.select("sig", F.col("node").alias("doc_id")), ["sig", "doc_id"])
        .withColumn("k", F.row_number().over(of_class)).filter("k = 1")
        .select(F.col("doc_id").alias("node"), "sig", "n", "toks", "freq"),
        4_000_000, "n",
    )
    small = boundary([(r["top"], r["subsets"], r["scans"]) for r in _costs(reps, num, den).collect()])
    labels = _links(reps, _entries(reps, small, num, den), num, den)
    if labels is None:
        placed = classes.withColumn("comp", F.col("node"))
    else:
        placed = classes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    whole, merged = _of_repeated_ids(known, sets.filter(F.col("sig").isNull()), placed)
    linked = F.lit(0).cast("long")
    if count_links:
        placed = placed.join(_link_counts(reps, classes, labels, num, den, block_sets, block_shingles), "sig", "left")
        linked = F.col("class_size") - 1 + F.coalesce("links", F.lit(0))
    grouped = known.select("doc_id", "n", "sig").join(placed, "sig").select("doc_id", "n", "comp", F.col("node").alias("class"), "class_size", linked.alias("n_links"))
    alone = sets.filter(F.col("sig").isNull()).select("doc_id", "n", F.col("doc_id").alias("comp"), F.col("doc_id").alias("class"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    rows = grouped.unionByName(alone)
    if merged:
        rows = rows.join(whole, "comp", "left").withColumn("comp", F.coalesce("whole", "comp")).drop("whole")
    known_id = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return rows.select(
        known_id("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), known_id("comp").alias("component_id"), known_id("class").alias("class_id"), "class_size", *["n_links"] * count_links
    )
