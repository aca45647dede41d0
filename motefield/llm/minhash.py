"""MinHash near-dedup with an LSH forest.

Each document's set of word shingles gives ``PERMUTATIONS`` min-hashes. Documents with equal sets are one
node from there on. Every tree of the forest is one sorted order of the nodes, by a label of ``DEPTH``
min-hashes of its own; it is cut into ranges for the tasks. Neighbours in an order that share a prefix of
at least ``SHALLOW`` values are candidates. Depth adapts per region: a region of at most ``LEAF`` nodes gives
all its pairs; a larger one is split by the next value, down to the whole label, where each node meets its
next neighbours. With 24 trees a pair at similarity 0.85 shares four values in some tree with
1 - (1 - 0.85^4)^24 > 0.999 999 98 (at 0.8: 0.999 996). Such a pair is a candidate if one of those regions has at most
``LEAF`` nodes. A larger region may part it, so the nodes of all larger regions that hold several groups once the
forest's links are made (`crowded`) meet again by their rarest shingles (`rare_pairs`). That is exact: no
pair of such nodes that reaches the share is missing from these candidates.

Candidates whose set sizes or min-hashes rule the share out are dropped (`_likely`). The others are confirmed on
full shingle sets, in two rounds so that large groups of copies stay cheap: first each node with its most
frequent partner, then every candidate between groups that are still apart. A candidate inside one group needs
no check, as it cannot change the groups; so no link is lost that the forest or the rare shingles find.

Null and empty texts, and texts without words, have the empty set and are linked with nothing. Rows with a
null id are not linked either: their component is null and they are kept. Rows that repeat an id are one
node and share the verdict.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motefield.llm.common import NOT_SPACE, Texts, expand, gram_hashes, mix, per_text, slices, staged
from motefield.llm.components import components, merged

PERMUTATIONS, TREES, DEPTH, SHALLOW, LEAF, NEXT = 128, 24, 12, 4, 16, 3
#: bits of the shingle counters; rows of a shingle that go under one salt, and salts at most
COUNTERS, HOT, SALTS = 20, 512, 64


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    factors = rng.integers(1 << 62, (1 << 63) - 1, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
    slots = np.stack([np.concatenate([np.arange(t * 5, t * 5 + 5), rng.permutation(PERMUTATIONS)])[:DEPTH] for t in range(TREES)])
    return factors, slots


def shingle_sets(texts: Texts, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text; all words as one where there are fewer."""
    w = texts.lower().words(NOT_SPACE)
    h = w.hashes()
    whole = gram_hashes(h, n)
    short = {m: gram_hashes(h, m) for m in range(1, n)}
    out = []
    for a, c in zip(w.first.tolist(), w.count.tolist()):
        out.append(np.unique(whole[a: a + c - n + 1]) if c >= n else short[c][a: a + 1] if c else whole[:0])
    return out


def signatures(docs: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """``id, n_shingles, d1, d2, sig``: set size, 128 bits of set digest, min-hashes (16 bits of each)."""

    def make():
        factors, _ = _constants()

        def fn(texts, batch):
            sets = shingle_sets(texts, shingle)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            sig = np.zeros((len(sets), PERMUTATIONS), np.uint16)
            if len(full):
                flat = np.concatenate(sets)
                at = (np.cumsum(sizes) - sizes)[full]
                for k, f in enumerate(factors):
                    low = np.minimum.reduceat(flat * f, at)
                    low ^= low >> np.uint64(29)
                    sig[full, k] = (low * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)
            digest = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            return {"id": batch.column(id_col).cast(pa.int64()), "n_shingles": pa.array(sizes), "d1": pa.array(digest[:, 0].copy()),
                    "d2": pa.array(digest[:, 1].copy()), "sig": pa.array([s.tobytes() for s in sig], pa.binary())}

        return fn

    return per_text(docs.select(id_col, F.col(text).cast("string").alias(text)), make, "id long, n_shingles long, d1 long, d2 long, sig binary", text, rows=False)


def _pairs_in(labels: np.ndarray, ids: np.ndarray, tree: np.ndarray):
    """Candidate pairs of rows sorted by (tree, label)."""
    n = len(ids)
    left, right = [], []
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = (labels[1:] == labels[:-1]) & (tree[1:] == tree[:-1])[:, None]
    lcp = np.where(same.all(1), DEPTH, np.argmin(same, 1))
    for step in range(1, NEXT + 1):  # neighbours: the prefix shared over several rows is the least in between
        near = lcp[: n - step].copy()
        for k in range(1, step):
            near = np.minimum(near, lcp[k: n - step + k])
        at = np.flatnonzero(near >= SHALLOW)
        left.append(at), right.append(at + step)
    todo = [(0, n, SHALLOW)]
    while todo:
        lo, hi, depth = todo.pop()
        cut = np.flatnonzero(lcp[lo: hi - 1] < depth) + lo + 1
        starts, ends = np.concatenate([[lo], cut]), np.concatenate([cut, [hi]])
        size = ends - starts
        for s, e in zip(starts[size > NEXT + 1].tolist(), ends[size > NEXT + 1].tolist()):
            if e - s <= LEAF:
                i, j = np.triu_indices(e - s, NEXT + 1)
                left.append(i + s), right.append(j + s)
            elif depth < DEPTH:
                todo.append((s, e, depth + 1))
    a, b = ids[np.concatenate(left)], ids[np.concatenate(right)]
    return np.minimum(a, b), np.maximum(a, b)


def _labels(batch: pa.RecordBatch):
    labels = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u2").reshape(-1, DEPTH)
    return labels, batch.column("id").to_numpy(), batch.column("tree").to_numpy()


def candidates(nodes: DataFrame) -> DataFrame:
    """``a, b, c``: pairs the forest proposes, and in how many places. ``nodes``: ``id, sig``."""

    def plant(batches):
        _, slots = _constants()
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, PERMUTATIONS)
                for t in range(TREES):
                    own = sig[:, slots[t]].astype(">u2")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), t, np.int8)), pa.array([x.tobytes() for x in own], pa.binary()), batch.column("id")], ["tree", "label", "id"])

    def walk(batches):
        """Pairs of a sorted range (kind 0), and its first and last rows (1 and 2) to meet the next ranges."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        open_, head, last = None, [], None

        def rows(table, kind):
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(table), pa.int8()), pa.array([part] * len(table), pa.int32()),
                                               table["id"].combine_chunks(), table["id"].combine_chunks(), table["tree"].combine_chunks(), table["label"].combine_chunks()],
                                              ["kind", "part", "a", "b", "tree", "label"])

        def pairs(table):
            batch = table.combine_chunks().to_batches()[0]
            a, b = _pairs_in(*_labels(batch))
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, part, np.int32)), pa.array(a), pa.array(b),
                                               pa.array(np.zeros(n, np.int8)), pa.nulls(n, pa.binary())], ["kind", "part", "a", "b", "tree", "label"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if len(head) < LEAF:
                head += table.slice(0, LEAF - len(head)).to_pylist()
                if len(head) == LEAF or True:
                    first = table.schema
            open_ = table if open_ is None else pa.concat_tables([open_, table])
            labels, _, tree = _labels(open_.combine_chunks().to_batches()[0])
            cut = np.flatnonzero((labels[1:, :SHALLOW] != labels[:-1, :SHALLOW]).any(1) | (tree[1:] != tree[:-1]))
            if len(cut):
                yield pairs(open_.slice(0, cut[-1] + 1))
                last = open_.slice(max(0, cut[-1] + 1 - LEAF), min(LEAF, cut[-1] + 1))
                open_ = open_.slice(cut[-1] + 1)
        if open_ is not None:
            yield pairs(open_)
            tail = open_ if last is None else pa.concat_tables([last, open_])
            yield rows(pa.Table.from_pylist(head, first), 1)
            yield rows(tail.slice(max(0, len(tail) - LEAF)), 2)

    def meet(table: pa.Table) -> pa.Table:
        order = table.sort_by([("tree", "ascending"), ("label", "ascending"), ("a", "ascending")]).rename_columns(
            ["id" if c == "a" else c for c in table.column_names]).combine_chunks()
        a, b = _pairs_in(*_labels(order.to_batches()[0]))
        return pa.table({"a": a, "b": b})

    forest = nodes.select("id", "sig").mapInArrow(plant, "tree byte, label binary, id long")
    order = forest.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    walked = staged(order.mapInArrow(walk, "kind byte, part int, a long, b long, tree byte, label binary"), "forest")
    edges = walked.where("kind > 0")
    ranks = edges.select("part").distinct().withColumn("r", F.row_number().over(Window.orderBy("part")))  # one row per range
    met = edges.join(F.broadcast(ranks), "part").withColumn("gap", F.col("r") - F.when(F.col("kind") == 1, 1).otherwise(0))
    across = met.select("gap", "a", "tree", "label").groupBy("gap").applyInArrow(meet, "a long, b long")
    return walked.where("kind = 0").select("a", "b").union(across).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))


def crowded(nodes: DataFrame, top: DataFrame) -> DataFrame:
    """``id, comp``: nodes of regions of ``SHALLOW`` values that hold more than ``LEAF`` nodes and several groups
    of ``top``. ``nodes``: ``id, sig``."""

    def plant(batches):
        _, slots = _constants()
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, PERMUTATIONS)
                for t in range(TREES):
                    own = np.ascontiguousarray(sig[:, slots[t][:SHALLOW]]).view(np.int64)[:, 0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), t, np.int8)), pa.array(own), batch.column("id"), batch.column("comp")], ["tree", "label", "id", "comp"])

    named = nodes.select("id", "sig").join(top.select(F.col("u").alias("id"), "v"), "id", "left").select("id", "sig", F.coalesce("v", "id").alias("comp"))
    spots = named.mapInArrow(plant, "tree byte, label long, id long, comp long")
    regions = spots.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    regions = staged(regions.where((F.col("n") > LEAF) & (F.col("x") < F.col("y"))).select("tree", "label"), "regions")
    return spots.join(regions, ["tree", "label"], "left_semi").select("id", "comp").distinct()


def rare_pairs(texts: DataFrame, shingle: int, share: int) -> DataFrame:
    """``a, b, c``: pairs of different groups that share one of their rarest shingles, and how many such. ``texts``:
    ``id, comp, _text``.

    Shingles have one order, by counters (of buckets of shingles, so no shingle is shuffled for it) and hash. In that order
    the first shingle that a pair at the share has in common is among the first n - ceil(t n) + 1 of the larger set and the
    first n - ceil(2 t n / (1 + t)) + 1 of the smaller one, and enough shingles follow it in both. Frequent shingles are
    salted: rows of the smaller side are dealt out, those of the larger side go to each salt.

    Shingles of one group only are left out before the match. Of the others, rows of the shingle's largest group meet only
    rows of other groups. As no group is larger, pairs within the rest are fewer than these, so at most about half of the
    rows made are of one group, however large the groups are.
    """
    shift = np.uint64(64 - COUNTERS)

    def tally(batches):
        total = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                for s in shingle_sets(Texts(part.column("_text")), shingle):
                    np.add.at(total, s >> shift, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    seen = texts.select("_text").mapInArrow(tally, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # 2^COUNTERS rows at most
    counts = np.zeros(1 << COUNTERS, np.int64)
    counts[seen["at"].to_numpy()] = seen["n"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def make():
        counts = shared.value

        def fn(own, batch):
            cols = [[], [], [], [], [], []]
            ids = batch.column("id").to_numpy()
            deal = mix(ids.view(np.uint64))
            for row, s in enumerate(shingle_sets(own, shingle)):
                n, c = len(s), counts[s >> shift]
                order = np.lexsort((s, c))[: n + share * n // -100 + 1]
                less = n + 2 * share * n // -(100 + share) + 1
                at = np.flatnonzero(c[order] > 1)  # a counter of one is a shingle of this text only
                token, salts = s[order[at]].view(np.int64), np.minimum((c[order[at]] - 1) // HOT + 1, SALTS)
                low = at < less
                every = np.repeat(np.arange(len(at)), salts)
                salt = np.concatenate([deal[row] % salts[low].astype(np.uint64), expand(np.zeros(len(at), np.int64), salts)])
                pick = np.concatenate([np.flatnonzero(low), every])
                small = np.arange(len(pick)) < low.sum()
                for col, v in zip(cols, (token[pick], salt, np.full(len(pick), row), np.full(len(pick), n), at[pick], small)):
                    col.append(v)
            token, salt, row, n, at, small = (np.concatenate(c) for c in cols)
            row = pa.array(row)
            return {"token": pa.array(token), "salt": pa.array(salt.astype(np.int32)), "id": batch.column("id").take(row), "comp": batch.column("comp").take(row),
                    "n": pa.array(n.astype(np.int64)), "rest": pa.array((n - at).astype(np.int64)), "small": pa.array(small)}

        return fn

    rows = staged(per_text(texts, make, "token long, salt int, id long, comp long, n long, rest long, small boolean", "_text", rows=False), "rare-shingles")
    sizes = rows.where("not small and salt = 0").groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"))
    shared_by = sizes.groupBy("token").agg(F.max(F.struct("n", "comp"))["comp"].alias("largest"), F.count(F.lit(1)).alias("groups"))
    rows = rows.join(staged(shared_by.where("groups > 1").select("token", "largest"), "shared-shingles"), "token").withColumn(
        "large", F.col("comp") == F.col("largest")).drop("largest")
    side = lambda small, k, *more: rows.where(F.col("small") == small).select(
        "token", "salt", *more, *[F.col(c).alias(f"{c}_{k}") for c in ("id", "comp", "n", "rest")])
    x = side(True, "x", F.col("large").alias("kind"))
    y = side(False, "y", F.explode(F.when(F.col("large"), F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))).alias("kind"))
    met = x.join(y, ["token", "salt", "kind"]).where(
        (F.col("comp_x") != F.col("comp_y")) & ((F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("id_x") < F.col("id_y"))))
        & (100 * F.col("n_x") >= share * F.col("n_y"))
        & ((100 + share) * F.least("rest_x", "rest_y") >= share * (F.col("n_x") + F.col("n_y"))))
    return met.groupBy(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).agg(F.count(F.lit(1)).alias("c"))


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, share: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets have 100 * intersection >= share * union. ``texts``: ``id, _text``."""

    def make():
        def fn(b_texts, batch):
            b_sets = shingle_sets(b_texts, shingle)
            a_sets = shingle_sets(Texts(batch.column("_a")), shingle)
            good = []
            for x, y in zip(a_sets, b_sets):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and 100 * both >= share * (len(x) + len(y) - both))
            mask = pa.array(good, pa.bool_())
            return {"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)}

        return fn

    left = texts.select(F.col("id").alias("a"), F.col("_text").alias("_a"))
    right = texts.select(F.col("id").alias("b"), F.col("_text").alias("_b"))
    return per_text(pairs.select("a", "b").join(right, "b").join(left, "a"), make, "a long, b long", "_b", rows=False)


def _likely(pairs: DataFrame, nodes: DataFrame, share: int) -> DataFrame:
    """Drops pairs that cannot reach the share: by set sizes (exact), and by min-hashes 6 deviations below it."""
    expect = share / 100
    least = int(PERMUTATIONS * expect - 6 * (PERMUTATIONS * expect * (1 - expect)) ** 0.5)

    def check(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, PERMUTATIONS) for c in ("_sa", "_sb"))
                keep = pa.array((x == y).sum(1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "c")], ["a", "b", "c"])

    side = lambda c: nodes.select(F.col("id").alias(c), F.col("sig").alias(f"_s{c}"), F.col("n_shingles").alias(f"_n{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.where(100 * F.least("_na", "_nb") >= share * F.greatest("_na", "_nb"))
    return both.select("a", "b", "c", "_sa", "_sb").mapInArrow(check, "a long, b long, c long")


def near_duplicates(docs: DataFrame, shingle: int = 5, share: int = 80, id_col: str = "doc_id", text: str = "text",
                    few: int = 1_000_000) -> DataFrame:
    """``id, n_shingles, component_id, kept`` per row: the least id reachable over confirmed links.

    ``few``: up to so many ids (8 bytes each) are broadcast to pick the texts that confirmation needs.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("_text"))
    sets = staged(signatures(texts, "id", "_text", shingle), "signatures")
    real = F.col("id").isNotNull() & (F.col("n_shingles") > 0)
    groups = staged(sets.where(real).groupBy("d1", "d2").agg(F.min("id").alias("node")), "equal-sets")
    members = staged(sets.where(real).join(groups, ["d1", "d2"]).select(
        "id", "n_shingles", "node", F.when(F.col("id") == F.col("node"), F.col("sig")).alias("sig")), "members")
    nodes = members.where("id = node").dropDuplicates(["id"])
    pairs = staged(_likely(candidates(nodes), nodes, share), "candidates")

    def chosen(ids, name):
        used = staged(ids, f"{name}-ids")
        n = used.count()
        mine = texts.join(F.broadcast(used) if n <= few else used, "id").dropDuplicates(["id"])
        return n, staged(mine, f"{name}-texts")

    def linked(top, pairs, mine):
        best = pairs.groupBy("b").agg(F.max(F.struct("c", -F.col("a"))).alias("x")).select((-F.col("x.col2")).alias("a"), "b")
        links = staged(confirmed(best, mine, shingle, share), "links")
        top = components(links) if top is None else merged(top, links)
        apart = pairs
        for c in ("a", "b"):
            at = top.select(F.col("u").alias(c), F.col("v").alias(f"_{c}"))
            apart = apart.join(at, c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
        return merged(top, staged(confirmed(apart.where("_a != _b"), mine, shingle, share), "links"))

    _, mine = chosen(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidate")
    top = linked(None, pairs, mine)
    n, mine = chosen(crowded(nodes, top), "crowd")
    if n:
        pairs = staged(_likely(rare_pairs(mine, shingle, share), nodes, share), "rare-pairs")
        top = linked(top, pairs, mine)
    named = members.select("id", "node").distinct().join(top, F.col("node") == F.col("u"), "left").groupBy("id").agg(
        F.min(F.coalesce("v", "node")).alias("component_id"))
    named = staged(named, "named")
    out = sets.select("id", "n_shingles").join(named, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
