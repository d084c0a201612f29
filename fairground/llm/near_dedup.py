"""Near-duplicate documents by a chosen-path set similarity join over word shingles."""

from __future__ import annotations

from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairground.llm.common import Forest, connected_components, groups_in_order, minhashes, named, scratch, seeds, shingle_hashes, small_batches, whole

#: Independent trees, and minwise tokens of a document from which paths choose; the first TREES of
#: them are the first choices of the trees. At Jaccard 0.75 one tree's first choice misses a pair with
#: probability 1/4, TREES of them with 1.5e-5.
TREES, TOKENS = 8, 48
#: Rows that meet in a task. Nodes up to WHOLE times this size are compared exhaustively, block against
#: block; larger ones branch again, as often as _replicas() says.
LEAF, WHOLE = 2048, 4
#: Shingles of the rows that meet in a task: long texts make smaller blocks.
LEAF_SHINGLES = 4_000_000
#: Levels after which what is left of a large node is compared block against block, whatever its size.
LEVELS = 8
#: Of 1/similarity branches wanted at each node, the share of nodes that take a second one.
SECOND_BRANCH = 3
#: Bound on the chance that no leaf holds a pair of the wanted similarity.
MISS = 1e-4


def _missed(depth: int, replicas: int, similarity: float) -> float:
    """The chance that no leaf holds a pair of this similarity if its first nodes all branch to this depth.

    A branching process for each number of equal tokens that the pair can have, since all paths of a
    pair choose among the same tokens."""
    n = TOKENS - TREES
    equal = np.arange(n + 1) / n
    weight = np.array([comb(n, i) * similarity**i * (1 - similarity) ** (n - i) for i in range(n + 1)])
    second, lost = (1 - 1 / n) / SECOND_BRANCH, np.zeros(n + 1)
    for _ in range(depth):
        branch = 1 - equal + equal * lost
        lost = (1 - second) * branch + second * branch**2
    return float((weight * (1 - similarity + similarity * lost**replicas) ** TREES).sum())


def _replicas(depth: int, similarity: float) -> int:
    """How often every large first node has to branch anew for MISS to hold at this depth."""
    n = 1
    while depth and _missed(depth, n, similarity) > MISS:
        n += 1
    return n


#: Equal tokens that a pair needs to be worth an exact comparison: 25 of 48 when the similarity is
#: 0.75, 3.7 standard deviations below the mean.
def _least_tokens(similarity: float) -> int:
    return int(TOKENS * similarity - 3.7 * (TOKENS * similarity * (1 - similarity)) ** 0.5)


_PROFILE = "doc_id long, rep binary, n long, tokens array<int>"


def _digests(texts: pa.Array, k: int) -> tuple[list[bytes | None], list[np.ndarray]]:
    """A 128-bit digest of every text's word sequence (none without words), and its shingles."""
    shingles, words, bounds = shingle_hashes(texts, k)
    return [xxhash.xxh3_128_digest(words[a:b].tobytes()) if b > a else None for a, b in zip(bounds, bounds[1:], strict=False)], shingles


def _profiles(batches, k: int):
    mult = seeds(TOKENS)
    for batch in batches:
        reps, shingles = _digests(batch.column(1), k)
        held = [i for i, rep in enumerate(reps) if rep is not None]
        tokens: list = [None] * len(reps)
        for i, own in zip(held, minhashes([shingles[i] for i in held], mult).view(np.int32), strict=True):
            tokens[i] = own
        n = [len(np.unique(s)) for s in shingles]
        yield pa.record_batch({"doc_id": batch.column(0), "rep": pa.array(reps, pa.binary()), "n": pa.array(n, pa.int64()), "tokens": pa.array(tokens, pa.list_(pa.int32()))})


def profiles(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rep (a 128-bit digest of the word sequence, null without words), the number of shingles,
    the minwise tokens."""
    small_batches(docs.sparkSession)
    rows = docs.select(named(docs, id_col).cast("long").alias("doc_id"), named(docs, text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_profiles, k=k), _PROFILE)


def _partners(tree: int, tokens: np.ndarray, n: np.ndarray, big: np.ndarray, side: np.ndarray, least: int, similarity: float):
    """For each row of a leaf the later rows worth an exact comparison here: enough equal tokens, sizes
    that allow the similarity, not of the same of two blocks (side; -1 in a leaf of one block), and no
    earlier tree that compares both by its first choice."""
    for i in range(len(n) - 1):
        same = tokens[i + 1 :] == tokens[i]
        ok = (same.sum(1) >= least) & (np.minimum(n[i + 1 :], n[i]) >= similarity * np.maximum(n[i + 1 :], n[i]))
        if side[i] >= 0:
            ok &= side[i + 1 :] != side[i]
        if not ok.any():
            continue
        earlier = TREES if tree < 0 else tree
        if earlier:
            small = ((big[i + 1 :, None] >> np.arange(earlier)) & 1) == 0
            ok &= ~(same[:, :earlier] & small).any(1)
        hits = np.flatnonzero(ok)
        if len(hits):
            yield i, hits + i + 1


def _screen(batches, similarity: float):
    """Leaves in, clusters out: the rows that have a partner in their leaf, named by the smallest row
    that such partners connect them with."""
    least = _least_tokens(similarity)
    out = {c: [] for c in _CLUSTERED}
    for g in groups_in_order(batches, "leaf", ["leaf", "tree", "rep", "doc", "n", "big", "side", "tokens"]):
        if len(g["rep"]) < 2:
            continue
        forest = Forest(len(g["rep"]))
        tokens = np.array(g["tokens"], dtype=np.int32)
        for i, js in _partners(g["tree"][0], tokens, np.array(g["n"]), np.array(g["big"]), np.array(g["side"]), least, similarity):
            for j in js.tolist():
                forest.join(i, j)
        roots = [forest.root(i) for i in range(len(g["rep"]))]
        sizes = np.bincount(roots)
        for i, r in enumerate(roots):
            if sizes[r] > 1:
                out["cluster"].append(f"{g['leaf'][0]}:{g['rep'][r].hex()}")
                for c in ("rep", "doc", "tree", "big", "side"):
                    out[c].append(g[c][i])
        if len(out["rep"]) > 4096:
            yield _screened(out)
            out = {c: [] for c in out}
    yield _screened(out)


_CLUSTERED = {"cluster": pa.string(), "rep": pa.binary(), "doc": pa.int64(), "tree": pa.int32(), "big": pa.int32(), "side": pa.int32()}


def _screened(out: dict) -> pa.RecordBatch:
    return pa.record_batch({c: pa.array(out[c], kind) for c, kind in _CLUSTERED.items()})


def _confirm(batches, k: int, similarity: float):
    """Clusters with texts in, a forest of confirmed links out: Jaccard on the full sets.

    Texts come by the id of one of their documents; those of other texts with the same id are left out."""
    least, mult = _least_tokens(similarity), seeds(TOKENS)
    num, den = round(similarity * 100), 100

    def with_sets():
        for batch in batches:
            reps, shingles = _digests(batch.column("text"), k)
            right = [i for i, (rep, own) in enumerate(zip(batch.column("rep").to_pylist(), reps, strict=True)) if rep == own]
            own = pa.array([np.unique(shingles[i]).tobytes() for i in right], pa.large_binary())
            yield batch.select(["cluster", "tree", "rep", "big", "side"]).take(pa.array(right, pa.int64())).append_column("set", own)

    a, b = [], []
    for g in groups_in_order(with_sets(), "cluster", ["cluster", "tree", "rep", "big", "side", "set"]):
        rows = list({rep: i for i, rep in enumerate(g["rep"])}.values())
        sets = [np.frombuffer(g["set"][i], dtype=np.uint64) for i in rows]
        n, tokens = np.array([len(s) for s in sets]), minhashes(sets, mult).view(np.int32)
        big, side = np.array([g["big"][r] for r in rows]), np.array([g["side"][r] for r in rows])
        # what is kept of a pair are two numbers and a count: a block's pairs may be millions
        pairs = [(np.full(len(js), i, np.int32), js.astype(np.int32), (tokens[js] == tokens[i]).sum(1, dtype=np.int8)) for i, js in _partners(g["tree"][0], tokens, n, big, side, least, similarity)]
        if not pairs:
            continue
        left, right, equal = (np.concatenate(x) for x in zip(*pairs, strict=True))
        del pairs
        # the likeliest first: they connect most rows, and what is connected needs no comparison
        likely = np.argsort(-equal, kind="stable").astype(np.int32)
        forest = Forest(len(rows))
        for i, j in ((int(left[p]), int(right[p])) for p in likely):
            if forest.root(i) == forest.root(j):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                forest.join(i, j)
                a.append(g["rep"][rows[i]])
                b.append(g["rep"][rows[j]])
    yield pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _compared(nodes: DataFrame) -> DataFrame:
    """leaf, tree, side, rep: every pair of a node's rows in exactly one leaf, which has at most about
    LEAF rows and LEAF_SHINGLES shingles (or two long texts)."""
    parts = F.greatest(F.col("rows") / LEAF, F.col("shingles") / LEAF_SHINGLES)
    blocks = F.when(parts > 1, F.least(F.ceil(2 * parts), "rows")).otherwise(1).cast("int")
    own = nodes.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    leaf = F.when(F.col("blocks") == 1, F.col("node")).otherwise(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    return paired.select(leaf.alias("leaf"), F.col("tree").cast("int").alias("tree"), side.cast("int").alias("side"), "rep")


def _branches(large: DataFrame, tokens: DataFrame) -> tuple[DataFrame | None, int]:
    """_compared() of what (node, rep) branch into, and the depth of the deepest."""
    leaves, depth = None, 0
    while not large.isEmpty():
        depth += 1
        # the node chooses tokens by its own hash, the same for all of its rows: one, or sometimes two
        pick = lambda i: F.pmod(F.xxhash64("node", F.lit(depth), F.lit(i)), F.lit(TOKENS - TREES)) + TREES  # noqa: E731, B023
        picks = F.when(F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(SECOND_BRANCH)) == 0, F.array(pick(0), pick(1))).otherwise(F.array(pick(0)))
        branched = large.withColumn("at", F.explode(F.array_distinct(picks))).join(tokens, "rep")
        branched = branched.select("rep", "n", F.xxhash64("node", F.lit(depth), "at", F.get("tokens", F.col("at").cast("int"))).alias("node"))
        branched = scratch(branched, "branches")
        counted = branched.groupBy("node").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).where("rows > 1")
        nodes = scratch(branched.join(counted, "node").withColumn("tree", F.lit(-1)), "nodes")
        end = depth == LEVELS
        found = _compared(nodes if end else nodes.where(F.col("rows") <= WHOLE * LEAF))
        leaves = found if leaves is None else leaves.union(found)
        if end:
            break
        large = nodes.where(F.col("rows") > WHOLE * LEAF).select("node", "rep")
    return leaves, depth


def _leaves(reps: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(leaf, tree, side, rep) of all trees, and (rep, big): in which trees its first node was too large."""
    first = reps.select("rep", "n", F.posexplode(F.slice("tokens", 1, TREES)).alias("tree", "token"))
    first = first.select("rep", "n", "tree", F.xxhash64("tree", "token").alias("node"))
    counted = first.groupBy("node").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).where("rows > 1")
    nodes = scratch(first.join(counted, "node"), "nodes")
    big = nodes.where(F.col("rows") > WHOLE * LEAF).groupBy("rep").agg(F.bit_or(F.expr("shiftleft(1, tree)")).alias("big"))
    leaves, tokens = _compared(nodes.where(F.col("rows") <= WHOLE * LEAF)), reps.select("rep", "n", "tokens")
    large = nodes.where(F.col("rows") > WHOLE * LEAF).select("node", "rep")
    # how often to branch is known by the depth that branching took
    done, depth = 0, 0
    while done < (need := _replicas(depth, similarity)):
        salted = F.explode(F.sequence(F.lit(done), F.lit(need - 1)))
        more, deep = _branches(large.select("rep", "node", salted.alias("salt")).select(F.xxhash64("node", "salt").alias("node"), "rep"), tokens)
        leaves = leaves if more is None else leaves.union(more)
        done, depth = need, max(depth, deep)
    return leaves, big


def near_links(docs: DataFrame, profiled: DataFrame, k: int = 5, similarity: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b: confirmed links between different word sequences, by their digests, enough of them to connect
    whatever the links found in a leaf connect (links within what is connected there are left out).

    profiled: profiles(docs), better a scratch table, since it is read several times."""
    usable = profiled.where(F.col("rep").isNotNull() & F.col("doc_id").isNotNull())
    reps = usable.groupBy("rep").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    reps = scratch(reps, "representatives")
    leaves, big = _leaves(reps, similarity)
    known = reps.join(big, "rep", "left").select("rep", "doc", "n", F.coalesce("big", F.lit(0)).alias("big"), "tokens")
    rows = leaves.join(known, "rep").select("leaf", "tree", "side", "rep", "doc", "n", F.col("big").cast("int").alias("big"), "tokens")
    rows = rows.repartition("leaf").sortWithinPartitions("leaf")
    clusters = scratch(rows.mapInArrow(partial(_screen, similarity=similarity), "cluster string, rep binary, doc long, tree int, big int, side int"), "clusters")
    texts = docs.select(named(docs, id_col).cast("long").alias("doc"), named(docs, text_col).cast("string").alias("text"))
    # neither side of these joins has a size bound, so none is broadcast, at any size
    wanted = texts.join(clusters.select("doc").distinct().hint("merge"), "doc", "left_semi")
    grouped = clusters.hint("merge").join(wanted, "doc").select("cluster", "tree", "rep", "big", "side", "text").repartition("cluster").sortWithinPartitions("cluster")
    return grouped.mapInArrow(partial(_confirm, k=k, similarity=similarity), "a binary, b binary")


def _groups(docs: DataFrame, profiled: DataFrame, k: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """rep, component (the least digest that links reach), for digests with links."""
    found = connected_components(near_links(docs, profiled, k, similarity, id_col, text_col), name="near")
    return found.select(F.col("node").alias("rep"), "component")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Words `[^\\x20\\x09-\\x0D]+` after lowering A-Z; a document's set is its distinct k-word shingles
    over the whole text, with fewer words the whole sequence. Two documents are linked if the Jaccard
    similarity of their sets is `similarity` or more; component_id is the smallest id reachable.

    Documents of the same word sequence are one representative, named by a digest of it, so a group of
    copies of any size is one row of the join. Representatives go down TREES independent trees: a node's
    rows are split by the value of a minwise token that the node chooses; nodes of at most WHOLE * LEAF
    rows are screened by their equal tokens, block against block, and confirmed on the full sets. A pair
    is confirmed in the first tree that compares both. No more than about LEAF texts, or LEAF_SHINGLES
    shingles, meet in a task at once. Larger nodes branch, so often that no leaf holds a pair with
    probability MISS at most; what is left after LEVELS levels is compared block against block.

    Rows with null or blank text have an empty set, are linked with nothing and kept. A null id stays
    null, is linked with nothing and kept. Rows with the same id, whatever their texts, share their
    component. An empty table gives an empty result. Other columns are ignored."""
    profiled = scratch(profiles(docs, k, id_col, text_col), "profiles")
    groups = _groups(docs, profiled, k, similarity, id_col, text_col)
    usable = profiled.where(F.col("rep").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "rep").distinct()
    grouped = usable.join(groups, "rep", "left").select("doc_id", "rep", F.coalesce("component", "rep").alias("component"))
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("least"))
    mapped = scratch(grouped.join(least, "component").select("doc_id", "rep", "least"), "mapped")
    # an id of several texts joins their groups
    several = mapped.groupBy("doc_id").agg(F.min("least").alias("a"), F.max("least").alias("b")).where("a <> b")
    joined = mapped.join(several.select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    if not joined.isEmpty():
        ends = connected_components(joined.where("a <> b"), name="ids")
        mapped = mapped.join(ends, mapped.least == ends.node, "left").select("doc_id", "rep", F.coalesce("component", "least").alias("least"))
    by_id = mapped.groupBy("doc_id", "rep").agg(F.min("least").alias("least"))
    out = profiled.join(by_id, ["doc_id", "rep"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _with_digest(batches, k: int):
    for batch in batches:
        reps, _ = _digests(batch.column(1), k)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(reps, pa.binary()), batch.column(2)], names=["id", "text", "rep", "row"])


def deduplicated(docs: DataFrame, k: int = 5, similarity: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each group of linked word sequences the
    row with the smallest id stays, of equal ids and sequences the one with the smallest text. Rows
    without an id all stay, and of those without words one for each id. An id with several texts is judged
    text by text. Names of other columns may be anything; an empty table stays empty."""
    profiled = scratch(profiles(docs, k, id_col, text_col), "profiles")
    groups = _groups(docs, profiled, k, similarity, id_col, text_col)
    usable = profiled.where(F.col("rep").isNotNull() & F.col("doc_id").isNotNull())
    per = usable.groupBy("rep").agg(F.min("doc_id").alias("id")).join(groups, "rep", "left")
    first = per.groupBy(F.coalesce("component", "rep").alias("component")).agg(F.min(F.struct("id", "rep")).alias("first"))
    kept = scratch(first.select("first.id", "first.rep"), "kept")
    wordless = profiled.where(F.col("rep").isNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id")).distinct()
    twice = scratch(profiled.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "twice")
    rows = docs.select(named(docs, id_col).cast("long").alias("id"), named(docs, text_col).cast("string").alias("text"), whole(docs).alias("row"))
    stay = kept.select("id").union(wordless).distinct()
    once = rows.where("id IS NOT NULL").join(stay.hint("merge"), "id", "left_semi")
    if twice.isEmpty():
        return once.union(rows.where("id IS NULL")).select("row.*")
    alone = once.join(twice.hint("merge"), "id", "left_anti")
    schema = T.StructType([rows.schema["id"], rows.schema["text"], T.StructField("rep", T.BinaryType()), rows.schema["row"]])
    again = once.join(twice.hint("merge"), "id", "left_semi").mapInArrow(partial(_with_digest, k=k), schema)
    known = again.join(kept.hint("merge"), ["id", "rep"], "left_semi").union(again.where("rep IS NULL").select("id", "rep", "text", "row"))
    chosen = known.groupBy("id", "rep").agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row"))
    return alone.select("row").union(chosen.select("row")).union(rows.where("id IS NULL").select("row")).select("row.*")
