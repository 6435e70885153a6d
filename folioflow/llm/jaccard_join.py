"""N-gram Jaccard join of whole documents: a prefix join over groups of documents, exact at the threshold.

1. ``first_pass``: each text's set of word 5-grams as 62-bit hashes; texts with equal sets are one *node*.
2. Hot shingles (those that a task meets often, summed over all tasks) go to the end of the order that the
   prefixes follow. Any order gives the same links; this one keeps passages that many documents share, out of
   the prefixes. The table of hot shingles is bounded by HOT_SHINGLES.
3. Nodes of equal size and equal prefix are one *group*; only groups enter the index (shingle, group).
4. Stars: each posting list links its members to its smallest and largest group only, and each group its nodes
   to one node. A list never emits all its pairs. Of each node there is a bit map, the parities of its shingles in
   some buckets; where two maps differ in more bits than two sets that link may differ in shingles, the pair goes.
   What is left is verified on the sets, nearest pairs first, and gives first components.
5. Again with each member of a list and the next in size, for lists of several components.
6. What is left: pairs in one list whose components differ, counted from the smaller components' side, where sizes,
   hot shingles and parities allow a link; these are verified. Prefixes that reach into the hot shingles hold all
   others of their sets: of those, only the ones with a list can be shared with another such set. A pair inside one
   component needs no check, so no link is lost for the components.
7. Components of all verified links. Names of nodes and groups are 63 of 128 bits of a hash; the few that stand for
   two things are found by the other bits and named by these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, drop_staged, give_back, stage, text_or_empty
from .components import components

WORDS = 5
#: Links: PER * intersection >= NEED * union.
NEED, PER = 75, 100
HOT_IN_TASK, HOT_IN_ALL, HOT_SHINGLES = 4, 64, 500_000
CHUNK_SHINGLES = 2_000_000
#: Texts whose prefixes are put into one frame.
FRAME_TEXTS = 400
#: Rounds of stars, and the share of tried pairs that must link for one more. They only decide when pairs are verified.
ROUNDS, LEAST_GAIN = 6, 0.05
#: 64-bit words of parities that rows of the join of lists carry at most.
JOIN_WORDS = 16
_FOLDED = "transform(slice({x}, 1, int(size({x}) / 2)), (v, i) -> v ^ {x}[i + int(size({x}) / 2)])"
_LIKE = "if(size({x}) > size({y}), " + _FOLDED + ", {x})"
#: ``parities_apart`` of two columns whose sizes differ by one doubling at most.
BITS_APART = f"aggregate(zip_with({_LIKE.format(x='ax', y='bx')}, {_LIKE.format(x='bx', y='ax')}, (u, v) -> bit_count(u ^ v)), 0, (s, v) -> s + v)"
#: Bit of a hot shingle in the common order.
HOT_BIT = 1 << 62
#: Fixed odd multipliers of the five places of a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
#: Bytes hashed at a time; a cut falls on white space, so words stay whole and memory does not grow with a text.
HASH_BYTES = 1 << 20
_LETTERS = np.random.default_rng(0x5EED).integers(0, 1 << 64, 4096, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(folded: bytes) -> np.ndarray:
    """64-bit hash of each word: its bytes times random numbers of their places, summed and mixed."""
    global _LETTERS
    chars = np.frombuffer(folded, np.uint8)
    inside = chars != 32
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
    lengths = np.diff(np.concatenate([first, [len(at)]]))
    longest = int(lengths.max())
    if longest > len(_LETTERS):
        _LETTERS = np.random.default_rng(0x5EED).integers(0, 1 << 64, 2 * longest, np.uint64)
    place = at - np.repeat(at[first], lengths)
    sums = np.add.reduceat(_LETTERS[place] * chars[at].astype(np.uint64), first)
    return mixed(sums + lengths.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def batch_shingles(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 62-bit hashes of the 5-word shingles of each UTF-8 text; A-Z lower-cased.

    Words are runs of bytes other than \\x20 and \\x09-\\x0D. A text of fewer words is one shingle, its whole
    sequence; a text without words has none.
    """
    out, start = [], 0
    while start < len(texts):
        size, stop = 0, start
        while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= HASH_BYTES):
            size += len(texts[stop]) + 1
            stop += 1
        folded = b" ".join(texts[start:stop]).translate(_FOLD)
        if stop == start + 1 and len(folded) > HASH_BYTES:
            parts, at = [], 0
            while at < len(folded):
                cut = folded.find(b" ", at + HASH_BYTES)
                cut = len(folded) if cut < 0 else cut
                parts.append(word_hashes(folded[at:cut]))
                at = cut
            words, counts = np.concatenate(parts), [sum(map(len, parts))]
        else:
            words = word_hashes(folded)
            ends = np.cumsum([len(t) + 1 for t in texts[start:stop]]) - 1
            chars = np.frombuffer(folded, np.uint8) != 32
            begins = np.flatnonzero(chars & np.concatenate([[True], ~chars[:-1]])) if len(chars) else np.empty(0, np.int64)
            counts = np.diff(np.concatenate([[0], np.searchsorted(begins, ends)])).tolist()
        n = max(0, len(words) - WORDS + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(WORDS):
            rolled += words[k : k + n] * PLACES[k]
        rolled = mixed(rolled) >> np.uint64(2)
        at = 0
        for c in counts:
            if c >= WORDS:
                s = np.sort(rolled[at : at + c - WORDS + 1])
                s = s[np.concatenate([[True], s[1:] != s[:-1]])].astype(np.int64)
            elif c:
                s = (mixed((words[at : at + c] * PLACES[:c]).sum(keepdims=True) + np.uint64(c)) >> np.uint64(2)).astype(np.int64)
            else:
                s = np.empty(0, np.int64)
            out.append(s)
            at += c
        start = stop
    return out


def shingles(text: bytes) -> np.ndarray:
    return batch_shingles([text])[0]


def keys_of(x: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """Two 63-bit halves of a 128-bit hash: the name of a set or prefix, and what tells apart two of one name."""
    h = xxhash.xxh3_128_intdigest(x.tobytes(), seed=seed)
    return (h & (1 << 64) - 1) >> 1, h >> 65


def named(keys: tuple[int, int], twins: frozenset) -> int:
    return keys[1] if keys[0] in twins else keys[0]


def parity(found: np.ndarray) -> bytes:
    """A bit for each of 4 to 8 buckets a shingle: whether an odd number of the set's shingles falls there."""
    bits = max(64, 1 << (4 * len(found) - 1).bit_length())
    return np.packbits((np.bincount(found & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sig: np.ndarray, size: int) -> np.ndarray:
    """The parities of the same set in fewer buckets."""
    while len(sig) > size:
        sig = sig[: len(sig) // 2] ^ sig[len(sig) // 2 :]
    return sig


def parities_apart(a: bytes, b: bytes) -> int:
    """Buckets of different parity: never more than the shingles that only one of both sets has."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def prefix_size(n: int) -> int:
    return n - -(-NEED * n // PER) + 1


def rows_of(names: list[str], other: str):
    """Brings a frame to the columns ``names``: nullable longs, but ``other``."""

    def whole(df: pd.DataFrame) -> pd.DataFrame:
        absent = pd.arrays.IntegerArray(np.zeros(len(df), np.int64), np.ones(len(df), bool))
        cols = {c: (df[c].astype(object) if c in df else pd.Series([None] * len(df), dtype=object)) if c == other else (df[c].astype("Int64") if c in df else absent) for c in names}
        return pd.DataFrame(cols)

    return whole


def first_pass(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One reading of all texts: a row (doc_id, t, n_shingles, node, check) each, and rows (token, k) of shingles met
    HOT_IN_TASK times in a run of sets. t: a hash of the text; node and check: ``keys_of`` the set, null without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, seen = [], 0, set()

        def often() -> pd.DataFrame:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            at = counts >= HOT_IN_TASK
            return whole(pd.DataFrame({"token": values[at], "k": counts[at]}))

        for batch in batches:
            made, nodes = batch_shingles(batch["_text"].tolist()), []
            for found in made:
                nodes.append(keys_of(found) if len(found) else (pd.NA, pd.NA))
                if len(found) and nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    held.append(found)
                    size += len(found)
            out = pd.DataFrame({"doc_id": batch["doc_id"], "t": batch["t"], "n_shingles": [len(x) for x in made], "node": pd.array([x[0] for x in nodes], dtype="Int64"), "check": pd.array([x[1] for x in nodes], dtype="Int64")})
            yield whole(out)
            if size >= CHUNK_SHINGLES:
                yield often()
                held, size, seen = [], 0, set()
        if held:
            yield often()
        give_back()

    names = ["doc_id", "t", "n_shingles", "node", "check", "token", "k"]
    whole = rows_of(names, "doc_id")
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("t"), text_or_empty(text_col).cast("binary").alias("_text"))
    return stage(rows.mapInPandas(run, "doc_id string, t long, n_shingles long, node long, check long, token long, k long"), "first-pass")


def hot_shingles(first: DataFrame) -> np.ndarray:
    often = first.filter("token IS NOT NULL").groupBy("token").agg(F.sum("k").alias("n"))
    top = often.filter(F.col("n") >= HOT_IN_ALL).orderBy(F.desc("n"), "token").limit(HOT_SHINGLES).select("token").toPandas()
    return np.sort(top["token"].to_numpy(np.int64))


def prefix_of(found: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order: by hash, hot ones last (HOT_BIT)."""
    p = prefix_size(len(found))
    if len(hot):
        at = np.searchsorted(hot, found)
        is_hot = hot[np.minimum(at, len(hot) - 1)] == found
        if is_hot.any():
            found = np.concatenate([found[~is_hot], found[is_hot] | HOT_BIT])
    return found[:p]


def group_index(docs: DataFrame, text_col: str, hot, node_twins: frozenset, group_twins: frozenset) -> DataFrame:
    """Rows of members (grp, gcheck, node, n, mx, p, hot, sig) without token and of the index (token, grp), each once a task at least.

    mx: the last shingle of the prefix in the common order; hot: hot shingles of the set if the prefix reaches them,
    else null; sig: ``parity``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, groups = set(), set()
        for part in (batch["_text"].iloc[at : at + FRAME_TEXTS].tolist() for batch in batches for at in range(0, len(batch), FRAME_TEXTS)):
            tokens, head = [], []
            for found in batch_shingles(part):
                if not len(found) or (node := named(keys_of(found), node_twins)) in seen:
                    continue
                seen.add(node)
                prefix = prefix_of(found, hot.value)
                keys = keys_of(prefix, len(found))
                grp = named(keys, group_twins)
                rows = 0
                if grp not in groups:
                    groups.add(grp)
                    tokens.append(prefix)
                    rows = len(prefix)
                plain = int(np.searchsorted(prefix, HOT_BIT))
                head.append((grp, keys[1], node, len(found), int(prefix[-1]), len(prefix), len(found) - plain if plain < len(prefix) else None, parity(found), rows))
            if head:
                h = pd.DataFrame(head, columns=["grp", "gcheck", "node", "n", "mx", "p", "hot", "sig", "rows"])
                yield whole(h.drop(columns="rows"))
                if tokens:
                    yield whole(pd.DataFrame({"token": np.concatenate(tokens), "grp": np.repeat(h["grp"].to_numpy(), h["rows"])}))
        give_back()

    names = ["token", "grp", "gcheck", "node", "n", "mx", "p", "hot", "sig"]
    whole = rows_of(names, "sig")
    texts = docs.select(text_or_empty(text_col).cast("binary").alias("_text"))
    return stage(texts.mapInPandas(run, "token long, grp long, gcheck long, node long, n long, mx long, p long, hot long, sig binary"), "prefixes")


def twins_of(table: DataFrame, name: str, check: str) -> frozenset:
    """Names that stand for two things. Of x things there are about x * x / 2^64: under a hundred thousand for 10^12."""
    apart = table.groupBy(name).agg(F.min(check).alias("x"), F.max(check).alias("y")).filter("x <> y")
    return frozenset(r[0] for r in apart.select(name).collect())


def near(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose parities allow a link, with d, the parities apart."""

    @F.pandas_udf("long")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([parities_apart(a, b) for a, b in zip(x, y, strict=True)], dtype="int64")

    side = lambda x: sigs.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"{PER} * least(na, nb) >= {NEED} * greatest(na, nb)")
    return both.withColumn("d", apart("sa", "sb")).filter(FEW_APART.format(d="d", na="na", nb="nb")).select("a", "b", "d")


#: Sets a and b link if they differ in at most (PER - NEED) / (PER + NEED) of |a| + |b|.
FEW_APART = f"{PER + NEED} * {{d}} <= {PER - NEED} * ({{na}} + {{nb}})"


class Sets:
    """The shingle sets of nodes, made again from one text of each and staged when they are first asked for."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, twins: frozenset):
        self.docs, self.nodes, self.id_col, self.text_col, self.twins = docs, nodes, id_col, text_col, twins
        self.found: DataFrame | None = None
        self.parts: list[DataFrame] = []

    def of(self, wanted: DataFrame) -> DataFrame:
        """node, s of the nodes of ``wanted`` (node), and maybe of others."""
        twins = self.twins

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made = batch_shingles(batch["_text"].tolist())
                yield pd.DataFrame({"node": [named(keys_of(x), twins) if len(x) else 0 for x in made], "s": made})
            give_back()

        if self.found is not None:
            wanted = wanted.join(self.found.select("node"), "node", "left_anti")
        wanted = stage(self.nodes.join(wanted, "node", "left_semi").select("node", "rep.*"), "wanted")
        n = wanted.count()
        if n:
            keys = wanted.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"))
            if n <= BROADCAST_ROWS:
                keys = F.broadcast(keys)
            docs = self.docs.select(F.col(self.id_col).alias("_i"), F.xxhash64(text_or_empty(self.text_col)).alias("_x"), text_or_empty(self.text_col).cast("binary").alias("_text"))
            made = docs.join(keys, (F.col("_x") == F.col("_t")) & F.col("_i").eqNullSafe(F.col("_id")), "left_semi").select("_text").mapInPandas(run, "node long, s array<long>")
            made = stage(made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
            self.parts.append(made)
            self.found = made if self.found is None else self.found.union(made)
        drop_staged(wanted)
        return self.found

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs`` (a, b: nodes; a staged table) whose sets link."""
        if pairs.isEmpty():
            return pairs.select("a", "b")
        sets = self.of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        same = F.size(F.array_intersect("sa", "sb"))
        linked = both.filter(PER * same >= NEED * (F.size("sa") + F.size("sb") - same))
        return stage(linked.select("a", "b"), "linked")

    def drop(self) -> None:
        drop_staged(*self.parts)


def may_link(na, nb, pa, pb, ma, mb, shared):
    """Upper bound of the intersection from shared prefix shingles; whoever's prefix ends first bounds its rest."""
    rest = F.when(ma <= mb, na - pa).otherwise(nb - pb)
    return ((NEED + PER) * (shared + rest) >= NEED * (na + nb)) & (PER * F.least(na, nb) >= NEED * F.greatest(na, nb))


def star_links(rays: DataFrame, sets: Sets, comps: DataFrame | None = None) -> DataFrame:
    """Components (node, comp) of ``comps`` and links among ``rays`` (a, b, d): each round every component tries its nearest ray."""
    spent = []
    for _ in range(ROUNDS):
        left = rays.select("a", "b", "d", F.col("a").alias("ca"), F.col("b").alias("cb"))
        if comps is not None:
            for x in "ab":
                of = comps.select(F.col("node").alias(x), F.col("comp").alias("_c"))
                left = left.join(of, x, "left").withColumn(f"c{x}", F.coalesce("_c", x)).drop("_c")
        left = stage(left.filter("ca <> cb").select("a", "b", "d", "ca", "cb"), "left")
        drop_staged(*spent)
        ends = left.select(F.col("ca").alias("c"), "a", "b", "d").union(left.select("cb", "a", "b", "d"))
        tried = stage(ends.groupBy("c").agg(F.min(F.struct("d", "a", "b")).alias("r")).select("r.a", "r.b").distinct(), "tried")
        found = sets.verified(tried)
        gained, n = found.count(), tried.count()
        spent = [left, tried]
        if gained:
            links = found if comps is None else found.union(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))
            older, comps = comps, components(links)
            drop_staged(found, *([older] if older is not None else []))
        if gained <= LEAST_GAIN * n:
            break
        rays = left.join(tried, ["a", "b"], "left_anti")
    drop_staged(*spent)
    return comps if comps is not None else components(sets.nodes.selectExpr("node a", "node b").limit(0))


def linked_nodes(docs: DataFrame, nodes: DataFrame, hot_values: np.ndarray, id_col: str, text_col: str, twins: frozenset) -> DataFrame:
    """Components (node, comp) of nodes under verified links."""
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(hot_values)
    group_twins: frozenset = frozenset()
    while True:
        prefixes = group_index(docs, text_col, hot, twins, group_twins)
        members = stage(prefixes.filter("token IS NULL").drop("token").dropDuplicates(["node"]), "members")
        more = twins_of(members.filter(~F.col("grp").isin(*group_twins)) if group_twins else members, "grp", "gcheck")
        if not more:
            break
        group_twins |= more
        drop_staged(prefixes, members)
    index = prefixes.filter("token IS NOT NULL").select("token", "grp")
    group = stage(members.groupBy("grp").agg(F.first("n").alias("n"), F.first("mx").alias("mx"), F.first("p").alias("p"), F.first("hot").alias("hot"), F.min("node").alias("lead")), "groups")
    # Aggregate, join and distinct all use this one exchange.
    index = index.repartition("token")
    ends = index.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo <> hi")
    lists = stage(index.join(ends.hint("merge"), "token").distinct(), "lists")
    drop_staged(prefixes)
    sets = Sets(docs, nodes, id_col, text_col, twins)

    # Stars: each member of a list with its ends, each node of a group with its first.
    side = lambda x: group.select(*[F.col(c).alias(f"{x}_{c}") for c in ("grp", "n", "mx", "p", "lead")])
    rays = lists.select(F.col("grp").alias("a_grp"), F.col("lo").alias("b_grp")).union(lists.select("grp", "hi")).filter("a_grp <> b_grp")
    rays = rays.groupBy("a_grp", "b_grp").agg(F.count(F.lit(1)).alias("c")).join(side("a"), "a_grp").join(side("b"), "b_grp")
    bound = may_link(*[F.col(c) for c in ("a_n", "b_n", "a_p", "b_p", "a_mx", "b_mx", "c")])
    between = rays.filter(bound).select(F.col("a_lead").alias("a"), F.col("b_lead").alias("b"))
    within = members.join(group.select("grp", "lead"), "grp").filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    rays = stage(near(between.union(within).selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), members), "rays")
    comps = star_links(rays, sets)

    # before: the token ahead of this one among the group's listed ones. Two groups of equal tokens there meet there too,
    # so a pair meets only where they differ, which holds at the first token that both have.
    order = Window.partitionBy("grp").orderBy("token")
    listing = lists.select("token", "grp").withColumn("before", F.coalesce(F.lag("token").over(order), F.lit(-1)))

    def left_between() -> tuple[DataFrame, DataFrame]:
        """Units (members of one group in one component), and the rows of lists that hold several components."""
        units = stage(members.select("grp", "node", "n").join(comps, "node", "left").select("grp", "node", "n", F.coalesce("comp", "node").alias("comp")), "units")
        held = listing.join(units.groupBy("grp", "comp").agg(F.min("n").alias("n"), F.min("node").alias("node")), "grp")
        several = held.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("token")
        return units, stage(held.join(several, "token", "left_semi"), "held")

    units, held = left_between()
    # More stars: in such lists each unit and the next in size.
    sized = Window.partitionBy("token", F.floor(F.log2("n"))).orderBy("n", "grp", "comp")
    pairs = held.select("node", "comp", F.lag("node").over(sized).alias("b"), F.lag("comp").over(sized).alias("other")).filter("comp <> other")
    pairs = pairs.selectExpr("least(node, b) a", "greatest(node, b) b").distinct()
    older, comps = comps, star_links(stage(near(pairs, members), "neighbours"), sets, comps)
    if older is not comps:
        drop_staged(units, held)
        units, held = left_between()
    # What is left: pairs of units in lists of several components.
    listed = lists.filter(F.col("token") < HOT_BIT).groupBy("grp").agg(F.count(F.lit(1)).alias("listed"))
    sizes = group.select("grp", "n", "hot").join(listed, "grp", "left").fillna(0, ["listed"])

    @F.pandas_udf("array<long>")
    def short(sig: pd.Series) -> pd.Series:
        return sig.map(lambda s: folded(np.frombuffer(s, np.int64), JOIN_WORDS))

    alone = units.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).filter("k = 1")
    met_units = held.select("grp", "comp").distinct()
    marks = alone.join(met_units, ["grp", "comp"], "left_semi").join(members.select("node", "sig"), "node").select("grp", "comp", short("sig").alias("bits"))
    info = stage(met_units.join(marks, ["grp", "comp"], "left").join(sizes, "grp"), "unit-info")
    major = held.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"))
    # Both sides of the join use this one exchange.
    marked = held.drop("n", "node").join(info, ["grp", "comp"]).join(major, "token").repartition("token")
    a = marked.filter("comp <> major").selectExpr("token", "before a_before", "grp a_grp", "comp a_comp", "n an", "listed al", "hot ah", "bits ax")
    b = marked.selectExpr("token", "before b_before", "grp b_grp", "comp b_comp", "n bn", "listed bl", "hot bh", "bits bx", "comp = major b_major")
    met = a.join(b, "token").filter(
        "a_comp <> b_comp AND (a_before <> b_before OR a_before = -1) AND (b_major OR (a_grp, a_comp) < (b_grp, b_comp))"
        f" AND {PER} * least(an, bn) >= {NEED} * greatest(an, bn)"
        f" AND (ah IS NULL OR bh IS NULL OR {NEED + PER} * (least(al, bl) + least(ah, bh)) >= {NEED} * (an + bn))"
        f" AND (ax IS NULL OR bx IS NULL OR {FEW_APART.format(d=BITS_APART, na='an', nb='bn')})"
    )
    # One row for a pair of units, whichever side was the smaller in a list.
    met = met.selectExpr(
        "if(a_grp < b_grp, a_grp, b_grp) a_grp", "if(a_grp < b_grp, a_comp, b_comp) a_comp",
        "if(a_grp < b_grp, b_grp, a_grp) b_grp", "if(a_grp < b_grp, b_comp, a_comp) b_comp",
    )
    met = met.filter("a_grp <> b_grp").distinct()
    # Inside one group the prefixes are equal: units of different components all meet, but where equal sizes are too
    # small for two different sets to link.
    group_comps = units.filter(f"{PER + NEED} * (n - 1) >= {2 * NEED} * n").select("grp", "comp").distinct()
    split = group_comps.groupBy("grp").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("grp")
    parts = group_comps.join(split, "grp", "left_semi")
    inside = parts.select(F.col("grp").alias("a_grp"), F.col("comp").alias("a_comp")).join(
        parts.select(F.col("grp").alias("b_grp"), F.col("comp").alias("b_comp")), F.expr("a_grp = b_grp AND a_comp < b_comp")
    )
    member = lambda x: units.select(F.col("grp").alias(f"{x}_grp"), F.col("comp").alias(f"{x}_comp"), F.col("node").alias(x))
    rest = met.unionByName(inside).join(member("a"), ["a_grp", "a_comp"]).join(member("b"), ["b_grp", "b_comp"]).select("a", "b")
    rest = stage(near(rest, members), "rest")
    second = sets.verified(rest.select("a", "b"))
    # The first links are there as one link from each node to its component.
    out = components(second.union(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
    sets.drop()
    drop_staged(members, group, lists, rays, comps, units, held, info, rest, second)
    hot.unpersist()
    return out


def near_duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t (xxhash64 of the text, null as empty), n_shingles and first (absent, doc_id, t) of every row.

    ``first`` names the row that stands for the component: the smallest id there, its smallest t; null without words.
    """
    bounded_batches(docs.sparkSession)
    found = first_pass(docs, id_col, text_col)
    digests = found.filter("n_shingles IS NOT NULL").select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "t", "n_shingles", "node", "check")
    twins = twins_of(digests.filter("node IS NOT NULL"), "node", "check")
    if twins:
        digests = digests.withColumn("node", F.when(F.col("node").isin(*twins), F.col("check")).otherwise(F.col("node")))
    row = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "t")
    nodes = stage(digests.filter("node IS NOT NULL").groupBy("node").agg(F.min(row).alias("rep")), "nodes")
    comps = linked_nodes(docs.select(id_col, text_col), nodes, hot_shingles(found), id_col, text_col, twins)
    named = nodes.select("node", "rep").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    roots = named.join(comps.select("comp").distinct(), "comp", "left_semi").groupBy("comp").agg(F.min("rep").alias("root"))
    of_node = named.join(roots, "comp", "left").select("node", F.coalesce("root", "rep").alias("first"))
    return digests.join(of_node, "node", "left").select("doc_id", "t", "n_shingles", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, component_id (smallest id reachable by links, itself included) for every row.

    Null, empty and wordless texts have 0 shingles and stand alone. Repeated rows and ties share a component.
    Rows with a null id link like others and bridge; they take the component's smallest id (null if all its ids are).
    Other columns are not read. An empty table gives an empty result. Ids may be of any orderable type.
    """
    rows = near_duplicate_rows(docs, id_col, text_col)
    return rows.select(F.col("doc_id").alias(id_col), "n_shingles", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the smallest id's, nulls last; texts without words all stay.

    Rows go by id and text together, so another text under the same id is judged on its own. Of repeated rows one stays.
    """
    rows = stage(near_duplicate_rows(docs, id_col, text_col), "near-rows")
    stays = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t")))
    gone = rows.filter(~stays).select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct()
    again = rows.filter(F.col("first").isNotNull() & stays).groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").drop("_k")
    on = lambda df: docs[id_col].eqNullSafe(df["_id"]) & (F.xxhash64(text_or_empty(docs[text_col])) == df["_t"])
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    again = stage(again, "repeated")
    if again.isEmpty():
        return docs.join(small(gone), on(gone), "left_anti")
    one = docs.join(small(again), on(again), "left_semi").dropDuplicates([id_col, text_col])
    other = stage(gone.union(again), "not-plain")
    return docs.join(small(other), on(other), "left_anti").unionByName(one)
