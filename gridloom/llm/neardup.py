"""Near-duplicate classes by MinHash with sequential Bayesian verification.

A text's set holds its distinct five-word shingles (words lower-cased from A to Z; with fewer words all of them as one; none
without words). Texts are linked if their sets' Jaccard similarity is at least PERCENT / 100, and a class is what links connect.

1. Each text gets a sketch: a key for each band of ROWS minima, and a signature of CHECKS further minima. Texts with the same
   set become one node, so that copies cost nothing from here on. Shingles are 64-bit hashes, sets are told apart by 128 bits.
2. Nodes that share a band's key are candidates. Within a bucket not all pairs are formed: the member that meets most others
   over all its buckets becomes the hub, and every member is compared with the hub.
3. A pair is compared by batches of BATCH signature values. After each batch it is dropped if the posterior probability that its
   similarity reaches the threshold (uniform prior) is below MISS. Survivors are verified on their full sets.
4. Links give first classes. Where the members of a hub fall into several classes, the pairs between classes are still open. With
   the difference D(x) between x's and the hub's sets, x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles. A link
   between classes therefore needs a common part of D(x) and D(y), which must show in the first elements of each (prefix filter,
   those that x has and the hub lacks first, then those that the hub has and x lacks, the rarer ones first of either kind).
   A hub with at most LOCAL_MEMBERS members and LOCAL_HASHES elements in their differences is settled by one task at once: the sizes of
   D(x), D(y) and of their common part give the similarity of x and y exactly. Steps 5 and 6 are for larger hubs.
5. An element that members of one class only hold sets them apart from all members of other classes. A member that is apart by
   too many of these from even the member that is least so is linked with no other class, and goes before any join. So pages of one
   template, each with words of its own, are settled by counting.
6. Members of a hub that share an element form a group. The groups of a hub form their pairs if these are at most PAIRS for each
   member in all of them, and they are compared as in 3. Else the member that is least apart becomes the new hub, all other open members
   are compared with it, and 4 to 6 start again with the new classes; each time PAIRS grows fourfold, so g members end after
   log4(g / PAIRS) rounds at most. No round makes more rows than PAIRS for each member and element, and no link that all pairs would
   find is lost.

A pair at the threshold t shares no band with probability (1 - t^ROWS)^bands: there are as many bands as it takes for MISS at most
(35 for 80 percent, 24 for 85). It is dropped in 3 with MISS at most.

Nulls: a null text counts as empty. Empty texts are linked with nothing. A row with a null id has no class (component_id null) and
is kept. Rows that share an id are one document. Extra columns are dropped; an empty table gives no rows. Texts of any length are
read whole: a worker holds one batch of Arrow (bounded in bytes by the session) and the sets of 64 texts.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .shared import Cache, cut, forget, parts

SHINGLE, PERCENT, ROWS = 5, 80, 5
CHECKS, BATCH = 96, 32
#: Chance that a pair at the threshold shares no band, at most; and the probability at which a pair is taken not to reach it.
MISS = 1e-6
WORDS = 300_000
#: Pairs for each member that a group may form before it gets a hub of its own; PAIRS_GROWTH times as many in each further round.
PAIRS, PAIRS_GROWTH = 16, 4

#: Open members of a hub, and hashes in all their differences from it, that one task settles (up to some 300 MB of a worker's memory).
LOCAL_MEMBERS, LOCAL_HASHES = 4096, 2_000_000
#: Elements with more holders are counted by a product of matrices, the others by listing their holders' pairs.
LISTED = 32

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def n_bands(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


class Sketcher:
    def __init__(self, shingle: int = SHINGLE, bands: int = 0):
        self.shingle, self.bands = shingle, bands
        self.word = Cache(xxhash.xxh3_64_intdigest, WORDS).__getitem__
        self.a, self.b = _constants(bands * ROWS + CHECKS)

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's set."""
        words = text.encode().lower().split()  # bytes: only A to Z change, only ASCII white space splits
        n = len(words)
        if n == 0:
            return np.empty(0, dtype=np.uint64)
        if n < self.shingle:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], dtype=np.uint64)
        h = np.fromiter(map(self.word, words), dtype=np.uint64, count=n)
        out = h[: n - self.shingle + 1]
        for k in range(1, self.shingle):
            out = out * _MIX[0] + h[k : n - self.shingle + 1 + k]
        return np.unique(_finish(out))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint64)
        for at in range(0, len(shingles), 1024):
            block = shingles[at : at + 1024, None] * self.a + self.b
            out = np.minimum(out, (block >> np.uint64(32)).min(axis=0))
        return out

    def sketch(self, text: str) -> tuple[int, bytes | None, bytes | None, list[int] | None]:
        """Set size, digest of the set, signature (16-bit values), keys of the bands."""
        s = self.shingles(text)
        if not len(s):
            return 0, None, None, None
        m = self.minima(s)
        keys = m[: self.bands * ROWS].reshape(self.bands, ROWS)
        key = np.arange(self.bands, dtype=np.uint64)
        for k in range(ROWS):
            key = _finish(key * _MIX[0] + keys[:, k])
        return len(s), xxhash.xxh3_128_digest(s.tobytes()), m[self.bands * ROWS :].astype("<u2").tobytes(), key.view(np.int64).tolist()


def least_matches(percent: int, checks: int = CHECKS, batch: int = BATCH, miss: float = MISS) -> list[int]:
    """For each batch: the fewest matches so far with which a pair stays. With a uniform prior, the posterior probability of a
    similarity of t or more after m matches in n is the chance of at most m hits in n + 1 draws of probability t."""
    t, out = percent / 100, []
    for n in range(batch, checks + 1, batch):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, percent: int, shingle: int) -> DataFrame:
    """id, n, digest, signature, bands for each row."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sketcher(shingle, n_bands(percent))
        for batch in parts(batches):
            made = list(zip(*map(s.sketch, batch.column("text").to_pylist()), strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))], names=["id", "n", "digest", "signature", "bands"])

    return texts.mapInArrow(run, "id long, n long, digest binary, signature binary, bands array<long>")


def _unlikely_dropped(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b (and what comes with them) that the sequential test leaves."""
    least = least_matches(percent)
    sides = [signatures.select(F.col("node").alias(x), F.col("signature").alias(f"signature_{x}")) for x in "ab"]
    joined = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", "signature_a", "signature_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(f"signature_{k}").to_pylist()), dtype="<u2").reshape(-1, CHECKS) for k in "ab")
            left, matches = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
            for k, m in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (x[left, part] == y[left, part]).sum(axis=1)
                stay = matches >= m
                left, matches = left[stay], matches[stay]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(left)) for k in "ab"], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long").distinct()


class _Recent(OrderedDict):
    """Sets of the texts seen last."""

    def __init__(self, make, most: int = 64):
        super().__init__()
        self.make, self.most = make, most

    def of(self, text: str) -> np.ndarray:
        if text in self:
            self.move_to_end(text)
            return self[text]
        if len(self) >= self.most:
            self.popitem(last=False)
        self[text] = out = self.make(text)
        return out


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    sides = [texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Pairs a, b whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = _Recent(Sketcher(shingle).shingles)
        for batch in parts(batches):
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)):
                x, y = recent.of(x), recent.of(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in "ab"], names=["a", "b"])

    return _with_texts(pairs.select("a", "b"), texts).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _differences(members: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """members: node, hub -> node, hub, n (set size), n_hub, own (how many hashes the node has and the hub lacks), d (these, then those
    that the hub has and the node lacks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = _Recent(Sketcher(shingle).shingles)
        for batch in parts(batches):
            sizes, hubs, owns, out = [], [], [], []
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                x, y = recent.of(x), recent.of(y)
                own = np.setdiff1d(x, y, assume_unique=True)
                sizes.append(len(x))
                hubs.append(len(y))
                owns.append(len(own))
                out.append(np.concatenate([own, np.setdiff1d(y, x, assume_unique=True)]).view(np.int64))
            made = [*(pa.array(v, pa.int64()) for v in (sizes, hubs, owns)), pa.array(out, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *made], names=["node", "hub", "n", "n_hub", "own", "d"])

    joined = _with_texts(members.select(F.col("node").alias("a"), F.col("hub").alias("b")), texts)
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "node long, hub long, n long, n_hub long, own long, d array<long>")


def _shared(e: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """m x m: how many elements two members have in common. e, x: elements and their holders, in the order of e."""
    out = np.zeros((m, m), dtype=np.float32)
    _, start, df = np.unique(e, return_index=True, return_counts=True)
    for k in np.unique(df[(df > 1) & (df <= LISTED)]):
        first, second = np.triu_indices(k, 1)
        starts, step = start[df == k], max(1, (1 << 20) // len(first))
        for at in range(0, len(starts), step):
            held = x[starts[at : at + step, None] + np.arange(k)]
            key, n = np.unique(held[:, first].astype(np.int64).ravel() * m + held[:, second].ravel(), return_counts=True)
            np.add.at(out, (key // m, key % m), n.astype(np.float32))
    many = np.flatnonzero(df > LISTED)
    out += out.T
    for at in range(0, len(many), 1024):
        part = many[at : at + 1024]
        rows = np.concatenate([x[start[k] : start[k] + df[k]] for k in part])
        held = np.zeros((m, len(part)), dtype=np.float32)
        held[rows, np.repeat(np.arange(len(part)), df[part])] = 1
        out += held @ held.T
    return out


def local_links(node: np.ndarray, group: np.ndarray, n: np.ndarray, differ: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different classes (group), as many as it takes to join all classes that links between these members join.
    differ: what each member's set, of size n, differs in from the same set."""
    slack = (100 - percent) / (100 + percent)
    size = np.array([len(d) for d in differ], dtype=np.int64)
    _, group = np.unique(group, return_inverse=True)
    _, e = np.unique(np.concatenate(differ), return_inverse=True)
    x = np.repeat(np.arange(len(node)), size)
    least, most = np.full(len(e), len(node)), np.full(len(e), -1)
    np.minimum.at(least, e, group[x])
    np.maximum.at(most, e, group[x])
    common = (least < most)[e]  # held in several classes: linked members differ in all others
    apart = size - np.bincount(x[common], minlength=len(node)) - slack * n
    by_class = np.full(group.max() + 1, np.inf)
    np.minimum.at(by_class, group, apart)
    best, second = np.append(np.argsort(by_class, kind="stable"), [0, 0])[:2], np.append(np.sort(by_class), np.inf)[:2]
    open_ = apart + np.where(group == best[0], second[1], second[0]) <= 1e-6
    left = np.flatnonzero(open_)
    if len(left) < 2:
        return []
    place = np.cumsum(open_) - 1
    common &= open_[x]
    order = np.lexsort((x[common], e[common]))
    both = _shared(e[common][order], place[x[common][order]], len(left))
    node, group, n, size, out = node[left], group[left], n[left], size[left], []
    for i in range(len(left)):
        apart_i = size[i] + size - 2 * both[i].astype(np.int64)
        meet = (n[i] + n - apart_i) // 2  # a whole number: the sizes of two sets differ from that of their difference by an even one
        linked = (100 * meet >= percent * (n[i] + n - meet)) & (group != group[i])
        while linked.any():
            j = int(np.argmax(linked))
            out.append((min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))))
            group[group == group[j]] = group[i]
            linked &= group != group[i]
    return out


def _local(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: links between classes within each hub, for hubs whose members one task can hold."""

    def run(table: pa.Table) -> pa.Table:
        node, group, n = (table.column(c).to_numpy() for c in ("node", "class", "n"))
        d = table.column("d").combine_chunks()
        values, ends = d.flatten().to_numpy(), np.concatenate([[0], np.cumsum(d.value_lengths().to_numpy())])
        links = local_links(node, group, n, [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return rows.select("hub", "node", "class", "n", "d").groupBy("hub").applyInArrow(run, "a long, b long")


def _settle_local(members: DataFrame, texts: DataFrame, percent: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """members: node, hub, class, home. Links a, b between classes within the hubs that one task can hold; the members of the others."""
    rows = cut(_differences(members.select("node", "hub"), texts, shingle).join(members, ["node", "hub"]))
    sizes = rows.groupBy("hub").agg(F.count("*").alias("members"), F.sum(F.size("d").cast("long")).alias("hashes"))
    large = cut(sizes.where((F.col("members") > LOCAL_MEMBERS) | (F.col("hashes") > LOCAL_HASHES)).select("hub"))
    links = cut(_local(rows.join(large, "hub", "left_anti"), percent))
    rest = cut(members.join(large, "hub", "left_semi"))
    forget(rows, large)
    return links, rest


def _open_groups(members: DataFrame, texts: DataFrame, percent: int, shingle: int, per_member: float) -> tuple[DataFrame, DataFrame]:
    """members: node, hub, class, home (the hub's class). Of the members that may still be linked with one of another class (steps 4 and
    5), those of hubs whose groups have at most per_member pairs for each member, by the elements e that they share: hub, e, node, class, n,
    alone, rest, rank (place of e); and those of the other hubs, with the next hub: node, hub."""
    t = percent / 100
    slack = (1 - t) / (1 + t)  # linked sets differ in at most slack * (|a| + |b|) shingles
    rows = cut(_differences(members, texts, shingle).join(members, ["node", "hub"]))
    size = F.size("d").cast("double")
    near = size <= slack * (F.col("n") + F.col("n_hub"))
    most = slack * (1 + 1 / t) * F.col("n")  # the most that n and the size of any partner allow
    # fewest common elements with a partner of another class: a pair has a member that is not linked with the hub
    fewest = F.greatest(F.lit(1.0), F.when(near, F.ceil(size * (1 - slack) / 2 - 1e-6)).otherwise(F.ceil(size - most - 1e-6)).cast("double"))
    held = rows.withColumn("prefix", (size - fewest + 1).cast("long")).where("prefix > 0")
    elements = held.select("hub", "node", "class", "prefix", "n", "own", F.size("d").cast("long").alias("size"), "home", F.posexplode("d").alias("at", "e"))
    holders = elements.groupBy("hub", "e").agg(F.count("*").alias("df"), F.min("class").alias("least"), F.max("class").alias("most"))
    shared = elements.join(holders.where("least < most").select("hub", "e", "df"), ["hub", "e"])
    rank = F.row_number().over(W.partitionBy("hub", "node").orderBy(F.col("at") >= F.col("own"), "df", "e"))
    alone = F.col("size") - F.count("*").over(W.partitionBy("hub", "node"))  # elements of this class only come first
    shared = shared.withColumns({"rank": rank, "alone": alone}).where(F.col("rank") + F.col("alone") <= F.col("prefix"))
    # linked members differ in all elements that only one of their classes has
    apart = F.col("alone") - slack * F.col("n")
    found = cut(shared.select("hub", "e", "node", "class", (F.col("class") == F.col("home")).alias("at_home"), "n", "alone", (F.col("size") - F.col("alone")).alias("rest"), "rank", apart.alias("apart")))
    by_class = found.groupBy("hub", "e", "class", "at_home").agg(F.count("*").alias("c"), F.min(F.struct("apart", "node")).alias("first"))
    squared = lambda c: c.cast("double") * c
    pairs = (squared(F.sum("c")) - F.sum(squared(F.col("c")))) / 2
    least = lambda at_home: F.min(F.when(F.col("at_home") == at_home, F.col("first.apart")))
    groups = by_class.groupBy("hub", "e").agg(F.sum("c").alias("members"), pairs.alias("pairs"), F.min("first").alias("first"), least(True).alias("home"), least(False).alias("away")).where("pairs > 0")
    groups = cut(groups)
    hubs = cut(groups.groupBy("hub").agg(F.max(F.col("pairs") > F.col("members") * per_member).alias("large"), F.min("first").alias("first"), F.min("home").alias("home"), F.min("away").alias("away")))
    other = F.when(F.col("at_home"), F.col("away")).otherwise(F.least("home", "away"))  # the least apart of any in another class, at most
    still = F.col("apart") + other <= 1e-6
    settled = groups.join(hubs.where("not large").select("hub"), "hub").select("hub", "e", "home", "away")
    small = cut(found.join(settled, ["hub", "e"]).where(still).drop("apart", "at_home", "home", "away"))
    each = found.select("hub", "node", "at_home", "apart").distinct()  # one row for each member, not for each element
    large = each.join(hubs.where("large").select("hub", F.col("first.node").alias("next"), "home", "away"), "hub").where(still & (F.col("node") != F.col("next")))
    again = cut(large.select("node", F.col("next").alias("hub")).distinct())
    forget(rows, found, groups, hubs)
    return small, again


def _pairs(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of different classes within the groups that may still be linked."""
    t = percent / 100
    a, b = (groups.select("hub", "e", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "alone", "rest", "rank", "class"))) for k in "ab")
    differ = (F.col("node_a") < F.col("node_b")) & (F.col("class_a") != F.col("class_b"))
    # at the first element that they share, they can share no more than those from there on (at a later one the pair is known already)
    shared = 1 + F.least(F.col("rest_a") - F.col("rank_a"), F.col("rest_b") - F.col("rank_b"))
    apart = F.col("alone_a") + F.col("rest_a") + F.col("alone_b") + F.col("rest_b") - 2 * shared
    fits = apart <= (1 - t) / (1 + t) * (F.col("n_a") + F.col("n_b")) + 1e-6
    return a.join(b, ["hub", "e"]).where(differ & fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _hubs(buckets: DataFrame) -> DataFrame:
    """buckets: key, node, size -> node, hub: each member of a bucket with the one that meets most others in all its buckets."""
    meets = buckets.groupBy("node").agg(F.sum("size").alias("meets"))
    hubs = buckets.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", (-F.col("node")).alias("least"))).alias("m")).select("key", (-F.col("m.least")).alias("hub"))
    return buckets.join(hubs, "key").where("node != hub").select("node", "hub").distinct()


def _open_members(members: DataFrame, classes: DataFrame) -> DataFrame:
    """node, hub, class, home (the hub's class) for the members of the hubs whose members fall into several classes."""
    homes = members.select("hub").distinct().join(classes.select(F.col("node").alias("hub"), F.col("component").alias("home")), "hub", "left").select("hub", F.coalesce("home", "hub").alias("home"))
    classed = members.join(classes.select("node", "component"), "node", "left").select("node", "hub", F.coalesce("component", "node").alias("class"))
    classed = cut(classed.join(homes, "hub"))
    several = classed.groupBy("hub").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most")
    out = cut(classed.join(several.select("hub"), "hub", "left_semi"))
    forget(classed)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """id_col, n_shingles, component_id, kept for each row. Ids are integers."""
    drawn = cut(sketches(docs, id_col, text_col, percent, shingle))
    nodes = cut(drawn.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("node"), F.first("signature").alias("signature"), F.first("bands").alias("bands")))

    keys = nodes.select("node", F.explode("bands").alias("key"))
    crowded = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = cut(keys.join(crowded, "key"))
    members = cut(_hubs(buckets))

    involved = members.select("node").unionByName(members.select(F.col("hub").alias("node"))).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = cut(texts.join(involved.hint("merge"), "node", "left_semi"))  # the same plan at every size
    signatures = nodes.select("node", "signature")

    def linked(pairs: DataFrame) -> DataFrame:
        likely = cut(_unlikely_dropped(pairs, signatures, percent))
        links = cut(_verified(likely, texts, percent, shingle))
        forget(likely)
        return links

    links = linked(members.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    final = components(links)
    used, most = [buckets, links, members], PAIRS
    while not members.isEmpty():
        still = _open_members(members, final)
        used.append(still)
        if still.isEmpty():
            break
        found, rest = _settle_local(still, texts, percent, shingle)
        used += [found, rest]
        if rest.isEmpty():
            if not found.isEmpty():
                final = components(final.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
            break
        groups, again = _open_groups(rest, texts, percent, shingle, most)
        pairs = cut(_pairs(groups, percent).unionByName(again.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))).distinct())
        more = linked(pairs)
        used += [groups, pairs, again, more]
        members, most = again, most * PAIRS_GROWTH
        more = more.unionByName(found)
        if not more.isEmpty():
            final = components(final.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    forget(*used, texts)

    classes = nodes.select("digest", "node").join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = drawn.select("id", "n", "digest").join(classes, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that stand for their class: one for each class, every row with a null id. Of rows that share an
    id, the one whose columns have the least hash stays."""
    kept = near_duplicates(docs, id_col, text_col, percent).where(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    names = [f"c{k}" for k in range(len(docs.columns))]
    hashed = [F.col(n) for n, f in zip(names, docs.schema, strict=True) if "map<" not in f.dataType.simpleString()]
    rows = docs.toDF(*names).select(F.struct(*names).alias("row"), F.xxhash64(*hashed).alias("hash"), F.col(names[docs.columns.index(id_col)]).cast("long").alias("id"))
    known = rows.where("id is not null").join(kept.hint("merge"), "id", "left_semi").groupBy("id").agg(F.min_by("row", "hash").alias("row"))
    return known.select("row.*").unionByName(rows.where("id is null").select("row.*")).toDF(*docs.columns)
