"""N-gram Jaccard join by partitions of the universe, without all pairs of a group.

Sets whose similarity reaches 3/4 differ in few shingles: at most a seventh of both sizes
together. A hash deals all shingles into so many segments that two such sets must agree on one
of them exactly, or differ in one by a single shingle. Sizes fall into bands of a power of two
with a number of segments each. Every set files, for each segment, a hash of its shingles there,
and for the first few segments also the hashes with one shingle left out (the one-deletion
neighbourhood). A set meets others in its own band and, if they may be larger, in the next.

*Cost-based allocation.* A set has more segments than the pigeonhole needs. Once the number of
sets that share each filed hash is known for the whole corpus, a set drops its most shared ones
as far as the guarantee allows; leaving-one-out variants count double and let it drop more.

*No all pairs.* Equal sets are one set from the start. Each set is first verified against one
leader, which it shares most hashes with. What is linked then is one component, and only sets
of different components are compared further. In a large family of half-like sets these would
still be nearly all pairs; families are compared block by block, and only links that join two
components come out. So the components are those of all links, and no pair of a group of near
copies becomes a row.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SHINGLE, drop_stash, stash

#: Similarity as a fraction.
NUM, DEN = 3, 4
#: Sets below this size file each shingle as a segment of its own: no segment is empty then.
SMALL = 64
#: Deviations by which the expected number of filled segments exceeds what is needed.
MARGIN = 6.0
#: Share by which the filled segments of the largest size exceed what is needed, so that sets
#: can drop what many others share.
SPARE = 0.15
#: Similarity to its leader from which a set is of the leader's family, the size from which a
#: family is compared in blocks, and the shingles of a block.
FAMILY, CROWD, BLOCK = (2, 5), 64, 1 << 18
#: A key that more than this part of all rows share is looked up apart.
HEAVY = 10_000
#: Most 64-bit words of a set's parities (a power of two).
PARITY = 64
_MEMBER, _DELETED, _VISITOR, _SHORT, _WIDE = 1, 2, 4, 8, 16
#: The band stands above the marks.
_BAND = 5

_U = np.uint64
_M1, _M2, _P = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> _U(30))
    x *= _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


def _starts(s: np.ndarray) -> np.ndarray:
    """Where runs of equal values start in sorted ones."""
    new = np.ones(len(s), dtype=bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return np.flatnonzero(new)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles. Words are split at the six ASCII
    white-space characters, A-Z in lower case: what bytes.split and bytes.lower do."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(SHINGLE, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h *= _P
        h += w[k : len(w) - n + 1 + k]
    s = mix(h)
    s.sort()
    return s[_starts(s)]


def _spread(s: np.ndarray, seed: int = 0) -> np.ndarray:
    return mix(s + _U((seed + 1) * int(_P) % (1 << 64)))


def set_id(s: np.ndarray, seed: int = 0, spread: np.ndarray | None = None) -> int:
    """64 bits of a set: equal for equal sets. ``joined`` takes another seed if two sets share one."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        total = (_spread(s, seed) if spread is None else spread).sum(keepdims=True)
        return int(mix(mix(s.sum(keepdims=True) + _U(len(s))) + total).view(np.int64)[0])


def parities(s: np.ndarray, spread: np.ndarray | None = None) -> np.ndarray:
    """For classes of shingles whether the set has an odd number: at least four times as many
    classes as shingles, up to 64 * ``PARITY``. Each shingle that two sets differ in changes one bit, so
    sets differ in at least as many shingles as their parities in bits. Adding both halves gives
    the parities of half as many classes."""
    bits = 64 * min(PARITY, max(1, (4 << len(s).bit_length()) // 64))
    odd = np.bincount(((_spread(s) if spread is None else spread) & _U(bits - 1)).view(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def differ_at_most(n: int, m: int) -> int:
    """The most shingles that sets of n and m may differ in and still reach the similarity."""
    return (n + m) * (DEN - NUM) // (DEN + NUM)


@functools.cache
def plan(band: int) -> tuple[int, int]:
    """(segments, of which the first so many have one-deletion variants) of the sizes from
    2^band up to the next power: the cheapest pair by filed hashes whose guarantee holds with
    ``MARGIN`` deviations for the largest size. (0, 0): each shingle is a segment."""
    top = (2 << band) - 1
    if top < SMALL:
        return 0, 0
    need = differ_at_most(top, top) + 1
    best = (math.inf, 0, 0)
    for m in range(need, 2 * need):
        empty = math.exp(-top / m)
        one = empty * top / m
        filled = m * (1 - empty) - MARGIN * math.sqrt(m * empty)
        short = max(0.0, need - filled)
        u = math.ceil(short / max(1e-9, 1 - empty - one)) + 2
        if u <= m and m * (1 - empty) >= (1 + SPARE) * need:
            best = min(best, (m * (1 - empty) + u * top / m, m, u))
    return best[1], best[2]


def signatures(s: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, int, int, np.ndarray]:
    """(keys, flags, spare, doubled, wide) that a set files in a band: ``spare`` is how many of its
    segments it may drop (negative: it must count that many doubled), ``doubled`` how many
    segments with one-deletion variants it has, ``wide`` the places of their whole keys."""
    n, top = len(s), (2 << band) - 1
    need = differ_at_most(n, min(top, n * DEN // NUM)) + 1
    m, u = plan(band)
    seed = _U((band + 1) * int(_M2) % (1 << 64))
    if not m:
        return mix(s ^ seed).view(np.int64), np.zeros(n, dtype=np.int32), n - need, 0, np.zeros(0, dtype=np.int64)
    # In the order of the mixed values the segments stand in order, too.
    mixed = mix(s + seed)
    mixed.sort()
    segment, value = ((mixed >> _U(32)) * _U(m)) >> _U(32), mix(mixed ^ _P)
    starts = _starts(segment)
    sums, filled = np.add.reduceat(value, starts), segment[starts]
    sizes = np.diff(starts, append=n)
    sums += mix((filled + _U(1)) * _P + seed)
    keys = mix(sums)
    # The segments with variants are the first ones.
    k = int(np.searchsorted(filled, _U(u)))
    wide = np.flatnonzero(sizes[:k] >= 2)
    fewer = [mix(sums[i] - value[starts[i] : starts[i] + sizes[i]]) for i in wide.tolist()]
    flags = np.zeros(len(keys) + sum(map(len, fewer)), dtype=np.int32)
    flags[len(keys) :] = _DELETED
    return np.concatenate([keys, *fewer]).view(np.int64), flags, len(keys) - need, len(wide), wide


#: What a filed row tells in one number: the size above 32 bits, the band and the marks above 22,
#: the number of doubled segments above 16, and the spare ones, shifted.
_SPARE, _DOUBLED = 1 << 15, 63


def _info(n: int, flags: np.ndarray, spare: int, doubled: int) -> np.ndarray:
    """Fewer spare or doubled segments than there are only let a set drop less."""
    rest = min(doubled, _DOUBLED) << 16 | min(max(spare, -_SPARE), _SPARE - 1) + _SPARE
    return flags.astype(np.int64) << 22 | (n << 32 | rest)


_FILED = "key bigint, sid bigint, info bigint, parities array<bigint>"


def filed(docs: DataFrame, text: str = "text", key: str = "doc_id", everything: bool = False, seed: int = 0) -> DataFrame:
    """Rows of all sets: a member row for each document (key is its doc_id, with the parities of
    its set), and what its set files, once for each set and task. ``info`` is packed, as a row is sorted for each
    shingle or two. With ``everything``, each shingle is filed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        held: list[list[np.ndarray]] = []
        odd: list[np.ndarray] = []
        size = 0

        def batch() -> pa.RecordBatch:
            keys, sids, infos = (np.concatenate(c) for c in zip(*held, strict=True))
            member = infos >> 22 & _MEMBER != 0
            widths = np.zeros(len(member) + 1, dtype=np.int32)
            widths[1:][member] = [len(x) for x in odd]
            ends = pa.array(np.cumsum(widths, dtype=np.int32))
            packed = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(odd) if odd else [], type=pa.int64()), mask=pa.array(~member))
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sids), pa.array(infos), packed], names=["key", "sid", "info", "parities"])

        def put(keys, sid, info) -> None:
            held.append([keys, np.full(len(keys), sid, dtype=np.int64), info])

        for part in batches:
            for doc, body in zip(part.column(0).to_numpy(zero_copy_only=False), part.column(1), strict=True):
                s = shingle_set(body.as_py())
                spread = _spread(s, seed)
                sid, n = set_id(s, seed, spread), len(s)
                put(np.array([doc], dtype=np.int64), sid, _info(n, np.array([_MEMBER]), 0, 0))
                odd.append(parities(s, spread))
                size += 1
                if n and sid not in done:
                    done.add(sid)
                    band = n.bit_length() - 1
                    for b in (band, band + 1) if n * DEN // NUM >= 2 << band else (band,):
                        if everything:
                            keys, flags, spare, doubled = mix(s ^ _U(b + 77)).view(np.int64), np.zeros(n, dtype=np.int32), 0, 0
                        else:
                            keys, flags, spare, doubled, wide = signatures(s, b)
                            flags[wide] = _WIDE
                        flags |= (0 if b == band else _VISITOR) | (_SHORT if spare + doubled < 0 else 0) | b << _BAND
                        put(keys, sid, _info(n, flags, spare, doubled))
                        size += len(keys)
                if size >= 1 << 17:
                    yield batch()
                    held.clear()
                    odd.clear()
                    size = 0
        if held:
            yield batch()

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _FILED)


def _shared(rows: DataFrame) -> DataFrame:
    """Member rows, and filed rows whose key at least two sets have or whose set lacks the
    guarantee, with ``met`` (rows of the key)."""
    flags = F.shiftright("info", 22).bitwiseAND(1023).cast("int")
    rows = rows.repartition("key").withColumn("member", F.shiftright("info", 22).bitwiseAND(_MEMBER) != 0)
    w = Window.partitionBy("key", "member")
    rows = rows.withColumn("met", F.count("*").over(w).cast("int"))
    rows = rows.withColumn("low", F.min("sid").over(w)).withColumn("high", F.max("sid").over(w))
    short = flags.bitwiseAND(_SHORT) != 0
    rows = rows.where(F.col("member") | (F.col("low") < F.col("high")) | short)
    return rows.select(
        "key", "sid", F.shiftright("info", 32).cast("int").alias("n"), flags.alias("flags"),
        (F.col("info").bitwiseAND(2 * _SPARE - 1) - _SPARE).cast("int").alias("spare"),
        F.shiftright("info", 16).bitwiseAND(_DOUBLED).cast("int").alias("doubled"), "parities", "member", "met",
    )


def _allocated(shared: DataFrame) -> DataFrame:
    """(key, sid, n, band, deleted, visitor, active, weight): a row is active unless its set
    drops it. A set drops its most shared segments as far as ``spare`` allows; if it counts its
    one-deletion variants, it may drop as many more, but no whole key of a segment with variants:
    variants meet whole keys alone, so equal segments, which count double, would not meet. It
    takes what shares less in all."""
    rows = shared.where(~F.col("member")).dropDuplicates(["key", "sid", "flags"]).select(
        "key", "sid", "n", "met",
        F.shiftright("flags", _BAND).alias("band"),
        (F.col("flags").bitwiseAND(_DELETED) != 0).alias("deleted"),
        (F.col("flags").bitwiseAND(_VISITOR) != 0).alias("visitor"),
        (F.col("flags").bitwiseAND(_WIDE) != 0).alias("wide"),
        "spare", "doubled",
    )
    own = Window.partitionBy("sid", "band")
    order = own.orderBy("deleted", F.desc("met"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The place among all whole keys, and among those of segments without variants.
    rows = rows.withColumns({"rank": F.row_number().over(order), "narrow": F.count_if(~F.col("wide")).over(order)})
    stays_plain = lambda most: ~F.col("deleted") & (F.col("rank") > most)
    stays_double = lambda most: F.col("deleted") | F.col("wide") | (F.col("narrow") > most)
    cost = lambda stays: F.sum(F.when(stays, F.col("met")).otherwise(0)).over(own)
    plain, more = F.col("spare"), F.col("spare") + F.col("doubled")
    double = (plain < 0) | (cost(stays_double(more)) < cost(stays_plain(plain)))
    rows = rows.withColumn("double", double).withColumn("most", F.when(F.col("double"), F.greatest(more, F.lit(0))).otherwise(plain))
    active = F.when(F.col("double"), stays_double(F.col("most"))).otherwise(stays_plain(F.col("most")))
    weight = F.avg("met").over(Window.partitionBy("sid"))
    return rows.select("key", "sid", "n", "band", "deleted", "visitor", active.alias("active"), weight.alias("weight"))


def _fits(a, b):
    """Sizes that may reach the similarity."""
    return DEN * F.least(a, b) >= NUM * F.greatest(a, b)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of set ids with ``both`` and ``either``, the sizes of intersection and union."""
    one = sets.select(F.col("sid").alias("a"), F.col("s").alias("sa"))
    other = sets.select(F.col("sid").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(one, "a").join(other, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    return joined.select("a", "b", "both", (F.col("sum") - F.col("both")).alias("either"))


_REACHED = f"{DEN} * both >= {NUM} * either"


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of set ids, those whose sets reach the similarity, exactly."""
    return _compared(pairs, sets).where(_REACHED).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(sid, comp): the smallest id reachable, for all ids in edges (a, b). Labels take the
    least of their neighbours' and then of the label's own label, until nothing changes."""
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "join-edges")
    labels = stash(both.groupBy(F.col("a").alias("sid")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "join-labels")
    while True:
        near = both.join(labels.select(F.col("sid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("sid")).agg(F.min("comp").alias("least"))
        hop = labels.join(near, "sid").select("sid", "comp", F.least("comp", "least").alias("next"))
        far = labels.select(F.col("sid").alias("next"), F.col("comp").alias("far"))
        moved = stash(hop.join(far, "next").select("sid", F.col("comp").alias("was"), F.least("next", "far").alias("comp")), "join-labels")
        drop_stash(labels)
        labels = moved.select("sid", "comp")
        if moved.where("was <> comp").isEmpty():
            return labels


def looked_up(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join with a table that has each key once. A key of more than a ten thousandth of all
    rows on the left is no hot group: there are fewer than ``HEAVY`` such keys, whatever the table, so
    that their rows on the right are broadcast. The left side is read three times: stash it."""
    counts = left.groupBy(key).count()
    most = max(100, left.count() // HEAVY)
    heavy = stash(counts.where(F.col("count") > most).select(key), "join-heavy")
    if heavy.isEmpty():
        return left.join(right, key, "left")
    marked = left.join(F.broadcast(heavy.withColumn("__hot", F.lit(True))), key, "left")
    hot = stash(right.join(F.broadcast(heavy), key, "left_semi"), "join-heavy")
    many = marked.where("__hot").drop("__hot").join(F.broadcast(hot), key, "left")
    return many.unionByName(marked.where("__hot IS NULL").drop("__hot").join(right, key, "left"))


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels of ``components`` (stashed) after further edges. Only edges between different
    components count, and only the components they join are labelled again."""
    at = lambda c: labels.select(F.col("sid").alias(c), F.col("comp").alias(f"{c}_comp"))
    between = edges.join(at("a"), "a", "left").join(at("b"), "b", "left")
    between = between.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).where("a <> b")
    between = stash(between.distinct(), "join-between")
    if between.isEmpty():
        return labels
    more = components(between)
    moved = looked_up(labels, more.select(F.col("sid").alias("comp"), F.col("comp").alias("to")), "comp")
    fresh = more.join(labels.select("sid"), "sid", "left_anti")
    return stash(moved.select("sid", F.coalesce("to", "comp").alias("comp")).unionByName(fresh.select("sid", "comp")), "join-labels")


def _plausible(a: str, b: str, num: int = NUM, den: int = DEN):
    """Whether sets of these parities and fitting sizes may reach a similarity; loses no pair that
    does. The longer parities, if any, have twice the words of the others."""
    x, y = F.col(f"parities_{a}"), F.col(f"parities_{b}")
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    half = F.size(short)
    differing = lambda w, i: F.bit_count(w.bitwiseXOR(F.get(long, i)).bitwiseXOR(F.coalesce(F.get(long, i + half), F.lit(0).cast("long"))))
    bits = F.aggregate(F.transform(short, differing), F.lit(0), lambda total, c: total + c)
    return bits * (den + num) <= (F.col(f"n_{a}") + F.col(f"n_{b}")) * (den - num)


def _pairs(rows: DataFrame, few: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of set ids, with repeats, whose links may count: of different units and
    components, one of them owning the band, not both leaving a shingle out, of fitting sizes,
    and the key active for the smaller one (of equal ones, for either). Where rows have
    ``parities``, those must not differ in more bits than the sets may differ in shingles. With
    ``few``, the smaller or the larger one is of these rows."""
    names = ["sid", "n", "deleted", "visitor", "comp", "unit"] + ["parities"] * ("parities" in rows.columns)
    a = (rows if few is None else few).where("active").select("key", *(F.col(c).alias(f"{c}_a") for c in names))
    b = rows.select("key", *(F.col(c).alias(f"{c}_b") for c in names))
    ok = (F.col("unit_a") != F.col("unit_b")) & (F.col("comp_a") != F.col("comp_b")) & ~(F.col("visitor_a") & F.col("visitor_b"))
    ok = ok & ~(F.col("deleted_a") & F.col("deleted_b")) & _fits(F.col("n_a"), F.col("n_b"))
    if few is None:
        ok = ok & (F.col("n_a") <= F.col("n_b"))
    if "parities" in names:
        ok = ok & _plausible("a", "b")
    return a.join(b, "key").where(ok).select(F.least("sid_a", "sid_b").alias("a"), F.greatest("sid_a", "sid_b").alias("b"))


def _led(rows: DataFrame) -> DataFrame:
    """(a, b): each set and the leader that it shares most keys with. The leader of a key is the
    set whose keys are shared by most on average."""
    lead = F.max(F.when(~F.col("deleted"), F.struct("weight", "sid", "n"))).over(Window.partitionBy("key"))
    now = rows.withColumn("lead", lead).where((F.col("lead.sid") != F.col("sid")) & _fits(F.col("n"), F.col("lead.n")))
    now = now.groupBy(F.col("sid").alias("a"), F.col("lead.sid").alias("b")).agg(F.count("*").alias("c"))
    return now.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))


def _within(family: DataFrame, labels: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """Links inside large families, those that join two components and no others. A family is
    cut into blocks of about ``BLOCK`` shingles and each pair of blocks compared in one task, so
    that pairs never become rows."""
    sized = stash(family.join(known.select("sid", "n"), "sid").select("family", "sid", "n"), "join-sized")
    blocks = sized.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    dealt = looked_up(sized, blocks, "family").join(sets, "sid").join(labels, "sid", "left")
    dealt = dealt.withColumn("comp", F.coalesce("comp", "sid")).withColumn("own", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", "comp", "s")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
        part = part.sort_values("sid")
        ids, own, sets = part["sid"].to_numpy(), part["own"].to_numpy(), list(part["s"])
        sizes = np.array([len(x) for x in sets])
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.r_[0, np.cumsum(sizes)]
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        comp = part["comp"].to_numpy()
        right = np.flatnonzero(own == j)
        where = np.concatenate([np.arange(at[k], at[k + 1]) for k in right]) if len(right) else np.zeros(0, dtype=int)
        starts = np.r_[0, np.cumsum(sizes[right])][:-1]
        mark = np.zeros(token.max() + 1, dtype=np.int32)
        found = []
        for k in np.flatnonzero(own == i) if len(right) else ():
            mark[token[at[k] : at[k + 1]]] = 1
            both = np.add.reduceat(mark[token[where]], starts)
            mark[token[at[k] : at[k + 1]]] = 0
            for x in np.flatnonzero(DEN * both >= NUM * (sizes[k] + sizes[right] - both)):
                a, b = top(int(comp[k])), top(int(comp[right[x]]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append((int(ids[k]), int(ids[right[x]])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("family", "i", "j").applyInPandas(run, "a bigint, b bigint")


def links(rows: DataFrame, fetch: Callable[[DataFrame], DataFrame], known: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all links among sets that share a key. Deletes
    ``rows``, which is stashed. ``fetch`` gives the sets of pairs, stashed."""
    return linked(rows, fetch, known)[0]


def linked(rows: DataFrame, fetch: Callable[[DataFrame], DataFrame], known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of ``links``, and the labels of their components.

    First each set meets its leader. Sets half-like one leader are its family; in a family of
    ``CROWD`` or more, where nearly all share keys, blocks are compared. All other sets of
    different components are compared if an active key is theirs. Shingles are only fetched
    for pairs that parities leave."""
    at = lambda c: known.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("parities").alias(f"parities_{c}"))
    near = stash(_led(rows).join(at("a"), "a").join(at("b"), "b").where(_plausible("a", "b", *FAMILY)).select("a", "b"), "join-near")
    sets = fetch(near)
    led = stash(_compared(near, sets), "join-led")
    found = led.where(_REACHED).select("a", "b")
    labels = components(found)
    kin = led.where(f"{FAMILY[1]} * both >= {FAMILY[0]} * either").select(F.col("a").alias("sid"), F.col("b").alias("family"))
    # A leader may have a leader itself: it is of the larger family then, and a family of its own.
    large = kin.groupBy("family").agg(F.count("*").alias("size")).where(F.col("size") >= CROWD)
    kin = kin.join(large.select("family"), "family").union(large.select("family", F.col("family").alias("sid")))
    kin = stash(kin.distinct(), "join-families")
    inside = stash(_within(kin, labels, sets, known), "join-links")
    drop_stash(sets)
    labels = extended(labels, inside)
    now = rows.drop("weight").join(kin.groupBy("sid").agg(F.min("family").alias("family")), "sid", "left")
    now = now.join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    # What has one unit is one component or a family that is done; keys with one unit go. Both
    # have set ids for names; a family's is hashed, so that it is no component's.
    now = now.withColumn("unit", F.when(F.col("family").isNull(), F.col("comp")).otherwise(F.xxhash64("family"))).drop("family")
    by_key = Window.partitionBy("key")
    now = now.withColumn("low", F.min("unit").over(by_key)).withColumn("high", F.max("unit").over(by_key)).withColumn("any", F.max("active").over(by_key))
    now = stash(now.where((F.col("low") < F.col("high")) & F.col("any")).drop("low", "high", "any"), "join-rows")
    drop_stash(rows)
    rest = stash(_pairs(now.join(known.select("sid", "parities"), "sid")).distinct(), "join-rest")
    drop_stash(now)
    sets = fetch(rest)
    last = stash(verified(rest, sets), "join-links")
    drop_stash(sets)
    return found.unionByName(inside).unionByName(last), extended(labels, last)


def sets_of(docs: DataFrame, known: DataFrame, pairs: DataFrame, unique: bool, text: str = "text", key: str = "doc_id", seed: int = 0) -> DataFrame:
    """(sid, s) of the set ids in pairs (a, b), stashed: the shingles of one document of each.
    Texts that share a doc_id may give a set twice, unless each doc_id is ``unique``."""
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    first = known.join(wanted, "sid", "left_semi").select("doc_id").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [shingle_set(t) for t in part["text"]]
            yield pd.DataFrame({"sid": [set_id(s, seed) for s in found], "s": [s.view(np.int64) for s in found]})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(first, "doc_id", "left_semi")
    found = rows.select("text").mapInPandas(run, "sid bigint, s array<bigint>")
    return stash(found if unique else found.dropDuplicates(["sid"]), "join-sets")


def joined(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Words are split at ASCII white space, A-Z in lower case; fewer than five words are one
    shingle. Null, empty and wordless texts have no shingle and no link. A null doc_id is
    linked with nothing and has a null component. Rows that share a doc_id are one node with
    the links of all its texts; each keeps its own n_shingles. Sets are told apart by 64-bit
    hashes of their 64-bit shingle hashes; should two sets share one (their sizes and parities
    tell), all is done again with other hashes. Very long texts are one set. Only the key and the
    text are read; an empty table gives an empty one.
    """
    seed = 0
    while True:
        shared = stash(_shared(filed(docs, text, key, seed=seed)), "join-filed")
        members = stash(shared.where("member").select(F.col("key").alias("doc_id"), "sid", "n", "parities"), "join-members")
        content = F.xxhash64("n", "parities")
        known = members.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("parities").alias("parities"), (F.min(content) < F.max(content)).alias("clash"))
        known = stash(known, "join-known")
        if known.where("clash").isEmpty():
            break
        seed += 1
    known = known.drop("clash")
    rows = stash(_allocated(shared), "join-rows")
    short = stash(filed_short(shared), "join-few")
    drop_stash(shared)
    unique = members.groupBy("doc_id").count().where("count > 1").isEmpty()
    fetch = lambda pairs: sets_of(docs, known, pairs, unique, text, key, seed)
    labels = linked(rows, fetch, known)[1]
    if not short.isEmpty():
        labels = extended(labels, stash(_short_links(docs, fetch, known, short, text, key, seed), "join-links"))
    if not unique:
        # A doc_id with several texts joins their sets.
        several = members.where("n > 0").groupBy("doc_id").agg(F.min("sid").alias("a"), F.collect_set("sid").alias("all")).where(F.size("all") > 1)
        labels = extended(labels, stash(several.select("a", F.explode("all").alias("b")).where("a <> b"), "join-links"))
    # The smallest doc_id goes from sets to components, back to sets, and to the documents.
    placed = stash(known.select("sid", "doc_id").join(labels, "sid", "left").select("sid", "doc_id", F.coalesce("comp", "sid").alias("comp")), "join-placed")
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    placed = looked_up(placed, least, "comp").select("sid", "component_id")
    out = looked_up(members.select("doc_id", "sid", "n"), placed, "sid")
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    lost = docs.where(F.col(key).isNull()).select(F.col(text).alias("text"))

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(shingle_set(t)))

    nameless = lost.select(F.lit(None).cast("long").alias("doc_id"), count("text").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless)


def filed_short(shared: DataFrame) -> DataFrame:
    """Ids of the sets that too few filled segments leave without the guarantee (next to none)."""
    return shared.where(~F.col("member") & (F.col("flags").bitwiseAND(_SHORT) != 0)).select("sid").distinct()


def _short_links(docs: DataFrame, fetch: Callable[[DataFrame], DataFrame], known: DataFrame, short: DataFrame, text: str, key: str, seed: int = 0) -> DataFrame:
    """Links of such sets: a second pass in which every shingle is a segment of its own."""
    rows = _shared(filed(docs, text, key, everything=True, seed=seed)).where(~F.col("member"))
    rows = rows.dropDuplicates(["key", "sid", "flags"]).select("key", "sid", "n", F.shiftright("flags", _BAND).alias("band"), (F.col("flags").bitwiseAND(_VISITOR) != 0).alias("visitor"), F.lit(False).alias("deleted"), F.lit(True).alias("active"), F.col("sid").alias("comp"), F.col("sid").alias("unit"))
    rows = rows.join(known.select("sid", "parities"), "sid")
    few = rows.join(short, "sid", "left_semi")
    pairs = stash(_pairs(rows, few).distinct(), "join-short")
    return verified(pairs, fetch(pairs))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with the smallest doc_id of their component, rows without an id, and of
    rows that share such an id one."""
    kept = joined(docs.select("doc_id", "text")).where("doc_id = component_id").select("doc_id").distinct()
    stay = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stay.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


# The brute force over all pairs; DuckDB takes it at the sizes of the correctness gate.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM d),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
r(a, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.c = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON s.doc_id = m.a
"""
