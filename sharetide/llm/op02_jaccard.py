"""Exact Jaccard similarity join of documents' word shingles (operator 2).

Jaccard distance is a metric, but unrelated documents are all at distance 1, inside every triangle window,
so pivots alone would send every document to every region.  Documents are therefore first grouped into
bundles outside which no link can lie, then each bundle is joined in the metric space:

1. Documents with equal sets are one class.  Each class deals its shingles into more parts than two
   linked sets can differ in, so linked sets agree in at least one part; parts with two shingles or more are keys, as unrelated
   texts have single shingles in common the oftener, the more texts there are.  A set with so few such parts that a
   lighter one may be all that agrees has its smallest hashes as keys too.
2. Classes joined by keys, directly or not, make up a bundle.  In bundles too large for one task the classes of
   a key are joined only if sketches, whose distance is never above that of the sets, allow a link.
3. A bundle's pivots create Voronoi regions.  A class belongs to the region of its nearest pivot and is
   repeated in each region whose pivot is not farther by more than twice the distance limit: by the triangle
   inequality every link of a class lies in its own region.  Regions join recursively, the small ones by matrix
   products of exact intersections.

Nothing lists all pairs: a region returns, by class, its number of links and one linked class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharetide.llm.common import free_shuffles, op_query, table
from sharetide.llm.graph import components
from sharetide.llm.seeds import first_words, member_filter
from sharetide.llm.textmath import Words, inner, mix, pieces, ragged, windows_of, words_of
from sharetide.session import discard, stage

REGION = 6000  # classes joined in one task; larger bundles are dealt out by pivots
LEAF, PIVOTS = 64, 8
COLUMNS = 4096  # shingles multiplied at a time
BLOCK = 512
DEAL_AGAIN = 6  # another way of dealing shingles into parts
GROUP = 64  # classes of a key that are compared by sketches; those of a commoner key are joined as they are
RARE = 16  # a shingle of so few sets of a region is counted by its pairs, all others by matrix products


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, all in a row; and where each document's begin."""
    n = len(w.first) - 1
    at, doc = inner(w.first, k)
    value = windows_of(w.hash, k)[at] if len(at) else np.zeros(0, np.uint64)
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):  # the whole sequence is the one shingle
        whole = np.array([mix(np.array([hash(tuple(w.hash[w.first[i] : w.first[i + 1]].tolist())) & (2**64 - 1)], np.uint64))[0] for i in short.tolist()], np.uint64)
        value, doc = np.concatenate((value, whole)), np.concatenate((doc, short))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.concatenate(([True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))) if len(value) else np.zeros(0, bool)
    value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(n + 1))


def class_ids(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash for each set; 0 for the empty set."""
    size = np.diff(first)
    out = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = mix(np.add.reduceat(mix(value ^ np.uint64(0x51ED270B)), first[some]) + size[some].astype(np.uint64)) | np.uint64(1)
    return out.view(np.int64)


def rings(top: int, percent: int) -> np.ndarray:
    """Borders of size rings; sizes of linked sets lie in one ring or in two next to each other."""
    borders = [1]
    while borders[-1] <= top:
        borders.append(borders[-1] * 100 // percent + 1)
    return np.array([*borders, borders[-1] * 100 // percent + 1])


def keys_of(value: np.ndarray, first: np.ndarray, percent: int, deal: int = 5, steps: tuple[int, ...] = (0, 1)) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the sets they belong to.  Linked sets have a key in common unless they are equal.

    Linked sets differ in at most ``differ`` shingles, so in as many of more parts; another part is equal in both and
    a key, if it is heavy: if it has two shingles or more.  Only if both have ``differ`` heavy parts or fewer can all equal
    parts be light: such sets have their smallest hashes as keys too, of which linked sets share one.
    """
    size = np.diff(first)
    if not len(value):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    borders = rings(int(size.max()), percent)
    ring = np.searchsorted(borders, size, side="right") - 1
    owner = np.repeat(np.arange(len(size)), size)
    dealt = mix(value + np.uint64(deal)) >> np.uint64(32)
    keys, owners = [], []
    for step in steps:  # with sets of the ring below, and of the ring above
        level = ring + step
        most = borders[np.minimum(level + 1, len(borders) - 1)] - 1  # largest set of this level
        salt = mix(level.astype(np.uint64) + np.uint64(77))
        differ = 2 * most * (100 - percent) // (100 + percent)
        parts = np.where((differ > 0) & (size > 0), differ + 2 + differ // 5, 0)  # no difference: equal sets, one class
        cut = parts[owner] > 0
        own = owner[cut]
        offset = np.cumsum(parts) - parts
        place = offset[own] + ((dealt[cut] * parts[own].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(total, place, mix(value[cut]))
        holder = np.repeat(np.arange(len(size)), parts)
        heavy = np.flatnonzero(np.bincount(place, minlength=len(total)) > 1)
        number = (heavy - offset[holder[heavy]]).astype(np.uint64)
        keys.append(mix(total[heavy] + mix(salt[holder[heavy]] + number)))
        owners.append(holder[heavy])
        partner = np.minimum(most, size * 100 // percent)  # largest set that this one can be linked with here
        few = np.flatnonzero((parts > 0) & (np.bincount(holder[heavy], minlength=len(size)) <= (size + partner) * (100 - percent) // (100 + percent)))
        length = size[few] - -(-size[few] * percent // 100) + 1
        holder = np.repeat(few, length)
        keys.append(mix(value[ragged(first[few], length)] + mix(salt[holder])))
        owners.append(holder)
    return np.concatenate(keys), np.concatenate(owners)


def _sets(docs: DataFrame, column: str, k: int, body, schema: str, *carried: str) -> DataFrame:
    """Run ``body(batch, value, first, class ids)`` over the shingle sets of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, column):
            value, first = shingles(words_of(b.column(column), True), k)
            yield from body(b, value, first, class_ids(value, first))

    return docs.select(column, *carried).mapInArrow(run, schema)


class Region:
    """Sets that meet in one task: exact links of the ``core`` sets with all sets."""

    def __init__(self, value: np.ndarray, first: np.ndarray, percent: int) -> None:
        self.size, self.percent = np.diff(first), percent
        owner = np.repeat(np.arange(len(self.size)), self.size)
        _, column, count = np.unique(value, return_inverse=True, return_counts=True)
        shared = count > 1  # a shingle of one set alone meets no other
        rare = shared & (count <= RARE)
        self._meet(owner, column, rare[column])
        shared &= ~rare
        number = np.cumsum(shared) - 1
        keep = shared[column]
        self.owner, self.column, self.width = owner[keep], number[column[keep]], int(shared.sum())
        self.begin = np.searchsorted(self.owner, np.arange(len(self.size) + 1))
        self.links = np.zeros(len(self.size), np.int64)
        self.root = np.arange(len(self.size))

    def _meet(self, owner: np.ndarray, column: np.ndarray, rare: np.ndarray) -> None:
        """Numbers of rare shingles that sets have in common, listed for both sets of each pair."""
        n = len(self.size)
        order = np.argsort(column[rare], kind="stable")
        row, kind = owner[rare][order], column[rare][order]
        codes = [np.zeros(0, np.int64)]
        for step in range(1, RARE):
            same = np.flatnonzero(kind[step:] == kind[:-step])
            if not len(same):
                break
            a, b = row[same], row[same + step]
            codes += [a * n + b, b * n + a]
        code, self.times = np.unique(np.concatenate(codes), return_counts=True)
        self.other = code % max(n, 1)
        self.meets = np.searchsorted(code // max(n, 1), np.arange(n + 1))

    def _rows(self, rows: np.ndarray, low: int) -> np.ndarray:
        """Columns low.. of the incidence matrix of some sets."""
        at = ragged(self.begin[rows], self.begin[rows + 1] - self.begin[rows])
        row = np.repeat(np.arange(len(rows)), self.begin[rows + 1] - self.begin[rows])
        column = self.column[at] - low
        inside = (column >= 0) & (column < COLUMNS)
        out = np.zeros((len(rows), min(COLUMNS, self.width - low)), np.float32)
        out[row[inside], column[inside]] = 1
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of sets a with sets b."""
        out = np.zeros((len(a), len(b)), np.float32)
        for low in range(0, self.width, COLUMNS):
            out += self._rows(a, low) @ self._rows(b, low).T
        place = np.full(len(self.size), -1)
        place[b] = np.arange(len(b))
        length = self.meets[a + 1] - self.meets[a]
        at, row = ragged(self.meets[a], length), np.repeat(np.arange(len(a)), length)
        column = place[self.other[at]]
        here = column >= 0
        out[row[here], column[here]] += self.times[at[here]]
        return out

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, core: np.ndarray, all_: np.ndarray) -> None:
        if len(all_) <= LEAF or not len(core):
            return self.leaf(core, all_)
        pivot = all_[np.linspace(0, len(all_) - 1, PIVOTS).astype(np.int64)]
        both = self.common(all_, pivot)
        away = 1 - both / np.maximum(self.size[all_][:, None] + self.size[pivot][None] - both, 1)
        nearest = away.argmin(1)
        within = away <= away.min(1, keepdims=True) + 2 * (1 - self.percent / 100) + 1e-6
        is_core = np.isin(all_, core)
        parts = [(all_[is_core & (nearest == j)], all_[within[:, j]]) for j in range(PIVOTS)]
        if sum(len(c) * len(a) for c, a in parts) > 0.7 * len(core) * len(all_):
            return self.leaf(core, all_)  # the windows hold nearly all: no use in dividing
        for c, a in parts:
            self.join(c, a)
        return None

    def leaf(self, core: np.ndarray, all_: np.ndarray, both: bool = False) -> None:
        """Compare in blocks; with ``both``, links count for the sets of both sides."""
        for x in range(0, len(core), BLOCK):
            for y in range(0, len(all_), 4 * BLOCK):
                a, b = core[x : x + BLOCK], all_[y : y + 4 * BLOCK]
                shared = self.common(a, b)
                linked = 100 * shared >= self.percent * (self.size[a][:, None] + self.size[b][None] - shared)
                linked[a[:, None] == b[None]] = False
                self.links[a] += linked.sum(1)
                if both:
                    self.links[b] += linked.sum(0)
                for i in np.flatnonzero(linked.any(1)).tolist():
                    roots = {self.find(j) for j in np.unique(self.root[b[linked[i]]]).tolist()} | {self.find(int(a[i]))}
                    least = min(roots)
                    for r in roots:
                        self.root[r] = least


def _join_regions(rows: DataFrame, percent: int) -> DataFrame:
    """Per class that is core somewhere: ``class``, ``other`` (a class linked to it or itself), ``n_links``."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        ids, core, right, both, size, value = (np.concatenate(x) for x in zip(*held))
        once = first_words(ids)  # equal sets come from several tasks; the rows are in order of class
        value = value[ragged((np.cumsum(size) - size)[once], size[once])]
        ids, core, right, size = ids[once], core[once], right[once], size[once]
        first = np.concatenate(([0], np.cumsum(size)))
        region = Region(value, first, percent)
        if both[0]:  # two blocks of one dense bundle
            region.leaf(np.flatnonzero(core), np.flatnonzero(right), both=True)
        else:
            region.join(np.flatnonzero(core), np.flatnonzero(right))
        roots = np.array([region.find(i) for i in range(len(ids))], np.int64)
        tell = core | (roots != np.arange(len(ids))) | (region.links > 0)
        return pa.RecordBatch.from_arrays([pa.array(ids[tell]), pa.array(ids[roots[tell]]), pa.array(region.links[tell])], ["class", "other", "n_links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for b in batches:
            task = b.column("task").to_numpy()
            lists = b.column("shingles")
            at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            flat = lists.flatten().to_numpy().view(np.uint64)
            cut = [*first_words(task).tolist(), len(task)]
            for x, y in zip(cut, cut[1:]):
                if held and task[x] != now:
                    yield solve(held)
                    held = []
                now = task[x]
                held.append((b.column("class").to_numpy()[x:y], *[b.column(c).to_numpy(zero_copy_only=False)[x:y] for c in ("core", "right", "both")], np.diff(at)[x:y], flat[at[x] : at[y]]))
        if held:
            yield solve(held)

    dealt = rows.select("task", "class", "core", "right", "both", "shingles").repartition("task").sortWithinPartitions("task", "class")
    return dealt.mapInArrow(run, "class bigint, other bigint, n_links bigint")


def _key_edges(keys: DataFrame) -> DataFrame:
    """``a``, ``b``: the classes of each key (rows ``seed, class``), hung on the least of them.  Fewer rows than there are keys' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # a key may go on in the next batch
        for b in batches:
            seed, held = b.column("seed").to_numpy(), b.column("class").to_numpy()
            if not len(seed):
                continue
            at = first_words(seed)
            least = held[at].copy()
            if last and last[0] == seed[0]:
                least[0] = last[1]
            last = seed[-1], least[-1]
            low = np.repeat(least, np.diff(np.append(at, len(seed))))
            apart = held != low
            if apart.any():
                pairs = np.unique(np.stack((held[apart], low[apart])), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return keys.repartition("seed").sortWithinPartitions("seed", "class").mapInArrow(run, "a bigint, b bigint")


def sketches(value: np.ndarray, first: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of shingles by cell (255 at most), ``width`` cells a set, all in a row; and where each set's begin.

    A shingle that one set alone has changes one cell by one: the cells of two sets differ, in sum, by no more than the sets.
    """
    begin = np.concatenate(([0], np.cumsum(width)))
    owner = np.repeat(np.arange(len(width)), np.diff(first))
    cell = ((mix(value + np.uint64(31)) >> np.uint64(32)) * width[owner].astype(np.uint64)) >> np.uint64(32)
    return np.minimum(np.bincount(begin[owner] + cell.astype(np.int64), minlength=begin[-1]), 255).astype(np.uint8), begin


def sketch_pairs(seed: np.ndarray, size: np.ndarray, sketch: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of rows of one seed (rows are in its order) whose sketches allow a link."""
    width = np.array([len(x) for x in sketch])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        cells = np.frombuffer(b"".join(sketch[i] for i in rows.tolist()), np.uint8).reshape(len(rows), w).astype(np.int16)
        for step in range(1, GROUP):
            same = np.flatnonzero(seed[rows[step:]] == seed[rows[:-step]])
            if not len(same):
                break
            for part in np.array_split(same, len(same) * w // (1 << 22) + 1):
                apart = np.abs(cells[part] - cells[part + step]).sum(1)
                a, b = rows[part], rows[part + step]
                near = apart <= (size[a] + size[b]) * (100 - percent) // (100 + percent)
                left.append(a[near])
                right.append(b[near])
    return np.concatenate(left), np.concatenate(right)


def _refine(large: DataFrame, percent: int) -> DataFrame:
    """Bundles (``class``, ``bundle``, ``n``) of the classes in ``large``, apart wherever no link can lie.

    Other keys are dealt, and of the classes of a key only those pairs are joined whose sketches differ by no more than
    linked sets of their sizes can.  The classes of a key met more than ``GROUP`` times are all joined.  Classes that
    nothing is joined with have no links and are left out.
    """

    def sets(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lists = b.column("shingles")
        return lists.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seed, owner = keys_of(*sets(b), percent, DEAL_AGAIN)
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), b.column("class").take(pa.array(owner))], ["seed", "class"])

    stored = large.select("class", "shingles")
    keys = stored.mapInArrow(key_rows, "seed bigint, class bigint")
    by_key = stage(keys.groupBy("seed").agg(F.min("class").alias("low"), F.count("*").alias("n")).where("n > 1"), "refined-keys")
    few, many = by_key.where(F.col("n") <= GROUP).select("seed"), by_key.where(F.col("n") > GROUP).select("seed", "low")
    wanted = member_filter(few)

    def sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, first = sets(b)
            size = np.diff(first)
            borders = rings(int(size.max(initial=1)), percent)
            ring = np.searchsorted(borders, size, side="right") - 1
            for step in (0, 1):  # sets of one key are of one level, so their sketches have one width
                seed, owner = keys_of(value, first, percent, DEAL_AGAIN, (step,))
                hit = np.flatnonzero(wanted(seed))
                seed, owner = seed[hit], owner[hit]
                cells, begin = sketches(value, first, np.maximum(8, borders[ring + step + 1] // 6))
                sketch = pa.array([cells[begin[i] : begin[i + 1]].tobytes() for i in range(len(size))], pa.binary())
                for x in range(0, len(owner), 20_000):
                    at = pa.array(owner[x : x + 20_000])
                    yield pa.RecordBatch.from_arrays([pa.array(seed[x : x + 20_000].view(np.int64)), b.column("class").take(at), pa.array(size[owner[x : x + 20_000]]), sketch.take(at)], ["seed", "class", "size", "sketch"])

    def join_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: pa.Table) -> pa.RecordBatch:
            seed, held, size = (rows.column(c).to_numpy() for c in ("seed", "class", "size"))
            a, b = sketch_pairs(seed, size, rows.column("sketch").to_pylist(), percent)
            found = np.unique(np.stack((held[a], held[b])), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

        kept = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            if rows.num_rows:
                end = int(first_words(rows.column("seed").to_numpy())[-1])  # the last key may go on in the next batch
                yield pairs(rows.slice(0, end))
                kept = rows.slice(end)
        if kept is not None:
            yield pairs(kept)

    sketched = stored.mapInArrow(sketch_rows, "seed bigint, class bigint, size bigint, sketch binary").join(few, "seed", "left_semi")
    near = sketched.repartition("seed").sortWithinPartitions("seed").mapInArrow(join_keys, "a bigint, b bigint")
    common = keys.join(many, "seed").select(F.col("class").alias("a"), F.col("low").alias("b"))
    bundles = stage(components(near.union(common)).select(F.col("v").alias("class"), F.col("root").alias("bundle")), "refined")
    return stage(bundles.join(bundles.groupBy("bundle").agg(F.count("*").alias("n")), "bundle"), "refined-sized")


def _regions(large: DataFrame, percent: int, limit: int) -> DataFrame:
    """Rows ``task, class, core, right, shingles`` of bundles over ``limit``, dealt out by pivots.

    In a large bundle each class is compared with some pivots; the pivots' rows are repeated for as many
    slices as the bundle has, so no task compares more than ``limit`` classes.  A region that is still too
    large is dealt into blocks of core and other classes, all pairs of which are tasks of their own.
    """
    yes = F.lit(True)
    large = large.withColumn("slices", F.ceil(F.col("n") / limit).cast("int"))
    from pyspark.sql import Window

    order = Window.partitionBy("bundle").orderBy(F.xxhash64("class", F.lit(9)), "class")
    pivots = large.select("bundle", "slices", "class", "shingles").withColumn("p", F.row_number().over(order)).where(F.col("p") <= 2 * PIVOTS)
    pivots = pivots.select("bundle", "p", F.col("shingles").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    sliced = large.withColumn("slice", F.pmod(F.xxhash64("class"), F.col("slices")).cast("int"))
    both = F.size(F.array_intersect("shingles", "pivot"))
    away = 1 - both / (F.size("shingles") + F.size("pivot") - both)
    near = stage(sliced.select("bundle", "slice", "class", "shingles").join(pivots, ["bundle", "slice"]).groupBy("bundle", "class").agg(F.sort_array(F.collect_list(F.struct(away.alias("d"), "p"))).alias("away")), "pivots")
    reach = 2 * (1 - percent / 100) + 1e-6
    placed = near.select("bundle", "class", F.col("away")[0]["p"].alias("own"), F.explode(F.filter("away", lambda a: a["d"] <= F.col("away")[0]["d"] + reach)["p"]).alias("p"))
    placed = stage(placed.withColumn("core", F.col("own") == F.col("p")), "regions")
    sizes = stage(placed.groupBy("bundle", "p").agg(F.sum(F.col("core").cast("bigint")).alias("cores"), F.count("*").alias("others")), "region-sizes")
    # Where the windows hold nearly all of a bundle, dividing it would only repeat its rows: it stays one region.
    dense = sizes.groupBy("bundle").agg((F.sum(F.col("cores") * F.col("others")) > 0.7 * F.pow(F.sum("cores"), F.lit(2))).alias("dense"))
    placed = placed.join(dense, "bundle").where(~F.col("dense") | F.col("core")).withColumn("p", F.when(F.col("dense"), 0).otherwise(F.col("p")))
    count = sizes.join(dense, "bundle").groupBy("bundle", F.when(F.col("dense"), 0).otherwise(F.col("p")).alias("p")).agg(
        F.ceil(F.sum("cores") / limit).alias("cores"), F.ceil(F.when(F.first("dense"), F.sum("cores")).otherwise(F.sum("others")) / limit).alias("others")
    )
    chunk = F.xxhash64("class", F.lit(4))
    dealt = placed.join(count.where("cores > 0"), ["bundle", "p"]).select(
        "bundle", "class", "p", "core",
        F.pmod(chunk, F.col("cores")).alias("i"), F.pmod(chunk, F.col("others")).alias("j"), "cores", "others",
    )
    # All of a dense bundle are core, so a pair of its blocks is compared once and counted for both.
    pairs = dealt.where("p = 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("cores") - 1))).select(
        "bundle", "class", F.xxhash64("bundle", F.lit("blocks"), F.least("i", "k"), F.greatest("i", "k")).alias("task"), (F.col("i") <= F.col("k")).alias("core"), (F.col("i") >= F.col("k")).alias("right"), (F.col("i") != F.col("k")).alias("both")
    )
    dealt = dealt.where("p > 0")
    as_right = dealt.select("bundle", "class", "p", F.explode(F.sequence(F.lit(0), F.col("cores") - 1)).alias("i"), "j", (F.lit(False)).alias("core"), yes.alias("right"))
    as_core = dealt.where("core").select("bundle", "class", "p", "i", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("j"), yes.alias("core"), F.lit(False).alias("right"))
    tasks = as_right.unionByName(as_core).groupBy("bundle", "class", F.xxhash64("bundle", "p", "i", "j").alias("task")).agg(F.max("core").alias("core"), F.max("right").alias("right"), F.lit(False).alias("both")).unionByName(pairs)
    return tasks.join(large.select("bundle", "class", "shingles"), ["bundle", "class"]).select("task", "class", "core", "right", "both", "shingles")


def join_similar(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", column: str = "text", limit: int = REGION) -> DataFrame:
    """``key``, ``n_shingles``, ``class`` (equal sets), ``n_links`` (other classes linked to it), ``component_id``.

    Two rows link if 100 * |intersection| >= percent * |union| of their sets of ``words``-word shingles, lower-cased in A-Z.  One
    row is returned per input row, also for repeated and null keys; ``component_id`` is the least key reachable by
    links.  Texts without words, null ones included, have an empty set and link with nothing: their component is
    their own key.  An empty table gives an empty table.  Other columns are left behind.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def class_rows(b, value, first, ids):
        yield pa.RecordBatch.from_arrays([b.column(key), pa.array(np.diff(first)), pa.array(ids)], [key, "n_shingles", "class"])

    def key_rows(b, value, first, ids):
        found, owner = keys_of(value, first, percent)
        held = ids[owner]
        order = np.lexsort((held, found))
        found, held = found[order], held[order]
        keep = np.concatenate(([True], (found[1:] != found[:-1]) | (held[1:] != held[:-1]))) if len(found) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(held[keep])], ["seed", "class"])

    def members(of: DataFrame) -> DataFrame:
        """The classes of ``of`` with their sets; copies of a set that come from other tasks included."""
        candidate = member_filter(of.select(F.col("class").alias("seed")))

        def set_rows(b, value, first, ids):
            wanted = np.flatnonzero(candidate(ids.view(np.uint64)) & (ids != 0))
            wanted = wanted[np.unique(ids[wanted], return_index=True)[1]]
            size = np.diff(first)[wanted]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(value[ragged(first[wanted], size)].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[wanted]), lists], ["class", "shingles"])

        return _sets(docs, column, words, set_rows, "class bigint, shingles array<bigint>").join(of, "class")

    def whole_bundles(sets: DataFrame) -> DataFrame:
        return sets.select(F.col("bundle").alias("task"), "class", F.lit(True).alias("core"), F.lit(True).alias("right"), F.lit(False).alias("both"), "shingles")

    classes = stage(_sets(docs, column, words, class_rows, f"{key} {key_type}, n_shingles bigint, class bigint", key), "classes")
    # Keys are dealt out bare: nearly all are met once, so partial aggregates would only be wider rows.
    edges = _key_edges(_sets(docs, column, words, key_rows, "seed bigint, class bigint"))
    bundles = stage(components(edges).select(F.col("v").alias("class"), F.col("root").alias("bundle")), "bundles")
    sized = stage(bundles.join(bundles.groupBy("bundle").agg(F.count("*").alias("n")), "bundle"), "sized")
    free_shuffles(docs.sparkSession)
    linked = stage(_join_regions(whole_bundles(members(sized.where(F.col("n") <= limit))), percent), "links")
    free_shuffles(docs.sparkSession)
    if not sized.where(F.col("n") > limit).isEmpty():
        large = stage(members(sized.where(F.col("n") > limit)).groupBy("class").agg(F.first("shingles").alias("shingles")), "large")
        refined = _refine(large, percent)
        free_shuffles(docs.sparkSession)
        parts = [whole_bundles(large.join(refined.where(F.col("n") <= limit), "class"))]
        if not refined.where(F.col("n") > limit).isEmpty():
            parts.append(_regions(large.join(refined.where(F.col("n") > limit), "class"), percent, limit))
        for rows in parts:
            linked = linked.unionByName(stage(_join_regions(rows, percent), "links"))
            free_shuffles(docs.sparkSession)
        discard(large)
    counts = linked.groupBy("class").agg(F.sum("n_links").alias("n_links"))
    roots = stage(components(linked.select(F.col("class").alias("a"), F.col("other").alias("b"))), "components")
    rows = classes.join(counts, "class", "left").join(roots.select(F.col("v").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = rows.where(F.col("class") != 0).groupBy("root").agg(F.min(key).alias("least"))
    return rows.join(least, "root", "left").select(
        key, "n_shingles", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("class") == 0, F.col(key)).otherwise(F.col("least")).alias("component_id")
    )


@op_query("op2_ngram_jaccard")
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join_similar(table(spark, sf_dir, "documents"), words=4, percent=85)
    return joined.select("doc_id", "n_shingles", "component_id", "n_links")
