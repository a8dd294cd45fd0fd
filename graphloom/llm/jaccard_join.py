"""N-gram Jaccard join: documents whose 5-word shingle sets overlap by 0.8 or more, exactly, by signature trees.

1. Every text becomes its set of hashed shingles; equal sets share a class id (a hash of the set; the rare different
   sets that share one are told apart by a second hash), so exact copies are one class from the start.
2. Sets that link share an element among the first n - ceil(0.8 n) + 1 of each under any one order of all elements.
   The order puts elements that a corpus-wide count found frequent last, so passages, boilerplate and stop words
   are rarely among the first. The count only orders; it drops nothing. Classes that share a prefix element form
   a bucket.
3. Leaders: every class is compared with one other class, the smallest of the most of its buckets, by bitmaps and then by whole sets.
   A group of near copies is joined here by a star, in rows linear in the classes. Links give components.
4. Signature trees: buckets that still span several components are gathered by the component that most of their classes
   belong to, so that buckets of one group of documents are searched once. A small group is one task's. A large one is cut into
   units by size (linked sizes are in the same or the next one) and by hash, members of the component itself apart, as they need
   no search among each other, and each pair of units is a task's. A task goes down trees over its classes by pairs of nodes,
   dropping those of one component and those that cannot overlap enough. This is done twice: with bitmaps alone, which leaves
   the classes that may have a link, and for those with the whole sets, whose pairs are compared and joined in the task, so
   that only links between what was apart come out. The rows that are sent grow with the classes of a group times its units,
   not with its pairs.
5. Components again, and back to the documents.

No link between different texts is lost: every pair that shares a prefix element is in one component or examined in 3 or 4.
Sets are exact up to 64-bit hashes of shingles.

Defined results: null, empty and wordless texts have no shingles and form components of their own; repeated rows are
copies of each other (a doc_id that comes twice is one document and gives two rows); a null doc_id links like any
other, and is a component's id only where it has no other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm import common
from graphloom.llm import signature_tree as st
from graphloom.llm.components import components

WIDTH = 5
#: Elements that a window of COUNTED shingles holds in HEAVY sets or more are counted; the ORDERED most frequent ones in
#: the corpus come last in the order. These bound the order's table, not what is compared.
COUNTED, HEAVY, ORDERED = 1 << 21, 3, 1 << 17
#: Classes and elements of a unit of a group, about; a unit holds one class at least. A group within both is not cut.
UNIT, UNIT_ELEMENTS = 1024, 1 << 20
#: Ratio of the sizes at which a unit ends: a little above 5 / 4, so that linked sizes are in the same or the next unit.
SPREAD = 1.2501

_U = np.uint64
_STEP = [_U(common._MULT * (2 * k + 3) % (1 << 64) | 1) for k in range(WIDTH)]


def sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a large_string slice."""
    data, offsets = common.buffer(column)
    n = len(column)
    start, end, doc = common.words(data, offsets)
    word = common.span_hash(common.prefix_hash(common.lower(data)), start, end)
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    full = max(0, len(word) - WIDTH + 1)
    shingle = np.zeros(full, _U)
    for k in range(WIDTH):
        shingle += word[k : k + full] * _STEP[k]
    shingle = common.mix(shingle)
    out = []
    for i in range(n):
        a, size = first[i], count[i]
        if size >= WIDTH:
            s = np.sort(shingle[a : a + size - WIDTH + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif size:
            total = sum((word[a + k] * _STEP[k] for k in range(size)), _U(0)) + _U(size)
            out.append(common.mix(np.array([total ^ _U(common._MULT)], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def class_ids(elements: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set: where different sets share the first, the second stands for them."""
    one, two = elements.sum(dtype=_U), common.mix(elements ^ _U(common._MULT)).sum(dtype=_U)
    first = common.mix(common.mix(np.array([one], _U)) ^ (two + _U(len(elements))))
    second = common.mix(first ^ common.mix(np.array([one + two * _U(common._MULT)], _U)))
    return int(common.signed(first)[0]), int(common.signed(second)[0])


def class_id(elements: np.ndarray, clashing: frozenset[int]) -> int:
    first, second = class_ids(elements)
    return second if first in clashing else first


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _texts(batches) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    """(batch, first row, sets) of slices of batches whose last column is the text."""
    for batch in batches:
        text = common.large(batch.column(batch.num_columns - 1))
        for a, b in common.slices(text):
            with np.errstate(over="ignore"):
                yield batch, a, sets(text.slice(a, b - a))


_FIRST = ["kind", "doc_id", "h", "a", "b", "n", "least", "bits"]
_FIRST_SCHEMA = "kind int, doc_id long, h long, a long, b long, n long, least long, bits binary"


def _signatures(batches):
    """Rows of documents (kind 0: doc_id, hash of the text, class, second class id, size, and once a task for each class the smallest
    hash and the bitmap) and of frequent elements (kind 1: element a, count n)."""
    seen, window, held = set(), [], 0

    def frequent():
        element, count = np.unique(np.concatenate(window), return_counts=True)
        some = count >= HEAVY
        k = int(some.sum())
        none = pa.nulls(k, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), none, none, pa.array(common.signed(element[some])), none, pa.array(count[some].astype(np.int64)), none, pa.nulls(k, pa.binary())], _FIRST)

    for batch, at, found in _texts(batches):
        ids, least, bits = [class_ids(s) for s in found], [], []
        for c, s in zip(ids, found):
            new = len(s) and c not in seen
            if new:
                seen.add(c)
                window.append(s)
                held += len(s)
            least.append(int(common.signed(s[:1])[0]) if new else None)
            bits.append(st.signature(s).tobytes() if new else None)
        numbers = [pa.array(x, pa.int64()) for x in ([c[0] for c in ids], [c[1] for c in ids], [len(s) for s in found], least)]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), *(batch.column(k).slice(at, len(ids)) for k in (0, 1)), *numbers, pa.array(bits, pa.binary())], _FIRST)
        if held >= COUNTED:
            yield frequent()
            window, held = [], 0
    if held:
        yield frequent()


def _prefixes(known):
    """(key, class) of the prefix elements of every set, once a task."""

    def run(batches):
        element, count, clashing = known.value
        seen = set()
        for _, _, found in _texts(batches):
            keys, ids = [], []
            for s in found:
                if not len(s) or (c := class_id(s, clashing)) in seen:
                    continue
                seen.add(c)
                p = prefix_size(len(s))
                if len(element):
                    at = np.minimum(np.searchsorted(element, s), len(element) - 1)
                    often = element[at] == s
                    rare = s[~often]
                    if len(rare) < p:
                        rest = s[often]
                        rare = np.concatenate([rare, rest[np.argsort(count[at[often]], kind="stable")[: p - len(rare)]]])
                    s = rare
                keys.append(s[:p])
                ids.append(np.full(p, c, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(common.signed(np.concatenate(keys))), pa.array(np.concatenate(ids))], ["key", "class"])

    return run


def _elements(known):
    """(class, elements) of every text's set, once a task."""

    def run(batches):
        clashing, seen = known.value[2], set()
        for _, _, found in _texts(batches):
            rows = []
            for s in found:
                if len(s) and (c := class_id(s, clashing)) not in seen:
                    seen.add(c)
                    rows.append((c, s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["class", "elements"])

    return run


def _linked(batches):
    """The (a, b) pairs whose sets link."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
            ok.append(bool(st.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok, pa.bool_())) for k in (0, 1)], ["a", "b"])


def _likely(batches):
    """The (a, b) pairs whose sizes and bitmaps allow a link."""
    for batch in batches:
        ok = []
        for x, y, n, m in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
            ok.append(5 * n >= 4 * m and 5 * m >= 4 * n and st.may_link(np.frombuffer(x, _U), np.frombuffer(y, _U), n, m))
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok, pa.bool_())) for k in (0, 1)], ["a", "b"])


def _traverse(kind: str):
    """Of each pair of units, the classes that may have a link (by bitmaps), or the links that join what is apart (by elements); rows come
    sorted by (g, task)."""

    def run(batches):
        held: list[list[tuple]] = [[], []]
        now = None

        def done():
            left, right = held if held[0] else held[::-1]
            found = (st.partnered if kind == "bits" else st.search)(left, right or left, not right) if left else []
            if found:
                columns = [[now[0]] * len(found), [now[1]] * len(found), found] if kind == "bits" else list(zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["g", "task", "class"] if kind == "bits" else ["a", "b"])

        for batch in batches:
            for g, task, side, c, component, *rest in zip(*(x.to_pylist() for x in batch.columns)):
                if (g, task) != now:
                    yield from done()
                    now, held = (g, task), [[], []]
                *known, raw = rest
                known = [known[0], known[1] & common._MASK] if known else []
                held[side].append((c, component, *known, np.frombuffer(raw, _U)))
        yield from done()

    return run


def _sided(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """(a, b) pairs with the columns of both classes. A class of many pairs is split by adaptive execution, as both tables are settled."""
    side = lambda k: of.select(F.col("class").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns])
    return common.bounded(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", *[f"{c}_{k}" for c in columns for k in "ab"]))


def _gathered(members: DataFrame, sizes: DataFrame, label: DataFrame) -> DataFrame:
    """(g, task, side, class, component): the groups that buckets across components make, whole (task -1) or as pairs of units."""
    tagged = members.select("key", "class").join(label.select(F.col("node").alias("class"), "label"), "class", "left").select("key", "class", F.coalesce("label", "class").alias("component"))
    whole = W.partitionBy("key")
    tagged = tagged.repartition("key").withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key", "component")))
    tagged = tagged.select("class", "component", F.max(F.struct("n", -F.col("component"))).over(whole).alias("most"), F.min("component").over(whole).alias("lo"), F.max("component").over(whole).alias("hi"))
    rows = tagged.where("lo < hi").select((-F.col("most")["col2"]).alias("g"), "class", "component").distinct()
    rows = common.settle(rows.join(sizes.select("class", "n"), "class").select("g", "class", "component", "n"), "open-rows")
    few = (F.count(F.lit(1)) <= UNIT) & (F.sum("n") <= UNIT_ELEMENTS)
    groups = common.settle(rows.groupBy("g").agg(few.alias("few")), "groups")
    rows = rows.join(groups, "g")
    # within a small group only classes with another one of like size next to them (in order of size) can link
    near = W.partitionBy("g").orderBy("n", "class")
    small = rows.where("few").withColumn("down", F.lag("n").over(near)).withColumn("up", F.lead("n").over(near)).where("5 * down >= 4 * n OR 5 * n >= 4 * up")
    small = small.select("g", F.lit(-1).cast("long").alias("task"), F.lit(0).alias("side"), "class", "component")
    if groups.where("NOT few").isEmpty():
        return common.settle(small, "task-rows")
    inside = (F.col("component") == F.col("g")).cast("int")
    rows = common.settle(rows.where("NOT few").select("g", "class", "component", "n", F.floor(F.log("n") / F.log(F.lit(SPREAD))).cast("int").alias("s"), inside.alias("inside")), "large")
    lanes = F.ceil(F.greatest(F.count(F.lit(1)) / UNIT, F.sum("n") / UNIT_ELEMENTS)).cast("int")
    units = common.settle(rows.groupBy("g", "s", "inside").agg(lanes.alias("lanes"), F.min("component").alias("lo"), F.max("component").alias("hi")), "units")
    x = units.select("g", "s", "inside", "lanes", "lo", "hi", F.explode(F.array("s", F.col("s") + 1)).alias("t"))
    y = units.select("g", F.col("s").alias("t"), F.col("inside").alias("within"), F.col("lanes").alias("others"), F.col("lo").alias("low"), F.col("hi").alias("high"))
    pairs = x.join(y, ["g", "t"]).where("inside + within < 2 AND NOT (lo = hi AND low = high AND lo = low) AND (s < t OR inside >= within)")
    same = (F.col("s") == F.col("t")) & (F.col("inside") == F.col("within"))
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).withColumn("j", F.explode(F.sequence(F.when(same, F.col("i")).otherwise(0), F.col("others") - 1)))
    tasks = common.settle(pairs.withColumn("task", F.monotonically_increasing_id()), "tasks")
    mine = rows.join(units.select("g", "s", "inside", "lanes"), ["g", "s", "inside"]).withColumn("lane", F.pmod(F.xxhash64("class"), "lanes").cast("int")).select("g", "s", "inside", "lane", "class", "component")
    mine = common.settle(mine, "unit-rows")
    home = tasks.select("task", F.lit(0).alias("side"), "g", "s", "inside", F.col("i").alias("lane"))
    guest = tasks.where(~(same & (F.col("i") == F.col("j")))).select("task", F.lit(1).alias("side"), "g", F.col("t").alias("s"), F.col("within").alias("inside"), F.col("j").alias("lane"))
    large = mine.join(home.unionByName(guest), ["g", "s", "inside", "lane"]).select("g", "task", "side", "class", "component")
    return common.settle(small.unionByName(large), "task-rows")


def classed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, component, component_id) of every row of (doc_id, text): h is a hash of the text, component a number that only rows of
    a component share (null without shingles)."""
    spark = docs.sparkSession
    texts = common.bounded(docs).select("doc_id", F.xxhash64("text").alias("h"), "text")
    first = common.settle(texts.mapInArrow(common.kernel(_signatures), _FIRST_SCHEMA), "shingle-classes")
    found = first.where("kind = 0")
    sizes = common.settle(found.groupBy(F.col("a").alias("class")).agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min("b").alias("lo"), F.max("b").alias("hi")), "sizes")
    # different sets of one id are as good as never there, so this list is short at any size
    clashing = frozenset(r["class"] for r in sizes.where("lo < hi").select("class").collect())
    if clashing:
        found = found.withColumn("a", F.when(F.col("a").isin(*clashing), F.col("b")).otherwise(F.col("a")))
        sizes = common.settle(found.groupBy(F.col("a").alias("class")).agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id")), "sizes")
    found = found.withColumnRenamed("a", "class")
    top = first.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(ORDERED).toArrow()
    element, often = top.column("a").to_numpy().view(_U), top.column("n").to_numpy()
    order = np.argsort(element)
    known = spark.sparkContext.broadcast((element[order], often[order], clashing))

    key = W.partitionBy("key")
    members = texts.select("text").mapInArrow(common.kernel(_prefixes(known)), "key long, class long")
    members = members.select("key", "class", F.lag("class").over(key.orderBy("class")).alias("before"), F.min("class").over(key).alias("lead"), F.max("class").over(key).alias("last"))
    members = common.settle(members.where("lead < last AND (before IS NULL OR before < class)").select("key", "class", "lead"), "buckets")
    votes = members.where("class <> lead").repartition("class").groupBy("class", "lead").agg(F.count(F.lit(1)).alias("n"))
    picked = common.settle(votes.groupBy("class").agg(F.max_by("lead", F.struct("n", -F.col("lead"))).alias("lead")).select(F.col("lead").alias("a"), F.col("class").alias("b")), "leaders")
    busy = picked.select(F.explode(F.array("a", "b")).alias("class"))  # a class of a bucket has a leader or is one
    bits = common.settle(found.where("bits IS NOT NULL").join(busy, "class", "left_semi").select("class", "n", "least", "bits").dropDuplicates(["class"]), "bits")

    def elements(of: DataFrame) -> DataFrame:
        """The whole sets of classes, made again from one text of each."""
        of = common.settle(of.distinct(), "wanted")
        rep = common.settle(sizes.join(of, "class", "left_semi").select(F.col("doc_id").alias("rep")).distinct(), "wanted-ids")
        chosen = texts.select("doc_id", "text").join(rep, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
        made = chosen.mapInArrow(common.kernel(_elements(known)), "class long, elements binary")
        return common.settle(made.join(of, "class", "left_semi").dropDuplicates(["class"]), "sets")

    pairs = common.settle(_sided(picked, bits, "bits", "n").mapInArrow(_likely, "a long, b long"), "led")
    links = _sided(pairs, elements(pairs.select(F.explode(F.array("a", "b")).alias("class"))), "elements")
    links = common.settle(links.mapInArrow(_linked, "a long, b long"), "links")

    gathered = _gathered(members, sizes, components(links))
    dealt = lambda rows: common.bounded(rows).repartition(common.partitions(docs), "g", "task").sortWithinPartitions("g", "task")
    maybe = dealt(gathered.join(bits, "class").select("g", "task", "side", "class", "component", "n", "least", "bits"))
    maybe = common.settle(maybe.mapInArrow(_traverse("bits"), "g long, task long, class long"), "partnered")
    whole = elements(maybe.select("class"))
    rows = dealt(gathered.join(maybe, ["g", "task", "class"], "left_semi").join(whole, "class").select("g", "task", "side", "class", "component", "elements"))
    more = common.settle(rows.mapInArrow(_traverse("elements"), "a long, b long"), "links")
    label = components(links.unionByName(more))

    placed = found.select("doc_id", "h", "class", "n").join(label.select(F.col("node").alias("class"), "label"), "class", "left")
    placed = common.settle(placed.select("doc_id", "h", "n", F.when(F.col("n") > 0, F.coalesce("label", "class")).alias("component")), "placed")
    least = common.settle(placed.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    some = placed.where("n > 0").join(least, "component").select("doc_id", "h", "n", "component", "component_id")
    return some.unionByName(placed.where("n = 0").withColumn("component_id", F.col("doc_id")))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text)."""
    return classed(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, of its smallest doc_id (of several rows of that id, the one with the smallest
    text hash; of rows alike in both, any); rows without shingles stay.

    Rows are told apart by doc_id and text, not by doc_id alone. Only what is to go, and rows that repeat, are joined with the texts.
    """
    d, h = (common.column_name(docs, x) for x in ("_doc", "_hash"))
    placed = common.settle(classed(docs).where("n > 0").groupBy("component", "doc_id", "h").agg(F.count(F.lit(1)).alias("rows")), "placed")
    best = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("best"))
    stays = F.col("doc_id").eqNullSafe(F.col("best")["doc_id"]) & (F.col("h") == F.col("best")["h"])
    marked = placed.join(common.settle(best, "best"), "component").select(F.col("doc_id").alias(d), F.col("h").alias(h), "rows", stays.alias("stays")).where("NOT stays OR rows > 1")
    marked = common.settle(marked, "marked")
    of = lambda m: docs["doc_id"].eqNullSafe(m[d]) & (F.xxhash64(docs["text"]) == m[h])
    plain = marked.select(d, h)
    several = marked.where("stays").select(d, h)
    return docs.join(plain, of(plain), "left_anti").unionByName(docs.join(several, of(several), "left_semi").dropDuplicates(["doc_id", "text"]))


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
SQL: dict[str, str] = {}
