"""Exact Jaccard self-join of documents on their word shingles, as a blocked sparse matrix product.

The product of the document-by-shingle incidence matrix with its transpose holds all overlaps. Only a part of it
can reach the bound, and only that part is built:

1. One scan gives each document its set's size, a 64-bit class (equal sets, equal class) and a bit signature, and
   adds all shingles into a counting sketch of fixed size. Documents of one class count once from here on.
2. A second scan orders each set's shingles by the sketch, rare first (any order common to all documents is right;
   the sketch never undercounts, so frequent shingles come last). With a similarity of at least 4/5, two sets
   of sizes m and n share at least ceil(4/5 max(m, n)) shingles, so they meet within the first
   ``n - ceil(4n/5) + 1`` of each: those are the columns that count. They go to blocks of the shingle dimension.
3. A block sorts its incidences and multiplies its short columns out, adding up overlaps and discarding pairs whose
   sizes alone rule them out. Long columns (a passage or near copies in many documents) are not multiplied out:
   each of their documents is paired with the column's least one, which joins nearly all of a group of near copies
   into one component at a linear cost.
4. A pair's overlaps are added up over all blocks. What lies behind the columns that count is at most ``ceil(4n/5) - 1``
   shingles of the set whose columns end first, and of the long columns a pair shares at most as many as either set has;
   pairs whose overlap cannot reach 4/9 of both sizes that way are discarded (of equal sets of n shingles, those that share
   less than 4n/45 of their n/5 rarest). Then go pairs whose bit signatures differ in more places than their sizes
   allow; the rest is verified on the whole sets.
5. Long columns whose documents are not all in one component yet get further stars around other documents. What is
   then still divided is taken up pair by pair, for what stars may miss: pairs of documents whose components differ,
   within the bounds of sizes and bit signatures, each in the first column that they share. These are verified too, so
   no link is lost.

Components are found on classes. Shingles and classes are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from chatloom.llm import arrays
from chatloom.llm.components import components
from chatloom.scratch import release, written

WIDTH = 5
#: Similarity of at least NUM / DEN.
NUM, DEN = 4, 5
#: Counters of the sketch: 4 MB, whatever the corpus' size.
SKETCH_BITS = 20
SKETCH_ROWS = 64
#: Bit signatures of 2,048 bits rule out unlike sets of up to some 4,000 shingles; larger ones go on to verification.
SIGNATURE_WORDS = 32
#: Rounds of stars on long columns, each with other centres, before their remaining pairs are taken one by one.
STAR_ROUNDS = 2
#: Columns of up to this many documents are multiplied out.
SHORT = 16
#: Incidences of a block, about.
BLOCK = 1 << 18
BLOCKS_AT_LEAST = 64
FLUSH = 1 << 20
#: Bits of the filter of candidate classes (2 MB). What it lets through wrongly costs time only.
FILTER_BITS = 24
#: Stands for a key that is null where one is needed.
NO_ID = -(1 << 63) + 7


def _row_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, bounds = arrays.words(arrays.lowered(raw), offsets)
    return arrays.sets(*arrays.shingles(hashes, bounds, WIDTH))


def _classes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name for each row's set of values (in any order)."""
    sizes = np.diff(bounds).astype(np.uint64)
    return arrays.mixed(arrays.row_sums(arrays.mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds) + arrays.mixed(sizes))


def _signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row, 64 * SIGNATURE_WORDS bits: the parity of how many values fall on each bit.

    Sets whose signatures differ in d bits differ in d values at least.
    """
    n = len(bounds) - 1
    bits = 64 * SIGNATURE_WORDS
    row = np.repeat(np.arange(n), np.diff(bounds))
    where = (arrays.mixed(values + np.uint64(1)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(row * bits + where, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64).reshape(n, SIGNATURE_WORDS)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: a row per document, then the task's part of the sketch in SKETCH_ROWS rows."""
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()), ("signature", pa.list_(pa.int64())), ("part", pa.int32()), ("counts", pa.list_(pa.int64()))])
    for batch in batches:
        ids = batch.column(0)
        for first, last, raw, offsets in arrays.pieces(batch.column(1)):
            values, bounds = _row_sets(raw, offsets)
            sketch += np.bincount((values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            n = last - first
            signature = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * SIGNATURE_WORDS, pa.int32()), pa.array(_signatures(values, bounds).ravel()))
            yield pa.record_batch([ids.slice(first, n), pa.array(np.diff(bounds)), pa.array(_classes(values, bounds).view(np.int64)), signature, pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))], schema)
    for part, counts in enumerate(np.split(sketch, SKETCH_ROWS)):
        if counts.any():
            yield pa.record_batch([pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.list_(pa.int64())), pa.array([part], pa.int32()), pa.array([counts], pa.list_(pa.int64()))], schema)


def _sketch_order(scan: DataFrame) -> np.ndarray:
    """The place of each counter among all, smallest first: 2**SKETCH_BITS numbers, on the driver."""
    def added(table: pa.Table) -> pa.Table:
        total = sum(np.asarray(x.values) for x in table.column("counts"))
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([total], pa.list_(pa.int64()))})

    once = scan.where("part is not null").select("part", "counts")
    total = np.zeros((SKETCH_ROWS, (1 << SKETCH_BITS) // SKETCH_ROWS), np.int64)
    for row in once.groupBy("part").applyInArrow(added, "part int, counts array<bigint>").collect():
        total[row["part"]] = row["counts"]
    place = np.empty(1 << SKETCH_BITS, np.uint64)
    place[np.argsort(total.ravel(), kind="stable")] = np.arange(1 << SKETCH_BITS, dtype=np.uint64)
    return place


def _ordered(values: np.ndarray, bounds: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each value renamed, one to one, so that ascending order is rare first; each row sorted."""
    low = np.uint64(64 - SKETCH_BITS)
    out = (place[(values >> low).astype(np.int64)] << low) | (values & ((np.uint64(1) << low) - np.uint64(1)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    return out


def _fresh(classes: np.ndarray, seen: set) -> np.ndarray:
    """Which rows are the first of their class in this task."""
    out = np.zeros(len(classes), bool)
    for i, c in enumerate(classes.tolist()):
        if c not in seen:
            seen.add(c)
            out[i] = True
    return out


def _incidences(place_of, blocks: int):
    """Step 2 for a task: rows ``(block, shingles, classes, sizes)`` with packed arrays."""
    schema = pa.schema([("block", pa.int64()), ("shingles", pa.binary()), ("classes", pa.binary()), ("sizes", pa.binary())])

    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        shingles, classes, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        block = (arrays.mixed(shingles) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        found, starts = np.unique(block[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        packed = [[x[order[a:b]].tobytes() for a, b in zip(starts, ends, strict=True)] for x in (shingles, classes, sizes)]
        for i in range(0, len(found), 256):
            yield pa.record_batch([pa.array(found[i : i + 256]), *(pa.array(x[i : i + 256], pa.binary()) for x in packed)], schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seen, parts, held = place_of.value, set(), [], 0
        for batch in batches:
            for _, _, raw, offsets in arrays.pieces(batch.column(0)):
                values, bounds = _row_sets(raw, offsets)
                classes = _classes(values, bounds)
                count = np.diff(bounds)
                prefix = np.where(_fresh(classes, seen) & (count > 0), count - (NUM * count + DEN - 1) // DEN + 1, 0)
                ordered = _ordered(values, bounds, place)
                take = np.repeat(bounds[:-1] - np.cumsum(prefix) + prefix, prefix) + np.arange(prefix.sum())
                parts.append((ordered[take], np.repeat(classes, prefix), np.repeat(count, prefix).astype(np.int32)))
                held += len(take)
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [], 0
        if held:
            yield from flush(parts)

    return task


PRODUCT = "shingle bigint, a bigint, a_size int, b bigint, b_size int, overlap int"


def _product(table: pa.Table) -> pa.Table:
    """Step 3 for a block. Pairs of short columns with their overlap in this block; incidences of long columns with ``b`` null."""
    def whole(name: str, kind) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])

    shingles, classes, sizes = whole("shingles", np.uint64), whole("classes", np.int64), whole("sizes", np.int32)
    order = np.lexsort((classes, shingles))
    shingles, classes, sizes = shingles[order], classes[order], sizes[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (classes[1:] != classes[:-1])
    shingles, classes, sizes = shingles[new], classes[new], sizes[new]
    starts = np.flatnonzero(np.append(True, shingles[1:] != shingles[:-1]))
    length = np.diff(np.append(starts, len(shingles)))
    of = np.repeat(length, length)
    long = of > SHORT
    column = np.repeat(np.arange(len(starts)), length)
    pairs = []
    for gap in range(1, SHORT):
        i = np.flatnonzero((column[gap:] == column[:-gap]) & ~long[gap:])
        j = i + gap
        fits = DEN * np.minimum(sizes[i], sizes[j]).astype(np.int64) >= NUM * np.maximum(sizes[i], sizes[j]).astype(np.int64)
        pairs.append((i[fits], j[fits]))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((classes[j], classes[i]))
    i, j = i[order], j[order]
    if len(i):
        first = np.flatnonzero(np.append(True, (classes[i][1:] != classes[i][:-1]) | (classes[j][1:] != classes[j][:-1])))
        overlap = np.diff(np.append(first, len(i)))
        i, j = i[first], j[first]
    else:
        overlap = np.zeros(0, np.int64)
    k, left = len(i), np.flatnonzero(long)
    none = pa.nulls(len(left), pa.int64())
    return pa.table({
        "shingle": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(shingles[left].view(np.int64))]),
        "a": np.concatenate([classes[i], classes[left]]), "a_size": np.concatenate([sizes[i], sizes[left]]),
        "b": pa.concat_arrays([pa.array(classes[j]), none]), "b_size": pa.concat_arrays([pa.array(sizes[j]), none.cast(pa.int32())]),
        "overlap": pa.concat_arrays([pa.array(overlap.astype(np.int32)), none.cast(pa.int32())]),
    })


def _sets_of(filter_of):
    """The whole sets of the documents in the filter: rows ``(class, members)``."""
    schema = pa.schema([("class", pa.int64()), ("members", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(filter_of.value, np.uint8)
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            for first, last, raw, offsets in arrays.pieces(batch.column(1)):
                values, bounds = _row_sets(raw, offsets)
                classes = _classes(values, bounds)
                at = _filter_place(classes, ids[first:last])
                hit = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                for some in np.array_split(hit, 1 + len(hit) // 256):
                    if len(some):
                        yield pa.record_batch([pa.array(classes[some].view(np.int64)), pa.array([values[bounds[h] : bounds[h + 1]].tobytes() for h in some], pa.binary())], schema)

    return task


def _filter_place(classes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The bit of a class and of the document that stands for it."""
    return (arrays.mixed(classes.view(np.uint64) ^ arrays.mixed(ids.astype(np.int64).view(np.uint64))) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _class_filter(classes: DataFrame) -> bytes:
    """2**FILTER_BITS bits with those of the given rows ``(class, least)`` set. A task sends its bits packed, whatever their number."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[_filter_place(batch.column(0).to_numpy(), batch.column(1).fill_null(NO_ID).to_numpy())] = True
        packed = np.packbits(bits, bitorder="little")
        for part, bytes_ in enumerate(np.split(packed, SKETCH_ROWS)):
            if bytes_.any():
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([bytes_.tobytes()], pa.binary())], ["part", "bits"])

    def joined(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("bits")])
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    parts = classes.mapInArrow(task, "part int, bits binary").groupBy("part").applyInArrow(joined, "part int, bits binary")
    whole = np.zeros((SKETCH_ROWS, (1 << FILTER_BITS) // 8 // SKETCH_ROWS), np.uint8)
    for row in parts.collect():
        whole[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return whole.tobytes()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets are similar enough."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("a_set"), batch.column("b_set"), strict=True)):
            a, b = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
            both = np.concatenate([a, b])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep[i] = DEN * shared >= NUM * (len(a) + len(b) - shared)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _apart(a: str, b: str) -> F.Column:
    """In how many places two bit signatures differ."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SIGNATURE_WORDS)), F.lit(0))


def _may_link(a: str, b: str, a_size: str, b_size: str) -> F.Column:
    """Whether sizes and bit signatures leave a link possible.

    Sets with an overlap of at least NUM/DEN of their union differ in at most (DEN-NUM)/(DEN+NUM) of their sizes' sum.
    """
    sizes = DEN * F.least(a_size, b_size) >= NUM * F.greatest(a_size, b_size)
    return sizes & ((DEN + NUM) * _apart(a, b) <= (DEN - NUM) * (F.col(a_size) + F.col(b_size)))


def _may_reach(overlap: str, a_long: str, b_long: str, a_size: str, b_size: str) -> F.Column:
    """Whether a pair that shares ``overlap`` short columns can share as many shingles as a link asks for.

    Beyond short columns it shares no more than the fewer long columns of the two, and of what lies behind the columns that
    count no more than the longer rest of the two.
    """
    rest = f"({NUM} * greatest({a_size}, {b_size}) + {DEN - 1}) DIV {DEN} - 1"
    return F.expr(f"{DEN + NUM} * ({overlap} + least({a_long}, {b_long}) + {rest}) >= {NUM} * ({a_size} + {b_size})")


def _reaching(pairs: DataFrame, n_long: DataFrame) -> DataFrame:
    """Pairs ``(a, a_size, b, b_size, overlap)`` with a < b, each once with its overlaps added up, that sizes leave possible.

    ``n_long``: ``(class, n_long)`` of the classes with long columns, and in how many of them each is.
    """
    pairs = pairs.groupBy("a", "b").agg(F.min("a_size").alias("a_size"), F.min("b_size").alias("b_size"), F.sum("overlap").alias("overlap"))
    for side in ("a", "b"):
        pairs = pairs.join(n_long.select(F.col("class").alias(side), F.col("n_long").alias(f"{side}_long")), side, "left")
    return pairs.fillna(0, ["a_long", "b_long"]).where(_may_reach("overlap", "a_long", "b_long", "a_size", "b_size")).select("a", "b", "overlap")


def _possible(pairs: DataFrame, classes: DataFrame, n_long: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of classes that may link, by overlap and sizes, then by bit signatures; each once."""
    pairs = _reaching(pairs, n_long)
    for side in ("a", "b"):
        own = classes.select(F.col("class").alias(side), F.col("signature").alias(f"{side}_bits"), F.col("n_shingles").alias(f"{side}_size"))
        pairs = pairs.join(own, side)
    return pairs.where(_may_link("a_bits", "b_bits", "a_size", "b_size")).select("a", "b")


def _stars(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Pairs of each long column's centre with the classes of other components in it, as ``_reaching`` takes them."""
    ends = rows.join(centres, "shingle").where("component <> centre.component").select(F.struct("class", "size").alias("x"), F.struct("centre.class", "centre.size").alias("y"))
    low, high = F.least("x", "y"), F.greatest("x", "y")
    return ends.select(low["class"].alias("a"), low["size"].alias("a_size"), high["class"].alias("b"), high["size"].alias("b_size"), F.lit(0).alias("overlap"))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """The pairs ``(a, b)`` of classes that are links, by their whole sets.

    Only the documents that stand for a class in some pair send their sets, picked while scanning by a filter of fixed size.
    """
    spark = pairs.sparkSession
    pairs = written(pairs, f"{label}-pairs")
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    filter_of = spark.sparkContext.broadcast(_class_filter(ends.join(classes.select("class", "least"), "class").select("class", "least")))
    found = written(docs.mapInArrow(_sets_of(filter_of), "class bigint, members binary"), f"{label}-sets")
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("class").alias(side), F.col("members").alias(f"{side}_set")), side)
    links = written(pairs.mapInArrow(_linked, "a bigint, b bigint").distinct(), f"{label}-links")
    release(found)
    return links


def _near_duplicates_by_number(df: DataFrame, text: str, key: str) -> DataFrame:
    """``near_duplicates`` for keys of any ordered type: numbers that rise with the keys stand for them, so the least number is the least key's."""
    own = df.select(F.col(key).alias("k"), F.col(text).alias("text"))
    numbers = written(own.where("k IS NOT NULL").select("k").distinct().orderBy("k").select("k", F.monotonically_increasing_id().alias("number")), "ngram-keys")
    docs = written(own.join(numbers, "k", "left").select(F.col("number").alias("doc_id"), "text"), "ngram-numbered")
    found = near_duplicates(docs)
    for column, name in (("doc_id", "own_key"), ("component_id", "least_key")):
        found = found.join(numbers.select(F.col("number").alias(column), F.col("k").alias(name)), column, "left")
    return found.select(F.col("own_key").alias(key), "n_shingles", F.col("least_key").alias("component_id"))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row's ``key, n_shingles, component_id``; the component is named by its least key.

    Null, empty or blank text: no shingles, linked with nothing, its component is its own key. Fewer than five
    words: one shingle of them all, so such texts link only if equal. Null key: the row takes part in links, and its
    component is the least key that is not null in it, if any. Repeated rows each get a row. Empty table: no rows.
    Other columns don't matter, whatever their names. Keys may be of any type that has an order; those that aren't whole numbers are
    numbered in their order first.
    """
    if not isinstance(df.schema[key].dataType, IntegralType):
        return _near_duplicates_by_number(df, text, key)
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scan = written(docs.mapInArrow(_scan, "doc_id bigint, n_shingles bigint, class bigint, signature array<bigint>, part int, counts array<bigint>"), "ngram-scan")
    rows = scan.where("part is null")
    place_of = spark.sparkContext.broadcast(_sketch_order(scan))
    whole = rows.groupBy("class").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = written(whole, "ngram-classes")

    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    blocks = BLOCKS_AT_LEAST + total // DEN // BLOCK
    packed = docs.select("text").mapInArrow(_incidences(place_of, blocks), "block bigint, shingles binary, classes binary, sizes binary")
    product = written(packed.groupBy("block").applyInArrow(_product, PRODUCT), "ngram-product")
    short = product.where("b is not null").select("a", "a_size", "b", "b_size", "overlap")
    rows_of = written(product.where("b is null").select("shingle", F.col("a").alias("class"), F.col("a_size").alias("size"), F.col("a").alias("component")), "ngram-long")
    n_long = written(rows_of.groupBy("class").agg(F.count("*").alias("n_long")), "ngram-counts")
    links = tried = None
    for number in range(STAR_ROUNDS):
        # the first stars are around the least documents, which many columns share; later ones around others
        order = F.col("class") if number == 0 else F.xxhash64("class", "shingle", F.lit(number))
        centres = rows_of.groupBy("shingle").agg(F.min_by(F.struct("class", "component", "size"), order).alias("centre"))
        star = _stars(rows_of, centres)
        # a pair that short columns joined has been tried or discarded with all its overlap by the end of the first round
        new = _possible(short.union(star) if number == 0 else star.join(tried, ["a", "b"], "left_anti"), classes, n_long)
        new = written(new, f"ngram-try-{number}")
        found = _verified(new, docs, classes, f"ngram-star-{number}")
        tried = new if number == 0 else tried.union(new)
        named = written(components(found if links is None else links.union(found), f"ngram-{number}"), f"ngram-named-{number}")
        links = named.select(F.col("node").alias("a"), F.col("component").alias("b"))
        rows_of = rows_of.drop("component").join(named, F.col("class") == F.col("node"), "left").select("shingle", "class", "size", F.coalesce("component", "class").alias("component"))
        divided = rows_of.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle")
        rows_of = written(rows_of.join(divided, "shingle", "left_semi"), f"ngram-open-{number}")
        if rows_of.isEmpty():
            break
    else:
        own = rows_of.groupBy("class").agg(F.collect_list("shingle").alias("columns"))
        full = written(rows_of.join(own, "class").join(n_long, "class").join(classes.select("class", "signature"), "class"), "ngram-rest-rows")
        a, b = (full.select("shingle", *(F.col(c).alias(f"{s}_{c}") for c in ("class", "size", "component", "signature", "columns", "n_long"))) for s in ("a", "b"))
        first_shared = F.array_min(F.array_intersect("a_columns", "b_columns"))
        reach = _may_reach("0", "a_n_long", "b_n_long", "a_size", "b_size")
        test = (F.col("a_component") < F.col("b_component")) & reach & _may_link("a_signature", "b_signature", "a_size", "b_size") & (a["shingle"] == first_shared)
        rest = a.join(b, (a["shingle"] == b["shingle"]) & test).select(F.least("a_class", "b_class").alias("a"), F.greatest("a_class", "b_class").alias("b"))
        more = _verified(rest.join(tried, ["a", "b"], "left_anti"), docs, classes, "ngram-rest")
        named = components(links.union(more), "ngram-all")

    together = classes.join(named, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("component", "class").alias("component"))
    together = written(together, "ngram-named")
    least = together.groupBy("component").agg(F.min("least").alias("component_id"))
    found = together.join(least, "component").select("class", "component_id")
    own = rows.select("doc_id", "n_shingles", "class").join(found, "class", "left")
    return own.select(F.col("doc_id").alias(key), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def kept_one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` with one document of each component left: the one with its least key.

    A row without shingles or without a key has no component to leave it for and stays. Rows that repeat both key and
    text are one document, of which one stays; rows that share a key only are told apart by their texts.
    """
    found = written(near_duplicates(df, text, key), "ngram-components")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own"))
    own_key = F.col("own")[key]
    dropped = found.where(F.col("component_id") < F.col(key)).select(F.col(key).alias("dropped")).distinct()
    kept = rows.join(dropped, own_key == F.col("dropped"), "left_anti")
    repeated = found.where(f"n_shingles > 0 AND {key} IS NOT NULL").groupBy(F.col(key).alias("repeated")).count().where("count > 1").select("repeated")
    if not repeated.isEmpty():
        same = own_key == F.col("repeated")
        twice = kept.join(repeated, same, "left_semi").select("own", own_key.alias("k"), F.col("own")[text].alias("t")).dropDuplicates(["k", "t"]).select("own")
        kept = kept.join(repeated, same, "left_anti").union(twice)
    return kept.select("own.*")
