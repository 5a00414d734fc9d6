"""Near duplicates by the Jaccard similarity of word n-grams: a blocked sparse matrix product.

The incidence matrix of texts (rows) and n-grams (columns) is never multiplied whole. It is cut in
row blocks (what a scan task holds at a time) and column blocks (ranges of the n-gram's hash), and
its non-zeros travel as packed 64-bit numbers: 48 bits of the n-gram, 16 bits of the row.

1. Scan. Texts with the same n-gram set are one row (a class); copies fold here.
2. Column blocks count in how many rows each n-gram occurs. N-grams of a single row cannot overlap
   with anything: only the others return to their row block, with a grade of their frequency.
3. Row blocks apply the bound that follows from the size: texts of similarity J share at least
   J times the larger set, so among the n - ceil(J n) + 1 n-grams of a text that come first in any
   common order at least one is shared. The order is by frequency, single-row n-grams first. Most
   rows have too many of those and are out; the rest keep their few first shared n-grams.
4. Rows that share one of these are chained to clusters (a link to the smallest row of each n-gram,
   then connected components).
5. Within a cluster the product is computed exactly: overlap counts of row blocks against each
   other, accumulated over chunks of columns, and compared with the bound for the two sizes. Larger
   clusters are cut in blocks by size, and only blocks whose sizes allow a link meet. Each product
   returns a spanning set of links and the number of links of each row, never all pairs.
6. Components of these links, labelled by their smallest document id.

Nothing is capped or sampled, and pairs are never rows of a table. A frequent n-gram is folded in
the scan: where it fills more than HOT_SHARE of a row block, the column block receives one entry
with the count, and the row block keeps the rows itself. A group of copies is one row per block.
What stays quadratic is the arithmetic inside a cluster of texts that really are similar.

Defined results: words are what white space (space, tab to carriage return) separates, A-Z in lower
case; a text of one to n-1 words has one n-gram, all its words; a text without words, or null, has
none, links with nothing and is its own component; a null id takes the component of its class;
repeated rows are linked copies. The table must give the same rows in the same order when a task
runs again (a file scan or stored table).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicgauge.llm.common import Rows, arrow_schema, fresh, grouped, rows_of
from topicgauge.llm.components import components
from topicgauge.sources.storage import materialize

#: Words per n-gram, and the least similarity in hundredths.
WORDS = 5
PERCENT = 75
#: Non-zeros of a row block; a longer text is a block of its own.
BLOCK_ENTRIES = 1 << 20
BLOCK_ROWS = (1 << 16) - 2
#: An n-gram in more than this share of a block's rows, and in HOT_ROWS at least, is folded.
HOT_SHARE = 1 / 64
HOT_ROWS = 32
#: Rows of a cluster that are multiplied at a time, and columns per chunk.
PRODUCT_ROWS = 1024
PRODUCT_COLUMNS = 4096
#: Bytes of a text that are split in words at a time.
STRETCH = 4 << 20

_FOLDED = 0xFFFF
_LOW = np.uint64((1 << 48) - 1)
_S16, _S48 = np.uint64(16), np.uint64(48)
_SPACE = b" \t\n\r\x0b\x0c"
_ODD = np.uint64(0x9E3779B97F4A7C15)
PIECES = "kind int, block int, row_block long, entries binary, more binary"
ROWS = "doc_id long, n long, class binary, first binary, shared binary"
LINKS = "u binary, v binary, links long"


def word_hashes(text: bytes) -> np.ndarray:
    """The 64-bit hashes of the words, in order."""
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + STRETCH)
        while end < len(text) and text[end : end + 1] not in _SPACE:
            end += 1
        words = text[at:end].lower().split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.array([], np.uint64)


def ngrams(text: bytes, width: int = WORDS) -> np.ndarray:
    """The sorted set of the text's n-grams, as 64-bit hashes."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = (h ^ words[k : k + n]) * _ODD
        h ^= h >> np.uint64(32)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def class_of(grams: np.ndarray) -> bytes | None:
    """128 bits that name the set."""
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


class RowBlock:
    """Rows of the incidence matrix that a scan task holds at a time."""

    def __init__(self):
        self.docs: list[tuple] = []
        self.rows: dict[bytes, int] = {}
        self.grams: list[np.ndarray] = []
        self.entries = 0

    def add(self, doc_id: int | None, grams: np.ndarray) -> None:
        name = class_of(grams)
        self.docs.append((doc_id, len(grams), name))
        if name is not None and name not in self.rows:
            self.rows[name] = len(self.rows)
            self.grams.append(grams)
            self.entries += len(grams)

    def full(self) -> bool:
        return self.entries >= BLOCK_ENTRIES or len(self.rows) >= BLOCK_ROWS or len(self.docs) >= 4 * BLOCK_ROWS

    def pieces(self, number: int, blocks: int) -> Iterator[tuple]:
        """The block's rows, and its non-zeros by column block, as rows of PIECES."""
        home = number % blocks
        docs = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*self.docs), (pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "n", "class"]
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as out:
            out.write_batch(docs)
        yield 1, home, number, sink.getvalue().to_pybytes(), b""
        if not self.grams:
            return
        grams = np.concatenate(self.grams)
        row = np.repeat(np.arange(len(self.grams), dtype=np.uint64), [len(g) for g in self.grams])
        block = ((grams >> _S48) * np.uint64(blocks) >> _S16).astype(np.uint16)
        order = np.argsort(block, kind="stable")
        packed = ((grams & _LOW) << _S16 | row)[order]
        bounds = np.searchsorted(block[order], np.arange(blocks + 1))
        hot = max(HOT_ROWS, int(HOT_SHARE * len(self.grams)))
        for b in range(blocks):
            if bounds[b] == bounds[b + 1]:
                continue
            part = np.sort(packed[bounds[b] : bounds[b + 1]])
            first, size = runs(part >> _S16)
            if (size > hot).any():
                folded = np.repeat(size > hot, size)
                marks = part[first[size > hot]] | np.uint64(_FOLDED)
                yield 2, home, number, part[folded].tobytes(), np.uint64(b).tobytes()
                yield 0, b, number, np.concatenate([part[~folded], marks]).tobytes(), size[size > hot].astype("<u4").tobytes()
            else:
                yield 0, b, number, part.tobytes(), b""


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value begins, and how often it occurs."""
    if not len(sorted_values):
        return np.array([], np.int64), np.array([], np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return first, np.diff(np.append(first, len(sorted_values)))


def incidence(docs: DataFrame, blocks: int, width: int = WORDS) -> DataFrame:
    """Step 1."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(PIECES))
        task, turn, held = TaskContext.get().partitionId(), 0, RowBlock()

        def emit():
            for piece in held.pieces(task << 32 | turn, blocks):
                yield from out.add(piece, len(piece[3]) + len(piece[4]))

        for doc_id, text in rows_of(batches):
            held.add(doc_id, ngrams(text or b"", width))
            if held.full():
                yield from emit()
                turn, held = turn + 1, RowBlock()
        if held.docs:
            yield from emit()
        yield from out.flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, PIECES)


def column_block(pieces: pa.Table) -> pa.Table:
    """Step 2: the entries whose n-gram occurs in two rows or more go back, graded by frequency."""
    out: list[tuple] = []
    back: list[tuple] = []
    for kind, block, row_block, entries, more in zip(*(c.to_pylist() for c in pieces.columns)):
        if kind:
            out.append((kind, block, row_block, entries, more))
        else:
            back.append((block, row_block, np.frombuffer(entries, "<u8"), np.frombuffer(more, "<u4")))
    if back:
        entries = np.concatenate([e for *_, e, _ in back])
        weight = np.ones(len(entries), np.int64)
        weight[(entries & np.uint64(_FOLDED)) == _FOLDED] = np.concatenate([m for *_, m in back])
        order = np.argsort(entries >> _S16, kind="stable")
        first, size = runs((entries >> _S16)[order])
        rows = np.add.reduceat(weight[order], first)
        grade = np.zeros(len(entries), np.uint8)
        grade[order] = np.repeat(np.where(rows > 1, np.minimum(255, 4 * np.log2(rows)), 0).astype(np.uint8), size)
        at = 0
        for block, row_block, own, _ in back:
            own_grade = grade[at : at + len(own)]
            at += len(own)
            if own_grade.any():
                out.append((0, block, row_block, own[own_grade > 0].tobytes(), own_grade[own_grade > 0].tobytes()))
    schema = arrow_schema(PIECES)
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)


def unfold(block: int, entries: np.ndarray, grade: np.ndarray, folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace the entries that stand for folded rows by those rows."""
    mark = (entries & np.uint64(_FOLDED)) == _FOLDED
    if not mark.any():
        return entries, grade
    names, grades = entries[mark] >> _S16, grade[mark]
    order = np.argsort(names)
    at = np.searchsorted(names[order], folded >> _S16)
    at = np.minimum(at, len(names) - 1)
    known = names[order][at] == folded >> _S16
    return np.concatenate([entries[~mark], folded[known]]), np.concatenate([grade[~mark], grades[order][at][known]])


def row_block(pieces: pa.Table, percent: int = PERCENT) -> pa.Table:
    """Step 3: all rows, and for those that pass the bound their first shared n-grams and all shared ones."""
    docs, parts, folded = [], [], {}
    for kind, block, _, entries, more in zip(*(c.to_pylist() for c in pieces.columns)):
        if kind == 1:
            with pa.ipc.open_stream(entries) as stream:
                docs += zip(*(c.to_pylist() for c in stream.read_all().columns))
        elif kind == 2:
            folded[int(np.frombuffer(more, "<u8")[0])] = np.frombuffer(entries, "<u8")
        else:
            parts.append((block, np.frombuffer(entries, "<u8"), np.frombuffer(more, np.uint8)))
    out: list[tuple] = [(doc_id, n, name, None, None) for doc_id, n, name in docs]
    sizes = {name: n for _, n, name in docs if name is not None}  # in the order of the block's rows
    names, n = list(sizes), np.array(list(sizes.values()), np.int64)
    if parts:
        gram, row, grade = [], [], []
        for block, entries, graded in parts:
            entries, graded = unfold(block, entries, graded, folded.get(block, np.array([], "<u8")))
            gram.append(entries >> _S16 | np.uint64(block) << _S48)
            row.append((entries & np.uint64(_FOLDED)).astype(np.int64))
            grade.append(graded)
        gram, row, grade = np.concatenate(gram), np.concatenate(row), np.concatenate(grade)
        order = np.lexsort((gram, grade, row))
        gram, row = gram[order], row[order]
        shared = np.bincount(row, minlength=len(n))
        start = np.cumsum(shared) - shared
        least = -(-percent * n // 100)
        keep = (n - least + 1) - (n - shared)  # how many of the first n-grams are shared ones
        for k in np.flatnonzero(keep > 0):
            own = gram[start[k] : start[k] + shared[k]]
            out.append((None, int(n[k]), names[k], own[: keep[k]].tobytes(), np.sort(own).tobytes()))
    schema = arrow_schema(ROWS)
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)


def filtered_rows(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Steps 1 to 3, stored: a row per document, and (with ``first`` and ``shared``) one per possible class of a block."""
    blocks = min(60_000, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = incidence(docs, blocks, width).groupBy("block").applyInArrow(column_block, PIECES)
    # a number per row block is the key of the way back
    return materialize(columns.groupBy("row_block").applyInArrow(lambda pieces: row_block(pieces, percent), ROWS))


def clusters_of(rows: DataFrame) -> DataFrame:
    """Step 4: ``class, cluster`` of rows that share one of their first n-grams with another."""
    schema = "gram long, class binary"

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(schema))
        for name, first in rows_of(batches):
            for gram in np.frombuffer(first, "<i8").tolist():
                yield from out.add((gram, name))
        yield from out.flush()

    firsts = materialize(rows.select("class", "first").mapInArrow(explode, schema))
    hubs = firsts.groupBy("gram").agg(F.min("class").alias("hub"), F.max("class").alias("other")).filter(F.col("hub") != F.col("other"))
    links = firsts.join(hubs.select("gram", "hub"), "gram").filter(F.col("class") != F.col("hub"))
    found = components(links.select(F.col("class").alias("u"), F.col("hub").alias("v")).distinct())
    return found.select(F.col("node").alias("class"), F.col("root").alias("cluster"))


def products(rows: DataFrame, clusters: DataFrame, percent: int = PERCENT, block_rows: int = PRODUCT_ROWS) -> DataFrame:
    """``product, side, class, n, copies, shared``: which rows are multiplied with which."""
    # sizes that differ by two bands or more are further apart than the bound allows
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent))).cast("int")
    members = rows.join(clusters, "class").withColumn("band", band)
    cells = members.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("rows"))
    whole = cells.groupBy("cluster").agg(
        F.sum("rows").alias("all_rows"),
        F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("rows") / block_rows).cast("int").alias("parts")))).alias("parts"),
    )  # a cluster has at most as many bands as sizes have powers of 100 / percent
    placed = members.join(whole, "cluster")
    parts = lambda b: F.coalesce(F.try_element_at("parts", b), F.lit(0))
    own = F.pmod(F.xxhash64("class"), parts(F.col("band"))).cast("int")
    numbers = lambda n: F.filter(F.sequence(F.lit(0), n), lambda k: k < n)
    pair = lambda b, s, c, t, side: F.struct(b.alias("b"), s.alias("s"), c.alias("c"), t.alias("t"), side.alias("side"))
    me, here, zero, one = F.col("own"), F.col("band"), F.lit(0), F.lit(1)
    split = F.concat(
        F.transform(numbers(parts(here)), lambda t: pair(here, F.least(me, t), here, F.greatest(me, t), F.when(me <= t, 0).otherwise(1))),
        F.transform(numbers(parts(here + 1)), lambda t: pair(here, me, here + 1, t, zero)),
        F.transform(numbers(parts(here - 1)), lambda t: pair(here - 1, t, here, me, one)),
    )
    single = F.array(pair(F.lit(-9), zero, F.lit(-9), zero, zero))
    return (
        placed.withColumn("own", own)
        .withColumn("product", F.explode(F.when(F.col("all_rows") <= block_rows, single).otherwise(split)))
        .select("cluster", "product.b", "product.s", "product.c", "product.t", "product.side", "class", "n", "copies", "shared")
    )


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The product of two blocks of rows, accumulated over chunks of columns."""
    both = np.concatenate([*left, *right])
    columns, column = np.unique(both, return_inverse=True)
    total = np.zeros((len(left), len(right)), np.float32)
    row = np.concatenate([np.repeat(np.arange(len(side)), [len(g) for g in side]) for side in (left, right)])
    side = np.repeat([0, 1], [sum(map(len, left)), sum(map(len, right))])
    order = np.argsort(column, kind="stable")
    column, row, side = column[order], row[order], side[order]
    for at in range(0, len(columns), PRODUCT_COLUMNS):
        a, b = np.searchsorted(column, [at, at + PRODUCT_COLUMNS])
        width = min(PRODUCT_COLUMNS, len(columns) - at)
        blocks = []
        for k, rows_ in enumerate((left, right)):
            mine = side[a:b] == k
            block = np.zeros((len(rows_), width), np.float32)
            block[row[a:b][mine], column[a:b][mine] - at] = 1
            blocks.append(block)
        total += blocks[0] @ blocks[1].T
    return total.astype(np.int64)


def multiply(run: list[tuple], percent: int) -> Iterator[tuple]:
    """Step 5 for one product: ``(row, row it is connected with, copies of the rows it links with)``."""
    sides = [[r for r in run if r[5] == k] for k in (0, 1)]
    within = not sides[1] or run[0][1:3] == run[0][3:5]
    if within:
        sides = [run, run]
    elif not sides[0]:
        return
    grams = [[np.frombuffer(r[9], "<u8") for r in side] for side in sides]
    n = [np.array([r[7] for r in side], np.int64) for side in sides]
    copies = [np.array([r[8] for r in side], np.int64) for side in sides]
    common = overlaps(*grams)
    linked = 100 * common >= percent * (n[0][:, None] + n[1][None, :] - common)
    if within:
        np.fill_diagonal(linked, False)
    counts = [linked @ copies[1], copies[0] @ linked]
    # the smallest reachable row, by repeated minima along the links
    far = len(sides[0]) + len(sides[1])
    label = [np.arange(len(sides[0])), np.arange(len(sides[1])) + (0 if within else len(sides[0]))]
    while True:
        from_right = np.where(linked, label[1][None, :], far).min(axis=1, initial=far)
        a = np.minimum(label[0], from_right)
        b = a if within else np.minimum(label[1], np.where(linked, a[:, None], far).min(axis=0, initial=far))
        if (a == label[0]).all() and (b == label[1]).all():
            break
        label = [a, b]
    everyone = [r[6] for r in sides[0]] + ([] if within else [r[6] for r in sides[1]])
    for k in range(1 if within else 2):
        for r, root, links in zip(sides[k], label[k].tolist(), counts[k].tolist()):
            if links:
                yield r[6], everyone[root], links


def near_links(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, block_rows: int = PRODUCT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Steps 1 to 5: a row per document, and ``u, v, links`` between classes."""
    stored = filtered_rows(docs, width, percent)
    listed = stored.filter(F.col("shared").isNull()).select("doc_id", "n", "class")
    possible = stored.filter(F.col("shared").isNotNull()).select("n", "class", "first", "shared")
    possible = possible.groupBy("class").agg(*[F.any_value(c).alias(c) for c in ("n", "first", "shared")])
    copies = listed.groupBy("class").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(possible.join(copies, "class"))
    tasks = products(rows.select("class", "n", "copies", "shared"), clusters_of(rows), percent, block_rows)
    key = ["cluster", "b", "s", "c", "t"]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(LINKS))
        for _, run in grouped(rows_of(batches), len(key)):
            for row in multiply(run, percent):
                yield from out.add(row, 64)
        yield from out.flush()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = tasks.repartition(parts, *key).sortWithinPartitions(*key, "side", "class").mapInArrow(scan, LINKS)
    return listed, materialize(links)


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, block_rows: int = PRODUCT_ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row.

    ``n_links`` counts the other documents a document links with, copies included.
    """
    listed, links = near_links(docs, width, percent, block_rows)
    classes = listed.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    roots = materialize(components(links.select("u", "v")).select(F.col("node").alias("class"), "root"))
    smallest = roots.join(classes.select("class", "first_id"), "class").groupBy("root").agg(F.min("first_id").alias("least_id"))
    degree = links.groupBy(F.col("u").alias("class")).agg(F.sum("links").alias("links"))
    connected = roots.join(smallest, "root").join(degree, "class", "left").select("class", "root", "least_id", "links")
    known = (
        classes.join(connected, "class", "left").filter((F.col("copies") > 1) | F.col("root").isNotNull())
        .select(
            "class", F.coalesce("least_id", "first_id").alias("component"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    return listed.join(known, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def with_class(docs: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` and their class; a row without words gets a name of its own, shorter than that of a class."""
    text_at, names = docs.columns.index("text"), [*docs.columns, name]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        for batch in batches:
            classes = []
            for (text,) in rows_of([batch.select([text_at])]):
                turn += 1
                classes.append(class_of(ngrams(text or b"")) or (task << 40 | turn).to_bytes(12, "big"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(classes, pa.binary())], names)

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, and all rows without words.

    It is a row of the smallest id, null being the last, and among classes with that id of the
    smallest; of rows that share both the one with the least text. An id that also stands in other
    components does not keep their rows.
    """
    key, first_id, rows = fresh(docs, "class", "first_id", "rows")
    listed, links = near_links(docs)
    roots = components(links.select("u", "v")).select(F.col("node").alias("class"), "root")
    ids = listed.filter(F.col("class").isNotNull()).groupBy("class", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    classes = ids.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.sum("rows").alias("copies"), F.min_by("rows", "doc_id").alias("own"))
    groups = materialize(
        classes.join(roots, "class", "left").filter((F.col("copies") > 1) | F.col("root").isNotNull())
        .select("class", F.coalesce("root", "class").alias("root"), "first_id", F.coalesce("own", "copies").alias("rows"))
    )
    best = F.min(F.struct(F.col("first_id").isNull().alias("last"), "first_id", "class", "rows")).alias("best")
    stays = groups.groupBy("root").agg(best).select("best.class", "best.first_id", "best.rows")
    members = materialize(groups.select("class").join(stays, "class", "left").select(F.col("class").alias("of"), F.col("first_id").alias(first_id), F.col("rows").alias(rows)))
    (of,) = fresh(docs.select("*", *[F.lit(0).alias(c) for c in (key, first_id, rows)]), "of")
    judged = with_class(docs, key).join(members.withColumnRenamed("of", of), F.col(key) == F.col(of), "left")
    first = F.col("doc_id").cast("long").eqNullSafe(F.col(first_id))
    kept = judged.filter(F.col(of).isNull() | (F.col(rows) == 1) & first).select(*docs.columns)
    if members.filter(F.col(rows) > 1).isEmpty():
        return kept
    repeated = judged.filter((F.col(rows) > 1) & first).groupBy(key).agg(F.min_by(F.struct(*docs.columns), "text").alias("row"))
    return kept.unionByName(repeated.select("row.*"))
