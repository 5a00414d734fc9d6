"""Phrase collocations by set-oriented relational mining (SETM).

Texts are cut into pieces at punctuation and line ends, pieces into words. The relation of length k holds every
occurrence of a frequent k-word phrase: its piece, its position in the piece and the phrase. It is kept sorted by piece
and position and stored, in blocks of about BLOCK_WORDS consecutive words: one row holds a block's occurrences in order, as numbers of
the block's own list of phrases. One round makes length k + 1:

1. *Merge-join* by piece and adjacent position: inside a block, the occurrences at positions i and i + 1 of one piece
   make a candidate occurrence. A block that ends inside a piece carries the few words behind it, so no phrase is lost.
2. *Group and count*: a block hands on each of its distinct candidates once, with its count. Words are summed by a window over the
   word; longer candidates travel packed, as sorted runs of one of about ``blocks / RANGE_BLOCKS`` ranges of their hash, and a range
   sums the runs of all blocks. The first (block, number) that has a phrase becomes its name.
3. *Semi-join*: names of frequent candidates go back to the blocks that have them, packed by run, the others disappear from the relation.

Only distinct candidates per block are shuffled, never occurrences, so the most frequent word or phrase has
one entry per block. A range holds about RANGE_BLOCKS blocks' worth of candidates, however large the table; there are never more runs than
candidates. The blocks themselves travel packed, one row each.

A phrase's names of its first and of its last k - 1 words lead to the frequencies of all its parts by joins over frequent phrases, which
are at most one per MIN_COUNT words of the input. Products are decimals of 38 digits.

A phrase inside a longer candidate as frequent as itself is dropped. It is enough to look at phrases one word longer:
whatever lies between the two is at least as frequent as the longer one.

Defined results: a null or empty text has no words; a null language counts as ``und``; ids take no part, so null and
repeated ids, and repeated rows, count like others; further columns are ignored; an empty table gives no rows. Texts are read
in stretches, however long. The table must give the same rows in the same order when a task runs again (files or a stored table).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicgauge.llm.common import LETTERS_LOW, LETTERS_UP, rows_of
from topicgauge.sources.storage import materialize

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: Words per block, and bytes of text that are split at a time: a block has at most the words of one stretch more.
BLOCK_WORDS = 1 << 20
STRETCH = 1 << 20
#: Bits of a candidate's number within its block, and of a block's number within its partition.
LOCAL_BITS, NUMBER_BITS = 22, 16
#: Blocks whose candidates one range of hashes holds, on average.
RANGE_BLOCKS = 8

_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Letters to lower case, piece ends to line feeds, tabs to spaces: then pieces and words are what split() gives.
_TABLE = bytes.maketrans(LETTERS_UP.encode() + _ENDS + b"\t", LETTERS_LOW.encode() + b"\n" * len(_ENDS) + b" ")
_CUT = re.compile(rb"[ \n]")

WORDS = "block long, owned int, n int, ids binary, follows binary, langs array<string>, totals array<long>, key_lang array<int>, word array<binary>, counts array<long>"
PAIRS = "block long, owned int, n int, ids binary, part array<int>, start array<int>, size array<int>, run array<binary>"
#: Of a run: the numbers and names of its frequent candidates, and the phrases of which it is the first to have them.
COUNTED = "block long, n int, locals binary, names binary, own array<long>, first array<long>, rest array<long>, f array<long>"


def packed(values: np.ndarray) -> bytes:
    """Compressed, the first bytes of all numbers before their second ones."""
    bytes_ = np.ascontiguousarray(values).view("u1").reshape(len(values), values.itemsize)
    return pa.compress(bytes_.T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    held = pa.decompress(data, n * width, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(held, "u1").reshape(width, n).T).view(kind).reshape(n)


def packed_run(first: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> bytes:
    """Candidates sorted by their first part: steps of the first parts, the rests, the counts."""
    steps = np.diff(first, prepend=0)
    return b"".join(len(c).to_bytes(4, "little") + c for c in map(packed, (steps, rest.astype("<i8"), counts.astype("<i4"))))


def unpacked_run(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    columns, at = [], 0
    for kind in ("<i8", "<i8", "<i4"):
        stop = at + 4 + int.from_bytes(data[at : at + 4], "little")
        columns.append(unpacked(data[at + 4 : stop], kind, n))
        at = stop
    return np.cumsum(columns[0]), columns[1], columns[2]


def range_of(first: np.ndarray, rest: np.ndarray, ranges: int) -> np.ndarray:
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rest.astype(np.uint64)
    mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)


def stretches(text: bytes, size: int | None = None, least: int = MAX_WORDS) -> Iterator[tuple[bool, list[bytes]]]:
    """(does a new piece begin here, words) of a text. Words that go on a piece come at least ``least`` at a time, unless it ends."""
    size = STRETCH if size is None else size
    text = text.translate(_TABLE)
    begins, held, at = True, [], 0
    while at < len(text):
        cut = _CUT.search(text, at + size)
        stop = cut.start() if cut else len(text)
        first, *others = text[at:stop].split(b"\n")
        held += first.split()
        if others:
            if held:
                yield begins, held
            for piece in others[:-1]:
                if words := piece.split():
                    yield True, words
            begins, held = True, others[-1].split()
        if len(held) >= least:
            yield begins, held
            begins, held = False, []
        at = stop
    if held:
        yield begins, held


class Numbers(dict):
    """Numbers words in the order in which they come."""

    def __init__(self, keys: list[tuple[int, bytes]], lang: int):
        super().__init__()
        self.keys_of_block, self.lang = keys, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.keys_of_block)
        self.keys_of_block.append((self.lang, word))
        return number


class Block:
    """Consecutive words of pieces of any languages."""

    def __init__(self):
        self.keys: list[tuple[int, bytes]] = []
        self.langs: dict[str, int] = {}
        self.numbers: dict[str, Numbers] = {}
        self.ids: list[int] = []
        self.ends: list[int] = []  # positions behind which no word of the same piece follows

    def add(self, lang: str, begins: bool, words: list[bytes]) -> None:
        if begins and self.ids:
            self.ends.append(len(self.ids) - 1)
        numbers = self.numbers.get(lang)
        if numbers is None:
            numbers = self.numbers[lang] = Numbers(self.keys, self.langs.setdefault(lang, len(self.langs)))
        self.ids += map(numbers.__getitem__, words)

    def row(self, number: int, ahead: tuple[str, list[bytes]] | None = None) -> dict:
        """The block as a row; ``ahead`` are words of the piece the block ends in."""
        owned = len(self.ids)
        if ahead:
            self.add(ahead[0], False, ahead[1])
        ids = np.array(self.ids, "<i4")
        follows = np.ones(len(ids), "u1")
        follows[self.ends] = 0
        follows[-1:] = 0
        counts = np.bincount(ids[:owned], minlength=len(self.keys))
        lang = np.array([k for k, _ in self.keys], np.int32)
        totals = np.bincount(lang, counts, minlength=len(self.langs)).astype(np.int64)
        return {
            "block": TaskContext.get().partitionId() << NUMBER_BITS | number, "owned": owned, "n": len(ids), "ids": packed(ids), "follows": packed(follows),
            "langs": list(self.langs), "totals": totals, "key_lang": lang, "word": [w for _, w in self.keys], "counts": counts,
        }


def arrow_of(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}

    def kind(name: str) -> pa.DataType:
        return pa.list_(kinds[name[6:-1]]) if name.startswith("array<") else kinds[name]

    return pa.schema([(name, kind(k)) for name, k in (f.split() for f in ddl.split(", "))])


def batch_of(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    def one(value, kind):
        if not pa.types.is_list(kind):
            return pa.array([value], kind)
        values = pa.array(value, kind.value_type)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return pa.RecordBatch.from_arrays([one(row[f.name], f.type) for f in schema], schema=schema)


def word_blocks(docs: DataFrame, max_words: int = MAX_WORDS, block_words: int | None = None) -> DataFrame:
    """The relation of all words, before rare ones are dropped."""
    limit, schema = block_words or BLOCK_WORDS, arrow_of(WORDS)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(), 0
        for lang, text in rows_of(batches):
            lang = "und" if lang is None else lang.decode("utf-8", "replace")
            for begins, words in stretches(text or b"", least=max_words):
                if len(block.ids) >= limit:
                    if number >> NUMBER_BITS:
                        raise ValueError("too many blocks in a partition")
                    yield batch_of(block.row(number, None if begins else (lang, words[: max_words - 1])), schema)
                    block, number = Block(), number + 1
                block.add(lang, begins, words)
        if block.ids:
            yield batch_of(block.row(number), schema)

    return docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(scan, WORDS)


def stored(df: DataFrame) -> DataFrame:
    """:func:`materialize`, compressed more: these tables are read once or twice."""
    setting = "spark.sql.parquet.compression.codec"
    before = df.sparkSession.conf.get(setting)
    df.sparkSession.conf.set(setting, "zstd")
    try:
        return materialize(df)
    finally:
        df.sparkSession.conf.set(setting, before)


def frequent_words(blocks: DataFrame, min_count: int) -> DataFrame:
    """``own, lang, word, f, name, block, local`` of every word of a block that is frequent over all blocks."""
    lang = F.transform("key_lang", lambda k: F.get("langs", k))
    keys = F.arrays_zip(lang.alias("lang"), F.col("word"), F.col("counts").cast("array<int>").alias("count"))
    own = F.shiftleft("block", LOCAL_BITS).bitwiseOR(F.col("local").cast("long"))
    named = blocks.select("block", F.posexplode(keys).alias("local", "_k")).select(own.alias("own"), "_k.*")
    same = W.partitionBy("lang", "word")
    named = named.withColumns({"f": F.sum("count").over(same), "name": F.min("own").over(same)}).filter(F.col("f") >= min_count).drop("count")
    local = F.col("own").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1)).cast("int")
    return stored(named.withColumns({"block": F.shiftright("own", LOCAL_BITS), "local": local}))


def frequent_pairs(blocks: DataFrame, min_count: int) -> DataFrame:
    """COUNTED: of every run the candidates that are frequent over all blocks."""
    schema = arrow_of(COUNTED)

    def count(runs: pa.Table) -> pa.Table:
        rows = zip(*(runs[c].to_pylist() for c in ("block", "start", "size", "run")))
        columns = [
            (np.arange(start, start + size) | block << LOCAL_BITS, *unpacked_run(run, size)) for block, start, size, run in rows
        ]
        own, first, rest, counts = map(np.concatenate, zip(*columns))
        order = np.lexsort((rest, first))
        own, first, rest, counts = own[order], first[order], rest[order], counts[order]
        starts = np.flatnonzero(np.append(True, (np.diff(first) != 0) | (np.diff(rest) != 0)))
        f = np.add.reduceat(counts, starts, dtype=np.int64)
        alike = np.diff(np.append(starts, len(own)))
        name, f = np.repeat(np.minimum.reduceat(own, starts), alike), np.repeat(f, alike)
        kept = np.flatnonzero(f >= min_count)
        kept = kept[np.argsort(own[kept])]
        block = own[kept] >> LOCAL_BITS
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        batches = []
        for at in np.split(kept, cuts[1:]) if len(cuts) else []:
            named = at[own[at] == name[at]]
            row = {
                "block": own[at[0]] >> LOCAL_BITS, "n": len(at), "locals": packed((own[at] & (1 << LOCAL_BITS) - 1).astype("<i4")),
                "names": packed(name[at].astype("<i8")), "own": own[named], "first": first[named], "rest": rest[named], "f": f[named],
            }
            batches.append(batch_of(row, schema))
        return pa.Table.from_batches(batches, schema)

    runs = blocks.select("block", F.explode(F.arrays_zip("part", "start", "size", "run")).alias("_r")).select("block", "_r.*")
    return stored(runs.groupBy("part").applyInArrow(count, COUNTED))


def extended(blocks: DataFrame, names: DataFrame, ranges: int) -> DataFrame:
    """PAIRS: the candidates one word longer, from the blocks and the names of their frequent phrases."""
    schema, first_round = arrow_of(PAIRS), "follows" in blocks.columns

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        n, owned = left["n"][0].as_py(), left["owned"][0].as_py()
        ids = unpacked(left["ids"][0].as_py(), "<i4", n)
        size = int(ids.max(initial=-1)) + 1
        name_of = np.full(size + 1, -1, np.int64)  # the last stands for no phrase
        if first_round:
            name_of[right["local"].to_numpy()] = right["name"].to_numpy()
        else:
            for count, locals_, own_names in zip(*(right[c].to_pylist() for c in ("n", "locals", "names"))):
                name_of[unpacked(locals_, "<i4", count)] = unpacked(own_names, "<i8", count)
        here = name_of[ids] >= 0
        pairs = here[:-1] & here[1:]
        if first_round:
            pairs &= unpacked(left["follows"][0].as_py(), "u1", n)[:-1] > 0
        at = np.flatnonzero(pairs)
        if not len(at):
            return schema.empty_table()
        codes, local = np.unique(ids[at].astype(np.int64) * size + ids[at + 1], return_inverse=True)
        counts = np.bincount(local[at < owned], minlength=len(codes))
        first, rest = name_of[codes // size], name_of[codes % size]
        part = range_of(first, rest, ranges)
        order = np.lexsort((first, part))
        place = np.empty(len(order), "<i4")
        place[order] = np.arange(len(order))
        longer = np.full(n, -1, "<i4")
        longer[at] = place[local]
        first, rest, counts, part = first[order], rest[order], counts[order], part[order]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        spans = list(zip(starts, [*starts[1:], len(part)]))
        row = {
            "block": left["block"][0].as_py(), "owned": owned, "n": n, "ids": packed(longer), "part": part[starts], "start": starts,
            "size": [b - a for a, b in spans], "run": [packed_run(first[a:b], rest[a:b], counts[a:b]) for a, b in spans],
        }
        return pa.Table.from_batches([batch_of(row, schema)])

    held = blocks.select("block", "owned", "n", "ids", *["follows"] * first_round)
    named = names.select("block", "local", "name") if first_round else names.select("block", "n", "locals", "names")
    return held.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(join, PAIRS)


def mined(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, block_words: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """``lang, n`` and, by length from 1 on, ``name, lang, phrase, last, f, firsts, rests`` of all frequent phrases.

    ``firsts`` and ``rests`` are the frequencies of the first and of the last 1, 2, ... words.
    """
    blocks = stored(word_blocks(docs, max_words, block_words))
    totals = blocks.select(F.explode(F.arrays_zip("langs", "totals")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.totals").alias("n"))
    ranges = -(-blocks.count() // RANGE_BLOCKS)
    names = frequent_words(blocks, min_count)
    word = F.col("word").cast("string")
    none = F.array().cast("array<bigint>")
    own_names = names.filter(F.col("own") == F.col("name"))  # one row per word: that of the block that names it
    found = [own_names.select("name", "lang", word.alias("phrase"), word.alias("last"), "f", none.alias("firsts"), none.alias("rests"))]
    for _ in range(1, max_words):
        blocks = stored(extended(blocks, names, ranges))
        names = frequent_pairs(blocks, min_count)
        parts = found[-1]
        first = parts.select(F.col("name").alias("first"), "lang", "phrase", F.col("f").alias("first_f"), "firsts")
        rest = parts.select(F.col("name").alias("rest"), "last", F.col("f").alias("rest_f"), "rests")
        phrases = names.select(F.explode(F.arrays_zip("own", "first", "rest", "f")).alias("_p")).select(F.col("_p.own").alias("name"), "_p.first", "_p.rest", "_p.f")
        longer = phrases.join(first, "first").join(rest, "rest").select(
            "name", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", F.array_append("firsts", F.col("first_f")).alias("firsts"),
            F.array_append("rests", F.col("rest_f")).alias("rests"), "first", "rest",
        )
        found.append(stored(longer))
    return totals, found


def weakest_cut(words: int) -> Column:
    """``score, k, l, r`` of the cut with the lowest score, the first of those that tie."""
    whole = lambda c: c.cast("decimal(18,0)")
    cuts = []
    for k in range(1, words):
        left, right = F.element_at("firsts", k), F.element_at("rests", words - k)
        share = (F.lit(1000).cast("decimal(4,0)") * whole(F.col("f"))).cast("decimal(20,0)") * whole(F.col("n"))
        score = F.call_function("div", share, whole(left) * whole(right))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, block_words: int | None = None
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's strongest phrases of 2 to ``max_words`` words."""
    totals, found = mined(docs, min_count, max_words, block_words)
    totals = materialize(totals)
    kept = None
    for words, rows in enumerate(found[1:], 2):
        if words < max_words:
            longer = found[words]
            inside = longer.select(F.col("first").alias("name"), "f").unionByName(longer.select(F.col("rest").alias("name"), "f"))
            rows = rows.join(inside.groupBy("name").agg(F.max("f").alias("longer_f")), "name", "left").filter("longer_f IS NULL OR longer_f < f")
        cut = rows.join(totals, "lang").withColumn("cut", weakest_cut(words))
        part = cut.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
        kept = part if kept is None else kept.unionByName(part)
    if kept is None:
        raise ValueError("phrases have at least two words")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
