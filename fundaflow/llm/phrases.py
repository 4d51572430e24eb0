"""Phrase collocations by SETM: relational mining of sorted occurrence relations.

The occurrence relation of level k says which frequent group of k words stands at each place.  It is stored
sorted by (piece, position) in blocks of bounded size.  One level: merge-join a block's relation with itself
at the adjacent position of the same piece, which is a step along the sorted block, and write the groups of
k + 1 words so found; group-count them over all blocks; semi-join each block's relation with the frequent ones
before the next level extends it.  Counts are combined within the block, so a phrase on every second line costs
one entry a block, and entries travel as packed columns of many.

Groups carry exact ids: a group of level k + 1 is (group of its first k words, group of its last k words), so
no hash can confuse two phrases.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fundaflow.llm.shared import pick, ship
from fundaflow.session import shared_dir

#: Words of a phrase at most, occurrences at least.
LONGEST, SUPPORT = 4, 30
#: A phrase goes where a longer one around it has so many percent of its occurrences.
COVERED = 80
#: Phrases of each language in the report.
TOP = 2000
#: Positions of a block, and entries that are counted in one task.
BLOCK, PART = 1 << 21, 1 << 22

# A-Z change case, the ends of pieces become line feeds, tabs blanks.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x0A if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 0x09 else c for c in range(256))
_WORDS = "block long, size int, groups binary, code int, lang string, word string, n long"
_KEYS = "block long, size int, groups binary, part int, `start` int, `left` binary, `right` binary, n binary"
_COUNTS = "block long, codes binary, ids binary, id long, `left` long, `right` long, f long"


def pieces(text: str | None) -> list[bytes]:
    """The words of a text in order; a line feed ends a piece."""
    return [w for w in (text or "").encode("utf-8", "replace").translate(_FOLD).replace(b"\n", b" \n ").split(b" ") if w]


class _Codes(dict):
    """Codes of a block's words from 1; the end of a piece is 0."""

    def __init__(self, counter: list[int]):
        super().__init__({b"\n": 0})
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        self.counter[0] += 1
        self[word] = code = self.counter[0]
        return code


class _Block:
    """The relation of level 1 while it is read: codes by position, each language with words of its own."""

    def __init__(self, number: int):
        self.number, self.size, self.counter = number, 0, [0]
        self.langs: dict[str, _Codes] = {}
        self.parts: list[np.ndarray] = []

    def add(self, lang: str, words: list[bytes], tail: list[bytes]) -> None:
        """`tail` are the words behind, which phrases that start here may reach into; none starts there."""
        if lang not in self.langs:
            self.langs[lang] = _Codes(self.counter)
        code = self.langs[lang].__getitem__
        self.parts.append(np.fromiter(map(code, words), np.int32, len(words)))
        self.size += len(words)
        if tail:
            self.parts.append(np.fromiter(map(code, tail), np.int32, len(tail)))
        else:
            self.parts.append(np.zeros(1, np.int32))
            self.size += 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(self.parts)
        count = np.bincount(codes[: self.size], minlength=self.counter[0] + 1)
        yield _batch(_WORDS, 1, block=[self.number], size=[self.size], groups=[_pack(codes)])
        for lang, known in self.langs.items():
            del known[b"\n"]
            code = np.fromiter(known.values(), np.int64, len(known))
            if len(code):
                yield _batch(_WORDS, len(code), block=np.full(len(code), self.number), code=code, lang=[lang] * len(code), word=[w.decode() for w in known], n=count[code])


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(schema: str, rows: int, **columns) -> pa.RecordBatch:
    """A batch of the schema; columns that are not given are null."""
    fields = [(name.strip("`"), _ARROW[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))]
    return pa.record_batch([pa.array(columns[n], t) if n in columns else pa.nulls(rows, t) for n, t in fields], names=[n for n, _ in fields])


def occurrences(docs: DataFrame, text_col: str, lang_col: str, block: int = BLOCK) -> DataFrame:
    """Level 1: a row per block (block, size, words) and a row per distinct word of a block (block, code, lang, word, n)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        now = _Block(first)
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                words = pieces(text.as_py())
                for at in range(0, len(words), block):
                    now.add(lang.as_py(), words[at : at + block], words[at + block : at + block + LONGEST - 1])
                    if now.size >= block or at + block < len(words):
                        yield from now.rows()
                        made += 1
                        now = _Block(first + made)
        if now.size:
            yield from now.rows()

    ship(docs.sparkSession)
    source = pick(docs, lang=lang_col, text=text_col).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return source.mapInArrow(read, _WORDS)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers of one type, byte by byte of their places, compressed: high bytes that are all zero cost nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def _order(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sorts by (left, right)."""
    wide = int(right.max(initial=0)) + 1
    if int(left.max(initial=0)) < (1 << 62) // wide:
        return np.argsort(left * wide + right, kind="stable")
    return np.lexsort((right, left))


def _part(left: np.ndarray, right: np.ndarray, parts: int) -> np.ndarray:
    mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _extended(block: int, size: int, groups: np.ndarray, ids: np.ndarray, parts: int, last: bool) -> Iterator[pa.RecordBatch]:
    """A block's next level: its relation, and its groups with their counts, sorted and dealt to parts.

    `groups` are codes by position, `ids` the ids of codes, 0 where they are not frequent or no group.
    """
    global_ids = ids[groups]
    at = np.flatnonzero((global_ids[:-1] > 0) & (global_ids[1:] > 0))  # merge-join with the adjacent position of the piece
    out = np.zeros(len(groups), np.int32)
    if len(at):
        seen, first, code = np.unique(groups[at].astype(np.int64) * len(ids) + groups[at + 1], return_index=True, return_inverse=True)
        left, right = global_ids[at[first]], global_ids[at[first] + 1]
        n = np.bincount(code[at < size], minlength=len(seen))
        part = _part(left, right, parts)
        order = _order(left, right)
        order = order[np.argsort(part[order], kind="stable")]
        rank = np.empty(len(seen), np.int32)
        rank[order] = np.arange(1, len(seen) + 1, dtype=np.int32)
        out[at] = rank[code]
        left, right, n, part = left[order], right[order], n[order], part[order]
        for k in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
            yield _batch(_KEYS, 1, block=[block], part=[int(part[k[0]])], start=[int(k[0]) + 1], left=[_pack(np.diff(left[k], prepend=0))], right=[_pack(right[k])],
                         n=[_pack(n[k].astype(np.int32))])
    if not last:
        yield _batch(_KEYS, 1, block=[block], size=[size], groups=[_pack(out)])


def _next_level(relation: DataFrame, back: DataFrame, parts: int, last: bool) -> DataFrame:
    """Semi-join and extension of all blocks; `back` has the ids of the codes that are frequent, as rows (of, code, id) or packed (of, codes, ids)."""

    def extend(block: pa.Table, frequent: pa.Table) -> pa.Table:
        out = [_batch(_KEYS, 0)]
        for row in block.to_pylist():
            groups = _unpack(row["groups"], np.int32)
            ids = np.zeros(int(groups.max(initial=0)) + 1, np.int64)
            if "code" in frequent.column_names:
                ids[frequent.column("code").to_numpy()] = frequent.column("id").to_numpy()
            else:
                for codes, known in zip(frequent.column("codes").to_pylist(), frequent.column("ids").to_pylist(), strict=True):
                    ids[_unpack(codes, np.int32)] = _unpack(known, np.int64)
            out += _extended(row["block"], row["size"], groups, ids, parts, last)
        return pa.Table.from_batches(out)

    blocks = relation.where("groups IS NOT NULL").select("block", "size", "groups")
    return blocks.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(extend, _KEYS)


def _counted(relation: DataFrame, parts: int, support: int) -> DataFrame:
    """The frequent groups (id, left, right, f) of a level, and per block the ids of its frequent codes (block, codes, ids)."""

    def count(part: pa.Table) -> pa.Table:
        number = part.column("part")[0].as_py()
        block, start = part.column("block").to_pylist(), part.column("start").to_pylist()
        left = [np.cumsum(_unpack(x.as_py(), np.int64)) for x in part.column("left")]
        sizes = [len(x) for x in left]
        left, right = np.concatenate(left), np.concatenate([_unpack(x.as_py(), np.int64) for x in part.column("right")])
        n = np.concatenate([_unpack(x.as_py(), np.int32) for x in part.column("n")]).astype(np.int64)
        order = _order(left, right)
        sorted_left, sorted_right = left[order], right[order]
        begins = np.flatnonzero(np.append(True, (np.diff(sorted_left) != 0) | (np.diff(sorted_right) != 0)))
        f = np.add.reduceat(n[order], begins)
        enough = f >= support
        ids = np.zeros(len(f), np.int64)
        ids[enough] = np.arange(int(enough.sum())) * parts + number + 1
        of = np.zeros(len(left), np.int64)
        of[order] = np.repeat(ids, np.diff(np.append(begins, len(left))))
        out = [_batch(_COUNTS, int(enough.sum()), id=ids[enough], left=sorted_left[begins[enough]], right=sorted_right[begins[enough]], f=f[enough])]
        for b, s, own in zip(block, start, np.split(of, np.cumsum(sizes)[:-1]), strict=True):
            some = np.flatnonzero(own)
            if len(some):
                out.append(_batch(_COUNTS, 1, block=[b], codes=[_pack((some + s).astype(np.int32))], ids=[_pack(own[some])]))
        return pa.Table.from_batches(out)

    return relation.where("part IS NOT NULL").select("part", "block", "start", "left", "right", "n").groupBy("part").applyInArrow(count, _COUNTS)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to LONGEST words with f >= support, and (lang, n) of all word occurrences.

    Each level is written to the shared folder and read again, so a lost executor costs its tasks only.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/phrases-{uuid.uuid4().hex}"

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    relation = stored(occurrences(docs, text_col, lang_col, block), "relation1")
    rows = relation.where("code IS NOT NULL")
    totals = stored(rows.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    counted = stored(rows.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= support), "counted1")
    numbered = counted.withColumn("at", F.monotonically_increasing_id())
    tasks = (numbered.agg(F.max(F.shiftright("at", 33))).first()[0] or 0) + 1
    words = stored(numbered.select("lang", "word", "f", (F.col("at").bitwiseAND((1 << 33) - 1) * tasks + F.shiftright("at", 33) + 1).alias("id")), "frequent1")
    back = rows.join(words, ["lang", "word"]).select(F.col("block").alias("of"), "code", "id")
    found = [words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("ending"), "f")]
    parts = max(8, -(-int(totals.agg(F.sum("n")).first()[0] or 0) // PART))
    for width in range(2, LONGEST + 1):
        relation = stored(_next_level(relation, back, parts, width == LONGEST), f"relation{width}")
        level = stored(_counted(relation, parts, support), f"frequent{width}")
        back = level.where("codes IS NOT NULL").select(F.col("block").alias("of"), "codes", "ids")
        begin = found[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"))
        end = found[-1].select(F.col("id").alias("right"), "ending")
        groups = level.where("id IS NOT NULL").select("id", "left", "right", "f")
        named = groups.join(begin, "left").join(end, "right").select("id", "lang", F.concat_ws(" ", "begin", "ending").alias("phrase"), "ending", "f")
        found.append(stored(named, f"named{width}"))
    every = found[0].select("lang", "phrase", F.lit(1).alias("k"), "f")
    for k, named in enumerate(found[1:], start=2):
        every = every.union(named.select("lang", "phrase", F.lit(k), "f"))
    return every, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, covered: int = COVERED, top: int = TOP,
                 block: int = BLOCK) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are split into pieces at `.,;:!?` and line ends and pieces into words at blanks and tabs; a phrase is
    2 to 4 words of one piece with a >= support occurrences.  Its lowest-scoring cut (ties: the shortest first
    part) gives l and r, the occurrences of both parts, and score floor(2000000 * a / (l + r)), exactly.  A
    phrase inside a longer one with at least `covered` percent of its occurrences goes.  n counts all words of
    the language.  A null or empty text has no words, a null lang is `und`, repeated rows count again, other
    columns are ignored whatever their names, an empty table gives an empty table.  Whole texts of any length.
    """
    every, totals = frequent_phrases(docs, text_col, lang_col, support, block)
    candidates = every.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("begin"), F.expr("array_join(slice(w, cut + 1, k - cut), ' ')").alias("end"))
    part = lambda name, count: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    scored = cuts.join(part("begin", "l"), ["lang", "begin"]).join(part("end", "r"), ["lang", "end"]).withColumn(
        "score", F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))

    spans = F.expr("flatten(transform(sequence(2, k - 1), size -> transform(sequence(1, k - size + 1), at -> array_join(slice(w, at, size), ' '))))")
    around = candidates.where("k > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    whole = f"coalesce(cast(longer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {covered}, false)"
    kept = best.join(around, ["lang", "phrase"], "left").where(f"NOT ({whole})").select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
