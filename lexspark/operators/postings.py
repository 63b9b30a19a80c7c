"""A stored inverted index: postings in blocks of documents with bounds of their scores, added to segment by segment.

Tables under one folder, all written once and never changed:
- `postings/segment=`: by block and term, for each term and block of documents the number of holders, the largest frequency, the
  smallest length, and the entries (child, frequency, length, places), at most as many as a block has documents;
- `children/segment=`: each text's length and block, for the corpus statistics;
- `gone/segment=`: children of earlier segments that this segment replaces or deletes.
A text that changes adds its own postings in a new segment; `compact` makes one segment of all that is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lexspark.functions.text import search_terms
from lexspark.operators.retrieve import HELD_PAIRS, K1, B, Best, idf, query_phrases, top
from lexspark.sources.tables import give_back, picked, small_batches, written

#: Documents of a block, about; whole blocks are passed over.
BLOCK_DOCUMENTS = 256
POSTINGS = "term string, block int, holders long, most long, shortest int, entries array<struct<child_id: {kind}, f: long, length: int, places: array<int>>>, segment int"
CHILDREN = "child_id {kind}, length int, block int, segment int"
GONE = "child_id {kind}, segment int"


def inverted(children: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of texts (child_id, text): a row for each term and block, sorted by term within a block.

    The texts of a block, about BLOCK_DOCUMENTS, meet in one task and are inverted there, so texts are shuffled once and
    their entries not at all: a term of all texts is as many rows as there are blocks.
    """
    rows = children.select("child_id", F.pmod(F.xxhash64("child_id"), F.lit(blocks)).cast("int").alias("block"), "text")
    kind = children.schema["child_id"].dataType.simpleString()
    # a task takes whole blocks in order; terms are cut after the shuffle, as texts are smaller than their terms
    dealt = small_batches(rows.repartition(_tasks(children.sparkSession, blocks), "block").sortWithinPartitions("block"))
    cut = dealt.select("child_id", "block", search_terms(F.col("text")).alias("terms"))
    lists = cut.mapInArrow(_inverter, f"term string, block int, holders long, most long, shortest int, entries array<struct<child_id:{kind},f:long,length:int,places:array<int>>>")
    return lists, rows.select("child_id", F.size(search_terms(F.col("text"))).alias("length"), "block")


def _tasks(spark: SparkSession, blocks: int) -> int:
    """Tasks that invert: some 32,000 texts each, at least one for each core, so that files don't multiply."""
    return min(blocks, max(spark.sparkContext.defaultParallelism, -(-blocks // 128)))


def _inverter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of postings of texts (child_id, block, terms) that come block by block."""
    held: list[pa.RecordBatch] = []

    def settle() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        child, block, terms = (whole.column(c).combine_chunks() for c in ("child_id", "block", "terms"))
        lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(terms).dictionary_encode()
        names = coded.dictionary
        rank = np.empty(len(names), np.int64)
        rank[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
        term = rank[coded.indices.to_numpy(zero_copy_only=False)]
        text = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(term)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.lexsort((place, text, term))
        term, text, place = term[order], text[order], place[order]
        new_entry = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (text[1:] != text[:-1])]) if len(term) else np.zeros(0, int)
        entry_term, entry_text = term[new_entry], text[new_entry]
        f = np.diff(np.r_[new_entry, len(term)])
        new_row = np.flatnonzero(np.r_[True, entry_term[1:] != entry_term[:-1]]) if len(new_entry) else np.zeros(0, int)
        places = pa.ListArray.from_arrays(pa.array(np.r_[new_entry, len(term)], pa.int32()), pa.array(place, pa.int32()))
        length = lengths[entry_text]
        entry = pa.StructArray.from_arrays([child.take(pa.array(entry_text)), pa.array(f, pa.int64()), pa.array(length, pa.int32()), places], names=["child_id", "f", "length", "places"])
        columns = [
            pa.array(names).take(pc.array_sort_indices(names)).take(pa.array(entry_term[new_row])),
            pa.array(np.full(len(new_row), block[0].as_py()), pa.int32()),
            pa.array(np.diff(np.r_[new_row, len(new_entry)]), pa.int64()),
            pa.array(np.maximum.reduceat(f, new_row) if len(new_row) else f, pa.int64()),
            pa.array(np.minimum.reduceat(length, new_row) if len(new_row) else length, pa.int32()),
            pa.ListArray.from_arrays(pa.array(np.r_[new_row, len(new_entry)], pa.int32()), entry),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["term", "block", "holders", "most", "shortest", "entries"])

    def parts(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(whole), 4096):
            yield whole.slice(low, 4096)

    for batch in batches:
        block = batch.column(1).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for low, high in zip(cuts, cuts[1:]):
            if held and high > low and held[-1].column(1)[0].as_py() != block[low]:
                yield from parts(settle())
                held.clear()
            if high > low:
                held.append(batch.slice(low, high - low))
    if held:
        yield from parts(settle())
    held.clear()
    give_back()


class StoredPostings:
    """The inverted index under a folder of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "long"):
        self.spark, self.root, self.kind = spark, root.rstrip("/"), kind
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def segments(self) -> list[int]:
        """Segments that are whole: what was cut short has no mark of its end, and its number is taken again."""
        folder = self._path(f"{self.root}/done")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        found = sorted(int(n) for n in names if n.isdigit())
        compacted = [int(n[5:]) for n in names if n.startswith("from_")]
        return [n for n in found if n >= max(compacted, default=0)]

    def _read(self, name: str, schema: str) -> DataFrame:
        parts = [f"{self.root}/{name}/segment={n}" for n in self.segments() if self._fs.exists(self._path(f"{self.root}/{name}/segment={n}"))]
        schema = schema.format(kind=self.kind)
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*parts)

    def postings(self) -> DataFrame:
        return self._read("postings", POSTINGS)

    def gone(self) -> DataFrame | None:
        """(child_id, before): postings of segments before that number don't count; None if nothing was replaced."""
        if not any(self._fs.exists(self._path(f"{self.root}/gone/segment={n}")) for n in self.segments()):
            return None
        return self._read("gone", GONE).groupBy("child_id").agg(F.max("segment").alias("before"))

    def _living(self, rows: DataFrame) -> DataFrame:
        """Rows (child_id, segment) of texts that a later segment hasn't replaced or deleted."""
        gone = self.gone()
        if gone is None:
            return rows
        return rows.join(gone, "child_id", "left").where("before is null or segment >= before").drop("before")

    def children(self) -> DataFrame:
        return self._living(self._read("children", CHILDREN))

    def _write(self, n: int, children: DataFrame, deleted: DataFrame | None) -> None:
        blocks = max(1, -(-children.count() // BLOCK_DOCUMENTS))
        lists, lengths = inverted(children, blocks)
        lists.write.mode("overwrite").parquet(f"{self.root}/postings/segment={n}")
        lengths.write.mode("overwrite").parquet(f"{self.root}/children/segment={n}")
        if deleted is not None:
            deleted.write.mode("overwrite").parquet(f"{self.root}/gone/segment={n}")
        self._fs.create(self._path(f"{self.root}/done/{n}"), True).close()

    def add(self, children: DataFrame) -> int:
        """Adds texts (child_id, text), in place of earlier ones of their ids; returns the segment's number.

        Ids are unique. Only the new texts are read and only their postings are written. Null texts have no terms and no length.
        """
        done = self.segments()
        n = 1 + max(done, default=0)
        replaced = None
        if done:
            replaced = written(self.children().select("child_id").join(children.select("child_id"), "child_id", "left_semi"))
            replaced = None if replaced.isEmpty() else replaced
        self._write(n, children, replaced)
        return n

    def delete(self, ids: DataFrame) -> int:
        """Takes texts (child_id) out; their postings stay on disk until the next compaction, but don't count."""
        n = 1 + max(self.segments(), default=0)
        self._write(n, ids.select("child_id", F.lit("").alias("text")).limit(0), ids.select("child_id").distinct())
        return n

    def compact(self) -> int:
        """One segment of all postings that count, made from the stored ones without their texts; older ones are read no more."""
        n = 1 + max(self.segments(), default=0)
        lengths = written(self.children().select("child_id", "length"))
        blocks = max(1, -(-lengths.count() // BLOCK_DOCUMENTS))
        entries = self._living(self.postings().select("term", "segment", F.explode("entries").alias("e")).select("term", "segment", "e.*"))
        block = F.pmod(F.xxhash64("child_id"), F.lit(blocks)).cast("int")
        lists = entries.groupBy("term", block.alias("block")).agg(
            F.count("*").alias("holders"), F.max("f").alias("most"), F.min("length").alias("shortest"), F.collect_list(F.struct("child_id", "f", "length", "places")).alias("entries")
        )
        lists.repartitionByRange("block").sortWithinPartitions("block", "term").write.mode("overwrite").parquet(f"{self.root}/postings/segment={n}")
        lengths.withColumn("block", block).write.mode("overwrite").parquet(f"{self.root}/children/segment={n}")
        self._fs.create(self._path(f"{self.root}/done/from_{n}"), True).close()
        self._fs.create(self._path(f"{self.root}/done/{n}"), True).close()
        return n

    def issues(self) -> list[str]:
        """What is wrong with the stored tables: marked segments without postings or children, repeated living children."""
        out = [f"segment {n} lacks {name}" for n in self.segments() for name in ("children", "postings") if not self._fs.exists(self._path(f"{self.root}/{name}/segment={n}/_SUCCESS"))]
        if not out and not self.children().groupBy("child_id").count().where("count > 1").isEmpty():
            out.append("a child is stored twice")
        return out

    def top_k(self, queries: DataFrame, k: int, allowed: DataFrame | None = None, held: int = HELD_PAIRS) -> DataFrame:
        """The k best texts by BM25 for each question (question_id, text), as retrieve.bm25_top_k gives them.

        First each question's blocks of the largest bounds are scored; its k-th score there is the least that counts. Of the
        other blocks only those whose bound reaches it are read. Bounds come from a block's largest frequency and smallest
        length, without its entries; a phrase's from those of its tokens. `allowed` (child_id, or question_id and child_id)
        filters texts; statistics stay those of all texts. Where the questions have at most `held` different words in all,
        tasks hold them and score a block's entries as a matrix product; else entries and words are joined.
        """
        asked = query_phrases(queries).withColumn("key", F.array_join("terms", " "))
        wanted = asked.select("key", F.size("terms").alias("m"), F.posexplode("terms").alias("i", "term")).distinct()
        met = picked(wanted, self.postings(), "term")  # else all lists would be dealt by term
        stats = self.children().agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length")).first()
        kind = queries.schema["question_id"].dataType
        if not stats.n_docs or k <= 0:
            return top(self.spark.createDataFrame([], f"question_id {kind.simpleString()}, child_id {self.kind}, score double"), ["question_id"], "score", "child_id", 1)
        mean = stats.mean_length or 1.0
        parts = lambda f, length: f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(mean)))
        # what only needs the rows' heads: bounds of each key in each block that holds all its tokens
        heads = met.groupBy("key", "m", "segment", "block").agg(F.count("*").alias("have"), F.min("most").alias("most"), F.max("shortest").alias("shortest"), F.min("holders").alias("holders"))
        heads = heads.where("have = m").drop("have")
        found, counts = self._phrases(met, heads), None
        places = [F.col("key"), F.col("segment"), F.col("block")]
        # holders of single tokens are summed without entries, unless some texts don't count any more
        ids = None
        if self.gone() is None:
            counts = heads.where("m = 1").select("key", "holders")
        else:
            ids = written(self.children().select("segment", "block", "child_id"))
            counts = kept(met.where("m = 1").select(*places, F.col("entries.child_id").alias("child_id")), ids).select("key", F.size("child_id").cast("long").alias("holders"))
        if allowed is not None and "question_id" not in allowed.columns:
            ids = written((self.children().select("segment", "block", "child_id") if ids is None else ids).join(allowed.select("child_id").distinct(), "child_id", "left_semi"))
        if found is not None:
            counts = counts.unionByName(found.select("key", F.lit(1).cast("long").alias("holders")))
        counts = counts.groupBy("key").agg(F.sum("holders").alias("holders"))
        weights = asked.groupBy("question_id", "key").agg(F.count("*").alias("times")).join(counts, "key")
        weights = written(weights.select("question_id", "key", (F.col("times") * idf(F.lit(stats.n_docs), F.col("holders"))).alias("weight")))
        few = weights.limit(held + 1).collect()
        bounds = heads.join(weights, "key").groupBy("question_id", "segment", "block").agg(F.sum(F.col("weight") * parts(F.col("most"), F.col("shortest"))).alias("bound"))
        bounds = written(bounds)
        by_question = allowed is not None and "question_id" in allowed.columns

        # the names of blocks are few and go to the lists, as the semi-join is done before the lists meet the asked words
        def entries(blocks: DataFrame) -> DataFrame:
            """(key, segment, block, child_id, length, f) of all that counts in blocks (segment, block)."""
            lists = met.where("m = 1").join(blocks, ["segment", "block"], "left_semi")
            rows = self._living(lists.select("key", "segment", "block", F.explode("entries").alias("e")).select("key", "segment", "block", "e.child_id", "e.length", "e.f"))
            if found is not None:
                rows = rows.unionByName(found.join(blocks, ["segment", "block"], "left_semi").select("key", "segment", "block", "child_id", "length", "f"))
            if allowed is not None and not by_question:
                rows = rows.join(allowed.select("child_id").distinct(), "child_id", "left_semi")
            return rows

        def joined(blocks: DataFrame) -> DataFrame:
            rows = entries(F.broadcast(blocks.select("segment", "block").distinct())).join(blocks.join(weights, "question_id"), ["key", "segment", "block"])
            if by_question:
                rows = rows.join(allowed, ["question_id", "child_id"], "left_semi")
            return rows.groupBy("question_id", "child_id").agg(F.round(F.sum(F.col("weight") * parts(F.col("f"), F.col("length"))), 9).alias("score"))

        def in_place(blocks: DataFrame) -> DataFrame:
            some, one = F.broadcast(blocks.select("segment", "block").distinct()), lambda c: F.array(c).alias(c)
            wide = met.where("m = 1").join(some, ["segment", "block"], "left_semi").select(*places, *[F.col(f"entries.{c}").alias(c) for c in ("child_id", "length", "f")])
            if found is not None:
                wide = wide.unionByName(found.join(some, ["segment", "block"], "left_semi").select(*places, one("child_id"), one("length"), one("f")))
            if ids is not None:
                wide = kept(wide, ids)
            rows = small_batches(wide, 10_000).repartition("segment", "block").sortWithinPartitions("segment", "block").select("segment", "block", "key", "child_id", "length", "f")
            best = rows.mapInArrow(_scorer([(r.question_id, r.key, r.weight) for r in few], k, mean), f"question int, child_id {self.kind}, score double")
            named = list(enumerate(dict.fromkeys(r.question_id for r in few)))
            names = self.spark.createDataFrame(named, StructType([StructField("question", IntegerType()), StructField("question_id", kind)]))
            return best.join(F.broadcast(names), "question").select("question_id", "child_id", "score")  # at most `held` rows

        scored = joined if by_question or len(few) > held else in_place
        first = top(bounds.withColumn("_b", F.struct("segment", "block")), ["question_id"], "bound", "_b", 1 + -(-k // BLOCK_DOCUMENTS)).select("question_id", "segment", "block")
        begun = written(top(scored(first), ["question_id"], "score", "child_id", k).drop("rank"))
        # a block that was scored for one question may be scored again for another: each text counts once
        both = begun.unionByName(scored(blocks_left(bounds, begun, k))).groupBy("question_id", "child_id").agg(F.max("score").alias("score"))
        return top(both, ["question_id"], "score", "child_id", k)

    def _phrases(self, met: DataFrame, heads: DataFrame) -> DataFrame | None:
        """(key, segment, block, child_id, length, f) of keys of several tokens, wherever these adjoin; None without such keys."""
        if met.where("m > 1").select("key").isEmpty():
            return None
        lists = met.where("m > 1").join(heads.where("m > 1").select("key", "segment", "block"), ["key", "segment", "block"], "left_semi")
        entries = lists.select("key", "m", "i", "segment", "block", F.explode("entries").alias("e")).select("key", "m", "i", "segment", "block", "e.*")
        starts = entries.select("key", "m", "i", "segment", "block", "child_id", "length", F.explode("places").alias("place"))
        starts = starts.groupBy("key", "m", "segment", "block", "child_id", "length", (F.col("place") - F.col("i")).alias("start")).agg(F.count("*").alias("have")).where("have = m")
        return written(self._living(starts.groupBy("key", "segment", "block", "child_id", "length").agg(F.count("*").alias("f"))))


def kept(lists: DataFrame, ids: DataFrame) -> DataFrame:
    """Lists (key, segment, block, and entries as equally long arrays, one of them child_id) without the texts that ids
    (segment, block, child_id) lacks. Lists meet a block's ids as they are stored, so entries are never rows of a shuffle."""
    names = lists.columns
    columns = [c for c in names if c not in ("key", "segment", "block")]

    def of_block(stored: pa.Table, own: pa.Table) -> pa.Table:
        child = pc.list_flatten(stored.column("child_id"))
        keep = pc.is_in(child, value_set=own.column("child_id").combine_chunks())
        row = np.repeat(np.arange(len(stored)), pc.list_value_length(stored.column("child_id")).to_numpy())
        counts = np.bincount(row[keep.to_numpy()], minlength=len(stored))
        offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
        out = stored.select([c for c in stored.column_names if c not in columns])
        for c in columns:
            out = out.append_column(c, pa.ListArray.from_arrays(offsets, pc.list_flatten(stored.column(c)).filter(keep).combine_chunks()))
        return out.filter(pa.array(counts > 0)).select(names)

    of = lambda rows: rows.groupBy("segment", "block")
    return of(lists).cogroup(of(ids)).applyInArrow(of_block, lists.schema)


def blocks_left(bounds: DataFrame, begun: DataFrame, k: int) -> DataFrame:
    """(question_id, segment, block) of blocks whose bound reaches the k-th score found so far, or any where fewer were found."""
    least = begun.groupBy("question_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    rest = bounds.join(least, "question_id", "left")
    return rest.where(F.coalesce(F.col("n") < k, F.lit(True)) | (F.col("bound") >= F.col("least") - 1e-6)).select("question_id", "segment", "block")


def _scorer(pairs: list[tuple], k: int, mean: float, words: int = 8192):
    """Scores blocks of entries, sorted by block, against all questions, and keeps k texts for each: pairs are (question, key,
    weight). Questions may be long, so a product is over `words` words at a time."""
    questions = {q: n for n, q in enumerate(dict.fromkeys(q for q, _, _ in pairs))}
    names = sorted({key for _, key, _ in pairs})
    place = {key: n for n, key in enumerate(names)}
    table = np.array([(questions[q], place[key]) for q, key, _ in pairs], np.int64).reshape(-1, 2)
    weight = np.array([w for *_, w in pairs], float)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Best(len(questions), k), None
        matrix = np.zeros((len(names), len(questions))) if len(names) * len(questions) <= 20_000_000 else None
        if matrix is not None:
            matrix[table[:, 1], table[:, 0]] = weight
        held: list[pa.RecordBatch] = []

        def weights(columns: np.ndarray, first: int) -> np.ndarray:
            if matrix is not None:
                return matrix[columns, first : first + 512]
            some = (table[:, 0] >= first) & (table[:, 0] < first + 512) & np.isin(table[:, 1], columns)
            part = np.zeros((len(columns), min(512, len(questions) - first)))
            part[np.searchsorted(columns, table[some, 1]), table[some, 0] - first] = weight[some]
            return part

        def settle() -> None:
            whole = pa.Table.from_batches(held).combine_chunks()
            sizes = pc.list_value_length(whole.column("f")).to_numpy()
            key = np.repeat(pc.fill_null(pc.index_in(whole.column("key"), value_set=pa.array(names, pa.string())), -1).to_numpy(), sizes)
            child, f, length = (pc.list_flatten(whole.column(c)).to_numpy() for c in ("child_id", "f", "length"))
            known = key >= 0
            ids, row = np.unique(child[known], return_inverse=True)
            value = (f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean)))[known]
            for low in range(0, len(ids), 1024):
                here = (row >= low) & (row < low + 1024)
                every, at = np.unique(key[known][here], return_inverse=True)
                for first in range(0, len(questions), 512):
                    scores = 0.0
                    for start in range(0, len(every), words):
                        columns, some = every[start : start + words], (at >= start) & (at < start + words)
                        cells = np.zeros((min(1024, len(ids) - low), len(columns)))
                        cells[row[here][some] - low, at[some] - start] = value[here][some]
                        scores = scores + cells @ weights(columns, first)
                    best.add(np.round(scores, 9), ids[low : low + 1024], first)

        last = None
        for batch in batches:
            kind = batch.schema.field("child_id").type.value_type
            if not len(batch):
                continue
            block = batch.column("block").to_numpy(zero_copy_only=False) + (batch.column("segment").to_numpy(zero_copy_only=False).astype(np.int64) << 32)
            if last is not None and block[0] != last:
                settle()
                held.clear()
            # whole blocks are settled together; the last one may go on in the next batch
            start = int(np.searchsorted(block, block[-1]))
            if start:
                held.append(batch.slice(0, start))
                settle()
                held.clear()
            held.append(batch.slice(start))
            last = block[-1]
        if held:
            settle()
        if kind is not None:
            question, ids, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(question, pa.int32()), pa.array(ids, kind), pa.array(score, pa.float64())], names=["question", "child_id", "score"])

    return search
