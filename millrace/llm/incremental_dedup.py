"""Deduplicating new batches against all history (problem 1).

An index keeps, in the shared folder, the full vectors of all accepted records and inverted-file cells. A cell is named by
a few words of one sentence (see ``vectors``); a record stands in several cells for each of its sentences. A new
record probes the cells of its sentences, those of the emptiest cells first, until the sentences left hold no more than
``tail_share`` of its words: a record that is near enough shares more than that, so part of what it shares stands in
cells that were probed. Which words name a cell is drawn, so a sentence with changed words keeps each of its cells with
some probability only; recall is measured against brute force. Every pair met is then held against three exact bounds of
its similarity (sizes, words shared by the sketches, words shared at all), and those left are scored on the full vectors.

Also kept: the words' weights (frozen when the index is built), how full the cells are, by hash bucket, and the counts of
each source's lines, so that a later delivery reads no text of the history. A delivery counts once its ``rejected``
table is there; what an interrupted run left behind is written anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import vectors as vec
from millrace.llm.storage import exists, materialise, new_table, spread

CELLS = "record_id long, batch_no int, size int, cells array<long>"
_LAST = (1 << 31) - 1
PROBES = "cell long, b long, batch_b int, size_b int"


@dataclass(frozen=True)
class DedupConfig:
    """``least``: similarity from which a record is a duplicate. ``tail_share``: share of a record's words whose cells, the
    fullest ones, aren't probed; cells with up to ``few`` records always are. ``buckets``: hash buckets in which the cells are counted. ``hot_cell``: cells with more new
    records are thinned by their earliest ones before pairs are made. ``min_records`` and ``min_share`` say which lines of a
    source don't count as article. ``broadcast_lines``: number of such lines up to which tasks hold them all; more are joined.
    """

    least: float = 0.75
    tail_share: float = 0.5
    few: int = 8
    buckets: int = 1 << 20
    hot_cell: int = 64
    min_records: int = 5
    min_share: float = 0.05
    broadcast_lines: int = 500_000


def _source() -> Column:
    return F.xxhash64("source_id")


def line_counts(records: DataFrame) -> DataFrame:
    """(src, line, n): in how many records of a source each line stands; ``line`` null: how many records it has."""
    rows = spread(records.where("page_content is not null and source_id is not null").select(_source().alias("src"), "page_content"))
    return rows.mapInArrow(vec.source_lines, "src long, line long").groupBy("src", "line").agg(F.count(F.lit(1)).alias("n"))


def excessive_lines(counts: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(src, line): the excessive lines of each source."""
    total = counts.groupBy("src", "line").agg(F.sum("n").alias("n"))
    of = total.where("line is null").select("src", F.col("n").alias("of"))
    often = total.where(F.col("line").isNotNull() & (F.col("n") >= cfg.min_records)).join(of, "src")
    return often.where(F.col("n") >= cfg.min_share * F.col("of")).select("src", "line")


def vectorise(records: DataFrame, excessive: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    """Vectors of (record_id, batch_no, source_id, page_content), not yet written: ``vec.VECTOR_SCHEMA``.

    The excessive lines of its source are no part of a record; where the source is null, those of any source aren't. Rows
    with null text or id have no vector; a text without words, or of excessive lines only, has size 0 and duplicates nothing.
    A null batch comes last.
    """
    known = materialise(excessive, "excessive")
    rows = spread(records.where("page_content is not null and record_id is not null")).select(
        "record_id", F.coalesce("batch_no", F.lit(_LAST)).cast("int").alias("batch_no"), F.when(F.col("source_id").isNotNull(), _source()).alias("src"), "page_content"
    )
    if known.count() <= cfg.broadcast_lines:
        got = known.toArrow()
        gone: dict[int | None, set[int]] = {None: set(got.column("line").to_pylist())}
        for src, line in zip(got.column("src").to_pylist(), got.column("line").to_pylist()):
            gone.setdefault(src, set()).add(line)
        shared = records.sparkSession.sparkContext.broadcast(gone)
        return rows.withColumn("own", F.lit(None).cast("array<long>")).mapInArrow(lambda batches: vec.vectorise(batches, shared.value), vec.VECTOR_SCHEMA)

    rows = rows.dropDuplicates(["record_id"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [list(set(vec.line_keys(t))) for t in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([k for ks in keys for k in ks], pa.int64())], ["record_id", "src", "line"])

    lines = rows.select("record_id", "src", "page_content").mapInArrow(split, "record_id long, src long, line long")
    hits = lines.join(known, ["src", "line"], "left_semi").unionByName(lines.where("src is null").join(known.select("line").distinct(), "line", "left_semi").select("record_id", "src", "line"))
    own = hits.groupBy("record_id").agg(F.collect_set("line").alias("own"))
    return rows.join(own, "record_id", "left").select(*rows.columns, "own").mapInArrow(lambda batches: vec.vectorise(batches, {}), vec.VECTOR_SCHEMA)


def _summed(arrays: Iterator[np.ndarray], size: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, dtype=np.int64)
    for one in arrays:
        total += one
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names)


def reranked(pairs: DataFrame, vectors: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(a, b, score) of the pairs (a, b) whose exact similarity reaches ``cfg.least``."""
    least = cfg.least
    bound = least * (vec.ONE_IN - 1) / vec.ONE_IN  # words shared at least, as whole sentences count that differ in single words

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            sketch = [np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, vec.SKETCH) for i in (4, 5)]
            hit = pa.array(np.flatnonzero(vec.most_shared(sketch[0], size_a, sketch[1], size_b) >= bound * np.maximum(size_a, size_b)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(hit), batch.column(1).take(hit)], ["a", "b"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longer = np.maximum(*(np.diff(vec.flat(batch.column(i))[0]) for i in (4, 5)))
            batch = batch.take(pa.array(np.flatnonzero(vec.shared_words(batch.column(4), batch.column(5)) >= bound * longer)))
            cols = [[np.frombuffer(x, dtype=np.uint16) for x in batch.column(i).to_pylist()] for i in range(2, 6)]
            got = np.array([vec.similarity(la.tolist(), wa, lb.tolist(), wb, least) for la, lb, wa, wb in zip(*cols)], dtype=np.float64)
            hit = np.flatnonzero(got >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), batch.column(1).take(pa.array(hit)), pa.array(got[hit])], ["a", "b", "score"])

    def both(of: DataFrame, *cols: str) -> DataFrame:
        for side in ("b", "a"):
            of = of.join(vectors.select(F.col("record_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in cols)), side)
        return of.select("a", "b", *(f"{c}_{side}" for c in cols for side in ("a", "b")))

    sketched = both(pairs.select("a", "b"), "size", "sketch").where(F.least("size_a", "size_b") >= F.lit(bound) * F.greatest("size_a", "size_b"))
    left = materialise(sketched.mapInArrow(near, "a long, b long"), "near")
    return materialise(both(left, "lens", "words").mapInArrow(score, "a long, b long, score double"), "scored")


def _best(edges: DataFrame) -> DataFrame:
    """(a, b): of each b the a most like it, of equally like ones the one with the least id."""
    return edges.groupBy("b").agg(F.max(F.struct("score", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")


class DedupIndex:
    """Accepted records in a folder; a second object on the same folder goes on where the first one ended."""

    def __init__(self, spark: SparkSession, path: str | None = None, cfg: DedupConfig = DedupConfig()):
        self.spark, self.path, self.cfg = spark, path or new_table(spark, "cells"), cfg
        self.deliveries = 0
        while exists(spark, self._at("rejected", self.deliveries)):
            self.deliveries += 1

    def _at(self, table: str, n: int) -> str:
        return f"{self.path}/{table}/{n:06d}"

    def _write(self, rows: DataFrame, table: str) -> DataFrame:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(self._at(table, self.deliveries))
        return self._read(table, rows.schema, self.deliveries, self.deliveries + 1)

    def _read(self, table: str, schema, first: int, end: int) -> DataFrame:
        paths = [self._at(table, n) for n in range(first, end) if exists(self.spark, self._at(table, n))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rejected(self) -> DataFrame:
        """(record_id_a, record_id_b) of all deliveries."""
        return self._read("rejected", "record_id_a long, record_id_b long", 0, self.deliveries)

    def vectors(self) -> DataFrame:
        """The vectors of all accepted records."""
        return self._read("vectors", vec.VECTOR_SCHEMA, 0, self.deliveries).join(self.rejected().select(F.col("record_id_b").alias("record_id")), "record_id", "left_anti")

    def count_lines(self, records: DataFrame) -> DedupIndex:
        """Add the lines of a delivery to the counts before it is added: then ``add`` and ``build`` don't count them again."""
        self._write(line_counts(records), "lines")
        return self

    def _vectors_of(self, records: DataFrame) -> DataFrame:
        if not exists(self.spark, self._at("lines", self.deliveries)):
            self.count_lines(records)
        counts = self._read("lines", "src long, line long, n long", 0, self.deliveries + 1)
        rows = vectorise(records, excessive_lines(counts, self.cfg), self.cfg)
        # ids are shuffled to see whether any is repeated, then vectors: never texts
        repeated = not records.groupBy("record_id").count().where("record_id is not null and count > 1").isEmpty()
        return self._write(rows.dropDuplicates(["record_id"]) if repeated else rows, "vectors")

    def _axes(self, fit: DataFrame | None = None) -> vec.Axes:
        path = f"{self.path}/axes"
        if fit is not None:
            counted = fit.select("words").mapInArrow(lambda batches: _summed((vec.word_counts(b.column(0)) for b in batches), vec.CODES, ["code", "n"]), "code long, n long")
            counted.groupBy("code").agg(F.sum("n").alias("n")).unionByName(fit.agg(F.lit(-1).cast("long").alias("code"), F.count(F.lit(1)).alias("n"))).write.mode("overwrite").parquet(path)
        got = self.spark.read.schema("code long, n long").parquet(path).toArrow()
        code, n = got.column("code").to_numpy(), got.column("n").to_numpy()
        counts = np.zeros(vec.CODES, dtype=np.int64)
        counts[code[code >= 0]] = n[code >= 0]
        return vec.Axes(counts, int(n[code < 0].sum()))

    def _place(self, vectors: DataFrame, axes: vec.Axes) -> DataFrame:
        """Write the cells of records, and how full they are."""
        shared = self.spark.sparkContext.broadcast(axes)  # vec.CODES numbers

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, _, at, cell = shared.value.cells(batch.column(3), batch.column(4))
                mine = row[at]
                by = np.lexsort((cell, mine))
                mine, cell = mine[by], cell[by]
                new = np.concatenate(([True], (mine[1:] != mine[:-1]) | (cell[1:] != cell[:-1]))) if len(mine) else np.zeros(0, dtype=bool)
                mine, cell = mine[new], cell[new]
                of = np.concatenate(([0], np.cumsum(np.bincount(mine, minlength=len(batch))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.ListArray.from_arrays(pa.array(of), pa.array(cell))], ["record_id", "batch_no", "size", "cells"])

        cells = self._write(vectors.where("size > 0").select("record_id", "batch_no", "size", "lens", "words").mapInArrow(place, CELLS), "cells")
        buckets = self.cfg.buckets

        def heat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = (np.bincount(np.asarray(b.column(0).flatten()) & (buckets - 1), minlength=buckets) for b in batches)
            yield from _summed(counts, buckets, ["bucket", "n"])

        self._write(cells.select("cells").mapInArrow(heat, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1"), "heat")
        return cells

    def _probes(self, vectors: DataFrame, axes: vec.Axes) -> DataFrame:
        """The cells that records probe, by how full the cells are now: ``PROBES``."""
        got = self._read("heat", "bucket long, n long", 0, self.deliveries + 1).groupBy("bucket").agg(F.sum("n").alias("n"))
        got = got.select("bucket", F.least(F.lit(255), F.floor(F.log2("n") * 8)).cast("int").alias("rank")).toArrow()
        ranks = np.zeros(self.cfg.buckets, dtype=np.uint8)  # cfg.buckets bytes, whatever the history's size
        rank = got.column("rank").to_numpy()
        # a bucket holds other cells too: what is usual for a bucket comes on top of the few
        usual = 2 * float(np.exp2(rank / 8).sum()) / self.cfg.buckets
        ranks[got.column("bucket").to_numpy()] = np.where(rank <= 8 * np.log2(self.cfg.few + usual), 0, rank)
        shared = self.spark.sparkContext.broadcast((axes, ranks))
        tail, buckets = self.cfg.tail_share, self.cfg.buckets

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            axes, ranks = shared.value
            for batch in batches:
                row, lens, at, cell = axes.cells(batch.column(3), batch.column(4))
                full = np.zeros(len(row), dtype=np.uint8)
                np.maximum.at(full, at, ranks[cell & (buckets - 1)])
                by = np.lexsort((np.arange(len(row)), full, row))
                r, n = row[by], lens[by]
                before = np.cumsum(n) - n
                before = before - before[np.searchsorted(r, r)]
                whole = np.bincount(row, weights=lens, minlength=len(batch))[r]
                probed = np.zeros(len(row), dtype=bool)
                probed[by] = (whole - before > tail * whole) | (full[by] == 0)
                on = probed[at]
                pick, cell = pa.array(row[at[on]]), cell[on]
                yield pa.RecordBatch.from_arrays([pa.array(cell), *(batch.column(i).take(pick) for i in range(3))], ["cell", "b", "batch_b", "size_b"])

        return vectors.where("size > 0").select("record_id", "batch_no", "size", "lens", "words").mapInArrow(probe, PROBES)

    def build(self, history: DataFrame) -> DedupIndex:
        """Take records (record_id, batch_no, source_id, page_content) known to hold no duplicates as accepted."""
        stored = self._vectors_of(history)
        self._place(stored, self._axes(stored))
        self._commit(self.spark.createDataFrame([], "record_id_a long, record_id_b long"))
        return self

    def _commit(self, rejected: DataFrame) -> DataFrame:
        out = self._write(rejected, "rejected")
        self.deliveries += 1
        return out

    def add(self, new: DataFrame) -> DataFrame:
        """Check new records (record_id, batch_no, source_id, page_content), in the order (batch_no, record_id), and keep the accepted ones.

        Gives (record_id_a, record_id_b) for each rejected record b: the accepted record a most like it, of equally like
        ones the one with the least id. Rows that repeat a record_id are taken as one record.
        """
        stored = self._vectors_of(new)
        # equal vectors are one record: its first row stands for all copies, however many
        sig = stored.where("size > 0").select("record_id", "batch_no", F.sha2(F.concat("lens", F.lit(b"|"), "words"), 256).alias("sig"))
        first = sig.groupBy("sig").agg(F.min(F.struct("batch_no", "record_id")).alias("first"))
        copies = materialise(sig.select("sig", "record_id").join(first, "sig").select("record_id", F.col("first.record_id").alias("rep")), "copies")
        reps = stored.join(copies.where("record_id = rep").select("record_id"), "record_id", "left_semi").select(*stored.columns)
        axes = self._axes(stored if not exists(self.spark, f"{self.path}/axes") else None)
        cells = self._place(reps, axes)
        probes = materialise(self._probes(reps, axes), "probes")
        hot = materialise(self._hot_cells(probes), "hot")
        edges = self._edges(cells, probes, hot)
        taken = materialise(self._accepted_edges(edges, cells, probes, hot), "taken")
        # a copy of a rejected record repeats the same accepted one, a copy of an accepted record repeats that
        rejected = (
            copies.join(_best(taken).withColumnRenamed("b", "rep"), "rep", "left")
            .where("a is not null or record_id <> rep")
            .select(F.coalesce("a", "rep").alias("record_id_a"), F.col("record_id").alias("record_id_b"))
        )
        return self._commit(rejected)

    def _score(self, pairs: DataFrame) -> DataFrame:
        bound = F.lit(self.cfg.least * (vec.ONE_IN - 1) / vec.ONE_IN)
        sized = pairs.where(F.least("size_a", "size_b") >= bound * F.greatest("size_a", "size_b")).select("a", "b").distinct()
        return reranked(sized, self._read("vectors", vec.VECTOR_SCHEMA, 0, self.deliveries + 1), self.cfg)

    def _edges(self, cells: DataFrame, probes: DataFrame, hot: DataFrame) -> DataFrame:
        """(a, b, score, old) of the pairs met; ``old``: a is accepted history. Of hot cells only those with the history."""
        gone = self.rejected().select(F.col("record_id_b").alias("record_id"))
        history = self._read("cells", CELLS, 0, self.deliveries).join(gone, "record_id", "left_anti")
        every = _members(history).withColumn("old", F.lit(True)).unionByName(_members(cells).join(hot, "cell", "left_anti").withColumn("old", F.lit(False)))
        scored = self._score(every.join(probes, "cell").where(F.expr(f"old or {_EARLIER}")))
        old = history.select(F.col("record_id").alias("a"), F.lit(True).alias("old"))
        return materialise(scored.join(old, "a", "left").select("a", "b", "score", F.coalesce("old", F.lit(False)).alias("old")), "edges")

    def _hot_cells(self, probes: DataFrame) -> DataFrame:
        return probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > self.cfg.hot_cell).select("cell")

    def _accepted_edges(self, edges: DataFrame, cells: DataFrame, probes: DataFrame, hot: DataFrame) -> DataFrame:
        """The edges (a, b, score) whose a is accepted; every b in them is rejected.

        Hot cells: the earliest record leads, the records like it are set aside, then the next earliest leads, as long
        as cells stay hot and shrink. Pairs are made among the records left. A record set aside comes back if none of its
        leaders is accepted; at last it is compared with all accepted records of its cells.
        """
        if hot.isEmpty():
            return _without(edges, self._resolve(edges)).select("a", "b", "score")
        members = materialise(_members(cells).join(hot, "cell", "left_semi"), "members")
        seeking = materialise(probes.join(hot, "cell", "left_semi"), "seeking")
        aside = self.spark.createDataFrame([], "id long")
        led = members.groupBy("cell").agg(F.lit(None).cast("struct<batch_a:int,a:long>").alias("upto"))
        count = members.count()
        while True:
            ahead = members.join(aside, members.a == aside.id, "left_anti").join(led, "cell")
            lead = ahead.where(F.col("upto").isNull() | (F.struct("batch_a", "a") > F.col("upto"))).groupBy("cell").agg(F.min(F.struct("batch_a", "a", "size_a")).alias("lead"), F.count(F.lit(1)).alias("n"))
            lead = materialise(lead.where(F.col("n") > self.cfg.hot_cell).select("cell", "lead.*"), "lead")
            if lead.isEmpty():
                break
            behind = seeking.join(aside, seeking.b == aside.id, "left_anti").join(lead, "cell").where(_EARLIER)
            edges = materialise(edges.unionByName(self._score(behind).withColumn("old", F.lit(False))), "edges")
            led = lead.select("cell", F.struct("batch_a", "a").alias("upto"))
            aside = materialise(aside.unionByName(edges.join(lead.select("a").distinct(), "a", "left_semi").select(F.col("b").alias("id"))).distinct(), "aside")
            now = members.join(aside, members.a == aside.id, "left_anti").count()
            if now > 0.9 * count:
                break
            count = now
        back = None
        while back is None or not back.isEmpty():
            if back is not None:
                aside = materialise(aside.join(back, "id", "left_anti"), "aside")
            a_open = members.join(aside, members.a == aside.id, "left_anti")
            b_open = seeking.join(aside, seeking.b == aside.id, "left_anti")
            met = a_open.join(b_open, "cell").where(_EARLIER)
            edges = materialise(edges.unionByName(self._score(met).withColumn("old", F.lit(False))), "edges")
            lost = self._resolve(edges)
            back = materialise(aside.join(lost.select(F.col("b").alias("id")), "id", "left_anti"), "back")
        kept = _without(members, lost)
        last = self._score(kept.join(seeking.join(aside, seeking.b == aside.id, "left_semi"), "cell").where(_EARLIER))
        return _without(edges.select("a", "b", "score").unionByName(last), lost)

    def _resolve(self, edges: DataFrame) -> DataFrame:
        """(b): the records that an earlier accepted one makes duplicates, decided in the records' order along the edges."""
        lost = materialise(edges.where("old").select("b").distinct(), "lost")
        left = _without(edges.where("not old").select("a", "b").distinct(), lost).join(lost, "b", "left_anti")
        while True:
            left = materialise(left, "left")
            if left.isEmpty():
                return lost
            free = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
            now = materialise(left.join(free, "a", "left_semi").select("b").distinct(), "lost")
            lost = lost.unionByName(now)
            left = _without(left.join(free, "a", "left_anti").join(now, "b", "left_anti"), now)


#: a comes before b in the order of the deliveries
_EARLIER = "batch_a < batch_b or batch_a = batch_b and a < b"


def _members(cells: DataFrame) -> DataFrame:
    return cells.select(F.explode("cells").alias("cell"), F.col("record_id").alias("a"), F.col("batch_no").alias("batch_a"), F.col("size").alias("size_a"))


def _without(rows: DataFrame, lost: DataFrame) -> DataFrame:
    """Rows whose a isn't lost."""
    return rows.join(lost.select(F.col("b").alias("a")), "a", "left_anti").select(*rows.columns)


def duplicates(records: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    """Batch 0 as history, all later batches as one ordered delivery: (record_id_a, record_id_b) per rejected record.

    The lines of all records are counted first, so that both parts leave out the same ones.
    """
    index = DedupIndex(records.sparkSession, cfg=cfg).count_lines(records)
    index.build(records.where("batch_no = 0"))
    return index.count_lines(records.limit(0)).add(records.where("batch_no > 0 or batch_no is null"))
