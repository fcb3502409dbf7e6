"""The ingestion run end to end, as set-based Spark jobs (one job for all new files, no per-file loop).

A file's identity is its registration: the pair (path, file_hash) that admitted it.  The pair is carried through the
pending list, the parse output, the summary, the extract rows and the mark, so a file whose content changed
(``admit_match="hash"``) is parsed, summarised and extracted anew, and its old rows stay what they were.

Tables under ``base`` in the shared storage folder:

* ``registry/``        ``contract_track`` as an append-only status log (``StatusLog``): B1 and B3 append
* ``parses/``          parse output by identity, stored before a file is admitted; what later steps retry from
* ``parsed/``          append-only ``contract_parsed`` rows, final
* ``extract/``         append-only ``contract_extract`` rows with ``extract_status``
* ``model_cache/``     model answers, in folders by the first digits of the prompt key
* ``extract_retry/``   identities whose extraction call failed
* ``_staging/run-*/``  what a run wrote for itself; removed when it has committed

``ingest(listing)`` is the whole run on a listing of names: names that are known go by a join, each remaining file is
opened once, and hash, route, decode and parse happen in that pass.  A stop between any two steps is repaired by the
next run: parse output without admission is found again by its identity, admitted files without an outcome are pending,
outcomes without a mark are marked, and every append leaves out the identities that are there.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.columns import base_name
from papyra.functions.model import TextModel, infer_text, prompt_prefix, prompt_key
from papyra.operators import documents as doc
from papyra.operators import extraction as ext
from papyra.operators import registry as reg
from papyra.schemas import CONTRACT_TRACK, PENDING, STORED_EXTRACT, STORED_PARSED
from papyra.sources.files import Opener, content_hash, inventory_columns, open_files
from papyra.sources.status_log import StatusLog
from papyra.sources.tables import SnapshotTable


@dataclass
class IngestConfig:
    base: str
    parser: doc.Parser = doc.text_parser
    extensions: list[str] = field(default_factory=lambda: list(doc.PARSE_EXTENSIONS))
    partitions: int | None = None          # C2: tasks that open and parse (None: by the sizes of the new files)
    limit: int | None = None               # C1: first N new files per run (None: all)
    summary_model: TextModel | None = None  # E3; None leaves summaries NULL
    summary_source: str = "raw"             # E3 input: "raw" = the parse result (as the application), "text"
    extract_model: TextModel | None = None  # E5; None skips extraction
    model_cache: bool = True                # E2: keep answers by prompt key and never ask twice
    admit_copies: str = "all"               # B1 within one listing: "all" (application) or "first" per hash
    admit_match: str = "name_or_hash"       # B1: "name_or_hash" (application) or "hash" (re-uploads admitted)
    opener: Opener | None = None            # how a task reads one file (None: the file systems of pyarrow)
    compact_every: int = 20                 # commits of the registry between two snapshots


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    if _exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


_KEY = ["path", "file_hash"]
_IDS = "path string, file_hash string"
EMPTY_PARSE = "EMPTY_PARSE"      # error status of a document that the parser returned nothing for
_OUTCOME = T.StructType([T.StructField("path", T.StringType()), T.StructField("file_hash", T.StringType()),
                         T.StructField("raw_parsed", T.VariantType()), T.StructField("text", T.StringType()),
                         T.StructField("error_status", T.StringType())])
_OPENED = T.StructType(_OUTCOME.fields + [T.StructField("length", T.LongType()),
                                          T.StructField("modificationTime", T.TimestampType())])
_CACHE = "prompt_key string, response string, prefix string"


def _same(a: DataFrame, b: DataFrame, hash_too: bool = True) -> Column:
    """Rows of one identity.  Stored rows without a hash (written before hashes were kept) go by their path."""
    own = a["path"] == b["_p"]
    return own & (b["_h"].isNull() | a["file_hash"].eqNullSafe(b["_h"])) if hash_too else own


def _keys(df: DataFrame) -> DataFrame:
    return df.select(F.col("path").alias("_p"), F.col("file_hash").alias("_h")).distinct()


def _without_known(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` whose identity is not in ``table``.  The table is probed with a semi join that has the (small) rows as
    its build side, then the few hits are removed: the big table is never shuffled whole."""
    paths = rows.select(F.col("path").alias("_k")).distinct()
    hits = table.select("path", "file_hash").join(paths, table["path"] == paths["_k"], "left_semi")
    k = _keys(hits)
    return rows.join(k, _same(rows, k), "left_anti")


def _with_known(rows: DataFrame, table: DataFrame) -> DataFrame:
    paths = rows.select(F.col("path").alias("_k")).distinct()
    hits = table.select("path", "file_hash").join(paths, table["path"] == paths["_k"], "left_semi")
    k = _keys(hits)
    return rows.join(k, _same(rows, k), "left_semi")


class IngestRun:
    def __init__(self, spark: SparkSession, cfg: IngestConfig):
        self.spark, self.cfg = spark, cfg
        self.registry = StatusLog(spark, f"{cfg.base}/registry", ["file_path", "file_hash"], CONTRACT_TRACK,
                                  f"processed = '{PENDING}'", cfg.compact_every)
        self.parses_path = f"{cfg.base}/parses"
        self.parsed_path = f"{cfg.base}/parsed"
        self.extract_path = f"{cfg.base}/extract"
        self.cache_path = f"{cfg.base}/model_cache"
        self.retry = SnapshotTable(spark, f"{cfg.base}/extract_retry")

    # -- tables
    def changes(self) -> DataFrame:
        """Z3, incremental: the registry's change history (the log itself): ``insert`` per admission,
        ``update_preimage`` and ``update_postimage`` per status change."""
        return self.registry.changes()

    def parsed(self) -> DataFrame | None:
        if not _exists(self.spark, self.parsed_path):
            return None
        return self.spark.read.schema(STORED_PARSED).parquet(self.parsed_path)

    def extracted(self) -> DataFrame:
        return _read_or_empty(self.spark, self.extract_path, STORED_EXTRACT)

    def current(self, table: DataFrame) -> DataFrame:
        """Rows of ``parsed()`` or ``extracted()`` that belong to the latest registration of their path."""
        newest = (self.registry.versioned().groupBy("file_path")
                  .agg(F.max_by("file_hash", F.struct("_v", "upload_time", "file_hash")).alias("_h"))
                  .withColumnRenamed("file_path", "_p"))
        return table.join(newest, (table["path"] == newest["_p"])
                          & (table["file_hash"].isNull() | table["file_hash"].eqNullSafe(newest["_h"])), "left_semi")

    # -- one run's own folder
    def _staged(self, run: str, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.cfg.base}/_staging/{run}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _of_identity(self, run: str, name: str, table: DataFrame, keys: DataFrame) -> DataFrame:
        """Rows of ``table`` (texts and parses) with an identity in ``keys``.  Where fewer identities are left out than
        kept, as in a first run, those left out are written and removed: a short list is broadcast, and the texts stay where
        they are, while a join with a list of nearly all of them would deal and sort every text."""
        ids = table.select(*_KEY).distinct()
        kept = self._staged(run, f"{name}-kept", _keys(ids.join(keys, _same(ids, keys), "left_semi")))
        same = (ids["path"].eqNullSafe(kept["_p"])) & ids["file_hash"].eqNullSafe(kept["_h"])
        rest = self._staged(run, name, _keys(ids.join(kept, same, "left_anti")))
        fewer, how = (rest, "left_anti") if rest.count() < kept.count() else (kept, "left_semi")
        return table.join(fewer, table["path"].eqNullSafe(fewer["_p"]) & table["file_hash"].eqNullSafe(fewer["_h"]), how)

    def _without(self, run: str, name: str, rows: DataFrame, table: DataFrame) -> DataFrame:
        """``_without_known`` for rows with texts: the few that are known are written, so their list can be broadcast."""
        ids = rows.select(*_KEY).distinct()
        known = self._staged(run, name, _keys(_with_known(ids, table)))
        return rows.join(known, rows["path"].eqNullSafe(known["_p"]) & rows["file_hash"].eqNullSafe(known["_h"]), "left_anti")

    def _clean(self) -> None:
        fs, p = _path(self.spark, f"{self.cfg.base}/_staging")
        fs.delete(p, True)

    # -- B1
    def register(self, inventory: DataFrame) -> DataFrame:
        """Admit new files: an append to the registry (staged first, since the registry is also read)."""
        run = f"admit-{uuid.uuid4().hex}"
        self._admit(run, self._staged(run, "inventory", inventory))       # hashed once, then joined twice
        self._clean()
        return self.registry.read()

    def _admit(self, run: str, inventory: DataFrame) -> DataFrame:
        """The rows of an inventory that the registry admits, staged; committed unless there are none."""
        admitted = self._admissible(run, inventory)
        if admitted.limit(1).count():
            self.registry.append(admitted)
        return admitted

    def _admissible(self, run: str, inventory: DataFrame) -> DataFrame:
        return self._staged(run, "admitted", reg.register_new_files(
            inventory, self.registry.rows().select(*CONTRACT_TRACK.fieldNames()), self.cfg.admit_copies, self.cfg.admit_match))

    # -- listing to tables, one open per new file
    def unseen(self, listing: DataFrame) -> DataFrame:
        """The listed names that have to be opened: unknown names or, where re-uploads are admitted, names that were
        not registered with this size and time."""
        rows = self.registry.rows().select(*CONTRACT_TRACK.fieldNames())
        src = listing.select("path", "modificationTime", F.col("length").cast("long").alias("length"))
        if self.cfg.admit_match == "name_or_hash":
            names = src.select(base_name(F.col("path")).alias("_n")).distinct()
            known = rows.select(F.col("file_name").alias("_n")).join(names, "_n", "left_semi").distinct()
            return src.join(known, base_name(F.col("path")) == F.col("_n"), "left_anti")
        known = rows.select(F.col("file_path").alias("_p"), F.col("size").alias("_s"), F.col("upload_time").alias("_t"))
        hits = known.join(src.select(F.col("path").alias("_p")).distinct(), "_p", "left_semi")
        same = (src["path"] == hits["_p"]) & (src["length"] == hits["_s"]) & (src["modificationTime"] == hits["_t"])
        return src.join(hits, same, "left_anti")

    def _open(self, listing: DataFrame) -> DataFrame:
        """Hash, route, decode and parse in the pass that opens the files: one outcome row a file."""
        cfg = self.cfg
        routed = doc.route_by_extension(listing, cfg.extensions)

        def opened(route: str) -> DataFrame:
            return open_files(routed.filter(F.col("route") == route), cfg.opener, cfg.partitions)
        parsed = cfg.parser(opened("parse"))
        carried = {"file_hash", "length", "modificationTime"}
        if not carried <= set(parsed.columns):
            # A parser that returns (path, parsed) only: the bytes are kept for it, so that they are read once.
            bytes_ = self._staged(self._run, "content", opened("parse"))
            parsed = cfg.parser(bytes_.select("path", "content")).join(bytes_.drop("content"), "path")
        ok = parsed.select("path", "file_hash", F.col("parsed").alias("raw_parsed"),
                           F.when(doc.error_of(F.col("parsed")).isNull(), doc.reassembled_text(F.col("parsed"))).alias("text"),
                           doc.error_of(F.col("parsed")).alias("error_status"), "length", "modificationTime")
        # A document that the parser found nothing in has an outcome of its own: it is not parsed for ever.
        ok = ok.withColumn("error_status", F.when(F.col("text").isNull(), F.coalesce("error_status", F.lit(EMPTY_PARSE))))
        raw = opened("raw")
        txt = F.try_validate_utf8(F.col("content").cast("string"))
        raw = raw.select("path", "file_hash", F.lit(None).cast("variant").alias("raw_parsed"), txt.alias("text"),
                         F.when(txt.isNull() & F.col("content").isNotNull(), F.lit("INVALID_UTF8")).alias("error_status"),
                         "length", "modificationTime")
        return ok.unionByName(raw)

    def ingest(self, listing: DataFrame, now: Column | None = None) -> None:
        """One run over a listing (``path, modificationTime, length``): A1, B1, B4, C1-C11, E3, E5-E7, B3."""
        cfg = self.cfg
        self._run = run = f"run-{uuid.uuid4().hex}"
        todo = self.unseen(listing)
        if cfg.limit:
            todo = todo.orderBy("path").limit(cfg.limit)
        todo = self._staged(run, "listing", todo)
        opened = self._staged(run, "opened", self._open(todo))
        # Files that the parser dropped are opened again for their hash alone.
        lost = todo.join(opened.select("path"), "path", "left_anti")
        if lost.limit(1).count():
            again = open_files(lost, cfg.opener, cfg.partitions).select(
                "path", "file_hash", F.lit(EMPTY_PARSE).alias("error_status"), "length", "modificationTime")
            opened = self._staged(run, "all", opened.unionByName(again, allowMissingColumns=True))
        # Names stamped with their own time can be recognised unchanged; otherwise the listing's time, as the application.
        stamp = F.col("modificationTime") if cfg.admit_match == "hash" else F.current_timestamp()
        admitted = self._admissible(run, opened.select(*inventory_columns(stamp)))
        mine = admitted.select(F.col("file_path").alias("_p"), F.col("file_hash").alias("_h"))
        mine = self._of_identity(run, "refused", opened.select(*_OUTCOME.fieldNames()), mine)
        self._store(mine)
        if admitted.limit(1).count():
            self.registry.append(admitted)
        self._finish(run, now)

    def _store(self, outcomes: DataFrame) -> None:
        """Parse output by identity, kept before its files count as admitted."""
        new = outcomes
        if _exists(self.spark, self.parses_path):
            new = self._without(self._run, "stored", outcomes, _read_or_empty(self.spark, self.parses_path, _OUTCOME))
        new.write.mode("append").parquet(self.parses_path)

    # -- B4, C1-C11, E3, E5-E7, B3 for files that are registered already
    def process(self, files: DataFrame, now: Column | None = None) -> None:
        """Process the pending files among ``files`` (``path, content``), for callers that hold the bytes.

        Work per run is proportional to the run: the pending identities are written once and every later step is
        scoped to them.  What has parse output already (a run that stopped, a summary that failed) is not parsed again.
        """
        cfg = self.cfg
        self._run = run = f"run-{uuid.uuid4().hex}"
        pending = self._staged(run, "arrived", self._pending())
        stored = _read_or_empty(self.spark, self.parses_path, _OUTCOME)
        done = self.parsed()
        todo = _without_known(pending, stored)
        todo = _without_known(todo, done) if done is not None else todo
        mine = files.join(todo.select(F.col("path").alias("_p")).distinct(), F.col("path") == F.col("_p"), "left_semi")
        if cfg.limit:
            first = mine.select("path").orderBy("path").limit(cfg.limit).withColumnRenamed("path", "_p")
            mine = mine.join(first, F.col("path") == F.col("_p"), "left_semi")
        outcomes = doc.process_batch(mine, cfg.parser, cfg.extensions, cfg.partitions)
        outcomes = self._staged(run, "parse", outcomes.select("path", "raw_parsed", "text", "error_status"))
        # The identity that is pending; with re-uploads admitted, only if the bytes are those that were registered.
        ids = todo
        if cfg.admit_match == "hash":
            seen = _keys(files.select("path", content_hash("content").alias("file_hash")))
            ids = todo.join(seen, _same(todo, seen), "left_semi")
        else:
            ids = todo.join(files.select(F.col("path").alias("_p")), F.col("path") == F.col("_p"), "left_semi")
            if cfg.limit:
                ids = ids.join(first, F.col("path") == F.col("_p"), "left_semi")
        rows = ids.join(outcomes, "path", "left").select(
            "path", "file_hash", "raw_parsed", "text",
            F.when(F.col("text").isNull() & F.col("error_status").isNull(), F.lit(EMPTY_PARSE))
            .otherwise(F.col("error_status")).alias("error_status"))
        self._store(self._staged(run, "outcomes", rows))
        self._finish(run, now)

    def _pending(self) -> DataFrame:
        return self.registry.open().select(F.col("file_path").alias("path"), "file_hash", F.col("_v").alias("version"))

    def _finish(self, run: str, now: Column | None) -> None:
        """Summaries, extracts and marks of every pending file that has parse output."""
        cfg, spark = self.cfg, self.spark
        pending = self._staged(run, "pending", self._pending())
        stored = _read_or_empty(spark, self.parses_path, _OUTCOME)
        known = self.parsed()
        ids = pending.select("path", "file_hash")
        waiting = _without_known(ids, known) if known is not None else ids
        k = _keys(waiting)
        x = self._of_identity(run, "elsewhere", stored, k)
        if cfg.summary_model is not None:
            src = F.col("text") if cfg.summary_source == "text" else F.col("raw_parsed").cast("string")
            # Failed parses and files that no parser took (raw text) are not summarised.
            src = F.when(F.col("error_status").isNull() & F.col("raw_parsed").isNotNull(), src)
            # The answers are written, not the texts: what is stored below joins them to the parses by prompt key.
            x = ext.summarize_documents(x.withColumn("_src", src), "_src", cfg.summary_model, error_col="summary_error",
                                        staged=lambda answers: self._staged(run, "summaries", answers)).drop("_src")
        else:
            x = x.withColumn("summarize", F.lit(None).cast("string")).withColumn("summary_error", F.lit(None).cast("string"))
        # A document whose summary call failed stays pending; the next run takes up its stored parse.
        final = x.filter(F.col("summary_error").isNull()).select(*STORED_PARSED.fieldNames())
        final.write.mode("append").parquet(self.parsed_path)
        done = self._staged(run, "done", _with_known(ids, self.parsed()))
        if cfg.extract_model is not None:
            self._extract(run, done)
        # An older content of a path that has been replaced before it was read is settled with the newer one.
        newest = pending.groupBy("path").agg(F.max("version").alias("last"))
        stale = pending.join(newest, "path").filter("version < last").select("path", "file_hash")
        settled = done.unionByName(stale).distinct().withColumnsRenamed({"path": "_p", "file_hash": "_h"})
        rows = self.registry.open().select(*CONTRACT_TRACK.fieldNames())
        before = rows.join(settled, (rows["file_path"] == settled["_p"]) & rows["file_hash"].eqNullSafe(settled["_h"]), "left_semi")
        before = self._staged(run, "before", before)
        if before.limit(1).count():
            self.registry.append(reg.mark_processed(before, before.select(F.col("file_path").alias("path")), now))
        self._clean()

    def _extract(self, run: str, ids: DataFrame) -> None:
        """E5-E7 for this run's documents plus earlier ones whose model call failed."""
        cfg, spark = self.cfg, self.spark
        targets = ids.unionByName(self.retry.read(_IDS).select("path", "file_hash")).distinct()
        todo = self._staged(run, "targets", _without_known(targets, self.extracted()))     # replays add nothing
        parsed, k = self.parsed(), _keys(todo)
        mine = parsed.join(k, (parsed["path"] == k["_p"]) & (parsed["file_hash"].isNull() | parsed["file_hash"].eqNullSafe(k["_h"])))
        mine = self._staged(run, "mine", mine.select("path", F.col("_h").alias("file_hash"), "summarize").dropDuplicates(_KEY))
        # Every parsed document gets an extract row; without a summary (raw text, failed parse) its fields are NULL.
        blank = mine.filter(F.col("summarize").isNull()).select(*_KEY, F.lit("no_summary").alias("extract_status"))
        prompts = mine.filter(F.col("summarize").isNotNull()).select(*_KEY, "summarize", ext.build_prompt("summarize", "extract").alias("_prompt"))
        prompts = self._staged(run, "prompts", prompts.withColumn("prompt_key", prompt_key(F.col("_prompt"))))
        cache = self._cached(prompts) if cfg.model_cache else None
        answered = infer_text(prompts.drop("prompt_key"), "_prompt", cfg.extract_model, cache=cache, keep_key=True)
        answered = self._staged(run, "answers", answered)
        if cfg.model_cache:
            fresh = answered.filter(F.col("model_error").isNull() & F.col("response").isNotNull()) \
                .select("prompt_key", "response").dropDuplicates(["prompt_key"])
            if cache is not None:
                fresh = fresh.join(cache.select("prompt_key"), "prompt_key", "left_anti")
            (fresh.withColumn("prefix", prompt_prefix(F.col("prompt_key"))).repartition("prefix")
             .write.mode("append").partitionBy("prefix").parquet(self.cache_path))
        # Rows whose model call failed stay out of the extract table and are retried on the next run.
        ok = ext.extract_fields(answered.filter(F.col("response").isNotNull()))
        rows = ext.expand_struct(ok, [*_KEY, "summarize", "extract_status"]).unionByName(blank, allowMissingColumns=True)
        rows.select(*STORED_EXTRACT.fieldNames()).write.mode("append").parquet(self.extract_path)
        self.retry.write(answered.filter(F.col("response").isNull()).select(*_KEY).distinct())

    def _cached(self, prompts: DataFrame) -> DataFrame | None:
        """Earlier answers, only from the folders of the key prefixes that this run asks for."""
        if not _exists(self.spark, self.cache_path):
            return None
        wanted = [r.p for r in prompts.select(prompt_prefix(F.col("prompt_key")).alias("p")).distinct().collect()]  # 256 at most
        return self.spark.read.schema(_CACHE).parquet(self.cache_path).filter(F.col("prefix").isin(wanted)).select("prompt_key", "response")

