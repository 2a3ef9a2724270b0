"""Incremental ingest: micro-batches with change detection, versions, late rows, ledgers, and windows over event time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabulon.sources.scratch import children, exists, fresh_path, put_if_absent, removed, stored, text_of


def payload_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def classify(offered: DataFrame, held: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """offered with _hash and change: insert, update or unchanged.  held needs (id, _hash) only."""
    o = offered.withColumn("_hash", payload_hash(columns))
    h = held.select(F.col(id_col), F.col("_hash").alias("_held"))
    change = F.when(F.col("_held").isNull(), "insert").when(F.col("_held") == F.col("_hash"), "unchanged").otherwise("update")
    return o.join(h, id_col, "left").withColumn("change", change).drop("_held")


def latest(df: DataFrame, id_col: str, order: list[Column]) -> DataFrame:
    """One row per id: the last in order."""
    w = Window.partitionBy(id_col).orderBy(*[c.desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def merged(held: DataFrame, offered: DataFrame, id_col: str, as_of: str) -> DataFrame:
    """held and offered made one: a row replaces a held one unless it is older; repeated ids within a batch keep the latest."""
    both = held.withColumn("_new", F.lit(0)).unionByName(offered.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, id_col, [F.col(as_of), F.col("_new"), payload_hash([c for c in offered.columns if c in held.columns])]).drop("_new")


def insert_only(held: DataFrame, offered: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Rows to add; the same id with another payload is an error, the same payload again is nothing."""
    judged = classify(offered.dropDuplicates([id_col]), held.withColumn("_hash", payload_hash(columns)), id_col, columns)
    clash = F.when(F.col("change") == "update", F.raise_error(F.lit("an id came back with another payload"))).otherwise(F.lit(True))
    return judged.filter(clash).filter("change = 'insert'").drop("change", "_hash")


def versions(observed: DataFrame, id_col: str, as_of: str, columns: list[str]) -> DataFrame:
    """(id, version, payload columns, valid_from, valid_to): a version begins when the payload differs from the one before."""
    w = Window.partitionBy(id_col).orderBy(as_of, "_hash")
    d = observed.withColumn("_hash", payload_hash(columns)).dropDuplicates([id_col, as_of, "_hash"])
    d = d.withColumn("_changed", ~F.col("_hash").eqNullSafe(F.lag("_hash").over(w))).filter("_changed")
    d = d.withColumn("version", F.row_number().over(w)).withColumn("valid_to", F.lead(as_of).over(w))
    return d.select(id_col, "version", *columns, F.col(as_of).alias("valid_from"), "valid_to")


class VersionedTable:
    """A table dealt by a hash of its id into `parts`; a micro-batch writes the parts that it touches as a generation.

    What is held is the newest finished generation of each part, as the folders in storage tell: nothing is kept in the
    driver, so a restart goes on where the last batch ended.  A batch that is replayed after a failure reads what was
    held before it and writes its generation again, so each batch counts once.
    """

    def __init__(self, spark: SparkSession, root: str, empty: DataFrame, id_col: str, parts: int = 16):
        self.spark, self.root, self.schema, self.id_col, self.parts = spark, root, empty.schema, id_col, parts

    def part_of(self) -> Column:
        return F.pmod(F.xxhash64(self.id_col), F.lit(self.parts)).cast("int")

    def _newest(self, before: int | None) -> dict[int, str]:
        """part -> folder of its newest generation, of those before a number."""
        found: dict[int, str] = {}
        generations = sorted(int(g.removeprefix("g=")) for g in children(self.spark, self.root, "g="))
        for g in generations:
            if (before is None or g < before) and exists(self.spark, f"{self.root}/g={g}/_SUCCESS"):
                found |= {int(p.removeprefix("part=")): f"{self.root}/g={g}/{p}" for p in children(self.spark, f"{self.root}/g={g}", "part=")}
        return found

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        paths = [p for k, p in self._newest(before).items() if only is None or k in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, generation: int, df: DataFrame) -> None:
        df.withColumn("part", self.part_of()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/g={generation}")


def ingest(stream: DataFrame, table: VersionedTable, id_col: str, as_of: str, checkpoint: str, ledger: Callable[[int, dict], None] | None = None) -> None:
    """Take in everything that is available, batch by batch; the cursor (checkpoint) advances only with a whole batch."""

    def batch(df: DataFrame, number: int) -> None:
        touched = [r["p"] for r in df.select(table.part_of().alias("p")).distinct().collect()]  # table.parts rows at most
        base = table.read(number, touched)
        columns = [c for c in df.columns if c != id_col]
        counts = {}
        if ledger:
            counts = {r["change"]: r["count"] for r in classify(latest(df, id_col, [F.col(as_of)]), base.withColumn("_hash", payload_hash(columns)), id_col, columns).groupBy("change").count().collect()}
        table.write(number, merged(base, df, id_col, as_of))
        if ledger:
            ledger(number, counts)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def freshness(ledger: DataFrame, source: str, at: str, ok: str, now: Column, stale_hours: int) -> DataFrame:
    """(source, last_ok, status): never, failed (the last run), stale (the last good run is too old) or ok."""
    g = ledger.groupBy(source).agg(F.max(F.when(F.col(ok), F.col(at))).alias("last_ok"), F.max(F.struct(at, ok)).alias("_last"))
    old = F.col("last_ok") < now - F.expr(f"INTERVAL {stale_hours} HOURS")
    status = F.when(F.col("last_ok").isNull(), "never").when(~F.col(f"_last.{ok}"), "failed").when(old, "stale").otherwise("ok")
    return g.select(source, "last_ok", status.alias("status"))


def cleanup_plan(df: DataFrame, id_col: str, columns: list[str], doomed: Column) -> DataFrame:
    """(id, before): the rows a clean-up would remove, with a digest of each as it is now."""
    return df.filter(doomed).select(id_col, F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("before"))


def applied(df: DataFrame, plan: DataFrame, id_col: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go): a planned row that has changed since stays."""
    now = df.withColumn("_now", F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))
    p = plan.select(F.col(id_col).alias("_id"), "before")
    match = (now[id_col] == p["_id"]) & (now["_now"] == p["before"])
    return now.join(p, match, "left_anti").drop("_now"), now.join(p, match, "left_semi").drop("_now")


class Cleanup:
    """A clean-up in steps that can be checked and taken back: plan, apply, verify, roll back.

    The plan holds each row to be removed or changed with the reason and a digest of the row as it was.  apply() acts on
    rows that still have that digest and writes them, as they were, to a journal.  verify() holds rows before and after
    against the journal.  rollback() restores what the journal holds where nothing has happened since: a removed row
    if its id is still free, a changed one if it still is as the clean-up left it.  Ids are unique and not null.
    """

    def __init__(self, spark: SparkSession, root: str, id_col: str):
        self.spark, self.root, self.id_col = spark, root, id_col

    @staticmethod
    def digest(df: DataFrame, row: str | None = None) -> Column:
        return F.md5(F.to_json(F.col(row) if row else F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))

    def _image(self, df: DataFrame) -> DataFrame:
        """(_id, _row, _md5): each row as it is."""
        row = df.select(F.col(self.id_col).alias("_id"), F.struct(*sorted(df.columns)).alias("_row"))
        return row.withColumn("_md5", self.digest(row, "_row"))

    def plan(self, df: DataFrame, phase: str, chosen: Column, reason: str, changes: dict[str, Column] | None = None) -> DataFrame:
        """(id, action, reason, before, and the new values): rows to remove, or to change where `changes` are given."""
        rows = df.filter(chosen)
        new = F.struct(*[(changes or {}).get(c, F.col(c)).cast(df.schema[c].dataType).alias(c) for c in sorted(df.columns)])
        planned = rows.select(F.col(self.id_col).alias("_id"), F.lit("change" if changes else "remove").alias("action"), F.lit(reason).alias("reason"), self.digest(rows).alias("before"), new.alias("new"))
        planned.write.parquet(f"{self.root}/plan/{phase}")
        return self.spark.read.parquet(f"{self.root}/plan/{phase}")

    def journal(self, phase: str) -> DataFrame:
        """(id, action, reason, old row, its digest, and the new row's digest, null if removed) of what was done."""
        return self.spark.read.parquet(f"{self.root}/journal/{phase}")

    def apply(self, df: DataFrame, phase: str) -> DataFrame:
        """The rows after the clean-up; planned rows that have changed since stay as they are.  A phase is applied once."""
        if exists(self.spark, f"{self.root}/journal/{phase}/_SUCCESS"):
            raise ValueError(f"{phase} has been applied")
        plan = self.spark.read.parquet(f"{self.root}/plan/{phase}")
        now = self._image(df)
        hit = now.join(plan, "_id").filter(F.col("_md5") == F.col("before"))
        after = F.when(F.col("action") == "change", self.digest(hit, "new"))
        hit.select("_id", "action", "reason", F.col("_row").alias("old"), F.col("_md5").alias("before"), "new", after.alias("after")).write.mode("overwrite").parquet(f"{self.root}/journal/{phase}")
        done = self.journal(phase).select("_id", "action", "new")
        out = now.join(done, "_id", "left").filter(~F.coalesce(F.col("action") == "remove", F.lit(False)))
        return out.select(F.coalesce("new", "_row").alias("r")).select("r.*").select(*df.columns)

    def verify(self, before: DataFrame, after: DataFrame, phase: str) -> DataFrame:
        """One row: planned, removed, changed, skipped, and whether rows and digests before are those after with the journal
        put back.  Digests are sums over rows, so order does not matter."""

        def facts(df: DataFrame, image: DataFrame) -> DataFrame:
            return image.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("_md5", 1, 12), 16, 10).cast("decimal(38,0)")).alias("d"))

        j = self.journal(phase)
        kept = self._image(after).join(j.filter("after is not null").select("_id", F.col("after").alias("_md5")), ["_id", "_md5"], "left_anti")
        whole = kept.select("_id", "_md5").unionByName(j.select("_id", F.col("before").alias("_md5")))
        one, two = facts(before, self._image(before)), facts(after, whole)
        counts = j.agg(F.count_if(F.col("action") == "remove").alias("removed"), F.count_if(F.col("action") == "change").alias("changed"))
        planned = self.spark.read.parquet(f"{self.root}/plan/{phase}").agg(F.count("*").alias("planned"))
        same = (F.col("n0") == F.col("n1")) & F.col("d0").eqNullSafe(F.col("d1"))
        both = one.select(F.col("n").alias("n0"), F.col("d").alias("d0")).crossJoin(two.select(F.col("n").alias("n1"), F.col("d").alias("d1"))).crossJoin(counts).crossJoin(planned)  # one row each
        return both.select("planned", "removed", "changed", (F.col("planned") - F.col("removed") - F.col("changed")).alias("skipped"), same.alias("complete"))

    def rollback(self, df: DataFrame, phase: str) -> DataFrame:
        """The rows with what the journal holds put back where nothing has happened since."""
        now = self._image(df)
        j = self.journal(phase).select("_id", "old", "after")
        back = now.join(j, "_id", "full")
        free, untouched = F.col("_row").isNull() & F.col("after").isNull(), F.col("_md5") == F.col("after")
        row = F.when(F.col("old").isNotNull() & (free | F.coalesce(untouched, F.lit(False))), F.col("old")).otherwise(F.col("_row"))
        return back.select(row.alias("r")).filter("r is not null").select("r.*").select(*df.columns)


class PassageState:
    """Which passages of which records are embedded, night by night; only new ones are sent on.

    A generation holds (record, record digest, chunk_no, key) of every passage.  refresh() cuts records whose digest is
    new or changed again, keeps the others' rows, and leaves out records that are gone.  A generation is complete with
    its folder, so a broken night is done again from the one before.
    """

    def __init__(self, spark: SparkSession, root: str, cut: Callable[[DataFrame], DataFrame], record_type: str = "bigint"):
        """cut: (id, text) -> (id, chunk_no, body); what is embedded is the body."""
        self.spark, self.root, self.cut = spark, root, cut
        self.schema = f"id {record_type}, digest string, chunk_no int, key string"

    def _generations(self) -> list[str]:
        return [g for g in children(self.spark, self.root, "g=") if exists(self.spark, f"{self.root}/{g}/_SUCCESS")]

    def held(self, back: int = 0) -> DataFrame:
        """The newest generation, or the one so many before it."""
        found = self._generations()
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{found[-1 - back]}") if len(found) > back else self.spark.createDataFrame([], self.schema)

    def refresh(self, docs: DataFrame, id_col: str, text: str, key: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, int]:
        """((key, body) to embed, (key) to delete, records cut): against the newest generation, which the night's replaces."""
        held, number = self.held(), len(self._generations())
        now = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
        seen = held.select("id", "digest", F.lit(True).alias("was"), F.lit(None).cast("boolean").alias("here"))
        offered = now.select("id", "digest", F.lit(None).cast("boolean").alias("was"), F.lit(True).alias("here"))
        marks = stored(offered.unionByName(seen).groupBy("id", "digest").agg(F.max("was").alias("was"), F.max("here").alias("here")), "marks")
        news = marks.filter("was is null").select("id", "digest")
        fresh = now.join(news, ["id", "digest"], "left_semi")
        pieces = stored(self.cut(fresh.select("id", "text")).select("id", "chunk_no", "body").withColumn("key", key(F.col("body"))), "pieces")
        rows = pieces.join(news, "id").select("id", "digest", F.col("chunk_no").cast("int").alias("chunk_no"), "key")
        empty = news.filter("id is not null").join(pieces.select("id"), "id", "left_anti").select("id", "digest", F.lit(-1).alias("chunk_no"), F.lit(None).cast("string").alias("key"))  # known, without passages
        same = held.join(marks.filter("was and here").select("id", "digest"), ["id", "digest"], "left_semi")
        same.select("id", "digest", "chunk_no", "key").unionByName(rows).unionByName(empty).write.mode("overwrite").parquet(f"{self.root}/g={number:06}")
        after = self.held().filter("key is not null").select("key").distinct()
        before = held.filter("key is not null").select("key").distinct()
        send = pieces.groupBy("key").agg(F.min("body").alias("body")).join(before, "key", "left_anti")
        return send, before.join(after, "key", "left_anti"), news.count()


def change_events(df: DataFrame, id_col: str, version: str, fields: list[str]) -> DataFrame:
    """(id, version, field, before, after, kind): what each version changed; kind is added, removed or changed.

    Values are given as text.  Versions of one id meet in one window; an id's first version has no events.
    """
    w = Window.partitionBy(id_col).orderBy(version)
    d = df.select(id_col, version, F.row_number().over(w).alias("_r"), *[F.struct(F.lag(F.col(f).cast("string")).over(w).alias("before"), F.col(f).cast("string").alias("after")).alias(f"_{f}") for f in fields])
    long = d.filter("_r > 1").select(id_col, version, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}.before").alias("before"), F.col(f"_{f}.after").alias("after")) for f in fields])).alias("c")).select(id_col, version, "c.*")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return long.filter(~F.col("before").eqNullSafe(F.col("after"))).withColumn("kind", kind)


class WorkQueue:
    """Claims on pending items, kept as an append-only table that any number of writers extend.

    A claim holds an item for a lease; an item that is neither done nor held may be claimed again, so a lost worker's
    items come back.  claim() takes at most so many, oldest first.  A writer reads the rounds up to n, writes its rows
    and then a file that makes them round n + 1, which succeeds only if there is none yet: of two that claim at once one
    loses, reads again and chooses anew.
    """

    def __init__(self, spark: SparkSession, root: str, id_type: str = "long"):
        self.spark, self.root, self.schema = spark, root, f"id {id_type}, worker string, until timestamp, done boolean"

    def _rounds(self) -> list[str]:
        return [r for r in children(self.spark, f"{self.root}/rounds") if r.isdigit()]

    def ledger(self, rounds: list[str] | None = None) -> DataFrame:
        rows = [f"{self.root}/rows/{text_of(self.spark, f'{self.root}/rounds/{r}')}" for r in (self._rounds() if rounds is None else rounds)]
        return self.spark.read.schema(self.schema).parquet(*rows) if rows else self.spark.createDataFrame([], self.schema)

    def _append(self, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
        while True:
            rounds = self._rounds()
            name = uuid.uuid4().hex
            choose(self.ledger(rounds)).write.parquet(f"{self.root}/rows/{name}")
            if put_if_absent(self.spark, f"{self.root}/rounds/{len(rounds):09}", name):
                return self.spark.read.schema(self.schema).parquet(f"{self.root}/rows/{name}")
            removed(self.spark, f"{self.root}/rows/{name}")

    def claim(self, items: DataFrame, id_col: str, order: list[str], worker: str, now: str, lease_minutes: int, most: int) -> DataFrame:
        """(id) of the items that the worker now holds."""
        at = F.lit(now).cast("timestamp")

        def choose(ledger: DataFrame) -> DataFrame:
            taken = ledger.filter(F.col("done") | (F.col("until") > at)).select(F.col("id").alias(id_col)).distinct()
            free = items.join(taken, id_col, "left_anti").orderBy(*order, id_col).limit(most)
            return free.select(F.col(id_col).alias("id"), F.lit(worker).alias("worker"), (at + F.expr(f"INTERVAL {lease_minutes} MINUTES")).alias("until"), F.lit(False).alias("done"))

        return self._append(choose).select("id")

    def finish(self, ids: DataFrame, worker: str) -> None:
        self._append(lambda _: ids.select("id", F.lit(worker).alias("worker"), F.lit(None).cast("timestamp").alias("until"), F.lit(True).alias("done")))


def rebuilt_family(spark: SparkSession, path: str, rows: DataFrame, partition: str, touched: DataFrame, family: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Delete and build again the aggregates of the touched partitions only, by overwriting these partitions.

    rows: the whole base table; touched: (partition) values; family() aggregates rows and keeps the partition column.
    """
    fresh = family(rows.join(touched.distinct(), partition, "left_semi"))
    fresh.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return spark.read.parquet(path)


def budgeted(spark: SparkSession, docs: DataFrame, id_col: str, size: Column, root: str, budget: int, work: Callable[[DataFrame], DataFrame]) -> int:
    """One night's run: work on the first pending documents whose sizes add up to at most the budget (one at least).

    Each run writes results and then the ids it has done, so a broken run is done again as a whole; the number of
    documents done.  Running sums are taken over range partitions.
    """
    from tabulon.operators.ranking import numbered

    runs = [r for r in children(spark, f"{root}/done", "run=") if exists(spark, f"{root}/done/{r}/_SUCCESS")]
    done = spark.read.schema(docs.select(id_col).schema).parquet(*[f"{root}/done/{r}" for r in runs]) if runs else None
    pending = docs.select(id_col, size.cast("long").alias("_size"))
    pending = pending.join(done, id_col, "left_anti") if done is not None else pending
    ranged = numbered(pending, [id_col], "_n")
    block = ranged.withColumn("_b", F.floor(F.col("_n") / 1000))
    ahead = block.groupBy("_b").agg(F.sum("_size").alias("_s")).withColumn("_before", F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s"))  # a row per thousand documents
    upto = block.join(ahead.select("_b", "_before"), "_b").withColumn("_upto", F.col("_before") + F.sum("_size").over(Window.partitionBy("_b").orderBy("_n")))
    chosen = upto.filter((F.col("_upto") <= budget) | (F.col("_n") == 1)).select(id_col)
    number = f"run={len(runs):06}"
    chosen.write.mode("overwrite").parquet(f"{root}/chosen/{number}")
    chosen = spark.read.schema(docs.select(id_col).schema).parquet(f"{root}/chosen/{number}")
    work(docs.join(chosen, id_col, "left_semi")).write.mode("overwrite").parquet(f"{root}/results/{number}")
    chosen.write.mode("overwrite").parquet(f"{root}/done/{number}")
    return chosen.count()


def tumbling(df: DataFrame, at: str, width: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """(keys, start, n) per window; works on streams and tables alike."""
    g = df.groupBy(*keys, F.window(at, width, slide or width).alias("w")).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), "n")


def sessions(df: DataFrame, at: str, gap: str, keys: list[str]) -> DataFrame:
    g = df.groupBy(*keys, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drained(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Run a streaming query over all that is available and give its result as a table.

    Each batch writes a folder of its own, again if it is replayed.  keys: the query is an aggregation by them; a batch
    writes only the groups that it changed, and a group's newest row counts.  Without keys all batches' rows count.
    """
    spark = stream.sparkSession
    out = fresh_path(spark, "stream")

    def keep(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode("update" if keys else "append").foreachBatch(keep).option("checkpointLocation", fresh_path(spark, "cursor")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)
    if keys:
        rest = [c for c in stream.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*").select(*stream.columns)
    return rows.drop("batch")
