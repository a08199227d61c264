"""Deduplicating new batches against all history with an incremental inverted index.

The index of everything accepted so far is a folder of the shared file system with three shelves:

  postings  (slot = word, rep, n, pos, bitmap, wide): the rare-first prefix words of each distinct word set
  keys      (slot, key): letter keys of accepted rows
  texts     (slot, rep, content): the text of each distinct word set, for verification

and the word order, counted once, over the first rows that came in.  Every ingest appends one segment to each shelf.  A segment
is split by slot into buckets of about BUCKET_ROWS rows, so an ingest reads only the buckets its own words, keys and candidates
fall in: what it reads depends on the batch, not on the length of the history.  FAN segments of one size class are merged
into one with more buckets, so there are few segments and each row is rewritten a logarithmic number of times.
The list of segments is a file written last; what an ingest that failed left behind is not in it and gets overwritten.

An ingest takes any number of whole batches.  Three joins make the candidates: new sets among themselves, and new prefixes
against the old postings, of which the shorter set must be met in its short prefix; old postings never meet old ones.  Size,
place and bit bounds act in the join, the rest is verified on the texts.  Then rows are decided in batch
order: a row is a case if an accepted row of an earlier batch has its letter key or nearly its words.  Rows with
an accepted partner in the index are cases at once, rows without any partner are accepted at once; the others are
settled in rounds, each of which settles at least the earliest open batch of every group.  State is kept by group (letter key,
word set), never by pair of rows, so a group that holds a third of the log is as cheap as any other.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import new_folder, staged
from tidemark.llm.neardup import DEN, MIN_WORDS, NUM, verified
from tidemark.operators.signatures import CLASS, POSTED, SIGNED, cell_counts, classes, gathered, may_overlap, short, signer

MIN_KEY_LENGTH = 20
BUCKET_ROWS = 1 << 20
FAN = 8
#: Into how many consecutive portions a whole log is fed.
PORTIONS = 3
#: After so many rounds the decisions so far are summed up in one table.
ROUNDS_HELD = 4


def batches(log: DataFrame) -> DataFrame:
    """(id, batch): batch is the smallest line_num of the row's session; rows of no session (null, empty or
    'unknown') are batches of their own."""
    rows = log.select(F.col("line_num").cast("long").alias("id"), F.col("session_id").cast("string").alias("session")).where("id is not null")
    alone = F.expr("session is null or session in ('', 'unknown')")
    starts = rows.where(~alone).groupBy("session").agg(F.min("id").alias("batch"))
    return rows.where(~alone).join(starts, "session").select("id", "batch").unionByName(rows.where(alone).select("id", F.col("id").alias("batch")))


class Shelf:
    """One table of the index, in segments [name, buckets, rows]; every row has an integer slot."""

    def __init__(self, spark: SparkSession, folder: str, segments: list, bucket_rows: int, fan: int):
        self.spark, self.folder, self.segments, self.bucket_rows, self.fan = spark, folder, segments, bucket_rows, fan

    def near(self, slots: DataFrame) -> DataFrame | None:
        """The rows of the buckets in which any of the slots (a column slot) lies; None where nothing was ever appended."""
        if not self.segments:
            return None
        finest = max(b for _, b, _ in self.segments)
        touched = None
        if finest > 1:  # at most one number for each bucket of the index
            touched = [r[0] for r in slots.select(F.expr(f"slot & {finest - 1}").alias("b")).distinct().collect()]
        out = None
        for name, buckets, _ in self.segments:
            rows = self.spark.read.parquet(f"{self.folder}/{name}")
            if touched is not None and buckets > 1:
                rows = rows.where(F.col("bucket").isin(sorted({t & (buckets - 1) for t in touched})))
            rows = rows.drop("bucket")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _write(self, rows: DataFrame, name: str, expected: int | None) -> None:
        buckets = 1
        while expected and buckets * self.bucket_rows < expected:
            buckets *= 2
        rows = rows.withColumn("bucket", F.expr(f"slot & {buckets - 1}"))
        if buckets > 1:
            rows = rows.hint("rebalance", F.col("bucket"))
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/{name}")
        n = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}").count()  # from the footers
        if n:
            self.segments.append([name, buckets, n])

    def append(self, rows: DataFrame, number: int, most: int) -> None:
        """Append rows as a segment; `most` is a bound on their number.  Segments of one size class are merged when there
        are `fan` of them."""
        self._write(rows, f"{number:06d}", most)
        merged = 0
        while len(last := self.segments[-self.fan :]) == self.fan and max(s[2] for s in last) <= self.fan * min(s[2] for s in last):
            rows = None
            for name, _, _ in last:
                part = self.spark.read.parquet(f"{self.folder}/{name}").drop("bucket")
                rows = part if rows is None else rows.unionByName(part)
            del self.segments[-self.fan :]
            merged += 1
            self._write(rows, f"{number:06d}-{merged}", sum(s[2] for s in last))


class History:
    """The index, new or opened again by its folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None, min_words: int = MIN_WORDS, num: int = NUM, den: int = DEN, bucket_rows: int = BUCKET_ROWS, fan: int = FAN):
        self.spark, self.folder = spark, folder or new_folder(spark, "history")
        self.min_words, self.num, self.den = min_words, num, den
        self._order = None
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        state = self._read("state.json") or {"ingests": 0, "shelves": {}}
        self.ingests, self.rounds = state["ingests"], 0
        self.shelves = {name: Shelf(spark, f"{self.folder}/{name}", state["shelves"].get(name, []), bucket_rows, fan) for name in ("postings", "keys", "texts")}

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _read(self, name: str) -> dict | None:
        if not self._fs.exists(self._path(name)):
            return None
        lines = self.spark.read.text(f"{self.folder}/{name}").collect()  # one line
        return json.loads(lines[0][0])

    def _commit(self) -> None:
        """The list of segments takes the place of the one before in one step; only then are merged segments deleted."""
        self.ingests += 1
        new, old = self._path("state.new"), self._path("state.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps({"ingests": self.ingests, "shelves": {n: s.segments for n, s in self.shelves.items()}}).encode()))
        out.close()
        self._fs.delete(old, False)
        self._fs.rename(new, old)
        for name, shelf in self.shelves.items():
            if self._fs.exists(self._path(name)):
                for status in self._fs.listStatus(self._path(name)):
                    if status.getPath().getName() not in {s[0] for s in shelf.segments}:
                        self._fs.delete(status.getPath(), True)

    def ranks(self, texts: DataFrame):
        """The word order: counted over the rows given when the index is new, and kept with it.  The executors write it; the
        driver's heap would not hold it as rows."""
        if self._order is None:
            if not self._fs.exists(self._path("order/_SUCCESS")):
                cell_counts(texts, self.min_words).write.mode("overwrite").parquet(f"{self.folder}/order")
            self._order = self.spark.sparkContext.broadcast(gathered(self.spark.read.parquet(f"{self.folder}/order")))
        return self._order

    def sign(self, rows: DataFrame, first: DataFrame | None = None) -> DataFrame:
        """Signatures and letter keys of rows (id, content), lazily; of these alone most later steps are made.  `first`: the rows
        over which a new index counts its word order, those to be signed where not given."""
        rows = rows.select(F.col("id").cast("long"), F.col("content").cast("string"))
        run = signer(self.ranks(rows if first is None else first), self.num, self.den, self.min_words, min_key=MIN_KEY_LENGTH)
        return rows.mapInArrow(run, f"{SIGNED}, key binary")

    def ingest(self, signed: DataFrame, texts: DataFrame) -> DataFrame:
        """Decide signed rows (those of sign() and batch) of whole batches, all later than those before.

        texts: (id, content) of these rows at least.  Returns (line_num) of the cases; all other rows are accepted, those
        with null or short content (no letter key of 20 characters, under 12 words) always.
        """
        num, den, shelves = self.num, self.den, self.shelves
        sets = staged(classes(signed.where("n > 0")), "sets")
        posted = sets.select("rep", "n", "bitmap", "wide", F.posexplode("prefix").alias("pos", "slot"))
        a, b = posted.where(short("n", "pos", num, den)).alias("a"), posted.alias("b")
        new = F.expr(f"a.slot = b.slot and (a.n < b.n or a.rep < b.rep) and {may_overlap(num, den)}")
        pairs = a.hint("shuffle_hash").join(b, new).selectExpr("least(a.rep, b.rep) as id_a", "greatest(a.rep, b.rep) as id_b", "false as old")
        known = shelves["postings"].near(posted)
        if known is not None:
            # the smaller set is met in its short prefix, whichever of the two it is; the history streams past hash tables of the batch
            ours, theirs = posted.where(short("n", "pos", num, den)), known.where(short("n", "pos", num, den))
            ours = ours.alias("a").hint("shuffle_hash").join(known.alias("b"), F.expr(f"a.slot = b.slot and {may_overlap(num, den)}"))
            theirs = theirs.alias("a").join(posted.alias("b").hint("shuffle_hash"), F.expr(f"a.slot = b.slot and a.n < b.n and {may_overlap(num, den)}"))
            pairs = pairs.unionByName(ours.selectExpr("a.rep as id_a", "b.rep as id_b", "true as old")).unionByName(theirs.selectExpr("b.rep as id_a", "a.rep as id_b", "true as old"))
        pairs = staged(pairs.distinct(), "candidates")
        texts = texts.select(F.col("id").cast("long"), F.col("content").cast("string"))
        stored = shelves["texts"].near(pairs.where("old").selectExpr("cast(hash(id_b) as int) as slot"))
        links = staged(verified(pairs, texts, num, den, stored), "links")

        rows = staged(self._candidates(signed, sets, links), "rows")
        cases = self._settle(rows, links.where("not old"))

        good = rows.join(cases, "id", "left_anti").where("rep is not null").select("rep")
        # a case without a rep among the candidates (by its letter key alone) is the only row of its set, so its id is the rep
        bad = staged(rows.join(cases, "id", "left_semi").select(F.coalesce("rep", "id").alias("rep")).distinct().join(good, "rep", "left_anti"), "bad")
        kept = sets.join(bad, "rep", "left_anti")
        most = signed.count(), sets.agg(F.sum(F.size("prefix"))).first()[0]
        shelves["postings"].append(kept.select("rep", "n", "bitmap", "wide", F.posexplode("prefix").alias("pos", "slot")).select("slot", *POSTED), self.ingests, most[1] or 0)
        keys = signed.where("key is not null").join(cases, "id", "left_anti").select("key").distinct()
        shelves["keys"].append(keys.select(F.hash("key").alias("slot"), "key"), self.ingests, most[0])
        # hash tables of ids, here and below, so that the wide rows need not be sorted
        contents = texts.join(kept.select(F.col("rep").alias("id")).hint("shuffle_hash"), "id").select(F.hash("id").alias("slot"), F.col("id").alias("rep"), "content")
        shelves["texts"].append(contents, self.ingests, most[0])
        self._commit()
        return cases.select(F.col("id").alias("line_num"))

    def _candidates(self, signed: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
        """(id, batch, key, rep, old) of the rows that may have a partner: of a letter key or a word set that comes more
        than once, is linked, or is known.  key and rep are null where they lead nowhere; old tells of a partner in the index."""
        ends = links.selectExpr("id_a as rep", "old").unionByName(links.where("not old").selectExpr("id_b as rep", "old"))
        linked = ends.groupBy("rep").agg(F.max("old").alias("old"))
        of_set = sets.select(*CLASS, "rep", "members").join(linked, "rep", "left").where("members > 1 or old is not null").select(*CLASS, "rep", "old")
        by_set = signed.where("n > 0").select("id", "batch", *CLASS).join(of_set.hint("shuffle_hash"), CLASS).select("id", "batch", "rep", F.col("old").alias("old_set"))
        keys = signed.where("key is not null").select("id", "batch", "key")
        said = keys.select("key", F.lit(1).alias("c"), F.lit(False).alias("known"))
        known = self.shelves["keys"].near(keys.select(F.hash("key").alias("slot")))
        if known is not None:
            said = said.unionByName(known.select("key", F.lit(0).alias("c"), F.lit(True).alias("known")))
        often = said.groupBy("key").agg(F.sum("c").alias("c"), F.max("known").alias("old_key")).where("c > 1 or c = 1 and old_key").select("key", "old_key")
        by_key = keys.join(often.hint("shuffle_hash"), "key")
        both = by_set.join(by_key, ["id", "batch"], "full_outer")
        return both.select("id", "batch", "key", "rep", F.expr("coalesce(old_set, false) or coalesce(old_key, false)").alias("old"))

    def _settle(self, rows: DataFrame, links: DataFrame) -> DataFrame:
        """(id) of the cases among rows (id, batch, key, rep, old)."""
        both = links.selectExpr("id_a as rep", "id_b as other").unionByName(links.selectExpr("id_b as rep", "id_a as other"))
        # (id, batch, group, own): the groups each row is in (own) or is linked to
        fresh = rows.where("not old")
        watched = fresh.join(both, "rep").select("id", "batch", _set_group("other").alias("group"), F.lit(False).alias("own"))
        watch = _groups(fresh).withColumn("own", F.lit(True)).unionByName(watched)
        taken, cases, open_rows = None, rows.where("old").select("id"), True
        while open_rows:
            self.rounds += 1
            # one table a round: every row of the open groups with its decision, null where it must wait
            waiting = watch.where("own").groupBy("group").agg(F.min("batch").alias("waits"))
            seen = watch.join(waiting, "group", "left")
            if taken is None:
                seen = seen.withColumn("taken", F.lit(None).cast("long"))
            else:
                seen = seen.join(taken.groupBy("group").agg(F.min("batch").alias("taken")), "group", "left")
            each = Window.partitionBy("id")
            state = seen.select("id", "batch", "group", "own", F.min("waits").over(each).alias("waits"), F.min("taken").over(each).alias("taken"))
            decided = staged(state.selectExpr("id", "batch", "group", "own", "case when taken < batch then true when waits >= batch then false end as is_case"), "round")
            watch = decided.where("is_case is null").drop("is_case")
            open_rows = not watch.isEmpty()
            cases = cases.unionByName(decided.where("is_case").select("id"))
            fixed = decided.where("own and not is_case").select("group", "batch")
            taken = fixed if taken is None else taken.unionByName(fixed)
            if self.rounds % ROUNDS_HELD == 0 and open_rows:
                taken, cases = staged(taken.groupBy("group").agg(F.min("batch").alias("batch")), "taken"), staged(cases.distinct(), "cases")
        return staged(cases.distinct(), "cases")


def _set_group(rep: str) -> Column:
    return F.unhex(F.lpad(F.hex(F.col(rep)), 16, "0"))


def _groups(rows: DataFrame) -> DataFrame:
    """(id, batch, group) of each row's letter key (16 bytes) and word set (8 bytes), where it has them."""
    return rows.select("id", "batch", F.explode(F.array_compact(F.array("key", _set_group("rep")))).alias("group"))


def found(log: DataFrame, portions: int = PORTIONS, bucket_rows: int = BUCKET_ROWS, fan: int = FAN) -> DataFrame:
    """(line_num) of the rows the log had already accepted earlier, exactly or nearly.

    The log is fed to a new index in consecutive portions of whole batches; their number changes nothing in
    the result.  The word order is that of the rows before the first cut alone.  A row is signed without regard to others, so
    all rows are signed in one pass, and written by portion.
    """
    texts = log.select(F.col("line_num").cast("long").alias("id"), F.col("content").cast("string").alias("content")).where("id is not null")
    batch_of = staged(batches(log), "batches")
    cuts = []
    if portions > 1:
        cuts = batch_of.select(F.percentile_approx("batch", [i / portions for i in range(1, portions)], 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    history = History(log.sparkSession, bucket_rows=bucket_rows, fan=fan)
    signed = history.sign(texts, texts.where(F.col("id") <= cuts[0]) if cuts else None)
    portion = F.expr("0")
    for cut in cuts:
        portion = portion + (F.col("batch") > cut).cast("int")
    signed = staged(signed.join(batch_of.hint("shuffle_hash"), "id").withColumn("portion", portion), "signed", "portion")
    span = {r[0]: r for r in signed.groupBy("portion").agg(F.min("id"), F.max("id")).collect()}  # a row for each portion
    out = None
    for k in sorted(span):
        _, low, high = span[k]
        cases = history.ingest(signed.where(F.col("portion") == k).drop("portion"), texts.where(F.col("id").between(low, high)))
        out = cases if out is None else out.unionByName(cases)
    return out if out is not None else texts.select(F.col("id").alias("line_num"))
