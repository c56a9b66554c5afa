"""Snapshot sources (S01–S10): pick files from a listing, then read them.

File selection runs on the *listing* (``binaryFile`` with only the path
column selected, so no content is read), as DataFrame work: stamps are
parsed with ``regexp_extract`` / ``to_timestamp``, the newest per group is a
rank. Only the chosen files are then read, in the tasks their paths are dealt to, and parsed with an
explicit schema (never inferred). Each snapshot file is one JSON document of
one API page, read whole (``wholetext``) so malformed documents can be
detected and handled by policy.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from touchline.functions.windows import newest

c = F.col

# Path-stamp patterns of the snapshot layout.
RUN_STAMP_EVENTS = r"(?:^|/)([a-z]+)_(\d{8}_\d{6})Z/"          # <mode>_YYYYMMDD_HHMMSSZ/
RUN_STAMP_STATS = r"/(\d{4}-\d{2}-\d{2}_\d{6})/"               # YYYY-MM-DD_HHMMSS/
FULL_FILE = r"full_(\d{8})\.json$"
INC_FILE = r"inc_(\d{8}T\d{4})Z\.json$"


def list_files(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """Every file below ``root`` matching ``glob``: (file_path, modified, size)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(root)
            .select(c("path").alias("file_path"), c("modificationTime").alias("modified"),
                    c("length").alias("size")))


def path_part(depth_from_end: int) -> Column:
    """Folder name ``depth_from_end`` levels above the file (1 = parent)."""
    return F.element_at(F.split(c("file_path"), "/"), -1 - depth_from_end)


def with_path_parts(files: DataFrame, names: Sequence[str]) -> DataFrame:
    """Name the folders above the file, innermost last: names=['league', 'season']
    gives league = 2 levels up, season = parent."""
    out = files
    for i, n in enumerate(reversed(list(names)), start=1):
        out = out.withColumn(n, path_part(i))
    return out


# S01 / S09 -------------------------------------------------------------------------
TASK_FILES, TASK_BYTES = 2000, 64 << 20      # that one reading task aims at


def read_files(paths: DataFrame) -> DataFrame:
    """(file_path, content) of a listing's files, read in the tasks that hold their paths.

    The listing is dealt out and never reaches the driver. A file that has
    gone since it was listed gives ``content = NULL``; any other error fails the task.
    ``paths`` may carry ``size``. File systems that only Spark's readers know
    (``viewfs:``, say) are read by ``read_tree``.
    """
    known = paths.select("file_path", *(["size"] if "size" in paths.columns else [])).dropDuplicates(["file_path"])
    size = F.sum("size") if "size" in paths.columns else F.lit(0)
    seen = known.agg(F.count(F.lit(1)).alias("n"), size.alias("b")).first()
    tasks = max(1, -(-seen.n // TASK_FILES), -(-int(seen.b or 0) // TASK_BYTES))

    def read(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            # a few files at a time, so that a batch of contents stays small
            for at in range(0, len(names), 16):
                some = names[at:at + 16]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([_content(p) for p in some], pa.binary())],
                                                 ["file_path", "content"])

    return known.select("file_path").repartition(tasks, "file_path").mapInArrow(read, "file_path string, content binary")


def _content(path: str) -> bytes | None:
    """The bytes of a file; None if there is none."""
    from pyarrow import fs
    try:
        if path.startswith("file:") or path.startswith("/"):
            # Spark spells local paths 'file:/x', decoded
            filesystem, inner = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        else:
            filesystem, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
            inner = unquote(inner)
        with filesystem.open_input_stream(inner, compression=None) as stream:
            return stream.read()
    except FileNotFoundError:
        return None


_TASK_SCHEMES = ("file", "hdfs", "s3", "gs", "abfs", "abfss")


def read_tree(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(file_path, content) by Spark's own reader: the tree that holds the listing is read once and
    semi-joined with it. Two paths tell the tree: what the smallest and the greatest have in common, all have."""
    ends = paths.agg(F.min("file_path").alias("low"), F.max("file_path").alias("high")).first()
    if ends.low is None:
        return spark.createDataFrame([], "file_path string, content binary")
    common = os.path.commonprefix([ends.low, ends.high])
    root = ends.low if common == ends.low == ends.high else common[:common.rindex("/") + 1]
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select(c("path").alias("file_path"), "content"))
    return files.join(paths.select("file_path").distinct(), "file_path", "left_semi")


def parse_once(raw: DataFrame, valid: Callable[[Column], Column], schema) -> DataFrame:
    """``raw`` with ``is_valid`` and ``doc`` (NULL unless valid) in place of its JSON text ``value``.

    Both come out of a generated row, because filters on projected columns are pushed below them with a
    copy of their expression: each would make and parse the text again.
    """
    checked = F.transform(F.array("value"), lambda v: F.struct(v.alias("value"), valid(v).alias("ok")))
    parsed = F.transform(checked, lambda x: F.struct(x["ok"].alias("is_valid"), F.when(x["ok"], F.from_json(x["value"], schema)).alias("doc")))
    return raw.select(*[x for x in raw.columns if x != "value"], F.inline(parsed))


def read_snapshots(spark: SparkSession, paths: DataFrame | Sequence[str], schema: StructType,
                   on_bad: str = "skip") -> DataFrame:
    """Parse whole-file JSON documents with ``schema``.

    ``paths``: a file listing (``file_path`` column) or a list of paths.
    ``on_bad``: ``skip`` drops unreadable documents, ``error_row`` keeps one
    row with ``doc = NULL``, ``is_valid = false`` and the reason, ``missing``
    keeps them as a NULL document (treated as absent downstream).
    Output: file_path, doc (struct), is_valid, error_reason. The listing stays
    distributed (``read_files``; ``read_tree`` for schemes that only Spark reads).
    """
    if on_bad not in ("skip", "error_row", "missing"):
        raise ValueError(on_bad)
    if not isinstance(paths, DataFrame):
        paths = spark.createDataFrame([(p,) for p in paths], "file_path string")
    foreign = ~c("file_path").startswith("/") & ~F.regexp_extract("file_path", "^([a-z0-9]+):", 1).isin(*_TASK_SCHEMES)
    by_spark = paths.where(foreign).limit(1).count() > 0
    content = read_tree(spark, paths) if by_spark else read_files(paths)
    raw = content.select("file_path", c("content").cast("string").alias("value"))
    parsed = parse_once(raw, lambda v: F.coalesce(F.try_parse_json(v).isNotNull() & (F.trim(v) != ""), F.lit(False)), schema)
    reason = F.lit("exception: JSONDecodeError: malformed document")
    if on_bad == "skip":
        return parsed.where("is_valid").select("file_path", "doc", F.lit(True).alias("is_valid"),
                                              F.lit(None).cast("string").alias("error_reason"))
    if on_bad == "error_row":
        return parsed.select("file_path", "doc", "is_valid", F.when(~c("is_valid"), reason).alias("error_reason"))
    return parsed.select("file_path", "doc", F.lit(True).alias("is_valid"),
                         F.lit(None).cast("string").alias("error_reason"))


# S02 -------------------------------------------------------------------------------
def latest_run(files: DataFrame, by: Sequence[str], stamp_re: str, stamp_fmt: str, group: int = 1) -> DataFrame:
    """Files of the newest run folder per group; folders whose name fails the
    stamp pattern are ignored."""
    s = F.regexp_extract(c("file_path"), stamp_re, group)
    f = files.withColumn("run_ts", F.when(s != "", F.try_to_timestamp(s, F.lit(stamp_fmt))))
    return newest(f, by, "run_ts")


# S03 -------------------------------------------------------------------------------
def latest_window(files: DataFrame, by: Sequence[str], window: str, label_col: str = "snapshot",
                  strict: bool = False) -> DataFrame:
    """Resolve 'summer' / 'winter' / 'latest' / an explicit label to the newest
    matching snapshot label per group. Groups without a match are skipped
    (``strict=True`` raises instead — a check on a small grouped result)."""
    if window == "latest":
        cand = files
    elif window in ("summer", "winter"):
        cand = files.where(c(label_col).startswith(window + "_"))
    else:
        cand = files.where(c(label_col) == window)
    out = newest(cand, by, label_col)
    if strict:
        missing = files.select(*by).distinct().join(cand.select(*by).distinct(), list(by), "left_anti")
        if missing.limit(1).count():
            raise ValueError(f"no snapshot for window {window!r} in some groups")
    return out


# S04 -------------------------------------------------------------------------------
def latest_file(files: DataFrame, by: Sequence[str], by_embedded_ts: bool = False) -> DataFrame:
    """Newest file per group: plain lexicographic max of the path (so any
    ``inc_`` sorts after every ``full_``), or by the embedded stamp."""
    if not by_embedded_ts:
        return newest(files, by, "file_path")
    stamp = F.regexp_extract(c("file_path"), r"(\d{4}-\d{2}-\d{2}_\d{2}-\d{2})\.json$", 1)
    f = files.withColumn("__ts", F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd_HH-mm")))
    return newest(f.withColumn("__m", F.struct("__ts", "file_path")), by, "__m").drop("__ts", "__m")


# S05 -------------------------------------------------------------------------------
def baseline_plus_inc(files: DataFrame, by: Sequence[str], mode: str = "baseline") -> tuple[DataFrame, DataFrame]:
    """Baseline: newest ``full_YYYYMMDD`` plus every ``inc_YYYYMMDDTHHMMZ``
    strictly later; inc: only the newest inc. Returns (selected files, groups
    missing a baseline)."""
    full_s = F.regexp_extract(c("file_path"), FULL_FILE, 1)
    inc_s = F.regexp_extract(c("file_path"), INC_FILE, 1)
    f = (files.withColumn("full_ts", F.when(full_s != "", F.try_to_timestamp(full_s, F.lit("yyyyMMdd"))))
         .withColumn("inc_ts", F.when(inc_s != "", F.try_to_timestamp(inc_s, F.lit("yyyyMMdd'T'HHmm")))))
    if mode == "inc":
        return newest(f, by, "inc_ts").drop("full_ts", "inc_ts"), files.select(*by).limit(0)
    g = f.dropna(subset=list(by)).withColumn("base_ts", F.max("full_ts").over(Window.partitionBy(*by)))
    chosen = g.where((c("full_ts") == c("base_ts")) | (c("inc_ts") > c("base_ts")))
    missing = f.groupBy(*by).agg(F.count("full_ts").alias("__n")).where("__n = 0").drop("__n")
    return chosen.drop("full_ts", "inc_ts", "base_ts"), missing


# S06 -------------------------------------------------------------------------------
def latest_batch(files: DataFrame) -> DataFrame:
    """Per tab folder: the newest ``run_ts=`` batch that has ``response.json``.
    ``meta_path`` names the batch's ``_meta.json`` by convention (listings skip
    ``_``-prefixed files; the reader of J09 globs them and falls back to the
    run stamp when absent). Output: tab_dir, run_ts, response_path, meta_path."""
    run = F.regexp_extract(c("file_path"), r"run_ts=([0-9T\-]+)/", 1)
    tab = F.regexp_extract(c("file_path"), r"/([^/]+)/run_ts=", 1)
    name = F.element_at(F.split(c("file_path"), "/"), -1)
    f = files.select("file_path", run.alias("run_ts"), tab.alias("tab_dir"), name.alias("name")) \
             .where(c("run_ts") != "")
    resp = f.where(c("name") == "response.json")
    chosen = newest(resp, ["tab_dir"], "run_ts")
    return chosen.select("tab_dir", "run_ts", c("file_path").alias("response_path"),
                         F.regexp_replace(c("file_path"), "response\\.json$", "_meta.json").alias("meta_path"))


def read_small_files(paths: DataFrame, path_col: str = "file_path") -> DataFrame:
    """(path, text) for each path: sidecar files Spark's sources skip (names starting
    with ``_``, e.g. ``_meta.json``); a missing file gives ``text = NULL``."""
    read = read_files(paths.select(c(path_col).alias("file_path")))
    return read.select(c("file_path").alias(path_col), c("content").cast("string").alias("text"))


# S07 -------------------------------------------------------------------------------
def roster_player_ids(spark: SparkSession, files: DataFrame, by: Sequence[str] = ("league", "season")) -> DataFrame:
    """Newest ``run_YYYY-MM-DD`` roster per group, ``{team: [ids]}`` flattened
    to distinct player ids."""
    from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField
    run = F.regexp_extract(c("file_path"), r"run_(\d{4}-\d{2}-\d{2})/", 1)
    f = files.withColumn("run", run).where(c("run") != "")
    chosen = newest(f, list(by), "run")
    schema = StructType([StructField("teams", MapType(StringType(), ArrayType(IntegerType())))])
    docs = read_snapshots(spark, chosen, schema)
    docs = docs.join(chosen.select("file_path", *by), "file_path")
    teams = docs.select(*by, F.explode(c("doc.teams")).alias("team_id", "ids"))
    return (teams.select(*by, c("team_id").cast("int").alias("team_id"), F.explode("ids").alias("player_id"))
            .where(c("player_id").isNotNull()).select(*by, "player_id").distinct())


# S08 -------------------------------------------------------------------------------
def changed_blobs(ledger: DataFrame, load_col: str = "teams_load_date") -> DataFrame:
    """Latest season per league whose blob was never loaded or was refreshed
    after the last load."""
    latest = newest(ledger, ["league_id"], "season_year")
    return latest.where(c(load_col).isNull() | (c(load_col) < c("upd_date")))


# S10 -------------------------------------------------------------------------------
def read_venue_fills(spark: SparkSession, paths, on_bad: str = "skip") -> DataFrame:
    """Every ``venues.json``: a list whose elements are either flat venue
    objects or API wrappers ``{response: [venue]}``; first occurrence of each
    id in (file, position) order wins."""
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField
    venue = StructType([StructField("id", IntegerType()), StructField("name", StringType()),
                        StructField("city", StringType()), StructField("country", StringType())])
    elem = StructType(venue.fields + [StructField("response", ArrayType(venue))])
    docs = read_snapshots(spark, paths, ArrayType(elem), on_bad=on_bad)  # type: ignore[arg-type]
    items = docs.select("file_path", F.posexplode("doc").alias("pos", "e"))
    flat = items.select("file_path", "pos", F.coalesce(c("e.response")[0], F.struct(
        c("e.id").alias("id"), c("e.name").alias("name"), c("e.city").alias("city"),
        c("e.country").alias("country"))).alias("v"))
    flat = flat.where(c("v.id").isNotNull()).select(
        "file_path", "pos", c("v.id").alias("venue_id"), c("v.name").alias("venue_name"),
        c("v.city").alias("city"), c("v.country").alias("country"))
    from touchline.functions.windows import latest_by
    return latest_by(flat, ["venue_id"], [c("file_path"), c("pos")]).drop("file_path", "pos")
