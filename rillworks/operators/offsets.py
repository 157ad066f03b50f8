"""Byte offsets, checkpoints and file listings."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillworks.functions.jsontext import kind, with_document
from rillworks.functions.once import once
from rillworks.model import ROLL_BYTES, ROLL_SECONDS
from rillworks.operators.ordered import block_of, neighbour, running, running_sums


def line_offsets(lines: DataFrame, key: str, seq: str, text: str, block: Column | None = None) -> DataFrame:
    """Adds `byte_offset`, where each line starts in its file."""
    size = F.octet_length(text) + 1
    return running_sums(lines, [key], [seq], {"byte_offset": size.cast("bigint")},
                        block_of(seq) if block is None else block)


def collect_totals(chunks: DataFrame, by: list[str], data: str) -> DataFrame:
    """Lines (line feeds; an unterminated tail is not one) and bytes."""
    feeds = F.length(data) - F.length(F.replace(data, F.lit("\n"), F.lit("")))
    return chunks.groupBy(*by).agg(F.sum(feeds).alias("lines_collected"),
                                   F.sum(F.octet_length(data)).alias("bytes_collected"))


def continuity(chunks: DataFrame, keys: list[str], seq: str, block: Column | None = None) -> DataFrame:
    """Adds the next chunk's offset and `state`: ok, gap, overlap, reset (back at 0) or last.

    Rows: (keys, seq, offset, length)."""
    ahead = neighbour(chunks, keys, [seq], {"next_offset": F.col("offset")},
                      block_of(seq) if block is None else block, ahead=True)
    end = F.col("offset") + F.col("length")
    state = (F.when(F.col("next_offset").isNull(), "last").when(F.col("next_offset") == end, "ok")
             .when((F.col("next_offset") == 0) & (F.col("offset") > 0), "reset")
             .when(F.col("next_offset") > end, "gap").otherwise("overlap"))
    return ahead.withColumn("state", state)


def resume_plan(files: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Where to go on reading: a file smaller than its recorded size was rotated and starts at 0.

    Rows: files (path, size), checkpoints (path, offset, file_size); a missing checkpoint is all zeros."""
    saved = checkpoints.select("path", F.col("offset").alias("_offset"), F.col("file_size").alias("_size"))
    rotated = F.col("size") < F.coalesce("_size", F.lit(0))
    start = F.when(rotated, 0).otherwise(F.coalesce("_offset", F.lit(0)))
    return files.join(saved, "path", "left").select(
        "path", "size", start.alias("start_offset"), rotated.alias("rotated"),
        F.greatest(F.col("size") - start, F.lit(0)).alias("pending_bytes"))


def latest_checkpoints(log: DataFrame, key: str, seq: str, deleted: str, columns: list[str]) -> DataFrame:
    """Current checkpoint per key from a change log: the last write wins, removed keys drop out."""
    last = log.groupBy(key).agg(F.max_by(F.struct(deleted, *columns), seq).alias("_last"))
    return last.filter(~F.col(f"_last.{deleted}")).select(key, *[F.col(f"_last.{c}").alias(c) for c in columns])


def checkpoint_documents(checkpoints: DataFrame, agent: str, key: str) -> DataFrame:
    """One JSON document per agent, key -> checkpoint, in key order. A document holds the files of one
    agent host. Of rows with the same key the one modified last counts (of those, the one read furthest)."""
    entry = F.struct("offset", "file_path", "inode", "file_size", "last_modified")
    single = checkpoints.groupBy(agent, key).agg(F.max_by(entry, F.struct("last_modified", "offset", "file_size", "inode", "file_path")).alias("_entry"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col("_entry").alias("value"))))
    return single.groupBy(agent).agg(F.to_json(F.map_from_entries(entries)).alias("document"))


def parse_checkpoint_documents(documents: DataFrame, agent: str, document: str) -> DataFrame:
    """Checkpoint rows from the documents. A missing member has its default; a document that is no JSON object, or has
    an entry or a member of a wrong type (a JSON null too), gives one row with `failed` and no entry of it counts."""
    strict = with_document(documents.select(agent, document), F.col(document))
    entries = F.when(F.col("_doc").isNotNull() & (kind(F.col("_doc")) == "OBJECT"), F.try_variant_get("_doc", "$", "map<string, variant>"))
    shape = lambda v, name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    is_text = lambda v, name: F.coalesce(shape(v, name) == "STRING", F.lit(True))
    is_number = lambda v, name: F.coalesce(shape(v, name).isin("BIGINT", "DOUBLE", "BOOLEAN") | shape(v, name).startswith("DECIMAL"), F.lit(True))
    numbers, texts = ["offset", "inode", "file_size"], ["file_path", "last_modified"]

    def sound(v: Column) -> Column:
        ok = F.schema_of_variant(v).startswith("OBJECT")
        for name in numbers:
            ok = ok & is_number(v, name)
        for name in texts:
            ok = ok & is_text(v, name)
        return ok

    opened = once(strict.select(agent, entries.alias("_map")), _ok=F.coalesce(F.forall(F.map_values("_map"), sound), F.lit(False)))
    rows = opened.select(agent, (~F.col("_ok")).alias("failed"), F.explode_outer(F.when(F.col("_ok"), F.col("_map"))).alias("key", "_c"))
    member = lambda name, type_name, default: F.coalesce(F.try_variant_get("_c", f"$.{name}", type_name), F.lit(default)).alias(name)
    number, text = lambda name: member(name, "bigint", 0).cast("bigint").alias(name), lambda name: member(name, "string", "")
    return rows.select(agent, "failed", "key", number("offset"), text("file_path"), number("inode"), number("file_size"), text("last_modified"))


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, event, from_path) between two listings (path, size, mtime, content).

    A file is MOVED when its size and content are those of exactly one file that went and exactly one that came;
    copies that cannot be told apart stay DELETED and CREATED, and so does a file whose content or size is not known. Paths meet without their contents, only
    files on one side are hashed, and they are counted per size and content, never paired."""
    listing = lambda df, name: df.select("path", F.struct("size", "mtime").alias("stat"), F.lit(name).alias("side"))
    of = lambda name: F.max(F.when(F.col("side") == name, F.col("stat")))
    both = listing(before, "old").unionByName(listing(after, "new")).groupBy("path").agg(
        of("old").alias("old"), of("new").alias("new"))
    event = (F.when(F.col("old").isNull(), "CREATED").when(F.col("new").isNull(), "DELETED")
             .when(F.col("old") != F.col("new"), "MODIFIED"))
    events = both.select("path", event.alias("event"), F.coalesce("new.size", "old.size").alias("size")).filter("event IS NOT NULL")
    return _with_moves(events.select("path", "event"), _digests(before, after, events.filter("event <> 'MODIFIED'")))


def _with_moves(events: DataFrame, hashed: DataFrame) -> DataFrame:
    """(path, event, from_path): pairs of a file that came and one that went, alone with their size and content, become MOVED.

    A listed size other than that of the content was taken while the file grew: bytes past it may not have been read."""
    path_of = lambda name: F.min(F.when(F.col("event") == name, F.col("path")))
    count = lambda name: F.count_if(F.col("event") == name)
    moves = hashed.filter("size IS NOT NULL AND digest IS NOT NULL").groupBy("size", "digest").agg(
        count("CREATED").alias("_came"), count("DELETED").alias("_went"),
        path_of("CREATED").alias("to"), path_of("DELETED").alias("gone")).filter("_came = 1 AND _went = 1")
    settled = moves.select(F.inline(F.array(
        F.struct(F.col("to").alias("path"), F.col("gone").alias("from_path")),
        F.struct(F.col("gone").alias("path"), F.lit(None).cast("string").alias("from_path"))))).withColumn("_moved", F.lit(True))
    return events.join(settled, "path", "left").filter("_moved IS NULL OR from_path IS NOT NULL").select(
        "path", F.when(F.col("_moved"), "MOVED").otherwise(F.col("event")).alias("event"), "from_path")


def listing_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, event, from_path, start, stop) between two listings (path, size, mtime, digest), with the bytes to read.

    Events are those of `file_changes`, from stored digests; a file without one is never MOVED. A new file is read from 0, a
    grown one from its old size, one that shrank was rotated and is read from 0, a moved one has nothing new, and a
    deleted one has no range. A file of the same size with another time is MODIFIED without new bytes."""
    side = lambda df, name: df.select("path", F.struct("size", "mtime", "digest").alias(name))
    both = side(before, "old").join(side(after, "new"), "path", "full")
    event = (F.when(F.col("old").isNull(), "CREATED").when(F.col("new").isNull(), "DELETED").when(
        (F.col("old.size") != F.col("new.size")) | (F.col("old.mtime") != F.col("new.mtime")), "MODIFIED"))
    stop = F.col("new.size")
    start = F.when(F.col("old").isNull() | (stop < F.col("old.size")), F.lit(0).cast("bigint")).otherwise(F.col("old.size"))
    rows = both.select("path", event.alias("event"), F.when(stop.isNotNull(), start).alias("start"), stop.alias("stop"),
                       F.coalesce("new.size", "old.size").alias("size"), F.coalesce("new.digest", "old.digest").alias("digest")).filter("event IS NOT NULL")
    hashed = rows.filter("event <> 'MODIFIED'").select("path", "event", "size", "digest")
    told = _with_moves(rows.select("path", "event"), hashed)
    ranged = told.join(rows.select("path", "start", "stop"), "path")
    return ranged.withColumn("start", F.when(F.col("event") == "MOVED", F.col("stop")).otherwise(F.col("start")))


def _digests(before: DataFrame, after: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted files (path, event, ..) with their `digest`. Contents are hashed where they are read and never shuffled."""
    contents = before.select("path", "content", F.lit("DELETED").alias("event")).unionByName(
        after.select("path", "content", F.lit("CREATED").alias("event")))
    return contents.select("path", "event", F.sha2("content", 256).alias("digest")).join(wanted, ["path", "event"])


def glob_regex(pattern: Column) -> Column:
    """Regular expression of a path glob: `*` and `?` stay within a directory, `**` does not, `[..]`
    is a character class."""
    escaped = F.regexp_replace(pattern, r"([.+^${}()|\\])", r"\\$1")
    classes = F.regexp_replace(escaped, r"\[!", "[^")
    deep = F.replace(classes, F.lit("**"), F.lit("\u0001"))
    star = F.replace(deep, F.lit("*"), F.lit("[^/]*"))
    single = F.replace(star, F.lit("?"), F.lit("[^/]"))
    return F.concat(F.lit("^"), F.replace(single, F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def match_files(files: DataFrame, patterns: DataFrame, excludes: list[str] | None = None) -> DataFrame:
    """(task_id, path) for files that match a task's pattern and no excluded name pattern.

    A file meets the patterns by equality on the directory part before the first wildcard, which is
    one of the file's ancestor directories; the regular expression is only checked on those."""
    fixed = F.regexp_extract("pattern", r"^([^*?\[]*/)", 1)
    dim = patterns.select("task_id", fixed.alias("_dir"), glob_regex(F.col("pattern")).alias("_regex"))
    kept = files
    for name in excludes or []:
        kept = kept.filter(~F.regexp_extract("path", r"([^/]*)$", 1).rlike(_literal_regex(name)))
    ancestors = F.expr(
        "transform(sequence(1, size(split(path, '/')) - 1), i -> concat(substring_index(path, '/', i), '/'))")
    placed = kept.select("path", F.explode(ancestors).alias("_dir"))
    return placed.join(dim, "_dir").filter(F.expr("path RLIKE _regex")).select("task_id", "path").distinct()


def _literal_regex(pattern: str) -> str:
    out = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in ".+^${}()|\\" else c) for c in pattern)
    return f"^{out}$"


def files_watched(files: DataFrame, by: list[str], now: Column, fast_seconds: int) -> DataFrame:
    """Files per task, fast when written within `fast_seconds` (the rule is ours)."""
    fast = now - F.col("mtime") <= fast_seconds
    return files.groupBy(*by).agg(F.count_if(fast).alias("fast_files"), F.count_if(~fast).alias("slow_files"))


def roll_index(lines: DataFrame, keys: list[str], order: list[str], epoch_seconds: Column, size: Column,
               block: Column, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Adds the output file of each line: hours since the key's first line in order, and bytes written before
    it in units of the rolling size."""
    written = running(lines, keys, order, {"_written": ("sum", size), "_start": ("first", epoch_seconds)}, block)
    start, before = F.coalesce("_start", epoch_seconds), F.coalesce("_written", F.lit(0))
    return written.withColumn("hour_index", F.floor((epoch_seconds - start) / ROLL_SECONDS)).withColumn(
        "size_index", F.floor(before / roll_bytes)).drop("_start", "_written")


def last_rows(df: DataFrame, keys: list[str], order: list[str], n: int, shares: int = 64) -> DataFrame:
    """The last n rows per key, oldest first in `row_from_end` = n .. 1.

    Each key is dealt to `shares` shares by a hash of the order columns; a share hands on its last n rows
    at most, so for any n the last step meets n rows per share of a key, not the key.
    """
    return cut_by_share(df, keys, [F.desc(c) for c in order], n, "row_from_end", shares, order)


def cut_by_share(df: DataFrame, keys: list[str], order: list[Column], n: int, number: str, shares: int, by: list[str]) -> DataFrame:
    """Rows numbered 1 to n per key in `order`, cut within shares of a key first."""
    dealt = df.withColumn("_share", F.pmod(F.xxhash64(*by), F.lit(shares)))
    inside = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_share").orderBy(*order)))
    few = inside.filter(F.col("_place") <= n).drop("_share", "_place")
    return few.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(number) <= n)


def since_start(samples: DataFrame, keys: list[str], order: str, value: str, out: str, block: Column | None = None) -> DataFrame:
    """Adds the value minus the first value of its key that is not NULL."""
    first = running(samples, keys, [order], {"_first": ("first", F.col(value))}, block_of(order) if block is None else block, inclusive=True)
    return first.withColumn(out, F.col(value) - F.col("_first")).drop("_first")
