"""Allow and block rules for URLs by a sort-merge range join with a sweep over nested rules."""

from __future__ import annotations

import string
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.llm.text import pick, ready

#: Key ranges per shuffle partition, the most key ranges, and the sampled keys that bound them.
CELLS_PER_PARTITION = 4
MAX_CELLS = 2048
SAMPLES = 1 << 14
#: Bytes of a sampled key that are kept as a range bound; any string is a valid bound.
BOUND_BYTES = 256

_LOWEST = -(1 << 63)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://` or for NULL."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substr(url, mark + 3)).otherwise("")
    raw_host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw_host) + 1), r"^[^?#]*", 0)
    return F.translate(raw_host, string.ascii_uppercase, string.ascii_lowercase), path


def label_count(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def canonical_key(host: Column, path: Column, level: Column) -> Column:
    """The last `level` labels of the host in reverse, a slash, and the path, as bytes.

    A host has no slash, so all URLs that a rule fits have, at the rule's number of labels, keys that begin with the
    rule's own key: a rule is one interval of keys. Level 0 gives the empty key, which no rule has.
    """
    n = F.greatest(level, F.lit(1))
    backwards = F.array_join(F.reverse(F.slice(F.split(host, r"\."), -n, n)), ".")
    return F.when(level > 0, F.concat(backwards, F.lit("/"), path)).otherwise("").cast("binary")


def _distinct_rules(rules: DataFrame) -> DataFrame:
    named = pick(rules, host="host", path="path", verdict="verdict").filter("host is not null")
    lower = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    return (named.groupBy(lower.alias("host"), F.coalesce("path", F.lit("")).alias("path"))
            .agg(F.when(F.max((F.col("verdict") == "block").cast("int")) == 1, "block").otherwise("allow").alias("verdict"))
            .withColumn("level", label_count(F.col("host"))))


def _bounds(keyed: DataFrame, cells: int) -> list[tuple[bytes, int]]:
    """Bounds of key ranges with about equal numbers of rows, from a hashed sample of about SAMPLES keys at any size."""
    total = keyed.count()
    share = min(1.0, SAMPLES / total) if total else 0.0
    drawn = F.pmod(F.xxhash64("tie"), F.lit(1 << 30)) < F.lit(round(share * (1 << 30)))
    sample = keyed.select(F.substring("key", 1, BOUND_BYTES).alias("key"), "tie").filter(drawn)
    found = sorted((bytes(r.key), r.tie) for r in sample.collect())
    return [found[len(found) * j // cells] for j in range(1, cells)] if found else []


def _assign(bounds: list[tuple[bytes, int]]):
    """Append the range of each URL's key, or repeat each rule for every range that its interval meets."""
    def urls(batches):
        for batch in batches:
            cell = [bisect_right(bounds, pair) for pair in zip(batch["key"].to_pylist(), batch["tie"].to_pylist())]
            kept = [c for c in batch.schema.names if c not in ("key", "tie")]
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *[batch[c] for c in kept]], names=["cell", *kept])

    def rules(batches):
        for batch in batches:
            rows, cells = [], []
            for n, key in enumerate(batch["key"].to_pylist()):
                met = range(bisect_right(bounds, (key, _LOWEST)), bisect_left(bounds, (key + b"\xff", _LOWEST)) + 1)
                rows.extend([n] * len(met))
                cells.extend(met)
            kept = batch.select([c for c in batch.schema.names if c != "key"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), *kept.columns], names=["cell", *kept.schema.names])

    return urls, rules


def _sweep(batches):
    """Go through rules and URLs in key order with a stack of the rules whose intervals are open; the top is the longest."""
    stack, at = [], None
    for batch in batches:
        best = {"size": [], "host_size": [], "rule": [], "verdict": []}
        urls = []
        for n, (cell, key, is_url, host, path, verdict) in enumerate(zip(
                *(batch[c].to_pylist() for c in ("cell", "key", "is_url", "host", "path", "verdict")))):
            if cell != at:
                stack, at = [], cell
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                stack.append((key, len(host) + len(path), len(host), host + path, verdict))
                continue
            urls.append(n)
            top = stack[-1][1:] if stack else (-1, -1, None, None)
            for column, value in zip(best.values(), top):
                column.append(value)
        kept = batch.select(["id", "host", "path", "part", "first"]).take(pa.array(urls, pa.int64()))
        types = (pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(v, t) for v, t in zip(best.values(), types)]],
                                         names=[*kept.schema.names, *best])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict of every row: the longest rule that fits, and `default` where none does.

    `rules` has host, path and verdict (allow or block). A rule fits its host and all subdomains if the URL's path begins
    with the rule's. Of fitting rules the one with most characters wins, then the one with the longer host; of equal rules
    with both verdicts, block. A rule without host is left out, one without path fits all paths.

    A path rule also holds for subdomains, so it isn't one interval of whole keys; each URL therefore has a key at each
    number of labels that some rule's host has (their number is bounded by the rules, not by the pages). Keys are dealt by
    sampled bounds into ranges, a key with many rows over several (bounds have a hash of the row's place behind the key); a rule goes to the ranges that its interval meets. Each
    range is sorted by Spark and swept with a stack of open rules; the longest of a row's rules is an aggregate.

    A NULL or malformed URL has empty host and path. Repeated rows and NULL ids are rows like any others. Other columns are
    left out, clashing or not; empty tables give no rows, or the default for every row.
    """
    spark = pages.sparkSession
    ready(spark)
    kept = _distinct_rules(rules)
    levels = sorted(r[0] for r in kept.select("level").distinct().collect())
    host, path = url_parts(F.coalesce("url", F.lit("")))
    found = pick(pages, id=id_col, url=url_col).select("id", host.alias("host"), path.alias("path"), F.spark_partition_id().alias("part"),
                                                         F.monotonically_increasing_id().alias("row"))
    usable = F.filter(F.array(*[F.lit(k) for k in levels]).cast("array<int>"), lambda k: k <= label_count(F.col("host")))
    urls = (found.withColumn("levels", F.when(F.size(usable) > 0, usable).otherwise(F.array(F.lit(0))))
            .select("id", "host", "path", "part", "row", F.posexplode("levels").alias("place", "level"))
            .select("id", "host", "path", "part", "row", "level", (F.col("place") == 0).cast("bigint").alias("first"),
                    F.lit(None).cast("string").alias("verdict"), F.lit(True).alias("is_url")))
    key = canonical_key(F.col("host"), F.col("path"), F.col("level"))
    keyed = urls.withColumns({"key": key, "tie": F.xxhash64("row", "level")}).drop("row")

    cells = min(CELLS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_CELLS)
    deal_urls, deal_rules = _assign(_bounds(keyed, cells))
    id_type = urls.schema["id"].dataType.simpleString()
    row = f"cell int, id {id_type}, host string, path string, part int, level int, first bigint, verdict string, is_url boolean"
    ruled = (kept.select(F.lit(None).cast(id_type).alias("id"), "host", "path", F.lit(0).alias("part"), "level",
                         F.lit(0).cast("bigint").alias("first"), "verdict", F.lit(False).alias("is_url"), key.alias("key")))
    both = keyed.mapInArrow(deal_urls, row).unionByName(ruled.mapInArrow(deal_rules, row))
    swept = (both.repartition("cell").withColumn("key", key).sortWithinPartitions("cell", "key", "is_url")
             .mapInArrow(_sweep, f"id {id_type}, host string, path string, part int, first bigint, "
                                 "size int, host_size int, rule string, verdict string"))
    # rows of one scan partition that are equal in all columns are one group here, and as many rows again below
    best = (swept.groupBy("id", "host", "path", "part")
            .agg(F.max(F.struct("size", "host_size", "rule", "verdict")).alias("best"), F.sum("first").alias("rows")))
    return (best.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
            .select("id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
