"""URL filters as a sort-merge range join.

A rule is a host suffix and a path prefix. Written with its labels reversed and each ended by U+0000 (here a comma:
``m.example.net`` -> ``net,example,m,``) a host suffix becomes a key prefix, that is an interval of keys:
all hosts under ``example.net`` lie in [``net,example,``, ``net,example-``). Keys and rules are dealt out by ranges
of the key, sorted, and swept once; a stack holds the hosts whose intervals contain the present key. Intervals of prefixes
nest or are disjoint, so popping from the top is enough. Each host on the stack has its path prefixes, which are sorted, nested intervals too: a path
is found by binary search and steps outward. A range gets only the rules whose intervals
reach into it, so neither table is ever whole in a task. The longest host wins, then the longest path.

Edge cases: a null url or one without ``://`` has an empty host and path and can match only a rule with an empty host.
A null rule host or path counts as empty; of equal rules the verdict that sorts first wins. An empty rule table gives every
url the default verdict. Repeated urls and ids are each judged. Input columns besides the two named are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import materialize

END = "\x00"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical_key(host: Column) -> Column:
    """Reversed labels, each ended by U+0000; one that is in the host itself is escaped."""
    plain = F.replace(F.replace(host, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    return F.concat(F.array_join(F.reverse(F.split(plain, "[.]")), END), F.lit(END))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``rules(host, path, verdict)`` -> ``(id, url key columns host and path, rule, verdict)`` for every row of ``pages``."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("key", canonical_key(F.col("host")))
    urls = urls.select("key", F.lit(1).alias("kind"), F.xxhash64("id", "path").alias("tie"), "id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    named = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    named = named.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("key", F.when(F.col("host") == "", "").otherwise(canonical_key(F.col("host"))))
    named = named.select("key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("tie"), F.lit(None).cast(urls.schema["id"].dataType).alias("id"), "host", "path", "verdict")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = named.unionByName(urls).repartitionByRange(parts, "key", "kind", "tie").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "urls")
    # Rules of earlier ranges whose intervals reach into a range are those at the prefixes of its first key: an equi-join, for one row a range.
    first = dealt.groupBy("part").agg(F.min("key").alias("first")).withColumn("labels", F.split("first", END, -1))
    up = first.select("part", F.explode(F.transform(F.sequence(F.lit(0), F.size("labels") - 1), lambda k: F.concat(F.array_join(F.slice("labels", 1, k), END), F.when(k > 0, END).otherwise("")))).alias("key"))
    stream = dealt.drop("tie").unionByName(up.distinct().join(named.drop("tie"), "key"))
    stream = stream.select("part", "key", "kind", "id", "host", "path", "verdict").repartition(parts, "part").sortWithinPartitions("part", "key", "kind", "path")
    kind = urls.schema["id"].dataType.simpleString()
    out = stream.mapInArrow(lambda batches: _sweep(batches, default), f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


class Paths:
    """The path rules of one host, added in ascending order. Prefixes are intervals of paths: they nest, and each knows the next wider one around it."""

    def __init__(self, host: str):
        self.host, self.paths, self.verdicts, self.around = host, [], [], []

    def add(self, path: str, verdict: str) -> None:
        if self.paths and self.paths[-1] == path:
            return
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.around[at]
        self.paths.append(path)
        self.verdicts.append(verdict)
        self.around.append(at)

    def find(self, path: str) -> tuple[str, str] | None:
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.around[at]
        return (self.host + self.paths[at], self.verdicts[at]) if at >= 0 else None


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    part, stack = None, []  # of (key prefix, Paths)
    for b in batches:
        rows, out = b.to_pydict(), ([], [], [], [], [])
        for p, key, kind, i, host, path, verdict in zip(*rows.values(), strict=True):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not kind:
                if not stack or stack[-1][0] != key:
                    stack.append((key, Paths(host)))
                stack[-1][1].add(path, verdict)
                continue
            found = (x.find(path) for _, x in reversed(stack) if x.host or not host)
            rule, own = next(filter(None, found), (None, default))
            for column, x in zip(out, (i, host, path, rule, own), strict=True):
                column.append(x)
        schema = pa.schema([("id", b.schema.field("id").type), *((n, pa.string()) for n in ("host", "path", "rule", "verdict"))])
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
