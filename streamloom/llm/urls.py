"""URL filter: allow and block rules in a trie over reversed host labels and path segments; the longest match wins.

A rule is a host and a path prefix. It fits its host and every subdomain when the url's path starts with the rule's.
Among the fitting rules the one with most host labels wins, then the longest path, then ``block`` before ``allow``.

Host: what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to
``?``, ``#`` or the end. Null urls and urls without ``://`` have both empty, match no rule and get the default verdict;
so do all urls if there are no rules. Repeated rows are judged alike; very long urls are walked once, label by label.
Other columns are kept; clashing names are replaced by the operator's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.common import column, free_name, map_arrow, plus, table

#: Rules are broadcast as a trie only up to these bounds; beyond, they are joined by trie node.
MAX_TRIE_RULES, MAX_TRIE_CHARS = 200_000, 16 << 20
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url) -> tuple[F.Column, F.Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, "(?s)^.*?://", "")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), *LETTERS), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


class HostTrie:
    """Nodes are dictionaries; host labels lead down from the last, then ``/`` opens the path, segment by segment."""

    def __init__(self, rules):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("h", label), {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            ends = node.setdefault("ends", {})
            if ends.get(rest, ("",))[0] != "block":
                ends[rest] = (verdict, host + path)
        self._order(self.root)

    def _order(self, root: dict) -> None:
        todo = [root]
        while todo:
            node = todo.pop()
            if "ends" in node:
                node["ends"] = sorted(node["ends"].items(), key=lambda e: -len(e[0]))
            todo += [v for k, v in node.items() if k != "ends"]

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        hosts, node = [self.root], self.root
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            hosts.append(node)
        segments = path.split("/")
        for start in reversed(hosts[1:]):  # most host labels first
            nodes, node = [(start, 0)], start
            for k, segment in enumerate(segments[:-1]):
                node = node.get(("p", segment))
                if node is None:
                    break
                nodes.append((node, k + 1))
            for node, k in reversed(nodes):  # longest path first
                for rest, found in node.get("ends", ()):
                    if segments[k].startswith(rest):
                        return found
        return None, None


def judge(df: DataFrame, rules, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict. ``rules``: (verdict, host, path) tuples or a DataFrame of these columns.

    A rule frame is measured first: a bounded one becomes a broadcast trie; a larger one is joined by trie node.
    """
    host, path = host_and_path(F.col(url_col))
    df = df.drop(*(c for c in df.columns if c.lower() in ("host", "path", "rule", "verdict"))).withColumns({"host": host, "path": path})
    if isinstance(rules, DataFrame):
        n, chars = rules.agg(F.count("*"), F.sum(F.length("host") + F.length("path"))).first()
        if n > MAX_TRIE_RULES or (chars or 0) > MAX_TRIE_CHARS:
            return _judge_by_join(df, rules, default)
        rules = [tuple(r) for r in rules.select("verdict", "host", "path").collect()]
    return _judge_by_trie(df, rules, default)


def _judge_by_trie(df: DataFrame, rules: list, default: str) -> DataFrame:
    shipped = df.sparkSession.sparkContext.broadcast(list(rules))
    keep = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = HostTrie(shipped.value)
        for b in batches:
            memo: dict = {}
            found = []
            for key in zip(column(b, "host").to_pylist(), column(b, "path").to_pylist(), strict=True):
                if key not in memo:
                    memo[key] = trie.find(*key)
                found.append(memo[key])
            rule, verdict = pa.array([f[1] for f in found], pa.string()), pa.array([f[0] or default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in keep), rule, verdict], [*keep, "rule", "verdict"])

    return map_arrow(df, run, plus(df.schema, rule="string", verdict="string"))


def _judge_by_join(df: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Every (host suffix, whole segments) node of a distinct url meets the rules that end there."""
    cut = F.regexp_extract("path", "(?s)^(.*/)?", 1)
    nodes = rules.select("verdict", "host", "path", cut.alias("node_path"), F.concat("host", "path").alias("rule"))
    pages = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))
    asked = pages.withColumn("at_host", F.explode(suffixes)).withColumn("node_path", F.explode(prefixes))
    met = asked.join(nodes.select("verdict", F.col("host").alias("at_host"), "node_path", "rule", F.col("path").alias("rule_path")), ["at_host", "node_path"]).filter(F.expr("startswith(path, rule_path)"))
    order = F.struct(F.size(F.split("at_host", r"\.")), F.length("rule_path"), (F.col("verdict") == "block").cast("int"), "rule")
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    name = free_name(df, "best")
    best = best.withColumnRenamed("best", name)
    return df.join(best, ["host", "path"], "left").select(*df.columns, F.col(f"{name}.rule").alias("rule"), F.coalesce(f"{name}.verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH r(verdict, rhost, rpath) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
rest AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS t FROM pages),
p AS (SELECT page_id, k, translate(regexp_extract(t, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
m AS (SELECT p.k, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY p.k ORDER BY length(rhost) DESC, length(rpath) DESC) AS n
      FROM p JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE n = 1) AS best USING (k)
"""
